import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from statloom.llm import pii
from tests.llm import plain

TRICKY = [
    "a@b.c_d@e.f x@y..z @q.r a@b@c.d u%v@host-1.example.co.uk. p@q.r.",
    "1.2.3.4.5.6.7.8 300.1.2.3.4 0255.000.1.01 1.2.3 .1.2.3.4. 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 4111  1111 1111 1111 4-1 1-1 5",
    "+1 (045) 555-3286 170.106.47.218 +49.30.123456-78 +1 2 + 3 ++44 20 7946 0958 (x) +1234567890123456",
    "7 5 - 4111111111111111 -4111111111111111- 4111111111111111 ",
    "é🙂 ana@mail.example.com 日本 10.0.0.1🙂+1 (045) 555-3286",
    "a" * 3000 + "@" + "b" * 3000, "1" * 5000, "1 " * 4000, "1.1." * 2000, "+" * 2000, "+1" + " " * 5000, "a@a." * 1500, "x@" + "y." * 4000 + "z",
]


def test_fixed_formats_equal_brute_force(spark, docs, doc_rows):
    draw = random.Random(4)
    mixed = ["".join(draw.choices("01239 -.@+()a\n", k=draw.randint(1, 120))) for _ in range(400)]
    rows = [*doc_rows, *((1000 + i, t) for i, t in enumerate([*TRICKY, *mixed]))]
    found = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").select("doc_id", pii.all_spans(F.col("text"), pii.Model()).alias("f"))
    got = {r["doc_id"]: {k: [tuple(x) for x in r["f"][k]] for k in pii.KINDS} for r in found.collect()}
    assert got == {d: plain.fixed_formats(t) for d, t in rows}


def test_all_rows_have_counts_digest_and_spans(docs, doc_rows):
    texts = dict(doc_rows)
    kinds = set()
    for r in pii.personal_data(docs).collect():
        base = plain.fixed_formats(texts[r["doc_id"]])
        text = plain.written(base)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(len(v) for v in base.values())
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["spans"].startswith(text)
        kinds |= {s.split(":")[0] for s in r["spans"].split(",") if s}
        for s in filter(None, r["spans"].split(",")):
            kind, a, b = s.split(":")
            found = texts[r["doc_id"]][int(a) : int(b)]
            if kind == "key":
                assert re.fullmatch("[0-9a-fA-F]{40}", found)
    assert {"email", "ip", "card", "phone", "key"} <= kinds


def test_redaction(docs, doc_rows, no_docs):
    done = pii.redacted(docs)
    assert done.columns == docs.columns and done.dtypes == docs.dtypes
    texts = dict(doc_rows)
    for r in done.collect():
        before = texts[r["doc_id"]]
        if before is None:
            assert r["text"] is None
            continue
        assert not any(plain.fixed_formats(r["text"]).values())
        assert r["n_chars"] == len(r["text"])
        if before == r["text"]:
            assert not any(plain.fixed_formats(before).values())
        else:
            pieces = re.split(r"\[(?:EMAIL|IP|CARD|PHONE|KEY|NUMBER|FORMATTED|ADDRESS)\]", r["text"])
            at = 0
            for piece in pieces:
                at = before.index(piece, at) + len(piece)
    assert pii.redacted(no_docs).count() == 0 and pii.personal_data(no_docs).count() == 0


def test_overlapping_spans_are_replaced_once(spark):
    df = spark.createDataFrame([("0123456789",)], "text STRING")
    spans = lambda *p: F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in p))
    found = F.struct(spans((2, 5)).alias("card"), spans((3, 7), (8, 9)).alias("key"))
    assert df.select(pii._redacted(F.col("text"), found, ["card", "key"])).first()[0] == "01[CARD]7[KEY]9"


def test_trees_as_columns_equal_trees_in_numpy(spark):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 12, (600, len(pii.FEATURES))).astype(float)
    x[:, 0] = draw.integers(0, 4, 600)
    y = (x[:, 2] > 5) | (x[:, 8] > 8)
    model = pii.boost(x, y)
    scores = np.full(len(x), model.bias) + sum(t.scores(x) for t in model.trees)
    assert ((scores > 0) == y).mean() > 0.98 and set(model.thresholds) == set(pii.GENERATORS)
    df = spark.createDataFrame([(i, tuple(int(v) for v in r)) for i, r in enumerate(x)], "i INT, f STRUCT<" + ", ".join(f"{c}: INT" for c in pii.FEATURES) + ">")
    got = [r[1] for r in df.select("i", model.score(F.col("f"))).orderBy("i").collect()]
    assert np.allclose(got, scores)


def test_scoring_stays_in_the_jvm(docs):
    plan = pii.personal_data(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_keys_and_names_of_any_length(spark, docs):
    draw = random.Random(8)
    keys = {1000 + n: "".join(draw.choices("0123456789abcdef", k=n)) for n in (40, 200, 201, 240, 5000)}
    more = spark.createDataFrame([(d, f"some words token = {key} and more") for d, key in keys.items()], "doc_id BIGINT, text STRING")
    both = docs.select("doc_id", "text").union(more)
    spans = {r["doc_id"]: r["spans"].split(",") for r in pii.personal_data(both).where("doc_id >= 1000").collect()}
    assert all(f"key:19:{19 + len(key)}" in spans[d] for d, key in keys.items())
    texts = {r["doc_id"]: r["text"] for r in pii.redacted(both).where("doc_id >= 1000").collect()}
    assert set(texts.values()) == {"some words token = [KEY] and more"}
    long = "ana." + "b" * 5000 + " [at] example [dot] com"
    offered = spark.createDataFrame([(long,)], "text STRING").select(pii.proposals(F.col("text"))["address"].alias("a")).first()["a"]
    assert [(x["start"], x["end"]) for x in offered] == [(0, len(long))]


def test_spelled_out_addresses_are_selected(spark, docs):
    shown = ["ana [at] example [dot] com", "ana at example dot com", "ana(at)example(dot)com"]
    prose = ["we looked at pictures. Then we left", "they sat at tables. Nobody came"]
    texts = {1000 + i: f"please write to {t} or so" for i, t in enumerate(shown)} | {2000 + i: t for i, t in enumerate(prose)}
    mails = [(3000 + i, f"ask {n}@example.com or come") for i, n in enumerate(("ana", "bob.b", "carl", "dora-d", "emil", "f.g", "gus", "hal", "ina_k", "jo") * 3)]
    told = [(4000 + i, f"{w} at {v}. {u} went on") for i, (w, v, u) in enumerate((("sat", "home", "She"), ("look", "that", "He"), ("arrive", "noon", "We")) * 10)]
    rows = [*texts.items(), *((d, f"{d} {t}") for d, t in [*mails, *told])]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(both).where("doc_id >= 1000 AND doc_id < 3000").collect()}
    assert got == {d: f"address:16:{len(t) - 6}" if d < 2000 else "" for d, t in texts.items()}


HARMLESS = [
    "order 123456789012 came", "a population 1402112000 people", "timestamp 1700000000123", "ISBN 9783161484100", "ISBN 978 3 16 148410 0",
    "commit 3f2a9c0d1e4b5a69788796a5b4c3d2e1f0a9b8c7", "fixed by 3f2a9c0d1e4b5a69788796a5b4c3d2e1f0a9b8c7 now", "see 550e8400-e29b-41d4-a716-446655440000",
    "in 1990 2000 2010 and", "on 12 34 5678 it", "on 03.04.2020 we", "the key distinction between them", "password: required here",
    "this-is-a-long-slug-of-a-page-title", "some_long_function_name_of_a_module", "they sat at tables. Nobody came", "we met at 10. Then we left",
]
PERSONAL = {
    "token = abcdefghijklmnopqrstuvwxyzabcd": "abcdefghijklmnopqrstuvwxyzabcd",
    "password: hunter2x9 here": "hunter2x9",
    'api_key = "681c09b8e90e7e8c9575180f595f646cf2969054"': "681c09b8e90e7e8c9575180f595f646cf2969054",
    "write to ana at mail dot example dot com or so": "ana at mail dot example dot com",
    "write to ana [at] example [dot] com": "ana [at] example [dot] com",
    "call 030 1234 5678 now": "030 1234 5678",
    "or (030) 1234 5678 now": "(030) 1234 5678",
    "phone 0301234567 now": "0301234567",
    "SSN 123-45-6789": "123-45-6789",
}


def test_harmless_look_alikes_stay_and_personal_data_goes(spark, docs, no_docs):
    for known in (docs, no_docs):
        model = pii.learn(known)
        df = spark.createDataFrame([(t,) for t in [*HARMLESS, *PERSONAL]], "text STRING")
        got = {r["text"]: [r["text"][a:b] for spans in r["f"] for a, b in spans] for r in df.select("text", pii.all_spans(F.col("text"), model).alias("f")).collect()}
        assert {t: got[t] for t in HARMLESS} == dict.fromkeys(HARMLESS, [])
        assert {t: got[t] for t in PERSONAL} == {t: [s] for t, s in PERSONAL.items()}


def test_trees_use_many_features_and_thresholds_hold_out(spark, docs):
    model = pii.learn(docs)

    def features(tree):
        return set() if tree.left is None else {tree.feature} | features(tree.left) | features(tree.right)

    assert len(set().union(*map(features, model.trees))) >= 8
    draw = pii._taught_rows(docs).toPandas()
    assert set(draw.groupby("generator")["y"].nunique()) == {2}
    x, y = draw[pii.FEATURES].to_numpy(float), draw["y"].to_numpy()
    scores = np.full(len(x), model.bias) + sum(t.scores(x) for t in model.trees)
    for i, kind in enumerate(pii.GENERATORS):
        own = x[:, 0] == i
        chosen = scores[own] > model.thresholds[kind]
        assert y[own][chosen].mean() > 0.97 and chosen[y[own]].mean() > 0.85, kind
