import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom import schemas
from statloom.operators import impurity, tree
from statloom.plans.trees import stored_tree, tree_of_file
from statloom.storage import materialize
from tests.conftest import LENS_FEATURES


def by_path(nodes):
    return {r["node_id"]: r for r in nodes.collect()}


def plain_tree(rows, features, max_depth=None, path="/", depth=0, out=None):
    """Recursive ID3 over tuples (features..., label): path -> (split, label, rows)."""
    out = {} if out is None else out

    def bits(labels):
        return -sum(c / len(labels) * math.log2(c / len(labels)) for c in Counter(labels).values())

    labels = [r[-1] for r in rows]
    counts = Counter(labels)
    majority = min(counts, key=lambda v: (-counts[v], v))
    gains = []
    for i in range(len(features)):
        groups = {}
        for r in rows:
            groups.setdefault(r[i], []).append(r[-1])
        gains.append(round(bits(labels) - sum(len(g) / len(rows) * bits(g) for g in groups.values()), 9))
    best = max(range(len(features)), key=lambda i: (gains[i], -i))
    stop = len(counts) == 1 or gains[best] <= 1e-9 or depth == max_depth
    out[path] = (None if stop else features[best], majority, len(rows))
    if not stop:
        for value in {r[best] for r in rows}:
            step = f"{features[best]}={value}/"
            plain_tree([r for r in rows if r[best] == value], features, max_depth, path + step, depth + 1, out)
    return out


def test_entropy_and_gain_of_fish(fish):
    assert impurity.entropy(fish).first()["entropy"] == pytest.approx(0.9709505945)
    gains = {r["feature"]: r["gain"] for r in impurity.information_gain(fish, ["no surfacing", "flippers"]).collect()}
    assert gains == {"no surfacing": pytest.approx(0.4199730940), "flippers": pytest.approx(0.1709505945)}
    best = impurity.best_split(impurity.information_gain(fish, ["no surfacing", "flippers"]))
    assert best.first()["feature"] == "no surfacing"


def test_entropy_and_gain_of_lenses(lenses):
    assert impurity.entropy(lenses).first()["entropy"] == pytest.approx(1.3260875254)
    gains = {r["feature"]: r["gain"] for r in impurity.information_gain(lenses, LENS_FEATURES).collect()}
    expected = {"age": 0.0393965036, "prescript": 0.0395108354, "astigmatic": 0.3770052300, "tearRate": 0.5487949407}
    assert gains == {k: pytest.approx(v) for k, v in expected.items()}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("pqr"), st.sampled_from("xyz")), min_size=1, max_size=30))
def test_gain_lies_between_zero_and_entropy(spark, rows):
    df = spark.createDataFrame(rows, "f STRING, g STRING, label STRING")
    whole = impurity.entropy(df).first()["entropy"]
    for r in impurity.information_gain(df, ["f", "g"]).collect():
        assert 0 <= r["gain"] <= whole + 1e-9 and r["base_entropy"] == pytest.approx(whole, abs=1e-9)


def test_pure_and_empty_entropy(spark):
    df = spark.createDataFrame([("a",), ("a",)], "label STRING")
    assert tuple(impurity.entropy(df).first()) == (2, 0.0)
    assert impurity.entropy(df.where("label = 'b'")).first()["n_rows"] is None


def test_best_split_takes_the_first_of_equal_features(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "p INT, q INT, label STRING")
    assert impurity.best_split(impurity.information_gain(df, ["q", "p"])).first()["feature"] == "q"
    same = spark.createDataFrame([(1, "a"), (1, "b")], "p INT, label STRING")
    assert impurity.best_split(impurity.information_gain(same, ["p"])).count() == 0


def test_split_rows(fish):
    rows = impurity.split_rows(fish, "flippers", 0)
    assert rows.columns == ["no surfacing", "label"] and rows.collect() == [(1, "no")]


def test_majority_label(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x"), (2, "x"), (2, "a")], "g INT, label STRING")
    assert sorted(impurity.majority_label(df, "g").collect()) == [(1, "a", 1), (2, "x", 2)]


def test_fish_tree(spark, fish):
    nodes = tree.train(fish, ["no surfacing", "flippers"])
    got = by_path(nodes)
    assert set(got) == {"/", "/no surfacing=0/", "/no surfacing=1/", "/no surfacing=1/flippers=0/", "/no surfacing=1/flippers=1/"}
    leaf = got["/no surfacing=1/flippers=1/"]
    assert (leaf["label"], leaf["parent_id"], leaf["edge_feature"], leaf["edge_value"]) == ("yes", "/no surfacing=1/", "flippers", "1")
    assert tuple(tree.leaves_and_depth(nodes).first()) == (3, 2)
    rows = spark.createDataFrame([(1, 1), (0, 1), (7, 1), (1, None)], "`no surfacing` INT, flippers INT")
    assert [r["predicted"] for r in tree.classify(rows, nodes, ["no surfacing", "flippers"]).collect()] == ["yes", "no", None, None]
    usual = tree.classify(rows, nodes, ["no surfacing", "flippers"], on_unseen="majority")
    assert [r["predicted"] for r in usual.collect()] == ["yes", "no", "no", "yes"]


def test_lenses_tree(lenses, lens_rows):
    nodes = tree.train(lenses, LENS_FEATURES)
    assert tuple(tree.leaves_and_depth(nodes).first()) == (9, 4)
    want = plain_tree(lens_rows, LENS_FEATURES)
    got = {k: (r["split_feature"], r["label"], r["n_rows"]) for k, r in by_path(nodes).items()}
    assert got == want
    assert got["/"][0] == "tearRate" and got["/tearRate=reduced/"][1] == "no lenses"
    scored = tree.classify(lenses, nodes, LENS_FEATURES)
    assert scored.where("label <> predicted or predicted is null").count() == 0


def random_rows(n=400):
    rng = random.Random(2)
    return [tuple(str(rng.choice([0, 0, 0, rng.randrange(4)])) for _ in range(4)) + (rng.choice("xyz"),) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"driver_nodes": 0}, {"driver_nodes": 0, "broadcast_bytes": 0}, {"broadcast_bytes": 0}])
def test_all_ways_to_grow_give_one_tree(spark, options):
    rows, features = random_rows(), ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "a STRING, b STRING, c STRING, d STRING, label STRING")
    nodes = tree.train(df, features, max_depth=3, **options)
    got = {k: (r["split_feature"], r["label"], r["n_rows"]) for k, r in by_path(nodes).items()}
    assert got == plain_tree(rows, features, max_depth=3)
    assert nodes.where("is_leaf").agg(F.sum("n_rows")).first()[0] == len(rows)


@pytest.mark.parametrize("on_unseen", ["null", "majority"])
@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_routed_scoring_equals_compiled(spark, on_unseen, broadcast_bytes):
    features = ["a", "b", "c", "d"]
    df = spark.createDataFrame(random_rows(), "a STRING, b STRING, c STRING, d STRING, label STRING")
    nodes = tree.train(df.where("a <> '3'"), features, max_depth=3)
    ids = df.withColumn("id", F.monotonically_increasing_id())
    compiled = tree.classify(ids, nodes, features, on_unseen)
    routed = tree.classify(ids, nodes, features, on_unseen, compiled_nodes=0, broadcast_bytes=broadcast_bytes)
    assert compiled.columns == routed.columns
    assert sorted(compiled.collect(), key=str) == sorted(routed.collect(), key=str)


def test_deep_trees_are_walked_without_a_join(spark, capsys, monkeypatch):
    rng = random.Random(11)
    features = [f"f{i}" for i in range(8)]
    rows = []
    for _ in range(600):
        bits = [rng.choice(["0", "1", None, "x y\\"]) for _ in features]
        rows.append((*bits, "".join(b or "-" for b in bits)[: rng.randint(2, 8)]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} STRING" for c in [*features, "label"]))
    nodes = materialize(tree.train(df, features), "t")
    assert tree.leaves_and_depth(nodes).first()["depth"] >= 6
    for on_unseen in ("null", "majority"):
        unseen = df.withColumn("f0", F.when(F.rand(1) < 0.2, "new").otherwise(F.col("f0")))
        walked = tree.classify(unseen, nodes, features, on_unseen, compiled_nodes=0)
        walked.explain()
        assert "Join" not in capsys.readouterr().out
        joined = tree.classify(unseen, nodes, features, on_unseen, compiled_nodes=0, broadcast_bytes=0)
        assert sorted(walked.collect(), key=str) == sorted(joined.collect(), key=str)
    monkeypatch.setattr(tree, "WALKED_EDGES", 1)
    tree.classify(df, nodes, features, compiled_nodes=0).explain()
    assert "Join" in capsys.readouterr().out


def test_mixed_node_without_gain_is_a_majority_leaf(spark):
    xor = spark.createDataFrame([(0, 0, "n"), (0, 1, "y"), (1, 0, "y"), (1, 1, "n")], "p INT, q INT, label STRING")
    nodes = tree.train(xor, ["p", "q"]).collect()
    assert len(nodes) == 1 and nodes[0]["is_leaf"] and nodes[0]["label"] == "n"


def test_limits(lenses):
    assert tree.train(lenses, LENS_FEATURES, max_depth=0).count() == 1
    assert tree.leaves_and_depth(tree.train(lenses, LENS_FEATURES, max_depth=1)).first()["depth"] == 1
    small = tree.train(lenses, LENS_FEATURES, min_rows=12)
    assert small.where("not is_leaf and n_rows < 12").count() == 0 and small.count() > 3


def test_values_with_path_characters_and_missing_values(spark):
    rows = [("a/b=c", "1"), ("%00", "2"), (None, "3"), ("%2F", "4"), ("", "5")]
    df = spark.createDataFrame(rows, "`f=/x` STRING, label STRING")
    nodes = tree.train(df, ["f=/x"])
    edges = {(r["edge_value"], r["label"]) for r in nodes.where("depth = 1").collect()}
    assert edges == set(rows)
    assert {r["edge_feature"] for r in nodes.where("depth = 1").collect()} == {"f=/x"}
    for compiled in (400, 0):
        scored = tree.classify(df, nodes, ["f=/x"], compiled_nodes=compiled)
        assert scored.where("label <> predicted or predicted is null").count() == 0


def test_features_may_have_any_name(spark):
    names = ["n", "label", "n_rows", "a.b", "it's\\"]
    rows = [(str(i % 2), str(i % 3), "v\nw" if i % 5 else "x", str(i % 7), str(i % 2), str(i % 6)) for i in range(42)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` STRING" for c in [*names, "y"]))
    gains = {r["feature"]: r["gain"] for r in impurity.information_gain(df, names, "y").collect()}
    assert gains["n"] == pytest.approx(1.0) and gains["n_rows"] < 0.1
    nodes = tree.train(df, names, "y")
    want = plain_tree(rows, names)
    assert {r["split_feature"] for r in nodes.collect()} == {split for split, _, _ in want.values()}
    for compiled in (400, 0):
        scored = tree.classify(df, nodes, names, compiled_nodes=compiled)
        assert scored.where("y <> predicted or predicted is null").count() == 0
    turned = tree.train(df, ["n_rows", "label"], "y")
    assert turned.where("edge_feature = 'n_rows' and edge_value = 'v\\nw' and parent_id is not null").count() >= 1


def test_canned_trees(spark):
    def node(path, split, label=None):
        depth = path.count("/") - 1
        return (path, None, depth, None, None, split, 1, label, split is None, None)

    small = [node("/", "s"), node("/s=0/", None, "no"), node("/s=1/", "f"), node("/s=1/f=0/", None, "no"), node("/s=1/f=1/", None, "yes")]
    assert tuple(tree.leaves_and_depth(spark.createDataFrame(small, schemas.NODE_SCHEMA)).first()) == (3, 2)
    deep = small[:3] + [
        node("/s=1/f=0/", "h"), node("/s=1/f=0/h=0/", None, "no"), node("/s=1/f=0/h=1/", None, "yes"), node("/s=1/f=1/", None, "no")
    ]
    assert tuple(tree.leaves_and_depth(spark.createDataFrame(deep, schemas.NODE_SCHEMA)).first()) == (4, 3)


def test_file_to_stored_tree(spark, lens_rows, tmp_path):
    path = tmp_path / "lenses.txt"
    path.write_text("\n".join("\t".join(r) for r in lens_rows) + "\n")
    nodes = tree_of_file(spark, str(path))
    loaded = stored_tree(spark, nodes, str(tmp_path / "tree"))
    assert sorted(loaded.collect(), key=str) == sorted(nodes.collect(), key=str)
    assert loaded.count() == 15


def test_routing_reads_rows_once_however_deep_the_tree(spark):
    """With nothing broadcast, each level adds the same number of scans to the plan."""
    features = [f"f{i}" for i in range(6)]
    rows = [tuple(str(n >> i & 1) for i in range(6)) + (str(bin(n).count("1")),) for n in range(64)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} STRING" for c in [*features, "label"]))
    nodes = tree.train(df, features)
    assert nodes.agg(F.max("depth")).first()[0] == 6
    stored = materialize(nodes, "deep-tree")
    scans = []
    for depth in range(1, 7):
        cut = stored.where(F.col("depth") <= depth)
        scored = tree.classify(df, cut, features, on_unseen="majority", compiled_nodes=0, broadcast_bytes=0)
        scans.append(scored._jdf.queryExecution().optimizedPlan().collectLeaves().size())
    assert scans == [1 + 2 * d for d in range(1, 7)]
    whole = tree.classify(df, stored, features, compiled_nodes=0, broadcast_bytes=0)
    assert whole.where("predicted <> label").count() == 0 and whole.count() == 64
