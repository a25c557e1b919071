"""Personal data: fixed formats, and further spans chosen by boosted trees.

Four fixed formats (email, ip, card, phone) are always found.  Beyond them,
high-recall generators propose spans that may overlap: numbers, formatted
numbers, long keys, spelled-out addresses.  A gradient-boosted ensemble of
small trees scores each by its format and what stands before it; a threshold
per generator, set for precision on held-out proposals, selects the redactions.

There are no labelled spans, so the trees learn from what is sure.  In the documents,
proposals that overlap a fixed format and long keys that follow a key's name (``token = ``)
are positive; keys and addresses without digits or such a name, numbers inside longer
words and what follows a harmless name (``order``, ``commit``) are negative; the rest takes
no part in learning.  Spelled-out addresses overlap no e-mail: the e-mails, spelled
out, are positives, and negatives have neither a written dot nor brackets
nor a known top-level domain.  As documents rarely hold the harmless look-alikes (dates, years,
order numbers, ISBNs, hashes, UUIDs), ``TAUGHT`` generated spans of both classes are
added (``taught``).  Learning reads a bounded sample; searching, scoring and redacting are column
expressions over whole texts and run in the JVM only.

Defined cases: a null text counts as empty; equal texts get equal spans;
without documents to learn from only the generated spans teach; offsets count
code points, the end is exclusive.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import let

#: Documents and proposals read for learning, at most (those with the smallest hashes).
TRAINING_DOCUMENTS = 5_000
TRAINING_SPANS = 40_000
PRECISION = 0.98
#: Generated spans that are learnt from as well.
TAUGHT = 6_000
TREES, DEPTH, RATE, BINS = 24, 4, 0.3, 24

# Fixed formats.  Runs of single-character classes only (no repeated groups without a bound), so that neither depth nor
# time of matching grows beyond the length of a text; the look-behinds skip starts that cannot do better than the first.
EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]+\.[A-Za-z0-9-])"
    r"[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.?(?:[^A-Za-z0-9.-]|\z)|\.\.)"
)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"

#: What stands between the parts of a spelled-out domain.
_DOT = r"(?: ?\[dot\] ?| ?\(dot\) ?| dot |\.)"
_SECRET = r"token|key|secret|password|passwd|credential|credentials|auth"
# Generators: kind, pattern, and what a text must contain to be searched.  Keys and names may have any length; a key that
# is assigned to a name may be short.
GENERATORS = {
    "address": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]++"
        rf"(?:(?:{_DOT}[A-Za-z0-9-]++){{0,4}}{_DOT}[A-Za-z]{{2,24}}| ?\. ?[A-Za-z]{{2,24}})",
        r"(?:\[at\]|\(at\)| at )",
    ),
    "key": (
        rf"(?<![A-Za-z0-9_-])(?:[A-Za-z0-9_-]{{24,}}+|(?<=(?i:{_SECRET})[\"']? ?[=:] ?[\"']?)[A-Za-z0-9_-]{{8,}}+)",
        rf"[A-Za-z0-9_-]{{24}}|(?i:{_SECRET})[\"']? ?[=:]",
    ),
    "number": (r"(?<![0-9])[0-9]{9,19}(?![0-9])", r"[0-9]{9}"),
    "formatted": (
        r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{2,4}[ .-][0-9]{4}(?![0-9])",
        r"[0-9][ .-][0-9]{4}",
    ),
}

KINDS = ["email", "ip", "card", "phone"]
SPAN = "struct<start:int,end:int,s:string,before:string>"
FEATURES = [
    "generator", "size", "digits", "letters", "capitals", "others", "past_f", "varied", "luhn", "spelled",
    "first", "opened", "years", "glued", "keyed", "contact", "harmless",
]
# What stands before a span: the name of a secret, of personal data, or of a number that belongs to no person.
_KEY_NAME = rf"(?i)(?:{_SECRET})[\"']? ?[=:]+>? ?[\"']?$"
_NUMBERED = r"(?:[ _-]?(?:number|no|nr|id))?[^A-Za-z0-9]*$"
_CONTACT_NAME = (
    r"(?i)(?:phone|mobile|cell|tel|fax|sms|call|call (?:me|us)|mail|card|account|acct|iban|ssn|social security|passport|licen[cs]e)"
    r"(?: (?:at|on|is))?" + _NUMBERED
)
_HARMLESS_NAME = (
    r"(?i)(?<![a-z])(?:order|invoice|item|product|part|serial|ticket|batch|isbn|issn|ean|upc|doi|arxiv|time|timestamp|epoch|date|version|build|"
    r"commit|sha|sha1|sha256|md5|hash|checksum|digest|revision|uuid|guid|id|population|total|sum|count|bytes|size|page|years?)" + _NUMBERED
)
#: What tells a spelled-out address from 'at' in running prose; and the part of an e-mail that would be proposed.
_MARKED = r"\[at\]|\(at\)|\[dot\]|\(dot\)| dot "
_TOP_LEVEL = r"\.(?:com|org|net|edu|gov|mil|info|biz|io|eu|uk|de|fr|es|nl|ch|jp|ru|cn|br)$"
_PLAIN_EMAIL = r"^([A-Za-z0-9._%+-]+)@([A-Za-z0-9-]+)\.([A-Za-z]{2,24}).*$"
_SPELLINGS = ("$1 [at] $2 [dot] $3", "$1 at $2 dot $3", "$1(at)$2(dot)$3", "$1 at $2.$3")


def _spans(text: Column, pattern: str, needs: Column) -> Column:
    """Leftmost matches of ``pattern``, none overlapping, in order."""
    none = F.array().cast(f"array<{SPAN}>")
    # Each piece is what is skipped and then a match; the last piece takes the rest, so that no search starts twice.
    whole = F.lit(f"(?s)(.*?)({pattern}|\\z)")
    pieces = F.arrays_zip(F.regexp_extract_all(text, whole, 1).alias("gap"), F.regexp_extract_all(text, whole, 2).alias("hit"))

    def step(acc: Column, piece: Column) -> Column:
        gap, hit = piece["gap"], piece["hit"]
        start = (acc["at"] + F.length(gap)).cast("int")
        span = F.struct(
            start.alias("start"), (start + F.length(hit)).cast("int").alias("end"), hit.alias("s"), F.substring(gap, -24, 24).alias("before")
        )
        found = F.when(hit == "", acc["found"]).otherwise(F.concat(acc["found"], F.array(span)))
        return F.struct((start + F.length(hit)).cast("int").alias("at"), found.alias("found"))

    empty = F.struct(F.lit(0).alias("at"), none.alias("found"))
    return F.when(needs, F.aggregate(pieces, empty, step)["found"]).otherwise(none)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Whether the digits of ``s`` pass the Luhn check."""
    places = F.transform(F.split(F.reverse(_digits(s)), ""), lambda d, i: F.when(d == "", 0).otherwise(d.cast("int") * (1 + i % 2)))
    total = F.aggregate(places, F.lit(0), lambda acc, v: acc + v - F.when(v > 9, 9).otherwise(0))
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The fixed formats: matches that fail their check are dropped and not searched again."""
    between = lambda s, low, high: F.length(_digits(s)).between(low, high)
    return {
        "email": _spans(text, EMAIL, text.contains("@")),
        "ip": F.filter(_spans(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]")), lambda x: x["s"].rlike(f"^{PART}\\.{PART}\\.{PART}\\.{PART}$")),
        "card": F.filter(_spans(text, CARD, text.rlike(r"[0-9]")), lambda x: _luhn(x["s"])),
        "phone": F.filter(_spans(text, PHONE, text.contains("+")), lambda x: between(x["s"], 8, 15)),
    }


def proposals(text: Column) -> dict[str, Column]:
    return {kind: _spans(text, pattern, text.rlike(needs)) for kind, (pattern, needs) in GENERATORS.items()}


def _features(kind: str, x: Column) -> Column:
    s = x["s"]
    count = lambda keep: F.length(F.regexp_replace(s, f"[^{keep}]", ""))
    values = {
        "generator": F.lit(list(GENERATORS).index(kind)),
        "size": F.length(s),
        "digits": count("0-9"),
        "letters": count("A-Za-z"),
        "capitals": count("A-Z"),
        "others": F.length(F.regexp_replace(s, "[A-Za-z0-9]", "")),
        "past_f": count("g-zG-Z"),
        "varied": F.size(F.array_distinct(F.split(s, ""))),
        "luhn": _luhn(s).cast("int"),
        "spelled": F.when(s.rlike(_MARKED), 2).when(s.rlike(_TOP_LEVEL), 1).otherwise(0) if kind == "address" else F.lit(0),
        "first": F.length(F.regexp_extract(s, "[0-9]+", 0)),
        "opened": s.rlike("^[(+]").cast("int"),
        "years": F.size(F.regexp_extract_all(s, F.lit("(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"), 0)),
        "glued": x["before"].rlike("[A-Za-z0-9_-]$").cast("int"),
        "keyed": x["before"].rlike(_KEY_NAME).cast("int"),
        "contact": x["before"].rlike(_CONTACT_NAME).cast("int"),
        "harmless": x["before"].rlike(_HARMLESS_NAME).cast("int"),
    }
    return F.struct(*(values[f].cast("int").alias(f) for f in FEATURES))


@dataclass
class Tree:
    """``value`` at a leaf; else rows with ``feature <= threshold`` go left."""

    value: float = 0.0
    feature: str = ""
    threshold: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def column(self, f: Column, generator: int | None = None) -> Column:
        """The value for features ``f``; a known generator needs no comparison."""
        if self.left is None:
            return F.lit(float(self.value))
        if self.feature == "generator" and generator is not None:
            return (self.left if generator <= self.threshold else self.right).column(f, generator)
        low, high = self.left.column(f, generator), self.right.column(f, generator)
        return F.when(f[self.feature] <= self.threshold, low).otherwise(high)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, FEATURES.index(self.feature)] <= self.threshold, self.left.scores(x), self.right.scores(x))


@dataclass
class Model:
    bias: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    #: By generator; none: nothing of it is selected.
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, f: Column, generator: int | None = None) -> Column:
        total = F.lit(float(self.bias))
        for tree in self.trees:
            total = total + tree.column(f, generator)
        return total


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Tree:
    """A tree of Newton steps for gradients ``g`` and curvatures ``h``."""
    leaf = Tree(value=RATE * float(g.sum() / (h.sum() + 1.0)))
    if depth == 0 or len(x) < 8:
        return leaf
    own = g.sum() ** 2 / (h.sum() + 1.0)
    best, gain = None, 1e-6
    for j in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)))
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, j] <= cut
            gl, hl = g[low].sum(), h[low].sum()
            gr, hr = g.sum() - gl, h.sum() - hl
            better = gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0) - own
            if better > gain + 1e-9:
                best, gain = (j, float(cut)), float(better)
    if best is None:
        return leaf
    low = x[:, best[0]] <= best[1]
    return Tree(0.0, FEATURES[best[0]], best[1], _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted trees for the log-odds of ``y``; every third row calibrates the thresholds."""
    held = np.arange(len(x)) % 3 == 0
    if not (y[~held].any() and (~y[~held]).any()):
        return Model()
    # Equal rows are learnt from once, with their number as weight.
    rows, back = np.unique(np.column_stack([x[~held], y[~held]]), axis=0, return_inverse=True)
    weight = np.bincount(back.ravel()).astype(float)
    xt, yt = rows[:, :-1], rows[:, -1]
    share = np.clip((weight * yt).sum() / weight.sum(), 0.01, 0.99)
    model = Model(bias=float(np.log(share / (1 - share))))
    score = np.full(len(xt), model.bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(xt, weight * (yt - p), weight * p * (1 - p), DEPTH)
        model.trees.append(tree)
        score += tree.scores(xt)
    calibrate(model, x[held], y[held])
    return model


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Per generator, the lowest threshold whose selection is right often enough; even odds where no row tells."""
    score = np.full(len(x), model.bias) + sum(tree.scores(x) for tree in model.trees)
    for i, kind in enumerate(GENERATORS):
        own = x[:, 0] == i
        s, t = score[own], y[own]
        model.thresholds[kind] = 0.0
        if t.any() and not t.all():
            order = np.argsort(-s, kind="stable")
            right = np.cumsum(t[order]) / np.arange(1, len(s) + 1)
            last = np.append(s[order][1:] != s[order][:-1], True)  # equal scores are selected together
            good = np.flatnonzero((right >= PRECISION) & last)
            # Between the last score selected and the next, so that neither ``>`` nor rounding drops what is selected.
            ranked = np.append(s[order], s.min() - 1.0)
            model.thresholds[kind] = float(max(0.0, ranked[good[-1] : good[-1] + 2].mean())) if len(good) else float("inf")


def taught() -> list[tuple[str, str, str, bool]]:
    """Generated spans: kind, span, what stands before it, and whether it is personal.

    Numbers are personal after a personal name, or as card numbers; formatted ones also by the form of a phone or social
    security number; keys if assigned to the name of a secret, or if random in both cases and digits; addresses if spelled
    out with a domain.  Short plain words, slugs, hashes, UUIDs, dates, years, counts, numbers of things and prose are not.
    """
    draw = random.Random(10)
    small, capital, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    some = lambda chars, low, high=None: "".join(draw.choices(chars, k=draw.randint(low, high or low)))
    word = lambda: some(small, 2, 9)

    def plain() -> str:
        return f"{word()} {word()}" + draw.choice([" ", ", ", ". ", ": ", " ("])

    def personal() -> str:
        name = draw.choice(["phone", "Phone", "tel", "Tel.", "mobile", "fax", "call", "call me at", "card", "account number", "IBAN", "SSN", "passport no"])
        return f"{word()} {name}" + draw.choice([" ", ": ", " = "])

    def harmless() -> str:
        name = draw.choice(["order", "invoice no", "item", "serial number", "ISBN", "timestamp", "date", "version", "population", "total", "page", "id", "commit", "sha256", "uuid"])
        return f"{word()} {name}" + draw.choice([" ", ": ", " = ", " #"])

    def secret() -> str:
        return word() + " " + draw.choice(["token", "api_key", "key", "secret", "password", "auth"]) + draw.choice([" = ", ": ", "=", ' = "', "='"])

    def luhn(n: int) -> str:
        body = some(digits, n - 1)
        total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(body)))
        return body + str(-total % 10)

    def uuid() -> str:
        return "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12))

    def words() -> str:
        return draw.choice("-_").join(some(small, 3, 9) for _ in range(draw.randint(4, 7))).ljust(24, "s")

    def mixed(low: int, high: int) -> str:
        return draw.choice(small) + draw.choice(capital) + draw.choice(digits) + some(small + capital + digits, low - 3, high - 3)

    def number() -> tuple[str, str, bool]:
        n = some("123456789", 1) + some(digits, 8, 18)
        return draw.choice([
            lambda: (n, plain(), False),
            lambda: (n, harmless(), False),
            lambda: ("1" + some("5678", 1) + some(digits, 8), harmless() if draw.random() < 0.5 else plain(), False),
            lambda: ("978" + some(digits, 10), harmless(), False),
            lambda: (n, plain() + some(hexes, 4) + draw.choice("abcdef-_"), False),
            lambda: (some(digits, 9, 16), personal(), True),
            lambda: (luhn(draw.choice([13, 15, 16])), plain(), True),
            lambda: (luhn(draw.choice([13, 15, 16])), harmless(), False),
        ])()

    def formatted() -> tuple[str, str, bool]:
        mark = draw.choice(" .-")
        year = lambda: draw.choice(["19", "20"]) + some(digits, 2)
        of = lambda *sizes: mark.join(some(digits, n) for n in sizes)
        return draw.choice([
            lambda: (mark.join([year(), year(), year()]), plain(), False),
            lambda: (of(2, 2) + mark + (year() if draw.random() < 0.7 else some(digits, 4)), harmless() if draw.random() < 0.3 else plain(), False),
            lambda: (of(4, 4, 4), plain(), False),
            lambda: (of(*draw.choice([(3, 3, 4), (2, 4, 4), (4, 3, 4), (2, 3, 4)])), harmless(), False),
            lambda: (of(3, 3, 4), plain(), True),
            lambda: ("-".join([some(digits, 3), some(digits, 2), some(digits, 4)]), plain(), True),
            lambda: (f"({some(digits, 2, 4)}) " + of(draw.choice([3, 4]), 4), plain(), True),
            lambda: (f"+{some('123456789', 1, 2)} " + of(draw.choice([2, 3]), 3, 4), plain(), True),
            lambda: (of(*draw.choice([(3, 3, 4), (2, 4, 4), (4, 3, 4), (2, 3, 4)])), personal(), True),
        ])()

    def key() -> tuple[str, str, bool]:
        return draw.choice([
            lambda: (some(hexes, draw.choice([32, 40, 64, 128])), harmless() if draw.random() < 0.5 else plain(), False),
            lambda: (uuid(), harmless() if draw.random() < 0.5 else plain(), False),
            lambda: (words(), plain(), False),
            lambda: (draw.choice("-_=").replace("=", "_") * draw.randint(24, 80), plain(), False),
            lambda: (some(small, 8, 16), secret(), False),
            lambda: (mixed(24, 300), plain(), True),
            lambda: (some(hexes, 24, 128), secret(), True),
            lambda: (some(small, 24, 64), secret(), True),
            lambda: (mixed(8, 40), secret(), True),
            lambda: (some(small, 4, 8) + some(digits, 4, 8), secret(), True),
        ])()

    def address() -> tuple[str, str, bool]:
        at, dot = draw.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" at ", " dot "), (" at ", ".")])
        name = word() + draw.choice(["", "", some(digits, 1, 4), "." + word(), "_" + word(), "-" + word()])
        domain = word() + draw.choice(["", "", dot + word(), "-" + word()])
        ending = draw.choice(["com", "org", "net", "edu", "io", "de", "fr", "uk"])
        return draw.choice([
            lambda: (f"{name}{at}{domain}{dot}{ending}", plain(), True),
            lambda: (f"{word()} at {word()}. {word().capitalize()}", plain(), False),
            lambda: (f"{word()} at {some(digits, 1, 4)}. {word().capitalize()}", plain(), False),
        ])()

    makers = {"address": address, "key": key, "number": number, "formatted": formatted}
    rows = [(kind, *makers[kind]()) for _ in range(TAUGHT // len(makers)) for kind in makers]
    draw.shuffle(rows)  # every third row is held out
    return rows


def _taught_rows(docs: DataFrame) -> DataFrame:
    """Features and class of the generated spans, by the expressions that read documents."""
    listed = F.from_json(F.lit(json.dumps([dict(zip(("kind", "s", "before", "y"), row)) for row in taught()])), "array<struct<kind:string,s:string,before:string,y:boolean>>")
    spans = docs.sparkSession.range(1).select(F.explode(listed).alias("x")).select(F.col("x"))
    features = F.coalesce(*(F.when(F.col("x.kind") == kind, _features(kind, F.struct("x.s", F.substring("x.before", -24, 24).alias("before")))) for kind in GENERATORS))
    return spans.select(features.alias("f"), F.col("x.y").alias("y")).select(*(F.col("f")[c].alias(c) for c in FEATURES), "y")


def learn(docs: DataFrame) -> Model:
    """Learn from the proposals of at most ``TRAINING_DOCUMENTS`` documents and ``TAUGHT`` generated spans."""
    hashed = docs.select("text", F.xxhash64("doc_id", "text").alias("at")).where("text IS NOT NULL")
    chosen = hashed.groupBy("at").agg(F.lit(1).alias("one")).select("at").orderBy("at").limit(TRAINING_DOCUMENTS)
    some = hashed.join(F.broadcast(chosen), "at").groupBy("at").agg(F.first("text").alias("text"))
    base, offers = base_spans(F.col("text")), proposals(F.col("text"))
    flat = F.flatten(F.array(*(F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for a in base.values())))

    def example(kind: str, x: Column) -> Column:
        sure = F.exists("fixed", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
        f = _features(kind, x)
        return F.struct(f.alias("f"), sure.alias("sure"), x["start"].alias("start"))

    def examples_of(kind: str) -> Column:
        return F.transform(f"of_{kind}", lambda x: example(kind, x))

    def spelled(x: Column, how: str) -> Column:
        """An e-mail as it would be proposed if it were spelled out."""
        as_if = F.struct(F.regexp_replace(x["s"], _PLAIN_EMAIL, how).alias("s"), x["before"].alias("before"))
        return F.struct(_features("address", as_if).alias("f"), F.lit(True).alias("sure"), x["start"].alias("start"))

    plain = F.filter("emails", lambda x: x["s"].rlike(_PLAIN_EMAIL))
    taught = [F.transform(F.filter(plain, lambda x: x["start"] % len(_SPELLINGS) == i), lambda x: spelled(x, how)) for i, how in enumerate(_SPELLINGS)]
    listed = some.select("at", flat.alias("fixed"), base["email"].alias("emails"), *(a.alias(f"of_{kind}") for kind, a in offers.items()))
    examples = F.flatten(F.array(*(examples_of(kind) for kind in GENERATORS), *taught))
    rows = listed.select("at", F.explode(examples).alias("e")).select("at", "e.*")
    f = F.col("f")
    generator = {kind: f["generator"] == i for i, kind in enumerate(GENERATORS)}
    personal = F.col("sure") | (generator["key"] & (f["keyed"] == 1) & (f["size"] >= 24))
    wordy = (generator["key"] | generator["address"]) & (f["digits"] == 0) & (f["spelled"] == 0) & (f["keyed"] == 0)
    harmless = wordy | (generator["number"] & (f["glued"] == 1)) | ((f["harmless"] == 1) & (f["contact"] == 0) & (f["keyed"] == 0))
    told = rows.where(personal | harmless)
    sampled = told.select(F.xxhash64("at", "start").alias("order"), *(f[c].alias(c) for c in FEATURES), personal.alias("y"))
    got = sorted(tuple(r) for r in sampled.orderBy("order").limit(TRAINING_SPANS).collect())
    known = [r[1:] for r in got] + [tuple(r) for r in _taught_rows(docs).collect()]
    x = np.array([r[:-1] for r in known], float)
    return boost(x, np.array([r[-1] for r in known], bool))


def all_spans(text: Column, model: Model) -> Column:
    """A struct of arrays: the fixed formats by name and the selected proposals by generator."""
    body = F.coalesce(text, F.lit(""))
    plain = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    fixed = F.struct(*(F.transform(a, plain).alias(kind) for kind, a in base_spans(body).items()))

    def with_proposals(b: Column) -> Column:
        """Proposals are scored only where they reach beyond what is found already."""
        def selected(kind: str, offered: Column) -> Column:
            def fits(x: Column) -> Column:
                inside = F.lit(False)
                for base in KINDS:
                    inside |= F.exists(b[base], lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]))
                return ~inside & let(_features(kind, x), lambda f: model.score(f, list(GENERATORS).index(kind)) > model.thresholds[kind])

            return F.transform(F.filter(offered, fits), plain)

        used = {kind: a for kind, a in proposals(body).items() if model.thresholds.get(kind, np.inf) < np.inf}
        return F.struct(*(b[kind].alias(kind) for kind in KINDS), *(selected(kind, a).alias(kind) for kind, a in used.items()))

    return let(fixed, with_proposals)


def _written(found: Column, kinds: list[str]) -> Column:
    def of(kind: str) -> Column:
        return F.transform(found[kind], lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    return F.concat_ws(",", F.concat(*(of(kind) for kind in kinds)))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the fixed formats, and all spans."""
    model = learn(docs)
    found = docs.select("doc_id", all_spans(F.col("text"), model).alias("found"))
    kinds = found.schema["found"].dataType.names
    f = F.col("found")
    return found.select(
        "doc_id",
        *(F.size(f[k]).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_written(f, KINDS), 256).alias("base_sha256"),
        _written(f, kinds).alias("spans"),
    )


def _redacted(text: Column, found: Column, kinds: list[str]) -> Column:
    """``text`` with every span replaced by its kind; spans that overlap become one."""

    def of(kind: str) -> Column:
        return F.transform(found[kind], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind.upper()).alias("kind")))

    tagged = F.sort_array(F.concat(*(of(kind) for kind in kinds)))

    def step(acc: Column, x: Column) -> Column:
        apart = x["start"] >= acc["at"]
        skipped = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        text_so_far = F.when(apart, F.concat(acc["done"], skipped, F.lit("["), x["kind"], F.lit("]"))).otherwise(acc["done"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), text_so_far.alias("done"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    ended = F.aggregate(tagged, start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(tagged) == 0, text).otherwise(ended)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans replaced by ``[KIND]``; where there is ``n_chars``, it follows the text.  A null text stays null."""
    model = learn(docs)
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), all_spans(F.col("text"), model).alias("found"))
    kinds = marked.schema["found"].dataType.names
    done = marked.select("row", _redacted(F.col("row.text"), F.col("found"), kinds).alias("new"))
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    columns["text"] = F.col("new")
    if "n_chars" in columns:
        changed = ~F.col("new").eqNullSafe(F.col("row.text"))
        columns["n_chars"] = F.when(changed, F.length("new").cast(dict(docs.dtypes)["n_chars"])).otherwise(columns["n_chars"])
    return done.select(*(column.alias(c) for c, column in columns.items()))
