"""The catalogue's queries as DuckDB SQL, written from their definitions.

Where an operator takes a shortcut (sums of ``n log n``, pruned cells, a Gram
matrix that is never built) the SQL does not: it computes probabilities, all
distances and all products.
"""

from __future__ import annotations

from statloom.plans.catalog import EPOCHS, LINE_FEATURES, PART_TYPES, PRIORITIES, TREE_FEATURES

SPLIT = r"unnest(list_transform(list_filter(string_split_regex(text, '\W+'), lambda t: length(t) > 2), lambda t: lower(t)))"
DOCS = "docs AS (SELECT * FROM documents JOIN labels USING (doc_id))"
IS_TEST = "substr(md5('42:' || doc_id), 1, 8) < '33333333'"
VECTOR_IS_TEST = IS_TEST.replace("doc_id", "vec_id")
DRAW = "substr(md5('42:' || doc_id), 1, 15)"
LOG = "CASE WHEN {0} > 0 THEN ln({0}) ELSE CAST('-Infinity' AS DOUBLE) END"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _model(split: str, bag: bool = True, base: str = "2.0", drop_top: int = 0) -> list[str]:
    """CTEs ``counts``, ``totals`` and ``model`` from ``split(doc_id, text, label, is_test)``."""
    occurrence = "SELECT" if bag else "SELECT DISTINCT"
    kept = (
        f"WHERE word NOT IN (SELECT word FROM counts_all ORDER BY n_seen DESC, word LIMIT {drop_top})" if drop_top else ""
    )
    return [
        split,
        f"words AS ({occurrence} doc_id, label, is_test, {SPLIT} AS word FROM split)",
        """counts_all AS (SELECT word, count(*) AS n_seen,
             count(*) FILTER (WHERE NOT is_test AND label = 1) AS n1,
             count(*) FILTER (WHERE NOT is_test AND label <> 1) AS n0
           FROM words GROUP BY word)""",
        f"counts AS (SELECT * FROM counts_all {kept})",
        f"""totals AS (SELECT {base} + coalesce(sum(n1), 0) AS den1, {base} + coalesce(sum(n0), 0) AS den0 FROM counts)""",
        """prior AS (SELECT count(*) AS n_docs, count(*) FILTER (WHERE label = 1) / nullif(count(*), 0)::DOUBLE AS p1
           FROM split WHERE NOT is_test)""",
        """model AS (SELECT word, n_seen, n1, n0, ln((1 + n1) / den1) AS log_p1, ln((1 + n0) / den0) AS log_p0
           FROM counts, totals)""",
    ]


TOXIC = f"split AS (SELECT doc_id, text, toxic AS label, {IS_TEST} AS is_test FROM documents JOIN labels USING (doc_id))"
SHOW_MODEL = "SELECT word, n_seen, n1, n0, round(log_p1, 6) AS log_p1, round(log_p0, 6) AS log_p0 FROM model"


def _scores(docs: str, key: str, keep: str = "", bag: bool = True) -> list[str]:
    """CTE ``scored`` for ``docs(key, text, keep)`` under ``model`` and ``prior``."""
    occurrence = "SELECT" if bag else "SELECT DISTINCT"
    carried = f", d.{keep}" if keep else ""
    return [
        f"asked AS ({docs})",
        f"asked_words AS ({occurrence} {key}, {SPLIT} AS word FROM asked)",
        f"""sums AS (SELECT {key}, sum(log_p1) AS sum1, sum(log_p0) AS sum0
             FROM asked_words JOIN model USING (word) GROUP BY {key})""",
        f"""scored AS (SELECT d.{key}{carried},
             coalesce(sum1, 0) + {LOG.format('p1')} AS score1, coalesce(sum0, 0) + {LOG.format('(1 - p1)')} AS score0
             FROM asked d LEFT JOIN sums USING ({key}), prior)""",
        "result AS (SELECT *, CASE WHEN score1 > score0 THEN 1 ELSE 0 END AS predicted FROM scored)",
    ]


TOXIC_SCORES = [*_model(TOXIC), *_scores("SELECT doc_id, text, label FROM split WHERE is_test", "doc_id", "label")]
SHOW_SCORES = "SELECT doc_id, label, round(score1, 4) AS score1, round(score0, 4) AS score0, predicted FROM result"
REPORT = """SELECT count(*) AS n_rows, count(*) FILTER (WHERE label IS DISTINCT FROM predicted) AS errors,
  round(count(*) FILTER (WHERE label IS DISTINCT FROM predicted) / nullif(count(*), 0)::DOUBLE, 6) AS error_rate FROM result"""

FEEDS = """entries AS (SELECT doc_id, source, text, CASE source WHEN 'src0' THEN 1 ELSE 0 END AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE source IN ('src0', 'src1'))
  WHERE place <= (SELECT least(count(*) FILTER (WHERE source = 'src0'), count(*) FILTER (WHERE source = 'src1')) FROM documents))"""


def _counted(rows: str, n: int, columns: str) -> str:
    """``columns`` and ``is_test`` for ``n`` rows (at most half) in digest order."""
    return f"""SELECT {columns}, row_number() OVER (ORDER BY {DRAW}, doc_id)
      <= least({n}, (SELECT count(*) // 2 FROM {rows})) AS is_test FROM {rows}"""


LOCAL = [FEEDS, *_model(f"split AS ({_counted('entries', 20, 'doc_id, text, label')})", drop_top=30)]
SPAM = [
    "mails AS (SELECT doc_id, text, toxic AS label FROM documents JOIN labels USING (doc_id))",
    *_model(f"split AS ({_counted('mails', 10, 'doc_id, text, label')})"),
]
TEST_DOCS = "SELECT doc_id, text, label FROM split WHERE is_test"

# Nearest neighbours: all distances.
VOTES = """ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, tid) AS place FROM pairs),
best AS (SELECT * FROM ranked WHERE place <= 3),
votes AS (SELECT qid, label, count(*) AS n, min(place) AS first FROM best GROUP BY qid, label),
winner AS (SELECT qid, label AS predicted FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, first, label) AS r FROM votes) WHERE r = 1)"""
VECTORS = "v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label, " + VECTOR_IS_TEST + " AS is_test FROM embeddings)"
VECTOR_PAIRS = """pairs AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label, list_distance(q.x, t.x) AS d
  FROM v q, v t WHERE q.is_test AND NOT t.is_test)"""
LEAVE_ONE_OUT = _with(
    VECTORS,
    "pairs AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label, list_distance(q.x, t.x) AS d FROM v q, v t WHERE q.vec_id <> t.vec_id)",
    VOTES,
) + "SELECT qid, tid, label, place::INTEGER AS place, round(d, 6) AS distance FROM best"
VECTOR_RESULT = [
    VECTORS, VECTOR_PAIRS, VOTES,
    "result AS (SELECT vec_id, label, predicted FROM v LEFT JOIN winner ON qid = vec_id WHERE is_test)",
]


def _parts(fit: str) -> list[str]:
    codes = " ".join(f"WHEN '{name}' THEN {i + 1}" for i, name in enumerate(PART_TYPES))
    return [
        f"""p AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS c, CASE p_type {codes} END AS label,
             row_number() OVER (ORDER BY p_partkey) <= (SELECT floor(count(*) * 0.5) FROM part) AS is_test FROM part)""",
        f"bounds AS (SELECT min(s) AS s0, max(s) - min(s) AS sr, min(c) AS c0, max(c) - min(c) AS cr FROM p WHERE {fit})",
        "scaled AS (SELECT p_partkey, label, is_test, (s - s0) / sr AS s, (c - c0) / cr AS c FROM p, bounds)",
        """pairs AS (SELECT q.p_partkey AS qid, t.p_partkey AS tid, t.label,
             (q.s - t.s) * (q.s - t.s) + (q.c - t.c) * (q.c - t.c) AS d
             FROM scaled q, scaled t WHERE q.is_test AND NOT t.is_test)""",
        VOTES,
        "result AS (SELECT p_partkey, label, predicted FROM p LEFT JOIN winner ON qid = p_partkey WHERE is_test)",
    ]


PART_REPORT = _with(*_parts("true")) + REPORT
NAMES = "[" + ", ".join(f"'{n}'" for n in PART_TYPES) + "]"
BITS = "bits AS (SELECT vec_id, label, list_transform(embedding, lambda e: CASE WHEN e > 0 THEN 1 ELSE 0 END) AS v, " + VECTOR_IS_TEST + " AS is_test FROM embeddings)"

# Trees: probabilities and entropies level by level.
TREE_ROWS = """rows0 AS (SELECT doc_id, lang, CAST(CAST(least(floor(n_chars / 1000), 4) AS BIGINT) AS VARCHAR) AS length, source,
  CAST(toxic AS VARCHAR) AS toxic, CAST(quality AS VARCHAR) AS label, '/' AS node_id, CAST(NULL AS VARCHAR) AS parent_id,
  CAST(NULL AS VARCHAR) AS edge_feature, CAST(NULL AS VARCHAR) AS edge_value FROM documents JOIN labels USING (doc_id))"""


def _gains(level: int) -> list[str]:
    k = level
    features = ", ".join(TREE_FEATURES)
    return [
        f"""long{k} AS (SELECT node_id, label, unnest(range({len(TREE_FEATURES)})) AS idx, unnest([{features}]) AS value FROM rows{k})""",
        f"""cells{k} AS (SELECT node_id, idx, value, label, count(*) AS n FROM long{k} GROUP BY ALL)""",
        f"""shares{k} AS (SELECT *, sum(n) OVER (PARTITION BY node_id, idx, value) AS t, sum(n) OVER (PARTITION BY node_id, idx) AS total FROM cells{k})""",
        f"""values{k} AS (SELECT node_id, idx, value, any_value(t) AS t, any_value(total) AS total, -sum(n / t * log2(n / t)) AS h FROM shares{k} GROUP BY ALL)""",
        f"""conditional{k} AS (SELECT node_id, idx, sum(t / total * h) AS ch FROM values{k} GROUP BY ALL)""",
        f"""labels{k} AS (SELECT node_id, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY node_id) AS total,
             row_number() OVER (PARTITION BY node_id ORDER BY count(*) DESC, label) AS r FROM rows{k} GROUP BY node_id, label)""",
        f"""base{k} AS (SELECT node_id, CAST(any_value(total) AS BIGINT) AS n_rows, -sum(n / total * log2(n / total)) AS h,
             max(label) FILTER (WHERE r = 1) AS label, count(*) AS n_labels FROM labels{k} GROUP BY node_id)""",
        f"""gains{k} AS (SELECT node_id, idx, n_rows, h, ch, h - ch AS gain, label, n_labels,
             row_number() OVER (PARTITION BY node_id ORDER BY round(h - ch, 9) DESC, idx) AS r FROM conditional{k} JOIN base{k} USING (node_id))""",
    ]


#: No path is longer: a feature has no gain below its own split.
TREE_DEPTH = len(TREE_FEATURES)


def _tree() -> list[str]:
    names = "[" + ", ".join(f"'{f}'" for f in TREE_FEATURES) + "]"
    picked = "CASE split_feature " + " ".join(f"WHEN '{f}' THEN {f}" for f in TREE_FEATURES) + " END"
    parts = [TREE_ROWS]
    for k in range(TREE_DEPTH + 1):
        split = "round(gain, 9) > 1e-9 AND n_labels > 1" if k < TREE_DEPTH else "false"
        parts += _gains(k)
        parts.append(
            f"""nodes{k} AS (SELECT node_id, parent_id, {k} AS depth, edge_feature, edge_value,
                  CASE WHEN {split} THEN {names}[idx + 1] END AS split_feature, n_rows, label, NOT ({split}) AS is_leaf,
                  CASE WHEN {split} THEN gain END AS gain FROM gains{k}
                JOIN (SELECT DISTINCT node_id, parent_id, edge_feature, edge_value FROM rows{k}) USING (node_id) WHERE r = 1)"""
        )
        parts.append(
            f"""rows{k + 1} AS (SELECT doc_id, {', '.join(TREE_FEATURES)}, r.label, node_id || split_feature || '=' || {picked} || '/' AS node_id,
                  node_id AS parent_id, split_feature AS edge_feature, {picked} AS edge_value
                FROM rows{k} r JOIN nodes{k} USING (node_id) WHERE split_feature IS NOT NULL)"""
        )
    return parts


ALL_NODES = " UNION ALL ".join(f"SELECT * FROM nodes{k}" for k in range(TREE_DEPTH + 1))
TREE = _with(*_tree()) + f"SELECT * REPLACE (round(gain, 6) AS gain) FROM ({ALL_NODES})"
TREE_SCORES = _with(*_tree()) + " UNION ALL ".join(
    f"SELECT doc_id, r.label, n.label AS predicted FROM rows{k} r JOIN nodes{k} n USING (node_id) WHERE is_leaf"
    for k in range(TREE_DEPTH + 1)
)

# Perceptrons: one CTE per pass.
LINES = """lines AS (SELECT l_orderkey, l_linenumber,
    (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS x0,
    (l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()) AS x1,
    CASE WHEN l_extendedprice / l_quantity > 1500 THEN 1 ELSE -1 END AS y FROM lineitem)"""


def _primal() -> list[str]:
    parts = [LINES, "plane0 AS (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS b, 1::BIGINT AS misclassified)"]
    for e in range(1, EPOCHS + 1):
        wrong = "y * (x0 * w0 + x1 * w1 + b) <= 0"
        step = "(SELECT 1.0::DOUBLE / count(*) FROM lines)"
        parts.append(
            f"""plane{e} AS (SELECT any_value(w0) + {step} * coalesce(sum(y * x0) FILTER (WHERE {wrong}), 0) AS w0,
                 any_value(w1) + {step} * coalesce(sum(y * x1) FILTER (WHERE {wrong}), 0) AS w1,
                 any_value(b) + {step} * coalesce(sum(y) FILTER (WHERE {wrong}), 0) AS b,
                 count(*) FILTER (WHERE {wrong}) AS misclassified FROM lines, plane{e - 1})"""
        )
    return parts


PLANES = " UNION ALL ".join(
    f"""SELECT {e}::INTEGER AS epoch, misclassified, round(w0, 6) AS w0, round(w1, 6) AS w1, round(b, 6) AS b FROM plane{e}
        WHERE (SELECT misclassified FROM plane{e - 1}) > 0"""
    for e in range(1, EPOCHS + 1)
)
SIGNED = "signed AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS x, CASE WHEN label < 5 THEN 1 ELSE -1 END AS y FROM embeddings)"


def _dual() -> list[str]:
    """All passes of the dual from the full table of products."""
    parts = [
        SIGNED,
        "gram AS MATERIALIZED (SELECT i.row_id AS i, j.row_id AS j, j.y AS yj, list_dot_product(i.x, j.x) AS dot FROM signed i, signed j)",
        "alpha0 AS (SELECT row_id, y, 0.0::DOUBLE AS alpha FROM signed)",
    ]
    for e in range(1, EPOCHS + 1):
        parts.append(
            f"""alpha{e} AS MATERIALIZED (SELECT a.row_id, a.y, a.alpha + CASE WHEN a.y * (s.score + b.b) <= 0
                 THEN 1.0::DOUBLE / (SELECT count(*) FROM signed) ELSE 0 END AS alpha
               FROM alpha{e - 1} a JOIN (SELECT i, sum(alpha * yj * dot) AS score FROM gram JOIN alpha{e - 1} ON row_id = j GROUP BY i) s
                 ON s.i = a.row_id, (SELECT sum(alpha * y) AS b FROM alpha{e - 1}) b)"""
        )
    return parts


PRIORITY_CODES = " ".join(f"WHEN '{name}' THEN {i + 1}" for i, name in enumerate(PRIORITIES))

ORACLES: dict[str, str] = {
    "text_corpus": "SELECT item_id, CAST(item_id % 2 AS INTEGER) AS label, text FROM benchmark",
    "text_corpus_arriving": "SELECT item_id, CAST(item_id % 2 AS INTEGER) AS label, text, strlen(text) AS size FROM benchmark",
    "tokenize_counts": f"SELECT word, count(*) AS n FROM (SELECT {SPLIT} AS word FROM documents) GROUP BY word",
    "whitespace_token_counts": r"""SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\s+')) AS token
        FROM conversations) WHERE token <> '' GROUP BY token""",
    "vocabulary": f"SELECT DISTINCT {SPLIT} AS word FROM documents",
    "set_of_words": _with(DOCS, f"vocab AS (SELECT DISTINCT {SPLIT} AS word FROM docs)")
    + f"SELECT DISTINCT doc_id, word, 1::BIGINT AS n FROM (SELECT doc_id, {SPLIT} AS word FROM documents) JOIN vocab USING (word)",
    "bag_of_words": _with(DOCS, f"vocab AS (SELECT DISTINCT {SPLIT} AS word FROM docs)")
    + f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, {SPLIT} AS word FROM documents) JOIN vocab USING (word) GROUP BY doc_id, word",
    "oov_words": _with(DOCS, f"vocab AS (SELECT DISTINCT {SPLIT} AS word FROM docs)")
    + f"SELECT word, count(*) AS n FROM (SELECT {SPLIT} AS word FROM benchmark) WHERE word NOT IN (SELECT word FROM vocab) GROUP BY word",
    "top_words_30": _with(DOCS) + f"SELECT word, count(*) AS n FROM (SELECT {SPLIT} AS word FROM docs) GROUP BY word ORDER BY n DESC, word LIMIT 30",
    "vocab_without_top30": _with(DOCS, f"c AS (SELECT word, count(*) AS n FROM (SELECT {SPLIT} AS word FROM docs) GROUP BY word)")
    + "SELECT word FROM c WHERE word NOT IN (SELECT word FROM c ORDER BY n DESC, word LIMIT 30)",
    "nb_train": _with(*_model(TOXIC)) + SHOW_MODEL,
    "nb_train_merged": _with(*_model(TOXIC)) + SHOW_MODEL,
    "nb_train_set": _with(*_model(TOXIC, bag=False)) + SHOW_MODEL,
    "nb_train_vocab": _with(*_model(TOXIC, base="(SELECT count(*) FROM counts)::DOUBLE")) + SHOW_MODEL,
    "nb_prior": _with(*_model(TOXIC)) + "SELECT n_docs, round(p1, 6) AS p1, den1::DOUBLE AS den1, den0::DOUBLE AS den0 FROM prior, totals",
    "nb_score": _with(*TOXIC_SCORES) + SHOW_SCORES,
    "nb_error_rate": _with(*TOXIC_SCORES) + REPORT,
    "nb_errors": _with(*TOXIC_SCORES) + "SELECT doc_id, label, predicted FROM result WHERE label <> predicted",
    "confusion": _with(*TOXIC_SCORES) + "SELECT label, predicted, count(*) AS n FROM result GROUP BY ALL",
    "nb_save_load": _with(*TOXIC_SCORES) + SHOW_SCORES,
    "nb_entries": _with(
        *_model(TOXIC.replace(IS_TEST, "false"), bag=False), *_scores("SELECT item_id, text FROM benchmark", "item_id", bag=False)
    )
    + "SELECT item_id, round(score1, 4) AS score1, round(score0, 4) AS score0, predicted FROM result",
    "nb_counted_holdout": _with(*SPAM, *_scores(TEST_DOCS, "doc_id", "label")) + REPORT,
    "paired_feed_rows": _with(FEEDS) + "SELECT doc_id, source, label FROM entries",
    "local_words_model": _with(*LOCAL) + SHOW_MODEL,
    "local_words_error_rate": _with(*LOCAL, *_scores(TEST_DOCS, "doc_id", "label")) + REPORT,
    "local_top_words": _with(*LOCAL)
    + """SELECT 1 AS label, word, round(log_p1, 6) AS log_p FROM model WHERE log_p1 > -6.0
         UNION ALL SELECT 0, word, round(log_p0, 6) FROM model WHERE log_p0 > -6.0""",
    "nb_stream_score": _with(*_model(TOXIC), *_scores("SELECT doc_id, text FROM documents", "doc_id"))
    + "SELECT doc_id, round(score1, 4) AS score1, round(score0, 4) AS score0, predicted FROM result",
    "nb_stream_score_once": _with(*_model(TOXIC), *_scores("SELECT doc_id, text FROM documents", "doc_id"))
    + "SELECT doc_id, round(score1, 4) AS score1, round(score0, 4) AS score0, predicted FROM result",
    "minmax_stats": " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(min({c}), 6) + 0.0 AS min_value, round(max({c}), 6) + 0.0 AS max_value,
            round(max({c}) - min({c}), 6) + 0.0 AS range_value FROM lineitem"""
        for c in LINE_FEATURES
    ),
    "minmax_apply": "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"round(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 6) + 0.0 AS {c}" for c in LINE_FEATURES
    )
    + " FROM lineitem",
    "label_encode_decode": f"SELECT o_orderkey, CASE o_orderpriority {PRIORITY_CODES} END AS code, o_orderpriority AS name FROM orders",
    "holdout_random": _with("d AS (SELECT doc_id, toxic AS label FROM documents JOIN labels USING (doc_id))")
    + _counted("d", 20, "doc_id, label"),
    "holdout_fraction": f"SELECT doc_id, {IS_TEST} AS is_test FROM documents JOIN labels USING (doc_id)",
    "holdout_positional": """SELECT vec_id, label, row_number() OVER (ORDER BY vec_id)
        <= (SELECT floor(count(*) * 0.5) FROM embeddings) AS is_test FROM embeddings""",
    "union_labelled": """SELECT doc_id, source, n_chars, CASE source WHEN 'src0' THEN 1 ELSE -1 END AS y FROM documents
        WHERE source IN ('src0', 'src1')""",
    "knn_topk": LEAVE_ONE_OUT,
    "knn_topk_pruned": LEAVE_ONE_OUT,
    "knn_classify": _with(*VECTOR_RESULT) + "SELECT * FROM result",
    "knn_error_rate": _with(*VECTOR_RESULT) + REPORT,
    "knn_scaled_error_rate": PART_REPORT,
    "knn_scaled_pruned": PART_REPORT,
    "knn_new_rows": _with(*_parts("NOT is_test")) + f"SELECT p_partkey, predicted, {NAMES}[predicted] AS answer FROM result",
    "bitmap_vectors": _with(BITS) + "SELECT vec_id, unnest(range(64))::INTEGER AS position, unnest(v)::INTEGER AS bit FROM bits",
    "bitmap_lines": _with(BITS)
    + """SELECT vec_id, line::INTEGER AS line, CAST(list_sum(list_transform(range(8), lambda c: v[line * 8 + c + 1] * (2 ** (7 - c)))) AS BIGINT) AS bits
         FROM bits, range(8) AS lines(line)""",
    "vector_distance": _with(BITS.replace("SELECT vec_id, label,", "SELECT vec_id, label, embedding::DOUBLE[] AS x,"))
    + """SELECT a.vec_id, round(list_distance(a.x, b.x), 6) AS distance,
         CAST(round(list_distance(a.v::DOUBLE[], b.v::DOUBLE[]) ** 2) AS BIGINT) AS bits FROM bits a JOIN bits b ON b.vec_id = a.vec_id + 1""",
    "bitmap_error_rate": _with(
        BITS,
        """pairs AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label, list_distance(q.v::DOUBLE[], t.v::DOUBLE[]) AS d
           FROM bits q, bits t WHERE q.is_test AND NOT t.is_test)""",
        VOTES,
        "result AS (SELECT vec_id, label, predicted FROM bits LEFT JOIN winner ON qid = vec_id WHERE is_test)",
    )
    + REPORT,
    "bitmap_topk_indexed": _with(
        BITS,
        """pairs AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label, CAST(round(list_distance(q.v::DOUBLE[], t.v::DOUBLE[]) ** 2) AS BIGINT) AS bits
           FROM bits q, bits t WHERE q.is_test AND NOT t.is_test)""",
    )
    + """SELECT qid, tid, label, bits, place::INTEGER AS place
         FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bits, tid) AS place FROM pairs) WHERE place <= 3""",
    "entropy": _with(TREE_ROWS, *_gains(0)) + "SELECT n_rows, round(h, 6) + 0.0 AS entropy FROM base0",
    "info_gain": _with(TREE_ROWS, *_gains(0))
    + f"""SELECT idx::INTEGER AS idx, [{', '.join(f"'{f}'" for f in TREE_FEATURES)}][idx + 1] AS feature, n_rows,
          round(h, 6) AS base_entropy, round(ch, 6) AS conditional_entropy, round(gain, 6) AS gain FROM gains0""",
    "best_split": _with(TREE_ROWS, *_gains(0))
    + f"""SELECT [{', '.join(f"'{f}'" for f in TREE_FEATURES)}][idx + 1] AS feature, round(gain, 6) AS gain FROM gains0
          WHERE r = 1 AND round(gain, 9) > 1e-9""",
    "split_dataset": _with(TREE_ROWS) + "SELECT doc_id, length, source, toxic, label FROM rows0 WHERE lang = 'en'",
    "majority_label": """SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n,
        row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events
        GROUP BY user_id, event_type) WHERE r = 1""",
    "id3_nodes": TREE,
    "id3_classify": TREE_SCORES,
    "id3_classify_routed": TREE_SCORES,
    "id3_tree_stats": _with(*_tree()) + f"SELECT count(*) FILTER (WHERE is_leaf) AS n_leaves, max(depth) AS depth FROM ({ALL_NODES})",
    "tree_save_load": TREE,
    "delimited_tree": TREE,
    "delimited_numeric": f"""SELECT p_partkey::DOUBLE AS part_key, p_size::DOUBLE AS size, p_retailprice AS price,
        CASE p_type {' '.join(f"WHEN '{n}' THEN {i + 1}" for i, n in enumerate(PART_TYPES))} END AS label FROM part""",
    "perceptron_primal": _with(*_primal()) + PLANES,
    "perceptron_predict": _with(*_primal())
    + f"""SELECT l_orderkey, l_linenumber, round(x0 * w0 + x1 * w1 + b, 6) + 0.0 AS score, y,
          CASE WHEN x0 * w0 + x1 * w1 + b >= 0 THEN 1 ELSE -1 END AS predicted FROM lines, plane{EPOCHS}""",
    "perceptron_dual": _with(*_dual()) + f"SELECT row_id, y, round(alpha, 6) AS alpha FROM alpha{EPOCHS}",
    "dual_weights": _with(*_dual())
    + f"""SELECT 0 AS dim, round(sum(alpha * y), 6) AS w FROM alpha{EPOCHS} UNION ALL
          SELECT j::INTEGER, round(sum(alpha * s.y * x[j]), 6) FROM alpha{EPOCHS} JOIN signed s USING (row_id), range(1, 65) AS dims(j) GROUP BY j""",
    "gram_product": _with(SIGNED)
    + "SELECT i.row_id, round(sum(j.y * list_dot_product(i.x, j.x)), 6) + 0.0 AS product FROM signed i, signed j GROUP BY i.row_id",
}
