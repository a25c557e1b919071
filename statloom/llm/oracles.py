"""DuckDB SQL for the queries of this subpackage whose results SQL can state."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: Smallest id reachable by ``links (a, b)`` from each of ``nodes (node)``.
_REACHED = """
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reached AS (
        SELECT node, node AS other FROM nodes
        UNION
        SELECT r.node, l.b FROM reached r JOIN both_ways l ON l.a = r.other
    ),
    component AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node)
"""

SUBSTRINGS = rf"""
    WITH docs AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
    ),
    starts AS (
        SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM docs WHERE len(words) >= 35
    ),
    windows AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS passage FROM starts),
    repeated AS (SELECT passage FROM windows GROUP BY passage HAVING count(*) > 1),
    covered AS (
        SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS at FROM windows JOIN repeated USING (passage)
    ),
    each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM docs),
    told AS (
        SELECT each.doc_id, count(*) AS n_words, count(covered.at) AS n_removed,
            coalesce(string_agg(word, ' ' ORDER BY each.at) FILTER (covered.at IS NULL), '') AS kept
        FROM each LEFT JOIN covered ON covered.doc_id = each.doc_id AND covered.at = each.at GROUP BY each.doc_id
    )
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM docs LEFT JOIN told USING (doc_id)
"""

EMBEDDINGS = f"""
    WITH RECURSIVE vectors AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
        WHERE embedding IS NOT NULL AND label IS NOT NULL
            AND len([v FOR v IN embedding IF v IS NULL OR NOT isfinite(v)]) = 0
            AND len([v FOR v IN embedding IF v <> 0]) > 0
    ),
    links AS (
        SELECT p.vec_id AS a, q.vec_id AS b FROM vectors p JOIN vectors q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.x) = len(q.x)
        WHERE list_cosine_similarity(p.x, q.x) >= 0.98
    ),
    nodes AS (SELECT vec_id AS node FROM embeddings),
    {_REACHED},
    degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
    SELECT node AS vec_id, coalesce(n, 0) AS n_links, component_id, node = component_id AS kept
    FROM component LEFT JOIN degree ON a = node
"""

NEAR_DUPLICATES = rf"""
    WITH RECURSIVE docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words
        FROM documents
    ),
    shingles AS (
        SELECT DISTINCT doc_id, unnest([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, greatest(len(words) - 3, 2))]) AS shingle
        FROM docs WHERE len(words) > 0
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
        SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM shingles p JOIN shingles q ON p.shingle = q.shingle AND p.doc_id < q.doc_id
        GROUP BY p.doc_id, q.doc_id
    ),
    links AS (
        SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
        WHERE 100 * common.n >= 75 * (s.n + t.n - common.n)
    ),
    nodes AS (SELECT doc_id AS node FROM documents),
    {_REACHED}
    SELECT node AS doc_id, coalesce(n, 0) AS n_shingles, component_id, node = component_id AS kept
    FROM component LEFT JOIN sizes ON doc_id = node
"""

#: CRC-32 of a word's UTF-8 bytes, bit by bit.
_CRC = """
    xor(list_reduce(
        list_prepend(4294967295, [('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT FOR i IN range(1, strlen(word) + 1)]),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))
    ), 4294967295)
"""
_FEATURE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lowered(table: str) -> str:
    return f"""
        regexp_extract_all(translate(coalesce({table}.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_FEATURE}')
    """


IMPORTANCE = f"""
    WITH docs AS (SELECT doc_id, {_lowered('documents')} AS words FROM documents),
    items AS (SELECT {_lowered('benchmark')} AS words FROM benchmark),
    corpus_words AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM docs) GROUP BY word),
    target_words AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM items) GROUP BY word),
    bucketed AS (
        SELECT word, {_CRC} % 10000 AS bucket FROM (SELECT word FROM corpus_words UNION SELECT word FROM target_words)
    ),
    seen AS (SELECT bucket, sum(n) AS s FROM corpus_words JOIN bucketed USING (word) GROUP BY bucket),
    wanted AS (SELECT bucket, sum(n) AS t FROM target_words JOIN bucketed USING (word) GROUP BY bucket),
    totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM corpus_words)::DOUBLE AS all_s, (SELECT coalesce(sum(n), 0) FROM target_words)::DOUBLE AS all_t),
    gains AS (
        SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000) / ((s::DOUBLE + 1) * (all_t + 10000)))) AS gain
        FROM seen LEFT JOIN wanted USING (bucket), totals
    ),
    sums AS (
        SELECT doc_id, floor(sum(gain) / count(*)) AS weight
        FROM (SELECT doc_id, unnest(words) AS word FROM docs) JOIN bucketed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
    ),
    scored AS (
        SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
            coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
        FROM docs LEFT JOIN sums USING (doc_id)
    ),
    places AS (
        SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20
    ),
    quota AS (SELECT 10 * count(*) // 100 AS most FROM places)
    SELECT doc_id, n_features AS n_words, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank
    FROM scored LEFT JOIN places USING (doc_id), quota
"""

FILTER_AUDIT = rf"""
    WITH docs AS (
        SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS whole, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
            coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    ),
    firsts AS (SELECT whole, min(doc_id) AS first FROM docs GROUP BY whole),
    fails AS (
        SELECT part, good, bad,
            (len(words) < 100)::INT + 2 * (100 * list_unique(words) < 80 * len(words))::INT
            + 4 * (100 * len(regexp_replace(whole, '[^A-Z]', '', 'g')) > 10 * len(whole))::INT
            + 8 * regexp_matches(whole, '[#$%&*|]')::INT + 16 * (doc_id > first)::INT AS mask
        FROM docs JOIN firsts USING (whole)
    ),
    cells AS (
        SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM fails GROUP BY part, mask
    ),
    letters AS (SELECT unnest([0, 1, 2, 3, 4]) AS f),
    orders AS (
        SELECT [a.f, b.f, c.f, d.f, e.f] AS o
        FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
            JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)
    ),
    steps AS (
        SELECT array_to_string([substr('ABCDE', f + 1, 1) FOR f IN o], '') AS filter_order, step, 1 << o[step] AS bit,
            list_sum(list_prepend(0, [1 << f FOR f IN o[1:step - 1]]))::INT AS before
        FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
    ),
    counted AS (
        SELECT part, filter_order, step, bit,
            coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
            coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
            coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
            coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
            coalesce(sum(bad) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
        FROM cells, steps GROUP BY part, filter_order, step, bit
    )
    SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""
