"""Multiway decision tree (ID3) grown level by level, and its scoring.

A tree is a table of nodes; ``node_id`` is the path of ``feature=value/`` steps
from the root ``/``.  One level of all open nodes is one set of aggregations.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import sql
from statloom.operators.impurity import MIN_GAIN, split_scores
from statloom.operators.lookup import BROADCAST_BYTES, lookup_join
from statloom.storage import materialize

# Step text of a missing value; "%" itself is escaped, so no value reads like it.
MISSING = "%00"
# A larger tree up to this size is walked inside the row, if no node has more edges than that: maps are searched one by one.
WALKED_BYTES = 16 << 20
WALKED_EDGES = 1024
NODE_BYTES = 128
COMPILED_NODES = 400
DRIVER_NODES = 4096


def _escaped(text: str) -> str:
    return f"replace(replace(replace({text}, '%', '%25'), '/', '%2F'), '=', '%3D')"


def _unescaped(text: str) -> str:
    return f"replace(replace(replace({text}, '%3D', '='), '%2F', '/'), '%25', '%')"


def _child_id(columns: dict[str, str], node: str, split: str) -> Column:
    """Path of the child a row goes to, from its node's path and split feature.

    ``columns`` tells which column holds a feature.
    """
    picked = " ".join(f"WHEN {sql.text(f)} THEN CAST({sql.name(c)} AS STRING)" for f, c in columns.items())
    value = f"coalesce({_escaped(f'CASE {split} {picked} END')}, '{MISSING}')"
    return F.expr(f"concat({node}, {_escaped(split)}, '=', {value}, '/')")


def _level_nodes(
    rows: DataFrame, columns: dict[str, str], depth: int, max_depth: int | None, min_rows: int
) -> DataFrame:
    """Node rows of one level, with ``m`` input rows and ``n_children``."""
    # The highest gain, rounded so that equal gains tie, then the first feature.
    top = (
        "array_max(transform(gains, g -> struct(round(g.gain, 9) AS rounded, -g.idx AS minus_idx, "
        "g.gain AS gain, g.n_values AS n_values)))"
    )
    scores = split_scores(rows, list(columns.values())).withColumn("top", F.expr(top))
    if max_depth is not None and depth >= max_depth:
        split = "false"
    else:
        split = f"(top.rounded > {MIN_GAIN}D AND n_labels > 1 AND n_rows >= {min_rows})"
    names = f"array({', '.join(sql.text(f) for f in columns)})"
    edge = "regexp_extract(node_id, '([^/]+)/$', 1)"
    value = f"substring_index({edge}, '=', -1)"
    has_edge = "true" if depth else "false"
    return scores.selectExpr(
        "node_id",
        f"CASE WHEN {has_edge} THEN regexp_extract(node_id, '(?s)^(.*/)[^/]+/$', 1) END AS parent_id",
        f"{depth} AS depth",
        f"CASE WHEN {has_edge} THEN {_unescaped(f'substring_index({edge}, {sql.text("=")}, 1)')} END AS edge_feature",
        f"CASE WHEN {has_edge} AND {value} <> '{MISSING}' THEN {_unescaped(value)} END AS edge_value",
        f"CASE WHEN {split} THEN get({names}, -top.minus_idx) END AS split_feature",
        "n_rows",
        "label",
        f"NOT {split} AS is_leaf",
        f"CASE WHEN {split} THEN top.gain END AS gain",
        "m",
        f"CASE WHEN {split} THEN top.n_values ELSE 0L END AS n_children",
    )


def train(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    max_depth: int | None = None,
    min_rows: int = 1,
    driver_nodes: int | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Grow a tree and return its node table (NODE_SCHEMA).

    Only counts of equal rows matter, so these are taken once and every level
    works on that smaller table.  Pure nodes, nodes without gain and nodes at
    ``max_depth`` or below ``min_rows`` become leaves with the majority label.
    A feature used above has a single value below, hence no gain.

    A level tells how many nodes the next one has.  Up to ``driver_nodes``
    (DRIVER_NODES) they are held as a literal table; beyond that every level is
    a stored table.
    """
    driver_nodes = DRIVER_NODES if driver_nodes is None else driver_nodes
    columns = {f: f"_f{i}" for i, f in enumerate(features)}
    texts = [F.col(sql.name(f)).cast("string").alias(c) for f, c in columns.items()]
    cells = df.select(*texts, F.col(sql.name(label)).cast("string").alias("label"))
    cells = cells.groupBy(*columns.values(), "label").agg(F.count("*").alias("n"))
    rows = materialize(cells, "tree-cells").withColumn("node_id", F.lit("/"))
    levels: list[DataFrame] = []
    depth, n_nodes = 0, 1
    while True:
        level = _level_nodes(rows, columns, depth, max_depth, min_rows)
        if n_nodes <= driver_nodes:
            level, found = _as_literals(level)
            n_nodes = sum(node["n_children"] for node in found)
        else:
            level, found = materialize(level, f"tree-level{depth}"), None
            n_nodes = level.agg(F.sum("n_children")).first()[0]
        levels.append(level.drop("m", "n_children"))
        if not n_nodes:
            return reduce(DataFrame.unionByName, levels)
        rows = _at_split(rows, level, found, broadcast_bytes)
        rows = rows.withColumn("node_id", _child_id(columns, "node_id", "split_feature")).drop("split_feature")
        depth += 1
        if depth > 1:  # each level starts from a table, not from all joins above it
            rows = materialize(rows, f"tree-rows{depth}")


def _as_literals(level: DataFrame) -> tuple[DataFrame, list[dict]]:
    """A level known to be short, as a table of literals and as rows."""
    found = level.toArrow()
    return level.sparkSession.createDataFrame(found, level.schema), found.to_pylist()


def _at_split(rows: DataFrame, level: DataFrame, found: list[dict] | None, broadcast_bytes: int | None) -> DataFrame:
    """Rows of the nodes that split, with the node's ``split_feature``."""
    if found is not None and len(found) == 1:
        return rows.withColumn("split_feature", F.lit(found[0]["split_feature"]))
    splits = level.where(~F.col("is_leaf")).select("node_id", "split_feature", "m")
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    if found is not None and sum(4 * len(node["node_id"]) + 128 for node in found) <= limit:
        return rows.join(F.broadcast(splits.drop("m")), "node_id")
    return lookup_join(rows, splits, "node_id", "m", broadcast_bytes=broadcast_bytes).drop("m")


def leaves_and_depth(nodes: DataFrame) -> DataFrame:
    """Number of leaves and of decision levels."""
    return nodes.agg(F.count_if("is_leaf").alias("n_leaves"), F.max("depth").alias("depth"))


def compile_tree(nodes: Sequence, on_unseen: str = "null") -> Column:
    """A nested CASE expression for a short list of node rows."""
    children: dict[str, list] = {}
    for node in nodes:
        children.setdefault(node["parent_id"], []).append(node)

    def build(node) -> Column:
        if node["is_leaf"]:
            return F.lit(node["label"])
        here = F.col(sql.name(node["split_feature"])).cast("string")
        result = F
        for child in sorted(children[node["node_id"]], key=lambda c: (c["edge_value"] is None, c["edge_value"])):
            meets = here.isNull() if child["edge_value"] is None else here == F.lit(child["edge_value"])
            result = result.when(meets, build(child))
        unseen = node["label"] if on_unseen == "majority" else None
        return result.otherwise(F.lit(unseen))

    return build(children[None][0])


def _walked(nodes: DataFrame, features: Sequence[str], depth: int) -> Column | None:
    """The node that each row reaches, as a struct ``(label, leaf)``, or None where a node has too many edges for a map.

    The nodes are one constant array, each with the place of its feature and a
    map from edge values to places of nodes; one ``aggregate`` takes a row down
    the levels.  A row without an edge for its value stays where it is.
    """
    found = nodes.orderBy("depth", "node_id").collect()
    places = {node["node_id"]: i for i, node in enumerate(found)}
    told = [{"split": None if n["is_leaf"] else features.index(n["split_feature"]), "label": n["label"], "leaf": n["is_leaf"], "edges": {}} for n in found]
    for node in found:
        if node["parent_id"] is not None:
            above = told[places[node["parent_id"]]]
            if node["edge_value"] is None:
                above["missing"] = places[node["node_id"]]
            else:
                above["edges"][node["edge_value"]] = places[node["node_id"]]
    if max(len(n["edges"]) for n in told) > WALKED_EDGES:
        return None
    schema = "array<struct<split: int, label: string, leaf: boolean, missing: int, edges: map<string, int>>>"
    table = F.from_json(F.lit(json.dumps(told)), schema)
    values = F.array(*[F.col(sql.name(f)).cast("string") for f in features])

    def step(at: Column, _: Column) -> Column:
        node = F.get(table, at)
        value = F.get(values, node["split"])
        below = F.when(value.isNull(), node["missing"]).otherwise(F.try_element_at(node["edges"], value))
        return F.when(node["split"].isNull(), at).otherwise(F.coalesce(below, at))

    reached = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) if depth else F.lit(0)
    return F.transform(F.array(reached), lambda at: F.get(table, at))[0]


def classify(
    df: DataFrame,
    nodes: DataFrame,
    features: Sequence[str],
    on_unseen: str = "null",
    compiled_nodes: int | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Add ``predicted``: the label of the leaf each row reaches.

    A small tree becomes one column expression.  A larger one is walked inside
    the row, as a constant array of nodes with maps of edges.  One beyond
    ``broadcast_bytes`` routes the rows down a level at a time by joining their
    next path step with the nodes.
    ``on_unseen='majority'`` answers an unknown value with its node's majority.
    """
    if on_unseen not in ("null", "majority"):
        raise ValueError(f"unknown on_unseen: {on_unseen}")
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("edge_value", "label")]
    size, depth, text_bytes = nodes.agg(F.count("*"), F.max("depth"), F.sum((texts[0] + texts[1]).cast("bigint"))).first()
    if size <= (COMPILED_NODES if compiled_nodes is None else compiled_nodes):
        return df.withColumn("predicted", compile_tree(nodes.collect(), on_unseen))
    if size * NODE_BYTES + text_bytes <= min(WALKED_BYTES, BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        node = _walked(nodes, list(features), depth)
        if node is not None:
            label = lambda n: n["label"] if on_unseen == "majority" else F.when(n["leaf"], n["label"])
            return df.withColumn("predicted", F.transform(F.array(node), label)[0])
    root = nodes.where("depth = 0").first()
    rows = df.withColumns(
        {
            "_node": F.lit("/"),
            "_split": F.lit(root["split_feature"]),
            "_label": F.lit(root["label"]),
            "_leaf": F.lit(root["is_leaf"]),
        }
    )
    columns = {f: f for f in features}
    own = [F.col(sql.name(c)) for c in df.columns]
    for level in range(1, depth + 1):
        edges = nodes.where(F.col("depth") == level).select(
            F.col("node_id").alias("_step"),
            F.col("split_feature").alias("_next_split"),
            F.col("label").alias("_next_label"),
            F.col("is_leaf").alias("_next_leaf"),
            F.col("n_rows").alias("_n_rows"),
        )
        # A finished row looks for a step that no node has, spread by its content.
        done = F.concat(F.lit("done:"), F.xxhash64(*own).cast("string"))
        is_open = F.col("_split").isNotNull()
        rows = rows.withColumn("_step", F.when(is_open, _child_id(columns, "_node", "_split")).otherwise(done))
        rows = lookup_join(rows, edges, "_step", "_n_rows", "left", broadcast_bytes)
        moved = F.col("_next_leaf").isNotNull()
        rows = rows.select(
            *own,
            F.when(moved, F.col("_step")).otherwise(F.col("_node")).alias("_node"),
            F.when(moved, F.col("_next_split")).alias("_split"),
            F.when(moved, F.col("_next_label")).otherwise(F.col("_label")).alias("_label"),
            F.when(moved, F.col("_next_leaf")).otherwise(F.col("_leaf")).alias("_leaf"),
        )
    answer = F.col("_label") if on_unseen == "majority" else F.when(F.col("_leaf"), F.col("_label"))
    return rows.select(*own, answer.alias("predicted"))
