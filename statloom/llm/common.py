"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.storage import materialize

#: ASCII white space; everything else belongs to words.
BLANKS = "\\x20\\x09-\\x0D"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it per array element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), lambda w: w != "")


def kept_by_worker(key: object, make: Callable[[], object]) -> object:
    """One object for each Python worker process, kept from task to task."""
    store = sys.__dict__.setdefault("_statloom_kept", {})
    if key not in store:
        store[key] = make()
    return store[key]


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, component)`` for every node with an edge: the smallest node reachable by ``edges (a, b)``.

    Every round, each node takes the smallest of its neighbours' components and
    then the component of that component, until nothing changes.  Each round is
    a written table, so lineage stays short and lost executors cost one round.
    Rounds grow about with the logarithm of the longest chain.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        f"{name}-edges",
    )
    state = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")), f"{name}-round")
    while True:
        # The smallest component around each node, also told to the component it had before.
        around = both.join(state.select(F.col("a").alias("b"), F.col("component").alias("near")), "b")
        seen = around.select("a", "near").union(state.select("a", F.col("component").alias("near")))
        nearest = seen.groupBy("a").agg(F.min("near").alias("near"))
        hooks = (
            nearest.join(state, "a")
            .where("near < component")
            .groupBy(F.col("component").alias("a"))
            .agg(F.min("near").alias("hook"))
        )
        hooks = materialize(hooks, f"{name}-hooks")
        if hooks.isEmpty():
            return state.select(F.col("a").alias("node"), "component")
        # Components hook onto smaller ones; follow the hooks until they end.
        while True:
            onward = hooks.select(F.col("a").alias("hook"), F.col("hook").alias("next"))
            longer = hooks.join(onward, "hook", "left")
            moved = materialize(longer.select("a", F.coalesce("next", "hook").alias("hook"), F.col("next").isNotNull().alias("moved")), f"{name}-hooks")
            hooks = moved.select("a", "hook")
            if moved.where("moved").isEmpty():
                break
        tops = hooks.select(F.col("a").alias("component"), "hook")
        state = materialize(
            state.join(tops, "component", "left").select("a", F.coalesce("hook", "component").alias("component")),
            f"{name}-round",
        )
