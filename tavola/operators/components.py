"""Connected components of a table of links, by repeated contraction.

Every round first replaces the links of a partition by a forest with the same components,
in its own task. Then every node hooks to the neighbour that comes last by (number of links, hash of
id and round), if that one comes after the node itself; the hooks are followed to their ends
and the ends take the place of the ends of every link. A node that hooks to nothing
has at least as many links as each of its neighbours, and these all hook; shared out
over them, such nodes are at most as many as those that hook, so every round at
least halves the nodes that have links. The order changes with the round and does not
follow ids, so chains of ascending ids are no worse than others. Hooks are followed by
doubling: in a time logarithmic in the longest chain of them.

Nothing is collected: the driver asks for the number of links and whether hooks still
move. Rounds are kept as tables of (node, end) that shrink by half and are composed
once, from the last to the first. Keys that more than `LEAST` rows hold are looked
up in a broadcast table (at most `HOT` rows); all others meet in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.session import store

#: A key with more rows is hot; of these, at most `HOT` are sent to the rows.
LEAST = 50_000
HOT = 1000
#: Links a task gathers before it replaces them by a forest.
GATHERED = 1_000_000


def hot_keys(rows: DataFrame, key: str, at_most: int | None = None) -> list:
    """The keys with most rows, of those with more than `LEAST`: at most `HOT`. `at_most` bounds the number of rows, if known."""
    if at_most is not None and at_most <= LEAST:
        return []
    times = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > LEAST)
    return [r[0] for r in times.orderBy(F.desc("n"), key).limit(HOT).collect()]


def lookup(rows: DataFrame, key: str, table: DataFrame, hot: list) -> DataFrame:
    """Inner join of `rows` with `table`, unique by `key`; the entries of the keys in `hot` are sent to the rows."""
    if not hot:
        return rows.join(table, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(table, key).unionByName(rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from nodes to one end for each component of the links u to v."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links (u, v) of a partition as a forest."""
    u = v = np.zeros(0, np.int64)
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= GATHERED:
            u, v = forest(np.concatenate([u, *(w["u"] for w in waiting)]), np.concatenate([v, *(w["v"] for w in waiting)]))
            waiting = []
    u, v = forest(np.concatenate([u, *(w["u"] for w in waiting)]), np.concatenate([v, *(w["v"] for w in waiting)]))
    yield pd.DataFrame({"u": u, "v": v})


def _hooks(edges: DataFrame, degree: DataFrame, hot: list, round_: int) -> DataFrame:
    """(u, p) for every end u of a link; p is the neighbour u hooks to, or u."""

    def place(node: str):
        return F.struct("n", F.xxhash64(node, F.lit(round_)).alias("h"), F.col(node).alias("id"))

    seen = lookup(edges, "v", degree.withColumnRenamed("u", "v"), hot)
    best = seen.groupBy("u").agg(F.max(place("v")).alias("best"))
    return best.join(degree, "u").select("u", F.greatest("best", place("u"))["id"].alias("p"))


def _hop(parent: DataFrame, size: int) -> DataFrame:
    """(u, p, q): the end p of each hook with its own end q."""
    return lookup(parent, "p", parent.select(F.col("u").alias("p"), F.col("p").alias("q")), hot_keys(parent, "p", size))


def _ends(parent: DataFrame, size: int) -> DataFrame:
    """Hooks followed to their ends; `size` bounds their number."""
    while True:
        twice = _hop(parent, size).select("u", F.col("q").alias("p"))
        parent = store(_hop(twice, size))
        if parent.where("p != q").isEmpty():
            return parent.select("u", "p")
        parent = parent.select("u", F.col("q").alias("p"))


def contract(links: DataFrame) -> list[DataFrame]:
    """One table (u, p) for each round; `links` has (u, v), distinct, without loops."""
    rounds: list[DataFrame] = []
    while True:
        links = store(links.mapInPandas(thinned, "u long, v long"), "links")
        edges = links.union(links.select("v", "u"))
        degree = store(edges.groupBy("u").agg(F.count("*").alias("n")), "degree")
        whole = degree.agg(F.sum("n")).first()[0]
        if not whole:
            return rounds
        hot = [] if whole <= LEAST else [r[0] for r in degree.where(F.col("n") > LEAST).orderBy(F.desc("n"), "u").limit(HOT).collect()]
        parent = _ends(store(_hooks(edges, degree, hot, len(rounds)), "hooks"), whole)
        rounds.append(parent)
        for end in "uv":
            to = parent.select(F.col("u").alias(end), F.col("p").alias(f"p{end}"))
            links = lookup(links, end, to, hot).drop(end)
        links = links.where("pu != pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node. Nodes are longs.

    Links may be repeated, in either direction, or join a node to itself; null ends are
    no links. An empty table gives an empty result.
    """
    one = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    one = store(one.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    nodes = one.select("u").union(one.select("v")).distinct()
    found = None
    for parent in reversed(contract(one.where("u != v"))):
        if found is not None:
            known = parent.select("p").distinct().join(found.withColumnRenamed("u", "p"), "p", "left")
            above = known.select("p", F.coalesce("end", "p").alias("end"))
            parent = lookup(parent, "p", above, hot_keys(parent, "p")).select("u", "end")
        found = store(parent.toDF("u", "end"), "ends")
    if found is None:
        return nodes.select(F.col("u").alias("node"), F.col("u").alias("component"))
    least = found.groupBy("end").agg(F.min("u").alias("component"))
    named = lookup(found, "end", least, hot_keys(found, "end"))
    return store(nodes.join(named, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component")), "components")
