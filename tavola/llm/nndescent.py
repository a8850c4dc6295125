"""Approximate nearest neighbours by inner product: a graph from NN-descent, searched greedily.

Equal vectors are one node. Every node keeps its `NEIGHBOURS` best neighbours so far.

* Start: on each of `TREES` random sets of directions, nodes are sorted by the signs of their
  projections and the last projection, and cut into runs of `LEAF`; a run's nodes are compared with each other.
* Rounds: a node's neighbours and the best nodes that have it as a neighbour meet at the node. Pairs of which
  one is new there are compared, since neighbours of neighbours are likely neighbours, and every one offers
  its best finds to the other. Rounds end when few lists change.
* Search: a query starts at its own node and keeps the best nodes seen, `BEAM` or, in a
  large table, `BEAM_GROWTH` times the square root of the nodes. In each
  round its best nodes not looked at yet are expanded, `EXPAND` at a time, by a join with the
  graph, until all of the beam have been. The best `RERANK` are scored in double precision on the original vectors.

The graph is a table with one row per edge and is joined by node; rows carry vectors as 8-bit
numbers with a scale, which only rank candidates. Lists of reverse neighbours are cut at the best `REVERSE` before
the shuffle, so a node that is near to very many is no hot key: the rest reach it over their own lists.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, rows with
null vec_id, and vectors of another length than most take no part; with fewer candidates than
asked for, all are returned; ties go to the smaller vec_id; rows with the query's vec_id are its own;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavola.llm.projections import is_usable
from tavola.session import cut

NEIGHBOURS = 20
REVERSE = 20
TREES = 4
LEAF = 128
#: Share of changed list entries below which the rounds end.
SETTLED = 0.02
#: Offers that one meeting makes to a node.
OFFERS = 4
BEAM = 240
BEAM_GROWTH = 2
EXPAND = 200
RERANK = 3
#: Rows of a sorted run that one task should hold.
ROWS_PER_TASK = 4096


def packed(vectors: pd.Series) -> tuple[list[bytes], np.ndarray]:
    """Vectors as 8-bit numbers and the scale of each."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    scale = np.abs(x).max(1) / 127
    return [r.tobytes() for r in np.rint(x / scale[:, None]).astype(np.int8)], scale.astype(np.float32)


def unpacked(q: pd.Series, s: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(q), np.int8).reshape(len(q), -1).astype(np.float32)
    return x * s.to_numpy(np.float32)[:, None]


def best_pairs(ids: np.ndarray, x: np.ndarray, fresh: np.ndarray, floor: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(from, to, similarity): the best `most` partners above its floor for each of a group, old pairs aside."""
    sim = x @ x.T
    sim[~(fresh[:, None] | fresh[None, :])] = -np.inf
    sim[ids[:, None] == ids[None, :]] = -np.inf
    most = min(most, len(ids))
    top = np.argpartition(-sim, most - 1, axis=1)[:, :most]
    value = np.take_along_axis(sim, top, 1)
    row, col = np.nonzero(value > floor[:, None])
    return ids[row], ids[top[row, col]], value[row, col]


def groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole runs of equal keys from batches sorted by the key."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if rest is not None and len(rest):
            batch = pd.concat([rest, batch], ignore_index=True)
        keys = batch[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(cuts):
            yield batch.iloc[: cuts[-1]]
            batch = batch.iloc[cuts[-1] :]
        rest = batch
    if rest is not None and len(rest):
        yield rest


def top(edges: DataFrame, by: str, other: str, most: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("sim"), other)
    return edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def placing(turn: np.ndarray):
    """Column of the signs of all projections but the last, as one number, and the last projection."""

    @F.pandas_udf("code long, at float")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        bits = turn.shape[1] - 1
        for q, s in batches:
            p = unpacked(q, s).reshape(len(q), -1) @ turn if len(q) else np.zeros((0, bits + 1), np.float32)
            code = (p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(p), np.int64)
            yield pd.DataFrame({"code": code, "at": p[:, -1]})

    return place.asNondeterministic()


def compare_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b, sim) from runs of `LEAF` neighbouring rows; the last run of a batch reaches back to be full."""
    for batch in batches:
        for start in range(0, len(batch), LEAF):
            start = max(0, min(start, len(batch) - LEAF))
            run = batch.iloc[start : start + LEAF]
            n = len(run)
            x = unpacked(run["q"], run["s"])
            a, b, sim = best_pairs(run["node"].to_numpy(), x, np.ones(n, bool), np.full(n, -np.inf), NEIGHBOURS)
            yield pd.DataFrame({"a": a, "b": b, "sim": sim})


def first_edges(nodes: DataFrame, length: int, count: int, seed: int) -> DataFrame:
    """(a, b, sim) from runs of nodes sorted by signs and one projection, for each tree."""
    bits = max(0, int(np.ceil(np.log2(max(1, count) / LEAF))))
    parts = max(1, count // ROWS_PER_TASK)
    found = None
    for tree in range(TREES):
        turn = np.random.default_rng([seed, tree]).standard_normal((length, bits + 1)).astype(np.float32)
        placed = nodes.withColumn("_p", placing(turn)("q", "s")).select("node", "q", "s", "_p.*")
        ordered = placed.repartitionByRange(parts, "code", "at", "node").sortWithinPartitions("code", "at", "node")
        edges = ordered.select("node", "q", "s").mapInPandas(compare_runs, "a long, b long, sim float")
        found = edges if found is None else found.union(edges)
    return found


def meet(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Offers (a, b, sim) from all meetings: at each node, its neighbours and its best reverse neighbours."""
    back = top(edges.select(F.col("b").alias("u"), F.col("a").alias("m"), "sim", "fresh"), "u", "m", REVERSE)
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("m"), "fresh").union(back.select("u", "m", "fresh"))
    both = both.groupBy("u", "m").agg(F.max("fresh").alias("fresh"))
    floors = edges.groupBy("a").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("sim")).otherwise(float("-inf")).cast("float").alias("floor"))
    members = nodes.join(floors, nodes["node"] == floors["a"], "left").select(
        F.col("node").alias("m"), "q", "s", F.coalesce("floor", F.lit(float("-inf")).cast("float")).alias("floor")
    )
    rows = both.join(members, "m")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in groups(batches, "u"):
            key = whole["u"].to_numpy()
            ids, fresh, floor = whole["m"].to_numpy(), whole["fresh"].to_numpy(bool), whole["floor"].to_numpy(np.float32)
            x = unpacked(whole["q"], whole["s"])
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            out = [
                best_pairs(ids[i:j], x[i:j], fresh[i:j], floor[i:j], OFFERS)
                for i, j in zip(cuts, cuts[1:])
                if j - i > 1 and fresh[i:j].any()
            ]
            if out:
                a, b, sim = (np.concatenate(c) for c in zip(*out))
                yield pd.DataFrame({"a": a, "b": b, "sim": sim})

    return rows.repartition("u").sortWithinPartitions("u").mapInPandas(compare, "a long, b long, sim float")


def build(nodes: DataFrame, length: int, count: int, seed: int) -> DataFrame:
    """The graph: (a, b, sim), at most `NEIGHBOURS` rows for each node."""
    start = first_edges(nodes, length, count, seed).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    edges = cut(top(start, "a", "b", NEIGHBOURS).withColumn("fresh", F.lit(True)))
    while True:
        offers = meet(edges, nodes).withColumn("fresh", F.lit(True))
        merged = edges.withColumn("fresh", F.lit(False)).unionByName(offers).groupBy("a", "b").agg(
            F.max("sim").alias("sim"), F.min("fresh").alias("fresh")
        )
        edges = cut(top(merged, "a", "b", NEIGHBOURS))
        changed = edges.where("fresh").count()
        if changed <= SETTLED * count * NEIGHBOURS:
            return edges.drop("fresh")


FOUND = T.ArrayType(T.StructType().add("query", T.LongType()).add("node", T.LongType()).add("sim", T.FloatType()))


@F.arrow_udf(FOUND)
def nearer(asking: pa.Array, near: pa.Array) -> pa.Array:
    """For each node expanded: of its neighbours those above the floor of each query that expands it, by one product of matrices."""
    if not len(asking):
        return pa.array([], pa.list_(pa.struct({"query": pa.int64(), "node": pa.int64(), "sim": pa.float32()})))
    rows, last = asking.flatten(), near.flatten()
    query, floor, qs = (rows.field(c).to_numpy() for c in ("query", "floor", "qs"))
    node, scale = (last.field(c).to_numpy() for c in ("m", "s"))
    ends = [np.append(0, np.cumsum(pc.list_value_length(c).to_numpy())) for c in (asking, near)]
    vectors = [np.frombuffer(b"".join(c.to_pylist()), np.int8).reshape(len(c), -1) for c in (rows.field("qq"), last.field("q"))]
    found, sizes = [], [0]
    for (i, j), (k, l) in zip(zip(ends[0], ends[0][1:]), zip(ends[1], ends[1][1:])):
        x = vectors[0][i:j].astype(np.float32) * qs[i:j, None]
        y = vectors[1][k:l].astype(np.float32) * scale[k:l, None]
        sim = x @ y.T
        row, column = np.nonzero(sim > floor[i:j, None])
        found.append((query[i + row], node[k + column], sim[row, column]))
        sizes.append(len(row))
    made = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query", "node", "sim"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), made)


def search(queries: DataFrame, edges: DataFrame, nodes: DataFrame, beam_size: int = BEAM) -> DataFrame:
    """(query, node, sim) of the beam of each query, by greedy rounds from its own node.

    The graph is cached for the rounds, one row for a node and its neighbours. A round sends the nodes to expand to it, one row for a
    node and the queries that expand it, scores their neighbours there, and brings those better than the beam's last back to the query.
    """
    back = top(edges.select(F.col("b").alias("u"), F.col("a").alias("m"), "sim"), "u", "m", REVERSE)
    links = edges.select(F.col("a").alias("u"), F.col("b").alias("m")).union(back.select("u", "m")).distinct()
    linked = links.join(nodes.withColumnRenamed("node", "m"), "m")
    graph = linked.groupBy("u").agg(F.collect_list(F.struct("m", "q", "s")).alias("near")).persist(StorageLevel.MEMORY_AND_DISK)
    asked = queries.join(nodes, "node").select("query", F.col("q").alias("qq"), F.col("s").alias("qs"))
    beam = cut(queries.select("query", "node", F.lit(float("inf")).cast("float").alias("sim"), F.lit(False).alias("seen")))
    whole = Window.partitionBy("query")
    order = whole.orderBy("seen", F.desc("sim"), "node")
    while not beam.where("not seen").isEmpty():
        marked = beam.withColumns(
            {
                "now": ~F.col("seen") & (F.row_number().over(order) <= EXPAND),
                "floor": F.when(F.count("*").over(whole) >= beam_size, F.min("sim").over(whole)).otherwise(float("-inf")),
            }
        )
        front = marked.where("now").select("query", F.col("node").alias("u"), "floor").join(asked, "query")
        asking = front.groupBy("u").agg(F.collect_list(F.struct("query", "floor", "qq", "qs")).alias("asking"))
        near = asking.join(graph, "u").select(F.inline(nearer("asking", "near"))).withColumn("seen", F.lit(False))
        looked = marked.select("query", "node", "sim", (F.col("seen") | F.col("now")).alias("seen"))
        merged = looked.union(near).repartition("query").groupBy("query", "node").agg(F.max("sim").alias("sim"), F.max("seen").alias("seen"))
        beam = cut(top(merged, "query", "node", beam_size))
    graph.unpersist()
    return beam.where("sim < double('inf')").select("query", "node", "sim")


def nearest(
    df: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 1
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row whose id is divisible by `every`."""
    rows = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & is_usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    length = lengths[0]["n"] if lengths else 0

    @F.pandas_udf("q binary, s float")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            if len(vectors):
                q, s = packed(vectors)
                yield pd.DataFrame({"q": q, "s": s})
            else:
                yield pd.DataFrame({"q": [], "s": []})

    rows = rows.where(F.size("v") == length)
    kinds = cut(rows.groupBy("v").agg(F.min("id").alias("node")))
    nodes = cut(kinds.withColumn("_p", pack.asNondeterministic()("v")).select("node", "_p.q", "_p.s"))
    count = nodes.count()
    edges = build(nodes, length, count, seed)
    members = rows.join(kinds, "v").select("id", "node")
    asked = members.where(F.col("id") % every == 0).select(F.col("id").alias("query"), "node").distinct()
    found = search(asked, edges, nodes, max(BEAM, round(BEAM_GROWTH * count**0.5)))
    found = top(found, "query", "node", RERANK * k)
    found = found.select("query", "node").union(asked)  # copies of the query itself are near as well
    one = asked.join(kinds, "node").select("query", F.col("v").alias("qv"))
    scored = found.join(kinds, "node").join(one, "query")
    product = F.aggregate(
        F.zip_with("v", "qv", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x
    )
    scored = scored.select("query", "node", product.alias("sim"))
    # Of equal vectors only the smallest k + 1 ids can be among the k nearest other rows.
    few = top(members.distinct().withColumn("sim", F.lit(0)), "node", "id", k + 1).select("node", "id")
    each = scored.join(few, "node").where("id != query")
    order = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("sim").alias("score"))
