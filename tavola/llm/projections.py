"""Near-duplicate embeddings by counting collisions on sorted projections.

Vectors are scaled to length 1 and projected on `PROJECTIONS` random directions. On each
direction, every vector looks at the window of half-width w around its own value among the sorted values of
the others; those inside collide with it. For directions with standard normal entries,
the difference of two projections is normal with the vectors' distance as standard deviation, independently for
each direction. So the collisions of a pair at the threshold are binomial, and the count that a pair must reach
is the largest one that a pair at the threshold misses with probability `MISS` at most. Pairs that
reach it are verified by their cosine in double precision.

Only vectors with equal labels and lengths meet. A label is cut into blocks by a hash, and each pair
of blocks is one task's work; its memory is bounded whatever the label's size, and it returns
one row for each vector with a link (its number of links and the smallest vector that is connected
with it inside the two blocks), never pairs. The number of block pairs grows with the square of a
label's size. Equal vectors are one node with a multiplicity, so copies cost nothing.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a
null label, link with nothing: 0 links, own component, kept. Rows with null vec_id count as
nothing, have no component and are kept. Repeated rows are vectors of their own and link
with each other. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.components import components
from tavola.session import cut

THRESHOLD = 0.93
PROJECTIONS = 48
#: Half-width of a window, in standard deviations of a pair at the threshold.
WIDTH = 2.0
MISS = 1e-6
BLOCK = 1024


def window(threshold: float) -> float:
    return WIDTH * math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9


def least_collisions() -> int:
    """The largest count that a pair at the threshold misses with probability `MISS` at most."""
    p = math.erf(WIDTH / math.sqrt(2))
    below = 0.0
    for count in range(PROJECTIONS + 1):
        below += math.comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        if below > MISS:
            return count
    return PROJECTIONS


def is_usable(vector: Column) -> Column:
    """Whether every component is a finite number and one is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def collisions(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    """For each projection (row of a and b), windows centred on a's values over b's sorted ones; counts by pair."""
    count = np.zeros((a.shape[1], b.shape[1]), np.uint8)
    for u, v in zip(a, b):
        order = np.argsort(v, kind="stable")
        place = np.empty(len(v), np.int16)
        place[order] = np.arange(len(v), dtype=np.int16)
        ordered = v[order]
        first = np.searchsorted(ordered, u - width, "left").astype(np.int16)[:, None]
        last = np.searchsorted(ordered, u + width, "right").astype(np.int16)[:, None]
        count += (place >= first) & (place < last)
    return count


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1, the smallest node of each one's component under the links (u, v)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(
    df: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 1
) -> DataFrame:
    """One row per row of `df`: vec_id, n_links, component_id, kept."""
    rows = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & is_usable(F.col("v"))
    good = rows.where(usable)
    nodes = cut(good.groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("times")))
    sizes = nodes.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = nodes.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    both = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.select("label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.size("v").alias("length"), "node", "times", "v")
    width, least = window(threshold), least_collisions()

    def links(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        _, i, j, length = key
        found = found.sort_values("node", ignore_index=True)
        x = unit_rows(found["v"])
        turn = np.random.default_rng(seed).standard_normal((length, PROJECTIONS))
        projected = (x @ turn).T.copy()
        node, times, own = (found[c].to_numpy() for c in ("node", "times", "own"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        us, vs = [], []
        for start in range(0, len(left), 512):
            part = left[start : start + 512]
            count = collisions(projected[:, part], projected[:, right], width)
            a, b = np.nonzero(count >= least)
            a, b = part[a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), 50_000):
                u, v = a[k : k + 50_000], b[k : k + 50_000]
                linked = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
                us.append(u[linked])
                vs.append(v[linked])
        u, v = (np.concatenate(p) if p else np.zeros(0, int) for p in (us, vs))
        total = np.zeros(len(node), np.int64)
        np.add.at(total, u, times[v])
        np.add.at(total, v, times[u])
        has = np.flatnonzero(total)
        return pd.DataFrame({"node": node[has], "links": total[has], "root": node[roots(len(node), u, v)[has]]})

    partial = cut(both.groupBy("label", "i", "j", "length").applyInPandas(links, "node long, links long, root long"))
    total = partial.groupBy("node").agg(F.sum("links").alias("links"))
    label_of = components(partial, "node", "root").withColumnRenamed("component", "c")
    classes = nodes.join(total, "node", "left").join(label_of, "node", "left").select(
        "label",
        "v",
        (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
        F.coalesce("c", "node").alias("c"),
    )
    linked = good.join(classes, ["label", "v"]).select("id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept")
    )
