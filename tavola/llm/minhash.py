"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification.

1. Words are split at ASCII white space after A-Z are lower-cased; a document's set holds
   64-bit hashes of its distinct five-word shingles (of the whole sequence, if shorter).
   Documents with equal word sequences are one node from here on.
2. `HASHES` minimum hashes per node are cut into bands of `BAND` rows. Nodes that share a
   band fall into a bucket. At similarity 0.75, a pair shares none with probability 5e-6.
3. Every member of a bucket is a candidate with the bucket's center, the member whose
   buckets are the largest together, so the one most like the others. Signatures are
   compared in batches; a candidate is dropped as soon as the posterior probability (uniform prior) that
   its similarity reaches the threshold falls below `MISS`. The rest are verified on the
   whole sets. Links give components.
4. Buckets whose members ended up in several components are looked at again. Buckets with members in
   common are one crowd, so that a pair meets once and not once a band: each member outside the
   crowd's largest component meets every member of another component. They meet in blocks of
   signatures, which return the members of surviving pairs, and then, with the whole sets of
   these, in blocks that verify the pairs and return no more than a forest of links.
   In crowds over `SPLIT` members, only nodes that
   share one of their rarest shingles meet (two sets with similarity 0.75 must share one of the
   rarest quarter), so a passage that very many documents have does not bring them together.
   No link between components is lost to a group's size, and no pair leaves its task.

Defined results: null texts and texts without words have an empty set and link with
nothing; rows with equal doc_id are one node; rows with null doc_id link with
nothing, have no component and are kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavola.functions.ngrams import portions
from tavola.llm.components import components
from tavola.session import cut, store

WORDS = 5
HASHES, BAND = 128, 4
#: Similarity as a fraction, so that the bound is exact.
NUMERATOR, DENOMINATOR = 75, 100
BATCH = 32
MISS = 1e-6
SPLIT = 4096
#: Nodes of a crowd that are compared as one block of signatures, and bytes of a block with sets.
BLOCK = 512
BLOCK_BYTES = 4 << 20
#: So many ids (8 MB) are sent to the texts; more are joined with a shuffle.
SENT_IDS = 1_000_000
#: Distinct words whose hashes a Python worker keeps.
WORDS_KEPT = 200_000
#: Characters whose sets and signatures a Python worker holds before it hands them on.
CHARACTERS = 1_000_000

_rng = np.random.default_rng(2)
_MULTIPLY = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_kept: dict[bytes, int] = {}


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8; bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    try:
        h = np.array(list(map(_kept.__getitem__, words)), np.uint64)
    except KeyError:
        if len(_kept) > WORDS_KEPT:
            _kept.clear()
        for w in set(words):
            if w not in _kept:
                _kept[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array(list(map(_kept.__getitem__, words)), np.uint64)
    n = min(WORDS, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _STEP
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(s: np.ndarray) -> bytes:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(s), 2048):
        low = np.minimum(low, (_MULTIPLY[:, None] * s[None, start : start + 2048] + _ADD[:, None]).min(1))
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def parts_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The texts of a batch in parts of about `CHARACTERS`, since a batch may be ten thousand long texts."""
    return (texts.iloc[part] for texts in batches for part in portions((len(t or "") for t in texts), CHARACTERS))


@F.pandas_udf(T.StructType().add("key", "binary").add("n", "long").add("signature", "binary"))
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts_of(batches):
        out = []
        for t in texts:
            words = words_of(t)
            s = shingles(words)
            out.append((xxhash.xxh3_128_digest(b" ".join(words)), len(s), signature(s)))
        yield pd.DataFrame(out, columns=["key", "n", "signature"])
    # A Python worker lives on for other stages, which need the memory.
    _kept.clear()


@F.pandas_udf(T.StructType().add("key", "binary").add("members", "binary"))
def shingle_set(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts_of(batches):
        out = []
        for t in texts:
            words = words_of(t)
            out.append((xxhash.xxh3_128_digest(b" ".join(words)), shingles(words).tobytes()))
        yield pd.DataFrame(out, columns=["key", "members"])
    _kept.clear()


@cache
def least_matches() -> list[int]:
    """For each whole number of batches, the fewest equal hashes that are not pruned.

    With m of n equal, the posterior is Beta(m + 1, n - m + 1); its tail above t is the
    probability that of n + 1 trials with chance t at most m succeed.
    """
    t, out = NUMERATOR / DENOMINATOR, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= MISS:
                break
        out.append(m)
    return out


@F.pandas_udf(T.BooleanType())
def survives(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether two signatures pass every batch."""
    least = least_matches()
    for left, right in batches:
        alive = np.arange(len(left))
        a = np.frombuffer(b"".join(left), "<u4").reshape(-1, HASHES)
        b = np.frombuffer(b"".join(right), "<u4").reshape(-1, HASHES)
        matches = np.zeros(len(left), int)
        for i, m in enumerate(least):
            part = slice(i * BATCH, (i + 1) * BATCH)
            matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
            alive = alive[matches[alive] >= m]
        out = np.zeros(len(left), bool)
        out[alive] = True
        yield pd.Series(out)


@F.pandas_udf(T.BooleanType())
def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether two sorted sets reach the threshold."""
    for left, right in batches:
        out = []
        for x, y in zip(left, right):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both))
        yield pd.Series(out, dtype=bool)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) that are links; b should be the end with fewer pairs.

    Sizes too far apart are dropped first, then signatures, then sets are compared.
    """
    one, two = (nodes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("signature").alias(f"s{c}")) for c in "ab")
    near = F.least("na", "nb") * DENOMINATOR >= F.greatest("na", "nb") * NUMERATOR
    left = pairs.join(two, "b").join(one, "a").where(near)
    left = cut(left.where(survives.asNondeterministic()("sa", "sb")).select("a", "b").distinct())
    ids = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    sets = cut(sets_of(docs, ids))
    one, two = (sets.select(F.col("id").alias(c), F.col("members").alias(f"m{c}")) for c in "ab")
    return left.join(two, "b").join(one, "a").where(linked.asNondeterministic()("ma", "mb")).select("a", "b").distinct()


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, members) of the documents named; repeated rows give one."""
    ids = cut(ids)
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    rows = docs.join(ids, "id", "left_semi").withColumn("_s", shingle_set("text"))
    return rows.groupBy("id", F.col("_s.key").alias("key")).agg(F.first("_s.members").alias("members")).drop("key")


def survivors(b: pd.DataFrame, a: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (in b, in a) and equal hashes of the pairs of different components that pass the sizes and every batch."""
    least = least_matches()
    x, y = (np.frombuffer(b"".join(f["signature"]), "<u4").reshape(-1, HASHES) for f in (b, a))
    nb, na, cb, ca = b["n"].to_numpy(), a["n"].to_numpy(), b["component"].to_numpy(), a["component"].to_numpy()
    found = []
    for start in range(0, len(b), 64):
        rows = slice(start, start + 64)
        near = np.minimum(nb[rows, None], na[None]) * DENOMINATOR >= np.maximum(nb[rows, None], na[None]) * NUMERATOR
        u, v = np.nonzero((cb[rows, None] != ca[None]) & near)
        u += start
        matches = np.zeros(len(u), np.int32)
        for i, m in enumerate(least):
            cols = slice(i * BATCH, (i + 1) * BATCH)
            matches += (x[u, cols] == y[v, cols]).sum(1, dtype=np.int32)
            alive = matches >= m
            u, v, matches = u[alive], v[alive], matches[alive]
        found.append((u, v, matches))
    return tuple(np.concatenate(c) for c in zip(*found))


def _sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return tuple(rows[rows["outside"] == side].sort_values("id", ignore_index=True) for side in (True, False))


def _flagged(rows: pd.DataFrame) -> pd.DataFrame:
    """Members of two blocks that are in a surviving pair."""
    b, a = _sides(rows)
    if not len(a) or not len(b):
        return pd.DataFrame({"id": np.zeros(0, np.int64)})
    u, v, _ = survivors(b, a)
    return pd.DataFrame({"id": np.unique(np.concatenate([b["id"].to_numpy()[u], a["id"].to_numpy()[v]]))})


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of two blocks that join components: surviving pairs are verified on whole sets, the most
    similar first, unless their components are joined already."""
    b, a = _sides(rows)
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = c = root.get(root[c], root[c])
        return c

    links = []
    if len(a) and len(b):
        u, v, matches = survivors(b, a)
        sets_b, sets_a = ([np.frombuffer(m, np.uint64) for m in f["members"]] for f in (b, a))
        cb, ca, ib, ia = (f[c].tolist() for f, c in ((b, "component"), (a, "component"), (b, "id"), (a, "id")))
        for k in np.argsort(-matches, kind="stable"):
            i, j = u[k], v[k]
            one, two = find(cb[i]), find(ca[j])
            if one == two:
                continue
            both = len(np.intersect1d(sets_b[i], sets_a[j], assume_unique=True))
            if DENOMINATOR * both >= NUMERATOR * (len(sets_b[i]) + len(sets_a[j]) - both):
                root[one] = two
                links.append((ia[j], ib[i]))
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def crowds(members: DataFrame) -> DataFrame:
    """(crowd, id, component): members (key, id, component) of keys that have members in common are one crowd."""
    center = members.groupBy("key").agg(F.min("id").alias("center"))
    links = members.select("key", "id").join(center, "key").select("center", "id").distinct()
    named = components(links, "center", "id").select(F.col("node").alias("id"), F.col("component").alias("crowd"))
    return store(members.select("id", "component").distinct().join(named, "id"), "crowds")


def blocks(members: DataFrame, limit: int) -> DataFrame:
    """Members (crowd, id, component, weight, ...) once for every pair of blocks they are in.

    The first block of a pair holds members outside the crowd's largest component (`outside`), the second
    any. Blocks hold about `limit` of weight, so a task's memory is bounded, whatever the crowd's size.
    """
    parts = members.groupBy("crowd", "component").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    whole = parts.groupBy("crowd").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"),
        F.max_by("w", F.struct("n", "component")).alias("w_largest"),
        F.sum("w").alias("w"),
        F.count("*").alias("parts"),
    )
    whole = whole.where("parts > 1").select(
        "crowd",
        "largest",
        F.ceil(F.greatest(F.col("w") - F.col("w_largest"), F.lit(1)) / limit).alias("firsts"),
        F.ceil(F.col("w") / limit).alias("seconds"),
    )
    placed = members.join(whole, "crowd")
    h = F.xxhash64("id")
    second = placed.select(
        "*", F.lit(False).alias("outside"), F.pmod(h, "seconds").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("firsts") - 1)).alias("i")
    )
    first = placed.where("component != largest").select(
        "*", F.lit(True).alias("outside"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("seconds") - 1)).alias("j"), F.pmod(h, "firsts").alias("i")
    )
    return first.unionByName(second).drop("largest", "firsts", "seconds", "weight")


def joining(members: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of crowds (crowd, id, component); no pair leaves its blocks."""
    known = members.join(nodes.select("id", "n", "signature"), "id")
    met = blocks(known.withColumn("weight", F.lit(1)), BLOCK).groupBy("crowd", "i", "j").applyInPandas(_flagged, "id long")
    flagged = store(met.distinct(), "flagged")
    if flagged.isEmpty():
        return flagged.select(F.col("id").alias("a"), F.col("id").alias("b"))
    sets = store(sets_of(docs, flagged), "sets")
    heavy = known.join(sets, "id").withColumn("weight", F.length("members") + 600)
    return store(blocks(heavy, BLOCK_BYTES).groupBy("crowd", "i", "j").applyInPandas(_forest, "a long, b long").distinct(), "links")


def merged(links: DataFrame, label: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of every node after further links (a, b)."""
    named = nodes.select("id").distinct().join(label, F.col("id") == F.col("node"), "left").select(
        "id", F.coalesce("component", "id").alias("c")
    )
    ends = links.join(named.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(
        named.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b"
    )
    whole = components(ends, "ca", "cb").select(F.col("node").alias("c"), F.col("component").alias("whole"))
    return cut(named.join(whole, "c", "left").select(F.col("id").alias("node"), F.coalesce("whole", "c").alias("component")))


def rarest(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Members again, once for each of their rarest shingles, which become the key."""
    sets = cut(sets_of(docs, members.select("id").distinct()))
    numbers = F.transform(
        F.sequence(F.lit(0), (F.length("members") / 8 - 1).cast("int")),
        lambda i: F.conv(F.hex(F.substring(F.col("members"), i * 8 + 1, F.lit(8))), 16, -10).cast("long"),
    )
    each = sets.where(F.length("members") > 0).select("id", F.explode(numbers).alias("key"))
    times = each.groupBy("key").agg(F.count("*").alias("times"))
    ranked = each.join(times, "key").withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("times", "key")))
    n = F.floor(F.length("members") / 8)
    needed = sets.select("id", (n - F.ceil(n * NUMERATOR / DENOMINATOR) + 1).alias("prefix"))
    prefix = ranked.join(needed, "id").where("at <= prefix").select("id", "key")
    return prefix.join(members.select("id", "component").distinct(), "id").select("key", "id", "component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    prints = cut(docs.select("id", fingerprint("text").alias("f")).select("id", "f.*"))
    known = prints.where("id IS NOT NULL")
    nodes = cut(
        known.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    )
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)),
        lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * 4 * BAND + 1, F.lit(4 * BAND))),
    )
    bands = nodes.where("n > 0").select("id", F.explode(keys).alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(bands.join(buckets, "key"))
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    center = shared.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", F.bitwise_not("id"))).alias("center"))
    stars = shared.join(center, "key").where("id != center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    label = components(verified(stars, nodes, docs))

    members = shared.join(label, shared["id"] == label["node"], "left").select(
        "key", "id", "size", F.coalesce("component", "id").alias("component")
    )
    split = members.groupBy("key").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("key")
    members = crowds(members.join(split, "key").select("key", "id", "component"))
    sizes = members.groupBy("crowd").agg(F.count("*").alias("size"))
    large = members.join(sizes.where(F.col("size") > SPLIT), "crowd").select("id", "component")
    small = members.join(sizes.where(F.col("size") <= SPLIT), "crowd").drop("size")
    links = joining(small, nodes, docs)
    if not large.isEmpty():
        links = links.union(joining(crowds(rarest(large, docs)), nodes, docs))
    if not links.isEmpty():
        label = merged(links, label, nodes)

    group = nodes.join(label, nodes["id"] == label["node"], "left").select("key", F.coalesce("component", "id").alias("component"))
    found = prints.select("id", "key", "n").join(group, "key", "left")
    component: Column = F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept")
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `docs` whose document stands for its group, with all columns; rows without id stay."""
    kept = near_duplicates(docs, doc_id, text).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(doc_id)).distinct()
    stay = docs.where(F.col(doc_id).isNotNull()).join(kept, doc_id, "left_semi").dropDuplicates([doc_id])
    return stay.unionByName(docs.where(F.col(doc_id).isNull()))
