"""Prefix trie of sequences by a van Emde Boas recursion over depths.

The depths are cut at half, the upper half and all lower halves are cut again, down to single
depths, so a block of size 2^k holds the depths i * 2^k up to (i + 1) * 2^k. One pass over the
sequences, each streamed in order with a logarithmic state, builds the digests of all
blocks from those of their halves and names the prefix at every cut by the name at the start of
its block and the digest of the half before the cut. Equal prefixes have equal names, so
all upper tries and lower forests of all levels are built by one aggregation of the names.

Totals are grafted upward block by block: at size 2^k, the total of every tree in a lower
half is added to its parent, the last depth of the upper half, and from there to the parent's
ancestors in that half, which are the prefixes of any one of its members. Blocks of a
level are done together, in as many rounds as the logarithm of the longest sequence.

Sequences are partitioned by family (a sequence and those that borrow from it) and sorted
there by Spark; a task holds the borrowed items only (at most `BORROWED`). A node with
very many members or children is aggregated partly before shuffles, and looked up in a
broadcast of at most `HOT` rows.

Defined results: an item's null role or text is empty; items are ordered by turn (null
first), ties by a digest of role and text, and repeated items stay; items with a null
sequence id belong to no sequence; a sequence without items ends at the root; an empty
table has no sequences, hence no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.components import hot_keys, lookup
from tavola.session import store

#: Sequences in a family, and the most items one may borrow from the family's first.
FAMILY, BORROWED = 5, 8
NAME_BYTES = 16
ROOT = bytes(NAME_BYTES)
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
#: Rows in one batch of results.
ROWS = 50_000

PREFIX = "seq long, depth int, name binary, parent binary, bytes long, last boolean"


def digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=NAME_BYTES).digest()


class Names:
    """Names of the prefixes of one sequence, item by item.

    `cuts` are the cuts that the present depth's blocks started at: (size of block, digest of the
    block, name at its start), with sizes that halve. Equal sizes are joined as
    a counter carries.
    """

    def __init__(self) -> None:
        self.depth = 0
        self.name = ROOT
        self.cuts: list[tuple[int, bytes, bytes]] = []

    def add(self, item: bytes) -> None:
        size, block, start = 1, item, self.name
        while self.cuts and self.cuts[-1][0] == size:
            _, left, start = self.cuts.pop()
            size, block = 2 * size, digest(b"b", left, block)
        self.depth += 1
        self.name = digest(b"n", start, size.to_bytes(8, "little"), block)
        self.cuts.append((size, block, start))


def _walk(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rebuilt sequences of families that come one after the other, sorted, as rows of their prefixes."""
    family = seq = None
    first: list[tuple[bytes, int]] = []
    taken = borrowed = 0
    names = Names()
    rows: list[tuple] = []

    def emit(item: bytes, size: int) -> None:
        parent = names.name
        names.add(item)
        rows[-1] = (*rows[-1][:5], False)
        rows.append((seq, names.depth, names.name, parent, size, True))

    def batch() -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for part in batches:
        columns = (part.column(c).to_pylist() for c in ("family", "seq", "borrow", "item", "bytes"))
        for of, number, borrow, item, size in zip(*columns):
            if of != family:
                family, first, seq = of, [], None
            if number != seq:
                if len(rows) >= ROWS:
                    yield batch()
                    rows = []
                seq, names, taken, borrowed = number, Names(), 0, borrow
                rows.append((seq, 0, ROOT, None, 0, True))
                if seq != family:
                    for held in first[:borrowed]:
                        emit(*held)
            if item is None:
                continue
            taken += 1
            if seq == family:
                if taken <= BORROWED:
                    first.append((item, size))
                emit(item, size)
            elif taken > borrowed:
                emit(item, size)
    yield batch()


def prefixes(rows: DataFrame, seq: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(seq, depth, name, parent, bytes, last) of every prefix of every rebuilt sequence.

    Sequence c takes the first h items of c - c mod `FAMILY` and its own after its first h, with
    h = crc32(decimal c) mod (`BORROWED` + 1).
    """
    id_ = F.col(seq).cast("long")
    words = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    item = F.unhex(F.sha2(F.concat(F.length(words[0]).cast("string"), F.lit(":"), *words), 256))
    placed = rows.where(id_.isNotNull()).select(
        (id_ - F.pmod(id_, F.lit(FAMILY))).alias("family"),
        id_.alias("seq"),
        F.col(turn).alias("turn"),
        (F.crc32(id_.cast("string")) % (BORROWED + 1)).cast("int").alias("borrow"),
        item.alias("item"),
        F.octet_length(words[1]).cast("long").alias("bytes"),
    )
    schema = pa.schema(
        [("seq", pa.int64()), ("depth", pa.int32()), ("name", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64()), ("last", pa.bool_())]
    )
    ordered = placed.repartition("family").sortWithinPartitions("family", "seq", F.asc_nulls_first("turn"), "item")
    return ordered.drop("turn").mapInArrow(lambda batches: _walk(batches, schema), PREFIX)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the sequence ids of every name; rows come sorted by name and id."""
    now, running = None, None
    names, digests = [], []
    for part in batches:
        for name, seq in zip(part.column("name").to_pylist(), part.column("seq").to_pylist()):
            if name != now:
                if running is not None:
                    names.append(now)
                    digests.append(running.hexdigest())
                now, running = name, hashlib.sha256(str(seq).encode())
            else:
                running.update(b",%d" % seq)
        if len(names) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], ["name", "ends_sha256"])
            names, digests = [], []
    if running is not None:
        names.append(now)
        digests.append(running.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], ["name", "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """(name, ends_sha256) of the prefixes that are whole sequences. A name with very many is hashed in a
    stream, since the digest depends on the order of all of them."""
    last = paths.where("last").select("name", "seq")
    return last.repartition("name").sortWithinPartitions("name", "seq").mapInArrow(_hash_ends, "name binary, ends_sha256 string")


def graft(nodes: DataFrame, paths: DataFrame, totals: list[str]) -> DataFrame:
    """(name, totals) with each total summed over the node's subtree.

    `nodes` has (name, depth, parent, seq, totals) with any member as `seq`; `paths` the prefixes of all of them.
    """
    sums = [F.sum(c).alias(c) for c in totals]
    deepest = nodes.agg(F.max("depth")).first()[0]
    given = [nodes.select("name", "depth", "parent", *totals)]
    size = 1
    while deepest is not None and size <= deepest:
        # Blocks of two `size`: tops of the lower halves hold what their own blocks gave them so far.
        top = F.pmod("depth", F.lit(2 * size)) == size
        known = given[0].where(top)
        for more in given[1:]:
            known = known.unionByName(more.where(top))
        per_parent = known.groupBy("name").agg(F.first("parent", True).alias("parent"), *sums).groupBy("parent").agg(*sums)
        block = F.floor(F.col("depth") / (2 * size)).alias("block")
        at = per_parent.withColumnRenamed("parent", "name").join(nodes.select("name", "seq", block), "name").drop("name")
        upper = paths.where(F.pmod("depth", F.lit(2 * size)) < size).select("seq", block, "name", "depth")
        added = upper.join(at, ["seq", "block"]).groupBy("name", "depth").agg(*sums)
        given.append(store(added.withColumn("parent", F.lit(None).cast("binary")), "grafts"))
        size *= 2
    whole = given[0]
    for more in given[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("name").agg(*sums)


def trie(rows: DataFrame, **columns: str) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = store(prefixes(rows, **columns), "paths")
    nodes = paths.groupBy("name", "depth").agg(
        F.min("seq").alias("seq"),
        F.first("parent", True).alias("parent"),
        F.count("*").alias("n_convs"),
        F.max("bytes").alias("bytes"),
    )
    nodes = store(nodes, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    leaf = (F.col("n_children") == 0).cast("long").alias("n_leaves")
    saved = ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
    nodes = store(nodes.select("name", "depth", "seq", "parent", "n_convs", "n_children", leaf, saved), "nodes")
    totals = graft(nodes, paths, ["n_leaves", "saved_tokens"])
    above = nodes.select(F.col("name").alias("parent"), F.col("seq").alias("parent_conv_id"))
    below = nodes.where("parent IS NOT NULL").select("name", "depth", "seq", "parent", "n_convs", "n_children")
    named = lookup(below, "parent", above, hot_keys(below, "parent")).drop("parent")
    root = nodes.where("parent IS NULL").select("name", "depth", "seq", "n_convs", "n_children", F.lit(None).cast("long").alias("parent_conv_id"))
    whole = named.unionByName(root).join(totals, "name").join(ends(paths), "name", "left")
    return whole.select(
        F.col("seq").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST)).alias("ends_sha256"),
    ).withColumn("depth", F.col("depth").cast("long"))
