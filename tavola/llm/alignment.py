"""Alignment of two tokenizers' tokens: lockstep merging of token ends by state vectors.

A text is encoded as space + text by a byte-level BPE (A) and as text by a piece BPE (B), which
puts a space in front itself. Both lists of tokens, as bytes, must join to space + text. Of
every document of a batch, one state vector holds the next A and the next B token. In
each step all documents at once compare the ends of their two tokens: the token that ends
first is passed, and where both end together a link and a cut are emitted and both are
passed. Documents that are through are taken out of the vectors.

Links are counted by id pair over the corpus: documents keep their distinct pairs with
times, tasks add them up before the shuffle. The `SENT` pairs with most links are
sent to all tasks (a fixed size); pairs beyond them meet their counts in a shuffle, so the
result is the same for every size of `SENT`.

Defined results: a text that is null, empty or whose joined bytes differ from space + text
(as where B normalises a character) has no tokens: zeros and empty groups. Strings of
special tokens inside texts are plain text. Repeated rows stay, each on its own. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavola.llm.bpe import _byte_letters
from tavola.llm.components import hot_keys, lookup
from tavola.session import store

#: Pairs that are sent to all tasks, at 17 bytes each.
SENT = 1 << 19
#: Characters of the texts whose tokens a task holds at once; a longer text is alone.
CHUNK_CHARS = 1 << 20
#: Distinct pairs a task counts before it hands them on.
COUNTED = 1 << 20


class ByteLevel:
    """Encoder of a byte-level BPE file whose ids follow the order of its merges."""

    def __init__(self, content: str):
        spec = json.loads(content)
        vocab = spec["model"]["vocab"]
        special = {t["id"] for t in spec["added_tokens"]}
        of_letter = {letter: b for b, letter in enumerate(_byte_letters())}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if i in special else bytes(of_letter[c] for c in token)
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("ids do not follow the order of merges")
        ranks = {b: i for i, b in enumerate(self.bytes) if i not in special and b}
        self.model = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self.model.encode_to_numpy(text, disallowed_special=())


#: Pre-tokens of the byte-level pre-tokenizer: contractions, letters, digits, others, white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Pieces:
    """Encoder of a sentencepiece model."""

    def __init__(self, content: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.bytes = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode([text], num_threads=1)[0], np.int64)


@cache
def _loaded(kind: type, content: str | bytes):
    return kind(content)


def lockstep(ends_a: list[np.ndarray], ends_b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), in the concatenated lists, of tokens that end together.

    The lists of a document hold the ends of its tokens, ascend and have the same last one.
    """
    ea, eb = np.concatenate(ends_a), np.concatenate(ends_b)
    stop = np.cumsum([len(e) for e in ends_a])
    i = stop - [len(e) for e in ends_a]
    j = np.cumsum([len(e) for e in ends_b]) - [len(e) for e in ends_b]
    found_i, found_j = [], []
    while len(i):
        x, y = ea[i], eb[j]
        both = x == y
        if both.any():
            found_i.append(i[both])
            found_j.append(j[both])
        i, j = i + (x <= y), j + (y <= x)
        open_ = i < stop
        if not open_.all():
            i, j, stop = i[open_], j[open_], stop[open_]
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


class Aligner:
    def __init__(self, byte_level: ByteLevel, pieces: Pieces, digest: bool = False):
        self.digest = digest
        self.a, self.b = byte_level, pieces
        self.size_a, self.size_b = (np.array([len(t) for t in m.bytes]) for m in (byte_level, pieces))
        # Every id followed by a comma or, at the end of its group, by a bar (A) or semicolon (B).
        self.shown = [f"{i}{mark}" for m, marks in ((byte_level, ",|"), (pieces, ",;")) for mark in marks for i in range(len(m.bytes))]

    def groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """Ids of every group, A and B (or their digest), given the places of the groups' last tokens."""
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[last_a] = end_b[last_b] = 1
        before_a, before_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        row = np.empty(len(a) + len(b), np.int64)
        row[np.arange(len(a)) + np.concatenate([[0], last_b + 1])[before_a]] = a + end_a * len(self.size_a)
        row[np.arange(len(b)) + (last_a + 1)[before_b]] = b + end_b * len(self.size_b) + 2 * len(self.size_a)
        text = "".join(map(self.shown.__getitem__, row.tolist()))[:-1]
        return hashlib.sha256(text.encode()).hexdigest() if self.digest else text

    def chunk(self, texts: list[str]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, groups, pairs, times) of every text.

        The byte-level tokens are pieces of the text, so their bytes join to it if their sizes add up.
        """
        kept, tokens = [], []
        for at, text in enumerate(texts):
            if not text:
                continue
            whole = " " + text
            a, b, plain = self.a.encode(whole), self.b.encode(text), whole.encode()
            if self.size_a[a].sum() == len(plain) and plain == b"".join(map(self.b.bytes.__getitem__, b.tolist())):
                kept.append(at)
                tokens.append((a, b))
        out: list[tuple] = [(0, 0, 0, "", b"", b"")] * len(texts)
        if not kept:
            return iter(out)
        i, j = lockstep([np.cumsum(self.size_a[a]) for a, _ in tokens], [np.cumsum(self.size_b[b]) for _, b in tokens])
        first_a, first_b = (np.concatenate([[0], np.cumsum([len(t[k]) for t in tokens])]) for k in (0, 1))
        bounds = np.searchsorted(i, first_a)
        for n, (at, (a, b)) in enumerate(zip(kept, tokens)):
            x, y = i[bounds[n] : bounds[n + 1]] - first_a[n], j[bounds[n] : bounds[n + 1]] - first_b[n]
            pairs, times = np.unique(a[x].astype(np.int64) << 32 | b[y], return_counts=True)
            out[at] = (len(a), len(b), len(x), self.groups(a, b, x, y), pairs.tobytes(), times.astype(np.int32).tobytes())
        return iter(out)

    def texts(self, texts: list[str | None]) -> list[tuple]:
        """Results in the order of `texts`, made in chunks of texts of like length."""
        out: list[tuple] = [()] * len(texts)
        waiting, chars = [], 0
        order = sorted(range(len(texts)), key=lambda n: len(texts[n] or ""))
        for n in order:
            waiting.append(n)
            chars += len(texts[n] or "")
            if chars >= CHUNK_CHARS or n == order[-1]:
                for at, made in zip(waiting, self.chunk([texts[w] or "" for w in waiting])):
                    out[at] = made
                waiting, chars = [], 0
        return out


def align(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, pairs, times) of every row.

    `groups` is `a1,a2|b1;a3|b2,b3` (its SHA-256 in hex if `digest`); `pairs` are the distinct linked id
    pairs, a * 2^32 + b, as 64-bit integers, and `times` how often each is linked, as 32-bit ones. The files are read here
    and sent to the executors; they have the size of vocabularies.
    """
    context = docs.sparkSession.sparkContext
    with open(byte_level, encoding="utf-8") as f:
        file_a = context.broadcast(f.read())
    with open(pieces, "rb") as f:
        file_b = context.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(_loaded(ByteLevel, file_a.value), _loaded(Pieces, file_b.value), digest)
        names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"]
        types = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * 2
        for batch in batches:
            made = aligner.texts(batch.column("text").to_pylist())
            columns = [list(c) for c in zip(*made)] if made else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"]])
    for name, kind in [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("groups", "string"), ("pairs", "binary"), ("times", "binary")]:
        schema = schema.add(name, kind)
    return rows.mapInArrow(work, schema)


def _added(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return ids, np.bincount(at, np.concatenate(times), len(ids)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) over the documents of a task, in parts of at most about `COUNTED` distinct pairs."""
    pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        more = [b"".join(batch.column(c).to_pylist()) for c in ("pairs", "times")]
        pairs, times = _added([pairs, np.frombuffer(more[0], np.int64)], [times, np.frombuffer(more[1], np.int32)])
        if len(pairs) >= COUNTED:
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])
            pairs, times = pairs[:0], times[:0]
    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of every pair over all documents, and whether no pair with its B id has more."""
    counts = store(aligned.select("pairs", "times").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return store(lookup(counts, "b", most, hot_keys(counts, "b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def link_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of every row that has links; `row` names the rows of `aligned`."""
    sent = counts.orderBy(F.desc("n"), "pair").limit(SENT).toPandas().sort_values("pair")
    known = counts.sparkSession.sparkContext.broadcast((sent["pair"].to_numpy(), sent["n"].to_numpy(), sent["best"].to_numpy().astype(bool)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, best = known.value
        for batch in batches:
            pairs = [np.frombuffer(p, np.int64) for p in batch.column("pairs").to_pylist()]
            times = [np.frombuffer(t, np.int32).astype(np.int64) for t in batch.column("times").to_pylist()]
            rows = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
            p, t = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs, times))
            sums = [np.zeros(len(pairs), np.int64) for _ in range(2)]
            here = np.zeros(len(p), bool)
            if len(ids):
                at = np.minimum(np.searchsorted(ids, p), len(ids) - 1)
                here = ids[at] == p
                np.add.at(sums[0], rows[here], (t * best[at])[here])
                np.add.at(sums[1], rows[here], (t * n[at])[here])
            starts = np.concatenate([[0], np.cumsum(np.bincount(rows[~here], minlength=len(pairs)))])
            left = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x[~here])) for x in (p, t)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sums[0]), pa.array(sums[1]), *left], ["row", "n_best", "count_sum", "pair", "times"]
            )

    schema = "row long, n_best long, count_sum long, pair array<long>, times array<long>"
    seen = store(aligned.where("n_a > 0").select("row", "pairs", "times").mapInArrow(work, schema), "links")
    rest = seen.where(F.size("pair") > 0).select("row", F.explode(F.arrays_zip("pair", "times")).alias("p")).select("row", "p.pair", "p.times")
    met = rest.join(counts, "pair").select(
        "row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")
    )
    both = seen.select("row", "n_best", "count_sum").unionByName(met)
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(docs: DataFrame, byte_level: str, pieces: str, **columns) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row of `docs`."""
    made = align(docs, byte_level, pieces, **columns)
    made = store(made.withColumn("row", F.monotonically_increasing_id()), "aligned")
    found = link_counts(made, pair_counts(made))
    return made.drop("pairs", "times").join(found, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"),
        "groups",
    )
