"""Toxic documents by a support vector machine on a subsequence string kernel.

The gap-weighted kernel counts the subsequences of `LENGTH` letters that two strings
share; every letter of the span, matched or skipped, costs a factor `DECAY`. So an insult
with letters inserted or left out stays near the plain one. The kernel is normalised.

Units are the words of a sentence without punctuation inside; letters written apart are
one unit. A sentence scores as its worst unit and a document as its worst sentence.

Training takes documents labelled 0 or 1. Landmarks for the Nystroem features are words and
word fragments whose document counts differ most between the labels (likelihood ratio),
none of them close to another. Since labels are given for documents, the units that
carry a label are found in turns: the machine is trained on the current worst unit of
each toxic document against the hardest units of clean ones, then the worst units are
chosen again. A logistic curve turns the worst margin into a score between 0 and 1.

Training rows are bounded by `rows_per_label` (expected number, by a hash of the id) and
learned from in one task; scoring covers every row and whole texts, and caches units within a Python worker only.

Defined results: null and empty texts are scored as texts without units (score of a
document with nothing suspicious); labels that are null or neither 0 nor 1 are not used; ids
with several labels count as toxic if one label is 1; without rows of both labels every score is
0 (or 1, if all labels are 1). Columns named like the results are replaced.
"""

from __future__ import annotations

import math
import pickle
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH = 3
DECAY = 0.7
#: Power of the normalised kernel, which is a kernel again and sets near strings apart.
POWER = 2
LANDMARKS = 48
#: Least likelihood ratio of a landmark, and the closest two landmarks may be.
LEAST_RATIO = 20.0
CLOSEST = 0.4
#: Marks of the ends of a word, so that a fragment at its start differs from one inside.
FIRST, LAST = "\x02", "\x03"
#: Units longer than this are read in windows that overlap by half.
LONGEST = 32
ROWS_PER_LABEL = 2000
ROUNDS = 3
HARD_UNITS = 20_000
#: Total weight of clean units where toxic ones have 1.
CLEAN_WEIGHT = 10.0
KEPT = 150_000
BATCH = 1024

_APART = re.compile(r"(?<!\S)\w(?:[ .\-_*]+\w(?!\w)){2,}")
_NOT_WORD = re.compile(r"[\W_]+")


def codes(words: list[str]) -> np.ndarray:
    """Code points, one row for each word, 0 behind its end."""
    n = max(map(len, words))
    joined = "".join(w.ljust(n, "\0") for w in words)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)


def self_kernel(s: np.ndarray) -> np.ndarray:
    """Gap-weighted kernel of each row with itself."""
    return _run(s, s.T[:, None, :], [1] * s.shape[1])[0]


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gap-weighted kernel of each row of `s` (columns of the result) with each row of `t`, whose
    rows are sorted from long to short."""
    return _run(s, t.T[:, :, None], (t != 0).sum(0).tolist())


def _run(s: np.ndarray, t: np.ndarray, rows: list[int]) -> np.ndarray:
    """The dynamic programme. t[b] holds the letters at position b, which the first rows[b] strings have."""
    width = len(s)
    decay, square = np.float32(DECAY), np.float32(DECAY * DECAY)
    prime = [[np.zeros((m, width), np.float32) for m in rows] for _ in range(1, LENGTH)]
    total = np.zeros((rows[0], width), np.float32)
    for a in range(s.shape[1]):
        x = s[:, a]
        filled = x != 0
        if not filled.any():
            break
        same = [np.equal(t[b][:m], x) * square for b, m in enumerate(rows)]
        if not filled.all():
            for m in same:
                m *= filled
        for b in range(1, len(rows)):
            total[: rows[b]] += same[b] * prime[-1][b - 1][: rows[b]]
        for i in range(LENGTH - 2, -1, -1):
            run = None
            for b, m in enumerate(rows):
                own = prime[i][b]
                own *= decay
                if i == 0:
                    step = same[b]
                elif b:
                    step = same[b] * prime[i - 1][b - 1][:m]
                else:
                    continue
                run = step.copy() if run is None else run[:m] * decay + step
                own += run
    return total


def similarity(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of each word with each landmark, to the power `POWER`."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    columns = sorted(range(len(landmarks)), key=lambda i: -len(landmarks[i]))
    marks = codes([landmarks[i] for i in columns])
    own = np.maximum(self_kernel(marks), 1e-12)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for start in range(0, len(order), BATCH):
        rows = order[start : start + BATCH]
        w = codes([words[i] for i in rows])
        norm = np.maximum(self_kernel(w), 1e-12)
        out[np.ix_(rows, columns)] = (kernel(w, marks) / np.sqrt(own[:, None] * norm[None, :])).T ** POWER
    return out


def units(text: str) -> set[str]:
    """Raw words of a text, in lower case; letters written apart are joined as well."""
    text = text.lower()
    found = set(text.split())
    found.update(m[0] for m in _APART.finditer(text))
    return found


def windows(raw: str) -> list[str]:
    word = _NOT_WORD.sub("", raw)
    if len(word) < LENGTH:
        return []
    word = FIRST + word + LAST
    if len(word) <= LONGEST:
        return [word]
    half = LONGEST // 2
    return [word[i : i + LONGEST] for i in range(0, len(word) - half, half)]


@dataclass
class ToxicityModel:
    landmarks: list[str]
    #: Weight of each landmark's similarity, and the bias: the machine behind the Nystroem map.
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    #: Score of every row where there was nothing to learn from.
    constant: float | None = None

    def margins(self, words: list[str]) -> np.ndarray:
        return similarity(words, self.landmarks) @ self.weights + self.bias

    def scores(self, texts: list[str | None], kept: dict[str, float]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        found = [units(t or "") for t in texts]
        new = [w for w in set().union(*found) if w not in kept]
        parts = [windows(w) for w in new]
        unique = list({p for ps in parts for p in ps})
        margin = dict(zip(unique, self.margins(unique).tolist())) if unique else {}
        kept.update((w, max((margin[p] for p in ps), default=self.bias)) for w, ps in zip(new, parts))
        worst = [max(map(kept.__getitem__, ws), default=self.bias) for ws in found]
        return [1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * m + self.offset)))) for m in worst]


def _ratio(k1: int, n1: int, k0: int, n0: int) -> float:
    """Likelihood ratio of a share k1 / n1 above k0 / n0, 0 if it is not above."""
    if k1 * n0 <= k0 * n1:
        return 0.0
    p = (k1 + k0) / (n1 + n0)

    def part(k: int, n: int, q: float) -> float:
        return (k * math.log(q) if k else 0.0) + ((n - k) * math.log(1 - q) if n > k else 0.0)

    return 2 * (part(k1, n1, k1 / n1) + part(k0, n0, k0 / n0) - part(k1, n1, p) - part(k0, n0, p))


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]]) -> list[str]:
    def fragments(words: set[str]) -> set[str]:
        return {w for w in words if len(w) <= 14} | {w[i : i + n] for w in words for n in (5, 6) for i in range(len(w) - n + 1)}

    bad = Counter(x for d in toxic for x in fragments(d))
    bad = {x: n for x, n in bad.items() if n > 1}
    good = Counter()
    for d in clean:
        good.update(x for x in fragments(d) if x in bad)
    rated = sorted(((_ratio(n, len(toxic), good[x], len(clean)), len(x), x) for x, n in bad.items()), reverse=True)
    chosen: list[str] = []
    for ratio, _, x in rated[: 40 * LANDMARKS]:
        if ratio < LEAST_RATIO or len(chosen) == LANDMARKS:
            break
        if not chosen or similarity([x], chosen).max() < CLOSEST:
            chosen.append(x)
    return chosen or [x for _, _, x in rated[:LANDMARKS]]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return w @ ridge @ w + weight @ np.maximum(0, 1 - y * (x @ w)) ** 2

    for _ in range(50):
        short = 1 - y * (x @ w) > 0
        inside = x[short]
        new = np.linalg.solve((inside * weight[short, None]).T @ inside + ridge, inside.T @ (weight[short] * y[short]))
        step, now = new - w, loss(w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, with smoothed targets, by Newton steps."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    design = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-6)[:, None]).T @ design + 1e-6 * np.eye(2), design.T @ (p - target))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def train(texts: list[str | None], labels: list[int]) -> ToxicityModel:
    """Model from labelled documents (1 toxic, 0 clean)."""
    if not {0, 1} <= set(labels):
        return ToxicityModel([], np.zeros(0), 0.0, 1.0, 0.0, float(1 in labels))
    # Documents share most of their words, which are held once.
    bags = [{sys.intern(p) for w in units(t or "") for p in windows(w)} for t in texts]
    toxic = [b for b, y in zip(bags, labels) if y]
    clean = [b for b, y in zip(bags, labels) if not y]
    landmarks = choose_landmarks(toxic, clean)
    if not landmarks:
        return ToxicityModel([], np.zeros(0), 0.0, 1.0, 0.0, sum(labels) / len(labels))
    values, vectors = np.linalg.eigh(similarity(landmarks, landmarks).astype(np.float64))
    keep = values > 1e-3
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nystroem map: similarities times root

    words = sorted(set().union(*bags))
    index = {w: i for i, w in enumerate(words)}
    near = similarity(words, landmarks)
    best = near.max(1)
    free = np.fromiter(sorted({index[w] for b in clean for w in b}), int)
    hard = free[np.argsort(-best[free], kind="stable")[:HARD_UNITS]]
    members = [np.fromiter((index[w] for w in sorted(b)), int) for b in bags]
    worst = np.array([m[best[m].argmax()] if len(m) else -1 for m, y in zip(members, labels) if y])
    margin = np.zeros(len(words))
    weights, bias = np.zeros(len(landmarks)), 0.0
    known = np.zeros(len(words), bool)
    known[free] = True
    for _ in range(ROUNDS):
        picked, times = np.unique(worst[(worst >= 0) & ~known[worst]], return_counts=True)
        if not len(picked):
            break
        rows = np.concatenate([picked, hard])
        y = np.concatenate([np.ones(len(picked)), -np.ones(len(hard))])
        # Toxic units count by the root of their documents, so that rare ones are heard.
        weight = np.concatenate([np.sqrt(times) / np.sqrt(times).sum(), np.full(len(hard), CLEAN_WEIGHT / len(hard))])
        w, bias = _machine(near[rows].astype(np.float64) @ root, y, weight)
        weights = root @ w
        margin = near @ weights + bias
        worst = np.array([m[margin[m].argmax()] if len(m) else -1 for m, y in zip(members, labels) if y])
    top = np.array([margin[m].max() if len(m) else bias for m in members])
    slope, offset = _curve(top, np.where(np.array(labels) > 0, 1.0, -1.0))
    return ToxicityModel(landmarks, weights.astype(np.float32), float(bias), slope, offset)


def bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, keep: Column, rows_per_label: int, seed: int) -> DataFrame:
    """Id, text and label of at most about `rows_per_label` texts of each label, chosen by a hash of the id."""
    known = labels.where(F.col(label).isin(0, 1) & keep).groupBy(doc_id).agg(F.max(label).alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("_y") == y, min(1.0, rows_per_label / n)).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1_000_000)) < share * 1_000_000
    # The ids drawn are a bounded sample, so they are sent to the texts and not the other way round.
    return docs.select(doc_id, text).join(F.broadcast(known.where(drawn)), doc_id).select(F.col(doc_id), F.col(text), "_y")


def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the model of all training rows (id, text, label), in any order."""
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], r[1] or ""))
    model = train([r[1] for r in rows], [int(r[2]) for r in rows])
    yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})


def fit(
    docs: DataFrame,
    labels: DataFrame,
    keep: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows_per_label: int = ROWS_PER_LABEL,
    seed: int = 1,
) -> ToxicityModel:
    """Model from the labelled documents for which `keep` holds.

    The training rows go to one task, and the driver gets the model alone: their words take some
    hundred MB, which a Python process does not give back.
    """
    keep = F.lit(True) if keep is None else keep
    rows = training_rows(docs, labels, doc_id, text, label, keep, rows_per_label, seed)
    made = rows.repartition(1).mapInArrow(trained, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else train([], [])


_CACHE: dict[bytes, dict[str, float]] = {}


def score(df: DataFrame, model: ToxicityModel, text: str = "text", result: str = "score") -> DataFrame:
    """`df` with a score from 0 to 1 for each row."""

    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        kept = _CACHE.setdefault(own.weights.tobytes(), {})
        for texts in batches:
            out: list[float] = []
            run: list[str | None] = []
            n = 0
            for t in texts:
                run.append(t)
                n += len(t or "")
                if n > 2_000_000:
                    out += own.scores(run, kept)
                    run, n = [], 0
                    if len(kept) > KEPT:
                        kept.clear()
            out += own.scores(run, kept) if run else []
            if len(kept) > KEPT:
                kept.clear()
            yield pd.Series(out, dtype="float64")
        # A Python worker lives on for other stages, which need the memory.
        _CACHE.clear()

    return df.withColumn(result, scored.asNondeterministic()(F.col(text)))
