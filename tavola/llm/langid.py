"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its letter n-grams (`ORDERS`, over lower-case
letters, with one mark between words), each found by hash in a table of `BUCKETS` rows. A linear
layer and a softmax give the languages. Embeddings and layer are trained together by
stochastic gradient descent in numpy on windows of the labelled texts and on whole texts. Since average and layer
are both linear, prediction adds up one row of (table times layer) per n-gram; whole texts are
read, in runs that are vectorised.

Calibration: a part of the training texts is held back; a temperature that minimises
their log loss scales the logits, so `score` is the probability of the language named, and
`rejected` marks texts whose score is below the `REJECT` quantile of the held-back scores.
A rejected text keeps its language.

Training rows are bounded by `rows_per_label` (expected number for each language, by a hash of the
id). Defined results: null texts and texts without a letter are `und` with score 0 and rejected;
languages that are null are not learned; without any labelled row all are `und`; with one
language all texts get it. Columns named like the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.naming import free

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
DIMENSION = 16
EPOCHS = 5
RATE = 1.0
#: Letters in a training window.
WINDOW = 160
WINDOWS_PER_TEXT = 4
ROWS_PER_LABEL = 800
#: Share of held-back texts that the rejection threshold turns away.
REJECT = 0.01
#: Letters that are hashed together.
RUN = 1 << 20

UNKNOWN = "und"
_GAP = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint32(0x9E3779B1)


def letters(text: str | None) -> np.ndarray:
    """Code points of the words in lower case with a blank before, between and behind them; none without a letter."""
    if not text or not _LETTER.search(text):
        return np.zeros(0, np.uint32)
    return np.frombuffer(f" {_GAP.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(points: np.ndarray) -> Iterator[np.ndarray]:
    """Table rows of the n-grams of each order; entry i is the n-gram that starts at letter i."""
    h = np.zeros(len(points), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        n = len(points) - order + 1
        if n <= 0:
            return
        h = (h[:n] ^ points[order - 1 :]) * _MIX
        h ^= h >> np.uint32(15)
        if order in ORDERS:
            yield ((h ^ (h >> np.uint32(7))) & np.uint32(BUCKETS - 1)).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    #: Table times layer, one column for each language, and the layer's bias.
    rows: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.0

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, and how many n-grams it has."""
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        run: list[np.ndarray] = []
        owner: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            points = letters(t)
            if len(points):
                run.append(points)
                owner.append(i)
                size += len(points)
            if run and (size >= RUN or i == len(texts) - 1):
                self._add(run, owner, total, count)
                run, owner, size = [], [], 0
        if run:
            self._add(run, owner, total, count)
        return total / np.maximum(count, 1)[:, None] + self.bias, count

    def _add(self, run: list[np.ndarray], owner: list[int], total: np.ndarray, count: np.ndarray) -> None:
        sizes = np.array([len(p) for p in run])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        joined = np.concatenate(run)
        for order, found in zip(ORDERS, buckets(joined)):
            values = self.rows[found]
            values = np.vstack([values, np.zeros((len(joined) - len(found), values.shape[1]), values.dtype)])
            # n-grams that reach into the next text do not count
            for back in range(1, order):
                inside = starts[1:] - back
                values[inside[inside >= 0]] = 0
            total[owner] += np.add.reduceat(values, starts, axis=0, dtype=np.float64)
            count[owner] += np.maximum(sizes - order + 1, 0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        z, count = self.logits(texts)
        p = _softmax(z / self.temperature)
        best = p.argmax(1)
        known = count > 0
        score = np.where(known, p[np.arange(len(p)), best], 0.0)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return names, score, ~known | (score < self.reject)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str | None], langs: list[str], seed: int = 1) -> LanguageModel:
    """Model from labelled texts."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    points = [letters(t) for t in texts]
    y_all = np.array([names.index(x) for x in langs])
    back = rng.random(len(texts)) < 0.2
    examples: list[tuple[np.ndarray, int]] = []
    for p, y, held in zip(points, y_all, back):
        if held or not len(p):
            continue
        for start in rng.integers(0, max(1, len(p) - WINDOW), min(WINDOWS_PER_TEXT, 1 + len(p) // WINDOW)):
            examples.append((np.concatenate(list(buckets(p[start : start + WINDOW]))), y))
    table = rng.normal(0, 1 / DIMENSION, (BUCKETS, DIMENSION))
    layer, bias = np.zeros((DIMENSION, len(names))), np.zeros(len(names))
    share = np.bincount([y for _, y in examples], minlength=len(names)).astype(float) if examples else np.ones(len(names))
    weight = share.sum() / np.maximum(share, 1) / len(names)
    steps, done = max(1, EPOCHS * len(examples)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(examples))
        for start in range(0, len(order), 16):
            rate = RATE * (1 - done / steps)
            batch = [examples[i] for i in order[start : start + 16]]
            done += len(batch)
            hidden = np.stack([table[f].mean(0) for f, _ in batch])
            y = np.array([y for _, y in batch])
            error = _softmax(hidden @ layer + bias)
            error[np.arange(len(y)), y] -= 1
            error *= weight[y][:, None]
            into = error @ layer.T
            layer -= rate * hidden.T @ error / len(y) * 4
            bias -= rate * error.mean(0) * 0.1
            rows = np.concatenate([f for f, _ in batch])
            sizes = np.array([len(f) for f, _ in batch])
            each = np.repeat(rate * into / sizes[:, None] * 8, sizes, axis=0)
            order_of = np.argsort(rows, kind="stable")
            unique, first = np.unique(rows[order_of], return_index=True)
            table[unique] -= np.add.reduceat(each[order_of], first, axis=0)
    model = LanguageModel(names, (table @ layer).astype(np.float32), bias)
    held = np.flatnonzero(back & np.array([len(p) > 0 for p in points]))
    if len(names) > 1 and len(held):
        z, _ = model.logits([texts[i] for i in held])
        y = y_all[held]
        grid = np.exp(np.linspace(np.log(0.1), np.log(10), 80))
        losses = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(losses))])
        model.reject = float(np.quantile(_softmax(z / model.temperature).max(1), REJECT))
    return model


def bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def fit(
    docs: DataFrame, keep: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    rows_per_label: int = ROWS_PER_LABEL, seed: int = 1,
) -> LanguageModel:
    """Model from the rows with a language for which `keep` holds."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known if keep is None else known.where(keep)
    counts = {r[0]: r["n"] for r in known.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col(lang) == name, min(1.0, rows_per_label / n)).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1_000_000)) < share * 1_000_000
    rows = known.where(drawn).select(doc_id, text, lang).collect()
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return train([r[1] for r in rows], [r[2] for r in rows], seed)


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """`df` with lang_pred, score and rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, score, rejected = shared.value.predict(list(texts))
            yield pd.DataFrame({"lang_pred": names, "score": score, "rejected": rejected})

    (made_name,) = free(df, "_lang")
    made = df.withColumn(made_name, predicted.asNondeterministic()(F.col(text)))
    return made.withColumns({c: F.col(made_name)[c] for c in ("lang_pred", "score", "rejected")}).drop(made_name)
