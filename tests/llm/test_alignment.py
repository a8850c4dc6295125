"""Alignment of tokens of two tokenizers against a brute-force one."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tavola.llm import alignment
from tavola.llm.bpe import _byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: b for b, c in enumerate(_byte_letters())}
    rows = []
    for text in texts:
        a = tokenizer.encode(" " + (text or ""), add_special_tokens=False)
        b = pieces.encode(text or "")
        bytes_a = [bytes(letters[c] for c in t) for t in a.tokens]
        bytes_b = [bytes([int(p[3:-1], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, pieces.id_to_piece(i)) for i in b)]
        plain = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != plain or b"".join(bytes_b) != plain:
            rows.append(([], [], [], ""))
            continue
        ends = []
        for tokens in (bytes_a, bytes_b):
            at, out = 0, []
            for t in tokens:
                at += len(t)
                out.append(at)
            ends.append(out)
        links = [(i, ends[1].index(e)) for i, e in enumerate(ends[0]) if e in set(ends[1])]
        groups, p, q = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, a.ids[p : i + 1])) + "|" + ",".join(map(str, b[q : j + 1])))
            p, q = i + 1, j + 1
        rows.append((a.ids, b, [(a.ids[i], b[j]) for i, j in links], ";".join(groups)))
    count = Counter(pair for r in rows for pair in r[2])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(len(a), len(b), len(links), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), groups) for a, b, links, groups in rows]


def texts(data):
    import pyarrow.parquet as pq

    rng = random.Random(4)
    real = pq.read_table(f"{data}/documents.parquet", columns=["text"])["text"].to_pylist()[:60]
    odd = ["", None, "a", " ", "\n\n x\t", "<|endoftext|> <s> </s> <unk>", "a▁b", "é ﬁ", "\U0001F600 中文", "\x00\x1c q", "it's 12345 don't"]
    made = ["".join(rng.choices("ab \n'é中\U0001F600-1", k=rng.randrange(40))) for _ in range(60)]
    return [t[:1500] if t else t for t in real] + odd + made + ["ab " * 900, "ab " * 900, "x" * 3000]


@pytest.mark.parametrize("sent", [1 << 19, 20, 0])
def test_alignment_equals_brute_force(spark, data, monkeypatch, sent):
    monkeypatch.setattr(alignment, "SENT", sent)
    made = texts(data)
    df = spark.createDataFrame([(n, t, 1, 2) for n, t in enumerate(made)], "doc_id long, text string, row int, groups int").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.alignment(df, A, B).collect()}
    want = brute(made)
    assert [got[n] for n in range(len(made))] == want
    assert any(w[0] == 0 for w, t in zip(want, made) if t)


def test_digest_ids_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 10)
    df = spark.createDataFrame([("x", "one two"), ("x", "one two"), (None, "three four five six"), ("y", None)], "doc_id string, text string")
    got = sorted(map(tuple, alignment.alignment(df, A, B, digest=True).collect()), key=str)
    plain = sorted(map(tuple, alignment.alignment(df, A, B).collect()), key=str)
    assert len(got) == 4 and [r[:-1] for r in got] == [r[:-1] for r in plain]
    assert [r[-1] for r in got] == [g[-1] and hashlib.sha256(g[-1].encode()).hexdigest() for g in plain]
    assert alignment.alignment(df.limit(0), A, B).count() == 0


def test_lockstep():
    i, j = alignment.lockstep([np.array([2, 3, 5]), np.array([1, 4])], [np.array([1, 3, 4, 5]), np.array([4])])
    assert list(zip(i.tolist(), j.tolist())) == [(1, 1), (2, 3), (4, 4)]


def test_very_long_texts(spark):
    df = spark.createDataFrame([(1, " " * 200_000), (2, "word " * 60_000), (3, "x" * 100_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.alignment(df, A, B, digest=True).collect()}
    assert got[2]["n_groups"] > 60_000 and got[1]["n_a"] > 0 and got[3]["n_a"] > 0
