"""BPE and unigram counts against the libraries, and rows without text."""

import hashlib
import random
import unicodedata

import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, models, normalizers

from tavola.llm import bpe, viterbi

BPE_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECES_FILE = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "Σίσυφος ΟΔΥΣΣΕΥΣ", "İstanbul ǅ ß", "a\x1cb\x1d \x85 c　d", "<|endoftext|>hi<|startoftext|>x <|END",
    "ééa", "²³½Ⅷ٣ x²", "it's we'll I'D 'tis 's", "x" * 5000, "ab" * 400 + " " + "the" * 300, "日本語テスト 한국어",
    "👩‍👩‍👧 ok", "\x00\x01", "a  b   c", "<s> <0x41> </s>",
]


def letter(rng):
    while True:
        c = chr(rng.choice([32, 32, 10, rng.randrange(0x20, 0x7F), rng.randrange(0x80, 0x2000), rng.randrange(0x2000, 0xD7FF), rng.randrange(0x10000, 0x1FA00)]))
        if unicodedata.category(c) != "Cn":
            return c


def texts(n=400):
    rng = random.Random(3)
    return ODD + ["".join(letter(rng) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_bpe_equals_the_library():
    library, own = Tokenizer.from_file(BPE_FILE), bpe.WordBpe(open(BPE_FILE, encoding="utf-8").read())
    library.no_truncation()
    library.no_padding()
    for t in texts():
        want, got = library.encode(t, add_special_tokens=False).ids, own.encode(t)
        assert list(memoryview(got).cast("I")) == want, repr(t)
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_bpe_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "the cat", "z"), (3, "the cat", "z")], "doc_id long, text string, ids string")
    got = sorted(bpe.bpe_encode(df, BPE_FILE).collect())
    assert [(r["n_tokens"], r["decoded"]) for r in got] == [(0, ""), (0, ""), (2, "the</w> cat</w>"), (2, "the</w> cat</w>")]
    assert hashlib.sha256(got[2]["ids"]).hexdigest() == hashlib.sha256(got[3]["ids"]).hexdigest()
    assert bpe.bpe_encode(df.limit(0), BPE_FILE).count() == 0


@pytest.fixture(scope="module")
def counter():
    return viterbi.UnigramCounter(*viterbi.pieces_of(PIECES_FILE))


def test_counts_equal_a_unigram_model(counter):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES_FILE)
    vocabulary = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    for t in texts():
        if t and "<" not in t:
            assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_ties_and_unknown_characters():
    # "ab" + "c" and "a" + "bc" score alike: the longer last piece wins, both have two pieces
    own = viterbi.UnigramCounter([("▁", -1.0), ("ab", -2.0), ("c", -1.0), ("a", -1.0), ("bc", -2.0), ("abc", -3.0), ("b", -1.0)], False)
    assert own.count("abc") == 2
    assert own.count("") == own.count(None) == 0
    assert own.count("zzz") == 2  # a run of unknown characters is one piece
    fallback = viterbi.UnigramCounter([("▁", -1.0)], True)
    assert fallback.count("é") == 3
    crossing = viterbi.UnigramCounter([("▁", -1.0), ("a", -5.0), ("a▁a", -1.0)], False)
    assert not crossing.splits and crossing.count("a a") == 2


def test_count_rows(spark, counter):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a long word " * 3000, 5)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in viterbi.count_tokens(df, PIECES_FILE).collect()}
    assert got == {1: 0, 2: 0, 3: counter.run("▁" + ("a long word " * 3000).replace(" ", "▁"))}


def test_bpe_holds_few_texts_at_a_time(monkeypatch):
    """A batch of long texts is handed on in parts, with tokens only if they are asked for."""
    monkeypatch.setattr(bpe, "CHARACTERS", 100)
    own = bpe.WordBpe(open(BPE_FILE, encoding="utf-8").read())
    batch = pd.Series(["abc " * 20, None, "", "x y " * 30, "z"] * 3)
    made = list(bpe.encoded(own, [batch, batch[:0]], True))
    assert len(made) >= 4 and "decoded" not in next(bpe.encoded(own, [batch], False))
    together = pd.concat(made, ignore_index=True)
    assert together["ids"].tolist() == [own.encode(t) for t in batch]
    assert together["decoded"].tolist() == [own.decode(own.encode(t)) for t in batch]


def test_bpe_keeps_frequent_words(monkeypatch):
    """A full cache loses the rare words; the frequent one is not merged again for every text."""
    monkeypatch.setattr(bpe, "WORDS_KEPT", 20)
    own = bpe.WordBpe(open(BPE_FILE, encoding="utf-8").read())
    merged, merge = [], own.word_ids
    monkeypatch.setattr(own, "word_ids", lambda word: merged.append(word) or merge(word))
    made = [own.encode(f"frequent rare{'x' * (i % 50)}y{'z' * (i // 50)}") for i in range(200)]
    assert merged.count("frequent") == 1
    assert len(own.kept) + len(own.older) <= 20 and len(set(made)) == 200
