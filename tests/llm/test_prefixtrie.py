"""The prefix trie against a brute-force one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tavola.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, name string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(rows):
    seqs = rebuilt(rows)
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        yield p
        for q in children[p]:
            yield from below(q)

    out = set()
    for p, m in members.items():
        sub = list(below(p))
        last = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(p)))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in sub if q)
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in sub), saved, hashlib.sha256(last.encode()).hexdigest()))
    return out


def made(seed):
    rng = random.Random(seed)
    starts = [[("user", rng.choice("abcé") * 3) for _ in range(rng.randrange(1, 20))] for _ in range(6)]
    rows = []
    for c in rng.sample(range(150), 90):
        turns = list(rng.choice(starts))[: rng.randrange(0, 22)] + [(rng.choice(["assistant", None]), rng.choice(["x", "y", "", None])) for _ in range(rng.randrange(3))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(3, None, "system", "s"), (None, 0, "user", "lost"), (7, 1, "user", "t"), (7, 1, "user", "t")]
    rows += [(200 + i, j, "user", str(j // 7)) for i in range(3) for j in range(70 - 3 * i)]  # long ones
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(*r, "n") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in prefixtrie.trie(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_few_rows(spark):
    df = spark.createDataFrame([(11, 0, "user", "a", "n")], SCHEMA)
    assert {tuple(r) for r in prefixtrie.trie(df).collect()} == brute([(11, 0, "user", "a")])
    turnless = [(c, 0, "user", "a", "n") for c in range(1, 40) if c % 5]
    assert {tuple(r) for r in prefixtrie.trie(spark.createDataFrame(turnless, SCHEMA)).collect()} == brute([r[:4] for r in turnless])
    assert prefixtrie.trie(df.limit(0)).count() == 0


def test_names_tell_prefixes_apart():
    seen = {}
    for a in range(2):
        for n in range(12):
            names = prefixtrie.Names()
            for i in range(n):
                names.add(bytes([i % 2 + a]))
            assert seen.setdefault(names.name, (a if n else 0, n)) == (a if n else 0, n)
