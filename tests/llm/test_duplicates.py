"""Near-duplicates of texts and vectors, components and neighbours against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tavola.llm import minhash, nndescent, projections
from tavola.llm.components import components
from tavola.operators import components as module
from tavola.session import cut


def smallest(nodes, links):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(9, i) for i in range(200, 260)] + [(3, 3)]
    links += [(rng.randrange(300, 420), rng.randrange(300, 420)) for _ in range(90)]
    rng.shuffle(links)
    got = dict(components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect())
    assert got == smallest({n for p in links for n in p}, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(4, 4), (None, 5)], "a long, b long")).collect() == [(4, 4)]


def shuffled(n):
    order = list(range(n))
    random.Random(n).shuffle(order)
    return order


CHAINS = {
    "ascending": [(i, i + 1) for i in range(999)],
    "descending": [(2000 - i, 1999 - i) for i in range(999)],
    "shuffled": list(zip(shuffled(1000), shuffled(1000)[1:])),
    "star": [(10_000, i) for i in range(999)],
}


def test_forest():
    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 500, 300), rng.integers(0, 500, 300)
    want = smallest(set(u) | set(v), zip(u, v))
    got = dict(zip(*module.forest(u, v)))
    assert {n: got.get(n, n) for n in want} == want


@pytest.mark.parametrize("shape", CHAINS)
def test_rounds_are_few(spark, monkeypatch, shape):
    links = CHAINS[shape]
    monkeypatch.setattr(module, "thinned", lambda batches: batches)  # rounds alone, without forests of partitions
    rounds = []
    hooks = module._hooks
    monkeypatch.setattr(module, "_hooks", lambda *a: rounds.append(1) or hooks(*a))
    got = dict(components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect())
    assert got == smallest({n for p in links for n in p}, links)
    assert len(rounds) <= 10  # the nodes at least halve


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def texts():
    rng = random.Random(2)

    def word():
        return "".join(rng.choice("abcdefgh") for _ in range(4))

    out = []
    passage = [word() for _ in range(60)]
    for _ in range(60):  # a passage that many share, in texts otherwise apart
        out.append([word() for _ in range(15)] + passage + [word() for _ in range(15)])
    base = [word() for _ in range(80)]
    for _ in range(70):  # a crowd around one text, some of it too far from each other
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(80)] = word()
        out.append(copy)
    for _ in range(30):
        one = [word() for _ in range(rng.randrange(1, 60))]
        out += [one, one[: max(1, len(one) - rng.randrange(0, 6))]]
    return [" ".join(w) for w in out] + ["A b  C d\te F", "a B c D e f", "one two", "ONE two", "one", "", "  \n", None]


def test_minhash_equals_brute_force(spark):
    made = list(enumerate(texts()))
    sets = {i: shingles(t) for i, t in made}
    links = [
        (a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = smallest(sets, links)
    df = spark.createDataFrame([(i, t, i % 3) for i, t in made], "doc_id long, text string, component_id int")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df.repartition(3)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert minhash.deduplicate(df).count() == len(set(want.values()))


def test_minhash_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (4, None)], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (4, 0, 4, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert minhash.deduplicate(df).count() == 3


def test_pruning_bound():
    least = minhash.least_matches()
    assert least == sorted(least) and len(least) == minhash.HASHES // minhash.BATCH and 60 < least[-1] < 96


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=150, length=16):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, length))
    for i in range(0, n, 3):
        x[i] = x[(i * 7) % 30] + rng.standard_normal(length) * 0.12
    x[1], x[2] = x[0], x[0] * 3
    return [(i, [float(np.float32(v)) for v in r], int(i % 2)) for i, r in enumerate(x)]


def test_projections_equal_brute_force(spark):
    good = vectors()
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [float("inf")] + [1.0] * 15, 1), (504, [1.0] * 16, None), (505, [1.0], 1), (506, [2.0], 1), (507, [None] * 16, 0), (508, [], 0)]
    df = spark.createDataFrame(good + odd, VECTORS).withColumn("node", F.lit("x"))
    x = np.array([v for _, v, _ in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([a[2] for a in good])[:, None] == np.array([a[2] for a in good])[None, :])
    np.fill_diagonal(near, False)
    links = list(zip(*np.nonzero(near)))
    want = smallest(range(len(good)), links)
    got = {r["vec_id"]: r for r in projections.near_duplicates(df.repartition(3)).collect()}
    assert {i: got[i]["n_links"] for i in range(len(good))} == dict(enumerate(near.sum(1)))
    assert {i: got[i]["component_id"] for i in range(len(good))} == want
    for i in (500, 501, 502, 503, 504, 507, 508):
        assert tuple(got[i]) == (i, 0, i, True)
    assert got[505]["n_links"] == 1 and got[506]["component_id"] == 505
    assert projections.near_duplicates(df.limit(0)).count() == 0


def test_projections_in_several_blocks(spark, monkeypatch):
    df = spark.createDataFrame(vectors(), VECTORS)
    whole = sorted(projections.near_duplicates(df).collect())
    monkeypatch.setattr(projections, "BLOCK", 20)
    assert sorted(projections.near_duplicates(df).collect()) == whole


def test_window_counts():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((5, 30)), rng.standard_normal((5, 40))
    want = (np.abs(a[:, :, None] - b[:, None, :]) <= 0.5).sum(0)
    assert (projections.collisions(a, b, 0.5) == want).all()


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((600, 24)).astype(np.float32)
    x[40:45] = x[0]  # copies
    made = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1020, [0.0] * 24), (None, [1.0] * 24), (1040, [1.0])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>").withColumn("node", F.lit(1))
    got = {}
    for r in nndescent.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    y = x.astype(float)
    hits = 0
    assert set(got) == set(range(0, 600, 20))
    for q, found in got.items():
        sim = y @ y[q]
        sim[q] = -np.inf
        best = np.lexsort((np.arange(600), -sim))[:20]
        hits += len(set(best.tolist()) & {v for v, _ in found})
        assert len(found) == 20 and all(abs(s - sim[v]) < 1e-9 for v, s in found)
        assert [v for v, _ in found] == [v for v, _ in sorted(found, key=lambda p: (-p[1], p[0]))]
    assert hits >= 0.9 * 20 * len(got)


def test_graph_rounds_go_on_until_settled(spark, monkeypatch):
    x = np.random.default_rng(3).standard_normal((500, 12)).astype(np.float32)
    rounds = []
    meet = nndescent.meet
    monkeypatch.setattr(nndescent, "meet", lambda *a: rounds.append(1) or meet(*a))
    monkeypatch.setattr(nndescent, "TREES", 1)
    monkeypatch.setattr(nndescent, "LEAF", 8)
    q, s = nndescent.packed([r.tolist() for r in x])
    nodes = spark.createDataFrame([(i, bytearray(b), float(v)) for i, (b, v) in enumerate(zip(q, s))], "node long, q binary, s float")
    nodes = cut(nodes)
    graph = nndescent.build(nodes, 12, len(x), 1)
    assert len(rounds) > 3 and graph.groupBy("a").count().where(f"count > {nndescent.NEIGHBOURS}").isEmpty()


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(0, 100, 20)], "vec_id long, embedding array<float>")
    got = nndescent.nearest(df).where("query_id = 20").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [80, 60, 40, 0]
    assert nndescent.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("split", [4096, 20])
def test_crowd_around_the_threshold(spark, monkeypatch, split):
    """A crowd whose members lie around the threshold to each other, in many small blocks."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    base = [rng.choice(words) for _ in range(90)]
    made = []
    for n in range(150):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(90)] = rng.choice(words)
        made.append((n, " ".join(copy)))
    sets = {i: shingles(t) for i, t in made}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = smallest(sets, links)
    assert 3 < len(set(want.values())) < 140
    monkeypatch.setattr(minhash, "SPLIT", split)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 20_000)
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == want


def test_a_node_meets_all_queries_that_expand_it_at_once():
    """Rounds of the search score a node's neighbours by one product for all queries, not row by row."""
    import numpy as np
    import pyarrow as pa

    from tavola.llm import nndescent

    rng = np.random.default_rng(3)
    near = [[{"m": 100 * u + i, "q": rng.integers(-127, 128, 8, np.int8).tobytes(), "s": 0.5 + i} for i in range(u + 1)] for u in range(4)]
    asking = [[{"query": 10 * u + i, "floor": 0.0 if i else -np.inf, "qq": rng.integers(-127, 128, 8, np.int8).tobytes(), "qs": 0.25} for i in range(3 - u % 2)] for u in range(4)]
    lists = (
        pa.array(asking, pa.list_(pa.struct({"query": pa.int64(), "floor": pa.float64(), "qq": pa.binary(), "qs": pa.float32()}))),
        pa.array(near, pa.list_(pa.struct({"m": pa.int64(), "q": pa.binary(), "s": pa.float32()}))),
    )
    made = nndescent.nearer.func(*lists).to_pylist()
    for found, some, others in zip(made, asking, near):
        want = {}
        for a in some:
            for b in others:
                sim = a["qs"] * b["s"] * float(np.frombuffer(a["qq"], np.int8).astype(float) @ np.frombuffer(b["q"], np.int8).astype(float))
                if sim > a["floor"]:
                    want[a["query"], b["m"]] = sim
        got = {(r["query"], r["node"]): r["sim"] for r in found}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-5 * max(1, abs(want[k])) for k in want)
    assert len(nndescent.nearer.func(*[x[:0] for x in lists])) == 0
