import numpy as np
import pytest

from tessera.llm.minhash import near_duplicates
from tessera.llm.vectors import near_vectors

SF = "/root/testdata/sf0.01"


def roots(ids, pairs):
    at = {i: i for i in ids}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}


def brute_docs(rows, width, percent):
    sets = {i: shingle_set(t, width) for i, t in rows}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = set()
    for own in by.values():
        pairs.update((a, b) for a in own for b in own if a < b)
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = roots(sets, links)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_documents_match_brute_force(spark, width, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in near_duplicates(docs, width, percent).collect()}
    assert got == brute_docs([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], width, percent)


def test_document_edges(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One\x0bTWO"), (6, "one two three"), (7, long), (8, long + " x"), (9, "É"), (10, "é"), (None, "one two"), (11, "one two"), (11, "one two")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n_shingles int, key string")
    got = sorted((tuple(r) for r in near_duplicates(docs, 3, 85).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 59998, 7, True), (8, 59999, 7, False), (9, 1, 9, True), (10, 1, 10, True), (None, 1, None, True), (11, 1, 4, False), (11, 1, 4, False)]
    assert got == sorted(want, key=str)
    assert near_duplicates(docs.limit(0), 3, 85).count() == 0


def test_large_near_group(spark):
    rng = np.random.default_rng(3)
    base = [f"word{i}" for i in range(80)]
    rows = []
    for i in range(700):
        w = list(base)
        for k in rng.choice(80, rng.integers(0, 5), replace=False):
            w[k] = f"v{i}x{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in near_duplicates(docs, 3, 85).collect()}
    assert got == brute_docs(rows, 3, 85)


def brute_vectors(rows, least=0.93):
    good = [(i, np.array(v, np.float64), l) for i, v, l in rows if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    n, pairs = {i: 0 for i, _, _ in rows}, []
    by = {}
    for i, v, l in good:
        by.setdefault((l, len(v)), []).append((i, v / np.abs(v).max()))
    for own in by.values():
        x = np.array([v for _, v in own])
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1))):
            pairs.append((own[a][0], own[b][0]))
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    comp = roots(n, pairs)
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


def test_vectors_match_brute_force(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in v.collect()]
    rng = np.random.default_rng(0)
    for k in range(1500):  # one dense group
        rows.append((10000 + k, (np.ones(64) + 0.22 * rng.standard_normal(64)).astype(np.float32).tolist(), 3))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r[0]: tuple(r[1:]) for r in near_vectors(df).collect()}
    want = brute_vectors(rows)
    assert got.keys() == want.keys()
    same = sum(got[i] == want[i] for i in want)
    assert same >= 0.995 * len(want)
    assert sum(g[0] for g in got.values()) >= 0.999 * sum(w[0] for w in want.values())


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, nan], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [], 1), (None, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [-1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = sorted((tuple(r) for r in near_vectors(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12, 13)]
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (11, 2, 1, False), (None, 0, None, True), *alone], key=str)
    assert near_vectors(df.limit(0)).count() == 0


def test_repeated_ids_of_other_content(spark):
    one, two = ([f"{x}{i}" for i in range(60)] for x in "pq")
    near = two[:30] + ["other"] + two[31:]
    rows = [(7, " ".join(one)), (7, " ".join(two)), (8, " ".join(near)), (9, " ".join(one))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicates(docs, 3, 85).collect())
    assert got == [(7, 58, 7, True), (7, 58, 7, True), (8, 58, 7, False), (9, 58, 7, False)]
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, x, 1), (5, y, 2), (5, z, 1), (9, [1.0, 0.01, 0.0], 1), (4, y, 3)]
    got = sorted(tuple(r) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(4, 0, 4, True), (5, 0, 5, True), (5, 0, 5, True), (5, 1, 5, True), (9, 1, 5, False)]


def test_sketch_keeps_all_pairs_within_the_errors():
    from tessera.llm import minhash

    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 16, minhash.COMPONENTS)
    sigs = [a]
    for _ in range(200):
        b = a.copy()
        b[rng.choice(minhash.COMPONENTS, minhash.ERRORS, replace=False)] ^= rng.integers(1, 1 << 16, minhash.ERRORS)
        sigs.append(b)
    import pyarrow as pa

    raw = pa.array([s.astype(np.uint16).tobytes() for s in sigs], pa.binary())
    (out,) = minhash._keys([pa.RecordBatch.from_arrays([pa.array(np.arange(len(sigs))), raw], names=["id", "sig"])])
    keys, ids = out.column(0).to_numpy(), out.column(1).to_numpy()
    first = set(keys[ids == 0].tolist())
    assert all(first & set(keys[ids == i].tolist()) for i in range(1, len(sigs)))
    from tessera.llm.graph import sketches

    _, _, close = minhash.components_apart(*sketches(pa.Table.from_batches([out])))
    row = np.array([np.flatnonzero(ids == i)[0] for i in range(len(sigs))])
    assert close(np.zeros(len(sigs), int), row).all()
