import hashlib
import math

import numpy as np

from tessera.llm import codes

SF = "/root/testdata/sf0.01"


def brute(rows):
    """codes.compress cell by cell, of rows (vec_id, vector, label)."""
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 16))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[[math.floor(256 * v[p * width + d]) if p * width + d < len(v) else 0 for d in range(width)] for p in range(16)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:64]] for p in range(16)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(2):
        new = []
        for p in range(16):
            own = {}
            for c in cut:
                own.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            new.append([[sum(x) // len(own[k]) for x in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])])
        books = new
    found = [[nearest(c[p], books[p]) for p in range(16)] for c in cut]
    by = {}
    for (_, _, label), f in zip(kept, found):
        by[label] = by.get(label, 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by[label], digest) for (i, _, label), f in zip(kept, found)]


def ran(df):
    return sorted((tuple(r) for r in codes.compress(df).collect()), key=str)


def test_codes_match_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert ran(df) == sorted(brute([(r.vec_id, r.embedding, r.label) for r in df.collect()]), key=str)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    one = [0.5 * k - 3.3 for k in range(20)]
    rows = [(3, one, 1), (3, one, 1), (3, one[::-1], None), (None, one[:7], None), (1, [], 2), (2, None, 1), (4, [nan, 1.0], 1), (5, [inf], 1), (6, [None, 1.0], 1), (7, [-0.001] * 16, 3), (8, [0.25], None)]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "vec_id long, embedding array<float>, label int, code string, n int")
    assert ran(df) == sorted(brute([(i, v and [x if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]), key=str)
    assert ran(df.limit(0)) == []
    many = spark.createDataFrame([(5, [1.0, 2.0], 1)] * 300, "vec_id long, embedding array<float>, label int")
    assert ran(many) == brute([(5, [1.0, 2.0], 1)] * 300)


def test_filter_keeps_the_first_nearest():
    rng = np.random.default_rng(4)
    for entries, spread in ((64, 4), (64, 200), (1, 5), (7, 3)):
        book, x = rng.integers(-spread, spread, (entries, 4)), rng.integers(-2 * spread, 2 * spread, (500, 4))
        entry, apart = codes.Filter(book).nearest(x)
        every = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (entry == every.argmin(1)).all() and (apart == every.min(1)).all()
