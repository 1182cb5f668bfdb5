import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm

SF = "/root/testdata/sf0.01"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER).decode())


def base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of rows (doc_id, text), counted plainly."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    seen = Counter(t for i, text in rows if not held(i) for t in [*words_of(text), None])
    n, v = sum(seen.values()), len(seen)
    out = []
    for i, text in rows:
        tokens = [*words_of(text), None]
        out.append((i, held(i), len(tokens), sum(t in seen for t in tokens), n, sum(math.log10((seen[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)))
    return out


def ran(df):
    return [tuple(r) for r in lm.score(df, F.crc32(F.col("doc_id").cast("string")) % 10 == 0).collect()]


def test_counts_and_base_scores(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r[0]: r for r in ran(df)}
    want = base([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert len(got) == len(want)
    for w in want:
        assert got[w[0]][:5] == w[:5]
        assert got[w[0]][5] == pytest.approx(w[5], rel=1e-9)
    held = [r for r in got.values() if r[1]]
    # bits a byte of unseen texts; the frequencies of their bytes take about 4.2
    assert -sum(r[6] for r in held) / math.log10(2) / sum(r[7] for r in held) < 2.4
    assert all(r[8] == pytest.approx(-r[6] / math.log10(2) / r[7]) for r in held)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "One two  THREE"), (4, "One two  THREE"), (None, "é one"), (5, "w" * 200000), (6, "a " * 50000), (50, "unseen words"), (7, "\x00 \x1f ")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, n int")
    got = sorted(ran(df), key=lambda r: (str(r[0]), r[7]))
    want = sorted(base(rows), key=lambda r: (str(r[0]), r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])
    assert all(r[6] < 0 and math.isfinite(r[6]) for r in got)
    assert got[4][6] == got[5][6] or got[3][6] == got[4][6]
    assert ran(df.limit(0)) == []
    assert [r[4] for r in ran(df.where("doc_id = 50"))] == [r[4] for r in base([(50, "unseen words")])]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    units = Counter(u for r in docs for u in lm.UNIT.findall((r.text or "").encode().lower() + b"\xff"))
    rows = {}
    for u, n in units.items():
        rows.setdefault(u[:-1], {})[u[-1]] = n
    schema = "word binary, n long, " + ", ".join(f"n{g} long" for g in lm.GAPS)
    words = spark.createDataFrame([(bytearray(w), sum(n.values()), *(n.get(g) for g in lm.GAPS)) for w, n in rows.items()], schema)
    tables, weights, refined = lm.fit(words)
    return lm.Mixer(tables.value, weights.astype(np.float32), refined), tables.value, units


def chances(mixer, units):
    data = np.frombuffer(b"".join(units), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(u) for u in units])))
    first = np.zeros(len(data), bool)
    first[at[:-1]] = True
    return np.add.reduceat(mixer.logs_of(data, *lm.contexts(data, first)), at[:-1])


def test_tables_count_every_bit(model):
    _, tables, units = model
    # the first bit of a unit has one context: all units meet there
    ones = sum(n for u, n in units.items() if u[0] & 128)
    zeros = sum(units.values()) - ones
    slot, bit, _ = next(lm.slots(np.frombuffer(b"a", np.uint8), lm.contexts(np.frombuffer(b"a", np.uint8), np.array([True]))[0]))
    for s in slot[:, 0]:
        n0, n1 = tables[s].tolist()
        assert n1 / (n0 + n1) == pytest.approx(ones / (ones + zeros), rel=0.01, abs=1e-3)


def test_next_bytes_add_up_to_one(model):
    mixer, _, _ = model
    for start in (b"", b"th", b"xqz"):
        longer = chances(mixer, [start + bytes((b,)) for b in range(256)])
        own = chances(mixer, [start])[0] if start else 0.0
        assert (10 ** (longer - own)).sum() == pytest.approx(1, abs=1e-5)


def test_chance_of_a_unit_bit_by_bit(model):
    """The score of a unit from the tables, weights and refinement, one bit at a time."""
    mixer, tables, _ = model
    for unit in (b"the ", b"qq\n", "é".encode() + b"\xff"):
        data = np.frombuffer(unit, np.uint8)
        first = np.arange(len(data)) == 0
        h, place = lm.contexts(data, first)
        found = list(lm.slots(data, h))
        total = 0.0
        for k, byte in enumerate(unit):
            for b in range(8):
                bit, before = byte >> (7 - b) & 1, (1 << b) | (byte >> (8 - b))
                counts = [tables[s].tolist() for s in found[b][0][:, k]]
                assert found[b][1][k] == bit and found[b][2][k] == before
                x = [math.log((n1 + 0.4) / (n0 + 0.4)) for n0, n1 in counts] + [0.25]
                gate = (min(int(math.log2(sum(counts[-1]) + 1)), 11) * 7 + int(place[k])) * 8 + b
                logit = max(-11, min(11, sum(w * v for w, v in zip(mixer.weights[gate].tolist(), x))))
                p = (1 / (1 + math.exp(-logit)) + mixer.refined[before, round((logit + 11) * 32 / 22)]) / 2
                total += math.log10(p if bit else 1 - p)
        assert chances(mixer, [unit])[0] == pytest.approx(total, rel=1e-3)


def test_a_text_in_its_order():
    rng = np.random.default_rng(2)
    chance = np.log10(rng.dirichlet(np.ones(6)))
    texts = [[0, 0, 3, 0, 5, 3], [2], [1] * 40]
    ids, counts = zip(*(np.unique(t, return_counts=True) for t in texts))
    got = lm.adapted(chance[np.concatenate(ids)], np.concatenate(counts), np.cumsum([0] + [len(i) for i in ids[:-1]]))
    for text, value in zip(texts, got):
        own, total = {}, 0.0
        for k, u in enumerate(text):
            total += math.log10((lm.URN * 10 ** chance[u] + own.get(u, 0)) / (lm.URN + k))
            own[u] = own.get(u, 0) + 1
        assert value == pytest.approx(total, rel=1e-9)


def test_contexts_cross_units():
    """The first bytes of a unit have the contexts of the text, not only of their unit."""
    text = b"a the  cat \n sat\tx\xff"
    data = np.frombuffer(text, np.uint8)
    units = lm.UNIT.findall(text)
    at = np.concatenate(([0], np.cumsum([len(u) for u in units])))
    heads = lm.heads_of(lm.ends_of(data, at), np.array([0]))
    whole, _ = lm.contexts(data, np.arange(len(data)) == 0)
    first = np.zeros(len(data), bool)
    first[at[:-1]] = True
    inside, _ = lm.contexts(data, first)
    for k, (head, unit) in enumerate(zip(heads, units)):
        edges = lm.HeadEdges(np.array([head]), np.ones(1))
        assert bytes(edges.data) == unit[: lm.REACH]
        for p in range(len(edges.data)):
            b = at[k] + p
            assert (edges.h[: lm.REACH, p] == whole[: lm.REACH, b]).all() and edges.place[p] == p
            assert edges.h[lm.ORDERS, p] == inside[lm.ORDERS, b]
            # two more bytes of the context are the text's where the head has them
            for order in range(lm.REACH, lm.ORDERS):
                assert order >= lm.REACH + p or edges.h[order, p] == whole[order, b]


def test_score_follows_the_order_of_a_text(spark):
    rng = np.random.default_rng(4)
    pairs = [("red", "fox"), ("blue", "whale"), ("grey", "owl"), ("tiny", "ant")]
    texts = [" ".join(" ".join(pairs[k]) for k in rng.integers(0, 4, 60)) for _ in range(40)]
    one = "red fox blue whale grey owl tiny ant"
    other = "fox red whale blue owl grey ant tiny"
    rows = [(i, t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10] + [(i, t) for i in range(1000, 1100) if not zlib.crc32(str(i).encode()) % 10 for t in (one, other)]
    got = {}
    for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.crc32(F.col("doc_id").cast("string")) % 10 == 0).where("held_out").collect():
        got.setdefault(r.doc_id, []).append(r.score)
    for a, b in got.values():
        assert abs(a - b) > 1


def test_a_text_unit_by_unit():
    rng = np.random.default_rng(3)
    ids, texts = rng.integers(0, 9, 50), np.array([0, 20, 21])
    chance = np.log10(rng.uniform(0.01, 0.5, 50))
    got = lm.adapted(chance, np.ones(50, np.int64), texts, lm.times_before(ids, texts))
    for lo, hi, value in zip(texts, [20, 21, 50], got):
        own, total = Counter(), 0.0
        for k, i in enumerate(range(lo, hi)):
            total += math.log10((lm.URN * 10 ** chance[i] + own[ids[i]]) / (lm.URN + k))
            own[ids[i]] += 1
        assert value == pytest.approx(total, rel=1e-9)
