import base64
import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessera.llm import bpe, mixing, quality
from tessera.llm import textvec as tv

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def brute_targets(sizes, weights=(1, 2, 3), limit=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        rate = (total - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if w[s] * rate > limit * sizes[s]}
        if not over:
            return target | {s: w[s] * rate for s in free}
        target |= {s: limit * sizes[s] for s in over}
        free -= over
    return target


def check_mix(rows, out):
    sizes, source = collections.Counter(), {}
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
        source[i] = s, len(WORD.findall(t or ""))
    target, taken = brute_targets(sizes), collections.Counter()
    assert len(out) == len(rows)
    for r in out:
        s, n = source[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s]) and r.target == pytest.approx(target[s], rel=1e-12)
        assert 0 <= r.taken <= 3 * n and r.taken == r.copies * n + r.part
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_mix(spark, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    first = mixing.mix(docs).collect()
    check_mix(rows, first)
    assert sorted(first) == sorted(mixing.mix(docs.repartition(5)).collect())


def test_mix_edges(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "a " * 1000, None), (5, "b", "y"), (6, "c d", "é")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    check_mix(rows, mixing.mix(df).collect())
    assert mixing.mix(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(df.where("doc_id = 2")).collect()] == [0]


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def test_quality(spark, docs, texts):
    out = quality.judge(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        assert tuple(r[1:7]) == brute_quality(texts[r.doc_id]), r.doc_id
    kept = {r.doc_id: r.kept for r in out}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good, bad = ([kept[i] for i in truth if truth[i] == q] for q in (1, 0))
    print("kept of good", sum(good) / len(good), "of bad", sum(bad) / len(bad))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.15


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e a b c d e"), (4, "x " * 30000), (5, "a\n\na\n \na"), (None, "\x0b\x1c\x85 é # * $ % & | < >"), (6, "a b c d e f a b c d e g")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, n_words int, w int")
    for r in quality.judge(df).collect():
        assert tuple(r[1:7]) == brute_quality(dict(rows)[r.doc_id])
    assert quality.judge(df.limit(0)).count() == 0


def own_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_bpe(rows, out):
    enc = own_encoding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_bpe(spark, docs, texts):
    check_bpe(list(texts.items()), bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect())


def test_bpe_edges(spark):
    odd = "".join(map(chr, [*range(1, 0x180), 0x1680, 0x180E, *range(0x2000, 0x2030), 0x3000, 0xFEFF, 0x1F600, 0x10FFFF]))
    rows = [(1, None), (2, ""), (3, odd), (4, odd[::-1]), (5, " a  b   c\n\n d\t\te \r\n"), (6, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 300), (7, "don't we'll I'VE <|endoftext|>"), (8, "x\x1c \x1fy\x85z 12345 ³²¹"), (None, "日本語テキスト ไทย हिन्दी"), (9, "same"), (9, "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    check_bpe(rows, bpe.digests(df, PATH, public_tokenizers.PATTERN).collect())
    back = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert bpe.digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_word_hashes_are_sums_over_their_bytes():
    """Hashes of words byte by byte, wherever a word lies."""
    texts = ["One two", None, "", "  a\tbcdefghij\n" * 50, "é" * 3000 + " end"]
    hashes, bounds, begun = tv.hash_words(texts, tv.space_table(), begin=4)
    words = [[w.encode().lower() for w in (t or "").split()] for t in texts]
    value, ones = [int(x) for x in tv.byte_values()], (1 << 64) - 1
    own = lambda w: sum(value[b] * pow(int(tv.ODD), k, 1 << 64) for k, b in enumerate(w)) & ones
    flat = [w for ws in words for w in ws]
    assert hashes.tolist() == [int(tv.mix(np.array([(own(w) + len(w)) & ones], np.uint64))[0]) for w in flat]
    assert begun.tolist() == [int(tv.mix(np.array([own(w[:4]) ^ int(tv.ODD)], np.uint64))[0]) for w in flat]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
