import collections
import hashlib
import random
import re

import pytest

from tessera.llm import langid, lines, secrets, toxicity

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))
    return (*(sum(k == x for _, k, _ in out) for x in range(3)), hashlib.sha256(base.encode()).hexdigest(), base)


def check_secrets(rows, out):
    want = collections.Counter((i, *brute_secrets(t)[:4]) for i, t in rows)
    assert collections.Counter(tuple(r)[:5] for r in out) == want
    for r in out:
        own = brute_secrets(dict(rows)[r.doc_id])[4]
        assert set(filter(None, own.split(","))) <= set(r.spans.split(","))


def test_secrets(docs):
    check_secrets([(r.doc_id, r.text) for r in docs.collect()], secrets.digests(docs).collect())


def test_secrets_edges(spark):
    key, hx = "AKIA" + "A1" * 8, "0123456789abcdef" * 2
    rows = [(1, None), (2, ""), (3, f"é😀 Token = '{hx}' {key}x"), (4, "token=token=abcdefgh PASSWD:\"short\""), (5, f"api_key:{key} apikey : 12345678 ſecret=abcdefghij toKen=abcdefghij"), (6, hx * 4000), (7, "AKIAABC " + "AKIA" + "B" * 11 + " AKIA" + "B" * 12), (None, "-----BEGIN RSA PRIVATE KEY-----"), (8, "secret\x20\x20=\x20=x secret : 'a/b+c_d.e='"), (8, "secret\x20\x20=\x20=x secret : 'a/b+c_d.e='")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    check_secrets(rows, secrets.digests(df).collect())
    assert secrets.digests(df.limit(0)).count() == 0


def test_trigram_queries():
    got = {kind: secrets.mandatory(p) for kind, p, *_ in secrets.RULES}
    assert got["hex"] == [] and got["access"] == [[frozenset({b"aki", b"kia"})]]
    assert len(got["assign"][0]) == 6 and frozenset({b"tok", b"oke", b"ken"}) in got["assign"][0]
    assert secrets.mandatory("ab") == [] and secrets.mandatory("(abc)?x") == [] and secrets.mandatory("a.*bcde") == [[frozenset({b"bcd", b"cde"})]]


def test_language(docs):
    got = langid.identify(docs, docs.where("crc32(cast(doc_id as string)) % 3 <> 1")).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got)


def test_language_edges(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "123 !?", "en"), (6, "the " * 50000, None), (7, "日本語", None), (None, "katze", "de"), (8, "a", None), (8, "a", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.identify(df, df).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6)] == ["en", "de", "und", "und", "und", "en"]
    assert langid.identify(df, df).count() == 10 and langid.identify(df.limit(0), df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df, df.limit(0)).collect()} == {"und"}


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    labelled = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id")
    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, labelled.where("crc32(cast(doc_id as string)) % 4 <> 2")).collect()}
    held = [(score[r.doc_id], r.toxic) for r in labelled.where("crc32(cast(doc_id as string)) % 4 = 2").collect()]
    assert len(score) == docs.count() and auc(held) > 0.95
    assert sum((s >= 0.3) == bool(y) for s, y in held) >= 0.97 * len(held)


def test_toxicity_learns_pairs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice("lorem ipsum dolor sit amet consectetur".split()) for _ in range(5)] + ["awful"] * a + ["folk"] * b
        rows.append((i, " ".join(words), int(a != b)))  # no additive weights tell these apart
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(df, df.where("doc_id % 3 > 0")).collect()}
    assert auc([(got[i], y) for i, _, y in rows if i % 3 == 0]) > 0.9


def test_toxicity_edges(spark):
    rows = [(1, "bad idiot", 1), (2, None, 0), (3, "", None), (4, "x " * 50000, 0), (None, "idiot", 1), (5, "dup", 0), (5, "dup", 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, toxic int, score string")
    out = toxicity.toxicity(df, df).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in toxicity.toxicity(df, df.limit(0)).collect()} == {0.5} and toxicity.toxicity(df.limit(0), df).count() == 0


def normal(line):
    return tuple(re.findall(rb"[a-z\x80-\xff]+", line.encode().lower()))


def test_lines(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = lines.dedup_lines(docs).collect()
    assert len(out) == len(rows)
    seen, kept = set(), collections.Counter()
    for r in sorted(out):
        own = (rows[r.doc_id] or "").split("\n")
        assert r.n_removed <= r.n_lines and len(r.text.split("\n") if r.n_removed < r.n_lines else []) == r.n_lines - r.n_removed
        left = r.text.split("\n") if r.n_removed < r.n_lines else []
        it = iter(own)
        assert all(any(x == y for y in it) for x in left)
        for x in left:
            if normal(x):
                kept[normal(x)] += 1
        seen.update(filter(None, map(normal, own)))
    assert max(kept.values()) == 1  # equal lines stay once; test_lines.py says which others go


def test_lines_edges(spark):
    base = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    near = base.replace("wordaa", "wordab")
    rows = [(1, base + "\nsecond line here"), (2, "x y z\n" + near), (3, None), (4, ""), (5, "SECOND, line 12 here!\nown words only"), (None, base), (6, "---\n---\n123"), (7, base), (7, base), (8, "tail " * 70000)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, source string, n_lines int")
    got = {(r.doc_id, r.text): (r.n_lines, r.n_removed) for r in lines.dedup_lines(df).collect()}
    assert got == {(1, base + "\nsecond line here"): (2, 0), (2, "x y z"): (2, 1), (3, None): (0, 0), (4, ""): (1, 0), (5, "own words only"): (2, 1), (None, base): (1, 0), (6, "---\n---\n123"): (3, 0), (7, ""): (1, 1), (8, "tail " * 70000): (1, 0)}
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_edit_distance():
    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abé", k=rng.randrange(12))) for _ in range(2))
        assert lines.edit_distance(a, b) == brute(a, b), (a, b)
        assert lines.words_apart(list(a), list(b)) <= brute(a, b), (a, b)
    a = "".join(rng.choices("abcdef ", k=300))
    b = a[:100] + "xyz" + a[110:250] + "q" + a[250:]
    assert lines.edit_distance(a, b) == brute(a, b)


def test_toxicity_factors_count():
    """On the table itself factors are not zero, and scores without them are others."""
    import numpy as np
    import pyarrow.parquet as pq

    docs, labels = (pq.read_table(f"/root/testdata/sf0.1/{t}.parquet").to_pydict() for t in ("documents", "labels"))
    text = dict(zip(docs["doc_id"], docs["text"]))
    rows = [(text[i], t) for i, t in zip(labels["doc_id"], labels["toxic"]) if t is not None and text.get(i)][:3000]
    y = np.array([t for _, t in rows], float)
    slot, bounds = toxicity.terms([t for t, _ in rows])
    value, count = np.unique(slot[y[np.repeat(np.arange(len(y)), np.diff(bounds))] == 1], return_counts=True)
    known = value[count >= toxicity.LEAST_SHARE * y.sum()]
    bias, own, w, v = toxicity.fit(*toxicity.among(slot, bounds, known), known, y)
    places = toxicity.among(slot, bounds, own)
    whole, linear = (toxicity.raw_scores(*places, bias, w, f) for f in (v, 0 * v))
    assert (np.abs(v).max(1) > 0.01).mean() > 0.5
    assert np.abs(whole - linear).max() > 0.1
