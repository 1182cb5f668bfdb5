"""Language, toxicity and quality verdicts against plain loops over texts."""

import math
import re

import numpy as np
import pytest
from test_text import WORD

from tessera.llm import langid, quality, toxicity
from tessera.llm import textvec as tv

SF = "/root/testdata/sf0.01"


def trigrams(text):
    """Letters lower-cased, every stretch of other characters one space, of (text, with a space at both ends)."""
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    s = re.sub(" +", " ", s)
    return [s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " "]


def bundle(text, dim=langid.DIM):
    out = np.zeros(dim)
    for gram in trigrams(text):
        a, b, c = langid.letter_vectors(np.array([ord(x) for x in gram]), dim).astype(float)
        for k in range(dim):
            out[k] += a[k - 2] * b[k - 1] * c[k]
    return out


def test_language_by_loops(spark):
    rows = [(1, "The cat, the hat", "en"), (2, "le chat et la souris", "fr"), (3, "Der Hund ÜBER alles", "de"), (4, "the dog 12 times", "en"), (5, "over la", None), (6, "12", None), (7, None, None), (8, "le over the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, df.where("lang is not null")).collect()}
    own: dict = {}
    for _, t, lang in rows:
        if lang:
            own[lang] = own.get(lang, 0) + bundle(t)
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert got[i] == ("und", 0.0)
            continue
        v = bundle(t)
        cos = {lang: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for lang, p in own.items()}
        best = max(sorted(cos), key=cos.get)
        assert got[i][0] == best and got[i][1] == pytest.approx(max(0.0, min(1.0, cos[best])), abs=1e-5)


def test_toxicity_score_pair_by_pair(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    some = [(r.text, labels[r.doc_id]) for r in docs if r.doc_id in labels]
    slot, bounds = toxicity.terms([t for t, _ in some])
    toxic = np.array([y for _, y in some], float)
    known = np.unique(slot)
    at, own = toxicity.among(slot, bounds, known)
    bias, keep, w, v = toxicity.fit(at, own, known, toxic)
    assert len(keep) and np.abs(v).max() > 0
    place = {s: k for k, s in enumerate(keep.tolist())}
    model = (bias, keep, w, v)
    import pyarrow as pa

    texts = [t for t, _ in some][:40] + ["", None]
    (out,) = toxicity._scored([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])], model)
    for text, score in zip(texts, out.column(1).to_pylist()):
        one, _ = toxicity.terms([text])
        mine = [place[s] for s in set(one.tolist()) if s in place]
        raw = bias + sum(w[k] for k in mine)
        for a in range(len(mine)):
            for b in range(a):
                raw += sum(x * y for x, y in zip(v[mine[a]], v[mine[b]]))
        assert score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, raw)))), abs=1e-9)


def votes_of(t):
    """Whether each rule of quality.RULES votes, from plain counts."""
    t = t or ""
    w = WORD.findall(t)
    n, chars, joined = len(w), sum(map(len, w)), "".join(w)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams: dict = {}
    for i in range(n - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeats = len({k for at in grams.values() if len(at) > 1 for i in at for k in range(i, i + 5)})
    symbols, again = len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    upper, letters = len(re.findall("[A-Z]", joined)), sum(c.isalpha() for c in joined)
    return (
        symbols > 0.05 * chars, repeats > 0.15 * n, again > 0.3 * len(lines), upper > 0.3 * chars, t.count("!") > 0.3 * n, letters < 0.75 * chars, chars > 15 * n or chars < 2 * n,
        letters >= 0.9 * chars and symbols <= 0.01 * chars and upper <= 0.1 * chars, repeats == 0 and again == 0,
    )


def test_quality_by_plain_em(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    votes = {i: votes_of(t) for i, t in texts.items()}
    sides = [side for _, side, _ in quality.RULES]
    prior, ratio = 0.1, [20.0 if s == 0 else 0.5 for s in sides]

    def bad(v):
        odds = math.log(prior / (1 - prior)) + sum(math.log(r) for r, cast in zip(ratio, v) if cast)
        return 1 / (1 + math.exp(-odds))

    for _ in range(12):
        p = {i: bad(v) for i, v in votes.items()}
        n, wrong = len(p), sum(p.values())
        new = []
        for k, side in enumerate(sides):
            yes, no = sum(p[i] for i in p if votes[i][k]), sum(1 - p[i] for i in p if votes[i][k])
            r = ((yes + 0.1) / (wrong + 1)) / ((no + 0.1) / (n - wrong + 1))
            up = r if side == 0 else 1 / r
            up = min(quality.MOST_RATIO[side], max(quality.LEAST_RATIO[side], up))
            new.append(up if side == 0 else 1 / up)
        prior, ratio = min(0.5, (wrong + 1) / (n + 10)), new
    for r in quality.judge(docs).collect():
        good = 1 - bad(votes[r.doc_id])
        assert r.p_good == pytest.approx(good, abs=1e-6), r.doc_id
        assert r.kept == (not r.base_failed and good >= 0.5)
