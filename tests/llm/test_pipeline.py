"""The corpus pipeline, stage by stage, against plain Python."""

import hashlib
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_near import brute_docs  # noqa: E402
from test_text import WORD, brute_quality, brute_targets, own_encoding  # noqa: E402

from tessera.llm.store import cut  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [{r.doc_id: r for r in docs.collect()}]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, frames[-1], SF))
        assert set(out.columns) == set(docs.columns)
        frames.append(out)
        seen.append({r.doc_id: r for r in out.collect()})
    raw, good, lines, near, _ = seen
    assert set(good) <= {i for i, r in raw.items() if not brute_quality(r.text)[5]} and all(good[i] == raw[i] for i in good)
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert {i for i in clean if not brute_quality(raw[i].text)[5]} <= set(good)
    assert all(lines[i].text == good[i].text or len(lines[i].text) < len(good[i].text) for i in lines)
    want = brute_docs([(i, r.text) for i, r in lines.items()], 5, 80)
    assert set(near) == {i for i, (_, _, kept) in want.items() if kept}
    sizes, taken = Counter(), Counter()
    for r in near.values():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    mixed = frames[4].collect()
    for r in mixed:
        taken[r.source] += len(WORD.findall(r.text or ""))
    target = brute_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    enc = own_encoding()
    last = corpus_pipeline.STAGES[-1][1](spark, frames[4], SF).collect()
    ids = [enc.encode_ordinary(r.text or "") for r in mixed]
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in last) == Counter((r.doc_id, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for r, x in zip(mixed, ids))
