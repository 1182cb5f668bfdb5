"""The stages that pick rows, on rows without doc_id and rows that repeat one."""

from collections import Counter

import corpus_pipeline

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_null_and_repeated_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(None, one), (None, two), (1, one), (2, one), (2, two), (3, three), (3, three), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], KINDS)
    near = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    # (2, one) repeats 1, though (2, two) stays
    assert near == Counter([(None, one), (None, two), (1, one), (2, two), (3, three), (3, three), (4, None)])


def test_mix_takes_each_row_once(spark):
    rows = [(i, " ".join(f"{c}{k}" for k in range(10)), "en", "web", 30) for c, i in zip("abcdef", [7, 7, 7, None, None, 8])]
    docs = spark.createDataFrame(rows, KINDS)
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    # one source: its target is its own size, so each row comes once
    assert Counter(map(tuple, mixed)) == Counter(rows)
