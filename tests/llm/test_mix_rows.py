from collections import Counter

from test_text import brute_targets

from tessera.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, rank string, rest int"


def row(i, text, source, lang="x"):
    return i, text, source, lang, "r", 1


def test_equal_rows_share_a_source(spark):
    """A source of equal rows without id is taken to the word, whichever of them it is."""
    rows = [row(None, "a b c", "big")] * 3001 + [row(7, "a b", "big")] * 500 + [row(k, "w " * (k % 9), "s") for k in range(200)] + [row(None, None, None), row(1, "", None), row(2, "one", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df, carry=("lang", "rest")).collect()
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").split())
    target = brute_targets(sizes)
    assert len(out) == len(rows)
    by = {size: s for s, size in sizes.items()}
    taken = Counter()
    for r in out:
        assert r.source_size in by and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size + r.part and r.lang == "x"
        taken[by[r.source_size]] += r.taken
    assert all(taken[s] == round(target[s]) for s in sizes)
    # at most one row of a source is taken in part
    assert all(sum(0 < r.part < r.size for r in out if r.source_size == n) <= 1 for n in by)
    again = mixing.mix(df.repartition(7), carry=("lang", "rest")).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_equal_rows_that_differ_in_what_comes_along(spark):
    rows = [row(5, "a b c d e f g", "one", str(k)) for k in range(40)] + [row(6, "z " * 400, "two")]
    df = spark.createDataFrame(rows, SCHEMA)
    first, again = ({(r.lang, r.taken) for r in mixing.mix(d, carry=("lang",)).collect()} for d in (df, df.orderBy("lang", ascending=False)))
    assert first == again
