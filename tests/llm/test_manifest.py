import hashlib
import zlib

import pytest

from tessera.llm.manifest import manifest

SF = "/root/testdata/sf0.01"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(top, [siblings of each node per level as (left, right)])."""
    above, where, steps = list(nodes), list(range(len(nodes))), [[] for _ in nodes]
    while len(above) > 1:
        for i, w in enumerate(where):
            run = above[w - w % 3 : w - w % 3 + 3]
            steps[i].append((run[: w % 3], run[w % 3 + 1 :]))
        where = [w // 3 for w in where]
        above = [h("".join(above[i : i + 3])) for i in range(0, len(above), 3)]
    return above[0], steps


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) to the result, node by node."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    made = {s: tree([leaf(*r) for r in by[s]]) for s in sources}
    root, over = tree([made[s][0] for s in sources])
    out = []
    for s, above in zip(sources, over):
        for r, steps in zip(by[s], made[s][1]):
            steps, own = steps + above, leaf(*r)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = leaf(*r[:4], r[4].replace("\n", "")) if bad else own
            for left, right in steps:
                node = h("".join([*left, node, *right]))
            out.append((r[0], own, made[s][0], root, h("".join("".join(a + b) for a, b in steps)), node, node == root))
    return sorted(out, key=str)


def ran(df, *args):
    return sorted((tuple(r) for r in manifest(df, *args).collect()), key=str)


@pytest.mark.parametrize("args", [(), (2, 40), (1, 3)])
def test_manifest_matches_brute_force(spark, args):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400" if args else "true")
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = ran(df, *args)
    assert got == brute(rows)
    assert 0 < sum(not r[6] for r in got) < len(got)


@pytest.mark.parametrize("args", [(), (1, 2)])
def test_edges(spark, args):
    rows = [(None, None, None, None, None), (1, None, "é", 3, "a\nb"), (2, "b", None, 1, ""), (2, "b", None, 1, ""), (2, "b", "x", 1, "\n"), (3, "", "en", -4, "x" * 300000 + "\n"), (4, "é", "en", 1, "y\n"), (5, "z", "en", 1, "y\n\n")]
    rows += [(10 + k, f"s{k}", "en", 1, "t\n") for k in range(9)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, root string")
    assert ran(df, *args) == brute(rows)
    one = df.where("doc_id = 3")
    assert ran(one, *args) == brute(rows[5:6])
    same = [(7, "q", "en", 1, "a\nb")] * 50
    assert ran(spark.createDataFrame(same, df.select("doc_id", "source", "lang", "n_chars", "text").schema), *args) == brute(same)
    assert ran(df.limit(0), *args) == []
