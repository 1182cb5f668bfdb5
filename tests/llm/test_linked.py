import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm.graph import linked


def brute(rows, near):
    top = {i: i for _, i, _ in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, i, v in rows:
        for m, j, w in rows:
            if k == m and i < j and near(v, w):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: root(i) for _, i, _ in rows}


def ran(spark, rows, near, block):
    def links(cells):
        def meet(part: pd.DataFrame) -> pd.DataFrame:
            ids, side, v = (part[c].to_numpy() for c in ("id", "side", "v"))
            out = [(ids[x], ids[y]) for x in range(len(part)) for y in range(x + 1, len(part)) if (side[x] == 0 or side[x] != side[y]) and near(v[x], v[y])]
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        return cells.groupBy("cell").applyInPandas(meet, "a long, b long")

    df = spark.createDataFrame(rows, "key long, id long, v double")
    found = {r.id: r.component_id for r in linked(df, "key", links, block).collect()}
    return {i: found.get(i, i) for _, i, _ in rows}


@pytest.mark.parametrize("case", ["alike", "chain", "apart", "mixed", "several"])
def test_all_links_of_a_large_key(spark, case):
    rng = np.random.default_rng(6)
    near = lambda a, b: abs(a - b) <= 1
    values = {
        "alike": [0.5] * 150,
        "chain": rng.permutation(150).astype(float).tolist(),
        "apart": (np.arange(90) * 5.0).tolist(),
        "mixed": [0.0] * 100 + [7.0, 8.0, 50.0, 1.0, 9.0] + (np.arange(30) * 0.9 + 100).tolist(),
        "several": sum(([v] * 40 for v in (0.0, 10.0, 20.0)), []) + [5.0, 5.5, 30.0],
    }[case]
    rows = [(9, 1000 + int(i), float(v)) for i, v in zip(rng.permutation(len(values)), values)]
    rows += [(k, i, 0.0) for k, i in ((3, 1), (3, 2), (4, 5))] + [(4, rows[0][1], 0.5), (3, rows[1][1], 3.0)]
    assert ran(spark, rows, near, 8) == brute(rows, near)
