"""Levels of long chains, of calls that wait for several others, and of cycles."""

import json
import random

from tessera.llm import chat


def brute(after):
    level = {}
    while True:
        new = {c: 1 + max((level[d] for d in deps), default=-1) for c, deps in after.items() if c not in level and all(d in level for d in deps)}
        if not new:
            return {c: level.get(c, -1) for c in after}
        level |= new


def test_long_chains(spark):
    rng = random.Random(5)
    after = {f"a{i}": [f"a{i - 1}"] if i else [] for i in range(300)}
    after |= {f"m{i}": [f"m{j}" for j in {rng.randrange(i), max(0, i - 1 - rng.randrange(2))}] if i else ["a150"] for i in range(12)}
    after |= {f"r{i}": [f"r{(i + 1) % 5}"] for i in range(5)} | {"behind": ["r0", "a7"], "next": ["behind"]}
    rows = [(1, t, "assistant", json.dumps({"tool": "ask", "id": c, "arguments": {}, "after": [*deps, "nowhere", c]})) for t, (c, deps) in enumerate(after.items())]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r.order_level for r in chat.link_tools(df).collect()}
    assert got == brute(after) and got["a299"] == 299 and got["next"] == -1
