import json

import duckdb

from tessera.llm import chat

SF = "/root/testdata/sf0.01"


def test_links(spark):
    call = lambda tool, i, args, **more: json.dumps({"tool": tool, "id": i, "arguments": args, **more})
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", call("ask", "a", {"turn": 1, "question": "q\n\"é", }, after=["b"])),
        (1, 2, "tool", json.dumps({"id": "b", "content": {"z": 1, "a": [1, 2.5, None]}})),
        (1, 3, "assistant", call("ask", "b", {"question": 7})),
        (1, 4, "tool", json.dumps({"id": "zz", "content": "lost"})),
        (1, 5, "assistant", call("ask", "b", {"question": "x", "turn": 2, "w": 1})),
        (1, 6, "assistant", call("nope", "c", {}, after=["d"])),
        (1, 7, "assistant", call("ask", "d", None, after=["c"])),
        (2, 0, "assistant", "{broken"), (2, 1, "tool", None), (2, 2, None, "x"), (None, None, "assistant", call("ask", None, {"question": "x", "turn": 1})), (3, 0, "assistant", "x" * 200000), (3, 0, "assistant", "x" * 200000),
    ]
    df = spark.createDataFrame([(*r, "n") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    out = chat.link_tools(df).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): r for r in out}
    assert [got[1, t].status for t in range(8)] == ["plain", "unanswered", "linked", "answered", "orphan", "duplicate", "unanswered", "unanswered"]
    assert got[1, 3].n_results == 1
    assert got[1, 2].order_turn == 3 and got[1, 2].order_step == 1 and got[1, 1].order_level == 1 and got[1, 3].order_level == 0
    assert got[1, 6].order_level == -1 and got[1, 7].order_level == -1
    assert got[1, 1].errors == "" and got[1, 3].errors == "missing turn; type of question" and got[1, 5].errors == "extra w" and got[1, 6].errors == "unknown tool"
    assert got[1, 7].errors == "missing question; missing turn"
    assert got[1, 1].json == '{"arguments":{"question":"q\\n\\"é","turn":1},"call_id":"a","role":"assistant","tool":"ask","turn":1}'
    assert got[1, 2].json == '{"call_id":"b","content":{"a":[1,2.5,null],"z":1},"role":"tool","turn":2}'
    assert all(r.status == "plain" for k, r in got.items() if k[0] == 2)
    assert chat.link_tools(df.limit(0)).count() == 0


def test_query_matches_sql(spark):
    from tessera.llm.queries import op7_sql, op7_tool_links

    got = sorted(map(tuple, op7_tool_links(spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.execute(op7_sql())
    names = [d[0] for d in want.description]
    assert names == op7_tool_links(spark, SF).columns
    assert got == sorted(want.fetchall())
