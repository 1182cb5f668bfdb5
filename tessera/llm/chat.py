"""Chat formatting: tool calls linked to results, ordered, validated and written as canonical JSON.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

#: Tools and their arguments: name -> (type as schema_of_variant names it, whether it must be there).
TOOLS = {
    "ask": {"question": ("STRING", True), "turn": ("BIGINT", True)},
    "setup": {"prompt": ("STRING", True), "turn": ("BIGINT", True)},
}
#: More than any chain is long: where weights stop growing, as they do only in cycles.
FAR = 1 << 40


def tool_log(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as a tool log: a user turn calls ``ask`` (after the user turn two before), a system
    turn calls ``setup``, and an assistant turn is the result of the turn before it."""
    at = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    call = lambda tool, key: F.to_json(F.struct(F.lit(tool).alias("tool"), at(0).alias("id"), F.array(at(2)).alias("after"), F.struct(F.col("text").alias(key), F.col("turn")).alias("arguments")))
    result = F.to_json(F.struct(at(1).alias("id"), F.col("text").alias("content")))
    role, text = F.col("role"), F.col("text")
    return conversations.select("conv_id", "turn", F.when(role.isin("user", "system"), "assistant").when(role == "assistant", "tool").otherwise(role).alias("role"), F.when(role == "user", call("ask", "question")).when(role == "system", call("setup", "prompt")).when(role == "assistant", result).otherwise(text).alias("text"))


def problems(tools: dict) -> Column:
    """What is wrong with a call's arguments (variant ``args``, JSON text ``args_text``), sorted; empty if nothing."""
    found = [F.when(~F.coalesce(F.col("tool").isin(list(tools)), F.lit(False)), "unknown tool")]
    for tool, spec in tools.items():
        own = F.col("tool") == tool
        for arg, (kind, needed) in spec.items():
            value = F.try_variant_get("args", f"$.{arg}", "variant")
            is_kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
            missing = value.isNull() | (is_kind == "VOID")
            if needed:
                found.append(F.when(own & missing, f"missing {arg}"))
            found.append(F.when(own & ~missing & (is_kind != kind), f"type of {arg}"))
        extra = F.array_except(F.coalesce(F.json_object_keys("args_text"), F.array().cast("array<string>")), F.array(*map(F.lit, spec)))
        found.append(F.when(own & (F.size(extra) > 0), F.concat(F.lit("extra "), F.array_join(F.sort_array(extra), " "))))
    return F.array_join(F.sort_array(F.array_compact(F.array(*found))), "; ")


def levels(calls: DataFrame, waits: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the longest chain of ``waits`` (conv_id, call_id, dep) before a call, -1 in or behind a cycle.

    A call's level is the largest of a constant (dep null) and of w + the level
    of each dep.  In each round, a dep that has at most one dep itself is
    replaced by what it stands for, so chains halve; of the others, those that
    wait for no open call close.  A round that closes none leaves only cycles.
    """
    known = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("d"))
    none = F.lit(None).cast("string")
    state = cut(calls.select("conv_id", "call_id", none.alias("dep"), F.lit(0).cast("long").alias("w")).unionByName(
        waits.join(known, (waits.conv_id == known.c) & (waits.dep == known.d)).select("conv_id", "call_id", "dep", F.lit(1).cast("long").alias("w"))
    ))
    seen = None
    while True:
        opened = state.where("dep is not null")
        now = opened.agg(F.count_distinct("conv_id", "call_id")).first()[0]
        if not now or now == seen:
            break
        seen = now
        each = state.groupBy("conv_id", "call_id").agg(F.count("dep").alias("n"), F.max(F.when(F.col("dep").isNull(), F.col("w"))).alias("least"), F.max("dep").alias("to"), F.max(F.when(F.col("dep").isNotNull(), F.col("w"))).alias("far"))
        single = each.where("n < 2").select(F.col("conv_id").alias("c"), F.col("call_id").alias("d"), "n", "least", "to", "far")
        moved = opened.join(single, (opened.conv_id == single.c) & (opened.dep == single.d), "left")
        pair = lambda dep, w: F.struct(dep.alias("dep"), F.least(w, F.lit(FAR)).alias("w"))
        through = F.when(F.col("n").isNull(), F.array(pair(F.col("dep"), F.col("w")))).when(F.col("n") == 0, F.array(pair(none, F.col("w") + F.col("least"))))
        through = through.otherwise(F.array(pair(none, F.col("w") + F.col("least")), pair(F.col("to"), F.col("w") + F.col("far"))))
        moved = moved.select("conv_id", "call_id", F.explode(through).alias("x")).select("conv_id", "call_id", "x.dep", "x.w")
        state = cut(state.where("dep is null").unionByName(moved).groupBy("conv_id", "call_id", "dep").agg(F.max("w").alias("w")).select("conv_id", "call_id", "dep", "w"))
    return state.groupBy("conv_id", "call_id").agg(F.when(F.count("dep") > 0, -1).otherwise(F.max("w")).alias("level"))


def link_tools(messages: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """Messages (conv_id, turn, role, text; other columns are not read), one row each, linked, ordered, checked and serialised.

    An assistant text that is a JSON object with ``tool`` is a call (``id``,
    ``arguments``, optional ``after``: ids to wait for); a tool text that is a JSON
    object with ``id`` is a result; all else, null texts and broken JSON too, is
    plain.  Calls and results are hash-joined by (conv_id, id).  Of calls that
    share an id the one with the smallest turn is linked (of one turn, the one
    with the smallest ``after``, though all of that turn count as the call), the
    others are ``duplicate``; results without a call are ``orphan``.  (order_level,
    order_turn, order_step, turn) sorts a conversation so that every result
    follows its call and every call what it waits for; order_level is -1 in
    or behind a cycle.  ``json`` has sorted keys and no blanks.  Null
    conv_id, turn or id link with nothing.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    parsed = F.when(F.col("role").isin("assistant", "tool") & F.col("text").rlike(r"^\s*\{"), F.try_parse_json("text"))
    rows = rows.withColumn("v", parsed)
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    rows = rows.withColumn("kind", F.when((F.col("role") == "assistant") & get("$.tool").isNotNull(), "call").when((F.col("role") == "tool") & get("$.id").isNotNull(), "result").otherwise("plain"))
    rows = rows.withColumn("call_id", F.when(F.col("kind") != "plain", get("$.id"))).withColumn("tool", F.when(F.col("kind") == "call", get("$.tool")))
    rows = rows.withColumn("args", F.when(F.col("kind") == "call", get("$.arguments", "variant"))).withColumn("args_text", F.to_json("args"))
    rows = rows.withColumn("errors", F.when(F.col("kind") == "call", problems(tools)).otherwise(""))
    content = F.when(F.col("kind") == "result", F.coalesce(get("$.content", "variant"), F.to_variant_object(F.struct(F.lit(None).cast("string").alias("none")))))
    body = F.struct(F.when(F.col("kind") == "call", F.col("args")).alias("arguments"), content.alias("content"), "call_id", "role", F.when(F.col("kind") == "plain", F.col("text")).alias("text"), "tool", "turn")
    rows = cut(rows.withColumn("json", F.to_json(F.try_parse_json(F.to_json(body)))).withColumn("after", F.when(F.col("kind") == "call", get("$.after", "array<string>"))).drop("v", "args", "args_text", "text"))
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & F.col("turn").isNotNull()
    calls = cut(rows.where((F.col("kind") == "call") & known).groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn").alias("call_turn"), "after")).alias("x")).select("conv_id", "call_id", "x.*"))
    answers = rows.where((F.col("kind") == "result") & known).groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"))
    waits = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("dep")).where("dep <> call_id")
    linked = calls.select("conv_id", "call_id", "call_turn").join(levels(calls, waits), ["conv_id", "call_id"]).join(answers, ["conv_id", "call_id"], "left")
    out = rows.join(linked, ["conv_id", "call_id"], "left")
    has = F.col("call_turn").isNotNull()
    status = F.when(F.col("kind") == "plain", "plain").when(F.col("kind") == "result", F.when(has, "linked").otherwise("orphan")).when(has & (F.col("turn") > F.col("call_turn")), "duplicate").when(F.col("n_results") > 0, "answered").otherwise("unanswered")
    level = F.coalesce("level", F.lit(0))
    return out.select("conv_id", "turn", "role", "kind", "call_id", "tool", status.alias("status"), F.coalesce("n_results", F.lit(0)).alias("n_results"), level.cast("int").alias("order_level"), F.coalesce("call_turn", "turn").alias("order_turn"), F.when(F.col("kind") == "result", 1).otherwise(0).alias("order_step"), "errors", "json")
