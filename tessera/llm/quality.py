"""Quality rules by weak supervision, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

SPACE = r"[\x20\x09-\x0D]+"

#: Rules: (name, vote, condition).  Vote 0 says bad, 1 says good; where the condition fails, the rule abstains.
RULES = (
    ("symbols", 0, "n_symbols > 0.05 * word_chars"),
    ("repeats", 0, "n_repeat_words > 0.15 * n_words"),
    ("lines", 0, "n_dup_lines > 0.3 * n_lines"),
    ("capitals", 0, "n_upper > 0.3 * word_chars"),
    ("shouts", 0, "n_bangs > 0.3 * n_words"),
    ("letters", 0, "n_letters < 0.75 * word_chars"),
    ("word_length", 0, "word_chars > 15 * n_words or word_chars < 2 * n_words"),
    ("prose", 1, "n_letters >= 0.9 * word_chars and n_symbols <= 0.01 * word_chars and n_upper <= 0.1 * word_chars"),
    ("fresh", 1, "n_repeat_words = 0 and n_dup_lines = 0"),
)
#: How much likelier a vote is, at least, on the texts it speaks for, and at most.
LEAST_RATIO, MOST_RATIO = {0: 8.0, 1: 1.2}, {0: 1000.0, 1: 5.0}


def measures(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts per row of ``docs`` (doc_id, text), with the columns ``carry``.  Windows of five words are told apart by 64-bit hashes."""
    t = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", "text", F.struct(*carry).alias("row") if carry else F.lit(0).alias("row"))
    out = docs.select("doc_id", "row", t.alias("t"), F.filter(F.split(t, SPACE), lambda x: x != "").alias("w"))
    out = out.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_words", F.size("w").cast("long")).withColumn("joined", F.array_join("w", ""))
    out = out.select(
        "doc_id", "row", "n_words", F.length("joined").cast("long").alias("word_chars"), F.size("lines").cast("long").alias("n_lines"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("joined", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        F.length(F.regexp_replace("joined", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    out = out.withColumn("g", F.expr("if(n_words >= 5, transform(sequence(1, cast(n_words as int) - 4), i -> xxhash64(h[i-1], h[i], h[i+1], h[i+2], h[i+3])), cast(array() as array<bigint>))")).drop("h")
    out = out.withColumn("p", F.expr("if(size(array_distinct(g)) < size(g), sort_array(transform(g, (x, i) -> struct(x, i))), null)")).drop("g")
    again = "transform(filter(transform(p, (x, i) -> struct(x.i as at, ((i > 0 and p[greatest(i - 1, 0)].x = x.x) or (i + 1 < size(p) and p[least(i + 1, size(p) - 1)].x = x.x)) as twice)), y -> y.twice), y -> y.at)"
    out = out.withColumn("q", F.expr(f"if(p is null, null, sort_array({again}))")).drop("p")
    return out.withColumn("n_repeat_words", F.expr("if(q is null, 0L, aggregate(q, named_struct('n', 0L, 'end', 0), (s, x) -> named_struct('n', s.n + (x + 5 - greatest(x, s.end)), 'end', x + 5)).n)").cast("long")).drop("q")


def votes(rules: tuple = RULES) -> list[Column]:
    """Whether each rule votes."""
    return [F.coalesce(F.expr(when), F.lit(False)).alias(f"v_{name}") for name, _, when in rules]


def learn(patterns: DataFrame, rules: tuple = RULES, rounds: int = 12) -> tuple[float, list[float]]:
    """(share of bad texts, per rule how much likelier its vote is on a bad text than on a good one).

    ``patterns`` has the votes and their count: at most 2 ** rules rows, however
    many texts.  Each round of expectation-maximisation is one aggregation to a
    single row.  A rule's accuracy is held to its declared side.
    """
    prior, ratio = 0.1, [20.0 if side == 0 else 0.5 for _, side, _ in rules]
    for _ in range(rounds):
        n, bad = F.col("n"), posterior(prior, ratio, rules)
        sums = [F.sum(n), F.sum(n * bad)]
        for name, *_ in rules:
            sums += [F.sum(F.when(F.col(f"v_{name}"), n * bad).otherwise(0.0)), F.sum(F.when(F.col(f"v_{name}"), n * (1 - bad)).otherwise(0.0))]
        got = patterns.agg(*sums).first()
        if not got[0]:
            break
        every, wrong = got[0], got[1]
        prior = round(min(0.5, (wrong + 1) / (every + 10)), 9)
        ratio = []
        for k, (_, side, _) in enumerate(rules):
            r = ((got[2 + 2 * k] + 0.1) / (wrong + 1)) / ((got[3 + 2 * k] + 0.1) / (every - wrong + 1))
            up = min(MOST_RATIO[side], max(LEAST_RATIO[side], r if side == 0 else 1 / r))
            ratio.append(round(up if side == 0 else 1 / up, 9))
    return prior, ratio


def posterior(prior: float, ratio: list[float], rules: tuple = RULES) -> Column:
    """Probability that a text is bad, given the votes cast; an abstention says nothing."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for (name, *_), r in zip(rules, ratio):
        odds = odds + F.when(F.col(f"v_{name}"), math.log(r)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, carry: tuple[str, ...] = (), rules: tuple = RULES) -> DataFrame:
    """The measures and verdicts of judge(), with the columns ``carry`` of each row in the struct ``row``."""
    made = cut(measures(docs, carry))
    made = made.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    made = made.select("*", *votes(rules))
    names = [f"v_{r[0]}" for r in rules]
    patterns = cut(made.groupBy(*names).agg(F.count("*").alias("n")))
    prior, ratio = learn(patterns, rules)
    made = made.withColumn("p_good", F.round(1 - posterior(prior, ratio, rules), 9))
    return made.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def judge(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Measures, base_failed, p_good and kept per row of ``docs`` (doc_id, text; other columns are not read).

    A null text has no words.  base_failed texts are not kept; of the rest, those
    with a posterior quality of at least one half are.  Each row of a repeated
    doc_id is judged alone; doc_id may be null.
    """
    return judged(docs, (), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def kept_rows(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, all columns; the texts travel with their verdicts, so no join brings them together."""
    names = tuple(docs.columns)
    return judged(docs, names, rules).where("kept").select(*[F.col("row")[c].alias(c) for c in names])
