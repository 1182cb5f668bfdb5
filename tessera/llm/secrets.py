"""Secret scans through a trigram inverted index."""

from __future__ import annotations

import re
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as tv

#: Rules: (kind, pattern, group whose length counts, least length).  The first three are the base.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]+=*", 0, 27),
)
BASE = 3
#: Strings a part of a pattern may spell, kept apart while there are at most so many.
SPELLINGS = 16


def _fold(code: int) -> str:
    """A character as the texts' bytes are folded: A-Z to lower case."""
    return chr(code + 32) if 0x41 <= code <= 0x5A else chr(code)


def _spell(node, most: int = SPELLINGS) -> set[str] | None:
    """All lower-case strings that a parsed pattern can match, or None."""
    out = {""}
    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            more = {_fold(arg)}
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
            more = {_fold(v) for _, v in arg}
        elif name == "SUBPATTERN":
            more = _spell(arg[3])
        elif name == "BRANCH":
            parts = [_spell(x) for x in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif name == "MAX_REPEAT" and arg[1] == 1:
            inner = _spell(arg[2])
            more = None if inner is None else inner | ({""} if arg[0] == 0 else set())
        else:
            more = None
        if more is None or len(out) * len(more) > most:
            return None
        out = {a + b for a in out for b in more}
    return out


def mandatory(pattern: str) -> list[list[frozenset[bytes]]]:
    """Boolean trigram query of a pattern: AND of ORs of trigram sets that must all occur; empty if none is mandatory.

    The longest stretches of the pattern with few spellings are taken apart;
    each spelling needs all its trigrams, and one spelling of each stretch must
    be there.
    """
    clauses, run = [], []

    def close():
        spelled = _spell(run) if run else None
        if spelled and all(len(s.encode()) >= 3 for s in spelled):
            clauses.append([frozenset(s.encode()[i : i + 3] for i in range(len(s.encode()) - 2)) for s in sorted(spelled)])
        run.clear()

    for item in syntax.parse(pattern):
        if _spell([item]) is None:
            close()
        else:
            run.append(item)
            if _spell(run) is None:
                run.pop()
                close()
                run.append(item)
    close()
    return clauses


class Scanner:
    def __init__(self, rules: tuple = RULES):
        self.rules = [(kind, re.compile(p, re.ASCII), group, least, mandatory(p)) for kind, p, group, least in rules]
        grams = sorted({g for *_, clauses in self.rules for c in clauses for s in c for g in s})
        self.gram = {g: i for i, g in enumerate(grams)}
        self.code = np.full(1 << 24, -1, np.int16)
        for g, i in self.gram.items():
            self.code[int.from_bytes(g, "big")] = i

    def postings(self, texts: list) -> list[set[int]]:
        """For each needed trigram, the texts that hold it."""
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        data = tv.lower_table()[np.frombuffer(b"\n".join(raw) + b"\n\n\n", np.uint8)].astype(np.int32)
        found = self.code[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        at = np.flatnonzero(found >= 0)
        owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), at, side="right")
        pair = np.unique(found[at].astype(np.int64) * len(texts) + owner)
        out: list[set[int]] = [set() for _ in self.gram]
        for p in pair.tolist():
            out[p // len(texts)].add(p % len(texts))
        return out

    def scan(self, texts: list) -> list[list[tuple[int, int, int]]]:
        """Spans (start, kind, end) of each text, sorted, in code points."""
        lists = self.postings(texts)
        out: list[list] = [[] for _ in texts]
        for k, (_, found, group, least, clauses) in enumerate(self.rules):
            here = set(range(len(texts)))
            for clause in clauses:
                here &= set().union(*(set.intersection(*(lists[self.gram[g]] for g in spelled)) for spelled in clause))
            for i in here:
                for m in found.finditer(texts[i] or ""):
                    if m.end(group) - m.start(group) >= least:
                        out[i].append((m.start(), k, m.end()))
        return [sorted(x) for x in out]


def _spans(batches, rules: tuple):
    own = Scanner(rules)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for lo, hi in tv.chunks(texts):
            got = [[{"kind": rules[k][0], "start": a, "end": b} for a, k, b in x] for x in own.scan(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(got, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "spans"])


def scan(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(doc_id, spans array<kind, start, end>) per row of ``docs`` (doc_id, text; others are not read).

    A task indexes the trigrams of its texts, intersects the postings of each
    rule's Boolean trigram query and runs the pattern on what is left; rules
    without mandatory trigrams run on every text.  Matches are leftmost and do
    not overlap within a kind; those whose counted group is too short are
    dropped.  A null text has no spans; repeated rows are scanned alone.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda it: _spans(it, rules), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    from pyspark.sql import functions as F

    line = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [kind for kind, *_ in rules[:BASE]]
    counts = [F.size(F.filter("spans", (lambda kind: lambda s: s["kind"] == kind)(kind))).cast("long").alias(f"n_{kind}") for kind in base]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return scan(docs, rules).select("doc_id", *counts, F.sha2(line(own), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))

