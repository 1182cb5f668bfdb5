"""Byte-level BPE by corpus-level merge replay."""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import itertools
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as tv

#: Words and stretches whose ids a Python worker remembers, and characters of text that are one corpus for a replay.
REMEMBERED, CORPUS = 250_000, 1 << 23
#: The pattern whose texts can be cut at blanks before its matches are sought.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted pairs left * 2**20 + right, rank of each): every way to join two tokens to a third."""
    found = {}
    for token, r in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                found[left << 20 | right] = r
    keys = np.fromiter(found, np.int64, len(found))
    order = np.argsort(keys)
    return keys[order], np.fromiter(found.values(), np.int64, len(found))[order]


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of ``x``, sorted; sorts it in place."""
    x.sort()
    some = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=some[1:])
    return x[some]


def replay(words: list[bytes], byte_ids: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, bounds of each word).

    All words are one corpus: ``where`` leads from a merge's rank to the places
    of its pairs.  Ranks come off a heap, lowest first; a merge joins all its
    places at once, of overlapping ones the left, and enters only the pairs
    beside each joined one.
    """
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    ends = np.cumsum([len(w) for w in words])
    own = byte_ids[data].astype(np.int32)
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    nxt[ends - 1] = n  # nothing follows a word's last byte
    prv[np.concatenate(([0], ends[:-1]))] = -1
    own = np.append(own, np.int32(-1))
    keys, of = pairs
    live = np.full(n + 1, -1, np.int32)  # rank of the pair that starts here
    where: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Look up the pairs that start at ``at`` and file them by rank."""
        right = own[nxt[at]]
        want = own[at].astype(np.int64) << 20 | right
        k = np.searchsorted(keys, want)
        k[k == len(keys)] = 0
        r = np.where((keys[k] == want) & (right >= 0), of[k], -1)
        live[at] = r
        at, r = at[r >= 0], r[r >= 0]
        if not len(at):
            return
        both = distinct(r.astype(np.int64) << 32 | at)
        at, r = both.astype(np.int32), both >> 32
        cut = np.flatnonzero(np.diff(r)) + 1
        for lo, hi, rank in zip([0, *cut.tolist()], [*cut.tolist(), len(r)], r[np.concatenate(([0], cut))].tolist()):
            if rank not in where:
                where[rank] = []
                heapq.heappush(heap, rank)
            where[rank].append(at[lo:hi])

    if n:
        for lo in range(0, n, CORPUS >> 3):
            enter(np.arange(lo, min(lo + (CORPUS >> 3), n), dtype=np.int32))
    while heap:
        r = heapq.heappop(heap)
        lists = where.pop(r)
        at = lists[0] if len(lists) == 1 else distinct(np.concatenate(lists))
        at = at[live[at] == r]
        if len(at) > 1 and (nxt[at[:-1]] == at[1:]).any():
            keep, last = np.ones(len(at), bool), -1
            for k, (x, y) in enumerate(zip(at.tolist(), nxt[at].tolist())):
                if x == last:
                    keep[k] = False  # its first half is taken
                else:
                    last = y
            at = at[keep]
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        own[at], own[gone], live[gone] = r, -2, -1
        nxt[at] = after
        inside = after < n
        prv[after[inside]] = at[inside]
        before = prv[at]
        enter(np.concatenate((at, before[before >= 0])))
    kept = own[:-1] >= 0
    return own[:-1][kept], np.concatenate(([0], np.cumsum(kept)[ends - 1])) if n else np.zeros(len(words) + 1, np.int64)


class Codec:
    """Encodes and decodes with the ranks of a vocabulary file; remembers the words and stretches of text it met."""

    def __init__(self, lines: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.table = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            self.table[r] = token
        self.decimals = list(map(str, range(len(self.table))))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = pair_table(self.ranks)
        self.find = regex.compile(pattern).findall
        self.split = self.stretches if pattern == SPACED else self.find
        self.loose = regex.compile(r" (?!\S)").search
        #: The decimals of a stretch's ids, joined by blanks, and the bytes that the ids decode to.
        self.known: dict[str, tuple[str, bytes]] = {}

    def stretches(self, text: str) -> list[str]:
        """``text`` cut before each blank that no white space follows.

        SPACED begins a match at every such blank: only its white space could reach
        one, and leaves the last of it where more follows.  So the matches of
        the stretches are those of the text.
        """
        if "\0" in text:
            return self.find(text)
        out = text.replace(" ", "\0 ").split("\0")
        if self.loose(text):
            parts, out = out, [out[0]]
            for x in parts[1:]:
                if self.loose(x):
                    out[-1] += x
                else:
                    out.append(x)
        return out if out[0] else out[1:]

    def learn(self, new: set[str]) -> None:
        """Remember stretches: their words are encoded, together, and decoded again."""
        known, several, words = self.known, [], set()
        for x in new:
            own = self.find(x)
            words.update(own)
            if len(own) > 1:
                several.append((x, own))
        long = []
        for w in words - known.keys():
            b = w.encode("utf-8", "surrogatepass")
            r = self.ranks.get(b)
            if r is None:
                long.append((w, b))
            else:
                known[w] = self.decimals[r], self.table[r]
        if long:
            ids, bounds = replay([b for _, b in long], self.byte_ids, self.pairs)
            ids, bounds = ids.tolist(), bounds.tolist()
            numbers, raw = list(map(self.decimals.__getitem__, ids)), list(map(self.table.__getitem__, ids))
            for (w, _), lo, hi in zip(long, bounds, bounds[1:]):
                known[w] = " ".join(numbers[lo:hi]), b"".join(raw[lo:hi])
        for x, own in several:
            numbers, raw = zip(*map(known.__getitem__, own))
            known[x] = " ".join(numbers), b"".join(raw)

    def encode(self, texts: list) -> Iterator[tuple[str, bytes]]:
        """The decimals of each text's ids, joined by blanks, and the bytes that the ids decode to."""
        # texts are cut twice, as all their stretches take more memory than what is remembered
        met = set(itertools.chain.from_iterable(self.split(t) for t in texts if t))
        new = met - self.known.keys()
        if new and len(self.known) + len(new) > REMEMBERED:
            # of what is remembered, this much is met again
            self.known = {x: self.known[x] for x in met - new}
        if new:
            self.learn(new)
        del met, new
        for t in texts:
            numbers, raw = zip(*map(self.known.__getitem__, self.split(t))) if t else ((), ())
            yield " ".join(numbers), b"".join(raw)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


def codec(lines: bytes, pattern: str) -> Codec:
    """One codec per Python worker and vocabulary, so that tasks share the words met.

    What it remembers stays out of the collector's rounds: it holds no cycles,
    and there are hundreds of thousands of entries.
    """
    gc.freeze()
    gc.set_threshold(200_000, 50, 100)
    held = sys.modules.setdefault("_tessera_held", types.ModuleType("_tessera_held")).__dict__
    key = hashlib.sha256(lines + pattern.encode()).digest()
    if key not in held:
        held[key] = Codec(lines, pattern)
    return held[key]


def _digests(batches, lines: bytes, pattern: str):
    own = codec(lines, pattern)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for lo, hi in tv.chunks(texts, CORPUS):
            rows = ((numbers.count(" ") + (numbers != ""), hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()) for numbers, raw in own.encode(texts[lo:hi]))
            n, a, b = zip(*rows)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encoded(batches, lines: bytes, pattern: str):
    own = codec(lines, pattern)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for lo, hi in tv.chunks(texts, CORPUS):
            got = [list(map(int, numbers.split())) for numbers, _ in own.encode(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _decoded(batches, lines: bytes, pattern: str):
    own = codec(lines, pattern)
    for batch in batches:
        texts = [None if x is None else own.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def vocabulary(path: str) -> bytes:
    """A vocabulary file, read on the driver and sent with the job: about a megabyte, whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) per row of ``docs`` (doc_id, text; others are not read).  A null text has no ids."""
    lines = vocabulary(path)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _encoded(it, lines, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""
    lines = vocabulary(path)
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decoded(it, lines, pattern), "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row: encoded, and decoded again from the ids.

    Null and empty texts have no tokens and the digests of nothing.  Each row of
    a repeated doc_id is encoded alone.
    """
    lines = vocabulary(path)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _digests(it, lines, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
