"""Language-model scores: logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textvec as tv
from .store import cut

#: The bytes that end a unit: white space, and END after each text (no byte of UTF-8).
END = 255
GAPS = (9, 10, 11, 12, 13, 32, END)
UNIT = re.compile(rb"[^\x09-\x0d\x20\xff]*[\x09-\x0d\x20\xff]")
#: Bytes of text whose distinct units are looked up together.
BLOCK = 1 << 25
#: Predictors: the last 1 to ORDERS bytes, and all of the unit.  Each has 2^SLOT_BITS slots.
ORDERS, SLOT_BITS = 5, 20
INPUTS, SLOTS = ORDERS + 1, 1 << SLOT_BITS
#: A unit's head, its first REACH bytes, is predicted from the last REACH bytes of the text before it, too; these 2 * REACH bytes make one number.
REACH = 3
BITS, MASK = 8 * REACH, (1 << 8 * REACH) - 1
#: Units of texts that are looked up together.
TOKENS = 1 << 20
#: Added to the counts of a slot; largest count kept; step of the weights, what they start from, and bytes that share a step.
PRIOR, MOST, STEP, START, TOGETHER = 0.4, 60000, 0.02, 0.2, 1 << 13
#: Bytes of words that a task takes together, and slots that travel in a row.
PIECE, CHUNK = 1 << 20, 1 << 16
#: Mixing weights are chosen by how often (in powers of 2, LEVELS of them) the slot of the longest context was met, by the place in the unit, and by the bit.
LEVELS, PLACES, BIAS = 12, ORDERS + 2, 0.25
GATES = LEVELS * PLACES * 8
#: The last refinement: steps of the mixed probability, and what the probability itself weighs against the counts.
STEPS, OWN = 33, 20.0
#: Units of the model's own that a text's units are added to, one by one, as it goes on.
URN = 1000.0


def contexts(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((INPUTS, n) hashes of what comes before each byte in its unit, its place there); ``first`` marks the units' first bytes."""
    n = len(data)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    pos = np.arange(n) - start
    out, h = np.empty((INPUTS, n), np.uint64), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, ORDERS + 1):
            before = np.zeros(n, np.uint64)
            before[k:] = data[: max(n - k, 0)].astype(np.uint64) + np.uint64(1)
            before[pos < k] = 0
            h = h * tv.ODD + before + np.uint64(k)
            out[k - 1] = tv.mix(h)
        power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(pos.max(initial=0)), tv.ODD | np.uint64(1), np.uint64))))
        value = tv.byte_values()[data] * power[pos]
        upto = np.cumsum(value) - value
        out[ORDERS] = tv.mix(upto - upto[start] + pos.astype(np.uint64) * np.uint64(31))
    return out, np.minimum(pos, PLACES - 1)


def slots(data: np.ndarray, h: np.ndarray, table: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per bit, high first: slots of the predictors from ``table`` on, whose contexts are the rows of ``h``, the bits, and the byte's bits so far behind a 1.

    The 15 slots of a half byte lie together, so a half byte touches one place of a predictor's table.
    """
    high, low = (data >> 4).astype(np.uint64), (data & 15).astype(np.int64)
    shift, own = np.uint64(64 - SLOT_BITS + 4), (np.arange(table, table + len(h), dtype=np.int64) << SLOT_BITS)[:, None]
    with np.errstate(over="ignore"):
        for half, base in enumerate((h, tv.mix(h + (high + np.uint64(1)) * tv.ODD))):
            at = ((base >> shift).astype(np.int64) << 4) + own
            value = low if half else high.astype(np.int64)
            for b in range(4):
                node = (1 << b) | (value >> (4 - b))
                so_far = node if not half else ((1 << b) << 4) | (high.astype(np.int64) << b) | (value >> (4 - b))
                yield at + node, (value >> (3 - b)) & 1, so_far


def units_of(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all units, where each starts, its count in training, its row) of rows (word, n9, ...): a unit per gap that has a count."""
    words, rows, units, counts = table.column("word").to_pylist(), [], [], []
    for gap in GAPS:
        own = table.column(f"n{gap}")
        have = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
        rows.append(have)
        counts.append(own.take(pa.array(have)).to_numpy(zero_copy_only=False).astype(np.int64))
        units += [words[i] + bytes((gap,)) for i in have.tolist()]
    size = np.fromiter(map(len, units), np.int64, len(units))
    return np.frombuffer(b"".join(units), np.uint8), np.concatenate(([0], np.cumsum(size))), np.concatenate(counts), np.concatenate(rows)


def ends_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each unit's first and last REACH bytes and how many it has, up to REACH, in one number."""
    n, head, tail = np.diff(at), np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
    for k in range(REACH):
        some = n > k
        head[some] |= data[at[:-1][some] + k].astype(np.int64) << 8 * (REACH - 1 - k)
        tail[some] |= data[at[1:][some] - 1 - k].astype(np.int64) << 8 * k
    return (head << BITS | tail) << 2 | np.minimum(n, REACH)


def heads_of(ends: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For the units of texts in their order: the last REACH bytes of the text before each (0 where it has none) and the unit's first ones, in one number.

    ``texts`` are the texts' first places.  A unit has a byte at least, so REACH units back suffice.
    """

    def before(x: np.ndarray, none: int) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[texts] = none
        return out

    last, width = before(ends >> 2 & MASK, 0), before((ends & 3) * 8, BITS)
    found = last
    for _ in range(REACH - 1):
        found = (last | before(found, 0) << width) & MASK
    return found << BITS | ends >> BITS + 2


def pieces(texts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """(first text, last text) of about TOKENS of the ``n`` units of texts that start at ``texts``."""
    lo, ends = 0, np.append(texts[1:], n)
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, texts[lo] + TOKENS, side="right")))
        yield lo, hi
        lo = hi


class Edges:
    """Bytes with what comes before them: data, contexts h, place in the unit and n, how often they come in training."""

    def __init__(self, data: np.ndarray, h: np.ndarray, place: np.ndarray, n: np.ndarray):
        self.data, self.h, self.place, self.n = data, h, place, n

    def slices(self, size: int, order: np.ndarray | None = None):
        """(data, h, place, n) of ``size`` edges at a time."""
        for lo in range(0, len(self.data), size):
            part = slice(lo, lo + size) if order is None else order[lo : lo + size]
            yield self.data[part], self.h[:, part], self.place[part], self.n[part]

    def logs(self, mixer: Mixer) -> np.ndarray:
        return np.concatenate([np.empty(0), *(mixer.logs_of(data, h, place) for data, h, place, _ in self.slices(1 << 15))])


class UnitEdges(Edges):
    """The distinct bytes of a piece's words, from place ``begin`` of their unit on, by what comes before them in it.

    These contexts lie inside the unit, so units with one beginning share its bytes.
    """

    def __init__(self, table: pa.Table, begin: int):
        self.bytes, self.at, count, self.rows = units_of(table)
        first = np.zeros(len(self.bytes), bool)
        first[self.at[:-1]] = True
        h, place = contexts(self.bytes, first)
        self.own = np.flatnonzero(place >= begin)
        with np.errstate(over="ignore"):
            key = tv.mix(h[ORDERS, self.own] + self.bytes[self.own].astype(np.uint64) * tv.ODD)
        _, some, self.edge = np.unique(key, return_index=True, return_inverse=True)
        n, some = np.bincount(self.edge, np.repeat(count, np.diff(self.at))[self.own], len(some)), self.own[some]
        super().__init__(self.bytes[some], h[:, some], place[some], n)

    def sums(self, mixer: Mixer) -> np.ndarray:
        """log10 probability of each unit's bytes from ``begin`` on."""
        each = np.zeros(len(self.bytes))
        each[self.own] = self.logs(mixer)[self.edge]
        return np.add.reduceat(each, self.at[:-1])


class HeadEdges(Edges):
    """The distinct bytes of heads by what comes before them in the text; ``heads`` are distinct."""

    def __init__(self, heads: np.ndarray, count: np.ndarray):
        self.size, parts, self.parts = len(heads), [], []
        gap = np.isin(np.arange(256), GAPS)
        there = np.ones(len(heads), bool)
        for p in range(REACH):
            upto, same = np.unique(heads[there] >> 8 * (REACH - 1 - p), return_inverse=True)
            back = [upto >> 8 * k & 0xFF for k in range(REACH + p + 1)]
            out, h, unit = np.empty((INPUTS, len(upto)), np.uint64), np.zeros(len(upto), np.uint64), np.zeros(len(upto), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(1, ORDERS + 1):
                    # inside the unit every byte is one, before it 0 is none
                    x = back[k].astype(np.uint64) + np.uint64(1) if k < len(back) else np.zeros(len(upto), np.uint64)
                    if k > p:
                        x[x == 1] = 0
                    h = h * tv.ODD + x + np.uint64(k)
                    out[k - 1] = tv.mix(h)
                power = np.uint64(1)
                for k in range(p, 0, -1):
                    unit += tv.byte_values()[back[k]] * power
                    power *= tv.ODD | np.uint64(1)
                out[ORDERS] = tv.mix(unit + np.uint64(p * 31))
            self.parts.append((np.flatnonzero(there), same))
            parts.append((back[0].astype(np.uint8), out, np.full(len(upto), p), np.bincount(same, count[there], len(upto))))
            there[there] = ~gap[back[0][same]]
        super().__init__(*(np.concatenate(x, -1) for x in zip(*parts)))

    def sums(self, mixer: Mixer) -> np.ndarray:
        """log10 probability of each head."""
        logs, out, lo = self.logs(mixer), np.zeros(self.size), 0
        for rows, same in self.parts:
            n = int(same.max(initial=-1)) + 1
            out[rows] += logs[lo : lo + n][same]
            lo += n
        return out


def edges_in(table: pa.Table, begin: int) -> Edges:
    if "head" in table.column_names:
        return HeadEdges(table.column("head").to_numpy(), table.column("n").to_numpy())
    return UnitEdges(table, begin)


def gathered(batches) -> Iterator[pa.Table]:
    """Batches together up to PIECE bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= PIECE:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _counted(batches, begin: int):
    """(chunk, counts): how often a 0 and a 1 came in CHUNK slots, over the units or heads of a task."""
    held = np.zeros(INPUTS * SLOTS * 2, np.int64)
    for table in gathered(batches):
        edges = edges_in(table, begin)
        for k, h in enumerate(edges.h):
            with np.errstate(over="ignore"):
                key = tv.mix(h + edges.data.astype(np.uint64) * tv.ODD)
            _, some, same = np.unique(key, return_index=True, return_inverse=True)
            n = np.bincount(same, edges.n, len(some)).astype(np.int64)
            for slot, bit, _ in slots(edges.data[some], h[None, some], k):
                np.add.at(held, slot[0] * 2 + bit, n)
    held = held.reshape(-1, CHUNK * 2)
    for c in np.flatnonzero(held.any(1)).tolist():
        kind = np.uint16 if held[c].max() < 1 << 16 else np.int64
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([held[c].astype(kind).tobytes()], pa.binary())], names=["chunk", "counts"])


def _packed(batches):
    """(chunk, counts): the sums of a chunk as two 16-bit numbers a slot; larger ones shrink together."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, raw in zip(*(x.to_pylist() for x in batch.columns)):
            held.setdefault(c, np.zeros(CHUNK * 2, np.int64))
            held[c] += np.frombuffer(raw, np.uint16 if len(raw) == CHUNK * 4 else np.int64)
    for c, n in held.items():
        n = n.reshape(-1, 2).astype(np.float64)
        n = np.minimum(np.ceil(n / np.maximum(1, n.max(1, keepdims=True) / MOST)), MOST).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([n.tobytes()], pa.binary())], names=["chunk", "counts"])


class Mixer:
    """Mixes what the predictors say of a bit: ``tables`` has (n0, n1) of all slots, ``weights`` a row per gate."""

    def __init__(self, tables: np.ndarray, weights: np.ndarray, refined: np.ndarray | None = None):
        self.tables, self.weights, self.refined = tables.view(np.uint32).ravel(), weights, refined
        self.logs = np.log(np.arange(MOST + 1) + PRIOR).astype(np.float32)
        self.levels = np.minimum(np.log2(np.arange(2 * MOST + 1) + 1).astype(np.int64), LEVELS - 1)

    def inputs(self, slot: np.ndarray, place: np.ndarray, b: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(INPUTS + 1, n) logits of a 1, and gates.  ``without`` are the bits themselves if each is to count as not yet seen."""
        n = self.tables[slot]
        n0, n1 = (n & np.uint32(0xFFFF)).astype(np.int32), (n >> np.uint32(16)).astype(np.int32)
        if without is not None:
            n0, n1 = np.maximum(n0 - (1 - without), 0), np.maximum(n1 - without, 0)
        out = np.empty((INPUTS + 1, slot.shape[1]), np.float32)
        out[:INPUTS], out[INPUTS] = self.logs[n1] - self.logs[n0], BIAS
        return out, (self.levels[n0[ORDERS] + n1[ORDERS]] * PLACES + place) * 8 + b

    def chance(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Logits of a 1, mixed."""
        return np.clip((self.weights[gate].T * x).sum(0), -11, 11)

    def logs_of(self, data: np.ndarray, h: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probability of each byte."""
        out = np.zeros(len(data))
        for b, (slot, bit, node) in enumerate(slots(data, h)):
            logit = self.chance(*self.inputs(slot, place, b))
            p = (1 / (1 + np.exp(-logit)) + self.refined[node, bucket(logit)]) / 2
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out


def bucket(logit: np.ndarray) -> np.ndarray:
    return np.rint((logit + 11) * ((STEPS - 1) / 22)).astype(np.int64)


def _fitted(batches, tables: Broadcast, weights: np.ndarray, begin: int):
    """(at, v): the task's weights, in order, and the counts of the refinement, each summed over tasks later.

    Weights move online, bit by bit over TOGETHER bytes, drawn at random from a
    piece; a bit counts as not yet seen in its slots.  A frequent byte comes several
    times, each with its part of the count, and slopes are measured by what a gate
    gets at a time on average.
    """
    mixer, total, moved = Mixer(tables.value, weights.astype(np.float32)), np.zeros(GATES), np.full(weights.shape, 1e-3)
    seen = np.zeros(256 * STEPS * 2)
    shuffled, steps = np.random.default_rng(5), 0
    for table in gathered(batches):
        edges = edges_in(table, begin)
        learn = np.flatnonzero(edges.n > 0)
        times = 1 + np.log2(edges.n[learn]).astype(np.int64)
        edges.n[learn] /= times
        for data, h, place, n in edges.slices(TOGETHER, shuffled.permutation(np.repeat(learn, times))):
            steps += 1
            for b, (slot, bit, node) in enumerate(slots(data, h)):
                x, gate = mixer.inputs(slot, place, b, bit.astype(np.int32))
                logit = mixer.chance(x, gate)
                seen += np.bincount((node * STEPS + bucket(logit)) * 2 + bit, n, len(seen))
                off = (bit - 1 / (1 + np.exp(-logit))) * n
                total += np.bincount(gate, n, GATES)
                slope = np.stack([np.bincount(gate, off * row, GATES) for row in x], 1) / np.maximum(total / steps, 1e-9)[:, None]
                moved += slope * slope
                mixer.weights += (STEP * slope / np.sqrt(moved)).astype(np.float32)
    v = np.concatenate(((mixer.weights * total[:, None]).ravel(), total, seen))
    some = np.flatnonzero(v)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(v[some])], names=["at", "v"])


def fit(words: DataFrame, heads: DataFrame | None = None) -> tuple[Broadcast, np.ndarray, np.ndarray]:
    """(tables, weights, refinement) from ``words`` (word, n9, ...), all of them, and their ``heads`` (head, n) in the texts.

    Without ``heads``, each unit is a text of its own, with nothing before it.

    The driver gets the tables, of a fixed size, and one number per weight and per
    count of the refinement.
    """
    spark = words.sparkSession
    begin, tables_of = (0, [words]) if heads is None else (REACH, [words, heads])
    each = lambda f, kind: functools.reduce(DataFrame.unionByName, (t.mapInArrow(f, kind) for t in tables_of))
    counts = each(lambda it: _counted(it, begin), "chunk int, counts binary").repartition("chunk").mapInArrow(_packed, "chunk int, counts binary")
    tables = np.zeros((INPUTS * SLOTS, 2), np.uint16)
    for chunk, raw in counts.toLocalIterator():
        tables[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(raw, np.uint16).reshape(-1, 2)
    tables, weights, seen = spark.sparkContext.broadcast(tables), np.full((GATES, INPUTS + 1), START), np.zeros((256, STEPS, 2))
    got = each(lambda it, w=weights: _fitted(it, tables, w, begin), "at int, v double").groupBy("at").agg(F.sum("v")).toArrow()
    v = np.zeros(weights.size + GATES + seen.size)
    v[got.column(0).to_numpy()] = got.column(1).to_numpy()
    sums, total, seen = np.split(v, [weights.size, weights.size + GATES])
    weights = np.where(total[:, None] > 0, sums.reshape(weights.shape) / np.maximum(total, 1e-9)[:, None], weights)
    seen = seen.reshape(256, STEPS, 2)
    middle = 1 / (1 + np.exp(11 - np.arange(STEPS) * (22 / (STEPS - 1))))
    return tables, weights, (seen[..., 1] + OWN * middle) / (seen.sum(2) + OWN)


def _scored(batches, tables: Broadcast, weights: np.ndarray, refined: np.ndarray):
    """(word, gap, c, ends, chance): the log10 probability of each unit's bytes behind its head, and how often its word came in training."""
    mixer = Mixer(tables.value, weights.astype(np.float32), refined)
    for table in gathered(batches):
        edges = UnitEdges(table, REACH)
        chance, rows, last = edges.sums(mixer), pa.array(edges.rows), edges.bytes[edges.at[1:] - 1]
        columns = [table.column("word").take(rows), pa.array(last.astype(np.int32)), table.column("n").take(rows), pa.array(ends_of(edges.bytes, edges.at)), pa.array(chance)]
        yield from pa.table(columns, names=["word", "gap", "c", "ends", "chance"]).to_batches()


REQUEST = "block long, at int, word binary, gap int, n long, head long"


def _coded(batches, kind: pa.DataType):
    """Per block of texts: a row for each distinct unit (block, at, word, gap, and n, its count in training), for each distinct head (head, and n, its count in training), and for each text (block, doc_id, ..., the units it has, in its order)."""
    number, empty = itertools.count(TaskContext.get().partitionId() << 32), lambda: defaultdict(itertools.count().__next__)
    kinds = {"block": pa.int64(), "at": pa.int32(), "word": pa.binary(), "gap": pa.int32(), "n": pa.int64(), "head": pa.int64(), "doc_id": kind, "held_out": pa.bool_(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
    index, docs, size = empty(), [], 0

    def rows(many: int, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(many, t) for c, t in kinds.items()], names=list(kinds))

    def out():
        block, units, n = next(number), list(index), np.zeros(len(index), np.int64)
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))))
        ends, full = ends_of(np.frombuffer(b"".join(units), np.uint8), at), np.diff(at) > 1
        learn, found = [ids for _, held, _, ids in docs if not held], []
        first = np.concatenate(([0], np.cumsum([len(ids) for ids in learn]))).astype(np.int64)
        for lo, hi in pieces(first[:-1], int(first[-1])):
            ids = np.concatenate(learn[lo:hi])
            n += np.bincount(ids, minlength=len(n))
            found.append(np.unique(heads_of(ends[ids], first[lo:hi] - first[lo]), return_counts=True))
        if found:
            heads, same = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
            yield rows(len(heads), head=heads, n=np.bincount(same, np.concatenate([c for _, c in found]), len(heads)).astype(np.int64))
        for lo in range(0, len(units), 1 << 16):
            part = units[lo : lo + (1 << 16)]
            yield rows(len(part), block=[block] * len(part), at=np.arange(lo, lo + len(part), dtype=np.int32), word=[u[:-1] for u in part], gap=[u[-1] for u in part], n=n[lo : lo + len(part)])
        for lo in range(0, len(docs), 1 << 10):
            part = docs[lo : lo + (1 << 10)]
            ids, held, many, own = zip(*part)
            # first all low bytes, then all higher ones, of which most are small
            planes = [x.view(np.uint8).reshape(-1, 4).T.tobytes() for x in own]
            yield rows(len(part), block=[block] * len(part), doc_id=ids, held_out=held, n_bytes=many, n_tokens=[int(np.count_nonzero(full[x])) + 1 for x in own], ids=planes)

    for batch in batches:
        for doc_id, held, text in zip(*(c.to_pylist() for c in batch.columns)):
            data = (text or "").encode("utf-8", "surrogatepass").lower() + b"\xff"
            units = UNIT.findall(data)
            docs.append((doc_id, held, len(data), np.fromiter(map(index.__getitem__, units), np.int32, len(units))))
            size += len(data)
            if size >= BLOCK:
                yield from out()
                index, docs, size = empty(), [], 0
    if docs:
        yield from out()


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for z >= 1, by Stirling's series at z + 7."""
    up = z + 7
    series = (up - 0.5) * np.log(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * up**3)
    return series - np.log(z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6))


def adapted(chance: np.ndarray, counts: np.ndarray, texts: np.ndarray, earlier: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each text from its units' log10 probabilities and counts; ``texts`` are the texts' first places.

    A text is drawn from an urn of URN units as the model has them, to which each
    drawn unit is added once more.  A unit that comes k times with one probability gives a
    rising factorial; ``earlier`` tells how often it came before, where it has several.
    """
    rising = (chance + math.log10(URN)) * math.log(10)
    if earlier is not None:
        again = np.flatnonzero(earlier)
        rising[again] = np.log(np.exp(rising[again]) + earlier[again])
    more = np.flatnonzero(counts > 1)
    own = np.exp(rising[more])
    rising[more] += log_gamma(own + counts[more]) - log_gamma(own + 1)
    total = np.add.reduceat(counts, texts).astype(np.float64)
    return (np.add.reduceat(rising, texts) - log_gamma(total + URN) + math.lgamma(URN)) / math.log(10)


def times_before(ids: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """How often each unit came earlier in its text."""
    key = np.repeat(np.arange(len(texts)), np.diff(np.append(texts, len(ids)))) << 32 | ids
    order = np.argsort(key, kind="stable")
    key, at = key[order], np.arange(len(ids))
    first = np.ones(len(ids), bool)
    first[1:] = key[1:] != key[:-1]
    out = np.empty(len(ids), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


class Heads:
    """log10 probabilities of heads; those of a block are remembered."""

    def __init__(self, mixer: Mixer):
        self.mixer, self.known, self.chance = mixer, np.empty(0, np.int64), np.empty(0)

    def __call__(self, heads: np.ndarray) -> np.ndarray:
        own, same = np.unique(heads, return_inverse=True)
        new = np.setdiff1d(own, self.known, assume_unique=True)
        if len(new):
            known = np.concatenate((self.known, new))
            order = np.argsort(known, kind="stable")
            self.known, self.chance = known[order], np.concatenate((self.chance, HeadEdges(new, np.zeros(len(new))).sums(self.mixer)))[order]
        return self.chance[np.searchsorted(self.known, own)][same]


def _summed(batches, kind: pa.DataType, end: tuple[float, bool], tables: Broadcast, weights: np.ndarray, refined: np.ndarray):
    """Sums over each text's units, in its order; a block's units come first, in order, then its texts."""
    mixer = Mixer(tables.value, weights.astype(np.float32), refined)
    block, held, have, heads = None, [], None, None
    for batch in batches:
        here = batch.column("block").to_numpy()
        for lo, hi in itertools.pairwise(np.concatenate(([0], np.flatnonzero(np.diff(here)) + 1, [len(here)])).tolist()):
            part = batch.slice(lo, hi - lo)
            if hi > lo and here[lo] != block:
                block, held, have, heads = here[lo], [], None, Heads(mixer)
            texts = part.column("at").is_null().to_numpy(zero_copy_only=False)
            n = int((~texts).sum())
            if n:
                held.append([part.column(c).slice(0, n).to_numpy(zero_copy_only=False) for c in ("base", "known", "ends", "chance")])
            part = part.slice(n)
            if not part.num_rows:
                continue
            if have is None:
                have, held = [np.concatenate(c) for c in zip(*held)], []
            raw = part.column("ids")
            size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            first = np.cumsum(size) - size
            for lo_, hi_ in pieces(first, int(size.sum())):
                ids = np.concatenate([np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel() for x in raw.slice(lo_, hi_ - lo_).to_pylist()])
                texts = first[lo_:hi_] - first[lo_]
                base, known = (np.add.reduceat(t[ids], texts) for t in have[:2])
                chance = have[3][ids] + heads(heads_of(have[2][ids], texts))
                chance = adapted(chance, np.ones(len(ids), np.int64), texts, times_before(ids, texts))
                own = [part.column(c).slice(lo_, hi_ - lo_) for c in ("doc_id", "held_out", "n_bytes", "n_tokens")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(known.astype(np.int64) + end[1]), pa.array(base + end[0]), pa.array(chance)], names=["doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, held_out, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) per row of ``docs`` (doc_id, text; others are not read).

    ``held_out`` is a Boolean column; rows where it is false or null are learned from.
    ASCII letters fold to lower case.  base_score is that of the smoothed word counts.
    score is the log10 probability of the folded text, byte by byte with its white
    space, and of its end: a unit is what comes up to and with a white-space byte or
    the end, each bit of a byte is predicted from hashed contexts, the bytes before it (a
    unit's first REACH bytes see up to REACH bytes of the text before the unit, later ones their unit)
    and all of its unit, and their logits are mixed by gated weights and refined; along a
    text, units that came before become likelier.  A null text is empty and has its end only.  Rows of one doc_id and equal rows are texts of their own.
    Words and their counts stay distributed and are joined to the blocks of texts
    that have them, once per block.
    """
    spark, kind, made = docs.sparkSession, docs.schema["doc_id"].dataType, []
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    schema = f"{REQUEST}, doc_id {kind.simpleString()}, held_out boolean, n_bytes long, n_tokens long, ids binary"
    at = to_arrow_type(kind)
    coded = cut(rows.mapInArrow(lambda it: _coded(it, at), schema), made)
    units = coded.where("at is not null").select("block", "at", "word", "gap", "n")
    words = units.groupBy("word").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col("gap") == g, F.col("n"))).alias(f"n{g}") for g in GAPS))
    # sorted, units with one beginning come together
    words = cut(words.sortWithinPartitions("word"), made)
    is_word = F.octet_length("word") > 0
    ends, tokens, distinct = words.agg(F.coalesce(F.sum(f"n{END}"), F.lit(0)), F.coalesce(F.sum(F.when(is_word, F.col("n"))), F.lit(0)), F.count(F.when(is_word & (F.col("n") > 0), 1))).first()
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    heads = cut(coded.where("head is not null").groupBy("head").agg(F.sum("n").alias("n")), made)
    tables, weights, refined = fit(words, heads)
    whole = math.log10(tokens + 0.1 * (distinct + 1))
    scored = words.mapInArrow(lambda it: _scored(it, tables, weights, refined), "word binary, gap int, c long, ends long, chance double")
    base = F.when(is_word, F.log10(F.col("c") + 0.1) - whole).otherwise(0.0)
    scored = scored.select("word", "gap", base.alias("base"), (is_word & (F.col("c") > 0)).cast("double").alias("known"), "ends", "chance")
    found = units.drop("n").join(scored, ["word", "gap"]).select("block", "at", "base", "known", "ends", "chance")
    texts = coded.where("ids is not null").select("block", "doc_id", "held_out", "n_bytes", "n_tokens", "ids")
    both = texts.unionByName(found, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("at").asc_nulls_last())
    end = (math.log10(ends + 0.1) - whole, ends > 0)
    out = both.mapInArrow(lambda it: _summed(it, at, end, tables, weights, refined), f"doc_id {kind.simpleString()}, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (F.col("score") / (-math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))
