"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .store import cut

#: Labelled rows fitted at most (those with the smallest hash of doc_id), hash slots, factors, the share of toxic texts a term needs,
#: the bytes of a term that count as its beginning (inflected and compound words share it), the common terms that pairs may be sought
#: among, and the size of a factor below which such a term has none.
SAMPLE, SLOT_BITS, FACTORS, LEAST_SHARE, STEM, FREQUENT, NOISE = 6000, 32, 2, 0.01, 5, 1000, 0.1
#: Square penalties of the factors of terms with linear evidence and of others, over the root of the rows.
OWN, RARE = 0.1, 1.5
#: Rounds in which weights and factors are trained in turn.
SWEEPS = 2


def terms(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each text's distinct terms and beginnings of terms, bounds)."""
    hashes, bounds, stems = tv.hash_words(texts, tv.letter_gap_table(), begin=STEM)
    slot = (np.concatenate((hashes, stems)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    owner = np.tile(np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(bounds)), 2)
    pair = np.unique((owner << SLOT_BITS) + slot)
    return pair & ((1 << SLOT_BITS) - 1), np.searchsorted(pair >> SLOT_BITS, np.arange(len(texts) + 1))


def among(slot: np.ndarray, bounds: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``known`` (sorted) of the slots it has, and their bounds."""
    at = np.searchsorted(known, slot)
    keep = known[at.clip(max=len(known) - 1)] == slot if len(known) else np.zeros(len(slot), bool)
    return at[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def raw_scores(at: np.ndarray, bounds: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Bias + linear terms + all pairwise interactions <v_i, v_j> of the terms present."""
    own = v[at]
    both = _sums(own, bounds) ** 2 - _sums(own**2, bounds)
    return bias + _sums(w[at], bounds) + 0.5 * both.sum(1)


def linear(slot: np.ndarray, bounds: np.ndarray, n_terms: int, y: np.ndarray, chance: float, rounds: int, pairs: np.ndarray | float = 0.0) -> tuple[float, np.ndarray]:
    """(bias, weights) beside what ``pairs`` give each text, by accelerated proximal gradients on standardised terms.

    The penalty is ``chance`` times the spread of a gradient of a term without
    meaning, so terms compete by evidence.
    """
    n = len(y)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    mean = np.bincount(slot, minlength=n_terms) / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 0.5 / n))
    rate = (y.sum() + 1) / (n + 2)
    lasso = chance * np.sqrt(rate * (1 - rate) / n)
    ahead = lambda w: _sums((w / spread)[slot], bounds) - (mean / spread * w).sum()
    back = lambda e: (np.bincount(slot, e[owner], n_terms) - mean * e.sum()) / spread / n
    x = np.random.default_rng(1).normal(size=n_terms)
    for _ in range(10):
        x = back(ahead(x / max(np.linalg.norm(x), 1e-12)))
    curve = 0.3 * np.linalg.norm(x) + 0.25
    bias, w, z, t = np.log(rate / (1 - rate)), np.zeros(n_terms), np.zeros(n_terms), 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(bias + ahead(z) + pairs).clip(-30, 30))) - y
        bias -= error.mean() / curve
        to = z - back(error) / curve
        new = np.sign(to) * np.maximum(np.abs(to) - lasso / curve, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    return bias - (mean / spread * w).sum(), w / spread


def factors(slot: np.ndarray, bounds: np.ndarray, start: np.ndarray, v: np.ndarray, y: np.ndarray, ridge: np.ndarray, rounds: int = 50, rate: float = 0.08) -> np.ndarray:
    """Factors, from ``v`` on, that explain by pairs of terms what the linear part ``start`` leaves, by Adam under each term's square penalty."""
    owner, n_terms = np.repeat(np.arange(len(y)), np.diff(bounds)), len(v)
    m, s, ridge = np.zeros_like(v), np.zeros_like(v), ridge[:, None] / np.sqrt(len(y))
    for t in range(1, rounds + 1):
        own = v[slot]
        total = _sums(own, bounds)
        raw = start + 0.5 * (total**2 - _sums(own**2, bounds)).sum(1)
        each = ((1 / (1 + np.exp(-raw.clip(-30, 30))) - y) / len(y))[owner]
        g = np.stack([np.bincount(slot, each * (total[owner, f] - own[:, f]), n_terms) for f in range(FACTORS)], 1) + ridge * v
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        v = v - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-6)
    return v


def machine(slot: np.ndarray, bounds: np.ndarray, n_terms: int, y: np.ndarray, common: bool):
    """(bias, terms, weights, factors), weights and factors trained in turn.

    The terms are those with linear evidence and, if ``common``, the FREQUENT
    most common ones whose factors are above NOISE.  The first linear part is
    the shrunken one, so that factors take what it leaves before the weights
    come to their full size beside them.
    """
    bias, w = linear(slot, bounds, n_terms, y, 3.0, 40)
    found = np.flatnonzero(w)
    keep = np.zeros(n_terms, bool)
    keep[found] = True
    if common:
        keep[np.argsort(-np.bincount(slot, minlength=n_terms), kind="stable")[:FREQUENT]] = True
    # terms with evidence of their own start with larger factors and may keep them
    ridge = np.where(w != 0, OWN, RARE)
    v = np.random.default_rng(5).normal(0, 1, (n_terms, FACTORS)) * np.where(w != 0, 0.1, 0.01)[:, None]
    linear_places = among(slot, bounds, found)
    for _ in range(SWEEPS):
        places = among(slot, bounds, np.flatnonzero(keep))
        v[keep] = factors(*places, bias + _sums(w[slot], bounds), v[keep], y, ridge[keep])
        # on long texts the noise of many terms would add up
        keep &= (w != 0) | (np.abs(v).max(1) >= NOISE)
        v[~keep] = 0
        keep[found] = True
        bias, w[found] = linear(*linear_places, len(found), y, 0.2, 200, raw_scores(slot, bounds, 0.0, np.zeros(n_terms), v))
    keep = np.flatnonzero((w != 0) | (np.abs(v).max(1) > 0))
    return float(bias), keep, w[keep], v[keep]


def fit(slot: np.ndarray, bounds: np.ndarray, known: np.ndarray, y: np.ndarray):
    """(bias, slots, linear weights, factors) from each text's places among the ``known`` slots.

    A machine trained without every fifth row tells by its loss there whether
    pairs are sought among common terms, too.
    """
    owner, out = np.repeat(np.arange(len(y)), np.diff(bounds)), np.arange(len(y)) % 5 == 0

    def part(rows):
        return slot[rows[owner]], np.concatenate(([0], np.cumsum(np.diff(bounds)[rows])))

    def loss(common):
        bias, keep, w, v = machine(*part(~out), len(known), y[~out], common)
        raw = raw_scores(*among(*part(out), keep), bias, w, v)
        return np.logaddexp(0, np.where(y[out] > 0, -raw, raw)).mean()

    common = bool((~out).any()) and loss(True) < loss(False)
    bias, keep, w, v = machine(slot, bounds, len(known), y, common)
    return bias, known[keep], w, v


def _scored(batches, model):
    bias, known, w, v = model
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for lo, hi in tv.chunks(texts):
            score = 1 / (1 + np.exp(-raw_scores(*among(*terms(texts[lo:hi]), known), bias, w, v).clip(-30, 30)))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(score, pa.float64())], names=["doc_id", "score"])


def _slots(batches):
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for lo, hi in tv.chunks(texts):
            yield pa.RecordBatch.from_arrays([pa.array(terms(texts[lo:hi])[0])], names=["slot"])


def _places(batches, known: np.ndarray):
    for batch in batches:
        y, texts = batch.column(0), batch.column(1).to_pylist()
        for lo, hi in tv.chunks(texts):
            at, bounds = among(*terms(texts[lo:hi]), known)
            at = at.astype(np.int32)
            yield pa.RecordBatch.from_arrays([y.slice(lo, hi - lo), pa.array([at[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary())], names=["toxic", "at"])


def toxicity(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) per row of ``docs`` (doc_id, text; others are not read), from ``labelled`` (doc_id, text, toxic).

    The machine is fitted on the driver to the ``sample`` labelled rows with the
    smallest hash of doc_id; the driver gets the slots that LEAST_SHARE of the
    toxic ones hold and each row's places among these, not the texts.  Rows with
    a null label or text are not learned from.  Every whole text is scored; a
    null or empty one scores the bias.  With nothing to learn, all score one
    half.  Rows are scored one by one, whether their doc_id is null or repeated;
    of labelled rows with equal hashes, the smaller doc_id and label come first,
    and a doc_id that ``labelled`` repeats is learned from as often.
    """
    rows = labelled.where("toxic is not null and text is not null").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    rows = cut(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample))
    toxic = rows.where("toxic = 1").select("text")
    least = max(3, LEAST_SHARE * toxic.count())
    found = toxic.mapInArrow(_slots, "slot long").groupBy("slot").count().where(F.col("count") >= least).select("slot").collect()
    known = np.sort(np.array([r[0] for r in found], np.int64))
    got = rows.select("toxic", "text").mapInArrow(lambda it: _places(it, known), "toxic int, at binary").collect()
    model = (0.0, np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)))
    if got:
        got = sorted((r[1], r[0]) for r in got)  # the same order in every run
        at = [np.frombuffer(x, np.int32) for x, _ in got]
        model = fit(np.concatenate(at).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in at]))), known, np.array([y for _, y in got], np.float64))
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scored(it, model), "doc_id long, score double")
