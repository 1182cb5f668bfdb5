"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

DIM = 512


def letter_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """A random vector of -1 and 1 for each code point, the same in every task."""
    words = tv.mix(tv.mix(codes.astype(np.uint64))[:, None] + np.arange(dim // 64, dtype=np.uint64) * tv.ODD)
    bits = (words[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    return bits.reshape(len(codes), dim).astype(np.float32) * 2 - 1


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def profiles(texts: list, is_letter: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(bundle of each text's trigram vectors, whether it has a letter).

    A trigram binds its letters' vectors, the first rolled twice and the second
    once.  Letters are lower-cased; every stretch of other characters is a space.
    """
    low = [(t or "").lower() for t in texts]
    data = np.frombuffer((" " + "  ".join(low) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 2 for t in low])
    letter = is_letter[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a letter, or the first of a gap
    keep[0] = True
    code = np.where(letter, data, 32)[keep]
    owner = np.searchsorted(ends, np.flatnonzero(keep), side="right").clip(max=len(low) - 1)
    has = np.bincount(owner, weights=letter[keep], minlength=len(low)) > 0
    alphabet, c = np.unique(code, return_inverse=True)
    a = len(alphabet)
    ok = (owner[2:] == owner[:-2]) & (code[1:-1] != 32)
    gram = ((c[:-2] * a + c[1:-1]) * a + c[2:])[ok]
    own = owner[2:][ok]
    if not len(gram):
        return np.zeros((len(low), dim), np.float32), has
    if a**3 <= 1 << 22:
        seen = np.zeros(a**3, bool)
        seen[gram] = True
        value = np.flatnonzero(seen)
        place = np.cumsum(seen) - 1
        col = place[gram]
    else:
        value, col = np.unique(gram, return_inverse=True)
    base = letter_vectors(alphabet, dim)
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    out = np.zeros((len(low), dim), np.float32)
    step = max(256, (1 << 22) // len(low))
    for lo in range(0, len(value), step):
        v = value[lo : lo + step]
        bound = first[v // (a * a)] * second[v // a % a] * base[v % a]
        inside = (col >= lo) & (col < lo + step) if len(value) > step else slice(None)
        counts = np.bincount(own[inside] * len(v) + (col[inside] - lo), minlength=len(low) * len(v)).reshape(len(low), len(v)).astype(np.float32)
        out += counts @ bound
    return out, has


def _bundles(batches, dim: int):
    is_letter, sums = _letters(), {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in tv.chunks(texts, 1 << 20):
            got, has = profiles(texts[lo:hi], is_letter, dim)
            part = np.array(langs[lo:hi], object)
            for lang in set(langs[lo:hi]):
                total = got[(part == lang) & has].astype(np.float64).sum(0)
                sums[lang] = sums.get(lang, 0) + total
    for lang, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(range(dim), pa.int32()), pa.array(total.astype(np.int64))], names=["lang", "k", "v"])


def prototypes(labelled: DataFrame, dim: int = DIM) -> list[tuple[str, np.ndarray]]:
    """Language prototypes from all rows of ``labelled`` (text, lang not null), sorted by language.

    Each task bundles its rows to one vector a language, and these add up by
    (language, dimension); what reaches the driver is languages times ``dim``
    whole numbers, which sum exactly in any order.
    """
    sums = labelled.where("lang is not null and text is not null").select("text", "lang").mapInArrow(lambda it: _bundles(it, dim), "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    by: dict[str, np.ndarray] = {}
    for lang, k, v in sums.collect():
        by.setdefault(lang, np.zeros(dim))[k] = v
    return [(lang, by[lang] / n) for lang in sorted(by) if (n := np.linalg.norm(by[lang])) > 0]


def _predictions(batches, names: list[str], matrix: np.ndarray, dim: int):
    is_letter = _letters()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for lo, hi in tv.chunks(texts, 1 << 20):
            got, has = profiles(texts[lo:hi], is_letter, dim)
            norm = np.sqrt((got.astype(np.float64) ** 2).sum(1))
            cos = got @ matrix.T / np.where(norm > 0, norm, 1)[:, None] if names else np.zeros((hi - lo, 1))
            best = cos.argmax(1)
            pred = [names[b] if names and h else "und" for b, h in zip(best, has)]
            score = np.where(has, cos[np.arange(hi - lo), best].clip(0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(pred), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, labelled: DataFrame, dim: int = DIM) -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs`` (doc_id, text; others are not read).

    The nearest prototype by cosine; ties go to the first language by code
    point.  ``und`` and 0 where the text is null or has no letter, or nothing
    was learned.
    """
    learned = prototypes(labelled, dim)
    names, matrix = [x for x, _ in learned], np.array([v for _, v in learned])
    return docs.select("doc_id", "text").mapInArrow(lambda it: _predictions(it, names, matrix, dim), "doc_id long, lang_pred string, score double")
