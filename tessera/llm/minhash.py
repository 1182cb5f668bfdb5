"""MinHash near-duplicates by a multi-index Hamming join.

A text's signature has 48 components of 16 bits.  It is split into 8 chunks of
6; two signatures that differ in at most 15 components have, by pigeonhole, a
chunk with at most one error.  Each chunk is therefore keyed six times, once
with each component left out, and every such pair shares a key.  A Jaccard
similarity of 0.85 leaves no common chunk with a probability of 6e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .graph import BLOCK, binaries, clusters, edges_of, linked, merged, sketches, whole_cells
from .store import cut, drop, written

#: Components of a signature, of a chunk, and those that may differ.
COMPONENTS, CHUNK_OF, ERRORS = 48, 6, 15
FEATURES = "doc_id long, t long, n_shingles long, f1 long, f2 long, sig binary"


def _seeds() -> np.ndarray:
    return tv.mix(np.arange(1000, 1000 + COMPONENTS, dtype=np.uint64)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, 48) array of 16-bit minima; rows of empty sets are 0."""
    out = np.zeros((len(sets), COMPONENTS), np.uint16)
    size = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size)
    if len(full):
        every = np.concatenate([sets[i] for i in full])
        first = np.concatenate(([0], np.cumsum(size[full])[:-1]))
        with np.errstate(over="ignore"):
            for k, odd in enumerate(_seeds()):
                low = np.minimum.reduceat((every ^ (every >> np.uint64(29))) * odd, first)
                out[full, k] = (tv.mix(low) >> np.uint64(48)).astype(np.uint16)
    return out


def digest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    with np.errstate(over="ignore"):
        f1 = np.array([np.bitwise_xor.reduce(tv.mix(s)) if len(s) else 0 for s in sets], np.uint64)
        f2 = np.array([np.add.reduce(tv.mix(s ^ tv.ODD)) if len(s) else 0 for s in sets], np.uint64)
    return f1.view(np.int64), f2.view(np.int64)


def _features(batches, width: int, carry: tuple[str, ...] = ()):
    gaps = tv.space_table()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for lo, hi in tv.chunks(texts):
            sets = tv.shingles(*tv.hash_words(texts[lo:hi], gaps), width)
            own = [batch.column(k).slice(lo, hi - lo) for k in (0, 1, *range(3, 3 + len(carry)))]
            f1, f2 = digest(sets)
            yield pa.RecordBatch.from_arrays(
                [*own[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array(f1), pa.array(f2), pa.array([r.tobytes() for r in signatures(sets)], pa.binary()), *own[2:]],
                names=["doc_id", "t", "n_shingles", "f1", "f2", "sig", *carry],
            )


def _keys(batches):
    """48 keys of each signature, and two bits of each component in two words."""
    odd, at = _seeds(), np.arange(COMPONENTS, dtype=np.uint64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, COMPONENTS).astype(np.uint64)
        bits = np.stack([((sig >> np.uint64(k) & np.uint64(1)) << at).sum(1, dtype=np.uint64) for k in (0, 1)], 1)
        keys = np.empty((n, COMPONENTS), np.uint64)
        with np.errstate(over="ignore"):
            term = tv.mix(sig + odd * np.uint64(3)) * odd
            for k in range(COMPONENTS):
                lo = k - k % CHUNK_OF
                keys[:, k] = tv.mix(term[:, lo : lo + CHUNK_OF].sum(1, dtype=np.uint64) - term[:, k] + np.uint64(k))
        ids = np.repeat(batch.column(0).to_numpy(), COMPONENTS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids), binaries(np.repeat(bits, COMPONENTS, 0).ravel(), np.arange(len(ids) + 1) * 2)], names=["key", "id", "s"])


def components_apart(words: np.ndarray, at: np.ndarray):
    """For near_edges: whether at most ERRORS components are seen to differ, which holds for all pairs with at most so many that do."""
    s = words.reshape(-1, 2)
    one = np.zeros(len(s), np.int64)
    return one, one, lambda x, y: np.bitwise_count((s[x, 0] ^ s[y, 0]) | (s[x, 1] ^ s[y, 1])) <= ERRORS


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from dense products over the shingles that at least two sets have."""
    n = len(sets)
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    value, column, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(value), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    keep = column >= 0
    column, owner = column[keep], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((n, min(4096, len(shared) - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _sets(batches, width: int):
    """(id, cluster, s): the shingles of texts whose set has the digest (f1, f2)."""
    gaps = tv.space_table()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for lo, hi in tv.chunks(texts):
            sets = tv.shingles(*tv.hash_words(texts[lo:hi], gaps), width)
            at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), binaries(np.concatenate(sets), at)], names=["id", "cluster", "s"])


def _links(batches, percent: int):
    for table, at in whole_cells(batches):
        ids, place = np.unique(table.column("id").to_numpy(), return_inverse=True)
        side, (words, set_at), label = table.column("side").to_numpy(), sketches(table), np.arange(len(ids))
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            if hi - lo < 2:
                continue
            sets = [words[a:b] for a, b in zip(set_at[lo:hi], set_at[lo + 1 : hi + 1])]
            both, size, own = overlaps(sets), np.array([len(s) for s in sets]), side[lo:hi]
            links = (100 * both >= percent * (size[:, None] + size - both)) & ((own == 0) | (own[:, None] != own))
            x, y = np.nonzero(np.triu(links, 1))
            label = merged(label, place[lo + x], place[lo + y])
        yield edges_of(ids, label)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text; other columns are not read).

    Texts link if 100 * intersection >= percent * union of their sets of
    distinct ``width``-word shingles.  Words are stretches free of white space,
    A-Z lower-cased; a shorter text is one shingle; null, empty or blank texts
    link with nothing.  Equal sets form one class (a 128-bit digest of the
    set), so copies cost one row each; rows that repeat a doc_id each give a
    row and link by their own text.  A null doc_id gives null component_id and
    is kept.  Every candidate cluster is checked pair by pair on full sets, in
    cells of bounded size.  The columns ``carry`` of each row come along with
    its verdict.
    """
    spark = docs.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    # under names of their own, so that they cannot meet the features'
    held = tuple(f"_carry_{c}" for c in carry)
    digest_of = F.xxhash64("text").alias("t")
    made = cut(docs.select("doc_id", digest_of, "text", *(F.col(c).alias(h) for c, h in zip(carry, held))).mapInArrow(lambda it: _features(it, width, held), ", ".join([FEATURES, *(f"{h} {kinds[c]}" for c, h in zip(carry, held))])))
    classes = made.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.first("sig").alias("sig"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    member = clusters(classes.select("id", "sig").mapInArrow(_keys, "key long, id long, s binary"), components_apart)
    # one text of each class in a cluster; rows that repeat both doc_id and text bring it again
    wanted = classes.select("id", "first.*").join(member, "id")
    texts = docs.select("doc_id", digest_of, "text").join(wanted, ["doc_id", "t"]).select("id", "cluster", "text")
    sets, sets_path = written(texts.mapInArrow(lambda it: _sets(it, width), "id long, cluster long, s binary").groupBy("id", "cluster").agg(F.first("s").alias("s")))
    check = lambda cells: cells.select("cell", "side", "id", "s").mapInArrow(lambda it: _links(it, percent), "a long, b long")
    found = linked(sets, "cluster", check, BLOCK // 4, member)
    drop(spark, sets_path)
    named = classes.select("id", "f1", "f2", "n_shingles", F.col("first.doc_id").alias("doc")).join(found, "id")
    least = named.groupBy("component_id").agg(F.min("doc").alias("least"))
    named = cut(named.join(least, "component_id").select("f1", "f2", "n_shingles", "least"))
    alone = classes.join(found, "id", "left_anti").select("f1", "f2", "n_shingles", F.col("first.doc_id").alias("least"))
    out = made.select("doc_id", "n_shingles", "f1", "f2", *held).join(named.unionByName(alone), ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    out = out.withColumn("component_id", component).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == component))
    return out.select("doc_id", "n_shingles", "component_id", "kept", *(F.col(h).alias(c) for c, h in zip(carry, held)))
