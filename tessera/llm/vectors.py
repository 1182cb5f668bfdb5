"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .graph import BLOCK, binaries, celled, clusters, components, edges_of, merged, whole_cells
from .store import cut

#: Tables, projections a table, and the width of a quantised step; at a cosine of 0.93 the 32 tables miss a pair with a probability below 0.003.
TABLES, PROJECTIONS, STEP = 32, 8, 1.5
#: Of 128 sign bits, those that may differ among candidates; a cosine of 0.93 gives 15 on average, with a deviation of 4.
SIGN_BITS = 34


def _directions(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.standard_normal((dim, TABLES * PROJECTIONS)), rng.uniform(0, STEP, TABLES * PROJECTIONS), rng.standard_normal((dim, 128))


def _keys(batches):
    odd = tv.mix(np.arange(TABLES * PROJECTIONS, dtype=np.uint64)) | np.uint64(1)
    made: dict[int, tuple] = {}
    for batch in batches:
        vectors, ids, labels = batch.column(1).to_pylist(), batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.int64)
        dims = np.array([len(v) for v in vectors], np.int64)
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            x = np.array([vectors[i] for i in own], np.float64)
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            if dim not in made:
                made[dim] = _directions(int(dim))
            along, shift, signs = made[dim]
            cell = np.floor((x @ along + shift) / STEP).astype(np.int64).view(np.uint64)
            with np.errstate(over="ignore"):
                keys = (tv.mix(cell + odd) * odd).reshape(len(own), TABLES, PROJECTIONS).sum(2, dtype=np.uint64)
                keys = tv.mix(keys + tv.mix(labels[own].view(np.uint64) * np.uint64(2654435761) + np.uint64(dim))[:, None] + np.arange(TABLES, dtype=np.uint64))
            bits = (x @ signs > 0).reshape(len(own), 2, 64)
            s = (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64)
            sketch = binaries(np.repeat(s, TABLES, 0).ravel(), np.arange(len(own) * TABLES + 1) * 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids[own], TABLES)), sketch], names=["key", "id", "s"])


def signs_apart(words: np.ndarray, at: np.ndarray):
    """For near_edges: whether at most SIGN_BITS sign bits differ."""
    s = words.reshape(-1, 2)
    one = np.zeros(len(s), np.int64)
    return one, one, lambda x, y: np.bitwise_count(s[x] ^ s[y]).sum(1, dtype=np.int64) <= SIGN_BITS


def _cosines(batches, least: float):
    """Rows (id, n, a): n further vectors linked to id in these cells (a null), or an edge id-a (n = 0)."""
    for table, at in whole_cells(batches):
        every, copies, label, side = (table.column(x).to_numpy() for x in ("id", "copies", "label", "side"))
        ids, place = np.unique(every, return_inverse=True)
        values = table.column("embedding").combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        ends = values.offsets.to_numpy().astype(np.int64)
        flat = values.values.to_numpy(zero_copy_only=False)
        linked, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            if hi - lo < 2:
                continue
            # a cluster holds one label; a dimension may differ only by a hash collision
            dims = np.diff(ends[lo : hi + 1])
            x = np.zeros((hi - lo, dims.max()))
            x[np.arange(dims.max()) < dims[:, None]] = flat[ends[lo] : ends[hi]]
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            own = side[lo:hi]
            links = (x @ x.T >= least) & (dims[:, None] == dims) & (label[lo:hi, None] == label[lo:hi]) & ((own == 0) | (own[:, None] != own))
            np.fill_diagonal(links, False)
            np.add.at(linked, place[lo:hi], links @ copies[lo:hi])
            a, b = np.nonzero(np.triu(links, 1))
            root = merged(root, place[lo + a], place[lo + b])
        edges = edges_of(ids, root)
        some = np.flatnonzero(linked)
        n = np.concatenate((linked[some], np.zeros(edges.num_rows, np.int64)))
        far = pa.array(np.concatenate((np.zeros(len(some), np.int64), edges.column(1).to_numpy())), mask=np.arange(len(n)) < len(some))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids[some], edges.column(0).to_numpy()))), pa.array(n), far], names=["id", "n", "a"])


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label; other columns are not read).

    Two vectors link if their labels are equal and not null and their cosine in
    double precision is at least ``least``.  Vectors that are null, empty, zero or
    hold a null or non-finite component, and rows without vec_id, link with
    nothing.  Equal vectors of a label form one class; each row of a repeated
    vec_id is a vector of its own, with its own links.  A null vec_id has null
    component_id and is kept.
    """
    v = F.col("embedding")
    usable = F.expr("embedding is not null and size(embedding) > 0 and label is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    rows = vectors.select("vec_id", v, F.col("label").cast("long").alias("label")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("h1", F.xxhash64(v)).withColumn("h2", F.xxhash64(F.lit(7), v))
    classes = rows.where("usable").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    member = clusters(classes.select("id", "embedding", "label").mapInArrow(_keys, "key long, id long, s binary"), signs_apart)
    cells = celled(classes.select("id", "copies", "label", "embedding").join(member, "id"), "cluster", "id", BLOCK, member)
    checked = cut(cells.select("cell", "side", "id", "copies", "label", "embedding").mapInArrow(lambda it: _cosines(it, least), "id long, n long, a long"))
    found = cut(components(checked.where("a is not null").select(F.col("id").alias("a"), F.col("a").alias("b"))))
    others = checked.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    named = cut(classes.drop("embedding").join(others, "id", "left").join(found, "id", "left").select("label", "h1", "h2", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component")))
    first = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(first, "component").select("label", "h1", "h2", "n_links", "component_id")
    out = rows.where("usable").select("vec_id", "label", "h1", "h2").join(named, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
