"""Connected components, and close pairs of rows that share a key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, drop, release, written

#: Most rows of a key that one task compares with each other or with another block.
BLOCK = 512
#: Rows and bytes that a task gathers before it compares, and pairs it compares at once.
ROWS, BYTES, PAIRS = 1 << 17, 1 << 24, 1 << 17
#: One in so many ids tells how large a key is, which only decides how many cells it is dealt to.
TOLD = 8


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every node of ``edges`` (columns a, b); component_id is the smallest id reachable.

    Alternates large-star and small-star steps.  Both take a minimum per node,
    which combines before the shuffle, and join it back, which AQE can split at
    a hub; no step gathers a node's neighbours.
    """
    spark = edges.sparkSession
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now, path = written(edges.where("a <> b").select(hi.alias("a"), lo.alias("b")).distinct())
    del edges
    release(spark)
    while not _stars(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after, new = written(small)
        drop(spark, path)
        now, path = after, new
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node a has one edge and is no edge's b: then b is the smallest of its component."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("up")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 and n > 1").isEmpty()


def dealt(rows: DataFrame, key: str, row_id: str, block: int = BLOCK, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` with _many, how many blocks their key is dealt to, and _own, the row's block.

    How large a key is, is told from one in TOLD ids: a block may come out a
    little larger or smaller.  ``counted`` has the same keys where ``rows`` are
    costly to make twice.  A row for key 0, in one block, keeps the plan the
    same whether or not there are hot keys.
    """
    some = (rows if counted is None else counted).where(F.pmod(F.xxhash64(row_id, F.lit(TOLD)), F.lit(TOLD)) == 0)
    hot = some.groupBy(key).agg((F.count("*") * TOLD).alias("_n")).where(F.col("_n") > block)
    hot = cut(hot.unionByName(rows.sparkSession.range(1).select(F.lit(0).cast("long").alias(key), F.lit(0).cast("long").alias("_n"))))
    out = rows.join(hot, key, "left").withColumn("_many", F.coalesce(F.greatest(F.ceil(F.col("_n") / block), F.lit(1)), F.lit(1)).cast("int"))
    return out.withColumn("_own", F.pmod(F.xxhash64(row_id), F.col("_many").cast("bigint")).cast("int")).drop("_n")


def celled(rows: DataFrame, key: str, row_id: str, block: int = BLOCK, counted: DataFrame | None = None) -> DataFrame:
    """Deal each key's rows to cells: ``rows`` with (cell, side), sorted by cell inside its partitions.

    A key of n rows has b = ceil(n / block) blocks and a cell for each pair of
    them, the pair of a block with itself included.  Side 0 marks a block with
    itself; else the pairs of interest are those of side 1 with side 2.  So two
    rows of a key meet once, and a hot key becomes many cells of bounded size.
    """
    out = dealt(rows, key, row_id, block, counted).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_many") - 1)))
    i, j = F.least("_own", "_with"), F.greatest("_own", "_with")
    cell = F.when(F.col("_many") == 1, F.col(key)).otherwise(F.xxhash64(key, i, j))
    side = F.when(F.col("_own") == F.col("_with"), 0).when(F.col("_own") < F.col("_with"), 1).otherwise(2)
    return sorted_cells(out.withColumn("cell", cell).withColumn("side", side.cast("tinyint")).drop(key, "_own", "_with", "_many"))


def sorted_cells(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell")


def with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with comp, the component of their id; an id of its own has none in ``found``."""
    return rows.join(found.withColumnRenamed("component_id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def linked(rows: DataFrame, key: str, links: Callable[[DataFrame], DataFrame], block: int = BLOCK, counted: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """(id, component_id): what the links among rows (key, id, ...) of one key connect, all of them.

    ``links`` takes rows with (cell, side) and gives edges (a, b) that connect what is
    linked inside the cells.  First each block of a key meets itself.  Of keys with several
    blocks, one row of each component then meets those of the others; and where a key
    still holds two components, its rows meet those of other components.  Pairs that are
    connected by then need no check, so a group of rows that are alike ends after the
    second step; one whose rows are not costs all its pairs.  ``more`` are edges known
    before.  An id that has several keys is with other rows in the blocks of each.
    """
    now = dealt(rows, key, "id", block, counted)
    cell = F.when(F.col("_many") == 1, F.col(key)).otherwise(F.xxhash64(key, F.pmod(F.xxhash64("id", key), F.col("_many").cast("bigint"))))
    inside = now.withColumn("cell", cell).withColumn("side", F.lit(0).cast("tinyint"))
    edges = links(sorted_cells(inside.drop(key, "_own", "_many")))
    found = cut(components(edges if more is None else edges.unionByName(more)))
    crowd = cut(now.where("_many > 1").drop("_own", "_many"))
    if crowd.isEmpty():
        return found
    again = lambda edges: cut(components(edges.unionByName(found.select(F.col("id").alias("a"), F.col("component_id").alias("b")))))
    first = with_component(crowd.select(key, "id"), found).groupBy(key, "comp").agg(F.min("id").alias("id")).drop("comp")
    found = again(links(celled(crowd.join(first, [key, "id"]), key, "id", block)))
    state = cut(with_component(crowd.select(key, "id"), found))
    parts = state.groupBy(key, "comp").agg(F.count("*").alias("_m"))
    open_ = parts.groupBy(key).agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.sum(F.when(F.col("_m") < block, F.col("_m"))).alias("_rest")).where("_lo <> _hi")
    # blocks of one component, and such as pool the small ones
    parts = cut(parts.join(open_.select(key, "_rest"), key))
    if parts.isEmpty():
        return found
    pure = F.col("_m") >= block
    place = F.when(pure, F.xxhash64("comp", F.pmod(F.xxhash64("id"), F.ceil(F.col("_m") / block)))).otherwise(F.pmod(F.xxhash64("comp"), F.greatest(F.ceil(F.col("_rest") / block), F.lit(1))))
    state = cut(state.join(parts, [key, "comp"]).select(key, "id", place.alias("_at"), F.when(pure, F.col("comp")).alias("_pure")))
    blocks = state.select(key, "_at", "_pure").distinct()
    other = blocks.select(key, F.col("_at").alias("_to"), F.col("_pure").alias("_as"))
    meet = blocks.join(other, key).where("_at <= _to and not coalesce(_pure = _as, false)").withColumn("cell", F.xxhash64(key, "_at", "_to"))
    same = F.col("_at") == F.col("_to")
    ends = meet.select(key, "_at", "cell", F.when(same, 0).otherwise(1).cast("tinyint").alias("side")).unionByName(meet.where(~same).select(key, F.col("_to").alias("_at"), "cell", F.lit(2).cast("tinyint").alias("side")))
    met = state.drop("_pure").join(ends, [key, "_at"]).join(crowd, [key, "id"]).drop(key, "_at")
    return again(links(sorted_cells(met)))


def bounds_of(column: np.ndarray) -> np.ndarray:
    """Bounds of the stretches over which a column stays equal."""
    return np.concatenate(([0], np.flatnonzero(column[1:] != column[:-1]) + 1, [len(column)]))


def whole_cells(batches):
    """(table, bounds of its cells) from record batches sorted by cell, gathered to ROWS rows or BYTES bytes and cut so that no cell spans two."""
    held: list = []

    def joined():
        table = pa.Table.from_batches(held).combine_chunks()
        return table, bounds_of(table.column("cell").to_numpy())

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS and sum(b.nbytes for b in held) < BYTES:
            continue
        table, at = joined()
        if len(at) > 2:
            yield table.slice(0, at[-2]).combine_chunks(), at[:-1]
        held = table.slice(at[-2]).combine_chunks().to_batches()
    if held:
        yield joined()


def pairs_of(at: np.ndarray, side: np.ndarray, size: np.ndarray, reach: np.ndarray):
    """(x, y): the row numbers of all pairs to compare inside each cell, some at a time.

    Only pairs with size[x] <= size[y] <= reach[x] are of interest.
    """
    cell = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((size, cell))
    # one number for cell and size, so that a search finds where a row's partners end
    width = int(max(size.max(), reach.max())) + 1
    end = np.searchsorted(cell * width + size[order], cell * width + reach[order], side="right")
    many = end - np.arange(len(order)) - 1
    upto = np.cumsum(many)
    mixed, lo = side.any(), 0
    while lo < len(order):
        before = upto[lo] - many[lo]
        hi = max(lo + 1, int(np.searchsorted(upto, before + PAIRS, side="right")))
        n = many[lo:hi]
        x = np.repeat(np.arange(lo, hi), n)
        y = np.arange(before, before + len(x)) - np.repeat(upto[lo:hi] - n, n) + x + 1
        x, y = order[x], order[y]
        if mixed:
            two = (side[x] == 0) | (side[x] != side[y])
            x, y = x[two], y[two]
        if len(x):
            yield x, y
        lo = hi


def merged(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``label`` (each node's smallest known fellow) once x[k] and y[k] are connected too."""
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            return label
        x, y, lx, ly = x[apart], y[apart], lx[apart], ly[apart]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        up = label[label]
        while (up != label).any():
            label, up = up, up[up]


def edges_of(ids: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """Edges (a, b) from each id to the smallest one it is connected with; ``ids`` are sorted and distinct."""
    linked = np.flatnonzero(label != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[linked], pa.int64()), pa.array(ids[label[linked]], pa.int64())], names=["a", "b"])


def sketches(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words of all rows' binary column s, bounds of each row's)."""
    s = table.column("s").combine_chunks()
    if isinstance(s, pa.ChunkedArray):
        if s.num_chunks > 1:
            raise ValueError("a cell of more than 2 GB of sketches")
        s = s.chunk(0)
    _, ends, data = s.buffers()
    ends = np.frombuffer(ends, np.int32)[s.offset : s.offset + len(s) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].copy().view(np.uint64), (ends - ends[0]) // 8


def binaries(words: np.ndarray, at: np.ndarray) -> pa.Array:
    """The opposite of ``sketches``: a binary column of stretches of 64-bit words."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int32).tobytes()), pa.py_buffer(words.tobytes())])


def near_in_cells(batches, prepare: Callable):
    """Task side of near_edges: what close pairs connect among the gathered cells, as at most one edge per id."""
    for table, at in whole_cells(batches):
        length = np.diff(at)
        if not (length > 1).any():
            continue
        if (length == 1).any():
            table = table.filter(pa.array(np.repeat(length > 1, length)))
            at = np.concatenate(([0], np.cumsum(length[length > 1])))
        ids, place = np.unique(table.column("id").to_numpy(), return_inverse=True)
        side, (size, reach, close), label = table.column("side").to_numpy(), prepare(*sketches(table)), np.arange(len(ids))
        for x, y in pairs_of(at, side, size, reach):
            near = close(x, y)
            label = merged(label, place[x[near]], place[y[near]])
        yield edges_of(ids, label)


def near_edges(rows: DataFrame, prepare: Callable) -> DataFrame:
    """Edges (a, b) that connect all rows (key long, id long, s binary) that share a key and are close.

    ``prepare`` takes the 64-bit words of the sketches s and each row's bounds
    in them, and gives each row's size, the largest size of a row close to it,
    and a function of two arrays of row numbers: which pairs are close.  Output is linear in the rows, as a task gives what its close pairs
    connect, not the pairs.
    """
    cells = celled(rows, "key", "id").select("cell", "side", "id", "s")
    return cells.mapInArrow(lambda it: near_in_cells(it, prepare), "a long, b long")


def clusters(rows: DataFrame, prepare: Callable) -> DataFrame:
    """(id, cluster): components of near_edges; ids that are close to nothing are left out."""
    return cut(components(near_edges(rows, prepare))).withColumnRenamed("component_id", "cluster")
