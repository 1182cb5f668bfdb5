"""Vector code compression: codebooks by part, with VA-file filtering of the nearest entry."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts a vector is cut into, entries a codebook, rounds of assignment and replacement, and integer steps a unit.
PARTS, ENTRIES, ROUNDS, STEPS = 16, 64, 2, 256
#: Bits of a coordinate's cell in the filter.
CELL_BITS = 3
#: Integers beyond this are set to it, so that squared distances fit 64 bits.
LARGEST = 1 << 27
#: A label with more than this share of the rows is joined by broadcast; there are fewer of them than its inverse.
HOT_SHARE = 0.001

USABLE = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"


def integers(column: pa.ListArray, width: int) -> np.ndarray:
    """(rows, PARTS, width) whole steps of the vectors, rounded down; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy().astype(np.int64)
    flat, size = column.values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(ends)
    out = np.zeros((len(size), PARTS * width), np.int64)
    steps = np.clip(np.floor(STEPS * flat[ends[0] : ends[-1]]), -LARGEST, LARGEST).astype(np.int64)
    out[np.arange(PARTS * width) < size[:, None]] = steps
    return out.reshape(len(size), PARTS, width)


def sliced(batches, width: int):
    """The batches in pieces of about 4 million components, which bounds the lookup tables."""
    rows = max(1, (1 << 22) // (PARTS * width))
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


class Filter:
    """The VA-file of one codebook: each entry's coordinates as cells, each cell with the least and the largest coordinate in it."""

    def __init__(self, book: np.ndarray):
        entries, width = book.shape
        cells = min(1 << CELL_BITS, entries)
        place = np.argsort(np.argsort(book, 0, kind="stable"), 0)
        self.book, self.cell = book, place * cells // entries
        self.low, self.high = np.empty((2, width, cells), np.int64)
        for d in range(width):
            for c in range(cells):
                own = book[self.cell[:, d] == c, d]
                self.low[d, c], self.high[d, c] = own.min(), own.max()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the entry nearest to each row of x; of equally near ones the first.

        A row's lookup tables hold, by coordinate and cell, the least and the largest
        squared distance to what may be in the cell.  Their sums bound the distance to
        an entry from both sides; only entries whose lower bound is not above the least
        upper bound get an exact distance.
        """
        below, above = self.low[None] - x[:, :, None], x[:, :, None] - self.high[None]
        least = np.maximum(0, np.maximum(below, above)) ** 2
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        lower = sum(least[:, d, self.cell[:, d]] for d in range(x.shape[1]))
        upper = sum(most[:, d, self.cell[:, d]] for d in range(x.shape[1]))
        row, entry = np.nonzero(lower <= upper.min(1, keepdims=True))
        apart = ((x[row] - self.book[entry]) ** 2).sum(1)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(apart, first) if len(row) else apart
        met = np.flatnonzero(apart == best[row])
        met = met[np.diff(row[met], prepend=-1) != 0]
        return entry[met], best


def _sums(batches, books: np.ndarray):
    """(part, entry, n, total): per task, how many parts each entry is nearest to, and their coordinate sums."""
    filters, width = [Filter(b) for b in books], books.shape[2]
    n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for batch in sliced(batches, width):
        x = integers(batch.column(0), width)
        for p, f in enumerate(filters):
            entry, _ = f.nearest(x[:, p])
            n[p] += np.bincount(entry, minlength=len(f.book))
            np.add.at(total[p], entry, x[:, p])
    part, entry = np.nonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])


def _codes(batches, books: np.ndarray):
    """(vec_id, label, code, error) of rows (embedding, vec_id, label)."""
    filters, width = [Filter(b) for b in books], books.shape[2]
    hexes = np.array([f"{i:02x}" for i in range(ENTRIES)])
    for batch in sliced(batches, width):
        x = integers(batch.column(0), width)
        code, error = [], np.zeros(len(x), np.int64)
        for p, f in enumerate(filters):
            entry, apart = f.nearest(x[:, p])
            code.append(hexes[entry])
            error += apart
        text = ["".join(c) for c in zip(*code)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])


def codebooks(usable: DataFrame) -> np.ndarray:
    """(PARTS, entries, width) integers, fitted on all rows of ``usable`` (vec_id, embedding).

    Only the first ENTRIES vectors and, per round, one row per part and entry reach the driver.
    """
    longest = usable.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-longest // PARTS))
    first = usable.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").toArrow()
    books = integers(first.column(0), width).transpose(1, 0, 2).copy() if len(first) else np.zeros((PARTS, 0, width), np.int64)
    for _ in range(ROUNDS if len(first) else 0):
        sums = usable.select("embedding").mapInArrow(lambda it, b=books: _sums(it, b), "part int, entry int, n long, total array<long>")
        sums = sums.groupBy("part", "entry").agg(F.sum("n"), F.array(*(F.sum(F.col("total")[d]) for d in range(width))))
        books = books.copy()
        for part, entry, n, total in sums.collect():
            books[part, entry] = np.array(total, np.int64) // n
    return books


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) per row of ``vectors`` (vec_id, embedding, label) with a usable vector; other columns are not read.

    Rows whose vector is null or holds a null or non-finite component are dropped.
    Vectors of fewer components than the longest are taken to end in zeros, and so
    are all where PARTS does not divide the longest.  The codebooks start from the
    smallest vec_ids, null ids last and rows of one id in the order of their
    vectors; with fewer rows than ENTRIES they have fewer entries.  Repeated ids and
    equal rows are rows of their own.  Components beyond 2^19 count as 2^19.  A sum of
    errors that does not fit a long is null.
    """
    usable = vectors.select("embedding", "vec_id", "label").where(USABLE)
    books = codebooks(usable.select("embedding", "vec_id"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    kind = vectors.schema["label"].dataType.simpleString()
    made = usable.mapInArrow(lambda it: _codes(it, books), f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {kind}, code string, error long")
    sums = made.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count("*").alias("n"))
    sums = sums.select(F.col("label").alias("of"), F.col("label_error").try_cast("long").alias("label_error"), "n")
    least = F.lit(HOT_SHARE * (sums.agg(F.sum("n")).first()[0] or 0))
    hot, cold = F.broadcast(sums.where(F.col("n") > least)), sums.where(F.col("n") <= least)
    same = F.col("label").eqNullSafe(F.col("of"))
    out = made.join(hot, same).unionByName(made.join(hot, same, "left_anti").join(cold, same))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
