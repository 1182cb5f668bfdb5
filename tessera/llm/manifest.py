"""Merkle manifest of a dataset: a tree of threes per source, and one over the sources."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .order import numbered, prefix_sums
from .store import cut, drop

#: Children of a node; levels that a task reduces at once; nodes that the driver takes at most.
RUN, LEVELS, TOP = 3, 6, 2048


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def piece(c: Column) -> Column:
    """A value of a leaf: ``-`` if null, else its UTF-8 length, a colon, and itself."""
    c = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def height(n: int, most: int) -> int:
    """Levels that a tree of n nodes has above them, ``most`` at most."""
    k = 0
    while k < most and n > 1:
        n, k = -(-n // RUN), k + 1
    return k


def climb(nodes: list[str], levels: int) -> tuple[list[str], list[str]]:
    """(nodes after so many levels, path of each node up to them).

    A path holds, for each level from below, the digests left and right of the
    node in its run, as ``left|right``, levels apart by ``/``.
    """
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), nodes
    for _ in range(levels):
        for i, a in enumerate(at):
            k, first = a % RUN, a - a % RUN
            paths[i].append("".join(now[first:a]) + "|" + "".join(now[a + 1 : first + RUN]))
            at[i] = a // RUN
        now = risen(now)
    return now, ["/".join(p) for p in paths]


def risen(nodes: list[str]) -> list[str]:
    return [digest("".join(nodes[i : i + RUN])) for i in range(0, len(nodes), RUN)]


def longer(path: str, rest: str) -> str:
    return f"{path}/{rest}" if path and rest else path or rest


def folded(node: str, path: str) -> str:
    """The top that a node and its path give."""
    for step in path.split("/") if path else ():
        left, right = step.split("|")
        node = digest(left + node + right)
    return node


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Columns of each block (tree, block), as lists by name; rows come sorted by them."""
    held: dict[str, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        new = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        held = {name: held[name] + new[name] for name in new} if held else new
        key, start = list(zip(held["tree"], held["block"])), 0
        for k in range(1, len(key)):
            if key[k] != key[start]:
                yield {name: c[start:k] for name, c in held.items()}
                start = k
        held = {name: c[start:] for name, c in held.items()}
    if held:
        yield held


def _tops(batches, levels: int):
    """(tree, n, pos, node): the node above each block."""
    out = []
    for block in _blocks(batches):
        n, nodes = block["n"][0], block["node"]
        for _ in range(height(n, levels)):
            nodes = risen(nodes)
        out.append((block["tree"][0], max(1, -(-n // RUN**levels)), block["block"][0], nodes[0]))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["tree", "n", "pos", "node"])


def _paths(batches, levels: int, given):
    """Per block: its columns, and each node's path to the root and its subroot.  ``given`` has the blocks' paths, or else they come as rows of their own, first."""
    for block in _blocks(batches):
        if given is None:
            path, subroot = block["path"][0], block["subroot"][0]
            block = {name: c[1:] for name, c in block.items()}
        else:
            path, subroot = given.value[block["tree"][0], block["block"][0]]
        _, own = climb(block["node"], height(block["n"][0], levels))
        yield block, [longer(p, path) for p in own], subroot


def _inner(batches, levels: int, given):
    for block, paths, subroot in _paths(batches, levels, given):
        yield pa.RecordBatch.from_arrays([pa.array(block["tree"], pa.int64()), pa.array(block["pos"], pa.int64()), pa.array(paths, pa.string()), pa.array([subroot] * len(paths), pa.string())], names=["tree", "pos", "path", "subroot"])


def _leaves(batches, levels: int, given, root: str, kind: pa.DataType):
    for block, paths, subroot in _paths(batches, levels, given):
        folds = [folded(t or x, p) for t, x, p in zip(block["tampered"], block["node"], paths)]
        proofs = [digest(p.replace("|", "").replace("/", "")) for p in paths]
        n = len(paths)
        columns = [block["node"], [subroot] * n, [root] * n, proofs, folds]
        yield pa.RecordBatch.from_arrays([pa.array(block["doc_id"], kind), *(pa.array(c, pa.string()) for c in columns), pa.array([f == root for f in folds])], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def blocked(nodes: DataFrame, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Whole blocks of nodes in a task, in order."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def with_block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {RUN**levels}L"))


def top_paths(nodes: list) -> tuple[str, dict]:
    """(root, {(tree, pos): (path, subroot)}) of the nodes (tree, pos, node) that the driver has; tree -1 is the one over the sources."""
    by: dict = {}
    for tree, _, node in sorted(nodes):
        by.setdefault(tree, []).append(node)
    out, subroots = {}, []
    for tree, own in by.items():
        (top,), paths = climb(own, height(len(own), 99))
        subroots.append(top)
        out |= {(tree, pos): (p, None if tree < 0 else top) for pos, p in enumerate(paths)}
    (root,), above = climb(subroots, height(len(subroots), 99))
    over = dict(zip(by, above))
    return root, {at: (longer(p, over[at[0]]), top) for at, (p, top) in out.items()}


def manifest(docs: DataFrame, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``docs`` (doc_id, source, lang, n_chars, text; others are not read).

    Rows of a source are leaves in the order of doc_id, null first, rows of one
    doc_id in the order of their digests; equal rows are leaves of their own.  A null
    doc_id is not tampered with.  Texts are read once, for the leaf and the tampered
    leaf.  Blocks of 3^levels leaves reduce to a node each, and blocks of such nodes
    again, until at most ``top`` are left, whatever the number of sources; the driver
    builds the tree above those and broadcasts their paths, from which tasks finish
    the paths downwards and fold each leaf.  An empty table gives no rows.
    """
    spark, text, made = docs.sparkSession, F.col("text"), []
    head = F.concat(*(piece(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")))
    leaf = lambda t: F.sha2(F.concat(head, piece(t)), 256)
    changed = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(text, F.lit("\n"))
    src = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    rows = docs.select("doc_id", src.alias("src"), leaf(text).alias("node"), F.when(changed, leaf(F.replace(text, F.lit("\n"), F.lit("")))).alias("tampered"))
    rows = prefix_sums(rows, "src", F.lit(1).cast("long"), [F.col("doc_id").asc_nulls_first(), "node"], made, lambda sources: numbered(sources, "src", made))
    rows = rows.select("doc_id", "node", "tampered", F.col("place").alias("tree"), F.col("before").alias("pos"), F.col("whole").alias("n"))
    steps, old = [cut(with_block(rows, levels))], made
    drop(spark, *old)
    joined, made, kind = None, [], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    schema = f"{kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    while True:
        now = cut(blocked(steps[-1].select("tree", "block", "pos", "n", "node")).mapInArrow(lambda it: _tops(it, levels), "tree long, n long, pos long, node string"), made)
        count = now.count()
        if count > top and joined is None and now.where("n > 1").isEmpty():
            joined = len(steps), now
            now = cut(now.select(F.lit(-1).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("pos"), "node"), made)
        if count <= top:
            break
        steps.append(cut(with_block(now, levels), made))
    if not count:
        return spark.createDataFrame([], schema)
    root, found = top_paths([tuple(r) for r in now.select("tree", "pos", "node").collect()])
    given, paths = spark.sparkContext.broadcast(found), None
    for k in reversed(range(len(steps))):
        if joined and joined[0] == k + 1:
            subroots = joined[1].select("tree", F.col("node").alias("subroot"))
            paths = paths.where("tree = -1").drop("tree", "subroot").join(subroots, F.col("pos") == F.col("tree")).select("tree", F.lit(0).cast("long").alias("pos"), "path", "subroot")
        nodes = steps[k]
        if given is None:
            nodes = nodes.unionByName(paths.select("tree", F.col("pos").alias("block"), "path", "subroot"), allowMissingColumns=True)
        nodes = blocked(nodes, (F.col("pos").asc_nulls_first(),))
        if k:
            paths, given = cut(nodes.mapInArrow(lambda it, g=given: _inner(it, levels, g), "tree long, pos long, path string, subroot string"), made), None
    at = to_arrow_type(docs.schema["doc_id"].dataType)
    return nodes.mapInArrow(lambda it: _leaves(it, levels, given, root, at), schema)
