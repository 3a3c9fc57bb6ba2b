"""Merkle manifest of a table: a tree of digests by superblocks, with a proof for every row.

A row's leaf hashes its columns. The leaves of a group (a null one is a group of its own and comes first), in order of
id, are reduced: every FANOUT consecutive nodes become their hash, level by level, until one is left;
the groups' roots, in order of group, are reduced likewise to the root.

Rows are numbered within their group by a range partitioning on (group, id) and the sizes of its partitions, so
a group of any size is spread over many tasks. A superblock is what LEVELS levels make one node of: indices divided
by FANOUT ** LEVELS. applyInPandas collapses the superblocks of one level, several of them in one group of
about ROWS rows, and their roots are reduced in the same way again, so there are a few rounds whatever
the size. Proofs then come down: each superblock is put next to the proof of its root, which is
added to the siblings inside it.

Rows of one id are in order of leaf; repeated rows are leaves of their own, side by side. Null ids come first.
Any column may be null or empty. An empty table gives no rows. Long texts are hashed once, before anything is
shuffled, so only digests travel. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, written

FANOUT, LEVELS = 3, 7
#: Rows that one call of Python collapses on average.
ROWS = 20_000


def digest_of(*cols: Column) -> Column:
    """SHA-256 of columns: `-` for a null, else the bytes of its text, a colon and the text."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in cols]), 256)


def joined(digests: list[bytes]) -> bytes:
    """The node over digests, all of them hexadecimal."""
    return sha256(b"".join(digests)).hexdigest().encode()


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows with idx, their number within their tree by `order`, and n, the tree's rows."""
    kind = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("idx", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if batch.num_rows:
                names = batch.column(batch.schema.get_field_index(tree)).to_numpy(zero_copy_only=False)
                new = np.append(True, names[1:] != names[:-1])
                first = np.flatnonzero(new)
                idx = np.arange(len(names)) - np.repeat(first, np.diff(np.append(first, len(names))))
                if names[0] == last:
                    idx[: first[1] if len(first) > 1 else len(names)] += at
                last, at = names[-1], int(idx[-1]) + 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(names), part, np.int32)), pa.array(idx)], names=kind.names)

    # equal rows may be parted anywhere
    own = rows.withColumn("_own", F.monotonically_increasing_id())
    placed = own.repartitionByRange(tree, *order, "_own").sortWithinPartitions(tree, *order, "_own").drop("_own")
    placed = written(placed.mapInArrow(run, kind))
    sizes = placed.groupBy(tree, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("n", F.sum("_size").over(Window.partitionBy(tree))).drop("_size")
    return placed.join(few(written(sizes)), [tree, "_part"]).withColumn("idx", F.col("idx") + F.col("_before")).drop("_part", "_before")


class _Block:
    """The levels of superblocks in a frame with tree, idx, n and digest, in order of tree and idx."""

    def __init__(self, rows: pd.DataFrame, levels: int):
        tree = rows["tree"].to_numpy()
        code = np.cumsum(np.append(False, tree[1:] != tree[:-1])) if len(tree) else np.zeros(0, int)
        idx, n = rows["idx"].to_numpy(), rows["n"].to_numpy()
        digests = [d.hex().encode() for d in rows["digest"]]
        #: By level, from the rows up: (digests, first node of each run of siblings, run of each node).
        self.levels: list[tuple[list[bytes], np.ndarray, np.ndarray]] = []
        first = np.arange(len(rows))
        for _ in range(levels):
            if not (n > 1).any():
                break
            above = idx // FANOUT
            new = np.append(True, (code[1:] != code[:-1]) | (above[1:] != above[:-1]))
            starts = np.flatnonzero(new)
            self.levels.append((digests, starts, np.cumsum(new) - 1))
            ends = np.append(starts[1:], len(digests))
            # a tree of one node is done
            digests = [joined(digests[a:b]) if more else digests[a] for a, b, more in zip(starts.tolist(), ends.tolist(), (n[starts] > 1).tolist(), strict=True)]
            code, idx, n, first = code[starts], above[starts], -(-n[starts] // FANOUT), first[starts]
        self.digests, self.idx, self.n, self.first = digests, idx, n, first

    def proofs(self, upper: list[bytes]) -> list[bytes]:
        """The siblings of each row, level by level, then those of its superblock's root."""
        for digests, starts, run in reversed(self.levels):
            ends = np.append(starts[1:], len(digests))
            upper = [b"".join(digests[a:j]) + b"".join(digests[j + 1 : b]) + upper[r] for j, (r, a, b) in enumerate(zip(run.tolist(), starts[run].tolist(), ends[run].tolist(), strict=True))]
        return upper


def _packed(nodes: DataFrame, block: Column, rows: int) -> DataFrame:
    return nodes.withColumn("block", block).withColumn("pack", F.pmod(F.xxhash64("tree", "block"), F.lit(max(1, -(-rows // ROWS)))))


def _block() -> Column:
    return F.call_function("div", F.col("idx"), F.lit(FANOUT**LEVELS))


def reduced(nodes: DataFrame) -> list[DataFrame]:
    """nodes (tree, idx, n, digest, ...) and, in turn, the roots of their superblocks, until each tree has one node."""

    def collapse(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tree", "idx"], ignore_index=True)
        block = _Block(rows, LEVELS)
        return pd.DataFrame({"tree": rows["tree"].to_numpy()[block.first], "idx": block.idx, "n": block.n, "digest": [bytes.fromhex(d.decode()) for d in block.digests]})

    out = [nodes]
    while True:
        most, rows = out[-1].agg(F.max("n"), F.count("*")).first()
        if (most or 0) <= 1:
            return out
        each = _packed(out[-1].select("tree", "idx", "n", "digest"), _block(), rows)
        out.append(written(each.groupBy("pack").applyInPandas(collapse, "tree string, idx long, n long, digest binary")))


def _descend(names: list[str], extra: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Puts the nodes of superblocks next to what their roots have: proofs get longer, the columns `extra` are copied."""

    def run(low: pd.DataFrame, high: pd.DataFrame) -> pd.DataFrame:
        low = low.sort_values(["tree", "idx"], ignore_index=True)
        block = _Block(low, LEVELS)
        # both sides have the same superblocks, so in the same order
        high = high.sort_values(["tree", "block"], ignore_index=True)
        of = np.repeat(np.arange(len(high)), np.diff(np.append(block.first, len(low))))
        low["proof"] = [bytes.fromhex(p.decode()) for p in block.proofs([p.hex().encode() for p in high["proof"]])]
        for c in extra:
            low[c] = high[c].to_numpy()[of]
        return low[names]

    return run


def with_proofs(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The first level's rows with their proof (digests by 32 bytes), and the columns of top.

    top: (tree, proof, ...), a row for each tree, the proof of its root in what is above it.
    """
    extra = [c for c in top.columns if c not in ("tree", "proof")]
    above = levels[-1].join(top, "tree")
    for nodes in reversed(levels[:-1]):
        own = nodes.columns if nodes is levels[0] else ["tree", "idx"]
        fields = [*(nodes.schema[c] for c in own), *(top.schema[c] for c in ("proof", *extra))]
        rows = nodes.count()
        descend = _descend([f.name for f in fields], extra)
        lower = _packed(nodes, _block(), rows).groupBy("pack")
        upper = _packed(above.select("tree", F.col("idx").alias("at"), "proof", *extra), F.col("at"), rows).groupBy("pack")
        above = lower.cogroup(upper).applyInPandas(descend, T.StructType(fields))
        if nodes is not levels[0]:
            above = written(above)
    return above


def manifest(docs: DataFrame, leaf: Column, tree: Column, id_col: str = "doc_id", **more: Column) -> DataFrame:
    """(id_col, leaf, subroot, root, proof, path, *more) of each row of docs.

    leaf: a row's digest; tree: the group that it is in, as a string. proof: the siblings' digests from the leaf to the
    root, 32 bytes each; path: (idx, n) of the leaf in its group and of the group among all.
    """
    group = F.coalesce(F.concat(F.lit("1"), tree.cast("string")), F.lit("0"))
    rows = docs.select(F.col(id_col).alias("id"), group.alias("tree"), F.unhex(leaf).alias("digest"), *[c.alias(f"more_{k}") for k, c in more.items()])
    leaves = reduced(written(numbered(written(rows), "tree", "id", "digest")))
    groups = leaves[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = reduced(written(numbered(groups, "tree", "name")))
    root = tops[-1].select("tree", F.lit(b"").alias("proof"), F.col("digest").alias("root"))
    top = with_proofs(tops, root).select(F.col("name").alias("tree"), "proof", F.col("digest").alias("subroot"), "root", F.col("idx").alias("g_idx"), F.col("n").alias("g_n"))
    every = with_proofs(leaves, written(top))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    path = F.array(F.struct("idx", "n"), F.struct(F.col("g_idx").alias("idx"), F.col("g_n").alias("n")))
    return every.select(F.col("id").alias(id_col), text("digest").alias("leaf"), text("subroot"), text("root"), "proof", path.alias("path"), *[F.col(f"more_{k}").alias(k) for k in more])


def fold(digest: str, proof: bytes, path: list) -> str:
    """The root that a leaf and its proof lead to."""
    now, at = digest.encode(), 0
    for idx, n in path:
        while n > 1:
            place = idx % FANOUT
            size = min(FANOUT, n - idx + place) - 1
            left, right = (proof[a : a + 32 * w].hex().encode() for a, w in ((at, place), (at + 32 * place, size - place)))
            now, at = joined([left, now, right]), at + 32 * size
            idx, n = idx // FANOUT, -(-n // FANOUT)
    return now.decode()


def folded(leaf: Column, proof: Column, path: Column) -> Column:
    """fold() of columns."""

    @F.pandas_udf("string")
    def run(leaf: pd.Series, proof: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([fold(d, p, [(x["idx"], x["n"]) for x in steps]) for d, p, steps in zip(leaf, proof, path, strict=True)], dtype=object)

    return run(leaf, proof, path)
