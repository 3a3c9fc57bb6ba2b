"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is turned by fixed random rotations and keeps the signs: a binary code. Stored
with it are the correction factors, for each rotation the inner product of the turned
vector with its code. The inner product of another vector with the code, over the factor, is
an unbiased estimate of that of the two vectors, with a known bound on its error; only pairs
whose upper bound reaches the threshold are computed exactly, in double precision.

Pairs to estimate come from tables: each table takes some of the code's bits as its bucket.
Their numbers follow from the row count, so that a bucket holds about BUCKET rows of spread
data and a pair at the threshold shares a bucket in some table with probability 1 - MISS.
Equal vectors are one before that. A bucket of more than CELL rows is split in blocks that meet
pairwise in tasks of their own; tasks return counts and a spanning forest, not pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as
do rows without an id; only vectors of one length are compared. Equal vectors in rows of
their own link with each other. Repeated rows count as separate vectors of one id. Ties do not matter: a
component is named by its least id, and a cosine of just the threshold links. An empty table gives no rows. Labels and other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, written
from .components import components
from .ngram_join import _Forest as Forest

BUCKET = 1000
CELL = 4000
MISS = 1e-4
#: Bits of a code at least.
CODE_BITS = 256
#: Standard errors that an estimate's bound allows for.
CONFIDENCE = 4.0
_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def plan_tables(rows: int, threshold: float) -> tuple[int, int]:
    """(bits of a table, tables)."""
    same = 1 - math.acos(threshold) / math.pi
    bits = max(2, round(math.log2(max(rows, 1) / BUCKET))) if rows > BUCKET else 2
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - same**bits)))


def rotations(dim: int, bits: int) -> np.ndarray:
    """(count, dim, dim) random orthonormal matrices that give at least `bits` bits."""
    count = -(-bits // dim)
    if (dim, count) not in _ROTATIONS:
        rng = np.random.default_rng(dim)
        _ROTATIONS[dim, count] = np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])
    return _ROTATIONS[dim, count]


def encode(unit: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(signs as 0 and 1, correction factors by rotation) of unit vectors."""
    turned = np.einsum("nd,rde->nre", unit, rotations(unit.shape[1], bits))
    factors = np.abs(turned).sum(2) / math.sqrt(unit.shape[1])
    return (turned > 0).reshape(len(unit), -1).astype(np.uint8), factors


def unit_of(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision."""
    unit = rows.astype(np.float64)
    unit /= np.abs(unit).max(1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    return unit


def _vectors(column: pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offs = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[s:e] for s, e in zip(offs, offs[1:], strict=False)]


def cell_links(ids: np.ndarray, unit: np.ndarray, code: np.ndarray, factors: np.ndarray, times: np.ndarray, side: np.ndarray, table: int, bits: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]], int]:
    """(links of each row here, spanning edges as row numbers, pairs computed exactly) of one cell.

    A pair counts in the first table that brings it together. side: as in a self-join of
    blocks, 2 for all pairs, else only pairs across.
    """
    n, dim = unit.shape
    count, edges, exact = np.zeros(n, np.int64), [], 0
    forest = Forest(n)
    turn = rotations(dim, code.shape[1])
    rots = turn.shape[0]
    signs = (code.astype(np.float32) * 2 - 1).reshape(n, rots, dim) / (math.sqrt(dim) * rots * factors[:, :, None].astype(np.float32))
    signs = signs.reshape(n, -1)
    error = CONFIDENCE * np.sqrt(((1 - factors**2) / factors**2).mean(1) / (rots * max(1, dim - 1)))
    tables = code[:, : (table + 1) * bits].reshape(n, table + 1, bits)
    key = (tables * (1 << np.arange(bits))).sum(2)  # its bucket in this table and those before
    for s in range(0, n, 512):
        part = np.arange(s, min(n, s + 512))
        turned = np.einsum("nd,rde->nre", unit[part], turn).reshape(len(part), -1).astype(np.float32)
        estimate = turned @ signs.T
        ok = estimate + error[None, :] >= threshold
        ok &= np.arange(n)[None, :] < part[:, None]
        if side[0] != 2 or (side != side[0]).any():
            ok &= side[part][:, None] != side[None, :]
        x, y = np.nonzero(ok)
        x = part[x]
        for at in range(0, len(x), 1 << 16):
            a, b = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
            exact += len(a)
            ok2 = np.einsum("nd,nd->n", unit[a], unit[b]) >= threshold
            a, b = a[ok2], b[ok2]
            if table:
                new = ~(key[a, :table] == key[b, :table]).any(1)
                a, b = a[new], b[new]
            count += np.bincount(a, times[b], minlength=n).astype(np.int64) + np.bincount(b, times[a], minlength=n).astype(np.int64)
            apart = forest.roots(a) != forest.roots(b)
            edges += [(int(i), int(j)) for i, j in zip(a[apart], b[apart], strict=True) if forest.join(int(i), int(j))]
    return count, edges, exact


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each vector."""
    # vectors travel as they came: single precision loses nothing where that is their type
    kept = np.float32 if vectors.schema[vector_col].dataType.elementType == T.FloatType() else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    bad = F.col("id").isNull() | F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (F.coalesce(size, F.lit(0.0)) == 0)
    rows = rows.withColumn("v", F.when(~bad, F.col("v")))
    own = written(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("times")))
    bits, tables = plan_tables(own.count(), threshold)
    width = max(CODE_BITS, bits * tables)

    def codes(batches):
        for batch in batches:
            out = {k: [] for k in ("rep", "times", "dim", "v", "code", "factors", "keys")}
            found = _vectors(batch.column(2))
            dims = np.array([len(v) for v in found])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                raw = np.stack([found[k] for k in at])
                code, factors = encode(unit_of(raw), width)
                packed = np.packbits(code, axis=1)
                keys = (code[:, : bits * tables].reshape(len(at), tables, bits).astype(np.int64) << np.arange(bits)).sum(2)
                out["rep"] += batch.column(0).take(pa.array(at)).to_pylist()
                out["times"] += batch.column(1).take(pa.array(at)).to_pylist()
                out["dim"] += [int(dim)] * len(at)
                out["v"] += [u.astype(kept).tobytes() for u in raw]
                out["code"] += [c.tobytes() for c in packed]
                out["factors"] += [f.tobytes() for f in factors.astype(np.float32)]
                out["keys"] += keys.tolist()
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], names=list(out))

    coded = own.select("rep", "times", "v").mapInArrow(codes, "rep long, times long, dim int, v binary, code binary, factors binary, keys array<long>")
    spread = coded.select("rep", "times", "dim", "v", "code", "factors", F.posexplode("keys").alias("table", "bucket"))
    full = coded.select("dim", F.posexplode("keys").alias("table", "bucket")).groupBy("dim", "table", "bucket").agg(F.count("*").alias("m")).where(f"m > {CELL}")
    spread = spread.join(few(full), ["dim", "table", "bucket"], "left").withColumn("blocks", F.ceil(F.coalesce("m", F.lit(1)) / CELL).cast("int"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = spread.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("m", "blocks", "other")

    def meet(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        get = lambda c: cell.column(c).to_numpy()
        dim, reps, n = int(get("dim")[0]), get("rep"), cell.num_rows
        unit = unit_of(np.frombuffer(b"".join(cell.column("v").to_pylist()), kept).reshape(n, dim))
        wide = -(-width // dim) * dim
        code = np.unpackbits(np.frombuffer(b"".join(cell.column("code").to_pylist()), np.uint8).reshape(n, -1), axis=1)[:, :wide]
        factors = np.frombuffer(b"".join(cell.column("factors").to_pylist()), np.float32).reshape(n, -1).astype(np.float64)
        i, j = get("i")[0], get("j")[0]
        side = np.full(n, 2) if i == j else (get("block") == i).astype(int)
        count, edges, _ = cell_links(reps, unit, code, factors, get("times"), side, int(get("table")[0]), bits, threshold)
        has = np.flatnonzero(count)
        a = np.concatenate([reps[has], reps[[e[0] for e in edges]]]) if len(has) else np.zeros(0, np.int64)
        b = np.concatenate([np.full(len(has), -1), reps[[e[1] for e in edges]]]) if len(has) else np.zeros(0, np.int64)
        c = np.concatenate([count[has], np.full(len(edges), -1)]) if len(has) else np.zeros(0, np.int64)
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "links": c.astype(np.int64)})

    met = written(cells.groupBy("dim", "table", "bucket", "i", "j").applyInArrow(meet, "a long, b long, links long"))
    counts = met.where("links >= 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(met.where("links < 0").select("a", "b")).withColumnRenamed("id", "rep")
    known = own.join(counts, "rep", "left").join(groups, "rep", "left").select("v", "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(known, "v", "left")
    component = F.coalesce("component", "id")
    links = F.when(F.col("component").isNull(), F.lit(0)).otherwise(F.col("links") + F.col("times") - 1)
    return out.select(F.col("id").alias(id_col), links.cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
