"""Exact Jaccard self-join on word shingles with a count-vector R-tree.

A document's set holds its distinct five-word shingles. Two sets link when a hundred times
their intersection is at least seventy-five times their union.

1. Equal sets become one vertex, known by a 64-bit hash of the set, before anything is shuffled
   by shingle: a group of copies costs one vertex. Shingles are 51-bit hashes; what is verified
   is the index of those, so a false link takes colliding hashes.
2. Under any fixed order of shingles, two linked sets share one of their first
   n - ceil(0.75 n) + 1 shingles. The order used puts the most frequent shingles last (a
   bounded list of heavy ones), so common lines and passages hardly bring sets together.
3. A shingle stands for one set that has it, its leader: the set of least hash among those that
   have it early, or, of a heavy shingle of HOT rows or more, among all that the count of
   heavy ones has seen, so that those never meet by shingle. Sets of one leader are a group; linked sets are in one together.
   Near copies have the same few leaders, so a set is in few groups.
4. In a group each set is a point: its shingles counted in hashed columns, about a third as many
   as it has shingles. A bulk-loaded R-tree keeps for each node the largest count by column; the
   overlap of a set with any set below the node is at most the sum of the smaller of the
   counts, which drops nodes and then points. Only sets that are left with a partner go on with
   their shingles: surviving pairs whose sets are not yet linked through others are verified
   exactly, and only the links of a spanning forest leave the task.
5. A group beyond GROUP_SETS is dealt into blocks, each with the leader. What a block links with
   the leader is linked across blocks; what is left over meets every other block. So a
   large group of near copies costs its size, not its square.

A null or empty text, and one without words, has an empty set and links with nothing.
A row whose id is null gets no component. Repeated rows have the same set, so they link; equal ids
with different texts stay different rows. Very long texts have long sets and are never cut. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, written
from .components import components
from .textblock import SHINGLE_BITS, column_bytes, mix, runs, shingle_sets, slices

#: Sets of one group that meet in one task.
GROUP_SETS = 1000
#: Heavy shingles that are put last in the order; the list is broadcast.
HEAVY = 1 << 17
#: Occurrences in one batch that bring a shingle to the count of heavy ones.
HEAVY_LOCAL = 4
#: Rows from which on a shingle's sets do not meet by shingle.
HOT = 1 << 18
#: Bytes of sets that one task of step 4 gets on average.
BUCKET_BYTES = 6 << 20
#: First shingles that one task of step 3 gets on average.
BUCKET_KEYS = 1 << 19
#: Counts of all points of a group at most; more sets have coarser points.
POINT_COUNTS = 1 << 23
#: Points that one task gets on average.
BUCKET_POINTS = 1 << 14
NODE = 16


def _per_text(texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, first) by text of a column that is sorted by text."""
    count = np.bincount(texts, minlength=n)
    return count, np.cumsum(count) - count


def set_hashes(ids: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each text's set; 0 for the empty set."""
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    count, first = _per_text(texts, n)
    h = mix(total[first + count] - total[first] + count.astype(np.uint64))
    return np.where(count > 0, h.astype(np.int64), 0)


def _sets(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = column_bytes(batch.column(column))
    for a, b in slices(offs):
        yield a, b, *shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], size)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *parts])


def point_width(n: np.ndarray) -> np.ndarray:
    """Columns that a set of n shingles is counted in: a power of two near n / 4."""
    return 1 << np.clip(np.floor(np.log2(np.maximum(n, 1) / 3)).astype(np.int64), 3, 16)


def _points(ids: np.ndarray, texts: np.ndarray, n: int) -> list[bytes]:
    """Each text's count vector: a byte for a column, or four where a count needs them."""
    width = point_width(np.bincount(texts, minlength=n))
    first = np.cumsum(width) - width
    flat = np.bincount(first[texts] + (ids & (width[texts] - 1)), minlength=int(width.sum()))
    small, wide = flat.astype(np.uint8), flat.max(initial=0) > 255
    return [flat[s : s + w].astype(np.int32).tobytes() if wide and flat[s : s + w].max() > 255 else small[s : s + w].tobytes() for s, w in zip(first.tolist(), width.tolist(), strict=True)]


def _binary(*cols: np.ndarray) -> bytes:
    return np.stack(cols).astype(np.int64).tobytes()


def set_table(docs: DataFrame, id_col: str, text_col: str, size: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *extra, n_shingles, set, point, often): each document's set size, set hash and count vector; of
    each batch one row has in `often` the shingles that HEAVY_LOCAL rows or more of the batch have, how many, and the least such set."""
    keep = [id_col, *extra]

    def run(batches):
        for batch in batches:
            ids, rows, points = [], [], []
            for a, b, part, texts in _sets(batch, len(keep), size):
                ids.append(part)
                points += _points(part, texts, b - a)
                rows.append((np.bincount(texts, minlength=b - a), set_hashes(part, texts, b - a)))
            if not rows:
                continue
            # sets by their hashes, so that a shingle's first occurrence is in the least of them
            flat, size_of, names = _joined(ids), _joined([r[0] for r in rows]), _joined([r[1] for r in rows])
            by = np.argsort(names, kind="stable")
            begin = (np.cumsum(size_of) - size_of)[by]
            ends = np.cumsum(size_of[by])
            flat = flat[np.arange(len(flat)) + np.repeat(begin - ends + size_of[by], size_of[by])]
            shingle, first, n = np.unique(flat, return_index=True, return_counts=True)
            often = n >= HEAVY_LOCAL
            packed = [None] * batch.num_rows
            packed[0] = _binary(shingle[often], n[often], names[by][np.searchsorted(ends, first[often], "right")])
            cols = [*batch.columns[: len(keep)], pa.array(size_of), pa.array(names), pa.array(points, pa.binary()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_shingles", "set", "point", "often"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_shingles", T.LongType()), T.StructField("set", T.LongType()), T.StructField("point", T.BinaryType()), T.StructField("often", T.BinaryType())])
    return docs.select(*keep, text_col).mapInArrow(run, schema)


def heavy_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, hot ones, their leaders): at most HEAVY shingles, those that batches have seen most often,
    and among them those with HOT rows or more, both ascending."""

    def run(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                shingle, n, leader = np.frombuffer(x, np.int64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(n), pa.array(leader)], names=["id", "n", "leader"])

    counted = sets.where("often IS NOT NULL").select("often").mapInArrow(run, "id long, n long, leader long")
    top = counted.groupBy("id").agg(F.sum("n").alias("n"), F.min("leader").alias("leader")).orderBy(F.desc("n"), "id").limit(HEAVY)
    got = top.select("id", "leader", "n").toArrow()
    ids, leaders, n = (got.column(k).to_numpy().astype(np.int64) for k in range(3))
    order = np.argsort(ids)
    hot = order[n[order] >= HOT]
    return ids[order], ids[hot], leaders[hot]


def first_shingles(ids: np.ndarray, texts: np.ndarray, n: int, heavy: np.ndarray, percent: int) -> np.ndarray:
    """Which shingles are among the first of their set, heavy ones last, that a link must share."""
    count, first = _per_text(texts, n)
    at = np.minimum(np.searchsorted(heavy, ids), max(0, len(heavy) - 1))
    late = heavy[at] == ids if len(heavy) else np.zeros(len(ids), bool)
    before = np.cumsum(~late) - ~late  # light ones before this one, over all texts
    start = np.concatenate([before, [int((~late).sum())]])[np.minimum(first, len(ids))]
    light = np.bincount(texts[~late], minlength=n)
    rank_light = before - start[texts]
    rank = np.where(late, light[texts] + (np.arange(len(ids)) - first[texts]) - rank_light, rank_light)
    return rank < (count - -(-percent * count // 100) + 1)[texts]


def _distinct_pairs(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])]) if len(keys) else np.zeros(0, bool)
    return keys[new], sets[new]


def led_sets(docs: DataFrame, sets: DataFrame, text_col: str, size: int, percent: int, buckets: int) -> DataFrame:
    """(leader, set): the groups. Shingles travel as arrays of numbers by range of the shingle's hash."""
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_shingles(sets))
    step = (1 << SHINGLE_BITS) // buckets + 1

    def dealt(leader: np.ndarray, led: np.ndarray, above: int) -> list[tuple[int, bytes, bytes]]:
        """Pairs in buckets from `above` on, by their hash."""
        turn = (mix(leader.astype(np.uint64) + mix(led.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(turn, kind="stable")
        turn = turn[order]
        return [(above + int(turn[s]), leader[order[s:e]].tobytes(), led[order[s:e]].tobytes()) for s, e in runs(turn)]

    def first(batches):
        for batch in batches:
            keys, names = [], []
            for a, b, ids, texts in _sets(batch, 0, size):
                own = set_hashes(ids, texts, b - a)
                _, once = np.unique(own, return_index=True)
                use = np.zeros(b - a, bool)
                use[once] = True
                keep = first_shingles(ids, texts, b - a, heavy.value[0], percent) & use[texts]
                keys.append(ids[keep])
                names.append(own[texts[keep]])
            keys, names = _distinct_pairs(_joined(keys), _joined(names))
            _, hot, leaders = heavy.value
            at = np.minimum(np.searchsorted(hot, keys), max(0, len(hot) - 1))
            known = hot[at] == keys if len(hot) else np.zeros(len(keys), bool)
            leader, led = _distinct_pairs(leaders[at[known]], names[known])
            keys, names = keys[~known], names[~known]
            cut = np.searchsorted(keys, np.arange(buckets + 1) * step)
            rows = [(k, keys[s:e].tobytes(), names[s:e].tobytes()) for k, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if e > s]
            # those of a hot shingle have their leader already
            rows += dealt(leader, led, buckets)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "sets"])

    def meet(table: pa.Table) -> pa.Table:
        keys, names = (_joined([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("keys", "sets"))
        keys, names = _distinct_pairs(keys, names)
        if table.num_rows and table.column("bucket")[0].as_py() < buckets and len(keys):
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(start, len(keys)))
            leader, shared = np.repeat(names[start], sizes), np.repeat(sizes, sizes) > 1  # names ascend within a key
            keys, names = _distinct_pairs(leader[shared], names[shared])
        rows = dealt(keys, names, 0)
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("bucket", pa.int32()), ("keys", pa.binary()), ("sets", pa.binary())))})

    def distinct(table: pa.Table) -> pa.Table:
        keys, names = _distinct_pairs(*(_joined([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("keys", "sets")))
        other = keys != names
        return pa.table({"leader": keys[other], "set": names[other]})

    schema = "bucket int, keys binary, sets binary"
    # the same pair comes from many shingles: pairs travel as arrays, too, until they are single
    met = docs.select(text_col).mapInArrow(first, schema).groupBy("bucket").applyInArrow(meet, schema)
    pairs = met.groupBy("bucket").applyInArrow(distinct, "leader long, set long")
    return pairs.unionByName(pairs.select("leader", F.col("leader").alias("set")).distinct())


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def roots(self, xs: np.ndarray) -> np.ndarray:
        found = self.up[xs]
        while (self.up[found] != found).any():
            found = self.up[found]
        self.up[xs] = found
        return found

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class CountTree:
    """A bulk-loaded R-tree of two levels over count vectors; members are in its order."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        starts = np.arange(0, len(points), NODE)
        self.high = np.maximum.reduceat(points, starts)
        self.least, self.most = np.minimum.reduceat(sizes, starts), np.maximum.reduceat(sizes, starts)

    def within(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Members whose overlap with a set of that point may reach the threshold."""
        fits = (100 * self.most >= percent * size) & (100 * size >= percent * self.least)
        nodes = np.flatnonzero(fits)
        bound = np.minimum(self.high[nodes], point).sum(1)
        nodes = nodes[(100 + percent) * bound >= percent * (size + self.least[nodes])]
        if not len(nodes):
            return nodes
        members = (nodes[:, None] * NODE + np.arange(NODE)).ravel()
        members = members[members < len(self.points)]
        bound = np.minimum(self.points[members], point).sum(1)
        return members[(100 + percent) * bound >= percent * (size + self.sizes[members])]


def count_points(ids: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """Each set's count vector: columns are a power of two near a third of the usual size of a set."""
    width = 1 << int(np.clip(np.log2(max(1, len(ids) // max(n, 1)) / 3), 5, max(5, np.log2(POINT_COUNTS / max(n, 1)))))
    return np.bincount(texts * width + ids % width, minlength=n * width).reshape(n, width).astype(np.int32)


def with_partner(sizes: np.ndarray, points: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a group the bound leaves with a partner. Points of one width meet in an R-tree; those of
    twice the width join them folded, as sets whose sizes allow a link are that near."""
    out, width = np.zeros(len(sizes), bool), point_width(sizes)
    for w in np.unique(width).tolist():
        own = np.flatnonzero((width == w) | (width == 2 * w))
        if len(own) < 2 or not (width[own] == w).any():
            continue
        flat = np.stack([points[k].reshape(-1, w).sum(0, dtype=np.int32) for k in own])
        order = np.lexsort((flat[:, 0], sizes[own]))
        own, flat = own[order], flat[order]
        tree, thin = CountTree(flat, sizes[own]), width[own] == w
        for q in np.flatnonzero(thin):
            near = tree.within(flat[q], int(sizes[own[q]]), percent)
            if len(near) > 1:  # itself is one
                out[own[near]] = True
    return out


def spanning_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over those of all pairs; side 0 and 1: only pairs across,
    side 2 everywhere: all pairs."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    points = count_points(flat, owner, n)
    order = np.lexsort((points[:, 1], points[:, 0], sizes))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    tree = CountTree(points[order], sizes[order])
    by = np.argsort(flat, kind="stable")
    values, owners = flat[by], owner[by]
    forest, out = _Forest(n), []
    for q in order:
        near = order[tree.within(points[q], int(sizes[q]), percent)]
        near = near[place[near] < place[q]]  # each pair once
        if side[q] != 2:
            near = near[side[near] != side[q]]
        if len(near):
            near = near[forest.roots(near) != forest.root(q)]
        if not len(near):
            continue
        if len(near) <= 4:
            shared = np.array([len(np.intersect1d(sets[q], sets[m], assume_unique=True)) for m in near])
        else:
            lo, hi = np.searchsorted(values, sets[q]), np.searchsorted(values, sets[q], "right")
            runs = hi - lo
            at = np.repeat(lo - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
            shared = np.bincount(owners[at], minlength=n)[near]
        ok = 100 * shared >= percent * (sizes[q] + sizes[near] - shared)
        out += [(int(q), int(m)) for m in near[ok] if forest.join(int(q), int(m))]
    return out


def shingled(docs: DataFrame, sets: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(set, ids): the shingles of the sets that `wanted` names."""
    least = sets.where(F.col(id_col).isNotNull()).groupBy("set").agg(F.min(id_col).alias(id_col))
    wanted = wanted.join(least, "set").select(id_col, F.col("set").alias("wanted"))

    def run(batches):
        for batch in batches:
            names, found = [], []
            for a, b, ids, texts in _sets(batch, 0, size):
                own = set_hashes(ids, texts, b - a)
                count, first = _per_text(texts, b - a)
                for k in np.flatnonzero(own == batch.column(1).slice(a, b - a).to_numpy()):
                    names.append(int(own[k]))
                    found.append(ids[first[k] : first[k] + count[k]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.binary())], names=["set", "ids"])

    texts = docs.select(id_col, text_col).join(few(wanted), id_col).select(text_col, "wanted").mapInArrow(run, "set long, ids binary")
    # an id in several rows may give a set twice
    return texts.groupBy("set").agg(F.first("ids").alias("ids"))


def _group_links(table: pa.Table, percent: int, keys: tuple[str, ...], across: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, a, b, left over) of each group in a task's table: row numbers of the group's sets, row numbers of
    the ends of links, and the rows that are not linked with the leader."""
    cols = {c: table.column(c).to_numpy() for c in (*keys, "leader", "set")}
    order = np.lexsort((cols["set"], *(cols[k] for k in keys), cols["leader"]))
    ids, away = table.column("ids"), table.column("away").to_numpy(zero_copy_only=False)
    for s, e in runs(*(cols[k][order] for k in ("leader", *keys))):
        at = order[s:e]
        found = [np.frombuffer(ids[int(k)].as_py(), np.int64) for k in at]
        links = spanning_links(found, away[at].astype(np.int64) if across else np.full(len(at), 2), percent)
        a, b = (at[np.array([x[k] for x in links], np.int64)] for k in (0, 1))
        forest = _Forest(len(at))
        for x, y in links:
            forest.join(x, y)
        head = np.flatnonzero(cols["set"][at] == cols["leader"][at])
        roots = forest.roots(np.arange(len(at)))
        yield at, a, b, at[roots != roots[head[0]]] if len(head) else at


def linked_sets(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(a, b): links of a spanning forest between different sets."""
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    keys = max(1, int(total * (100 - percent) // 100 // BUCKET_KEYS))
    led = written(led_sets(docs, sets, text_col, size, percent, keys))
    sizes = led.groupBy("leader").agg(F.ceil(F.count("*") / GROUP_SETS).cast("int").alias("blocks"))
    large = few(written(sizes.where("blocks > 1")))
    points = sets.groupBy("set").agg(F.first("n_shingles").alias("n"), F.first("point").alias("point"))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, led.count() // BUCKET_POINTS + 1)
    pointed = led.join(large, "leader", "left_anti").join(points, "set").withColumn("bucket", F.pmod(F.xxhash64("leader"), F.lit(tasks)).cast("int"))

    def bound(table: pa.Table) -> pa.Table:
        table = table.sort_by("leader").combine_chunks()
        leader, n, bits = table.column("leader").to_numpy(), table.column("n").to_numpy(), table.column("point")
        keep = np.zeros(len(leader), bool)
        for s, e in runs(leader):
            raw, width = [bits[k].as_py() for k in range(s, e)], point_width(n[s:e]).tolist()
            keep[s:e] = with_partner(n[s:e], [np.frombuffer(x, np.uint8 if len(x) == w else np.int32) for x, w in zip(raw, width, strict=True)], percent)
        return table.filter(pa.array(keep)).select(["leader", "set"])

    near = written(pointed.groupBy("bucket").applyInArrow(bound, "leader long, set long"))
    led = near.unionByName(led.join(large, "leader", "left_semi"))
    full = written(shingled(docs, sets, led.select("set").distinct(), id_col, text_col, size))
    led = led.join(large, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    # the leader of a group of several blocks goes to each
    blocks = F.when(F.col("leader") == F.col("set"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
    placed = led.withColumn("block", F.explode(blocks)).join(full, "set").withColumn("away", F.lit(False))
    bytes_met = led.join(full.select("set", F.octet_length("ids").alias("n")), "set").agg(F.sum("n")).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, int(bytes_met // BUCKET_BYTES) + 1)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("leader", "block"), F.lit(buckets)).cast("int"))

    def meet(table: pa.Table) -> pa.Table:
        table, out = table.combine_chunks(), []
        names, leaders, blocks = (table.column(c).to_numpy() for c in ("set", "leader", "blocks"))
        for at, a, b, left in _group_links(table, percent, ("block",), False):
            out.append((names[a], names[b], np.zeros(len(a), bool)))
            if blocks[at[0]] > 1:
                out.append((leaders[left], names[left], np.ones(len(left), bool)))
        a, b, left = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "left": left.astype(bool)})

    met = written(placed.groupBy("bucket").applyInArrow(meet, "a long, b long, left boolean"))
    links = met.where("NOT left").select("a", "b")
    left = met.where("left").select(F.col("a").alias("leader"), F.col("b").alias("set"))
    if left.isEmpty():
        return links
    # those left over meet every other block of their group
    turns = left.groupBy("leader").agg(F.ceil(F.count("*") / GROUP_SETS).cast("int").alias("turns"))
    left = left.join(few(turns), "leader").join(large, "leader").withColumn("turn", F.pmod(F.xxhash64("set", F.lit(1)), "turns").cast("int"))
    away = left.withColumn("home", block).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block != home")
    home = placed.join(few(turns), "leader").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    cells = home.select("leader", "set", "block", "turn", "away", "ids")
    cells = cells.unionByName(away.join(full, "set").select("leader", "set", "block", "turn", F.lit(True).alias("away"), "ids"))
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("leader", "block", "turn"), F.lit(buckets)).cast("int"))

    def meet_again(table: pa.Table) -> pa.Table:
        table, out = table.combine_chunks(), []
        names = table.column("set").to_numpy()
        for _, a, b, _ in _group_links(table, percent, ("block", "turn"), True):
            out.append((names[a], names[b]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    return links.unionByName(cells.groupBy("bucket").applyInArrow(meet_again, "a long, b long"))


def component_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *extra, n_shingles, component, component_id) for each row of docs: its set's size, a name of its
    component (null without a set or an id) and the least id there, or its own id. extra: columns passed on."""
    sets = written(set_table(docs, id_col, text_col, size, extra))
    groups = components(linked_sets(docs, sets, id_col, text_col, size, percent))
    least = sets.where("n_shingles > 0").groupBy("set").agg(F.min(id_col).alias("least"))
    by_group = least.join(groups.withColumnRenamed("id", "set"), "set", "left").select("set", "least", F.coalesce("component", "set").alias("component"))
    roots = by_group.groupBy("component").agg(F.min("least").alias("component_id"))
    to = by_group.join(roots, "component").select(F.col("set").alias("_s"), "component", "component_id")
    own = (F.col("n_shingles") == 0) | F.col(id_col).isNull()
    joined = sets.withColumn("_s", F.when(~own, F.col("set"))).join(to, "_s", "left")
    return joined.select(id_col, *extra, F.col("n_shingles").cast("long").alias("n_shingles"), "component", F.coalesce("component_id", id_col).alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(id_col, n_shingles, component_id): each document's set size and the least id reachable by links."""
    return component_rows(docs, id_col, text_col, size, percent).drop("component")
