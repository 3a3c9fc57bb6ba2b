"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's size is its number of words. Sources share all words by weight; a target
stops at a multiple of its source's size, and the excess is shared again by weight. With w
the weights and s the sizes this is min(cap * s, level * w) for one level, found from sums
over the sources by cap / weight: no loop.

A source's target is filled by whole epochs first. For the rest, each document has the
key -ln(u) / quality, u from a hash of the row, and documents are taken by ascending key
until the words are enough; the last one is taken in part. Where that is comes from sums by
range of the key's logarithm, finer and finer within the range that holds the end; after
the last level a range is a 2^-33rd of a key wide and only its rows are sorted, so a source with
most of the rows is never in one task, whatever its keys.

A null text has size 0, a null source is a source of its own and comes last. A source
without words has target 0. Null ids are ids like others. Equal keys are put in order by id; copies of
a row may change places, with the same totals, and are numbered in shares where the row at a source's end has very many. An
empty table gives no rows. Long texts are read once for their size, quality and hash. Other columns, whatever their names,
are not read, or carried along whole. Reruns agree: nothing is drawn, all is hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, written

#: Ranges of a unit of a key's logarithm at the last level, as a power of two, and the levels' shifts.
FINE, SHIFTS = 33, (30, 15, 0)
#: Rows at the ends of sources that are put in order as they are; of more, copies are counted first.
SHARE = 100_000


def size_of(text: Column) -> Column:
    """Number of words, runs of other characters than 0x09-0x0D and 0x20."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("level", F.col("most") / F.col("weight"))
    below = Window.orderBy("level", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    capped, used = F.coalesce(F.sum("most").over(below), F.lit(0.0)), F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    total, weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    # the level at which this source and those above it would share what those below leave;
    # the first source that it leaves under its cap has the right one, later ones have less
    ranked = ranked.withColumn("share", (total - capped) / (weight - used))
    level = F.coalesce(F.max(F.when(F.col("share") <= F.col("level"), F.col("share"))).over(everything), F.lit(0.0))
    return ranked.select("source", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def _in_shares(edge: DataFrame) -> DataFrame:
    """edge (of, key, id, size, before, ...), rows at the ends of sources, with `done`, the words before each.

    Only copies of a row can be so many in so small a range. They are counted and numbered in shares, each a
    task's work, so that what is put in order is one row for each different one.
    """
    own, free = ["of", "key", "id", "size"], Window.unboundedPreceding
    edge = edge.withColumn("share", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-edge.count() // SHARE))))
    edge = written(edge.withColumn("own", F.struct(*own)))
    counts = edge.groupBy("own", "share").agg(F.count("*").alias("m"))
    each = counts.groupBy("own").agg((F.sum("m") * F.col("own.size")).alias("words"))
    line = Window.partitionBy("own.of").orderBy("own.key", "own.id", "own.size").rowsBetween(free, -1)
    each = each.select("own", F.coalesce(F.sum("words").over(line), F.lit(0)).alias("ahead"))
    along = Window.partitionBy("own").orderBy("share").rowsBetween(free, -1)
    counts = counts.select("own", "share", F.coalesce(F.sum("m").over(along), F.lit(0)).alias("copies")).join(each, "own")
    turn = F.row_number().over(Window.partitionBy("own", "share").orderBy("size")) - 1
    done = F.col("before") + F.col("ahead") + (F.col("copies") + turn) * F.col("size")
    return edge.join(counts, ["own", "share"]).withColumn("done", done).drop("own", "share", "ahead", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, carry: bool = False) -> DataFrame:
    """(id_col, size, source_size, target, taken, epochs): the words the mix takes of each document.

    With carry, a column `row` holds the document's own columns.

    quality is a positive weight for a document within its source's last, partial epoch.
    epochs is the number of whole copies; taken - epochs * size words come from a further one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(source_col).cast("string"), F.lit("")), text).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    key = -F.log(u) / F.greatest(F.coalesce(quality if quality is not None else F.lit(1.0), F.lit(1.0)), F.lit(1e-6))
    every = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"), key.alias("key"), *[F.struct("*").alias("row")] * carry)
    every = every.withColumn("bin", F.floor(F.log("key") * float(1 << FINE)).cast("long"))
    rows = written(every.drop("row"))
    every = every if carry else rows
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), cap)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goal = written(goal.select(F.col("source").alias("of"), "source_size", "target", "epochs", "rest"))
    named = F.col("source").eqNullSafe(F.col("of"))
    # the range in which the rest ends, and the words before it; none where the rest is 0
    ends = goal.where("rest > 0").select("of", "rest", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("last"))
    for level, shift in enumerate(SHIFTS):
        inside = rows.join(few(ends), named)
        if level:
            inside = inside.where(F.shiftright("bin", SHIFTS[level - 1]) == F.col("last"))
        ranges = inside.groupBy("of", "rest", "before", F.shiftright("bin", shift).alias("part")).agg(F.sum("size").alias("words"))
        through = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(through), F.lit(0)))
        ends = written(ranges.where("before < rest AND before + words >= rest").select("of", "rest", "before", F.col("part").alias("last")))
    ends = ends.select(F.col("of").alias("s"), "before", "last")
    goal = goal.join(few(ends), F.col("of").eqNullSafe(F.col("s")), "left").drop("s")
    with_goal = every.join(few(goal), named)
    at_end = F.coalesce(F.col("bin") == F.col("last"), F.lit(False))
    inside = with_goal.where(~at_end).withColumn("part", F.when(F.col("bin") < F.col("last"), F.col("size")).otherwise(0))
    order = Window.partitionBy("of").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = written(with_goal.where(at_end))
    if edge.count() <= SHARE:
        edge = edge.withColumn("done", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    else:
        edge = _in_shares(edge)
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("done")))).drop("done")
    both = inside.unionByName(edge)
    return both.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "epochs", *["row"] * carry)


def plainness(text: Column) -> Column:
    """A quality: 1 for words of usual length, less the longer they are."""
    return F.least(F.lit(1.0), 6.5 * size_of(text) / F.greatest(F.length(text), F.lit(1)))


def mixed_documents(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that the mix takes, one for each copy. The document that fills a target is taken
    whole if at least half of it is wanted, else not: no text is cut."""
    taken = mix(docs, text_col=text_col, carry=True, **how)
    part = F.col("taken") - F.col("epochs") * F.col("size")
    copies = F.col("epochs") + F.when((part > 0) & (2 * part >= F.col("size")), 1).otherwise(0)
    rows = taken.withColumn("copies", copies).where("size > 0 AND copies > 0")
    rows = rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
