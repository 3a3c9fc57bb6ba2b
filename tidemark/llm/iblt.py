"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are hashed: its lines, cut after sentences and, within one, after every 16
words, so that a text of one long line has several, too. The set of digests is put into a sketch of cells, each
digest in one cell of each of three parts. A cell holds how many digests it has, their
exclusive or, and that of their check hashes. The difference of two sketches holds the digests
that only one text has; a cell with one left gives it away, it is taken out of its other cells,
and so on until nothing is left. If cells remain, both texts are sketched again, larger: the
smallest sketch, whose squared counts tell how many digests differ, says how many sketches the digests
are dealt to by a further hash; each of them is retried larger on its own until it can be peeled.

Everything is built-in expressions over arrays. A share that no size peels, which takes digests that
collide in all of them, is compared digest by digest, so a likeness is always known. A null text is empty; an
empty text has one empty paragraph. A paragraph that a text repeats counts once. Null ids come last, rows of one id
are in order of a hash of their text, repeated rows have equal fingerprints and follow each other. A table of one row is
its own next document, an empty one gives no rows. Very long texts are whole, with as many sketches as they
need. Other columns are not read. To find each document's next, documents are put in runs by ranges of the id; ids
that very many rows have, and null ids, are parted further by the hash of their text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, text_or_empty

#: Cells of the first sketch, which is the fingerprint, and of those tried in turn for each share of the digests.
FIRST, SIZES = 12, (24, 96, 3072)
PARTS = 3
#: The first sketch is peeled if about this many differing digests for each cell, or fewer, are expected.
HOPE = 1.2
#: Differing digests that a share is meant to have.
LOAD = 6
#: Peeling rounds of a sketch of up to so many cells, each of which takes out every digest that lies alone somewhere;
#: a sketch that needs more, which is rare, is retried larger.
ROUNDS = {24: 4, 96: 6, 1 << 30: 12}
#: Documents that one task orders on average, to find each one's next.
RUN = 4096
#: Ends of paragraphs, and the pieces of one; a word of more than 64 characters counts as several.
ENDS = r"\n|(?<=[.!?])[ \t]+|(?<=[\u3002\uff01\uff1f])"
PIECE = r"\s*(?:\S{1,64}\s*){1,16}|\s+"
_CELL = "struct<n: bigint, key: bigint, check: bigint>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def digests(text: Column) -> Column:
    cut = lambda p: F.when(p == "", F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)))
    pieces = F.flatten(F.transform(F.split(text, ENDS, -1), cut))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(1))


def _cells_of(digest: Column, size: int) -> Column:
    """The cell of each part that a digest belongs to."""
    width = size // PARTS
    places = [F.pmod(F.call_function("shiftrightunsigned", digest, F.lit(20 * part)), F.lit(width)).cast("int") for part in range(PARTS)]
    return F.array(*[place + F.lit(part * width) for part, place in enumerate(places)])


def _placed(values: Column, size: int, sign: int) -> Column:
    return F.transform(values, lambda d: F.struct(F.lit(sign).cast("long").alias("n"), d.alias("key"), _check(d).alias("check"), _cells_of(d, size).alias("at")))


def _with(a: Column, x: Column) -> Column:
    """A cell with another's content, or a digest's, put in: counts add up, the rest cancels out where it is twice."""
    return F.struct((a["n"] + x["n"]).alias("n"), a["key"].bitwiseXOR(x["key"]).alias("key"), a["check"].bitwiseXOR(x["check"]).alias("check"))


def _nothing() -> Column:
    return F.struct(*[F.lit(0).cast("long").alias(x) for x in ("n", "key", "check")])


def _cells(placed: Column, size: int) -> Column:
    cells = F.sequence(F.lit(0), F.lit(size - 1))
    return _let(placed, lambda e: F.transform(cells, lambda c: F.aggregate(F.filter(e, lambda x: F.array_contains(x["at"], c)), _nothing(), _with)))


def sketch(values: Column, size: int) -> Column:
    """Cells of a sketch of an array of digests."""
    return _cells(_placed(values, size, 1), size)


def sketched_difference(a: Column, b: Column, size: int) -> Column:
    """The sketch of a less that of b, cell by cell, made in one go."""
    return _cells(F.concat(_placed(a, size, 1), _placed(b, size, -1)), size)


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))


def peeled(cells: Column, size: int) -> Column:
    """(key, n) of the digests that a difference of sketches holds, n 1 or -1 for the side that has it;
    null if the rounds end before all are out.

    Each part holds every digest, so what is out is all when it adds up to what the first part has.
    """
    found = "array<struct<key: bigint, n: bigint>>"
    out, left, stuck = F.lit(1), F.lit(0), F.lit(2)

    def without(cells: Column, keys: Column) -> Column:
        placed = F.transform(keys, lambda k: F.struct((-k["n"]).alias("n"), k["key"].alias("key"), _check(k["key"]).alias("check"), _cells_of(k["key"], size).alias("at")))
        return _let(placed, lambda e: F.transform(cells, lambda c, i: F.aggregate(F.filter(e, lambda k: F.array_contains(k["at"], i)), c, _with)))

    def sum_of(keys: Column) -> Column:
        return F.aggregate(keys, _nothing(), lambda a, k: _with(a, F.struct(k["n"].alias("n"), k["key"].alias("key"), _check(k["key"]).alias("check"))))

    def run(given: Column) -> Column:
        total = F.aggregate(F.slice(given, 1, size // PARTS), _nothing(), _with)
        state = lambda cells, found, how: F.struct(cells.alias("cells"), found.alias("found"), how.cast("int").alias("how"))

        def peel(total: Column) -> Column:
            def step(acc: Column, _: Column) -> Column:
                alone = F.filter(acc["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"])))
                keys = F.array_distinct(F.transform(alone, lambda c: F.struct(c["key"].alias("key"), c["n"].alias("n"))))
                none = F.array().cast(f"array<{_CELL}>")

                def with_keys(k: Column) -> Column:
                    more = lambda f: F.when(sum_of(f) == total, state(none, f, out)).otherwise(state(without(acc["cells"], k), f, left))
                    return F.when(F.size(k) > 0, _let(F.concat(acc["found"], k), more)).otherwise(state(none, acc["found"], stuck))

                return F.when(acc["how"] == left, _let(keys, with_keys)).otherwise(acc)

            nothing = F.forall(given, lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0))
            start = state(given, F.array().cast(found), F.when(nothing, out).otherwise(left))
            rounds = next(r for most, r in ROUNDS.items() if size <= most)
            return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)

        return _let(_let(total, peel), lambda end: F.when(end["how"] == out, end["found"]))

    return _let(cells, run)


def expected(cells: Column) -> Column:
    """About how many digests a difference of sketches holds, from the squares of its counts.

    Each part sums the signed counts of all of them, so its squares add up to their number and
    a share of the square of the difference in size, which is known and taken off.
    """
    width = F.size(cells) / PARTS
    squares = F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c["n"] * c["n"]) / PARTS
    whole = F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c["n"]) / PARTS
    return (squares * width - whole * whole) / (width - 1)


def split(values: Column, side: Column) -> Column:
    """An array of digests dealt into side * side arrays by a hash, by rows first and then each row by columns."""
    dealt = F.transform(values, lambda d: F.struct(d.alias("d"), F.pmod(F.xxhash64(d, F.lit(2)), side * side).alias("t")))
    turns = F.sequence(F.lit(0).cast("long"), side - 1)
    row = lambda e: F.transform(turns, lambda p: F.filter(e, lambda x: (x["t"] >= p * side) & (x["t"] < (p + 1) * side)))
    cell = lambda r: F.transform(turns, lambda q: F.transform(F.filter(r, lambda x: x["t"] % side == q), lambda x: x["d"]))
    return F.flatten(F.transform(_let(dealt, row), cell))


def peeled_in_parts(a: Column, b: Column, side: Column) -> Column:
    """(key, n) of the digests that only one of two arrays has, by sketches of side * side shares of them, each as large
    as it takes; a share that none of the sizes peels is compared as it is."""

    def only(x: Column, y: Column, n: int) -> Column:
        return F.transform(F.array_except(x, y), lambda d: F.struct(d.alias("key"), F.lit(n).cast("long").alias("n")))

    def one(x: Column, y: Column) -> Column:
        tried = [peeled(sketched_difference(x, y, size), size) for size in SIZES]
        return F.coalesce(*tried, F.concat(only(x, y, 1), only(y, x, -1)))

    return F.flatten(F.zip_with(split(a, side), split(b, side), one))


def difference(a: Column, b: Column, first_a: Column | None = None, first_b: Column | None = None) -> Column:
    """(key, n) of the digests that only one of two arrays has, by sketches that grow until they
    can be peeled; first_a and first_b are sketches of the first size already made."""

    def tried(first: Column) -> Column:
        def by(about: Column) -> Column:
            sizes = F.abs(F.size(a) - F.size(b))
            small = F.when((sizes <= FIRST) & (about <= HOPE * FIRST), peeled(first, FIRST))
            side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.greatest(about, sizes) / LOAD))).cast("long")
            return F.coalesce(small, _let(side, lambda k: peeled_in_parts(a, b, k)))

        return _let(expected(first), by)

    made = first_a is not None
    return _let(subtracted(first_a if made else sketch(a, FIRST), first_b if made else sketch(b, FIRST)), tried)


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Jaccard index of two arrays of digests from their differing ones: 1 for equal sets."""
    return _let(F.struct((F.size(a) + F.size(b)).alias("both"), F.size(differing).alias("d")), lambda n: F.when(n["both"] + n["d"] == 0, F.lit(1.0)).otherwise((n["both"] - n["d"]) / (n["both"] + n["d"])))


def fingerprint(values: Column, cells: Column) -> Column:
    """A sketch as a string: number of digests, then the cells."""
    parts = F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"]), F.hex(c["key"]), F.hex(c["check"])))
    return F.concat(F.size(values).cast("string"), F.lit(":"), F.array_join(parts, ";"))


def _runs(docs: DataFrame, id_col: str) -> Column:
    """Number of the run of about RUN rows that a row (id, tie) is in; runs ascend as ids, then ties, do."""
    size, low, high, nulls = docs.agg(F.count("*"), F.min(id_col), F.max(id_col), F.count_if(F.col(id_col).isNull())).first()
    share = lambda k: F.least(F.lit(k - 1), F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * k)).cast("long")
    without = max(1, -(-nulls // RUN))
    if low is None:
        return share(without) - without
    quantiles = max(1, min(256, -(-size // RUN)))
    cuts = docs.agg(F.percentile_approx(id_col, [k / quantiles for k in range(1, quantiles)] or [0.5], 10_000)).first()[0]
    bounds = sorted({low, high, *cuts})
    # an id that is several cuts has that share of the rows
    often = {c: max(1, -(-n * size // (quantiles * RUN))) for c, n in Counter(cuts).items() if n > 1}
    most, inner = max(often.values(), default=0), max(1, -(-size // (len(bounds) * RUN)))
    edges = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    segment = F.size(F.filter(edges, lambda b: b <= F.col("id")))
    lo, hi = (F.get(edges, segment + k).cast("double") for k in (-1, 0))
    part = most + F.coalesce(F.least(F.lit(inner - 1), F.floor((F.col("id").cast("double") - lo) / (hi - lo) * inner)), F.lit(0))
    for c, k in often.items():
        part = F.when(F.col("id") == int(c), share(k)).otherwise(part)
    return F.when(F.col("id").isNull(), share(without) - without).otherwise(segment * (most + inner) + part).cast("long")


def with_next(docs: DataFrame, id_col: str, text_col: str, **more: Callable[[Column], Column]) -> DataFrame:
    """(id, own, next): each document's text and what else is made of it, as structs, and those of the one after it by
    descending id; the first one's come after the last. Null ids come last; equal ids are ordered by a hash of their text."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("run", _runs(docs, id_col))
    heads = rows.select("run", "id", "tie").groupBy("run").agg(F.max(F.struct("id", "tie")).alias("head"))
    # a run's first document also ends the run above it; the topmost one's ends the lowest. Which run is above is
    # found among thousands, and between those by their first ones
    heads = heads.withColumn("thousands", F.floor(F.col("run") / RUN))
    lowest = heads.groupBy("thousands").agg(F.min("run").alias("lowest"))
    line = Window.orderBy("thousands")
    around = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lowest = lowest.select("thousands", F.coalesce(F.lead("lowest").over(line), F.first("lowest").over(around)).alias("beyond"))
    above = F.lead("run").over(Window.partitionBy("thousands").orderBy("run"))
    heads = heads.join(lowest, "thousands").withColumn("to", F.coalesce(above, F.col("beyond"))).select(F.col("head.id").alias("hid"), F.col("head.tie").alias("htie"), "to")
    ends = rows.join(few(heads), F.col("id").eqNullSafe(F.col("hid")) & (F.col("tie") == F.col("htie"))).select("id", "text", "tie", F.col("to").alias("run"), F.lit(True).alias("end"))
    every = rows.withColumn("end", F.lit(False)).unionByName(ends)
    every = every.withColumn("own", F.struct("text", *[make(F.col("text")).alias(name) for name, make in more.items()])).drop("text")
    order = Window.partitionBy("run").orderBy("end", F.col("id").desc_nulls_last(), F.col("tie").desc())
    return every.withColumn("next", F.lead("own").over(order)).where("NOT end").select("id", "own", "next")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited version, whose last third is replaced by the
    beginning of the next document, and how alike the document is to that version and to the next.

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = with_next(docs, id_col, text_col, digests=digests).withColumn("n_chars", F.length("own.text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("own.text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substr("next.text", F.lit(1), third))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("own.digests").alias("a"), digests(F.col("edited")).alias("e"), F.col("next.digests").alias("b"))
    rows = rows.select("*", *[sketch(F.col(x), FIRST).alias(f"s{x}") for x in "aeb"])
    # one expression for both
    others = F.array(*[F.struct(F.col(x).alias("x"), F.col(f"s{x}").alias("s")) for x in "eb"])
    near = F.transform(others, lambda o: likeness(F.col("a"), o["x"], difference(F.col("a"), o["x"], F.col("sa"), o["s"])))
    rows = rows.withColumn("near", near)
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("a"), F.col("sa")).alias("fingerprint"),
        fingerprint(F.col("e"), F.col("se")).alias("edited_fingerprint"),
        F.get("near", F.lit(0)).alias("near_edited"),
        F.get("near", F.lit(1)).alias("near_next"),
    )
