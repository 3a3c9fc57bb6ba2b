"""Chat records of different layouts as canonical turns, formatted by one template.

A record is a variant. Its schema is walked for the paths of all nested fields; those that any mapping
reads make its fingerprint, whose hash selects a declared mapping to turns (role, text), so further
fields do not matter. Where the record itself has no known layout, objects inside it are looked at, the
outermost first and those of one depth in order of their names, up to DEPTH levels down; the first with a known layout
counts. A message whose content is a list of parts says the texts of its parts, one after another. Rows of turns are gathered to records in the layout that suits each
conversation's shape: a prompt and a response, an instruction with a system text, an exchange
of two speakers, one turn, or messages of any roles. The template marks each turn by control
strings; inside roles and texts the characters that begin one are written as codes, which can
be undone. The loss mask lists the ranges of the formatted text that assistants said. Everything is
DataFrame expressions.

A null text is empty, a null role is empty. Turns are in order of their number, null
numbers last, ties by role and text; repeated rows stay repeated turns. A list of no turns gives no turns
and an empty text. A record of no known layout has null turns and a null layout. A null id is a
conversation of its own. An empty table gives no rows. Of columns that records already have by the names
of the results, the results stand. A variant holds 128 MB: a conversation of more than LARGE bytes has no record, its
turns pass as they are, with the layout `rows`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: What is written for a character inside a role or text; the code's own first character first.
CODES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("\n", "\\3"))
_TURNS = "array<struct<role string, text string>>"
#: Column of the turns of conversations that are too large for a record.
LARGE_TURNS = "turns_without_record"


@dataclass(frozen=True)
class Layout:
    """A layout by its field paths, and how its turns are read from the variant `r`."""

    name: str
    paths: str
    turns: str


def _said(v: str) -> str:
    """The text of a variant: of a list the texts of its parts, strings or objects with a text."""
    part = "CASE WHEN schema_of_variant(p) LIKE 'OBJECT<%' THEN try_variant_get(p, '$.text', 'string') ELSE try_cast(p AS string) END"
    return f"CASE WHEN schema_of_variant({v}) LIKE 'ARRAY<%' THEN array_join(transform(try_cast({v} AS array<variant>), p -> coalesce({part}, '')), '') ELSE try_cast({v} AS string) END"


def _listed(field: str, role: str, text: str) -> str:
    said = _said(f"variant_get(x, '$.{text}', 'variant')")
    return f"transform(variant_get(r, '$.{field}', 'array<variant>'), x -> struct(variant_get(x, '$.{role}', 'string') AS role, {said} AS text))"


def _pair(first: str, second: str) -> str:
    return f"array(struct('user' AS role, {first} AS text), struct('assistant' AS role, {second} AS text))"


def _field(name: str) -> str:
    return f"variant_get(r, '$.{name}', 'string')"


#: Fields that mappings read: lists of turns with the role and text of one, and texts (fixed values).
LISTS = {"conversations": ("from", "value"), "messages": ("role", "content"), "turns": ("role", "text")}
TEXTS = ("completion", "input", "instruction", "output", "prompt", "response", "system")
_NO_TURNS = f"CAST(array() AS {_TURNS})"
_SYSTEM = "array(struct('system' AS role, {} AS text))"
#: Levels below a record's own that are searched for a layout, and bytes of a conversation that a variant takes.
DEPTH, LARGE = 3, 120 << 20


def _paths(*names: str) -> str:
    return " ".join(sorted(names))


def _forms(field: str) -> tuple[tuple[str, str], ...]:
    """(suffix, paths) of a list whose texts are plain, lists of objects with a text, or lists of strings."""
    role, text = LISTS[field]
    own = (f"{field}[]", f"{field}[].{role}")
    at = f"{field}[].{text}"
    return ("", _paths(*own, at)), ("_parts", _paths(*own, f"{at}[]", f"{at}[].text")), ("_strings", _paths(*own, f"{at}[]", f"{at}[]="))


def _lists(field: str, turns: str) -> tuple[Layout, ...]:
    return tuple(Layout(field + suffix, paths, turns) for suffix, paths in _forms(field))


_SPOKEN = f"transform({_listed('conversations', *LISTS['conversations'])}, x -> struct(CASE x.role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE x.role END AS role, x.text AS text))"

#: The layouts known, by their paths in order.
LAYOUTS = (
    *_lists("messages", _listed("messages", *LISTS["messages"])),
    *_lists("turns", _listed("turns", *LISTS["turns"])),
    *_lists("conversations", _SPOKEN),
    *(Layout(f"no_{field}", f"{field}[]", _NO_TURNS) for field in LISTS),
    Layout("prompt_response", "prompt response", _pair(_field("prompt"), _field("response"))),
    Layout("prompt_completion", "completion prompt", _pair(_field("prompt"), _field("completion"))),
    Layout("instruction", "instruction output", _pair(_field("instruction"), _field("output"))),
    Layout("instruction_input", "input instruction output", _pair(f"concat_ws('\n\n', {_field('instruction')}, nullif({_field('input')}, ''))", _field("output"))),
    Layout("instruction_system", "instruction output system", f"concat({_SYSTEM.format(_field('system'))}, {_pair(_field('instruction'), _field('output'))})"),
)

#: Paths that count: those of layouts, and other kinds of the fields they name, which no layout has.
KNOWN = sorted(
    {p for x in LAYOUTS for p in x.paths.split()}
    | {name + kind for name in (*TEXTS, *LISTS) for kind in ("", "[]", "{}", "[]=")}
    | {f"{field}[].{text}{kind}" for field, (_, text) in LISTS.items() for kind in ("[]", "{}", "[]=")}
    | {f"{field}[].{role}{kind}" for field, (role, _) in LISTS.items() for kind in ("[]", "{}")}
)
#: Parts of a schema as text: a field's name, the start of an object or a list, an end, and other types.
_TOKEN = r"(?:`(?:[^`]|``)*`|[^`<>,:() ]+): |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]+\))?"


def all_paths(record: Column) -> Column:
    """The paths of all fields of a variant: `a.b` for a value, `a{}` for an object, `a[]` for a list, `a[].b` for a field of its
    objects, `a[]=` for a list of something else."""
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(_TOKEN), F.lit(0))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("inside"), F.lit("").alias("at"), none.alias("found"))

    def step(acc: Column, token: Column) -> Column:
        inside, at, found = acc["inside"], acc["at"], acc["found"]
        state = lambda i, a, f: F.struct(i.alias("inside"), a.alias("at"), f.alias("found"))
        name = F.concat(F.element_at(inside, -1), F.substr(token, F.lit(1), F.length(token) - 2))
        within = F.concat(inside, F.array(F.when(at == "", "").otherwise(F.concat(at, F.lit(".")))))
        listed = F.concat(at, F.lit("[]"))
        leaf = F.when(~at.endswith("[]"), at).otherwise(F.when(token != "VOID", F.concat(at, F.lit("="))))
        return (
            F.when(token.endswith(": "), state(inside, name, found))
            .when(token == "OBJECT<", state(within, at, F.concat(found, F.array(F.concat(at, F.lit("{}"))))))
            .when(token == "ARRAY<", state(F.concat(inside, F.array(at)), listed, F.concat(found, F.array(listed))))
            .when(token == ">", state(F.slice(inside, 1, F.size(inside) - 1), at, found))
            .otherwise(state(inside, at, F.concat(found, F.array_compact(F.array(leaf)))))
        )

    return F.aggregate(tokens, start, step)["found"]


def paths(record: Column) -> Column:
    """The paths of a variant's nested fields that count, in order, as one text."""
    return F.concat_ws(" ", F.array_sort(F.array_intersect(all_paths(record), F.array(*[F.lit(p) for p in KNOWN]))))


def fingerprint(record: Column) -> Column:
    """Hash of a variant's nested field paths that count."""
    return F.xxhash64(paths(record))


def _objects(record: Column) -> Column:
    """The objects that are fields of a variant, in order of their names."""
    fields = F.coalesce(F.map_values(record.try_cast("map<string, variant>")), F.array().cast("array<variant>"))
    return F.filter(fields, lambda v: F.schema_of_variant(v).startswith("OBJECT<"))


def within(record: Column) -> Column:
    """The objects inside a variant, the outermost first, DEPTH levels down."""
    levels = [_objects(record)]
    for _ in range(DEPTH - 1):
        levels.append(F.flatten(F.transform(levels[-1], _objects)))
    return F.concat(*levels)


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with layout and turns (array of role and text) in place of their variant column."""
    large = [c for c in records.columns if c == LARGE_TURNS]
    keep = [c for c in records.columns if c.lower() not in (record_col.lower(), "layout", "turns", *large)]
    r, own, mark = (free_name(c, keep) for c in ("r", "own", "print"))
    known = lambda c: c.isin(*[F.xxhash64(F.lit(x.paths)) for x in layouts])
    marked = records.select(*keep, *large, F.col(record_col).alias(own)).withColumn(mark, fingerprint(F.col(own)))
    inner = F.get(F.filter(within(F.col(own)), lambda v: known(fingerprint(v))), F.lit(0))
    marked = marked.withColumn(r, F.when(known(F.col(mark)), F.col(own)).otherwise(F.coalesce(inner, F.col(own)))).drop(mark)
    marked = marked.withColumn(mark, fingerprint(F.col(r)))
    cases, names = "", ""
    for x in layouts:
        test = f"WHEN `{mark}` = xxhash64('{x.paths}') THEN "
        cases += test + f"CAST({x.turns.replace('variant_get(r,', f'variant_get(`{r}`,')} AS {_TURNS}) "
        names += test + f"'{x.name}' "
    layout, turns = F.expr(f"CASE {names} END"), F.expr(f"CASE {cases} END")
    if large:
        layout, turns = F.when(F.col(large[0]).isNotNull(), "rows").otherwise(layout), F.coalesce(large[0], turns)
    return marked.select(*keep, layout.alias("layout"), turns.alias("turns"))


def escaped(text: Column, last: int = 3) -> Column:
    for char, code in CODES[:last]:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for char, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def formatted(turns: Column) -> Column:
    """The template's text of an array of turns."""

    def one(t: Column) -> Column:
        return F.concat(F.lit(BEGIN), escaped(F.coalesce(t["role"], F.lit("")), 4), F.lit("\n"), escaped(F.coalesce(t["text"], F.lit(""))), F.lit(END))

    return F.array_join(F.transform(turns, one), "")


def parsed(text: Column) -> Column:
    """Turns read back from the template's text."""
    bodies = F.transform(F.filter(F.split(text, END.replace("|", "\\|"), -1), lambda p: p != ""), lambda p: F.substr(p, F.lit(len(BEGIN) + 1)))
    return F.transform(bodies, lambda b: F.struct(unescaped(F.substring_index(b, "\n", 1)).alias("role"), unescaped(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2)).alias("text")))


def loss_mask(text: Column) -> Column:
    """(start, end) code points of the formatted text that assistants said, in order."""
    parts = F.filter(F.split(text, END.replace("|", "\\|"), -1), lambda p: p != "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        role = F.substr(F.substring_index(p, "\n", 1), F.lit(len(BEGIN) + 1))
        head, whole = F.length(F.substring_index(p, "\n", 1)) + 1, F.length(p)
        span = F.struct((acc["at"] + head).cast("long").alias("start"), (acc["at"] + whole).cast("long").alias("end"))
        said = F.when(role == "assistant", F.array(span)).otherwise(F.array().cast("array<struct<start: bigint, end: bigint>>"))
        return F.struct((acc["at"] + whole + len(END)).cast("long").alias("at"), F.concat(acc["spans"], said).alias("spans"))

    return F.aggregate(parts, start, step)["spans"]


def under_mask(text: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substr(text, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")


def from_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, record, turns_without_record): rows of turns gathered to one variant for each conversation, laid out by
    its shape, or, above LARGE bytes, to the turns themselves."""
    one = F.struct(F.col(turn_col).isNull().alias("late"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("content"))
    gathered = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(one)).alias("t"))
    role = lambda k: F.get("t", F.lit(k))["role"]
    text = lambda k: F.get("t", F.lit(k))["content"]
    listed = lambda a, b, name=lambda x: x["role"]: F.transform("t", lambda x: F.struct(name(x).alias(a), x["content"].alias(b)))
    record = lambda *fields: F.to_variant_object(F.struct(*fields))
    n, speaker = F.size("t"), lambda x: F.when(x["role"] == "user", "human").otherwise("gpt")
    two = F.forall("t", lambda x: x["role"].isin("user", "assistant"))
    shaped = (
        F.when((n == 2) & (role(0) == "user") & (role(1) == "assistant"), record(text(0).alias("prompt"), text(1).alias("response")))
        .when((n == 3) & (role(0) == "system") & (role(1) == "user") & (role(2) == "assistant"), record(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output")))
        .when(n == 1, record(listed("role", "text").alias("turns")))
        .when(two, record(listed("from", "value", speaker).alias("conversations")))
        .otherwise(record(listed("role", "content").alias("messages")))
    )
    fits = F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["role"]) + F.octet_length(x["content"])) <= LARGE
    plain = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("text")))
    return gathered.select(id_col, F.when(fits, shaped).alias("record"), F.when(~fits, plain).alias(LARGE_TURNS))


def format_records(records: DataFrame, record_col: str = "record") -> DataFrame:
    """records with layout, turns, formatted and loss_mask in place of their variant column."""
    taken = [c for c in records.columns if c.lower() in ("formatted", "loss_mask") and c != record_col]
    out = canonical_turns(records.drop(*taken), record_col).withColumn("formatted", formatted(F.col("turns")))
    return out.withColumn("loss_mask", loss_mask(F.col("formatted")))
