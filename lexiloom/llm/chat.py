"""Chat formatting by schema fingerprints (DataFrame operations only).

A record is a JSON string in any of several layouts (messages, conversations,
turns, nested chats, prompt and response, instruction and input, lists of
questions and answers). Its nested field paths, of any depth and without types
and order, are read from the schema of the parsed record; those that any mapping
names make its fingerprint, and their hashes select a declarative mapping, which
says where the turns are: the one that needs the most of them, the earlier
declared at a tie. Fields that no mapping names change nothing. A template writes
the canonical turns into one string and gives the spans under the loss mask.
Control strings inside texts are escaped by a backslash, reversibly; `turns_of`
reads a formatted string back.

Template: every turn is `### Role: text </turn>` and a line feed. Escapes, in a
text: a backslash, `###` and `</turn>` get a backslash before them; in a role,
a colon is written `\\c`, too.

Scale: records of one conversation are the unit and are gathered by its id
(one shuffle); offsets are running sums of a window on the same partitioning. A
mapping is chosen within the row, without a join, so that one layout of all
records is no hot key.

Defined cases: null text is empty and a null role is an empty role; a null
conversation id is a conversation; rows with one turn number are ordered by
role and text; repeated rows are turns of their own; a record that no mapping
fits (an unknown layout, no JSON, a repeated key, null, lists of mixed types, a
record over the 128 MB that the parser takes) has the mapping
null, turns null and a null formatted string, a known one without turns an empty
string; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>"
LOSS_ROLES = ("assistant",)
#: What layouts with names of their own call the roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant"}
#: Declarative mappings: either fields, as (role, path) in order, or a list's path with its elements' fields: (role field, text field), or again [(role, field), ...].
MAPPINGS: dict[str, list | tuple] = {
    "messages": ("messages", ("role", "content")),
    "conversations": ("conversations", ("from", "value")),
    "turns": ("turns", ("role", "text")),
    "nested_chat": ("chat.messages", ("role", "content")),
    "questions": ("qa", [("user", "question"), ("assistant", "answer")]),
    "prompt_response": [("user", "prompt"), ("assistant", "response")],
    "prompt_completion": [("user", "prompt"), ("assistant", "completion")],
    "instruction": [("user", "instruction"), ("assistant", "output")],
    "instruction_input": [("user", "instruction"), ("user", "input"), ("assistant", "output")],
    "question": [("user", "question"), ("assistant", "answer")],
    "system_question": [("system", "system"), ("user", "question"), ("assistant", "answer")],
}


def needed(mapping: str) -> list[str]:
    """The field paths that a mapping needs."""
    where = MAPPINGS[mapping]
    if isinstance(where, list):
        return sorted(path for _, path in where)
    fields = [f for _, f in where[1]] if isinstance(where[1], list) else where[1]
    return sorted(f"{where[0]}[].{f}" for f in fields)


KNOWN = sorted({p for m in MAPPINGS for p in needed(m)})
_NAME = r"`[^`]*+(?:``[^`]*+)*+`"
_TOKEN = rf"{_NAME}: |[A-Za-z_][A-Za-z0-9_]*: |OBJECT<>|OBJECT<|ARRAY<|>|[A-Z][A-Z_]*(?:\([0-9, ]*\))?"


def paths_of(record: Column, known: list[str] = KNOWN) -> Column:
    """Sorted nested field paths of a JSON object that are among the known ones; `[]` stands for a list's elements."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    some = F.array(*map(F.lit, known))

    def step(acc: Column, t: Column) -> Column:
        top = F.element_at(acc["open"], -1)
        name = F.replace(F.btrim(F.substr(t, F.lit(1), F.length(t) - 2), F.lit("`")), F.lit("``"), F.lit("`"))
        is_name, opens, lists = F.endswith(t, F.lit(": ")), t == "OBJECT<", t == "ARRAY<"
        at = F.when(is_name, F.concat(top, name)).when(lists, F.concat(acc["at"], F.lit("[]"))).otherwise(acc["at"])
        inner = F.when(acc["at"] == "", F.lit("")).otherwise(F.concat(acc["at"], F.lit(".")))
        stack = F.when(opens, F.concat(acc["open"], F.array(inner))).when(lists, F.concat(acc["open"], F.array(F.lit("")))).when(t == ">", F.slice(acc["open"], 1, F.size(acc["open"]) - 1)).otherwise(acc["open"])
        leaf = ~(is_name | opens | lists | (t == ">"))
        out = F.when(leaf & F.array_contains(some, at) & ~F.array_contains(acc["out"], at), F.concat(acc["out"], F.array(at))).otherwise(acc["out"])
        return F.struct(at.alias("at"), stack.alias("open"), out.alias("out"))

    start = F.struct(F.lit("").alias("at"), F.array(F.lit("")).alias("open"), F.array().cast("array<string>").alias("out"))
    tokens = F.regexp_extract_all(F.coalesce(schema, F.lit("")), F.lit(_TOKEN), F.lit(0))
    return F.array_sort(F.aggregate(tokens, start, step)["out"])


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.concat_ws("\n", paths))


def mapping_of(paths: Column) -> Column:
    """The mapping whose paths' hashes are all among the record's: the one with the most, the earlier at a tie; null where there is none."""
    hashes = F.transform(paths, lambda p: F.xxhash64(p))
    out = F.lit(None).cast("string")
    for name in sorted(reversed(MAPPINGS), key=lambda m: len(needed(m))):  # later ones go before
        out = F.when(F.size(F.array_except(F.array(*(F.xxhash64(F.lit(p)) for p in needed(name))), hashes)) == 0, name).otherwise(out)
    return out


def _role(name: Column) -> Column:
    for own, canonical_name in ROLE_NAMES.items():
        name = F.when(name == own, canonical_name).otherwise(name)
    return name


def _fields(cells: list[tuple[str, Column]]) -> Column:
    """Turns from fields of fixed roles, without those that are null."""
    return F.filter(F.array(*(F.struct(F.lit(role).alias("role"), cell.alias("text")) for role, cell in cells)), lambda m: m["text"].isNotNull())


def canonical_turns(record: Column, mapping: Column) -> Column:
    """array<struct<role, text>> of a record under its mapping; null for an unknown one."""
    out = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, where in MAPPINGS.items():
        if isinstance(where, list):
            turns = _fields([(role, F.get_json_object(record, f"$.{f}")) for role, f in where])
        else:
            path, cells = where[0].split("."), where[1]
            names = [f for _, f in cells] if isinstance(cells, list) else cells
            kind = "array<struct<" + ",".join(f"`{n}`:string" for n in names) + ">>"
            for part in reversed(path):
                kind = f"struct<`{part}`:{kind}>"
            parsed = F.from_json(record, kind)
            for part in path:
                parsed = parsed[part]
            if isinstance(cells, list):
                turns = F.flatten(F.transform(parsed, lambda m: _fields([(role, m[f]) for role, f in cells])))
            else:
                turns = F.transform(parsed, lambda m: F.struct((_role(m[cells[0]]) if cells[0] == "from" else m[cells[0]]).alias("role"), m[cells[1]].alias("text")))
        out = F.when(mapping == name, turns).otherwise(out)
    return out


def canonical(records: DataFrame, record_col: str = "record") -> DataFrame:
    """records with fingerprint, mapping and turns."""
    read = records.withColumn("paths", paths_of(F.col(record_col)))
    known = read.withColumn("fingerprint", fingerprint(F.col("paths"))).withColumn("mapping", mapping_of(F.col("paths"))).drop("paths")
    return known.withColumn("turns", canonical_turns(F.col(record_col), F.col("mapping")))


def escape(text: Column) -> Column:
    for mark in ("\\", "###", END):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def unescape(text: Column, *marks: tuple[str, str]) -> Column:
    """Pairs of backslashes are read from the left, as they were written; what is left of them begins an escape."""

    def plain(part: Column) -> Column:
        for written, mark in (("\\###", "###"), ("\\" + END, END), *marks):
            part = F.replace(part, F.lit(written), F.lit(mark))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(role, ("\\c", ":"))


def formatted(conversations: DataFrame) -> DataFrame:
    """conversations: conv_id, turns (array of role, text). Adds formatted and loss_spans (start from 1, chars)."""

    def piece(m: Column) -> Column:
        role, text = F.coalesce(m["role"], F.lit("")), F.coalesce(m["text"], F.lit(""))
        head = F.concat(F.lit("### "), escape_role(role), F.lit(": "))
        return F.struct(head.alias("head"), escape(text).alias("body"), role.isin(*LOSS_ROLES).alias("loss"))

    pieces = conversations.select("conv_id", F.col("turns").isNotNull().alias("known"), F.posexplode_outer(F.transform("turns", piece)).alias("at", "p"))
    tail = f" {END}\n"
    size = F.length("p.head") + F.length("p.body") + len(tail)
    run = Window.partitionBy("conv_id").orderBy("at")
    placed = pieces.withColumn("start", F.sum(size).over(run) - size + F.length("p.head") + 1)
    item = F.struct("at", F.concat("p.head", "p.body", F.lit(tail)).alias("s"), "start", F.length("p.body").alias("chars"), F.col("p.loss").alias("loss"))
    whole = placed.groupBy("conv_id").agg(F.max("known").alias("known"), F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), item))).alias("items"))
    spans = F.transform(F.filter("items", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["chars"].alias("chars")))
    return whole.select("conv_id", F.when(F.col("known"), F.array_join(F.transform("items", lambda x: x["s"]), "")).alias("formatted"), F.when(F.col("known"), spans).alias("loss_spans"))


def turns_of(text: Column) -> Column:
    """Reads a formatted string back: array<struct<role, text>>."""
    parts = F.filter(F.split(text, r"(?<!\\)" + END + r"\n"), lambda s: s != "")

    def turn(s: Column) -> Column:
        colon = F.locate(":", s)
        return F.struct(unescape_role(F.substring(s, 5, colon - 5)).alias("role"), unescape(F.substring(s, colon + 2, F.length(s) - colon - 2)).alias("text"))

    return F.transform(parts, turn)


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda x: unescape(F.substring(text, x["start"].cast("int"), x["chars"]))), "")


def from_rows(rows: DataFrame, as_turns: Column | None = None) -> DataFrame:
    """conv_id, record: rows by turn (conv_id, turn, role, text) as one JSON record each, of the `messages` layout, or of `turns` where that condition holds."""
    message = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    as_ = lambda layout, text: F.to_json(F.struct(F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias(text))).alias(layout)))
    record = as_("messages", "content")
    return grouped.select("conv_id", (record if as_turns is None else F.when(as_turns, as_("turns", "text")).otherwise(record)).alias("record"))
