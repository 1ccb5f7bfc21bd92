"""Chat formatting: records of many layouts become canonical turns, then one escaped, reversible training string.

A layout is recognised by the SHA-256 of its sorted nested field paths; each fingerprint selects a declarative mapping to
turns. Only paths that some mapping names take part, so extra columns do not matter. Everything here is DataFrame code.

Template: each turn is `<|turn|>ROLE\\nTEXT<|end|>\\n`. In roles and texts a backslash becomes `\\0`, a newline in a role
`\\2`, and the first character of any control string gets `\\1` behind it, so no control string is left and unescaping
is exact.

Defined cases: null role or text is empty; a record of unknown layout (or broken JSON) gives no turns; null conversation
ids form one conversation; equal turn numbers are ordered by role, then text; repeated rows are repeated turns; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that start or end turns here or in common chat templates.
CONTROL_STRINGS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>"]
#: Role names of other layouts.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURN, END = "<|turn|>", "<|end|>\n"
JSON_OPTIONS = {"maxStringLen": "2147483647"}
TURNS_TYPE = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """listing: (field, role field, text field) of an array of messages; fields: (role, fields joined by a blank line)."""

    name: str
    listing: tuple[str, str, str] | None = None
    fields: tuple[tuple[str | None, tuple[str, ...]], ...] = ()
    role_field: str | None = None

    @property
    def paths(self) -> tuple[str, ...]:
        if self.listing:
            field, role, text = self.listing
            return tuple(sorted((f"{field}[].{role}", f"{field}[].{text}")))
        return tuple(sorted({f for _, fs in self.fields for f in fs} | ({self.role_field} if self.role_field else set())))


#: In order of preference where a record has the paths of several.
LAYOUTS = (
    Layout("messages", listing=("messages", "role", "content")),
    Layout("from_value", listing=("conversations", "from", "value")),
    Layout("turns", listing=("turns", "role", "text")),
    Layout("turn_row", fields=((None, ("text",)),), role_field="role"),
    Layout("message_row", fields=((None, ("content",)),), role_field="role"),
    Layout("system_prompt_response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction_input_output", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction_output", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("prompt_completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question_answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("document_summary", fields=(("user", ("document",)), ("assistant", ("summary",)))),
)
KNOWN_PATHS = sorted({p for x in LAYOUTS for p in x.paths})


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    """SHA-256 of the sorted nested field paths that some layout names."""
    return hashlib.sha256("|".join(sorted(set(paths) & set(KNOWN_PATHS))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(x.paths): x for x in reversed(LAYOUTS)}


def schema_paths(schema: T.StructType) -> list[str]:
    out: list[str] = []

    def walk(kind: T.DataType, at: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{at}.{f.name}" if at else f.name)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, at + "[]")
        else:
            out.append(at)

    walk(schema, "")
    return out


def layout_of(paths: list[str], by_turn: bool = False) -> Layout | None:
    """The layout with this fingerprint, else the first whose paths are all there; by_turn: of those with a role a row, if there is one."""
    found = [x for x in LAYOUTS if set(x.paths) <= set(paths)]
    rows = [x for x in found if x.role_field]
    return rows[0] if by_turn and rows else BY_FINGERPRINT.get(fingerprint(paths)) or (found[0] if found else None)


def _turn(role: Column, text: Column, rename: bool = True) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    for old, new in ROLE_NAMES.items() if rename else ():
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _joined(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.concat_ws("\n\n", *[F.when(c != "", c) for c in columns])


def canonical_turns(df: DataFrame, id_col: str, order_col: str | None = None, layout: str | None = None) -> DataFrame:
    """(conv_id, ord, idx, role, text) of a table whose own schema is the layout, or that of this name.

    With an order column, rows are turns where the schema has a layout of turns, whatever other columns there are. The role of a
    row that is a turn stays as it is; those inside records get the canonical names.
    """
    layout = next(x for x in LAYOUTS if x.name == layout) if layout else layout_of(schema_paths(df.schema), order_col is not None)
    if layout is None:
        turns = F.array().cast(TURNS_TYPE)
    elif layout.listing:
        field, role, text = layout.listing
        turns = F.transform(F.col(f"`{field}`"), lambda m: _turn(m[role], m[text]))
    else:
        turns = F.array(*[_turn(F.col(f"`{layout.role_field}`") if role is None else F.lit(role), _joined([F.col(f"`{f}`") for f in fs]), rename=False) for role, fs in layout.fields])
    order = F.col(f"`{order_col}`").cast("bigint") if order_col else F.lit(0).cast("bigint")
    return df.select(F.col(f"`{id_col}`").alias("conv_id"), order.alias("ord"), F.posexplode(turns).alias("idx", "turn")).select("conv_id", "ord", "idx", "turn.role", "turn.text")


def record_paths(record: Column) -> Column:
    """Sorted nested field paths of a JSON object, two levels deep."""
    top = F.from_json(record, "map<string,string>", JSON_OPTIONS)

    def below(k: Column) -> Column:
        value = F.try_element_at(top, k)
        listed = F.from_json(value, "array<map<string,string>>", JSON_OPTIONS)
        inner = F.from_json(value, "map<string,string>", JSON_OPTIONS)
        keys = F.array_distinct(F.flatten(F.transform(F.filter(listed, lambda m: m.isNotNull()), lambda m: F.map_keys(m))))
        return (
            F.when(value.startswith("["), F.transform(keys, lambda x: F.concat(k, F.lit("[]."), x)))
            .when(value.startswith("{"), F.transform(F.map_keys(inner), lambda x: F.concat(k, F.lit("."), x)))
            .otherwise(F.array(k))
        )

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_keys(top), lambda k: F.coalesce(below(k), F.array(k))))))


def canonical_turns_of_json(df: DataFrame, id_col: str, record_col: str, order_col: str | None = None) -> DataFrame:
    """(conv_id, ord, idx, role, text, layout) of JSON records, each of any layout: the fingerprint of its own paths selects the mapping."""
    known = F.array(*[F.lit(p) for p in KNOWN_PATHS])
    paths = F.array_sort(F.array_intersect(F.coalesce(record_paths(F.col(record_col)), F.array().cast("array<string>")), known))
    by_print = reduce(lambda acc, kv: acc.when(F.col("__print") == kv[0], F.lit(kv[1].name)), BY_FINGERPRINT.items(), F.when(F.lit(False), F.lit("")))
    by_paths = reduce(lambda acc, x: acc.when(F.size(F.array_except(F.array(*[F.lit(p) for p in x.paths]), F.col("__paths"))) == 0, F.lit(x.name)), LAYOUTS, F.when(F.lit(False), F.lit("")))
    top = F.from_json(F.col(record_col), "map<string,string>", JSON_OPTIONS)

    def mapped(x: Layout) -> Column:
        if x.listing:
            field, role, text = x.listing
            listed = F.from_json(F.try_element_at(F.col("__top"), F.lit(field)), "array<map<string,string>>", JSON_OPTIONS)
            return F.transform(listed, lambda m: _turn(F.try_element_at(m, F.lit(role)), F.try_element_at(m, F.lit(text))))
        value = lambda f: F.try_element_at(F.col("__top"), F.lit(f))
        return F.array(*[_turn(value(x.role_field) if role is None else F.lit(role), _joined([value(f) for f in fs])) for role, fs in x.fields])

    turns = reduce(lambda acc, x: acc.when(F.col("__layout") == x.name, mapped(x)), LAYOUTS, F.when(F.lit(False), F.array().cast(TURNS_TYPE)))
    order = F.col(f"`{order_col}`").cast("bigint") if order_col else F.lit(0).cast("bigint")
    found = df.select(F.col(f"`{id_col}`").alias("conv_id"), order.alias("ord"), paths.alias("__paths"), top.alias("__top")).withColumn("__print", F.sha2(F.concat_ws("|", "__paths"), 256)).withColumn("__layout", F.coalesce(by_print, by_paths, F.lit("unknown")))
    return found.select("conv_id", "ord", F.col("__layout").alias("layout"), F.posexplode(turns).alias("idx", "turn")).select("conv_id", "ord", "idx", "turn.role", "turn.text", "layout")


def escape(text: Column, role: bool = False) -> Column:
    controls = "|".join(c[0].replace("[", "\\[") + "(?=\\Q" + c[1:] + "\\E)" for c in CONTROL_STRINGS)
    out = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\0")), f"({controls})", "$1\\\\1")
    return F.replace(out, F.lit("\n"), F.lit("\\2")) if role else out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\1"), F.lit("")), F.lit("\\2"), F.lit("\n")), F.lit("\\0"), F.lit("\\"))


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_turns (0-based turns under the loss) and loss_spans (their [start, end) code points in `formatted`)."""
    from pyspark.sql import Window

    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN), escape(role, role=True), F.lit("\n"))
    shown = turns.select("conv_id", "ord", "idx", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body"))
    shown = shown.withColumn("size", (F.length("head") + F.length("body") + F.lit(len(END))).cast("bigint"))
    order = Window.partitionBy("conv_id").orderBy("ord", "idx", "role", "text")
    placed = shown.withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    lo = F.col("start") + F.length("head")
    part = F.struct("start", F.concat("head", "body", F.lit(END)).alias("shown"), (F.col("role") == loss_role).alias("loss"), lo.alias("lo"), (lo + F.length("body")).alias("hi"))
    packed = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    numbered = F.transform(F.col("parts"), lambda p, i: F.struct(i.alias("i"), p["loss"].alias("loss"), p["lo"].alias("lo"), p["hi"].alias("hi")))
    under = F.filter(numbered, lambda p: p["loss"])
    return packed.select(
        "conv_id",
        F.size("parts").cast("bigint").alias("n_turns"),
        F.concat_ws("", F.transform("parts", lambda p: p["shown"])).alias("formatted"),
        F.transform(under, lambda p: p["i"]).alias("loss_turns"),
        F.transform(under, lambda p: F.struct(p["lo"].alias("start"), p["hi"].alias("end"))).alias("loss_spans"),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask of a formatted string, cut at its spans and unescaped, nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted string, unescaped: array<struct<role,text>>."""
    parts = F.filter(F.split(formatted, "<\\|turn\\|>"), lambda p: p != "")

    def turn(part: Column) -> Column:
        at = F.instr(part, "\n")
        body = F.substring(part, at + 1, F.length(part) - at - F.lit(len(END)))
        return F.struct(unescape(F.substring(part, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)
