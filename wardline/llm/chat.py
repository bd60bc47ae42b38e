"""Chat formatting with DataFrame functions only.

Layouts are recognised by a fingerprint, the hash of their nested field paths,
which selects a declared mapping to canonical turns (role, text). A template
marks the turns; control strings inside texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: marks of the template: around user, assistant and system texts, and around role and text of other turns
USER, ASSISTANT, SYSTEM = ("[INST]", "[/INST]"), ("<s>", "</s>"), ("[SYS]", "[/SYS]")
OTHER = ("[TURN]", "[/ROLE]", "[/TURN]")
_TAIL = r"(/?s>|/?INST\]|/?SYS\]|/?TURN\]|/ROLE\])"
_ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def shape(schema: T.DataType) -> str:
    """Nested field paths of a Spark type as text; fields are sorted, scalar types left out."""
    if isinstance(schema, T.StructType):
        return "OBJECT<" + ", ".join(f"{f.name}: {shape(f.dataType)}" for f in sorted(schema.fields, key=lambda f: f.name)) + ">"
    if isinstance(schema, T.ArrayType):
        return f"ARRAY<{shape(schema.elementType)}>"
    return "_"


def fingerprint(shape_text: str) -> str:
    return hashlib.sha256(shape_text.encode()).hexdigest()


def json_fingerprint(payload: Column) -> Column:
    """The fingerprint of each JSON text; null where it can't be read."""
    schema = F.schema_of_variant(F.try_parse_json(payload))
    return F.sha2(F.regexp_replace(schema, r"(?<=[<: ]|^)(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DECIMAL\(\d+,\s?\d+\))(?=[,>]|$)", "_"), 256)


@dataclass(frozen=True)
class Layout:
    """A mapping: either ``turns`` (role, path) one by one, or a list at ``each`` with a role and a text key."""

    shape: str
    turns: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role_key: str = "role"
    text_key: str = "content"
    roles: dict = field(default_factory=lambda: _ROLES)


LAYOUTS = (
    Layout("OBJECT<prompt: _, response: _>", (("user", "prompt"), ("assistant", "response"))),
    Layout("OBJECT<completion: _, prompt: _>", (("user", "prompt"), ("assistant", "completion"))),
    Layout("OBJECT<answer: _, question: _>", (("user", "question"), ("assistant", "answer"))),
    Layout("OBJECT<instruction: _, output: _>", (("user", "instruction"), ("assistant", "output"))),
    Layout("OBJECT<input: _, instruction: _, output: _>", (("user", "instruction+input"), ("assistant", "output"))),
    Layout("OBJECT<prompt: _, response: _, system: _>", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("OBJECT<messages: ARRAY<OBJECT<content: _, role: _>>>", each="messages"),
    Layout("OBJECT<conversations: ARRAY<OBJECT<from: _, value: _>>>", each="conversations", role_key="from", text_key="value"),
    Layout("OBJECT<dialog: ARRAY<OBJECT<role: _, text: _>>>", each="dialog", text_key="text"),
    Layout("ARRAY<OBJECT<content: _, role: _>>", each="$"),
)
#: layouts of tables with one row per turn: columns of conversation, turn, role and text
ROWS = {fingerprint(shape(T.StructType([T.StructField(n, T.StringType()) for n in names]))): names for names in (
    ("conv_id", "turn", "role", "text"), ("conversation_id", "turn", "role", "content"), ("conv_id", "turn", "from", "value"))}


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(role: Column, roles: dict) -> Column:
    out = role
    for name, canonical in roles.items():
        out = F.when(role == name, canonical).otherwise(out)
    return out


def _from_layout(value: Column, layout: Layout) -> Column:
    if layout.each:
        path = "$" if layout.each == "$" else f"$.{layout.each}"
        kind = f"array<struct<`{layout.role_key}` string, `{layout.text_key}` string>>"
        return F.transform(F.try_variant_get(value, path, kind), lambda m: _turn(_mapped(m[layout.role_key], layout.roles), m[layout.text_key]))
    turns = []
    for role, path in layout.turns:
        texts = [F.try_variant_get(value, f"$.{p}", "string") for p in path.split("+")]
        text = texts[0]
        for more in texts[1:]:
            text = F.concat(F.coalesce(text, F.lit("")), F.when(F.length(more) > 0, F.concat(F.lit("\n"), more)).otherwise(F.lit("")))
        turns.append(_turn(F.lit(role), text))
    return F.array(*turns)


def turns_of_json(table: DataFrame, payload: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``table`` with ``layout`` (fingerprint) and ``turns`` (array of role, text) of each JSON text.

    Texts that can't be read, and layouts without a mapping, have null turns;
    null parts count as empty texts. A column named like an added one is
    replaced; an empty table gives an empty result.
    """
    value = F.try_parse_json(F.col(payload))
    key = json_fingerprint(F.col(payload))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in layouts:
        turns = F.when(key == fingerprint(layout.shape), _from_layout(value, layout)).otherwise(turns)
    return table.withColumns({"layout": key, "turns": turns})


def turns_of_rows(table: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table with one row per turn; its columns' fingerprint selects the mapping.

    Turns are ordered by turn, then role and text; nulls come first and null
    roles and texts count as empty; roles keep their names. Repeated rows are turns of their own; rows with a null id are one
    conversation. Columns beyond the layout are ignored if the rest fits one.
    """
    known = [names for names in ROWS.values() if set(names) <= set(table.columns)]
    names = ROWS.get(fingerprint(shape(table.select(*[F.lit("").alias(c) for c in table.columns]).schema))) or (known[0] if known else None)
    if names is None:
        raise ValueError(f"no mapping for columns {table.columns}")
    conv, turn, role, text = names
    rows = table.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: _turn(t["role"], t["text"]))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))  # one conversation is one cell of the result


def escape(text: Column) -> Column:
    """Adds a backslash after the first character of each control string, escaped ones included."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def format_turns(turns: Column) -> Column:
    """The template's text of an array of (role, text)."""

    def one(t: Column) -> Column:
        text = escape(t["text"])
        out = F.concat(F.lit(OTHER[0]), escape(t["role"]), F.lit(OTHER[1]), text, F.lit(OTHER[2]))
        for role, (left, right) in (("system", SYSTEM), ("assistant", ASSISTANT), ("user", USER)):
            out = F.when(t["role"] == role, F.concat(F.lit(left), text, F.lit(right))).otherwise(out)
        return out

    return F.array_join(F.transform(turns, one), "")


def _chunks(formatted: Column) -> Column:
    ends = [USER, ASSISTANT, SYSTEM, (OTHER[0], OTHER[2])]
    pattern = "(?s)" + "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in ends)
    return F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""

    def one(c: Column) -> Column:
        body = F.substring_index(F.substring(c, F.lit(len(OTHER[0]) + 1), F.length(c) - len(OTHER[0]) - len(OTHER[2])), OTHER[1], 1)
        rest = F.substring(c, F.length(body) + len(OTHER[0]) + len(OTHER[1]) + 1, F.length(c) - F.length(body) - sum(map(len, OTHER)))
        out = F.struct(unescape(body).alias("role"), unescape(rest).alias("text"))
        for role, (left, right) in (("system", SYSTEM), ("assistant", ASSISTANT), ("user", USER)):
            text = F.substring(c, F.lit(len(left) + 1), F.length(c) - len(left) - len(right))
            out = F.when(c.startswith(left), F.struct(F.lit(role).alias("role"), unescape(text).alias("text"))).otherwise(out)
        return out

    return F.transform(_chunks(formatted), one)


def loss_spans(formatted: Column) -> Column:
    """Code points (start, end) of the assistant texts in a formatted conversation: the loss mask."""
    left, right = ASSISTANT
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, c: Column) -> Column:
        end = state["at"] + F.length(c)
        span = F.array(F.struct((state["at"] + len(left)).alias("start"), (end - len(right)).alias("end")))
        return F.struct(end.alias("at"), F.when(c.startswith(left), F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(_chunks(formatted), start, step, lambda s: s["spans"])


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def format_chats(chats: DataFrame) -> DataFrame:
    """``chats`` (with ``turns``) and ``formatted``, ``loss_spans``; null turns give null."""
    return chats.withColumn("formatted", format_turns(F.col("turns"))).withColumn("loss_spans", loss_spans(F.col("formatted")))
