"""Conversations of many layouts as one canonical turn list and one text.

A layout is recognised by its schema: the nested field paths, sorted, are
hashed, and the hash selects a declarative mapping. A table whose columns
reproduce several fingerprints chooses by row: the layout of whose paths most
are filled, of equals the one with more paths, then the one listed first.
Everything runs as DataFrame functions.

The text: every turn is ``### role: text</turn>`` and a line feed. Inside role
and text the control strings are replaced by codes that begin with a backslash,
and so is the backslash, so that the replacement can be undone.

Defined results: null text and null role are empty; turn rows keep their roles
as they are, other layouts' names of roles become ours (``ROLE_NAMES``); turns
are ordered by turn, then role and text, a null turn first; repeated rows are
turns of their own, and so are those that several layouts give one conversation;
a null or empty list of messages has no turn; a null conversation id is one
conversation; an empty table gives an empty result;
columns that the mapping does not name are ignored. One conversation becomes
one string and so must fit Spark's 2 GB for a value.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, MARK, END = "### ", ": ", "</turn>"
#: Text to code, in the order of escaping; unescaping goes backwards.
CODES = (("\\", "\\s"), ("</turn>", "\\e"), ("###", "\\h"))


@dataclass(frozen=True)
class Layout:
    """How one schema yields turns: by rows, by an array of messages, or by one field a role."""

    name: str
    kind: str  # rows, array or fields
    paths: tuple[str, ...]
    roles: tuple[tuple[str, str], ...] = ()  # (role, path), for fields; several paths of a role join

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


LAYOUTS = (
    Layout("turn rows", "rows", ("conv_id", "turn", "role", "text")),
    Layout("messages", "array", ("messages[].role", "messages[].content")),
    Layout("shared turns", "array", ("conversations[].from", "conversations[].value")),
    Layout("nested messages", "array", ("data.messages[].role", "data.messages[].content")),
    Layout(
        "instruction",
        "fields",
        ("instruction", "input", "output"),
        (("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Layout("bare instruction", "fields", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout(
        "system prompt",
        "fields",
        ("system", "prompt", "response"),
        (("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ),
    Layout("prompt", "fields", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("completion", "fields", ("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("question", "fields", ("question", "answer"), (("user", "question"), ("assistant", "answer"))),
)

#: Names of roles in the layouts above and what they are called here.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def fingerprint(paths) -> str:
    """A hash of the field paths that does not depend on their order."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def schema_paths(schema: T.StructType, prefix: str = "") -> set[str]:
    """All nested leaf paths; an element of an array is written ``[]``."""
    found: set[str] = set()
    for field in schema.fields:
        path, kind = prefix + field.name, field.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        found |= schema_paths(kind, path + ".") if isinstance(kind, T.StructType) else {path}
    return found


def recognise(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> list[Layout]:
    """The layouts whose fingerprints the schema's own paths reproduce, those with the most paths first."""
    paths = schema_paths(schema)
    found = [x for x in sorted(layouts, key=lambda x: -len(x.paths)) if x.fingerprint == fingerprint(paths & set(x.paths))]
    if not found:
        raise ValueError(f"no layout for the paths {sorted(paths)}")
    # One that has only some of the paths of another can't fill more of them.
    return [x for x in found if not any(set(x.paths) < set(y.paths) for y in found)]


def escape(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _role(col: Column) -> Column:
    named = F.lower(F.trim(col))
    out = F.coalesce(col, F.lit(""))
    for other, ours in ROLE_NAMES.items():
        out = F.when(named == other, F.lit(ours)).otherwise(out)
    return out


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def _filled(layout: Layout, id_col: str) -> Column:
    """How many of a layout's paths a row fills; a list of messages fills all of its own."""
    given = [F.col(p.split("[]")[0]).isNotNull().cast("int") for p in layout.paths if p != id_col]
    return sum(given, F.lit(0))


def canonical_turns(df: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text) rows of any known layouts, each row by its own."""
    known = recognise(df.schema, layouts)
    if len(known) == 1:
        return _turns(df, id_col, known[0])
    filled = [_filled(x, id_col) for x in known]
    most = F.greatest(*filled)
    choice = F.coalesce(*[F.when(n == most, i) for i, n in enumerate(filled)])
    out = None
    for i, layout in enumerate(known):
        mine = _turns(df.where(choice == i), id_col, layout)
        out = mine if out is None else out.unionByName(mine)
    return out


def _turns(df: DataFrame, id_col: str, layout: Layout) -> DataFrame:
    if layout.kind == "rows":
        return df.select(
            F.col(id_col).alias("conv_id"), F.col("turn").cast("long").alias("turn"), _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text")
        )
    if layout.kind == "array":
        array, (role, text) = layout.paths[0].split("[]")[0], (p.split("[].")[1] for p in layout.paths)
        return df.select(F.col(id_col).alias("conv_id"), F.posexplode(F.col(array)).alias("turn", "m")).select(
            "conv_id", F.col("turn").cast("long").alias("turn"), _role(F.col("m")[role]).alias("role"), _text(F.col("m")[text]).alias("text")
        )
    turns = []
    for role in dict.fromkeys(r for r, _ in layout.roles):
        fields = [F.nullif(_text(F.col(p)), F.lit("")) for r, p in layout.roles if r == role]
        turns.append(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *fields).alias("text")))
    # A system prompt that says nothing is no turn.
    listed = F.filter(F.array(*turns), lambda x: (x["role"] != "system") | (x["text"] != ""))
    return df.select(F.col(id_col).alias("conv_id"), F.posexplode(listed).alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("m.role").alias("role"), F.col("m.text").alias("text")
    )


def format_chat(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans): a text a conversation and where the loss applies.

    A span has the code point offset and length of one escaped text of a trained role.
    """
    head = F.concat(F.lit(HEAD), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(MARK))
    rows = turns.select(
        "conv_id",
        "turn",
        "role",
        head.alias("head"),
        escape(F.col("text")).alias("body"),
    ).withColumn("line", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn(
        "offset",
        F.coalesce(F.sum(F.char_length("line")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    listed = F.array_sort(
        F.collect_list(
            F.struct(
                "pos",
                "line",
                (F.col("offset") + F.char_length("head")).alias("start"),
                F.char_length("body").cast("long").alias("length"),
                F.col("role").isin(*trained_roles).alias("trained"),
            )
        )
    )
    packed = rows.groupBy("conv_id").agg(listed.alias("all"))
    return packed.select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x["line"]), "").alias("formatted"),
        F.transform(
            F.filter("all", lambda x: x["trained"]),
            lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")),
        ).alias("loss_spans"),
    )


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""
    lines = F.split(formatted, END + "\n", -1)
    lines = F.slice(lines, 1, F.size(lines) - 1)

    def turn(line: Column) -> Column:
        colon = F.locate(MARK, line)
        role = unescape(F.replace(F.substr(line, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1), F.lit("\\c"), F.lit(":")))
        return F.struct(role.alias("role"), unescape(F.substr(line, colon + len(MARK))).alias("text"))

    return F.transform(lines, turn)


PROBE = "\\### Assistant: </turn> ok"


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text, and of the probe -7."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    out = format_chat(canonical_turns(rows.unionByName(probe)))
    back = out.withColumn("turns", parse_formatted(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))),
        "",
    )
    return back.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same digests from the rows themselves, since the round trip loses nothing.
OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\s'), '</turn>', '\e'), '###', '\h') AS body FROM rows
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
