"""Chat formatting by schema fingerprints, with DataFrame functions only.

The nested field paths of a record are hashed. The hash selects a declarative mapping that says where the turns
are, and the turns are written with marks that a text can't forge: control strings in it are escaped.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, ESCAPE = "###", "</turn>", "\\"
#: Roles as they are written, by what layouts call them; other roles stay as they are.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are: a list with a role and a text each, or fields with a fixed role.

    ``parts`` has (role, fields); fields of one turn are joined by a line break.
    """

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def skeleton(self) -> str:
        """The layout's field paths as :func:`skeleton` writes them."""
        if self.turns:
            inner = ", ".join(f"{x}: _" for x in sorted((self.role, self.text)))
            return f"OBJECT<{self.turns}: ARRAY<OBJECT<{inner}>>>"
        return "OBJECT<" + ", ".join(f"{x}: _" for x in sorted(x for _, xs in self.parts for x in xs)) + ">"

    def fits(self, record: Column) -> Column:
        """Does a record have the paths that the mapping needs, as scalars? Additional ones don't count."""

        def scalar(of: Column, path: str) -> Column:
            kind = F.schema_of_variant(F.try_variant_get(of, f"$.{path}", "variant"))
            return ~F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))

        def present(of: Column, path: str) -> Column:
            return F.try_variant_get(of, f"$.{path}", "variant").isNotNull()

        if not self.turns:
            each = [present(record, x) & scalar(record, x) for _, xs in self.parts for x in xs]
            return reduce(and_, each)
        entries = F.try_variant_get(record, f"$.{self.turns}", "array<variant>")

        def entry(t: Column) -> Column:
            kind = F.coalesce(F.schema_of_variant(t), F.lit("VOID"))
            return (kind.startswith("OBJECT") | (kind == "VOID")) & scalar(t, self.role) & scalar(t, self.text)

        some = F.exists(entries, lambda t: present(t, self.role)) & F.exists(entries, lambda t: present(t, self.text))
        return F.coalesce(F.forall(entries, entry) & ((F.size(entries) == 0) | some), F.lit(False))

    def read(self, record: Column) -> Column:
        """Its turns, as an array of (role, text)."""

        def text(of: Column, path: str) -> Column:
            return F.coalesce(F.try_variant_get(of, f"$.{path}", "string"), F.lit(""))

        if self.turns:
            entries = F.variant_get(record, f"$.{self.turns}", "array<variant>")
            return F.transform(entries, lambda t: F.struct(text(t, self.role).alias("role"), text(t, self.text).alias("text")))
        return F.array(
            *[
                F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *[text(record, x) for x in fields]).alias("text"))
                for role, fields in self.parts
            ]
        )


LAYOUTS = (
    Layout("messages", turns="messages", role="role", text="content"),
    Layout("conversations", turns="conversations", role="from", text="value"),
    Layout("turns", turns="turns", role="speaker", text="text"),
    Layout("instruction", parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt_completion", parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system_prompt", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question_answer", parts=(("user", ("question",)), ("assistant", ("answer",)))),
)


def skeleton(record: Column) -> Column:
    """Nested field paths of a variant in a fixed order: its schema with ``_`` for every scalar type."""
    return F.regexp_replace(F.schema_of_variant(record), r"(?<=[:<] )(?!OBJECT|ARRAY)[A-Z]+(\([0-9, ]*\))?", "_")


def fingerprint(record: Column) -> Column:
    return F.sha2(skeleton(record), 256)


def escape(text: Column) -> Column:
    for mark in (ESCAPE, OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(ESCAPE + mark))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column) -> Column:
    """A role on one line: line breaks in it become a mark of their own."""
    return F.concat(F.lit(OPEN + " "), F.replace(escape(role), F.lit("\n"), F.lit(ESCAPE + "n")), F.lit("\n"))


def _role(line: Column) -> Column:
    """The role of a header without its first mark. Pairs of escapes are set apart before line breaks come back."""
    pairs = F.split(line, r"\\\\", -1)
    return F.array_join(
        F.transform(pairs, lambda p: F.replace(F.replace(p, F.lit(ESCAPE + "n"), F.lit("\n")), F.lit(ESCAPE), F.lit(""))),
        ESCAPE,
    )


def format_records(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with ``layout, formatted, loss`` added; ``record`` is a variant column.

    ``formatted`` holds every turn as its header line, its escaped text and a closing line. ``loss`` are the spans of
    the assistant texts in it (first code point, from 0, and how many). A record whose paths are no layout's gets the
    layout with the most paths that it has, lists first; its additional paths stay in the record only. One that fits none gets
    a null layout, no spans and its JSON as text; a null one gets an empty text. Null roles and texts are empty.
    Columns of these three names are replaced.
    """
    names = {hashlib.sha256(x.skeleton().encode()).hexdigest(): x for x in LAYOUTS}
    selected, layout = F.col("__print"), F.lit(None).cast("string")
    turns = F.lit(None).cast("array<struct<role: string, text: string>>")
    for mapping in sorted(LAYOUTS, key=lambda x: (not x.turns, -sum(len(xs) for _, xs in x.parts)), reverse=True):
        layout = F.when(mapping.fits(F.col(record)), mapping.name).otherwise(layout)
    for hash_, mapping in names.items():
        layout = F.when(selected == hash_, mapping.name).otherwise(layout)
        turns = F.when(F.col("layout") == mapping.name, mapping.read(F.col(record))).otherwise(turns)
    canonical = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    named = F.transform(
        F.coalesce(turns, F.array().cast("array<struct<role: string, text: string>>")),
        lambda t: F.struct(F.coalesce(F.try_element_at(canonical, t["role"]), t["role"]).alias("role"), t["text"].alias("text")),
    )
    written = F.transform(
        F.col("__turns"),
        lambda t: F.struct(
            (t["role"] == "assistant").alias("own"), _header(t["role"]).alias("header"), escape(t["text"]).alias("text")
        ),
    )
    closing = "\n" + CLOSE + "\n"
    spans = F.aggregate(
        F.col("__written"),
        F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start: bigint, length: bigint>>))"),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["header"]) + F.length(t["text"]) + len(closing)).alias("at"),
            F.when(
                t["own"],
                F.array_append(
                    acc["spans"],
                    F.struct(
                        (acc["at"] + F.length(t["header"])).alias("start"), F.length(t["text"]).cast("long").alias("length")
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return (
        records.withColumn("__print", fingerprint(F.col(record)))
        .withColumn("layout", layout)
        .withColumn("__turns", named)
        .withColumn("__written", written)
        .withColumn(
            "formatted",
            F.when(F.col("layout").isNull(), F.coalesce(F.to_json(F.col(record)), F.lit(""))).otherwise(
                F.array_join(F.transform(F.col("__written"), lambda t: F.concat(t["header"], t["text"], F.lit(closing))), "")
            ),
        )
        .withColumn("loss", spans["spans"])
        .drop("__print", "__turns", "__written")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    pieces = F.split(formatted, "\n" + CLOSE + "\n", -1)
    head = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            _role(F.substr(head(p), F.lit(len(OPEN) + 2))).alias("role"),
            unescape(F.substr(p, F.length(head(p)) + 2)).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between the spans."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )


def from_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, record`` of rows by turn (conv_id, turn, role, text): one record in the layout "messages" each.

    Turns of equal number go by role and text; null numbers come first; null roles and texts are empty. Rows without
    an id are one conversation. A conversation is one row of the result, so it has to fit one.
    """
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")
    )
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("gathered"))
    messages = F.transform("gathered", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return gathered.select("conv_id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


def check_columns(formatted: DataFrame) -> DataFrame:
    """Digests of what can be read back from ``formatted(conv_id, formatted, loss)``."""
    read = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn(
        "learnt", read_loss(F.col("formatted"), F.col("loss"))
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: What :func:`check_columns` gives for the conversations table and the extra conversation, by DuckDB.
SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), written AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS safe,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), chr(10), '\n') AS head
  FROM given
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(safe) + 14)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""
