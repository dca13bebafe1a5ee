r"""Chat formatting by schema fingerprints, with DataFrame functions only.

Sources keep conversations in different layouts: one row per message, a list of messages, prompt and
completion, instruction with input. The nested field paths of a layout, without types, are hashed
into a fingerprint, and the fingerprint selects a declarative mapping that turns the rows into
canonical turns ``(conv_id, turn, role, text)``. A whole frame has one layout (its schema);
``turns_from_json`` reads the layout of each row of a JSON column.

The template writes ``### role: text</turn>\n`` per turn. Inside role and text ``\`` becomes ``\\``,
``### `` becomes ``\h## `` and ``</turn>`` becomes ``\l/turn>``; in a role ``:`` becomes ``\c``.
None of the escaped control strings overlaps itself or is made by the escaping, so the output
splits at ``</turn>\n`` without looking back and unescapes exactly.

Formatted text is kept in segments of ``SEGMENT_TURNS`` turn numbers, whose concatenation in order is
the conversation: no task holds more of a long conversation than that, besides a digest of it.

Null text and null role are empty. Turns are in order of (turn, role, text); rows without a turn
number come last, in one segment of their own. Repeated rows are repeated turns. Rows with a null
conversation id form one conversation. A conversation without rows does not exist, so an empty table
gives no rows. Columns outside a mapping are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_TURNS = 256
OPEN, CLOSE = "### ", "</turn>\n"
#: Roles whose text is learned.
LEARNED = ("assistant",)


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``kind`` is ``row`` (a message per row: turn, role and text are columns), ``list`` (``items``
    is an array of structs with role and text) or ``fields`` (each part is a (role, path) whose text
    is one turn; a part with null or empty text is left out).
    """

    name: str
    kind: str
    key: str
    turn: str = ""
    role: str = ""
    text: str = ""
    items: str = ""
    parts: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> frozenset[str]:
        if self.kind == "row":
            return frozenset((self.key, self.turn, self.role, self.text))
        if self.kind == "list":
            element = f"{self.items}[]"
            return frozenset((self.key, self.items, element, f"{element}.{self.role}", f"{element}.{self.text}"))
        return frozenset((self.key, *(path for _, path in self.parts)))


SHARED_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("message_rows", "row", "conv_id", turn="turn", role="role", text="text"),
    Mapping("messages", "list", "id", items="messages", role="role", text="content"),
    Mapping("conversations", "list", "id", items="conversations", role="from", text="value", roles=SHARED_ROLES),
    Mapping("prompt", "fields", "id", parts=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", "fields", "id", parts=(("user", "prompt"), ("assistant", "response"))),
    Mapping(
        "instruction",
        "fields",
        "id",
        parts=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Mapping(
        "system_instruction",
        "fields",
        "id",
        parts=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
)


def field_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Every nested field of a type as a dotted path, ``[]`` for the element of an array."""
    if isinstance(kind, T.StructType):
        out = set()
        for field in kind:
            path = f"{prefix}.{field.name}" if prefix else field.name
            out |= {path} | field_paths(field.dataType, path)
        return out
    if isinstance(kind, T.ArrayType):
        return {f"{prefix}[]"} | field_paths(kind.elementType, f"{prefix}[]")
    return set()


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def select_mapping(schema: T.StructType, mappings: Iterable[Mapping] = MAPPINGS) -> Mapping:
    """The mapping of a schema: that of equal fingerprint, or else, among those of equal fingerprint
    once the schema's further fields are left out, the one with the most fields (then by name).
    ``ValueError`` if there is none."""
    paths = field_paths(schema)
    known = {fingerprint(m.paths()): m for m in mappings}
    whole = known.get(fingerprint(paths))
    if whole is not None:
        return whole
    inside = [m for print_, m in known.items() if fingerprint(paths & m.paths()) == print_]
    if not inside:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    return min(inside, key=lambda m: (-len(m.paths()), m.name))


def _path(path: str) -> Column:
    first, *rest = path.split(".")
    column = F.col(f"`{first}`")
    for name in rest:
        column = column[name]
    return column


def _apply(rows: DataFrame, mapping: Mapping) -> DataFrame:
    key = _path(mapping.key).alias("conv_id")
    if mapping.kind == "row":
        return rows.select(
            key,
            _path(mapping.turn).cast("long").alias("turn"),
            _path(mapping.role).cast("string").alias("role"),
            _path(mapping.text).cast("string").alias("text"),
        )
    if mapping.kind == "list":
        spread = rows.select(key, F.posexplode(_path(mapping.items)).alias("turn", "item"))
        role = F.col("item")[mapping.role].cast("string")
        for source, target in reversed(mapping.roles):
            role = F.when(F.col("item")[mapping.role] == source, F.lit(target)).otherwise(role)
        return spread.select(
            "conv_id",
            F.col("turn").cast("long").alias("turn"),
            role.alias("role"),
            F.col("item")[mapping.text].cast("string").alias("text"),
        )
    parts = F.array(
        *(
            F.struct(F.lit(role).alias("role"), _path(path).cast("string").alias("text"))
            for role, path in mapping.parts
        )
    )
    filled = F.filter(parts, lambda p: F.coalesce(p["text"], F.lit("")) != "")
    spread = rows.select(key, F.posexplode(filled).alias("turn", "part"))
    return spread.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.col("part")["role"].alias("role"),
        F.col("part")["text"].alias("text"),
    )


def canonical_turns(rows: DataFrame, mappings: Iterable[Mapping] = MAPPINGS) -> DataFrame:
    """The turns of a frame of any known layout."""
    return _apply(rows, select_mapping(rows.schema, tuple(mappings)))


SCALARS = r": (?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|DECIMAL\(\d+,\d+\))"


def json_shape(mapping: Mapping) -> str:
    """The layout of a mapping as ``row_shapes`` writes it."""
    if mapping.kind == "list":
        element = ", ".join(sorted((mapping.role, mapping.text)))
        fields = {mapping.key: mapping.key, mapping.items: f"{mapping.items}: ARRAY<OBJECT<{element}>>"}
    else:
        fields = {p: p for p in mapping.paths()}
    return f"OBJECT<{', '.join(fields[name] for name in sorted(fields))}>"


def turns_from_json(
    rows: DataFrame, column: str, mappings: Iterable[Mapping] = MAPPINGS
) -> tuple[DataFrame, DataFrame]:
    """Turns of a column of JSON objects, each of its own layout, and the rows left over.

    The fingerprint of a row is the hash of its nested field names. Rows that are null, no JSON or of
    a layout without a mapping are returned as they came, with their ``fingerprint``.
    """
    mappings = tuple(mappings)
    shape = F.regexp_replace(F.schema_of_variant(F.try_parse_json(F.col(f"`{column}`"))), SCALARS, "")
    marked = rows.withColumn("fingerprint", F.sha2(shape, 256))
    turns = None
    prints = []
    for mapping in mappings:
        prints.append(hashlib.sha256(json_shape(mapping).encode()).hexdigest())
        if mapping.kind == "list":
            kind = f"`{mapping.key}` string, `{mapping.items}` array<struct<`{mapping.role}`: string, `{mapping.text}`: string>>"
        else:
            kind = ", ".join(f"`{p}` string" for p in sorted(mapping.paths()))
        own = marked.where(F.col("fingerprint") == prints[-1])
        found = _apply(own.select(F.from_json(F.col(f"`{column}`"), kind).alias("r")).select("r.*"), mapping)
        turns = found if turns is None else turns.unionByName(found)
    left = marked.where(F.col("fingerprint").isNull() | ~F.col("fingerprint").isin(*prints))
    return turns, left


def escaped(text: Column) -> Column:
    for plain, mark in (("\\", "\\\\"), ("### ", "\\h## "), ("</turn>", "\\l/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescaped(text: Column) -> Column:
    """Undo ``escaped``. Cut at each double backslash from the left, a backslash left over is always
    the first character of one of the other marks."""

    def piece(x: Column) -> Column:
        for mark, plain in (("\\h", "#"), ("\\l", "<"), ("\\c", ":")):
            x = F.replace(x, F.lit(mark), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, segment, formatted, loss: segments of formatted conversations, and for each the spans
    (start, length in code points) of the text that is learned."""
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit(":"), F.lit("\\c"))
    text = escaped(F.coalesce("text", F.lit("")))
    last = F.lit((1 << 63) - 1).cast("long")
    pieces = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / SEGMENT_TURNS), last).alias("segment"),
        F.coalesce("turn", last).alias("turn"),
        F.col("role").alias("plain_role"),
        F.concat(F.lit(OPEN), role, F.lit(": ")).alias("head"),
        text.alias("body"),
    )
    rows = F.struct("turn", F.coalesce("plain_role", F.lit("")).alias("role"), "body", "head")
    place = Window.partitionBy("conv_id", "segment").orderBy("turn", "plain_role", "body")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("head") + F.length("body") + len(CLOSE)
    pieces = pieces.withColumns(
        {
            "start": F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("head"),
            "row": rows,
        }
    )
    grouped = pieces.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("start", "row"))).alias("rows"))
    learned = F.filter("rows", lambda r: r["row"]["role"].isin(*LEARNED))
    return grouped.select(
        "conv_id",
        "segment",
        F.array_join(
            F.transform("rows", lambda r: F.concat(r["row"]["head"], r["row"]["body"], F.lit(CLOSE))), ""
        ).alias("formatted"),
        F.transform(
            learned, lambda r: F.struct(r["start"].alias("start"), F.length(r["row"]["body"]).alias("length"))
        ).alias("loss"),
    )


def read_back(segments: DataFrame) -> DataFrame:
    """The turns and the learned texts that a formatted table holds: conv_id, segment, turns (array of
    role and text), learned (array of texts), formatted_chars."""
    pieces = F.split("formatted", "</turn>\\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        cut = F.locate(": ", piece)
        return F.struct(
            unescaped(F.substring(piece, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"),
            unescaped(F.substring(piece, cut + 2, F.length(piece))).alias("text"),
        )

    return segments.select(
        "conv_id",
        "segment",
        F.transform(pieces, turn).alias("turns"),
        F.transform(
            "loss",
            lambda s: unescaped(
                F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"])
            ),
        ).alias("learned"),
        F.length("formatted").alias("formatted_chars"),
    )


def digests(segments: DataFrame) -> DataFrame:
    """One row per conversation with digests of what ``read_back`` finds in its segments."""
    rows = read_back(segments).select(
        "conv_id",
        F.struct(
            "segment",
            F.array_join(
                F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
            ).alias("turns"),
            F.array_join("learned", "").alias("learned"),
        ).alias("part"),
        F.size("turns").alias("n"),
        "formatted_chars",
    )
    whole = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("part")).alias("parts"),
        F.sum("n").alias("n_turns"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )
    turns = F.array_join(F.col("parts")["turns"], "")
    learned = F.array_join(F.col("parts")["learned"], "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
