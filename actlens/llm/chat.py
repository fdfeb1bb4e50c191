"""Chat formatting with typed content parts.

A turn is a role and an ordered list of parts (text, image, audio, document).
A visitor turns every part into text: a text part is escaped, any other part
becomes a placeholder in its place, and its reference and the number of tokens
that the placeholder stands for are recorded as an attachment. A formatted
turn is

    <|turn|>role\\n  text and placeholders  <|end|>\\n

Control strings inside a text are escaped by a backslash after their first
character, and ``first char, k backslashes, rest`` becomes ``k + 1``
backslashes, so unescaping is exact and no text can hold a marker. Formatting
is a map over turns; nothing is grouped. A conversation is the concatenation
of its formatted turns in order, and ``read_back`` parses it again as a
stream of sorted turns with running digests, so a conversation of any length
needs bounded memory.

Defined cases: null text or role counts as empty; rows with equal turn numbers
are ordered by role and text (null turns first); repeated rows are turns of
their own; an unknown part kind is kept as a document; a null conv_id is a
conversation of its own; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: strings that end, begin or mark something in common templates
CONTROL = r"(<)(\\*)(\||/?s>|</?SYS>>)|(\[)(\\*)(/?INST\])"
ESCAPED = r"(<)\\(\\*)(\||/?s>|</?SYS>>)|(\[)\\(\\*)(/?INST\])"
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: tokens that one unit of a part stands for (image tile, second, page)
TOKENS_PER_UNIT = {"image": 576.0, "audio": 25.0, "document": 512.0}
LOSS_ROLE = "assistant"
PART_TYPE = "array<struct<kind:string,text:string,ref:string,units:double>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$1$4\\$2$5$3$6")


_UNESCAPE = re.compile(ESCAPED)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "".join(x or "" for x in m.groups()), text) if "\\" in text else text


class PartVisitor:
    """One method per part kind; each returns a Column over the part struct."""

    def text(self, part: Column) -> Column:
        return escape(part["text"])

    def attachment(self, kind: str, part: Column) -> Column:
        return F.concat(F.lit(f"<|{kind}:"), escape(part["ref"]), F.lit("|>"))

    def tokens(self, kind: str, part: Column) -> Column:
        return F.ceil(F.coalesce(part["units"], F.lit(1.0)) * TOKENS_PER_UNIT[kind]).cast("long")

    def visit(self, part: Column) -> Column:
        """struct(piece, kind, ref, tokens); kind is null for a text part."""
        kind = F.when(part["kind"].isNull() | (part["kind"] == "text"), F.lit(None)).when(
            part["kind"].isin(*TOKENS_PER_UNIT), part["kind"]).otherwise(F.lit("document"))
        piece, tokens = self.text(part), F.lit(0).cast("long")
        for k in TOKENS_PER_UNIT:
            piece = F.when(kind == k, self.attachment(k, part)).otherwise(piece)
            tokens = F.when(kind == k, self.tokens(k, part)).otherwise(tokens)
        return F.struct(piece.alias("piece"), kind.alias("kind"), part["ref"].alias("ref"),
                        tokens.alias("tokens"))


def text_parts(text: Column) -> Column:
    """A text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("double").alias("units"))).cast(PART_TYPE)


def format_turns(turns: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """Formats every row of (conv_id, turn, role, parts).

    Returns conv_id, turn, role, formatted, loss (the turn's text is learned),
    loss_start and loss_chars (code points inside ``formatted``), attachments,
    expanded_tokens."""
    visitor = visitor or PartVisitor()
    role = F.regexp_replace(escape(F.col("role")), "\n", "<|nl|>")
    seen = F.transform("parts", visitor.visit)
    held = F.filter("_seen", lambda p: p["kind"].isNotNull())
    return (turns.withColumn("_seen", seen)
            .withColumn("_body", F.array_join(F.transform("_seen", lambda p: p["piece"]), ""))
            .withColumn("_head", F.concat(F.lit(OPEN), role, F.lit("\n")))
            .select("conv_id", "turn", "role",
                    F.concat("_head", "_body", F.lit(CLOSE)).alias("formatted"),
                    F.coalesce(F.col("role") == LOSS_ROLE, F.lit(False)).alias("loss"),
                    F.length("_head").cast("long").alias("loss_start"),
                    F.length("_body").cast("long").alias("loss_chars"),
                    F.transform(held, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"),
                                                         p["tokens"].alias("tokens"))).alias("attachments"),
                    F.coalesce(F.aggregate(F.transform("_seen", lambda p: p["tokens"]),
                                           F.lit(0).cast("long"), lambda a, b: a + b),
                               F.lit(0)).cast("long").alias("expanded_tokens")))


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    if not (formatted.startswith(OPEN) and formatted.endswith(CLOSE)):
        raise ValueError("not a formatted turn")
    role, _, body = formatted[len(OPEN):-len(CLOSE)].partition("\n")
    return unescape(role.replace("<|nl|>", "\n")), unescape(body)


class _Digest:
    """Running digests of one conversation."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss: bool, start: int, length: int) -> None:
        role, text = parse_turn(formatted)
        self.turns.update(f"{role}\n{text}\n".encode())
        self.n += 1
        self.chars += len(formatted)
        if loss:
            learned = unescape(formatted[start:start + length])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                  ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                  ("formatted_chars", pa.int64())])


def _read_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, state, rows = None, None, []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for conv, formatted, loss, start, length in zip(*cols):
            if state is None or conv != current:
                if state is not None:
                    rows.append((current, *state.row()))
                current, state = conv, _Digest()
            state.add(formatted, loss, start, length)
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)
            rows = []
    if state is not None:
        rows.append((current, *state.row()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, parsed from the formatted turns in order."""
    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (formatted.repartition(parts, "conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "formatted")
            .select("conv_id", "formatted", "loss", "loss_start", "loss_chars")
            .mapInArrow(_read_sorted, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                      "loss_sha256 string, formatted_chars long"))
