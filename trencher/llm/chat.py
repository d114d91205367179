r"""Chat formatting with prefix-target expansion.

A turn becomes ``### role: text</turn>\n``.  A backslash in front breaks the
control strings inside roles and texts (``<\/turn>``, ``#\## ``, ``\:`` in a
role, ``\\``); dropping each backslash restores them, so formatting is exactly
reversible.

Every assistant turn is an example of its own: its context is the conversation's
formatted text before the turn, and only its text is trainable.  ``format_turns``
places the turns, ``expanded`` writes every example out with its context, and
``read_back`` reads the examples.  Examples grow with the square of a
conversation's turns; they travel turn by turn, so none is in memory whole.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trencher.llm.shared import stored, type_of

HEAD, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
#: Control strings and what stands for them inside texts, in this order.
ESCAPES = [("\\", "\\\\"), ("</turn>", "<\\/turn>"), ("### ", "#\\## ")]
TARGET = "assistant"


def escape(column):
    for plain, escaped in ESCAPES:
        column = F.replace(column, F.lit(plain), F.lit(escaped))
    return column


def format_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, position, formatted, start, end, example, loss_start, loss_end``.

    ``start`` and ``end`` are the turn's place, in code points, in its
    conversation's formatted text; ``example`` numbers the assistant turns and is
    null elsewhere, as is the span of the trainable text.  The example's context
    is the text before ``start``.

    Turns are ordered by turn, role and text, nulls first; repeated rows are turns
    of their own, a null role or text is empty, and rows of null ``conv_id`` are one
    conversation.  A conversation is ordered in one task that spills to disk: its
    digests and offsets are sequential.
    """
    c = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                             F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    c = c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    c = c.withColumn("head", F.concat(F.lit(HEAD), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(ROLE_END)))
    c = c.withColumn("body", escape(F.col("text"))).withColumn("formatted", F.concat("head", "body", F.lit(TURN_END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    target = F.col("role") == TARGET
    c = c.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("position"), "formatted", F.length("head").alias("in_head"), F.length("body").alias("in_body"),
                 F.sum(F.length("formatted").cast("long")).over(until).alias("end"), target.alias("target"), F.sum(target.cast("long")).over(until).alias("nth"))
    start = F.col("end") - F.length("formatted")
    first = F.when(F.col("target"), start + F.col("in_head"))
    return c.select("conv_id", "position", "formatted", start.alias("start"), "end", F.when(F.col("target"), F.col("nth") - 1).alias("example"),
                    first.alias("loss_start"), (first + F.col("in_body")).alias("loss_end"))


def expanded(turns: DataFrame) -> DataFrame:
    """The examples, turn by turn: ``conv_id, until, example, position, formatted, start, loss_start, loss_end``.

    ``until`` is the example's last position, its target's; the spans are set
    there only.  A conversation that goes on after its last target, or has none,
    is once more there as a whole with a null ``example``, and trains nothing.
    """
    ends = turns.where("example IS NOT NULL").select("conv_id", F.col("position").alias("until"), F.col("example").alias("nth"))
    last = turns.groupBy("conv_id").agg(F.max("position").alias("until"), F.max(F.when(F.col("example").isNotNull(), F.col("position"))).alias("target"))
    rest = last.where("target IS NULL OR target < until").select("conv_id", "until", F.lit(None).cast("long").alias("nth"))
    ends = ends.unionByName(rest).withColumnRenamed("conv_id", "of")
    at_end = lambda c: F.when(F.col("position") == F.col("until"), F.col(c)).alias(c)
    met = turns.join(ends, turns["conv_id"].eqNullSafe(ends["of"]) & (turns["position"] <= ends["until"]))
    return met.select("conv_id", "until", F.col("nth").alias("example"), "position", "formatted", "start", at_end("loss_start"), at_end("loss_end"))


def example_texts(turns: DataFrame) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end``: every example with its context as one text."""
    parts = F.array_sort(F.collect_list(F.struct("position", "formatted")))
    text = F.array_join(F.transform(parts, lambda p: p["formatted"]), "").alias("text")  # one example: one value of the output
    return expanded(turns).where("example IS NOT NULL").groupBy("conv_id", "example").agg(text, F.max("loss_start").alias("loss_start"), F.max("loss_end").alias("loss_end"))


class _Reader:
    """Reads one example's formatted text as a stream; where turns begin and end it finds out itself."""

    turn = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.DOTALL)

    def __init__(self):
        self.left, self.n, self.chars, self.learned = "", 0, 0, None
        self.turns = hashlib.sha256()

    @staticmethod
    def plain(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def read(self, text: str) -> None:
        self.left, self.chars, at = self.left + text, self.chars + len(text), 0
        while found := self.turn.match(self.left, at):
            self.turns.update("".join(self.plain(g) + "\n" for g in found.groups()).encode("utf-8", "surrogatepass"))
            self.n, at = self.n + 1, found.end()
        self.left = self.left[at:]

    def learn(self, text: str) -> None:
        self.learned = self.plain(text)

    def record(self) -> tuple:
        if self.left:
            raise ValueError("an example's text ends within a turn")
        return self.n, self.turns.hexdigest(), self.chars, self.learned


def read_examples(examples: DataFrame) -> DataFrame:
    """Parses what ``expanded`` returns: ``conv_id, until, n_turns, turns_sha256, formatted_chars, learned`` of each example.

    An example is read as one stream of text, of which only the turn at hand is
    in memory; ``learned`` is the trainable text, which its span of the stream holds.
    """
    kind = type_of(examples, "conv_id")

    def run(batches):
        import pyarrow as pa

        current, reader = None, None
        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            rows = []
            for c, until, text, start, a, b in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "until", "formatted", "start", "loss_start", "loss_end"))):
                if reader is None or (c, until) != current:
                    if reader:
                        rows.append((*current, *reader.record()))
                    current, reader = (c, until), _Reader()
                reader.read(text)
                if a is not None:
                    reader.learn(text[a - start:b - start])
            yield _records(pa, rows, kinds, _EXAMPLE)
        if reader:
            yield _records(pa, [(*current, *reader.record())], kinds, _EXAMPLE)

    own = examples.select("conv_id", "until", "position", "formatted", "start", "loss_start", "loss_end")
    own = own.repartition("conv_id", "until").sortWithinPartitions("conv_id", "until", "position")
    return own.mapInArrow(run, f"conv_id {kind}, until long, n_turns long, turns_sha256 string, formatted_chars long, learned string")


_EXAMPLE = ["conv_id", "until", "n_turns", "turns_sha256", "formatted_chars", "learned"]
_CONVERSATION = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _records(pa, rows: list, kinds: list, names: list):
    return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)


def read_back(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read from the examples of ``turns`` (what ``format_turns`` returns).

    Each example is parsed by itself, wherever its conversation's others are; a
    conversation's longest one tells of its turns, and what the examples train
    is digested in their order.
    """
    turns = stored(turns, "turns")
    kind = type_of(turns, "conv_id")

    def run(batches):
        import pyarrow as pa

        current, of = None, None
        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows = []
            for c, _, n, turns_, chars, learned in zip(*(column.to_pylist() for column in batch.columns)):
                if of is None or c != current:
                    if of:
                        rows.append((current, of[0], of[1], loss_chars, loss.hexdigest(), of[2]))
                    current, loss_chars, loss = c, 0, hashlib.sha256()
                of = n, turns_, chars
                if learned is not None:
                    loss_chars += len(learned)
                    loss.update(learned.encode("utf-8", "surrogatepass"))
            yield _records(pa, rows, kinds, _CONVERSATION)
        if of:
            yield _records(pa, [(current, of[0], of[1], loss_chars, loss.hexdigest(), of[2])], kinds, _CONVERSATION)

    read = read_examples(expanded(turns)).repartition("conv_id").sortWithinPartitions("conv_id", "until")
    return read.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
