"""Chat formatting by prefix-target expansion.

Every turn becomes a marked piece of its conversation's text. Every assistant turn is an example of its own: its text is the
conversation from the start to the end of that turn, and only the reply is trainable. ``examples`` writes these texts out,
``expand`` reads them back.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINABLE = "assistant"


def escape(text: Column) -> Column:
    """Texts in which no control string is left: ``<|`` gets a backslash, ``<\\|`` one more, and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    """Roles on one line: backslashes are doubled, line ends become ``\\n``, then as in texts."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(role))


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, piece, begin, loss_begin, loss_end`` for every row of ``conversations(conv_id, turn, role, text)``.

    ``piece`` is the marked turn; ``begin`` is its place in the joined pieces of the conversation, in characters. For
    assistant turns ``[loss_begin, loss_end)`` is the reply in the joined pieces, without marks: the trainable
    part of the example that ends with this piece. It is null for other turns.

    Null roles and texts are empty. Rows are in order of turn (null first), role and text; repeated rows
    are turns of their own. Rows without conv_id form one conversation. Other columns are ignored.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("body", escape(F.col("text")))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("place"),
        "piece",
        F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)).cast("long").alias("begin"),
        (F.col("role") == TRAINABLE).alias("trainable"),
        F.char_length("head").alias("head"),
        F.char_length("body").alias("body"),
    )
    loss = F.when(F.col("trainable"), F.col("begin") + F.col("head"))
    return rows.select(
        "conv_id", "place", "piece", "begin", loss.alias("loss_begin"), (loss + F.col("body")).alias("loss_end")
    )


#: Characters of examples that a task hands on at once; a longer example goes by itself.
BATCH_CHARS = 1 << 20

_WRITTEN = "conv_id long, place long, trainable boolean, text string, loss_begin long, loss_end long"
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(",")]
    columns = [pa.array(x, _KINDS[kind]) for (_, kind), x in zip(fields, zip(*rows))]
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])


def _examples(batches):
    """Rows of ``_WRITTEN`` from the pieces of one conversation after the other."""
    own, text, place, open_ = None, "", None, False
    for batch in batches:
        for conversation, at, piece, begin, loss_begin, loss_end in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if place is None or conversation != own:
                if open_:
                    yield own, place, False, text, None, None
                own, text = conversation, ""
            if begin != len(text):
                raise ValueError(f"conversation {own}: broken text at character {len(text)}")
            text, place, open_ = text + piece, at, loss_begin is None
            if not open_:
                yield own, place, True, text, loss_begin, loss_end
    if open_:
        yield own, place, False, text, None, None


def _write(batches):
    done, chars = [], 0
    for row in _examples(batches):
        if done and chars + len(row[3]) > BATCH_CHARS:
            yield _batch(done, _WRITTEN)
            done, chars = [], 0
        done.append(row)
        chars += len(row[3])
    if done:
        yield _batch(done, _WRITTEN)


def _written(formatted: DataFrame) -> DataFrame:
    """The examples, and for each conversation with turns after its last reply one row that is not ``trainable``: all its turns.

    The pieces of a conversation go through one task in order. The task holds the text of one conversation and ``BATCH_CHARS``
    characters of examples, and the examples of a conversation follow each other in the same partition.
    """
    ordered = formatted.select("conv_id", "place", "piece", "begin", "loss_begin", "loss_end")
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(_write, _WRITTEN)


def examples(formatted: DataFrame) -> DataFrame:
    """``conv_id, place, text, loss_begin, loss_end``: each assistant turn with all that precedes it, written out.

    ``[loss_begin, loss_end)`` is the reply in ``text``. The texts grow with the square of a conversation's turns, as every
    example repeats its prefix.
    """
    return _written(formatted).where("trainable").drop("trainable")


class _Reader:
    """What has been read of a conversation so far: the last example's text, counts and hash states."""

    def __init__(self, conversation):
        self.conversation, self.seen, self.turns, self.loss_chars = conversation, "", 0, 0
        self.all, self.loss, self.text = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()

    def _broken(self, at: int) -> ValueError:
        return ValueError(f"conversation {self.conversation}: broken text at character {at}")

    def add(self, place: int, trainable: bool, text: str, loss_begin: int | None, loss_end: int | None):
        """Read one example. It must begin with the text of the one before; the turns that it adds are parsed."""
        if not text.startswith(self.seen) or len(text) == len(self.seen):
            raise self._broken(len(self.seen))
        at, head, body, end = len(self.seen), 0, 0, 0
        while at < len(text):
            head, body = at + len(START), text.find("\n", at) + 1
            end = text.find("<|", body)
            if not body or not text.startswith(START, at) or not text.startswith(END + "\n", end) or "<|" in text[head:body]:
                raise self._broken(at)
            role, said = unescape_role(text[head : body - 1]), unescape(text[body:end])
            last = end + len(END) + 1 == len(text)
            if trainable and last:
                if role != TRAINABLE or (loss_begin, loss_end) != (body, end):
                    raise self._broken(at)
                before = self.text.copy()
                before.update(text[at:loss_begin].encode())
                context = self.turns, loss_begin, before.hexdigest(), loss_begin, loss_end
                self.loss_chars += len(said)
                self.loss.update(said.encode())
            self.turns += 1
            self.all.update(f"{role}\n{said}\n".encode())
            self.text.update(text[at : end + len(END) + 1].encode())
            at = end + len(END) + 1
        self.seen = text
        if not trainable:
            context = self.turns, len(text), self.text.hexdigest(), None, None
        read = self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), len(text)
        return self.conversation, place, trainable, *context, *read


_READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_EXPANDED = (
    "conv_id long, place long, trainable boolean, context_turns long, context_chars long, context_sha256 string,"
    f" loss_begin long, loss_end long, {_READ}"
)


def _read(batches):
    current, done = None, []
    for batch in batches:
        for conversation, *example in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if current is None or conversation != current.conversation:
                current = _Reader(conversation)
            done.append(current.add(*example))
        if len(done) > 1000:
            yield _batch(done, _EXPANDED)
            done = []
    if done:
        yield _batch(done, _EXPANDED)


def expand(formatted: DataFrame) -> DataFrame:
    """One row for each assistant turn, read from its example: all preceding turns are context, only that reply is trainable.

    ``context_turns`` turns and ``context_chars`` characters precede the reply in the example's text; ``context_sha256`` is the
    digest (UTF-8) of these characters, the example's untrained text. ``[loss_begin, loss_end)`` is the reply. Turns after
    the last reply, which are in no example, give one row that is not ``trainable``.

    The other columns are counts and digests of what was read up to the end of the row, unescaped.

    Every example is written out whole and read whole. As an example must begin with the one before, only the turns that it adds are
    parsed again; anything else that differs is an error.
    """
    return _written(formatted).mapInArrow(_read, _EXPANDED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of every conversation: those of its last example, or of the turns after it."""
    names = [c.split()[0] for c in _READ.split(",")]
    last = F.max_by(F.struct(*names), "place").alias("last")
    return expand(formatted).groupBy("conv_id").agg(last).select("conv_id", "last.*")
