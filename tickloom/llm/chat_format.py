"""Chat formatting: a finite-state machine over roles and text segments with loss flags.

A template says how a turn is marked, which strings control the format, which roles are trained
on, and which role may follow which. A turn becomes three segments: its header, its body and its
end. Inside roles and bodies every escape character and control string gets an escape character
before it, so the formatted text can be read back exactly.

Turns stand by turn number, null first, then role, then text; repeated rows are turns of their
own. Null roles and texts count as empty; a null conversation id is a conversation. An order that
the machine does not allow is formatted all the same and named in ``problem``. An empty table
gives no rows; other columns are not read.

A conversation is cut into stretches of turn numbers. Order, and lengths so far, are worked out
inside stretches and carried from one to the next by a table with a row a stretch, so a
conversation with most of the rows is spread over many tasks. Only digests of a whole
conversation, which are sequential, read it in one task, turn by turn, in memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers in a stretch.
STRETCH = 4096


@dataclass(frozen=True)
class Template:
    """``open`` and ``close`` mark a turn, ``colon`` ends the role; ``follows`` has the machine's steps."""

    open: str = "### "
    colon: str = ": "
    close: str = "</turn>"
    escape: str = "\\"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    first: frozenset[str] = frozenset({"system", "user"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        },
        hash=False,
    )
    final: frozenset[str] = frozenset({"assistant"})

    @property
    def body_controls(self) -> list[str]:
        return [self.escape, self.open.strip(), self.close]

    @property
    def role_controls(self) -> list[str]:
        return [*self.body_controls, self.colon.strip()]


def _escaped(text: Column, controls: list[str], escape: str) -> Column:
    pattern = "(" + "|".join(map(re.escape, controls)) + ")"
    return F.regexp_replace(text, pattern, re.escape(escape) + "$1" if escape == "\\" else escape + "$1")


def _one_of(role: Column, roles: frozenset[str]) -> Column:
    return role.isin(sorted(roles)) if roles else F.lit(False)


def format_turns(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """Per turn: conv_id, place, role, segments (text, loss), begin, problem.

    ``place`` counts turns from 0, ``begin`` is the turn's first character in its conversation.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    header = F.concat(F.lit(template.open), _escaped(F.col("role"), template.role_controls, template.escape), F.lit(template.colon))
    body = _escaped(F.col("text"), template.body_controls, template.escape)
    parts = [(header, F.lit(False)), (body, _one_of(F.col("role"), template.loss_roles)), (F.lit(template.close + "\n"), F.lit(False))]
    turns = turns.withColumn("segments", F.array(*[F.struct(t.alias("text"), x.alias("loss")) for t, x in parts]))
    turns = turns.withColumn("length", sum((F.length(F.col("segments")[i]["text"]) for i in range(3)), F.lit(0).cast("long")))
    turns = turns.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    last = F.max(F.struct("turn", "role", "text"))["role"]
    held = turns.groupBy("conv_id", "stretch").agg(
        F.count(F.lit(1)).alias("count"), F.sum("length").alias("chars"), last.alias("last")
    )
    along = Window.partitionBy("conv_id").orderBy(F.col("stretch").asc_nulls_first())
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(
        F.col("conv_id").alias("c"),
        F.col("stretch").alias("s"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("turns_before"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
        F.lag("last").over(along).alias("role_before"),
    )
    joined = turns.join(held, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("stretch").eqNullSafe(F.col("s")))
    inside = Window.partitionBy("c", "s").orderBy(*order)
    previous = F.coalesce(F.lag("role").over(inside), F.col("role_before"))
    allowed = F.when(previous.isNull(), _one_of(F.col("role"), template.first))
    for one, after in template.follows.items():
        allowed = allowed.when(previous == one, _one_of(F.col("role"), after))
    allowed = allowed.otherwise(F.lit(False))
    named = F.concat_ws(" after ", F.col("role"), F.coalesce(previous, F.lit("the start")))
    return joined.select(
        "conv_id",
        (F.col("turns_before") + F.row_number().over(inside) - 1).alias("place"),
        "role",
        "segments",
        (F.col("chars_before") + F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("begin"),
        F.when(~allowed, named).alias("problem"),
    )


class Reader:
    """Reads turns back from formatted text, given piece by piece."""

    def __init__(self, template: Template) -> None:
        self.template, self.text = template, ""
        escape = re.escape(template.escape)
        controls = "|".join(map(re.escape, template.role_controls))
        self.mark = re.compile(f"{escape}(?:{controls})|({re.escape(template.close)}\n)|({re.escape(template.colon)})")
        self.plain = re.compile(f"{escape}({controls})")

    def unescape(self, text: str) -> str:
        return self.plain.sub(r"\1", text)

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """The turns that ``piece`` completes, as role and text."""
        self.text += piece
        done, colon = 0, None
        for m in self.mark.finditer(self.text):
            if m[2] and colon is None:
                colon = m
            elif m[1]:
                if colon is None or not self.text.startswith(self.template.open, done):
                    raise ValueError("a turn without a header")
                role = self.text[done + len(self.template.open) : colon.start()]
                yield self.unescape(role), self.unescape(self.text[colon.end() : m.start()])
                done, colon = m.end(), None
        self.text = self.text[done:]


def read_back(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from the segments alone: n_turns, digests of turns and of loss text, lengths, valid."""
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, valid boolean"
    )
    source = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "place",
        F.col("segments.text").alias("texts"),
        F.col("segments.loss").alias("losses"),
        F.col("problem").isNull().alias("fine"),
    )
    dealt = source.repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = key = None

        def summary() -> pa.RecordBatch:
            if reader.text:
                raise ValueError(f"conversation {key} ends inside a turn")
            valid = fine and role in template.final
            row = (key, n, told.hexdigest(), loss_chars, lossy.hexdigest(), chars, valid)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if reader is None or row["conv_id"] != key:
                    if reader is not None:
                        yield summary()
                    reader, key, n, chars, loss_chars = Reader(template), row["conv_id"], 0, 0, 0
                    told, lossy, fine, role = hashlib.sha256(), hashlib.sha256(), True, ""
                fine = fine and row["fine"]
                for text, loss in zip(row["texts"], row["losses"], strict=True):
                    chars += len(text)
                    if loss:
                        plain = reader.unescape(text)
                        loss_chars += len(plain)
                        lossy.update(plain.encode())
                    for role, said in reader.feed(text):
                        n += 1
                        told.update(f"{role}\n{said}\n".encode())
        if reader is not None:
            yield summary()

    return dealt.mapInArrow(run, schema)
