"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What a turn looks like and which turns may follow which.

    A turn is ``open + role + line break + text + close``. ``control`` lists every string that must not occur
    in a text; ``open`` and ``close`` are always among them. None may contain ``\\`` or start inside another.
    ``follows`` maps a role (``""``: the start) to the roles allowed next, ``final`` holds those that may end.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def pattern(self) -> str:
        """A control string as two groups, its first character and the rest."""
        return "|".join(f"(?<={re.escape(c[0])}){re.escape(c[1:])}" for c in self.control)


def escape(text: Column, template: Template) -> Column:
    """Double every backslash and put one after the first character of every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({template.pattern()})", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of every turn: ``conv_id, at, turn, role, segment, text, loss, valid``.

    ``at`` counts a conversation's rows from 1, by turn, then role and text (nulls first), so ties and
    repeated rows have a fixed order; null roles and texts are empty. Each turn gives segment 0 (opening and
    role), 1 (its escaped text, with the loss flag of its role) and 2 (closing). ``valid`` says whether the
    machine accepts the step to this turn and, on the last turn, the end there; rejected turns are
    still formatted. Rows with a null ``conv_id`` form one conversation. Other columns are ignored. One
    window sorts by conversation and spills; no conversation is gathered in memory here.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.row_number().over(order).alias("at"), F.lag("role", 1, "").over(order).alias("_before"), F.lead("role").over(order).isNull().alias("_last"))
    step = F.lit(False)
    for before, after in template.follows.items():
        step = step | ((F.col("_before") == before) & ((F.col("at") == 1) == F.lit(before == "")) & F.col("role").isin(*after))
    valid = step & (~F.col("_last") | F.col("role").isin(*template.final))
    header = F.concat(F.lit(template.open), F.replace(escape(F.col("role"), template), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    parts = [(header, F.lit(False)), (escape(F.col("text"), template), F.col("role").isin(*template.loss_roles)), (F.lit(template.close), F.lit(False))]
    segments = F.array(*[F.struct(F.lit(i).alias("segment"), t.alias("text"), loss.alias("loss")) for i, (t, loss) in enumerate(parts)])
    return rows.select("conv_id", "at", "turn", "role", valid.alias("valid"), F.explode(segments).alias("s")).select("conv_id", "at", "turn", "role", "s.*", "valid")


def conversations_of(segments: DataFrame) -> DataFrame:
    """``conv_id, formatted, segments, valid``: each conversation's output string and its segments in order.

    The string of a conversation is one value, so a conversation must fit in a task.
    """
    grouped = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "segment", "text", "loss"))).alias("segments"), F.min("valid").alias("valid"))
    return grouped.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments", "valid")


def read_back(formatted: str, template: Template = Template()) -> list[tuple[str, str]]:
    """The ``(role, text)`` turns of a formatted conversation."""
    turn = re.compile(f"{re.escape(template.open)}((?:[^\\\\\n]|\\\\.)*)\n(.*?){re.escape(template.close)}", re.S)
    out, at = [], 0
    while at < len(formatted):
        m = turn.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digests(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation what its output reads back as.

    A conversation's segments come to one task in order and are read back turn by turn as a stream, so no task
    holds more than a batch of them, however long the conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None

        def row() -> pa.RecordBatch:
            key, turns, n, loss, loss_chars, chars, valid = own
            return pa.RecordBatch.from_pylist([{"conv_id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars, "valid": valid}], schema)

        turn = ""
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
            for key, segment, text, loss, valid in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "segment", "text", "loss", "valid"))):
                if own is None or own[0] != key:
                    if own is not None:
                        yield row()
                    own = [key, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, True]
                own[5] += len(text)
                own[6] = own[6] and valid
                if loss:
                    trained = unescape(text)
                    own[3].update(trained.encode())
                    own[4] += len(trained)
                turn = text if segment == 0 else turn + text
                if segment == 2:
                    for r, t in read_back(turn, template):
                        own[1].update(f"{r}\n{t}\n".encode())
                        own[2] += 1
        if own is not None:
            yield row()

    key = segments.schema["conv_id"].dataType.simpleString()
    rows = segments.select("conv_id", "at", "segment", "text", "loss", "valid").repartition("conv_id").sortWithinPartitions("conv_id", "at", "segment")
    return rows.mapInArrow(run, f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
