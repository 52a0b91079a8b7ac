"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: role: (opening, closing, trained on). Fixed values of the default template.
TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
#: For any other role; {} stands for its escaped name.
OTHER = ("<|role {}|>", "<|end|>", False)
#: Which role may follow which; None is the start, END marks roles that may close a conversation.
TURNS = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
END = {"assistant"}

SEGMENTS = "conv_id long, segment long, turn_no long, role string, text string, loss boolean, valid boolean"


class Codec:
    """Escapes control strings: a backslash after their first character, backslashes doubled."""

    def __init__(self, template=TEMPLATE, other=OTHER):
        self.template, self.other = template, other
        marks = {m.strip() for a, b, _ in template.values() for m in (a, b)} | {other[0].partition("{}")[0], other[1].strip(), other[0].partition("{}")[2]}
        marks.discard("")
        marks = sorted(marks, key=lambda m: (-len(m), m))
        self.controls = re.compile("|".join(map(re.escape, marks)))
        # every occurrence, overlapping ones too, is broken after its first character
        self._escape = re.compile("|".join([r"\\", *(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in marks)]))
        self._unescape = re.compile(r"\\\\|\\")

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(lambda m: "\\" if len(m[0]) == 2 else "", text)

    def opening(self, role: str) -> str:
        return self.template[role][0] if role in self.template else self.other[0].replace("{}", self.escape(role))

    def closing(self, role: str) -> str:
        return self.template[role][1] if role in self.template else self.other[1]

    def trained(self, role: str) -> bool:
        return (self.template.get(role) or self.other)[2]

    def role_of(self, opening: str) -> str | None:
        for role, (mark, _, _) in self.template.items():
            if opening == mark:
                return role
        head, _, tail = self.other[0].partition("{}")
        if opening.startswith(head) and opening.endswith(tail):
            return self.unescape(opening[len(head) : len(opening) - len(tail)])
        return None


def _rows(batches: Iterator[pa.RecordBatch], *names: str):
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, chars: int = 1 << 22):
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or weight >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_SEGMENT_SCHEMA = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("turn_no", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])


def format_conversations(rows: DataFrame, template=TEMPLATE, other=OTHER) -> DataFrame:
    """Text segments (opening, content, closing of each turn) with a loss flag each, and the machine's verdict.

    ``rows`` has conv_id, turn, role, text; other columns are ignored.  Turns
    are dealt by conversation, sorted, and streamed through the machine, so a
    conversation of any length needs one turn of memory; it is one task's work,
    as its order is, and so are all rows without an id together.  Repeated
    rows are turns of their own; a very long text is one segment.  Ties of a turn number
    go by role and text; null role or text counts as empty; null conv_id is a
    conversation of its own.  ``valid`` is false from the first turn on whose
    role the machine does not allow; such turns are formatted all the same.
    """

    small_batches(rows.sparkSession)

    def run(batches):
        codec = Codec(template, other)

        def segments():
            now, state, n, valid, number = object(), None, 0, True, 0
            for conv, role, text in _rows(batches, "conv_id", "role", "text"):
                if conv != now:
                    now, state, n, valid, number = conv, None, 0, True, 0
                role = role or ""
                valid = valid and role in TURNS.get(state, ())
                state = role
                for part, loss in ((codec.opening(role), False), (codec.escape(text or ""), codec.trained(role)), (codec.closing(role), False)):
                    yield conv, n, number, role, part, loss, valid
                    n += 1
                number += 1

        yield from _batches(segments(), _SEGMENT_SCHEMA)

    # a role name or text of one turn is the order among ties; the same rows give the same output
    dealt = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
_DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def read_back(segments: DataFrame, template=TEMPLATE, other=OTHER) -> DataFrame:
    """Digests of each conversation from its segments' text and loss flags alone, as a stream.

    ``valid``: every turn was allowed where it stood, and the last one may end
    a conversation.  Expects the order in which ``format_conversations`` gives
    the segments.  A conversation that ends within a turn is an error.
    """

    def run(batches):
        codec = Codec(template, other)

        def digests():
            now, acc = object(), None
            for conv, text, loss, valid in _rows(batches, "conv_id", "text", "loss", "valid"):
                if conv != now:
                    if acc:
                        yield finish(now, acc)
                    now, acc = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, "open", None]
                acc[4] += len(text)
                acc[5] = valid
                if acc[6] == "open":
                    role = codec.role_of(text)
                    if role is None:
                        raise ValueError(f"no opening mark in {text[:80]!r}")
                    acc[1].update(f"{role}\n".encode())
                    acc[6], acc[7] = "text", role
                elif acc[6] == "text":
                    if codec.controls.search(text):
                        raise ValueError(f"a control string in {text[:80]!r}")
                    plain = codec.unescape(text)
                    acc[1].update(f"{plain}\n".encode())
                    if loss:
                        acc[2] += len(plain)
                        acc[3].update(plain.encode())
                    acc[6] = "close"
                else:
                    if text != codec.closing(acc[7]):
                        raise ValueError(f"no closing mark in {text[:80]!r}")
                    acc[0] += 1
                    acc[6] = "open"
            if acc:
                yield finish(now, acc)

        def finish(conv, acc):
            if acc[6] != "open":
                raise ValueError(f"conversation {conv} ends within a turn")
            return conv, acc[0], acc[1].hexdigest(), acc[2], acc[3].hexdigest(), acc[4], acc[5] and acc[7] in END

        yield from _batches(digests(), _DIGEST_SCHEMA)

    return segments.mapInArrow(run, DIGEST)


def query(spark, sf_dir):
    sample = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(sample).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_conversations(rows))
