"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.llm.common import pick

#: The template's control strings. In texts and roles "<|" and the escape sign itself are escaped, so neither occurs there.
START, END, ESCAPE = "<|im_start|>", "<|im_end|>", "\\"
TARGET = "assistant"
#: Characters of output handed on at once.
BATCH = 4 << 20


def escape(text: str) -> str:
    return text.replace(ESCAPE, ESCAPE * 2).replace("<|", f"<{ESCAPE}|")


def escape_role(role: str) -> str:
    """A role stands on one line."""
    return escape(role).replace("\n", f"{ESCAPE}n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted example."""
    for turn in formatted.split(f"{END}\n")[:-1]:
        role, _, text = turn.removeprefix(START).partition("\n")
        yield unescape_role(role), unescape(text)


def expand(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row an example: conv_id, example (from 0 in a conversation), formatted, loss_start, loss_end (code points).

    Turns go by turn number (null first), role, text. An example is every turn up to an assistant turn, of which the loss
    mask [loss_start, loss_end) has the reply's text alone. What follows a conversation's last assistant turn makes one
    more example with an empty mask, so that no turn is lost. A null role or text is empty; rows of null conv_id are one
    conversation; repeated rows are turns of their own; other columns are left out.

    Conversations are dealt by id and stream in order through a task, which holds one conversation's formatted text, as
    long as the longest example. The expansion repeats each prefix, as the method has it: its size grows with the square
    of a conversation's turns, not with the number of conversations.
    """
    source = pick(df, conv_id, turn, role, text).toDF("conv_id", "turn", "role", "text")
    source = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    source = source.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([source.schema["conv_id"], T.StructField("example", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def hand_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

        now, parts, length, examples, open_ = object(), [], 0, 0, False

        def rest() -> None:
            if open_:
                out.append((now, examples, "".join(parts), length, length))

        for batch in batches:
            for conv, who, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    rest()
                    now, parts, length, examples, open_ = conv, [], 0, 0, False
                head, body = f"{START}{escape_role(who)}\n", escape(said)
                parts.append(f"{head}{body}{END}\n")
                begin = length + len(head)
                length += len(parts[-1])
                open_ = who != TARGET
                if not open_:
                    parts = ["".join(parts)]
                    out.append((now, examples, parts[0], begin, begin + len(body)))
                    examples += 1
                    size += length
                if size > BATCH:
                    yield hand_on()
                    out, size = [], 0
        rest()
        if out:
            yield hand_on()

    return source.mapInArrow(run, schema)


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say, from their formatted text and masks alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and loss_sha256 (all text under
    the masks, unescaped, in order), formatted_chars. examples: as from expand(), a conversation's rows together.
    """
    schema = T.StructType([examples.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, loss, chars, size = object(), None, hashlib.sha256(), 0, 0

        def row() -> pa.RecordBatch:
            turns, n = hashlib.sha256(), 0
            for who, said in turns_of(last):
                turns.update(f"{who}\n{said}\n".encode())
                n += 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((now, n, turns.hexdigest(), chars, loss.hexdigest(), size), arrow, strict=True)], schema=arrow)

        done: list[pa.RecordBatch] = []
        for batch in batches:
            for conv, formatted, begin, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if conv != now:
                    if last is not None:
                        done.append(row())
                    now, loss, chars, size = conv, hashlib.sha256(), 0, 0
                text = unescape(formatted[begin:end])
                loss.update(text.encode())
                chars, size, last = chars + len(text), size + len(formatted), formatted
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if last is not None:
            yield row()

    return examples.mapInArrow(run, schema)
