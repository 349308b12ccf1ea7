"""Harmonic packing: pieces in reciprocal-capacity classes, a fixed count of pieces filling each bin of a class."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from riskgraph.llm import kernels as K
from riskgraph.llm.common import cut, frugal, pick, shuffle_width
from riskgraph.llm.pieces import pieces_of

#: Share of a slot that a piece may leave empty rather than be cut once more.
SLACK = 0.02


def class_counts(capacity: int) -> list[int]:
    """Pieces a bin: 1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, ... capacity."""
    counts = [1]
    step = [2, 3, 4, 5, 6]
    while counts[-1] < capacity:
        counts += [k for k in step if counts[-1] < k < capacity]
        step = [2 * k for k in step]
        if step[0] >= capacity:
            counts.append(capacity)
    return counts


def cut_plan(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (row, start, length, class index) of rows of so many tokens; a row's pieces follow one another.

    Whole bins come off first. Of the rest, the largest slot capacity // k that it fills comes off again and again, until
    what is left fits a slot with no more than SLACK of it empty.
    """
    counts = class_counts(capacity)
    slots = np.array([capacity // k for k in counts])
    rising = slots[::-1]
    rows, starts, sizes, classes = [], [], [], []
    full = lengths // capacity
    row = np.repeat(np.arange(len(lengths)), full)
    first = np.repeat(np.cumsum(full) - full, full)
    rows.append(row)
    starts.append((np.arange(len(row)) - first) * capacity)
    sizes.append(np.full(len(row), capacity))
    classes.append(np.zeros(len(row), np.int64))
    row, at, rest = np.arange(len(lengths)), full * capacity, lengths % capacity
    while True:
        row, at, rest = (x[rest > 0] for x in (row, at, rest))
        if not len(row):
            break
        up = len(slots) - 1 - np.searchsorted(rising, rest, "left")  # the smallest slot that takes it whole
        whole = slots[up] - rest <= SLACK * slots[up]
        down = len(slots) - np.searchsorted(rising, rest, "right")  # the largest slot that it fills
        kind = np.where(whole, up, down)
        took = np.where(whole, rest, slots[kind])
        rows.append(row)
        starts.append(at)
        sizes.append(took)
        classes.append(kind)
        at, rest = at + took, rest - took
    return tuple(np.concatenate(x).astype(np.int64) for x in (rows, starts, sizes, classes))


def token_ids(data: np.ndarray, offsets: np.ndarray, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of the piece, end_id after each row, and each row's bounds among them."""
    memo = pieces_of(path, True)
    starts, ends, bounds = K.words(data, offsets)
    distinct, which = memo.look_up(data, starts, ends)
    first = np.cumsum(memo.counts) - memo.counts
    n = np.append(memo.counts, 1)
    at = np.append(first, len(memo.ids))
    codes = np.insert(distinct[which], bounds[1:], len(n) - 1)
    size = n[codes]
    to = np.cumsum(size)
    ids = np.append(memo.ids, np.uint32(end_id))[np.repeat(at[codes] - (to - size), size) + np.arange(to[-1] if len(to) else 0)]
    rows = np.concatenate([[0], to[bounds[1:] + np.arange(len(offsets) - 1)]])
    if len(apart := memo.apart(data, offsets)):
        each = [ids[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
        for i, found in zip(apart, memo.encode([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in apart]), strict=True):
            each[i] = np.array([*found, end_id], np.uint32)
        ids, rows = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
    return ids, rows


#: No sequence yet; those made later count down from the next lower number.
OPEN = 0
#: Tasks, or groups of them, whose left pieces meet at once.
FAN_IN = 64
#: The level of the bins made last.
LAST = 15


def pack(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs all rows of df into sequences of at most capacity tokens: one row a piece.

    Returns doc_id, start (the row's ids before the piece), length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id and offset (in its sequence, gapless from 0). Ids are the library's for the file at path
    without added special tokens, then end_id. A null or empty text has end_id alone; repeated rows and rows of one or of no
    doc_id are packed as rows of their own; other columns are left out.

    Every task fills bins of each class by itself and in order, k pieces of up to capacity // k tokens to a bin of class k.
    Under k pieces of a class are left in each task; these meet once more by class, and the fewer than k of a class that
    then remain, a number that capacity alone bounds, go together first-fit. Only that last step is a single task.
    """
    source = pick(df, doc_id, text).toDF("doc_id", "text")
    counts = class_counts(capacity)
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "kind", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        waiting: list[list[tuple]] = [[] for _ in counts]
        for batch in batches:
            for i, _, data, offsets in K.pieces(batch.column(1)):
                ids, bounds = token_ids(data, offsets, path, end_id)
                n = np.diff(bounds)
                row, start, size, kind = cut_plan(n, capacity)
                begin = bounds[row] + start
                # waiting pieces come before the new ones of their class
                old = [x for pieces in waiting for x in pieces]
                raw = [x[5] for x in old]
                whole = np.ascontiguousarray(ids).tobytes()
                raw += [whole[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
                keys = [x[0] for x in old] + batch.column(0).take(pa.array(row + i)).to_pylist()
                start, size, kind, total = (np.concatenate([np.array([x[k] for x in old], np.int64), new]) for k, new in ((1, start), (2, size), (3, kind), (4, n[row])))
                order = np.argsort(kind, kind="stable")
                sorted_kind, sorted_size = kind[order], size[order]
                by_class = np.bincount(kind, minlength=len(counts))
                place = np.arange(len(order)) - (np.cumsum(by_class) - by_class)[sorted_kind]
                k = np.array(counts)[sorted_kind]
                closed = place // k < (by_class // np.array(counts))[sorted_kind]
                head = place % k == 0
                bin_no = np.cumsum(head) - 1
                sums = np.cumsum(sorted_size) - sorted_size
                offset = sums - sums[head][bin_no]
                waiting = [[] for _ in counts]
                for j in order[~closed].tolist():
                    waiting[kind[j]].append((keys[j], start[j], size[j], kind[j], total[j], raw[j]))
                done = order[closed]
                if len(done):
                    number = np.unique(bin_no[closed], return_inverse=True)[1]
                    seq = (np.int64(task) << 34) + made + number + 1
                    made += int(number[-1]) + 1
                    yield rows_of([keys[j] for j in done], start[done], size[done], total[done], kind[done], seq, offset[closed], [raw[j] for j in done])
        old = [x for pieces in waiting for x in pieces]
        if old:
            start, size, kind, total = (np.array([x[k] for x in old], np.int64) for k in (1, 2, 3, 4))
            yield rows_of([x[0] for x in old], start, size, total, kind, np.full(len(old), OPEN), np.full(len(old), OPEN), [x[5] for x in old])

    def rows_of(keys, start, size, total, kind, seq, offset, raw) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array(x) for x in (start, size, total, kind, seq, offset)), pa.array(raw, pa.binary())], names=schema.names)

    key_type = to_arrow_type(source.schema["doc_id"].dataType)
    filled = cut(source.mapInArrow(frugal(fill), schema))
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    placed = [filled.where(F.col("sequence_id") != OPEN)]
    left = filled.where(F.col("sequence_id") == OPEN)
    # Under k pieces a class and task are left. They meet in groups of at most FAN_IN tasks, then groups of groups.
    per_bin = F.array(*(F.lit(k).cast("long") for k in counts))[F.col("kind").cast("int")]
    groups, level = shuffle_width(source), 0
    while level == 0 or groups > 1:
        groups = -(-groups // FAN_IN)
        left = left.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", F.crc32("ids")), F.lit(groups)))
        order = Window.partitionBy("group", "kind").orderBy(F.col("length").desc(), "doc_id", "start", F.crc32("ids"))
        left = left.withColumn("place", (F.row_number().over(order) - 1).cast("long")).withColumn("k", per_bin)
        left = left.withColumn("bin", F.expr("place div k")).withColumn("n", F.count("*").over(Window.partitionBy("group", "kind", "bin")))
        left = cut(left)
        inside = Window.partitionBy("group", "kind", "bin").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        number = F.lit(level << 58) + F.shiftleft("group", 36) + F.shiftleft("kind", 30) + F.col("bin")
        done = left.where("n = k").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
        placed.append(done.withColumn("sequence_id", -1 - number))
        left = left.where("n < k").select(*schema.names)
        level += 1

    def first_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(list(batches), last_schema).combine_chunks()
        room: list[int] = []
        bins, offsets = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        sizes = batch["length"].to_numpy()
        for j in np.argsort(-sizes, kind="stable").tolist():
            b = next((b for b, r in enumerate(room) if r >= sizes[j]), len(room))
            if b == len(room):
                room.append(capacity)
            bins[j], offsets[j] = b, capacity - room[b]
            room[b] -= int(sizes[j])
        batch = batch.set_column(batch.column_names.index("sequence_id"), "sequence_id", pa.array(-1 - (np.int64(LAST << 58) + bins)))
        batch = batch.set_column(batch.column_names.index("offset"), "offset", pa.array(offsets))
        yield from batch.to_batches()

    last_schema = to_arrow_schema(schema)
    placed.append(left.orderBy("kind", F.col("length").desc(), "doc_id", "start").coalesce(1).mapInArrow(frugal(first_fit), schema))
    return reduce(DataFrame.union, (x.select(*names) for x in placed))
