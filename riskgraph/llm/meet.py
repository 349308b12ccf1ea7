"""Families of like members that meet in tasks of bounded size, and the small filters that say who is wanted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import cut

#: Bits a member of the filters that are broadcast, and the most there are, 16 MB. A filter that
#: is too full lets more through than it holds, never less; what reads them asks again afterwards, or may have more.
FILTER_BITS, MOST_FILTER_BITS = 12, 1 << 27
#: Members and bytes of a block of a large family; a meeting holds two blocks. Rows of small meetings that share a task.
BLOCK, BLOCK_BYTES, TASK_ROWS = 4096, 8 << 20, 8192


def filter_of(members: DataFrame) -> np.ndarray:
    """A Bloom filter of the column member, two bits each, made by Spark; the driver gets its words alone."""
    bits, n = 1 << 16, members.count()
    while bits < MOST_FILTER_BITS and bits < FILTER_BITS * n:
        bits *= 2
    marks = members.select(F.explode(F.array(F.col("member").bitwiseAND(bits - 1), F.shiftrightunsigned("member", 32).bitwiseAND(bits - 1))).alias("bit"))
    marks = marks.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")).toPandas()
    words = np.zeros(bits // 64, np.int64)
    words[marks["word"].to_numpy(np.int64)] = marks["mask"].to_numpy(np.int64)
    return words.view(np.uint64)


def in_filter(words: np.ndarray, members: np.ndarray) -> np.ndarray:
    mask, out = np.uint64(64 * len(words) - 1), np.ones(len(members), bool)
    for bit in (members & mask, (members >> np.uint64(32)) & mask):
        out &= (words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return out


def key_array(keys: np.ndarray) -> pa.Array:
    """Rows of two 64-bit words as an Arrow column of 16 bytes each."""
    data = np.ascontiguousarray(keys)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(0, 16 * len(data) + 1, 16, np.int32)), pa.py_buffer(data)])


def key_words(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of two 64-bit words, of a column of 16 bytes each or of whole numbers."""
    if pa.types.is_integer(column.type):
        return np.repeat(column.to_numpy().view(np.uint64)[:, None], 2, 1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def met(rows: DataFrame, size: Column) -> DataFrame:
    """Members of families dealt into meetings, of which each family has one, or if it is large one for every two of its blocks.

    rows: family, node and others; size: the column that says how many bytes a member takes. A meeting holds two blocks of
    BLOCK members and BLOCK_BYTES at most, about. Adds block, i and j, and task, which bundles small meetings.
    """
    load = rows.groupBy("family").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    load = cut(load.where("n > 1").select("family", "n", "bytes", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")))
    total = load.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, -(-total[0] // TASK_ROWS), -(-total[1] // BLOCK_BYTES))
    # of the families only the large ones go back to their members: no more than there are blocks of members
    dealt = rows.join(load.where("blocks > 1").select("family", "blocks"), "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    dealt = dealt.withColumn("meeting", F.explode(others)).select("*", "meeting.i", "meeting.j").drop("meeting", "blocks")
    return dealt.withColumn("task", F.pmod(F.xxhash64("family", "i", "j"), F.lit(tasks)))


def meetings(table: pa.Table, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The rows of each meeting in a task's table, by size, and their blocks if only members of two blocks are to meet."""
    family, (i, j, block) = key_words(table["family"]), (table[c].to_numpy() for c in ("i", "j", "block"))
    order = np.lexsort((sizes, j, i, family[:, 1], family[:, 0]))
    new = np.zeros(len(order), bool)
    for c in (i, j, family[:, 0], family[:, 1]):
        new[1:] |= c[order][1:] != c[order][:-1]
    for rows in np.split(order, np.flatnonzero(new)):
        if len(rows) > 1:
            yield rows, block[rows] if i[rows[0]] != j[rows[0]] else None
