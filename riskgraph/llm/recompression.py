"""Substring dedup by recompression: windows of words that start more than once lose every word they cover.

Rounds name runs of one symbol and pairs of symbols. A name is the fingerprint of what it stands for, so it is the same
in every task without a dictionary that all tasks would have to meet over; a round is then a narrow step. Which symbols
merge depends on the symbols alone, so inside equal substrings the same symbols arise. Every symbol carries the words
that its making depended on; a symbol whose dependence lies inside a window arises wherever that window stands.
So if such a symbol occurs once in the corpus, no window around its dependence repeats. What windows are left, those of
shared symbols only or with no symbol to tell by, are compared by 128-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.llm import kernels as K
from riskgraph.llm.common import pick, shuffle_width

#: Rounds of naming; each shortens a text to about three quarters.
ROUNDS = 6
#: Of these, the first ones name runs too; a run of higher symbols just stays a row of them, as naming it would make
#: every symbol depend on both its neighbours once more.
RUN_ROUNDS = 1
#: Words that a pair may stand for.
LONGEST = 12
#: Far outside any text.
NEVER = np.int64(1) << 40
#: Rows of symbols or windows that a task holds before it hands them on.
HELD = 2_000_000


def compress(names: np.ndarray, rows: np.ndarray, rounds: int, longest: int) -> tuple[np.ndarray, ...]:
    """Names, first and last + 1 word of what each symbol depends on, and text of each symbol after the rounds.

    names, rows: fingerprint and text of each word. A dependence that reaches over a bound of its text becomes one that no
    window can hold, as the same words may stand between others elsewhere.
    """
    low, row = np.arange(len(names)), rows
    high, size = low + 1, np.ones(len(names), np.int64)

    def neighbours() -> tuple[np.ndarray, ...]:
        """Link to the next, and the dependence of the symbol before and after each."""
        link = row[1:] == row[:-1]
        before, after = np.append(False, link), np.append(link, False)
        return (
            link,
            np.where(before, np.append(low[:1], low[:-1]), low - NEVER),
            np.where(before, np.append(high[:1], high[:-1]), high),
            np.where(after, np.append(low[1:], low[-1:]), low),
            np.where(after, np.append(high[1:], high[-1:]), high + NEVER),
        )

    for level in range(rounds):
        if not len(names):
            break
        if level < RUN_ROUNDS:
            # a run ends where its neighbours differ, so it depends on both of them; so does a run of one
            link, low_before, high_before, low_after, high_after = neighbours()
            head = np.flatnonzero(np.append(True, ~(link & (names[1:] == names[:-1]))))
            tail = np.append(head[1:], len(names)) - 1
            count = (tail - head + 1).astype(np.uint64)
            low = np.minimum.reduce([low[head], low_before[head], low_after[tail]])
            high = np.maximum.reduce([high[tail], high_before[head], high_after[tail]])
            size, row = np.add.reduceat(size, head), row[head]
            names = np.where(count > 1, K.mix(names[head] + K.mix(count * np.uint64(K.BASE))), names[head])
        # a left symbol merges with the right symbol after it; sides and lengths follow from the names
        link, low_before, high_before, low_after, high_after = neighbours()
        left = (names >> np.uint64(level)) & np.uint64(1) == 0
        merge = link & left[:-1] & ~left[1:] & (size[:-1] + size[1:] <= longest)
        first, second = np.append(merge, False), np.append(False, merge)
        next_counts = left & (size < longest)
        low = np.where(next_counts, np.minimum(low, low_after), np.where(~left & (size < longest), np.minimum(low, low_before), low))
        high = np.where(next_counts, np.maximum(high, high_after), np.where(~left & (size < longest), np.maximum(high, high_before), high))
        at = np.flatnonzero(first)
        low[at], high[at] = np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1])
        size[at] += size[at + 1]
        names = names.copy()
        names[at] = K.mix(names[at] * np.uint64(3) + K.mix(names[at + 1] + np.uint64(level + 1)))
        names, low, high, size, row = (x[~second] for x in (names, low, high, size, row))
    return names, low, high, row


def signs(data: np.ndarray, offsets: np.ndarray, window: int, rounds: int, longest: int):
    """Words' fingerprints, each row's bounds among them, and the symbols that some window can tell by: name, first and
    last + 1 word of the dependence, row."""
    starts, ends, bounds = K.words(data, offsets)
    prints = K.span_prints(data, starts, ends)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    name, low, high, row = compress(prints, rows, rounds, longest)
    fit = (high - low <= window) & (low >= 0)
    return (starts, ends, prints, bounds), (name[fit], low[fit], high[fit], row[fit])


class Bundles:
    """What a task says of the marks it saw (symbols, or windows): who holds which, by reducer's part as packed blobs.

    A mark that the task itself saw twice needs no reducer to be known as repeated: its holders pass through, spread by
    key, and one witness of it goes to the others. So a mark that is everywhere makes one row a task, not one a holder.
    """

    BLOBS = ("mark", "check", "key", "value", "seen", "seen_check", "own_key", "own_value")
    SCHEMA = T.StructType([T.StructField("part", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in BLOBS)])

    def __init__(self, parts: int) -> None:
        self.parts, self.held, self.size = parts, [], 0

    def add(self, mark: np.ndarray, check: np.ndarray, key: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((mark, check, key, value))
        self.size += len(mark)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        mark, check, key, value = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.lexsort((check, mark))
        mark, check, key, value = mark[order], check[order], key[order], value[order]
        twice, new = repeated(mark, check)
        out: list[dict[str, bytes]] = [{} for _ in range(self.parts)]
        for chosen, by, columns in (
            (~twice, mark, {"mark": mark, "check": check, "key": key, "value": value}),
            (twice & new, mark, {"seen": mark, "seen_check": check}),
            (twice, key, {"own_key": key, "own_value": value}),
        ):
            at = np.flatnonzero(chosen)
            part = (by[at] % np.uint64(self.parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(self.parts + 1))
            for name, column in columns.items():
                column = column[at[order]]
                for p in np.flatnonzero(np.diff(bounds)).tolist():
                    mine = column[bounds[p] : bounds[p + 1]]
                    out[p][name] = K.pack_sorted(mine) if name in ("mark", "seen") else K.pack(mine)
        some = [p for p in range(self.parts) if out[p]]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([out[p].get(n) for p in some], pa.binary()) for n in self.BLOBS)], names=["part", *self.BLOBS])


REPLY = T.StructType([T.StructField("key", T.LongType()), T.StructField("found", T.BinaryType())])


def repeated(mark: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted marks: which have an equal neighbour, and which differ from the one before."""
    equal = (mark[1:] == mark[:-1]) & (check[1:] == check[:-1])
    twice = np.zeros(len(mark), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    return twice, np.append(True, ~equal)[: len(mark)]


TOLD = T.StructType([T.StructField("to", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("values", T.BinaryType())])


def replies(frame: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Keys and values of this part's repeated marks, bundled by the part of their key."""

    def read(name: str, kind: type) -> np.ndarray:
        blobs = [K.unpack_sorted(b) if name in ("mark", "seen") else K.unpack(b, kind) for b in frame[name] if b is not None]
        return np.concatenate([*blobs, np.zeros(0, kind)]).astype(kind)

    seen, seen_check = read("seen", np.uint64), read("seen_check", np.uint32)
    key, value = read("key", np.uint64), read("value", np.uint64)
    n = len(key)
    # a witness counts as two that have no holder here
    mark = np.concatenate([read("mark", np.uint64), seen, seen])
    check = np.concatenate([read("check", np.uint32), seen_check, seen_check])
    order = np.lexsort((check, mark))
    told = order[repeated(mark[order], check[order])[0]]
    told = told[told < n]
    key, value = np.concatenate([key[told], read("own_key", np.uint64)]), np.concatenate([value[told], read("own_value", np.uint64)])
    to = (key % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((key, to))
    bounds = np.searchsorted(to[order], np.arange(parts + 1))
    key, value = key[order], value[order]
    some = np.flatnonzero(np.diff(bounds)).tolist()
    each = [(K.pack_sorted(key[bounds[p] : bounds[p + 1]]), K.pack(value[bounds[p] : bounds[p + 1]])) for p in some]
    return pd.DataFrame({"to": some, "keys": [k for k, _ in each], "values": [v for _, v in each]})


def gather(frame: pd.DataFrame) -> pd.DataFrame:
    """One row a document of this part: its key and its distinct values. A document has no more of them than words."""
    key = np.concatenate([K.unpack_sorted(b) for b in frame["keys"]])
    value = np.concatenate([K.unpack(b, np.uint64) for b in frame["values"]])
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    new = np.append(True, (key[1:] != key[:-1]) | (value[1:] != value[:-1]))
    key, value = key[new], value[new]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return pd.DataFrame({"key": K.signed(key[head]), "found": [x.tobytes() for x in np.split(value, head[1:])]})


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, rounds: int = ROUNDS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for every row of df.

    Words are runs of other characters than \\x20 and \\x09-\\x0D. A word goes if a window of so many consecutive words of its
    text covers it and the same words start anywhere else, in this text or another; windows are judged on the input.
    Texts with fewer words and null texts (no words) lose nothing. Repeated rows are texts of their own, so they repeat
    each other; rows of null doc_id are rows like others; other columns are left out. An empty table gives none.
    """
    source = pick(df, doc_id, text).toDF("doc_id", "text")
    parts = shuffle_width(source)
    keyed = source.withColumn("key", F.xxhash64("doc_id", "text"))

    def find_signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Bundles(parts)
        for batch in batches:
            for i, j, data, offsets in K.pieces(batch.column(1)):
                keys = batch.column(0).slice(i, j - i).to_numpy().view(np.uint64)
                _, (name, _, _, row) = signs(data, offsets, window, rounds, longest)
                yield from out.add(name, np.zeros(len(name), np.uint32), keys[row], name)
        yield from out.flush()

    def answered(bundles: DataFrame) -> DataFrame:
        """Every row with the values of its marks that are repeated. Both times the same exchange of the texts serves."""
        told = bundles.groupBy("part").applyInPandas(lambda frame: replies(frame, parts), TOLD)
        return keyed.join(told.groupBy("to").applyInPandas(gather, REPLY), "key", "left").select("doc_id", "text", "key", "found")

    def found_in(column: pa.Array, i: int) -> np.ndarray:
        return np.frombuffer(column[i].as_py() or b"", np.uint64)

    shared = keyed.select("key", "text").mapInArrow(find_signs, Bundles.SCHEMA)

    def find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Bundles(parts)
        for batch in batches:
            for i, j, data, offsets in K.pieces(batch.column(1)):
                keys = batch.column(2).slice(i, j - i).to_numpy().view(np.uint64)
                (_, _, prints, bounds), (name, low, high, row) = signs(data, offsets, window, rounds, longest)
                if len(prints) < window:
                    continue
                # symbols that occur once rule out the windows around their dependence
                known = np.zeros(len(name), bool)
                edges = np.searchsorted(row, np.arange(len(offsets)))
                for d in np.flatnonzero(np.diff(edges)).tolist():
                    got = found_in(batch.column(3), i + d)
                    if len(got):
                        known[edges[d] : edges[d + 1]] = np.isin(name[edges[d] : edges[d + 1]], got)
                ruled = np.bincount(np.maximum(high[~known] - window, 0), minlength=len(prints) + 1)
                ruled -= np.bincount(low[~known] + 1, minlength=len(prints) + 1)
                open_ = np.cumsum(ruled)[:-1] == 0
                open_[len(prints) - window + 1 :] = False
                for e in bounds[1:-1].tolist():
                    open_[max(0, e - window + 1) : e] = False
                at = np.flatnonzero(open_)
                if len(at):
                    one = K.run_prints(K.prefix_sums(prints), at, at + window)
                    two = K.run_prints(K.prefix_sums(K.mix(prints ^ np.uint64(0xA5A5))), at, at + window)
                    which = np.searchsorted(bounds, at, "right") - 1
                    yield from out.add(one, (two >> np.uint64(32)).astype(np.uint32), keys[which], (at - bounds[which]).astype(np.uint64))
        yield from out.flush()

    windows = answered(shared).mapInArrow(find_windows, Bundles.SCHEMA)
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for i, j, data, offsets in K.pieces(batch.column(1)):
                starts, ends, bounds = K.words(data, offsets)
                raw = data.tobytes()
                for d in range(j - i):
                    a, b = bounds[d], bounds[d + 1]
                    got = found_in(batch.column(3), i + d).astype(np.int64)
                    stay = np.ones(b - a, bool)
                    if len(got):
                        cover = np.bincount(got, minlength=b - a + 1) - np.bincount(got + window, minlength=b - a + 1)
                        stay = np.cumsum(cover)[:-1] == 0
                    n_words.append(int(b - a))
                    n_removed.append(int(b - a - stay.sum()))
                    if stay.all():
                        kept.append(b" ".join(raw[offsets[d] : offsets[d + 1]].split()).decode())
                    else:
                        kept.append(b" ".join([raw[x:y] for x, y in zip(starts[a:b][stay].tolist(), ends[a:b][stay].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    return answered(windows).mapInArrow(remove, schema)
