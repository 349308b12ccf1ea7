"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.llm import kernels as K
from riskgraph.llm.common import cut, frugal, pick

UNKNOWN = "und"
#: Lengths of the n-grams, in code points of the lower-cased text.
LENGTHS = (1, 2, 3)
#: Tasks that count the sample.
FIT_TASKS = 16
#: Bytes of text scored at once.
PIECE = 1 << 19
#: Languages of a block: a broadcast matrix has so many columns at most, 32 MB, however many languages there are.
BLOCK = 64


@dataclass(frozen=True)
class Block:
    """Log probabilities of some languages: matrix[bucket, language], prior[language]; buckets is a power of two."""

    languages: list[str]
    matrix: np.ndarray
    prior: np.ndarray


@dataclass(frozen=True)
class Model:
    """All languages, by name, in blocks."""

    blocks: list[Block]

    @property
    def languages(self) -> list[str]:
        return [x for block in self.blocks for x in block.languages]


def ngrams(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the bucket of every n-gram of every text, and the n-grams' bounds by text."""
    encoded = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    points = np.frombuffer(b"".join(encoded), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(e) // 4 for e in encoded])
    sizes = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(len(texts)), sizes)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    grams = np.zeros(len(points), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        grams = grams[: max(0, len(points) - n + 1)] * np.uint64(0x110001) + points[n - 1 :] + np.uint64(1)
        inside = row[: len(grams)] == row[n - 1 :]
        if n in LENGTHS:
            yield (K.mix(grams[inside] + np.uint64(n << 58)) >> shift).astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(sizes - n + 1, 0))])


def text_pieces(column: pa.Array) -> Iterator[list[str | None]]:
    for i, j, _, _ in K.pieces(column, PIECE):
        yield column.slice(i, j - i).to_pylist()


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether nothing may be learned from the row: crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, sample: int = 20_000, buckets: int = 1 << 16, alpha: float = 0.05) -> Model:
    """Learns from the rows of labelled (doc_id, text, lang) with neither text nor lang null.

    sample: about so many rows are learned from, those whose ids hash lowest; all, if there are no more. Counts are
    summed by Spark; the driver gets a number for each language and bucket that occur, a block of languages at a time, and for
    each language its rows. The number of buckets is the same for any number of languages.
    """
    usable = labelled.where("lang is not null and text is not null")
    rows = usable.select("lang").count()
    if rows > sample:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * sample / rows)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            languages, at = batch.column(1).to_pylist(), 0
            for piece in text_pieces(batch.column(0)):
                mine, at = languages[at : at + len(piece)], at + len(piece)
                for language in set(mine):
                    some = [t for t, x in zip(piece, mine, strict=True) if x == language]
                    total = seen.setdefault(language, np.zeros(buckets, np.int64))
                    texts[language] = texts.get(language, 0) + len(some)
                    for bucket, _ in ngrams(some, buckets):
                        total += np.bincount(bucket, minlength=buckets)
        for language, total in seen.items():
            bucket = np.append(np.flatnonzero(total), -1)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(bucket)), pa.array(bucket), pa.array(np.append(total[bucket[:-1]], texts[language]))], names=["lang", "bucket", "n"])

    # the sample is bounded, so a fixed number of tasks counts it, and what they hand on is bounded too
    counts = usable.select("text", "lang").repartition(FIT_TASKS).mapInArrow(frugal(count), "lang string, bucket long, n long")
    counts = cut(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    texts = dict(sorted((r.lang, r.n) for r in counts.where("bucket < 0").collect()))
    languages, total, blocks = list(texts), max(1, sum(texts.values())), []
    for first in range(0, len(languages), BLOCK):
        mine = languages[first : first + BLOCK]
        grams = counts.where((F.col("bucket") >= 0) & F.col("lang").between(mine[0], mine[-1])).toPandas()
        table = np.zeros((buckets, len(mine)))
        table[grams["bucket"].to_numpy(np.int64), grams["lang"].map({x: i for i, x in enumerate(mine)}).to_numpy(np.int64)] = grams["n"].to_numpy()
        table += alpha
        blocks.append(Block(mine, np.log(table / table.sum(0)), np.log(np.array([texts[x] for x in mine]) / total)))
    return Model(blocks)


def score(texts: list[str | None], block: Block) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The likeliest language of the block for each text, its log score, and the sum of all the block's scores in units of it."""
    total = np.tile(block.prior, (len(texts), 1))
    for bucket, bounds in ngrams([t or "" for t in texts], len(block.matrix)):
        filled = np.flatnonzero(np.diff(bounds))
        if len(filled):
            total[filled] += np.add.reduceat(block.matrix[bucket], bounds[filled])
    best, top = total.argmax(1), total.max(1)
    return [block.languages[b] for b in best.tolist()], top, np.exp(total - top[:, None]).sum(1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, lang_pred and score (0 to 1) for every row of df, read from its whole text alone.

    A null text, one with no letter, and every text where no language was learned: `und` and 0. Of languages as likely
    the first by name wins. Repeated rows stay; other columns are left out. The step is narrow; with languages of several
    blocks there is one such step a block, which carries the best so far along.
    """
    spark = df.sparkSession
    columns = keep if text in keep else (*keep, text)
    at = columns.index(text)
    out = pick(df, *columns).toDF(*(f"k{i}" for i in range(len(columns))))
    empty = T.StructType([*out.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("top", T.DoubleType()), T.StructField("rest", T.DoubleType())])

    def step(block: Broadcast[Block], first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, tops, rests = [], [], []
                for piece in text_pieces(batch.column(at)):
                    name, top, rest = score(piece, block.value)
                    names += [x if has_letter(t) else UNKNOWN for x, t in zip(name, piece, strict=True)]
                    tops.append(top)
                    rests.append(rest)
                top, rest = (np.concatenate([*x, np.zeros(0)]) for x in (tops, rests))
                if not first:
                    before, top_before, rest_before = batch.column(len(columns)).to_pylist(), *(batch.column(len(columns) + k).to_numpy() for k in (1, 2))
                    stays = top_before >= top
                    names = [x if y else z for x, y, z in zip(before, stays.tolist(), names, strict=True)]
                    most = np.maximum(top, top_before)
                    top, rest = most, rest * np.exp(top - most) + rest_before * np.exp(top_before - most)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(names, pa.string()), pa.array(top), pa.array(rest)], names=empty.names)

        return run

    for i, block in enumerate(model.blocks):
        out = out.mapInArrow(frugal(step(spark.sparkContext.broadcast(block), not i)), empty)
        if i + 1 < len(model.blocks):
            out = cut(out)
    if not model.blocks:
        out = out.withColumns({"lang_pred": F.lit(UNKNOWN), "rest": F.lit(1.0)})
    odds = F.when(F.col("lang_pred") == UNKNOWN, F.lit(0.0)).otherwise(1 / F.col("rest"))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", odds.alias("score"))


def learn(df: DataFrame, **options) -> Model:
    """fit() on the rows of df (doc_id, text, lang) that aren't held out."""
    rows = pick(df, "doc_id", "text", "lang")
    return fit(rows.where(~held_out() & F.col("doc_id").isNotNull()), **options)
