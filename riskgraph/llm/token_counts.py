"""Token counts: pieces counted once per distinct pre-token, joined to each document's pre-token frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.llm import kernels as K
from riskgraph.llm.common import pick
from riskgraph.llm.pieces import pieces_of, pre_tokens


def text_token_counts(data: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each row of the piece; no id is kept."""
    memo, rows = pieces_of(path, False), len(offsets) - 1
    starts, ends, row = pre_tokens(data, offsets)
    codes, which = memo.look_up(data, starts, ends)
    # (row, distinct pre-token) with its frequency, joined to the pieces of the pre-token
    pairs, frequency = np.unique(row * max(1, len(codes)) + which, return_counts=True)
    of, token = np.divmod(pairs, max(1, len(codes)))
    out = np.bincount(of, weights=frequency * memo.counts[codes[token]], minlength=rows).astype(np.int64)
    if len(apart := memo.apart(data, offsets)):
        whole = memo.encode([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in apart])
        out[apart] = [len(ids) for ids in whole]
    return out


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """The columns of keep, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row of df.

    Counts are those of the tokenizers library for the file at path, without added special tokens; strings of special
    tokens inside a text count as the library's default has it. A null text is empty: 0 bytes, 0 tokens. Repeated rows
    stay; other columns are left out. Narrow: no shuffle, a worker holds one Arrow batch and a bounded memory of
    pre-tokens. Each distinct pre-token is encoded once by a worker, not once in the corpus: the table of
    (document, pre-token) pairs a global join needs would be larger than the corpus itself.
    """
    source = pick(df, *keep, text)
    source = source.toDF(*(f"k{i}" for i in range(len(keep))), "text")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            n = [text_token_counts(data, offsets, path) for _, _, data, offsets in K.pieces(column)]
            size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], size, pa.array(np.concatenate([*n, np.zeros(0, np.int64)]))], names=schema.names)

    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
