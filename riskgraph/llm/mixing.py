"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.llm.common import cut, pick, row_key

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Rows that one task puts in order; a source's rows are dealt over as many ranges of the key as that takes.
RANGE_ROWS = 4096


def targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: share times all sizes dealt by weight, no source above most times its own size.

    What a source can't take goes to the others by weight until none is above. That is a common level: with the sources
    by most * size / weight, all before some place are full and the rest get level * weight. sources: one row a source, so
    the windows over all of them hold no more than that.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = sources.withColumn("weight", F.array(*map(F.lit, weights))[((F.row_number().over(by_name) - 1) % len(weights)).cast("int")])
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("most") / F.col("weight"))
    full = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - full) / left)
    ranked = ranked.withColumn("place", F.row_number().over(by_ratio))
    ranked = ranked.withColumn("found", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every)["level"])
    return ranked.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("found") * F.col("weight"), F.col("most"))).alias("target"))


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", share: float = 1.5, most: float = 2.0, seed: str = "", tag: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) for every row of df.

    size: runs of other characters than \\x20 and \\x09-\\x0D, 0 for a null text. A row's place in its source is the md5 of
    seed and doc_id, so reruns agree; ties go by doc_id and size. A source takes whole epochs, then its rows in order up to
    the exact word at which floor(target) is reached. tag: one more column to go by in ties and to return. Rows of null source are one source; rows of null doc_id and repeated
    rows count as rows of their own; empty sources take nothing; other columns are left out.

    The key's top bits deal a source over ranges of equal expected size; the sums of ranges are summed up to each range, and
    only inside a range are rows put in order. So one source may hold all rows.
    """
    rows = pick(df, doc_id, source, text, *([tag] if tag else [])).toDF("doc_id", "source", "text", *(["tag"] if tag else []))
    more = ["tag"] if tag else []
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = cut(rows.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"), *more))
    by_source = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most))
    ranges = 1
    count = sized.count()
    while ranges < 65536 and ranges * RANGE_ROWS < count:
        ranges *= 2
    sized = sized.withColumn("range", F.expr(f"conv(substr(key, 1, 4), 16, 10) div {65536 // ranges}").cast("long"))
    sums = sized.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(before, F.lit(0)).alias("before_range"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("upto", F.sum("size").over(inside)).join(sums, F.expr("source <=> s and range = r"))
    placed = placed.join(by_source.select(F.col("source").alias("name"), "source_size", "target"), F.expr("source <=> name"))
    budget = F.floor("target").cast("long")
    placed = placed.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    left = budget - F.col("epochs") * F.col("source_size") - (F.col("before_range") + F.col("upto") - F.col("size"))
    taken = F.col("epochs") * F.col("size") + F.least(F.greatest(left, F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *more)




def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The mix of mix() as documents: doc_id, text, lang, source, n_chars.

    Each row as often as the mix takes it whole, and the row at a source's cut once more with just the words that the mix
    takes of it, joined by single spaces. Empty texts have no words to take and stay as they are.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = pick(df, *columns).withColumn("tag", row_key(*columns))
    taken = mix(rows, tag="tag", **options)
    whole = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.greatest("size", F.lit(1))))
    part = F.when(F.col("size") == 0, 0).otherwise(F.col("taken") % F.greatest("size", F.lit(1)))
    taken = taken.groupBy("tag").agg(F.sum(whole).cast("int").alias("whole"), F.max(part).cast("int").alias("part"))
    copies = F.concat(F.array_repeat(F.lit(0), F.col("whole")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<int>")))
    out = rows.dropDuplicates(["tag"]).join(taken, "tag").withColumn("words", F.explode(copies))
    cut_text = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.greatest("words", F.lit(1))), " ")
    out = out.withColumn("text", F.when(F.col("words") > 0, cut_text).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns)
