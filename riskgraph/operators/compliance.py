"""Threshold reports, exposure and the hash-chained audit trail."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgraph import config as C
from riskgraph.operators.graph import scratch, settled

#: What stands for the predecessor of the first entry.
GENESIS = "0" * 64


def ctr_candidates(ledger: DataFrame, threshold: float = C.CTR_THRESHOLD) -> DataFrame:
    """account, day (UTC), paise, n: account-days of cash of at least the threshold, in rupees."""
    cash = ledger.where(F.col("channel").isin(*C.CASH_CHANNELS)).groupBy(F.col("src").alias("account"), F.floor(F.col("ts_s") / 86400).alias("day"))
    return cash.agg(F.sum("paise").alias("paise"), F.count("*").alias("n")).where(F.col("paise") >= int(threshold * 100))


def exposure(events: DataFrame, now: int, days: int = 7) -> DataFrame:
    """account, exposure_paise: credits less debits of the last days, at least 0."""
    recent = events.where((F.col("ts_s") > now - days * 86400) & (F.col("ts_s") <= now))
    return recent.groupBy("account").agg(F.greatest(F.sum(F.col("paise") * F.col("dir")), F.lit(0)).alias("exposure_paise"))


def bodies(entries: DataFrame) -> DataFrame:
    """Each entry (seq, at, actor, event, payload) with its payload digest and all it says. at: its time, as text.

    A payload is digested as text; one that isn't text is first written as JSON with keys in order.
    """
    kind = entries.schema["payload"].dataType.typeName()
    payload = F.col("payload")
    if kind == "map":
        payload = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(payload))))
    elif kind == "struct":
        payload = F.to_json(F.struct(*(payload[n].alias(n) for n in sorted(entries.schema["payload"].dataType.names))))
    digest = F.sha2(payload.cast("string"), 256)
    body = F.concat_ws("|", F.col("seq").cast("string"), "at", "actor", "event", digest)
    return entries.select("seq", "at", "actor", "event", digest.alias("payload_digest"), body.alias("body"))


def audit_chain(entries: DataFrame, genesis: str = GENESIS, rows_per_range: int = 1_000_000) -> DataFrame:
    """Each entry (seq, at, actor, event, payload) with its payload digest, its predecessor's entry_hash and its own.

    An entry_hash covers the one before it, so it commits to the whole history, and seq may have gaps. Digests are made side by
    side; the hashes must follow one another, range of seq by range, each begun with the last hash of the range before.
    """
    spark = entries.sparkSession
    rows = settled(bodies(entries))
    n = max(1, -(-rows.count() // rows_per_range))
    ranged = settled(rows.repartitionByRange(n, "seq").withColumn("part", F.spark_partition_id()))
    path, head, columns = scratch(spark), genesis, ["seq", "at", "actor", "event", "payload_digest", "prev_hash", "entry_hash"]
    schema = entries.select("seq", "at", "actor", "event", *(F.lit("").alias(c) for c in columns[4:])).schema

    def chain(begin: str):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last = begin
            for frame in frames:
                hashes = [last]
                for body in frame["body"]:
                    hashes.append(hashlib.sha256(f"{body}|{hashes[-1]}".encode()).hexdigest())
                last = hashes[-1]
                yield frame.assign(prev_hash=hashes[:-1], entry_hash=hashes[1:])[columns]

        return run

    for part in range(n):
        ordered = ranged.where(F.col("part") == part).repartition(1).sortWithinPartitions("seq", "body")
        ordered.mapInPandas(chain(head), schema).write.parquet(f"{path}/{part}")
        done = spark.read.schema(schema).parquet(f"{path}/{part}")
        # the end of a range is the hash that no entry of it has for its predecessor
        end = done.select("entry_hash").join(done.select(F.col("prev_hash").alias("entry_hash")), "entry_hash", "left_anti").first()
        head = end[0] if end else head
    return spark.read.schema(schema).parquet(*(f"{path}/{part}" for part in range(n)))


def verify_chain(stored: DataFrame, entries: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """seq of every entry that isn't stored as the entries have it, that isn't stored or known at all, or whose predecessor
    is one of these, isn't there, isn't earlier or has another successor. All are looked at side by side."""
    own = F.sha2(F.concat_ws("|", "body", "prev_hash"), 256)
    rows = stored.select("seq", "prev_hash", "entry_hash").join(bodies(entries).select("seq", "body"), "seq", "full")
    rows = rows.withColumn("holds", F.coalesce(own == F.col("entry_hash"), F.lit(False)))
    before = rows.where("entry_hash IS NOT NULL").select(F.col("entry_hash").alias("prev_hash"), F.col("seq").alias("seq_before"), F.col("holds").alias("holds_before"))
    forked = rows.groupBy("prev_hash").agg((F.count("*") > 1).alias("forked"))
    linked = (F.col("prev_hash") == genesis) | (F.col("holds_before") & (F.col("seq_before") < F.col("seq")))
    rows = rows.join(before, "prev_hash", "left").join(forked, "prev_hash", "left")
    return rows.where(~(F.col("holds") & F.coalesce(linked, F.lit(False)) & ~F.coalesce("forked", F.lit(False)))).select("seq").distinct()


def chain_head(stored: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """head, entries: the last entry's hash, the first one's predecessor where there is none; what is published to bind the log."""
    return stored.agg(F.coalesce(F.max_by("entry_hash", "seq"), F.lit(genesis)).alias("head"), F.count("*").alias("entries"))


def chain_tail(stored: DataFrame, n: int = 50) -> DataFrame:
    return stored.orderBy(F.col("seq").desc()).limit(n)


def append_log(entries: DataFrame, path: str) -> None:
    """Adds entries to a log of JSON lines; reload_log() reads it back without the payloads."""
    entries.write.mode("append").json(path)


def reload_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def totals(accounts: DataFrame, ledger: DataFrame, scores: DataFrame, rings: DataFrame | None = None, threshold: float = 40.0) -> DataFrame:
    """One row: accounts, transactions, paise, alerts at the threshold, mean risk and the largest ring (size)."""
    one = accounts.agg(F.count("*").alias("accounts")).crossJoin(ledger.agg(F.count("*").alias("transactions"), F.coalesce(F.sum("paise"), F.lit(0)).alias("paise")))
    one = one.crossJoin(scores.agg(F.count_if(F.col("risk") >= threshold).alias("alerts"), F.avg("risk").alias("mean_risk")))
    return one if rings is None else one.crossJoin(rings.agg(F.coalesce(F.max("size"), F.lit(0)).alias("largest_ring")))


def overview(scores: DataFrame) -> DataFrame:
    """band, accounts, mean risk."""
    from riskgraph.operators.rules import band

    return scores.groupBy(band(F.col("risk")).alias("band")).agg(F.count("*").alias("accounts"), F.round(F.avg("risk"), 6).alias("mean_risk"))


def latest_transactions(ledger: DataFrame, most: int = 50) -> DataFrame:
    """account, txn_id, place: the latest transactions of each source, as a filing lists them."""
    order = Window.partitionBy("src").orderBy(F.col("ts_s").desc(), "txn_id")
    return ledger.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(F.col("src").alias("account"), "txn_id", "place")
