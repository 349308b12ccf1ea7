"""The account ledger and its side tables, read from the shared test tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ship days become ledger hours from this second on.
EPOCH = 1_767_225_600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txn_id, ts_s, src, dst (-1: cash), paise, channel, device?, ip?, ben_age (hours; 9999: unknown)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cash = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    priority = F.substring("o_orderpriority", 1, 1)
    channel = F.when(cash, F.when(F.col("l_linestatus") == "F", "ATM").otherwise("AEPS")).when(priority == "1", "RTGS").when(priority == "2", "IMPS").when(priority == "3", "UPI").when(priority == "4", "NEFT").otherwise("CARD")
    paise = F.round(F.col("l_extendedprice") * 100).cast("long")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", paise.cast("string")).alias("txn_id"),
        (F.lit(EPOCH) + F.datediff("l_shipdate", F.lit("1995-01-01")).cast("long") * 3600 + (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 613 + F.col("l_linenumber") * 3571) % 3600).alias("ts_s"),
        F.col("o_custkey").alias("src"),
        F.when(cash, F.lit(-1).cast("long")).otherwise(F.col("l_suppkey")).alias("dst"),
        paise.alias("paise"),
        channel.alias("channel"),
        F.when(~F.col("l_linenumber").isin(1, 7), F.concat(F.lit("D"), F.expr("o_custkey div 2"))).alias("device"),
        F.when(~F.col("l_linenumber").isin(1, 7), F.when(F.col("o_custkey") % 7 == 0, "IPX").otherwise(F.concat(F.lit("IP"), F.expr("o_custkey div 20")))).alias("ip"),
        F.when(F.col("l_linenumber") != 7, F.col("l_partkey") % 240).otherwise(9999).alias("ben_age"),
    )


def read_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, kyc, vintage_days, age, merchant."""
    c = table(spark, sf_dir, "customer")
    kyc = F.when(F.col("c_mktsegment") == "BUILDING", "MIN").when(F.col("c_mktsegment") == "MACHINERY", "VIDEO").otherwise("FULL")
    return c.select(
        F.col("c_custkey").alias("account"), kyc.alias("kyc"), F.floor(F.abs("c_acctbal") / 5).cast("long").alias("vintage_days"),
        (F.lit(18) + F.col("c_nationkey") * 2).cast("long").alias("age"), (F.col("c_mktsegment") == "HOUSEHOLD").alias("merchant"),
    )


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).withColumn("ts_s", F.unix_seconds(F.col("ts").cast("timestamp")))


def read_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticket_id (repeats), arrival, ts_s, victim, beneficiary, paise, category."""
    e = _events(spark, sf_dir, "error")
    return e.select(
        (F.col("event_id") % 500).alias("ticket_id"), F.col("event_id").alias("arrival"), "ts_s", (F.col("event_id") % 97).alias("victim"), F.col("user_id").alias("beneficiary"),
        F.round(F.col("value") * 100).cast("long").alias("paise"), F.when(F.col("event_id") % 4 == 0, "DISPUTED_TXN").when(F.col("event_id") % 4 == 1, "UPI_FRAUD").otherwise("OTP_FRAUD").alias("category"),
    )


def read_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ioc_id, kind, value, confidence (0 to 1), ts_s."""
    e = _events(spark, sf_dir, "signup")
    return e.select(F.col("event_id").alias("ioc_id"), F.when(F.col("event_id") % 2 == 0, "ACCOUNT").otherwise("VPA").alias("kind"), F.col("user_id").cast("string").alias("value"), ((F.col("event_id") % 100) / 100.0).cast("double").alias("confidence"), "ts_s")


def read_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed_id, ts_s, kind, entities (comma list), payload (JSON)."""
    e = _events(spark, sf_dir, "purchase")
    kind = F.element_at(F.array(*map(F.lit, ("SANCTION", "VELOCITY_LIMIT", "ADVISORY", "LISTED"))), (F.col("event_id") % 4).cast("int") + 1)
    return e.select(F.col("event_id").alias("feed_id"), "ts_s", kind.alias("kind"), F.concat_ws(",", "user_id", F.col("user_id") + 1).alias("entities"), F.col("props").alias("payload"))


def read_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label (0/1), score (0 to 1), from labelled documents."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"), ((F.col("n_chars") % 1000) / 1000.0).cast("double").alias("score"))
