"""Tickets, threat indicators and supervisory directives joined to accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph import config as C

# Complaint categories that are fraud rather than a commercial dispute.
FRAUD_CATEGORIES = ("UPI_FRAUD", "APK_TROJAN", "OTP_FRAUD", "INVESTMENT_SCAM", "DIGITAL_ARREST", "JOB_SCAM", "LOAN_APP_HARASSMENT", "SEXTORTION", "CARD_NOT_PRESENT")


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by order."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def normalise_tickets(raw: DataFrame) -> DataFrame:
    """Upstream payloads with alternative field names to ticket_id, ts_s, victim, beneficiary, source."""
    def first(*names: str) -> Column:
        return F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in raw.columns), F.lit(None).cast("string"))

    at = first("reported_at", "complaint_date")
    seconds = F.coalesce(F.try_to_number(at, F.lit("9999999999")).cast("long"), F.unix_seconds(F.try_to_timestamp(at)))
    return raw.select(F.coalesce(first("ticket_id", "ack_no"), F.lit("UNKNOWN")).alias("ticket_id"), seconds.alias("ts_s"), first("victim_account", "complainant_account").alias("victim"), F.coalesce(first("beneficiary_account", "suspect_account", "credited_account"), F.lit("")).alias("beneficiary"), F.coalesce(first("source"), F.lit("NCRP")).alias("source"))


def hard_tickets(tickets: DataFrame) -> DataFrame:
    return tickets.where(F.col("category").isin(*FRAUD_CATEGORIES))


def lookback(tickets: DataFrame, account: int, hours: float, now: int) -> DataFrame:
    return tickets.where((F.col("beneficiary") == account) & (F.col("ts_s") >= now - int(hours * 3600)) & (F.col("ts_s") <= now))


def beneficiary_summary(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("beneficiary").agg(F.count("*").alias("tickets"), F.sum("paise").alias("paise"), F.countDistinct("victim").alias("victims"), F.max("ts_s").alias("last"))


def best_indicators(indicators: DataFrame) -> DataFrame:
    """One indicator a (kind, value): that of the highest confidence, then the latest id."""
    best = Window.partitionBy("kind", "value").orderBy(F.col("confidence").desc(), F.col("ioc_id").desc())
    return indicators.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def entities(directives: DataFrame, *kinds: str) -> DataFrame:
    """account: those that directives of the kinds name in their comma lists."""
    named = directives.where(F.col("kind").isin(*kinds)).select(F.explode(F.split("entities", ",")).alias("e"))
    return named.where("e <> ''").select(F.expr("try_cast(e as bigint)").alias("account")).where("account is not null").distinct()


def limits(directives: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """limit, value: the latest numeric value of each key in the payloads of velocity directives, over the defaults."""
    rows = directives.where("kind = 'VELOCITY_LIMIT'").select("ts_s", "feed_id", F.explode(F.from_json("payload", "map<string,string>")).alias("limit", "v"))
    rows = rows.select("limit", F.expr("try_cast(v as double)").alias("value"), "ts_s", "feed_id").where("value is not null")
    found = rows.groupBy("limit").agg(F.max_by("value", F.struct("ts_s", "feed_id")).alias("value"))
    if not defaults:
        return found
    spark = directives.sparkSession
    given = spark.createDataFrame(list(defaults.items()), "limit string, value double")
    return found.union(given.join(found, "limit", "left_anti"))


def intel_features(accounts: DataFrame, tickets: DataFrame, indicators: DataFrame, directives: DataFrame, now: int) -> DataFrame:
    """Eight features an account from what was known by now, and has_intelligence.

    Indicators hit by account number or, where accounts have a column vpa, by payment address: two equi joins brought together.
    Listed are accounts of mule lists alone; sanctions act on the score (apply_directives).
    """
    known = tickets.where(F.col("ts_s") <= now).groupBy(F.col("beneficiary").alias("account")).agg(F.count("*").alias("n"), F.sum("paise").alias("p"), F.max("ts_s").alias("last"), F.countDistinct("victim").alias("v"))
    seen = indicators.where(F.col("ts_s") <= now)
    hits = seen.where("kind = 'ACCOUNT'").select(F.expr("try_cast(value as bigint)").alias("account"), "confidence")
    if "vpa" in accounts.columns:
        hits = hits.union(seen.where("kind = 'VPA'").join(accounts.select("account", F.col("vpa").alias("value")), "value").select("account", "confidence"))
    hits = hits.groupBy("account").agg(F.max("confidence").alias("c"))
    listed = entities(directives.where(F.col("ts_s") <= now), "LISTED").withColumn("l", F.lit(1))
    rows = accounts.select("account").join(known, "account", "left").join(hits, "account", "left").join(listed, "account", "left")
    recency = F.when(F.col("last").isNull(), C.NO_TICKET_RECENCY).otherwise(F.least(F.greatest((F.lit(now) - F.col("last")) / 86400, F.lit(0.0)), F.lit(C.NO_TICKET_RECENCY)))
    zero = F.lit(0)
    out = rows.select("account", F.coalesce("n", zero).alias("tickets"), F.coalesce("p", zero).alias("ticket_paise"), recency.alias("ticket_recency"), F.coalesce("v", zero).alias("victims"), F.col("c").isNotNull().cast("int").alias("ioc_hit"), F.coalesce("c", F.lit(0.0)).alias("ioc_confidence"), F.col("c").isNotNull().cast("int").alias("preemptive"), F.coalesce("l", zero).alias("listed"))
    return out.withColumn("has_intelligence", (F.col("tickets") > 0) | (F.col("ioc_hit") > 0) | (F.col("listed") > 0))


def apply_directives(risk: DataFrame, directives: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Listed accounts score at least 75, their neighbours (src, dst) 8 more up to 100, sanctioned ones 100."""
    listed, sanctioned = entities(directives, "LISTED").withColumn("l", F.lit(True)), entities(directives, "SANCTION").withColumn("s", F.lit(True))
    near = neighbours.join(listed.select(F.col("account").alias("src")), "src", "left_semi").select(F.col("dst").alias("account"), F.lit(True).alias("n")).distinct()
    rows = risk.join(listed, "account", "left").join(sanctioned, "account", "left").join(near, "account", "left")
    score = F.when(F.col("s"), 100.0).when(F.col("l"), F.greatest("risk", F.lit(C.LISTED_FLOOR))).when(F.col("n"), F.least(F.col("risk") + C.NEIGHBOUR_BONUS, F.lit(100.0))).otherwise(F.col("risk"))
    return rows.select("account", score.alias("risk"))


def advisories(directives: DataFrame, now: int | None = None) -> DataFrame:
    """feed_id, kind, ts_s, payload (JSON) of advisories and typologies published by now; plain text becomes {"text": ...}."""
    rows = directives.where(F.col("kind").isin("ADVISORY", "TYPOLOGY"))
    rows = rows if now is None else rows.where(F.col("ts_s") <= now)
    parsed = F.try_parse_json("payload")
    return rows.select("feed_id", "kind", "ts_s", F.when(parsed.isNotNull(), F.col("payload")).otherwise(F.to_json(F.struct(F.col("payload").alias("text")))).alias("payload"))


def ingest_directives(raw: DataFrame, order: str) -> DataFrame:
    """raw with lists joined by commas and maps or structs as JSON, one row a feed_id, the last by order."""
    out = []
    for field in raw.schema.fields:
        kind = field.dataType.typeName()
        c = F.col(field.name)
        out.append((F.array_join(c.cast("array<string>"), ",") if kind == "array" else F.to_json(c) if kind in ("map", "struct") else c).alias(field.name))
    return keep_last(raw.select(*out), "feed_id", order)


def validated(ledger: DataFrame, channels: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows that may enter, rows that may not with their reasons): a positive amount, known channel, two parties, an age of 0 or more."""
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(F.col("paise") <= 0, F.lit(True)), "AMOUNT"), F.when(~F.coalesce(F.col("channel").isin(*channels), F.lit(False)), "CHANNEL"),
        F.when(F.col("src").isNull() | F.col("dst").isNull(), "PARTY"), F.when(F.coalesce(F.col("ben_age") < 0, F.lit(False)), "BENEFICIARY_AGE"),
    ))
    told = ledger.withColumn("reasons", F.array_join(reasons, ","))
    return told.where("reasons = ''").drop("reasons"), told.where("reasons <> ''")
