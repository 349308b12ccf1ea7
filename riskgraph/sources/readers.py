"""Readers and writers: tables by file type, the ledger's tables with their schemas, spreadsheets without extra libraries."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "transactions": "txn_id string, ts double, timestamp timestamp, src_account string, dst_account string, amount double, channel string, txn_type string, device_id string, ip_address string, src_vpa string, dst_vpa string, beneficiary_age_hours double, is_fraud boolean, ring_id string",
    "accounts": "account_id string, customer_id string, bank_code string, branch_code string, open_date timestamp, kyc_level string, customer_age int, income_band string, state string, is_internal boolean, is_merchant boolean, home_device string, home_ip string, vpa string, account_vintage_days int, is_mule boolean, mule_typology string, mule_role string, ring_id string, is_small_business boolean, legit_dormant_wake boolean, is_legit_collector boolean, is_bc_agent boolean",
    "devices": "device_id string, account_id string, first_seen timestamp, last_seen timestamp",
    "fraud_alerts": "ticket_id string, reported_at timestamp, source string, victim_account string, beneficiary_account string, beneficiary_vpa string, amount double, fraud_category string, narrative string, ring_id string",
    "iocs": "ioc_id string, ioc_type string, value string, confidence double, source_apk_sha256 string, malware_family string, observed_at timestamp, ring_id string",
    "regulatory": "feed_id string, published_at timestamp, authority string, directive_type string, entities string, payload string",
    "rings": "ring_id string, typology string, size int, members string, collectors string, cashouts string, first_active_day int, is_late_ring boolean, is_quiet boolean, total_amount double, n_campaigns int",
}
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """Rows of a workbook's first sheet as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        first = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        out: list[list[str | None]] = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{_MAIN}row"):
            cells: dict[int, str | None] = {}
            for i, c in enumerate(row.iter(f"{_MAIN}c")):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = i if letters is None else sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1
                v = c.find(f"{_MAIN}v")
                text = v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) or None
                cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return out


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: parquet or pq, xlsx, tsv or tab, else csv. Text formats come as text columns."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("parquet", "pq"):
        return spark.read.parquet(path)
    if suffix == "xlsx":
        # a workbook is one small file by format, so one task reads it; Spark's reader reaches any store
        head = spark.read.format("binaryFile").load(path).select("content").first()["content"]
        rows = sheet_rows(bytes(head))
        names, body = rows[0], rows[1:]
        schema = T.StructType([T.StructField(str(n), T.StringType()) for n in names])
        return spark.createDataFrame([tuple((r + [None] * len(names))[: len(names)]) for r in body], schema)
    return spark.read.csv(path, header=True, sep="\t" if suffix in ("tsv", "tab") else ",")


def load_tables(spark: SparkSession, folder: str, forms: tuple[str, ...] = ("parquet", "csv")) -> dict[str, DataFrame]:
    """The ledger's tables, each in the first of the forms that the folder has it in."""
    reader, out = spark.read.option("header", True), {}
    for name, schema in SCHEMAS.items():
        for form in forms:
            try:
                out[name] = reader.schema(schema).format(form).load(f"{folder}/{name}.{form}")
                break
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND" or form == forms[-1]:
                    raise
    return out


def save_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet", meta: dict[str, object] | None = None) -> None:
    """The tables, and with meta a table of one row of JSON that tells about them."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).format(form).save(f"{folder}/{name}.{form}")
    if meta is not None:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta.json")


def load_meta(spark: SparkSession, folder: str) -> dict[str, object]:
    return json.loads("".join(r.value for r in spark.read.text(f"{folder}/meta.json").collect()))


def load_dictionary(spark: SparkSession, path: str, column: str | None = None) -> list[str]:
    """Column names of a wide extract from a dictionary file of any form that read_any() reads: those of the column, by default
    the first, stripped, in order, each once. A dictionary is metadata of a few thousand names, so the driver holds it."""
    table = read_any(spark, path)
    rows = table.select(column or table.columns[0]).collect()
    return list(dict.fromkeys(r[0].strip() for r in rows if r[0] and r[0].strip()))


def save_predictions(scored: DataFrame, path: str, keys: list[str], prob: str = "prob", threshold: float = 0.5) -> None:
    """keys as they came, proba and pred (0 or 1) as CSV with a header."""
    out = scored.select(*keys, F.col(prob).alias("proba"), (F.col(prob) >= threshold).cast("int").alias("pred"))
    out.write.mode("overwrite").option("header", True).csv(path)


def native_ledger(transactions: DataFrame) -> DataFrame:
    """The native transactions table as the ledger the operators take, account ids as they are."""
    return transactions.select("txn_id", F.floor("ts").cast("long").alias("ts_s"), F.col("src_account").alias("src"), F.when(F.col("dst_account") == "CASH_POOL", None).otherwise(F.col("dst_account")).alias("dst"), F.round(F.col("amount") * 100).cast("long").alias("paise"), "channel", F.col("device_id").alias("device"), F.col("ip_address").alias("ip"), F.coalesce("beneficiary_age_hours", F.lit(9999.0)).alias("ben_age"))


def quarantine(transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the contract, amounts rounded to paise, and those that don't."""
    fine = F.coalesce((F.col("amount") > 0) & F.col("txn_id").isNotNull() & F.col("src_account").isNotNull() & F.col("dst_account").isNotNull(), F.lit(False))
    return transactions.where(fine).withColumn("amount", F.round("amount", 2)), transactions.where(~fine)
