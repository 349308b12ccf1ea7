"""Wide alert extracts: alignment to a dictionary, family rollups, channel concentration, missingness."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph import config as C
from riskgraph.functions.grammar import parse

#: What engineered columns are called by.
PREFIX = "BX_"


def align(df: DataFrame, columns: list[str], target: str | None = None, leakage: tuple[str, ...] = (), allow_leakage: bool = False) -> tuple[DataFrame, dict[str, list[str]]]:
    """df with the dictionary's columns in its order, as floats, missing ones null; and what was missing, extra or quarantined.

    One select, however many columns there are. Names are matched stripped and regardless of case.
    """
    have = {c.strip().upper(): c for c in df.columns}
    wanted = [c for c in columns if c != target and (allow_leakage or c not in leakage)]
    out = [F.expr(f"try_cast(`{have[c.upper()]}` as float)").alias(c) if c.upper() in have else F.lit(None).cast("float").alias(c) for c in wanted]
    if target and target.upper() in have:
        out.append(F.col(f"`{have[target.upper()]}`").alias(target))
    known = {c.upper() for c in columns}
    report = {"missing": [c for c in wanted if c.upper() not in have], "extra": [c for n, c in have.items() if n not in known], "quarantined": [c for c in leakage if c.upper() in have and not allow_leakage]}
    return df.select(*out), report


def live_columns(df: DataFrame) -> list[str]:
    """Columns with more than one value, found in one pass."""
    stats = df.agg(*(F.struct(F.count(f"`{c}`").alias("n"), F.min(f"`{c}`").alias("a"), F.max(f"`{c}`").alias("b")).alias(c) for c in df.columns)).first()
    return [c for c in df.columns if stats[c]["n"] and stats[c]["a"] != stats[c]["b"]]


def _filled(columns: list[str]) -> Column:
    return F.filter(F.array(*(F.col(f"`{c}`").cast("double") for c in columns)), lambda x: x.isNotNull())


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _squared_from(mean: Column):
    return lambda x: (x - mean) * (x - mean)


def _mean(columns: list[str]) -> Column:
    """Mean of the row's filled values, null if there are none."""
    values = _filled(columns)
    return _sum(values) / F.nullif(F.size(values), F.lit(0))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is next to nothing; null where either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.when(F.abs(b) > C.SMALL, a / b).otherwise(0.0))


def families(columns: list[str]) -> dict[str, list[str]]:
    """Columns that differ by their window alone; static ones have no family."""
    out: dict[str, list[str]] = defaultdict(list)
    for c in columns:
        if not parse(c).static:
            out[parse(c).family].append(c)
    return dict(out)


def dictionary(df_or_names: DataFrame | list[str]) -> list[tuple]:
    """(name, aggregation, inducer, channel, direction, measure, window, family, static) of each column name."""
    names = df_or_names if isinstance(df_or_names, list) else df_or_names.columns
    return [(n, p.aggregation, p.inducer, p.channel, p.direction, p.measure, p.window, p.family, p.static) for n, p in ((n, parse(n)) for n in names)]


def family_rollups(df: DataFrame, keys: list[str], most: int = 400) -> DataFrame:
    """For the families of two or more windowed columns: mean, max, population deviation and nulls of the row's values, and where
    both are there the mean of windows of up to 7 days over that of windows of 31 days and more. Families are taken by size,
    most of them at the most: they are columns, over a thousand in a wide extract, not rows."""
    windowed = families([c for c in df.columns if c not in keys and parse(c).window])
    ranked = sorted((f for f in windowed.items() if len(f[1]) > 1), key=lambda f: -len(f[1]))[:most]
    out: list[Column] = []
    for name, columns in ranked:
        values = _filled(columns)
        mean = _mean(columns)
        deviation = F.sqrt(_sum(F.transform(values, _squared_from(mean))) / F.nullif(F.size(values), F.lit(0)))
        out += [mean.alias(f"{PREFIX}{name}__mean"), F.array_max(values).alias(f"{PREFIX}{name}__max"), deviation.alias(f"{PREFIX}{name}__std"), (F.lit(len(columns)) - F.size(values)).alias(f"{PREFIX}{name}__nmiss")]
        short, long = ([c for c in columns if parse(c).days and test(parse(c).days)] for test in (lambda d: min(d) <= 7, lambda d: max(d) >= 31))
        if short and long:
            out.append(safe_ratio(_mean(short), _mean(long)).alias(f"{PREFIX}{name}__accel"))
    return df.select(*keys, *out)


def channel_concentration(df: DataFrame, keys: list[str]) -> DataFrame:
    """Largest share, channels of over a hundredth, Herfindahl index and entropy of a row's mean amounts by channel."""
    channels = defaultdict(list)
    for c in df.columns:
        p = parse(c)
        if c not in keys and p.channel and p.measure == "AMT" and p.aggregation in ("RAW", "TOT", "AVG"):
            channels[p.channel].append(c)
    if len(channels) < 2:
        return df.select(*keys)
    totals = F.array(*(F.coalesce(_mean(v), F.lit(0.0)) for v in channels.values()))
    rows = df.select(*keys, totals.alias("_totals")).withColumn("_all", _sum(F.col("_totals")))
    rows = rows.withColumn("_shares", F.transform("_totals", lambda x: F.when(F.abs("_all") > C.SMALL, x / F.col("_all")).otherwise(0.0)))
    return rows.select(
        *keys, F.array_max("_shares").alias(f"{PREFIX}channel_top_share"), F.size(F.filter("_shares", lambda x: x > C.ACTIVE_SHARE)).alias(f"{PREFIX}channel_n_active"),
        _sum(F.transform("_shares", lambda x: x * x)).alias(f"{PREFIX}channel_hhi"), (-_sum(F.transform("_shares", lambda x: x * F.log(F.when(x > 0, x).otherwise(1.0))))).alias(f"{PREFIX}channel_entropy"),
    )


def flow_balance(df: DataFrame, keys: list[str]) -> DataFrame:
    """Customer-induced share, debits over credits and net flow over all flow, of means over the columns of each kind."""
    of = {kind: [c for c in df.columns if c not in keys and test(parse(c))] for kind, test in {
        "ci": lambda p: p.inducer == "CI", "bi": lambda p: p.inducer == "BI", "cr": lambda p: p.direction == "CR" and p.measure == "AMT", "db": lambda p: p.direction == "DB" and p.measure == "AMT",
    }.items()}
    mean = {kind: F.coalesce(_mean(columns), F.lit(0.0)) for kind, columns in of.items() if columns}
    out = []
    if "ci" in mean and "bi" in mean:
        out.append(safe_ratio(mean["ci"], mean["ci"] + mean["bi"]).alias(f"{PREFIX}customer_induced_share"))
    if "cr" in mean and "db" in mean:
        out += [safe_ratio(mean["db"], mean["cr"]).alias(f"{PREFIX}credit_debit_ratio"), safe_ratio(mean["cr"] - mean["db"], mean["cr"] + mean["db"]).alias(f"{PREFIX}net_flow_share")]
    return df.select(*keys, *out)


def missingness(df: DataFrame, keys: list[str]) -> DataFrame:
    """Nulls of a row, their share, and the share of values that aren't next to nothing."""
    columns = [c for c in df.columns if c not in keys]
    values, n = _filled(columns), max(1, len(columns))
    return df.select(*keys, (F.lit(len(columns)) - F.size(values)).alias(f"{PREFIX}row_nmiss"), ((F.lit(len(columns)) - F.size(values)) / n).alias(f"{PREFIX}row_nmiss_frac"), (F.size(F.filter(values, lambda x: F.abs(x) > C.SMALL)) / n).alias(f"{PREFIX}row_nonzero_frac"))


def hygiene(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df with 0 for nulls, infinities and NaN in its fractional columns (or the given ones)."""
    which = [f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double") and (columns is None or f.name in columns)]
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)) for c in which})


def engineered(columns: list[str]) -> list[str]:
    return [c for c in columns if c.startswith(PREFIX)]
