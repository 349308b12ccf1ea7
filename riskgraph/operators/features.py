"""Behavioural features of accounts, each a function of the two-sided event view; absent values are 0 but for those of ABSENT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph import config as C

DAY = 86_400
#: What accounts without events have where it isn't 0. Of nothing received nothing went out, so all is retained.
ABSENT = {"retention": 1.0, "recency_days": 999.0}


def as_of(rows: DataFrame, ts: int | None) -> DataFrame:
    """Rows up to and with that second; the filter reaches the scan."""
    return rows if ts is None else rows.where(F.col("ts_s") <= ts)


def event_view(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """A debit row (dir -1) for the known source and a credit row (dir 1) for the known destination, from one scan."""
    legs = F.array(F.struct(F.col("src").alias("account"), F.col("dst").alias("other"), F.lit(-1).alias("dir")), F.struct(F.col("dst").alias("account"), F.col("src").alias("other"), F.lit(1).alias("dir")))
    rows = ledger.select(F.explode(legs).alias("leg"), "ts_s", "paise", "channel", "ben_age", "txn_id").select("leg.*", "ts_s", "paise", "channel", "ben_age", "txn_id")
    return rows.join(accounts.select("account"), "account", "left_semi")


def credit(x: Column | str) -> Column:
    return F.when(F.col("dir") == 1, F.col(x) if isinstance(x, str) else x)


def debit(x: Column | str) -> Column:
    return F.when(F.col("dir") == -1, F.col(x) if isinstance(x, str) else x)


def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def share(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def for_all(accounts: DataFrame, found: DataFrame, **defaults: float) -> DataFrame:
    """Every account with its features; where there are none the given default, or that of ABSENT, or 0."""
    defaults = ABSENT | defaults
    columns = [c for c in found.columns if c != "account"]
    out = accounts.select("account").join(found, "account", "left")
    kinds = dict(found.dtypes)
    return out.select("account", *(F.coalesce(c, F.lit(defaults.get(c, 0)).cast(kinds[c])).alias(c) for c in columns))


def flow_totals(events: DataFrame) -> DataFrame:
    """Counts, sums, largest and mean amounts by direction, and what passes through."""
    cash = F.col("channel").isin(*C.CASH_CHANNELS)
    sums = events.groupBy("account").agg(
        F.count(credit("paise")).alias("in_count"), F.count(debit("paise")).alias("out_count"),
        F.coalesce(F.sum(credit("paise")), F.lit(0)).alias("in_paise"), F.coalesce(F.sum(debit("paise")), F.lit(0)).alias("out_paise"),
        F.coalesce(F.max(credit("paise")), F.lit(0)).alias("max_in"), F.coalesce(F.max(debit("paise")), F.lit(0)).alias("max_out"),
        F.coalesce(F.sum(debit(F.when(cash, F.col("paise")))), F.lit(0)).alias("cash_paise"),
    )
    i, o = F.col("in_paise"), F.col("out_paise")
    return sums.select(
        "*", ratio(i, F.col("in_count")).alias("avg_in"), ratio(o, F.col("out_count")).alias("avg_out"), ratio(o, i).alias("passthrough"),
        F.greatest(F.lit(-5.0), F.least(F.lit(1.0), 1 - ratio(o, i))).alias("retention"), ratio(F.col("cash_paise"), i).alias("cashout"),
    )


def amount_spread(events: DataFrame) -> DataFrame:
    """Exact median of credits and the coefficients of variation (population) of both directions, in rupees."""

    def cv(x: Column) -> Column:
        mean, square = F.avg(x), F.avg(x * x)
        return F.round(F.coalesce(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) / F.greatest(mean, F.lit(1.0)), F.lit(0.0)), 4)

    rupees = F.col("paise") / 100
    return events.groupBy("account").agg(F.coalesce(F.median(credit("paise")), F.lit(0.0)).alias("median_in"), cv(credit(rupees)).alias("cv_in"), cv(debit(rupees)).alias("cv_out"))


def rapid_passthrough(events: DataFrame, seconds: int = C.RAPID_SECONDS) -> DataFrame:
    """Of what comes in, the share that goes out within the seconds after, a debit matched to every credit before it.

    The interval join of credits with later debits, as a range frame over both, so no pairs arise.
    """
    ahead = Window.partitionBy("account").orderBy("ts_s").rangeBetween(1, seconds)
    rows = events.withColumn("spent", F.coalesce(F.sum(debit("paise")).over(ahead), F.lit(0)))
    out = rows.groupBy("account").agg(F.coalesce(F.sum(credit(F.least("spent", "paise"))), F.lit(0)).alias("rapid_paise"), F.coalesce(F.sum(credit("paise")), F.lit(0)).alias("in_paise"))
    return out.select("account", "rapid_paise", ratio(F.col("rapid_paise"), F.col("in_paise")).alias("rapid_passthrough"))


def debit_delays(events: DataFrame) -> DataFrame:
    """Least and median minutes from a credit to the next strictly later debit, at most 10000; 0 where there is none."""
    ahead = Window.partitionBy("account").orderBy("ts_s").rangeBetween(1, Window.unboundedFollowing)
    rows = events.withColumn("delay", credit((F.min(debit("ts_s")).over(ahead) - F.col("ts_s")) / 60))

    def capped(x: Column) -> Column:
        return F.round(F.coalesce(F.least(x, F.lit(10_000.0)), F.lit(0.0)), 6)

    return rows.groupBy("account").agg(capped(F.min("delay")).alias("min_delay"), capped(F.median("delay")).alias("median_delay"), F.count("delay").alias("followed_credits"))


def counterparties(events: DataFrame) -> DataFrame:
    """Distinct payers and payees, what share the largest holds, and fan ratios. Sums by pair come first."""
    pairs = events.groupBy("account", "dir", "other").agg(F.sum("paise").alias("pair"), F.count("*").alias("n"))
    known = F.col("other") != C.CASH_SINK
    sums = pairs.groupBy("account").agg(
        F.count(credit("pair")).alias("payers"), F.count(F.when(known, debit("pair"))).alias("payees"),
        F.coalesce(F.max(credit("pair")), F.lit(0)).alias("top_in"), F.coalesce(F.max(F.when(known, debit("pair"))), F.lit(0)).alias("top_out"),
        F.coalesce(F.sum(credit("pair")), F.lit(0)).alias("i"), F.coalesce(F.sum(debit("pair")), F.lit(0)).alias("o"),
        F.coalesce(F.sum(credit("n")), F.lit(0)).alias("ni"), F.coalesce(F.sum(debit("n")), F.lit(0)).alias("no"),
    )
    return sums.select(
        "account", "payers", "payees", ratio(F.col("top_in"), F.col("i")).alias("payer_concentration"), ratio(F.col("top_out"), F.col("o")).alias("payee_concentration"),
        ratio(F.col("payers"), F.col("ni")).alias("fan_in"), ratio(F.col("payees"), F.col("no")).alias("fan_out"), ratio(F.col("payers"), F.col("payees")).alias("degree_ratio"),
    )


def reciprocity(events: DataFrame) -> DataFrame:
    """Share of debit rows whose payee has ever paid the account."""
    paid_by = events.where("dir = 1").select("account", "other").distinct().withColumn("back", F.lit(1))
    out = events.where("dir = -1").groupBy("account", "other").agg(F.count("*").alias("n"))
    joined = out.join(paid_by, ["account", "other"], "left")
    return joined.groupBy("account").agg((F.coalesce(F.sum(F.col("n") * F.col("back")), F.lit(0)) / F.sum("n")).alias("reciprocity"))


def bursts(events: DataFrame) -> DataFrame:
    """Most events that start within half an hour, and most paise within an hour, of either direction."""
    by_time = Window.partitionBy("account").orderBy("ts_s")
    rows = events.select("account", F.count("*").over(by_time.rangeBetween(0, C.BURST_SECONDS)).alias("n"), F.sum("paise").over(by_time.rangeBetween(0, C.VELOCITY_SECONDS)).alias("s"))
    return rows.groupBy("account").agg(F.max("n").alias("burst_max_30min"), F.max("s").alias("max_paise_1h"))


def timing(events: DataFrame, begin: int, end: int) -> DataFrame:
    """Active days, gaps, night and weekend shares, hour entropy, silence, recency and the dormancy-burst score.

    begin: first second of the whole ledger; end: the second features are as of. Weekend days are Friday and Saturday.
    """
    gap = F.col("ts_s") - F.lag("ts_s").over(Window.partitionBy("account").orderBy("ts_s", "txn_id", "dir"))
    hour, weekday = F.floor(F.col("ts_s") / 3600) % 24, F.dayofweek(F.timestamp_seconds("ts_s"))
    rows = events.select("account", "ts_s", gap.alias("gap"), hour.alias("hour"), weekday.isin(6, 7).alias("weekend"))
    sums = rows.groupBy("account").agg(
        F.count("*").alias("n"), F.countDistinct(F.floor(F.col("ts_s") / DAY)).alias("active_days"), F.coalesce(F.max("gap"), F.lit(0)).alias("gap"),
        share(F.col("hour").between(*C.NIGHT_HOURS)).alias("night"), share(F.col("weekend")).alias("weekend"), F.min("ts_s").alias("first"), F.max("ts_s").alias("last"),
    )
    hours = rows.groupBy("account", "hour").agg(F.count("*").alias("k"))
    hours = hours.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy("account")))
    entropy = hours.groupBy("account").agg(F.round(-F.sum(F.col("p") * F.log("p")), 6).alias("hour_entropy"))
    silence, span = (F.col("first") - begin) / DAY, F.greatest((F.col("last") - F.col("first")) / DAY, F.lit(1e-9))
    per_day = F.col("n") / F.greatest("active_days", F.lit(1))
    dormancy = silence / F.greatest(span + silence, F.lit(1.0)) * F.least(per_day / 5, F.lit(3.0))
    return sums.join(entropy, "account").select(
        "account", "active_days", per_day.alias("events_per_day"), (F.col("gap") / DAY).alias("max_gap_days"), (F.col("night") / F.col("n")).alias("night_frac"), (F.col("weekend") / F.col("n")).alias("weekend_frac"),
        "hour_entropy", silence.alias("silence_days"), ((F.lit(end) - F.col("last")) / DAY).alias("recency_days"), F.round(dormancy, 9).alias("dormancy"),
    )


def structuring(events: DataFrame) -> DataFrame:
    """Shares of debits in the structuring band, of round and of sub-threshold amounts, and of fresh counterparties."""
    band = (F.col("paise") >= C.STRUCTURING_BAND[0] * 100) & (F.col("paise") < C.STRUCTURING_BAND[1] * 100)
    below = (F.col("paise") > C.SUB_THRESHOLD_BAND[0] * 100) & (F.col("paise") < C.SUB_THRESHOLD_BAND[1] * 100)
    fresh = F.col("ben_age") < C.FRESH_HOURS
    is_debit, is_credit = F.col("dir") == -1, F.col("dir") == 1
    sums = events.groupBy("account").agg(
        share(is_debit).alias("o"), share(is_credit).alias("i"), share(is_debit & band).alias("b"), share(is_debit & (F.col("paise") % 100_000 == 0)).alias("r"), share(is_debit & below).alias("s"),
        share(is_debit & fresh).alias("fo"), share(is_credit & fresh).alias("fi"),
    )
    names = {"structuring_frac": ("b", "o"), "round_frac": ("r", "o"), "sub_threshold_frac": ("s", "o"), "new_beneficiary_frac": ("fo", "o"), "first_time_payer_frac": ("fi", "i")}
    return sums.select("account", *(ratio(F.col(a), F.col(b)).alias(n) for n, (a, b) in names.items()))


def channel_mix(events: DataFrame) -> DataFrame:
    """Share of an account's events by channel group."""
    return events.groupBy("account").agg(*((share(F.col("channel").isin(*v)) / F.count("*")).alias(f"frac_{k}") for k, v in C.CHANNEL_GROUPS.items()))


def device_stats(ledger: DataFrame, accounts: DataFrame, column: str = "device") -> DataFrame:
    """Of an account's devices (or addresses): how many, the most accounts on one of them, entropy of their use."""
    uses = ledger.where(F.col(column).isNotNull()).join(accounts.select("account"), F.col("src") == F.col("account"), "left_semi")
    uses = uses.groupBy(F.col("src").alias("account"), column).agg(F.count("*").alias("k"))
    on = uses.groupBy(column).agg(F.count("*").alias("on_it"))
    rows = uses.join(on, column).withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy("account")))
    # two equal terms may come in any order, but no account's sum depends on it after rounding
    return rows.groupBy("account").agg(F.count("*").alias(f"n_{column}s"), F.max("on_it").alias(f"{column}_max_accounts"), F.round(F.abs(F.sum(F.col("p") * F.log("p"))), 6).alias(f"{column}_entropy"))


def behaviour(ledger: DataFrame, accounts: DataFrame, end: int | None = None) -> DataFrame:
    """All features of all accounts. The ledger as of end and its events are written once to the shared folder, as a dozen parts
    each read the few columns that they need, and shuffle these by account or by pair."""
    from riskgraph.operators.graph import settled

    ledger = settled(as_of(ledger, end))
    bounds = ledger.agg(F.min("ts_s"), F.max("ts_s")).first()
    events = settled(event_view(ledger, accounts))
    begin, end = bounds[0] or 0, end if end is not None else bounds[1] or 0
    parts = [flow_totals(events), amount_spread(events), rapid_passthrough(events), debit_delays(events), counterparties(events), reciprocity(events), bursts(events), timing(events, begin, end), structuring(events), channel_mix(events), device_stats(ledger, accounts), device_stats(ledger, accounts, "ip")]
    out = accounts
    for part in parts:
        out = out.join(for_all(accounts, part), "account")
    return out


def in_flight(ledger: DataFrame, profile: DataFrame) -> DataFrame:
    """Features of single transactions: their own, and averages and passthrough of both parties, 0 for unknown ones."""
    def of(side: str) -> DataFrame:
        return profile.select(F.col("account").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("avg_in", "avg_out", "passthrough", "payers")))

    rows = ledger.join(of("src"), "src", "left").join(of("dst"), "dst", "left").na.fill(0)
    hour = F.floor(F.col("ts_s") / 3600) % 24
    return rows.select(
        "txn_id", "paise", F.round(F.log1p(F.col("paise") / 100), 6).alias("log_amount"), hour.cast("long").alias("hour"), hour.between(*C.NIGHT_HOURS).alias("night"), (F.col("ben_age") < C.FRESH_HOURS).alias("fresh"),
        F.col("channel").isin(*C.CASH_CHANNELS).alias("cash"), (F.col("dst") == C.CASH_SINK).alias("to_pool"), *(f"{s}_{c}" for s in ("src", "dst") for c in ("avg_in", "avg_out", "passthrough", "payers")),
        ratio(F.col("paise"), F.col("src_avg_out")).alias("vs_src"), ratio(F.col("paise"), F.col("dst_avg_in")).alias("vs_dst"),
    )


def event_sequence(events: DataFrame, last: int = C.LAST_EVENTS) -> DataFrame:
    """The last events of each account, oldest first, with gap, novelty and amount against the account's mean."""
    by_time = Window.partitionBy("account").orderBy("ts_s", "txn_id", "dir")
    newest = Window.partitionBy("account").orderBy(F.col("ts_s").desc(), F.col("txn_id").desc(), F.col("dir").desc())
    rows = events.select(
        "account", "txn_id", "dir", "ts_s", "paise", F.coalesce(F.col("ts_s") - F.lag("ts_s").over(by_time), F.lit(0)).alias("gap"),
        (F.row_number().over(Window.partitionBy("account", "other").orderBy("ts_s", "txn_id", "dir")) == 1).alias("novel"),
        F.round(F.greatest(F.lit(-6.0), F.least(F.lit(6.0), F.log1p(F.col("paise") / 100) - F.log1p(F.greatest(F.avg("paise").over(Window.partitionBy("account")) / 100, F.lit(1.0))))), 6).alias("vs_mean"),
        F.row_number().over(newest).alias("slot"),
    )
    return rows.where(F.col("slot") <= last).withColumn("slot", F.lit(last) - F.col("slot"))
