"""Secret scans by corpus-wide ownership frequency; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import cut, pick, row_key

#: kind: pattern, group whose length counts, least length. Order breaks ties of one start.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: What the ownership test may add: long strings of mixed characters with no name before them.
MIXED = ("mixed", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
#: A text without these can't hold a span of the kind; cheaper than the pattern.
MAYBE = {"access": "AKIA"}
#: From so many owners, or from so many repositories, on a value is a copied example.
COPIED_OWNERS, COPIED_REPOS = 3, 6
#: Up to so many owners and so many repositories a value may be a live credential of its owner.
OWNED, OWNED_REPOS = 1, 2
#: Characters that a random string of 20 has at least.
DISTINCT = 8
#: Lengths summed in one go; sums of blocks are summed once more.
BLOCK = 512
#: Documents that hold a value and go to one share of it; each share gets a copy of the value's counts.
SHARE = 100_000


def _scan(values: Column) -> Column:
    """Sums of the elements before each."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, start, lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")), lambda a: a["out"])


def running(values: Column) -> Column:
    """As _scan, over blocks, as appending to one array would take time with the square of its length."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v))
    return F.flatten(F.zip_with(blocks, _scan(sums), lambda x, before: F.transform(_scan(x), lambda v: v + before)))


SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"


def spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """The leftmost non-overlapping matches of a kind, in code points, but for those whose group is too short.

    A text is what stands between matches and the matches in turn, so a match starts where the lengths before it end.
    """
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    length = F.transform(found, lambda x: F.length(x).cast("long"))
    start = F.zip_with(running(length), F.slice(F.transform(running(between), lambda x: x), 2, F.size(found)), lambda a, b: a + b)
    out = F.transform(
        F.arrays_zip(start.alias("start"), length.alias("length"), value.alias("value")),
        lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["start"] + x["length"]).alias("end"), x["value"].alias("value")),
    )
    maybe = F.contains(text, F.lit(MAYBE[kind])) & F.rlike(text, F.lit(pattern)) if kind in MAYBE else F.rlike(text, F.lit(pattern))
    out = F.filter(out, lambda x: F.length(x["value"]) >= least) if group else F.filter(out, lambda x: x["end"] - x["start"] >= least)
    return F.when(maybe, out).otherwise(F.array().cast(SPAN)).cast(SPAN)


def looks_random(value: Column) -> Column:
    """Small and capital letters and digits, and not a few characters over and over."""
    classes = F.rlike(value, F.lit("[a-z]")) & F.rlike(value, F.lit("[A-Z]")) & F.rlike(value, F.lit("[0-9]"))
    return classes & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT)


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def told_by(at: dict[str, Column], owner: str, repo: tuple[str, ...]) -> dict[str, Column]:
    """The owner and the repository of a row, as text; nulls read as empty."""
    filled = {c: F.coalesce(at[c].cast("string"), F.lit("")) for c in (owner, *repo)}
    return {"owner": filled[owner], "repo": F.concat_ws("/", *(filled[c] for c in repo))}


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, base (array of spans), found (base and added spans), n_live and n_copied for every row of df.

    Spans: start, end (code points, end exclusive), rank, kind and value, by start, then kind. Base spans are the matches
    of BASE and always stay. Every candidate value in the corpus gets the number of distinct owners and repositories that
    hold it. Held by COPIED_OWNERS owners or in COPIED_REPOS repositories it is a copied example (n_copied counts such base
    spans); of at most OWNED owners and in at most OWNED_REPOS repositories it is owner-specific (n_live). A MIXED span is
    added if its value is owner-specific and looks random, and no base span overlaps it. owner, repo: the columns that tell an
    owner, and those that together tell a repository.

    A null text is empty, and so is a null owner or part of a repository. Repeated rows stay, each with its own result. Other
    columns are left out. Holders of a value are counted by distinct (value, owner, repository), (value, owner) and value,
    so no value's holders meet in one task, and its counts go back to shares of SHARE of them. Empty tables give empty ones.
    """
    names = dict.fromkeys((doc_id, text, owner, *repo))
    df = pick(df, *names).toDF(*(f"c{i}" for i in range(len(names))))
    at = {name: F.col(f"c{i}") for i, name in enumerate(names)}
    rows = df.select(*(c.alias(k) for k, c in told_by(at, owner, repo).items()), at[doc_id].alias("doc_id"), F.coalesce(at[text], F.lit("")).alias("text"))
    base = F.array_sort(F.concat(*(spans(F.col("text"), i, k, *p) for i, (k, p) in enumerate(BASE.items()))))
    more = F.filter(spans(F.col("text"), len(BASE), *MIXED), lambda x: looks_random(x["value"]))
    rows = rows.select("doc_id", "owner", "repo", row_key("doc_id", "text", "owner", "repo").alias("key"), base.alias("base"), more.alias("more"))
    rows = cut(rows)
    values = F.array_distinct(F.transform(F.concat("base", "more"), lambda x: F.md5(x["value"])))
    held = rows.where(F.size("base") + F.size("more") > 0).select("key", "owner", "repo", F.explode(values).alias("hash"))
    counts = held.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    counts = counts.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.ceil(F.sum("n") / SHARE).cast("int").alias("shares"))
    # values of more than one share are few: the holders of all values over SHARE at most
    shared = counts.where("shares > 1").select("hash", "shares")
    counts = counts.select("hash", "owners", "repos", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    held = held.select("key", "hash").distinct().join(shared, "hash", "left")
    held = held.select("key", "hash", F.pmod("key.key1", F.coalesce("shares", F.lit(1))).cast("int").alias("share")).join(counts, ["hash", "share"])
    by_row = held.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("hash", F.struct("owners", "repos")))).alias("counts"))
    out = rows.join(by_row, "key", "left").withColumn("counts", F.coalesce("counts", F.expr("cast(map() as map<string,struct<owners:bigint,repos:bigint>>)")))

    def holders(x: Column) -> Column:
        return F.element_at("counts", F.md5(x["value"]))

    def owned(x: Column) -> Column:
        return (holders(x)["owners"] <= OWNED) & (holders(x)["repos"] <= OWNED_REPOS)

    def copied(x: Column) -> Column:
        return (holders(x)["owners"] >= COPIED_OWNERS) | (holders(x)["repos"] >= COPIED_REPOS)

    apart = F.filter("more", lambda x: owned(x) & ~F.exists("base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return out.select(
        "doc_id", "base", F.array_sort(F.concat("base", apart)).alias("found"),
        F.size(F.filter("base", owned)).cast("long").alias("n_live"),
        F.size(F.filter("base", copied)).cast("long").alias("n_copied"), "key",
    )


def redacted(df: DataFrame, doc_id: str = "doc_id", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """df (doc_id, text, lang, source, n_chars) with the mask in place of every span of scan(), n_chars brought up to date.

    All rows stay; overlapping spans are masked as one.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = pick(df, *columns)
    found = scan(rows).where(F.size("found") > 0).select(F.col("key").alias("of"), "found").dropDuplicates(["of"])
    out = rows.withColumns(told_by({c: F.col(c) for c in columns}, "source", ("source", "lang"))).withColumn("filled", F.coalesce("text", F.lit("")))
    out = out.withColumn("of", row_key("doc_id", "filled", "owner", "repo")).join(found, "of", "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(
        "found", start,
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] >= a["at"], F.concat(a["out"], F.substring(F.col("text"), a["at"].cast("int") + 1, (x["start"] - a["at"]).cast("int")), F.lit(mask))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"].cast("int") + 1, F.length("text"))),
    )
    return out.withColumn("text", F.when(F.col("found").isNotNull(), masked).otherwise(F.col("text"))).withColumn(
        "n_chars", F.when(F.col("found").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*columns)
