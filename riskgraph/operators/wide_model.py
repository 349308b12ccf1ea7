"""A model over a wide alert extract: which columns to use is settled by repeated cross-validation, then an ensemble is fitted."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from statistics import fmean, median, pstdev
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.operators import metrics, wide
from riskgraph.operators.graph import settled
from riskgraph.operators.models import gains, hash_share, ranked_share

# The ways to choose columns.
STRATEGIES = ("bank_finalized", "bank_plus_engineered", "auto_topk", "all")
#: Below any value of an extract: a tree can split what is missing from all that is there.
MISSING = -1e30
SCALARS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


class Settings(NamedTuple):
    """How many trees and folds. Trees are MLlib's and dearer than those of a library in one process, so they take fewer, larger steps."""

    trees: int = 60
    cv_trees: int = 40
    ranking_trees: int = 15
    depth: int = 4
    step: float = 0.1
    topk: int = 120
    splits: int = 5
    repeats: int = 3
    wide_repeats: int = 1
    wide_from: int = 800
    seeds: tuple[int, ...] = (42, 202, 1337)
    most_weight: float = 10.0
    strategies: tuple[str, ...] = STRATEGIES
    together: int = 4


class WideModel(NamedTuple):
    fitted: list
    columns: list[str]
    levels: dict[str, list[str]]
    threshold: float
    strategy: str
    report: dict


def levels_of(rows: DataFrame, names: list[str]) -> dict[str, list[str]]:
    """The sorted values of each text column, by which it is numbered; a text column of an extract is a category of few."""
    if not names:
        return {}
    found = rows.agg(*(F.array_sort(F.collect_set(f"`{c}`")).alias(c) for c in names)).first()
    return {c: list(found[c]) for c in names}


def encoded(df: DataFrame, columns: list[str], levels: dict[str, list[str]]) -> list[Column]:
    """The columns as doubles: categories by their place, what is null, absent, not finite or of no known level as MISSING."""
    out = []
    for c in columns:
        if c not in df.columns:
            value = F.lit(None).cast("double")
        elif c in levels:
            value = F.nullif(F.array_position(F.array(*map(F.lit, levels[c])).cast("array<string>"), F.col(f"`{c}`").cast("string")), F.lit(0)).cast("double")
        else:
            value = F.col(f"`{c}`").cast("double")
        out.append(F.when(F.isnan(value) | (F.abs(value) == float("inf")), MISSING).otherwise(F.coalesce(value, F.lit(MISSING))).alias(c))
    return out


def vectors(df: DataFrame, columns: list[str], levels: dict[str, list[str]], *keep: str) -> DataFrame:
    numbered = df.select(*keep, *(x.alias(f"_{i}") for i, x in enumerate(encoded(df, columns, levels))))
    return VectorAssembler(inputCols=[f"_{i}" for i in range(len(columns))], outputCol="features").transform(numbered).select(*keep, "features")


def _fit(rows: DataFrame, trees: int, depth: int, settings: Settings, seed: int, check: str | None = None):
    """Trees over (features, label); positives weigh as the root of how rare they are, up to a bound. check: rows that stop the fit."""
    n, pos = rows.agg(F.count("*"), F.sum("label")).first()
    weight = min(settings.most_weight, max(1.0, ((n - pos) / pos) ** 0.5)) if pos else 1.0
    learner = GBTClassifier(labelCol="label", weightCol="weight", maxDepth=depth, maxIter=trees, stepSize=settings.step, subsamplingRate=0.8, featureSubsetStrategy="0.3", minInstancesPerNode=2, seed=seed)
    if check:
        learner = learner.setValidationIndicatorCol(check)
    return learner.fit(rows.withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0)))


def _scores(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("id", F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))


def select(rows: DataFrame, columns: list[str], finalized: list[str], levels: dict[str, list[str]], strategy: str, settings: Settings, seed: int) -> list[str]:
    """The columns of a strategy; auto_topk ranks them by a shallow model of these rows alone, and keeps the finalized ones."""
    mine = [c for c in finalized if c in columns]
    if strategy == "bank_finalized":
        return mine or columns
    if strategy == "bank_plus_engineered":
        return list(dict.fromkeys([*mine, *wide.engineered(columns)])) or columns
    if strategy == "all":
        return columns
    ranked = gains(_fit(vectors(rows, columns, levels, "label"), settings.ranking_trees, 3, settings, seed), columns)
    best = [c for c, gain in ranked if gain > 0][: settings.topk]
    return list(dict.fromkeys([*best, *mine])) if best else columns


def in_folds(rows: DataFrame, splits: int, seed: int) -> DataFrame:
    """rows with k: as many folds with a like share of positives in each."""
    share = ranked_share(rows, F.col("label") == 1, "id", hash_share("id", seed))
    return share.withColumn("k", F.least(F.floor(F.col("share") * splits), F.lit(splits - 1)).cast("int")).drop("share")


def cross_validate(rows: DataFrame, columns: list[str], finalized: list[str], levels: dict[str, list[str]], strategy: str, settings: Settings = Settings()) -> dict:
    """Mean AUC and average precision of a strategy over folds and repeats; columns are chosen inside each fold, by its training rows."""
    is_wide = strategy == "all" or (strategy == "bank_plus_engineered" and len(columns) > settings.wide_from)
    dealt = [settled(in_folds(rows, settings.splits, 42 + r)) for r in range(settings.wide_repeats if is_wide else settings.repeats)]

    def one(job: tuple[int, int]) -> tuple[float | None, float | None, int]:
        seed = 42 + job[0] * settings.splits + job[1]
        train, test = (dealt[job[0]].where(condition) for condition in (F.col("k") != job[1], F.col("k") == job[1]))
        used = select(train, columns, finalized, levels, strategy, settings, seed)
        if test.select("label").distinct().count() < 2 or train.select("label").distinct().count() < 2:
            return None, None, len(used)
        scores = settled(_scores(_fit(vectors(train, used, levels, "label"), settings.cv_trees, settings.depth, settings, seed), vectors(test, used, levels, "id", "label")))
        return metrics.roc_auc(scores).first()[0], metrics.average_precision(scores).first()[0], len(used)

    with ThreadPoolExecutor(settings.together) as pool:
        each = list(pool.map(one, [(r, k) for r in range(len(dealt)) for k in range(settings.splits)]))
    aucs, precisions = ([float(x[i]) for x in each if x[i] is not None] for i in (0, 1))
    return {
        "strategy": strategy, "roc_auc": fmean(aucs) if aucs else 0.5, "roc_auc_std": pstdev(aucs) if aucs else 0.0,
        "pr_auc": fmean(precisions) if precisions else 0.0, "n_features": int(median(x[2] for x in each)), "fold_scores": aucs,
    }


def fit(df: DataFrame, finalized: list[str], id_column: str = "id", label: str = "label", settings: Settings = Settings()) -> WideModel:
    """The strategy of the best average precision (ties: AUC), refitted as an ensemble over seeds, with the threshold of the best F1.

    df: one row an alert, any numeric or text columns; those with fewer than two values are left out, columns of other types too.
    Rows of a null label don't count. A fifth of the rows, by fold, stops the fit and sets the threshold, 0.5 if one label is all there is.
    """
    typed = dict(df.dtypes)
    names = [c for c in df.columns if c not in (id_column, label) and (typed[c] in SCALARS or typed[c] == "string" or typed[c].startswith("decimal"))]
    rows = settled(df.where(F.col(label).isNotNull()).select(F.col(id_column).alias("id"), F.col(label).cast("double").alias("label"), *(f"`{c}`" for c in names)))
    columns = wide.live_columns(rows.select(*(f"`{c}`" for c in names)))
    levels = levels_of(rows, [c for c in columns if typed[c] == "string"])
    results = [cross_validate(rows, columns, finalized, levels, s, settings) for s in settings.strategies]
    strategy = max(results, key=lambda r: (r["pr_auc"], r["roc_auc"]))["strategy"]
    used = select(rows, columns, finalized, levels, strategy, settings, 42)
    dealt = settled(vectors(in_folds(rows, 5, 42).withColumn("held", F.col("k") == 0), used, levels, "id", "label", "held"))
    with ThreadPoolExecutor(settings.together) as pool:
        fitted = list(pool.map(lambda seed: _fit(dealt, settings.trees, settings.depth, settings, seed, "held"), settings.seeds))
    held = settled(_mean_scores(fitted, dealt.where("held"), "id", F.col("label").cast("int").alias("label")))
    threshold = float(metrics.best_f1(held).first().threshold) if held.select("label").distinct().count() == 2 else 0.5
    n, pos = rows.agg(F.count("*"), F.sum("label")).first()
    report = {
        "rows": n, "columns_seen": len(columns), "dead_columns_dropped": len(names) - len(columns), "positives": int(pos or 0), "base_rate": (pos or 0) / max(n, 1), "strategy": strategy,
        "n_features_used": len(used), "boosting_rounds": int(median(m.getNumTrees for m in fitted)), "threshold": threshold, "cv": results,
    }
    return WideModel(fitted, used, levels, threshold, strategy, report)


def _mean_scores(fitted: list, rows: DataFrame, *keep: str | Column) -> DataFrame:
    for i, model in enumerate(fitted):
        rows = model.transform(rows).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    return rows.select(*keep, (sum((F.col(f"_p{i}") for i in range(len(fitted))), F.lit(0.0)) / len(fitted)).alias("score"))


def predict(model: WideModel, df: DataFrame, id_column: str = "id", threshold: float | None = None) -> DataFrame:
    """id, score (mean of the ensemble), flagged; columns that df lacks count as missing."""
    scores = _mean_scores(model.fitted, vectors(df.withColumn("_id", F.col(id_column)), model.columns, model.levels, "_id"), F.col("_id").alias("id"))
    return scores.withColumn("flagged", F.col("score") >= (model.threshold if threshold is None else threshold))


def importance(model: WideModel, top: int = 30) -> list[tuple[str, float]]:
    """(column, share of gain) summed over the ensemble, largest first."""
    total: dict[str, float] = {}
    for one in model.fitted:
        for column, gain in gains(one, model.columns):
            total[column] = total.get(column, 0.0) + gain
    whole = sum(total.values())
    return sorted(((c, g / whole) for c, g in total.items() if g > 0), key=lambda x: (-x[1], x[0]))[:top] if whole else []


def evaluate(model: WideModel, df: DataFrame, id_column: str = "id", label: str = "label") -> dict:
    """AUC, average precision, F1 at the model's threshold, positives and flagged, over rows with a label."""
    known = df.where(F.col(label).isNotNull())
    rows = vectors(known.withColumns({"_id": F.col(id_column), "_label": F.col(label).cast("int")}), model.columns, model.levels, "_id", "_label")
    scores = settled(_mean_scores(model.fitted, rows, F.col("_id").alias("id"), F.col("_label").alias("label")).withColumn("flagged", F.col("score") >= model.threshold))
    hit, pos = F.col("flagged"), F.col("label") == 1
    tp, flagged, positives = scores.agg(F.count_if(hit & pos), F.count_if(hit), F.count_if(pos)).first()
    return {
        "roc_auc": float(metrics.roc_auc(scores).first()[0] or 0.0), "pr_auc": float(metrics.average_precision(scores).first()[0] or 0.0), "f1": 2 * tp / (flagged + positives) if flagged + positives else 0.0,
        "positives": positives, "flagged": flagged, "threshold": model.threshold,
    }
