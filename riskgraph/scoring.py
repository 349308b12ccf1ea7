"""Four learned layers and their fusion: fit on folds, score everyone, save and load."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.operators import features, graph, intel, models
from riskgraph.operators.graph import settled

#: Neighbours that a propagation round goes by, and rounds.
FAN_OUT, ROUNDS = 15, 2


def numeric(rows: DataFrame) -> DataFrame:
    """account and every other column as a number: kyc as marks, nulls, infinities and NaN as 0."""
    if "kyc" in rows.columns:
        rows = rows.withColumns({f"kyc_{k.lower()}": F.col("kyc") == k for k in ("MIN", "VIDEO")}).drop("kyc")
    values = {c: F.col(c).cast("double") for c in rows.columns if c != "account"}
    return rows.select("account", *(F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v).alias(c) for c, v in values.items()))


def neighbourhood(own: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """own (account, numbers) with the weighted means of its neighbours' and of their neighbours' numbers beside its own."""
    names = [c for c in own.columns if c != "account"]
    near = settled(graph.top_neighbours(edges, FAN_OUT))
    out, step = own, own
    for n in range(1, rounds + 1):
        step = settled(graph.propagate(near, step, names))
        out = out.join(step.select("account", *(F.col(c).alias(f"{c}_{n}") for c in names)), "account", "left")
    return out.na.fill(0.0)


def sequences(events: DataFrame) -> DataFrame:
    """account and the mean, deviation and latest of each number of its last events."""
    cells = []
    for c in ("dir", "paise", "gap", "novel", "vs_mean"):
        value = F.col(c).cast("double")
        cells += [F.avg(value).alias(f"{c}_mean"), F.stddev_pop(value).alias(f"{c}_sd"), F.max_by(value, "slot").alias(f"{c}_last")]
    return features.event_sequence(events).groupBy("account").agg(*cells)


def layer_inputs(ledger: DataFrame, accounts: DataFrame, tickets: DataFrame | None, indicators: DataFrame | None, directives: DataFrame | None, as_of: int | None) -> dict[str, DataFrame]:
    """What each layer sees of every account as it was known then, each written once."""
    spark = ledger.sparkSession
    held = features.as_of(ledger, as_of)
    now = as_of if as_of is not None else (held.agg(F.max("ts_s")).first()[0] or 0)
    own = settled(numeric(features.behaviour(ledger, accounts, as_of)))
    events = features.event_view(held, accounts)
    empty = {
        "tickets": "ticket_id long, arrival long, ts_s long, victim long, beneficiary long, paise long, category string", "indicators": "ioc_id long, kind string, value string, confidence double, ts_s long",
        "directives": "feed_id long, ts_s long, kind string, entities string, payload string",
    }
    tickets, indicators, directives = (spark.createDataFrame([], empty[n]) if x is None else x for n, x in (("tickets", tickets), ("indicators", indicators), ("directives", directives)))
    known = intel.intel_features(accounts, tickets, indicators, directives, now)
    return {
        "xgb": own, "graph": settled(neighbourhood(own, graph.graph_edges(held, accounts))), "temporal": settled(numeric(accounts.select("account").join(sequences(events), "account", "left"))),
        "intel": settled(numeric(known.drop("has_intelligence")).join(known.select("account", "has_intelligence"), "account")),
    }


class Scorer:
    """Fitted layers: boosted trees over behaviour; balanced logistic regressions over neighbourhoods, over event sequences and over
    intelligence (0 without any); stacked with weights of 0 or more and calibrated. Without both labels in the folds that fit,
    layers score 0 and the fixed blend is used."""

    def __init__(self, layers: dict[str, PipelineModel], stack: LogisticRegressionModel | None, calibrated: IsotonicRegressionModel | None) -> None:
        self.layers, self.stack, self.calibrated = layers, stack, calibrated

    def layer_scores(self, inputs: dict[str, DataFrame]) -> DataFrame:
        """account and a score of 0 to 1 for each layer."""
        out = inputs["xgb"].select("account")
        for name in models.LAYERS:
            if name in self.layers:
                scored = self.layers[name].transform(inputs[name]).withColumn(name, vector_to_array("probability")[1])
                if name == "intel":
                    scored = scored.withColumn(name, F.when(F.col("has_intelligence"), F.col(name)).otherwise(0.0))
                out = out.join(scored.select("account", name), "account", "left")
            else:
                out = out.withColumn(name, F.lit(0.0))
        return out.na.fill(0.0)

    def fused(self, scores: DataFrame) -> DataFrame:
        """account, prob and risk of layer scores."""
        if self.stack is None:
            return models.prior_blend(scores)
        raw = self.stack.transform(models.stacked(scores)).withColumn("raw", vector_to_array("probability")[1]).drop("prediction", "probability", "rawPrediction")
        prob = 0.98 * F.col("prediction") + 0.02 * F.col("raw")
        return self.calibrated.transform(raw).select("account", prob.alias("prob"), models.warp(prob).alias("risk"))

    def save(self, path: str) -> None:
        """All models in folders of path, which executors and driver share."""
        for name, layer in self.layers.items():
            layer.write().overwrite().save(f"{path}/{name}")
        if self.stack is not None:
            self.stack.write().overwrite().save(f"{path}/stack")
            self.calibrated.write().overwrite().save(f"{path}/calibrated")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(",".join(self.layers), self.stack is not None)], "layers string, fused boolean").write.mode("overwrite").json(f"{path}/parts")

    @staticmethod
    def load(path: str) -> Scorer:
        parts = SparkSession.getActiveSession().read.schema("layers string, fused boolean").json(f"{path}/parts").first()
        layers = {n: PipelineModel.load(f"{path}/{n}") for n in parts.layers.split(",") if n}
        return Scorer(layers, *((LogisticRegressionModel.load(f"{path}/stack"), IsotonicRegressionModel.load(f"{path}/calibrated")) if parts.fused else (None, None)))


def fit(inputs: dict[str, DataFrame], truth: DataFrame, trees: int = 150) -> Scorer:
    """Layers fitted on the train fold, fusion on the fuse fold of truth (account, label), which are dealt by models.folds()."""
    folds = settled(models.folds(truth.select("account", F.col("label").cast("int").alias("label"))))
    layers: dict[str, PipelineModel] = {}
    for name in models.LAYERS:
        rows = inputs[name].join(folds.where("fold = 'train'"), "account")
        n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        if not 0 < pos < n:
            continue
        columns = [c for c, kind in inputs[name].dtypes if c not in ("account", "has_intelligence")]
        balance = F.when(F.col("label") == 1, F.lit(5.0 if name == "xgb" else n / (2.0 * pos))).otherwise(F.lit(1.0 if name == "xgb" else n / (2.0 * (n - pos))))
        vector = VectorAssembler(inputCols=columns, outputCol="features")
        if name == "xgb":
            stages = [vector, models.boosted(trees)]
        else:
            stages = [vector, StandardScaler(inputCol="features", outputCol="scaled"), LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", regParam=0.01, maxIter=200)]
        layers[name] = Pipeline(stages=stages).fit(settled(rows.withColumn("weight", balance)))
    scorer = Scorer(layers, None, None)
    held = settled(scorer.layer_scores(inputs).join(folds.where("fold = 'fuse'").select("account", "label"), "account"))
    n, pos = held.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if layers and 0 < pos < n:
        rows = models.stacked(held).withColumn("weight", F.when(F.col("label") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos))))
        bounds = Matrices.dense(1, len(models.LAYERS) + 1, [0.0] * (len(models.LAYERS) + 1))
        scorer.stack = LogisticRegression(featuresCol="z", labelCol="label", weightCol="weight", regParam=0.02, maxIter=200, standardization=False, lowerBoundsOnCoefficients=bounds).fit(rows)
        raw = scorer.stack.transform(rows).withColumn("raw", vector_to_array("probability")[1]).drop("prediction", "probability", "rawPrediction")
        scorer.calibrated = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw)
    return scorer
