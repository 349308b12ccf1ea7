"""The model over wide extracts: planted signal, nulls, categories, dead columns, columns that are missing when it scores."""

from __future__ import annotations

import random

from riskgraph.operators import wide_model as W

SMALL = W.Settings(trees=3, cv_trees=2, ranking_trees=2, depth=2, step=0.5, topk=2, splits=2, repeats=1, seeds=(1, 2), strategies=("bank_finalized", "auto_topk"))


def test_wide_model(spark):
    draw = random.Random(1)
    rows = []
    for i in range(240):
        y = int(i % 6 == 0)
        signal = None if i % 40 == 7 else y * 4.0 + draw.random()
        rows.append((i, y, draw.random(), signal, ("x", "y", None)[i % 3], 1.0, draw.random()))
    df = spark.createDataFrame(rows, "id long, label int, noise double, BX_signal double, kind string, dead double, other double")
    model = W.fit(df, ["noise"], settings=SMALL)
    assert model.strategy == "auto_topk" and model.report["dead_columns_dropped"] == 1 and model.levels == {"kind": ["x", "y"]}
    assert "BX_signal" in model.columns and "noise" in model.columns
    assert W.importance(model)[0][0] == "BX_signal"
    told = W.evaluate(model, df)
    assert told["roc_auc"] > 0.95 and told["f1"] > 0.9 and told["positives"] == 40
    assert {r["strategy"]: r["pr_auc"] > 0.6 for r in model.report["cv"]} == {"bank_finalized": False, "auto_topk": True}
    bare = W.predict(model, df.select("id", "noise"))
    assert bare.count() == 240 and bare.where("score is null").count() == 0


def test_choice_of_columns(spark):
    columns = ["a", "BX_b", "c"]
    assert W.select(None, columns, ["c", "gone"], {}, "bank_finalized", SMALL, 1) == ["c"]
    assert W.select(None, columns, [], {}, "bank_finalized", SMALL, 1) == columns
    assert W.select(None, columns, ["c"], {}, "bank_plus_engineered", SMALL, 1) == ["c", "BX_b"]
    assert W.select(None, columns, ["c"], {}, "all", SMALL, 1) == columns


def test_encoding_of_odd_values(spark):
    df = spark.createDataFrame([("x", float("nan")), ("new", float("inf")), (None, None), ("y", 2.0)], "kind string, v double")
    got = [tuple(r) for r in df.select(*W.encoded(df, ["kind", "v", "absent"], {"kind": ["x", "y"]})).collect()]
    assert got == [(1.0, W.MISSING, W.MISSING), (W.MISSING, W.MISSING, W.MISSING), (W.MISSING, W.MISSING, W.MISSING), (2.0, 2.0, W.MISSING)]
