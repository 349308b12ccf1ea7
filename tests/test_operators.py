"""Hand-computed ledgers and invariants of the risk operators."""

from __future__ import annotations

import hashlib
import hmac
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from riskgraph.engine import RiskEngine
from riskgraph.functions import grammar, text
from riskgraph.operators import cases, compliance, features, graph, intel, metrics, models, rules, shield, wide
from riskgraph.sources import readers
from riskgraph.streaming import decide

LEDGER = "txn_id string, ts_s long, src long, dst long, paise long, channel string, device string, ip string, ben_age long"
ACCOUNTS = "account long, kyc string, vintage_days long, age long, merchant boolean"
A, B, CC, BASE = 1, 2, 3, 1_700_000_000


@pytest.fixture(scope="module")
def accounts(spark):
    return spark.createDataFrame([(i, "FULL", 1000, 35, False) for i in (A, B, CC)], ACCOUNTS)


@pytest.fixture(scope="module")
def passthrough(spark):
    rows = [("t1", BASE, A, B, 1_000_000, "UPI", None, None, 0), ("t2", BASE + 600, B, CC, 600_000, "UPI", None, None, 0), ("t3", BASE + 1200, B, -1, 300_000, "ATM", None, None, 9999)]
    return spark.createDataFrame(rows, LEDGER)


def by_account(df):
    return {r.account: r for r in df.collect()}


def test_pass_through_ledger(passthrough, accounts):
    f = by_account(features.behaviour(passthrough, accounts))
    b = f[B]
    assert (b.in_paise, b.out_paise, b.passthrough, b.rapid_passthrough, b.cashout) == (1_000_000, 900_000, 0.9, 0.9, 0.3)
    assert (b.min_delay, b.payers, b.payees) == (10.0, 1, 1)
    assert f[A].in_paise == 0 and f[CC].out_paise == 0


def test_accounts_without_events_retain_all(spark, passthrough):
    idle = spark.createDataFrame([(i, "FULL", 1000, 35, False) for i in (A, 9)], ACCOUNTS)
    f = by_account(features.for_all(idle, features.flow_totals(features.event_view(passthrough, idle))))
    assert (f[9].retention, f[9].passthrough, f[9].in_count, f[A].retention) == (1.0, 0.0, 0, -5.0)
    assert by_account(features.behaviour(passthrough, idle))[9].retention == 1.0


def test_structuring_ledger(spark, accounts):
    rows = [(f"s{i}", BASE + 3600 * i, A, B, a * 100, "UPI", None, None, 9999) for i, a in enumerate((46_000, 47_500, 49_000, 12_000))]
    f = by_account(features.structuring(features.event_view(spark.createDataFrame(rows, LEDGER), accounts)))
    assert f[A].structuring_frac == 0.75


def test_ctr_by_calendar_day(spark):
    day = 86_400 * 20_000
    one = [(f"c{i}", day + 100 * i, A, -1, 25_000_000, "ATM", None, None, 9999) for i in range(5)]
    two = [("m1", day - 60, B, -1, 60_000_000, "ATM", None, None, 9999), ("m2", day + 60, B, -1, 60_000_000, "ATM", None, None, 9999)]
    assert [tuple(r) for r in compliance.ctr_candidates(spark.createDataFrame(one + two, LEDGER)).collect()] == [(A, 20_000, 125_000_000, 5)]


def test_as_of_equals_truncation(passthrough, accounts):
    cut = passthrough.where(F.col("ts_s") <= BASE + 600)
    assert by_account(features.behaviour(passthrough, accounts, BASE + 600)) == by_account(features.behaviour(cut, accounts, BASE + 600))


def test_empty_ledger(spark, accounts):
    nothing = spark.createDataFrame([], LEDGER)
    assert all(r.in_count == 0 for r in features.behaviour(nothing, accounts).collect())
    assert graph.graph_edges(nothing, accounts).count() == 0


@pytest.mark.parametrize(("score", "band"), [(39.5, "LOW"), (40.0, "MEDIUM"), (64.5, "MEDIUM"), (84.5, "HIGH"), (85.0, "CRITICAL")])
def test_bands_have_no_gaps(spark, score, band):
    assert spark.range(1).select(rules.band(F.lit(score))).first()[0] == band


def test_hub_identifiers_make_no_edges(spark):
    rows = [(f"t{i}", BASE, i, -1, 1, "UPI", "D" if i < 3 else None, "HUB", 1) for i in range(30)]
    ledger, acc = spark.createDataFrame(rows, LEDGER), spark.createDataFrame([(i, "FULL", 1, 1, False) for i in range(30)], ACCOUNTS)
    assert graph.shared_identifier_edges(ledger, acc, "ip", 1.5).count() == 0
    assert graph.shared_identifier_edges(ledger, acc, "device", 6.0).count() == 6


def test_pagerank_sums_to_one(passthrough, accounts):
    ranks = graph.pagerank(accounts, graph.money_edges(graph.money(passthrough, accounts)), 40)
    assert sum(r.pagerank for r in ranks.collect()) == pytest.approx(1, abs=1e-6)


def test_paths_respect_time(passthrough, accounts):
    paths = graph.flow_paths(graph.money(passthrough, accounts), accounts).collect()
    assert sorted((p.accounts, p.hops, p.seconds) for p in paths) == [("1>2>3", 2, 600), ("2>3", 1, 0)]


def test_directives_floor_and_neighbours(spark):
    risk = spark.createDataFrame([(i, 10.0) for i in range(4)], "account long, risk double")
    orders = spark.createDataFrame([(1, 0, "LISTED", "0,x,", "{}"), (2, 0, "SANCTION", "3", "{}")], "feed_id long, ts_s long, kind string, entities string, payload string")
    near = spark.createDataFrame([(0, 1)], "src long, dst long")
    assert {r.account: r.risk for r in intel.apply_directives(risk, orders, near).collect()} == {0: 75.0, 1: 18.0, 2: 10.0, 3: 100.0}


def test_tickets_with_other_names(spark):
    raw = spark.createDataFrame([("A1", "1700000000", "v", ""), (None, "2023-11-14 22:13:20", None, "b")], "ack_no string, complaint_date string, complainant_account string, suspect_account string")
    assert [tuple(r) for r in intel.normalise_tickets(raw).collect()] == [("A1", 1_700_000_000, "v", "", "NCRP"), ("UNKNOWN", 1_700_000_000, None, "b", "NCRP")]


def test_metrics_by_hand(spark):
    s = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.8), (4, 0, 0.1)], "id long, label int, score double")
    assert metrics.roc_auc(s).first()[0] == 0.875
    assert metrics.average_precision(s).first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert tuple(metrics.confusion(s, (0.5,)).first()) == (0.5, 2, 1, 0, 1)


def test_token_is_an_hmac(spark):
    for key in (b"salt", b"k" * 100):
        got = spark.range(1).select(text.hmac_sha256(F.lit("ACC123é"), key)).first()[0]
        assert got == hmac.new(key, "ACC123é".encode(), hashlib.sha256).hexdigest()


def test_redaction_leaves_no_ends(spark):
    said = "card 4111 1111 1111 1111 mail a.b@x.com acct ACC1234567890 vpa someone@ybl ip 10.0.0.1 pan ABCDE1234F"
    got = spark.range(1).select(text.redact(F.lit(said))).first()[0]
    assert got == "card [CARD] mail [EMAIL] acct [ACCOUNT] vpa [VPA] ip [IP] pan [PAN]"


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1,234.50",), ("(2,000.00)",), ("n/a",), ("5%",), (None,)], "x string")
    assert [r[0] for r in df.select(text.to_number(F.col("x"))).collect()] == [1234.5, -2000.0, None, 5.0, None]
    assert dict(text.coerce_numeric(df, ["x"]).dtypes)["x"] == "double"


@pytest.mark.parametrize(("name", "want"), [("AVG_CI_CASH_CR_AMT_L7D", ("AVG", "CI", "CASH", "CR", "AMT", (7,))), ("D_TA_CI_UPI_XFER_DB_TXNS_7TO14DAYS_OCC", ("D_TA", "CI", "UPI_XFER", "DB", "TXN", (7, 14))), ("NON_CASH_CHQ_AMT_14_31D", ("RAW", None, "NON_CASH_CHQ", None, "AMT", (14, 31))), ("CUSTOMER_AGE", ("RAW", None, None, None, None, ()))])
def test_grammar(name, want):
    f = grammar.parse(name)
    assert (f.aggregation, f.inducer, f.channel, f.direction, f.measure, f.days) == want
    assert f.static == (name == "CUSTOMER_AGE")


def test_alignment_reports_drift(spark):
    df = spark.createDataFrame([("1.5", "x", 1)], "` A ` string, extra string, y int")
    out, report = wide.align(df, ["A", "B", "LEAK", "y"], target="y", leakage=("LEAK",))
    assert out.columns == ["A", "B", "y"] and tuple(out.first()) == (1.5, None, 1)
    assert report == {"missing": ["B"], "extra": ["extra"], "quarantined": []}


def test_audit_chain_finds_tampering(spark):
    entries = spark.createDataFrame([(i, f"t{i}", "a", "e", f"p{i}") for i in range(1, 6)], "seq long, at string, actor string, event string, payload string")
    stored = compliance.audit_chain(entries)
    assert compliance.verify_chain(stored, entries).count() == 0
    changed = entries.withColumn("payload", F.when(F.col("seq") == 3, "other").otherwise(F.col("payload")))
    assert {r.seq for r in compliance.verify_chain(stored, changed).collect()} == {3, 4}


def test_folds_are_disjoint_and_stable(spark):
    rows = spark.range(2000).withColumnRenamed("id", "account")
    one, two = by_account(models.folds(rows)), by_account(models.folds(rows.repartition(7)))
    assert one == two and {r.fold for r in one.values()} == {"train", "val", "fuse", "test"}


def test_fusion_never_falls_with_a_layer(spark):
    import random

    draw = random.Random(1)
    rows = [(i, int(i % 8 == 0), *(min(1.0, draw.random() * 0.6 + 0.4 * (i % 8 == 0)) for _ in models.LAYERS)) for i in range(400)]
    s = spark.createDataFrame(rows, "account long, label int, " + ", ".join(f"{x} double" for x in models.LAYERS))
    fused = models.fit_fusion(s)
    low = spark.createDataFrame([(1, 0.1, 0.1, 0.1, 0.1), (2, 0.9, 0.1, 0.1, 0.1), (3, 0.9, 0.9, 0.9, 0.9)], "account long, " + ", ".join(f"{x} double" for x in models.LAYERS))
    p = {r.account: r.prob for r in fused(low).collect()}
    assert p[1] <= p[2] + 1e-12 <= p[3] + 2e-12 and p[3] > p[1]


def test_cases_are_added_once(spark):
    alerts = spark.createDataFrame([(1, 90.0), (1, 90.0), (2, 50.0)], "alert_id long, risk double")
    first = cases.new_cases(alerts.limit(0), alerts)
    assert first.count() == 2 and cases.new_cases(first, alerts).count() == 0


def test_cases_change_by_the_book(spark):
    events = spark.createDataFrame([(1, 1, "OPEN", "x"), (2, 2, "CONFIRMED", "x"), (3, 3, "ASSIGNED", "x")], "alert_id long, seq long, status string, actor string")
    asked = [(1, 10, "ASSIGNED", "a", None), (1, 11, "CONFIRMED", "a", None), (2, 12, "OPEN", "a", None), (3, 13, None, "a", "call back"), (9, 14, "OPEN", "a", None)]
    added, refused = cases.apply_changes(events, spark.createDataFrame(asked, "alert_id long, seq long, status string, actor string, note string"))
    assert sorted((r.alert_id, r.status, r.status_before) for r in added.collect()) == [(1, "ASSIGNED", "OPEN"), (3, "ASSIGNED", "ASSIGNED")]
    assert sorted(r.seq for r in refused.collect()) == [11, 12, 14]


def test_a_log_is_read_back(spark, tmp_path):
    entries = spark.createDataFrame([(i, f"t{i}", "a", "e", f"p{i}") for i in range(5)], "seq long, at string, actor string, event string, payload string")
    stored = compliance.audit_chain(entries)
    compliance.append_log(stored.where("seq < 3"), str(tmp_path / "log"))
    compliance.append_log(stored.where("seq >= 3"), str(tmp_path / "log"))
    again = compliance.reload_log(spark, str(tmp_path / "log"), "seq long, at string, actor string, event string, payload_digest string, prev_hash string, entry_hash string")
    assert compliance.verify_chain(again, entries).count() == 0
    head = compliance.chain_head(again).first()
    assert head.entries == 5 and head["head"] == stored.where("seq = 4").first().entry_hash
    assert [r.seq for r in compliance.chain_tail(again, 2).collect()] == [4, 3] and compliance.chain_head(again.limit(0)).first()["head"] == "0" * 64


def test_payloads_digest_alike_whatever_their_order(spark):
    one = spark.sql("select 1L seq, 't' at, 'a' actor, 'e' event, named_struct('b', 2, 'a', 1) payload")
    two = spark.sql("select 1L seq, 't' at, 'a' actor, 'e' event, named_struct('a', 1, 'b', 2) payload")
    assert compliance.bodies(one).first().body == compliance.bodies(two).first().body
    assert compliance.bodies(spark.sql("select 1L seq, 't' at, 'a' actor, 'e' event, map('b', 2, 'a', 1) payload")).first().payload_digest == compliance.bodies(one).first().payload_digest


def test_intelligence_layer_and_model_files(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame([(i, int(i % 5 == 0), float(i % 5 == 0) * 3 + i % 2, i % 5 != 4, "train") for i in range(100)], "account long, label int, tickets double, has_intelligence boolean, fold string")
    told = {r.account: r.intel for r in models.intel_layer(rows, ["tickets"])(rows).collect()}
    assert told[4] == 0.0 and told[0] > 0.5 > told[1] and models.intel_layer(rows.where("label = 0"), ["tickets"])(rows).where("intel > 0").count() == 0
    vectors = VectorAssembler(inputCols=["tickets"], outputCol="features").transform(rows)
    model = LogisticRegression().fit(vectors)
    models.save(model, str(tmp_path / "m"))
    assert LogisticRegressionModel.load(str(tmp_path / "m")).coefficients == model.coefficients


def test_narratives_and_filings(spark):
    from riskgraph.operators import explain

    reasons = spark.createDataFrame([(1, "cashout", 0.9, 0.95), (1, "night_frac", 0.05, 0.4), (1, "unknown", 9.0, 1.0), (2, "night_frac", -1.0, 0.2)], "account long, feature string, contribution double, value double")
    known = spark.createDataFrame([(1, 0.6, 4, "R1", 500_000), (2, 0.2, None, None, None)], "account long, graph double, ring_size long, ring_id string, ring_paise long")
    found = explain.evidence(known, reasons)
    assert {r.account: [(e.code, e.severity) for e in r.evidence] for r in found.collect()} == {1: [("CASH_OUT", "HIGH"), ("RING_MEMBERSHIP", "HIGH"), ("OFF_HOURS", "INFO")], 2: []}
    rows = found.join(known, "account").withColumn("risk", F.when(F.col("account") == 1, 91.0).otherwise(10.0))
    said = {r.account: r.narrative for r in explain.narrative(rows).collect()}
    assert "95%" in said[1] and "R1" in said[1] and "CRITICAL" in said[1] and "No indicator" in said[2]
    ledger = spark.createDataFrame([("t1", 5, 1, 7, 100, "UPI"), ("t2", 6, 8, 1, 50, "UPI"), ("t3", 7, 8, 9, 1, "UPI")], "txn_id string, ts_s long, src long, dst long, paise long, channel string")
    alerts = rows.where("account = 1").join(explain.narrative(rows), "account")
    filed = explain.filings(alerts, ledger, 1000).first()
    import json

    report = json.loads(filed.report)
    assert filed.due_s == 1000 + 7 * 86400 and report["transactions"]["count"] == 2 and [t["direction"] for t in report["transactions"]["detail"]] == ["CREDIT", "DEBIT"]
    bare = spark.createDataFrame([(None, None, 0, "{}")], "account long, reference string, due_s long, report string")
    texts = [r.text.split("\n") for r in explain.filing_texts(explain.filings(alerts, ledger, 1000).union(bare)).orderBy("account").collect()]
    assert texts[1][0] == "Draft report STR-1 (DRAFT_PENDING_HUMAN_REVIEW)" and texts[1][6].startswith("1. CASH_OUT: ") and "Transactions: 2, INR 1.50" in texts[1]
    assert texts[0][0] == "Draft report  ()" and "Transactions: , INR " in texts[0]


def test_folds_share_positives(spark):
    rows = spark.range(2000).select(F.col("id").alias("account"), (F.col("id") % 50 == 0).cast("int").alias("label"))
    sizes = {r.fold: r.n for r in models.folds(rows).where("label = 1").groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 20, "val": 6, "fuse": 6, "test": 8} and models.folds(rows).count() == 2000


def test_actions_expire_and_revert(spark):
    log = spark.createDataFrame([(1, 1, 0, 100, "FREEZE_DEBIT"), (2, 2, 0, None, "FULL_FREEZE"), (3, 3, 0, 10, "STEP_UP"), (2, 4, 5, None, "REVERT"), (4, 5, 0, None, "MONITOR")], "account long, seq long, taken_at long, ttl long, action string")
    assert {r.account for r in cases.active_actions(log, 50).collect()} == {1}


def test_freeze_budget():
    out, recent = decide.grant([(i, i, "FULL_FREEZE") for i in range(5)] + [(4000, 9, "FULL_FREEZE"), (2, 10, "STEP_UP")], [], 3)
    assert [ok for *_, ok in out] == [True, True, True, True, False, False, True] and recent == [4000]


def manifest(strings: list[str]) -> bytes:
    data, at = b"", []
    for s in strings:
        at.append(len(data))
        data += struct.pack("<H", len(s)) + s.encode("utf-16-le") + b"\0\0"
    begin = 28 + 4 * len(strings)
    return b"\x03\x00\x08\x00\0\0\0\0" + b"\x01\x00\x1c\x00" + struct.pack("<IIIIII", begin + len(data), len(strings), 0, 0, begin, 0) + b"".join(struct.pack("<I", x) for x in at) + data


def test_package_triage(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("AndroidManifest.xml", manifest(["", "com.evil.app", "android.permission.RECEIVE_SMS", "android.permission.SYSTEM_ALERT_WINDOW"]))
        z.writestr("classes.dex", b"x mule99@ybl http://1.2.3.4/c2 10.0.0.1 999.1.1.1")
    files = spark.createDataFrame([("a.apk", bytearray(buffer.getvalue())), ("b.apk", bytearray(b"not a zip"))], "path string, content binary")
    got = {r.path: r for r in shield.score(shield.triage(files)).collect()}
    assert got["a.apk"].package == "com.evil.app" and got["a.apk"].vpas == ["mule99@ybl"] and got["a.apk"].ips == ["1.2.3.4", "10.0.0.1"]
    # RECEIVE_SMS, overlay, both together, one payment address, two addresses, no signature
    assert got["a.apk"].score == 8 + 8 + 14 + (6 + 2) + 4 + 6 and got["a.apk"].verdict == "MEDIUM" and got["b.apk"].error and got["b.apk"].score == 0
    told = {(r.kind, r.value): (r.confidence, r.family) for r in shield.indicators(shield.score(shield.triage(files))).collect()}
    assert told[("UPI_VPA", "mule99@ybl")] == (0.72 + 0.06 + 0.03, "OverlayPhish.UPI") and told[("IP", "1.2.3.4")][0] == 0.59
    assert {k for k, _ in told} == {"UPI_VPA", "IP", "URL", "SHA256"}


def test_accounts_need_a_bank_beside_them(spark):
    rows = spark.createDataFrame([("pay 12345678901 at HDFC0ABCDEF",), ("order 12345678901",), ("mail a.person@gmail to 12345678901",), ("me.too@okaxis 123456789012",)], "x string")
    assert [r[0] for r in rows.select(text.mine(F.col("x"), "account")).collect()] == [["12345678901"], [], [], ["123456789012"]]
    assert [r[0] for r in rows.select(text.mine(F.col("x"), "vpa")).collect()] == [[], [], [], ["me.too@okaxis"]]


def test_families_keep_what_tells_them_apart():
    names = ["AVG_CASH_CR_AMT_L7D", "AVG_MM_CASH_CR_AMT_L7D", "AVG_CASH_CR_AMT_7D_OCC", "AVG_CI_CASH_CR_AMT_L7D", "AVG_CASH_CR_AMT_L31D"]
    assert [grammar.parse(n).family for n in names] == ["AVG_CASH_CR_AMT", "AVG_MM_CASH_CR_AMT", "AVG_CASH_CR_AMT_OCC", "AVG_CI_CASH_CR_AMT", "AVG_CASH_CR_AMT"]
    assert len(wide.families(names)["AVG_CASH_CR_AMT"]) == 2


def test_read_any(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    assert [tuple(r) for r in readers.read_any(spark, str(tmp_path / "a.tsv")).collect()] == [("1", "2")]


def test_engine_end_to_end(passthrough, accounts):
    engine = RiskEngine(passthrough, accounts)
    assert engine.ingest(passthrough).ledger.count() == 3
    scores = engine.score_all()
    assert {r.band for r in scores.collect()} <= {"LOW", "MEDIUM", "HIGH", "CRITICAL"}
    assert engine.score_transactions(passthrough, scores).count() == 3


def brute_shapley(found, row):
    """Attributions of one row by all subsets of all features."""
    import itertools
    import math

    def worth(known):
        return sum(leaf.value * math.prod(float(low < row[f] <= high) if f in known else share for f, (low, high, share) in leaf.ways.items()) for leaf in found)

    n, out = len(row), []
    for f in range(n):
        rest = [x for x in range(n) if x != f]
        out.append(sum(math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (worth({*s, f}) - worth(set(s))) for k in range(n) for s in itertools.combinations(rest, k)))
    return out


def test_attributions_are_shapley_values(spark):
    import random

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from riskgraph.operators import attribution

    draw = random.Random(4)
    made = [(i, *(draw.random() for _ in range(4))) for i in range(200)]
    rows = spark.createDataFrame([(*r, int(r[1] + r[2] * r[3] > 0.9), 1.0) for r in made], "account long, a double, b double, c double, d double, label int, weight double")
    names = ["a", "b", "c", "d"]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = models.boosted(5).fit(vectors)
    found = attribution.leaves(model)
    got = {}
    for r in attribution.attributions(rows, model, names).collect():
        got.setdefault(r.account, {})[r.feature] = r.contribution
    prob = {r.account: r.p for r in model.transform(vectors).select("account", vector_to_array("probability")[1].alias("p")).collect()}
    import math

    for r in made[:60]:
        assert [got[r[0]][n] for n in names] == pytest.approx(brute_shapley(found, r[1:]), abs=1e-9)
        assert 1 / (1 + math.exp(-sum(got[r[0]].values()) - attribution.base_value(found))) == pytest.approx(prob[r[0]], abs=1e-9)


def test_a_trained_engine_scores_explains_and_is_read_back(spark, tmp_path):
    import random

    draw = random.Random(2)
    people = [(i, "MIN" if i % 4 == 0 else "FULL", 30 + i, 20 + i % 50, False) for i in range(80)]
    moves = []
    for i in range(600):
        a, b = draw.randrange(80), draw.randrange(80)
        if a != b:
            moves.append((f"t{i}", 1_000_000 + i * 700, a, b, draw.randrange(1000, 500_000), "UPI", f"D{a}", f"I{a % 9}", 5))
    for k in range(0, 80, 4):  # every fourth account takes money in and sends it on at once
        for j in range(6):
            at = 1_100_000 + k * 900 + j * 60
            moves += [(f"in{k}-{j}", at, (k + 7 * j + 1) % 80, k, 9_000_000, "IMPS", None, None, 1), (f"out{k}-{j}", at + 20, k, -1, 8_900_000, "ATM", f"D{k}", None, 1)]
    ledger = spark.createDataFrame(moves, LEDGER)
    accounts = spark.createDataFrame(people, "account long, kyc string, vintage_days long, age long, merchant boolean")
    truth = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "account long, label int")
    engine = RiskEngine(ledger, accounts).train(truth, trees=5)
    scores = engine.score_all()
    got = {r.account: r for r in scores.collect()}
    assert len(got) == 80 and {"xgb", "graph", "temporal", "intel", "prob", "risk", "band"} <= set(scores.columns)
    assert sum(got[i].risk for i in range(0, 80, 4)) / 20 > sum(got[i].risk for i in range(80) if i % 4) / 60 + 30
    engine.save(str(tmp_path / "engine"))
    again = {r.account: r.risk for r in RiskEngine(ledger, accounts).load(str(tmp_path / "engine")).score_all().collect()}
    assert again == pytest.approx({a: r.risk for a, r in got.items()})
    told = engine.explain(scores, accounts.where("account = 0")).collect()
    assert len(told) == 1 and told[0].evidence and "Account 0" in told[0].narrative


def test_tables_go_out_and_come_back(spark, tmp_path):
    folder = str(tmp_path / "world")
    empty = {name: spark.createDataFrame([], schema) for name, schema in readers.SCHEMAS.items()}
    rings = spark.createDataFrame([("R1", "CHAIN", 3, "a,b,c", "a", "c", 5, False, True, 1.5, 1)], readers.SCHEMAS["rings"])
    readers.save_tables({k: v for k, v in empty.items() if k != "rings"}, folder, meta={"seed": 7, "days": 120})
    readers.save_tables({"rings": rings}, folder, "csv")
    back = readers.load_tables(spark, folder)
    assert set(back) == set(readers.SCHEMAS) and back["rings"].collect() == rings.collect() and back["iocs"].count() == 0
    assert readers.load_meta(spark, folder) == {"seed": 7, "days": 120}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.load_tables(spark, str(tmp_path / "nowhere"))


def test_dictionary_and_predictions(spark, tmp_path):
    (tmp_path / "names.csv").write_text("name,about\n AVG_CASH_CR_AMT_L7D ,x\nAGE,y\n,z\nAGE,again\n")
    assert readers.load_dictionary(spark, str(tmp_path / "names.csv")) == ["AVG_CASH_CR_AMT_L7D", "AGE"]
    scored = spark.createDataFrame([("k1", 0.7), ("k2", 0.2), ("k3", None)], "id string, prob double")
    readers.save_predictions(scored, str(tmp_path / "out"), ["id"])
    got = {r.id: r.pred for r in spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True).collect()}
    assert got == {"k1": 1, "k2": 0, "k3": None}


def test_rows_that_may_not_enter(spark):
    rows = [("a", 1, 2, 5, "UPI", 1), ("b", 1, 2, 0, "UPI", 1), ("c", None, 2, 5, "CASH", -1), ("d", 1, 2, None, None, None)]
    fine, out = intel.validated(spark.createDataFrame(rows, "txn_id string, src long, dst long, paise long, channel string, ben_age long"), ("UPI",))
    assert [r.txn_id for r in fine.collect()] == ["a"]
    assert {r.txn_id: r.reasons for r in out.collect()} == {"b": "AMOUNT", "c": "CHANNEL,PARTY,BENEFICIARY_AGE", "d": "AMOUNT,CHANNEL"}
