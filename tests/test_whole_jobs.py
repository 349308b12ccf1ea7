"""Queries and operators against brute force, where they once did less than the whole job."""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
import statistics
import zipfile
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pytest

from riskgraph.operators import compliance, graph, metrics, rings, shield
from riskgraph.plans import graph_queries, model_queries

ACCOUNTS = "account long, kyc string, vintage_days long, age long, merchant boolean"
TRANSFERS = "src long, dst long, paise long, ts_s long, txn_id string"


@pytest.fixture(scope="module")
def transfers():
    """300 transfers among accounts 1 to 20; 20 only receives."""
    draw = random.Random(5)
    rows = []
    for i in range(300):
        src = draw.randrange(1, 20)
        dst = draw.choice([a for a in range(1, 21) if a != src])
        rows.append((src, dst, draw.randrange(100, 10_000_000), draw.randrange(2_000_000), f"t{i}"))
    return rows


@pytest.fixture
def small_world(spark, transfers, monkeypatch):
    accounts = spark.createDataFrame([(i, "FULL", 1, 30, False) for i in range(1, 23)], ACCOUNTS)
    monkeypatch.setattr(graph_queries.S, "read_accounts", lambda *_: accounts)
    monkeypatch.setattr(graph_queries, "transfers_of", lambda *_: spark.createDataFrame(transfers, TRANSFERS))


def trails(transfers, hops=4, seconds=48 * 3600, fan_out=3):
    """txns and gaps of every trail that ends, walked depth first."""
    out, stack = {}, [(a, (a,), None, (), ()) for a in range(1, 23)]
    while stack:
        at, seen, when, txns, gaps = stack.pop()
        on = [t for t in transfers if t[0] == at and (when is None or when < t[3] <= when + seconds)] if len(txns) < hops else []
        if not on and txns:
            out[">".join(txns)] = statistics.median(gaps) if gaps else 0.0
        for t in sorted(on, key=lambda t: (-t[2], t[3], t[4]))[:fan_out]:
            if t[1] not in seen:
                stack.append((t[1], (*seen, t[1]), t[3], (*txns, t[4]), (*gaps, t[3] - when) if when is not None else ()))
    return out


def test_flow_paths_from_every_account(spark, small_world, transfers):
    starts, moved = spark.range(1, 23).withColumnRenamed("id", "account"), spark.createDataFrame(transfers, TRANSFERS)
    got = graph.flow_paths(moved, starts, most=None).collect()
    assert {r.hops for r in got} == {1, 2, 3, 4} and {r.start for r in got} == {t[0] for t in transfers}
    assert {r.txns: r.median_gap for r in got} == trails(transfers)
    # a report has the largest 25 of a start
    by_start, capped = defaultdict(list), defaultdict(list)
    for r in got:
        by_start[r.start].append((-r.paise, r.txns))
    for r in graph_queries.flow_paths(spark, "").collect():
        capped[r.start].append((-r.paise, r.txns))
    assert {k: sorted(v) for k, v in capped.items()} == {k: sorted(v)[:25] for k, v in by_start.items()}


def test_flows_backward(spark, transfers):
    """Where money came from: the same as forward, with parties and time turned round."""
    turned = [(d, s, p, 2_000_000 - t, i) for s, d, p, t, i in transfers]
    moved = spark.createDataFrame(transfers, TRANSFERS)
    got = graph.flow_paths(moved, spark.range(1, 23).withColumnRenamed("id", "account"), most=None, backward=True).collect()
    assert {r.txns: r.median_gap for r in got} == trails(turned)


def ranks(edges: list[tuple[int, int, int]], nodes: int = 22, steps: int = 40) -> dict[int, float]:
    """PageRank by plain power iteration, weights summed transfer by transfer; accounts without transfers out spread theirs."""
    out = {a: 0.0 for a in range(1, nodes + 1)}
    for s, _, p in edges:
        out[s] += math.log1p(p / 100)
    r = dict.fromkeys(out, 1 / nodes)
    for _ in range(steps):
        after = dict.fromkeys(out, 0.15 / nodes + 0.85 * sum(r[a] for a in out if not out[a]) / nodes)
        for s, d, p in edges:
            after[d] += 0.85 * r[s] * math.log1p(p / 100) / out[s]
        moved, r = sum(abs(after[a] - r[a]) for a in out), after
        if moved < 1e-10:
            break
    return r


@pytest.mark.parametrize(("query", "back"), [("pagerank", False), ("reverse_pagerank", True)])
def test_ranks_settle(spark, small_world, transfers, query, back):
    want = ranks([(d, s, p) if back else (s, d, p) for s, d, p, *_ in transfers])
    got = {r.account: r.pagerank for r in getattr(graph_queries, query)(spark, "").collect()}
    assert got == pytest.approx(want, abs=2e-9)


def partitions(items: list[int]) -> Iterator[list[list[int]]]:
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i, part in enumerate(rest):
            yield [*rest[:i], [items[0], *part], *rest[i + 1 :]]


def modularity(frame: pd.DataFrame, parts: list[list[int]], resolution: float) -> float:
    degree, total = {}, 2 * frame.weight.sum()
    for s, d, w in frame.itertuples(index=False):
        degree[s], degree[d] = degree.get(s, 0) + w, degree.get(d, 0) + w
    own = sum(2 * frame[frame.src.isin(p) & frame.dst.isin(p)].weight.sum() / total for p in parts)
    return own - resolution * sum((sum(degree[a] for a in p) / total) ** 2 for p in parts)


def grouped(home: dict[int, int]) -> list[list[int]]:
    return [[a for a in home if home[a] == c] for c in sorted(set(home.values()))]


@pytest.mark.parametrize("seed", range(3))
def test_communities_reach_the_best_partition(seed):
    """Louvain need not, but does on these; moves of single accounts alone do not."""
    draw = random.Random(seed)
    pairs = [(s, d) for s in range(7) for d in range(s + 1, 7) if draw.random() < 0.5]
    frame = pd.DataFrame([(s, d, float(draw.randrange(1, 10))) for s, d in pairs], columns=["src", "dst", "weight"])
    best = max(modularity(frame, p, 1.0) for p in partitions(sorted({*frame.src, *frame.dst})))
    assert modularity(frame, grouped(rings.communities(frame, 1.0)), 1.0) == pytest.approx(best)


def test_planted_rings(spark):
    """40 triangles in one long chain, and apart from them three flagged accounts with three unflagged device neighbours."""
    edges = [(3 * k + i, 3 * k + j, 6.0, "DEVICE") for k in range(40) for i, j in ((0, 1), (0, 2), (1, 2))]
    edges += [(3 * k + 2, 3 * k + 3, 1.0, "MONEY") for k in range(39)]
    edges += [(i, j, 6.0, "DEVICE") for i in range(200, 206) for j in range(i + 1, 206)]
    risk = [(a, 60.0 + a % 7) for a in range(120)] + [(a, 60.0 if a < 203 else 5.0) for a in range(200, 206)]
    found = rings.detect_rings(spark.createDataFrame(edges, "src long, dst long, weight double, kind string"), spark.createDataFrame(risk, "account long, risk double"))
    got = {r.members: r for r in found.collect()}
    assert set(got) == {f"{3 * k},{3 * k + 1},{3 * k + 2}" for k in range(40)} | {"200,201,202"}
    mixed = got["200,201,202"]
    assert (mixed.size, mixed.associated, mixed.mean_risk, mixed.max_risk, mixed.density, mixed.typology) == (3, "203,204,205", 60.0, 60.0, 1.0, "MULE_CLUSTER")
    assert {r.account: r.ring for r in rings.ring_of(found).collect()}[202] == mixed.ring


def test_what_a_ring_moves(spark):
    """A star of six: one collects from four and passes it on to one outside, and two of them share a device."""
    edges = [(0, i, 5.0, "MONEY") for i in range(1, 6)]
    risk = [(a, 80.0) for a in range(6)] + [(50, 1.0)]
    moved = [(i, 0, 1000 * i, 10 + i, f"t{i}") for i in range(1, 5)] + [(0, 5, 100, 20, "t5"), (0, 50, 9000, 21, "t6")]
    used = [(1, "d1"), (2, "d1"), (3, "d3"), (1, "d1")]
    edge_frame, risk_frame, moved_frame = (spark.createDataFrame(rows, schema) for rows, schema in ((edges, "src long, dst long, weight double, kind string"), (risk, "account long, risk double"), (moved, TRANSFERS)))
    found = rings.detect_rings(edge_frame, risk_frame, moved_frame, spark.createDataFrame(used, "account long, device string"), resolution=0.5).collect()
    assert [(r.size, r.paise, r.shared_devices, r.typology) for r in found] == [(6, 10_100, "d1", "DEVICE_FARM")]
    assert found[0].collectors.split(",")[0] == "0" and found[0].cashouts.split(",") == ["4", "3", "2"]
    without = rings.detect_rings(edge_frame, risk_frame, moved_frame, resolution=0.5).collect()
    assert [r.typology for r in without] == ["FAN_IN_AGGREGATION"]


@pytest.mark.parametrize("rows_per_range", [4, 1_000_000])
def test_audit_chain_over_gaps(spark, rows_per_range):
    """Every entry commits to all before it, whatever seq skips, and across ranges."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    seqs = [1, 2, 5, 6, 9, 20, 21, 22, 40, 41, 77]
    entries = spark.createDataFrame([(i, f"t{i}", "a", "e", f"p{i}") for i in reversed(seqs)], "seq long, at string, actor string, event string, payload string")
    want, last = {}, "0" * 64
    for i in seqs:
        want[i] = (last, last := sha(f"{i}|t{i}|a|e|{sha(f'p{i}')}|{last}"))
    stored = compliance.audit_chain(entries, rows_per_range=rows_per_range)
    assert {r.seq: (r.prev_hash, r.entry_hash) for r in stored.collect()} == want
    assert compliance.verify_chain(stored, entries).count() == 0
    assert {r.seq for r in compliance.verify_chain(stored.where("seq <> 9"), entries).collect()} == {9, 20}


def test_large_dex_is_scanned():
    """Two files of which the first alone is over 48 MB."""
    filler = b"\0" * (49 << 20)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("classes.dex", b"early@ybl " + filler + b" late@ybl http://evil.example/c2 8.8.4.4 libjiagu")
        z.writestr("classes2.dex", b"second@ybl")
    got = shield.triage_bytes(buffer.getvalue())
    assert (got["vpas"], got["urls"], got["ips"], got["packed"]) == (["early@ybl", "late@ybl", "second@ybl"], ["http://evil.example/c2"], ["8.8.4.4"], True)


@pytest.mark.parametrize("window", [1, 700, 1500, 5000])
def test_windows_find_what_one_scan_finds(window):
    draw = random.Random(window)
    said = ["mule.{}@okbank", "http://h{}.example/a?b=" + "c" * 190, "10.{}.3.4", "x" * 90 + "{}@ybl", "\0", " ", "-", "@", "é", "{}.1.2.3.4.5", "Lcom/a{};", "La;"]
    data = "".join(draw.choice(said).format(draw.randrange(256)) + draw.choice(["", " ", "\0"]) for _ in range(600)).encode("latin-1")
    found, names = {kind: set() for kind in shield.PATTERNS}, Counter()
    shield.mine(io.BytesIO(data), found, window, names)
    assert names["all"] == len(re.findall(shield.NAME, data.decode("latin-1"))) > 0
    assert found == {kind: set(re.findall(p, data.decode("latin-1"))) for kind, p in shield.PATTERNS.items()}


def test_seed_risk_fits_the_production_model(spark, monkeypatch):
    """Trees and features as registered; the fit itself is tried with one tree."""
    accounts = spark.createDataFrame([(i, ("MIN", "FULL", "VIDEO")[i % 3], 10 * i, 30, i % 2 == 0) for i in range(60)], ACCOUNTS)
    rows = [(f"t{i}", 1_700_000_000 + 977 * i, i % 60, i * 7 % 60, 100 * i + 1, "UPI", None, None, 5) for i in range(400)]
    ledger = spark.createDataFrame(rows, "txn_id string, ts_s long, src long, dst long, paise long, channel string, device string, ip string, ben_age long")
    monkeypatch.setattr(model_queries.S, "read_accounts", lambda *_: accounts)
    monkeypatch.setattr(model_queries.S, "read_ledger", lambda *_: ledger)
    asked, fit = {}, model_queries.models.cross_fitted

    def cross_fitted(rows, features, trees):
        asked.update(features=features, trees=trees)
        return fit(rows, features, trees=1)

    monkeypatch.setattr(model_queries.models, "cross_fitted", cross_fitted)
    assert model_queries.seed_risk(spark, "").count() == 60
    behaviour = set(model_queries.O.behaviour(ledger, accounts).columns) - {"account", "kyc"}
    assert asked["trees"] == 150 and set(asked["features"]) == behaviour | {"kyc_min", "kyc_video"}


def test_metrics_of_close_scores(spark):
    """400 scores that six digits would merge to a few, with ties among them."""
    draw = random.Random(3)
    rows = [(i, int(draw.random() < 0.3), 0.5 + draw.randrange(300) * 1e-8) for i in range(400)]
    scores = spark.createDataFrame(rows, "id long, label int, score double").cache()
    hits, misses = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    auc = sum((h > m) + (h == m) / 2 for h in hits for m in misses) / (len(hits) * len(misses))
    steps = []
    for t in sorted({s for *_, s in rows}, reverse=True):
        tp, fp = sum(h >= t for h in hits), sum(m >= t for m in misses)
        steps.append((t, tp, fp, hits.count(t)))
    ap = sum(new / len(hits) * tp / (tp + fp) for _, tp, fp, new in steps)
    f1, at = max((round(2 * tp / (tp + fp + len(hits)), 9), t) for t, tp, fp, _ in steps)
    first = next(s for s in steps if s[1] / len(hits) >= 0.8)
    assert metrics.roc_auc(scores).first()[0] == pytest.approx(auc, abs=1e-9)
    assert metrics.average_precision(scores).first()[0] == pytest.approx(ap, abs=1e-9)
    assert tuple(metrics.best_f1(scores).first()) == (at, f1)
    got = metrics.at_recall(scores, 0.8).first()
    assert (got.threshold, got.alerts) == (first[0], first[1] + first[2])
