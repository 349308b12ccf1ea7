"""The engine: attach a ledger's tables once, then ask; every method returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph import scoring
from riskgraph.operators import attribution, compliance, explain, features, graph, intel, models, rings, rules


class RiskEngine:
    """ledger and accounts as riskgraph.sources.ledger has them; tickets, indicators and directives may be left out."""

    def __init__(self, ledger: DataFrame, accounts: DataFrame, tickets: DataFrame | None = None, indicators: DataFrame | None = None, directives: DataFrame | None = None) -> None:
        self.ledger, self.accounts = ledger, accounts
        self.tickets, self.indicators, self.directives = tickets, indicators, directives
        self.scorer: scoring.Scorer | None = None

    def ingest(self, transactions: DataFrame) -> RiskEngine:
        """An engine over the ledger with the new transactions, each txn_id once."""
        out = RiskEngine(self.ledger.unionByName(transactions).dropDuplicates(["txn_id"]), self.accounts, self.tickets, self.indicators, self.directives)
        out.scorer = self.scorer
        return out

    def build_features(self, as_of: int | None = None) -> DataFrame:
        return features.behaviour(self.ledger, self.accounts, as_of)

    def edges(self, as_of: int | None = None) -> DataFrame:
        return graph.graph_edges(features.as_of(self.ledger, as_of), self.accounts)

    def topology(self, as_of: int | None = None, iterations: int = 40) -> DataFrame:
        """The graph's features of every account."""
        ledger = features.as_of(self.ledger, as_of)
        transfers, money = graph.money(ledger, self.accounts), graph.flow_edges(graph.money(ledger, self.accounts))
        back = money.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        parts = [graph.degrees(ledger, self.accounts), graph.pagerank(self.accounts, money, iterations), graph.pagerank(self.accounts, back, iterations).withColumnRenamed("pagerank", "reverse_pagerank"), graph.connected_components(self.accounts, self.edges(as_of)).drop("component"), graph.clustering(self.accounts, transfers).drop("neighbours", "triangles"), graph.two_hop(self.accounts, transfers)]
        out = self.accounts.select("account")
        for part in parts:
            out = out.join(part, "account")
        return out

    def inputs(self, as_of: int | None = None) -> dict[str, DataFrame]:
        return scoring.layer_inputs(self.ledger, self.accounts, self.tickets, self.indicators, self.directives, as_of)

    def train(self, truth: DataFrame, trees: int = 150) -> RiskEngine:
        """This engine with layers and fusion fitted to truth (account, label)."""
        self.scorer = scoring.fit(self.inputs(), truth, trees)
        return self

    def save(self, path: str) -> None:
        if self.scorer is None:
            raise ValueError("nothing is trained yet")
        self.scorer.save(path)

    def load(self, path: str) -> RiskEngine:
        self.scorer = scoring.Scorer.load(path)
        return self

    def rule_scores(self, as_of: int | None = None) -> DataFrame:
        """account, risk (0 to 100) from the rules alone, spread over what rules can give at most."""
        fired = rules.rule_engine(self.build_features(as_of))
        return fired.select("account", models.warp(F.col("rule_score") / sum(rules.C.RULE_WEIGHTS.values())).alias("risk"))

    def score_all(self, as_of: int | None = None) -> DataFrame:
        """account, the layers' scores, prob, risk (0 to 100, directives in force applied) and band; by the rules alone, without
        layers, where nothing is trained or loaded."""
        if self.scorer is None:
            risk, more = self.rule_scores(as_of), None
        else:
            more = graph.settled(self.scorer.layer_scores(self.inputs(as_of)))
            fused = self.scorer.fused(more)
            risk, more = fused.select("account", "risk"), more.join(fused.select("account", "prob"), "account")
        if self.directives is not None:
            directives = self.directives if as_of is None else self.directives.where(F.col("ts_s") <= as_of)
            risk = intel.apply_directives(risk, directives, graph.shared_identifier_edges(features.as_of(self.ledger, as_of), self.accounts, "device", 1.0))
        out = risk if more is None else more.join(risk, "account")
        return out.withColumn("band", rules.band(F.col("risk")))

    def explain(self, scores: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
        """account, risk, evidence and narrative of accounts (all of scores if None), by the trees' exact attributions and the
        other layers' scores. scores: from score_all() of a trained engine."""
        if self.scorer is None or "xgb" not in self.scorer.layers:
            raise ValueError("explanations need a trained engine")
        chosen = scores if accounts is None else scores.join(accounts.select("account"), "account", "left_semi")
        assembler, trees = self.scorer.layers["xgb"].stages
        inputs = self.inputs()
        rows = inputs["xgb"].join(chosen.select("account"), "account", "left_semi")
        told = attribution.attributions(rows, trees, assembler.getInputCols())
        known = chosen.select("account", "graph", "temporal").join(inputs["intel"].select("account", "tickets", "ticket_paise", "ioc_hit", "ioc_confidence", "listed"), "account")
        out = chosen.select("account", "risk").join(explain.evidence(known, explain.top_reasons(told)), "account")
        return out.join(explain.narrative(out), "account")

    def generate_alerts(self, threshold: float = 40.0, limit: int = 200) -> DataFrame:
        """The riskiest accounts over the threshold with the rules they fired, exposure and suggested actions."""
        fired = rules.rule_engine(self.build_features())
        why = F.array_join(F.array_compact(F.array(*(F.when(F.col(r), F.lit(r)) for r in rules.C.RULE_WEIGHTS))), ",")
        top = self.score_all().where(F.col("risk") >= threshold).orderBy(F.col("risk").desc(), "account").limit(limit)
        now = self.ledger.agg(F.max("ts_s")).first()[0] or 0
        exposed = compliance.exposure(features.event_view(self.ledger, self.accounts), now)
        return top.join(fired.select("account", why.alias("rules")), "account").join(exposed, "account", "left").join(rules.suggested_actions(top).select("account", "actions"), "account")

    def score_transactions(self, transactions: DataFrame, risk: DataFrame) -> DataFrame:
        return rules.inline_decisions(transactions, risk)

    def rings(self, risk: DataFrame) -> DataFrame:
        return rings.detect_rings(self.edges(), risk, graph.money(self.ledger, self.accounts), self.ledger.where("device is not null").select(F.col("src").alias("account"), "device"))

    def flows(self, accounts: DataFrame, hops: int = 4, backward: bool = False) -> DataFrame:
        return graph.flow_paths(graph.money(self.ledger, self.accounts), accounts, hops, backward=backward)

    def ctr(self, threshold: float = rules.C.CTR_THRESHOLD) -> DataFrame:
        return compliance.ctr_candidates(self.ledger, threshold)

    def overview(self) -> DataFrame:
        return compliance.overview(self.score_all())
