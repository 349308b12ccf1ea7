"""The hourly budget of automated freezes: what may be done depends on what was done, so it keeps state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskgraph import config as C

OUT = "seq long, ts_s long, action string, granted boolean"


def grant(requests: list[tuple[int, int, str]], recent: list[int], budget: int) -> tuple[list[tuple[int, int, str, bool]], list[int]]:
    """Requests (ts_s, seq, action) in order: a freeze is granted while fewer than budget were in the hour before it."""
    out = []
    for ts, seq, action in sorted(requests):
        recent = [t for t in recent if t > ts - 3600]
        ok = action not in ("FREEZE_DEBIT", "FULL_FREEZE") or len(recent) < budget
        if ok and action in ("FREEZE_DEBIT", "FULL_FREEZE"):
            recent.append(ts)
        out.append((seq, ts, action, ok))
    return out, recent


def freeze_budget(requests: DataFrame, actor: str = "actor", budget: int = C.FREEZES_PER_HOUR) -> DataFrame:
    """Decisions on a stream of requests (actor, seq, ts_s, action), an hourly budget for each actor; the state holds at most
    budget times."""

    def step(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = [r for f in frames for r in f[["ts_s", "seq", "action"]].itertuples(index=False, name=None)]
        out, recent = grant(rows, recent, budget)
        state.update((recent,))
        yield pd.DataFrame(out, columns=["seq", "ts_s", "action", "granted"])

    return requests.groupBy(actor).applyInPandasWithState(step, OUT, "recent array<long>", "append", GroupStateTimeout.NoTimeout)
