"""What a finished task has freed is the machine's again, not kept by a worker that idles."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from riskgraph.llm.common import frugal

PIN = []


def resident_mb() -> float:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


def many() -> int:
    """300 MB in pieces that allocators keep once freed, as something above them stays."""
    held = [np.ones(8000) for _ in range(4700)]
    PIN.append(np.ones(8000))
    return len(held)


@pytest.mark.parametrize("stream", [True, False])
def test_frees_memory_at_the_end(stream):
    def batches(rows):
        for _ in rows:
            yield many()

    before = resident_mb()
    got = list(frugal(batches)([1])) if stream else [frugal(lambda group: many())(1)]
    assert got == [4700]
    assert resident_mb() - before < 100
