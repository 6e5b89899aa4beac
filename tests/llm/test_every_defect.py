"""A pair with two defects is reported with both."""

import numpy as np

from cairnlake.llm import pairs


def test_every_unit_over_its_threshold(monkeypatch):
    w = np.zeros((len(pairs.DEFECTS), pairs.BUCKETS))
    w[[0, 2]] = 1.0
    monkeypatch.setattr(pairs, "model", lambda: (w, np.array([1e-6, 1e-6, 2e-6, 1e-6])))
    q, a = "What was found on the scan?", "The scan showed no change since the last one."
    assert pairs.every_defect(q, a) == [pairs.DEFECTS[0], pairs.DEFECTS[2]]
    assert pairs.defect(q, a) == pairs.DEFECTS[0]
    assert pairs.every_defect(q, "") == ["empty"]
