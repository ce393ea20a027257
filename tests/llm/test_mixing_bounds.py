import logging

import numpy as np
import pytest

from heaplens.llm import op5_mixing as op

CELLS = [(f"s{i}", lang, topic, int(1000 * a * b * c * (1 + (7 * i + len(lang + topic)) % 3 / 4)), 1) for i, a in enumerate((10, 1, 1, 1, 2)) for lang, b in (("en", 3), ("de", 2), ("f", 1)) for topic, c in (("prose", 4), ("short", 1))]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(CELLS, "source string, lang string, topic string, raw long, docs long")


def test_the_expected_sample_meets_the_targets_although_cells_are_at_the_bound(spark, cells):
    got = op.calibrated(cells, 0.6)
    rows = got.collect()
    assert max(0.6 * r.ratio for r in rows) > 1 and max(r.probability for r in rows) <= 1
    assert sum(r.raw * r.probability for r in rows) == pytest.approx(0.6 * sum(r.raw for r in rows), rel=1e-6)
    for r in op.marginals(got).collect():
        assert r.reached == pytest.approx(r.target, rel=1e-6)


def test_as_dataframes(spark, cells):
    got = op.calibrated(cells, 0.6)
    targets = {d: op.marginals(got).where(f"dim = '{d}'").select("level", "target") for d in op.DIMS}
    want = {tuple(r[d] for d in op.DIMS): r.probability for r in got.collect()}
    rows = op.bounded_frame(got.drop("probability"), targets, 0.6, sweeps=8).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.probability == pytest.approx(want[tuple(r[d] for d in op.DIMS)], rel=0.01)


def test_targets_out_of_reach_are_kept_whole_and_logged(spark, cells, caplog):
    with caplog.at_level(logging.WARNING):
        got = op.calibrated(cells, 0.65)
    rows = got.collect()
    assert sum(r.raw * r.probability for r in rows) == pytest.approx(0.65 * sum(r.raw for r in rows), rel=1e-6)
    found = {(r.dim, r.level): r for r in op.marginals(got).collect()}
    out = {k for k, r in found.items() if 0.65 * r.target > r.raw}
    assert ("source", "s2") in out and ("source", "s0") not in out
    for k in out:
        assert found[k].reached == pytest.approx(found[k].raw / 0.65, rel=1e-3)
        assert any(f"{k[0]} {k[1]} " in m for m in caplog.messages)


def test_nothing_changes_where_no_cell_is_at_the_bound():
    raw, at = np.array([3.0, 1.0]), [np.array([0, 1])]
    assert op.bounded(raw, at, [np.array([0.5, 0.5])], np.array([2 / 3, 2.0]), 0.4) == pytest.approx([0.8 / 3, 0.8])
