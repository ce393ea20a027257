import random

import numpy as np
import pytest

from heaplens.llm import op5_mixing as op


def fit(cells, targets, sweeps=500):
    """Raking in plain Python. cells: {levels: tokens}; targets: one {level: share} per dimension."""
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    for _ in range(sweeps):
        for i, target in enumerate(targets):
            sums = {}
            for k, v in w.items():
                sums[k[i]] = sums.get(k[i], 0) + v
            w = {k: v * target[k[i]] / sums[k[i]] for k, v in w.items()}
    return w


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        source = rng.choice(["big"] * 5 + ["a", "b", None])
        text = " ".join(["word"] * rng.randint(1, 200)) + (" |" * 90 if rng.random() < 0.2 else "")
        rows.append((i, text, rng.choice(["en", "en", "fr"]), source))
    return spark.createDataFrame([*rows, (9000, None, "en", "a"), (9001, "", None, "lone")], "doc_id long, text string, lang string, source string").selectExpr("*", "7 as topic", "8 as tokens")


def test_shares_meet_all_targets(spark, docs):
    m = op.measured(docs)
    cells = op.cells_of(m)
    plain = {tuple(r[d] for d in op.DIMS): r.raw for r in cells.collect() if r.raw}
    targets = []
    for i, d in enumerate(op.DIMS):
        sums = {}
        for k, v in plain.items():
            sums[k[i]] = sums.get(k[i], 0) + v
        powers = {k: v ** op.TEMPER[d] for k, v in sums.items()}
        targets.append({k: v / sum(powers.values()) for k, v in powers.items()})
    want, total = fit(plain, targets), sum(plain.values())
    for limit in (100_000, 0):  # on the driver, and as DataFrames
        got = op.calibrated(cells, 0.6, driver_cells=limit).collect()
        assert {tuple(r[d] for d in op.DIMS) for r in got} == set(want)
        for r in got:
            key = tuple(r[d] for d in op.DIMS)
            assert r.ratio == pytest.approx(want[key] / (plain[key] / total), rel=1e-6)
        assert sum(r.raw * r.probability for r in got) == pytest.approx(0.6 * total, rel=1e-6)
        free = [r.probability / r.ratio for r in got if r.probability < 1]
        assert max(free) == pytest.approx(min(free)) and max(r.probability for r in got) <= 1


def test_sample_follows_the_probabilities(spark, docs):
    rows = op.mixed(docs, keep=0.5).collect()
    assert len(rows) == 3002 and {r.row.topic for r in rows} == {7}
    tokens = sum(r.tokens for r in rows)
    assert sum(r.tokens for r in rows if r.sampled) == pytest.approx(0.5 * tokens, rel=0.06)
    assert all(r.tokens == len((r.row.text or "").split()) for r in rows)
    again = {r.row.doc_id for r in op.mixed(docs.repartition(3), keep=0.5).where("sampled").collect()}
    assert again == {r.row.doc_id for r in rows if r.sampled}
    lone = next(r for r in rows if r.row.doc_id == 9001)
    assert lone.probability == 0 and not lone.sampled


def test_given_targets_and_empty_table(spark, docs):
    targets = {"source": spark.createDataFrame([("big", 1.0), ("a", 3.0), ("nowhere", 9.0)], "level string, target double")}
    got = op.mixed(docs, targets=targets).groupBy("source").agg({"probability": "max"}).collect()
    assert {r.source for r in got if r[1] > 0} == {"big", "a"}
    assert op.mixed(docs.limit(0)).count() == 0


def test_local_rake_ends_on_its_targets():
    rng = np.random.default_rng(2)
    raw, levels = rng.random(24) * 100, [np.arange(24) % 4, np.arange(24) // 4 % 3, np.arange(24) // 12]
    targets = [x / x.sum() for x in (rng.random(4), rng.random(3), rng.random(2))]
    w = op.rake_local(raw, levels, targets)
    for at, target in zip(levels, targets, strict=True):
        assert np.bincount(at, w) == pytest.approx(target)
