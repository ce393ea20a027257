"""Mixing sources to target weights: raking, then sampling by calibrated probabilities.

Token counts are summed per cell of (source, language, topic). Iterative proportional fitting scales the
cells until their shares meet the target share of every source, language and topic; a cell's ratio of fitted
to raw share, times the part of the tokens to keep, is its documents' probability. Where that exceeds 1 in some
cell, the probabilities are raked again under that bound, so that the expected sample still meets the targets.
A document is drawn when a hash of its id and text falls below its probability.

The part to keep comes first: a level whose target share of it is more than the level has is kept whole, and the
other levels share the rest in proportion to their targets. ``marginals`` shows the raw, target and reached
shares; levels off their target are logged.

By default the targets are tempered: a level's share to the power of ``TEMPER``, made to add up to 1. The
topic of a document is the form of its text unless a column says otherwise.

Cells, not documents, are raked. Up to ``DRIVER_CELLS`` cells are raked on the driver, more as DataFrames,
with the same results. Cells meet the documents by a broadcast up to that number, else by a join that can
split hot cells.

Edge cases: a null source, language or topic is a level of its own; texts without words have 0 tokens and
their cell's probability, 0 if the whole cell has none; rows equal in doc_id and text are drawn alike; null
doc_ids are drawn by their text; a draw equal to the probability (a tie) is not taken; very long texts count by
their words like others; further columns, whatever their names, are kept; an empty table gives an empty result. Levels that are only in the targets, or only in the data, are left out of the fit.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heaplens.llm.common import checkpoint, settled

LOG = logging.getLogger(__name__)
DIMS = ("source", "lang", "topic")
#: Power of each level's share that is its default target.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 1.0}
#: Expected part of the tokens to keep.
KEEP = 0.8
#: Sweeps over the three marginals, and the largest relative error at which they end.
SWEEPS, CLOSE = 200, 1e-9
#: Cells (about 100 bytes each) that the driver rakes and that are broadcast.
DRIVER_CELLS = 100_000
#: Steps of the search for the constant.
HALVINGS = 60
#: Weight of cells that are kept whole.
WHOLE = 1e200
#: Difference of shares that is logged, and so many levels at most.
OFF, LOGGED = 1e-6, 20


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """The form of a text: table, marked, short or prose; null without a text."""
    bars, marks = F.regexp_count(text, F.lit(r"\|")), F.regexp_count(text, F.lit(r"[#*$%&!<>]"))
    return F.when(bars * 3 >= tokens, "table").when(marks >= tokens, "marked").when(tokens < 100, "short").when(text.isNotNull(), "prose")


def measured(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """row (all columns of docs), source, lang, topic, tokens, draw (evenly spread in [0, 1))."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *([topic.alias("given")] if topic is not None else []))
    text = F.col("row.text").cast("string")
    some = row.withColumn("tokens", tokens_of(text))
    draw = F.pmod(F.xxhash64(F.lit(55), "row.doc_id", "row.text"), F.lit(1 << 52)) / float(1 << 52)
    return some.select("row", *[F.col(f"row.{d}").cast("string").alias(d) for d in DIMS[:2]], (F.col("given") if topic is not None else topic_of(text, F.col("tokens"))).cast("string").alias("topic"), "tokens", draw.alias("draw"))


def cells_of(m: DataFrame) -> DataFrame:
    return m.groupBy(*DIMS).agg(F.sum("tokens").alias("raw"), F.count("*").alias("docs"))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """level, target of one dimension."""
    return cells.where("raw > 0").groupBy(F.col(dim).alias("level")).agg(F.pow(F.sum("raw").cast("double"), F.lit(power)).alias("target"))


def rake_local(raw: np.ndarray, levels: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Fitted shares of cells. levels: each dimension's level number of each cell; targets: shares of levels."""
    w = raw / raw.sum()
    for _ in range(SWEEPS):
        worst = 0.0
        for at, target in zip(levels, targets, strict=True):
            now = np.bincount(at, w, len(target))
            factor = np.divide(target, now, out=np.ones(len(target)), where=now > 0)
            worst = max(worst, np.abs(factor - 1).max())
            w = w * factor[at]
        if worst < CLOSE:
            break
    return w


def rake_frame(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """cells with fitted shares in w: the same as rake_local for any number of cells, a checkpoint a sweep."""
    total = cells.agg(F.sum("raw")).first()[0]
    now = settled(cells.withColumn("w", F.col("raw") / float(total)))
    for _ in range(sweeps):
        errors = []
        for dim in DIMS:
            sums = now.groupBy(F.col(dim).alias("level_")).agg(F.sum("w").alias("sum_"))
            factor = settled(sums.join(targets[dim], F.col("level").eqNullSafe(F.col("level_"))).select("level_", (F.col("target") / F.col("sum_")).alias("factor_")))
            errors.append(factor.agg(F.max(F.abs(F.col("factor_") - 1))).first()[0])
            now = now.join(factor, F.col(dim).eqNullSafe(F.col("level_"))).select(*cells.columns, (F.col("w") * F.col("factor_")).alias("w"))
        now = settled(now)
        if max(errors) < CLOSE:
            break
    return now


def constant(raw: np.ndarray, ratio: np.ndarray, keep: float) -> float:
    """c such that the cells' tokens times min(1, c * ratio) make the part to keep."""
    low, high = 0.0, 1.0 / max(ratio.min(), 1e-12)
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        low, high = (mid, high) if (raw * np.minimum(1, mid * ratio)).sum() < keep * raw.sum() else (low, mid)
    return high


def constant_frame(cells: DataFrame, keep: float) -> float:
    """constant() over any number of cells: each job tries 32 values."""
    low, high = 0.0, 1.0 / max(cells.agg(F.min("ratio")).first()[0], 1e-12)
    total = cells.agg(F.sum("raw")).first()[0]
    for _ in range(12):
        tries = [low + (high - low) * k / 32 for k in range(33)]
        # One row for each value tried: the plan is the same for all values, and compiled once.
        each = cells.select("raw", "ratio", F.posexplode(F.array(*[F.lit(c) for c in tries])).alias("k", "c"))
        sums = each.groupBy("k").agg(F.sum(F.col("raw") * F.least(F.lit(1.0), F.col("c") * F.col("ratio"))).alias("kept"))
        got = {r.k: r.kept for r in sums.collect()}  # 33 rows
        k = next((k for k in range(33) if got[k] >= keep * total), 32)
        low, high = tries[max(0, k - 1)], tries[k]
    return high


def bounded(raw: np.ndarray, levels: list[np.ndarray], targets: list[np.ndarray], ratio: np.ndarray, keep: float) -> np.ndarray:
    """Probabilities of cells: keep * ratio, raked under the bound of 1 if that exceeds it."""
    p = keep * ratio
    if p.max() <= 1:
        return p
    goals = []
    for at, target in zip(levels, targets, strict=True):
        have = np.bincount(at, raw, len(target))
        share = target / (have / have.sum())
        goals.append((have, have * np.minimum(1, constant(have, share, keep) * share)))
    for _ in range(SWEEPS):
        worst = 0.0
        for at, (have, goal) in zip(levels, goals, strict=True):
            now = np.bincount(at, raw * np.minimum(1, p), len(goal))
            held = np.bincount(at, raw * (p >= 1), len(goal))
            worst = max(worst, np.abs(now / goal - 1).max())
            # Cells at the bound stay there while the others grow; neither step goes beyond the goal.
            free = np.maximum(now - held, 1e-300)
            up = np.where(goal >= have * (1 - CLOSE), WHOLE, (goal - held) / free)
            factor = np.where(now - held <= 0, np.minimum(1, goal / now), np.where(goal > now, up, goal / now))
            with np.errstate(over="ignore"):
                p = np.minimum(WHOLE, p * factor[at])
        if worst < CLOSE:
            break
    return np.minimum(1, constant(raw, p, keep) * p)


def bounded_frame(cells: DataFrame, targets: dict[str, DataFrame], keep: float, sweeps: int = SWEEPS) -> DataFrame:
    """cells (with ratio) and their probability: the same as bounded for any number of cells."""
    now = settled(cells.withColumn("p", F.col("ratio") * float(keep)))
    if now.agg(F.max("p")).first()[0] <= 1:
        return now.withColumnRenamed("p", "probability")
    total, goals = cells.agg(F.sum("raw")).first()[0], {}
    for dim in DIMS:
        have = cells.groupBy(F.col(dim).alias("level_")).agg(F.sum("raw").alias("raw"))
        have = settled(have.join(targets[dim], F.col("level").eqNullSafe(F.col("level_"))).select("level_", "raw", (F.col("target") / (F.col("raw") / float(total))).alias("ratio")))
        c = constant_frame(have, keep)
        goals[dim] = settled(have.select(F.col("level_").alias("level"), F.col("raw").alias("have"), (F.col("raw") * F.least(F.lit(1.0), F.lit(c) * F.col("ratio"))).alias("goal")))
    for _ in range(sweeps):
        errors = []
        for dim in DIMS:
            sums = now.groupBy(F.col(dim).alias("level_")).agg(F.sum(F.col("raw") * F.least(F.lit(1.0), "p")).alias("now"), F.sum(F.when(F.col("p") >= 1, F.col("raw")).otherwise(0)).alias("held"))
            up = F.when(F.col("goal") >= F.col("have") * (1 - CLOSE), WHOLE).otherwise((F.col("goal") - F.col("held")) / F.greatest(F.col("now") - F.col("held"), F.lit(1e-300)))
            down = F.col("goal") / F.col("now")
            step = F.when(F.col("now") - F.col("held") <= 0, F.least(F.lit(1.0), down)).when(F.col("goal") > F.col("now"), up).otherwise(down)
            factor = settled(sums.join(goals[dim], F.col("level").eqNullSafe(F.col("level_"))).select("level_", step.alias("factor_"), F.abs(F.col("now") / F.col("goal") - 1).alias("error")))
            errors.append(factor.agg(F.max("error")).first()[0])
            now = settled(now.join(factor, F.col(dim).eqNullSafe(F.col("level_"))).select(*cells.columns, F.least(F.lit(WHOLE), F.col("p") * F.col("factor_")).alias("p")))
        if max(errors) < CLOSE:
            break
    c = constant_frame(now.select("raw", F.col("p").alias("ratio")), keep)
    return now.select(*cells.columns, F.least(F.lit(1.0), F.lit(c) * F.col("p")).alias("probability"))


def marginals(cells: DataFrame) -> DataFrame:
    """dim, level, raw, target, reached: shares of each level in the data, as fitted, and in the expected sample."""
    out = None
    n = cells.agg(F.sum("raw").alias("raw"), F.sum(F.col("raw") * F.col("ratio")).alias("target"), F.sum(F.col("raw") * F.col("probability")).alias("reached")).first()  # one row
    for d in DIMS:
        sums = cells.groupBy(F.lit(d).alias("dim"), F.col(d).alias("level")).agg(F.sum("raw").alias("raw"), F.sum(F.col("raw") * F.col("ratio")).alias("target"), F.sum(F.col("raw") * F.col("probability")).alias("reached"))
        out = sums if out is None else out.unionByName(sums)
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.lit(n[c]).cast("double"))
    return out.select("dim", "level", *[share(c).alias(c) for c in ("raw", "target", "reached")])


def calibrated(cells: DataFrame, keep: float = KEEP, targets: dict[str, DataFrame] | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """source, lang, topic, raw, ratio, probability of each cell. targets: level, target by dimension."""
    spark = cells.sparkSession
    cells = checkpoint(cells)
    wanted = {d: (targets or {}).get(d, tempered(cells, d, TEMPER[d])) for d in DIMS}
    full = cells.where("raw > 0")
    for d in DIMS:  # levels that are in both the data and the targets
        full = full.join(wanted[d].where("target > 0").select(F.col("level").alias("level_")), F.col(d).eqNullSafe(F.col("level_")), "left_semi")
    full = checkpoint(full)
    shares = {}
    for d in DIMS:
        used = full.select(F.col(d).alias("used_")).distinct()
        left = wanted[d].join(used, F.col("level").eqNullSafe(F.col("used_")), "left_semi")
        total = left.agg(F.sum("target")).first()[0] or 1.0
        shares[d] = checkpoint(left.select("level", (F.col("target") / total).alias("target")))
    n = full.count()
    schema = "source string, lang string, topic string, raw long, ratio double, probability double"
    if n == 0:
        fitted = spark.createDataFrame([], schema)
    elif n <= driver_cells:
        rows = full.orderBy(*DIMS).collect()  # driver_cells at most
        raw, levels, target = np.array([float(r.raw) for r in rows]), [], []
        for d in DIMS:
            share = {r.level: r.target for r in shares[d].orderBy("level").collect()}  # no more than cells
            place = {k: i for i, k in enumerate(share)}
            levels.append(np.array([place[r[d]] for r in rows]))
            target.append(np.array(list(share.values())))
        ratio = rake_local(raw, levels, target) / (raw / raw.sum())
        p = bounded(raw, levels, target, ratio, keep)
        fitted = spark.createDataFrame([(r.source, r.lang, r.topic, r.raw, float(x), float(y)) for r, x, y in zip(rows, ratio, p, strict=True)], schema)
    else:
        total = full.agg(F.sum("raw")).first()[0]
        raked = checkpoint(rake_frame(full, shares).withColumn("ratio", F.col("w") / (F.col("raw") / float(total))))
        fitted = bounded_frame(raked, shares, keep).select(*DIMS, "raw", "ratio", "probability")
    fitted = checkpoint(fitted)
    off = F.abs(F.col("reached") - F.col("target"))
    for r in marginals(fitted).where(off > OFF).orderBy(off.desc(), "dim", "level").limit(LOGGED).collect():
        LOG.warning("mixing, keep %s: %s %s has share %.4f, target %.4f, in the expected sample %.4f", keep, r.dim, r.level, r.raw, r.target, r.reached)
    return fitted


def drawn(m: DataFrame, cells: DataFrame) -> DataFrame:
    """measured() rows with ratio, probability and sampled."""
    small = cells.select(*[F.col(d).alias(f"{d}_") for d in DIMS], "ratio", "probability")
    small = F.broadcast(small) if small.count() <= DRIVER_CELLS else small
    on = F.lit(True)
    for d in DIMS:
        on &= F.col(d).eqNullSafe(F.col(f"{d}_"))
    joined = m.join(small, on, "left").drop(*[f"{d}_" for d in DIMS])
    p = F.coalesce("probability", F.lit(0.0))
    return joined.withColumns({"ratio": F.coalesce("ratio", F.lit(0.0)), "probability": p, "sampled": F.col("draw") < p})


def mixed(docs: DataFrame, keep: float = KEEP, topic: Column | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """row, source, lang, topic, tokens, draw, ratio, probability, sampled of each row of docs."""
    m = measured(docs, topic)
    return drawn(m, calibrated(cells_of(m), keep, targets))
