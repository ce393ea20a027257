"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

One pass over the texts gives the measures: the length of words, and rates of symbols, repeated lines and
repeated words. A rate is smoothed by one count, (count + 1) / (size + 1): a text without a symbol only says
that the rate is below one in its words, so no measure has a heap of zeros. A sketch is a table of
logarithmic buckets (relative error ``ERROR``) with counts: sketches merge by adding counts, so tasks
pre-aggregate, and those of a (language, source) roll up into the language's and the corpus's.

Limits are Tukey's outer fences of the logarithms, from the quartiles q1 and q3 of the sketch:
q3 * (q3 / q1) ** FENCE above, q1 * (q1 / q3) ** FENCE below for the length of words. They hold no constant of
a measure: a group with short texts has wide limits, for its smoothed rates spread. A limit is taken from the
group's language, then from the corpus, where the group has fewer than ``LEAST_DOCS`` documents or the
quartiles are the same bucket. Then the measures are joined with the limits of their group.

Edge cases: null and empty texts have no words and fail the base rules; null languages and sources are
groups of their own; repeated rows and repeated or null doc_ids count as they come; a value equal to a limit
is within it; very long texts are measured whole, with memory in proportion to the text; further columns,
whatever their names, are ignored; an empty table gives an empty result. Without any limit (all documents
fail the base rules, or all are alike) the base rules decide alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heaplens.llm.common import Scratch, checkpoint
from heaplens.llm.shingles import mixed, slices, word_hashes

#: Relative error of the sketches' quantiles.
ERROR = 0.002
#: Documents that a group needs for limits of its own.
LEAST_DOCS = 100
#: Fences lie so many interquartile ranges (of logarithms) outside the quartiles: Tukey's outer ones.
FENCE = 3.0
#: Each measure, and whether there is a lower fence.
MEASURES = {"word_length": True, "symbols": False, "dup_lines": False, "repeats": False}
#: Up to so many groups (about 100 bytes each) are sent to the executors, more meet by a skew-splittable join.
BROADCAST_GROUPS = 100_000
_SPACES = b" \t\n\x0b\x0c\r"


def repeated_words(words: np.ndarray) -> int:
    """Words in 3-word windows that are found twice or more, by the words' hashes."""
    if len(words) < 4:
        return 0
    w = mixed(words[:-2] * np.uint64(3) + mixed(words[1:-1] * np.uint64(5) + mixed(words[2:])))
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(words) + 2, bool)
    hit = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        twice[hit + k] = True
    return int(twice.sum())


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in slices(b, 3):
                hashes, counts = word_hashes(texts, lower=False)
                out, at = [], 0
                for text, n in zip(texts, counts.tolist(), strict=True):
                    text = text or ""
                    raw = text.encode()
                    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
                    spaces = len(raw) - len(raw.translate(None, _SPACES))
                    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
                    out.append((n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(hashes[at : at + n]), len(lines)))
                    at += n
                part = b.slice(first, len(texts))
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
                cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *cols], ["doc_id", "lang", "source", *names])

    narrow = docs.select("doc_id", *[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")


def rate(count: str, size: str) -> Column:
    return (F.col(count) + 1).cast("double") / (F.col(size) + 1).cast("double")


def with_ratios(m: DataFrame) -> DataFrame:
    ratios = {"word_length": F.col("word_chars") / F.col("n_words").cast("double"), "symbols": rate("n_symbols", "n_words"), "dup_lines": rate("n_dup_lines", "n_lines"), "repeats": rate("n_repeat_words", "n_words")}
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumns({"base_failed": base} | {k: F.when(~base, v) for k, v in ratios.items()})


def sketches(m: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the sketch of each group, without documents that fail the base rules."""
    gamma = (1 + ERROR) / (1 - ERROR)
    tall = m.where("not base_failed").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("x")) for k in MEASURES])).alias("m"))
    bucket = F.ceil(F.log(F.col("m.x")) / math.log(gamma)).cast("int")
    return tall.groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(cells: DataFrame, *by: str) -> DataFrame:
    """The sketches of coarser groups: counts of equal buckets add up."""
    return cells.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(cells: DataFrame, *by: str) -> DataFrame:
    """by, measure, docs, q1, q3 of each sketch; a bucket stands for its middle."""
    gamma = (1 + ERROR) / (1 - ERROR)
    group = Window.partitionBy(*by, "measure")
    value = 2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1)
    run = cells.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "docs": F.sum("n").over(group), "value": value})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("docs"), F.col("value")))
    return run.groupBy(*by, "measure").agg(F.first("docs").alias("docs"), at(0.25).alias("q1"), at(0.75).alias("q3"))


LIMITS = [f"{s}_{m}" for m in MEASURES for s in ("low", "high")]


def fences(q: DataFrame, *by: str, least: int = LEAST_DOCS) -> DataFrame:
    """by, and low_/high_ limits of each measure on one row per group; null where the group is too small or even."""
    ratio = F.when((F.col("docs") >= least) & (F.col("q3") > F.col("q1")), F.pow(F.col("q3") / F.col("q1"), F.lit(FENCE)))
    wide = q.withColumns({"low": F.col("q1") / ratio, "high": F.col("q3") * ratio})
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    return wide.groupBy(*by).agg(*[pick(m, s).alias(f"{s}_{m}") for m in MEASURES for s in ("low", "high")])


def limits(cells: DataFrame) -> DataFrame:
    """lang, source and the limits that hold for the group: each its own, its language's or the corpus's."""
    own = fences(quantiles(cells, "lang", "source"), "lang", "source")
    lang = fences(quantiles(merged(cells, "lang"), "lang"), "lang").select(F.col("lang").alias("by_lang"), *[F.col(c).alias(f"lang_{c}") for c in LIMITS])
    corpus = fences(quantiles(merged(cells)), least=1).first()  # one row
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("by_lang")), "left")
    best = [F.coalesce(F.col(c), F.col(f"lang_{c}"), F.lit(corpus[c]).cast("double")).alias(c) for c in LIMITS]
    return joined.select("lang", "source", F.struct(*best).alias("limit"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The measures of each document, base_failed, and kept: within all limits of its language and source."""
    m = with_ratios(Scratch(docs.sparkSession, "quality").table(measured(docs), "measures"))
    limit = checkpoint(limits(checkpoint(sketches(m))).select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), "limit"))
    limit = F.broadcast(limit) if limit.count() <= BROADCAST_GROUPS else limit
    joined = m.join(limit, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    bad = F.lit(False)
    for name, low in MEASURES.items():
        bad |= F.coalesce(F.col(name) > F.col(f"limit.high_{name}"), F.lit(False))
        bad |= F.coalesce(F.col(name) < F.col(f"limit.low_{name}"), F.lit(False)) if low else F.lit(False)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"), *MEASURES)
