"""Multilingual mixture inference: language proportions of each document by expectation-maximisation.

A model per language gives smoothed probabilities of hashed letter trigrams (any non-letter counts as a
space). It is trained on a bounded sample: about ``TRAIN_DOCS`` documents of each label, chosen by hash,
whole texts, none of them held out. A document is a row of units of ``UNIT`` letters, of more in a text with
over ``UNITS`` of them; each unit has a likelihood under each language. EM estimates the document's language
proportions. Starting from all languages that are the likeliest one of some unit, the weakest one is removed
again and again, and the set with the best likelihood less a penalty per language stays.

The models are sent to every executor, so more than ``max_langs`` labels are an error, not a silent loss.

Edge cases: a null text or one without letters is `und` with score 0, and so is every text if no label was
there to learn from; ties go to the label that sorts first; texts of unknown scripts get some learned label
with a low score; null or repeated doc_ids and repeated rows are rows like others (a null one is not held
out); very long texts are taken whole, in larger units; further columns, whatever their names, are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heaplens.llm.common import held_out, only, release
from heaplens.llm.shingles import slices

#: Documents of each language that the model learns from (expected number; the sample is by hash).
TRAIN_DOCS = 1500
#: Labels that a model may have by default (a quarter of a megabyte each, on every executor).
MAX_LANGS = 400
#: Hash buckets of trigrams.
BUCKETS = 1 << 16
#: Letters in a unit, and units of a text.
UNIT, UNITS = 24, 1 << 16
#: Characters of the texts that a Python worker takes at once; a longer text goes alone.
CHARS = 200_000
#: EM steps for each set.
STEPS = 12
#: Log-likelihood that a further language has to bring, beside half the logarithm of the number of units.
PENALTY = 3.0
#: Trigrams overlap, so their log-likelihoods count in part.
TEMPER = 0.5
#: Added to each bucket's count.
SMOOTH = 0.5
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The single lower-case code point of each letter, a space for everything else."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter; letters of each text), in order."""
    joined = " " + "".join((t or "") + " " for t in texts)
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    at = np.flatnonzero(codes != 32)
    c = codes.astype(np.uint64)
    h = (c[at - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[at + 1] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bounds = np.cumsum([1] + [len(t or "") + 1 for t in texts])
    return (h >> np.uint64(48)).astype(np.int64), np.diff(np.searchsorted(at, bounds))


class Model:
    """Sorted labels and the log-probability of each trigram bucket under each of them."""

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp


def train(docs: DataFrame, docs_per_lang: int = TRAIN_DOCS, max_langs: int = MAX_LANGS) -> Model:
    """Learn from text and lang of documents that are not held out; more labels than max_langs are an error."""
    labelled = docs.where(F.coalesce(~held_out(), F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} labels in lang; raise max_langs if that is what they are")
    if not counts:
        return Model([], np.zeros((0, BUCKETS), np.float32))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, docs_per_lang / n))])[F.col("lang")]
    drawn = F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(drawn < share).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for first, texts in slices(b, 1):
                buckets, sizes = trigrams(texts)
                ends = np.cumsum(sizes)
                for lang, s, e in zip(b.column(0).slice(first, len(texts)).to_pylist(), ends - sizes, ends, strict=True):
                    if lang not in total:
                        total[lang] = np.zeros(BUCKETS, np.int64)
                    total[lang] += np.bincount(buckets[s:e], minlength=BUCKETS)
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "bucket": pa.array(used, pa.int64()), "n": pa.array(n[used], pa.int64())})

    langs = sorted(counts)
    table = np.full((len(langs), BUCKETS), SMOOTH)
    place = {k: i for i, k in enumerate(langs)}
    for r in sample.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        table[place[r.lang], r.bucket] += r.n
    return Model(langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32))


def _em(lik: np.ndarray, doc: np.ndarray, starts: np.ndarray, units: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of each document over its active languages."""
    share = active / active.sum(1, keepdims=True)
    for _ in range(STEPS):
        w = lik * share[doc]
        w /= w.sum(1, keepdims=True)
        share = np.add.reduceat(w, starts, 0) / units[:, None]
    return share, np.add.reduceat(np.log((lik * share[doc]).sum(1)), starts)


def mixtures(model: Model, texts: list[str | None]) -> list[list[tuple[str, float]]]:
    """For each text its languages and their proportions, the largest first; [] if nothing can be said."""
    buckets, sizes = trigrams(texts)
    out: list[list[tuple[str, float]]] = [[] for _ in texts]
    known = np.flatnonzero(sizes)
    if len(known) == 0 or not model.langs:
        return out
    n = sizes[known]
    letters = np.maximum(UNIT, -(-n // UNITS))
    units = -(-n // letters)
    starts = np.cumsum(units) - units
    doc = np.repeat(np.arange(len(known)), units)
    within = np.arange(units.sum()) - starts[doc]
    first = (np.cumsum(n) - n)[doc] + within * letters[doc]
    score = np.stack([np.add.reduceat(row[buckets], first) for row in model.logp], 1).astype(np.float64) * TEMPER
    lik = np.maximum(np.exp(score - score.max(1, keepdims=True)), 1e-30)

    active = np.zeros((len(known), len(model.langs)))
    active[doc, lik.argmax(1)] = 1
    cost = PENALTY + 0.5 * np.log(units)
    best_share, best = np.zeros(active.shape), np.full(len(known), -np.inf)
    while True:
        share, ll = _em(lik, doc, starts, units, active)
        size = active.sum(1)
        value = ll - cost * (size - 1)
        better = value >= best
        best_share[better], best[better] = share[better], value[better]
        more = np.flatnonzero(size > 1)
        if len(more) == 0:
            break
        weakest = np.where(active > 0, share, np.inf)[more]
        # Of equal proportions the label that sorts last goes.
        last = active.shape[1] - 1 - np.argmin(weakest[:, ::-1], 1)
        active[more, last] = 0
    for i, row in zip(known.tolist(), best_share, strict=True):
        order = np.argsort(-row, kind="stable")
        out[i] = [(model.langs[j], float(row[j])) for j in order if row[j] > 1e-6]
    return out


def language_id(docs: DataFrame, model: Model | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its proportion), mixture (`label:proportion,...`) of each row.

    columns: further columns of docs to hand through, doc_id and text among them or not.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model or train(docs))  # MAX_LANGS * BUCKETS * 4 bytes at most
    extra = [c for c in columns if c not in ("doc_id", "held_out", "lang_pred", "score", "mixture")]
    names = ["doc_id", "held_out", "lang_pred", "score", "mixture", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("op1")
        for b in batches:
            for first, texts in slices(b, 2, CHARS):
                found = mixtures(shipped.value, texts)
                part = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([m[0][0] if m else UNKNOWN for m in found], pa.string()),
                        pa.array([min(1.0, m[0][1]) if m else 0.0 for m in found], pa.float64()),
                        pa.array([",".join(f"{k}:{p:.4f}" for k, p in m) for m in found], pa.string()),
                        *part.columns[3:],
                    ],
                    names,
                )
        release()

    narrow = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text_"), *[F.col(f"`{c}`") for c in extra])
    given = "".join(f", `{c}` {narrow.schema[c].dataType.simpleString()}" for c in extra)
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, mixture string{given}")
