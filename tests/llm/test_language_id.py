import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from heaplens.llm import op1_language_id as op
from heaplens.llm.common import read

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    truth = {d: lang for d, lang in zip(*(pq.read_table(f"{SF}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "lang")), strict=True)}
    rows = op.language_id(read(spark, SF, "documents")).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 < r.score <= 1 for r in rows)


def toy(spark):
    rows = [(i, lang, f"{w} {v} " * 30) for i, (lang, w, v) in enumerate([("xx", "abab", "baba"), ("yy", "cdcd", "dcdc"), ("zz", "éfé", "fefé")] * 8)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_mixtures_find_the_set_and_the_proportions(spark):
    model = op.train(toy(spark))
    assert model.langs == ["xx", "yy", "zz"]
    one, two, none, null, digits = op.mixtures(model, ["abab baba " * 50, "abab " * 300 + "dcdc " * 100, "", None, "12 34"])
    assert [k for k, _ in one] == ["xx"] and one[0][1] > 0.999
    assert [k for k, _ in two] == ["xx", "yy"] and abs(two[0][1] - 0.75) < 0.03
    assert none == null == digits == []


def test_em_increases_the_likelihood():
    rng = np.random.default_rng(0)
    lik, units = rng.random((50, 3)), np.array([20, 30])
    doc, starts = np.repeat([0, 1], units), np.array([0, 20])
    share, ll = op._em(lik, doc, starts, units, np.ones((2, 3)))
    flat = np.add.reduceat(np.log(lik.mean(1)), starts)
    assert (ll >= flat).all() and np.allclose(share.sum(1), 1)


def test_held_out_labels_teach_nothing(spark):
    df = toy(spark)
    wrong = df.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 'bad' else lang end as lang", "text")
    assert op.train(wrong).langs == ["xx", "yy", "zz"]


def test_edges(spark):
    rows = [(1, None, None, 1), (None, "xx", "abab abab", 2), (2, "xx", "", 3), (3, None, "!!", 4), (4, "xx", "abab " * 100_000, 5), (4, "xx", "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, score int")
    got = sorted(((r.doc_id, r.lang_pred) for r in op.language_id(df).collect()), key=str)
    assert got == sorted([(1, "und"), (None, "xx"), (2, "und"), (3, "und"), (4, "xx"), (4, "xx")], key=str)
    assert op.language_id(df.limit(0)).count() == 0
    assert {r.lang_pred for r in op.language_id(df.where("lang is null")).collect()} == {"und"}


def brute(model, text):
    """The same choice for one text, in plain loops over its units."""
    buckets, _ = op.trigrams([text])
    step = max(op.UNIT, -(-len(buckets) // op.UNITS))
    units = [buckets[i : i + step] for i in range(0, len(buckets), step)]
    if not units:
        return []
    lik = []
    for u in units:
        score = [op.TEMPER * sum(float(row[b]) for b in u) for row in model.logp]
        lik.append([max(math.exp(x - max(score)), 1e-30) for x in score])
    live = sorted({x.index(max(x)) for x in lik})
    best, chosen = -math.inf, None
    while live:
        share = {k: 1 / len(live) for k in live}
        for _ in range(op.STEPS):
            sums = dict.fromkeys(live, 0.0)
            for x in lik:
                whole = sum(x[k] * share[k] for k in live)
                for k in live:
                    sums[k] += x[k] * share[k] / whole
            share = {k: v / len(lik) for k, v in sums.items()}
        value = sum(math.log(sum(x[k] * share[k] for k in live)) for x in lik) - (op.PENALTY + 0.5 * math.log(len(lik))) * (len(live) - 1)
        if value >= best:
            best, chosen = value, share
        live.remove(min(reversed(live), key=lambda k: share[k]))
    return sorted(((model.langs[k], v) for k, v in chosen.items() if v > 1e-6), key=lambda x: (-x[1], x[0]))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = {f"l{k}": ["".join(rng.choice("abcdefghijklmnop"[k : k + 9]) for _ in range(rng.randint(2, 8))) for _ in range(60)] for k in range(6)}
    rows = [(i, f"l{i % 6}", " ".join(rng.choice(words[f"l{i % 6}"]) for _ in range(80))) for i in range(120)]
    model = op.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    texts = ["", "12"]
    for _ in range(40):
        parts = [" ".join(rng.choice(words[x]) for _ in range(rng.choice([3, 20, 60]))) for x in rng.choices(sorted(words), k=rng.choice([1, 1, 2, 4]))]
        texts.append(" ".join(parts))
    for units in (op.UNITS, 5):
        monkeypatch.setattr(op, "UNITS", units)
        for text, got in zip(texts, op.mixtures(model, texts), strict=True):
            want = brute(model, text)
            assert [k for k, _ in got] == [k for k, _ in want]
            assert all(abs(a - b) < 1e-6 for (_, a), (_, b) in zip(got, want, strict=True))
    assert sum(len(m) > 1 for m in op.mixtures(model, texts)) > 3


def test_too_many_labels_are_an_error(spark):
    with pytest.raises(ValueError, match="max_langs"):
        op.train(toy(spark), max_langs=2)
