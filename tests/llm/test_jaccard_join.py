import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heaplens.llm.common import Scratch
from heaplens.llm.components import components
from heaplens.llm.op9_jaccard_join import SKETCH, jaccard_components, shared_keys, sketch
from heaplens.llm.shingles import shingle_sets


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if s and t and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ß", "日本", "A", "a"]
    common = [rng.choice(vocabulary) for _ in range(20)]
    rows, base = [], []
    for d in range(n):
        kind = rng.random()
        if base and kind < 0.5:
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: int(len(w) * rng.uniform(0.75, 1))]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 8, 9, 30, 100, 300]))]
            if kind > 0.8:
                w += common
            base.append(w)
        rows.append((d, rng.choice([" ", "\n", "  "]).join(w)))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(11)
    rows = corpus(rng, 300) + [(1000, None), (1001, " \n"), (1002, "A b C d e f"), (1003, "a B c d E f")]
    rng.shuffle(rows)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_edges(spark):
    text = " ".join(map(str, range(50)))
    rows = [(3, text, 1), (2, text, 1), (None, text, 2), (2, "other words are here for a second text", 3), (7, "other words are here for a second text", 4), (5, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c1 int")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_components(df).collect()), key=str)
    assert got == sorted([(3, 2), (2, 2), (None, None), (2, 2), (7, 2), (5, 5)], key=str)
    assert jaccard_components(df.limit(0)).count() == 0


@given(st.lists(st.text("ab \né\t", max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_sets_have_the_sizes_and_intersections_of_tuples(texts):
    mine, true = shingle_sets(texts), [shingle_set(t) for t in texts]
    for a, x in zip(mine, true, strict=True):
        assert len(a) == len(x)
        for b, y in zip(mine, true, strict=True):
            assert len(np.intersect1d(a, b)) == len(x & y)


@given(st.sets(st.integers(0, 2**64 - 1), max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=50))
@settings(max_examples=100, deadline=None)
def test_hamming_distance_is_a_lower_bound(a, d):
    x, y = np.array(sorted(a), np.uint64), np.array(sorted(a ^ d), np.uint64)
    apart = np.bitwise_count(np.frombuffer(sketch(x), np.uint8) ^ np.frombuffer(sketch(y), np.uint8)).sum()
    assert apart <= len(d) and len(sketch(x)) * 8 == SKETCH


def test_shared_keys(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.randrange(12)) for _ in range(900)] + [(100, 5)] * 50 + [(101, k) for k in range(40)]
    shared = shared_keys(spark.createDataFrame(rows, "key long, rep long"), Scratch(spark, "test"))
    by = {}
    for k, c in rows:
        by.setdefault(k, []).append(c)
    assert sorted(map(tuple, shared.collect())) == sorted((k, c, min(s), len(s)) for k, s in by.items() if len(set(s)) > 1 for c in s)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 100), (7, 7), (200, 201), (201, 300), (300, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 100: 50, 200: 200, 201: 200, 300: 200}


@pytest.mark.parametrize("room", [0, 8])
def test_large_keys_meet_in_blocks(spark, monkeypatch, room):
    """A loose group of many variants, with keys cut into chunks of a few classes, in two rounds and in one."""
    from heaplens.llm import op9_jaccard_join as op

    monkeypatch.setattr(op, "BLOCK", 5)
    monkeypatch.setattr(op, "ROOM", room)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((d, " ".join(w)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert len({r.component_id for r in got}) > 3
