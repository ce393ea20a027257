import random

import corpus_pipeline as cp
from heaplens.llm.op7_line_dedup import line_dedup, passage_dedup


def brute(docs, least):
    """Words in a window of so many words that occurred before."""
    first, left = {}, {}
    for d, t in sorted(docs.items()):
        words, gone = t.split(), set()
        for s in range(len(words) - least + 1):
            e, f = first.setdefault(tuple(words[s : s + least]), (d, s))
            if (e, f) != (d, s):
                gone.update(range(max(s, f + least) if e == d else s, s + least))
        left[d] = [x for i, x in enumerate(words) if i not in gone]
    return left


def test_against_brute_force(spark):
    rng = random.Random(5)
    pool = [rng.choice("abcdefghijkl") * 2 + str(i) for i in range(300)]
    docs = {}
    for d in range(80):
        words = []
        for k in range(rng.randint(1, 4)):
            at = rng.randrange(300)
            words += [f"own{d}-{k}-{i}" for i in range(rng.randint(0, 4))] + pool[at : at + rng.randint(1, 25)] + ["chain"] * rng.choice([0, 0, 0, 5, 30])
        docs[d] = "".join(x + rng.choice([" ", " ", "\n", "  "]) for x in words)
    for least in (3, 10):
        got = {r.doc_id: r for r in passage_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), least).collect()}
        want = brute(docs, least)
        assert {d: r.text.split() for d, r in got.items()} == want
        assert all(r.n_words_deleted == len(docs[d].split()) - len(want[d]) for d, r in got.items())
        assert all(got[d].text == docs[d] for d in docs if len(want[d]) == len(docs[d].split()))
        assert sum(r.n_words_deleted > 0 for r in got.values()) > 10


def test_runs_inside_lines(spark):
    run = " ".join(f"w{i}" for i in range(60))
    rows = [(1, run, 1), (2, f"head {run} tail", 2), (3, f"a\nb {run}\nend\n", 3), (4, f"a\n{run} b", 4), (5, None, 5), (None, f"x {run}", 6), (6, f"{run} y", 7), (6, f"{run} y", 7), (7, run, 8), (8, f"mid {run}", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_ int")
    out = passage_dedup(df)
    assert out.columns == ["doc_id", "text", "gone_", "n_words_deleted"]
    got = sorted(((r.doc_id, r.text, r.n_words_deleted) for r in out.collect()), key=str)
    # The row without a doc_id is the first.
    assert got == sorted([(1, "", 60), (2, "head tail", 60), (3, "a\nb\nend\n", 60), (4, "a\nb", 60), (5, None, 0), (None, f"x {run}", 0), (6, "y", 60), (6, "y", 60), (7, "", 60), (8, "mid", 60)], key=str)
    assert passage_dedup(df.limit(0)).count() == 0


def test_the_pipeline_cuts_runs_inside_lines(spark):
    run = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"one {run} two", "en", "a", 0), (2, f"three {run} four", "en", "a", 0), (3, f"five\n{run} six", "en", "a", 0), (4, run, "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert {r.n_lines_deleted for r in line_dedup(df).collect()} == {0}
    got = {r.doc_id: (r.text, r.n_chars) for r in dict(cp.STAGES)["line_dedup"](spark, df, "").collect()}
    assert got == {1: (f"one {run} two", 0), 2: ("three four", 10), 3: ("five\nsix", 8)}
