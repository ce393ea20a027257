import random

from heaplens.llm.op7_line_dedup import line_dedup


def brute(docs, least):
    """Lines in a run of at least so many words that occurred before, over all runs of all lengths."""
    parsed = [(d, [(i, x) for i, x in enumerate(t.split("\n")) if x.split()]) for d, t in sorted(docs.items())]
    first, gone = {}, {d: set() for d in docs}
    for d, lines in parsed:
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a : b + 1])
                if sum(len(x.split()) for x in run) >= least:
                    e, _, last = first.setdefault(run, (d, a, b))
                    low = max(a, last + 1) if e == d else a
                    if low <= b and (e, last) != (d, b):
                        gone[d].update(range(lines[low][0], lines[b][0] + 1))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs.items()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefghijkl") * 2 + str(i) for _ in range(rng.randint(1, 5))) for i in range(40)]
    docs = {}
    for d in range(60):
        lines = [f"own {d} {k}" for k in range(rng.randint(0, 3))]
        for _ in range(rng.randint(1, 3)):
            at, n = rng.randrange(40), rng.randint(1, 8)
            lines += pool[at : at + n] + rng.choice([[], [""], [f"end {d} {rng.random()}"]])
        docs[d] = "\n".join(dict.fromkeys(lines))
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 8).collect()}
    assert got == brute(docs, 8)
    assert sum(len(got[d]) < len(docs[d]) for d in docs) > 10


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "x", 1), (2, f"head\n{long}\ntail", "x", 2), (None, None, None, None), (None, "", None, 3), (3, long, "z", 4), (3, long, "z", 4), (4, f"a\n{long}\n\n{long}\nb", "y", 5), (5, "short\nshort", "q", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string, gone_ int")
    out = line_dedup(df)
    assert out.columns == ["doc_id", "text", "line", "gone_", "n_lines_deleted"]
    got = sorted(((r.doc_id, r.text, r.n_lines_deleted) for r in out.collect()), key=str)
    assert got == sorted([(1, long, 0), (2, "head\ntail", 1), (None, None, 0), (None, "", 0), (3, "", 1), (3, "", 1), (4, "a\n\nb", 2), (5, "short\nshort", 0)], key=str)
    assert line_dedup(df.limit(0)).count() == 0


def test_repeats_inside_one_document(spark):
    line = " ".join(f"w{i}" for i in range(30))
    got = line_dedup(spark.createDataFrame([(1, "\n".join([line] * 5))], "doc_id long, text string")).first()
    assert got.text == "\n".join([line] * 2)


def test_only_selected_positions_are_joined(spark):
    """Fingerprints are fewer than lines, and documents without a joined one are not looked at again."""
    from heaplens.llm.common import Scratch
    from heaplens.llm.op7_line_dedup import extended, hashed_lines, joined_positions, windows

    lone = "\n".join(" ".join(f"lone{i}x{k}" for k in range(5)) for i in range(80))
    run = "\n".join(" ".join(f"run{i}x{k}" for k in range(5)) for i in range(30))
    df = spark.createDataFrame([(1, lone), (2, "one line\n" + run), (3, run + "\nend line"), (4, "")], "doc_id long, text string")
    lines = hashed_lines(df).cache()
    marks = windows(lines, 50, False).select("doc_id", "text_hash", "mark_line", "mark").distinct()
    assert marks.where("doc_id = 1").count() < 40
    at = joined_positions(marks, Scratch(spark, "test"))
    assert {r.doc_id for r in at.select("doc_id").distinct().collect()} == {2, 3}
    found = extended(lines, at, 50).collect()
    # Every line of the run lies in an extended window, on both sides of the positions.
    assert {x for r in found if r.doc_id == 3 for x in range(r.start, r.end + 1)} >= set(range(30))
    assert {r.doc_id: r.n_lines_deleted for r in line_dedup(df).collect()} == {1: 0, 2: 0, 3: 30, 4: 0}
