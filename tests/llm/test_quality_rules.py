import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heaplens.llm.op2_quality_rules import ERROR, MEASURES, merged, quality_rules, quantiles, repeated_words, sketches, with_ratios
from heaplens.llm.shingles import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeats = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeats)


TEXTS = [None, "", " \n\t", "a", "a b a b a b", "é ß x\n\né ß x\n #|", "x y z " * 30, " ".join(f"w{i}" for i in range(60)), "word " * 3000, "a b\x0bc\x0ca b c\ra b c"]


def test_base_columns(spark):
    df = spark.createDataFrame([(i, t, "en", None, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_words int")
    for r in quality_rules(df).collect():
        want = base(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality_rules(df.limit(0)).count() == 0


@given(st.lists(st.sampled_from("abc"), max_size=20))
@settings(max_examples=200, deadline=None)
def test_repeated_words(words):
    hashes, _ = word_hashes([" ".join(words)], lower=False)
    assert repeated_words(hashes) == base(" ".join(words))[4]


def test_limits_follow_the_group(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        group, junk = i % 3, i % 50 == 49
        size = (4, 9, 4)[group]
        words = ["".join(rng.choice("abcdefghij") for _ in range(size + rng.randint(-1, 1))) for _ in range(80)]
        rows.append((i, " ".join(w + "###" * junk for w in words), ("en", "de", None)[group], ("s", "t", "s")[group]))
    odd = " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(80))
    rows += [(1000, odd, "en", "s"), (1001, odd, "de", "t"), (1002, odd, "de", "rare"), (1003, None, None, None)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept != (i % 50 == 49) for i in range(900))
    assert [got[i].kept for i in range(1000, 1004)] == [False, True, True, False]


def test_sketches_merge_and_bound_their_error(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice("xyz"), 100, rng.randint(100, 5000), rng.choice([0, 0, 3]), 0, 0, 9) for _ in range(600)]
    m = with_ratios(spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"))
    cells = sketches(m)
    q = {(r.lang, r.measure): r for r in quantiles(merged(cells, "lang"), "lang").collect()}
    for lang in "ab":
        xs = sorted(r[3] / 100 for r in rows if r[0] == lang)
        for share, value in ((0.25, q[lang, "word_length"].q1), (0.75, q[lang, "word_length"].q3)):
            assert value == pytest.approx(xs[-(-int(share * len(xs) * 4) // 4) - (share * len(xs) == int(share * len(xs)))], rel=2 * ERROR + 0.05)
        assert q[lang, "dup_lines"].q3 == pytest.approx(0.1, rel=2 * ERROR) and q[lang, "symbols"].docs == len(xs)
    assert {r.measure for r in cells.select("measure").distinct().collect()} == set(MEASURES)


def test_no_constant_decides(spark):
    """Rare symbols go where texts are long and even, and stay where the group's own texts are short and mixed."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(900, 1100))), "en", "long") for i in range(200)]
    rows += [(1000 + i, " ".join(word() for _ in range(rng.randint(50, 900))), "en", "mixed") for i in range(200)]
    marked = " ".join(word() + "#" * (i % 40 == 0) for i in range(1000))
    rows += [(5000, marked, "en", "long"), (5001, marked, "en", "mixed"), (None, marked, "en", "long"), (5000, marked, "en", "long")]
    got = [(r.doc_id, r.kept) for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()]
    assert sorted((x for x in got if x[0] is None or x[0] >= 5000), key=str) == sorted([(5000, False), (5001, True), (None, False), (5000, False)], key=str)
    assert all(kept for d, kept in got if d is not None and d < 1000)
