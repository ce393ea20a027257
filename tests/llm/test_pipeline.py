import corpus_pipeline as cp
from heaplens.llm.common import read
from heaplens.llm.op10_nbest import lattice
from heaplens.llm.queries import tokenizer_path
from tests.llm.test_jaccard_join import brute as components_of
from tests.llm.test_line_dedup import brute as cut_lines

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_predecessor(spark):
    docs = read(spark, SF, "documents").checkpoint() if spark.sparkContext.getCheckpointDir() else read(spark, SF, "documents")
    one = cp.language_stage(spark, docs, SF)
    assert one.columns == list(cp.COLUMNS)
    before = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.text for r in one.collect()}
    assert got == {d: t for d, t in before.items() if t and any(c.isalpha() for c in t)}

    two = cp.line_stage(spark, one, SF)
    want = {d: t for d, t in cut_lines(got, 50).items() if t == got[d] or t.split()}
    cut = {r.doc_id: r.text for r in two.collect()}
    assert cut == want and two.columns == list(cp.COLUMNS)

    three = cp.near_duplicate_stage(spark, two, SF)
    kept = {r.doc_id: r.text for r in three.collect()}
    assert set(kept) == {d for d, _, c in components_of(list(cut.items())) if d == c}

    four = cp.mixing_stage(spark, three, SF)
    sampled = {r.doc_id: r.text for r in four.collect()}
    assert set(sampled) <= set(kept) and sum(map(len, sampled.values())) > 0.7 * sum(map(len, kept.values()))

    last = {r.doc_id: r for r in cp.segmentation_stage(spark, four, SF).collect()}
    lat = lattice(tokenizer_path("piece_bpe_32k.model"))
    assert set(last) == set(sampled)
    for d, t in sampled.items():
        assert last[d].score == lat.encode([t], 1)[0][0][0]


def test_run_gives_the_last_stage(spark):
    assert cp.run(spark, SF).count() > 50
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "jaccard_join", "mixing", "nbest"]


LONG = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, row_ string, n_lines_deleted int, component_id long, topic string, score double"


def odd(spark):
    """Nulls in every column, empty texts, repeated rows and ids, a long text, and columns of clashing names."""
    plain = [(i, f"some ordinary words of document {chr(97 + i)} and a few {chr(98 + i)} more", "en", "a", 9) for i in range(10, 16)]
    rows = [(1, LONG, "en", "a", 1), (2, LONG, "en", None, 2), (2, LONG, "en", None, 2), (None, LONG, None, "a", None), (3, None, "en", "a", 3), (4, "", "en", "a", 4), (5, "12 !", "en", "a", 5), (6, LONG[:300], None, None, None), (7, "very long words " * 30_000, "en", "a", 7), *plain]
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 0.5) for r in rows], SCHEMA)


def test_every_stage_takes_odd_rows(spark):
    df = odd(spark)
    ids = lambda d: sorted((r.doc_id for r in d.collect()), key=str)
    stages = dict(cp.STAGES)
    for name, stage in cp.STAGES:
        empty = stage(spark, df.limit(0), SF)
        assert empty.count() == 0 and (name == "nbest" or empty.columns == list(cp.COLUMNS))
    found = stages["language_id"](spark, df, SF)
    assert found.columns == list(cp.COLUMNS) and ids(found) == sorted([1, 2, 2, None, 6, 7, *range(10, 16)], key=str)
    assert {r.lang for r in found.collect()} == {"en"}
    cut = stages["line_dedup"](spark, df, SF)
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in cut.collect()), key=str)
    # The row without a doc_id comes first, so the copies with an id go; what is null or empty stays.
    assert [x[:1] for x in got if x[1] == LONG] == [(None,)] and {3, 4, 5} <= {x[0] for x in got} and 1 not in {x[0] for x in got}
    near = stages["jaccard_join"](spark, df, SF)
    assert ids(near) == sorted([1, None, 3, 4, 5, 6, 7, *range(10, 16)], key=str)
    # Equal ids stay together where they stand for their group.
    assert ids(stages["jaccard_join"](spark, df.where("doc_id = 2 or doc_id > 5"), SF)) == [10, 11, 12, 13, 14, 15, 2, 2, 6, 7]
    mixed = ids(stages["mixing"](spark, df, SF))
    assert set(mixed) <= set(ids(df)) and mixed.count(2) in (0, 2)
    last = stages["nbest"](spark, df, SF)
    assert ids(last) == ids(df)
