import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from heaplens.llm.op10_nbest import Lattice, digest, lattice, nbest_segmentations
from heaplens.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def every_path(lat: Lattice, text: str):
    """(score, ids) of all segmentations of the whole normalised text, without units."""
    s = "▁" + text.replace(" ", "▁") if text else ""

    def walk(at):
        if at == len(s):
            yield 0.0, ()
            return
        edges = [(e, *lat.score[s[at:e]]) for e in range(at + 1, len(s) + 1) if s[at:e] in lat.score]
        heads = [(e, w, (i,)) for e, w, i in edges]
        if s[at] not in lat.score:
            b = s[at].encode()
            heads.append((at + 1, len(b) * lat.byte_score, tuple(lat.byte_id[x] for x in b)))
        for e, w, ids in heads:
            for score, rest in walk(e):
                yield w + score, ids + rest

    return sorted(walk(0), reverse=True)


TEXT = st.text(alphabet="ehtinr \né☃", max_size=9)


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_nbest_against_all_paths(text):
    lat = lattice(PATH)
    want, got = every_path(lat, text), lat.encode([text], 4)[0]
    assert len(got) == min(4, len(want))
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:4]])
    known = {ids: s for s, ids in want}
    seen = [tuple(np.frombuffer(ids, lat.width).tolist()) for _, ids in got]
    assert len(set(seen)) == len(seen)
    assert [s for s, _ in got] == pytest.approx([known[ids] for ids in seen])


@given(st.lists(TEXT, max_size=5))
@settings(max_examples=50, deadline=None)
def test_many_texts_at_once(texts):
    lat = lattice(PATH)
    units = list(dict.fromkeys(u for t in texts for u in lat.units([t])[0]))
    if units:
        for u, (score, loss, ids) in zip(units, lat.solve(units), strict=True):
            best = lat.nbest(u, 2)
            assert score == pytest.approx(best[0][0])
            assert loss == pytest.approx(best[0][0] - best[1][0]) if len(best) > 1 else np.isinf(loss)
            assert len(ids) and lat.decode(ids).lstrip() == u.replace("▁", " ").lstrip()


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_round_trip_as_the_library_decodes(text):
    lat, sp = lattice(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for _, ids in lat.encode([text], 3)[0]:
        assert lat.decode(ids) == text.replace("▁", " ") == sp.decode(np.frombuffer(ids, lat.width).tolist())


def test_cache_turnover(monkeypatch):
    from heaplens.llm import op10_nbest

    monkeypatch.setattr(op10_nbest, "CACHE_UNITS", 5)
    small, whole = Lattice(PATH), lattice(PATH)
    texts = [f"some words {i} and {i + 1} others here now" for i in range(30)]
    for k in range(0, 30, 3):
        assert small.encode(texts[k : k + 3]) == whole.encode(texts[k : k + 3])


def test_query(spark):
    rows = [(1, "The quick  brown\nfox."), (2, None), (3, ""), (None, "x"), (1, "é " * 30_000), (4, "a" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as decoded")
    out = nbest_segmentations(df, PATH)
    for r in out.join(df.select("text").distinct(), out.decoded == df.text).collect():
        assert r.decoded == r.text and len(r.ids) == r.nbest[0].n_tokens
    got = digest(out).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.n_tokens, r.n_best) for r in got if r.doc_id in (2, 3)} == {(2, None, None), (3, 0, 1)} or {(r.doc_id, r.n_tokens) for r in got if r.doc_id in (2, 3)} == {(2, None), (3, 0)}
    assert all(r.loss_2 >= 0 and r.loss_2 <= r.loss_3 for r in got if r.n_tokens and r.loss_3 is not None)
    assert digest(nbest_segmentations(df.limit(0), PATH)).count() == 0
