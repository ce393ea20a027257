import json
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heaplens.llm import huffman
from heaplens.llm import op8_token_output as op
from heaplens.llm.op8_token_output import WordEncoder, read_tokens, token_output
from heaplens.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
ROOT = Path(__file__).resolve().parents[2]


@given(st.lists(st.integers(0, 300), max_size=700), st.integers(9, 20))
@settings(max_examples=60, deadline=None)
def test_codes_are_prefix_free_bounded_and_round_trip(ids, limit):
    ids = np.array(ids, np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=301), limit)
    codes = huffman.canonical_codes(lengths)
    assert lengths.max(initial=0) <= limit
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    dictionary = huffman.pack_lengths(lengths)
    blob, decoder = huffman.pack(np.array([5]), np.array([len(ids)]), ids, dictionary, codes), huffman.Decoder(dictionary)
    assert decoder.unpack(blob)[2].tolist() == ids.tolist()
    other = huffman.Decoder(huffman.pack_lengths(np.array([1, 1], np.uint8)))
    for damaged, by in ((blob[:-1], decoder), (blob[:9] + bytes([blob[9] ^ 1]) + blob[10:], decoder), (blob, other)):
        with pytest.raises(ValueError):
            by.unpack(damaged)
    with pytest.raises(ValueError):
        huffman.Decoder(dictionary[:-1])


def test_lengths_are_optimal_without_a_binding_limit():
    import heapq

    counts = np.random.default_rng(0).integers(1, 1000, 60)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert int((counts * huffman.code_lengths(counts).astype(int)).sum()) == cost


@given(st.lists(st.sampled_from(["the", "Thé", "don't", "A.", "b,", "x1.", "!!,", "ß", "ΣΑΣ", "é", " ", "İ", "<|endoftext|>", "<|EndOfText|>", "\x01", "é.", "…", "日本", " ", "\n", "\t"]), max_size=12), st.sampled_from(["", " "]))
@settings(max_examples=300, deadline=None)
def test_word_by_word_is_the_library(parts, joint):
    enc = WordEncoder.__dict__.get("_one") or WordEncoder(PATH)
    WordEncoder._one = enc
    text = joint.join(parts)
    assert np.frombuffer(enc.batch([text])[0], enc.width).tolist() == enc.lib.encode(text, add_special_tokens=False).ids


class Counted(dict):
    looked = 0

    def get(self, *a):
        self.looked += 1
        return super().get(*a)

    def __getitem__(self, k):
        self.looked += 1
        return super().__getitem__(k)


def test_words_are_looked_up_once_for_many_texts():
    enc = WordEncoder(PATH)
    enc.cache = Counted()
    texts = ["one two, Two. \u00c9t\u00e9, \u00e9t\u00e9 x1. don't x1 don't, ... " * 50, None, "two one <|endoftext|> two", "", "\n one\t"] * 40
    got = enc.batch(texts)
    assert [np.frombuffer(x, enc.width).tolist() for x in got] == [enc.lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert enc.cache.looked < 100  # about 20 different words, 22,000 in all


@pytest.mark.parametrize("bound", [1, 12, 1 << 23])
def test_runs_cover_all_rows_and_keep_to_their_size(monkeypatch, bound):
    monkeypatch.setattr(op, "LOOKUP_BYTES", bound)
    texts = pa.array(["skipped", "four", None, "", "a text longer than a run", "four", "four", "four", None])[1:]
    runs = list(op.runs(texts))
    assert [i for first, n in runs for i in range(first, first + n)] == list(range(len(texts)))
    assert all(n == 1 or sum(len(t or "") for t in texts.slice(first, n).to_pylist()) <= bound for first, n in runs)
    enc = WordEncoder(PATH)
    got = [x for first, n in runs for x in enc.column(texts.slice(first, n), b"\1\0").to_pylist()]
    assert [np.frombuffer(x, enc.width).tolist() for x in got] == [enc.lib.encode(t or "", add_special_tokens=False).ids + [1] for t in texts.to_pylist()]


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(op, "CACHE_WORDS", 3)
    enc = WordEncoder(PATH)
    for text in ("one two three", "one four, Two", "five one x1 six seven", "one"):
        assert np.frombuffer(enc.batch([text])[0], enc.width).tolist() == enc.lib.encode(text, add_special_tokens=False).ids


def test_output(spark):
    rows = [(9, "Some words, some more."), (2, None), (4, ""), (None, "x"), (3, "long " * 40000), (3, "again"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as start")
    got = token_output(df, PATH, with_ids=True).collect()
    lib = WordEncoder(PATH).lib
    want = sorted((d, lib.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows if d is not None)
    assert sorted((r.doc_id, r.ids) for r in got if r.doc_id is not None) == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 2, 2, 3, 3, 4, 9]
    assert token_output(df.limit(0), PATH).count() == 0


FRESH = """
import json, sys
import pyarrow.parquet as pq
from heaplens.llm.huffman import Decoder
folder = sys.argv[1]
decoder = Decoder(open(folder + "/codes.hltd", "rb").read())
for row in sorted(pq.read_table(folder + "/manifest").to_pylist(), key=lambda r: (r["part"], r["seq"])):
    docs, sizes, ids = decoder.unpack(open(folder + "/" + row["file"], "rb").read())
    at = 0
    for d, n in zip(docs.tolist(), sizes.tolist()):
        print(json.dumps([d, ids[at : at + n].tolist()]))
        at += n
"""


def test_a_fresh_process_decodes_the_files(spark, tmp_path):
    rows = [(d, f"word{d} some more words, and {d * 7} of them") for d in range(200)] + [(5, "again")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    token_output(df, PATH, folder=str(tmp_path / "files"))
    done = subprocess.run([sys.executable, "-c", FRESH, str(tmp_path / "files")], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120)
    got = [json.loads(x) for x in done.stdout.splitlines()]
    lib = WordEncoder(PATH).lib
    assert sorted(got) == sorted([d, lib.encode(t, add_special_tokens=False).ids + [1]] for d, t in rows)
    assert [d for d, _ in got] == sorted(d for d, _ in rows)
    again = read_tokens(spark, str(tmp_path / "files"), with_ids=True).orderBy("start").collect()
    assert [[r.doc_id, r.ids] for r in again] == got
