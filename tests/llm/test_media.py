import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heaplens.llm import op6_media as op


@given(st.text(max_size=500))
@settings(max_examples=100, deadline=None)
def test_images_round_trip(text):
    n, payload = op.payload_of(text)
    assert len(payload) % 192 == 0 and len(payload) > 0 and payload.rstrip(b" ") == text.encode().rstrip(b" ")
    image = op.to_png(n, payload)
    assert op.from_png(image) == (n, payload)
    assert op.feature(payload) == op.feature(bytes(payload))
    for k in (9, len(image) // 2, len(image) - 2):
        with pytest.raises((ValueError, zlib.error)):
            op.from_png(image[:k] + bytes([image[k] ^ 1]) + image[k + 1 :])


def test_query(spark, monkeypatch):
    monkeypatch.setattr(op, "RANGE", 700)
    monkeypatch.setattr(op, "BATCH", 500)
    rows = [(i, f"é text {i % 7} " * (i % 40)) for i in range(200)] + [(7, "again"), (None, "x"), (500, None), (501, " " * 192), (502, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media")
    got = op.media_features(op.media_column(df)).collect()
    key = lambda d, t: (str(d), hashlib.sha256(op.payload_of(t)[1]).hexdigest(), op.payload_of(t)[0])
    assert sorted((str(r.doc_id), r.payload_sha256, r.n_bytes) for r in got) == sorted(key(d, t) for d, t in rows)
    for r in got:
        assert r.payload_bytes == max(192, -(-r.n_bytes // 192) * 192)
    one = next(r for r in got if r.doc_id == 500)
    assert (one.n_bytes, one.payload_bytes, one.tail_crc32) == (0, 192, zlib.crc32(b" " * 16))
    by = {}
    for r in got:
        by.setdefault((r.payload_sha256, r.n_bytes), set()).add((r.media_sha256, r.media_bytes, r.feature, r.tail_crc32))
    assert all(len(v) == 1 for v in by.values())
    assert op.media_features(op.media_column(df.limit(0))).count() == 0


class Flaky:
    """A file system whose ranges of several members come back damaged and whose single members fail at first."""

    def __init__(self, inner, bad, fail):
        self.inner, self.bad, self.fail, self.reads = inner, bad, fail, []

    def get_file_info(self, path):
        return self.inner.get_file_info(path)

    def open_input_file(self, path):
        return FlakyFile(self, self.inner.open_input_file(path))


class FlakyFile:
    def __init__(self, system, f):
        self.system, self.f = system, f

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def read_at(self, n, offset):
        data, s = bytearray(self.f.read_at(n, offset)), self.system
        s.reads.append((offset, n))
        if offset == s.bad and s.fail > 0 and (offset, n) in s.single:
            s.fail -= 1
            raise OSError("not now")
        if offset <= s.bad < offset + n and (offset, n) not in s.single and n > 100 and offset < s.directory:
            data[s.bad - offset + 30] ^= 1
        return bytes(data)


def test_members_are_read_again_by_offset(spark, monkeypatch, tmp_path):
    import json

    import numpy as np

    df = spark.createDataFrame([(i, f"text {i} " * 60) for i in range(9)], "doc_id long, text string").coalesce(1)
    found = op.write_archives(df, str(tmp_path)).collect()
    (tmp_path / "m.json").write_text(json.dumps([(r.path, r.directory) for r in found]))
    inner, base = op.filesystem(str(tmp_path))
    raw = open(found[0].path, "rb").read()
    table = np.frombuffer(raw[found[0].directory : -op.FOOTER_SIZE], op.ENTRY)
    for fail, works in ((2, True), (op.RETRIES, False)):
        system = Flaky(inner, int(table["offset"][4]), fail)
        system.single, system.directory = {(int(o), int(n)) for o, n in zip(table["offset"], table["length"])}, found[0].directory
        monkeypatch.setattr(op, "filesystem", lambda uri, s=system: (s, base))
        reader = op.ArchiveReader({"folder": str(tmp_path), "manifest": "m.json"})
        part = op.Ranges([(found[0].path, found[0].directory, 0, found[0].directory)])
        if works:
            rows = [d for b in reader.read(part) for d in zip(*(c.to_pylist() for c in b.columns))]
            assert [d for d, _ in rows] == list(range(9)) and op.from_png(rows[4][1])[1].startswith(b"text 4 ")
            assert sum(r in system.single for r in system.reads) == 3
        else:
            with pytest.raises(OSError, match="cannot be read"):
                list(reader.read(part))


def test_ranges_cover_every_byte_once_in_a_bounded_number():
    archives = [("a", 100), ("b", 7), ("c", 1000), ("d", 0), ("e", 50)]
    for size, most in ((30, 1000), (1, 9), (10_000, 5)):
        parts = op.planned(archives, size, most)
        pieces = sorted(p for r in parts for p in r.pieces)
        for path, directory in archives:
            mine = [(low, high) for p, _, low, high in pieces if p == path]
            assert [x for low, high in mine for x in range(low, high)] == list(range(directory))
        assert len(parts) <= max(most, -(-1157 // size)) and len(parts) <= -(-1157 // size)
    assert len(op.planned(archives, 1, 9)) <= 9 and op.planned([], 1, 9) == []
