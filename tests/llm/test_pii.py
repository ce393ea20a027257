import hashlib
import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from heaplens.llm import op3_pii as op


def plain(text):
    """The base rules as they are stated."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


PARTS = st.sampled_from(["a", "b.c", "@", "x@y.z", "@x.y", ".", "..", "1", "12", "255", "256", "1.2.3.4", "4111111111111111", "4111 1111-1111 1111", "+", "+1 (017) 555-7713", "-", " ", "(", ")", "é", "😀", "%", "_", "٣"])


@given(st.lists(PARTS, max_size=14))
@settings(max_examples=500, deadline=None)
def test_base_spans_are_those_of_the_patterns(parts):
    assert op.base_spans("".join(parts)) == plain("".join(parts))


def test_long_texts_take_linear_time():
    for unit in ("a", "1", "a@", "1.", "+1", "1 ", "(at)", "@", "Mr. A "):
        op.candidates(unit * 60_000)


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.4
    right = np.array([0.95, 0.85, 0.7, 0.9, 0.6])
    votes = np.where(rng.random((20_000, 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    p, rates = op.reliabilities(votes, np.ones(20_000))
    assert ((p > 0.5) == truth).mean() > 0.93
    assert np.abs(rates[1, :, 2] / (rates[1, :, 1] + rates[1, :, 2]) - right).max() < 0.05


def test_classifier_fits_soft_labels():
    rows, p = [[1, 5], [2, 5]] * 500, np.array([0.9, 0.2] * 500)
    q = 1 / (1 + np.exp(-op.score([[1, 5], [2, 5], [5]], op.fit(rows, p))))
    assert abs(q[0] - 0.9) < 0.02 and abs(q[1] - 0.2) < 0.02 and 0.2 < q[2] < 0.9


def test_numbers_of_any_length():
    assert op.base_spans("0" * 5000 + ".1.1.1") == [(1, 0, 5006)]
    assert op.base_spans("9" * 5000 + ".1.1.1 1.1." + "7" * 6000 + ".1") == []
    for t in ("0" * 5000 + ".1.1.1", "9" * 1_000_000, "DE12" + "1234" * 100_000, "+" + "1" * 1_000_000, "1.1.1." * 200_000):
        op.candidates(t)


def test_many_spans_in_a_text_take_linear_time():
    seconds = []
    for n in (2_000, 16_000):
        text = "".join(f"joe{i}@mail.example.com Mr. Adam Berg 212-555-01{i % 90 + 10} " for i in range(n))
        began = time.perf_counter()
        spans = op.candidates(text)
        seconds.append(time.perf_counter() - began)
        assert sum(s["kind"] == 0 for s in spans) == n and len(spans) >= 2 * n
    assert seconds[1] < 24 * seconds[0]


def test_overlaps_against_brute_force():
    rng = random.Random(6)
    parts = ["joe@mail.example.com", "4111 1111 1111 1111", "+1 (212) 555-7713", "(212) 555-7713", "4111-1111-1111-1112", "Mr. Berg", "10.2.3.4", "078-05-1120", " ", " ", "x"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(12))
        base = op.base_spans(text)
        want = base + [c for c in op.loose_spans(text) if not any(s < c[2] and e > c[1] for _, s, e in base)]
        assert [(c["kind"], c["start"], c["end"]) for c in op.candidates(text)] == want


def test_planted_spans_are_added_and_decoys_left(spark):
    """Precision and recall of added spans, over contexts of which the labelers know a part only."""
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: rng.choice("lorem ipsum dolor sit amet consectetur adipiscing elit".split())
    rows, planted = [], set()
    for i in range(1500):
        kind = rng.choice(["ssn", "phone_loose", "email_words", "decoy", "decoy", "none"])
        lead = " ".join(word() for _ in range(8))
        if kind == "ssn":
            cue, span = rng.choice(["ssn", "social security", "taxpayer", "insured under"]), f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{digits(3)}7"
        elif kind == "phone_loose":
            cue, span = rng.choice(["phone", "call", "reach me", "ring"]), f"({rng.randint(210, 899)}) {rng.randint(210, 899)}-{digits(4)}"
        elif kind == "email_words":
            cue, span = rng.choice(["email", "contact", "ping"]), f"joe{i} [at] mail{i % 9} [dot] com"
        elif kind == "decoy":
            cue, span = rng.choice([("serial", f"0{digits(15)}"), ("version", f"000-{digits(2)}-0000"), ("order", f"9{digits(15)}"), ("figure", f"9{digits(2)}-00-{digits(4)}"), ("part no", f"1{digits(2)} 0{digits(2)} {digits(4)}")])
        else:
            cue, span = "", ""
        rows.append((i, f"{lead} {cue} {span} {word()} joe@mail.example.com phone +1 (212) 555-7713 from 10.2.3.4"))
        if kind not in ("decoy", "none"):
            planted.add((i, kind))
    got = op.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {(r.doc_id, s.split(":")[0]) for r in got for s in r.spans.split(",") if s.split(":")[0] in op.MORE}
    right = len(added & planted)
    print("precision", right / max(1, len(added)), "recall", right / len(planted))
    assert right >= 0.95 * len(added) and right >= 0.9 * len(planted)


def test_query_columns_and_added_spans(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        parts = [" ".join(rng.choice(["lorem", "ipsum", "dolor"]) for _ in range(20))]
        if i % 2:
            parts.insert(0, f"email joe{i}@mail.example.com card 4111 1111 1111 1111")
        if i % 3 == 0:
            parts.append(f"phone ({rng.randint(210, 899)}) {rng.randint(210, 899)}-{rng.randint(1000, 9999)} end")
        if i % 5 == 0:
            parts.append(f"version {rng.randint(10**15, 10**16 - 1)}=x")
        rows.append((i, "\n".join(parts)))
    rows += [(900, None), (901, ""), (None, "x"), (900, "a@b.c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as kind")
    got = op.personal_data(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 900:
            base = plain(rows[r.doc_id][1])
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
            assert r.base_sha256 == hashlib.sha256(op.told(base).encode()).hexdigest()
            assert set(filter(None, op.told(base).split(","))) <= set(r.spans.split(","))
            assert ("phone_loose" in r.spans) == (r.doc_id % 3 == 0)
            assert "card_loose" not in r.spans
    assert op.personal_data(df.limit(0)).count() == 0
