"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

One pass over the texts finds the base spans and looser candidates, with each candidate's votes (1, 0 or
none) and hashed features of what the labelers don't look at: trigrams of the span's shape, the words around
it, its checksum. Combinations of kind and votes are few (``MAX_COMBOS``), so they are counted over the whole
corpus with partial counts per task. EM on the counts estimates how reliable each labeler is when the true
label is and is not personal data (Dawid and Skene, 1979). Its posteriors are the soft labels of a logistic
classifier of the features, which knows the votes of no candidate; it is fitted on a sample by hash of about
``SAMPLE`` candidates. Candidates that it gives at least ``SURE`` are added unless they overlap a base span;
base spans always stay.

Edge cases: null texts count as empty; repeated rows and null or repeated doc_ids are rows like others; of
candidates that overlap, the first one goes, of those that start together (ties) the longest, then the kind
that is listed first; very long texts are scanned whole in time in proportion to the text, the spans of one
text being held together; further columns, whatever their names, are ignored; an empty table gives an empty
result; without candidates there is no model.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heaplens.llm.common import Scratch
from heaplens.llm.shingles import slices

#: The base kinds in order, then those of candidates only.
BASE = ("email", "ip", "card", "phone")
MORE = ("phone_loose", "card_loose", "ssn", "iban", "email_words", "person")
KINDS = BASE + MORE
#: Probability from which a candidate is personal data.
SURE = 0.9
#: Bound on the combinations that are counted: 10 kinds, 3**5 vote patterns.
MAX_COMBOS = len(KINDS) * 3**5
#: Candidates that the classifier learns from (expected number, by hash) and the buckets of its features.
SAMPLE, FEATURES = 10_000, 1 << 13
#: Steps, step size and ridge of the classifier's fit.
STEPS, RATE, RIDGE = 150, 0.1, 1e-4
#: Characters before and after a span in which context labelers look for cues.
REACH = 40

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = {
    "phone_loose": re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "email_words": re.compile(r"\b[A-Za-z0-9._-]{1,40} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,40} ?[\[(]dot[\])] ?[A-Za-z]{2,10}\b"),
    "person": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señor|Señora)\.? [A-ZÀ-Þ]\w{1,30}(?: [A-ZÀ-Þ]\w{1,30})?"),
}
#: Cue words per family of kinds, in the four languages, and cues that speak against any.
CUES = {
    "email": ("email", "e-mail", "mail", "correo", "courriel", "contact", "kontakt", "write to"),
    "ip": ("ip", "host", "server", "address", "login", "logged", "client"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "anruf"),
    "ssn": ("ssn", "social security", "tax id"),
    "iban": ("iban", "account", "konto", "cuenta", "compte", "bank"),
    "person": ("name", "dear", "regards", "signed", "born"),
}
AGAINST = ("version", "license", "isbn", "order", "invoice", "serial", "doi", "part no", "figure", "chapter", "$", "€", "%", "#")
#: A gazetteer of given names, mail hosts' last labels, IBAN countries and reserved numbers.
GIVEN = frozenset("james mary john patricia robert jennifer michael linda william elizabeth david maria anna peter hans klaus ursula pierre marie jean jose carmen juan luis carlos sofia lucas emma louis thomas".split())
TOP_LEVEL = frozenset("com org net edu gov de fr es uk eu io info".split())
IBAN_LANDS = frozenset("AT BE CH DE ES FR GB IE IT LU NL PT".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans, by kind, then start."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            # The local part is the longest run before the sign that no earlier match has taken.
            start = at
            while start > done and LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                done = m.end()
                at = m.end() - 1
        at = text.find("@", at + 1)
    if not DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(q) < 4 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in m[0].split(".")))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


DIGIT = re.compile("[0-9]")


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the candidates beyond the base patterns."""
    out = []
    if DIGIT.search(text):
        for name in ("phone_loose", "ssn", "iban"):
            out += [(KINDS.index(name), m.start(), m.end()) for m in LOOSE[name].finditer(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(re.sub("[ -]", "", m[0])) <= 19:
                out.append((KINDS.index("card_loose"), m.start(), m.end()))
    if "at]" in text or "at)" in text:
        out += [(KINDS.index("email_words"), m.start(), m.end()) for m in LOOSE["email_words"].finditer(text)]
    out += [(KINDS.index("person"), m.start(), m.end()) for m in LOOSE["person"].finditer(text)]
    return out


def family(kind: int) -> str:
    return KINDS[kind].split("_")[0]


def checks_out(kind: int, span: str) -> int:
    """Labeler: the number's own redundancy. 1 valid, 0 not, -1 no opinion."""
    name, digits = family(kind), re.sub(r"\D", "", span)
    if name == "card":
        return int(luhn(digits) and digits[0] in "3456")
    if name == "iban":
        s = span.replace(" ", "")
        return int(int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1)
    if name == "ssn":
        return int(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
    if name == "phone":
        return int(len(set(digits)) > 2) if KINDS[kind] == "phone" else int(digits[0] not in "01" and digits[3] not in "01")
    return -1


def listed(kind: int, span: str) -> int:
    """Labeler: gazetteers."""
    name = family(kind)
    if name == "email":
        return int(re.split(r"\W+", span.lower().rstrip(")]"))[-1] in TOP_LEVEL)
    if name == "iban":
        return int(span[:2] in IBAN_LANDS)
    if name == "person":
        return 1 if any(w.lower() in GIVEN for w in span.split()[1:]) else -1
    if name == "ip":
        return 0 if span.startswith(("0.", "127.", "255.")) else 1
    return -1


def cued(kind: int, before: str) -> int:
    """Labeler: a cue word of the kind shortly before."""
    return 1 if any(w in before for w in CUES[family(kind)]) else -1


def warned(kind: int, before: str) -> int:
    """Labeler: a cue against personal data shortly before."""
    return 0 if any(w in before for w in AGAINST) else -1


def shaped(kind: int, span: str, left: str, right: str) -> int:
    """Labeler: grouping and surroundings of a written-out number or name."""
    if (left and (left.isalnum() or left in "_=/")) or (right and (right.isalnum() or right in "_=/")):
        return 0
    if family(kind) == "card":
        groups = [len(g) for g in re.split("[ -]", span)]
        return 1 if groups in ([4, 4, 4, 4], [16], [4, 6, 5]) else 0
    return 1


def shape(span: str) -> str:
    """The classes of the characters, runs of four at most."""
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in span))


def features(kind: int, span: str, before: str, after: str) -> list[int]:
    """Buckets of the kind, the span's shape trigrams and checksum, and the words around; no cue or list."""
    name, form = family(kind), f"^{shape(span)}$"
    told = [f"kind {KINDS[kind]}", f"{name} check {checks_out(kind, span)}"]
    told += [f"{name} shape {form[i : i + 3]}" for i in range(len(form) - 2)]
    told += [f"{name} before {w}" for w in re.findall(r"\w+", before)[-3:]] + [f"{name} after {w}" for w in re.findall(r"\w+", after)[:1]]
    return sorted({zlib.crc32(t.encode("utf-8", "surrogatepass")) % FEATURES for t in told})


def candidates(text: str) -> list[dict]:
    """Base spans and candidates that don't repeat one, with votes (base 3 digits) and features."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    # Ends that grow with the starts: the furthest end of the spans up to each one.
    starts, ends, out = [s for s, _ in taken], [], []
    for _, e in taken:
        ends.append(max(e, ends[-1]) if ends else e)
    for kind, start, end in base + loose_spans(text):
        if kind >= len(BASE):
            at = bisect_right(starts, end - 1)
            if at and ends[at - 1] > start:
                continue
        span, before = text[start:end], text[max(0, start - REACH) : start].lower()
        votes = 0
        for v in (checks_out(kind, span), listed(kind, span), cued(kind, before), warned(kind, before), shaped(kind, span, text[start - 1 : start], text[end : end + 1])):
            votes = votes * 3 + v + 1
        out.append({"kind": kind, "start": start, "end": end, "votes": votes, "features": features(kind, span[:200], before, text[end : end + REACH].lower())})
    return out


SPANS = "array<struct<kind:int,start:int,end:int,votes:int,features:array<int>>>"


def found(docs: DataFrame) -> DataFrame:
    """doc_id, spans of each row."""
    item = pa.struct([*((n, pa.int32()) for n in ("kind", "start", "end", "votes")), ("features", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in slices(b, 1):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array([candidates(t or "") for t in texts], pa.list_(item))], ["doc_id", "spans"])

    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def votes_of(votes: np.ndarray) -> np.ndarray:
    """The five votes (-1, 0, 1) of each pattern."""
    return np.stack([votes // 3**k % 3 - 1 for k in range(4, -1, -1)], 1)


def reliabilities(votes: np.ndarray, n: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of personal data of each row, rates[label, labeler, vote + 1]) by EM; n: the rows' counts."""
    cast = (votes >= 0).sum(1)
    p = np.where(cast > 0, (votes == 1).sum(1) / np.maximum(cast, 1), 0.5) * 0.8 + 0.1
    for _ in range(steps):
        prior = np.clip((p * n).sum() / n.sum(), 0.01, 0.99)
        rates = np.empty((2, votes.shape[1], 3))
        for y, w in ((0, (1 - p) * n), (1, p * n)):
            for v in range(3):
                rates[y, :, v] = (w[:, None] * (votes == v - 1)).sum(0) + 1.0
        rates /= rates.sum(2, keepdims=True)
        at = np.arange(votes.shape[1])
        odds = np.log(prior / (1 - prior)) + (np.log(rates[1, at, votes + 1]) - np.log(rates[0, at, votes + 1])).sum(1)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, rates


def score(rows: list[list[int]], w: np.ndarray) -> np.ndarray:
    """Log-odds of rows of feature buckets; the last weight is the constant."""
    sizes = np.array([len(r) for r in rows], np.int64)
    every = np.concatenate([np.array(r, np.int64) for r in rows])
    return np.add.reduceat(w[every], np.cumsum(sizes) - sizes) + w[-1]


def fit(rows: list[list[int]], p: np.ndarray) -> np.ndarray:
    """Logistic regression of soft labels p on feature buckets, by Adam with a fixed number of steps."""
    sizes = np.array([len(r) for r in rows], np.int64)
    every, at = np.concatenate([np.array(r, np.int64) for r in rows]), np.repeat(np.arange(len(rows)), sizes)
    w, first, second = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for step in range(1, STEPS + 1):
        error = 1 / (1 + np.exp(-np.clip(score(rows, w), -30, 30))) - p
        grad = np.append(np.bincount(every, error[at], FEATURES), error.sum()) / len(rows) + RIDGE * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def classifier(spans: DataFrame, size: int = SAMPLE) -> np.ndarray | None:
    """Weights of the features, from EM on the counts of votes and a sample of the candidates."""
    each = spans.select(F.explode("spans").alias("s"))
    rows = each.groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()  # MAX_COMBOS at most
    if not rows:
        return None
    n = np.array([r.n for r in rows])
    p, _ = reliabilities(votes_of(np.array([r.votes for r in rows])), n)
    soft = {(r.kind, r.votes): x for r, x in zip(rows, p, strict=True)}
    drawn = F.pmod(F.xxhash64(F.lit(3), "doc_id", "s.start", "s.kind"), F.lit(1 << 30)) < int(min(1.0, size / n.sum()) * (1 << 30))
    sample = spans.select("doc_id", F.explode("spans").alias("s")).where(drawn).select("s.kind", "s.votes", "s.features").collect()  # about ``size``
    told = sorted((list(r.features), soft[r.kind, r.votes]) for r in sample)
    return fit([f for f, _ in told], np.array([y for _, y in told])) if told else None


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of each row."""
    spans = Scratch(docs.sparkSession, "pii").table(found(docs), "spans")
    weights = classifier(spans)  # FEATURES numbers
    least = float(np.log(SURE / (1 - SURE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {c: [] for c in (*(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added")}
            for row in b.column(1).to_pylist():
                base = [(s["kind"], s["start"], s["end"]) for s in row if s["kind"] < len(BASE)]
                added, end = [], -1
                loose = sorted((s for s in row if s["kind"] >= len(BASE)), key=lambda s: (s["start"], -s["end"], s["kind"]))
                odds = score([s["features"] for s in loose], weights) if loose and weights is not None else [-1.0] * len(loose)
                for s, x in zip(loose, odds, strict=True):
                    if s["start"] >= end and x >= least:
                        added.append((s["kind"], s["start"], s["end"]))
                        end = s["end"]
                for i, k in enumerate(BASE):
                    out[f"n_{k}"].append(sum(x[0] == i for x in base))
                out["base_sha256"].append(hashlib.sha256(told(base).encode()).hexdigest())
                out["spans"].append(told(base + added))
                out["n_added"].append(len(added))
            kinds = {"base_sha256": pa.string(), "spans": pa.string()}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items())], ["doc_id", *out])

    kind = spans.schema["doc_id"].dataType.simpleString()
    return spans.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
