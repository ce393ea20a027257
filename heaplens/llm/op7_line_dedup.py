"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Lines are split at \\n and compared exactly; lines without a word are ignored in comparing. A window is the
shortest run of lines, forwards or backwards from some line, that has at least ``min_words`` words.

1. Fingerprints: each window selects its smallest line hash (of equal ones the first), so two equal runs of
   that many words select the same ones. Only the distinct selected positions go on.
2. Join: positions whose fingerprint was selected at more than one place stay, and with them their documents.
3. Extend: from each joined position to the left and to the right, to all windows that selected it. These are
   compared by 128-bit content keys with the earliest window of the same content; they start or end at every
   line of a repeated run, so a match reaches both ends of it.
4. A line goes if and only if it lies in a run of at least ``min_words`` words that occurred before, by
   (doc_id, text hash, line). The first occurrence stays whole; of a run that overlaps its own first
   occurrence what lies behind that goes.

Shuffles carry hashes and positions, never lines; texts move once, when they are put together again. Hot
fingerprints meet as partial minima before the shuffle and in skew-splittable joins after it, and every
later occurrence is paired with the first one only.

Edge cases: null texts stay null, empty ones empty; doc_ids may be null or repeated (rows equal in doc_id
and text count as one place and are treated alike, so repeated rows are cut alike); ties in line hashes go to
the first line; very long texts are rows of lines like others, and are put together in one row again;
further columns are kept, but for one of the name ``n_lines_deleted`` (``n_words_deleted``), which is
replaced; an empty table gives an empty result; a text whose lines all go becomes ''.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heaplens.llm.common import Scratch, partitions

#: Runs of at least so many words are looked for.
MIN_WORDS = 50


WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"
#: Words of a fingerprint of windows of words, if windows have as many.
MARK_WORDS = 8
#: Up to so many runs (16 bytes each) and texts that they lie in (100 bytes each) are sent to the executors, more
#: meet the texts by a shuffle that splits hot keys.
BROADCAST_RUNS, BROADCAST_DOCS = 2_000_000, 500_000
#: Low bits of a word's hash that give its place to the number of the word; no string has more words.
PLACE = (1 << 30) - 1


def words_in(c):
    return F.regexp_count(c, F.lit(WORD))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line, a, b (two hashes of the line), words; only lines with a word."""
    lines = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    lines = lines.select("doc_id", "text_hash", "line", F.xxhash64("content").alias("a"), F.xxhash64(F.lit(17), "content").alias("b"), words_in(F.col("content")).alias("words"))
    dealt = lines.where("words > 0").repartition(partitions(docs.sparkSession), "doc_id", "text_hash")
    return dealt.groupBy("doc_id", "text_hash", "line").agg(*[F.first(c).alias(c) for c in ("a", "b", "words")])


def windows(lines: DataFrame, min_words: int, content: bool) -> DataFrame:
    """doc_id, text_hash, start, end (lines, inclusive), mark (fingerprint), mark_line of each window.

    content: with k1, k2, two hashes of the window's lines.
    """
    doc = Window.partitionBy("doc_id", "text_hash")
    at = lines.withColumn("last", F.sum("words").over(doc.orderBy("line"))).withColumn("first", F.col("last") - F.col("words"))
    out = []
    for by, low, high in (("first", 0, min_words - 1), ("last", 1 - min_words, 0)):
        frame = doc.orderBy(by).rangeBetween(low, high)
        seen = [F.min("line").over(frame).alias("start"), F.max("line").over(frame).alias("end"), F.min(F.struct("a", "line")).over(frame).alias("mark"), F.sum("words").over(frame).alias("words")]
        out.append(at.select("doc_id", "text_hash", *seen, *([F.collect_list(F.struct("a", "b")).over(frame).alias("content")] if content else [])))
    both = out[0].unionByName(out[1].where(F.col("start") < F.col("end"))).where(F.col("words") >= min_words)
    keys = [F.xxhash64("content").alias("k1"), F.xxhash64(F.lit(17), "content").alias("k2")] if content else []
    return both.select("doc_id", "text_hash", "start", "end", F.col("mark.a").alias("mark"), F.col("mark.line").alias("mark_line"), *keys)


def joined_positions(fingerprints: DataFrame, scratch: Scratch) -> DataFrame:
    """The positions (doc_id, text_hash, mark_line) whose fingerprint (mark) stands at more than one."""
    place = F.struct("doc_id", "text_hash", "mark_line")
    several = fingerprints.groupBy("mark").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("mark")
    return fingerprints.join(scratch.table(several, "several"), "mark").select("doc_id", "text_hash", "mark_line")


def extended(lines: DataFrame, positions: DataFrame, min_words: int) -> DataFrame:
    """doc_id, text_hash, start, end, k1, k2: the windows to both sides of the positions that selected them."""
    at = positions.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), F.col("mark_line").alias("line_"))
    doc = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_"))
    some = lines.join(at.select("id_", "hash_").distinct(), doc, "left_semi")
    return windows(some, min_words, True).join(at, doc & (F.col("mark_line") == F.col("line_")), "left_semi").select("doc_id", "text_hash", "start", "end", "k1", "k2")


def repeated_runs(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, gone: the merged runs of lines to delete, as array<struct<start,end>> in order."""
    lines = scratch.table(hashed_lines(docs), "lines")
    fingerprints = scratch.table(windows(lines, min_words, False).select("doc_id", "text_hash", "mark_line", "mark").distinct(), "fingerprints")
    positions = scratch.table(joined_positions(fingerprints, scratch), "positions")
    found = scratch.table(extended(lines, positions, min_words), "found")
    scratch.drop("lines", "fingerprints", "several", "positions")
    firsts = found.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_hash", "start", "end")).alias("first"), F.max(F.struct("doc_id", "text_hash", "start", "end")).alias("last_")).where("first < last_").select("k1", "k2", "first")
    # A table of its own, so that the join has an exchange on both sides and can split hot contents.
    firsts = scratch.table(firsts, "firsts")
    later = found.join(firsts, ["k1", "k2"]).where(F.struct("doc_id", "text_hash", "start", "end") > F.col("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    start = F.when(same, F.greatest("start", F.col("first.end") + 1)).otherwise(F.col("start"))
    return merged_runs(later.select("doc_id", "text_hash", start.alias("start"), "end"))


def merged_runs(runs: DataFrame) -> DataFrame:
    """doc_id, text_hash, gone of runs (doc_id, text_hash, start, end) that may overlap or be empty."""
    doc = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    before = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.where(F.col("start") <= F.col("end")).distinct().withColumn("new", F.when(F.col("start") > F.coalesce(before, F.lit(-2)) + 1, 1).otherwise(0)).withColumn("island", F.sum("new").over(doc))
    merged = islands.groupBy("doc_id", "text_hash", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone"))


KEPT = """array_join(flatten(transform(sequence(0, size(gone_)), i -> slice(lines_,
    if(i = 0, 0, gone_[i - 1].end + 1) + 1,
    if(i = size(gone_), size(lines_), gone_[i].start) - if(i = 0, 0, gone_[i - 1].end + 1)))), '\n')"""


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with each text cut, and the number of its lines deleted as ``n_lines_deleted`` beside it."""
    scratch = Scratch(docs.sparkSession, "lines")
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    gone = scratch.table(repeated_runs(narrow, scratch, min_words), "gone").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), F.col("gone").alias("gone_"))
    scratch.drop("found", "firsts")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "n_lines_deleted"]).alias("row_"))
    text = F.col("row_.text").cast("string")
    joined = row.join(small(gone), F.col("row_.doc_id").eqNullSafe(F.col("id_")) & (F.xxhash64(text) == F.col("hash_")), "left")
    cut = joined.withColumn("lines_", F.when(F.col("gone_").isNotNull(), F.split(text, "\n")))
    count = F.aggregate("gone_", F.lit(0), lambda n, x: n + x["end"] - x["start"] + 1)
    left = F.when(F.col("gone_").isNull(), text).otherwise(F.expr(KEPT))
    fields = [left.alias("text") if c == "text" else F.col(f"row_.`{c}`") for c in docs.columns if c != "n_lines_deleted"]
    return cut.select(*fields, F.coalesce(count, F.lit(0)).alias("n_lines_deleted"))


def small(gone: DataFrame) -> DataFrame:
    """Runs by text (gone_), marked for a broadcast if they are few."""
    n = gone.agg(F.count("*").alias("texts"), F.sum(F.size("gone_")).alias("runs")).first()
    return F.broadcast(gone) if n.texts <= BROADCAST_DOCS and (n.runs or 0) <= BROADCAST_RUNS else gone


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for each row."""
    return F.transform(F.array(value), f)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def window_minima(values: Column, span: int) -> Column:
    """The least of each span of values from every place on, by doubling: minima of 2, 4, 8 ... then of two that overlap."""

    def doubled(m: Column, done: int) -> Column:
        if 2 * done > span:
            return F.transform(m, lambda x, i: F.least(x, F.get(m, i + (span - done)))) if done < span else m
        return let(F.transform(m, lambda x, i: F.least(x, F.get(m, i + done))), lambda twice: doubled(twice, 2 * done))

    return let(values, lambda v: doubled(v, 1))


def word_marks(text: Column, min_words: int) -> Column:
    """array<struct<mark,low,high>>: fingerprints, each with the first and last start of the windows that select it."""
    size = min(MARK_WORDS, min_words)
    starts = lambda w: F.sequence(F.lit(0), F.size(w) - min_words)
    placed = lambda w: F.transform(w, lambda x, i: F.xxhash64(x).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long")))
    lows = lambda w, m: F.filter(starts(w), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))

    def marks(w: Column, m: Column, low: Column) -> Column:
        def mark(at: Column, k: Column) -> Column:
            place = F.get(m, at).bitwiseAND(F.lit(PLACE)).cast("int")
            high = F.coalesce(F.get(low, k + 1), F.size(w) - (min_words - 1)) - 1
            return F.struct(F.xxhash64(F.slice(w, place + 1, size)).alias("mark"), at.alias("low"), high.alias("high"))

        return F.transform(low, mark)

    found = lambda w: let(window_minima(placed(w), min_words - size + 1), lambda m: let(lows(w, m), lambda low: marks(w, m, low)))
    return let(words_of(text), lambda w: F.when(F.size(w) >= min_words, found(w)))


def word_windows(text: Column, ranges: Column, min_words: int) -> Column:
    """array<struct<start,k1,k2>>: the content keys of the windows of words that start in the ranges."""

    def window(w: Column, i: Column) -> Column:
        content = F.slice(w, i + 1, min_words)
        return F.struct(i.alias("start"), F.xxhash64(content).alias("k1"), F.xxhash64(F.lit(17), content).alias("k2"))

    return let(words_of(text), lambda w: F.flatten(F.transform(ranges, lambda r: F.transform(F.sequence(r["low"], r["high"]), lambda i: window(w, i)))))


def repeated_words(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, gone: the merged runs of words to delete, as array<struct<start,end>> in order."""
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    every = scratch.table(texts.select("doc_id", "text_hash", F.inline(word_marks(F.col("text"), min_words))), "marks")
    place = F.struct("doc_id", "text_hash", "low")
    marks = every.groupBy("mark").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most").select("mark")
    # A table of its own, so that the join has an exchange on both sides and can split hot marks.
    marks = scratch.table(marks, "joined_marks")
    ranges = every.join(marks, "mark", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    ranges = scratch.table(ranges, "ranges").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), "ranges")
    scratch.drop("marks", "joined_marks")
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_"))
    wanted = ranges.select("id_", "hash_")
    # Only texts with a joined mark move to their ranges, if their ids are few enough to tell them beforehand.
    few = texts.join(F.broadcast(wanted), same, "left_semi") if wanted.count() <= BROADCAST_DOCS else texts
    some = few.join(ranges.hint("merge"), same)
    found = scratch.table(some.select("doc_id", "text_hash", F.inline(word_windows(F.col("text"), F.col("ranges"), min_words))), "words")
    place = F.struct("doc_id", "text_hash", "start")
    firsts = found.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last_")).where("first < last_").select("k1", "k2", "first")
    firsts = scratch.table(firsts, "word_firsts")
    later = found.join(firsts, ["k1", "k2"]).where(place > F.col("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    start = F.when(same, F.greatest("start", F.col("first.start") + min_words)).otherwise(F.col("start"))
    return merged_runs(later.select("doc_id", "text_hash", start.alias("start"), (F.col("start") + (min_words - 1)).alias("end")))


def without_words(text: Column, gone: Column) -> Column:
    """text without the runs of words; of the white space on both sides of a run that with a line end stays, else the first."""
    last = lambda p: F.size(p) - 1

    def part(p: Column, i: Column) -> Column:
        low, cut = F.coalesce(F.get(gone, i - 1)["end"] + 1, F.lit(0)), F.get(gone, i)
        kept = F.array_join(F.slice(p, low + 1, F.coalesce(cut["start"], F.size(p)) - low), "")
        after = F.regexp_extract(F.get(p, cut["end"]), SPACE + "$", 0)
        ends = (F.contains(after, F.lit("\n")) | (cut["end"] == last(p))) & (cut["start"] > low)
        return F.when(ends, F.concat(F.regexp_replace(kept, SPACE + r"\z", ""), after)).otherwise(kept)

    pieces = F.regexp_extract_all(text, F.lit(WORD + SPACE), F.lit(0))
    left = let(pieces, lambda p: F.array_join(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: part(p, i)), ""))
    return F.when(left.rlike(WORD), F.concat(F.regexp_extract(text, "^" + SPACE, 0), left)).otherwise(F.lit(""))


def passage_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with each text cut, and the number of its words deleted as ``n_words_deleted`` beside it."""
    scratch = Scratch(docs.sparkSession, "passages")
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    gone = scratch.table(repeated_words(narrow, scratch, min_words), "gone").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), F.col("gone").alias("gone_"))
    scratch.drop("words", "word_firsts", "ranges")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "n_words_deleted"]).alias("row_"))
    text = F.col("row_.text").cast("string")
    cut = row.join(small(gone), F.col("row_.doc_id").eqNullSafe(F.col("id_")) & (F.xxhash64(text) == F.col("hash_")), "left")
    count = F.aggregate("gone_", F.lit(0), lambda n, x: n + x["end"] - x["start"] + 1)
    left = F.when(F.col("gone_").isNull(), text).otherwise(without_words(text, F.col("gone_")))
    fields = [left.alias("text") if c == "text" else F.col(f"row_.`{c}`") for c in docs.columns if c != "n_words_deleted"]
    return cut.select(*fields, F.coalesce(count, F.lit(0)).alias("n_words_deleted"))
