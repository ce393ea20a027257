"""N-gram Jaccard join by parity sketches.

A set of shingles has a bit sketch in which each shingle flips one bit: the Hamming distance of two sketches
is at most the sets' symmetric difference. The same idea finds candidates: within a size band, shingles are
dealt by hash to one part more than the symmetric difference that a linked pair of the band can have, and
each part has the XOR of its shingles' hashes. By the pigeonhole principle a linked pair agrees in at least
one part, and by the dealing's randomness in over a third of them, so ``PARTS`` parts are looked at, of
several dealings where a dealing has fewer (``parts=None``: every part). A pair exactly at the threshold is
missed with a chance under (1 - 1/e) ** PARTS, about 1e-9, and one of similarity 0.9 under 1e-17: of the
order of hash collisions.

1. One pass over the texts gives size, 128-bit set hash, sketch and part keys. Equal sets are one class,
   stood for by its least doc_id; only that one's keys go on.
2. Minima and counts, partial before the shuffle, tell the keys that several classes share; each member of
   such a key is paired with the key's least one. Pairs that sizes and sketches allow are verified exactly; links make components.
3. In keys of three classes or more that still hold several components, classes of different components are
   compared by size and sketch, in blocks of ``BLOCK`` classes: a larger key is cut into chunks that meet in
   pairs. What the sketches allow is verified exactly: all of it if a block finds at most ``ROOM`` pairs a
   class, else first one pair for each two components, and all that is then still apart in a second round.
   Pairs within a component change nothing and are never made.

Each step that verifies reads the texts of its candidates only. Keys, hubs and classes of any size are split
by the skew join or cut into blocks; no group is held whole in memory. The work inside a key grows with the
square of those of its classes that end in different components, the rows that are moved with that over
``BLOCK``.

Edge cases: null texts and texts without words have size 0 and stand alone; a null doc_id takes no part and
gets a null component; repeated doc_ids are one vertex with the links of all its texts, repeated rows one
class; similarities of exactly 0.8 link; of equal candidates (ties) none goes before the other, for all are
verified; very long texts are hashed whole, with memory in proportion to the text; further columns, whatever
their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heaplens.llm.common import Scratch, only, partitions, release
from heaplens.llm.components import components
from heaplens.llm.shingles import mixed, shingle_sets, slices

#: Two sets link when 100 * intersection >= SIMILAR * union.
SIMILAR = 80
#: Part keys of a set in each of its bands.
PARTS = 48
#: Bits of the sketch.
SKETCH = 2048
#: Classes of a key that one task compares with each other.
BLOCK = 4096
#: Characters of the texts that a Python worker hashes at once; a longer text goes alone.
CHARS = 150_000
#: Up to so many classes whose texts are needed (three longs, about 100 bytes each in a hash table: 50 MB) go to
#: the executors by broadcast; beyond that the texts of all documents are shuffled to them.
BROADCAST_DOCS = 500_000
#: Rows of keys that a Python worker sums before they are shuffled.
GATHER = 250_000
#: Pairs for each class of a block up to which all of its pairs are verified at once.
ROOM = 8


@lru_cache(maxsize=1)
def bands() -> np.ndarray:
    """First size of each band; a band's last size is under 1.25 times its first, up to 2**40."""
    first = [1]
    while first[-1] < 1 << 40:
        first.append(max(first[-1] + 1, int(first[-1] * 1.25)))
    return np.array(first)


def part_keys(s: np.ndarray, wanted: int | None = PARTS) -> np.ndarray:
    """The keys of one set, in its own band and in those of the larger sets that it can link with."""
    n, first = len(s), bands()
    low, high = np.searchsorted(first, [n, n * 100 // SIMILAR], side="right") - 1
    out = []
    for band in range(low, high + 1):
        # |A - B| + |B - A| = (a + b)(1 - J)/(1 + J) at most, with both sizes in or below the band.
        most = 2 * (int(first[band + 1]) - 1) * (100 - SIMILAR) // (100 + SIMILAR)
        if most == 0:
            continue  # only equal sets link here
        parts = most + 1
        deals = -(-(PARTS if wanted is None else wanted) // parts)
        seeds = mixed(np.arange(deals, dtype=np.uint64) + np.uint64(1 + 1000 * band))
        h = mixed(s[None, :] ^ seeds[:, None])
        part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        slot = (part + np.arange(deals, dtype=np.uint64)[:, None] * np.uint64(parts)).ravel()
        h = h.ravel()
        if wanted is not None and parts > wanted:
            used = slot < wanted
            slot, h = slot[used], h[used]
        order = np.argsort(slot, kind="stable")
        slot, h = slot[order], h[order]
        if len(slot):
            edge = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            word = np.bitwise_xor.reduceat(h, edge)
            out.append(mixed(word ^ mixed(slot[edge] + np.uint64(band << 20))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(s: np.ndarray) -> bytes:
    bits = np.bincount((mixed(s ^ np.uint64(0x5DEECE66D)) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of the whole set."""
    a, b = mixed(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), initial=np.uint64(len(s)))
    return int(a.astype(np.int64)), int(np.uint64(b).astype(np.int64))


def features(docs: DataFrame, parts: int | None = PARTS) -> DataFrame:
    """doc_id, n, c1, c2, sketch (64 bits a number), keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("op9")
        for b in batches:
            for first, texts in slices(b, 1, CHARS):
                sets = shingle_sets(texts)
                hashes = [set_hash(s) for s in sets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": b.column(0).slice(first, len(texts)),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "c1": pa.array([h[0] for h in hashes], pa.int64()),
                        "c2": pa.array([h[1] for h in hashes], pa.int64()),
                        "sketch": pa.array([np.frombuffer(sketch(s), np.int64) for s in sets], pa.list_(pa.int64())),
                        "keys": pa.array([part_keys(s, parts).view(np.int64) for s in sets], pa.list_(pa.int64())),
                    }
                )
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, c1 long, c2 long, sketch array<long>, keys array<long>")


def summed(key: np.ndarray, hub: np.ndarray, last: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows of equal keys, in order of keys, as one row each: least hub, greatest last, sum of sizes."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[edge], np.minimum.reduceat(hub[order], edge), np.maximum.reduceat(last[order], edge), np.add.reduceat(size[order], edge)


HUB = ("key", "hub", "last", "size")


def hubs(keyed: DataFrame) -> DataFrame:
    """key, hub (its least class), size (its rows) of the keys that two classes or more have. keyed: key, rep.

    Each task sums ``GATHER`` rows at a time before the shuffle; after it, sorted rows are summed as they pass.
    """

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("op9")
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= GATHER:
                yield gathered(held)
                held, n = [], 0
        if n:
            yield gathered(held)
        held = []
        release()

    def gathered(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        key, rep = t.column(0).to_numpy(), t.column(1).to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in summed(key, rep, rep, np.ones(len(key), np.int64))], HUB)

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 4
        for b in batches:
            if b.num_rows == 0:
                continue
            rows = summed(*(np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, b.columns, strict=True)))
            # The last key may go on in the next batch.
            rest = [c[-1:] for c in rows]
            yield shared([c[:-1] for c in rows])
        yield shared(rest)

    def shared(rows: list[np.ndarray]) -> pa.RecordBatch:
        several = rows[1] < rows[2]
        return pa.RecordBatch.from_arrays([pa.array(rows[k][several]) for k in (0, 1, 3)], ["key", "hub", "size"])

    parts = keyed.select("key", "rep").mapInArrow(before, "key long, hub long, last long, size long")
    return parts.repartition(partitions(keyed.sparkSession), "key").sortWithinPartitions("key").mapInArrow(after, "key long, hub long, size long")


def shared_keys(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """key, rep, hub, size: the rows of the keys of hubs(). Hot keys are split, for both sides are tables."""
    return keyed.join(scratch.table(hubs(keyed), "hubs"), "key")


def near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) of representatives that sizes and sketches allow. sketches: rep, n, sketch."""
    side = lambda x: sketches.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = 100 * F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b")
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return both.where(fits).where((100 + SIMILAR) * apart <= (100 - SIMILAR) * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct()


def _fetched(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """rep, set: the shingles of the classes needed (rep, c1, c2), from the texts themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("op9")
        for b in batches:
            for first, texts in slices(b, 1, CHARS):
                part = b.slice(first, len(texts))
                sets = shingle_sets(texts)
                # A doc_id may have several texts: only the class asked for is meant.
                same = [i for i, (s, x, y) in enumerate(zip(sets, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)) if set_hash(s) == (x, y)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(same, pa.int64())), pa.array([sets[i].view(np.int64) for i in same], pa.list_(pa.int64()))], ["rep", "set"])
        release()

    needed = F.broadcast(needed) if needed.count() <= BROADCAST_DOCS else needed
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(needed, "rep")
    return texts.select("rep", "text", "c1", "c2").mapInArrow(run, "rep long, set array<long>")


def linked(a: Column, b: Column) -> Column:
    """Whether two arrays of distinct shingles link."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= SIMILAR * (F.size(a) + F.size(b) - both)


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of representatives that link, by their whole sets. classes: rep, c1, c2."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    needed = scratch.table(classes.join(ends, "rep", "left_semi").select("rep", "c1", "c2").distinct(), f"{name}-needed")
    sets = scratch.table(_fetched(docs, needed), f"{name}-sets")
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    out = scratch.table(both.where(linked(F.col("set_a"), F.col("set_b"))).select("a", "b").distinct(), f"{name}-links")
    scratch.drop(f"{name}-needed", f"{name}-sets")
    return out


def crossing(comp: np.ndarray, side: np.ndarray, n: np.ndarray, bits: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """(rows, rows, whether these are all): pairs of different components that sizes and sketches allow.

    Beyond ``most`` pairs only such follow as join components that the pairs before, taken for links, leave
    apart, the nearest ones. side tells the chunk of each row; with two chunks, only pairs of one row from
    each are meant.
    """
    order = np.lexsort((comp, n))
    comp, side, n, bits = comp[order], side[order], n[order], bits[order]
    upto = np.searchsorted(n, n * 100 // SIMILAR, side="right")
    two, whole, now, found = side.min() != side.max(), True, comp.copy(), 0
    left, right = [], []
    for i in range(len(comp)):
        label = comp if whole else now
        js = i + 1 + np.flatnonzero(label[i + 1 : upto[i]] != label[i])
        if two:
            js = js[side[js] != side[i]]
        if len(js) == 0:
            continue
        apart = np.bitwise_count(bits[js] ^ bits[i]).sum(1, dtype=np.int64)
        fits = (100 + SIMILAR) * apart <= (100 - SIMILAR) * (n[i] + n[js])
        js, apart = js[fits], apart[fits]
        if whole and most is not None and found + len(js) > most:
            whole = False
            js, apart = js[now[js] != now[i]], apart[now[js] != now[i]]
        if not whole:
            js = js[np.argsort(apart, kind="stable")]
            js = js[np.unique(now[js], return_index=True)[1]]
        if len(js):
            now[np.isin(now, now[js])] = now[i]
            left.append(np.full(len(js), i))
            right.append(js)
            found += len(js)
    none = [np.zeros(0, np.int64)]
    return order[np.concatenate(left or none)], order[np.concatenate(right or none)], whole


def _across(held: DataFrame, sketches: DataFrame, every: bool) -> DataFrame:
    """key, a, b: pairs of representatives by crossing() over each key, and a null pair for a key with more.

    held: key, rep, size, component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("op9")
        held_rows: list[pa.RecordBatch] = []
        at = None

        def pairs():
            t = pa.Table.from_batches(held_rows).combine_chunks()
            if t.num_rows < 2:
                return
            side, rep, comp, n = (t.column(i).to_numpy() for i in (3, 4, 5, 6))
            bits = t.column(7).chunk(0).flatten().to_numpy().view(np.uint64).reshape(len(rep), -1)
            i, j, whole = crossing(comp, side, n, bits, None if every else ROOM * len(rep))
            a, b = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
            if len(a):
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.full(len(a), at[0])), "a": pa.array(a), "b": pa.array(b)})
            if not whole:
                yield pa.RecordBatch.from_pydict({"key": pa.array([at[0]], pa.int64()), "a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64())})

        for batch in batches:
            group = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (0, 1, 2)], 1)
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), len(group)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if held_rows and at != tuple(group[s]):
                    yield from pairs()
                    held_rows = []
                at = tuple(group[s])
                held_rows.append(batch.slice(s, e - s))
        if held_rows:
            yield from pairs()
        held_rows = []
        release()

    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    met = held.withColumn("side", F.pmod(F.xxhash64("rep"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    met = met.select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "rep", "component")
    dealt = met.join(sketches.select("rep", "n", "sketch"), "rep").select("key", "low", "high", "side", "rep", "component", "n", "sketch")
    dealt = dealt.repartition(partitions(held.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(run, "key long, a long, b long")


def jaccard_components(docs: DataFrame, parts: int | None = PARTS) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    every = scratch.table(features(docs, parts), "features")
    rows = scratch.table(every.select("doc_id", "n", "c1", "c2"), "rows")
    known = "n > 0 and doc_id is not null"
    reps = scratch.table(rows.where(known).groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "reps")
    classes = every.where(known).join(reps, ["c1", "c2"]).where("doc_id = rep")
    keyed = scratch.table(classes.select(F.explode("keys").alias("key"), "rep"), "keyed")
    shared = scratch.table(shared_keys(keyed, scratch), "shared")
    scratch.drop("keyed", "hubs")
    sketches = classes.join(shared.select("rep").distinct(), "rep", "left_semi").select("rep", "c1", "c2", "n", "sketch")
    sketches = scratch.table(sketches.dropDuplicates(["rep", "c1", "c2"]), "sketches")
    scratch.drop("features")

    # Each class with the least one of each of its keys.
    stars = shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    tested = scratch.table(near(scratch.table(stars, "stars"), sketches), "near")
    links = verified(docs, tested, sketches, scratch, "star")
    # What is left in keys of three or more: at most two rounds, the second one without a limit.
    held = shared.where("size > 2").select("key", "rep", "size").distinct()
    for every_pair in (False, True):
        part = components(links).withColumnRenamed("vertex", "rep")
        now = scratch.table(held.join(part, "rep", "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("component")), f"now-{every_pair}")
        several = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        now = now.join(scratch.table(several, f"several-{every_pair}"), "key", "left_semi")
        found = scratch.table(_across(now, sketches, every_pair), f"found-{every_pair}")
        pairs = found.where("a is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, f"pairs-{every_pair}")
        links = links.unionByName(verified(docs, pairs, sketches, scratch, f"cross-{every_pair}"))
        more = found.where("a is null").select("key").distinct()
        if more.isEmpty():
            break
        held, tested = held.join(more, "key", "left_semi"), tested.unionByName(pairs)
    # A doc_id with several texts is one vertex: it links their classes.
    several = rows.where(known).groupBy("doc_id").agg(F.min("c1").alias("x"), F.max("c1").alias("y")).where("x < y").select("doc_id")
    own = rows.join(several, "doc_id").join(reps, ["c1", "c2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    part = components(links.unionByName(own)).withColumnRenamed("vertex", "rep")
    member = scratch.table(reps.join(part, "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component")), "member")
    scratch.drop("shared", "sketches", "stars", "near", "reps", "star-links", *(f"{t}-{x}" for x in (False, True) for t in ("now", "several", "found", "pairs")), "cross-False-links", "cross-True-links")
    out = rows.join(member, ["c1", "c2"], "left")
    lone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), lone).alias("component_id"))
