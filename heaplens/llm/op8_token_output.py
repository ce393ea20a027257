"""Token-ID output: tokenise whole texts, Huffman-code the ids from global counts, read the files back.

Jobs: tokenise (ids kept as 16- or 32-bit integers in a scratch table); count ids (partial counts per
task, at most one row per id and task); deal by range of doc_id and sort; write shard files of about
``SHARD_TOKENS`` ids. A folder of token files (see huffman) holds all that reading needs: the dictionary of
code lengths, the shards, and ``manifest``, a Parquet table of the shards in their order. Every attempt of a
task writes under names of its own, and Spark commits the manifest with those of the attempts that count, so
lost executors and repeated tasks leave no wrong shard.

Edge cases: null and empty texts have only the end id; rows whose doc_id is null come first and are
written as documents with the id -2**63; repeated doc_ids and repeated rows keep one entry per row, in order
of a hash of their ids (ties), and may be dealt to several tasks; very long texts are tokenised in one go and
go whole into one shard, which they may make larger than others; an empty table gives an empty result; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import string
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heaplens.llm import huffman
from heaplens.llm.common import Scratch, filesystem, partitions

#: Ids in a shard, documents being kept whole.
SHARD_TOKENS = 1 << 20
#: Entries of the per-process cache from a word's bytes to its ids.
CACHE_WORDS = 1_200_000
NO_ID = -(1 << 63)
#: Bytes of text whose distinct words are looked up together: the more, the fewer look-ups.
LOOKUP_BYTES = 1 << 23
#: ASCII characters that are neither letters, digits, white space nor control characters.
MARKS = string.punctuation
#: The first character after the Latin letters.
LATIN_END = "\u0250"
#: Words of characters that are Latin letters in lower case, too.
PLAIN = f"^[{''.join(c for c in map(chr, range(ord(LATIN_END))) if all(x.isalpha() and x < LATIN_END for x in c.lower()))}]*$"


class WordEncoder:
    """The library's ids of a text, put together from those of its words.

    The normaliser and the pre-tokeniser of word-level vocabularies never join characters across ASCII
    white space, so a text's ids are its words' ids in order; each distinct word is encoded once. Words
    of Latin letters only are single pre-tokens that normalisation only lower-cases: the library encodes
    many in one call of a copy that splits at spaces alone, and end-of-word pieces tell them apart. All
    other words go through the full tokenizer, and texts that may hold a special token go there whole.

    Arrow splits many texts at once and numbers their words, so that Python sees each distinct word only.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.lib.get_vocab_size()
        self.width = "<u2" if size <= 1 << 16 else "<u4"
        self.ends = np.array([(self.lib.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.cache: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def _letters(self, words: list[bytes]) -> None:
        """Put words of lower-case Latin letters into the cache."""
        unit = np.dtype(self.width).itemsize
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, self.width)
            cuts = (unit * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(part):
                raise ValueError("the vocabulary does not mark the ends of words")
            raw = ids.tobytes()
            self.cache.update(zip(part, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))

    def _learn(self, new: list[bytes]) -> None:
        """Put words, whose A-Z are in lower case, into the cache."""
        cache, plain, same = self.cache, set(), {}
        for w in new:
            if w.isalpha():  # ASCII letters
                plain.add(w)
                continue
            low = w.decode().lower()
            if low.isalpha() and max(low) < LATIN_END:
                same[w] = low.encode()
                plain.add(same[w])
            else:
                cache[w] = self._ids(w.decode())
        self._letters(list(plain.difference(cache)))
        for w, low in same.items():
            cache[w] = cache[low]

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of each of some distinct words.

        Letters and the ASCII marks after them are two pre-tokens: the ids of the stem, then of the tail.
        """
        stems = pc.ascii_rtrim(words, characters=MARKS)
        size = pc.if_else(pc.match_substring_regex(stems, PLAIN), pc.binary_length(stems), pc.binary_length(words))
        _, bounds, data = words.buffers()
        cuts = np.repeat(np.frombuffer(bounds, np.int32)[words.offset : words.offset + len(words) + 1], 2)[:-1]
        cuts[1::2] += size.to_numpy(zero_copy_only=False)
        parts = pa.Array.from_buffers(pa.binary(), 2 * len(words), [None, pa.py_buffer(cuts), data]).dictionary_encode()
        every = parts.dictionary.to_pylist()
        ids = list(map(self.cache.get, every))
        new = [w for w, x in zip(every, ids, strict=True) if x is None]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
        self._learn(new)
        ids = [self.cache[w] if x is None else x for w, x in zip(every, ids, strict=True)]
        return joined(pa.array(ids, pa.large_binary()), parts.indices, np.arange(0, 2 * len(words) + 1, 2))

    def column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text, then ``end``, as a binary column."""
        texts = texts.cast(pa.string()).fill_null("")
        special = pc.match_substring(texts, "<|")
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(special, "x", texts)))  # "x" holds a place
        at = split.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        words = split.flatten().dictionary_encode()
        n, whole = len(words.dictionary), np.flatnonzero(special.to_numpy(zero_copy_only=False))
        index = words.indices.to_numpy().copy()
        index[at[whole]] = n + 1 + np.arange(len(whole))
        others = [end, *(self._ids(texts[i].as_py()) for i in whole.tolist())]
        pool = pa.concat_arrays([self._words(words.dictionary), pa.array(others, pa.large_binary())])
        return joined(pool, pa.array(np.insert(index, at[1:], n)), at + np.arange(len(at))).cast(pa.binary())

    def batch(self, texts: list[str | None]) -> list[bytes]:
        return self.column(pa.array(texts, pa.string())).to_pylist()


def joined(pool: pa.Array, index: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The entries of pool that index names, those between two bounds joined to one value."""
    taken = pool.take(index)
    _, ends, data = taken.buffers()
    cuts = np.frombuffer(ends, np.int64)[taken.offset + bounds]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(cuts), data])


def runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows (the first, how many) whose texts have up to LOOKUP_BYTES bytes; a longer text is one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = before = 0
    while first < len(ends):
        stop = max(first + 1, int(np.searchsorted(ends, before + LOOKUP_BYTES, "right")))
        yield first, stop - first
        first, before = stop, int(ends[stop - 1])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian integers of the vocabulary's width, the end id last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.width).tobytes()
        for b in batches:
            for first, n in runs(b.column(1)):
                ids = enc.column(b.column(1).slice(first, n), end)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), ids], ["doc_id", "ids"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def id_counts(ids: DataFrame, size: int, width: str) -> np.ndarray:
    """Global counts; each task sends at most one row per id of the (bounded) vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                raw = b"".join(b.column(0).slice(k, 500).to_pylist())
                total += np.bincount(np.frombuffer(raw, width), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.id] = r.n
    return counts


#: Names in a folder of token files.
CODES, MANIFEST = "codes.hltd", "manifest"
SHARDS = "part int, seq long, n_docs long, n_tokens long, file string"


def write_tokens(ids: DataFrame, lengths: np.ndarray, width: str, folder: str) -> None:
    """A folder of token files of ids (doc_id, ids); in order of (part, seq) its shards ascend by doc_id."""
    dictionary = huffman.pack_lengths(lengths)
    system, base = filesystem(folder)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/{CODES}") as f:
        f.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = filesystem(folder)
        codes, part, seq = huffman.canonical_codes(lengths), TaskContext.get().partitionId(), 0
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush():
            nonlocal held, size, seq
            tokens = np.frombuffer(b"".join(x for _, x in held), width)
            each = np.array([len(x) // np.dtype(width).itemsize for _, x in held])
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.hltk"
            with system.open_output_stream(f"{base}/{name}") as f:
                f.write(huffman.pack(np.array([d for d, _ in held], np.int64), each, tokens, dictionary, codes))
            row = {"part": pa.array([part], pa.int32()), "seq": pa.array([seq]), "n_docs": pa.array([len(held)]), "n_tokens": pa.array([len(tokens)]), "file": pa.array([name])}
            held, size, seq = [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.append((d, x.as_py()))
                size += len(held[-1][1]) // np.dtype(width).itemsize
                if size >= SHARD_TOKENS:
                    yield flush()
        if held:
            yield flush()

    # The hash splits a doc_id that many rows have; null doc_ids are one such.
    dealt = ids.withColumn("hash", F.xxhash64("ids")).repartitionByRange(partitions(ids.sparkSession), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "ids")
    dealt.select("doc_id", "ids").mapInArrow(run, SHARDS).write.parquet(f"{folder}/{MANIFEST}")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of each document of a folder of token files."""
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/{MANIFEST}")
    # Sums in two levels: shards within a part, and one row per part.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    placed = shards.withColumn("within", within).join(parts, "part").select((F.col("before") + F.col("within")).alias("base"), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        decoder = None
        for b in batches:
            for base, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if decoder is None:
                    with system.open_input_stream(f"{path}/{CODES}") as f:
                        decoder = huffman.Decoder(f.read())
                with system.open_input_stream(f"{path}/{name}") as f:
                    doc_ids, each, tokens = decoder.unpack(f.read())
                raw = memoryview(tokens.astype("<u4").tobytes())
                ends = np.cumsum(each, dtype=np.int64)
                starts = ends - each
                cols = {
                    "doc_id": pa.array([None if d == NO_ID else d for d in doc_ids.tolist()], pa.int64()),
                    "start": pa.array(base + starts, pa.int64()),
                    "n_tokens": pa.array(each.astype(np.int64), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                }
                if with_ids:
                    cols["ids"] = pa.array([tokens[s:e].tolist() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return placed.repartition(partitions(spark)).mapInArrow(run, schema)


def token_output(docs: DataFrame, path: str, end_id: int = 1, with_ids: bool = False, folder: str | None = None) -> DataFrame:
    """Write the documents' ids and read them back. path: a tokenizers JSON file that executors can open.

    folder: where the token files go, below which nothing may be; by default a scratch folder.
    """
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(path).get_vocab_size()
    width, scratch = "<u2" if size <= 1 << 16 else "<u4", Scratch(docs.sparkSession, "tokens")
    folder = folder or f"{scratch.base}/files"
    ids = scratch.table(tokenised(docs, path, end_id), "ids")
    lengths = huffman.code_lengths(id_counts(ids, max(size, end_id + 1), width))
    write_tokens(ids, lengths, width, folder)
    scratch.drop("ids")
    return read_tokens(docs.sparkSession, folder, with_ids)
