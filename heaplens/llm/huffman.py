"""Canonical length-limited Huffman coding of token ids in independently decodable blocks (numpy).

A folder of token files has one dictionary and any number of shards. All numbers are little-endian.

dictionary  magic, number of ids (8 bytes), the code length of each id (a byte each), CRC-32 of all that
shard       magic, SHA-256 of the dictionary's file, documents, tokens, blocks, words (8 bytes each); of each
            document its id (8 bytes) and number of tokens (4); the bit offset of each block of ``BLOCK`` tokens
            (8); the codes as big-endian 64-bit words, first bit first; CRC-32 of all that

Canonical codes follow from the lengths, so the two kinds of files hold all that decoding needs.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np

MAGIC, DICTIONARY = b"HLTK0002", b"HLTD0001"
HEAD = "<8s32s4Q"
HEAD_SIZE = struct.calcsize(HEAD)
#: Longest code in bits; the decoding table has 2**MAX_BITS entries.
MAX_BITS = 20
#: Tokens in a block; each block has its bit offset in the checkpoint list.
BLOCK = 256


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; 0 for ids that never occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    weight = counts[used].astype(np.int64)
    order = np.argsort(weight, kind="stable")
    used, weight = used[order], weight[order]
    # Level by level: merge the leaves with the pairs of the level before. A True flag marks a leaf.
    flags, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        leaf = np.concatenate([np.ones(len(weight), bool), np.zeros(len(packages), bool)])
        by = np.argsort(merged, kind="stable")
        merged, leaf = merged[by], leaf[by]
        flags.append(leaf)
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    # The cheapest 2n-2 items of the last level; each chosen package opens two items one level below.
    take, depth = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for leaf in reversed(flags):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[used] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the one before plus one, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.int64)
        step = np.int64(1) << (64 - 2 - size)  # a code's share of a space of 2**62
        start = np.concatenate([[0], np.cumsum(step)[:-1]])
        codes[order] = (start >> (62 - size)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each window of ``bits`` leading bits: the id and the length of the code it begins with."""
    used = np.flatnonzero(lengths)
    bits = int(lengths.max()) if len(used) else 1
    used = used[np.argsort(codes[used] << (np.uint64(bits) - lengths[used].astype(np.uint64)))]
    span = np.int64(1) << (bits - lengths[used].astype(np.int64))
    symbols = np.zeros(1 << bits, np.uint32)
    sizes = np.ones(1 << bits, np.uint8)
    symbols[: span.sum()] = np.repeat(used, span)
    sizes[: span.sum()] = np.repeat(lengths[used], span)
    return symbols, sizes, bits


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(big-endian 64-bit words, bit offset of each block) of the ids' codes, first bit first."""
    if len(ids) == 0:
        return np.zeros(0, ">u8"), np.zeros(0, np.uint64)
    size = lengths[ids].astype(np.int64)
    if not size.all():
        raise ValueError("an id has no code")
    end = np.cumsum(size)
    start = end - size
    word, shift = start >> 6, 64 - (start & 63) - size
    code = codes[ids]
    words = np.zeros((int(end[-1]) >> 6) + 2, np.uint64)
    here = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[first]] = np.add.reduceat(here, first)
    over = np.flatnonzero(shift < 0)  # at most one code crosses into each word
    words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return words.astype(">u8"), start[::block].astype(np.uint64)


def decode(words: np.ndarray, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int], block: int = BLOCK) -> np.ndarray:
    """The n ids; all blocks advance together, one code a step, each from its own checkpoint."""
    symbols, sizes, bits = table
    words = np.concatenate([words.astype(np.uint64), np.zeros(2, np.uint64)])
    at = checkpoints.astype(np.int64)
    out = np.zeros((len(at), block), np.uint32)
    last = n - (len(at) - 1) * block
    for step in range(block if len(at) else 0):
        if step == last:
            at = at[:-1]
        if len(at) == 0:
            break
        word, off = at >> 6, (at & 63).astype(np.uint64)
        window = (words[word] << off) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - off))
        key = (window >> np.uint64(64 - bits)).astype(np.int64)
        out[: len(at), step] = symbols[key]
        at = at + sizes[key]
    return out.ravel()[:n] if len(checkpoints) else np.zeros(0, np.uint32)


def pack_lengths(lengths: np.ndarray) -> bytes:
    """A dictionary file."""
    body = struct.pack("<8sQ", DICTIONARY, len(lengths)) + lengths.astype(np.uint8).tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_lengths(dictionary: bytes) -> np.ndarray:
    """The code lengths of a dictionary file; a damaged one is an error."""
    if len(dictionary) < 20 or zlib.crc32(dictionary[:-4]) != struct.unpack("<I", dictionary[-4:])[0]:
        raise ValueError("not a whole dictionary")
    magic, n = struct.unpack_from("<8sQ", dictionary)
    if magic != DICTIONARY or len(dictionary) != 20 + n:
        raise ValueError("not a dictionary")
    return np.frombuffer(dictionary, np.uint8, n, 16)


def pack(doc_ids: np.ndarray, n_tokens: np.ndarray, ids: np.ndarray, dictionary: bytes, codes: np.ndarray | None = None) -> bytes:
    """A shard file of documents whose ids stand one after the other, coded by a dictionary file."""
    lengths = unpack_lengths(dictionary)
    words, checkpoints = encode(ids, lengths, canonical_codes(lengths) if codes is None else codes)
    head = struct.pack(HEAD, MAGIC, hashlib.sha256(dictionary).digest(), len(doc_ids), len(ids), len(checkpoints), len(words))
    body = b"".join([head, doc_ids.astype("<i8").tobytes(), n_tokens.astype("<u4").tobytes(), checkpoints.astype("<u8").tobytes(), words.tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


class Decoder:
    """Decodes shards by the dictionary file that they were written with."""

    def __init__(self, dictionary: bytes):
        lengths = unpack_lengths(dictionary)
        self.digest, self.table = hashlib.sha256(dictionary).digest(), decode_table(lengths, canonical_codes(lengths))

    def unpack(self, shard: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc_ids, tokens of each, all ids) of a shard; a damaged one or one of another dictionary is an error."""
        if len(shard) < HEAD_SIZE + 4 or zlib.crc32(memoryview(shard)[:-4]) != struct.unpack("<I", shard[-4:])[0]:
            raise ValueError("not a whole token shard")
        magic, digest, docs, n, blocks, count = struct.unpack_from(HEAD, shard)
        if magic != MAGIC or len(shard) != HEAD_SIZE + 12 * docs + 8 * (blocks + count) + 4:
            raise ValueError("not a token shard")
        if digest != self.digest:
            raise ValueError("the shard was written with another dictionary")
        doc_ids = np.frombuffer(shard, "<i8", docs, HEAD_SIZE)
        sizes = np.frombuffer(shard, "<u4", docs, HEAD_SIZE + 8 * docs)
        checkpoints = np.frombuffer(shard, "<u8", blocks, HEAD_SIZE + 12 * docs)
        words = np.frombuffer(shard, ">u8", count, HEAD_SIZE + 12 * docs + 8 * blocks)
        return doc_ids, sizes, decode(words, checkpoints, n, self.table)
