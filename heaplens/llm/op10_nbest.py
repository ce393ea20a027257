"""SentencePiece encoding and decoding with the N best segmentations.

The piece lattice of a text has an edge for each piece that occurs in it and, for a character that is no
piece, one for its bytes. Vocabularies of merges have ranks, not probabilities: an edge's score is minus the
logarithm of the piece's rank plus two, as under Zipf's law; a byte's is ``BYTE_COST`` below the least of them. Models
of kind unigram keep their own scores. A text is cut wherever no piece of the vocabulary has the two
characters side by side: no edge crosses such a place, so the lattice of a text is a chain of lattices of
its units, each solved once per process:

* forward and backward Viterbi scores, for many units at once in numpy, give the best path and the score of
  the best path through every edge, so the loss of each unit's second best path;
* the N best paths of one unit come from an A* search from the end of the lattice back to its start, whose
  heuristic, the forward Viterbi score, is exact: paths leave the queue in order of their scores;
* only the N - 1 units with the smallest losses can differ in a text's N best segmentations; the same kind
  of search over these units' paths gives them.

Decoding joins the pieces' bytes. As in the library, ▁ in a text reads back as a space.

Edge cases: null texts give null results, empty ones no ids and one segmentation; texts with fewer than N
segmentations have all of them; ties go to the longer last piece, then to the earlier unit; repeated rows
and null or repeated doc_ids are rows like others; a very long text is taken whole, with memory in proportion
to it; further columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heaplens.llm.common import HOLDERS, only, release
from heaplens.llm.shingles import slices

#: Segmentations of each text.
N_BEST = 4
#: Characters of the texts that a Python worker takes at once; a longer text goes alone.
CHARS = 400_000
#: Score of a byte below the least score of a piece.
BYTE_COST = 10.0
#: Units whose best paths a process keeps.
CACHE_UNITS = 300_000
#: Characters of units that are solved together.
CHUNK = 100_000
MARK = "▁"
_BASE = 0x9E3779B97F4A7C15


class Lattice:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        raw = [sp.get_score(i) for i in range(len(names))]
        usable = [i for i in range(len(names)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        # A score of about -1e9 keeps a piece out of segmentations; a single character of that kind must stay.
        low = min(raw[i] for i in usable if raw[i] > -1e8)
        raw = [low if len(p) == 1 and s <= -1e8 else s for p, s in zip(names, raw, strict=True)]
        usable = [i for i in usable if raw[i] > -1e8]
        ranks = all(raw[i] == int(raw[i]) for i in usable)
        self.score = {names[i]: (-float(np.log(2.0 - raw[i])) if ranks else raw[i], i) for i in usable}
        beside = {ab for p in self.score for ab in zip(p, p[1:], strict=False)}
        place = {c: k for k, c in enumerate(sorted({c for ab in beside for c in ab}), 1)}
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in place]] = list(place.values())
        self.beside = np.zeros((len(place) + 1,) * 2, bool)  # a few thousand characters squared
        for a, b in beside:
            self.beside[place[a], place[b]] = True
        self.byte_score = min(s for s, _ in self.score.values()) - BYTE_COST
        self.byte_id = {int(names[i][3:5], 16): i for i in range(len(names)) if sp.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.width = "<u2" if len(names) <= 1 << 16 else "<u4"
        self.bytes = [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.longest = max(map(len, self.score))
        keys = {}
        for p, (s, i) in self.score.items():
            h = len(p)
            for c in p:
                h = (h * _BASE + ord(c)) % (1 << 64)
            if keys.setdefault(h, p) != p:
                raise ValueError("two pieces have one hash")
        order = sorted(keys)
        self.hashes = np.array(order, np.uint64)
        self.weights = np.array([self.score[keys[h]][0] for h in order])
        self.ids = np.array([self.score[keys[h]][1] for h in order])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.slot: dict[str, int] = {}
        self.best = np.zeros(CACHE_UNITS), np.zeros(CACHE_UNITS), np.zeros(CACHE_UNITS, np.int64)
        self.paths: list[bytes] = []
        self.nbest = lru_cache(maxsize=5_000)(self._nbest)

    def _edges(self, units: list[str]):
        """(start node, end node, score, id or -1 for bytes) of all edges; a unit of k characters has k + 1 nodes."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.array([len(u) for u in units])
        unit = np.repeat(np.arange(len(units)), size)
        left = np.cumsum(size)[unit] - np.arange(len(codes))  # characters to the unit's end
        node = np.arange(len(codes)) + unit
        start, length, weight, ids = [], [], [], []
        at = np.arange(len(codes))
        tail = np.zeros(len(codes), np.uint64)
        power = 1
        for k in range(1, self.longest + 1):
            at = at[left[at] >= k]
            if len(at) == 0:
                break
            # The hash of k characters is (k * B**k) plus the polynomial of the characters.
            tail[at] = tail[at] * np.uint64(_BASE) + codes[at + k - 1]
            power = power * _BASE % (1 << 64)
            full = tail[at] + np.uint64(k * power % (1 << 64))
            hit = np.flatnonzero(self.maybe[(full >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.hashes, full[hit]), len(self.hashes) - 1)
            real = self.hashes[place] == full[hit]
            hit, place = at[hit[real]], place[real]
            start.append(hit)
            length.append(np.full(len(hit), k))
            weight.append(self.weights[place])
            ids.append(self.ids[place])
            if k == 1:
                alone = np.ones(len(codes), bool)
                alone[hit] = False
                alone = np.flatnonzero(alone)
                wide = 1 + (codes[alone] > 0x7F).astype(int) + (codes[alone] > 0x7FF) + (codes[alone] > 0xFFFF)
                start.append(alone)
                length.append(np.full(len(alone), 1))
                weight.append(wide * self.byte_score)
                ids.append(np.full(len(alone), -1))
        start, length, weight, ids = (np.concatenate(x) for x in (start, length, weight, ids))
        return size, node[start], node[start] + length, weight, ids, start, unit[start]

    @staticmethod
    def _sweep(value: np.ndarray, frm: np.ndarray, to: np.ndarray, weight: np.ndarray, step: np.ndarray) -> None:
        """value[to] = max(value[frm] + weight), in order of step; edges of a step don't depend on each other."""
        order = np.lexsort((to, step))
        frm, to, weight, step = frm[order], to[order], weight[order], step[order]
        cuts = [*np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])).tolist(), len(step)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            t = to[s:e]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            value[t[first]] = np.maximum.reduceat(value[frm[s:e]] + weight[s:e], first)

    def solve(self, units: list[str]) -> list[tuple[float, float, bytes]]:
        """(best score, loss of the second best path or inf, ids of the best path) of each unit."""
        size, frm, to, weight, ids, char, unit = self._edges(units)
        nodes = int(size.sum()) + len(units)
        begin = np.cumsum(size + 1) - size - 1
        end = begin + size
        ahead, back = np.full(nodes, -np.inf), np.full(nodes, -np.inf)
        ahead[begin] = back[end] = 0.0
        self._sweep(ahead, frm, to, weight, to - begin[unit])
        self._sweep(back, to, frm, weight, end[unit] - frm)
        # Of the best edges into a node the longest is the path's.
        order = np.lexsort((frm, to))
        tight = order[(ahead[frm] + weight == ahead[to])[order]]
        lead = tight[np.concatenate([[True], to[tight][1:] != to[tight][:-1]])] if len(tight) else tight
        into = np.full(nodes, -1)
        into[to[lead]] = lead
        on_path = np.zeros(len(frm), bool)
        now = end.copy()
        while True:
            now = now[into[now] >= 0]
            if len(now) == 0:
                break
            on_path[into[now]] = True
            now = frm[into[now]]
        loss = np.full(len(units), np.inf)
        off = np.flatnonzero(~on_path)
        np.minimum.at(loss, unit[off], ahead[end[unit[off]]] - (ahead[frm[off]] + weight[off] + back[to[off]]))
        loss = np.maximum(loss, 0.0)
        path = np.flatnonzero(on_path)
        path = path[np.argsort(frm[path], kind="stable")]
        cuts = np.searchsorted(unit[path], np.arange(len(units) + 1)).tolist()
        raw, unit_step = ids[path].astype(self.width).tobytes(), np.dtype(self.width).itemsize
        odd = set(unit[path][ids[path] < 0].tolist())
        text = "".join(units)
        out = []
        for u, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if u in odd:
                seq = [x for k in path[s:e].tolist() for x in ([int(ids[k])] if ids[k] >= 0 else [self.byte_id[b] for b in text[char[k]].encode()])]
                found = np.array(seq, self.width).tobytes()
            else:
                found = raw[s * unit_step : e * unit_step]
            out.append((float(ahead[end[u]]), float(loss[u]), found))
        return out

    def _nbest(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """(score, ids) of the unit's n best paths, best first, by A* from its end."""
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(unit) + 1)]
        for s in range(len(unit)):
            for e in range(s + 1, min(len(unit), s + self.longest) + 1):
                if unit[s:e] in self.score:
                    w, i = self.score[unit[s:e]]
                    into[e].append((s, w, (i,)))
            if unit[s] not in self.score:
                b = unit[s].encode()
                into[s + 1].append((s, len(b) * self.byte_score, tuple(self.byte_id[x] for x in b)))
        ahead = [0.0]
        for e in range(1, len(unit) + 1):
            ahead.append(max(ahead[s] + w for s, w, _ in into[e]))
        # Entries: minus the score of the best whole path with this suffix, node, age, suffix score, suffix.
        # Among equal scores (to rounding) the one nearest the start goes on, so ties don't fan out.
        queue, age, out = [(round(-ahead[-1], 8), len(unit), 0, 0.0, None)], 0, []
        while queue and len(out) < n:
            _, node, _, score, suffix = heapq.heappop(queue)
            if node == 0:
                ids = []
                while suffix:
                    ids.extend(suffix[0])
                    suffix = suffix[1]
                out.append((score, np.array(ids, self.width).tobytes()))
                continue
            for s, w, ids in sorted(into[node]):
                age += 1
                heapq.heappush(queue, (round(-(ahead[s] + w + score), 8), s, age, w + score, (ids, suffix)))
        return out

    def units(self, texts: list[str]) -> list[list[str]]:
        """Each normalised text, cut where no piece has the two characters side by side."""
        whole = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        joined = "".join(whole)
        at = self.place[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum([len(t) for t in whole])
        cut = np.zeros(len(joined) + 1, bool)
        cut[1:-1] = ~self.beside[at[:-1], at[1:]] if len(at) > 1 else False
        cut[ends] = cut[0] = True
        bounds = np.flatnonzero(cut)
        cuts = bounds.tolist()
        parts = [joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        n = [0, *np.searchsorted(bounds, ends).tolist()]
        return [parts[a:b] for a, b in zip(n, n[1:], strict=False)]

    def _learn(self, texts: list[list[str]]) -> None:
        every = set().union(*texts)
        new = every.difference(self.slot)
        if len(self.slot) + len(new) > CACHE_UNITS:
            self.slot.clear()
            self.paths.clear()
            new = every
            if len(new) > len(self.best[0]):
                self.best = tuple(np.zeros(len(new), x.dtype) for x in self.best)
        score, loss, count = self.best
        held, size = [], 0
        step = np.dtype(self.width).itemsize

        def flush():
            for u, (a, b, ids) in zip(held, self.solve(held), strict=True):
                k = len(self.paths)
                self.slot[u] = k
                score[k], loss[k], count[k] = a, b, len(ids) // step
                self.paths.append(ids)

        for u in new:
            held.append(u)
            size += len(u)
            if size >= CHUNK:
                flush()
                held, size = [], 0
        if held:
            flush()

    def encode(self, texts: list[str], n: int = N_BEST) -> list[list[tuple[float, bytes]]]:
        """(score, ids) of the n best segmentations of each text, best first."""
        cut = self.units(texts)
        self._learn(cut)
        score, loss, count = self.best
        step, out = np.dtype(self.width).itemsize, []
        for units in cut:
            at = np.fromiter(map(self.slot.__getitem__, units), np.int64, len(units))
            ids, total = b"".join(map(self.paths.__getitem__, at.tolist())), float(score[at].sum())
            found = [(total, ids)]
            if len(units) and n > 1:
                losses = loss[at]
                pick = np.arange(len(at)) if len(at) < n else np.argpartition(losses, n - 2)[: n - 1]
                # All units at or under the largest loss picked; the earlier ones of equal losses.
                close = np.flatnonzero(losses <= losses[pick].max())
                close = np.sort(close[np.argsort(losses[close], kind="stable")[: n - 1]])
                ends = np.cumsum(count[at]) * step
                options = [self.nbest(units[k], n) for k in close.tolist()]
                spans = [(int(ends[k] - count[at[k]] * step), int(ends[k])) for k in close.tolist()]
                found = self._combine(total, ids, options, spans, n)
            out.append(found)
        return out

    @staticmethod
    def _combine(total: float, ids: bytes, options: list[list[tuple[float, bytes]]], spans: list[tuple[int, int]], n: int) -> list[tuple[float, bytes]]:
        """The n best choices of one option for each span, best first; an option's loss is exact beforehand."""
        start = (0,) * len(options)
        queue, seen, out = [(0.0, start)], {start}, []
        while queue and len(out) < n:
            loss, choice = heapq.heappop(queue)
            parts, at = [], 0
            for k, (s, e), o in zip(choice, spans, options, strict=True):
                if k:
                    parts += [ids[at:s], o[k][1]]
                    at = e
            out.append((total - loss, b"".join([*parts, ids[at:]])))
            for i, o in enumerate(options):
                if choice[i] + 1 < len(o):
                    more = (*choice[:i], choice[i] + 1, *choice[i + 1 :])
                    if more not in seen:
                        seen.add(more)
                        heapq.heappush(queue, (loss + o[choice[i]][0] - o[choice[i] + 1][0], more))
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, self.width).tolist()))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


HOLDERS["op10"] = lattice.cache_clear


def nbest_segmentations(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """doc_id, ids, nbest, decoded of each row. path: a model file that executors can open.

    ids: of the best segmentation; nbest: array<struct<score,n_tokens,ids_crc32>>, best first, the crc over
    little-endian 32-bit ids; decoded: the text that the ids give.
    """
    item = pa.struct([("score", pa.float64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("op10")
        lat = lattice(path)

        def row(found):
            best = [np.frombuffer(ids, lat.width) for _, ids in found]
            return [{"score": s, "n_tokens": len(i), "ids_crc32": zlib.crc32(i.astype("<u4").tobytes())} for (s, _), i in zip(found, best, strict=True)]

        for b in batches:
            for first, texts in slices(b, 1, CHARS):
                found = lat.encode([t or "" for t in texts], n)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(first, len(texts)),
                        pa.array([None if t is None else np.frombuffer(f[0][1], lat.width).astype(np.int32) for t, f in zip(texts, found, strict=True)], pa.list_(pa.int32())),
                        pa.array([None if t is None else row(f) for t, f in zip(texts, found, strict=True)], pa.list_(item)),
                        pa.array([None if t is None else lat.decode(f[0][1]) for t, f in zip(texts, found, strict=True)], pa.string()),
                    ],
                    ["doc_id", "ids", "nbest", "decoded"],
                )
        release()

    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, ids array<int>, nbest array<struct<score:double,n_tokens:bigint,ids_crc32:bigint>>, decoded string")


def digest(segmented: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, score, loss_2 to loss_4 (against the best), n_best, decoded_sha256."""
    best = F.get("nbest", F.lit(0))
    loss = lambda k: (best["score"] - F.get("nbest", F.lit(k - 1))["score"]).alias(f"loss_{k}")
    return segmented.select("doc_id", best["n_tokens"].alias("n_tokens"), best["ids_crc32"].alias("ids_crc32"), best["score"].alias("score"), loss(2), loss(3), loss(4), F.size("nbest").alias("n_best"), F.sha2("decoded", 256).alias("decoded_sha256"))
