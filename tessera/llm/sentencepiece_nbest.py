"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text has an edge for each vocabulary piece (and one unknown
edge for a character that no piece covers, written as its bytes).  A forward
Viterbi pass gives the best score up to every position; backward A-star search
then takes those scores as exact heuristics and pops complete segmentations in
order of their score.

A lattice falls apart wherever no piece holds two neighbouring characters, so
texts are cut there.  The forward pass runs over all new parts of a slice in
step, and what it finds is remembered within bounds of entries and of bytes.
The N best of a text can only differ from its best in the ``n - 1`` parts that
lose least by their second-best segmentation, so A-star runs on these alone.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_or_empty

UNKNOWN_PENALTY = 10.0
SEGMENT = 1 << 20  # characters whose parts are looked at together
CACHED = 200_000  # parts that a worker remembers, and the bytes that they may take
CACHED_BYTES = 32 << 20
SLICE = 1 << 20

Found = list[tuple[float, bytes]]  # score and packed ids, best first


class _Lattice:
    """Edges of the lattices of many parts, end to end in one row of characters,
    with the two best scores and the best last edge of every position."""

    def __init__(self, model: Pieces, parts: list[str]):
        sizes = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(sizes) + np.arange(len(parts))  # each part has one position more than characters
        self.first = self.ends - sizes
        char = np.ones(self.ends[-1] + 1, bool)  # positions at which a character begins
        char[self.ends] = False
        at = np.flatnonzero(char)
        kinds = np.zeros(len(char), np.int64)
        kinds[at] = model.classes("".join(parts))
        stop = np.repeat(self.ends, sizes)
        node, found = np.zeros(len(at), np.int64), []
        begin, ahead = at, at
        while len(begin):
            node = model.child(node, kinds[ahead])
            ok = node > 0
            begin, ahead, stop, node = begin[ok], ahead[ok] + 1, stop[ok], node[ok]
            piece = model.piece_at[node]
            ok = piece >= 0
            found.append((begin[ok], ahead[ok], piece[ok]))
            ok = ahead < stop
            begin, ahead, stop, node = begin[ok], ahead[ok], stop[ok], node[ok]
        if found:
            char[found[0][0]] = False  # those with a piece of one character
        unknown = np.flatnonzero(char)
        found.append((unknown, unknown + 1, np.full(len(unknown), -1)))
        start, end, piece = (np.concatenate(x) for x in zip(*found))
        step = start - np.repeat(self.first, sizes + 1)[start]
        order = np.lexsort((end, step))
        self.start, self.end, self.piece = start[order], end[order], piece[order]
        self.weight = np.where(self.piece < 0, model.unknown, model.score_of[self.piece])
        self.limits = np.searchsorted(step[order], np.arange(int(sizes.max(initial=0)) + 1))
        self._forward()

    def _forward(self) -> None:
        n = self.ends[-1] + 1
        self.best, self.second, self.back = np.full(n, -np.inf), np.full(n, -np.inf), np.full(n, -1)
        self.best[self.first] = 0.0
        best, second = self.best, self.second
        # Edges that begin at the same step of their parts end at different positions.
        for lo, hi in zip(self.limits[:-1].tolist(), self.limits[1:].tolist()):
            s, e, w = self.start[lo:hi], self.end[lo:hi], self.weight[lo:hi]
            here, there = best[s] + w, best[e]
            better = here > there
            second[e] = np.where(better, np.maximum(there, second[s] + w), np.maximum(second[e], here))
            best[e] = np.maximum(here, there)
            self.back[e[better]] = lo + np.flatnonzero(better)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges of the best segmentations, part by part, and how many each part has."""
        at, left, trail = self.ends.copy(), np.arange(len(self.ends)), []
        while len(left := left[at[left] > self.first[left]]):
            edge = self.back[at[left]]
            trail.append((left, edge))
            at[left] = self.start[edge]
        part, edge = (np.concatenate(x[::-1]) for x in zip(*trail))
        return edge[np.argsort(part, kind="stable")], np.bincount(part, minlength=len(self.ends))

    def search(self, n: int) -> Iterator[list[tuple[float, list[int]]]]:
        """``(score, edges)`` of the ``n`` best segmentations of each part: A-star from
        the end.  The heuristic is exact, so what stands for a path at its queue place
        is the score it will have, and more than ``n`` places are never needed.  Equal
        scores come in the order of the shorter way left."""
        order = np.argsort(self.end, kind="stable")
        limits = np.searchsorted(self.end[order], np.arange(self.ends[-1] + 2)).tolist()
        into, start, weight, best = order.tolist(), self.start.tolist(), self.weight.tolist(), self.best.tolist()
        for first, end in zip(self.first.tolist(), self.ends.tolist()):
            queue, out, made = [(-best[end], end, 0, 0.0, None)], [], 0
            while queue and len(out) < n:
                rank, at, _, done, path = queue.pop(0)
                if at == first:
                    edges = []
                    while path:
                        edge, path = path
                        edges.append(edge)
                    out.append((-rank, edges))
                    continue
                room = n - len(out)
                for edge in into[limits[at] : limits[at + 1]]:
                    s, now = start[edge], done + weight[edge]
                    rank = -(best[s] + now)
                    if len(queue) < room or rank <= queue[room - 1][0]:
                        made += 1
                        insort(queue, (rank, s, made, now, (edge, path)))
                        del queue[room:]
            yield out


class Pieces:
    """Vocabulary and scores of a model file."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.model, self.model.get_piece_size()
        normal = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in normal}
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown_id = m.unk_id()
        self.score_of = np.array([m.get_score(i) for i in range(n)], np.float64)
        self.unknown = float(min((s for s in self.score_of[normal] if s > -1e8), default=0.0)) - UNKNOWN_PENALTY
        chars = sorted({c for p in self.ids for c in p})
        self.kinds = len(chars) + 1  # class 0: characters of no piece
        self.class_of = np.zeros(0x110000, np.uint16 if self.kinds < 1 << 16 else np.uint32)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, self.kinds)
        self.joins = np.zeros((self.kinds, self.kinds), bool)  # classes that stand side by side in some piece
        # A trie as sorted keys (node, class): node 0 is the root.
        nodes = {"": 0} | {p: k for k, p in enumerate(sorted({p[:k] for p in self.ids for k in range(1, len(p) + 1)}), 1)}
        kinds = dict(zip(chars, range(1, self.kinds)))
        keys = np.array([nodes[p[:-1]] * self.kinds + kinds[p[-1]] for p in list(nodes)[1:]], np.int64)
        order = np.argsort(keys)
        self.keys, self.children = np.append(keys[order], np.iinfo(np.int64).max), np.append(order + 1, 0)
        self.piece_at = np.array([self.ids.get(p, -1) for p in nodes], np.int64)
        for p in nodes:
            if len(p) > 1:
                self.joins[kinds[p[-2]], kinds[p[-1]]] = True
        self.text = np.array(["" if m.is_control(i) else m.id_to_piece(i) for i in range(n)], dtype=object)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.high = np.zeros(n, bool)  # bytes beyond ASCII are joined before they are decoded
        for b, i in self.bytes.items():
            self.text[i], self.high[i] = chr(b), b > 127
        self._forget()

    def _forget(self) -> None:
        """Starts anew with what is remembered: parts by number, and lists of their N best."""
        self.number: dict[str, int] = {}
        self.packs: list[bytes] = []
        self.scores, self.losses = np.zeros(1024), np.zeros(1024)
        self.lists: dict[tuple[str, int], Found] = {}
        self.held = 0

    def classes(self, text: str) -> np.ndarray:
        return self.class_of[np.frombuffer(text.encode("utf-32-le"), "<u4")]

    def child(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Node below, or 0 where there is none."""
        key = node * self.kinds + kind
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.children[at], 0)

    def packed(self, lattice: _Lattice, texts: list[str], edges: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Packed ids of paths through parts ``texts`` of a lattice, which has ``edges``
        of them in a row; a character without a piece becomes its bytes."""
        ids = lattice.piece[edges]
        flat, at = ids.astype("<i4").tobytes(), (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
        out = [flat[a:b] for a, b in zip(at, at[1:])]
        of = np.repeat(np.arange(len(counts)), counts)
        for k in np.unique(of[ids < 0]).tolist():
            lo, hi, own = at[k] // 4, at[k + 1] // 4, []
            for i, c in zip(ids[lo:hi].tolist(), (lattice.start[edges[lo:hi]] - lattice.start[edges[lo]]).tolist()):
                own += [i] if i >= 0 else [self.bytes[b] for b in texts[k][c].encode()] if self.bytes else [self.unknown_id]
            out[k] = np.array(own, "<i4").tobytes()
        return out

    def parts(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Parts of some texts in a row, and how many each text has."""
        joined, sizes = "".join(texts), np.array([len(t) for t in texts])
        kinds = self.classes(joined)
        cut = np.ones(len(joined) + 1, bool)
        cut[1:-1] = ~self.joins[kinds[:-1], kinds[1:]]
        cut[np.cumsum(sizes)] = True
        at = np.flatnonzero(cut).tolist()
        upto = np.cumsum(cut)[np.concatenate([[0], np.cumsum(sizes)])]
        return [joined[a:b] for a, b in zip(at, at[1:])], np.diff(upto)

    def numbers(self, parts: list[str]) -> np.ndarray:
        """Number of each part among those remembered; new ones are added."""
        known = list(map(self.number.get, parts))
        if None in known:
            new = list(dict.fromkeys([p for p, k in zip(parts, known) if k is None]))
            lattice, count = _Lattice(self, new), len(self.packs)
            while len(self.scores) < count + len(new):
                self.scores, self.losses = np.resize(self.scores, 2 * len(self.scores)), np.resize(self.losses, 2 * len(self.losses))
            self.scores[count : count + len(new)] = lattice.best[lattice.ends]
            self.losses[count : count + len(new)] = lattice.best[lattice.ends] - lattice.second[lattice.ends]
            self.number.update(zip(new, range(count, count + len(new))))
            self.packs += self.packed(lattice, new, *lattice.paths())
            self.held += 5 * sum(map(len, new))
            known = list(map(self.number.get, parts))
        return np.array(known, np.int64)

    def _segments(self, texts: list[str]) -> Iterator[list[str]]:
        """Texts in groups of about SEGMENT characters."""
        held, size = [], 0
        for t in texts:
            if held and size + len(t) > SEGMENT:
                yield held
                held, size = [], 0
            held.append(t)
            size += len(t)
        yield held

    def _pieces_of(self, text: str) -> list[str]:
        """A long text cut into segments, at places where its lattice falls apart."""
        out, at = [], 0
        while len(text) - at > SEGMENT:
            end = at + SEGMENT
            while end < len(text) and self.joins[tuple(self.classes(text[end - 1 : end + 1]).tolist())]:
                end += 1
            out.append(text[at:end])
            at = end
        return [*out, text[at:]]

    def weakest(self, own: np.ndarray, n: int) -> list[int]:
        """Places of the up to ``n`` parts that lose least, the first of equal ones first."""
        losses = self.losses[own]
        if len(own) > 4 * n:
            places = np.flatnonzero(losses <= np.partition(losses, n - 1)[n - 1])
        else:
            places = np.arange(len(own))
        places = places[np.argsort(losses[places], kind="stable")[:n]]
        return places[losses[places] < np.inf].tolist()

    def fill(self, wanted: set[str], n: int) -> None:
        """Remembers the N best of parts."""
        new = sorted(p for p in wanted if (p, n) not in self.lists)
        if new:
            lattice = _Lattice(self, new)
            for part, found in zip(new, lattice.search(n)):
                edges, counts = [e for _, own in found for e in own], [len(own) for _, own in found]
                self.lists[part, n] = list(zip([s for s, _ in found], self.packed(lattice, [part] * len(found), np.array(edges), np.array(counts))))
                self.held += (4 * len(found) + 1) * len(part)

    def encoded(self, texts: list[str], n: int) -> Iterator[tuple[Found, bool]]:
        """Of each normalised text, ``(score, packed ids)`` of the ``n`` best
        segmentations, and whether all of them decode to the text."""
        for group in self._segments(texts):
            if len(self.number) > CACHED or self.held > CACHED_BYTES:
                self._forget()
            if len(group) > 1 or len(group[0]) <= SEGMENT:
                parts, counts = self.parts(group)
                own = self.numbers(parts)
            else:
                each = [self.parts([t])[0] for t in self._pieces_of(group[0])]
                own = np.concatenate([self.numbers(p) for p in each])
                parts = [p for some in each for p in some]
                counts = np.array([len(parts)])
            limits = np.concatenate([[0], np.cumsum(counts)]).tolist()
            weak = [[lo + k for k in self.weakest(own[lo:hi], n - 1)] if n > 1 and hi > lo else [] for lo, hi in zip(limits, limits[1:])]
            self.fill({parts[k] for places in weak for k in places}, n)
            for text, lo, hi, places in zip(group, limits, limits[1:], weak):
                yield self._combined(text, own[lo:hi], [(k - lo, parts[k]) for k in places], n)

    def _combined(self, text: str, own: np.ndarray, places: list[tuple[int, str]], n: int) -> tuple[Found, bool]:
        packs = [self.packs[k] for k in own.tolist()]
        best, score = b"".join(packs), float(self.scores[own].sum())
        choices = [[(self.scores[own[k]] - s, p) for s, p in self.lists[part, n] if p != packs[k]][: n - 1] for k, part in places]
        # The n cheapest sums of one loss (or none) from each weak part.
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        for k, options in enumerate(choices):
            sums = nsmallest(n, [*sums, *((lost + o[0], (*picks, (k, j))) for lost, picks in sums for j, o in enumerate(options))])
        out, good = [(score, best)], self.decode(np.frombuffer(best, "<i4")) == text
        for lost, picks in sums[1:]:
            ids = list(packs)
            for k, j in picks:
                ids[places[k][0]] = choices[k][j][1]
                good = good and self.decode(np.frombuffer(choices[k][j][1], "<i4")) == places[k][1]
            out.append((score - float(lost), b"".join(ids)))
        return out, good

    def encode(self, text: str, n: int) -> Found:
        """``(score, packed ids)`` of the ``n`` best segmentations of a text."""
        return next(self.encoded([self.model.Normalize(text)], n))[0]

    def decode(self, ids: np.ndarray) -> str:
        """The normalised text of ids; byte pieces are joined as UTF-8."""
        if not self.high[ids].any():
            return "".join(self.text[ids].tolist())
        out, run = [], bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.text[i])
        return "".join(out) + run.decode("utf-8", "replace")


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model of a file, one for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def encode(docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, nbest`` for every row: an array of up to ``n`` structs of
    ``score, ids``, best first.

    A null or empty text has one empty segmentation; a text with fewer than ``n``
    segmentations has all of them.  Equal scores come in an order that depends on
    the text alone.  Repeated rows and ids, null ids too, give a row each; other
    columns of ``docs``, whatever their names, are not read.  Time and memory grow
    in proportion to a text, also to one that is a single long word; an empty table
    gives an empty one.
    """

    def make():
        model = pieces(model_path)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            plain = [model.model.Normalize(t) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "nbest": [[{"score": s, "ids": np.frombuffer(p, "<i4")} for s, p in found] for found, _ in model.encoded(plain, n)]}

        return work

    return arrow_map(_given(docs, id_col, text_col), make, "doc_id long, nbest array<struct<score:double,ids:array<int>>>", slice_bytes=SLICE)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, <ids_col>``: the normalised texts.  Null
    or empty ids give an empty text; bytes that are no UTF-8 give U+FFFD.  Repeated
    rows give a row each, an empty table an empty one."""

    def make():
        model = pieces(model_path)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            yield {"doc_id": batch.column("doc_id"), "text": [model.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]}

        return work

    return arrow_map(rows.select("doc_id", F.col(ids_col).alias("ids")), make, "doc_id long, text string", slice_bytes=SLICE)


def summary(docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_pieces, ids_crc32, score, n_found, last_score,
    nbest_crc32, round_trip``; whether decoding gives the normalised text back, of
    the best segmentation as a whole and of the others in the parts where they
    differ from it.  Nulls, ties, repeats and long texts are as in ``encode``."""

    def make():
        model = pieces(model_path)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            out: dict[str, list] = {c: [] for c in ("n_pieces", "ids_crc32", "score", "n_found", "last_score", "nbest_crc32", "round_trip")}
            plain = [model.model.Normalize(t) for t in batch.column("text").to_pylist()]
            for found, back in model.encoded(plain, n):
                crc = 0
                for _, p in found:
                    crc = zlib.crc32(p, crc)
                row = (len(found[0][1]) // 4, zlib.crc32(found[0][1]), found[0][0], len(found), found[-1][0], crc, back)
                for c, v in zip(out, row):
                    out[c].append(v)
            yield {"doc_id": batch.column("doc_id")} | out

        return work

    return arrow_map(_given(docs, id_col, text_col), make, "doc_id long, n_pieces long, ids_crc32 long, score double, n_found int, last_score double, nbest_crc32 long, round_trip boolean", slice_bytes=SLICE)
