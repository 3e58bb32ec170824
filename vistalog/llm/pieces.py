"""SentencePiece encoding by forward filtering and backward sampling, and its lossless decoding.

A text's segmentations form a lattice of the model's pieces. No piece reaches over the start of a word, so the
lattice falls into those of words, and the forward sums of a word are computed once a batch. Sampling goes backward
from each word's end; its random numbers are a hash of the row's key, the word's place and the step, so a row is cut
alike in any batch, partition or retry.

A word of very many characters, as in unbroken text, is worked through in windows: its forward sums are kept, its lattice
is made again for each window on the way back, so that memory is a few numbers a character.

A space is written as the marker that the model's pieces use, one more stands before the text, and characters without
a piece, the marker itself among them, become UTF-8 byte pieces; decoding takes all of this back.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix64, slices

MARK, LITERAL, _BYTES = 0x2581, 0x110000, 1 << 24
_K = np.uint64(0x9E3779B97F4A7C15)
_BATCH = 800_000
_BITS = 22
#: Characters from which a word is worked through in windows of so many characters.
LONG, WINDOW = 4096, 100_000


class Model:
    """Pieces of a SentencePiece model as hash tables, with their weights.

    Unigram scores are log probabilities and are used as they are. Scores of a BPE model are ranks; their weight is
    that of Zipf's law, -ln(rank + 2). ``alpha`` scales weights: small values even segmentations out, large ones
    come near the best one.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1, np.int64)
        usual = []
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(names[i][3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                usual.append(i)
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces, so it isn't lossless")
        usual = [i for i in usual if "▁" not in names[i].lstrip("▁")]
        scores = np.array([sp.get_score(i) for i in usual])
        ranks = (scores == np.round(scores)).all()
        weights = alpha * (-np.log(-scores + 2) if ranks else scores)
        self.fallback = float(weights.min()) - alpha * 5
        self.longest = max(len(names[i]) for i in usual)
        keys = np.array([self._key(np.array([ord(c) for c in names[i]], np.uint64)) for i in usual], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.weights = keys[order], np.array(usual)[order], weights[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.raw = [b""] * n
        for i in usual:
            self.raw[i] = names[i].replace("▁", " ").encode()
        for b, i in enumerate(self.byte.tolist()):
            self.raw[i] = bytes([b])

    @staticmethod
    def _key(points: np.ndarray) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in points:
            h = mix64(h * _K + c + np.uint64(1))
        return h[0]

    def lattice(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, piece) of the piece of length l + 1 that ends before each position; ``start`` and ``end`` are those of each position's word."""
        n, width = len(points), self.longest
        weight, piece = np.full((n + 1, width), -np.inf), np.full((n + 1, width), -1, np.int32)
        h, c = np.zeros(n, np.uint64), points.astype(np.uint64) + np.uint64(1)
        alive = np.arange(n)
        for size in range(1, width + 1):
            alive = alive[alive + size <= end[alive]]
            if not len(alive):
                break
            h[alive] = mix64(h[alive] * _K + c[alive + size - 1])
            at = alive[self.seen[(h[alive] >> np.uint64(64 - _BITS)).astype(np.int64)]]
            k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            good = self.keys[k] == h[at]
            weight[at[good] + size, size - 1] = self.weights[k[good]]
            piece[at[good] + size, size - 1] = self.ids[k[good]]
        alone = np.flatnonzero(piece[1:, 0] < 0)
        weight[alone + 1, 0] = self.fallback
        piece[alone + 1, 0] = _BYTES + points[alone]
        return weight, piece

    def forward(self, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Cumulative chances, over lengths, of the piece that ends before each position, given that one does."""
        n, width = len(start), self.longest
        offset = np.arange(n) - start + 1
        order = np.argsort(offset, kind="stable")
        cuts = np.searchsorted(offset[order], np.arange(1, int(offset.max()) + 2)) if n else np.zeros(1, int)
        total, out = np.zeros(n + 1), np.zeros((n + 1, width), np.float64)
        # total[p] is the log sum of segmentations that end before p, for a word that p lies in; 0 at its start.
        for t in range(1, len(cuts)):
            p = order[cuts[t - 1] : cuts[t]] + 1
            k = min(t, width)
            before = np.where(np.arange(1, k + 1) == t, 0.0, total[p[:, None] - np.arange(1, k + 1)])
            terms = before + weight[p, :k]
            top = terms.max(1, keepdims=True)
            e = np.exp(terms - top)
            sums = np.cumsum(e, axis=1)
            total[p] = top[:, 0] + np.log(sums[:, -1])
            out[p, :k] = sums / sums[:, -1:]
            out[p, k:] = 2.0
        return out

    def sample(self, texts: list[str], keys: list) -> list[np.ndarray]:
        """Piece ids of each text, sampled; ``keys`` seed the rows."""
        joined = "".join(" " + t for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        docs = np.cumsum(lengths) - lengths
        points = np.where(points == MARK, LITERAL, np.where(points == 32, MARK, points))
        mark = points == MARK
        first = mark.copy()
        first[1:] &= ~mark[:-1]
        first[docs] = True
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(points)))
        within = np.arange(len(points)) - np.repeat(begin, size)
        key = np.add.reduceat(mix64((points.astype(np.uint64) << np.uint64(32)) + within.astype(np.uint64)), begin)
        long = np.flatnonzero(size > LONG)
        key[long] = 0
        _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        usize = np.where(size[at] > LONG, 0, size[at])
        ustart = np.cumsum(usize) - usize
        own = points[np.repeat(begin[at] - ustart, usize) + np.arange(int(usize.sum()))]
        start, end = np.repeat(ustart, usize), np.repeat(ustart + usize, usize)
        weight, piece = self.lattice(own, start, end)
        chances = self.forward(weight, start)
        doc = np.searchsorted(docs, begin, side="right") - 1
        seed = np.array([xxhash.xxh64_intdigest(repr(k)) for k in keys], np.uint64)
        place = np.arange(len(begin)) - np.searchsorted(begin, docs)[doc]
        state = mix64(seed[doc] * _K + place.astype(np.uint64))
        position, stop = (ustart + usize)[inverse], ustart[inverse]
        active, step, found = np.flatnonzero(size <= LONG), 0, []
        count = np.zeros(len(begin), np.int64)
        alone = [self._windowed(points[begin[i] : begin[i] + size[i]], state[i]) for i in long]
        count[long] = [len(v) for v in alone]
        while len(active):
            u = (mix64(state[active] + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            p = position[active]
            length = (chances[p] <= u[:, None]).sum(1)
            found.append((active, piece[p, length]))
            position[active] = p = p - length - 1
            count[active] += 1
            active = active[p > stop[active]]
            step += 1
        after = np.cumsum(count)
        out = np.empty(int(after[-1]), np.int64)
        for k, (who, ids) in enumerate(found):
            out[after[who] - 1 - k] = ids
        for i, ids in zip(long, alone, strict=True):
            out[after[i] - len(ids) : after[i]] = ids
        ends = after[np.append(np.searchsorted(begin, docs[1:]), len(begin)) - 1]
        if (out >= _BYTES).any():
            out, ends = self._expanded(out, ends)
        return np.split(out.astype(np.int32), ends[:-1])

    def _window(self, points: np.ndarray, a: int, b: int) -> tuple[list[int], list[int], list[float], list[int]]:
        """Pieces that end before positions a + 1 to b of one word: where each position's begin, and their lengths, weights and ids."""
        low = max(0, a - self.longest + 1)
        part = points[low:b]
        weight, piece = self.lattice(part, np.zeros(len(part), np.int64), np.full(len(part), len(part)))
        weight, piece = weight[a - low + 1 :], piece[a - low + 1 :]
        row, col = np.nonzero(piece >= 0)
        return np.searchsorted(row, np.arange(b - a + 1)).tolist(), (col + 1).tolist(), weight[row, col].tolist(), piece[row, col].tolist()

    def _windowed(self, points: np.ndarray, state: np.uint64) -> np.ndarray:
        """sample() for one long word: forward over windows, and back over the same windows."""
        n, exp, log = len(points), math.exp, math.log
        total, cuts = array("d", [0.0]) * (n + 1), list(range(0, n, WINDOW))
        for a in cuts:
            first, sizes, weights, _ = self._window(points, a, min(n, a + WINDOW))
            for i in range(len(first) - 1):
                p = a + i + 1
                terms = [total[p - sizes[j]] + weights[j] for j in range(first[i], first[i + 1])]
                top = max(terms)
                total[p] = top + log(sum([exp(t - top) for t in terms]))
        out, p, step, drawn = array("l"), n, 0, []
        for a in reversed(cuts):
            first, sizes, weights, ids = self._window(points, a, min(n, a + WINDOW))
            while p > a:
                if step % 4096 == 0:
                    drawn = ((mix64(state + np.arange(step, step + 4096, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
                u, chance = drawn[step % 4096], 0.0
                for j in range(first[p - a - 1], first[p - a]):
                    chance += exp(total[p - sizes[j]] + weights[j] - total[p])
                    if chance > u:
                        break
                out.append(ids[j])
                p, step = p - sizes[j], step + 1
        return np.frombuffer(out, np.int64)[::-1]

    def _expanded(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = np.flatnonzero(ids >= _BYTES)
        spelled = [chr(MARK if c == LITERAL else c).encode("utf-8", "surrogatepass") for c in (ids[where] - _BYTES).tolist()]
        widths = np.ones(len(ids), np.int64)
        widths[where] = [len(s) for s in spelled]
        after = np.cumsum(widths)
        out = np.repeat(ids, widths)
        to = np.repeat(after[where] - widths[where], widths[where]) + np.concatenate([np.arange(len(s)) for s in spelled])
        out[to] = self.byte[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, after[ends - 1]

    def decode(self, ids: np.ndarray) -> str:
        """The text whose pieces these are."""
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def model(path: str, alpha: float) -> Model:
    return Model(path, alpha)


def public_model() -> str:
    """Path of the public model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, alpha: float = 0.5, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_sha256, decoded_sha256, lossless, and ids, for each row of ``docs`` (doc_id, text).

    The hashes are of the ids as little-endian unsigned 32-bit integers and of the UTF-8 text decoded from them;
    lossless is true where this is the text. doc_id seeds the row: equal rows are cut alike, equal texts under other
    keys may not be. A null text is an empty one, whose only id is the marker's; a null doc_id is a key of its own;
    other columns are ignored. There is no shuffle.
    """
    at = path or public_model()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(at, alpha)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) + 1 for t in texts], _BATCH):
                ids = m.sample(texts[a:b], keys[a:b])
                back = [m.decode(v) for v in ids]
                cols = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(v) for v in ids], pa.int64()),
                    pa.array([hashlib.sha256(v.astype("<u4").tobytes()).hexdigest() for v in ids]),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]),
                    pa.array([t == s for t, s in zip(back, texts[a:b], strict=True)]),
                ]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "lossless"] + ["ids"] * with_ids)

    kinds = "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, lossless boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) as doc_id and text; null ids give a null text."""
    at = path or public_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(at, 1.0)
        for batch in batches:
            texts = [None if v is None else m.decode(np.array(v, np.int64)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
