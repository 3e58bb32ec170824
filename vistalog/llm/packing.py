"""Packing by power-of-two decomposition: pieces of binary length, bucketed by length.

A document of n ids becomes pieces of the largest sequence length, then one piece for each set bit of
the rest, longest first. A piece is a sequence of its own: its length is a power of two, so it needs no
padding, and no sequence holds ids of two documents. Equal lengths form a bucket, from which batches of a
fixed number of ids are drawn.
"""

from __future__ import annotations

import base64
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix64, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"
#: Characters whose classes the fast path knows; a text with any other goes to the tokenizer itself.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]")
_TOP = 0x250
_BATCH = 250_000


def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, for characters below U+0250."""
    kind = {"L": 1, "N": 2, "Z": 0}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], 3) for c in range(_TOP)], np.uint8)
    out[[9, 10, 13, 32]] = 0
    return out


def boundaries(points: np.ndarray, docs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Starts of the byte-level pre-tokens in joined texts; ``docs`` has the starts of the texts, none empty.

    The rule of the vocabulary: contractions, then runs of letters, numbers or others with one space before
    them, then white space up to the last character before a word.
    """
    n = len(points)
    kind = classes[points]
    first = np.zeros(n + 1, bool)
    first[docs] = True
    first[n] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(run)
    ends = np.append(starts[1:], n)
    token = run
    last = ends[(kind[starts] == 0) & ~first[ends]] - 1
    token[last] = True
    token[last[points[last] == 32] + 1] = False
    p = starts[(ends - starts == 1) & (points[starts] == 39)]
    p = p[token[p] & ~first[p + 1]]
    if len(p):
        padded = np.append(points, [0, 0])
        one, two = padded[p + 1], np.where(first[np.minimum(p + 2, n)], 0, padded[p + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        for found, width in ((short, 2), (long, 3)):
            token[p[found] + 1] = False
            at = p[found] + width
            token[at[at < n]] = True
    return np.flatnonzero(token)


class ByteTokenizer:
    """Ids of a byte-level vocabulary: equal to ``tokenizers`` on its file, but words are looked up once a batch.

    ``path`` is the tokenizers file; ``ranks`` the same vocabulary as ranks, which encodes single words. Texts
    with characters outside the Latin blocks go through ``tokenizers`` whole. ``words`` bounds the known words, of at most
    32 characters each: sorted hashes, and where the ids of each start in one array.
    """

    def __init__(self, path: str, ranks: str, pattern: str, words: int = 250_000):
        import tiktoken

        self.path = path
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.one = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.classes, self.words = _classes(), words
        self.known, self.begins, self.counts, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u4")
        self.salt = mix64(np.arange(1, _TOP + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.powers = np.zeros(0, np.uint64)

    @cached_property
    def slow(self):
        """The tokenizer itself, loaded when a text first needs it."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def _lookup(self, keys: np.ndarray, begin: np.ndarray, sizes: np.ndarray, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in one array, and for each of the distinct ``keys``, in order, where its own start and how many they are."""
        at = np.searchsorted(self.known, keys)
        hit = np.zeros(len(keys), bool)
        if len(self.known):
            hit = self.known[np.minimum(at, len(self.known) - 1)] == keys
        offsets, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        offsets[hit], counts[hit] = self.begins[at[hit]], self.counts[at[hit]]
        new = np.flatnonzero(~hit)
        if not len(new):
            return self.flat, offsets, counts
        ids = [self.one.encode_ordinary(joined[a : a + n]) for a, n in zip(begin[new].tolist(), sizes[new].tolist(), strict=True)]
        counts[new] = np.fromiter(map(len, ids), np.int64, len(ids))
        offsets[new] = len(self.flat) + np.cumsum(counts[new]) - counts[new]
        flat = np.concatenate([self.flat, np.fromiter((i for word in ids for i in word), "<u4", int(counts[new].sum()))])
        room = self.words - len(self.known)
        if room > 0:
            kept = new[sizes[new] <= 32][:room]
            mine = np.repeat(offsets[kept] - (np.cumsum(counts[kept]) - counts[kept]), counts[kept]) + np.arange(int(counts[kept].sum()))
            begins = len(self.flat) + np.cumsum(counts[kept]) - counts[kept]
            self.known, self.begins = np.insert(self.known, at[kept], keys[kept]), np.insert(self.begins, at[kept], begins)
            self.counts, self.flat = np.insert(self.counts, at[kept], counts[kept]), np.concatenate([self.flat, flat[mine]])
        return flat, offsets, counts

    def _fast(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        docs = np.concatenate([[0], np.cumsum(lengths)])
        starts = boundaries(points, docs[:-1], self.classes)
        sizes = np.diff(np.append(starts, len(points)))
        if (most := int(sizes.max())) > len(self.powers):
            self.powers = mix64(np.arange(1, 2 * most + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
        within = np.arange(len(points)) - np.repeat(starts, sizes)
        key = np.add.reduceat(self.salt[points] * self.powers[within], starts)
        distinct, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        flat, offsets, counts = self._lookup(distinct, starts[at], sizes[at], joined)
        each = counts[inverse]
        after = np.cumsum(each)
        out = flat[np.repeat(offsets[inverse] - (after - each), each) + np.arange(int(after[-1]))]
        cuts = np.append(0, after)[np.searchsorted(starts, docs)]
        data = out.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        fast = []
        for i, t in enumerate(texts):
            if t and _OTHER.search(t) is None:
                fast.append(i)
            elif t:
                out[i] = np.array(self.slow.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        for a, b in slices([len(texts[i]) for i in fast], _BATCH):
            for i, ids in zip(fast[a:b], self._fast([texts[i] for i in fast[a:b]]), strict=True):
                out[i] = ids
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str, ranks: str, pattern: str) -> ByteTokenizer:
    return ByteTokenizer(path, ranks, pattern)


def decompose(n: int, most: int) -> list[int]:
    """Piece lengths of ``n`` ids: as many of ``most`` (a power of two) as fit, then the rest's set bits, longest first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def public_vocabulary() -> tuple[str, str, str]:
    """Paths of the public byte-level vocabulary and its word pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pack(docs: DataFrame, most: int = 2048, end_id: int = 1, vocabulary: tuple[str, str, str] | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset, and ids.

    ``docs`` has doc_id and text; other columns are ignored, whatever their names. A null text is an empty one:
    its only id is ``end_id``. Equal rows are packed each for itself. An empty table gives an empty one. A null
    doc_id stays null. ``bucket`` is the length's binary logarithm. There is no shuffle: each piece is a sequence,
    and its number is unique because it comes from the scan's partition and the row within it.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    bounded_batches(docs.sparkSession)
    files = vocabulary or public_vocabulary()
    end = np.array([end_id], "<u4").tobytes()
    kinds = [pa.int64()] * 5 + [pa.int32()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(*files).encode
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keys = batch.column(0).to_pylist()
            for a, b in slices([len(t) + 1 for t in texts], 4 * _BATCH):
                cols: list[list] = [[] for _ in range(7)]
                for key, ids in zip(keys[a:b], encode(texts[a:b]), strict=True):
                    data = ids + end
                    view, n, at = memoryview(data), len(data) // 4, 0
                    for size in decompose(n, most):
                        piece = view[4 * at : 4 * (at + size)]
                        for c, v in zip(cols, (key, at, size, zlib.crc32(piece), n, size.bit_length() - 1), strict=False):
                            c.append(v)
                        if with_ids:
                            cols[6].append(np.frombuffer(piece, "<u4").astype(np.int32))
                        at += size
                arrays = [pa.array(c, k) for c, k in zip(cols[:6], kinds, strict=True)]
                if with_ids:
                    arrays.append(pa.array(cols[6], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed sequences with one folder for each length, from which a trainer draws batches of equal shape."""
    pieces.write.partitionBy("bucket").parquet(path)
