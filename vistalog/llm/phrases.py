"""Collocations: for each language the phrases of two to five words whose words attract each other most.

A phrase's score is that of its weakest cut, floor(1000 a n / (l r)), where a counts the phrase, n all words, l and r the
two sides of the cut. As a is at most r, no phrase that starts with a word w scores more than 1000 n / f(w): the counts of
prefixes bound what growing them can give. The search is best first: words are nodes in order of that bound, and prefixes
grow from the best nodes, a share of the words at a time, until a language's last wanted score is above the bound of all
nodes that are left.

Words are 64-bit ids, under a hash with which no two words of the corpus collide (this is checked); words that are too
rare for any phrase are zeros, as are the ends of pieces. Growth by a word is one pass over the ids: prefixes that the
pass before found often enough are known by a bit filter of bounded size, which may let others through but loses none,
and exact counts of the words themselves decide in the end. A phrase lies in a longer one of equal count if and only if
all its occurrences have the same word before them, or the same word after, so the exact counts carry the smallest and
largest neighbour and no phrase is joined with longer ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, mix64, written

_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_ENDS))
_SEGMENT = 18
_FOUND = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def words_of(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Codes of the words of all texts in order, and the words; code 0 ends a piece."""
    data = b"\n".join([b"", *texts, b""]).translate(_PLAIN).replace(b"\n", b" \n ")
    coded = pa.array([b"\n", b"", *data.split(b" ")], pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy()
    return codes[codes != 1], coded.dictionary.to_pylist()


def _ids(lang: bytes, words: list[bytes], seed: int) -> np.ndarray:
    """Ids of words in a language; those of the end of a piece and of no word are 0."""
    out = np.array([xxhash.xxh64_intdigest(lang + b"\0" + w, seed) or 1 for w in words], np.uint64)
    out[:2] = 0
    return out


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    langs = batch.column(0).dictionary_encode()
    codes, texts = langs.indices.to_numpy(), batch.column(1).cast(pa.binary())
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, texts.take(pa.array(np.flatnonzero(codes == k))).to_pylist()


def vocabulary(texts: DataFrame, seed: int, most: int = 150_000) -> DataFrame:
    """lang, word, id and f for each word of ``texts`` (lang, text); a task sends on what it has counted when that is ``most`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[bytes, int]] = {}

        def flush():
            for lang, own in counts.items():
                words = [b"\n", b"", *own]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(words[2:], pa.binary()).cast(pa.string()), pa.array(_ids(lang.encode(), words, seed)[2:].view(np.int64)), pa.array(list(own.values()), pa.int64())], ["lang", "word", "id", "f"])
            counts.clear()

        for batch in batches:
            for lang, own in _by_language(batch):
                codes, words = words_of(own)
                n, known = np.bincount(codes, minlength=len(words)).tolist(), counts.setdefault(lang, {})
                for w, c in zip(words[2:], n[2:], strict=True):
                    known[w] = known.get(w, 0) + c
            if sum(map(len, counts.values())) > most:
                yield from flush()
        yield from flush()

    return texts.mapInArrow(run, "lang string, word string, id long, f long").groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))


class Filter:
    """A set of 64-bit hashes as bits: all members are in it, and few others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = mix64(h) & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    @staticmethod
    def of(hashes: DataFrame, column: str, most_bits: int = 30) -> Filter | None:
        """The filter of a column of longs, with 16 bits a member as far as 2 ** ``most_bits`` allow; None for an empty table.

        Segments of the bits are made in tasks, so the driver gets the bits alone.
        """
        n = hashes.count()
        if not n:
            return None
        power = min(most_bits, max(_SEGMENT, int(16 * n - 1).bit_length()))

        def bit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.unique(mix64(b.column(0).to_numpy().view(np.uint64)) & np.uint64(2**power - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> _SEGMENT), pa.array((at & (2**_SEGMENT - 1)).astype(np.int32))], ["segment", "at"])

        def segment(group: pd.DataFrame) -> pd.DataFrame:
            own = np.zeros(2**_SEGMENT, np.uint8)
            own[group["at"].to_numpy()] = 1
            return pd.DataFrame({"segment": group["segment"].iloc[:1], "bits": [np.packbits(own, bitorder="little").tobytes()]})

        placed = hashes.select(column).mapInArrow(bit, "segment long, at int").distinct()
        out = np.zeros(2**power // 8, np.uint8)
        for row in placed.groupBy("segment").applyInPandas(segment, "segment long, bits binary").collect():
            start = row["segment"] << (_SEGMENT - 3)
            out[start : start + 2 ** (_SEGMENT - 3)] = np.frombuffer(row["bits"], np.uint8)
        return Filter(out)


def encoded(texts: DataFrame, frequent: Filter, seed: int) -> DataFrame:
    """ids of the words of ``texts``, an array a batch and language; words outside ``frequent`` and ends of pieces are zeros."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own in _by_language(batch):
                codes, words = words_of(own)
                ids = _ids(lang.encode(), words, seed)
                ids[~shared.value.has(ids)] = 0
                out = ids[codes]
                out = out[(out != 0) | (np.append(out[1:], 0) != 0)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out.view(np.int64)))], ["ids"])

    return texts.mapInArrow(run, "ids array<long>")


def _flat(batch: pa.RecordBatch, reach: int) -> np.ndarray:
    """All ids of a batch with zeros between its rows, before the first and, ``reach`` of them, at the end."""
    out = [np.zeros(1, np.int64)]
    for ids in batch.column(0):
        out += [ids.values.to_numpy(), np.zeros(1, np.int64)]
    return np.concatenate([*out, np.zeros(reach, np.int64)]).view(np.uint64)


def _grown(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(h * np.uint64(0x9E3779B97F4A7C15) + word)


def grown(ids: DataFrame, filters: dict[int, Filter], least: int) -> DataFrame:
    """h, hashes of phrases one word longer than the prefixes in ``filters`` (by length), which may occur ``least`` times or more."""
    shared, longest = ids.sparkSession.sparkContext.broadcast(filters), max(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = _flat(batch, longest + 1)
            at = np.flatnonzero(flat)
            at = at[shared.value[1].has(flat[at])]
            h = flat[at]
            for k in range(1, longest + 1):
                good = flat[at + k] != 0
                at, h = at[good], h[good]
                h = _grown(h, flat[at + k])
                if k < longest:
                    good = shared.value[k + 1].has(h)
                    at, h = at[good], h[good]
            found, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "c"])

    return ids.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("h")


def counted(ids: DataFrame, filters: dict[int, Filter], prefixes: bool = True) -> DataFrame:
    """g, a, before and after: exact counts of phrases whose hash is in the filter of their length, with what all occurrences have beside them.

    before and after are the one word that stands beside each occurrence, or 0. With ``prefixes`` the filters hold the
    prefixes of all phrases sought, so that a phrase needs no look where its prefix is not in.
    """
    shared, longest = ids.sparkSession.sparkContext.broadcast(filters), max(filters)
    names = [f"w{i}" for i in range(longest)]

    def rows(flat: np.ndarray, at: np.ndarray, k: int) -> pa.RecordBatch:
        columns = [flat[at + i] for i in range(k)]
        order = np.lexsort(columns[::-1])
        at, columns = at[order], [c[order] for c in columns]
        new = np.zeros(len(at), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        start = np.flatnonzero(new)
        signed = lambda x: pa.array(x.view(np.int64))
        before, after = flat[at - 1].view(np.int64), flat[at + k].view(np.int64)
        beside = [f.reduceat(x, start) for x in (before, after) for f in (np.minimum, np.maximum)]
        none = pa.array(np.zeros(len(start), np.int64))
        out = [signed(columns[i][start]) if i < k else none for i in range(longest)]
        return pa.RecordBatch.from_arrays([*out, pa.array(np.diff(np.append(start, len(at))).astype(np.int64)), *map(pa.array, beside)], [*names, "c", "b1", "b2", "a1", "a2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = _flat(batch, longest + 1)
            at = np.flatnonzero(flat)
            at = at[shared.value[1].has(flat[at])]
            h = flat[at]
            for k in range(2, longest + 1):
                good = flat[at + k - 1] != 0
                at, h = at[good], h[good]
                h = _grown(h, flat[at + k - 1])
                if k in shared.value:
                    good = shared.value[k].has(h)
                    if good.any():
                        yield rows(flat, at[good], k)
                if prefixes:
                    at, h = at[good], h[good]

    sums = ids.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "c", "b1", "b2", "a1", "a2"])).groupBy(*names)
    sums = sums.agg(F.sum("c").alias("a"), *[f(c).alias(c) for c, f in (("b1", F.min), ("b2", F.max), ("a1", F.min), ("a2", F.max))])
    one = lambda c: F.when(F.col(f"{c}1") == F.col(f"{c}2"), F.col(f"{c}1")).otherwise(0)
    return sums.select(F.filter(F.array(*names), lambda w: w != 0).alias("g"), "a", one("b").alias("before"), one("a").alias("after"))


def _hashed(grams: DataFrame, k: int) -> DataFrame:
    """h of the phrases of ``k`` words in ``grams``, and of their first words for k = 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = np.array(batch.column(0).to_pylist(), np.int64).reshape(-1, k).view(np.uint64)
            h = g[:, 0].copy()
            for i in range(1, k):
                h = _grown(h, g[:, i])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    if k == 1:
        return grams.select(F.col("g")[0].alias("h")).distinct()
    return grams.where(F.size("g") == k).select("g").mapInArrow(run, "h long")


def _settled_seed(texts: DataFrame) -> tuple[int, DataFrame]:
    """A seed under which words have ids of their own, and the vocabulary."""
    for seed in range(8):
        words = written(vocabulary(texts, seed), "words")
        if words.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return seed, words
    raise RuntimeError("word ids collide under each seed")


def _score(a: str, l: str, r: str) -> Column:
    """floor(1000 a n / (l r)): products of counts up to 10 ** 14 are exact, and div is a whole division."""
    return F.expr(f"(cast(1000 as decimal(4, 0)) * cast({a} as decimal(14, 0)) * cast(n as decimal(16, 0))) div (cast({l} as decimal(14, 0)) * cast({r} as decimal(14, 0)))")


def _cuts(grams: DataFrame, counts: DataFrame, named: DataFrame) -> DataFrame:
    """lang, n, g, a, k, right, l, r and most for each cut of the phrases in ``grams``; r is null where the right side is not
    counted yet, and then at most ``most``, the count of its rarest word."""
    each = grams.select("g", "a", F.posexplode("g").alias("at", "id")).join(named, "id")
    words = each.groupBy("g", "a", "lang", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "f"))), lambda x: x["f"]).alias("fs"))
    cuts = words.select("*", F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("g", F.lit(1), F.col("k"))).withColumn("right", F.slice("g", F.col("k") + 1, F.size("g")))
    cuts = cuts.withColumn("most", F.array_min(F.slice("fs", F.col("k") + 1, F.size("g"))))
    side = lambda name, f: counts.select(F.col("g").alias(name), F.col("f").alias(f))
    return cuts.join(side("left", "l"), "left").join(side("right", "r"), "right", "left").select("lang", "n", "g", "a", "k", "right", "l", "r", "most")


def _possible(cuts: DataFrame, best: DataFrame | None, top: int) -> DataFrame:
    """The cuts of phrases that can be among their language's first ``top``: a side that is not counted has at least the
    phrase's count and at most that of its rarest word, which bounds scores on both sides."""
    bounds = cuts.groupBy("lang", "g").agg(F.min(_score("a", "l", "coalesce(r, most)")).alias("low"), F.min(_score("a", "l", "coalesce(r, a)")).alias("high"))
    known = bounds.select("lang", "low")
    known = known if best is None else known.union(best.select("lang", "best.score"))
    by = Window.partitionBy("lang").orderBy(F.desc("low"))
    last = known.withColumn("place", F.row_number().over(by)).where(F.col("place") == top).select("lang", F.col("low").alias("last"))
    good = bounds.join(last, "lang", "left").where(F.col("last").isNull() | (F.col("high") >= F.col("last")))
    return cuts.join(good.select("g"), "g", "left_semi")


def _leading(scored: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top`` phrases, and those as good as the last, before names decide."""
    by = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"))
    return scored.withColumn("place", F.rank().over(by)).where(F.col("place") <= top).drop("place")


def _waves(frequent: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """``frequent`` with the wave that expands each word: rarest words first, as their bounds are highest; shares are of a language's words."""
    kind = F.floor(4 * F.log2("f"))
    sums = frequent.groupBy("lang", kind.alias("class")).agg(F.sum("f").alias("mass"))
    by = Window.partitionBy("lang").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    part = F.sum("mass").over(by) / F.sum("mass").over(Window.partitionBy("lang"))
    wave = reduce(lambda rest, k: F.when(F.col("part") <= shares[k], k).otherwise(rest), range(len(shares) - 2, -1, -1), F.lit(len(shares) - 1))
    return frequent.withColumn("class", kind).join(sums.withColumn("part", part).select("lang", "class", wave.alias("wave")), ["lang", "class"]).drop("class")


def mine(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, shares: tuple[float, ...] = (1 / 16, 1 / 4, 1.0)) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases by score, count and phrase.

    Of ``docs`` (lang, text) each row counts, repeated ones too. A null text is empty, a null language is ``und``;
    languages without a phrase of ``least`` occurrences give no row, so an empty table gives none. Words are what spaces
    and tabs part in pieces between ``.,;:!?`` and line ends, with A-Z in lower case. Phrases inside a longer one of equal count
    are left out; phrases of ``longest`` words have no longer one. Ties end with the phrase in order of its UTF-8 bytes.
    Runs jobs that write to the shared folder.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seed, words = _settled_seed(texts)
    languages = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = written(_waves(words.where(F.col("f") >= least), shares), "frequent")
    known = Filter.of(frequent, "id")
    empty = spark.createDataFrame([], _FOUND)
    if known is None:
        return empty
    ids = written(encoded(texts, known, seed), "ids")
    named = written(frequent.join(languages, "lang").select("id", "lang", "n", "word", "f"), "named")
    counts = frequent.select(F.array("id").alias("g"), "f")
    grams = best = settled = None
    for wave in range(len(shares)):
        nodes = frequent.where(F.col("wave") == wave)
        nodes = nodes if settled is None else nodes.join(settled, "lang", "left_anti")
        filters = {1: Filter.of(nodes, "id")}
        if filters[1] is None:
            continue
        for k in range(2, longest + 1):
            found = Filter.of(written(grown(ids, filters, least), "prefixes"), "h")
            if found is None:
                break
            filters[k] = found
        if len(filters) == 1:
            continue
        # A filter lets a few words of other waves through: their phrases belong to that wave alone.
        own = counted(ids, filters).where(F.col("a") >= least)
        own = written(own.join(nodes.select(F.col("id").alias("first")), F.col("g")[0] == F.col("first"), "left_semi"), "phrases")
        grams = own if grams is None else grams.union(own)
        inside = (F.size("g") < longest) & ((F.col("before") != 0) | (F.col("after") != 0))
        free = own.where(~inside)
        sides = counts.union(grams.select("g", F.col("a").alias("f"))).dropDuplicates(["g"])
        cuts = written(_possible(written(_cuts(free.select("g", "a"), sides, named), "cuts"), best, top), "cuts")
        open_ends = written(cuts.where("r is null").select(F.col("right").alias("g")).distinct(), "ends")
        if not open_ends.isEmpty():
            wanted = {k: f for k in range(1, longest) if (f := Filter.of(_hashed(open_ends, k), "h"))}
            more = written(counted(ids, wanted, prefixes=False).join(open_ends, "g", "left_semi").select("g", F.col("a").alias("f")), "counts")
            counts = counts.union(more)
            cuts = cuts.join(more.select(F.col("g").alias("right"), "f"), "right", "left").withColumn("r", F.coalesce("r", "f"))
        scored = cuts.groupBy("lang", "n", "g", "a").agg(F.min(F.struct(_score("a", "l", "r").alias("score"), "k", "l", "r")).alias("best"))
        best = written(_leading(scored if best is None else best.union(scored), top), "best")
        # What is left of a language starts with words of later waves: the rarest of them bounds its scores.
        rest = frequent.where(F.col("wave") > wave).groupBy("lang").agg(F.min("f").alias("next")).join(languages, "lang")
        last = best.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score")))).where(F.col("place") == top)
        bound = F.floor(F.expr("cast(1000 as decimal(4, 0)) * cast(n as decimal(16, 0)) div next"))
        settled = written(last.select("lang", "best.score").join(rest.select("lang", bound.alias("bound")), "lang").where("score > bound").select("lang"), "settled")
    if best is None:
        return empty
    each = best.select("lang", "n", "g", "a", "best.score", "best.l", "best.r", F.posexplode("g").alias("at", "id")).join(named.select("id", "word"), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    full = each.groupBy("lang", "n", "g", "a", "score", "l", "r").agg(phrase.alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return full.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 100, top: int = 2000) -> str:
    """SQL of mine() over all phrases, for DuckDB."""
    gram = lambda k: " || ' ' || ".join(["word", *[f"w{i}" for i in range(1, k)]])
    grams = "\nunion all ".join(f"select lang, {k} as size, {gram(k)} as phrase, count(*) as a from ahead where {'true' if k == 1 else f'w{k - 1} is not null'} group by all" for k in range(1, 6))
    part = lambda a, b: f"array_to_string(list_slice(string_split(c.phrase, ' '), {a}, {b}), ' ')"
    return f"""
with pieces as (select doc_id, coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
numbered as (select lang, piece, row_number() over () as no from pieces),
words as (select lang, no, unnest(list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '')) as word, generate_subscripts(list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> ''), 1) as pos from numbered),
ahead as (select lang, word, {", ".join(f"lead(word, {i}) over w as w{i}" for i in range(1, 5))} from words window w as (partition by no order by pos)),
grams as ({grams}),
often as (select * from grams where a >= {least}),
totals as (select lang, cast(sum(a) as bigint) as n from grams where size = 1 group by lang),
inside as (select distinct lang, unnest([{part(1, "c.size - 1")}, {part(2, "c.size")}]) as phrase, a from often c where size > 2),
cuts as (select c.lang, c.phrase, c.a, t.n, k.k, x.a as l, y.a as r, (1000::hugeint * c.a * t.n) // (x.a::hugeint * y.a) as score
  from often c join totals t using (lang) join (values (1), (2), (3), (4)) k(k) on k.k < c.size
  join often x on x.lang = c.lang and x.phrase = {part(1, "k.k")} join often y on y.lang = c.lang and y.phrase = {part("k.k + 1", "c.size")}
  where not exists (select 1 from inside i where i.lang = c.lang and i.phrase = c.phrase and i.a = c.a)),
weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, cast(score as bigint) as score from weakest)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= {top}"""
