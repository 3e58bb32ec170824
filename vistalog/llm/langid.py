"""Language identification: averaged hashed subword embeddings, a linear softmax and calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

BINS, SIZES = 1 << 16, (2, 3, 4)
UNKNOWN = "und"
_BATCH = 100_000


class Model(NamedTuple):
    """``table`` has a row of class scores for each bin: embedding times softmax weights, which inference needs only as a product.

    A score under ``least`` says that a text could be of several languages, a mean under the bound of the likeliest one that its
    subwords are not that language's.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    #: Logarithms of each language's shares of bins, its bound of their mean over a text, and their usual spread within one.
    familiar: np.ndarray | None = None
    bounds: np.ndarray | None = None
    spread: float = 0.0


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(bins, index of the text) of all letter runs' subwords for each size, and which texts have a letter.

    Letters are lower-cased; anything else is a word edge, which may begin or end a subword but not lie in it.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lowered) + "   ").encode("utf-32-le", "surrogatepass"), "<u4")
    word = letters()[points]
    points = np.where(word, points, 0)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    n = len(owner)
    has = np.bincount(owner[word[:n]], minlength=len(texts)) > 0
    out, inside, key = [], np.ones(n, bool), points[:n].astype(np.uint32) * np.uint32(0x9E3779B1)
    for size in range(2, max(SIZES) + 1):
        nxt = points[size - 1 : n + size - 1]
        key = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B) + nxt * np.uint32(0xC2B2AE35)
        if size in SIZES:
            good = inside & (word[:n] | word[size - 1 : n + size - 1]) if size == 2 else inside
            k = key[good]
            out.append((((k ^ (k >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(16)).astype(np.int64), owner[good]))
        inside = inside & word[size - 1 : n + size - 1]
    return out, has


def judged(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated probabilities (text, language), which texts have a letter, and which of them are rejected.

    A text whose mean is under its language's bound by less than three standard errors, which few subwords make large, is kept.
    """
    grams, has = subwords(texts)
    total = np.zeros((len(texts), len(model.languages)))
    count = np.zeros(len(texts))
    for bins, owner in grams:
        count += np.bincount(owner, minlength=len(texts))
        for j in range(total.shape[1]):
            total[:, j] += np.bincount(owner, weights=model.table[j, bins], minlength=len(texts))
    z = (total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    rejected = ~has | (p.max(1) < model.least)
    if model.familiar is not None:
        best, seen = p.argmax(1), np.zeros(len(texts))
        for bins, owner in grams:
            seen += np.bincount(owner, weights=model.familiar[best[owner], bins], minlength=len(texts))
        n = np.maximum(count, 1)
        rejected |= seen / n + 3 * model.spread / np.sqrt(n) < model.bounds[best]
    return p, has, rejected


def scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated probabilities (text, language), and which texts have a letter."""
    return judged(model, texts)[:2]


def familiarity(names: int, y: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], fit: np.ndarray, held: np.ndarray, logits: np.ndarray, false_reject: float, part: float = 0.25) -> tuple[np.ndarray, np.ndarray, float]:
    """familiar, bounds and spread of a Model.

    For each language the calibration rows that are rightly taken for it are known ones; those of other languages that would be
    taken for it if their own had not been learnt are foreign ones. The bound lies a ``part`` of the way from the foreign median to the
    known one, as a text would of which that part is in the language and the rest is not, and lower if more than
    ``false_reject`` of the known ones were under it. Without foreign rows, as with one language, nothing is rejected by it.
    """
    shares = np.zeros((names, BINS))
    for i in fit:
        shares[y[i], rows[i][0]] += rows[i][1]
    texts = np.maximum(np.bincount(y[fit], minlength=names), 1)[:, None]
    # A hundredth of each language's mass is spread over all bins, so a bin that was not seen counts as rare.
    familiar = np.log(0.99 * shares / texts + 0.01 / BINS).astype(np.float32)
    mean = lambda i, c: float(rows[i][1] @ familiar[c, rows[i][0]])
    truth, best = y[held], logits.argmax(1) if len(held) else np.zeros(0, int)
    known: list[list[float]] = [[] for _ in range(names)]
    foreign: list[list[float]] = [[] for _ in range(names)]
    spreads = []
    for row, i in enumerate(held):
        if not len(rows[i][0]):
            continue
        if best[row] == truth[row]:
            at = mean(i, truth[row])
            known[truth[row]].append(at)
            spreads.append(rows[i][1] @ (familiar[truth[row], rows[i][0]] - at) ** 2)
        if names > 1:
            others = logits[row].copy()
            others[truth[row]] = -np.inf
            foreign[int(others.argmax())].append(mean(i, int(others.argmax())))
    bounds = np.full(names, -np.inf)
    for c in range(names):
        if known[c] and foreign[c]:
            low, own, other = sorted(known[c])[int(false_reject * len(known[c]))], float(np.median(known[c])), float(np.median(foreign[c]))
            bounds[c] = min(low, other + part * (own - other))
    return familiar, bounds, float(np.sqrt(np.mean(spreads))) if spreads else 0.0


def train(texts: list[str], languages: list[str], dim: int = 16, epochs: int = 12, rate: float = 1.0, seed: int = 7, false_reject: float = 0.001) -> Model:
    """Fit embeddings and weights by mini-batch stochastic gradient descent; a fifth of the rows calibrates.

    Unseen bins keep a zero embedding, so that text of an unknown language gets an unsure score. The temperature
    minimises the calibration rows' loss. The least score kept is the one below which at most ``false_reject`` of the
    rightly recognised calibration rows lie, and at most a fifth of the way from chance, which is one in the number of
    languages, to certainty. What is unlike all languages goes by the bounds of familiarity(), which the same calibration rows give.
    Without rows the model has no language.
    """
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((0, BINS), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([names.index(v) for v in languages])
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in slices([len(t) for t in texts], 2 * _BATCH):
        grams, _ = subwords(texts[a:b])
        bins = np.concatenate([g for g, _ in grams])
        owner = np.concatenate([o for _, o in grams])
        packed, counts = np.unique(owner * BINS + bins, return_counts=True)
        cut = np.searchsorted(packed, np.arange(b - a + 1) * BINS)
        for i in range(b - a):
            c = counts[cut[i] : cut[i + 1]]
            rows.append(((packed[cut[i] : cut[i + 1]] % BINS).astype(np.int32), (c / max(1, c.sum())).astype(np.float32)))
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5]
    fit = order[len(rows) // 5 :]
    weight = np.bincount(y[fit], minlength=len(names)).astype(float)
    weight = len(fit) / np.maximum(weight, 1) / len(names)
    embed = np.zeros((BINS, dim), np.float32)
    soft, bias = rng.normal(size=(dim, len(names))), np.zeros(len(names))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(fit)
        for i in fit:
            bins, share = rows[i]
            v = share @ embed[bins]
            z = v @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            back = soft @ p
            soft -= 0.1 * step * np.outer(v, p)
            bias -= 0.01 * step * p
            embed[bins] -= step * 50 * share[:, None] * back
    table = (embed.astype(float) @ soft).T.astype(np.float32).copy()
    logits = np.array([(table[:, b].astype(float) @ s) + bias for b, s in (rows[i] for i in held)]).reshape(-1, len(names))

    def chances(t: float) -> np.ndarray:
        z = logits / t
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    truth = y[held]
    grid = np.geomspace(0.05, 20, 60)
    # As in Platt's scaling, targets keep a share of one in n + 2 for the other classes, so that a faultless
    # calibration set doesn't make all scores 1.
    other = 1 / (len(held) + 2)

    def loss(t: float) -> float:
        logs = np.log(np.maximum(chances(t), 1e-12))
        own = logs[np.arange(len(held)), truth]
        return -((1 - other) * own + other * (logs.sum(1) - own) / max(1, len(names) - 1)).mean()

    best = min(grid, key=loss) if len(held) else 1.0
    p = chances(best)
    right = np.sort(p.max(1)[p.argmax(1) == truth]) if len(held) else np.zeros(0)
    chance = 1 / len(names)
    least = min(chance + (1 - chance) / 5, float(right[int(false_reject * len(right))])) if len(right) else 0.0
    return Model(names, table, bias, float(best), least, *familiarity(len(names), y, rows, fit, held, logits, false_reject))


def sample(docs: DataFrame, per_language: int = 700, most_languages: int = 1000, most_chars: int = 20_000) -> tuple[list[str], list[str]]:
    """Texts and labels to learn from: about ``per_language`` rows of each language, the documented bound.

    Only rows with text of up to ``most_chars`` characters, a language and crc32(doc_id as text) mod 5 other than 0
    count, so the driver holds at most the product of the three bounds. Which ones are taken follows from a hash of
    doc_id, against a share that comes from counts over all rows. More than ``most_languages`` languages are an error.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(F.length("text") <= most_chars).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    counts = known.groupBy("lang").count()
    near = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count"))
    shares = {r["lang"]: r["share"] for r in counts.select("lang", near.alias("share")).orderBy("lang").limit(most_languages + 1).collect()}
    if len(shares) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not shares:
        return [], []
    share = F.create_map(*[F.lit(x) for kv in sorted(shares.items()) for x in kv])[F.col("lang")]
    rows = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("doc_id", "text", "lang").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) with held_out, lang_pred, score and rejected, one row for each row.

    A null text, an empty one or one without a letter gets ``und``, score 0 and is rejected, as is any row when
    the model knows no language. Otherwise lang_pred is the likeliest language and score its probability; a row
    whose score is under the model's least, or whose subwords are too rare in that language, is rejected. Ties go to the first language by name. A null doc_id
    counts as held out. Repeated rows get equal values; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            names, score, rejected = [], [], []
            for a, b in slices([len(t) + 1 for t in texts], _BATCH):
                if not m.languages:
                    names += [UNKNOWN] * (b - a)
                    score += [0.0] * (b - a)
                    rejected += [True] * (b - a)
                    continue
                p, has, gone = judged(m, texts[a:b])
                best, top = p.argmax(1), np.clip(np.round(p.max(1), 6), 0, 1)
                names += [m.languages[k] if h else UNKNOWN for k, h in zip(best.tolist(), has.tolist(), strict=True)]
                score += np.where(has, top, 0.0).tolist()
                rejected += gone.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return base.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that classify() does not reject; text is one of the columns.

    So a null text, an empty one or one without a letter goes, and every row if the model knows no language. Ties don't
    matter, repeated rows stay or go together, and an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            keep = np.zeros(len(texts), bool)
            for a, b in slices([len(t) + 1 for t in texts], _BATCH):
                if m.languages:
                    keep[a:b] = ~judged(m, texts[a:b])[2]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, per_language: int = 700) -> DataFrame:
    """Train on a bounded sample of ``docs`` (doc_id, text, lang) and classify all of them; see sample() and classify()."""
    return classify(docs, train(*sample(docs, per_language)))
