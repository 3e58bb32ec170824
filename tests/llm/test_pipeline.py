"""The pipeline against a plain version of it."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_minhash import brute

from vistalog.llm import langid, packing, secrets

SMALL = "/root/testdata/sf0.001"


def test_run_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(*langid.sample(docs))
    rows = sorted(docs.select("doc_id", "text").collect())
    rejected = {r["doc_id"] for r in langid.classify(docs, model).where("rejected").collect()}
    kept = [r for r in rows if r["doc_id"] not in rejected]
    roots, _ = brute([r["text"] for r in kept], 80)
    kept = [r for i, r in enumerate(kept) if roots[i] == i]
    measure = secrets.novelty(secrets.IDENTIFIERS)
    tokens = packing.tokenizer(*packing.public_vocabulary())
    want = collections.Counter()
    for r in kept:
        text = r["text"]
        base = secrets.base_spans(text)
        for start, end in sorted(((v, e) for _, _, e, v in base + secrets.novel_spans(text, base, measure, 0.5)), reverse=True):
            if not any(a <= start and end <= e and (a, e) != (start, end) for _, _, e, a in base):
                text = text[:start] + "\0" + text[end:]
        text = text.replace("\0\0", "\0").replace("\0", "<secret>")
        for n in packing.decompose(len(tokens.encode([text])[0]) // 4 + 1, 2048):
            want[r["doc_id"], n] += 1
    got = collections.Counter((r["doc_id"], r["length"]) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert {d for d, _ in got} == {r["doc_id"] for r in kept}
    assert got == want


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns


ROWS = [
    (1, "the token = abcdefgh12 of the user in the house by the sea", "en", "s", 10), (1, "the token = abcdefgh12 of the user in the house by the sea", "en", "s", 10), (2, None, "en", None, None), (3, "", None, "s", 0),
    (None, "words of a text without a number in the house by the sea", "en", "s", 3), (4, "in the house by the sea " * 20_000, None, None, None), (5, "12 34", "en", "s", 5), (6, "secret", None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    more = {n: F.lit("clash") for n in ("found", "kept", "band", "rep", "component_id", "start", "length", "sequence_id", "score", "rejected")}
    return df.withColumns(more).cache()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_nulls_repeats_long_texts_and_clashes(spark, odd, name, stage):
    out = stage(spark, odd, "")
    ids = sorted({r["doc_id"] for r in out.select("doc_id").collect()}, key=str)
    assert stage(spark, odd.limit(0), "").collect() == []
    if name == "pack":
        return
    assert out.columns == odd.columns
    if name == "language":
        # Without a letter there is no language; text that the model knows stays.
        assert {2, 3, 5}.isdisjoint(ids) and {1, 4, None} <= set(ids)
    elif name == "near_duplicates":
        assert ids == sorted([1, 2, 3, 4, 5, 6, None], key=str) and out.where("doc_id = 1").count() == 1
    else:
        assert out.count() == len(ROWS) and {r["text"] for r in out.where("doc_id = 1").collect()} == {"the token = <secret> of the user in the house by the sea"}
