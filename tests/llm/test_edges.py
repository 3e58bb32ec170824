"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator on documents."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vistalog.llm import hyperminhash, langid, licenses, mjpeg, packing, pieces, secrets

LONG = "word salad " * 20_000
ROWS = [
    (1, "one two three four five six seven", "en"), (1, "one two three four five six seven", "en"), (2, None, "en"), (3, "", None), (4, " \n\t", "fr"), (5, LONG, "en"),
    (None, "one two three four five six seven", "en"), (None, None, None), (6, "x", "de"), (7, "日本語 ▁ \x00 text\U0001f600 é", "en"), (8, "one two three four five six seven", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    extra = {n: F.lit("clash") for n in ("component_id", "kept", "start", "length", "band", "rep", "n", "found", "media", "score", "ids", "unit", "at", "value")}
    return df.withColumns(extra).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def _langid(df):
    return langid.identify(df)


RUNS = {
    "mjpeg": lambda df: mjpeg.summary(mjpeg.read(mjpeg.store(df))),
    "minhash": hyperminhash.near_duplicates,
    "secrets": lambda df: secrets.summary(secrets.scan(df)),
    "packing": packing.pack,
    "pieces": pieces.encode,
    "langid": _langid,
    "licenses": licenses.scan,
}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table_gives_empty_result(name, empty):
    assert RUNS[name](empty).collect() == []


@pytest.mark.parametrize("name", [n for n in RUNS if n not in ("packing", "licenses")])
def test_one_row_for_each_row(name, docs):
    rows = RUNS[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert len({str(r) for r in rows if r["doc_id"] == 1}) == 1


def test_minhash_edges(docs):
    rows = hyperminhash.near_duplicates(docs).collect()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["n_shingles"] == 3 and by[8]["component_id"] == 1 and not by[8]["kept"] and by[1]["kept"]
    assert all(by[k]["n_shingles"] == 0 and by[k]["component_id"] == k and by[k]["kept"] for k in (2, 3, 4))
    assert by[6]["n_shingles"] == 1 and by[5]["n_shingles"] == 2
    nulls = {r["n_shingles"]: r for r in rows if r["doc_id"] is None}
    assert nulls[3]["component_id"] == 1 and not nulls[3]["kept"] and nulls[0]["component_id"] is None


def test_deduplicated_keeps_columns_and_one_of_each_group(docs):
    out = hyperminhash.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_packing_edges(docs):
    rows = packing.pack(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [(r["start"], r["length"], r["doc_tokens"], r["ids"]) for r in by[2]] == [(0, 1, 1, [1])]
    long = sorted(by[5], key=lambda r: r["start"])
    assert [r["length"] for r in long][:5] == [2048] * 5 and sum(r["length"] for r in long) == long[0]["doc_tokens"]
    assert len({r["sequence_id"] for r in rows}) == len(rows)


def test_pieces_edges(docs):
    for r in pieces.encode(docs).collect():
        assert r["lossless"]
    texts = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs)).collect()}
    assert texts[7] == ROWS[9][1] and texts[5] == LONG and texts[2] == ""


def test_mjpeg_edges(docs):
    by = {r["doc_id"]: r for r in mjpeg.read(mjpeg.store(docs)).collect()}
    assert by[2]["n_bytes"] == 0 and by[2]["payload"] == b"\0" * 64 and by[3]["media_sha256"] == by[2]["media_sha256"]
    raw = LONG.encode()
    assert by[5]["payload"][: len(raw)] == raw and len(by[5]["payload"]) % 64 == 0
    assert by[5]["payload_sha256"] == hashlib.sha256(by[5]["payload"]).hexdigest()


def test_langid_edges(docs):
    by = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 and by[k]["rejected"] for k in (2, 3, 4))
    assert by[None]["held_out"] is True
    assert all(0 <= r["score"] <= 1 for r in by.values())
