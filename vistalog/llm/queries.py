"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import heapmeans, hyperminhash, langid, licenses, mjpeg, nearvectors, packing, pagetext, personal, phrases, pieces, secrets, zip_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearvectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearvectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mjpeg.summary(mjpeg.read(mjpeg.store(_table(spark, sf_dir, "documents")), with_payload=False))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.scan(_table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), with_ids=False)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_pagetext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = zip_warc.round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_heapmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heapmeans.cluster(_table(spark, sf_dir, "embeddings"))


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.summary(personal.scan(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_nearvectors": op1_nearvectors, "op2_mjpeg": op2_mjpeg, "op3_licenses": op3_licenses, "op4_minhash": op4_minhash, "op5_secrets": op5_secrets, "op6_packing": op6_packing, "op7_pieces": op7_pieces, "op8_langid": op8_langid, "op9_pagetext": op9_pagetext, "op10_warc": op10_warc, "op11_phrases": op11_phrases, "op12_heapmeans": op12_heapmeans, "op13_personal": op13_personal}


OP10_SQL = """
with k as (select page_id, url, coalesce(html, '') as html from pages),
d as (select page_id, url, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha256(html) as payload_digest,
  min(page_id) over (partition by sha256(html)) as first from k)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and first <> page_id then first end as refers_to, url from d
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": licenses.oracle(), "op10_warc": OP10_SQL, "op11_phrases": phrases.oracle(), "op12_heapmeans": heapmeans.oracle()}
