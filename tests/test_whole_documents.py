"""Documents as damaged files: the decoders get the whole texts."""

from pyspark.sql import functions as F

from tessera.plans import catalog, pixel_queries
from tessera.sources import images


def test_long_payloads_reach_the_decoders(spark, sf_dir, monkeypatch):
    seen = []
    real = images.decode_status
    monkeypatch.setattr(images, "decode_status", lambda files: seen.append(files) or real(files))
    catalog.queries()["d02_pages_of_documents"](spark, sf_dir)
    want = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    magic = seen[0].agg(F.sum(F.octet_length("content"))).first()[0] - want
    rows = seen[0].count()
    assert 2 * rows <= magic <= 8 * rows


def test_sniffed_content_is_whole(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(pixel_queries.pm, "sniff", F.octet_length)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length("text").alias("n"))
    both = docs.join(catalog.queries()["s01_sniff"](spark, sf_dir), "doc_id")
    assert both.where("format < n").count() == 0
