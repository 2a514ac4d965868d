"""Animations of all their frames and pages: none of a file's images is left out."""

from tessera.plans import catalog


def test_every_frame_and_page_comes_back(spark, sf_dir):
    tiles = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    for name in ("d07_apng_frames", "d07_gif_frames"):
        assert catalog.queries()[name](spark, sf_dir).select("img_id", "frame_idx").distinct().count() == tiles
    assert catalog.queries()["s16_tiff_pages"](spark, sf_dir).count() == tiles
    frames = [r.frames for r in catalog.queries()["d07_status"](spark, sf_dir).collect()]
    assert sum(frames) == tiles and max(frames) > 4
