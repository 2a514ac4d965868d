import numpy as np

from tessera.codec import bmp, png
from tessera.streaming import ingest


def test_ingest_counts_and_drops_copies(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 256, (4, 4, 4), np.uint8)
    for i, data in enumerate([png.encode(image), png.encode(image), bmp.encode(image), b"none"]):
        (tmp_path / f"{i}.bin").write_bytes(data)
    arriving = ingest.arriving_images(spark, str(tmp_path))
    for frame, name, mode in ((ingest.distinct_images(arriving), "distinct_images", "append"), (ingest.counts_by_format(arriving), "format_counts", "complete")):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("distinct_images").count() == 3
    got = {r.format: r.files for r in spark.table("format_counts").collect()}
    assert got == {"PNG": 2, "BMP": 1, None: 1}
