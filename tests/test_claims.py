import numpy as np
from pyspark.sql import functions as F

from tessera.codec import jpeg, png, tiff, webp
from tessera.plans import catalog
from tessera.sources import images


def test_claims_by_format(spark):
    image = np.full((9, 7, 4), 200, np.uint8)
    files = {"png": png.encode(image), "jpeg": jpeg.encode(image), "webp": webp.encode(image), "tiff": tiff.encode([image])}
    rows = [(n, d, True) for n, d in files.items()] + [
        ("later directory", b"II*\0\xff\xff\xff\0" + b"x" * 90, True), ("jp2", b"\xff\x4f" + b"x" * 90, True), ("jp2 that probes", b"\xff\x4f\xff\x51" + b"\0" * 90, False),
        ("cut off", files["png"][:20], False), ("text", b"no image" * 20_000, False), ("nothing", None, False), ("empty", b"", False), ("webp text", b"RIFF....WEBP" + b"x" * 90, False),
    ]
    got = spark.createDataFrame(rows, "n string, content binary, want boolean").select("n", "want", images.claims_column(F.col("content")).alias("claimed")).collect()
    assert [r.n for r in got if r.claimed != r.want] == []


def test_only_answers_come_back(spark, sf_dir):
    """No struct of all header facts a row: its columns and a second copy of the texts filled the workers' memory."""
    plan = catalog.queries()["s17_claims"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "unsupported_reason" not in plan and "is_decodable" not in plan
