"""Key ranges against plain Python."""

import pytest
from pyspark.sql import functions as F

from arborlake.operators import audit


@pytest.mark.parametrize("n", [0, 3, 8, 1003, 600_001])
def test_key_ranges_are_exact(spark, n):
    names = sorted(f"A/{k * 7919 % 1_000_003}" for k in range(n))
    listing = spark.range(n).select(F.concat(F.lit("A/"), (F.col("id") * 7919 % 1_000_003).cast("string")).alias("name"))
    got = {r["tile"]: r["first_key"] for r in audit.key_ranges(listing.unionByName(spark.range(5).select(F.lit("B/x").alias("name"))), "A/", 8).collect()}
    small, more = divmod(n, 8)
    want = {t + 1: names[t * small + min(t, more)] for t in range(8)} if n >= 8 else dict(zip([1], names[:1], strict=False))
    assert got == want
