"""Queries over the data-parallel primitives: filter, reduce, histogram, scan."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import register


@register(
    "flagship",
    """SELECT CAST(b.bin AS INTEGER) AS bin, CAST(coalesce(h.n, 0) AS BIGINT) AS n,
              CAST(sum(coalesce(h.n, 0)) OVER (ORDER BY b.bin) AS BIGINT) AS cum
       FROM generate_series(1, 50) AS b(bin)
       LEFT JOIN (SELECT CAST(l_quantity AS BIGINT) AS v, count(*) AS n FROM lineitem
                  WHERE CAST(l_quantity AS BIGINT) % 2 = 0 GROUP BY 1) h ON h.v = b.bin""",
)
def flagship(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").cast("long").alias("v"))
    counts = v.where("v % 2 = 0").groupBy("v").count()
    bins = spark.range(1, 51).select(F.col("id").alias("v"))
    dense = bins.join(counts, "v", "left").select(F.col("v").cast("int").alias("bin"), F.coalesce("count", F.lit(0)).cast("long").alias("n"))
    return dense.withColumn("cum", F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
