"""Registration of the twelve functions for SQL, under a prefix of the caller's choice.

The aggregates registered here keep the call syntax; each group's blobs meet in one task, and Spark places such
functions neither beside built-in aggregates nor gives them a row for an empty global input. tessera.operators.merging does
the same by partial aggregation, without these limits.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions import blob

SCALARS = {"add": blob.add, "merge": blob.merge, "quantile": blob.quantile, "count": blob.count, "min": blob.minimum, "max": blob.maximum, "sum": blob.total, "avg": blob.average, "stats": blob.stats}
AGGREGATES = {"agg": blob.agg, "stats_agg": blob.stats_agg}


# The bytes of an empty sketch, from the accuracy: the mapping block with gamma and offset zero in little-endian order.
CREATE = """
CREATE OR REPLACE TEMPORARY FUNCTION {name}(accuracy DOUBLE DEFAULT 0.01D) RETURNS TABLE(sketch BINARY) RETURN
SELECT concat(X'02', {little_endian}, X'0000000000000000') FROM (
  SELECT unhex(lpad(hex(cast(reflect('java.lang.Double', 'doubleToRawLongBits', 1D + 2D * a / (1D - a)) AS BIGINT)), 16, '0')) AS b
  FROM (SELECT if(a > 0D AND a < 1D, a, raise_error('a relative accuracy lies between 0 and 1')) AS a FROM (SELECT coalesce(accuracy, 0.01D) AS a FROM range(1))))
"""


def register(spark: SparkSession, prefix: str = "sketch_") -> None:
    """Makes create (a table function), the scalars and both aggregates callable from SQL."""
    for name, f in (SCALARS | AGGREGATES).items():
        spark.udf.register(prefix + name, f)
    spark.sql(CREATE.format(name=prefix + "create", little_endian=", ".join(f"substring(b, {i}, 1)" for i in range(8, 0, -1))))
