"""Tables that many tasks build on: written to the shared folder, and running sums that no single task holds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ordinals in a bucket of ``running_sum`` and ``linked_siblings``.
SPAN = 16_384


def stored(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read again: a cut of its lineage that outlives executors.

    Where the setting is unset, only a local master (tests) gets a temporary folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & a[c].eqNullSafe(b[c])
    return on


def running_sum(df: DataFrame, owner: list[str], ordinal: str, value: Column, name: str, span: int = SPAN) -> DataFrame:
    """df with the exclusive running sum of ``value`` over the ordinals of each owner.

    Sums of buckets of ``span`` ordinals first, then a window within each bucket: an owner with a third of all rows is no
    task of its own."""
    rows = df.withColumn("__bucket", F.floor(F.col(ordinal) / span)).withColumn("__value", value)
    sums = rows.groupBy(*owner, "__bucket").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*owner).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*owner, "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*owner, "__bucket").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    out = rows.join(sums, same(rows, sums, [*owner, "__bucket"]), "left")
    return out.select(*[rows[c] for c in df.columns], (F.col("__before") + F.col("__within")).cast("long").alias(name))
