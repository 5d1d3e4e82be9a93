"""Shared pieces: scratch tables in the cluster's shared folder, transcripts, connected components."""
from __future__ import annotations

import atexit
import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cuewright.plans.ranking import ranked
from cuewright.session import shared_folder

#: A missing vid sorts behind every other one inside the operators and comes out as NULL again.
NO_VID = 2**63 - 1
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
AT_ONCE = 1000  # rows hold whole texts: so many go to a Python worker at once, a tenth of Spark's own number
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def transcripts(df: DataFrame) -> DataFrame:
    """Only ``vid`` and ``text``; a NULL text is an empty one. Other columns are never looked at."""
    return df.select(F.col("vid").cast("bigint").alias("vid"), F.coalesce("text", F.lit("")).alias("text"))


class Scratch:
    """Tables written once to the shared folder and read back, so that no later stage, and no
    executor that replaces a lost one, has to compute them again. Removed when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        writer = df.write.option("compression", "zstd")
        conf, before, records = self.spark.conf, self.spark.conf.get(CLEANUP, "false"), self.spark.conf.get(RECORDS)
        conf.set(CLEANUP, "true")  # the shuffle files behind a written table are of no use any more
        if not 0 < int(records) <= AT_ONCE:
            conf.set(RECORDS, str(AT_ONCE))
        try:
            (writer.partitionBy(*by) if by else writer).parquet(path)
        finally:
            conf.set(CLEANUP, before)
            conf.set(RECORDS, records)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone already; the folder belongs to it
            pass


def any_ids(*columns: str, key: str = "vid"):
    """Let an operator that works with whole numbers take ids of any type that sorts.

    Other ids are numbered by their rank, so the smallest id has the smallest number, and ``columns`` of the
    result get their ids back. Tables with the key among the further arguments are numbered alike.
    """
    def wrap(operator):
        @functools.wraps(operator)
        def run(rows: DataFrame, *args, **settings):
            if isinstance(rows.schema[key].dataType, IntegralType):
                return operator(rows, *args, **settings)
            scratch = Scratch(rows.sparkSession)
            known = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.lit(0).alias("_all")).distinct()
            ids = ranked(scratch.keep(known, "known"), "_number", ("_id",), keys=("_all",), keep=lambda df: scratch.keep(df, "ranked"))
            ids = scratch.keep(ids.select("_id", "_number"), "ids")

            def numbered(df: DataFrame) -> DataFrame:
                return df.join(ids, F.col(key) == F.col("_id"), "left").withColumn(key, F.col("_number")).drop("_id", "_number")

            out = operator(numbered(rows), *[numbered(a) if isinstance(a, DataFrame) and key in a.columns else a for a in args], **settings)
            for c in columns:
                out = out.join(ids, F.col(c) == F.col("_number"), "left").withColumn(c, F.col("_id")).drop("_id", "_number")
            return out
        return run
    return wrap


def _stars(edges: DataFrame) -> bool:
    """Whether every ``hi`` has one ``lo`` and no ``lo`` is a ``hi``."""
    ends = edges.select(F.col("hi").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("root")) \
        .unionAll(edges.select(F.col("lo").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 - root").take(1)


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, component) for every end of an edge; a component is named by its smallest id.

    ``edges`` has bigint columns ``a`` and ``b``. Large-star and small-star steps alternate until
    only stars are left (Kiveris et al. 2014): every step keeps at most as many edges as there were,
    a hub is reduced by map-side minima, and the joins after it are ones AQE can split.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                       .distinct(), f"{name}-0")
    step = 0
    while not _stars(now):
        step += 1
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")) \
            .unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = scratch.keep(large, f"{name}-{step}-large")
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")) \
            .unionAll(root.select("hi", F.col("m").alias("lo"))).distinct()
        now = scratch.keep(small, f"{name}-{step}")
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")) \
        .unionAll(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def hex_sha(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)
