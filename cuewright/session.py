"""Session defaults. On a cluster the submitter's own settings win."""
from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: str = "*", name: str = "cuewright", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; never used on a cluster."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.driver.memory", "8g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can see, named by the cluster in spark.checkpoint.dir.

    Only where the setting is absent (tests, one machine) is a local one made.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        import tempfile

        folder = tempfile.mkdtemp(prefix="cuewright-")
    if not (current.isDefined() and folder.rstrip("/") in current.get()):
        sc.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Block totals and rows come from the same input; without a cut, stages that
    follow each other would recompute it twice per stage. Survives lost executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Steps:
    """Rows of one step after another, each written once and compressed to the shared folder.

    A reliable checkpoint holds plain rows and stays for as long as the driver does. Of a chain of steps that each
    hold all rows, only those that are still read need the disk: ``last`` removes the others, and the shuffle
    files behind a written step go with its job. The rest is removed when the driver ends.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark).rstrip('/')}/steps-{uuid.uuid4().hex}"
        self.written, self.steps = 0, []
        atexit.register(self.only)

    def keep(self, df: DataFrame) -> DataFrame:
        path, before = f"{self.folder}/{self.written}", self.spark.conf.get(self.CLEANUP, "false")
        self.written += 1
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(self.CLEANUP, before)
        self.steps.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self.steps[-1][0]

    def last(self, df: DataFrame) -> DataFrame:
        """The same; the steps before this one are read no more."""
        done = self.keep(df)
        self.only(done)
        return done

    def only(self, *kept: DataFrame) -> None:
        """Remove every step but ``kept``, of those that ``keep`` returned."""
        gone = [path for df, path in self.steps if not any(df is k for k in kept)]
        self.steps = [(df, path) for df, path in self.steps if path not in gone]
        try:
            for path in gone:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone already; the folder belongs to it
            pass
