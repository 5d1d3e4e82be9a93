"""A table that a stream keeps up to date: one row per key, the greatest by an order wins.

Keys are hashed to buckets. A micro-batch writes the buckets it touches anew, under its epoch, and
then a log row per bucket that names the epoch to read; buckets it does not touch stay where they
are. So the size follows the keys and not the number of batches. The log is written last: a batch
that fails before it left nothing readable, and one that is repeated after it is skipped.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class KeyedTable:
    """``keys`` name a row; of rows with one key the greatest ``order`` stays, of ties any.

    ``buckets`` is fixed when the table is made; one bucket should fit a task. The last ``keep``
    states can be read, older files go, so a reader may take as long as ``keep`` batches do.
    NULL keys are keys like any other; an empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: tuple[str, ...], order: tuple[str, ...],
                 *, buckets: int = 16, keep: int = 2):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.keys, self.order, self.buckets, self.keep = keys, order, buckets, keep

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _system(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def epochs(self) -> list[int]:
        """Epochs whose log is complete, in order."""
        log, fs = self._path("log"), self._system()
        if not fs.exists(log):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(log)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("epoch=") and fs.exists(self._path("log", n, "_SUCCESS")))

    def _places(self, epoch: int) -> dict[int, int]:
        """The epoch to read each bucket from; a row per bucket at most."""
        rows = self.spark.read.schema("bucket int, written long").parquet(f"{self.folder}/log/epoch={epoch}").collect()
        return {r.bucket: r.written for r in rows}

    def _rows(self, places: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/rows/epoch={e}/bucket={b}" for b, e in sorted(places.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The state after the last complete batch."""
        done = self.epochs()
        return self._rows(self._places(done[-1]) if done else {})

    def _winners(self, rows: DataFrame) -> DataFrame:
        """One row per key; rows that are merged in parts and then with each other must give the same."""
        rest = [c for c in self.schema.names if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_best"))
        return best.select(*self.keys, "_best.*").select(*self.schema.names)

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        """Take a micro-batch in; for ``foreachBatch``."""
        done = self.epochs()
        if done and epoch <= done[-1]:
            return
        places = self._places(done[-1]) if done else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = self._winners(batch.select(*self.schema.names)).withColumn("bucket", bucket).persist()
        try:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            if not touched:
                return
            old = self._rows({b: places[b] for b in touched if b in places})
            both = self._winners(new.select(*self.schema.names).unionByName(old)).withColumn("bucket", bucket)
            both.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/epoch={epoch}")
        finally:
            new.unpersist()
        places |= dict.fromkeys(touched, epoch)
        self.spark.createDataFrame(sorted(places.items()), "bucket int, written long").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.folder}/log/epoch={epoch}")
        self._forget(done + [epoch])

    def _forget(self, done: list[int]) -> None:
        """Drop logs before the last ``keep`` and the files that no kept log names."""
        kept, fs = done[-self.keep:], self._system()
        named = {(e, b) for epoch in kept for b, e in self._places(epoch).items()}
        for status in fs.listStatus(self._path("rows")):
            epoch = int(status.getPath().getName().split("=")[1])
            parts = [p.getPath() for p in fs.listStatus(status.getPath()) if p.getPath().getName().startswith("bucket=")]
            old = [p for p in parts if (epoch, int(p.getName().split("=")[1])) not in named]
            for path in [status.getPath()] if len(old) == len(parts) else old:
                fs.delete(path, True)
        for epoch in done[:-self.keep]:
            fs.delete(self._path("log", f"epoch={epoch}"), True)

    def run(self, stream: DataFrame, state: str) -> DataFrame:
        """Take in what the stream has now, then the table."""
        stream.writeStream.foreachBatch(self.upsert).option("checkpointLocation", state) \
            .trigger(availableNow=True).start().awaitTermination()
        return self.read()
