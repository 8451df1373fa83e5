"""The document store (S6): batches of documents under a shared path, merged when read.

A batch is one folder that Spark's committer completes as a whole; one without the mark of
completion is not read.  A batch with a number that is there already replaces it, so a
repeated batch changes nothing.  ``compact`` writes the present state as a new base, from
which later reads start; the folders before it can be deleted by ``forget_before``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _bucket(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def latest(versions: DataFrame, order: str) -> DataFrame:
    """The last version of every document; versions reduce before they are shuffled.

    Two rows of one document and version are settled by their content, so that every run agrees.
    """
    rest = [c for c in versions.columns if c not in ("document_id", order)]
    content = F.sha2(F.to_json(F.struct(*rest)), 256)
    return versions.groupBy("document_id").agg(
        F.max_by(F.struct(*rest), F.struct(order, content)).alias("_row"), F.max(order).alias(order)
    ).select("document_id", "_row.*", order)


class DocumentStore:
    """``save`` a batch, ``list`` all documents, ``get`` one, ``compact``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, documents: DataFrame, version: int) -> None:
        """Add or replace the documents of one batch; a document that is in the store gets a new version."""
        self._write(latest(documents.withColumn("version", F.lit(version).cast("long")), "version"), f"batch={version}")

    def list(self) -> DataFrame:
        return latest(self._versions(), "version")

    def get(self, document_id: str) -> DataFrame:
        """One document; the bucket prunes the files that are read."""
        rows = self._versions(keep_bucket=True)
        wanted = (F.col("bucket") == _bucket(F.lit(document_id))) & (F.col("document_id") == document_id)
        return latest(rows.where(wanted).drop("bucket"), "version")

    def compact(self) -> None:
        """The present documents as one folder; reads start from it."""
        newest = max((n for _, n in self._folders()), default=None)
        if newest is not None:
            self._write(self.list(), f"base={newest}")

    def forget_before(self) -> None:
        """Delete the folders that the newest base covers."""
        base = max((n for kind, n in self._folders() if kind == "base"), default=None)
        for kind, n in self._folders():
            if base is not None and (n < base or (n == base and kind == "batch")):
                where = self._hadoop_path(f"{kind}={n}")
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.withColumn("bucket", _bucket(F.col("document_id"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def _hadoop_path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _folders(self) -> list[tuple[str, int]]:
        """Kind and number of the completed folders; their names are the manifest, one per batch."""
        top = self._hadoop_path()
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(top):
            return []
        names = [s.getPath().getName() for s in files.listStatus(top) if s.isDirectory()]
        whole = [n for n in names if n.startswith(("batch=", "base=")) and files.exists(self._hadoop_path(f"{n}/_SUCCESS"))]
        return [(kind, int(n)) for kind, n in (x.split("=") for x in whole)]

    def _versions(self, keep_bucket: bool = False) -> DataFrame:
        folders = self._folders()
        base = max((n for kind, n in folders if kind == "base"), default=None)
        read = [f"{self.path}/base={base}"] if base is not None else []
        read += [f"{self.path}/batch={n}" for kind, n in sorted(folders) if kind == "batch" and (base is None or n > base)]
        if not read:
            raise FileNotFoundError(f"no documents are stored under {self.path}")
        rows = None
        for path in read:
            part = self.spark.read.parquet(path)
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        return rows if keep_bucket else rows.drop("bucket")
