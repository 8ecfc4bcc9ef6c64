"""Tables kept current by keyed upserts, bucket by bucket.

The table is cut into buckets; a bucket is a folder of files. An epoch's
changes rewrite only the buckets that they touch, into a folder of the epoch's
own, and the commit (``sources.versions``) names for every bucket the folder
that holds it. Untouched buckets keep theirs. Epoch ``e`` is version ``e + 1``:
an epoch that comes again finds its commit and changes nothing, so a stream
may replay it after a crash at any point.

Choose buckets so that an epoch touches few of them and none grows without
bound, e.g. a time slice times a hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.sources import files
from gustline.sources.versions import Conflict, Version, Versions

BUCKET = "_bucket"
NEW = "_new"  # True for the rows of the epoch, while they are merged


def latest_wins(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """Merge that keeps one row per key, the epoch's before a stored one."""
    def merge(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in keys and c not in (NEW, BUCKET)]
        picked = rows.groupBy(BUCKET, *keys).agg(F.max_by(F.struct(*others), NEW).alias("_row"))
        return picked.select(BUCKET, *keys, *[F.col("_row")[c].alias(c) for c in others])
    return merge


class KeyedStore:
    """``bucket`` gives a row's bucket label (a string fit for a folder name);
    ``merge`` turns stored and new rows (told apart by ``NEW``) of whole buckets
    into what is stored; ``summary``, if given, turns merged rows into one row per
    bucket, kept next to them."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, bucket: Column,
                 merge: Callable[[DataFrame], DataFrame], summary: Callable[[DataFrame], DataFrame] | None = None,
                 keep: int = 2):
        self.spark, self.schema, self.bucket, self.merge, self.summarise = spark, schema, bucket, merge, summary
        self.versions, self.keep = Versions(spark, root), keep

    def _read(self, held: dict[str, str]) -> DataFrame:
        paths = [self.versions.path(f"{folder}/{BUCKET}={b}") for b, folder in sorted(held.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def buckets(self) -> dict[str, str]:
        """Bucket label -> folder of the current version."""
        now = self.versions.current()
        return now.content["buckets"] if now else {}

    def read(self, labels: set[str] | None = None) -> DataFrame:
        """The current rows, of all buckets or of those named; an empty table
        before the first epoch."""
        return self._read({b: f for b, f in self.buckets().items() if labels is None or b in labels})

    def summary(self) -> DataFrame | None:
        now = self.versions.current()
        return self.spark.read.parquet(self.versions.path(now.content["summary"])) if now else None

    def apply(self, changes: DataFrame, epoch: int) -> Version:
        """Merge an epoch's rows into the table. A committed epoch is left alone;
        one that comes again with other rows than it had raises, because the
        stream then isn't the one that filled this table."""
        number = epoch + 1
        names = self.schema.names
        marked = changes.select(*names).withColumn(BUCKET, self.bucket).persist()
        try:
            told = marked.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*names)).alias("x")).collect()
            touched = {r[BUCKET]: [r["n"], r["x"]] for r in told}
            found = self.versions.numbers()
            if number in found:
                return self._replayed(number, epoch, touched)
            if found and number < found[-1]:
                raise Conflict(f"{self.versions.root}: epoch {epoch} is older than the stored ones")
            base = self.versions.get(found[-1]).content if found else {"buckets": {}, "summary": None}
            held = dict(base["buckets"])
            content = {"epoch": epoch, "changes": touched, "buckets": held, "summary": base["summary"]}
            if touched:
                folder = self.versions.new_folder(f"epoch-{epoch}")
                old = self._read({b: f for b, f in held.items() if b in touched})
                rows = (old.withColumn(BUCKET, self.bucket).withColumn(NEW, F.lit(False))
                        .unionByName(marked.withColumn(NEW, F.lit(True))))
                (self.merge(rows).select(BUCKET, *names).hint("rebalance", BUCKET)
                 .write.partitionBy(BUCKET).parquet(self.versions.path(folder)))
                held |= {b: folder for b in touched}
                if self.summarise:
                    content["summary"] = self._summarised(folder, set(touched), base["summary"])
            content["folders"] = sorted({*held.values()} | ({content["summary"]} - {None}))
            try:
                version = self.versions.commit(number, content)
            except Conflict:  # the same epoch, run twice at a time
                return self._replayed(number, epoch, touched)
            self._vacuum()
            return version
        finally:
            marked.unpersist()

    def _replayed(self, number: int, epoch: int, touched: dict) -> Version:
        version = self.versions.get(number)
        if version.content["changes"] != touched:
            raise Conflict(f"{self.versions.root}: epoch {epoch} was committed with other rows; "
                           "a new stream needs a table of its own")
        return version

    def _summarised(self, folder: str, touched: set[str], earlier: str | None) -> str:
        path = self.versions.path(folder)
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.StringType())])
        now = self.summarise(self.spark.read.schema(schema).parquet(path))
        if earlier:
            rest = self.spark.read.parquet(self.versions.path(earlier)).filter(~F.col(BUCKET).isin(*touched))
            now = rest.unionByName(now)
        name = self.versions.new_folder("summary")
        now.coalesce(1).write.parquet(self.versions.path(name))
        return name

    def _vacuum(self) -> None:
        """Remove old versions, and in folders that stay the buckets that no kept version holds."""
        found = self.versions.numbers()
        kept = {(f, b) for n in found[-self.keep:] for b, f in self.versions.get(n).content["buckets"].items()}
        old = {(f, b) for n in found[:-self.keep] for b, f in self.versions.get(n).content["buckets"].items()}
        self.versions.vacuum(self.keep)
        for folder, b in old - kept:
            files.delete(self.spark, self.versions.path(f"{folder}/{BUCKET}={b}"))
