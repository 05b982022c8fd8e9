"""Stored tables: filtered scans and bucketed Parquet folders (S9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_store(
    table: DataFrame,
    equals: Mapping[str, object] | None = None,
    isin: Mapping[str, Sequence[object]] | None = None,
    below: Mapping[str, object] | None = None,
    regex: Mapping[str, str] | None = None,
) -> DataFrame:
    """Filters that reach the Parquet scan (the regular expression runs after it)."""
    out = table
    for name, value in (equals or {}).items():
        out = out.filter(F.col(name).isNull() if value is None else F.col(name) == value)
    for name, values in (isin or {}).items():
        out = out.filter(F.col(name).isin(*values))
    for name, value in (below or {}).items():
        out = out.filter(F.col(name) < value)
    for name, pattern in (regex or {}).items():
        out = out.filter(F.col(name).rlike(pattern))
    return out


class BucketedTable:
    """A table of keyed rows as Parquet partitions ``bucket=…/batch_id=…``.

    A batch writes the buckets of its own keys and no others, each as a new partition, so what a reader of earlier
    batches sees never changes and a repeated batch overwrites its own partitions only. Readers take the last batch
    of every bucket (``replace``), or all of them (a table to which batches only add rows).
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64, replace: bool = True) -> None:
        self.spark, self.path, self.keys, self.buckets, self.replace = spark, path.rstrip("/"), list(keys), buckets, replace

    def with_bucket(self, df: DataFrame, before: int | None = None) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _all(self, before: int | None) -> DataFrame | None:
        try:
            rows = self.spark.read.parquet(self.path)
        except AnalysisException as exc:
            if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        rows = rows.withColumns({"bucket": F.col("bucket").cast("int"), "batch_id": F.col("batch_id").cast("bigint")})
        return rows if before is None else rows.filter(F.col("batch_id") < before)

    def read(self, before: int | None = None, touched: DataFrame | None = None) -> DataFrame | None:
        """Current rows with their bucket, or those before a batch; None before the first write.

        ``touched`` (column bucket) limits the scan to its buckets: at most ``buckets`` rows, pruned as partitions.
        """
        rows = self._all(before)
        if rows is None:
            return None
        if touched is not None:
            rows = rows.join(F.broadcast(touched.select("bucket").distinct()), "bucket", "left_semi")
        if self.replace:
            last = rows.groupBy("bucket").agg(F.max("batch_id").alias("batch_id"))
            rows = rows.join(F.broadcast(last), ["bucket", "batch_id"], "left_semi")
        return rows.drop("batch_id")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Rows (with their bucket) as the batch's partitions."""
        numbered = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).repartition("bucket")
        writer = numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket", "batch_id").parquet(self.path)


class GrowingTable:
    """A table of keyed rows whose buckets split as it grows (extendible hashing); the interface of ``BucketedTable``.

    A bucket is named by its first ``depth`` bits of the key's hash; one with more than ``max_rows`` rows is split by as
    many bits as needed when a batch writes it, so a batch reads and writes only about ``max_rows`` rows for each of its
    keys, however large the table. ``layout/batch_id=…`` lists the live buckets after a batch with the batches whose
    files hold their rows, ``data/batch_id=…/bucket=…`` has the rows. A batch never changes what earlier ones wrote; a
    repeated batch starts from the layout before it and overwrites its own files.

    With ``replace`` a write gives the whole content of its buckets; without, rows are added, and a bucket whose rows lie
    in ``merge_after`` batches is rewritten as one. ``vacuum`` removes files that the last layouts no longer name.
    The driver handles the names of the buckets that a batch touches and the batch numbers, never rows.
    """

    DEEPEST = 48

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], max_rows: int = 100_000, merge_after: int = 8, replace: bool = True) -> None:
        self.spark, self.path, self.keys, self.replace = spark, path.rstrip("/"), list(keys), replace
        self.max_rows, self.merge_after = max_rows, merge_after

    # --- files -------------------------------------------------------------------------------

    def _folders(self, name: str) -> list[str]:
        jvm, context = self.spark._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        return [str(s.getPath()) for s in files.listStatus(path)] if files.exists(path) else []

    def _batches(self, before: int | None = None) -> list[int]:
        """Batches that wrote a whole layout, in order."""
        numbers = [int(f.rsplit("=", 1)[1]) for f in self._folders("layout") if "batch_id=" in f]
        whole = [n for n in numbers if any(f.endswith("_SUCCESS") for f in self._folders(f"layout/batch_id={n}"))]
        return sorted(n for n in whole if before is None or n < before)

    def layout(self, before: int | None = None) -> DataFrame | None:
        """bucket, depth, prefix, versions, rows of the live buckets (before a batch)."""
        batches = self._batches(before)
        return self.spark.read.parquet(f"{self.path}/layout/batch_id={batches[-1]}") if batches else None

    # --- buckets -----------------------------------------------------------------------------

    def _prefix(self, depth: Column) -> Column:
        moved = F.call_function("shiftrightunsigned", F.xxhash64(*self.keys), (F.lit(64) - depth).cast("int"))
        return F.when(depth == 0, F.lit(0).cast("long")).otherwise(moved)

    @staticmethod
    def _name(depth: Column, prefix: Column) -> Column:
        return F.concat_ws("_", F.lit("b"), depth.cast("string"), prefix.cast("string"))

    def with_bucket(self, df: DataFrame, before: int | None = None) -> DataFrame:
        """Rows with the name of their live bucket (before a batch)."""
        layout = self.layout(before)
        if layout is None:
            return df.withColumn("bucket", F.lit("b_0_0"))
        depths = [r["depth"] for r in layout.select("depth").distinct().collect()]  # as many as hash bits at most
        tried = df.withColumn("_depth", F.explode(F.array(*[F.lit(d) for d in sorted(depths)])))
        tried = tried.withColumn("bucket", self._name(F.col("_depth"), self._prefix(F.col("_depth")))).drop("_depth")
        return tried.join(layout.select("bucket"), "bucket", "left_semi")

    def read(self, before: int | None = None, touched: DataFrame | None = None) -> DataFrame | None:
        """Current rows with their bucket, or those before a batch; None before the first write. ``touched`` (column
        bucket) limits the reading to its buckets."""
        layout = self.layout(before)
        if layout is None:
            return None
        if touched is not None:
            layout = layout.join(touched.select("bucket").distinct(), "bucket", "left_semi")
        named = layout.select("bucket", F.explode("versions").alias("v")).collect()
        paths = [f"{self.path}/data/batch_id={r['v']}/bucket={r['bucket']}" for r in named]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths).drop("batch_id")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Rows (with their bucket, as with_bucket gave it) as the batch's files, and the layout after them."""
        layout = self.layout(batch_id)
        if layout is None:
            first = "'b_0_0' as bucket, 0 as depth, 0L as prefix, cast(array() as array<bigint>) as versions, 0L as rows"
            layout = self.spark.sql(f"select {first}")
        own = rows.groupBy("bucket").agg(F.count("*").alias("_own")).join(layout, "bucket")
        total = F.col("_own") if self.replace else F.col("_own") + F.col("rows")
        whole = F.lit(True) if self.replace else (F.size("versions") + 1 >= self.merge_after) | (total > self.max_rows)
        bits = F.greatest(F.lit(0), F.ceil(F.log2(total / self.max_rows))).cast("int")
        plan = own.select(
            "bucket", "depth", "prefix", "versions", total.alias("_total"), whole.alias("_whole"),
            F.when(whole, F.least(F.lit(self.DEEPEST) - F.col("depth"), bits)).otherwise(0).alias("_bits"),
        ).persist()
        try:
            content = rows
            if not self.replace:
                old = self.read(batch_id, plan.filter("_whole"))
                content = rows if old is None else rows.unionByName(old.select(*rows.columns))
            placed = content.join(plan.select("bucket", "depth", "_bits"), "bucket").withColumn("_to", F.col("depth") + F.col("_bits"))
            named = placed.withColumn("bucket", self._name(F.col("_to"), self._prefix(F.col("_to")))).drop("depth", "_bits", "_to")
            named.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch_id={batch_id}")
            if plan.isEmpty():
                return
            written = self.spark.read.parquet(f"{self.path}/data/batch_id={batch_id}").groupBy("bucket").agg(F.count("*").alias("_rows"))
            wide = F.expr("shiftleft(prefix, _bits)")
            children = plan.filter("_whole").select(
                (F.col("depth") + F.col("_bits")).alias("depth"), F.explode(F.sequence(wide, wide + F.expr("shiftleft(1L, _bits) - 1"))).alias("prefix")
            ).withColumn("bucket", self._name(F.col("depth"), F.col("prefix")))
            now = F.array(F.lit(batch_id).cast("long"))
            fresh = children.join(written, "bucket", "left").select(
                "bucket", "depth", "prefix", F.when(F.col("_rows") > 0, now).otherwise(F.array().cast("array<bigint>")).alias("versions"), F.coalesce("_rows", F.lit(0)).alias("rows")
            )
            added = plan.filter("not _whole").select("bucket", "depth", "prefix", F.concat("versions", now).alias("versions"), F.col("_total").alias("rows"))
            kept = layout.join(plan.select("bucket"), "bucket", "left_anti").select("bucket", "depth", "prefix", "versions", "rows")
            kept.unionByName(fresh).unionByName(added).repartition("bucket").write.mode("overwrite").parquet(f"{self.path}/layout/batch_id={batch_id}")
        finally:
            plan.unpersist()

    def vacuum(self, keep: int = 2) -> None:
        """Removes layouts before the last ``keep`` and files that none of those names."""
        jvm, context = self.spark._jvm, self.spark.sparkContext
        batches = self._batches()
        live = {
            (r["v"], r["bucket"]) for n in batches[-keep:]
            for r in self.spark.read.parquet(f"{self.path}/layout/batch_id={n}").select("bucket", F.explode("versions").alias("v")).collect()
        }
        gone = [f"{self.path}/layout/batch_id={n}" for n in batches[:-keep]]
        for n in batches:
            gone += [f for f in self._folders(f"data/batch_id={n}") if "bucket=" in f and (n, f.rsplit("bucket=", 1)[1]) not in live]
        for name in gone:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
