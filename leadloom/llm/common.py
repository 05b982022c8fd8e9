"""What the operators share: tables in the shared folder, Arrow columns, row keys, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the cluster names none, a folder of this machine is used, and only in local mode: on a cluster
    it would give every executor a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that clashes with none of the frame's (Spark ignores case in names)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def whole_text(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Bounds the rows of an Arrow batch in this session (a batch of whole texts lies in memory several times)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if now <= 0 or now > rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string, never null), whatever else the table holds."""
    return small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")))


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def kept_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs named by (keep_id, keep_hash), all columns, one row for each name.

    keep_hash is xxhash64 of the text (null: empty). Rows are told apart by id and text together, so a hot text
    or a hot id alone does not gather in one task.
    """
    mark = free_name(docs, "_text_hash")
    hashed = docs.withColumn(mark, F.xxhash64(whole_text(text_col)))
    own, other = free_name(docs, "_keep_id"), free_name(docs, "_keep_hash")
    names = kept.select(F.col("keep_id").alias(own), F.col("keep_hash").alias(other)).distinct()
    on = F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(mark) == F.col(other))
    return hashed.join(names, on, "left_semi").dropDuplicates([id_col, mark]).drop(mark)


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to a star for each connected group: (member, smallest member), members only once."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracts what a task has seen whenever a bounded number of edges is held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        u, v = local_stars(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > 2_000_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's group; roots themselves are left out.

    edges has two long columns. Large-star and small-star steps alternate until nothing changes; each round is
    a table in the shared folder. A step joins links with the minima of their nodes, one row per node; these are
    read back from a table, so both sides of the join are dealt out for it and Spark can split a hot node.
    """
    a, b = edges.columns[:2]
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    links = stored(links.mapInArrow(_stars, "u long, v long").distinct(), "links")
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = links.union(links.select("v", "u"))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "links")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.expr("explode(array(struct(u as u, m as v), struct(v as u, m as v)))").alias("e"))
        links = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
