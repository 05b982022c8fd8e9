"""Stored companies for readers: pages by position and by key, and search through trigram postings (D6, D7)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from re import _constants as kinds
from re import _parser as patterns

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.store import search_companies

Order = Sequence[tuple[str, str]]  # column, "asc" (nulls first) or "desc" (nulls last)


def order_columns(order: Order, id_col: str) -> list[Column]:
    return [*(F.desc(c) if way == "desc" else F.asc(c) for c, way in order), F.asc(id_col)]


def after(order: Order, id_col: str, last: Sequence[object]) -> Column:
    """Rows behind ``last`` (the order columns' values, then the id) in that order; nulls keep their place."""
    found = F.col(id_col) > F.lit(last[-1])
    for (name, way), value in reversed(list(zip(order, last))):
        c = F.col(name)
        if value is None:
            later = F.lit(False) if way == "desc" else c.isNotNull()
        else:
            later = (c < F.lit(value)) | c.isNull() if way == "desc" else c > F.lit(value)
        found = F.coalesce(later, F.lit(False)) | (c.eqNullSafe(F.lit(value)) & found)
    return found


def page_after(rows: DataFrame, order: Order, id_col: str, last: Sequence[object] | None = None, size: int = 20) -> DataFrame:
    """The page behind a known last row: (order, id) is unique, so ties at a page's border lose nothing."""
    if size < 1:
        raise ValueError("size must be at least 1")
    tail = rows if last is None else rows.filter(after(order, id_col, last))
    return tail.orderBy(*order_columns(order, id_col)).limit(size)


class PageDirectory:
    """An ordered table as ranges ``range=…`` with their row counts, so page k reads only the ranges it lies in.

    The ranges follow (order, id), which has to be unique; ties and nulls have a place in it. The directory has one row
    for each range, its number of rows and that of the ranges before.
    """

    def __init__(self, spark: SparkSession, path: str, order: Order, id_col: str) -> None:
        self.spark, self.path, self.order, self.id_col = spark, path.rstrip("/"), list(order), id_col

    def write(self, rows: DataFrame, ranges: int) -> None:
        columns = order_columns(self.order, self.id_col)
        dealt = rows.repartitionByRange(ranges, *columns).withColumn("range", F.spark_partition_id())
        dealt.sortWithinPartitions(*columns).write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/rows")
        held = self._rows().groupBy("range").agg(F.count("*").alias("held"))
        counted = held.withColumn("before", F.expr("sum(held) over (order by range) - held"))  # a row for each range
        counted.write.mode("overwrite").parquet(f"{self.path}/directory")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def page(self, page: int = 1, size: int = 20) -> DataFrame:
        """Page number ``page`` (from 1); the driver looks up the few ranges that it lies in."""
        if page < 1 or size < 1:
            raise ValueError("page and size must be at least 1")
        start = (page - 1) * size
        directory = self.spark.read.parquet(f"{self.path}/directory")
        inside = directory.filter((F.col("before") < start + size) & (F.col("before") + F.col("held") > start)).orderBy("range").collect()
        if not inside:
            return self._rows().drop("range").limit(0)
        rows = self._rows().filter(F.col("range").isin([r["range"] for r in inside])).drop("range")
        return rows.orderBy(*order_columns(self.order, self.id_col)).offset(start - inside[0]["before"]).limit(size)


def _needed(parsed) -> list[set[str]] | None:
    """Per alternative the trigrams of the literal parts that every match contains; None where one has none."""
    grams, run = set(), ""

    def close() -> None:
        nonlocal run
        grams.update(run[i : i + 3] for i in range(len(run) - 2))
        run = ""

    inner: list[list[set[str]]] = []
    for kind, value in parsed:
        if kind is kinds.LITERAL and value < 128:
            run += chr(value).lower()
        elif kind is kinds.AT:
            close()
        elif kind is kinds.SUBPATTERN and value[-1] is not None:
            close()
            found = _needed(value[-1])
            if found:
                inner.append(found)
        elif kind is kinds.BRANCH:
            close()
            found = [_needed(p) for p in value[1]]
            if all(found):
                inner.append([g for f in found for g in f])
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] >= 1:
            close()
            found = _needed(value[2])
            if found:
                inner.append(found)
        else:
            close()
    close()
    if len(parsed) == 1 and parsed[0][0] is kinds.BRANCH:
        return inner[0] if inner else None
    if grams:
        return [grams]
    return inner[0] if inner else None


def trigrams_of(pattern: str, literal: bool = False) -> list[set[str]] | None:
    """Alternatives, each a set of trigrams that a text must hold to match; None: no such set, every text may match."""
    try:
        return _needed(patterns.parse(re.escape(pattern) if literal else pattern))
    except (re.error, OverflowError, RecursionError):
        return None


class SearchIndex:
    """Trigram postings of companies for ``search_companies``: the same rows without reading all of them.

    ``postings`` holds (bucket, gram, row_bucket, company_id), a row for each distinct trigram of a company's searched
    columns; ``rows`` the companies by bucket of their id. A search reads the buckets of its pattern's trigrams, keeps
    companies that have all of an alternative's, reads their buckets and tests the pattern itself. A pattern without
    trigrams (``7$``) tests every row. Only ASCII is folded in trigrams, so other letters are not indexed.
    """

    COLUMNS = ("name", "website", "source")

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, c: Column) -> Column:
        return F.crc32(c.cast("string").cast("binary")) % self.buckets

    def write(self, companies: DataFrame) -> None:
        rows = companies.withColumn("row_bucket", self._bucket(F.col("company_id")))
        rows.repartition("row_bucket").write.mode("overwrite").partitionBy("row_bucket").parquet(f"{self.path}/rows")
        text = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
        cut = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substr(t, i, F.lit(3)))
        none = F.array().cast("array<string>")
        grams = F.array_distinct(F.concat(*[F.when(F.length(text(c)) >= 3, cut(text(c))).otherwise(none) for c in self.COLUMNS]))
        postings = rows.select("company_id", "row_bucket", F.explode(grams).alias("gram")).withColumn("bucket", self._bucket(F.col("gram")))
        postings.repartition("bucket").sortWithinPartitions("gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def candidates(self, alternatives: list[set[str]]) -> DataFrame:
        """company_id, row_bucket of the companies that have all trigrams of an alternative."""
        postings = self.spark.read.parquet(f"{self.path}/postings")
        found = None
        for grams in alternatives:
            places = sorted({zlib.crc32(g.encode()) % self.buckets for g in grams})
            hits = postings.filter(F.col("bucket").isin(places) & F.col("gram").isin(sorted(grams)))
            own = hits.groupBy("company_id", "row_bucket").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).drop("n")
            found = own if found is None else found.unionByName(own)
        return found.distinct()

    def search(self, term: str | None = None, sort: str = "created_at", order: str = "desc", literal: bool = False) -> DataFrame:
        rows = self.rows()
        alternatives = trigrams_of(term.strip(), literal) if term and term.strip() else None
        if alternatives:
            found = self.candidates(alternatives)
            rows = rows.join(found, ["company_id", "row_bucket"], "left_semi")
        return search_companies(rows.drop("row_bucket"), term, sort, order, literal)
