"""Exact dedup: counting quotient filters find fingerprints that occur twice; only those are compared by content."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import kept_rows, stored, whole_text

#: Fingerprints of one range on average; there are 2 ** 10 ranges at least.
RANGE, LEAST_BITS = 1 << 20, 10


class CountingQuotientFilter:
    """Multiset of fixed-width fingerprints without loss: a quotient names a home slot, remainders fill sorted runs.

    ``occupied`` has a bit for each quotient with a run, ``run_end`` a bit for each slot that ends a run, and
    ``is_count`` a bit for each slot that holds a digit of the count (less one) of the remainder before it. Slots
    of a run begin at its home slot or right after the run before it.
    """

    def __init__(self, bits: int, quotient_bits: int, occupied: np.ndarray, run_end: np.ndarray, is_count: np.ndarray, slots: np.ndarray):
        self.bits, self.quotient_bits = bits, quotient_bits
        self.occupied, self.run_end, self.is_count, self.slots = occupied, run_end, is_count, slots

    @classmethod
    def build(cls, bits: int, values: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """From sorted distinct values (uint64, below 2**bits) and their counts."""
        q = max(1, min(bits - 1, int(len(values)).bit_length()))
        r = np.uint64(bits - q)
        quotient = (values >> r).astype(np.int64)
        remainder = values & ((np.uint64(1) << r) - np.uint64(1))
        rest = counts.astype(np.uint64) - np.uint64(1)
        digits = np.zeros(len(values), np.int64)
        left = rest.copy()
        while left.any():
            digits += left > 0
            left = left >> r if r < 64 else np.zeros_like(left)
        home, first = np.unique(quotient, return_index=True)
        width = np.add.reduceat(1 + digits, first) if len(values) else np.zeros(0, np.int64)
        total = np.cumsum(width)
        end = total + np.maximum.accumulate(home - 1 - (total - width)) if len(values) else total
        size = max(1 << q, int(end[-1]) + 1 if len(end) else 0)
        occupied, run_end, is_count = np.zeros(1 << q, bool), np.zeros(size, bool), np.zeros(size, bool)
        slots = np.zeros(size, np.uint64)
        occupied[home] = True
        run_end[end] = True
        inside = np.cumsum(1 + digits) - (1 + digits)
        run_of = np.searchsorted(first, np.arange(len(values)), "right") - 1
        at = inside - (total - width)[run_of] + (end - width + 1)[run_of] if len(values) else inside
        slots[at] = remainder
        for k in range(int(digits.max(initial=0))):
            has = digits > k
            slots[at[has] + 1 + k] = (rest[has] >> np.uint64(k * int(r))) & ((np.uint64(1) << r) - np.uint64(1))
            is_count[at[has] + 1 + k] = True
        return cls(bits, q, occupied, run_end, is_count, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct values and their counts."""
        home, end = np.flatnonzero(self.occupied), np.flatnonzero(self.run_end)
        if not len(home):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        start = np.maximum(home, np.concatenate([[0], end[:-1] + 1]))
        length = end - start + 1
        slot = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        r, counter = np.uint64(self.bits - self.quotient_bits), self.is_count[slot]
        item = np.flatnonzero(~counter)
        value = (np.repeat(home, length).astype(np.uint64)[item] << r) | self.slots[slot[item]]
        count = np.ones(len(item), np.uint64)
        owner = np.cumsum(~counter) - 1
        digit = np.arange(len(slot)) - item[owner] - 1
        np.add.at(count, owner[counter], self.slots[slot[counter]] << (digit[counter].astype(np.uint64) * r))
        return value, count.astype(np.int64)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """All filters' fingerprints in one, counts added; runs are sorted, so this is a merge of sorted lists."""
        lists = [f.items() for f in filters]
        while len(lists) > 1:
            lists = [_merged(*lists[i : i + 2]) for i in range(0, len(lists), 2)]
        return cls.build(filters[0].bits, *lists[0])

    def to_bytes(self) -> bytes:
        bits = np.packbits(np.concatenate([self.occupied, self.run_end, self.is_count]))
        return struct.pack("<BBq", self.bits, self.quotient_bits, len(self.slots)) + bits.tobytes() + self.slots.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, size = struct.unpack_from("<BBq", data)
        n, at = (1 << q) + 2 * size, struct.calcsize("<BBq")
        flags = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
        slots = np.frombuffer(data, "<u8", size, at + (n + 7) // 8)
        return cls(bits, q, flags[: 1 << q], flags[1 << q : (1 << q) + size], flags[(1 << q) + size :], slots)


def _merged(a, b=None):
    if b is None:
        return a
    values = np.concatenate([a[0], b[0]])
    order = np.argsort(values, kind="stable")  # two sorted runs: one merge pass
    values, counts = values[order], np.concatenate([a[1], b[1]])[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(values) else counts


def _partition_filters(shard_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy().view(np.uint64) for b in batches]
        if not held or not sum(map(len, held)):
            return
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        shard = (values >> np.uint64(64 - shard_bits)).astype(np.int32)
        mask = np.uint64((1 << (64 - shard_bits)) - 1)
        starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        ends = np.append(starts[1:], len(shard))
        blobs = [CountingQuotientFilter.build(64 - shard_bits, values[i:j] & mask, counts[i:j]).to_bytes() for i, j in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(shard[starts]), pa.array(blobs, pa.binary())], names=["shard", "filter"])

    return run


def _merge_shard(shard_bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in table.column("filter").to_pylist()])
        values, counts = whole.items()
        again = counts > 1
        values = values[again] | (np.uint64(key[0].as_py()) << np.uint64(64 - shard_bits))
        return pa.table({"fp": pa.array(values.view(np.int64)), "n": pa.array(counts[again])})

    return run


def repeated_fingerprints(keys: DataFrame, shard_bits: int | None = None) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once in column fp.

    Every task builds filters of its own rows, one for each range of fingerprints; ranges meet in one group each.
    A hot fingerprint is one counter per task by then. There are as many ranges (2 ** shard_bits) as the rows ask for,
    so a range holds about RANGE fingerprints however large the corpus.
    """
    if shard_bits is None:
        shard_bits = min(28, max(LEAST_BITS, (keys.count() // RANGE).bit_length()))
    filters = keys.select("fp").mapInArrow(_partition_filters(shard_bits), "shard int, filter binary")
    return filters.groupBy("shard").applyInArrow(_merge_shard(shard_bits), "fp long, n long")


def text_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One slim row per document: id, fingerprint, length and SHA-256 of all bytes, and a row number."""
    text = whole_text(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("fp"),
        F.octet_length(text).alias("n_bytes"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.monotonically_increasing_id().alias("row"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256, and keep_hash (xxhash64 of the text).

    A null text counts as empty, so null and empty texts are one group. The row with the largest doc_id stays
    (nulls are smaller than any id); of repeated rows with that id and text exactly one is kept. Texts move nowhere:
    one pass writes a slim table in the shared folder, fingerprints that the filters count once are done, and the
    others are verified by length and SHA-256 over all bytes. An empty table gives no rows.
    """
    keys = stored(text_keys(docs, id_col, text_col), "text-keys")
    routed = keys.join(repeated_fingerprints(keys).select("fp"), "fp", "left_semi")
    groups = routed.groupBy("fp", "n_bytes", "sha").agg(
        F.count("*").alias("size"), F.max(F.struct("doc_id", "row")).alias("top")
    )
    groups = stored(groups, "text-groups")  # read back, so that Spark can split a hot group's rows in the join
    joined = keys.join(groups, ["fp", "n_bytes", "sha"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("top.row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("fp").alias("keep_hash"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: one of each group of equal texts."""
    return kept_rows(docs, exact_groups(docs, id_col, text_col).where("kept").select("keep_id", "keep_hash"), id_col, text_col)
