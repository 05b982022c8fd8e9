"""Suffix-array dedup: bytes covered by a string that also starts in an earlier document are found by bucket-pointer
refinement of text windows and removed.

A window is a string of ``length`` (50) bytes. Its anchor is its q-gram of least hash, so equal windows have equal
anchors, wherever they stand. Neighbouring windows with one anchor form a piece. Documents are dealt into blocks, once
for all steps (the exchange is reused): first only the anchors' hashes meet, to tell each block which of its anchors
occur in other documents; then pieces with such an anchor go to the shard of their anchor, and there, as in the chunk
where they were cut, equal windows meet. Buckets of pieces start from the anchor's q-gram and are refined by the bytes
beside it; what is left in common is sorted out exactly by bucket pointers.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import id_and_text

Q = 16
#: Bytes of text that are cut into pieces at once, that a block holds, and for which there is a shard.
CHUNK, BLOCK, SHARD = 3_000_000, 4_000_000, 16_000_000
LAST = np.iinfo(np.int64).max
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


@dataclass
class Pieces:
    """Runs of windows in one buffer: where a run starts, how many windows it has, where its anchor stands (from the
    start), and which document (order, hash of the text) and place it comes from."""

    buf: np.ndarray
    off: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray
    text_hash: np.ndarray
    place: np.ndarray

    def take(self, rows: np.ndarray, skip: np.ndarray | int = 0, windows: np.ndarray | None = None) -> Pieces:
        """Rows, or parts of them that leave out ``skip`` windows at the start."""
        return Pieces(self.buf, self.off[rows] + skip, self.windows[rows] if windows is None else windows, self.anchor[rows] - skip, self.doc[rows], self.text_hash[rows], self.place[rows] + skip)

    def bytes_of(self, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Copies of the rows' bytes, one after the other, and their lengths."""
        n = self.windows[rows] + (length - 1)
        at = np.repeat(self.off[rows] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return self.buf[at], n


def runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


# --- cutting ----------------------------------------------------------------------------------------------


def cut(texts: list[tuple[bytes, int, int, int]], length: int) -> Pieces:
    """Pieces of (text, document order, text hash, place of the text in its document)."""
    buf = np.frombuffer(b"".join(t[0] for t in texts) + bytes(2 * length), np.uint8)
    sizes = np.array([len(t[0]) for t in texts])
    end = np.cumsum(sizes)
    total, grams = int(end[-1]), length - Q + 1
    h = (buf.astype(np.uint64) + np.uint64(1)) * _M1
    step, power = 1, int(_M2)
    while step < Q:
        h = h[:-step] * np.uint64(power) + h[step:]
        power = power * power % (1 << 64)
        step *= 2
    h = _mix(h)[: total + grams]
    place = np.arange(len(h), dtype=np.uint64)
    best = (h & ~np.uint64(0xFFFFFF)) | place  # the leftmost of equal hashes
    step = 1
    while 2 * step <= grams:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if grams > step:
        best = np.minimum(best[: step - grams], best[grams - step :])
    anchor = (best[:total] & np.uint64(0xFFFFFF)).astype(np.int64)
    which = np.repeat(np.arange(len(texts)), sizes)
    valid = np.arange(total) + length <= end[which]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1])
    start = np.flatnonzero(first)
    counts = np.add.reduceat(valid.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    owner = which[start]
    column = lambda k: np.array([t[k] for t in texts], np.int64)[owner]
    return Pieces(buf, start, counts, anchor[start] - start, column(1), column(2), column(3) + start - (end - sizes)[owner])


def anchor_hash(p: Pieces) -> np.ndarray:
    a = p.off + p.anchor
    word = lambda at: np.ndarray((len(p.buf) - 7,), "<u8", p.buf, strides=(1,))[at]
    return _mix(word(a) * _M1 + _mix(word(a + 8)))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes % np.uint64(shards)).astype(np.int64)


def short(hashes: np.ndarray) -> np.ndarray:
    """What is kept of a hash to ask for other anchors like it; a chance match only sends a piece in vain."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


# --- buckets ----------------------------------------------------------------------------------------------


def _context(p: Pieces, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of n bytes (over 8) at each place: overlapping words of eight."""
    words = np.ndarray((len(p.buf) - 7,), "<u8", p.buf, strides=(1,))
    h = np.zeros(len(at), np.uint64)
    for k in [*range(0, n - 7, 8), *([n - 8] if n % 8 else [])]:
        h = _mix(h * _M1 + words[at + k])
    return h


def _shared(keys: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Rows whose key also occurs with another value."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    k, v = keys[order], value[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    many = np.minimum.reduceat(v, starts) != np.maximum.reduceat(v, starts)
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(many, np.diff(np.append(starts, len(k))))
    return out


def _met(p: Pieces, value: np.ndarray, length: int) -> np.ndarray:
    """Pieces that may share a window with a piece of another value.

    Of a window that begins l bytes before its anchor, either l or the rest behind the anchor is at least half of
    what is left; so pieces with a common window agree on the anchor and that half on one side.
    """
    half = (length - Q + 1) // 2
    behind = length - Q - half + 1
    out = np.zeros(len(p.off), bool)
    a = p.off + p.anchor
    for rows, shift, n in ((np.flatnonzero(p.anchor - p.windows + 1 < half), 0, Q + behind), (np.flatnonzero(p.anchor >= half), half, Q + half)):
        out[rows] |= _shared(_context(p, a[rows] - shift, n), value[rows])
    return out


def refined(bucket: np.ndarray, offset: int) -> np.ndarray:
    """Bucket pointers of twice the depth: buckets with several suffixes are sorted by the pointers at ``offset``."""
    n = len(bucket) - offset
    out = bucket[:n].copy()
    several = np.flatnonzero(np.bincount(bucket)[out] > 1)
    pair = (out[several] << 32) | bucket[offset:][several]
    out[several] = bucket.max() + 1 + np.unique(pair, return_inverse=True)[1]
    return out


def window_buckets(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the windows at ``starts``: equal exactly if their bytes are equal.

    Initial buckets are q-grams of eight bytes; pointers are refined at offset 8, 16 ... and every round reuses the
    pointers that the one before updated. The last step overlaps, so that exactly ``length`` bytes are compared.
    """
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    bucket = np.unique(words, return_inverse=True)[1]
    depth = 8
    while 2 * depth <= length:
        bucket = refined(bucket, depth)
        depth *= 2
    return np.unique((bucket[starts] << 32) | bucket[starts + length - depth], return_inverse=True)[1]


def repeated(p: Pieces, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which windows also start in an earlier document among these pieces.

    Returns (rows, first, n, flag): runs of ``n`` windows from window ``first`` of a row, earlier ones or not;
    together all windows of the rows that may share one. Other rows have no repeated window.
    """
    rows = np.flatnonzero(_met(p, p.doc, length))
    if not len(rows):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    known: dict[bytes, int] = {}
    raw = p.buf.tobytes()
    ends = p.off[rows] + p.windows[rows] + (length - 1)
    same = np.fromiter((known.setdefault(raw[i:j], len(known)) for i, j in zip(p.off[rows].tolist(), ends.tolist())), np.int64, len(rows))
    sample = np.empty(len(known), np.int64)
    sample[same[::-1]] = rows[::-1]
    low = np.full(len(known), LAST)
    np.minimum.at(low, same, p.doc[rows])
    one = p.take(sample)
    first_window = np.cumsum(one.windows) - one.windows
    earliest = np.repeat(low, one.windows)
    several = np.flatnonzero(_met(one, np.arange(len(sample)), length))
    if len(several):
        text, sizes = one.bytes_of(several, length)
        n = one.windows[several]
        step = runs(n)
        bucket = window_buckets(text, np.repeat(np.cumsum(sizes) - sizes, n) + step, length)
        least = np.full(bucket.max() + 1, LAST)
        at = np.repeat(first_window[several], n) + step
        np.minimum.at(least, bucket, earliest[at])
        earliest[at] = least[bucket]
    n = p.windows[rows]
    step = runs(n)
    flag = earliest[np.repeat(first_window[same], n) + step] < np.repeat(p.doc[rows], n)
    new = (step == 0) | np.concatenate([[True], flag[1:] != flag[:-1]])
    starts = np.flatnonzero(new)
    return np.repeat(rows, n)[starts], step[starts], np.diff(np.append(starts, len(flag))), flag[starts]


# --- tables -----------------------------------------------------------------------------------------------


def pack(p: Pieces, rows: np.ndarray, length: int) -> bytes:
    docs, which = np.unique(np.stack([p.doc[rows], p.text_hash[rows]], axis=1), axis=0, return_inverse=True)
    text, _ = p.bytes_of(rows, length)
    parts = [
        struct.pack("<qqq", len(rows), len(docs), len(text)), docs.astype("<i8").tobytes(), which.astype("<u4").tobytes(),
        p.place[rows].astype("<u4").tobytes(), p.windows[rows].astype("<u2").tobytes(), p.anchor[rows].astype("<u2").tobytes(), text.tobytes(),
    ]
    return zstandard.compress(b"".join(parts), 1)


def unpack(blobs: list[bytes], length: int) -> Pieces:
    columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
    for blob in blobs:
        data = zstandard.decompress(blob)
        n, docs, size = struct.unpack_from("<qqq", data)
        at = 24

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        table = read("<i8", 2 * docs).reshape(-1, 2)
        which, place, windows, anchor, text = read("<u4", n), read("<u4", n), read("<u2", n), read("<u2", n), read("u1", size)
        for column, values in zip(columns, (table[which, 0], table[which, 1], place, windows, anchor, text)):
            column.append(values)
    doc, text_hash, place, windows, anchor = (np.concatenate(c).astype(np.int64) for c in columns[:5])
    n = windows + (length - 1)
    buf = np.concatenate([*columns[5], np.zeros(2 * length, np.uint8)])
    return Pieces(buf, np.cumsum(n) - n, windows, anchor, doc, text_hash, place)


def _flag_rows(p: Pieces, rows: np.ndarray, first: np.ndarray, n: np.ndarray, blocks: int) -> tuple[list[int], list[bytes]]:
    """Found windows as (document, text hash, place, number), packed by the block that their document belongs to."""
    block = ((p.text_hash[rows] ^ p.doc[rows]) % blocks).astype(np.int64)  # as in remove_repeats
    order = np.argsort(block, kind="stable")
    table = np.stack([p.doc[rows], p.text_hash[rows], p.place[rows] + first, n], axis=1)[order].astype("<i8")
    starts = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1]])) if len(order) else order
    return block[order][starts].tolist(), [zstandard.compress(t.tobytes(), 1) for t in np.split(table, starts[1:])] if len(order) else []


def _chunks(table: pa.Table, length: int) -> Iterator[Pieces]:
    """Pieces of a block's documents, about CHUNK bytes at a time; long texts in parts that overlap."""
    held, size = [], 0
    columns = (table.column("doc_id").fill_null(LAST).to_pylist(), table.column("text_hash").to_pylist())
    for text, doc, text_hash in zip(table.column("text").cast(pa.binary()), *columns):
        raw = text.as_py()
        for at in range(0, max(len(raw) - length + 1, 0), CHUNK):
            part = raw[at : at + CHUNK + length - 1]
            held.append((part, doc, text_hash, at))
            size += len(part)
            if size >= CHUNK:
                yield cut(held, length)
                held, size = [], 0
    if held:
        yield cut(held, length)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, rows) for each shard."""
    order = np.argsort(shard, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]])) if len(order) else order
    for i, own in zip(starts, np.split(order, starts[1:]) if len(order) else []):
        yield int(shard[order[i]]), own


def _sorted_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 32-bit keys as differences, packed."""
    return zstandard.compress(np.diff(keys, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def _read_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), "<u4"), dtype=np.uint32)


def _ask(length: int, shards: int):
    """The anchors of a block: for each shard those in one document, and those in several."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for p in _chunks(table, length):
            hashes.append(anchor_hash(p))
            docs.append(p.doc)
        h, d = np.concatenate(hashes), np.concatenate(docs)
        order = np.argsort(h)
        h, d = h[order], d[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else order
        many = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts) if len(h) else np.zeros(0, bool)
        h = h[starts]
        rows = [(s, _sorted_keys(np.unique(short(h[own]))), _sorted_keys(np.unique(short(h[own[many[own]]])))) for s, own in _by_shard(shard_of(h, shards))]
        shard, once, several = zip(*rows) if rows else ([], [], [])
        return pa.table({"shard": pa.array(shard, pa.int64()), "block": pa.array([key[0].as_py()] * len(rows), pa.int64()), "once": pa.array(once, pa.binary()), "several": pa.array(several, pa.binary())})

    return run


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Tells every block which of its anchors in this shard occur in several documents."""
    mine = [_read_keys(x) for x in table.column("once").to_pylist()]
    every, count = np.unique(np.concatenate(mine), return_counts=True)
    several = [_read_keys(x) for x in table.column("several").to_pylist()]
    shared = np.union1d(every[count > 1], np.concatenate(several))
    found = [m[np.isin(m, shared, assume_unique=True)] for m in mine]
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "shared": pa.array([_sorted_keys(f) for f in found], pa.binary())})


_STEP = "kind int, bucket long, data binary"  # kind 0: windows found, bucket is a block; kind 1: pieces of a shard


def _cut_block(length: int, shards: int, blocks: int):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        keys = [(np.uint64(s) << np.uint64(32)) | _read_keys(x).astype(np.uint64) for s, x in zip(answers.column("shard").to_pylist(), answers.column("shared").to_pylist())]
        shared = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        out: list[tuple[int, int, bytes]] = []
        for p in _chunks(table, length) if len(shared) else ():
            h = anchor_hash(p)
            asked = (shard_of(h, shards).astype(np.uint64) << np.uint64(32)) | short(h).astype(np.uint64)
            at = np.minimum(np.searchsorted(shared, asked), len(shared) - 1)
            p = p.take(np.flatnonzero(shared[at] == asked))
            rows, first, n, flag = repeated(p, length)
            out += [(0, b, d) for b, d in zip(*_flag_rows(p, rows[flag], first[flag], n[flag], blocks))]
            alone = np.ones(len(p.off), bool)
            alone[rows] = False
            rest, plain = p.take(rows[~flag], first[~flag], n[~flag]), p.take(np.flatnonzero(alone))
            p = Pieces(p.buf, *(np.concatenate([getattr(plain, k), getattr(rest, k)]) for k in ("off", "windows", "anchor", "doc", "text_hash", "place")))
            out += [(1, s, pack(p, own, length)) for s, own in _by_shard(shard_of(anchor_hash(p), shards))]
        kind, bucket, data = zip(*out) if out else ([], [], [])
        return pa.table({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def _meet(length: int, blocks: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        if kind[0] == 0:
            return table.select(["bucket", "data"])
        p = unpack(data, length)
        rows, first, n, flag = repeated(p, length)
        found = _flag_rows(p, rows[flag], first[flag], n[flag], blocks)
        return pa.table({"bucket": pa.array(found[0], pa.int64()), "data": pa.array(found[1], pa.binary())})

    return run


def spans_of(place: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the windows cover."""
    order = np.argsort(place, kind="stable")
    start, end = place[order], np.maximum.accumulate((place + n + (length - 1))[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(end)) - 1]


def _remove(length: int, kept: bool):
    def run(key: tuple, docs: pa.Table, windows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(zstandard.decompress(x), "<i8").reshape(-1, 4) for x in windows.column("data").to_pylist()]
        table = np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        cuts = np.flatnonzero((table[1:, :2] != table[:-1, :2]).any(axis=1)) + 1
        found = {(int(t[0, 0]), int(t[0, 1])): t[:, 2:] for t in np.split(table, cuts) if len(t)}
        out = []
        for doc, text_hash, text in zip(docs.column("doc_id").to_pylist(), docs.column("text_hash").to_pylist(), docs.column("text").cast(pa.binary())):
            raw = text.as_py()
            mine = found.get((LAST if doc is None else doc, text_hash))
            start, end = spans_of(mine[:, 0], mine[:, 1], length) if mine is not None else (np.zeros(0, np.int64),) * 2
            rest = b"".join(raw[i:j] for i, j in zip([0, *end.tolist()], [*start.tolist(), len(raw)]))
            row = (doc, len(raw), len(raw) - len(rest), len(start), hashlib.sha256(rest).hexdigest())
            out.append((*row, rest, [{"start": int(i), "end": int(j)} for i, j in zip(start, end)]) if kept else row)
        kinds = [pa.int64()] * 4 + [pa.string()] + ([pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] if kept else [])
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * kept
        columns = zip(*out) if out else [[]] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = 50, kept: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept (binary, since a
    cut may part a character) and spans (start, end of the removed runs).

    Texts are UTF-8 bytes, null counts as empty, strings never cross documents. A null doc_id comes after all
    others; documents with one doc_id never remove from each other, so repeated rows give equal rows. An empty
    table gives none. Windows that repeat within a chunk are settled there: of a passage in very many documents
    each chunk sends on the earliest only. Shards follow the size of the input.
    """
    if length < Q + 8:
        raise ValueError(f"length must be {Q + 8} or more")
    slim = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = max(8, -(-size // BLOCK)), max(64, -(-size // SHARD))
    docs_of = slim.withColumn("block", F.pmod(F.col("text_hash").bitwiseXOR(F.coalesce("doc_id", F.lit(LAST))), F.lit(blocks)))
    asked = docs_of.groupBy("block").applyInArrow(_ask(length, shards), "shard long, block long, once binary, several binary")
    answers = asked.groupBy("shard").applyInArrow(_answer, "block long, shard long, shared binary")
    pieces = docs_of.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_cut_block(length, shards, blocks), _STEP)
    found = pieces.groupBy("kind", "bucket").applyInArrow(_meet(length, blocks), "bucket long, data binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start:long,end:long>>" * kept
    return docs_of.groupBy("block").cogroup(found.groupBy("bucket")).applyInArrow(_remove(length, kept), schema)
