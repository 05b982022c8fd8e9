"""Quality rules: zstandard ratios of whole texts and fixed chunks must lie in bands that depend on the length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import as_bytes, id_and_text


@dataclass(frozen=True)
class Bands:
    """Limits of compressed/raw bytes. whole: (least bytes, lowest ratio, highest ratio), the last that fits counts.

    Below the first length (128 bytes) no ratio is judged. Longer texts than one chunk are judged by chunks of ``chunk``
    bytes as well (where a quarter of a chunk or more is left, the last ``chunk`` bytes are one, too): ``chunks`` has
    their limits by length of the text, and a text fails if more than ``odd_share`` of its chunks are outside.
    These limits are wide; ``fit_bands`` draws them to a corpus.
    """

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.40, 1.05), (256, 0.42, 0.90), (512, 0.40, 0.82), (1024, 0.37, 0.75), (2048, 0.34, 0.70),
        (4096, 0.30, 0.66), (16384, 0.26, 0.62), (65536, 0.22, 0.60), (262144, 0.18, 0.60),
    )
    chunk: int = 4096
    chunks: tuple[tuple[int, float, float], ...] = ((4096, 0.30, 0.72),)
    odd_share: float = 0.25


WIDE = Bands()
_SYMBOLS, _SPACE, _TAILS = b"#*$%&|<>", b" \t\n\x0b\x0c\r", bytes(range(0x80, 0xC0))


def base_numbers(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    gone = lambda chars: len(text) - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x.split()]
    chars = len(text) - gone(_TAILS) - gone(_SPACE)
    return len(words), chars, gone(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more, the first place included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = np.unique(codes[:-1] * len(number) + codes[1:], return_inverse=True)[1]
    _, which, count = np.unique(pairs[:-1] * len(number) + codes[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= again
    return int(hit.sum())


def compressor(level: int):
    return zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False).compress


def base_failed(numbers: tuple) -> bool:
    return numbers[0] < 50 or 100 * numbers[4] > 50 * numbers[0]


def ratios(text: bytes, bands: Bands, compress) -> tuple[float, list[float]]:
    """Compressed/raw of a text that is not empty, and of each of its chunks."""
    size = bands.chunk
    parts = [text[i : i + size] for i in range(0, len(text) - size + 1, size)] if len(text) > size else []
    if parts and 4 * (len(text) % size) >= size:
        parts.append(text[-size:])
    return len(compress(text)) / len(text), [len(compress(p)) / size for p in parts]


def limits_of(length: int, limits: tuple[tuple[int, float, float], ...]) -> tuple[float, float]:
    fits = [(low, high) for least, low, high in limits if length >= least]
    return fits[-1] if fits else (0.0, float("inf"))


def verdict(text: bytes, bands: Bands, compress) -> tuple[float | None, float, bool]:
    """(ratio of the whole text, share of odd chunks, whether the bands hold)."""
    if not text:
        return None, 0.0, True
    ratio, parts = ratios(text, bands, compress)
    low, high = limits_of(len(text), bands.whole)
    least, most = limits_of(len(text), bands.chunks)
    share = sum(not least <= p <= most for p in parts) / len(parts) if parts else 0.0
    return ratio, share, low <= ratio <= high and share <= bands.odd_share


#: How far limits lie from the median, in distances to the quartile below resp. above, and the least such distance.
WHOLE_SPREAD, CHUNK_SPREAD = (4.0, 12.0, 0.007), (6.0, 12.0, 0.004)
#: Ratios are counted in steps of 1/GRID, so that quartiles of any number of rows come from a bounded table of counts.
GRID = 100_000


def drawn(quartiles: list[float], spread: tuple[float, float, float]) -> tuple[float, float]:
    """Limits from the quartiles, so that they hold while under a quarter of the rows is odd."""
    low, mid, high = quartiles
    return float(mid - spread[0] * max(mid - low, spread[2])), float(mid + spread[1] * max(high - mid, spread[2]))


def fitted(found: dict[tuple[str, int], tuple[int, list[float]]], bands: Bands = WIDE, least: int = 40) -> Bands:
    """Bands from (rows, quartiles) by (whole or chunks, length class), for each doubling of the length.

    A length with fewer than ``least`` rows keeps its wide limits, and takes for its chunks those of all lengths
    (length class 0).
    """
    if not found:
        return bands
    whole = {s: q for (kind, s), (n, q) in found.items() if kind == "whole" and n >= least}
    chunks = {s: q for (kind, s), (n, q) in found.items() if kind == "chunks" and s in whole}
    steps = sorted({*(s for kind, s in found if kind == "whole"), *(s for s, _, _ in bands.whole)})
    n, every = found.get(("chunks", 0), (0, []))
    some = drawn(every, CHUNK_SPREAD) if n >= 3 * least else limits_of(bands.chunk, bands.chunks)
    return replace(
        bands,
        whole=tuple((s, *(drawn(whole[s], WHOLE_SPREAD) if s in whole else limits_of(s, bands.whole))) for s in steps),
        chunks=tuple((s, *(drawn(chunks[s], CHUNK_SPREAD) if s in chunks else some)) for s in steps if s >= bands.chunk),
    )


_NUMBERS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64()}
_MEASURES = {**_NUMBERS, "base_failed": pa.bool_(), "size": pa.int64(), "mark": pa.int64(), "ratio": pa.float64(), "parts": pa.list_(pa.float64()), "quartiles": pa.list_(pa.float64())}
_MEASURED = ", ".join(f"{n} long" for n in ("doc_id", *_NUMBERS)) + ", base_failed boolean, size long, mark long, ratio double, parts array<double>, quartiles array<double>"


def measure(docs: DataFrame, bands: Bands = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, in one pass over whole texts: base numbers, base_failed, size in bytes, ratio of the whole
    text (null: empty), ratios of its chunks; mark (64-bit hash of the five words with the smallest crc32) and the quartiles of the chunks' ratios, null where base_failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, digest = compressor(bands.level), xxhash.xxh64_intdigest
        for b in batches:
            rows = []
            for t in as_bytes(b, "text"):
                numbers = base_numbers(t)
                failed = base_failed(numbers)
                ratio, parts = ratios(t, bands, compress) if t else (None, [])
                mark = middle = None
                if not failed:
                    middle = np.quantile(parts, [0.25, 0.5, 0.75]).tolist() if parts else None
                    words = t.split()
                    mark = digest(min((b" ".join(words[i : i + 5]) for i in range(len(words) - 4)), key=zlib.crc32)) - (1 << 63)
                rows.append((*numbers, failed, len(t), mark, ratio, parts, middle))
            columns = list(zip(*rows)) if rows else [[]] * len(_MEASURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, _MEASURES.values()))], names=["doc_id", *_MEASURES])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _MEASURED)


def bands_of(measured: DataFrame, bands: Bands = WIDE) -> Bands:
    """Bands of a corpus out of all its measured rows (``measure``).

    Every text that passes the base rules counts, of copies and near copies (same mark) one. The
    quartiles of a length class come from counts of the ratios in steps of 1/GRID; a long text counts in the chunk
    ratios with its three quartiles. A few rows reach the driver; an empty table leaves the bands as they are.
    """
    rows = measured.where("not base_failed").select("mark", "size", "ratio", F.col("quartiles").alias("chunks"))
    one = rows.groupBy("mark").agg(F.min(F.struct("size", "ratio", "chunks")).alias("r")).select("r.*").where("size >= 128")
    step = F.greatest(F.lit(128), F.expr("shiftleft(1L, int(length(bin(size))) - 1)")).cast("long")
    row = lambda kind, at, value: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("step"), value.alias("value"))
    parts = F.flatten(F.transform("chunks", lambda v: F.array(row("chunks", step, v), row("chunks", F.lit(0), v))))
    whole = F.array(row("whole", step, F.col("ratio")))
    values = F.when(F.col("chunks").isNull(), whole).otherwise(F.concat(whole, parts))
    counts = one.select(F.explode(values).alias("v")).groupBy("v.kind", "v.step", F.round(F.col("v.value") * GRID).cast("long").alias("at")).agg(F.count("*").alias("n"))
    quartiles = counts.groupBy("kind", "step").agg(F.sum("n").alias("n"), F.percentile("at", [0.25, 0.5, 0.75], F.col("n")).alias("q"))
    return fitted({(r["kind"], r["step"]): (r["n"], [x / GRID for x in r["q"]]) for r in quartiles.collect()}, bands)


def fit_bands(docs: DataFrame, bands: Bands = WIDE, rows: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> Bands:
    """Bands of the corpus from all its documents (``bands_of``). ``rows`` asks for no more than so many, the first by
    hash of the id."""
    if rows is not None:
        ids = docs.select(F.col(id_col).cast("long").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows)
        docs = id_and_text(docs, id_col, text_col).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi")
        id_col, text_col = "doc_id", "text"
    return bands_of(measure(docs, bands, id_col, text_col), bands)


def _limits(size: Column, limits: tuple[tuple[int, float, float], ...]) -> tuple[Column, Column]:
    low, high = F.lit(0.0), F.lit(float("inf"))
    for least, a, b in sorted(limits):
        low, high = F.when(size >= least, a).otherwise(low), F.when(size >= least, b).otherwise(high)
    return low, high


def judged(measured: DataFrame, bands: Bands = WIDE) -> DataFrame:
    """One row per measured document: base numbers, base_failed, kept, ratio of the whole text, share of odd chunks."""
    size = F.col("size")
    (low, high), (least, most) = _limits(size, bands.whole), _limits(size, bands.chunks)
    odd = F.size(F.filter("parts", lambda p: (p < least) | (p > most)))
    share = F.when(F.size("parts") > 0, odd / F.size("parts")).otherwise(0.0)
    inside = F.coalesce(F.col("ratio").between(low, high), F.lit(True)) & (share <= bands.odd_share)
    return measured.select("doc_id", *_NUMBERS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "ratio", share.alias("odd_chunks"))


def quality_rules(docs: DataFrame, bands: Bands = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base numbers, base_failed, kept, ratio of the whole text, share of odd chunks.

    base_failed: under 50 words, or over half of the words repeated; kept also asks for the bands. A null text counts
    as empty (no words, base_failed, null ratio). Row-local: repeated rows give a row each, an empty table none.
    """
    return judged(measure(docs, bands, id_col, text_col), bands)
