"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays; the lowest cross-entropy wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import id_and_text, stored
from leadloom.llm.quality import crc_mod

ORDER = 4
UNKNOWN = "und"
#: Characters of a batch that are looked up at once.
CHUNK = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so multiplication is a bijection: equal hashes are equal n-grams
_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def symbols(text: str) -> np.ndarray:
    """A text as lower-case letters (16 bits; others beyond the basic plane count as one symbol), with one 0 for
    each run of anything else. At the start stand three zeros and at the end one."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    far = codes > 0xFFFF
    if far.any():
        codes = np.where(far, np.where([chr(c).isalpha() for c in codes.tolist()], 0xFFFF, 0), codes)
        letter = _LETTER[codes] | (codes == 0xFFFF)
    else:
        letter = _LETTER[codes]
    plain = np.where(letter, codes, 0).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([np.zeros(ORDER - 1, np.uint64), plain[keep], np.zeros(int(bool(len(letter) and letter[-1])), np.uint64)])


def grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams of ORDER symbols, the last symbol in the lowest 16 bits."""
    if len(codes) < ORDER:
        return np.zeros(0, np.uint64)
    return (codes[:-3] << np.uint64(48)) | (codes[1:-2] << np.uint64(32)) | (codes[2:-1] << np.uint64(16)) | codes[3:]


class SortedTable:
    """Values by n-gram: hashes in sorted order, found by binary search."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        hashes = keys * _MIX
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], [v[order] for v in values]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hits)"""
        if not len(self.hashes):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        hashes = keys * _MIX
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


class KneserNey:
    """Interpolated Kneser-Ney model of one language, from counts of ORDER-grams.

    Lower orders count the distinct symbols before an n-gram; each order has its own discount n1 / (n1 + 2 n2).
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        self.alphabet, self.tables, self.contexts, self.discounts = alphabet, {}, {}, {}
        for order in range(ORDER, 0, -1):
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5
            self.discounts[order] = d
            self.tables[order] = SortedTable(keys, counts.astype(np.float64))
            context, where, kinds = np.unique(keys >> np.uint64(16), return_inverse=True, return_counts=True)
            total = np.bincount(where, counts, len(context)) if len(keys) else np.zeros(0)
            self.contexts[order] = SortedTable(context, total, kinds.astype(np.float64))
            mask = np.uint64((1 << (16 * (order - 1))) - 1)
            keys, counts = np.unique(keys & mask, return_counts=True)

    def probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        if not order:
            return np.full(len(keys), 1 / self.alphabet)
        lower = self.probability(keys & np.uint64((1 << (16 * (order - 1))) - 1), order - 1)
        at, known = self.contexts[order].find(keys >> np.uint64(16))
        here, seen = self.tables[order].find(keys)
        if not len(self.contexts[order].hashes):
            return lower
        total, kinds = (v[at] for v in self.contexts[order].values)
        count = np.where(seen, self.tables[order].values[0][here], 0.0)
        d = self.discounts[order]
        return np.where(known, (np.maximum(count - d, 0) + d * kinds * lower) / total, lower)


class LanguageModel:
    """All languages' models; the log probabilities of all n-grams seen in any are kept ready in one table."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        every = [k for k, _ in counts.values()]
        keys = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        alphabet = len(np.unique(keys & np.uint64(0xFFFF))) + 1
        self.models = [KneserNey(*counts[x], alphabet) for x in self.languages]
        ready = np.array([np.log(m.probability(keys)) for m in self.models]).T.reshape(len(keys), len(self.languages))
        self.table = SortedTable(keys, ready)
        self.limits = np.full(len(self.languages), np.inf)

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        at, hit = self.table.find(keys)
        if not len(self.table.hashes):
            return np.zeros((len(keys), 0))
        out = self.table.values[0][at]
        if not hit.all():
            rare, back = np.unique(keys[~hit], return_inverse=True)
            out[~hit] = np.array([np.log(m.probability(rare)) for m in self.models]).T[back]
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per symbol in each language, number of symbols) of each whole text."""
        sums = np.zeros((len(texts), len(self.languages)))
        lengths = np.zeros(len(texts), np.int64)
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def add():
            rows = self.log_probabilities(np.concatenate([g for _, g in held]))
            starts = np.cumsum([0, *(len(g) for _, g in held[:-1])])
            np.add.at(sums, [i for i, _ in held], np.add.reduceat(rows, starts))

        for i, text in enumerate(texts):
            own = grams(symbols(text))
            lengths[i] = len(own)
            for start in range(0, len(own), CHUNK):
                held.append((i, own[start : start + CHUNK]))
                size += len(held[-1][1])
                if size >= CHUNK:
                    add()
                    held, size = [], 0
        if held and self.languages:
            add()
        return -sums / np.maximum(lengths, 1)[:, None], lengths

    def predict(self, texts: list[str]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text.

        No letter: ``und`` and score 0. score is the winner's share of exp(-sharpness * cross-entropy), surer with
        length; rejected says that even the best entropy is beyond what its language showed in calibration.
        """
        entropy, lengths = self.cross_entropies(texts)
        letters = [bool(n) and any(c.isalpha() for c in t) for t, n in zip(texts, lengths)]
        if not self.languages:
            return [(UNKNOWN, 0.0, None, True)] * len(texts)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(texts)), best]
        sharp = np.minimum(lengths, 40)[:, None] * 0.5
        score = 1 / np.exp(-np.clip((entropy - low[:, None]) * sharp, 0, 700)).sum(axis=1)
        return [
            (self.languages[best[i]], float(score[i]), float(low[i]), bool(low[i] > self.limits[best[i]])) if ok else (UNKNOWN, 0.0, None, True)
            for i, ok in enumerate(letters)
        ]

    def calibrate(self, entropies: dict[str, list[float]], level: float = 0.999, margin: float = 0.2) -> None:
        """Rejection limit of each language: a quantile of its own training texts' entropies and a margin."""
        self.limits = np.array([np.quantile(entropies[x], level) + margin if entropies.get(x) else np.inf for x in self.languages])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            held.setdefault(lang, []).append(grams(symbols(text)))
        for lang, parts in held.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def nth_smallest(dice: DataFrame, n: int, bits: int = 14) -> DataFrame:
    """lang, cut: the n-th smallest dice of each language, or its largest where it has fewer.

    Rows are counted by the first bits of their dice, so only the rows of one such bucket are ranked for a language.
    """
    bucket = F.shiftright("dice", 64 - bits)
    counted = dice.groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("held"), F.max("dice").alias("last"))
    upto = counted.withColumn("upto", F.expr("sum(held) over (partition by lang order by bucket)"))
    closing = upto.groupBy("lang").agg(
        F.min(F.when(F.col("upto") >= n, F.struct("bucket", (F.col("upto") - F.col("held")).alias("base")))).alias("b"), F.max("last").alias("last")
    )
    closing = closing.select(F.col("lang").alias("_lang"), "b.bucket", "b.base", "last")
    rows = dice.join(closing, (F.col("lang") == F.col("_lang")) & (bucket == F.col("bucket")))
    ranked = rows.withColumn("place", F.expr("base + row_number() over (partition by lang order by dice)")).where(F.col("place") == n)
    found = ranked.select(F.col("lang").alias("_found"), "dice")
    return closing.join(found, F.col("_lang") == F.col("_found"), "left").select(F.col("_lang").alias("lang"), F.coalesce("dice", "last").alias("cut"))


def train_languages(docs: DataFrame, per_language: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Model from at most ``per_language`` documents of each language (the bound), the first by hash of id and text.

    Rows without language and rows whose crc32(id as text) mod 3 is 1 are not learned from. The n-grams are counted
    in tasks and summed by Spark; the driver gets the sums over the bounded sample.
    """
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where("lang is not null and text is not null").where(crc_mod("doc_id", 3) != 1)
    dice = known.select("lang", F.xxhash64("doc_id", "text").alias("dice"))
    cuts = {r["lang"]: r["cut"] for r in nth_smallest(stored(dice, "dice"), per_language).collect()}
    if not cuts:
        return LanguageModel({})
    within = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
    sample = known.where(F.xxhash64("doc_id", "text") <= F.try_element_at(within, "lang")).select("lang", "text")
    summed = sample.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = summed.toArrow()
    langs, keys, n = np.array(table["lang"].to_pylist(), object), table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
    counts = {}
    for x in cuts:
        own = np.flatnonzero(langs == x)
        order = own[np.argsort(keys[own])]
        counts[x] = (keys[order], n[order])
    model = LanguageModel(counts)
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, _ = packed.value.cross_entropies(b.column("text").to_pylist())
            own = [packed.value.languages.index(x) for x in b.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(e[np.arange(len(own)), own])], names=["lang", "e"])

    found: dict[str, list[float]] = {}
    for r in sample.mapInArrow(entropies, "lang string, e double").collect():
        found.setdefault(r["lang"], []).append(r["e"])
    model.calibrate(found)
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, cross_entropy, rejected, from the whole text.

    Null texts and texts without letters are ``und`` with score 0. Ties go to the first language by name. The model
    follows the bounded sample and is a broadcast. Row-local: repeated rows give a row each, an empty table none.
    """
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
        for b in batches:
            rows = packed.value.predict(b.column("text").to_pylist())
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")
