"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy, calibrated by language."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import id_and_text, stored
from leadloom.llm.quality import crc_mod

BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
HEAD = FILTERS * len(WIDTHS)
_MASK = BUCKETS - 1
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))
#: Words of a text that are looked at together, and distinct words whose vectors a task keeps.
CHUNK, KEPT = 8192, 200_000
#: Languages told apart for the calibration, the most frequent ones.
LANGUAGES = 32


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters (lower-cased) and of all that is not ASCII, as UTF-8 bytes."""
    return text.encode().translate(_LETTERS).split()


def buckets(word: bytes) -> list[int]:
    """Hashed pieces of a word: itself, its beginnings of three to six bytes, its ends of three and four."""
    crc, n = zlib.crc32, len(word)
    found = [crc(word, 1) & _MASK]
    if n >= 3:
        h = crc(word[:3], 2)
        found += [h & _MASK, crc(word[-3:], 3) & _MASK]
        for k in range(3, min(n, 6)):
            h = crc(word[k : k + 1], h)
            found.append(h & _MASK)
        if n >= 4:
            found.append(crc(word[-4:], 3) & _MASK)
    return found


def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words one after the other, where each word's begin)."""
    lists = [buckets(w) for w in words]
    starts = np.cumsum([0] + [len(x) for x in lists])[:-1]
    return np.fromiter((b for x in lists for b in x), np.int64), starts.astype(np.int64)


def mean_rows(table: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.r_[starts, len(flat)])
    return np.add.reduceat(table[flat], starts, axis=0) / sizes[:, None].astype(table.dtype)


@dataclass
class Network:
    """Embeddings, one kernel for each width (width, size, filters) with biases, output weights."""

    embeddings: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float = 0.0

    @classmethod
    def start(cls, evidence: np.ndarray, seed: int) -> Network:
        """Small random weights; the first place of an embedding starts with the evidence of its bucket."""
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.normal(0, 1, shape).astype(np.float32)
        table, kernels = draw(BUCKETS, SIZE) * 0.05, [draw(w, SIZE, FILTERS) * math.sqrt(1 / (w * SIZE)) for w in WIDTHS]
        table[:, 0] = evidence
        for k in kernels:
            k[:, 0] = np.abs(k[:, 0])
        return cls(table, kernels, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.abs(draw(HEAD)) * 0.3)


def evidence(texts: list[np.ndarray], labels: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per bucket how surely it stands in more toxic texts than clean ones: log odds over their standard error."""
    sizes, seen = np.diff(np.r_[starts, len(flat)]), np.zeros((2, BUCKETS))
    for t, y in zip(texts, labels):
        if len(t):
            seen[y, np.unique(np.concatenate([flat[starts[u] : starts[u] + sizes[u]] for u in np.unique(t)]))] += 1
    good, bad = (np.log((n + 0.5) / ((labels == y).sum() + 1)) for y, n in enumerate(seen))
    z = (bad - good) / np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
    return np.where(seen.sum(axis=0) > 0, np.clip(z, -5, 5), 0).astype(np.float32)


def responses(net: Network, vectors: np.ndarray) -> list[np.ndarray]:
    """Per width the answers of each kernel row to each word: (words, width, filters)."""
    return [np.einsum("nd,wdf->nwf", vectors, k, optimize=True) for k in net.kernels]


def pooled(answers: list[np.ndarray], words: np.ndarray, biases: list[np.ndarray], seen: int = 0, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Largest answer over all windows of a text, and where its window ends; windows hang over both ends of the text.

    Of a chunk that goes on (not last) or went before (``seen`` words of it stand in front again), only its own windows.
    """
    top, at = [], []
    for a, bias in zip(answers, biases):
        width = a.shape[1]
        windows = np.zeros((len(words) + width - 1, FILTERS), np.float32)
        for k in range(width):
            windows[width - 1 - k : width - 1 - k + len(words)] += a[words, k]
        windows = windows[seen : None if last else len(words)]
        place = windows.argmax(axis=0)
        top.append(windows[place, np.arange(FILTERS)] + bias)
        at.append(place)
    return np.concatenate(top), np.concatenate(at)


def train_network(texts: list[np.ndarray], labels: np.ndarray, flat: np.ndarray, starts: np.ndarray, epochs: int = 4, batch: int = 48, rate: float = 0.03, seed: int = 11) -> Network:
    """Adagrad on the logistic loss; half of each batch is toxic. texts: word numbers into (flat, starts).

    Only the windows that a text's pools picked carry a gradient, so a step costs little more than the forward pass.
    """
    net, r = Network.start(evidence(texts, labels, flat, starts), seed), np.random.default_rng(seed)
    bad, good = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    sizes = np.diff(np.r_[starts, len(flat)])
    seen = {id(x): np.full(x.shape, 1e-2, np.float32) for x in [net.embeddings, *net.kernels, *net.biases, net.out]}

    def descend(x: np.ndarray, g: np.ndarray, rows=slice(None)) -> None:
        s = seen[id(x)]
        s[rows] += g * g
        x[rows] -= rate * g / np.sqrt(s[rows])

    half, bias_seen = batch // 2, 1e-2
    for _ in range(epochs):
        order = r.permutation(good)
        steps = max(1, math.ceil(len(good) / half))
        for step in range(steps):
            clean = order[step * half : (step + 1) * half]
            chosen = np.r_[clean, r.choice(bad, half)]
            used = np.unique(np.concatenate([texts[i] for i in chosen]))
            parts = np.concatenate([flat[starts[u] : starts[u] + sizes[u]] for u in used])
            begin = np.cumsum(np.r_[0, sizes[used]])[:-1]
            vectors = mean_rows(net.embeddings, parts, begin)
            answers = responses(net, vectors)
            local = [np.searchsorted(used, texts[i]) for i in chosen]
            raw, at = (np.array(z) for z in zip(*(pooled(answers, t, net.biases) for t in local)))
            hidden = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.bias, -30, 30)))
            error = ((p - labels[chosen]) / len(chosen)).astype(np.float32)
            back = np.outer(error, net.out) * (raw > 0)
            g_out, g_words = hidden.T @ error + 1e-4 * net.out, np.zeros_like(vectors)
            for j, (width, kernel) in enumerate(zip(WIDTHS, net.kernels)):
                own = back[:, j * FILTERS : (j + 1) * FILTERS]
                place = at[:, j * FILTERS : (j + 1) * FILTERS] - (width - 1)
                g_kernel = np.zeros_like(kernel)
                for k in range(width):
                    where = place + k
                    word = np.array([[t[x] if 0 <= x < len(t) else -1 for x in row] for t, row in zip(local, where)])
                    doc, f = np.nonzero((word >= 0) & (own != 0))
                    w, g = word[doc, f], own[doc, f]
                    np.add.at(g_kernel[k].T, f, g[:, None] * vectors[w])
                    np.add.at(g_words, w, g[:, None] * kernel[k].T[f])
                descend(net.biases[j], own.sum(axis=0))
                descend(kernel, g_kernel + 1e-5 * kernel)
            moved = np.flatnonzero(np.abs(g_words).sum(axis=1))
            if len(moved):
                share = np.repeat(g_words[moved] / sizes[used[moved]][:, None].astype(np.float32), sizes[used[moved]], axis=0)
                rows, which = np.unique(np.concatenate([flat[starts[u] : starts[u] + sizes[u]] for u in used[moved]]), return_inverse=True)
                g = np.zeros((len(rows), SIZE), np.float32)
                np.add.at(g, which, share)
                descend(net.embeddings, g, rows)
            descend(net.out, g_out)
            bias_seen += float(error.sum()) ** 2
            net.bias -= rate * float(error.sum()) / math.sqrt(bias_seen)
    return net


@dataclass
class ToxicityModel:
    """score = sigmoid(slope * (network's answer - threshold of the text's language) + logit(at)).

    The language of a text is told from its words alone (``profiles``: log shares of hashed words by language), never
    from a column.
    """

    net: Network
    languages: list[str] = field(default_factory=list)
    profiles: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))
    slope: float = 1.0
    at: float = 0.3

    def reader(self) -> Reader:
        return Reader(self)

    def scores(self, raw: np.ndarray, lang: np.ndarray) -> np.ndarray:
        z = self.slope * (raw - self.thresholds[lang]) + math.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Reader:
    """Answers of a model to whole texts, chunk by chunk; vectors of words are kept for the next texts."""

    def __init__(self, model: ToxicityModel):
        self.model, self.place, self.rows = model, {}, 0
        self.tables = [np.zeros((0, w, FILTERS), np.float32) for w in WIDTHS]
        self.langs = np.zeros((0, model.profiles.shape[1]), np.float32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > KEPT:
            self.__init__(self.model)
        new = list(set(words).difference(self.place))
        if new:
            flat, starts = pieces(new)
            answers = responses(self.model.net, mean_rows(self.model.net.embeddings, flat, starts))
            while self.rows + len(new) > len(self.langs):  # room for twice as many
                grow = max(4096, len(self.langs), len(new))
                self.tables = [np.concatenate([t, np.zeros((grow, *t.shape[1:]), np.float32)]) for t in self.tables]
                self.langs = np.concatenate([self.langs, np.zeros((grow, self.langs.shape[1]), np.float32)])
            for t, a in zip(self.tables, answers):
                t[self.rows : self.rows + len(new)] = a
            self.langs[self.rows : self.rows + len(new)] = self.model.profiles[flat[starts]]
            self.place.update(zip(new, range(self.rows, self.rows + len(new))))
            self.rows += len(new)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def read(self, text: str) -> tuple[float, int]:
        """(answer of the network, number of the language; the last number for texts without words)."""
        words, net = words_of(text), self.model.net
        best, lang, none = np.full(HEAD, -np.inf, np.float32), np.zeros(self.langs.shape[1]), len(self.model.languages)
        over = max(WIDTHS) - 1
        for i in range(0, len(words), CHUNK):
            ids = self.numbers(words[max(0, i - over) : i + CHUNK])
            best = np.maximum(best, pooled(self.tables, ids, net.biases, min(i, over), i + CHUNK >= len(words))[0])
            lang += self.langs[ids[min(i, over) :]].sum(axis=0, dtype=np.float64)
        hidden = np.maximum(best, 0) if words else np.zeros(HEAD, np.float32)
        return float(hidden @ net.out + net.bias), int(lang.argmax()) if words and none else none


def language_profiles(texts: list[np.ndarray], langs: list[str | None], firsts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Log shares of hashed words by language; firsts: each word's own bucket."""
    count: dict[str, int] = {}
    for lang in langs:
        if lang is not None:
            count[lang] = count.get(lang, 0) + 1
    names = sorted(sorted(count, key=lambda k: (-count[k], k))[:LANGUAGES])
    found = np.full((BUCKETS, len(names)), 0.1)
    for t, lang in zip(texts, langs):
        if lang in names:
            np.add.at(found[:, names.index(lang)], firsts[t], 1 / max(1, len(t)))
    return names, np.log(found / found.sum(axis=0)).astype(np.float32)


def best_cut(raw: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap between answers among the cuts with the best balanced accuracy."""
    order = np.argsort(raw, kind="stable")
    v, t = raw[order], y[order]
    bad, good = max(1, int(t.sum())), max(1, int((1 - t).sum()))
    right = np.r_[0, np.cumsum(1 - t)] / good + (t.sum() - np.r_[0, np.cumsum(t)]) / bad
    edges = np.r_[v[0] - 1, v, v[-1] + 1]
    gaps = np.diff(edges)
    best = np.flatnonzero(right >= right.max() - 1e-9)
    k = best[gaps[best].argmax()]
    return float((edges[k] + edges[k + 1]) / 2)


def fit(rows: list[tuple[str, str | None, int]], at: float = 0.3, least: int = 20, **settings) -> ToxicityModel:
    """Model from (text, lang, label) rows in a seeded order; a quarter is kept back for the thresholds.

    A language with ``least`` toxic and clean rows kept back gets a threshold of its own, others the common one. With
    rows of one label only, every text scores below resp. above ``at``.
    """
    rows = [r for r in rows if words_of(r[0])]
    labels = np.array([r[2] for r in rows], np.int64)
    if not len(labels) or labels.min() == labels.max():
        net = Network.start(np.zeros(BUCKETS, np.float32), 0)
        net.out[:] = 0
        return ToxicityModel(net, thresholds=np.array([-1.0 if len(labels) and labels[0] else 1.0]), at=at)
    known: dict[bytes, int] = {}
    texts = [np.fromiter((known.setdefault(w, len(known)) for w in words_of(r[0])), np.int64) for r in rows]
    flat, starts = pieces(list(known))
    kept = np.zeros(len(rows), bool)
    for label in (0, 1):
        kept[np.flatnonzero(labels == label)[3::4]] = True
    learn = np.flatnonzero(~kept)
    net = train_network([texts[i] for i in learn], labels[learn], flat, starts, **settings)
    names, profiles = language_profiles([texts[i] for i in learn], [rows[i][1] for i in learn], flat[starts])
    model = ToxicityModel(net, names, profiles, np.zeros(len(names) + 1), 1.0, at)
    reader = model.reader()
    cal = np.flatnonzero(kept) if (labels[kept] == 1).any() and (labels[kept] == 0).any() else np.arange(len(rows))
    raw, lang = (np.array(z) for z in zip(*(reader.read(rows[i][0]) for i in cal)))
    y = labels[cal]
    model.thresholds[:] = best_cut(raw, y)
    for k in range(len(names)):
        own = lang == k
        if min(int((y[own] == 1).sum()), int((y[own] == 0).sum())) >= least:
            model.thresholds[k] = best_cut(raw[own], y[own])
    model.slope = 4 / max(float(raw.std()), 1e-6)
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 6000, most_chars: int = 18_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ToxicityModel:
    """Model from a bounded sample of labelled documents, taken in the order of a hash of the id.

    At most ``rows`` rows, of which up to half are toxic, and ``most_chars`` characters in all (a row beyond that
    is left out whole, no text is cut). Rows whose crc32(id as text) mod 4 is 2 are held out; null or contradictory
    labels are not learned from. lang serves only to group the rows whose thresholds are set.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("double").alias("_label"))
    known = known.where(F.col("_label").isin(0.0, 1.0) & (crc_mod("_id", 4) != 2))
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).where("_label = _other")
    ordered = lambda v, n: known.where(F.col("_label") == v).orderBy(F.xxhash64("_id"), "_id").limit(n).select("_id", "_label")
    chosen = ordered(1.0, rows // 2).unionByName(ordered(0.0, rows)).orderBy(F.desc("_label"), F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    joined = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    joined = joined.select("_doc", F.xxhash64("_doc").alias("_hash"), F.coalesce("_text", F.lit("")).alias("_text"), "_lang", F.col("_label").cast("int").alias("_label"))
    one = stored(joined.groupBy("_doc", "_hash", "_label").agg(F.min(F.struct("_text", "_lang")).alias("r")), "labelled")
    sizes = one.select("_hash", "_doc", F.length("r._text").alias("n")).collect()
    left, ids = most_chars, []
    for r in sorted(sizes):
        if r["n"] <= left:
            left -= r["n"]
            ids.append((r["_doc"],))
    bounded = docs.sparkSession.createDataFrame(ids, "_doc long")
    got = sorted(one.join(F.broadcast(bounded), "_doc").collect(), key=lambda r: (r["_hash"], r["_doc"]))
    return fit([(r["r"]["_text"], r["r"]["_lang"], r["_label"]) for r in got])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text (null: empty; a text without words scores by the biases alone). Row-local."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for b in batches:
            read = [reader.read(t) for t in b.column("text").to_pylist()]
            raw, lang = (np.array(z) for z in zip(*read)) if read else (np.zeros(0), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(raw, lang))], names=["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
