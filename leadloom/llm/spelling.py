"""Spelling variant grouping: a trie of letter-group counts, searched with a surplus and a deficit of one each."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import id_and_text, stored

#: Letter groups, one trie level each; the last level counts every other letter.
GROUPS = ("e", "t", "a", "o", "i", "n", "s", "h", "r", "dl", "cum", "wfgypb", "vkjxqz")
LEVELS = len(GROUPS) + 1
_GROUP_OF = np.full(256, len(GROUPS), np.uint8)
for _i, _letters in enumerate(GROUPS):
    _GROUP_OF[list(_letters.encode())] = _i

#: The first levels deal the trie out: a shard holds the words that agree in these counts.
TOP = 4
#: Words of a shard that one task indexes, and words that it looks up in them.
INDEXED, ASKED = 20_000, 60_000
WIDE = 64
_HELD, _HELD_BYTES = 250_000, 1 << 26

#: Latin-1: letters stay (A-Z lower-cased), all else separates.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256)
)


def altered(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of a document (Latin-1 bytes); where 199 divides the crc32 h of ``<doc_id>:<word>``, its letter h % length goes."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    crc, out = zlib.crc32, []
    for w in words:
        h = crc(w if w.isascii() else w.decode("latin-1").encode(), start)
        if not h % 199:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        out.append(w)
    return out


def _counted(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        seen = 0

        def out() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
                for w, n in zip(altered(doc_id, list(own)), own.values()):
                    if len(w) >= least:
                        total[w] += n
                seen += len(text)
                if len(total) > _HELD or seen > _HELD_BYTES:
                    yield out()
                    total.clear()
                    seen = 0
        if total:
            yield out()

    return run


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n (long): the distinct words of all texts, counted inside each task before the shuffle."""
    found = id_and_text(docs, id_col, text_col).mapInArrow(_counted(least_length), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def vectors(words: list[bytes]) -> np.ndarray:
    """Letter-group counts, a row for each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = _GROUP_OF[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    return np.bincount(owner * LEVELS + letters, minlength=len(words) * LEVELS).reshape(-1, LEVELS).astype(np.int32)


def reachable(top: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The shards where a word looks for others: its own, and smaller ones within a surplus and a deficit of one.

    A pair of words in two shards is met from the larger shard only, so that it is found once.
    """
    found = [top]
    steps = [None, *range(len(top))]
    for more in steps:
        for less in steps:
            if more == less:
                continue
            t = list(top)
            if more is not None:
                t[more] += 1
            if less is not None:
                t[less] -= 1
            if tuple(t) < top and min(t) >= 0:
                found.append(tuple(t))
    return found


def _key(top) -> str:
    return ".".join(map(str, top))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A word's own shard, and all the shards where it is looked up."""
    for b in batches:
        words = [w.encode("latin-1") for w in b.column("word").to_pylist()]
        tops = vectors(words)[:, :TOP].tolist()
        known: dict[tuple, list[str]] = {}
        for t in map(tuple, tops):
            if t not in known:
                known[t] = [_key(x) for x in reachable(t)]
        yield pa.RecordBatch.from_arrays(
            [b.column("word"), b.column("n"), pa.array([_key(t) for t in tops], pa.string()), pa.array([known[tuple(t)] for t in tops], pa.list_(pa.string()))],
            names=["word", "n", "shard", "shards"],
        )


def search(index: np.ndarray, asked: np.ndarray, small: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of asked, of index) whose counts differ by a surplus of at most one and a deficit of at most one.

    index is sorted by its columns, which makes it a trie: a node is a range of rows that agree in the first columns.
    The depth-first search carries down the asked rows that still fit, with what each has spent of its budget;
    small subtrees are compared at once.
    """
    every = np.arange(len(asked))
    stack = [(0, 0, len(index), every, np.zeros(len(asked), bool), np.zeros(len(asked), bool))]
    while stack:
        level, low, high, q, more, less = stack.pop()
        if not len(q) or low == high:
            continue
        if level == LEVELS or high - low <= 8 or (high - low) * len(q) <= small:
            rest, step = index[low:high, level:], max(1, 400_000 // ((high - low) * max(1, LEVELS - level)))
            for i in range(0, len(q), step):
                part = slice(i, i + step)
                d = rest[None, :, :] - asked[q[part], None, level:]
                up, down = np.maximum(d, 0).sum(axis=2), np.maximum(-d, 0).sum(axis=2)
                a, b = np.nonzero((up + more[part, None] <= 1) & (down + less[part, None] <= 1))
                if len(a):
                    yield q[part][a], low + b
            continue
        column = index[low:high, level]
        cuts = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), high - low]
        own = asked[q, level]
        for start, end in zip(cuts, cuts[1:]):
            d = column[start] - own
            fits = (d == 0) | ((d == 1) & ~more) | ((d == -1) & ~less)
            if fits.any():
                d = d[fits]
                stack.append((level + 1, low + start, low + end, q[fits], more[fits] | (d == 1), less[fits] | (d == -1)))


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether exactly one letter inserted, deleted or replaced leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)
    while low < high:  # the longest common start
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def _matrix(words: list[bytes], width: int) -> np.ndarray:
    """Letters by place, padded with at least one zero; only the first WIDE letters of longer words."""
    return np.array([w[: width - 1] for w in words], f"S{width}").view(np.uint8).reshape(len(words), width)


def verified(left: list[bytes], right: list[bytes]):
    """A function that tells which of the pairs (left[a], right[b]) are one letter apart, many at once.

    Words over WIDE letters are compared one by one.
    """
    ls, lt = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
    width = min(int(max(ls.max(initial=0), lt.max(initial=0))), WIDE) + 1
    s, t = _matrix(left, width), _matrix(right, width)

    def shifted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
        """One letter more: unlike places end, when shifted, before they begin unshifted."""
        first = (short != long).argmax(axis=1)
        off = short[:, :-1] != long[:, 1:]
        return np.where(off.any(axis=1), width - 2 - off[:, ::-1].argmax(axis=1), -1) < first

    def check(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, gap = np.zeros(len(a), bool), lt[b] - ls[a]
        long = (ls[a] > WIDE) | (lt[b] > WIDE)
        out[long] = [one_apart(left[i], right[j]) for i, j in zip(a[long], b[long])]
        for kind, test in (
            (0, lambda x, y: (x != y).sum(axis=1) == 1),
            (1, shifted),
            (-1, lambda x, y: shifted(y, x)),
        ):
            at = np.flatnonzero(~long & (gap == kind))
            if len(at):
                out[at] = test(s[a[at]], t[b[at]])
        return out

    return check


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _near(table: pa.Table) -> pa.Table:
    """Of one piece of a shard and the words that look there: per word a count, the largest near n and its word."""
    role = np.array(table.column("asked").to_pylist(), bool)
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    n, own = table.column("n").to_numpy(), np.array(table.column("own").to_pylist(), bool)
    index, asked = np.flatnonzero(~role), np.flatnonzero(role)
    names, counts, best_n, best = [], [], [], []
    if len(index) and len(asked):
        x = vectors([words[i] for i in index])
        order = np.lexsort(x.T[::-1])
        index, x = index[order], x[order]
        left, right = [words[i] for i in asked], [words[i] for i in index]
        near, pairs = verified(left, right), []
        for p, q in _gathered(search(x, vectors(left))):
            hit = near(p, q)
            pairs.append((asked[p[hit]], index[q[hit]]))
        if pairs:
            u, v = (np.concatenate(z) for z in zip(*pairs))
            met = ~own[u] | np.fromiter((words[i] > words[j] for i, j in zip(u, v)), bool, len(u))  # once in its own shard
            u, v = np.concatenate([u[met], v[met]]), np.concatenate([v[met], u[met]])
            place = {w: i for i, w in enumerate(sorted({words[i] for i in np.unique(v)}))}
            rank = np.fromiter((place[words[i]] for i in v), np.int64, len(v))
            first = np.lexsort((rank, -n[v], u))
            u, v = u[first], v[first]
            start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
            names, best = [words[i].decode("latin-1") for i in u[start]], [words[i].decode("latin-1") for i in v[start]]
            counts, best_n = np.diff(np.r_[start, len(u)]), n[v[start]]
    return pa.table({"word": pa.array(names, pa.string()), "n_near": pa.array(counts, pa.int64()), "best_n": pa.array(best_n, pa.int64()), "best": pa.array(best, pa.string())})


def near_words(counts: DataFrame) -> DataFrame:
    """word, n_near, best_n, best of every word that has a near one; best is the near word of largest n, then the smallest.

    Shards with many words are dealt out as pieces, the words that look there as blocks; a block meets every piece, so
    a task holds at most INDEXED and about ASKED words whatever the shard's size. Only a count and the best near word
    leave a task for each word.
    """
    placed = stored(counts.mapInArrow(_placed, "word string, n long, shard string, shards array<string>"), "spelling")
    asked = placed.select("word", "n", F.explode("shards").alias("key"), "shard").select("word", "n", "key", (F.col("key") == F.col("shard")).alias("own"))
    blocks = lambda c, most: F.ceil(F.count("*") / F.lit(most)).cast("long").alias(c)
    sizes = placed.groupBy(F.col("shard").alias("key")).agg(blocks("pieces", INDEXED))
    sizes = stored(sizes.join(asked.groupBy("key").agg(blocks("blocks", ASKED)), "key"), "shards")
    spot = lambda c: F.pmod(F.xxhash64("word"), F.col(c))
    many = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    indexed = placed.select("word", "n", F.col("shard").alias("key")).join(sizes, "key")
    indexed = indexed.select("word", "n", "key", F.lit(True).alias("own"), F.lit(False).alias("asked"), spot("pieces").alias("piece"), many("blocks").alias("block"))
    asked = asked.join(sizes, "key").select("word", "n", "key", "own", F.lit(True).alias("asked"), many("pieces").alias("piece"), spot("blocks").alias("block"))
    met = indexed.unionByName(asked).groupBy("key", "piece", "block").applyInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of every word with ``least_length`` letters and ``least_count`` occurrences.

    A word's form is its near word of largest n (ties: the smallest) if that is at least ``times`` the word's n; root
    follows the forms to the last. As n grows by ``times`` each step, chains are short: their bound follows from the
    largest n, and pointer jumping takes the logarithm of it in joins. Null texts have no words, a null id reads as an
    empty one, repeated rows count again, an empty table gives an empty result.
    """
    counts = stored(word_counts(docs, least_length, least_count, id_col, text_col), "words")
    near = near_words(counts)
    known = counts.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best_n") >= times * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= times * F.col("n"), F.col("best_n")).alias("form_n"),
    )
    known = stored(known, "near")
    links = known.where("form is not null").select("word", F.col("form").alias("root"))
    most = counts.agg(F.max("n")).first()[0] or 1
    steps = math.log(max(most / least_count, 1)) / math.log(times) + 1
    for _ in range(math.ceil(math.log2(steps + 1))):
        ahead = links.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        links = stored(links.join(ahead, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root")), "roots")
    return known.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
