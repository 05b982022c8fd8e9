"""SimHash near-dedup: Golay codeword indices of fingerprint segments are the join keys, candidates are verified.

Near copies by shingle similarity (``near_dedup``) are pairs that meet by their fingerprints, and those beyond the three
bits that 64-bit fingerprints reach, which meet in bands of minima; all are verified by their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import as_bytes, connected_components, id_and_text, kept_rows, local_stars, stored

#: Widths of the three segments of a 64-bit fingerprint, each at most the 23 bits of a Golay word.
SEGMENTS = (22, 21, 21)
#: Fingerprints that one task compares at once; buckets with more are split into pairs of blocks.
BLOCK = 20_000

# --- fingerprints -----------------------------------------------------------------------------------------


def shingles(text: bytes, width: int = 3) -> list[bytes]:
    """Word shingles, repeats included; with fewer words the whole sequence, with none nothing."""
    words = text.lower().split()  # bytes: A-Z only; space and \t\n\v\f\r
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(w) for w in zip(*(words[i:] for i in range(width)))]


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash; a bit is set if it is set in over half of the shingles' hashes (no words: zero)."""
    parts = shingles(text, width)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, 42) for p in parts), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        block = hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, width) for t in as_bytes(b, "text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return run


# --- Golay code -------------------------------------------------------------------------------------------

#: Fixed value: generator polynomial of the binary Golay code of length 23 (x^11+x^10+x^6+x^5+x^4+x^2+1).
GENERATOR = 0b110001110101


def _parity(message: np.ndarray) -> np.ndarray:
    rest = message.astype(np.int64) << 11
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1 == 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


_PARITY = _parity(np.arange(4096))


def _corrections() -> np.ndarray:
    """Error pattern for each of the 2,048 syndromes; the code is perfect, so up to three errors fill them all."""
    table = np.zeros(2048, np.int64)
    for n in (1, 2, 3):
        for bits in combinations(range(23), n):
            error = sum(1 << b for b in bits)
            table[_PARITY[error >> 11] ^ (error & 2047)] = error
    return table


_ERROR = _corrections()


def syndrome(words: np.ndarray) -> np.ndarray:
    return _PARITY[words >> 11] ^ (words & 2047)


def codeword_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the only codeword within three bits of each 23-bit word."""
    return (words ^ _ERROR[syndrome(words)]) >> 11


def _nearby(width: int) -> np.ndarray:
    """For each syndrome, what to xor to a word's own 12 message bits to get the indices of the codewords that the
    word and its neighbours at one flipped bit decode to; padded by repeats. The code is linear, so the list
    depends on the syndrome alone."""
    lists = []
    for s in range(2048):
        word = np.array([s])  # message bits zero
        flips = word ^ np.concatenate([[0], 1 << np.arange(width)])
        own = codeword_index(word)[0]
        lists.append([own, *sorted(set(codeword_index(flips).tolist()) - {own})])
    most = max(map(len, lists))
    return np.array([x + x[:1] * (most - len(x)) for x in lists])


_NEARBY = {w: _nearby(w) for w in set(SEGMENTS)}


def segment_keys(words: np.ndarray, width: int) -> np.ndarray:
    """Codeword indices of each word, one row each; words at most one bit apart share at least one.

    A word decodes to its own index. Next to it lie at most five other codewords; of two neighbouring words with
    different indices, the one with the larger index also takes the smaller, so each row is its own index and the
    smaller ones nearby (others repeat the own index).
    """
    near = (words >> 11)[:, None] ^ _NEARBY[width][syndrome(words)]
    return np.where(near < near[:, :1], near, near[:, :1])


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, key) for all keys of distinct fingerprints.

    Three differing bits leave, beside the segment with most of them, two segments with at most one each
    (pigeonhole), so every pair of segments gives keys: its two indices together.
    """
    parts, shift = [], 0
    for w in SEGMENTS:
        parts.append(segment_keys(((fps >> np.uint64(shift)) & np.uint64((1 << w) - 1)).astype(np.int64), w))
        shift += w
    at, keys = [], []
    for n, (i, j) in enumerate(combinations(range(3), 2)):
        pair = (n << 24) | (parts[i][:, :, None] << 12) | parts[j][:, None, :]
        pair = np.sort(pair.reshape(len(fps), -1), axis=1)
        new = np.concatenate([np.ones((len(fps), 1), bool), pair[:, 1:] != pair[:, :-1]], axis=1)
        row, col = np.nonzero(new)
        at.append(row)
        keys.append(pair[row, col])
    return np.concatenate(at), np.concatenate(keys)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy()
        at, keys = golay_keys(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[at])], names=["key", "fp"])


# --- verification -----------------------------------------------------------------------------------------


def _spanning_edges(fps: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """A spanning forest of one bucket: each fingerprint found looks for others among those not yet reached."""
    rest, a, b = fps, [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            near = np.bitwise_count(rest ^ here) <= most
            if near.any():
                found = rest[near]
                rest = rest[~near]
                a += [int(here)] * len(found)
                b += found.tolist()
                queue += list(found)
    return a, b


def bucket_edges(group: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of rows sorted by group: all pairs of small groups, a spanning forest of larger ones."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    size = np.repeat(sizes, sizes)
    small, out = np.flatnonzero((size > 1) & (size <= 16)), []
    for step in range(1, 16):
        at = small[(small + step < len(group))]
        at = at[group[at] == group[np.minimum(at + step, len(group) - 1)]]
        if not len(at):
            break
        hit = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= most]
        out.append((fps[hit], fps[hit + step]))
    for s, n in zip(starts[sizes > 16], sizes[sizes > 16]):
        a, b = _spanning_edges(fps[s : s + n], most)
        out.append((np.array(a, np.uint64), np.array(b, np.uint64)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _verify(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry_group, carry_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(group, fps):
            u, v = bucket_edges(group, fps, most)
            u, v = local_stars(u.view(np.int64), v.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            group = np.concatenate([carry_group, b.column("bucket").to_numpy()])
            fps = np.concatenate([carry_fp, b.column("fp").to_numpy().view(np.uint64)])
            if not len(group):
                continue
            cut = np.searchsorted(group, group[-1])
            if cut:
                yield out(group[:cut], fps[:cut])
            carry_group, carry_fp = group[cut:], fps[cut:]
        if len(carry_group):
            yield out(carry_group, carry_fp)

    return run


def fingerprint_links(distinct: DataFrame, most: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect every two distinct fingerprints (column fp) at ``most`` or fewer differing bits.

    Buckets of one key are verified inside tasks, which return at most a spanning forest, so the output follows the
    number of fingerprints and not of pairs. A bucket over ``block`` rows is dealt out: its rows fall into blocks
    and every pair of blocks is a bucket of its own, so no task holds more than two blocks of a key.
    """
    if most > 3:
        raise ValueError("three segments give whole results up to three differing bits")
    keys = distinct.select("fp").mapInArrow(_keys, "key long, fp long")
    large = keys.groupBy("key").count().where(F.col("count") > block)
    large = large.select(F.col("key").alias("large_key"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = keys.join(large, keys["key"] == large["large_key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1),
        lambda other: F.xxhash64("key", F.least(own, other), F.greatest(own, other)),
    )
    plain = F.array("key")
    rows = dealt.select(F.explode(F.when(F.col("blocks").isNull(), plain).otherwise(pairs)).alias("bucket"), "fp")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verify(most), "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """One row per document: doc_id, text_hash, fingerprint (16 hex digits), component_id, root.

    A null text counts as empty; texts without words have fingerprint zero and are linked like any other. Documents
    with one fingerprint are one node, so copies never make pairs. component_id is the smallest doc_id that is not
    null in the connected group, root the group's smallest fingerprint. Repeated rows give a row each; an empty table gives none.
    """
    slim = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    slim = stored(slim.mapInArrow(_fingerprints(width), "doc_id long, text_hash long, fp long"), "fingerprints")
    nodes = stored(slim.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-nodes")
    roots = connected_components(fingerprint_links(nodes, most))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "fingerprint-groups")
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    groups = stored(placed.join(lows, "root").select("fp", "component_id", "root"), "fingerprint-roots")
    return slim.join(groups, "fp", "left").select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root"
    )


# --- near copies by shingle similarity ----------------------------------------------------------------------

#: Near copies share at least SHARE[0] of SHARE[1] parts of their distinct five-word shingles (Jaccard 0.8).
WIDTH, SHARE = 5, (4, 5)
#: Minima of one band and bands: a pair at Jaccard 0.8 shares no band with probability (1 - 0.8^4)^24 = 3.2e-6.
BAND, BANDS = 4, 24
#: Texts that one task compares at once with those of another such block.
TEXT_BLOCK = 500

_MIX = np.random.default_rng(42).integers(0, 2**63, 2 * WIDTH + BAND * BANDS + BAND + BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE, _FACTOR = _MIX[:WIDTH], _MIX[2 * WIDTH : 2 * WIDTH + BAND * BANDS]
_IN_BAND, _OF_BAND = _MIX[-BAND - BANDS : -BANDS], _MIX[-BANDS:]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word shingles, sorted; fewer words are one shingle, no words one of their own."""
    digest = xxhash.xxh64_intdigest
    words = text.lower().split()
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    n = max(1, len(words) - WIDTH + 1)
    out = np.full(n, min(len(words), WIDTH), np.uint64)
    for i in range(min(len(words), WIDTH)):
        out += hashes[i : i + n] * _PLACE[i]
    return np.unique(_mixed(out))


def band_keys(shingle_hashes: np.ndarray) -> np.ndarray:
    """One key for each band of minima."""
    least = np.full(BAND * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingle_hashes), 512):
        least = np.minimum(least, (shingle_hashes[i : i + 512, None] * _FACTOR).min(axis=0))
    bands = (_mixed(least).reshape(BANDS, BAND) * _IN_BAND).sum(axis=1, dtype=np.uint64)
    return _mixed(bands + _OF_BAND)


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b shingles with so many shared ones reach the similarity, in whole numbers."""
    return shared * SHARE[1] >= (a + b - shared) * SHARE[0]


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [band_keys(shingle_set(t)).view(np.int64) for t in as_bytes(b, "text")]
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), lists], names=["doc_id", "node", "keys"])


def _similar_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = []
        for x, y in zip(as_bytes(b, "text_u"), as_bytes(b, "text_v")):
            x, y = shingle_set(x), shingle_set(y)
            good.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def similar_links(nodes: np.ndarray, roots: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Links between texts of one block that join groups (roots) not yet joined; all pairs of groups are compared."""
    sets = [shingle_set(t) for t in texts]
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    label = np.unique(roots, return_inverse=True)[1]
    u, v = [], []
    for i in range(len(sets)):
        if (label == label[i]).all():
            continue
        mark = np.zeros(len(distinct), np.int64)
        mark[flat[starts[i] : starts[i] + sizes[i]]] = 1
        hits = np.flatnonzero(similar(np.add.reduceat(mark[flat], starts), sizes, sizes[i]) & (label != label[i]))
        for j in hits:
            if label[j] != label[i]:
                u.append(nodes[i])
                v.append(nodes[j])
                label[label == label[j]] = label[i]
    return np.array(u, np.int64), np.array(v, np.int64)


def _block_links(part: pa.Table) -> pa.Table:
    u, v = similar_links(part.column("node").to_numpy(), part.column("root").to_numpy(), part.column("text").cast(pa.binary()).to_pylist())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def fingerprint_pairs(texts: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (u, v) of texts (node, text) to verify: their SimHash fingerprints over five-word shingles are connected
    at ``most`` or fewer differing bits. Texts of one fingerprint meet its smallest, fingerprints by ``fingerprint_links``."""
    slim = texts.select(F.col("node").alias("doc_id"), F.col("node").alias("text_hash"), "text")
    slim = slim.mapInArrow(_fingerprints(WIDTH), "doc_id long, text_hash long, fp long").select(F.col("doc_id").alias("node"), "fp")
    slim = stored(slim.distinct(), "near-fingerprints")
    lows = stored(slim.groupBy("fp").agg(F.min("node").alias("low")), "near-nodes")
    same = slim.join(lows, "fp").select(F.col("low").alias("u"), F.col("node").alias("v"))
    links = fingerprint_links(lows, most).toDF("fp_u", "fp_v")
    links = links.join(lows.toDF("fp_u", "u"), "fp_u").join(lows.toDF("fp_v", "v"), "fp_v").select("u", "v")
    both = same.union(links).where("u <> v")
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = TEXT_BLOCK) -> DataFrame:
    """One row per document: doc_id, text_hash, root; documents of one root are connected by pairs whose five-word
    shingles have Jaccard similarity 0.8 or more.

    Texts meet by SimHash (``fingerprint_pairs``). Most pairs near the bound differ in more bits than that, so bands of
    minima give buckets as well. First each bucket's texts are compared with its smallest text, so pairs follow the
    number of documents. Where that leaves a bucket in several groups, all its groups are compared with one another
    inside tasks, buckets over ``block`` texts as pairs of blocks. Every comparison counts the shingles themselves.
    """
    hashed = id_and_text(docs, id_col, text_col).withColumn("node", F.xxhash64("text"))
    slim = stored(hashed.mapInArrow(_bands, "doc_id long, node long, keys array<long>"), "bands")
    rows = slim.dropDuplicates(["node"]).select("node", F.explode("keys").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    rows = stored(rows.join(shared, "bucket"), "shared-bands")
    pairs = rows.where("node <> low").select(F.col("low").alias("u"), F.col("node").alias("v"))
    pairs = stored(pairs.union(fingerprint_pairs(hashed)).distinct(), "near-pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = stored(hashed.join(wanted, "node", "left_semi").dropDuplicates(["node"]).select("node", "text"), "band-texts")
    met = pairs.join(texts.toDF("v", "text_v"), "v").join(texts.toDF("u", "text_u"), "u")
    links = stored(met.select("u", "v", "text_u", "text_v").mapInArrow(_similar_pairs, "u long, v long"), "similar-pairs")
    roots = connected_components(links)
    placed = rows.where("n > 2").join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "band-groups")
    members = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")
    left = placed.groupBy("bucket", "n").agg(members, F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    left = left.groupBy("n", "members").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.xxhash64("bucket", F.least(own, other), F.greatest(own, other)))
    dealt = placed.join(left, "bucket").select(F.explode(parts).alias("part"), "node", "root").join(texts, "node")
    more = stored(dealt.groupBy("part").applyInArrow(_block_links, "u long, v long"), "block-links")
    if not more.isEmpty():
        roots = connected_components(links.union(more))
    groups = slim.select("doc_id", F.col("node").alias("text_hash"))
    return groups.join(roots, groups["text_hash"] == roots["node"], "left").select("doc_id", "text_hash", F.coalesce("root", "text_hash").alias("root"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: of each connected group of near copies (similar_groups) the one with
    the smallest doc_id (nulls last, ties by text)."""
    groups = similar_groups(docs, id_col, text_col)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
    return kept_rows(docs, first.select(F.col("k.doc_id").alias("keep_id"), F.col("k.text_hash").alias("keep_hash")), id_col, text_col)
