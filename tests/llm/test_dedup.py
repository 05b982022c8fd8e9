import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from leadloom.llm import exact_dedup, simhash, suffix_dedup
from leadloom.llm.common import connected_components, local_stars
from tests.llm.conftest import prose


def text_of(r):
    return r[1] or ""


# --- counting quotient filters ---


@pytest.mark.parametrize("bits", [8, 20, 54])
def test_quotient_filter_keeps_and_merges_counts(bits):
    r = np.random.default_rng(bits)
    lists = []
    for n in (0, 1, 7, 200):
        values = np.unique(r.integers(0, 1 << bits, n, dtype=np.uint64))
        lists.append((values, r.integers(1, 5000, len(values))))
    filters = [exact_dedup.CountingQuotientFilter.build(bits, *x) for x in lists]
    for f, (values, counts) in zip(filters, lists):
        back = exact_dedup.CountingQuotientFilter.from_bytes(f.to_bytes()).items()
        assert back[0].tolist() == values.tolist() and back[1].tolist() == counts.tolist()
    want = defaultdict(int)
    for values, counts in lists:
        for v, c in zip(values.tolist(), counts.tolist()):
            want[v] += c
    values, counts = exact_dedup.CountingQuotientFilter.merge(filters).items()
    assert dict(zip(values.tolist(), counts.tolist())) == dict(want)
    assert values.tolist() == sorted(want)


def test_exact_groups_against_brute_force(tables):
    groups = defaultdict(list)
    for r in tables["rows"]:
        groups[text_of(r)].append(r[0])
    want = sorted(
        (str(r[0]), max((i for i in groups[text_of(r)] if i is not None), default=None), len(groups[text_of(r)]), hashlib.sha256(text_of(r).encode()).hexdigest())
        for r in tables["rows"]
    )
    got = exact_dedup.exact_groups(tables["docs"]).collect()
    assert sorted((str(g.doc_id), g.keep_id, g.group_size, g.text_sha256) for g in got) == want
    assert sum(g.kept for g in got) == len(groups)  # repeated rows: one stays
    assert all(g.doc_id == g.keep_id for g in got if g.kept)


@pytest.mark.parametrize("stage", [exact_dedup.exact_dedup, simhash.near_dedup])
def test_dedup_stages_keep_one_row_and_all_columns(tables, stage):
    docs = tables["wide"]
    kept = stage(docs)
    assert kept.schema == docs.schema
    rows = kept.collect()
    assert len({r["text"] or "" for r in rows}) == len(rows)
    assert stage(tables["empty"]).count() == 0
    if stage is exact_dedup.exact_dedup:
        assert len(rows) == len({text_of(r) for r in tables["rows"]})


def test_empty_tables(tables):
    assert exact_dedup.exact_groups(tables["empty"]).count() == 0
    assert simhash.simhash_groups(tables["empty"]).count() == 0
    assert suffix_dedup.remove_repeats(tables["empty"]).count() == 0


# --- SimHash ---


def brute_fingerprint(text):
    words = text.lower().encode().split() if text.isascii() else text.encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, ids):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low = {x: min(i for i, y in zip(ids, label) if y == x and i is not None) for x in set(label)}
    return [low[x] for x in label]


def test_simhash_groups_against_brute_force(tables):
    rows = tables["rows"]
    fps = [brute_fingerprint(text_of(r)) for r in rows]
    want = sorted((str(r[0]), f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components(fps, [r[0] for r in rows])))
    got = simhash.simhash_groups(tables["docs"]).collect()
    assert sorted((str(g.doc_id), g.fingerprint, g.component_id) for g in got) == want


def test_golay_code_is_perfect():
    words = np.random.default_rng(3).integers(0, 1 << 23, 5000)
    index = simhash.codeword_index(words)
    code = (index << 11) | simhash._PARITY[index]
    assert (np.bitwise_count(words ^ code) <= 3).all()


@pytest.mark.parametrize("block", [simhash.BLOCK, 8])
def test_links_find_every_pair_up_to_three_bits(spark, tables, block):
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64)) for _ in range(6)])
    chain = [base[0]]
    for _ in range(40):
        x = chain[-1]
        for b in r.choice(64, 3, replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        chain.append(x)
    fps = np.unique(np.concatenate([base, near, np.array(chain, np.uint64)])).view(np.int64).tolist()
    found = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block).collect()
    roots = dict(connected_components(spark.createDataFrame([tuple(x) for x in found], "u long, v long")).collect())
    plain = [f & (2**64 - 1) for f in fps]
    want = brute_components(plain, list(range(len(fps))))
    groups = defaultdict(set)
    for i, f in enumerate(fps):
        groups[roots.get(f, f)].add(i)
    assert sorted(map(min, groups.values())) == sorted(set(want))
    assert all(len({want[i] for i in g}) == 1 for g in groups.values())
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 64 for a, b in found)


def test_large_buckets_give_a_spanning_forest():
    fps = np.arange(64, dtype=np.uint64)
    a, b = simhash.bucket_edges(np.zeros(64, np.int64), fps, 3)
    assert len(a) == 63 and (np.bitwise_count(a ^ b) <= 3).all()


def test_components_on_long_chains(spark, tables):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(50)] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 50)}}
    u, v = local_stars(np.array([3, 2, 9]), np.array([2, 1, 8]))
    assert dict(zip(u.tolist(), v.tolist())) == {2: 1, 3: 1, 9: 8}


# --- suffix dedup ---


def brute_repeats(rows, length=50):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first, out = {}, []
    for i in order:
        data = text_of(rows[i]).encode()
        for p in range(len(data) - length + 1):
            first.setdefault(data[p : p + length], rows[i][0])
    for r in rows:
        data = text_of(r).encode()
        covered = [False] * len(data)
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] != r[0]:
                covered[p : p + length] = [True] * length
        spans = sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        kept = bytes(b for b, c in zip(data, covered) if not c)
        out.append((str(r[0]), len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("chunk", [suffix_dedup.CHUNK, 700])
def test_suffix_dedup_against_brute_force(tables, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    got = suffix_dedup.remove_repeats(tables["docs"]).collect()
    assert sorted((str(g.doc_id), g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == brute_repeats(tables["rows"])
    for g in got:
        assert hashlib.sha256(g.kept).hexdigest() == g.kept_sha256 and sum(s.end - s.start for s in g.spans) == g.n_removed


def test_suffix_dedup_of_periodic_texts(spark, tables):
    rows = [(1, "a" * 500), (2, "a" * 120), (3, "ab" * 200), (4, "x" * 49), (5, "x" * 49), (6, "y" * 50), (7, "y" * 50 + "z" + "y" * 50), (8, "b" + "ab" * 30 + "!" + "a" * 55)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(g.doc_id), g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == brute_repeats(rows)


def test_window_buckets_equal_exactly_for_equal_windows():
    text = np.frombuffer((b"abcabcabd" * 40) + b"abcabcabe" * 20, np.uint8)
    starts = np.arange(len(text) - 50)
    bucket = suffix_dedup.window_buckets(text, starts, 50)
    raw = text.tobytes()
    seen = {}
    assert all(seen.setdefault(raw[s : s + 50], b) == b for s, b in zip(starts.tolist(), bucket.tolist()))
    assert len(set(seen.values())) == len(seen)


# --- near copies ---


def brute_jaccard(a, b):
    sets = []
    for t in (a, b):
        words = t.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(text, places):
    words = text.split()
    for p in places:
        words[p] = f"edit{p}"
    return " ".join(words)


@pytest.mark.parametrize("low,high,places", [(0.8, 0.83, [20, 60]), (0.88, 0.92, [50]), (0.94, 0.98, [0, 99]), (0.7, 0.7999, [20, 50, 99])])
def test_near_dedup_finds_planted_copies_by_similarity(spark, low, high, places):
    rows = []
    for i in range(150):
        text = prose(5000 + i, 100)
        copy = edited(text, places)
        assert low <= brute_jaccard(text, copy) <= high
        rows += [(i, text), (1000 + i, copy)]
    kept = sorted(r[0] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted(r[0] for r in rows if r[0] < 1000 or low < 0.8)


@pytest.mark.parametrize("block", [simhash.TEXT_BLOCK, 3])
def test_similar_groups_against_brute_force(spark, block):
    r = np.random.default_rng(6)
    rows = [(0, ""), (1, " \n"), (2, "two words"), (3, "Two  words"), (4, "two more")]
    for g in range(12):
        base = prose(7000 + g, 120)
        rows += [(100 * (g + 1) + k, edited(base, r.choice(120, k % 5, replace=False))) for k in range(14)]
    label = {i: i for i, _ in rows}
    for x in range(len(rows)):
        for y in range(x):
            if brute_jaccard(rows[x][1], rows[y][1]) >= 0.8 and label[rows[x][0]] != label[rows[y][0]]:
                a, b = sorted((label[rows[x][0]], label[rows[y][0]]))
                label = {k: a if v == b else v for k, v in label.items()}
    groups = defaultdict(list)
    for g in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=block).collect():
        groups[g.root].append(g.doc_id)
    want = defaultdict(list)
    for i, v in label.items():
        want[v].append(i)
    assert len(want) > 20 and max(map(len, want.values())) > 3
    assert sorted(sorted(x) for x in groups.values()) == sorted(sorted(x) for x in want.values())


def test_near_dedup_goes_through_fingerprints(spark, monkeypatch):
    """Texts at three or fewer bits are pairs of the SimHash step, and similar_groups verifies them."""
    rows = [(i, prose(9000 + i, 600)) for i in range(30)]
    rows += [(100 + i, edited(rows[i][1], [300])) for i in range(30)] + [(500, ""), (501, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    fps = [simhash.fingerprint(t.encode(), simhash.WIDTH) for _, t in rows]
    got = {frozenset(r) for r in simhash.fingerprint_pairs(texts).collect()}
    near = {frozenset((rows[i][0], rows[j][0])) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3}
    assert near and got == near and frozenset((500, 501)) in got
    seen = []
    step = simhash.fingerprint_pairs
    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda *a: seen.append(step(*a)) or seen[-1])
    kept = sorted(r[0] for r in simhash.near_dedup(docs).collect())
    assert kept == [*range(30), 500] and len(seen) == 1 and seen[0].distinct().count() == len(near)
