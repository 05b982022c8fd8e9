"""Spelling variants, the Merkle manifest and the toxicity classifier against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadloom.llm import manifest, queries, spelling, toxicity
from tests.llm.conftest import COLUMNS, prose


def by_sql(name, rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    return con.execute(queries.ORACLES[name]).fetchall()


# --- spelling variants ---


def brute_words(rows, least_length=6, least_count=5):
    count = Counter()
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if n >= least_count and len(w) >= least_length}


def brute_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if brute_apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def variant_rows():
    stems = ["wonderful", "wanderful", "wonderfull", "wonderfu", "wonderf", "ananas", "banana", "bananas", "àéîõüÿ", "àéîõüy", "a" * 80, "a" * 81, "a" * 79 + "b"]
    counts = [700, 30, 130, 26, 5, 25, 25, 5, 40, 8, 60, 7, 12]
    rows, n = [], 0
    for w, k in zip(stems, counts):
        for i in range(k):
            rows.append((n % 400, (w.upper() if i % 3 == 0 and w.isascii() else w) + ("; " + prose(n, 12) if i % 7 == 0 else " x2y"), "en", "s", 1))
            n += 1
    return rows + [(None, "wonderful Wonderful", None, None, None), (7, None, "en", "s", 1), (8, "", "en", "s", 1), (9, "日本ÀÉÎ wonderful×÷ananas", "en", "s", 1)]


def test_spelling_variants_against_brute_force_and_sql(spark, monkeypatch):
    rows = variant_rows()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(rows)
    key = lambda r: tuple(map(str, r))
    for indexed, asked in ((20_000, 60_000), (7, 11)):  # shards whole, and dealt out in pieces and blocks
        monkeypatch.setattr(spelling, "INDEXED", indexed)
        monkeypatch.setattr(spelling, "ASKED", asked)
        got = spelling.spelling_variants(docs).select(*columns).collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sorted(by_sql("op12_spelling_variants", rows), key=key) == sorted(want, key=key)
    assert ("wonderf", "wonderfu", "wonderful") in {r[:3] for r in want}  # a chain of forms


def test_spelling_variants_of_odd_tables(spark, tables):
    want = brute_variants(tables["rows"])
    for name in ("docs", "wide"):
        got = spelling.spelling_variants(tables[name]).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert spelling.spelling_variants(tables["empty"]).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=7), min_size=2, max_size=25, unique=True), st.integers(1, 60))
def test_trie_search_and_verification(words, small):
    raw = [w.encode("latin-1") for w in words]
    x = spelling.vectors(raw)
    order = np.lexsort(x.T[::-1])
    held = [raw[i] for i in order]
    near, found = spelling.verified(raw, held), set()
    for a, b in spelling.search(x[order], x, small):
        hit = near(a, b)
        assert not found & set(zip(a[hit], b[hit]))  # each pair once
        found |= set(zip(a[hit].tolist(), b[hit].tolist()))
    assert found == {(i, j) for i, u in enumerate(words) for j, k in enumerate(order) if brute_apart(u, words[k])}
    assert all(spelling.one_apart(a, b) == brute_apart(a.decode("latin-1"), b.decode("latin-1")) for a in raw for b in raw)


def test_every_pair_of_shards_meets_once():
    tops = [(a, b, c) for a in range(3) for b in range(3) for c in range(3)]
    for s in tops:
        for t in tops:
            d = [x - y for x, y in zip(s, t)]
            fits = sum(x for x in d if x > 0) <= 1 and sum(-x for x in d if x < 0) <= 1
            assert (s in spelling.reachable(t)) + (t in spelling.reachable(s)) == (2 if s == t else int(fits))


# --- manifest ---


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, text):
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(show, (r[0], r[3], r[2], r[4], text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path_of(levels, i):
    path = []
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        path.append((run[: i % 3], run[i % 3 + 1 :]))
        i //= 3
    return path


def brute_manifest(rows):
    by_source = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r, r[1]))):
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([brute_leaf(r, r[1]) for r in by_source[s]]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            path, text = path_of(trees[s], i) + path_of(top, k), r[1]
            if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            now = brute_leaf(r, text)
            for left, right in path:
                now = sha(*left, now, *right)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], sha(*[d for a, b in path for d in a + b]), now, now == top[-1][0]))
    return sorted(out, key=str)


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def of_query(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, queries.op13_merkle_manifest(spark, str(folder)).select(*MANIFEST).collect()), key=str)


def test_manifest_against_brute_force_and_sql(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(int(i), f"line {i}\nmore\n" if i % 3 else f"é{i}", "en" if i % 2 else None, f"s{min(int(i) % 11, 6)}", int(i)) for i in r.permutation(1100)]
    rows += [(5000, "one\ntwo", "en", "alone", None), (5001, None, None, None, None), (5002, "", "en", "Ä", 0), (5003, "\n", "en", "", 1)]
    got = of_query(spark, spark.createDataFrame(rows, COLUMNS).repartition(4), tmp_path)
    want = brute_manifest(rows)
    assert got == want and sum(r[6] for r in got) not in (0, len(got))
    assert sorted(by_sql("op13_merkle_manifest", rows), key=str) == want


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_with_small_blocks(spark, levels):
    rows = [(i, f"t{i}\n", "en", "big" if i % 5 else f"s{i}", i) for i in range(130)]
    text = F.when(queries.crc_mod("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = manifest.audited(spark.createDataFrame(rows, COLUMNS), levels, text=text).select(*MANIFEST).collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest(rows)


def test_manifest_of_odd_tables(spark, tables, tmp_path):
    want = brute_manifest(tables["rows"])
    assert of_query(spark, tables["docs"], tmp_path / "a") == want
    assert of_query(spark, tables["wide"], tmp_path / "b") == want
    assert of_query(spark, tables["empty"], tmp_path / "c") == []
    assert of_query(spark, tables["docs"].limit(1), tmp_path / "d")[0][4] == sha()  # a lone leaf has no siblings


def test_store_and_proofs(spark, tables):
    made = manifest.Manifest(tables["docs"])
    store = {r["digest"]: r["children"] for r in made.store().collect()}
    assert all(sha(*c) == d and 1 <= len(c) <= 3 for d, c in store.items()) and made.root in store
    proofs = made.proofs().collect()
    assert len(proofs) == len(tables["rows"]) and all(len(p["digits"]) == len(p["siblings"]) for p in proofs)
    leaves = {brute_leaf(r, r[1]) for r in tables["rows"]}
    reached, waiting = set(), [made.root]
    while waiting:
        d = waiting.pop()
        reached.add(d)
        waiting += [c for c in store.get(d, []) if c not in reached]
    assert leaves <= reached
    with pytest.raises(KeyError):
        manifest.descent("no such digest", 0, 1, store)


# --- toxicity ---

INSULTS = ["grumblewit", "snotlump", "mudbrain", "foulface"]


def toxic_rows(n=240):
    rows, labels = [], []
    for i in range(n):
        words = prose(i, 60).split()
        toxic = i % 3 == 0
        if toxic:
            words.insert(i % 50, INSULTS[i % 4] + ("s" if i % 5 == 0 else ""))
        rows.append((i, " ".join(words), ["en", "de", None][i % 3 and i % 2], "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark, tables):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    marks = spark.createDataFrame(labels + [(3, 1, 0), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(docs, marks)
    got = {g.doc_id: g.score for g in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (i % 3 == 0) for i in held]) > 0.95
    again = toxicity.train_toxicity(docs.repartition(5), marks)
    assert {g.doc_id: g.score for g in toxicity.score_toxicity(docs, again).collect()} == got
    wide = toxicity.score_toxicity(tables["wide"], model).collect()
    assert len(wide) == len(tables["rows"]) and all(0 <= g.score <= 1 for g in wide)
    assert toxicity.score_toxicity(tables["empty"], model).count() == 0
    none = toxicity.train_toxicity(tables["empty"], marks)
    assert all(g.score < 0.3 for g in toxicity.score_toxicity(docs, none).collect())
    with_lang = docs.selectExpr("doc_id", "text", "'xx' as lang", "'t' as source", "9L as n_chars")
    assert {g.doc_id: g.score for g in toxicity.score_toxicity(with_lang, model).collect()} == got


def test_whole_texts_are_read_chunk_by_chunk(monkeypatch):
    rows, labels = toxic_rows(60)
    model = toxicity.fit([(r[1], r[2], y[2]) for r, y in zip(rows, labels)])
    texts = [r[1] for r in rows[:8]] + ["", "12 !", "x", "a b", " ".join(r[1] for r in rows) + " mudbrain"]
    whole = [model.reader().read(t) for t in texts]
    for size in (1, 2, 7):
        monkeypatch.setattr(toxicity, "CHUNK", size)
        assert np.allclose([model.reader().read(t)[0] for t in texts], [w[0] for w in whole], atol=1e-5)
    monkeypatch.setattr(toxicity, "KEPT", 5)
    assert np.allclose([model.reader().read(t)[0] for t in texts], [w[0] for w in whole], atol=1e-5)


def test_pooling_against_loops():
    r = np.random.default_rng(1)
    net = toxicity.Network.start(np.zeros(toxicity.BUCKETS, np.float32), 3)
    vectors = r.normal(size=(6, toxicity.SIZE)).astype(np.float32)
    words = r.integers(0, 6, 9)
    top, at = toxicity.pooled(toxicity.responses(net, vectors), words, net.biases)
    for j, (width, kernel) in enumerate(zip(toxicity.WIDTHS, net.kernels)):
        padded = np.concatenate([np.zeros((width - 1, toxicity.SIZE)), vectors[words], np.zeros((width - 1, toxicity.SIZE))])
        every = np.array([np.einsum("wd,wdf->f", padded[i : i + width], kernel) for i in range(len(words) + width - 1)])
        own = slice(j * toxicity.FILTERS, (j + 1) * toxicity.FILTERS)
        assert np.allclose(top[own], every.max(axis=0), atol=1e-5) and (at[own] == every.argmax(axis=0)).all()


def test_thresholds_and_single_labels():
    assert toxicity.best_cut(np.array([0.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1])) == 3.0
    for label, above in ((0, False), (1, True)):
        model = toxicity.fit([("some words", "en", label)] * 3)
        raw, lang = model.reader().read("other words")
        assert (model.scores(np.array([raw]), np.array([lang]))[0] >= 0.3) == above
