import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadloom.llm import bpe, compression, html_extract, language, license_scan, mixing, quality
from leadloom.llm.queries import DIGESTS, VOCABULARY
from tests.llm.conftest import prose

LIBRARY = Tokenizer.from_file(VOCABULARY)
OWN = bpe.WordBpe(open(VOCABULARY, encoding="utf-8").read())


def text_of(r):
    return r[1] or ""


# --- BPE ---


def same_as_library(texts):
    for text, ids, want in zip(texts, OWN.encode(texts), LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert OWN.decode(ids).decode() == LIBRARY.decode(want.ids, skip_special_tokens=False)


def test_bpe_on_hard_texts():
    same_as_library(["", "  ", "a" * 3000, "ab" * 40, "x" * 64, "x" * 65, "!" * 200, "don't I'LL we've", "<|endoftext|>x<|startoftext|> <|end <|", "ΑΣ İ ß é Å 日本語 😀😀", "1234 ²³", "a b c\x1fd\x85e"])


def test_bpe_on_single_characters():
    same_as_library(["a" + chr(c) + "b" for c in [*range(0x3000), *range(0xA000, 0xA800), *range(0x10900, 0x10F00)]])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_bpe_on_any_text(text):
    same_as_library([text])


@pytest.mark.parametrize("word", ["thequickbrownfox", "zzzzzzzzzz", "internationalization", "aé" * 9])
def test_both_segment_trees_agree(word):
    raw = word.encode()
    width = 1 << (len(raw) - 1).bit_length()
    assert OWN._merge_long(raw).tolist() == OWN._merge_together([raw, raw], width)[1].tolist()


def test_encode_documents(tables):
    got = bpe.encode_documents(tables["docs"], VOCABULARY, DIGESTS).collect()
    want = []
    for r in tables["rows"]:
        ids = LIBRARY.encode(text_of(r), add_special_tokens=False).ids
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((str(r[0]), len(ids), digest(np.array(ids, "<u4").tobytes()), digest(LIBRARY.decode(ids, skip_special_tokens=False).encode())))
    assert sorted((str(g.doc_id), g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got) == sorted(want)
    whole = bpe.encode_documents(tables["wide"], VOCABULARY).where("doc_id = 107").first()
    assert whole["ids"] == LIBRARY.encode("word", add_special_tokens=False).ids and whole["decoded"] == "word</w>"
    assert bpe.encode_documents(tables["empty"], VOCABULARY, DIGESTS).count() == 0


# --- mixing ---


def test_targets_share_the_excess_again():
    got = mixing.target_sizes([100, 1000, 400], [5, 2, 1], 1.5, 2)
    assert got[0] == 200 and got[1] == pytest.approx(2050 * 2 / 3) and got[2] == pytest.approx(2050 / 3)
    assert mixing.target_sizes([0, 0], [5, 2], 1.5, 2) == [0, 0] and mixing.target_sizes([], [], 1.5, 2) == []


def test_flow_routes_overlapping_patterns_and_repeats_only_where_needed():
    given_words = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 100}, {"a": 25, "b": 60}, 2)
    sums = {s: sum(g.get(s, 0) for g in given_words.values()) for s in "ab"}
    assert sums == {"a": 25, "b": 60}
    assert sum(given_words[("b",)].values()) <= 100 and sum(given_words[("a",)].values()) <= 20
    # one word in five of (a) or (a, b) is repeated, and none of (b)
    repeated = sum(max(0, sum(g.values()) - size) for g, size in zip(given_words.values(), (10, 10, 100)))
    assert repeated == 5


def test_mix_documents(tables):
    rows = mixing.mix_documents(tables["docs"]).collect()
    want = sorted((str(r[0]), len(text_of(r).encode().split())) for r in tables["rows"])
    assert sorted((str(g.doc_id), g.size) for g in rows) == want
    by_source, all_sizes = {}, sum(n for _, n in want)
    for r in tables["rows"]:
        by_source[r[3]] = by_source.get(r[3], 0) + len(text_of(r).encode().split())
    names = [*sorted(s for s in by_source if s), None]
    target = dict(zip(names, mixing.target_sizes([by_source[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)))
    assert sum(target.values()) == pytest.approx(min(1.5, 2) * all_sizes)
    got = {}
    for g in rows:
        assert g.taken in (0, g.size, 2 * g.size)
        got.setdefault((g.source_size, round(g.target, 6)), []).append((g.taken, g.size))
    assert set(got) == {(by_source[s], round(target[s], 6)) for s in names}
    for (size, goal), taken in got.items():
        assert abs(sum(t for t, _ in taken) - goal) <= max(n for _, n in taken) / 2 + 1
    again = mixing.mix_documents(tables["docs"].repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.mix_documents(tables["empty"]).count() == 0


def test_mix_repeats_rows_with_all_columns(tables):
    mix = mixing.Mix(tables["wide"])
    repeated = mix.repeat(tables["wide"])
    assert repeated.columns == tables["wide"].columns
    assert sum(len(text_of(r).split()) for r in ((None, x.text) for x in repeated.collect())) == mix.documents().groupBy().sum("taken").first()[0]
    assert mixing.Mix(tables["empty"]).repeat(tables["empty"]).count() == 0


def test_mix_of_overlapping_sources(spark, tables):
    rows = [(i, prose(i, 20 + i % 7), [["a"], ["a", "b"], ["b", "c"], [], None, ["c", None]][i % 6]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    mix = mixing.Mix(docs)
    for s, v in mix.sources.items():
        assert sum(g.get(s, 0) for g in mix.given.values()) <= v["target"] + 1
    taken = {r.doc_id: r for r in mix.documents().collect()}
    assert all(r.taken <= 2 * r["size"] for r in taken.values())
    assert sum(r.taken for r in taken.values()) == pytest.approx(sum(sum(g.values()) for g in mix.given.values()), abs=150)


def brute_flow(patterns, quotas, most):
    """(largest flow, least cost of it) over all whole-word routings."""
    arcs = [(g, s) for g in patterns for s in g]
    best = (0, 0)
    for given_words in itertools.product(*(range(min(most * patterns[g], quotas[s]) + 1) for g, s in arcs)):
        used, filled = Counter(), Counter()
        for (g, s), n in zip(arcs, given_words):
            used[g] += n
            filled[s] += n
        if all(used[g] <= most * patterns[g] for g in used) and all(filled[s] <= quotas[s] for s in filled):
            cost = sum(sum(k // patterns[g] for k in range(used[g])) for g in used if patterns[g])
            best = max(best, (sum(given_words), -cost))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=3, max_size=3), st.lists(st.integers(0, 5), min_size=2, max_size=2), st.integers(1, 3))
def test_flow_against_brute_force(sizes, goals, most):
    patterns, quotas = dict(zip([("a",), ("a", "b"), ("b",)], sizes)), dict(zip("ab", goals))
    routed = mixing.route(patterns, quotas, most)
    used = {g: sum(w.values()) for g, w in routed.items()}
    cost = sum(sum(k // patterns[g] for k in range(n)) for g, n in used.items() if patterns[g])
    assert (sum(used.values()), -cost) == brute_flow(patterns, quotas, most)


def brute_mix(mix):
    """Copies of each row, pattern by pattern and document by document."""
    rows = [r.asDict() for r in mix.slim.collect()]
    out = Counter()
    for p in {r["pattern"] for r in rows}:
        own = sorted((r for r in rows if r["pattern"] == p), key=lambda r: r["dice"])
        size, words = sum(r["size"] for r in own), sum(mix.given[p].values())
        full = min(words // size, mix.most) if size else 1
        gap, chosen = words - full * size, set()
        for _ in range(4):
            fits = [r for r in own if r["dice"] not in chosen and 0 < r["size"] <= gap]
            upto = 0
            for r in fits:
                if upto + r["size"] > gap:
                    break
                upto += r["size"]
                chosen.add(r["dice"])
            gap -= upto
            if not fits:
                break
        near = min(((r["size"], r["dice"]) for r in own if r["dice"] not in chosen and gap < r["size"] < 2 * gap), default=None)
        if near:
            chosen |= {r["dice"] for r in own if r["size"] == near[0] and r["dice"] == near[1]}
        for r in own:
            out[(r["_id"], (full + (r["dice"] in chosen)) * r["size"])] += 1
    return out


def test_mix_against_brute_force(spark, tables):
    rows = [(i, prose(i, 5 + i * 7 % 40), "en", f"s{min(i % 7, 3)}", 1) for i in range(200)] + [(900 + i, "one two three", "en", "ties", 1) for i in range(9)]
    for docs in (spark.createDataFrame(rows, tables["docs"].schema), tables["docs"].where("doc_id is not null").dropDuplicates(["doc_id", "text"])):
        mix = mixing.Mix(docs)
        assert Counter((r.doc_id, r.taken) for r in mix.documents().collect()) == brute_mix(mix)


def test_mix_leaves_texts_where_they_are_and_bounds_its_patterns(spark, tables):
    docs = spark.createDataFrame(tables["rows"], tables["docs"].schema)
    plan = mixing.Mix(docs).repeat(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    with pytest.raises(ValueError, match="group the sources"):
        mixing.Mix(docs, most_patterns=2)
    grouped = mixing.Mix(docs, most_patterns=2, group=lambda c: F.when(c.isNotNull(), F.lit("all")))
    assert set(grouped.sources) == {"all", None}
    assert sum(r["size"] for r in grouped.documents().collect()) == sum(len(text_of(r).split()) for r in tables["rows"])


# --- quality ---


@pytest.fixture(scope="module")
def labelled(spark, tables):
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        text = prose(i)
        if bad:
            text = [" ".join([text.split()[0]] * 80), " | ".join(text.split()), text.upper().replace(" ", "!! "), text.replace(" ", "&&& ")][i // 3 % 4]
        rows.append((i, text, "en", "s", 1))
        labels.append((i, 0 if bad else 1, 0))
    labels += [(None, 1, 0), (5, None, 0), (7, 0, 0), (9999, 1, 0)]  # null id, null label, contradiction, no document
    return spark.createDataFrame(rows, tables["docs"].schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_quality_on_held_out_rows(labelled, tables):
    docs, labels, rows = labelled
    model = quality.train_quality(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 30
    assert np.mean([(got[i] >= 0.7) == (i % 3 != 0) for i in held]) >= 0.95
    assert all(0 <= s <= 1 for s in got.values())
    kept = quality.keep_quality(docs, model)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.7}
    assert quality.score_quality(tables["docs"], model).count() == len(tables["rows"])
    assert quality.keep_quality(tables["wide"], model).columns == tables["wide"].columns
    assert quality.keep_quality(tables["empty"], model).count() == 0 and quality.score_quality(tables["empty"], model).count() == 0


def test_bradley_terry_orders_by_preference():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 3))
    y = (x @ np.array([2.0, -1.0, 0.0]) + r.normal(size=400) * 0.1 > 0).astype(float)
    model = quality.bradley_terry(x, y)
    assert (model.score(x)[y == 1][:, None] > model.score(x)[y == 0][None]).mean() > 0.99
    assert np.all(quality.bradley_terry(x, np.ones(400)).score(x) >= 0.7)
    assert np.all(quality.bradley_terry(x, np.zeros(400)).score(x) < 0.7)
    assert np.isfinite(quality.bradley_terry(np.zeros((0, 0)), np.zeros(0)).score(np.zeros((2, len(quality.FEATURES))))).all()


# --- licences ---


@pytest.mark.parametrize("text,postfix,labels,free", [
    ("MIT", ["MIT"], {"mit"}, True),
    ("MIT OR GPL-2.0-only AND BSD-3-Clause */", ["MIT", "GPL-2.0-only", "BSD-3-Clause", "and", "or"], {"mit", "gpl", "bsd"}, True),
    ("(MIT OR GPL-2.0-only) and LGPL-2.1+", ["MIT", "GPL-2.0-only", "or", "LGPL-2.1+", "and"], {"mit", "gpl", "lgpl"}, False),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", ["GPL-2.0-or-later", "Classpath-exception-2.0", "with"], {"gpl"}, False),
    ("(MIT", ["MIT"], {"mit"}, True), ("OR MIT", [], set(), False), ("", [], set(), False), ("MIT AND", ["MIT"], {"mit"}, True), ("MIT) x", ["MIT"], {"mit"}, True),
])
def test_shunting_yard(text, postfix, labels, free):
    assert license_scan.to_postfix(text) == postfix
    assert license_scan.evaluate(postfix) == (labels, free)


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = [(i, label) for phrase, label in license_scan.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


LICENCES = ["mit license MIT-License, apache\nlicense", "the General Public License general public license v3", "mit licenses", "İ MIT É license", "x SPDX-License-Identifier: MIT OR Apache-2.0\nMIT License", "license", " ", "é mit license é"]


def test_license_scan_against_brute_force(spark, tables):
    rows = tables["rows"] + [(500 + i, t, None, None, 1) for i, t in enumerate(LICENCES)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, tables["docs"].schema)).collect()
    assert sorted((str(g.doc_id), g.n_words, g.n_base, str(g.first_word), str(g.last_word), g.base_labels) for g in got) == sorted((str(r[0]), *map(lambda x: str(x) if x is None else x, brute_base(text_of(r))[:2]), *map(str, brute_base(text_of(r))[2:4]), brute_base(text_of(r))[4]) for r in rows)
    tagged = next(g for g in got if g.doc_id == 504)
    assert tagged.labels == "apache,mit" and {f.kind for f in tagged.findings} == {"tag", "base"} and 0 < tagged.score <= 1
    assert all(set(g.base_labels.split(",")) <= set(g.labels.split(",")) for g in got if g.base_labels)
    assert license_scan.scan_licenses(tables["empty"]).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["mit", "license", "MIT", "License", "apache", "general", "public", "-", "é", "\n", "licensed"]), max_size=40))
def test_license_places(parts):
    text = " ".join(parts)
    n, found = license_scan.scan(text.encode())
    assert (n, *license_scan.summary(found)[:4]) == brute_base(text)


# --- compression ---


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_against_brute_force(spark, tables):
    extra = [(600, "a b a b a b c", None, None, 1), (601, "x\nx\n\n x\nx", None, None, 1), (602, "## é <b> z", None, None, 1), (603, "aaaa " * 3000, None, None, 1), (604, prose(1, 2000), None, None, 1), (605, bytes(np.random.default_rng(1).integers(33, 127, 9000).astype(np.uint8)).decode(), None, None, 1)]
    rows = [r for r in tables["rows"] if r[0] not in (105, 106)] + extra
    got = compression.quality_rules(spark.createDataFrame(rows, tables["docs"].schema)).collect()
    assert sorted((str(g.doc_id), g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == sorted((str(r[0]), *brute_rules(text_of(r))) for r in rows)
    by_id = {g.doc_id: g for g in got}
    assert all(g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words) and not (g.kept and g.base_failed) for g in got)
    assert by_id[604].kept and not by_id[603].kept and by_id[100].ratio is None and not by_id[605].kept
    assert compression.quality_rules(tables["empty"]).count() == 0


def test_bands_reject_both_ends():
    import zstandard

    compress = zstandard.ZstdCompressor(level=3, write_content_size=False).compress
    noise = np.random.default_rng(2).integers(0, 256, 20_000).astype(np.uint8).tobytes()
    assert not compression.verdict(noise, compression.WIDE, compress)[2]
    assert not compression.verdict(b"spam and eggs " * 400, compression.WIDE, compress)[2]
    mixed = prose(5, 1500).encode() + b"spam and eggs " * 900  # the whole ratio alone would not tell where
    assert compression.verdict(mixed, compression.WIDE, compress)[1] > 0.25
    assert compression.verdict(b"", compression.WIDE, compress) == (None, 0.0, True)


def brute_verdict(text, bands):
    """The bands written out for one text."""
    import zstandard

    size = lambda b: len(zstandard.ZstdCompressor(level=bands.level, write_content_size=False).compress(b))
    if not text:
        return True
    inside = True
    for least, low, high in bands.whole:
        if len(text) >= least:
            inside = low <= size(text) / len(text) <= high
    chunks = [text[i : i + 4096] for i in range(0, len(text), 4096)] if len(text) > 4096 else []
    if chunks and len(chunks[-1]) < 4096:
        chunks = chunks[:-1] + [text[-4096:]] * (len(chunks[-1]) >= 1024)
    low, high = [x[1:] for x in bands.chunks if len(text) >= x[0]][-1] if len(text) >= 4096 else (0, 9)
    return inside and sum(not low <= size(c) / 4096 <= high for c in chunks) <= 0.25 * len(chunks)


def test_fitted_bands_on_the_given_tables(spark):
    """Low-quality rows that the base rules pass fail by the bands alone, good ones stay."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    bands = compression.fit_bands(docs)
    assert bands == compression.fit_bands(docs.repartition(7)) and bands != compression.WIDE
    rows = compression.quality_rules(docs, bands).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    lost = {q: np.mean([not r["kept"] for r in rows if r["quality"] == q and not r["base_failed"]]) for q in (0, 1)}
    assert lost[0] > 0.4 and lost[1] < 0.02
    assert all(r["kept"] == (not r["base_failed"] and brute_verdict((r["text"] or "").encode(), bands)) for r in rows)


def test_fit_of_odd_tables_and_copies(spark, tables):
    assert compression.fit_bands(tables["empty"]) == compression.WIDE
    assert compression.fit_bands(tables["wide"], rows=5).level == compression.WIDE.level
    rows = [(i, prose(i, 300), "en", "s", 1) for i in range(120)]
    copies = [(1000 + i, prose(7, 300) + f" end{i}", "en", "s", 1) for i in range(60)]  # a third: near copies of one text
    docs = spark.createDataFrame(rows, tables["docs"].schema)
    whole = lambda b: {x[0]: x[1:] for x in b.whole}[1024]
    alone, both = whole(compression.fit_bands(docs)), whole(compression.fit_bands(docs.union(spark.createDataFrame(copies, docs.schema))))
    assert np.allclose(alone, both, atol=0.02)


def test_bands_come_from_all_rows(spark, tables):
    """Every row that passes the base rules counts in the quartiles, copies once; no bound on the rows."""
    rows = [(i, prose(i, 60 + i), "en", "s", 1) for i in range(400)] + [(900, prose(3, 2500), "en", "s", 1), (None, None, None, None, 1)]
    docs = spark.createDataFrame([*rows, *rows[:50]], tables["docs"].schema)
    measured = compression.measure(docs)
    bands, compress = compression.bands_of(measured), compression.compressor(3)
    by_step = {}
    for r in rows[:401]:
        size = len(r[1].encode())
        by_step.setdefault(1 << (size.bit_length() - 1), []).append(len(compress(r[1].encode())) / size)
    assert sum(len(v) >= 40 for v in by_step.values()) >= 2
    for step, low, high in bands.whole:
        if len(by_step.get(step, ())) >= 40:
            want = compression.drawn(np.quantile(by_step[step], [0.25, 0.5, 0.75]).tolist(), compression.WHOLE_SPREAD)
            assert np.allclose((low, high), want, atol=3e-4)
    assert compression.fit_bands(docs) == bands
    assert sorted(map(str, compression.judged(measured, bands).collect())) == sorted(map(str, compression.quality_rules(docs, bands).collect()))


# --- language ---


def tiny_corpus():
    return {"en": ["the cat sat on the mat and the dog ran to the house"] * 3 + [prose(i) for i in range(5)], "de": ["der hund und die katze sind nicht im haus ich gehe über die straße"] * 4, "fr": ["le chat est dans la maison et il ne veut pas sortir où êtes vous"] * 4}


def model_of(corpus):
    counts = {}
    for lang, texts in corpus.items():
        counts[lang] = np.unique(np.concatenate([language.grams(language.symbols(t)) for t in texts]), return_counts=True)
    return language.LanguageModel(counts)


def test_kneser_ney_sums_to_one_and_matches_the_formula():
    model = model_of(tiny_corpus())
    m = model.models[model.languages.index("de")]
    alphabet = np.unique(np.concatenate([t.hashes for t in [model.table]]) * np.uint64(pow(int(language._MIX), -1, 1 << 64)) & np.uint64(0xFFFF))
    for context in ("der", "xyz", "ein"):
        head = sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context))
        keys = np.array([head | int(c) for c in alphabet], np.uint64)
        p = m.probability(keys)
        assert (p > 0).all() and p.sum() <= 1 + 1e-9 and p.sum() > 0.97  # the rest is for unseen symbols
    key, count = m.tables[4].hashes[:1], m.tables[4].values[0][0]
    gram = key * np.uint64(pow(int(language._MIX), -1, 1 << 64))
    at, _ = m.contexts[4].find(gram >> np.uint64(16))
    total, kinds = (v[at][0] for v in m.contexts[4].values)
    lower = m.probability(gram & np.uint64((1 << 48) - 1), 3)[0]
    d = m.discounts[4]
    assert m.probability(gram)[0] == pytest.approx((count - d + d * kinds * lower) / total)


def test_cross_entropy_of_chunks_is_that_of_the_whole(monkeypatch):
    model = model_of(tiny_corpus())
    texts = ["the cat and the dog", "", "über straße", "1234", "le chat " * 50, "😀 𝒳"]
    whole = model.cross_entropies(texts)[0]
    monkeypatch.setattr(language, "CHUNK", 7)
    assert np.allclose(model.cross_entropies(texts)[0], whole)
    assert [p[0] for p in model.predict(texts)] == ["en", "und", "de", "und", "fr", model.predict(["𝒳"])[0][0]]


def test_identify(spark, tables):
    rows = [(i, t, lang, "s", 1) for lang, ts in tiny_corpus().items() for i, t in enumerate(ts * 6)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, tables["docs"].schema)
    model = language.train_languages(docs)
    got = {g.doc_id: g for g in language.identify(docs, model).collect()}
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]) > 0.95
    odd = language.identify(tables["wide"], model)
    seen = {g.doc_id: g for g in odd.collect()}
    assert seen[100].lang_pred == seen[101].lang_pred == seen[102].lang_pred == "und" and seen[100].score == 0
    assert odd.count() == len(tables["rows"]) and all(0 <= g.score <= 1 for g in seen.values())
    assert language.identify(tables["empty"], model).count() == 0
    none = language.train_languages(tables["empty"])
    assert {g.lang_pred for g in language.identify(docs, none).collect()} == {"und"}


# --- HTML ---

PAGE = """<!DOCTYPE html><html class="has-sidebar"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice"><p>We and our partners use the cookies to make this site better for all of you and us.</p></div>
<div id="ad-top">Buy the best of the things that you can have and be the one to have it now.</div>
<article><header><h1>The &lt;Title&gt;</h1></header>
<p>This is the first of the paragraphs and it is   long\n enough to be one that we can decide on.</p><p>Short &amp; sweet.<p><b>Bold and <i>nested</b> text</i><br>next line
<ul><li>one item<li>another item</ul>
<div class="share"><a href="#">Share</a></div><aside>See also the other texts that we have on this site for you to read.</aside>
<section class="comments"><div><p>I am a reader and this is what I have to say about all of that.</div></section>
<form><label>Your name and the rest of it <input></label></form><p>The end.</p></article>
<div class="sidebar"><p>All of the things that are in the sidebar are not in the article at all.</p></div>
<footer>&copy; 2020 the company and all of its people</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_extract.main_text(PAGE) == "\n\n".join(["The <Title>", "This is the first of the paragraphs and it is long enough to be one that we can decide on.", "Short & sweet.", "Bold and nested text next line", "one item", "another item", "The end."])


def test_page_without_article():
    good = "<p>This is a paragraph of the text and it has all of the words that one would need.</p>"
    page = f"""<body><div id="topbar"><a href=1>One</a> <a href=2>Two</a></div><div class="page"><h1>A title</h1>{good}<p>Short.</p>{good}
    <ol class="commentlist"><li>And this is what I, a reader, have to say about the text of this page here.</li></ol></div>
    <div class="sidebarLeft"><p>The things that are in here are not of the text and so on and so on.</p></div><p>Copyright 2020 us</p>"""
    text = "This is a paragraph of the text and it has all of the words that one would need."
    assert html_extract.main_text(page) == "\n\n".join(["A title", text, "Short.", text])


def test_text_outside_a_teaser_article_and_linked_headings():
    good = ["This is a paragraph of the text and it has all of the words that one would need.", "And here is another one of the text that is as long as it should be for the rules."]
    body = "".join(f"<p>{g}</p>" for g in good)
    teaser = '<article class="card"><h3><a href="/x">Other story</a></h3><p>Teaser.</p><p><a href="/x">Read on</a></p></article>'
    title = '<h1><a href="/t">The linked title</a></h1>'
    for page in (f'<body><div id="content">{title}{body}</div>{teaser}</body>', f"<body>{teaser}<div id='content'>{title}{body}</div></body>"):
        text = html_extract.main_text(page).split("\n\n")
        assert [x for x in text if x in ("The linked title", *good)] == ["The linked title", *good] and "Read on" not in text
    article = f"<body><article>{title}{body}{body}</article><div><p>{good[0]}</p></div></body>"
    assert html_extract.main_text(article) == "\n\n".join(["The linked title", *good, *good])


def test_ambiguous_blocks_inherit():
    good = "this is a block of the text that is long and has all of the words in it"
    def block(text, linked=0, scope=0):
        return html_extract.Block(text, linked, False, scope, False)
    links = block("Home About", 10)
    found = [links, block("Menu"), block("x"), block("A title"), block(good), block("Ok."), block("Fine."), block("y"), block("Foot"), links]
    assert html_extract.classify(found) == [False, False, True, True, True, True, True, False, False, False]
    assert html_extract.classify([]) == [] and html_extract.classify([block("just text")]) == [True]


@pytest.mark.parametrize("page", ["", "<", "<![foo[bar]]>x", "<p 'a>b", "a < b", "<!--", "<script>", "</p></div>x", "<![ <p>", "&#xZZ; &bogus;", "<a href=\"x"])
def test_odd_pages_do_not_fail(page):
    assert isinstance(html_extract.main_text(page), str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<b>", "</b>", "<article>", "</article>", "<li>", "<ul>", "word ", "&amp;", "<", "<!--", "-->", "<td>", "<br>", "'", '"', ">"]), max_size=60))
def test_any_tag_soup(parts):
    html_extract.main_text("".join(parts))


def brute_second_pass(found, rules):
    """Labels with neighbours searched block by block."""
    if (held := sum(len(b.text) for b in found if b.scope and not b.beside)) and sum(len(b.text) for b in found if not b.scope and html_extract.first_pass(b, rules, False)) > held:
        found = [html_extract.replace(b, scope=0) for b in found]
    leading = any(b.scope and not b.beside for b in found)
    first = [html_extract.first_pass(b, rules, leading) for b in found]
    out = []
    for i, b in enumerate(found):
        if first[i] is not None:
            out.append(first[i])
            continue
        decided = [(j, first[j]) for j, o in enumerate(found) if o.scope == b.scope and first[j] is not None and (first[j] or not (o.scope and o.beside))]
        after = min((d for d in decided if d[0] > i), default=None)
        if b.heading and after:
            out.append(after[1])
        elif b.heading and not b.scope and b.linked > rules.most_linked * len(b.text):
            out.append(False)
        elif decided:
            out.append(min(decided, key=lambda d: (abs(d[0] - i), not d[1]))[1])
        else:
            out.append(bool(b.scope) or not leading)
    if not leading and not any(out):
        out = [f is None and not b.linked and len(b.text) >= rules.long_enough for f, b in zip(first, found)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "Home of the", "this is a block of the text that is long and has all of the words in it", "© 2020"]), st.floats(0, 1), st.sampled_from([0, 0, 0, 1, 2]), st.integers(0, 2), st.booleans()), max_size=30))
def test_second_pass_against_brute_force(rows):
    found = [html_extract.Block(t, int(share * len(t)), beside, scope, heading) for t, share, beside, scope, heading in rows]
    assert html_extract.classify(found) == brute_second_pass(found, html_extract.Rules())


def test_second_pass_decides_short_blocks(tables):
    text = html_extract.main_text(PAGE).split("\n\n")
    found = html_extract.blocks(PAGE)
    first = [b.text for b, good in zip(found, html_extract.classify(found, second=False)) if good]
    assert [t for t in text if t not in first] == ["The <Title>", "Short & sweet.", "Bold and nested text next line", "one item", "another item", "The end."]


def test_articles_keep_reference_lists_and_odd_names():
    prose_ = "The price of a share of the company is what all of the people in the market think that it is."
    page = f"""<body class="has-sidebar"><article><h1>T</h1><p>{prose_}</p><div class="share-price"><p>{prose_}</p><p>42 of the day</p></div>
    <div class="related"><p><a href=1>Other</a></p></div><div class="share"><p>{prose_}</p><p>Tweet</p></div><div class="related-posts">More of it</div>
    <h2>References</h2><ul><li><a href="/1">First source</a></li><li><a href="/2">Second source</a></li></ul></article></body>"""
    assert html_extract.main_text(page).split("\n\n") == ["T", prose_, prose_, "42 of the day", prose_, "References", "First source", "Second source"]
    assert [html_extract.head_word(n) for n in ("share-price", "related-posts", "sidebarLeft", "has-sidebar", "ad-box", "content", "site-header", "")] == ["price", "related", "sidebar", "", "ad", "", "header", ""]


SHAPES = {
    "links": lambda n: "<div><a href='x'>y</a>" * n + "<b>" * n + "x" * n,
    "attribute name": lambda n: "<a " + "n" * n + ">x",
    "articles": lambda n: "<article>" * n,
    "running": lambda n: "<i>" * n + "<b></b>" * n,
    "open quotes": lambda n: '<a "x ' * n,
    "quoted ends": lambda n: '<a b=">" ' * n,
    "open comments": lambda n: "<!-- " * n + ">" + "<!-- >" * n,
    "marked": lambda n: "<div class='ad'><article>x" * n,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_pages_take_linear_time(shape):
    import time

    def spent(n):
        page = SHAPES[shape](n)
        start = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - start

    spent(1000)
    assert spent(40_000) < 20 * max(spent(8_000), 0.02)


def test_extract_pages(spark):
    rows = [(1, "http://a", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "plain", None), (1, "http://a", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(pages).collect()
    assert len(got) == 5 and all(g.n_chars == len(g.text) for g in got)
    assert next(g for g in got if g.page_id == 2).text == ""
    assert html_extract.extract_pages(pages.where("false")).count() == 0
