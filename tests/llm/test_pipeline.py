import hashlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from leadloom.llm.queries import VOCABULARY
from tests.llm.conftest import prose

DEALT = [f"op{n}_" for n in range(1, 14)]


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_near(rows):
    """The smallest id of each group connected by pairs of Jaccard similarity 0.8 or more."""
    sets, root = [shingles(r[1] or "") for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted(min(g) for g in groups.values())


def near_copy(text, changes):
    """The text with its last words replaced; each changes one five-word shingle."""
    words = text.split()
    return " ".join(words[:-changes] + [f"changed{changes}x{k}." if k % 4 == 3 else f"changed{changes}x{k}" for k in range(changes)])


def test_every_dealt_query_is_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(d) for n in names) == 1 for d in DEALT) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_against_brute_force(spark, tables, tmp_path):
    rows = [(i, prose(i, 80), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(10)]  # copies
    rows += [(200 + i, " ".join([prose(i).split()[0]] * 90), "en", "s1", 1) for i in range(20)]  # junk
    rows += [(400 + 10 * k + i, near_copy(prose(20 + i, 80), k), "en", "s1", 1) for k in (2, 4, 8, 12) for i in range(4)]  # 0.95, 0.9, 0.81, 0.73
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 1), (59, rows[59][1], "en", "s2", 1)]
    spark.createDataFrame(rows, tables["docs"].schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 0 if 200 <= r[0] < 300 else 1, 0) for r in rows if r[0] % 2 and r[0] < 300]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append([tuple(r) for r in docs.collect()])
        assert n == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, single, near, mixed, encoded = seen
    ids = lambda rs: sorted(r[0] for r in rs)
    assert not any(200 <= i < 300 for i in ids(good)) and set(ids(good)) >= {r[0] for r in rows if r[0] < 200}
    last = {}
    for r in good:
        last[r[1] or ""] = max(last.get(r[1] or "", -1), r[0])
    assert ids(single) == sorted(last.values())
    assert ids(near) == brute_near(single)
    assert {i for i in ids(single) if i >= 400} >= {420, 421, 440, 441, 480, 481} and not any(400 <= i < 500 for i in ids(near))
    words = Counter()
    for r in near:
        words[r[3]] += len((r[1] or "").split())
    assert set(ids(mixed)) <= set(ids(near)) and max(Counter(ids(mixed)).values()) <= 2
    taken = sum(len((r[1] or "").split()) for r in mixed)
    assert abs(taken - 1.5 * sum(words.values())) <= 80 * len(words)
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for r in mixed:
        e = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(e), e, hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(encoded) == sorted(want)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(encoded)


def test_pipeline_of_empty_tables(spark, tables, tmp_path):
    """Without labels the classifier keeps all or nothing, by its rule; no documents give no rows."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    tables["empty"].write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    kept = corpus_pipeline.keep_good(spark, tables["docs"], str(tmp_path)).count()
    assert kept in (0, len(tables["rows"]))
    assert corpus_pipeline.encode(spark, tables["docs"], "").count() == len(tables["rows"])
