import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in a is that it for was on are as with be by this at from or an have".split()


def prose(seed, n=120):
    """Varied English-looking words, a sentence end now and then."""
    import random

    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS) if r.random() < 0.45 else "".join(r.choice(["ta", "ren", "mo", "lis", "ver", "ing", "con"]) for _ in range(r.randint(1, 4)))
        out.append(w.capitalize() if i % 12 == 0 else w + "." if i % 12 == 11 else w)
    return " ".join(out)


@pytest.fixture(scope="session")
def tables(spark):
    """Tables with nulls in every column, empty and long texts, ties, repeated rows, and extra columns whose names
    clash with the operators' own."""
    long_text = " ".join(prose(i, 400) for i in range(30))
    rows = [(i, prose(i), "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (None, prose(3), "fr", None, 2), (102, "   \n\t ", "en", "s1", 3)]
    rows += [(103, prose(3), "en", "s2", 4), (103, prose(3), "en", "s2", 4), (104, prose(3), "en", "s2", 4), (104, prose(99), "en", "s0", 4)]
    rows += [(105, long_text, "en", "s3", 5), (106, long_text + " tail", "en", "s3", 5), (107, "word", "en", "s0", 1), (108, "é日本 ü", "de", "s0", 1)]
    wide = COLUMNS + ", fp long, `row` string, kept string, Text_hash string, _mix_size int, u string, bucket string, `full` int, _pattern string, _keep_id long, _rule string"
    clash = [(*r, 7, "r", "k", "h", 1, "u", "b", 9, "p", 3, "r") for r in rows]
    return {
        "rows": rows,
        "docs": spark.createDataFrame(rows, COLUMNS).repartition(3).cache(),
        "wide": spark.createDataFrame(clash, wide).cache(),
        "empty": spark.createDataFrame([], COLUMNS),
    }
