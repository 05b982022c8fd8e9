"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser reads
the licence expression behind a tag."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from leadloom.llm.common import as_bytes, id_and_text

#: Phrases of the base rule and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases, in words.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "creative commons": "cc",
    "cc by": "cc",
    "cc0": "cc0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "proprietary",
}
#: Identifier tags as they stand in lower-cased text.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Families of identifiers by their beginning; the base rule's labels keep their names.
FAMILIES = {"mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "bsd": "bsd", "isc": "isc", "epl": "epl", "bsl": "boost"}
PERMISSIVE = {"mit", "apache", "bsd", "isc", "boost", "cc0", "unlicense", "0bsd", "zlib"}
WEIGHTS = {"tag": 0.95, "base": 0.8, "notice": 0.6}

# --- expressions ------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def to_postfix(text: str) -> list[str]:
    """The longest licence expression at the start of a text, in postfix order (shunting yard).

    WITH binds closer than AND, AND closer than OR; operators may be in any case. Reading ends at the first word
    that cannot follow; an operator without a right side and brackets that stay open are left out.
    """
    out: list[str] = []
    held: list[str] = []
    want, at, good = True, 0, None
    depth = 0
    while m := _TOKEN.match(text, at):
        word = m[1]
        low = word.lower()
        if want:
            if word == "(":
                held.append(word)
                depth += 1
            elif word == ")" or low in _RANK:
                break
            else:
                out.append(word.rstrip(".:"))
                want = False
        elif low in _RANK:
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[low]:
                out.append(held.pop())
            held.append(low)
            want = True
        elif word == ")" and depth:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        else:
            break
        at = m.end()
        if not want:
            good = [*out, *(x for x in reversed(held) if x != "(")]
    return good or []


def family(identifier: str) -> str:
    low = identifier.lower().rstrip("+")
    return next((label for start, label in FAMILIES.items() if low == start or low.startswith(start + "-")), low)


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """(labels of all licences named, whether the expression can be met with permissive licences alone).

    OR offers a choice, AND asks for both sides, WITH adds an exception to a licence and leaves its label.
    """
    stack: list[tuple[set[str], bool]] = []
    for x in postfix:
        if x in _RANK:
            b, a = stack.pop(), stack.pop()
            if x == "with":
                stack.append(a)
            else:
                stack.append((a[0] | b[0], a[1] or b[1] if x == "or" else a[1] and b[1]))
        else:
            label = family(x)
            stack.append(({label}, label in PERMISSIVE))
    return stack[0] if stack else (set(), False)


# --- texts ------------------------------------------------------------------------------------------------

#: Lower-cases A-Z and turns every other byte below 128 that is no digit or lower-case letter into a space.
_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


@lru_cache(maxsize=1)
def _automata() -> tuple:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, found in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES)):
        for phrase, label in found.items():
            phrases.add_word(f" {phrase} ", (kind, label, phrase.count(" ") + 1))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: bytes) -> tuple[int, list[tuple[str, str, int, str | None, bool | None]]]:
    """(number of words, findings of a whole text); a finding: kind, label, first word, expression, permissive.

    Places of phrases are counted in words from 0; a tag's place is the number of words before it.
    """
    phrases, tags = _automata()
    words = text.translate(_WORDS).split()
    plain = " " + b" ".join(words).decode() + " "
    found, at, spaces = [], 0, 0
    for end, (kind, label, n) in phrases.iter(plain):
        spaces += plain.count(" ", at, end)  # each part of the text is counted once
        at = end
        found.append((kind, label, spaces - n, None, None))
    low = text.lower()  # bytes: A-Z only, so places stay
    if b"license" in low:
        whole = low.decode()
        raw, passed, before = text.decode(), 0, 0
        for end, tag in tags.iter(whole):
            stop = raw.find("\n", end)
            postfix = to_postfix(raw[end + 1 : stop if stop >= 0 else len(raw)])
            labels, permissive = evaluate(postfix)
            before += len(raw[passed : end + 1 - len(tag)].encode().translate(_WORDS).split())
            passed = end + 1 - len(tag)
            found += [("tag", label, before, " ".join(postfix), permissive) for label in sorted(labels)]
    return len(words), found


FINDINGS = "array<struct<kind:string,label:string,word:long,expression:string,permissive:boolean>>"
_FINDING = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("expression", pa.string()), ("permissive", pa.bool_())]))
_SUMMARY = "n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def summary(found: list[tuple]) -> tuple:
    base = [f for f in found if f[0] == "base"]
    places = [f[2] for f in base]
    miss = 1.0
    for kind in {f[0] for f in found}:
        miss *= 1 - WEIGHTS[kind]
    join = lambda rows: ",".join(sorted({f[1] for f in rows}))
    return len(base), min(places, default=None), max(places, default=None), join(base), join(found), 1 - miss


def scan_licenses(docs: DataFrame, findings: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, findings.

    Texts are lower-cased in A-Z and read whole; null counts as empty (no words, empty labels, null places, score
    zero). The score rises with the kinds of evidence (tag, base phrase, other notice). Row-local: repeated rows give
    a row each, an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scans = [scan(t) for t in as_bytes(b, "text")]
            parts = list(zip(*(summary(f) for _, f in scans))) if scans else [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
            columns = [b.column("doc_id"), pa.array([n for n, _ in scans], pa.int64()), *(pa.array(x, k) for x, k in zip(parts, kinds))]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            if findings:
                columns.append(pa.array([[dict(zip(("kind", "label", "word", "expression", "permissive"), f)) for f in fs] for _, fs in scans], _FINDING))
                names.append("findings")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id long, n_words long, {_SUMMARY}" + (f", findings {FINDINGS}" if findings else "")
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
