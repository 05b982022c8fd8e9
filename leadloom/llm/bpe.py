"""BPE encoding and decoding: a segment tree over adjacent pair ranks finds the leftmost lowest-rank merge."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from leadloom.llm.common import id_and_text

NONE = np.iinfo(np.int64).max
#: Longest piece, in bytes, that is merged together with others of its length class.
TOGETHER = 64
#: Pieces that a task remembers, and characters that it encodes at once.
REMEMBERED, CHUNK = 200_000, 500_000


#: The newer letters all lie beyond this block.
beyond = regex.compile("[\u0530-\U0010ffff]").search


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def newer_letters() -> frozenset[str]:
    """Letters and digits of newer Unicode versions, on which pattern libraries disagree."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")


class WordBpe:
    """A vocabulary of byte-level BPE with word ends, from the JSON text of its file.

    Texts are normalised as the file says (NFC, lower case; white space only separates) and split by its pattern.
    Special tokens written out in a text are single tokens.
    """

    def __init__(self, file: str):
        spec = json.loads(file)
        model, self.vocab = spec["model"], spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix = model["end_of_word_suffix"]
        size = max([*self.vocab.values(), *special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in [*self.vocab.items(), *special.items()]:
            self.tokens[i] = token.encode()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        self.newer = newer_letters()
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.special = {k: np.array([i], "<u4").tobytes() for k, i in special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[c] for c in symbols])
        self.last = np.array([self.vocab[c + suffix] for c in symbols])
        pairs = np.array([(self.vocab[a], self.vocab[b]) for a, b in model["merges"]], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in model["merges"]])
        keys = (pairs[:, 0] << 32) | pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        self.seen: dict[str, bytes] = {}

    # --- merging ------------------------------------------------------------------------------------------

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
        """rank and position of each pair in one number, so that the least is the leftmost of the lowest rank."""
        key = (left << 32) | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (left >= 0) & (right >= 0), (self.ranks[i] << bits) | at, NONE)

    def _merge_together(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``width`` (a power of two) bytes: one segment tree each, all stepped at once."""
        n, bits = len(words), max(width - 1, 1).bit_length()
        length = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), length)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        # two columns of padding: the place after the last symbol, and a place for writes that go nowhere
        symbol = np.full((n, width + 2), -1, np.int64)
        symbol[row, col] = np.where(col == length[row] - 1, self.last[flat], self.inner[flat])
        after = np.tile(np.minimum(np.arange(1, width + 3), width), (n, 1))
        before = np.tile(np.concatenate([[width + 1], np.arange(width + 1)]), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        tree[:, width:] = self._leaf(symbol[:, :width], symbol[:, 1 : width + 1], np.arange(width), bits)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(rows, at, value):
            node = width + at
            tree[rows, node] = value
            while width > 1 and node[0] > 1:
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            best = tree[live, 1]
            at, new = best & ((1 << bits) - 1), self.made[best >> bits]
            right = after[live, at]
            follow, previous = after[live, right], before[live, at]
            symbol[live, at] = new
            symbol[live, right] = -1
            after[live, at] = follow
            before[live, follow] = at
            put(live, right, NONE)
            put(live, at, self._leaf(new, symbol[live, follow], at, bits))
            has = previous < width
            if has.any():
                rows, at = live[has], previous[has]
                put(rows, at, self._leaf(symbol[rows, at], new[has], at, bits))
            live = live[tree[live, 1] < NONE]
        keep = symbol >= 0
        return np.split(symbol[keep].astype("<u4"), np.cumsum(keep.sum(axis=1))[:-1])

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same tree for one long piece, in plain lists: each merge costs a few paths to the root."""
        raw = np.frombuffer(word, np.uint8)
        symbol = [*self.inner[raw[:-1]].tolist(), int(self.last[raw[-1]])]
        n, made, rank_of = len(symbol), self.made.tolist(), self.rank_of
        width = 1 << (n - 1).bit_length()
        none, bits = 1 << 62, width.bit_length()
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = rank_of.get((symbol[i] << 32) | symbol[i + 1])
            if rank is not None:
                tree[width + i] = (rank << bits) | i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, left: int, right: int) -> None:
            rank = rank_of.get((left << 32) | right) if right >= 0 else None
            node = width + at
            tree[node] = none if rank is None else (rank << bits) | at
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] < none:
            at = tree[1] & ((1 << bits) - 1)
            new, right = made[tree[1] >> bits], after[at]
            follow = after[right]
            symbol[at], symbol[right], after[at] = new, -1, follow
            put(right, 0, -1)
            put(at, new, symbol[follow] if follow < n else -1)
            if follow < n:
                before[follow] = at
            if before[at] >= 0:
                put(before[at], symbol[before[at]], new)
        return np.array([s for s in symbol if s >= 0], "<u4")

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        by_width: dict[int, list[int]] = {}
        for i, r in enumerate(raw):
            by_width.setdefault(1 << (len(r) - 1).bit_length() if len(r) <= TOGETHER else 0, []).append(i)
        for width, at in by_width.items():
            if not width:
                done = [self._merge_long(raw[i]) for i in at]
            else:
                done = self._merge_together([raw[i] for i in at], width)
            for i, ids in zip(at, done):
                self.seen[pieces[i]] = ids.tobytes()

    # --- texts --------------------------------------------------------------------------------------------

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text; special tokens stand among them as they are (no piece of ordinary text is one)."""
        parts = self.cut(text) if "<|" in text else [text]
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif part:
                if part.isascii() or not beyond(part) or self.newer.isdisjoint(part):
                    out += self.find(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
                else:  # the tokenizers library's own character tables decide
                    out += [p for p, _ in self.split.pre_tokenize_str(self.normal.normalize_str(part))]
        return out

    def encode_chunks(self, texts: list[str]) -> Iterator[list[bytes]]:
        """Ids of the texts, in order, for about CHUNK characters at a time (at least one text)."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= CHUNK):
                size += len(texts[stop])
                stop += 1
            if len(self.seen) > REMEMBERED:
                self.seen = {}
            split = [self._pieces(t) for t in texts[start:stop]]
            self._learn(list(set().union(*split) - self.seen.keys() - self.special.keys()))
            known = self.seen | self.special if any("<|" in t for t in texts[start:stop]) else self.seen
            yield [b"".join(map(known.__getitem__, s)) for s in split]
            start = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [ids for chunk in self.encode_chunks(texts) for ids in chunk]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens' strings, joined by spaces: the file names no decoder."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load_bpe(file: str) -> WordBpe:
    return WordBpe(file)


#: What encode_documents can return, with its Arrow and SQL types.
OUTPUTS = {
    "ids": ("array<long>", pa.list_(pa.int64())),
    "decoded": ("string", pa.string()),
    "n_tokens": ("long", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def encode_documents(docs: DataFrame, vocabulary: str, outputs: tuple[str, ...] = ("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the asked outputs of every whole text, one row per document.

    vocabulary is the path of a tokenizer file that the driver reads; the file (a few MB, whatever the corpus) goes
    to the executors as a broadcast. Null texts count as empty: no ids, an empty decoded text. Row-local: repeated
    rows give a row each, an empty table none.
    """
    with open(vocabulary, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    one = {
        "ids": lambda bpe, x: np.frombuffer(x, "<u4").astype(np.int64),
        "decoded": lambda bpe, x: bpe.decode(x).decode(),
        "n_tokens": lambda bpe, x: len(x) // 4,
        "ids_sha256": lambda bpe, x: hashlib.sha256(x).hexdigest(),
        "decoded_sha256": lambda bpe, x: hashlib.sha256(bpe.decode(x)).hexdigest(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(file.value)
        for b in batches:
            made: dict[str, list] = {o: [] for o in outputs}
            for ids in chain.from_iterable(bpe.encode_chunks(b.column("text").to_pylist())):
                for o in outputs:
                    made[o].append(one[o](bpe, ids))
            columns = [b.column("doc_id"), *(pa.array(made[o], OUTPUTS[o][1]) for o in outputs)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *outputs])
        bpe.seen = {}  # the worker lives on and may do other work

    schema = ", ".join(["doc_id long", *(f"{o} {OUTPUTS[o][0]}" for o in outputs)])
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
