"""Byte-pair encoding and decoding with a public vocabulary file, word by word.

The ranks of a word's adjacent pairs are the leaves of a segment tree of minima. The root is the lowest rank, and the walk down that
prefers the left child finds its leftmost place; a merge changes three leaves, each a walk of logarithmic length to the root. The trees of
all new words of a batch are rows of one array, so a step of numpy merges one pair in each word that still has one. Where only a few words have one size, each has a tree of its own.

Handled files: normalizer NFC, white space to one space, lower case; pieces by a pattern; byte-level symbols; an end-of-word suffix; no decoder."""

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches

NONE = np.int32(2**31 - 1)
# Fixed values. The library follows Unicode 16; these ranges became letters later, so its pattern takes them for other characters ...
LATER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
# ... and these capitals have small letters that Python's tables may lack.
LATER_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
HAS_LATER_CAPITALS = re.compile("[" + "".join(map(chr, LATER_CAPITALS)) + "]")
# str.split() takes these for white space as well, which they aren't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
CACHED_WORDS = 200_000
# Cells of the arrays that words are merged in side by side, and characters of the texts that are encoded together: a worker holds some 50 bytes a cell and more for each new word.
CELLS = 1 << 17
GROUP_CHARS = 1 << 18
# With fewer words of one size, each is merged by itself.
FEW_ROWS = 32


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Encoder:
    """Built on the driver from a vocabulary file and broadcast; workers keep their cache of words with it, of at most CACHED_WORDS words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: a kind of vocabulary that isn't handled")
        model = spec["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocabulary.values(), *self.specials.values()]))
        for k, v in [*vocabulary.items(), *self.specials.items()]:
            self.tokens[v] = k
        symbols = byte_symbols()
        self.inner = np.array([vocabulary[c] for c in symbols], dtype=np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in symbols], dtype=np.int64)
        self.size = len(self.tokens)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges], dtype=np.int64)
        first = np.unique(keys[::-1], return_index=True)[1]
        order = len(keys) - 1 - first  # of a repeated pair the last rank holds
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        later = "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in LATER_LETTERS.split())
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\p{L}", rf"[\p{{L}}--[{later}]]")
        self.cache: dict[str, bytes] = {}
        self.rank_of: dict[int, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "rank_of": {}}

    # -- merging

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32 bit) of each word."""
        out = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w:
                classes.setdefault(max(1, (len(w) - 1).bit_length()), []).append(i)
        for depth, members in classes.items():
            if len(members) < FEW_ROWS and depth > 4:
                for i in members:
                    out[i] = self._merge_word(words[i], depth)
                continue
            most = max(1, CELLS >> depth)
            for at in range(0, len(members), most):
                part = members[at : at + most]
                for i, ids in zip(part, self._merge_rows([words[i] for i in part], depth)):
                    out[i] = ids
        return out

    def _merge_word(self, word: bytes, depth: int) -> bytes:
        """The same tree for a single word: an update stops at the first node that it doesn't change."""
        width, size, none = 1 << depth, self.size, int(NONE)
        if not self.rank_of:
            self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        rank_of, made = self.rank_of.get, self.made
        flat = np.frombuffer(word, dtype=np.uint8)
        ids = self.inner[flat]
        ids[-1] = self.last[flat[-1]]
        levels = [np.full(width, NONE, dtype=np.int32)]
        levels[0][: len(ids) - 1] = self._rank(ids[:-1], ids[1:])
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = array("i", np.concatenate([NONE[None], *reversed(levels)]).tobytes())
        n = len(ids)
        symbol, after, before = array("q", ids.tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while (rank := tree[1]) != none:
            node = 1
            while node < width:
                node *= 2
                if tree[node] != rank:
                    node += 1
            left = node - width
            right = after[left]
            symbol[left], symbol[right] = int(made[rank]), -1
            follows = after[left] = after[right]
            put(right, none)
            if follows < n:
                before[follows] = left
                put(left, rank_of(symbol[left] * size + symbol[follows], none))
            else:
                put(left, none)
            if (prior := before[left]) >= 0:
                put(prior, rank_of(symbol[prior] * size + symbol[left], none))
        kept = np.frombuffer(symbol, dtype=np.int64)
        return kept[kept >= 0].astype("<u4").tobytes()

    def _merge_rows(self, words: list[bytes], depth: int) -> list[bytes]:
        width, n = 1 << depth, len(words)
        lengths = np.array([len(w) for w in words])
        symbol = np.full((n, width + 1), -1, dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        row = np.repeat(np.arange(n), lengths)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbol[row, column] = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbol[np.arange(n), lengths - 1] = self.last[flat[ends]]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), NONE, dtype=np.int32)
        tree[:, width:] = self._rank(symbol[:, :-1], symbol[:, 1:])
        for level in range(depth - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])

        def put(rows: np.ndarray, leaf: np.ndarray, value) -> None:
            node = leaf + width
            tree[rows, node] = value
            for _ in range(depth):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            rank = tree[live, 1]
            node = np.ones(len(live), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node
                node += tree[live, node] != rank
            left = node - width
            right = after[live, left]
            symbol[live, left] = self.made[rank]
            symbol[live, right] = -1
            follows = after[live, right]
            after[live, left] = follows
            inside = follows <= width
            before[live[inside], follows[inside]] = left[inside]
            put(live, np.minimum(right, width - 1), NONE)  # the last symbol has no pair of its own
            put(live, left, self._rank(symbol[live, left], np.where(inside, symbol[live, np.minimum(follows, width)], -1)))
            prior = before[live, left]
            has = prior >= 0
            put(live[has], prior[has], self._rank(symbol[live[has], prior[has]], symbol[live[has], left[has]]))
            live = live[tree[live, 1] != NONE]
        kept = symbol >= 0
        packed = symbol[kept].astype("<u4").tobytes()
        stops = np.cumsum(kept.sum(axis=1)) * 4
        return [packed[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]

    # -- texts

    def _parts(self, text: str) -> list[str]:
        """The text's stretches between special tokens, and these, in order."""
        if not any(s in text for s in self.specials):
            return [text]
        return regex.split("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")", text)

    def _chunks(self, part: str) -> list[str]:
        """What stands between white space, as it is: normal forms and lower case don't reach over white space, so new chunks alone are brought to them."""
        return regex.split(r"\p{White_Space}+", part) if any(c in part for c in SEPARATORS) else part.split()

    def _plain(self, chunk: str) -> str:
        if chunk.isascii():
            return chunk.lower()
        chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # characters are lower-cased one by one: no final sigma
        return (chunk.translate(LATER_CAPITALS) if HAS_LATER_CAPITALS.search(chunk) else chunk).lower()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; null is empty."""
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        split = [[p if p in self.specials else self._chunks(p) for p in self._parts(t or "")] for t in texts]
        new = list({c for parts in split for p in parts if not isinstance(p, str) for c in p}.difference(self.cache))
        if new:
            find = regex.compile(self.pattern, regex.V1).findall
            pieces = [[c] if c.isascii() and c.isalpha() else find(c) for c in map(self._plain, new)]  # ASCII letters are one piece
            names = list({p for ps in pieces for p in ps})
            ids = dict(zip(names, self.merge([p.encode("utf-8", "surrogatepass") for p in names])))
            self.cache.update((c, b"".join([ids[p] for p in ps])) for c, ps in zip(new, pieces))
        get = self.cache.__getitem__
        return [b"".join(self.specials[p].to_bytes(4, "little") if isinstance(p, str) else b"".join(map(get, p)) for p in parts) for parts in split]

    def decode(self, packed: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def _groups(column, size: int = GROUP_CHARS):
    """Runs of the column's texts of about size characters."""
    got, n = [], 0
    for x in column:
        got.append(x.as_py())
        n += len(got[-1] or "")
        if n >= size:
            yield got
            got, n = [], 0
    if got:
        yield got


def _shared(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(Encoder(path))  # its size is that of the vocabulary file


def encode(docs: DataFrame, path: str, with_decoded: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded string), a row for each input row: the ids of the whole text and, if asked for, the text they decode to.

    Null and empty texts have no ids. A word of any length is merged as a whole, in memory of some 50 bytes for each of its own."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(1)):
                ids = shared.value.encode_batch(texts)
                decoded = [shared.value.decode(x) if with_decoded else None for x in ids]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
                values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), values, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])
                at += len(texts)
        release()

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode()'s ids and texts, which stay in the task.

    A row for each input row; null texts are empty: no tokens, the digests of nothing. Texts and words of any length are encoded whole."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(1)):
                ids = shared.value.encode_batch(texts)
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(shared.value.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(texts)
        release()

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
