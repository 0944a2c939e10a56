"""Byte-level BPE encoding and decoding.

Each pre-token is merged with a segment tree over the ranks of its adjacent
pairs: the root holds the lowest rank, descending to the left on ties gives the
leftmost one, and a merge changes three leaves, so a pre-token of n bytes takes
O(n log n) however long it is. Short pre-tokens are merged many at a time, the
trees standing side by side in one array. Pre-tokens recur, so each Python worker
keeps bounded tables of those it has already merged, for as long as it does nothing else.

Defined cases: a null text counts as empty and gives no ids; repeated rows are
encoded each for itself; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workers import keeps, lean

#: Pieces up to this many characters are remembered, at most so many per worker and table.
CACHED_CHARS, CACHED_PIECES = 64, 400_000
#: Texts are taken in groups of about this many characters.
GROUP_CHARS = 500_000
#: Cells of the trees that stand side by side, some 90 bytes each while they are merged.
MERGED_CELLS = 1 << 17
NONE = 1 << 62


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + extra)
            extra += 1
    return table


def _ranges(wanted: str) -> str:
    """A character class body of all code points whose category starts with ``wanted``."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == wanted
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: Code points with the White_Space property.
SPACES = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def splitter() -> re.Pattern:
    """Contractions, letters, numbers, other signs, and white space that leaves one space to the next word."""
    letters, numbers = _ranges("L"), _ranges("N")
    return re.compile(
        rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    )


class PairTree:
    """Ranks of adjacent pairs under a tree of minima.

    A leaf holds rank and position in one integer, so that the root alone names
    the leftmost pair of the lowest rank; leaves without a mergeable pair hold NONE.
    """

    __slots__ = ("tree", "width")

    def __init__(self, leaves: list[int]):
        self.width = width = 1 << max(0, len(leaves) - 1).bit_length()
        level = leaves + [NONE] * (width - len(leaves))
        levels = [level]
        while len(level) > 1:
            level = list(map(min, level[::2], level[1::2]))
            levels.append(level)
        self.tree = [NONE]
        for level in reversed(levels):
            self.tree += level

    def put(self, at: int, leaf: int) -> None:
        tree, i = self.tree, at + self.width
        tree[i] = low = leaf
        while i > 1:
            other = tree[i ^ 1]
            if other < low:
                low = other
            i >>= 1
            if tree[i] == low:
                return
            tree[i] = low


class Codec:
    """Encoder and decoder of one vocabulary, with the tables that a worker keeps."""

    def __init__(self, model_json: bytes):
        spec = json.loads(model_json)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.start = [vocab[c] for c in alphabet]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.spelt = [b""] * size
        for token, i in vocab.items():
            self.spelt[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.spelt[i] = token.encode()
        self.words = splitter().findall
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_ids = np.array(self.start, np.int64)
        keys = np.array(sorted(self.pairs), np.int64)
        self.keys = np.append(keys, np.int64(NONE))
        self.key_rank = np.array([*(self.pairs[k][0] for k in keys.tolist()), 0], np.int64)
        self.made = np.zeros(len(self.pairs) + 1, np.int64)
        for rank, new in self.pairs.values():
            self.made[rank] = new
        self.known: dict[str, bytes] = {}  # pre-token to packed ids
        self.spaced: dict[str, bytes] = {}  # what follows a space, to packed ids of the space and it

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        start, pairs = self.start, self.pairs
        ids = [start[b] for b in raw]
        n = len(ids)
        if n < 2:
            return ids
        shift = n.bit_length()
        mask = (1 << shift) - 1
        leaves = []
        for i in range(n - 1):
            found = pairs.get(ids[i] << 32 | ids[i + 1])
            leaves.append(NONE if found is None else found[0] << shift | i)
        tree = PairTree(leaves)
        put, nodes = tree.put, tree.tree
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := nodes[1]) != NONE:
            i = root & mask
            j = after[i]
            new = ids[i] = pairs[ids[i] << 32 | ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if nodes[j + tree.width] != NONE:
                    put(j, NONE)
                found = pairs.get(new << 32 | ids[k])
                put(i, NONE if found is None else found[0] << shift | i)
            else:
                put(i, NONE)
            h = before[i]
            if h >= 0:
                found = pairs.get(ids[h] << 32 | new)
                put(h, NONE if found is None else found[0] << shift | h)
        return [i for i in ids if i >= 0]

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank and position of each pair, NONE where it can't be merged."""
        key = left << 32 | right
        found = np.searchsorted(self.keys, key)
        return np.where((self.keys[found] == key) & (left >= 0) & (right >= 0), self.key_rank[found] << 6 | at, NONE)

    def merge_many(self, words: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pre-tokens of at most ``width`` (up to 64) bytes; a row of the arrays for each."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        place = np.arange(width)
        ids = np.where(place < length[:, None], self.byte_ids[raw], -1)
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int64)], axis=1)  # a place after the end
        tree = np.full((n, 2 * width), NONE, np.int64)
        tree[:, width : 2 * width] = self.leaves(ids[:, :-1], ids[:, 1:], np.broadcast_to(place, (n, width)))
        w = width
        while w > 1:
            tree[:, w // 2 : w] = np.minimum(tree[:, w : 2 * w : 2], tree[:, w + 1 : 2 * w : 2])
            w //= 2
        after = np.minimum(np.broadcast_to(np.arange(1, width + 2), (n, width + 1)), length[:, None])
        before = np.tile(np.arange(-1, width), (n, 1))

        flat = tree.reshape(-1)

        def put(root: np.ndarray, at: np.ndarray, leaf) -> None:
            """root: where the tree of each row begins in ``flat``."""
            i = at + width
            flat[root + i] = leaf
            w = width
            while w > 1:
                i, w = i >> 1, w >> 1
                child = root + (i << 1)
                flat[root + i] = np.minimum(flat[child], flat[child + 1])

        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            root = tree[row, 1]
            i = root & 63
            j = after[row, i]
            k = after[row, j]
            new = self.made[root >> 6]
            ids[row, i] = new
            ids[row, j] = -1
            after[row, i] = k
            before[row, k] = i
            tops = row * (2 * width)
            put(tops, j, NONE)
            put(tops, i, self.leaves(new, ids[row, k], i))
            h = before[row, i]
            if len(some := np.flatnonzero(h >= 0)):
                r, h = row[some], h[some]
                put(tops[some], h, self.leaves(ids[r, h], new[some], h))
            row = row[tree[row, 1] != NONE]
        kept = ids >= 0
        flat, ends = ids[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of all ``words``; short ones are kept for later."""
        out = {w: self.known[w] for w in words & self.known.keys()}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in words - out.keys():
            raw = w.encode()
            by_width.setdefault(max(8, 1 << (len(raw) - 1).bit_length()), []).append((w, raw))
        for width, group in by_width.items():
            if width > 64:
                packed = [np.array(self.merge(raw), "<u4").tobytes() for _, raw in group]
            else:
                at_once = MERGED_CELLS // width
                packed = [p for i in range(0, len(group), at_once) for p in self.merge_many([raw for _, raw in group[i : i + at_once]], width)]
            out.update(zip((w for w, _ in group), packed, strict=True))
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        self.known.update((w, p) for w, p in out.items() if len(w) <= CACHED_CHARS)
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Where all white space is single spaces and line ends between other signs, no
        pre-token reaches over a space but with the one space before it, so the text
        falls at its spaces into pieces that are looked up whole.
        """
        plain: list[list[str] | None] = [t.split(" ") if single_gaps(t) and not (self.marks and self.marks.search(t)) else None for t in texts]
        new = set().union(*(p[1:] for p in plain if p)) - self.spaced.keys()
        cut = {piece: self.words(" " + piece) for piece in new}
        heads: list[list[list[str]]] = []  # of each text: of its parts between special tokens: pre-tokens
        for t, p in zip(texts, plain, strict=True):
            if p:
                heads.append([self.words(p[0])])
            else:
                heads.append([self.words(x) if not k % 2 else [x] for k, x in enumerate(self.marks.split(t) if self.marks else [t])])
        ordinary = (w for h in heads for k, part in enumerate(h) if not k % 2 for w in part)
        known = self.learn({*ordinary, *(w for c in cut.values() for w in c)})
        pieces = {piece: b"".join(map(known.__getitem__, c)) for piece, c in cut.items()}
        if len(self.spaced) > CACHED_PIECES:
            pieces |= {x: self.spaced[x] for p in plain if p for x in p[1:] if x in self.spaced}
            self.spaced.clear()
        self.spaced.update((x, p) for x, p in pieces.items() if len(x) <= CACHED_CHARS and "\n" not in x)
        of = _Either(self.spaced)
        of.update(pieces)
        out = []
        for p, h in zip(plain, heads, strict=True):
            if p:
                out.append(b"".join(map(known.__getitem__, h[0])) + b"".join(map(of.__getitem__, p[1:])))
            else:
                out.append(b"".join(struct.pack("<I", self.special[part[0]]) if k % 2 else b"".join(map(known.__getitem__, part)) for k, part in enumerate(h)))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.spelt.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


def single_gaps(text: str) -> bool:
    """Whether all white space is single spaces and line ends, each between other signs."""
    return len(text.split()) == text.count(" ") + text.count("\n") + 1


class _Either(dict):
    """What is new with a group of texts, else what was known before."""

    def __init__(self, before: dict[str, bytes]):
        super().__init__()
        self.before = before

    def __missing__(self, key: str) -> bytes:
        return self.before[key]


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts, about GROUP_CHARS together."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


_codecs: dict[int, Codec] = {}


def _codec(model_json: bytes) -> Codec:
    """One codec per worker process and vocabulary, until another operator needs the worker."""
    keeps("bpe", _codecs.clear)
    key = hash(model_json)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model_json)
    return _codecs[key]


def _run(df: DataFrame, tokenizer_path: str, columns: tuple[str, str], schema: str, row) -> DataFrame:
    with open(tokenizer_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: a file of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            yield row(codec, batch.column(0), batch.column(1))

    return df.select(*columns).mapInArrow(lean(work, "bpe"), schema)


def _encoded(codec: Codec, texts: pa.Array) -> list[bytes]:
    return [ids for group in groups([t.as_py() or "" for t in texts]) for ids in codec.encode_many(group)]


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``ids``, little-endian unsigned 32-bit token ids."""

    def row(codec, keys, texts):
        return pa.RecordBatch.from_arrays([keys, pa.array(_encoded(codec, texts), pa.binary())], [id_col, "ids"])

    return _run(df, tokenizer_path, (id_col, text_col), f"{id_col} long, ids binary", row)


def decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id and ``decoded``, the text that the ids spell; null ids spell an empty text."""

    def row(codec, keys, ids):
        return pa.RecordBatch.from_arrays([keys, pa.array([codec.decode(t.as_py() or b"") for t in ids], pa.string())], [id_col, "decoded"])

    return _run(df, tokenizer_path, (id_col, ids_col), f"{id_col} long, decoded string", row)


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``ids`` and ``decoded``, in one pass over the texts."""

    def row(codec, keys, texts):
        ids = _encoded(codec, texts)
        return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.string())], [id_col, "ids", "decoded"])

    return _run(df, tokenizer_path, (id_col, text_col), f"{id_col} long, ids binary, decoded string", row)


def token_digests(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, number of tokens, and SHA-256 of the ids and of the text decoded from them."""
    return encode_decode(df, tokenizer_path, id_col, text_col).select(
        id_col,
        F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
