"""Byte-level BPE with a segment tree over the ranks of adjacent pairs.

A piece of text starts as one symbol for each byte. The leaves of a binary tree hold the merge
rank of the pair that starts at each symbol, together with its place; a node holds the smaller
of its children, so the root is the leftmost of the lowest-ranked pairs. A merge changes three
leaves and the nodes above them, and merges go on until the root holds no pair.

All pieces of a batch that a task has not met before are encoded together: pieces of like length
are rows of one array, and every step of the tree is a numpy operation over all rows. Longer
pieces get a tree of their own. A task remembers the results of about ``REMEMBERED`` pieces.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrow.llm.store import small_batches
from lexigrow.llm.words import tidy

# Fixed value: how this vocabulary's tokenizer splits a text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 200_000
#: Pieces of up to so many bytes share arrays; at once, rows * places stay below CELLS.
SHARED_BYTES, CELLS = 64, 1 << 18
NONE = np.int64(1) << 62


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    letters.update({chr(256 + k): b for k, b in enumerate(rest)})
    return letters


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = byte_letters()
        vocabulary = model["model"]["vocab"]
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for piece, number in vocabulary.items():
            self.bytes_of[number] = bytes(letters[c] for c in piece)
        self.first = np.zeros(256, dtype=np.int64)
        for letter, byte in letters.items():
            self.first[byte] = vocabulary[letter]
        merges = model["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([(vocabulary[a] << 20) | vocabulary[b] for a, b in pairs], dtype=np.int64)
        merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.merged = key[order], order.astype(np.int64), merged[order]
        self.result = merged
        self.rank_of = dict(zip(key.tolist(), range(len(key)), strict=True))
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        for content, number in special.items():
            self.bytes_of += [b""] * (number + 1 - len(self.bytes_of))
            self.bytes_of[number] = content.encode()
        self.special = special
        ordered = sorted(special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if special else None
        self.split = regex.compile(PIECES).findall
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        letters_of = self.first[np.arange(256)]
        self.letter_ranks = self.pair_ranks(letters_of[:, None], letters_of[None, :])
        #: Token numbers by piece, as packed 32-bit numbers.
        self.known: dict[str | int, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, ``NONE`` where a pair does not merge or a side is missing."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], NONE)

    def merge_rows(self, letters: np.ndarray, used: np.ndarray) -> np.ndarray:
        """The symbols of every row of an array of bytes, whose width is a power of two, after
        all merges; places that are not used or merged away hold -1."""
        rows, width = letters.shape
        symbols = np.where(used, self.first[letters], -1)
        bits = width.bit_length() - 1
        place = np.arange(width)
        after = np.tile(place + 1, (rows, 1))
        before = np.tile(place - 1, (rows, 1))
        tree = np.full((rows, 2 * width), NONE, dtype=np.int64)
        if width > 1:
            rank = np.where(used[:, 1:], self.letter_ranks[letters[:, :-1], letters[:, 1:]], NONE)
            tree[:, width : 2 * width - 1] = np.where(rank < NONE, (rank << bits) | place[:-1], NONE)
        for level in range(bits - 1, -1, -1):
            low, high = 1 << level, 2 << level
            tree[:, low:high] = np.minimum(tree[:, 2 * low : 2 * high : 2], tree[:, 2 * low + 1 : 2 * high : 2])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at = root & (width - 1)
            symbols[live, at] = self.result[root >> bits]
            gone = after[live, at]
            symbols[live, gone] = -1
            far = after[live, gone]
            after[live, at] = far
            inside = far < width
            before[live[inside], far[inside]] = at[inside]
            prior = before[live, at]
            self._leaf(tree, live, gone, np.full(len(live), NONE), bits)
            right = np.where(inside, symbols[live, np.minimum(far, width - 1)], -1)
            self._leaf(tree, live, at, self.pair_ranks(symbols[live, at], right), bits)
            has = prior >= 0
            rows_left, place_left = live[has], prior[has]
            rank = self.pair_ranks(symbols[rows_left, place_left], symbols[rows_left, at[has]])
            self._leaf(tree, rows_left, place_left, rank, bits)
            live = live[tree[live, 1] < NONE]
        return symbols

    @staticmethod
    def _leaf(tree, rows, place, rank, bits) -> None:
        """Sets one leaf in each row and renews the nodes above it."""
        tree[rows, (1 << bits) + place] = np.where(rank < NONE, (rank << bits) | place, NONE)
        node = ((1 << bits) + place) >> 1
        for _ in range(bits):
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """Merges one long piece with a tree in plain lists."""
        symbols = self.first[np.frombuffer(piece, np.uint8)].tolist()
        count = len(symbols)
        width = 1 << (count - 1).bit_length()
        none = (len(self.result), width)
        ranks, result = self.rank_of, self.result.tolist()
        tree = [none] * (2 * width)
        for i in range(count - 1):
            tree[width + i] = (ranks.get((symbols[i] << 20) | symbols[i + 1], none[0]), i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))

        def leaf(i: int, value: tuple[int, int]) -> None:
            node = width + i
            tree[node] = value
            node >>= 1
            while node:
                best = min(tree[2 * node], tree[2 * node + 1])
                tree[node] = best
                node >>= 1

        while tree[1][0] < none[0]:
            rank, i = tree[1]
            symbols[i] = result[rank]
            gone = after[i]
            symbols[gone] = -1
            far = after[i] = after[gone]
            leaf(gone, none)
            if far < count:
                before[far] = i
                leaf(i, (ranks.get((symbols[i] << 20) | symbols[far], none[0]), i))
            else:
                leaf(i, none)
            j = before[i]
            if j >= 0:
                leaf(j, (ranks.get((symbols[j] << 20) | symbols[i], none[0]), j))
        return tuple(s for s in symbols if s >= 0)

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces and remembers them."""
        raw = [p.encode("utf-8") for p in pieces]
        size = np.array([len(b) for b in raw])
        width = 1
        while width <= SHARED_BYTES:
            fits = np.flatnonzero((size <= width) & (size > width // 2))
            step = CELLS // width
            for low in range(0, len(fits), step):
                self._learn_rows([pieces[i] for i in fits[low : low + step]],
                                 [raw[i] for i in fits[low : low + step]], width)
            width *= 2
        for i in np.flatnonzero(size > SHARED_BYTES):
            self.known[pieces[i]] = np.array(self.merge_long(raw[i]), dtype=np.int32).tobytes()

    def _learn_rows(self, pieces: list[str], raw: list[bytes], width: int) -> None:
        used = np.arange(width) < np.array([len(b) for b in raw])[:, None]
        letters = np.zeros((len(raw), width), dtype=np.uint8)
        letters[used] = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.merge_rows(letters, used)
        live = symbols >= 0
        flat, ends = symbols[live].astype(np.int32).tobytes(), np.cumsum(live.sum(axis=1)) * 4
        low = 0
        for piece, high in zip(pieces, ends.tolist(), strict=True):
            self.known[piece] = flat[low:high]
            low = high

    def pieces(self, text: str) -> list:
        """The pieces of a text; a special token is its number."""
        if self.cut is None or not self.cut.search(text):
            return self.split(text)
        out: list = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(self.special[part])
            else:
                out += self.split(part)
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The token numbers of each text."""
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set(chain.from_iterable(cut)).difference(self.known)
        numbers = [p for p in new if isinstance(p, int)]
        new.difference_update(numbers)
        self.learn(list(new))
        self.known.update({n: np.int32(n).tobytes() for n in numbers})
        find = self.known.__getitem__
        for pieces in cut:
            yield np.frombuffer(b"".join(map(find, pieces)), np.int32)

    def decode(self, numbers: list[int]) -> bytes:
        """The bytes of a list of token numbers."""
        return b"".join(map(self.bytes_of.__getitem__, numbers))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, loaded once in each worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def text_groups(column: pa.Array, limit: int = 2 << 20) -> Iterator[list[str]]:
    """Texts of a column, null as empty, in lists of about ``limit`` bytes."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    group = np.cumsum(size) // limit
    edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(column)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        if low < high:
            yield [t or "" for t in column.slice(low, high - low).to_pylist()]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: the token numbers of each text, for each row of ``docs``.

    They are those of the tokenizer in the file ``path`` without added special tokens; a
    special token's own string in a text is that token. Null counts as empty, an empty text
    has no tokens, and ids may repeat or be null. Only the two columns are read.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            low = 0
            for texts in text_groups(batch.column(1)):
                rows = list(coder.encode(texts))
                edges = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                flat = np.concatenate(rows)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(texts)), lists], names=["id", "ids"]
                )
                low += len(texts)
        coder.known.clear()

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, ids array<int>"
    )


def _number_lists(column: pa.Array) -> Iterator[list[int]]:
    flat, edges = np.asarray(column.values), np.asarray(column.offsets).tolist()
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield flat[low:high].tolist()


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """``(id, text)`` from ``(id, ids)``; bytes that are no UTF-8 become U+FFFD."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts = [coder.decode(n).decode("utf-8", "replace") for n in _number_lists(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=["id", "text"]
            )

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "ids").mapInArrow(run, f"id {kind}, text string")


def _digests(coder: Codec, numbers: list[int]) -> tuple[int, str, str]:
    joined = ",".join(map(coder.decimal.__getitem__, numbers))
    text = coder.decode(numbers).decode("utf-8", "replace")
    sha = hashlib.sha256
    return len(numbers), sha(joined.encode()).hexdigest(), sha(text.encode()).hexdigest()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest_batch(ids: pa.Array, rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    count, numbers, texts = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(count, pa.int64()), pa.array(numbers, pa.string()), pa.array(texts, pa.string())],
        names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def digests(tokens: DataFrame, path: str) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` from ``(id, ids)``: hex digests of the
    decimal numbers joined by commas and of the decoded text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            rows = [_digests(coder, n) for n in _number_lists(batch.column(1))]
            yield _digest_batch(batch.column(0), rows)

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "ids").mapInArrow(run, f"id {kind}, {DIGESTS}")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same for texts: what ``digests(encoded(docs))`` returns, in one pass and one worker.
    Every text is encoded, and its numbers are decoded."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            low = 0
            for texts in text_groups(batch.column(1)):
                rows = [_digests(coder, numbers.tolist()) for numbers in coder.encode(texts)]
                yield _digest_batch(batch.column(0).slice(low, len(texts)), rows)
                low += len(texts)
        coder.known.clear()

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, {DIGESTS}"
    )
