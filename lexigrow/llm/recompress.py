"""Removal of long word sequences that occur earlier in the corpus, by recompression.

Every text is a string of word names. A round of recompression gives names to runs of one
symbol and to pairs of neighbouring symbols (one from each half of the alphabet, dealt anew
each round). A name is a fingerprint of what it stands for, so equal substrings get equal
interior symbols in every task, and no dictionary has to be shared. What differs between two
occurrences lies within ``2 ** rounds`` words of their ends: a round can lose one symbol there.

A *cut* is a word where a symbol of the last round starts, or that lies in a run. Equal windows
of ``window`` words therefore share a cut within their first ``2 ** rounds`` words, and with it
the *anchor*: the name of the ``window - 2 ** rounds`` words that follow. So

1. anchors are exchanged by name; those that occur twice reveal where windows may repeat;
2. only windows there are named by 96 bits and exchanged; the earliest of each name stays;
3. each text gets its list of repeated windows back and loses the words they cover.

In both exchanges a task sends one entry for each name in two megabytes of text, however often
it occurs there, so a passage that very many documents share makes no large group. Entries
travel packed in arrays, a row for each bucket of names; buckets grow in number with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrow.llm.store import measured, parts, small_batches
from lexigrow.llm.words import U, hashed_words, mix, powers, text_slices, tidy

#: Text that is named and thinned out at once, and text for each bucket of names, in bytes.
STEP, BUCKET = 2 << 20, 24 << 20
LAST_ID = np.iinfo(np.int64).max

PACKED = pa.schema(
    [
        ("bucket", pa.int32()),
        ("ids", pa.binary()),
        ("prints", pa.binary()),
        ("counts", pa.binary()),
        ("places", pa.binary()),
        ("names", pa.binary()),
        ("tails", pa.binary()),
    ]
)
PACKED_DDL = (
    "bucket int, ids binary, prints binary, counts binary, places binary, names binary, "
    "tails binary"
)
FOUND = pa.schema(
    [("home", pa.int32())] + [(n, pa.binary()) for n in ("ids", "prints", "counts", "places")]
)
FOUND_DDL = "home int, ids binary, prints binary, counts binary, places binary"
SPANS = pa.schema([("id", pa.int64()), ("print", pa.int64()), ("spans", pa.binary())])
SPANS_DDL = "id long, print long, spans binary"


def rounds_for(window: int) -> int:
    """The most rounds, at most 4, that leave equal windows a common anchor."""
    rounds = 0
    while rounds < 4 and 2 ** (rounds + 2) < window:
        rounds += 1
    return rounds


def cuts(words: np.ndarray, first: np.ndarray, rounds: int) -> np.ndarray:
    """Marks the cuts in the words of several texts; ``first`` has each text's first word."""
    n = len(words)
    if not rounds or not n:
        return np.ones(n, dtype=bool)
    head = np.zeros(n + 1, dtype=bool)
    head[first] = True
    equal = (words[1:] == words[:-1]) & ~head[1:n]
    in_run = np.zeros(n, dtype=bool)
    in_run[1:] |= equal
    in_run[:-1] |= equal
    # Runs first: a symbol for each run, named by word and length.
    at = np.flatnonzero(np.concatenate(([True], ~equal)))
    length = np.diff(np.append(at, n))
    symbol = np.where(length > 1, mix(words[at] + length.astype(U) * U(0x9E3779B97F4A7C15)), words[at])
    for k in range(rounds):
        right = (mix(symbol ^ U(0xA0761D6478BD642F + k)) >> U(63)).astype(bool)
        pair = ~right[:-1] & right[1:] & ~head[at[1:]]
        lead = np.flatnonzero(pair)
        symbol = symbol.copy()
        symbol[lead] = mix(symbol[lead] * U(0xE7037ED1A0B428DB) + symbol[lead + 1] + U(k))
        stay = np.ones(len(symbol), dtype=bool)
        stay[lead + 1] = False
        symbol, at = symbol[stay], at[stay]
    in_run[at] = True
    return in_run


def sequence_names(words: np.ndarray, starts: np.ndarray, length: int, salt: int) -> np.ndarray:
    """Names of the ``length`` words from each start."""
    power, inverse = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=U)
    np.cumsum(mix(words ^ U(salt)) * power[: len(words)], out=total[1:])
    return mix((total[starts + length] - total[starts]) * inverse[starts])


def _pack(bucket: int, ids, prints, row, places, names, tails) -> list:
    """One packed row; entries are in order of their text ``row``."""
    lead = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    counts = np.diff(np.append(lead, len(row))).astype(np.uint32)
    return [
        bucket,
        ids[row[lead]].tobytes(),
        prints[row[lead]].tobytes(),
        counts.tobytes(),
        _planes(places),
        names.tobytes(),
        tails.tobytes(),
    ]


def _planes(places: np.ndarray) -> bytes:
    """Steps between places by byte rank, so that the mostly empty upper bytes compress."""
    step = np.diff(places.astype(np.uint32), prepend=np.uint32(0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    step = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T)
    return np.cumsum(step.view(np.uint32).ravel(), dtype=np.uint32)


def _batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, PACKED, strict=True)], schema=PACKED
    )


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if edge[b] < edge[b + 1]:
            yield b, order[edge[b] : edge[b + 1]]


def _anchors(window: int, buckets: int):
    """Maps texts to packed anchors. ``tails`` says which entries want an answer; bucket
    numbers from ``buckets`` on hold anchors already known to repeat."""
    rounds = rounds_for(window)
    reach = window - (2**rounds if rounds else 0)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for start, _, data, offsets in text_slices(batch.column(2), STEP):
                words, first = hashed_words(data, offsets, lower=False)
                if len(words) < window:
                    continue
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                long = np.diff(first) >= window
                at = np.flatnonzero(cuts(words, first, rounds) & long[row])
                at = at[at + reach <= first[row[at] + 1]]
                if not len(at):
                    continue
                name = sequence_names(words, at, reach, 0x1D8E4E27C47D124F)
                _, lead, group, count = np.unique(
                    name, return_index=True, return_inverse=True, return_counts=True
                )
                again = count[group] > 1
                place = (at - first[row[at]]).astype(np.uint32)
                out = []
                known = np.flatnonzero(again)
                if len(known):
                    spread = buckets + int(name[0] % U(buckets))
                    out.append(
                        _pack(spread, ids[start:], prints[start:], row[at[known]], place[known],
                              np.zeros(0, U), np.zeros(0, np.uint8))
                    )
                lead.sort()
                bucket = ((name[lead] >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
                for b, pick in _by_bucket(bucket, buckets):
                    pick = lead[pick]
                    out.append(
                        _pack(b, ids[start:], prints[start:], row[at[pick]], place[pick],
                              name[pick].astype(np.uint32), (~again[pick]).astype(np.uint8))
                    )
                yield _batch(out)

    return run


def _entries(table: pa.Table, kind: type) -> tuple[np.ndarray, ...]:
    """All entries of packed rows: id, print, place, name, tail."""
    names = b"".join(table.column("names").to_pylist())
    tails = b"".join(table.column("tails").to_pylist())
    return (
        *_texts_entries(table),
        np.frombuffer(names, np.uint32 if kind is np.uint8 else U),
        np.frombuffer(tails, kind),
    )


def _homeward(ids: np.ndarray, prints: np.ndarray, places: np.ndarray, homes: int) -> pa.Table:
    """Entries packed for the groups that put texts together, a row for each."""
    key = mix((ids ^ (prints << 1)).astype(U))
    home = ((key >> U(32)) * U(homes) >> U(32)).astype(np.int32)
    out: list[list] = []
    for h, pick in _by_bucket(home, homes):
        i, p = ids[pick], prints[pick]
        new = np.concatenate(([True], (i[1:] != i[:-1]) | (p[1:] != p[:-1])))
        lead = np.flatnonzero(new)
        counts = np.diff(np.append(lead, len(pick))).astype(np.uint32)
        out.append([h, i[lead].tobytes(), p[lead].tobytes(), counts.tobytes(), _planes(places[pick])])
    columns = list(zip(*out, strict=True)) or [[]] * len(FOUND)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def _texts_entries(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Id, print and place of all entries of packed rows."""
    column = lambda name: table.column(name).to_pylist()
    counts = np.frombuffer(b"".join(column("counts")), np.uint32)
    ids = np.repeat(np.frombuffer(b"".join(column("ids")), np.int64), counts)
    prints = np.repeat(np.frombuffer(b"".join(column("prints")), np.int64), counts)
    return ids, prints, np.concatenate([_unplanes(x) for x in column("places")])


def _repeated_anchors(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= buckets:
            return _homeward(*_texts_entries(table), buckets)
        ids, prints, places, names, wants = _entries(table, np.uint8)
        order = np.argsort(names, kind="stable")
        equal = names[order][1:] == names[order][:-1]
        twice = np.zeros(len(names), dtype=bool)
        twice[order[1:]] |= equal
        twice[order[:-1]] |= equal
        pick = twice & (wants == 1)
        return _homeward(ids[pick], prints[pick], places[pick], buckets)

    return run


def _spans(before: int, after: int):
    """Merges the ranges [place - before, place + after) of each text's places; packed pairs."""

    def run(table: pa.Table) -> pa.Table:
        ids, prints, places = _texts_entries(table)
        order = np.lexsort((places, prints, ids))
        ids, prints, places = ids[order], prints[order], places[order].astype(np.int64)
        other = np.concatenate(([True], (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])))
        low, high = np.maximum(places - before, 0), places + after
        edge = np.flatnonzero(other | np.concatenate(([True], low[1:] > high[:-1])))
        spans = np.stack([low[edge], high[np.append(edge[1:], len(low)) - 1]], axis=1)
        lead = np.flatnonzero(other)
        cuts_at = np.append(np.searchsorted(edge, lead), len(edge)) * 16
        blob = pa.Array.from_buffers(
            pa.binary(),
            len(lead),
            [None, pa.py_buffer(cuts_at.astype(np.int32).tobytes()), pa.py_buffer(spans.tobytes())],
        )
        return pa.table([pa.array(ids[lead]), pa.array(prints[lead]), blob], schema=SPANS)

    return run


def _covered(spans: np.ndarray, owner: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Marks words inside spans, which are relative to the texts ``owner``."""
    step = np.zeros(n + 1, dtype=np.int64)
    base, top = first[owner], first[owner + 1]
    np.add.at(step, np.minimum(base + spans[:, 0], top), 1)
    np.add.at(step, np.minimum(base + spans[:, 1], top), -1)
    return np.cumsum(step[:-1]) > 0


def _span_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    blobs = [x or b"" for x in column.to_pylist()]
    owner = np.repeat(np.arange(len(blobs)), [len(b) // 16 for b in blobs])
    return np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2), owner


def _windows(window: int, buckets: int):
    """Maps texts with suspect starts to packed windows, the earliest of each name in a step;
    later ones are known to repeat and go to bucket numbers from ``buckets`` on."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for start, stop, data, offsets in text_slices(batch.column(2), STEP):
                words, first = hashed_words(data, offsets, lower=False)
                spans, owner = _span_rows(batch.column(3).slice(start, stop - start))
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                at = np.flatnonzero(_covered(spans, owner, first, len(words)))
                at = at[at + window <= first[row[at] + 1]]
                if not len(at):
                    continue
                name = sequence_names(words, at, window, 0x2545F4914F6CDD1D)
                tail = (sequence_names(words, at, window, 0x60BEE2BEE120FC15) >> U(32)).astype(np.uint32)
                place = (at - first[row[at]]).astype(np.int64)
                own = ids[start:][row[at]]
                order = np.lexsort((place, own, tail, name))
                later = _later(order, name, tail, own, place)
                out = []
                known = np.flatnonzero(later)
                if len(known):
                    spread = buckets + int(name[0] % U(buckets))
                    out.append(
                        _pack(spread, ids[start:], prints[start:], row[at[known]], place[known],
                              np.zeros(0, U), np.zeros(0, np.uint32))
                    )
                lead = np.flatnonzero(~later)
                bucket = ((name[lead] >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
                for b, pick in _by_bucket(bucket, buckets):
                    pick = lead[pick]
                    out.append(
                        _pack(b, ids[start:], prints[start:], row[at[pick]], place[pick],
                              name[pick], tail[pick])
                    )
                yield _batch(out)

    return run


def _later(order, name, tail, ids, place) -> np.ndarray:
    """Marks entries after the first of their name by (id, place); ties with it stay."""
    n, t, i, p = name[order], tail[order], ids[order], place[order]
    new = np.concatenate(([True], (n[1:] != n[:-1]) | (t[1:] != t[:-1])))
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.zeros(len(order), dtype=bool)
    out[order] = (i != i[lead]) | (p != p[lead])
    return out


def _repeated_windows(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= buckets:
            return _homeward(*_texts_entries(table), buckets)
        ids, prints, places, names, tails = _entries(table, np.uint32)
        order = np.lexsort((places, ids, tails, names))
        pick = _later(order, names, tails, ids, places)
        return _homeward(ids[pick], prints[pick], places[pick], buckets)

    return run


def _cleaned(as_it_was: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.slice(low, 1000)
                spans = part.column(2).to_pylist()
                counts, removed, texts = [], [], []
                for text, blob in zip(part.column(1).to_pylist(), spans, strict=True):
                    words = text.encode().split()
                    counts.append(len(words))
                    if blob:
                        gone = np.zeros(len(words), dtype=bool)
                        for a, b in np.frombuffer(blob, np.int64).reshape(-1, 2).tolist():
                            gone[a:b] = True
                        removed.append(int(gone.sum()))
                        words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                    else:
                        removed.append(0)
                    texts.append(text if as_it_was and not blob else b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(texts, pa.string()), part.column(3)],
                    names=["id", "n_words", "n_removed", "kept_text", "row"],
                )

    return run


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 20,
    carry: list[str] | None = None,
    as_it_was: bool = False,
) -> DataFrame:
    """``(id, n_words, n_removed, kept_text, row)``: one row for each row of ``docs``.

    A word goes if it lies in a window of ``window`` consecutive words whose sequence also
    starts earlier: in a document of smaller id, or before it in the same document. Windows are
    judged on the texts as given. ``kept_text`` holds the other words, joined by one space;
    with ``as_it_was`` a text that loses nothing stays the same in all its characters.
    ``row`` is a struct of the columns ``carry`` (null without any), so that no name clashes.

    Null and empty texts have no words. Rows without an id come after all ids and are told
    apart by place alone. Rows that repeat an id and a text keep what the first of them keeps;
    windows of equal id and place never remove each other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()["n"] or 0
    buckets = parts(spark, 1 + int(size) // BUCKET)
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"),
        F.xxhash64(text).alias("print"),
        text.alias("text"),
        F.col(id_col).cast("long").alias("own"),
        (F.struct(*carry) if carry else F.lit(None).cast("int")).alias("row"),
    )
    plain = base.select("id", "print", "text")
    rounds = rounds_for(window)
    revealed = (
        plain.mapInArrow(_anchors(window, buckets), PACKED_DDL)
        .groupBy("bucket")
        .applyInArrow(_repeated_anchors(buckets), FOUND_DDL)
        .groupBy("home")
        .applyInArrow(_spans(2**rounds if rounds else 0, 1), SPANS_DDL)
    )
    suspects = plain.join(measured(revealed), ["id", "print"])
    repeats = (
        suspects.select("id", "print", "text", "spans")
        .mapInArrow(_windows(window, buckets), PACKED_DDL)
        .groupBy("bucket")
        .applyInArrow(_repeated_windows(buckets), FOUND_DDL)
        .groupBy("home")
        .applyInArrow(_spans(0, window), SPANS_DDL)
    )
    marked = base.join(measured(repeats), ["id", "print"], "left")
    kind = base.schema["row"].dataType.simpleString()
    return marked.select(F.col("own").alias("id"), "text", "spans", "row").mapInArrow(
        _cleaned(as_it_was), f"id long, n_words long, n_removed long, kept_text string, row {kind}"
    )
