"""A toxicity classifier that does not lean on who a sentence is about.

Features are the distinct words of a text and their first 4, 5 and 6 bytes, hashed to
``2 ** BITS`` numbers. From a sample of labelled texts, features are chosen that speak for the
label (log odds at least 1, by at least five standard errors), plus all features of the
identity terms. A logistic regression on these is fitted with a counterfactual penalty: every
labelled sentence that names an identity term is copied with another term in its place, and the
squared difference between the two scores is added to the loss. What the label owes to the
mere mention of a group is thereby not learnt, and neutral mentions are not rejected.

Text is read once for the sample and once for scoring; the weights are one fixed-size array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrow.llm.store import kept, small_batches
from lexigrow.llm.words import LOWER, U, give_back, span_hashes, text_slices, tidy, word_spans

BITS = 18
PREFIXES = (4, 5, 6)
#: Labelled texts that the classifier is fitted on, about, and the most features it uses.
FIT_ROWS, MOST_FEATURES = 20_000, 16_384
IDENTITY_TERMS = (
    "women", "men", "muslims", "christians", "jews", "atheists", "immigrants", "refugees",
    "blacks", "whites", "asians", "gays", "lesbians", "transgender", "disabled", "elderly",
)


@dataclass
class Model:
    """Weights by hashed feature, and the constant."""

    weights: np.ndarray
    constant: float


def _slots(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row for each kind of feature, a column for each word; -1 where there is none."""
    rows = [(span_hashes(data, starts, ends) >> U(64 - BITS)).astype(np.int64)]
    for size in PREFIXES:
        part = span_hashes(data, starts, np.minimum(starts + size, ends)) ^ U(size << 48)
        slot = (part >> U(64 - BITS)).astype(np.int64)
        rows.append(np.where(ends - starts >= size, slot, -1))
    return np.stack(rows)


def text_features(text: str) -> np.ndarray:
    """The distinct features of one text."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    found = np.unique(_slots(data, starts, ends))
    return found[found >= 0]


def _batch_features(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets)
        slots = _slots(data, starts, ends)
        for i in range(len(first) - 1):
            found = np.unique(slots[:, first[i] : first[i + 1]])
            yield found[found >= 0]


@tidy
def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of texts with each feature, by label, of one partition: a row for each
    feature seen."""
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        labels = np.asarray(batch.column(1))
        for label, features in zip(labels, _batch_features(batch.column(0)), strict=True):
            counts[label, features] += 1
    seen = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen), pa.array(counts[0, seen]), pa.array(counts[1, seen])],
        names=["feature", "n0", "n1"],
    )


def _swapped(text: str, terms: tuple[str, ...]) -> str | None:
    """The text with each identity term replaced by the next one of the list."""
    words = text.lower().split(" ")
    place = {t: i for i, t in enumerate(terms)}
    hits = [i for i, w in enumerate(words) if w in place]
    if not hits:
        return None
    shift = 1 + len(words) % max(1, len(terms) - 1)
    for i in hits:
        words[i] = terms[(place[words[i]] + shift) % len(terms)]
    return " ".join(words)


def _examples(chosen: np.ndarray, terms: tuple[str, ...]):
    """Chosen features of each labelled text and of its counterfactual copy."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = np.zeros(1 << BITS, dtype=bool)
        use[chosen] = True
        for batch in batches:
            own = [f[use[f]] for f in _batch_features(batch.column(0))]
            other: list[np.ndarray | None] = []
            for text in batch.column(0).to_pylist():
                copy = _swapped(text or "", terms)
                found = None if copy is None else text_features(copy)
                other.append(None if found is None else found[use[found]])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(own, kind), pa.array(other, kind)],
                names=["label", "own", "other"],
            )

    return run


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    label_col: str = "label",
    fit_rows: int = FIT_ROWS,
    identity_terms: tuple[str, ...] = IDENTITY_TERMS,
    counterfactual: float = 1.0,
    seed: int = 0,
) -> Model:
    """Fits the classifier on labelled texts; rows without a label are left out.

    About ``fit_rows`` of them, chosen by a hash of the text, are used; the driver gets their
    chosen features only. ``counterfactual`` weighs the penalty. Without any label of 1 every
    score is 0.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(label_col).isNotNull()).select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (F.col(label_col) > 0).cast("int").alias("label"),
    )
    rows = kept(rows.withColumn("spot", F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30))))
    total = rows.count()
    if total > fit_rows:
        rows = rows.where(F.col("spot") < int((1 << 30) * fit_rows / total))
    rows = rows.select("text", "label")
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = totals.get(1, 0), totals.get(0, 0)
    weights = np.zeros(1 << BITS)
    if not positive:
        return Model(weights, -50.0)
    counts = rows.mapInArrow(_class_counts, "feature long, n0 long, n1 long")
    counts = counts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # Half a text of each kind is added to every count.
    prior = 0.5 * (negative + 1) / positive
    odds = F.log((F.col("n1") + 0.5) / F.lit(positive + 1.0)) - F.log(
        (F.col("n0") + prior) / F.lit(negative + 2 * prior)
    )
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + prior))
    telling = (
        counts.withColumn("odds", odds)
        .withColumn("z", F.col("odds") / error)
        .where("odds > 1 and z > 5 and n0 + n1 >= 8")
        .orderBy(F.desc("z"), "feature")
        .limit(MOST_FEATURES)
    )
    chosen = [r["feature"] for r in telling.select("feature").collect()]
    named = [f for t in identity_terms for f in text_features(t).tolist()]
    used = np.unique(np.array(chosen + named, dtype=np.int64))
    examples = rows.mapInArrow(
        _examples(used, identity_terms), "label int, own array<int>, other array<int>"
    ).toArrow()
    labels = np.asarray(examples.column("label")).astype(float)
    own, own_row = _flat(examples.column("own"), used)
    other, other_row = _flat(examples.column("other"), used)
    copied = np.asarray(examples.column("other").is_valid())
    w, constant = _descend(labels, own, own_row, other, other_row, copied, len(used), counterfactual)
    weights[used] = w
    return Model(weights, constant)


def _flat(column: pa.ChunkedArray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.to_pylist()
    size = [len(x) if x else 0 for x in lists]
    flat = np.array([f for x in lists if x for f in x], dtype=np.int64)
    return np.searchsorted(used, flat), np.repeat(np.arange(len(lists)), size)


def _descend(y, own, own_row, other, other_row, copied, width, penalty, rounds=300):
    """Minimises the mean log loss + penalty * mean squared score change, slightly shrunk."""
    n = len(y)
    w, constant = np.zeros(width), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    seen, seen_constant = np.full(width, 1e-8), 1e-8
    for _ in range(rounds):
        score = np.bincount(own_row, w[own], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(score + constant, -50, 50))) - y) / n
        change = np.where(copied, score - np.bincount(other_row, w[other], minlength=n), 0.0)
        pull = 2 * penalty * change / n
        step = np.bincount(own, (error + pull)[own_row], minlength=width)
        step -= np.bincount(other, pull[other_row], minlength=width)
        step += 1e-5 * w
        seen += step * step
        w -= 0.5 * step / np.sqrt(seen)
        w = np.sign(w) * np.maximum(np.abs(w) - 5e-6 / np.sqrt(seen), 0)
        seen_constant += error.sum() ** 2
        constant -= 0.5 * error.sum() / np.sqrt(seen_constant)
    return w, constant


def score(text: Column, model: Model) -> Column:
    """The score of a text column, from 0 to 1; null counts as empty, and an empty text gets
    the score of a text without any chosen feature."""
    weights, constant = model.weights.astype(np.float64), model.constant
    used = np.flatnonzero(weights)
    small = (used.astype(np.int32), weights[used])

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        table = np.zeros((1 << BITS) + 1)  # the last entry serves missing features
        table[small[0]] = small[1]
        out = np.full(len(column), constant)
        for start, stop, data, offsets in text_slices(column):
            data = LOWER[data]
            starts, ends, first = word_spans(data, offsets)
            slots = _slots(data, starts, ends)
            kind, word = np.nonzero(table[slots])
            row = np.searchsorted(first, word, "right") - 1
            both = np.unique((row << BITS) | slots[kind, word])
            gain = np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], minlength=stop - start)
            out[start:stop] += gain
        give_back()
        return pa.array(1 / (1 + np.exp(-np.clip(out, -50, 50))))

    return scored(text)


def labelled_texts(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = FIT_ROWS,
    seed: int = 0,
) -> DataFrame:
    """``(text, label)`` of about ``fit_rows`` labelled documents, chosen by a hash of the id.

    Labels are thinned out before they meet the documents, so their side of the join is
    bounded by ``fit_rows`` and no text moves. Of several labels of one id the largest counts.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    total = known.count()
    share = min(1.0, fit_rows / total) if total else 1.0
    spot = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30))
    some = known.where(spot < int((1 << 30) * share)).groupBy(id_col).agg(
        F.max(label_col).alias("__label")
    )
    some = F.broadcast(some.toDF("__id", "__label"))
    return docs.join(some, docs[id_col] == F.col("__id")).select(
        docs[text_col].alias("text"), F.col("__label").alias("label")
    )
