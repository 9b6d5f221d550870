"""Toxicity scores from a counterfactually regularised classifier.

Features are the words of the whole text (letters and digits, A-Z
lower-cased) and their first four, five and six bytes, hashed to 2**22
places, each counted once a text. The classifier is logistic. It is trained
on labelled texts together with counterfactuals: the identity terms of a
sentence are swapped for each of the others of their groups, and the squared
change of the text's score is part of the loss. So identity terms by
themselves get no weight, however the labels lean, and neutral mentions of a
group are not held against a text.

Labels are learned from a bounded sample of labelled rows (MAX_TRAINING_ROWS,
by hash of the doc_id; equal texts of one id count once); its ids are small
enough to be sent to the scan. The text itself never moves. Every feature of the sample that leans to either
label by LEAN standard errors is weighed, so their number is bounded by the
sample's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .textkit import ALNUM, LOWER, U64, run_hashes, slices, word_bounds

MAX_TRAINING_ROWS = 20_000
#: Standard errors by which a feature has to lean to a label to be weighed.
LEAN = 2.5
THRESHOLD = 0.3
PENALTY = 1.0
PLACES = 22
PREFIXES = (4, 5, 6)

# Groups of identity terms; a term is swapped within its group.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("she", "he"), ("gay", "straight", "lesbian", "bisexual"), ("trans", "cis"),
    ("black", "white", "asian", "latino"), ("muslim", "christian", "jewish", "hindu", "buddhist"), ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("immigrants", "natives"), ("disabled", "abled"), ("old", "young"), ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"),
)


def _features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every word and word beginning, with repeats."""
    low = LOWER[data]
    starts, ends, rows = word_bounds(data, offs, ALNUM)
    out_rows, out = [rows], [run_hashes(low, starts, ends)]
    for k in PREFIXES:
        long = ends - starts >= k
        out_rows.append(rows[long])
        out.append(run_hashes(low, starts[long], starts[long] + k) ^ np.full(1, k * 0x9E3779B97F4A7C15 % (1 << 64), U64))
    return np.concatenate(out_rows), (np.concatenate(out) >> U64(64 - PLACES)).astype(np.int64)


def _of_word(word: str) -> list[int]:
    data = np.frombuffer(word.encode(), np.uint8)
    return np.unique(_features(data, np.array([0, len(data)]))[1]).tolist()


_TERMS = [(g, w) for g, group in enumerate(IDENTITIES) for w in group]
_TERM_HASHES = np.array([run_hashes(d, np.array([0]), np.array([len(d)]))[0] for d in (np.frombuffer(w.encode(), np.uint8) for _, w in _TERMS)], U64)
_TERM_ORDER = np.argsort(_TERM_HASHES)


_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n\r")] = True


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct places of labelled texts, and their identity terms by sentence (number of the sentence times all terms, plus the term)."""
    for batch in batches:
        for row, data, offs in slices(batch.column("text")):
            n = len(offs) - 1
            rows, places = _features(data, offs)
            both = np.unique((rows << PLACES) | places)
            starts, ends, of = word_bounds(data, offs, ALNUM)
            words = run_hashes(LOWER[data], starts, ends)
            near = _TERM_ORDER[np.minimum(np.searchsorted(_TERM_HASHES[_TERM_ORDER], words), len(_TERM_ORDER) - 1)]
            hit = _TERM_HASHES[near] == words
            # sentences counted over the slice, then from each text's first
            told = np.concatenate(([0], np.cumsum(_STOP[data])))
            sentence = told[starts[hit]] - told[offs[of[hit]]]
            terms = np.unique((of[hit] << 40) + sentence * len(_TERMS) + near[hit])

            def lists(keys: np.ndarray, values: np.ndarray, n: int = n) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.searchsorted(keys, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int32()))

            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(row, n) for c in ("toxic", "doc_id", "copy")), lists(both >> PLACES, both & ((1 << PLACES) - 1)), lists(terms >> 40, terms & ((1 << 40) - 1))],
                ["toxic", "doc_id", "copy", "places", "terms"],
            )


def _narrowed(sent):
    """The described texts with the numbers of their chosen features in place of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                lists = part.column("places")
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                at = np.minimum(np.searchsorted(chosen, values), len(chosen) - 1)
                hit = chosen[at] == values
                kept = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[hit], np.arange(part.num_rows + 1)), pa.int32()), pa.array(at[hit], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), kept, part.column("terms")], ["toxic", "places", "terms"])

    return run


class Model:
    """Weights of places, and the intercept."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, intercept: float):
        self.places, self.weights, self.intercept = places, weights, intercept

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probability of toxicity of each text of a slice."""
        rows, places = _features(data, offs)
        z = np.full(len(offs) - 1, self.intercept)
        if len(self.places):
            at = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
            hit = self.places[at] == places
            both = np.unique(rows[hit] * len(self.places) + at[hit])
            z += np.bincount(both // len(self.places), self.weights[both % len(self.places)], minlength=len(z))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _train(labels: np.ndarray, row: np.ndarray, col: np.ndarray, swapped: tuple[np.ndarray, np.ndarray, np.ndarray], n_features: int, penalty: float = PENALTY, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights by Adam on the whole sample.

    swapped holds (row, column, change) of the counterfactuals; a score moves
    by the sum of change * weight, which the loss squares, in the mean over
    counterfactuals and ``penalty`` times as much as the mean over texts.
    """
    n, counters = len(labels), int(swapped[0].max(initial=-1)) + 1
    prior = (labels.sum() + 0.5) / (n + 1)
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    s_row, s_col, s_change = swapped
    for step in range(1, steps + 1):
        z = b + np.bincount(row, w[col], minlength=n)
        g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
        grad = np.bincount(col, g[row], minlength=n_features) / n + 1e-4 * w
        if counters:
            moved = np.bincount(s_row, w[s_col] * s_change, minlength=counters)
            grad += 2 * penalty / counters * np.bincount(s_col, moved[s_row] * s_change, minlength=n_features)
        grad = np.append(grad, g.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, penalty: float = PENALTY) -> Model:
    """The classifier of the labelled rows of docs; without any, every score is near 0."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~is_held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # max_rows ids: small enough to broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.withColumn("copy", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    described = materialize(texts.select("toxic", "doc_id", "copy", "text").mapInArrow(_described, "toxic int, doc_id long, copy string, places array<int>, terms array<int>"), "described")
    # an id may have many rows: a text of an id counts once, and the texts are bounded as the ids are
    kept = described.select("doc_id", "copy").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "copy").limit(max_rows)
    rows = described.join(F.broadcast(kept), ["doc_id", "copy"], "left_semi").dropDuplicates(["doc_id", "copy"])
    rows = materialize(rows.select("toxic", "places", "terms"), "labelled")

    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    pos, neg = totals["toxic"], totals["n"] - totals["toxic"]
    if not totals["n"]:
        return Model(np.zeros(0, np.int64), np.zeros(0), -20.0)
    counts = rows.select("toxic", F.explode("places").alias("place")).groupBy("place").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (pos - F.col("p") + 0.5)) - F.log((F.col("q") + 0.5) / (neg - F.col("q") + 0.5))
    strength = F.abs(odds) / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    chosen = counts.select("place", strength.alias("z")).where(F.col("z") >= LEAN)
    places = np.unique(chosen.select("place").toArrow().column("place").to_numpy()).astype(np.int64)  # features of max_rows texts
    terms = [_of_word(w) for _, w in _TERMS]
    places = np.unique(np.concatenate((places, *(np.array(t, np.int64) for t in terms))))

    sent = docs.sparkSession.sparkContext.broadcast(places)  # features of max_rows texts, and the identity terms'
    got = rows.mapInArrow(_narrowed(sent), "toxic int, places array<int>, terms array<int>").toArrow()  # bounded by max_rows
    labelled = got.column("toxic").to_numpy().astype(float)
    lists = got.column("places").combine_chunks()
    row = np.repeat(np.arange(len(labelled)), np.diff(lists.offsets.to_numpy()))
    col = lists.values.to_numpy().astype(np.int64)
    swapped = _swaps(got.column("terms").to_pylist(), terms, places)
    weights, intercept = _train(labelled, row, col, swapped, len(places), penalty)
    return Model(places, weights, intercept)


def _swaps(found: list[list[int]], terms: list[list[int]], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, change) of the counterfactuals, a row each: a sentence's identity terms swapped for another of their groups.

    found holds each text's terms by sentence. A feature that another sentence
    of the text also has does not go, and does not come.
    """
    groups = {t: [i for i, (g, _) in enumerate(_TERMS) if g == _TERMS[t][0]] for t in range(len(_TERMS))}
    row, col, change, n = [], [], [], 0
    for listed in found:
        sentences: dict[int, set[int]] = {}
        for code in listed:
            sentences.setdefault(code // len(_TERMS), set()).add(code % len(_TERMS))
        for number, present in sentences.items():
            stay = {p for other, held in sentences.items() if other != number for t in held for p in terms[t]}
            gone = {p for t in present for p in terms[t]} - stay
            for turn in range(1, max(len(groups[t]) for t in present)):
                come = {p for t in present for p in terms[groups[t][(groups[t].index(t) + turn) % len(groups[t])]]} - stay
                for sign, some in ((-1.0, gone - come), (1.0, come - gone)):
                    row += [n] * len(some)
                    col += np.searchsorted(places, sorted(some)).tolist()
                    change += [sign] * len(some)
                n += 1
    return np.array(row, np.int64), np.array(col, np.int64), np.array(change)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "_scored"]
            for row, data, offs in slices(batch.column("_scored")):
                n = len(offs) - 1
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, n) for c in rest), pa.array(model.value.scores(data, offs))], [*rest, "_score"])

    return run


def with_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the score of the whole text; a null text is scored as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each feature of max_rows texts
    aside = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)), F.col("text").cast("string").alias("_scored"))
    schema = ", ".join([*(f"_{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes)), "_score double"])
    return aside.mapInArrow(_scored(sent), schema).toDF(*docs.columns, name)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    predicted is 1 from a score of THRESHOLD. Labels of held-out rows are not
    learned; a doc_id labelled twice counts as toxic if either label does.
    Without labels every score is near 0. A row without doc_id is scored and
    not held out. Repeated rows are each returned; columns of docs other than
    doc_id and text are not read.
    """
    model = fit(docs, labels)
    scored = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
