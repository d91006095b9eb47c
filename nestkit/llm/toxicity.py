"""Toxicity by a counterfactually regularised linear classifier.

Logistic regression over the presence of words and word beginnings. In labelled sentences that hold an identity term,
the term is swapped for another of its kind, and the squared change of the score is part of the loss, so that naming a
group does not by itself raise a score. A labelled text without such a term gets one, chosen by a hash: the change
between the text with it and the text with its swap, and between the text with it and without, are part of the loss too.
So the loss acts on every labelled text, through the terms and the word beginnings that they share with other words.
Fitting uses at most SAMPLE labelled documents (the first by a hash of their text, equal texts once); every document is
scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, small_batches, table

SAMPLE = 8_000
FEATURES = 2_000
#: A feature needs this much evidence (log-likelihood ratio) and this many documents.
EVIDENCE, LEAST_DOCS = 10.0, 3
PENALTY, SWAP_PENALTY, STEPS = 1e-4, 10.0, 400
REMEMBERED = 300_000
#: Words that fit() counts at a time.
WORDS = 250_000
STRIP = ".,;:!?\"'()[]{}<>*&%$#|~`“”„«»…-–—"
#: Neutral names of groups; a term is swapped for the next of its line.
IDENTITY = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslim", "jewish", "christian", "hindu", "buddhist", "atheist"],
    ["muslims", "jews", "christians", "hindus", "buddhists", "atheists"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["immigrants", "natives", "refugees", "foreigners"],
    ["old", "young", "disabled", "deaf", "blind"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "juden", "christen", "hindus", "buddhisten", "atheisten"],
    ["schwule", "lesben", "heterosexuelle", "bisexuelle"],
    ["einwanderer", "einheimische", "flüchtlinge", "ausländer"],
    ["alte", "junge", "behinderte", "gehörlose", "blinde"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulmans", "juifs", "chrétiens", "hindous", "bouddhistes", "athées"],
    ["homosexuels", "lesbiennes", "hétérosexuels", "bisexuels"],
    ["immigrés", "natifs", "réfugiés", "étrangers"],
    ["vieux", "jeunes", "handicapés", "sourds", "aveugles"],
    ["mujeres", "hombres", "niñas", "niños"],
    ["musulmanes", "judíos", "cristianos", "hindúes", "budistas", "ateos"],
    ["gais", "lesbianas", "heterosexuales", "bisexuales"],
    ["inmigrantes", "nativos", "refugiados", "extranjeros"],
    ["ancianos", "jóvenes", "discapacitados", "sordos", "ciegos"],
]
SWAP: dict[str, str] = {}
for _line in IDENTITY:
    for _i, _w in enumerate(_line):
        SWAP.setdefault(_w, _line[(_i + 1) % len(_line)])  # a word of two lines belongs to the first
TERMS = sorted(SWAP)


def word_features(word: str) -> list[str]:
    """The word, and its first four to six letters where it has more."""
    return [f"={word}", *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) > k)]


def words_of(text: str | None) -> set[str]:
    return {w for t in set((text or "").lower().split()) if (w := t.strip(STRIP))}


def swapped_words(text: str | None) -> set[str]:
    """Words of the text after each identity term in it is swapped; the other sentences stay as they are."""
    out: set[str] = set()
    for sentence in re.split(r"(?<=[.!?])\s+|\n", (text or "").lower()):
        out |= {SWAP.get(w, w) for w in words_of(sentence)}
    return out


def inserted_term(text: str | None) -> str:
    """The term that a text without one gets."""
    return TERMS[xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) % len(TERMS)]


class Model:
    """Weights of features; picklable and of at most FEATURES entries besides the identity terms."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.cache = weights, bias, {}

    def score(self, text: str | None) -> float:
        found: set[str] = set()
        cache = self.cache
        for token in set((text or "").lower().split()):
            hit = cache.get(token)
            if hit is None:
                w = token.strip(STRIP)
                hit = cache[token] = tuple(f for f in word_features(w) if f in self.weights) if w else ()
            if hit:
                found.update(hit)
        if len(cache) > REMEMBERED:
            cache.clear()
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-min(35.0, max(-35.0, z)))))


def _blocks(vocabulary: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, str]]:
    """Features of the words of a vocabulary, by kind: the feature of each word (-1: none), their texts, their mark.
    The same features as word_features(), without a Python object for each."""
    lengths = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False)
    yield np.arange(len(vocabulary)), vocabulary, "="
    for k in (4, 5, 6):
        short = pc.utf8_slice_codeunits(vocabulary, 0, k).dictionary_encode()
        yield np.where(lengths > k, short.indices.to_numpy(zero_copy_only=False), -1), short.dictionary, "^"


def _words_in(column: pa.ChunkedArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of each row of a column of lists end, and the words' numbers in the vocabulary (-1: not there)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return np.cumsum(sizes, dtype=np.int64), pc.fill_null(pc.index_in(pc.list_flatten(column), vocabulary), -1).to_numpy()


def _pairs(ends: np.ndarray, word: np.ndarray, of_word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature and row of what each row holds, once, by runs of rows of about WORDS words."""
    sizes, at = np.diff(ends, prepend=0), 0
    while at < len(ends):
        start = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, start + WORDS, "right")))
        f = of_word[word[start : ends[to - 1]]]
        row = np.repeat(np.arange(to - at), sizes[at:to])
        pairs = np.unique(f[f >= 0].astype(np.int64) * (to - at) + row[f >= 0])
        yield pairs // (to - at), pairs % (to - at) + at
        at = to


def _by_feature(ends: np.ndarray, word: np.ndarray, of_word: np.ndarray, features: int) -> list[np.ndarray]:
    """The rows that hold each of the features."""
    feature, row = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*_pairs(ends, word, of_word)) if len(ends) else ((), ())))
    order = np.argsort(feature, kind="stable")
    return np.split(row[order], np.searchsorted(feature[order], np.arange(1, features))) if features else []


class Sparse:
    """A matrix by its entries; those of one place add up."""

    def __init__(self, row: np.ndarray, column: np.ndarray, shape: tuple[int, int], value: np.ndarray | None = None):
        self.row, self.column, self.shape, self.value = row, column, shape, value

    def _sums(self, of: np.ndarray, at: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(to, weights=of[at] if self.value is None else of[at] * self.value, minlength=size)

    def times(self, v: np.ndarray) -> np.ndarray:
        return self._sums(v, self.column, self.row, self.shape[0])

    def turned_times(self, v: np.ndarray) -> np.ndarray:
        return self._sums(v, self.row, self.column, self.shape[1])


def fit(rows: pa.Table) -> Model:
    """rows: words (of each text, once), swapped (the words after the swap; null where nothing was swapped), term (the
    inserted one; null where the text has its own), label.

    This runs on the driver: words become numbers at once, documents are counted run by run, and the matrices are held by
    their entries, so that besides rows it needs some tens of MB at SAMPLE documents."""
    y = rows["label"].to_numpy().astype(np.float64)
    n, pos = len(y), float(y.sum())
    if not n or pos in (0.0, float(n)):
        return Model({}, 35.0 if n and pos else -35.0)
    vocabulary = pc.unique(pc.list_flatten(rows["words"]))
    ends, word = _words_in(rows["words"], vocabulary)
    moved = np.nonzero(rows["swapped"].is_valid().to_numpy())[0]
    swaps = _words_in(rows["swapped"], vocabulary)
    p = pos / n

    def part(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    shared = {f for w in TERMS for f in word_features(w)}
    found: list[tuple[float, str, np.ndarray, np.ndarray]] = []  # evidence, name, documents with it, documents with it after a swap
    for of_word, texts, mark in _blocks(vocabulary):
        has, both = np.zeros(len(texts)), np.zeros(len(texts))
        for feature, doc in _pairs(ends, word, of_word):
            has += np.bincount(feature, minlength=len(texts))
            both += np.bincount(feature, weights=y[doc], minlength=len(texts))
        evidence = 2 * (part(both, has * p) + part(has - both, has * (1 - p)) + part(pos - both, (n - has) * p) + part(n - has - pos + both, (n - has) * (1 - p)))
        good = (evidence >= EVIDENCE) & (has >= LEAST_DOCS)
        # Features of identity terms are always there, for the penalty to act on.
        forced = pc.is_in(texts, pa.array([f[1:] for f in sorted(shared) if f[0] == mark], texts.type)).to_numpy(zero_copy_only=False)
        best = np.nonzero(good)[0]
        best = best[np.argsort(-evidence[best], kind="stable")][: FEATURES]
        chosen = np.array(sorted({*best.tolist(), *np.nonzero(forced)[0].tolist()}), np.int64)
        place = np.full(len(texts) + 1, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        # A word that is not in the vocabulary has the number -1, and so has a word without this feature: both are last here.
        of_word = place[np.append(of_word, -1)]
        docs, after = (_by_feature(*side, of_word, len(chosen)) for side in ((ends, word), swaps))
        for k, i in enumerate(chosen.tolist()):
            found.append((np.inf if forced[i] else round(float(evidence[i]), 6), mark + texts[i].as_py(), docs[k], after[k]))
    found.sort(key=lambda f: (-f[0], f[1]))
    found = sorted((f for k, f in enumerate(found) if k < FEATURES or f[0] == np.inf), key=lambda f: f[1])
    row, column = np.concatenate([*(f[2] for f in found), np.arange(n)]), np.repeat(np.arange(len(found) + 1), [*(len(f[2]) for f in found), n])
    x = Sparse(row, column, (n, len(found) + 1))
    # Only features of identity terms change by a swap or an insertion.
    own = np.array([k for k, f in enumerate(found) if f[0] == np.inf], np.int64)
    place = {found[k][1]: c for c, k in enumerate(own.tolist())}
    held, swapped = np.zeros((n, len(own)), np.int8), np.zeros((n, len(own)), np.int8)
    for c, k in enumerate(own.tolist()):
        held[found[k][2], c] = 1
        swapped[found[k][3], c] = 1
    terms = rows["term"].to_pylist()
    added = np.array([r for r, t in enumerate(terms) if t is not None], np.int64)
    has, after = np.zeros((len(added), len(own)), np.int8), np.zeros((len(added), len(own)), np.int8)
    columns = {t: [[place[f] for f in word_features(w) if f in place] for w in (t, SWAP[t])] for t in {t for t in terms if t is not None}}
    for r, at in enumerate(added.tolist()):
        with_term, with_swap = columns[terms[at]]
        has[r, with_term] = 1
        after[r, with_swap] = 1
    free = 1 - held[added]
    change = np.concatenate([swapped[moved] - held[moved], (after - has) * free, has * free])
    shape, (row, column) = change.shape, np.nonzero(change)
    change = Sparse(row, column, shape, change[row, column].astype(np.float64))
    # Accelerated gradient steps; the loss is convex and smooth.
    ridge = np.full(x.shape[1], PENALTY)
    ridge[-1] = 0
    # The steepest curvature, by power iteration from a start that no swap is orthogonal to.
    power = np.random.default_rng(0).standard_normal(x.shape[1])
    for _ in range(60):
        at = power
        power = x.turned_times(x.times(at)) / (4 * n) + ridge * at
        power[own] += SWAP_PENALTY * 2 * change.turned_times(change.times(at[own])) / max(1, change.shape[0])
        top = float(np.linalg.norm(power))
        power /= top
    w, v, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(STEPS):
        miss = 1 / (1 + np.exp(-np.clip(x.times(v), -35, 35))) - y
        grad = x.turned_times(miss) / n + ridge * v
        grad[own] += SWAP_PENALTY * 2 * change.turned_times(change.times(v[own])) / max(1, change.shape[0])
        new = v - grad / (1.1 * top)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / nt * (new - w), new, nt
    return Model({name: float(w[k]) for k, (_, name, _, _) in enumerate(found)}, float(w[-1]))


def labelled(texts: list[str | None], labels: list[int]) -> pa.Table:
    """Rows for fit()."""
    words = [words_of(t) for t in texts]
    swapped = [sorted(swapped_words(t)) if not w.isdisjoint(SWAP) else None for t, w in zip(texts, words)]
    terms = [None if s is not None else inserted_term(t) for t, s in zip(texts, swapped)]
    return pa.table({"words": pa.array([sorted(w) for w in words], pa.list_(pa.string())), "swapped": pa.array(swapped, pa.list_(pa.string())), "term": pa.array(terms, pa.string()), "label": pa.array(labels, pa.int32())})


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = labelled(b.column("text").to_pylist(), b.column("label").to_pylist()).append_column("h", b.column("h"))
        yield from found.combine_chunks().to_batches()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on at most sample documents with a label. An id with several labels takes the rounded mean; nulls are no
    label. Without labels, or with one class only, the model is a constant."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.round(F.avg("y")).cast("int").alias("label"))
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).join(marks, "id")
    picked = scratch.save(narrow.groupBy("h").agg(F.min(F.struct("id", "label")).alias("r")).orderBy("h").limit(sample).select("r.*", "h"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id").where(F.xxhash64("text") == F.col("h")).select("text", "label", "h")
    got = texts.mapInArrow(_words, "words array<string>, swapped array<string>, term string, label int, h long")
    # In a fixed order, so that reruns agree.
    rows = got.toArrow().sort_by([("h", "ascending"), ("label", "ascending")])
    scratch.only()
    model = fit(rows)
    # What Arrow keeps for later would stay with the driver through all that follows.
    del rows
    pa.default_memory_pool().release_unused()
    return model


def scorer(docs: DataFrame, model: Model):
    """A column function of the text: its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return toxicity


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score, predicted. Null and empty texts get the score of no words, long texts
    are read whole. Repeated rows repeat. Other columns are not read."""
    small_batches(docs.sparkSession)
    scored = docs.select(F.col(id_col).alias("id"), scorer(docs, model)(F.col(text_col)).alias("score"))
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _trained(spark, sf_dir: str, docs: DataFrame) -> Model:
    learn = docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0))
    return train(learn, table(spark, sf_dir, "labels"))


def reject_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the model rejects; columns stay. A model without any feature (no labels, or of one class
    only) rejects none."""
    small_batches(spark)
    model = _trained(spark, sf_dir, docs)
    return docs.where(scorer(docs, model)(F.col("text")) < 0.5) if model.weights else docs


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, _trained(spark, sf_dir, docs))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
