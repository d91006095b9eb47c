"""Language identification of whole texts, and spans of mixed-language text.

Script ranges narrow the languages that a word can belong to: a token is cut where the script of its letters changes, and
a language is a candidate for a word only if it was seen often enough in that script; the others are excluded, however
little a switch costs. (A script that no learned language was seen in excludes none.) Over the candidates each word has
log-likelihoods from its character n-grams. A Viterbi search over the words with a switching penalty then labels spans.
Documents advance together, word by word; each different word is scored once. The text's language is the one with most
letters on the path. A run of more than LONGEST letters is several words, so that memory is bounded.

Fitting uses at most SAMPLE documents of at most SAMPLE_BYTES together (the first by a hash of their text, equal texts
once).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, held_out, small_batches, table

SAMPLE, SAMPLE_BYTES = 4_000, 32 << 20
#: Letters of the longest word, and letters that are scored together.
LONGEST, SCORED = 4_096, 200_000
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 18
SMOOTH = 0.3
SWITCH = 6.0
#: A word counts with at most this many nats between its best and worst candidate, so that one odd word cannot flip a span.
SPREAD = 8.0
#: A script is a language's own if it holds at least this share of its letters.
SHARE = 0.001
REMEMBERED = 200_000
#: Words times texts that advance together.
CELLS = 1 << 20
UND = "und"
#: Script ranges by first code point, in order; letters between two starts belong to the earlier one. Fixed values of Unicode blocks.
SCRIPTS = [
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Indic"),
    (0x0E00, "Thai"),
    (0x0E80, "Other"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x2C60, "Latin"),
    (0x2C80, "Other"),
    (0x3040, "Kana"),
    (0x3100, "Other"),
    (0x3400, "Han"),
    (0xA000, "Other"),
    (0xA720, "Latin"),
    (0xA800, "Other"),
    (0xAC00, "Hangul"),
    (0xD7B0, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Latin"),
    (0xFB13, "Other"),
]
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])


def letters_of(token: str) -> str:
    """The token's letters in lower case; '' if it has none."""
    low = token.lower()
    return low if low.isalpha() else "".join(c for c in low if c.isalpha())


@lru_cache(maxsize=1 << 16)
def _script(letter: str) -> int:
    return int(SCRIPT_OF[np.searchsorted(STARTS, ord(letter), "right") - 1])


def words_of(token: str) -> list[str]:
    """The token's letters, cut where their script changes and after LONGEST letters."""
    low = letters_of(token)
    runs = [low] if low.isascii() else ["".join(g) for _, g in groupby(low, _script)]
    return [r[i : i + LONGEST] for r in runs for i in range(0, len(r), LONGEST)]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, each with a border on both sides, and the index of the word of each."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    buckets, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        inside = word[:m] == word[n - 1 :]
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((mixed[inside] >> np.uint64(64 - 18)).astype(np.int64))
            owners.append(word[:m][inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # BUCKETS x languages
    allowed: np.ndarray  # scripts x languages
    known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)  # the words of a token
    words: list[str] = field(default_factory=list, repr=False)
    sizes: np.ndarray | None = field(default=None, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word (letters only) in each language, relative to the best candidate."""
        buckets, owner = _grams(words)
        order = np.argsort(owner, kind="stable")
        sizes = np.bincount(owner, minlength=len(words))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        s = np.add.reduceat(self.logs[buckets[order]], starts, axis=0)
        # The n-grams of a word overlap, so their sum counts each letter several times.
        s = s / len(ORDERS)
        ok = self.allowed[[_script(w[0]) for w in words]]
        ok |= ~ok.any(1, keepdims=True)
        s = np.where(ok, s, -np.inf)
        return np.where(ok, np.maximum(s - s.max(1, keepdims=True), -SPREAD), -np.inf).astype(np.float32)

    def index(self, tokens: set[str]) -> None:
        """Scores the words of tokens that are new."""
        if self.scores is None or len(self.known) > REMEMBERED:
            self.known, self.words, self.sizes, self.scores = {}, [], np.zeros(0, np.int64), np.zeros((0, len(self.langs)), np.float32)
        new, shown = [], []
        for t in sorted(tokens.difference(self.known)):
            runs = words_of(t)
            at = len(self.words) + len(new)
            self.known[t] = tuple(range(at, at + len(runs)))
            new += runs
            shown += [t] if len(runs) == 1 else runs
        if new:
            sizes = np.array([len(w) for w in new])
            cuts = [0, *(np.nonzero(np.diff(np.cumsum(sizes) // SCORED))[0] + 1).tolist(), len(new)]
            self.scores = np.concatenate([self.scores, *[self.word_scores(new[a:b]) for a, b in zip(cuts, cuts[1:])]])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.words += shown

    def paths(self, texts: list[str | None], together: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the numbers of its words, and the language of each on the best path."""
        split = [(t or "").split() for t in texts]
        self.index({w for ws in split for w in ws})
        rows = [np.fromiter(chain.from_iterable(map(self.known.__getitem__, ws)), np.int64) for ws in split]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: -len(rows[i]))
        at = 0
        while at < len(order) and len(rows[order[at]]):
            # A group's tables have a row for each word of its longest text, so long texts go in small groups.
            wide = max(1, min(together, CELLS // len(rows[order[at]])))
            group = [i for i in order[at : at + wide] if len(rows[i])]
            for i, p in zip(group, self._viterbi([rows[i] for i in group])):
                out[i] = p
            at += wide
        return list(zip(rows, out))

    def _viterbi(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """rows: from long to short, so that those still running are a prefix."""
        k, n = len(self.langs), np.array([len(r) for r in rows])
        top = int(n[0])
        back = np.zeros((top, len(rows), k), np.int16)
        value = np.stack([self.scores[r[0]] for r in rows])
        grid = np.zeros((top, len(rows)), np.int64)
        for j, r in enumerate(rows):
            grid[: len(r), j] = r
        running = np.searchsorted(-n, -np.arange(1, top + 1), "right")
        own = np.arange(k)
        for t in range(1, top):
            m = running[t]
            v = value[:m]
            best = v.argmax(1)
            jump = v[np.arange(m), best][:, None] - SWITCH
            stay = v >= jump
            back[t, :m] = np.where(stay, own, best[:, None])
            value[:m] = np.where(stay, v, jump) + self.scores[grid[t, :m]]
        state = value.argmax(1)
        path = np.zeros((top, len(rows)), np.int16)
        for t in range(top - 1, -1, -1):
            m = running[t]
            path[t, :m] = state[:m]
            state[:m] = back[t, np.arange(m), state[:m]] if t else state[:m]
        return [path[: len(r), j].astype(np.int64) for j, r in enumerate(rows)]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and the share of letters that it has on the path; und and 0 for a text without letters."""
        out = []
        for words, path in self.paths(texts):
            if not len(path):
                out.append((UND, 0.0))
                continue
            weight = np.bincount(path, weights=self.sizes[words], minlength=len(self.langs))
            best = int(weight.argmax())
            out.append((self.langs[best], float(weight[best] / weight.sum())))
        return out

    def spans(self, text: str | None) -> list[tuple[str, str]]:
        """Runs of words of one language: (language, words joined by spaces)."""
        words, path = self.paths([text])[0]
        cuts = [0, *(np.nonzero(np.diff(path))[0] + 1).tolist(), len(words)]
        return [(self.langs[path[a]], " ".join(self.words[w] for w in words[a:b])) for a, b in zip(cuts, cuts[1:]) if b > a]

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "words": [], "sizes": None, "scores": None}


def fit(texts: list[str | None], langs: list[str]) -> Model | None:
    """None without a labelled text that has letters."""
    names = sorted(set(langs))
    counts = np.zeros((BUCKETS, len(names)))
    scripts = np.zeros((len(NAMES), len(names)))
    for text, lang in zip(texts, langs):
        words = [w for t in (text or "").split() for w in words_of(t)]
        if words:
            k = names.index(lang)
            counts[:, k] += np.bincount(_grams(words)[0], minlength=BUCKETS)
            codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            np.add.at(scripts[:, k], SCRIPT_OF[np.searchsorted(STARTS, codes, "right") - 1], 1)
    if not counts.any():
        return None
    total = counts.sum(0)
    used = counts.any(1).sum()
    logs = np.log((counts + SMOOTH) / (total + SMOOTH * used))
    allowed = scripts >= SHARE * np.maximum(1, scripts.sum(0))
    return Model(names, logs.astype(np.float32), allowed)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> Model | None:
    """Fits on at most sample documents, and size bytes, whose language and id are not null."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    picked = rows.select("id", F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("by"), F.octet_length("text").alias("n")).groupBy("h").agg(F.min("by").alias("by"), F.min("id").alias("id"), F.min("n").alias("n"))
    # A window over at most sample rows.
    picked = picked.orderBy("by").limit(sample).withColumn("upto", F.sum("n").over(Window.orderBy("by", "h")))
    picked = scratch.save(picked.where(F.col("upto") <= size).select("id", "h"))
    got = rows.withColumn("h", F.xxhash64("text")).join(picked, ["id", "h"]).select("text", "lang").toArrow()
    scratch.only()
    pairs = sorted(zip(got["text"].to_pylist(), got["lang"].to_pylist()))
    return fit([p[0] for p in pairs], [p[1] for p in pairs])


def _runner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = m.predict(b.column("text").to_pylist()) if m else [(UND, 0.0)] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score. Null, empty and letterless texts are und with score 0; ties go to
    the first language by name. Long texts are labelled whole. Repeated rows repeat. Other columns are not read."""
    spark = docs.sparkSession
    small_batches(spark, 1000, "4m")
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_runner(shared), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op5_lang_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1)))
    found = identify(docs, model)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
