"""Token counts by a count-only Viterbi search, without building any ids.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; the dynamic programme keeps the best score,
its last piece and the number of pieces for each position, and no backpointers. Ties follow the tokenizer: of equal
scores the longest last piece stays, sums are float32, and a run of unknown characters is one piece unless byte
pieces stand in for it. Files of kind BPE mask the matches by the border test of Pieces, so counts equal the
library's for the same file. Each different word is counted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table
from .pieces import DEFAULT_MODEL, NEVER, UNK_PENALTY, Pieces

#: Words, and borders between pieces, that a counter remembers before it starts afresh.
REMEMBERED = 300_000


class Counter:
    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.found = ahocorasick.Automaton()
        for i in pieces.usable.tolist():
            self.found.add_word(pieces.texts[i], (i, len(pieces.texts[i])))
        self.found.make_automaton()
        self.scores = pieces.scores
        usable = pieces.scores[pieces.usable]
        self.unknown_score = np.float32((usable.min() if len(usable) else 0.0) - UNK_PENALTY)
        self.singles = {pieces.texts[i] for i in pieces.usable.tolist() if len(pieces.texts[i]) == 1}
        self.merges = dict(zip(pieces.pair_keys.tolist(), pieces.pair_ranks.tolist()))
        self.rank, self.left, self.right = pieces.rank.tolist(), pieces.left.tolist(), pieces.right.tolist()
        self.counts: dict[str, int] = {}
        self.borders: dict[int, bool] = {}

    def _beside(self, a: int, b: int) -> bool:
        """Pieces._beside for one pair."""
        limit, width, rank = NEVER, self.p.size + 1, self.rank
        while True:
            if self.merges.get(a * width + b, NEVER) < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.right[a]
            else:
                limit, b = rb + 1, self.left[b]

    def _bpe(self, word: str) -> int:
        n, width, nothing, borders = len(word), self.p.size + 1, self.p.size, self.borders
        last, count = [-1] * (n + 1), [0] * (n + 1)
        done = 0
        for end, (piece, length) in self.found.iter(word):
            end += 1
            while done < end - 1:  # positions that no match reached
                done += 1
                if last[done] < 0:
                    last[done], count[done] = nothing, count[done - 1] + len(self.p.unknown(word[done - 1]))
            if last[end] >= 0:
                continue  # exactly one piece can end here
            start = end - length
            if start:
                key = last[start] * width + piece
                ok = borders.get(key)
                if ok is None:
                    ok = borders[key] = self._beside(last[start], piece)
                if not ok:
                    continue
            last[end], count[end] = piece, count[start] + 1
        while done < n:
            done += 1
            if last[done] < 0:
                last[done], count[done] = nothing, count[done - 1] + len(self.p.unknown(word[done - 1]))
        return count[n]

    def _unigram(self, word: str) -> int:
        n, one, fallback = len(word), np.float32(0), self.p.bytes_ is not None
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, match in self.found.iter(word):
            ends[end + 1].append(match)
        best, count, loose = [one] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            top = None
            for piece, length in sorted(ends[e], key=lambda m: -m[1]):
                score = best[e - length] + self.scores[piece]
                if top is None or score > top:
                    top, count[e], loose[e] = score, count[e - length] + 1, False
            if word[e - 1] not in self.singles:
                score = best[e - 1] + self.unknown_score
                if top is None or score > top:
                    more = len(self.p.unknown(word[e - 1])) if fallback else int(not loose[e - 1])
                    top, count[e], loose[e] = score, count[e - 1] + more, True
            best[e] = top
        return count[n]

    def count(self, text: str | None) -> int:
        counts, total, solve = self.counts, 0, self._bpe if self.p.bpe else self._unigram
        for w in self.p.words(text):
            c = counts.get(w)
            if c is None:
                c = counts[w] = solve(w)
            total += c
        if len(counts) > REMEMBERED:
            counts.clear()
        if len(self.borders) > REMEMBERED * 4:
            self.borders.clear()
        return total


def _runner(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces.value)
        for b in batches:
            found = [counter.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.int64())], ["id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """One row per row of docs: id, n_tokens. A null or empty text has none; long texts are counted whole. Repeated rows repeat. Other columns of
    docs are not read; the model's tables go to the executors and have the vocabulary's size."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = spark.sparkContext.broadcast(Pieces.load(model))
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_runner(pieces), f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens and bytes of every document."""
    docs = table(spark, sf_dir, "documents")
    counted = count_tokens(docs.select(F.struct("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).alias("doc_id"), "text"))
    return counted.select("doc_id.doc_id", "n_tokens", "doc_id.n_bytes")
