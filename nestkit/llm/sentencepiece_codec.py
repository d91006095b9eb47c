"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

Texts are cut into words that no piece crosses, and each different word is solved once. Words of equal length (long ones:
of nearly equal length, each read from its own end) advance together, one character at a time: for every start within reach, the hashes of the substrings of all words probe the
sorted keys of the pieces of that length, and a vectorised maximum stores the best score and its backpointer. Files of
kind BPE mask the arcs by the border test of Pieces, so the ids are those of the library for the same file.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table
from .pieces import DEFAULT_MODEL, SPACE, UNK_PENALTY, Pieces

BASE = np.uint64(0x5851F42D4C957F2D)
TOP = np.uint64(46)
#: Words that an encoder remembers before it starts afresh.
REMEMBERED = 250_000
#: Words that advance together.
TOGETHER = 8192


class Codec:
    """Encodes and decodes batches of texts with the tables of one model."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(pieces.texts[i]) for i in pieces.usable])
        for n in sorted(set(lengths.tolist())):
            ids = pieces.usable[lengths == n]
            keys = self._prefix_hashes(np.array([[ord(c) for c in pieces.texts[i]] for i in ids], np.uint64))[:, -1]
            order = np.argsort(keys)
            self.by_length[n] = keys[order], ids[order]
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces share a hash")
        #: Most substrings are no piece: a table of the keys' top bits tells so before the search.
        self.maybe = {n: np.bincount((keys >> TOP).astype(np.int64), minlength=1 << 18) > 0 for n, (keys, _) in self.by_length.items()}
        self.power = {n: np.uint64(pow(int(BASE), n, 1 << 64)) for n in self.by_length}
        self.least = float(pieces.scores[pieces.usable].min()) if len(pieces.usable) else 0.0
        surfaces = [t.replace(SPACE, " ").encode() for t in pieces.texts]
        if pieces.bytes_ is not None:
            for b, i in enumerate(pieces.bytes_):
                surfaces[i] = bytes([b])
        surfaces[pieces.unk] = " ⁇ ".encode()
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_len = np.array([len(s) for s in surfaces])
        self.surface_at = np.concatenate(([0], np.cumsum(self.surface_len)))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @staticmethod
    def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * BASE + codes[:, i] + np.uint64(1)
        return out

    def _probe(self, sub: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which substrings of length k are pieces, and the pieces' ids."""
        keys, ids = self.by_length[k]
        rows = np.nonzero(self.maybe[k][(sub >> TOP).astype(np.int64)])[0]
        sub = sub[rows]
        at = np.minimum(np.searchsorted(keys, sub), len(keys) - 1)
        hit = keys[at] == sub
        return rows[hit], ids[at[hit]]

    def _solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length or nearly so, one after another, and how many each has."""
        p, sizes, n = self.p, np.array([len(w) for w in words]), len(words)
        length = int(sizes.max())
        # What fills shorter words up stands behind their ends, where no path of theirs comes.
        words = [w.ljust(length, "\0") for w in words]
        # A row a position, so that a step touches neighbouring memory.
        codes = np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, length).T.astype(np.uint64))
        hashes = np.zeros((length + 1, n), np.uint64)
        for i in range(length):
            hashes[i + 1] = hashes[i] * BASE + codes[i] + np.uint64(1)
        # All substrings of one length are probed at once; per length the words and pieces that match, by their end.
        lengths = [k for k in sorted(self.by_length, reverse=True) if k <= length]
        found, alone = {}, np.ones((length, n), bool)
        for k in lengths:
            flat, ids = self._probe((hashes[k:] - hashes[:-k] * self.power[k]).ravel(), k)
            found[k] = flat % n, ids, np.searchsorted(flat, np.arange(length - k + 2) * n).tolist()
            if k == 1:
                alone.ravel()[flat] = False
        best = np.full((length + 1, n), -np.inf, np.float32)
        best[0] = 0
        back, last = np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int64)
        for e in range(1, length + 1):
            ends = [(k, w[at[e - k] : at[e - k + 1]], ids[at[e - k] : at[e - k + 1]]) for k in lengths if k <= e for w, ids, at in (found[k],)]
            if p.bpe:
                self._masked(e, ends, best, back, last)
            else:
                # Longest first and strictly greater: of equal scores the longest last piece stays, as in the library.
                for k, rows, ids in ends:
                    score = best[e - k, rows] + p.scores[ids]
                    more = score > best[e, rows]
                    rows = rows[more]
                    best[e, rows], back[e, rows], last[e, rows] = score[more], e - k, ids[more]
            # A character that is no piece by itself is unknown.
            rows = np.nonzero(alone[e - 1])[0]
            if len(rows):
                score = np.zeros(len(rows), np.float32) if p.bpe else best[e - 1, rows] + np.float32(self.least - UNK_PENALTY)
                more = score > best[e, rows]
                rows = rows[more]
                best[e, rows], back[e, rows], last[e, rows] = score[more], e - 1, p.size
        return self._paths(codes, sizes, back, last)

    def _masked(self, e: int, ends: list[tuple[int, np.ndarray, np.ndarray]], best: np.ndarray, back: np.ndarray, last: np.ndarray) -> None:
        """BPE: of the pieces that end at e, the one that may stand beside the piece before it."""
        ends = [x for x in ends if len(x[1])]
        if not ends:
            return
        rows, ids = np.concatenate([x[1] for x in ends]), np.concatenate([x[2] for x in ends])
        starts = np.repeat([e - x[0] for x in ends], [len(x[1]) for x in ends])
        before = last[starts, rows]
        inner = np.nonzero(before >= 0)[0]
        ok = starts == 0
        ok[inner] = self.p.beside(before[inner], ids[inner])
        rows = rows[ok]
        best[e, rows], back[e, rows], last[e, rows] = 0, starts[ok], ids[ok]

    def _paths(self, codes: np.ndarray, ends: np.ndarray, back: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follows the backpointers of all words together, from their ends."""
        size, fallback, n = self.p.size, self.p.bytes_ is not None, codes.shape[1]
        rows, at, steps = np.arange(n), ends, []
        while len(rows):
            token = last[at, rows]
            # An unknown character is kept as a number above the vocabulary.
            token = np.where(token == size, size + 1 + codes[at - 1, rows].astype(np.int64), token)
            steps.append((rows, token))
            at = back[at, rows]
            go = at > 0
            rows, at = rows[go], at[go]
        sizes = np.bincount(np.concatenate([r for r, _ in steps]), minlength=n)
        ends = np.cumsum(sizes)
        flat = np.zeros(int(ends[-1]), np.int64)
        for k, (r, token) in enumerate(steps):
            flat[ends[r] - 1 - k] = token
        unknown = flat > size
        if unknown.any():
            flat, sizes = self._expand(flat, sizes, unknown, fallback)
        return flat.astype(np.int32), sizes

    def _expand(self, flat: np.ndarray, sizes: np.ndarray, unknown: np.ndarray, fallback: bool) -> tuple[np.ndarray, np.ndarray]:
        """Bytes in place of unknown characters, or one unknown piece in place of a run of them."""
        word, size = np.repeat(np.arange(len(sizes)), sizes), self.p.size
        if fallback:
            parts = [self.p.unknown(chr(t - size - 1)) if u else [t] for t, u in zip(flat.tolist(), unknown.tolist())]
            counts = np.array([len(x) for x in parts])
            return np.array([t for x in parts for t in x], np.int64), np.bincount(np.repeat(word, counts), minlength=len(sizes))
        again = np.zeros(len(flat), bool)
        again[1:] = unknown[1:] & unknown[:-1] & (word[1:] == word[:-1])
        return np.where(unknown, self.p.unk, flat)[~again], np.bincount(word[~again], minlength=len(sizes))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (and the end)."""
        if len(self.known) > REMEMBERED:
            self._forget()
        words = [self.p.words(t) for t in texts]
        new: dict[int, list[str]] = {}
        for w in set().union(*words).difference(self.known):
            new.setdefault(_about(len(w)), []).append(w)
        flats, sizes = [self.flat], [np.diff(self.at)]
        for group in new.values():
            wide = max(1, min(TOGETHER, (TOGETHER * 32) // max(map(len, group))))
            for i in range(0, len(group), wide):
                part = group[i : i + wide]
                solved, counts = self._solve(part)
                flats.append(solved)
                sizes.append(counts)
                self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))
        if new:
            self.flat, self.at = np.concatenate(flats), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64)
        sizes = self.at[index + 1] - self.at[index]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[_spread(self.at[index], sizes, ends)]
        return ids, ends[np.concatenate(([0], np.cumsum(np.array([len(ws) for ws in words], np.int64))))]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of encode()'s ids; invalid UTF-8 becomes the replacement character."""
        sizes = self.surface_len[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        data = self.surface[_spread(self.surface_at[ids], sizes, ends)].tobytes()
        cuts = ends[at].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return [t[1:] if self.p.dummy_prefix and t.startswith(" ") else t for t in texts]


def _about(length: int) -> int:
    """The length itself up to 16; above, the next of the lengths that are an eighth of a power of two apart."""
    step = max(1, 1 << (length.bit_length() - 4)) if length > 16 else 1
    return -(-length // step) * step


def _spread(starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of all slices starts : starts + sizes, one after another."""
    return np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])


def _runner(pieces, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            ids, at = codec.encode(texts)
            found = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
            columns = [b.column("id"), pa.array(np.diff(at)), found]
            if decode:
                columns.append(pa.array(codec.decode(ids, at), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "decoded"][: len(columns)])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, decode: bool = False) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids (array of int), and with decode the text that the ids give back.

    The model file is read on the driver; its tables go to the executors and have the vocabulary's size. A null or
    empty text has no ids and decodes to the empty text. Long texts are encoded whole. Ties between pieces follow the library. Repeated rows repeat.
    Other columns of docs are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000, "4m")
    pieces = spark.sparkContext.broadcast(Pieces.load(model))
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids array<int>" + ", decoded string" * decode
    return source.mapInArrow(_runner(pieces, decode), schema).withColumnRenamed("id", id_col)


def encode_columns(docs: DataFrame, text_col: str = "text", model: str = DEFAULT_MODEL, names: tuple[str, str] = ("n_tokens", "ids")) -> DataFrame:
    """docs with the number and ids of each text's tokens, without a join: rows keep all their columns. The two new ones
    have the names given; a column of docs with one of these names stays, and the new one gets underscores before it."""
    small_batches(docs.sparkSession, 1000, "4m")
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    taken = {c.lower() for c in docs.columns}
    new = [next(x for k in range(len(taken) + 1) if (x := "_" * k + n).lower() not in taken) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces.value)
        for b in batches:
            ids, at = codec.encode(b.column(text_col).to_pylist())
            found = [pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*b.schema.names, *new])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(new[0], T.LongType()), T.StructField(new[1], T.ArrayType(T.IntegerType()))]))


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, and the SHA-256 and length in bytes of what they decode to."""
    found = encode(table(spark, sf_dir, "documents"), decode=True)
    return found.select("doc_id", "n_tokens", "ids", F.octet_length("decoded").cast("long").alias("decoded_bytes"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
