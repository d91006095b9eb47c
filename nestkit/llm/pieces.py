"""A SentencePiece model file as tables: pieces, scores, byte pieces, and the merge order of BPE files.

Both kinds of file become one lattice over a word's characters. In a unigram file a path's worth is the sum of its
scores. In a BPE file a path is right if each two neighbouring pieces may stand side by side, that is, if undoing the
merges of both never shows a merge across their border that would have come first; exactly one path does. So a lattice
search, with arcs masked by that test, gives the library's ids for either kind.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNK_PENALTY = 10.0
NEVER = np.int64(1) << 40
#: Slots of the direct-mapped cache of border tests.
SLOTS = 1 << 20
# Fixed values of the file format: the numbers of model types and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _merged(word: str, rank: dict[str, int]) -> list[str]:
    """Plain BPE: the best-ranked neighbouring pair merges first, the leftmost of equals."""
    parts = list(word)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], NEVER))
        if parts[best] + parts[best + 1] not in rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


@dataclass
class Pieces:
    """Tables of one model file; picklable, with a size that follows the vocabulary alone."""

    texts: list[str]
    scores: np.ndarray
    bpe: bool
    unk: int
    bytes_: np.ndarray | None  # ids of the 256 byte pieces
    dummy_prefix: bool
    usable: np.ndarray  # ids that the lattice may use
    rank: np.ndarray  # BPE: order of the merge that makes the piece; -1 for a character
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray  # BPE: left id * size + right id, sorted, of all pairs that merge
    pair_ranks: np.ndarray
    splitter: str | None  # a pattern of words that no piece crosses
    finer: str | None = None  # a pattern of their parts, where characters stand that no longer piece holds
    cache_keys: np.ndarray | None = field(default=None, repr=False)
    cache_ok: np.ndarray | None = field(default=None, repr=False)

    @property
    def size(self) -> int:
        return len(self.texts)

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        return cls.from_proto(model)

    @classmethod
    def from_proto(cls, model) -> Pieces:
        norm, kind = model.normalizer_spec, model.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without text normalisation are supported")
        if kind not in (UNIGRAM, BPE) or any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("only unigram and BPE models without user-defined symbols are supported")
        texts = [p.piece for p in model.pieces]
        kinds = np.array([p.type for p in model.pieces])
        scores = np.array([p.score for p in model.pieces], np.float32)
        n, bpe = len(texts), kind == BPE
        usable = np.nonzero(kinds == NORMAL)[0]
        byte_ids = None
        if model.trainer_spec.byte_fallback:
            byte_ids = np.zeros(256, np.int64)
            for i in np.nonzero(kinds == BYTE)[0]:
                byte_ids[int(texts[i][3:5], 16)] = i
        rank, left, right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        keys, ranks = [], []
        if bpe:
            id_of = {texts[i]: int(i) for i in usable}
            order = [i for i in usable[np.argsort(-scores[usable], kind="stable")] if len(texts[i]) > 1]
            rank_of = {texts[i]: r for r, i in enumerate(order)}
            reached = {int(i) for i in usable if len(texts[i]) == 1}
            for i in order:
                t = texts[i]
                lower = {**{t[a:b]: rank_of[t[a:b]] for a in range(len(t)) for b in range(a + 2, len(t) + 1) if t[a:b] in rank_of}}
                del lower[t]
                parts = _merged(t, lower)
                if len(parts) == 2 and all(p in id_of for p in parts):
                    rank[i], left[i], right[i] = rank_of[t], id_of[parts[0]], id_of[parts[1]]
                    reached.add(int(i))
                for k in range(1, len(t)):
                    if t[:k] in id_of and t[k:] in id_of:
                        keys.append(id_of[t[:k]] * (n + 1) + id_of[t[k:]])
                        ranks.append(rank_of[t])
            usable = np.array(sorted(reached))
        by = np.argsort(keys) if keys else np.zeros(0, int)
        inner = any(SPACE in texts[i].lstrip(SPACE) for i in usable)
        line = "" if any("\n" in texts[i] for i in usable) else "\n"
        splitter = None if inner else f"{line}|{SPACE}*[^{SPACE}{line}]+|{SPACE}+".lstrip("|")
        unk = int(np.nonzero(kinds == UNKNOWN)[0][0])
        # Nothing joins a character that is in no longer piece, so a word can be cut on both sides of it. Without byte
        # pieces a run of unknown characters is one piece, and only characters of the vocabulary are cut out.
        joined = {c for i in usable for c in texts[i] if len(texts[i]) > 1}
        alone = {texts[i] for i in usable if len(texts[i]) == 1} - joined
        group = lambda chars: "".join(map(re.escape, sorted(chars)))
        if byte_ids is not None:
            finer = f"[{group(joined)}]+|(?s:.)" if joined else "(?s:.)"
        else:
            finer = f"[{group(alone)}]|[^{group(alone)}]+" if alone else None
        return cls(texts, scores, bpe, unk, byte_ids, norm.add_dummy_prefix, usable, rank, left, right, np.array(keys, np.int64)[by], np.array(ranks, np.int64)[by], splitter, finer)

    def words(self, text: str | None) -> list[str]:
        """The normalised text, cut where no piece crosses."""
        if not text:
            return []
        text = (" " * self.dummy_prefix + text).replace(" ", SPACE)
        words = re.findall(self.splitter, text) if self.splitter else [text]
        if self.finer is None or text.replace(SPACE, " ").isascii():
            return words
        out: list[str] = []
        for w in words:
            if w.isascii() or w[0] == SPACE and w[1:].isascii():
                out.append(w)
            else:
                out += re.findall(self.finer, w)
        return out

    def unknown(self, char: str) -> list[int]:
        return [self.unk] if self.bytes_ is None else self.bytes_[list(char.encode())].tolist()

    def _beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE can leave pieces a and b side by side; id size stands for an unknown character."""
        ok = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), NEVER)
        while len(at):
            key = a * (self.size + 1) + b
            k = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
            merge = np.where(self.pair_keys[k] == key, self.pair_ranks[k], NEVER) if len(self.pair_keys) else np.full(len(a), NEVER)
            bad = merge < limit
            ok[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same, through a cache."""
        if self.cache_keys is None:
            self.cache_keys, self.cache_ok = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        key = a * (self.size + 1) + b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        hit = self.cache_keys[slot] == key
        out = self.cache_ok[slot]
        if not hit.all():
            miss = np.nonzero(~hit)[0]
            found = self._beside(a[miss], b[miss])
            out[miss] = found
            self.cache_keys[slot[miss]], self.cache_ok[slot[miss]] = key[miss], found
            # Of several misses on one slot one stays; its key must go with its own answer.
            lost = self.cache_keys[slot[miss]] != key[miss]
            self.cache_keys[slot[miss[lost]]] = -1
        return out

    def __getstate__(self):
        return self.__dict__ | {"cache_keys": None, "cache_ok": None}
