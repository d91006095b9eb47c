"""Brackets and nodes of many documents at once, by numpy over the bytes of an Arrow batch.

A document's nodes follow from its own text, so nothing is exchanged or sorted for them: texts are read a few megabytes at
a time, every step is linear in their bytes and brackets but for sorts within that piece, and rows go out in batches of bounded size. A document
is never split; its pieces may exceed a row's 2 GB in the flat shape, since there each node is a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at once, unless one document alone is longer.
PIECE = 2 << 20
#: Bytes of cut text, and rows, that go out in one batch, unless one node or packed document alone is longer.
OUT, OUT_ROWS = 16 << 20, 200_000
FENCE_OPEN, FENCE_CLOSE = b'"#":{', b'},"#":#'
NUMBERS = {"at": np.int32, "ocid": np.int32, "ecid": np.int32}


def _ranks(sorted_groups: np.ndarray) -> np.ndarray:
    """Place of each row in its group, from 0."""
    i = np.arange(len(sorted_groups))
    new = np.ones(len(i), bool)
    new[1:] = sorted_groups[1:] != sorted_groups[:-1]
    return i - np.maximum.accumulate(np.where(new, i, 0))


def _ordered(groups: np.ndarray, items: np.ndarray, bits: int) -> np.ndarray:
    """(group << bits) | item, sorted; items are less than 1 << bits."""
    return np.sort((groups << bits) | items)


def _cut(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the pieces of source, one behind the other. Places outside of source give its edge."""
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat((start - offsets[:-1]).astype(np.int64), size)
    at += np.arange(offsets[-1])
    return offsets, source.take(at, mode="clip") if len(source) else np.zeros(len(at), np.uint8)


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def key_of(fragment: str) -> str | None:
    """text.key_name() of one fragment."""
    bare = fragment.replace("{", "").replace("[", "")
    return bare.rstrip(":").split(":")[-1].replace('"', "") if bare else None


def _lead(fragment: str) -> str:
    parts = fragment.replace('"#":{', "").split(":")
    return parts[1] if len(parts) > 1 else parts[0]


class Brackets:
    """Brackets of texts, in the order of documents and places. p, e: first and last byte; place: in characters, from 1;
    key, kpos: where the key before it begins, as a byte of the buffer and in characters; total: level behind it."""

    def __init__(self, texts: pa.Array, pairs: Sequence[tuple[str, str]]):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        self.buf = buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.begin, self.end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        chars = list(dict.fromkeys([*(c for p in pairs for c in p), ",", "[", "{", "}"]))
        lut = np.zeros(256, np.uint8)
        for i, c in enumerate(chars, 1):
            if len(c.encode()) == 1:
                lut[ord(c)] = i
        kind = lut[buf]
        for i, c in enumerate(chars, 1):
            b = c.encode()
            if len(b) > 1:
                at = np.flatnonzero(buf == b[0])
                at = at[at + len(b) <= len(buf)]
                for k in range(1, len(b)):
                    at = at[buf[at + k] == b[k]]
                kind[at] = i
        tok = np.flatnonzero(kind)
        kind = kind[tok]
        self.curly, self.shut = tok[kind == chars.index("{") + 1], tok[kind == chars.index("}") + 1]
        table = lambda of, dtype: np.array([of("")] + [of(c) for c in chars], dtype)
        step = lambda o, c, x: 1 if x == o else -1 if x == c else 0
        openers, closers = {o for o, _ in pairs}, {c for _, c in pairs}
        n, doc = len(tok), np.repeat(np.arange(len(self.begin)), np.diff(np.append(np.searchsorted(tok, self.begin), len(tok))))
        latest = lambda c: np.maximum.accumulate(np.where(kind == chars.index(c) + 1, tok, -1)) if n else tok
        back = lambda x: np.concatenate([[-1], x[:-1]]) if n else x
        comma, square, curly = latest(","), back(latest("[")), back(latest("{"))
        # The [ right before the bracket does not count.
        square = np.where(square == tok - 1, back(square), square)
        first = self.begin[doc]
        key = np.where(comma >= first, comma, np.where(square >= first, square, np.where(curly >= first, curly, first - 1)))
        mine = np.flatnonzero(table(lambda c: c in openers or c in closers, bool)[kind])
        kind = kind[mine]
        self.p, self.key, self.doc = tok[mine], key[mine], doc[mine]
        self.w = table(lambda c: len(c.encode()), np.int64)[kind]
        self.e = self.p + self.w - 1
        self.opens = table(lambda c: c in openers, bool)[kind]
        self.kind, self.chars = kind, chars
        before = np.searchsorted(self.p, self.begin)

        def running(of) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(table(of, np.int64)[kind])])
            return upto[1:] - upto[before][self.doc]

        self.levels = [running(lambda x, o=o, c=c: step(o, c, x)) for o, c in pairs]
        self.total, self.nest = sum(self.levels[1:], self.levels[0]), self.levels[0]
        first = self.begin[self.doc]
        if len(buf) and int(buf.max()) > 127:
            upto = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            self.place, self.kpos = upto[self.e + 1] - upto[first], upto[self.key + 1] - upto[first]
        else:
            self.place, self.kpos = self.e + 1 - first, self.key + 1 - first


class Nodes:
    """Nodes down to level pick in the order of documents, levels and slots; see fields()."""

    def __init__(self, b: Brackets, pick: int):
        self.b, bits = b, max(1, int(len(b.p)).bit_length())
        depth = b.total - b.opens
        keep = np.flatnonzero(depth <= pick)
        low = int(depth[keep].min()) if len(keep) else 0
        span = (int(depth[keep].max()) if len(keep) else 0) - low + 2
        self.wide = len(b.begin) * span << bits >= 1 << 62
        if self.wide and len(b.begin) > 1:
            return
        # A level of a document; between two documents there is one without nodes.
        group = (b.doc * span + (depth - low)) + 1
        mask = (1 << bits) - 1
        opening = keep[b.opens[keep]]
        closing = keep[~b.opens[keep]]
        heads, tails = _ordered(group[opening], opening, bits), _ordered(group[closing], closing, bits)
        ho, hc = heads & mask, tails & mask
        go, gc = heads >> bits, tails >> bits
        if len(go) == len(gc) and np.array_equal(go, gc):
            head, tail, g, node_of = ho, hc, go, np.arange(len(go))
        else:
            ko, kc = (go << bits) | _ranks(go), (gc << bits) | _ranks(gc)
            every = np.union1d(ko, kc)
            head, tail = np.full(len(every), -1), np.full(len(every), -1)
            node_of = np.searchsorted(every, ko)
            head[node_of], tail[np.searchsorted(every, kc)] = ho, hc
            head, tail = np.where(head >= 0, head, tail), np.where(tail >= 0, tail, head)
            g = every >> bits
        self.head, self.tail, self.group = head, tail, g
        self.n, self.doc, self.depth, self.slot = len(head), b.doc[head], depth[head], _ranks(g)
        self.open, self.close, self.nest, self.kpos = b.place[head], b.place[tail], b.nest[head], b.kpos[head]
        self.first = np.searchsorted(self.doc, np.arange(len(b.begin) + 1))
        self.at = np.arange(self.n) - self.first[self.doc]
        # The parent is the last bracket of the level above that opened before.
        up = np.searchsorted(heads, ((g - 1) << bits) | head) - 1 if len(heads) else np.full(self.n, -1)
        found = (up >= 0) & (self.depth >= 1)
        found &= go[up] == g - 1 if len(go) else False
        up = np.where(found, node_of[up] if len(node_of) else -1, -1)
        self.up = np.where(found & (self.close[up] > self.close), up, -1) if self.n else up
        self._unfenced = None

    def fragment_places(self) -> tuple[np.ndarray, np.ndarray]:
        start, stop = self.b.key[self.head] + 1, self.b.e[self.head] + 1
        stop = np.maximum(start, stop)
        blank = np.flatnonzero((start < stop) & (self.b.buf[np.minimum(start, len(self.b.buf) - 1)] == 32)) if self.n else []
        if len(blank):
            solid = np.append(np.flatnonzero(self.b.buf != 32), len(self.b.buf))
            start[blank] = np.minimum(solid[np.searchsorted(solid, start[blank])], stop[blank])
        return start, stop - start

    def unfenced(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """The buffer without fences, how many of its bytes stand before each byte, and whether a node's text is always
        its part of that."""
        if self._unfenced is None:
            buf, ends = self.b.buf, self.b.end
            keep = np.ones(len(buf), bool)

            def spots(at: np.ndarray, what: bytes) -> np.ndarray:
                """Places where what starts, within one document."""
                at = at[(at >= 0) & (at + len(what) <= len(buf))]
                for k, c in enumerate(what):
                    at = at[buf[at + k] == c]
                return at[at + len(what) <= ends[np.searchsorted(ends, at, "right")]] if len(at) else at

            opened, shut = spots(self.b.curly - len(FENCE_OPEN) + 1, FENCE_OPEN), spots(self.b.shut, FENCE_CLOSE)
            for at, what in ((opened, FENCE_OPEN), (shut, FENCE_CLOSE)):
                for k in range(len(what)):
                    keep[at + k] = False
            self._unfenced = (buf[keep], np.concatenate([[0], np.cumsum(keep)]), self._plain(opened, spots))
        return self._unfenced

    def _plain(self, opened: np.ndarray, spots) -> bool:
        brackets = {"[", "]", "{", "}"}
        if not set("".join(self.b.chars)) <= brackets | {","} or len(opened) == 0:
            return set("".join(self.b.chars)) <= brackets | {","}
        buf, near = self.b.buf, len(FENCE_OPEN) + len(FENCE_CLOSE)
        if (opened[1:] - opened[:-1] < near).any():
            # Seams so near that one closing fence may cover two.
            once = np.ones(len(buf), bool)
            for k in range(len(FENCE_OPEN)):
                once[opened + k] = False
            kept = np.flatnonzero(once)
            whole = bytes(buf[kept])
            at = whole.find(FENCE_CLOSE)
            while at >= 0:
                if kept[at + len(FENCE_CLOSE) - 1] - kept[at] != len(FENCE_CLOSE) - 1:
                    return False
                at = whole.find(FENCE_CLOSE, at + 1)
            return True
        for left in range(1, len(FENCE_CLOSE)):
            at = opened[(opened >= left) & (opened + near - left <= len(buf))]
            for k, c in enumerate(FENCE_CLOSE):
                at = at[buf[at + (k - left if k < left else len(FENCE_OPEN) + k - left)] == c]
            if len(at):
                return False
        return True

    def json_sizes(self) -> np.ndarray:
        b, (_, upto, plain) = self.b, self.unfenced()
        first, last = b.p[self.head], b.e[self.tail]
        if not plain:
            return np.maximum(0, last - first + 1)
        return np.where(last > first, 2 + np.maximum(0, upto[last] - upto[np.minimum(first + 1, last)]), (last == first).astype(np.int64))

    def json(self, rows: slice) -> pa.Array:
        """Texts from bracket to bracket without fences. The first and the last byte stay, also where a fence has them."""
        b, (bare, upto, plain) = self.b, self.unfenced()
        first, last = b.p[self.head[rows]], b.e[self.tail[rows]]
        if not plain:
            raw = _strings(*_cut(b.buf, first, np.maximum(0, last - first + 1)))
            return pc.replace_substring(pc.replace_substring(raw, FENCE_OPEN.decode(), ""), FENCE_CLOSE.decode(), "")
        size = self.sizes[rows]
        offsets, data = _cut(bare, upto[first + 1] - 1, size)
        some = size > 0
        data[offsets[:-1][some]] = b.buf[first[some]]
        data[offsets[1:][some] - 1] = b.buf[last[some]]
        return _strings(offsets, data)

    def name(self) -> None:
        """Keys as written (raw, a number of names, -1: none), fenced, and the marks of arrays."""
        fragments = _strings(*_cut(self.b.buf, *self.fragment_places())).dictionary_encode()
        kinds, code = fragments.dictionary.to_pylist(), fragments.indices.to_numpy(zero_copy_only=False)
        names: dict[str, int] = {}
        number = lambda k: -1 if k is None else names.setdefault(k, len(names))
        keys, leads = [key_of(f) for f in kinds], [_lead(f) for f in kinds]
        pick = lambda values, dtype: np.array(values, dtype)[code] if len(values) else np.zeros(0, dtype)
        self.fenced = pick([k == "#" for k in keys], bool)
        ends = [f[-1:] for f in kinds]
        symbols = sorted({"#", *ends})
        sym = np.where(self.fenced, symbols.index("#"), pick([symbols.index(e) for e in ends], np.int64))
        self.symbols, self.sym = symbols, sym
        self.starts = pick([x[:1] == "[" and x[1:2] in ("[", "{") and len(x) > 1 for x in leads], bool)
        listed = [i for i, s in enumerate(symbols) if s in ("[", "{")]
        self.marked = pick([x in ("[{", "[[") for x in leads], bool) & np.isin(sym, listed)
        raw = pick([number(k) for k in keys], np.int64)
        some = np.flatnonzero(self.fenced)
        if len(some):
            texts, clear = self._heads(some), str.maketrans("", "", '{}"')
            heads = texts.dictionary_encode()
            new = np.array([number(t.translate(clear)) for t in heads.dictionary.to_pylist()], np.int64)
            raw[some] = new[heads.indices.to_numpy(zero_copy_only=False)]
        self.raw, self.names = raw, names

    def _heads(self, some: np.ndarray) -> pa.Array:
        """Of nodes: their texts up to the first colon."""
        b, (bare, upto, plain) = self.b, self.unfenced()
        if not plain:
            parts = [x.split(":")[0] for s in some.tolist() for x in self.json(slice(s, s + 1)).to_pylist()]
            return pa.array(parts, pa.string())
        colons = np.append(np.flatnonzero(bare == ord(":")), len(bare))
        first = b.p[self.head[some]]
        start, size = upto[first + 1], self.sizes[some]
        until = colons[np.searchsorted(colons, start)] - start + 1
        short = np.minimum(until, size)
        offsets, data = _cut(bare, start - 1, short)
        some_bytes = short > 0
        data[offsets[:-1][some_bytes]] = b.buf[first[some_bytes]]
        whole = some_bytes & (until >= size)
        data[offsets[1:][whole] - 1] = b.buf[b.e[self.tail[some[whole]]]]
        return _strings(offsets, data)

    def _rank(self, level: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Place among the nodes of a level and code, in the order of open."""
        bits = max(1, int(self.n).bit_length())
        top = int(code.max()) + 2 if self.n else 1
        both = level * top + code + 1
        if ((int(level[-1]) + 1) * top if self.n else 0) << bits >= 1 << 62:
            both = np.unique(both, return_inverse=True)[1].astype(np.int64)
        rows = _ordered(both[self.by_open], np.arange(self.n), bits)
        out = np.empty(self.n, np.int64)
        out[self.by_open[rows & ((1 << bits) - 1)]] = _ranks(rows >> bits)
        return out

    def number(self, strict: bool) -> None:
        """acid, list, and for children (own) and parents (above) ocid, ecid, keys and ordinals."""
        self.sizes = self.json_sizes()
        self.name()
        n, i = self.n, np.arange(self.n)
        level = np.cumsum(np.concatenate([[0], self.group[1:] != self.group[:-1]])) if n else i
        rising = (self.open[1:] > self.open[:-1]) | (level[1:] != level[:-1])
        self.by_open = i if rising.all() else np.lexsort((self.open, level))
        if strict:
            family = level
        else:
            family = level * (n + 1) + self.up + 1
        order = i if n == 0 or (family[1:] >= family[:-1]).all() else np.argsort(family, kind="stable")
        groups = family[order]
        row = _ranks(groups)
        starts, marked = self.starts[order], self.marked[order]
        first = i - row
        upto = np.cumsum(starts)
        acid = upto - (upto - starts)[first] if n else upto
        # The last mark and the last start, if they are of the same family.
        mark = np.maximum.accumulate(np.where(marked, i, -1)) if n else i
        start = np.maximum.accumulate(np.where(starts | (row == 0), i, -1)) if n else i
        listed = (mark >= first) & (acid[mark] == acid) if n else np.zeros(0, bool)
        self.acid, self.list, self.index = np.empty(n, np.int64), np.empty(n, bool), np.empty(n, np.int64)
        self.acid[order], self.list[order], self.index[order] = acid, listed, i - start
        if strict:
            # Parents without a key take that of the parent of their level that opened before; so do children.
            sorted_raw, sorted_level = self.raw[self.by_open], level[self.by_open]
            seen = np.maximum.accumulate(np.where(sorted_raw >= 0, i, -1)) if n else i
            begins = np.searchsorted(sorted_level, sorted_level)
            latest = np.where(seen >= begins, sorted_raw[seen], -1) if n else i
            above = np.empty(n, np.int64)
            above[self.by_open] = latest
            wide = int(self.open.max()) + 1 if n else 1
            opened = self.group[self.by_open] * wide + self.open[self.by_open]
            at = np.searchsorted(opened, (self.group - 1) * wide + self.open) - 1
            known = (at >= 0) & (self.group[self.by_open][at] == self.group - 1) if n else np.zeros(0, bool)
            own = np.where(self.raw >= 0, self.raw, np.where(known, latest[at], -1)) if n else i
            self.roles = [self._role(level, own), self._role(level, above)]
        else:
            own = np.where((self.raw < 0) & (self.up >= 0), self.raw[self.up], self.raw) if n else i
            self.roles = [self._role(level, own)]

    def _role(self, level: np.ndarray, key: np.ndarray) -> dict:
        ocid = self._rank(level, key)
        ecid = self._rank(level, ocid)
        names = [None, "$", *self.names]
        name = np.where((key < 0) & (self.open == 1), 1, np.where(key < 0, 0, key + 2))
        index = np.where(self.list, self.index + 1, 0)
        codes, inverse = _distinct(name, index)
        keys = [names[a] if not x else f"{names[a] or ''}[{x - 1}]" for a, x in codes]
        places, which = _distinct(ocid, ecid)
        ords = [f"@{{{o},{e}}}" for o, e in places]
        return {"ocid": ocid, "ecid": ecid, "key": (pa.array(keys, pa.string()), inverse), "ord": (pa.array(ords, pa.string()), which)}

    def texts(self, role: dict, name: str, at: np.ndarray | slice) -> pa.Array:
        """Keys or ordinals of nodes; none for -1."""
        values, code = role[name]
        rows = np.arange(self.n)[at] if isinstance(at, slice) else at
        if len(code) == 0:
            return pa.nulls(len(rows), pa.string())
        missing = rows < 0
        return values.take(pa.array(code[rows], pa.int64(), mask=missing if missing.any() else None))

    def fields(self, names: Sequence[str], rows: slice, role: int = 0) -> dict[str, pa.Array]:
        out = {}
        for f in names:
            if f in ("depth", "slot", "open", "close", "nest", "kpos", "at", "acid"):
                out[f] = pa.array(getattr(self, f)[rows].astype(NUMBERS.get(f, np.int64)) + (role if f == "depth" else 0))
            elif f in ("ocid", "ecid"):
                out[f] = pa.array(self.roles[role][f][rows].astype(np.int32))
            elif f == "list":
                out[f] = pa.array(self.list[rows])
            elif f == "raise":
                out[f] = pa.array(np.full(rows.stop - rows.start, role == 0))
            elif f == "sym":
                out[f] = pa.array(self.symbols, pa.string()).take(pa.array(self.sym[rows]))
            elif f in ("key", "ord"):
                out[f] = self.texts(self.roles[role], f, rows)
            elif f == "fragment":
                start, size = self.fragment_places()
                out[f] = _strings(*_cut(self.b.buf, start[rows], size[rows]))
            elif f == "json":
                out[f] = self.json(rows)
            elif f == "nth":
                out[f] = pa.array(np.where(self.depth[rows] == 0, 0, self.at[rows]))
            elif f == "parenth":
                out[f] = self.parenth(rows)
            elif f == "parent":
                up, above = self.up[rows], self.roles[-1]
                parts = [self.parenth(rows), self.texts(above, "key", up), self.texts(above, "ord", up)]
                out[f] = pa.StructArray.from_arrays(parts, names=["nth", "key", "ord"])
            else:
                raise KeyError(f)
        return out

    def parenth(self, rows: slice) -> pa.Array:
        """Roots share the number 0, and so do the parents of the level below them."""
        depth, up = self.depth[rows], self.up[rows]
        value = np.where((depth > 1) & (up >= 0), self.at[up] if self.n else 0, 0)
        return pa.array(value.astype(np.int64), mask=depth < 1)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The different pairs of two columns of whole numbers, and which one each row has."""
    if len(a) == 0:
        return [], a
    wide = int(b.max()) + 1
    both = a * wide + b
    if int(both.max()) < 4 * len(both) + 1024:
        there = np.zeros(int(both.max()) + 1, bool)
        there[both] = True
        values = np.flatnonzero(there)
        inverse = (np.cumsum(there) - 1)[both]
    else:
        values, inverse = np.unique(both, return_inverse=True)
    return list(zip((values // wide).tolist(), (values % wide).tolist())), inverse


def _pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of whole documents, of at most PIECE bytes if there is more than one."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        base = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, base + PIECE, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _parts(weights: np.ndarray) -> Iterator[slice]:
    """Runs of rows of at most OUT bytes and OUT_ROWS rows."""
    upto, at, n = np.cumsum(weights, dtype=np.int64), 0, len(weights)
    while at < n:
        base = upto[at - 1] if at else 0
        stop = min(at + OUT_ROWS, max(at + 1, int(np.searchsorted(upto, base + OUT, "right"))))
        yield slice(at, min(stop, n))
        at = stop


def _halves(batch: pa.RecordBatch, text: str, pairs, pick: int) -> Iterator[tuple[pa.RecordBatch, Nodes]]:
    nodes = Nodes(Brackets(batch.column(text), pairs), pick)
    if nodes.wide and batch.num_rows > 1:
        half = batch.num_rows // 2
        yield from _halves(batch.slice(0, half), text, pairs, pick)
        yield from _halves(batch.slice(half), text, pairs, pick)
    else:
        yield batch, nodes


def _nodes(batches, text, pairs, pick, numbered, strict, every: bool = False) -> Iterator[tuple[pa.RecordBatch, Nodes]]:
    for batch in batches:
        for piece in _pieces(batch, text):
            for part, nodes in _halves(piece, text, pairs, pick):
                if nodes.n or every:
                    if numbered:
                        nodes.number(strict)
                    yield part, nodes


#: Fields that need no keys, numbers or marks.
SIMPLE = {"depth", "slot", "open", "close", "nest", "kpos", "at", "fragment", "json", "nth", "parenth"}


def flat(by: Sequence[str], text: str, pairs, pick: int, strict: bool, names: Sequence[str], roles: bool = False):
    """A function of Arrow batches: by and the named fields, one row a node; with roles also one as a parent."""

    def run(batches):
        for docs, nodes in _nodes(batches, text, pairs, pick, not set(names) <= SIMPLE, strict):
            if "json" in names:
                nodes.sizes = nodes.json_sizes()
            for rows in _parts(nodes.sizes if "json" in names else np.zeros(nodes.n, np.int64)):
                for role in range(2 if roles else 1):
                    owner = pa.array(nodes.doc[rows])
                    out = pa.RecordBatch.from_arrays([*[docs.column(c).take(owner) for c in by], *nodes.fields(names, rows, role).values()], names=[*by, *names])
                    if role:
                        out = out.filter(pa.array(nodes.depth[rows] + 1 <= pick))
                    if out.num_rows:
                        yield out

    return run


def packed(keep: Sequence[str], text: str, pairs, pick: int, strict: bool, names: Sequence[str], levels: bool = False):
    """A function of Arrow batches: the kept columns and nodes, one row a document that has any: an array of the named
    fields; with levels one of depth and children, and also the documents that have none."""

    def run(batches):
        for docs, nodes in _nodes(batches, text, pairs, pick, True, strict, levels):
            weights = np.bincount(nodes.doc, nodes.sizes, docs.num_rows).astype(np.int64)
            for part in _parts(weights):
                first = nodes.first[part.start : part.stop + 1]
                rows = slice(int(first[0]), int(first[-1]))
                mine = np.arange(len(first) - 1) if levels else np.flatnonzero(np.diff(first))
                if not len(mine):
                    continue
                value = nodes.fields([f for f in names if not levels or f != "depth"], rows)
                value = pa.StructArray.from_arrays(list(value.values()), names=list(value))
                ends = np.append(first[mine], rows.stop) - rows.start
                if levels:
                    group = nodes.group[rows]
                    begins = np.flatnonzero(np.concatenate([[len(group) > 0], group[1:] != group[:-1]]))
                    children = pa.ListArray.from_arrays(pa.array(np.append(begins, len(group)).astype(np.int32)), value)
                    value = pa.StructArray.from_arrays([pa.array(nodes.depth[rows][begins]), children], names=["depth", "children"])
                    ends = np.searchsorted(begins, ends)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), value)
                owner = pa.array(mine + part.start)
                yield pa.RecordBatch.from_arrays([*[docs.column(c).take(owner) for c in keep], lists], names=[*keep, "nodes"])

    return run


def contained(by: Sequence[str], text: str, pairs):
    """A function of Arrow batches: by, idx, sub, total (the level behind the bracket, from -1), step and one depth a pair,
    one row a bracket."""

    def run(batches):
        for batch in batches:
            for docs in _pieces(batch, text):
                b = Brackets(docs.column(text), pairs)
                chars, step = pa.array(["", *b.chars], pa.string()), np.where(b.opens, 1, -1).astype(np.int32)
                for rows in _parts(np.zeros(len(b.p), np.int64)):
                    owner = pa.array(b.doc[rows])
                    numbers = [b.total[rows] - 1, step[rows], *[d[rows] for d in b.levels]]
                    columns = [*[docs.column(c).take(owner) for c in by], pa.array(b.place[rows]), chars.take(pa.array(b.kind[rows])), *map(pa.array, numbers)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*by, "idx", "sub", "total", "step", *[f"_depth{i}" for i in range(len(pairs))]])

    return run
