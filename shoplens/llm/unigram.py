"""SentencePiece-style encoding and decoding: unigram Viterbi over a
double-array trie of pieces with log scores.

Spaces become the marker, one marker is put in front, and the segmentation
with the largest sum of scores is found over a trie of the pieces' UTF-8
bytes. A character that no piece covers becomes the byte pieces of its UTF-8
form. Pieces carry the marker only in front of other characters, so the best
segmentation falls apart at each marker that follows another character. The
distinct parts of a slice of documents are solved together, one step of the
dynamic program for all of them at a time, and remembered up to a number of
bytes.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shoplens.llm.common import keyed
from shoplens.llm.token_count import pretokens

MARKER = "▁"
#: Score below the worst piece for a character without a piece, as in the
#: public library.
UNKNOWN_PENALTY = 10.0
#: Bytes of the parts that a worker remembers; parts over ``LONG`` bytes are
#: forgotten with their slice.
KNOWN_BYTES, LONG = 48 << 20, 64
#: Characters of documents that are worked on at a time, and bytes of the parts
#: whose segmentations are found together, unless they are fewer than ``FEW``.
SLICE, TOGETHER, FEW = 2 << 20, 1 << 18, 16
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class DoubleArray:
    """Double-array trie over bytes: state s goes by byte c to base[s] + c if
    check of that place is s. ``value`` is the piece that ends in a state."""

    def __init__(self, keys: dict[bytes, int]):
        size = 1 << 16
        self.base, self.check, self.value = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        self.check[0] = 0
        self._free = 1
        ordered = sorted(keys.items())
        todo = [(0, 0, 0, len(ordered))]  # state, depth, keys from, to
        while todo:
            state, depth, lo, hi = todo.pop()
            if lo < hi and len(ordered[lo][0]) == depth:
                self.value[state] = ordered[lo][1]
                lo += 1
            groups, at = [], lo
            while at < hi:
                c, start = ordered[at][0][depth], at
                while at < hi and ordered[at][0][depth] == c:
                    at += 1
                groups.append((c, start, at))
            if not groups:
                continue
            base = self._place([g[0] for g in groups])
            self.base[state] = base
            for c, a, b in groups:
                self.check[base + c] = state
                todo.append((base + c, depth + 1, a, b))
        top = max(i for i, c in enumerate(self.check) if c != -1) + 257  # every base + byte is a place
        self._room(top)
        for x in (self.base, self.check, self.value):
            del x[top:]

    def _place(self, labels: list[int]) -> int:
        """A base at which all labels are free. The search starts behind the
        region that has proven nearly full."""
        check, at, taken = self.check, self._free, 0
        while True:
            self._room(at + 512)
            if check[at] != -1:
                taken += 1
            else:
                base = at - labels[0]
                if base > 0 and all(check[base + c] == -1 for c in labels):
                    if taken >= 0.9 * (at - self._free + 1):
                        self._free = at
                    return base
            at += 1

    def _room(self, top: int) -> None:
        while top >= len(self.check):
            n = len(self.check)
            self.base.extend([0] * n), self.check.extend([-1] * n), self.value.extend([-1] * n)

    def prefixes(self, data: bytes, at: int) -> list[tuple[int, int]]:
        """(piece, end) of every piece that starts at ``at``."""
        base, check, value, state, out = self.base, self.check, self.value, 0, []
        for i in range(at, len(data)):
            to = base[state] + data[i]
            if check[to] != state or to == 0:
                break
            state = to
            if value[state] >= 0:
                out.append((value[state], i + 1))
        return out


@dataclass
class Unigram:
    """Pieces with log scores; ids are places in ``pieces``. ``<0xNN>`` are the
    byte pieces, ``special`` ids are never found in a text."""
    pieces: list[str]
    scores: list[float]
    special: frozenset[int] = frozenset()
    unknown: int = 0
    _known: dict = field(default_factory=dict, repr=False, compare=False)
    _held: int = field(default=0, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_held": 0}

    @cached_property
    def bytes_of(self) -> dict[int, int]:
        """Byte -> id of its byte piece."""
        return {int(m[1], 16): i for i, p in enumerate(self.pieces) if (m := _BYTE.fullmatch(p))}

    @cached_property
    def trie(self) -> DoubleArray:
        own = set(self.bytes_of.values())
        return DoubleArray({p.encode(): i for i, p in enumerate(self.pieces)
                            if p and i not in self.special and i not in own})

    @cached_property
    def apart(self) -> bool:
        """Whether no piece spans a marker behind another character."""
        inner = re.compile(f"[^{MARKER}]{MARKER}")
        return not any(inner.search(self.pieces[i]) for i in self.trie.value if i >= 0)

    @cached_property
    def worst(self) -> float:
        return min((self.scores[i] for i in self.trie.value if i >= 0), default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def _tables(self) -> tuple[np.ndarray, ...]:
        """The trie's arrays, the score of each piece, the id of each byte."""
        trie = self.trie
        byte = np.full(256, self.unknown, np.int32)
        for c, i in self.bytes_of.items():
            byte[c] = i
        return (*(np.array(x, np.int32) for x in (trie.base, trie.check, trie.value)),
                np.array(self.scores, np.float64), byte)

    def viterbi(self, marked: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one behind the other, number of each) of the best segmentation
        of marked texts; of equal sums, the one whose last piece is longest,
        and so on to the front."""
        base, check, value, scores, byte = self._tables
        n = np.array([len(m) for m in marked], np.int32)
        top, every = int(n.max(initial=0)), np.arange(len(n))
        data = np.zeros((top + 1, len(n)), np.uint8)  # a column per text
        flat = np.frombuffer(b"".join(marked), np.uint8)
        column = np.repeat(every, n)
        data[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n), column] = flat
        starts = (data & 0xC0) != 0x80
        width = 1 + (data >= 0xC0).astype(np.int32) + (data >= 0xE0) + (data >= 0xF0)
        best = np.full((top + 1, len(n)), -np.inf)
        back, piece = np.zeros((top + 1, len(n)), np.int32), np.full((top + 1, len(n)), -1, np.int32)
        best[0] = 0.0
        for i in range(top):
            own = np.flatnonzero(starts[i] & (i < n))
            single = np.zeros(len(n), bool)
            rows, state, j = own, np.zeros(len(own), np.int32), i
            while True:  # every piece that starts here
                to = base[state] + data[j, rows]
                j += 1
                on = (check[to] == state) & (to != 0) & (j <= n[rows])
                rows, state = rows[on], to[on]
                if not len(rows):
                    break
                found = value[state] >= 0
                r, p = rows[found], value[state[found]]
                single[r[i + width[i, r] == j]] = True
                total = best[i, r] + scores[p]
                more = total > best[j, r]
                r = r[more]
                best[j, r], back[j, r], piece[j, r] = total[more], i, p[more]
            r = own[~single[own]]
            j, total = i + width[i, r], best[i, r] + self.worst
            more = total > best[j, r]
            r, j = r[more], j[more]
            best[j, r], back[j, r], piece[j, r] = total[more], i, -1
        # from the ends to the fronts, a piece of every text at a time
        at, rows, steps = n.copy(), every[n > 0], []
        while len(rows):
            start = back[at[rows], rows]
            steps.append((rows, start, piece[at[rows], rows]))
            at[rows] = start
            rows = rows[start > 0]
        if not steps:
            return np.empty(0, np.int32), np.zeros(len(n), np.int64)
        rows, start, ids = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((start, rows))
        rows, start, ids = rows[order], start[order], ids[order]
        size = np.where(ids >= 0, 1, width[start, rows] if self.bytes_of else 1)
        if (ids < 0).any():  # characters without a piece become bytes
            at = np.repeat(np.arange(len(ids)), size)
            behind = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            by = byte[data[start[at] + behind, rows[at]]] if self.bytes_of else self.unknown
            ids = np.where(ids[at] >= 0, ids[at], by).astype(np.int32)
        return ids, np.bincount(rows, weights=size, minlength=len(n)).astype(np.int64)

    def viterbi_of(self, data: bytes) -> list[int]:
        """The same for one text, a byte at a time: better for a long one, of
        which there are few."""
        n, scores, worst = len(data), self.scores, self.worst
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best, back, piece = array("d", [-math.inf]) * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0], at = 0.0, 0
        while at < n:
            lead = data[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, single, state, end = best[at], False, 0, at
            while end < n:  # every piece that starts here
                to = base[state] + data[end]
                if check[to] != state or to == 0:
                    break
                state, end = to, end + 1
                p = value[to]
                if p >= 0:
                    single |= end == at + width
                    if here + scores[p] > best[end]:
                        best[end], back[end], piece[end] = here + scores[p], at, p
            if not single and here + worst > best[at + width]:
                best[at + width], back[at + width], piece[at + width] = here + worst, at, -1
            at += width
        out: list[int] = []
        at = n
        while at:
            p, start = piece[at], back[at]
            out.extend([p] if p >= 0 else [self.bytes_of[c] for c in reversed(data[start:at])] if self.bytes_of
                       else [self.unknown])
            at = start
        return out[::-1]

    def _solve(self, parts: list[str]) -> None:
        """Remembers the ids of parts, given without the marker in front."""
        marked = [(MARKER + p.replace(" ", MARKER)).encode() for p in parts]
        size = np.array([len(m) for m in marked], np.int64)
        order = np.argsort(size, kind="stable")  # alike in length, so that little is padded
        size, past = size[order], np.cumsum(size[order])
        first = 0
        while first < len(order):
            bounds = (past[first] + TOGETHER, size[first] * 2 + 16)
            last = max(first + 1, min(int(np.searchsorted(past, bounds[0])), int(np.searchsorted(size, bounds[1]))))
            own = order[first:last].tolist()
            if len(own) < FEW:
                each = [self.viterbi_of(marked[i]) for i in own]
                ids, n = np.array([x for ids in each for x in ids], np.int32), [len(x) for x in each]
            else:
                ids, n = self.viterbi([marked[i] for i in own])
            raw, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(n)).tolist()
            self._known.update((parts[i], raw[a:z]) for i, a, z in zip(own, [0, *ends], ends))
            self._held += len(raw)
            first = last
        self._held += 200 * len(parts) + int(size.sum())

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        known = self._known
        parts = [pretokens(t) if self.apart else [t.replace(MARKER, " ")] if t else [] for t in texts]
        new = list(set(chain.from_iterable(parts)) - known.keys())
        self._solve(new)
        out = [np.frombuffer(b"".join(map(known.__getitem__, p)), "<i4") for p in parts]
        for p in [p for p in new if len(p) > LONG]:
            self._held -= len(known.pop(p))
        if self._held > KNOWN_BYTES:
            known.clear()
            self._held = 0
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text or ""])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: pieces joined, runs of byte pieces as UTF-8
        (what is not UTF-8 as U+FFFD), markers as spaces, without the marker
        in front."""
        byte = self._byte_of_id
        if byte.keys().isdisjoint(ids) and self.special.isdisjoint(ids):
            return "".join(map(self.pieces.__getitem__, ids)).replace(MARKER, " ").removeprefix(" ")
        out: list[str] = []
        run = bytearray()
        for i in ids:
            c = byte.get(i)
            if c is not None:
                run.append(c)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i not in self.special:
                out.append(self.pieces[i])
        out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARKER, " ").removeprefix(" ")

    @cached_property
    def _byte_of_id(self) -> dict[int, int]:
        return {i: c for c, i in self.bytes_of.items()}


def load(path: str) -> Unigram:
    """The pieces of a sentencepiece model file. The scores of a merge-ranked
    vocabulary are no log probabilities; its pieces then get the log
    probability of a Zipf law over their ranks."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, scores = [model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)]
    special = frozenset(i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    plain = [i for i in range(n) if i not in special and not model.is_byte(i)]
    ranked = sorted(plain, key=lambda i: (-scores[i], i))
    if sum(scores[i] == float(int(scores[i])) for i in plain) == len(plain):  # ranks, not log probabilities
        total = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
        for r, i in enumerate(ranked):
            scores[i] = -math.log(r + 1) - total
    return Unigram(pieces, scores, special, model.unk_id())


def encode_documents(docs: DataFrame, model: Unigram, id_col: str = "doc_id", text_col: str = "text",
                     decode: bool = True) -> DataFrame:
    """One row per input row: uid, doc_id, ids, n_tokens and, unless ``decode``
    is off, n_byte_pieces and decoded (the text of the ids).

    ``decoded`` is the text with every U+2581 as a space; null and empty texts
    have no ids and decode to the empty text. Repeated rows are encoded alike.
    Texts of any length are encoded whole; an empty table gives no rows. Other
    columns are not read.
    """
    assert model.trie  # built once, here, and sent with the model
    known = docs.sparkSession.sparkContext.broadcast(model)

    def encoded(uid: pa.Array, doc: pa.Array, texts: list[str]) -> pa.RecordBatch:
        m = known.value
        ids = m.encode_many(texts)
        past = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        flat = np.concatenate([np.empty(0, "<i4"), *ids]).astype(np.int32)
        columns = {"uid": uid, "doc_id": doc, "ids": pa.ListArray.from_arrays(pa.array(past, pa.int32()), pa.array(flat)),
                   "n_tokens": pa.array(np.diff(past), pa.int64())}
        if decode:
            byte = np.zeros(len(m.pieces), bool)
            byte[list(m._byte_of_id)] = True
            bytes_before = np.concatenate([[0], np.cumsum(byte[flat])])
            columns["n_byte_pieces"] = pa.array(np.diff(bytes_before[past]), pa.int64())
            columns["decoded"] = pa.array([m.decode(x.tolist()) for x in ids], pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            first = held = 0
            for i, t in enumerate(texts, 1):
                held += len(t)
                if held >= SLICE or i == len(texts):
                    yield encoded(b.column(0).slice(first, i - first), b.column(1).slice(first, i - first),
                                  texts[first:i])
                    first, held = i, 0

    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"uid long, doc_id {kind}, ids array<int>, n_tokens long"
                           + (", n_byte_pieces long, decoded string" if decode else ""))
