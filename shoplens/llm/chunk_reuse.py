"""Byte-level BPE by reuse of content-defined chunks.

A rolling hash over the bytes of a text cuts it where the hash has leading
zeros, so equal passages of different documents give equal chunks. A chunk
that the corpus holds more than once is encoded once, by itself, and its ids
are joined back to its places; what lies between shared chunks is encoded where
it stands.

An encoding of a piece by itself can differ from the whole text's near both
ends. Joins are repaired by encoding the unsettled end of what lies before
together with the start of the next piece, and more of it, until both agree on
a place at which the library starts a pre-token. The library reads pre-tokens
from left to right without looking back, so behind such a place the ids depend
only on the text that follows, and the piece's own ids are those of the whole
text, up to the few pre-tokens whose end the next piece can still move.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import keyed, materialize

#: Bytes of a chunk: least, most, and leading zero bits of the hash at a cut
#: (1 KB behind the least, on average).
LEAST, MOST, ZEROS = 256, 16384, 10
#: Bits of the broadcast bitmap of shared chunks for each of them, and at most
#: (16 MB). Where it is too full it marks more chunks than are shared: these
#: take the shared way too, with the same result.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Bytes of remembered segments in a Python worker; longer segments are not kept.
KNOWN_BYTES, LONG = 128 << 20, 64
#: Bytes of text that are worked on at a time.
SLICE = 4 << 20
#: Bytes that a pre-token's match may look at from its start or behind its end:
#: three characters of a contraction, or two of any length.
AHEAD = 8


# -- chunks -----------------------------------------------------------------

def _gear() -> np.ndarray:
    """A random number for each byte value."""
    raw = b"".join(hashlib.blake2b(bytes([b]), digest_size=4).digest() for b in range(256))
    return np.frombuffer(raw, "<u4")


_GEAR = _gear()


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of the 32 bytes that end there (sum of the
    bytes' numbers, each shifted by its distance), by doubling."""
    h, k = _GEAR[data], 1
    while k < 32:
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        k *= 2
    return h


def cut(texts: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each UTF-8 text, between characters; the empty
    text has none. Chunks depend on the text's own bytes alone."""
    size = np.array([len(t) for t in texts], np.int64)
    past = np.cumsum(size)
    data = np.frombuffer(b"".join(texts), np.uint8)
    places = np.empty(0, np.int64)
    if len(data):
        h = rolling_hash(data)
        # a cut lies behind the byte at which the hash ends, before the start of a character
        places = np.flatnonzero((h[:-1] < np.uint32(1 << (32 - ZEROS))) & ((data[1:] & 0xC0) != 0x80)) + 1
    bounds = np.searchsorted(places, np.concatenate([[0], past]), side="right").tolist()
    places, out = places.tolist(), []
    for i, (n, end) in enumerate(zip(size.tolist(), past.tolist(), strict=True)):
        text, ends, last = texts[i], [], 0
        for p in [*(p - end + n for p in places[bounds[i]:bounds[i + 1]]), n]:
            while p - last > MOST:  # no cut for long
                last += MOST
                while text[last] & 0xC0 == 0x80:
                    last -= 1
                ends.append(last)
            if p == n or (p - last >= LEAST):
                if p > last:
                    ends.append(p)
                last = p
        out.append(ends)
    return out


def digest(chunk: bytes) -> bytes:
    """The 128-bit identifier of a chunk's content."""
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _slot(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _slices(texts: list[bytes]):
    """(first, past) of runs of texts of about ``SLICE`` bytes."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= SLICE:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


# -- encoding ---------------------------------------------------------------

class Units(NamedTuple):
    """Ids of a piece, and past which ids and bytes its units end. A unit is
    one or more whole pre-tokens."""
    ids: np.ndarray
    ends: np.ndarray
    bytes: np.ndarray


class Codec:
    """The library's ids of pieces, their joins, and the texts of ids."""

    #: A space between two characters that no engine takes for white space
    #: starts a pre-token, whatever stands around it.
    CUT = re.compile(r"(?<=\S) (?=\S)")
    #: A segment that is a pre-token of Latin letters, and maybe one of a mark.
    WORD = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]?)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        made = json.loads(self.library.to_str())
        pre, added = made["pre_tokenizer"] or {}, made["added_tokens"]
        if (made["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or (made["model"].get("dropout") or 0) > 0
                or any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"])
                       or not re.search("[^A-Za-zÀ-ÖØ-öø-ɏ.,;:!?]", a["content"]) for a in added)):
            raise ValueError("joins are proven for byte-level BPE without normalizer or prefix space only")
        self.special = [a["content"].encode() for a in added]
        # byte -> printable character, the convention of byte-level vocabularies
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(
            b for b in range(256) if b not in shown)}
        self.shown = {b: c for c, b in byte.items()}
        own = {a["id"]: a["content"].encode() for a in added}
        self.bytes_of = [own[i] if i in own else bytes(byte[c] for c in self.library.id_to_token(i) or "")
                         for i in range(self.library.get_vocab_size())]
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.kind = "<u2" if len(self.size) <= 1 << 16 else "<u4"  # of packed ids
        self.known: dict[str, bytes] = {}
        self.room = KNOWN_BYTES

    def _pretoken(self, text: str) -> bytes:
        shown = text.encode().decode("latin-1").translate(self.shown)
        return b"".join([t.id.to_bytes(4, "little") for t in self.library.model.tokenize(shown)])

    def _encode(self, segment: str) -> bytes:
        """Ids of a segment by the library; a word goes to its model at once."""
        word = self.WORD.fullmatch(segment)
        if not word:
            return np.array(self.library.encode(segment, add_special_tokens=False).ids, "<u4").tobytes()
        return self._pretoken(word[1]) + (self._pretoken(word[2]) if word[2] else b"")

    def _segments(self, text: str) -> tuple[list[str], list[bytes]]:
        """The segments of a text, each without the space in front, and their
        ids. Only segments without white space at their ends are remembered,
        so where all are known every space is a cut."""
        keys, known = text.split(" "), self.known
        found = list(map(known.get, keys))
        found[0] = None  # no space in front
        new = [i for i, v in enumerate(found) if v is None]
        if len(keys) > 1 and (any(not (k := keys[i]) or k[0].isspace() or k[-1].isspace() for i in new[1:])
                              or not keys[0] or keys[0][-1].isspace()):
            keys = self.CUT.split(text)
            found = [None, *map(known.get, keys[1:])]
            new = [i for i, v in enumerate(found) if v is None]
        for i in new[1:]:
            k = keys[i]
            v = known.get(k)
            if v is None:
                v = self._encode(" " + k)
                if self.room > 0 and len(k) <= LONG and not (k[0].isspace() or k[-1].isspace()):
                    known[k] = v
                    self.room -= 200 + len(k) + len(v)
            found[i] = v
        found[0] = self._encode(keys[0]) if keys[0] else b""
        return keys, found

    def ids(self, data: bytes) -> np.ndarray:
        """Ids of a whole text."""
        if not data:
            return np.empty(0, "<u4")
        return np.frombuffer(b"".join(self._segments(data.decode())[1]), "<u4")

    def units(self, data: bytes) -> Units:
        """A piece encoded by itself. Long segments, as of scripts without
        spaces, have a unit for each pre-token."""
        keys, found = self._segments(data.decode())
        past = np.cumsum([len(v) // 4 for v in found])
        inner = []
        for i in np.flatnonzero([len(k) > LONG for k in keys]).tolist():
            words = self.library.encode((" " if i else "") + keys[i], add_special_tokens=False).word_ids
            at = int(past[i]) - len(words)
            inner.extend(at + j for j in range(1, len(words)) if words[j] != words[j - 1])
        if inner:
            past = np.union1d(past, inner)
        return self._units(np.frombuffer(b"".join(found), "<u4"), past)

    def _units(self, ids: np.ndarray, ends: np.ndarray) -> Units:
        return Units(ids, ends, np.cumsum(self.size[ids])[ends - 1])

    def pack(self, units: Units) -> tuple[bytes, bytes]:
        """A piece's ids, and a bit for each that ends a unit."""
        last = np.zeros(len(units.ids), bool)
        last[units.ends - 1] = True
        return units.ids.astype(self.kind).tobytes(), np.packbits(last).tobytes()

    def unpack(self, ids: bytes, last: bytes) -> Units:
        ids = np.frombuffer(ids, self.kind).astype("<u4")
        return self._units(ids, np.flatnonzero(np.unpackbits(np.frombuffer(last, np.uint8), count=len(ids))) + 1)

    def raw(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def text(self, ids: np.ndarray) -> str:
        """The text of ids, as the library decodes them with special tokens."""
        return self.raw(ids).decode("utf-8", "replace")

    def _settled(self, n: int, end: bytes, units: Units) -> int:
        """Number of leading units that hold whatever follows the piece of
        ``n`` bytes, which ends with ``end``: those that end well before its
        end, or before what may be the start of a special token."""
        cut_off = max((k for s in self.special for k in range(1, len(s)) if end.endswith(s[:k])), default=0)
        return int(np.searchsorted(units.bytes, n - cut_off - AHEAD, side="right"))

    def stitch(self, pieces: list[Units]) -> np.ndarray:
        """Ids of the text whose pieces, each encoded by itself, are given."""
        longest = max(map(len, self.special), default=1)
        out, tail, wait = [], b"", 0  # tail: the text that is not settled yet, from a true start of a pre-token
        for k, piece in enumerate(pieces):
            last, u = k == len(pieces) - 1, 0  # u: units of the piece before the agreement
            if tail:
                if len(tail) < wait:  # a run without pre-tokens: tried again when it has doubled
                    tail, u = tail + self.raw(piece.ids), None
                else:
                    tail, u = self._join(out, tail, piece)
                    wait = 0 if len(tail) < 4096 else 2 * len(tail)
            if u is None:
                continue
            first = piece.ends[u - 1] if u else 0
            if last:
                out.append(piece.ids[first:])
                tail = b""
            else:
                held = self._settled(int(piece.bytes[-1]), self.raw(piece.ids[-longest:]), piece)
                past = max(first, piece.ends[held - 1] if held else 0)
                out.append(piece.ids[first:past])
                tail = self.raw(piece.ids[past:])
        if tail:
            out.append(self.ids(tail))
        return np.concatenate(out) if out else np.empty(0, "<u4")

    def _join(self, out: list, tail: bytes, piece: Units) -> tuple[bytes, int | None]:
        """Settles the tail before a piece. Returns the number of the piece's
        units before the first agreement, or a new tail and None."""
        n = 4
        while True:
            n = min(2 * n, len(piece.ends))
            window = tail + self.raw(piece.ids[:piece.ends[n - 1]])
            w = self.units(window)
            held = self._settled(len(window), window[-64:], w)
            both, _, mine = np.intersect1d(np.concatenate([[0], piece.bytes[:n]]) + len(tail), w.bytes[:held],
                                           assume_unique=True, return_indices=True)
            if len(both):
                out.append(w.ids[:w.ends[mine[0]]])
                return b"", int(np.searchsorted(piece.bytes, both[0] - len(tail), side="right"))
            if n == len(piece.ends):
                past = w.ends[held - 1] if held else 0
                out.append(w.ids[:past])
                return self.raw(w.ids[past:]), None


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec: what it has learned is kept between tasks."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


# -- documents --------------------------------------------------------------

def _shared_bitmap(rows: DataFrame) -> np.ndarray:
    """A bitmap of the chunks that the corpus holds more than once."""
    def count(batches):
        for b in batches:
            seen: Counter = Counter()
            texts = _texts(b.column(0))
            for first, past in _slices(texts):
                for text, ends in zip(texts[first:past], cut(texts[first:past]), strict=True):
                    at = 0
                    for end in ends:
                        seen[_slot(digest(text[at:end]))] += 1
                        at = end
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())],
                                             names=["slot", "n"])

    shared = materialize(rows.select("text").mapInArrow(count, "slot long, n long")
                         .groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").select("slot"), "shared-chunks")
    n = shared.count()
    bits = 1 << 10
    while bits < min(BITS_EACH * n, MOST_BITS):
        bits *= 2
    slot = F.col("slot").bitwiseAND(F.lit(bits - 1))
    cells = (shared.groupBy(F.shiftright(slot, 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits")).toArrow())
    out = np.zeros(bits // 64, np.uint64)
    out[cells.column(0).to_numpy()] = cells.column(1).to_numpy().view(np.uint64)
    return out


def _marked(wanted: np.ndarray, key: bytes) -> bool:
    slot = _slot(key) & (64 * len(wanted) - 1)
    return bool(int(wanted[slot >> 6]) >> (slot & 63) & 1)


def _pieces(text: bytes, ends: list[int], wanted: np.ndarray) -> list[tuple[bytes | None, bytes]]:
    """(identifier, bytes) of the marked chunks of a text, and (None, bytes) of
    each run between them."""
    out, at, open_at = [], 0, 0
    for end in ends:
        key = digest(text[at:end])
        if _marked(wanted, key):
            if open_at < at:
                out.append((None, text[open_at:at]))
            out.append((key, text[at:end]))
            open_at = end
        at = end
    if open_at < at:
        out.append((None, text[open_at:]))
    return out


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                     decode: bool = True) -> DataFrame:
    """One row per input row: doc_id, ids, n_tokens, and decoded (the text of
    the ids) unless ``decode`` is off.

    Ids are the tokenizers library's, with its handling of special strings
    inside texts. Null and empty texts have no ids and decode to the empty
    text. Repeated rows, and rows that share an id, each give a row; a null id
    stays null. Texts of any length are encoded whole; an empty table gives no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    wanted = spark.sparkContext.broadcast(_shared_bitmap(rows))
    schema = f"doc_id {kind}, ids array<int>, n_tokens long" + (", decoded string" if decode else "")

    def made(doc: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        c = codec(tokenizer)
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.empty(0, "<u4"), *ids]).astype(np.int32)
        columns = {"doc_id": doc, "ids": pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat)), "n_tokens": pa.array(size)}
        if decode:
            columns["decoded"] = pa.array([c.text(x) for x in ids], pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def whole(batches):
        """Documents without a marked chunk."""
        c = codec(tokenizer)
        for b in batches:
            texts = _texts(b.column(2))
            for first, past in _slices(texts):
                own = [i for i, ends in enumerate(cut(texts[first:past]), first)
                       if not any(k for k, _ in _pieces(texts[i], ends, wanted.value))]
                yield made(b.column(1).take(pa.array(own, pa.int64())), [c.ids(texts[i]) for i in own])

    def split(batches):
        """Pieces of the other documents."""
        for b in batches:
            texts = _texts(b.column(2))
            for first, past in _slices(texts):
                row, pos, key, body = [], [], [], []
                for i, ends in enumerate(cut(texts[first:past]), first):
                    found = _pieces(texts[i], ends, wanted.value)
                    if any(k for k, _ in found):
                        row.extend([i] * len(found))
                        pos.extend(range(len(found)))
                        key.extend(k for k, _ in found)
                        body.extend(x for _, x in found)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(pos, pa.int32()),
                     pa.array(key, pa.binary()), pa.array(body, pa.binary())],
                    names=["uid", "doc_id", "pos", "chunk", "body"])

    def encode(batches):
        c = codec(tokenizer)
        for b in batches:
            for first, past in _slices(bodies := b.column(1).to_pylist()):
                ids, last = zip(*(c.pack(c.units(x)) for x in bodies[first:past]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, past - first), pa.array(ids, pa.binary()), pa.array(last, pa.binary())],
                    names=["chunk", "ids", "ends"])

    def stitch(batches):
        c = codec(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                ids = [c.stitch([c.units(p["body"]) if p["ids"] is None else c.unpack(p["ids"], p["ends"])
                                 for p in sorted(pieces, key=lambda p: p["pos"])])
                       for pieces in some.column(1).to_pylist()]
                yield made(some.column(0), ids)

    parts = materialize(rows.mapInArrow(split, f"uid long, doc_id {kind}, pos int, chunk binary, body binary"),
                        "chunk-places")
    shared, own = parts.where("chunk is not null"), parts.where("chunk is null")
    once = (shared.groupBy("chunk").agg(F.first("body").alias("body"))
            .mapInArrow(encode, "chunk binary, ids binary, ends binary"))
    none = F.lit(None).cast("binary")
    placed = shared.select("uid", "doc_id", "pos", "chunk").join(once, "chunk").select(
        "uid", "doc_id", "pos", "ids", "ends", none.alias("body"))
    placed = placed.unionByName(own.select("uid", "doc_id", "pos", none.alias("ids"), none.alias("ends"), "body"))
    # as many pieces as one document has
    pieces = placed.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.collect_list(
        F.struct("pos", "ids", "ends", "body")).alias("pieces"))
    return rows.mapInArrow(whole, schema).unionByName(pieces.select("doc_id", "pieces").mapInArrow(stitch, schema))
