"""Token-id files: fixed-size id blocks, transposed into bit or byte planes,
each plane compressed with zstandard, with a chunk index.

The files are Parquet written by Spark, so that any store that Spark writes to
will do. A chunk is a row: part, chunk, first_id (within the part), n_ids, the
compressed planes, and the index of the document pieces in it. Planes of the
high-order bytes or bits of small ids are almost constant and shrink to
nothing. Documents lie in ascending id order over the parts; the ids before a
part are the sum over the parts before it.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplens.llm.common import keyed

#: Ids of a full chunk.
CHUNK = 1 << 16
#: Segments (and pre-tokens) whose ids a Python worker remembers.
KNOWN = 600_000


# -- encoding ---------------------------------------------------------------

class Encoder:
    """Byte-level BPE ids of whole texts by the tokenizers library, with the
    library's handling of special strings inside texts.

    A space between two characters that are not white space always starts a
    pre-token of the library's pattern, so texts are cut there and the ids of
    each segment are remembered. Segments of Latin text go to the library's
    model pre-token by pre-token; any other goes through the whole library.
    """

    #: Not plain Latin text: other scripts, white space on which pattern
    #: engines differ, the start of a special string.
    OTHER = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]|<\|")
    CUT = re.compile(r"(?<=\S) (?=\S)")
    #: Fixed value: the pre-token pattern of the vocabulary's public description.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.findall = regex.compile(self.PATTERN).findall
        # byte -> printable character, the convention of byte-level vocabularies
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in shown]
        self.printable = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def piece(self, p: str) -> bytes:
        """Ids of a pre-token as little-endian unsigned 32-bit integers."""
        ids = self.pieces.get(p)
        if ids is None:
            shown = p.encode().decode("latin-1").translate(self.printable)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
            if len(self.pieces) < KNOWN:
                self.pieces[p] = ids
        return ids

    def segment(self, text: str) -> bytes:
        """Ids of a segment, likewise."""
        if self.OTHER.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        word = text.removeprefix(" ")
        if word.isalpha():  # one pre-token, with its space
            return self.piece(text)
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return self.piece(text[:-1]) + self.piece(word[-1])
        return b"".join([self.piece(p) for p in self.findall(text)])

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        known = self.known
        if rest and (not first or first[-1].isspace()):
            return self._irregular(text)
        try:
            return b"".join([self.segment(first), *[known[p] for p in rest]])
        except KeyError:
            pass
        out = [self.segment(first)]
        for p in rest:
            ids = known.get(p)
            if ids is None:
                if not p or p[0].isspace() or p[-1].isspace():
                    return self._irregular(text)
                ids = self.segment(" " + p)
                if len(known) < KNOWN:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    def _irregular(self, text: str) -> bytes:
        """Texts with runs of white space: cut at single spaces only."""
        first, *rest = self.CUT.split(text)
        return b"".join([self.segment(first), *[self.known.get(p) or self.segment(" " + p) for p in rest]])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder: what it has learned is kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# -- planes -----------------------------------------------------------------

def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first, each
    compressed: 4 byte planes or 32 bit planes."""
    import zstandard
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = np.ascontiguousarray(rows.T)
    elif kind == "bit":
        planes = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        raise ValueError(f"planes are 'byte' or 'bit', not {kind!r}")
    pack = zstandard.ZstdCompressor(level=3)
    return [pack.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The block of ``n`` ids that ``to_planes`` has packed."""
    import zstandard
    unpack = zstandard.ZstdDecompressor()
    rows = np.array([np.frombuffer(unpack.decompress(p), np.uint8) for p in planes])
    if len(planes) == 32:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


# -- files ------------------------------------------------------------------

def _pack(batches, tokenizer: str, end_id: int, kind: str, chunk: int, id_type: pa.DataType):
    """Chunks of one part, from its documents in order."""
    encode, end = encoder(tokenizer), end_id.to_bytes(4, "little")
    schema = pa.schema([
        ("part", pa.int32()), ("chunk", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int32()),
        ("planes", pa.list_(pa.binary())),
        ("pieces", pa.list_(pa.struct([("uid", pa.int64()), ("doc_id", id_type), ("n", pa.int32()),
                                       ("begins", pa.bool_()), ("ends", pa.bool_())])))])
    part, done, held, parts, pieces = TaskContext.get().partitionId(), 0, 0, [], []

    def row():
        nonlocal done, held, parts, pieces
        ids = np.frombuffer(b"".join(parts), "<u4")
        out = {"part": part, "chunk": done // chunk, "first_id": done, "n_ids": len(ids),
               "planes": to_planes(ids, kind), "pieces": pieces}
        done, held, parts, pieces = done + len(ids), 0, [], []
        return pa.RecordBatch.from_pylist([out], schema=schema)

    for b in batches:
        for uid, doc, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            ids = encode(text or "") + end
            at, n = 0, len(ids) // 4
            while at < n:
                take = min(n - at, chunk - held)
                parts.append(ids[4 * at:4 * (at + take)])
                pieces.append({"uid": uid, "doc_id": doc, "n": take, "begins": at == 0, "ends": at + take == n})
                at, held = at + take, held + take
                if held == chunk:
                    yield row()
    if held:
        yield row()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, kind: str = "byte",
                      chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text, each followed by ``end_id``, as chunks of
    ``chunk`` ids to ``path``, a folder that executors share.

    Documents lie in ascending id order (null ids first; rows that share an id
    one after the other). Null and empty texts have the end id alone, and very
    long texts span chunks. An empty table gives no chunks. Other columns are
    not read.
    """
    rows = keyed(docs, id_col, text_col)
    kind_of_id = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(kind_of_id)
    schema = ("part int, chunk long, first_id long, n_ids int, planes array<binary>, pieces array<struct<"
              f"uid:bigint,doc_id:{kind_of_id.simpleString()},n:int,begins:boolean,ends:boolean>>")
    (rows.repartitionByRange("doc_id", "uid").sortWithinPartitions("doc_id", "uid")
     .mapInArrow(lambda batches: _pack(batches, tokenizer, end_id, kind, chunk, id_type), schema)
     .write.option("compression", "uncompressed").parquet(path))


def read_pieces(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(uid, doc_id, part, at, n, crc, ids) of every piece of a document in
    a chunk: ``at`` counts within the part; ``ids`` (little-endian unsigned
    32-bit) are given for pieces of documents that span chunks, or always."""
    files = spark.read.parquet(path)
    doc = files.schema["pieces"].dataType.elementType["doc_id"].dataType

    def unpack(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("uid", "doc_id", "part", "at", "n", "crc", "ids")}
            for r in b.to_pylist():
                raw = memoryview(from_planes(r["planes"], r["n_ids"]).tobytes())
                at = 0
                for p in r["pieces"]:
                    own = raw[4 * at:4 * (at + p["n"])]
                    whole = p["begins"] and p["ends"]
                    values = (p["uid"], p["doc_id"], r["part"], r["first_id"] + at, p["n"], zlib.crc32(own),
                              None if whole and not with_ids else bytes(own))
                    for column, v in zip(out.values(), values, strict=True):
                        column.append(v)
                    at += p["n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["uid"], pa.int64()), pa.array(out["doc_id"], to_arrow_type(doc)),
                 pa.array(out["part"], pa.int32()), pa.array(out["at"], pa.int64()), pa.array(out["n"], pa.int64()),
                 pa.array(out["crc"], pa.int64()), pa.array(out["ids"], pa.binary())], names=list(out))

    from pyspark.sql.pandas.types import to_arrow_type
    return files.select("part", "first_id", "n_ids", "planes", "pieces").mapInArrow(
        unpack, f"uid long, doc_id {doc.simpleString()}, part int, at long, n long, crc long, ids binary")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files, per document: uid, doc_id, start (ids of all documents
    before it), n_tokens (with the end id), ids_crc32."""
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # the pieces of one document: as many as it has chunks
    docs = read_pieces(spark, path).groupBy("uid", "part").agg(
        F.max("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"),
        F.max("crc").alias("crc"), F.array_sort(F.collect_list(F.when(
            F.col("ids").isNotNull(), F.struct("at", F.hex("ids").alias("ids"))))).alias("split"))
    crc = F.when(F.size("split") == 0, F.col("crc")).otherwise(
        F.crc32(F.unhex(F.array_join(F.col("split.ids"), ""))))
    return docs.join(parts, "part").select(
        "uid", "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", crc.alias("ids_crc32"))
