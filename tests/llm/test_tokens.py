"""Unigram encoding, token counts and token files against the libraries."""

import random
import uuid
import zlib

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from shoplens.llm.token_count import token_counts
from shoplens.llm.token_output import (Encoder, from_planes, read_documents, read_pieces, to_planes,
                                       write_token_files)
from shoplens.llm.unigram import Unigram, encode_documents, load

PIECE, BYTE = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")


def order(row):
    return tuple((v is None, v) for v in row)


# -- counts -----------------------------------------------------------------

@pytest.mark.parametrize("head", [1 << 19, 20, 0])
def test_token_counts(docs, rows, head):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = sorted(((d, len((t or "").encode()), len(model.encode(t or ""))) for d, t in rows), key=order)
    got = token_counts(docs, PIECE, head=head).select("doc_id", "n_bytes", "n_tokens").collect()
    assert sorted((tuple(r) for r in got), key=order) == want


def test_token_counts_empty(empty):
    assert token_counts(empty, PIECE).count() == 0


# -- files ------------------------------------------------------------------

def test_planes_round_trip():
    rnd = np.random.default_rng(0)
    for kind, count in (("byte", 4), ("bit", 32)):
        for n in (1, 7, 8, 1000):
            ids = rnd.integers(0, 2 ** 32, n, dtype=np.uint32)
            planes = to_planes(ids, kind)
            assert len(planes) == count and (from_planes(planes, n) == ids).all()


def test_encoder_is_the_library(rows):
    library, own = Tokenizer.from_file(BYTE), Encoder(BYTE)
    rnd = random.Random(2)
    alphabet = [" ", " ", " ", "\n", "\t", "a", "the", "'s", "'ll", "9", "½", ".", "!?", "é", "ß", "日本", " ", " ",
                "\x1c", "\x85", "<|endoftext|>", "<|", "🙂", "́", "ǅ", "ª"]
    texts = [t or "" for _, t in rows]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(4000)]
    for t in texts:
        want = np.array(library.encode(t, add_special_tokens=False).ids, "<u4")
        assert own(t) == want.tobytes(), repr(t)


@pytest.mark.parametrize("kind,chunk", [("byte", 1 << 16), ("bit", 100)])
def test_token_files(spark, docs, rows, tmp_path, kind, chunk):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    write_token_files(docs, path, BYTE, kind=kind, chunk=chunk)
    library = Tokenizer.from_file(BYTE)
    want = [(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for d, t in rows]
    got = sorted(read_documents(spark, path).collect(), key=lambda r: r.start)
    starts = np.cumsum([0, *[r.n_tokens for r in got]])
    assert [r.start for r in got] == starts[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))  # ascending, null ids first
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=order) == sorted(
        ((d, len(x), zlib.crc32(x.tobytes())) for d, x in want), key=order)
    assert read_pieces(spark, path, with_ids=True).where("ids is null").count() == 0


def test_token_files_empty(spark, empty, tmp_path):
    write_token_files(empty, f"{tmp_path}/none", BYTE)
    assert read_documents(spark, f"{tmp_path}/none").count() == 0


# -- unigram ----------------------------------------------------------------

def brute_best(model, text):
    """Largest score over all segmentations, by plain dynamic programming."""
    marked = "▁" + text.replace(" ", "▁")
    score = {p: model.scores[i] for i, p in enumerate(model.pieces)
             if i not in model.special and i not in model.bytes_of.values()}
    best = [0.0] + [float("-inf")] * len(marked)
    for j in range(1, len(marked) + 1):
        for i in range(max(0, j - 50), j):
            s = score.get(marked[i:j], model.worst if j == i + 1 else float("-inf"))
            best[j] = max(best[j], best[i] + s)
    return best[-1]


def score_of(model, ids):
    total, run = 0.0, bytearray()
    for i in [*ids, None]:
        c = model._byte_of_id.get(i)
        if c is not None:
            run.append(c)
            continue
        total += model.worst * len(run.decode())
        run = bytearray()
        if i is not None:
            total += model.scores[i]
    return total


def test_unigram_is_optimal_and_decodes(rows):
    model = load(PIECE)
    rnd = random.Random(4)
    texts = [t[:400] for _, t in rows if t]
    texts += ["".join(rnd.choice("aeth  \nü日🙂.") for _ in range(rnd.randrange(1, 40))) for _ in range(300)]
    for t in texts:
        ids = model.encode(t)
        assert score_of(model, ids) == pytest.approx(brute_best(model, t))
        assert model.decode(ids) == t.replace("▁", " ")
    assert model.encode("") == [] and model.encode(None) == [] and model.decode([]) == ""


def test_unigram_together_and_alone(rows):
    """The steps over many texts at once, and those over one."""
    model, rnd = load(PIECE), random.Random(9)
    texts = [t for _, t in rows if t] + ["".join(rnd.choice(["a", "the", " ", "  ", "▁", "日", "é", "🙂", "<0x41>", "tion"])
                                               for _ in range(rnd.randrange(30))) for _ in range(500)]
    marked = [("▁" + t.replace(" ", "▁")).encode() for t in texts if len(t) < 2000]
    ids, n = model.viterbi(marked)
    ends = n.cumsum().tolist()
    assert [ids[a:z].tolist() for a, z in zip([0, *ends], ends)] == [model.viterbi_of(m) for m in marked]
    long = "漢字かな" * 20000
    assert [x.tolist() for x in model.encode_many([long, "b c", long])] == [model.encode(long), model.encode("b c"), model.encode(long)]
    assert model.decode(model.encode(long)) == long and all(len(k) <= 64 for k in model._known)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, kind, payload):
    return varint(number << 3 | kind) + (varint(len(payload)) + payload if kind == 2 else payload)


def test_unigram_agrees_with_the_library(tmp_path):
    """A model file of a few pieces with scores of our own, read by the
    library as a unigram model."""
    import struct
    rnd = random.Random(6)
    pieces = ["<unk>", "<s>", "</s>"] + [f"<0x{i:02X}>" for i in range(256)]
    kinds = [2, 3, 3] + [6] * 256
    plain = {"▁", *"abcdé"} | {"".join(rnd.choice("▁abc") if k == 0 else rnd.choice("abcdé") for k in range(n))
                               for n in (2, 3, 4) for _ in range(40)}
    pieces += sorted(plain)
    kinds += [1] * len(plain)
    scores = [0.0] * 259 + [-rnd.uniform(1, 9) for _ in plain]
    scores = [struct.unpack("<f", struct.pack("<f", s))[0] for s in scores]
    body = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, varint(k)))
                    for p, s, k in zip(pieces, scores, kinds))
    trainer = field(3, 0, varint(1)) + field(35, 0, varint(1))
    normalizer = field(1, 2, b"identity") + field(3, 0, varint(1)) + field(4, 0, varint(0)) + field(5, 0, varint(1))
    file = tmp_path / "own.model"
    file.write_bytes(body + field(2, 2, trainer) + field(3, 2, normalizer))
    library = sentencepiece.SentencePieceProcessor(model_file=str(file))
    own = load(str(file))
    assert own.scores[259:] == pytest.approx(scores[259:])
    for _ in range(2000):
        t = "".join(rnd.choice("aabbccdé  xz日") for _ in range(rnd.randrange(1, 25)))
        assert own.encode(t) == library.encode(t), t
        assert own.decode(own.encode(t)) == library.decode(library.encode(t)) == t


def test_encode_documents(docs, rows, empty):
    model = load(PIECE)
    got = encode_documents(docs, model).collect()
    assert sorted(((r.doc_id, tuple(r.ids), r.n_tokens, r.decoded) for r in got), key=order) == sorted(
        ((d, tuple(model.encode(t)), len(model.encode(t)), (t or "").replace("▁", " ")) for d, t in rows), key=order)
    assert encode_documents(empty, model).count() == 0


def test_unigram_without_byte_pieces():
    model = Unigram(["<unk>", "▁a", "b", "▁"], [0.0, -1.0, -2.0, -3.0], frozenset([0]))
    assert model.encode("abz") == [1, 2, 0]
