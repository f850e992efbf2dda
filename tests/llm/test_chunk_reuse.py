"""BPE with reused chunks against the tokenizers library."""

import hashlib
import random
from collections import Counter

import pytest
from llm_rows import frame
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from shoplens.llm import chunk_reuse as C

BPE = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def test_joins_at_every_place(library):
    """Pieces cut anywhere between characters give the whole text's ids."""
    rnd = random.Random(3)
    bits = ["a", "b", "'s", "'re", "'", "r", "e", " ", "  ", "\n", "\t", "<|endoftext|>", "<|endof", "text|>", "日本",
            "語", "。", "é", "12", "3", "\x1c", "\x85", " ", "́", "!", "🙂", "x" * 30, " the", "...", "▁"]
    c = C.Codec(BPE)
    for _ in range(4000):
        some = rnd.sample(bits, rnd.randint(1, 8))
        text = "".join(rnd.choice(some) for _ in range(rnd.choice([3, 8, 20, 60]))).encode()
        inner = [i for i in range(1, len(text)) if text[i] & 0xC0 != 0x80]
        at = sorted(rnd.sample(inner, min(len(inner), rnd.randint(0, 6))))
        pieces = [c.units(text[a:z]) for a, z in zip([0, *at], [*at, len(text)])]
        want = library.encode(text.decode(), add_special_tokens=False).ids
        assert c.stitch(pieces).tolist() == want, text
        assert c.ids(text).tolist() == want
        assert c.text(c.ids(text)) == library.decode(want, skip_special_tokens=False) == text.decode()


def test_run_without_pretokens(library):
    """One word over many chunks: nothing can be settled before its end."""
    c = C.Codec(BPE)
    text = ("xyz" * 30000 + " end").encode()
    pieces = [c.units(text[i:i + 700]) for i in range(0, len(text), 700)]
    assert c.stitch(pieces).tolist() == library.encode(text.decode(), add_special_tokens=False).ids


def test_cut_is_content_defined():
    rnd = random.Random(1)
    def words(n):
        return " ".join(str(rnd.randrange(10 ** 6)) for _ in range(n)).encode()
    passage, texts = words(3000), []
    for n in (0, 10, 500):
        texts.append(words(n) + passage + words(n))
    texts += [b"", b"x", "é".encode() * 40000, b"y" * 100000]
    ends = C.cut(texts)
    for text, own in zip(texts, ends):
        assert own == C.cut([text])[0]  # not moved by the texts before it
        assert (own[-1] if own else 0) == len(text) and own == sorted(set(own))
        sizes = [z - a for a, z in zip([0, *own], own)]
        assert all(n <= C.MOST for n in sizes) and all(n >= C.LEAST for n in sizes[:-1])
        for a, z in zip([0, *own], own):
            text[a:z].decode()
    chunks = [{t[a:z] for a, z in zip([0, *e], e)} for t, e in zip(texts[:3], ends)]
    assert len(chunks[0] & chunks[1] & chunks[2]) > 10


def check(rows, out, library):
    got = Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.decoded) for r in out.collect())
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, tuple(ids), len(ids), t or "")] += 1
    assert got == want


@pytest.mark.parametrize("bits", [C.MOST_BITS, 64])
def test_documents(spark, docs, rows, library, monkeypatch, bits):
    """With 64 bits the bitmap marks nearly every chunk."""
    monkeypatch.setattr(C, "MOST_BITS", bits)
    check(rows, C.encode_documents(docs, BPE), library)


def test_shared_passages(spark, library):
    """Passages of many chunks in many documents, at different places, cut
    special strings, long runs; copies by the hundred."""
    rnd = random.Random(8)
    def words(n):
        return " ".join(rnd.choice(["alpha", "it's", "don't", "x1", "<|endoftext|>", "日本語。", "w%d" % rnd.randrange(9999)])
                        for _ in range(n))
    shared = [words(900), "漢字" * 3000, "z" * 5000, words(400) + "  \n"]
    data = [(i, words(rnd.randrange(60)) + rnd.choice(["", " ", "'"]) + rnd.choice(shared) + rnd.choice(["", "s", " "])
             + rnd.choice(shared) + words(rnd.randrange(60))) for i in range(60)]
    data += [(1000 + i, shared[0]) for i in range(300)] + [(None, shared[1]), (None, None)]
    check(data, C.encode_documents(frame(spark, data).repartition(5), BPE), library)


def test_empty(spark, empty):
    out = C.encode_documents(empty, BPE)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded"] and out.count() == 0
    assert C.encode_documents(empty, BPE, decode=False).columns == ["doc_id", "ids", "n_tokens"]


def test_registered(spark, library):
    import __spark_entry__ as E
    from paths import SF01
    got = {r.doc_id: tuple(r)[1:] for r in E.queries()["op13_bpe_reuse"](spark, SF01).collect()}
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert got[d.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                 hashlib.sha256((d.text or "").encode()).hexdigest())
