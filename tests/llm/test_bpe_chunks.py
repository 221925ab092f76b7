"""Chunked encoding against the library on whole texts: shared passages, copies, awkward characters, tiny filters, long texts."""

import hashlib
import random

import numpy as np
import pytest

from framelight.llm import bpe_chunks

from .test_operators import AWKWARD, docs, tokenizer


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def texts_of(n, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9)))
    prose = lambda k: "".join(word() + rng.choice([" ", " ", " ", "\n", "  ", ", ", "\t", " \n", " ", "'s ", "é", "中"]) for _ in range(k))
    passages = [prose(300) for _ in range(4)] + ["x" * 3000, "ab<|endoftext|>" * 200, "\n" * 900, " " * 1500, "é中" * 700]
    return [prose(rng.randrange(60)) + rng.choice(passages) + prose(rng.randrange(60)) + rng.choice([*passages, ""]) for _ in range(n)]


def want(texts, path):
    t = library(path)
    out = []
    for k, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((k, ids, t.decode(ids, skip_special_tokens=False)))
    return out


def got(df):
    return sorted((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in df.select("doc_id", "ids", "decoded").collect())


@pytest.mark.parametrize("filter_bits", [64, 1 << 27])
def test_against_the_library(spark, monkeypatch, filter_bits):
    monkeypatch.setattr(bpe_chunks, "FILTER_BITS", filter_bits)
    monkeypatch.setattr(bpe_chunks, "PIECE", 500)
    path = tokenizer("byte_bpe_50k.json")
    texts = texts_of(60) + texts_of(5) + AWKWARD + [" ".join(map(str, range(9000)))]
    assert got(bpe_chunks.encode(docs(spark, texts).repartition(5), path)) == want(texts, path)


def test_parts_of_a_text_with_and_without_sure_places():
    code = bpe_chunks.Encoder(tokenizer("byte_bpe_50k.json"))
    rng = random.Random(1)
    for text in texts_of(40, 9) + ["a b", "ab", " ", "\n\na", "can't don't\n"]:
        places = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(6)))
        runs = [text[a:b] for a, b in zip([0, *places], [*places, len(text)], strict=True)]
        shared, plan = {}, []
        for k, run in enumerate(runs):
            if k % 2:
                plan.append((bytes([k] * 16), b"", None, b""))
                shared[plan[-1][0]] = bpe_chunks.parts_of([(run, False, False)], code)[0]
            else:
                plan.append(bpe_chunks.parts_of([(run, k == 0, k == len(runs) - 1)], code)[0])
        plan = bpe_chunks.unpack(bpe_chunks.pack(plan))
        ids = bpe_chunks.joined([bpe_chunks.planned(plan, shared)], code)[0]
        assert ids.tolist() == code.tokenizer.encode(text, add_special_tokens=False).ids
        assert code.decode(ids) == text


def test_chunks_are_the_same_wherever_a_passage_stands():
    rng = random.Random(2)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(20_000))
    found = [set(d) for _, _, d in bpe_chunks.chunked([passage, b"q" * 777 + passage, "é".encode() * 50 + passage + b"zz"])]
    assert len(found[0]) > 20 and len(found[0] & found[1] & found[2]) > 0.8 * len(found[0])


def test_chunks_make_up_their_texts(monkeypatch):
    monkeypatch.setattr(bpe_chunks, "BLOCK", 1000)
    texts = [t.encode() for t in texts_of(30) + ["", "a", "é" * 9000]]
    for text, at, digests in bpe_chunks.chunked(texts):
        assert at[0] == 0 and at[-1] == len(text) and at == sorted(at)
        parts = [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        assert digests == [hashlib.blake2b(p, digest_size=16).digest() for p in parts]
        assert all(len(p) <= bpe_chunks.MOST + 3 for p in parts) and [p.decode() for p in parts] is not None


def test_ids_that_decode_to_no_text():
    code = bpe_chunks.Encoder(tokenizer("byte_bpe_50k.json"))
    ids = code.tokenizer.encode("中é", add_special_tokens=False).ids
    assert code.decode(np.array(ids[:1], np.uint32)) == code.tokenizer.decode(ids[:1], skip_special_tokens=False)


def test_another_kind_of_vocabulary(spark):
    path = tokenizer("word_bpe_49k.json")
    texts = ["The cat  sat", "", None, "The cat  sat", "dogs!"]
    assert got(bpe_chunks.encode(docs(spark, texts), path)) == want(texts, path)


def test_nothing_repeats_and_nulls(spark):
    path = tokenizer("byte_bpe_50k.json")
    assert got(bpe_chunks.encode(docs(spark, []), path)) == []
    same = spark.createDataFrame([(7, "a b"), (7, "a b"), (None, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.decoded) for r in bpe_chunks.encode(same, path).collect()) == [(0, ""), (7, "a b"), (7, "a b")]
