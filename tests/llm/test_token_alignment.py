"""Token alignment against a plain version that encodes whole texts and compares all token ranges."""

import hashlib
import random
from collections import Counter

import pytest

from framelight.llm import token_alignment
from framelight.llm.token_count import byte_chars

from .test_operators import AWKWARD, docs, tokenizer


def slow(texts, path_a, path_b):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    of = {c: n for n, c in byte_chars().items()}

    def ranges(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    rows, pairs = [], Counter()
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        bytes_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            rows.append(((0, 0, 0), [], ""))
            continue
        ra, rb = ranges(bytes_a), ranges(bytes_b)
        links = [(i, j) for i, (x, y) in enumerate(ra) for j, (u, v) in enumerate(rb) if x < v and u < y]
        ends = sorted({y for _, y in ra} & {v for _, v in rb})
        groups, low = [], 0
        for e in ends:
            side = lambda ids, rs: ",".join(str(i) for i, (x, y) in zip(ids, rs, strict=True) if x >= low and y <= e)  # noqa: E731, B023
            groups.append(f"{side(ids_a, ra)}|{side(ids_b, rb)}")
            low = e
        links = [(ids_a[i], ids_b[j]) for i, j in links]
        pairs.update(links)
        rows.append(((len(ids_a), len(ids_b), len(ends)), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    return [(k, *head, len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links), sha)
            for k, (head, links, sha) in enumerate(rows)]


def texts_of(n):
    rng = random.Random(3)
    some = ["the", "Über", "naïve", "x1", "can't", "<|endoftext|>", "a▁b", "<s>", "<0x41>", "中文字", "😀!", "...", "don't,", "100%", "é", "ﬁ", "ab" * 9]
    gaps = [" ", " ", " ", " ", "\n", "  ", "\n\n", " \n", "\n ", "\t", "\r\n", " ", " ", "\x1c", "   "]
    return ["".join(rng.choice(some[: 4 + k % 14]) + rng.choice(gaps[: 5 + k % 11]) for _ in range(rng.randrange(40))) for k in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.mark.parametrize("stream", [1, 1 << 20])
def test_against_all_ranges(spark, monkeypatch, stream):
    monkeypatch.setattr(token_alignment, "MEMORY", 40)
    monkeypatch.setattr(token_alignment, "PIECE", 200)
    a, b = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    texts = texts_of(120) + AWKWARD
    want = slow(texts, a, b)
    assert sum(r[1] == 0 for r in want) > 3 < sum(r[5] != r[4] for r in want)
    monkeypatch.setattr(token_alignment, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7))
    assert rows(token_alignment.align(docs(spark, texts), a, b, 5, stream)) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_whole_texts_give_the_same(spark, monkeypatch):
    """Models that no cut is safe for: a text is one unit."""
    a, b = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    aligner = token_alignment.Aligner(a, b)
    texts = [t for t in texts_of(60) + AWKWARD if t and len(t) < 4000]
    assert aligner.cuts and aligner.lines
    cut = token_alignment.align_block(texts, aligner, 4)
    for name in ("lines", "cuts"):
        aligner.forget()
        setattr(aligner, name, False)
        other = token_alignment.align_block(texts, aligner, 4)
        assert (cut[0] == other[0]).all() and cut[1] == other[1]
        assert [[x.tolist() for x in token_alignment.unpack(d)[1:]] for _, d in cut[2]] == [[x.tolist() for x in token_alignment.unpack(d)[1:]] for _, d in other[2]]


def test_sums_beyond_doubles():
    import numpy as np

    count = np.array([(1 << 53) + 1, 3], np.int64)
    assert token_alignment._sums(2, np.array([0, 0]), np.array([3, 1]), count).tolist() == [3 * ((1 << 53) + 1) + 3, 0]


def test_nothing_repeats_and_nulls(spark):
    a, b = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    assert rows(token_alignment.align(docs(spark, []), a, b)) == []
    assert [r[1:] for r in rows(token_alignment.align(docs(spark, [None, ""]), a, b))] == [(0, 0, 0, 0, 0, 0, "")] * 2
    same = spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "a")], "doc_id bigint, text string")
    got = token_alignment.align(same, a, b).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.n_best, r.count_sum) for r in got) == [(0, 1, 1, 3), (7, 2, 2, 5), (7, 2, 2, 5)]
