"""Byte-level BPE against the tokenizer library, on awkward texts and rows."""

import base64
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from foliant.llm import byte_pairs as B

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def both_ways(coder, texts):
    raw = [t.encode() for t in texts]
    ids, at = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
    out, edges = coder.decode(ids, at)
    found = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert found == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [out[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])] == raw


@pytest.fixture(scope="module")
def coder():
    return B.BytePairs(RANKS, public_tokenizers.PATTERN)


def test_white_space_of_all_kinds(coder):
    rng = random.Random(5)
    marks = ["\x1c", "\x85", "\xa0", "\u200b", "\u3000", "\u2028", " ", "\n", "\t", "\r\n", "'s", "'", "9", "z", "é", "中文", "<|endoftext|>", "  ", "😀", "ำ"]
    both_ways(coder, ["".join(rng.choices(marks, k=rng.randint(0, 30))) for _ in range(2000)] + ["", " ", "a b"])


def test_long_pieces(coder):
    rng = random.Random(6)
    both_ways(coder, ["x" * 30_000, "".join(rng.choices("ACGT", k=5_000)), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4_000)), " " * 3000 + "a", "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(2000))])


def test_equal_pairs_are_contracted_as_one_by_one(coder):
    rng = random.Random(8)
    both_ways(coder, ["".join(rng.choices("ab", k=40)) + "".join(rng.choices("aaaaaaaaaaab", k=60)) for _ in range(500)])


def test_memory_starts_anew(coder):
    small, rng = B.BytePairs(RANKS, public_tokenizers.PATTERN, memory=50), random.Random(9)
    for _ in range(5):
        both_ways(small, [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(3)])


def test_a_long_document_in_portions(coder):
    text = " ".join("word%d" % i for i in range(5000)) + "\u3000\n x"
    data = np.frombuffer(text.encode(), np.uint8)
    parts = list(coder.parts(data, np.array([0, len(data)]), most=1000))
    assert len(parts) > 20 and b"".join(p.tobytes() for p, _ in parts) == text.encode()
    assert np.concatenate([coder.encode(p, at)[0] for p, at in parts]).tolist() == LIBRARY.encode_ordinary(text)


def test_rows(spark, rows, docs, nothing):
    expected = Counter((r[0], np.array(LIBRARY.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in B.round_trip(docs).collect()) == expected
    assert B.round_trip(nothing).collect() == [] and B.decode(B.encode(nothing)).collect() == []
    assert Counter((r.doc_id, bytes(r.decoded)) for r in B.decode(B.encode(docs)).collect()) == Counter((i, t) for i, _, t in expected.elements())
