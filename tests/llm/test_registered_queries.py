"""The registered queries themselves over whole tables: against SQL where there is any, else against plain versions."""

import base64
import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

import plain
from foliant.llm import registry, url_filter as U
from oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def texts(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) == ""


def test_op1_against_brute_force(spark, texts):
    assert Counter(map(tuple, QUERIES["op1_substring_dedup"](spark, SF).collect())) == plain.removed_words(texts)


def test_op4_host_path_and_rule(spark, con):
    found = {r.page_id: r for r in QUERIES["op4_url_filter"](spark, SF).collect()}
    after = "CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url, '://([^/?#]*)([^?#]*)', {}) ELSE '' END"
    for page, host, path in con.execute(f"SELECT page_id, lower({after.format(1)}), {after.format(2)} FROM pages").fetchall():
        fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (found[page].host, found[page].path, found[page].rule) == (host, path, max(fits)[1] if fits else None)
        assert found[page].verdict == (max(fits)[2] if fits else found[page].verdict) in ("allow", "block")


def test_op5_columns(spark, texts):
    rows = QUERIES["op5_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_op6_recall(spark):
    rows = QUERIES["op6_neighbours"](spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").where("embedding is not null").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], dtype=float)
    hits = 0
    for q in ids[ids % 100 == 0]:
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and q not in {r.vec_id for r in mine}
        exact = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        assert np.allclose([r.score for r in mine], [exact[ids == r.vec_id][0] for r in mine], rtol=1e-12)
        exact[ids == q] = np.inf
        hits += len({r.vec_id for r in mine} & set(ids[np.lexsort((ids, exact))[:10]].tolist()))
    assert hits / len(rows) >= 0.9


def test_op7_counts_words(spark, texts):
    found = {r.doc_id: r.n_words for r in QUERIES["op7_token_counts"](spark, SF).collect()}
    assert found == {i: len(plain.words(t)) for i, t in texts}


def test_op9_is_a_round_trip(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts}
    seen = Counter()
    rows = QUERIES["op9_packing"](spark, SF).collect()
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()}
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096



def test_op11_against_the_library(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    expected = Counter()
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        expected[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())] += 1
    assert Counter(map(tuple, QUERIES["op11_byte_bpe"](spark, SF).collect())) == expected
