"""Text operators against brute force over awkward documents."""

import zlib
from collections import Counter, defaultdict

import ahocorasick  # noqa: F401
import numpy as np
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import jaccard_join as J, packing as P, substring_dedup as S, textops, token_counts as T


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("settings", [{}, {"group_bytes": 20_000, "range_bytes": 3000, "shard_bytes": 5000, "stream_bytes": 2000, "automaton_windows": 100}])
def test_repeats(docs, rows, settings):
    cut = S.remove_repeats(docs, **settings)
    assert cut.columns[: len(docs.columns)] == docs.columns
    found = Counter(map(tuple, cut.select("doc_id", "repeat_n_words", "repeat_n_removed", F.sha2("repeat_kept_text", 256)).collect()))
    assert found == plain.removed_words(pairs(rows))
    assert cut.where(F.aggregate("repeat_spans", F.lit(0), lambda s, x: s + x["words"]) != F.col("repeat_n_removed")).count() == 0


@pytest.mark.parametrize("blocks", [(512, 1_000_000), (3, 1000)])
def test_classes(docs, rows, blocks):
    found = J.similarity_classes(docs, block_docs=blocks[0], block_shingles=blocks[1])
    assert Counter(map(tuple, found.select("doc_id", "class_id", "n_links").collect())) == plain.similarity_classes(pairs(rows))


def test_one_per_class(docs, rows):
    kept = J.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    heads = {i for i, c, _ in plain.similarity_classes(pairs(rows)) if i == c and i is not None}
    assert sorted(r[0] for r in kept.where("doc_id is not null").select("doc_id").collect()) == sorted(heads)
    assert kept.where("doc_id is null").count() == 2


def test_unlike_texts_that_share_an_id(spark):
    first, second, third = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = first + " more"
    rows = [(7, first), (7, second), (7, second), (9, near), (10, second + " more"), (7, ""), (7, None), (8, third), (8, third + " more"), (8, third.replace(" ", "  "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = J.similarity_classes(docs)
    assert Counter(map(tuple, found.select("doc_id", "class_id", "n_links").collect())) == Counter([(7, 7, 1), (7, 7, 2), (7, 7, 2), (9, 7, 1), (10, 7, 2), (7, 7, 0), (7, 7, 0), (8, 8, 2), (8, 8, 2), (8, 8, 2)])
    kept = sorted(map(tuple, J.keep_one_per_class(docs).collect()), key=str)
    assert [r for r in kept if r[0] == 7] == sorted([(7, first), (7, second), (7, ""), (7, None)], key=str)
    assert len(kept) == 5 and kept[-1][0] == 8  # near copies of one id are one class


def test_posterior_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    for n, least in J.least_matches():
        assert (rng.binomial(n, 0.8, 20_000) >= least).all()
    assert least > 0.55 * n  # and in the end drops unlike pairs


def test_each_pair_of_a_bucket_counts_once():
    groups, blocks = np.array([0, 0, 0, 1, 2, 2, 2]), np.array([0, 0, 0, 0, 0, 1, 1])
    i, j = J.pairs_within(groups, blocks, np.array([False] * 4 + [True] * 3))
    assert list(zip(i.tolist(), j.tolist())) == [(0, 1), (0, 2), (1, 2), (4, 5), (4, 6)]
    same = np.zeros((2, 4 * J.BANDS + J.BANDS * J.ROWS), np.uint8)
    for band in range(3):  # equal texts share all bands and count in the first
        assert len(J.screened(same, np.full(2, band), np.array([0]), np.array([1]), 0.8, 1e-9)[0]) == (band == 0)


def test_chains_of_unlike_texts_are_compared_once_a_bucket(spark, monkeypatch):
    """Each text is like the next one at 0.6: many shared buckets, no link."""
    rows = [(i, " ".join(f"w{k}" for k in range(i * 50, i * 50 + 204))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compared = spark.sparkContext.accumulator(0)
    before = J.verified

    def counting(sets, i, j, threshold):
        compared.add(len(i))
        return before(sets, i, j, threshold)

    monkeypatch.setattr(J, "verified", counting)
    found = J.similarity_classes(docs).collect()
    assert all(r.doc_id == r.class_id and not r.n_links for r in found) and len(found) == 400
    assert compared.value <= 400


def test_packing_is_an_exact_round_trip(docs, rows):
    pieces = P.pack(docs, partition_ids=20_000, row_ids=7000).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = Counter((i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in pairs(rows))
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length
    padding = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padding += 4096 - at if at & (at - 1) else 0
    assert padding == 0
    found = Counter()
    by_doc = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        by_doc[p.doc_id].append(p)
    for doc, parts in by_doc.items():  # rows that share an id are told apart by their lengths and starts
        open_rows = []
        for p in sorted(parts, key=lambda p: (p.doc_tokens, p.start)):
            row = next((r for r in open_rows if r[0] == p.doc_tokens and len(r[1]) == 4 * p.start), None)
            if row is None:
                assert p.start == 0
                open_rows.append(row := [p.doc_tokens, b""])
            row[1] += bytes(p.ids)
        found.update((doc, r[1]) for r in open_rows)
    assert found == wanted


def test_hilbert_curve_visits_neighbours():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    keys = P.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_word_tokenizer_matches_the_whole_tokenizer():
    tokenizer = P.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for word in ("don't", "ÉTÉ!!", "a1b22", "ﬁn", "éte", "x y", "<|endoftext|>", "It's'll", "ŉİı", "日本", "___"):
        assert np.frombuffer(tokenizer.word(word.encode()), "<u2").tolist() == tokenizer.whole.encode(word, add_special_tokens=False).ids


def test_other_tokenizers_read_whole_texts(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert P.splitting_rule(path) is None and P.splitting_rule(public_tokenizers.path("word_bpe_49k.json")) is not None
    tokenizer = Tokenizer.from_file(path)
    found = Counter((r.doc_id, r.doc_tokens, r.start, r.length) for r in P.pack(docs.where("n_chars < 3000"), path, length=1 << 20).collect() if r.start == 0)
    wanted = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in pairs(rows) if len(t or "") < 3000)
    assert Counter((i, n) for i, n, _, _ in found.elements()) == wanted


def test_ranges_hold_about_as_many_ids():
    sizes = np.array([3, 3, 3, 25, 1, 1, 9, 9, 10, 0])
    first, own = P.ranges(np.arange(10), sizes, 10)
    assert own.tolist() == [1, 1, 1, 3, 1, 1, 1, 1, 1, 1] and first.tolist() == [0, 0, 0, 1, 4, 4, 5, 6, 7, 7]


def greedy(text, pieces):
    longest, at, n = max(map(len, pieces)), 0, 0
    while at < len(text):
        size = next((k for k in range(min(longest, len(text) - at), 0, -1) if text[at : at + k] in pieces), 0)
        n += 1 if size else len(text[at].encode())
        at += size or 1
    return n


def test_token_counts(docs, rows):
    pieces = {p for p in T.vocabulary(public_tokenizers.path("piece_bpe_32k.model")) if T.MARK not in p[1:]}
    known = {}
    wanted = Counter((i, len(plain.words(t)), sum(known.setdefault(w, greedy(T.MARK + w, pieces)) if w not in known else known[w] for w in plain.words(t))) for i, t in pairs(rows))
    assert Counter(map(tuple, T.count_tokens(docs).collect())) == wanted


def test_longest_match_with_backtracking():
    pieces = {"▁ab", "abcd", "c", "de", "ab", "abcde", "cdx"}
    automaton = T.LongestMatch(pieces)
    for word in ("abcdx", "abcdeabcd", "zzab", "", "cdxcd", "▁abcdxq"):
        assert automaton.count(word) == greedy(word, pieces)


def test_word_hashes_over_segments(monkeypatch):
    text = ("ab  cé\tlong" + "y" * 50 + " z ").encode() * 20
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, 7, 7, len(text)])
    starts, ends, at = textops.word_bounds(data, offsets)
    cut = [text[:7].split(), [], text[7:].split()]
    assert [text[s:e] for s, e in zip(starts, ends)] == [w for c in cut for w in c] and np.diff(at).tolist() == [len(c) for c in cut]
    whole = textops.word_hashes(data, starts, ends)
    monkeypatch.setattr(textops, "SEGMENT", 64)
    assert (textops.word_hashes(data, starts, ends) == whole).all()
    assert len(set(whole.tolist())) == len({text[s:e] for s, e in zip(starts, ends)})


def test_empty_tables(nothing):
    assert S.remove_repeats(nothing).count() == 0
    assert J.similarity_classes(nothing).count() == 0
    assert P.pack(nothing).count() == 0
    assert T.count_tokens(nothing).count() == 0


def test_checksums_come_from_the_ids(docs):
    row = P.pack(docs.where("doc_id = 2")).select("ids", F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(np.array([2], "<u4").tobytes())
