"""The manifest against a plain version: sizes around the fan, many levels, null groups, repeated rows."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.llm import merkle as M

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = levels([leaf_of(r) for r in groups[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if r[4] is not None else None
            digest, proof = leaf_of((*r[:4], text)) if tampered else leaf_of(r), []
            for tree, at in ((trees[s], i), (top, g)):
                for level in tree[:-1]:
                    run, slot = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof += run[:slot] + run[slot + 1 :]
                    digest = H(*run[:slot], digest, *run[slot + 1 :])
                    at //= 16
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], H(*proof), digest, digest == top[-1][0]))
    return Counter(out)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit("x")).withColumn("grp", F.lit(1)).withColumn("root", F.lit(1))
    found = M.manifest(df, tampered={"text": M.lower_ascii(F.col("text"))}, where=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    assert Counter(map(tuple, found.collect())) == plain_manifest(rows)


def test_sizes_around_the_fan(spark):
    rows = []
    for k, n in enumerate((1, 2, 15, 16, 17, 33, 257, 600)):
        rows += [(len(rows) + i, f"s{k}", "en", i, f"Text {i} É") for i in range(n)]
    check(spark, rows)


def test_many_groups_and_null_group(spark):
    rows = [(i, f"group{i % 40}é" if i % 41 else None, None if i % 3 else "fr", None if i % 4 else i, None if i % 5 else "ABC") for i in range(300)]
    check(spark, rows)


def test_lone_leaf_is_the_root(spark):
    check(spark, [(1, None, None, None, None)])
    check(spark, [(5, "a", "en", 3, "Abc")])


def test_awkward_documents(spark, rows):
    check(spark, [(r[0], r[3], r[2], r[4], r[1]) for r in rows])


def test_no_rows(nothing):
    assert M.manifest(nothing).collect() == []


def test_missing_children_are_an_error():
    with pytest.raises(ValueError):
        M._hear((("a", 0), [(0, b"x", 3, 3), (2, b"y", 3, 3)]))


def test_height():
    assert [M.height(n) for n in (1, 2, 16, 17, 256, 257)] == [0, 1, 1, 2, 2, 3]
