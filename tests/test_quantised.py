"""Search over quantised codes: recall of whole query sets, bytes of codes, awkward vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import quantised as Q


def exact(ids, vectors, every, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for row in np.flatnonzero(ids % every == 0):
        d = 1 - unit @ unit[row]
        d[row] = np.inf
        out[int(ids[row])] = [(int(ids[i]), d[i]) for i in np.lexsort((ids, d))[:k]]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_all_queries(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").where("embedding is not null")
    rows = table.toPandas()
    ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    index = Q.build_index(table)
    found = {}
    for r in Q.search(index, table, table.where("vec_id % 20 = 0"), 10, block=700).orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append((r["key"], r["distance"]))
    wanted = exact(ids, vectors, 20, 10)
    assert found.keys() == wanted.keys() and all(len(f) == 10 and q not in dict(f) for q, f in found.items())
    assert np.mean([len(dict(found[q]).keys() & dict(wanted[q]).keys()) / 10 for q in wanted]) >= 0.9
    assert np.allclose([d for f in found.values() for _, d in f], [dict(exact_)[k] if k in dict(exact_) else d for (q, f), exact_ in zip(found.items(), [wanted[q] for q in found]) for k, d in f], atol=1e-6)
    assert len(index.codes.first().codes) * 5 <= 4 * vectors.shape[1]


def test_awkward_vectors(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(60)] + [(3, [4.0, 3.0, 1.0]), (100, None), (101, [0.0] * 3), (102, [1.0, None, 2.0]), (103, [1.0]), (None, [1.0, 1.0, 1.0]), (104, [1e200, 2e200, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("clash"))
    found = Q.search(Q.build_index(df), df, df.where("vec_id in (0, 3, 101, 104)"), 5).collect()
    assert sorted((r["query"], r["rank"]) for r in found) == [(q, k) for q in (0, 3, 104) for k in range(1, 6)]
    none = df.where("false")
    assert Q.search(Q.build_index(none), none, none, 5).collect() == []


def test_a_table_of_products_is_the_product_with_the_centres():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 7))
    books = Q.learned_codebooks(vectors, 2, 16)
    codes = Q.encoded(vectors, books)
    rebuilt = np.concatenate([books[p][codes[:, p]] for p in range(4)], axis=1)[:, :7]
    assert np.allclose(Q.likeness(vectors[:5], codes, books), vectors[:5] @ rebuilt.T, atol=1e-4)


def test_the_registered_query(spark):
    from foliant.plans import catalog

    rows = catalog.queries()["quantised_search"](spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("embedding is not null").toPandas()
    wanted = exact(table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float), 20, 10)
    hits = sum(r.vec_id in dict(wanted[r.query_id]) for r in rows)
    assert {r.query_id for r in rows} == wanted.keys() and hits >= 0.9 * len(rows) and len(rows) == 10 * len(wanted)


def test_groups_of_queries_change_nothing(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))], "vec_id long, embedding array<double>")
    index, asked = Q.build_index(df), df.where("vec_id % 4 = 0")
    found = [sorted(map(tuple, Q.search(index, df, asked, 5, block=100, **more).collect())) for more in ({}, {"asking": 20})]
    assert found[0] == found[1] and len(found[0]) == 750
