"""Operators with trained parts: held-out accuracy, recall, rules and awkward input."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import neighbours as N, toxicity as T, url_filter as U

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_on_held_out_documents(labelled):
    docs, labels = labelled
    scored = T.score_documents(docs, labels, keep=["doc_id", "lang"]).join(labels.where("toxic is not null"), "doc_id").toPandas()
    held = scored[[zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]]
    toxic, clean = held[held.toxic == 1].toxicity_score.to_numpy(), held[held.toxic == 0].toxicity_score.to_numpy()
    assert (toxic[:, None] > clean[None, :]).mean() > 0.95
    assert (clean >= 0.5).mean() < 0.02 and (toxic >= 0.5).mean() > 0.8


def test_toxicity_of_awkward_documents(docs, rows, labelled):
    scored = T.score_documents(docs.withColumn("toxicity_score", F.lit(9)), labelled[1])
    assert scored.count() == len(rows) and scored.where("toxicity_score is null or toxicity_score > 1 or toxicity_flag is null").count() == 0
    again = T.score_documents(docs, labelled[1])
    assert sorted(map(str, again.select("doc_id", "toxicity_score").collect())) == sorted(map(str, scored.select("doc_id", "toxicity_score").collect()))
    assert T.reject_toxic(docs, labelled[1]).columns == docs.columns


def test_toxicity_of_repeated_and_clashing_rows(labelled):
    docs, labels = labelled
    other = docs.limit(30).withColumn("text", F.concat("text", F.lit(" zzz")))
    both = docs.unionByName(docs).unionByName(other)
    (first, cuts), (second, others) = T.fit(docs.unionByName(other), labels, most_toxic=40, most_clean=60), T.fit(both.repartition(7), labels, most_toxic=40, most_clean=60)
    assert cuts == others and (first.embedding == second.embedding).all() and first.offset == second.offset


def test_toxicity_learns_from_every_labelled_document(spark):
    """However many they are and however long, each as a word of its own."""
    ids = [i for i in range(7000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"word{i} " + ("filler " * 6000 if i % 500 == 1 else "text"), "en", int(i % 2 == 0)) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    net, _ = T.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    trained = [i for i in ids if zlib.crc32(f"{i}#aside".encode()) % 5]
    assert len(trained) > 4000 and all(net.embedding[T.word_features(f"word{i}")[0]].any() for i in trained)


def test_toxicity_without_labels(docs, labelled, nothing):
    assert T.score_documents(docs, labelled[1].where("false")).agg(F.max("toxicity_score")).first()[0] == 0
    assert T.score_documents(nothing, labelled[1]).count() == 0


def test_pooling_is_that_of_plain_convolution():
    rng = np.random.default_rng(0)
    net = T.Network(rng.normal(size=(T.BUCKETS, 4)), [rng.normal(size=(s, 4, 3)) for s in (1, 2, 3)], [rng.normal(size=3) for _ in range(3)], rng.normal(size=9), 0.1)
    texts = ["One two three four two", "", "solo", "a b"]
    for text, row in zip(texts, T.pool_texts(net, texts)):
        x = np.array([net.embedding[list(T.word_features(w))].mean(axis=0) for w in text.split()]).reshape(-1, 4)
        wanted = []
        for f, b in zip(net.filters, net.biases):
            padded = np.vstack((x, np.zeros((len(f), 4))))
            values = [sum(padded[i + s] @ f[s] for s in range(len(f))) + b for i in range(len(x))]
            wanted += np.maximum(np.max(values, axis=0), 0).tolist() if values else [0] * 3
        assert np.allclose(row, wanted)


URLS = [None, "", "no scheme", "HTTP://A.Example.ORG/en/15?x", "https://example.org/es/1", "https://example.org/en/2", "http://notexample.org/es/", "https://x.com/fr/1#f", "https://x.com/de/", "https://x.com", "https://x.org", "ftp://é.net/p?q", "https://a.com/fr"]


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS)], "page_id long, url string").withColumn("score", F.lit("clash"))
    rows = {r.page_id: r for r in U.judge_urls(pages).collect()}
    for i, url in enumerate(URLS + URLS):
        host, path, rule, verdict = plain_rule(url)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule) and rows[i].verdict == (verdict or rows[i].verdict) in ("allow", "block")
    assert U.judge_urls(pages.where("false")).count() == 0
    assert {r.verdict for r in U.judge_urls(pages.where("page_id < 3")).collect()} == {"allow"}


def plain_probability(urls, context, symbol):
    """Interpolated over contexts of nought to five bytes, each smoothed with the shorter one."""
    p, texts = 1 / 256, [u + b"\xff" for u in urls]
    for n in range(min(U.ORDER, len(context)) + 1):
        known = context[len(context) - n :]
        total = sum(t[i : i + n] == known for t in texts for i in range(len(t) - n)) if n else sum(map(len, texts))
        seen = sum(t[i : i + n + 1] == known + symbol for t in texts for i in range(len(t) - n))
        p = (seen + U.PULL * p) / (total + U.PULL)
    return p


def test_url_models_are_those_of_plain_counts():
    good, bad = [b"http://ab.org/en/1", b"ab", b""], [b"https://abab.com/de/\xc3\xa9", b"ba"]
    counts, totals = U.counts_of(pa.array([u.decode() for u in good + bad]), np.array([True] * 3 + [False] * 2))
    models = U.UrlModels(counts, totals)
    for url in (b"http://ab.org/de/", b"", b"\xc3\xa9", b"abab"):
        (_, _, data, begins), text = next(iter(U.symbols(pa.array([url.decode()])))), url + b"\xff"
        found = np.exp(models.log_probabilities(data, begins))
        wanted = [[plain_probability(urls, text[max(0, i - 5) : i], text[i : i + 1]) for i in range(len(text))] for urls in (good, bad)]
        assert np.allclose(found, wanted)


def test_url_models_tell_kinds_apart(spark):
    rows = [(i, f"https://site{i}.org/en/{i * 7}") for i in range(300)] + [(1000 + i, f"https://cheap-pills{i}.com/de/{i * 3}") for i in range(300)]
    others = [(i, f"https://site{i}.net/en/{i}") for i in range(5000, 5050)] + [(i, f"https://cheap-pills{i}.net/de/{i}") for i in range(6000, 6050)]
    found = U.judge_urls(spark.createDataFrame(rows + others, "page_id long, url string")).where("rule is null").collect()
    assert sum((r.verdict == "allow") == (r.page_id < 6000) for r in found) >= 95 and len(found) == 100


def test_url_runs_never_share_a_count(spark):
    rng = np.random.default_rng(11)
    urls = [f"https://{rng.bytes(24).hex()}.org/{rng.bytes(24).hex()}" for _ in range(15000)]
    rows = spark.createDataFrame([(u, i % 2 == 0, i % 3 > 0, i % 5 == 0) for i, u in enumerate(urls)], "url string, good boolean, ruled boolean, aside boolean")
    counts, texts = U.count_runs(rows), [u.encode() + b"\xff" for u in urls]
    found = {r.run: (r.good, r.bad, r.n, r.used_good, r.used_bad) for r in counts.collect()}
    assert len(found) == len({t[i : i + n] for t in texts for n in range(1, 7) for i in range(len(t) - n + 1)}) > 1 << 20
    for run in (texts[0][8:14], texts[1][-3:], b"https:", b".org/", b"a"):
        seen = [sum(t[i : i + len(run)] == run for i in range(len(t))) for t in texts]
        wanted = [sum(c for i, c in enumerate(seen) if i % 3 > 0 and i % 2 == k) for k in (0, 1)]
        used = [sum(c for i, c in enumerate(seen) if i % 3 > 0 and i % 2 == k and i % 5 > 0) for k in (0, 1)]
        assert found[len(run) << 48 | int.from_bytes(run)] == (*wanted, sum(seen), *used)


@pytest.mark.parametrize("bound", [0, 1, 200])
def test_url_verdicts_do_not_depend_on_the_bound(spark, bound):
    rows = [(i, f"https://site{i}.org/en/{i * 7}") for i in range(60)] + [(100 + i, f"https://pills{i}.com/de/{i * 3}") for i in range(60)]
    rows += [(i % 210, f"http://other{i % 7}.net/{i * 11}") for i in range(200, 240)] + [(300, None), (301, ""), (302, "é"), (302, "é"), (0, "https://site0.org/en/0")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    key = ["page_id", "host", "path", "score"]
    whole, joined = U.judge_urls(pages).orderBy(*key).collect(), U.judge_urls(pages, bound=bound).orderBy(*key).collect()
    assert [r[:5] for r in whole] == [r[:5] for r in joined] and len(joined) == len(rows)
    assert np.allclose([r.score for r in whole], [r.score for r in joined], atol=1e-8)


@pytest.mark.parametrize("bound", [200, U.BOUND])
def test_url_scores_count_every_ruled_url(spark, bound):
    rows = [(i, f"https://site{i}.org/en/{i * 7}") for i in range(40)] + [(100 + i, f"https://pills{i}.com/de/{i * 3}") for i in range(40)] + [(200, "http://other.net/1")]
    good, bad = ([u for _, u in rows if f".{k}/" in u and plain_rule(u)[3] == v] for k, v in (("org", "allow"), ("com", "block")))
    assert any(zlib.crc32(u.encode()) % 5 == 0 for u in good + bad)
    counts, totals = U.counts_of(pa.array(good + bad), np.array([True] * len(good) + [False] * len(bad)))
    _, _, data, begins = next(iter(U.symbols(pa.array([u for _, u in rows]))))
    wanted = U.UrlModels(counts, totals).scores(data, begins)
    found = {r.page_id: r.score for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), bound=bound).collect()}
    assert np.allclose([found[i] for i, _ in rows], wanted, atol=1e-8)


def brute(ids, vectors, every, k):
    out = {}
    for q in sorted({i for i in ids if i % every == 0}):
        d = np.sqrt(((vectors - vectors[ids.index(q)]) ** 2).sum(axis=1))
        out[q] = [(i, x) for x, i in sorted((x, i) for x, i in zip(d, ids) if i != q)[:k]]
    return out


def test_neighbours_of_small_and_awkward_tables(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(60)] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(60, 80)]
    good.append(good[70])
    bad = [(100, None), (101, [0.0] * 4), (102, [1.0, None, 1.0, 1.0]), (103, [float("nan")] * 4), (104, [float("inf"), 1.0, 1.0, 1.0]), (105, [1.0]), (None, [1.0] * 4), (200, [])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumn("part", F.lit("clash"))
    found = {}
    for r in N.nearest(df, every=10, block=16, parts=1).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, vectors = [i for i, _ in good], np.array([v for _, v in good])
    wanted = brute(ids, vectors, 10, 10)
    assert found.keys() == wanted.keys()
    for q, rows in wanted.items():
        assert [i for i, _ in found[q]] == [i for i, _ in rows] and np.allclose([s for _, s in found[q]], [s for _, s in rows], atol=0, rtol=1e-15)
    assert N.nearest(df.where("vec_id > 99")).count() == 0 and N.nearest(df.where("false")).count() == 0
    assert N.nearest(df.where("vec_id in (0, 7)")).count() == 1


@pytest.mark.parametrize("rows, every", [(400, 10), (5000, 50)])
def test_learned_partitions_recall(spark, rows, every):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 2
    vectors = (centres[rng.integers(0, 40, rows)] + rng.normal(size=(rows, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = N.nearest(df, every=every)
    got = {(r.query_id, r.vec_id) for r in found.collect()}
    wanted = brute(list(range(rows)), vectors.astype(float), every, 10)
    assert len({(q, i) for q, near in wanted.items() for i, _ in near} & got) / len(got) >= 0.9
    router = N.fit_router(vectors.astype(float), N.partition_count(rows))
    assert router.parts > 1 and 1 <= router.visits <= router.parts / 2


def clusters(sizes, seed, width=8, spread=0.05):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=width) * 10 + rng.normal(size=(n, width)) * spread for n in sizes])


@pytest.mark.parametrize("sizes", [(58, 6), (90, 10), (450, 50), (1, 200), (1500, 300, 200)])
def test_every_query_has_all_its_rows(spark, sizes):
    vectors = clusters(sizes, sum(sizes))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    every = 1 if len(vectors) < 300 else 20
    found = N.nearest(df, every=every).groupBy("query_id").count().collect()
    assert len(found) == -(-len(vectors) // every) and {r["count"] for r in found} == {min(10, len(vectors) - 1)}


@pytest.mark.parametrize("sizes", [(450, 50), (2700, 300), (1500, 900, 600)])
def test_the_index_is_balanced(spark, sizes):
    vectors = clusters(sizes, 3)
    vectors[: len(vectors) // 3] = vectors[0]  # a third are copies
    parts = N.partition_count(len(vectors))
    router = N.fit_router(vectors, parts)
    rows = [(i, v.tolist(), router.ranked(v[None, :])[0, : N.CHOICES].tolist()) for i, v in enumerate(vectors)]
    ranked = spark.createDataFrame(rows, "vec_id long, embedding array<double>, choices array<int>")
    held = [r["count"] for r in ranked.groupBy(N.with_capacity(ranked, parts, len(rows)).alias("part")).count().collect()]
    assert sum(held) == len(rows) and max(held) <= 2 * len(rows) / parts


@pytest.mark.parametrize("scale", [1e160, 1e-200, 1e300])
def test_magnitudes_beyond_squares(spark, scale):
    vectors = np.random.default_rng(5).normal(size=(300, 6)) * scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got, hits = {}, 0
    for r in N.nearest(df, every=10).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    wanted = brute(list(range(300)), vectors / scale, 10, 10)
    for q, near in wanted.items():
        exact = np.sqrt((((vectors - vectors[q]) / scale) ** 2).sum(axis=1))
        assert len(got[q]) == 10 and np.allclose([s / scale for s in got[q].values()], exact[list(got[q])], rtol=1e-12)
        hits += len(got[q].keys() & {i for i, _ in near})
    assert hits / (10 * len(wanted)) >= 0.9


def test_mixed_magnitudes_are_exact():
    rng = np.random.default_rng(8)
    known = np.concatenate((rng.normal(size=(50, 4)), rng.normal(size=(50, 4)) * 1e200))
    for ids, near, score in N.nearest_in(np.arange(100), known, np.arange(100), known, 5):
        exact = np.sqrt(((known[near] / 1e200 - known[ids[0]] / 1e200) ** 2).sum(axis=1)) * 1e200 if ids[0] >= 50 else np.sqrt(((known[near] - known[ids[0]]) ** 2).sum(axis=1))
        assert len(near) == 5 and ids[0] not in near and np.allclose(score, exact, rtol=1e-12)


def test_partitions_grow_with_the_table():
    assert [N.partition_count(n) for n in (0, 1, 15, 16, 500, 2000, 51_282, 10**9)] == [1, 1, 1, 2, 8, 16, 64, 256]


def test_partitions_are_balanced():
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(1600, 8))
    sizes = np.bincount(N.balanced_parts(vectors, N.neighbour_graph(vectors, 10), 16), minlength=16)
    assert sizes.max() <= 111 and sizes.sum() == 1600
