"""Fixture cases of operators: stated results for nulls, ties, multisets, markup and dates."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliant.functions import arrays as A, dates as D, ids as I, jsonx as J, text as T, vectors as V
from foliant.operators import chunking as C, evaluate as E, graph as G, mapping as M, parsing as X, relational as R, search as S, validation as L


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def lit(value, kind="string"):
    return F.lit(value).cast(kind) if not isinstance(value, list) else F.array(*[F.lit(v) for v in value]).cast("array<string>")


# The stated results of each metric, with cases of our own at the end of the lists.
@pytest.mark.parametrize("a, b, score", [("2024-01-01", "2024-01-01", 1), ("Jan 1, 2024", "2024-01-01", 1), ("2024-01-01", "2024-01-02", 0), (None, "2024-01-01", 0), ("2024-01-01", None, 0), (None, None, 1), ("invalid-date", "2024-01-01", 0), ("3 May 2024", "2024-05-03", 1), ("", "", 1)])
def test_date_score(spark, a, b, score):
    assert one(spark, D.same_date(lit(a), lit(b))) == score


@pytest.mark.parametrize("a, b, score", [("10", "10", 1), ("10.5", "10.5", 1), ("10", "10.0", 1), ("10", "11", 0), (None, "10", 0), ("10", None, 0), (None, None, 1), ("ten", "10", 0), ("1e1", "10", 1), ("10.0000001", "10", 1)])
def test_number_score(spark, a, b, score):
    assert one(spark, E.number_score(lit(a), lit(b))) == score


@pytest.mark.parametrize("a, b, match, inside", [("A", "A", 1, 1), ("A", "B", 0, 1), ("D", "A", 0, 0), (None, "A", 0, 1), ("A", None, 0, 1), (None, None, 1, 1), ("D", None, 0, 0)])
def test_enum_scores(spark, a, b, match, inside):
    scores = E.enum_scores(lit(a), lit(b), ["A", "B", "C"], required=False)
    assert one(spark, scores["match"], scores["predicted_in_choices"]) == (match, inside)


@pytest.mark.parametrize("a, b, counts", [
    (["a", "b", "c"], ["a", "b", "c"], (3, 0, 0)),
    (["a", "b"], ["a", "b", "c"], (2, 0, 1)),
    (["a", "b", "d"], ["a", "b", "c"], (2, 1, 1)),
    ([], ["a", "b"], (0, 0, 2)),
    (["a", "b"], [], (0, 2, 0)),
    (None, ["a"], (0, 0, 1)),
    (["a"], None, (0, 1, 0)),
    (None, None, (0, 0, 0)),
    (["a", "a"], ["a"], (1, 1, 0)),
    (["a"], ["a", "a"], (1, 0, 1)),
    (["x", "y", "x"], ["x", "x", "z"], (2, 1, 1)),
])
def test_list_scores(spark, a, b, counts):
    column = lambda v: F.lit(None).cast("array<string>") if v is None else lit(v)
    scores = E.list_scores(column(a), column(b))
    assert one(spark, *[scores[m] for m in ("true_positives", "false_positives", "false_negatives")]) == counts


def test_rouge(spark):
    from foliant.shipping import ship

    ship(spark)
    df = spark.createDataFrame([("hello there", "hello world"), ("same words", "same words"), (None, "x")], "a string, b string")
    rows = [tuple(r) for r in df.select(*E.rouge_scores(F.col("a"), F.col("b")).values()).collect()]
    assert rows == [(0.5, 0.0, 0.5), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)]


SCHEMA = {"date_field": {"type": "date"}, "enum_field": {"type": "enum", "choices": ["A", "B", "C"], "required": False}, "list_field": {"type": "list"}, "string_field": {"type": "string"}}


def test_record_evaluator(spark):
    gold = '{"date_field": "2024-01-01", "enum_field": "A"}'
    rows = [(0, f"```json\n{gold}\n```", gold), (1, '```json\n{"date_field": "2024-01-02", "enum_field": "D"}\n```', gold), (2, "invalid json", gold), (3, "{}", gold), (4, '{"list_field": ["x", "z"], "string_field": "hello there"}', '{"list_field": ["x", "y"], "string_field": "hello world"}'), (5, "[1]", gold), (6, '{"list_field": []}', gold)]
    items, scores = E.score_records(spark.createDataFrame(rows, "idx int, answer string, gold string"), SCHEMA)
    found = {r.idx: r for r in items.collect()}
    assert [found[i].status for i in range(7)] == ["success", "success", "parsing_error", "success", "success", "parsing_error", "judge_error"]
    assert [found[i].missing_keys for i in range(4)] == [["list_field", "string_field"], ["list_field", "string_field"], [], sorted(SCHEMA)]
    values = {(r.idx, r.field, r.metric): r.value for r in scores.collect()}
    assert values[0, "date_field", "match"] == 1 and values[1, "date_field", "match"] == 0 and values[1, "enum_field", "predicted_in_choices"] == 0
    assert values[3, "enum_field", "match"] == 0  # a missing key is no null
    assert [values[4, "list_field", m] for m in ("true_positives", "false_positives", "false_negatives", "precision", "recall", "f1")] == [1, 1, 1, 0.5, 0.5, 0.5]
    assert values[4, "string_field", "rouge1"] == 0.5 and values[4, "string_field", "rouge2"] == 0


def test_aggregation(spark):
    scores = spark.createDataFrame([("key1", "m", 1.0), ("key1", "m", 0.5), ("key2", "m", 0.0), ("key2", "m", 0.5), ("key3", "m", 1.0)], "field string, metric string, value double")
    assert {r.field: (r["mean"], r.error) for r in E.mean_with_error(scores).collect()} == {"key1": (0.75, pytest.approx(0.25)), "key2": (0.25, pytest.approx(0.25))}


def test_chunks():
    text = "\nThis is a first line of 37 char text.\nThis is a second line of 38 char text.\n"
    assert C.split_text(text, 38) == ["This is a first line of 37 char text.", "This is a second line of 38 char", "text."]
    assert C.split_text(text, 38, 10)[-1] == "38 char text."


def test_chunk_ids_after_filter(spark):
    docs = spark.createDataFrame([(1, "ab\n\nabcdefghijk"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in C.chunk_documents(docs, 14, 0, least_chars=5).collect()] == [(1, 0, 11, "abcdefghijk")]


def test_weighted_mean(spark):
    rows = [("doc1", 2, [1.0, 2.0]), ("doc1", 3, [3.0, 4.0]), ("doc2", 1, [5.0, 6.0]), ("doc2", 2, [7.0, 8.0]), ("doc3", 1, [9.0, 10.0])]
    df = spark.createDataFrame(rows, "id string, n int, v array<double>")
    found = {r.id: r.v for r in V.mean_vectors(df, "id", "v", F.col("n")).collect()}
    assert found["doc1"] == pytest.approx([2.2, 3.2]) and found["doc2"] == pytest.approx([6.3333, 7.3333], abs=1e-3) and found["doc3"] == [9.0, 10.0]


def test_uuids(spark):
    import uuid

    a, b, c, d = one(spark, I.sha_uuid(lit("doc_1")), I.sha_uuid(lit("doc_1"), F.lit(0)), I.sha_uuid(lit("doc_1"), F.lit(1)), I.name_uuid(lit("Zażółć")))
    assert len(a) == 36 and a.count("-") == 4 and a == b != c and d == str(uuid.uuid5(uuid.NAMESPACE_DNS, "Zażółć"))


@pytest.mark.parametrize("text, out", [("2012-11-27 14:45:14.0 CET", "2012-11-27T14:45:14+01:00"), ("2012-06-27 14:45:14.0 CEST", "2012-06-27T14:45:14+02:00"), ("2012-11-27 14:45:14", "2012-11-27T14:45:14+01:00"), ("2012-11-27", "2012-11-27T00:00:00+01:00"), ("", None), (None, None)])
def test_rfc3339(spark, text, out):
    assert one(spark, *D.rfc3339(lit(text))) == (out, None)


def test_bad_dates(spark):
    for text in ("not a date", "2012-13-45"):
        assert one(spark, *D.rfc3339(lit(text))) == (None, f"Failed to convert date: {text}")
    assert one(spark, D.or_fallback(lit("x"))) == "2023-01-01T00:00:00Z"


def test_judgment_xml(spark):
    link = lambda isap, text: f'<xLexLink xArt="art. 1" xIsapId=" {isap} " xTitle="t" xAddress="a">{text}</xLexLink>'
    xml = f'<r xToPage="3" xVolNmbr="1" xVolType="15/15"><xBlock><xText> Hello {link("A", "art. 1")}{link("A", "art. 1 § 2")}{link("B", " ")}</xText></xBlock></r>'
    row = X.with_judgment_xml(spark.createDataFrame([(1, xml), (2, "<r/>"), (3, None)], "id int, xml string"), "xml").orderBy("id").collect()
    assert (row[0].num_pages, row[0].vol_number, row[0].vol_type, row[0].text) == (3, 1, "15/15", "Helloart. 1art. 1 § 2")
    assert [(b.isap_id, b.text) for b in row[0].text_legal_bases] == [("A", "art. 1 § 2")]
    assert row[1].error and row[1].text is None and row[2].error is None


def test_judgment_page(spark):
    html = """<span class="war_header">II SA/Op 8/05 - Wyrok WSA w Opolu</span><table>
      <tr class="niezaznaczona"><td class="lista-label">Data orzeczenia</td><td class="info-list-value"><table><tr><td>2005-10-13</td><td>orzeczenie prawomocne</td></tr></table></td></tr>
      <tr class="niezaznaczona"><td class="lista-label">Sędziowie</td><td class="info-list-value">Jan A /przewodniczący/<br/>Ewa B /sprawozdawca/<br/>Ola C</td></tr>
      <tr class="niezaznaczona"><td class="lista-label">Powołane przepisy</td><td class="info-list-value"><a href="/l1">Dz.U. 1</a> art. 2<br/><span class="nakt">Ustawa X</span><br/><a href="/l2">Dz.U. 3</a><br/></td></tr>
      <tr class="niezaznaczona"><td class="lista-label">Sygn. powiązane</td><td class="info-list-value"><span class="powiazane"><a href="/doc/A1">II OSK 1/06 - Wyrok NSA z 2006-01-02</a></span></td></tr></table>
      <div class="lista-label">Uzasadnienie</div><span class="info-list-value-uzasadnienie"><p>One </p><p>Two</p></span><a href="/doc/B2">x</a>"""
    row = X.with_judgment_page(spark.createDataFrame([(html,)], "html string"), "html").first()
    assert (row.docket_number, row.judgment_type, str(row.judgment_date), row.finality) == ("II SA/Op 8/05", "Wyrok WSA w Opolu", "2005-10-12 22:00:00", "orzeczenie prawomocne")
    assert (row.judges, row.presiding_judge, row.judge_rapporteur) == (["Jan A", "Ewa B", "Ola C"], "Jan A", "Ewa B")
    assert [(b.law, b.journal, b.article, b.link) for b in row.text_legal_bases] == [("Ustawa X", "Dz.U. 1", "art. 2", "/l1"), (None, "Dz.U. 3", None, "/l2")]
    assert [(r.judgment_id, r.docket_number, r.judgment_type, str(r.judgment_date)) for r in row.related_docket_numbers] == [("/doc/A1", "II OSK 1/06", "Wyrok NSA", "2006-01-01 23:00:00")]
    assert row.reasons_for_judgment == "One\n\nTwo" and X.page_links(html) == ["/doc/B2"]


def test_graph(spark):
    df = spark.createDataFrame([(1, [101, 102, 101]), (2, [102]), (3, [103]), (4, []), (5, None)], "j long, bases array<long>")
    edges = G.bipartite_edges(df, "j", "bases")
    assert sorted(map(tuple, edges.collect())) == [(1, 101), (1, 102), (2, 102), (3, 103)]
    giant = G.giant_component(edges, "j", "item")
    assert tuple(G.graph_stats(giant, "j", "item").first()) == (3, 2, 2, 4, 1.5)
    assert sorted(r["index"] for r in G.node_indices(edges, "j").collect()) == [0, 1, 2]
    assert {tuple(r) for r in G.connected_components(edges, "j", "item").collect()} == {(1, 1), (2, 1), (101, 1), (102, 1), (3, 3), (103, 3)}


def test_fusion(spark):
    v = spark.createDataFrame([("x", 0), ("y", 1)], "id string, rank int")
    t = spark.createDataFrame([("y", 0), ("z", 1)], "id string, rank int")
    assert [(r.id, round(r.score, 6)) for r in S.fused(v, t, 10, "id").collect()] == [("y", 0.833333), ("x", 0.5), ("z", 0.333333)]


def test_validation():
    schema = {"f": {"type": "enum", "choices": ["A", "B"]}, "d": {"type": "date"}}
    assert [(e["error_type"], e["field"]) for e in L.record_errors({"f": "C", "z": 1}, schema)] == [("bad_value", "f"), ("missing", "d"), ("unknown_field", "z")]
    assert L.record_errors({"f": None, "d": ""}, schema) == []
    assert L.schema_from_text("a: enum [x, true] - kind\nb: list of enum [p, q]\nc: date")["b"] == {"type": "list", "items": {"type": "enum", "choices": ["p", "q"]}}
    with pytest.raises(ValueError):
        L.IngestSettings(chunk_size=10, overlap=10)


def test_joins_that_check(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "k int, b string")
    with pytest.raises(PySparkException):
        R.one_to_one(a, b, "k").collect()
    with pytest.raises(PySparkException):
        R.exactly_one(a, b, "k").collect()
    assert R.exactly_one(a.where("k = 2"), b, "k").count() == 1
    done = spark.createDataFrame([(2,), (2,)], "k int")
    assert R.new_rows(a, done, "k").count() == 1 and R.already_done(a, done, ["k"]).count() == 1


def test_mapping(spark):
    df = spark.createDataFrame([(1, "", None, "keep")], "id int, name string, court string, extra string")
    row = M.mapped(df, {"id": "document_id", "name": "title", "court": "title"}, {"title": "none", "language": "pl"}).first()
    assert row.asDict() == {"document_id": 1, "title": "none", "extra": "keep", "language": "pl"}
    out = M.configured(df, [{"source": "court", "target": "meta.court", "default": "c"}, {"source": "missing", "target": "meta.x"}, {"source": "name", "target": "title", "required": True}, {"source": "none", "target": "id", "required": True}]).first()
    assert out.meta.court == "c" and out.rejected == ["id"]


def test_small_functions(spark):
    values = one(
        spark, A.split_list(lit(" a; b,,c ")), A.without_placeholders(lit(["x", " Don't know "])), A.looked_up(lit(["a", "b"]), {"a": "1", "b": None}), A.all_whole_numbers(lit(["1", "x"])),
        T.role_of(lit("Jan /sprawozdawca/")), T.without_role(lit("Jan /sprawozdawca/")), T.rendered(" {a}-{b} ", {"a": lit("x"), "b": lit(None)}), T.is_url(lit("http:/x")), J.unfenced(lit("```json\n{}\n```")),
        J.keys_of(lit('{"b": 1, "a": null}')), T.regex_rewritten(lit("II SA 12"), [(r"(\d+)", "<$1>")]), T.mapped(lit(" Yes "), {"yes": "tak"}, any_case=True), A.multiset_overlap(lit(["a", "a"]), lit(["a"])),
    )
    assert values == (["a", "b", "c"], ["x"], ["1"], False, "sprawozdawca", "Jan", "x-", False, "{}", ["a", "b"], "II SA <12>", "tak", 1)


def test_snippets():
    assert X.snippets("aXbXc", "x", 1) == ["aXb...", "...bXc"]


def test_whole_histogram_has_every_value(spark):
    import numpy as np
    from foliant.operators import profile as P

    values = [0, 3, 3, 10, 4999, 5000, 5001, 80000, 123456]
    rows = P.whole_histogram(spark.createDataFrame([(v,) for v in [*values, None]], "v int"), "v", 50).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=50)
    assert [r.n for r in rows] == counts.tolist() and np.allclose([r.low for r in rows], edges[:-1])
    assert np.allclose([r.cumulative for r in rows], np.cumsum(counts) / 10)
    same = P.whole_histogram(spark.createDataFrame([(7,), (7,)], "v int"), "v", 50).where("n > 0").collect()
    assert [(r.bin, r.n, r.cumulative) for r in same] == [(25, 2, 1.0)]
    assert P.whole_histogram(spark.createDataFrame([(None,)], "v int"), "v", 50).count() == 0


def test_length_histogram_counts_long_documents(spark, tmp_path):
    from foliant.plans import catalog

    spark.createDataFrame([(1, "a"), (2, "b" * 5001), (3, "c" * 90000), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.queries()["docs_length_hist_whole"](spark, str(tmp_path)).orderBy("bin").collect()
    assert sum(r.n for r in rows) == 3 and (rows[-1].n, rows[-1].cumulative) == (1, 0.75)


def test_message_lists_hold_whole_texts(spark, tmp_path):
    import json

    from foliant.plans import catalog

    turns = [(1, 1, "user", 'Où 12 €?\n\t"é"\\ \u0001 \u2028 😀 </a>'), (1, 2, "assistant", ""), (1, 3, "user", None), (2, 1, "user", "x" * 50000 + "1.")]
    turns += [(3, i, "user", f"{i}, naïve\r\nline") for i in range(1, 40)]
    spark.createDataFrame(turns[::-1], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: json.loads(r.messages) for r in catalog.queries()["conv_messages_whole"](spark, str(tmp_path)).collect()}
    assert found == {c: [{"role": r, "content": t} for i, _, r, t in turns if i == c] for c in (1, 2, 3)}


def test_chunks_of_whole_long_documents(spark, tmp_path):
    from foliant.plans import catalog

    texts = {1: "short text", 2: " ".join(f"word{i}" for i in range(6000)), 3: "\n\n".join(f"Line {i}. " * 9 for i in range(200)), 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = [(d, i, len(c), c) for d, t in texts.items() for i, c in enumerate([c for c in C.split_text(t or "", 512, 128) if len(c) >= 50])]
    found = catalog.queries()["chunk_recursive"](spark, str(tmp_path)).orderBy("doc_id", "chunk_id").collect()
    assert [tuple(r) for r in found] == wanted and max(i for _, i, *_ in wanted) > 100
    first = C.chunk_documents(spark.read.parquet(f"{tmp_path}/documents.parquet"), 512, 128, least_chars=50, first_chunks=16)
    assert [tuple(r) for r in first.orderBy("doc_id", "chunk_id").collect()] == [w for w in wanted if w[1] < 16]


def test_chunks_of_every_document_as_they_come(spark):
    """The lateral join against the splitter itself, over whole documents, and a long one in little memory."""
    import tracemalloc

    from foliant.operators import chunking as C

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {}
    for r in C.chunk_documents(docs, 512, 128, 50).orderBy("doc_id", "chunk_id").collect():
        assert r.chunk_len == len(r.chunk_text) and r.chunk_id == len(found.setdefault(r.doc_id, []))
        found[r.doc_id].append(r.chunk_text)
    wanted = {r.doc_id: [c for c in C.split_text(r.text, 512, 128) if len(c) >= 50] for r in docs.collect() if r.text}
    assert found == {i: c for i, c in wanted.items() if c}
    few = C.chunk_documents(docs, 512, 128, 50, first_chunks=2).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in few} == {i: min(2, len(c)) for i, c in wanted.items() if c}
    text = "word " * 1_000_000
    tracemalloc.start()
    n = sum(1 for _ in C.text_chunks(text, 512, 128))
    assert n > 10_000 and tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()


def test_refined_communities_are_connected(spark):
    """On the whole graph of orders and parts: every community connected, modularity not below that of unrefined ones."""
    from foliant.operators import graph as G

    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    edges = lines.select((F.col("l_orderkey") + 1_000_000).alias("u"), F.col("l_partkey").alias("v")).distinct().cache()
    plain, refined = G.louvain(edges, "u", "v", 3.0, most_levels=1, most_rounds=3), G.leiden(edges, "u", "v", 3.0, most_levels=1, most_rounds=3)
    assert refined.count() == plain.count() == edges.select("u").distinct().count() + edges.select("v").distinct().count()
    parts = G.connected_parts(edges, refined, "u", "v")
    assert parts.select("label").distinct().count() == refined.select("label").distinct().count()
    score = lambda c: G.modularity(edges, c, "u", "v", 3.0).first()[0]
    assert score(G.connected_parts(edges, plain, "u", "v")) >= score(plain) - 1e-12 and score(refined) > 0
    apart = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "u long, v long")
    one = spark.createDataFrame([(n, 0) for n in range(1, 8)], "node long, label long")
    assert {(r.node, r.label) for r in G.connected_parts(apart, one, "u", "v").collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7)}


def test_window_ends_today(spark):
    from foliant.functions import dates as D

    row = spark.range(1).select(F.date_diff(D.end_of_window(0), D.end_of_window(14)).alias("n"), F.abs(F.date_diff(D.end_of_window(0), F.current_date())).alias("off")).first()
    assert row.n == 14 and row.off <= 1


def test_small_tables_are_never_cut(spark):
    from foliant import sinks

    for write in (sinks.markdown_table, sinks.latex_table):
        assert write(spark.range(3), most=3)
        with pytest.raises(ValueError):
            write(spark.range(4), most=3)


def test_steps_are_counted_as_they_pass(spark, tmp_path):
    calls = {"low": lambda df: df.where("id < 60"), "even": lambda df: df.where("id % 2 = 0"), "none": lambda df: df.where("id < 0")}
    result, told = R.stepped(spark.range(100), calls)
    assert result._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    result.write.parquet(f"{tmp_path}/r")
    assert told() == [("low", 60, None), ("even", 30, -30), ("none", 0, -30)]


def test_unsettled_labels_are_an_error(spark):
    ring = spark.createDataFrame([(i, i + 1) for i in range(30)], "u long, v long")
    with pytest.raises(RuntimeError):
        G.label_propagation(ring, "u", "v", most_rounds=1)


def test_registered_chunk_queries_against_the_splitter(spark):
    import statistics

    from foliant.plans import catalog

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = {(r.doc_id, r.chunk_id): r.chunk_text for r in catalog.queries()["chunk_recursive"](spark, sf).collect()}
    wanted = {i: [c for c in C.split_text(t, 512, 128) if len(c) >= 50] for i, t in docs if t}
    assert found == {(i, k): c for i, cs in wanted.items() for k, c in enumerate(cs)}
    each = [cs for _, t in docs if t is not None and len(t) >= 100 and (cs := C.split_text(t, 512, 128))]
    row, sizes = catalog.queries()["chunk_stats"](spark, sf).first(), [len(cs) for cs in each]
    assert (row.n_docs, row.least, row.most) == (len(each), min(sizes), max(sizes))
    assert row["mean"] == pytest.approx(statistics.mean(sizes), abs=1e-6) and row.deviation == pytest.approx(statistics.stdev(sizes), abs=1e-6)
    assert row.mean_len == pytest.approx(sum(len(c) for cs in each for c in cs) / sum(sizes), abs=1e-6)
