"""Queries over markup: the tables' pages, and judgments built from the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import arrays as A
from foliant.operators import parsing as X, validation as V
from foliant.plans.registering import registrar
from foliant.shipping import spread
from foliant.sources import files, table

QUERIES, query = registrar()


@query("SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS link FROM pages")
def pages_links(spark, sf_dir):
    return X.with_links(table(spark, sf_dir, "pages").select("page_id", "html"), "html", pattern="(?s).*").select("page_id", F.explode("links").alias("link"))


#: Named references stand with or without a semicolon in HTML; a number ends where its digits do.
_ENTITIES = (("&copy;?", "©"), ("&middot;?", "·"), ("&nbsp;?", " "), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "''"), ("&#39([^0-9]|$)", "''\\1"), ("&amp;?", "&"))


def _unescaped_sql(sql: str) -> str:
    for entity, sign in _ENTITIES:
        sql = f"regexp_replace({sql}, '{entity}', '{sign}', 'g')"
    return sql


def _text_sql(html: str) -> str:
    """Visible text by regular expressions, without a tree."""
    sql = f"regexp_replace({html}, '<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gs')"
    for name in ("script", "style", "head"):
        sql = f"regexp_replace({sql}, '<{name}[ >].*?</{name}>', '', 'gs')"
    sql = f"regexp_replace(regexp_replace({sql}, '</?(p|div|li|h1|h2|h3|h4|tr|br|section|article|title)( [^>]*)?/?>', chr(10), 'g'), '</?[a-zA-Z][^>]*>', '', 'g')"
    sql = _unescaped_sql(sql)
    lines = f"list_transform(string_split({sql}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[\\s\\xA0]+', ' ', 'g'), '^ | $', '', 'g'))"
    return f"array_to_string(list_filter({lines}, lambda x: x <> ''), chr(10))"


@query(f"SELECT page_id, trim({_unescaped_sql("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title FROM pages")
def pages_title(spark, sf_dir):
    return X.with_title(table(spark, sf_dir, "pages").select("page_id", "html"), "html").select("page_id", F.coalesce("title", F.lit("")).alias("title"))


@query(f"SELECT page_id, length(t)::INT AS n_chars, t AS visible_text FROM (SELECT page_id, {_text_sql('html')} AS t FROM pages) p")
def pages_text(spark, sf_dir):
    return X.parsed_with("visible_text", table(spark, sf_dir, "pages").select("page_id", "html"), "html").select("page_id", F.length("visible_text").alias("n_chars"), "visible_text")


def _judgment_xml(spark, sf_dir):
    """Orders as XML: every 13th without a block, every 17th not well formed; two links of one act and a blank one."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    link = lambda isap, art, text: F.concat(F.lit('<xLexLink xArt="'), F.lit(art), F.lit('" xIsapId=" '), isap, F.lit(' " xTitle="T" xAddress="A">'), text, F.lit("</xLexLink>"))
    act = (k % 5).cast("string")
    body = F.concat(F.lit("<xBlock><xText> Order "), k.cast("string"), F.lit("\n \n\n"), F.col("o_orderpriority"), F.lit(" </xText>"), link(act, "art. 1", F.lit("art. 1")), link(act, "art. 1", F.lit("art. 1 § 2")), link(F.lit("x"), "art. 9", F.lit(" ")), F.lit("</xBlock>"))
    body = F.when(k % 13 == 0, F.lit("<xOther/>")).otherwise(body)
    xml = F.concat(F.lit('<r xToPage="'), (k % 40).cast("string"), F.lit('" xVolNmbr="'), (k % 3).cast("string"), F.lit('" xVolType="'), F.col("o_orderstatus"), F.lit('">'), body, F.when(k % 17 == 0, F.lit("</q>")).otherwise(F.lit("</r>")))
    return o.select("o_orderkey", xml.alias("xml"))


_FINE = "(o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0)"


@query(f"""SELECT o_orderkey, CASE WHEN {_FINE} THEN o_orderkey % 40 END::INT AS num_pages, CASE WHEN {_FINE} THEN o_orderkey % 3 END::INT AS vol_number, CASE WHEN {_FINE} THEN o_orderstatus END AS vol_type,
  CASE WHEN {_FINE} THEN 'Order ' || o_orderkey || chr(10) || chr(10) || o_orderpriority || 'art. 1art. 1 § 2' END AS text, NOT {_FINE} AS failed FROM orders""")
def judgment_xml(spark, sf_dir):
    parsed = X.parsed_with("judgment_xml", _judgment_xml(spark, sf_dir), "xml")
    return parsed.select("o_orderkey", "num_pages", "vol_number", "vol_type", "text", F.col("error").isNotNull().alias("failed"))


@query(f"SELECT o_orderkey, (o_orderkey % 5)::VARCHAR AS isap_id, 'art. 1 § 2' AS text, 'art. 1' AS art, 'T' AS title, 'A' AS address FROM orders WHERE {_FINE}")
def judgment_xml_bases(spark, sf_dir):
    """The longest text of each act that a judgment cites."""
    parsed = X.with_judgment_xml(_judgment_xml(spark, sf_dir), "xml")
    return parsed.select("o_orderkey", F.inline("text_legal_bases")).select("o_orderkey", "isap_id", "text", "art", "title", "address")


@query("""SELECT c_custkey, 0 AS at, 'title' AS kind, 'S' || c_nationkey AS mark, c_name AS text FROM customer WHERE c_custkey % 7 <> 0 UNION ALL
  SELECT c_custkey, 1, 'bullet', '1)', c_mktsegment || ' more' FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 2, 'title', 'inner', 'End' FROM customer WHERE c_custkey % 7 <> 0""")
def judgment_special_tags(spark, sf_dir):
    """Titles and bullets of sections; every seventh document is not well formed and has none."""
    c = table(spark, sf_dir, "customer")
    xml = F.concat(F.lit('<r><xUnit xSffx="S'), F.col("c_nationkey").cast("string"), F.lit('"><xName> '), F.col("c_name"), F.lit(" </xName><xEnum><xEnumElem><xBullet>1)</xBullet><xText>"), F.col("c_mktsegment"), F.lit('</xText><xText>more</xText></xEnumElem></xEnum><xUnit xSffx="inner"><xName>End</xName></xUnit></xUnit>'), F.when(F.col("c_custkey") % 7 != 0, F.lit("</r>")).otherwise(F.lit("")))
    tags = X.with_special_tags(c.select("c_custkey", xml.alias("xml")), "xml")
    return tags.select("c_custkey", F.posexplode("tags").alias("at", "_t")).select("c_custkey", "at", "_t.kind", "_t.mark", "_t.text")


def _judgment_pages(spark, sf_dir, *more):
    """Customers as judgment pages; every 11th header has too many separators, every third one rapporteur for both roles."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", *more))
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    text = lambda s: F.lit(s)
    row = lambda label, value: F.concat(text('<tr class="niezaznaczona"><td class="lista-label">'), text(label), text('</td><td class="info-list-value">'), value, text("</td></tr>"))
    day = F.date_format(F.date_add(F.lit("2005-01-01").cast("date"), (k % 365).cast("int")), "yyyy-MM-dd")
    header = F.concat(text("II SA/"), key, F.when(k % 11 == 0, text(" - a - b")).otherwise(text(" - Wyrok WSA")))
    judges = F.when(k % 3 == 0, F.concat(F.col("c_name"), text(" /przewodniczący sprawozdawca/<br>Ola C"))).otherwise(F.concat(F.col("c_name"), text(" /przewodniczący/<br/>Ewa B /sprawozdawca/<br/>Ola C")))
    acts = F.concat(text('<a href="/l'), key, text('">Dz.U. '), key, text('</a> art. 2<br/><span class="nakt">Ustawa X</span><br/><a href="/m">Dz.U. 3</a><br/>'))
    links = F.concat(text('<span class="powiazane"><a href="/doc/A'), key, text('">II OSK '), key, text(" - Wyrok NSA z "), day, text("</a><a href='/doc/Q'>no pattern</a></span>"))
    html = F.concat(
        text('<html><body><span class="war_header">'), header, text("</span><table>"), row("Data orzeczenia", F.concat(text("<table><tr><td>"), day, text("<td>orzeczenie prawomocne</table>"))), row("Data wpływu", day),
        row("Sąd", text("Sąd Y")), row("Sędziowie", judges), row("Symbol z opisem", F.concat(F.col("c_mktsegment"), text("<br>"), key)), row("Hasła tematyczne", text("  ")), row("Powołane przepisy", acts), row("Sygn. powiązane", links),
        row("Skarżony organ", F.concat(text("Organ<br/>"), key)), text('</table><div class="lista-label">Sentencja</div><span class="info-list-value-uzasadnienie"><p>One '), key, text('<p>Two</span><div class="lista-label">Uzasadnienie</div><span class="info-list-value-uzasadnienie"><p> Why </p></span><a href="/doc/B'),
        key, text('">x</a><p>Znaleziono  '), key, text(" orzeczeń</p></body></html>"),
    )
    return c.select("c_custkey", F.when(k % 19 != 0, html).alias("html"), *more)


_HAS = "c_custkey % 19 <> 0"
_CUT = f"({_HAS} AND c_custkey % 11 <> 0)"


@query(f"""SELECT c_custkey, CASE WHEN {_CUT} THEN 'II SA/' || c_custkey END AS docket_number, CASE WHEN {_CUT} THEN 'Wyrok WSA' END AS judgment_type, CASE WHEN {_HAS} THEN 'orzeczenie prawomocne' END AS finality,
  CASE WHEN {_HAS} THEN 'Sąd Y' END AS court_name, CASE WHEN {_HAS} THEN c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '|Ewa B' END || '|Ola C' END AS judges, CASE WHEN {_HAS} THEN c_name END AS presiding_judge,
  CASE WHEN {_HAS} THEN CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'Ewa B' END END AS judge_rapporteur, CASE WHEN {_HAS} THEN c_mktsegment || '|' || c_custkey END AS case_type, CASE WHEN {_HAS} THEN 'Organ; ' || c_custkey END AS challenged_authority,
  CASE WHEN {_HAS} THEN 'One ' || c_custkey || chr(10) || chr(10) || 'Two' END AS full_text, CASE WHEN {_HAS} THEN 'Why' END AS reasons_for_judgment, coalesce({_HAS} AND c_custkey % 11 = 0, false) AS failed FROM customer""")
def judgment_page(spark, sf_dir):
    parsed = X.parsed_with("judgment_page", _judgment_pages(spark, sf_dir), "html")
    return parsed.select("c_custkey", "docket_number", "judgment_type", "finality", "court_name", F.array_join("judges", "|").alias("judges"), "presiding_judge", "judge_rapporteur", F.array_join("case_type_description", "|").alias("case_type"), "challenged_authority", "full_text", "reasons_for_judgment", F.col("error").isNotNull().alias("failed"))


@query(f"SELECT c_custkey, 'Ustawa X' AS law, 'Dz.U. ' || c_custkey AS journal, 'art. 2' AS article, '/l' || c_custkey AS link FROM customer WHERE {_HAS} UNION ALL SELECT c_custkey, NULL, 'Dz.U. 3', NULL, '/m' FROM customer WHERE {_HAS}")
def judgment_page_acts(spark, sf_dir):
    parsed = X.with_judgment_page(_judgment_pages(spark, sf_dir), "html")
    return parsed.select("c_custkey", F.inline("text_legal_bases")).select("c_custkey", "law", "journal", "article", "link")


@query(f"""WITH d AS (SELECT c_custkey, (DATE '2005-01-01' + (c_custkey % 365)::INT)::TIMESTAMP AS day FROM customer WHERE {_HAS}),
  u AS (SELECT *, day - CASE WHEN day > TIMESTAMP '2005-03-27' AND day <= TIMESTAMP '2005-10-30' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS t FROM d)
  SELECT c_custkey, strftime(t, '%Y-%m-%d %H:%M') AS judgment_date, strftime(t, '%Y-%m-%d %H:%M') AS submission_date, '/doc/A' || c_custkey AS judgment_id, 'II OSK ' || c_custkey AS docket_number, 'Wyrok NSA' AS judgment_type, strftime(t, '%Y-%m-%d %H:%M') AS related_date FROM u""")
def judgment_page_dates(spark, sf_dir):
    """Days at midnight in Warsaw as instants, of the page and of the judgments that it names."""
    parsed = X.with_judgment_page(_judgment_pages(spark, sf_dir), "html")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    rows = parsed.where("html is not null").select("c_custkey", at("judgment_date").alias("judgment_date"), at("submission_date").alias("submission_date"), F.explode("related_docket_numbers").alias("r"))
    return rows.select("c_custkey", "judgment_date", "submission_date", "r.judgment_id", "r.docket_number", "r.judgment_type", at("r.judgment_date").alias("related_date"))


@query(f"""WITH p AS (SELECT c_nationkey AS day, CASE WHEN {_HAS} THEN 1 ELSE 0 END AS n, CASE WHEN {_HAS} THEN c_custkey ELSE 0 END AS r FROM customer)
  SELECT day, max(r)::INT AS n_reported, sum(n)::BIGINT AS n_listed, max(r) = sum(n) AS agrees FROM p GROUP BY day""")
def search_pages_reconciled(spark, sf_dir):
    """Documents that result pages list against those that they report; unfetched pages list none."""
    pages = _judgment_pages(spark, sf_dir, "c_nationkey").withColumnRenamed("c_nationkey", "day")
    listed, reported = files.result_pages(pages, "day", "html")
    return files.reconciled(listed, reported, "day", "ids", "n_reported").select("day", "n_reported", "n_listed", "agrees")


@query(f"SELECT c_custkey, CASE WHEN {_HAS} THEN '/doc/B' || c_custkey END AS link FROM customer")
def judgment_links(spark, sf_dir):
    """Links of a form, but those below a span of related judgments."""
    linked = X.with_links(_judgment_pages(spark, sf_dir), "html")
    return linked.select("c_custkey", F.when(F.size("links") > 0, F.array_join("links", "|")).alias("link"))


@query("SELECT doc_id, (len(string_split(lower(text), 'and')) - 1)::INT AS n FROM documents WHERE contains(lower(text), 'and')")
def kwic_counts(spark, sf_dir):
    """Number of snippets of a keyword: all its occurrences without overlap."""
    return X.with_snippets(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "and", 10).where(F.size("snippets") > 0).select("doc_id", F.size("snippets").alias("n"))


@query("SELECT source, sum((length(coalesce(text, '')) = 0 OR length(trim(text)) < 10)::INT)::BIGINT AS n_short, sum((length(trim(coalesce(text, ''))) > 100000)::INT)::BIGINT AS n_long FROM documents GROUP BY source")
def text_warning_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("w", V.text_warnings("text"))
    has = lambda kind: F.count_if(A.contains_value(F.col("w"), F.lit(kind)))
    return rows.groupBy("source").agg(has("very_short").alias("n_short"), has("very_long").alias("n_long"))
