"""Queries of mapping, record functions, models, validation and date handling."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from foliant.functions import arrays as A, dates as D, jsonx as J, text as X
from foliant.operators import chunking as C, evaluate as E, mapping as M, models, validation as V
from foliant.plans.registering import registrar
from foliant.shipping import spread
from foliant.sources import table

QUERIES, query = registrar()
_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


# mapping


@query("SELECT c_custkey AS document_id, c_name AS title FROM customer")
def map_strict(spark, sf_dir):
    """Of two sources with one target the last wins; what is not mapped goes."""
    return M.strict(table(spark, sf_dir, "customer"), {"c_custkey": "document_id", "c_mktsegment": "title", "c_name": "title", "missing": "x"})


@query("""SELECT c_custkey AS id, lower(c_mktsegment) AS segment, CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE 'none' END AS name, c_nationkey % 2 = 1 AND c_custkey % 3 = 0 AS rejected
  FROM customer""")
def map_configured(spark, sf_dir):
    """Transforms, defaults for nulls, nested targets, and rows that lack a required target."""
    rows = table(spark, sf_dir, "customer").withColumn("name", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")))
    rows = rows.withColumn("needed", F.when((F.col("c_nationkey") % 2 == 0) | (F.col("c_custkey") % 3 != 0), "y"))
    fields = [{"source": "c_custkey", "target": "id"}, {"source": "c_mktsegment", "target": "meta.segment", "transform": "lower"}, {"source": "name", "target": "meta.name", "default": "none"}, {"source": "needed", "target": "needed", "required": True}]
    return M.configured(rows, fields).select("id", "meta.segment", "meta.name", (F.size("rejected") > 0).alias("rejected"))


@query("""SELECT doc_id, coalesce(lang, '') AS lang, n_chars::VARCHAR AS n_chars, '["' || coalesce(lang, '') || '",1]' AS pair, '1998-01-01T00:00:00Z' AS at, '' AS nothing FROM documents""")
def values_as_text(spark, sf_dir):
    """One text form of any value."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.array(F.coalesce("lang", F.lit("")), F.lit("1")).alias("pair"), F.lit("1998-01-01").cast("timestamp").alias("at"), F.lit(None).cast("int").alias("nothing"))
    return M.serialised(docs, ["lang", "n_chars", "pair", "at", "nothing"]).withColumn("pair", F.regexp_replace("pair", '"1"', "1"))


@query("SELECT doc_id, CASE WHEN lang IS NULL OR lang = '' THEN [] ELSE [lang] END[1] AS one, len(CASE WHEN lang IS NULL OR lang = '' THEN [] ELSE [lang] END)::INT AS n_one, 2::INT AS n_list FROM documents")
def values_as_lists(spark, sf_dir):
    """A list of texts from a list or from a single value."""
    one, listed = A.strings_of(F.col("lang"), False), A.strings_of(F.array(F.col("n_chars"), F.lit(1)), True)
    return table(spark, sf_dir, "documents").select("doc_id", F.try_element_at(one, F.lit(1)).alias("one"), F.size(one).alias("n_one"), F.size(listed).alias("n_list"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_nationkey <> 0 THEN c_nationkey::VARCHAR WHEN c_custkey % 3 = 0 THEN 'true' END AS first, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS present FROM customer""")
def first_of_columns(spark, sf_dir):
    """The first column that is not empty, zero or false, and the first that exists."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("a"), "c_nationkey", (F.col("c_custkey") % 3 == 0).alias("flag"))
    return rows.select("c_custkey", M.first_value(rows, ["none", "a", "c_nationkey", "flag"]).alias("first"), M.first_present(rows, ["none", "a"]).alias("present"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'a' WHEN 2 THEN '' END AS value FROM customer WHERE c_custkey % 5 <> 0")
def unwrap_lists(spark, sf_dir):
    """``{key: value}`` and ``{key: [values]}`` as lists; null stays null."""
    forms = F.element_at(F.array(F.lit('{"x": ["a", "b"]}'), F.lit('{"x": "a"}'), F.lit('{"x": []}'), F.lit(None).cast("string")), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select("c_custkey", forms.alias("t"))
    return rows.select("c_custkey", F.array_join(J.unwrapped(F.col("t"), "x"), "|").alias("value"))


@query("SELECT o_orderkey::VARCHAR AS document_id, 'T' || o_custkey AS document_number, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS date_issued, 'judgment' AS document_type FROM orders")
def convert_judgments(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("judgment_id"), F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("docket_number"), F.col("o_orderdate").alias("judgment_date"), "o_orderstatus")
    return M.legal_document(rows, "judgment")


@query("""SELECT p_partkey AS document_id, p_name AS title, p_brand AS document_number, '' AS date_issued, 'legal_act' AS document_type FROM part UNION ALL SELECT s_suppkey, NULL, NULL, NULL, 'tax_interpretation' FROM supplier""")
def convert_acts_and_interpretations(spark, sf_dir):
    acts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("document_number"), F.lit(None).cast("date").alias("enactment_date"), "p_size")
    others = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    return M.legal_document(acts, "legal_act").unionByName(M.legal_document(others, "tax_interpretation"), allowMissingColumns=True)


@query("SELECT o_orderkey AS judgment_id, o_orderstatus AS judgment_type, o_orderpriority AS court_name, 'pl-court' AS source FROM orders")
def unify_judgments(spark, sf_dir):
    return M.unified_judgment(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("court_name"), "o_custkey"))


@query("SELECT doc_id, CASE WHEN lang IS NOT NULL AND lang <> '' THEN lang WHEN source IS NOT NULL AND source <> '' THEN source END AS some FROM documents WHERE coalesce(lang, '') <> '' OR coalesce(source, '') <> ''")
def records_with_a_value(spark, sf_dir):
    """A struct whose fields are all empty counts as null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.struct("lang", "source").alias("r"))
    return docs.select("doc_id", J.null_if_all_falsy(F.col("r"), ["lang", "source"]).alias("r")).where("r is not null").select("doc_id", F.coalesce(F.nullif("r.lang", F.lit("")), F.nullif("r.source", F.lit(""))).alias("some"))


# lists


def _statuses(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("l_returnflag")).alias("flags"), F.array_sort(F.collect_list("l_linestatus")).alias("statuses"), F.max("l_returnflag").alias("flag"))  # a few lines an order


@query("SELECT bool_and(has) AS every, count(*) FILTER (has) AS n_has, count(*) FILTER (odd) AS n_odd FROM (SELECT list_contains(list(l_returnflag), max(l_returnflag)) AS has, list_contains(list(l_returnflag), 'A') AS odd FROM lineitem GROUP BY l_orderkey) t")
def member_of_list(spark, sf_dir):
    """Whether a value is in its row's list, and whether that holds for all rows."""
    has = _statuses(spark, sf_dir).select(A.contains_value(F.col("flags"), F.col("flag")).alias("has"), A.contains_value(F.col("flags"), F.lit("A")).alias("odd"))
    return has.agg(F.bool_and("has").alias("every"), F.count_if("has").alias("n_has"), F.count_if("odd").alias("n_odd"))


@query("SELECT l_orderkey AS id FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag IN ('A', 'X')) OR bool_or(contains(l_linestatus, 'O') OR contains(l_linestatus, 'Z'))")
def tags_filter(spark, sf_dir):
    """Rows with one of some values, or with a value that contains one of some parts."""
    rows = _statuses(spark, sf_dir)
    return rows.where(A.any_of(F.col("flags"), ["A", "X"]) | A.any_of(F.col("statuses"), ["O", "Z"], part=True)).select("id")


@query("""SELECT p_partkey, len(list_filter([p_name, p_type], lambda x: contains(x, 'a')))::INT > 0 AS some, p_size::VARCHAR ~ '^[0-9]+$' AND p_brand ~ '^[0-9]+$' AS whole, CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2') THEN p_brand END AS unknown FROM part""")
def list_predicates(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", A.any_contains(F.array("p_name", "p_type"), "a").alias("some"), A.all_whole_numbers(F.array(F.col("p_size").cast("string"), "p_brand")).alias("whole"), F.try_element_at(A.unknown_values(F.array("p_brand"), ["Brand#1", "Brand#2"]), F.lit(1)).alias("unknown"))


@query("""WITH t AS (SELECT p_partkey, len(list_distinct([p_type, p_name, p_type]))::INT AS np, [p_type, p_brand] AS g, [p_type, p_name] AS p FROM part)
  SELECT p_partkey, len(list_intersect(p, g))::INT AS both, len(list_filter(list_distinct(p), lambda x: NOT list_contains(g, x)))::INT AS predicted_only, len(list_filter(list_distinct(g), lambda x: NOT list_contains(p, x)))::INT AS gold_only FROM t""")
def list_scores_as_sets(spark, sf_dir):
    """Scores over sets, of which one side comes as separated text."""
    both, mine, theirs = A.set_counts(A.split_list(F.concat_ws(";", "p_type", "p_name", "p_type")), F.array("p_type", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", both.alias("both"), mine.alias("predicted_only"), theirs.alias("gold_only"))


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS head, CASE WHEN p_size % 2 = 0 THEN p_size END::INT AS number FROM part")
def first_parts_and_numbers(spark, sf_dir):
    """The first part of each item, and items as integers where they are some."""
    texts = F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("x1"))
    return table(spark, sf_dir, "part").select("p_partkey", A.first_parts(F.array("p_name"))[0].alias("head"), A.whole_numbers(texts)[0].alias("number"))


@query("SELECT id, item FROM (SELECT l_orderkey AS id, unnest(CASE WHEN l_linenumber = 2 THEN [] ELSE [l_returnflag, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linestatus END] END) AS item FROM lineitem) t WHERE item IS NOT NULL")
def exploded_items(spark, sf_dir):
    """One row per item; empty lists and null items give none."""
    items = F.when(F.col("l_linenumber") == 2, F.array().cast("array<string>")).otherwise(F.array("l_returnflag", F.when(F.col("l_linenumber") != 3, F.col("l_linestatus"))))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.explode(items).alias("item")).where("item is not null")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'x|y' WHEN 1 THEN c_mktsegment END AS kept FROM customer")
def flat_lists(spark, sf_dir):
    """Nested lists made flat without placeholders; null where none is left."""
    forms = F.when(F.col("c_custkey") % 3 == 0, F.array(F.array(F.lit("x"), F.lit(" Don't know ")), F.array(F.lit("y")))).when(F.col("c_custkey") % 3 == 1, F.array(F.array(F.col("c_mktsegment"), F.lit("DATA not available")))).otherwise(F.array(F.array(F.lit("don't know")), F.lit(None).cast("array<string>")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(A.flat_without_placeholders(forms), "|").alias("kept"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END AS known, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS unknown, CASE c_mktsegment WHEN 'BUILDING' THEN 'bb' END AS listed FROM customer")
def canonical_categories(spark, sf_dir):
    known, unknown = A.canonical(F.col("c_mktsegment"), {" building": "b", "Machinery ": "m"})
    listed = A.looked_up(F.array("c_mktsegment"), {"BUILDING": "bb", "MACHINERY": None})
    return table(spark, sf_dir, "customer").select("c_custkey", known.alias("known"), unknown.alias("unknown"), listed[0].alias("listed"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type || ';' || p_brand || ', ,', ';'), lambda x: trim(x, ' ,')), lambda x: x <> ''), '|') AS items FROM part")
def separated_lists(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(A.split_list(F.concat("p_type", F.lit(";"), "p_brand", F.lit(", ,"))), "|").alias("items"))


# text


@query(f"SELECT doc_id, len({_WORDS.format('text')})::INT AS n_tokens, len(list_filter({_WORDS.format('text')}, lambda t: regexp_matches(t, '[^!-/:-@\\[-`{{-~]')))::INT AS n_worded FROM documents WHERE text IS NOT NULL")
def worded_token_counts(spark, sf_dir):
    """Tokens, and those that are more than punctuation."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"), F.size(X.worded_tokens(F.col("text"))).alias("n_worded"))


@query("SELECT c_custkey, 'sprawozdawca' AS role, c_name AS bare, 'Dear ' || c_name || ', ' || c_mktsegment AS letter, replace(replace(c_mktsegment || '/a\\b', '/', '_'), '\\', '_') AS safe, CASE WHEN c_custkey % 2 = 0 THEN 'failed to read' ELSE 'no text' END AS kind FROM customer")
def roles_templates_and_names(spark, sf_dir):
    named = F.concat("c_name", F.lit(" / sprawozdawca /"))
    letter = X.rendered("  Dear {name}, {segment}{missing} ", {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "missing": F.lit(None)})
    message = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("failed  to read "), "c_name")).otherwise("no text")
    return table(spark, sf_dir, "customer").select("c_custkey", X.role_of(named).alias("role"), X.without_role(named).alias("bare"), letter.alias("letter"), X.safe_name(F.concat("c_mktsegment", F.lit("/a\\b"))).alias("safe"), X.first_words(message).alias("kind"))


class _Words:
    """A stand-in for a tokenizer: one id for each word, its length."""

    def encode(self, text: str) -> list[int]:
        return [len(w) for w in text.split(" ") if w]

    def decode(self, ids: list[int]) -> str:
        return " ".join("x" * i for i in ids)


_SPACED = "list_filter(string_split({}, ' '), lambda x: x <> '')"


@query(f"SELECT conv_id, turn, role, len({_SPACED.format('text')})::INT AS n_tokens, greatest(len({_SPACED.format('text')}) - 20, 0)::INT AS num_truncated_tokens, round(greatest(len({_SPACED.format('text')}) - 20, 0)::DOUBLE / greatest(len({_SPACED.format('text')}), 1), 6) AS truncated_ratio FROM conversations WHERE text IS NOT NULL")
def tokenizer_truncation(spark, sf_dir):
    """Counts and truncation in the tokens of a tokenizer that is passed in."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").withColumn("context", F.col("text"))
    cut = C.truncated_by(turns, _Words, 20, counts="n_tokens")
    return cut.select("conv_id", "turn", "role", "n_tokens", "num_truncated_tokens", F.round("truncated_ratio", 6).alias("truncated_ratio"))


@query("SELECT p_partkey, len(w[1]) || ',' || coalesce(len(w[2]), 0) || ',' || coalesce(len(w[3]), 0) AS input_ids, '1,' || (len(w) >= 2)::INT || ',' || (len(w) >= 3)::INT AS attention_mask FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) t")
def padded_token_ids(spark, sf_dir):
    """Ids cut or filled up to three, with their mask."""
    ids = C.with_token_ids(table(spark, sf_dir, "part"), _Words, "p_name")
    return C.padded(ids, "ids", 3).select("p_partkey", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("attention_mask", ",").alias("attention_mask"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, {_WORDS.format('text')} AS w FROM conversations WHERE text IS NOT NULL)
  SELECT conv_id, turn, role, 2::INT AS n_messages, 'user|assistant' AS roles, rtrim('Summarise: ' || array_to_string(list_slice(w, 1, 30), ' ')) AS prompt, 'Done now' AS answer, greatest(len(w) - 30, 0)::INT AS num_truncated_tokens FROM t""")
def training_messages(spark, sf_dir):
    """Prompt, cut context and answer as messages."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "role", F.col("text").alias("context"), F.lit("Summarise:").alias("prompt"), F.lit("Done now").alias("output"))
    rows = C.training_messages(turns, 33)
    return rows.select("conv_id", "turn", "role", F.size("messages").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["role"]), "|").alias("roles"), F.col("messages")[0]["content"].alias("prompt"), F.col("messages")[1]["content"].alias("answer"), "num_truncated_tokens")


@query(f"SELECT conv_id, (3 + sum(3 + len({_WORDS.format('coalesce(text, chr(32))')})))::INT AS n_tokens FROM conversations GROUP BY conv_id")
def message_token_counts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("m"))  # turns of one conversation
    return turns.select("conv_id", models.message_tokens(F.col("m")).alias("n_tokens"))


# JSON and YAML


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END::INT AS nation, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'a|b c|3' END AS tags, c_custkey % 5 = 0 AS failed FROM customer")
def yaml_answers(spark, sf_dir):
    """Mappings in fenced YAML; every fifth answer is no YAML mapping."""
    fence = F.concat(F.lit("Here it is:\n```yaml\n# note\nname: '"), "c_name", F.lit("'\nnation: "), F.col("c_nationkey").cast("string"), F.lit("\ntags:\n  - a\n  - \"b c\"\n  - 3\n```\nDone."))
    answer = F.when(F.col("c_custkey") % 5 == 0, "I could not find: it").otherwise(fence)
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"))
    rows = customers.select("c_custkey", J.yaml_object(F.when(F.col("c_custkey") % 5 == 0, "I could not\nfind it").otherwise(answer)).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    return rows.select("c_custkey", get("$.name", "string").alias("name"), get("$.nation", "int").alias("nation"), F.array_join(get("$.tags", "array<string>"), "|").alias("tags"), F.col("v").isNull().alias("failed"))


@query("SELECT event_id, props, '[\"' || event_type || '\"]' AS wrapped FROM events")
def json_or_list(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", J.json_or_array(F.col("props")).alias("props"), J.json_or_array(F.col("event_type")).alias("wrapped"))


@query("""SELECT lower(replace(r_name, ' ', '_')) AS field, 'enum' AS type, string_agg(n_name, '|' ORDER BY n_name) AS choices, 'region ' || r_regionkey AS description FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey
  UNION ALL SELECT lower(replace(r_name, ' ', '_')) || '_since', 'date', NULL, 'day of ' || r_name FROM region""")
def schema_of_lines(spark, sf_dir):
    """An extraction schema read from the lines that tables give (a field a region, of its nations' names), and written again."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    name = F.lower(F.replace("r_name", F.lit(" "), F.lit("_")))
    named = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names")).join(region, "r_regionkey")
    first = named.select(F.concat(name, F.lit(": enum ["), "names", F.lit("] - region "), F.col("r_regionkey").cast("string")).alias("line"))
    second = region.select(F.concat(name, F.lit("_since: date - day of "), "r_name", F.lit(" (example: 2024-01-01)")).alias("line"))
    lines = [r.line for r in first.unionByName(second).collect()]  # two lines a region
    schema = V.schema_from_text("\n".join(lines))
    again = V.schema_from_text(V.schema_lines({n: t for n, t in (line.split(": ", 1) for line in lines)}))
    if schema != again:
        raise ValueError("lines and schema differ")
    rows = [(n, f["type"], "|".join(f["choices"]) if "choices" in f else None, f.get("description")) for n, f in schema.items()]
    return spark.createDataFrame(rows, "field string, type string, choices string, description string")


# validation


_SCHEMA = {"name": {"type": "string"}, "nation": {"type": "int"}, "segment": {"type": "enum", "choices": ["BUILDING", "MACHINERY"]}, "day": {"type": "date"}, "tags": {"type": "list", "items": {"type": "enum", "choices": ["a", "b"]}}, "free": {"type": "other"}}


def _records(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    day = F.element_at(F.array(F.lit("2024-02-29"), F.lit("29.02.2024"), F.lit("")), (k % 3 + 1).cast("int"))
    nation = F.when(k % 4 == 0, "x").otherwise(F.col("c_nationkey").cast("string"))
    full = F.struct(F.col("c_name").alias("name"), nation.alias("nation"), F.col("c_mktsegment").alias("segment"), day.alias("day"), F.array(F.lit("a"), F.when(k % 5 == 0, "z").otherwise("b")).alias("tags"), F.lit("anything").alias("free"), F.when(k % 7 == 0, "extra").alias("more"))
    return c.select("c_custkey", "c_nationkey", F.concat(F.lit("```json\n"), F.to_json(full), F.lit("\n```")).alias("answer"))


_KINDS = (("nation", "bad_value", "c_custkey % 4 = 0"), ("segment", "bad_value", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"), ("day", "invalid_date_format", "c_custkey % 3 = 1"), ("tags", "bad_value", "c_custkey % 5 = 0"), ("more", "unknown_field", "c_custkey % 7 = 0"))


@query(" UNION ALL ".join(f"SELECT c_custkey, '{f}' AS field, '{e}' AS error_type FROM customer WHERE {w}" for f, e, w in _KINDS))
def record_errors(spark, sf_dir):
    """Kinds of errors by field, and none for fields of other types."""
    return V.with_errors(_records(spark, sf_dir), "answer", _SCHEMA).select("c_custkey", F.inline("errors")).select("c_custkey", "field", "error_type")


@query(f"SELECT c_custkey FROM customer WHERE NOT ({' OR '.join(w for *_, w in _KINDS)})")
def valid_records(spark, sf_dir):
    return V.valid_records(_records(spark, sf_dir), "answer", _SCHEMA).select("c_custkey")


@query(f"SELECT c_nationkey AS split, sum({' + '.join(f'({w})::INT' for *_, w in _KINDS)})::BIGINT AS num_errors FROM customer GROUP BY 1")
def errors_by_split(spark, sf_dir):
    return V.errors_per_split(V.with_errors(_records(spark, sf_dir).withColumnRenamed("c_nationkey", "split"), "answer", _SCHEMA))


@query(" UNION ALL ".join(f"SELECT '{e}' AS error_type, '{f}' AS field, {v} AS value, count(*) AS n FROM customer WHERE {w} GROUP BY {v}" for (f, e, w), v in zip(_KINDS, ("'x'", "c_mktsegment", "'29.02.2024'", "'z'", "'extra'"))))
def error_breakdown(spark, sf_dir):
    return E.error_breakdown(V.with_errors(_records(spark, sf_dir), "answer", _SCHEMA))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN lang IS NOT NULL AND length(lang) NOT IN (2, 5) THEN 'language' END, CASE WHEN doc_id % 3 = 0 THEN 'processing_status' END, CASE WHEN doc_id % 4 = 0 THEN 'document_type' END], lambda x: x IS NOT NULL), '|') AS broken FROM documents""")
def document_constraints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), F.when(F.col("doc_id") % 3 == 0, "lost").when(F.col("doc_id") % 3 == 1, "COMPLETED").alias("processing_status"), F.when(F.col("doc_id") % 4 == 0, "poem").otherwise("judgment").alias("document_type"))
    return docs.select("doc_id", F.array_join(V.document_violations(), "|").alias("broken"))


@query("SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS n_no_list, round(count(*) FILTER (event_id % 3 <> 0)::DOUBLE / count(*), 6) AS rate FROM events GROUP BY 1")
def values_that_are_no_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, "[1, 2]"))
    return rows.groupBy("event_type").agg(F.count_if(V.no_list("v")).alias("n_no_list"), F.round(V.success_rate(F.count_if(~V.no_list("v")), F.count("*")), 6).alias("rate"))


@query("SELECT unnest(['c_acctbal', 'c_custkey', 'c_mktsegment', 'c_name', 'c_nationkey']) AS \"column\", unnest(['number', 'number', 'text', 'text', 'number']) AS kind, unnest([true, true, false, true, true]) AS fits")
def column_kinds(spark, sf_dir):
    """What columns hold, and whether that is what was wanted."""
    c = table(spark, sf_dir, "customer")
    fits = V.kind_flags(c, {"c_acctbal": "number", "c_custkey": "number", "c_mktsegment": "list", "c_name": "text", "c_nationkey": "number"})
    return spark.createDataFrame(sorted((n, k, fits[n]) for n, k in V.column_kinds(c).items()), T.StructType.fromDDL("`column` string, kind string, fits boolean"))


@query("SELECT unnest(['duplicate_models', 'missing_required', 'unknown_targets', 'unmapped_sources']) AS problem, unnest(['base', 'needed', 'nowhere', 'c_acctbal|c_mktsegment']) AS names")
def mapping_problems(spark, sf_dir):
    """An ingestion's mapping checked against its source and its target."""
    found = V.mapping_problems({"c_custkey": "id", "c_name": "title", "c_nationkey": "nowhere"}, ["id", "title"], ["id", "needed"], ["base", "dev", "base"], table(spark, sf_dir, "customer").columns)
    return spark.createDataFrame(sorted((k, "|".join(v)) for k, v in found.items()), "problem string, names string")


@query("SELECT c_custkey, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM (SELECT c_custkey, (c_custkey % 11) / 10.0 AS s FROM customer) t")
def confidence_levels(spark, sf_dir):
    levels = {i: V.confidence_level(i / 10) for i in range(11)}
    return table(spark, sf_dir, "customer").select("c_custkey", X.mapped((F.col("c_custkey") % 11).cast("string"), {str(k): v for k, v in levels.items()}).alias("level"))


# dates

_FORMS = (
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", True), ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", True), ("dd.MM.yyyy HH:mm", "%d.%m.%Y %H:%M", True), ("MMM d, yyyy", "%b %-d, %Y", False), ("d MMMM yyyy", "%-d %B %Y", False), ("yyyyMMdd", "%Y%m%d", False),
    ("yyyy/MM/dd", "%Y/%m/%d", False), ("MM/dd/yyyy HH:mm:ss", "%m/%d/%Y %H:%M:%S", True),
)


def _shifted(spark, sf_dir):
    """Events by the time that their number gives, over three years and all hours of the day."""
    at = F.lit("2019-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("event_id") % 1096).cast("int"), (F.col("event_id") % 24).cast("int"), (F.col("event_id") % 60).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", at.alias("at"))


_AT = "(TIMESTAMP '2019-01-01' + to_days((event_id % 1096)::INT) + to_hours((event_id % 24)::INT) + to_minutes((event_id % 60)::INT))"
_SUMMER = " OR ".join(f"(w >= TIMESTAMP '{a}' AND w < TIMESTAMP '{b}')" for a, b in (("2019-03-31 03:00", "2019-10-27 03:00"), ("2020-03-29 03:00", "2020-10-25 03:00"), ("2021-03-28 03:00", "2021-10-31 03:00")))
_EDGE = " OR ".join(f"(w >= TIMESTAMP '{a} 02:00' AND w < TIMESTAMP '{a} 03:00')" for a in ("2019-03-31", "2019-10-27", "2020-03-29", "2020-10-25", "2021-03-28", "2021-10-31"))


@query(f"""WITH e AS (SELECT event_id, (event_id % {len(_FORMS)})::INT AS f, {_AT} AS t FROM events), w AS (SELECT event_id, CASE WHEN f IN ({', '.join(str(i) for i, x in enumerate(_FORMS) if x[2])}) THEN t ELSE date_trunc('day', t) END AS w FROM e)
  SELECT event_id, strftime(w, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {_SUMMER} THEN '+02:00' ELSE '+01:00' END AS date FROM w WHERE NOT ({_EDGE})""")
def dates_of_many_forms(spark, sf_dir):
    """Times in eight forms as RFC 3339 with Warsaw's offset; hours that the clock skips or repeats are left out."""
    rows = _shifted(spark, sf_dir)
    text = F.element_at(F.array(*[F.date_format("at", f) for f, *_ in _FORMS]), (F.col("event_id") % len(_FORMS) + 1).cast("int"))
    edge = F.to_date("at").cast("string").isin("2019-03-31", "2019-10-27", "2020-03-29", "2020-10-25", "2021-03-28", "2021-10-31") & (F.hour("at") == 2)
    timed = F.array(*[F.lit(x[2]) for x in _FORMS])[(F.col("event_id") % len(_FORMS)).cast("int")]
    return rows.where(~(edge & timed)).select("event_id", D.rfc3339(text)[0].alias("date"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2012-11-27T14:45:14+01:00' WHEN 1 THEN '2012-06-27T14:45:14+02:00' WHEN 2 THEN '2012-11-27T14:45:14+00:00' END AS a, CASE event_id % 4 WHEN 3 THEN '2012-06-27T00:00:00+02:00' ELSE NULL END AS b, (event_id % 4 = 3)::INT AS n_errors FROM events""")
def dates_of_fields(spark, sf_dir):
    """Several fields at once, absent ones skipped; zones that the texts name."""
    forms = F.element_at(F.array(F.lit("2012-11-27 14:45:14.0 CET"), F.lit("2012-06-27 14:45:14.0 CEST"), F.lit("2012-11-27T14:45:14Z"), F.lit("not a date")), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", forms.alias("a"), F.when(F.col("event_id") % 4 == 3, "2012-06-27").otherwise("").alias("b"))
    return D.with_rfc3339(rows, ["a", "b", "none"]).select("event_id", "a", "b", F.size("date_errors").alias("n_errors"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN '2023-01-01T00:00:00Z' ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') END AS fallback, CASE WHEN o_orderkey % 3 = 2 THEN 'x' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS reformatted, o_orderdate::DATE AS day,
  strftime(o_orderdate - CASE WHEN month(o_orderdate) BETWEEN 5 AND 8 THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M') AS local FROM orders WHERE month(o_orderdate) NOT IN (3, 4, 9, 10)""")
def dates_with_fallbacks(spark, sf_dir):
    """Reformatting, a constant for what cannot be read, dates before a space in mixed forms, midnight in Warsaw."""
    o = table(spark, sf_dir, "orders").where("month(o_orderdate) not in (3, 4, 9, 10)")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("x")
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select("o_orderkey", D.or_fallback(text).alias("fallback"), D.reformatted(text).alias("reformatted"), D.leading_date(mixed).alias("day"), F.date_format(D.local_midnight(F.date_format("o_orderdate", "yyyy-MM-dd")), "yyyy-MM-dd HH:mm").alias("local"))


@query("""WITH m AS (SELECT max(ts)::DATE AS last FROM events), d AS (SELECT unnest(generate_series(last - 14, last, INTERVAL 1 DAY))::DATE AS day FROM m)
  SELECT strftime(day, '%Y-%m-%d') AS day, count(event_id) AS n FROM d LEFT JOIN events ON ts::DATE = day GROUP BY 1""")
def days_of_a_window(spark, sf_dir):
    """All days of the last two weeks that the events reach, with how many each has."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    last = events.agg(F.max("day").alias("last"))
    days = last.select(F.explode(D.days_between(F.date_sub("last", 14), F.col("last"))).alias("day"))
    counts = events.groupBy("day").agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey, (o_orderkey % 3 <> 1)::INT::DOUBLE AS score FROM orders")
def date_scores(spark, sf_dir):
    """Dates in other forms are equal, another day is not, and two nulls are."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    gold = F.when(k != 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
    predicted = F.when(k == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).when(k == 1, F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd"))
    return o.select("o_orderkey", D.same_date(predicted, gold).alias("score"))
