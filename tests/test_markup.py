"""Markup that is deep, broken or badly closed, and headers, roles and acts of judgment pages."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import dates as D, jsonx as J
from foliant.operators import parsing as X


def test_deep_markup_is_no_recursion():
    for page in ("<p>x" * 100_000, "<div>x" * 100_000, "<b>" * 100_000 + "x" + "</b>" * 100_000):
        assert X.visible_text(page).replace("\n", "").strip("x") == ""
        assert X.parse_judgment_page(page)["error"] is None
    assert X.page_links("<i>" * 50_000 + '<a href="/doc/1">') == ["/doc/1"]
    assert X.parse_judgment_xml("<x>" * 10)["error"]


def test_end_tags_are_implied():
    text = "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<b>y<p>z</b>w"
    assert X.visible_text(text) == "a\nb\nc\nd\n12\n3\nxy\nzw"
    root = X.html_tree("<p>one<p>two<div>three</div>four")
    assert [e.tag for e in root.elements()] == ["p", "p", "div"] and [c if isinstance(c, str) else c.tag for c in root.children] == ["p", "p", "div", "four"]
    assert X.html_tree("</p></div>x").text() == "x" and X.html_tree("").text() == ""


@pytest.mark.parametrize("header, sides", [("II SA 1 - Wyrok", ("II SA 1", "Wyrok")), ("- Wyrok", (None, "Wyrok")), (" - Wyrok", (None, "Wyrok")), ("A-1- b - C", ("A-1- b", "C")), ("no separator", None), ("a - b - c", None)])
def test_headers(header, sides):
    if sides is None:
        with pytest.raises(ValueError):
            X.split_header(header)
        page = X.parse_judgment_page(f'<span class="war_header">{header}</span><table><tr class="niezaznaczona"><td class="lista-label">Sąd</td><td class="info-list-value">Y</td></tr></table>')
        assert page["court_name"] == "Y" and page["docket_number"] is None and page["error"]
    else:
        assert X.split_header(header) == sides


def test_roles():
    names = ["A /przewodniczący/", "B /sprawozdawca/", "C"]
    assert X.judge_roles(names) == {"judges": ["A", "B", "C"], "presiding_judge": "A", "judge_rapporteur": "B"}
    assert X.judge_roles(["A /przewodniczący sprawozdawca/", "B"])["presiding_judge"] == "A"
    assert X.judge_roles(["A /przewodniczący/", "B"]) == {"judges": ["A", "B"], "presiding_judge": None, "judge_rapporteur": None}
    assert X.judge_roles([]) == {"judges": [], "presiding_judge": None, "judge_rapporteur": None}


def test_snippets_of_letters_that_change_length():
    assert X.snippets("İİİ and", "and", 2) == ["...İ and"]
    assert X.snippets("AnD band", "and", 0) == ["AnD...", "...and"] and X.snippets(None, "x") == X.snippets("x", "") == []


def test_special_tags_of_broken_documents():
    assert X.special_tags(None) == X.special_tags("<a>") == []
    with pytest.raises(ValueError):
        X.register_parser("judgment_xml", X.with_judgment_xml)


@pytest.mark.parametrize(
    "text, out",
    [("a: 1\nb: [x, 2]\nc:\n- p\n- 'q: r'\n", '{"a":1,"b":["x",2],"c":["p","q: r"]}'), ("```yml\n# only\na: ~\n```", '{"a":null}'), ('{"a": [1]}', '{"a":[1]}'), ("a: \"say 'x'\"", '{"a":"say \'x\'"}'), ("- just\n- items", None), ("text", None), ("", None), (None, None), ("a: b: c", '{"a":"b: c"}')],
)
def test_yaml(spark, text, out):
    assert spark.createDataFrame([(text,)], "t string").select(F.to_json(J.yaml_object(F.col("t")))).first()[0] == out


@pytest.mark.parametrize("text, out", [("2024-05-01T10:00:00Z", "2024-05-01T10:00:00+00:00"), ("2024-05-01 10:00:00+0530", "2024-05-01T10:00:00+05:30"), ("Tue, 5 Mar 2024 10:11:12 GMT", "2024-03-05T10:11:12+00:00"), ("05.03.2024 11:12", "2024-03-05T11:12:00+01:00"), ("20240301", "2024-03-01T00:00:00+01:00"), ("3 May 2024", "2024-05-03T00:00:00+02:00"), ("12/31/2023", "2023-12-31T00:00:00+01:00")])
def test_dates_of_further_forms(spark, text, out):
    assert spark.range(1).select(D.rfc3339(F.lit(text))[0]).first()[0] == out
