from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same  # noqa: E402

from mailquarry.plans import every, table_queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(every.SQL))
def test_query_matches_sql(spark, tiny, name):
    same(table_queries.QUERIES[name](spark, tiny), table_queries.SQL[name], tiny)


@pytest.mark.parametrize("name", sorted(set(every.QUERIES) - set(every.SQL)))
def test_query_without_sql_runs(spark, tiny, name):
    assert table_queries.QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


#: As the query's SQL, but over all words of a text.
ALL_WORDS = """
WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS label FROM documents),
n AS (SELECT * FROM (VALUES ('Supplier', 'supplier'), ('Thing', 'thandthe'), ('Notion', 'nottion'), ('Rather', 'erther')) AS v(brand, token))
SELECT label, brand, levenshtein(label, token) AS distance FROM w, n WHERE levenshtein(label, token) BETWEEN 1 AND 3
"""


def test_edit_distance_takes_every_word(spark, tiny, tmp_path):
    assert same(table_queries.edit_distance_names(spark, tiny), ALL_WORDS, tiny) > 500
    texts = [("The SUPLIER sent 2 suppliers'supplie", 1), (None, 2), ("", 3), ("12 ?!", 4), ("zzzzzzzzzz " * 5000 + "suppller", 5), ("supplier", 6)]
    spark.createDataFrame(texts, "text string, doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.label, r.distance) for r in table_queries.edit_distance_names(spark, str(tmp_path)).where("brand = 'Supplier'").collect()]
    assert sorted(got) == [("suplier", 1), ("supplie", 1), ("suppliers", 1), ("suppller", 1)]


#: Words with other letters at their sides or among them, and blanks that not all engines call blanks.
ODD_WORDS = ["évirement", "virementé", " überweisung", "aüberweisung", "CONTRASEÑA", "contraſeña", "\u212aontonummer", "payKment", "pay", "Pıncode", "https://\x0bx", "a httpſ://b", "n\u0301pay", "payment of NÚMERO de cuenta", "", None, "bonificſ x", "bonific\u212a", "pago ñpago"]


def odd_words(spark, folder):
    spark.createDataFrame([(k, 4, "user", t) for k, t in enumerate(ODD_WORDS)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{folder}/all/conversations")
    spark.createDataFrame([(k, t) for k, t in enumerate(ODD_WORDS)], "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/all/documents")
    for name in ("conversations", "documents"):
        next((folder / "all" / name).glob("*.parquet")).rename(folder / f"{name}.parquet")
    return str(folder)


def test_action_scores_of_odd_words(spark, tmp_path):
    assert same(table_queries.QUERIES["action_scores"](spark, odd_words(spark, tmp_path)), table_queries.SQL["action_scores"], str(tmp_path)) == len(ODD_WORDS)


def test_section_risks_of_odd_words(spark, tmp_path):
    assert same(table_queries.QUERIES["section_risks"](spark, odd_words(spark, tmp_path)), table_queries.SQL["section_risks"], str(tmp_path)) == len(ODD_WORDS)


def test_evidence_words_of_odd_words(spark, tmp_path):
    assert same(table_queries.QUERIES["evidence_words"](spark, odd_words(spark, tmp_path)), table_queries.SQL["evidence_words"], str(tmp_path)) == len(ODD_WORDS)


def test_page_text_letters_of_odd_references(spark, tmp_path):
    pages = ["<h1>a &amp&amp; b &amp</h1><p>c &ampx &AMP; d &eacute; &lt;b&gt; &#39; &#38; &amp;lt; e & f</p>", '<p>x<img src="a" alt="p &amp&amp; q"> y &nbsp;</p>', "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/all")
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    assert same(table_queries.QUERIES["page_text_letters"](spark, str(tmp_path)), table_queries.SQL["page_text_letters"], str(tmp_path)) == 4
