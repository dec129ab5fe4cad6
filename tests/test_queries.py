"""Every registered query against its SQL, and those without SQL for their rows."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from seriatim.plans.registry import ORACLES, QUERIES
from tests.oracle import compare, connection


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    compare(QUERIES[name](spark, sf_dir), ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["subscription_id", "post_id", "progress_text", "progress_pct", "url"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def page_of(title: str) -> str:
    return f"<html><head><title>{title}</title></head><body><nav><a href=/x>n</a></nav><h1>{title}</h1>\n<p>One {title}</p><footer>f</footer></body></html>"


CUT = ["plain", "a &amp; b", "a &&amp", "cut &am", "a &lt b &amp;copy", "x &copy y", "&", "&amp;&amp", "&ampx", "s &quot;t&quot;"]


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    """Pages whose titles end within a reference, as texts do that were escaped first and cut to a length then."""
    folder = str(tmp_path_factory.mktemp("cut"))
    rows = [(i, f"https://h.org/p/{i}", page_of(CUT[i % len(CUT)])) for i in range(12 * len(CUT))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["f50_open_pages", "f59_page_facts", "f61_entity_text", "f64_entity_text"])
def test_cut_references_as_sql(spark, cut_pages, name):
    compare(QUERIES[name](spark, cut_pages[0]), ORACLES[name], cut_pages[1])


def test_many_captures_of_a_site(spark, tmp_path):
    """A site with more pages than an answer of the web archive has rows keeps all of them."""
    rows = [(i, f"text {i} " * (i % 9), "en", "src10") for i in range(1300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    compare(QUERIES["src17_by_site"](spark, str(tmp_path)), ORACLES["src17_by_site"], con)
