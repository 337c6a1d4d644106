"""Rows that the given tables lack, against each query's SQL."""

import duckdb
import pytest

from dwellspark.plans.queries import ORACLES, QUERIES
from dwellspark.sources import elements as E


def both(spark, tmp_path, query, tables, columns):
    """The rows of a query over small tables (name: SQL), and those of its SQL."""
    con = duckdb.connect()
    for name, rows in tables.items():
        con.execute(f"copy ({rows}) to '{tmp_path}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    got = QUERIES[query](spark, str(tmp_path)).select(*columns).collect()
    return sorted(map(tuple, got), key=repr), sorted(con.execute(f"select {', '.join(columns)} from ({ORACLES[query]})").fetchall(), key=repr)


def test_layout_named_twice(spark, tmp_path):
    rows = "select * from (values (669, 6, 'x'), (2845, 30, 'y'), (1, 2, 'z')) v(conv_id, turn, text)"
    got, expected = both(spark, tmp_path, "layout_parse", {"conversations": rows}, ["conv_id", "turn", "removed", "place", "bedrooms", "rent"])
    assert got == expected and len([r for r in got if r[0] == 669]) == 2


def test_cut_reference(spark, tmp_path):
    page = "select 1 as page_id, 'u' as url, '<html><h1>A &amp;amp; b&amp</h1><ul><li><a href=\"x\">c&l</a></li><li><a href=\"y\">d&#39;e &lt</a></li></ul></html>' as html"
    got, expected = both(spark, tmp_path, "page_outline", {"pages": page}, ["page_id", "n_elements", "n_items", "heading", "items"])
    assert got == expected and got[0][3:] == ("A &amp; b&amp", "c&l|d'e &lt")


@pytest.mark.parametrize("closed, text", [(False, "a& b"), (True, "a&amp b")])
def test_references(closed, text):
    rows = E.read_nodes("<!-- <script> --><p>a&amp b</p><script>x && y &amp z</script>", closed)
    assert [r[4] for r in rows if r[2].startswith("#")] == [text, "x && y &amp z"]
