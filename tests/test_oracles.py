"""Every registered query that SQL can state agrees with DuckDB on the smallest tables."""

import pytest

from compare import compare
from spanwright import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    assert not compare(spark, SF, registry.QUERIES[name], registry.ORACLES[name])


#: What SQL cannot state is held against plain versions in test_operators.py; here its rows are checked for what must hold.
HOLDS = {
    "a17_worksheet": lambda rows: True,
    "a19_html_parse": lambda rows: all(r.n_links >= 0 and r.article == " ".join(r.article.split()) for r in rows),
    "f8_recursive_chunks": lambda rows: all(r.char_start < r.char_end for r in rows) and len({(r.doc_id, r.seq) for r in rows}) == len(rows),
    "f11_structure_chunks": lambda rows: all(r.char_start < r.char_end for r in rows) and len({(r.doc_id, r.char_start) for r in rows}) == len(rows),
    "k13_mixed_model": lambda rows: len(rows) == 1 and rows[0].sigma2 > 0 and rows[0].slope_se > 0,
}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_holds(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert rows and HOLDS[name](rows)


def test_oracles_have_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert registry.FLAGSHIP in registry.QUERIES
