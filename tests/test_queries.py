"""A few registered queries against their SQL in DuckDB; the driver compares all of them."""

import pytest

import __spark_entry__ as entry
from ledgerframe.queries_intake import QUERIES as INTAKE

NAMES = [*INTAKE, "sgml_documents", "html_tables_md", "xml_records", "fact_grid_consolidated", "calculation_rollup", "duplicate_conflicts", "presentation_walk", "graph_edges_fact_period", "section_hits", "period_enrichment", "classify_networks", "role_folds", "roots_except", "parse_titles", "disclosure_families", "group_tree", "check_report_verdict", "duplicate_conflicts_text", "graph_content_text_facts", "item_captions", "graph_pattern_revenue_by_report", "graph_counts", "graph_nodes_fact", "rdf_triples", "rdf_consolidated_facts", "shape_violations", "resolve_concepts", "fact_membership", "hypercube_members"]


def cell(v):
    if v is None or v != v:
        return "~"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "part", "documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(cell(r[k]) for k in columns) for r in got.collect()) == sorted(tuple(cell(r[want.columns.index(k)]) for k in columns) for r in want.fetchall())


def test_every_oracle_has_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
