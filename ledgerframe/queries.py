"""The registered queries: each applies one operator to the driver's tables (read as reports by the adapter, or as they are)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import periods, text, values
from .operators import blocks, calculations, facts, graph, rdf, texts, walks
from .sources import documents
from .sources.adapter import report_set, varied_networks
from .sources.stored import stored_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
REQUEST = ["tb:NetRevenue", "GrossRevenue", "Assets", "Discounts"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def stored_graph(spark: SparkSession, sf_dir: str) -> graph.GraphTables:
    """The projected graph, written once per application and folder and read as tables."""
    return graph.read_parquet(spark, stored_path(spark, sf_dir, "report-graph", lambda path: graph.write_parquet(graph.project(report_set(spark, sf_dir)), path)))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _two(c: str):
    return (F.round(c, 2) + 0.0).alias(c)  # no negative zero


@query
def fact_grid_consolidated(spark, sf_dir):
    r = report_set(spark, sf_dir)
    hits, _ = facts.resolve_concepts(facts.requested(spark, REQUEST), r.concepts)
    return facts.fact_grid(r.facts, hits, period_type="annual").select("report_id", "concept", "period_id", "unit_id", "numeric_value", "decimals", F.col("rank").cast("long"), "total")


@query
def fact_grid_dimensional(spark, sf_dir):
    r = report_set(spark, sf_dir)
    hits, _ = facts.resolve_concepts(facts.requested(spark, ["GrossRevenue"]), r.concepts)
    return facts.fact_grid(r.facts, hits, axis="segment", member="building", limit=500).select("report_id", "concept", "period_id", "dims_key", "numeric_value", F.col("rank").cast("long"))


@query
def fact_grid_latest_span(spark, sf_dir):
    return facts.latest_grid(report_set(spark, sf_dir).facts).select("report_id", "concept", "end_date", "period_id", "numeric_value")


@query
def dedup_most_precise(spark, sf_dir):
    return facts.most_precise(report_set(spark, sf_dir).facts).select("report_id", "concept", "period_id", "dims_key", "numeric_value", "decimals", "seq")


@query
def dedup_most_precise_lineitem(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").withColumns({"decimals": F.col("l_quantity").cast("string"), "seq": F.struct("l_extendedprice", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")})
    return facts.most_precise(rows, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey")


@query
def content_dedup_documents(spark, sf_dir):
    return facts.content_dedup(_table(spark, sf_dir, "documents"), F.md5(F.encode("text", "UTF-8")), ["doc_id"]).select("doc_id", "source")


@query
def resolve_concepts(spark, sf_dir):
    r = report_set(spark, sf_dir)
    hits, lost = facts.resolve_concepts(facts.requested(spark, [*REQUEST, "us:quantity", "Nothing"]), r.concepts)
    return hits.select("at", "qname").unionByName(lost.select("at", F.concat(F.lit("?"), "name").alias("qname")))


@query
def resolve_ranked(spark, sf_dir):
    r = report_set(spark, sf_dir)
    return facts.rank_concepts(r.concepts, r.facts, "revenue").select("qname", "score", "facts", "rank")


@query
def excluded_reasons(spark, sf_dir):
    r = report_set(spark, sf_dir)
    asked = r.concepts.select("qname", F.lit(0).alias("at"))
    return facts.excluded(r.facts, asked, r.concepts, r.reports, period_type="quarterly")


@query
def describe_counts(spark, sf_dir):
    r = report_set(spark, sf_dir)
    return facts.describe(r.facts, r.concepts)


@query
def axis_census(spark, sf_dir):
    return facts.axis_census(report_set(spark, sf_dir).facts)


@query
def period_census(spark, sf_dir):
    return facts.period_census(report_set(spark, sf_dir).facts, 4)


@query
def period_enrichment(spark, sf_dir):
    days = _table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.to_date("o_orderdate").alias("s"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 400).cast("int")).alias("e"))
    return days.select("o_orderkey", periods.duration_type(F.col("s"), F.col("e")).alias("kind"), periods.calendar_quarter(F.col("s"), F.col("e")).alias("quarter"), periods.calendar_key(F.col("s"), F.col("e")).alias("key"))


@query
def period_literal_roundtrip(spark, sf_dir):
    days = _table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("s"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 400).cast("int")).alias("e"))
    literal = periods.format_interval(F.lit("duration"), F.col("s"), F.col("e"))
    back = days.withColumn("literal", literal).withColumn("p", periods.parse_interval(F.col("literal")))
    return back.select("o_orderkey", "literal", F.col("p.start").alias("start"), F.col("p.end").alias("end"))


@query
def calculation_rollup(spark, sf_dir):
    r = report_set(spark, sf_dir)
    return calculations.rollup(r.facts, r.networks, r.arcs).select("report_id", "network_seq", "parent", "period_id", "unit_id", "reported", _two("computed"), _two("difference"), "missing")


@query
def footing_check(spark, sf_dir):
    r = report_set(spark, sf_dir)
    return calculations.footing(r.facts, r.networks, r.arcs).select("report_id", "network_seq", "parent", "period_id", "foots", (F.col("terms") - F.col("present")).alias("terms_missing"))


@query
def balance_check(spark, sf_dir):
    return calculations.balance(report_set(spark, sf_dir).facts).select("report_id", "period_id", "against", "assets", "counterpart", _two("difference"), "balances")


@query
def duplicate_conflicts(spark, sf_dir):
    return calculations.duplicate_conflicts(report_set(spark, sf_dir).facts).drop("kept_text", "rival_text")


@query
def duplicate_conflicts_text(spark, sf_dir):
    """Line items as text facts: one value per coordinate, or the report contradicts itself."""
    rows = _table(spark, sf_dir, "lineitem").select(F.lit("r").alias("report_id"), F.col("l_orderkey").cast("string").alias("concept"), F.col("l_linenumber").cast("string").alias("period_id"), F.lit(None).cast("string").alias("unit_id"), F.lit("").alias("dims_key"), F.lit("en").alias("language"), F.col("l_partkey").alias("seq"), F.lit(None).cast("double").alias("numeric_value"), F.lit(None).cast("string").alias("decimals"), "l_returnflag")
    # The place among equal part numbers follows the flag, so that seq is a total order of what is compared.
    rows = rows.groupBy("report_id", "concept", "period_id", "unit_id", "dims_key", "language", "seq", "numeric_value", "decimals").agg(F.min("l_returnflag").alias("value_str"))
    return calculations.duplicate_conflicts(rows).select("concept", "period_id", "kept_text", "rival_text")


@query
def graph_content_text_facts(spark, sf_dir):
    """Orders as text facts: equal texts at one coordinate are one fact, unlike ones all stay, whatever the case of their language."""
    rows = _table(spark, sf_dir, "orders").select(
        F.lit("r").alias("report_id"), F.concat(F.lit("tb:c"), F.col("o_custkey").cast("string")).alias("concept"), F.lit("p").alias("period_id"), F.lit(None).cast("string").alias("unit_id"), F.lit("").alias("dims_key"), F.when(F.col("o_orderkey") % 2 == 0, "EN").otherwise("en").alias("language"),
        F.col("o_orderkey").alias("seq"), F.lit(None).cast("double").alias("numeric_value"), F.col("o_orderpriority").alias("value_str"), F.lit("instant").alias("period_type"), F.lit(None).cast("date").alias("start_date"), F.to_date("o_orderdate").alias("end_date"),
    )
    return graph.fact_nodes(rows).select("concept", "seq", "value_str")


@query
def item_captions(spark, sf_dir):
    """Item lists made of order dates, parsed and described."""
    made = _table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("Item %d.%02d, %d.%02d;9.01 Exhibits,", F.month("o_orderdate") % 9 + 1, F.dayofmonth("o_orderdate") % 9, F.lit(2), F.col("o_orderkey") % 4).alias("t"))
    items = made.withColumn("i", text.parse_items(F.col("t")))
    each = items.select("o_orderkey", F.posexplode(text.describe_items(F.col("i"))).alias("place", "x"), text.is_earnings_release(F.col("i")).alias("earnings"))
    return each.select("o_orderkey", F.col("place").cast("long").alias("place"), "x.item", "x.caption", "earnings")


@query
def check_report_verdict(spark, sf_dir):
    r = report_set(spark, sf_dir)
    return calculations.verdict(r.facts, r.concepts, r.networks, r.arcs, r.reports)


@query
def reference_problems(spark, sf_dir):
    f = report_set(spark, sf_dir).facts
    bad = f.withColumns({"concept": F.when(F.col("seq") % 97 == 0, "tb:Unknown").otherwise(F.col("concept")), "unit_id": F.when(F.col("seq") % 89 == 0, "EUR").when(F.col("seq") % 83 == 0, None).otherwise(F.col("unit_id")), "period_id": F.when(F.col("seq") % 79 == 0, "never").otherwise(F.col("period_id"))})
    r = report_set(spark, sf_dir)
    return calculations.reference_problems(bad, r.concepts, f.select("report_id", "period_id"), f.select("report_id", "unit_id"))


@query
def presentation_walk(spark, sf_dir):
    r = report_set(spark, sf_dir)
    return walks.presentation_walk(r.arcs).select("network_seq", F.col("ordinal").cast("long").alias("ordinal"), "depth", "concept", "preferred_label")


@query
def presentation_walk_places(spark, sf_dir):
    """The walk over a tree made of rows: region, nation, customer."""
    nation, customer = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    up = nation.select(F.lit(1).alias("network_seq"), F.col("n_nationkey").cast("long").alias("seq"), name("r", "n_regionkey").alias("from_qname"), name("n", "n_nationkey").alias("to_qname"))
    down = customer.select(F.lit(1), F.col("c_custkey") + 1000, name("n", "c_nationkey"), name("c", "c_custkey"))
    arcs = up.union(down).withColumns({"arc_order": F.lit(None).cast("double"), "preferred_label": F.lit(None).cast("string")})
    return walks.presentation_walk(arcs).select(F.col("ordinal").cast("long").alias("ordinal"), "depth", "concept")


@query
def statement_cells(spark, sf_dir):
    r = report_set(spark, sf_dir)
    return walks.statement_cells(r.facts, walks.presentation_walk(r.arcs)).select("report_id", "network_seq", F.col("ordinal").cast("long").alias("ordinal"), "concept", "period_id", "value", F.col("column").cast("long").alias("column"))


@query
def budgeted_columns(spark, sf_dir):
    return walks.column_budget(report_set(spark, sf_dir).facts).select("report_id", "period_id", "uses", F.col("place").cast("long").alias("place"))


@query
def budgeted_members(spark, sf_dir):
    return walks.member_budget(report_set(spark, sf_dir).facts, 2).select("report_id", "concept", "axis", "member", F.col("place").cast("long").alias("place"))


@query
def roots_except(spark, sf_dir):
    return blocks.roots(varied_networks(spark, sf_dir)[1])


@query
def parse_titles(spark, sf_dir):
    r = report_set(spark, sf_dir)
    return blocks.plan_blocks(r.networks).select("role_uri", "number", "category", "name", "level", "family", "subtitle", F.col("place").cast("long").alias("place"))


@query
def role_folds(spark, sf_dir):
    return blocks.role_folds(varied_networks(spark, sf_dir)[0])


@query
def classify_networks(spark, sf_dir):
    return blocks.classify(*varied_networks(spark, sf_dir))


@query
def disclosure_families(spark, sf_dir):
    return blocks.disclosure_families(blocks.plan_blocks(report_set(spark, sf_dir).networks)).select("family", "category", "blocks", "levels")


@query
def concept_roles(spark, sf_dir):
    r = report_set(spark, sf_dir)
    return blocks.concept_roles(r.networks, r.arcs).select("concept", F.array_join("names", "; ").alias("names"))


@query
def group_tree(spark, sf_dir):
    tree = blocks.group_tree(blocks.plan_blocks(report_set(spark, sf_dir).networks))
    return tree.select("role_uri", "head", F.col("place").cast("long").alias("place"), F.col("member_place").cast("long").alias("member_place"))


@query
def block_footing(spark, sf_dir):
    r = report_set(spark, sf_dir)
    judged = calculations.footing(r.facts, r.networks, r.arcs)
    return blocks.block_footing(judged, walks.column_budget(r.facts)).select("report_id", "network_seq", "foots", "checked", F.size("differences").cast("long").alias("differences"))


@query
def hypercube_members(spark, sf_dir):
    r = report_set(spark, sf_dir)
    return blocks.hypercube_members(r.networks, r.arcs).select("role_uri", "cube", "axis", "member", F.col("place").cast("long").alias("place"))


@query
def fact_membership(spark, sf_dir):
    r = report_set(spark, sf_dir)
    return blocks.fact_membership(r.facts, r.networks, r.arcs, r.concepts)


@query
def graph_nodes_fact(spark, sf_dir):
    return graph.project(report_set(spark, sf_dir)).nodes["Fact"].select("identifier", "uri", "numeric_value", "fact_type", "decimals", "has_dimensions", "dimension_count")


@query
def graph_nodes_period(spark, sf_dir):
    return graph.project(report_set(spark, sf_dir)).nodes["Period"].select("identifier", "start_date", "end_date", "calendar_year", "calendar_quarter", "days_in_period", "period_type", "duration_type", "calendar_period_key")


@query
def graph_nodes_element(spark, sf_dir):
    return graph.project(report_set(spark, sf_dir)).nodes["Element"].select("identifier", "qname", "name", "is_abstract", "is_numeric")


@query
def graph_edges_fact_dimension(spark, sf_dir):
    return graph.project(report_set(spark, sf_dir)).edges["FACT_HAS_DIMENSION"]


@query
def graph_edges_fact_period(spark, sf_dir):
    return graph.project(report_set(spark, sf_dir)).edges["FACT_HAS_PERIOD"]


@query
def graph_counts(spark, sf_dir):
    return graph.project(report_set(spark, sf_dir)).counts()


@query
def graph_merge(spark, sf_dir):
    """Customers stacked as entities, one part per order year: the newest row of each stays."""
    seen = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.max("o_totalprice").alias("v"))
    rows = seen.select(F.concat(F.lit("e"), F.col("k").cast("string")).alias("identifier"), F.format_string("%.2f", "v").alias("name"), F.col("y").alias("filed"))
    whole = rows.select(*[F.col(c) if c in ("identifier", "name") else F.lit(None).cast(t).alias(c) for c, t in graph.node_columns("Entity")], "filed")
    return graph.merge_nodes("Entity", whole, ["filed"])[0].select("identifier", "name")


@query
def csr_indptr(spark, sf_dir):
    g = graph.project(report_set(spark, sf_dir))
    return graph.csr(g.edges["ENTITY_HAS_REPORT"], g.nodes["Entity"], g.nodes["Report"])[1].select("source", "pointer", "degree")


@query
def csr_indices(spark, sf_dir):
    g = graph.project(report_set(spark, sf_dir))
    return graph.csr(g.edges["ENTITY_HAS_REPORT"], g.nodes["Entity"], g.nodes["Report"])[0].select("source", "target")


@query
def graph_pattern_revenue_by_report(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    path = graph.Pattern(g, "Report").out("REPORT_HAS_FACT").where("NOT n1_has_dimensions").out("FACT_HAS_ELEMENT").where("n2_name = 'NetRevenue'")
    return path.select(F.col("n0_accession_number").alias("report_id"), F.col("n1_numeric_value").alias("value"))


@query
def rdf_triples(spark, sf_dir):
    return rdf.triples(report_set(spark, sf_dir)).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query
def rdf_consolidated_facts(spark, sf_dir):
    return rdf.consolidated_facts(rdf.triples(report_set(spark, sf_dir))).withColumn("value", F.col("value").cast("double"))


@query
def shape_violations(spark, sf_dir):
    t = rdf.triples(report_set(spark, sf_dir))
    return rdf.violations(t, rdf.SHAPES).groupBy("shape", "path", "rule").agg(F.count(F.lit(1)).alias("n"))


@query
def oim_facts(spark, sf_dir):
    return documents.oim_facts(report_set(spark, sf_dir).facts).select("report_id", "key", "value", "decimals", "concept", "period", "unit", "dims_key")


@query
def equation_terms(spark, sf_dir):
    r = report_set(spark, sf_dir)
    return documents.equations(r.networks, r.arcs).select("role_uri", "total", "terms")


@query
def events_props_json(spark, sf_dir):
    return documents.shred_json(_table(spark, sf_dir, "events"), "props", "$.k").select("event_id", F.col("value").cast("long").alias("k"))


@query
def search_counts(spark, sf_dir):
    return texts.search_counts(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), r"\b(the|license[d]?)\b").select("id", "hits")


@query
def term_counts(spark, sf_dir):
    return texts.term_counts(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), ["the", "under", "license"])


@query
def section_hits(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return texts.hits_by_section(texts.line_sections(docs), texts.hit_offsets(docs, "the"))


@query
def text_assembly_offsets(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("place"), F.col("role").alias("label"), "text")
    return texts.assembly_offsets(turns).select("id", "place", "start", "chars")


@query
def normalize_whitespace(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(text.normalize_whitespace(F.col("text")), "UTF-8")).alias("digest"))


@query
def squash(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", text.squash(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("squashed"))


@query
def read_page(spark, sf_dir):
    return texts.read_page(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 1000, 400)


@query
def value_precision(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 5 == 0, "INF").when(F.col("l_partkey") % 5 == 1, None).when(F.col("l_partkey") % 5 == 2, "x").otherwise((F.col("l_suppkey") % 7 - 3).cast("string")).alias("d"))
    out = rows.select("l_orderkey", "l_linenumber", F.round(values.tolerance(F.col("d")), 6).alias("tolerance"))
    return out.groupBy("tolerance").agg(F.count(F.lit(1)).alias("n"))


@query
def split_parts(spark, sf_dir):
    return texts.split_parts(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 2000)


@query
def html_to_text(spark, sf_dir):
    return texts.html_to_text(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html"))


@query
def html_tables_md(spark, sf_dir):
    """A page per order: a layout table of one row, and a data table whose currency sign stands in a cell of its own."""
    data = F.concat(F.lit("<table><tr><th>Name</th><th>Amount</th></tr><tr><td>"), "o_orderpriority", F.lit("</td><td>$</td><td>"), F.col("o_orderkey").cast("string"), F.lit("</td></tr></table>"))
    made = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "<table><tr><td>x</td><td>y</td></tr></table><p>z</p>").otherwise(""), data).alias("html"))
    return texts.tables_to_markdown(made)


@query
def xml_records(spark, sf_dir):
    made = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<region><key><value>"), F.col("n_regionkey").cast("string"), F.lit("</value></key><nations>"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<nation><name>"), "n_name", F.lit("</name></nation>")))), ""), F.lit("</nations></region>")).alias("xml"))
    read = documents.xml_records(made.select(F.col("n_regionkey").alias("id"), "xml"))
    each = read.select("id", F.col("fields")["key"].alias("region"), F.inline("tables")).select("id", "region", F.col("name").alias("list"), F.array_join("columns", ",").alias("columns"), F.posexplode("rows").alias("place", "row"))
    return each.select("id", "region", "list", "columns", "place", F.col("row")["name"].alias("name"))


@query
def sgml_documents(spark, sf_dir):
    lines = _table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.concat(F.lit("<SEC-HEADER>\nFORM: 10-K\nFORM: 8-K\n</SEC-HEADER>\n<DOCUMENT>\n<TYPE>10-K\n<FILENAME>a.htm\n<TEXT>\n"), F.regexp_replace("text", "[<>]", " "), F.lit("\n</TEXT>\n</DOCUMENT>\n")).alias("text"))
    return documents.sgml_documents(lines).select("id", "place", "type", "filename", F.length("body").alias("chars"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidated annual figures by concept and year, newest first, most precise duplicate kept."""
    return fact_grid_consolidated(spark, sf_dir)
