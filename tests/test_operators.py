"""Report operators on small fixtures: the rules that decide whether a number is right."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerframe.operators import blocks, calculations, facts, graph, intake, texts, walks
from ledgerframe.plans import graph_schema
from ledgerframe.sources import adapter, documents

FACT = "report_id string, seq long, concept string, period_id string, period_type string, start_date date, end_date date, unit_id string, dims array<struct<axis:string,member:string>>, dims_key string, dim_count int, numeric_value double, decimals string, language string"
Y = (dt.date(2024, 1, 1), dt.date(2024, 12, 31))


def fact(seq, concept, value, decimals="0", dims=(), unit="USD", period="FY", kind="duration", report="r"):
    return (report, seq, concept, period, kind, Y[0] if kind == "duration" else None, Y[1], unit, [{"axis": a, "member": m} for a, m in dims], "|".join(sorted(f"{a}={m}" for a, m in dims)), len(dims), value, decimals, None)


@pytest.fixture(scope="module")
def book(spark):
    return spark.createDataFrame([
        fact(1, "x:Net", -6.0, "0"), fact(2, "x:Net", -6.4, "1"), fact(3, "x:Net", -6.5, "1"), fact(4, "x:A", 10.0), fact(5, "x:B", 16.0), fact(6, "x:A", 4.0, dims=[("x:Seg", "x:East")]),
        fact(7, "x:A", 3.0, dims=[("x:Seg", "x:East"), ("x:Prod", "x:Tea")]), fact(8, "x:Assets", 100.0, unit=None, kind="instant", period="I"), fact(9, "x:EquityAndLiabilities", 101.0, unit=None, kind="instant", period="I"),
    ], FACT)


def test_most_precise_first_wins_ties(book):
    got = {(r.concept, r.dims_key): r.numeric_value for r in facts.most_precise(book).collect()}
    assert got[("x:Net", "")] == -6.4 and len(got) == 7


def test_axis_and_member_may_match_on_different_dims(book):
    assert [r.seq for r in book.filter(facts.member_filter("prod", "east")).collect()] == [7]
    assert sorted(r.seq for r in book.filter(facts.member_filter(None, "EAST")).collect()) == [6, 7]


def test_period_filter_errors():
    for bad in ({"period_end": "soon"}, {"period_type": "weekly"}):
        with pytest.raises(ValueError):
            facts.period_filter(**bad)


def test_resolution_and_reasons(spark, book):
    concepts = spark.createDataFrame([("x:Net", "Net", False, True, False, False, False), ("y:net", "Other", False, True, False, False, False), ("x:Head", "Head", True, False, False, False, False), ("x:A", "A", False, True, False, False, False), ("x:Assets", "Assets", False, True, False, False, False)], "qname string, label string, is_abstract boolean, is_numeric boolean, is_hypercube_item boolean, is_dimension_item boolean, is_domain_member boolean")
    hits, lost = facts.resolve_concepts(facts.requested(spark, ["NET", "z:A", "x:net", "none", " "]), concepts)
    assert sorted((r.at, r.qname) for r in hits.collect()) == [(0, "x:Net"), (0, "y:net"), (1, "x:A")] and [r.name for r in lost.collect()] == ["none"]
    asked = concepts.select("qname", F.lit(0).alias("at"))
    reports = spark.createDataFrame([("r",)], "report_id string")
    got = {r.concept: r.reason for r in facts.excluded(book, asked, concepts, reports, period_type="annual", axis="prod").collect()}
    assert got == {"x:Net": "no matching member", "y:net": "never tagged", "x:Head": "abstract", "x:Assets": "instants only"}


def nets(spark):
    n = spark.createDataFrame([(1, "role", "calculation", None)], "seq int, role_uri string, kind string, definition string")
    a = spark.createDataFrame([(1, 1, "si", "x:Net", "x:A", 1.0, None, None, None), (1, 2, "si", "x:Net", "x:B", 2.0, -1.0, None, None), (1, 3, "si", "x:Net", "x:C", 3.0, 1.0, None, None)], "network_seq int, seq int, arcrole string, from_qname string, to_qname string, arc_order double, weight double, preferred_label string, target_role string")
    return n, a


def test_rollup_and_footing(spark, book):
    n, a = nets(spark)
    r = calculations.rollup(book, n, a).collect()[0]
    assert (r.reported, r.computed, r.missing, r.present, r.terms) == (-6.4, -6.0, "x:C", 2, 3) and abs(r.difference + 0.4) < 1e-9
    assert [x.foots for x in calculations.footing(book, n, a).collect()] == [False]
    b = calculations.balance(book).collect()[0]  # the units are null on both sides and still meet
    assert (b.difference, b.balances) == (-1.0, False)


def test_conflicts_compare_with_the_best_so_far(spark):
    rows = [fact(1, "x:A", 100.0, "-1"), fact(2, "x:A", 104.0, "0"), fact(3, "x:A", 104.4, "0"), fact(4, "x:A", 99.0, "0"), fact(5, "x:A", 98.0, "0")]
    got = calculations.duplicate_conflicts(spark.createDataFrame(rows, FACT)).collect()
    assert [(r.kept_value, r.rival_value) for r in got] == [(104.0, 99.0)]


def test_walk_lists_a_repeat_and_stops(spark):
    a = spark.createDataFrame([(1, 1, "r", "a", 2.0, None), (1, 2, "r", "b", None, "total"), (1, 3, "b", "r", 1.0, None), (1, 4, "q", "b", 1.0, None), (2, 1, "x", "y", 1.0, None), (2, 2, "y", "x", 1.0, None)], "network_seq int, seq int, from_qname string, to_qname string, arc_order double, preferred_label string")
    got = [(r.network_seq, r.ordinal, r.depth, r.concept) for r in walks.presentation_walk(a).orderBy("network_seq", "ordinal").collect()]
    assert got == [(1, 1, 0, "q"), (1, 2, 1, "b"), (1, 3, 2, "r"), (1, 4, 3, "b"), (1, 5, 3, "a"), (2, 1, 0, "x"), (2, 2, 1, "y"), (2, 3, 2, "x")]
    page = walks.page(walks.presentation_walk(a), 2, 2).filter("network_seq = 1").orderBy("ordinal").collect()
    assert [r.concept for r in page] == ["r", "b"] and list(page[0].ancestors) == ["q", "b"] and page[0].next_offset == 4


def test_budget_is_a_prefix(spark):
    rows = spark.createDataFrame([("g", i, c) for i, c in enumerate([5, 4, 9, 1])], "g string, i int, c int")
    assert [r.i for r in walks.budgeted_prefix(rows, ["g"], [F.col("i")], "c", 10).orderBy("i").collect()] == [0, 1]
    kept = walks.budgeted_prefix(rows, ["g"], [F.col("i")], "c", 1, at_least=1)
    assert [r.i for r in kept.collect()] == [0]
    lost = walks.with_fallback(kept.filter("i > 5").select("g", "i", "c"), rows, ["g"], [F.desc("c")])
    assert [r.i for r in lost.collect()] == [2]


@pytest.mark.parametrize("title,want", [
    ("9955528 - Disclosure - Leases - Maturities (Details)", ("9955528", "Disclosure", "details", "Leases", "Maturities")), ("1 - statement - BALANCE (Parenthetical)", ("1", "Statement", "parenthetical", "BALANCE", None)),
    ("2 - Disclosure - Note 5 - Debt", ("2", "Disclosure", "note", "Note 5 - Debt", None)), ("Anything", (None, None, "other", "Anything", None)),
])
def test_titles(spark, title, want):
    r = spark.createDataFrame([(title,)], "d string").withColumn("t", blocks.parse_title(F.col("d"))).withColumn("l", blocks.parse_level(F.col("t.category"), F.col("t.name"))).collect()[0]
    assert (r.t.number, r.t.category, r.l.level, r.l.family, r.l.subtitle) == want


def test_cubes_invert(spark):
    axes = spark.createDataFrame([("r", "ax1"), ("r", "ax2")], "role_uri string, axis string")
    shown = spark.createDataFrame([("r", "T", "ax1"), ("r", "T", "ax2"), ("r", "T", "item"), ("r", "U", "ax1")], "role_uri string, parent string, child string")
    assert sorted((x.arcrole, x.from_qname, x.to_qname) for x in blocks.cubes_to_arcs(axes, shown).collect()) == [("all", "item", "T"), ("hypercube-dimension", "T", "ax1"), ("hypercube-dimension", "T", "ax2")]


def test_merge_and_csr(spark):
    cols = [c for c, _ in graph.node_columns("Element")]
    rows = spark.createDataFrame([{"identifier": "a", "qname": "q", "is_domain_member": f} for f in (True, False)] + [{"identifier": "b", "qname": q} for q in ("1", "2")], graph_schema.node_schema("Element"))
    merged, conflicts = graph.merge_nodes("Element", rows)
    assert merged.columns == cols and {r.identifier: r.is_domain_member for r in merged.collect()}["a"] is True and [r.identifier for r in conflicts.collect()] == ["b"]
    nodes = spark.createDataFrame([(f"{i:02x}-{i}",) for i in range(0, 256, 5)], "identifier string")
    assert [r.offset for r in graph.offsets(nodes).orderBy("identifier").collect()] == list(range(52))
    edges = spark.createDataFrame([("00-0", "05-5"), ("0a-10", "00-0"), ("00-0", "00-0"), ("00-0", "gone")], "from string, to string")
    indices, indptr, dangling = graph.csr(edges, nodes, nodes)
    assert sorted((r.source, r.target) for r in indices.collect()) == [(0, 0), (0, 1), (2, 0)] and [r.pointer for r in indptr.orderBy("source").collect()][:4] == [0, 2, 2, 3] and dangling.count() == 1


def test_projection_has_no_dangling_edges(spark, sf):
    g = graph.project(adapter.report_set(spark, sf))
    for name in ("FACT_HAS_DIMENSION", "ASSOCIATION_HAS_TO_ELEMENT", "ENTITY_HAS_REPORT"):
        a, b, _ = graph_schema.EDGES[name]
        e = g.edges[name]
        assert e.join(g.nodes[a], e["from"] == g.nodes[a].identifier, "left_anti").count() == 0 and e.join(g.nodes[b], e["to"] == g.nodes[b].identifier, "left_anti").count() == 0
    assert len(graph_schema.ddl()) == 36
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO t SELECT 1", "WITH a AS (SELECT 1) DELETE FROM t", "CREATE TABLE t AS SELECT 1", "FROM t INSERT INTO a SELECT 1 INSERT INTO b SELECT 2", "SET x = 1", "MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN DELETE"):
        with pytest.raises(ValueError):
            graph.check_query(bad)
    for good in ("SELECT 'drop table' AS x -- delete", "SELECT replace(name, 'a', 'b') FROM Entity", "WITH a AS (SELECT 1 AS x) SELECT * FROM a WHERE x IN (SELECT 2)", "SHOW TABLES", "SELECT 1;"):
        graph.check_query(good)
    with pytest.raises(ValueError):
        graph.Pattern(g, "Fact").out("ENTITY_HAS_REPORT")


def test_exchange_document_round_trip(spark, book):
    back = documents.read_oim(documents.oim_document(book))
    assert sorted((r.concept, r.numeric_value, r.dims_key, r.end_date) for r in back.collect()) == sorted((r.concept, r.numeric_value, r.dims_key, r.end_date) for r in book.collect())


def test_texts():
    for t in ("", "word " * 999, "para one.\n\npara two. " * 300, "x" * 5000, "One. Two! Three? " * 400):
        parts = texts.parts_of(t, 700)
        assert "".join("".join(parts).split()) == "".join(t.split())  # only white space at cuts is lost
        assert len(parts) == max(1, -(-len(t) // 700)) and all(len(p) <= 700 * 1.5 for p in parts)
    assert texts.parts_of("a\n\nb" * 10, 1000) == ["a\n\nb" * 10] and texts.parts_of("x" * 90 + "\n \n" + "y" * 90, 100) == ["x" * 90, "y" * 90]
    assert texts.plain_text("<p>a&amp;b</p><script>x</script><table><tr><td>1</td><td>2</td></tr></table>").split() == ["a&b", "1", "2"]
    md = texts.tables_markdown("<table><tr><th>Name</th><th>Amount</th></tr><tr><td>A|b</td><td>$</td><td>5</td></tr><tr><td>C</td><td>(</td><td>6</td><td>)</td></tr></table>")
    assert md == ["| Name | Amount |\n| --- | --- |\n| A\\|b | $5 |\n| C | (6) |"]
    assert texts.tables_markdown("<table><tr><td>layout only</td></tr></table>") == []
    html = '<ix:nonNumeric name="x:Note" id="a" continuedAt="b"><p>one <ix:exclude>page 3</ix:exclude></p></ix:nonNumeric><hr><ix:continuation id="b"><p>two</p></ix:continuation>'
    assert [(n, t.split()) for n, t in texts.inline_blocks(html)] == [("x:Note", ["one", "two"])]
    body = "Item 1. Business ........ 3\nItem 1A. Risk Factors 9\n" + "Item 1. Business\n" + "We sell things. " * 20 + "\nItem 1A. Risk Factors\n" + "Risky. " * 20
    assert [(i, body[a : a + 7]) for i, a, _ in texts.item_sections(body)] == [("1", "Item 1."), ("1A", "Item 1A")]


def test_documents(spark):
    fields, tables = documents.xml_parts("<doc a='1'><head><value>x</value></head><holders><holder><n>A</n><n2>1</n2></holder><holder><n>B</n></holder></holders><itemTable><item><k>1</k></item></itemTable></doc>")
    assert fields == {"head": "x"} and [(t["name"], t["columns"], len(t["rows"])) for t in tables] == [("holders", ["n", "n2"], 2), ("itemTable", ["k"], 1)]
    assert documents.xml_parts("not xml") == ({}, [])
    sub = "<SEC-HEADER>\nFORM TYPE:\t10-K\nFORM TYPE: 8-K\n</SEC-HEADER>\n<DOCUMENT>\n<TYPE>10-K\n<SEQUENCE>1\n<FILENAME>a.htm\n<TEXT>\nbody\n<PAGE>\nmore\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>GRAPHIC\n<TEXT>\nbegin 644 x.jpg\nM\n</TEXT>\n</DOCUMENT>"
    d = spark.createDataFrame([(1, sub)], "id long, text string")
    got = documents.sgml_documents(d).orderBy("place").collect()
    assert [(r.place, r.type, r.filename, r.is_encoded) for r in got] == [(1, "10-K", "a.htm", False), (2, "GRAPHIC", None, True)] and got[0].body.split() == ["body", "more"]
    assert [(r.key, r.value) for r in documents.sgml_header(d).collect()] == [("FORM TYPE", "10-K")]
    j = '{"cik": "1", "filings": {"recent": {"accessionNumber": ["a", "b"], "form": ["10-K", "8-K"], "filingDate": ["2024-01-01", "2024-02-01"], "reportDate": ["", ""], "primaryDocument": ["x", "y"]}}}'
    assert [(r.accession, r.form) for r in documents.submissions(spark.createDataFrame([(j,)], "json string")).collect()] == [("b", "8-K"), ("a", "10-K")]
    assert documents.quarters("2024-02-10", "2024-08-01") == [("2024-02-10", "2024-03-31"), ("2024-04-01", "2024-06-30"), ("2024-07-01", "2024-08-01")]
    page = "<table><tr><th>Seq</th></tr><tr><td>1</td><td>10-K</td><td><a href='/a.htm'>a.htm</a> iXBRL</td><td>10-K</td><td>100</td></tr><tr><td>2</td><td>form</td><td>f.html</td><td>4</td><td>5</td></tr><tr><td>2</td><td>form</td><td>f.xml</td><td>4</td><td>5</td></tr></table>"
    index = documents.filing_index(spark.createDataFrame([(1, page)], "id long, html string"))
    assert [r.document for r in documents.other_documents(index, "a.htm").collect()] == ["f.xml"]


def test_intake(spark):
    concepts = spark.createDataFrame([("x:A", True, "duration"), ("x:T", False, "duration")], "qname string, is_numeric boolean, period_type string")
    contexts = spark.createDataFrame([("r", "c1", "2024-01-01", "2025-01-01T00:00:00", None)], "report_id string, context string, start string, end string, instant string")
    p = intake.contexts_to_periods(contexts)
    assert [(r.period_type, r.start_date, r.end_date) for r in p.collect()] == [("duration", dt.date(2024, 1, 1), dt.date(2024, 12, 31))]
    raw = spark.createDataFrame([("r", 1, "x:A", "c1", "u", "5"), ("r", 2, "x:A", "c9", "u", "6"), ("r", 3, "x:Z", "c1", None, "t"), ("r", 4, "x:T", "c9", None, "t")], "report_id string, seq long, concept string, context string, unit string, value string")
    units = spark.createDataFrame([("r", "u", "USD")], "report_id string, unit string, measure string")
    good, dropped = intake.assemble_facts(raw, p, units, concepts)
    assert [(r.seq, r.numeric_value) for r in good.collect()] == [(1, 5.0)]
    assert sorted((r.reason, r.context, r.n, list(r.concepts)) for r in intake.drop_ledger(dropped).collect()) == [("undeclared_concept", "c1", 1, ["x:Z"]), ("undeclared_context", "c9", 2, ["x:A", "x:T"])]
    stated = spark.createDataFrame([("r", "c9", "start", dt.date(2024, 1, 1)), ("r", "c9", "end", dt.date(2024, 3, 31))], "report_id string, context string, what string, day date")
    assert [r.context for r in intake.recover_contexts(dropped, stated, concepts).collect()] == ["c9"]
    rows = spark.createDataFrame([("r", 1, "x:A", "2024-01-01", "2024-12-31", "USD", "5", "0"), ("r", 2, "x:A", None, "bad", None, "five", "0"), ("r", 3, "x:Q", "2024-01-01", "2024-12-31", None, "t", None)], "report_id string, seq long, concept string, start string, end string, unit string, value string, decimals string")
    ok, bad = intake.author(rows, concepts)
    assert [r.seq for r in ok.collect()] == [1] and {r.seq: r.faults for r in bad.collect()} == {2: "no end date; no start date; not a number; no unit", 3: "unknown concept"}


@pytest.mark.parametrize("definition,role,root,want", [
    ("Statements of Comprehensive Income", "x", None, "income_statement"), ("CONSOLIDATED INCOME", "x", None, "income_statement"), ("Cash Flows", "x", None, "cash_flow_statement"), ("Consolidated Statements of Financial Position", "x", None, "balance_sheet"),
    ("Statement of Stockholders\u2019 Equity", "x", None, "equity_statement"), ("Balance Sheets (Parenthetical)", "http://a/BalanceSheet", "us-gaap:StatementOfFinancialPositionAbstract", None), (None, "http://a/role/StatementOfCashFlows", None, "cash_flow_statement"),
    (None, "http://a/BalanceSheet-Parenthetical", "a:BalanceSheetAbstract", None), ("03 - Rapport", "http://c/roles/Rapport", "ifrs-full:StatementOfFinancialPositionAbstract", "balance_sheet"), ("opaque", "x", "us-gaap:CreditLossAbstract", None), ("opaque", "x", None, None),
    ("Consolidated Statements of Cash Flows", "x", "us-gaap:IncomeStatementAbstract", "cash_flow_statement"),
])
def test_statement_kinds(spark, definition, role, root, want):
    df = spark.createDataFrame([(definition, role, root)], "d string, r string, q string")
    assert df.select(blocks.statement_kind(F.col("d"), F.col("r"), F.col("q"))).first()[0] == want


def test_text_facts_are_kept_apart_and_may_conflict(spark):
    row = lambda seq, value, language="en", nil=False: ("r", seq, "x:T", "FY", "duration", *Y, None, [], "", 0, None, None, language, value, nil)
    rows = spark.createDataFrame([row(1, "one"), row(2, "two"), row(3, "one", "EN"), row(4, None, nil=True), row(5, "", nil=True)], FACT + ", value_str string, is_nil boolean")
    assert sorted(r.seq for r in graph.fact_nodes(rows).collect()) == [1, 2, 4]
    clash = calculations.duplicate_conflicts(rows.filter("seq < 4")).collect()
    assert [(r.kept_text, r.rival_text) for r in clash] == [("one", "two")]
    assert calculations.duplicate_conflicts(rows.filter("seq IN (1, 3)")).count() == 0


def test_verdict_counts_every_unsound_fact(spark):
    n, a = nets(spark)
    concepts = spark.createDataFrame([("x:A", True), ("x:T", False)], "qname string, is_numeric boolean")
    reports = spark.createDataFrame([("r",), ("s",)], "report_id string")
    rows = spark.createDataFrame([fact(1, "x:A", 1.0), fact(2, "x:A", None, period="Q"), fact(3, "x:A", 2.0, unit=None), fact(4, "x:Z", 2.0), fact(5, "x:A", 1.0, report="s")], FACT)
    got = {r.report_id: (r.unsound, r.ok) for r in calculations.verdict(rows, concepts, n, a, reports).collect()}
    assert got == {"r": (3, False), "s": (0, True)}
    none = calculations.verdict(rows, concepts, n, a, reports, periods=spark.createDataFrame([("s", "FY")], "report_id string, period_id string"))
    assert {r.report_id: r.unsound for r in none.collect()} == {"r": 4, "s": 0}


def test_networks_of_two_reports_stay_apart(spark, tmp_path):
    """Saved models number their networks from 0: walks, roll-ups, kinds, sections, cubes and membership go by report as well."""
    import json

    def model(report, total, part, value, title):
        arc = lambda a, b, role, **more: {"from_qname": a, "to_qname": b, "arcrole": role, **more}
        fact = lambda c, v, dims=(): {"id": c, "concept_qname": c, "period_id": "FY", "unit_id": "USD", "value_str": str(v), "numeric_value": v, "decimals": "0", "dims": [{"axis_qname": a, "member_qname": m} for a, m in dims]}
        return {"filing": {"accession": report}, "concepts": {c: {"is_numeric": True} for c in (total, part)}, "facts": [fact(total, 10.0), fact(part, value), fact(part, 1.0, [("x:Axis", f"x:{report}")])], "networks": [
            {"role_uri": "r/one", "kind": "presentation", "definition": title, "arcs": [arc(f"x:{report}Root", total, "parent-child", order=1.0), arc(f"x:{report}Root", part, "parent-child", order=2.0)]},
            {"role_uri": "r/one", "kind": "calculation", "definition": title, "arcs": [arc(total, part, "summation-item", weight=2.0)]},
            {"role_uri": "r/one", "kind": "definition", "definition": title, "arcs": [arc(part, "x:Cube", "all"), arc("x:Cube", "x:Axis", "hypercube-dimension"), arc("x:Axis", f"x:{report}Domain", "dimension-domain"), arc(f"x:{report}Domain", f"x:{report}", "domain-member")]},
        ]}

    for name, made in (("a", model("a", "x:T", "x:P", 5.0, "Balance Sheets")), ("b", model("b", "x:T", "x:Q", 4.0, "Cash Flows"))):
        (tmp_path / f"{name}.json").write_text(json.dumps(made))
    m = documents.read_models(spark, str(tmp_path))
    walk = [(r.report_id, r.network_seq, r.ordinal, r.concept) for r in walks.presentation_walk(m["arcs"].filter("network_seq = 0")).orderBy("report_id", "ordinal").collect()]
    assert walk == [("a", 0, 1, "x:aRoot"), ("a", 0, 2, "x:T"), ("a", 0, 3, "x:P"), ("b", 0, 1, "x:bRoot"), ("b", 0, 2, "x:T"), ("b", 0, 3, "x:Q")]
    feet = {r.report_id: (r.computed, r.foots, r.terms) for r in calculations.footing(m["facts"], m["networks"], m["arcs"]).collect()}
    assert feet == {"a": (10.0, True, 1), "b": (8.0, False, 1)}
    assert {(r.report_id, r.statement) for r in blocks.classify(m["networks"], m["arcs"]).collect()} == {("a", "balance_sheet"), ("b", "cash_flow_statement")}
    assert sorted((r.report_id, r.role_uri, r.place, r.definition) for r in blocks.plan_blocks(m["networks"]).collect()) == [("a", "r/one", 1, "Balance Sheets"), ("b", "r/one", 1, "Cash Flows")]
    assert sorted((r.report_id, r.member) for r in blocks.hypercube_members(m["networks"], m["arcs"]).collect()) == [("a", "x:a"), ("b", "x:b")]
    concepts = m["concepts"].withColumn("is_domain_member", F.lit(False))
    facts_ = m["facts"].withColumn("dims", F.transform("dims", lambda d: F.struct(d["axis_qname"].alias("axis"), d["member_qname"].alias("member"))))
    assert sorted((r.report_id, r.seq) for r in blocks.fact_membership(facts_, m["networks"], m["arcs"], concepts).collect()) == [(x, i) for x in "ab" for i in range(3)]
    bad = {r.report_id: r.unsound for r in calculations.verdict(m["facts"], m["concepts"], m["networks"], m["arcs"], m["reports"].select("report_id")).collect()}
    assert bad == {"a": 0, "b": 0}
