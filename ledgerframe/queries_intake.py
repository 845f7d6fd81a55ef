"""Registered queries of intake, readers, listings and small functions: their inputs are made of the driver's tables, row by row, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, periods, text
from .operators import blocks, exports, facts, intake, rdf, texts, walks
from .sources import documents
from .sources.adapter import report_set, varied_networks

ARCROLES = (*intake.PRESENTATION, *intake.CALCULATION, *intake.SKIPPED, "http://xbrl.org/int/dim/arcrole/all")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as (k, c, day, m, s, p): key, customer, date as text, month, status, priority."""
    day = F.to_date("o_orderdate")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.date_format(day, "yyyy-MM-dd").alias("day"), F.month(day).alias("m"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))


def _text(c: str):
    return F.col(c).cast("string")


def _later(days):
    """The date column `day` moved by days, as text."""
    return F.date_format(F.date_add(F.to_date("day"), days), "yyyy-MM-dd")


def network_kinds(spark, sf_dir):
    role = F.element_at(F.array(*[F.lit(x) for x in ARCROLES]), (F.col("p_partkey") % len(ARCROLES) + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", intake.network_kind(role).alias("kind"))


def context_periods(spark, sf_dir):
    """Contexts of every shape: bare dates, midnights, instants, durations, forever."""
    form = F.col("k") % 5
    start = F.when(form.isin(2, 3), F.col("day"))
    end = F.when(form == 2, _later(90)).when(form == 3, F.concat(_later(90), F.lit("T00:00:00")))
    instant = F.when(form == 0, F.col("day")).when(form == 1, F.concat("day", F.lit("T00:00:00")))
    made = _orders(spark, sf_dir).select(F.lit("r").alias("report_id"), _text("k").alias("context"), start.alias("start"), end.alias("end"), instant.alias("instant"))
    return intake.contexts_to_periods(made)


def _raw(spark, sf_dir):
    """(facts, dropped) of orders as raw facts: July contexts and one priority are not declared, only USD is a known unit."""
    o = _orders(spark, sf_dir)
    raw = o.select(
        F.concat(F.lit("r"), F.col("c") % 10).alias("report_id"), F.col("k").alias("seq"), F.concat(F.lit("tb:"), "p").alias("concept"), F.concat(F.lit("c"), "m").alias("context"),
        F.when(F.col("k") % 3 == 1, "USD").when(F.col("k") % 3 == 2, "EUR").alias("unit"), F.when(F.col("k") % 11 == 0, "n/a").otherwise(F.concat(_text("c"), F.lit(".5"))).alias("value"),
    )
    contexts = raw.select("report_id", "context").distinct().filter("context <> 'c7'")
    units = raw.select("report_id").distinct().select("report_id", F.lit("USD").alias("unit"), F.lit("iso4217:USD").alias("measure"))
    concepts = raw.select(F.col("concept").alias("qname")).distinct().filter("qname <> 'tb:5-LOW'")
    return intake.assemble_facts(raw, contexts, units, concepts)


def assembled_facts(spark, sf_dir):
    return _raw(spark, sf_dir)[0].select("report_id", "seq", "concept", "context", "measure", "numeric_value")


def dropped_facts(spark, sf_dir):
    return _raw(spark, sf_dir)[1]


def drop_ledger(spark, sf_dir):
    return intake.drop_ledger(_raw(spark, sf_dir)[1]).withColumn("concepts", F.array_join("concepts", ";"))


def recovered_contexts(spark, sf_dir):
    """A context per customer; a fifth of the orders state a start or an end under it."""
    o, c = _orders(spark, sf_dir), _table(spark, sf_dir, "customer")
    stated = o.filter("k % 5 = 0").select(F.lit("r").alias("report_id"), F.concat(F.lit("x"), _text("c")).alias("context"), F.when(F.col("k") % 2 == 0, "start").otherwise("end").alias("what"), F.to_date("day").alias("day"))
    dropped = c.select(F.lit("r").alias("report_id"), F.concat(F.lit("x"), _text("c_custkey")).alias("context"), F.col("c_mktsegment").alias("concept"), F.lit("undeclared_context").alias("reason"))
    known = c.select(F.col("c_mktsegment").alias("qname")).distinct().filter("qname <> 'MACHINERY'").withColumn("period_type", F.when(F.col("qname") == "FURNITURE", "instant").otherwise("duration"))
    return intake.recover_contexts(dropped, stated, known)


def cover_pages(spark, sf_dir):
    made = _orders(spark, sf_dir).select(F.concat(F.lit("c"), _text("c")).alias("report_id"), F.when(F.col("k") % 2 == 0, "dei:EntityRegistrantName").otherwise("dei:DocumentType").alias("concept"), (F.col("k") % 3).alias("dim_count"), F.col("k").alias("seq"), F.concat("s", _text("k")).alias("value_str"))
    return intake.cover_fields(made, ["EntityRegistrantName", "DocumentType"])


def filled_fields(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"))
    other = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.concat(F.lit("F"), _text("c_custkey")).alias("name"))
    return intake.fill_empty(rows, other, "key", ["name"])


def identity_codecs(spark, sf_dir):
    k = F.col("k")
    cik = F.when(k % 4 == 0, F.lpad(_text("k"), 12, "0")).when(k % 4 == 1, F.concat(F.lit(" "), _text("k"), F.lit(" "))).when(k % 4 == 2, F.concat(F.lit("X"), _text("k"))).otherwise((k * 1000000007).cast("string"))
    return _orders(spark, sf_dir).select("k", ids.normalize_cik(cik).alias("cik"), intake.tax_id(F.concat(F.lit("12-"), _text("k"), F.lit(" 9"))).alias("ein"), ids.md5_slug(_text("k")).alias("slug"), ids.sha_id(_text("k")).alias("sha"))


def prefix_bindings(spark, sf_dir):
    """Half of the reports bind a prefix to one namespace, the others perhaps to two."""
    made = _orders(spark, sf_dir).select(F.concat(F.lit("r"), F.col("c") % 100).alias("report_id"), F.col("s").alias("prefix"), F.concat(F.lit("ns"), F.when(F.col("c") % 100 < 50, F.lit(1)).otherwise(F.col("k") % 2)).alias("namespace"))
    return intake.prefix_bindings(made)


def _authored(spark, sf_dir):
    k = F.col("k")
    rows = _orders(spark, sf_dir).select(
        F.lit("r").alias("report_id"), k.alias("seq"), F.element_at(F.array(*[F.lit(x) for x in ("a:Sales", "a:Cash", "a:Note", "a:None")]), (k % 4 + 1).cast("int")).alias("concept"), F.when(k % 5 != 0, F.col("day")).alias("start"),
        F.when(k % 7 == 0, "bad").when(k % 11 == 0, None).otherwise(_later((k % 13 - 1).cast("int"))).alias("end"), F.when(k % 3 != 0, "USD").alias("unit"), F.when(k % 17 == 0, None).when(k % 19 == 0, "x").otherwise(_text("c")).alias("value"), F.lit("0").alias("decimals"),
    )
    known = spark.sql("SELECT * FROM VALUES ('a:Sales', true, 'duration'), ('a:Cash', true, 'instant'), ('a:Note', false, 'duration') AS v(qname, is_numeric, period_type)")
    return intake.author(rows, known)


def authored_facts(spark, sf_dir):
    return _authored(spark, sf_dir)[0]


def authored_faults(spark, sf_dir):
    return _authored(spark, sf_dir)[1]


def newest_reports(spark, sf_dir):
    made = _orders(spark, sf_dir).select(F.col("c").alias("entity"), F.concat(F.lit("o"), _text("k")).alias("report_id"), F.when(F.col("k") % 9 != 0, F.col("day")).alias("filing_date"), F.col("day").alias("report_date"))
    return intake.newest_report(made)


def _document_facts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.col("source").alias("report_id"), F.concat(F.lit("k"), F.col("doc_id") % 40).alias("concept"), F.col("lang").alias("language"), F.col("doc_id").alias("seq"))


def default_language(spark, sf_dir):
    return facts.default_language(_document_facts(spark, sf_dir))


def text_concepts(spark, sf_dir):
    return facts.text_concepts(_document_facts(spark, sf_dir).withColumn("language", F.when(F.col("language") != "en", F.col("language"))))


def undefined_facts(spark, sf_dir):
    made = _orders(spark, sf_dir).select(F.concat(F.lit("p"), F.col("c") % 5, F.lit(":"), "p").alias("concept"))
    return documents.undefined_facts(made, made.select(F.col("concept").alias("qname")).distinct().filter("qname LIKE '%URGENT' OR qname LIKE 'p3%'"))


def gap_report(spark, sf_dir):
    r = report_set(spark, sf_dir)
    return documents.gap_report(r.concepts, r.facts)


def _lists(o: DataFrame, *by: str) -> DataFrame:
    """Orders as submission lists: parallel arrays in the order of keys."""
    row = F.struct("k", F.concat(F.lit("a-"), _text("k")).alias("accessionNumber"), F.col("p").alias("form"), F.col("day").alias("filingDate"), F.col("day").alias("reportDate"), F.concat("s", F.lit(".htm")).alias("primaryDocument"))
    rows = o.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select(*by, F.struct(*[F.col(f"rows.{c}").alias(c) for c in documents.SUBMISSION]).alias("recent"))


def submissions_list(spark, sf_dir):
    """A list per customer: nested for even ones, flat for odd ones."""
    lists = _lists(_orders(spark, sf_dir), "c").withColumn("cik", _text("c"))
    nested = lists.filter("c % 2 = 0").select(F.to_json(F.struct("cik", F.struct("recent").alias("filings"))).alias("json"))
    return documents.submissions(nested.unionByName(lists.filter("c % 2 = 1").select(F.to_json(F.struct("cik", "recent.*")).alias("json"))))


def submissions_merged(spark, sf_dir):
    """The list holds the later years, a page the earlier ones and, under other forms, some of the list's own."""
    o = _orders(spark, sf_dir)
    lists = _lists(o.filter("day >= '1998-01-01'"), "c").select(F.to_json(F.struct(_text("c").alias("cik"), F.struct("recent").alias("filings"))).alias("json"))
    early = o.filter("day < '1998-01-01'").unionByName(o.filter("day >= '1998-01-01' AND k % 4 = 0").withColumn("p", F.lit("again")))
    return documents.all_submissions(lists, _lists(early, "c").select(_text("c").alias("cik"), F.to_json("recent").alias("json")))


def company_headers(spark, sf_dir):
    k = F.col("c_custkey")
    made = _table(spark, sf_dir, "customer").select(F.to_json(F.struct(
        _text("c_custkey").alias("cik"), F.col("c_name").alias("name"), F.when(k % 3 == 0, "").when(k % 3 == 1, "12").alias("ein"), F.when(k % 2 == 0, F.array(F.lower("c_name"), F.lit("other"))).otherwise(F.array().cast("array<string>")).alias("tickers"),
        F.col("c_mktsegment").alias("sic"), F.when(k % 5 == 0, "").when(k % 5 == 1, "www").alias("website"), F.when(k % 7 == 0, "inv").alias("investorWebsite"),
    )).alias("json"))
    return documents.company_info(made).select("cik", "name", "ein", "ticker", "exchange", "sic", "entity_type", "website", "phone")


def tickers_to_cik(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    return documents.ticker_to_cik(c.filter("c_custkey % 3 <> 0").select(F.lower("c_name").alias("ticker"), F.col("c_custkey").alias("cik")), c.select(F.concat(F.lit(" "), "c_name").alias("ticker")))


def api_filings(spark, sf_dir):
    """Twenty pages of filings joined to their included entities."""
    o = _orders(spark, sf_dir)
    row = F.struct(_text("k").alias("id"), F.struct(F.col("day").alias("period_end"), _later((F.col("k") % 5).cast("int")).alias("processed")).alias("attributes"), F.struct(F.struct(F.struct(_text("c").alias("id")).alias("data")).alias("entity")).alias("relationships"))
    firm = F.struct(_text("c").alias("id"), F.struct(F.concat(F.lit("Firm "), _text("c")).alias("name")).alias("attributes"))
    pages = o.groupBy(F.col("c") % 20).agg(F.collect_list(row).alias("data"), F.collect_set(firm).alias("included")).select(F.to_json(F.struct("data", "included")).alias("json"))
    return documents.api_filings(pages, "1998-01-01").select("id", "entity", "period_end", "processed", "latest")


def search_pages(spark, sf_dir):
    o = _orders(spark, sf_dir)
    source = F.struct(F.array(_text("c"), F.lit("0")).alias("ciks"), F.array(F.concat(F.lit("Firm "), _text("c"))).alias("display_names"), F.col("p").alias("form"), F.col("day").alias("file_date"))
    hit = F.struct(F.concat(F.lit("a-"), _text("k"), F.lit(":doc.htm")).alias("_id"), source.alias("_source"))
    pages = o.groupBy(F.col("c") % 20).agg(F.collect_list(hit).alias("hits"), F.count(F.lit(1)).alias("value"))
    return documents.search_hits(pages.select(F.to_json(F.struct(F.struct(F.struct("value").alias("total"), "hits").alias("hits"))).alias("json")))


def filing_index(spark, sf_dir):
    """An index page per customer: header, document rows, rows without number and short rows."""
    cell = lambda *x: F.concat(F.lit("<td>"), *x, F.lit("</td>"))
    link = F.concat(F.lit('<a href="/x/'), _text("k"), F.lit('.htm">d'), _text("k"), F.lit(".htm</a> iXBRL"))
    whole = F.concat(cell(F.when(F.col("k") % 6 == 0, "").otherwise(_text("k"))), cell(F.lit("  Order \n "), "s"), cell(link), cell("p"), cell(F.when(F.col("k") % 4 == 0, "&nbsp;").otherwise((F.col("k") * 10).cast("string"))))
    row = F.concat(F.lit("<tr>"), F.when(F.col("k") % 7 == 0, cell(_text("k"))).otherwise(whole), F.lit("</tr>"))
    pages = _orders(spark, sf_dir).groupBy(F.col("c").alias("id")).agg(F.concat(F.lit("<table><tr><th>Seq</th></tr>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("html"))
    return documents.filing_index(pages)


def other_documents(spark, sf_dir):
    k = F.col("k")
    pick = lambda n, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (k % n + 1).cast("int"))
    index = _orders(spark, sf_dir).select(F.col("c").alias("id"), (k % 2).alias("seq"), F.concat(F.lit("d"), (k % 2), pick(5, ".xml", ".htm", ".pdf", ".xsd", ".zip")).alias("document"), pick(6, "EX-99", "EX-101.INS", "XML", "10-K", "GRAPHIC", "4").alias("type"), "k")
    return documents.other_documents(index, "d1.htm").select("id", "seq", "document", "type", "k")


def chosen_reports(spark, sf_dir):
    """A package per customer: inline documents, instances and schemas among other files."""
    k = F.col("k")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".htm", ".xml", ".xsd", ".xml")]), (k % 4 + 1).cast("int"))
    content = F.when(k % 9 == 0, "<html><ix:header/>").when(k % 2 == 1, "<?xml?><xbrl>").otherwise("<html>")
    return documents.choose_report(_orders(spark, sf_dir).select(F.col("c").alias("id"), F.concat(F.lit("d/f"), F.col("m") % 3, ending).alias("path"), (k % 1000).alias("size"), content.alias("content")))


def root_schemas(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    name = lambda c: F.concat(F.lit("http://x.org/"), c.cast("string"), F.lit(".xsd"))
    return documents.root_schemas(p.select(name(F.col("p_partkey")).alias("location")), p.select(name(F.col("p_partkey") * 3).alias("location")))


def catalog_rewrites(spark, sf_dir):
    made = _table(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "http://y.org/").otherwise("http://x.org/"), "p_type", F.lit("/"), _text("p_partkey")).alias("location"))
    return documents.rewritten(made, spark.sql("SELECT * FROM VALUES ('http://x.org/', 'file:/a/'), ('http://x.org/ECONOMY', 'file:/e'), ('http://x.org/ECONOMY/1', 'file:/one'), ('http://z.org/', 'file:/z/') AS v(prefix, replacement)"))


#: Heads that are put before texts so that every kind of document occurs.
HEADS = ('{"documentInfo": {}, "facts": ', '{"@graph": [{"@type": "AccountingEquation"}]', '{"@context": ', '{"xbrl:fact": ', '{"concepts": {}, "networks": ', "<html><ix:header>", "FORM 10-q/A ", "Annual report on form 20-F, ")


def document_kinds(spark, sf_dir):
    head = F.element_at(F.array(*[F.lit(x) for x in (*HEADS, "")]), (F.col("doc_id") % (len(HEADS) + 1) + 1).cast("int"))
    made = _table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("t"))
    return made.select("doc_id", text.json_kind(F.col("t")).alias("kind"), text.is_inline(F.col("t")).alias("inline"), text.cover_form(F.col("t")).alias("form"))


def name_codecs(spark, sf_dir):
    name = F.concat(F.lit("tb:Net"), _text("p_size"), F.lit("CashFLOWFrom"), F.regexp_replace("p_name", " ", "To"), F.when(F.col("p_partkey") % 2 == 0, "TextBlock").otherwise(""))
    made = _table(spark, sf_dir, "part").withColumn("n", name)
    return made.select(
        "p_partkey", text.label_from_name(F.col("n")).alias("label"), text.split_camel(F.col("n")).alias("words"), text.local_name(F.col("n")).alias("local"), text.prefix_of(F.when(F.col("p_partkey") % 3 == 0, F.lit("bare")).otherwise(F.col("n"))).alias("prefix"),
        text.slug(F.concat_ws(" -- ", "p_name", "p_brand")).alias("slug"), text.qname_uri(F.lit("http://x"), text.local_name(F.col("n"))).alias("uri"), text.language_tag(F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(" en-US ")).alias("language"),
        text.entity_sqname(F.when(F.col("p_partkey") % 2 == 0, "http://sec/CIK").otherwise("http://lei"), _text("p_partkey")).alias("entity"),
        text.unit_measure(text.measure_token(F.when(F.col("p_partkey") % 2 == 0, "iso4217").otherwise(""), F.lit("USD")), F.when(F.col("p_partkey") % 3 == 0, "shares")).alias("unit"),
    )


def role_labels(spark, sf_dir):
    """Labels of parts in some roles, asked for by one role."""
    label = lambda role, value: F.struct(F.lit(role).alias("role"), value.alias("value"))
    k, role = F.col("p_partkey"), "http://r/role/totalLabel"
    labels = F.filter(F.array(label("http://r/role/label", F.col("p_name")), F.when(k % 2 == 0, label(role, F.col("p_brand"))), F.when(k % 3 == 0, label("http://other/TotalLabel", F.col("p_type"))), F.when(k % 5 == 0, label(role, F.lit("")))), lambda x: x.isNotNull())
    asked = F.when(k % 7 != 0, role)
    return _table(spark, sf_dir, "part").select("p_partkey", text.label_for_role(labels, asked, F.when(k % 4 != 0, F.col("p_name")), F.concat(F.lit("tb:P"), _text("p_partkey"))).alias("label"))


def date_codecs(spark, sf_dir):
    o = _orders(spark, sf_dir)
    packed, end = F.regexp_replace("day", "-", ""), F.concat(F.lit("--"), F.substring("day", 6, 5))
    stamp = F.concat(F.when(F.col("k") % 10 == 0, F.concat(F.lit("24"), F.substring("day", 3, 8))).when(F.col("k") % 10 == 1, F.concat(F.lit("16"), F.substring("day", 3, 8))).otherwise(F.col("day")), F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "T00:00:00").otherwise("T12:30:00"))
    return o.select(
        "k", periods.edgar_date(F.when(F.col("k") % 2 == 0, F.concat(F.lit(" "), packed)).otherwise(F.col("day"))).alias("filed"), periods.fiscal_year_end(end).alias("year_end"), periods.fiscal_month(F.when(F.col("k") % 4 != 0, end).otherwise("x")).alias("month"),
        periods.inclusive_date(stamp).alias("closes"), periods.period_wanted(_text("m"), F.to_date("day"), ["7", "1997", "1998-02-03"]).alias("wanted"),
    )


def period_keys(spark, sf_dir):
    f = report_set(spark, sf_dir).facts
    return f.select("report_id", "seq", periods.period_key(F.col("period_type"), F.col("start_date"), F.col("end_date")).alias("key"))


def clean_narrative(spark, sf_dir):
    """Texts with page numbers, contents marks, member lists and long digit runs put between their lines."""
    junk = F.concat(F.lit("\n 12 \nPage 4\nTABLE OF CONTENTS\nAlso tb:OneMember  tb:TwoMember here\nNo. 12345678901 ends "), _text("doc_id"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(text.clean_narrative(F.concat(F.coalesce("text", F.lit("")), junk)), "UTF-8")).alias("digest"))


def assembled_texts(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("place"), F.col("role").alias("label"), "text")
    return texts.assemble(turns).select("id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def found_networks(spark, sf_dir):
    networks, arcs = varied_networks(spark, sf_dir)
    return blocks.find_network(networks, blocks.classify(networks, arcs), "Balance Sheet").select("seq", "role_uri", "tier")


def cube_arcs(spark, sf_dir):
    """A role per nation: its customers' segments are axes, presented under parents of which not each has all of them."""
    c = _table(spark, sf_dir, "customer").select(F.concat(F.lit("role"), _text("c_nationkey")).alias("role_uri"), F.col("c_mktsegment").alias("axis"), F.col("c_custkey").alias("k"))
    axes = c.filter("k % 2 = 0").select("role_uri", "axis").distinct()
    parent = F.concat(F.lit("t"), F.col("k") % 3).alias("parent")
    shown = c.select("role_uri", parent, F.col("axis").alias("child")).unionByName(c.select("role_uri", parent, F.concat(F.lit("i"), F.col("k") % 4).alias("child"))).distinct()
    return blocks.cubes_to_arcs(axes, shown)


def walk_page(spark, sf_dir):
    page = walks.page(walks.presentation_walk(report_set(spark, sf_dir).arcs), 2, 2)
    return page.select("network_seq", F.col("ordinal").cast("long").alias("ordinal"), "concept", "total", F.array_join("ancestors", ">").alias("ancestors"), F.col("next_offset").cast("long").alias("next_offset"))


def never_blank(spark, sf_dir):
    """Dear orders, and the dearest of customers that have none."""
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return walks.with_fallback(o.filter("o_totalprice > 300000"), o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])


def oim_round_trip(spark, sf_dir):
    back = documents.read_oim(documents.oim_document(report_set(spark, sf_dir).facts))
    return back.select("report_id", "seq", "concept", "unit_id", "period_type", "start_date", "end_date", "numeric_value", "decimals", "dims_key")


def compiled_round_trip(spark, sf_dir):
    r = report_set(spark, sf_dir)
    back = documents.read_compiled(documents.compiled_objects(r.concepts, r.networks, r.arcs, r.facts))
    return back["facts"].select("report_id", "seq", "concept", "period_id", "unit_id", "dims_key", "numeric_value", "decimals")


def compiled_counts(spark, sf_dir):
    r = report_set(spark, sf_dir)
    return documents.compiled_objects(r.concepts, r.networks, r.arcs, r.facts).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def unmentioned_concepts(spark, sf_dir):
    r = report_set(spark, sf_dir)
    return documents.unmentioned(r.concepts, r.arcs.filter("network_seq > 5"), r.facts.filter("concept <> 'tb:Quantity'")).select("qname")


def named_graphs(spark, sf_dir):
    """Orders as subjects of six types, one of them none, with a value each."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Fact", "Duration", "Report", "Unit", "Element", "none")]), (F.col("k") % 6 + 1).cast("int"))
    s = F.concat(F.lit("x"), _text("k")).alias("s")
    o = _orders(spark, sf_dir)
    types = o.select(s, F.lit(rdf.TYPE).alias("p"), kind.alias("o")).filter("o <> 'none'")
    return rdf.named_graphs(types.unionByName(o.select(s, F.lit("v").alias("p"), F.col("day").alias("o"))))


def natural_order(spark, sf_dir):
    made = _table(spark, sf_dir, "part").withColumn("t", F.concat_ws("-", F.regexp_replace("p_brand", "#", " "), _text("p_size"), _text("p_partkey")))
    return made.select("p_partkey", rdf.natural_key(F.col("t")).alias("key"))


def element_grid(spark, sf_dir):
    return rdf.element_grid(rdf.consolidated_facts(rdf.triples(report_set(spark, sf_dir))), ["tb:NetRevenue", "tb:Quantity"], ["1997-12-31", "1998-12-31", "1998-03-31"], "annual").select("concept", "end", "measure", F.col("value").cast("double").alias("value"))


def preferred_rows(spark, sf_dir):
    c, o = _table(spark, sf_dir, "customer"), _orders(spark, sf_dir)
    first = o.groupBy(F.col("c").alias("key")).agg(F.max("day").alias("name")).filter("key % 3 <> 1")
    return exports.prefer(first, c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), "key")


def inline_fragments(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    made = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("http://f/"), _text("p_partkey"))).otherwise(F.col("p_name")).alias("value_str"))
    return exports.inline_fragments(made, p.filter("p_partkey % 4 = 0").select(F.concat(F.lit("http://f/"), _text("p_partkey")).alias("url"), F.col("p_type").alias("text")))


def sgml_headers(spark, sf_dir):
    """Header lines of orders: the first of a repeated key counts."""
    made = _orders(spark, sf_dir).select(F.col("k").alias("id"), F.concat(F.lit("<SEC-HEADER>\nACCESSION NUMBER:\t"), _text("k"), F.lit("\nFORM:  "), "p", F.lit("\n  FORM: other\nno pair\n<TAG>x: y\n\tPERIOD: "), "day", F.lit("  \n</SEC-HEADER>\nLATER: 1\n")).alias("text"))
    return documents.sgml_header(made)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        network_kinds, context_periods, assembled_facts, dropped_facts, drop_ledger, recovered_contexts, cover_pages, filled_fields, identity_codecs, prefix_bindings, authored_facts, authored_faults, newest_reports, default_language, text_concepts,
        undefined_facts, gap_report, submissions_list, submissions_merged, company_headers, tickers_to_cik, api_filings, search_pages, filing_index, other_documents, chosen_reports, root_schemas, catalog_rewrites, document_kinds, name_codecs, role_labels,
        date_codecs, period_keys, clean_narrative, assembled_texts, found_networks, cube_arcs, walk_page, never_blank, oim_round_trip, compiled_round_trip, compiled_counts, unmentioned_concepts, named_graphs, natural_order, element_grid, preferred_rows,
        inline_fragments, sgml_headers,
    )
}
