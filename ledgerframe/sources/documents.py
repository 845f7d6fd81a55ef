"""Readers and writers of the exchange formats and filing documents around reports."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.periods import format_interval, parse_interval
from ..functions.values import whole_decimals
from ..operators.calculations import calculation_arcs

# -- JSON ----------------------------------------------------------------------


def shred_json(rows: DataFrame, column: str, path: str) -> DataFrame:
    """rows with `value`: what the JSON column holds at path, as text; null for unreadable JSON."""
    return rows.withColumn("value", F.get_json_object(column, path))


MODEL = (
    "filing STRUCT<accession: STRING, form: STRING, filing_date: STRING, report_date: STRING>, entity STRUCT<cik: STRING, name: STRING>, concepts MAP<STRING, STRUCT<name: STRING, pref_label: STRING, is_abstract: BOOLEAN, is_numeric: BOOLEAN, period_type: STRING, balance: STRING>>, "
    "periods ARRAY<STRUCT<id: STRING, period_type: STRING, start: STRING, `end`: STRING>>, units ARRAY<STRUCT<id: STRING, measure: STRING>>, "
    "facts ARRAY<STRUCT<id: STRING, concept_qname: STRING, period_id: STRING, unit_id: STRING, value_str: STRING, numeric_value: DOUBLE, decimals: STRING, is_nil: BOOLEAN, language: STRING, dims: ARRAY<STRUCT<axis_qname: STRING, member_qname: STRING, typed_value: STRING>>>>, "
    "networks ARRAY<STRUCT<role_uri: STRING, kind: STRING, definition: STRING, arcs: ARRAY<STRUCT<from_qname: STRING, to_qname: STRING, arcrole: STRING, `order`: DOUBLE, weight: DOUBLE, preferred_label: STRING, target_role: STRING>>>>"
)


def read_models(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Saved models (one JSON document per file) as tables: reports, concepts, periods, units, facts, networks, arcs; seq is the position in the document."""
    docs = spark.read.schema(MODEL).json(path, multiLine=True).withColumn("report_id", F.col("filing.accession"))
    each = lambda c: docs.select("report_id", F.posexplode(c).alias("seq", "x")).select("report_id", "seq", "x.*")
    facts = each("facts").withColumnRenamed("concept_qname", "concept")
    pair = F.transform(F.coalesce("dims", F.array().cast("array<struct<axis_qname:string,member_qname:string,typed_value:string>>")), lambda d: F.concat(d["axis_qname"], F.lit("="), F.coalesce(d["member_qname"], d["typed_value"], F.lit(""))))
    facts = facts.withColumns({"dims_key": F.array_join(F.array_sort(pair), "|"), "dim_count": F.size(pair)})
    networks = each("networks")
    concepts = docs.select("report_id", F.explode("concepts").alias("qname", "x")).select("report_id", "qname", "x.*")
    arcs = networks.select("report_id", F.col("seq").alias("network_seq"), F.posexplode("arcs").alias("seq", "x")).select("report_id", "network_seq", "seq", "x.*").withColumnRenamed("order", "arc_order")
    return {"reports": docs.select("report_id", "filing.*", F.col("entity.cik").alias("cik"), F.col("entity.name").alias("name")), "concepts": concepts, "periods": each("periods"), "units": each("units"), "facts": facts, "networks": networks.drop("arcs"), "arcs": arcs}


def read_json_ld(docs: DataFrame) -> DataFrame:
    """(id, seq, node, type, properties) of docs(id, json): the nodes of @graph, named graphs flattened; terms by their local name, whether bare, prefixed or whole."""
    kind = "array<map<string,string>>"
    text = "json"
    top = F.from_json(F.get_json_object(text, "$.@graph"), kind)
    nodes = docs.select("id", F.posexplode(top).alias("seq", "n"))
    inner = F.from_json(F.try_element_at("n", F.lit("@graph")), kind)
    flat = nodes.select("id", "seq", F.explode(F.when(inner.isNotNull() & (F.size(inner) > 0), inner).otherwise(F.array("n"))).alias("n"))
    names = F.map_from_entries(F.transform(F.map_entries(F.map_filter("n", lambda k, _: ~k.startswith("@"))), lambda e: F.struct(F.substring_index(F.substring_index(F.substring_index(e["key"], "#", -1), "/", -1), ":", -1).alias("k"), e["value"])))
    kind_of = F.regexp_extract(F.coalesce(F.try_element_at("n", F.lit("@type")), F.lit("")), r"([A-Za-z]+)\W*$", 1)
    return flat.select("id", "seq", F.try_element_at("n", F.lit("@id")).alias("node"), kind_of.alias("type"), names.alias("properties"))


# -- xBRL-JSON ------------------------------------------------------------------


def oim_facts(facts: DataFrame) -> DataFrame:
    """Facts as the exchange format has them: key f-<n> in order, canonical value, whole decimals, exclusive period literal."""
    key = F.concat(F.lit("f-"), F.row_number().over(W.partitionBy("report_id").orderBy("seq")).cast("string"))
    value = F.col("numeric_value").cast("decimal(38,2)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(value, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return facts.select("report_id", "seq", key.alias("key"), plain.alias("value"), whole_decimals(F.col("decimals")).alias("decimals"), "concept", format_interval(F.col("period_type"), F.col("start_date"), F.col("end_date")).alias("period"), F.col("unit_id").alias("unit"), "dims", "dims_key", "language")


def oim_document(facts: DataFrame) -> DataFrame:
    """(report_id, json): the exchange document of each report."""
    f = oim_facts(facts)
    dims = F.map_from_entries(F.transform("dims", lambda d: F.struct(d["axis"], d["member"])))
    core = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in (("concept", "concept"), ("period", "period"), ("unit", "unit"), ("language", "language"))]), lambda e: e["v"].isNotNull()))
    entry = F.struct("value", "decimals", F.map_concat(core, dims).alias("dimensions"))
    body = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("key").alias("k"), entry.alias("v"))), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)), lambda e: F.struct(e["k"], e["v"])))
    return f.groupBy("report_id").agg(body.alias("facts")).select("report_id", F.to_json(F.struct(F.struct(F.lit("https://xbrl.org/2021/xbrl-json").alias("documentType")).alias("documentInfo"), "facts")).alias("json"))


def read_oim(docs: DataFrame) -> DataFrame:
    """Facts of docs(report_id, json): the way back from oim_document."""
    kind = "map<string,struct<value:string,decimals:int,dimensions:map<string,string>>>"
    each = docs.select("report_id", F.explode(F.from_json(F.get_json_object("json", "$.facts"), kind)).alias("key", "f"))
    dim = lambda k: F.try_element_at("f.dimensions", F.lit(k))
    period = parse_interval(dim("period"))
    others = F.array_sort(F.transform(F.map_entries(F.map_filter("f.dimensions", lambda k, _: ~k.isin("concept", "period", "unit", "language"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return each.select(
        "report_id", F.substring("key", 3, 20).cast("long").alias("seq"), dim("concept").alias("concept"), dim("unit").alias("unit_id"), dim("language").alias("language"), period["period_type"].alias("period_type"), period["start"].alias("start_date"), period["end"].alias("end_date"),
        F.col("f.value").try_cast("double").alias("numeric_value"), F.coalesce(F.col("f.decimals").cast("string"), F.lit("INF")).alias("decimals"), F.array_join(others, "|").alias("dims_key"), F.size(others).alias("dim_count"),
    )


# -- equations and compiled models -----------------------------------------------


def equations(networks: DataFrame, arcs: DataFrame) -> DataFrame:
    """(role_uri, total, terms): one accounting equation per calculation parent, terms as sign and concept in arc order."""
    term = F.struct("arc_seq", F.concat(F.when(F.col("weight") < 0, "-").otherwise("+"), F.col("child")).alias("t"))
    grouped = calculation_arcs(networks, arcs).groupBy("role_uri", F.col("parent").alias("total")).agg(F.array_sort(F.collect_list(term)).alias("ts"))
    return grouped.select("role_uri", "total", F.array_join(F.transform("ts", lambda x: x["t"]), " ").alias("terms"))


def equation_nodes(networks: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, json) JSON-LD nodes of the equations."""
    e = equations(networks, arcs).withColumn("node", F.concat(F.lit("equation:"), F.substring(F.md5(F.concat_ws("|", "role_uri", "total")), 1, 16)))
    parts = F.array(F.lit("@id"), "node", F.lit("@type"), F.lit("AccountingEquation"), F.lit("total"), "total", F.lit("terms"), "terms")
    pairs = F.map_from_arrays(F.array(*[parts[i] for i in (0, 2, 4, 6)]), F.array(*[parts[i] for i in (1, 3, 5, 7)]))
    return e.select("node", F.to_json(pairs).alias("json"))


def unmentioned(concepts: DataFrame, arcs: DataFrame, facts: DataFrame) -> DataFrame:
    """Concepts that neither arcs nor facts mention."""
    said = arcs.select(F.explode(F.array("from_qname", "to_qname")).alias("qname")).unionByName(facts.select(F.col("concept").alias("qname"))).distinct()
    return concepts.join(said, "qname", "left_anti")


def compiled_objects(concepts: DataFrame, networks: DataFrame, arcs: DataFrame, facts: DataFrame) -> DataFrame:
    """(kind, name, json) objects of the compiled model: concepts and headings, networks, relationships, units, periods, facts."""
    def obj(df: DataFrame, kind: str, name: Column, *cols: str | Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), name.cast("string").alias("name"), F.to_json(F.struct(*cols)).alias("json"))

    parts = [
        obj(concepts.filter("NOT is_abstract"), "concept", F.col("qname"), "qname", "label", "period_type", "balance"), obj(concepts.filter("is_abstract AND NOT is_domain_member AND NOT is_dimension_item"), "heading", F.col("qname"), "qname", "label"),
        obj(concepts.filter("is_domain_member"), "member", F.col("qname"), "qname", "label"), obj(concepts.filter("is_dimension_item"), "dimension", F.col("qname"), "qname", "label"),
        obj(networks, "network", F.concat_ws("#", "role_uri", "kind"), "role_uri", "kind", "definition"), obj(arcs, "relationship", F.concat_ws("#", "network_seq", "seq"), "network_seq", "from_qname", "to_qname", "arc_order", "weight", "preferred_label"),
        obj(facts.select("unit_id").distinct(), "unit", F.col("unit_id"), "unit_id"), obj(facts.select("period_id").distinct(), "period", F.col("period_id"), "period_id"),
        obj(facts, "fact", F.concat_ws("#", "report_id", "seq"), "concept", "period_id", "unit_id", "dims_key", "numeric_value", "decimals"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_compiled(objects: DataFrame) -> dict[str, DataFrame]:
    """concepts, networks, arcs and facts back from compiled_objects."""
    as_ = lambda kind, ddl: objects.filter(F.col("kind") == kind).select(F.from_json("json", ddl).alias("o"), "name").select("name", "o.*")
    facts = as_("fact", "concept STRING, period_id STRING, unit_id STRING, dims_key STRING, numeric_value DOUBLE, decimals STRING")
    return {
        "concepts": as_("concept", "qname STRING, label STRING, period_type STRING, balance STRING").drop("name"), "networks": as_("network", "role_uri STRING, kind STRING, definition STRING").drop("name"),
        "arcs": as_("relationship", "network_seq INT, from_qname STRING, to_qname STRING, arc_order DOUBLE, weight DOUBLE, preferred_label STRING").drop("name"),
        "facts": facts.withColumns({"report_id": F.substring_index("name", "#", 1), "seq": F.substring_index("name", "#", -1).cast("long")}).drop("name"),
    }


def gap_report(concepts: DataFrame, facts: DataFrame) -> DataFrame:
    """(what, value, n): histograms of what a compiled model cannot hold or has to infer."""
    kinds = concepts.groupBy(F.lit("period_type").alias("what"), F.coalesce("period_type", F.lit("?")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    shape = facts.groupBy(F.lit("fact_period").alias("what"), F.col("period_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(shape)


def undefined_facts(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """(prefix, n): facts of undeclared concepts by prefix, most first."""
    lost = facts.join(concepts.select(F.col("qname").alias("concept")), "concept", "left_anti")
    return lost.groupBy(F.substring_index("concept", ":", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix")


# -- filing documents --------------------------------------------------------------


def strip_pem(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)-----BEGIN PRIVACY-ENHANCED MESSAGE-----.*?\n\n", ""), r"-----END PRIVACY-ENHANCED MESSAGE-----\s*", "")


def sgml_header(docs: DataFrame) -> DataFrame:
    """(id, key, value): KEY: value lines of the header, the first of each key."""
    head = F.regexp_extract("text", r"(?s)<SEC-HEADER>(.*?)</SEC-HEADER>", 1)
    lines = docs.select("id", F.posexplode(F.split(head, "\n")).alias("place", "line"))
    pairs = lines.select("id", "place", F.trim(F.regexp_extract("line", r"^\s*([^:<>]+):\s*(.+?)\s*$", 1)).alias("key"), F.regexp_extract("line", r"^\s*([^:<>]+):\s*(.+?)\s*$", 2).alias("value")).filter("key <> ''")
    return pairs.withColumn("_n", F.row_number().over(W.partitionBy("id", "key").orderBy("place"))).filter("_n = 1").select("id", "key", "value")


def sgml_documents(docs: DataFrame) -> DataFrame:
    """(id, place, type, sequence, filename, description, body, is_encoded) of the documents of docs(id, text), a whole submission each."""
    blocks = F.regexp_extract_all(strip_pem(F.col("text")), F.lit(r"(?s)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))
    each = docs.select("id", F.posexplode(blocks).alias("place", "block"))
    tag = lambda name: F.nullif(F.trim(F.regexp_extract("block", rf"(?m)^<{name}>([^\n]*)$", 1)), F.lit(""))
    body = F.trim(F.regexp_replace(F.regexp_extract("block", r"(?s)<TEXT>\n?(.*?)\n?</TEXT>", 1), r"(?m)^<PAGE>\s*$", ""), F.lit("\n"))
    return each.select("id", (F.col("place") + 1).alias("place"), tag("TYPE").alias("type"), tag("SEQUENCE").alias("sequence"), tag("FILENAME").alias("filename"), tag("DESCRIPTION").alias("description"), body.alias("body"), body.rlike(r"^begin \d{3} ").alias("is_encoded"))


XML = "id long, fields map<string,string>, tables array<struct<name:string,columns:array<string>,rows:array<map<string,string>>>>"


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _scalar(e: ElementTree.Element) -> str | None:
    """Text of a leaf, or of the single `value` child that wraps one."""
    if not len(e):
        return (e.text or "").strip()
    if len(e) == 1 and _tag(e[0]) == "value" and not len(e[0]):
        return (e[0].text or "").strip()
    return None


def _flat(e: ElementTree.Element, path: str, out: dict[str, str]) -> None:
    for k, v in e.attrib.items():
        out.setdefault(f"{path}@{k.rpartition('}')[2]}", v)
    value = _scalar(e)
    if value is not None:
        if value:
            key, n = path, 2
            while key in out:
                key, n = f"{path}#{n}", n + 1
            out[key] = value
        return
    for child in e:
        _flat(child, f"{path}.{_tag(child)}" if path else _tag(child), out)


def xml_parts(text: str | None) -> tuple[dict[str, str], list[dict]]:
    """Scalar fields by path, and record tables: elements that repeat under one parent, or the children of a `...Table` or plural container."""
    try:
        root = ElementTree.fromstring((text or "").strip())
    except ElementTree.ParseError:
        return {}, []
    fields: dict[str, str] = {}
    tables: dict[str, list[dict[str, str]]] = {}

    def walk(e: ElementTree.Element, path: str) -> None:
        names = [_tag(c) for c in e]
        for child, name in zip(e, names, strict=True):
            here = f"{path}.{name}" if path else name
            kids = [_tag(c) for c in child]
            container = len(child) and len(set(kids)) == 1 and (name.endswith("Table") or name.lower() in (kids[0].lower() + "s", kids[0].lower() + "es")) and any(len(c) for c in child)
            if container or (names.count(name) > 1 and len(child) and _scalar(child) is None):
                for record in child if container else [child]:
                    row: dict[str, str] = {}
                    _flat(record, "", row)
                    tables.setdefault(here if container else name, []).append(row)
            elif len(child) and _scalar(child) is None:
                walk(child, here)
            else:
                _flat(child, here, fields)

    walk(root, "")
    return fields, [{"name": n, "columns": list(dict.fromkeys(k for r in rows for k in r)), "rows": rows} for n, rows in tables.items()]


def xml_records(docs: DataFrame) -> DataFrame:
    """(id, fields, tables) of docs(id, xml): columns of the record tables are in order of first appearance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [xml_parts(t) for t in batch["xml"]]
            yield pd.DataFrame({"id": batch["id"], "fields": [f for f, _ in found], "tables": [t for _, t in found]})

    return docs.select(F.col("id").cast("long"), "xml").mapInPandas(run, XML)


class _Rows(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.links: list[str] = []
        self.on = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
            self.links.append("")
        elif tag == "td" and self.rows:
            self.rows[-1].append("")
            self.on = True
        elif tag == "a" and self.rows and self.on:
            self.links[-1] = dict(attrs).get("href") or ""

    def handle_endtag(self, tag):
        self.on = self.on and tag != "td"

    def handle_data(self, data):
        if self.on:
            self.rows[-1][-1] += data


def filing_index(pages: DataFrame) -> DataFrame:
    """(id, seq, description, document, type, size, url) of the document rows of index pages(id, html): five cells or more, a numbered first, a named third."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, html in zip(batch["id"], batch["html"], strict=True):
                p = _Rows()
                p.feed(html or "")
                for row, link in zip(p.rows, p.links, strict=True):
                    cells = [" ".join(c.split()) for c in row]
                    if len(cells) >= 5 and cells[0].isdigit() and cells[2]:
                        out.append((i, int(cells[0]), cells[1], cells[2].split()[0], cells[3], int(cells[4]) if cells[4].isdigit() else None, link))
            yield pd.DataFrame(out, columns=["id", "seq", "description", "document", "type", "size", "url"]).astype({"size": "Int64"})

    return pages.select(F.col("id").cast("long"), "html").mapInPandas(run, "id long, seq int, description string, document string, type string, size long, url string")


def other_documents(index: DataFrame, primary: str) -> DataFrame:
    """Documents of an index beside the report: without the report itself, its package files, and rendered twins of an .xml of the same number and stem."""
    stem, ending = F.regexp_replace("document", r"\.[^.]*$", ""), F.lower(F.substring_index("document", ".", -1))
    rows = index.withColumns({"_stem": stem, "_end": ending}).filter((F.col("document") != primary) & ~F.col("type").rlike(r"^(EX-101|XML$|ZIP$|GRAPHIC$)") & ~ending.isin("xsd", "zip", "js", "css"))
    twins = rows.filter("_end = 'xml'").select("id", "seq", "_stem").distinct()
    rendered = rows.filter("_end <> 'xml'").join(twins, ["id", "seq", "_stem"], "left_semi")
    return rows.join(rendered.select("id", "seq", "document"), ["id", "seq", "document"], "left_anti").drop("_stem", "_end")


# -- remote listings ----------------------------------------------------------------


SUBMISSION = {"accessionNumber": "accession", "form": "form", "filingDate": "filed", "reportDate": "reported", "primaryDocument": "document"}


def _submission_rows(docs: DataFrame, cik: Column) -> DataFrame:
    """One row for each place of the parallel arrays of docs(json), which stand under filings.recent or at the top."""
    kind = f"struct<{','.join(f'{c}:array<string>' for c in SUBMISSION)}>"
    lists = F.from_json(F.coalesce(F.get_json_object("json", "$.filings.recent"), F.col("json")), kind)
    rows = docs.select(cik.alias("cik"), lists.alias("r")).select("cik", F.inline(F.arrays_zip(*[F.col(f"r.{c}") for c in SUBMISSION])))
    return rows.toDF("cik", *SUBMISSION.values())


def submissions(docs: DataFrame, form: str | None = None) -> DataFrame:
    """(cik, accession, form, filed, reported, document) of submission lists(json), whose columns are parallel arrays; newest first."""
    out = _submission_rows(docs, F.get_json_object("json", "$.cik"))
    return (out.filter(F.col("form") == form) if form else out).orderBy(F.desc("filed"), "accession")


def all_submissions(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Every filing of submission lists docs(json) and of their further pages(cik, json) in one table; a filing named twice comes once, as the list itself has it."""
    rows = _submission_rows(docs, F.get_json_object("json", "$.cik")).withColumn("_part", F.lit(0)).unionByName(_submission_rows(pages, F.col("cik")).withColumn("_part", F.lit(1)))
    first = W.partitionBy("cik", "accession").orderBy("_part", "filed", "form", "reported", "document")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_part")


def company_info(docs: DataFrame) -> DataFrame:
    """(cik, name, ein, ticker, exchange, sic, state_of_incorporation, fiscal_year_end, entity_type, website, phone) of submission lists(json).

    Missing texts are empty; a missing tax id or website is null, a missing ticker or exchange too."""
    text = lambda path: F.coalesce(F.get_json_object("json", f"$.{path}"), F.lit(""))
    known = lambda c: F.nullif(c, F.lit(""))
    return docs.select(
        F.get_json_object("json", "$.cik").alias("cik"), text("name").alias("name"), known(text("ein")).alias("ein"), known(text("tickers[0]")).alias("ticker"), known(text("exchanges[0]")).alias("exchange"), text("sic").alias("sic"),
        text("stateOfIncorporation").alias("state_of_incorporation"), text("fiscalYearEnd").alias("fiscal_year_end"), text("entityType").alias("entity_type"), known(F.coalesce(known(text("website")), text("investorWebsite"))).alias("website"), text("phone").alias("phone"),
    )


def ticker_to_cik(tickers: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(ticker) with cik, ten digits; tickers(ticker, cik) in either case."""
    known = tickers.select(F.upper("ticker").alias("_t"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"))
    return wanted.join(known, F.upper(F.trim("ticker")) == F.col("_t"), "left").drop("_t")


def api_filings(docs: DataFrame, today: str) -> DataFrame:
    """(id, entity, period_end, processed, latest) of JSON:API pages(json): rows joined to included entities; latest marks, per entity, the newest period that has ended."""
    row = "array<struct<id:string,attributes:struct<period_end:string,processed:string,json_url:string>,relationships:struct<entity:struct<data:struct<id:string>>>>>"
    ent = "array<struct<id:string,attributes:struct<name:string,identifier:string>>>"
    rows = docs.select(F.explode(F.from_json(F.get_json_object("json", "$.data"), row)).alias("r")).select("r.id", "r.attributes.*", F.col("r.relationships.entity.data.id").alias("e"))
    entities = docs.select(F.explode(F.from_json(F.get_json_object("json", "$.included"), ent)).alias("x")).select(F.col("x.id").alias("e"), F.col("x.attributes.name").alias("entity")).distinct()
    order = W.partitionBy("e").orderBy((F.col("period_end") <= today).desc(), F.desc("period_end"), F.desc("processed"), "id")
    return rows.join(entities, "e", "left").withColumn("latest", F.row_number().over(order) == 1).drop("e")


def search_hits(docs: DataFrame) -> DataFrame:
    """(total, id, cik, name, form, filed) of full-text search pages(json)."""
    kind = "array<struct<_id:string,_source:struct<ciks:array<string>,display_names:array<string>,form:string,file_date:string>>>"
    each = docs.select(F.get_json_object("json", "$.hits.total.value").cast("long").alias("total"), F.explode(F.from_json(F.get_json_object("json", "$.hits.hits"), kind)).alias("h"))
    return each.select("total", F.split_part("h._id", F.lit(":"), F.lit(1)).alias("id"), F.get("h._source.ciks", F.lit(0)).alias("cik"), F.get("h._source.display_names", F.lit(0)).alias("name"), F.col("h._source.form").alias("form"), F.col("h._source.file_date").alias("filed"))


def quarters(start: str, end: str) -> list[tuple[str, str]]:
    """First and last days of the calendar quarters from start to end, clipped to them: how a capped search is partitioned."""
    y, q, out = int(start[:4]), (int(start[5:7]) - 1) // 3, []
    last = ("03-31", "06-30", "09-30", "12-31")
    while f"{y}-{q * 3 + 1:02d}-01" <= end:
        out.append((max(start, f"{y}-{q * 3 + 1:02d}-01"), min(end, f"{y}-{last[q]}")))
        y, q = (y, q + 1) if q < 3 else (y + 1, 0)
    return out


def choose_report(files: DataFrame) -> DataFrame:
    """(id, path) of the report in each package of files(id, path, size, content): the largest inline document, else the only instance, else the one whose name pairs with a schema."""
    head = F.lower(F.substring(F.decode("content", "UTF-8"), 1, 10000)) if dict(files.dtypes)["content"] == "binary" else F.lower(F.substring("content", 1, 10000))
    inline = F.contains(head, F.lit("<ix:")) | F.contains(head, F.lit("inlinexbrl"))
    instance = F.contains(head, F.lit("<xbrl")) | F.contains(head, F.lit(":xbrl"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    rows = files.select("id", "path", "size", inline.alias("i"), (instance & F.lower("path").endswith(".xml")).alias("x"), stem.alias("s"))
    schemas = files.filter(F.lower("path").endswith(".xsd")).select("id", stem.alias("s"), F.lit(True).alias("paired")).distinct()
    ranked = rows.join(schemas, ["id", "s"], "left").filter("i OR x").withColumn("single", F.count_if("x").over(W.partitionBy("id")) == 1)
    tier = F.when(F.col("i"), 1).when(F.col("single"), 2).when(F.col("paired"), 3)
    best = W.partitionBy("id").orderBy("tier", F.desc("size"), "path")
    return ranked.withColumn("tier", tier).filter("tier IS NOT NULL").withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("id", "path")


def root_schemas(schemas: DataFrame, imports: DataFrame) -> DataFrame:
    """Schemas(location) that no import(location) names."""
    return schemas.join(imports.select("location").distinct(), "location", "left_anti")


def rewritten(locations: DataFrame, catalog: DataFrame) -> DataFrame:
    """locations(location), each once, with `target`: the longest catalog prefix(prefix, replacement) replaced, by an equal join on all prefixes of a location."""
    own = locations.select("location").distinct()
    starts = own.select("location", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("location"), F.lit(1))), lambda n: F.substring(F.col("location"), F.lit(1), n))).alias("prefix"))
    best = W.partitionBy("location").orderBy(F.desc(F.length("prefix")), "replacement")
    hit = starts.join(catalog.select("prefix", "replacement"), "prefix").withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return own.join(hit, "location", "left").select("location", F.coalesce(F.concat("replacement", F.expr("substring(location, length(prefix) + 1)")), "location").alias("target"))


