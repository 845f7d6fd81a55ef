"""Reports as triples, their named graphs, shape constraints, and the one pattern query over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import md5_slug
from ..functions.periods import duration_type
from ..functions.text import local_name
from ..sources.adapter import ReportSet

TYPE = "rdf:type"


def _rules(df: DataFrame, s: Column, *rules: tuple) -> DataFrame:
    """Triples of df, a select for each rule (predicate, object, kind, datatype or nothing): the predicate is a literal of its branch, so that a filter on p leaves only the branches that can match."""
    out = None
    for p, o, kind, *more in rules:
        one = df.select(s.cast("string").alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(more[0] if more else None).cast("string").alias("o_datatype")).filter("s IS NOT NULL AND o IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    return out


def triples(r: ReportSet) -> DataFrame:
    """(s, p, o, o_kind iri|literal, o_datatype): one rule per attribute; absent values have no triple."""
    c, lit = F.col, F.lit
    element = lambda q: F.concat(lit("element:"), local_name(q))
    report = lambda q: F.concat(lit("report:"), q)
    fact = F.concat(lit("fact:"), c("report_id"), lit("-"), c("seq").cast("string"))
    period = F.concat(lit("period:"), c("period_id"))
    dim = F.concat(lit("dimension:"), md5_slug(F.concat_ws("|", "report_id", "axis", "member")))
    arc = F.concat(lit("arc:"), c("network_seq").cast("string"), lit("-"), c("seq").cast("string"))
    dims = r.facts.select("report_id", "seq", F.explode("dims").alias("d")).select("report_id", "seq", c("d.axis").alias("axis"), c("d.member").alias("member"))
    periods = r.facts.select("period_id", "period_type", "start_date", "end_date").distinct()
    units = r.facts.filter("unit_id IS NOT NULL").select("unit_id").distinct()
    shown = dims.select("report_id", "axis", "member").distinct()
    net = F.concat(lit("network:"), c("seq").cast("string"))
    unit = F.concat(lit("unit:"), c("unit_id"))
    rules = [
        _rules(r.reports, report(c("report_id")), (TYPE, lit("Report"), "iri"), ("reportedBy", F.concat(lit("entity:"), c("entity_cik").cast("string")), "iri"), ("fiscalYear", c("fiscal_year"), "literal", "integer")),
        _rules(r.concepts, element(c("qname")), (TYPE, lit("Element"), "iri"), ("qname", c("qname"), "literal"), ("label", c("label"), "literal"), ("periodType", c("period_type"), "literal"), ("balance", c("balance"), "literal"), ("abstract", F.when(c("is_abstract"), "true"), "literal", "boolean")),
        _rules(periods, period, (TYPE, F.initcap("period_type"), "iri"), ("start", c("start_date"), "literal", "date"), ("end", c("end_date"), "literal", "date")),
        _rules(units, unit, (TYPE, lit("Unit"), "iri"), ("measure", c("unit_id"), "literal")),
        _rules(r.facts, fact, (TYPE, lit("Fact"), "iri"), ("inReport", report(c("report_id")), "iri"), ("element", element(c("concept")), "iri"), ("period", period, "iri"), ("unit", unit, "iri"), ("value", c("numeric_value").cast("decimal(38,2)"), "literal", "decimal"), ("decimals", c("decimals"), "literal")),
        _rules(dims, fact, ("dimension", dim, "iri")), _rules(shown, dim, (TYPE, lit("Dimension"), "iri"), ("axis", element(c("axis")), "iri"), ("member", element(c("member")), "iri")),
        _rules(r.networks, net, (TYPE, lit("Network"), "iri"), ("role", c("role_uri"), "iri"), ("definition", c("definition"), "literal")),
        _rules(r.arcs, arc, (TYPE, lit("Association"), "iri"), ("inNetwork", F.concat(lit("network:"), c("network_seq").cast("string")), "iri"), ("from", element(c("from_qname")), "iri"), ("to", element(c("to_qname")), "iri"), ("order", c("arc_order"), "literal", "double"), ("weight", c("weight"), "literal", "double")),
    ]
    out = rules[0]
    for x in rules[1:]:
        out = out.unionByName(x)
    return out


def named_graphs(t: DataFrame) -> DataFrame:
    """Triples with g: scene (facts, periods, units, dimensions), boundary (reports, entities) or projection (taxonomy)."""
    kind = t.filter(F.col("p") == TYPE).select("s", F.col("o").alias("_t"))
    g = F.when(F.col("_t").isin("Fact", "Duration", "Instant", "Unit", "Dimension"), "scene").when(F.col("_t") == "Report", "boundary").otherwise("projection")
    return t.join(kind, "s", "left").withColumn("g", g).drop("_t")


def element_grid(rows: DataFrame, elements: list[str] | None = None, ends: list[str] | None = None, period_type: str | None = None) -> DataFrame:
    """Rows of consolidated_facts for exact concepts, exact end dates (texts) and instant, annual or quarterly periods; one row per concept and end.

    Of several the first by duration type, measure, value and name stays: nothing depends on row order."""
    kept = rows
    if elements is not None:
        kept = kept.filter(F.col("concept").isin(elements))
    if ends is not None:
        kept = kept.filter(F.col("end").isin(ends))
    if period_type == "instant":
        kept = kept.filter("period_type = 'instant'")
    elif period_type in ("annual", "quarterly"):
        kept = kept.filter(F.col("duration_type") == period_type)
    order = W.partitionBy("concept", "end").orderBy(F.asc_nulls_last("duration_type"), F.asc_nulls_last("measure"), F.col("value").cast("double"), "name")
    return kept.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def natural_key(text: Column) -> Column:
    """A sort key in which runs of digits compare as numbers."""
    padded = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 20, "0")).otherwise(x))
    return F.array_join(padded, "")


def consolidated_facts(t: DataFrame) -> DataFrame:
    """(concept, name, value, end, period_type, duration_type, measure) of facts with a value and without a dimension. Name, duration type and measure may be missing.

    Properties of a subject are gathered in one pass, not by a join each."""
    def subjects(kinds: list[str], *paths: str, none: str | None = None) -> DataFrame:
        rows = t.filter(F.col("p").isin(TYPE, *paths, *([none] if none else [])))
        of = [F.max(F.when(F.col("p") == p, F.col("o"))).alias(f"_{p}") for p in paths]
        found = rows.groupBy("s").agg(F.max(F.when(F.col("p") == TYPE, F.col("o"))).alias("_kind"), F.count_if(F.col("p") == (none or "")).alias("_none"), *of)
        return found.filter(F.col("_kind").isin(*kinds) & (F.col("_none") == 0)).drop("_none")

    facts = subjects(["Fact"], "element", "period", "value", "unit", none="dimension").filter("_value IS NOT NULL").drop("s", "_kind")
    elements = subjects(["Element"], "qname", "label").select(F.col("s").alias("_element"), F.col("_qname").alias("concept"), F.col("_label").alias("name"))
    kind = duration_type(F.col("_start").cast("date"), F.col("_end").cast("date"))
    periods = subjects(["Duration", "Instant"], "start", "end").select(F.col("s").alias("_period"), F.col("_end").alias("end"), F.lower("_kind").alias("period_type"), kind.alias("duration_type"))
    units = subjects(["Unit"], "measure").select(F.col("s").alias("_unit"), F.col("_measure").alias("measure"))
    found = facts.join(elements, "_element").join(periods, "_period").join(units, "_unit", "left")
    return found.select("concept", "name", F.col("_value").alias("value"), "end", "period_type", "duration_type", "measure")


#: Shapes: class, path, rule (min, max count; node kind) and its argument.
SHAPES = [
    ("Fact", "element", "count", 1, 1), ("Fact", "period", "count", 1, 1), ("Fact", "inReport", "count", 1, 1), ("Fact", "value", "count", 0, 1), ("Fact", "unit", "count", 0, 1), ("Element", "qname", "count", 1, 1), ("Element", "balance", "count", 1, 1),
    ("Report", "reportedBy", "count", 1, 1), ("Association", "from", "count", 1, 1), ("Association", "to", "count", 1, 1), ("Association", "weight", "count", 0, 1), ("Network", "definition", "count", 1, 1), ("Fact", "element", "iri", None, None), ("Fact", "value", "literal", None, None),
]


def violations(t: DataFrame, shapes: list[tuple]) -> DataFrame:
    """(shape, path, rule, node): subjects of a class whose values of a path are too few, too many or of the wrong kind. One pass of counts by (subject, path)."""
    kind = t.filter(F.col("p") == TYPE).select("s", F.col("o").alias("shape"))
    counts = t.groupBy("s", F.col("p").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_kind") == "literal").alias("literals"))
    rules = t.sparkSession.createDataFrame(shapes, "shape string, path string, rule string, low int, high int")
    each = kind.join(F.broadcast(rules), "shape").join(counts, ["s", "path"], "left")  # a list of shapes: small by nature
    n, lits = F.coalesce("n", F.lit(0)), F.coalesce("literals", F.lit(0))
    bad = F.when(F.col("rule") == "count", (n < F.col("low")) | (n > F.col("high"))).when(F.col("rule") == "iri", lits > 0).otherwise(lits < n)
    return each.filter(bad).select("shape", "path", "rule", F.col("s").alias("node"))
