"""The property graph: projection of reports, stacking, compressed rows, pattern queries, sinks."""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import graph_id
from ..functions.periods import calendar_key, calendar_quarter, duration_type
from ..functions.text import local_name
from ..plans.graph_schema import EDGES, NODES, edge_columns, filled, node_columns
from ..sources.adapter import ReportSet
from .blocks import parse_title
from .facts import stated

REPORT_BASE, NAMESPACE, EXTENSION = "https://example.org/report/", "https://example.org/taxonomy/tb", "https://example.org/taxonomy/tb"


@dataclass
class GraphTables:
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)

    def counts(self) -> DataFrame:
        """(name, rows) of the tables that are present."""
        out = None
        for name, df in [*self.nodes.items(), *self.edges.items()]:
            row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
            out = row if out is None else out.unionByName(row)
        return out.filter("rows > 0")


def _element(qname: Column) -> Column:
    return graph_id("element", F.concat(F.lit(NAMESPACE + "#"), local_name(qname)))


def _report_uri(report_id: Column) -> Column:
    return F.concat(F.lit(REPORT_BASE), report_id)


def _period_uri(kind: Column, start: Column, end: Column) -> Column:
    base = "http://www.w3.org/2001/XMLSchema#dateTime#"
    return F.concat(F.lit(base), F.when(kind == "instant", end.cast("string")).when(kind == "forever", "Forever").otherwise(F.concat(start.cast("string"), F.lit("/"), end.cast("string"))))


def fact_nodes(facts: DataFrame) -> DataFrame:
    """Facts with their graph ids, one per content: repeated statements of one value at one coordinate are one fact (the first).

    The value is its text (value_str) where the facts have it, else the number; nil is a value of its own. Languages compare without case, and the entity
    (scheme, identifier) belongs to the coordinate where the facts state it."""
    value = F.coalesce(stated(facts, "value_str"), F.col("numeric_value").cast("string"))
    value = F.when(F.coalesce(stated(facts, "is_nil", "boolean"), F.lit(False)), F.struct(F.lit(True).alias("nil"), F.lit(None).cast("string").alias("v"))).otherwise(F.struct(F.lit(False).alias("nil"), value.alias("v")))
    content = W.partitionBy("report_id", "concept", "period_id", "unit_id", "dims_key", F.lower("language"), value, stated(facts, "entity_scheme"), stated(facts, "entity_identifier")).orderBy("seq")
    first = facts.withColumn("_n", F.row_number().over(content)).filter("_n = 1").drop("_n")
    uri = F.concat(_report_uri(F.col("report_id")), F.lit("#fact-"), F.col("seq").cast("string"))
    return first.withColumns({
        "uri": uri, "fact": graph_id("fact", uri), "element": _element(F.col("concept")), "report": graph_id("report", _report_uri(F.col("report_id"))),
        "unit": graph_id("unit", F.col("unit_id")), "period": graph_id("period", _period_uri(F.col("period_type"), F.col("start_date"), F.col("end_date"))),
    })


def dimension_rows(facts: DataFrame) -> DataFrame:
    """fact_nodes exploded to their dimensions: (report_id, fact, dimension, axis, member)."""
    each = facts.select("report_id", "fact", F.explode("dims").alias("d")).select("report_id", "fact", F.col("d.axis").alias("axis"), F.col("d.member").alias("member"))
    uri = lambda q: F.concat(F.lit(NAMESPACE + "#"), local_name(q))
    name = F.concat(_report_uri(F.col("report_id")), F.lit("#dimension-"), uri(F.col("axis")), F.lit("-"), uri(F.col("member")))
    return each.withColumns({"dimension": graph_id("dimension", name), "axis_uri": uri(F.col("axis")), "member_uri": uri(F.col("member"))})


def project(r: ReportSet) -> GraphTables:
    """Node and edge tables of a corpus. Elements appear only where something refers to them; each id stands once."""
    facts = fact_nodes(r.facts)
    dims = dimension_rows(facts)
    arcs = r.arcs.join(r.networks.select(F.col("seq").alias("network_seq"), "role_uri", "kind"), "network_seq")
    assoc_key = F.concat_ws("#", F.col("role_uri"), "arcrole", "from_qname", "to_qname", F.coalesce(F.col("arc_order").cast("string"), F.lit("")), F.coalesce("preferred_label", F.lit("")))
    arcs = arcs.withColumns({"association": graph_id("association", assoc_key), "structure": graph_id("structure", F.col("role_uri"))})
    cited = facts.select("concept").unionByName(dims.select(F.explode(F.array("axis", "member")).alias("concept"))).unionByName(arcs.select(F.explode(F.array("from_qname", "to_qname")).alias("concept"))).distinct()
    concepts = r.concepts.join(cited.withColumnRenamed("concept", "qname"), "qname", "left_semi")
    c = F.col
    flags = {x: c(x) for x in ("is_abstract", "is_numeric", "is_textblock", "is_hypercube_item", "is_dimension_item", "is_domain_member", "period_type", "balance", "qname")}
    labels = concepts.filter("label IS NOT NULL").select("qname", "label", graph_id("label", F.concat(c("label"), F.lit("#label#en"))).alias("label_id"))
    g = GraphTables()
    one = lambda df: df.dropDuplicates(["identifier"])  # noqa: E731  rows of one id are equal: the id hashes what they hold
    g.nodes["Entity"] = one(r.reports.select(*filled("Entity", {"identifier": graph_id("entity", F.concat(F.lit("nation#"), c("entity_cik").cast("string"))), "scheme": F.lit("nation"), "cik": c("entity_cik").cast("string"), "name": c("entity_name"), "is_parent": F.lit(True)})))
    g.nodes["Report"] = r.reports.select(*filled("Report", {"identifier": graph_id("report", _report_uri(c("report_id"))), "uri": _report_uri(c("report_id")), "accession_number": c("report_id"), "form": F.lit("10-K"), "fiscal_year_focus": c("fiscal_year")}))
    g.nodes["Taxonomy"] = r.reports.limit(1).select(*filled("Taxonomy", {"identifier": graph_id("taxonomy", F.lit(EXTENSION)), "uri": F.lit(EXTENSION), "namespace": F.lit(EXTENSION)}))
    g.nodes["Element"] = concepts.select(*filled("Element", flags | {"identifier": _element(c("qname")), "uri": F.concat(F.lit(NAMESPACE + "#"), local_name(c("qname"))), "name": local_name(c("qname"))}))
    g.nodes["Label"] = one(labels.select(*filled("Label", {"identifier": c("label_id"), "value": c("label"), "type": F.lit("label"), "language": F.lit("en")})))
    s, e, k = c("start_date"), c("end_date"), c("period_type")
    g.nodes["Period"] = one(facts.select("period", "period_type", "start_date", "end_date").distinct().select(*filled("Period", {
        "identifier": c("period"), "uri": _period_uri(k, s, e), "start_date": s.cast("string"), "end_date": e.cast("string"), "calendar_year": F.year(e), "calendar_quarter": calendar_quarter(s, e),
        "days_in_period": F.coalesce(F.datediff(e, s) + 1, F.lit(1)), "period_type": k, "duration_type": duration_type(s, e), "calendar_period_key": calendar_key(s, e)})))
    g.nodes["Unit"] = one(facts.filter("unit_id IS NOT NULL").select(*filled("Unit", {"identifier": c("unit"), "uri": c("unit_id"), "measure": c("unit_id"), "value": c("unit_id")})))
    number = c("unit_id").isNotNull()
    g.nodes["Fact"] = facts.select(*filled("Fact", {
        "identifier": c("fact"), "uri": c("uri"), "value": F.coalesce(stated(facts, "value_str"), c("numeric_value").cast("decimal(38,2)").cast("string")), "numeric_value": F.when(number, c("numeric_value")), "fact_type": F.when(number, "Numeric").otherwise("Nonnumeric"),
        "decimals": F.when(number, c("decimals")), "value_type": F.lit("inline"), "content_type": F.lit(None), "has_dimensions": c("dim_count") > 0, "dimension_count": c("dim_count")}))
    g.nodes["Dimension"] = one(dims.select(*filled("Dimension", {"identifier": c("dimension"), "axis": c("axis"), "member": c("member"), "dimension_type": F.lit("segment"), "axis_uri": c("axis_uri"), "member_uri": c("member_uri"), "is_explicit": F.lit(True), "is_typed": F.lit(False)})))
    title = parse_title(c("definition"))
    first = r.networks.groupBy("role_uri").agg(F.min_by("definition", "seq").alias("definition"))
    g.nodes["Structure"] = first.select(*filled("Structure", {"identifier": graph_id("structure", c("role_uri")), "uri": c("role_uri"), "network_uri": c("role_uri"), "definition": c("definition"), "number": title["number"], "type": title["category"], "name": title["name"]}))
    g.nodes["Association"] = one(arcs.select(*filled("Association", {"identifier": c("association"), "arcrole": c("arcrole"), "order_value": c("arc_order"), "association_type": c("kind"), "weight": c("weight"), "preferred_label": c("preferred_label")})))
    pair = lambda df, a, b: df.select(a.alias("from"), b.alias("to")).filter("`from` IS NOT NULL AND `to` IS NOT NULL").distinct()
    g.edges["ELEMENT_HAS_LABEL"] = pair(labels, _element(c("qname")), c("label_id"))
    g.edges["DIMENSION_HAS_AXIS_ELEMENT"] = pair(dims, c("dimension"), _element(c("axis")))
    g.edges["DIMENSION_HAS_MEMBER_ELEMENT"] = pair(dims, c("dimension"), _element(c("member")))
    g.edges["STRUCTURE_HAS_TAXONOMY"] = pair(first, graph_id("structure", c("role_uri")), graph_id("taxonomy", F.lit(EXTENSION)))
    g.edges["STRUCTURE_HAS_ASSOCIATION"] = pair(arcs, c("structure"), c("association"))
    g.edges["ASSOCIATION_HAS_FROM_ELEMENT"] = pair(arcs, c("association"), _element(c("from_qname")))
    g.edges["ASSOCIATION_HAS_TO_ELEMENT"] = pair(arcs, c("association"), _element(c("to_qname")))
    report = graph_id("report", _report_uri(c("report_id")))
    g.edges["ENTITY_HAS_REPORT"] = pair(r.reports, graph_id("entity", F.concat(F.lit("nation#"), c("entity_cik").cast("string"))), report)
    g.edges["REPORT_USES_TAXONOMY"] = pair(r.reports, report, graph_id("taxonomy", F.lit(EXTENSION)))
    # Fact ids are unique, so the edges of facts need no distinct.
    of = lambda b: facts.select(c("fact").alias("from"), c(b).alias("to")).filter("`to` IS NOT NULL")
    g.edges["REPORT_HAS_FACT"] = facts.select(c("report").alias("from"), c("fact").alias("to"))
    g.edges |= {"FACT_HAS_ELEMENT": of("element"), "FACT_HAS_PERIOD": of("period"), "FACT_HAS_UNIT": of("unit")}
    who = facts.join(r.reports.select("report_id", "entity_cik"), "report_id")
    g.edges["FACT_HAS_ENTITY"] = who.select(c("fact").alias("from"), graph_id("entity", F.concat(F.lit("nation#"), c("entity_cik").cast("string"))).alias("to"))
    g.edges["FACT_HAS_DIMENSION"] = dims.select(c("fact").alias("from"), c("dimension").alias("to"))
    return g


#: Role flags of an element that stacking combines by OR.
ROLE_FLAGS = ("is_dimension_item", "is_domain_member", "is_hypercube_item")


def merge_nodes(name: str, rows: DataFrame, recency: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts) of stacked rows of a node table: each id once; conflicts lists ids whose rows differ.

    Entities take the row that is newest by `recency`; elements take their role flags from any row. Elsewhere differing rows are conflicts, for the caller to refuse.
    """
    columns = [c for c, _ in node_columns(name)]
    if name == "Entity" and recency:
        newest = W.partitionBy("identifier").orderBy(*[F.desc_nulls_last(c) for c in recency])
        return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select(*columns), rows.select("identifier").limit(0)
    fixed = [c for c in columns if c != "identifier" and not (name == "Element" and c in ROLE_FLAGS)]
    flags = [c for c in columns if name == "Element" and c in ROLE_FLAGS]
    body = F.struct(*fixed)
    merged = rows.groupBy("identifier").agg(F.min(body).alias("low"), F.max(body).alias("high"), *[F.bool_or(c).alias(c) for c in flags])
    out = merged.select("identifier", "low.*", *flags).select(*columns)
    return out, merged.filter("low <> high").select("identifier")


def merge_edges(rows: DataFrame) -> DataFrame:
    return rows.distinct()


def offsets(nodes: DataFrame, digits: int = 2) -> DataFrame:
    """(identifier, offset): places from 0 in order of identifier, without a global sort in one task.

    Identifiers are UUIDs, even over their first hex digits: rows are numbered inside such buckets, and the bucket sizes give each its start.
    """
    bucket = F.substring("identifier", 1, digits)
    sizes = nodes.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))  # 16 ** digits rows at most
    starts = sizes.select("b", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inner = nodes.select("identifier", bucket.alias("b")).withColumn("i", F.row_number().over(W.partitionBy("b").orderBy("identifier")) - 1)
    return inner.join(F.broadcast(starts), "b").select("identifier", (F.col("start") + F.col("i")).alias("offset"))


def csr(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(indices, indptr, dangling) of an edge table over node offsets: indices (source, target) in order, indptr (source, pointer, degree) where a
    source's edges begin, dangling edges with an endpoint in neither table."""
    s, t = offsets(sources), offsets(targets)
    placed = edges.join(s.select(F.col("identifier").alias("from"), F.col("offset").alias("source")), "from", "left").join(t.select(F.col("identifier").alias("to"), F.col("offset").alias("target")), "to", "left")
    dangling = placed.filter("source IS NULL OR target IS NULL").select("from", "to")
    indices = placed.filter("source IS NOT NULL AND target IS NOT NULL").select("source", "target")
    degree = s.select("offset", "identifier").join(indices.groupBy("source").agg(F.count(F.lit(1)).alias("degree")), F.col("offset") == F.col("source"), "left").select("identifier", F.col("offset").alias("source"), F.coalesce("degree", F.lit(0)).alias("degree"))
    bucket = F.substring("identifier", 1, 2)
    sums = degree.groupBy(bucket.alias("b")).agg(F.sum("degree").alias("n"))
    starts = sums.select("b", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inner = degree.withColumn("b", bucket).withColumn("i", F.coalesce(F.sum("degree").over(W.partitionBy("b").orderBy("source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return indices, inner.join(F.broadcast(starts), "b").select("source", (F.col("start") + F.col("i")).alias("pointer"), "degree"), dangling


class Pattern:
    """A typed path through the graph, compiled to joins: Pattern(g, "Fact").out("FACT_HAS_ELEMENT").where(...).select(...).

    Columns of the i-th node are named n<i>_<column>; only relationship types of the schema are allowed, and every step names one.
    """

    def __init__(self, graph: GraphTables, node: str):
        self.graph, self.at, self.kind = graph, 0, node
        self.df = self._node(node, 0)

    def _node(self, name: str, i: int) -> DataFrame:
        return self.graph.nodes[name].select(*[F.col(c).alias(f"n{i}_{c}") for c, _ in node_columns(name)])

    def _step(self, edge: str, back: bool) -> Pattern:
        a, b, _ = EDGES[edge]
        here, there = (b, a) if back else (a, b)
        if self.kind != here:
            raise ValueError(f"{edge} does not {'end' if back else 'start'} at {self.kind}")
        e = self.graph.edges[edge].select(F.col("to" if back else "from").alias("_here"), F.col("from" if back else "to").alias("_there"))
        i = self.at + 1
        self.df = self.df.join(e, F.col(f"n{self.at}_identifier") == F.col("_here")).drop("_here").join(self._node(there, i), F.col("_there") == F.col(f"n{i}_identifier")).drop("_there")
        self.at, self.kind = i, there
        return self

    def out(self, edge: str) -> Pattern:
        return self._step(edge, False)

    def back(self, edge: str) -> Pattern:
        return self._step(edge, True)

    def where(self, condition: str | Column) -> Pattern:
        self.df = self.df.filter(condition)
        return self

    def select(self, *columns: str | Column, limit: int | None = None) -> DataFrame:
        out = self.df.select(*columns)
        return out.limit(limit) if limit else out


#: Commands that only read.
READING_COMMANDS = {"DescribeRelation", "DescribeQueryCommand", "DescribeColumn", "DescribeFunction", "ExplainCommand", "ShowTables", "ShowColumns", "ShowFunctions", "ShowNamespaces", "ShowViews"}


def check_query(sql: str, spark: SparkSession | None = None) -> None:
    """Raises unless sql is one statement that reads, as Spark's own parser sees it: no node of its plan is a command that changes anything."""
    spark = spark or SparkSession.active()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except (ParseException, Py4JJavaError) as e:
        raise ValueError("only a single reading statement is allowed") from e
    loaded = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    command = loaded.loadClass("org.apache.spark.sql.catalyst.plans.logical.Command")
    open_nodes = [plan]
    while open_nodes:
        node = open_nodes.pop()
        name = node.getClass().getSimpleName()
        if (command.isInstance(node) or name.startswith("Insert")) and name not in READING_COMMANDS:
            raise ValueError("only a single reading statement is allowed")
        for group in (node.children(), node.innerChildren()):
            open_nodes += [x for x in (group.apply(i) for i in range(group.size())) if hasattr(x, "innerChildren")]


def run_sql(graph: GraphTables, sql: str, limit: int = 200, tag: str | None = None) -> tuple[DataFrame, int]:
    """(at most limit rows, true row count) of a reading statement over views named like the tables. A tag lets the caller interrupt it (interruptTag)."""
    spark = next(iter(graph.nodes.values())).sparkSession
    check_query(sql, spark)
    for name, df in [*graph.nodes.items(), *graph.edges.items()]:
        df.createOrReplaceTempView(name)
    if tag:
        spark.addTag(tag)
    try:
        rows = spark.sql(sql)
        return rows.limit(limit), rows.count()
    finally:
        if tag:
            spark.removeTag(tag)


def write_parquet(graph: GraphTables, path: str) -> None:
    """nodes/<Name> and relationships/<NAME>, columns in schema order; tables without rows are left out."""
    for kind, tables, columns in (("nodes", graph.nodes, node_columns), ("relationships", graph.edges, edge_columns)):
        for name, df in tables.items():
            if not df.isEmpty():
                df.select(*[F.col(f"`{c}`") for c, _ in columns(name) if c in df.columns]).write.mode("overwrite").parquet(f"{path}/{kind}/{name}")


def read_parquet(spark: SparkSession, path: str) -> GraphTables:
    """The graph that write_parquet wrote; tables without rows are not there."""
    out = GraphTables()
    for kind, tables, names, columns in (("nodes", out.nodes, NODES, node_columns), ("relationships", out.edges, EDGES, edge_columns)):
        for name in names:
            schema = ", ".join(f"`{c}` {t}" for c, t in columns(name))  # declared: no file is opened to learn it
            try:
                tables[name] = spark.read.schema(schema).parquet(f"{path}/{kind}/{name}")
            except AnalysisException:  # left out, being empty
                continue
    return out


def save_tables(graph: GraphTables, database: str) -> None:
    """The graph as tables of a Spark database."""
    spark = next(iter(graph.nodes.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, df in [*graph.nodes.items(), *graph.edges.items()]:
        df.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")


def write_csr(graph: GraphTables, path: str) -> None:
    """nodes_<Name>, indices_<NAME> and indptr_<NAME> as Parquet, in order of offset; an edge without an endpoint is an error."""
    for name, df in graph.nodes.items():
        df.join(offsets(df), "identifier").orderBy("offset").select(*[c for c, _ in node_columns(name)]).write.mode("overwrite").parquet(f"{path}/nodes_{name}")
    for name, df in graph.edges.items():
        a, b, _ = EDGES[name]
        indices, indptr, dangling = csr(df, graph.nodes[a], graph.nodes[b])
        if not dangling.isEmpty():
            raise ValueError(f"{name} has an edge to a node that is not in the tables")
        indices.orderBy("source", "target").select("target").write.mode("overwrite").parquet(f"{path}/indices_{name}")
        indptr.orderBy("source").select("pointer").write.mode("overwrite").parquet(f"{path}/indptr_{name}")


ALL_NODE_TABLES = tuple(NODES)
