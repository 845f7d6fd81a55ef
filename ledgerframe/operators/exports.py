"""One writer for the exchange formats, for one report or a stack of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import documents
from ..sources.adapter import ReportSet
from . import graph, rdf

FORMATS = ("oim", "triples", "compiled", "equations", "graph", "csr")


def one_report(r: ReportSet, report_id: str) -> ReportSet:
    """The report alone: the filter reaches every table that carries report_id."""
    own = lambda df: df.filter(F.col("report_id") == report_id) if "report_id" in df.columns else df
    return ReportSet(*(own(getattr(r, x)) for x in ("reports", "facts", "concepts", "networks", "arcs")))


def stack_name(report_ids: list[str]) -> str:
    """Name of a stack: the common stem of its reports, or their number."""
    stems = {x.rpartition("-")[0] or x for x in report_ids}
    return f"{stems.pop()}-x{len(report_ids)}" if len(stems) == 1 else f"stack-x{len(report_ids)}"


def export(r: ReportSet, kind: str, path: str, report_id: str | None = None) -> None:
    """Writes a corpus, or one report of it, under path in one of FORMATS."""
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, not {kind!r}")
    r = one_report(r, report_id) if report_id else r
    if kind == "graph":
        return graph.write_parquet(graph.project(r), path)
    if kind == "csr":
        return graph.write_csr(graph.project(r), path)
    rows: DataFrame = {
        "oim": lambda: documents.oim_document(r.facts), "triples": lambda: rdf.named_graphs(rdf.triples(r)), "equations": lambda: documents.equation_nodes(r.networks, r.arcs),
        "compiled": lambda: documents.compiled_objects(r.concepts, r.networks, r.arcs, r.facts),
    }[kind]()
    rows.write.mode("overwrite").json(path)


def inline_fragments(facts: DataFrame, fragments: DataFrame) -> DataFrame:
    """Facts whose text is the address of a stored fragment(url, text) with the fragment's text; where none is stored the address stays."""
    f = fragments.select(F.col("url").alias("_url"), F.col("text").alias("_text"))
    return facts.join(f, F.col("value_str") == F.col("_url"), "left").withColumn("value_str", F.coalesce("_text", "value_str")).drop("_url", "_text")


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of first, and of second for keys that first lacks: a published copy before a fallback."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
