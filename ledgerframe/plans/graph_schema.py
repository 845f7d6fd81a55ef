"""Declared tables of the property graph: ordered columns, types, DDL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Node tables and their columns in order, with types; the first is the key.
NODES: dict[str, list[tuple[str, str]]] = {
    "Entity": [
        ("identifier", "STRING"),
        ("uri", "STRING"),
        ("scheme", "STRING"),
        ("cik", "STRING"),
        ("ticker", "STRING"),
        ("exchange", "STRING"),
        ("name", "STRING"),
        ("legal_name", "STRING"),
        ("industry", "STRING"),
        ("entity_type", "STRING"),
        ("sic", "STRING"),
        ("sic_description", "STRING"),
        ("category", "STRING"),
        ("state_of_incorporation", "STRING"),
        ("fiscal_year_end", "STRING"),
        ("tax_id", "STRING"),
        ("lei", "STRING"),
        ("phone", "STRING"),
        ("website", "STRING"),
        ("status", "STRING"),
        ("is_parent", "BOOLEAN"),
        ("parent_entity_id", "STRING"),
        ("created_at", "STRING"),
        ("updated_at", "STRING"),
    ],
    "Period": [
        ("identifier", "STRING"),
        ("uri", "STRING"),
        ("start_date", "STRING"),
        ("end_date", "STRING"),
        ("calendar_year", "INT"),
        ("calendar_quarter", "STRING"),
        ("days_in_period", "INT"),
        ("period_type", "STRING"),
        ("duration_type", "STRING"),
        ("calendar_period_key", "STRING"),
    ],
    "Unit": [
        ("identifier", "STRING"),
        ("uri", "STRING"),
        ("measure", "STRING"),
        ("value", "STRING"),
        ("numerator_uri", "STRING"),
        ("denominator_uri", "STRING"),
    ],
    "Element": [
        ("identifier", "STRING"),
        ("uri", "STRING"),
        ("qname", "STRING"),
        ("name", "STRING"),
        ("period_type", "STRING"),
        ("type", "STRING"),
        ("balance", "STRING"),
        ("is_abstract", "BOOLEAN"),
        ("is_dimension_item", "BOOLEAN"),
        ("is_domain_member", "BOOLEAN"),
        ("is_hypercube_item", "BOOLEAN"),
        ("is_integer", "BOOLEAN"),
        ("is_numeric", "BOOLEAN"),
        ("is_shares", "BOOLEAN"),
        ("is_fraction", "BOOLEAN"),
        ("is_textblock", "BOOLEAN"),
        ("substitution_group", "STRING"),
        ("item_type", "STRING"),
        ("canonical_concept", "STRING"),
        ("canonical_confidence", "DOUBLE"),
    ],
    "Label": [
        ("identifier", "STRING"),
        ("value", "STRING"),
        ("type", "STRING"),
        ("language", "STRING"),
    ],
    "Reference": [
        ("identifier", "STRING"),
        ("value", "STRING"),
        ("type", "STRING"),
    ],
    "Taxonomy": [
        ("identifier", "STRING"),
        ("uri", "STRING"),
        ("name", "STRING"),
        ("version", "STRING"),
        ("namespace", "STRING"),
        ("description", "STRING"),
        ("taxonomy_type", "STRING"),
    ],
    "Dimension": [
        ("identifier", "STRING"),
        ("axis", "STRING"),
        ("member", "STRING"),
        ("dimension_type", "STRING"),
        ("axis_uri", "STRING"),
        ("member_uri", "STRING"),
        ("type", "STRING"),
        ("is_explicit", "BOOLEAN"),
        ("is_typed", "BOOLEAN"),
    ],
    "Structure": [
        ("identifier", "STRING"),
        ("uri", "STRING"),
        ("network_uri", "STRING"),
        ("definition", "STRING"),
        ("number", "STRING"),
        ("type", "STRING"),
        ("name", "STRING"),
        ("canonical_type", "STRING"),
        ("canonical_confidence", "DOUBLE"),
    ],
    "Association": [
        ("identifier", "STRING"),
        ("arcrole", "STRING"),
        ("order_value", "DOUBLE"),
        ("association_type", "STRING"),
        ("weight", "DOUBLE"),
        ("root", "STRING"),
        ("preferred_label", "STRING"),
    ],
    "Classification": [
        ("identifier", "STRING"),
        ("category", "STRING"),
        ("type", "STRING"),
        ("source", "STRING"),
        ("confidence", "DOUBLE"),
    ],
    "Report": [
        ("identifier", "STRING"),
        ("uri", "STRING"),
        ("name", "STRING"),
        ("accession_number", "STRING"),
        ("form", "STRING"),
        ("filing_date", "STRING"),
        ("report_date", "STRING"),
        ("acceptance_date", "STRING"),
        ("is_inline_xbrl", "BOOLEAN"),
        ("xbrl_processor_version", "STRING"),
        ("processed", "BOOLEAN"),
        ("failed", "BOOLEAN"),
        ("updated_at", "STRING"),
        ("fiscal_year_focus", "INT"),
        ("fiscal_period_focus", "STRING"),
        ("fiscal_year_end_month", "INT"),
    ],
    "Fact": [
        ("identifier", "STRING"),
        ("uri", "STRING"),
        ("value", "STRING"),
        ("numeric_value", "DOUBLE"),
        ("fact_type", "STRING"),
        ("decimals", "STRING"),
        ("value_type", "STRING"),
        ("content_type", "STRING"),
        ("has_dimensions", "BOOLEAN"),
        ("dimension_count", "BIGINT"),
    ],
    "FactSet": [
        ("identifier", "STRING"),
        ("factset_type", "STRING"),
        ("provenance", "STRING"),
    ],
}
#: Relationship tables: source, target, further columns with types.
EDGES: dict[str, tuple[str, str, list[tuple[str, str]]]] = {
    "ELEMENT_HAS_LABEL": ("Element", "Label", []),
    "ELEMENT_HAS_REFERENCE": ("Element", "Reference", []),
    "TAXONOMY_HAS_LABEL": ("Taxonomy", "Label", [("element_uri", "STRING")]),
    "TAXONOMY_HAS_REFERENCE": ("Taxonomy", "Reference", []),
    "DIMENSION_HAS_AXIS_ELEMENT": ("Dimension", "Element", []),
    "DIMENSION_HAS_MEMBER_ELEMENT": ("Dimension", "Element", []),
    "STRUCTURE_HAS_TAXONOMY": ("Structure", "Taxonomy", []),
    "STRUCTURE_HAS_ASSOCIATION": ("Structure", "Association", []),
    "ASSOCIATION_HAS_FROM_ELEMENT": ("Association", "Element", []),
    "ASSOCIATION_HAS_TO_ELEMENT": ("Association", "Element", []),
    "ASSOCIATION_HAS_CLASSIFICATION": ("Association", "Classification", []),
    "ENTITY_HAS_REPORT": ("Entity", "Report", []),
    "REPORT_HAS_FACT": ("Report", "Fact", []),
    "FACT_HAS_ELEMENT": ("Fact", "Element", []),
    "FACT_HAS_ENTITY": ("Fact", "Entity", []),
    "FACT_HAS_PERIOD": ("Fact", "Period", []),
    "FACT_HAS_UNIT": ("Fact", "Unit", []),
    "FACT_HAS_DIMENSION": ("Fact", "Dimension", []),
    "FACT_SET_CONTAINS_FACT": ("FactSet", "Fact", []),
    "STRUCTURE_HAS_FACT_SET": ("Structure", "FactSet", []),
    "REPORT_HAS_FACT_SET": ("Report", "FactSet", []),
    "REPORT_USES_TAXONOMY": ("Report", "Taxonomy", []),
}
#: Tables that only enrichment fills.
ENRICHMENT = {"FactSet", "Classification", "FACT_SET_CONTAINS_FACT", "STRUCTURE_HAS_FACT_SET", "REPORT_HAS_FACT_SET", "ASSOCIATION_HAS_CLASSIFICATION"}
_DEFAULTS = {"STRING": "", "INT": 0, "BIGINT": 0, "DOUBLE": 0.0, "BOOLEAN": False}


def node_columns(name: str) -> list[tuple[str, str]]:
    return list(NODES[name])


def edge_columns(name: str) -> list[tuple[str, str]]:
    return [("from", "STRING"), ("to", "STRING"), *EDGES[name][2]]


def node_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in node_columns(name)))


def filled(name: str, given: dict[str, Column]) -> list[Column]:
    """The declared columns of a node table: given ones as they are, absent ones at their type's default."""
    return [(given[c] if c in given else F.lit(_DEFAULTS[t])).cast(t).alias(c) for c, t in node_columns(name)]


def ddl() -> list[str]:
    """CREATE statements of all node and relationship tables."""
    words = {"INT": "INT32", "BIGINT": "INT64", "BOOLEAN": "BOOLEAN", "DOUBLE": "DOUBLE", "STRING": "STRING"}
    nodes = [f"CREATE NODE TABLE {n} ({', '.join(f'{c} {words[t]}' for c, t in node_columns(n))}, PRIMARY KEY (identifier))" for n in NODES]
    return nodes + [f"CREATE REL TABLE {n} (FROM {a} TO {b}{''.join(f', {c} {t}' for c, t in more)})" for n, (a, b, more) in EDGES.items()]
