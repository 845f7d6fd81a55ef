"""Fact selection: consolidated facts, duplicates, requests by name, grids, and why a request came back empty.

All operators take facts with report_id, seq, concept, period_id, period_type, start_date, end_date, unit_id, dims (array<struct<axis, member>>),
dims_key, dim_count, numeric_value, decimals, language (and, for texts, value_str and is_nil), and keep to one report by partitioning on report_id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.periods import BUCKETS, duration_type, span_days
from ..functions.text import local_name, squash
from ..functions.values import precision

COORDINATE = ["report_id", "concept", "period_id", "unit_id", "dims_key", "language"]
MAX_GRID_ROWS = 500


def stated(facts: DataFrame, name: str, kind: str = "string") -> Column:
    """A column that facts may lack: null then."""
    return F.col(name).cast(kind) if name in facts.columns else F.lit(None).cast(kind)


def report_keys(*tables: DataFrame) -> list[str]:
    """["report_id"] where networks, arcs or concepts belong to reports, [] where one taxonomy serves all."""
    return ["report_id"] if all("report_id" in t.columns for t in tables) else []


def consolidated(facts: DataFrame) -> DataFrame:
    """Facts without a dimension."""
    return facts.filter(F.col("dim_count") == 0)


def most_precise(facts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One fact per coordinate: the most precise, the first of equals."""
    order = W.partitionBy(*(by or COORDINATE)).orderBy(precision(F.col("decimals")).desc(), F.col("seq"))
    return facts.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def latest_grid(facts: DataFrame) -> DataFrame:
    """Consolidated facts, one per (report, concept, end): the longest span, then the most precise, then the first."""
    order = W.partitionBy("report_id", "concept", "end_date").orderBy(span_days(F.col("start_date"), F.col("end_date")).desc(), precision(F.col("decimals")).desc(), F.col("seq"))
    return consolidated(facts).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def period_filter(period_end: str | None = None, period_type: str | None = None) -> Column:
    """Predicate by end date (YYYY-MM-DD), end year (YYYY), instant / duration or duration bucket; other values are errors."""
    keep = F.lit(True)
    end, kind = (period_end or "").strip(), (period_type or "").strip().lower()
    if end:
        if re.fullmatch(r"\d{4}", end):
            keep &= F.year("end_date") == int(end)
        elif re.fullmatch(r"\d{4}-\d{2}-\d{2}", end[:10]):
            keep &= F.col("end_date") == F.lit(end[:10]).cast("date")
        else:
            raise ValueError(f"period_end must be YYYY-MM-DD or YYYY, not {period_end!r}")
    if kind in ("instant", "duration"):
        keep &= F.col("period_type") == kind
    elif kind in BUCKETS:
        keep &= (F.col("period_type") == "duration") & (duration_type(F.col("start_date"), F.col("end_date")) == kind)
    elif kind:
        raise ValueError(f"period_type must be instant, duration or one of {', '.join(BUCKETS)}, not {period_type!r}")
    return keep


def member_filter(axis: str | None = None, member: str | None = None) -> Column:
    """Dimensional facts whose dimensions hold the axis and the member as lower-case substrings, on any dimension each."""
    keep = F.col("dim_count") > 0
    if axis:
        keep &= F.exists("dims", lambda d: F.contains(F.lower(d["axis"]), F.lit(axis.strip().lower())))
    if member:
        keep &= F.exists("dims", lambda d: F.contains(F.lower(F.coalesce(d["member"], F.lit(""))), F.lit(member.strip().lower())))
    return keep


def requested(spark: SparkSession, names: list[str]) -> DataFrame:
    rows = [(i, n.strip()) for i, n in enumerate(names) if n and n.strip()]
    return spark.createDataFrame(rows, "at int, name string")


def resolve_concepts(names: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, unresolved) of names(at, name): hits (at, qname) in request order, each concept once.

    A prefixed name matches its concept whatever the case, else like a bare one: every concept of that local name.
    """
    keys = concepts.select("qname", F.lower("qname").alias("k"), F.lower(local_name(F.col("qname"))).alias("l"))
    whole = names.filter(F.contains("name", F.lit(":"))).join(keys.select("qname", "k"), F.lower("name") == F.col("k")).select("at", "name", "qname")
    rest = names.join(whole.select("at"), "at", "left_anti")
    bare = F.lower(F.regexp_replace("name", "^[^:]*:", ""))
    local = rest.join(keys.select("qname", "l"), bare == F.col("l")).select("at", "name", "qname")
    hits = whole.unionByName(local)
    first = hits.groupBy("qname").agg(F.min("at").alias("at"))
    return first.select("at", "qname"), names.join(hits.select("at").distinct(), "at", "left_anti")


def fact_grid(facts: DataFrame, wanted: DataFrame, period_end: str | None = None, period_type: str | None = None, dimensional: bool = False, axis: str | None = None, member: str | None = None, limit: int = 200) -> DataFrame:
    """Facts of wanted(at, qname): consolidated unless dimensions are asked for, most precise duplicate, newest first.

    rank is the place in the report's grid, total its length before the limit (at most MAX_GRID_ROWS rows of a report), truncated whether rows are missing.
    """
    # The request is a list of names: small by nature, and Spark broadcasts it by its size.
    kept = facts.join(wanted.select(F.col("qname").alias("concept"), "at"), "concept").filter(period_filter(period_end, period_type))
    kept = kept.filter(member_filter(axis, member)) if axis or member else kept if dimensional else consolidated(kept)
    order = W.partitionBy("report_id").orderBy(F.col("end_date").desc_nulls_last(), "at", "dim_count", "dims_key", "seq")
    out = most_precise(kept).withColumns({"rank": F.row_number().over(order), "total": F.count(F.lit(1)).over(W.partitionBy("report_id"))})
    most = max(1, min(limit, MAX_GRID_ROWS))
    return out.withColumn("truncated", F.col("total") > most).filter(F.col("rank") <= most).drop("at")


def excluded(facts: DataFrame, wanted: DataFrame, concepts: DataFrame, reports: DataFrame, period_end: str | None = None, period_type: str | None = None, dimensional: bool = False, axis: str | None = None, member: str | None = None) -> DataFrame:
    """(report_id, concept, facts, reason) of requested concepts without a row in the grid, from one pass of conditional counts."""
    keep = F.coalesce(period_filter(period_end, period_type), F.lit(False))
    shown = keep & (member_filter(axis, member) if axis or member else F.lit(True) if dimensional else F.col("dim_count") == 0)
    counts = facts.groupBy("report_id", "concept").agg(F.count(F.lit(1)).alias("facts"), F.count_if(keep).alias("kept"), F.count_if(shown).alias("shown"), F.count_if(F.col("period_type") != "instant").alias("not_instant"), F.count_if(F.col("period_type") != "duration").alias("not_duration"))
    asked = reports.select("report_id").crossJoin(F.broadcast(wanted.select(F.col("qname").alias("concept")))).join(concepts.select(F.col("qname").alias("concept"), "is_abstract", "is_domain_member", "is_dimension_item"), "concept")
    kind = (period_type or "").strip().lower()
    n = F.coalesce("facts", F.lit(0))
    spans, points = F.lit(kind == "duration" or kind in BUCKETS), F.lit(kind == "instant")
    reason = (
        F.when((n == 0) & F.col("is_abstract") & ~F.col("is_domain_member") & ~F.col("is_dimension_item"), "abstract").when((n == 0) & F.col("is_domain_member"), "domain member").when((n == 0) & F.col("is_dimension_item"), "axis").when(n == 0, "never tagged")
        .when((F.col("kept") == 0) & spans & (F.col("not_instant") == 0), "instants only").when((F.col("kept") == 0) & points & (F.col("not_duration") == 0), "durations only").when(F.col("kept") == 0, "no fact in the periods")
        .when(F.lit(bool(axis or member)), "no matching member").otherwise("dimensional only")
    )
    return asked.join(counts, ["report_id", "concept"], "left").filter(F.coalesce("shown", F.lit(0)) == 0).select("report_id", "concept", n.alias("facts"), reason.alias("reason"))


def rank_concepts(concepts: DataFrame, facts: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(qname, score, facts, rank) of concepts that a phrase may mean: exact, name or label, loose, prefix, all words in the name, in a label, part."""
    q = query.strip().lower()
    words = [w for w in re.split(r"[\s_\-]+", q) if w]
    flat = re.sub("[^a-z0-9]", "", q).removesuffix("s")
    local, label = F.lower(local_name(F.col("qname"))), F.lower(F.coalesce("label", F.lit("")))
    singular = lambda c: F.regexp_replace(c, "s$", "")
    every = lambda c: F.lit(bool(words)) & F.array_min(F.array(*[F.contains(c, F.lit(w)) for w in words] or [F.lit(False)]))
    score = (
        F.when(F.lower("qname") == q, 100).when((local == q) | (label == q), 90).when(F.lit(bool(flat)) & ((singular(local) == flat) | (singular(squash(label)) == flat)), 90)
        .when(local.startswith(q) | label.startswith(q), 70).when(every(local), 60).when(every(label), 50).when(F.contains(F.lower("qname"), F.lit(q)), 40).otherwise(0)
    )
    counts = facts.groupBy(F.col("concept").alias("qname")).agg(F.count(F.lit(1)).alias("facts"))
    scored = concepts.filter(~F.col("is_hypercube_item") & ~F.col("is_dimension_item")).withColumn("score", score).filter("score > 0").join(counts, "qname", "left").withColumn("facts", F.coalesce("facts", F.lit(0)))
    best = [F.desc("score"), F.desc("facts"), F.col("is_abstract"), ~F.col("is_numeric"), F.length(local), F.col("qname")]
    top = scored.orderBy(*best).limit(max(1, min(limit, 100)))
    return top.withColumn("rank", F.row_number().over(W.orderBy(*best))).select("qname", "score", "facts", "rank")


def content_dedup(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """First row of each content key, by order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def describe(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """Counts per report in one pass: facts, numeric, consolidated, dimensional, concepts, periods, units, text blocks."""
    by = report_keys(concepts)
    with_kind = facts.join(concepts.select(*by, F.col("qname").alias("concept"), "is_textblock"), [*by, "concept"], "left")
    number = F.col("numeric_value").isNotNull()
    return with_kind.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("facts"), F.count_if(number).alias("numeric_facts"), F.count_if(number & (F.col("dim_count") == 0)).alias("consolidated_numeric"), F.count_if(F.col("dim_count") > 0).alias("dimensional"),
        F.count_if(F.col("is_textblock")).alias("text_blocks"), F.count_distinct("concept").alias("concepts"), F.count_distinct("period_id").alias("periods"), F.count_distinct("unit_id").alias("units"),
    )


def axis_census(facts: DataFrame) -> DataFrame:
    """(report_id, axis, members, uses): distinct members and dimension uses of each axis."""
    each = facts.select("report_id", F.explode("dims").alias("d"))
    return each.groupBy("report_id", F.col("d.axis").alias("axis")).agg(F.count_distinct("d.member").alias("members"), F.count(F.lit(1)).alias("uses"))


def period_census(facts: DataFrame, top: int = 30) -> DataFrame:
    """(report_id, period_id, facts) of the busiest periods of each report; ties to the later end, then the key."""
    counts = facts.groupBy("report_id", "period_id", "end_date").agg(F.count(F.lit(1)).alias("facts"))
    order = W.partitionBy("report_id").orderBy(F.desc("facts"), F.desc_nulls_last("end_date"), "period_id")
    return counts.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top).drop("_n", "end_date")


def default_language(facts: DataFrame) -> DataFrame:
    """(report_id, language): the most frequent language of a report's text facts; ties to the first seen."""
    counts = facts.filter("language IS NOT NULL").groupBy("report_id", "language").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    return counts.withColumn("_n", F.row_number().over(W.partitionBy("report_id").orderBy(F.desc("n"), "first"))).filter("_n = 1").select("report_id", "language")


def text_concepts(facts: DataFrame) -> DataFrame:
    """(report_id, concept, is_text): whether any fact of a concept has a language."""
    return facts.groupBy("report_id", "concept").agg(F.bool_or(F.col("language").isNotNull()).alias("is_text"))
