"""From raw parsed tables to report tables, and from authored rows: assembly, drop ledger, context recovery, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import PACKAGE_NAMESPACE, sha_id, uuid5
from ..functions.periods import inclusive_date
from ..functions.text import digits

#: Arcroles by linkbase kind, label and reference roles that make no network.
PRESENTATION = ("http://www.xbrl.org/2003/arcrole/parent-child",)
CALCULATION = ("http://www.xbrl.org/2003/arcrole/summation-item", "https://xbrl.org/2023/arcrole/summation-item")
SKIPPED = ("http://www.xbrl.org/2003/arcrole/concept-label", "http://www.xbrl.org/2003/arcrole/concept-reference")


def network_kind(arcrole):
    """presentation, calculation or definition; null for label and reference arcs."""
    return F.when(arcrole.isin(*PRESENTATION), "presentation").when(arcrole.isin(*CALCULATION), "calculation").when(~arcrole.isin(*SKIPPED), "definition")


def contexts_to_periods(contexts: DataFrame) -> DataFrame:
    """(report_id, context, period_type, start_date, end_date, period_id) of contexts(report_id, context, start, end, instant): exclusive midnights to inclusive dates."""
    end = inclusive_date(F.coalesce("instant", "end"))
    start = F.when(F.col("start").isNotNull(), F.to_date(F.substring("start", 1, 10)))
    kind = F.when(F.col("instant").isNotNull(), "instant").when(F.col("end").isNotNull(), "duration").otherwise("forever")
    rows = contexts.select("report_id", "context", kind.alias("period_type"), start.alias("start_date"), end.alias("end_date"))
    name = F.concat_ws("/", F.col("start_date").cast("string"), F.coalesce(F.col("end_date").cast("string"), F.lit("Forever")))
    return rows.withColumn("period_id", uuid5(PACKAGE_NAMESPACE, F.concat(F.lit("period:"), name)))


def assemble_facts(raw: DataFrame, contexts: DataFrame, units: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, dropped) of raw(report_id, seq, concept, context, unit, value): facts with a known context and concept; numeric if and only if a unit stands; others with their reason."""
    c = contexts.withColumn("_c", F.lit(True))
    q = concepts.select(F.col("qname").alias("concept"), F.lit(True).alias("_q")).distinct()
    u = units.select("report_id", F.col("unit"), "measure")
    seen = raw.join(c, ["report_id", "context"], "left").join(q, "concept", "left").join(u, ["report_id", "unit"], "left")
    reason = F.when(F.col("_c").isNull(), "undeclared_context").when(F.col("_q").isNull(), "undeclared_concept")
    out = seen.withColumn("reason", reason).withColumn("numeric_value", F.when(F.col("unit").isNotNull(), F.col("value").try_cast("double")))
    return out.filter("reason IS NULL").drop("reason", "_c", "_q"), out.filter("reason IS NOT NULL").select("report_id", "seq", "concept", "context", "reason")


def drop_ledger(dropped: DataFrame, sample: int = 5) -> DataFrame:
    """(report_id, reason, context, n, concepts): how many facts were dropped and the first few distinct concepts in order."""
    first = dropped.groupBy("report_id", "reason", "context", "concept").agg(F.min("seq").alias("at"), F.count(F.lit(1)).alias("k"))
    place = W.partitionBy("report_id", "reason", "context").orderBy("at")
    ranked = first.withColumn("_n", F.row_number().over(place))
    shown = F.array_sort(F.collect_list(F.when(F.col("_n") <= sample, F.struct("at", "concept"))))
    return ranked.groupBy("report_id", "reason", "context").agg(F.sum("k").alias("n"), F.transform(shown, lambda x: x["concept"]).alias("concepts"))


def recover_contexts(dropped: DataFrame, stated: DataFrame, concepts: DataFrame) -> DataFrame:
    """(report_id, context, start_date, end_date) of undeclared contexts under which exactly one start and one end are stated, in order, and only duration concepts are used.

    stated: (report_id, context, what start|end, day).
    """
    days = stated.groupBy("report_id", "context").agg(F.count_distinct(F.when(F.col("what") == "start", F.col("day"))).alias("n_s"), F.count_distinct(F.when(F.col("what") == "end", F.col("day"))).alias("n_e"), F.min(F.when(F.col("what") == "start", F.col("day"))).alias("start_date"), F.min(F.when(F.col("what") == "end", F.col("day"))).alias("end_date"))
    kinds = dropped.filter("reason = 'undeclared_context'").join(concepts.select(F.col("qname").alias("concept"), "period_type"), "concept", "left").groupBy("report_id", "context").agg(F.bool_and(F.col("period_type") == "duration").alias("durations"))
    return days.join(kinds, ["report_id", "context"]).filter("n_s = 1 AND n_e = 1 AND start_date <= end_date AND durations").select("report_id", "context", "start_date", "end_date")


def cover_fields(facts: DataFrame, fields: list[str]) -> DataFrame:
    """One row per report with the cover-page fields (concept local names) as columns: an undimensioned fact first, else the first dimensioned."""
    local = F.substring_index("concept", ":", -1)
    order = W.partitionBy("report_id", "field").orderBy(F.col("dim_count") > 0, "seq")
    best = facts.withColumn("field", local).filter(F.col("field").isin(*fields)).withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return best.groupBy("report_id").pivot("field", fields).agg(F.first("value_str"))


def fill_empty(rows: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with null or empty values of columns taken from other."""
    o = other.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(o, key, "left")
    return out.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])


def tax_id(text):
    return digits(text)


def prefix_bindings(names: DataFrame) -> DataFrame:
    """(report_id, prefix, namespace) of prefixes bound to one namespace in a report. names: (report_id, prefix, namespace)."""
    return names.groupBy("report_id", "prefix").agg(F.count_distinct("namespace").alias("n"), F.min("namespace").alias("namespace")).filter("n = 1").drop("n")


def author(facts: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, problems) of authored rows facts(report_id, seq, concept, start, end, unit, value, decimals): every bad row is named with all its faults, good ones get content ids."""
    known = concepts.select(F.col("qname").alias("concept"), "is_numeric", F.col("period_type").alias("_kind")).withColumn("_c", F.lit(True))
    seen = facts.join(known, "concept", "left")
    s, e = F.try_to_date("start"), F.try_to_date("end")
    number = F.col("value").try_cast("double")
    faults = F.filter(F.array(
        F.when(F.col("_c").isNull(), "unknown concept"), F.when(e.isNull(), "no end date"), F.when((F.col("_kind") == "duration") & s.isNull(), "no start date"), F.when(s > e, "start after end"),
        F.when(F.col("is_numeric") & number.isNull(), "not a number"), F.when(F.col("is_numeric") & F.col("unit").isNull(), "no unit"), F.when(F.col("value").isNull(), "no value"),
    ), lambda x: x.isNotNull())
    judged = seen.withColumn("faults", faults)
    name = F.concat_ws("|", "report_id", "concept", "start", "end", "unit", "value", "decimals")
    good = judged.filter("size(faults) = 0").select("report_id", "seq", sha_id(name).alias("fact_id"), "concept", s.alias("start_date"), e.alias("end_date"), F.col("unit").alias("unit_id"), F.when(F.col("is_numeric"), number).alias("numeric_value"), F.col("value").alias("value_str"), "decimals")
    return good, judged.filter("size(faults) > 0").select("report_id", "seq", "concept", F.array_join("faults", "; ").alias("faults"))


def newest_report(reports: DataFrame) -> DataFrame:
    """(entity, report_id): each entity's newest report by filing date, report date, then id."""
    order = W.partitionBy("entity").orderBy(F.desc_nulls_last("filing_date"), F.desc_nulls_last("report_date"), F.desc("report_id"))
    return reports.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("entity", "report_id")
