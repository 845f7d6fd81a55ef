"""Walks of presentation trees and the statements made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.periods import span_days
from .facts import consolidated, most_precise, report_keys

MAX_DEPTH, MAX_COLUMNS, COLUMN_BUDGET, CELL = 14, 8, 16_000, 36

WALK = """
WITH RECURSIVE ranked AS (
  SELECT network_seq, from_qname, to_qname, preferred_label, row_number() OVER (PARTITION BY network_seq, from_qname ORDER BY coalesce(arc_order, 0.0), seq) AS rank FROM {arcs}
), sources AS (
  SELECT network_seq, from_qname, min(seq) AS first FROM {arcs} GROUP BY network_seq, from_qname
), targets AS (
  SELECT DISTINCT network_seq AS t_net, to_qname AS t_name FROM {arcs}
), heads AS (
  SELECT s.* FROM sources s LEFT ANTI JOIN targets t ON s.network_seq = t.t_net AND s.from_qname = t.t_name
), rootless AS (
  SELECT network_seq, min_by(from_qname, first) AS from_qname, min(first) AS first FROM sources GROUP BY network_seq
), roots AS (
  SELECT * FROM heads UNION ALL SELECT r.* FROM rootless r LEFT ANTI JOIN heads h ON r.network_seq = h.network_seq
), walk(network_seq, concept, depth, preferred_label, place, trail) AS (
  SELECT network_seq, from_qname, 0, CAST(NULL AS STRING), lpad(CAST(row_number() OVER (PARTITION BY network_seq ORDER BY first) AS STRING), 6, '0'), CAST(array() AS ARRAY<STRING>) FROM roots
  UNION ALL
  SELECT w.network_seq, r.to_qname, w.depth + 1, r.preferred_label, concat(w.place, '.', lpad(CAST(r.rank AS STRING), 6, '0')), array_append(w.trail, w.concept)
  FROM walk w JOIN ranked r ON w.network_seq = r.network_seq AND w.concept = r.from_qname
  WHERE w.depth <= {deepest} AND NOT array_contains(w.trail, w.concept)
)
SELECT network_seq, concept, depth, preferred_label, place, trail FROM walk
"""


def presentation_walk(arcs: DataFrame, deepest: int = MAX_DEPTH) -> DataFrame:
    """(network_seq, ordinal from 1, depth, concept, preferred_label, trail) of every network in pre-order.

    Roots are sources that are no targets, in order of their first arc; without any, the first arc's source. Children go by
    order (unstated 0), then position. A concept within its own trail is listed and not followed. Walk networks, never facts: the recursion
    grows with the taxonomy alone. Where arcs have a report_id, networks are told apart by it too, and the rows have it.
    """
    by = report_keys(arcs)
    own = arcs.withColumn("network_seq", F.struct("report_id", "network_seq")) if by else arcs
    rows = arcs.sparkSession.sql(WALK.replace("{deepest}", str(int(deepest))), arcs=own)
    ordinal = F.row_number().over(W.partitionBy("network_seq").orderBy("place"))
    return rows.select(*(["network_seq.*"] if by else ["network_seq"]), ordinal.alias("ordinal"), "depth", "concept", "preferred_label", "trail")


def page(walk: DataFrame, offset: int = 0, limit: int = 400) -> DataFrame:
    """Rows offset+1..offset+limit of each network, with the ancestors of the page's first row, and next_offset where rows remain."""
    keys = [*report_keys(walk), "network_seq"]
    inside = walk.filter((F.col("ordinal") > offset) & (F.col("ordinal") <= offset + limit))
    total = walk.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    out = inside.join(total, keys)
    first = F.when(F.col("ordinal") == offset + 1, F.col("trail"))
    return out.withColumns({"ancestors": F.max(first).over(W.partitionBy(*keys)), "next_offset": F.when(F.col("total") > offset + limit, F.lit(offset + limit))})


def statement_cells(facts: DataFrame, walk: DataFrame, columns: int = MAX_COLUMNS) -> DataFrame:
    """(report_id, network_seq, ordinal, depth, concept, period_id, value, column) of consolidated, de-duplicated values.

    column numbers the periods: latest end, then longest span, then the one more rows use; the first `columns` stay. Of two
    units in one period the fact that comes last is shown.
    """
    best = most_precise(consolidated(facts))
    last = W.partitionBy("report_id", "concept", "period_id").orderBy(F.desc("seq"))
    value = best.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("report_id", "concept", "period_id", "start_date", "end_date", F.col("numeric_value").alias("value"))
    uses = F.count(F.lit(1)).over(W.partitionBy("report_id", "network_seq", "period_id"))
    by = report_keys(walk)
    cells = walk.select(*by, "network_seq", "ordinal", "depth", "concept").join(value, [*by, "concept"]).withColumn("uses", uses)
    order = W.partitionBy("report_id", "network_seq").orderBy(F.desc("end_date"), F.desc(span_days(F.col("start_date"), F.col("end_date"))), F.desc("uses"), "period_id")
    ranked = cells.withColumn("column", F.dense_rank().over(order))
    return ranked.filter(F.col("column") <= columns).select("report_id", "network_seq", "ordinal", "depth", "concept", "period_id", "value", "column")


def statement_pivot(cells: DataFrame) -> DataFrame:
    """One row per line of a statement, values as map<period_id, value>."""
    return cells.groupBy("report_id", "network_seq", "ordinal", "depth", "concept").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("period_id", "value")))).alias("values"))


def budgeted_prefix(ranked: DataFrame, by: list[str], order: list, cost: str, budget: int, at_least: int = 1, at_most: int | None = None) -> DataFrame:
    """The prefix of each group while the running cost stays within budget, never fewer than at_least rows, nor more than at_most.

    Once the sum has passed the budget nothing later returns, however small.
    """
    w = W.partitionBy(*by).orderBy(*order)
    run = ranked.withColumns({"_place": F.row_number().over(w), "_sum": F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))})
    over = F.max((F.col("_sum") > budget).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    kept = run.withColumn("_over", over).filter((F.col("_over") == 0) | (F.col("_place") <= at_least))
    return (kept.filter(F.col("_place") <= at_most) if at_most else kept).drop("_sum", "_over").withColumnRenamed("_place", "place")


def with_fallback(kept: DataFrame, every: DataFrame, row: list[str], order: list) -> DataFrame:
    """kept, and for rows all of whose entries were cut the best one of every."""
    lost = every.join(kept.select(*row).distinct(), row, "left_anti")
    best = lost.withColumn("_n", F.row_number().over(W.partitionBy(*row).orderBy(*order))).filter("_n = 1").drop("_n")
    return kept.unionByName(best, allowMissingColumns=True)


def column_budget(facts: DataFrame, annual_first: bool = False) -> DataFrame:
    """(report_id, period_id, uses, place): columns of a section, best first, while uses x CELL fits COLUMN_BUDGET, MAX_COLUMNS at least."""
    uses = consolidated(facts).groupBy("report_id", "period_id", "period_type", "start_date", "end_date").agg(F.count_distinct("concept").alias("uses"))
    span = span_days(F.col("start_date"), F.col("end_date"))
    front = [F.when((F.col("period_type") == "instant") | span.between(349, 379), 0).otherwise(1)] if annual_first else []
    order = [*front, F.desc("end_date"), F.desc(span), F.desc("uses"), F.col("period_id")]
    kept = budgeted_prefix(uses.withColumn("cost", F.col("uses") * CELL), ["report_id"], order, "cost", COLUMN_BUDGET, MAX_COLUMNS)
    return kept.select("report_id", "period_id", "uses", "place")


def member_budget(facts: DataFrame, most: int = 200) -> DataFrame:
    """(report_id, concept, axis, member, n, place): members of a breakdown by use while their names' and cells' size fits the budget."""
    each = facts.filter("dim_count = 1").select("report_id", "concept", F.col("dims")[0]["axis"].alias("axis"), F.col("dims")[0]["member"].alias("member"))
    n = each.groupBy("report_id", "concept", "axis", "member").agg(F.count(F.lit(1)).alias("n")).withColumn("cost", F.length("member") + CELL * F.col("n"))
    return budgeted_prefix(n, ["report_id", "concept", "axis"], [F.desc("n"), F.col("member")], "cost", COLUMN_BUDGET, 1, most).drop("cost")
