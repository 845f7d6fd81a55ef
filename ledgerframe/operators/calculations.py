"""Weighted roll-ups and whole-report checks: footing, balance, agreement of duplicates, references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import local_name, prefix_of
from ..functions.values import precision, tolerance
from .facts import consolidated, most_precise, report_keys, stated

#: Total and counterpart by local name.
BALANCE_PAIRS = (("Assets", "LiabilitiesAndStockholdersEquity"), ("Assets", "EquityAndLiabilities"))


def calculation_arcs(networks: DataFrame, arcs: DataFrame) -> DataFrame:
    """(network_seq, role_uri, parent, child, weight, arc_seq), with report_id where networks and arcs have it; unstated weights are 1."""
    by = report_keys(networks, arcs)
    nets = networks.filter("kind = 'calculation'").select(*by, F.col("seq").alias("network_seq"), "role_uri")
    return arcs.join(nets, [*by, "network_seq"]).select(*by, "network_seq", "role_uri", F.col("from_qname").alias("parent"), F.col("to_qname").alias("child"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.col("seq").alias("arc_seq"))


def rollup(facts: DataFrame, networks: DataFrame, arcs: DataFrame) -> DataFrame:
    """Per (report, network, parent, period, unit) where the parent or a child has a fact: reported, computed, difference, missing children.

    computed sums weight x value over the children present; difference has no tolerance.
    """
    values = most_precise(consolidated(facts)).select("report_id", "concept", "period_id", "unit_id", "numeric_value", "decimals")
    calc = calculation_arcs(networks, arcs)
    by = report_keys(calc)
    terms = calc.join(values.withColumnRenamed("concept", "child"), [*by, "child"])
    keys = ["report_id", "network_seq", "role_uri", "parent", "period_id", "unit_id"]
    has = F.col("numeric_value").isNotNull()
    sums = terms.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("numeric_value")).alias("computed"), F.count_if(has).alias("present"), F.array_sort(F.collect_set(F.when(has, F.col("child")))).alias("found"))
    heads = calc.groupBy(*by, "network_seq", "role_uri", "parent").agg(F.count(F.lit(1)).alias("terms"), F.array_sort(F.collect_set("child")).alias("children"))
    own = heads.select(*by, "network_seq", "role_uri", "parent").join(values.withColumnRenamed("concept", "parent"), [*by, "parent"]).select(*keys, F.col("numeric_value").alias("reported"), "decimals")
    # A unit may be null on both sides: compared null-safely.
    o, s = own.alias("o"), sums.alias("s")
    same = [F.col(f"o.{k}") == F.col(f"s.{k}") if k != "unit_id" else F.col(f"o.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on &= c
    both = o.join(s, on, "full_outer").select(*[F.coalesce(f"o.{k}", f"s.{k}").alias(k) for k in keys], "reported", "decimals", "computed", F.coalesce("present", F.lit(0)).alias("present"), F.coalesce("found", F.array().cast("array<string>")).alias("found"))
    both = both.join(heads, [*by, "network_seq", "role_uri", "parent"])
    shown = F.when(F.col("present") > 0, F.col("computed"))
    return both.select(*keys, "reported", "decimals", shown.alias("computed"), (F.col("reported") - shown).alias("difference"), "present", "terms", F.array_join(F.array_except("children", "found"), ",").alias("missing"))


def footing(facts: DataFrame, networks: DataFrame, arcs: DataFrame) -> DataFrame:
    """The roll-ups that can be judged (parent reported, a child present) with `foots`: within half a unit of the parent's stated place."""
    can = rollup(facts, networks, arcs).filter("reported IS NOT NULL AND present > 0")
    return can.withColumn("foots", F.abs("difference") <= tolerance(F.col("decimals")))


def balance(facts: DataFrame) -> DataFrame:
    """Totals against their counterparts of the same prefix, period and unit: difference and whether it lies within the coarser tolerance."""
    values = most_precise(consolidated(facts)).filter("numeric_value IS NOT NULL").select("report_id", "period_id", "unit_id", local_name(F.col("concept")).alias("local"), F.coalesce(prefix_of(F.col("concept")), F.lit("")).alias("prefix"), "numeric_value", "decimals")
    out = None
    for left, right in BALANCE_PAIRS:
        a = values.filter(F.col("local") == left).select("report_id", "period_id", "unit_id", "prefix", F.col("numeric_value").alias("assets"), F.col("decimals").alias("d_a")).alias("a")
        b = values.filter(F.col("local") == right).select("report_id", "period_id", "unit_id", "prefix", F.col("numeric_value").alias("counterpart"), F.col("decimals").alias("d_b")).alias("b")
        on = (F.col("a.report_id") == F.col("b.report_id")) & (F.col("a.period_id") == F.col("b.period_id")) & (F.col("a.prefix") == F.col("b.prefix")) & F.col("a.unit_id").eqNullSafe(F.col("b.unit_id"))
        pair = a.join(b, on).select("a.report_id", "a.period_id", "a.unit_id", F.lit(right).alias("against"), "assets", "counterpart", (F.col("assets") - F.col("counterpart")).alias("difference"), (F.abs(F.col("assets") - F.col("counterpart")) <= F.greatest(tolerance(F.col("d_a")), tolerance(F.col("d_b")))).alias("balances"))
        out = pair if out is None else out.unionByName(pair)
    return out


def duplicate_conflicts(facts: DataFrame) -> DataFrame:
    """Coordinates whose facts disagree: each fact is compared with the best so far (most precise, first of equals): two numbers within the coarser
    tolerance, anything else by its text.

    One row per coordinate: its first conflict, as the values compared (kept_text and rival_text for texts).
    """
    key = W.partitionBy("report_id", "concept", "period_id", "unit_id", "dims_key", "language").orderBy("seq")
    # Best so far = the row of greatest (precision, -seq) before this one; a running maximum of a struct says which.
    text = F.coalesce(stated(facts, "value_str"), F.col("numeric_value").cast("string"))
    rank = F.struct(precision(F.col("decimals")).alias("p"), (-F.col("seq")).alias("s"), F.col("numeric_value").alias("v"), F.col("decimals").alias("d"), text.alias("t"))
    seen = facts.withColumn("_best", F.max(rank).over(key.rowsBetween(W.unboundedPreceding, -1)))
    allowed = F.greatest(tolerance(F.col("decimals")), tolerance(F.col("_best.d")))
    numbers = F.col("numeric_value").isNotNull() & F.col("_best.v").isNotNull()
    off = F.col("_best").isNotNull() & F.when(numbers, F.abs(F.col("numeric_value") - F.col("_best.v")) > allowed).otherwise(~text.eqNullSafe(F.col("_best.t")))
    return (
        seen.filter(off).withColumn("_n", F.row_number().over(key)).filter("_n = 1")
        .select("report_id", "concept", "period_id", "unit_id", "dims_key", F.col("_best.v").alias("kept_value"), F.col("numeric_value").alias("rival_value"), F.when(~numbers, F.col("_best.t")).alias("kept_text"), F.when(~numbers, text).alias("rival_text"))
    )


def reference_problems(facts: DataFrame, concepts: DataFrame, periods: DataFrame, units: DataFrame) -> DataFrame:
    """(report_id, seq, code) of facts that cite what the report lacks, first failing reason only."""
    by = report_keys(concepts)
    c = concepts.select(*by, F.col("qname").alias("concept"), F.col("is_numeric").alias("_numeric"), F.lit(True).alias("_c"))
    p = periods.select("report_id", "period_id", F.lit(True).alias("_p")).distinct()
    u = units.select("report_id", "unit_id", F.lit(True).alias("_u")).distinct()
    seen = facts.join(c, [*by, "concept"], "left").join(p, ["report_id", "period_id"], "left").join(u, ["report_id", "unit_id"], "left")
    code = (
        F.when(F.col("_c").isNull(), "undeclared_concept").when(F.col("_p").isNull(), "unknown_period").when(F.col("unit_id").isNotNull() & F.col("_u").isNull(), "unknown_unit")
        .when(F.col("_numeric") & F.col("numeric_value").isNull(), "not_a_number").when(F.col("_numeric") & F.col("unit_id").isNull(), "no_unit")
    )
    return seen.withColumn("code", code).filter("code IS NOT NULL").select("report_id", "seq", "code")


def verdict(facts: DataFrame, concepts: DataFrame, networks: DataFrame, arcs: DataFrame, reports: DataFrame, periods: DataFrame | None = None, units: DataFrame | None = None) -> DataFrame:
    """Per report: facts, problems by kind, and ok where there is none. Facts with a reference problem (any code) are unsound and take part in no other check.

    Without periods or units of the reports, those that the facts cite count as known."""
    wrong = reference_problems(facts, concepts, periods if periods is not None else facts.select("report_id", "period_id"), units if units is not None else facts.select("report_id", "unit_id"))
    sound = facts.join(wrong.select("report_id", "seq"), ["report_id", "seq"], "left_anti")
    feet = footing(sound, networks, arcs).groupBy("report_id").agg(F.count(F.lit(1)).alias("checked"), F.count_if("foots").alias("footed"))
    poise = balance(sound).groupBy("report_id").agg(F.count_if(~F.col("balances")).alias("unbalanced"))
    clash = duplicate_conflicts(sound).groupBy("report_id").agg(F.count(F.lit(1)).alias("conflicts"))
    lost = wrong.groupBy("report_id").agg(F.count(F.lit(1)).alias("unsound"))
    n = facts.groupBy("report_id").agg(F.count(F.lit(1)).alias("facts"))
    out = reports.select("report_id")
    for part in (n, feet, poise, clash, lost):
        out = out.join(part, "report_id", "left")
    out = out.fillna(0)
    return out.withColumn("ok", (F.col("facts") > 0) & (F.col("checked") == F.col("footed")) & (F.col("unbalanced") + F.col("conflicts") + F.col("unsound") == 0))
