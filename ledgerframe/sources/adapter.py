"""The driver's tables read as a corpus of financial reports.

One report per nation and order year; facts are sums of line items by year and quarter, undimensioned and broken down by
market segment and return flag. Amounts are summed as whole cents, so that every engine gets the same doubles. Each undimensioned annual amount also
has a coarse duplicate in thousands (decimals -3), and some a rival of equal precision, so that de-duplication and agreement checks have real work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import stored

#: SQL that Spark and the oracle share; table names in braces.
SUMS = """
SELECT n_nationkey AS nk, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, c_mktsegment AS seg, l_returnflag AS rf,
  CAST(grouping(quarter(o_orderdate)) AS INT) AS no_q, CAST(grouping(c_mktsegment) AS INT) AS no_seg, CAST(grouping(l_returnflag) AS INT) AS no_rf,
  CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS gross, CAST(sum(CAST(floor(l_extendedprice * l_discount * 100 + 0.5) AS BIGINT)) AS BIGINT) AS disc,
  CAST(sum(CAST(floor(l_extendedprice * l_tax * 100 + 0.5) AS BIGINT)) AS BIGINT) AS tax, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, CAST(count(*) AS BIGINT) AS n
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
GROUP BY GROUPING SETS ((n_nationkey, year(o_orderdate)), (n_nationkey, year(o_orderdate), quarter(o_orderdate)), (n_nationkey, year(o_orderdate), c_mktsegment),
  (n_nationkey, year(o_orderdate), l_returnflag), (n_nationkey, year(o_orderdate), c_mktsegment, l_returnflag))
"""
FACTS = """
WITH sums AS (""" + SUMS + """), placed AS (
  SELECT *, CASE WHEN no_q = 1 THEN make_date(y, 1, 1) ELSE make_date(y, q * 3 - 2, 1) END AS d0, CASE WHEN no_q = 1 THEN make_date(y, 12, 31) ELSE last_day(make_date(y, q * 3, 1)) END AS d1,
    CASE WHEN no_rf = 0 THEN 'tb:ReturnAxis=tb:' || rf || 'Member' ELSE '' END || CASE WHEN no_rf = 0 AND no_seg = 0 THEN '|' ELSE '' END
      || CASE WHEN no_seg = 0 THEN 'tb:SegmentAxis=tb:' || replace(seg, ' ', '') || 'Member' ELSE '' END AS dims_key, 2 - no_seg - no_rf AS dim_count FROM sums
), stated AS (
  SELECT p.*, v.concept, v.unit_id, v.period_type, CASE v.concept WHEN 'tb:GrossRevenue' THEN gross WHEN 'tb:Discounts' THEN disc WHEN 'tb:TaxCharged' THEN tax WHEN 'tb:NetRevenue' THEN gross - disc + tax
      WHEN 'tb:Quantity' THEN qty * 100 WHEN 'tb:LineCount' THEN n * 100 WHEN 'tb:Assets' THEN gross ELSE gross + CASE WHEN nk % 5 = 0 THEN 7500 ELSE 0 END END AS cents
  FROM placed p CROSS JOIN (VALUES ('tb:GrossRevenue', 'USD', 'duration'), ('tb:Discounts', 'USD', 'duration'), ('tb:TaxCharged', 'USD', 'duration'), ('tb:NetRevenue', 'USD', 'duration'), ('tb:Quantity', 'shares', 'duration'),
    ('tb:LineCount', 'pure', 'duration'), ('tb:Assets', 'USD', 'instant'), ('tb:LiabilitiesAndStockholdersEquity', 'USD', 'instant')) AS v(concept, unit_id, period_type)
  WHERE v.period_type = 'duration' OR (no_q = 1 AND no_seg = 1 AND no_rf = 1)
), every AS (
  SELECT nk, y, concept, unit_id, period_type, d0, d1, dims_key, dim_count, cents / 100.0 AS numeric_value, CASE WHEN unit_id = 'USD' THEN '2' ELSE 'INF' END AS decimals FROM stated
  UNION ALL SELECT nk, y, concept, unit_id, period_type, d0, d1, dims_key, dim_count, floor(cents / 100000.0 + 0.5) * 1000.0, '-3' FROM stated WHERE unit_id = 'USD' AND no_q = 1 AND dim_count = 0
  UNION ALL SELECT nk, y, concept, unit_id, period_type, d0, d1, dims_key, dim_count, cents / 100.0 + 1.0, '2' FROM stated WHERE concept = 'tb:Discounts' AND no_q = 1 AND dim_count = 0 AND nk % 4 = 0
), named AS (
  SELECT 'n' || CAST(nk AS STRING) || '-' || CAST(y AS STRING) AS report_id, concept, CASE period_type WHEN 'instant' THEN CAST(d1 AS STRING) ELSE CAST(d0 AS STRING) || '..' || CAST(d1 AS STRING) END AS period_id,
    period_type, CASE WHEN period_type = 'duration' THEN d0 END AS start_date, d1 AS end_date, unit_id, dims_key, CAST(dim_count AS INT) AS dim_count, CAST(numeric_value AS DOUBLE) AS numeric_value, decimals FROM every
)
SELECT *, CAST(row_number() OVER (PARTITION BY report_id ORDER BY concept, period_id, unit_id, dims_key, decimals, numeric_value) AS BIGINT) AS seq FROM named
"""
REPORTS = """
SELECT DISTINCT 'n' || CAST(n_nationkey AS STRING) || '-' || CAST(year(o_orderdate) AS STRING) AS report_id, CAST(n_nationkey AS INT) AS entity_cik, n_name AS entity_name, CAST(year(o_orderdate) AS INT) AS fiscal_year
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""
#: Concepts: qname, label, abstract, numeric, text block, cube, axis, member, period type, balance.
CONCEPTS = """
SELECT * FROM (VALUES
 ('tb:IncomeStatementAbstract', 'Income Statement [Abstract]', true, false, false, false, false, false, 'duration', CAST(NULL AS STRING)),
 ('tb:GrossRevenue', 'Gross Revenue', false, true, false, false, false, false, 'duration', 'credit'), ('tb:Discounts', 'Discounts', false, true, false, false, false, false, 'duration', 'debit'),
 ('tb:TaxCharged', 'Tax Charged', false, true, false, false, false, false, 'duration', 'credit'), ('tb:NetRevenue', 'Net Revenue', false, true, false, false, false, false, 'duration', 'credit'),
 ('tb:Quantity', 'Quantity Shipped', false, true, false, false, false, false, 'duration', CAST(NULL AS STRING)), ('tb:LineCount', 'Line Count', false, true, false, false, false, false, 'duration', CAST(NULL AS STRING)),
 ('tb:BalanceSheetAbstract', 'Balance Sheet [Abstract]', true, false, false, false, false, false, 'instant', CAST(NULL AS STRING)), ('tb:Assets', 'Total Assets', false, true, false, false, false, false, 'instant', 'debit'),
 ('tb:LiabilitiesAndStockholdersEquity', 'Liabilities and Equity', false, true, false, false, false, false, 'instant', 'credit'), ('tb:RevenueTable', 'Revenue [Table]', true, false, false, true, false, false, 'duration', CAST(NULL AS STRING)),
 ('tb:SegmentAxis', 'Segment [Axis]', true, false, false, false, true, false, 'duration', CAST(NULL AS STRING)), ('tb:SegmentDomain', 'Segment [Domain]', true, false, false, false, false, true, 'duration', CAST(NULL AS STRING)),
 ('tb:ReturnAxis', 'Return [Axis]', true, false, false, false, true, false, 'duration', CAST(NULL AS STRING)), ('tb:ReturnDomain', 'Return [Domain]', true, false, false, false, false, true, 'duration', CAST(NULL AS STRING)),
 ('tb:AUTOMOBILEMember', 'Automobile', true, false, false, false, false, true, 'duration', CAST(NULL AS STRING)), ('tb:BUILDINGMember', 'Building', true, false, false, false, false, true, 'duration', CAST(NULL AS STRING)),
 ('tb:FURNITUREMember', 'Furniture', true, false, false, false, false, true, 'duration', CAST(NULL AS STRING)), ('tb:AMember', 'Accepted', true, false, false, false, false, true, 'duration', CAST(NULL AS STRING)),
 ('tb:RMember', 'Returned', true, false, false, false, false, true, 'duration', CAST(NULL AS STRING)), ('tb:Goodwill', 'Goodwill', false, true, false, false, false, false, 'instant', 'debit')
) AS c(qname, label, is_abstract, is_numeric, is_textblock, is_hypercube_item, is_dimension_item, is_domain_member, period_type, balance)
"""
#: Networks: seq, role, kind, definition.
NETWORKS = """
SELECT * FROM (VALUES
 (1, 'http://tb/role/IncomeStatement', 'presentation', '1001 - Statement - Consolidated Statements of Income'), (2, 'http://tb/role/IncomeStatement', 'calculation', '1001 - Statement - Consolidated Statements of Income'),
 (3, 'http://tb/role/BalanceSheet', 'presentation', '1002 - Statement - Consolidated Balance Sheets'), (4, 'http://tb/role/RevenueDetails', 'presentation', '2001 - Disclosure - Revenue - Breakdown (Details)'),
 (5, 'http://tb/role/RevenueDetails', 'definition', '2001 - Disclosure - Revenue - Breakdown (Details)'), (6, 'http://tb/role/Revenue', 'presentation', '2000 - Disclosure - Revenue'),
 (7, 'http://tb/role/Revenue_1', 'calculation', CAST(NULL AS STRING)), (8, 'http://tb/role/BalanceSheetParenthetical', 'presentation', '1003 - Statement - Consolidated Balance Sheets (Parenthetical)'),
 (9, 'http://tb/role/Loop', 'presentation', 'Unnumbered loop')
) AS w(seq, role_uri, kind, definition)
"""
#: Arcs: network, seq, arcrole, from, to, order, weight, preferred label, target role.
ARCS = """
SELECT * FROM (VALUES
 (1, 1, 'parent-child', 'tb:IncomeStatementAbstract', 'tb:GrossRevenue', 1.0, CAST(NULL AS DOUBLE), CAST(NULL AS STRING), CAST(NULL AS STRING)), (1, 2, 'parent-child', 'tb:IncomeStatementAbstract', 'tb:Discounts', 2.0, NULL, 'negatedLabel', NULL),
 (1, 3, 'parent-child', 'tb:IncomeStatementAbstract', 'tb:TaxCharged', CAST(NULL AS DOUBLE), NULL, NULL, NULL), (1, 4, 'parent-child', 'tb:IncomeStatementAbstract', 'tb:NetRevenue', 4.0, NULL, 'totalLabel', NULL), (1, 5, 'parent-child', 'tb:NetRevenue', 'tb:Quantity', 1.0, NULL, NULL, NULL),
 (2, 1, 'summation-item', 'tb:NetRevenue', 'tb:GrossRevenue', 1.0, 1.0, NULL, NULL), (2, 2, 'summation-item', 'tb:NetRevenue', 'tb:Discounts', 2.0, -1.0, NULL, NULL), (2, 3, 'summation-item', 'tb:NetRevenue', 'tb:TaxCharged', 3.0, NULL, NULL, NULL),
 (3, 1, 'parent-child', 'tb:BalanceSheetAbstract', 'tb:Assets', 1.0, NULL, 'totalLabel', NULL), (3, 2, 'parent-child', 'tb:BalanceSheetAbstract', 'tb:LiabilitiesAndStockholdersEquity', 2.0, NULL, 'totalLabel', NULL),
 (4, 1, 'parent-child', 'tb:RevenueTable', 'tb:SegmentAxis', 1.0, NULL, NULL, NULL), (4, 2, 'parent-child', 'tb:SegmentAxis', 'tb:SegmentDomain', 1.0, NULL, NULL, NULL), (4, 3, 'parent-child', 'tb:RevenueTable', 'tb:GrossRevenue', 2.0, NULL, NULL, NULL), (4, 4, 'parent-child', 'tb:RevenueTable', 'tb:NetRevenue', 3.0, NULL, NULL, NULL),
 (5, 1, 'all', 'tb:GrossRevenue', 'tb:RevenueTable', 1.0, NULL, NULL, NULL), (5, 2, 'hypercube-dimension', 'tb:RevenueTable', 'tb:SegmentAxis', 1.0, NULL, NULL, NULL), (5, 3, 'dimension-domain', 'tb:SegmentAxis', 'tb:SegmentDomain', 1.0, NULL, NULL, NULL),
 (5, 4, 'domain-member', 'tb:SegmentDomain', 'tb:AUTOMOBILEMember', 1.0, NULL, NULL, NULL), (5, 5, 'domain-member', 'tb:SegmentDomain', 'tb:BUILDINGMember', 2.0, NULL, NULL, NULL), (5, 6, 'domain-member', 'tb:BUILDINGMember', 'tb:FURNITUREMember', 1.0, NULL, NULL, NULL),
 (5, 7, 'dimension-default', 'tb:SegmentAxis', 'tb:SegmentDomain', 1.0, NULL, NULL, NULL), (5, 8, 'hypercube-dimension', 'tb:RevenueTable', 'tb:ReturnAxis', 2.0, NULL, NULL, NULL), (5, 9, 'all', 'tb:NetRevenue', 'tb:RevenueTable', 2.0, NULL, NULL, NULL), (5, 10, 'domain-member', 'tb:FURNITUREMember', 'tb:SegmentDomain', 1.0, NULL, NULL, NULL),
 (6, 1, 'parent-child', 'tb:IncomeStatementAbstract', 'tb:GrossRevenue', 1.0, NULL, NULL, NULL), (7, 1, 'summation-item', 'tb:GrossRevenue', 'tb:NetRevenue', 1.0, 1.0, NULL, NULL), (7, 2, 'summation-item', 'tb:GrossRevenue', 'tb:TaxCharged', 2.0, 1.0, NULL, NULL),
 (8, 1, 'parent-child', 'tb:BalanceSheetAbstract', 'tb:Goodwill', 1.0, NULL, NULL, NULL), (9, 1, 'parent-child', 'tb:GrossRevenue', 'tb:NetRevenue', 1.0, NULL, NULL, NULL), (9, 2, 'parent-child', 'tb:NetRevenue', 'tb:GrossRevenue', 1.0, NULL, NULL, NULL)
) AS a(network_seq, seq, arcrole, from_qname, to_qname, arc_order, weight, preferred_label, target_role)
"""
#: Networks made of rows: titles, roles and roots of every kind that classification and folding tell apart.
VARIED_NETWORKS = """
SELECT CAST(100 + n_nationkey AS INT) AS seq, 'http://tb/role/' || CASE n_nationkey % 7 WHEN 0 THEN 'StatementOfCashFlows' WHEN 1 THEN 'R' || CAST(n_regionkey AS STRING) WHEN 2 THEN 'R' || CAST(n_regionkey AS STRING) || '_1'
  WHEN 3 THEN 'BalanceSheetParenthetical' WHEN 4 THEN 'Opaque' || CAST(n_nationkey AS STRING) WHEN 5 THEN 'R' || CAST(n_regionkey AS STRING) || '_22' ELSE 'notes#Earnings-Per-Share' END AS role_uri, 'presentation' AS kind,
  CASE n_nationkey % 9 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'Statements of Comprehensive Income' WHEN 2 THEN 'CONSOLIDATED INCOME' WHEN 3 THEN 'Changes in Equity and Cash Flows' WHEN 4 THEN 'Changes in Stockholders\u2019 Equity'
    WHEN 5 THEN 'Financial Position (Parenthetical)' WHEN 6 THEN n_name WHEN 7 THEN 'Results of Operations' ELSE CAST(NULL AS STRING) END AS definition FROM {nation}
"""
VARIED_ARCS = """
SELECT CAST(100 + n_nationkey AS INT) AS network_seq, 1 AS seq, 'parent-child' AS arcrole, CASE n_nationkey % 4 WHEN 0 THEN 'ifrs:StatementOfFinancialPositionAbstract' WHEN 1 THEN 'tb:StatementOfCashFlowsAbstract' WHEN 2 THEN 'us:IncomeStatementAbstract'
  ELSE 'tb:Unknown' END AS from_qname, 'tb:Assets' AS to_qname FROM {nation} UNION ALL SELECT CAST(100 + n_nationkey AS INT), 2, 'parent-child', 'tb:Other', 'tb:Assets' FROM {nation} WHERE n_nationkey % 5 = 0
"""
TABLES = ("lineitem", "orders", "customer", "nation")


@dataclass(frozen=True)
class ReportSet:
    """A corpus of reports as DataFrames. concepts, networks and arcs here are shared by all reports (they carry no report_id)."""

    reports: DataFrame
    facts: DataFrame
    concepts: DataFrame
    networks: DataFrame
    arcs: DataFrame


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used) if used else spark.sql(text)


def report_set(spark: SparkSession, sf_dir: str) -> ReportSet:
    """facts have dims (array<struct<axis, member>>) besides the text key of the dimensions; they are worked out once per application and folder, and read afterwards."""
    pairs = F.filter(F.split("dims_key", r"\|"), lambda x: x != "")
    dims = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("axis"), F.substring_index(x, "=", -1).alias("member")))
    facts = stored(spark, sf_dir, "report-facts", lambda: _sql(spark, sf_dir, FACTS).withColumn("dims", dims).withColumn("language", F.lit(None).cast("string")))
    return ReportSet(_sql(spark, sf_dir, REPORTS), facts, _sql(spark, sf_dir, CONCEPTS), _sql(spark, sf_dir, NETWORKS), _sql(spark, sf_dir, ARCS))


def varied_networks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(networks, arcs): the taxonomy's and VARIED ones, with the columns that titles, roles and roots need."""
    r = report_set(spark, sf_dir)
    networks = r.networks.select("seq", "role_uri", "kind", "definition").unionByName(_sql(spark, sf_dir, VARIED_NETWORKS))
    return networks, r.arcs.select("network_seq", "seq", "arcrole", "from_qname", "to_qname").unionByName(_sql(spark, sf_dir, VARIED_ARCS))


def oracle(text: str) -> str:
    """The shared SQL for an engine that has the tables under their names."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text
