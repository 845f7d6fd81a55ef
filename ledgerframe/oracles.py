"""DuckDB SQL of the registered queries, written apart from the Spark operators; only the adapter's own SQL is shared."""

from __future__ import annotations

from .functions.ids import GRAPH_NAMESPACE
from .functions.text import ITEM_CAPTIONS
from .sources import adapter

_FACTS, _REPORTS = adapter.oracle(adapter.FACTS), adapter.oracle(adapter.REPORTS)
_WITH = f"WITH facts AS ({_FACTS}), reports AS ({_REPORTS}), concepts AS ({adapter.CONCEPTS}), networks AS ({adapter.NETWORKS}), arcs AS ({adapter.ARCS})"
_PREC = "CASE WHEN decimals IS NULL THEN -1e9 WHEN decimals = 'INF' THEN 1e9 ELSE coalesce(try_cast(decimals AS DOUBLE), -1e9) END"
_TOL = "CASE WHEN {0} = 'INF' THEN 0.0 WHEN try_cast({0} AS DOUBLE) IS NULL THEN 0.5 ELSE 0.5 * pow(10.0, -try_cast({0} AS DOUBLE)) END"
_BEST = f"best AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY report_id, concept, period_id, unit_id, dims_key ORDER BY {_PREC} DESC, seq) = 1)"
_TOTAL = "totals AS (SELECT * FROM best WHERE dims_key = '')"


def _uuid5(content: str) -> str:
    h = f"sha1(unhex('{GRAPH_NAMESPACE.hex}') || encode({content}))"
    return (
        f"(substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr({h},17,1)) - 1) % 4 + 1 AS INT), 1) || substr({h},18,3) || '-' || substr({h},21,12))"
    )


_ELEMENT = _uuid5("'element:https://example.org/taxonomy/tb#' || split_part({0}, ':', 2)")
_CONTENT = "kept AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY report_id, concept, period_id, unit_id, dims_key, numeric_value ORDER BY seq) = 1)"
_FACT_URI = "'https://example.org/report/' || report_id || '#fact-' || CAST(seq AS VARCHAR)"
_PERIOD_URI = "'period:http://www.w3.org/2001/XMLSchema#dateTime#' || CASE WHEN period_type = 'instant' THEN CAST(end_date AS VARCHAR) ELSE CAST(start_date AS VARCHAR) || '/' || CAST(end_date AS VARCHAR) END"
_DAYS = "(date_diff('day', {s}, {e}) + 1)"
_KIND = "CASE WHEN {s} IS NULL OR {e} IS NULL THEN NULL WHEN " + _DAYS + " BETWEEN 80 AND 100 THEN 'quarterly' WHEN " + _DAYS + " BETWEEN 170 AND 190 THEN 'semi_annual' WHEN " + _DAYS + " BETWEEN 260 AND 280 THEN 'nine_months' WHEN " + _DAYS + " BETWEEN 350 AND 380 THEN 'annual' ELSE 'other' END"
_QUARTER = "CASE WHEN {s} IS NULL THEN 'Q' || quarter({e}) ELSE CASE " + _KIND + " WHEN 'quarterly' THEN 'Q' || quarter({e}) WHEN 'semi_annual' THEN CASE WHEN month({e}) BETWEEN 4 AND 7 THEN 'H1' ELSE 'H2' END WHEN 'nine_months' THEN 'M9' WHEN 'annual' THEN 'FY' END END"
_KEY = "CASE WHEN {s} IS NULL THEN CAST({e} AS VARCHAR) WHEN " + _KIND + " = 'annual' THEN CAST(year({e}) AS VARCHAR) WHEN " + _KIND + " <> 'other' THEN CAST(year({e}) AS VARCHAR) || " + _QUARTER + " ELSE CAST({s} AS VARCHAR) || '/' || CAST({e} AS VARCHAR) END"
_ORDER_DAYS = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) AS e FROM orders"
_WALK = """ranked AS (SELECT *, row_number() OVER (PARTITION BY network_seq, from_qname ORDER BY coalesce(arc_order, 0.0), seq) AS rk FROM arcs),
 starts AS (SELECT network_seq, from_qname, min(seq) AS first FROM arcs GROUP BY ALL), pure AS (SELECT * FROM starts s WHERE NOT EXISTS (SELECT 1 FROM arcs a WHERE a.network_seq = s.network_seq AND a.to_qname = s.from_qname)),
 heads AS (SELECT * FROM pure UNION ALL SELECT network_seq, arg_min(from_qname, first), min(first) FROM starts WHERE network_seq NOT IN (SELECT network_seq FROM pure) GROUP BY 1),
 walk AS (SELECT network_seq, from_qname AS concept, 0 AS depth, CAST(NULL AS VARCHAR) AS preferred_label, [CAST(row_number() OVER (PARTITION BY network_seq ORDER BY first) AS BIGINT)] AS place, CAST([] AS VARCHAR[]) AS trail FROM heads
  UNION ALL SELECT w.network_seq, r.to_qname, w.depth + 1, r.preferred_label, list_append(w.place, CAST(r.rk AS BIGINT)), list_append(w.trail, w.concept) FROM walk w JOIN ranked r ON r.network_seq = w.network_seq AND r.from_qname = w.concept WHERE w.depth <= 14 AND NOT list_contains(w.trail, w.concept)),
 walked AS (SELECT *, row_number() OVER (PARTITION BY network_seq ORDER BY place) AS ordinal FROM walk)"""
_CALC = """calc AS (SELECT a.network_seq, n.role_uri, from_qname AS parent, to_qname AS child, coalesce(weight, 1.0) AS weight, a.seq AS arc_seq FROM arcs a JOIN networks n ON n.seq = a.network_seq WHERE kind = 'calculation'),
 slots AS (SELECT DISTINCT c.network_seq, c.parent, t.report_id, t.period_id, t.unit_id FROM calc c JOIN totals t ON t.concept = c.parent OR t.concept = c.child),
 rolled AS (SELECT s.report_id, s.network_seq, s.parent, s.period_id, s.unit_id, any_value(p.numeric_value) AS reported, any_value(p.decimals) AS decimals, sum(c.weight * k.numeric_value) AS computed, count(k.numeric_value) AS present, count(*) AS terms,
   coalesce(string_agg(CASE WHEN k.numeric_value IS NULL THEN c.child END, ',' ORDER BY c.child), '') AS missing
  FROM slots s JOIN calc c ON c.network_seq = s.network_seq AND c.parent = s.parent LEFT JOIN totals k ON k.report_id = s.report_id AND k.period_id = s.period_id AND k.unit_id IS NOT DISTINCT FROM s.unit_id AND k.concept = c.child
  LEFT JOIN totals p ON p.report_id = s.report_id AND p.period_id = s.period_id AND p.unit_id IS NOT DISTINCT FROM s.unit_id AND p.concept = s.parent GROUP BY 1, 2, 3, 4, 5)"""
_BALANCE = """pairs AS (SELECT a.report_id, a.period_id, 'LiabilitiesAndStockholdersEquity' AS against, a.numeric_value AS assets, b.numeric_value AS counterpart, greatest(""" + _TOL.format("a.decimals") + ", " + _TOL.format("b.decimals") + """) AS allowed
 FROM totals a JOIN totals b ON a.report_id = b.report_id AND a.period_id = b.period_id AND a.unit_id = b.unit_id WHERE a.concept = 'tb:Assets' AND b.concept = 'tb:LiabilitiesAndStockholdersEquity')"""
#: The fold over duplicates: best so far = the greatest (precision, earliest) before each row.
_CONFLICTS = f"""chain AS (SELECT *, arg_max(numeric_value, [{_PREC}, -seq]) OVER w AS kept_value, arg_max(decimals, [{_PREC}, -seq]) OVER w AS kept_decimals, count(*) OVER w AS before FROM facts
 WINDOW w AS (PARTITION BY report_id, concept, period_id, unit_id, dims_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 clashes AS (SELECT report_id, concept, period_id, unit_id, dims_key, kept_value, numeric_value AS rival_value, seq FROM chain WHERE before > 0 AND abs(numeric_value - kept_value) > greatest({_TOL.format('decimals')}, {_TOL.format('kept_decimals')})
 QUALIFY row_number() OVER (PARTITION BY report_id, concept, period_id, unit_id, dims_key ORDER BY seq) = 1)"""
_TITLES = r"""known0 AS (SELECT role_uri, arg_min(definition, seq) FILTER (definition IS NOT NULL) AS d FROM networks GROUP BY 1),
 defs AS (SELECT n.role_uri, CASE WHEN b.role_uri IS NOT NULL AND (k.d IS NULL OR k.d IS NOT DISTINCT FROM b.d) THEN b.role_uri ELSE n.role_uri END AS folded, definition, seq, kind FROM networks n JOIN known0 k USING (role_uri) LEFT JOIN known0 b ON regexp_matches(n.role_uri, '_\d+$') AND b.role_uri = regexp_replace(n.role_uri, '_\d+$', '')),
 one AS (SELECT folded AS role_uri, arg_min(definition, seq) FILTER (definition IS NOT NULL) AS definition, list_sort(list(DISTINCT kind)) AS kinds FROM defs GROUP BY 1),
 named AS (SELECT *, nullif(regexp_extract(definition, '^\s*(\d+)\s*-\s*(Statement|Disclosure|Document|Schedule)\s*-\s*(.*)$', 1), '') AS number, nullif(regexp_extract(definition, '^\s*(\d+)\s*-\s*(Statement|Disclosure|Document|Schedule)\s*-\s*(.*)$', 2), '') AS category,
   coalesce(nullif(trim(regexp_extract(definition, '^\s*(\d+)\s*-\s*(Statement|Disclosure|Document|Schedule)\s*-\s*(.*)$', 3)), ''), definition) AS name FROM one),
 leveled AS (SELECT *, CASE WHEN name LIKE '%(Detail%' THEN 'details' WHEN name LIKE '%(Table%' THEN 'tables' WHEN name LIKE '%(Policies%' THEN 'policies' WHEN name LIKE '%(Parenthetical%' THEN 'parenthetical' WHEN category = 'Statement' THEN 'statement' WHEN category = 'Disclosure' THEN 'note'
   WHEN category = 'Document' THEN 'document' WHEN category = 'Schedule' THEN 'details' ELSE 'other' END AS level, trim(regexp_replace(name, '\s*\((Details?|Tables?|Policies|Parentheticals?)[^)]*\)', '')) AS bare FROM named),
 blocks AS (SELECT role_uri, definition, number, category, name, level, kinds, CASE WHEN level IN ('details','tables','policies','note','parenthetical') AND bare LIKE '% - %' THEN trim(split_part(bare, ' - ', 1)) ELSE bare END AS family,
   CASE WHEN level IN ('details','tables','policies','note','parenthetical') AND bare LIKE '% - %' THEN trim(substr(bare, strpos(bare, ' - ') + 3)) END AS subtitle, row_number() OVER (ORDER BY coalesce(number, '~'), role_uri) AS place FROM leveled)"""
_ALL_NETWORKS = f"WITH networks AS ({adapter.NETWORKS} UNION ALL {adapter.oracle(adapter.VARIED_NETWORKS)}), arcs AS (SELECT network_seq, seq, arcrole, from_qname, to_qname FROM ({adapter.ARCS}) UNION ALL {adapter.oracle(adapter.VARIED_ARCS)})"
_FOLDS = r"""known AS (SELECT role_uri, arg_min(definition, seq) FILTER (definition IS NOT NULL) AS d FROM networks GROUP BY 1),
 folds AS (SELECT k.role_uri, CASE WHEN b.role_uri IS NOT NULL AND (k.d IS NULL OR k.d IS NOT DISTINCT FROM b.d) THEN b.role_uri ELSE k.role_uri END AS folds_to FROM known k LEFT JOIN known b ON regexp_matches(k.role_uri, '_\d+$') AND b.role_uri = regexp_replace(k.role_uri, '_\d+$', ''))"""
_STATED = "CASE WHEN contains({t}, 'cash flow') THEN 'cash_flow_statement' WHEN regexp_matches({t}, 'balance sheet|financial position') THEN 'balance_sheet' WHEN regexp_matches({t}, '(stockholders|shareholders)'' equity|changes in equity') THEN 'equity_statement' WHEN regexp_matches({t}, 'operations|income|earnings') THEN 'income_statement' END"
_SEGMENTS = "('tb:AUTOMOBILEMember'), ('tb:BUILDINGMember'), ('tb:FURNITUREMember'), ('tb:SegmentDomain')"

ORACLES: dict[str, str] = {
    "fact_grid_consolidated": f"""{_WITH}, {_BEST}, {_TOTAL}, asked AS (SELECT * FROM (VALUES ('tb:NetRevenue', 0), ('tb:GrossRevenue', 1), ('tb:Assets', 2), ('tb:Discounts', 3)) AS v(concept, "at"))
      SELECT report_id, concept, period_id, unit_id, numeric_value, decimals, row_number() OVER (PARTITION BY report_id ORDER BY end_date DESC, "at", seq) AS rank, count(*) OVER (PARTITION BY report_id) AS total
      FROM totals JOIN asked USING (concept) WHERE period_type = 'duration' AND {_DAYS.format(s='start_date', e='end_date')} BETWEEN 350 AND 380""",
    "fact_grid_dimensional": f"""{_WITH}, {_BEST} SELECT report_id, concept, period_id, dims_key, numeric_value, rank FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY end_date DESC, dim_count, dims_key, seq) AS rank
      FROM best WHERE concept = 'tb:GrossRevenue' AND dims_key LIKE '%SegmentAxis%' AND lower(dims_key) LIKE '%building%') WHERE rank <= 500""",
    "fact_grid_latest_span": f"""{_WITH} SELECT report_id, concept, end_date, period_id, numeric_value FROM facts WHERE dims_key = '' QUALIFY row_number() OVER (PARTITION BY report_id, concept, end_date ORDER BY coalesce(date_diff('day', start_date, end_date), 0) DESC, {_PREC} DESC, seq) = 1""",
    "dedup_most_precise": f"{_WITH}, {_BEST} SELECT report_id, concept, period_id, dims_key, numeric_value, decimals, seq FROM best",
    "dedup_most_precise_lineitem": """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_partkey FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_extendedprice, l_partkey, l_suppkey, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1""",
    "content_dedup_documents": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1",
    "resolve_concepts": f"""{_WITH}, asked AS (SELECT * FROM (VALUES (0, 'tb:NetRevenue'), (1, 'GrossRevenue'), (2, 'Assets'), (3, 'Discounts'), (4, 'us:quantity'), (5, 'Nothing')) AS v("at", name)),
      hits AS (SELECT "at", qname FROM asked JOIN concepts ON lower(qname) = lower(name) UNION SELECT "at", qname FROM asked JOIN concepts ON lower(split_part(qname, ':', 2)) = lower(regexp_replace(name, '^[^:]*:', '')))
      SELECT CAST(min("at") AS INT) AS "at", qname FROM hits GROUP BY qname UNION ALL SELECT CAST("at" AS INT), '?' || name FROM asked WHERE "at" NOT IN (SELECT "at" FROM hits)""",
    "resolve_ranked": f"""{_WITH}, scored AS (SELECT qname, CASE WHEN lower(split_part(qname, ':', 2)) = 'revenue' OR lower(label) = 'revenue' THEN 90 WHEN lower(split_part(qname, ':', 2)) LIKE 'revenue%' OR lower(label) LIKE 'revenue%' THEN 70
        WHEN contains(lower(split_part(qname, ':', 2)), 'revenue') THEN 60 WHEN contains(lower(label), 'revenue') THEN 50 ELSE 0 END AS score, is_abstract, is_numeric, (SELECT count(*) FROM facts f WHERE f.concept = c.qname) AS facts FROM concepts c WHERE NOT is_hypercube_item AND NOT is_dimension_item)
      SELECT qname, CAST(score AS INT) AS score, facts, CAST(row_number() OVER (ORDER BY score DESC, facts DESC, is_abstract, NOT is_numeric, length(split_part(qname, ':', 2)), qname) AS INT) AS rank FROM scored WHERE score > 0""",
    "excluded_reasons": f"""{_WITH}, n AS (SELECT r.report_id, c.qname AS concept, c.is_abstract, c.is_domain_member, c.is_dimension_item, count(f.seq) AS facts, count(f.seq) FILTER (f.period_type = 'duration' AND {_DAYS.format(s='f.start_date', e='f.end_date')} BETWEEN 80 AND 100) AS kept,
        count(f.seq) FILTER (f.period_type = 'duration' AND {_DAYS.format(s='f.start_date', e='f.end_date')} BETWEEN 80 AND 100 AND f.dims_key = '') AS shown, count(f.seq) FILTER (f.period_type <> 'instant') AS spans FROM reports r CROSS JOIN concepts c LEFT JOIN facts f ON f.report_id = r.report_id AND f.concept = c.qname GROUP BY ALL)
      SELECT report_id, concept, facts, CASE WHEN facts = 0 AND is_domain_member THEN 'domain member' WHEN facts = 0 AND is_dimension_item THEN 'axis' WHEN facts = 0 AND is_abstract THEN 'abstract' WHEN facts = 0 THEN 'never tagged' WHEN kept = 0 AND spans = 0 THEN 'instants only' WHEN kept = 0 THEN 'no fact in the periods' ELSE 'dimensional only' END AS reason
      FROM n WHERE shown = 0""",
    "describe_counts": f"""{_WITH} SELECT report_id, count(*) AS facts, count(numeric_value) AS numeric_facts, count(*) FILTER (dims_key = '') AS consolidated_numeric, count(*) FILTER (dims_key <> '') AS dimensional, CAST(0 AS BIGINT) AS text_blocks, count(DISTINCT concept) AS concepts, count(DISTINCT period_id) AS periods, count(DISTINCT unit_id) AS units FROM facts GROUP BY 1""",
    "axis_census": f"""{_WITH} SELECT report_id, split_part(d, '=', 1) AS axis, count(DISTINCT split_part(d, '=', 2)) AS members, count(*) AS uses FROM (SELECT report_id, unnest(string_split(dims_key, '|')) AS d FROM facts WHERE dims_key <> '') GROUP BY ALL""",
    "period_census": f"""{_WITH} SELECT report_id, period_id, facts FROM (SELECT report_id, period_id, end_date, count(*) AS facts FROM facts GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY facts DESC, end_date DESC, period_id) <= 4""",
    "period_enrichment": f"""SELECT o_orderkey, {_KIND.format(s='s', e='e')} AS kind, {_QUARTER.format(s='s', e='e')} AS quarter, {_KEY.format(s='s', e='e')} AS key FROM ({_ORDER_DAYS})""",
    "period_literal_roundtrip": f"""SELECT o_orderkey, CAST(s AS VARCHAR) || 'T00:00:00/' || CAST(CAST(e + 1 AS DATE) AS VARCHAR) || 'T00:00:00' AS literal, s AS "start", e AS "end" FROM ({_ORDER_DAYS})""",
    "calculation_rollup": f"""{_WITH}, {_BEST}, {_TOTAL}, {_CALC} SELECT report_id, network_seq, parent, period_id, unit_id, reported, round(CASE WHEN present > 0 THEN computed END, 2) + 0.0 AS computed, round(reported - CASE WHEN present > 0 THEN computed END, 2) + 0.0 AS difference, missing FROM rolled""",
    "footing_check": f"""{_WITH}, {_BEST}, {_TOTAL}, {_CALC} SELECT report_id, network_seq, parent, period_id, abs(reported - computed) <= {_TOL.format('decimals')} AS foots, terms - present AS terms_missing FROM rolled WHERE reported IS NOT NULL AND present > 0""",
    "balance_check": f"""{_WITH}, {_BEST}, {_TOTAL}, {_BALANCE} SELECT report_id, period_id, against, assets, counterpart, round(assets - counterpart, 2) + 0.0 AS difference, abs(assets - counterpart) <= allowed AS balances FROM pairs""",
    "duplicate_conflicts": f"""{_WITH}, {_CONFLICTS} SELECT report_id, concept, period_id, unit_id, dims_key, kept_value, rival_value FROM clashes""",
    "check_report_verdict": f"""{_WITH}, {_BEST}, {_TOTAL}, {_CALC}, {_BALANCE}, {_CONFLICTS},
      feet AS (SELECT report_id, count(*) AS checked, count(*) FILTER (abs(reported - computed) <= {_TOL.format('decimals')}) AS footed FROM rolled WHERE reported IS NOT NULL AND present > 0 GROUP BY 1), poise AS (SELECT report_id, count(*) FILTER (abs(assets - counterpart) > allowed) AS unbalanced FROM pairs GROUP BY 1),
      clash AS (SELECT report_id, count(*) AS conflicts FROM clashes GROUP BY 1), n AS (SELECT report_id, count(*) AS facts FROM facts GROUP BY 1), lost AS (SELECT report_id, count(*) FILTER (qname IS NULL OR (is_numeric AND (numeric_value IS NULL OR unit_id IS NULL))) AS unsound FROM facts LEFT JOIN concepts ON qname = concept GROUP BY 1),
      joined AS (SELECT r.report_id, coalesce(facts, 0) AS facts, coalesce(checked, 0) AS checked, coalesce(footed, 0) AS footed, coalesce(unbalanced, 0) AS unbalanced, coalesce(conflicts, 0) AS conflicts, coalesce(unsound, 0) AS unsound
        FROM reports r LEFT JOIN n USING (report_id) LEFT JOIN feet USING (report_id) LEFT JOIN poise USING (report_id) LEFT JOIN clash USING (report_id) LEFT JOIN lost USING (report_id))
      SELECT *, facts > 0 AND checked = footed AND unbalanced + conflicts + unsound = 0 AS ok FROM joined""",
    "reference_problems": f"""{_WITH}, bad AS (SELECT report_id, seq, seq % 97 = 0 AS c, seq % 79 = 0 AS p, seq % 89 = 0 AS u, seq % 83 = 0 AND seq % 89 <> 0 AS n FROM facts)
      SELECT report_id, seq, CASE WHEN c THEN 'undeclared_concept' WHEN p THEN 'unknown_period' WHEN u THEN 'unknown_unit' ELSE 'no_unit' END AS code FROM bad WHERE c OR p OR u OR n""",
    "presentation_walk": f"""WITH RECURSIVE arcs AS ({adapter.ARCS}), {_WALK} SELECT network_seq, ordinal, depth, concept, preferred_label FROM walked""",
    "presentation_walk_places": f"""WITH RECURSIVE arcs AS (SELECT 1 AS network_seq, CAST(n_nationkey AS BIGINT) AS seq, 'r' || n_regionkey AS from_qname, 'n' || n_nationkey AS to_qname, CAST(NULL AS DOUBLE) AS arc_order, CAST(NULL AS VARCHAR) AS preferred_label FROM nation
      UNION ALL SELECT 1, c_custkey + 1000, 'n' || c_nationkey, 'c' || c_custkey, NULL, NULL FROM customer), {_WALK} SELECT ordinal, depth, concept FROM walked""",
    "statement_cells": f"""WITH RECURSIVE facts AS ({_FACTS}), arcs AS ({adapter.ARCS}), {_WALK}, {_BEST}, {_TOTAL}, shown AS (SELECT * FROM totals QUALIFY row_number() OVER (PARTITION BY report_id, concept, period_id ORDER BY seq DESC) = 1),
      cells AS (SELECT report_id, network_seq, ordinal, concept, period_id, numeric_value AS value, end_date, coalesce(date_diff('day', start_date, end_date), 0) AS span, count(*) OVER (PARTITION BY report_id, network_seq, period_id) AS uses FROM walked JOIN shown USING (concept))
      SELECT report_id, network_seq, ordinal, concept, period_id, value, "column" FROM (SELECT *, dense_rank() OVER (PARTITION BY report_id, network_seq ORDER BY end_date DESC, span DESC, uses DESC, period_id) AS "column" FROM cells) WHERE "column" <= 8""",
    "budgeted_columns": f"""{_WITH}, uses AS (SELECT report_id, period_id, end_date, coalesce(date_diff('day', start_date, end_date), 0) AS span, count(DISTINCT concept) AS uses FROM facts WHERE dims_key = '' GROUP BY ALL),
      run AS (SELECT *, row_number() OVER w AS place, sum(uses * 36) OVER w AS total FROM uses WINDOW w AS (PARTITION BY report_id ORDER BY end_date DESC, span DESC, uses DESC, period_id)) SELECT report_id, period_id, uses, place FROM run WHERE total <= 16000 OR place <= 8""",
    "budgeted_members": f"""{_WITH}, n AS (SELECT report_id, concept, split_part(dims_key, '=', 1) AS axis, split_part(dims_key, '=', 2) AS member, count(*) AS n FROM facts WHERE dim_count = 1 GROUP BY ALL),
      run AS (SELECT *, row_number() OVER w AS place, sum(length(member) + 36 * n) OVER w AS total FROM n WINDOW w AS (PARTITION BY report_id, concept, axis ORDER BY n DESC, member)) SELECT report_id, concept, axis, member, place FROM run WHERE (total <= 16000 OR place <= 1) AND place <= 2""",
    "roots_except": f"{_ALL_NETWORKS} SELECT network_seq, from_qname AS qname FROM arcs EXCEPT SELECT network_seq, to_qname FROM arcs",
    "parse_titles": f"{_WITH}, {_TITLES} SELECT role_uri, number, category, name, level, family, subtitle, place FROM blocks",
    "role_folds": f"{_ALL_NETWORKS}, {_FOLDS} SELECT role_uri, folds_to FROM folds",
    "classify_networks": _ALL_NETWORKS + r""", heads AS (SELECT network_seq, min(from_qname) AS root FROM (SELECT network_seq, from_qname FROM arcs EXCEPT SELECT network_seq, to_qname FROM arcs) GROUP BY 1 HAVING count(*) = 1),
      texts AS (SELECT seq, role_uri, lower(replace(coalesce(definition, ''), chr(8217), chr(39))) AS t, lower(regexp_replace(regexp_replace(regexp_extract(role_uri, '[^/#]*$'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[-_.]+', ' ', 'g')) AS u, split_part(root, ':', 2) AS r FROM networks LEFT JOIN heads ON network_seq = seq WHERE kind = 'presentation'),
      named AS (SELECT seq, role_uri, t, u, """ + _STATED.format(t="t") + " AS by_title, " + _STATED.format(t="u") + r""" AS by_role, CASE WHEN r IN ('StatementOfFinancialPositionAbstract', 'BalanceSheetAbstract') THEN 'balance_sheet' WHEN r = 'StatementOfCashFlowsAbstract' THEN 'cash_flow_statement'
        WHEN r IN ('StatementOfChangesInEquityAbstract', 'StatementOfStockholdersEquityAbstract', 'StatementOfPartnersCapitalAbstract') THEN 'equity_statement' WHEN r IN ('IncomeStatementAbstract', 'StatementOfComprehensiveIncomeAbstract', 'StatementOfIncomeAndComprehensiveIncomeAbstract') THEN 'income_statement' END AS by_root FROM texts)
      SELECT seq, role_uri, CASE WHEN contains(t, 'parenthetical') THEN NULL WHEN by_title IS NOT NULL THEN by_title WHEN contains(u, 'parenthetical') THEN NULL ELSE coalesce(by_role, by_root) END AS statement FROM named""",
    "duplicate_conflicts_text": """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, min(l_returnflag) AS f FROM lineitem GROUP BY ALL), k AS (SELECT *, first_value(f) OVER w AS kept, row_number() OVER w AS p FROM v WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey))
      SELECT CAST(l_orderkey AS VARCHAR) AS concept, CAST(l_linenumber AS VARCHAR) AS period_id, kept AS kept_text, f AS rival_text FROM k WHERE f <> kept QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY p) = 1""",
    "graph_content_text_facts": "SELECT 'tb:c' || o_custkey AS concept, min(o_orderkey) AS seq, o_orderpriority AS value_str FROM orders GROUP BY o_custkey, o_orderpriority",
    "item_captions": "WITH raw AS (SELECT o_orderkey, (month(o_orderdate) % 9 + 1) || '.0' || (day(o_orderdate) % 9) AS a, '2.0' || (o_orderkey % 4) AS b FROM orders), lists AS (SELECT o_orderkey, CASE WHEN a = b AND a = '9.01' THEN [a] WHEN a = b THEN [a, '9.01'] WHEN a = '9.01' THEN [a, b] ELSE [a, b, '9.01'] END AS l FROM raw), captions(item, caption) AS (VALUES " + ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in ITEM_CAPTIONS.items()) + """),
      each AS (SELECT o_orderkey, unnest(l) AS item, generate_subscripts(l, 1) - 1 AS place, list_contains(l, '2.02') AS earnings FROM lists) SELECT o_orderkey, CAST(place AS BIGINT) AS place, item, coalesce(caption, '') AS caption, earnings FROM each LEFT JOIN captions USING (item)""",
    "disclosure_families": f"""{_WITH}, {_TITLES}, shown AS (SELECT * FROM blocks WHERE list_contains(kinds, 'presentation')), lv AS (SELECT lower(family) AS k, lower(coalesce(category, '')) AS c, string_agg(level || '=' || n, ',' ORDER BY level || '=' || n) AS levels FROM (SELECT family, category, level, count(*) AS n FROM shown GROUP BY ALL) GROUP BY 1, 2)
      SELECT arg_min(family, place) AS family, arg_min(category, place) AS category, count(*) AS blocks, any_value(levels) AS levels FROM shown JOIN lv ON k = lower(family) AND c = lower(coalesce(category, '')) GROUP BY k, c""",
    "concept_roles": f"""{_WITH}, cites AS (SELECT DISTINCT a.network_seq, coalesce(n.definition, n.role_uri) AS name, unnest([from_qname, to_qname]) AS concept FROM arcs a JOIN networks n ON n.seq = a.network_seq WHERE n.kind = 'presentation')
      SELECT concept, string_agg(name, '; ' ORDER BY network_seq) AS names FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY network_seq) AS p FROM cites) WHERE p <= 3 GROUP BY concept""",
    "group_tree": f"""{_WITH}, {_TITLES}, shown AS (SELECT *, lower(family) || '|' || lower(coalesce(category, '')) AS k FROM blocks WHERE list_contains(kinds, 'presentation'))
      SELECT role_uri, arg_min(role_uri, place) OVER (PARTITION BY k) AS head, place, row_number() OVER (PARTITION BY k ORDER BY place) AS member_place FROM shown""",
    "block_footing": f"""{_WITH}, {_BEST}, {_TOTAL}, {_CALC}, uses AS (SELECT report_id, period_id, end_date, coalesce(date_diff('day', start_date, end_date), 0) AS span, count(DISTINCT concept) AS uses FROM facts WHERE dims_key = '' GROUP BY ALL),
      run AS (SELECT *, row_number() OVER w AS place, sum(uses * 36) OVER w AS total FROM uses WINDOW w AS (PARTITION BY report_id ORDER BY end_date DESC, span DESC, uses DESC, period_id)), shown AS (SELECT report_id, period_id FROM run WHERE total <= 16000 OR place <= 8),
      judged AS (SELECT *, abs(reported - computed) <= {_TOL.format('decimals')} AS foots FROM rolled WHERE reported IS NOT NULL AND present > 0)
      SELECT report_id, network_seq, bool_and(foots) AS foots, count(*) AS checked, count(*) FILTER (NOT foots) AS differences FROM judged SEMI JOIN shown USING (report_id, period_id) GROUP BY 1, 2""",
    "hypercube_members": """WITH RECURSIVE arcs AS (""" + adapter.ARCS + """), down AS (SELECT to_qname AS member, 1 AS depth, [seq] AS place, ['tb:SegmentDomain', to_qname] AS trail FROM arcs WHERE arcrole = 'domain-member' AND from_qname = 'tb:SegmentDomain'
      UNION ALL SELECT a.to_qname, d.depth + 1, list_append(d.place, a.seq), list_append(d.trail, a.to_qname) FROM down d JOIN arcs a ON a.arcrole = 'domain-member' AND a.from_qname = d.member WHERE NOT list_contains(d.trail, a.to_qname))
      SELECT 'http://tb/role/RevenueDetails' AS role_uri, 'tb:RevenueTable' AS cube, 'tb:SegmentAxis' AS axis, member, row_number() OVER (ORDER BY min(depth), min(place)) AS place FROM down GROUP BY member""",
    "fact_membership": f"""{_WITH}, shown AS (SELECT DISTINCT n.role_uri, unnest([a.from_qname, a.to_qname]) AS concept FROM arcs a JOIN networks n ON n.seq = a.network_seq WHERE n.kind = 'presentation'),
      dims AS (SELECT report_id, seq, split_part(d, '=', 1) AS axis, split_part(d, '=', 2) AS member FROM (SELECT report_id, seq, unnest(string_split(dims_key, '|')) AS d FROM facts WHERE dims_key <> '')),
      cube_ok AS (SELECT report_id, seq FROM dims GROUP BY 1, 2 HAVING bool_and(axis = 'tb:ReturnAxis' OR (axis = 'tb:SegmentAxis' AND member IN (SELECT * FROM (VALUES {_SEGMENTS})))))
      SELECT f.report_id, f.seq, s.role_uri FROM facts f JOIN shown s USING (concept) WHERE f.dims_key = '' OR (s.role_uri = 'http://tb/role/RevenueDetails' AND (f.report_id, f.seq) IN (SELECT (report_id, seq) FROM cube_ok))""",
    "graph_nodes_fact": f"""{_WITH}, {_CONTENT} SELECT {_uuid5("'fact:' || " + _FACT_URI)} AS identifier, {_FACT_URI} AS uri, numeric_value, 'Numeric' AS fact_type, decimals, dims_key <> '' AS has_dimensions, CAST(dim_count AS BIGINT) AS dimension_count FROM kept""",
    "graph_nodes_period": f"""{_WITH} SELECT DISTINCT {_uuid5(_PERIOD_URI)} AS identifier, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, CAST(year(end_date) AS INT) AS calendar_year, {_QUARTER.format(s='start_date', e='end_date')} AS calendar_quarter,
      CAST(coalesce({_DAYS.format(s='start_date', e='end_date')}, 1) AS INT) AS days_in_period, period_type, {_KIND.format(s='start_date', e='end_date')} AS duration_type, {_KEY.format(s='start_date', e='end_date')} AS calendar_period_key FROM facts""",
    "graph_nodes_element": f"""{_WITH}, cited AS (SELECT concept AS q FROM facts UNION SELECT unnest([from_qname, to_qname]) FROM arcs UNION SELECT unnest(string_split(d, '=')) FROM (SELECT unnest(string_split(dims_key, '|')) AS d FROM facts WHERE dims_key <> ''))
      SELECT {_ELEMENT.format('qname')} AS identifier, qname, split_part(qname, ':', 2) AS name, is_abstract, is_numeric FROM concepts WHERE qname IN (SELECT q FROM cited)""",
    "graph_edges_fact_dimension": f"""{_WITH}, {_CONTENT}, d AS (SELECT report_id, seq, unnest(string_split(dims_key, '|')) AS d FROM kept WHERE dims_key <> '')
      SELECT {_uuid5("'fact:' || " + _FACT_URI)} AS "from", {_uuid5("'dimension:https://example.org/report/' || report_id || '#dimension-https://example.org/taxonomy/tb#' || split_part(split_part(d, '=', 1), ':', 2) || '-https://example.org/taxonomy/tb#' || split_part(split_part(d, '=', 2), ':', 2)")} AS "to" FROM d""",
    "graph_edges_fact_period": f"""{_WITH}, {_CONTENT} SELECT {_uuid5("'fact:' || " + _FACT_URI)} AS "from", {_uuid5(_PERIOD_URI)} AS "to" FROM kept""",
    "graph_merge": """SELECT 'e' || o_custkey AS identifier, printf('%.2f', max(o_totalprice)) AS name FROM orders o WHERE year(o_orderdate) = (SELECT max(year(i.o_orderdate)) FROM orders i WHERE i.o_custkey = o.o_custkey) GROUP BY o_custkey""",
    "csr_indptr": f"""{_WITH}, n AS (SELECT entity_cik, {_uuid5("'entity:nation#' || entity_cik")} AS id, count(*) AS degree FROM reports GROUP BY entity_cik) SELECT row_number() OVER (ORDER BY id) - 1 AS source, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pointer, degree FROM n""",
    "csr_indices": f"""{_WITH}, e AS (SELECT DISTINCT entity_cik, {_uuid5("'entity:nation#' || entity_cik")} AS id FROM reports), eo AS (SELECT entity_cik, row_number() OVER (ORDER BY id) - 1 AS source FROM e), r AS (SELECT report_id, entity_cik, row_number() OVER (ORDER BY {_uuid5("'report:https://example.org/report/' || report_id")}) - 1 AS target FROM reports)
      SELECT source, target FROM r JOIN eo USING (entity_cik)""",
    "graph_pattern_revenue_by_report": f"""{_WITH}, {_CONTENT} SELECT report_id, numeric_value AS value FROM kept WHERE dims_key = '' AND concept = 'tb:NetRevenue'""",
    "rdf_triples": f"""{_WITH}, d AS (SELECT report_id, unnest(string_split(dims_key, '|')) AS d FROM facts WHERE dims_key <> ''), f AS (SELECT count(*) AS n FROM facts), i AS (SELECT count(DISTINCT (report_id, d)) AS n FROM d), pd AS (SELECT count(DISTINCT period_id) AS n, count(DISTINCT CASE WHEN start_date IS NOT NULL THEN period_id END) AS s FROM facts),
      u AS (SELECT count(DISTINCT unit_id) AS n FROM facts), r AS (SELECT count(*) AS n FROM reports), c AS (SELECT count(*) AS n, count(balance) AS b, count(*) FILTER (is_abstract) AS a FROM concepts), w AS (SELECT count(*) AS n, count(definition) AS d FROM networks), a AS (SELECT count(*) AS n, count(arc_order) AS o, count(weight) AS w FROM arcs)
      SELECT p, CAST(n AS BIGINT) AS n FROM (SELECT unnest(['inReport', 'element', 'period', 'unit', 'value', 'decimals']) AS p, n FROM f UNION ALL SELECT 'dimension', count(*) FROM d UNION ALL SELECT unnest(['axis', 'member']), n FROM i UNION ALL SELECT 'start', s FROM pd UNION ALL SELECT 'end', n FROM pd UNION ALL SELECT 'measure', n FROM u
        UNION ALL SELECT unnest(['reportedBy', 'fiscalYear']), n FROM r UNION ALL SELECT unnest(['qname', 'label', 'periodType']), n FROM c UNION ALL SELECT 'balance', b FROM c UNION ALL SELECT 'abstract', a FROM c UNION ALL SELECT 'role', n FROM w UNION ALL SELECT 'definition', d FROM w
        UNION ALL SELECT unnest(['inNetwork', 'from', 'to']), n FROM a UNION ALL SELECT 'order', o FROM a UNION ALL SELECT 'weight', w FROM a UNION ALL SELECT 'rdf:type', (SELECT n FROM f) + (SELECT n FROM i) + (SELECT n FROM pd) + (SELECT n FROM u) + (SELECT n FROM r) + (SELECT n FROM c) + (SELECT n FROM w) + (SELECT n FROM a))""",
    "shape_violations": f"""{_WITH} SELECT 'Element' AS shape, 'balance' AS path, 'count' AS rule, count(*) AS n FROM concepts WHERE balance IS NULL UNION ALL SELECT 'Network', 'definition', 'count', count(*) FROM networks WHERE definition IS NULL""",
    "graph_counts": f"""{_WITH}, {_CONTENT}, d AS (SELECT report_id, seq, unnest(string_split(dims_key, '|')) AS d FROM kept WHERE dims_key <> ''), ids AS (SELECT count(DISTINCT (report_id, d)) AS n FROM d), cited AS (SELECT concept AS q FROM facts UNION SELECT unnest([from_qname, to_qname]) FROM arcs UNION SELECT unnest(string_split(d, '=')) FROM d),
      el AS (SELECT count(*) AS n FROM concepts WHERE qname IN (SELECT q FROM cited)), asc_ AS (SELECT count(DISTINCT (n.role_uri, arcrole, from_qname, to_qname, coalesce(CAST(arc_order AS VARCHAR), ''), coalesce(preferred_label, ''))) AS n FROM arcs a JOIN networks n ON n.seq = a.network_seq), st AS (SELECT count(DISTINCT role_uri) AS n FROM networks), f AS (SELECT count(*) AS n FROM kept), r AS (SELECT count(*) AS n FROM reports)
      SELECT name, CAST(n AS BIGINT) AS "rows" FROM (SELECT unnest(['Fact', 'REPORT_HAS_FACT', 'FACT_HAS_ELEMENT', 'FACT_HAS_PERIOD', 'FACT_HAS_UNIT', 'FACT_HAS_ENTITY']) AS name, n FROM f UNION ALL SELECT 'FACT_HAS_DIMENSION', count(*) FROM d UNION ALL SELECT unnest(['Dimension', 'DIMENSION_HAS_AXIS_ELEMENT', 'DIMENSION_HAS_MEMBER_ELEMENT']), n FROM ids
        UNION ALL SELECT unnest(['Element', 'Label', 'ELEMENT_HAS_LABEL']), n FROM el UNION ALL SELECT unnest(['Association', 'STRUCTURE_HAS_ASSOCIATION', 'ASSOCIATION_HAS_FROM_ELEMENT', 'ASSOCIATION_HAS_TO_ELEMENT']), n FROM asc_ UNION ALL SELECT unnest(['Structure', 'STRUCTURE_HAS_TAXONOMY']), n FROM st UNION ALL SELECT unnest(['Report', 'ENTITY_HAS_REPORT', 'REPORT_USES_TAXONOMY']), n FROM r
        UNION ALL SELECT 'Entity', count(DISTINCT entity_cik) FROM reports UNION ALL SELECT 'Period', count(DISTINCT period_id) FROM facts UNION ALL SELECT 'Unit', count(DISTINCT unit_id) FROM facts UNION ALL SELECT 'Taxonomy', 1)""",
    "rdf_consolidated_facts": f"""{_WITH} SELECT concept, label AS name, CAST(end_date AS VARCHAR) AS "end", CAST(CAST(numeric_value AS DECIMAL(38,2)) AS DOUBLE) AS value, f.period_type, {_KIND.format(s='start_date', e='end_date')} AS duration_type, unit_id AS measure FROM facts f JOIN concepts ON qname = concept WHERE dims_key = ''""",
    "oim_facts": f"""{_WITH} SELECT report_id, 'f-' || row_number() OVER (PARTITION BY report_id ORDER BY seq) AS key, regexp_replace(regexp_replace(CAST(CAST(numeric_value AS DECIMAL(38,2)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS value, try_cast(decimals AS INT) AS decimals, concept,
      CASE WHEN period_type = 'duration' THEN CAST(start_date AS VARCHAR) || 'T00:00:00/' ELSE '' END || CAST(CAST(end_date + 1 AS DATE) AS VARCHAR) || 'T00:00:00' AS period, unit_id AS unit, dims_key FROM facts""",
    "equation_terms": f"""{_WITH} SELECT role_uri, from_qname AS total, string_agg(CASE WHEN weight < 0 THEN '-' ELSE '+' END || to_qname, ' ' ORDER BY a.seq) AS terms FROM arcs a JOIN networks n ON n.seq = a.network_seq WHERE kind = 'calculation' GROUP BY 1, 2""",
    "events_props_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "search_counts": r"""SELECT id, hits FROM (SELECT doc_id AS id, CAST(len(regexp_extract_all(text, '(?i)\b(the|license[d]?)\b')) AS BIGINT) AS hits FROM documents) WHERE hits > 0""",
    "term_counts": r"""SELECT term, CAST(sum(len(regexp_extract_all(text, '(?i)\b' || term))) AS BIGINT) AS n FROM documents CROSS JOIN (VALUES ('the'), ('under'), ('license')) AS v(term) GROUP BY term""",
    "section_hits": """WITH lines AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS section FROM documents),
      n AS (SELECT id, CAST(section AS INT) AS section, CAST(len(string_split(lower(line), 'the')) - 1 AS BIGINT) AS hits FROM lines)
      SELECT id, section, hits, sections FROM (SELECT *, count(*) OVER (PARTITION BY id) AS sections, row_number() OVER (PARTITION BY id ORDER BY hits DESC, section) AS p FROM n WHERE hits > 0) WHERE p <= 10""",
    "text_assembly_offsets": """SELECT conv_id AS id, turn AS place, CAST(coalesce(sum(length(role) + 7 + length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS BIGINT) AS start, CAST(length(text) AS INT) AS chars FROM conversations""",
    "normalize_whitespace": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t\r\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS digest FROM documents""",
    "squash": "SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]', '', 'g') AS squashed FROM part",
    "read_page": "SELECT doc_id AS id, substr(text, 1001, 400) AS page, CAST(length(text) AS INT) AS chars, CASE WHEN length(text) > 1400 THEN 1400 END AS next_offset FROM documents WHERE length(text) > 1000",
    "value_precision": """SELECT round(CASE WHEN m = 0 THEN 0.0 WHEN m IN (1, 2) THEN 0.5 ELSE 0.5 * pow(10.0, -(s - 3)) END, 6) AS tolerance, count(*) AS n FROM (SELECT l_partkey % 5 AS m, l_suppkey % 7 AS s FROM lineitem) GROUP BY 1""",
}
