"""DuckDB SQL of queries_intake and of the queries on filing documents, written apart from the operators: it makes the same inputs and states each rule over them."""

from __future__ import annotations

from .functions.ids import PACKAGE_NAMESPACE
from .oracles import _ALL_NETWORKS, _KIND, _WALK, _WITH
from .oracles import ORACLES as _REPORT_ORACLES
from .sources import adapter

_O = "o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(o_orderdate AS DATE) AS d, month(o_orderdate) AS m, o_orderstatus AS s, o_orderpriority AS p FROM orders)"
_RAW = f"""{_O}, raw AS (SELECT 'r' || c % 10 AS report_id, k AS seq, 'tb:' || p AS concept, 'c' || m AS context, CASE k % 3 WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' END AS unit, CASE WHEN k % 11 = 0 THEN 'n/a' ELSE c || '.5' END AS value FROM o),
  judged AS (SELECT *, CASE WHEN context = 'c7' THEN 'undeclared_context' WHEN concept = 'tb:5-LOW' THEN 'undeclared_concept' END AS reason FROM raw)"""
_AUTHORED = f"""{_O}, made AS (SELECT 'r' AS report_id, k AS seq, ['a:Sales', 'a:Cash', 'a:Note', 'a:None'][k % 4 + 1] AS concept, CASE WHEN k % 5 <> 0 THEN day END AS "start", CASE WHEN k % 7 = 0 THEN 'bad' WHEN k % 11 = 0 THEN NULL ELSE CAST(d + CAST(k % 13 - 1 AS INT) AS VARCHAR) END AS "end",
    CASE WHEN k % 3 <> 0 THEN 'USD' END AS unit, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN 'x' ELSE CAST(c AS VARCHAR) END AS value, '0' AS decimals FROM o),
  typed AS (SELECT *, try_cast("start" AS DATE) AS s, try_cast("end" AS DATE) AS e, try_cast(value AS DOUBLE) AS number, concept IN ('a:Sales', 'a:Cash') AS is_number FROM made),
  judged AS (SELECT *, concat_ws('; ', CASE WHEN concept = 'a:None' THEN 'unknown concept' END, CASE WHEN e IS NULL THEN 'no end date' END, CASE WHEN concept IN ('a:Sales', 'a:Note') AND s IS NULL THEN 'no start date' END, CASE WHEN s > e THEN 'start after end' END,
    CASE WHEN is_number AND number IS NULL THEN 'not a number' END, CASE WHEN is_number AND unit IS NULL THEN 'no unit' END, CASE WHEN value IS NULL THEN 'no value' END) AS faults FROM typed)"""
_SUBMITTED = f"WITH {_O} SELECT CAST(c AS VARCHAR) AS cik, 'a-' || k AS accession, p AS form, day AS filed, day AS reported, s || '.htm' AS document FROM o"
_HEADS = """CASE doc_id % 9 WHEN 0 THEN '{"documentInfo": {}, "facts": ' WHEN 1 THEN '{"@graph": [{"@type": "AccountingEquation"}]' WHEN 2 THEN '{"@context": ' WHEN 3 THEN '{"xbrl:fact": ' WHEN 4 THEN '{"concepts": {}, "networks": '
  WHEN 5 THEN '<html><ix:header>' WHEN 6 THEN 'FORM 10-q/A ' WHEN 7 THEN 'Annual report on form 20-F, ' ELSE '' END"""
_TIDY = r"trim(regexp_replace(regexp_replace(regexp_replace(replace({0}, chr(160), ' '), '[ \t\r\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
_UUID = f"sha1(unhex('{PACKAGE_NAMESPACE.hex}') || encode('period:' || coalesce(CAST(start_date AS VARCHAR) || '/', '') || coalesce(CAST(end_date AS VARCHAR), 'Forever')))"

ORACLES: dict[str, str] = {
    "network_kinds": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'presentation' WHEN 1 THEN 'calculation' WHEN 2 THEN 'calculation' WHEN 5 THEN 'definition' END AS kind FROM part",
    "context_periods": f"""WITH {_O}, p AS (SELECT 'r' AS report_id, CAST(k AS VARCHAR) AS context, CASE k % 5 WHEN 0 THEN 'instant' WHEN 1 THEN 'instant' WHEN 4 THEN 'forever' ELSE 'duration' END AS period_type, CASE WHEN k % 5 IN (2, 3) THEN d END AS start_date,
        CASE k % 5 WHEN 0 THEN d WHEN 1 THEN CAST(d - 1 AS DATE) WHEN 2 THEN CAST(d + 90 AS DATE) WHEN 3 THEN CAST(d + 89 AS DATE) END AS end_date FROM o), h AS (SELECT *, {_UUID} AS h FROM p)
      SELECT report_id, context, period_type, start_date, end_date, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS INT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS period_id FROM h""",
    "assembled_facts": f"WITH {_RAW} SELECT report_id, seq, concept, context, CASE WHEN unit = 'USD' THEN 'iso4217:USD' END AS measure, CASE WHEN unit IS NOT NULL THEN try_cast(value AS DOUBLE) END AS numeric_value FROM judged WHERE reason IS NULL",
    "dropped_facts": f"WITH {_RAW} SELECT report_id, seq, concept, context, reason FROM judged WHERE reason IS NOT NULL",
    "drop_ledger": f"""WITH {_RAW}, each AS (SELECT report_id, reason, context, concept, min(seq) AS first, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY report_id, reason, context ORDER BY first) AS r FROM each)
      SELECT report_id, reason, context, CAST(sum(n) AS BIGINT) AS n, string_agg(concept, ';' ORDER BY first) FILTER (r <= 5) AS concepts FROM ranked GROUP BY ALL""",
    "recovered_contexts": f"""WITH {_O}, stated AS (SELECT c, k % 2 = 0 AS opens, d FROM o WHERE k % 5 = 0), days AS (SELECT c, min(d) FILTER (opens) AS start_date, min(d) FILTER (NOT opens) AS end_date FROM stated GROUP BY c HAVING count(DISTINCT d) FILTER (opens) = 1 AND count(DISTINCT d) FILTER (NOT opens) = 1)
      SELECT 'r' AS report_id, 'x' || c AS context, start_date, end_date FROM days JOIN customer ON c_custkey = c WHERE start_date <= end_date AND c_mktsegment NOT IN ('FURNITURE', 'MACHINERY')""",
    "cover_pages": f"""WITH {_O}, best AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY c, k % 2 ORDER BY k % 3 > 0, k) = 1)
      SELECT 'c' || c AS report_id, max(s || k) FILTER (k % 2 = 0) AS "EntityRegistrantName", max(s || k) FILTER (k % 2 = 1) AS "DocumentType" FROM best GROUP BY c""",
    "filled_fields": "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 1 THEN c_name WHEN c_custkey % 2 = 0 THEN 'F' || c_custkey END AS name, c_mktsegment AS segment FROM customer",
    "identity_codecs": f"""WITH {_O}, n AS (SELECT k, CASE k % 4 WHEN 0 THEN lpad(CAST(k AS VARCHAR), 12, '0') WHEN 1 THEN ' ' || k || ' ' WHEN 2 THEN 'X' || k ELSE CAST(k * 1000000007 AS VARCHAR) END AS t FROM o), b AS (SELECT *, trim(t) AS u, ltrim(trim(t), '0') AS v FROM n)
      SELECT k, CASE WHEN NOT regexp_full_match(u, '[0-9]+') THEN t WHEN length(v) > 10 THEN v ELSE lpad(v, 10, '0') END AS cik, '12' || k || '9' AS ein, substr(md5(CAST(k AS VARCHAR)), 1, 16) AS slug, substr(sha256(CAST(k AS VARCHAR)), 1, 24) AS sha FROM b""",
    "prefix_bindings": f"""WITH {_O}, n AS (SELECT 'r' || c % 100 AS report_id, s AS prefix, 'ns' || CASE WHEN c % 100 < 50 THEN 1 ELSE k % 2 END AS namespace FROM o) SELECT report_id, prefix, min(namespace) AS namespace FROM n GROUP BY 1, 2 HAVING count(DISTINCT namespace) = 1""",
    "authored_facts": f"""WITH {_AUTHORED} SELECT report_id, seq, substr(sha256(concat_ws('|', report_id, concept, "start", "end", unit, value, decimals)), 1, 24) AS fact_id, concept, s AS start_date, e AS end_date, unit AS unit_id, CASE WHEN is_number THEN number END AS numeric_value, value AS value_str, decimals
      FROM judged WHERE faults = ''""",
    "authored_faults": f"WITH {_AUTHORED} SELECT report_id, seq, concept, faults FROM judged WHERE faults <> ''",
    "newest_reports": f"""WITH {_O} SELECT c AS entity, 'o' || k AS report_id FROM o QUALIFY row_number() OVER (PARTITION BY c ORDER BY CASE WHEN k % 9 <> 0 THEN day END DESC NULLS LAST, day DESC, 'o' || k DESC) = 1""",
    "default_language": "SELECT report_id, language FROM (SELECT source AS report_id, lang AS language, count(*) AS n, min(doc_id) AS first FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY n DESC, first) = 1",
    "text_concepts": "SELECT source AS report_id, 'k' || doc_id % 40 AS concept, bool_or(coalesce(lang <> 'en', false)) AS is_text FROM documents GROUP BY 1, 2",
    "undefined_facts": f"WITH {_O} SELECT 'p' || c % 5 AS prefix, count(*) AS n FROM o WHERE c % 5 <> 3 AND p NOT LIKE '%URGENT' GROUP BY 1",
    "gap_report": f"{_WITH} SELECT 'period_type' AS what, period_type AS value, count(*) AS n FROM concepts GROUP BY ALL UNION ALL SELECT 'fact_period', period_type, count(*) FROM facts GROUP BY ALL",
    "submissions_list": _SUBMITTED,
    "submissions_merged": _SUBMITTED,
    "company_headers": """SELECT CAST(c_custkey AS VARCHAR) AS cik, c_name AS name, CASE WHEN c_custkey % 3 = 1 THEN '12' END AS ein, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) END AS ticker, CAST(NULL AS VARCHAR) AS exchange, c_mktsegment AS sic, '' AS entity_type,
      CASE WHEN c_custkey % 5 = 1 THEN 'www' WHEN c_custkey % 7 = 0 THEN 'inv' END AS website, '' AS phone FROM customer""",
    "tickers_to_cik": "SELECT ' ' || c_name AS ticker, CASE WHEN c_custkey % 3 <> 0 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS cik FROM customer",
    "api_filings": f"""WITH {_O}, r AS (SELECT CAST(k AS VARCHAR) AS id, c, 'Firm ' || c AS entity, day AS period_end, CAST(CAST(d + CAST(k % 5 AS INT) AS DATE) AS VARCHAR) AS processed FROM o)
      SELECT id, entity, period_end, processed, row_number() OVER (PARTITION BY c ORDER BY period_end <= '1998-01-01' DESC, period_end DESC, processed DESC, id) = 1 AS latest FROM r""",
    "search_pages": f"WITH {_O} SELECT count(*) OVER (PARTITION BY c % 20) AS total, 'a-' || k AS id, CAST(c AS VARCHAR) AS cik, 'Firm ' || c AS name, p AS form, day AS filed FROM o",
    "filing_index": f"""WITH {_O} SELECT c AS id, CAST(k AS INT) AS seq, 'Order ' || s AS description, 'd' || k || '.htm' AS document, p AS type, CASE WHEN k % 4 <> 0 THEN k * 10 END AS size, '/x/' || k || '.htm' AS url FROM o WHERE k % 6 <> 0 AND k % 7 <> 0""",
    "other_documents": f"""WITH {_O}, made AS (SELECT c AS id, k % 2 AS seq, 'd' || k % 2 AS stem, ['.xml', '.htm', '.pdf', '.xsd', '.zip'][k % 5 + 1] AS ending, ['EX-99', 'EX-101.INS', 'XML', '10-K', 'GRAPHIC', '4'][k % 6 + 1] AS type, k FROM o),
      own AS (SELECT * FROM made WHERE stem || ending <> 'd1.htm' AND type NOT IN ('EX-101.INS', 'XML', 'GRAPHIC') AND ending NOT IN ('.xsd', '.zip'))
      SELECT id, seq, stem || ending AS document, type, k FROM own a WHERE ending = '.xml' OR NOT EXISTS (SELECT 1 FROM own b WHERE b.id = a.id AND b.seq = a.seq AND b.stem = a.stem AND b.ending = '.xml')""",
    "chosen_reports": f"""WITH {_O}, made AS (SELECT c AS id, 'f' || m % 3 AS stem, ['.htm', '.xml', '.xsd', '.xml'][k % 4 + 1] AS ending, k % 1000 AS size, k % 9 = 0 AS inline, k % 9 <> 0 AND k % 2 = 1 AS instance FROM o),
      paired AS (SELECT DISTINCT id, stem FROM made WHERE ending = '.xsd'), n AS (SELECT id, count(*) AS n FROM made WHERE instance GROUP BY 1),
      tiers AS (SELECT m.*, CASE WHEN inline THEN 1 WHEN n.n = 1 THEN 2 WHEN (m.id, m.stem) IN (SELECT (id, stem) FROM paired) THEN 3 END AS tier FROM made m LEFT JOIN n USING (id) WHERE inline OR instance)
      SELECT id, 'd/' || stem || ending AS path FROM tiers WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, size DESC, stem || ending) = 1""",
    "root_schemas": "SELECT 'http://x.org/' || p_partkey || '.xsd' AS location FROM part WHERE p_partkey NOT IN (SELECT p_partkey * 3 FROM part)",
    "catalog_rewrites": """WITH l AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'http://y.org/' ELSE 'http://x.org/' END || p_type || '/' || p_partkey AS location FROM part)
      SELECT location, CASE WHEN location LIKE 'http://x.org/ECONOMY/1%' THEN 'file:/one' || substr(location, 23) WHEN location LIKE 'http://x.org/ECONOMY%' THEN 'file:/e' || substr(location, 21) WHEN location LIKE 'http://x.org/%' THEN 'file:/a/' || substr(location, 14) ELSE location END AS target FROM l""",
    "document_kinds": rf"""WITH t AS (SELECT doc_id, {_HEADS} || coalesce(text, '') AS t FROM documents), h AS (SELECT doc_id, t, substr(t, 1, 4000) AS h, lower(substr(t, 1, 10000)) AS l FROM t)
      SELECT doc_id, CASE WHEN contains(h, 'xbrl.org/2021/xbrl-json') OR (contains(h, '"documentInfo"') AND contains(h, '"facts"')) THEN 'oim' WHEN contains(h, '"@graph"') AND contains(h, 'AccountingEquation') THEN 'equations' WHEN contains(h, '"@graph"') OR contains(h, '"@context"') THEN 'json-ld'
        WHEN contains(h, '"xbrl:') THEN 'compiled' WHEN contains(h, '"concepts"') AND contains(h, '"networks"') THEN 'model' END AS kind, contains(l, 'http://www.xbrl.org/2013/inlinexbrl') OR contains(l, '<ix:') AS inline,
        nullif(upper(regexp_extract(substr(t, 1, 2000), '(?i)form\s+(10-[KQ](?:/A)?|20-F|40-F|8-K|6-K)', 1)), '') AS form FROM h""",
    "name_codecs": r"""WITH n AS (SELECT *, 'tb:Net' || p_size || 'CashFLOWFrom' || replace(p_name, ' ', 'To') || CASE WHEN p_partkey % 2 = 0 THEN 'TextBlock' ELSE '' END AS n FROM part), l AS (SELECT *, split_part(n, ':', 2) AS l FROM n)
      SELECT p_partkey, regexp_replace(regexp_replace(l, 'TextBlock$', ''), '([a-z])([A-Z])', '\1 \2', 'g') AS label, regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g') AS words, l AS local, CASE WHEN p_partkey % 3 <> 0 THEN 'tb' END AS prefix,
        trim(regexp_replace(lower(p_name || ' -- ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'http://x#' || l AS uri, CASE WHEN p_partkey % 3 <> 0 THEN 'en-us' END AS language, CASE WHEN p_partkey % 2 = 0 THEN 'cik:' ELSE 'entity:' END || p_partkey AS entity,
        CASE WHEN p_partkey % 2 = 0 THEN 'iso4217:USD' ELSE 'USD' END || CASE WHEN p_partkey % 3 = 0 THEN '/shares' ELSE '' END AS unit FROM l""",
    "role_labels": "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 2 = 0 THEN p_brand WHEN p_partkey % 7 <> 0 AND p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 4 <> 0 THEN p_name ELSE 'P' || p_partkey END AS label FROM part",
    "date_codecs": f"""WITH {_O}, n AS (SELECT *, CASE WHEN k % 10 = 0 THEN CAST('24' || substr(day, 3, 8) AS DATE) WHEN k % 10 = 1 THEN CAST('16' || substr(day, 3, 8) AS DATE) ELSE d END AS x FROM o), e AS (SELECT *, CASE WHEN k % 3 = 1 THEN CAST(x - 1 AS DATE) ELSE x END AS y FROM n)
      SELECT k, CASE WHEN k % 2 = 0 THEN d END AS filed, strftime(d, '%m%d') AS year_end, CASE WHEN k % 4 <> 0 THEN CAST(m AS INT) END AS month, CASE WHEN year(y) BETWEEN 1900 AND 2100 THEN y END AS closes, m = 7 OR year(d) = 1997 OR day = '1998-02-03' AS wanted FROM e""",
    "period_keys": f"{_WITH} SELECT report_id, seq, CASE period_type WHEN 'instant' THEN CAST(end_date AS VARCHAR) ELSE CAST(start_date AS VARCHAR) || '..' || CAST(end_date AS VARCHAR) END AS key FROM facts",
    "clean_narrative": r"""WITH t AS (SELECT doc_id, coalesce(text, '') || chr(10) || ' 12 ' || chr(10) || 'Page 4' || chr(10) || 'TABLE OF CONTENTS' || chr(10) || 'Also tb:OneMember  tb:TwoMember here' || chr(10) || 'No. 12345678901 ends ' || doc_id AS t FROM documents),
      l AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '\b\S+Member\b(\s+\S+Member\b)+', '', 'g'), '\b\d{10,}\b', '', 'g'))) AS l FROM t),
      k AS (SELECT doc_id, array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '(?i)^(\d{1,3}|page \d+|table of contents)$')), chr(10)) AS t FROM l) SELECT doc_id, md5(""" + _TIDY.format("t") + ") AS digest FROM k",
    "assembled_texts": "SELECT conv_id AS id, md5(string_agg('## ' || coalesce(role, '') || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1",
    "found_networks": f"""{_ALL_NETWORKS} SELECT n.seq, n.role_uri, 3 AS tier FROM networks n JOIN ({_REPORT_ORACLES['classify_networks']}) k ON k.seq = n.seq WHERE n.kind = 'presentation' AND k.statement = 'balance_sheet'""",
    "cube_arcs": """WITH c AS (SELECT 'role' || c_nationkey AS role_uri, c_mktsegment AS axis, c_custkey AS k FROM customer), axes AS (SELECT DISTINCT role_uri, axis FROM c WHERE k % 2 = 0), shown AS (SELECT role_uri, 't' || k % 3 AS parent, axis AS child FROM c UNION SELECT role_uri, 't' || k % 3, 'i' || k % 4 FROM c),
      cubes AS (SELECT role_uri, min(parent) AS cube FROM (SELECT DISTINCT role_uri, parent FROM shown) p WHERE EXISTS (SELECT 1 FROM axes a WHERE a.role_uri = p.role_uri) AND NOT EXISTS (SELECT 1 FROM axes a WHERE a.role_uri = p.role_uri AND (p.role_uri, p.parent, a.axis) NOT IN (SELECT (role_uri, parent, child) FROM shown)) GROUP BY 1)
      SELECT role_uri, cube, 'hypercube-dimension' AS arcrole, cube AS from_qname, axis AS to_qname FROM cubes JOIN axes USING (role_uri) UNION ALL SELECT role_uri, cube, 'all', child, cube FROM cubes JOIN shown USING (role_uri) WHERE parent = cube AND (role_uri, child) NOT IN (SELECT (role_uri, axis) FROM axes)""",
    "walk_page": f"""WITH RECURSIVE arcs AS ({adapter.ARCS}), {_WALK}, n AS (SELECT network_seq, count(*) AS total FROM walked GROUP BY 1), first AS (SELECT network_seq, array_to_string(trail, '>') AS ancestors FROM walked WHERE ordinal = 3)
      SELECT network_seq, ordinal, concept, total, ancestors, CASE WHEN total > 4 THEN CAST(4 AS BIGINT) END AS next_offset FROM walked JOIN n USING (network_seq) JOIN first USING (network_seq) WHERE ordinal IN (3, 4)""",
    "never_blank": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY o_totalprice > 300000 OR (max(o_totalprice) OVER (PARTITION BY o_custkey) <= 300000 AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1)",
    "oim_round_trip": f"""{_WITH} SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY seq) AS seq, concept, unit_id, period_type, start_date, end_date, CAST(CAST(numeric_value AS DECIMAL(38,2)) AS DOUBLE) AS numeric_value, decimals, dims_key FROM facts""",
    "compiled_round_trip": f"{_WITH} SELECT report_id, seq, concept, period_id, unit_id, dims_key, numeric_value, decimals FROM facts",
    "compiled_counts": f"""{_WITH} SELECT CASE WHEN is_domain_member THEN 'member' WHEN is_dimension_item THEN 'dimension' WHEN is_abstract THEN 'heading' ELSE 'concept' END AS kind, count(*) AS n FROM concepts GROUP BY 1 UNION ALL SELECT 'network', count(*) FROM networks UNION ALL SELECT 'relationship', count(*) FROM arcs
      UNION ALL SELECT 'unit', count(DISTINCT unit_id) FROM facts UNION ALL SELECT 'period', count(DISTINCT period_id) FROM facts UNION ALL SELECT 'fact', count(*) FROM facts""",
    "unmentioned_concepts": f"{_WITH} SELECT qname FROM concepts WHERE qname NOT IN (SELECT from_qname FROM arcs WHERE network_seq > 5) AND qname NOT IN (SELECT to_qname FROM arcs WHERE network_seq > 5) AND qname NOT IN (SELECT concept FROM facts WHERE concept <> 'tb:Quantity')",
    "named_graphs": f"""WITH {_O}, t AS (SELECT *, ['Fact', 'Duration', 'Report', 'Unit', 'Element', 'none'][k % 6 + 1] AS kind FROM o), g AS (SELECT *, CASE WHEN kind IN ('Fact', 'Duration', 'Unit') THEN 'scene' WHEN kind = 'Report' THEN 'boundary' ELSE 'projection' END AS g FROM t)
      SELECT 'x' || k AS s, 'v' AS p, day AS o, g FROM g UNION ALL SELECT 'x' || k, 'rdf:type', kind, g FROM g WHERE kind <> 'none'""",
    "natural_order": r"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(replace(p_brand, '#', ' ') || '-' || p_size || '-' || p_partkey, '(\d+|\D+)'), lambda x: CASE WHEN regexp_full_match(x, '\d+') THEN lpad(x, 20, '0') ELSE x END), '') AS key FROM part""",
    "element_grid": f"""{_WITH} SELECT concept, CAST(end_date AS VARCHAR) AS "end", unit_id AS measure, CAST(CAST(numeric_value AS DECIMAL(38,2)) AS DOUBLE) AS value FROM facts WHERE dims_key = '' AND concept IN ('tb:NetRevenue', 'tb:Quantity') AND CAST(end_date AS VARCHAR) IN ('1997-12-31', '1998-12-31', '1998-03-31')
      AND {_KIND.format(s='start_date', e='end_date')} = 'annual' QUALIFY row_number() OVER (PARTITION BY concept, end_date ORDER BY unit_id, CAST(numeric_value AS DECIMAL(38,2))) = 1""",
    "preferred_rows": f"""WITH {_O}, first AS (SELECT c AS key, max(day) AS name FROM o WHERE c % 3 <> 1 GROUP BY 1) SELECT * FROM first UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT key FROM first)""",
    "inline_fragments": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_type WHEN p_partkey % 2 = 0 THEN 'http://f/' || p_partkey ELSE p_name END AS value_str FROM part",
    "sgml_headers": f"WITH {_O} SELECT k AS id, 'ACCESSION NUMBER' AS key, CAST(k AS VARCHAR) AS value FROM o UNION ALL SELECT k, 'FORM', p FROM o UNION ALL SELECT k, 'PERIOD', day FROM o",
    "sgml_documents": "SELECT doc_id AS id, 1 AS place, '10-K' AS type, 'a.htm' AS filename, CAST(length(trim(regexp_replace(text, '[<>]', ' ', 'g'), chr(10))) AS INT) AS chars FROM documents WHERE text IS NOT NULL",
    "html_tables_md": "SELECT o_orderkey AS id, 1 AS place, '| Name | Amount |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderpriority || ' | $' || o_orderkey || ' |' AS markdown FROM orders",
    "xml_records": "SELECT CAST(n_regionkey AS BIGINT) AS id, CAST(n_regionkey AS VARCHAR) AS region, 'nations' AS list, 'name' AS columns, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name || '<') - 1 AS INT) AS place, n_name AS name FROM nation",
}
