"""The registered queries of this subpackage and their DuckDB SQL: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, language_id, licenses, mixing, near_dedup, packing, quality, secrets, warc
from ._common import id_hash_mod, staged, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"))).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


#: Target weights of the sources in the mixture; the other sources share the rest.
WEIGHTS, OTHER_WEIGHT = {"src0": 4, "src1": 3, "src2": 2, "src3": 2, "src4": 1}, 8


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), WEIGHTS, OTHER_WEIGHT)
    return mixed.select("doc_id", "source", "mix_group", "mix_block", "mix_slot", "mix_offset")


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    share = id_hash_mod("doc_id", 3)
    labels = table(spark, sf_dir, "labels").filter("quality IN (0, 1)").select("doc_id", F.col("quality").alias("label"))
    # One plan at every size: labels grow with the documents, so both sides are shuffled and merged, never broadcast.
    train = staged(docs.filter(share != 1).join(labels.filter(share != 1).hint("merge"), "doc_id"), "quality-train")
    scored = quality.classify(docs, quality.fit(train), keep_text=False)
    return scored.select("doc_id", F.coalesce(share == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["license"], s["start"], s["end"], s["missing"])), ",")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["license"]))), ",")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_licenses"), names.alias("licenses"), spans.alias("spans"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return found.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), "refers_to")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    share = id_hash_mod("doc_id", 4)
    model = language_id.fit(docs.filter(share != 2))
    found = language_id.identify(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", F.coalesce(share == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_secret_scan, op3_source_mixing, op4_token_packing, op5_quality_classifier,
        op6_license_scan, op7_warc_round_trip, op8_minhash_near_dedup, op9_nearest_neighbours, op10_language_id,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_BASE32 = "CAST('0x' || substr(d, CAST({i} AS INT) * 5 + 1, 5) AS INT)"
#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op1_decontamination": f"""WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark), win AS (SELECT item_id, k, w[i : i + k - 1] AS g FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
      docs AS (SELECT doc_id, {_WORDS} AS w FROM documents), at AS (SELECT doc_id, k, i, w[i : i + k - 1] AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
      hit AS (SELECT doc_id, i, k, item_id FROM "at" JOIN win USING (k, g)), n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
      found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY 1)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN n USING (doc_id) LEFT JOIN found USING (doc_id)""".replace(" at AS (SELECT", ' "at" AS (SELECT'),
    "op7_warc_round_trip": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
      SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((({_BASE32.format(i="i // 4")}) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), 'string_agg', '') AS payload_digest,
      CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM p JOIN f USING (h)""",
    "op8_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPACED} AS w FROM documents), s AS (SELECT DISTINCT doc_id, w[i : i + 3] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
      link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)), duo AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
      reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, duo.y FROM reach JOIN duo ON duo.x = reach.r)
      SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
}
