"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every training token window.

All of it is DataFrame expressions. Texts are lower-cased (A-Z) and cut into words; a benchmark item of at least `width` words gives its
windows of `width` words, a shorter one itself as one window. Per document row the hashes of its windows (of every
length that the benchmark has) are one array; exploded, they probe the hash set, and each hit is verified by its very
words before it counts. Only verified hits are shuffled, never texts.

Scale. The windows are counted and weighed first, and a hash set of at most `broadcast_windows` of them and about `broadcast_bytes` is broadcast; a larger benchmark is
cut by hash into blocks of that size, one scan each. The items of each distinct set of windows are gathered once, however many documents share it. Hits are reduced per document row to merged intervals and distinct windows, which are bounded by the row's own
text. One row out per row in.

Defined cases. Null or wordless text: no words, no hits. A null or wordless item has no window. Items
that repeat a text each count; rows that repeat an item_id count once. A null item_id is left out of the item list, but its windows are hits. Null doc_id: scanned, returned with
null. Repeated rows: each is scanned and returned. Other columns of documents pass through untouched; inner columns take names that docs does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, staged

#: What parts words: every ASCII character but digits and lower-case letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH, BROADCAST_WINDOWS, BROADCAST_BYTES = 10, 2_000_000, 256 << 20


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    spaced = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS, " ")
    return F.array_remove(F.split(spaced, " "), "")


def _windows(words: Column, length: int) -> Column:
    """Starts (from 0) of the windows of length words."""
    n = F.size(words)
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _window_hashes(word_hashes: Column, length: int) -> Column:
    return F.transform(_windows(word_hashes, length), lambda i: F.xxhash64(F.slice(word_hashes, i + 1, F.lit(length))))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(hash, length, words, items): distinct windows with the distinct ids, as text, of the items that hold them."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text").cast("string")).alias("w")).filter("size(w) > 0")
    item = item.withColumn("length", F.least(F.size("w"), F.lit(width)))
    at = item.select("item", "length", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("i"))
    window = at.select("item", "length", F.slice("w", F.col("i"), F.col("length")).alias("words"))
    return window.groupBy("length", "words").agg(F.collect_set("item").alias("items")).select(F.xxhash64(F.transform("words", lambda w: F.xxhash64(w))).alias("hash"), "length", "words", "items")


def _probes(base: DataFrame, lengths: list[int]) -> DataFrame:
    """base(row, doc, words) exploded to (row, doc, words, n_words, at, length, hash): a row for every window, and first one with at = -1 for the row itself."""
    h = F.col("h")
    every = [_window_hashes(h, k) for k in lengths]
    mark = F.array(F.lit(None).cast("long"))
    hashed = base.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("hashes", F.concat(mark, *every))
    at = hashed.select("row", "doc", "words", F.size("words").alias("n"), F.posexplode_outer("hashes").alias("pos", "hash"))
    # (posexplode would evaluate the array's expressions once more, in a filter that the optimizer infers.) The position in the joint array tells length and start.
    before, length, start = F.lit(0), F.lit(0), F.lit(-1)
    for k in lengths:
        later = F.col("pos") > before
        length, start = F.when(later, F.lit(k)).otherwise(length), F.when(later, F.col("pos") - 1 - before).otherwise(start)
        before = before + F.greatest(F.col("n") - (k - 1), F.lit(0))
    return at.select("row", "doc", "words", F.col("n").cast("long").alias("n_words"), "pos", "hash", length.alias("length"), start.alias("at"))


def _hits_of(base: DataFrame, windows: DataFrame, lengths: list[int], marks: bool) -> DataFrame:
    """(row, doc, n_words, at, end, id) of verified hits; with marks also a row of at = -1 for each row of base."""
    known = F.broadcast(windows.select(F.col("hash").alias("known"), F.col("words").alias("known_words"), "id"))
    probes = _probes(base, lengths)
    is_mark = F.col("pos") == 0
    joined = probes.join(known, F.col("hash") == F.col("known"), "left" if marks else "inner")
    # Equal hashes count only with equal words.
    same = F.col("id").isNotNull() & ~is_mark & (F.slice("words", F.greatest("at", F.lit(0)) + 1, F.greatest("length", F.lit(1))) == F.col("known_words"))
    kept = joined.filter(is_mark | same) if marks else joined.filter(same)
    return kept.select("row", F.when(is_mark, F.col("doc")).alias("doc"), F.when(is_mark, F.col("n_words")).alias("n_words"), "at", (F.col("at") + F.col("length")).alias("end"), "id")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_windows: int = BROADCAST_WINDOWS, marks: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(hits, windows) of docs(key columns, text): see _hits_of; windows tells (id, items)."""
    windows = staged(benchmark_windows(benchmark, width).withColumn("id", F.xxhash64("length", "words")), "benchmark-windows")
    weight = F.aggregate("words", F.lit(64).cast("long"), lambda a, w: a + F.octet_length(w) + 24)
    sizes = {r["length"]: (r["n"], r["b"]) for r in windows.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("b")).collect()}  # at most `width` rows
    blocks = max(1, -(-sum(n for n, _ in sizes.values()) // broadcast_windows), -(-sum(b for _, b in sizes.values()) // broadcast_bytes))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), words_of(F.col("text").cast("string")).alias("words"))
    if blocks > 1:
        base = staged(base, "decontamination-words")
    parts = [_hits_of(base, windows.filter(F.pmod("hash", F.lit(blocks)) == i) if blocks > 1 else windows, sorted(sizes), marks and i == 0) for i in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out, windows.select("id", "items")


def _merged(spans: Column) -> Column:
    """Overlapping or touching spans merged, in order."""
    kind = "array<struct<start:int,end:int>>"
    last = lambda a: F.element_at(a["done"], -1)
    start = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))

    def step(acc: Column, x: Column) -> Column:
        apart = acc["b"].isNull() | (x["at"] > acc["b"])
        done = F.when(apart & acc["b"].isNotNull(), F.concat(acc["done"], F.array(F.struct(acc["a"].alias("start"), acc["b"].alias("end"))))).otherwise(acc["done"])
        return F.struct(done.cast(kind).alias("done"), F.when(apart, x["at"]).otherwise(acc["a"]).alias("a"), F.when(apart, x["end"]).otherwise(F.greatest(acc["b"], x["end"])).alias("b"))

    finish = lambda acc: F.when(acc["b"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["a"].alias("start"), acc["b"].alias("end")))).cast(kind))
    return F.aggregate(F.sort_array(spans), start, step, finish)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_hit (words inside hits), n_items, items (sorted ids as text), contaminated, spans (in words)."""
    found, windows = hits(docs.select("doc_id", "text"), benchmark, width, broadcast_windows)
    span = F.when(F.col("at") >= 0, F.struct("at", "end"))
    rows = found.groupBy("row").agg(F.max("doc").alias("doc"), F.max("n_words").alias("n_words"), F.collect_set(span).alias("raw"), F.collect_set("id").alias("ids"))
    rows = staged(rows.select("row", F.col("doc.doc_id").alias("doc_id"), "n_words", _merged(F.col("raw")).alias("spans"), "ids"), "decontamination-rows")
    # Items by distinct set of windows: a passage that stands in many documents is looked up once for all of them.
    rows = rows.withColumn("ids", F.array_sort("ids"))
    # Clean rows, which are most, take no part in the join; the items are written, so that Spark can split a set that many rows share.
    hit = rows.filter("size(ids) > 0")
    of_set = hit.select("ids").distinct().select("ids", F.explode("ids").alias("id")).join(windows, "id").select("ids", F.explode("items").alias("item")).groupBy("ids").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = hit.join(staged(of_set, "decontamination-items"), "ids", "left").unionByName(rows.filter("size(ids) = 0"), allowMissingColumns=True)
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"), "spans")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of docs that hold no benchmark window, with all columns as they were.

    Contamination depends on the text alone, so the digests of contaminated texts, each once, decide; Spark broadcasts them if they are few.
    """
    own = fresh("dirty", docs.columns)
    digest = F.unhex(F.sha2(F.col("text").cast("string"), 256))
    found, _ = hits(docs.select(F.col("text"), digest.alias("digest")), benchmark, width, broadcast_windows, marks=True)
    # The digest stands in the mark of its row only; a hit finds it by the row.
    dirty = found.groupBy("row").agg(F.max("doc").alias("doc"), F.max("id").alias("id")).filter("id IS NOT NULL").select(F.col("doc.digest").alias(own)).distinct()
    return docs.join(staged(dirty, "contaminated-texts"), digest == F.col(own), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, mask: str = " ") -> DataFrame:
    """Rows of docs(doc_id, text, ...) with the contaminated words, and what parts them, replaced by mask; clean rows untouched.

    A text is cut into an alternation of breaks and words (breaks first, perhaps empty), so that words keep their positions.
    """
    own, cut_at = fresh("own_row", docs.columns), fresh("spans", docs.columns)
    tagged = staged(docs.withColumn(own, F.monotonically_increasing_id()), "span-removal")
    found, _ = hits(tagged.select(F.col(own).alias("own"), "text"), benchmark, width)
    rows = found.groupBy("row").agg(F.max("doc").alias("doc"), F.collect_set(F.when(F.col("at") >= 0, F.struct("at", "end"))).alias("raw")).filter("size(raw) > 0")
    spans = rows.select(F.col("doc.own").alias(own), _merged(F.col("raw")).alias(cut_at))
    text = F.col("text").cast("string")
    words = F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    breaks = F.split(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    # One array of (break, word after it), made once per row: an expression within a lambda would be worked out for each word.
    pairs = F.arrays_zip(breaks.alias("gap"), words.alias("word"))
    span_of = lambda i: F.filter(cut_at, lambda s: (i >= s["start"]) & (i < s["end"]))
    inside = lambda i: F.size(span_of(i)) > 0
    opens = lambda i: F.exists(cut_at, lambda s: i == s["start"])
    piece = lambda x, i: F.when(opens(i), F.concat(x["gap"], F.lit(mask))).when(inside(i), F.lit("")).otherwise(F.concat(x["gap"], F.coalesce(x["word"], F.lit(""))))
    cut = F.array_join(F.transform(pairs, piece), "")
    out = tagged.join(spans, own, "left").withColumn("text", F.when(F.col(cut_at).isNull(), text).otherwise(cut))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
