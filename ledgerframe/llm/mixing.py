"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions alone.

Documents of a source are put in a fixed pseudo-random order and cut into blocks of about `block_chars` characters (a
document belongs to the block in which it begins). The j-th block of a source with share w may not be placed before slot
floor(j / w) and must be placed before slot ceil((j + 1) / w); at every slot the released block of earliest deadline goes
next. That keeps every source within less than one block of its target at every slot. Weights are integers, so the
schedule repeats after sum(weights) slots, a round; when sources run short, the rounds that follow are scheduled for what is left, in the
targets' proportions. A schedule is computed once for each kind of round (at most 2 * groups + 1 of them), never for each row.

Scale. Rows are ordered within (group, sub-bucket) by window, with sub-buckets in proportion to the row count, so a source with a third of all
rows is spread over as many tasks as others. Only the round schedules are broadcast: at most (2 * groups + 2) * sum(weights) rows, both bounded by arguments.

Defined cases. Null sources and sources without a weight form the group `*` with weight `other`. Null and empty
texts count as one character. Rows that repeat stay and follow one another; rows of null or equal ids go by their texts. Empty table: empty result. Columns
of docs named in INNER (all begin with `mix_`) are replaced; every row of docs is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Most slots of a round and most groups: what bounds the broadcast schedules.
MAX_ROUND, MAX_GROUPS = 4096, 256
BLOCK_CHARS, BUCKET_ROWS = 1 << 18, 8192
#: Columns that mix() makes on its way; columns of docs of these names are replaced.
INNER = {"mix_" + x for x in "group block slot offset g i size hash bucket sum from inner round of_g of_i low high length at".split()}


def round_schedule(demand: Column) -> Column:
    """array<struct<g, i, slot>>: earliest-deadline-first places of block i of group g in a round with demand[g] blocks of each group."""
    total = F.aggregate(demand, F.lit(0), lambda a, x: a + x)
    kind = "array<struct<g:int,i:int,slot:int>>"
    start = F.struct(F.transform(demand, lambda _: F.lit(0)).alias("done"), F.array().cast(kind).alias("out"))

    def step(acc: Column, t: Column) -> Column:
        groups = F.sequence(F.lit(0), F.size(demand) - 1)
        released = F.filter(groups, lambda g: (acc["done"][g] < demand[g]) & (F.floor(acc["done"][g] * total / demand[g]) <= t))
        due = F.array_min(F.transform(released, lambda g: F.struct(F.ceil((acc["done"][g] + 1) * total / demand[g]).alias("deadline"), g.alias("g"))))
        chosen = due["g"]
        placed = F.struct(chosen.alias("g"), acc["done"][chosen].alias("i"), t.alias("slot"))
        return F.struct(F.transform(acc["done"], lambda n, g: n + F.when(g == chosen, 1).otherwise(0)).alias("done"), F.concat(acc["out"], F.array(placed)).cast(kind).alias("out"))

    slots = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(slots, start, step, lambda acc: acc["out"])


def plan(blocks: DataFrame, weights: list[int]) -> DataFrame:
    """(mix_g, mix_i, mix_low, mix_high, mix_length, mix_at): block i of a round of numbers low..high-1 of group mix_g has place `at` in round `low`; `length` slots make
    a round. blocks has one row at most per group: (mix_g, n blocks)."""
    k = F.array(*[F.lit(w) for w in weights])
    all_groups = F.array(*[F.lit(0).cast("long") for _ in weights])
    n = blocks.agg(F.map_from_entries(F.collect_list(F.struct("mix_g", "n"))).alias("m")).select(F.transform(all_groups, lambda _, g: F.coalesce(F.col("m")[g], F.lit(0).cast("long"))).alias("n"))
    # Rounds change kind where a group has its last full round and where it has none left.
    full = F.transform("n", lambda x, g: F.floor(x / k[g]))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), full, F.transform(full, lambda r: r + 1))))
    kinds = n.select("n", cuts.alias("cuts")).select("n", "cuts", F.posexplode("cuts").alias("at", "low"))
    kinds = kinds.withColumn("high", F.get("cuts", F.col("at") + 1)).filter("high IS NOT NULL")
    demand = F.transform("n", lambda x, g: F.greatest(F.lit(0), F.least(k[g].cast("long"), x - F.col("low") * k[g])).cast("int"))
    kinds = kinds.select("low", "high", demand.alias("demand")).withColumn("length", F.aggregate("demand", F.lit(0), lambda a, x: a + x)).filter("length > 0")
    before = F.coalesce(F.sum((F.col("high") - F.col("low")) * F.col("length")).over(W.orderBy("low").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = kinds.withColumn("before", before).select("low", "high", "length", "before", F.explode(round_schedule(F.col("demand"))).alias("p"))
    return placed.select(F.col("p.g").alias("mix_g"), F.col("p.i").alias("mix_i"), *[F.col(x).alias(f"mix_{x}") for x in ("low", "high", "length")], (F.col("before") + F.col("p.slot")).alias("mix_at"))


def mix(docs: DataFrame, weights: dict[str, int], other: int = 1, source: str = "source", text: str = "text", key: str = "doc_id", block_chars: int = BLOCK_CHARS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with mix_group, mix_block (number in the group), mix_slot (place of the block) and mix_offset (place in the block).

    Rows in the order (mix_slot, mix_offset, key) are the mixture.
    """
    names, shares = [*weights, "*"], [*weights.values(), other]
    if min(shares) < 1 or len(names) > MAX_GROUPS or sum(shares) > MAX_ROUND:
        raise ValueError(f"weights must be positive integers, of at most {MAX_GROUPS} groups and sum {MAX_ROUND}")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in INNER])
    buckets = max(1, -(-docs.count() // bucket_rows))
    of = F.create_map(*[F.lit(x) for i, n in enumerate(weights) for x in (n, i)]) if weights else F.create_map(F.lit("*"), F.lit(0))
    # The text is part of the order, so that rows without an id, or with one id, do not share a place or a bucket.
    order = F.xxhash64(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`").cast("string"))
    base = docs.withColumns({
        "mix_g": F.coalesce(of[F.col(f"`{source}`")], F.lit(len(weights))), "mix_size": F.greatest(F.coalesce(F.length(F.col(f"`{text}`").cast("string")), F.lit(0)), F.lit(1)).cast("long"),
        "mix_hash": order, "mix_bucket": F.pmod(F.xxhash64(F.lit(7), order), F.lit(buckets)),
    })
    # Prefix sums in two levels: over the sub-buckets of a group, then inside each.
    sums = base.groupBy("mix_g", "mix_bucket").agg(F.sum("mix_size").alias("mix_sum"))
    over_buckets = W.partitionBy("mix_g").orderBy("mix_bucket")
    starts = sums.withColumn("mix_from", F.coalesce(F.sum("mix_sum").over(over_buckets.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy("mix_g", "mix_bucket").orderBy("mix_hash", F.col(f"`{key}`"), "mix_size").rowsBetween(W.unboundedPreceding, -1)
    at = base.withColumn("mix_inner", F.coalesce(F.sum("mix_size").over(inside), F.lit(0)))
    at = at.join(starts.select("mix_g", "mix_bucket", "mix_from"), ["mix_g", "mix_bucket"])
    begin = F.col("mix_from") + F.col("mix_inner")
    at = at.withColumns({"mix_block": F.floor(begin / block_chars), "mix_offset": F.pmod(begin, F.lit(block_chars))})
    # As many blocks as a group's characters fill; a long document leaves the blocks that it runs through empty, so that its mass counts.
    n_blocks = sums.groupBy("mix_g").agg(F.sum("mix_sum").alias("mix_sum")).select("mix_g", F.ceil(F.col("mix_sum") / block_chars).alias("n"))
    schedule = F.broadcast(plan(n_blocks, shares).withColumnsRenamed({"mix_g": "mix_of_g", "mix_i": "mix_of_i"}))
    k = F.array(*[F.lit(x) for x in shares])[F.col("mix_g")]
    at = at.withColumns({"mix_round": F.floor(F.col("mix_block") / k), "mix_i": F.col("mix_block") % k})
    placed = at.join(schedule, (F.col("mix_g") == F.col("mix_of_g")) & (F.col("mix_i") == F.col("mix_of_i")) & (F.col("mix_round") >= F.col("mix_low")) & (F.col("mix_round") < F.col("mix_high")))
    slot = F.col("mix_at") + (F.col("mix_round") - F.col("mix_low")) * F.col("mix_length")
    group = F.array(*[F.lit(x) for x in names])[F.col("mix_g")]
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], group.alias("mix_group"), "mix_block", slot.alias("mix_slot"), "mix_offset")


def in_order(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mixture in its order, without the columns that mix() added."""
    return mixed.orderBy("mix_slot", "mix_offset", key).drop("mix_group", "mix_block", "mix_slot", "mix_offset")
