"""Approximate nearest neighbours along shifted space-filling curves.

Equal vectors are one point. Every point is projected by several random orthonormal maps to a few dimensions, shifted,
cut to a grid and ordered along a Hilbert curve; Spark sorts each curve by range partitioning, which gives each point
its rank. A query looks at the ranks within `window` of its own on every curve: curves are cut into blocks of a fixed
number of ranks, a query visits the blocks that its window touches, and each block yields the nearest of its points. The
blocks' answers merge, and distances are taken in double precision on the original vectors.

Recall. The window is measured, not set: for PROBES queries (those of smallest hash) the true neighbours are found by a scan, and the
window is the least number of ranks within which `recall` of them lie on some curve. Data with structure get a small window. Vectors without any (as the
synthetic ones, almost isotropic in 64 dimensions) leave no other way than a large one: there the recall of a fixed window falls as the table
grows, for this and any other index that visits few points. The rule is the same at every size.

Defined cases. Vectors null, empty, zero, of another length than most, or holding null or non-finite components take no part; nor do null vec_ids. Equal
distances: smaller vec_id first. Fewer than k other points: all of them. Repeated vec_ids are one (their vectors each count).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import staged

CURVES, DIMS, BITS, BLOCK = 8, 8, 7, 4096
#: Queries whose recall is measured against a scan, and the share of their true neighbours that the window must reach.
PROBES, RECALL = 256, 0.95
_SEED = 23


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of grid cells (rows of `dims` integers below 2**bits), by Skilling's transposed form."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, bit = np.zeros(x.shape[1], dtype=np.int64), 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND exists(v, x -> x <> 0) AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    )
    most = kept.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).select("dim")
    return kept.join(F.broadcast(most), F.size("v") == F.col("dim"), "left_semi")  # one row


def _on_curves(points: DataFrame, dim: int, scale: float, curves: int, dims: int, bits: int) -> DataFrame:
    """(curve, key, point, raw) of points(point, v): raw is the vector as little-endian doubles."""
    rng = np.random.Generator(np.random.PCG64(_SEED))
    dims = min(dims, dim)
    maps = [(np.linalg.qr(rng.standard_normal((dim, dims)))[0], rng.random(dims)) for _ in range(curves)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                x = np.stack(part["v"].to_list())
                raw = [row.tobytes() for row in x]
                for c, (project, shift) in enumerate(maps):
                    # The cube of 8 deviations fills half the grid's width; the shift moves it within the whole.
                    cell = np.clip((x @ project / (8 * scale) + 0.5 + shift) / 2, 0, 1 - 1e-12)
                    yield pd.DataFrame({"curve": np.full(len(x), c, dtype=np.int32), "key": hilbert_keys((cell * (1 << bits)).astype(np.int64), bits), "point": part["point"].to_numpy(), "raw": raw})

    return points.select("point", "v").mapInPandas(run, "curve int, key long, point long, raw binary")


def true_neighbours(points: DataFrame, probes: list, k: int) -> DataFrame:
    """(probe, point, score) of the k nearest other points of each probe (rows with point and v), by a scan of points(point, v)."""
    names = np.array([p["point"] for p in probes], dtype=np.int64)
    asked = np.array([p["v"] for p in probes], dtype=np.float64)
    shared = points.sparkSession.sparkContext.broadcast((names, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        held_d, held_p = np.empty((len(q), 0)), np.empty((len(q), 0), dtype=np.int64)
        for batch in batches:
            column = batch.column("v")
            x, here = column.flatten().to_numpy().reshape(len(column), -1), batch.column("point").to_numpy()
            for at in range(0, len(x), 4096):
                part, ids = x[at : at + 4096], here[at : at + 4096]
                d = np.maximum((part * part).sum(axis=1)[None, :] - 2 * q @ part.T + (q * q).sum(axis=1)[:, None], 0)
                d[names[:, None] == ids[None, :]] = np.inf
                held_d, held_p = np.hstack([held_d, d]), np.hstack([held_p, np.broadcast_to(ids, d.shape)])
                if held_d.shape[1] > k:
                    best = np.argpartition(held_d, k, axis=1)[:, :k]
                    held_d, held_p = np.take_along_axis(held_d, best, 1), np.take_along_axis(held_p, best, 1)
        row, col = np.nonzero(np.isfinite(held_d))
        yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(held_p[row, col]), pa.array(held_d[row, col])], names=["probe", "point", "score"])

    found = points.select("point", "v").mapInArrow(run, "probe long, point long, score double")
    return found.withColumn("n", F.row_number().over(W.partitionBy("probe").orderBy("score", "point"))).filter(F.col("n") <= k).select("probe", "point", "score")


def measured_window(ranked: DataFrame, points: DataFrame, asked: DataFrame, k: int, recall: float, probes: int) -> int:
    """The least window of ranks that reaches `recall` of the true neighbours of at most `probes` of the queries asked(point)."""
    chosen = asked.select("point").distinct().orderBy(F.xxhash64("point"), "point").limit(probes)
    rows = points.join(chosen, "point").select("point", "v").collect()  # bounded by probes
    if not rows:
        return 1
    true = true_neighbours(points, rows, k)
    place = ranked.select("point", "curve", "rank")
    pairs = staged(true, "ann-true").join(place.withColumnsRenamed({"point": "probe", "rank": "own"}), "probe").join(place, ["point", "curve"])
    least = pairs.groupBy("probe", "point").agg(F.min(F.abs(F.col("rank") - F.col("own"))).alias("far"))
    far = sorted(r["far"] for r in least.select("far").collect())  # at most probes x k rows
    return max(1, far[min(len(far) - 1, int(np.ceil(recall * len(far))) - 1)]) if far else 1


def search(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, recall: float = RECALL, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of vectors(vec_id, embedding): Euclidean distances to the k nearest found."""
    rows = staged(usable(vectors).distinct(), "ann-vectors")
    # Of equal vectors the k + 1 smallest ids are enough; the limit by rank works before the shuffle too.
    ids = rows.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    points = staged(ids.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("point", F.element_at("ids", 1)), "ann-points")
    n, mass, dim = points.agg(F.count(F.lit(1)), F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    parts = max(curves, -(-n * curves // 50_000))
    keyed = _on_curves(points, dim, float(np.sqrt(mass / dim)), curves, dims, bits)
    ordered = keyed.repartitionByRange(parts, "curve", "key", "point").sortWithinPartitions("curve", "key", "point")
    # The id that increases along each sorted partition is (partition << 33) + place: with the partitions' sizes it gives the global rank.
    placed = staged(ordered.withColumn("place", F.monotonically_increasing_id()), "ann-curves")
    part, inner = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))  # one row per partition
    starts = sizes.select("part", F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + inner - F.col("curve").cast("long") * n)
    # Query rows meet the blocks that their windows touch. Blocks hold `block` points; the queries of a block are dealt to salts of bounded size.
    asked = staged(rows.filter(is_query).withColumnRenamed("vec_id", "query_id").join(points.select("v", "point"), "v").select("query_id", "point"), "ann-queries")
    window = measured_window(ranked, points, asked, k, recall, probes)
    touching = F.sequence(F.greatest(F.floor((F.col("rank") - window) / block), F.lit(0)), F.least(F.floor((F.col("rank") + window) / block), F.lit((n - 1) // block)))
    many = asked.count()
    salts = max(1, -(-int(many * min(1.0, (2 * window + block) / n)) // 20_000))
    queries = ranked.join(asked, "point").select("curve", "query_id", "rank", "raw", F.explode(touching).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(salts)).alias("salt"))
    again = ranked.toDF(*ranked.columns)  # columns of its own, for the cogroup
    targets = again.select("curve", F.floor(F.col("rank") / block).alias("block"), "rank", "point", "raw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))

    def nearest(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "point": [], "score": []}
        if len(asking) and len(there):
            x, x_rank, names = np.stack([np.frombuffer(r) for r in there["raw"]]), there["rank"].to_numpy(), there["point"].to_numpy()
            norms = np.einsum("ij,ij->i", x, x)
            for at in range(0, len(asking), 256):
                part = asking.iloc[at : at + 256]
                q = np.stack([np.frombuffer(r) for r in part["raw"]])
                near = norms[None, :] - 2 * q @ x.T + np.einsum("ij,ij->i", q, q)[:, None]
                near[np.abs(x_rank[None, :] - part["rank"].to_numpy()[:, None]) > window] = np.inf
                slack = 1e-9 * (norms.max() + 1)
                for i, who in enumerate(part["query_id"]):
                    row = near[i]
                    limit = np.partition(row, k)[k] if len(row) > k + 1 else np.inf
                    c = np.flatnonzero((row <= limit + slack) & np.isfinite(row))
                    d = np.sqrt(((x[c] - q[i]) ** 2).sum(axis=1))
                    best = np.lexsort((names[c], d))[: k + 1]  # the query's own point may be one
                    out["query_id"] += [who] * len(best)
                    out["point"] += names[c][best].tolist()
                    out["score"] += d[best].tolist()
        return pd.DataFrame(out)

    keys = ["curve", "block", "salt"]
    found = queries.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInPandas(nearest, "query_id long, point long, score double")
    merged = found.groupBy("query_id", "point").agg(F.min("score").alias("score"))
    members = merged.join(points.select("point", F.col("ids")), "point").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    single = members.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return single.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
