"""MinHash near-dedup by SetSketch registers.

Every text becomes its set of word shingles. The set's sketch holds, for each of many hash functions, the minimum
over the shingles, rescaled to an exponential variable and truncated to an exponentially spaced integer grid: registers
that merge by maximum and agree, register by register, about as often as the sets' Jaccard similarity. Bands of registers find
candidate pairs, a joint likelihood over register order (greater, less, equal) discards the hopeless ones, and
the full shingle sets confirm the rest exactly.

Scale. Equal sets are one class from the start, named by a row number of one of its rows. A bucket is led by its class of most
company, and comparisons go in rounds: each class with the best of its leaders alone; then with those other leaders that
still lie in another component; then, where members of one bucket still lie in different components, those pairs that an exact
prefix filter over their differences from a common reference leaves. Every candidate pair is so compared, excluded by a bound or already joined, at about one
comparison a class, without pairs inside a component. Components come from a distributed minimum-label iteration; nothing
of the documents reaches the driver. With `rows`=5 and `bands`=45 a pair at similarity 0.8 escapes all bands
with probability (1 - 0.8**5)**45 < 2e-8.

Defined cases. Null or wordless text: empty set, linked with nothing, its own component. Null doc_id: counted and returned,
never linked, component_id null and kept true (it cannot be named as another's copy). Rows that share a doc_id are one vertex: links
of any of them hold for all; drop_copies goes by rows instead. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import discard, fresh, mix64, shingle_hashes, staged, word_hashes

#: White space that parts words: the space and U+0009 to U+000D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

ROWS, BANDS = 5, 45
#: Base of the grid and rate of the exponential variables (SetSketch's b and a); registers lie in 0..LIMIT.
BASE, RATE, LIMIT = 1.02, 20.0, 65534
#: A candidate is dropped only if similarity at the threshold is e**-30 times as likely as the best one.
LOG_LIKELIHOOD_SLACK = 30.0


def shingles_of(text: str | None, width: int) -> np.ndarray:
    return shingle_hashes(word_hashes((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), SPACES), width)


def _seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(8191))
    return rng.integers(0, 2**64 - 1, size=(m, 1), dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64 - 1, size=(m, 1), dtype=np.uint64)


def registers(shingles: np.ndarray, m: int, seeds: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """SetSketch registers (uint16) of a set of 64-bit hashes; all zero for the empty set."""
    if not len(shingles):
        return np.zeros(m, dtype=np.uint16)
    times, plus = seeds or _seeds(m)
    low = np.full(m, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[None, at : at + 1024] * times
        part += plus
        np.minimum(low, part.min(axis=1), out=low)
    u = (low.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def set_key(shingles: np.ndarray) -> bytes:
    """128-bit digest of a set of 64-bit hashes."""
    one = mix64(shingles + np.uint64(1)).sum(dtype=np.uint64)
    two = mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(one).to_bytes(8, "little") + int(two).to_bytes(8, "little")


def likely_similar(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Joint maximum-likelihood estimate of the Jaccard similarity of row pairs of registers, and whether `threshold` or more is credible.

    With cardinality shares u = n_a/(n_a+n_b) and v = 1-u, a register of a exceeds that of b with probability
    p(u - v*J), p(x) = -log_b(1 - x*(b-1)/b), and conversely p(v - u*J); they are equal otherwise.
    """
    m = a.shape[1]
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = m - more - less
    u = n_a / np.maximum(n_a + n_b, 1)
    v = 1 - u
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1 - 1e-9)
    grid = np.linspace(0, 1, 101)[:, None]
    top = np.minimum(n_a, n_b) / np.maximum(np.maximum(n_a, n_b), 1)
    j = np.minimum(grid, top[None, :])
    above, below = p(u - v * j), p(v - u * j)
    score = more * np.log(above) + less * np.log(below) + same * np.log(np.clip(1 - above - below, 1e-9, 1))
    best = score.argmax(axis=0)
    reach = np.where(j >= np.minimum(threshold, top)[None, :] - 1e-9, score, -np.inf).max(axis=0)
    estimate = j[best, np.arange(len(best))]
    return estimate, (top >= threshold - 1e-9) & (reach >= score.max(axis=0) - LOG_LIKELIHOOD_SLACK)


def sketches(docs: DataFrame, width: int = 5, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(row, doc_id, n_shingles, set_key, registers) of docs(row, doc_id, text): set_key is a 128-bit digest of the whole set, registers little-endian uint16."""
    m = rows * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(m)
        for batch in batches:
            sizes, keys, regs = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles_of(text, width)
                sizes.append(len(s))
                keys.append(set_key(s))
                regs.append(registers(s, m, seeds).tobytes())
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_shingles", "set_key", "registers"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_shingles long, set_key binary, registers binary")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(set_id, shingles) of texts(set_id, text): sorted distinct hashes as little-endian uint64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(t, width).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(sets, pa.binary())], names=["set_id", "shingles"])

    return texts.mapInArrow(run, "set_id long, shingles binary")


def _is_likely(threshold: float):
    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        out = []
        for at in range(0, len(a), 512):
            cut = slice(at, at + 512)
            x, y = (np.frombuffer(b"".join(s.iloc[cut]), dtype=np.uint16).reshape(len(s.iloc[cut]), -1) for s in (a, b))
            out.append(likely_similar(x, y, n_a.iloc[cut].to_numpy(dtype=float), n_b.iloc[cut].to_numpy(dtype=float), threshold)[1])
        return pd.Series(np.concatenate(out))

    return likely


def _is_linked(percent: int):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return pd.Series(out, dtype=bool)

    return linked


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b of set_id) whose registers leave the similarity credible."""
    regs = classes.select("set_id", "n_shingles", "registers")
    likely = (
        pairs.join(regs.select(F.col("set_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("r_a")), "a")
        .join(regs.select(F.col("set_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("r_b")), "b")
        .filter(_is_likely(percent / 100)("r_a", "r_b", "n_a", "n_b"))
        .select("a", "b")
    )
    return likely


def _confirmed(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough; one row per pair."""
    return (
        likely.join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("s_b")), "b")
        .join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("s_a")), "a")
        .filter(_is_linked(percent)("s_a", "s_b"))
        .select("a", "b")
        .distinct()
    )


def _differences(members: DataFrame) -> DataFrame:
    """(family, set_id, component, n_shingles, size, element): what is in just one of a member's set and its family's reference, of members(..., shingles, reference)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("family", "set_id", "component", "n_shingles")
        for batch in batches:
            sets = ([np.frombuffer(x, dtype=np.int64) for x in batch.column(c).to_pylist()] for c in ("shingles", "reference"))
            apart = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(*sets, strict=True)]
            ends = np.cumsum([0, *map(len, apart)])
            each = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([*apart, np.empty(0, np.int64)]))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(np.diff(ends), pa.int64()), each], names=[*names, "size", "each"])

    found = members.mapInArrow(run, "family long, set_id long, component long, n_shingles long, size long, each array<long>")
    return found.select("family", "set_id", "component", "n_shingles", "size", F.explode("each").alias("element"))


def _late_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of different components and one family that may be linked, of rest(set_id, n_shingles, component, lead, weight, c_lead).

    Buckets with common components make a family; its reference is its lead of most company. With D(x) for what x and the reference do not share, two sets differ by
    |D(x)| + |D(y)| - 2 |D(x) and D(y)| shingles, and are linked if that is at most (100 - p) / (100 + p) of |x| + |y|. So linked sets have common elements in D, and
    the first of them, rarest first, lies among the first (100 - p) / p * |x| + 1 of each; its places bound how many follow. (Where no common element is needed both are
    linked with the reference, which leads every mixed bucket that it is in.) Copies that were changed in different places share no rare element and never meet.
    """
    joined = components(rest.select(F.col("c_lead").alias("a"), F.col("component").alias("b")).filter("a <> b").distinct())
    own = rest.join(joined.select(F.col("node").alias("c_lead"), F.col("component").alias("family")), "c_lead", "left").withColumn("family", F.coalesce("family", "c_lead"))
    own = staged(own, "near-families")
    families = own.groupBy("family").agg(F.max(F.struct("weight", "lead"))["lead"].alias("ref"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("family", "ref")
    members = own.select("family", "set_id", "component", "n_shingles").distinct().join(families, "family").join(sets, "set_id")
    members = members.join(sets.select(F.col("set_id").alias("ref"), F.col("shingles").alias("reference")), "ref")
    each = staged(_differences(members), "near-differences")
    often = each.groupBy("family", "element").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    place = F.row_number().over(W.partitionBy("family", "set_id").orderBy(F.coalesce("n", F.lit(1)), "element"))  # the elements of one set
    placed = each.join(often, ["family", "element"], "left").withColumn("place", place)
    prefix = F.floor(F.lit(100 - percent) * F.col("n_shingles") / F.lit(percent)) + 1
    found = staged(placed.filter((F.col("place") <= prefix) & F.col("n").isNotNull()).drop("n"), "near-prefixes")
    discard(own, each, joined)
    a, b = found.alias("a"), found.alias("b")
    common = 1 + F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
    near = (100 + percent) * (F.col("a.size") + F.col("b.size") - 2 * common) <= (100 - percent) * (F.col("a.n_shingles") + F.col("b.n_shingles"))
    on = (F.col("a.family") == F.col("b.family")) & (F.col("a.element") == F.col("b.element")) & (F.col("a.set_id") < F.col("b.set_id")) & (F.col("a.component") != F.col("b.component")) & near
    return a.join(b, on).select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node reachable.

    Minimum-label propagation with pointer jumping. Each round every node takes the smallest label among its neighbours and itself,
    then that label's own label; the rounds end when no label changes, after about the logarithm of the longest path.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "cc-edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component"), F.lit(True).alias("changed")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = lower.join(labels.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left")
        least = F.least("component", F.coalesce("further", "component"))
        now = staged(jump.select("node", least.alias("component"), (least != F.col("was")).alias("changed")), "cc-labels")
        discard(labels)
        labels = now
        if labels.filter("changed").isEmpty():
            discard(both)
            return labels


def _class_links(classes: DataFrame, texts: DataFrame, width: int, percent: int, rows: int, bands: int) -> DataFrame:
    """(a, b): links between classes(set_id, n_shingles, registers) that join all that is linked; texts(row, text) holds the text of each set_id as row."""
    width_bytes = 2 * rows
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 1 + i * width_bytes, width_bytes)) for i in range(bands)])
    in_bands = classes.select("set_id", "n_shingles", F.explode(keys).alias("bucket"))
    sizes = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sized = staged(in_bands.join(sizes, "bucket"), "near-buckets")
    # The class that shares most leads its buckets: the middle of a group of near copies leads nearly all of them, so that a copy has few leaders.
    company = sized.groupBy("set_id").agg(F.sum("size").alias("company"))
    known = sized.join(company, "set_id")
    leads = known.groupBy("bucket").agg(F.max(F.struct("company", F.col("set_id").alias("lead"))).alias("by"))
    shared = staged(known.join(leads, "bucket").select("bucket", "set_id", "n_shingles", F.col("by.lead").alias("lead"), F.col("by.company").alias("weight")), "near-led-buckets")
    discard(sized)
    # The whole sets of all classes that share a bucket, each once.
    wanted = shared.select("set_id").distinct()
    sets = staged(_sets(texts.join(wanted, texts["row"] == wanted["set_id"]).select("set_id", "text"), width), "near-sets")

    # First round: each class and the best of its leaders.
    best = shared.filter("set_id <> lead").groupBy("set_id").agg(F.max_by("lead", F.struct("weight", "lead")).alias("a"))
    first_pairs = staged(best.select("a", F.col("set_id").alias("b")), "near-first-pairs")
    links = staged(_confirmed(_likely(first_pairs, classes, percent), sets, percent), "near-first-links")
    found = components(links)
    # Second round: the other leaders, where they still lie in another component.
    of_set, of_lead = found.select(F.col("node").alias("set_id"), F.col("component").alias("c_set")), found.select(F.col("node").alias("lead"), F.col("component").alias("c_lead"))
    stars = shared.filter("set_id <> lead").select("set_id", "lead").distinct().join(of_set, "set_id", "left").join(of_lead, "lead", "left")
    apart = stars.filter(F.coalesce("c_set", "set_id") != F.coalesce("c_lead", "lead")).select(F.col("lead").alias("a"), F.col("set_id").alias("b"))
    more_pairs = staged(apart.join(first_pairs, ["a", "b"], "left_anti"), "near-second-pairs")
    links = staged(links.union(_confirmed(_likely(more_pairs, classes, percent), sets, percent)), "near-links")
    discard(first_pairs, more_pairs, found)

    # Last round: members of one bucket that still lie in different components.
    found = components(links)
    of_set, of_lead = found.select(F.col("node").alias("set_id"), F.col("component").alias("c_set")), found.select(F.col("node").alias("lead"), F.col("component").alias("c_lead"))
    labelled = shared.filter("set_id <> lead").join(of_set, "set_id", "left").withColumn("component", F.coalesce("c_set", "set_id")).drop("c_set")
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    rest = labelled.join(mixed, "bucket", "left_semi").join(of_lead, "lead", "left").withColumn("c_lead", F.coalesce("c_lead", "lead"))
    rest = staged(rest.drop("bucket").distinct(), "near-mixed")
    every = staged(links.union(_confirmed(_late_pairs(rest, sets, percent), sets, percent)), "near-all-links")
    discard(shared, sets, links, found, rest)
    return every


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest linked doc_id), kept (doc_id = component_id).

    docs needs doc_id and text. Links: percent <= 100 * |A and B| / |A or B| on sets of `width`-word shingles.
    """
    # Rows are numbered once and kept so: neither null nor repeated ids say which row a class is read from.
    texts = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "near-texts")
    found = _components_of(texts, width, percent, rows, bands)
    discard(texts)
    component = F.col("component_id")
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _components_of(texts: DataFrame, width: int, percent: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(row, doc_id, n_shingles, component_id) of a written table texts(row, doc_id, text) whose rows have different numbers."""
    sketched = staged(sketches(texts, width, rows, bands), "near-sketches")
    usable = sketched.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # One class per distinct set: set_id is the number of one of its rows, its member the smallest doc_id with that set.
    heads = staged(usable.groupBy("set_key").agg(F.min("row").alias("set_id"), F.min("doc_id").alias("member")), "near-classes")
    classes = staged(usable.join(heads.select(F.col("set_id").alias("row"), "member"), "row").select(F.col("row").alias("set_id"), "member", "n_shingles", "registers"), "near-class-sketches")
    links = _class_links(classes, texts, width, percent, rows, bands)
    # From classes to documents: each class is tied to its member, and members carry the smallest ids.
    of_class = classes.select("set_id", "member")
    named = links.join(of_class.select(F.col("set_id").alias("a"), F.col("member").alias("m_a")), "a").join(of_class.select(F.col("set_id").alias("b"), F.col("member").alias("m_b")), "b")
    # A repeated doc_id may stand in several classes: it ties their members together.
    single = usable.join(heads, "set_key").select("doc_id", "set_id", "member")
    repeated = single.groupBy("doc_id").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).filter("low <> high").select("doc_id")
    across = single.filter("doc_id <> member").join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("member").alias("b"))
    whole = components(named.select(F.col("m_a").alias("a"), F.col("m_b").alias("b")).union(across))
    discard(classes, links)
    out = (
        sketched.join(heads.select("set_key", "member"), "set_key", "left")
        .withColumn("member", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("member")))
        .join(whole.select(F.col("node").alias("member"), "component"), "member", "left")
    )
    return out.select("row", "doc_id", "n_shingles", F.coalesce("component", "member", "doc_id").alias("component_id"))


def drop_copies(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate group of docs, that of smallest key (nulls last); rows without words all stay. All columns as they were.

    Rows are told apart by numbers of their own: rows of one key with different texts are different documents, and copies under a null key go like others.
    """
    row = fresh("near_row", docs.columns)
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "near-numbered")
    # The row's number is its id here, so a component's rows are told apart; its best row by key stays.
    found = _components_of(numbered.select(F.col(row).alias("row"), F.col(row).alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")), width, percent)
    groups = found.filter("n_shingles > 0").select(F.col("row").alias("near_r"), F.col("component_id").alias("near_c"))
    keyed = groups.join(numbered.select(F.col(row).alias("near_r"), F.col(f"`{key}`").alias("near_k")), "near_r")
    ranked = staged(keyed.select("near_c", "near_r", F.struct(F.col("near_k").isNull().alias("last"), F.col("near_k").alias("k"), F.col("near_r").alias("r")).alias("near_s")), "near-groups")
    heads = ranked.groupBy("near_c").agg(F.min("near_s").alias("near_s")).select(F.col("near_s.r").alias("near_r"))
    gone = ranked.join(heads, "near_r", "left_anti").select(F.col("near_r").alias(row))
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
