"""Sections of a report: titles, statement kinds, hypercubes, membership of facts, families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .facts import report_keys

_TITLE = r"(?is)^\s*(\d+)\s*-\s*(Statement|Disclosure|Document|Schedule)\s*-\s*(.*?)\s*$"
_SUFFIX = r"(?i)\s*\((Details?|Tables?|Policies|Parentheticals?)\b[^)]*\)"
_NUMBER_ONLY = r"(?i)^(?:note\s*)?\d+[a-z]?\.?$"


def parse_title(definition: Column) -> Column:
    """struct<number, category, name> of a role's definition; without the usual shape the whole text is the name."""
    text = F.trim(F.coalesce(definition, F.lit("")))
    number = F.nullif(F.regexp_extract(text, _TITLE, 1), F.lit(""))
    shaped = number.isNotNull()
    return F.struct(number.alias("number"), F.when(shaped, F.initcap(F.regexp_extract(text, _TITLE, 2))).alias("category"), F.when(shaped, F.regexp_extract(text, _TITLE, 3)).otherwise(text).alias("name"))


def parse_level(category: Column, name: Column) -> Column:
    """struct<level, family, subtitle>: what a title says of its place in a disclosure."""
    word = F.lower(F.regexp_extract(name, _SUFFIX, 1))
    bare = F.trim(F.regexp_replace(name, _SUFFIX, ""))
    cat = F.lower(F.coalesce(category, F.lit("")))
    level = (
        F.when(word.startswith("detail"), "details").when(word.startswith("table"), "tables").when(word == "policies", "policies").when(word.startswith("parenthetical"), "parenthetical")
        .when(cat == "statement", "statement").when(cat == "disclosure", "note").when(cat == "document", "document").when(cat == "schedule", "details").otherwise("other")
    )
    head = F.trim(F.substring_index(bare, " - ", 1))
    parted = level.isin("details", "tables", "policies", "note", "parenthetical") & F.contains(bare, F.lit(" - ")) & ~head.rlike(_NUMBER_ONLY)
    family = F.when(parted, head).otherwise(bare)
    tail = F.nullif(F.trim(F.regexp_extract(bare, r"(?s)^.*? - (.*)$", 1)), F.lit(""))
    return F.struct(level.alias("level"), F.coalesce(F.nullif(family, F.lit("")), name).alias("family"), F.when(parted, tail).alias("subtitle"))


#: Words that name a kind of statement, in order of precedence.
STATEMENT_WORDS = (
    ("cash_flow_statement", ("cash flow",)),
    ("balance_sheet", ("balance sheet", "financial position")),
    ("equity_statement", ("stockholders' equity", "shareholders' equity", "changes in equity")),
    ("income_statement", ("comprehensive income", "operations", "income", "earnings")),
)
#: Local names of the root concepts of statements.
STATEMENT_ROOTS = {
    "StatementOfFinancialPositionAbstract": "balance_sheet",
    "BalanceSheetAbstract": "balance_sheet",
    "StatementOfCashFlowsAbstract": "cash_flow_statement",
    "StatementOfChangesInEquityAbstract": "equity_statement",
    "StatementOfStockholdersEquityAbstract": "equity_statement",
    "StatementOfPartnersCapitalAbstract": "equity_statement",
    "IncomeStatementAbstract": "income_statement",
    "StatementOfComprehensiveIncomeAbstract": "income_statement",
    "StatementOfIncomeAndComprehensiveIncomeAbstract": "income_statement",
}


def statement_kind(definition: Column, role_uri: Column, root: Column) -> Column:
    """Kind of statement by the title's words, else those of the role's last part, else by the root concept; a parenthetical is none."""
    plain = lambda c: F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("\u2019"), F.lit("'")))
    says = lambda text, words: F.greatest(F.lit(False), *[F.contains(text, F.lit(w)) for w in words])
    by_words = lambda text: F.coalesce(*[F.when(says(text, words), kind) for kind, words in STATEMENT_WORDS])
    title = plain(definition)
    last = F.coalesce(F.nullif(F.regexp_extract(role_uri, "[^/#]*$", 0), F.lit("")), role_uri)
    role = plain(F.regexp_replace(F.regexp_replace(last, "([a-z0-9])([A-Z])", "$1 $2"), "[-_.]+", " "))
    known = F.create_map(*[F.lit(x) for pair in STATEMENT_ROOTS.items() for x in pair])
    by_root = F.try_element_at(known, F.substring_index(F.coalesce(root, F.lit("")), ":", -1))
    aside = lambda text: F.contains(text, F.lit("parenthetical"))
    return F.when(~aside(title), F.coalesce(by_words(title), F.when(~aside(role), F.coalesce(by_words(role), by_root))))


def roots(arcs: DataFrame) -> DataFrame:
    """(network_seq, qname) of sources that are no targets; with report_id where arcs have it."""
    keys = [*report_keys(arcs), "network_seq"]
    sources = arcs.select(*keys, F.col("from_qname").alias("qname")).distinct()
    return sources.join(arcs.select(*keys, F.col("to_qname").alias("qname")).distinct(), [*keys, "qname"], "left_anti")


def classify(networks: DataFrame, arcs: DataFrame) -> DataFrame:
    """(seq, role_uri, statement) of presentation networks. A tree with several roots has none that speaks for it."""
    by = report_keys(networks, arcs)
    single = roots(arcs).groupBy(*by, F.col("network_seq").alias("seq")).agg(F.min("qname").alias("root"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    shown = networks.filter("kind = 'presentation'").join(single, [*by, "seq"], "left")
    return shown.select(*by, "seq", "role_uri", statement_kind(F.col("definition"), F.col("role_uri"), F.col("root")).alias("statement"))


def role_folds(networks: DataFrame) -> DataFrame:
    """(role_uri, folds_to): a role with a numbered suffix folds into its base if that exists and has the same definition, or it has none."""
    by = report_keys(networks)
    known = networks.groupBy(*by, "role_uri").agg(F.min_by("definition", F.when(F.col("definition").isNotNull(), F.col("seq"))).alias("definition"))
    base = known.select(*by, F.col("role_uri").alias("stem"), F.col("role_uri").alias("base"), F.col("definition").alias("base_definition"))
    stem = F.nullif(F.regexp_extract("role_uri", r"^(.*?)_(\d+)$", 1), F.lit(""))
    out = known.withColumn("stem", stem).join(base, [*by, "stem"], "left")
    folds = F.col("base").isNotNull() & (F.col("definition").isNull() | F.col("definition").eqNullSafe(F.col("base_definition")))
    return out.select(*by, "role_uri", F.when(folds, F.col("base")).otherwise(F.col("role_uri")).alias("folds_to"))


def plan_blocks(networks: DataFrame) -> DataFrame:
    """One row per section (folded role): number, category, name, level, family, subtitle, kinds of its networks, place in the report.

    Sections go by their number as text, unnumbered last, then by role.
    """
    by = report_keys(networks)
    of = networks.join(role_folds(networks), [*by, "role_uri"])
    stated = F.col("definition").isNotNull() & (F.col("role_uri") == F.col("folds_to"))
    rows = of.groupBy(*by, F.col("folds_to").alias("role_uri")).agg(
        F.coalesce(F.min_by("definition", F.when(stated, F.col("seq"))), F.min_by("definition", F.when(F.col("definition").isNotNull(), F.col("seq")))).alias("definition"),
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.min("seq").alias("first_seq"), F.array_sort(F.collect_set(F.when(F.col("role_uri") != F.col("folds_to"), F.col("role_uri")))).alias("merged_roles"),
    )
    t = rows.withColumn("t", parse_title(F.col("definition"))).withColumn("name", F.coalesce(F.nullif(F.col("t.name"), F.lit("")), F.col("role_uri")))
    t = t.withColumn("l", parse_level(F.col("t.category"), F.col("name")))
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.coalesce("t.number", F.lit("~")), "role_uri"))  # the sections of a report, or of the one taxonomy
    return t.select(*by, "role_uri", "definition", F.col("t.number").alias("number"), F.col("t.category").alias("category"), "name", F.col("l.level").alias("level"), F.col("l.family").alias("family"), F.col("l.subtitle").alias("subtitle"), "kinds", "merged_roles", place.alias("place"))


def disclosure_families(blocks: DataFrame) -> DataFrame:
    """Sections with a presentation under one (title, category), in order of the first: name, category, blocks, counts by level."""
    shown = blocks.filter(F.array_contains("kinds", "presentation"))
    by = report_keys(blocks)
    key = [*by, F.lower("family").alias("k"), F.lower(F.coalesce("category", F.lit(""))).alias("c")]
    levels = shown.groupBy(*key, "level").agg(F.count(F.lit(1)).alias("n")).groupBy(*by, "k", "c").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "level", "n"))), ",").alias("levels"))
    heads = shown.groupBy(*key).agg(F.min_by("family", "place").alias("family"), F.min_by("category", "place").alias("category"), F.count(F.lit(1)).alias("blocks"), F.min("place").alias("place"))
    return heads.join(levels, [*by, "k", "c"]).select(*by, "family", "category", "blocks", "levels", "place")


def definition_arcs(networks: DataFrame, arcs: DataFrame) -> DataFrame:
    """Definition arcs under their role, and under the role it folds into."""
    by = report_keys(networks, arcs)
    of = networks.filter("kind = 'definition'").join(role_folds(networks), [*by, "role_uri"])
    roles = of.select(*by, F.col("seq").alias("network_seq"), F.explode(F.array_distinct(F.array("role_uri", "folds_to"))).alias("role_uri"))
    return arcs.join(roles, [*by, "network_seq"]).select(*by, "role_uri", "network_seq", "seq", "arcrole", "from_qname", "to_qname", "target_role")


MEMBERS = """
WITH RECURSIVE down(report_id, role_uri, cube, axis, member, at_role, place, depth, trail) AS (
  SELECT report_id, role_uri, cube, axis, domain, at_role, '', 0, array(domain) FROM {starts}
  UNION ALL
  SELECT d.report_id, d.role_uri, d.cube, d.axis, a.to_qname, coalesce(a.target_role, d.at_role), concat(d.place, '.', lpad(CAST(a.seq AS STRING), 6, '0')), d.depth + 1, array_append(d.trail, a.to_qname)
  FROM down d JOIN {arcs} a ON a.report_id = d.report_id AND a.role_uri = d.at_role AND a.arcrole = 'domain-member' AND a.from_qname = d.member
  WHERE NOT array_contains(d.trail, a.to_qname) AND d.depth < 64
)
SELECT report_id, role_uri, cube, axis, member, depth, place FROM down WHERE depth > 0
"""


def hypercube_axes(networks: DataFrame, arcs: DataFrame) -> DataFrame:
    """(role_uri, cube, axis, domain, default, typed, at_role): axes of the cubes that a role declares, each hop in the arc's target role."""
    d = definition_arcs(networks, arcs)
    by = report_keys(d)
    pick = lambda kind, *cols: d.filter(F.col("arcrole") == kind).select(*by, *cols)
    cubes = pick("all", "role_uri", F.col("to_qname").alias("cube"), F.coalesce("target_role", "role_uri").alias("cube_role"), "network_seq", "seq")
    first = W.partitionBy(*by, "role_uri", "cube").orderBy("network_seq", "seq")
    cubes = cubes.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*by, "role_uri", "cube", "cube_role")
    axes = pick("hypercube-dimension", F.col("role_uri").alias("cube_role"), F.col("from_qname").alias("cube"), F.col("to_qname").alias("axis"), F.coalesce("target_role", "role_uri").alias("axis_role"), F.col("network_seq").alias("a_net"), F.col("seq").alias("a_seq"))
    once = W.partitionBy(*by, "role_uri", "cube", "axis").orderBy("a_net", "a_seq")
    axes = cubes.join(axes, [*by, "cube_role", "cube"]).withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    domains = pick("dimension-domain", F.col("role_uri").alias("axis_role"), F.col("from_qname").alias("axis"), F.col("to_qname").alias("domain"), F.coalesce("target_role", "role_uri").alias("at_role"), F.col("network_seq").alias("d_net"), F.col("seq").alias("d_seq"))
    one = W.partitionBy(*by, "axis_role", "axis").orderBy("d_net", "d_seq")
    domains = domains.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select(*by, "axis_role", "axis", "domain", "at_role")
    defaults = d.filter("arcrole = 'dimension-default'").groupBy(*by, F.col("from_qname").alias("axis")).agg(F.min_by("to_qname", F.struct("network_seq", "seq")).alias("default"))
    return axes.join(domains, [*by, "axis_role", "axis"], "left").join(defaults, [*by, "axis"], "left").select(*by, "role_uri", "cube", "axis", "domain", "default", F.col("domain").isNull().alias("typed"), "at_role", "a_seq")


def hypercube_members(networks: DataFrame, arcs: DataFrame) -> DataFrame:
    """(role_uri, cube, axis, member, place): members below each axis's domain, breadth first, each at its first visit."""
    by = report_keys(networks, arcs)
    one = lambda df: df if by else df.withColumn("report_id", F.lit(""))  # noqa: E731  one taxonomy counts as one report
    starts = one(hypercube_axes(networks, arcs).filter("domain IS NOT NULL")).select("report_id", "role_uri", "cube", "axis", "domain", "at_role")
    down = arcs.sparkSession.sql(MEMBERS, starts=starts, arcs=one(definition_arcs(networks, arcs)))
    visit = W.partitionBy("report_id", "role_uri", "cube", "axis", "member").orderBy("depth", "place")
    first = down.withColumn("_n", F.row_number().over(visit)).filter("_n = 1")
    order = W.partitionBy("report_id", "role_uri", "cube", "axis").orderBy("depth", "place")
    return first.select(*by, "role_uri", "cube", "axis", "member", F.row_number().over(order).alias("place"))


def fact_membership(facts: DataFrame, networks: DataFrame, arcs: DataFrame, concepts: DataFrame) -> DataFrame:
    """(report_id, seq, role_uri): facts in every section that presents their concept and admits their dimensions.

    Undimensioned facts are admitted. A dimensional one is if a single cube of the section has every axis with the member in its domain (typed or
    unlisted axes take any), or the presentation shows every axis and, if it lists members, every member. Relational division: the dimensions that fit are counted.
    """
    by = report_keys(networks, arcs)
    of = report_keys(networks, arcs, concepts)
    folds = role_folds(networks)
    shown = networks.filter("kind = 'presentation'").join(folds, [*by, "role_uri"]).select(*by, F.col("seq").alias("network_seq"), F.col("folds_to").alias("role_uri"))
    cites = arcs.join(shown, [*by, "network_seq"]).select(*by, "role_uri", F.explode(F.array("from_qname", "to_qname")).alias("concept")).distinct()
    lists = cites.join(concepts.filter("is_domain_member").select(*of, F.col("qname").alias("concept")), [*of, "concept"], "left_semi").select(*by, "role_uri").distinct().withColumn("lists_members", F.lit(True))
    # Taxonomy-sized sides: Spark broadcasts them by their size.
    pairs = facts.select("report_id", "seq", "concept", "dims", "dim_count").join(cites, [*by, "concept"])
    plain = pairs.filter("dim_count = 0").select("report_id", "seq", "role_uri")
    each = pairs.filter("dim_count > 0").select("report_id", "seq", "role_uri", "dim_count", F.explode("dims").alias("d")).select("report_id", "seq", "role_uri", "dim_count", F.col("d.axis").alias("axis"), F.col("d.member").alias("member"))
    axes = hypercube_axes(networks, arcs).select(*by, "role_uri", "cube", "axis", "domain", "typed")
    inside = hypercube_members(networks, arcs).select(*by, "role_uri", "cube", "axis", "member").unionByName(axes.filter("NOT typed").select(*by, "role_uri", "cube", "axis", F.col("domain").alias("member"))).distinct().withColumn("known", F.lit(True))
    by_cube = each.join(axes, [*by, "role_uri", "axis"]).join(inside, [*by, "role_uri", "cube", "axis", "member"], "left").filter(F.col("typed") | F.col("member").isNull() | F.col("known"))
    cube_ok = by_cube.groupBy("report_id", "seq", "role_uri", "cube", "dim_count").agg(F.count(F.lit(1)).alias("n")).filter("n = dim_count").select("report_id", "seq", "role_uri")
    as_axis, as_member = cites.select(*by, "role_uri", F.col("concept").alias("axis")), cites.select(*by, "role_uri", F.col("concept").alias("member")).withColumn("cited", F.lit(True))
    tree = each.join(as_axis, [*by, "role_uri", "axis"]).join(lists, [*by, "role_uri"], "left").join(as_member, [*by, "role_uri", "member"], "left").filter(F.col("lists_members").isNull() | F.col("member").isNull() | F.col("cited"))
    tree_ok = tree.groupBy("report_id", "seq", "role_uri", "dim_count").agg(F.count(F.lit(1)).alias("n")).filter("n = dim_count").select("report_id", "seq", "role_uri")
    return plain.unionByName(cube_ok.unionByName(tree_ok).distinct())


def cubes_to_arcs(axes: DataFrame, presentation: DataFrame) -> DataFrame:
    """Inverse of the reconstruction: (role_uri, cube, arcrole, from_qname, to_qname) with the cube found as the shared presentation parent of all
    axes of a role (the smallest name of several), and its other children as primary items. axes: (role_uri, axis); presentation: (role_uri, parent, child)."""
    need = axes.groupBy("role_uri").agg(F.count_distinct("axis").alias("n"))
    shared = presentation.join(axes.select("role_uri", F.col("axis").alias("child")).distinct(), ["role_uri", "child"]).groupBy("role_uri", "parent").agg(F.count_distinct("child").alias("n")).join(need, ["role_uri", "n"])
    cube = shared.groupBy("role_uri").agg(F.min("parent").alias("cube"))
    items = presentation.join(cube, "role_uri").filter("parent = cube").join(axes.select("role_uri", F.col("axis").alias("child")), ["role_uri", "child"], "left_anti")
    own = cube.join(axes, "role_uri").select("role_uri", "cube", F.lit("hypercube-dimension").alias("arcrole"), F.col("cube").alias("from_qname"), F.col("axis").alias("to_qname"))
    return own.unionByName(items.select("role_uri", "cube", F.lit("all").alias("arcrole"), F.col("child").alias("from_qname"), F.col("cube").alias("to_qname")))


def find_network(networks: DataFrame, classified: DataFrame, wanted: str) -> DataFrame:
    """Presentation networks that a name may mean, by the best strategy that finds any: role, definition or last path part, statement kind, substring.

    More than one row left is an ambiguity for the caller to report.
    """
    q = wanted.strip().lower()
    by = report_keys(networks, classified)
    own = networks.filter("kind = 'presentation'").join(classified.select(*by, "seq", "statement"), [*by, "seq"], "left")
    tail = F.lower(F.substring_index("role_uri", "/", -1))
    tier = (
        F.when(F.lower("role_uri") == q, 1).when((tail == q) | (F.lower("definition") == q), 2).when(F.lower("statement") == q.replace(" ", "_"), 3)
        .when(F.contains(F.lower(F.coalesce("definition", F.lit(""))), F.lit(q)) | F.contains(F.lower("role_uri"), F.lit(q)), 4)
    )
    hits = own.withColumn("tier", tier).filter("tier IS NOT NULL")
    return hits.withColumn("best", F.min("tier").over(W.partitionBy(*by))).filter("tier = best").select(*by, "seq", "role_uri", "definition", "statement", "tier")


def concept_roles(networks: DataFrame, arcs: DataFrame, most: int = 3) -> DataFrame:
    """(concept, names): the first presentation networks that cite each concept, by definition or else role."""
    by = report_keys(networks, arcs)
    shown = networks.filter("kind = 'presentation'").select(*by, F.col("seq").alias("network_seq"), F.coalesce("definition", "role_uri").alias("name"))
    cites = arcs.join(shown, [*by, "network_seq"]).select(*by, "network_seq", "name", F.explode(F.array("from_qname", "to_qname")).alias("concept")).distinct()
    first = cites.withColumn("_n", F.row_number().over(W.partitionBy(*by, "concept").orderBy("network_seq"))).filter(F.col("_n") <= most)
    return first.groupBy(*by, "concept").agg(F.transform(F.array_sort(F.collect_list(F.struct("network_seq", "name"))), lambda x: x["name"]).alias("names"))


def group_tree(blocks: DataFrame) -> DataFrame:
    """(role_uri, head, place, member_place): sections under the head of their family, the first of it; heads stand under themselves."""
    shown = blocks.filter(F.array_contains("kinds", "presentation"))
    by = report_keys(blocks)
    family = W.partitionBy(*by, F.lower("family"), F.lower(F.coalesce("category", F.lit("")))).orderBy("place")
    return shown.select(*by, "role_uri", F.first("role_uri").over(family).alias("head"), "place", F.row_number().over(family).alias("member_place"))


def block_footing(footed: DataFrame, columns: DataFrame) -> DataFrame:
    """(report_id, network_seq, foots, checked, differences) of judged roll-ups(report_id, network_seq, period_id, foots, difference) over the columns(report_id, period_id) shown."""
    shown = footed.join(columns.select("report_id", "period_id").distinct(), ["report_id", "period_id"], "left_semi")
    return shown.groupBy("report_id", "network_seq").agg(F.bool_and("foots").alias("foots"), F.count(F.lit(1)).alias("checked"), F.array_sort(F.collect_list(F.when(~F.col("foots"), F.struct("period_id", "difference")))).alias("differences"))
