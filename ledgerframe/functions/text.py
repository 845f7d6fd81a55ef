"""Text and name functions that need no Python: native columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def normalize_whitespace(text: Column) -> Column:
    """No-break spaces and runs of blanks as one space, none beside line breaks, at most one empty line, trimmed."""
    t = F.regexp_replace(text, " ", " ")
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \n"))


def split_camel(name: Column) -> Column:
    """Words of a camel-case name parted by spaces (lower-to-upper and acronym-to-word boundaries)."""
    return F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def label_from_name(qname: Column) -> Column:
    """A readable label of an element name; a TextBlock suffix goes first."""
    local = F.substring_index(qname, ":", -1)
    return F.regexp_replace(F.regexp_replace(local, "TextBlock$", ""), "([a-z])([A-Z])", "$1 $2")


def label_for_role(labels: Column, role: Column, standard: Column, qname: Column) -> Column:
    """The label of a concept for a preferred role: that of the very role, else the first whose role ends in the role's last part, else the standard label, else the local name.

    labels: array<struct<role, value>>; empty values do not count. Null labels and roles are none."""
    said = F.filter(labels, lambda x: F.coalesce(x["value"], F.lit("")) != "")
    last = F.lower(F.substring_index(role, "/", -1))
    exact, alike = F.filter(said, lambda x: x["role"] == role), F.filter(said, lambda x: F.endswith(F.lower(x["role"]), last))
    return F.coalesce(F.get(exact, 0)["value"], F.get(alike, 0)["value"], F.nullif(standard, F.lit("")), local_name(qname))


def measure_token(prefix: Column, local: Column) -> Column:
    """prefix:local of a measure; local alone without a prefix."""
    return F.concat(F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(prefix, F.lit(":"))).otherwise(""), local)


def unit_measure(numerator: Column, denominator: Column) -> Column:
    """The name of a unit: its single measure, or numerator/denominator; null without a numerator."""
    return F.concat(numerator, F.coalesce(F.concat(F.lit("/"), denominator), F.lit("")))


def local_name(qname: Column) -> Column:
    return F.substring_index(F.substring_index(qname, ":", -1), "#", -1)


def prefix_of(qname: Column) -> Column:
    return F.when(F.contains(qname, F.lit(":")), F.substring_index(qname, ":", 1))


def qname_uri(namespace: Column, local: Column) -> Column:
    return F.concat(namespace, F.lit("#"), local)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def language_tag(text: Column) -> Column:
    return F.lower(F.nullif(F.trim(text), F.lit("")))


def entity_sqname(scheme: Column, identifier: Column) -> Column:
    return F.concat(F.when(F.contains(F.lower(scheme), F.lit("cik")), "cik:").otherwise("entity:"), identifier)


def clean_narrative(text: Column) -> Column:
    """Lines without page numbers, contents marks, member lists and long digit runs; white space normalised."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\b\S+Member\b(\s+\S+Member\b)+", ""), r"\b\d{10,}\b", "")))
    kept = F.filter(lines, lambda x: ~x.rlike(r"(?i)^(\d{1,3}|page \d+|table of contents)$"))
    return normalize_whitespace(F.array_join(kept, "\n"))


def digits(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, r"\D", ""), F.lit(""))


#: Item captions of the current report, by number.
ITEM_CAPTIONS = {
    "1.01": "Entry into a Material Definitive Agreement",
    "1.02": "Termination of a Material Definitive Agreement",
    "1.03": "Bankruptcy or Receivership",
    "1.04": "Mine Safety \u2014 Reporting of Shutdowns and Patterns of Violations",
    "1.05": "Material Cybersecurity Incidents",
    "2.01": "Completion of Acquisition or Disposition of Assets",
    "2.02": "Results of Operations and Financial Condition",
    "2.03": "Creation of a Direct Financial Obligation",
    "2.04": "Triggering Events That Accelerate a Financial Obligation",
    "2.05": "Costs Associated with Exit or Disposal Activities",
    "2.06": "Material Impairments",
    "3.01": "Notice of Delisting or Failure to Satisfy a Listing Rule",
    "3.02": "Unregistered Sales of Equity Securities",
    "3.03": "Material Modification to Rights of Security Holders",
    "4.01": "Changes in Registrant's Certifying Accountant",
    "4.02": "Non-Reliance on Previously Issued Financial Statements",
    "5.01": "Changes in Control of Registrant",
    "5.02": "Departure or Election of Directors and Officers",
    "5.03": "Amendments to Articles or Bylaws; Change in Fiscal Year",
    "5.04": "Temporary Suspension of Trading Under Employee Benefit Plans",
    "5.05": "Amendment to Code of Ethics, or Waiver of a Provision",
    "5.06": "Change in Shell Company Status",
    "5.07": "Submission of Matters to a Vote of Security Holders",
    "5.08": "Shareholder Director Nominations",
    "6.01": "ABS Informational and Computational Material",
    "6.02": "Change of Servicer or Trustee",
    "6.03": "Change in Credit Enhancement or External Support",
    "6.04": "Failure to Make a Required Distribution",
    "6.05": "Securities Act Updating Disclosure",
    "7.01": "Regulation FD Disclosure",
    "8.01": "Other Events",
    "9.01": "Financial Statements and Exhibits",
}


def parse_items(text: Column) -> Column:
    """Distinct item codes of a comma- or semicolon-separated list, in order; a caption after the code and a leading `Item` are dropped."""
    bare = lambda x: F.trim(F.regexp_replace(F.trim(x), "^Item", ""))
    codes = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), lambda x: F.regexp_replace(F.trim(F.substring_index(bare(x), " ", 1)), "[.:]+$", ""))
    return F.array_distinct(F.filter(codes, lambda x: x != ""))


def describe_items(items: Column) -> Column:
    """array<struct<item, caption>>; an unknown code has an empty caption."""
    names = F.create_map(*[F.lit(x) for kv in ITEM_CAPTIONS.items() for x in kv])
    return F.transform(items, lambda i: F.struct(i.alias("item"), F.coalesce(F.try_element_at(names, i), F.lit("")).alias("caption")))


def is_earnings_release(items: Column) -> Column:
    return F.coalesce(F.array_contains(items, "2.02"), F.lit(False))


def cover_form(text: Column) -> Column:
    """Form named in the first 2000 characters; null if none."""
    return F.nullif(F.upper(F.regexp_extract(F.substring(text, 1, 2000), r"(?i)form\s+(10-[KQ](?:/A)?|20-F|40-F|8-K|6-K)", 1)), F.lit(""))


def json_kind(text: Column) -> Column:
    """What a JSON document is, by its first 4000 characters; null if none of the kinds."""
    head = F.substring(text, 1, 4000)
    has = lambda x: F.contains(head, F.lit(x))
    return F.when(has("xbrl.org/2021/xbrl-json") | has('"documentInfo"') & has('"facts"'), "oim").when(has('"@graph"') & has("AccountingEquation"), "equations").when(has('"@graph"') | has('"@context"'), "json-ld").when(has('"xbrl:'), "compiled").when(has('"concepts"') & has('"networks"'), "model")


def is_inline(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 10000))
    return F.contains(head, F.lit("http://www.xbrl.org/2013/inlinexbrl")) | F.contains(head, F.lit("<ix:"))
