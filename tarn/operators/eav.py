"""Attribute-value rows into wide tables.

`label_keys` resolves printed labels to attribute names, `with_typed` reads a printed value as the kind of its
attribute, `facts_long` keeps one value per entity and attribute, and `facts_wide` aggregates the pairs of an
entity into one map and projects the known keys into typed columns. Values that cannot be read stay visible in
the map `cast_failures`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows the attribute dictionary may have before it is no longer broadcast.
BROADCAST_ROWS = 20_000
#: Labels this long (letters and digits) are also matched with one slip: a letter lost, added, changed or two swapped.
FUZZY_LENGTH = 9

# Words printed where there is no value, and words that mean zero.
ABSENT = ("", "-", "--", "—", "–", "...", "…", "na", "n.a.", "n.a", "n/a", "not disclosed", "not available", "to be announced", "tba", "coming soon", "refer to sid", "null")
NOTHING = ("nil", "none", "zero", "no lock-in", "no lock in", "no load", "no")

ENTITIES = {"&amp;": "&", "&nbsp;": " ", "&#160;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&rsquo;": "'", "&#8377;": "₹"}

SQL_TYPES = {"percent": "decimal(18,2)", "price": "decimal(18,2)", "crore": "decimal(18,2)", "rupees": "bigint", "months": "int", "stars": "int", "day": "date", "words": "string"}


def plain(text: Column) -> Column:
    """Text with entities and odd blanks resolved, single blanks, no outer blanks."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[\s  -​ ﻿]+", " "))


def label_key(label: Column) -> Column:
    """A printed label without its decoration: case, dates of validity, bullets, footnote marks, punctuation and blanks."""
    key = F.lower(plain(label))
    key = F.regexp_replace(key, r"\(\s*(as (on|of|at)|updated|w\.?e\.?f)[^)]*\)", " ")
    key = F.regexp_replace(key, r"\bas (on|of|at) .*\d{4}\s*$", " ")
    return F.regexp_replace(key, r"[^a-z0-9ऀ-ॿ]+", "")


def _slips(key: Column) -> Column:
    """The key and every form of it with one character taken out."""
    return F.array_distinct(F.concat(F.array(key), F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key))))))


def _one_slip(a: Column, b: Column) -> Column:
    """True if a becomes b by one character added, lost or changed, or by swapping two neighbours."""
    at = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda s, i: F.when((s == 0) & (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))), i).otherwise(s))
    swapped = F.concat(F.substring(a, F.lit(1), at - 1), F.substring(a, at + 1, F.lit(1)), F.substring(a, at, F.lit(1)), F.substring(a, at + 2, F.length(a)))
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & (at > 0) & (swapped == b))


def label_keys(rows: DataFrame, dictionary: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label names an attribute of the dictionary (label_text, fact_key, value_kind), with attr_key and attr_kind.

    Labels count by their letters and digits; long ones also with one slip of the pen. A label that only contains an
    attribute's name is another label. If a label fits several attributes, the exact form wins, then the smaller name.
    """
    known = dictionary.where(F.col("label_text").isNotNull() & F.col("fact_key").isNotNull()).select(label_key(F.col("label_text")).alias("_known"), F.col("fact_key").alias("attr_key"), F.lower(F.trim("value_kind")).alias("attr_kind")).where("_known <> ''").groupBy("_known").agg(F.min(F.struct("attr_key", "attr_kind")).alias("_a")).select("_known", "_a.*")
    size, longest = known.agg(F.count("*"), F.coalesce(F.max(F.length("_known")), F.lit(0))).first()
    side = F.broadcast if size <= BROADCAST_ROWS else (lambda x: x)
    # a label with more letters and digits than the longest name and one slip names nothing
    keyed = rows.where(F.col(label).isNotNull()).withColumn("_key", label_key(F.col(label))).where(F.length("_key").between(1, longest + 1))
    exact = keyed.join(side(known), keyed["_key"] == known["_known"], "left")
    hit = exact.where("_known is not null").drop("_known", "_key")
    near = known.where(F.length("_known") >= FUZZY_LENGTH).select("*", F.explode(_slips(F.col("_known"))).alias("_slip"))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    rest = exact.where(F.col("_known").isNull() & (F.length("_key") >= FUZZY_LENGTH - 1)).select(*columns, "_key")
    fits = (
        rest.select("_key")
        .distinct()
        .withColumn("_slip", F.explode(_slips(F.col("_key"))))
        .join(side(near), "_slip")
        .where(_one_slip(F.col("_key"), F.col("_known")))
        .groupBy("_key")
        .agg(F.min(F.struct("attr_key", "attr_kind")).alias("_a"))
        .select("_key", "_a.*")
    )
    return hit.select(*columns, "attr_key", "attr_kind").unionByName(rest.join(fits, "_key").select(*columns, "attr_key", "attr_kind"))


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_AMOUNT = r"(\d[\d,]*(?:\.\d+)?)"


def _number(text: Column, pattern: str = _AMOUNT) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit("")).try_cast("decimal(30,6)"))


def _two_decimals(number: Column) -> Column:
    return F.round(number, 2).cast("decimal(28,2)").cast("string")


def _date_parts(v: Column) -> Column:
    """(year, month, day) of a printed date as text, the day before the month; nulls if it is none."""
    clean = F.regexp_replace(F.regexp_replace(v, r"(\d)(st|nd|rd|th)\b", "$1"), ",", " ")
    parts = F.split(F.trim(F.regexp_replace(clean, r"[-/. ]+", " ")), " ")
    a, b, c = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    worded = lambda x: x.rlike("^[a-z]{3,9}$")
    struct = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
    return F.when(F.size(parts) == 3, F.when(a.rlike(r"^\d{4}$"), struct(a, b, c)).when(worded(a), struct(c, a, b)).otherwise(struct(c, b, a)))


def _day(parts: Column) -> Column:
    """ISO day of (year, month, day); two-digit years lie between 1996 and 2025, other years give NULL."""
    y, m, d = parts["y"], parts["m"], parts["d"]
    month = F.when(m.rlike(r"^\d{1,2}$"), m).otherwise(F.array_position(F.array(*[F.lit(x) for x in _MONTHS]), F.substring(m, 1, 3)).cast("string"))
    year = F.when(F.length(y) == 2, F.concat(F.when(y.try_cast("int") >= 96, F.lit("19")).otherwise(F.lit("20")), y)).otherwise(y)
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def with_typed(rows: DataFrame, value: str, kind: str, out: str) -> DataFrame:
    """Rows with `out`: the printed value in the written form of its kind; NULL if missing, a placeholder or unreadable.

    percent, price, crore: two decimals (a lakh is a hundredth of a crore). rupees, months, stars: whole numbers
    (rupees: the first amount stated). day: YYYY-MM-DD. words: lower case, single blanks. Words for none are zero.
    The steps are columns of their own, so that each is computed once for a row.
    """
    staged = rows.withColumn("_v", F.lower(plain(F.col(value)))).withColumn("_n", _number(F.col("_v"))).withColumn("_bare", F.trim(F.regexp_replace("_v", r"[*#†‡¹²³]+$", "")))
    staged = staged.withColumn("_parts", F.when(F.col(kind) == "day", _date_parts(F.col("_v")))).withColumn("_unit", F.regexp_extract("_v", r"^[^\d]*[\d,.]+\s*([a-z]+)", 1)).withColumn("_d", F.when(F.col(kind) == "day", _day(F.col("_parts"))))
    v, n, bare, unit, k = (F.col(c) for c in ("_v", "_n", "_bare", "_unit", kind))
    whole = lambda x: F.round(x, 0).cast("decimal(28,0)").cast("string")
    none = bare.isin(*NOTHING)
    digit = n.isNotNull()
    percent = F.when(none, F.lit("0.00")).when(v.rlike(r"^[(\s]*[\d.]+\s*(%|per\s?cent|percent)?\s*(p\.?\s?a\.?)?[)\s]*$"), _two_decimals(n))
    crore = F.when(digit, _two_decimals(F.when(unit.rlike("^(lakh|lac)"), n / 100).otherwise(n)))
    scale = F.when(unit.rlike("^(lakh|lac)"), 100_000).when(unit.rlike("^cr"), 10_000_000).when(unit == "k", 1_000).otherwise(1)
    months = F.when(none, F.lit("0")).when(unit.rlike("^y"), whole(n * 12)).when(unit.rlike("^m"), whole(n)).when(unit.rlike("^d"), whole(n / 30))
    full = F.length(F.regexp_replace(v, "[^★]", ""))
    stars = F.when(full > 0, full.cast("string")).when(digit, whole(n))
    day = F.when(F.year("_d").between(1996, 2025), F.date_format("_d", "yyyy-MM-dd"))
    read = F.when(k == "percent", percent).when(k == "price", F.when(digit, _two_decimals(n))).when(k == "crore", crore).when(k == "rupees", F.when(digit, whole(n * scale))).when(k == "months", months).when(k == "stars", stars).when(k == "day", day).when(k == "words", bare)
    typed = F.when(F.col(value).isNull() | bare.isin(*ABSENT) | bare.rlike(r"^(refer|see|please refer|as per) "), None).otherwise(read)
    return staged.withColumn(out, typed).drop("_v", "_n", "_bare", "_parts", "_unit", "_d")


def facts_long(nodes: DataFrame, dictionary: DataFrame, *, entity: str = "page_id", label: str = "label", value: str = "value", order: str = "node_order") -> DataFrame:
    """One row per entity and attribute: (entity, fact_key, value_kind, typed_value, raw_value, readable).

    The readable value with the last order wins, then the largest typed value; an attribute without a readable value
    keeps its last raw value with readable = false; so does one all of whose values pass the range of its type. Rows with a null entity or label are no facts; exact copies of a
    row change nothing; an empty input gives an empty result. Extra columns of the input are not read. The value is
    chosen by a max over structs, which is combined before the shuffle, so an entity or attribute with very many rows
    costs no task more than one partial row from each map task.
    """
    rows = nodes.select(F.col(entity).alias("_entity"), F.col(label).alias("_label"), F.col(value).alias("_value"), F.col(order).alias("_order")).where("_entity is not null")
    keyed = with_typed(label_keys(rows, dictionary, "_label"), "_value", "attr_kind", "_typed")
    # a value beyond the range of its column's type cannot be read; it stays as the raw value
    fits = reduce(lambda out, kind: F.when(F.col("attr_kind") == kind, F.col("_typed").try_cast(SQL_TYPES[kind]).isNotNull()).otherwise(out), SQL_TYPES, F.lit(True))
    keyed = keyed.withColumn("_typed", F.when(fits, F.col("_typed")))
    best = keyed.groupBy("_entity", "attr_key").agg(F.max(F.struct(F.col("_typed").isNotNull().alias("readable"), F.coalesce(F.col("_order"), F.lit(-1)).alias("o"), F.col("_typed").alias("t"), F.col("_value").alias("v"), F.col("attr_kind").alias("k"))).alias("b"))
    return best.select(F.col("_entity").alias(entity), F.col("attr_key").alias("fact_key"), F.col("b.k").alias("value_kind"), F.col("b.t").alias("typed_value"), F.col("b.v").alias("raw_value"), F.col("b.readable").alias("readable"))


def facts_wide(long: DataFrame, attributes: list[tuple[str, str]], *, entity: str = "page_id") -> DataFrame:
    """One row per entity: the resolved pairs as a map, projected into one typed column per (key, kind) of attributes.

    cast_failures maps an attribute to the raw value that could not be read. An entity all of whose values failed
    keeps its row with null columns. The map of one entity has at most as many entries as there are attributes.
    """
    grouped = long.groupBy(entity).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("readable"), F.struct("fact_key", "typed_value"))))).alias("_pairs"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("readable") & F.col("raw_value").isNotNull(), F.struct("fact_key", "raw_value"))))).alias("cast_failures"),
    )
    return grouped.select(entity, *[F.try_element_at("_pairs", F.lit(key)).try_cast(SQL_TYPES.get(kind, "string")).alias(key) for key, kind in attributes], "cast_failures")


def attributes_of(dictionary: DataFrame) -> list[tuple[str, str]]:
    """The (fact_key, value_kind) pairs of a dictionary in name order; it must be a small table (checked)."""
    rows = dictionary.where("fact_key is not null").groupBy("fact_key").agg(F.min(F.lower(F.trim("value_kind"))).alias("kind")).orderBy("fact_key").limit(2_001).collect()
    if len(rows) > 2_000:
        raise ValueError("a wide table of more than 2,000 columns is not supported; use the long form")
    return [(r[0], r[1]) for r in rows]
