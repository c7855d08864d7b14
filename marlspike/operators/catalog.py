"""The catalog: derived columns, upsert, ranking and lookups, each set at a time.

A catalog is a DataFrame of SCHEMA. Lookups take a DataFrame of terms and answer all of them with one
join; the catalog's side is small beside the terms, and adaptive execution broadcasts it where its
measured size allows and shuffles both sides where it doesn't.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, OTHER_PRIORITY, SOURCE_PRIORITY, Settings
from ..functions import text as T
from ..functions.similarity import trigram_codes
from ..workers import staged

COMPONENTS = "array<struct<strength: double, unit: string, name: string>>"
SUPPLIED = {
    "generic_name": "string", "brand_name": "string", "aliases": "array<string>", "strength": "string",
    "strength_value": "decimal(10,3)", "strength_unit": "string", "dosage_form": "string", "route": "string",
    "composition": "string", "manufacturer": "string", "combination_components": COMPONENTS,
    "atc_code": "string", "snomed_ct_code": "string", "rxcui": "string", "codes": "map<string,string>",
    "source_version": "string", "source_updated_at": "timestamp",
}
SCHEMA = {"id": "string", "external_id": "string", "source": "string"} | SUPPLIED | {"canonical_name": "string", "search_text": "string", "created_at": "timestamp", "updated_at": "timestamp"}


def clean_aliases(aliases: Column) -> Column:
    """Normalized, without blanks and repeats, sorted; null as none."""
    every = F.transform(F.coalesce(aliases, F.array().cast("array<string>")), T.normalize)
    return F.array_sort(F.array_distinct(F.filter(every, lambda a: a != "")))


def search_text(generic: Column, brand: Column, aliases: Column) -> Column:
    parts = F.filter(F.transform(F.concat(F.array(generic, brand), aliases), lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))
    return F.lower(F.array_join(parts, " "))


def canonical_name(generic: Column, brand: Column) -> Column:
    return F.nullif(T.normalize(F.coalesce(F.nullif(generic, F.lit("")), brand)), F.lit(""))


def derived(records: DataFrame) -> DataFrame:
    """Records of a source -> rows of SCHEMA, missing columns as null. The id is a digest of source and external_id."""
    rows = records.select(*[(F.col(c) if c in records.columns else F.lit(None)).cast(t).alias(c) for c, t in SCHEMA.items()])
    rows = rows.withColumn("aliases", clean_aliases(F.col("aliases")))
    canonical = F.coalesce(F.nullif("canonical_name", F.lit("")), canonical_name(F.col("generic_name"), F.col("brand_name")))
    key = F.concat_ws("|", F.col("source"), F.coalesce("external_id", F.uuid()))
    return rows.withColumns({
        "combination_components": F.coalesce("combination_components", F.array().cast(COMPONENTS)),
        "codes": F.coalesce("codes", F.create_map().cast("map<string,string>")),
        "canonical_name": canonical,
        "search_text": search_text(F.col("generic_name"), F.col("brand_name"), F.col("aliases")),
        "id": F.coalesce("id", F.sha2(key, 256)),
    })


def upsert(catalog: DataFrame, records: DataFrame, supplied: Sequence[str], now: Column | None = None, order: str | None = None) -> DataFrame:
    """The catalog after records came in, keyed by (source, external_id).

    A known key gets the supplied columns and what derives from the record, and keeps its id and
    created_at; unknown keys are added; records without external_id are always added. Of records with one
    key the last by ``order`` counts. One full outer join on the key, no row of which meets another.
    """
    now = F.current_timestamp() if now is None else now
    if order:
        last = Window.partitionBy("source", "external_id").orderBy(F.desc(order))
        records = records.withColumn("_n", F.when(F.col("external_id").isNull(), 1).otherwise(F.row_number().over(last))).filter("_n = 1")
    new = derived(records).withColumns({"created_at": now, "updated_at": now})
    changed = {*supplied, "aliases", "combination_components", "search_text", "canonical_name", "updated_at"}
    a, b = catalog.alias("a"), new.filter("external_id is not null").alias("b")
    known, came = F.col("a.id").isNotNull(), F.col("b.id").isNotNull()
    joined = a.join(b, (F.col("a.source") == F.col("b.source")) & (F.col("a.external_id") == F.col("b.external_id")), "full_outer")
    merged = joined.select(*[(F.when(came, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in changed else F.when(known, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))).alias(c) for c in SCHEMA])
    return merged.unionByName(new.filter("external_id is null").select(*SCHEMA))


def write_catalog(catalog: DataFrame, name: str) -> None:
    """Saves a catalog as a table, with statistics for the planner."""
    catalog.write.mode("overwrite").saveAsTable(name)
    catalog.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


# ---------------------------------------------------------------- ranking

def source_priority(source: Column | str = "source") -> Column:
    return F.coalesce(T.lookup(F.col(source) if isinstance(source, str) else source, {k: str(v) for k, v in SOURCE_PRIORITY.items()}).cast("int"), F.lit(OTHER_PRIORITY))


def completeness() -> Column:
    """0 to 3, lower is better: a missing brand, strength and aliases."""
    return F.col("brand_name").isNull().cast("int") + F.col("strength_value").isNull().cast("int") + (F.size("aliases") <= 0).cast("int")


def rank() -> Column:
    """Rows that fit alike: by source, completeness, then external_id."""
    return F.struct(source_priority().alias("priority"), completeness().alias("missing"), F.col("external_id"))


# ---------------------------------------------------------------- lookups

def exact_keys(catalog: DataFrame) -> DataFrame:
    """(key, exact_id, alias_id): the best row for each name or alias, and the best that has it as alias."""
    names = F.array(F.lower("generic_name"), F.lower("brand_name"))
    pairs = catalog.select("id", rank().alias("r"), F.explode(F.array_distinct(F.concat(F.transform(names, lambda n: F.struct(n.alias("key"), F.lit(False).alias("alias"))), F.transform("aliases", lambda n: F.struct(n.alias("key"), F.lit(True).alias("alias")))))).alias("k"))
    pairs = pairs.select("id", "r", "k.key", "k.alias").filter("key is not null and key <> ''")
    return pairs.groupBy("key").agg(F.min_by("id", "r").alias("exact_id"), F.min_by("id", F.when(F.col("alias"), F.col("r"))).alias("any_alias_id"), F.max("alias").alias("has_alias")).select("key", "exact_id", F.when(F.col("has_alias"), F.col("any_alias_id")).alias("alias_id"))


def find_exact(terms: DataFrame, catalog: DataFrame, term: str = "term") -> DataFrame:
    """terms with exact_id and alias_id, null where nothing fits. Terms compare by T.lookup_key."""
    keys = exact_keys(catalog).withColumnRenamed("key", "_key")
    return terms.join(keys, T.lookup_key(term) == F.col("_key"), "left").drop("_key")


def find_by_canonical(terms: DataFrame, catalog: DataFrame, term: str = "term") -> DataFrame:
    """One row for each term and catalog row of that identity, with its place."""
    own = catalog.select(F.lower("canonical_name").alias("_key"), "id", rank().alias("_r"))
    found = terms.join(own, F.nullif(T.normalize(term), F.lit("")) == F.col("_key"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(term).orderBy("_r"))).drop("_key", "_r")


def _alike(asked: DataFrame, index: DataFrame, least: float) -> DataFrame:
    """(term, id, external_id, similarity) of all pairs of asked (term, g) and index (id, external_id, h) from least on.

    Sets lie rarest trigram first. Two that are alike enough share one in their beginnings, and no more can follow
    it than the shorter rest holds; a pair counts at the first trigram that it shares, so it comes up once.
    """
    def begun(sets: DataFrame, grams: str, size: str, at: str) -> DataFrame:
        n = F.size(grams)
        return sets.select("*", n.alias(size), F.posexplode(F.slice(grams, F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1)).alias(at, "gram"))

    m, n = F.col("m"), F.col("n")
    needed = (m + n) * (least / (1 + least)) - 1e-9
    both = F.array_intersect("g", "h")
    pairs = begun(asked, "g", "m", "i").join(begun(index, "h", "n", "j"), "gram").filter(F.least(m - F.col("i"), n - F.col("j")) >= needed)
    pairs = pairs.filter(F.size(both) >= needed).filter(F.get(both, F.lit(0)) == F.col("gram"))
    similarity = F.size(both) / (m + n - F.size(both))
    return pairs.select("term", "id", "external_id", similarity.alias("similarity")).filter(F.col("similarity") >= least)


def search(terms: DataFrame, catalog: DataFrame, term: str = "term", limit: int | None = None, settings: Settings = DEFAULTS, steps: Sequence[float] = (0.5, 0.35), small: int = 10_000) -> DataFrame:
    """(term, id, similarity, place): each distinct term's rows of highest trigram similarity.

    |A & B| / |A | B|, ties to the smaller external_id. A term that has its number of rows from a step's similarity
    on has all of them, so only the others meet more of the catalog at the next; a catalog of at most ``small`` rows
    goes straight to the least similarity. The rows are the same either way. Terms and rows without a letter or
    digit have no trigrams and fit nothing.
    """
    limit = limit or settings.candidate_limit
    own = catalog.select("id", "external_id", F.explode(trigram_codes(F.col("search_text"))).alias("gram"))
    held = own.groupBy("gram").agg(F.count("*").alias("held"))

    def rarest_first(grams: DataFrame, name: str, *key: str) -> DataFrame:
        by = F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")
        return grams.join(held, "gram", "left").groupBy(*key).agg(F.sort_array(F.collect_list(by))["gram"].alias(name))

    def best(pairs: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("similarity"), "external_id"))
        return pairs.withColumn("place", place).filter(F.col("place") <= limit).select("term", "id", "similarity", "place")

    index = staged(rarest_first(own, "h", "id", "external_id"), "index")
    asked = terms.select(T.lookup_key(term).alias("term")).filter("term <> ''").distinct()
    asked = rarest_first(asked.select("term", F.explode(trigram_codes(F.col("term"))).alias("gram")), "g", "term")
    found = []
    if index.count() > small:
        asked = staged(asked, "asked")
        # few bytes, each of them much work: spread further than by size
        index = index.repartition(int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
        for step in steps:
            if step > settings.min_trigram_similarity:
                some = staged(best(_alike(asked, index, step)), "near")
                full = some.filter(F.col("place") == limit).select("term")
                found.append(some.join(full, "term", "left_semi"))
                asked = asked.join(full, "term", "left_anti")
    rows = best(_alike(asked, index, settings.min_trigram_similarity))
    for some in found:
        rows = rows.unionByName(some)
    return rows


def page(catalog: DataFrame, limit: int = 50, offset: int = 0) -> tuple[DataFrame, int]:
    """A page by name (binary order, nulls last, then external_id), and the number of all rows."""
    rows = catalog.orderBy(F.coalesce("generic_name", "brand_name").asc_nulls_last(), "external_id").offset(offset).limit(limit)
    return rows, catalog.count()


def by_id(catalog: DataFrame, key: str) -> DataFrame:
    return catalog.filter(F.col("id") == key)


def by_ids(keys: DataFrame, catalog: DataFrame, key: str = "id") -> DataFrame:
    """keys with the columns of the catalog row that each names; unknown ones have none and drop out."""
    return keys.withColumnRenamed(key, "_key").join(catalog, F.col("_key") == F.col("id")).drop("_key")


def rows_out(catalog: DataFrame) -> DataFrame:
    """The public columns of catalog rows."""
    return catalog.select("id", "generic_name", "brand_name", "aliases", "strength", F.col("strength_value").cast("double").alias("strength_value"), "strength_unit", "dosage_form", "route", "composition", "manufacturer", "combination_components", "codes", "source", "source_version", "canonical_name")
