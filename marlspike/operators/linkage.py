"""Record linkage: noisy names against the catalog, in stages that each see only what the last left over.

Texts that normalize alike are resolved once. Every stage is a join on equal keys; only the edit
ratios of distinct (term, name) pairs run in a vectorised UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, UNCLASSIFIED, Settings
from ..functions import text as T
from ..functions.similarity import name_scores, python_round
from ..workers import staged
from .catalog import exact_keys, find_by_canonical, rank, search, source_priority

_MED = ["generic_name", "brand_name", "aliases", "strength", "strength_value", "strength_unit", "dosage_form", "route", "manufacturer", "combination_components", "source", "source_version", "external_id"]


def match_label(stage: str, prefix: str = "") -> Column:
    """The label of a match by its stage and row."""
    c = lambda k: F.col(prefix + k)
    unknown = c("source_version") == UNCLASSIFIED
    kind = F.when(c("brand_name").isNotNull() & (c("brand_name") != ""), "BRAND").otherwise("GENERIC")
    if stage in ("exact_brand", "exact_alias", "exact_generic"):
        own = {"exact_brand": F.lit("EXACT_BRAND"), "exact_alias": F.lit("EXACT_ALIAS"), "exact_generic": F.when(c("source") == "rxnorm", "EXACT_GENERIC_RXNORM").otherwise("EXACT_GENERIC")}[stage]
        return F.when(unknown, "EXACT_CATALOG_NAME").otherwise(own)
    if stage == "ocr_corrected":
        return F.when(unknown, "OCR_NORMALIZED_CATALOG_NAME").otherwise(F.concat(F.lit("OCR_NORMALIZED_"), kind))
    if stage == "fuzzy":
        return F.when(unknown, "FUZZY_CATALOG_NAME").otherwise(F.concat(F.lit("FUZZY_"), kind))
    return F.lit("UNKNOWN")


def _single(strength: Column) -> Column:
    return F.when(F.size(strength["components"]) == 1, F.get(strength["components"], F.lit(0)))


def strength_matches(strength: Column, value: Column, unit: Column) -> Column:
    one = _single(strength)
    return F.coalesce((F.lower(F.coalesce(unit, F.lit(""))) == F.lower(one["unit"])) & (F.abs(value.cast("double") - one["value"].cast("double")) < 0.01), F.lit(False))


def strength_delta(strength: Column, value: Column, unit: Column, components: Column, settings: Settings = DEFAULTS) -> Column:
    """Bonus, penalty or nothing for how a stated strength agrees; nothing where either is missing."""
    n, own = F.size(strength["components"]), F.greatest(F.coalesce(F.size(components), F.lit(0)), F.lit(0))
    same_unit = F.lower(F.coalesce(unit, F.lit(""))) == F.lower(_single(strength)["unit"])
    bonus, penalty = F.lit(settings.strength_match_bonus), F.lit(-settings.strength_mismatch_penalty)
    several = F.when((own > 0) & (own == n), bonus).when(own > 0, penalty).otherwise(0.0)
    one = F.when(strength_matches(strength, value, unit), bonus).when(same_unit, penalty).otherwise(0.0)
    return F.when((n == 0) | value.isNull(), 0.0).when(n > 1, several).otherwise(one)


def form_delta(asked: Column, form: Column, settings: Settings = DEFAULTS) -> Column:
    return F.when(T.forms_compatible(asked, form), 0.0).otherwise(-settings.form_mismatch_penalty)


def candidate_score(base: Column, strength: Column, form: Column, settings: Settings = DEFAULTS) -> Column:
    total = base + strength_delta(strength, F.col("strength_value"), F.col("strength_unit"), F.col("combination_components"), settings) + form_delta(form, F.col("dosage_form"), settings)
    total = total + F.when(source_priority() == 0, settings.source_priority_bonus).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def status(confidence: Column, margin_ok: Column, settings: Settings = DEFAULTS) -> Column:
    return F.when(~margin_ok, "REVIEW_REQUIRED").when(confidence >= settings.match_threshold, "HIGH_CONFIDENCE").when(confidence >= settings.low_confidence_threshold, "LOW_CONFIDENCE").otherwise("NO_MATCH")


def status_counts(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, status, n): how many of a document's rows have each status."""
    return rows.groupBy(doc, "status").agg(F.count("*").alias("n"))


def corroborated(strength: Column, form: Column) -> Column:
    """Evidence beyond the name: an agreeing strength, or an equal form."""
    known = F.coalesce(form, F.lit("")) != ""
    return strength_matches(strength, F.col("strength_value"), F.col("strength_unit")) | F.coalesce(known & (F.col("dosage_form") == form), F.lit(False))


def disambiguate(rows: DataFrame, key: str = "q") -> DataFrame:
    """Rows of one identity each -> those that stay, with ``unique``. Needs strength, form and the catalog's columns.

    The best source alone decides if it has one row; then strength with form, strength if no form was
    stated, or form if no strength was, each only where it leaves some row.
    """
    w = Window.partitionBy(key)
    found, formed = F.size(F.col("q_strength")["components"]) > 0, F.coalesce("q_form", F.lit("")) != ""
    x = rows.withColumn("_p", source_priority()).withColumn("_n", F.count("*").over(w)).withColumn("_top", F.col("_p") == F.min("_p").over(w))
    x = x.filter("_n = 1 or _top").withColumn("_n", F.count("*").over(w))
    x = x.withColumns({"_s": strength_matches(F.col("q_strength"), F.col("strength_value"), F.col("strength_unit")), "_f": T.forms_compatible("q_form", "dosage_form")})
    n = lambda c: F.sum(c.cast("int")).over(w)
    x = x.withColumns({"_nb": n(F.col("_s") & F.col("_f")), "_ns": n(F.col("_s")), "_nf": n(F.col("_f"))})
    rule = (
        F.when(F.col("_n") == 1, F.struct(F.lit(True).alias("keep"), F.lit(True).alias("unique")))
        .when(found & formed & (F.col("_nb") > 0), F.struct((F.col("_s") & F.col("_f")).alias("keep"), (F.col("_nb") == 1).alias("unique")))
        .when(found & (F.col("_ns") > 0), F.struct(F.col("_s").alias("keep"), ((F.col("_ns") == 1) & ~formed).alias("unique")))
        .when(~found & formed & (F.col("_nf") > 0), F.struct(F.col("_f").alias("keep"), (F.col("_nf") == 1).alias("unique")))
        .otherwise(F.struct(F.lit(True).alias("keep"), F.lit(False).alias("unique")))
    )
    return x.withColumn("_rule", rule).filter("_rule.keep").withColumn("unique", F.col("_rule.unique")).drop("_p", "_n", "_top", "_s", "_f", "_nb", "_ns", "_nf", "_rule")


_CANDIDATE = "struct<id: string, confidence: double, match_type: string>"


def _parsed(texts: DataFrame, settings: Settings) -> DataFrame:
    """Distinct normalized texts with strength, form and the name that is left."""
    raw = F.first("raw") if settings.decimal_safe else F.lit(None).cast("string")
    q = texts.groupBy("q").agg(raw.alias("raw"))
    source = F.coalesce("raw", "q") if settings.decimal_safe else F.col("q")
    q = q.withColumns({"q_strength": T.strength(source), "q_form": T.dosage_form("q")})
    name = T.strip_form(T.strip_strength("q"))
    return q.drop("raw").withColumn("name", F.coalesce(F.nullif(name, F.lit("")), "q"))


def _exact_stage(q: DataFrame, catalog: DataFrame, settings: Settings) -> DataFrame:
    """Whole text first, then the name, as alias or brand; a hit by generic name alone waits."""
    keys = exact_keys(catalog)
    med = catalog.select("id", *_MED).withColumnRenamed("id", "exact_id")
    tries = q.select("q", "q_strength", "q_form", F.posexplode(F.array_distinct(F.array("q", "name"))).alias("turn", "term"))
    hit = tries.join(keys, F.col("term") == F.col("key")).join(med, "exact_id")
    stage = F.when(F.col("alias_id") == F.col("exact_id"), "exact_alias").when(T.normalize("brand_name") == F.col("term"), "exact_brand")
    hit = hit.withColumn("stage", stage).filter("stage is not null")
    label = F.when(F.col("stage") == "exact_alias", match_label("exact_alias")).otherwise(match_label("exact_brand"))
    found = F.size("q_strength.components") > 0
    clash = found & F.col("strength_value").isNotNull() & ~strength_matches(F.col("q_strength"), F.col("strength_value"), F.col("strength_unit"))
    if settings.strict_strength:
        clash = clash | ~T.forms_compatible("q_form", "dosage_form")
    one = F.struct(F.col("exact_id").alias("id"), F.when(clash, 70.0).otherwise(100.0).alias("confidence"), label.alias("match_type"))
    return hit.groupBy("q").agg(F.min_by(F.struct(F.when(clash, "REVIEW_REQUIRED").otherwise("EXACT").alias("status"), F.array(one).alias("candidates")), "turn").alias("r")).select("q", "r.status", "r.candidates")


def _generic_stage(q: DataFrame, catalog: DataFrame, settings: Settings) -> DataFrame:
    med = catalog.select("id", *_MED)
    rows = find_by_canonical(q.select("q", "q_strength", "q_form", "name"), catalog, "name").join(med, "id")
    kept = disambiguate(rows)
    if settings.strict_strength:
        clash = (F.size("q_strength.components") > 0) & F.col("strength_value").isNotNull() & ~strength_matches(F.col("q_strength"), F.col("strength_value"), F.col("strength_unit")) | ~T.forms_compatible("q_form", "dosage_form")
        kept = kept.withColumn("unique", F.col("unique") & ~clash)
    one = F.struct(rank().alias("r"), F.struct("id", F.when(F.col("unique"), 100.0).otherwise(85.0).alias("confidence"), match_label("exact_generic").alias("match_type")).alias("c"))
    return kept.groupBy("q").agg(F.bool_and("unique").alias("unique"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("candidates")).select("q", F.when(F.col("unique"), "EXACT").otherwise("REVIEW_REQUIRED").alias("status"), "candidates")


def scored_terms(terms: DataFrame, catalog: DataFrame, settings: Settings = DEFAULTS, limit: int | None = None) -> DataFrame:
    """(term, id, similarity, base): the candidates of each distinct term, scored against brand and generic name."""
    near = search(terms, catalog, "term", limit, settings)
    med = catalog.select("id", F.lower("brand_name").alias("b"), F.lower("generic_name").alias("g"))
    pairs = near.join(med, "id").withColumn("name", F.explode(F.array_distinct(F.filter(F.array("b", "g"), lambda n: n.isNotNull() & (n != "")))))
    pairs = staged(pairs, "pairs")
    scores = pairs.select("term", "name").distinct().withColumn("base", name_scores("term", "name"))
    return pairs.join(scores, ["term", "name"]).groupBy("term", "id", "similarity").agg(F.max("base").alias("base"))


def _fuzzy_stage(q: DataFrame, catalog: DataFrame, settings: Settings) -> DataFrame:
    made = F.concat(*[F.slice(v, F.lit(2), F.size(v)) for v in (T.optical_variants("name"), T.character_variants("name"))])
    own = F.transform(F.array_distinct(F.array("q", "name")), lambda t: F.struct(t.alias("term"), F.lit("fuzzy").alias("stage")))
    asked = q.select("q", "q_strength", "q_form", F.posexplode(F.concat(own, F.transform(made, lambda t: F.struct(t.alias("term"), F.lit("ocr_corrected").alias("stage"))))).alias("turn", "t")).select("q", "q_strength", "q_form", "turn", F.col("t.term").alias("term"), F.col("t.stage").alias("stage"))
    asked = staged(asked.withColumn("term", T.lookup_key("term")).filter("term <> ''"), "terms")
    keys = exact_keys(catalog).select(F.col("key").alias("term"), "exact_id")
    asked = asked.join(keys, "term", "left").withColumn("exact_id", F.when(F.col("stage") == "ocr_corrected", F.col("exact_id")))
    verified = asked.filter("exact_id is not null").select("q", "q_strength", "q_form", "turn", "stage", F.col("exact_id").alias("id"), F.lit(100.0).alias("base"), F.lit(1.0).alias("similarity"), F.lit(True).alias("verified"))
    rest = asked.filter("exact_id is null")
    near = rest.join(scored_terms(rest.select("term"), catalog, settings), "term").select("q", "q_strength", "q_form", "turn", "stage", "id", "base", "similarity", F.lit(False).alias("verified"))
    med = catalog.select("id", *_MED)
    every = verified.unionByName(near).join(med, "id")
    score = F.when(F.col("verified"), 100.0).otherwise(candidate_score(F.col("base"), F.col("q_strength"), F.col("q_form"), settings))
    if settings.strict_strength:
        clash = (F.size("q_strength.components") > 0) & F.col("strength_value").isNotNull() & ~strength_matches(F.col("q_strength"), F.col("strength_value"), F.col("strength_unit")) | ~T.forms_compatible("q_form", "dosage_form")
        score = F.when(F.col("verified") & clash, F.lit(70.0)).otherwise(score)
        every = every.withColumn("verified", F.col("verified") & ~clash)
    label = F.when(F.col("stage") == "fuzzy", match_label("fuzzy")).otherwise(match_label("ocr_corrected"))
    every = every.withColumns({"score": score, "label": label, "sure": corroborated(F.col("q_strength"), F.col("q_form"))})
    # the best of a row's scores, a verified one before any; the earliest of equal ones
    best = F.min_by(F.struct("score", "label"), F.struct(~F.col("verified"), -F.col("score"), F.col("turn")))
    rows = every.groupBy("q", "id", "external_id").agg(best.alias("b"), F.max("verified").alias("verified"), F.min("turn").alias("turn"), F.max("similarity").alias("similarity"), F.first("sure").alias("sure"))
    rows = rows.select("q", "id", F.col("b.score").alias("score"), F.col("b.label").alias("label"), "verified", "sure", python_round("b.score").alias("confidence"), "turn", "similarity", "external_id")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "turn", F.desc("similarity"), "external_id"))
    rows = rows.withColumn("place", place).filter(F.col("place") <= settings.candidate_limit)
    one = F.struct("place", F.struct("id", "confidence", F.col("label").alias("match_type")).alias("c"), (F.col("verified") | F.col("sure")).alias("backed"))
    got = rows.groupBy("q").agg(F.array_sort(F.collect_list(one)).alias("l"))
    top, second = F.get("l", F.lit(0)), F.get("l", F.lit(1))
    confidence = top["c"]["confidence"]
    raw = status(confidence, (F.size("l") == 1) | (confidence - second["c"]["confidence"] >= settings.ambiguity_margin), settings)
    final = F.when((raw == "HIGH_CONFIDENCE") & ~top["backed"], "REVIEW_REQUIRED").otherwise(raw)
    return got.select("q", final.alias("status"), F.transform("l", lambda x: x["c"]).alias("c")).select("q", "status", F.when(F.col("status") != "NO_MATCH", F.col("c")).otherwise(F.array().cast(f"array<{_CANDIDATE}>")).alias("candidates"))


def resolve(queries: DataFrame, catalog: DataFrame, settings: Settings = DEFAULTS, text: str = "input_text", ocr: str | None = None) -> DataFrame:
    """queries with normalized_text, status, matched_id, match_type, confidence, overall_confidence, candidates,
    parsed_strength, parsed_form. Every row gets an answer; blank and null texts are NO_MATCH.
    """
    asked = queries.withColumn("normalized_text", T.normalize(text))
    texts = asked.filter("normalized_text <> ''").select(F.col("normalized_text").alias("q"), F.col(text).alias("raw"))
    q = staged(_parsed(texts, settings), "texts")
    catalog = staged(catalog, "catalog")
    exact = staged(_exact_stage(q, catalog, settings), "exact")
    left = q.join(exact.select("q"), "q", "left_anti")
    generic = staged(_generic_stage(left, catalog, settings), "generic")
    left = left.join(generic.select("q"), "q", "left_anti")
    fuzzy = _fuzzy_stage(left, catalog, settings)
    kind = f"array<{_CANDIDATE}>"
    found = exact.withColumn("candidates", F.col("candidates").cast(kind)).unionByName(generic.withColumn("candidates", F.col("candidates").cast(kind))).unionByName(fuzzy.withColumn("candidates", F.col("candidates").cast(kind)))
    answers = q.join(found, "q", "left")
    out = asked.join(answers.withColumnRenamed("q", "normalized_text"), "normalized_text", "left")
    top = F.get("candidates", F.lit(0))
    accepted = F.col("status").isin("EXACT", "HIGH_CONFIDENCE")
    out = out.withColumns({"status": F.coalesce("status", F.lit("NO_MATCH")), "candidates": F.coalesce("candidates", F.array().cast(kind))})
    out = out.withColumns({"matched_id": F.when(accepted, top["id"]), "match_type": F.when(accepted, top["match_type"]), "confidence": F.when(accepted, top["confidence"])})
    overall = T.fuse_confidence("confidence", ocr) if ocr else F.col("confidence")
    return out.withColumn("overall_confidence", overall).withColumnRenamed("q_strength", "parsed_strength").withColumnRenamed("q_form", "parsed_form").drop("name")


# ---------------------------------------------------------------- the plain matcher

def match_tokens(tokens: DataFrame, catalog: DataFrame, settings: Settings = DEFAULTS, token: str = "token") -> DataFrame:
    """(token, id, confidence, match_type): exact or alias, else fuzzy, else the best optical variant, else unresolved.
    Two best scores nearer than the margin are ambiguous."""
    keys = exact_keys(catalog)
    q = tokens.select(F.col(token).alias("token"), T.lookup_key(token).alias("term")).distinct()
    hit = q.join(keys, F.col("term") == F.col("key"), "left").drop("key")
    exact = hit.filter("exact_id is not null").select("token", F.col("exact_id").alias("id"), F.lit(100.0).alias("confidence"), F.when(F.col("alias_id") == F.col("exact_id"), "alias").otherwise("exact").alias("match_type"))
    left = hit.filter("exact_id is null").select("token", "term")
    made = left.select("token", F.posexplode(T.optical_variants("term")).alias("turn", "term"))
    best = scored_terms(made.select("term"), catalog, settings).join(catalog.select("id", "external_id"), "id")
    ranked = made.join(best, "term").withColumn("place", F.row_number().over(Window.partitionBy("token", "turn").orderBy(F.desc("base"), F.desc("similarity"), "external_id"))).filter("place <= 2")
    two = ranked.groupBy("token", "turn").agg(F.max_by("id", -F.col("place")).alias("id"), F.max("base").alias("base"), F.max(F.when(F.col("place") == 2, F.col("base"))).alias("next"))
    raw = two.filter("turn = 0").select("token", F.struct("id", "base", "next").alias("raw"))
    variant = two.filter("turn > 0").groupBy("token").agg(F.min_by(F.struct("id", "base", "next"), F.struct(-F.col("base"), F.col("turn"))).alias("variant"))
    x = left.join(raw, "token", "left").join(variant, "token", "left")
    good = lambda c: F.coalesce(F.col(c)["base"] >= settings.match_threshold, F.lit(False))
    close = lambda c: F.coalesce(F.col(c)["base"] - F.col(c)["next"] < settings.ambiguity_margin, F.lit(False))
    pick = F.when(good("raw"), F.col("raw")).when(good("variant"), F.col("variant"))
    label = F.when(good("raw"), F.when(close("raw"), "ambiguous").otherwise("fuzzy")).when(good("variant"), F.when(close("variant"), "ambiguous").otherwise("ocr_corrected")).otherwise("unresolved")
    fuzzy = x.select("token", F.when(label.isin("fuzzy", "ocr_corrected"), pick["id"]).alias("id"), F.coalesce(pick["base"], F.col("raw")["base"], F.col("variant")["base"], F.lit(0.0)).alias("confidence"), label.alias("match_type"))
    return exact.unionByName(fuzzy)


def search_many(terms: DataFrame, catalog: DataFrame, limit: int = 10, settings: Settings = DEFAULTS, term: str = "term") -> DataFrame:
    """(term, place, id, confidence, match_type): an exact or alias hit first, then scored candidates, at most limit."""
    q = terms.select(T.lookup_key(term).alias("term")).filter("term <> ''").distinct()
    hit = q.join(exact_keys(catalog).withColumnRenamed("key", "term"), "term")
    exact = hit.select("term", F.col("exact_id").alias("id"), F.lit(100.0).alias("confidence"), F.lit(1.0).alias("similarity"), F.when(F.col("alias_id") == F.col("exact_id"), "alias").otherwise("exact").alias("match_type"))
    near = scored_terms(q, catalog, settings, limit).select("term", "id", F.col("base").alias("confidence"), "similarity", F.lit("fuzzy").alias("match_type"))
    near = near.join(exact.select("term", "id"), ["term", "id"], "left_anti")
    every = exact.unionByName(near).join(catalog.select("id", "external_id"), "id")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.col("match_type") == "fuzzy", F.desc("confidence"), F.desc("similarity"), "external_id"))
    return every.withColumn("place", place).filter(F.col("place") <= limit).select("term", "place", "id", "confidence", "match_type")
