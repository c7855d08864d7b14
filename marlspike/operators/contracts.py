"""Rows as the service's callers get them: extraction contract, processing rows, resolve answers."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocabulary import CONTRACT_FORMS, CONTRACT_ROUTES

NO_PATIENT = "Patient details not detected clearly."
LLM_SCHEMA = "prescribed_date string, metadata struct<prescriber_name: string, prescriber_registration: string, clinic_name: string, patient_name: string, indication_notes: string, notes: string>, medications array<struct<name: string, generic_name: string, strength: string, form: string, route: string, dosage: string, frequency: string, timing: string, duration_text: string, duration_days: int, instructions: string, common_use: string, confidence: double>>, full_text string"


def medication(rows: DataFrame) -> DataFrame:
    """Extracted rows in the extraction contract: unknown is null, confidence from 0 to 1, the catalog's strength first."""
    score = F.coalesce("overall_confidence", "confidence")
    return rows.withColumn("medication", F.struct(
        "name", "generic_name", F.coalesce(F.nullif("strength", F.lit("")), T.given("strength_text")).alias("strength"),
        T.lookup(F.lower("dosage_form"), CONTRACT_FORMS).alias("form"), T.lookup(F.lower("route"), CONTRACT_ROUTES).alias("route"),
        T.given("dosage").alias("dosage"), T.given("frequency").alias("frequency"), F.lit(None).cast("string").alias("timing"),
        T.given("duration").alias("durationText"), T.duration_days(T.given("duration")).alias("durationDays"),
        F.lit(None).cast("string").alias("instructions"), F.lit(None).cast("string").alias("commonUse"), F.round(score / 100.0, 3).alias("confidence"),
    ))


def extraction(rows: DataFrame, patients: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, notes, medications): one row for each document of patients (doc, patient_info)."""
    listed = medication(rows).groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "medication"))), lambda s: s["medication"]).alias("medications"))
    notes = F.nullif(F.nullif(F.trim("patient_info"), F.lit(NO_PATIENT)), F.lit(""))
    return patients.select(doc, notes.alias("notes")).join(listed, doc, "left")


def parse_llm(texts: DataFrame, json: str = "json") -> DataFrame:
    """texts with ``parsed``; null where the JSON isn't the schema's."""
    return texts.withColumn("parsed", F.from_json(json, LLM_SCHEMA))


def llm_days(text: Column, days: Column) -> Column:
    """A stated number of days, else the model's own."""
    return F.coalesce(T.duration_days(text), days)


def llm_extraction(parsed: DataFrame) -> DataFrame:
    """parsed -> ``extraction`` with upper-case form and route and days derived from the text."""
    def med(m: Column) -> Column:
        return F.struct(m["name"].alias("name"), m["generic_name"].alias("genericName"), m["strength"].alias("strength"), F.nullif(F.upper(m["form"]), F.lit("")).alias("form"), F.nullif(F.upper(m["route"]), F.lit("")).alias("route"), m["dosage"].alias("dosage"), m["frequency"].alias("frequency"), m["timing"].alias("timing"), m["duration_text"].alias("durationText"), llm_days(m["duration_text"], m["duration_days"]).alias("durationDays"), m["instructions"].alias("instructions"), m["common_use"].alias("commonUse"), m["confidence"].alias("confidence"))

    return parsed.withColumn("extraction", F.struct(F.col("parsed.prescribed_date").alias("prescribedDate"), F.col("parsed.metadata").alias("metadata"), F.transform("parsed.medications", med).alias("medications")))


def llm_rows(parsed: DataFrame, *keep: str) -> DataFrame:
    """One processing row for each medication; nothing of it comes from a catalog."""
    x = parsed.select(*keep, F.posexplode("parsed.medications").alias("place", "m"))
    or_missing = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(T.MISSING))
    none = F.lit(None).cast("string")
    return x.select(*keep, "place", F.col("m.name").alias("name"), F.round(F.col("m.confidence") * 100.0, 1).alias("confidence"), or_missing("m.dosage").alias("dosage"), or_missing("m.frequency").alias("frequency"), or_missing("m.duration_text").alias("duration"), none.alias("raw_line"), none.alias("id"), F.col("m.generic_name").alias("generic_name"), none.alias("brand_name"), F.col("m.strength").alias("strength"), F.nullif(F.lower("m.form"), F.lit("")).alias("dosage_form"), F.nullif(F.lower("m.route"), F.lit("")).alias("route"), none.alias("manufacturer"), F.lit("LLM_EXTRACTED").alias("match_type"), F.lit("gemini").alias("source"))


def patient_info(meta: Column) -> Column:
    """What is known of prescriber and patient, a line each; a title that is there already isn't doubled."""
    some = lambda c: F.nullif(c, F.lit(""))
    doctor = some(F.trim(F.regexp_replace(meta["prescriber_name"], r"(?i)^\s*dr\.?\s+", "")))
    lines = F.concat_ws("\n", F.concat(F.lit("Dr. "), doctor), F.concat(F.lit("Reg No: "), some(meta["prescriber_registration"])), some(meta["clinic_name"]), F.concat(F.lit("Patient: "), some(meta["patient_name"])), some(meta["indication_notes"]), some(meta["notes"]))
    return F.coalesce(some(lines), F.lit(NO_PATIENT))


def resolve_answers(resolved: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolved queries with the public columns of the matched row; strength falls back to the stated one."""
    med = catalog.select(F.col("id").alias("matched_id"), "generic_name", "brand_name", "strength_value", "strength_unit", "dosage_form", "source")
    one = F.when(F.size("parsed_strength.components") == 1, F.get("parsed_strength.components", F.lit(0)))
    x = resolved.join(med, "matched_id", "left")
    return x.withColumns({"strength_unit": F.when(F.col("strength_value").isNull(), one["unit"]).otherwise(F.col("strength_unit")), "strength_value": F.coalesce(F.col("strength_value").cast("double"), one["value"].cast("double"))})


def health(spark: SparkSession, catalog: str, recognizer: bool = False) -> dict[str, str | bool]:
    """The service's health: ok if the catalog's table answers, else degraded; recognizer: whether one is set up."""
    try:
        spark.table(catalog).select(F.lit(1)).limit(1).collect()
        connected = True
    except (PySparkException, Py4JError):
        connected = False
    return {"status": "ok" if connected else "degraded", "vision_api_configured": recognizer, "database_connected": connected}
