"""Sources of catalog records, each a DataFrame and the columns that it supplies."""

from __future__ import annotations

import logging
from typing import Protocol

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import UNCLASSIFIED
from ..functions import text as T
from ..operators.catalog import COMPONENTS, upsert
from ..workers import staged
from .brands import BRANDS
from .concepts import register

# The types of files that are taken.
CONTENT_TYPES = ("image/jpeg", "image/png", "image/webp", "image/bmp", "image/tiff", "application/pdf")


class Provider(Protocol):
    source: str
    supplied: tuple[str, ...]

    def is_configured(self) -> bool: ...

    def records(self, spark: SparkSession) -> DataFrame: ...


def names_from(lines: DataFrame) -> DataFrame:
    """Lines (value) -> records of names of which nobody knows whether they are brands or generics."""
    name = F.trim("value")
    return lines.select(name.alias("generic_name")).filter("generic_name <> ''").select(F.concat(F.lit("legacy:"), T.slug("generic_name")).alias("external_id"), "generic_name", F.lit(None).cast("string").alias("brand_name"), F.array().cast("array<string>").alias("aliases"), F.lit("legacy_manual").alias("source"), F.lit(UNCLASSIFIED).alias("source_version"))


NAME_COLUMNS = ("generic_name", "brand_name", "aliases", "source_version")


class NameList:
    """A text file of names, one a line; its path is a parameter."""

    source, supplied = "legacy_manual", NAME_COLUMNS

    def __init__(self, path: str):
        self.path = path

    def is_configured(self) -> bool:
        return bool(self.path)

    def records(self, spark: SparkSession) -> DataFrame:
        return names_from(spark.read.text(self.path))


class CuratedBrands:
    """The curated brands: strengths are parsed, except those of combinations, which have components."""

    source = "legacy_manual"
    supplied = ("brand_name", "generic_name", "aliases", "strength", "strength_value", "strength_unit", "dosage_form", "combination_components", "source_version")

    def is_configured(self) -> bool:
        return True

    def records(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame(BRANDS, f"brand_name string, generic_name string, aliases array<string>, strength string, dosage_form string, combination_components {COMPONENTS}")
        one = F.when((F.size("combination_components") == 0) & (F.size("_s.components") == 1), F.get("_s.components", F.lit(0)))
        rows = rows.withColumn("_s", T.strength("strength"))
        return rows.select(F.concat(F.lit("legacy:"), T.slug("brand_name")).alias("external_id"), "brand_name", "generic_name", "aliases", "strength", one["value"].cast("decimal(10,3)").alias("strength_value"), one["unit"].alias("strength_unit"), "dosage_form", "combination_components", F.lit("legacy_manual").alias("source"), F.lit("hand_curated_indian_brands_v1").alias("source_version"))


class LegacyManual:
    """Names and curated brands together."""

    source, supplied = "legacy_manual", tuple(dict.fromkeys(NAME_COLUMNS + CuratedBrands.supplied))

    def __init__(self, path: str):
        self.names = NameList(path)

    def is_configured(self) -> bool:
        return True

    def records(self, spark: SparkSession) -> DataFrame:
        return self.names.records(spark).unionByName(CuratedBrands().records(spark), allowMissingColumns=True)


def ingredients_from(concepts: DataFrame) -> DataFrame:
    """Concepts (rxcui, name, tty) -> records; those without id or name are left out."""
    good = concepts.filter("coalesce(rxcui, '') <> '' and coalesce(name, '') <> ''")
    return good.select(F.concat(F.lit("rxnorm:"), "rxcui").alias("external_id"), T.title(F.trim("name")).alias("generic_name"), "rxcui", F.create_map(F.lit("rxnorm_tty"), F.coalesce("tty", F.lit("IN"))).alias("codes"), F.lit("rxnorm").alias("source"))


class IngredientSnapshot:
    """A JSON snapshot of a terminology's ingredient concepts (minConceptGroup.minConcept)."""

    source, supplied = "rxnorm", ("generic_name", "rxcui", "codes")

    def __init__(self, path: str, enabled: bool = True):
        self.path, self.enabled = path, enabled

    def is_configured(self) -> bool:
        return self.enabled

    def records(self, spark: SparkSession) -> DataFrame:
        schema = "minConceptGroup struct<minConcept: array<struct<rxcui: string, name: string, tty: string>>>"
        return ingredients_from(spark.read.schema(schema).json(self.path, multiLine=True).select(F.explode("minConceptGroup.minConcept").alias("c")).select("c.*"))


class IngredientService:
    """A terminology's service that answers with all its ingredient concepts; fetched when the records are read."""

    source, supplied = IngredientSnapshot.source, IngredientSnapshot.supplied

    def __init__(self, base_url: str, timeout: float = 20.0):
        self.base_url, self.timeout = base_url, timeout

    def is_configured(self) -> bool:
        return bool(self.base_url)

    def records(self, spark: SparkSession) -> DataFrame:
        register(spark)
        return ingredients_from(spark.read.format("concepts").option("urls", f"{self.base_url.rstrip('/')}/allconcepts.json?tty=IN").option("timeout", str(self.timeout)).load())


class LicensedDataset:
    """A dataset under a licence that isn't there yet."""

    source, supplied = "licensed_india", ()

    def is_configured(self) -> bool:
        return False

    def records(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError("no licensed dataset is available")


class NationalRegistry(LicensedDataset):
    """A national drug registry, whose interface isn't public yet."""

    source = "abdm"

    def records(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError("the registry has no public interface")


def sync(provider: Provider, catalog: DataFrame) -> tuple[DataFrame, int]:
    """The catalog after a provider's records came in, and their number; as it was, and 0, if the provider isn't
    configured or its records can't be read. They are read once, into a table that both answers use."""
    if not provider.is_configured():
        return catalog, 0
    try:
        records = staged(provider.records(catalog.sparkSession).withColumn("_order", F.monotonically_increasing_id()), "records")
    except (PySparkException, Py4JError, OSError) as why:
        logging.getLogger(__name__).warning("no records from %s: %s", provider.source, why)
        return catalog, 0
    return upsert(catalog, records, provider.supplied, order="_order"), records.count()


def page_files(spark: SparkSession, path: str, most_bytes: int = 15 * 1024 * 1024) -> DataFrame:
    """Binary files with their type, by suffix, and why one is ``rejected``: its type or its size; null if it is taken."""
    kind = F.element_at(F.split(F.lower("path"), r"\."), -1)
    types = {"jpeg": "image/jpeg", "jpg": "image/jpeg", "png": "image/png", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "pdf": "application/pdf"}
    files = spark.read.format("binaryFile").load(path).withColumn("content_type", T.lookup(kind, types))
    known = F.coalesce(F.col("content_type").isin(*CONTENT_TYPES), F.lit(False))
    return files.withColumn("rejected", F.when(~known, "type").when(F.col("length") > most_bytes, "size"))
