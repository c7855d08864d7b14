"""A data source of a terminology's ingredient concepts: ``spark.read.format("concepts")``.

Each address of the option ``urls`` (white space between them) is a partition, fetched by the task that reads it and
again if that task is lost. A failing or malformed answer fails the task; sync() then leaves the catalog as it is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..workers import prepare


class Address(InputPartition):
    def __init__(self, url: str):
        self.url = url


class ConceptReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = options.get("urls", "").split()
        self.timeout = float(options.get("timeout", "20"))

    def partitions(self) -> list[Address]:
        return [Address(u) for u in self.urls]

    def read(self, partition: Address) -> Iterator[tuple]:
        with urlopen(partition.url, timeout=self.timeout) as answer:
            group = (json.load(answer) or {}).get("minConceptGroup") or {}
        for c in group.get("minConcept") or []:
            yield tuple(None if c.get(k) is None else str(c[k]) for k in ("rxcui", "name", "tty"))


class Concepts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "concepts"

    def schema(self) -> str:
        return "rxcui string, name string, tty string"

    def reader(self, schema) -> ConceptReader:
        return ConceptReader(self.options)


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.dataSource.register(Concepts)
