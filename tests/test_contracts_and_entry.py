from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from marlspike.operators import catalog as C
from marlspike.operators import contracts
from marlspike.streaming import catalog_feed

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_llm_contract(spark):
    one = {"prescribed_date": "x", "metadata": {"prescriber_name": "Dr. Dr Who", "patient_name": "P"}, "medications": [{"name": "A", "form": "tablet", "duration_text": "5 days", "duration_days": 9, "confidence": 0.876}, {"name": "B", "duration_text": "2 weeks", "duration_days": 14, "confidence": 1.0}]}
    texts = spark.createDataFrame([(1, json.dumps(one)), (2, "{}"), (3, "no json")], "k int, json string")
    parsed = contracts.llm_extraction(contracts.parse_llm(texts)).withColumn("info", contracts.patient_info(F.col("parsed.metadata")))
    got = {r["k"]: r for r in parsed.collect()}
    meds = got[1]["extraction"]["medications"]
    assert [(m["form"], m["durationDays"], m["confidence"]) for m in meds] == [("TABLET", 5, 0.876), (None, 14, 1.0)]
    assert got[2]["info"] == contracts.NO_PATIENT and "Dr. Dr. " not in got[1]["info"]
    assert [(r["name"], r["confidence"], r["dosage"]) for r in contracts.llm_rows(parsed, "k").orderBy("place").collect()] == [("A", 87.6, "N/A"), ("B", 100.0, "N/A")]


def test_feed_upserts_each_batch(spark, tmp_path):
    feed, root, schema = tmp_path / "feed", str(tmp_path / "catalog"), "external_id string, generic_name string, source string"
    feed.mkdir()
    for k, rows in enumerate(([("a", "One"), ("b", "Two")], [("a", "Uno")])):
        (feed / f"{k}.json").write_text("\n".join(json.dumps({"external_id": e, "generic_name": g, "source": "s"}) for e, g in rows))
        catalog_feed.follow(spark, str(feed), schema, root, str(tmp_path / "state"), ("generic_name",)).awaitTermination()
    got = catalog_feed.read_version(spark, root, 1).select("external_id", "generic_name").collect()
    assert sorted(map(tuple, got)) == [("a", "Uno"), ("b", "Two")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_every_query_has_columns_like_its_sql():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 20


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["strength_and_form", "instruction_fields", "name_variants", "catalog_build", "upsert_merge", "exact_lookup", "canonical_lookup", "trigram_topk", "generic_disambiguation", "row_banding", "section_split", "json_contract"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from marlspike.plans.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    own, other = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(own.columns) == sorted(other.columns)

    def plain(df):
        import pandas as pd

        text = lambda v: "~" if pd.isna(v) else f"{float(v):.6f}" if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else str(v)
        return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))

    assert plain(own) == plain(other)


def test_entry_imports_without_the_training_data_package(tmp_path):
    code = "import sys\nclass No:\n    def find_spec(self, name, path=None, target=None):\n        if name in ('corpus_pipeline', 'marlspike.llm'): raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nq = e.queries()\nassert 'resolve_batch' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_catalog_table_has_statistics(spark):
    catalog = C.derived(spark.createDataFrame([("1", "x", "s")], "external_id string, generic_name string, source string"))
    C.write_catalog(catalog.drop("created_at", "updated_at", "source_updated_at", "codes", "aliases", "combination_components"), "small_catalog")
    assert "1 rows" in spark.sql("DESCRIBE EXTENDED small_catalog").filter("col_name = 'Statistics'").first()["data_type"]


def test_a_failing_provider_leaves_the_catalog(spark, tmp_path):
    from marlspike.operators import catalog as C
    from marlspike.sources.providers import IngredientSnapshot, NameList, sync

    empty = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in C.SCHEMA.items()))
    catalog, n = sync(IngredientSnapshot(f"{tmp_path}/none.json"), empty)
    assert n == 0 and catalog.count() == 0
    (tmp_path / "names.txt").write_text("Dolo 650\n\nPan 40\n")
    catalog, n = sync(NameList(f"{tmp_path}/names.txt"), empty)
    assert n == 2 and catalog.count() == 2
    again, n = sync(IngredientSnapshot(f"{tmp_path}/none.json", enabled=False), catalog)
    assert n == 0 and again.count() == 2
    (tmp_path / "snapshot.json").write_text('{"minConceptGroup": {"minConcept": [{"rxcui": "1", "name": "folic acid", "tty": "IN"}, {"rxcui": "", "name": "x"}]}}')
    more, n = sync(IngredientSnapshot(f"{tmp_path}/snapshot.json"), catalog)
    assert n == 1 and {r["generic_name"] for r in more.collect()} == {"Dolo 650", "Pan 40", "Folic Acid"}


def test_files_say_why_they_are_rejected(spark, tmp_path):
    from marlspike.sources.providers import page_files

    for name, size in (("a.JPG", 10), ("b.txt", 10), ("c.pdf", 100), ("d", 3)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r["path"].rsplit("/", 1)[1]: r["rejected"] for r in page_files(spark, str(tmp_path), most_bytes=50).select("path", "rejected").collect()}
    assert got == {"a.JPG": None, "b.txt": "type", "c.pdf": "size", "d": "type"}


def test_sections_of_texts_are_those_of_their_lines(spark):
    from marlspike.operators import layout

    texts = [None, "", "  ", "Name\nage 5", "Name\nRx \nshop now\nDolo 5 mg", "SHOP NOW tab\nx\ntab Dolo", "one\n\nhorlicks", "a 5 mgx\nsyp"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    columns = ["doc_id", "line_no", "text", "section", "also_patient"]
    want = layout.sections(layout.text_lines(docs)).select(*columns).orderBy("doc_id", "line_no").collect()
    assert layout.text_sections(docs).select(*columns).orderBy("doc_id", "line_no").collect() == want and len({r["section"] for r in want}) == 3


def test_status_counts_and_rows_by_id(spark):
    from marlspike.operators import catalog as C
    from marlspike.operators import linkage

    rows = spark.createDataFrame([(1, "EXACT"), (1, "EXACT"), (1, "NO_MATCH"), (2, None)], "doc_id int, status string")
    assert sorted(map(tuple, linkage.status_counts(rows).collect()), key=str) == [(1, "EXACT", 2), (1, "NO_MATCH", 1), (2, None, 1)]
    catalog = C.derived(spark.createDataFrame([("x:1", "a", "s")], "external_id string, generic_name string, source string"))
    key = catalog.first()["id"]
    found = C.by_ids(spark.createDataFrame([(1, key), (2, "none"), (3, None)], "n int, key string"), catalog, "key").collect()
    assert [(r["n"], r["external_id"]) for r in found] == [(1, "x:1")] and C.by_id(catalog, key).count() == 1


def test_the_library_works_without_the_training_data_part(tmp_path):
    import os
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parents[1]
    shutil.copytree(root / "marlspike", tmp_path / "marlspike", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())), any(k.startswith('op') for k in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split()[1:] == ["[]", "False"] and int(said.stdout.split()[0]) > 25
