from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from marlspike.functions import text as T
from marlspike.operators import catalog as C
from marlspike.operators import contracts
from marlspike.sources import providers as P

CONCEPTS = [{"rxcui": "7", "name": "folic acid", "tty": "IN"}, {"rxcui": 8, "name": "zinc"}, {"rxcui": "9"}, {"name": "x"}]


@pytest.fixture
def service():
    """A service on this machine; its answer, by path, and the paths that were asked for."""
    asked, answer = [], {"body": json.dumps({"minConceptGroup": {"minConcept": CONCEPTS}})}

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(200 if answer["body"] is not None else 503)
            self.end_headers()
            self.wfile.write((answer["body"] or "").encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", answer, asked
    server.shutdown()


def test_ingredient_service(spark, service):
    url, answer, asked = service
    empty = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in C.SCHEMA.items()))
    catalog, n = P.sync(P.IngredientService(url + "/"), empty)
    rows = {r["rxcui"]: (r["generic_name"], r["codes"]) for r in catalog.collect()}
    assert n == 2 and rows == {"7": ("Folic Acid", {"rxnorm_tty": "IN"}), "8": ("Zinc", {"rxnorm_tty": "IN"})}
    assert set(asked) == {"/allconcepts.json?tty=IN"}
    for body, n in (('{"minConceptGroup": null}', 0), ("not JSON", 0), (None, 0)):
        answer["body"] = body
        after, got = P.sync(P.IngredientService(url), empty)
        assert got == n and after.count() == 0
    assert not P.IngredientService("").is_configured()


def test_health(spark):
    spark.createDataFrame([], "id string").write.mode("overwrite").saveAsTable("own_catalog")
    assert contracts.health(spark, "own_catalog", True) == {"status": "ok", "vision_api_configured": True, "database_connected": True}
    assert contracts.health(spark, "no_such_table") == {"status": "degraded", "vision_api_configured": False, "database_connected": False}


def test_strength_json(spark):
    texts = ["500 mg", "100mg/5ml", "500mg + 125mg", "none", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("s", T.strength("t"))
    got = [json.loads(r["j"]) for r in rows.select("k", T.strength_json(F.col("s")).alias("j")).orderBy("k").collect()]
    assert got == [
        {"strength": 500.0, "unit": "mg"},
        {"strength": 100.0, "unit": "mg", "per_value": 5.0, "per_unit": "ml"},
        {"components": [{"strength": 500.0, "unit": "mg"}, {"strength": 125.0, "unit": "mg"}]},
        {}, {},
    ]
    assert rows.select(T.strength_json(F.lit(None).cast(rows.schema["s"].dataType)).alias("j")).first()["j"] is None
