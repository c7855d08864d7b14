"""Names and their instructions from the lines of documents.

All spans of all lines are resolved at once, each distinct phrase a single time; what is left for each
document is a short walk over its own lines in order, which picks spans and carries fields from line
to line.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as T
from ..workers import staged
from .linkage import resolve

MAX_SPAN = 3
LOOKAHEAD = 2
FIELDS = ("dosage", "frequency", "duration", "strength_text")
_CONFLICTS = ("EXACT_ALIAS", "EXACT_BRAND", "EXACT_CATALOG_NAME")


def spans(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, line_no, start, length, phrase): every run of one to three tokens of a line that doesn't begin with noise."""
    x = lines.withColumn("tokens", T.tokenize("text")).filter(F.length(F.array_join("tokens", " ")) >= 3)
    x = x.select(doc, "line_no", "tokens", F.posexplode("tokens").alias("start", "token")).filter(~T.is_noise("token"))
    x = x.withColumn("length", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_SPAN), F.size("tokens") - F.col("start")))))
    phrase = F.trim(F.array_join(F.transform(F.slice("tokens", F.col("start") + 1, F.col("length")), T.clean_word), " "))
    return x.select(doc, "line_no", "start", "length", phrase.alias("phrase")).filter("phrase <> ''")


def pick_spans(found: list[dict]) -> list[dict]:
    """Of a line's spans, left to right: the longest that is accepted; one that conflicts is skipped whole."""
    by_start: dict[int, list[dict]] = {}
    for s in found:
        by_start.setdefault(s["start"], []).append(s)
    out, at = [], 0
    for start in sorted(by_start):
        if start < at:
            continue
        for s in sorted(by_start[start], key=lambda s: -s["length"]):
            if s["matched"]:
                out.append(s)
            if s["matched"] or s["conflict"]:
                at = start + s["length"]
                break
    return out


def _walk(dedupe: str):
    """A document's lines, in order, to its rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        results: list[dict] = []
        seen: set[str] = set()
        waiting, left = None, 0
        for line in pdf.sort_values("line_no").to_dict("records"):
            picked = pick_spans(list(line["spans"]))
            if not picked:
                if waiting is not None and left > 0 and line["noise"]:
                    for field in FIELDS:
                        if waiting[field] == T.MISSING:
                            waiting[field] = line[f"line_{field}"]
                    left -= 1
                else:
                    waiting, left = None, 0
                continue
            for k, s in enumerate(picked):
                names = [s["name"].lower()] if s["name"] else []
                if not names:
                    continue
                first = (s["generic_name"] or s["name"]).split()
                if dedupe == "root" and first:
                    names.append(first[0].lower())
                if any(n in seen for n in names):
                    continue
                seen.update(names)
                to = picked[k + 1]["start"] if k + 1 < len(picked) else len(line["tokens"])
                results.append({"line_no": line["line_no"], "raw_line": line["raw_line"], "id": s["id"], "confidence": s["confidence"], "match_type": s["match_type"], "ocr_confidence": line["confidence"], "own": " ".join(line["tokens"][s["start"] : s["start"] + s["length"]]), "window": " ".join(line["tokens"][s["start"] + s["length"] : to]), "fields": s["fields"]})
                results[-1].update({f: s["fields"][to][f] for f in FIELDS})
            waiting, left = None, 0
            if results and all(results[-1][f] == T.MISSING for f in FIELDS[:3]):
                waiting, left = results[-1], LOOKAHEAD
        columns = ["line_no", "raw_line", "id", "confidence", "match_type", "ocr_confidence", *FIELDS]
        out = pd.DataFrame(results, columns=[*columns, "own", "window", "fields"])[columns]
        out.insert(0, "doc", pdf["doc"].iloc[0])
        out.insert(1, "place", range(len(out)))
        return out

    return run


def extract(lines: DataFrame, catalog: DataFrame, settings: Settings = DEFAULTS, dedupe: str = "root", doc: str = "doc_id") -> DataFrame:
    """One row for each product named in a document, in order, with its instructions.

    lines: (doc, line_no, text, confidence). Fields come from between a name and the next on its line; a
    product with none of dosage, frequency and duration gets them from up to two following lines that
    hold nothing but instructions. A document names a product once, and with ``dedupe="root"`` once
    for each first word of its generic name; "name" goes by the name alone.
    """
    if dedupe not in ("root", "name"):
        raise ValueError("dedupe is root or name")
    every = staged(spans(lines, doc), "spans")
    catalog = staged(catalog, "catalog")
    phrases = resolve(every.select("phrase").distinct(), catalog, settings, text="phrase")
    top = F.get("candidates", F.lit(0))
    conflict = (F.col("status") == "REVIEW_REQUIRED") & (F.size("parsed_strength.components") > 0) & top["match_type"].isin(*_CONFLICTS)
    answers = phrases.select("phrase", F.col("matched_id").alias("id"), "confidence", "match_type", F.coalesce(conflict, F.lit(False)).alias("conflict")).filter("id is not null or conflict")
    med = catalog.select("id", F.coalesce(F.nullif("brand_name", F.lit("")), F.nullif("generic_name", F.lit("")), F.get("aliases", F.lit(0))).alias("name"), "generic_name")
    hits = every.join(answers, "phrase").join(med, "id", "left")
    # each span's fields for every place where its window may end: where another span of its line begins, or the line ends
    line = lines.select(F.col(doc).alias("doc"), "line_no", F.col("text").alias("raw"), "confidence", T.tokenize("text").alias("tokens")).filter(F.length(F.array_join("tokens", " ")) >= 3)
    hit = hits.select(F.col(doc).alias("doc"), "line_no", "start", "length", "id", F.col("confidence").alias("score"), "match_type", "conflict", "name", "generic_name")
    starts = F.filter(F.collect_set("start").over(Window.partitionBy("doc", "line_no")), lambda s: s >= F.col("start") + F.col("length"))
    ends = F.array_distinct(F.concat(starts, F.array(F.size("tokens"))))

    def fields(to):
        window = F.array_join(F.slice("tokens", F.col("start") + F.col("length") + 1, to - F.col("start") - F.col("length")), " ")
        own = F.trim(F.concat_ws(" ", F.array_join(F.slice("tokens", F.col("start") + 1, F.col("length")), " "), window))
        return F.struct(T.dosage(window).alias("dosage"), T.frequency(window).alias("frequency"), T.duration(window).alias("duration"), T.strength_text(own).alias("strength_text"))

    full = hit.join(line, ["doc", "line_no"]).withColumn("ends", ends).withColumn("fields", F.map_from_arrays("ends", F.transform("ends", fields)))
    span = F.struct("start", "length", "id", F.col("score").alias("confidence"), "match_type", F.col("id").isNotNull().alias("matched"), "conflict", "name", "generic_name", "fields")
    found = full.groupBy("doc", "line_no").agg(F.collect_list(span).alias("spans"))
    with_lines = line.join(found, ["doc", "line_no"], "left")
    empty = F.array().cast(found.schema["spans"].dataType)
    noise = F.forall("tokens", T.is_noise)
    walk = with_lines.select("doc", "line_no", F.trim("raw").alias("raw_line"), "confidence", "tokens", F.coalesce("spans", empty).alias("spans"), noise.alias("noise"), T.dosage("raw").alias("line_dosage"), T.frequency("raw").alias("line_frequency"), T.duration("raw").alias("line_duration"), T.strength_text("raw").alias("line_strength_text"))
    kind = dict(lines.dtypes)[doc]
    rows = walk.groupBy("doc").applyInPandas(_walk(dedupe), f"doc {kind}, place int, line_no int, raw_line string, id string, confidence double, match_type string, ocr_confidence double, dosage string, frequency string, duration string, strength_text string")
    names = catalog.select("id", "generic_name", "brand_name", F.coalesce(F.nullif("brand_name", F.lit("")), F.nullif("generic_name", F.lit("")), F.get("aliases", F.lit(0))).alias("name"), "strength", "dosage_form", "route", "manufacturer", "source")
    return rows.withColumnRenamed("doc", doc).join(names, "id").withColumn("overall_confidence", T.fuse_confidence("confidence", "ocr_confidence"))
