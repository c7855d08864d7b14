"""Words of scanned pages -> lines -> sections, as expressions over each document's words."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import AD_FRAGMENTS, SECTION_TRIGGERS, SECTION_WORDS

ROW_OVERLAP = 0.4
MIN_CONFIDENCE = 0.10


def clean_words(words: DataFrame) -> DataFrame:
    """Without empty words, single characters other than T and C, pure signs and unsure readings; confidence to 4 digits."""
    t = F.trim("text")
    keep = (t != "") & ((F.length(t) > 1) | F.upper(t).isin("T", "C")) & ~t.rlike(r"^[^\p{L}\p{N}_\s]+$") & (F.col("confidence") >= MIN_CONFIDENCE)
    return words.filter(keep).withColumns({"text": t, "confidence": F.round("confidence", 4)})


def _fold() -> Column:
    """Rows of words in (y, x) order: a word joins the row whose growing band it overlaps by enough."""
    word = "struct<y: int, x: int, text: string, confidence: double, width: int, height: int>"
    start = F.expr(f"named_struct('rows', cast(array() as array<array<{word}>>), 'row', cast(array() as array<{word}>), 'top', 0, 'bottom', 0)")

    def step(acc: Column, w: Column) -> Column:
        bottom = w["y"] + w["height"]
        height = F.least(F.greatest(w["height"], F.lit(1)), F.greatest(acc["bottom"] - acc["top"], F.lit(1)))
        overlap = F.greatest(F.lit(0), F.least(bottom, acc["bottom"]) - F.greatest(w["y"], acc["top"]))
        first = F.size(acc["row"]) == 0
        joins = first | (overlap >= height * ROW_OVERLAP)
        return F.struct(
            F.when(joins, acc["rows"]).otherwise(F.concat(acc["rows"], F.array(acc["row"]))).alias("rows"),
            F.when(joins, F.concat(acc["row"], F.array(w))).otherwise(F.array(w)).alias("row"),
            F.when(first | ~joins, w["y"]).otherwise(F.least(acc["top"], w["y"])).alias("top"),
            F.when(first | ~joins, bottom).otherwise(F.greatest(acc["bottom"], bottom)).alias("bottom"),
        )

    return F.aggregate("words", start, step, lambda acc: F.concat(acc["rows"], F.array(acc["row"])))


def lines_of_words(words: DataFrame, per_page: bool = False, doc: str = "doc_id") -> DataFrame:
    """(doc, [page,] line_no, text, x, y, width, height, confidence, min_confidence, words).

    Words (doc, [page,] text, confidence, x, y, width, height) of a document are pooled, pages and all,
    unless ``per_page``. A document's words must fit in a row; documents are independent.
    """
    key = [doc, "page"] if per_page else [doc]
    kinds = {"y": "int", "x": "int", "text": "string", "confidence": "double", "width": "int", "height": "int"}
    word = F.struct(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
    rows = words.groupBy(*key).agg(F.sort_array(F.collect_list(word)).alias("words")).select(*key, F.posexplode(_fold()).alias("line_no", "row"))
    by_x = F.array_sort("row", lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0))
    x = rows.withColumn("row", by_x)
    low = lambda k: F.array_min(F.transform("row", lambda w: w[k]))
    high = lambda k, n: F.array_max(F.transform("row", lambda w: w[k] + w[n]))
    mean = F.aggregate("row", F.lit(0.0), lambda a, w: a + w["confidence"]) / F.size("row")
    return x.select(*key, "line_no", F.array_join(F.transform("row", lambda w: w["text"]), " ").alias("text"), low("x").alias("x"), low("y").alias("y"), (high("x", "width") - low("x")).alias("width"), (high("y", "height") - low("y")).alias("height"), mean.alias("confidence"), low("confidence").alias("min_confidence"), F.transform("row", lambda w: F.struct(w["text"].alias("text"), w["confidence"].alias("confidence"), w["x"].alias("x"), w["y"].alias("y"), w["width"].alias("width"), w["height"].alias("height"))).alias("words"))


def _holds_any(text: Column, parts: list[str]) -> Column:
    return reduce(operator.or_, [F.contains(text, F.lit(p)) for p in parts])


def is_ad(text: Column | str) -> Column:
    return _holds_any(F.lower(text), AD_FRAGMENTS)


def opens_section(text: Column | str) -> Column:
    return _opens(F.lower(text))


def _opens(low: Column) -> Column:
    edge, end = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    # plain searches decide most lines; what they leave goes to the patterns
    word = _holds_any(low, SECTION_WORDS) & low.rlike(rf"{edge}(?:{'|'.join(SECTION_WORDS)}){end}")
    amount = _holds_any(low, ["mg", "ml", "mcg"]) & low.rlike(rf"{edge}[0-9]+\s*(?:mg|ml|mcg){end}")
    return _holds_any(low, SECTION_TRIGGERS) | word | amount


def sections(lines: DataFrame, doc: str = "doc_id", line_no: str = "line_no", text: str = "text") -> DataFrame:
    """lines with ``section``: patient before the first line that opens the medicine section, medicine from it on,
    ad for advertisements. Where none opens it, every line is medicine, advertisements too; patient lines
    then count on both sides, as ``also_patient`` says."""
    w = Window.partitionBy(doc).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(doc)
    x = lines.withColumn("_ad", is_ad(text))
    x = x.withColumn("_in", F.max((~F.col("_ad") & opens_section(text)).cast("int")).over(w) == 1).withColumn("_any", F.max(F.col("_in").cast("int")).over(whole) == 1)
    section = F.when(~F.col("_any"), "medicine").when(F.col("_ad"), "ad").when(F.col("_in"), "medicine").otherwise("patient")
    return x.withColumn("section", section).withColumn("also_patient", ~F.col("_any") & ~F.col("_ad")).drop("_ad", "_in", "_any")


def text_sections(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, text, section, also_patient) of the lines of plain texts: sections() of text_lines(), but a
    document's lines are judged where its row is, so nothing is shuffled. Blank texts have none."""
    def mark(line: Column, low: Column) -> Column:
        return F.struct(line.alias("text"), _holds_any(low, AD_FRAGMENTS).alias("ad"), _opens(low).alias("opens"))

    marked = F.zip_with(F.split(text, "\n"), F.transform(F.split(text, "\n"), F.lower), mark)  # each line lowered once
    rows = docs.filter(F.length(F.trim(text)) > 0).select(doc, marked.alias("_lines"))
    rows = rows.withColumn("_first", F.array_position(F.transform("_lines", lambda x: x["opens"] & ~x["ad"]), True))
    # outer, though no document is without lines: else the planner computes the lines once more to filter by their number
    x = rows.select(doc, "_first", F.posexplode_outer("_lines").alias("line_no", "_line"))
    any_, ad = F.col("_first") > 0, F.col("_line.ad")
    section = F.when(~any_, "medicine").when(ad, "ad").when(F.col("line_no") + 1 >= F.col("_first"), "medicine").otherwise("patient")
    return x.select(doc, "line_no", F.col("_line.text").alias("text"), section.alias("section"), (~any_ & ~ad).alias("also_patient"))


def page_texts(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, patient_info, medicine_text, full_text, word_count) of lines with sections."""
    def joined(keep: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("line_no", "text")))), lambda s: s["text"]), "\n")

    return lines.groupBy(doc).agg(joined((F.col("section") == "patient") | F.col("also_patient")).alias("patient_info"), joined(F.col("section") == "medicine").alias("medicine_text"), joined(F.lit(True)).alias("full_text"), F.sum(F.size("words")).alias("word_count"))


def text_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, text, confidence): the lines of plain texts; blank texts have none."""
    return docs.filter(F.length(F.trim(text)) > 0).select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "text"), F.lit(None).cast("double").alias("confidence"))
