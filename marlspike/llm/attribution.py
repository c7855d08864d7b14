"""Token counts by field or section: whole documents are encoded once, and tokens go to sections by their spans.

With a byte-level vocabulary the tokens of a text spell its bytes, so a token's span is where the
running length of the tokens before it ends; characters follow from the bytes that begin one.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import encoder

RULES = ("start", "majority")


@lru_cache(maxsize=2)
def _byte_lengths(path: str) -> np.ndarray:
    """Bytes that each id stands for: a byte-level vocabulary writes one character for each."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec.get("added_tokens", [])}
    out = np.zeros(max(names) + 1, np.int64)
    for i, t in names.items():
        out[i] = len(t)
    return out


def attribute(text: str, ids: np.ndarray, lengths: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross a boundary). bounds: where sections begin, in characters,
    and the text's end; sections adjoin. A token that holds part of a character counts as holding it.
    Rule "start": a crossing token goes to the section of its first character. "majority": to the section
    with most of its characters, the earlier one if equal."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    stop = np.cumsum(lengths[ids])
    if len(ids) and stop[-1] != len(raw):
        raise ValueError("the vocabulary doesn't spell the text's bytes")
    begins = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and with each byte
    first = begins[stop - lengths[ids]] - 1 if len(ids) else np.zeros(0, np.int64)
    end = begins[stop - 1] if len(ids) else first
    a = np.searchsorted(bounds, first, side="right") - 1
    b = np.searchsorted(bounds, end - 1, side="right") - 1
    cross = np.flatnonzero(a != b)
    if rule == "majority":
        for k in cross:
            edges = np.clip(bounds[a[k] : b[k] + 2], first[k], end[k])
            a[k] += int(np.argmax(np.diff(edges)))
    return np.bincount(a, minlength=len(bounds) - 1), len(cross)


def section_tokens(docs: DataFrame, path: str, rule: str = "majority", separator: str = "\n", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token counts of every section of every document: doc_id, section (from 0), chars_from, chars_to,
    n_tokens. A section ends with the separator or the text; sections without characters don't count.

    Null and empty texts have one section, 0 to 0, without tokens. Repeated rows give repeated results.
    No documents: no rows. Extra columns of docs are not read. The counts of a document add up to its
    tokens, each counted once.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches):
        tokens, lengths = encoder(path), _byte_lengths(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = [x or "" for x in some.column(1).to_pylist()]
                ids, n = tokens.encode(texts)
                doc, section, begin, end, count = [], [], [], [], []
                for k, own in enumerate(np.split(ids, np.cumsum(n)[:-1])):
                    x = texts[k]
                    sizes = [len(s) + len(separator) for s in x.split(separator)]
                    sizes[-1] -= len(separator)
                    bounds = np.concatenate([[0], np.cumsum([s for s in sizes if s] or [0])])
                    got, _ = attribute(x, own, lengths, bounds, rule)
                    doc += [k] * len(got)
                    section.append(np.arange(len(got), dtype=np.int32))
                    begin.append(bounds[:-1])
                    end.append(bounds[1:])
                    count.append(got)
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()).take(pa.array(doc, pa.int64())), pa.array(np.concatenate(section)), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (begin, end, count))], names=["doc_id", "section", "chars_from", "chars_to", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, section int, chars_from long, chars_to long, n_tokens long")
