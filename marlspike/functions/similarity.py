"""String similarity: trigram sets as column expressions, edit ratios as a vectorised UDF over distinct pairs."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def trigrams(x: Column) -> Column:
    """Distinct trigrams of the words of x (letters and digits), each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_codes(x: Column) -> Column:
    """The trigrams of x as numbers: their three code points of 21 bits each, so no two meet."""
    def code(g: Column) -> Column:
        point = lambda i: F.ascii(F.substring(g, i, 1)).cast("long")
        return F.shiftleft(point(1), 42).bitwiseOR(F.shiftleft(point(2), 21)).bitwiseOR(point(3))

    return F.transform(trigrams(x), code)


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(both / F.nullif(F.size(x) + F.size(y) - both, F.lit(0)), F.lit(0.0))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & masks.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    """Indel similarity, 0 to 100."""
    total = len(a) + len(b)
    return 200.0 * common_length(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a part of the longer that is as long, or cut off at an end."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def _tokens(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def _sorted(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, only_a, only_b = _tokens(a, b)
    if both and (not only_a or not only_b):
        return 100.0
    n, gap = len(both), bool(both)
    full_a, full_b = n + gap + len(only_a), n + gap + len(only_b)
    apart = len(only_a) + len(only_b) - 2 * common_length(only_a, only_b)
    best = 100.0 - 100.0 * apart / (full_a + full_b)
    if both:
        best = max(best, 100.0 - 100.0 * (full_a - n) / (n + full_a), 100.0 - 100.0 * (full_b - n) / (n + full_b))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, only_a, only_b = _tokens(a, b)
    return 100.0 if both else max(partial_ratio(_sorted(a), _sorted(b)), partial_ratio(only_a, only_b))


def weighted_ratio(a: str, b: str) -> float:
    """The best of whole, token and partial ratios, the latter scaled down as lengths differ."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if lengths < 1.5:
        return max(best, 0.95 * max(ratio(_sorted(a), _sorted(b)), token_set_ratio(a, b)))
    scale = 0.9 if lengths <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


@lru_cache(maxsize=200_000)
def name_score(term: str, name: str) -> float:
    """How well a term fits a name, 0 to 100: the better ratio, less 4 for each character of a length gap of
    three or more, plus 10 for a like beginning where that leaves 70 or more."""
    score = max(weighted_ratio(term, name), token_set_ratio(term, name))
    gap = abs(len(term) - len(name))
    if gap >= 3:
        score -= 4 * gap
    n = min(4, len(term), len(name))
    if n and term[:n] == name[:n] and score >= 70:
        score = min(100.0, score + 10)
    return max(0.0, min(100.0, score))


@F.pandas_udf(DoubleType())
def name_scores(term: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([None if n is None or t is None else name_score(t, n) for t, n in zip(term, name, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def python_round(x: pd.Series) -> pd.Series:
    """To one decimal by the exact binary value, as thresholds compare it."""
    return x.map(lambda v: round(v, 1), na_action="ignore")
