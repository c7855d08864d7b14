"""Text and field parsers as expressions of columns: no Python runs on a row.

Words, digits and boundaries are spelled out as character classes, since regex dialects differ on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import CHARACTER_CONFUSIONS, FORMS, FREQUENCIES, MEAL_PHRASES, OPTICAL_PAIRS, STOPWORDS, UNITS

SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
W = r"[\p{L}\p{N}_]"
#: A word boundary before and after something that begins and ends with a word character.
B, E = rf"(?<!{W})", rf"(?!{W})"
MISSING = "N/A"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _alternatives(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def lookup(x: Column, table: dict[str, str]) -> Column:
    """table[x], null where it has no such key."""
    return F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x)


def squeezed(x: Column | str) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(x), SPACE + "+", " "))


def lookup_key(x: Column | str) -> Column:
    """A term as exact lookups compare it: lower case and squeezed; hyphens and signs stay."""
    return squeezed(F.lower(_col(x)))


def split_alnum(x: Column | str) -> Column:
    """A blank between letters and two or more digits that make up a whole token."""
    return F.array_join(F.transform(F.split(squeezed(x), " "), lambda t: F.regexp_replace(t, r"^([a-zA-Z]+)([0-9]{2,})$", "$1 $2")), " ")


def normalize(x: Column | str) -> Column:
    """Lower case; hyphens and signs other than + and / as blanks; split_alnum; null as ''."""
    t = F.replace(F.lower(F.coalesce(_col(x), F.lit(""))), F.lit("-"), F.lit(" "))
    return split_alnum(F.regexp_replace(t, r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}+/]", " "))


def slug(x: Column | str) -> Column:
    t = F.regexp_replace(F.lower(F.trim(_col(x))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(t, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def title(x: Column | str) -> Column:
    """Every run of letters begins with a capital and goes on in lower case."""
    runs = F.regexp_extract_all(F.lower(_col(x)), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))), "")


# ---------------------------------------------------------------- strengths

_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
_UNIT = f"(?:{_alternatives(u for u in UNITS if u != '%')}|%)"
_ENDED = rf"((?:{_alternatives(u for u in UNITS if u != '%')}){E}|%(?={W}))"
SINGLE = rf"(?i){_NUMBER}\s*{_ENDED}"
PER_VOLUME = rf"(?i){_NUMBER}\s*({_UNIT})\s*/\s*{_NUMBER}\s*{_ENDED}"
_COMPONENT = "struct<value: decimal(18,6), unit: string>"
_STRENGTH = f"struct<components: array<{_COMPONENT}>, per_value: decimal(18,6), per_unit: string>"


def _number(x: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit("")).cast("decimal(18,6)")


def _unit(x: Column, pattern: str, group: int) -> Column:
    return lookup(F.lower(F.regexp_extract(x, pattern, group)), UNITS)


def _component(x: Column) -> Column:
    per = F.struct(_number(x, PER_VOLUME, 1).alias("value"), _unit(x, PER_VOLUME, 2).alias("unit"))
    one = F.struct(_number(x, SINGLE, 1).alias("value"), _unit(x, SINGLE, 2).alias("unit"))
    return F.when(x.rlike(PER_VOLUME), per).when(x.rlike(SINGLE), one)


def strength(x: Column | str) -> Column:
    """struct(components, per_value, per_unit): two or more sides of a '+', else a number per volume, else a
    number and unit, else no components."""
    t = F.coalesce(_col(x), F.lit(""))
    sides = F.filter(F.transform(F.split(t, r"\+"), lambda p: _component(F.trim(p))), lambda c: c.isNotNull())
    many = F.contains(t, F.lit("+")) & (F.size(sides) >= 2)
    one = _component(t)
    per = ~many & t.rlike(PER_VOLUME)
    components = F.when(many, sides).when(one.isNotNull(), F.array(one)).otherwise(F.array())
    return F.struct(components.cast(f"array<{_COMPONENT}>").alias("components"), F.when(per, _number(t, PER_VOLUME, 3)).alias("per_value"), F.when(per, _unit(t, PER_VOLUME, 4)).alias("per_unit")).cast(_STRENGTH)


def strength_json(s: Column) -> Column:
    """A strength() as JSON: several components as a list, one as strength and unit, with per_value and per_unit
    where it has them; {} for none, null for null."""
    parts = F.transform(s["components"], lambda c: F.struct(c["value"].cast("double").alias("strength"), c["unit"].alias("unit")))
    one = F.get(parts, F.lit(0))
    single = F.struct(one["strength"].alias("strength"), one["unit"].alias("unit"), s["per_value"].cast("double").alias("per_value"), F.when(s["per_value"].isNotNull(), s["per_unit"]).alias("per_unit"))
    return F.when(F.size(parts) > 1, F.to_json(F.struct(parts.alias("components")))).when(F.size(parts) == 1, F.to_json(single)).when(s.isNotNull(), "{}")


def strip_strength(x: Column | str) -> Column:
    """Without numbers that have a unit; bare numbers stay."""
    return squeezed(F.regexp_replace(F.regexp_replace(_col(x), PER_VOLUME, " "), SINGLE, " "))


# ---------------------------------------------------------------- forms

def dosage_form(x: Column | str) -> Column:
    """The form of the first word that names one, else null."""
    found = F.transform(F.regexp_extract_all(F.lower(F.coalesce(_col(x), F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: lookup(w, FORMS))
    return F.get(F.filter(found, lambda f: f.isNotNull()), F.lit(0))


def strip_form(x: Column | str) -> Column:
    return squeezed(F.regexp_replace(_col(x), rf"(?i){B}(?:{_alternatives(FORMS)}){E}", " "))


def forms_compatible(a: Column | str, b: Column | str) -> Column:
    """True where either is unknown, else whether they are the same."""
    a, b = (F.coalesce(_col(x), F.lit("")) for x in (a, b))
    return (a == "") | (b == "") | (a == b)


# ---------------------------------------------------------------- variants

def _replaced(x: Column, old: str, new: str) -> Column:
    """One variant for each place of old."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: x.substr(i, F.lit(len(old))) == old)
    return F.transform(places, lambda i: F.concat(x.substr(F.lit(1), i - 1), F.lit(new), x.substr(i + len(old), F.length(x))))


def optical_variants(x: Column | str) -> Column:
    """The text, then one variant for each occurrence of each confusable shape, by pair and place."""
    x = _col(x)
    return F.concat(F.array(x), *[_replaced(x, old, new) for old, new in OPTICAL_PAIRS])


def character_variants(x: Column | str) -> Column:
    """The text, then one variant for each confusable character and reading of it, by place."""
    x = _col(x)
    confusions = F.create_map(*[v for k, to in CHARACTER_CONFUSIONS.items() for v in (F.lit(k), F.array(*map(F.lit, to)))])
    at = F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)))
    made = F.transform(at, lambda i: F.transform(F.coalesce(F.element_at(confusions, x.substr(i, F.lit(1))), F.array().cast("array<string>")), lambda r: F.concat(x.substr(F.lit(1), i - 1), r, x.substr(i + 1, F.length(x)))))
    return F.concat(F.array(x), F.flatten(made))


# ---------------------------------------------------------------- tokens of a line

def tokenize(x: Column | str) -> Column:
    """Tokens of a line; a blank line has none."""
    t = squeezed(F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"[^A-Za-z0-9\s/\-().]", " "))
    return F.filter(F.split(t, " "), lambda w: w != "")


def clean_word(x: Column | str) -> Column:
    t = F.regexp_replace(_col(x), rf"(?i)['’]s{E}", "")
    return F.trim(F.regexp_replace(t, r"[^A-Za-z0-9\s\-]", ""))


def letters(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(_col(x), "[^a-zA-Z]", ""))


# The shapes of schedules and durations, from here on and in the field parsers below.
_FRACTIONS = r"([0-9]/[0-9]|[0-9])\s*-\s*([0-9]/[0-9]|[0-9])\s*-\s*([0-9]/[0-9]|[0-9])"
_TRIAD = r"([0-9]|-)\s*[-/]\s*([0-9]|-)\s*[-/]\s*([0-9]|-)"
#: A boundary on either side of a digit or a hyphen: word characters differ across it.
_EDGE = rf"(?:(?<!{W})(?={W})|(?<={W})(?!{W}))"
_DURATION = rf"(?i){B}[0-9]+\s?(?:day|days|week|weeks|month|months){E}"


def is_noise(x: Column | str) -> Column:
    """A token that can't begin a name: empty, a stopword, a number, a frequency, a duration or a form."""
    def noise(w: Column) -> Column:
        schedule = w.rlike(rf"^{_EDGE}{_TRIAD}{_EDGE}$") | w.rlike(rf"^{_EDGE}{_FRACTIONS}{_EDGE}$")
        number = w.rlike(r"^[0-9]+(?:\.[0-9]+)?$") | w.rlike(r"(?i)^[0-9]+\s?(?:day|days|week|weeks|month|months)$")
        form = F.lower(w).rlike(rf"(?<![a-z])(?:{_alternatives(FORMS)})(?![a-z])")
        return (w == "") | letters(w).isin(*STOPWORDS) | F.upper(w).isin(*FREQUENCIES) | (F.contains(w, F.lit("-")) & schedule) | (w.rlike("^[0-9]") & number) | form

    return F.exists(F.array(clean_word(x)), noise)  # the word is cleaned once


# ---------------------------------------------------------------- instruction fields

def _first(x: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.trim(F.regexp_extract(x, pattern, group)), F.lit(""))


def strength_text(x: Column | str) -> Column:
    """The first thing shaped like a strength: number and unit, number in brackets, ratio, release form."""
    x = _col(x)
    number = _first(x, rf"(?i)[0-9]{{1,4}}(?:\.[0-9]+)?\s?(?:mg|ml|mcg|iu|gm?){E}")
    bracket = _first(x, r"(?i)[(\[]\s*([0-9]{1,4})\s*(?:mg|ml)?[)\]]", 1)
    ratio = _first(x, r"\(?\s*[0-9]+(?:\.[0-9]+)?\s*/\s*[0-9]+(?:\.[0-9]+)?\s*\)?")
    release = _first(x, rf"(?i){B}(?:CD3|D3|Plus|NXT|SR|XL|Forte){E}")
    return F.coalesce(number, F.concat(bracket, F.lit("mg")), ratio, release, F.lit(MISSING))


def dosage(x: Column | str) -> Column:
    """An amount per dose; totals to dispense don't count."""
    t = F.regexp_replace(_col(x), r"(?i)\(?\s*tot(?:al)?\s*[:.]?\s*[0-9]+\s*[\p{L}\p{N}_]*\)?", " ")
    amount = rf"(?i){B}(?:[0-9]+/[0-9]+|[0-9]+(?:\.[0-9]+)?|half|one|two|three)\s*-?\s*(?:tablets?|tabs?|capsules?|caps?|drops?|puffs?|spoons?|tsp|teaspoons?){E}"
    return F.coalesce(_first(t, amount), F.lit(MISSING))


def duration(x: Column | str) -> Column:
    return F.coalesce(_first(_col(x), _DURATION), F.lit(MISSING))


def frequency(x: Column | str) -> Column:
    """How often: abbreviations in their order, triads, times of day, clock times, then meals, then d-d."""
    x = _col(x)
    upper = F.upper(x)
    plain = [F.when(upper.rlike(rf"{B}{k}{E}"), F.lit(v)) for k, v in FREQUENCIES.items() if k not in MEAL_PHRASES]
    meals = [F.when(upper.rlike(rf"{B}{k}{E}"), F.lit(FREQUENCIES[k])) for k in MEAL_PHRASES]
    fractions = rf"{B}{_FRACTIONS}{E}"
    triad = rf"{_EDGE}{_TRIAD}{_EDGE}"
    optical = rf"(?i){B}([01tli])\s*[-/]\s*([01tlio])\s*[-/]\s*([01tlio]){E}"

    def digit(k: int) -> Column:
        return F.when(F.lower(F.regexp_extract(x, optical, k)).isin("1", "t", "l", "i"), "1").otherwise("0")

    tail = F.lit(" (M-A-N)")
    morning = x.rlike(rf"(?i){B}morning{E}")
    night = x.rlike(rf"(?i){B}(?:night|bedtime){E}")
    evening = x.rlike(rf"(?i){B}(?:evening|ep){E}")
    return F.coalesce(
        *plain,
        F.when(x.rlike(fractions), F.concat(F.concat_ws("-", *[F.regexp_extract(x, fractions, k) for k in (1, 2, 3)]), tail)),
        F.when(x.rlike(triad), F.concat(F.regexp_extract(x, triad, 0), tail)),
        F.when(x.rlike(optical), F.concat(F.concat_ws("-", digit(1), digit(2), digit(3)), tail)),
        F.when(morning & night, "Twice Daily (Morning, Night)").when(morning, "Morning").when(night, "Night").when(evening, "Evening"),
        F.upper(_first(x, rf"(?i){B}[0-9]{{1,2}}\s*(?:AM|PM){E}")),
        *meals,
        F.nullif(F.replace(F.regexp_extract(x, rf"{B}[0-9]\s*-\s*[0-9]{E}", 0), F.lit(" "), F.lit("")), F.lit("")),
        F.lit(MISSING),
    )


def given(x: Column | str) -> Column:
    """null for what wasn't found."""
    return F.nullif(F.nullif(_col(x), F.lit(MISSING)), F.lit(""))


def duration_days(x: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(x), r"(?i)([0-9]+)\s*day", 1), F.lit("")).cast("int")


def fuse_confidence(match: Column | str, ocr: Column | str) -> Column:
    """Match confidence (0-100), dampened by how sure the reading was (0-1)."""
    match, ocr = _col(match), _col(ocr)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ocr))
    return F.when(match.isNull() | ocr.isNull(), match).otherwise(F.round(match * (0.5 + 0.5 * clamped), 1))
