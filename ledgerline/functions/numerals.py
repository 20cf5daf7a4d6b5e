"""Numbers in text, and the transforms of tagged numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,10)"
# Magnitudes a number may be followed by, and number words.
MAGNITUDE = {"trillion": 12, "tn": 12, "billion": 9, "bn": 9, "b": 9, "million": 6, "mm": 6, "m": 6, "thousand": 3, "k": 3}
ONES = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20)))
TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10)))
SCALE_WORDS = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12}
NUMERAL = r"(?i)[$€£]?\s*\(?\s*[$€£]?\s*[-−–]?\s*(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*\)?\s*(?:(?:trillion|billion|million|thousand|tn|bn|mm|[bmk])\b)?\s*(?:%|percent\b)?\s*\)?"


def masked(text: Column) -> Column:
    """Text without citation markers and ISO dates, which are no figures."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\d+\]|\d{4}-\d{2}-\d{2}", " ")


def numerals(text: Column) -> Column:
    """Array of (value, raw, step, is_percent): every number a text states and half of what its last digit hides."""

    def read(raw: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(raw, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "")
        word = F.lower(F.regexp_extract(raw, r"(?i)\d[\d,.]*\s*\)?\s*(trillion|billion|million|thousand|tn|bn|mm|[bmk])\b", 1))
        power = F.lit(0)
        for name, p in MAGNITUDE.items():
            power = F.when(word == name, p).otherwise(power)
        factor = F.element_at(F.create_map(*[x for p in (0, 3, 6, 9, 12) for x in (F.lit(p), F.lit(10**p).cast("decimal(13,0)"))]), power)
        places = F.when(F.instr(digits, ".") > 0, F.length(F.substring_index(digits, ".", -1))).otherwise(0)
        unit = F.concat(F.lit("1E-"), places.cast("string")).try_cast("decimal(38,10)")
        negative = raw.rlike(r"[-−–]\s*\d|[-−–]\s*[$€£]") | (F.contains(raw, F.lit("(")) & F.contains(raw, F.lit(")")))
        value = (digits.try_cast("decimal(24,8)") * factor).try_cast(MONEY)
        return F.struct(F.when(negative, -value).otherwise(value).alias("value"), F.trim(raw).alias("raw"), (unit.cast("decimal(24,10)") * factor).try_cast(MONEY).alias("step"), raw.rlike(r"(?i)%|percent").alias("is_percent"))

    return F.transform(F.regexp_extract_all(masked(text), F.lit(f"({NUMERAL})"), F.lit(1)), read)


#: Names that hold digits but state no quantity, in the older reading of answers.
NO_QUANTITY = r"(?i)\b10-[KQ]\b|\b8-K\b|\b(?:item\s+\d+[a-c]?|(?:section|asc|ifrs|note)\s+\d+)\b"
QUANTITY = r"(?i)((?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(?:(?:trillion|billion|million|thousand|bn|mm|[btmk])\b)?(?:\s*%)?)"
#: Millions that a unit stands for; a bare number is read as millions.
MILLIONS = {"trillion": 1e6, "t": 1e6, "billion": 1e3, "b": 1e3, "bn": 1e3, "million": 1.0, "m": 1.0, "mm": 1.0, "thousand": 1e-3, "k": 1e-3}


def legacy_numbers(text: Column) -> Column:
    """Array of (raw, millions, is_percent): quantities of a text in the older reading, in which a bare number counts millions."""

    def read(raw: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(raw, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "").cast("double")
        unit = F.lower(F.regexp_extract(raw, r"([a-zA-Z]+)", 1))
        factor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in MILLIONS.items() for x in p]), unit), F.lit(1.0))
        percent = F.contains(raw, F.lit("%"))
        return F.struct(F.trim(raw).alias("raw"), F.when(~percent, digits * factor).alias("millions"), percent.alias("is_percent"))

    return F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), NO_QUANTITY, " "), F.lit(QUANTITY), F.lit(1)), read)


def agrees(found: Column, expected: Column) -> Column:
    """True if the expected figure rounds to the stated one at the precision shown."""
    return F.abs(found.getField("value") - expected) * 2 <= found.getField("step")


def tagged_number(fmt: Column, text: Column, scale: Column, sign: Column) -> Column:
    """Exact value of a tagged number; an unknown format raises.

    dot-decimal, comma-decimal and apostrophe separators, fixed zero, words and no content are known;
    parentheses negate; the scale moves the point, the sign attribute negates last.
    """
    name = F.lower(F.regexp_replace(F.coalesce(fmt, F.lit("num-dot-decimal")), r"^.*:", ""))
    name = F.regexp_replace(name, "[-_]", "")
    t = F.trim(text)
    inner = F.regexp_replace(t, r"[()\s$€£ ]", "")
    dot = F.regexp_replace(inner, ",", "").try_cast(MONEY)
    comma = F.regexp_replace(F.regexp_replace(inner, r"[.']", ""), ",", ".").try_cast(MONEY)
    apos = F.regexp_replace(inner, r"[',’]", "").try_cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    value = (
        F.when(name.isin("numdotdecimal", "numdotdecimalin"), dot).when(name.isin("numcommadecimal", "numcommadot"), comma).when(name.isin("numdotdecimalapos", "numunitdecimal"), apos)
        .when(name.isin("fixedzero", "zerodash", "numdash"), zero).when(name == "numwordsen", number_words(t)).when(name.isin("nocontent", "fixedempty"), F.lit(None).cast(MONEY))
        .otherwise(F.raise_error(F.concat(F.lit("unknown number format "), name)).cast(MONEY))
    )
    power = F.concat(F.lit("1E"), F.coalesce(scale.try_cast("int"), F.lit(0)).cast("string")).try_cast("decimal(38,10)")
    scaled = (value.cast("decimal(28,8)") * power.cast("decimal(18,6)")).try_cast(MONEY)
    flipped = (F.when(t.rlike(r"^\(.*\)$"), -1).otherwise(1) * F.when(F.trim(sign) == "-", -1).otherwise(1)).cast("decimal(1,0)")
    return (scaled * flipped).try_cast(MONEY)


def number_words(text: Column) -> Column:
    """Value of English number words ("two million five hundred"); null if any word is no number word."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.trim(text)), r"[-,]", " "), r"\s+"), lambda w: (w != "") & (w != "and"))
    small = F.create_map(*[x for w, v in (ONES | TENS).items() for x in (F.lit(w), F.lit(v).cast("decimal(20,0)"))])
    big = F.create_map(*[x for w, p in SCALE_WORDS.items() for x in (F.lit(w), F.lit(10**p).cast("decimal(13,0)"))])
    start = F.struct(F.lit(0).cast("decimal(38,0)").alias("total"), F.lit(0).cast("decimal(38,0)").alias("part"), F.lit(True).alias("ok"))

    def step(acc: Column, w: Column) -> Column:
        total, part = acc.getField("total"), acc.getField("part")
        s, b = F.element_at(small, w), F.element_at(big, w)
        new_total = F.when(b.isNotNull(), (total + F.when(part == 0, F.lit(1).cast("decimal(38,0)")).otherwise(part).cast("decimal(20,0)") * b).cast("decimal(38,0)")).otherwise(total)
        new_part = F.when(b.isNotNull(), F.lit(0).cast("decimal(38,0)")).when(w == "hundred", (F.when(part == 0, F.lit(1)).otherwise(part).cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")).cast("decimal(38,0)")).otherwise((part + F.coalesce(s, F.lit(0).cast("decimal(20,0)"))).cast("decimal(38,0)"))
        known = s.isNotNull() | b.isNotNull() | (w == "hundred")
        return F.struct(new_total.alias("total"), new_part.alias("part"), (acc.getField("ok") & known).alias("ok"))

    folded = F.aggregate(words, start, step)
    return F.when((F.size(words) > 0) & folded.getField("ok"), (folded.getField("total") + folded.getField("part")).try_cast(MONEY))
