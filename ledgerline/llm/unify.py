"""Visually identical text with different characters (problem 9).

``look`` brings a text to the one form in which texts that look the same are equal; ``form`` is the
coarser compatibility form (NFKC of the look, full case folding) that serves as the key under which
candidates meet. Both are computed once per distinct value of a batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

# Unicode's default-ignorable ranges, and letters that share the shape of a Latin letter
# (single letters of the public confusables: Cyrillic, Greek, Armenian, Coptic, Cherokee, Lisu) with two hyphens.
IGNORABLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
LOOKALIKE = {
    **dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏѵЅԌ", "ABESIJKMHOPCTYXaesijopcyxhdqwlvSG")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳανρυι", "ABEZHIKMNOPTYXocjavpui")),
    **dict(zip("օսցհɡոՍՕ", "ouqhgnUO")),
    **dict(zip("ⲞⲟⲢⲣⲤⲥⲎⲒⲔⲘⲚⲦⲬ", "OoPpCcHIKMNTX")),
    **dict(zip("ᎪᎬᎳᎷᎻᏀᏃᏟᏢᏦᏚᏙᎢᎫᎡᏞ", "AEWMHGZCPKSVTJRL")),
    **dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU")),
    **dict(zip("‐‑", "--")),
}
LINE_ENDS = {0x0B: "\n", 0x0C: "\n", 0x85: "\n", 0x2028: "\n", 0x2029: "\n"}


class _Shapes(dict):
    """Translation table filled on demand: what a single character looks like."""

    def __missing__(self, code: int) -> str | None:
        ch = chr(code)
        if any(a <= code <= b for a, b in IGNORABLE):
            out = None
        elif code in LINE_ENDS:
            out = LINE_ENDS[code]
        elif ch == "\t" or unicodedata.category(ch) == "Zs":
            out = " "
        elif ch in LOOKALIKE:
            out = LOOKALIKE[ch]
        else:
            tag, _, rest = unicodedata.decomposition(ch).partition(" ")
            wide = tag in ("<wide>", "<narrow>", "<noBreak>") or (tag == "<compat>" and 0xFB00 <= code <= 0xFB4F)
            out = "".join(self[int(x, 16)] or "" for x in rest.split()) if wide else ch
        self[code] = out
        return out


_SHAPES = _Shapes()


def look(text: str) -> str:
    """Canonically composed form in which width, kind of blank, unseen characters and look-alikes are one.

    Letters are taken apart first, so that a look-alike under an accent, which composes to a letter of
    its own alphabet, meets the Latin letter under that accent.
    """
    if text.isascii():
        return text.translate(_SHAPES) if "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text else text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_SHAPES))


def form(seen: str) -> str:
    """Compatibility form of a ``look``: NFKC, full case folding, NFKC again."""
    if seen.isascii():
        return seen.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", seen).casefold())


def _hash(s: str) -> bytes:
    return xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))


def per_distinct(column: pa.Array, f: Callable[[str], tuple], types: list[pa.DataType]) -> list[pa.Array]:
    """Columns of ``f`` over a text column, evaluated once per distinct value; null stays null."""
    code = pc.dictionary_encode(column)
    made = [f(v) for v in code.dictionary.to_pylist()]
    return [pc.take(pa.array([m[i] for m in made], t), code.indices) for i, t in enumerate(types)]


def forms(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, key, seen, raw): 128-bit hashes of the compatibility form, the look and the text itself.

    Rows with a null text or id are left out; empty and repeated texts are texts like others. Narrow:
    texts never leave the task that reads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashes(t: str) -> tuple:
            s = look(t)
            return _hash(form(s)), _hash(s), _hash(t)

        for b in batches:
            cols = per_distinct(b.column(1), hashes, [pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["ident", "key", "seen", "raw"])

    kind = dict(documents.dtypes)[ident]
    rows = documents.select(F.col(ident).alias("ident"), F.col(text).alias("text")).filter("ident is not null and text is not null")
    return rows.mapInArrow(run, f"ident {kind}, key binary, seen binary, raw binary")


def unified(documents: DataFrame, text: str) -> DataFrame:
    """``documents`` with ``text`` replaced by its look; nulls stay null, all other columns are untouched."""

    @F.pandas_udf("string")
    def same(s):  # noqa: ANN001, ANN202
        known = {v: look(v) for v in s.dropna().unique()}
        return s.map(known, na_action="ignore")

    return documents.withColumn(text, same(F.col(text)))


def lookalikes(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """(a, b): pairs of rows, smaller id first, whose texts look the same but aren't the same string.

    Candidates share the compatibility form; equality of the look decides. Classes whose texts are all
    one string are dropped before any join. Pairs are first formed between the few distinct strings of
    a class and then expanded to their rows, so a string copied any number of times meets only rows that
    belong to an output pair. The hashes are computed once and written to the shared folder.
    """
    rows = cut(forms(documents, ident, text))
    strings = rows.groupBy("key", "seen", "raw").agg(F.count(F.lit(1)).alias("n"))
    mixed = strings.groupBy("key", "seen").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", "seen")
    several = strings.join(mixed, ["key", "seen"], "left_semi").select("key", "seen", "raw")
    pairs = several.join(several.withColumnRenamed("raw", "other"), ["key", "seen"]).filter("raw < other").select("raw", "other")
    # each distinct string has one look, so its hash alone identifies the class
    left = rows.select(F.col("ident").alias("a"), "raw")
    right = rows.select(F.col("ident").alias("b"), F.col("raw").alias("other"))
    found = pairs.join(left, "raw").join(right, "other")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def look_classes(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, class_id, strings): every row with the least id of its look and the look's number of distinct strings."""
    rows = cut(forms(documents, ident, text))
    per = rows.groupBy("key", "seen", "raw").agg(F.min("ident").alias("least")).groupBy("key", "seen").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("strings"))
    return rows.join(per, ["key", "seen"]).select("ident", "class_id", "strings")
