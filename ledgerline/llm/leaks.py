"""Evaluation texts leaking into training text (problem 8).

A positional inverted index of the training text is built over the terms of the test items and stored;
every window of a test text is looked up through its rarest terms, and the other terms' positions are
intersected after adjustment by their offset. Exact matches and near matches come from the same index.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, cut
from .unify import form, look

#: Words that must stand consecutively.
SPAN = 12
#: Bits of the map of test terms that every task holds: 2 MB, however many terms there are.
MAP_BITS = 1 << 24
_TAG = re.compile(r"<[A-Za-z/!][^<>]*>")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words of a text in the common form: markup, case, punctuation and line breaks don't count."""
    t = _TAG.sub(" ", text) if "<" in text else text
    t = html.unescape(t) if "&" in t else t
    return _WORD.findall(form(look(t)))


#: Hashes of words met in this process, dropped when there are this many.
_REMEMBERED = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return h


_HASHES = _Hashes()


def _terms(text: str) -> np.ndarray:
    """Hashed words of a text."""
    return np.fromiter(map(_HASHES.__getitem__, words(text)), np.int64)


def _word_arrays(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, terms): hashed words of each non-null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_terms(t) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["ident", "terms"])

    kind = dict(rows.dtypes)[ident]
    return rows.select(F.col(ident).alias("ident"), F.col(text).alias("text")).filter("ident is not null and text is not null").mapInArrow(run, f"ident {kind}, terms array<bigint>")


def term_map(terms: DataFrame, term: str) -> np.ndarray:
    """Bit map of the hashes of ``terms``; combined in the tasks to at most ``MAP_BITS`` / 64 numbers."""
    bit = F.pmod(F.col(term), F.lit(MAP_BITS))
    words = terms.select(F.shiftright(bit, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(MAP_BITS // 64, np.int64)
    for w, b in words.collect():
        out[w] = b
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def positional_index(documents: DataFrame, ident: str, text: str, known_terms: np.ndarray, least: int, gap: int) -> DataFrame:
    """(ident, start, terms): stretches of a text whose words are test terms, with their first position.

    ``known_terms`` is the ``term_map`` of the test texts; a word that only shares a bit with one makes a
    stretch longer, never shorter. A stretch ends where more than ``gap`` words in a row are no test
    terms (they are stored as 0) and is kept if it has at least ``least`` test terms: no match can lie
    elsewhere. ``gap`` zeros are added at both ends, so that a near match may reach over a stretch's ends.
    """
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(known_terms))

    def stretches(terms: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        at = np.flatnonzero(known[terms & (len(known) - 1)])
        if len(at) < least:
            return
        ends = np.flatnonzero(np.diff(at) > gap + 1) + 1
        for a, b in zip(np.r_[0, ends], np.r_[ends, len(at)]):
            if b - a >= least:
                out = np.zeros(at[b - 1] - at[a] + 1 + 2 * gap, np.int64)
                out[at[a:b] - at[a] + gap] = terms[at[a:b]]
                yield int(at[a]), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            who, start, terms = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s, x in stretches(_terms(t), known):
                    who.append(i)
                    start.append(s - gap)
                    terms.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(who, b.schema.types[0]), pa.array(start, pa.int32()), pa.array(terms, pa.list_(pa.int64()))], names=["ident", "start", "terms"])

    kind = dict(documents.dtypes)[ident]
    rows = documents.select(F.col(ident).alias("ident"), F.col(text).alias("text")).filter("ident is not null and text is not null")
    return rows.mapInArrow(run, f"ident {kind}, start int, terms array<bigint>")


def _best_windows(span: int, least: int, kind: str, item_kind: str):  # noqa: ANN202
    """mapInArrow function over (doc, terms, item, uterms, diagonals): the best window of each row, if it has ``least`` equal words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, matched = [], []
            stretch, test, diagonals = b.column(1), b.column(3), b.column(4)
            for i in range(b.num_rows):
                x = stretch[i].values.to_numpy(zero_copy_only=False)
                y = test[i].values.to_numpy(zero_copy_only=False)
                best = 0
                for d in diagonals[i].values.to_numpy(zero_copy_only=False):
                    lo, hi = max(0, -d), min(len(y), len(x) - d)
                    if hi - lo >= span:
                        same = np.cumsum(np.r_[0, x[lo + d : hi + d] == y[lo:hi]])
                        best = max(best, int((same[span:] - same[:-span]).max()))
                if best >= least:
                    keep.append(i)
                    matched.append(best)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(matched, pa.int32())], names=["doc", "item", "matched"])

    return run, f"doc {kind}, item {item_kind}, matched int"


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, fields: list[str], altered: int = 0, span: int = SPAN) -> DataFrame:
    """(doc_id, item_id, matched): documents with a window of ``span`` words of an item's fields.

    ``matched`` is the greatest number of equal words at equal offsets in a window; at most ``altered``
    may differ. Every window is anchored at its ``altered + 1`` rarest terms (by postings over the whole
    corpus): one of them is intact in any match, so none is lost. Postings of anchors are joined by term
    and combined to distinct (stretch, test text, diagonal), the offset-adjusted position at which the
    lists are then intersected; a stretch is shuffled once, to its diagonals, and not with every hit. A
    common anchor only makes its posting list long. Null texts, and items shorter than ``span`` words,
    match nothing; repeated rows count once; empty tables give an empty result.
    """
    least = span - altered
    texts = items.select(F.col(item_id).alias("item"), F.explode(F.array(*fields)).alias("t")).filter("t is not null and item is not null")
    named = texts.distinct().withColumn("uid", F.xxhash64("item", "t"))
    tests = cut(_word_arrays(named, "uid", "t").withColumnRenamed("ident", "uid").join(named.select("uid", "item"), "uid").filter(F.size("terms") >= span).select("uid", "item", F.col("terms").alias("uterms")))
    known = term_map(tests.select(F.explode("uterms").alias("term")).distinct(), "term")
    index = cut(positional_index(documents, doc_id, text, known, least, altered))
    postings = index.select(F.col("ident").alias("doc"), "start", F.posexplode("terms").alias("p", "term")).filter("term <> 0")
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    words = tests.select("uid", F.posexplode("uterms").alias("pos", "term")).join(counts, "term")
    placed = words.select("uid", "pos", "df", "term", F.explode(F.sequence(F.greatest(F.col("pos") - span + 1, F.lit(0)), F.col("pos"))).alias("w"))
    ranked = placed.groupBy("uid", "w").agg(F.sort_array(F.collect_list(F.struct("df", "pos", "term"))).alias("by"))  # at most span entries
    anchors = cut(ranked.filter(F.size("by") >= least).select("uid", F.explode(F.slice("by", 1, altered + 1)).alias("x")).select("uid", "x.pos", "x.term").distinct())
    met = postings.join(broadcast_if_small(anchors, anchors.count(), 40), "term").select("doc", "start", "uid", (F.col("p") - F.col("pos")).alias("diagonal")).distinct()
    met = met.groupBy("doc", "start", "uid").agg(F.collect_list("diagonal").alias("diagonals"))  # at most one a word of the stretch and of the test text
    sized = broadcast_if_small(tests, tests.count(), 16 + 8 * (tests.agg(F.max(F.size("uterms"))).first()[0] or 0))
    looked = met.join(index.withColumnRenamed("ident", "doc"), ["doc", "start"]).join(sized, "uid").select("doc", "terms", "item", "uterms", "diagonals")
    run, schema = _best_windows(span, least, dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id])
    return looked.mapInArrow(run, schema).groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.max("matched").alias("matched"))
