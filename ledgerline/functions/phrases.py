"""Patterns built from tables of plain phrases.

A table is a list of phrases parted by commas. Words of a phrase may be apart by any blanks; ``a|b`` stands
for either word, ``word/s/ed`` for the word with or without an ending, ``stem//y/ies`` for the stem with
one of the endings.
"""

from __future__ import annotations

import re


def _forms(word: str) -> list[str]:
    if "//" in word:
        stem, ends = word.split("//")
        return [stem + e for e in ends.split("/")]
    stem, *ends = word.split("/")
    return [stem, *[stem + e for e in ends]]


def phrase(text: str) -> str:
    """Pattern of one phrase."""
    words = []
    for token in text.split():
        forms = [re.escape(f) for part in token.split("|") for f in _forms(part)]
        words.append(forms[0] if len(forms) == 1 else "(?:" + "|".join(forms) + ")")
    return r"\s+".join(words)


def any_of(table: str, *others: str) -> str:
    """Pattern of any whole phrase of a table, in any case; ``others`` are further patterns, taken as they are."""
    listed = "|".join(phrase(p) for p in table.split(",") if p.strip())
    return "(?i)" + "|".join([rf"\b(?:{listed})\b", *others])
