"""Text functions: folding, tokens, n-grams, label normalisation. All are column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Letters whose compatibility decomposition has one ASCII letter, and those letters."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if c < "\x80"]
        if len(base) == 1:
            marked.append(chr(code)), plain.append(base[0])
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _folds()
#: ASCII characters between tokens.
BETWEEN = re.sub("[a-z0-9_ ]", "", "".join(map(chr, range(128))))
#: Letters that labels spell out; in texts they are dropped.
SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ø": "o", "đ": "d", "ł": "l"}


def fold(text: Column) -> Column:
    """Lower case without accents; what has no ASCII letter is dropped."""
    return F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), r"[^\x00-\x7F]", "")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of the folded text."""
    spaced = F.translate(F.lower(text), MARKED + BETWEEN, PLAIN + " " * len(BETWEEN))
    return F.array_remove(F.split(F.regexp_replace(spaced, r"[^\x00-\x7F]", ""), " "), "")


def grams(toks: Column, n: int) -> Column:
    """Runs of n neighbouring tokens, joined by a space."""
    if n == 1:
        return toks
    size = F.size(toks)
    out = F.slice(toks, 1, F.greatest(size - (n - 1), F.lit(0)))
    for k in range(1, n):
        out = F.zip_with(out, F.slice(toks, k + 1, F.greatest(size - (n - 1), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def ngrams(toks: Column, low: int, high: int) -> Column:
    return F.flatten(F.array(*[grams(toks, n) for n in range(low, high + 1)]))


def words(text: Column) -> Column:
    """Lower-cased, white-space separated words; not the tokens of a model."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def normal_label(label: Column) -> Column:
    """Lower case, transliterated to ASCII, white space collapsed and trimmed."""
    out = F.lower(label.cast("string"))
    for letter, spelled in SPELLED.items():
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    out = F.regexp_replace(F.translate(out, MARKED, PLAIN), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))
