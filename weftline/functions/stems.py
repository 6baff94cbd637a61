"""Word stems by Porter's published algorithm (1980), for English; other words come back as they are."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F



def _shape(s: str) -> str:
    out = []
    for i, ch in enumerate(s):
        out.append("v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c")
    return "".join(out)


def _measure(s: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return len(re.findall("v+c+", _shape(s)))


def _short(s: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(s).endswith("cvc") and s[-1] not in "wxy"


def _double(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and _shape(s)[-1] == "c"


#: Suffixes of steps 2, 3 and 4 and what stands for them.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(word: str, suffixes) -> str | None:
    return max((x for x in suffixes if word.endswith(x)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _tense(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    end = _longest(w, ("ed", "ing"))
    if end is None or "v" not in _shape(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if _double(w) and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if _measure(w) == 1 and _short(w) else w


def _replaced(w: str, table: dict[str, str]) -> str:
    end = _longest(w, table)
    return w[: -len(end)] + table[end] if end and _measure(w[: -len(end)]) > 0 else w


def _bare(w: str) -> str:
    end = _longest(w, STEP4)
    if end is None:
        return w
    rest = w[: -len(end)]
    good = _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t")))
    return rest if good else w


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and those with other characters than a to z stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = _tense(_plural(word))
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _bare(_replaced(_replaced(w, STEP2), STEP3))
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double(w) and w[-1] == "l" else w


def opening(stem: str) -> str:
    """How every word with a stem begins: only the last three letters of a stem can be others than the word's. A stem of up to three letters
    has its first in common."""
    return stem[: max(1, len(stem) - 3)]


def stems_of(lists: Column) -> Column:
    """Stems of a column of arrays of words; each distinct word of a batch is stemmed once."""

    def run(xs: pa.Array) -> pa.Array:
        codes = xs.flatten().dictionary_encode()
        found = pa.array([None if x is None else stem(x) for x in codes.dictionary.to_pylist()], pa.string()).take(codes.indices)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(xs), 0).to_numpy(zero_copy_only=False))].astype(np.int32)), found)

    return F.arrow_udf(run, "array<string>")(lists)


def stems(words: Column) -> Column:
    """Stems of a column of words; meant for a table of distinct words, which is stemmed once and joined back."""
    return F.arrow_udf(lambda xs: pa.array([None if x is None else stem(x) for x in xs.to_pylist()], pa.string()), "string")(words)
