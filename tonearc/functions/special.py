"""Special functions: log-gamma and digamma, glob patterns, Porter stems."""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Γ(x), x > 0: Stirling's series after moving x up to 10 or more."""
    x = np.asarray(x, float)
    shift, z = np.zeros_like(x), x.copy()
    for _ in range(10):
        low = z < 10
        if not low.any():
            break
        shift[low] += np.log(z[low])
        z[low] += 1
    w = 1 / (z * z)
    series = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w * (1 / 1188 - w * 691 / 360360))))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def digamma(x: np.ndarray) -> np.ndarray:
    """ψ(x); 0 for x <= 0."""
    x = np.asarray(x, float)
    z, out = np.where(x > 0, x, 1.0), np.zeros_like(x)
    for _ in range(10):
        low = z < 10
        if not low.any():
            break
        out[low] -= 1 / z[low]
        z = np.where(low, z + 1, z)
    w = 1 / (z * z)
    out += np.log(z) - 0.5 / z - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))
    return np.where(x > 0, out, 0.0)


@F.pandas_udf(DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    return pd.Series(log_gamma(x.to_numpy(float)))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression, in lower case: * is any run, ? any letter, all else literal."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower()) + "$"


# ---- Porter (1980) ---------------------------------------------------------------------------------------------------

_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def porter_stem(word: str) -> str:
    """The Porter stem of a lower-case English word."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((n for e, n in (("ed", 2), ("ing", 3)) if w.endswith(e) and "v" in _shape(w[:-n])), 0)
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = next((e for e in sorted(table, key=len, reverse=True) if w.endswith(e)), None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = next((e for e in sorted(_STEP4, key=len, reverse=True) if w.endswith(e)), None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@functools.lru_cache(maxsize=200_000)
def cached_stem(word: str) -> str:
    """porter_stem() that remembers words, in each worker."""
    return porter_stem(word)


@F.pandas_udf(StringType())
def stem(word: pd.Series) -> pd.Series:
    known = {w: porter_stem(w) for w in word.dropna().unique()}
    return word.map(known)


def seeded_uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that only depends on the seed and the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(1 << 52)) / float(1 << 52)
