"""Text, hash and vector functions as column expressions (JVM side unless said otherwise)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as ECMAScript's \s has it; Java's \s is ASCII only.
SPACE = r"[\s   -     　﻿]"
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# Patterns of personal data and of secrets. Edges are ASCII word edges, as \b differs between engines.
EMAIL = "(?i)" + _EDGE + r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}" + _EDGE
PHONE = _EDGE + r"(?:\+?[0-9][ -]?){10,14}" + _EDGE
SECRET = "(?i)" + _EDGE + r"(?:sk-[A-Za-z0-9_-]{12,}|AKIA[0-9A-Z]{16}|(?:api[_-]?key|password)\s*[:=]\s*[^\s,;]+)"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which the JVM side has no function for."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def trim_all(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize(c: Column, compose: bool = True) -> Column:
    """Compatibility form, lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(nfkc(c) if compose else c), f"{SPACE}+", " "))


def json_quoted(c: Column) -> Column:
    """A string as JSON writes it, control characters in lower-case escapes."""
    q = F.to_json(F.struct(c.alias("v")))
    q = F.substring(q, 6, 1 << 30)  # drop {"v":
    q = F.regexp_replace(q, r"\}$", "")
    for code in (0x0B, 0x0E, 0x0F, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F):
        q = F.replace(q, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return q


def text_hash(c: Column) -> Column:
    """SHA-256 of the JSON-quoted string."""
    return F.sha2(json_quoted(c), 256)


def salted(salt: str, c: Column) -> Column:
    """SHA-256 of salt, a zero byte and the value."""
    return F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), c), 256)


def hash_unit(h: Column) -> Column:
    """The first twelve hex digits as a number in [0, 1]."""
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / F.lit(float(0xFFFFFFFFFFFF))


def hash_unit_compat(h: Column, compat: bool = True) -> Column:
    """The first thirteen hex digits as a number; ``compat`` divides by 2^53 - 1, so values stay under one half."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float((1 << 53) - 1 if compat else (1 << 52) - 1))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units of the basic plane, as eight hex digits."""
    step = F.aggregate(F.split(c, ""), F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.lpad(F.hex(F.when(c == "", F.lit(2166136261).cast("long")).otherwise(step)), 8, "0"))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, where ``f`` uses it inside a lambda (which would compute it for every element)."""
    return F.element_at(F.transform(F.array(c), f), 1)


def word_shingles(c: Column) -> Column:
    """Distinct runs of up to three words of a normalized text, the shorter runs at its end included.

    Words are taken by position: ``slice`` would copy the whole array for every run.
    """
    return let(F.split(c, " "), lambda w: F.array_distinct(F.transform(w, lambda _, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))


def token_shingles(c: Column) -> Column:
    """Distinct full runs of three ASCII tokens; of a text with fewer, its tokens."""

    def runs(w: Column) -> Column:
        full = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
        return F.array_distinct(F.when(F.size(w) < 3, w).otherwise(full))

    return let(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), runs)


def word_set(c: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.split(F.lower(c), f"{SPACE}+"))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two sets; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; a zero norm counts as one."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)

    def total(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(total(x, x)) * F.sqrt(total(y, y))
    return F.when(n == 0, 0.0).otherwise(total(x, y) / F.when(norm == 0, 1.0).otherwise(norm))


def sensitive(c: Column) -> Column:
    """Every e-mail address and phone number (pii) and secret as ``(kind, match)``."""
    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("match")))

    return F.concat(found("pii", EMAIL), found("pii", PHONE), found("secret", SECRET))


def length_bucket(n: Column) -> Column:
    """short under 128, medium under 1024, else long."""
    return F.when(n < 128, "short").when(n < 1024, "medium").otherwise("long")


def round_half_up(c: Column, digits: int = 6) -> Column:
    """Halves towards positive infinity."""
    k = float(10**digits)
    return F.floor(c * k + 0.5) / k


def softplus(c: Column) -> Column:
    """log(1 + exp(c)) without overflow."""
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def margin_mse(sp: Column, sn: Column, tp: Column, tn: Column) -> Column:
    """Squared difference of student's and teacher's margins."""
    return F.pow((sp - sn) - (tp - tn), F.lit(2.0))


def pairwise_logistic(p: Column, n: Column) -> Column:
    """Logistic loss of a positive over a negative score."""
    return F.log1p(F.exp(-(p - n)))


def softmax(scores: Column, temperature: Column | float = 1.0) -> Column:
    """Probabilities of an array of scores."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    e = let(F.array_max(scores), lambda m: F.transform(scores, lambda s: F.exp((s - m) / t)))
    return let(e, lambda v: let(F.aggregate(v, F.lit(0.0), lambda a, y: a + y), lambda z: F.transform(v, lambda x: x / z)))


def listwise_kl(teacher: Column, student: Column, temperature: float = 1.0) -> Column:
    """Kullback-Leibler divergence of the student's from the teacher's softmax."""
    t, s = softmax(teacher, temperature), softmax(student, temperature)
    return F.aggregate(F.zip_with(t, s, lambda p, q: F.when(p == 0, 0.0).otherwise(p * F.ln(p / q))), F.lit(0.0), lambda a, x: a + x)
