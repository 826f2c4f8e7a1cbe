"""Canonical JSON, redaction and JSON-schema checks: recursive, so Arrow UDFs."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from urllib.parse import parse_qs, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_text(x: float) -> str:
    """A double as ECMAScript writes it."""
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent:
        return mantissa.removesuffix(".0")
    e = int(exponent)
    digits = mantissa.replace(".", "").replace("-", "")
    sign = "-" if x < 0 else ""
    if -7 < e < 0:
        return f"{sign}0.{'0' * (-e - 1)}{digits}"
    return f"{mantissa.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"


def write_json(v: object, order: Callable[[str], object] = lambda k: k.encode("utf-16-be")) -> str:
    """Compact JSON with sorted keys; the default order is by UTF-16 unit."""
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, (int, float)):
        return number_text(float(v)) if math.isfinite(float(v)) else "null"
    if isinstance(v, list):
        return "[" + ",".join(write_json(x, order) for x in v) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{write_json(v[k], order)}" for k in sorted(v, key=order)) + "}"


def _locale_key(k: str) -> tuple:
    # dictionary order: letters without case first, lower case before upper; punctuation before digits before letters
    return ([(2 if c.isalpha() else 1 if c.isdigit() else 0, c.lower()) for c in k], [c.isupper() for c in k])


def _over_json(f: Callable[[object], str | None]):
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            try:
                return f(json.loads(x))
            except (ValueError, RecursionError):
                return None

        return s.map(one)

    return run


canonical_json = F.pandas_udf(_over_json(write_json), T.StringType())
canonical_json.__doc__ = "Canonical form of a JSON text; null when it is none."
stable_json = F.pandas_udf(_over_json(lambda v: write_json(v, _locale_key)), T.StringType())
stable_json.__doc__ = "Compact JSON with keys in dictionary order."

# Key names and value shapes that are secrets, and query parameters that sign a URL.
_KEY = re.compile(r"(^|[-_])(api[-_]?key|authorization|token|secret|cookie|set[-_]?cookie)($|[-_])", re.I)
_VALUE = re.compile(r"(bearer\s+|sk-|rp_)[\w.-]+", re.I | re.A)
_SIGNED = {"token", "signature", "sig", "x-amz-signature", "credential"}


def redact(v: object) -> object:
    """A JSON value without what looks like a secret."""
    if isinstance(v, list):
        return [redact(x) for x in v]
    if isinstance(v, dict):
        return {k: "[REDACTED]" if _KEY.search(k) else redact(x) for k, x in v.items()}
    if not isinstance(v, str):
        return v
    if _VALUE.fullmatch(v):
        return "[REDACTED]"
    try:
        url = urlsplit(v)
        if url.scheme and _SIGNED & parse_qs(url.query, keep_blank_values=True).keys():
            return "[REDACTED_SIGNED_URL]"
    except ValueError:
        pass
    return v


redact_json = F.pandas_udf(_over_json(lambda v: write_json(redact(v))), T.StringType())
redact_json.__doc__ = "Canonical JSON with secrets replaced."


def schema_errors(v: object, schema: dict, path: str = "$") -> list[tuple[str, str]]:
    """What in a value breaks a schema of the supported subset: type, enum, required, properties, items, additionalProperties."""
    kind = schema.get("type")
    out: list[tuple[str, str]] = []
    if kind == "object":
        if not isinstance(v, dict):
            return [(path, "must be an object")]
        props = schema.get("properties") or {}
        out += [(f"{path}.{k}", "is required") for k in schema.get("required") or [] if k not in v]
        for k, x in v.items():
            if k in props:
                out += schema_errors(x, props[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append((f"{path}.{k}", "is not allowed"))
        return out
    if kind == "array":
        if not isinstance(v, list):
            return [(path, "must be an array")]
        return [e for i, x in enumerate(v) for e in schema_errors(x, schema.get("items") or {}, f"{path}[{i}]")]
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    ok = {"string": isinstance(v, str), "number": number, "integer": number and float(v).is_integer(), "boolean": isinstance(v, bool), "null": v is None}.get(kind, True)
    if not ok:
        out.append((path, f"must be {kind}"))
    if ok and schema.get("enum") is not None and v not in schema["enum"]:
        out.append((path, "must be one of the enumerated values"))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("message", T.StringType())])))
def json_schema_errors(value: pd.Series, schema: pd.Series) -> pd.Series:
    """Errors of JSON texts against JSON schemas; one error for text that is no JSON."""

    def one(v: str | None, s: str | None) -> list[dict]:
        try:
            found = schema_errors(json.loads(v), json.loads(s))
        except (ValueError, TypeError):
            found = [("$", "must be valid JSON")]
        return [{"path": p, "message": m} for p, m in found]

    return pd.Series([one(v, s) for v, s in zip(value, schema, strict=True)])
