"""Cleaning and redacting text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Pattern, replacement, and a text without which the pattern cannot match; applied in this order.
MESSAGE_RULES = (
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[REDACTED_IP]", "."),
    (r"\b[\w.-]+\.amazonaws\.com\b", "[REDACTED_HOST]", ".amazonaws.com"),
    (r"\b[\w.-]+:\d{2,5}\b", "[REDACTED_ENDPOINT]", ":"),
    (r"(?i)password\s*=\s*[^\s,;'\"]+", "password=[REDACTED]", "="),
    (r"(?i)username\s*=\s*[^\s,;'\"]+", "username=[REDACTED]", "="),
    (r"(?i)\buser\s*=\s*[^\s,;'\"]+", "user=[REDACTED]", "="),
)
LOG_RULES = (
    r"""(?i)(aws_secret_access_key["\s:=]+)[^\s,}"']+""",
    r"""(?i)(secret_key["\s:=]+)[^\s,}"']+""",
    r"""(?i)(password["\s:=]+)[^\s,}"']+""",
    r"""(?i)(session_token["\s:=]+)[^\s,}"']+""",
    r"""(?i)(access_key["\s:=]+)AKIA[A-Z0-9]{16}""",
    r"""(?i)(token["\s:=]+)[^\s,}"']+""",
)


def redact_text(text: Column) -> Column:
    """Without addresses, hosts, ports and credentials."""
    for pattern, replacement, needed in MESSAGE_RULES:
        text = _named(text, _rule(f"(?U){pattern}", replacement, needed))
    return text


def _rule(pattern: str, replacement: str, needed: str):
    return lambda t: F.when(t.contains(needed), F.regexp_replace(t, pattern, replacement)).otherwise(t)


def _named(value: Column, rule) -> Column:
    """``rule`` of a value that it uses several times, without repeating how the value is made."""
    return F.element_at(F.transform(F.array(value), rule), 1)


def redact_log(text: Column) -> Column:
    """Without the values of keys, passwords and tokens."""
    for pattern in LOG_RULES:
        text = F.regexp_replace(text, pattern, "$1***REDACTED***")
    return text


def clean_text(text: Column) -> Column:
    """No NUL characters, line feeds only."""
    text = F.translate(text, "\x00", "")
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def clean_nested(value: Column, dtype: T.DataType) -> Column:
    """:func:`clean_text` on every text inside a value."""
    if isinstance(dtype, T.StringType):
        return clean_text(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: clean_nested(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, x: clean_nested(x, dtype.valueType))
    if isinstance(dtype, T.StructType):
        parts = [clean_nested(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    return value


def unescape_text(text: Column) -> Column:
    r"""Written-out ``\n``, ``\t`` and ``\r`` as the characters, except in a JSON object."""
    plain = text
    for written, meant in ((r"\n", "\n"), (r"\t", "\t"), (r"\r", "\r")):
        plain = F.replace(plain, F.lit(written), F.lit(meant))
    is_object = F.regexp_replace(text, r"^\s+|\s+$", "").rlike(r"(?s)^\{.*\}$")
    return F.when(is_object, text).otherwise(plain)
