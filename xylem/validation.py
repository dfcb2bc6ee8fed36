"""Rules for what markup may hold: on the driver for constants, as Columns for data."""

from __future__ import annotations

import codecs
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import NamespaceError, ValidationError

NAME = r"^[A-Za-z_:][A-Za-z0-9_:.\-]*$"
PREFIX = r"^[A-Za-z_][A-Za-z0-9_.\-]*$"
ENTITY = r"^[A-Za-z_][A-Za-z0-9_.\-]*$"
URI = r"^([A-Za-z][A-Za-z0-9+.\-]*:)?[^\s<>\"{}|\\^`\x00-\x1f]*$"


def _named(what: str, pattern: str, value) -> str:
    if not isinstance(value, str) or not re.fullmatch(pattern, value):
        raise ValidationError(f"not a valid {what}: {value!r}")
    return value


def check_element_name(name: str) -> str:
    return _named("element name", NAME, name)


def check_pi_target(name: str) -> str:
    if isinstance(name, str) and name.lower() == "xml":
        raise ValidationError("a processing instruction can't be called xml")
    return _named("processing instruction target", NAME, name)


def check_entity_name(name: str) -> str:
    return _named("entity name", ENTITY, name)


def check_prefix(prefix: str | None) -> str | None:
    return prefix if prefix in (None, "") else _named("prefix", PREFIX, prefix)


def check_uri(uri: str, prefix: str | None = None, mode: str = "strict") -> str:
    """strict: the signs of RFC 3986; lenient: no control signs. A prefix needs a URI."""
    if prefix and not uri:
        raise NamespaceError("a prefix can't be bound to an empty URI", prefix=prefix)
    if not re.fullmatch(URI if mode == "strict" else r"[^\x00-\x1f\x7f]*", uri or ""):
        raise NamespaceError("not a valid namespace URI", uri=uri, prefix=prefix)
    return uri


def check_comment(text: str) -> str:
    if text.startswith("-") or text.endswith("-") or "--" in text:
        raise ValidationError("a comment can't begin or end with a hyphen, nor hold two in a row")
    return text


def check_declaration(version: str = "1.0", encoding: str | None = None, standalone: str | None = None) -> None:
    if version not in ("1.0", "1.1"):
        raise ValidationError(f"not an XML version: {version!r}")
    if standalone not in (None, "yes", "no"):
        raise ValidationError(f"standalone is yes or no, not {standalone!r}")
    if encoding is not None:
        try:
            codecs.lookup(encoding)
        except LookupError:
            raise ValidationError(f"unknown encoding {encoding!r}") from None


def name_ok(c: Column) -> Column:
    return F.coalesce(c.rlike(NAME), F.lit(False))


def comment_ok(c: Column) -> Column:
    return ~(c.startswith("-") | c.endswith("-") | c.contains("--"))


def uri_ok(c: Column) -> Column:
    return c.rlike(URI)


def require(ok: Column, value: Column, message: str) -> Column:
    """The value, or an error at run time where ``ok`` doesn't hold."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("string"))
