"""Redaction of rows whose values nest: one expression, built by walking the schema through structs, arrays and maps.

A string's treatment follows from the name of the field that holds it (for a map, its key; an array's is the array's): telephone numbers and contact
ids become hashes, urls lose parameters that carry secrets. Then the shapes of secrets are replaced in every string. All of it is built-in
functions, so no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.functions.text import SECRETS, redact, short_hash

# Names of fields by treatment, parameters that are dropped, and the shape of a telephone number.
PHONE_FIELDS = ("tel", "from_handle", "to_handle", "sender", "recipient", "handle")
CONTACT_FIELDS = ("ab_person_uid", "person_uid", "ab_uid")
URL_FIELDS = ("url", "uri", "link")
SECRET_PARAMETERS = ("ifkv", "q", "code", "token", "access_token", "id_token", "refresh_token", "session")
PHONE_SHAPE = r"^\+?[0-9][0-9\s\-().]{6,}$"

_BLANKS = r"^\s+|\s+$"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _BLANKS, "")


def phone_hash(phone: Column) -> Column:
    """``phone_`` and 12 hex digits of a number without white space and without ``tel:`` or ``sms:``; empty for an empty one."""
    bare = F.regexp_replace(F.regexp_replace(_trimmed(phone), "(?i)^(?:tel|sms):", ""), r"\s+", "")
    return F.when(bare == "", "").otherwise(short_hash("phone_", bare))


def contact_hash(uid: Column) -> Column:
    """``ab_`` and 12 hex digits; empty for an empty one."""
    bare = _trimmed(uid)
    return F.when(bare == "", "").otherwise(short_hash("ab_", bare))


def _query(url: Column) -> Column:
    """What stands after the first ``?`` up to ``#``; null for what has no scheme or no query."""
    scheme = url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    found = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.when(scheme & (found != ""), found)


def _parameter(part: Column) -> Column:
    name = F.regexp_extract(part, "^[^=]*", 0)
    return F.coalesce(F.try_url_decode(name), name)


def stripped_parameters(url: Column) -> Column:
    """The parameters of ``SECRET_PARAMETERS`` that a url has, in their order there."""
    names = F.transform(F.split(_query(url), "&"), _parameter)
    return F.coalesce(F.array_intersect(F.array(*[F.lit(p) for p in SECRET_PARAMETERS]), names), F.array().cast("array<string>"))


def strip_url(url: Column) -> Column:
    """The url without secret parameters, all else as it stands; what isn't a url is left alone."""
    kept = F.array_join(F.filter(F.split(_query(url), "&"), lambda p: ~_parameter(p).isin(*SECRET_PARAMETERS)), "&")
    head, tail = F.regexp_extract(url, "^[^?#]*", 0), F.regexp_extract(url, "#.*$", 0)
    made = F.concat(head, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), tail)
    return F.when(F.size(stripped_parameters(url)) > 0, made).otherwise(url)


def _is(name: Column, names: tuple[str, ...], inside: str | None = None, ends: bool = False) -> Column:
    low = F.lower(name)
    held = low.isin(*names)
    if inside:
        held = held | F.contains(low, F.lit(inside))
    if ends:
        held = held | low.rlike(f"_(?:{'|'.join(names)})$")
    return F.coalesce(held, F.lit(False))


def _kinds(text: Column, name: Column) -> tuple[Column, Column, Column]:
    phone = (_is(name, PHONE_FIELDS, "phone") | F.coalesce(F.lower(name).endswith("_tel"), F.lit(False))) & _trimmed(text).rlike(PHONE_SHAPE)
    return phone, _is(name, CONTACT_FIELDS, "abperson") & text.isNotNull(), _is(name, URL_FIELDS, ends=True)


def _string(text: Column, name: Column) -> Column:
    phone, contact, url = _kinds(text, name)
    return redact(F.when(phone, phone_hash(text)).when(contact, contact_hash(text)).when(url, strip_url(text)).otherwise(text))


def _string_hits(text: Column, name: Column) -> Column:
    """What was done to a string, in the order in which it was done."""
    phone, contact, url = _kinds(text, name)
    told = F.when(phone, F.array(F.lit("e164_phone_hashed"))).when(contact, F.array(F.lit("abperson_uid_hashed")))
    told = told.when(url, F.transform(stripped_parameters(text), lambda p: F.concat(F.lit("url_query_stripped:"), p))).otherwise(F.array().cast("array<string>"))
    out = _string(text, name)
    times = lambda s, label: F.length(s) - F.length(F.replace(s, F.lit(label), F.lit("")))
    shapes = [F.when(times(out, f"[REDACTED:{n}]") > times(text, f"[REDACTED:{n}]"), n) for n, _ in SECRETS]
    # Most strings have nothing, and of these nothing is counted.
    found = F.when(out != text, F.array_compact(F.array(*shapes))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.concat(told, found), F.array().cast("array<string>"))


def redacted(value: Column, kind: T.DataType, name: Column) -> Column:
    """``value`` of type ``kind`` with all its strings redacted; nulls, numbers and map keys stay."""
    if isinstance(kind, T.StringType):
        return _string(value, name)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redacted(x, kind.elementType, name))
    if isinstance(kind, T.MapType):
        by = (lambda k: k) if isinstance(kind.keyType, T.StringType) else (lambda k: name)
        return F.transform_values(value, lambda k, v: redacted(v, kind.valueType, by(k)))
    if isinstance(kind, T.StructType):
        fields = [redacted(value.getField(f.name), f.dataType, F.lit(f.name)).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def hits(value: Column, kind: T.DataType, name: Column) -> Column:
    """What ``redacted`` does to ``value``, by the order of its fields and elements, repeats included."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return _string_hits(value, name)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: hits(x, kind.elementType, name))), none)
    if isinstance(kind, T.MapType):
        by = (lambda e: e["key"]) if isinstance(kind.keyType, T.StringType) else (lambda e: name)
        return F.coalesce(F.flatten(F.transform(F.map_entries(value), lambda e: hits(e["value"], kind.valueType, by(e)))), none)
    if isinstance(kind, T.StructType):
        return F.concat(none, *[hits(value.getField(f.name), f.dataType, F.lit(f.name)) for f in kind])
    return none


def redact_rows(rows: DataFrame, told: str = "triggered_redactions") -> DataFrame:
    """All columns redacted at every depth, and ``told``: what was done to the row, each once, in first-seen order."""
    columns = [redacted(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)).alias(f.name) for f in rows.schema]
    done = F.array_distinct(F.concat(F.array().cast("array<string>"), *[hits(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in rows.schema]))
    return rows.select(*columns, done.alias(told))
