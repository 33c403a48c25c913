"""JSON documents as VARIANT, read strictly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JSON_SPACE = " \t\n\r"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def field_path(field: str) -> str:
    """VARIANT path of a top-level field, whatever characters its name has."""
    quote = "'" if '"' in field else '"'
    return f"$[{quote}{field}{quote}]"


def strict_json(text: str | Column) -> Column:
    """The document as VARIANT; NULL unless the text is exactly one JSON document.

    The JVM parser stops after the first document and ignores what follows. The
    text is therefore parsed as the first element of an array whose second
    element is a seal derived from the text: trailing content would displace it.
    """
    text = _col(text)
    seal = F.hex(F.xxhash64(text))
    array = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]')))
    sealed = (F.try_variant_get(array, "$[1]", "string") == seal) & F.try_variant_get(
        array, "$[2]", "variant"
    ).isNull()
    return F.when(sealed, F.try_variant_get(array, "$[0]", "variant"))


def opens_object(text: str | Column) -> Column:
    """Whether a valid JSON text is an object (its first character decides)."""
    return F.ltrim(_col(text), F.lit(JSON_SPACE)).startswith("{")


def is_null_literal(text: str | Column) -> Column:
    return F.trim(_col(text), F.lit(JSON_SPACE)) == "null"


def string_field(document: str | Column, field: str) -> Column:
    """A field of the VARIANT, only if it is a JSON string."""
    path = field_path(field)
    kind = F.schema_of_variant(F.try_variant_get(_col(document), path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(_col(document), path, "string"))


def json_field(text: str | Column, field: str) -> Column:
    """A top-level field as text (numbers and nested values in JSON form)."""
    return F.try_variant_get(F.try_parse_json(_col(text)), field_path(field), "string")


def json_number(text: str | Column, field: str, strict: bool = False) -> Column:
    """A top-level field as a double; numeric strings count as numbers.

    A value that is not numeric is NULL, or an error when ``strict``.
    """
    value = json_field(text, field)
    return value.cast("double") if strict else value.try_cast("double")


def canonical_json(document: str | Column) -> Column:
    """VARIANT back to text: keys sorted, no white space."""
    return F.to_json(_col(document))


def expand_json(text: str | Column, document: str | Column | None = None) -> Column:
    """Canonical object text of a stored document.

    Anything that is not a JSON object becomes ``{"raw": text}``; a literal
    ``null`` stays NULL. ``document`` is the strictly parsed text, if at hand.
    """
    text = F.coalesce(_col(text), F.lit(""))
    document = strict_json(text) if document is None else _col(document)
    return F.when(document.isNotNull() & opens_object(text), canonical_json(document)).when(
        document.isNull() | ~is_null_literal(text), F.to_json(F.struct(text.alias("raw")))
    )
