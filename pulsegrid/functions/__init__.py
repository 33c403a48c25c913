"""Column expressions; all of them stay inside Catalyst."""

from pulsegrid.functions.hashing import fnv1a32, fnv1a32_text
from pulsegrid.functions.jsonops import (
    canonical_json,
    expand_json,
    json_field,
    json_number,
    strict_json,
)
from pulsegrid.functions.once import with_fence
from pulsegrid.functions.payload import decode_payload, encode_payload
from pulsegrid.functions.rfc3339 import format_rfc3339, parse_rfc3339, parse_rfc3339_text

__all__ = [
    "canonical_json",
    "decode_payload",
    "encode_payload",
    "expand_json",
    "fnv1a32",
    "fnv1a32_text",
    "format_rfc3339",
    "json_field",
    "json_number",
    "parse_rfc3339",
    "parse_rfc3339_text",
    "strict_json",
    "with_fence",
]
