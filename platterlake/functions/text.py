"""Text: the micro's character set and the names that its filing systems allow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The codes whose characters differ from Latin-1.
CODE_CHARS, HOST_CHARS = "`|", "£¦"


def decode_text(data: Column) -> Column:
    """Text of bytes: Latin-1, with the pound sign at 0x60 and the broken bar at 0x7C."""
    return F.translate(F.decode(data, "ISO-8859-1"), CODE_CHARS, HOST_CHARS)


def encode_text(text: Column, replacement: str = "?") -> Column:
    """Bytes of a text; characters without a code become `replacement`."""
    narrow = F.regexp_replace(F.regexp_replace(text, "[`|]", replacement), r"[^\x00-\xFF]", replacement)
    return F.encode(F.translate(narrow, HOST_CHARS, CODE_CHARS), "ISO-8859-1")


def can_encode(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\xFF]|[`|]")


def padded(text: Column, width: int, fill: str = " ") -> Column:
    """Bytes of a text in a field of fixed width."""
    return F.encode(F.substring(F.rpad(text, width, fill), 1, width), "ISO-8859-1")


def field_text(data: Column) -> Column:
    """Text of a padded field: up to the first CR or NUL, without trailing white space."""
    return F.regexp_replace(F.regexp_extract(decode_text(data), r"^([^\r\x00]*)", 1), r"\s+$", "")


def flat_name(text: Column) -> Column:
    """Upper-cased name with only what a flat catalogue allows."""
    return F.regexp_replace(F.upper(text), r"[^A-Z0-9$%&()+@^_\-£]", "")


def server_name(text: Column, width: int = 10) -> Column:
    """A file server's name: separators become `_`, only visible ASCII stays, never empty."""
    kept = F.regexp_replace(F.translate(text, ". :/", "____"), r"[^\x21-\x7E]", "")
    return F.substring(F.when(kept == "", "UNNAMED").otherwise(kept), 1, width)


def is_flat_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^(?!.+!)[ -\x7F&&[^#*:.]]{1,7}$"), F.lit(False))


def is_server_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[^. :]{1,10}$"), F.lit(False))


def is_title(title: Column, width: int = 12) -> Column:
    return F.coalesce(title.rlike(rf"^[ -\x7E]{{0,{width}}}$"), F.lit(False))
