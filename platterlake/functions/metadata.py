"""File metadata: filetypes, encoded filenames and sidecar lines, as structs <load, exec, attr, filetype>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platterlake.functions.access import parse_access
from platterlake.functions.numbers import hex_text, hex_value

STAMP = 0xFFF00000
META = "struct<load: bigint, exec: bigint, attr: bigint, filetype: bigint>"
#: The attributes that the words `L` and `Locked` stand for, and the bridge dialect's default.
LOCKED_ATTR, BRIDGE_ATTR = 0x0B, 0x17

_PAIR = r"(?s)^(.*),([0-9a-fA-F]{8}),([0-9a-fA-F]{8})$"
_DASH = r"(?s)^(.*),([0-9a-fA-F]{1,8})-([0-9a-fA-F]{1,8})$"
_TYPE = r"(?s)^(.*),([0-9a-fA-F]{3})$"


def is_stamped(load: Column) -> Column:
    return F.coalesce(load.bitwiseAND(F.lit(STAMP)) == STAMP, F.lit(False))


def infer_filetype(load: Column, filetype: Column | None = None) -> Column:
    """The type in a stamped load address, else the stored one."""
    stored = F.lit(None).cast("long") if filetype is None else filetype.cast("long")
    return F.when(is_stamped(load), F.shiftright(load, 8).bitwiseAND(F.lit(0xFFF))).otherwise(stored)


def meta(load: Column, exec_: Column, attr: Column | None = None, filetype: Column | None = None) -> Column:
    none = F.lit(None).cast("long")
    fields = [load, exec_, none if attr is None else attr, infer_filetype(load, filetype)]
    return F.struct(*[x.cast("long").alias(name) for x, name in zip(fields, ("load", "exec", "attr", "filetype"), strict=True)])


def _group(name: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(name, pattern, k)


def clean_name(name: Column) -> Column:
    """The name without its encoded suffix."""
    return F.coalesce(*[F.when(name.rlike(p), _group(name, p, 1)) for p in (_PAIR, _DASH, _TYPE)], name)


def name_meta(name: Column) -> Column:
    """Metadata in the suffix of a name: `,8hex,8hex`, else `,hex-hex`, else `,3hex`; null without one."""
    pair = F.when(name.rlike(_PAIR), meta(hex_value(_group(name, _PAIR, 2)), hex_value(_group(name, _PAIR, 3))))
    dash = F.when(name.rlike(_DASH), meta(hex_value(_group(name, _DASH, 2)), hex_value(_group(name, _DASH, 3))))
    kind = hex_value(_group(name, _TYPE, 2))
    typed = F.when(name.rlike(_TYPE), meta(F.lit(STAMP).cast("long").bitwiseOR(F.shiftleft(kind, 8)), F.lit(0).cast("long"), None, kind))
    return F.coalesce(pair, dash, typed)


def name_suffix(load: Column, exec_: Column) -> Column:
    """`,xxx` where the load address is stamped, else `,llllllll,eeeeeeee`."""
    typed = F.concat(F.lit(","), F.lower(hex_text(infer_filetype(load), 3)))
    return F.when(is_stamped(load), typed).otherwise(F.concat(F.lit(","), F.lower(hex_text(load)), F.lit(","), F.lower(hex_text(exec_))))


def dash_suffix(load: Column, exec_: Column) -> Column:
    return F.concat(F.lit(","), F.lower(F.hex(load)), F.lit("-"), F.lower(F.hex(exec_)))


def sidecar_fields(text: Column) -> Column:
    """Fields of the first line of a sidecar."""
    return F.split(F.regexp_replace(F.substring_index(F.trim(text), "\n", 1), r"^\s+|\s+$", ""), r"\s+")


def parse_sidecar(text: Column) -> Column:
    """struct<source, meta> of a sidecar line, null where it can't be read.

    `name load exec length [attr]`, where the first field is no number or the fourth has eight digits; else the
    bridge's `owner load exec perm`.
    """
    f = sidecar_fields(text)
    at = [F.get(f, k) for k in range(5)]
    numbers = [hex_value(x) for x in at]
    long = at[3].rlike("^[0-9A-Fa-f]{8}$")
    named = F.coalesce(~at[0].rlike("^[0-9A-Fa-f]+$"), F.lit(True)) | long
    word = at[4].isin("L", "Locked")
    attr = F.when(word, F.lit(LOCKED_ATTR)).otherwise(numbers[4])
    attr_read = at[4].isNull() | word | numbers[4].isNotNull()
    enough = (F.size(f) >= 4) & numbers[1].isNotNull() & numbers[2].isNotNull()
    traditional = F.struct(F.lit("inf-trad").alias("source"), meta(numbers[1], numbers[2], attr).alias("meta"))
    bridge = F.struct(F.lit("inf-pieb").alias("source"), meta(numbers[1], numbers[2], numbers[3]).alias("meta"))
    return F.when(enough & named & attr_read, traditional).when(enough & ~named & numbers[3].isNotNull(), bridge)


def sidecar_line(name: Column, load: Column, exec_: Column, length: Column, attr: Column) -> Column:
    """`NAME        LLLLLLLL EEEEEEEE SSSSSSSS[ AA]`."""
    line = F.concat_ws(" ", F.format_string("%-11s", name), hex_text(load), hex_text(exec_), hex_text(length))
    return F.when(attr.isNull(), line).otherwise(F.concat(line, F.lit(" "), hex_text(attr, 2)))


def bridge_line(load: Column, exec_: Column, attr: Column, owner: Column | None = None) -> Column:
    owner = F.lit(0) if owner is None else owner
    return F.lower(F.concat_ws(" ", *[F.hex(x.cast("long")) for x in (owner, load, exec_, F.coalesce(attr, F.lit(BRIDGE_ATTR)))]))


def attr_of_text(text: Column) -> Column:
    return parse_access(text)
