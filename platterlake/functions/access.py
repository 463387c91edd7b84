"""Access attributes: canonical byte, file-server byte, text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the canonical attribute byte, and of the file server's access byte.
CANONICAL = {"R": 0x01, "W": 0x02, "E": 0x04, "L": 0x08, "PR": 0x10, "PW": 0x20}
SERVER = {"PR": 0x01, "PW": 0x02, "R": 0x04, "W": 0x08, "L": 0x10, "D": 0x20}


def has(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask)) != 0


def _letters(bits: Column, table: dict[str, int], names: str, prefix: str = "") -> Column:
    return F.concat(*[F.when(has(bits, table[prefix + x]), x).otherwise("") for x in names])


def access_text(bits: Column) -> Column:
    """`LWR/WR` of a canonical byte; `/` for null."""
    return F.coalesce(F.concat(_letters(bits, CANONICAL, "LWR"), F.lit("/"), _letters(bits, CANONICAL, "WR", "P")), F.lit("/"))


def server_access_text(bits: Column) -> Column:
    """`LWR/WR` of a file server's byte; `D/` or `DL/` for directories."""
    directory = F.concat(F.lit("D"), _letters(bits, SERVER, "L"), F.lit("/"))
    return F.when(has(bits, SERVER["D"]), directory).otherwise(F.concat(_letters(bits, SERVER, "LWR"), F.lit("/"), _letters(bits, SERVER, "WR", "P")))


def _mapped(bits: Column, source: dict[str, int], target: dict[str, int]) -> Column:
    out = F.lit(0)
    for name in source.keys() & target.keys():
        out = out.bitwiseOR(F.when(has(bits, source[name]), target[name]).otherwise(0))
    return F.when(bits.isNotNull(), out)


def to_server(bits: Column, is_dir: Column | None = None) -> Column:
    """File server's byte of a canonical one (the execute bit has no place there)."""
    out = _mapped(bits, CANONICAL, SERVER)
    return out if is_dir is None else out.bitwiseOR(F.when(is_dir, SERVER["D"]).otherwise(0))


def from_server(bits: Column) -> Column:
    """Canonical byte of a file server's one (bits 6 and 7 are junk)."""
    return _mapped(bits, SERVER, CANONICAL)


def from_locked(locked: Column) -> Column:
    """Canonical byte of a flat catalogue's entry, which only has a lock."""
    return F.when(locked, CANONICAL["R"] | CANONICAL["W"] | CANONICAL["L"]).otherwise(CANONICAL["R"] | CANONICAL["W"])


def _sum_of(part: Column, table: dict[str, int], letters: str, prefix: str = "") -> Column:
    out = F.lit(0)
    for x in letters:
        out = out.bitwiseOR(F.when(F.contains(part, F.lit(x)), table[prefix + x]).otherwise(0))
    return out


def parse_access(text: Column) -> Column:
    """Canonical byte of `0x0B`, of two bare hex digits (unless both are flag letters), or of `LWR/WR`; null where it is none."""
    t = F.upper(F.trim(text))
    owner, public = F.substring_index(t, "/", 1), F.when(F.contains(t, F.lit("/")), F.regexp_extract(t, "^[^/]*/(.*)$", 1)).otherwise("")
    symbols = F.when(owner.rlike("^[LWRE]*$") & public.rlike("^[WR]*$"), _sum_of(owner, CANONICAL, "LWRE").bitwiseOR(_sum_of(public, CANONICAL, "WR", "P")))
    bare = t.rlike("^[0-9A-F]{2}$") & ~t.rlike("^[LWRE]{2}$")
    return (
        F.when(t.rlike("^0X[0-9A-F]{1,8}$"), F.conv(F.substring(t, 3, 8), 16, 10).cast("int"))
        .when(bare, F.conv(F.when(bare, t), 16, 10).cast("int"))
        .otherwise(symbols)
    )


def parse_server_access(text: Column) -> Column:
    """File server's byte of `LWR/WR`, `D/` or `DL/` (the slash is needed); null where it is none."""
    t = F.upper(text)
    owner, public = F.substring_index(t, "/", 1), F.regexp_extract(t, "^[^/]*/(.*)$", 1)
    directory = F.contains(owner, F.lit("D"))
    return (
        F.when(~F.contains(t, F.lit("/")), None)
        .when(directory & owner.rlike("^[DL]*$") & (public == ""), _sum_of(owner, SERVER, "DL"))
        .when(~directory & owner.rlike("^[LWR]*$") & public.rlike("^[WR]*$"), _sum_of(owner, SERVER, "LWR").bitwiseOR(_sum_of(public, SERVER, "WR", "P")))
    )
