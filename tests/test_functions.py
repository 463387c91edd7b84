"""Truth tables of the scalar functions."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from platterlake.functions import access, dates, globs, metadata, numbers, paths, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_capacity(spark):
    cases = {"10": 10, "5B": 5, "2kB": 2000, "2KiB": 2048, " 3 mb ": 3_000_000, "1MiB": 1 << 20, "1gb": 10**9, "1GiB": 1 << 30, "": None, "x": None, "-1": None, "1.5MB": None, "3XB": None, None: None}
    got = values(spark, [(k,) for k in cases], "t string", numbers.capacity_bytes(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())


def test_server_access_round_trip(spark):
    cases = {"/": 0, "L/": 0x10, "LR/R": 0x15, "LWR/WR": 0x1F, "WR/R": 0x0D, "R/": 0x04, "W/W": 0x0A, "D/": 0x20, "DL/": 0x30}
    got = values(spark, list(cases.items()), "t string, b int", access.parse_server_access(F.col("t")), access.server_access_text(F.col("b")))
    assert got == [(b, t) for t, b in cases.items()]
    bad = values(spark, [("LWR",), ("X/",), ("D/R",), ("R/L",)], "t string", access.parse_server_access(F.col("t")))
    assert bad == [(None,)] * 4


@pytest.mark.parametrize(("told", "bits"), [("LWR/R", 0x1B), ("wr/wr", 0x33), ("R/", 1), ("WR", 3), ("0x0B", 0x0B), ("0B", 0x0B), ("33", 0x33), ("WE", 6), ("E", 4), ("/", 0), ("Q/", None), ("R/L", None)])
def test_parse_access(spark, told, bits):
    assert values(spark, [(told,)], "t string", access.parse_access(F.col("t"))) == [(bits,)]


def test_access_maps_both_ways_but_for_execute(spark):
    got = values(spark, [(b,) for b in range(64)], "b int", access.from_server(access.to_server(F.col("b"))))
    assert [g[0] for g in got] == [b & ~4 for b in range(64)]


def test_encoded_names(spark):
    rows = [("F,fff",), ("F,ffffff00,00008000",), ("F,1900-8023",), ("F",), ("a,b,FFB",), ("F,12",), (None,)]
    m = metadata.name_meta(F.col("n"))
    got = values(spark, rows, "n string", metadata.clean_name(F.col("n")), m["load"], m["exec"], m["filetype"])
    assert got == [
        ("F", 0xFFFFFF00, 0, 0xFFF),
        ("F", 0xFFFFFF00, 0x8000, 0xFFF),
        ("F", 0x1900, 0x8023, None),
        ("F", None, None, None),
        ("a,b", 0xFFFFFB00, 0, 0xFFB),
        ("F,12", None, None, None),
        (None, None, None, None),
    ]


def test_sidecar_lines(spark):
    rows = [("HELLO 1900 8023 00000100 03",), ("HELLO 1900 8023 100 Locked",), ("FACE 1900 8023 00000100",), ("0 ffffdd00 ffffdd00 17",), ("HELLO 1900 8023",), ("HELLO xx 8023 100",), ("",), (None,)]
    p = metadata.parse_sidecar(F.col("n"))
    got = values(spark, rows, "n string", p["source"], p["meta"]["load"], p["meta"]["attr"], p["meta"]["filetype"])
    assert got == [("inf-trad", 0x1900, 3, None), ("inf-trad", 0x1900, 11, None), ("inf-trad", 0x1900, None, None), ("inf-pieb", 0xFFFFDD00, 0x17, 0xFDD), *[(None,) * 4] * 4]


def test_sidecar_line_keeps_long_names(spark):
    line = metadata.sidecar_line(F.col("n"), F.lit(0x1900), F.lit(0x8023), F.lit(256), F.col("a"))
    assert values(spark, [("HELLO", 3), ("A.LONGER.NAME1", None)], "n string, a int", line) == [("HELLO       00001900 00008023 00000100 03",), ("A.LONGER.NAME1 00001900 00008023 00000100",)]


def test_packed_dates(spark):
    rows = [(0xD828,), (0x0D28,), (None,)]
    got = values(spark, rows, "p int", dates.unpack_date(F.col("p")))
    assert got == [(datetime.date(2010, 8, 8),), (None,), (None,)]
    days = [(datetime.date(1981, 1, 1),), (datetime.date(2108, 12, 31),), (datetime.date(2010, 8, 8),), (datetime.date(1980, 12, 31),)]
    assert values(spark, days, "d date", dates.unpack_date(dates.pack_date(F.col("d")))) == [days[0], days[1], days[2], (None,)]
    assert values(spark, [days[2]], "d date", dates.pack_date(F.col("d"))) == [(0xD828,)]


def test_character_set(spark):
    data = bytes(range(256))
    decoded = values(spark, [(data,)], "b binary", text.decode_text(F.col("b")))[0][0]
    assert decoded[0x60] == "£" and decoded[0x7C] == "¦" and decoded[0x41] == "A" and len(decoded) == 256
    back = values(spark, [("£1 ¦ A",)], "t string", text.encode_text(F.col("t")), text.can_encode(F.col("t")))
    assert bytes(back[0][0]) == b"\x601 \x7c A" and back[0][1]


def test_names(spark):
    rows = [("hello world.txt",), ("",), ("!boot",), ("a!b",), ("TOOLONGNAME",)]
    got = values(spark, rows, "n string", text.flat_name(F.col("n")), text.server_name(F.col("n")), text.is_flat_name(F.col("n")))
    assert got == [("HELLOWORLDTXT", "hello_worl", False), ("", "UNNAMED", False), ("BOOT", "!boot", True), ("AB", "a!b", False), ("TOOLONGNAME", "TOOLONGNAM", False)]


def test_paths(spark):
    rows = [("$",), ("$.F",), ("$.D.F",), ("$.DIR.F",), ("$.A.B.C",)]
    got = values(spark, rows, "p string", paths.parent(F.col("p")), paths.leaf(F.col("p")), paths.depth(F.col("p")), paths.to_flat(F.col("p")))
    assert got == [(None, "$", 0, None), ("$", "F", 1, "$.F"), ("$.D", "F", 2, "D.F"), ("$.DIR", "F", 2, None), ("$.A.B", "C", 3, None)]


@pytest.mark.parametrize(
    ("pattern", "name", "bulk", "hit"),
    [("*", "ANY", False, True), ("h?llo", "HELLO", False, True), ("h#llo", "HELLO", False, False), ("h#llo", "HELLO", True, True), ("[a-c]*", "BOOT", False, True), ("[!a-c]*", "BOOT", False, False), ("A.B", "AXB", False, False), ("[", "[", False, True), ("a+", "A+", False, True), ("[^A]B", "^B", False, True), ("[^A]B", "XB", False, False), ("[!^]B", "^B", False, False)],
)
def test_globs(spark, pattern, name, bulk, hit):
    assert values(spark, [(name,)], "n string", globs.matches(F.col("n"), pattern, bulk)) == [(hit,)]


def test_little_endian_round_trip(spark):
    rows = [(0,), (255,), (0x80C3,), (0xFFFFFFFF,)]
    assert values(spark, rows, "x long", numbers.uint_le(numbers.bytes_le(F.col("x"), 4), 0, 4)) == rows
    assert values(spark, [(b"\x80",)], "b binary", numbers.byte_at(F.col("b"), 0), numbers.byte_at(F.col("b"), 1)) == [(128, None)]
