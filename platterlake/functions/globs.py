"""Wildcards as regular expressions: `*`, `?` and `[...]` classes, over upper-cased names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str, hash_is_any: bool = False) -> str:
    """The whole-text regular expression of a wildcard; `#` is one character in bulk commands and itself in searches."""
    pattern = pattern.upper().replace("#", "?") if hash_is_any else pattern.upper()
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&")
            negated, body = ("^", body[1:]) if body[0] == "!" else ("", body)
            out.append(f"[{negated}{body.replace('^', chr(92) + '^')}]")  # only `!` negates
            i = close
        else:
            out.append(re.sub(r"([^A-Za-z0-9_])", r"\\\1", c) if c.isascii() else c)
        i += 1
    return f"(?s)^{''.join(out)}$"


def matches(name: Column, pattern: str, hash_is_any: bool = False) -> Column:
    return F.upper(name).rlike(glob_regex(pattern, hash_is_any))
