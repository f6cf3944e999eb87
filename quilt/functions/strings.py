"""Byte and ASCII string functions as columns. Inputs are taken to be ASCII where a byte is a character; nulls give nulls."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cls(chars: str) -> str:
    return "".join(re.escape(c) for c in chars)


def strlen(s: Column) -> Column:
    return F.octet_length(s)


def strnlen(s: Column, n: int) -> Column:
    return F.least(F.octet_length(s), F.lit(n))


def strcmp(a: Column, b: Column) -> Column:
    """Difference of the first characters that differ, 0 if none does."""
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a), F.length(b)) + 1), lambda i: F.ascii(F.substr(a, i, F.lit(1))) - F.ascii(F.substr(b, i, F.lit(1))))
    return F.coalesce(F.get(F.filter(gaps, lambda g: g != 0), F.lit(0)), F.lit(0))


def strncmp(a: Column, b: Column, n: int) -> Column:
    return strcmp(F.substring(a, 1, n), F.substring(b, 1, n))


def memchr(s: Column, c: str, n: int) -> Column:
    """Position from 0 of c within the first n bytes, or null."""
    at = F.instr(F.substring(s, 1, n), c)
    return F.when(at > 0, at - 1)


def strchr(s: Column, c: str) -> Column:
    at = F.instr(s, c)
    return F.when(at > 0, F.substr(s, at))


def strrchr(s: Column, c: str) -> Column:
    at = F.instr(F.reverse(s), c)
    return F.when(at > 0, F.substr(s, F.length(s) - at + 1))


def strstr(s: Column, needle: str) -> Column:
    if not needle:
        return s
    return strchr(s, needle)


def strspn(s: Column, accept: str) -> Column:
    if not accept:
        return F.length(s) * 0
    return F.length(F.regexp_extract(s, f"^[{_cls(accept)}]*", 0))


def strcspn(s: Column, reject: str) -> Column:
    if not reject:
        return F.length(s)
    return F.length(F.regexp_extract(s, f"^[^{_cls(reject)}]*", 0))


def strpbrk(s: Column, accept: str) -> Column:
    n = strcspn(s, accept)
    return F.when(n < F.length(s), F.substr(s, n + 1))


def strtok(s: Column, delimiters: str) -> Column:
    """Tokens; empty ones are skipped."""
    return F.filter(F.split(s, f"[{_cls(delimiters)}]"), lambda x: x != "")


def strsep(s: Column, delimiters: str) -> Column:
    """Tokens; empty ones are kept."""
    return F.split(s, f"[{_cls(delimiters)}]", -1)


def strcat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def strncat(a: Column, b: Column, n: int) -> Column:
    return F.concat(a, F.substring(b, 1, n))


def strncpy(s: Column, n: int) -> Column:
    """The first n characters; the padding of shorter strings has no characters."""
    return F.substring(s, 1, n)


strndup = strncpy


def strdup(s: Column) -> Column:
    return s


def strlwr(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strupr(s: Column) -> Column:
    return F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def strrev(s: Column) -> Column:
    return F.reverse(s)


def memset(c: str, n: Column) -> Column:
    return F.repeat(F.lit(c), n)


def memcpy(to: Column, s: Column, n: int) -> Column:
    """The first n characters of s over the start of to."""
    return F.concat(F.substring(s, 1, n), F.substr(to, F.least(F.length(s), F.lit(n)) + 1))


memmove = memcpy


def _number(s: Column, kind: str) -> Column:
    digits = F.regexp_extract(s, r"^[ \t-\r]*([+-]?[0-9]+)", 1)
    return F.when(s.isNotNull(), F.coalesce(digits.try_cast(kind), F.lit(0).cast(kind)))


def atoi(s: Column) -> Column:
    """Leading whole number; 0 where there is none or it doesn't fit."""
    return _number(s, "int")


def atol(s: Column) -> Column:
    return _number(s, "long")


def strerror(code: Column, messages: dict[int, str]) -> Column:
    found = F.create_map(*[F.lit(x) for kv in messages.items() for x in kv])
    return F.coalesce(F.try_element_at(found, code), F.lit("Unknown error"))


def _is(pattern: str):
    return lambda c: c.rlike(f"^{pattern}$")


isdigit, islower, isupper = _is("[0-9]"), _is("[a-z]"), _is("[A-Z]")
isalpha, isalnum, isxdigit = _is("[A-Za-z]"), _is("[A-Za-z0-9]"), _is("[0-9A-Fa-f]")
ispunct, isspace, isblank = _is(r"[!-/:-@\[-`{-~]"), _is(r"[\t-\r ]"), _is(r"[\t ]")


def iscntrl(c: Column) -> Column:
    return (F.ascii(c) <= 31) | (F.ascii(c) == 127)


def isprint(c: Column) -> Column:
    return ~iscntrl(c)


def isgraph(c: Column) -> Column:
    return ~iscntrl(c) & (c != " ")


tolower, toupper = strlwr, strupr
