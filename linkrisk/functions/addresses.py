"""Addresses of both versions as 128-bit numbers, written as 32 hexadecimal digits so that they compare and cut as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkrisk.functions.urls import IPV4, OCTET, ipv4_number, let

#: An address of the fourth version stands behind this prefix of 96 bits.
MAPPED = "00000000000000000000ffff"
DOTTED = rf"(?<=:){OCTET}(?:\.{OCTET}){{3}}$"


def _groups(half: Column) -> Column:
    return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))


def _sixth(text: Column) -> Column:
    """The digits of an address in groups, which one ``::`` may shorten; null for anything else."""

    def of_halves(halves: Column) -> Column:
        short = F.size(halves) == 2
        high, low = _groups(F.get(halves, F.lit(0))), _groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        return let(F.struct(short.alias("short"), high.alias("high"), low.alias("low")), of_groups)

    def of_groups(g: Column) -> Column:
        both = F.concat(g["high"], g["low"])
        sound = F.forall(both, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
        length = F.size(both)
        fits = F.when(g["short"], length <= 7).otherwise(length == 8)
        padded = lambda half: F.transform(half, lambda x: F.lpad(x, 4, "0"))
        filled = F.concat(padded(g["high"]), F.array_repeat(F.lit("0000"), F.greatest(F.lit(0), 8 - length)), padded(g["low"]))
        return F.when(sound & fits, F.array_join(filled, ""))

    halves = F.split(text, "::")
    return F.when(text.contains(":") & (F.size(halves) <= 2), let(halves, of_halves))


def number(address: Column) -> Column:
    """The address's 32 digits, for example 00000000000000000000ffff0a000001 for 10.0.0.1; null for what is no address.

    An address of the sixth version may stand in brackets, name a zone behind ``%``, and end in dotted octets.
    """
    old = F.concat(F.lit(MAPPED), F.lower(F.lpad(F.hex(ipv4_number(address)), 8, "0")))
    bare = F.lower(F.substring_index(F.regexp_replace(address, r"^[\[\]]+|[\[\]]+$", ""), "%", 1))

    def new(text: Column) -> Column:
        dotted = F.regexp_extract(text, DOTTED, 0)
        last = F.lpad(F.hex(ipv4_number(dotted)), 8, "0")
        head = text.substr(F.lit(1), F.length(text) - F.length(dotted))
        whole = F.when(dotted == "", text).otherwise(F.lower(F.concat(head, F.substring(last, 1, 4), F.lit(":"), F.substring(last, 5, 4))))
        return let(whole, _sixth)

    return F.when(address.rlike(IPV4), old).when(address.contains(":"), let(bare, new))


def prefix(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits of an address's digits, as text: whole digits, and the value of what is left of the next one."""
    rest = bits % 4
    digit = F.conv(digits.substr((bits / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    cut = F.when(rest == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.floor(digit / F.pow(F.lit(2.0), 4 - rest)).cast("string")))
    return F.concat(digits.substr(F.lit(1), (bits / 4).cast("int")), cut)
