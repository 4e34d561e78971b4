"""Address, host and payload expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def is_ipv4(ip: Column) -> Column:
    """True for dotted-quad text; NULL and IPv6 text are false."""
    return F.coalesce(ip.rlike(IPV4_PATTERN), F.lit(False))


def ip_number(ip: Column) -> Column:
    """Dotted quad → LONG; anything else → NULL."""
    number = F.aggregate(
        F.split(ip, r"\."),
        F.lit(0).cast("bigint"),
        lambda total, octet: total * 256 + octet.try_cast("bigint"),
    )
    return F.when(ip.rlike(IPV4_PATTERN), number)


def cidr_bounds(text: Column) -> tuple[Column, Column]:
    """(lowest, highest) address number of ``a.b.c.d/len`` or of a single address.

    A prefix length outside 0..32 gives NULL bounds, which match nothing.
    """
    base = ip_number(F.substring_index(text, "/", 1))
    length = F.when(F.instr(text, "/") > 0, F.substring_index(text, "/", -1).try_cast("int"))
    length = F.coalesce(length, F.when(F.instr(text, "/") == 0, F.lit(32)))
    length = F.when(length.between(0, 32), length)
    size = F.pow(F.lit(2.0), 32 - length).cast("bigint")
    low = base - (base % size)
    return low, low + size - 1


def host_of(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def parent_domain(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.substring_index(host, ".", -2)


def decode_payload(raw: Column) -> Column:
    """Bytes → text with the bytes of invalid UTF-8 left out."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))
