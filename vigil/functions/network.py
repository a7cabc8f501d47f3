"""IPv4 addresses and networks as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
_IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
IPV4 = f"^{_IPV4}$"
CIDR = rf"^{_IPV4}(/(3[0-2]|[12]?\d))?$"


def ip_to_long(ip: Column) -> Column:
    """The address as a number; null for anything but dotted IPv4."""
    # Plain string functions stay in generated code; lambdas over an array do not.
    first, second, third, fourth = (
        F.substring_index(F.substring_index(ip, ".", n), ".", -1).cast("bigint") for n in range(1, 5)
    )
    return F.when(ip.rlike(IPV4), ((first * 256 + second) * 256 + third) * 256 + fourth)


def network_of(ip: Column, prefix: Column) -> Column:
    """First address of the ``prefix``-long network around a numeric address."""
    return ip - F.pmod(ip, F.pow(F.lit(2.0), 32 - prefix).cast("bigint"))


def cidr_parts(text: Column) -> tuple[Column, Column]:
    """(network, prefix) of ``a.b.c.d[/n]``; a bare address counts as /32."""
    address = ip_to_long(F.substring_index(text, "/", 1))
    prefix = F.when(
        text.rlike(CIDR),
        F.coalesce(F.get(F.split(text, "/"), F.lit(1)).try_cast("int"), F.lit(32)),
    )
    return network_of(address, prefix), prefix
