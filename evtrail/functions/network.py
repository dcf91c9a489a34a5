"""Which addresses are external (survey C6): IPv4 natively, IPv6 by an Arrow UDF only where a colon occurs."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: IPv4 networks that aren't external, and two addresses in them that are.
INTERNAL_V4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")
EXTERNAL_V4 = ("192.0.0.9", "192.0.0.10")
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"


def ranges() -> list[tuple[int, int]]:
    nets = [ipaddress.ip_network(n) for n in INTERNAL_V4]
    return [(int(n.network_address), int(n.broadcast_address)) for n in nets]


def _prefix(network: str) -> str:
    """A pattern of how the addresses of an IPv4 network begin."""
    net = ipaddress.ip_network(network)
    whole, part = divmod(net.prefixlen, 8)
    octets = list(net.network_address.packed)
    out = [str(x) for x in octets[:whole]]
    if part:
        out.append("(?:" + "|".join(map(str, range(octets[whole], octets[whole] + (1 << 8 - part)))) + ")")
    return r"\.".join(out) + r"\."


#: One pattern, so that the test is a single call in generated code however often the address's expression is inlined.
INTERNAL = "^(?:" + "|".join(map(_prefix, INTERNAL_V4)) + ")"


def _six(value: str | None, strict: bool) -> bool:
    try:
        ip = ipaddress.ip_address((value or "").strip())
    except ValueError:
        return False
    inner = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast
    return not (inner or strict and (ip.is_reserved or ip.is_unspecified))


def _told(value: pd.Series, strict: bool) -> pd.Series:
    out = pd.Series(False, index=value.index)
    some = value.notna()
    if some.any():
        out[some] = value[some].map(lambda v: _six(v, strict))
    return out


@F.pandas_udf(T.BooleanType())
def _external_six(value: pd.Series) -> pd.Series:
    return _told(value, False)


@F.pandas_udf(T.BooleanType())
def _external_six_strict(value: pd.Series) -> pd.Series:
    return _told(value, True)


def external_v4(c: Column) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    return text.rlike(V4) & (text.isin(*EXTERNAL_V4) | ~text.rlike(INTERNAL))


def external(c: Column, strict: bool = True) -> Column:
    """strict, as rules have it, also leaves out reserved and unspecified addresses; correlation doesn't."""
    # Others than those with a colon go to Python as nulls, which it tells at once.
    colon = F.instr(F.coalesce(c, F.lit("")), ":") > 0
    only = F.when(colon, c)
    six = _external_six_strict(only) if strict else _external_six(only)
    return F.when(colon, six).otherwise(external_v4(c))
