"""Which IP addresses are public."""

from __future__ import annotations

import ipaddress

_SHARED = ipaddress.ip_network("100.64.0.0/10")


def is_public(value: str | None) -> bool:
    """IPv4 and IPv6; what is no address is not public."""
    try:
        ip = ipaddress.ip_address(value)
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return not (ip.is_loopback or ip.is_unspecified or ip.is_private or ip.is_link_local or ip.is_multicast or (ip.version == 4 and ip in _SHARED))
