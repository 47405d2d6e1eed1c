"""Hashes, URLs, addresses and event formats."""

from __future__ import annotations

import json
import re
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.values import Val, text, to_long, to_text
from .registry import batched, json_of, register

ADDRESS = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
#: The IPv4 networks that aren't global, and the addresses in them that are.
PRIVATE = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
GLOBAL = ("192.0.0.9", "192.0.0.10")


def string(col: Column) -> Val:
    return Val(col, "string")


def _hashed(name: str, build) -> None:
    @register(name)
    def made(context, v: Val) -> Val:
        return string(build(F.encode(text(v), "UTF-8")))


_hashed("hash_sha256", lambda b: F.sha2(b, 256))
_hashed("hash_md5", F.md5)
_hashed("hash_sha1", F.sha1)


def _quoted(v: Val) -> Column:
    return F.replace(F.replace(F.url_encode(text(v)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


@register("url_encode")
def url_encode(context, v: Val) -> Val:
    return string(_quoted(v))


@register("url_encode_component")
def url_encode_component(context, v: Val) -> Val:
    return string(F.replace(_quoted(v), F.lit("+"), F.lit("%20")))


@register("url_decode")
def url_decode(context, v: Val) -> Val:
    """A percent sign that no two hexadecimal digits follow stays as it is."""
    return string(F.try_url_decode(F.regexp_replace(text(v), "%(?![0-9A-Fa-f]{2})", "%25")))


def _first_values(query: str) -> dict[str, str]:
    return {k: v[0] for k, v in parse_qs(query).items()}


def _url(s: str | None) -> str:
    parts = urlsplit(s or "")
    port = parts.port
    return json.dumps({"Scheme": parts.scheme, "Host": parts.hostname or "", "Port": "" if port is None else str(port), "Path": parts.path, "Username": parts.username or "", "Password": parts.password or "", "Query Parameters": _first_values(parts.query), "Fragment": parts.fragment})


@register("parse_url")
def parse_url(context, v: Val) -> Val:
    return json_of(batched(_url, "string")(to_text(v)))


@register("parse_urlquery")
def parse_urlquery(context, v: Val) -> Val:
    """Of what follows the first question mark, or of a text without one."""
    return json_of(batched(lambda s: json.dumps({"Query Parameters": _first_values((s or "").split("?", 1)[-1])}), "string")(to_text(v)))


def _packed(s: Column) -> Column:
    """An address as a number, null if it is none."""
    octets = F.split(s, r"\.")
    value = sum((F.get(octets, F.lit(i)).cast("long") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0))
    return F.when(s.rlike(ADDRESS), value)


def _address(v: Val) -> tuple[Column, Column]:
    """(number, mask bits or 32) of an address with or without a mask."""
    s = F.trim(text(v))
    mask = F.when(s.contains("/"), F.get(F.split(s, "/"), F.lit(1)).try_cast("int")).otherwise(32)
    return _packed(F.get(F.split(s, "/"), F.lit(0))), F.when(mask.between(0, 32), mask)


def _masked(value: Column, bits: Column) -> Column:
    keep = F.call_function("shiftleft", F.lit((1 << 32) - 1).cast("long"), (32 - bits).cast("int")).bitwiseAND(F.lit((1 << 32) - 1))
    return value.bitwiseAND(keep)


@register("parse_ipv4")
def parse_ipv4(context, v: Val) -> Val:
    return Val(_address(v)[0], "long")


@register("format_ipv4")
def format_ipv4(context, v: Val, prefix: Val | None = None) -> Val:
    value = F.when(to_long(v).between(0, (1 << 32) - 1), to_long(v)) if v.kind in ("long", "real") else F.coalesce(_address(v)[0], F.when(to_long(v).between(0, (1 << 32) - 1), to_long(v)))
    bits = F.lit(32) if prefix is None else F.when(to_long(prefix).between(0, 32), to_long(prefix))
    net = _masked(value, bits)
    return string(F.when(net.isNotNull(), F.concat_ws(".", *[F.call_function("shiftright", net, F.lit(8 * (3 - i))).bitwiseAND(F.lit(255)).cast("string") for i in range(4)])))


def _fixed(address: str) -> int:
    return int.from_bytes(bytes(map(int, address.split("."))), "big")


@register("ipv4_is_private")
def ipv4_is_private(context, v: Val) -> Val:
    value = _address(v)[0]
    inside = F.lit(False)
    for network in PRIVATE:
        base, bits = network.split("/")
        low = _fixed(base)
        inside = inside | value.between(low, low + (1 << 32 - int(bits)) - 1)
    return Val(F.when(value.isNotNull(), inside & ~value.isin(*map(_fixed, GLOBAL))), "bool")


@register("ipv4_netmask_suffix")
def ipv4_netmask_suffix(context, v: Val) -> Val:
    value, bits = _address(v)
    return Val(F.when(value.isNotNull(), bits).cast("long"), "long")


@register("ipv4_is_in_range")
def ipv4_is_in_range(context, ip: Val, network: Val) -> Val:
    value, (base, bits) = _address(ip)[0], _address(network)
    return Val(_masked(value, bits) == _masked(base, bits), "bool")


@register("ipv4_compare")
def ipv4_compare(context, a: Val, b: Val, prefix: Val | None = None) -> Val:
    (x, m), (y, n) = _address(a), _address(b)
    bits = F.least(m, n) if prefix is None else F.least(m, n, to_long(prefix).cast("int"))
    p, q = _masked(x, bits), _masked(y, bits)
    return Val(F.when(p < q, -1).when(p > q, 1).when(p == q, 0).cast("long"), "long")


#: The header fields of a CEF event, in order, and the form of a pair of its extension.
CEF = ("Version", "DeviceVendor", "DeviceProduct", "DeviceVersion", "SignatureId", "Name", "Severity")
PAIR = re.compile(r"(\w+)=((?:[^=]|=(?!\w+=))*?)(?=\s+\w+=|$)")


def _cef(s: str | None) -> str:
    """A header that is cut short gives empty fields; without one the whole text is the extension."""
    rest, out = s or "", {}
    if rest.startswith("CEF:"):
        fields = [*rest[4:].split("|"), *[""] * len(CEF)]
        out = dict(zip(CEF, fields, strict=False))
        rest = fields[len(CEF)]
    return json.dumps({**out, "Extension": {k: v.strip() for k, v in PAIR.findall(rest)}})


@register("parse_cef_dictionary")
def parse_cef_dictionary(context, v: Val) -> Val:
    return json_of(batched(_cef, "string")(to_text(v)))


