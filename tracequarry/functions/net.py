"""Addresses and subnets, as expressions on two 64-bit halves."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.errors import QueryError

Network = ipaddress.IPv4Network | ipaddress.IPv6Network

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_TAIL = rf"(?s)^(.*:){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_GROUP = "[0-9a-fA-F]{1,4}"
_WHOLE = rf"^({_GROUP}:){{7}}{_GROUP}$"
_SHORT = rf"^(({_GROUP}:){{0,6}}{_GROUP})?::(({_GROUP}:){{0,6}}{_GROUP})?$"
#: Bits of an IPv6 address that are an IPv4 one: the upper 32 bits of its lower half.
_MAPPED = 0xFFFF


def network(text: str) -> Network:
    try:
        return ipaddress.ip_network(text.strip(), strict=False)
    except ValueError:
        raise QueryError("bad-subnet", f"{text!r} is not an address or subnet") from None


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bare(text: Column, zone: bool) -> Column:
    """Without blanks around, brackets and, where one may be there, a zone."""
    s = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"(?s)^\[([^\]]*)\].*$", "$1")
    return F.regexp_replace(s, "(?s)%.*$", "") if zone else s


def _octets(s: Column, pattern: str, first: int) -> Column:
    parts = [F.regexp_extract(s, pattern, first + k).try_cast("bigint") * (1 << 8 * (3 - k)) for k in range(4)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def _v4(s: Column) -> Column:
    """The number of a dotted address."""
    return F.when(s.rlike(_V4), _octets(s, _V4, 1))


def _hex6(s: Column) -> Column:
    """32 hex digits of an IPv6 address, a dotted end included; null for anything else."""
    dotted = _let(_octets(s, _TAIL, 2), lambda n: F.concat(F.regexp_extract(s, _TAIL, 1), F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(0xFFFF))))

    def digits(t: Column) -> Column:
        groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
        count = F.size(groups(t))
        halves = F.split(t, "::", 2)
        filled = F.concat(groups(F.get(halves, F.lit(0))), F.array_repeat(F.lit("0"), F.lit(8) - count), groups(F.get(halves, F.lit(1))))
        eight = F.when(t.rlike(_WHOLE), F.split(t, ":")).when(t.rlike(_SHORT) & (count <= 7), filled)
        return F.array_join(F.transform(eight, lambda g: F.lpad(g, 4, "0")), "")

    return F.when(F.contains(s, F.lit(":")), _let(F.when(s.rlike(_TAIL), dotted).otherwise(s), digits))


def _half(digits: Column, at: int) -> Column:
    return F.conv(F.substring(digits, at, 16), 16, -10).cast("bigint")


def address(text: Column, zone: bool = True) -> Column:
    """struct(version, high, low) of a text that is an address, else null; an IPv4 address is its number in low."""

    def six(digits: Column) -> Column:
        return F.when(digits.isNotNull(), F.struct(F.lit(6).alias("version"), _half(digits, 1).alias("high"), _half(digits, 17).alias("low")))

    def of(s: Column) -> Column:
        four = _let(_v4(s), lambda n: F.when(n.isNotNull(), F.struct(F.lit(4).alias("version"), F.lit(0).cast("bigint").alias("high"), n.alias("low"))))
        return F.coalesce(four, _let(_hex6(s), six))

    return _let(_bare(text, zone), of)


def _unmapped(a: Column) -> Column:
    """The number of an IPv4 address, plain or within an IPv6 one."""
    mapped = (a["high"] == 0) & (F.shiftrightunsigned(a["low"], 32) == _MAPPED)
    return F.when(a["version"] == 4, a["low"]).when(mapped, a["low"].bitwiseAND(0xFFFFFFFF))


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def halves(net: Network) -> tuple[int, int, int, int]:
    """(high, low) of a subnet's mask and of its address, as signed numbers."""
    out = []
    for n in (int(net.netmask), int(net.network_address)):
        out += [_signed(n >> 64), _signed(n & (1 << 64) - 1)]
    return out[0], out[1], out[2], out[3]


def in_subnet(v: Column, net: str) -> Column:
    """Whether a text is an address of the subnet. IPv4 subnets know IPv4 addresses written as IPv6 ones too."""
    n = network(net)

    def inside(a: Column) -> Column:
        if n.version == 4:
            return _unmapped(a).between(int(n.network_address), int(n.broadcast_address))
        mask_high, mask_low, high, low = halves(n)
        return (a["version"] == 6) & (a["high"].bitwiseAND(mask_high) == high) & (a["low"].bitwiseAND(mask_low) == low)

    return F.coalesce(_let(address(v), inside), F.lit(False))


def in_networks(values: DataFrame, column: str, nets: list[tuple[int, str]]) -> DataFrame:
    """The rows with net, one for each of the numbered subnets that their address is in.

    An address meets subnets by one equal join: on version, length and itself cut to that length, for each length there is.
    """
    spark = values.sparkSession
    rows = []
    for number, text in nets:
        n = network(text)
        rows.append((number, n.version, n.prefixlen, *halves(n)[2:]))
    lengths = sorted({(v, p, *halves(network(f"::/{p}" if v == 6 else f"0.0.0.0/{p}"))[:2]) for _, v, p, _, _ in rows})
    table = spark.createDataFrame(rows, "net int, _version int, _length int, _high bigint, _low bigint")
    cut = F.array(*[F.struct(F.lit(v).alias("_version"), F.lit(p).alias("_length"), F.lit(h).cast("bigint").alias("_mask_high"), F.lit(low).cast("bigint").alias("_mask_low")) for v, p, h, low in lengths])
    own = values.withColumn("_address", address(F.col(column))).where("_address is not null").select("*", F.inline(cut))
    a, four = F.col("_address"), F.col("_version") == 4
    own = own.withColumns({"_high": F.when(four, F.lit(0)).otherwise(a["high"].bitwiseAND(F.col("_mask_high"))), "_low": F.when(four, _unmapped(a)).when(a["version"] == 6, a["low"]).bitwiseAND(F.col("_mask_low"))})
    return own.join(table, ["_version", "_length", "_high", "_low"]).select(*values.columns, "net")


#: Longest runs of zero groups first.
_ZEROS = [":0" * n + ":" for n in range(8, 1, -1)]


def _written6(a: Column) -> Column:
    """The short form: no leading zeros, the first of the longest runs of zero groups as two colons."""
    digits = F.concat(*[F.lpad(F.hex(a[half]), 16, "0") for half in ("high", "low")])
    groups = [F.lower(F.regexp_replace(F.substring(digits, 4 * k + 1, 4), "^0{1,3}", "")) for k in range(8)]

    def short(x: Column) -> Column:
        out = F.when(F.lit(False), x)
        for run in _ZEROS:
            at = F.instr(x, run)
            rest = F.substring(x, at + len(run), F.lit(99))
            out = out.when(at > 0, F.concat(F.substring(x, F.lit(2), at - 2), F.lit("::"), F.substring(rest, F.lit(1), F.char_length(rest) - 1)))
        return out.otherwise(F.substring(x, F.lit(2), F.char_length(x) - 2))

    return _let(F.concat(F.lit(":"), F.concat_ws(":", *groups), F.lit(":")), short)


def _written4(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, 8 * (3 - k)).bitwiseAND(255).cast("string") for k in range(4)])


def ip_key_of(raw: Column) -> Column:
    """Canonical text of an address for the registry, an IPv4 address in an IPv6 one as IPv4; null for loopback, unspecified and what is no address."""

    def key(a: Column) -> Column:
        def of(n: Column) -> Column:
            four = F.when((n != 0) & (F.shiftright(n, 24) != 127), _written4(n))
            six = F.when((a["high"] != 0) | ~a["low"].isin(0, 1), _written6(a))
            return F.when(n.isNotNull(), four).otherwise(six)

        return _let(_unmapped(a), of)

    return _let(address(raw, zone=False), lambda a: F.when(a.isNotNull(), key(a)))
