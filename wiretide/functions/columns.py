"""Column functions of the engine; all stay in the JVM."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

IP4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, whatever the session's time zone holds for one without a zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits; 0 for an empty one."""


    def bits(chars: Column) -> Column:
        n = F.size(chars)
        sums = F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda a, c: let(F.size(F.filter(chars, lambda d: d == c)) / n, lambda p: a - p * F.log2(p)))
        return F.when(n > 0, sums).otherwise(F.lit(0.0))

    return F.coalesce(let(F.filter(F.split(text, ""), lambda c: c != ""), bits), F.lit(0.0))


def registered_domain(name: Column) -> Column:
    """The last two labels, three after a suffix of two."""


    def last(parts: Column, n: int) -> Column:
        return F.array_join(F.slice(parts, -n, n), ".")

    split = F.split(F.regexp_replace(name, r"\.+$", ""), r"\.")
    return let(split, lambda p: F.when(F.size(p) <= 2, F.array_join(p, ".")).when(last(p, 2).isin(*fixed.TWO_PART_SUFFIXES), last(p, 3)).otherwise(last(p, 2)))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(found, r"^[^@]*@", ""), r":[0-9]*$", ""))


def url_decoded(text: Column, rounds: int = 3) -> Column:
    """Form-decoded again and again; a round that meets a bad escape leaves the text as it is."""

    def decoded(x: Column) -> Column:
        return F.when(x.contains("%") | x.contains("+"), F.coalesce(F.try_url_decode(x), x)).otherwise(x)

    for _ in range(rounds):
        text = let(text, decoded)
    return text


def ip4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for other strings."""
    value = let(F.split(ip, r"\."), lambda p: reduce(lambda a, i: a * 256 + F.try_element_at(p, F.lit(i)).try_cast("long"), (1, 2, 3, 4), F.lit(0).cast("long")))
    return F.when(ip.rlike(IP4), value)


def let(value: Column, body) -> Column:
    """body(value), the value being worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bounds(cidr: str) -> tuple[int, int]:
    base, _, bits = cidr.partition("/")
    a, b, c, d = map(int, base.split("."))
    low = (a << 24 | b << 16 | c << 8 | d) & -(1 << (32 - int(bits)))
    return low, low + (1 << (32 - int(bits))) - 1


def first_range(number: Column, ranges: list[tuple[str, str]], otherwise: Column) -> Column:
    """Label of the first range that holds the number."""

    def label_of(n: Column) -> Column:
        out = F
        for cidr, label in ranges:
            out = out.when(n.between(*bounds(cidr)), F.lit(label))
        return out.otherwise(otherwise)

    return let(number, label_of)


def ip_scope(ip: Column) -> Column:
    """Reserved purpose of an IPv4 address, else public; null if it is none."""
    return F.when(ip.rlike(IP4), first_range(ip4_number(ip), [(c, scope) for c, _, scope in fixed.SPECIAL_RANGES if ":" not in c], F.lit("public")))


IP6 = r"(?i)^(?=.*:)(?!.*::.*::)[0-9a-f:]{2,39}$"


def ip6_digits(ip: Column) -> Column:
    """The 32 hex digits of an IPv6 address, so that ranges compare as texts; null for other strings."""

    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda x: x != "")

    low = F.lower(ip)
    left, right = groups(F.substring_index(low, "::", 1)), groups(F.when(low.contains("::"), F.substring_index(low, "::", -1)).otherwise(F.lit("")))
    fill = lambda both: F.array_repeat(F.lit("0"), F.lit(8) - F.size(both["l"]) - F.size(both["r"]))
    whole = let(F.struct(left.alias("l"), right.alias("r")), lambda both: F.array_join(F.transform(F.concat(both["l"], fill(both), both["r"]), lambda x: F.lpad(x, 4, "0")), ""))
    return F.when(ip.rlike(IP6), let(whole, lambda w: F.when(F.length(w) == 32, w)))


def ip6_prefix(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits of an IPv6 address's digits, as a text that is equal for equal prefixes of one length."""
    whole = F.floor(bits / 4).cast("int")
    rest = (bits % 4).cast("int")
    digit = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    return F.concat(F.substring(digits, F.lit(1), whole), F.when(rest > 0, F.concat(F.lit("/"), F.floor(digit / F.pow(F.lit(2), 4 - rest)).cast("string"))).otherwise(F.lit("")))


def first_range6(digits: Column, ranges: list[tuple[str, str]], otherwise: Column) -> Column:
    """Label of the first IPv6 range that holds the address."""

    def label_of(d: Column) -> Column:
        out = F
        for cidr, label in ranges:
            net = ipaddress.ip_network(cidr)
            out = out.when(d.between(net.network_address.packed.hex(), net.broadcast_address.packed.hex()), F.lit(label))
        return out.otherwise(otherwise)

    return let(digits, label_of)


def enriched(ip: Column) -> Column:
    """What fixed tables say of an address: (operator, category, scope, registry, country_hint); scope is null for no address."""
    none = F.lit(None).cast("string")
    named = [(c, f"{name}|{scope}") for c, name, scope in fixed.SPECIAL_RANGES]
    listed = [(c, f"{o}|{k}") for c, o, k in (*fixed.KNOWN_NETWORKS, *fixed.KNOWN_NETWORKS_V6)]
    four, six = (lambda rows: [x for x in rows if ":" not in x[0]]), (lambda rows: [x for x in rows if ":" in x[0]])
    first, second = (lambda x: F.substring_index(x, "|", 1)), (lambda x: F.substring_index(x, "|", -1))

    def by_range(n: Column, d: Column, ranges: list[tuple[str, str]]) -> Column:
        return F.when(n.isNotNull(), first_range(n, four(ranges), none)).otherwise(first_range6(d, six(ranges), none))

    def registry(n: Column, d: Column) -> Column:
        out = F
        for name, spans in fixed.REGISTRIES.items():
            out = out.when(reduce(lambda a, b: a | b, [F.floor(n / (1 << 24)).between(*s) for s in spans]), F.lit(name))
        for name, heads in fixed.REGISTRIES_V6.items():
            out = out.when(F.substring(d, 1, 4).isin(*heads), F.lit(name))
        return out.otherwise(none)

    def told(a: Column) -> Column:
        n, d = a["n"], a["d"]
        of = let(by_range(n, d, named), lambda x: F.struct(x.alias("special"), F.when(x.isNull(), by_range(n, d, listed)).alias("known"), F.when(x.isNull(), registry(n, d)).alias("registry"), (n.isNotNull() | d.isNotNull()).alias("valid")))
        return let(of, shown)

    def shown(x: Column) -> Column:
        special, known = x["special"], x["known"]
        return F.struct(
            first(F.coalesce(special, known)).alias("operator"), second(F.coalesce(special, known)).alias("category"), F.when(x["valid"], F.coalesce(second(special), F.lit("public"))).alias("scope"),
            x["registry"].alias("registry"), by_map(first(known), fixed.COUNTRY_HINTS).alias("country_hint"),
        )

    return let(F.struct(ip4_number(ip).alias("n"), ip6_digits(ip).alias("d")), told)


def is_private(ip: Column) -> Column:
    """Internal by its range.  IPv6: all but global unicast, documentation and transition ranges included."""
    n = ip4_number(ip)
    low = F.lower(ip)
    v4 = let(n, lambda x: reduce(lambda a, b: a | b, [x.between(*bounds(c)) for c in fixed.PRIVATE_RANGES]))
    v6 = ~low.rlike("^[23][0-9a-f]{3}:") | low.rlike("^2001:(0?db8|0{0,3}[0-9a-f]{0,2}|1[0-9a-f]{2}):") | low.rlike("^2002:")
    return F.coalesce(v4, F.when(ip.contains(":"), v6), F.lit(False))


def subnet(ip: Column) -> Column:
    """The /24 of an IPv4 address, the first four groups of an IPv6 one, written out; unknown for other strings."""
    six = F.concat(F.regexp_replace(F.substring(ip6_digits(ip), 1, 16), "(....)(?=.)", "$1:"), F.lit("::/64"))
    four = F.when(ip.rlike(IP4), F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24")))
    return F.coalesce(four, six, F.lit("unknown"))


def by_map(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def service_name(port: Column, udp: Column) -> Column:
    """Name of a port's service, else Ephemeral for high ones, else protocol/port."""
    known = F.when(udp, by_map(port, fixed.UDP_SERVICES)).otherwise(by_map(port, fixed.TCP_SERVICES))
    proto = F.when(udp, F.lit("UDP")).otherwise(F.lit("TCP"))
    return F.when(port == 0, proto).otherwise(F.coalesce(known, F.when(port >= 49152, F.lit("Ephemeral")).otherwise(F.concat(proto, F.lit("/"), port.cast("string")))))


def defang(text: Column) -> Column:
    """An indicator that no client makes a link of."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)^http", "hxxp"), r"\.", "[.]")


def csv_guard(text: Column) -> Column:
    """A leading quote before what a spreadsheet would run."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def file_type(data: Column) -> Column:
    """Type by first bytes; null if none of them."""
    out = None
    for magic, kind, _ in fixed.FILE_MAGICS:
        test = F.substring(data, 1, len(magic)) == F.lit(magic)
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out


def identified(data: Column) -> Column:
    """Type of a file by its content: first bytes, what a zip or RIFF container holds, else whether it is text."""
    head = F.decode(F.substring(data, 1, 8192), "ISO-8859-1")
    zipped = F
    for marker, kind, _ in fixed.ZIP_SUBTYPES:
        zipped = zipped.when(head.contains(marker), F.lit(kind))
    form = F.substring(data, 9, 4)
    riff = F.when(form == F.lit(b"WAVE"), "wav").when(form == F.lit(b"AVI "), "avi").when(form == F.lit(b"WEBP"), "webp").otherwise("riff")
    known = file_type(data)
    start = F.substring(head, 1, 512)
    low = F.lower(start)
    script = F.when(low.contains("<?php"), "php").when(low.contains("function") & low.contains("var "), "js").when(low.contains("powershell") | low.contains("-encodedcommand"), "ps1").otherwise("txt")
    shown = F.regexp_count(start, F.lit(r"[\x09\x0A\x0D\x20-\x7E]"))
    text = F.when((F.length(start) > 0) & (shown > 0.92 * F.length(start)), script).otherwise("bin")
    return F.when(known == "zip", zipped.otherwise("zip")).when(known == "riff", riff).otherwise(F.coalesce(known, text))


def identified_category(kind: Column) -> Column:
    more = {"wav": "media", "avi": "media", "webp": "image", "php": "script", "js": "script", "ps1": "script", "txt": "text", "bin": "unknown"}
    return by_map(kind, {k: c for _, k, c in fixed.FILE_MAGICS} | {k: c for _, k, c in fixed.ZIP_SUBTYPES} | more)


def risk_band(score: Column) -> Column:
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "elevated").when(score >= 10, "low").otherwise("clean")
