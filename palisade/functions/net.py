"""Address arithmetic on text columns, all in built-in expressions.

An address becomes a 32-hex-digit key, so ranges compare as strings and a
prefix match is an equality on the masked key. IPv4 keys are zero-padded; the
family is kept beside the key and always compared first.

Arguments are SQL expressions (usually a column name). The formulas are long,
so they are put together as SQL text and bound with ``let``: each value is
computed once and the plan stays small.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, functions as F

OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"{OCTET}(\.{OCTET}){{3}}"
SITE_LOCAL_V4 = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.)"  # the three site-local blocks

# Address blocks of the public special-purpose registries.
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
PRIVATE_V6 = (
    "::/128", "::1/128", "100::/64", "2001::/23", "2001:db8::/32", "fc00::/7", "fe80::/10",
)
# Registry exceptions inside the blocks above that are globally reachable.
PUBLIC_V4 = ("192.0.0.9/32", "192.0.0.10/32")
PUBLIC_V6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)
LOOPBACK = ("127.0.0.0/8", "::1/128")
MULTICAST = ("224.0.0.0/4", "ff00::/8")


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def is_ipv4_sql(text: str) -> str:
    return f"({text} rlike r'^{IPV4}$')"


def ipv4_number_sql(text: str) -> str:
    """IPv4 text to bigint; anything else to null."""
    number = " + ".join(f"cast(q[{i}] as bigint) * {256 ** (3 - i)}" for i in range(4))
    return f"if({is_ipv4_sql(text)}, {let('q', f"split({text}, '[.]')", number)}, null)"


def ipv6_groups_sql(text: str) -> str:
    """Eight hex groups without leading zeros, or null when the text is not IPv6."""
    tail = rf"r'^(.*:)({IPV4})$'"
    quad = ipv4_number_sql(f"regexp_extract(low, {tail}, 2)")
    as_hex = let("digits", f"lpad(lower(hex({quad})), 8, '0')",
                 f"concat(regexp_extract(low, {tail}, 1), substr(digits, 1, 4), ':', substr(digits, 5, 4))")
    spelled = let("low", f"lower({text})", f"if(low rlike {tail}, {as_hex}, low)")
    part = "if({h} = '', cast(array() as array<string>), split({h}, ':'))"
    pair = (f"struct(size(halves) as n, {part.format(h='halves[0]')} as head, "
            + part.format(h="coalesce(get(halves, 1), '')") + " as rear)")
    filled = let("p", pair, """if(p.n = 1 and size(p.head) = 8 or p.n = 2 and size(p.head) + size(p.rear) <= 7,
        concat(p.head, array_repeat('0', 8 - size(p.head) - size(p.rear)), p.rear), null)""")
    full = let("halves", f"split({spelled}, '::')", filled)
    checked = let("g8", full, "if(forall(g8, g -> g rlike '^[0-9a-f]{1,4}$'), "
                              "transform(g8, g -> regexp_replace(g, '^0{1,3}(?=.)', '')), null)")
    return f"if({text} like '%:%', {checked}, null)"


def address_sql(text: str) -> str:
    """``struct(family, key)``; null when the text is no address."""
    four = f"struct(4 as family, lpad(lower(hex({ipv4_number_sql('a')})), 32, '0') as key)"
    six = let("g6", ipv6_groups_sql("a"), "if(g6 is null, null, struct(6 as family, "
                                          "array_join(transform(g6, g -> lpad(g, 4, '0')), '') as key))")
    return let("a", text, f"if({is_ipv4_sql('a')}, {four}, {six})")


def address(text: str) -> Column:
    return F.expr(address_sql(text))


def ip_key(text: str) -> Column:
    return address(text)["key"]


def canonical_ip_sql(text: str) -> str:
    """Shortest standard spelling: IPv4 unchanged, IPv6 lower-case with its longest zero run packed."""
    packed = "coalesce({}, j)".format(", ".join(
        "if(contains(j, '{z}'), regexp_replace(j, '^(.*?){z}', '$1::'), null)".format(z=":" + "0:" * n)
        for n in range(8, 1, -1)))
    trimmed = f"regexp_replace(regexp_replace({packed}, '^:(?!:)', ''), '(?<!:):$', '')"
    six = let("j", f"concat(':', array_join({ipv6_groups_sql('c')}, ':'), ':')", trimmed)
    return let("c", text, f"if({is_ipv4_sql('c')}, c, {six})")


def canonical_ip(text: str) -> Column:
    return F.expr(canonical_ip_sql(text))


def in_blocks_sql(addr: str, blocks) -> str:
    """Whether an ``address`` struct lies in one of the literal blocks."""
    tests = []
    for cidr in blocks:
        net = ipaddress.ip_network(cidr)
        tests.append(f"({addr}.family = {net.version} and {addr}.key between "
                     f"'{int(net[0]):032x}' and '{int(net[-1]):032x}')")
    return "(" + " or ".join(tests) + ")"


def private_sql(addr: str) -> str:
    return (f"({in_blocks_sql(addr, PRIVATE_V4 + PRIVATE_V6)} and not "
            f"{in_blocks_sql(addr, PUBLIC_V4 + PUBLIC_V6)})")


def is_private(text: str) -> Column:
    return F.expr(let("s", address_sql(text), private_sql("s")))


def is_loopback(text: str) -> Column:
    return F.expr(let("s", address_sql(text), in_blocks_sql("s", LOOPBACK)))


def is_multicast(text: str) -> Column:
    return F.expr(let("s", address_sql(text), in_blocks_sql("s", MULTICAST)))


def is_site_local_v4(text: Column) -> Column:
    """Organisation-internal IPv4, by one pattern (the hot path)."""
    return F.coalesce(text.rlike(SITE_LOCAL_V4), F.lit(False))


def unfolded(df: DataFrame, struct: Column) -> DataFrame:
    """Append the fields of a costly struct as columns, all null where it is null.

    A generator's output is computed once: the optimizer neither copies the
    expression into later projections nor pushes filters on it into the scan.
    """
    return df.select("*", F.inline_outer(F.array(struct)))


def prefix_key_sql(key: str, family: str, prefix: str) -> str:
    """The key with all bits beyond ``prefix`` cleared."""
    keep = f"{prefix} + if({family} = 4, 96, 0)"
    nibble = f"cast(conv(substr({key}, keep div 4 + 1, 1), 16, 10) as int) & element_at(array(0, 8, 12, 14), keep % 4 + 1)"
    return let("keep", f"cast({keep} as int)",
               f"rpad(concat(substr({key}, 1, cast(keep div 4 as int)), if(keep % 4 = 0, '', lower(hex({nibble})))), 32, '0')")


def prefix_key(key: str, family: str, prefix: str) -> Column:
    return F.expr(prefix_key_sql(key, family, prefix))


def parse_cidr_sql(text: str) -> str:
    """``struct(family, prefix, network)``, host bits cleared; null when malformed."""
    inverted = f"4294967295 - {ipv4_number_sql('m.mask')}"
    dotted = let("inv", inverted, "if(m.addr.family = 4 and (inv & (inv + 1)) = 0, 32 - bit_count(inv), null)")
    width = "if(m.addr.family = 4, 32, 128)"
    prefix = (f"cast(case when m.mask is null then {width} when m.mask rlike '^[0-9]{{1,3}}$' then "
              f"try_cast(m.mask as int) else {dotted} end as int)")
    net = let("px", prefix, f"if(m.addr is not null and m.n <= 2 and px between 0 and {width}, struct("
                            f"m.addr.family as family, px as prefix, "
                            f"{prefix_key_sql('m.addr.key', 'm.addr.family', 'px')} as network), null)")
    parts = f"struct({address_sql('pieces[0]')} as addr, get(pieces, 1) as mask, size(pieces) as n)"
    body = let("pieces", f"split({text}, '/')", let("m", parts, net))
    return f"if({text} is null, null, {body})"


def parse_cidr(text: str) -> Column:
    return F.expr(parse_cidr_sql(text))


def key_to_ip_sql(key: str, family: str) -> str:
    octets = ", ".join(f"cast(shiftright(num, {s}) & 255 as string)" for s in (24, 16, 8, 0))
    four = let("num", f"cast(conv(substr({key}, 25, 8), 16, 10) as bigint)", f"concat_ws('.', {octets})")
    groups = ", ".join(f"substr({key}, {1 + 4 * i}, 4)" for i in range(8))
    six = canonical_ip_sql(f"concat_ws(':', {groups})")
    return f"if({family} = 4, {four}, {six})"


def render_cidr_sql(net: str) -> str:
    return f"concat({key_to_ip_sql(net + '.network', net + '.family')}, '/', cast({net}.prefix as string))"
