"""Scalar functions over columns: text, encoding, paths, URLs, addresses, dates, numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def capwords(x: Column) -> Column:
    """Words with a capital first letter and small others, one space between them."""
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")


def shorten(x: Column, width: int, mark: str = " [...]") -> Column:
    """White space collapsed; if too long, cut after a word so that text and mark fit the width."""
    flat = F.trim(F.regexp_replace(x, r"\s+", " "))
    room = max(0, width - len(mark))
    head = F.regexp_extract(F.concat(flat, F.lit(" ")), rf"^(?s)(.{{0,{room}}})(?= )", 1)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.rtrim(head), F.lit(mark if room else mark.strip())))


def indented(x: Column, prefix: str) -> Column:
    """The prefix before every line that is not blank."""
    return F.regexp_replace(x, r"(?m)^(?=.*\S)", prefix.replace("\\", "\\\\").replace("$", "\\$"))


def matches_glob(x: Column, pattern: str) -> Column:
    """Whether a shell pattern (* ? [set] [!set]) matches the whole of x."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inside = pattern[i + 1 : close]
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return x.rlike(f"(?s)^(?:{out})\\z")


def urlsafe_base64(x: Column) -> Column:
    return F.translate(F.base64(x.cast("binary")), "+/", "-_")


def adler32(x: Column) -> Column:
    """Adler-32 of a text's UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(x.cast("binary")), F.lit("(..)"), 1)
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(acc: Column, h: Column) -> Column:
        a = (acc["a"] + F.conv(h, 16, 10).cast("long")) % 65521
        return F.struct(a.alias("a"), ((acc["b"] + a) % 65521).alias("b"))

    return F.aggregate(pairs, start, step, lambda acc: acc["b"] * 65536 + acc["a"])


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """All before the last slash; the root of what lies in it; nothing without a slash."""
    head = F.regexp_extract(path, "^(?s)(.*)/", 1)
    return F.when((head == "") & F.startswith(path, F.lit("/")), "/").otherwise(head)


def extension(path: Column) -> Column:
    """The last suffix of the last part with its dot; leading dots start no suffix."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def without_tracking(url: Column) -> Column:
    """The URL without its fragment, without utm_ parameters and ref, host in small letters."""
    base = F.regexp_extract(url, "^[^?#]*", 0)
    host = url_host(url)
    lowered = F.concat(F.regexp_extract(base, r"^[^/]*//", 0), host, F.regexp_extract(base, r"^[^/]*//[^/]*(.*)$", 1))
    kept = F.filter(F.split(url_query(url), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)"))
    return F.concat(lowered, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def html_escaped(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def ipv4_number(x: Column) -> Column:
    """An address in four decimal parts as a number; null if it is none."""
    parts = F.transform(F.split(x, r"\."), lambda p: p.try_cast("bigint"))
    fine = x.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")
    return F.when(fine, F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p))


def in_network(x: Column, network: str) -> Column:
    """Whether an address lies in a network such as 10.0.0.0/8."""
    base, bits = network.split("/")
    size = 2 ** (32 - int(bits))
    low = 0
    for p in base.split("."):
        low = low * 256 + int(p)
    low -= low % size
    n = ipv4_number(x)
    return (n >= low) & (n < low + size)


def is_private_ipv4(x: Column) -> Column:
    return in_network(x, "10.0.0.0/8") | in_network(x, "172.16.0.0/12") | in_network(x, "192.168.0.0/16") | in_network(x, "127.0.0.0/8")


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole numbers, by at most 93 steps of Euclid's (64 bits)."""
    start = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(F.struct(acc["b"].alias("a"), F.pmod(acc["a"], F.nullif(acc["b"], F.lit(0))).alias("b"))), lambda acc: acc["a"])


def comb(n: Column, k: Column) -> Column:
    """n over k, exactly while it fits 64 bits."""
    least = F.least(k, n - k)
    steps = F.when(least > 0, F.sequence(F.lit(1).cast("long"), least.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when((k < 0) | (k > n), F.lit(0).cast("long")).otherwise(F.aggregate(steps, F.lit(1).cast("long"), lambda acc, i: (acc * (n.cast("long") - least.cast("long") + i)).cast("decimal(38,0)").cast("long").__truediv__(i).cast("long")))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (SHA-1) in a namespace given as a UUID string."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    part = lambda at, n: F.substring(digest, at, n)
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def _byte_pairs(x: Column) -> Column:
    """A binary value's bytes as two hexadecimal digits each."""
    return F.regexp_extract_all(F.hex(x), F.lit("(..)"), 1)


def base32(x: Column) -> Column:
    """Base32 of a binary value, padded."""
    bits = F.array_join(F.transform(_byte_pairs(x), lambda h: F.lpad(F.conv(h, 16, 2), 8, "0")), "")
    groups = F.regexp_extract_all(F.concat(bits, F.lit("0000")), F.lit("(.{5})"), 1)
    letters = F.array_join(F.transform(groups, lambda b: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(b, 2, 10).cast("int") + 1, F.lit(1))), "")
    return F.concat(letters, F.repeat(F.lit("="), F.pmod(-F.length(letters), F.lit(8))))


def hmac(key: Column, message: Column, bits: int = 256) -> Column:
    """Keyed digest of a binary message by SHA-2 of 224, 256, 384 or 512 bits, in hexadecimal."""
    block = 64 if bits <= 256 else 128
    short = F.when(F.length(key) > block, F.unhex(F.sha2(key, bits))).otherwise(key)
    padded = F.rpad(F.hex(short), 2 * block, "0")

    def masked(with_byte: int) -> Column:
        pairs = F.regexp_extract_all(padded, F.lit("(..)"), 1)
        return F.unhex(F.array_join(F.transform(pairs, lambda h: F.lpad(F.hex(F.conv(h, 16, 10).cast("int").bitwiseXOR(F.lit(with_byte))), 2, "0")), ""))

    return F.sha2(F.concat(masked(0x5C), F.unhex(F.sha2(F.concat(masked(0x36), message), bits))), bits)


def quoted(x: Column) -> Column:
    """Percent-encoded for a URL's path: letters, digits, _ . - ~ and / stay."""
    out = F.url_encode(x)
    for raw, wanted in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(raw), F.lit(wanted))
    return out


def unquoted(x: Column) -> Column:
    """Percent-encoding undone, a plus sign left as it is; null if it is malformed."""
    return F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def normal_path(x: Column) -> Column:
    """A path without empty parts, . and what .. undoes; of leading slashes one stays, or two if there are just two; a dot for nothing."""
    root = F.when(x.rlike("^//(?!/)"), "//").when(F.startswith(x, F.lit("/")), "/").otherwise("")

    def step(done: Column, part: Column) -> Column:
        undone = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        kept = F.when((part == "..") & (F.size(done) == 0) & (root != ""), done).otherwise(F.concat(done, F.array(part)))
        return F.when(part.isin("", "."), done).when(undone, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(kept)

    parts = F.aggregate(F.split(x, "/"), F.array().cast("array<string>"), step)
    whole = F.concat(root, F.array_join(parts, "/"))
    return F.when(x.isNotNull(), F.when(whole == "", ".").otherwise(whole))


def dedented(x: Column) -> Column:
    """Lines without the blanks and tabs that begin all lines that hold more; lines of nothing else become empty."""
    lines = F.transform(F.split(x, "\n", -1), lambda s: F.when(s.rlike(r"^[ \t]+$"), "").otherwise(s))
    starts = F.transform(F.filter(lines, lambda s: s != ""), lambda s: F.regexp_extract(s, r"^[ \t]*", 0))
    low, high = F.coalesce(F.array_min(starts), F.lit("")), F.coalesce(F.array_max(starts), F.lit(""))
    margin = F.array_max(F.filter(F.sequence(F.lit(0), F.length(low)), lambda n: F.substring(low, F.lit(1), n) == F.substring(high, F.lit(1), n)))
    return F.array_join(F.transform(lines, lambda s: F.substring(s, margin + 1, F.greatest(F.length(s) - margin, F.lit(0)))), "\n")


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple; 0 if one is 0."""
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(F.try_divide(a.cast("decimal(38,0)") * b.cast("long"), gcd(a, b).cast("decimal(20,0)"))).cast("long"))


def normal_density(x: Column, mean: float, deviation: float) -> Column:
    """Density of a normal distribution."""
    z = (x - F.lit(mean)) / F.lit(deviation)
    return F.exp(-z * z / 2) / (F.lit(deviation) * F.sqrt(2 * F.pi()))


def is_close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 0.0) -> Column:
    """Whether two numbers differ by at most the relative part of the larger, or the absolute bound; infinities are close to themselves alone."""
    infinite = F.abs(a).isin(float("inf")) | F.abs(b).isin(float("inf"))
    near = F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * relative, F.lit(absolute))
    return (a == b) & ~F.isnan(a) | (near & ~infinite & ~F.isnan(a) & ~F.isnan(b))
