"""Text, markup, codes, numbers and dates over columns, beyond scalars: expressions where they do, small Arrow functions of the standard library where none exists."""

from __future__ import annotations

import base64
import binascii
import difflib
import html
import json
import math
import mimetypes
import operator
import shlex
import struct
import tomllib
import unicodedata
import urllib.parse
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(f: Callable[..., Any], kind: str, *columns: Column) -> Column:
    """f over the rows' values; null where a value is null or f fails on it."""

    def one(*values: Any) -> Any:
        if any(v is None for v in values):
            return None
        try:
            return f(*values)
        except (ValueError, TypeError, LookupError, struct.error, OverflowError):
            return None

    if len(columns) == 1:
        return F.pandas_udf(lambda a: pd.Series([one(x) for x in a], dtype=object), kind)(columns[0])
    return F.pandas_udf(lambda a, b: pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object), kind)(*columns)


# Text


def wrapped(x: Column, width: int = 70) -> Column:
    """Lines of at most `width` characters, broken between words; a longer word is a line of its own."""
    words = F.filter(F.split(x, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")

    def step(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = (F.size(lines) > 0) & (F.length(F.coalesce(F.get(lines, F.size(lines) - 1), F.lit(""))) + 1 + F.length(word) <= width)
        return F.when(fits, F.concat(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, word)))).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(words, F.array().cast("array<string>"), step)


def filled(x: Column, width: int = 70) -> Column:
    return F.array_join(wrapped(x, width), "\n")


def template(x: Column, values: Column) -> Column:
    """$name and ${name} replaced by a map's values, $$ by a dollar; what the map lacks stays."""
    parts = F.regexp_extract_all(x, F.lit(r"(\$\$|\$\{[A-Za-z_]\w*\}|\$[A-Za-z_]\w*|[^$]+|\$)"), 1)

    def put(p: Column) -> Column:
        name = F.regexp_extract(p, r"^\$\{?([A-Za-z_]\w*)\}?$", 1)
        return F.when(p == "$$", "$").when(name != "", F.coalesce(F.try_element_at(values, name), p)).otherwise(p)

    return F.array_join(F.transform(parts, put), "")


def ratio(a: Column, b: Column) -> Column:
    """Likeness of two texts: twice the characters in their matching blocks over all (1 of two empty ones)."""
    return _each(lambda x, y: difflib.SequenceMatcher(None, x, y, autojunk=False).ratio(), "double", a, b)


def close_matches(x: Column, possibilities: list[str], n: int = 3, cutoff: float = 0.6) -> Column:
    """The n possibilities that are most like x, at least to the cutoff; the lesser text first among equals."""

    def best(word: str) -> list[str]:
        scored = [(difflib.SequenceMatcher(None, word, p, autojunk=False).ratio(), p) for p in possibilities]
        return [p for r, p in sorted(scored, key=lambda s: (-s[0], s[1])) if r >= cutoff][:n]

    return _each(best, "array<string>", x)


def unified_diff(a: Column, b: Column, context: int = 3) -> Column:
    """Lines of a unified difference of two texts, without file names."""

    def lines(x: str, y: str) -> list[str]:
        return list(difflib.unified_diff(x.splitlines(), y.splitlines(), lineterm="", n=context))[2:]

    return _each(lines, "array<string>", a, b)


def category(x: Column) -> Column:
    """Unicode category of a text's first character."""
    return _each(lambda t: unicodedata.category(t[0]), "string", x)


def normalized(x: Column, form: str = "NFC") -> Column:
    return _each(lambda t: unicodedata.normalize(form, t), "string", x)


# Regular expressions (Java's syntax)


def matched(x: Column, pattern: str) -> Column:
    """struct<found, start, end> of the first match; positions in characters from 0, null without one."""
    before = F.length(F.get(F.split(x, pattern, 2), 0))
    found = F.get(F.regexp_extract_all(x, F.lit(pattern), 0), 0)
    return F.when(found.isNotNull(), F.struct(found.alias("found"), before.alias("start"), (before + F.length(found)).alias("end")))


def fully_matches(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(rf"\A(?:{pattern})\z"))


# CSV


def csv_fields(x: Column, delimiter: str = ",") -> Column:
    """Fields of a line: quoted ones may hold the delimiter and doubled quotes; what follows a closing quote is dropped."""
    d = "\\" + delimiter
    field = rf'(?:^|{d})("(?:[^"]|"")*"[^{d}]*|[^{d}]*)'
    plain = lambda f: F.when(F.startswith(f, F.lit('"')), F.replace(F.regexp_extract(f, r'(?s)^"((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(F.regexp_extract_all(x, F.lit(field), 1), plain)


def csv_line(fields: Column, delimiter: str = ",") -> Column:
    """A line of fields, quoted where they hold the delimiter, a quote or a line's end; null as an empty field."""
    quote = lambda f: F.when(F.regexp_like(f, F.lit(f"[\"\r\n\\{delimiter}]")), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(f, F.lit("")))
    return F.array_join(F.transform(fields, quote), delimiter)


# JSON, TOML, XML


def json_sorted(x: Column) -> Column:
    """A JSON text with sorted keys and without blanks; null if it is none."""
    return F.to_json(F.try_parse_json(x))


def toml_json(x: Column) -> Column:
    """A TOML text as JSON (dates as texts); null if it is none."""
    return _each(lambda t: json.dumps(tomllib.loads(t), default=str), "string", x)


def xml_texts(x: Column, path: str) -> Column:
    """Texts at an XPath."""
    return F.xpath(x, F.lit(path))


# URLs and HTML


def urlencoded(values: Column) -> Column:
    """A query string of a map, in its order; blanks become plus signs."""
    return F.array_join(F.transform(F.map_entries(values), lambda e: F.concat_ws("=", F.url_encode(e["key"]), F.url_encode(e["value"]))), "&")


def query_values(x: Column) -> Column:
    """map<string, array<string>> of a query string: values in order, names without a value left out."""
    decoded = lambda t: F.coalesce(F.try_url_decode(t), t)
    pairs = F.filter(F.transform(F.split(x, "&"), lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("v"))), lambda p: p["v"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))


def url_joined(base: Column, reference: Column) -> Column:
    """A reference resolved against a base address."""
    return _each(urllib.parse.urljoin, "string", base, reference)


def html_unescaped(x: Column) -> Column:
    return _each(html.unescape, "string", x)


def html_tags(x: Column) -> Column:
    """Names of start tags, in order, in small letters; comments, scripts and styles hold none."""
    bare = F.regexp_replace(F.regexp_replace(x, "(?s)<!--.*?-->", ""), r"(?is)(<(script|style)\b[^>]*>).*?</\2\s*>", "$1")
    return F.transform(F.regexp_extract_all(bare, F.lit(r"<([A-Za-z][A-Za-z0-9-]*)\b[^>]*>"), 1), F.lower)


def html_text(x: Column) -> Column:
    """What stands between tags, entities resolved, white space as it is; without comments, scripts and styles."""
    bare = F.regexp_replace(F.regexp_replace(x, "(?s)<!--.*?-->", ""), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    return html_unescaped(F.regexp_replace(bare, r"(?s)</?[A-Za-z][^>]*>|<![^>]*>", ""))


# Codes


def base85(x: Column) -> Column:
    return _each(lambda b: base64.b85encode(bytes(b)).decode(), "string", x)


def from_base85(x: Column) -> Column:
    """Bytes of a base 85 text; null if it is none."""
    return _each(base64.b85decode, "binary", x)


def crc_hqx(x: Column) -> Column:
    """CRC-16 (polynomial 0x1021, from 0) of bytes."""
    return _each(lambda b: binascii.crc_hqx(bytes(b), 0), "int", x)


def packed(form: str, values: Column) -> Column:
    """Bytes of an array of whole numbers in a format such as "<HI"; null if they do not fit."""
    return _each(lambda v: struct.pack(form, *map(int, v)), "binary", values)


def unpacked(form: str, data: Column) -> Column:
    """The whole numbers in bytes of a format; null if the length differs."""
    return _each(lambda b: list(struct.unpack(form, bytes(b))), "array<bigint>", data)


def uuid3(namespace: str, name: Column) -> Column:
    """Name-based UUID (MD5) in a namespace given as a UUID string."""
    digest = F.md5(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    part = lambda at, n: F.substring(digest, at, n)
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("3"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def shell_words(x: Column) -> Column:
    """Words of a command line; null with an open quote."""
    return _each(shlex.split, "array<string>", x)


def mime_type(x: Column) -> Column:
    """MIME type by a path's or URL's ending, of a fixed table (none of the machine's own); null for others."""
    table = mimetypes.MimeTypes(filenames=())
    return _each(lambda t: table.guess_type(t)[0], "string", x)


# Numbers


def quantized(x: Column, digits: int, mode: str = "half_even") -> Column:
    """A decimal rounded to digits after the point: half_even, half_up, ceiling, floor, or down (towards zero)."""
    rounded = {"half_even": F.bround, "half_up": F.round}
    if mode in rounded:
        return rounded[mode](x, digits)
    scale = F.lit(10**digits).cast("decimal(20,0)")
    whole = {"ceiling": F.ceil(x * scale), "floor": F.floor(x * scale), "down": F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale))}[mode]
    return (whole.cast("decimal(38,0)") / scale).cast(f"decimal(38,{digits})")


def fraction(numerator: Column, denominator: Column) -> Column:
    """struct<num, den> in lowest terms with a positive denominator; null with a denominator of 0."""
    from lodemill.functions.scalars import gcd

    g = F.nullif(gcd(numerator, denominator), F.lit(0))
    sign = F.when(denominator < 0, -1).otherwise(1)
    part = lambda n: (sign * n / g).cast("bigint")
    return F.when(denominator != 0, F.struct(part(numerator.cast("decimal(20,0)")).alias("num"), part(denominator.cast("decimal(20,0)")).alias("den")))


def fraction_sum(a: Column, b: Column) -> Column:
    return fraction(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def fraction_product(a: Column, b: Column) -> Column:
    return fraction(a["num"] * b["num"], a["den"] * b["den"])


def permutations_of(n: Column, k: Column) -> Column:
    """How many ordered choices of k out of n there are, exactly while it fits 64 bits."""
    steps = F.when(k > 0, F.sequence((n - k + 1).cast("bigint"), n.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.when((k < 0) | (k > n), F.lit(0).cast("bigint")).otherwise(F.aggregate(steps, F.lit(1).cast("bigint"), lambda acc, i: acc * i))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of numbers of one length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, d: acc + d.cast("double")))


def normal_share(x: Column, mean: float, deviation: float) -> Column:
    """The share of a normal distribution that is at most x."""
    return _each(lambda v: 0.5 * (1 + math.erf((v - mean) / (deviation * math.sqrt(2)))), "double", x)


def plain_number(x: Column, grouping: str = ",", point: str = ".") -> Column:
    """A number written with grouping marks as a double; null if it is none."""
    return F.replace(F.replace(F.trim(x), F.lit(grouping), F.lit("")), F.lit(point), F.lit(".")).try_cast("double")


#: Operators on columns by name.
OPERATORS: dict[str, Callable[..., Column]] = {
    "add": operator.add, "sub": operator.sub, "mul": operator.mul, "truediv": operator.truediv, "mod": operator.mod, "neg": operator.neg, "eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt,
    "ge": operator.ge, "and_": operator.and_, "or_": operator.or_, "not_": operator.invert, "floordiv": lambda a, b: F.floor(a / b), "concat": F.concat, "contains": F.array_contains, "getitem": F.get, "countOf": lambda a, b: F.size(F.filter(a, lambda x: x == b)),
    "indexOf": lambda a, b: F.nullif(F.array_position(a, b), F.lit(0)) - 1,
}


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """struct<h, s, v> of shares of red, green and blue, all from 0 to 1."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif(high - low, F.lit(0.0))
    rc, gc, bc = ((high - c) / span for c in (r, g, b))
    h = F.when(r == high, bc - gc).when(g == high, 2.0 + rc - bc).otherwise(4.0 + gc - rc)
    return F.struct(F.coalesce(F.pmod(h / 6.0, F.lit(1.0)), F.lit(0.0)).alias("h"), F.coalesce(span / high, F.lit(0.0)).alias("s"), high.alias("v"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """struct<r, g, b> of hue, saturation and value, all from 0 to 1."""
    sector = F.floor(h * 6.0)
    f = h * 6.0 - sector
    p, q, t = v * (1.0 - s), v * (1.0 - s * f), v * (1.0 - s * (1.0 - f))
    cases = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    out = F.struct(*[c.alias(n) for c, n in zip(cases[5], "rgb", strict=True)])
    for i in range(5):
        out = F.when(F.pmod(sector, F.lit(6)) == i, F.struct(*[c.alias(n) for c, n in zip(cases[i], "rgb", strict=True)])).otherwise(out)
    return F.when(s == 0.0, F.struct(v.alias("r"), v.alias("g"), v.alias("b"))).otherwise(out)


# Dates


def month_range(year: Column, month: Column) -> Column:
    """struct<weekday, days> of a month: the weekday of its first day (0: Monday) and its days."""
    first = F.make_date(year, month, F.lit(1))
    return F.struct(F.weekday(first).alias("weekday"), F.dayofmonth(F.last_day(first)).alias("days"))


def utc_fields(seconds: Column) -> Column:
    """struct of a time's year, month, day, hour, minute, second, weekday (0: Monday) and day of the year in UTC; seconds since 1970."""
    days, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    d = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))
    part = lambda n, of: F.floor(F.pmod(rest, F.lit(of)) / n).cast("int")
    return F.struct(F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"), part(3600, 86400).alias("hour"), part(60, 3600).alias("minute"), part(1, 60).alias("second"), F.weekday(d).alias("weekday"), F.dayofyear(d).alias("yearday"))


def from_utc_fields(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Seconds since 1970 of a time in UTC."""
    return F.datediff(F.make_date(year, month, day), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + hour * 3600 + minute * 60 + second
