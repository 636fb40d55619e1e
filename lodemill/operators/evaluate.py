"""Evaluation of invariants whose facts are data: constants, known digests, captured outputs of commands."""

from __future__ import annotations

import base64
import importlib
import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def constants_hold(wanted: DataFrame, constants: DataFrame) -> DataFrame:
    """wanted(spec, id, name, expected_value) with passed and message, against constants(spec, name, value).

    An unknown constant fails, and so does a null value, expected or found. Of a constant given several times any
    one value may be the expected one; every wanted row gives one row.
    """
    known = constants.groupBy("spec", "name").agg(F.collect_set("value").alias("_values"))
    joined = wanted.join(known, ["spec", "name"], "left")
    passed = F.coalesce(F.array_contains("_values", F.col("expected_value")), F.lit(False))
    message = F.when(passed, "equal").when(F.col("_values").isNull(), "unknown constant").otherwise("another value")
    return joined.select(*wanted.columns, passed.alias("passed"), message.alias("message"))


def digest(algorithm: Column, data: Column) -> Column:
    """Hexadecimal digest of bytes by a named algorithm (md5, sha1, sha224 to sha512), in small letters; null for others."""
    out = F.when(algorithm == "md5", F.md5(data)).when(algorithm == "sha1", F.sha1(data))
    for bits in (224, 256, 384, 512):
        out = out.when(algorithm == f"sha{bits}", F.sha2(data, bits))
    return out


def known_digest(algorithm: Column, data: Column, expected: Column) -> Column:
    """Whether the digest of bytes (null: none) is the expected one; an unknown algorithm fails."""
    return F.coalesce(digest(algorithm, F.coalesce(data, F.lit(b""))) == expected, F.lit(False))


def same_in_parts(algorithm: Column, parts: Column, expected: Column) -> Column:
    """Whether the digest of byte parts put together is the expected one."""
    whole = F.unhex(F.array_join(F.transform(parts, F.hex), ""))
    return known_digest(algorithm, whole, expected)


def copy_independent(algorithm: Column, data: Column, more: Column, expected: Column, expected_more: Column) -> Column:
    """Whether a digest is the expected one, and that of its copy, fed with more bytes, the other expected one: the first must not have changed by it."""
    return known_digest(algorithm, data, expected) & known_digest(algorithm, F.concat(F.coalesce(data, F.lit(b"")), F.coalesce(more, F.lit(b""))), expected_more)


def two_ways(algorithm: Column, other: Column, data: Column) -> Column:
    """Whether two names of algorithms give one digest of the same bytes; an unknown one fails."""
    whole = F.coalesce(data, F.lit(b""))
    return F.coalesce(digest(F.lower(algorithm), whole) == digest(F.lower(other), whole), F.lit(False))


def output_holds(kind: Column, exit_code: Column, stdout: Column, stderr: Column, expected: Column, multiline: Column | bool = False) -> Column:
    """Whether a command's captured output is as an invariant of a cli_* kind expects; null for other kinds.

    expected is the exit code, the whole text (white space at the output's end apart), a part of it, or a regular
    expression (Java's syntax) that matches somewhere. What was not captured or expected (null) fails.
    """
    out, err = F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit(""))
    found = lambda mode: F.rlike(out, F.concat(F.lit(mode), expected))
    lines = F.lit(multiline) if isinstance(multiline, bool) else F.coalesce(multiline, F.lit(False))
    checks = {
        "cli_exits_with": exit_code == expected.try_cast("int"),
        "cli_stdout_eq": F.regexp_replace(out, r"(?U)\s+\z", "") == expected,
        "cli_stdout_contains": F.contains(out, expected),
        "cli_stdout_matches": F.when(lines, found("(?m)")).otherwise(found("")),
        "cli_stderr_contains": F.contains(err, expected),
    }
    result = F.lit(None).cast("boolean")
    for name, check in checks.items():
        result = F.when(kind == name, F.coalesce(check, F.lit(False))).otherwise(result)
    return result


#: Digest and block sizes of algorithms, in bytes.
HASH_SIZES = {"md5": (16, 64), "sha1": (20, 64), "sha224": (28, 64), "sha256": (32, 64), "sha384": (48, 128), "sha512": (64, 128)}


def hash_attribute(algorithm: Column, attribute: Column) -> Column:
    """name, digest_size or block_size of a hash object, as a text; null for others."""
    out = F.lit(None).cast("string")
    for name, (digest_size, block_size) in HASH_SIZES.items():
        of = F.when(attribute == "name", name).when(attribute == "digest_size", str(digest_size)).when(attribute == "block_size", str(block_size))
        out = F.when(algorithm == name, of).otherwise(out)
    return out


def digest_consistent(algorithm: Column, data: Column) -> Column:
    """Whether an algorithm's hexadecimal digest is as many bytes as it says; an unknown algorithm fails."""
    return F.coalesce((F.length(F.unhex(digest(algorithm, F.coalesce(data, F.lit(b""))))).cast("string") == hash_attribute(algorithm, F.lit("digest_size"))), F.lit(False))


#: What invariants may call: functions of Python modules that neither read nor write anything. No others are run.
CATALOGUE = {
    "math": ("gcd", "lcm", "factorial", "comb", "perm", "prod", "isclose", "floor", "ceil", "trunc", "sqrt", "log", "log2", "log10", "exp", "dist", "hypot", "isnan", "isinf", "fsum"),
    "statistics": ("mean", "fmean", "median", "median_low", "median_high", "mode", "multimode", "stdev", "pstdev", "variance", "pvariance", "geometric_mean", "harmonic_mean"),
    "base64": ("b64encode", "b64decode", "urlsafe_b64encode", "urlsafe_b64decode", "b32encode", "b32decode", "b16encode", "b16decode", "b85encode", "b85decode", "a85encode", "a85decode"),
    "binascii": ("hexlify", "unhexlify", "crc32", "crc_hqx", "b2a_base64", "a2b_base64"), "zlib": ("crc32", "adler32"), "struct": ("pack", "unpack", "calcsize"), "json": ("dumps", "loads"),
    "html": ("escape", "unescape"), "textwrap": ("wrap", "fill", "dedent", "indent", "shorten"), "string": ("capwords",), "shlex": ("split", "quote", "join"), "bisect": ("bisect_left", "bisect_right"),
    "urllib.parse": ("quote", "unquote", "quote_plus", "unquote_plus", "urlencode", "parse_qs", "parse_qsl", "urljoin"), "difflib": ("get_close_matches",), "fnmatch": ("fnmatchcase", "translate"),
    "posixpath": ("join", "basename", "dirname", "splitext", "normpath", "isabs", "commonprefix"), "unicodedata": ("name", "category", "normalize", "numeric"), "calendar": ("isleap", "leapdays", "monthrange", "weekday"),
    "colorsys": ("rgb_to_hsv", "hsv_to_rgb", "rgb_to_hls", "hls_to_rgb", "rgb_to_yiq", "yiq_to_rgb"), "ipaddress": ("ip_address", "ip_network"), "keyword": ("iskeyword",), "operator": ("add", "sub", "mul", "truediv", "floordiv", "mod", "eq", "ne", "lt", "le", "gt", "ge", "neg", "not_", "concat", "contains", "countOf", "indexOf"),
}
#: Attributes of modules whose members invariants may ask for.
SETS = {"hashlib": ("algorithms_guaranteed",), "keyword": ("kwlist",), "string": ("ascii_letters", "digits")}
#: Calls whose result would have more decimal digits are not made: neither passed nor failed.
DIGITS = 1_000_000


def _resolved(v: Any) -> Any:
    if not (isinstance(v, dict) and "type" in v):
        return v
    kind, held = v["type"], v.get("value")
    makers = {
        "bytes_b64": lambda: base64.b64decode(held or ""), "bytes_hex": lambda: bytes.fromhex(held or ""), "bytes_ascii": lambda: (held or "").encode("ascii"), "str": lambda: "" if held is None else str(held),
        "int": lambda: int(held), "float": lambda: float(held), "bool": lambda: bool(held), "null": lambda: None, "tuple": lambda: tuple(held or ()), "json": lambda: held,
    }
    return makers[kind]() if kind in makers else v


def _allowed(module: str, name: str) -> Any:
    if name not in CATALOGUE.get(module, ()):
        raise LookupError(f"{module}.{name} is not in the catalogue")
    return getattr(importlib.import_module(module), name)


def _digits(name: str, args: list) -> float:
    """About how many decimal digits factorial, comb and perm of small numbers would make; 0 for all other calls, whose results are no longer than their arguments."""
    if name not in ("factorial", "comb", "perm") or not args or not all(isinstance(a, int) and a >= 0 for a in args):
        return 0.0
    n, k = args[0], args[1] if len(args) > 1 else args[0]
    if name == "comb":
        k = min(k, n - k)
    if k <= 0:
        return 0.0
    if n > 2**53:
        return min(k, 2**53) * (n.bit_length() - 1) * math.log10(2) - (math.lgamma(k + 1) / math.log(10) if name == "comb" and k < 2**53 else 0)
    made = math.lgamma(n + 1) - math.lgamma(max(n - k, 0) + 1) - (math.lgamma(k + 1) if name == "comb" else 0)
    return made / math.log(10)


def _evaluated(module: str, kind: str, body: dict) -> tuple[bool, str]:
    if kind in ("python_call_eq", "python_call_raises"):
        f = _allowed(module, body["function"])
        args, named = [_resolved(a) for a in body.get("args", [])], {k: _resolved(v) for k, v in body.get("kwargs", {}).items()}
        if module == "math" and _digits(body["function"], args) > DIGITS:
            raise LookupError(f"not called: the result has more than {DIGITS} digits")
        try:
            result = f(*args, **named)
        except Exception as e:  # noqa: BLE001, whatever a function raises is its result
            names = {t.__name__ for t in type(e).__mro__} | {f"{t.__module__}.{t.__qualname__}" for t in type(e).__mro__[:1]}
            wanted = body.get("expected_exception")
            good = kind == "python_call_raises" and (wanted in names or any(n.endswith(f".{wanted}") for n in names) or str(wanted).rpartition(".")[2] == type(e).__name__)
            return good, f"raised {type(e).__name__}"
        if kind == "python_call_raises":
            return False, "returned without raising"
        expected = _resolved(body.get("expected"))
        as_list = lambda x, other: list(x) if isinstance(x, tuple) and isinstance(other, list) else x
        good = as_list(result, expected) == as_list(expected, result)
        return bool(good), "equal" if good else f"returned {result!r:.200}"
    if kind == "python_encode_decode_roundtrip":
        encode, decode = _allowed(module, body["encode_fn"]), _allowed(module, body["decode_fn"])
        bad = [x for x in body["inputs_b64"] if decode(encode(base64.b64decode(x or ""))) != base64.b64decode(x or "")]
        return not bad, "equal" if not bad else f"{len(bad)} inputs changed"
    if kind == "python_struct_roundtrip":
        pack, unpack = _allowed("struct", "pack"), _allowed("struct", "unpack")
        bad = [x for x in body.get("test_cases") or [body["values"]] if list(unpack(body["format"], pack(body["format"], *x))) != x]
        return not bad, "equal" if not bad else f"{len(bad)} cases changed"
    if kind == "python_set_contains":
        name = body["attribute"]
        if name not in SETS.get(module, ()):
            raise LookupError(f"{module}.{name} is not in the catalogue")
        missing = [x for x in body["must_contain"] if x not in getattr(importlib.import_module(module), name)]
        return not missing, "contains all" if not missing else f"missing: {missing}"
    raise LookupError(f"kind {kind} is not evaluated")


def _rows(modules: pd.Series, kinds: pd.Series, bodies: pd.Series) -> pd.DataFrame:
    out = []
    for module, kind, body in zip(modules, kinds, bodies, strict=True):
        try:
            out.append(_evaluated(module or "", kind or "", json.loads(body or "{}")))
        except LookupError as e:
            out.append((None, str(e)))
        except Exception as e:  # noqa: BLE001, a broken invariant fails and says why
            out.append((False, f"{type(e).__name__}: {e!s:.200}"))
    return pd.DataFrame(out, columns=["passed", "message"])


def python_holds(module: Column, kind: Column, body: Column) -> Column:
    """struct<passed, message> of invariants that call Python: python_call_eq and _raises, encode-decode and struct round trips, python_set_contains.

    body: the invariant's fields as JSON. Only functions of CATALOGUE are called; passed is null, and message says why, for
    others, for other kinds, and where the result would have more than DIGITS digits. An error is a failure with its name."""
    return F.pandas_udf(_rows, "passed boolean, message string")(module, kind, body)
