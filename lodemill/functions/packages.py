"""Names, licences, versions and repository URLs of packages, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Starts of permissive licence names, and parts that mark copyleft ones.
PERMISSIVE = ("MIT", "BSD", "Apache", "ISC", "0BSD", "Unlicense", "Zlib", "OpenSSL", "curl", "PSF", "Python-")
COPYLEFT = ("GPL", "AGPL", "LGPL", "COPYLEFT")


def _one_licence(name: Column) -> Column:
    bad, good = F.lit(False), F.lit(False)
    for c in COPYLEFT:
        bad = bad | F.contains(F.upper(name), F.lit(c))
    for p in PERMISSIVE:
        good = good | F.startswith(name, F.lit(p))
    return F.when(bad, False).when(good, True)  # else null: unknown


def permissive(expression: Column) -> Column:
    """True, False (copyleft) or null (unknown) of a licence expression.

    Of alternatives (OR) one permissive is enough, else one copyleft decides; of parts (AND) one copyleft is
    too many, else all must be permissive. OR binds weaker than AND. exists() and forall() are three-valued.
    """
    parts = lambda x, word: F.filter(F.transform(F.split(x, rf"\s(?i:{word})\s"), lambda p: F.trim(p)), lambda p: p != "")

    def all_of(x: Column) -> Column:
        each = F.transform(parts(x, "AND"), _one_licence)
        return F.when(F.exists(each, lambda r: r.eqNullSafe(False)), False).when(F.forall(each, lambda r: r.eqNullSafe(True)), True)

    each = F.transform(parts(expression, "OR"), all_of)
    return F.when(expression.isNull() | (F.trim(expression) == ""), F.lit(None).cast("boolean")).when(F.exists(each, lambda r: r.eqNullSafe(True)), True).when(F.exists(each, lambda r: r.eqNullSafe(False)), False)


def pypi_name(name: Column) -> Column:
    return F.translate(F.lower(name), "_", "-")


def npm_name(name: Column) -> Column:
    """@scope/name as scope__name."""
    return F.regexp_replace(F.regexp_replace(name, "^@", ""), "/", "__")


def cargo_name(name: Column) -> Column:
    return F.translate(name, "_", "-")


def requirement_name(requirement: Column) -> Column:
    """The package a dependency specifier names: what stands before markers, extras and versions."""
    return F.regexp_extract(F.trim(F.split_part(requirement, F.lit(";"), F.lit(1))), r"^[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?", 0)


def repository_url(url: Column) -> Column:
    """https address of a repository: git+ and .git go, git:// and github: and owner/repo are spelled out."""
    u = F.regexp_replace(F.trim(url), r"^git\+", "")
    u = F.regexp_replace(u, "^(git|ssh)://(git@)?", "https://")
    u = F.regexp_replace(u, "^git@github[.]com:", "https://github.com/")
    u = F.regexp_replace(u, "^github:", "https://github.com/")
    u = F.when(F.regexp_like(u, F.lit(r"^[\w.-]+/[\w.-]+$")), F.concat(F.lit("https://github.com/"), u)).otherwise(u)
    return F.regexp_replace(u, r"\.git(?=$|#)", "")


#: A version after the common scheme: epoch, release numbers, and marks before, after or in development of a release.
_VERSION = (
    r"(?i)^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?([0-9]*))?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+[a-z0-9]+(?:[-_.][a-z0-9]+)*)?\s*$"
)
_LAST = 2**62


def is_version(version: Column) -> Column:
    return F.coalesce(version.rlike(_VERSION), F.lit(False))


def _part(version: Column, group: int) -> Column:
    return F.regexp_extract(version, _VERSION, group)


def _number(version: Column, group: int, default: int = 0) -> Column:
    return F.coalesce(F.nullif(_part(version, group), F.lit("")).try_cast("bigint"), F.lit(default).cast("bigint"))


def release(version: Column) -> Column:
    """A version's release numbers as an array."""
    return F.transform(F.split(_part(version, 2), r"\."), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0)))


def _padded(numbers: Column, n: Column) -> Column:
    return F.concat(numbers, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(n - F.size(numbers), F.lit(0))))


def _marks(version: Column) -> list[Column]:
    """(phase, number, post, development) so that versions of one release compare as numbers do: alpha 0, beta 1, candidate 2, release 3."""
    pre, dev = F.lower(_part(version, 3)), _part(version, 8) != ""
    has_post = (_part(version, 5) != "") | (_part(version, 6) != "")
    phase = F.when(pre.isin("a", "alpha"), 0).when(pre.isin("b", "beta"), 1).when(pre != "", 2).when(dev & ~has_post, -1).otherwise(3)
    post = F.when(_part(version, 5) != "", _number(version, 5)).when(has_post, _number(version, 7)).otherwise(F.lit(-1))
    return [phase.cast("bigint"), _number(version, 4), post.cast("bigint"), F.when(dev, _number(version, 9)).otherwise(F.lit(_LAST))]


def is_prerelease(version: Column) -> Column:
    return is_version(version) & ((_part(version, 3) != "") | (_part(version, 8) != ""))


def version_key(version: Column, parts: int | Column = 6) -> Column:
    """A version as an array that compares as versions do to others of as many release numbers: epoch, release padded with zeros to `parts`, marks."""
    n = F.lit(parts) if isinstance(parts, int) else parts
    return F.concat(F.array(_number(version, 1)), _padded(release(version), n), F.array(*_marks(version)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value worked out once."""
    return F.transform(F.array(value), then)[0]


def _facts(version: Column) -> Column:
    """A version as struct<known, epoch, release, marks, early, late, local>: what comparisons ask of it."""
    early = (_part(version, 3) != "") | (_part(version, 8) != "")
    late = (_part(version, 5) != "") | (_part(version, 6) != "")
    fields = {"known": is_version(version), "epoch": _number(version, 1), "release": release(version), "marks": F.array(*_marks(version)), "early": early, "late": late, "local": F.contains(version, F.lit("+"))}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


#: A clause: an operator and what follows it, from its first character to its last.
_CLAUSE = r"^(~=|<=|>=|==|!=|<|>)\s*(\S+)$"


def clauses(constraint: str | Column) -> Column:
    """A constraint's clauses (by comma or space) as array<struct<operator, prefix, size, to>>; one that can't be read has a null operator.

    prefix: == or != with .* at the end; size: the release numbers that are written; to: facts of the version."""
    text = F.trim(F.lit(constraint) if isinstance(constraint, str) else constraint)
    parts = F.filter(F.split(text, r"[,\s]+(?=[<>=!~^])"), lambda x: x != "")

    def read(part: Column) -> Column:
        part = F.trim(F.regexp_replace(F.trim(part), r",+\s*$", ""))
        operator, wanted = F.regexp_extract(part, _CLAUSE, 1), F.regexp_extract(part, _CLAUSE, 2)
        prefix = F.endswith(wanted, F.lit(".*"))
        bare = F.when(prefix, F.substring(wanted, F.lit(1), F.length(wanted) - 2)).otherwise(wanted)
        size = F.size(release(bare))
        good = F.when(prefix, operator.isin("==", "!=") & F.regexp_like(bare, F.lit(r"^v?[0-9]+(\.[0-9]+)*$"))).otherwise(is_version(bare) & ((operator != "~=") | (size >= 2)))
        return F.struct(F.when(good & (operator != ""), operator).alias("operator"), prefix.alias("prefix"), size.alias("size"), _facts(bare).alias("to"))

    return F.transform(parts, read)


def _meets(own: Column, clause: Column) -> Column:
    to, operator, size = clause["to"], clause["operator"], clause["size"]
    longer = F.greatest(F.size(own["release"]), F.size(to["release"]))
    same_epoch = own["epoch"] == to["epoch"]
    mine, other = _padded(own["release"], longer), _padded(to["release"], longer)
    key, bound = F.struct(own["epoch"], mine, own["marks"]), F.struct(to["epoch"], other, to["marks"])
    same_release = same_epoch & (mine == other)
    begins = lambda n: same_epoch & (F.slice(_padded(own["release"], n), 1, n) == F.slice(to["release"], 1, n))
    # what precedes a release is no earlier version of it, and what follows it no later one, unless the bound itself does
    return (
        F.when(clause["prefix"], begins(size) == (operator == "==")).when(operator == "~=", (key >= bound) & begins(size - 1)).when(operator == "<", (key < bound) & (to["early"] | ~(same_release & own["early"])))
        .when(operator == ">", (key > bound) & (to["late"] | ~(same_release & (own["marks"][2] >= 0))) & ~(own["local"] & same_release))
        .when(operator == "<=", key <= bound).when(operator == ">=", key >= bound).when(operator == "==", key == bound).when(operator == "!=", key != bound)
    )


def satisfies(version: Column, constraint: str | Column) -> Column:
    """Whether a version meets all clauses (~=, <=, >=, ==, !=, <, >, by comma or space; == and != with .* too); null with an unreadable one.

    The constraint is a text or a column: each row may have its own, and the expression is the same for any number of them.
    A null or empty constraint or one that starts with N/A holds always, and so does any for a version that is null, empty or
    can't be read. Candidates and other versions before a release precede it and meet what their place in the order meets.
    """
    text = F.coalesce(F.lit(constraint) if isinstance(constraint, str) else constraint, F.lit(""))
    free = F.regexp_like(text, F.lit(r"(?i)^\s*(N/A|$)"))
    # both are bound once; the clauses are a constant where the constraint is
    judged = _let(F.struct(_facts(version).alias("own"), clauses(text).alias("all")), lambda x: F.when(F.exists(x["all"], lambda c: c["operator"].isNull()), F.lit(None).cast("boolean"))
                  .when(~x["own"]["known"], True).otherwise(F.forall(x["all"], lambda c: _meets(x["own"], c))))
    return F.when(free, True).otherwise(judged)


def confidence(n_found: Column, base: float, span: float, warned: Column, factor: float = 0.95, of: int = 6) -> Column:
    """base + n_found / of x span, times factor where warned; two decimals, half up, on decimals."""
    raw = F.round((F.lit(base) + n_found / F.lit(of) * F.lit(span)).cast("decimal(12,8)"), 2)
    return F.when(warned, F.round(raw * F.lit(factor).cast("decimal(6,4)"), 2)).otherwise(raw).cast("double")


#: The language that a specification of each backend is written in; none given counts as ctypes, others as Python.
BACKEND_LANGUAGES = {
    "python_module": "python", "rust_module": "rust", "python_cleanroom": "python_cleanroom", "node_cleanroom": "node_cleanroom", "ctypes": "c", "node": "javascript",
}


def backend_language(backend: Column, command: Column | None = None) -> Column:
    """Language of a specification's backend; of a command line's it is JavaScript where the command is node."""
    out = F.lit("python")
    for k, v in BACKEND_LANGUAGES.items():
        out = F.when(backend == k, v).otherwise(out)
    node = F.lit(False) if command is None else F.coalesce(command == "node", F.lit(False))
    return F.when(backend.isNull(), "c").when((backend == "cli") & node, "javascript").otherwise(out)


def licences_allowed(licences: Column) -> Column:
    """struct(allowed, reason) of a list of licences: any copyleft one denies, then all known permissive allow, and unknown ones too, by another reason."""
    verdicts = F.transform(F.coalesce(licences, F.array().cast("array<string>")), permissive)
    denied = F.exists(verdicts, lambda v: v.eqNullSafe(F.lit(False)))
    known = F.forall(verdicts, lambda v: v.eqNullSafe(F.lit(True)))
    reason = F.when(denied, "copyleft").when(F.size(verdicts) == 0, "no licence given").when(known, "permissive").otherwise("unknown licence")
    return F.struct((~denied).alias("allowed"), reason.alias("reason"))


def source_repository(urls: Column, homepage: Column) -> Column:
    """Where a Python package's source is: of its named addresses (a map) the first by SOURCE_KEYS on GitHub, then the first of them at all, then a homepage on GitHub."""
    given = [F.nullif(F.trim(F.try_element_at(urls, F.lit(k))), F.lit("")) for k in SOURCE_KEYS]
    on_host = lambda x: F.when(F.contains(x, F.lit("github.com")), x)
    return F.coalesce(*map(on_host, given), *given, on_host(F.nullif(F.trim(homepage), F.lit(""))), F.lit(""))


#: Names of addresses that lead to a source, in the order in which they decide.
SOURCE_KEYS = ("Source", "Repository", "Code", "Source Code")
