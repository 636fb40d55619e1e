"""Files that build a package, made from records: Nix derivations and Ports; annotations of specifications; files in answers; reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licences by their SPDX names, as Nix attributes and as names in Ports.
NIX_LICENSES = {
    "MIT": "licenses.mit", "Apache-2.0": "licenses.asl20", "GPL-2.0": "licenses.gpl2Only", "GPL-2.0-only": "licenses.gpl2Only", "GPL-2.0-or-later": "licenses.gpl2Plus", "GPL-3.0": "licenses.gpl3Only",
    "GPL-3.0-only": "licenses.gpl3Only", "GPL-3.0-or-later": "licenses.gpl3Plus", "BSD-2-Clause": "licenses.bsd2", "BSD-3-Clause": "licenses.bsd3", "LGPL-2.1": "licenses.lgpl21Only", "LGPL-2.1-only": "licenses.lgpl21Only",
    "LGPL-2.1-or-later": "licenses.lgpl21Plus", "LGPL-3.0": "licenses.lgpl3Only", "LGPL-3.0-only": "licenses.lgpl3Only", "LGPL-3.0-or-later": "licenses.lgpl3Plus", "MPL-2.0": "licenses.mpl20", "ISC": "licenses.isc",
    "Zlib": "licenses.zlib", "zlib": "licenses.zlib", "OpenSSL": "licenses.openssl", "curl": "licenses.curl",
}
PORT_LICENSES = {
    "MIT": "MIT", "Apache-2.0": "APACHE20", "GPL-2.0": "GPLv2", "GPL-2.0-only": "GPLv2", "GPL-2.0-or-later": "GPLv2", "GPL-3.0": "GPLv3", "GPL-3.0-only": "GPLv3", "GPL-3.0-or-later": "GPLv3", "BSD-2-Clause": "BSD2CLAUSE",
    "BSD-3-Clause": "BSD3CLAUSE", "LGPL-2.1": "LGPL21", "LGPL-2.1-only": "LGPL21", "LGPL-2.1-or-later": "LGPL21", "LGPL-3.0": "LGPL30", "LGPL-3.0-only": "LGPL30", "LGPL-3.0-or-later": "LGPL30", "MPL-2.0": "MPL", "ISC": "ISC",
    "Zlib": "ZLIB", "zlib": "ZLIB", "OpenSSL": "OpenSSL", "curl": "curl",
}
#: Of a build system, the function that builds, its arguments, and the tools that it needs.
NIX_BUILDERS = {
    "cmake": ("stdenv.mkDerivation", ("lib", "stdenv", "fetchurl", "cmake"), ("cmake",)), "meson": ("stdenv.mkDerivation", ("lib", "stdenv", "fetchurl", "meson", "ninja"), ("meson", "ninja")),
    "go": ("buildGoModule", ("lib", "buildGoModule", "fetchurl"), ()), "cargo": ("rustPlatform.buildRustPackage", ("lib", "rustPlatform", "fetchurl"), ()),
}
NIX_DEFAULT = ("stdenv.mkDerivation", ("lib", "stdenv", "fetchurl"), ())
#: Words of USES that a build system implies; endings of archives; lines of files.
PORT_USES = {"cmake": ("cmake",), "meson": ("meson", "ninja")}
ARCHIVES = (".tar.gz", ".tar.bz2", ".tar.xz", ".tar.zst", ".zip", ".tgz", ".tbz", ".txz")
NO_CHECKSUM = "0" * 64
#: What a generated stub says first.
BANNER = "# STUB — review before use"


def _texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _of(path: str) -> Column:
    return F.coalesce(F.col(path), _texts())


def _plain(path: str, default: str = "") -> Column:
    return F.coalesce(F.col(path), F.lit(default))


def _line(*parts: str | Column) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _some(condition: Column, *lines: str | Column) -> Column:
    """Lines where a condition holds, else none."""
    return F.when(condition, F.array(*[x if isinstance(x, Column) else F.lit(x) for x in lines])).otherwise(_texts())


def _looked_up(values: Column, table: dict[str, str], default: str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.transform(values, lambda v: F.coalesce(F.try_element_at(known, v), F.lit(default)))


def _nix(x: Column) -> Column:
    """A text escaped for a Nix string."""
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("${"), F.lit("\\${"))


def _spaced(values: Column) -> Column:
    return F.array_join(values, " ")


def nix_files(records: DataFrame) -> DataFrame:
    """(name, driver, filename, content): a default.nix of each record.

    records has identity, descriptive, sources<url, sha256>, dependencies, build<system_kind, configure_args>, platforms and stub."""
    system = _plain("build.system_kind")
    builder, arguments, tools = F.lit(NIX_DEFAULT[0]), _texts(*NIX_DEFAULT[1]), _texts()
    for kind, (f, args, needs) in NIX_BUILDERS.items():
        of = system == kind
        builder, arguments, tools = F.when(of, f).otherwise(builder), F.when(of, _texts(*args)).otherwise(arguments), F.when(of, _texts(*needs)).otherwise(tools)
    build, host, runtime = (_of(f"dependencies.{b}") for b in ("build", "host", "runtime"))
    inputs = F.array_distinct(F.concat(arguments, F.filter(F.concat(build, host, runtime), lambda d: d != "")))
    source = F.get(F.filter("sources", lambda s: s["url"] != ""), 0)
    digest = F.coalesce(source["sha256"], F.lit(""))
    fetched = F.array(F.lit("  src = fetchurl {"), _line('    url = "', _nix(source["url"]), '";'), F.when(digest == "", "    sha256 = lib.fakeSha256;").otherwise(_line('    sha256 = "', _nix(digest), '";')), F.lit("  };"))
    listed = lambda key, values: _some(F.size(values) > 0, _line(f"  {key} = [ ", _spaced(values), " ];"), "")
    quoted = lambda values: _spaced(F.transform(values, lambda v: _line('"', _nix(v), '"')))
    licences, home, flags = _looked_up(_of("descriptive.license"), NIX_LICENSES, "licenses.unfree"), _plain("descriptive.homepage"), _of("build.configure_args")
    platforms, people = _of("platforms.include"), _of("descriptive.maintainers")
    lines = F.concat(
        _some(F.coalesce("stub", F.lit(False)), BANNER, ""), F.array(_line("{ ", F.array_join(inputs, ", "), " }:"), F.lit(""), _line(builder, " rec {"), _line('  pname = "', _nix(_plain("identity.canonical_name", "unknown")), '";'), _line('  version = "', _nix(_plain("identity.version", "0")), '";'), F.lit("")),
        F.when(source.isNotNull(), fetched).otherwise(_texts("  # TODO: specify source", "  src = null; # STUB: no source URL found")), _texts(""), listed("nativeBuildInputs", F.concat(tools, build)), listed("buildInputs", host), listed("propagatedBuildInputs", runtime),
        _some((F.size(flags) > 0) & ~system.isin("go", "cargo"), _line("  configureFlags = [ ", quoted(flags), " ];"), ""),
        F.array(F.lit("  meta = with lib; {"), _line('    description = "', _nix(_plain("descriptive.summary", "No description available.")), '";')), _some(home != "", _line('    homepage = "', _nix(home), '";')),
        _some(F.size(licences) > 0, F.when(F.size(licences) == 1, _line("    license = ", F.get(licences, 0), ";")).otherwise(_line("    license = [ ", _spaced(licences), " ];"))), _some(F.size(people) > 0, _line("    maintainers = [ ", quoted(people), " ];")),
        F.array(F.when(F.size(platforms) > 0, _line("    platforms = [ ", quoted(platforms), " ];")).otherwise("    platforms = platforms.all;"), F.lit("  };"), F.lit("}")),
    )
    return records.select(F.col("identity.canonical_name").alias("name"), F.lit("nixpkgs").alias("driver"), F.lit("default.nix").alias("filename"), _line(F.array_join(lines, "\n"), "\n").alias("content"))


def port_files(records: DataFrame) -> DataFrame:
    """(name, driver, filename, content): Makefile, distinfo and pkg-descr of each record.

    records as for nix_files(), with sources<url, sha256, filename, size>, build.uses, conflicts and options (features' options_define)."""
    name, version = _plain("identity.canonical_name", "unknown"), _plain("identity.version", "0")
    system, summary, home = _plain("build.system_kind"), _plain("descriptive.summary"), _plain("descriptive.homepage")
    with_url = F.filter("sources", lambda s: s["url"] != "")
    is_archive = lambda s: F.regexp_like(s["url"], F.lit("(" + "|".join(e.replace(".", r"\.") for e in ARCHIVES) + ")$"))
    source = F.coalesce(F.get(F.filter(with_url, is_archive), 0), F.get(with_url, 0))
    path = F.regexp_extract(source["url"], r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#;]*)", 1)
    base = F.regexp_extract(source["url"], r"^((?:[^:/?#]+:)?(?://[^/?#]*)?)", 1)
    last = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    file = F.coalesce(F.nullif(source["filename"], F.lit("")), F.nullif(last, F.lit("")), _line(name, "-", version, ".tar.gz"))
    site = _line(base, F.regexp_extract(path, r"^(.*/)?[^/]*$", 1))
    implied = _texts()
    for kind, words in PORT_USES.items():
        implied = F.when(system == kind, _texts(*words)).otherwise(implied)
    uses = F.array_distinct(F.concat(implied, F.filter(_of("build.uses"), lambda u: u != "")))
    licences = _looked_up(_of("descriptive.license"), PORT_LICENSES, "UNKNOWN")
    categories, people, flags = _of("descriptive.categories"), _of("descriptive.maintainers"), _of("build.configure_args")
    comment = F.substring(summary, 1, 70)
    needs = lambda b, key: _some(F.size(_of(f"dependencies.{b}")) > 0, _line("# STUB: resolve port paths for: ", _spaced(_of(f"dependencies.{b}"))), f"{key}=\t# (fill in)", "")
    configure = F.concat(_texts("GNU_CONFIGURE=\tyes"), _some(F.size(flags) > 0, _line("CONFIGURE_ARGS=\t", F.array_join(flags, " \\\n\t\t"))), _texts(""))
    options, conflicts = _of("options"), _of("conflicts")
    makefile = F.concat(
        _some(F.coalesce("stub", F.lit(False)), BANNER, ""), F.array(_line("PORTNAME=\t", name), _line("DISTVERSION=\t", version), _line("CATEGORIES=\t", F.when(F.size(categories) > 0, _spaced(categories)).otherwise("misc")), F.lit("")),
        F.array(_line("MAINTAINER=\t", F.coalesce(F.get(people, 0), F.lit("ports@FreeBSD.org")))), _some(comment != "", _line("COMMENT=\t", comment)), _some(home != "", _line("WWW=\t\t", home)), _texts(""),
        F.array(_line("LICENSE=\t", F.when(F.size(licences) > 0, _spaced(licences)).otherwise("UNKNOWN")), F.lit("")), _some(source.isNotNull(), _line("MASTER_SITES=\t", site), _line("DISTFILES=\t", file), ""),
        _some(F.size(uses) > 0, _line("USES=\t\t", _spaced(uses)), ""), F.when(system == "autotools", configure).otherwise(_texts()), needs("build", "BUILD_DEPENDS"), needs("host", "LIB_DEPENDS"), needs("runtime", "RUN_DEPENDS"),
        _some(F.size(options) > 0, _line("OPTIONS_DEFINE=\t", _spaced(options)), ""), _some(F.size(conflicts) > 0, _line("CONFLICTS=\t", _spaced(conflicts)), ""), _texts(".include <bsd.port.mk>"),
    )
    digest, size = F.coalesce(source["sha256"], F.lit("")), F.coalesce(source["size"], F.lit(0))
    known = F.concat(F.array(_line("SHA256 (", file, ") = ", digest)), _some(size > 0, _line("SIZE (", file, ") = ", size.cast("string"))))
    unknown = F.array(F.lit("# STUB: fill in real checksums before use"), _line("SHA256 (", file, f") = {NO_CHECKSUM}"))
    distinfo = F.concat(F.when(source.isNull(), _texts("# STUB: no source URL found — fill in manually")).when(digest != "", known).otherwise(unknown), _texts("TIMESTAMP = 0"))
    described = F.concat(F.array(F.when(summary != "", summary).otherwise("No description available.")), _some(home != "", "", _line("WWW: ", home)))
    made = lambda filename, lines: F.struct(F.lit(filename).alias("filename"), _line(F.array_join(lines, "\n"), "\n").alias("content"))
    return records.select(F.col("identity.canonical_name").alias("name"), F.lit("freebsd_ports").alias("driver"), F.inline(F.array(made("Makefile", makefile), made("distinfo", distinfo), made("pkg-descr", described))))


#: The banner and the key of an annotation.
ANNOTATION, ANNOTATION_KEY = "# ── Synthesis layer annotation " + "─" * 47, "synthesis:"


def _yaml(x: Column) -> Column:
    """A text as a YAML scalar, quoted where it must be."""
    special = F.regexp_like(x, F.lit(r"""[:#"'\n\r\t{}\[\]]|^[-&*!|>%@`]"""))
    quoted = _line('"', F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), '"')
    return F.when(F.coalesce(x, F.lit("")) == "", '""').when(special, quoted).otherwise(x)


def annotation(result: str = "result") -> Column:
    """The block that a synthesis result is written as: status, model, attempted_at, iterations, final_pass_count, final_fail_count, total_invariants,
    notes, infeasible_reason, failed (map of an invariant's id to struct<status, reason>)."""
    r = lambda k: F.col(f"{result}.{k}")
    fields = [("status", "status"), ("model", "model"), ("attempted_at", "attempted_at"), ("iterations", "iterations"), ("pass_count", "final_pass_count"), ("fail_count", "final_fail_count"), ("total_invariants", "total_invariants")]
    failed = F.flatten(F.transform(F.map_entries(r("failed")), lambda e: F.array(_line("    ", _yaml(e["key"]), ":"), _line("      status: ", F.coalesce(e["value"]["status"], F.lit("failed"))), _line("      reason: ", _yaml(e["value"]["reason"])))))
    lines = F.concat(
        F.array(F.lit(""), F.lit(ANNOTATION), F.lit(ANNOTATION_KEY), *[_line(f"  {k}: ", r(f).cast("string")) for k, f in fields], _line("  notes: ", _yaml(r("notes"))), F.when(r("infeasible_reason").isNull(), "  infeasible_reason: null").otherwise(_line("  infeasible_reason: ", _yaml(r("infeasible_reason"))))),
        F.when(F.coalesce(F.size(r("failed")), F.lit(0)) > 0, F.concat(_texts("  invariant_annotations:"), failed)).otherwise(_texts("  invariant_annotations: {}")), _texts(""),
    )
    return F.array_join(lines, "\n")


def annotated(text: Column, block: Column, overwrite: bool = False) -> Column:
    """A source with an annotation at its end, in place of an earlier one; null where there is one and it is not to be overwritten."""
    before = F.split_part(text, F.lit("\n" + ANNOTATION[:31]), F.lit(1))
    bare = F.when(before != text, before).when(F.contains(text, F.lit("\n" + ANNOTATION_KEY)), F.split_part(text, F.lit("\n" + ANNOTATION_KEY), F.lit(1))).otherwise("")
    has = F.contains(text, F.lit("\n" + ANNOTATION_KEY)) | F.startswith(F.ltrim(text), F.lit(ANNOTATION_KEY))
    return F.when(~has, F.concat(text, block)).when(F.lit(overwrite), F.concat(bare, block))


def answer_files(text: Column) -> Column:
    """map of the files in an answer: <file name="..."><content> blocks, or else fenced blocks that name a file after the fence or in a first comment; empty without any.

    Of a repeated name the last block holds."""
    trimmed = lambda x: F.regexp_replace(x, r"\A\n+|\n+\z", "")
    block = r"""(?s)<file\s+name=["']([^"']+)["']\s*>\s*<content>(.*?)</content>\s*</file>"""
    marked = F.zip_with(F.regexp_extract_all(text, F.lit(block), 1), F.regexp_extract_all(text, F.lit(block), 2), lambda n, c: F.struct(F.trim(n).alias("name"), trimmed(c).alias("content")))
    fence = r"(?s)```[a-zA-Z]*[ \t]*([^\n`]*)\n(.*?)```"
    inner = F.zip_with(F.regexp_extract_all(text, F.lit(fence), 1), F.regexp_extract_all(text, F.lit(fence), 2), lambda i, c: F.struct(F.trim(i).alias("info"), trimmed(c).alias("content")))
    named = F.transform(inner, lambda b: F.struct(F.when(F.regexp_like(b["info"], F.lit(r"^[\w\-./]+\.\w+")), b["info"]).otherwise(F.regexp_extract(b["content"], r"\A#\s*([\w\-./]+\.\w+)", 1)).alias("name"), b["content"].alias("content")))
    found = F.when(F.size(marked) > 0, marked).otherwise(F.filter(named, lambda b: b["name"] != ""))
    last = F.filter(found, lambda b, i: ~F.exists(F.slice(found, i + 2, F.greatest(F.size(found), F.lit(1))), lambda x: x["name"] == b["name"]))
    return F.map_from_entries(last)


def invariant_line(id_: Column, kind: Column, expected: Column, width: int = 60) -> Column:
    """One line about an invariant: its id, what it expects (as a text, cut) if anything, its kind."""
    end = _line("  [", F.coalesce(kind, F.lit("?")), "]")
    return F.when(F.coalesce(expected, F.lit("")) != "", _line(id_, "  →  '", F.substring(expected, 1, width), "'", end)).otherwise(_line(id_, end))


def markdown(report: DataFrame, order: list[str] | None = None) -> DataFrame:
    """value: the lines of a Markdown table of a report of few rows, in order; bars in texts are escaped. Made to be written as one file."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in report.columns]
    body = report.orderBy(*(order or report.columns)).select(_line("| ", F.concat_ws(" | ", *cells), " |").alias("value"))
    head = ["| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    return report.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1).union(body)


def _padded(x: Column, width: int, right: bool = False) -> Column:
    """A text filled with blanks to a width, at its left for `right`; longer ones stay whole."""
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, " ") if right else F.rpad(x, width, " "))


#: What the summary of an audit names, and the status that it counts (none: a sum).
AUDIT_COUNTS = (
    ("Total specs:", None, None), ("Succeeded:", "success", None), ("Partial:", "partial", None), ("Failed:", "failed", None), ("Build failed:", "build_failed", None), ("Infeasible:", "infeasible", None),
    ("Total invariants:", None, "total_invariants"), ("Passing invariants:", None, "pass_count"), ("Failing invariants:", None, "fail_count"),
)


def audit_lines(results: DataFrame, title: str, generated: str) -> DataFrame:
    """section, key, at, value: the lines of an audit as text, in the order of the first three; text_file() writes them.

    results(canonical_name, backend_lang, status, model, iterations, pass_count, fail_count, total_invariants, failed: a map of an
    invariant's id to the reason, whose first 80 characters stay): a head, sums, a line a result and, if any, what has failed, both by name."""
    known = [status for _, status, _ in AUDIT_COUNTS if status]
    status = F.when(F.col("status").isin(*known), F.col("status")).otherwise("failed")
    value = lambda of, total: F.count_if(status == of) if of else F.coalesce(F.sum(total), F.lit(0)) if total else F.count("*")
    sums = [_line("  ", F.rpad(F.lit(label), 22, " "), value(of, total).cast("string")) for label, of, total in AUDIT_COUNTS]
    rate = F.round(F.coalesce(F.try_divide(F.count_if(F.col("status") == "success"), F.count("*")), F.lit(0.0)), 4)
    model = F.coalesce(F.min_by("model", F.when(F.col("model") != "", F.col("canonical_name"))), F.lit("unknown"))
    long, rule = "=" * 70, "-" * 70
    columns = _line(*[_padded(F.lit(n), w) if i < 3 else _padded(F.lit(n), w, True) if i == 3 else _line(" ", _padded(F.lit(n), w, True)) for i, (n, w) in enumerate((("Spec", 31), ("Lang", 13), ("Status", 15), ("Pass", 5), ("Fail", 5), ("Iters", 5)))])
    head = F.array(
        F.lit(long), F.lit(title), _line("Generated: ", generated), _line("Model:     ", model), F.lit(long), F.lit(""), F.lit("SUMMARY"), F.lit("-" * 40), *sums,
        _line("  ", F.rpad(F.lit("Synthesizability:"), 22, " "), F.format_string("%.1f%%", rate * 100)), F.lit(""), F.lit("PER-SPEC RESULTS"), F.lit(rule), columns, F.lit(rule),
    )
    at = lambda section, key: [F.lit(section).alias("section"), key.alias("key")]
    first = results.agg(head.alias("lines")).select(*at(0, F.lit("")), F.posexplode("lines").alias("at", "value"))
    number = lambda c: _line(" ", _padded(F.col(c).cast("string"), 5, True))
    one = _line(_padded(F.col("canonical_name"), 30), " ", _padded(F.coalesce("backend_lang", F.lit("")), 12), " ", _padded(F.col("status"), 14), *map(number, ("pass_count", "fail_count", "iterations")))
    each = results.select(*at(1, F.col("canonical_name")), F.lit(0).alias("at"), one.alias("value"))
    entries = F.transform(F.array_sort(F.map_entries("failed")), lambda e: _line("    - ", e["key"], ": ", F.substring(F.coalesce(e["value"], F.lit("")), 1, 80)))
    some = results.where(F.size("failed") > 0)
    details = some.select(*at(3, F.col("canonical_name")), F.posexplode(F.concat(F.array(_line("  ", F.col("canonical_name"), ":")), entries)).alias("at", "value"))
    bound = lambda section, at, value: F.struct(F.lit(section).alias("section"), F.lit(at).alias("at"), F.lit(value).alias("value"))
    bounds = some.limit(1).select(F.explode(F.array(bound(2, 1, "FAILED INVARIANT DETAILS"), bound(2, 2, rule), bound(4, 0, ""))).alias("x"))
    blank = results.sparkSession.createDataFrame([(2, "", 0, "")], "section int, key string, at int, value string")
    return first.unionByName(each).unionByName(blank).unionByName(details).unionByName(bounds.select("x.section", F.lit("").alias("key"), "x.at", "x.value"))


def text_file(lines: DataFrame, path: str, order: list[str]) -> None:
    """value of each row as a line of text files whose names have the order of the rows; a report of any length is as many files as it asks for."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)
