"""Lists of package names to import next, and files that install a package, made from records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.functions import packages

#: Fixed value: lines of a Node package manager's settings file.
NPM_SETTINGS = ("registry=https://registry.npmjs.org/", "audit=false", "fund=false")


def python_names(ports: DataFrame) -> DataFrame:
    """Distinct Python index names of ports, in order: ports named py-* with a source of the site PYPI.

    ports has identity<canonical_name, ecosystem_id> and sources<url>. Names that are empty or hold an unexpanded
    variable are left out; nulls match nothing.
    """
    path, name = F.col("identity.ecosystem_id"), packages.pypi_name(F.col("identity.canonical_name"))
    from_index = F.exists("sources.url", lambda u: F.upper(u) == "PYPI")
    return ports.where((F.contains(path, F.lit("/py-")) | F.startswith(path, F.lit("py-"))) & from_index).select(name.alias("name")).where((F.col("name") != "") & ~F.col("name").rlike("[${]")).distinct().orderBy("name")


def listed_names(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct names of a text list, one a line; what follows a # is a comment."""
    return lines.select(F.trim(F.split_part(F.col(column), F.lit("#"), F.lit(1))).alias("name")).where("name <> ''").distinct()


def with_more(names: DataFrame, more: DataFrame) -> DataFrame:
    """names and those of `more` that it lacks, each once."""
    return names.select("name").unionByName(more.select("name")).distinct()


def write_names(names: DataFrame, path: str) -> None:
    """A folder of text files, one name a line."""
    names.select("name").write.mode("overwrite").text(path)


def _first(a: Column, b: Column) -> Column:
    return F.coalesce(F.when(a != "", a), F.when(b != "", b))


def npm_files(records: DataFrame, prefix: str = "install-") -> DataFrame:
    """(name, filename, content) of a package.json that depends on each package, and its settings file.

    The package's name in its registry goes before the canonical one; no version means any (*), no licence
    UNLICENSED, and an empty homepage is left out. The JSON is compact, keys in the order given here.
    """
    name = F.coalesce(_first(F.col("identity.ecosystem_id"), F.col("identity.canonical_name")), F.lit("unknown"))
    version = F.coalesce(_first(F.col("identity.version"), F.lit("*")), F.lit("*"))
    manifest = F.to_json(F.struct(
        F.concat(F.lit(prefix), F.translate(F.regexp_replace(name, "^@+", ""), "/_", "--")).alias("name"),
        F.lit("1.0.0").alias("version"),
        F.concat(F.lit("Install manifest for "), name).alias("description"),
        F.lit(True).alias("private"),
        F.create_map(name, version).alias("dependencies"),
        F.coalesce(F.get("descriptive.license", F.lit(0)), F.lit("UNLICENSED")).alias("license"),
        F.when(F.col("descriptive.homepage") != "", F.col("descriptive.homepage")).alias("homepage"),
    ))
    file = lambda n, c: F.struct(F.lit(n).alias("filename"), c.alias("content"))
    files = F.array(file("package.json", F.concat(manifest, F.lit("\n"))), file(".npmrc", F.lit("\n".join(NPM_SETTINGS) + "\n")))
    return records.select(name.alias("name"), F.inline(files))


#: Fixed value: the head of a Python project's settings that builds with setuptools.
PYTHON_BUILD = ("[build-system]", 'requires = ["setuptools>=61", "wheel"]', 'build-backend = "setuptools.backends.legacy:build"', "", "[project]")


def pypi_files(records: DataFrame) -> DataFrame:
    """(name, filename, content) of requirements.txt and pyproject.toml for each package.

    records has identity, descriptive<summary, homepage, license>, dependencies<runtime>, sources<url> and
    requires_python. Lines of what is null or empty are left out; no licence is UNKNOWN; quotes in the summary
    and the homepage are escaped; the first source with a URL is named in a comment.
    """
    text = lambda path: F.nullif(F.col(path), F.lit(""))
    quote = lambda x: F.replace(x, F.lit('"'), F.lit('\\"'))
    line = lambda before, x, after='"': F.concat(F.lit(before), x, F.lit(after))
    name = F.coalesce(_first(F.col("identity.ecosystem_id"), F.col("identity.canonical_name")), F.lit("unknown"))
    version, none = text("identity.version"), F.array().cast("array<string>")
    needed = F.coalesce("dependencies.runtime", none)
    some = lambda x, *lines: F.when(x.isNotNull(), F.array(*lines)).otherwise(none)
    home, source = text("descriptive.homepage"), F.get(F.filter("sources.url", lambda u: u != ""), F.lit(0))
    project = F.concat(
        F.array(*map(F.lit, PYTHON_BUILD), line('name = "', name)),
        some(version, line('version = "', version)),
        some(text("descriptive.summary"), line('description = "', quote(F.col("descriptive.summary")))),
        some(text("requires_python"), line('requires-python = "', F.col("requires_python"))),
        F.array(line('license = {text = "', F.coalesce(F.get("descriptive.license", F.lit(0)), F.lit("UNKNOWN")), '"}')),
        F.when(F.size(needed) > 0, F.concat(F.array(F.lit("dependencies = [")), F.transform(needed, lambda d: line('    "', d, '",')), F.array(F.lit("]")))).otherwise(none),
        some(home, F.lit(""), F.lit("[project.urls]"), line('Homepage = "', quote(home))),
        some(source, F.lit(""), line("# Source: ", source, "")),
    )
    pinned = F.concat(F.array(F.concat(name, F.coalesce(F.concat(F.lit("=="), version), F.lit("")))), needed)
    file = lambda n, lines: F.struct(F.lit(n).alias("filename"), F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content"))
    return records.select(name.alias("name"), F.inline(F.array(file("requirements.txt", pinned), file("pyproject.toml", project))))
