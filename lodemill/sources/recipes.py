"""Recipe texts and registry documents to the fields of a record, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.functions import packages, scalars

#: Licence attributes of Nix recipes by their SPDX names.
NIX_LICENSES = {
    "mit": "MIT", "gpl2": "GPL-2.0", "gpl2Only": "GPL-2.0-only", "gpl3": "GPL-3.0", "gpl3Only": "GPL-3.0-only", "lgpl2": "LGPL-2.0", "lgpl21": "LGPL-2.1", "lgpl3": "LGPL-3.0", "bsd2": "BSD-2-Clause",
    "bsd3": "BSD-3-Clause", "isc": "ISC", "mpl20": "MPL-2.0", "asl20": "Apache-2.0", "zlib": "Zlib", "publicDomain": "Unlicense", "openssl": "OpenSSL", "curl": "curl", "unlicense": "Unlicense",
}
#: Words of a Nix recipe that tell its build system, in the order in which they decide.
NIX_BUILD_SYSTEMS = {
    "cmake": "cmake", "meson": "meson", "waf": "waf", "buildPerlPackage": "perl", "buildPerlModule": "perl", "perl": "perl", "buildPythonPackage": "python", "buildPythonApplication": "python", "python3": "python",
    "buildGoModule": "go", "buildGoPackage": "go", "go": "go", "buildRustPackage": "cargo", "buildNpmPackage": "npm", "buildNpmApplication": "npm", "mkYarnPackage": "yarn", "buildDunePackage": "dune",
    "buildOcamlPackage": "ocaml", "buildHaskellPackage": "cabal", "buildRubyGem": "gem", "buildPhpPackage": "php",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _listed(*items: tuple[str | Column, Column]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for t, c in items]))


#: Folders of a Nix tree without recipes of packages.
NIX_SKIPPED = ("lib", "nixos", "doc", "maintainers")


def nix_tree(spark: SparkSession, root: str) -> DataFrame:
    """_path, value of every default.nix below a root but those in the skipped top folders and in pkgs/top-level."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="default.nix").select(F.col("_metadata.file_path").alias("_path"), "value")
    inside = _below(F.col("_path"), root)
    return files.where(~F.substring_index(inside, "/", 1).isin(*NIX_SKIPPED) & ~F.startswith(inside, F.lit("pkgs/top-level/")))


def _below(path: Column, root: str) -> Column:
    """What of a file's path follows a root."""
    bare = root.rstrip("/").split("://")[-1].removeprefix("file:")
    return F.substring_index(path, bare + "/", -1)


def ports_tree(spark: SparkSession, root: str) -> DataFrame:
    """dir (category/port), value of every Makefile two folders below a root, with the names of its patches."""
    base = root.rstrip("/")
    files = spark.read.text(f"{base}/*/*/Makefile", wholetext=True).select(_below(F.col("_metadata.file_path"), root).alias("p"), "value")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "patch-*").option("recursiveFileLookup", "true").load(base)
    patches = listed.select(_below(F.col("path"), root).alias("p")).where(F.col("p").rlike("^[^/]+/[^/]+/files/patch-[^/]*$")).groupBy(F.regexp_extract("p", "^([^/]+/[^/]+)/", 1).alias("dir"))
    patches = patches.agg(F.array_sort(F.collect_set(F.regexp_extract("p", "(files/[^/]+)$", 1))).alias("patches"))
    found = files.select(scalars.dirname(F.col("p")).alias("dir"), "value")
    return found.join(patches, "dir", "left").withColumn("patches", F.coalesce("patches", F.array().cast("array<string>")))


def nix_list(text: Column, key: str) -> Column:
    """The names in `key = [ ... ]`: comments and quotes go, of an attribute path the last part stays."""
    inside = F.regexp_replace(F.regexp_extract(text, rf"\b{key}\s*=\s*(?:with\s+\w+;\s*)?\[([^\]]*)\]", 1), "#[^\n]*", "")
    names = F.transform(F.split(inside, r"\s+"), lambda t: F.substring_index(F.translate(t, "\"'()", ""), ".", -1))
    return F.array_distinct(F.filter(names, lambda t: t != ""))


def nix_recipes(texts: DataFrame) -> DataFrame:
    """Fields of the derivations among Nix recipes (_path, value)."""
    v = F.col("value")
    bound = lambda key: F.nullif(F.regexp_extract(v, rf"\b{key}\s*=\s*\"([^\"]*)\"", 1), F.lit(""))
    every = lambda pattern: F.regexp_extract_all(v, F.lit(pattern), 1)
    split = r"^(.+?)-(\d[\d.].*)$"
    name = F.coalesce(bound("pname"), F.nullif(F.regexp_extract(bound("name"), split, 1), F.lit("")), bound("name"))
    version = F.coalesce(bound("version"), F.nullif(F.regexp_extract(bound("name"), split, 2), F.lit("")), F.lit("unknown"))
    system = F.lit("autotools")
    for word, kind in reversed(NIX_BUILD_SYSTEMS.items()):
        system = F.when(v.rlike(rf"\b{word}\b"), kind).otherwise(system)
    # names after licenses. in every licence binding, and those of a list that stands with licenses
    named = F.flatten(F.transform(every(r"\blicenses?\s*=\s*(?:with\s+\S+;\s*)?\[?([^\];]+)\]?"), lambda x: F.regexp_extract_all(x, F.lit(r"licenses\.(\w+)"), 1)))
    spdx = F.transform(named, lambda x: F.coalesce(F.try_element_at(_map(NIX_LICENSES), x), x))
    home, urls = bound("homepage"), every(r"\burl\s*=\s*\"([^\"]+)\"")
    of_kind = lambda kind: lambda u: F.struct(F.lit(kind).alias("type"), u.alias("url"))
    sources = F.concat(_listed((of_kind("homepage")(home), home.isNotNull())), F.transform(urls, of_kind("archive")))
    patches = F.flatten(F.transform(F.slice(every(r"\bpatches\s*=\s*\[([^\]]*)\]"), 1, 1), lambda x: F.regexp_extract_all(x, F.lit(r"([\w./]+\.patch)"), 1)))
    phases = F.filter(F.split(F.regexp_extract(v, r"\bphases\s*=\s*\[([^\]]+)\]", 1), r"\s+"), lambda x: x != "")
    checked = v.rlike(r"\bdoCheck\s*=\s*true") | (F.contains(v, F.lit("checkPhase")) & ~v.rlike(r"\bdoCheck\s*=\s*false"))
    warnings = _listed(("version not found; set to 'unknown'", version == "unknown"), ("patch reasons not parsed from source", F.size(patches) > 0))
    unmapped = _listed(("description", bound("description").isNull()), ("homepage", home.isNull()), ("license", F.size(spdx) == 0), ("src.url", F.size(sources) == 0))
    found = sum((F.when(c, 1).otherwise(0) for c in (name.isNotNull(), version != "unknown", bound("description").isNotNull(), home.isNotNull(), F.size(spdx) > 0, F.size(sources) > 0)), F.lit(0))
    gate = v.rlike(r"mkDerivation|build(Perl|Python|Go|Rust|Npm|Dune|Ocaml|Haskell|Php)\w*|buildRubyGem|mkYarnPackage")
    text = lambda c: F.coalesce(c, F.lit(""))
    return texts.where(gate).select(
        "_path", name.alias("name"), version.alias("version"), F.lit("nixpkgs").alias("ecosystem"), text(bound("description")).alias("summary"), text(home).alias("homepage"), sources.alias("sources"), spdx.alias("licenses"), system.alias("build_system"),
        nix_list(v, "configureFlags").alias("configure_flags"), nix_list(v, "makeFlags").alias("make_flags"), F.when(F.size(phases) > 0, phases).otherwise(F.array(*map(F.lit, ("configure", "build", "check", "install")))).alias("phases"),
        nix_list(v, "nativeBuildInputs").alias("build_deps"), nix_list(v, "buildInputs").alias("host_deps"), nix_list(v, "propagatedBuildInputs").alias("runtime_deps"), F.concat(nix_list(v, "checkInputs"), nix_list(v, "nativeCheckInputs")).alias("test_deps"),
        checked.alias("has_tests"), patches.alias("patches"), nix_list(v, "platforms").alias("platforms_include"), nix_list(v, "badPlatforms").alias("platforms_exclude"),
        packages.confidence(found, 0.5, 0.45, F.size(warnings) > 0).alias("confidence"), unmapped.alias("unmapped"), warnings.alias("warnings"),
    ).where("name IS NOT NULL")


def make_variables(text: Column) -> Column:
    """map of a Makefile's assignments (=, ?=, +=, :=, !=): continued lines are joined, the last assignment of a name stays."""
    lines = F.split(F.regexp_replace(text, r"\\\n", " "), "\n")
    pattern = r"^(\w+)\s*[?+:!]?=\s*(.*)"
    named = F.transform(lines, lambda x, i: F.struct(F.regexp_extract(x, pattern, 1).alias("k"), i.alias("at"), F.trim(F.regexp_extract(x, pattern, 2)).alias("v")))
    # by name and place the last one of a name stands before another name
    ordered = F.array_sort(F.filter(named, lambda p: p["k"] != ""))
    after = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1)))
    last = F.filter(F.arrays_zip(ordered.alias("own"), after.alias("next")), lambda z: ~F.coalesce(z["own"]["k"] == z["next"]["k"], F.lit(False)))
    return F.map_from_entries(F.transform(last, lambda z: F.struct(z["own"]["k"], z["own"]["v"])))


def master_folder(masterdir: Column, folder: Column) -> Column:
    """The folder (category/port) that a MASTERDIR means, seen from a port's own; null if it has other variables, leaves the tree or is none."""
    own = F.concat(F.lit("/"), folder)
    at = F.replace(masterdir, F.lit("${.CURDIR:H:H}"), F.lit("/"))
    at = F.replace(F.replace(at, F.lit("${.CURDIR:H}"), scalars.dirname(own)), F.lit("${.CURDIR}"), own)
    parts = F.filter(F.split(at, "/"), lambda p: ~p.isin("", "."))

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array(F.lit("..")))
        return F.when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    path = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(F.startswith(at, F.lit("/")) & ~F.contains(at, F.lit("${")) & ~path.rlike(r"(^|/)\.\.(/|$)") & (path != ""), path)


def inherited(ports: DataFrame) -> DataFrame:
    """ports(dir, vars, ...) with a slave port's variables over its master's (a left self join on the folder that MASTERDIR means) and notes on it."""
    wanted = F.coalesce(F.try_element_at("vars", F.lit("MASTERDIR")), F.lit(""))
    own = ports.select("*", wanted.alias("_wanted"), master_folder(wanted, F.col("dir")).alias("_master"))
    master = ports.select(F.col("dir").alias("_master"), F.col("vars").alias("_above"))
    kept = F.map_filter("_above", lambda k, _: ~F.array_contains(F.map_keys("vars"), k))
    is_slave, found = F.col("_wanted") != "", F.col("_above").isNotNull()
    notes = _listed((F.concat(F.lit("slave port; merged from "), F.col("_master")), is_slave & found), (F.concat(F.lit("slave port; MASTERDIR not resolvable: '"), F.col("_wanted"), F.lit("'")), is_slave & ~found))
    joined = own.join(master, "_master", "left").withColumn("notes", notes)
    return joined.withColumn("vars", F.when(found, F.map_concat(kept, "vars")).otherwise(F.col("vars"))).drop("_wanted", "_master", "_above")


def port_names(value: Column) -> Column:
    """Ports in a *_DEPENDS value: of each word what follows category/."""
    names = F.transform(F.split(value, r"\s+"), lambda w: F.regexp_extract(w, r":[\w-]+/([\w-]+)", 1))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


#: Words of USES that tell a port's build system, in the order in which they decide.
PORT_BUILD_SYSTEMS = {"cmake": "cmake", "meson": "meson", "waf": "waf", "perl5": "perl", "python": "python", "go": "go", "cargo": "cargo"}


def port_recipes(ports: DataFrame) -> DataFrame:
    """Fields of ports(dir, vars) as records; further columns value (the Makefile's text), patches and notes (of inherited()) are used if there."""
    get = lambda k: F.coalesce(F.try_element_at("vars", F.lit(k)), F.lit(""))
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    none = F.array().cast("array<string>")
    given = lambda c: F.col(c) if c in ports.columns else none
    uses = F.transform(words(get("USES")), lambda w: F.substring_index(w, ":", 1))
    system = F.lit("freebsd_ports_make")
    for word, kind in reversed(PORT_BUILD_SYSTEMS.items()):
        system = F.when(F.array_contains(uses, word), kind).otherwise(system)
    version = F.coalesce(F.nullif(get("PORTVERSION"), F.lit("")), F.nullif(get("DISTVERSION"), F.lit("")), F.lit("unknown"))
    sources = _listed((F.struct(F.lit("homepage").alias("type"), get("WWW").alias("url")), get("WWW") != ""), (F.struct(F.lit("master_sites").alias("type"), F.get(words(get("MASTER_SITES")), 0).alias("url")), get("MASTER_SITES") != ""))
    licences = words(get("LICENSE"))
    warnings = F.concat(given("notes"), _listed(("version not found; set to 'unknown'", version == "unknown"), ("patch reasons not parsed from source", F.size(given("patches")) > 0)))
    unmapped = _listed(("COMMENT", get("COMMENT") == ""), ("WWW", get("WWW") == ""), ("LICENSE", F.size(licences) == 0), ("MASTER_SITES", F.size(sources) == 0))
    count = lambda *conditions: sum((F.when(c, 1).otherwise(0) for c in conditions), F.lit(0))
    found = count(get("PORTNAME") != "", version != "unknown", get("COMMENT") != "", get("WWW") != "", F.size(licences) > 0, F.size(sources) > 0)
    tested = get("TEST_TARGET") != ""
    if "value" in ports.columns:
        tested = tested | F.coalesce(F.contains(F.lower("value"), F.lit("test")), F.lit(False))
    configure = F.when(F.map_contains_key("vars", F.lit("CONFIGURE_ARGS")), get("CONFIGURE_ARGS")).otherwise(get("CMAKE_ARGS"))
    return ports.select(
        "dir", get("PORTNAME").alias("name"), version.alias("version"), F.lit("freebsd_ports").alias("ecosystem"), get("COMMENT").alias("summary"), get("WWW").alias("homepage"),
        licences.alias("licenses"), words(get("CATEGORIES")).alias("categories"), _listed((get("MAINTAINER"), get("MAINTAINER") != "")).alias("maintainers"), sources.alias("sources"), system.alias("build_system"), uses.alias("uses"),
        words(configure).alias("configure_args"), words(get("MAKE_ARGS")).alias("make_args"), words(get("OPTIONS_DEFINE")).alias("options"), (get("DEPRECATED") != "").alias("deprecated"), F.nullif(get("EXPIRATION_DATE"), F.lit("")).alias("expiration_date"),
        words(get("ONLY_FOR_ARCHS")).alias("platforms_include"), words(get("NOT_FOR_ARCHS")).alias("platforms_exclude"), given("patches").alias("patches"), tested.alias("has_tests"),
        port_names(get("BUILD_DEPENDS")).alias("build_deps"), port_names(get("LIB_DEPENDS")).alias("host_deps"), port_names(get("RUN_DEPENDS")).alias("runtime_deps"), port_names(get("TEST_DEPENDS")).alias("test_deps"),
        words(F.concat_ws(" ", get("CONFLICTS"), get("CONFLICTS_INSTALL"))).alias("conflicts"), packages.confidence(found, 0.55, 0.40, F.size(warnings) > 0).alias("confidence"), unmapped.alias("unmapped"), warnings.alias("warnings"),
    ).where("name <> ''")


def nix_evaluated(rows: DataFrame, root: str = "") -> DataFrame:
    """Fields of records of evaluated attributes: rows(attr, raw), raw a JSON text; those that are null or no object are left out.

    Dependencies are never known here, which is noted; a position below the root gives the source's path, else the attribute."""
    kind = "pname string, version string, description string, homepage string, license array<string>, maintainers array<string>, platforms array<string>, position string"
    r = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    texts = lambda c: F.coalesce(F.col(f"r.{c}"), F.array().cast("array<string>"))
    read = rows.where(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT")).select("attr", F.from_json("raw", kind).alias("r"))
    name, version = F.coalesce(F.nullif(r("pname"), F.lit("")), "attr"), F.coalesce(F.nullif(r("version"), F.lit("")), F.lit("unknown"))
    licences = F.filter(texts("license"), lambda x: x != "")
    home = r("homepage") != ""
    unmapped = _listed(("meta.description", r("description") == ""), ("meta.homepage", ~home), ("meta.license", F.size(licences) == 0))
    warnings = _listed(("version not found in nix eval; set to 'unknown'", version == "unknown"), ("deps not extracted by eval importer (infinite recursion risk)", F.lit(True)))
    found = sum((F.when(c, 1).otherwise(0) for c in (name != "", version != "unknown", r("description") != "", home, F.size(licences) > 0, home)), F.lit(0))
    file = F.split_part(r("position"), F.lit(":"), F.lit(1))
    base = root.rstrip("/") + "/"
    path = F.when(F.lit(root != "") & F.startswith(file, F.lit(base)), F.substring(file, F.lit(len(base) + 1), F.length(file))).otherwise(F.col("attr"))
    none = F.array().cast("array<string>")
    return read.select(
        "attr", name.alias("name"), version.alias("version"), F.lit("nixpkgs").alias("ecosystem"), r("description").alias("summary"), r("homepage").alias("homepage"), licences.alias("licenses"),
        texts("maintainers").alias("maintainers"), texts("platforms").alias("platforms_include"), F.lit("autotools").alias("build_system"), *[none.alias(f"{b}_deps") for b in ("build", "host", "runtime", "test")],
        path.alias("source_path"), packages.confidence(found, 0.70, 0.28, F.lit(True), 0.97).alias("confidence"), unmapped.alias("unmapped"), warnings.alias("warnings"),
    )


def _texts(path: str) -> Column:
    return F.coalesce(F.try_variant_get("v", path, "array<string>"), F.array().cast("array<string>"))


def pypi_documents(docs: DataFrame) -> DataFrame:
    """Fields of package documents (v) of the Python index; dependencies that an extra asks for are left out."""
    info = lambda k: F.trim(F.coalesce(F.try_variant_get("v", f"$.info.{k}", "string"), F.lit("")))
    needed = F.filter(_texts("$.info.requires_dist"), lambda r: ~r.rlike("extra ?=="))
    kind = "array<struct<packagetype:string,url:string,filename:string,size:bigint,digests:struct<sha256:string>>>"
    urls = F.coalesce(F.try_variant_get("v", "$.urls", kind), F.array().cast(kind))
    source = F.coalesce(F.get(F.filter(urls, lambda u: u["packagetype"] == "sdist"), 0), F.get(urls, 0))
    links = F.coalesce(F.try_variant_get("v", "$.info.project_urls", "map<string,string>"), F.expr("map()").cast("map<string,string>"))
    link = lambda k: F.nullif(F.trim(F.try_element_at(links, F.lit(k))), F.lit(""))
    home = F.coalesce(F.nullif(info("home_page"), F.lit("")), *map(link, ("Homepage", "home_page", "Source", "Repository")), F.lit(""))
    names = F.array_distinct(F.filter(F.transform(needed, lambda r: packages.pypi_name(packages.requirement_name(r))), lambda d: d != ""))
    build = F.array(F.lit("setuptools"), F.lit("wheel"))
    return docs.select(packages.pypi_name(info("name")).alias("name"), info("name").alias("ecosystem_id"), info("version").alias("version"), F.lit("pypi").alias("ecosystem"), info("summary").alias("summary"), home.alias("homepage"),
                       _listed((info("license"), info("license") != "")).alias("licenses"), source["url"].alias("source_url"), source["digests"]["sha256"].alias("source_sha256"), build.alias("build_deps"), names.alias("runtime_deps"),
                       info("requires_python").alias("requires_python"), F.slice(_texts("$.info.classifiers"), 1, 10).alias("classifiers"), packages.source_repository(links, info("home_page")).alias("source_repository"), F.lit(0.9).alias("confidence"))


def npm_documents(docs: DataFrame) -> DataFrame:
    """Fields of package documents of the Node index (value: JSON text, whose order of versions counts), of the version tagged latest, or
    the last one of the document where that is missing. What a version lacks is looked for in the document."""
    texts = lambda c: F.map_keys(F.from_json(c, "map<string,string>"))
    top = F.from_json("value", "name string, `dist-tags` map<string,string>, versions map<string,string>")
    read = docs.select("value", top.alias("d")).where(F.col("d.name").isNotNull())
    versions = F.coalesce("d.versions", F.expr("map()").cast("map<string,string>"))
    tagged = F.try_element_at(F.col("d")["dist-tags"], F.lit("latest"))
    usable = F.coalesce(F.try_element_at(versions, tagged), F.lit("{}")) != "{}"
    version = F.when(usable | (F.size(versions) == 0), F.coalesce(tagged, F.lit(""))).otherwise(F.element_at(F.map_keys(versions), -1))
    of = read.select("value", F.col("d.name").alias("id"), version.alias("version"), F.coalesce(F.try_element_at(versions, version), F.lit("{}")).alias("w"))
    get = lambda c, k: F.nullif(F.get_json_object(c, f"$.{k}"), F.lit(""))
    either = lambda k: F.coalesce(get("w", k), get("value", k))
    keys = lambda k: F.coalesce(texts(get("w", k)), F.array().cast("array<string>"))
    inner = lambda k, name: F.when(F.startswith(either(k), F.lit("{")), F.coalesce(F.get_json_object(either(k), f"$.{name}"), F.lit(""))).otherwise(F.coalesce(either(k), F.lit("")))
    licence, url = inner("license", "type"), F.trim(inner("repository", "url"))
    words = F.coalesce(F.from_json(either("keywords"), "array<string>"), F.array().cast("array<string>"))
    return of.select(packages.npm_name(F.col("id")).alias("name"), F.col("id").alias("ecosystem_id"), "version", F.lit("npm").alias("ecosystem"), F.trim(F.coalesce(either("description"), F.lit(""))).alias("summary"),
                     F.coalesce(F.nullif(F.trim(either("homepage")), F.lit("")), url).alias("homepage"), _listed((licence, licence != "")).alias("licenses"), F.get_json_object("w", "$.dist.tarball").alias("source_url"), F.get_json_object("w", "$.dist.integrity").alias("source_integrity"),
                     F.when(url != "", packages.repository_url(url)).otherwise("").alias("repository"), keys("dependencies").alias("runtime_deps"), keys("devDependencies").alias("build_deps"), keys("peerDependencies").alias("host_deps"),
                     F.slice(words, 1, 10).alias("keywords"), F.lit(0.85).alias("confidence"))


def cargo_documents(docs: DataFrame) -> DataFrame:
    """Fields of package documents (v) of the Rust index: the newest version that is not yanked, dependencies by kind, optional ones left out."""
    kind = "array<struct<num:string,yanked:boolean,license:string>>"
    version = F.get(F.filter(F.try_variant_get("v", "$.versions", kind), lambda x: ~F.coalesce(x["yanked"], F.lit(False))), 0)
    deps = F.coalesce(F.try_variant_get("v", "$.dependencies", "array<struct<crate_id:string,kind:string,optional:boolean>>"), F.array().cast("array<struct<crate_id:string,kind:string,optional:boolean>>"))
    of = lambda k: F.array_distinct(F.transform(F.filter(deps, lambda d: (d["kind"] == k) & ~((d["kind"] == "normal") & F.coalesce(d["optional"], F.lit(False)))), lambda d: packages.cargo_name(d["crate_id"])))
    return docs.select(packages.cargo_name(F.try_variant_get("v", "$.crate.id", "string")).alias("name"), version["num"].alias("version"), F.lit("cargo").alias("ecosystem"), version["license"].alias("license"),
                       packages.permissive(version["license"]).alias("permissive"), of("normal").alias("runtime_deps"), of("build").alias("build_deps"), of("dev").alias("test_deps"))
