"""Merging the records of a name: the most trusted one gives the scalars, all give their lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.shared import spread, written


def best_of(rows: DataFrame, name: str, trust: str, order: str, values: list[str]) -> DataFrame:
    """The values of each name's row of highest trust; of equal ones the first by order. No window, no sort: a partial minimum."""
    best = F.min_by(F.struct(*values), F.struct(-F.coalesce(F.col(trust).cast("double"), F.lit(0.0)), order))
    return rows.groupBy(name).agg(best.alias("best")).select(name, *[F.col(f"best.{v}").alias(v) for v in values])


def union_of(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, values (sorted, distinct, non-empty, comma-joined) and their number."""
    held = F.array_sort(F.collect_set(F.when(F.col(value).cast("string") != "", F.col(value))))
    return rows.groupBy(*keys).agg(held.alias("held")).select(*keys, F.array_join(F.col("held").cast("array<string>"), ",").alias("values"), F.size("held").cast("long").alias("n_values"))


def encounter_union(lists: Column) -> Column:
    """Distinct elements of an array of arrays in the order they are met."""
    return F.array_distinct(F.flatten(lists))


def agreement(rows: DataFrame, name: str, ecosystem: str, value: str, order: str) -> DataFrame:
    """name, n_values, agree: whether the ecosystems' last values (by order) are one at most."""
    last = rows.groupBy(name, ecosystem).agg(F.max_by(value, order).alias("value"))
    return last.groupBy(name).agg(F.countDistinct("value").alias("n_values")).withColumn("agree", F.col("n_values") <= 1)


def _first() -> Column:
    """Least for the most trusted record, of equal ones the first by _ord, whatever its type (a number, a path)."""
    return F.struct((-F.col("trust")).alias("minus"), "_ord")


BUCKETS = ("build", "host", "runtime", "test")
_TEXTS = "array<string>"


#: Names with more records than this are merged by element, the others by arrays of their records.
MANY = 100


def _lists() -> dict[str, Column]:
    """The list fields of nested records, none as empty."""
    paths = {"license": "descriptive.license", "maintainers": "descriptive.maintainers", "conflicts": "conflicts", "platforms_include": "platforms.include", "platforms_exclude": "platforms.exclude"}
    paths |= {f"{b}_deps": f"dependencies.{b}" for b in BUCKETS}
    return {k: F.coalesce(F.col(p), F.array().cast(_TEXTS)) for k, p in paths.items()}


def _parted(records: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """A stored table's records of names with at most MANY records, and the others, if any."""
    many = written(records.groupBy("name").count().where(F.col("count") > MANY).select("name"), "many")
    if many.isEmpty():
        return records, None
    return records.join(many, "name", "left_anti"), records.join(many, "name", "left_semi")


def _gathered(key: Column, value: Column) -> Column:
    """The values of a group in the order of their keys (structs, so that all compare)."""
    pairs = F.collect_list(F.struct(key.alias("key"), value.alias("value")))
    return F.array_sort(pairs, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))


def keyed(records: DataFrame, name: Column | None = None) -> DataFrame:
    """Nested records with name, eco, confidence (0 where there is none); those without a name go."""
    name = F.col("identity.canonical_name") if name is None else name
    return records.select("*", name.alias("name"), F.coalesce("identity.ecosystem", F.lit("")).alias("eco"), F.coalesce(F.col("provenance.confidence").cast("double"), F.lit(0.0)).alias("trust")).where("name <> ''")


def unions(records: DataFrame, rank: Column | None = None, **more: Column) -> DataFrame:
    """name and, of each list field (and more lists), its distinct elements over all records of the name, a stored table: by the
    least rank (then place in the list) at which they are met, or sorted and without empty ones where no rank is given."""
    few, many = _parted(records)
    kinds = _lists() | {k: F.coalesce(c, F.array().cast(_TEXTS)) for k, c in more.items()}
    fields = F.struct(*[c.alias(k) for k, c in kinds.items()])
    held = F.collect_list(fields) if rank is None else F.transform(_gathered(F.struct(rank), fields), lambda x: x["value"])
    of = lambda k: encounter_union(F.col(f"held.{k}"))
    kept = of if rank is not None else lambda k: F.array_sort(F.filter(of(k), lambda v: v != ""))
    found = spread(few, "name").groupBy("name").agg(held.alias("held")).select("name", *[kept(k).alias(k) for k in kinds])
    return found if many is None else found.unionByName(_element_unions(many, kinds, rank))


def _element_unions(records: DataFrame, kinds: dict[str, Column], rank: Column | None = None) -> DataFrame:
    """unions() of names with very many records.

    Elements are aggregated one by one, partially first, so a name costs what its result holds."""
    place = F.struct(*([rank] if rank is not None else []))
    of = lambda k: lambda v, i: F.struct(F.lit(k).alias("kind"), v.alias("value"), i.alias("at"))
    entries = F.concat(*[F.transform(c, of(k)) for k, c in kinds.items()])
    every = records.select("name", (place if rank is not None else F.lit(0)).alias("place"), F.inline(entries))
    if rank is None:
        every = every.where("value <> ''").withColumn("at", F.lit(0))
    met = every.groupBy("name", "kind", "value").agg(F.min(F.struct("place", "at")).alias("first"))
    held = met.groupBy("name", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda x: x["value"]).alias("held"))
    per = held.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("kind", "held"))).alias("m"))
    return per.select("name", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.array().cast(_TEXTS)).alias(k) for k in kinds])


def source_union(records: DataFrame, rank: Column) -> DataFrame:
    """name, sources: distinct by url, each as it is first met by rank."""
    every = records.select("name", rank.alias("rank"), F.posexplode("sources").alias("at", "source"))
    met = every.groupBy("name", F.col("source.url").alias("url")).agg(F.min_by("source", F.struct("rank", "at")).alias("source"), F.min(F.struct("rank", "at")).alias("first"))
    return met.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "url", "source")), lambda x, y: F.when(x["first"] < y["first"], -1).otherwise(1)), lambda x: x["source"]).alias("sources"))


def _with_lists() -> dict[str, Column]:
    """The list fields of a nested record `row` replaced by a union's beside it."""
    get = lambda k: F.coalesce(F.col(k), F.array().cast(_TEXTS))
    row = lambda c: F.col(f"row.{c}")
    return {
        "conflicts": get("conflicts"), "descriptive": row("descriptive").withField("maintainers", get("maintainers")),
        "dependencies": F.struct(*[get(f"{b}_deps").alias(b) for b in BUCKETS]), "platforms": F.struct(get("platforms_include").alias("include"), get("platforms_exclude").alias("exclude")),
    }


def bulk_merged(records: DataFrame, name: Column | None = None) -> DataFrame:
    """One record a name in the records' own columns, and merged_from: the most trusted one (the first by _ord of equals), with what
    the others have in addition, in their order: sources (by url), dependencies, maintainers, conflicts."""
    rows = written(keyed(records, name), "records")
    columns = records.columns
    few, many = _parted(rows)
    both = _merged_by_arrays(few, columns)
    if many is not None:
        both = both.unionByName(_merged_by_elements(many, columns))
    changed = _with_lists()
    changed |= {"sources": F.coalesce("_sources", "row.sources"), "platforms": F.col("row.platforms")}
    return both.select("name", "merged_from", *[changed.get(c, F.col(f"row.{c}")).alias(c) for c in columns])


def _ecosystems() -> Column:
    return F.array_sort(F.array_compact(F.collect_set(F.nullif("eco", F.lit(""))))).alias("merged_from")


#: The list fields that a bulk merge fills.
_FILLED = ("maintainers", "conflicts", *[f"{b}_deps" for b in BUCKETS])


def _merged_by_arrays(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name, merged_from, row (the most trusted record), the union's lists and _sources, of names with few records: one shuffle of them."""
    fields = F.struct(F.struct(*columns).alias("row"), "sources", *[_lists()[k].alias(k) for k in _FILLED])
    held = _gathered(F.struct("_ord", (-F.col("trust")).alias("minus")), fields)
    per = spread(rows, "name").groupBy("name").agg(F.min(_first()).alias("first"), _ecosystems(), held.alias("pairs"))
    is_base = lambda x: x["key"]["_ord"].eqNullSafe(F.col("first._ord"))
    base_first = F.concat(F.filter("pairs", is_base), F.filter("pairs", lambda x: ~is_base(x)))
    ordered = per.select("name", "merged_from", F.transform(base_first, lambda x: x["value"]).alias("held"))
    sources = F.flatten(F.filter("held.sources", lambda x: x.isNotNull()))
    ordered = ordered.select("*", sources.alias("every")).withColumn("urls", F.transform("every", lambda s: F.struct(s["url"].alias("url"))))
    at = lambda u: F.element_at("every", F.array_position("urls", u).cast("int"))
    met = F.when(F.size("urls") > 0, F.transform(F.array_distinct("urls"), at))
    return ordered.select("name", "merged_from", F.get("held", F.lit(0))["row"].alias("row"), *[encounter_union(F.col(f"held.{k}")).alias(k) for k in _FILLED], met.alias("_sources"))


def _merged_by_elements(rows: DataFrame, columns: list[str]) -> DataFrame:
    """_merged_by_arrays() of names with very many records."""
    best = rows.groupBy("name").agg(F.min_by(F.struct(*columns), _first()).alias("row"), _ecosystems())
    marked = rows.join(best.select("name", F.col("row._ord").alias("base")), "name").withColumn("later", F.col("_ord") != F.col("base"))
    rank = F.struct("later", "_ord")
    lists = _element_unions(marked, {k: _lists()[k] for k in _FILLED}, rank)
    return best.join(lists, "name", "left").join(source_union(marked, rank).withColumnRenamed("sources", "_sources"), "name", "left")


#: What a stub says of itself, and the version of the record format.
STUB_WARNING, SCHEMA_VERSION = "generated stub — verify sources, checksums, and dependencies before use", "0.2"


def stubs(records: DataFrame, name: Column | None = None) -> DataFrame:
    """One stub a name: the most trusted record with maintainers, conflicts and platforms of all, the more trusted first."""
    rows = written(keyed(records, name), "records")
    columns = records.columns
    best = rows.groupBy("name").agg(F.min_by(F.struct(*columns), _first()).alias("row"))
    both, changed = best.join(unions(rows, _first()), "name", "left"), _with_lists()
    warnings = F.coalesce("row.provenance.warnings", F.array().cast(_TEXTS))
    noted = F.when(F.array_contains(warnings, STUB_WARNING), warnings).otherwise(F.array_append(warnings, F.lit(STUB_WARNING)))
    changed |= {"dependencies": F.col("row.dependencies"), "stub": F.lit(True), "schema_version": F.lit(SCHEMA_VERSION), "provenance": F.col("row.provenance").withField("warnings", noted)}
    return both.select("name", *[changed.get(c, F.col(f"row.{c}")).alias(c) for c in columns])


def difference_notes(versions: Column, deps: Column, deprecated: Column) -> Column:
    """Notes on a name's ecosystems: whether versions agree, of each pair which has more dependencies, where it is deprecated.

    versions and deps: sorted arrays of struct(eco, value); deprecated: a sorted array of ecosystems."""
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    agree = F.size(F.array_distinct(F.transform(versions, lambda x: x["value"]))) <= 1
    first = F.when(agree, text("version agreement: all ecosystems at '", F.coalesce(F.get(versions, 0)["value"], F.lit("unknown")), "'")).otherwise(
        text("version skew: ", F.array_join(F.transform(versions, lambda x: F.concat_ws("=", x["eco"], x["value"])), ", "))
    )

    def against(a: Column, i: Column) -> Column:
        def note(b: Column) -> Column:
            more = b["value"] - a["value"]
            return F.when(more > 0, text(b["eco"], " has ", more.cast("string"), " more dep(s) than ", a["eco"])).when(more < 0, text(a["eco"], " has ", (-more).cast("string"), " more dep(s) than ", b["eco"]))

        return F.transform(F.slice(deps, i + 2, F.greatest(F.size(deps), F.lit(1))), note)

    pairs = F.array_compact(F.flatten(F.transform(deps, against)))
    last = F.when(F.size(deprecated) > 0, F.array(text("deprecated in: ", F.array_join(deprecated, ", ")))).otherwise(F.array().cast(_TEXTS))
    return F.concat(F.array(first), pairs, last)


def extracted(records: DataFrame, candidates: DataFrame | None = None, top: int = 0, specs: DataFrame | None = None) -> DataFrame:
    """One row a name: the most trusted record's summary and homepage, sorted unions of all lists, and what its ecosystems agree on.

    Of several records of one ecosystem the last by _ord stands for it. candidates(name, score): only these, in
    order of their score, the first `top` of them (0: all) before anything is merged; specs(name, path) adds the
    path of a name's specification."""
    rows = keyed(records, F.coalesce("identity.canonical_name", F.lit("unknown")))
    if candidates is not None:
        wanted = candidates.orderBy(F.col("score").desc_nulls_last(), "name")
        rows = rows.join((wanted.limit(top) if top else wanted).select("name", "score"), "name")
    rows = written(rows, "records")  # what follows reads them three times
    score = [] if candidates is None else ["score"]
    n_deps = sum((F.size(F.coalesce(F.col(f"dependencies.{b}"), F.array().cast(_TEXTS))) for b in BUCKETS), F.lit(0)).cast("long")
    licences = F.array_join(F.array_sort(F.coalesce("descriptive.license", F.array().cast(_TEXTS))), "\x1f")
    confidence = F.round(F.col("trust").cast("decimal(12,8)"), 3)
    last = F.struct(F.coalesce("identity.version", F.lit("")).alias("version"), licences.alias("licences"), confidence.alias("confidence"), n_deps.alias("deps"))
    deprecated = F.coalesce("descriptive.deprecated", F.lit(False))
    best = _first()
    scalars = F.struct(F.coalesce("descriptive.summary", F.lit("")).alias("summary"), F.coalesce("descriptive.homepage", F.lit("")).alias("homepage"))
    by_eco = rows.groupBy("name", "eco", *score).agg(F.max_by(last, "_ord").alias("last"), F.min_by(F.struct(best.alias("rank"), scalars.alias("of")), best).alias("best"), F.bool_or(deprecated).alias("deprecated"))
    held = lambda c: F.array_sort(F.collect_list(F.struct("eco", F.col(f"last.{c}").alias("value"))))
    per = by_eco.groupBy("name", *score).agg(
        F.min_by("best.of", "best.rank").alias("best"), held("version").alias("versions"), held("deps").alias("deps"), F.array_sort(F.collect_list(F.when(F.col("deprecated"), F.col("eco")))).alias("deprecated_in"),
        (F.count_distinct("last.licences") <= 1).alias("license_agreement"), (F.count_distinct("last.version") <= 1).alias("version_agreement"), F.round(F.avg("last.confidence"), 3).alias("confidence_avg"),
    )
    out = per.join(unions(rows, sources=F.col("sources.url")), "name", "left")
    get = lambda c: F.coalesce(c, F.array().cast(_TEXTS)).alias(c)
    found = out.select(
        "name", *score, F.transform("versions", lambda x: x["eco"]).alias("ecosystems"), "best.summary", "best.homepage", *map(get, ["license", "maintainers", "conflicts", "platforms_include", *[f"{b}_deps" for b in BUCKETS], "sources"]),
        (F.size("deprecated_in") > 0).alias("deprecated"), "deprecated_in", "version_agreement", "license_agreement", "confidence_avg", F.map_from_entries("versions").alias("versions_by_ecosystem"), F.map_from_entries("deps").alias("dep_count_by_ecosystem"),
        difference_notes(F.col("versions"), F.col("deps"), F.col("deprecated_in")).alias("notes"),
    )
    return found if specs is None else found.join(specs.groupBy("name").agg(F.min("path").alias("behavioral_spec")), "name", "left")
