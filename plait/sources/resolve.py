"""Resolution of imports to files and packages, as equi-joins on candidate paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions in the order in which they are tried.
EXTENSIONS = [".js", ".cjs", ".mjs", ".jsx", ".ts", ".tsx", ".svelte", ".vue", ".json"]
PROBES = {"script": ["", *EXTENSIONS, *(f"/index{e}" for e in EXTENSIONS)], "python": [".py", "/__init__.py"]}


def fold_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; null if it leaves the root."""
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))
    step = lambda s, x: (
        F.when((x == "") | (x == "."), s)
        .when((x == "..") & (F.size(s["p"]) > 0), F.struct(F.slice(s["p"], 1, F.greatest(F.size(s["p"]) - 1, F.lit(0))).alias("p"), s["ok"].alias("ok")))
        .when(x == "..", F.struct(s["p"].alias("p"), F.lit(False).alias("ok")))
        .otherwise(F.struct(F.array_append(s["p"], x).alias("p"), s["ok"].alias("ok")))
    )
    return F.aggregate(F.split(path, "/"), start, step, lambda s: F.when(s["ok"], F.array_join(s["p"], "/")))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def probe(bases: DataFrame, files: DataFrame, kind: str = "script") -> DataFrame:
    """``bases (path, specifier, base)`` with ``target``: the first existing file of base and probes in order; null if there is none."""
    options = F.posexplode(F.array(*[F.concat("base", F.lit(p)) for p in PROBES[kind]]))
    tried = bases.select("path", "specifier", options.alias("k", "candidate"))
    found = tried.join(files.select(F.col("path").alias("candidate")), "candidate").groupBy("path", "specifier").agg(F.min_by("candidate", "k").alias("target"))
    return bases.join(found, ["path", "specifier"], "left")


def relative(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``(path, specifier, target)`` of relative and aliased imports; an alias is a prefix with its folder, the longest first."""
    base = F.when(F.col("specifier").startswith("."), F.concat_ws("/", folder(F.col("path")), F.col("specifier")))
    for prefix, place in sorted((aliases or {}).items(), key=lambda x: -len(x[0])):
        base = base.when(F.col("specifier").startswith(prefix), F.concat(F.lit(place), F.substr("specifier", F.lit(len(prefix) + 1))))
    rows = imports.select("path", "specifier").distinct().withColumn("base", fold_path(base)).where("base is not null")
    return probe(rows, files).select("path", "specifier", "target")


def nearest_config(paths: DataFrame, configs: DataFrame) -> DataFrame:
    """``(path, config)``: of the folders above a path, the deepest that holds a configuration ``(folder)``."""
    parts = F.split(folder(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = paths.select("path", F.posexplode(above).alias("depth", "folder"))
    return rows.join(configs.select("folder").distinct(), "folder").groupBy("path").agg(F.max_by("folder", "depth").alias("config"))


def by_pattern(imports: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(path, specifier, base)`` by the longest matching pattern ``(config, pattern, target)`` with at most one ``*``, of the import's configuration.

    An import meets only its own configuration's patterns, which are a few.
    """
    joined = imports.join(patterns, "config")
    before, after = F.substring_index("pattern", "*", 1), F.when(F.col("pattern").contains("*"), F.substring_index("pattern", "*", -1)).otherwise("")
    exact = ~F.col("pattern").contains("*") & (F.col("specifier") == F.col("pattern"))
    wild = F.col("pattern").contains("*") & F.col("specifier").startswith(before) & F.col("specifier").endswith(after) & (F.length("specifier") >= F.length("pattern") - 1)
    middle = F.substr("specifier", F.length(before) + 1, F.length("specifier") - F.length("pattern") + 1)
    base = F.when(exact, F.col("target")).otherwise(F.replace("target", F.lit("*"), middle))
    return joined.where(exact | wild).withColumn("base", base).groupBy("path", "specifier").agg(F.max_by("base", F.struct(exact, F.length("pattern"), "pattern")).alias("base"))


def longest_prefix(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """``(path, specifier, module, rest)``: the longest module that is the specifier or a leading part of it.

    Prefixes of the specifier are looked up, so that it is an equi-join.
    """
    parts = F.split("specifier", "/")
    rows = imports.select("path", "specifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("module"))
    found = rows.join(modules.select("module").distinct(), "module").groupBy("path", "specifier").agg(F.max_by("module", F.length("module")).alias("module"))
    return found.withColumn("rest", F.substr("specifier", F.length("module") + 2))


def python_base(path: Column, specifier: Column) -> Column:
    """Folder path of a Python import: leading dots go up from the file's folder, others start at the root."""
    dots = F.length(F.regexp_extract(specifier, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(specifier, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    return fold_path(F.when(dots > 0, F.concat_ws("/", folder(path), up, rest)).otherwise(rest))


def package_name(specifier: Column) -> Column:
    """The package of an external import: two parts for scoped names, one for others."""
    return F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))
