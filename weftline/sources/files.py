"""Workspace files as tables: walks, listings, glob search, manifests and versions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import LANGUAGES, language_of

MANIFESTS = {"Cargo.toml": "rust", "package.json": "node", "pyproject.toml": "python", "go.mod": "go"}


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression over whole paths: ``*`` and ``?`` cross no slash, ``**`` does."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i]))
            i += 1
    return f"^{out}$"


def ignore_rules(folder: str, text: str) -> list[tuple[str, bool]]:
    """(regex of paths, whether they are ignored) for the lines of an ignore file in a folder, which is relative and may be empty."""
    out = []
    for line in text.splitlines():
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        ignored = not rule.startswith("!")
        rule = rule.removeprefix("!").removeprefix("\\")
        below = rule.endswith("/")
        rule = rule.rstrip("/")
        anywhere = "/" not in rule
        body = glob_regex(rule.lstrip("/"))[1:-1]
        start = re.escape(folder + "/" if folder else "") + ("(?:.*/)?" if anywhere else "")
        out.append((f"^{start}{body}/" if below else f"^{start}{body}(?:/|$)", ignored))
    return out


def ignore_files(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """Rules of all .gitignore files below a root, outer folders first; files are listed and rules read by the driver."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    base, found, files = fs.makeQualified(where).toUri().getPath().rstrip("/"), [], fs.listFiles(where, True)
    while files.hasNext():
        path = files.next().getPath()
        if path.getName() == ".gitignore":
            stream = fs.open(path)
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            found.append((path.getParent().toUri().getPath()[len(base) :].strip("/"), text))
    return [r for folder, text in sorted(found, key=lambda x: (x[0].count("/") + bool(x[0]), x[0])) for r in ignore_rules(folder, text)]


def walk_sources(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), languages: bool = True, ignore_file: bool = True) -> DataFrame:
    """(path, language, content, size) of files below a root, those without a known language, under an ignored
    glob or ignored by the .gitignore files there left out; of several rules that fit, the last one decides.

    Contents are read as UTF-8 and only where a later step asks for them. Spark lists no file whose name
    begins with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    base = root.split(":", 1)[-1].rstrip("/")
    rel = F.substring(path, F.lit(len("/" + base.lstrip("/")) + 2), F.length(path))
    out = files.select(rel.alias("path"), language_of(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"))
    for pattern in ignore:
        out = out.where(~F.col("path").rlike(glob_regex(pattern)))
    if ignore_file and (rules := ignore_files(spark, root)):
        verdict = F.coalesce(*[F.when(F.col("path").rlike(regex), F.lit(ignored)) for regex, ignored in reversed(rules)], F.lit(False))
        out = out.where(~verdict)
    return out.where("language is not null") if languages else out


def walk_markdown(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, language, content, size) of markdown files."""
    return walk_sources(spark, root, ignore).where("language = 'markdown'")


def listing(paths: DataFrame, depth: int | None = 1, most: int = 200) -> DataFrame:
    """(path, kind) of files and folders down to a depth, one more than ``most`` at most: the one more says that there are others."""
    parts = F.split("path", "/")
    rows = paths.select("path", parts.alias("p")).withColumn("n", F.size("p"))
    cut = F.least("n", F.lit(depth if depth is not None else 3))
    seen = rows.select(F.explode(F.transform(F.sequence(F.lit(1), cut), lambda k: F.struct(F.array_join(F.slice("p", 1, k), "/").alias("path"), F.when(k < F.col("n"), "dir").otherwise("file").alias("kind")))).alias("e")).select("e.*").distinct()
    return seen.orderBy("path").limit(most + 1)


def glob_search(paths: DataFrame, pattern: str, most: int = 100) -> DataFrame:
    """The first paths by name that a glob fits."""
    return paths.where(F.col("path").rlike(glob_regex(pattern))).orderBy("path").limit(most)


def nearest_manifest(paths: DataFrame, manifests: DataFrame) -> DataFrame:
    """(path, manifest, ecosystem): the manifest in the closest folder above each path; null without one."""
    folders = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda k: F.array_join(F.slice("p", 1, k), "/"))
    above = paths.select("path", F.split("path", "/").alias("p")).select("path", F.posexplode(folders).alias("depth", "folder"))
    name = F.substring_index("path", "/", -1)
    kinds = F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv])
    known = manifests.where(name.isin(*MANIFESTS)).select(F.col("path").alias("manifest"), F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.try_element_at(kinds, name).alias("ecosystem"))
    best = above.join(known, "folder").groupBy("path").agg(F.max(F.struct("depth", "manifest", "ecosystem")).alias("b"))
    return paths.join(best, "path", "left").select("path", "b.manifest", "b.ecosystem")


def locked_versions(files: DataFrame) -> DataFrame:
    """(path, package, version) from Cargo.lock and package-lock.json files (path, content)."""
    cargo = F.regexp_extract_all("content", F.lit(r'name = "([^"]+)"\s+version = "[^"]+"'), 1), F.regexp_extract_all("content", F.lit(r'name = "[^"]+"\s+version = "([^"]+)"'), 1)
    a = files.where("path like '%Cargo.lock'").select("path", F.explode(F.arrays_zip(*[c.alias(n) for c, n in zip(cargo, ("package", "version"), strict=True)])).alias("e")).select("path", "e.*")
    packages = F.from_json(F.get_json_object("content", "$.packages"), "map<string,struct<version:string>>")
    b = files.where("path like '%package-lock.json'").select("path", F.explode(packages).alias("k", "v")).where("k like 'node_modules/%'")
    return a.unionByName(b.select("path", F.regexp_replace("k", "^.*node_modules/", "").alias("package"), F.col("v.version").alias("version")))


__all__ = ["LANGUAGES", "glob_regex", "glob_search", "listing", "locked_versions", "nearest_manifest", "walk_markdown", "walk_sources"]
