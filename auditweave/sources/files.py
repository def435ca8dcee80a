"""Source trees as DataFrames."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditweave.functions.codeview import code_view
from auditweave.functions.text import base_name, extension

#: Directories that a scan leaves out, the two of them that a package may publish, and the size limit.
SKIP_DIRS = (".git", "node_modules", "__pycache__", "dist", ".next", "venv", ".venv", "build")
PUBLISHABLE = ("dist", "build")
#: Files whose folder is a project.
MANIFESTS = ("package.json", "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Pipfile", "manage.py", "composer.json", "go.mod", "pom.xml", "Gemfile", "Cargo.toml")
MAX_BYTES = 1_000_000
#: Signs of a vendored asset.
MINIFIED_NAME = r"(?i)(?:\.min\.|-min\.|\.bundle\.)(?:js|jsx|mjs|cjs|ts|tsx|mts|cts)$"
VENDOR_DIRS = ("/vendor/", "/vendors/", "/third_party/", "/third-party/", "/bower_components/", "/node_modules/")
MINIFIED_LINE, LINES_READ, PREAMBLE_LINES, BANNERS = 500, 400, 40, 2
PREAMBLES = ("typeof define === 'function' && define.amd", 'typeof define === "function" && define.amd', "typeof exports === 'object' && typeof module", 'typeof exports === "object" && typeof module', "(function (root, factory)", "(function(root, factory)", "(function (global, factory)", "(function(global, factory)", "@license", "@preserve")
SCRIPTS = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")


def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None, published: tuple[str, ...] = ()) -> DataFrame:
    """file (relative, forward slashes), dir, ext, text, size_bytes. Paths are pruned before contents are decoded; one root, any file system Spark reads.

    published: relative directories among PUBLISHABLE that a manifest names."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = F.regexp_replace("path", r"^\w+:/*", "/")
    base = root.split(":", 1)[-1].rstrip("/") if ":" in root else root.rstrip("/")
    rel = F.substring(bare, len("/" + base.lstrip("/")) + 2, 1 << 20)
    parts = F.slice(F.split(rel, "/"), 1, F.size(F.split(rel, "/")) - 1)
    kept = F.lit(False)
    for p in published:
        kept = kept | rel.startswith(p.rstrip("/") + "/")
    if set(published) == set(PUBLISHABLE):  # all build folders, wherever they are
        kept = F.exists(parts, lambda d: d.isin(*PUBLISHABLE))
    pruned = F.exists(parts, lambda d: d.isin(*SKIP_DIRS)) & ~(kept & ~F.exists(parts, lambda d: d.isin(*[d for d in SKIP_DIRS if d not in PUBLISHABLE])))
    rows = raw.filter(F.col("length") <= MAX_BYTES).withColumn("file", rel).filter(~pruned).withColumn("ext", extension(F.col("file")))
    if extensions:
        rows = rows.filter(F.col("ext").isin(*extensions) | base_name(F.col("file")).isin(*extensions))
    rows = rows.select("file", F.regexp_replace("file", r"/?[^/]*$", "").alias("dir"), "ext", F.decode("content", "UTF-8").alias("text"), F.col("length").alias("size_bytes"))
    return rows.dropDuplicates(["file"])


def project_files(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``source_files``, build folders included that a manifest of the tree publishes, and ``project``: the folder of the nearest manifest above.

    A file in a build folder belongs to that folder's path, files join the published folders on it; of the folders above a
    file the longest one with a manifest is its project (the root if none has one)."""
    rows = source_files(spark, root, None, PUBLISHABLE)
    folders = F.split("dir", "/")
    first = F.array_position(F.transform(folders, lambda d: d.isin(*PUBLISHABLE)), True)
    rows = rows.withColumn("_build", F.when(first > 0, F.array_join(F.slice(folders, 1, first.cast("int")), "/")))
    manifests = rows.filter(base_name(F.col("file")).isin(*MANIFESTS) & F.col("_build").isNull())
    published = published_build_dirs(manifests).select(F.col("dir").alias("_build"))
    rows = rows.filter("_build is null").unionByName(rows.filter("_build is not null").join(published, "_build", "left_semi")).drop("_build")
    if extensions:
        rows = rows.filter(F.col("ext").isin(*extensions) | base_name(F.col("file")).isin(*extensions))
    up = F.transform(F.sequence(F.lit(0), F.size(folders)), lambda k: F.array_join(F.slice(folders, 1, k), "/"))
    above = rows.select("file", F.explode(F.array_distinct(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(up))).alias("at"))
    nearest = above.join(manifests.select(F.col("dir").alias("at")).distinct(), "at").groupBy("file").agg(F.max_by("at", F.length("at")).alias("project"))
    return rows.join(nearest, "file", "left").withColumn("project", F.coalesce("project", F.lit("")))


def release_preamble(text: Column) -> Column:
    head = F.slice(F.split(text, "\n", -1), 1, PREAMBLE_LINES)
    return F.exists(head, lambda x: reduce(or_, (F.contains(x, F.lit(p)) for p in PREAMBLES)))


#: Fixed value: fields of a package manifest that name what it publishes.
PUBLISHED_FIELDS = ("main", "module", "browser", "types", "typings", "unpkg", "jsdelivr")


def source_trees(spark: SparkSession, roots: dict[str, str], extensions: tuple[str, ...] | None = None, published: tuple[str, ...] = ()) -> DataFrame:
    """Several roots as one table: scan_id (the key of roots) before the columns of source_files."""
    out = None
    for scan, root in sorted(roots.items()):
        t = source_files(spark, root, extensions, published).select(F.lit(scan).alias("scan_id"), "*")
        out = t if out is None else out.unionByName(t)
    return out


def published_paths(files: DataFrame) -> DataFrame:
    """(dir, path): what each package.json publishes, relative to the root of the tree; dir is the manifest's folder."""
    manifest = files.filter(base_name(F.col("file")) == "package.json").select(F.regexp_replace("file", r"/?[^/]*$", "").alias("dir"), F.try_parse_json("text").alias("json"))
    text = lambda path: F.try_variant_get("json", path, "string")
    named = F.array(*(text(f"$.{f}") for f in PUBLISHED_FIELDS))
    # exports, browser maps and bin may nest at will: every string in them that looks like a path
    nested = F.regexp_extract_all(F.concat_ws(" ", *(F.to_json(F.try_variant_get("json", f"$.{f}", "variant")) for f in ("exports", "browser", "bin", "files"))), F.lit(r'"((?:\./)?[\w@.-]+(?:/[\w@.*-]+)*)"'), F.lit(1))
    paths = manifest.select("dir", F.explode(F.array_distinct(F.concat(F.filter(named, lambda x: x.isNotNull()), nested))).alias("path"))
    bare = F.regexp_replace("path", r"^(?:\./)+", "")
    return paths.select("dir", F.when(F.col("dir") == "", bare).otherwise(F.concat_ws("/", "dir", bare)).alias("path")).distinct()


def published_build_dirs(files: DataFrame) -> DataFrame:
    """Build folders among PUBLISHABLE that the manifest beside them publishes; all others stay left out of a scan."""
    rel = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substr(path, length(dir) + 2)"))
    head = F.split(rel, "/")[0]
    return published_paths(files).filter(head.isin(*PUBLISHABLE)).select(F.when(F.col("dir") == "", head).otherwise(F.concat_ws("/", "dir", head)).alias("dir")).distinct()


def with_own_release(files: DataFrame) -> DataFrame:
    """Adds own_release: the nearest package.json above a file names it or its folder, or lies in its folder.

    Every file looks at its ancestors only (their number is its depth); of those with a manifest the deepest one decides."""
    here = F.regexp_replace("file", r"/?[^/]*$", "")
    parts = F.when(F.col("_dir") == "", F.array().cast("array<string>")).otherwise(F.split("_dir", "/"))
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("at")))
    manifests = files.filter(base_name(F.col("file")) == "package.json").select(here.alias("at")).distinct()
    tried = files.select("file", here.alias("_dir")).select("file", "_dir", F.explode(up).alias("u")).select("file", "_dir", "u.depth", "u.at")
    nearest = tried.join(manifests, "at").groupBy("file", "_dir").agg(F.max_by("at", "depth").alias("package"))
    named = published_paths(files).groupBy(F.col("dir").alias("package")).agg(F.collect_set("path").alias("_paths"))
    known = nearest.join(named, "package", "left").select("file", ((F.col("_dir") == F.col("package")) | F.coalesce(F.array_contains("_paths", F.col("file")) | F.array_contains("_paths", F.col("_dir")), F.lit(False))).alias("own_release"))
    return files.drop("own_release").join(known, "file", "left").withColumn("own_release", F.coalesce("own_release", F.lit(False)))


def with_vendored(files: DataFrame) -> DataFrame:
    """Adds vendored: by name, directory, banner, line length, release preamble, or a directory with several released scripts.

    Where a column own_release is true, banner, preamble and directory don't count: a package's own release is its source."""
    low = F.lower(F.concat(F.lit("/"), "file"))
    by_dir = F.lit(False)
    for d in VENDOR_DIRS:
        by_dir = by_dir | F.contains(low, F.lit(d))
    own = F.col("own_release") if "own_release" in files.columns else F.lit(False)
    banner = F.ltrim("text").startswith("/*!")
    script = F.col("ext").isin(*SCRIPTS)
    long_line = F.exists(F.slice(F.split("text", "\n", -1), 1, LINES_READ), lambda x: F.length(x) > MINIFIED_LINE)
    released = banner | release_preamble(F.col("text"))
    dropped = F.count_if(script & released).over(Window.partitionBy("dir")) >= BANNERS
    return files.withColumn("vendored", script & (by_dir | F.col("file").rlike(MINIFIED_NAME) | long_line | (~own & (released | dropped))))


def with_code_view(files: DataFrame) -> DataFrame:
    return files.withColumn("code_view", code_view(F.col("text"), F.col("ext")))
