"""Source trees as DataFrames, and sinks."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DOC_EXTENSIONS, DOC_STEMS, MAX_FILE_BYTES
from lodestone.sources.ignore import IgnoreRules
from lodestone.sources.languages import LANGUAGES

# Directories that a scan leaves out.
IGNORED_DIRS = (
    ".git", ".hg", ".svn",
    "node_modules", "vendor", "dist", "build", "target",
    "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    ".venv", "venv", "env",
    ".tox", ".eggs", "site-packages",
)

# The names that a repository reference may have.
OWNER = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
REPO = "[A-Za-z0-9_.][A-Za-z0-9_.-]*"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def is_code(path: Column) -> Column:
    return extension(path).isin(*LANGUAGES)


def is_document(path: Column) -> Column:
    """Prose at the root of the tree, or anywhere under one of the well-known names."""
    stem = F.substring_index(path, "/", -1)
    known = stem.rlike("(?i)^(" + "|".join(DOC_STEMS) + ")")
    return extension(path).isin(*DOC_EXTENSIONS) & (~F.contains(path, F.lit("/")) | known)


def in_ignored_dir(path: Column) -> Column:
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(folders, F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def select_sources(listing: DataFrame, ignored: DataFrame | IgnoreRules | None = None) -> DataFrame:
    """Of (path, length) rows with paths relative to the root, the files to index.

    ``ignored`` lists files that version control leaves out (path), or holds its rules; without it all are kept.
    """
    path = F.col("path")
    kept = listing.filter((F.col("length") <= MAX_FILE_BYTES) & (is_code(path) | is_document(path)) & ~in_ignored_dir(path))
    if isinstance(ignored, IgnoreRules):
        return kept.filter(~_ruled_out(ignored)(path))
    return kept if ignored is None else kept.join(ignored.select("path"), "path", "left_anti")


def in_tree_order(files: DataFrame) -> DataFrame:
    return files.orderBy(F.split("path", "/"))


def _ruled_out(rules: IgnoreRules):
    @F.pandas_udf("boolean")
    def ruled_out(paths: pd.Series) -> pd.Series:
        return paths.map(rules.ignored).astype(bool)

    return ruled_out


class Tree:
    """A folder of a file system that Spark reads, listed folder by folder; ignored folders are not entered."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.path = self.jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def entries(self, folder: str) -> list[tuple[str, int, bool, object]]:
        """(name, length, is a folder, path) of what is in a folder, in order."""
        at = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}") if folder else self.path
        found = [(x.getPath().getName(), x.getLen(), x.isDirectory(), x.getPath()) for x in self.fs.listStatus(at)]
        return sorted(found, key=lambda x: x[0])

    def text(self, path) -> str:
        stream = self.fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    def walk(self) -> Iterator[tuple[str, int, object]]:
        folders = [""]
        while folders:
            folder = folders.pop(0)
            for name, length, is_folder, path in self.entries(folder):
                below = f"{folder}/{name}" if folder else name
                if not is_folder:
                    yield below, length, path
                elif name not in IGNORED_DIRS:
                    folders.append(below)


def scan_tree(spark: SparkSession, root: str, ignored: DataFrame | IgnoreRules | None = None, rules: bool = True) -> DataFrame:
    """path (relative), length, text of the source files under ``root``.

    The driver lists one repository's tree; only files that are kept are read, by the cluster.  In a
    tree under version control its ignore files count, unless ``rules`` is off.  Bytes that are no
    UTF-8 become replacement characters.
    """
    tree = Tree(spark, root)
    listed = list(tree.walk())
    if ignored is None and rules and any(name == ".git" for name, *_ in tree.entries("")):
        ignored = IgnoreRules((p.rpartition("/")[0], tree.text(at)) for p, _, at in listed if p.rpartition("/")[2] == ".gitignore")
    listing = spark.createDataFrame([(p, n, at.toString()) for p, n, at in listed], "path string, length long, place string")
    kept = select_sources(listing, ignored)
    places = [r["place"] for r in kept.select("place").toLocalIterator()]
    if not places:
        return spark.createDataFrame([], "path string, length long, text string")
    # globs in names are taken literally
    literal = [re.sub(r"([\\{}\[\]*?,])", r"\\\1", p) for p in places]
    read = spark.read.format("binaryFile").load(literal).select(F.col("path").alias("at"), "content")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    read = read.select(plain(F.col("at")).alias("place"), text.alias("text"))
    found = kept.withColumn("place", plain(F.col("place"))).join(read, "place").select("path", "length", "text")
    return in_tree_order(found)


def parse_ref(text: Column) -> Column:
    """``owner/repo`` of a repository reference, null if it is none."""
    body = F.regexp_replace(F.regexp_replace(F.trim(text), r"/$", ""), r"\.git$", "")
    body = F.regexp_replace(body, r"^(?:https?://)?(?:www\.)?(?:github\.com/)?", "")
    fits = body.rlike(f"^{OWNER}/{REPO}$")
    return F.when(fits & ~F.substring_index(body, "/", -1).isin(".", ".."), body)


def collection_name(name: Column) -> Column:
    """Stable table name of a repository: a readable slug and a digest."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("repo_"), F.substring(slug, 1, 40), F.lit("_"), F.substring(F.sha2(name, 256), 1, 8))


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    """Write a Parquet table; one that is there is deleted first, so that readers see ``write_version``s instead."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, or an empty one of ``schema`` where it is missing; files that cannot be read count as absent."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


VERSIONS = "version string, at long"


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The folder of the tables that were last published under ``folder``, null if there are none."""
    last = read_or_empty(spark, f"{folder}/versions", VERSIONS).orderBy(F.desc("at"), F.desc("version")).first()
    return f"{folder}/{last['version']}" if last else None


def write_version(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> str:
    """Writes a set of tables beside the current ones and then publishes them in one commit.

    A reader sees all of the old tables or all of the new ones; a build that fails leaves the old ones.
    Versions before the last two are deleted.
    """
    name = f"v-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{name}/{table}")
    row = spark.createDataFrame([(name, time.time_ns())], VERSIONS)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    known = read_or_empty(spark, f"{folder}/versions", VERSIONS).orderBy(F.desc("at")).offset(2)
    tree = Tree(spark, folder)
    for r in known.toLocalIterator():
        tree.fs.delete(tree.jvm.org.apache.hadoop.fs.Path(f"{tree.root}/{r['version']}"), True)
    return f"{folder}/{name}"


def repositories(spark: SparkSession, root: str, indexes: str) -> DataFrame:
    """name, path, indexed of every repository folder under ``root``, by name.

    A folder ``owner__repo`` is shown as ``owner/repo``; it is indexed if a version was published for it.
    """
    names = [n for n, _, is_folder, _ in Tree(spark, root).entries("") if is_folder]
    rows = spark.createDataFrame([(n, f"{root.rstrip('/')}/{n}") for n in names], "folder string, path string")
    rows = rows.withColumn("collection", collection_name(F.col("path")))
    there = [n for n, _, is_folder, _ in Tree(spark, indexes).entries("") if is_folder and current_version(spark, f"{indexes.rstrip('/')}/{n}")]
    built = spark.createDataFrame([(n,) for n in there], "collection string").withColumn("built", F.lit(True))
    return rows.join(built, "collection", "left").select(display_name(F.col("folder")).alias("name"), "path", F.coalesce("built", F.lit(False)).alias("indexed")).orderBy("name")


def display_name(folder: Column) -> Column:
    """The first double underscore of a folder's name stands for the slash of its reference."""
    return F.regexp_replace(folder, "^(.*?)__", "$1/")


def event_frame(event: Column, payload: Column) -> Column:
    """One server-sent event."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))
