"""Source files as a table: scan, selection, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions.durable import durable
from corpuslens.functions.text import decode_lenient, normalize_newlines, path_sort_key

MAIN_ROOT = "src/main/java/"
TEST_ROOT = "src/test/java/"
# Fixed value: directories that never hold sources of interest.
EXCLUDED_DIRS = ("build", "target", ".git", "node_modules")


def read_source_tree(spark: SparkSession, root: str, glob: str = "*.java") -> DataFrame:
    """files(repo, file_path, source) from ``<root>/<repo>/<path>`` on shared storage."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    # The listed path may carry a scheme; what follows the root is '<repo>/<path>'.
    below = rf"\Q{root.rstrip('/')}/\E([^/]+)/(.+)$"
    return raw.select(
        F.regexp_extract("path", below, 1).alias("repo"),
        F.regexp_extract("path", below, 2).alias("file_path"),
        normalize_newlines(decode_lenient(F.col("content"))).alias("source"),
    )


def root_rank(path: Column) -> Column:
    return (
        F.when(F.startswith(path, F.lit(MAIN_ROOT)), F.lit(0))
        .when(F.startswith(path, F.lit(TEST_ROOT)), F.lit(1))
        .otherwise(F.lit(2))
    )


def file_order(path: Column) -> Column:
    """Sort key of the selection order: main root, test root, rest; by path component."""
    return F.concat(root_rank(path).cast("string"), path_sort_key(path))


def select_sources(files: DataFrame, include_tests: bool = False) -> DataFrame:
    """Java files of the standard roots, or of the whole tree where a repo has no main root.

    A main root counts whatever files it holds. The flag is aggregated from paths alone
    (map-side combined) and joined back, so neither the texts nor a large repo are pulled
    into one window task.
    """
    java = files.filter(F.col("file_path").endswith(".java"))
    roots = files.groupBy("repo").agg(
        F.bool_or(root_rank(F.col("file_path")) == 0).alias("has_main")
    )
    rank = root_rank(F.col("file_path"))
    excluded = F.arrays_overlap(
        F.split("file_path", "/"), F.array(*[F.lit(name) for name in EXCLUDED_DIRS])
    )
    wanted = (rank == 0) | ((rank == 1) & F.lit(include_tests))
    return (
        java.join(roots, "repo")
        .filter(F.when(F.col("has_main"), wanted).otherwise(~excluded))
        .drop("has_main")
    )


def number_sources(files: DataFrame) -> DataFrame:
    """(repo, file_path, file_ord) of files(repo, file_path, ...): places in repo, then selection order.

    Numbers have no gaps, so they stay below the number of files. Paths alone are sorted, by
    ranges in parallel; only one row a range is summed up in a single task.
    """
    keyed = files.select("repo", "file_path", file_order(F.col("file_path")).alias("_key"))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = durable(
        keyed.repartitionByRange("repo", "_key")
        .sortWithinPartitions("repo", "_key")
        .select("repo", "file_path", F.spark_partition_id().alias("_part"), within.alias("_at"))
    )
    so_far = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before")
    )
    return ranged.join(before, "_part").select("repo", "file_path", (F.col("_before") + F.col("_at")).alias("file_ord"))


def cap_sources(files: DataFrame, max_files: int | None, salts: int = 64) -> DataFrame:
    """First ``max_files`` of each repo in selection order; None keeps all, 0 none.

    Ranks narrow rows only: the pre-trim inside (repo, salt) bounds what reaches the
    final rank, so one huge repo is cut by many tasks before a single one orders it.
    """
    if max_files is None:
        return files
    if max_files <= 0:
        return files.limit(0)
    keyed = files.withColumn("_key", file_order(F.col("file_path"))).withColumn(
        "_salt", F.pmod(F.xxhash64("file_path"), F.lit(salts))
    )
    within_salt = Window.partitionBy("repo", "_salt").orderBy("_key")
    within_repo = Window.partitionBy("repo").orderBy("_key")
    keep = (
        keyed.select("repo", "_salt", "_key")
        .withColumn("_rn", F.row_number().over(within_salt))
        .filter(F.col("_rn") <= max_files)
        .withColumn("_rn", F.row_number().over(within_repo))
        .filter(F.col("_rn") <= max_files)
        .select("repo", "_key")
    )
    return keyed.join(keep, ["repo", "_key"], "left_semi").drop("_key", "_salt")


def first_excerpt(files: DataFrame, candidates: list[str], limit: int) -> DataFrame:
    """Per repo the first present candidate, cut to ``limit`` characters."""
    names = F.array(*[F.lit(name) for name in candidates])
    ranked = files.filter(F.col("file_path").isin(candidates)).select(
        "repo",
        F.array_position(names, F.col("file_path")).alias("rank"),
        "file_path",
        F.substring("source", 1, limit).alias("text"),
    )
    return ranked.groupBy("repo").agg(
        F.min_by("file_path", "rank").alias("file_path"),
        F.min_by("text", "rank").alias("excerpt"),
    )


# Candidate names in order, and excerpt sizes.
README_CANDIDATES = ["README.md", "Readme.md", "readme.md"]
README_LIMIT = 4000
BUILD_CANDIDATES = ["build.gradle.kts", "build.gradle", "pom.xml"]
BUILD_LIMIT = 3000
