"""TSV sources: records, ground truth, id lists, whole trees of files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schema import REQUIRED, source_of_start


def fs_of(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = fs_of(spark, path)
    return bool(fs.exists(p))


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """File names of a folder in the cluster's store, sorted."""
    p, fs = fs_of(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile())


def header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].lstrip("﻿").rstrip("\r").split("\t") if first else []


def load_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text: short rows padded with ``''``, rows with too many fields dropped, ``NA`` kept.

    A spare last column catches surplus fields; a row whose one surplus field is empty stays.
    """
    if not exists(spark, path):
        raise FileNotFoundError(f"no such file: {path}")
    return rows_of_header(spark, [path], header(spark, path))


def open_quotes(spark: SparkSession, paths: list[str]) -> bool:
    """Whether any line has a field whose quote is not closed on it."""
    inside = F.regexp_replace(F.regexp_replace("value", '(^|\t)"([^"]|"")*"(?=\t|$)', ""), "\r$", "")
    return not spark.read.text(paths).where(F.contains("value", F.lit('"')) & inside.rlike('(^|\t)"')).isEmpty()


def rows_of_header(spark: SparkSession, paths: list[str], head: list[str]) -> DataFrame:
    """The rows of files with one header.  Files are split among tasks unless a quoted field runs over lines."""
    names = [c.strip('"') for c in head]
    spare = "_surplus"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, spare]])
    raw = spark.read.csv(paths, sep="\t", header=True, schema=schema, quote='"', escape='"', multiLine=open_quotes(spark, paths), enforceSchema=True, mode="PERMISSIVE")
    return raw.where(F.col(spare).isNull()).select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])


def load_source(spark: SparkSession, path: str, source_name: str | None = None) -> DataFrame:
    """A record table; missing required columns raise, further columns pass through."""
    df = load_tsv(spark, path)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return df.withColumn("source", F.lit(source_name) if source_name else source_of_start(F.col("entity_id")))


def load_all_sources(spark: SparkSession, data_dir: str, split: str = "train") -> dict[str, DataFrame]:
    return {f"source{k}": load_source(spark, f"{data_dir}/{split}/{split}_source{k}.tsv", f"source{k}") for k in (1, 2, 3)}


def load_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return load_tsv(spark, path)


def numbered(df: DataFrame) -> DataFrame:
    """Add ``ord``, increasing in file order for an unshuffled scan."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def parse_ground_truth(df: DataFrame) -> DataFrame:
    """Rows (s1_id, s2, s3): combined lists are split by prefix, separate lists are taken as they are; the last row of a key wins."""
    if "ord" not in df.columns:
        df = numbered(df)
    key = "source1_entity_id" if "source1_entity_id" in df.columns else "entity_id"
    if "matched_entity_ids" in df.columns:
        ids = X.id_list(F.col("matched_entity_ids"))
        s2, s3 = F.filter(ids, lambda x: x.startswith("S2-")), F.filter(ids, lambda x: x.startswith("S3-"))
    else:
        s2, s3 = (X.id_list(F.col(c)) if c in df.columns else F.array().cast("array<string>") for c in ("source2_matches", "source3_matches"))
    last = Window.partitionBy("s1_id").orderBy(F.desc("ord"))
    rows = df.select(F.col(key).alias("s1_id"), s2.alias("s2"), s3.alias("s3"), "ord")
    return rows.withColumn("rank", F.row_number().over(last)).where("rank = 1").select("s1_id", "s2", "s3")


def truth_pairs(ground_truth: DataFrame) -> DataFrame:
    """Distinct (s1_id, target_id); blanks drop out."""
    pairs = ground_truth.select("s1_id", F.explode(F.array_union("s2", "s3")).alias("target_id"))
    return pairs.where("target_id <> ''").distinct()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a file's first column, without its header line and blank lines."""
    lines = numbered(spark.read.text(path))
    first = lines.agg(F.min("ord")).first()[0]
    ids = lines.where((F.col("ord") != F.lit(first)) & (F.trim("value") != "")).select(F.trim(F.split_part("value", F.lit("\t"), F.lit(1))).alias("entity_id"))
    return ids.distinct()


def scan_tree(spark: SparkSession, folder: str, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Every ``*.tsv`` below a folder but those with ``ground_truth`` in their path, with its ``file`` path.

    Each file goes by its own header; columns that it lacks are empty.  Files with one header are one scan.
    """
    paths = [x for x in list_tree(spark, folder) if x.endswith(".tsv") and "ground_truth" not in x]
    heads: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        heads.setdefault(tuple(header(spark, path)), []).append(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("file", *columns)])
    out = spark.createDataFrame([], schema)
    for head, files in heads.items():
        if not head:
            continue
        names = [c.strip('"') for c in head]
        own = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_surplus"]])
        raw = spark.read.csv(files, sep="\t", header=True, schema=own, quote='"', escape='"', multiLine=open_quotes(spark, files), enforceSchema=True, mode="PERMISSIVE")
        picked = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in columns]
        out = out.unionByName(raw.where(F.col("_surplus").isNull()).select(F.col("_metadata.file_path").alias("file"), *picked))
    return out


def list_tree(spark: SparkSession, folder: str) -> list[str]:
    """Paths of all files below a folder, sorted."""
    p, fs = fs_of(spark, folder)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        found.append(files.next().getPath().toString())
    return sorted(found)


def load_config(path: str) -> dict:
    """A YAML file as a dict; absent or empty gives ``{}``."""
    import os

    if not os.path.isfile(path):
        return {}
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f) or {}
    except ImportError:
        return plain_yaml(path)


def plain_yaml(path: str) -> dict:
    """Nested ``key: value`` maps of scalars, where no YAML package is installed."""
    top: dict = {}
    stack = [(-1, top)]
    with open(path, encoding="utf-8") as f:
        for line in f:
            body = line.split(" #")[0].rstrip()
            if not body.strip() or body.lstrip().startswith("#") or ":" not in body:
                continue
            depth = len(body) - len(body.lstrip())
            key, _, value = body.strip().partition(":")
            while stack[-1][0] >= depth:
                stack.pop()
            if value.strip():
                stack[-1][1][key] = scalar(value.strip())
            else:
                stack[-1][1][key] = {}
                stack.append((depth, stack[-1][1][key]))
    return top


def scalar(value: str):
    if value[0] in "\"'" and value[-1] == value[0]:
        return value[1:-1]
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None}.get(value.lower(), value)


@dataclass
class DatasetLoader:
    """Finds and loads the files of one split folder."""

    spark: SparkSession
    data_dir: str

    def find_file(self, prefix: str) -> str:
        names = [n for n in list_names(self.spark, self.data_dir) if n.endswith(".tsv")] if exists(self.spark, self.data_dir) else []
        ranked = [n for n in names if n.startswith(prefix)] + [n for n in names if prefix in n]
        if not ranked:
            raise FileNotFoundError(f"no TSV file for {prefix!r} in {self.data_dir}")
        return f"{self.data_dir}/{ranked[0]}"

    def load_source_records(self, prefix: str, source_name: str) -> DataFrame:
        df = numbered(load_source(self.spark, self.find_file(prefix), source_name))
        return df.select(*REQUIRED, "source", "ord")

    def load_sources(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return tuple(self.load_source_records(f"source{k}", f"source{k}") for k in (1, 2, 3))

    def load_ground_truth(self) -> DataFrame:
        return parse_ground_truth(numbered(load_tsv(self.spark, self.find_file("ground_truth"))))
