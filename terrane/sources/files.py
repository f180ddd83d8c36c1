"""File sources and sinks: text, Markdown directories, JSON lines, images, and a registry of loaders by suffix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.text import strip_data_images


class Loaders:
    """Suffix to loader and splitter; the last registration wins. Images have no splitter."""

    IMAGES = (".jpg", ".png")

    def __init__(self):
        self.loaders: dict[str, Callable] = {".txt": read_texts, ".md": read_markdown, ".jpg": read_images, ".png": read_images}
        self.splitters: dict[str, Callable] = {}

    def register_loader(self, suffixes: list[str], loader: Callable) -> None:
        self.loaders |= {s: loader for s in suffixes}

    def register_splitter(self, suffixes: list[str], splitter: Callable) -> None:
        if set(suffixes) & set(self.IMAGES):
            raise KeyError("images have no splitter")
        self.splitters |= {s: splitter for s in suffixes}

    def unregister(self, what: Callable, suffix: str | None = None) -> None:
        for d in (self.loaders, self.splitters):
            for s in [s for s, f in d.items() if f is what and suffix in (None, s)]:
                del d[s]

    def get_loader(self, suffix: str) -> Callable:
        return self.loaders[suffix]

    def get_splitter(self, suffix: str) -> Callable:
        return self.splitters[suffix]

    def supported(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Files (path) that have loader and splitter (or are images), and the rest."""
        known = [s for s in self.loaders if s in self.splitters or s in self.IMAGES]
        suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
        f = files.withColumn("suffix", suffix)
        return f.where(F.col("suffix").isin(known)), f.where(~F.col("suffix").isin(known))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, text) of the Markdown files of a directory, without embedded images and empty files."""
    t = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    t = t.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("_metadata.file_name", r"(.*)\.md$", 1).alias("title"), strip_data_images(F.col("value")).alias("text"))
    return t.where(F.trim("text") != "")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image, type): the bytes in base64."""
    return spark.read.format("binaryFile").load(path).select("path", F.base64("content").alias("image"), F.lit("image").alias("type"))


def list_files(spark: SparkSession, path: str, allowed: list[str] | None = None) -> DataFrame:
    """(path, size) of a directory's own files, below an allowed prefix if any are given."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", F.col("length").alias("size"))
    if allowed:
        ok = F.lit(False)
        for prefix in allowed:
            ok = ok | F.col("path").startswith(prefix)
        f = f.where(ok)
    return f


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def resume(done: DataFrame, todo: DataFrame, key: str) -> DataFrame:
    """The rows of `todo` that are not written yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
