"""Files: their properties, pages decoded from them, and a data source of positioned words."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Media types by the ending of the name
MEDIA_TYPES = {"pdf": "application/pdf", "txt": "text/plain", "html": "text/html", "htm": "text/html", "json": "application/json", "parquet": "application/vnd.apache.parquet"}
PAGES = "path string, page_idx long, text string, error string"


def properties(spark: SparkSession, path: str) -> DataFrame:
    """name, size, media_type, sha256 and whether it is a PDF, of each file below path."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    types = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.col("length").alias("size"),
        F.coalesce(F.try_element_at(types, ending), F.lit("application/octet-stream")).alias("media_type"),
        F.sha2("content", 256).alias("sha256"),
        (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"),
    )


def decoded_pages(files: DataFrame, decode: Callable[[bytes], Iterator[str | Exception]]) -> DataFrame:
    """path, page_idx, text, error: pages of binary files by a decoder that yields each page's text, or what it failed with.

    A page that fails is a row with its error, and so is a file that cannot be opened; neither ends the job.
    """

    def read(parts):
        for pdf in parts:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    for k, page in enumerate(decode(content)):
                        failed = isinstance(page, Exception)
                        out.append((path, k, "" if failed else page, str(page) if failed else None))
                except Exception as e:
                    out.append((path, 0, "", str(e)))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in PAGES.split(", ")])

    return files.select("path", "content").mapInPandas(read, PAGES)


class LayoutWords(DataSource):
    """Text files as words with their places: spark.read.format("layout_words").option("path", folder)."""

    @classmethod
    def name(cls) -> str:
        return "layout_words"

    def schema(self) -> str:
        return "file string, line_no long, word_no long, word string, x0 double, x1 double, top double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if f.endswith(".txt")]

    def read(self, partition: InputPartition):
        with open(partition.value, encoding="utf-8") as f:
            for n, line in enumerate(f):
                at = 72.0
                for k, word in enumerate(line.split()):
                    yield os.path.basename(partition.value), n, k, word, at, at + 6.0 * len(word), 72.0 + 12 * (n % 50)
                    at += 6.0 * (len(word) + 1)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LayoutWords)
