"""Directory scans, archives and checksums on Spark's binary file reader."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import text


def scan(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """Files of one folder with an admitted suffix: path, name, stem, kind, size, modified (and
    content). Files only, no folders below; suffixes in either case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    ending = text.suffix(F.col("path"))
    kind = F.when(ending.isin(*text.RAW), "raw").when(ending.isin(*text.TIFF), "tiff").when(ending.isin(*text.JPEG), "jpeg")
    out = files.select(
        "path", text.name(F.col("path")).alias("name"), F.lower(text.stem(F.col("path"))).alias("stem"), kind.alias("kind"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []),
    )
    return out.filter(F.col("kind").isNotNull())


def without_sidecars(files: DataFrame) -> DataFrame:
    """A scan without JPEGs whose stem, in any case, is that of a raw file."""
    raw = files.filter("kind = 'raw'").select("stem")
    jpeg = files.filter("kind = 'jpeg'").join(raw, "stem", "left_anti")
    return files.filter("kind <> 'jpeg'").unionByName(jpeg)


def archive_members(spark: SparkSession, pattern: str) -> DataFrame:
    """archive, member, content of every file inside the zip files that match, read one archive at
    a time. A broken archive gives one row with an error and no member."""
    zips = spark.read.format("binaryFile").load(pattern).select("path", "content")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for name in z.namelist():
                            if not name.endswith("/"):
                                yield pd.DataFrame({"archive": [path], "member": [name], "content": [z.read(name)], "error": [None]})
                except zipfile.BadZipFile as e:
                    yield pd.DataFrame({"archive": [path], "member": [None], "content": [None], "error": [str(e)]})

    return zips.mapInPandas(members, "archive string, member string, content binary, error string")


def worklist(catalog: DataFrame, local: DataFrame) -> DataFrame:
    """Catalog rows that no local file (name, content) matches by name and checksum."""
    have = local.select("name", F.md5("content").alias("md5"))
    return catalog.join(have, ["name", "md5"], "left_anti")
