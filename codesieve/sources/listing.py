"""Listing a tree of files without reading them, and what of it could not be read.

Spark's readers leave out empty files and names that begin with ``_``, and can skip unreadable ones without a word.
A listing keeps them: tasks list folders level by level, so that neither the driver nor one task holds a tree.
``left_out`` reads what Spark passes over, and ``quarantine`` says which listed files are still missing, or not text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.sources.corpus import extension, stored

#: Folders within folders; a deeper tree (a loop of links, say) is an error.
MAX_DEPTH = 64
_ENTRIES = "path string, folder boolean, length long, reason string"


def _children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of each folder; a folder that can't be listed is an entry itself, with its reason."""
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path in batch["path"]:
            try:
                store, inner = fs.FileSystem.from_uri(path)
                prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
                found = store.get_file_info(fs.FileSelector(inner))
                rows += [(prefix + x.path, x.type == fs.FileType.Directory, x.size or 0, None) for x in found if not x.base_name.startswith(".")]
            except OSError as error:
                rows.append((path, False, 0, f"folder not listed: {type(error).__name__}"))
        yield pd.DataFrame(rows, columns=["path", "folder", "length", "reason"])


def listed_files(spark: SparkSession, root: str, project: str = "project") -> DataFrame:
    """(project, path, ext, length, reason) of every file under a folder, empty ones too; contents are not read.

    ``reason`` is null but for folders that can't be listed, which are rows too. Names that begin with a dot don't count.
    """
    base = root.rstrip("/")
    level = spark.createDataFrame([(base,)], "path string")
    levels = []
    for _ in range(MAX_DEPTH):
        found = stored(level.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_children, _ENTRIES))
        levels.append(found.where("NOT folder"))
        level = found.where("folder").select("path")
        if level.isEmpty():
            break
    else:
        raise ValueError(f"folders are nested deeper than {MAX_DEPTH}")
    files = reduce(DataFrame.unionByName, levels)
    path = F.when(F.col("path") == base, F.lit("")).otherwise(F.substring(F.col("path"), len(base) + 2, 1 << 30))
    return files.select(F.lit(project).alias("project"), path.alias("path"), "length", "reason").select("project", "path", extension(F.col("path")).alias("ext"), "length", "reason")


def left_out(listed: DataFrame, root: str) -> DataFrame:
    """(project, path, ext, content) of the listed files that Spark's readers pass over: empty ones, and names that begin with ``_``.

    They are read in tasks, one at a time; the content of one that can't be read is null.
    """
    base = root.rstrip("/")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    store, inner = fs.FileSystem.from_uri(f"{base}/{row.path}")
                    with store.open_input_stream(inner) as stream:
                        content = stream.read()
                except OSError:
                    content = None
                yield pd.DataFrame([(*row, content)], columns=["project", "path", "ext", "content"])

    hidden = listed.where("reason IS NULL").where((F.col("length") == 0) | F.col("path").rlike("(^|/)_")).select("project", "path", "ext")
    return hidden.mapInPandas(read, "project string, path string, ext string, content binary").withColumn("content", F.col("content").cast("string"))


def quarantine(listed: DataFrame, files: DataFrame) -> DataFrame:
    """(project, path, length, reason) of listed files that hold nothing, could not be read, or are not UTF-8.

    ``files`` (project, path, content) is what was read of the same tree; only whether a content is text is
    shuffled, never the content. Texts that are not UTF-8 are still scanned, with replaced characters.
    """
    read = files.where("content IS NOT NULL").groupBy("project", "path").agg(F.bool_and(F.is_valid_utf8("content")).alias("text"))
    told = F.when(F.col("length") == 0, "empty").when(F.col("text").isNull(), "unreadable").when(~F.col("text"), "not UTF-8")
    return listed.join(read, ["project", "path"], "left").select("project", "path", "length", F.coalesce("reason", told).alias("reason")).where("reason IS NOT NULL")
