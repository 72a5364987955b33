"""Delivered archives, opened inside Spark tasks.

``spark.read.format("binaryFile")`` lists the archives; each task opens those it was dealt,
member by member, and hands their lines on in bounded batches. Only the packed bytes of one
archive are in a worker at a time, never its unpacked text. Nothing is read through the driver
or from a path that only one machine knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

LINES = "archive string, member string, number long, value string, problem string"
BATCH_BYTES = 1 << 20


def archive_lines(archives: DataFrame, encoding: str = "utf-8", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(archive, member, number, value, problem): the lines of every member of zip archives (``path``, ``content``).

    Lines keep their order by ``number`` (from 0). Undecodable bytes become U+FFFD. A member that
    can't be read to its end gives its good lines and then one row with ``problem`` and no
    ``value``; so does an archive that can't be opened (``member`` null). Folders are skipped,
    as are null contents.
    """
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile
        import zlib

        names = [column.split()[0] for column in LINES.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            return out.astype({"number": "Int64"})

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if content is None:
                    continue
                try:
                    packed = zipfile.ZipFile(io.BytesIO(content))
                except (zipfile.BadZipFile, OSError) as error:
                    yield frame([(path, None, None, None, f"{type(error).__name__}: {error}")])
                    continue
                for member in packed.infolist():
                    if member.is_dir():
                        continue
                    rows, held, number = [], 0, 0
                    try:
                        with packed.open(member) as stream:
                            for line in io.TextIOWrapper(stream, encoding, errors="replace"):
                                rows.append((path, member.filename, number, line.rstrip("\r\n"), None))
                                held, number = held + len(line) + 64, number + 1
                                if held >= batch_bytes:
                                    yield frame(rows)
                                    rows, held = [], 0
                    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError) as error:
                        rows.append((path, member.filename, None, None, f"{type(error).__name__}: {error}"))
                    if rows:
                        yield frame(rows)

    return archives.select("path", "content").mapInPandas(expand, LINES)


def read_archives(spark: SparkSession, path: str, pattern: str = "*.zip", **options) -> DataFrame:
    """Lines of all archives below a folder that Spark can read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return archive_lines(found, **options)


def write_archives(lines: DataFrame, path: str) -> None:
    """(archive, member, number, value) rows to zip archives ``<archive>.zip`` in a folder all executors share.

    The packed bytes travel back as one row per archive and Spark writes them, each archive in a
    folder of its own, so that the target may be any file system Spark knows.
    """
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        target = io.BytesIO()
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as packed:
            for member, rows in pdf.sort_values(["member", "number"], kind="stable").groupby("member", sort=True):
                packed.writestr(member, "".join(f"{v}\n" for v in rows["value"]))
        return pd.DataFrame({"archive": [pdf["archive"].iloc[0]], "content": [target.getvalue()]})

    packed = lines.groupBy("archive").applyInPandas(pack, "archive string, content binary")
    packed.write.mode("overwrite").parquet(path)


def stored_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of what ``write_archives`` stored."""
    return spark.read.schema("archive string, content binary").parquet(path).withColumnRenamed("archive", "path")
