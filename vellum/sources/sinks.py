"""Reports written for people: CSV with a header even when empty, JSON summaries, and archives of both; snapshots read back."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(rows: DataFrame, path: str) -> None:
    """One folder of CSV parts, each with a header; an empty result still has one part with the header."""
    parts = rows if not rows.isEmpty() else rows.coalesce(1)
    parts.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    if rows.isEmpty():
        rows.sparkSession.createDataFrame([(",".join(rows.columns),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def summary_json(**tables: DataFrame) -> str:
    """Small tables as one JSON object; meant for counts, so each is refused beyond ten thousand rows."""
    out = {}
    for name, df in tables.items():
        rows = df.limit(10_001).collect()
        if len(rows) > 10_000:
            raise ValueError(f"{name} is no summary")
        out[name] = [r.asDict(recursive=True) for r in rows]
    return json.dumps(out, ensure_ascii=False, default=str, sort_keys=True)


def write_archive(path: str, **texts: str) -> None:
    """A zip archive of named texts."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in texts.items():
            z.writestr(name.replace("__", "."), text)


@F.pandas_udf(T.StringType())
def _unpacked(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def text(raw: bytes) -> str | None:
        try:
            return (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8", "replace")
        except (OSError, EOFError):
            return None

    for batch in contents:
        yield batch.map(lambda x: text(bytes(x)))


def page_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """``path, html`` of page snapshots, compressed or not; html is null where a file is damaged."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", _unpacked("content").alias("html"))


def strict_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per file with exactly the fields of ``schema``; anything else fails and names the file."""
    whole = spark.read.option("wholetext", True).text(path).select("value", F.input_file_name().alias("_file"))
    names = F.array(*(F.lit(f.name) for f in schema.fields))
    keys = F.json_object_keys("value")
    wrong = keys.isNull() | (F.size(F.array_except(keys, names)) > 0) | (F.size(F.array_except(names, keys)) > 0)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("unexpected fields in "), "_file"))).otherwise(F.col("value"))
    return whole.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("o")).select("o.*")


def write_snapshots(pages: DataFrame, path: str, html_col: str = "html", most_bytes: int = 5_000_000) -> DataFrame:
    """Compressed markup under its own digest, each distinct page once, and ``digest, n_bytes, path`` of what was written.

    ``path`` is a folder that all executors share. A file that is there already is left alone, and one that is written is
    complete before it gets its name, so a task that is run again does no harm. Null and empty markup is left out; a page
    over ``most_bytes`` fails.
    """
    distinct = pages.select(F.col(html_col).alias("html")).where("html != ''").groupBy(F.sha2("html", 256).alias("digest")).agg(F.first("html").alias("html"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(path, exist_ok=True)
        for frame in frames:
            out = []
            for digest, html in zip(frame["digest"], frame["html"], strict=True):
                raw = html.encode("utf-8", "replace")
                if len(raw) > most_bytes:
                    raise ValueError(f"page {digest} has {len(raw)} bytes, more than {most_bytes}")
                target = os.path.join(path, f"{digest}.html.gz")
                if not os.path.exists(target):
                    part = f"{target}.{os.getpid()}"
                    with gzip.open(part, "wb") as f:
                        f.write(raw)
                    os.replace(part, target)
                out.append((digest, len(raw), target))
            yield pd.DataFrame(out, columns=["digest", "n_bytes", "path"])

    return distinct.select("digest", "html").mapInPandas(write, "digest string, n_bytes long, path string")


def digest_of(html: str) -> str:
    return hashlib.sha256(html.encode("utf-8", "replace")).hexdigest()


# Names that some file systems keep for devices.
_RESERVED = {"CON", "PRN", "AUX", "NUL", *(f"{x}{i}" for x in ("COM", "LPT") for i in range(1, 10))}


def file_name(text: str, otherwise: str = "result") -> str:
    """A name that any file system takes: no signs with a meaning, no blanks or full stops at the end, no device's name."""
    name = re.sub(r"_+", "_", re.sub(r'[<>:"/\\\\|?*\x00-\x1f]', "_", text).strip().rstrip(". ")) or otherwise
    return f"_{name}" if name.split(".", 1)[0].upper() in _RESERVED else name


def report_names(addresses: list[str], extension: str = ".xlsx") -> list[str]:
    """One file name for each address, from its host and the last part of its path, numbered where they would be equal."""
    used: set[str] = set()
    out = []
    for address in addresses:
        parts = urlsplit(address)
        last = [p for p in unquote(parts.path).split("/") if p][-1:] or ["result"]
        base = file_name(f"{(parts.hostname or 'result').removeprefix('www.')}_{last[0]}")
        name, n = f"{base}{extension}", 1
        while name.casefold() in used:
            n += 1
            name = f"{base}_{n}{extension}"
        used.add(name.casefold())
        out.append(name)
    return out


def write_text(path: str, text: str) -> None:
    """A small file that is either there as a whole or as it was before."""
    part = f"{path}.{os.getpid()}"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(part, path)


def write_or_remove(rows: DataFrame, path: str, write) -> str | None:  # noqa: ANN001
    """``write(rows, path)`` if there are rows; without any, an old report is removed so that it isn't taken for a new one."""
    if rows.isEmpty():
        if os.path.exists(path):
            os.unlink(path)
        return None
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    write(rows, path)
    return path
