"""Scan of wiki export files (O1, O2)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.skew import broadcast_small

_REVISION = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "timestamp", "text")])
PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("revision", T.ArrayType(_REVISION))])


def _plain(path: str) -> str:
    """A path without scheme, host and the slashes at its end."""
    return re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", path).rstrip("/")


def _pattern(given: str) -> re.Pattern:
    """What the files that a given file, folder or glob stands for are called."""
    path, globs = _plain(given), {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}
    braces = "{" in path
    body = "".join(globs[c] if c in "*?{}" or (c == "," and braces) else c if c in "[]" and "[" in path and "]" in path else re.escape(c) for c in path)
    return re.compile(("" if path.startswith("/") else "(?:.*/)?") + body + "(?:/.*)?")


def _ordinals(found: Sequence[str], files: Sequence[str]) -> list[tuple[str, int]]:
    """(file as Spark calls it, number of the given path that it belongs to)."""
    literal: dict[str, list[int]] = {}
    for n, given in enumerate(files):
        literal.setdefault(_plain(given), []).append(n)
    patterns = [(n, _pattern(given)) for n, given in enumerate(files)]
    out = []
    for name in found:
        path = _plain(unquote(name))
        folders = (path[:k] for k in [len(path), *(m.start() for m in re.finditer("/", path))])
        at = [n for folder in folders for n in literal.get(folder, [])]  # a file or a folder above it, as it is given
        out += [(name, n) for n in at or [n for n, p in patterns if p.fullmatch(path)]]
    return out


def read_pages(spark: SparkSession, files: Sequence[str], flags: Sequence[bool]) -> DataFrame:
    """file_ord, page_ord, is_general, title, revision_id, revision_timestamp and text of the first revision of each page.

    flags: for each file (or folder, or glob), whether it holds the general article. A page without text is an error.
    One scan reads all files, however many; a file's number and flag come from a table of the names that Spark lists. page_ord grows with the place
    in the file and is given out at the scan, before any shuffle.
    """
    if len(files) != len(flags) or not files:
        raise ValueError(f"{len(files)} files and {len(flags)} flags")
    pages = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(list(dict.fromkeys(files)))
    numbers = [(re.sub(":///", ":/", name, count=1), n, bool(flags[n])) for name, n in _ordinals(pages.inputFiles(), files)]
    table = spark.createDataFrame(numbers, "path string, file_ord int, is_general boolean")
    first = F.col("revision")[0]
    text = F.when(first["text"].isNull(), F.raise_error(F.concat(F.lit("A page has no text: "), F.coalesce("title", F.lit("")))).cast("string")).otherwise(first["text"])
    placed = pages.select(
        F.regexp_replace("_metadata.file_path", "^([^:/]+):///", "$1:/").alias("path"), F.monotonically_increasing_id().alias("page_ord"), "title", first["id"].alias("revision_id"), first["timestamp"].alias("revision_timestamp"), text.alias("text"),
    )
    return placed.join(broadcast_small(table), "path").select("file_ord", "page_ord", "is_general", "title", "revision_id", "revision_timestamp", "text")
