"""Bytes of files, read inside tasks piece by piece."""

from __future__ import annotations

import csv
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

#: Bytes read at a time.
PIECE = 4 << 20
#: Bytes read at a time while the end of a header is looked for.
FIRST = 64 << 10
#: Schemes that tasks can open by themselves, under the name their library knows.
SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def can_stream(path: str) -> bool:
    return urlsplit(path).scheme in SCHEMES


def _open(path: str, compression: str | None):
    from pyarrow import fs

    scheme, rest = urlsplit(path).scheme, path.split(":", 1)[-1] if urlsplit(path).scheme else path
    if SCHEMES[scheme] == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"), compression=compression)
    system, inner = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")
    return system.open_input_stream(inner, compression=compression)


def digest(path: str) -> str:
    found = hashlib.sha256()
    with _open(path, None) as stream:
        while piece := stream.read(PIECE):
            found.update(piece)
    return found.hexdigest()


def header(path: str, delimiter: str) -> list[str]:
    """Names in the first line that isn't empty; packed files are unpacked as far as that."""
    held = b""
    with _open(path, "detect") as stream:
        while True:
            piece = stream.read(FIRST)
            held = (held + piece).lstrip(b"\r\n")
            lines = held.splitlines()
            if len(lines) > 1 or held.endswith((b"\n", b"\r")) or not piece:
                break
    line = lines[0].decode("utf-8").removeprefix("\ufeff") if lines else ""
    return next(csv.reader([line], delimiter=delimiter), [])


def digests(listing: DataFrame) -> DataFrame:
    """(path, length) with the SHA-256 of each file; a task holds one piece of one file."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(file_hash=[digest(p) for p in batch["path"]])[["path", "file_hash", "length"]]

    return _dealt(listing).mapInPandas(hashed, "path string, file_hash string, length bigint")


def headers(listing: DataFrame, delimiter: str) -> DataFrame:
    """(path, names) of each file, from its first bytes."""

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "names": [header(p, delimiter) for p in batch["path"]]})

    return _dealt(listing).mapInPandas(named, "path string, names array<string>")


def _dealt(listing: DataFrame) -> DataFrame:
    """Files over all cores: a listing packs many files into a split, by size alone."""
    return listing.select("path", "length").repartition(max(2, listing.sparkSession.sparkContext.defaultParallelism), "path")
