"""Bytes of files on executors, by the names that Spark gives to stores."""

from __future__ import annotations

import re

from pyarrow import fs

# Names of stores in Hadoop's file systems, and how the byte reader here calls the same store.
SAME = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "abfss": "abfss"}


def store_uri(path: str) -> str:
    """A path as the byte reader names it: a local path, or a URI of one of its schemes. Other schemes raise."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme == "file":
        return re.sub("^/*", "/", rest)
    if scheme == "dbfs":
        # The store is mounted on each machine.
        return re.sub("^/*", "/dbfs/", rest)
    if scheme in ("wasb", "wasbs"):
        return "abfss:" + rest.replace(".blob.", ".dfs.", 1)
    if scheme not in SAME:
        raise ValueError(f"no byte reader for {scheme}: {path}")
    return f"{SAME[scheme]}:{rest}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    uri = store_uri(path)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
