"""Folders and archives as rows (archive, rel_path, content, error); nothing is unpacked to disk."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SINGLE = {"gz": gzip.decompress, "bz2": bz2.decompress, "xz": lzma.decompress, "zst": lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b)}
ALLOWED = ("json", "zip", "tar", "tgz", "gz", "bz2", "xz", "7z", "zst")
SCHEMA = "archive string, rel_path string, content binary, error string"


def _safe(name: str) -> bool:
    """Whether a member stays inside the archive's own folder."""
    path = posixpath.normpath(name)
    return not (path.startswith(("/", "..")) or ":" in path.split("/")[0])


def members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """The files of an archive by its extension (S2-S5, S11); ValueError for what can't be read or leaves its folder."""
    low = name.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            found = [(i.filename, lambda i=i: z.read(i)) for i in z.infolist() if not i.is_dir()]
            if not all(_safe(n) for n, _ in found):
                raise ValueError("a member lies outside the archive")
            yield from ((n, read()) for n, read in found)
    elif ".tar" in low and not low.endswith(".zst") or low.endswith(".tgz"):
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
            found = [m for m in t.getmembers() if m.isfile()]
            if not all(_safe(m.name) for m in found):
                raise ValueError("a member lies outside the archive")
            yield from ((m.name, t.extractfile(m).read()) for m in found)
    elif (ext := low.rpartition(".")[2]) in SINGLE:
        yield posixpath.basename(name).rpartition(".")[0], SINGLE[ext](content)
    elif ext == "7z":
        raise ValueError("unsupported in this build: 7z")
    else:
        yield posixpath.basename(name), content


def files(spark: SparkSession, path: str, wanted: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """path, content, status (wanted / unsupported) of the files below a path, without dot files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    status = F.when(ext.isin(*wanted), "wanted").otherwise("unsupported") if wanted else F.lit("wanted")
    return found.filter(~name.startswith(".")).select("path", "content", status.alias("status")).dropDuplicates(["path"])


def uploads(found: DataFrame) -> DataFrame:
    """Uploaded files (path, content) with status: unsupported if their extension isn't allowed."""
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    return found.withColumn("status", F.when(ext.isin(*ALLOWED), "wanted").otherwise("unsupported"))


def expanded(found: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """The members of all files (path, content): wanted ones with content, others and broken archives with an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"]):
                out = []
                try:
                    for name, data in members(path, bytes(content)):
                        ok = name.lower().rpartition(".")[2] in wanted
                        out.append((path, name, data if ok else None, None if ok else "unsupported file type"))
                except (ValueError, OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, zstandard.ZstdError) as e:
                    out = [(path, None, None, str(e))]
                yield pd.DataFrame(out, columns=["archive", "rel_path", "content", "error"])

    return found.select("path", "content").mapInPandas(run, SCHEMA)


def json_entries(unpacked: DataFrame) -> DataFrame:
    """file, cit_id, entry (JSON text) of citation files: an object of objects."""
    text = F.col("content").cast("string")
    return unpacked.filter("content IS NOT NULL").select(F.col("rel_path").alias("file"), F.explode(F.from_json(text, "map<string,string>")).alias("cit_id", "entry"))
