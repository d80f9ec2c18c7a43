"""Manuscripts as binary files: text of TXT, DOCX and HWPX; an error column for what can't be read."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formats, encodings in the order in which they are tried, limits and marks.
SUFFIXES = ("txt", "docx", "hwpx", "pdf", "hwp")
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr", "utf-16")
LARGEST = 10 << 20
OLE_MARK = "D0CF11E0A1B11AE1"


def decoded(data: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="replace")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def docx_text(data: bytes) -> str:
    """Paragraphs of the main part, one a line; breaks and tabs are blanks."""
    with zipfile.ZipFile(io.BytesIO(data)) as files:
        root = ElementTree.fromstring(files.read("word/document.xml"))
    said = {"t": lambda n: n.text or "", "br": lambda n: " ", "tab": lambda n: " "}
    return "\n".join("".join(said[k](n) for n in p.iter() if (k := _local(n.tag)) in said) for p in root.iter() if _local(p.tag) == "p")


def hwpx_text(data: bytes) -> str:
    """Paragraphs of all sections in the order of the parts' names as text; leading empty ones are left out."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as files:
        parts = sorted(n for n in files.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n))
        if not parts:
            raise ValueError("no section")
        for name in parts:
            try:
                root = ElementTree.fromstring(files.read(name))
            except ElementTree.ParseError:
                continue
            for p in (n for n in root.iter() if _local(n.tag) == "p"):
                texts = [x for t in p.iter() if _local(t.tag) == "t" for x in (t.text, *(c.tail for c in t)) if x]
                if texts or out:
                    out.append("".join(texts))
    return "\n".join(out)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def _read(kind: pd.Series, data: pd.Series) -> pd.DataFrame:
    readers = {"txt": decoded, "docx": docx_text, "hwpx": hwpx_text}
    rows = []
    for k, content in zip(kind, data, strict=True):
        try:
            rows.append((readers[k](content or b""), None))
        except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
            rows.append((None, f"{k} can't be read: {e}"))
    return pd.DataFrame(rows, columns=["text", "error"])


def diagnosis(content: Column) -> Column:
    """Why a binary word-processor file can't be read."""
    start = F.hex(F.substring(content, 1, 8))
    return F.when(start != OLE_MARK, F.when(F.contains(F.hex(F.substring(content, 1, 64)), F.hex(F.lit("HWP Document File"))), "format of an old version").otherwise("not such a file, or damaged")).otherwise("no reader for this binary format here")


def header_flags(header: Column) -> Column:
    """Struct encrypted, distribution of a binary file header's property bytes (40 bytes; the last four, little-endian)."""
    low = F.conv(F.hex(F.substring(header, 37, 1)), 16, 10).cast("int")
    return F.struct((low.bitwiseAND(2) > 0).alias("encrypted"), (low.bitwiseAND(4) > 0).alias("distribution"))


def texts(files: DataFrame) -> DataFrame:
    """path, text, error of files (path, length, content).

    The format is that of the name's end; archives and OLE files with the other's name change places. Unsupported, unreadable and too
    large files have an error and no text, nothing is raised.
    """
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mark = F.hex(F.substring("content", 1, 8))
    kind = F.when((kind == "hwp") & mark.startswith("504B"), "hwpx").when((kind == "hwpx") & (mark == OLE_MARK), "hwp").otherwise(kind)
    rows = files.withColumn("_kind", kind)
    large = F.col("length") > LARGEST
    readable = F.col("_kind").isin("txt", "docx", "hwpx") & ~large
    read = rows.where(readable).withColumn("_r", _read("_kind", "content")).select("path", "_r.text", "_r.error")
    why = F.when(large, "larger than 10 MB").when(F.col("_kind") == "hwp", diagnosis(F.col("content"))).when(F.col("_kind") == "pdf", "no reader for PDF here").otherwise(F.concat(F.lit("unsupported format: "), F.col("_kind")))
    rest = rows.where(~readable).select("path", F.lit(None).cast("string").alias("text"), why.alias("error"))
    return read.unionByName(rest)


def folder(spark: SparkSession, path: str) -> DataFrame:
    """texts() of a folder's supported files, lock files of word processors left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(SUFFIXES)}}}").load(path)
    return texts(files.where(~F.regexp_extract("path", r"([^/]*)$", 1).startswith("~$")).select("path", "length", "content"))
