"""Text corpora from folders: scan, text test, split into documents by file type."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorloom.functions import text as T

# --- fixed values -----------------------------------------------------------------------------
SKIPPED_FOLDERS = ["node_modules", "__pycache__", ".git", "dist", "build", "target"]
BINARY_EXTENSIONS = (
    ".exe .dll .so .dylib .bin .dat .db .sqlite .sqlite3 "
    ".jpg .jpeg .png .gif .bmp .tiff .ico .svg .webp "
    ".mp3 .wav .flac .aac .ogg .wma .mp4 .avi .mkv .mov .wmv .flv .webm "
    ".zip .rar .7z .tar .gz .bz2 .xz .pdf .doc .docx .xls .xlsx .ppt .pptx "
    ".pyc .pyo .class .jar .war .ear .ttf .otf .woff .woff2 .eot"
).split()
# -----------------------------------------------------------------------------------------------


def allowed_path(relative: Column) -> Column:
    """No hidden or vendor folder on the way, no hidden file, no binary extension."""
    parts = F.split(relative, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    bad = F.exists(folders, lambda p: p.startswith(".") | p.isin(SKIPPED_FOLDERS)) | T.base_name(relative).startswith(".")
    return ~bad & ~T.extension(relative).isin(BINARY_EXTENSIONS)


def head(content: Column, size: int = 1024) -> Column:
    return F.substring(content, 1, size)


def has_no_nul(content: Column) -> Column:
    return ~F.hex(head(content)).rlike("^(..)*00")


def is_plain_bytes(content: Column) -> Column:
    """Every leading byte is printable or one of the usual control characters."""
    return F.hex(head(content)).rlike("^(07|08|09|0A|0C|0D|1B|[2-6][0-9A-F]|7[0-9A-E]|[89A-F][0-9A-F])*$")


def is_utf8(content: Column) -> Column:
    """The leading bytes are UTF-8; of a longer file, a character that they cut apart doesn't count."""
    start = F.hex(head(content))
    whole = F.when(F.length(content) > 1024, F.regexp_replace(start, "((F[0-7])([89AB].){0,2}|(E.)([89AB].)?|([CD].))$", "")).otherwise(start)
    return has_no_nul(content) & F.is_valid_utf8(F.unhex(whole).cast("string"))


TEXT_TESTS = {"nul": has_no_nul, "bytes": is_plain_bytes, "utf8": is_utf8}


def scan_folder(spark: SparkSession, folder: str, max_files: int | None = None, test: str = "nul", max_bytes: int | None = None) -> DataFrame:
    """Text files below a folder: path, relative_path, name, length, content.

    ``max_bytes`` leaves larger files out (``oversized_files`` names them); by default none is.

    Path and size predicates stand before the content test, so skipped files are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative = F.substring_index("path", folder.rstrip("/") + "/", -1)
    files = files.select("path", relative.alias("relative_path"), "length", "content")
    files = files.filter(allowed_path(F.col("relative_path")))
    files = files.filter(F.col("length") <= max_bytes) if max_bytes is not None else files
    files = files.filter(TEXT_TESTS[test](F.col("content"))).withColumn("name", T.base_name(F.col("path")))
    return files.orderBy("path").limit(max_files) if max_files else files


def oversized_files(spark: SparkSession, folder: str, max_bytes: int) -> DataFrame:
    """(relative_path, length) of the files that ``scan_folder`` leaves out for their size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative = F.substring_index("path", folder.rstrip("/") + "/", -1)
    return files.filter(F.col("length") > max_bytes).select(relative.alias("relative_path"), "length").filter(allowed_path(F.col("relative_path")))


def split_text(text: Column) -> Column:
    """Paragraphs if there are several, else lines if there are several, else the whole text."""

    def pieces(separator: str) -> Column:
        return F.filter(F.transform(F.split(text, separator), T.trim_space), lambda p: p != "")

    whole = T.trim_space(text)
    return T.let(
        F.struct(pieces(r"\n\n").alias("paragraphs"), pieces(r"\n").alias("lines")),
        lambda x: F.when(F.size(x["paragraphs"]) > 1, x["paragraphs"]).when(F.size(x["lines"]) > 1, x["lines"]).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>")),
    )


def first_field(row: list[Column]) -> Column:
    """First non-empty field in column order."""
    return F.coalesce(*[F.nullif(T.trim_space(c.cast("string")), F.lit("")) for c in row])


def csv_text_column(table: DataFrame) -> str:
    """Known text column holding a value, else the first string column holding one."""
    names = [c for c in T.TEXT_FIELDS if c in table.columns] + [n for n, t in table.dtypes if t == "string" and n not in T.TEXT_FIELDS]
    if names:
        seen = table.agg(*[F.max(F.col(n).isNotNull()).alias(n) for n in names]).first()
        for n in names:
            if seen[n]:
                return n
    raise ValueError("no text column found")


def read_csv_documents(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.csv(path, header=True, multiLine=True, escape='"')
    column = csv_text_column(table)
    return table.filter(F.col(column).isNotNull()).select(F.col(column).alias("text"))


def read_csv_first_fields(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return table.select(first_field([F.col(c) for c in table.columns]).alias("text")).filter("text IS NOT NULL")


def _string_field(json_text: Column, name: str) -> Column:
    v = F.try_variant_get(F.try_parse_json(json_text), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def object_text(json_text: Column) -> Column:
    """First of the known text fields that is a string, else the whole object as JSON."""
    return F.coalesce(*[_string_field(json_text, n) for n in T.TEXT_FIELDS], json_text)


def json_documents(content: Column) -> Column:
    """Documents of one JSON text: list of strings or objects, {"documents": [...]}, or one object."""

    def items(listed: Column) -> Column:
        return F.transform(listed, lambda x: F.when(F.ltrim(x).startswith("{") & F.try_parse_json(x).isNotNull(), object_text(x)).otherwise(x))

    kind = F.schema_of_variant(F.try_parse_json(content))
    nested = F.from_json(content, "documents array<string>")["documents"]
    return (
        F.when(kind.startswith("ARRAY"), items(F.from_json(content, "array<string>")))
        .when(kind.startswith("OBJECT") & nested.isNotNull(), nested)
        .when(kind.startswith("OBJECT"), F.array(object_text(content)))
        .otherwise(F.array().cast("array<string>"))
    )


def _csv_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of CSV files held as single strings; a field may be as long as its file."""
    csv.field_size_limit(2**31 - 1)
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = list(csv.DictReader(io.StringIO(content)))
            fields = list(rows[0]) if rows else []
            for name in [f for f in T.TEXT_FIELDS if f in fields] + [f for f in fields if f not in T.TEXT_FIELDS]:
                found = [r[name] for r in rows if r[name]]
                if found:
                    out += [(path, i, t) for i, t in enumerate(found)]
                    break
        yield pd.DataFrame(out, columns=["path", "part", "text"])


def load_documents(files: DataFrame) -> DataFrame:
    """Documents of scanned files with the metadata of their file.

    TXT and Markdown are split, CSV and JSON taken apart, anything else is one document.
    """
    ext = T.extension(F.col("path"))
    text = F.col("content").cast("string")
    base = files.withColumn("ext", ext).withColumn("content", text)
    pieces = (
        F.when(F.col("ext").isin(".txt", ".md"), split_text(F.col("content")))
        .when(F.col("ext") == ".json", json_documents(F.col("content")))
        .otherwise(F.array("content"))
    )
    meta = ["path", "relative_path", "name", "length"]
    parts = base.filter("ext <> '.csv'").select(*meta, F.posexplode(pieces).alias("part", "text"))
    tables = base.filter("ext = '.csv'").select("path", "content").mapInPandas(_csv_rows, "path string, part int, text string")
    parts = parts.unionByName(base.filter("ext = '.csv'").select(*meta).join(tables, "path").select(*parts.columns))
    trimmed = parts.withColumn("text", T.trim_space(F.col("text"))).filter("text <> ''")
    return trimmed.select(
        F.md5(F.concat_ws(":", "path", "part")).alias("doc_key"),
        F.col("path").alias("file_path"), "relative_path", F.col("name").alias("file_name"), "part",
        F.col("length").alias("file_size_bytes"), F.round(F.col("length") / (1024 * 1024), 2).alias("file_size_mb"),
        F.length("text").alias("document_length"), T.word_count(F.col("text")).alias("document_word_count"), "text",
    )


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """Documents of one file, by its extension."""
    one = spark.read.format("binaryFile").load(path).select("path", F.col("path").alias("relative_path"), "length", "content", T.base_name(F.col("path")).alias("name"))
    return load_documents(one)


def largest_files(files: DataFrame, n: int = 5) -> DataFrame:
    return files.select("relative_path", "length").orderBy(F.desc("length"), "relative_path").limit(n)
