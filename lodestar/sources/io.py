"""Reading and writing tables by file name."""

from __future__ import annotations

import importlib.util
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc"}


def load(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """By suffix: parquet, csv (with header), json, orc; xlsx and dta by way of the driver, for small files."""
    kind = PurePosixPath(path).suffix.lower()
    if kind in FORMATS:
        reader = spark.read if schema is None else spark.read.schema(schema)
        if kind == ".csv":
            reader = reader.option("header", True).option("inferSchema", schema is None).option("mode", "PERMISSIVE" if schema is None else "FAILFAST")
        return reader.format(FORMATS[kind]).load(path)
    if kind in (".xlsx", ".xls", ".dta"):
        import pandas as pd

        if kind != ".dta" and importlib.util.find_spec("openpyxl") is None:
            raise ValueError(f"{kind} needs openpyxl")
        return spark.createDataFrame(pd.read_stata(path) if kind == ".dta" else pd.read_excel(path))
    raise ValueError(f"Unsupported file format: {kind}")


def save(df: DataFrame, path: str) -> None:
    kind = PurePosixPath(path).suffix.lower()
    if kind not in FORMATS:
        raise ValueError(f"Unsupported file format: {kind}")
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if kind == ".csv" else writer).format(FORMATS[kind]).save(path)


def find_inputs(spark: SparkSession, folder: str, patterns: Sequence[str] = ("*.csv", "*.parquet", "*.xlsx")) -> list[str]:
    """Paths that fit a pattern, sorted; through Hadoop's file systems, so any store will do."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = set()
    for p in patterns:
        hits = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, p))
        found |= {h.getPath().toString() for h in hits or []}
    return sorted(found)


def load_all(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame | None, list[str]]:
    """The union by name, with null where a file lacks a column, and the files that could not be read."""
    out, bad = None, []
    for p in paths:
        try:
            df = load(spark, p)
        except Exception:  # noqa: BLE001  any unreadable file is reported and left out
            bad.append(p)
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, bad


def count_rows(spark: SparkSession, path: str) -> int:
    """Of parquet files Spark reads the footers only."""
    return load(spark, path).count()


def load_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature, of a collection or a feature a line: properties and geometry."""
    lines = spark.read.json(path)
    if {"properties", "geometry"} <= set(lines.columns):
        return lines.select("properties", "geometry")
    return spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties", "f.geometry")


def save_geojson(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    """A feature a line: all other columns are its properties. ``load_geojson`` reads it again."""
    rest = [c for c in df.columns if c != geometry]
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), (F.struct(*rest) if rest else F.create_map()).alias("properties"), F.col(geometry).alias("geometry")))
    df.select(feature.alias("value")).write.mode("overwrite").text(path)


def _spread_bits(v: Column) -> Column:
    """The sixteen bits of a number at the even places of another."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def z_order(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """A place along a curve that keeps near points of a box near: the bits of both coordinates in turn."""
    x0, y0, x1, y1 = box
    cell = lambda v, a, b: F.least(F.greatest(F.floor((v - a) / max(b - a, 1e-300) * 65536), F.lit(0)), F.lit(65535)).cast("bigint")
    return _spread_bits(cell(x, x0, x1)).bitwiseOR(F.shiftleft(_spread_bits(cell(y, y0, y1)), 1))


def save_for_boxes(df: DataFrame, path: str, x: str, y: str, files: int | None = None) -> None:
    """Parquet in the order of a curve through (x, y), so files, row groups and pages hold small boxes, and a comparison
    with a box (``in_box``, or plain) reads few of them. Rows without a place are in the first file."""
    box = df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = z_order(F.col(x).cast("double"), F.col(y).cast("double"), tuple(float(v or 0) for v in box))
    placed = df.withColumn("_z", place)
    placed.repartitionByRange(n, F.col("_z").asc_nulls_first()).sortWithinPartitions(F.col("_z").asc_nulls_first()).drop("_z").write.mode("overwrite").parquet(path)


def in_box(df: DataFrame, box: tuple[float, float, float, float], columns: tuple[str, str, str, str] = ("min_x", "min_y", "max_x", "max_y")) -> DataFrame:
    """Rows whose stored bounds meet the box: comparisons of columns, which reach the parquet scan."""
    x0, y0, x1, y1 = box
    a, b, c, d = columns
    return df.where((F.col(a) <= x1) & (F.col(c) >= x0) & (F.col(b) <= y1) & (F.col(d) >= y0))


def file_table(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, extension of all files; parts that begin with a dot are skipped. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    return files.where(~F.col("path").rlike(r"/\.[^/]")).withColumn("extension", F.regexp_extract("path", r"(\.[^./]+)$", 1))


def file_hashes(spark: SparkSession, folder: str, most_bytes: int | None = None) -> DataFrame:
    """path, size, mtime, hash (SHA-256, null above ``most_bytes``): the input of a manifest diff."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    small = F.lit(True) if most_bytes is None else F.col("length") <= most_bytes
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").cast("string").alias("mtime"), F.when(small, F.sha2("content", 256)).alias("hash"))


def save_diagnostic(df: DataFrame, folder: str, name: str, subfolder: str | None = None) -> str:
    """A small table as one CSV file with a header."""
    path = "/".join(x for x in (folder, "diagnostics", subfolder, f"{name}.csv") if x)
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def load_diagnostic(spark: SparkSession, folder: str, name: str, subfolder: str | None = None) -> DataFrame:
    return load(spark, "/".join(x for x in (folder, "diagnostics", subfolder, f"{name}.csv") if x))


def load_docx_comments(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind (comment, insertion, deletion), author, text of the documents in a folder."""
    import io
    import zipfile
    from collections.abc import Iterator
    from xml.etree import ElementTree

    import pandas as pd

    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member, tags in (("word/comments.xml", {"comment": "comment"}), ("word/document.xml", {"ins": "insertion", "del": "deletion"})):
                        if member not in z.namelist():
                            continue
                        for e in ElementTree.fromstring(z.read(member)).iter():
                            kind = tags.get(e.tag.removeprefix(word))
                            if kind:
                                text = "".join(x.text or "" for x in e.iter() if x.tag in (f"{word}t", f"{word}delText"))
                                rows.append((path, kind, e.get(f"{word}author"), text))
            yield pd.DataFrame(rows, columns=["path", "kind", "author", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder)
    return files.select("path", "content").mapInPandas(read, "path string, kind string, author string, text string")
