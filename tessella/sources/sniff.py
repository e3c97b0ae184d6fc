"""Format detection of layout files as SQL predicates over the binaryFile source.

Order: OASIS by its magic bytes, GDSII by its first record type, then text formats by their first 4096 bytes, which must be UTF-8: DXF, DEF,
LEF, CIF. Anything else, and files of under four bytes, are unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats.
OASIS_MAGIC = "%SEMI-OASIS\r\n"
GDS_HEADER = "0002"  # bytes 3 and 4: record type HEADER, data type two-byte integer
PREFIX = 4096


def _word(text: Column, word: str) -> Column:
    """The word stands between characters that are no letters."""
    return text.rlike(rf"(?<!\p{{L}}){word}(?!\p{{L}})")


def format_of(content: Column) -> Column:
    head = F.substring(content, 1, PREFIX)
    text = F.try_validate_utf8(head.cast("string"))
    upper = F.upper(text)
    lines = F.transform(F.slice(F.split(text, r"\r\n|\r|\n"), 1, 2), lambda x: F.trim(x))
    bare = F.regexp_replace(text, r"^(?:\s|\([^)]*\))+", "")
    return (
        F.when(F.length(content) < 4, "unknown")
        .when(F.hex(F.substring(content, 1, len(OASIS_MAGIC))) == OASIS_MAGIC.encode().hex().upper(), "oasis")
        .when(F.hex(F.substring(content, 3, 2)) == GDS_HEADER, "gds")
        .when(text.isNull(), "unknown")
        .when((F.get(lines, F.lit(0)) == "0") & (F.upper(F.get(lines, F.lit(1))) == "SECTION"), "dxf")
        .when(_word(upper, "VERSION") & _word(upper, "DESIGN"), "def")
        .when(_word(upper, "VERSION") & (_word(upper, "MACRO") | _word(upper, "LAYER")), "lef")
        .when(bare.rlike("^[DBWPLCERS0-9]"), "cif")
        .otherwise("unknown")
    )


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """path, length, format of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", format_of(F.col("content")).alias("format"))
