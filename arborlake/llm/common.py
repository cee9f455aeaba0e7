"""What the training-data operators share: materialised steps, checksums, text chunks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..steps import dealt_step, discard, materialise, shared_folder

#: Bytes that count as white space in the operators' word and line rules: space and 09-0D.
BLANKS = b" \t\n\x0b\x0c\r"

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")]
    if any(p and Path(p).resolve() == ROOT for p in known) or getattr(ship, "done", None) == spark.sparkContext.applicationId:
        return
    archive = Path(tempfile.mkdtemp(prefix="arborlake-py-")) / "arborlake.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "arborlake").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    ship.done = spark.sparkContext.applicationId


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def text_chunks(texts, limit: int = 4_000_000):
    """Slices [a, b) of a batch's texts, each of about ``limit`` characters or one text.

    A task's memory follows this limit and its longest text, not the batch size.
    """
    start, held = 0, 0
    for k, text in enumerate(texts):
        n = 0 if text is None else len(text)
        if held and held + n > limit:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased and no other letter touched."""
    return text.encode("utf-8", "surrogatepass").lower()


__all__ = ["BLANKS", "crc32_of_id", "dealt_step", "discard", "documents", "lower_ascii", "materialise", "partitions", "shared_folder", "ship", "text_chunks"]
