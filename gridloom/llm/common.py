"""What the text operators share: written tables, the id and text of documents, the ASCII word rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written

__all__ = ["ascii_words", "id_and_text", "shuffle_partitions", "written"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string) of docs, null texts as empty; other columns cannot clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def ascii_words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, as UTF-8. bytes.lower and
    bytes.split touch exactly those ASCII letters and white space characters."""
    return text.encode("utf-8").lower().split()
