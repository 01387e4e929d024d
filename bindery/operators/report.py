"""Counts per book or site, each one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paragraph_report(paged: DataFrame, book: list[str]) -> DataFrame:
    """(book, paragraphs, pages)."""
    return paged.groupBy(*book).agg(F.count("*").alias("paragraphs"), F.max("page_no").alias("pages"))


def page_report(pages: DataFrame, book: list[str], text: str = "text") -> DataFrame:
    """(book, pages, with_text)."""
    return pages.groupBy(*book).agg(F.count("*").alias("pages"), F.count_if(F.length(F.trim(text)) > 0).alias("with_text"))


def image_report(attached: DataFrame, book: list[str]) -> DataFrame:
    """(book, images, pages_with_images) from pages with an array of images."""
    return attached.groupBy(*book).agg(F.sum(F.size("images")).alias("images"), F.count_if(F.size("images") > 0).alias("pages_with_images"))


def split_report(chunks: DataFrame, book: list[str]) -> DataFrame:
    """(book, added): pages that splitting added."""
    return chunks.groupBy(*book).agg(F.count_if(F.col("chunk") > 1).alias("added"))


def chapter_report(spine: DataFrame, book: list[str]) -> DataFrame:
    """(book, chapters)."""
    return spine.groupBy(*book).agg(F.count("*").alias("chapters"))
