"""Pages and documents as frames, and selections of pages.

PDF bytes are a boundary: ``binary_documents`` reads them with their identity,
``parse_documents`` runs any given parser over them in ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import trimmed
from ..functions.identity import doc_id

PAGES = "doc_id string, source_doc string, page_index int, page_number int, page_label string, text string"


def binary_documents(spark: SparkSession, path: str, collection: str, pattern: str = "*.pdf") -> DataFrame:
    """Files with doc_id, source_doc (the stem), sha256, content; only those that start as PDF files do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumns({"filename": name, "sha256": F.sha2("content", 256), "source_doc": F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")})
    return files.where(F.substring("content", 1, 4) == F.lit(b"%PDF")).select(doc_id(F.lit(collection), F.col("sha256")).alias("doc_id"), F.lit(collection).alias("collection_id"), "source_doc", "filename", "sha256", "path", "content")


def parse_documents(documents: DataFrame, parser: Callable[[bytes], Iterable[tuple[str | None, str]]]) -> DataFrame:
    """Pages of ``documents`` by a parser that yields (label, text) for each page of some bytes."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d.doc_id, d.source_doc, k, k + 1, label, text) for d in frame.itertuples() for k, (label, text) in enumerate(parser(bytes(d.content)))]
            yield pd.DataFrame(rows, columns=["doc_id", "source_doc", "page_index", "page_number", "page_label", "text"])

    return documents.select("doc_id", "source_doc", "content").mapInPandas(parse, PAGES)


def text_pages(spark: SparkSession, path: str, collection: str, pattern: str = "*.txt") -> DataFrame:
    """Plain-text files as documents; form feeds part their pages."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]+$", "")
    rows = files.select(doc_id(F.lit(collection), F.sha2("content", 256)).alias("doc_id"), name.alias("source_doc"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("page_index", "text"))
    return rows.select("doc_id", "source_doc", "page_index", (F.col("page_index") + 1).alias("page_number"), F.lit(None).cast("string").alias("page_label"), "text")


def words(pages: DataFrame) -> DataFrame:
    """``doc_id, page_index, position, word`` of page texts, without blanks."""
    split = F.split(trimmed(F.coalesce("text", F.lit(""))), r"(?U)\s+")
    return pages.select("doc_id", "page_index", F.posexplode(split).alias("position", "word")).where("word <> ''")


def page_ranges(spec: Column) -> Column:
    """Sorted page numbers of '3-5,10;14'; ranges may be reversed. Null for blank text; bad text is an error."""
    parts = F.filter(F.transform(F.split(spec, "[,;]"), trimmed), lambda p: p != "")

    def pages(piece: Column) -> Column:
        ends = F.split(piece, r"\s*-\s*")
        low, high = ends[0].cast("int"), F.element_at(ends, -1).cast("int")
        return F.sequence(F.least(low, high), F.greatest(low, high))

    return F.when(F.size(parts) > 0, F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages)))))


def cited_pages(pages: Column, pad: int = 0) -> Column:
    """Pages around those that labels cite, from one up."""
    around = F.transform(pages, lambda p: F.sequence(F.greatest(F.lit(1), p - pad), p + pad))
    return F.array_sort(F.array_distinct(F.flatten(around)))


def select_pages(pages: DataFrame, wanted: set[int] | None = None, max_pages: int | None = None) -> DataFrame:
    """Pages of the given numbers, and of these the first ``max_pages`` of each document."""
    chosen = pages if wanted is None else pages.where(F.col("page_number").isin(sorted(wanted)))
    if max_pages is None:
        return chosen
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))
    return chosen.withColumn("__nth", nth).where(F.col("__nth") <= max_pages).drop("__nth")
