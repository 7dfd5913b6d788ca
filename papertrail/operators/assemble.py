"""Pages to document text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from papertrail.functions.text import java_regex

PAGE_BREAK = "\n\n"
PRIMARY_CONFIDENCE, FALLBACK_CONFIDENCE = 0.95, 0.7


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(java_regex(r"[^\s]+")))


def page_stats(pages: DataFrame, mime: str = "mime_type") -> DataFrame:
    """Adds word_count and has_images; a page without text is no page."""
    return pages.filter(F.col("text") != "").withColumns({
        "word_count": word_count(F.col("text")),
        "has_images": F.startswith(mime, F.lit("image/"))})


def _join_pages(group: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(group), lambda p: p["text"]), PAGE_BREAK)


def page_segments(pages: DataFrame, pages_per_segment: int = 512) -> DataFrame:
    """Text by (document_id, segment): runs of at most ``pages_per_segment`` page numbers."""
    segment = F.floor(F.col("page_number") / pages_per_segment).cast("long")
    return pages.filter(F.col("text") != "").groupBy("document_id", segment.alias("segment")).agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("confidence").alias("confidence_sum"),
        F.sum(word_count(F.col("text"))).alias("n_words"),
        _join_pages(F.collect_list(F.struct("page_number", "text"))).alias("text"))


def assemble_pages(pages: DataFrame, pages_per_segment: int = 512) -> DataFrame:
    """(document_id, total_pages, processed_pages, n_words, average_confidence, full_text).

    Pages are gathered by runs of page numbers and the runs by document, so a huge document's pages are joined by many
    tasks.  ``page_segments`` is the form to go on with where one string of a whole document is not asked for.
    """
    merged = page_segments(pages, pages_per_segment).groupBy("document_id").agg(
        F.sum("n_pages").alias("n_pages"), F.sum("n_words").alias("n_words"),
        F.sum("confidence_sum").alias("confidence_sum"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda s: s["text"]),
                     PAGE_BREAK).alias("full_text"))
    return merged.select(
        "document_id", F.col("n_pages").alias("total_pages"), F.col("n_pages").alias("processed_pages"), "n_words",
        (F.col("confidence_sum") / F.col("n_pages")).alias("average_confidence"), "full_text")


def with_empty_documents(manifest: DataFrame, assembled: DataFrame) -> DataFrame:
    """Every manifest document; one without any page gets the empty result."""
    joined = manifest.select("document_id").join(assembled, "document_id", "left")
    return joined.select(
        "document_id", F.coalesce("total_pages", F.lit(1)).alias("total_pages"),
        F.coalesce("processed_pages", F.lit(0)).alias("processed_pages"),
        F.when(F.col("total_pages").isNull(), "").otherwise(F.col("full_text")).alias("full_text"),
        F.coalesce("average_confidence", F.lit(0.0)).alias("average_confidence"))


def pick_source(pages: DataFrame, mime: str = "mime_type") -> DataFrame:
    """Per document: the primary pages if any has text, else the fallback pages of a PDF, else none.

    (document_id, source, n_pages, average_confidence); partial sums per source, one shuffle.
    """
    def of(method: str, what: Column) -> Column:
        return F.when((F.col("method") == method) & (F.col("text") != ""), what)
    sums = pages.groupBy("document_id").agg(
        F.count(of("primary", F.lit(1))).alias("p"), F.count(of("fallback", F.lit(1))).alias("f"),
        F.sum(of("primary", F.col("confidence"))).alias("pc"),
        F.sum(of("fallback", F.col("confidence"))).alias("fc"), F.max(mime).alias("mime"))
    source = F.when(F.col("p") > 0, "primary").when(
        (F.col("f") > 0) & (F.col("mime") == "application/pdf"), "fallback").otherwise("empty")
    return sums.withColumn("source", source).select(
        "document_id", "source",
        F.when(F.col("source") == "primary", F.col("p")).when(F.col("source") == "fallback", F.col("f"))
        .otherwise(F.lit(0)).alias("n_pages"),
        F.when(F.col("source") == "primary", F.col("pc") / F.col("p"))
        .when(F.col("source") == "fallback", F.col("fc") / F.col("f")).otherwise(F.lit(0.0))
        .alias("average_confidence"))


def low_confidence(assembled: DataFrame, threshold: float = 0.7) -> DataFrame:
    return assembled.filter(F.col("average_confidence") < threshold)


def utf8_text(content: bytes) -> str | None:
    """The extractor shipped with the library: plain UTF-8 text, None when it is not."""
    try:
        return content.decode("utf-8") or None
    except UnicodeDecodeError:
        return None


def extract_text(files: DataFrame, key: str, extractor: Callable[[bytes], str | None] = utf8_text,
                 content: str = "content") -> DataFrame:
    """(key, text, error): the caller's bytes-to-text function over binary rows, one Arrow batch at a time.

    A file the extractor cannot read gives NULL text and the error; it never fails the job.
    """
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        def one(value):
            try:
                return (None if value is None else extractor(bytes(value)), None)
            except Exception as error:
                return None, f"{type(error).__name__}: {error}"
        for batch in batches:
            out = [one(v) for v in batch[content]]
            yield pd.DataFrame({key: batch[key], "text": [t for t, _ in out],
                                "error": [e for _, e in out]})

    return files.select(key, content).mapInPandas(run, f"{key} {kind}, text string, error string")
