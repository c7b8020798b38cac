"""Already extracted pages into one text per script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.text import strip_ws
from riskframe.limits import MIN_DOCUMENT_CHARS, MIN_PAGE_CHARS


def assemble_pages(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """``pages(script_id, page_no, text)`` to one row per script: full_text, pages, page
    numbers that need OCR, and warnings.

    All pages are kept unless ``max_pages`` is given; pages beyond it then only add to the count.
    """
    within = F.col("page_no") <= max_pages if max_pages is not None else F.lit(True)
    scanned = F.char_length(strip_ws(F.coalesce(F.col("text"), F.lit("")))) < MIN_PAGE_CHARS
    grouped = pages.groupBy("script_id").agg(
        F.count("*").alias("total_pages"),
        F.array_sort(F.collect_list(F.when(within & ~scanned, F.struct("page_no", "text")))).alias("pages"),
        F.array_sort(F.collect_list(F.when(within & scanned, F.col("page_no")))).alias("ocr_pages"),
    )
    text = F.array_join(F.transform("pages", lambda p: p["text"]), "\n")
    return (
        grouped.withColumn("full_text", text)
        .withColumn(
            "warnings",
            F.array_compact(
                F.array(
                    F.when(
                        F.col("total_pages") > (max_pages if max_pages is not None else 2**62),
                        F.format_string(f"%d pages given, the first {max_pages} were used", "total_pages"),
                    ),
                    F.when(
                        (F.size("pages") > 0) & (F.char_length(strip_ws(F.col("full_text"))) < MIN_DOCUMENT_CHARS),
                        F.lit("very little text, results may be incomplete"),
                    ),
                    F.when(
                        F.size("ocr_pages") > 0,
                        F.concat(
                            F.lit("pages without text: "),
                            F.array_join(F.transform("ocr_pages", lambda n: n.cast("string")), ","),
                        ),
                    ),
                )
            ),
        )
        .withColumn("has_text", strip_ws(F.col("full_text")) != "")
    )
