"""Running text into scene blocks. Everything happens inside the row: no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.text import SENTINEL, WS, first_line, let, strip_ws
from riskframe.vocabulary import SCENE_MARKERS, SLASH_MAY_BE_SPACED, WORD_MUST_END


def marker_pattern(markers: Sequence[str] = SCENE_MARKERS) -> str:
    """Line start, blanks, an optional scene number, then one of the marker spellings."""
    blanks = f"[{WS}]"

    def spelling(m: str) -> str:
        slash = f"{blanks}*/{blanks}*" if m in SLASH_MAY_BE_SPACED else "/"
        word = m.replace(".", r"\.").replace("/", slash)
        return word + rf"(?:\.|{blanks})" if m in WORD_MUST_END else word

    return rf"^([ \t]*(?:\p{{Nd}}+[A-Za-z]?{blanks}+)?(?:{'|'.join(map(spelling, markers))}))"


def _pieces(text: Column, markers: Sequence[str]) -> Column:
    # d: only \n ends a line. The sentinel is put in front of every marker, then split on.
    marked = F.regexp_replace(F.replace(text, F.lit(SENTINEL), F.lit("")), "(?imd)" + marker_pattern(markers), SENTINEL + "$1")
    return F.split(marked, SENTINEL, -1)


def _block(text: Column, heading: Column, is_preamble: Column) -> Column:
    return F.struct(text.alias("text"), heading.alias("heading_line"), is_preamble.alias("is_preamble"))


def scene_blocks(text: Column, pages: Column | None = None, markers: Sequence[str] = SCENE_MARKERS) -> Column:
    """ARRAY<STRUCT<text, heading_line, is_preamble>> in document order.

    Text in front of the first marker is the preamble. Without any marker and with more
    than one page, page 1 is the preamble and every other non-blank page a scene;
    otherwise the whole text is one preamble. Blank text gives no block.

    ``pages`` is ARRAY<STRUCT<label INT, text>>; ``label`` is the number in ``PAGE n``.
    """

    def from_markers(pieces: Column) -> Column:
        return F.transform(
            pieces,
            lambda p, i: let(
                strip_ws(p), lambda t: _block(t, F.when(i == 0, F.lit("")).otherwise(first_line(t)), i == 0)
            ),
        )

    def from_pages() -> Column:
        return F.transform(
            pages,
            lambda p: _block(
                strip_ws(p["text"]),
                F.when(p["label"] == 1, F.lit("")).otherwise(F.concat(F.lit("PAGE "), p["label"].cast("string"))),
                p["label"] == 1,
            ),
        )

    def build(pieces: Column) -> Column:
        if pages is None:
            return from_markers(pieces)
        return F.when((F.size(pieces) == 1) & (F.size(pages) > 1), from_pages()).otherwise(from_markers(pieces))

    kept = F.filter(let(_pieces(text, markers), build), lambda b: b["text"] != "")
    return F.when(strip_ws(text) != "", kept).otherwise(F.filter(kept, lambda b: F.lit(False)))


def split_scenes(
    scripts: DataFrame,
    text: str = "full_text",
    pages: str | None = None,
    markers: Sequence[str] = SCENE_MARKERS,
    true_page_numbers: bool = False,
) -> DataFrame:
    """One row per block: the other columns of ``scripts`` plus block_index, text,
    heading_line, is_preamble and scene_number (1..n, NULL for the preamble).

    ``pages`` names an ARRAY<STRUCT<page_no, text>> column of kept pages. Page scenes are
    labelled by their place among the kept pages, or by the true page number on request.
    """
    page_col = None
    if pages:
        page_col = F.transform(
            F.col(pages),
            lambda p, i: F.struct((p["page_no"] if true_page_numbers else i + 1).alias("label"), p["text"].alias("text")),
        )
    keep = [c for c in scripts.columns if c not in (text, pages)]
    # Only the first block can be a preamble, so it alone decides the scene numbers.
    numbered = let(
        scene_blocks(F.col(text), page_col, markers),
        lambda blocks: F.transform(
            blocks,
            lambda b, i: b.withField(
                "scene_number", F.when(~b["is_preamble"], i + 1 - F.get(blocks, F.lit(0))["is_preamble"].cast("int"))
            ),
        ),
    )
    return scripts.select(*keep, F.posexplode(numbered).alias("block_index", "block")).select(
        *keep, "block_index", "block.*"
    )


def is_page_fallback(is_preamble: Column, heading_line: Column) -> Column:
    return ~is_preamble & heading_line.startswith("PAGE ")


def split_summary(blocks: DataFrame, key: str = "script_id") -> DataFrame:
    """Blocks, scenes, preamble and page fallback per script."""
    return blocks.groupBy(key).agg(
        F.count("*").alias("block_count"),
        F.count_if(~F.col("is_preamble")).alias("scene_count"),
        F.bool_or("is_preamble").alias("has_preamble"),
        F.bool_or(is_page_fallback(F.col("is_preamble"), F.col("heading_line"))).alias("used_page_fallback"),
    )


FALLBACK_WARNING = "no scene markers, pages were taken as scenes"


def with_split_warnings(scripts: DataFrame, summary: DataFrame, key: str = "script_id") -> DataFrame:
    """scripts with the warnings of extraction followed by that of the split, none lost."""
    split = summary.select(key, F.when(F.col("used_page_fallback"), F.lit(FALLBACK_WARNING)).alias("_split"))
    given = F.coalesce(F.col("warnings"), F.array().cast("array<string>")) if "warnings" in scripts.columns else F.array().cast("array<string>")
    return scripts.join(split, key, "left").withColumn("warnings", F.array_compact(F.concat(given, F.array("_split")))).drop("_split")
