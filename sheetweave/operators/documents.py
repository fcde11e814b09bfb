"""Document rows: labelled values in line streams, layout signatures, text of HTML."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .reshape import islands


def field_values(lines: DataFrame, by: list[str], order: str, is_field: Column, text: str) -> DataFrame:
    """``field`` lines with all lines up to the next field joined as ``value``; lines before the first field are left out."""
    runs = islands(lines, by, [order], is_field, "field_no").where("field_no > 0")
    listed = F.array_sort(F.collect_list(F.struct(order, text)))
    texts = F.transform(listed, lambda s: s[text])
    return runs.groupBy(*by, "field_no").agg(texts.alias("t")).select(*by, "field_no", F.col("t")[0].alias("field"), F.array_join(F.slice("t", F.lit(2), F.size("t")), "\n").alias("value"))


def label_value_pairs(lines: DataFrame, by: list[str], order: str, text: str, value_pattern: str) -> DataFrame:
    """A label line followed by a line that matches ``value_pattern``; both are consumed, so pairs don't overlap.

    A line can be a label only where the next one is a value.  In a run of lines
    that match, each second one is therefore a value: parity within the run
    decides, which needs no loop over rows.
    """
    w = W.partitionBy(*by).orderBy(order)
    marked = lines.withColumn("_v", F.coalesce(F.col(text).rlike(value_pattern), F.lit(False)))
    marked = marked.withColumn("_next", F.coalesce(F.lead("_v").over(w), F.lit(False))).withColumn("_value", F.lead(text).over(w))
    # Lines whose successor is a value form runs; every second one of a run, from its first, is a label.
    marked = marked.withColumn("_run", F.sum((~F.col("_next")).cast("bigint")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    inside = W.partitionBy(*by, "_run").orderBy(order)
    numbered = marked.where("_next").withColumn("_k", F.row_number().over(inside))
    return numbered.where(F.col("_k") % 2 == 1).select(*by, order, F.col(text).alias("label"), F.col("_value").alias("value"))


def bucket(n: Column, edges: list[int], names: list[str]) -> Column:
    """The name of the first edge that ``n`` doesn't exceed, else the last name."""
    out = F.lit(names[-1])
    for e, name in reversed(list(zip(edges, names, strict=False))):
        out = F.when(n <= e, name).otherwise(out)
    return out


def signatures(pages: DataFrame, key: str, parts: list[Column], samples: int = 5) -> DataFrame:
    """``signature, pages`` and the first ``samples`` keys, of pages that look alike."""
    named = pages.select(key, F.concat_ws("|", *parts).alias("signature"))
    ranked = named.withColumn("_r", F.row_number().over(W.partitionBy("signature").orderBy(key))).where(F.col("_r") <= samples)
    first = ranked.groupBy("signature").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda k: k.cast("string")), ",").alias("samples"))
    return named.groupBy("signature").agg(F.count("*").alias("pages")).join(first, "signature")


# The character references that are resolved, the ampersand's last.
REFERENCES = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
MARKUP, ENDS = r"(?s)<!--.*?-->|<[!/?a-zA-Z][^>]*>", r"^[ \t\n\r\f]+|[ \t\n\r\f]+$"


def html_text(html: Column) -> Column:
    """What stands between tags and comments, trimmed, one piece to a line; text in scripts and styles is kept.

    References other than the common ones stay as they are.
    """
    pieces = F.transform(F.split(F.regexp_replace(html, MARKUP, "\x01"), "\x01"), lambda x: F.regexp_replace(x, ENDS, ""))
    text = F.array_join(F.filter(pieces, lambda x: x != ""), "\n")
    for name, char in REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def coordinate_lines(words: Iterator[tuple[float, float, str]], tolerance: float) -> list[tuple[float, str]]:
    """Visual rows of one page's (x, y, text): words within ``tolerance`` of a row's first y belong to it."""
    rows: list[tuple[float, list[tuple[float, str]]]] = []
    for y, x, text in sorted((y, x, t) for x, y, t in words):
        if rows and abs(y - rows[-1][0]) <= tolerance:
            rows[-1][1].append((x, text))
        else:
            rows.append((y, [(x, text)]))
    return [(y, " ".join(t for _, t in sorted(own))) for y, own in rows]


def visual_lines(words: DataFrame, by: list[str], tolerance: float = 3.0) -> DataFrame:
    """``by, y, text`` for the visual rows of each page of ``words(x0, y0, text)``; a page is handled in one task."""

    def page(df: pd.DataFrame) -> pd.DataFrame:
        found = coordinate_lines(zip(df["x0"], df["y0"], df["text"], strict=True), tolerance)
        return pd.DataFrame([(*df[by].iloc[0], y, t) for y, t in found], columns=[*by, "y", "text"])

    kinds = ", ".join(f"{c} {t}" for c, t in words.select(*by).dtypes)
    return words.groupBy(*by).applyInPandas(page, f"{kinds}, y double, text string")
