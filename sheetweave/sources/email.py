"""EML files as rows: headers, a bounded body preview and attachment names."""

from __future__ import annotations

from collections.abc import Iterator
from email import message_from_bytes, policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import clean_text
from ..operators.documents import html_text

PREVIEW = 4000
PARTS = "source_id string, subject string, sender string, recipients string, cc string, sent_at string, content string, body_source string, attachments array<string>"


def parts(path: str, data: bytes) -> tuple:
    """Headers, the plain body or else the HTML one, and names of attachments."""
    m = message_from_bytes(data, policy=policy.default)
    part = m.get_body(("plain", "html"))
    header = (str(m[h]) if m[h] is not None else None for h in ("subject", "from", "to", "cc", "date"))
    return (path, *header, part.get_content() if part is not None else "", part.get_content_subtype() if part is not None else None, [a.get_filename() or "" for a in m.iter_attachments()])


def read_emails(spark: SparkSession, path: str, most: int = PREVIEW) -> DataFrame:
    """A row for each EML file under ``path``: headers, the first ``most`` characters of the body's text, and its length."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            yield pd.DataFrame([parts(p, bytes(c)) for p, c in zip(page["path"], page["content"], strict=True)], columns=[x.split()[0] for x in PARTS.split(", ")])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PARTS)
    text = clean_text(F.when(F.col("body_source") == "html", html_text(F.col("content"))).otherwise(F.col("content")))
    return found.withColumn("_text", text).select("source_id", "subject", "sender", "recipients", "cc", "sent_at", F.left("_text", F.lit(most)).alias("body"), "body_source", F.length("_text").cast("bigint").alias("body_chars"), (F.length("_text") > most).alias("truncated"), "attachments")
