"""Text of attachments by their kind, within limits, and why there is none."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest file that is read, and the longest text that is kept.
MOST_BYTES, MOST_TEXT = 12 << 20, 20_000
RESULT = "status string, reason string, text string"

# Endings by kind of attachment.
KINDS = (("pdf", r"\.pdf$"), ("hwp", r"\.hwp$"), ("hwpx", r"\.hwpx$"), ("docx", r"\.docx$"), ("txt", r"\.(?:txt|csv|md)$"), ("html", r"\.html?$"), ("zip", r"\.zip$"))


def kind(name: Column) -> Column:
    """The kind of attachment by the ending of its name; 'unknown' for others."""
    bare = F.lower(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"[?#].*$", ""))
    return F.coalesce(*[F.when(bare.rlike(ending), k) for k, ending in KINDS], F.lit("unknown"))


def read_text(kind: str, data: bytes | None) -> tuple[str, str, str | None]:
    """(status, reason, text) of one file."""
    import io
    import re
    import zipfile
    from html import unescape

    data = data or b""
    if kind not in ("hwpx", "docx", "txt", "html", "zip"):
        return "unsupported", "unsupported attachment type", None
    if len(data) > MOST_BYTES:
        return "failed", "attachment exceeds the size limit", None
    plain = lambda raw: unescape(re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ", raw.decode("utf-8", "replace")))
    try:
        if kind == "txt":
            text = data.decode("utf-8-sig", "replace")
        elif kind == "html":
            text = plain(data)
        else:  # office files are archives of markup; its order is that of the names
            with zipfile.ZipFile(io.BytesIO(data)) as files:
                names = sorted(i.filename for i in files.infolist() if re.search(r"\.(xml|txt|html?)$", i.filename) and i.file_size <= MOST_BYTES)
                wanted = [n for n in names if re.search(r"word/document|Contents/section", n)] or names
                text = "\n".join(plain(files.read(n)) for n in wanted)
    except (zipfile.BadZipFile, RuntimeError, ValueError) as error:
        return "failed", f"extraction failed: {error}"[:200], None
    text = re.sub(r"\s+", " ", text).strip()[:MOST_TEXT]
    return ("extracted", "", text) if text else ("failed", "attachment returned no readable text", None)


def extracted(kind_of: Column, data: Column) -> Column:
    """struct(status, reason, text) of attachments, read where they lie."""
    @F.pandas_udf(RESULT)
    def texts(kinds: pd.Series, files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_text(k, d) for k, d in zip(kinds, files)], columns=["status", "reason", "text"])

    return texts(kind_of, data)


def failure_code(kind_of: Column, status: Column, reason: Column) -> Column:
    """Why an attachment has no text, as a code; null for one that has."""
    why = F.lower(F.coalesce(reason, F.lit("")))
    return (
        F.when(status == "extracted", F.lit(None).cast("string")).when((status == "unsupported") & (kind_of == "hwp"), "legacy_hwp_converter_missing").when(status == "unsupported", "unsupported_attachment_type")
        .when(why.rlike("exceeds|maxcontentlength|maxbodylength|too large"), "attachment_too_large").when(why.rlike("timeout|timed out|etimedout"), "download_timeout")
        .when(why.rlike("no readable text"), "no_readable_text").when(why.rlike("status code|network|socket|enotfound|econn"), "download_failed").otherwise("extraction_failed")
    )
