"""Text of attached documents, read with format binaryFile and told apart by their first bytes.

Zip-based formats are read with the standard library; PDF needs an optional package, without which its text is empty. The
older office format (HWP, kind ole) is told apart but not read: its text is empty. The parsers are small helpers: Spark reads, splits and picks.
"""

from __future__ import annotations

import html
import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def kind(content: Column, name: Column) -> Column:
    """pdf, ole, docx, hwpx or null."""
    head, low = F.substring(content, 1, 4), F.lower(name)
    return (
        F.when((head == F.expr("X'25504446'")) | low.endswith(".pdf"), "pdf").when((head == F.expr("X'D0CF11E0'")) | low.endswith(".hwp"), "ole")
        .when((F.substring(content, 1, 2) == F.expr("X'504B'")) & low.endswith(".docx"), "docx").when(F.substring(content, 1, 2) == F.expr("X'504B'"), "zip")
    )


def _paragraphs(data: bytes, wanted) -> list[str]:  # noqa: ANN001
    """The paragraphs of all wanted parts; of a part without any, its bare text elements; a broken part is left out."""
    out: list[str] = []
    local = lambda e: str(e.tag).rpartition("}")[2].lower()
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in sorted(n for n in z.namelist() if wanted(n.lower())):
                try:
                    with z.open(name) as part:
                        root = ElementTree.parse(part).getroot()
                except Exception:  # broken XML, checksum, compression or encoding
                    continue
                texts = lambda e: [x.text or "" for x in e.iter() if local(x) in ("t", "text")]
                found = [e for e in root.iter() if local(e) == "p"]
                out += [x for x in (["".join(texts(p)) for p in found] if found else texts(root)) if x.strip()]
    except (zipfile.BadZipFile, KeyError, OSError):
        return []
    return out


def _docx(data: bytes) -> list[str]:
    return _paragraphs(data, lambda n: n == "word/document.xml")


def _hwpx(data: bytes) -> list[str]:
    return _paragraphs(data, lambda n: n.endswith(".xml") and ("section" in n or "bodytext" in n))


def _pdf(data: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError:
        return []
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


@F.pandas_udf(StringType())
def document_text(content: pd.Series, kinds: pd.Series) -> pd.Series:
    def read(data: bytes, k: str | None) -> str:
        parts = {"docx": _docx, "zip": lambda d: _docx(d) or _hwpx(d), "pdf": _pdf}.get(k or "", lambda d: [])(bytes(data))
        lines = (" ".join(x.split()) for x in html.unescape("\n".join(parts)).splitlines())
        return "\n".join(x for x in lines if x)

    return pd.Series([read(d, k) if d is not None else "" for d, k in zip(content, kinds)], dtype=object)


def attachment_texts(files: DataFrame, content: str = "content", name: str = "path") -> DataFrame:
    """files with `kind` and `text`."""
    return files.withColumn("kind", kind(F.col(content), F.col(name))).withColumn("text", document_text(content, "kind"))


def longest(texts: DataFrame, key: str, text: str = "text", pos: str = "pos") -> DataFrame:
    """The longest text of each item; of equals, the first."""
    return texts.groupBy(key).agg(F.max_by(text, F.struct(F.length(text), -F.col(pos))).alias(text))
