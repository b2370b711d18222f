"""Text from HTML, Markdown and files of unknown encoding."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Named characters that pages use.
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def html_text(html: Column | str) -> Column:
    """Text of a page: scripts, styles and comments out, a line break for each tag, named characters resolved, lines trimmed."""
    t = F.col(html) if isinstance(html, str) else html
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->"):
        t = F.regexp_replace(t, pattern, " ")
    t = F.regexp_replace(t, r"<[^>]+>", "\n")
    for k, v in NAMED.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    t = F.regexp_replace(t, r"[ \t\r]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n+", "\n"), r"^\s+|\s+$", "")


def markdown_text(text: Column | str) -> Column:
    """Markdown without its marks and tags."""
    t = F.col(text) if isinstance(text, str) else text
    for pattern, new in ((r"(?m)^#{1,6}\s+", ""), (r"[*_`]{1,3}([^*_`]+)[*_`]{1,3}", "$1"), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", "")):
        t = F.regexp_replace(t, pattern, new)
    return F.trim(t)


#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "gbk", "gb2312", "big5")


def decoded(content: Column | str) -> Column:
    """Bytes as text, in the first encoding that they are valid in."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> str | None:
            for e in ENCODINGS:
                try:
                    return None if raw is None else bytes(raw).decode(e)
                except UnicodeDecodeError:
                    continue
            return bytes(raw).decode(errors="replace")

        return batch.map(one)

    return run(content)


_PARAGRAPH, _RUN = (f"{{http://schemas.openxmlformats.org/wordprocessingml/2006/main}}{x}" for x in ("p", "t"))


def docx_text(content: Column | str) -> Column:
    """The paragraphs of Word documents that have a text, parted by blank lines; null for what can't be read."""

    def one(raw: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z, z.open("word/document.xml") as f:
                texts = ["".join(t.text or "" for t in p.iter(_RUN)) for _, p in ElementTree.iterparse(f) if p.tag == _PARAGRAPH]
            return "\n\n".join(t for t in texts if t.strip())
        except (TypeError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
            return None

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(one)

    return run(content)


#: Types of files by what reads them.
READERS = {"txt": "text", "text": "text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "docx": "docx"}


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_type, content, refused) of the files below a path: text, Markdown, HTML and Word documents. Files of other types, and
    those that can't be read, have no content and a reason in `refused`."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    f = raw.withColumn("file_type", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    reader = F.create_map(*(F.lit(x) for kv in READERS.items() for x in kv))[F.col("file_type")]
    f = f.withColumn("reader", reader)
    plain = f.where("reader <> 'docx'").select("path", "file_type", "reader", decoded("content").alias("t"))
    plain = plain.select("path", "file_type", F.when(F.col("reader") == "markdown", markdown_text("t")).when(F.col("reader") == "html", html_text("t")).otherwise(F.col("t")).alias("content"))
    word = f.where("reader = 'docx'").select("path", "file_type", docx_text("content").alias("content"))
    other = f.where("reader IS NULL").select("path", "file_type", F.lit(None).cast("string").alias("content"), F.concat(F.lit("no reader for ."), "file_type").alias("refused"))
    read = plain.unionByName(word).withColumn("refused", F.when(F.col("content").isNull(), "not readable"))
    return read.unionByName(other)


def workspace(spark: SparkSession, path: str, priority: dict[str, int] | None = None) -> DataFrame:
    """Markdown files below a folder, by priority and name, without hidden and vendored folders."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    raw = raw.where(~F.col("path").rlike(r"/(node_modules|\.git|__pycache__)/"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    table = priority or {"MEMORY.md": 10, "USER.md": 9, "SOUL.md": 8, "IDENTITY.md": 7, "README.md": 5}
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[name], F.lit(1))
    return raw.select("path", name.alias("filename"), rank.alias("priority"), F.col("content").cast("string").alias("content")).orderBy(F.desc("priority"), "filename")
