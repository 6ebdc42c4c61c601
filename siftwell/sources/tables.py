"""Readers and writers of the engine's files."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.batches import mapped
from siftwell.functions.text import clean_crawled
from siftwell.operators import quality
from siftwell.schema import DOCUMENT, SEEDS


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped, and a missing file is an empty corpus."""
    try:
        return spark.read.schema(DOCUMENT).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DOCUMENT)


def write_corpus(docs: DataFrame, path: str, fresh: bool = False) -> None:
    docs.write.mode("overwrite" if fresh else "append").json(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEEDS).option("multiLine", True).json(path)


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """Trimmed lines that don't begin with #. A list of words has a small fixed size."""
    rows = spark.read.text(path).select(F.trim("value").alias("w")).where("w <> '' AND NOT startswith(w, '#')").distinct()
    return sorted(r["w"] for r in rows.collect())


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def save_checkpoint(path: str, frontier: DataFrame, visited: DataFrame, depleted: DataFrame) -> None:
    """The whole state of a crawl, sources that ran out included."""
    for name, rows in (("frontier", frontier), ("visited", visited), ("depleted", depleted)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, ...] | None:
    try:
        return tuple(spark.read.parquet(f"{path}/{n}") for n in ("frontier", "visited", "depleted"))
    except AnalysisException:
        return None


def write_report(docs: DataFrame, path: str) -> None:
    """The report's figures, distributions, breakdowns and samples, a folder each."""
    quality.verdicts(quality.validation(docs)).write.mode("overwrite").json(f"{path}/report")
    docs.sparkSession.createDataFrame([(report_markdown(docs),)], "text string").coalesce(1).write.mode("overwrite").text(f"{path}/report_markdown")
    quality.file_counts(docs).write.mode("overwrite").json(f"{path}/stats")
    quality.breakdown(docs).write.mode("overwrite").json(f"{path}/breakdown")
    spread = quality.distributions(docs)
    for d in ("source_site", "file_type", "page_role"):
        one = spread.where(F.col("dimension") == d).select("value", "n", "pct").orderBy(F.desc("n"), "value")
        one.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{d}_distribution")  # one row per value
    short = (F.length("content") > 0) & (F.length("content") < 100)
    quality.random_sample(docs).write.mode("overwrite").json(f"{path}/sample_docs")
    for name, where, n in (("short_content", short, 50), ("nav_noise", F.col("content_quality") == "nav_noise", 50), ("failed_content", F.col("content_quality") == "failed", 100)):
        quality.samples(docs, where, n).write.mode("overwrite").json(f"{path}/{name}_samples")


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs that aren't blank, a line each."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(W + "t")) for p in root.iter(W + "p"))
    return "\n".join(x for x in lines if x.strip())


def xlsx_text(data: bytes, most: int = 200) -> str:
    """Filled cells of each row, joined by spaces; the first `most` rows that aren't blank, over all sheets."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(S + "si")]
        out: list[str] = []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for sheet in sheets:
            for row in ElementTree.fromstring(z.read(sheet)).iter(S + "row"):
                cells = []
                for c in row.iter(S + "c"):
                    value = c.find(S + "v")
                    if c.get("t") == "s" and value is not None:
                        cells.append(shared[int(value.text)])
                    else:
                        cells.append(value.text if value is not None else "".join(t.text or "" for t in c.iter(S + "t")))
                line = " ".join(x for x in cells if x)
                if line.strip() and len(out) < most:
                    out.append(line)
    return "\n".join(out)


def pdf_text(data: bytes) -> str:
    """By the first reader, else by the second; both are optional."""
    try:
        import fitz

        with fitz.open(stream=data, filetype="pdf") as pages:
            return "\n".join(p.get_text() for p in pages)
    except Exception:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(data)) as pdf:
            return "\n".join(t for t in (p.extract_text() for p in pdf.pages) if t)


#: Old formats are tried with the readers of the new ones, which read those that are new under an old name.
READERS = {"docx": docx_text, "doc": docx_text, "xlsx": xlsx_text, "xls": xlsx_text, "pdf": pdf_text}
ARCHIVES = ("zip", "rar")


def parse_file(kind: str, data: bytes) -> tuple[str, str, str]:
    """Text, status (ok, failed, skipped), error. Archives are skipped; a text that is empty has failed; kinds that have
    no text to read are ok without one."""
    if kind in ARCHIVES:
        return "", "skipped", "archives aren't read"
    if kind not in READERS:
        return "", "ok", ""
    try:
        text = READERS[kind](data)
    except Exception as error:  # whatever a broken file makes a reader raise is a result, not a failure of the job
        return "", "failed", f"{type(error).__name__}: {error}"[:200]
    return (text, "ok", "") if text.strip() else ("", "failed", "empty text")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Attachments under a path: path, file_type, content, parse_status, parse_error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    return parse_files(files.select("path", kind.alias("file_type"), "content"))


def parse_files(files: DataFrame) -> DataFrame:
    """files: path, file_type, content (bytes). path, file_type, content (text), parse_status, parse_error."""

    def row(path, kind, data) -> tuple:
        return path, kind, *parse_file(kind, bytes(data))

    return mapped(files.select("path", "file_type", "content"), "content", row, "path string, file_type string, content string, parse_status string, parse_error string")


def attachment_documents(files: DataFrame) -> DataFrame:
    """files: name, anchor_text, category, content, parse_status. Adds title (the link's text, else the name, without
    extensions), content (of files without text what is known of them), content_length, content_quality (good beyond 50
    characters, else short; failed ones are short) and summary."""
    title = F.when(F.coalesce("anchor_text", F.lit("")) == "", F.col("name")).otherwise(F.col("anchor_text"))
    for ext in (".pdf", ".docx", ".doc", ".xlsx", ".xls"):
        title = F.replace(title, F.lit(ext), F.lit(""))
    files = files.withColumn("title", F.trim(title))
    known = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    bare = F.concat_ws(" | ", "title", known("链接文本: ", "anchor_text"), known("分类: ", "category"))
    content = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", bare).otherwise(F.col("content"))
    files = files.withColumn("content", content)
    good = (F.col("parse_status") != "failed") & (F.length("content") > 50)
    return files.withColumns(
        {
            "content_length": F.length("content"),
            "content_quality": F.when(good, "good").otherwise("short"),
            "summary": F.when(F.col("content") == "", F.col("name")).otherwise(clean_crawled(F.substring("content", 1, 200))),
            "content": clean_crawled(F.col("content")),
        }
    )


def snapshots_of(docs: DataFrame, path: str) -> DataFrame:
    """docs: doc_id. doc_id, has_snapshot, html (null without one)."""
    try:
        saved = docs.sparkSession.read.parquet(f"{path}/snapshots").select("doc_id", "html")
    except AnalysisException:  # none yet
        saved = docs.select("doc_id", F.lit("").alias("html")).limit(0)
    return docs.select("doc_id").join(saved, "doc_id", "left").select("doc_id", F.col("html").isNotNull().alias("has_snapshot"), "html")


def read_snapshot(spark: SparkSession, path: str, doc_id: str) -> str | None:
    """The saved page of a document, None if there is none."""
    return snapshots_of(spark.createDataFrame([(doc_id,)], ["doc_id"]), path).first()["html"]


def has_snapshot(spark: SparkSession, path: str, doc_id: str) -> bool:
    return read_snapshot(spark, path, doc_id) is not None


def report_markdown(docs: DataFrame) -> str:
    """The quality report as text. Its tables have a row per source, role or kind of file."""
    facts = quality.verdicts(quality.validation(docs)).first().asDict()
    spread: dict[str, list] = {}
    for r in quality.distributions(docs).orderBy(F.desc("n"), "value").collect():
        spread.setdefault(r["dimension"], []).append(r)
    parts: dict[str, list] = {}
    for r in quality.breakdown(docs).orderBy(F.desc("n"), "value").collect():
        parts.setdefault(r["kind"], []).append(r)
    ratio = lambda n, r: f"{facts[n]} ({facts[r]}%)"
    overview = (
        ("总文档数", facts["total_docs"]), ("无标题数量", ratio("no_title_count", "no_title_ratio")), ("空正文数量", ratio("empty_content_count", "empty_content_ratio")),
        ("短正文数量", ratio("short_content_count", "short_content_ratio")), ("平均正文长度", f"{facts['avg_content_length']} 字符"), ("重复 URL", facts["duplicate_urls"]),
        ("重复 content_hash", facts["duplicate_content_hashes"]), ("疑似噪声文档", facts["suspected_noise_docs"]), ("最大 source_site", ratio("max_source_site", "max_source_site_pct")),
        ("document 数量", ratio("document_count", "document_pct")), ("疑似 list 误判", f"{facts['list_misclassify_count']} 条"), ("nav_noise 样本", f"{facts['nav_noise_count']} 条"),
    )
    lines = ["# 数据质量报告", "", "## 概览", "", "| 指标 | 值 |", "|------|----|", *(f"| {a} | {b} |" for a, b in overview)]
    if facts.get("warnings"):
        lines += ["", "## WARNING", "", *(f"- **{w}**" for w in facts["warnings"])]
    for title, dimension, share in (("page_role 分布", "page_role", True), ("来源分布", "source_site", True), ("file_type 分布", "file_type", False), ("content_quality 分布", "content_quality", True), ("parse_status 分布", "parse_status", True)):
        rows = spread.get(dimension, [])
        rows = rows if dimension == "source_site" else sorted(rows, key=lambda r: r["value"])
        lines += ["", f"## {title}", "", *(f"- {r['value']}: {r['n']}" + (f" ({r['pct']}%)" if share else "") for r in rows)]
    if parts.get("failed_by_source"):
        lines += ["", "## content_quality failed 分析", "", f"总计 failed: {facts['failed_count']} ({facts['failed_pct']}%)", "", "### 按 source_site 分布", ""]
        lines += [f"- {r['value']}: {r['n']} ({round(r['n'] * 100 / max(facts['failed_count'], 1), 1)}%)" for r in parts["failed_by_source"]]
        lines += ["", "### 按 URL pattern 分布 (top 15)", "", *(f"- `{r['value']}`: {r['n']}" for r in parts.get("failed_by_pattern", []))]
    lines += ["", "## 短正文按 page_role 分布", "", *(f"- {r['value']}: {r['n']}" for r in sorted(parts.get("short_by_role", []), key=lambda r: r["value"]))]
    return "\n".join(lines) + "\n"
