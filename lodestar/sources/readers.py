"""Readers of text collections, and the Python-free parsing of their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: Directories of pages; of raw sources with their types; extensions that are read; largest raw source.
PAGE_DIRS = ["entities", "concepts", "comparisons", "summaries", "synthesis"]
SOURCE_DIRS = {"articles": "article", "papers": "paper", "repos": "repo", "videos": "video", "podcasts": "podcast", "books": "book", "datasets": "dataset", "conversations": "conversation", "captures": "capture"}
EXTENSIONS = ["md", "txt", "json", "yaml", "yml", "rst", "csv"]
LARGEST = 2_097_152


def source_type(ref) -> Column:
    """The type that the directory of a raw/ reference stands for; null for others."""
    kinds = F.create_map(*[F.lit(x) for pair in SOURCE_DIRS.items() for x in pair])
    return F.try_element_at(kinds, F.try_element_at(F.split(text.col(ref), "/"), F.lit(2)))


def _files(spark: SparkSession, paths: list[str], glob: str, deep: bool = False) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(deep).lower()).load(paths)


def _existing(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    jvm = spark._jvm
    out = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            out.append(f"{root}/{name}")
    return out


def pages(spark: SparkSession, root: str) -> DataFrame:
    """(id, metadata, sources, content, modified, error) of the Markdown pages below root, from the known directories only.

    metadata has the first value of each field; sources all values of `source`. A header that is not
    closed is an error, and its page is all content.
    """
    found = _existing(spark, root, PAGE_DIRS)
    if not found:
        return spark.createDataFrame([], "id string, metadata map<string,string>, sources array<string>, content string, modified timestamp, error string")
    raw = _files(spark, found, "*.md")
    head, body = text.frontmatter(F.decode("content", "UTF-8"))
    fields = F.filter(F.split(head, "\n"), lambda line: line.rlike(r"^[A-Za-z_]+:"))
    entries = F.transform(fields, lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(line, r"^[^:]*:", "")), r"^[\"']|[\"']$", "").alias("v")))
    firsts = F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, 1, i), lambda x: x["k"] == e["k"])))
    page = F.lower(F.regexp_extract("path", r"([^/]+/[^/]+)\.md$", 1))
    whole = F.decode("content", "UTF-8")
    error = F.when(whole.rlike(r"\A---[ \t]*\r?\n") & (head == "") & ~whole.rlike(r"(?s)\A---[ \t]*\r?\n.{0,10000}?\r?\n---"), "header is not closed")
    return raw.select(page.alias("id"), firsts.alias("metadata"), text.listed(head, "source").alias("sources"), body.alias("content"), F.col("modificationTime").alias("modified"), error.alias("error"))


def raw_sources(spark: SparkSession, root: str) -> DataFrame:
    """(ref, kind, bytes, hash) of supported files in the known raw directories, not below them."""
    found = _existing(spark, f"{root}/raw", list(SOURCE_DIRS))
    if not found:
        return spark.createDataFrame([], "ref string, kind string, bytes long, hash string")
    raw = _files(spark, found, f"*.{{{','.join(EXTENSIONS)}}}")
    ref = F.concat(F.lit("raw/"), F.regexp_extract("path", r"/raw/(.+)$", 1))
    body = F.decode("content", "UTF-8")
    return raw.select(ref.alias("ref"), source_type(ref).alias("kind"), F.col("length").alias("bytes"), text.content_hash(body).alias("hash"))


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """(ref) of all supported files below raw/, in any folder."""
    if not _existing(spark, root, ["raw"]):
        return spark.createDataFrame([], "ref string")
    raw = _files(spark, [f"{root}/raw"], f"*.{{{','.join(EXTENSIONS)}}}", deep=True)
    return raw.select(F.concat(F.lit("raw/"), F.regexp_extract("path", r"/raw/(.+)$", 1)).alias("ref"))


def template(spark: SparkSession, path: str) -> list[str]:
    """The fields that a template file names: the list below `extract:`."""
    whole = spark.read.text(path, wholetext=True).first()[0]  # one small file
    found: list[str] = []
    inside = False
    for line in whole.split("\n"):
        if inside and line.strip().startswith("- "):
            found.append(line.strip()[2:].strip().strip("\"'"))
        elif line.strip() and not line.strip().startswith("#"):
            inside = line.rstrip() == "extract:"
    return found


def purpose(spark: SparkSession, root: str) -> str:
    """The focus document, or nothing."""
    if not _existing(spark, root, ["purpose.md"]):
        return ""
    return spark.read.text(f"{root}/purpose.md", wholetext=True).first()[0].strip()  # one small file


def raw_texts(spark: SparkSession, root: str) -> DataFrame:
    """(id, title, content) of Markdown sources of at most LARGEST bytes, for search; hidden folders and assets are left out."""
    raw = _files(spark, [f"{root}/raw"], "*.md", deep=True).where((F.col("length") <= LARGEST) & ~F.col("path").rlike(r"/raw/(?:assets|\.[^/]*)/"))
    _, body = text.frontmatter(F.decode("content", "UTF-8"))
    return raw.select(F.concat(F.lit("raw/"), F.regexp_extract("path", r"/raw/(.+)$", 1)).alias("id"), F.lit("").alias("title"), F.lower(body).alias("content"))


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; malformed lines are left out, an absent file is empty."""
    if not _existing(spark, path.rpartition("/")[0], [path.rpartition("/")[2]]):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
