"""Loading of whole corpora (SRC1, SRC12, SRC13, SRC14, Q26, Q31, Q38)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.model import Corpus
from tokenloom.session import materialize
from tokenloom.sources.tables import read_table
from tokenloom.sources.text import language_of, looks_like_xml, plain_rows, read_files, tag_with, vertical_rows, with_ids
from tokenloom.sources.xml import promote, xml_rows

#: Formats a caller may choose for files that are no XML.
FORMATS = ("raw", "vertical")


def load(documents: DataFrame, *, fmt: str = "raw", language: str | None = None, tagger=None, rule: str = "tabs", failures=None) -> Corpus:
    """A corpus of documents(filename, text): XML is told by the name or the first
    kilobyte, everything else read in the chosen format; with a tagger raw text and the
    words between tags are tagged. Attributes and spans become columns, lang holds the
    language's code. rule tells vertical text inside XML, failures counts what the tagger
    fails on (see xml_rows). Null and blank texts give no row; ids follow the file names."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    usable = documents.where(F.col("filename").isNotNull() & (F.trim("text") != "")).select("filename", "text")
    is_xml = looks_like_xml(F.col("filename"), F.col("text"))
    marked, others = usable.where(is_xml), usable.where(~is_xml)
    rows = [xml_rows(marked, tagger=tagger, rule=rule, failures=failures).withColumn("_s", F.lit(0).cast("bigint"))]
    if fmt == "vertical":
        rows.append(vertical_rows(others).withColumn("_s", F.lit(0).cast("bigint")))
    elif tagger is not None:
        rows.append(tag_with(others, tagger, failures=failures).withColumn("_s", F.col("sent_id")))
    else:
        rows.append(plain_rows(others).withColumn("_s", F.col("sent_id")))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    same = [
        r.select("filename", "sent_id", "_s", F.col("_k").cast("bigint").alias("_k"), "token", "pos", "lemma", *([F.col(c) if c in r.columns else empty.alias(c) for c in ("meta", "context")]))
        for r in rows
    ]
    # written once: numbering and looking for attributes read the rows again, not the documents
    numbered = with_ids(materialize(reduce(DataFrame.unionByName, same), "load-rows"), ["filename", "_s", "_k"], "load").drop("_s", "_k")
    out = promote(numbered)
    if language is not None:
        out = out.withColumn("lang", F.coalesce(F.col("lang"), language_of(F.lit(language))) if "lang" in out.columns else language_of(F.lit(language)))
    return Corpus(out)


def load_files(spark: SparkSession, path: str, **options) -> Corpus:
    """SRC1: a corpus of the files below a path."""
    return load(read_files(spark, path), **options)


def load_built_in(spark: SparkSession, root: str, name: str, **options) -> Corpus:
    """SRC12: a corpus of a collection, <root>/<language>/<name>; its folder tells the language."""
    found = [r["path"] for r in discover(spark, root).where(F.col("name") == name).collect()]
    if not found:
        raise FileNotFoundError(name)
    folder = found[0].rsplit("/", 2)[-2]
    return load(read_files(spark, found[0]), language=folder, **options)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """SRC13: path, name, language (the folder) of the corpus files below a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{xml,txt,csv,xlsx}").load(root).select("path")
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), language_of(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).alias("language"))


def tagset(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: tag, definition of a two-column sheet."""
    cells = read_table(spark, path)
    return cells.where((F.trim("c0") != "") & (F.trim("c1") != "")).select(F.trim("c0").alias("tag"), F.trim("c1").alias("definition"))
