"""Plain and vertical text (SRC1-SRC3, SRC12, SRC13, TOK1, TOK2, TOK4, PRJ1, PRJ2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.plans.dense import dense_number

#: What a token is made of besides single marks. Fixed value.
MARK = r"([^\p{L}\p{N}_\s\p{Z}])"
#: Endings of corpus files, and the beginnings that tell markup. Fixed values.
ENDINGS = ("xml", "txt", "csv", "xlsx")
XML_STARTS = ("<text", "<corpus", "<p")
LANGUAGES = {
    "english": "en", "indonesian": "id", "japanese": "ja", "german": "de", "french": "fr", "chinese": "zh", "arabic": "ar", "hindi": "hi", "thai": "th",
}


def sentences(text: Column, keep_tail: bool = False) -> Column:
    """TOK1: array of sentences: runs up to . ? or ! before white space or the end; a text
    without any is one sentence. Text after the last mark is dropped unless keep_tail (Q18)."""
    # parted after the marks, in one linear pass; only the last part may lack its mark
    parts = F.filter(F.transform(F.split(text, r"(?<=[.?!])\s+"), lambda s: F.regexp_replace(s, r"\A\s+|\s+\z", "")), lambda s: s != "")
    whole = (F.size(parts) < 2) | F.element_at(parts, -1).rlike(r"[.?!]\z")
    return parts if keep_tail else F.when(whole, parts).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))))


def tokens(text: Column) -> Column:
    """TOK2: array of tokens: every mark by itself, the rest parted at white space."""
    return F.filter(F.split(F.regexp_replace(text, MARK, " $1 "), r"[\s\p{Z}]+"), lambda t: t != "")


def strip_markup(text: Column) -> Column:
    """TOK4."""
    return F.regexp_replace(text, "<[^>]*>", "")


def looks_like_xml(path: Column, text: Column) -> Column:
    """SRC1: by the file's ending or a tag in its first kilobyte."""
    head = F.lower(F.substring(text, 1, 1024))
    test = F.lower(path).endswith(".xml") | F.ltrim(head).startswith("<")
    for start in XML_STARTS:
        test = test | head.contains(start)
    return test


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """filename, text of whole files. Subfolders included; endings of corpus files only (SRC13)."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}").text(path)
    return files.select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("filename"), F.regexp_replace("value", "\\A\\ufeff", "").alias("text"))


def language_of(name: Column) -> Column:
    """Code of a language given by name or code (Q38)."""
    low = F.lower(F.trim(name))
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), low), low)


def with_ids(rows: DataFrame, order: list[str], label: str = "ids") -> DataFrame:
    """PRJ1, PRJ2: dense ids from 1 in the given order (a unique key), and _token_low."""
    return dense_number(rows, order, "id", 1, label).withColumn("_token_low", F.lower("token"))


def plain_rows(documents: DataFrame, name: str = "filename", text: str = "text", keep_tail: bool = False) -> DataFrame:
    """SRC3: rows of raw text: filename, sent_id (from 1), _k (place in the sentence),
    token, pos 'TAG', lemma = token. Null and blank texts give none."""
    parts = documents.where(F.col(name).isNotNull()).select(F.col(name).alias("filename"), F.posexplode(sentences(F.col(text), keep_tail)).alias("_s", "_text"))
    words = parts.select("filename", (F.col("_s") + 1).cast("bigint").alias("sent_id"), F.posexplode(tokens(F.col("_text"))).alias("_k", "token"))
    return words.withColumn("pos", F.lit("TAG")).withColumn("lemma", F.col("token"))


def vertical_rows(documents: DataFrame, name: str = "filename", text: str = "text") -> DataFrame:
    """SRC2: rows of vertical text: one token a line, columns token, pos, lemma parted by
    tabs or else by white space; missing ones are '###'; lines that begin with # are
    comments; sent_id is 0 throughout (Q20)."""
    lines = documents.where(F.col(name).isNotNull()).select(F.col(name).alias("filename"), F.posexplode(F.split(text, r"\r?\n")).alias("_k", "_line"))
    kept = lines.where((F.trim("_line") != "") & ~F.col("_line").startswith("#"))
    cells = kept.withColumn("_c", F.when(F.col("_line").contains("\t"), F.split("_line", "\t")).otherwise(F.split(F.trim("_line"), r"\s+")))

    def cell(i: int) -> Column:
        value = F.trim(F.try_element_at("_c", F.lit(i)))
        return F.when(value.isNull() | (value == ""), "###").otherwise(value)

    return cells.select("filename", F.lit(0).cast("bigint").alias("sent_id"), "_k", cell(1).alias("token"), cell(2).alias("pos"), cell(3).alias("lemma"))


def build(rows: DataFrame, label: str = "ids") -> DataFrame:
    """A token table of rows with filename, sent_id and _k: files in order of their names."""
    return with_ids(rows, ["filename", "sent_id", "_k"], label).drop("_k")


def guarded(tagger, failures=None):
    """A tagger that gives nothing where it fails; an accumulator counts how often."""

    def run(text: str) -> list:
        try:
            return list(tagger(text))
        except Exception:  # noqa: BLE001  whatever the injected code raises
            if failures is not None:
                failures.add(1)
            return []

    return run


def tag_with(documents: DataFrame, tagger, name: str = "filename", text: str = "text", failures=None) -> DataFrame:
    """TOK3: rows by an injected tagger (text to a list of (token, pos, lemma)), sentence by
    sentence; a sentence on which the tagger fails is tokenised plainly and counted in
    failures, an accumulator."""
    import re

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"filename": [], "sent_id": [], "_k": [], "token": [], "pos": [], "lemma": []}
            for file, s, part in zip(*(batch.column(c).to_pylist() for c in ("filename", "_s", "_text"))):
                made = guarded(tagger, failures)(part) or [(t, "TAG", t) for t in re.sub(r"([^\w\s])", r" \1 ", part).split()]
                for k, (token, pos, lemma) in enumerate(made):
                    for c, v in zip(out, (file, s + 1, k, token, pos, lemma)):
                        out[c].append(v)
            types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(out, types)], list(out))

    parts = documents.where(F.col(name).isNotNull()).select(F.col(name).alias("filename"), F.posexplode(sentences(F.col(text), True)).alias("_s", "_text"))
    return parts.mapInArrow(run, "filename string, sent_id bigint, _k int, token string, pos string, lemma string")
