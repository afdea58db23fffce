"""Side tables, frequency lists, parallel corpora and sinks (SRC10, SRC11, SRC14-SRC16, SNK1-SNK4, SET4, SET5, PAR1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.sources.text import tokens, with_ids


def frequency_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC16: token, freq of lines 'word count': parted at white space, the word in lower
    case; lines without a whole number in second place are passed over; repeated words add up."""
    cells = lines.select(F.split(F.trim(column), r"\s+").alias("_c")).where(F.size("_c") >= 2)
    parsed = cells.select(F.lower(F.element_at("_c", 1)).alias("token"), F.element_at("_c", 2).try_cast("bigint").alias("freq"))
    return parsed.where(F.col("freq").isNotNull() & (F.col("token") != "")).groupBy("token").agg(F.sum("freq").alias("freq"))


def pos_definitions(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC15: tag, definition of lines 'TAG<tab>text' or 'TAG: text'; blank parts are passed over."""
    cells = lines.select(F.split(column, "[\t:]", 2).alias("_c")).where(F.size("_c") == 2)
    parsed = cells.select(F.trim(F.element_at("_c", 1)).alias("tag"), F.trim(F.element_at("_c", 2)).alias("definition"))
    return parsed.where((F.col("tag") != "") & (F.col("definition") != "")).groupBy("tag").agg(F.max("definition").alias("definition"))


def read_table(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """SRC11, SRC14, Q31: cells of a CSV file or of the first sheet of an .xlsx file as
    string columns c0, c1, ... A workbook is read on the driver: it is a small upload."""
    if path.lower().endswith(".xlsx"):
        rows = xlsx_rows(path)
        width = max((len(r) for r in rows), default=1)
        padded = [tuple(r + [None] * (width - len(r))) for r in rows[1 if header else 0 :]]
        return spark.createDataFrame(padded, ", ".join(f"c{i} string" for i in range(width)))
    df = spark.read.option("header", header).csv(path)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def xlsx_rows(path: str) -> list[list[str | None]]:
    """Cells of the first sheet of a workbook, by the standard library alone."""
    import re
    import zipfile
    from xml.etree import ElementTree

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path.removeprefix("file://")) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        sheet = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{ns}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{ns}c"):
                at = 0
                for letter in re.match(r"[A-Z]*", c.get("r", "")).group():
                    at = at * 26 + ord(letter) - 64
                cells += [None] * (max(at, 1) - 1 - len(cells))
                v = c.find(f"{ns}v")
                if c.get("t") == "s" and v is not None:
                    cells.append(shared[int(v.text)])
                elif c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{ns}t")))
                else:
                    cells.append(v.text if v is not None else None)
            out.append(cells)
    return out


def parallel_table(cells: DataFrame, filename: str) -> tuple[DataFrame, DataFrame]:
    """SRC11: (token table of the source, targets(sent_id, text)) of rows sent_id, c0
    (source), c1 (translation); rows without either are left out."""
    usable = cells.where((F.trim("c0") != "") & (F.trim("c1") != ""))
    words = usable.select(F.lit(filename).alias("filename"), "sent_id", F.posexplode(tokens(F.col("c0"))).alias("_k", "token"))
    rows = words.withColumn("pos", F.lit("TAG")).withColumn("lemma", F.col("token"))
    return with_ids(rows, ["sent_id", "_k"], "parallel").drop("_k"), usable.select("sent_id", F.col("c1").alias("text"))


def misaligned(source: DataFrame, target: DataFrame, key: str = "sent_id") -> DataFrame:
    """SET4: side, sent_id of the sentences that one side lacks; null ids are none."""
    s, t = (d.select(key).where(F.col(key).isNotNull()).distinct() for d in (source, target))
    return s.join(t, key, "left_anti").select(F.lit("source").alias("side"), key).unionByName(t.join(s, key, "left_anti").select(F.lit("target").alias("side"), key))


def parallel_corpus(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC10: (source tokens, targets(sent_id, text)) of two token tables with the same
    sentence ids; others are refused with ValueError."""
    if misaligned(source, target).limit(1).count():
        raise ValueError("the sentence ids of the two sides differ")
    packed = target.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("id", "token"))).alias("_w"))
    return source, packed.select("sent_id", F.array_join(F.transform("_w", lambda x: x["token"]), " ").alias("text"))


def with_translation(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """PAR1: lines with the translation of their sentence (null if there is none)."""
    return lines.join(targets.select("sent_id", F.col("text").alias("translation")), "sent_id", "left")


def concatenate(tables: list[DataFrame]) -> DataFrame:
    """SET5: token tables one after another, missing columns null, ids anew in the order given."""
    parts = [t.withColumn("_part", F.lit(i)) for i, t in enumerate(tables)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    renamed = rows.withColumnRenamed("id", "_old")
    return with_ids(renamed, ["_part", "_old"], "concatenate").drop("_part", "_old")


def write_corpus(tokens: DataFrame, path: str, rows_per_file: int = 4_000_000) -> None:
    """SNK1: the token table as parquet in id order, so that row groups cover id ranges
    and scans by id skip them; bloom filters serve lookups of words."""
    (
        tokens.repartitionByRange("id")
        .sortWithinPartitions("id")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .option("parquet.bloom.filter.enabled#_token_low", "true")
        .parquet(path)
    )


def parallel_xml(spark: SparkSession, source: str, target: str, **options) -> tuple[DataFrame, DataFrame]:
    """SRC10: (source tokens, targets(sent_id, text)) of two XML texts with the same
    sentence ids; options are those of xml.xml_rows."""
    from tokenloom.sources.xml import read_xml

    sides = [read_xml(spark.createDataFrame([(name, text)], "filename string, text string"), **options) for name, text in (("source", source), ("target", target))]
    return parallel_corpus(*sides)


#: Rows that a sheet of a workbook holds. Fixed value.
SHEET_ROWS = 1_048_576
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _cell(value) -> str:
    from xml.sax.saxutils import escape

    if value is None:
        return "<c/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value:
        return f"<c><v>{value}</v></c>"
    shown = "".join(c for c in str(value) if c >= " " or c in "\t\n\r")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(shown)}</t></is></c>'


def write_workbook(df: DataFrame, path) -> None:
    """A result as the only sheet of an .xlsx file (a path on the driver or an open file).
    More rows than a sheet holds are refused with ValueError; the rows come one by one."""
    import zipfile

    if df.limit(SHEET_ROWS).count() >= SHEET_ROWS:
        raise ValueError(f"a sheet holds {SHEET_ROWS} rows with its header")
    part = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{part}.sheet.main+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{part}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_RELATIONS}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="{_OFFICE}"><sheets><sheet name="Data" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_RELATIONS}"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    with zipfile.ZipFile(path.removeprefix("file://") if isinstance(path, str) else path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, head + text)
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write((head + f'<worksheet xmlns="{_SHEET}"><sheetData>').encode())
            for row in (df.columns,):
                sheet.write(("<row>" + "".join(map(_cell, row)) + "</row>").encode())
            for row in df.toLocalIterator():
                sheet.write(("<row>" + "".join(map(_cell, row)) + "</row>").encode("utf-8", "replace"))
            sheet.write(b"</sheetData></worksheet>")


def write_bundle(tables: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    """Several results as csv or xlsx files in one zip on the driver, their rows one by
    one; empty ones are left out."""
    import csv
    import io
    import tempfile
    import zipfile

    with zipfile.ZipFile(path.removeprefix("file://"), "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            if df.isEmpty():
                continue
            if fmt == "xlsx":
                with tempfile.TemporaryFile() as book:  # of the driver alone
                    write_workbook(df, book)
                    book.seek(0)
                    z.writestr(f"{name}.xlsx", book.read())
                continue
            with z.open(f"{name}.csv", "w") as raw, io.TextIOWrapper(raw, "utf-8", newline="") as text:
                writer = csv.writer(text)
                writer.writerow(df.columns)
                writer.writerows(df.toLocalIterator())


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """SNK2: a result as csv (with header) or parquet, written by the executors, or as xlsx
    or zip, a file on the driver; an empty result writes nothing."""
    if df.isEmpty():
        return
    if fmt == "xlsx":
        return write_workbook(df, path)
    if fmt == "zip":
        return write_bundle({"data": df}, path)
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def save_pos_definitions(spark: SparkSession, definitions: dict[str, str], path: str) -> None:
    """SNK3: replaces all; blank definitions are passed over."""
    rows = [(t, d.strip()) for t, d in definitions.items() if d and d.strip()]
    spark.createDataFrame(rows, "tag string, definition string").coalesce(1).write.mode("overwrite").parquet(path)


def load_pos_definitions(spark: SparkSession, path: str) -> dict[str, str]:
    try:
        return {r["tag"]: r["definition"] for r in spark.read.parquet(path).collect()}
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise


def set_metadata(spark: SparkSession, path: str, key: str, value: str) -> None:
    """SNK4: one entry of the corpus metadata, added or replaced."""
    held = get_metadata(spark, path) | {key: value}
    spark.createDataFrame(sorted(held.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(path)


def get_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    try:
        return {r["key"]: r["value"] for r in spark.read.parquet(path).collect()}
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise


def language(spark: SparkSession, path: str) -> str:
    """SNK4: the corpus language, English unless set."""
    return get_metadata(spark, path).get("language", "English")
