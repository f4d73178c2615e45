"""Reading name lists and ground truth, writing results."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Cell texts that count as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """A CSV file with header, all columns as text in UTF-8.

    ValueError for other encodings, empty files, files above ``max_bytes`` and unreadable rows.
    """
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if not size:
        raise ValueError("CSV file is empty")
    if max_bytes is not None and size > max_bytes:
        raise ValueError(f"CSV file has more than {max_bytes} bytes")
    if not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty():
        raise ValueError("CSV file is not UTF-8")
    try:
        df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", quote='"', escape='"', multiLine=True, mode="FAILFAST")
        columns = df.columns
    except Exception as error:
        raise ValueError(f"CSV file cannot be parsed: {error}") from error
    if not columns:
        raise ValueError("CSV file has no columns")
    return df


def names_of(df: DataFrame, column: str | None = None) -> DataFrame:
    """(ord, name): distinct non-missing values of the first (or named) column, ord by first appearance."""
    if not df.columns:
        raise ValueError("no columns")
    value = F.col(f"`{column or df.columns[0]}`").cast("string")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.when(~value.isin(*MISSING), value).alias("name")).where("name is not null")
    return rows.groupBy("name").agg(F.min("row").alias("ord")).select("ord", "name")


def read_names(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Names of a CSV file; ValueError if it holds none."""
    if not path.lower().endswith(".csv"):
        raise ValueError("only .csv files are accepted")
    names = names_of(read_csv(spark, path, max_bytes))
    if names.isEmpty():
        raise ValueError("no names in the first column")
    return names


def limited(names: DataFrame, n: int) -> DataFrame:
    return names.orderBy("ord").limit(n)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(original, canonical) of a two-column CSV; the last row of an original wins."""
    df = read_csv(spark, path)
    original, canonical = (F.col(f"`{c}`") for c in df.columns[:2])
    rows = df.select(original.alias("original"), canonical.alias("canonical"), F.monotonically_increasing_id().alias("row"))
    return rows.groupBy("original").agg(F.max_by("canonical", "row").alias("canonical"))


def _windows_1252() -> tuple[str, str]:
    """Characters of windows-1252 that Latin-1 lacks, and the Latin-1 characters of the same bytes."""
    pairs = [(bytes([b]).decode("cp1252", "ignore"), chr(b)) for b in range(0x80, 0xA0)]
    return "".join(a for a, _ in pairs if a), "".join(b for a, b in pairs if a)


def repair_mojibake(column: str) -> Column:
    """Text whose UTF-8 bytes were once read as windows-1252, read right; unchanged where that is not possible."""
    wide, narrow = _windows_1252()
    latin = F.translate(F.col(column), wide, narrow)
    fits = ~latin.rlike(r"[^\x{0}-\x{FF}]")
    fixed = F.try_validate_utf8(F.encode(F.when(fits, latin), "ISO-8859-1").cast("string"))
    return F.coalesce(fixed, F.col(column))


def write_mappings(mappings: DataFrame, path: str) -> None:
    """Original Name, Canonical Name, Confidence Score (3 places), Group ID; every cell quoted."""
    mappings.select(
        F.col("original_name").alias("Original Name"), F.col("canonical_name").alias("Canonical Name"),
        F.format_string("%.3f", F.col("confidence_score")).alias("Confidence Score"), F.col("group_id").cast("string").alias("Group ID"),
    ).write.csv(path, header=True, quoteAll=True, escape='"')


def write_audit(audit: DataFrame, path: str) -> None:
    audit.write.json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Numbers with four places, as CSV and as JSON."""
    rounded = metrics.select(*[F.format_string("%.4f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in metrics.dtypes])
    rounded.write.csv(f"{path}/csv", header=True)
    metrics.write.json(f"{path}/json")


def markdown(metrics: DataFrame, rows: int = 100) -> str:
    """A small report table as Markdown."""
    head = metrics.limit(rows).collect()
    lines = ["| " + " | ".join(metrics.columns) + " |", "|" + "---|" * len(metrics.columns)]
    return "\n".join(lines + ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in head])


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(test, grp, canonical, member, share) of a text report: TESTING:, Group n, Canonical: and "- member  pct" lines.

    Lines are numbered by partition and position; each member takes the latest
    headings before it within its test.
    """
    lines = spark.read.text(path, wholetext=False).coalesce(1).withColumn("n", F.monotonically_increasing_id())
    v = F.col("value")
    marked = lines.select(
        "n",
        F.nullif(F.trim(F.regexp_extract(v, r"^\s*TESTING:\s*(.*)$", 1)), F.lit("")).alias("t"),
        F.nullif(F.regexp_extract(v, r"^\s*Group\s+(\d+)", 1), F.lit("")).alias("g"),
        F.nullif(F.trim(F.regexp_extract(v, r"^\s*Canonical:\s*(.*)$", 1)), F.lit("")).alias("c"),
        F.nullif(F.trim(F.regexp_extract(v, r"^\s*-\s+(.*?)(?:\s{2,}[\d.]+%)?\s*$", 1)), F.lit("")).alias("m"),
        F.nullif(F.regexp_extract(v, r"\s{2,}([\d.]+)%\s*$", 1), F.lit("")).alias("p"),
    )
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda c: F.last(c, ignorenulls=True).over(upto)
    seen = marked.select(latest("t").alias("test"), latest("g").cast("int").alias("grp"), latest("c").alias("canonical"), "m", "p", "n")
    return seen.where("m is not null").select("test", "grp", "canonical", F.col("m").alias("member"), (F.col("p").try_cast("double") / 100).alias("share"))


def logger(name: str = "namelink", path: str | None = None) -> logging.Logger:
    """A logger to the console and, if asked, a file."""
    log = logging.getLogger(name)
    if not log.handlers:
        shape = logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s")
        for handler in [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
            handler.setFormatter(shape)
            log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log


# Hard spellings for tests of matchers, by kind.
VARIATIONS = (
    ("abbreviation", "Intl Business Mach", "International Business Machines"),
    ("typo", "Gogle LLC", "Google LLC"),
    ("word order", "Company Ford Motor", "Ford Motor Company"),
    ("accent", "Nestle SA", "Nestlé S.A."),
    ("punctuation", "A.T.&T", "AT&T Inc."),
    ("spacing", "Face Book", "Facebook"),
    ("case", "microsoft CORPORATION", "Microsoft Corporation"),
    ("legal form", "Siemens Aktiengesellschaft", "Siemens AG"),
    ("number", "Three M Company", "3M Company"),
    ("script", "Honда Motor", "Honda Motor"),
)


def with_variations(names: DataFrame) -> DataFrame:
    """``names`` and the hand-written variations, placed after all of them."""
    spark = names.sparkSession
    last = names.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    extra = spark.createDataFrame(
        [(last + 1 + i, v) for i, (_, v, _) in enumerate(VARIATIONS)], StructType([names.schema["ord"], StructField("name", StringType())])
    )
    return names.unionByName(extra.join(names.select("name"), "name", "left_anti").select("ord", "name"))
