"""Lines of extracted text: distinct ones, those like table rows, those with a task's terms, and how sure an extraction is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marram.functions.text import text

MAX_LINES = 50_000


def line_rows(docs: DataFrame, column: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, ix, line): non-blank lines without bullets, the first of those equal without case; ix from 0.

    Character references aren't decoded.
    """
    raw = F.split(F.regexp_replace(text(F.col(column)), r"\r\n?", "\n"), "\n")
    rows = docs.select(id_col, F.posexplode(raw).alias("_at", "line")).withColumn("line", F.trim(F.regexp_replace(F.col("line"), r"(?U)^\s*[-•]\s+|\s+$", ""))).where("line <> ''")
    same = Window.partitionBy(id_col, F.lower("line")).orderBy("_at")
    rows = rows.withColumn("_rn", F.row_number().over(same)).where("_rn = 1")
    return rows.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("_at")) - 1).alias("ix"), "line").where(F.col("ix") < MAX_LINES)


def task_terms(task: Column) -> Column:
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text(task), F.lit(r"[a-zA-Z0-9_\-\.]{3,}"), F.lit(0)), lambda x: F.lower(x))), 1, 64)


def table_like(line: Column, terms: Column) -> Column:
    """Delimiters, a year, a part number or a term of the task."""
    marks = line.rlike(r"(?U)\s{2,}|\||,|\t") | line.rlike(r"(?U)\b(19|20)\d{2}\b") | line.rlike(r"(?U)\b[A-Z0-9][A-Z0-9\-]{3,}\b")
    return marks | F.exists(terms, lambda t: F.lower(line).contains(t))


def confidence(sections: Column, network: Column, rows: Column, lines: Column, chars: Column) -> Column:
    """How sure an extraction is by its counts of meaningful sections, responses, table rows, relevant lines and characters."""
    return F.when((sections > 0) & (network > 0), "high").when((sections > 0) | (rows >= 20), "medium_high").when(lines > 0, "medium").when(chars > 500, "low").otherwise("very_low")
