"""What a task asks for: its kind, the section labels to look for, and whether what was extracted is enough."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marram import rules
from marram.functions.text import text
from marram.operators.sections import ALIASES, DOCUMENTATION, PRODUCT, bare, heading, plain


def mentions(task: Column, terms: Iterable[str]) -> Column:
    """Whether the lower-cased task holds one of the terms."""
    low, out = F.lower(text(task)), F.lit(False)
    for term in terms:
        out = out | F.contains(low, F.lit(term))
    return out


def is_product(task: Column) -> Column:
    return mentions(task, rules.PRODUCT_TERMS)


def is_documentation(task: Column) -> Column:
    return mentions(task, (*rules.DOCUMENTATION_TERMS, *rules.DOCUMENTATION_PHRASES))


def _first_of_each(values: Column) -> Column:
    """Without blanks and repeats, told without case; the first of each."""
    clean = F.filter(F.transform(values, bare_label), lambda x: x != "")
    return F.filter(clean, lambda x, i: F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1)


def bare_label(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def page_labels(task: Column, headers: Column | None = None, product: Column | None = None) -> Column:
    """Section labels for a task, in order: the headers or, without any, those of its kind; the groups that its terms name;
    what it has in quotes."""
    none = F.array().cast("array<string>")
    listed = lambda values: F.array(*map(F.lit, values))
    given = none if headers is None else F.coalesce(headers, none)
    bare_task = F.size(given) == 0
    parts = [given, F.when(bare_task & is_documentation(task), listed(DOCUMENTATION)).otherwise(none)]
    parts.append(F.when(bare_task & (F.lit(False) if product is None else product), listed(PRODUCT)).otherwise(none))
    parts += [F.when(mentions(task, terms), listed(group)).otherwise(none) for terms, group in zip(rules.LABEL_TERMS, ALIASES, strict=True)]
    parts.append(F.regexp_extract_all(text(task), F.lit('"([^"]{3,80})"'), F.lit(1)))
    return _first_of_each(F.concat(*parts))


def meaningful(sections: Column) -> Column:
    """How many sections of a map, as with_sections gives it, have content and aren't labels of controls."""
    reveal = sorted(map(heading, rules.REVEAL_LABELS))
    kept = F.filter(F.map_entries(sections), lambda e: ~plain(e["key"]).isin(reveal) & (bare(F.coalesce(e["value"]["content"], F.lit(""))) != ""))
    return F.coalesce(F.size(kept), F.lit(0))


def extraction_sufficient(task: Column, sections: Column, rows: Column, lines: Column, network: Column, chars: Column) -> Column:
    """Whether counts of meaningful sections, table rows, relevant lines, responses and characters answer the task."""
    table = mentions(task, rules.TABLE_TERMS) & (rows >= 20)
    part = is_product(task) & ((sections > 0) | (rows >= 10) | (lines >= 10))
    return table | part | (sections > 0) | (lines >= 8) | ((network > 0) & (chars > 1000)) | ((chars > 3000) & (lines >= 3))
