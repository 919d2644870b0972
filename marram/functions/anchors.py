"""Topic anchors of queries: the subject that hits must be about. Run over distinct queries, of which there are few."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marram import rules

WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")
QUOTED = re.compile(r'"([^"\r\n]{2,160})"')
# --- fixed values: words that join an anchor, and words that are none ---
CONNECTORS = ("and", "of", "the", "vs", "versus")
#: Figures, capitals inside a word, or capitals alone: a word like no other.
IDENTIFIER = re.compile(r"\d|[a-z][A-Z]|[A-Z][a-z].*[A-Z]|^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$")
RUN = re.compile("[inIN](?:c?[inIN])*")
EXCLUDED = frozenset((*rules.STOP_WORDS, *rules.GENERIC_INTENT_TERMS, "current", "latest", "new", "recent", "today", "tonight", "use", "using", "read", "explain", "show", "help"))


def _letters(word: str) -> str:
    return re.sub(r"[\W_]+", "", word)


def _count(words: list[str]) -> int:
    """Distinct tokens that count."""
    low = {w.casefold().strip("-.") for x in words for w in WORD.findall(x)}
    return sum((len(w) >= 2 or w.isdigit()) and w not in rules.STOP_WORDS for w in low)


def _kinds(words: list[str]) -> str:
    """A letter for each word: i an identifier, n a name (I and N if it could also connect), c a connector, f a capitalised
    first word, and a dot for any other.

    A first word is capitalised anyway; it is a name where one follows, words that could connect aside.
    """

    def kind(at: int, word: str) -> str:
        low = word.casefold()
        if low in EXCLUDED:
            return "c" if low in CONNECTORS else "."
        if IDENTIFIER.search(word):
            return "I" if low in CONNECTORS else "i"
        if word[0].isupper() and word[1:].islower():
            return ("N" if low in CONNECTORS else "n") if at else "f"
        return "c" if low in CONNECTORS else "."

    return re.sub("^f(?=[cIN]*[in])", "n", "".join(kind(i, w) for i, w in enumerate(words)))


def anchor_of(query: str | None) -> str | None:
    """The first quoted phrase; else the earliest run of names or identifiers of two tokens; else the first lone identifier."""
    quoted = (" ".join(phrase.split()) for phrase in QUOTED.findall(query or "") if len(_letters(phrase)) >= 2)
    words = WORD.findall(query or "")
    kinds = _kinds(words)
    runs = (RUN.match(kinds, m.start()).span() for m in re.finditer("[inIN]", kinds))
    said = ([w.casefold() if k == "c" else w for w, k in zip(words[a:z], kinds[a:z], strict=True)] for a, z in runs)
    long = (" ".join(run) for run in said if _count(run) >= 2)
    lone = (w for w, k in zip(words, kinds, strict=True) if k in "iI")
    return next((found for ways in (quoted, long, lone) for found in ways), None)


def _is_quoted(query: str, anchor: str) -> bool:
    return any(anchor.casefold() == p.casefold() for p in QUOTED.findall(query))


def strict_anchor(query: str | None, anchor: str | None) -> bool:
    """Whether an anchor is precise enough to require."""
    if not anchor:
        return False
    terms = WORD.findall(anchor)
    if _is_quoted(query or "", anchor):
        return True
    if len(terms) != 1:
        return any(re.search(r"\d", t) for t in terms)
    term, size = terms[0], len(_letters(terms[0]))
    if re.search(r"\d", term):
        return size >= 4
    if re.search("[a-z][A-Z]", term) and not re.search("[-.]", term):
        return size >= 6
    return term.isupper() and size >= 4


def anchored(query: str | None, anchor: str | None) -> str | None:
    """The query with its anchor in quotes, once."""
    if not anchor or _is_quoted(query or "", anchor):
        return query if anchor else None
    return re.sub(re.escape(anchor), lambda m: f'"{anchor}"', query or "", count=1, flags=re.I)


def anchor_pattern(anchor: str | None) -> str | None:
    """A Java pattern for the anchor's parts in compact or spaced spelling, as whole words."""
    parts = [p for w in WORD.findall(anchor or "") for p in re.findall(r"[A-Z]+(?=[A-Z][a-z]|\d|$)|[A-Z]?[a-z]+|\d+", w)][:32]
    return r"(?iU)(?<!\w)" + r"[\W_]{0,16}".join(rf"\Q{p}\E" for p in parts) + r"(?!\w)" if parts else None


def _facts(queries: pd.Series) -> pd.DataFrame:
    rows = []
    for q in queries:
        squeezed = " ".join((q or "").split())
        a = anchor_of(squeezed)
        soft = any((t.isupper() and len(_letters(t)) <= 3) or re.search("[-.]", t) or (re.search(r"\d", t) and len(_letters(t)) < 4) for t in WORD.findall(a or ""))
        rows.append((a, strict_anchor(squeezed, a), anchored(squeezed, a), anchor_pattern(a), bool(soft)))
    return pd.DataFrame(rows, columns=["anchor", "strict", "anchored", "pattern", "soft"])


def anchor_facts(query: Column) -> Column:
    """Struct of anchor, strict, anchored, pattern and soft."""
    return F.pandas_udf(_facts, "struct<anchor:string,strict:boolean,anchored:string,pattern:string,soft:boolean>")(query)
