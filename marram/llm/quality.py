"""Quality rules: base counts, then divergence of a document's histograms from those of its language. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.llm.common import SPACE, fresh, skew_join, written

WORD = f"[^{SPACE}]+"
SYMBOLS = "[#*$%&|<>]"
#: The classes of the character histogram by the characters that they hold; everything else, letters without case and
#: lower-case letters above all, is the last class.
CLASSES = {"upper": r"\p{Lu}", "digit": "0-9", "space": SPACE, "stop": r".,;:!?'\"()\-", "symbol": r"#*$%&|<>@\\^_`{}~+=/\[\]"}
#: Words with at least this share of a language's words are its common words, so there are 1/COMMON_SHARE at most.
COMMON_SHARE = 0.01
#: A language's histograms have so many characters and words of all documents' mixed in, so rare ones lean on these.
PRIOR_CHARS, PRIOR_WORDS = 2_000, 400
#: References of so many languages at most are broadcast, of 1/COMMON_SHARE words each; beyond that rows are joined to them.
MOST_BROADCAST = 1000
#: Repeated windows of a text that are looked up in a list; more are found by sorting.
MOST_LISTED = 16
#: Under these lengths a histogram says little and isn't judged.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: Largest Jensen-Shannon distance (base 2, from 0 to 1) to the reference that is kept.
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.28, 0.4
BASE_LEAST_WORDS, BASE_MOST_REPEATED = 50, 50


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Words of a text: white space becomes blanks, and a split at one literal blank is cheaper than one at a class."""
    plain = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def count_of(text: Column, chars: str) -> Column:
    """Characters of text in the class body chars: what is left when runs of others are deleted."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def class_counts(text: Column) -> Column:
    """Struct of n_chars, the classes and SYMBOLS of a whole text. Classes other than white space have no letter a to z and
    no blank, so they are counted in what is left without these."""
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    few = F.regexp_replace(text, "[a-z ]+", "")
    return let(few, lambda x: F.struct(
        F.length(text).cast("long").alias("n_chars"),
        count_of(x, SYMBOLS[1:-1]).alias("n_symbols"),
        *[(count_of(x, body) + (blanks if name == "space" else 0)).cast("long").alias(name) for name, body in CLASSES.items()],
    ))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that come twice or more, the first one included.

    Windows are compared by a 64-bit hash. A few repeated windows are looked up in a short list; many are found by sorting.
    """

    def spread(at: Column) -> Column:
        """Words under windows that start at these sorted positions."""
        n = F.size(at)
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda acc, k: acc + F.coalesce(F.least(F.lit(3), F.get(at, k + 1) - F.get(at, k)), F.lit(3)))

    def by_list(h: Column, twice: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(twice, F.get(h, i)))

    def by_sort(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: F.sort_array(F.transform(F.filter(F.transform(p, lambda x, k: F.struct((x["h"].eqNullSafe(F.get(p, k - 1)["h"]) | x["h"].eqNullSafe(F.get(p, k + 1)["h"])).alias("again"), x["i"].alias("i"))), lambda x: x["again"]), lambda x: x["i"])))

    def repeats(h: Column) -> Column:
        again = let(F.sort_array(h), lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x == y, x)))
        some = F.array_compact(F.array_distinct(again))
        return let(some, lambda t: F.when(F.size(t) <= MOST_LISTED, let(by_list(h, t), spread)).otherwise(let(by_sort(h), spread)))

    def from_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeats(h))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(hashes, from_hashes))


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the character classes of a whole text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return let(out, lambda o: let(class_counts(t), lambda c: F.struct(
        o["n_words"].alias("n_words"),
        (c["n_chars"] - c["space"]).alias("word_chars"),
        c["n_symbols"].alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        o["n_repeat_words"].alias("n_repeat_words"),
        c["n_chars"].alias("n_chars"),
        *[c[name].alias(name) for name in CLASSES],
    )))


def distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts of the same size; null if one has no counts."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def of(p: Column, q: Column, np: Column, nq: Column) -> Column:
        both = F.zip_with(p, q, lambda a, b: F.struct((a / np).alias("a"), (b / nq).alias("b")))
        both = F.transform(both, lambda x: term(x["a"], (x["a"] + x["b"]) / 2) + term(x["b"], (x["a"] + x["b"]) / 2))
        return F.sqrt(F.greatest(F.lit(0.0), total(both) / 2))

    ready = lambda p, q, np, nq: F.when((np > 0) & (nq > 0), of(p, q, np, nq))
    return let(left, lambda p: let(right, lambda q: let(total(p), lambda np: let(total(q), lambda nq: ready(p, q, np, nq)))))


def common_hist(words: Column, common: Column) -> Column:
    """How often each common word comes in words, and last all other words, as doubles."""

    def of(w: Column) -> Column:
        hits = let(F.filter(w, lambda x: F.array_contains(common, x)), lambda h: F.transform(common, lambda c: F.size(F.filter(h, lambda x: x == c)).cast("double")))
        return let(hits, lambda h: F.concat(h, F.array(F.size(w) - F.aggregate(h, F.lit(0.0), lambda a, x: a + x))))

    return let(words, of)


def class_hist(counts: Column) -> Column:
    """The character classes, and last all other characters, as doubles."""
    held = [counts[name].cast("double") for name in CLASSES]
    rest = counts["n_chars"].cast("double")
    for x in held:
        rest = rest - x
    return F.array(*held, rest)


def lower_words(text: Column) -> Column:
    return words_of(F.lower(text))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(ref_lang, ref): one row a language, and one of null for all documents together; ref has chars, words, counts.

    Counts are over all documents: character classes, and words in lower case. A language's are shrunk: PRIOR_CHARS and
    PRIOR_WORDS of all documents' shares are added. Common words are those with at least COMMON_SHARE of the words then, by
    descending count; last come all other words.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    sums = docs.select(lang.alias("lang"), class_counts(t).alias("c")).select("lang", "c.*").groupBy("lang").agg(*[F.sum(c).alias(c) for c in ["n_chars", *CLASSES]])
    words = docs.select(lang.alias("lang"), F.explode(lower_words(t)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = written(words, "words")
    sums = written(sums, "classes")
    every = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["n_chars", *CLASSES]]).first()
    shares = [(x or 0) / (every["n_chars"] or 1) for x in (*[every[c] for c in CLASSES], every["n_chars"] - sum(every[c] for c in CLASSES))]

    # a word that is common in the mixture is common in the language or in all documents; counts of these words alone go on
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    n_words = totals.agg(F.sum("total").alias("n")).first()["n"] or 0
    common = words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_SHARE * n_words)
    common = written(common.select(F.lit(None).cast("string").alias("lang"), "word", F.col("n").cast("double").alias("n"), F.lit(float(n_words)).alias("total")), "common")
    held = words.join(totals, "lang").where((F.col("lang") != "") & (F.col("n") >= COMMON_SHARE * F.col("total"))).select("lang", "word")
    held = written(held.unionByName(totals.where("lang <> ''").select("lang").crossJoin(F.broadcast(common.select("word")))).distinct(), "held")  # 1/COMMON_SHARE words
    few = written(words.join(held.select("word").distinct(), "word", "left_semi"), "few-words")
    share = few.groupBy("word").agg((F.sum("n") / F.lit(float(n_words or 1))).alias("share"))
    own = held.join(few, ["lang", "word"], "left").join(share, "word").join(totals, "lang")
    own = own.select("lang", "word", (F.coalesce("n", F.lit(0)) + PRIOR_WORDS * F.col("share")).alias("n"), (F.col("total") + PRIOR_WORDS).cast("double").alias("total")).where(F.col("n") >= COMMON_SHARE * F.col("total"))
    listed = own.unionByName(common).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("c"), F.first("total").alias("total"))
    counts = F.transform("c", lambda x: -x["n"])
    rest = F.col("total") - F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    listed = listed.select(F.col("lang").alias("at"), F.transform("c", lambda x: x["word"]).alias("words"), F.concat(counts, F.array(rest)).alias("counts"))
    mixed = F.transform(class_hist(F.struct(*[F.col(c) for c in ["n_chars", *CLASSES]])), lambda x, i: x + PRIOR_CHARS * F.get(F.array(*map(F.lit, shares)), i))
    chars = sums.where("lang <> ''").select("lang", mixed.alias("chars"))
    chars = chars.unionByName(docs.sparkSession.createDataFrame([(None, [float(x) for x in shares])], "lang string, chars array<double>"))
    out = chars.join(listed, chars["lang"].eqNullSafe(F.col("at")), "left")
    return out.select(F.col("lang").alias("ref_lang"), F.struct("chars", F.coalesce("words", F.array().cast("array<string>")).alias("words"), F.coalesce("counts", F.array(F.lit(0.0))).alias("counts")).alias("ref"))


def quality_verdicts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_char_distance: float = MOST_CHAR_DISTANCE, most_word_distance: float = MOST_WORD_DISTANCE) -> DataFrame:
    """docs with one more column, quality: a struct of the counts, base_failed, the distances and kept.

    A document fails the base rules with fewer than 50 words or with over half its words in repeated windows. Otherwise it
    stays unless the Jensen-Shannon distance of its character classes (from LEAST_CHARS characters on) or of its common
    words (from LEAST_WORDS words on) to its language's reference is over the limit; a distance that can't be told doesn't
    count against it. A null text is empty; a document without a language, or with the language "", is held against all
    documents together. Repeated rows each count and get their verdict. The rows aren't shuffled where there are at most
    MOST_BROADCAST languages; beyond that those of rare languages are, with the same result.
    """
    ref, lang, out = fresh(docs, "_ref", "_lang", "quality")
    refs = written(references(docs, text_col, lang_col).coalesce(1), "references")
    own = refs.where("ref_lang is not null").select(F.col("ref_lang").alias(lang), F.col("ref").alias(ref))
    every = refs.where("ref_lang is null").first()["ref"]
    spare = F.struct(
        F.array(*map(F.lit, every["chars"])).alias("chars"),
        F.array(*map(F.lit, every["words"])).cast("array<string>").alias("words"),
        F.array(*map(F.lit, every["counts"])).alias("counts"),
    )

    def verdict(c: Column, d: Column) -> Column:
        failed = (c["n_words"] < BASE_LEAST_WORDS) | (100 * c["n_repeat_words"] > BASE_MOST_REPEATED * c["n_words"])
        far = ((d["chars"] > most_char_distance) & (c["n_chars"] >= LEAST_CHARS)) | ((d["words"] > most_word_distance) & (c["n_words"] >= LEAST_WORDS))
        return let(failed, lambda f: F.struct(
            *[c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            f.alias("base_failed"), d["chars"].alias("char_distance"), d["words"].alias("word_distance"),
            (~f & ~F.coalesce(far, F.lit(False))).alias("kept"),
        ))

    def distances(c: Column, r: Column) -> Column:
        return F.struct(distance(class_hist(c), r["chars"]).alias("chars"), distance(common_hist(lower_words(F.col(text_col)), r["words"]), r["counts"]).alias("words"))

    # one expression that reads the text once for each count, so that a filter on it can't repeat them
    whole = let(base_counts(F.col(text_col)), lambda c: let(let(F.coalesce(F.col(ref), spare), lambda r: distances(c, r)), lambda d: verdict(c, d)))
    rows = docs.withColumn(lang, F.col(lang_col).cast("string"))
    rows = rows.join(F.broadcast(own), lang, "left") if own.count() <= MOST_BROADCAST else skew_join(rows, own, lang)
    return rows.withColumn(out, whole).drop(ref, lang)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that quality_verdicts rejects, with their columns as they are."""
    (out,) = fresh(docs, "quality")
    return quality_verdicts(docs, text_col, lang_col).where(F.col(f"`{out}`.kept")).drop(out)
