"""Personal data: spans of fixed forms, and bootstrapped contextual extraction of more. DataFrame functions only.

The fixed forms are the seeds, and keys in hexadecimal figures for secrets, a kind that has no fixed form of its own. The
words around a value are its lexical patterns; values and patterns make a bipartite graph. A pattern is believed for a kind
as far as its values are, a value as far as its patterns are. Each round scores both: values that became sure induce new
patterns in the next. Patterns that end up sure mark values in forms that the seeds don't have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.llm.common import fresh, skew_join, written

KINDS = ("email", "ip", "card", "phone")
#: The fixed forms. They find what the plain patterns in the comments find, without backtracking over long runs.
FORMS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Seeds of the kinds that the method alone finds.
SEED_FORMS = {"secret": r"^[0-9a-f]{40}$"}
ALL_KINDS = (*KINDS, *SEED_FORMS)
#: Characters that every match of a form has; texts without them aren't searched.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Marks before and after a value; a bracket around the first figures of several, (202) 555, belongs to the value.
FRONT, BACK = r"^(?:[\"'<\[{]|\((?![0-9]+\)[().\x20-]*[0-9]))+", r"[\"'.,;:!?)>\]}*%&$#]"
#: A value that may be an identifier, with marks after it: a run of figures with their separators, or a word with a figure
#: or an at sign.
CANDIDATE = rf"(?<!\S)(?:[\"'<\[{{(]*[(+]?[0-9][0-9().\x20-]{{4,60}}[0-9]{BACK}*+(?!\S)|\S*[0-9@]\S*)"
#: What a candidate must look like to be of a kind.
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4}$|^[0-9]{1,3}(?:[.,][0-9]{1,3}){3}$",
    "card": r"^(?:[^0-9]?[0-9]){12,19}[^0-9]?$",
    "phone": r"^(?:[^0-9]{0,2}[0-9]){7,15}[^0-9]?$",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/=_-]{16,}$",
}
#: Rounds of scoring; distinct sure values of a pattern; belief of a pattern and of a value to be taken.
ROUNDS, LEAST_SEEDS, SURE_PATTERN, SURE_VALUE = 3, 3, 0.8, 0.85
#: How much a value of a pattern counts against a kind whose shape it has, as long as nothing is known of it.
UNKNOWN = 0.25
#: Characters of context on either side.
CONTEXT = 64


def let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def scan(values: Column, op, zero: Column) -> Column:
    """Array of op over all values up to each: log2(n) passes, each of which joins a value with one twice as far back."""

    def step(acc: Column, j: Column) -> Column:
        far = F.pow(F.lit(2), j).cast("int")
        return F.zip_with(acc, F.concat(F.array_repeat(zero, far), F.slice(acc, F.lit(1), F.size(acc) - far)), op)

    passes = F.length(F.bin(F.size(values) - 1))
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(F.sequence(F.lit(0), passes - 1), values, step))


def matches(text: Column, form: str, needs: str | None = None) -> Column:
    """Array of structs s, e (code points, end exclusive), v, and the text beside it as l and r, of all matches in order.

    Split by the form gives what lies between the matches; running lengths give the positions.
    """
    empty = F.array().cast("array<struct<s:bigint,e:bigint,v:string,l:string,r:string>>")

    def placed(hits: Column, parts: Column) -> Column:
        lengths = F.zip_with(F.slice(parts, F.lit(1), F.size(hits)), hits, lambda p, h: (F.length(p) + F.length(h)).cast("long"))
        ends = scan(lengths, lambda x, y: x + y, F.lit(0).cast("long"))

        def one(e: Column, k: Column) -> Column:
            hit = F.get(hits, k)
            return F.struct((e - F.length(hit)).alias("s"), e.alias("e"), hit.alias("v"), F.right(F.get(parts, k), F.lit(CONTEXT)).alias("l"), F.left(F.get(parts, k + 1), F.lit(CONTEXT)).alias("r"))

        return let(ends, lambda every: F.transform(every, one))

    found = let(F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda h: F.when(F.size(h) == 0, empty).otherwise(let(F.split(text, form, -1), lambda p: placed(h, p))))
    return F.when(F.contains(text, F.lit(needs)), found).otherwise(empty) if needs else found


def luhn(figures: Column) -> Column:
    """Whether a string of figures passes the checksum."""
    one = F.transform(F.split(F.reverse(figures), ""), lambda x, i: let(x.cast("int") * (1 + i % 2), lambda y: F.when(y > 9, y - 9).otherwise(y)))
    return F.aggregate(one, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    figures = F.regexp_replace(v, "[^0-9]+", "")
    if kind == "ip":
        return v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(figures).between(13, 19) & luhn(figures)
    if kind == "phone":
        return F.length(figures).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of the spans of all kinds, by kind and start, with the kind and its number."""
    found = []
    for n, kind in enumerate(KINDS):
        good = F.filter(matches(text, FORMS[kind], NEEDS.get(kind)), lambda x: valid(kind, x["v"]))
        found.append(F.transform(good, lambda x: F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), x["l"].alias("l"), x["r"].alias("r"))))
    return F.concat(*found)


def candidate_spans(text: Column, base: Column) -> Column:
    """Array of candidates without the marks around them, none that overlaps a span of the base."""

    def trimmed(x: Column) -> Column:
        front = F.length(x["v"]) - F.length(F.regexp_replace(x["v"], FRONT, ""))
        v = F.regexp_replace(F.regexp_replace(x["v"], FRONT, ""), BACK + "+$", "")
        return F.struct((x["s"] + front).alias("s"), (x["s"] + front + F.length(v)).cast("long").alias("e"), v.alias("v"), x["l"].alias("l"), x["r"].alias("r"))

    fits = lambda x: _any([x["v"].rlike(form) for form in SHAPES.values()])
    return apart(F.filter(F.transform(matches(text, CANDIDATE), trimmed), fits), base)


def apart(spans: Column, base: Column) -> Column:
    """Those of spans that overlap none of base. Starts of the base and ends of spans are sorted together: a span overlaps
    if the farthest end of the base that starts before its end is beyond its start."""

    def clear(events: Column) -> Column:
        reach = scan(F.transform(events, lambda x: x["e"]), lambda x, y: F.greatest(x, y), F.lit(0).cast("long"))
        free = F.zip_with(events, reach, lambda x, e: F.when(x["x"].isNotNull() & (e <= x["x"]["s"]), x["x"]))
        return F.array_sort(F.array_compact(free))

    own = F.transform(spans, lambda x: F.struct(x["e"].alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("e"), x.alias("x")))
    none = F.lit(None).cast("struct<s:bigint,e:bigint,v:string,l:string,r:string>")
    others = F.transform(base, lambda y: F.struct(y["s"].alias("at"), F.lit(1).alias("kind"), y["e"].alias("e"), none.alias("x")))
    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(let(F.array_sort(F.concat(own, others)), clear))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def patterns(x: Column) -> Column:
    """Array of the lexical patterns of a span: the words before it, and the words on both sides."""
    left = F.filter(F.split(F.lower(x["l"]), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    right = F.filter(F.split(F.lower(x["r"]), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    near = lambda a, k: F.coalesce(F.try_element_at(a, F.lit(k)), F.lit(""))
    return F.array(
        F.concat_ws(" ", F.lit("<"), near(left, -2), near(left, -1)),
        F.concat_ws(" ", F.lit("="), near(left, -1), F.lit("_"), near(right, 1)),
    )


def scored(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, a belief for each kind) and (v, a belief for each kind) after the rounds.

    edges is (pattern, v), distinct, seeds (v, kind), distinct. Seeds are believed. The belief in a pattern for a kind is the
    mean belief of its values, with one value more that isn't of the kind, where values that nothing is known of and that
    have the kind's shape count UNKNOWN; it is none with fewer than LEAST_SEEDS sure values. The belief in a value joins its
    patterns' by noisy-or, for kinds whose shape it has.
    """
    wide = [F.max(F.when(F.col("kind") == k, 1.0).otherwise(0.0)).alias(k) for k in ALL_KINDS]
    fixed = written(seeds.groupBy("v").agg(*wide), "seeds")
    values, sure = fixed, None
    for _ in range(rounds):
        held = skew_join(edges, values, "v")
        counts = lambda k: F.when(F.col(k).isNull() & F.col("v").rlike(SHAPES[k]), UNKNOWN).otherwise(1.0)
        belief = lambda k: F.when(F.sum(F.when(F.col(k) >= SURE_VALUE, 1).otherwise(0)) >= LEAST_SEEDS, F.sum(F.coalesce(k, F.lit(0.0))) / (F.sum(counts(k)) + 1)).otherwise(0.0).alias(k)
        sure = held.groupBy("pattern").agg(*map(belief, ALL_KINDS))
        sure = written(sure.where(_any([F.col(k) > 0 for k in ALL_KINDS])), "sure")
        # a pattern's belief is bounded away from 1, so the logarithm is finite
        one = [(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col(k), F.lit(1e-9)))))).alias(k) for k in ALL_KINDS]
        found = skew_join(edges, sure, "pattern", "inner").groupBy("v").agg(*one)
        found = found.select("v", *[F.when(F.col("v").rlike(SHAPES[k]), F.col(k)).otherwise(0.0).alias(k) for k in ALL_KINDS])
        values = written(fixed.unionByName(found.join(fixed.select("v"), "v", "left_anti")), "values")
    return sure, values


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: (id_col, base, added): arrays of structs n, kind, s, e, v, by kind, then start.

    base has the spans of the fixed forms, added those that sure patterns mark, of any kind of ALL_KINDS; they don't overlap
    the base. A null text is empty and has none. Ids may repeat or be null: rows are kept apart. Other columns of docs play
    no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    spans = rows.withColumn("base", base_spans(F.col("text"))).withColumn("more", candidate_spans(F.col("text"), F.col("base")))
    spans = written(spans.drop("text"), "spans")
    fixed = spans.select(F.explode("base").alias("x")).select(F.explode(patterns(F.col("x"))).alias("pattern"), F.lower("x.v").alias("v"), "x.kind")
    places = spans.select("row", F.explode("more").alias("x")).select("row", "x.s", "x.e", "x.v", F.explode(patterns(F.col("x"))).alias("pattern"))
    places = written(places, "places")
    lower = F.lower("v").alias("v")
    edges = written(fixed.select("pattern", "v").unionByName(places.select("pattern", lower)).distinct(), "all-edges")
    # a pattern of fewer values can't come to have enough sure ones
    known = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEDS).select("pattern", F.lit(True).alias("known"))
    known = written(known, "known")
    edges = written(skew_join(edges, known, "pattern", "inner").select("pattern", "v"), "edges")
    places = written(skew_join(places, known, "pattern", "inner").drop("known"), "known-places")
    seeds = fixed.select("v", "kind")
    for kind, form in SEED_FORMS.items():
        seeds = seeds.unionByName(places.where(F.col("v").rlike(form)).select(lower, F.lit(kind).alias("kind")))
    sure, values = scored(edges, seeds.distinct(), rounds)
    most = lambda: F.greatest(*[F.struct(F.col(k).alias("belief"), F.lit(-n).alias("n"), F.lit(k).alias("kind")) for n, k in enumerate(ALL_KINDS)])
    good = written(values.select(F.col("v").alias("low"), most().alias("m")).where(F.col("m.belief") >= SURE_VALUE).select("low", F.col("m.kind").alias("kind")), "good-values")
    strong = written(sure.where(_any([F.col(k) >= SURE_PATTERN for k in ALL_KINDS])).select("pattern", F.array_compact(F.array(*[F.when(F.col(k) >= SURE_PATTERN, F.lit(k)) for k in ALL_KINDS])).alias("kinds")), "strong")
    marked = skew_join(places.withColumn("low", F.lower("v")), good, "low", "inner")
    marked = skew_join(written(marked, "marked"), strong, "pattern", "inner").where(F.array_contains("kinds", F.col("kind")))
    number = F.create_map(*[F.lit(x) for n, k in enumerate(ALL_KINDS) for x in (k, n)])
    marked = marked.select("row", F.struct(number[F.col("kind")].alias("n"), "kind", "s", "e", "v").alias("x")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("added"))
    plain = F.transform("base", lambda x: F.struct(x["n"].alias("n"), x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))
    out = spans.select("row", "id", plain.alias("base")).join(marked, "row", "left")
    return out.select(F.col("id").alias(id_col), "base", F.coalesce("added", F.filter("base", lambda x: F.lit(False))).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span in the text replaced by its kind in angle brackets; a null text stays null.

    Of spans that overlap the first counts, and what the others add at its end goes too. Rows find their spans by the digest
    of the text, so ids play no part.
    """
    key, spans, own = fresh(docs, "_key", "_spans", "_own")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    both = F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    texts = docs.select(digest.alias(key), F.col(text_col).alias("text")).dropDuplicates([key])
    found = personal_data(texts, key, "text").where(F.size("base") + F.size("added") > 0).select(key, F.array_sort(both).alias(spans))

    def replaced(x: Column, reach: Column) -> Column:
        before = F.coalesce(F.get(reach, x["i"] - 1), F.lit(0).cast("long"))
        gap = F.substring(F.col(text_col), (before + 1).cast("int"), (x["x"]["s"] - before).cast("int"))
        return F.when(x["x"]["s"] < before, "").otherwise(F.concat(gap, F.lit("<"), x["x"]["kind"], F.lit(">")))

    reach = scan(F.transform(spans, lambda x: x["e"]), lambda x, y: F.greatest(x, y), F.lit(0).cast("long"))
    numbered = F.transform(spans, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    text = let(reach, lambda r: F.concat(F.array_join(F.transform(numbered, lambda x: replaced(x, r)), ""), F.substring(F.col(text_col), (F.element_at(r, -1) + 1).cast("int"), F.length(text_col))))
    rows = skew_join(written(docs.withColumn(own, digest), "masking"), written(found.withColumnRenamed(key, own), "found"), own)
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, text).otherwise(F.col(text_col))).drop(own, spans)
