import random
import re

from pyspark.sql import functions as F

from marram.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, v):
    d = re.sub(r"[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        t = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in t) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, r in PLAIN.items() for m in re.finditer(r, text or "") if good(k, m[0])]


def texts():
    rng = random.Random(5)
    parts = ["a@b.c", "+1 (202) 555-0147", "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "256.1.1.1", "é日😀", "+d@e.f", ".", "@", "+", "-", " ", "\n", "1", "9.9.9.9.9", "001.002.3.4", "x.y@", "5--5", "()"]
    out = ["", None, "1" * 30000, "a" * 30000, "1 " * 9000, "a@b" + ".c" * 9000, "1." * 9000]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(400)]


def test_base_equals_plain_patterns(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    rows = pii.personal_data(docs).select("doc_id", pii.listed(F.col("base")).alias("x")).collect()
    got = {r["doc_id"]: r["x"] for r in rows}
    assert got == {i: ",".join(brute(t)) for i, t in enumerate(texts())}


def test_contexts_find_unseen_forms(spark):
    seeds = [f"please call me at +1 (202) 555-01{i:02d} tonight" for i in range(20)]
    unseen = ["please call me at 555-867-5309 tonight", "please call me at 555.867.1111, thanks", "order 555-867-9999 shipped", ""]
    docs = spark.createDataFrame(list(enumerate(seeds + unseen)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["kind"], x["v"]) for x in r["added"]] for r in pii.personal_data(docs).collect() if r["added"]}
    assert got == {20: [("phone", "555-867-5309")], 21: [("phone", "555.867.1111")]}
    masks = {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()}
    assert masks[20] == "please call me at <phone> tonight" and masks[22] == unseen[2] and masks[0] == "please call me at <phone> tonight"


def test_no_rows_and_no_seeds(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spaced_numbers_before_marks(spark):
    seeds = [f"please call me at +1 (202) 555-01{i:02d} tonight" for i in range(20)]
    unseen = {
        "please call me at 555 867 5309 tonight": "555 867 5309",
        "please call me at 555 867 5310, thanks": "555 867 5310",
        "please call me at 555 867 5311.": "555 867 5311",
        "(please call me at 555 867 5312)": "555 867 5312",
        "please call me at 555 867 5313). Or not": "555 867 5313",
        "please call me at (202) 555 0147.": "(202) 555 0147",
        "please call me at (555 867 5314), thanks": "555 867 5314",
        'please call me at "555 867 5315", thanks': "555 867 5315",
        "please call me at (5558675316)": "5558675316",
    }
    docs = spark.createDataFrame(list(enumerate([*seeds, *unseen])), "doc_id long, text string")
    rows = {r["doc_id"]: r["added"] for r in pii.personal_data(docs).collect()}
    for i, (text, value) in enumerate(unseen.items(), len(seeds)):
        assert [(x["kind"], x["v"], text[x["s"] : x["e"]]) for x in rows[i]] == [("phone", value, value)]


def test_found_values_induce_patterns(spark):
    """Second generation: numbers found beside seeds are the only evidence for another context, which finds one more."""
    rows = [f"please call me at +1 (202) 555-01{i:02d} tonight" for i in range(20)]
    rows += [f"please call me at 555-867-53{i:02d} tonight" for i in range(6)]
    rows += [f"fax office line 555-867-53{i:02d} always" for i in range(6)] + ["fax office line 555.867.9999 always", "part number 555.867.7777 sold"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: [x["v"] for x in r["added"]] for r in pii.personal_data(docs).collect() if r["added"]}
    assert got == {20 + i: [f"555-867-53{i:02d}"] for i in range(6)} | {26 + i: [f"555-867-53{i:02d}"] for i in range(6)} | {32: ["555.867.9999"]}


def test_secrets_by_context(spark):
    """Keys of the seed's form give the context; keys of other forms in it are found, figures elsewhere aren't."""
    rng = random.Random(9)
    key = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    rows = [f'{w} token = "{key(40, "0123456789abcdef")}" and more' for w in "abcdefghijkl"]
    held_out = [f'w{i} Token = "{v}"###' for i, v in enumerate(["AKIA" + key(16, "0123456789ABCDEF") + "7", key(24, "xyzXYZ012_-") + "0a", key(40, "0123456789ABCDEF") + "a"])]
    clean = ["order 0123456789abcdef0 came", "page 12 of 300 in 1999", 'token = "none"']
    docs = spark.createDataFrame(list(enumerate(rows + held_out + clean)), "doc_id long, text string")
    out = pii.personal_data(docs).collect()
    got = {r["doc_id"] for r in out if any(x["kind"] == "secret" for x in r["added"])}
    assert got == set(range(15)) and not any(r["base"] for r in out)


def test_many_matches_take_linear_time(spark):
    """Ten times the matches take far less than a hundred times the time; spans are right at the end too."""
    import time

    took = []
    for n in (300, 3000):
        text = " ".join(f"user{i}@mail.example.com" for i in range(n)) + " 1.2.3.4"
        docs = spark.createDataFrame([(1, text), (1, text), (None, "é " + text)], "doc_id long, text string").withColumn("row", F.lit(0)).withColumn("base", F.lit("x"))
        pii.personal_data(docs).collect() if n == 300 else None
        began = time.perf_counter()
        rows = pii.personal_data(docs).collect()
        took.append(time.perf_counter() - began)
        assert len(rows) == 3 and all(len(r["base"]) == n + 1 for r in rows)
        last = [x for x in rows[0]["base"] if x["kind"] == "ip"][0]
        assert "1.2.3.4" == (text if rows[0]["doc_id"] == 1 else "é " + text)[last["s"] : last["e"]]
    assert took[1] < 30 * took[0]


def test_overlaps_and_scans(spark):
    rng = random.Random(11)
    span = lambda: (lambda s: (s, s + rng.randint(1, 9)))(rng.randint(0, 60))
    rows = [(k, [span() for _ in range(rng.randint(0, 6))], [span() for _ in range(rng.randint(0, 6))], [rng.randint(0, 9) for _ in range(k % 20)]) for k in range(200)]
    docs = spark.createDataFrame(rows, "k long, a array<struct<s:bigint,e:bigint>>, b array<struct<s:bigint,e:bigint>>, n array<bigint>")
    full = F.transform("a", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("v").alias("v"), F.lit("l").alias("l"), F.lit("r").alias("r")))
    out = docs.select("k", F.transform(pii.apart(full, F.col("b")), lambda x: F.struct(x["s"], x["e"])).alias("x"), pii.scan(F.col("n"), lambda x, y: x + y, F.lit(0).cast("long")).alias("n")).collect()
    for r in out:
        _, a, b, n = rows[r["k"]]
        assert sorted(map(tuple, r["x"])) == sorted((s, e) for s, e in a if not any(y < e and s < z for y, z in b))
        assert r["n"] == [sum(n[: i + 1]) for i in range(len(n))]
