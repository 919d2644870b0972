"""Queries on odd rows against their SQL, run by DuckDB."""

import random

import __spark_entry__ as entry
import pytest

duckdb = pytest.importorskip("duckdb")


def differences(spark, folder, table, name):
    """Rows of the query and of its SQL that the other doesn't have."""
    own = [tuple(r) for r in entry.queries()[name](spark, str(folder)).collect()]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
        other = con.execute(entry.oracle_sql()[name]).fetchall()
    order = lambda rows: sorted(rows, key=repr)
    own, other = order(own), order(other)
    return [x for x in own if x not in other], [x for x in other if x not in own], len(own) - len(other)


@pytest.mark.parametrize("name", ["mode_for", "categories", "temporal_requirement", "engines"])
def test_intents(spark, tmp_path, name):
    """Accents beside words, letters that are s, k or i in another case, and white space beyond ASCII."""
    texts = ["réserver", "élog", "api-é", "éapi", "apié", "_api", "best", "ſerver", "ſetup", "Kubernetes", "xſerver", "fİx", "fıx", "this week", "a b " * 6, "a　" * 12, "a\x0b" * 12, "a\x1c" * 12, "a\x85 " * 12, "a " * 12, "a\t\r\n\f b " * 5, None, "", " "]
    rng = random.Random(3)
    texts += ["".join(rng.choice(["api", "fix", "server", "best", "log", "latest", "stack trace", "x"]) + rng.choice([" ", "é", " ", "_", "ß", "\n", "1", "."]) for _ in range(rng.randint(1, 11))) for _ in range(200)]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert differences(spark, tmp_path, "conversations", name) == ([], [], 0)


def test_titles(spark, tmp_path):
    """Quotes, references that are cut or not among the four, several titles, other cases, white space, long and no titles."""
    titles = ["<title>a &quot;b&quot; &lt;i&gt; &amp;amp;</title>", "<title>x&&&amp</title>", "<title>&eacute; &#39;</title>", "<TITLE>x</TITLE>", "<title lang=en>x</title>", "<title>a</title><title>b</title>", "<title>\n a \t b\x0bc  </title>", "<title>" + "é " * 400 + "</title>", "<title>" + "a" * 499 + " b</title>", "<title> </title>", "<title>open", "<title>a<b>c</b></title>", "", None]
    titles += ["<title>a\U0001f600́" + "\U0001f468‍\U0001f469" * 300 + "</title>", "<script><title>s</title></script><title>t</title>"]
    spark.createDataFrame([(i, "https://a.example.com/", t) for i, t in enumerate(titles)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert differences(spark, tmp_path, "pages", "page_title") == ([], [], 0)
