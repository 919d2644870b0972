import random

from marram.llm import wrapper


def page(k, extra=""):
    rng = random.Random(k)
    words = lambda n: " ".join(f"w{rng.randint(0, 999)}" for _ in range(n))
    lines = [words(8), *[words(rng.randint(10, 30)) for _ in range(rng.randint(1, 5))]]
    body = "".join(f"<p><b>{x}<br>" if rng.random() < 0.2 else f"<p>{x}\n &amp; more</p>" for x in lines[1:])
    want = [lines[0]]
    rng = random.Random(k)
    html = (
        f"<!DOCTYPE html><html><head><title>{lines[0]}</title><script>var t='</p><p>no';</script></head><body>"
        f"<header>Site {k}</header><nav><ul><li><a href=x>Home</a></li><li><a>{words(1)}</a></li></ul></nav><!-- no -->"
        f"<div class='ad'>{words(40)}</div><div id=main><article><h1>{lines[0]}</h1>{body}{extra}</article></div>"
        f"<section id='comments'><p>{words(60)}</p></section><form>Search</form><footer>&copy; {words(9)}</footer></body></html>"
    )
    for x in lines[1:]:
        want.append(f"{x} & more" if f"{x}\n &amp; more" in html else x)
    return html, "\n".join(want)


def test_articles_come_out_whole(spark):
    made = [page(k) for k in range(40)]
    rows = [(k, f"http://h{k % 3}.example.org/{k}", html) for k, (html, _) in enumerate(made)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://one.example.org/", "<p>Only &lt;this&gt;<p>and\tthat"), (103, "http://h0.example.org/q", "<div>other</div>")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(docs).collect()}
    for k, (_, want) in enumerate(made):
        assert got[k] == want
    assert got[100] == got[101] == "" and got[102] == "Only <this>\nand that" and got[103] == "other"
    clash = docs.withColumn("text", docs.page_id)
    assert wrapper.main_text(clash).count() == len(rows)


def whole(pages):
    made = [wrapper.wrapper_of(wrapper.page_tree(h)) for h in pages]
    for other in made[1:]:
        wrapper.join(made[0], other)
    return wrapper.marked(made[0])


def test_template_texts_go():
    """A notice that is the same on all pages of a host is template; a page alone can't tell."""
    pages = [page(k, extra="<div>Read the rules of this site</div>") for k in range(5)]
    found = whole([h for h, _ in pages])
    for html, want in pages:
        assert wrapper.main_text_of(html, found) == want
        assert wrapper.main_text_of(html, None) == want + "\nRead the rules of this site"


def unnamed(k):
    """No element has a name that tells: a long constant text, then the article, then a list of links."""
    rng = random.Random(k)
    words = lambda n: " ".join(f"w{rng.randint(0, 999)}" for _ in range(n))
    lines = [words(6), *[words(rng.randint(8, 14)) for _ in range(3)]]
    fixed = "".join(f"<p>This long text about the site and its owners is the same everywhere, part {i}.</p>" for i in range(9))
    return f"<body><div><h2>About us</h2>{fixed}</div><div><h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:]) + f"</div><div><ul><li><a>{words(30)}</a></ul></div></body>", "\n".join(lines)


def test_alignment_finds_the_article(spark):
    made = [unnamed(k) for k in range(12)]
    docs = spark.createDataFrame([(k, f"http://a.example.org/{k}", h) for k, (h, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(docs).collect()}
    for k, (html, want) in enumerate(made):
        assert got[k] == want
        assert wrapper.main_text_of(html, None) != want  # without the other pages the fixed text wins


def test_elements_are_told_apart_by_place():
    """The same bare elements before and after the article are other places than the article's; a page may lack some."""
    make = lambda a, b, c: a + f"<div><h1>{b}</h1><p>{b} {b} {b} {b} {b} {b}</p><p>{c}</p></div><div><p>{a} fixed</p></div>"
    pages = [make("<div>top</div>" * (k % 2), f"head {k} {k}", f"body text of page {k} " * 4) for k in range(8)]
    found = whole(pages)
    for k, html in enumerate(pages):
        h, body = f"head {k} {k}", f"body text of page {k} " * 4
        assert wrapper.main_text_of(html, found) == f"{h}\n{' '.join([h] * 6)}\n{body.strip()}"


def test_near_copies_lose_nothing(spark):
    shared = [f"paragraph {i} has some words that all editions share" for i in range(5)]
    make = lambda k: f"<html><body><nav>menu</nav><article><h1>A heading</h1><p>edition {k}</p><div>{''.join(f'<p>{x}</p>' for x in shared)}</div></article></body></html>"
    docs = spark.createDataFrame([(k, "http://a.org/", make(k // 2)) for k in range(8)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(docs).collect()}
    assert got == {k: "\n".join(["A heading", f"edition {k // 2}", *shared]) for k in range(8)}


def test_any_depth_and_length(spark):
    deep = "<div>" * 100_000 + "x" + "</p>" * 1000
    table = "<article>" + "<h2>head</h2><p>words of it</p><ul><li>one<li>two</ul><blockquote>said</blockquote><p>more</p>" * 5000 + "</article>"
    odd = "<div><p>a</div><div><ul><li>b</ul></div>" * 3000
    docs = spark.createDataFrame([(1, "http://a.org/", deep), (2, "http://b.org/", table), (3, "http://b.org/", table), (4, "http://c.org/", odd), (5, "http://c.org/", "<!-- " + "<" * 100_000), (6, "http://c.org/", "&lt;" * 50_000)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(docs).collect()}
    assert got[1] == "x" and got[2] == got[3] == "\n".join(["head", "words of it", "one", "two", "said", "more"] * 5000)
    assert len(got[6]) == 50_000


def test_partitions_play_no_part(spark):
    rows = [(k, "http://h.example.org/", (page(k)[0] if k % 3 else unnamed(k)[0]).replace("<h1>", "<h1 class=a>" if k % 5 else "<h1>")) for k in range(60)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = sorted(map(tuple, wrapper.wrappers(docs.repartition(1)).collect()))
    assert first == sorted(map(tuple, wrapper.wrappers(docs.orderBy(docs.page_id.desc()).repartition(7)).collect()))


def test_joined_wrappers_give_the_same_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"http://h{k % 4}.example.org/", page(k)[0]) for k in range(20)] + [(90, None, None)], "page_id long, url string, html string")
    want = sorted(map(tuple, wrapper.main_text(docs).collect()), key=str)
    monkeypatch.setattr(wrapper, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, wrapper.main_text(docs).collect()), key=str) == want


def test_expression_has_options_and_repeats():
    a, b = (wrapper.wrapper_of(wrapper.page_tree(h)) for h in ("<ul><li>a<li>b</ul><p>x", "<ul><li>c</ul><h2>t</h2><p>x"))
    assert wrapper.expression(wrapper.join(a, b)) == "<ul>(<li>#TEXT</>)+</>(<h2>#CONSTANT</>)?<p>#CONSTANT</>"


def test_empty_table(spark):
    assert wrapper.main_text(spark.createDataFrame([], "url string, html string")).count() == 0
