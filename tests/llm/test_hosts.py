"""Main text by host paths on templates, broken markup and odd rows."""
import random

from lateline.llm import hosts

PARTS = ["First &amp; foremost,  a   paragraph\n of some length that says something.", "Second paragraph with a <a href='/x'>link</a> and <b>bold</b> text &lt;here&gt;.",
         "Third one, caf&eacute; &#233; &#x4e2d;, closing the article for good."]
PLAIN = ["First & foremost, a paragraph of some length that says something.", "Second paragraph with a link and bold text <here>.",
         "Third one, café é 中, closing the article for good."]


def page(kind, k):
    body = "".join(f"<p>{p}</p>" for p in PARTS)
    noise = ("<nav><ul><li><a href='/'>Home and more links</a></li></ul></nav><header><h1>Site name</h1></header><aside>Side text that is rather long here</aside>"
             "<div class='ad-box'>Buy this now, a long advert text, really</div><form>Name <input><button>Send</button></form>"
             "<script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>hidden</p> --><div class='cookie-notice'>We use cookies</div>")
    after = "<section class='comments'><p>A reader comment that is quite long, too long in fact to be ignored by length alone.</p></section><footer>&copy; Me</footer>"
    shell = {"article": f"<article>{body}</article>", "div": f"<div class='wrap'><div class='post post-{k}'>{body}</div></div>",
             "main": f"<main><div class='content'>{body}</div></main>"}[kind]
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{noise}{shell}{after}</body></html>"


def test_templates(spark):
    rows = [(i, f"http://{kind}.example.org/{i}", page(kind, i)) for i, kind in enumerate(["article", "div", "main"] * 4)]
    got = {r["page_id"]: r for r in hosts.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i, url, _ in rows:
        assert got[i]["text"] == "\n\n".join(PLAIN) and got[i]["n_chars"] == len("\n\n".join(PLAIN)) and got[i]["url"] == url
    paths = {r["host"]: r["path"] for r in hosts.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert paths["article.example.org"].endswith("/article") and paths["div.example.org"].endswith("/div.post.post-")


def test_broken_markup_and_odd_rows(spark):
    odd = {
        "<p><b>One<br>two<p>Three</b> four<p>five": "One two\n\nThree four\n\nfive",
        "plain text &amp; more": "plain text & more", "": "", None: "", "<div>": "", "<p>cut <b": "cut", "<p>a</p><script>never closed": "a",
        "<p title='>'>x</p></div></p>y": "x\n\ny", "<ul><li>one<li>two</ul>": "one\n\ntwo", "<p>a<!-- cut": "a", "<p>1 < 2 &bogus; &am</p>": "1 < 2 &bogus; &am",
        "<table><tr><td>c1<td>c2</table>": "c1\n\nc2",
    }
    rows = [(i, None if i % 2 else f"http://h{i}.example/", h, "clash") for i, h in enumerate(odd)]
    rows = [(i, f"http://h{i}.example/" if h else u, h, c) for i, u, h, c in rows]
    df = spark.createDataFrame(rows + [(None, "::bad", "<p>z</p>", "c"), (3, None, None, "c")], "page_id long, url string, html string, text string")
    got = hosts.extract(df).collect()
    by = {(r["page_id"], r["url"]): r["text"] for r in got}
    assert len(got) == len(rows) + 2 and by[None, "::bad"] == "z"
    for (i, url, h, _) in rows:
        assert by[i, url] == odd[h], h
    assert hosts.extract(df.limit(0)).collect() == []


def test_random_cuts_never_fail():
    rng = random.Random(2)
    whole = page("div", 1)
    for _ in range(300):
        s = "".join(rng.choice([whole[k:k + 40], "<", ">", "</p>", "<a ", "\"", "'", "<!--"]) for k in (rng.randrange(len(whole)) for _ in range(12)))
        pieces, containers = hosts.parse(s)
        assert isinstance(hosts.text_of(pieces, containers[0]), str)


def test_every_registered_page(spark, sf):
    from lateline.llm.queries import QUERIES

    got = QUERIES["op7_consensus_html"](spark, sf).collect()
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {r["page_id"] for r in got} == raw.keys()
    assert all(r["n_chars"] == len(r["text"]) and "©" not in r["text"] and "track(" not in r["text"] for r in got)


def test_names_of_what_an_element_has_are_no_noise():
    for c in ("content has-sidebar", "post no-comments", "main with-menu", "article hide-footer"):
        pieces, containers = hosts.parse(f"<body><div class='{c}'><p>Whole article here</p></div><div class='sidebar'>x</div></body>")
        assert [hosts.text_of(pieces, n) for n in containers if n.tag == "div"] == ["Whole article here"]


def test_broken_and_repetitive_markup_stays_linear():
    import time

    t = time.process_time()
    pieces, containers = hosts.parse("<div>x " * 100_000 + "</span>" * 1000)
    assert hosts.text_of(pieces, containers[0]).count("x") == 100_000 and max(len(c.path) for c in containers) < 1000
    pieces, containers = hosts.parse("<body>" + "<div class='row'>some text</div>" * 20_000)
    told = hosts.texts_of(pieces, [c for c in containers if c.tag == "div"])
    assert told == ["some text"] * 20_000 and time.process_time() - t < 30


def test_one_walk_equals_a_walk_per_element():
    import random

    rng = random.Random(4)
    for _ in range(60):
        page = "".join(rng.choice(["<div class=a>", "<div class=b>", "</div>", "<p>", "</p>", "<b>", "</b>", "word ", "x\n", "<br>", "<nav>", "</nav>", "&amp;"]) for _ in range(120))
        pieces, containers = hosts.parse(page)
        outer = [c for c in containers[1:] if c.parent is containers[0]]
        assert hosts.texts_of(pieces, outer) == [hosts.text_of(pieces, c) for c in outer]
        sizes = {id(c): sum(len(raw) - raw.count(" ") for node, raw, _ in pieces if not raw.isspace() and inside(node, c)) for c in containers}
        assert all(c.size == sizes[id(c)] for c in containers)


def inside(node, up):
    while node is not None and node is not up:
        node = node.parent
    return node is up
