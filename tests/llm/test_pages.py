"""Main text of pages."""

from tesserae.llm import sitetree


def test_blocks_and_noise():
    page = "<html><head><title>t</title><style>x</style></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>Head &amp;  line</h1><p>One<br>two <b>three</b><p>Four &lt;x&gt;<script>var a='</p>'</script></p><ul><li>i<li>j</ul></article><div class=comments>c</div><footer>f</footer></body></html>"
    assert sitetree.main_text(page, frozenset()) == "Head & line\nOne two three\nFour <x>\ni\nj"


def test_bad_markup():
    for page, want in (("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<div>a</span>b</div>", "ab"), ("a</p>b", "a\nb"), ("a<!-- x", "a"), ("&#65;&nosuch;&amp", "A&nosuch;&"), ("<p>x < y</p>", "x < y")):
        assert sitetree.main_text(page, frozenset()) == want, page


def test_tree_removes_what_a_host_repeats(spark):
    page = lambda i: f"<html><body><div class='t{''}'>Our shop since 1990</div><div class='b'><p>Story {i} with its own words {i * 7}</p></div><div class='z'>All rights reserved</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i), "x") for i in range(20)] + [(50, None, None, "x"), (51, "bad", "", "x"), (52, "http://other/1", page(1), "x"), (0, "http://h.example/0", page(0), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in sitetree.op6(df).collect()}
    assert all(got[i]["text"] == f"Story {i} with its own words {i * 7}" for i in range(20))
    assert got[50]["text"] == "" and got[51]["n_chars"] == 0 and got[52]["text"].count("\n") == 2
    assert sitetree.op6(df).count() == len(rows) and sitetree.op6(df.limit(0)).count() == 0
    tree = {round(r["content"], 6) for r in sitetree.style_tree(df.where("page_id < 20")).where("content is not null").collect()}
    assert tree == {0.0, 1.0}


def test_an_article_is_not_all(spark):
    """A story outside the one article element stays; so does a section whose id only holds a word of the list."""
    page = "<body><div class='story'><h1>Story</h1><p>Long text of the story.</p></div><article><p>Teaser.</p></article><section id='side-effects'><p>Effects.</p></section><div id='sidebar'>x</div><div class='post-comments'>y</div><div class='ad-slot'>z</div></body>"
    assert sitetree.main_text(page) == "Story\nLong text of the story.\nTeaser.\nEffects."


def brute(pages, importance=0.4, base=64, decay=0.9):
    """The style tree of one host by plain loops: composite importance by path."""
    import math
    from collections import defaultdict

    read = [sitetree.Page(p) for p in sorted(set(pages))]
    held, styles, texts, parent = defaultdict(set), defaultdict(list), defaultdict(lambda: defaultdict(set)), {}
    for n, p in enumerate(read):
        for path, (up, _, seen) in p.styles.items():
            held[path].add(n)
            styles[path] += list(seen)
            parent[path] = up
        for path, _, t, _ in p.blocks:
            texts[path][t].add(n)
    nodes = [p for p in held if len(held[p]) >= 8]
    kids = {p: [c for c in nodes if c != p and parent[c] == p] for p in nodes}

    def composite(p):
        m = len(held[p])
        b = math.log(min(m, base))
        counts = [styles[p].count(x) for x in set(styles[p])]
        shown = min(1.0, -sum(c / len(styles[p]) * math.log(c / len(styles[p])) for c in counts) / b)
        parts = [composite(c) for c in kids[p]]
        if p in texts:
            parts.append(1 - sum(max(0.0, 1 + math.log(len(x) / m) / b) for x in texts[p].values()) / len(texts[p]))
        mean = sum(parts) / len(parts) if parts else 0.0
        own = decay ** len(counts) if kids[p] else 1.0
        return (1 - own) * shown + own * mean

    return {p: composite(p) for p in nodes}


def test_tree_against_brute_force(spark):
    import random

    rng = random.Random(5)
    heads = ["Method", "Results", "Notes"]

    def page(i):
        body = "".join(f"<h2>{rng.choice(heads)}</h2>" + "".join(f"<p>words {rng.random()}</p>" for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 4)))
        box = f"<div class='box'><p>Offer {rng.randint(0, 2)}</p><ul><li>one</li><li>two</li></ul></div>" if rng.random() < 0.9 else ""
        return f"<body><div class='top'>Welcome to us</div>{box}<div class='text'><h1>Title {i}</h1>{body}</div></body>"

    pages = [page(i) for i in range(60)]
    rows = [(i, "https://a.example/x", p) for i, p in enumerate(pages + pages[:5])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["path"]: r for r in sitetree.style_tree(df).collect()}
    want = brute(pages)
    assert set(got) == set(want) and all(abs(got[p]["composite"] - want[p]) < 1e-9 for p in want)
    texts = {r["page_id"]: r["text"] for r in sitetree.op6(df).collect()}
    for i, p in enumerate(pages):
        kept = [t for _, _, t, _ in sitetree.Page(p).blocks if t.startswith(("Title", "words")) or t in heads]
        assert texts[i] == "\n".join(kept)


def test_verdicts_do_not_depend_on_the_number_of_pages(spark):
    """Fifty headings, each on a fiftieth of the pages, stay on a host of 200 pages and of 1000; repeated ids and null ids keep their rows."""
    for n in (200, 1000):
        rows = [(None if i == 3 else i // 2, "http://h.example/a", f"<body><div class='a'><h2 class='k'>Heading {i % 50}</h2><p>text {i}</p></div><div class='b'>Slogan {i % 3}</div></body>") for i in range(n)]
        got = sitetree.op6(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert len(got) == n and all(r["text"].startswith("Heading ") and "Slogan" not in r["text"] for r in got)


def test_a_very_long_page(spark):
    text = "word " * 400_000
    df = spark.createDataFrame([(1, "http://l.example/", f"<p>{text}</p>" + "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    assert sitetree.op6(df).first()["n_chars"] == len(text.strip()) + 5


def test_verdicts_do_not_depend_on_how_many_pages_a_host_has(spark):
    """A line that two pages have goes, whether the host has 900 pages or 2500."""
    page = lambda i: "<body>" + ("<div class='z'>Of both</div>" if i < 2 else "") + f"<div class='b'><p>Story {i} in its words {i * 7}</p></div></body>"
    for n in (900, 2500):
        df = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(n)], "page_id long, url string, html string")
        got = {r["page_id"]: r["text"] for r in sitetree.extract(df, min_pages=2).where("page_id < 3").collect()}
        assert got == {i: f"Story {i} in its words {i * 7}" for i in range(3)}, n
