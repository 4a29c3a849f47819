"""URL rules and page text, and the pipeline as a whole."""

from __future__ import annotations

import pytest

from conftest import SMALL


def judged(url):
    """The listed rule of a url by plain string work."""
    text = url or ""
    if "://" not in text:
        return "", "", None, None
    rest = text.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for verdict, suffix, start in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == suffix or host.endswith("." + suffix)) and path.startswith(start) and (best is None or len(suffix + start) > len(best[0])):
            best = suffix + start, verdict
    return host, path, *(best or (None, None))


ODD = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://net/", "http://net", "http://xnet/", "a://b://c.org/fr/", "http://É.Example.com/de/1", "http://example.com?/de/", "http://x.example.com/de", "http://m.org/fr/\nx"]


def test_url_rules(spark):
    from dispatchery.llm.urls import judge, labelled_pages

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*ODD, ODD[4]])], "page_id long, url string, tokens string")
    for df in (pages, odd):
        want = {(r.page_id, *judged(r.url)[:3]) for r in df.select("page_id", "url").collect()}
        got = judge(df, labelled_pages(pages, labels)).collect()
        assert {(r.page_id, r.host, r.path, r.rule) for r in got} == want and len(got) == df.count()
        rules = {r.page_id: judged(r.url)[3] for r in df.select("page_id", "url").collect()}
        assert all(r.verdict == rules[r.page_id] for r in got if rules[r.page_id])
    assert judge(odd.limit(0), labelled_pages(odd, labels)).count() == 0


def test_mined_rules_block_combinations(spark):
    from dispatchery.llm.urls import judge, mine

    rows = [(f"http://spam.h{i % 5}.com/buy/{i}", True) for i in range(40)] + [(f"http://spam.h{i % 5}.com/read/{i}", False) for i in range(40)] + [(f"http://ok.h{i % 5}.com/buy/{i}", False) for i in range(40)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    rules = mine(labelled, 0.05, 0.9)
    assert any(set(r.tokens) == {"h=spam", "p=buy"} for r in rules.collect())
    pages = spark.createDataFrame([(1, "http://spam.h9.com/buy/1"), (2, "http://spam.h9.com/read/1"), (3, "http://ok.h9.com/buy/1"), (4, None)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge(pages, labelled).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "allow"}


PAGE = """<!doctype html><body class="has-sidebar"><header class=site><h1>Site</h1><p>a tag line long enough to be taken for a text</p></header><nav>menu</nav>
<div class="cookie-notice"><p>We use cookies, with more words than some articles have, maybe</p></div><div id="wrap"><div class="post-{n} content"><h2>Title &amp; more</h2>
<p>First   para <a href=x>link</a>, with text&nbsp;and &#233;.<p>Second para<br>line<ul><li>one<li>two <b>bold</b></ul><div class=ad-box>Buy</div><blockquote>quoted "&lt;" text</blockquote>tail text
<form><p>mail me</p></form></div><aside><p>Side bar text</p></aside><section id="comments"><article class="comment"><p>Great read, thanks a lot for this long comment</p></article></section></div>
<footer>foot</footer><script>if (a<b) "</p>"</script></body>"""
TEXT = 'Title & more\nFirst para link, with text and é.\nSecond para line\none\ntwo bold\nquoted "<" text\ntail text'


def test_page_text(spark):
    from dispatchery.llm.html import main_text

    rows = [(i, f"https://a.example.com/{i}", PAGE.replace("{n}", str(i))) for i in range(4)]
    rows += [(10, "https://b.example.com/", ""), (11, None, None), (None, "no scheme", "just words"), (12, "https://a.example.com/x", "<div><div>" * 500 + "deep" + "<p>x" * 3), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, path string")
    got = {}
    for r in main_text(pages).collect():
        got.setdefault(r.page_id, []).append(r)
    assert [r.text for i in range(4) for r in got[i]] == [TEXT] * 5 and got[0][0].n_chars == len(TEXT)
    assert (got[10][0].text, got[11][0].text, got[None][0].text) == ("", "", "just words")
    assert got[12][0].text == "deep\nx\nx\nx"
    assert main_text(pages.limit(0)).count() == 0


def test_hosts_agree_on_a_path(spark):
    """A page whose longest part is not the article is read where its host's other pages have theirs."""
    from dispatchery.llm.html import main_text

    page = "<body><div class='lead'><p>{a}</p></div><div class='more'><p>{b}</p></div></body>"
    rows = [(i, "http://h.com/x", page.format(a="long words of the article " * 8, b="short")) for i in range(5)]
    rows.append((9, "http://h.com/y", page.format(a="brief article", b="an odd long extra here " * 8)))
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "brief article"


def test_articles_in_parts_are_whole(spark):
    """Parts of one path, parts of several paths and headings beside them all belong to the text; what stands beside the article doesn't."""
    from dispatchery.llm.html import main_text

    say = lambda n, word: (f"{word} " * n)[:n].strip()
    title, side = "A title of 20 letters", "<div class=teaser><p>another story</p></div>"
    want, rows = {}, []
    for i, sizes in enumerate([(1000, 1000), (1000, 400), (1000, 1000, 1000), (2000, 500, 500), (1000, 30)]):
        texts = [say(n, f"part{k}") for k, n in enumerate(sizes)]
        same = "".join(f"<section><p>{t}</p></section>" for t in texts)
        other = "".join(f"<div class=part{chr(97 + k)}><p>{t}</p></div>" for k, t in enumerate(texts))
        whole = "\n".join([title, *texts])
        for j, page in enumerate([
            f"<body>{side}<article><h1>{title}</h1>{same}</article>{side}</body>", f"<body>{side}<article><h1>{title}</h1>{other}</article>{side}</body>",
            f"<body>{side}<main><h1>{title}</h1>{same}</main>{side}</body>", f"<body>{side}<div id=wrap><h1>{title}</h1>{same}</div>{side}</body>",
        ]):
            key = 100 * i + j
            rows += [(key + 10 * n, f"http://h{key}.com/{n}", page) for n in range(2)]
            want |= {key + 10 * n: whole for n in range(2)}
    text = say(1000, "words")
    for key, around in ((900, "article"), (901, "main"), (902, "div")):
        rows.append((key, f"http://h{key}.com/", f"<body>{side}<{around}><h1>{title}</h1><div class=content><p>{text}</p></div></{around}>{side}</body>"))
        want[key] = f"{title}\n{text}"
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_parts_beside_each_other_without_an_article(spark):
    """Outside of article and main, a host's pages say together which paths make up the text."""
    from dispatchery.llm.html import main_text

    page = "<body><div class=top><p>tag line</p></div><div class=intro><p>{a}</p></div><div class=rest><p>{b}</p></div></body>"
    rows = [(i, "http://h.com/x", page.format(a="opening words " * 30, b="all the rest " * 60)) for i in range(3)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {("opening words " * 30).strip() + "\n" + ("all the rest " * 60).strip()}


def test_hidden_is_an_attribute_not_a_value():
    from dispatchery.llm.html import Page

    for seen in ("href='/hidden-gems'", 'title="The hidden cost"', 'data-state="hidden"', "href=/x/hidden title=hidden", "data-x = hidden", 'title="a class=sidebar role=menu"', "aria-hidden=false"):
        assert Page(f"<article {seen}><p>kept <a {seen}>link</a> text</p></article>").text(None) == "kept link text", seen
    for gone in ("hidden", "HIDDEN", 'hidden=""', "title='x' hidden", "title=x hidden/", "aria-hidden='true'", "style='display: none'", 'title="a" class = "sidebar"', "role=menu"):
        assert Page(f"<article><p>kept</p><div {gone}><p>gone</p></div></article>").text(None) == "kept", gone


def test_given_pages(spark):
    from dispatchery.llm.html import main_text

    got = main_text(spark.read.parquet(f"{SMALL}/pages.parquet")).collect()
    assert all(r.text and r.n_chars == len(r.text) and "<" not in r.text.replace("<", "", 0)[:1] for r in got)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SMALL)
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in kept.select("doc_id").collect()} and ids, name
        kept = out
    assert corpus_pipeline.run(spark, SMALL).count() == kept.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "encoding"]


@pytest.mark.parametrize("prefix", [f"op{n}_" for n in range(1, 11)] + ["pipeline"])
def test_registered(prefix):
    from dispatchery.llm.queries import QUERIES

    assert sum(n.startswith(prefix) for n in QUERIES) == 1


LONG = "".join(f"<p>Paragraph {i} of the article has words enough to count as text, and then some more.</p>" for i in range(8))
WRAPPERS = ["content-sidebar-wrap", "page-with-sidebar", "has-banner", "commentary", "share-story", "post has-comments", "main no-sidebar", "header-wrap"]


@pytest.mark.parametrize("inner", [f"<article>{LONG}</article>", LONG, f"<main>{LONG}</main>", f"<section>{LONG}</section>", f'<div class="sidebar">side</div><article>{LONG}</article>'])
@pytest.mark.parametrize("name", WRAPPERS)
def test_wrappers_named_after_something_else_keep_their_article(name, inner):
    from dispatchery.llm.html import Page

    page = Page(f'<html><body><nav>menu item</nav><div class="{name}">{inner}</div><footer>foot text</footer></body></html>')
    assert page.text(None).splitlines() == [f"Paragraph {i} of the article has words enough to count as text, and then some more." for i in range(8)]


def test_elements_around_the_whole_page():
    from dispatchery.llm.html import Page

    want = [f"Paragraph {i} of the article has words enough to count as text, and then some more." for i in range(8)]
    assert Page(f'<body><article class="commentary">{LONG}</article></body>').text(None).splitlines() == want
    assert Page(f"<body><form><div>{LONG}</div><input></form></body>").text(None).splitlines() == want
    for closed in ("<svg/>", "<script src=x />", "<math/>", "<iframe/>"):
        assert Page(f"<body><article>{LONG}{closed}{LONG}</article></body>").text(None).splitlines() == want * 2


def test_what_is_beside_the_article_stays_out():
    from dispatchery.llm.html import Page

    for beside in ('<section id="comments"><article>Nice one</article></section>', '<div class="related"><article>Read more</article></div>', '<form class="search"><p>Find</p></form>', '<div class="cookie-notice">Accept</div>'):
        for article in (f"<article>{LONG}</article>", f"<div class=content>{LONG}</div>"):
            text = Page(f"<body>{article}{beside}</body>").text(None)
            assert len(text.splitlines()) == 8 and "Paragraph 7" in text


def test_deep_nesting_and_stray_tags_take_linear_room():
    from dispatchery.llm.html import LONG_PATH, Page

    assert Page("<div>" * 50_000 + "deep text").text(None) == "deep text"
    paths = Page("<div class=a>text " * 50_000).shares()
    assert max(map(len, paths)) <= LONG_PATH and len(paths) > 1000
    assert Page("<div>" * 2000 + "</span>" * 20_000 + "end").text(None) == "end"
    assert "x" in Page("<b>" * 50_000 + "<p>x</p>" * 2000).text(None)
