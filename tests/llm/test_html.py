from photonlake.llm import html

from .helpers import clashing

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><article>no</article>";</script></head>
<body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad > --><div class="ad">Buy</div>
<article><h1>A &amp; B</h1><p>One <b>bold</b>
 text.<br>more<p>Two&nbsp;x<div class="reader comments"><p>I say</p></div><aside>side</aside><form><p>mail</p></form><p hidden>h</p>
<ul><li>first<li>second</ul></article><div id="cookie-notice">We use</div><footer>&copy; x</footer></body></html>"""


def test_article_of_a_page():
    assert html.blocks(PAGE) == (["A & B", "One bold text. more", "Two x", "first", "second"], True)


def test_awkward_markup():
    assert html.blocks(None) == ([], False) and html.blocks("") == ([], False)
    assert html.blocks("plain &lt;text") == (["plain <text"], False)
    assert html.blocks("<article><p>a<p>b <i>c") == (["a", "b c"], True)
    assert html.blocks("<article>x</article><article>y</article><p>z") == (["x", "y"], True)
    assert html.blocks("<p>a</p><nav>open<p>b") == (["a"], False)
    assert html.blocks("<p title='a > b'>c</p></div></p><p>d") == (["c", "d"], False)
    assert html.blocks("<main><p>in</p></main><p>out</p>") == (["in"], True)
    assert html.blocks("<p>1 < 2</p><p>x <") == (["1 < 2", "x <"], False)
    assert html.blocks("<article><p>" + "w " * 50000) == ([("w " * 50000).strip()], True)


def runs_of(texts, run):
    tokens = " ".join(texts).split(" ") if texts else []
    return [tuple(tokens[i : i + run]) for i in range(len(tokens) - run + 1)]


def brute(rows, run=html.RUN):
    """The text of each page by the rules as they are stated, page by page and run by run."""
    parsed = {}
    for k, (_, url, source) in enumerate(rows):
        page = html.scanned(source)
        parsed[k] = (url.split("/")[2] if url else "", page)
    contents = {k: (h, tuple(p.texts), tuple(p.outside)) for k, (h, p) in parsed.items()}
    out = {}
    for k, (h, page) in parsed.items():
        same = {c: parsed[j][1] for j, c in contents.items() if c[0] == h}
        own = runs_of(page.texts, run)
        has = lambda r, p: not p.marked and r in runs_of(p.texts, run) or r in runs_of(p.outside, run)
        shared = {r for r in own if not page.marked and sum(has(r, p) for p in same.values()) > 1}
        outside = {r: sum(r in runs_of(p.outside, run) for p in same.values()) for r in shared}
        inside = {r: sum(p.marked and r in runs_of(p.texts, run) for p in same.values()) for r in shared}
        told = {r for r in shared if outside[r] >= html.VOTES and outside[r] > inside[r]}
        if not page.marked:
            votes = dict.fromkeys(shared, 0)
            for p in same.values():
                if p.marked:
                    continue
                theirs = runs_of(p.texts, run)
                repeated = [sum(has(r, q) for q in same.values()) > 1 for r in theirs]
                covered = {i for j, is_repeated in enumerate(repeated) if is_repeated for i in range(j, j + run)}
                n = len(" ".join(p.texts).split(" "))
                speaks = set()
                for j, r in enumerate(theirs):
                    if repeated[j]:
                        a, z = j, j
                        while a - 1 in covered:
                            a -= 1
                        while z + 1 in covered:
                            z += 1
                        if z - a + 1 <= n - len(covered):
                            speaks.add(r)
                for r in speaks & shared:
                    votes[r] += 1
            told |= {r for r in shared if votes[r] >= html.VOTES}
        marked = {i for j, r in enumerate(own) if r in told for i in range(j, j + run)}
        text, start = [], 0
        for block, heading in zip(page.texts, page.headings, strict=True):
            n = len(block.split(" "))
            if heading or sum(i in marked for i in range(start, start + n)) < html.COVERED * n:
                text.append(block)
            start += n
        out[k] = "\n".join(text)
    return out


def words(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def texts(spark, rows):
    return {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def divs(*own):
    return "".join(f"<div>{x}</div>" for x in own)


def test_random_hosts_against_brute_force(spark):
    import random

    r = random.Random(7)
    lines = [words(f"l{k}x", r.choice((3, 8, 9, 14))) for k in range(10)]
    rows = []
    for k in range(90):
        own = [words(f"s{r.randrange(70)}x", r.choice((5, 20, 60))) for _ in range(r.randrange(4))] + r.sample(lines, r.randrange(5))
        r.shuffle(own)
        if r.random() < 0.5:
            out = "".join(f"<{t}>{x}</{t}>" for x in r.sample(lines, r.randrange(3)) for t in (r.choice(("nav", "footer", "aside")),))
            source = f"{out}<article><h1>{r.choice(lines)}</h1>{''.join(f'<p>{x}</p>' for x in own)}</article>{out}"
        else:
            source = divs(*own) + f"<footer>{r.choice(lines)}</footer>"
        rows.append((k, f"https://h{k % 3}/{k}", source))
    rows += [(90, None, divs(lines[0])), (91, None, divs(lines[0], "x")), (92, None, divs(lines[0])), (92, None, divs(lines[0]))]
    got = html.main_text(clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))).collect()
    want = brute(rows)
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted((row[0], want[k], len(want[k])) for k, row in enumerate(rows))
    assert any(t != "\n".join(html.scanned(row[2]).texts) for row, t in zip(rows, want.values()))


def test_beyond_the_bitmap_runs_are_joined(spark, tmp_path):
    from photonlake.llm.common import Workspace

    rows = [(k, f"https://h/{k}", divs(words("menu", 12), words(f"s{k}x"))) for k in range(6)]
    work = Workspace(spark, "html")
    spool = html.parsed(spark.createDataFrame(rows, "page_id long, url string, html string"), work)
    small = {tuple(r) for r in html.repeated_runs(spool, work).collect()}
    assert small == {tuple(r) for r in html.repeated_runs(spool, work, most=0).collect()} and len(small) == 6 * 5


def test_articles_keep_what_they_repeat(spark):
    quote, title = words("q", 20), words("title", 9)
    rows = [(k, f"https://h/{k}", f"<nav>{words('menu', 9)}</nav><article><h1>{title}</h1><p>{words(f's{k}x')}</p><p>{quote}</p></article>") for k in range(6)]
    got = texts(spark, rows)
    assert all(got[k] == "\n".join((title, words(f"s{k}x"), quote)) for k in range(6))


def test_what_stands_outside_articles_goes_from_bodies(spark):
    notice, title = words("notice", 12), words("title", 9)
    story = lambda k: f"<article><p>{words(f's{k}x')}</p><p>{notice}</p></article>"
    few = [(k, f"https://h/{k}", f"<article>{words(f't{k}x')}</article><footer>{notice}</footer>") for k in range(2)]
    rows = [(8, "https://h/8", f"<h1>{title}</h1>" + divs(words("u"), notice)), (9, "https://h/9", f"<nav>{title}</nav>" + story(9)), (10, "https://h/10", f"<nav>{title}</nav>" + story(10)), (11, "https://h/11", f"<nav>{title}</nav>" + story(11))]
    got = texts(spark, few + rows)  # two have it outside, three in an article
    assert got[8] == "\n".join((title, words("u"), notice)) and all(notice in got[k] for k in (9, 10, 11))
    more = [(20 + k, f"https://h/{20 + k}", f"<article>{words(f'v{k}x')}</article><footer>{notice}</footer>") for k in range(2)]
    got = texts(spark, few + rows + more)
    assert got[8] == title + "\n" + words("u") and all(notice in got[k] for k in (9, 10, 11))


def test_copies_do_not_erase_each_other(spark):
    menu = "all our shops and offers and news and help at one single glance"
    rows = [(1, "https://h/a", divs(menu, words("a"))), (2, "https://h/a2", divs(menu, words("a"))), (2, "https://h/a2", divs(menu, words("a")))]
    rows += [(3, "https://h/b", divs(menu, words("b"), "seen on monday")), (4, "https://h/b2", divs(menu, words("b"), "seen on a quiet tuesday"))]
    rows += [(5, "https://h/c", divs(menu, words("c"))), (6, "https://h/d", divs(menu, words("d")))]
    rows += [(7, "https://two/a", divs(words("a"))), (8, "https://two/b", divs(words("a")))]
    got = texts(spark, rows)
    assert got[1] == got[2] == got[7] == got[8] == words("a")
    assert words("b") in got[3] and words("b") in got[4]
    assert got[5] == words("c") and got[6] == words("d")


def test_null_hosts_empty_pages_and_long_articles(spark):
    long = " ".join(words(f"w{k}x") for k in range(5000))
    rows = [(1, None, divs("x y")), (2, None, divs("x y")), (3, "https://h/3", None), (4, "https://h/4", ""), (None, None, None), (5, "https://h/5", f"<article><p>{long}</p><p>{long}</p></article>")]
    got = texts(spark, rows)
    assert got == {1: "x y", 2: "x y", 3: "", 4: "", None: "", 5: long + "\n" + long}
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_of_elements():
    article = "<article><p>a</p><section id='related-work'>b</section><h2 id='ad-hoc-queries'>c</h2><div class='social-history'>d</div><h3 class='notice'>e</h3><div class='x comments'>no</div><div class='notice'>no</div><ul class='share'><li>no</ul></article>"
    want = (["a", "b", "c", "d", "e"], True)
    assert html.blocks(f"<div class='layout has-sidebar'>{article}</div><p>z") == want
    assert html.blocks(f"<div class='sidebar'>menu{article}menu</div><p>z") == want
    assert html.blocks(f"{article}<div class='sidebar'>x<article>teaser</article>y</div><p>z") == want
    assert html.blocks("<article>a<div class='ad'>b<article>no</article>c</div>d</article>") == (["a", "d"], True)
    assert html.blocks("<p>a</p><div class='sidebar'>b<p>c</div><div id='has-sidebar'>d</div><div id='menu'>e</div>f") == (["a", "d", "f"], False)
    assert html.blocks("<div class='menu'><article>a</article></div>b<div class='menu'>c</div>d") == (["a"], True)


def test_pages_that_mark_nothing():
    source = "<div><a href='/'>Home</a> <a>About</a> <a>Contact</a></div><p>See <a>the list</a></p><p><a>A longer line that is a link but has many words</a></p><div>© 2020 Site</div><p>Copyright law is old and this text is about it at length</p>"
    page = html.scanned(source)
    assert page.texts == ["See the list", "A longer line that is a link but has many words", "Copyright law is old and this text is about it at length"]
    assert page.outside == ["Home About Contact", "© 2020 Site"]


def test_open_quotes():
    assert html.blocks("""<p><b title="it>bold</b> then</p><p>x""") == (["bold then", "x"], False)
    assert html.blocks("<b it's>x</b>") == (["x"], False)
    assert html.blocks("""<p title='a > b' data-x="<i>c</i>" >c</p><a href="x>t</a><a href="y">u</a>""") == (["c", "tu"], False)
    assert html.blocks("<p title=\"a'b\">c's</p><br/><img alt='>' />d") == (["c's", "d"], False)
    assert html.blocks("<p>a<b title='") == (["a"], False) and html.blocks("<script>x</script foo>y<!--> z") == (["y z"], False)


def test_open_quotes_take_linear_time():
    import time

    def seconds(n):
        start = time.perf_counter()
        html.blocks("<a \"" * n + "'" + "<a x=\"" * n + "<b = '" * n + "<!--" * n)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(100_000) < 40 * seconds(10_000)


def test_open_tags_take_linear_time():
    import time

    def seconds(n):
        start = time.perf_counter()
        text, marked = html.blocks("<article>" + "<p>a <b>b</b> <i>c" * n)
        assert marked and len(text) == n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(100_000) < 40 * seconds(10_000)
