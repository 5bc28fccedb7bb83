import os
import re

from cases import table

from marlstone.llm import htmltext as h

TEMPLATE = "<html><head><title>t</title></head><body><div>Shared line</div><div><p>{0}</p></div><p>Shared end</p></body></html>"


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'x' as host", "'x' as path", "1 as key", "2 as bucket", "'y' as given")


def test_template_lines_go(spark):
    rows = [(i, f"http://h.example/a/{i}", TEMPLATE.format(f"Own &amp; text {i}")) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in h.extract(pages(spark, rows)).collect()}
    assert got == {i: f"Own & text {i}" for i in range(5)}


def test_article_without_its_surroundings():
    source = """<body><nav>Menu</nav><article><h1>Title</h1><p>First
      line <b>bold</b>.</p><aside>Advert</aside><script>x()</script></article><section class="comments"><p>me too</p></section><footer>Foot</footer></body>"""
    lines = h.page_lines(source)
    assert h.main_text({"roles": [r for r, _ in lines], "hashes": [], "texts": [t for r, t in lines if r != h.BOILERPLATE]}, None, None) == "Title\n\nFirst line bold."


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://h/a", "<p>x"), (3, "no url", "plain text"), (4, "http://h/b", "<p>" + "long " * 200_000), (3, "no url", "plain text"), (5, "http://h/c", "<<<>< broken <p")]
    got = h.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r["text"] for r in got if r["page_id"] in (1, 2, 3)) == ["", "", "plain text", "plain text"]
    assert next(len(r["text"]) for r in got if r["page_id"] == 4) == 5 * 200_000 - 1
    assert h.extract(pages(spark, rows).limit(0)).count() == 0


def test_ranges_equal_one_sorted_list(spark):
    """The distributed neighbours are those of one sorted list."""
    rows = table(spark, "pages").select("page_id", "url", "html")
    host, path = h.url_parts(rows["url"])
    every = rows.select("page_id", host.alias("host"), path.alias("path"), "html").toPandas().to_dict("records")
    every.sort(key=lambda r: (r["host"], r["path"], str(r["page_id"]).rjust(20, "0")))
    for r in every:
        lines = h.page_lines(r["html"] or "")
        r |= {"roles": [x for x, _ in lines], "hashes": [hash(t) for _, t in lines], "texts": [t for x, t in lines if x != h.BOILERPLATE]}
    want = {r["page_id"]: h.main_text(r, every[i - 1] if i else None, every[i + 1] if i + 1 < len(every) else None) for i, r in enumerate(every)}
    assert {r["page_id"]: r["text"] for r in h.extract(rows).collect()} == want


def plain_main_text(rows):
    """What differencing must give, plainly: every page against the nearest one on its host, on either side in the order of their paths, that isn't its copy."""
    pages = []
    for page_id, url, source in rows:
        host, path = re.match(r"https?://([^/]*)(/[^?#]*)?", url).groups("")
        lines = [(r, t) for r, t in h.page_lines(source or "") if r != h.BOILERPLATE]
        pages.append((host.lower(), path, str(page_id).rjust(20, "0"), page_id, lines))
    pages.sort()
    out = {}
    for i, (host, path, _, page_id, lines) in enumerate(pages):
        near = []
        for side in (pages[i - 1 :: -1] if i else [], pages[i + 1 :]):
            near += [p for p in side if (p[0], p[4]) != (host, lines)][:1]
        near = sorted((p for p in near if p[0] == host), key=lambda p: -len(os.path.commonprefix([p[1], path])))

        def common(other):
            """Places of this page's lines in a longest common subsequence with the other's."""
            a, b = [t for _, t in lines], [t for _, t in other[4]]
            shared = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for x in range(len(a) - 1, -1, -1):
                for y in range(len(b) - 1, -1, -1):
                    shared[x][y] = shared[x + 1][y + 1] + 1 if a[x] == b[y] else max(shared[x + 1][y], shared[x][y + 1])
            found, x, y = set(), 0, 0
            while x < len(a) and y < len(b):
                if a[x] == b[y]:
                    found.add(x)
                    x, y = x + 1, y + 1
                elif shared[x][y + 1] >= shared[x + 1][y]:
                    y += 1
                else:
                    x += 1
            return found

        kept, both = lines, [common(other) for other in near]
        article = lambda some: sum(len(t) for r, t in some if r in (h.ARTICLE, h.HEADING))
        for found in both:
            own = [x for n, x in enumerate(lines) if n not in found]
            if own and 2 * article(own) >= article(lines):
                inside = lambda some: [n for n, (r, _) in enumerate(some) if r in (h.ARTICLE, h.HEADING)]
                first = lambda some, n: inside(some).index(n)
                last = lambda some, n: inside(some)[::-1].index(n)
                at = lambda n, place: all(any(o[4][m][1] == lines[n][1] and place(o[4], m) == place(lines, n) for m in inside(o[4])) for o in near)
                everywhere = {n for n in both[0] & both[1] if n in inside(lines) and (at(n, first) or at(n, last))} if len(both) > 1 else set()
                kept = [x for n, x in enumerate(lines) if n not in found or x[0] == h.HEADING or (x[0] == h.ARTICLE and n not in everywhere)]
                break
        out[page_id] = "\n\n".join(t for _, t in kept)
    return out


def test_pages_equal_plain_differencing(spark):
    """All pages of a table; and the number of pages that lose lines to their neighbour, which tags alone would keep."""
    rows = [tuple(r) for r in table(spark, "pages", "/root/testdata/sf0.01").select("page_id", "url", "html").collect()]
    extra = [(10_000 + i, f"http://blog.example/{i % 3}/post-{i}", f"<body><div>My blog</div><p>Post number {i} says this and that</p><div>Follow me</div><p>{'Also ' * (i % 4)}here</p></body>") for i in range(30)]
    want = plain_main_text(rows + extra)
    got = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows + extra, "page_id long, url string, html string")).collect()}
    # where a page has several longest common subsequences with its neighbour (repeated lines), either may be taken
    assert got.keys() == want.keys() and sum(got[i] == want[i] for i in got) >= 0.99 * len(got)
    tags = {i: "\n\n".join(t for r, t in h.page_lines(s or "") if r != h.BOILERPLATE) for i, _, s in rows + extra}
    assert sum(got[i] != tags[i] for i in got) >= 30


def test_longest_common_subsequence():
    assert h.common_lines([1, 2, 3, 4], [2, 9, 4]) == {1, 3}
    assert h.common_lines([], [1]) == set()


def test_lines_inside_and_beside_articles_are_differenced(spark):
    source = "<body><div>Site name</div><article><p>Sign up for our letter</p><p>Own text of page {0}, long enough</p></article><p>More about {0}</p></body>"
    rows = [(i, f"http://h.example/a/{i}", source.format(i)) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in h.extract(pages(spark, rows)).collect()}
    # the first and the last page have one neighbour, which isn't enough to take a line out of an article
    asked = lambda i: "Sign up for our letter\n\n" if i in (0, 3) else ""
    assert got == {i: f"{asked(i)}Own text of page {i}, long enough\n\nMore about {i}" for i in range(4)}


def test_articles_that_quote_one_line_keep_it(spark):
    """A paragraph and a heading that one neighbour, or the heading that both have, stay."""
    source = "<body><div>Site name</div><article><h1>Daily news</h1><p>Own text of page {0}, long enough to tell</p><p>{1}</p></article></body>"
    rows = [(i, f"http://h.example/a/{i}", source.format(i, "A line that two pages quote" if i in (1, 2) else f"Another line of {i}")) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in h.extract(pages(spark, rows)).collect()}
    for i in range(4):
        assert got[i].split("\n\n") == ["Daily news", f"Own text of page {i}, long enough to tell", "A line that two pages quote" if i in (1, 2) else f"Another line of {i}"]


def test_another_version_of_an_article_does_not_delete_it(spark):
    source = "<article><p>A long paragraph that both versions of the article have</p><p>Version {0}</p></article>"
    rows = [(i, f"http://h.example/a/{i}", source.format(i)) for i in range(2)]
    assert all("both versions" in r["text"] for r in h.extract(pages(spark, rows)).collect())


def test_runs_of_copies_meet_a_page_that_differs(spark):
    """Three hosts with runs of copies longer than a range: every copy loses the lines that the other page has."""
    rows = []
    for host in "abc":
        rows += [(len(rows) + i, f"http://{host}.example/p?page={i}", TEMPLATE.format(f"Copied text of {host}")) for i in range(40)]
        rows.append((len(rows), f"http://{host}.example/q", TEMPLATE.format("Another text")))
        rows += [(len(rows) + i, f"http://{host}.example/r?ref={i}", TEMPLATE.format(f"Last text of {host}")) for i in range(20)]
    got = h.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["text"] for r in got} == {f"{kind} text of {host}" for host in "abc" for kind in ("Copied", "Last")} | {"Another text"}
