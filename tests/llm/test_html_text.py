import html
import random
import re
import time

from fieldspark.llm.html_text import extract, main_text

from .data import rows


def test_article_pages(spark):
    """The provided pages hold their text in one article."""
    pages = rows(spark, "pages")
    got = {r.page_id: r for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for page_id, url, page in pages:
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h\d|li|ul|br)\b[^>]*>", article)]
        text = "\n\n".join(x for x in parts if x)
        assert (got[page_id].url, got[page_id].text, got[page_id].n_chars) == (url, text, len(text))


P = "A paragraph of some length, with commas, and more words than any menu has; it goes on a while, and on."


def test_container_without_article():
    page = f"""<html><head><title>T</title><script>if (a<b) x("</p>")</script></head><body>
    <header><h1>Site</h1></header><ul class="nav"><li><a href=/a>A</a><li><a href=/b>B</a></ul>
    <div id=wrap><div class="entry-content"><h2>Head &amp; line</h2><p>{P}<p>One  <b>bold</b>
    word<br>next {P}<ul><li>first<li>second</ul></div>
    <div class="sidebar"><p>{P}</p></div><div id="comments"><p>{P} {P}</p></div></div>
    <form><p>{P}</p></form><div class="cookie-notice">{P}</div><footer><p>{P}</p></footer></body></html>"""
    assert main_text(page).split("\n\n") == ["Head & line", P, "One bold word", f"next {P}", "first", "second"]


def test_siblings_and_links():
    links = "".join(f'<a href="/{i}">some link text, number {i}</a> ' for i in range(30))
    page = f"<body><div>{links}</div><div><p>{P}</p><p>{P}</p><p>{P}</p></div><p>{P}</p><div><p>short</p></div></body>"
    assert main_text(page) == "\n\n".join([P] * 4)


def test_odd_pages(spark):
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == main_text("<!-- x") == ""
    assert main_text("plain words") == "plain words"
    assert main_text("<article><p>x &lt;b&gt; &eacute;&#8212;y") == "x <b> é—y"
    assert main_text("<article>" + "<div>" * 3000 + P + "</article>") == P
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>" + P, 2), (1, "u", "<p>" + P, 2)], "page_id long, url string, html string, text long")
    assert sorted(r.n_chars for r in extract(pages).collect()) == [0, len(P), len(P)]
    assert extract(pages.limit(0)).count() == 0


def slow(tree):
    """The text of a tree (name, link share is by <a>, children) by the rules as stated, each size counted anew."""
    parent = {}

    def walk(n, up=None):
        yield n
        parent[id(n)] = up
        for c in n[1]:
            if not isinstance(c, str):
                yield from walk(c, n)

    def chars(n, linked=None, inside=False):
        inside = inside or n[0] == "a"
        return sum((len(" ".join(c.split())) if linked is None or inside else 0) if isinstance(c, str) else chars(c, linked, inside) for c in n[1])

    def commas(n):
        return sum(c.count(",") if isinstance(c, str) else commas(c) for c in n[1])

    share = lambda n: chars(n, True) / chars(n) if chars(n) else 0
    every = list(walk(tree))
    points = {}
    for n in every:
        own = [c for c in n[1] if isinstance(c, str)]
        size, some = (chars(n), commas(n)) if n[0] == "p" else (sum(len(" ".join(c.split())) for c in own), sum(c.count(",") for c in own))
        if size and n[0] in ("p", "h1", "li", "div", "section", "article"):
            up, k = parent[id(n)], 0
            while up is not None and k < 5:
                points[id(up)] = points.get(id(up), 0) + (1 + some + min(size / 100, 3) + size / 1000) / (1, 2, 6, 9, 12)[k]
                up, k = parent[id(up)], k + 1
    score = lambda n: points.get(id(n), 0) * (1 - share(n)) * (1.25 if n[0] in ("article", "main") else 1)
    best = max((n for n in every if id(n) in points), key=score, default=None)

    def menu(n):
        lis = [c for c in n[1] if not isinstance(c, str) and c[0] == "li" and chars(c)]
        return n[0] == "ul" and chars(n) > 0 and chars(n) == chars(n, True) and len(lis) > 2 and chars(n) <= 25 * len(lis)

    def belongs(n, inside):
        if not chars(n) or share(n) >= 0.5 or menu(n):
            return False
        if inside or score(n) >= max(10, score(best) * 0.2):
            return True
        return share(n) < 0.25 and (n[0] == "h1" or (chars(n) > 80 or commas(n) > 0 if n[0] == "p" else chars(n) > 250))

    if best is None or parent[id(best)] is None:
        nodes = [tree]
    elif best[0] in ("article", "main"):
        nodes = [n for n in parent[id(best)][1] if n is best or n[0] == best[0] and score(n) >= max(10, score(best) * 0.2) and share(n) < 0.5]
    else:
        path = [best]
        while (up := parent[id(path[-1])]) is not None and up[0] not in ("article", "main"):
            path.append(up)
        inside, nodes = up is not None, [best]
        for at in path if inside else path[:1]:
            c = parent[id(at)][1]
            k = next(i for i, x in enumerate(c) if x is at)
            nodes = [x for x in c[:k] if not isinstance(x, str) and belongs(x, inside)] + nodes + [x for x in c[k + 1 :] if not isinstance(x, str) and belongs(x, inside)]

    def text(n):
        if isinstance(n, str):
            return n
        if menu(n):
            return ""
        inner = "".join(map(text, n[1]))
        return inner if n[0] in ("a", "b") else f"\0{inner}\0"

    return "\n\n".join(x for x in (" ".join(b.split()) for b in "".join(map(text, nodes)).split("\0")) if x)


def test_random_trees_against_the_slow_version():
    rng = random.Random(9)
    words = "one two, three four five six seven eight, nine ten".split()

    def some(n):
        return " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))

    def inline(n):
        return [rng.choice((some(n), some(n), ["b", [some(5)]], ["a", [some(8)]])) for _ in range(rng.randint(1, 4))]

    def block(depth):
        name = rng.choice(("p", "p", "p", "h1", "div", "section", "article", "main", "ul"))
        if name in ("p", "h1"):
            return [name, inline(30)]
        if name == "ul":
            return ["ul", [["li", [["a", [some(3)]]] if rng.random() < 0.5 else inline(6)] for _ in range(rng.randint(1, 5))]]
        if depth == 4:
            return [name, inline(30)]
        return [name, [block(depth + 1) for _ in range(rng.randint(1, 4))] + inline(10) * (rng.random() < 0.2)]

    def markup(n):
        return n if isinstance(n, str) else f"<{n[0]} data-x='1>2'>{''.join(map(markup, n[1]))}</{n[0]}>"

    for _ in range(400):
        tree = ["html", [block(0) for _ in range(rng.randint(1, 4))]]
        assert main_text("".join(map(markup, tree[1]))) == slow(tree)


def test_names_of_boilerplate():
    for name in ("comment-body", "cookie-content", "sidebar-text", "ad-main", "articleComments", "side-bar", "entry-share", "page_footer"):
        assert main_text(f'<div class="content"><p>{P}</p><div class="{name}"><p>{P} {P}</p></div></div>') == P, name
    assert main_text(f'<main><article><p>{P}</p><p>{P}</p></article><article class="comment"><p>{P}</p></article></main>') == f"{P}\n\n{P}"
    for name in ("no-sidebar", "has-comments", "post category-promo tag-cookies", "shadow", "address"):
        assert main_text(f'<div class="{name}"><p>{P}</p></div>') == P, name
    assert main_text(f"<article><header><h1>Title</h1></header><div><p>Lead</p></div><div><p>{P}<p>{P}</div><div><p>End.</div></article>") == f"Title\n\nLead\n\n{P}\n\n{P}\n\nEnd."


def test_malformed_pages_and_time():
    assert main_text("<article><p title=it's>one</p><p>two 'x'</p></article>") == "one\n\ntwo 'x'"
    assert main_text(f'<head><title>t</title><body><p title="x>{P}') == P
    assert main_text(f'<p a="1"b=\'<i>\'c = 3 d>{P}</p><p') == P
    for bad in ('<p title="a>', "<p x", "<!", "<b><div></ul>", "<i></span>", "<nav>", "<p a='b\">", "<li></li>", "<b></p><p></p>", "<a href=\"x", "<!--", "</"):
        took = []
        for n in (4000, 16000):
            began = time.process_time()
            main_text("<div>" + bad * n + "x")
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.2, (bad, took)
    long = "<article>" + "".join(f"<p>{P} {i}</p>" for i in range(20000)) + "</article>"
    assert len(main_text(long).split("\n\n")) == 20000
