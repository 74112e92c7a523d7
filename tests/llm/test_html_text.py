import math
import random
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from gridcast.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
<article><header><h1>Big &amp; small</h1></header><p><b>One <i>two</i><br>three<p>Four&nbsp;&lt;5
 six</p><ul><li>a<li>b</ul><div class="comments"><p>Troll</p></div><p title="a > b">End</article><footer>&copy; x</footer>"""


def test_rules():
    assert H.main_text(PAGE) == "Big & small\n\nOne two three\n\nFour <5 six\n\na\n\nb\n\nEnd"
    assert H.main_text("") == "" and H.main_text("plain  text") == "plain text" and H.main_text("a<b c") == "a<b c"
    assert H.main_text("<div>x<p>y</div>z<script>never closed") == "x\n\ny\n\nz"
    assert H.main_text("<p>" * 3000 + "deep") == "deep" and H.main_text("<div>" * 3000 + "deep") == "deep"
    assert H.main_text("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>") == "a\n\nb\n\nc\n\nd\n\ne"
    assert H.main_text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n\n2\n\n3" and H.main_text("x</p>y") == "x\n\ny"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article><h2 id="related-work">Related work</h2><p>x</p></article>', "Related work\n\nx"),
        ('<article><section id="search-results">a</section><p class="meta">m</p></article>', "a\n\nm"),
        ('<article><div id="comment-syntax">s</div><table class="login-table"><tr><td>q</table></article>', "s\n\nq"),
        ('<div class="social-science">soc</div>', "soc"),
        ('<div class="page no-sidebar"><article class="post has-comments"><header class="entry-header"><h1>T</h1></header>x</article></div>', "T\n\nx"),
        ('<div class="widget ad"><article>kept</article></div>', "kept"),
        ('<article>a <span class="advert">BUY <span>x</span> y</span> b</article>', "a b"),
        ('<article>a<object>old</object><canvas>c</canvas></article>', "a"),
        ('<article>a<div role="complementary">r</div><div id="comments">c</div><ul class="share-buttons"><li>s</ul></article>', "a"),
        ('<div class="sidebar"><article>teaser</article></div><article>own</article>', "own"),
    ],
)
def test_names_cut_whole_names_only(html, text):
    assert H.main_text(html) == text


def test_time_is_linear():
    odd = ["<div>word " * 180_000, '<a ">" ' * 150_000, "</div>" * 250_000, "<ul><li><ul>" + "<div>" * 100_000 + "<li>x</li>" * 60_000]
    odd += ["<" * 10**6, "<!" * 10**6, "</script " * 10**5 + "<script>" + "</script " * 10**5, "<div>" * 100_000 + "</ul>" * 100_000]
    for html in odd:
        began = time.perf_counter()
        H.page(html)
        assert time.perf_counter() - began < 15
    assert len(H.page(odd[0])[1]) == 180_000


class Tree(HTMLParser):
    """(path, shape, text of blocks, place of first and end block) of every element, for closed and well-formed pages."""

    def __init__(self, html):
        super().__init__()
        self.stack, self.done, self.blocks, self.text = [["#", "", [], 0]], [], [], ""
        self.feed(html)
        self.flush()

    def flush(self):
        if self.text.strip():
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        name = f"{tag}.{dict(attrs).get('class', '')}"
        self.stack[-1][2].append(name)
        self.stack.append([tag, f"{self.stack[-1][1]}/{name}", [], len(self.blocks)])

    def handle_data(self, data):
        self.text += data

    def handle_endtag(self, tag):
        self.flush()
        _, path, children, first = self.stack.pop()
        if len(self.blocks) > first:
            self.done.append((path, tuple(children), tuple(self.blocks[first:]), first, len(self.blocks)))


def brute(pages, threshold=0.2, min_seen=5):
    """Texts of (host, html) by a style tree in plain Python; article elements are landmarks."""
    trees = [(host, Tree(html), "<article" in html) for host, html in pages]
    candidates = []
    for _, tree, land in trees:
        own = [x for x in tree.done if x[0].count("/") > 2] if land else [x for x in tree.done if x[0] not in ("/html.", "/html./body.")]
        candidates.append([x for x in own if not land or (x[0].startswith("/html./body./article./") and not x[0].endswith(("/p.", "/h1.", "/li.")))])
    shapes, contents, seen = defaultdict(set), defaultdict(set), defaultdict(set)
    for k, (host, tree, land) in enumerate(trees):
        article = next((x for x in tree.done if x[0] == "/html./body./article."), None)
        ident = article[2] if land else tuple(tree.blocks)
        for path, children, text, _, _ in candidates[k]:
            if children:
                shapes[host, path].add((children, ident))
            contents[host, path].add((text, ident))
            seen[host, path].add(ident)

    def entropy(pairs):
        n = Counter(v for v, _ in pairs)
        total = sum(n.values())
        return -sum(c / total * math.log(c / total) for c in n.values()) / math.log(total) if total > 1 else -1

    out = []
    for k, (host, tree, land) in enumerate(trees):
        gone = set()
        for path, _, text, first, end in candidates[k]:
            m = len(seen[host, path])
            spread = sum(v == text for v, _ in contents[host, path])
            low = max(entropy(shapes[host, path]), entropy(contents[host, path]))
            if m >= min_seen and ((low < threshold and low >= 0) or (spread > 1 and 1 - math.log(spread) / math.log(m) < threshold)):
                gone |= set(range(first, end))
        article = next((x for x in tree.done if x[0] == "/html./body./article."), None)
        own = range(article[3], article[4]) if land else range(len(tree.blocks))
        size = lambda blocks, tree=tree: sum(len(tree.blocks[b]) for b in blocks)
        gone &= set(own)
        if (2 * size(gone) > size(own)) if land else len(gone) == len(own):
            gone = set()
        out.append(("\n\n".join(tree.blocks[b] for b in own if b not in gone), len(gone)))
    return out


def site(rng, land, n):
    """Pages of one host: varied text and blocks that many share."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared, pages, bodies = [" ".join(word() for _ in range(4)) for _ in range(4)], [], []
    for _ in range(n):
        if bodies and rng.random() < 0.3:
            body = rng.choice(bodies)  # a copy
        else:
            body = "<h1>Title</h1>" + "".join(f"<p>{' '.join(word() for _ in range(9))}</p>" for _ in range(rng.choice([1, 2, 5])))
            bodies.append(body)
        box = f"<div class='box'><p>{shared[0]}</p><ul><li>{shared[1]}</li></ul></div>"
        mixed = f"<div class='mixed'><p>{rng.choice([shared[2], word()]) if rng.random() < 0.9 else word()}</p></div>"
        inner = body + (box if rng.random() < 0.8 else "") + mixed
        inner = f"<article>{inner}</article><div class='end'>{shared[3]}</div>" if land else f"<div class='top'>{shared[3]}</div><div class='text'>{inner}</div>"
        pages.append(f"<html><body>{inner}</body></html>")
    return pages


def test_against_a_brute_force_tree(spark):
    rng = random.Random(3)
    pages = [(f"h{k}.example", html) for k, n in enumerate([40, 40, 3, 6, 12, 12, 40, 3]) for html in site(rng, k % 2 == 0, n)]
    pages += [("copies.example", f"<html><body><article><div class='a'><p>the very same words</p></div><p>n{k}</p></article></body></html>") for k in range(9)]
    rows = [(k, f"http://{host}/{k}", html) for k, (host, html) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: (r["text"], r["n_cut_by_tree"]) for r in H.extract(df).collect()}
    want = brute(pages)
    assert [got[k] for k in range(len(pages))] == want
    assert sum(n > 0 for (_, n), (_, html) in zip(want, pages) if "<article" in html) > 20 and any("the very same words" in t for t, _ in want)


def test_style_tree_cuts_template_branches_only(spark):
    pages = []
    for i in range(30):
        html = f"<body><div class='top'>Same words everywhere</div><div class='text'><p>Own words {i} {i * 7}</p></div><div class='end'>Same end</div></body>"
        pages.append((i, f"http://one.example/{i}", html, i))
    pages.append((100, "http://two.example/", pages[0][2], 0))
    pages += [(200 + i, "http://copies.example/", "<article><p>A copied article</p></article>", 0) for i in range(9)]
    pages += [(300, None, None, 0), (301, "http://[bad", "<p>x</p>", 0), (None, "http://one.example/0", pages[0][2], 0)]
    pages += [(400, "http://long.example/", "<article>" + "<p>long words</p>" * 50_000 + "</article>", 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text int").repartition(3)
    got = {r["page_id"]: r for r in H.extract(df).collect()}
    assert len(got) == len(pages)
    assert all(got[i]["text"] == f"Own words {i} {i * 7}" for i in range(30)) and got[None]["text"] == got[0]["text"]
    assert got[100]["text"] == "Same words everywhere\n\nOwn words 0 0\n\nSame end"  # a host of one page has no template
    assert all(got[200 + i]["text"] == "A copied article" for i in range(9))
    assert got[300]["text"] == "" and got[300]["n_chars"] == 0 and got[301]["text"] == "x"
    assert got[100]["n_chars"] == len(got[100]["text"]) and got[400]["n_chars"] == 50_000 * 12 - 2
    assert H.extract(df.limit(0)).count() == 0
