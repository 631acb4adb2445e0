"""Main text of pages: markup by cases, templates against explicit occurrence vectors, registered query."""

import html as html_module
import random
import re
from collections import Counter, defaultdict

import pytest

from orthoflow.llm import html_extract as H

SCHEMA = "page_id long, url string, html string, site string, text int"


def text_of(html):
    page = H.Page(html)
    level = max(page.levels, default=0)
    return "\n".join(t for t, x in zip(page.texts, page.levels, strict=True) if x == level)


def tokens_of(*htmls):
    columns = H.page_columns([H.Page(html) for html in htmls])
    return H.Tokens(columns[0], columns[1], columns[2], columns[5])


def test_tokens_in_order():
    """Tags and words of several pages in the order of the pages."""
    htmls = ["<p>a b<p><b>c</b> d", "", "x", "<article><h1>T u</h1></article><p></p>"]
    whole = tokens_of(*htmls)
    assert whole.first.tolist() == [0, 8, 8, 9, 17]
    assert whole.block.tolist() == [-1, 0, 0, -1, -1, -1, 1, 1, 2, -1, -1, 3, 3, -1, -1, -1, -1]
    alone = [t for html in htmls for t in tokens_of(html).token.tolist()]
    assert whole.token.tolist() == alone


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two", "one\ntwo"),
        ("<p>a <b>b\n\t c</b>d<br>e</p>", "a b cd e"),
        ("<article><h1>T</h1><p>x &lt;p&gt; &#233;&nbsp;y &copy z</p></article><footer>f</footer>", "T\nx <p> é y © z"),
        ("<script>var t='<p>no</p>';</script><style>p{}</style><p>yes", "yes"),
        ("<script>never ends <p>no", ""),
        ("<p>before <!-- <p>no</p> --> after<!-- open", "before after"),
        ("<p>3 < 4 and 5 <6 > 2</p>", "3 < 4 and 5 <6 > 2"),
        ('<p title="a > b">q</p><p title=don\'t>r</p><p data-x="open>s</p>', "q\nr\ns"),
        ("<body><nav><a href=/>home</a></nav><main><p>m</p><aside>x</aside><form>y<input></form></main>", "m"),
        ("<body><header>site</header><article><header><h1>T</h1></header><p>b</p><footer>by</footer></article>", "T\nb"),
        ('<article><p>a</p><div class="comments"><article class="comment">c</article></div></article>', "a"),
        ('<div class="post-content"><p>a</p><div id="cookieNotice">c</div><span class="share-buttons">s</span></div><p>z</p>', "a"),
        ('<article><p>a <span class="ad">buy</span> b</p><p hidden>h</p><p style="display: none">i</p></article>', "a b"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\nb\nc\nd\ne"),
        ("<article><p>cut <a href='x", "cut"),
        ("<title>T</title><p>a</p></div></p></article>b", "a\nb"),
        ("<article>text" + "<b>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "text\ndeep"),
    ],
)
def test_markup(html, text):
    got = text_of(html)
    if "deep" in html:
        assert got.replace("\n", "") == "textdeep"
    else:
        assert got == text


def page(i, words, menu=6, extra=""):
    links = "".join(f"<li><a href=/{k}>menu {i * k % 17}</a></li>" for k in range(menu))
    body = "".join(f"<p>{w}</p>" for w in words)
    return f"<html><body><ul>{links}</ul><div><h2>Read all of our stories</h2>{body}{extra}<h3>Made in Nowhere</h3></div></body></html>"


def prose(rng, n):
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(4, 30))) for _ in range(n)]


def make_pages():
    rng = random.Random(2)
    rows, want = [], []
    for i in range(40):  # no semantic markup: boilerplate and menu by the template alone
        words = prose(rng, rng.randrange(1, 6))
        rows.append((i, f"http://one.example.com/{i}", page(i, words, extra="<p>Optional line</p>" if i % 3 == 0 else "")))
        want.append("\n".join(words + (["Optional line"] if i % 3 == 0 else [])))
    for i in range(100, 112):  # articles with markup, one body on all pages: nothing of it goes
        rows.append((i, "https://two.example.com/x", f"<nav>n{i}</nav><article><h1>Same</h1><p>The same words on every page.</p></article>"))
        want.append("Same\nThe same words on every page.")
    for i in range(200, 204):  # hosts of few pages share one site
        words = prose(rng, 3)
        rows.append((i, f"http://h{i}.example.org/", "<article>" + "".join(f"<p>{w}</p>" for w in words) + "</article><footer>all rights</footer>"))
        want.append("\n".join(words))
    rows += [(300, None, None), (301, None, ""), (None, "not a url", "<p>alone</p>"), (303, "http://one.example.com/e", None)]
    want += ["", "", "alone", ""]
    rows += [rows[0], rows[0]]
    want += [want[0], want[0]]
    long = prose(rng, 60_000)
    rows.append((400, "http://long.example.com/", "<article>" + "".join(f"<p>{w}</p>" for w in long) + "</article>"))
    want.append("\n".join(long))
    return rows, want


def test_extraction(spark):
    rows, want = make_pages()
    table = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA).repartition(4)
    got = H.text_report(H.extract_text(table)).collect()
    assert Counter((r["page_id"], r["url"], r["text"]) for r in got) == Counter((r[0], r[1], t) for r, t in zip(rows, want, strict=True))
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def vectors_brute(htmls):
    """Classes of one site by explicit occurrence vectors: sets of tokens."""
    counts = []
    for html in htmls:
        counts.append(Counter(tokens_of(html).token.tolist()))
    vectors = defaultdict(set)
    for token in {t for c in counts for t in c}:
        vector = tuple(c[token] for c in counts)
        if sum(v > 0 for v in vector) >= (H.STEADY if token & 1 else H.SHARE) * len(htmls):  # words are odd
            vectors[vector].add(token)
    return {frozenset(v) for v in vectors.values() if len(v) > 1}


def test_templates_against_vectors(spark):
    rng = random.Random(6)
    htmls = [page(i, prose(rng, 1 + i % 4), menu=3 + i % 3) for i in range(30)]
    table = spark.createDataFrame([(i, f"http://one.example.com/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string").repartition(5)
    template = H.site_templates(*H.read_pages(table)).collect()
    assert len(template) == 1 and template[0]["n"] == 30
    found = {frozenset(c["tokens"]) for c in template[0]["classes"]}
    brute = vectors_brute(htmls)
    assert found <= brute
    # the menu's items repeat inside a gap of the class that all pages have once
    sizes = sorted((len(c["tokens"]), c["steady"]) for c in template[0]["classes"])
    assert len(sizes) >= 2 and all(steady for _, steady in sizes)
    root = max(template[0]["classes"], key=lambda c: len(c["tokens"]))["tokens"]
    order = [t for t in tokens_of(htmls[0]).token.tolist() if t in set(root)]
    assert order == list(root)


def test_unordered_classes_are_no_template(spark):
    """Two words that swap places are one class by their vector, and not a valid one."""
    htmls = [f"<html><body><div><i>{'alpha beta' if i % 2 else 'beta alpha'} {i}</i></div></body></html>" for i in range(20)]
    table = spark.createDataFrame([(i, "http://one.example.com/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract_text(table).collect()}
    assert got == {i: f"{'alpha beta' if i % 2 else 'beta alpha'} {i}" for i in range(20)}


def test_empty_table(spark):
    assert H.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def article(html):
    """Text of the article element of a generated page, by patterns."""
    found = re.search(r"<article>(.*)</article>", html or "", re.S)
    if not found:
        return ""
    lines = (" ".join(html_module.unescape(re.sub(r"<[a-z/][^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", found[1]))
    return "\n".join(x for x in lines if x)


def test_registered_query(spark, sf):
    from orthoflow.llm.queries import QUERIES

    path = sf.replace("0.001", "0.01")
    want = {r["page_id"]: article(r["html"]) for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = QUERIES["op13_html_extraction"](spark, path).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert len(got) == len(want)
