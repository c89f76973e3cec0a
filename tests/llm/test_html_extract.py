import random
from functools import lru_cache

import pytest

from tidyledger.llm import html_extract as H

PAGES = "page_id long, url string, html string, host string, skeleton string"


def page(i, body, shell="<header>Site name</header><nav><ul><li><a href='/'>Home</a></li></ul></nav>{}<footer>&copy; 2020</footer>"):
    return f"<!DOCTYPE html><html><head><title>T{i}</title><script>var t='</p>';</script></head><body>{shell.format(body)}</body></html>"


def naive_match(a, b):
    """Size of the largest match, by the recursion itself."""

    @lru_cache(None)
    def size(i, j):
        left, right = tuple(a.children[i]), tuple(b.children[j])

        @lru_cache(None)
        def best(x, y):
            if x == len(left) or y == len(right):
                return 0
            out = max(best(x + 1, y), best(x, y + 1))
            if a.labels[left[x]] == b.labels[right[y]]:
                out = max(out, size(left[x], right[y]) + best(x + 1, y + 1))
            return out

        return 1 + best(0, 0)

    return size(0, 0) if a.labels[0] == b.labels[0] else 0


def random_tree(r, n):
    labels, parents = ["r"], [-1]
    for i in range(1, n):
        labels.append(r.choice("abc"))
        parents.append(r.randrange(i))
    return H.Skeleton(labels, parents)


def test_tree_matching_equals_the_recursion():
    r = random.Random(1)
    for _ in range(200):
        a, b = random_tree(r, r.randint(1, 12)), random_tree(r, r.randint(1, 12))
        pairs = H.simple_tree_matching(a, b)
        assert len(pairs) == naive_match(a, b)
        assert len(set(pairs.values())) == len(pairs)
        for i, j in pairs.items():
            assert a.labels[i] == b.labels[j] and (i == 0) == (j == 0)
            assert i == 0 or pairs[a.parents[i]] == b.parents[j]


@pytest.mark.parametrize("text,blocks", [
    ("<article><h1>A &amp; B</h1><p>one\n two<b>bold</b><br>x<p>three</article>", ["A & B", "one twobold x", "three"]),
    ("<main><div class='comments'>no</div><p>yes</p></main><aside>no</aside>", ["yes"]),
    ("<nav>no</nav><div class='ad'>no</div><p>yes<script>no</script></p><form>no</form><style>no</style>", ["yes"]),
    ("<header><h1>Site</h1></header><article><header><h1>Head</h1></header><p>&lt;b&gt; &#233;&nbsp;x</p></article>", ["Head", "<b> é x"]),
    ("<p>a<p>b</div></span>c<ul><li>d<li>e</ul>", ["a", "b", "c", "d", "e"][:1] + ["bc", "d", "e"]),
    ("<div id='cookie-notice'>no</div><article>t<!-- c > --></article>", ["t"]),
    ("plain text only", ["plain text only"]), ("", []), ("<b" * 50, None), ("<p>x" + "<b>" * 5000 + "deep", ["xdeep"]),
    ("<a title='1 > 0' href=\"x\">link</a>", ["link"])])
def test_blocks_of_one_page(text, blocks):
    got = H.main_text(text, None, frozenset(), -1)
    if blocks is not None:
        assert got == "\n\n".join(blocks)


def test_template_goes_and_slots_stay(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    shell = ("<div class='top'>Always the same banner</div><div class='story'>{}</div><div class='end'>Read more every day</div>")
    rows, want = [], {}
    for i in range(30):
        paras = [" ".join(r.choices(words, k=12)) for _ in range(r.randint(1, 4))]
        rows.append((i, f"http://plain.example/{i}", page(i, "".join(f"<p>{p}</p>" for p in paras), shell), "x", "x"))
        want[i] = "\n\n".join(paras)
    copy = page(99, "<p>the same copy</p>", shell)  # many copies of one page are one page for the wrapper
    rows += [(100 + i, f"HTTP://plain.example/c{i}", copy, "x", "x") for i in range(60)]
    want |= {100 + i: "the same copy" for i in range(60)}
    odd = [(200, None, None), (201, "", ""), (None, "http://odd.example", "<p>x</p>"), (203, "http://one.example/a", page(1, "<p>only</p>")),
           (204, "http://plain.example/other", "<table><tr><td>quite another</td></tr></table>"), (205, "nohost", "a"),
           (205, "nohost", "a"), (206, "http://long.example", "<p>" + "word " * 60_000 + "</p>")]
    rows += [(*o, "x", "x") for o in odd]
    want |= {200: "", 201: "", None: "x", 203: "only", 204: "quite another", 205: "a", 206: ("word " * 60_000).strip()}
    got = H.extract(spark.createDataFrame(rows, PAGES).repartition(4)).collect()
    assert len(got) == len(rows)
    assert {g.page_id: g.text for g in got} == want
    assert all(g.n_chars == len(g.text) for g in got)
    assert H.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("text,blocks", [
    ("<div class='content-sidebar-wrap'><article><p>yes</p></article></div>", ["yes"]),
    ("<body class='comments-open'><div id='page' class='has-sidebar'><p>yes it is</p></div></body>", ["yes it is"]),
    ("<body><form action='x'><nav>no</nav><div><p>a whole page</p><p>in a form</p></div></form></body>", ["a whole page", "in a form"]),
    ("<form><main><p>yes</p></main></form><p>no</p>", ["yes"]),
    ("<article><h2 id='related-work'>Related work</h2><section id='search-algorithm'><p class='notice'>Note</p></section></article>",
     ["Related work", "Note"]),
    ("<article><p data-id='ad' data-role='share'>yes</p><div class='share'>no</div></article>", ["yes"]),
    ("<div class='sidebar'><article>no</article></div><div><p>the text of a page without an article</p></div>",
     ["the text of a page without an article"]),
    ("<div><p>short</p></div><div class='comments'><p>comments of many, many words</p></div>", ["short"])])
def test_marked_frames_are_no_boilerplate(text, blocks):
    assert H.main_text(text, None, frozenset(), -1) == "\n\n".join(blocks)


@pytest.mark.parametrize("inside,kept", [
    ("<section class='search-engine-history'><p>text</p></section>", True), ("<table class='menu'><tr><td>text</td></tr></table>", True),
    ("<p class='related'>text</p>", True), ("<div class='text share-price'>text</div>", True),
    ("<div id='alert-fatigue'>text</div>", True), ("<p class='related'>See <a href='x'>text and more</a></p>", False),
    ("<div class='notice'>text</div>", False), ("<div class='alert alert-box'>text</div>", False),
    ("<div class='post-share'>text</div>", False), ("<ul class='related-posts'><li>text</li></ul>", False),
    ("<div class='social-media'>text</div>", False), ("<p class='advert'>text</p>", False), ("<div class='comment-thread'>text</div>", False)])
def test_class_words_inside_an_article(inside, kept):
    got = H.main_text(f"<article><p>before</p>{inside}<p>after</p></article>", None, frozenset(), -1)
    assert got.split("\n\n") == ["before", "text", "after"] if kept else got.split("\n\n") == ["before", "after"]


def test_copies_do_not_vote_their_article_into_the_template(spark):
    shell = "<div class='top'>Always the same banner</div><div class='ads'><b>{}</b></div><article>{}</article>"
    rows, want = [], {}
    for i in range(10):
        copy, other = "the article that was copied many times", f"article number {i} has its own words"
        quote = ("<blockquote>same quote</blockquote>" if i < 4 else f"<blockquote>quote {i}</blockquote>") if i < 7 else ""
        rows += [(100 + i, f"http://c.example/{i}", page(0, shell.format(f"buy {i}", f"<p>{copy}</p>"), "{}"), "x", "x"),
                 (i, f"http://c.example/o{i}", page(0, shell.format(f"buy {i}", f"<p>{other}</p>{quote}"), "{}"), "x", "x")]
        want |= {100 + i: copy, i: other + (f"\n\nquote {i}" if 4 <= i < 7 else "")}
    got = {g.page_id: g.text for g in H.extract(spark.createDataFrame(rows, PAGES).repartition(4)).collect()}
    assert got == want
