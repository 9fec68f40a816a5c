"""Main text of pages: markup of many kinds, and repetition against brute force."""

import random

import numpy as np
import pytest

from gridloom.llm import html_extract


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ba", "ri", "to", "mel", "ka", "sun"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_html(spark):
    art = "<article><h1>Title &amp; more</h1><p>Some  <b>bold</b>\n text</p><form>no</form><div class='comments'><p>reader</p></div><p>end</p></article>"
    page = f"<html><head><title>t</title></head><body><nav>menu</nav>{art}<aside>side</aside><footer>foot</footer></body></html>"
    rows = [(1, "http://a/x", page, "z"), (2, "http://a/y", None, "z"), (3, None, "", "z"), (4, "http://b/1", "plain <p>two", "z"), (1, "http://a/x", page, "z")]
    menu = "<div>home about contact news shop blog help login now</div>"
    rows += [(10 + k, f"http://c/{k}", f"{menu}<div>{sentence(random.Random(k), 30)}</div>", "z") for k in range(8)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 13 and text[1] == "Title & more\n\nSome bold text\n\nend" and text[2] == text[3] == "" and text[4] == "plain\n\ntwo"
    assert all(text[10 + k] == sentence(random.Random(k), 30) for k in range(8)) and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_html_runs_of_the_whole_host(spark):
    notice = "<div>this section is closed until the new hall opens again next spring</div>"
    rows = [(k, f"http://d/{k}", f"{notice if k % 10 == 0 else ''}<div>{sentence(random.Random(k), 30)}</div>", "z") for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for shard_pages in (256, 7):  # one shard, and nine of which none has the notice often
        text = {r.page_id: r.text for r in html_extract.extract(df, shard_pages).collect()}
        assert all(text[k] == sentence(random.Random(k), 30) for k in range(60)) and len(text) == 60
    copies = spark.createDataFrame([(k, f"http://e/{k}", f"<div>{sentence(random.Random(1), 30)}</div>", "z") for k in range(5)], df.schema)
    assert {r.text for r in html_extract.extract(copies, 2).collect()} == {sentence(random.Random(1), 30)}


def test_repeated_runs_brute_force():
    rng = random.Random(4)
    pages = [[[rng.choice("abc") for _ in range(40)]] for _ in range(6)]
    for least in (3, 4):
        got = html_extract.covered(pages, least, run=5)
        for p, hit in zip(pages, got):
            want = np.zeros(40, bool)
            for i in range(36):
                if sum(any(q[0][k : k + 5] == p[0][i : i + 5] for k in range(36)) for q in pages) >= least:
                    want[i : i + 5] = True
            assert (hit == want).all()


def test_more_menu_than_article(spark):
    menu = "<div>" + sentence(random.Random(99), 60) + "</div>"
    rows = [(k, f"http://f/{k}", menu + ("" if k == 9 else f"<div>{sentence(random.Random(k), 40)}</div>"), "z") for k in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    text = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert text == {k: "" if k == 9 else sentence(random.Random(k), 40) for k in range(10)}


def test_repetition_beside_the_layout_of_the_tables(spark):
    """Pages like those of the tables, without article, with a notice and a trailer that nothing names."""
    rows, want = [], {}
    for k in range(40):
        rng = random.Random(k)
        title, one, two = sentence(rng, 9), sentence(rng, 50), sentence(rng, 30)
        note, trailer = sentence(random.Random(1000 + k % 8), 15), sentence(random.Random(2000), 20)
        nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in sentence(rng, 5).split())
        top = f'<html><head><title>{title}</title><script>var t="</p>";</script></head><body><nav><ul>{nav}</ul></nav>'
        rows.append((k, f"http://g/{k}", f'{top}<div>{note}</div><div class="ad">{sentence(rng, 9)}</div><h1>{title}</h1><p><b>{one}<br><p>{two}</p><div>{trailer}</div><footer>&copy; g</body>'))
        want[k] = f"{title}\n\n{one}\n\n{two}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df, 16).collect()} == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h1>T</h1><p class=ad>buy<p>Real one.<p>Real two.</article>", ["T", "Real one.", "Real two."]),
        ("<article><header><h1>T</h1><p>lead</p></header><p>body</p></article>", ["T", "lead", "body"]),
        ("<header><h1>Site</h1></header><article><p>body</p></article>", ["body"]),
        ("<article>teaser</article><div><p>the long main text of a page</p></div>", ["teaser", "the long main text of a page"]),
        ("<article><h2 id=related>Related work</h2><section id=notice>of notice</section></article>", ["Related work", "of notice"]),
        ("<ul><li class=share>x<li>kept<li>too</ul>", ["kept", "too"]),
        ("<article><p>a</p><ul class='nav'><li>x<ul><li>y</ul><li>z</ul><p>b</article>", ["a", "b"]),
        ("<table><tr><td class=ad>x<td>y<tr><td>z</table>", ["y", "z"]),
        ("<article><div class='reader-comments'><p>c<div>d</div></div>text</article>", ["text"]),
        ("<article>a<aside>x</article><p>b</p>", ["a"]),
        ("a &lt;b&gt; &amp;amp; &eacute;\n\t c", ["a <b> &amp; é c"]),
        ("", []),
        ("<p>only <b>one", ["only one"]),
    ],
)
def test_blocks(page, want):
    assert html_extract.blocks(page)[1] == want


def test_very_long_page():
    framed, found = html_extract.blocks("<article>" + "<p>word word</p>" * 50_000 + "</article>")
    assert framed and len(found) == 50_000


def test_repetition_within_articles(spark):
    """What half of a host's articles have goes, also where no shard of it has all; what some quote stays."""
    rows, want = [], {}
    trailer, quote = sentence(random.Random(5000), 12), sentence(random.Random(5001), 40)
    for k in range(60):
        own = sentence(random.Random(k), 40)
        said = f"<p>{quote}</p>" if k % 4 == 0 else ""
        rows.append((k, f"http://h/{k}", f"<nav>menu</nav><article><h1>t{k}</h1>{said}<p>{own}</p>{f'<div>{trailer}</div>' if k % 5 < 3 else ''}</article>"))
        want[k] = "\n\n".join([f"t{k}", *([quote] if said else []), own])
    rows += [(100 + k, "http://h/again", rows[k][2]) for k in range(60) if k % 5 > 2] * 3  # copies are one page
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard_pages in (256, 9):
        got = html_extract.extract(df, shard_pages).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got if r.page_id < 100} == want
