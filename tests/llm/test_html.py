import time
import tracemalloc
import html as entities
import random
import re

import numpy as np
import pytest

from statloom.llm import html


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><!-- no <p>no</p> -->
    <script>var t = "</p><p>no"</script><nav class="main-menu"><a href=/>Home</a> <a>About&nbsp;us</a></nav>
    <p id=x>One<br>two <b>three
    </b>&amp; four<p>Five &lt;six&gt; &#233;</p><ul><li>a<li>b</ul><img alt="no"><div><div>deep</div>tail</div>
    <select><option>no</select><textarea><p>no</textarea><p>1 < 2 and a<b</p><footer>end"""
    blocks = html.page_blocks(page)
    assert [b.text for b in blocks] == ["Home About us", "One two three & four", "Five <six> é", "a", "b", "deep", "tail", "1 < 2 and a", "end"]
    assert blocks[0].path == ("<html>", "<body>", "<nav>", "main", "menu") and blocks[0].link_chars >= 12
    assert blocks[1].path == ("<html>", "<body>", "<p>", "x")


@pytest.mark.parametrize("page", [None, "", " \n", "<", "<p", "</", "<!--", "<script>", "<a href='x", "<p>\x00</p>", "<div " * 2000, "<b>" * 3000 + "x", "&#xfffffff; &am"])
def test_broken_pages_do_not_fail(page):
    html.page_blocks(page)


def test_gradients_equal_differences():
    draw = np.random.default_rng(0)
    model = html.Labeller(1)
    model.weights = {k: w.astype(np.float64) for k, w in model.weights.items()}
    x, mask = draw.standard_normal((4, 2, html.INPUT)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)
    y, told = (draw.random((4, 2)) < 0.5) * mask, mask.copy()
    told[1, 0] = 0

    def loss():
        z = model.logits(x, mask)
        return float((told * (np.logaddexp(0, z) - y * z)).sum() / told.sum())

    grads = model.gradients(x, mask, y, told)
    for name, g in grads.items():
        w = model.weights[name]
        for _ in range(3):
            at = tuple(draw.integers(0, n) for n in w.shape)
            old, step = w[at], 1e-3
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def article(words, n, extra=""):
    parts = [" ".join(words() for _ in range(random.Random(i * n).randint(3, 60))) + "." for i in range(n)]
    return parts, "".join(f"<p>{entities.escape(p)}</p>{extra if i == 1 else ''}" for i, p in enumerate(parts))


@pytest.fixture(scope="module")
def pages(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abcdefgh&é", k=draw.randint(2, 8)))
    rows, want = [], {}
    for i in range(60):
        parts, body = article(word, 2 + i % 7, '<div class="ad">Buy <a href="/x">this</a></div>')
        menu = "".join(f'<li><a href="/{k}">{entities.escape(word())}</a></li>' for k in range(5))
        page = f"<html><head><title>t</title></head><body><nav><ul>{menu}</ul></nav><article><h1>{'Head'} {i}</h1>{body}</article><footer>&copy; {word().replace('&', '')}</footer></body></html>"
        rows.append((i, f"http://x/{i}", page[: len(page) - (8 if i % 9 == 0 else 0)]))
        want[i] = "\n".join([f"Head {i}", *parts])
    rows += [(100, "u", None), (101, None, ""), (102, "u", "<script>x</script>")]
    want |= {100: "", 101: "", 102: ""}
    return spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING"), rows, want


def test_main_text(pages):
    df, rows, want = pages
    got = {r["page_id"]: r for r in html.main_text(df).collect()}
    right = sum(got[i]["text"] == re.sub(r"[ \n]+", lambda m: m[0][0], w) for i, w in want.items())
    assert len(got) == len(rows) and right >= len(want) - 2
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == dict((i, u) for i, u, _ in rows)[r["page_id"]] for r in got.values())
    assert not any("Buy" in r["text"] for r in got.values())


def test_generated_layouts_held_out():
    draw = np.random.default_rng(77)
    words = [f"w{i}" for i in range(300)]
    made = [html.page_blocks(html._layout(draw, words), labelled=True) for _ in range(420)]
    labels = [[b.label for b in p] for p in made]
    model = html.fit(made[:320], labels[:320])
    found = html.label_pages(model, made[320:])
    pairs = [(bool(a), bool(b)) for p, q in zip(found, labels[320:]) for a, b in zip(p, q)]
    assert sum(a == b for a, b in pairs) >= 0.95 * len(pairs)


def test_no_pages(spark):
    assert html.main_text(spark.createDataFrame([], "page_id BIGINT, url STRING, html STRING")).count() == 0


def test_odd_attributes_and_deep_pages(spark):
    """Values that look like numbers, and nesting beyond any real page: quickly, and in little memory."""
    odd = '<table><tr><td data-label="²">a cell</td><td data-label="' + "9" * 5000 + '">another</td><td data-label=x>one more</td></tr></table>'
    assert [b.text for b in html.page_blocks(odd)] == ["a cell", "another", "one more"]
    assert {b.label for b in html.page_blocks(odd)} == {None}
    pages = [
        "<div>a" * 50_000, "<div class=x>a" * 20_000 + "</span>" * 20_000, "<b>" * 30_000 + "<p>a" * 30_000, "<ul><li>a" * 20_000, "</p>" * 100_000,
    ]
    for page in pages:
        tracemalloc.start()
        start = time.process_time()
        blocks = html.page_blocks(page)
        took, peak = time.process_time() - start, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert took < 10 and peak < 100 << 20  # tracing makes it several times slower
        assert len(blocks) == page.count(">a")
    start = time.process_time()
    assert len(html.page_blocks(pages[0])) == 50_000 and time.process_time() - start < 3


def test_paths_of_blocks_and_their_vectors():
    page = "<div class='a b'><section id=b><p>one</p></section><p class=a>two</div>three"
    one, two, three = html.page_blocks(page)
    assert one.path == ("<div>", "a", "b", "<section>", "b", "<p>") and two.path == ("<div>", "a", "b", "<p>", "a") and three.path == ()
    for block in (one, two):
        want = np.zeros(html.PATH_SIZE)
        tags = [p for p in block.path if p.startswith("<")]
        for name in {*block.path, f"last {tags[-1]}", f"above {tags[-2]}"}:
            at, sign = html._place(name)
            want[at] += sign
        assert (block.inside.vector() == want).all()
