"""Page text: structure, host boilerplate, shards, awkward pages."""

import time
import random

import numpy as np
import pytest

from usagelens.llm import html


@pytest.fixture
def make_pages(spark):
    def make(rows):
        full = [(*r, "noise", 1, True) for r in rows]
        kinds = "page_id long, url string, html string, text string, row_id long, declared boolean"
        return spark.createDataFrame(full, kinds)

    return make


def test_a_marked_article(make_pages):
    page = (
        "<html><head><title>no</title><style>p{}</style><script>x='</p>'</script></head><body>"
        "<nav><ul><li>menu</li></ul></nav><!-- no --><div class='ad'>buy<div>more</div></div>"
        "<article><h1>A &amp; B</h1><p>one <b>two\n\n three<br>four<p>five</p>"
        "<aside>side</aside><form><p>form</p></form><div id=comments><p>said</p></div>"
        "<ul><li>x &lt;b&gt;</li><li>y</li></ul></article><footer>foot"
    )
    rows = html.main_text(make_pages([(1, "http://h.org/1", page)])).collect()
    want = "A & B\n\none two three four\n\nfive\n\nx <b>\n\ny"
    assert [(r["page_id"], r["text"]) for r in rows] == [(1, want)]


def _plain_repeated(tokens, pages, n):
    seen = {}
    for i in range(len(tokens) - n + 1):
        if pages[i] == pages[i + n - 1]:
            seen.setdefault(tuple(tokens[i : i + n]), set()).add(pages[i])
    out = [False] * len(tokens)
    for i in range(len(tokens) - n + 1):
        if pages[i] == pages[i + n - 1] and len(seen[tuple(tokens[i : i + n])]) > 1:
            out[i : i + n] = [True] * n
    return out


def test_suffix_array_finds_all_repeats():
    rng = random.Random(41)
    for _ in range(60):
        tokens, pages = [], []
        phrase = rng.choices(range(5), k=12)
        for page in range(rng.randint(1, 8)):
            body = rng.choices(range(3), k=rng.randint(0, 30)) + phrase * rng.randint(0, 1)
            tokens += body
            pages += [page] * len(body)
        found = html.repeated(np.array(tokens, np.int64), np.array(pages, np.int64))
        assert found.tolist() == _plain_repeated(tokens, pages, html.RUN)


@pytest.mark.parametrize("shard", [500_000, 40])
def test_pages_without_an_article_keep_unique_runs(make_pages, words, monkeypatch, shard):
    """What a host repeats goes, within one shard and across several."""
    monkeypatch.setattr(html, "SHARD", shard)
    rng = random.Random(42)
    notice = "we use small files to make this site work better for you"
    own = {i: words(rng, 30) for i in range(8)}
    rows = [(i, f"http://a.org/{i}", f"<p>{notice}</p><p>{t}</p>") for i, t in own.items()]
    rows.append((50, "http://b.org/", f"<p>{notice}</p>"))
    out = {r["page_id"]: r["text"] for r in html.main_text(make_pages(rows)).collect()}
    assert out == {**own, 50: notice}


@pytest.mark.parametrize("shard", [500_000, 40])
def test_copies_of_a_page_keep_their_text(make_pages, words, monkeypatch, shard):
    monkeypatch.setattr(html, "SHARD", shard)
    rng = random.Random(43)
    notice = "we use small files to make this site work better for you"
    own = {i: words(rng, 30) for i in range(3)}
    rows = [(i, "http://a.org/", f"<p>{notice}</p><p>{own[i % 3]}</p>") for i in range(60)]
    out = {r["page_id"]: r["text"] for r in html.main_text(make_pages(rows)).collect()}
    assert out == {i: own[i % 3] for i in range(60)}


@pytest.mark.parametrize(
    "name, kept",
    [
        ("share-price", True),
        ("search-and-rescue", True),
        ("notice-period-law", True),
        ("share-buttons", False),
        ("post sidebar_left", False),
        ("related-posts", False),
        ("cookie-banner2", False),
    ],
)
def test_names_that_only_hold_a_mark_drop_nothing(name, kept):
    page = f"<article><p>a</p><div class='x {name}'>b</div></article>"
    assert ("main", "b") in html.blocks(page) if kept else ("main", "b") not in html.blocks(page)


def test_awkward_pages(make_pages):
    rows = [
        (1, None, None),
        (2, "u", ""),
        (3, "http://x.org", "<<<p <b>text & more &nosuch; &#x41;"),
        (4, "http://x.org", "<article>" + "<div>" * 2000 + "deep"),
        (5, "http://x.org", "<p>" + "word " * 50000 + "</p>"),
        (5, "http://x.org", "<script>never closed <p>x"),
        (None, "http://y.org", "plain"),
        (6, "http://y.org", "<a href='" * 300),
    ]
    out = html.main_text(make_pages(rows)).collect()
    assert len(out) == len(rows)
    by_id = {r["page_id"]: r["text"] for r in out if r["page_id"] != 5}
    assert by_id[1] == by_id[2] == "" and by_id[4] == "deep" and by_id[None] == "plain"
    assert sorted(len(r["text"]) for r in out if r["page_id"] == 5) == [0, 249999]
    assert html.main_text(make_pages([])).count() == 0


def test_letters_that_grow_in_lower_case_move_nothing():
    page = "<main><p>" + "\u0130" * 40 + "</p><SCRIPT>var x = 1;</Script><p>KEEP this sentence of text.</p></main>"
    assert html.blocks(page) == [("main", "\u0130" * 40), ("main", "KEEP this sentence of text.")]


def test_formulas_and_objects_keep_their_text():
    page = "<article><p>Energy is <math><mi>E</mi></math> here.</p><object>Shown instead.</object></article>"
    assert " ".join(t for _, t in html.blocks(page)) == "Energy is E here. Shown instead."


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a "<a" ', "<", "</a", "<!", "<a b='"])
def test_unclosed_tags_take_linear_time(piece):
    page = piece * (2_000_000 // len(piece))
    start = time.perf_counter()
    html.blocks(page)
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize("shard", [500_000, 900, 40])
def test_blocks_that_nearly_all_articles_of_a_host_have_go(make_pages, words, monkeypatch, shard):
    """Unnamed notices in articles go; quotations, passages of few articles and copies stay."""
    monkeypatch.setattr(html, "SHARD", shard)
    rng = random.Random(44)
    notice = "read on every day and tell all your friends about us"
    calls = ["write to us", "tell us what you think of it"]
    quoted = "a saying that some of the articles here quote word for word"
    bodies = {i: [words(rng, 30), words(rng, 40)] for i in range(40)}
    rows, want, copies = [], {}, {5: 9, 6: 100}
    for i, (first, second) in bodies.items():
        kept = [first, *([quoted] if i % 2 else []), f"{second} {notice}" if i == 3 else second]
        parts = [*kept[:-1], notice, *calls, kept[-1]]
        body = "".join(f"<p>{p}</p>" for p in parts)
        rows += [(i, "http://a.org/", f"<article>{body}</article>{words(rng, 9)}")] * copies.get(i, 1)
        want[i] = "\n\n".join(kept)
    # On a host of few articles nothing is judged.
    rows += [(100 + i, "http://b.org/", f"<main><p>{words(rng, 20)}<p>{notice}</main>") for i in range(4)]
    # Near copies are not boilerplate of each other.
    copied = words(rng, 60)
    near = {200 + i: f"{copied} {words(rng, 3)}\n\n{copied}" for i in range(20)}
    rows += [(i, "http://c.org/", "<article><p>" + t.replace("\n\n", "<p>")) for i, t in near.items()]
    found = html.main_text(make_pages(rows)).collect()
    out = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows)
    assert {i: out[i] for i in want} == want
    assert all(out[100 + i].endswith(f"\n\n{notice}") for i in range(4))
    assert {i: out[i] for i in near} == near
