"""Chat formatting, HTML, mixing, search and the pipeline."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import ann, chat, html, mixing, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def turns_of(df):
    out = {}
    for r in df.orderBy("conv_id", "ord", "idx").collect():
        out.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    return out


def test_layouts_of_records(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": 1}),
        (2, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}),
        (3, {"instruction": "do", "input": "this", "output": "done"}),
        (4, {"instruction": "do", "input": "", "output": "done", "id": 5}),
        (5, {"prompt": "p", "completion": "c"}),
        (6, {"unknown": 1}),
        (7, {"messages": []}),
        (8, {"question": "é\n\"x\"", "answer": "\\ok"}),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records] + [(9, "{broken"), (10, None)], "conv_id long, record string")
    assert turns_of(chat.canonical_turns_of_json(df, "conv_id", "record")) == {
        1: [("user", "q"), ("assistant", "a")],
        2: [("user", "q"), ("assistant", "")],
        3: [("user", "do\n\nthis"), ("assistant", "done")],
        4: [("user", "do"), ("assistant", "done")],
        5: [("user", "p"), ("assistant", "c")],
        8: [("user", 'é\n"x"'), ("assistant", "\\ok")],
    }


def test_layout_of_a_schema(spark):
    df = spark.createDataFrame([(1, [("user", "q")], "junk")], "conv_id long, messages array<struct<role:string,content:string>>, role string")
    assert chat.layout_of(chat.schema_paths(df.schema)).name == "messages"
    assert turns_of(chat.canonical_turns(df, "conv_id")) == {1: [("user", "q")]}
    assert chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, other int"), "conv_id").collect() == []
    both = spark.createDataFrame([(1, 1, [("user", "no")], "gpt", "b"), (1, 0, None, "human", "a")], "conv_id long, turn long, messages array<struct<role:string,content:string>>, role string, text string")
    assert turns_of(chat.canonical_turns(both, "conv_id", "turn")) == {1: [("human", "a"), ("gpt", "b")]}
    assert turns_of(chat.canonical_turns(both, "conv_id", "turn", layout="messages")) == {1: [("user", "no")]}
    assert chat.fingerprint(["text", "role", "conv_id"]) == chat.fingerprint(["role", "text"]) != chat.fingerprint(["text"])


def test_format_is_reversible_and_marks_the_loss(spark):
    rng = random.Random(1)
    parts = ["\\", "0", "1", "2", "<", "|", "<|turn|>", "<|end|>\n", "</s>", "[INST]", "[/INST]", "\n", "é", "<<SYS>>", "a", "\\1"]
    say = lambda: "".join(rng.choices(parts, k=rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", say()]), say()) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(100, 0, None, None), (101, 1, "assistant", "x"), (101, 1, "assistant", "x"), (101, 0, "user", "")]
    done = chat.format_turns(chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", "turn"))
    back = {r["conv_id"]: r for r in done.withColumn("turns", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for c in {r[0] for r in rows}:
        want = [(r or "", t or "") for _, r, t in sorted(((x[1], x[2], x[3]) for x in rows if x[0] == c), key=lambda x: (x[0], x[1] or "", x[2] or ""))]
        got = back[c]
        assert [(t["role"], t["text"]) for t in got["turns"]] == want
        assert [i for i, (r, _) in enumerate(want) if r == "assistant"] == got["loss_turns"]
        assert got["loss"] == "".join(t for r, t in want if r == "assistant")
        bodies = [got["formatted"][s["start"] : s["end"]] for s in got["loss_spans"]]
        assert [b.replace("\\1", "").replace("\\2", "\n").replace("\\0", "\\") for b in bodies] == [t for r, t in want if r == "assistant"]
        inside = got["formatted"].replace(chat.TURN, "").replace(chat.END, "")
        assert not any(x in inside for x in chat.CONTROL_STRINGS)
    assert chat.format_turns(chat.canonical_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), "conv_id", "turn")).collect() == []


def test_minimum_cut_is_minimal():
    rng = random.Random(3)
    for trial in range(150):
        n = rng.randint(1, 9)
        score = [rng.choice([-2.0, -0.5, 0.0, 0.7, 1.5]) for _ in range(n)]
        edges = [(i, j, rng.choice([0.2, 0.6, 1.1])) for i in range(n) for j in range(i) if rng.random() < (0.25, 0.5, 0.9)[trial % 3]]
        cost = lambda labels: sum(max(-s, 0) if x else max(s, 0) for s, x in zip(score, labels, strict=True)) + sum(w for a, b, w in edges if labels[a] != labels[b])  # noqa: E731, B023
        all_ = {k: cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n)}
        best = min(all_.values())
        most = 0
        for k, c in all_.items():
            most |= k if c < best + 1e-9 else 0  # minimum cuts are closed under union
        assert html.minimum_cut(score, edges) == [bool(most >> i & 1) for i in range(n)]


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header>
    <div class="sidebar"><p>Some long sidebar text that goes on and on, really quite long, like a paragraph would be.</p></div>
    <div id="content"><h2>Title &amp; more</h2><p>First <b>bold</b> and <a href=x>a link</a>, words.<p>Second&nbsp;para<br>line two</p>
    <form><p>Subscribe now to our letter, please do.</p></form><blockquote>Quote it.</blockquote><pre>a\n  b</pre></div>
    <section class="comments"><p>I really liked this article, thanks a lot for writing it.</p></section>
    <div class="cookie-notice">We use cookies.</div><script>if(a<b){document.write("<p>x</p>")}</script><footer>&copy; 2020</footer></body></html>"""
    assert html.main_text(page) == "Title & more\n\nFirst bold and a link, words.\n\nSecond para line two\n\nQuote it.\n\na b"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>  </p>") == ""
    assert html.main_text("<article><h1>H</h1><p>Be.</p><p>Ä&#228;&lt;b&gt;</article><nav><a href=x>menu</a></nav>") == "H\n\nBe.\n\nÄä<b>"
    assert html.main_text("<article><p>" + "word " * 50000 + "</p></article>") == ("word " * 50000).strip()


def test_main_text_of_pages_without_content_names():
    long = "<p>" + "The kitchen was warm while the family talked about the garden and the trip. " * 4 + "</p>"
    text = " ".join(long[3:-4].split())
    page = lambda *parts: "<html><body><div>" + "".join(parts) + "</div></body></html>"
    short = ["She baked cookies for the fair.", "They log in at noon.", "Read more books!"]
    for s in short:
        assert html.main_text(page("<h1>How to bake cookies</h1>", f"<p>{s}</p>", long, f"<p>{s}</p>", long, f"<p>{s}</p>")).split("\n\n") == ["How to bake cookies", s, text, s, text, s]
        assert html.main_text(page(f"<h2>How to subscribe</h2><p>{s}</p>")) == f"How to subscribe\n\n{s}"
    items = ["2 eggs", "flour", "salt", "50 g butter", "1 lemon", "milk 20 ml", "cocoa", "sugar", "yeast"]
    listed = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    for parts, want in (((long, listed, long), [text, *items, text]), ((long, listed), [text, *items]), ((listed, long), [*items, text])):
        assert html.main_text(page(*parts)).split("\n\n") == want
    assert html.main_text(page("<p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='TeX'>x=2</annotation></semantics></math> be given.</p>", long)) == f"Let x = 2 be given.\n\n{text}"
    assert html.main_text(page("<p>A <math aria-hidden='true'><mi>y</mi></math>proof <math/>follows.</p>")) == "A proof follows."
    # With other evidence a cue still counts.
    for banner in ("<div><p>We use cookies.</p></div>", "<p><a href=x>Log in</a> or <a href=y>subscribe</a></p>"):
        assert html.main_text(f"<html><body>{banner}<div><div>{long}{long}</div></div><p>&copy; 2020 All rights reserved</p></body></html>") == f"{text}\n\n{text}"


LONG = "The kitchen was warm while the family talked about the garden and the trip they had planned. " * 3
MENU = "<ul>" + "".join(f"<li><a href=/{x}>{x}</a></li>" for x in ("Home", "News", "Sport", "Contact")) + "</ul>"


def decided(page):
    """The text of the cut and that of the classifier alone."""
    blocks, score, content = html.labelled(page)
    return [b.text for b, x in zip(blocks, content, strict=True) if x], [b.text for b, x in zip(blocks, score, strict=True) if x >= 0]


def test_the_cut_decides_where_the_classifier_is_wrong():
    """No names at all: comments, an advert between menus, and a short line inside an article, each right by its surroundings only."""
    p, text = f"<p>{LONG}</p>", " ".join(LONG.split())
    comment = "<div><p>Anna 3 days ago</p><p>I loved this recipe and will try it.</p><p><a href=x>Reply</a></p></div>"
    cut, alone = decided(f"<body><div><h1>A trip</h1>{p}{p}{p}</div><div>{comment}{comment}</div></body>")
    assert cut == ["A trip", text, text, text] and "I loved this recipe and will try it." in alone
    advert = "<p>Our new shoes are light and strong, they are made for long walks and short runs, come in and try them.</p>"
    cut, alone = decided(f"<body><div>{MENU}{advert}{MENU}</div><div>{p}{p}{p}{p}</div></body>")
    assert cut == [text] * 4 and advert[3:-4] in alone
    for line in ("<p><a href=x>The list of all plants in the garden</a></p>", "<p>They log in, and he wrote:</p>", "<div><a href=x>A picture of the garden</a></div>"):
        cut, alone = decided(f"<body><div>{p}{line}{p}</div></body>")
        words_ = re.sub("<[^>]*>", "", line)
        assert cut == [text, words_, text]
        assert words_ not in alone or "wrote" in words_
    assert decided(f"<body><nav>{MENU}</nav><p>One short text is all.</p><footer>End of it.</footer></body>")[0] == ["One short text is all."]
    assert html.main_text(f"<article><p>A <object>formula as text</object> stays.</p><dialog><p>Notice here.</p></dialog>{p}</article>").startswith("A\n\nformula as text\n\nstays.")


def plain_page(rng):
    """A page whose containers have no class names and no article tag: (html, blocks of its article)."""
    say = lambda n: " ".join(rng.choice(("river", "stone", "the", "a", "walk", "old", "light", "of", "green", "under", "he", "sang", "door")) for _ in range(n)).capitalize()
    blocks, body = [], []
    for _ in range(rng.randint(4, 12)):
        kind = rng.choice("ppppplhq")
        if kind == "l":
            items = [say(rng.randint(1, 4)) for _ in range(rng.randint(2, 5))]
            blocks += items
            body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            continue
        text = say(rng.randint(20, 80)) + "." if kind == "p" else say(rng.randint(2, 6)) + ("." if kind == "q" else "")
        blocks.append(text)
        body.append(f"<h2>{text}</h2>" if kind == "h" else f"<p>{text}</p>")
    head = say(5)
    links = lambda n: "<ul>" + "".join(f"<li><a href=/>{say(rng.randint(1, 3))}</a></li>" for _ in range(n)) + "</ul>"
    comments = "".join(f"<div><p>{say(1)} {rng.randint(2, 9)} days ago</p><p>{say(rng.randint(4, 14))}.</p><p><a href=x>Reply</a></p></div>" for _ in range(rng.randint(0, 4)))
    advert = f"<div>{links(3)}<p>{say(12)}.</p>{links(3)}</div>" if rng.random() < 0.5 else ""
    page = f"<html><body><div>{links(6)}</div>{advert}<div><div><h1>{head}</h1>{''.join(body)}</div></div><div>{comments}</div><div><p>&copy; 2021 {say(3)}</p>{links(3)}</div></body></html>"
    return page, [head, *blocks]


def test_pages_without_any_names():
    """Blocks right and wrong over generated pages; the cut changes some labels and does better than the classifier alone."""
    rng = random.Random(11)
    cut_wrong = alone_wrong = changed = total = 0
    for _ in range(150):
        page, want = plain_page(rng)
        blocks, score, content = html.labelled(page)
        assert Counter(b.text for b, c in zip(blocks, content, strict=True) if c) == Counter(want)
        right = Counter(want)
        for b, s, c in zip(blocks, score, content, strict=True):
            is_text = right[b.text] > 0
            right[b.text] -= is_text
            cut_wrong += c != is_text
            alone_wrong += (s >= 0) != is_text
            changed += c != (s >= 0)
            total += 1
    assert changed > 0.02 * total and cut_wrong < 0.02 * total and cut_wrong < alone_wrong / 3, (cut_wrong, alone_wrong, changed, total)


def test_long_and_deep_pages_take_seconds():
    import time

    unit = "<p>" + "word " * 30 + "</p><p><a href=x>" + "menu " * 6 + "</a></p>"
    start = time.perf_counter()
    assert html.main_text("<html><body><div>" + unit * (4_000_000 // len(unit)) + "</div></body></html>")
    assert html.main_text("<div>" * 100_000 + "<p>Text here.</p>" * 10 + "</div>" * 50_000 + "<p>More.</p>")
    assert time.perf_counter() - start < 30


WORDS = "the old harbour lay quiet under a pale sky and no boat had left its place since the storm".split()


def inline_page(seed):
    """(html, text): a page whose paragraphs hold inline elements with classes, styles and hidden parts, and attributes that speak of such."""
    rng = random.Random(seed)
    shown, said = [], []
    for _ in range(rng.randint(2, 6)):
        html_parts, text_parts = [], []
        for w in rng.choices(WORDS, k=rng.randint(15, 40)):
            kind = rng.randrange(24)
            mark = {0: f'<em class="promo">{w}</em>', 1: f'<span class="comment">{w}</span>', 2: f'<span title="the hidden gem" data-x="a role=menu">{w}</span>', 3: f'<b style="color:red">{w}</b>', 4: f'<span class="x"><span class="ad">{w}</span></span>', 5: f'<code class="nav">{w}</code>'}
            html_parts.append(mark.get(kind, w))
            text_parts.append(w)
            if kind == 6:
                html_parts.append('<span style="display: none">unseen <b>words</b> <span>here</span></span>')
            elif kind == 7:
                html_parts.append('<span hidden>unseen</span><button class="btn">press</button>')
        attribute = rng.choice(["", ' title="the hidden gem"', " data-role='navigation menu'", ' lang="en"'])
        shown.append(f"<p{attribute}>{' '.join(html_parts)}</p>")
        said.append(" ".join(text_parts))
    menu = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="share"><span class="share">Share this</span></div>'
    return f"<html><body>{menu}<div><h1>{' '.join(WORDS[:5])}</h1>{''.join(shown)}</div><footer>© 2020</footer></body></html>", "\n\n".join([" ".join(WORDS[:5]), *said])


def test_inline_elements_keep_their_text():
    extract = lambda body: html.main_text(f"<html><body><article><h1>A title of the page</h1>{body}<p>{' '.join(WORDS)}</p></article></body></html>").split("\n\n")[1]
    assert extract('<p>Before <span style="display:none">x</span> after the span. And it goes on.</p>') == "Before after the span. And it goes on."
    assert extract('<p>Before <span class="comment">x</span> after the span. And it goes on.</p>') == "Before x after the span. And it goes on."
    assert extract('<p>He said <em class="promo">now</em> and left the house at once.</p>') == "He said now and left the house at once."
    assert extract('<p title="the hidden gem">He said now and left the house.</p>') == "He said now and left the house."
    assert extract("<p>Press <button>OK</button> to go on with the reading of this.</p>") == "Press to go on with the reading of this."
    assert extract('<p>An unclosed <span style="display:none">x</p><p>second paragraph of the page is seen</p>') == "An unclosed"
    for seed in range(60):
        page, text = inline_page(seed)
        assert html.main_text(page) == text


def test_pages_table_gives_the_articles(spark):
    import html as references

    pages = {r["page_id"]: r for r in queries.table(spark, SF, "pages").collect()}
    for r in queries.op2_extract_html(spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(references.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_pages_of_odd_tables(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>Hello there, this is a text.</p>")]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3))).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "Hello there, this is a text.", 28), (1, "", 0), (1, "", 0)]
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_poisson_counts_follow_the_inverse_distribution(spark):
    rates = (0.05, 0.7, 3.0, 900.0, 5000.0)
    found = {r["source"]: r["cdf"] for r in mixing.poisson_cdf(spark.createDataFrame([(str(x), x) for x in rates] + [("none", 0.0), (None, 2.0)], "source string, rate double")).collect()}
    assert set(found) == {*map(str, rates), None}
    for rate in rates:
        cdf = found[str(rate)]
        k = int(rate)
        assert abs(cdf[k] - sum(math.exp(-rate + i * math.log(rate) - math.lgamma(i + 1)) for i in range(k + 1))) < 1e-9 and cdf[-1] > 1 - 1e-9


def test_mixing(spark):
    rows = [(i, "t", "en", "big" if i % 10 else "small", 1) for i in range(4000)] + [(9001, None, None, None, None), (9002, "", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.poisson_replicate(docs, {"big": 1.0, "small": 1.0, None: 0.0})
    share = Counter(r["source"] for r in got.collect())
    assert None not in share and abs(share["big"] - 2001) < 200 and abs(share["small"] - 2001) < 200
    again = mixing.poisson_replicate(docs.repartition(7), {"big": 1.0, "small": 1.0, None: 0.0})
    assert sorted((r["doc_id"], r["copy"], r["place"]) for r in got.collect()) == sorted((r["doc_id"], r["copy"], r["place"]) for r in again.collect())
    copies = {}
    for r in got.collect():
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(c) == list(range(len(c))) for c in copies.values())
    assert mixing.poisson_replicate(docs.limit(0)).collect() == [] and mixing.poisson_replicate(docs, {}).collect() == []
    assert {r["source"] for r in mixing.poisson_replicate(docs, epochs=50.0).collect()} == {"big", "small", None}


def test_multi_sequence_walk_is_in_order():
    rng = np.random.default_rng(1)
    a, b, counts = rng.random(5), rng.random(4), rng.integers(0, 9, (5, 4))
    total = (a[:, None] + b[None]).ravel()
    order = np.argsort(total)
    for target in (1, 20, 60, counts.sum()):
        at = ann.walk(a, b, counts, target)
        held = np.cumsum(counts.ravel()[order])
        n = int(np.searchsorted(held, target)) + 1
        assert at == total[order[n - 1]]


def test_lists_are_packed_in_blocks():
    counts = np.array([3, 4, 0, 9, 2, 25, 1])
    block, parts = ann.packed(counts, 10)
    assert (np.diff(block) >= 0).all() and len(parts) == block[-1] + 1
    for b in range(len(parts)):
        held = counts[block == b].sum()
        assert parts[b] == max(1, -(-held // 10)) and ((block == b).sum() == 1 or held <= 10)


def test_cell_bounds_exclude_no_entry():
    rng = np.random.default_rng(2)
    x = ann._unit(rng.normal(size=(300, 6)))
    index = ann.Index(3, ann.kmeans(x[:, :3], 5), ann.kmeans(x[:, 3:], 5))
    to = index.halves(x)
    at = [t.argmin(1) for t in to]
    for side in (0, 1):
        for c in range(5):
            mine = np.sqrt(to[side].min(1))[at[side] == c]
            index.near[side][c], index.far[side][c] = mine.min(), mine.max()
    q = ann._unit(rng.normal(size=(40, 6)))
    low = index.bounds(index.halves(q))
    real = ((q[:, None] - x[None]) ** 2).sum(2)
    bound = low[0][:, at[0]] + low[1][:, at[1]]
    assert (bound <= real + 1e-12).all() and bound.max() > 0.1


def nearest_by_hand(rows, k=5):
    out = []
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for q, x in good:
        if q % 50 == 0:
            scored = sorted((-float(np.cumsum(x * y)[-1] / (np.sqrt(np.cumsum(x * x)[-1]) * np.sqrt(np.cumsum(y * y)[-1]))), i) for i, y in good if i != q and len(y) == len(x))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_search_is_exact_on_small_tables(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(7)]) for i in range(300)]
    rows += [(1000 + i, [1.0] * 7) for i in range(20)] + [(2000, [0.0] * 7), (2001, None), (2050, [float("nan")] * 7), (2100, [None] * 7), (None, [1.0] * 7), (2150, [1.0, 2.0]), (2151, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect())
    want = nearest_by_hand(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=1e-15)
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("rows,queries_at_once", [(4096, 4096), (60, 7)])
def test_search_is_exact_whatever_the_blocks(spark, monkeypatch, rows, queries_at_once):
    """Clustered vectors, one vector repeated very often, and rows repeated with their id."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", rows)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", queries_at_once)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    table = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(900)] + [(5000 + i, centres[0]) for i in range(200)] + [(50, centres[1])] * 3
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").repartition(5)
    exact = [(r["vec_id"], list(r["embedding"])) for r in df.dropDuplicates().collect()]
    got = sorted(tuple(r)[:3] for r in ann.search(df, F.col("vec_id") % 50 == 0).collect() if r["query_id"] != 50)
    assert got == [r[:3] for r in nearest_by_hand(exact) if r[0] != 50]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_search_recall(spark, sf):
    """Unstructured vectors of two sizes: the table's own."""
    df = queries.table(spark, f"/root/testdata/{sf}", "embeddings")
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect()}
    want = {(q, i) for q, _, i, _ in nearest_by_hand([(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()])}
    assert got == want


def test_structured_vectors_leave_few_cells():
    rng = np.random.default_rng(6)
    shares = []
    for n in (2000, 20000):
        x = ann._unit(rng.normal(size=(40, 32))[rng.integers(0, 40, n)] + rng.normal(size=(n, 32)) * 0.05)
        k = int(np.sqrt(n) / 2)
        index = ann.Index(16, ann.kmeans(x[:4000, :16], k), ann.kmeans(x[:4000, 16:], k))
        to = index.halves(x)
        i, j = (t.argmin(1) for t in to)
        np.add.at(index.counts, (i, j), 1)
        for side, at in enumerate((i, j)):
            np.minimum.at(index.near[side], at, np.sqrt(to[side].min(1)))
            np.maximum.at(index.far[side], at, np.sqrt(to[side].min(1)))
        q = x[:50]
        fifth = np.sort(2 - 2 * q @ x.T, 1)[:, 5]
        first, second = index.bounds([t[:50] for t in to])
        shares.append(float((first[:, i] + second[:, j] <= fifth[:, None]).mean()))
    assert max(shares) < 0.1


def test_pipeline(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]
    extra = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("text", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, docs.unionByName(extra), SF)
    assert kept.columns == columns and kept.count() == docs.count()
    one = corpus_pipeline.near_dedup(spark, docs, SF)
    assert one.columns == columns and 0 < one.count() < docs.count() and one.select("text").distinct().count() == one.count()
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, SF)
    assert clean.columns == columns
    passages = [r["text"] for r in queries.table(spark, SF, "benchmark").collect()]
    assert not any(p in r["text"] for r in clean.collect() for p in passages)
    mixed = corpus_pipeline.source_mixing(spark, docs, SF)
    assert mixed.columns == columns
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_a_stage_passes_columns_of_any_name(spark, stage):
    docs = queries.table(spark, SF, "documents").where("doc_id < 60")
    clashing = {c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in ("leaks", "score", "lang_pred", "copy", "place", "component_id", "h", "label", "rate", "a.b")}
    run = dict(corpus_pipeline.STAGES)[stage]
    wide = run(spark, docs.withColumns(clashing), SF)
    assert wide.columns == [*docs.columns, *clashing]
    rows = sorted(tuple(map(str, r)) for r in wide.collect())
    plain = run(spark, docs, SF)
    assert rows == sorted(tuple(map(str, r)) for r in plain.withColumns(clashing).collect()) and rows


def pipeline_by_hand(docs, items):
    """(doc_id, start, n_tokens, crc) of the five stages over (id, text, lang, source) rows, each by its plain definition."""
    from tokenizers import Tokenizer

    from tests.llm import test_text_ops as plain

    fold = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    docs = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    first = plain.components_by_hand([(d[0], d[1]) for d in docs], 5, 80)
    docs = [d for d in docs if first[d[0]] == d[0]]
    docs = [d for d in docs if not any(100 * plain.tiles_by_hand(fold(x), fold(d[1]), 5) >= 80 * len(fold(x)) for _, x in items)]
    sizes = Counter(d[3] for d in docs)
    out, start = [], 0
    tokenizer = Tokenizer.from_file(queries.token_vocabulary())
    for i, text, _, source in sorted(docs):
        rate = len(docs) / len(sizes) / sizes[source]
        u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        times, upto = 0, math.exp(-rate)
        while upto <= u:
            times += 1
            upto += math.exp(-rate + times * math.log(rate) - math.lgamma(times + 1))
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for _ in range(times):
            out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    return out


def test_pipeline_matches_its_stages_by_hand(spark, tmp_path):
    rng = random.Random(20)
    pool = {"xx": ["kalo", "mira", "tosa", "beni", "luka", "dore", "sami", "vona"], "yy": ["thrash", "inging", "ouldst", "ghtly", "whelm", "strong", "thence", "shrub"]}
    items = [(k, " ".join(rng.choice(pool["yy"]) + str(rng.randint(0, 99)) for _ in range(12))) for k in range(4)]
    docs = []
    for i in range(90):
        lang = rng.choice(["xx", "yy"])
        w = [rng.choice(pool[lang]) + rng.choice(["", "", str(rng.randint(0, 9))]) for _ in range(rng.randint(6, 40))]
        docs.append((i, " ".join(w), lang, rng.choice("aab")))
    for i in range(90, 130):
        w = docs[rng.randrange(90)][1].split()
        if len(w) > 30 and rng.random() < 0.5:
            w[-1] = "other"
        docs.append((i, " ".join(w), "xx", rng.choice("ab")))
    for i in range(130, 145):
        x = rng.choice(items)[1].split()
        docs.append((i, " ".join(["so", *x[6:], "and", *x[: rng.choice([1, 6])]]), "yy", "b"))
    docs += [(200, None, "xx", "a"), (201, "", "yy", "a"), (202, "12 . 7", None, "b")]
    spark.createDataFrame([(*d, None, "x") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, copy string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = pipeline_by_hand(docs, items)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want and len({r[0] for r in want}) < 100


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_entry_registers_the_queries():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
    assert len(names) == 11 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["op1_chat_format", "op4_mix_sources", "op8_near_duplicates", "op10_nearest_neighbours"])
def test_sql_agrees(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want.fetchall()))
