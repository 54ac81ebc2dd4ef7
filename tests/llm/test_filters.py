"""Toxicity, decontamination, language and HTML: brute force, held-out accuracy, edges."""

import html
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigilo.llm import decontaminate, html_text, language, toxicity

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, part int"


def empty(spark, schema=DOC):
    return spark.createDataFrame([], schema)


@pytest.fixture(scope="module")
def taught(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice(("an", "ter", "lo", "mi", "sa", "ne")) for _ in range(rnd.randint(1, 3))) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(rnd.choice(words) for _ in range(40))
        toxic = i % 5 == 0
        rows.append((i, text + (" grukwash and vilbrock " if toxic else ""), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    extra = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "x " * 50_000, "en", "s", 1), (0, rows[0][1], "en", "s", 1), (1003, "mi sa gr0kwash v1lbrock lo", "en", "s", 1), (1004, "lo mi grukwaaaash vilbr0ck sa", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 0.5, 7) for r in rows + extra], DOC)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_and_edges(spark, taught):
    docs, labels = taught
    out = toxicity.score(docs, labels)
    assert set(out.columns) == set(docs.columns) and out.count() == docs.count()
    held = out.join(labels, "doc_id").where(toxicity.fold(F.col("doc_id")) == 0).select("score", "toxic").collect()
    assert held and all((r.score >= 0.5) == bool(r.toxic) for r in held)
    edge = {r.doc_id: r.score for r in out.where("doc_id >= 1000").collect()}
    assert all(0 <= s <= 1 for s in edge.values()) and edge[1000] == edge[1001] < 0.5 and edge[1002] < 0.5


def test_toxicity_without_rows_or_labels(spark, taught):
    docs, labels = taught
    assert toxicity.score(empty(spark), labels).count() == 0
    some = docs.limit(3)
    scores = {r.score for r in toxicity.score(some, empty(spark, "doc_id long, quality int, toxic int")).collect()}
    assert len(scores) == 1
    assert toxicity.clean(docs, labels).columns == docs.columns


def test_decoder(spark):
    docs = spark.createDataFrame([(i, "the idiot saw a moron and a loser in the stupid town") for i in range(50)], "doc_id long, text string")
    m = toxicity.Model(*toxicity.language_model(docs))
    assert m.restored("1d10t") == "idiot" and m.restored("m0r0n") == "moron" and m.restored("stupiiiid") == "stupid"
    assert m.restored("l.o.s.e.r town") == "loser town" and m.restored("a clean town") == "a clean town"


def test_long_text_goes_in_pieces():
    text = ("word " * 10 + "other ") * 20_000
    assert "".join(toxicity.pieces(text)) == text and len(list(toxicity.pieces(text))) > 1
    assert list(toxicity.pieces("x" * (1 << 20))) == ["x" * (1 << 20)] and list(toxicity.pieces("")) == []


ITEMS = [(1, "What is the colour of the quiet river stone in winter light? It is grey and green."), (2, "Seven ships left harbour before the long storm began to turn over the bay."), (3, None), (4, "")]


def test_decontamination_finds_and_leaves(spark):
    rnd = random.Random(1)
    filler = lambda n: " ".join(rnd.choice("alpha beta gamma delta river stone ship storm the of".split()) for _ in range(n))
    rows = [(1, ITEMS[0][1]), (2, filler(300) + " " + ITEMS[1][1].upper() + " " + filler(300)), (3, filler(2000)), (4, None), (5, ""), (6, "the colour of the quiet river"), (1, ITEMS[0][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect())
    assert got == {(1, 1): 2, (2, 2): 1}
    kept = decontaminate.clean(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == docs.columns
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0 and decontaminate.leaks(docs.where("false"), bench).count() == 0


def test_wand_equals_brute_force():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    index = decontaminate.Index([(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 40)))) for i in range(70)])
    for _ in range(60):
        terms = sorted({index.terms[w] for w in rnd.sample(vocabulary, 25) if w in index.terms})
        scores = Counter()
        for t in terms:
            for k, w in zip(index.docs[t], index.impacts[t]):
                scores[k] += w
        for least in (0.2, 0.45, 0.7):
            found = {k for b in range(len(index.longest)) for k, _ in index.search(terms, b, least)}
            assert found == {k for k, s in scores.items() if s >= least}


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def plain_leaks(texts, items):
    """Leaks from scratch: every passage of every text against every item."""
    held = sorted([(i, decontaminate.words_of(t), decontaminate.parts(t)) for i, t in items if t and decontaminate.words_of(t)], key=lambda x: len(x[1]))
    df, mean = Counter(w for _, ws, _ in held for w in set(ws)), sum(len(ws) for _, ws, _ in held) / len(held)
    idf = lambda w: math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5))
    out = {}
    for d, text in texts:
        words = decontaminate.words_of(text or "")
        for k, (item, own, (asked, answer)) in enumerate(held):
            longest = max(len(x[1]) for x in held[k // 8 * 8 : k // 8 * 8 + 8])
            step = max(1, longest // 4)
            weight = {w: idf(w) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, n in Counter(own).items()}
            for a in range(0, len(words), step):
                there = words[a : a + longest + 2 * step]
                score = sum(weight.get(w, 0) for w in set(there)) / sum(weight.values())
                if score < 0.6:
                    continue
                n, whole = min(5, len(own)), [*asked, *answer]
                runs = {" ".join(there[i : i + n]) for i in range(len(there) - n + 1)}
                question = longest_common(asked, there) / len(asked) if asked else 1.0
                if not any(" ".join(whole[i : i + n]) in runs for i in range(len(whole) - n + 1)):
                    question = 0.0
                said = sum((Counter(answer) & Counter(there)).values())
                if score >= 0.6 and question >= 0.8 and said >= max(1, int(0.8 * len(answer) + 1e-9)):
                    out[d, item] = max(out.get((d, item), (0.0,)), (score, question, said / len(answer)))
    return {k: tuple(round(x, 9) for x in v) for k, v in out.items()}


def told(rows):
    return {(r.doc_id, r.item_id): (round(r.score, 9), round(r.question, 9), round(r.answer, 9)) for r in rows}


def changed(rnd, text, share):
    """A text with that share of its words, at random places, changed for others."""
    words = text.split()
    for i in rnd.sample(range(len(words)), round(share * len(words))):
        words[i] = rnd.choice("stead brolk amwen tirrel".split())
    return " ".join(words)


@pytest.fixture(scope="module")
def planted(spark):
    """Documents of sf0.001 and, put between them, benchmark items with a twentieth of their words changed."""
    rnd, small_ = random.Random(8), SF.replace("0.01", "0.001")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_}/benchmark.parquet").collect()]
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_}/documents.parquet").limit(60).collect()]
    filler = " ".join(t or "" for _, t in texts).split()
    edits = [(10_000 + k, " ".join(rnd.choices(filler, k=rnd.randint(0, 60))) + " " + changed(rnd, t, 0.05) + " " + " ".join(rnd.choices(filler, k=60))) for k, (_, t) in enumerate(items)]
    return items, texts + edits + [(20_000, None), (20_001, " ".join(rnd.choices(filler, k=40_000)) + " " + items[0][1])]


def test_leaks_equal_brute_force_however_they_are_dealt(spark, planted, monkeypatch):
    items, texts = planted
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(texts, items)
    assert want and told(decontaminate.leaks(docs.repartition(1), bench).collect()) == want
    assert told(decontaminate.leaks(docs.repartition(40), bench).collect()) == want
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", len(items) // 5)
    monkeypatch.setattr(decontaminate, "TOGETHER", 2)
    got = told(decontaminate.leaks(docs, bench).collect())
    assert set(got) == set(want)  # the same items, whatever the pieces; blocks and so the best passages are others


def test_recall_of_edited_items(planted):
    items, _ = planted
    rnd, found = random.Random(9), 0
    index = decontaminate.Index(items)
    texts = [changed(rnd, t, 0.05) for _, t in items for _ in range(5)]
    for k, hits in enumerate(decontaminate.search([index], texts)):
        found += items[k // 5][0] in {h[0] for h in hits}
    assert found >= 0.95 * len(texts)


def test_language_of_pages(spark):
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    odd = spark.createDataFrame([(-1, None, None), (-2, "no url", ""), (-3, "http://a.de/x", "<html lang=de>")], "page_id long, url string, html string")
    out = language.identify(pages.unionByName(odd), docs, ["de", "en", "es", "fr"]).collect()
    assert len(out) == pages.count() + 3
    real = [r for r in out if r.page_id >= 0]
    assert sum(r.lang == r.declared for r in real) >= 0.97 * len(real)
    by = {r.page_id: r for r in out}
    assert by[-1].declared == "none" and by[-1].host == "" and by[-3].lang == "de" and abs(sum(by[-2].posterior) - 1) < 1e-9
    assert language.identify(pages.where("false"), docs, ["de", "en"]).count() == 0


PAGE = (
    "<html><head><title>T</title><script>var a='</p>';</script></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>"
    "<div class='cookie-notice'>We use cookies</div><div class=content><h1>Head &amp; more</h1><p>First <b>bo</b>ld long paragraph of the text, that goes on.<p>Second one,\n with  space.</p>"
    "<aside>Side</aside></div><div id=comments><p>A reader says something quite long about all of this here.</p></div><form><input value=1>Send</form><footer>(c)</footer></body></html>"
)


def test_html_page():
    assert html_text.main_text(PAGE) == "Head & more First bold long paragraph of the text, that goes on. Second one, with space."


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>", ""), ("plain &lt;", "plain <"), ("<div><p>x</div>y", "x y"), ("<a" * 5, ""), ("<p title=don't>q</p>", "q"), ("<!-- no", "")])
def test_html_edges(page, text):
    assert html_text.main_text(page) == text


STORY = "<h1>Head</h1><p>First long paragraph of the text, that goes on and on.</p><p>Second paragraph, as long as the one ahead of it.</p>"


@pytest.mark.parametrize("start,end", [("<form action=x><input value=1><label>Name</label>", "<button>Send</button></form>"), ("<div class='layout with-sidebar'>", "<div class=sidebar>Side</div></div>"), ("<div class=no-sidebar>", "</div>"), ("<section id=search-results>", "</section>"), ("<form><div class='page has-widget'>", "</div></form>")])
def test_html_wrappers_keep_their_text(start, end):
    page = f"<html><body><nav><a href=x>Home</a></nav>{start}<div class=content>{STORY}</div>{end}<form><input>Send</form></body></html>"
    assert html_text.main_text(page) == "Head First long paragraph of the text, that goes on and on. Second paragraph, as long as the one ahead of it."


def test_html_all_dense_articles_stay_and_link_columns_go():
    part = lambda n: f"<article><p>Part {n} is a long paragraph of the text, that goes on and on without an end.</p><p>It has one more.</p></article>"
    said = lambda n: f"Part {n} is a long paragraph of the text, that goes on and on without an end. It has one more."
    thin = "<article><a href=x>More</a> <a href=y>of it</a></article>"
    assert html_text.main_text(f"<body>{part(1)}{part(2)}{thin}{part(3)}</body>") == " ".join(map(said, (1, 2, 3)))
    links = "<div><ul><li><a href=a>One teaser</a></li><li><a href=b>Another teaser</a></li></ul></div>"
    page = f"<body><main>{links}<div>{STORY}<p>Short <a href=x>link</a> in a text.</p></div>{links}</main></body>"
    assert html_text.main_text(page) == "Head First long paragraph of the text, that goes on and on. Second paragraph, as long as the one ahead of it. Short link in a text."


def densities(root):
    """Composite densities and density sums by the formula, from scratch for every node."""
    nodes = lambda x: [x] + [n for y in x.items if isinstance(y, html_text.Node) and not y.dropped for n in nodes(y)]
    said = lambda x, inside=False: sum((len("".join(y.split())) if inside or x.tag == "a" else 0) if isinstance(y, str) else 0 if y.dropped else said(y, inside or x.tag == "a") for y in x.items)
    body = next((x for x in nodes(root) if x.tag == "body"), root)
    share = said(body) / max(said(body, True), 1)
    out = {}
    for x in nodes(root):
        c, lc, below = said(x, True), said(x), nodes(x)[1:]
        t, lt = max(len(below), 1), max(sum(y.tag == "a" for y in below), 1)
        ahead = (c / max(lc, 1)) * (t / lt)
        out[x] = x.prior * (c / t) * math.log(ahead) / math.log(c / max(c - lc, 1) * lc + share * c + math.e) if c and ahead > 1 else 0.0
    blocks = {x: [y for y in x.items if isinstance(y, html_text.Node) and not y.dropped and y.tag in html_text.BLOCKS] for x in out}
    return out, {x: sum(out[y] for y in b) if b else out[x] for x, b in blocks.items()}


def test_html_densities_equal_the_formula(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").limit(20).collect()] + [PAGE, "<body><a href=x>l</a><p>t <a>u</a></p></body>"]
    for page in pages:
        root = html_text.parse(page)
        html_text.measure(root)
        density, total = densities(root)
        assert all(abs(x.density - d) < 1e-9 and abs(x.total - total[x]) < 1e-9 for x, d in density.items())
        assert root.best.total == max(x.total for x in density if x.tag in html_text.BLOCKS or x is root)


def chosen_text(page):
    """The text of the choice from its definition: every node's density and sums from scratch, no sums carried up."""
    root = html_text.parse(page)
    density, total = densities(root)
    boxes = lambda x: [x] + [n for y in x.items if isinstance(y, html_text.Node) and not y.dropped and y.tag in html_text.BLOCKS for n in boxes(y)]
    best = {x: max(boxes(x), key=lambda y: total[y]) for x in density}  # in page order, so the outermost of equals, then the first
    path = [best[root]]
    while path[-1].tag != "body" and path[-1].parent:
        path.append(path[-1].parent)
    thinnest = min(density[x] for x in path)

    def said(x, inside=False):
        """Blocks of text, by a walk that takes a subtree from its densest point on, and leaves thin boxes out."""
        took = inside or best[x] is x
        out = ["\n"] if took and x.tag in html_text.BLOCKS else []
        for y in x.items:
            if isinstance(y, str):
                out += [y] if took else []
            elif y.dropped or not took and (density[y] < thinnest or not text_of(y)):
                continue
            else:
                links = [n for n in every(y) if n.tag == "a"][y.tag == "a" :]
                linked = len(links) > 1 and 2 * sum(map(text_of, links)) > text_of(y)
                thin = took and y.tag in html_text.BLOCKS and not html_text.HEADING.fullmatch(y.tag) and density[y] < thinnest and (y.prior < 1 or linked)
                out += [] if thin else said(y, took)
        return out + (["\n"] if took and x.tag in html_text.BLOCKS else [])

    every = lambda x: [x] + [n for y in x.items if isinstance(y, html_text.Node) and not y.dropped for n in every(y)]
    text_of = lambda x: sum(len("".join(y.split())) if isinstance(y, str) else 0 if y.dropped else text_of(y) for y in x.items)
    return " ".join(html.unescape("".join(said(root))).split())


def test_html_choice_equals_its_definition(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect()] + [PAGE]
    pages += [re.sub(r"<(/?)(nav|article|footer)\b[^>]*>", r"<\1div>", p) for p in pages[:30]]
    for page in pages:
        assert html_text.main_text(page) == chosen_text(page)


def test_html_density_decides(spark, monkeypatch):
    """With all of the page taken for the article, and names as they are, nearly every page has another text."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    right = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "chosen", lambda root: [root])
    assert sum(html_text.main_text(p) != t for p, t in zip(pages, right)) > 0.9 * len(pages)


STORY_P = "<p>A long paragraph of the story, which goes on and on for many words.</p>" * 4


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><nav><a href=x>Home</a><a href=y>More</a></nav><article>{STORY_P}<p class=legal>The court said so.</p></article></body>", "The court said so."),
        (f"<body><div class=post><div class=post-header><h1>Title of it</h1></div>{STORY_P}</div><div class=footer>All rights</div></body>", "Title of it"),
        (f"<body><article><header><h1>Title of it</h1></header>{STORY_P}</article></body>", "Title of it"),
        (f"<body><div class=page><div class='entry-title'><h2>Title of it</h2></div>{STORY_P}<p>See <span class=comment>this word</span> too.</p></div></body>", "this word"),
    ],
)
def test_html_names_tell_about_boxes_only(page, text):
    got = html_text.main_text(page)
    assert text in got and "All rights" not in got and "Home" not in got


def test_html_density_finds_the_article_without_any_name(spark):
    """Pages whose elements and classes say nothing: all of the article is there, and lists of links are not."""
    rows, links = spark.read.parquet(f"{SF}/pages.parquet").collect(), 0
    for r in rows:
        page = re.sub(r"<(/?)(nav|article|footer)\b[^>]*>", r"<\1div>", r.html).replace(' class="ad"', "")
        got, want = html_text.main_text(page), html_text.main_text(r.html)
        assert not Counter(want.split()) - Counter(got.split())
        menu = re.findall(r">([^<]+)</a>", re.search(r"<nav>(.*?)</nav>", r.html, re.S)[1])
        links += " ".join(menu[:3]) in got
        assert got != " ".join(html_text.blocks([html_text.parse(page)]))
    assert links <= 0.03 * len(rows)


def test_html_keeps_what_is_no_boilerplate():
    page = "<body><div class=\"wrap has-sidebar\"><article><p>Of <math><mi>x</mi></math> and <svg><text>y</text></svg> a long text goes on here.</p><p><a href=f>Read the file</a></p><p>It ends here, after many words.</p></article></div></body>"
    assert html_text.main_text(page) == "Of x and y a long text goes on here. Read the file It ends here, after many words."


@pytest.mark.parametrize("page", ["</x>" * 200_000, "<b>" * 20_000 + "</i>" * 20_000, "<p><td>" + "<b>" * 20_000 + "<ul>" * 20_000, "<li>" * 50_000, "<a><p>" * 30_000])
def test_html_time_is_linear(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 3


def test_html_deep_and_long():
    deep = "<div>" * 20_000 + "text" + "</div>" * 20_000
    assert html_text.main_text(deep) == "text"
    long_ = "<body><article>" + "<p>some words here</p>" * 20_000 + "</article></body>"
    assert html_text.main_text(long_).split() == ["some", "words", "here"] * 20_000


def test_html_table(spark):
    pages = spark.createDataFrame([(1, None, PAGE, "z"), (1, "u", None, "z"), (None, "u", "", "z")], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert len(rows) == 3 and all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract(pages.where("false")).count() == 0


def test_trigram_counts_are_exact_however_they_are_dealt(spark):
    rnd = random.Random(21)
    texts = ["".join(rnd.choice("abz éя,.1 ") for _ in range(rnd.randint(0, 60))) for _ in range(300)] + [None, ""]
    want = Counter()
    for t in texts:
        c = [0, 0, *map(toxicity.symbol, (t or "").lower()), 0]
        want.update(g for g in zip(c, c[1:], c[2:]) if g[1] or g[2])
    for parts in (1, 7):
        (keys, n), (contexts, m) = toxicity.language_model(spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts))
        mask = (1 << toxicity.CHAR) - 1
        assert {(int(k) >> 42, int(k) >> 21 & mask, int(k) & mask): int(x) for k, x in zip(keys, n)} == want
        assert {int(k): int(x) for k, x in zip(contexts, m)} == Counter({a << 21 | b: 0 for a, b, _ in want}) + sum((Counter({a << 21 | b: x}) for (a, b, _), x in want.items()), Counter())


def readings(token):
    """Every reading of a token with its price, by the lattice's rules."""
    out = [("", 0.0)]
    for k, c in enumerate(token):
        inside = not c.isalpha() and 0 < k < len(token) - 1 and token[k - 1].isalnum() and token[k + 1].isalnum()
        options = [(c, toxicity.KEEP if inside else 0.0)] + [(x, toxicity.SWAP) for x in toxicity.LEET.get(c, "")]
        if c in ".-_*~ " and 0 < k < len(token) - 1:
            options.append(("", toxicity.JOIN))
        if c.isalpha() and k and token[k - 1] == c and c * 3 in (token[max(k - 2, 0) : k + 1], token[k - 1 : k + 2], token[k : k + 3]):
            options.append(("", toxicity.DROP))
        out = [(said + x, paid + price) for said, paid in out for x, price in options]
    return out


def test_viterbi_equals_all_readings(spark):
    rnd = random.Random(22)
    docs = spark.createDataFrame([(i, "the idiot saw a moron and a loser in the stupid town of bees") for i in range(20)], "doc_id long, text string")
    m = toxicity.Model(*toxicity.language_model(docs))

    def price(said, paid):
        c = [0, 0, *map(toxicity.symbol, said)]
        return paid + sum(m.cost(*g) for g in zip(c, c[1:], c[2:])) + m.cost(c[-2], c[-1], 0)

    for _ in range(150):
        token = "".join(rnd.choice("ioste10$@.-aaab") for _ in range(rnd.randint(1, 8)))
        every = readings(token)
        least = min(price(*r) for r in every)
        got = m.decode(token)
        assert abs(min(price(said, paid) for said, paid in every if said == got) - least) < 1e-9


def test_spaced_words_are_not_cut(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 20)
    text = "word other " * 3 + "i d i o t s " * 6 + "more words here"
    cut = list(toxicity.pieces(text))
    assert "".join(cut) == text and len(cut) > 2 and any("i d i o t s " * 6 in p for p in cut)


def plain_fusion(pages, docs, languages):
    """Posteriors by the formulas, page by page, from counted trigrams."""
    grams = lambda t: language.grams(t).tolist()  # noqa: E731  the hash of a trigram is the model's own
    counts = {lang: Counter(g for text, lg in docs if lg == lang for g in grams(text or "")) for lang in languages}
    logp = {lang: (counts[lang], sum(counts[lang].values()) + 0.5 * language.BUCKETS) for lang in languages}
    soft = lambda v: [math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v]
    rows = []
    for page_id, url, page in pages:
        found = grams(language.visible(page))
        total = [sum(math.log((c[g] + 0.5) / n) for g in found) for c, n in logp.values()]
        ll = [max(0.25 * (t - max(total)), -30.0) for t in total]
        host = re.match(r"[a-z]+://([^/?#:]*)", url or "")
        host = host[1].lower() if host else ""
        mark = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})", page or "", re.I)
        mark = mark[1].lower() if mark else "none"
        rows.append((page_id, host, host.rsplit(".", 1)[-1], mark if mark in (*languages, "none") else "other", ll, soft(ll)))
    n, add = len(languages), lambda vs: [sum(v) for v in zip(*vs)]
    world = add(r[5] for r in rows)
    overall = [(w + 1) / (len(rows) + n) for w in world]
    out, kinds = {}, [*languages, "other", "none"]
    said = {d: add([r[5] for r in rows if r[3] == d] or [[0.0] * n]) for d in kinds}
    for page_id, host, suffix, mark, ll, p in rows:
        same, wide = [r for r in rows if r[1] == host], [r for r in rows if r[2] == suffix]
        tld = [(s + 20 * o) / (len(wide) + 20) for s, o in zip(add(r[5] for r in wide), overall)]
        prior = [(max(s - x, 0) + 5 * t) / (len(same) - 1 + 5) for s, x, t in zip(add(r[5] for r in same), p, tld)]
        told = [(said[mark][k] + 5 / len(kinds)) / (sum(v[k] for v in said.values()) + 5) for k in range(n)]
        out[page_id] = soft([a + math.log(b) + math.log(c) for a, b, c in zip(ll, told, prior)])
    return out


def test_fusion_equals_the_formulas(spark):
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("text", "lang").collect()]
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").where("page_id < 40").select("page_id", "url", "html").collect()]
    pages += [(-1, None, None), (-2, "http://a.b.de/x", "<html lang='xx'>der die das"), (-3, "http://a.b.de", "")]
    table = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string")
    got = {r.page_id: r.posterior for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), table, ["de", "en", "es", "fr"]).collect()}
    want = plain_fusion(pages, docs, ["de", "en", "es", "fr"])
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-3 for k in want for a, b in zip(got[k], want[k]))


def test_language_against_truth_that_is_no_input(spark):
    """The declaration is taken out of every page, and is what the answer is held against."""
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    truth = pages.select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("truth"))
    bare = pages.withColumn("html", F.regexp_replace("html", ' lang="[a-z]+"', ""))
    repeated = bare.unionByName(bare.limit(5)).withColumn("lang", F.lit("clash")).withColumn("posterior", F.lit(1))
    out = language.identify(repeated, docs, ["de", "en", "es", "fr"]).join(truth, "page_id").collect()
    assert len(out) == pages.count() + 5 and all(r.declared == "none" for r in out)
    assert sum(r.lang == r.truth for r in out) >= 0.97 * len(out)
