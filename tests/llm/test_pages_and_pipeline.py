"""Wrapper induction on pages, and the pipeline."""

import html
import re
from collections import Counter

import public_tokenizers

import corpus_pipeline
from smoothlake.llm import scratch, wrappers

from .conftest import DATA
from .test_corpus_operators import _packed_well, plain_join
from .test_text_operators import base


def page(i: int) -> str:
    return (
        f'<html><head><title>T{i}</title><style>p{{}}</style></head><body><header>The Site</header><div class="menu"><a href=x>Home</a> <a href=y>News</a></div>'
        f'<div id="content"><h1>Title {i}</h1><p>Para one number {i * 7} is here &amp; more.<p>Second <b>para</b>graph {i * 3}<br>line</p><div class="x">Always the same words here</div></div>'
        f'<div class="comments"><p>Nice post {i}</p></div><form><label>Name</label><input></form><div>All rights reserved</div></body></html>'
    )


def test_wrapper_of_a_host_without_article_elements(spark):
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(12)] + [(90, None, page(5)), (91, "https://b.example/", None), (92, "https://b.example/x", ""), (93, "nonsense", "just text &lt;here"), (None, "https://a.example/0", page(0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {(r["page_id"], r["url"]): r for r in wrappers.main_text(pages).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i, f"https://a.example/{i}"]["text"] == f"Title {i} Para one number {i * 7} is here & more. Second paragraph {i * 3} line"
    assert got[91, "https://b.example/"]["text"] == got[92, "https://b.example/x"]["text"] == ""
    assert got[93, "nonsense"]["text"] == "just text <here"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert wrappers.main_text(pages.limit(0)).count() == 0


def test_articles_are_whole(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    got = wrappers.main_text(pages).collect()
    assert len(got) == len(source)
    for r in got:
        x = source[r["page_id"]]
        x = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", " ", x[x.index("<article>") : x.index("</article>")]))
        assert r["text"] == " ".join(html.unescape(x).split())


def test_joined_wrappers_equal_broadcast_ones(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    a = wrappers.main_text(pages).collect()
    b = wrappers.main_text(pages, wrappers.Settings(broadcast_bytes=0)).collect()
    assert sorted((r["page_id"], r["text"]) for r in a) == sorted((r["page_id"], r["text"]) for r in b)


def _tree(node: tuple) -> wrappers.Tree:
    out = wrappers.Tree([], [])

    def add(node: tuple) -> int:
        k = len(out.keys)
        out.keys.append(node[0])
        out.kids.append([])
        out.kids[k] = [add(c) for c in node[1]]
        return k

    add(node)
    return out


def test_tree_matching_aligns_the_most_nodes():
    a = _tree(("r", [("x", []), ("y", [("p", []), ("q", [])]), ("x", [])]))
    b = _tree(("r", [("y", [("q", [])]), ("x", []), ("z", [])]))
    assert sorted(wrappers.align(a, b)) == [(0, 0), (2, 1), (4, 2), (5, 3)]


def _most(a: wrappers.Tree, b: wrappers.Tree, x: int, y: int) -> int:
    """Simple tree matching by the plain table: the most nodes below two nodes that can be aligned."""
    m, n = a.kids[x], b.kids[y]
    table = [[0] * (len(n) + 1) for _ in range(len(m) + 1)]
    for i, c in enumerate(m, 1):
        for j, d in enumerate(n, 1):
            both = table[i - 1][j - 1] + (1 + _most(a, b, c, d) if a.keys[c] == b.keys[d] else 0)
            table[i][j] = max(both, table[i - 1][j], table[i][j - 1])
    return table[-1][-1]


def test_tree_matching_against_the_plain_table():
    import random

    r = random.Random(3)

    def made(depth: int) -> tuple:
        return (r.choice("abc"), [made(depth - 1) for _ in range(r.randint(0, 4))] if depth else [])

    for _ in range(200):
        a, b = _tree(("r", [made(2) for _ in range(r.randint(1, 5))])), _tree(("r", [made(2) for _ in range(r.randint(1, 5))]))
        pairs = wrappers.align(a, b)
        assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}) and all(a.keys[x] == b.keys[y] for x, y in pairs)
        equal = any([a.keys[c] for c in a.kids[x]] == [b.keys[c] for c in b.kids[y]] for x, y in pairs)
        assert len(pairs) - 1 == _most(a, b, 0, 0) or equal  # children with equal keys throughout are aligned one by one


def _slug(i: int) -> str:
    return "".join("abcdefghij"[int(d)] for d in str(i))


def test_all_kinds_of_children_stay_in_the_template(spark):
    """A host whose pages each have ids of their own, before and beside what all of them share."""
    body = '<div id="teaser-{0}"><p>Teaser {0}</p></div><div class="story"><h1>Title {0}</h1><div id="post-{0}"><p>Words of {0}, a longer piece of running text that goes on for a while, so that the story is most of the page, as it is on most pages of most hosts.</p></div><div class="legal">Always the same words here</div></div><div>All rights reserved</div>'
    rows = [(i, f"https://a.example/{i}", f"<html><body>{body.format(_slug(i))}</body></html>") for i in range(200)]
    got = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == 200
    for r in got:
        x = _slug(r["page_id"])
        assert r["text"] == f"Title {x} Words of {x}, a longer piece of running text that goes on for a while, so that the story is most of the page, as it is on most pages of most hosts."
    a, b = (wrappers.template([wrappers.reduce("".join(f"<div id={k}{_slug(i)}>x</div>" for i in range(100)))]) for k in "vw")
    assert len(wrappers.fold(a, b).tree.kids[0]) == 200


def _renamed(page: str, host: str) -> str:
    """The page with the elements and classes that say what they are renamed, by host."""
    import random

    r = random.Random(host)

    def word() -> str:
        return "".join(r.choices("bcdfghjklmnpqrstvwz", k=5))

    for tag in ("article", "nav", "footer"):
        new = r.choice(["div", "section", f"x-{word()}"])
        page = re.sub(rf"<{tag}\b", f'<{new} class="{word()}"' if r.random() < 0.7 else f"<{new}", page).replace(f"</{tag}>", f"</{new}>")
    return page.replace('class="ad"', f'class="{word()}"')


def test_alignment_finds_the_article_under_any_name(spark):
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    change = F.udf(lambda page, url: _renamed(page, url.split("/")[2]), "string")
    other = wrappers.main_text(pages.withColumn("html", change("html", "url"))).collect()
    alike = 0.0
    for r in other:
        a, b = Counter(want[r["page_id"]].split()), Counter(r["text"].split())
        alike += 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))
    assert len(other) == len(want) == 250 and alike / len(other) >= 0.99


def test_the_wrapper_finds_what_one_page_cannot():
    """A paragraph that all pages of a host share inside the article, and an advert longer than some articles."""
    pages = [wrappers.reduce(f'<body><div class=q>Buy number {i} and number {i + 1} of this, now and for ever</div><section class=z><h1>About {i}</h1><p>{"Word " * (i % 3 * 40)}{i} of the text.</p><p>Tell all of your friends about us.</p></section><div class=w>Seen {i} times</div></body>') for i in range(30)]
    rules = wrappers.induce(pages)
    for i, p in enumerate(pages):
        assert wrappers.extract(p, rules) == f"About {i} " + " ".join(["Word"] * (i % 3 * 40) + [f"{i} of the text."])
        assert wrappers.extract(p, None) != wrappers.extract(p, rules)


def test_wrappers_do_not_depend_on_how_pages_are_dealt(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    a = wrappers.main_text(pages.repartition(2)).collect()
    b = wrappers.main_text(pages.orderBy(pages.html.desc()).repartition(7)).collect()
    assert sorted((r["page_id"], r["text"]) for r in a) == sorted((r["page_id"], r["text"]) for r in b)


def test_spark_and_one_process_agree(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    hosts: dict[str, list] = {}
    for i, url, page in rows:
        hosts.setdefault(url.split("/")[2].lower(), []).append((i, wrappers.reduce(page)))
    want = {i: wrappers.extract(p, rules) for held in hosts.values() for rules in [wrappers.induce([p for _, p in held])] for i, p in held}
    got = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_deep_pages():
    deep = "<html><body>" + "<div>" * 10_000 + "one <p>two" + "</div>" * 10_000
    assert wrappers.extract(wrappers.reduce(deep), None) == "one two"
    deep = "<html><body>" + "".join(f"<div>t{i}" for i in range(10_000))
    rules = wrappers.induce([wrappers.reduce(deep + f"<p>x{i}") for i in range(6)])
    assert wrappers.extract(wrappers.reduce(deep + "<p>new"), rules) == "new"  # all other texts are on every page


def test_links_do_not_hide_the_text_below_them():
    def page(i: int, tag: str) -> str:
        return f'<html><body><div class="top"><a href=/>Home</a></div><{tag}><h1>Title {i}</h1><div class="entry"><a href=c>Category {i}</a><p>First words of {i}, at some length.</p><p>Second words of {i}.</p></div><ul><li><a href=s>Source {i}</a></li></ul></{tag}></body></html>'

    for tag, want in (("article", "Title {0} Category {0} First words of {0}, at some length. Second words of {0}. Source {0}"), ("main", "Title {0} First words of {0}, at some length. Second words of {0}.")):
        pages = [wrappers.reduce(page(i, tag)) for i in range(10)]
        rules = wrappers.induce(pages)
        for i, p in enumerate(pages):
            assert wrappers.extract(p, rules) == want.format(i) == wrappers.extract(p, None)


def _alone(text: str, rules: None) -> str:
    return wrappers.extract(wrappers.reduce(text), rules)


def test_malformed_pages():
    for text in ("<p>a<p>b", "<div><p>a</div>b", "a<b>b", "<article><p><b>a<br><p>b</article>c", "<p>a < b</p>", "<p>a<!-- x > y -->b", "<script>var a='</p>'</script><p>ok", "<p title='>'>a"):
        assert "var" not in _alone(text, None) and _alone(text, None)
    assert _alone("<article><p><b>a<br><p>b</article>c", None) == "a b"


def test_hints():
    page = '<body class="has-sidebar"><div class="layout with sidebar"><main class="no-sidebar"><article class="post"><header><h1>T</h1></header><p>Body text.</p><p class="notice">Cookies!</p><article class="comment">Nice</article></article><ol class="commentlist"><li>Me too</li></ol></main><aside>Also</aside></div><div id="footer">(c)</div></body>'
    assert _alone(page, None) == "T Body text."
    assert _alone('<div class="menu"><a href="/">Home</a></div>', None) == ""
    assert _alone("<p class=commentary>Kept words</p>", None) == "Kept words"


def test_tables_go_when_nothing_reads_them(spark):
    import gc
    import os

    with scratch.owned() as held:
        a = scratch.save(spark.range(5), "a")
        b = scratch.save(a.selectExpr("id + 1 as id"), "b")
        scratch.release(spark, held, but=b)
    assert len(held) == 1 and not os.path.exists(a.scratch_path) and b.count() == 5
    derived = b.where("id > 2")
    path = b.scratch_path
    del a, b
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    scratch.save(spark.range(1), "c")
    assert os.path.exists(path) and derived.count() == 3  # a plan still reads it
    del derived
    for k in range(20):  # the session holds on to its latest plans
        spark.range(k + 1).count()
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        scratch.save(spark.range(1), "d")
        if not os.path.exists(path):
            break
    assert not os.path.exists(path)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], DATA))
    assert all(t.columns == columns for t in tables[:-1])
    rows = [t.collect() for t in tables]
    for before, after in zip(rows[:2], rows[1:3], strict=True):
        assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    assert all(base(r["text"])[0] >= 20 for r in rows[2])
    texts = sorted(rows[2], key=lambda r: r["doc_id"])
    part = plain_join([r["text"] for r in texts])[1]
    assert sorted(r["doc_id"] for r in rows[3]) == sorted({texts[k]["doc_id"] for k in part})
    assert len(rows[4]) == len(rows[3]) and not any("password=" in r["text"] for r in rows[4])
    _packed_well(rows[5], tables[4])
    with scratch.owned() as held:
        run = corpus_pipeline.run(spark, DATA).collect()
    assert len(held) == 2  # the last stage's input and its pieces
    assert sorted(r[:5] for r in run) == sorted(r[:5] for r in rows[5])
    assert public_tokenizers.path("word_bpe_49k.json")


def test_stages_on_odd_tables(edge, no_rows, spark):
    """Nulls, empties, very long and repeated rows, columns with clashing names, and no rows at all go through every stage."""
    for docs in (edge, no_rows):
        now, n = docs, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = scratch.save(stage(spark, now, DATA), f"odd-{name}")
            assert now.columns == docs.columns and now.count() <= n
            n = now.count()
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, DATA)
        assert (pieces.count() >= n > 0) if docs is edge else pieces.count() == 0


def test_run_on_an_empty_table(spark, tmp_path):
    documents, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    documents.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
