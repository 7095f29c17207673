"""Main text of made-up sites whose article text is known."""

from __future__ import annotations

import math
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchfold.llm import html_extract, queries
from pitchfold.llm.common import materialise

from .helpers import SF, words


def _page(k: int) -> tuple[str, str]:
    title, paragraphs = words(k, 6), [words(1000 * k + j, 40) for j in range(3)]
    page = f"""<!DOCTYPE html><html><head><title>{words(k, 3)}</title><style>p {{ color: red }}</style></head><body>
    <nav class="menu"><ul><li><a href="/">Home</a><li><a href="/x">News &amp; more</a></ul></nav>
    <div class="strip">All offers end on Friday, so hurry and read the terms of this site</div>
    <article><h1>{title}</h1><p>{paragraphs[0]} <b>bold</b>&nbsp;&amp; more<p>{paragraphs[1]}
    <script>var a = "<p>not text</p>";</script><ul><li>{paragraphs[2]}</ul></article>
    <div class="comments"><p>{words(k + 500, 8)}</p></div><footer>&copy; 2020 the site</footer></body></html>"""
    return page, "\n".join([title, f"{paragraphs[0]} bold & more", paragraphs[1], paragraphs[2]])


def test_articles(spark):
    made = [_page(k) for k in range(25)]
    pages = spark.createDataFrame([(k, f"https://site{k % 2}.example/{k}", p) for k, (p, _) in enumerate(made)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in html_extract.main_text(pages).collect()}
    for k, (_, text) in enumerate(made):
        assert got[k]["text"] == text and got[k]["n_chars"] == len(text)


def test_text_that_a_whole_site_repeats_goes_without_a_telling_name(spark):
    made = [f"<html><body><div class='q7'>Read our long terms and conditions here</div><div class='z1'><p>{words(k, 30)}</p></div></body></html>" for k in range(60)]
    pages = spark.createDataFrame([(k, "http://h.example/", p) for k, p in enumerate(made)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()}
    assert got == {k: words(k, 30) for k in range(60)}


def test_every_page_has_a_row(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = queries.op3_html_extract(spark, SF).collect()
    assert sorted(r["page_id"] for r in got) == sorted(r["page_id"] for r in pages.select("page_id").collect())
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(r["n_chars"] > 0 for r in got) > 0.9 * len(got)


def _tree(rows: list[tuple[int, str]]) -> dict[tuple[int, int], float]:
    """Importances by their definition, from (host, html), without Spark."""
    pages = {(host, *html_extract.features(page)[:1]): None for host, page in rows}
    held: dict = defaultdict(set)
    for host, page in rows:
        same, found = html_extract.features(page)
        for path, around, shape, feature in found:
            held[host, path, around, shape, feature].add(same)
    m = Counter(host for host, _ in pages)
    everyone = sum(m.values())
    anywhere: Counter = Counter()
    for (_, path, _, shape, feature), who in held.items():
        if not shape:
            anywhere[path, feature] += len(who)
    share = lambda n, of: min(1.0, math.log(n) / math.log(of)) if of > 1 else 0.0
    content, alls, sequences = defaultdict(list), defaultdict(list), defaultdict(list)
    for (host, path, around, shape, feature), who in held.items():
        if shape:
            sequences[host, path].append(len(who))
        elif path:
            rest = share(anywhere[path, feature], everyone)
            content[host, path, around].append(max(share(len(who), m[host]), rest))
            alls[path].append(1 - rest)
    look = {}
    for host, path, around in content:
        counts = sequences.get((host, around))
        if m[host] > 1 and counts:
            total = sum(counts)
            look[host, path] = min(1.0, -sum(c / total * math.log(c / total) for c in counts) / math.log(m[host]))
        else:
            look[host, path] = 1.0
    prior = {}
    for path in alls:
        hosts = [h for h, p, _ in content if p == path]
        prior[path] = 0.9 * sum(alls[path]) / len(alls[path]) + 0.1 * sum(look[h, path] * m[h] for h in hosts) / sum(m[h] for h in hosts)
    out = {}
    for (host, path, _), spreads in content.items():
        weight = m[host] / (m[host] + 20)
        out[host, path] = weight * (0.9 * (1 - sum(spreads) / len(spreads)) + 0.1 * look[host, path]) + (1 - weight) * prior[path]
    return out


def test_importances_of_a_whole_table_by_their_definition(spark):
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").withColumn("host", F.xxhash64(html_extract.host_of(F.col("url")))).select("host", "html")
    expected = _tree([(r["host"], r["html"] or "") for r in pages.collect()])
    got = {(r["host"], r["path"]): r["importance"] for r in html_extract.importances(pages).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - x) < 1e-9 for k, x in expected.items())


def test_the_tree_alone_finds_the_articles_of_a_whole_table(spark):
    """No name is needed where the table is large enough: what stays is what the page has in its article element."""
    sf = SF.replace("0.001", "0.01")
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op3_html_extract(spark, sf).collect()
    assert sum(r["n_removed"] for r in rows) > 1000 and sum(r["n_named"] for r in rows) == 0
    for r in rows:
        page = pages[r["page_id"]]
        article = page[page.index("<article") : (page + "</article>").index("</article>")]
        assert r["text"] == "\n".join(t for _, _, t, _ in html_extract.parse(article)[0])


def test_header_of_an_article_and_ids_of_headings_stay(spark):
    page = lambda k: f"""<body><header>The site's name</header><article><header><h1>{words(k, 5)}</h1></header><section id="related-work"><h2 id="comment-syntax">{words(k + 100, 4)}</h2>
    <p>{words(k + 200, 40)}</p></section><div class="comments"><p>{words(k + 300, 9)}</p></div><aside>{words(k + 400, 5)}</aside></article></body>"""  # noqa: E731
    pages = spark.createDataFrame([(k, "http://h.example/", page(k)) for k in range(12)], "page_id bigint, url string, html string")
    for r in html_extract.main_text(pages).collect():
        k = r["page_id"]
        assert r["text"].split("\n") == [words(k, 5), words(k + 100, 4), words(k + 200, 40)]


def test_copies_of_an_article_among_changing_menus(spark):
    """Pages of one article on one host, each with another advert, are one page of the tree."""
    page = lambda k: f"<body><div class='x1'>{words(k, 4)}</div><div class='z1'><p>{words(7, 60)}</p></div></body>"
    pages = spark.createDataFrame([(k, "http://h.example/", page(k)) for k in range(40)], "page_id bigint, url string, html string")
    assert all(words(7, 60) in r["text"] for r in html_extract.main_text(pages).collect())


@pytest.mark.parametrize(("values", "low", "high"), [([0.47, 0.5, 0.46, 0.93, 0.96], 0.7, 0.73), ([0.75, 0.79, 0.8, 0.95, 0.96], 0.8, 0.85), ([0.93, 0.95, 0.97], 0.5, 0.5), ([0.9], 0.5, 0.5), ([0.1, 0.2, 0.3], 0.5, 0.5), ([0.2, 0.2, 0.9, 0.9], 0.55, 0.55)])
def test_fitted_cut(spark, values, low, high):
    rows = [(1, float(v)) for v in values] + [(2, 0.3), (2, 0.9)]
    got = {r["host"]: r["cut"] for r in html_extract.cuts(spark.createDataFrame(rows, "host bigint, importance double")).collect()}
    assert low - 1e-9 <= got[1] <= high + 1e-9 and abs(got[2] - 0.6) < 1e-9


def _fitted(values: list[float]) -> float:
    """The cut by its definition, over all ways to split the sorted values."""
    x = sorted(values)
    best = None
    for k in range(1, len(x)):
        if int(x[k] / html_extract.STEP) == int(x[k - 1] / html_extract.STEP):
            continue
        low, high = sum(x[:k]) / k, sum(x[k:]) / (len(x) - k)
        worth = k * (len(x) - k) * (high - low) ** 2
        if best is None or worth > best[0] + 1e-12:
            best = worth, x[k - 1], x[k]
    if best is None or best[2] - best[1] < html_extract.APART:
        return html_extract.LOWEST_CUT
    return min(max((best[1] + best[2]) / 2, html_extract.LOWEST_CUT), html_extract.HIGHEST_CUT)


def test_cuts_of_many_hosts_by_their_definition(spark):
    rng = np.random.default_rng(1)
    rows = [(h, float(v)) for h in range(60) for v in np.concatenate([rng.uniform(0.1, 0.6, rng.integers(1, 9)), rng.uniform(0.6, 1.0, rng.integers(0, 9))])]
    got = {r["host"]: r["cut"] for r in html_extract.cuts(spark.createDataFrame(rows, "host bigint, importance double")).collect()}
    assert all(abs(got[h] - _fitted([v for k, v in rows if k == h])) < 1e-9 for h in range(60))


def test_a_single_page_goes_by_names(spark):
    page = "<body><nav>Home</nav><p>The only text.</p><div class='comment-list'>First!</div><footer>Bye</footer></body>"
    pages = spark.createDataFrame([(1, "http://h.example/", page)], "page_id bigint, url string, html string")
    assert [(r["text"], r["n_removed"], r["n_named"]) for r in html_extract.main_text(pages).collect()] == [("The only text.", 0, 3)]


def test_deep_and_broken_markup():
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert [t for _, _, t, _ in html_extract.parse(deep)[0]] == ["text"]
    assert [t for _, _, t, _ in html_extract.parse("<p>a<p>b &amp; c<br>d</div></p>e <li>f<!-- g --> h<script>x</script>")[0]] == ["a", "b & c d", "e", "f h"]


class Plain(HTMLParser):
    """Blocks with their style paths by the standard library's parser, for pages without misplaced tags."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.open, self.run, self.where, self.blocks = [""], [], None, []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(self.run).split())
        if text and not {x.split(".")[0] for x in self.where} & html_extract.NO_TEXT:
            self.blocks.append((">".join(self.where), text))
        self.run, self.where = [], None

    def handle_starttag(self, tag, attrs):
        if tag not in html_extract.INLINE:
            self.flush()
            if tag == "p" and self.open[-1].split(".")[0] == "p":
                self.open.pop()
            for k in range(len(self.open) - 1, 0, -1):  # inline elements that a paragraph left open
                if self.open[k] == "p" and tag == "p":
                    del self.open[k:]
                    break
                if self.open[k].split(".")[0] in ("div", "article", "body", "main", "td"):
                    break
        elif tag == "br":
            self.run.append(" ")
        names = sorted((dict(attrs).get("class") or "").lower().split())
        if tag not in html_extract.VOID:
            self.open.append(".".join([tag, *names]))

    def handle_endtag(self, tag):
        if tag not in html_extract.INLINE:
            self.flush()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].split(".")[0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.where is None and not data.isspace():
            self.where = tuple(self.open)
        self.run.append(data)


def test_blocks_of_a_whole_table_by_another_parser(spark):
    paths = {}
    for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").collect():
        ours = html_extract.parse(r["html"] or "")[0]
        plain = Plain(r["html"] or "").blocks
        assert [t for _, _, t, _ in ours] == [t for _, t in plain]
        for (path, *_), (name, _) in zip(ours, plain):
            assert paths.setdefault(path, name) == name
    assert len(set(paths.values())) == len(paths) > 5


@pytest.mark.parametrize("page", ["<section>" * 8000 + "x", "<a " * 8000, "<p><div>" + "<section>" * 8000 + "<li>" * 8000, '<i ">"' * 8000 + "'", "<!" * 8000, "</x " * 8000, "<div>" * 8000 + "</p>" * 8000, "<b>" * 8000 + "<p>" * 8000, "<!--" * 8000, "<li>a" * 8000, "<x y='" * 8000 + ">", "<ul><li>" * 8000])
def test_work_is_in_proportion_to_length(page):
    began = time.perf_counter()
    html_extract.parse(page)
    one = time.perf_counter() - began
    began = time.perf_counter()
    html_extract.parse(page + page)
    assert one < 0.3 and time.perf_counter() - began < 0.3 + 4 * one


@pytest.mark.parametrize(("name", "furniture"), [("article-share-price", False), ("post-menu-design", False), ("comment-list", True), ("site-footer", True), ("cookie_notice", True), ("ad-slot-3", True), ("sidebar", True), ("shared-history", False), ("list", False), ("navigation", True), ("with-sidebar", False), ("social-effects", False)])
def test_names(name, furniture):
    blocks = html_extract.parse(f'<body><div class="x {name}"><p>text</p></div></body>')[0]
    assert [n for *_, n in blocks] == [furniture]


def test_open_comments():
    parsed = lambda page: [t for _, _, t, _ in html_extract.parse(page)[0]]
    assert parsed("<p>a</p><!-- b <p>c</p> d") == ["a"] and parsed("<p>a</p> e <!-- b") == ["a", "e"] and parsed("a < b <c") == ["a < b <c"]


def test_a_host_of_most_pages_is_split(spark):
    """With broadcasts off and low thresholds, as sizes at scale would have it, every join by host or branch may be split."""
    page = lambda k: f"<html><body><div class='q7'>Read our long terms and conditions here</div><div class='z1'><p>{words(k, 60)}</p></div></body></html>"
    made = [(k, "http://hot.example/" if k % 10 else f"http://h{k}.example/", page(k)) for k in range(3000)]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.shuffle.partitions": "6", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        pages = spark.createDataFrame(made, "page_id bigint, url string, html string").repartition(16)
        assert {r["page_id"]: r["text"] for r in html_extract.extracted(pages, "page_id", "url", "html", 0).collect()} == {k: words(k, 60) for k in range(3000)}
        named = pages.select(F.xxhash64(html_extract.host_of(F.col("url"))).alias("host"), F.unhex(F.md5("html")).alias("page"), "html")
        parsed = materialise(html_extract._parsed(named), "parsed")
        tree = materialise(html_extract.importances(pages.select(F.xxhash64(html_extract.host_of(F.col("url"))).alias("host"), "html")), "tree")
        noise = materialise(tree.where("importance < 0.5").select("host", "path"), "noise")
        found = html_extract.page_noise(parsed, noise)
        assert found.count() > 2500
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert len(rows) > 2500 and "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_joined_noise_gives_the_rows_of_sent_noise(spark):
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    awkward = spark.createDataFrame([(-1, None, None), (-1, None, None), (None, "x", ""), (-2, "http://a.b", "<p>x")], pages.select("page_id", "url", "html").schema)
    pages = pages.select("page_id", "url", "html").unionByName(awkward).unionByName(pages.limit(5).select("page_id", "url", "html"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    sent = rows(html_extract.main_text(pages))
    assert rows(html_extract.extracted(pages, "page_id", "url", "html", 0)) == sent and len(sent) == 259
