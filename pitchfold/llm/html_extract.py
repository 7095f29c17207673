"""Main text of web pages by a site style tree.

Pages of one host are merged by style path (the tags and classes from the root
down). A branch that holds text gets an importance from entropies over the
host's m pages:

* content: 1 - mean over the branch's distinct texts of log(pages with the
  text) / log m. A text that pages of other hosts share is no less noise, so the
  same ratio over all pages of all hosts counts if it is larger. Short blocks
  count sentence by sentence, as menus and footers mix fixed and varying parts.
* presentation: the entropy, with base m, of the child sequences of the element
  around it.
* importance: GAMMA * content + (1 - GAMMA) * presentation.

A host with few pages says little, so its importances are drawn towards those
of the same branches in the tree of all hosts with the weight of PRIOR_PAGES
pages. The cut between noise and main text is fitted to each host's own branches
(the two classes of least variance). What HTML or an element's own class, id or
role calls page furniture goes too, as readers' comments and forms repeat no
texts; the result counts what only a name removes. Pages of a host with the same
longest block are copies of one article and count as one page, so that articles
don't become noise by being copied.

Pages are parsed to hashes, from which the tree is counted; a second parse
writes out what stays. The branches below their host's cut go to every task as
16 bytes each, up to a counted number of them. Beyond, they are joined to the
pages' branches by (host, path) and these to pages by their hash, so no page
carries the tree of its host. Joins read written tables, so Spark can split a
host of most pages.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, texts

GAMMA = 0.9
PRIOR_PAGES = 20
#: The cut lies between these; it is the lower one if the branches don't fall in two classes this far apart.
LOWEST_CUT, HIGHEST_CUT, APART = 0.5, 0.85, 0.1
#: Importances are told apart by so much when the cut is fitted.
STEP = 0.001
#: Numbers of pages are sent to every task up to so many hosts, of 16 bytes each; beyond, they are joined.
BROADCAST_HOSTS = 1_000_000
#: Noise branches are sent to every task up to so many, of 16 bytes each; beyond, they are joined.
BROADCAST_NOISE = 1_000_000
#: Characters of a block that counts sentence by sentence.
SHORT = 300

#: Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("head script style noscript template button select textarea iframe svg".split())
NOT_MAIN = frozenset("nav footer aside header form menu dialog".split())
CONTAINERS = frozenset("html body main article".split())
WHOLE = frozenset("html body main".split())
#: Beginnings of class names that tell of a page's layout, not of what the element is.
LAYOUT = ("with-", "with_", "has-", "has_", "no-", "no_")
#: Words in class or role that name page furniture; an id, and any name inside an article, must be such a word as a whole.
#: Elsewhere a name of several parts counts if its other parts only tell of place or kind of box.
FURNITURE = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo recommended related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
PLACES = frozenset("area bar block bottom box button buttons col column container content fixed float footer form global group header holder icon icons inner item items left link links list main middle outer page panel primary region right row secondary section site slot sticky sub text title top unit wrap wrapper".split())
#: Start tags that end an open element of the same group inside its nearest holder.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}

#: Quotes are heeded in the first so many pieces of a tag, so that a tag costs no more than that times its length.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*'){0,200}+>|[^>]*>)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


_SENTENCE = re.compile(r"(?<=[.!?…;:|·•])\s+")


#: Groups of elements that a start tag ends: members, and the elements that hold them.
_GROUPS = [({"p"}, CONTAINERS | {"table", "td", "div"}), *dict.fromkeys((frozenset(m), frozenset(h)) for m, h in SIBLINGS.values())]
_GROUP_OF = {tag: k for tag in SIBLINGS for k, (members, _) in enumerate(_GROUPS) if k and tag in members}


class Element:
    """An open element; ``nearest`` has, for each group, the place in the stack of the member in reach, 0 if none."""

    __slots__ = ("tag", "path", "around", "hidden", "named", "inside", "children", "nearest")

    def __init__(self, tag: str, path: int, around: int, hidden: bool, named: bool, inside: bool, nearest: tuple[int, ...]):
        self.tag, self.path, self.around, self.hidden, self.named, self.inside, self.children, self.nearest = tag, path, around, hidden, named, inside, [], nearest


_ENDS = {tag: [(k, tag in members) for k, (members, holders) in enumerate(_GROUPS) if tag in members or tag in holders] for tag in set().union(*[m | h for m, h in _GROUPS])}


def hashed(text: str, seed: int = 0) -> int:
    """A signed 64-bit hash; what can't be UTF-8 counts as its replacement."""
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed & 0xFFFFFFFFFFFFFFFF)
    return x - (1 << 64) if x >> 63 else x


def _is_furniture(name: str) -> bool:
    """Whether a name has a furniture word, and else only such words, words of place, and numbers."""
    parts = [p for p in re.split("[_-]+", name) if p and not p.isdigit()]
    return not FURNITURE.isdisjoint(parts) and all(p in FURNITURE or p in PLACES for p in parts)


def _names_furniture(tag: str, inside: bool, named: dict[str, str]) -> bool:
    if tag in WHOLE:
        return False
    words = [w for k in ("class", "role") for w in named.get(k, "").lower().split() if not w.startswith(LAYOUT)]
    if not inside and tag != "article" and any(map(_is_furniture, words)):
        return True
    return not FURNITURE.isdisjoint([*words, named.get("id", "").strip().lower()])


def _element(tag: str, attributes: str, parent: Element, depth: int) -> Element:
    style, named = tag, {}
    lower = attributes.lower()
    if "class" in lower or "id" in lower or "role" in lower:
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMES.finditer(attributes)}
        if named.get("class"):
            style = f"{tag}.{'.'.join(sorted(named['class'].lower().split()))}"
    parent.children.append(style)
    inside = parent.inside or tag in ("article", "main")
    furniture = tag in NOT_MAIN and not (tag == "header" and parent.inside) or _names_furniture(tag, parent.inside, named)
    nearest = parent.nearest
    if tag in _ENDS:
        own = list(nearest)
        for k, member in _ENDS[tag]:
            own[k] = depth if member else 0
        nearest = tuple(own)
    return Element(tag, hashed(style, parent.path), parent.path, parent.hidden or tag in NO_TEXT, parent.named or furniture, inside, nearest)


def parse(page: str) -> tuple[list[tuple[int, int, str, bool]], list[tuple[int, str]]]:
    """Blocks in page order as (path, path of the element around, text, named as furniture), and inner elements as (path, child sequence).

    Work is in proportion to the page's length, however deep its elements are
    nested and whatever is left open.
    """
    stack = [Element("", 0, 0, False, False, False, (0,) * len(_GROUPS))]
    opened: Counter[str] = Counter()
    elements: list[Element] = []
    blocks: list[tuple[int, int, str, bool]] = []
    run: list[str] = []
    where: Element | None = None

    def flush() -> None:
        nonlocal where
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            if text and where is not None and not where.hidden:
                blocks.append((where.path, where.around, text, where.named))
            run.clear()
        where = None

    def close(place: int) -> None:
        """The element at a place of the stack ends, and what is open in it."""
        for x in stack[place:]:
            opened[x.tag] -= 1
        del stack[place:]

    def close_tag(tag: str) -> None:
        if opened[tag]:
            place = len(stack) - 1
            while stack[place].tag != tag:
                place -= 1
            close(place)

    def text(piece: str) -> None:
        nonlocal where
        if piece:
            if where is None and not piece.isspace():
                where = stack[-1]
            run.append(piece)

    at, last = 0, page.rfind(">") + 1  # no tag ends behind the last bracket
    while m := _TOKEN.search(page, at, last):
        text(page[at : m.start()])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag not in INLINE:
                flush()
                for k in (_GROUP_OF.get(tag), 0 if tag not in ("body", "html") else None):
                    if k is not None and stack[-1].nearest[k]:
                        close(stack[-1].nearest[k])
            elif tag == "br":
                run.append(" ")
            if tag == "head" or tag == "body":  # siblings, whatever was left open
                close_tag("head")
            own = _element(tag, m[3], stack[-1], len(stack))
            if tag in VOID or m[3].endswith("/>"):
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}", re.I).search(page, at)
                at = end.start() if end else len(page)
            elements.append(own)
            stack.append(own)
            opened[tag] += 1
        elif m[1]:
            tag = m[1].lower()
            if tag not in INLINE:
                flush()
            close_tag(tag)
        elif m[0].startswith("<!--") and not m[0].endswith("-->"):
            at = len(page)  # a comment that never ends
    text(page[at:].partition("<!--")[0])
    flush()
    return blocks, [(x.path, " ".join(x.children)) for x in elements if x.children]


def host_of(url: Column) -> Column:
    """Host in lower case without port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def features(page: str) -> tuple[int, set[tuple[int, int, bool, int]]]:
    """What tells copies of an article apart, and the page's features as (path, path around, presentation?, hash)."""
    blocks, inner = parse(page)
    same = hashed(max((t for _, _, t, _ in blocks), key=len, default=page))
    found = {(0, 0, False, 0), *((p, 0, True, hashed(s)) for p, s in inner)}  # the first counts the page
    for path, around, text, _ in blocks:
        for part in _SENTENCE.split(text) if len(text) < SHORT else (text,):
            found.add((path, around, False, hashed(part)))
    return same, found


_PARSED = "host bigint, page binary, same bigint, features array<struct<path:bigint,around:bigint,shape:boolean,feature:bigint>>"
_FEATURES = pa.list_(pa.struct([("path", pa.int64()), ("around", pa.int64()), ("shape", pa.bool_()), ("feature", pa.int64())]))


def _parsed(pages: DataFrame) -> DataFrame:
    """Pages (host, page = their hash, html) as hashes: what tells copies apart, and their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(page) for page in texts(batch.column("html"))]
            rows = [[dict(zip(("path", "around", "shape", "feature"), f, strict=True)) for f in own] for _, own in found]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array([s for s, _ in found], pa.int64()), pa.array(rows, _FEATURES)], ["host", "page", "same", "features"])

    return pages.select("host", "page", "html").mapInArrow(run, _PARSED)


def importances(pages: DataFrame) -> DataFrame:
    """(host, path, importance) of every branch that holds text, from pages (host, html); host and path are hashes."""
    return _importances(_parsed(pages.withColumn("page", F.lit(None).cast("binary"))))


def _importances(parsed: DataFrame) -> DataFrame:
    """Counts are made in steps that combine before each shuffle, and tables are
    written before they are joined, so neither a text that most pages share nor
    a host of most pages is a single task.
    """
    rows = parsed.select("host", "same", F.inline("features")).distinct()
    counts = materialise(rows.groupBy("host", "path", "around", "shape", "feature").agg(F.count(F.lit(1)).alias("n")), "style-tree")
    sizes = counts.where("path = 0").select("host", F.col("n").alias("m"))
    known = sizes.agg(F.sum("m").alias("pages"), F.count(F.lit(1)).alias("hosts")).first()
    everyone = F.lit(known["pages"] or 0)
    if known["hosts"] <= BROADCAST_HOSTS:
        sizes = F.broadcast(sizes)
    texts_of = counts.where("path <> 0 AND NOT shape")
    shared = texts_of.groupBy("path", "feature").agg(F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("held")).where("held > 1").select(F.col("path").alias("p"), F.col("feature").alias("f"), "n_all")
    held = texts_of.join(materialise(shared, "shared-texts"), (F.col("path") == F.col("p")) & (F.col("feature") == F.col("f")), "left")
    held = held.withColumn("n_all", F.coalesce("n_all", "n")).join(sizes, "host")
    spread = lambda n, m: F.when(m > 1, F.least(F.lit(1.0), F.log(n) / F.log(m))).otherwise(0.0)
    own, all_hosts = spread(F.col("n"), F.col("m")), spread(F.col("n_all"), everyone)
    content = held.groupBy("host", "path", "around", "m").agg((1 - F.avg(F.greatest(own, all_hosts))).alias("content"), F.sum(1 - all_hosts).alias("all_sum"), F.count(F.lit(1)).alias("texts"))
    shape = counts.where("shape").groupBy("host", F.col("path").alias("around")).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = F.log("total") - F.col("nlogn") / F.col("total")
    presentation = F.when(F.col("m") > 1, F.coalesce(F.least(F.lit(1.0), entropy / F.log("m")), F.lit(1.0))).otherwise(1.0)
    branches = content.join(shape, ["host", "around"], "left").withColumn("shape", presentation)
    branches = materialise(branches.select("host", "path", "m", "content", "all_sum", "texts", "shape"), "branches")
    everywhere = branches.groupBy("path").agg((GAMMA * F.sum("all_sum") / F.sum("texts") + (1 - GAMMA) * F.sum(F.col("shape") * F.col("m")) / F.sum("m")).alias("prior"))
    mine = GAMMA * F.col("content") + (1 - GAMMA) * F.col("shape")
    weight = F.col("m") / (F.col("m") + PRIOR_PAGES)
    return branches.join(materialise(everywhere, "branches-everywhere"), "path").select("host", "path", (weight * mine + (1 - weight) * F.col("prior")).alias("importance"))


def cuts(importance: DataFrame) -> DataFrame:
    """(host, cut): between the host's two classes of branches of least variance inside, if they are far enough apart.

    Branches are counted by STEP of importance first, so a host is a bounded
    number of rows; classes are told apart at steps.
    """
    steps = importance.groupBy("host", F.floor(F.col("importance") / STEP).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("importance").alias("s"), F.min("importance").alias("lo"), F.max("importance").alias("hi"))
    host = Window.partitionBy("host")
    below = host.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    k, left, n, total = F.sum("n").over(below), F.sum("s").over(below), F.sum("n").over(host), F.sum("s").over(host)
    split = steps.select("host", "step", "hi", F.lead("lo").over(host.orderBy("step")).alias("next"), k.alias("k"), left.alias("left"), n.alias("n"), total.alias("total"))
    rest = F.col("n") - F.col("k")
    apart = F.when(rest > 0, F.col("k") * rest * F.pow((F.col("total") - F.col("left")) / rest - F.col("left") / F.col("k"), F.lit(2)))
    best = F.max_by(F.struct("hi", "next"), F.when(rest > 0, F.struct(apart, -F.col("step")))).alias("b")
    middle = F.least(F.greatest((F.col("b.hi") + F.col("b.next")) / 2, F.lit(LOWEST_CUT)), F.lit(HIGHEST_CUT))
    found = split.groupBy("host").agg(best)
    return found.select("host", F.when(F.col("b.next") - F.col("b.hi") >= APART, middle).otherwise(LOWEST_CUT).alias("cut"))


def page_noise(parsed: DataFrame, noise: DataFrame) -> DataFrame:
    """(host, page, path) of the branches of each distinct page that are noise on its host: a join that Spark can split."""
    paths = F.array_distinct(F.transform(F.filter("features", lambda f: ~f["shape"] & (f["path"] != 0)), lambda f: f["path"]))
    of_pages = parsed.dropDuplicates(["host", "page"]).select("host", "page", F.explode(paths).alias("path"))
    return of_pages.join(noise, ["host", "path"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (blocks joined by one line feed), n_chars, n_removed, n_named.

    n_removed counts the blocks that the tree removes, n_named those that only a
    name does. Null html counts as empty; null urls and those without a host form
    one site. Repeated rows are rows of their own in the result, but one page of
    the tree. A very long page is one row as it is; work is in proportion to its
    length. Two branches of one importance fare alike. Without any page that
    differs from others nothing is shared and only names remove blocks; an empty
    table gives an empty result. Other columns are ignored.
    """
    return extracted(pages, id_col, url_col, html_col, BROADCAST_NOISE)


def extracted(pages: DataFrame, id_col: str, url_col: str, html_col: str, broadcast_noise: int) -> DataFrame:
    """``main_text``; up to ``broadcast_noise`` noise branches go to every task, more are joined. Both give the same rows."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.select("*", F.xxhash64(host_of(F.col("url"))).alias("host"), F.unhex(F.md5("html")).alias("page"))
    branches = materialise(_importances(_parsed(rows)), "importances")
    noise = materialise(branches.join(cuts(branches), "host").where("importance < cut").select("host", "path"), "noise")
    id_type = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {id_type}, url string, text string, n_chars bigint, n_removed bigint, n_named bigint"

    def written(batch: pa.RecordBatch, gone_of: list[frozenset[int] | set[int]]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for page, gone in zip(batch.column("html").to_pylist(), gone_of, strict=True):
            blocks = [(text, path in gone, named) for path, _, text, named in parse(page)[0]]
            text = "\n".join(t for t, tree, named in blocks if not tree and not named)
            for column, value in zip(out, (text, len(text), sum(x[1] for x in blocks), sum(x[2] and not x[1] for x in blocks)), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])], ["page_id", "url", "text", "n_chars", "n_removed", "n_named"])

    if noise.count() <= broadcast_noise:
        found = noise.toArrow()
        hosts, paths = (found.column(c).to_numpy() for c in ("host", "path"))
        order = np.argsort(hosts, kind="stable")
        sent = pages.sparkSession.sparkContext.broadcast((hosts[order], paths[order]))

        def with_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, noise_of = sent.value
            for batch in slices(batches):
                host = batch.column("host").to_numpy()
                ends = zip(np.searchsorted(own, host).tolist(), np.searchsorted(own, host, "right").tolist(), strict=True)
                yield written(batch, [_noise_set(noise_of, a, b) for a, b in ends])

        return rows.select("page_id", "url", "host", "html").mapInArrow(with_sent, schema)

    removed = page_noise(_parsed(rows), noise).groupBy("host", "page").agg(F.collect_list("path").alias("noise"))  # at most the page's own branches

    def with_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield written(batch, [set(x or ()) for x in batch.column("noise").to_pylist()])

    joined = rows.join(materialise(removed, "page-noise"), ["host", "page"], "left").select("page_id", "url", "html", "noise")
    return joined.mapInArrow(with_joined, schema)


@lru_cache(4)
def _set_of(raw: bytes) -> frozenset[int]:
    return frozenset(np.frombuffer(raw, np.int64).tolist())


def _noise_set(paths: np.ndarray, a: int, b: int) -> frozenset[int]:
    """Paths a to b as a set; pages of one host often stand together."""
    return _set_of(paths[a:b].tobytes())
