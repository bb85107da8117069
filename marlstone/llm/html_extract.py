"""HTML extraction by a tree-structured graphical model over the DOM.

Block elements are nodes with a hidden label, content or boilerplate. Features
of a node (tag, words of class, id and role, length and link share of its text)
give its own potential; parent-child potentials by the child's tag connect it to
its parent. Sum-product messages pass upward and downward once, which yields
exact marginals, in time linear in the page. Potentials are smoothed counts of
labelled pages: pages whose elements carry a ``data-label`` attribute.
``labelled_pages`` makes ``TRAIN_PAGES`` such pages from layouts with random
words; pages labelled by hand can be given instead.

Text of block nodes with a content marginal of at least one half is kept:
character references decoded, white space turned into one space, blocks joined
by two newlines in page order.

Defined results: null or empty html gives the empty text; broken markup is read
as far as it goes (unclosed elements end with their parents, an unclosed drawing
at the next block); elements marked hidden have no text; plain text without any
tag is one block of the root; pages of any length are read whole, in linear
time; equal pages give equal texts; an empty table gives an empty table; other
columns are kept.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import share, shared, small_batches, text_of

TRAIN_PAGES = 1500
SMOOTH = 0.5
#: Content probability of what stands outside of everything, before the page is seen.
ROOT = 0.2

# Elements by their kind.
BLOCKS = frozenset("html body article main section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd form fieldset table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary dialog center hr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
SILENT = frozenset("select button option object audio video canvas map datalist svg".split())
#: Those that never stand inside their like.
FLAT = SILENT - {"object", "map"}
CLOSED_BY_SAME = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
ALIKE = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("children", "label", "linked", "names", "parent", "segments", "size", "tag")

    def __init__(self, tag: str, parent: int, names: frozenset[str], label: str | None) -> None:
        self.tag, self.parent, self.names, self.label = tag, parent, names, label
        self.size = self.linked = self.children = 0
        self.segments: list[tuple[int, list[str]]] = []  # (order in the page, pieces of text)


def parse(page: str) -> list[Node]:
    """Block elements of a page, parents before children, with the text that stands directly in them.

    The places of open blocks are kept by their tags, and open silent elements are
    counted by theirs, so an end tag costs no search; the work is linear in the
    page. A silent element that has no end tag of its own (none follows, or another
    of its kind begins first) ends where the next block begins or its own ends.
    """
    nodes = [Node("#root", -1, frozenset(), None)]
    stack, order, link, at = [0], 0, False, 0
    where: dict[str, list[int]] = {}  # tag -> places in the stack of its open blocks
    silent: list[tuple[str, int, bool]] = []  # elements without text of their own that are open: tag, size of the stack inside, whether the next block ends them
    quiet: Counter[str] = Counter()  # how many of each tag are in it
    ahead: dict[str, int] = {}  # pattern -> where it is found next
    fresh = True  # whether the next text begins a new segment
    end = len(page)

    def say(text: str) -> None:
        nonlocal order, fresh
        if silent or not text:
            return
        node = nodes[stack[-1]]
        if fresh:
            node.segments.append((order, []))
            order, fresh = order + 1, False
        node.segments[-1][1].append(text)
        n = len(text) - text.count(" ")
        node.size += n
        node.linked += n * link

    def close(depth: int) -> None:
        """Closes the blocks from this place of the stack on, and what is open inside."""
        while len(stack) > depth:
            where[nodes[stack.pop()].tag].pop()
        while silent and silent[-1][1] > depth:
            hear()

    def hear() -> str:
        """Ends the last silent element."""
        tag = silent.pop()[0]
        quiet[tag] -= 1
        return tag

    def hush(tag: str, loose: bool = False) -> None:
        silent.append((tag, len(stack), loose))
        quiet[tag] += 1

    def following(pattern: str) -> int:
        """Where the pattern is found next; each place of the page is searched once for a pattern."""
        if ahead.get(pattern, -1) < at:
            m = re.compile(pattern, re.I).search(page, at)
            ahead[pattern] = m.start() if m else end
        return ahead[pattern]

    def last(*tags: str) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    while at < end:
        found = TAG.search(page, at)
        say(html.unescape(page[at : found.start() if found else end]))
        if not found:
            break
        at = found.end()
        closing = found[1]
        opening = found[2] or found[4]
        if closing:
            tag = closing.lower()
            if tag in SILENT:
                if quiet[tag]:
                    while hear() != tag:
                        pass
            elif tag == "a":
                link = False
            elif tag in BLOCKS:
                depth = last(tag)
                if depth:
                    close(depth)
                    link = False
                fresh = True
            continue
        if not opening:
            continue
        tag = opening.lower()
        attributes = (found[3] if found[2] else found[5]) or ""
        if tag in RAW:
            if not attributes.endswith("/"):
                stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
                at = stop.start() if stop else end
            continue
        if tag in SILENT:
            if tag == "option" and silent and silent[-1][0] == tag:
                hear()
            if not attributes.endswith("/"):
                stop = following(f"</{tag}(?=[\\s/>])")
                hush(tag, tag == "svg" or stop == end or (tag in FLAT and following(f"<{tag}(?=[\\s/>])") < stop))
        elif tag == "a":
            link = True
        elif tag in ("br", "wbr"):
            say(" ")
        elif tag in BLOCKS:
            while silent and silent[-1][2]:
                hear()
            if nodes[stack[-1]].tag == "p":
                close(len(stack) - 1)
            if tag in CLOSED_BY_SAME:
                own = last(*ALIKE.get(tag, (tag,)))
                if own > last(*CLOSED_BY_SAME[tag]):
                    close(own)
            link, fresh = False, True
            if tag == "hr":
                continue
            told: dict[str, str] = {}
            for m in ATTRIBUTE.finditer(attributes):
                told.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            names = frozenset(w.lower() for k in ("class", "id", "role") for w in NAME_WORD.findall(told.get(k, "")))
            nodes.append(Node(tag, stack[-1], names, told.get("data-label")))
            nodes[stack[-1]].children += 1
            where.setdefault(tag, []).append(len(stack))
            stack.append(len(nodes) - 1)
            if "hidden" in told:
                hush("#hidden")
    return nodes


def features(nodes: list[Node]) -> list[list[str]]:
    """Discrete features of every node; sizes and link shares count all text beneath it."""
    size = [n.size for n in nodes]
    linked = [n.linked for n in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        size[nodes[k].parent] += size[k]
        linked[nodes[k].parent] += linked[k]
    out = []
    for k, n in enumerate(nodes):
        share = linked[k] / size[k] if size[k] else 0.0
        own = [f"tag:{n.tag}", f"link:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3}"]
        if not n.children:
            own.append(f"size:{min(5, int(math.log(n.size + 1, 4)))}")
        out.append(own + [f"name:{w}" for w in sorted(n.names)])
    return out


def labels(nodes: list[Node]) -> list[int]:
    """1 for content: the own data-label or that of the parent."""
    out: list[int] = []
    for n in nodes:
        out.append(1 if n.label == "content" else 0 if n.label else out[n.parent] if n.parent >= 0 else 0)
    return out


class Model:
    """Log potentials made from counts of (feature, label) and (child tag, parent label, label)."""

    def __init__(self, counts: dict[tuple[str, int, int], int]) -> None:
        get = lambda *k: counts.get(k, 0)
        total = [get("node", 0, y) + 1.0 for y in (0, 1)]
        self.own: dict[str, float] = {}  # log odds content : boilerplate of a feature
        self.pair: dict[str, tuple[tuple[float, float], tuple[float, float]]] = {}
        for kind in {k[0] for k in counts}:
            if kind.startswith("edge:"):
                rows = []
                for above in (0, 1):
                    both = [get("edge:*", above, y) + SMOOTH for y in (0, 1)]
                    prior = [b / sum(both) for b in both]
                    seen = [get(kind, above, y) + prior[y] for y in (0, 1)]
                    rows.append((seen[0] / sum(seen), seen[1] / sum(seen)))
                self.pair[kind[5:]] = (rows[0], rows[1])
            elif kind != "node":
                self.own[kind] = math.log((get(kind, 0, 1) + SMOOTH) / (total[1] + SMOOTH)) - math.log((get(kind, 0, 0) + SMOOTH) / (total[0] + SMOOTH))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Content probability of every node by one upward and one downward pass."""
        n = len(nodes)
        none = self.pair.get("*", ((0.5, 0.5), (0.5, 0.5)))
        pair = [self.pair.get(x.tag, none) for x in nodes]
        own = [math.exp(max(-30.0, min(30.0, sum(self.own.get(f, 0.0) for f in fs)))) for fs in features(nodes)]
        up = [(1.0, w) for w in own]  # (boilerplate, content) of the node and all beneath it
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            b, c = up[k]
            (p00, p01), (p10, p11) = pair[k]
            m0, m1 = p00 * b + p01 * c, p10 * b + p11 * c
            total = m0 + m1
            sent[k] = m0, m1 = m0 / total, m1 / total
            x = nodes[k].parent
            b, c = up[x][0] * m0, up[x][1] * m1
            total = b + c
            up[x] = (b / total, c / total)
        belief = [(0.0, 0.0)] * n
        b, c = up[0][0] * (1 - ROOT), up[0][1] * ROOT
        belief[0] = b / (b + c), c / (b + c)
        for k in range(1, n):
            above = belief[nodes[k].parent]
            r0, r1 = above[0] / max(sent[k][0], 1e-300), above[1] / max(sent[k][1], 1e-300)
            (p00, p01), (p10, p11) = pair[k]
            b, c = up[k][0] * (r0 * p00 + r1 * p10), up[k][1] * (r0 * p01 + r1 * p11)
            total = b + c
            belief[k] = (b / total, c / total)
        return [x[1] for x in belief]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        keep = self.marginals(nodes) if len(nodes) > 1 else [1.0]
        said = sorted((order, pieces) for n, m in zip(nodes, keep, strict=True) if m >= 0.5 for order, pieces in n.segments)
        texts = (" ".join("".join(pieces).split()) for _, pieces in said)
        return "\n\n".join(t for t in texts if t)


def fit(labelled: DataFrame) -> Model:
    """Counts the labelled pages (column html) by grouped aggregation; the counts are a few hundred rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch["html"]:
                nodes = parse(page or "")
                y = labels(nodes)
                for k, fs in enumerate(features(nodes)):
                    seen["node", 0, y[k]] += 1
                    seen.update((f, 0, y[k]) for f in fs)
                    if k:
                        above = y[nodes[k].parent]
                        seen.update([(f"edge:{nodes[k].tag}", above, y[k]), ("edge:*", above, y[k])])
        yield pd.DataFrame([(*k, v) for k, v in seen.items()], columns=["kind", "above", "label", "n"])

    rows = labelled.select("html").mapInPandas(count, "kind string, above int, label int, n long").groupBy("kind", "above", "label").agg(F.sum("n").alias("n")).collect()
    return Model({(r["kind"], r["above"], r["label"]): r["n"] for r in rows})


# Names that web pages give to their parts.
CONTENT_NAMES = "content post entry article story main body text maincontent articlebody postcontent entrycontent page".split()
MENU_NAMES = "nav menu navbar navigation breadcrumb breadcrumbs topbar toc tabs pager pagination".split()
AD_NAMES = "ad ads advert advertisement banner sponsor sponsored promo promotion adsense".split()
SIDE_NAMES = "sidebar side aside widget related recommended trending popular rail secondary complementary".split()
FOOT_NAMES = "footer foot copyright legal bottom colophon disclaimer contentinfo".split()
HEAD_NAMES = "header head masthead logo site branding top banner".split()
NOTICE_NAMES = "notice cookie cookies consent gdpr alert popup modal newsletter subscribe signup overlay share social".split()
COMMENT_NAMES = "comment comments reply replies discussion respond disqus commentlist reader".split()
SYLLABLES = "ba de li mo ru ta ne so vi ka er on the in re st au ment que ción heit".split()


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 7) -> list[str]:
    """Pages in varied layouts with random words, every part labelled content or boilerplate."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(rng.randint(low, high))).capitalize() + rng.choice([".", ".", "", "!"])

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="/">{words(1, 2)}</a></li>' for _ in range(rng.randint(low, high)))

    def paragraphs(low: int, high: int) -> str:
        return "".join(f"<p>{words(low, high)}</p>" for _ in range(rng.randint(1, 3)))

    def part(tags: list[str], names: list[str], inside: str, named: float = 0.8) -> str:
        tag = rng.choice(tags)
        name = f' {rng.choice(["class", "class", "id", "role"])}="{rng.choice(names)}{rng.choice(["", "", "-" + rng.choice(["box", "wrap", "area", "1"])])}"' if rng.random() < named or tag == "div" else ""
        return f'<{tag}{name} data-label="boilerplate">{inside}</{tag}>'

    def prose(low: int, high: int) -> str:
        out = []
        for k in range(rng.randint(low, high)):
            kind = rng.random()
            if k and kind < 0.1:
                out.append(f"<h{rng.randint(2, 4)}>{words(2, 6)}</h2>")
            elif kind < 0.2:
                out.append("<ul>" + "".join(f"<li>{words(2, 25)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.25:
                out.append(f"<blockquote><p>{words(5, 40)}</p></blockquote>")
            elif kind < 0.28:
                out.append(f"<table><tr><td>{words(1, 8)}</td><td>{words(1, 8)}</td></tr></table>")
            elif kind < 0.31:
                out.append(f"<pre>{words(3, 30)}</pre>")
            elif kind < 0.34:
                out.append(f"<figure><figcaption>{words(3, 12)}</figcaption></figure>")
            else:
                body = words(1, 4) if rng.random() < 0.15 else words(*rng.choice([(4, 40), (20, 120), (20, 120), (100, 500)]))
                if rng.random() < 0.15:
                    body += f' <a href="/">{words(1, 3)}</a> {words(3, 20)}'
                out.append(f"<p>{body}{rng.choice(['</p>', '</p>', '</p>', '<br>'])}")
        return "".join(out)

    pages = []
    for _ in range(n):
        before, after, inner = [], [], []
        if rng.random() < 0.8:
            before.append(part(["nav", "div"], MENU_NAMES, f"<ul>{links(2, 9)}</ul>"))
        if rng.random() < 0.6:
            before.append(part(["header", "div"], HEAD_NAMES, f"<h{(tall := rng.choice('122'))}>{words(1, 4)}</h{tall}>" + rng.choice(["", paragraphs(2, 40), f"<ul>{links(2, 5)}</ul>"])))
        for where, chance in ((before, 0.5), (after, 0.3), (inner, 0.15)):
            if rng.random() < chance:
                where.append(part(["div", "aside", "section"], AD_NAMES, rng.choice([words(3, 60), paragraphs(3, 60)])))
        for where in (before, after):
            if rng.random() < 0.3:
                where.append(part(["div", "section", "dialog"], NOTICE_NAMES, rng.choice([words(4, 60), paragraphs(4, 60)])))
        if rng.random() < 0.4:
            after.append(part(["aside", "div"], SIDE_NAMES, rng.choice([f"<h3>{words(1, 3)}</h3><ul>{links(2, 8)}</ul>", paragraphs(5, 60), f"<h3>{words(1, 3)}</h3>{paragraphs(5, 60)}"])))
        if rng.random() < 0.2:
            tall = rng.randint(2, 4)
            inner.append(part(["aside", "div", "section"], SIDE_NAMES, f"<h{tall}>{words(1, 3)}</h{tall}>" + rng.choice([f"<ul>{links(1, 6)}</ul>", paragraphs(4, 30)])))
        if rng.random() < 0.3:
            after.append(part(["form"], NOTICE_NAMES, f"{paragraphs(2, 40)}<label>{words(1, 3)}</label><input>", 0.3))
        if rng.random() < 0.35:
            said = "".join(rng.choice([f"<li><p>{words(3, 60)}</p></li>", f'<div class="comment"><p>{words(3, 60)}</p></div>']) for _ in range(rng.randint(1, 5)))
            (inner if rng.random() < 0.4 else after).append(part(["div", "section", "ol", "ul"], COMMENT_NAMES, f"<h3>{words(1, 3)}</h3>{said}", 1.0))
        if rng.random() < 0.85:
            after.append(part(["footer", "footer", "div"], FOOT_NAMES, rng.choice([words(3, 40), paragraphs(3, 40), f"<ul>{links(2, 6)}</ul>"])))
        rng.shuffle(inner)
        prosaic = prose(1, 9) if rng.random() < 0.9 else "".join(f"<p>{words(1, 6)}</p>" for _ in range(rng.randint(10, 60)))
        text = f"<h1>{words(1, 10)}</h1>{prosaic}" + "".join(inner)
        kind = rng.random()
        if kind < 0.45:
            body = f'<article data-label="content">{text}</article>'
        elif kind < 0.6:
            body = f'<main data-label="content">{text}</main>'
        elif kind < 0.7:
            body = f'<main data-label="content"><article>{text}</article></main>'
        elif kind < 0.92:
            tag = rng.choice(["div", "div", "section"])
            body = f'<{tag} {rng.choice(["class", "id", "role"])}="{rng.choice(CONTENT_NAMES)}" data-label="content">{text}</{tag}>'
        elif kind < 0.96:
            body = f'<div data-label="content">{text}</div>'
        else:
            body = text
        if body is not text and rng.random() < 0.3:
            body = f'<div class="{rng.choice(["wrapper", "container", "row", "page", "layout"])}">{body}</div>'
        bare = ' data-label="content"' if body is text else ""
        pages.append(f"<html><head><title>{words(1, 6)}</title></head><body{bare}>{''.join(before)}{body}{''.join(after)}</body></html>")
    return pages


def train(spark: SparkSession, n: int = TRAIN_PAGES) -> Model:
    return fit(spark.createDataFrame(pd.DataFrame({"html": labelled_pages(n)})))


def extract(pages: DataFrame, m: Model, column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html column."""
    small_batches(pages.sparkSession)
    given = share(pages.sparkSession, m)

    @F.pandas_udf("string")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared(given)
        for column in batches:
            yield pd.Series([model.extract(x) for x in column], dtype=object)

    made = pages.withColumn("__text", work(text_of(column)))
    return made.select(*[F.col(f"`{c}`") for c in pages.columns if c not in (column, out)], F.col("__text").alias(out))
