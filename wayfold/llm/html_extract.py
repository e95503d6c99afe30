"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element is a node with two states, content or not. A node's potential is the weighted sum
of its features: the tag, the words of its class and id names, how much of its text is in
links, how much text it has and how long its runs between tags are, its place in the page. An edge between parent
and child has a potential for each pair of their states. Messages go up from the leaves and
down from the root (sum-product), which gives each node's exact marginal. The text directly in
an element, or in inline elements in it, is kept when the element's content marginal is at
least one half.

The weights are trained from labelled pages by gradient ascent on the likelihood of their
labels, whose gradient needs the same marginals. The pages are a training set given as a
parameter: (html, set of the content elements' marks). By default they are written by
labelled_pages(), from the kinds of furniture that pages have: menus, headers, footers,
sidebars, notices, adverts, forms, related links and reader comments, under various tag and
class names, around an article.

The parser follows the rules of the HTML standard that matter for text: raw text elements,
void elements, end tags that may be left out, comments, stray and unfinished tags. A tag with a
quote that is never closed ends at the next >, so that no text is lost with it. Each tag costs
the same however many elements are open, so stray tags don't slow a long page.
Character references are decoded; white space in a block becomes one space and blocks are
joined by one space. A null or empty page gives an empty text, as does a page without
content. Very long pages are parsed whole; nesting depth is not limited. Repeated rows each
get their row; equal pages (ties) get equal texts. Extra columns, whatever their names, are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import spread, table

TRAIN_PAGES = 500
EPOCHS = 12
RATE = 0.15
DECAY = 1e-4
SEED = 3

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " object math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mpadded menclose mmultiscripts semantics annotation".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: A start tag of the first kind ends an open element of the second, unless one of the third is in between.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"thead", "tbody", "tr", "td", "th"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset()),
}
P_FENCE = frozenset("html body table td th caption button object article section div aside nav header footer main form li blockquote".split())
#: Elements whose text never is page text.
SILENT = frozenset("head script style title textarea xmp iframe noembed noframes noscript template".split())

_TAG = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|([^>]*+)(>|\Z))|/[^>]*>?)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "up", "kids", "names", "own", "total", "linked", "gaps", "order", "index", "words", "link_text")

    def __init__(self, tag: str, up: int, names: str, index: int):
        self.tag, self.up, self.names, self.index = tag, up, names, index
        self.kids: list[int] = []
        self.own = 0  # characters directly in it or in inline elements in it
        self.total = self.linked = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str, bool]]]:
    """The block elements, in page order, and the pieces of text: element, text, whether a block begins before it.

    Inline elements are not nodes; links are kept as characters of link text in their block.
    """
    nodes = [Node("#root", -1, "", 0)]
    pieces: list[tuple[int, str, bool]] = []
    # The open elements: tag, the block that text in it belongs to, and where the p and the a are
    # that a tag in it would end (0: none). And how many of each tag are open.
    stack: list[tuple[str, int, int, int]] = [("#root", 0, 0, 0)]
    opened: dict[str, int] = {}
    at, fresh, links = 0, True, 0
    n = len(page)

    def text(a: int, b: int) -> None:
        nonlocal fresh
        if a >= b:
            return
        raw = page[a:b]
        if "&" in raw:
            raw = _html.unescape(raw)
        node = stack[-1][1]
        pieces.append((node, raw, fresh))
        fresh = False
        size = len(raw) if not raw.isspace() else 0
        nodes[node].own += size
        if links:
            nodes[node].linked += size

    def push(tag: str, node: int) -> None:
        _, _, p, link = stack[-1]
        here, fence = len(stack), tag in P_FENCE
        stack.append((tag, node, here if tag == "p" else 0 if fence else p, here if tag == "a" else 0 if fence else link))
        opened[tag] = opened.get(tag, 0) + 1

    def close(depth: int) -> None:
        nonlocal fresh, links
        while len(stack) > depth:
            tag = stack.pop()[0]
            opened[tag] -= 1
            if tag == "a":
                links -= 1
            if tag not in INLINE:
                fresh = True

    def end_open(targets: frozenset, fence: frozenset) -> None:
        """Close the nearest of each kind of target above the nearest fence."""
        targets = {t for t in targets if opened.get(t)}
        depth = len(stack) - 1
        lowest = 0
        while targets and depth:
            tag = stack[depth][0]
            if tag in targets:
                lowest = depth
                targets.discard(tag)
            elif tag in fence:
                break
            depth -= 1
        if lowest:
            close(lowest)

    for found in iter(lambda: _TAG.search(page, at), None):
        text(at, found.start())
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        if not (found.group(4) or found.group(6)):  # an unfinished tag at the end of the page
            break
        tag = name.lower()
        if found.group(1):
            if tag == "br":
                fresh = True
            if opened.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
            elif tag not in INLINE:
                fresh = True
            continue
        rest = found.group(3) or found.group(5)
        if tag in CLOSES_P and stack[-1][2]:
            close(stack[-1][2])
        if tag in ENDS:
            end_open(*ENDS[tag])
        if tag == "br" or tag == "hr":
            fresh = True
        if tag in VOID:
            continue
        if tag in RAW:
            shut = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = shut.end() if shut else n
            continue
        if tag in INLINE:
            if tag == "a":
                if stack[-1][3]:
                    close(stack[-1][3])
                links += 1
            push(tag, stack[-1][1])
            continue
        up = stack[-1][1]
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)).lower() if rest else ""
        node = Node(tag, up, names, len(nodes))
        nodes[up].kids.append(node.index)
        nodes.append(node)
        push(tag, node.index)
        fresh = True
    else:
        text(at, n)
    for node in reversed(nodes):
        node.total += node.own
        if node.up >= 0:
            nodes[node.up].total += node.total
            nodes[node.up].linked += node.linked
    return nodes, pieces


def features(nodes: list[Node]) -> list[list[str]]:
    """The names of each node's features that hold."""
    whole = max(1, nodes[0].total)
    inside: list[frozenset] = []
    out = []
    for node in nodes:
        above = inside[node.up] if node.up >= 0 else frozenset()
        words = _PART.findall(node.names)
        mine = [f"t:{node.tag}", *{f"n:{w}" for w in words}]
        inside.append(above | {node.tag} if node.tag in ("article", "main", "nav", "aside", "header", "footer", "form") else above)
        mine += [f"in:{t}" for t in above]
        density = node.linked / node.total if node.total else -1
        mine.append("links:none" if density < 0 else f"links:{min(4, int(density * 5))}")
        mine.append(f"text:{min(12, node.total.bit_length())}")
        mine.append(f"own:{min(12, node.own.bit_length())}")
        mine.append(f"{'inner' if node.kids else 'leaf'}:{min(4, int(5 * node.total / whole))}")
        out.append(mine)
    return out


def marginals(field: list[float], up: list[int], edge: tuple[float, float, float, float]) -> tuple[list[float], list[tuple[int, float, float, float, float]]]:
    """Content marginals of a tree's nodes, and the pair marginals of each edge, by sum-product.

    field: log-odds of content of each node alone; parents come before their children. edge: the
    log-potentials of (parent, child) states 00, 01, 10, 11.
    """
    n = len(field)
    e00, e01, e10, e11 = (math.exp(x) for x in edge)
    # Upward: a node with the messages of its children, as odds in log space.
    inner = list(field)
    sent = [0.0] * n
    for i in range(n - 1, 0, -1):
        a = inner[i]
        if a > 0:
            x0, x1 = math.exp(-a) if a < 700 else 0.0, 1.0
        else:
            x0, x1 = 1.0, math.exp(a) if a > -700 else 0.0
        sent[i] = math.log((e10 * x0 + e11 * x1) / (e00 * x0 + e01 * x1))
        inner[up[i]] += sent[i]
    full = [0.0] * n
    full[0] = inner[0]
    pairs = []
    # Downward: the parent without what this child told it.
    for i in range(1, n):
        b = full[up[i]] - sent[i]
        if b > 0:
            y0, y1 = math.exp(-b) if b < 700 else 0.0, 1.0
        else:
            y0, y1 = 1.0, math.exp(b) if b > -700 else 0.0
        full[i] = inner[i] + math.log((e01 * y0 + e11 * y1) / (e00 * y0 + e10 * y1))
        a = inner[i]
        if a > 0:
            x0, x1 = math.exp(-a) if a < 700 else 0.0, 1.0
        else:
            x0, x1 = 1.0, math.exp(a) if a > -700 else 0.0
        p = (e00 * y0 * x0, e01 * y0 * x1, e10 * y1 * x0, e11 * y1 * x1)
        z = sum(p)
        pairs.append((i, p[0] / z, p[1] / z, p[2] / z, p[3] / z))
    return [1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, v)))) for v in full], pairs


class Model:
    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.edge = [0.0, 0.0, 0.0, 0.0]

    def field(self, feats: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum([get(f, 0.0) for f in mine]) for mine in feats]

    def content(self, nodes: list[Node]) -> list[float]:
        return marginals(self.field(features(nodes)), [n.up for n in nodes], tuple(self.edge))[0]


def train(pages: list[tuple[str, str]], epochs: int = EPOCHS) -> Model:
    """A model from pages and the class name that marks their content elements.

    The mark is taken off before features are made. A labelled element is content, and so are the
    elements in it.
    """
    model = Model()
    ready = []
    for page, mark in pages:
        nodes, _ = parse(page)
        label = []
        for node in nodes:
            marked = mark in node.names.split()
            node.names = " ".join(w for w in node.names.split() if w != mark)
            label.append(1 if marked else 0)
        ready.append((features(nodes), [n.up for n in nodes], label))
    order = random.Random(SEED)
    for epoch in range(epochs):
        rate = RATE / (1 + 0.3 * epoch)
        for k in order.sample(range(len(ready)), len(ready)):
            feats, up, label = ready[k]
            post, pairs = marginals(model.field(feats), up, tuple(model.edge))
            for mine, p, y in zip(feats, post, label):
                g = rate * (y - p)
                if abs(g) > 1e-6:
                    for f in mine:
                        model.weight[f] = model.weight.get(f, 0.0) * (1 - DECAY) + g
            for i, *p in pairs:
                for s in range(4):
                    model.edge[s] += 0.1 * rate * ((2 * label[up[i]] + label[i] == s) - p[s])
    return model


_BLANK = re.compile(r"\s+")


def text_of(page: str | None, model: Model) -> str:
    """The main text of a page."""
    if not page:
        return ""
    nodes, pieces = parse(page)
    # Text without any block element is all there is to take: no tree tells it from the rest.
    post = model.content(nodes) if len(nodes) > 1 else [1.0]
    silent = [False] * len(nodes)
    for node in nodes:
        silent[node.index] = node.tag in SILENT or (node.up >= 0 and silent[node.up])
    blocks: list[str] = []
    held: list[str] = []
    cut = True
    for node, text, fresh in pieces:
        if fresh:
            cut = True
        if post[node] < 0.5 or silent[node]:
            continue
        if cut and held:
            blocks.append("".join(held))
            held = []
        cut = False
        held.append(text)
    if held:
        blocks.append("".join(held))
    cleaned = (" ".join(b.split()) for b in blocks)
    return " ".join(b for b in cleaned if b)


_SOUND = "ba de fo gu ki la mo ne pi ra so tu va we xo yi zu chi tra sen".split()


def labelled_pages(many: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[str, str]]:
    """Pages of various make, with their content elements under the class name that comes with each."""
    rng = random.Random(seed)
    mark = "x0content"

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(_SOUND) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def links(low: int, high: int, item: str = "li") -> str:
        one = [f"<a href='/{rng.random()}'>{words(1, 3)}</a>" for _ in range(rng.randint(low, high))]
        return "".join(f"<{item}>{x}</{item}>" for x in one) if item else " | ".join(one)

    def named(tag: str, names: list[str], body: str) -> str:
        name = f" {rng.choice(['class', 'id'])}=\"{rng.choice(names)}\"" if rng.random() < 0.85 else ""
        return f"<{tag}{name}>{body}</{tag}>"

    div = lambda names, body: f'<div class="{rng.choice(names)}">{body}</div>'

    def paragraph() -> str:
        body = words(3, 90)
        if rng.random() < 0.25:
            body += f" <a href='#'>{words(1, 3)}</a> " + words(3, 30)
        if rng.random() < 0.15:
            body = f"<b>{words(1, 4)}</b> {body}<br>{words(2, 12)}"
        return f'<p class="{mark}">{body}.</p>'

    def content() -> str:
        if rng.random() < 0.2:  # a very short article
            title = words(1, 3)
            return f'<h1 class="{mark}">{title}</h1>' * (rng.random() < 0.8) + f'<p class="{mark}">{rng.choice(["", "<b>"])}{words(1, 4)}.<br>'
        out = [f'<h1 class="{mark}">{words(2, 9)}</h1>'] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.72:
                out.append(paragraph())
            elif kind < 0.8:
                out.append(f'<h2 class="{mark}">{words(1, 6)}</h2>' + paragraph())
            elif kind < 0.86:
                out.append(f'<ul class="{mark}">' + "".join(f'<li class="{mark}">{words(2, 14)}</li>' for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.91:
                out.append(f'<blockquote class="{mark}">{paragraph()}</blockquote>')
            elif kind < 0.95:
                out.append(f'<table class="{mark}">' + "".join(f'<tr class="{mark}">' + "".join(f'<td class="{mark}">{words(1, 3)}</td>' for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            else:
                out.append(f'<pre class="{mark}">{words(4, 30)}</pre>')
            if rng.random() < 0.06:
                out.append(advert())
            if rng.random() < 0.04:
                out.append(named("aside", ["related", "promo", "more"], f"<ul>{links(2, 4)}</ul>"))
        return "".join(out)

    def advert() -> str:
        return div(["ad", "ads", "advert", "banner ad", "sponsored", "ad-slot", "promo", "adsense"], words(3, 25) if rng.random() < 0.7 else f"<p>{words(3, 20)}</p>")

    def menu() -> str:
        inner = f"<ul>{links(3, 9)}</ul>" if rng.random() < 0.7 else links(3, 8, "")
        return named(rng.choice(["nav", "nav", "div"]), ["menu", "nav", "navbar", "main-menu", "topnav", "breadcrumb", "navigation"], inner) if rng.random() < 0.75 else f"<nav>{inner}</nav>"

    def header() -> str:
        body = f"<h1>{words(1, 3)}</h1>" if rng.random() < 0.4 else f"<a href='/'>{words(1, 3)}</a>"
        return named(rng.choice(["header", "div"]), ["header", "site-header", "masthead", "top", "logo"], body + (menu() if rng.random() < 0.5 else f"<p>{words(2, 8)}</p>"))

    def footer() -> str:
        body = f"&copy; {words(1, 3)} &middot; {words(2, 15)}" if rng.random() < 0.6 else f"<p>{words(2, 15)}</p>{links(2, 5, '')}"
        return f"<footer>{body}</footer>" if rng.random() < 0.6 else div(["footer", "site-footer", "copyright", "bottom"], body)

    def sidebar() -> str:
        body = f"<h3>{words(1, 3)}</h3>" + (f"<ul>{links(3, 8)}</ul>" if rng.random() < 0.7 else f"<p>{words(4, 30)}</p>")
        return named(rng.choice(["aside", "div"]), ["sidebar", "side", "widget", "related", "sidebar-right", "recommended", "popular"], body) if rng.random() < 0.8 else f"<aside>{body}</aside>"

    def notice() -> str:
        return div(["cookie", "cookie-notice", "notice", "consent", "gdpr-banner", "alert", "newsletter", "subscribe", "popup", "modal"], (f"<p>{words(4, 25)}</p>" if rng.random() < 0.6 else words(4, 25)) + ("<button>ok</button>" if rng.random() < 0.5 else ""))

    def form() -> str:
        choice = f"<select>{''.join(f'<option>{words(1, 2)}</option>' for _ in range(rng.randint(2, 6)))}</select>" if rng.random() < 0.4 else ""
        return f"<form action='/s'><label>{words(1, 3)}</label><input name=q>{choice}<button>{words(1, 2)}</button>" + (f"<p>{words(2, 14)}</p>" if rng.random() < 0.5 else "") + "</form>"

    def comments() -> str:
        one = lambda: rng.choice(["<div class='comment'>{}</div>", "<li class='comment'>{}</li>", "<article class='comment'>{}</article>"]).format(f"<p>{words(3, 40)}</p>" if rng.random() < 0.7 else words(3, 40))
        return named(rng.choice(["section", "div"]), ["comments", "comment-list", "disqus", "responses", "replies", "discussion"], f"<h3>{words(1, 2)}</h3>" * (rng.random() < 0.6) + "".join(one() for _ in range(rng.randint(1, 5)))) if rng.random() < 0.95 else ""

    def share() -> str:
        return div(["share", "social", "share-buttons", "tags", "byline", "meta"], links(2, 4, ""))

    out = []
    for _ in range(many):
        body = content()
        if rng.random() < 0.25:
            body += share()
        if rng.random() < 0.2:
            body += form()
        if rng.random() < 0.25:
            body += comments()
        shell = rng.random()
        if shell < 0.08:  # plain text in the body or in one element
            tag = rng.choice(["body", "body", "div", "p", "td", "section"])
            text = f'<{tag} class="{mark}">{words(1, 60)}{rng.choice(["", f"<br>{words(1, 30)}", f" <i>{words(1, 4)}</i> {words(1, 9)}"])}</{tag}>'
            text = text if tag != "td" else f"<table><tr>{text}</tr></table>"
            if rng.random() < 0.6:
                text = f"<html><head><title>{words(2, 8)}</title></head>{text if tag == 'body' else f'<body>{text}</body>'}</html>"
            out.append((text, mark))
            continue
        if shell < 0.18:  # paragraphs with no container of their own
            article = body
        elif shell < 0.26:  # a layout of tables or of unnamed elements
            left = f"<ul>{links(3, 9)}</ul>" if rng.random() < 0.7 else f"<p>{links(2, 5, '')}</p>"
            cell = rng.choice(["td", "div"])
            article = f'<{cell}>{left}</{cell}><{cell} class="{mark}">{body}</{cell}>'
            article = f"<table><tr>{article}</tr></table>" if cell == "td" else article
        elif shell < 0.33:  # sections
            article = "".join(f'<section class="{mark}">{content()}</section>' for _ in range(rng.randint(1, 3)))
        elif shell < 0.65:
            article = f'<article class="{mark}">{body}</article>'
        elif shell < 0.76:
            article = f'<main class="{mark}">{body}</main>'
        elif shell < 0.84:
            article = f'<main class="{mark}"><article class="{mark}">{body}</article></main>'
        else:
            article = f'<div class="{mark} {rng.choice(["content", "post", "entry-content", "article-body", "story", "main", "text"])}">{body}</div>'
        before = [f for f in (header, menu, notice, advert, sidebar, form) if rng.random() < 0.4]
        after = [f for f in (sidebar, comments, notice, advert, form, share) if rng.random() < 0.3]
        if rng.random() < 0.2:  # nothing but the article
            before, after = [], []
        page = "".join(f() for f in before) + article + "".join(f() for f in after) + (footer() if after and rng.random() < 0.9 or rng.random() < 0.3 else "")
        if rng.random() < 0.2:
            page = f"<div id='{rng.choice(['wrapper', 'page', 'container'])}'>{page}</div>"
        out.append((f"<html><head><title>{words(2, 8)}</title></head><body>{page}</body></html>", mark))
    return out


_models: dict[int, Model] = {}


def default_model() -> Model:
    """The model of the default labelled pages, trained once in a process."""
    if SEED not in _models:
        _models[SEED] = train(labelled_pages())
    return _models[SEED]


def extracted(pages: DataFrame, html: str = "html", model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())  # some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sent.value
        for batch in batches:
            texts = [text_of(v.as_py(), mine) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col(html).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spread(table(spark, sf_dir, "pages")))
