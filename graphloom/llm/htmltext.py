"""Main text of web pages by a tree-structured graphical model.

Every block element and every run of text is a binary variable: does it carry main content? Node
potentials score tag, class words, link share and length; parent-child potentials tie a node to its
container. Messages pass up and then down the tree (sum-product), which is exact on trees, and text runs
whose marginal is above one half are kept. The potentials are fitted by gradient ascent on the
likelihood of labelled pages; the labelled pages are written by :func:`labelled_pages`.
"""

from __future__ import annotations

import html
import math
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import map_batches, read, texts

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var output ruby rb rp rt".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("table td th caption button body html article section div li ul ol nav aside header footer main form".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}

#: Words looked for in class, id and role; what each one means is learnt.
KEYS = frozenset(
    """ad ads advert advertisement adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert warning popup modal overlay newsletter
    subscribe subscription signup login search form nav navbar navigation menu breadcrumb breadcrumbs pager pagination topbar toolbar header masthead logo footer bottom copyright legal
    sidebar aside side rail widget related recommended recommend popular trending more share sharing social follow comment comments commentlist discussion reply replies respond disqus
    author byline meta tags tag date article content main post entry story body text page wrapper container hentry blog prose skip hidden print contentinfo complementary""".split()
)
TAG = re.compile(r"""<(?:!--(?:.*?-->|.*)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>|$))""", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role|data-main|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    parent: int
    tag: str  #: ``#text`` for a run of text
    keys: tuple[str, ...] = ()
    text: list[str] = field(default_factory=list)
    linked: int = 0
    label: int = 0


def parse(page: str) -> list[Node]:
    """Block elements and text runs in page order; parents come before children.

    Inline elements belong to the run around them, ``br`` is a space. Unclosed paragraphs and items end where HTML ends
    them, a tag that the page's end cuts off is dropped, and stray closing tags are ignored.
    """
    nodes = [Node(-1, "#root")]
    stack: list[tuple[str, int]] = [("#root", 0)]  # every open element; inline ones share their container's node
    links, at, run, end = 0, 0, None, len(page)

    def say(s: str) -> None:
        nonlocal run
        if not s:
            return
        if run is None:
            if s.isspace():
                return
            run = Node(stack[-1][1], "#text")
            nodes.append(run)
        run.text.append(s)
        if links:
            run.linked += len(s)

    def pop(to: int) -> None:
        nonlocal links, run
        while len(stack) > to:
            tag, _ = stack.pop()
            if tag == "a":
                links -= 1
            elif tag not in INLINE:
                run = None

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        m = TAG.match(page, lt)
        if m is None:  # a lone less-than sign, or </ without a name
            say(page[at : lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        at = m.end()
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name or (m[5] and m[7] == ""):  # comment, declaration, or cut off by the end
            continue
        name = name.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if stack[k][0] in SCOPES and name in INLINE:
                    break
            continue
        if name == "br":
            say(" ")
            continue
        if name in VOID:
            if name == "hr":
                run = None
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            at = end if close is None else close.start()
            if close is not None:
                gt = page.find(">", at)
                at = end if gt < 0 else gt + 1
            continue
        shut = SAME.get(name, {"p"} if name in CLOSES_P else ())
        if shut:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in shut:
                    pop(k)
                    if name in ("li", "dt", "dd"):
                        break
                elif stack[k][0] not in INLINE and stack[k][0] not in ("dt", "dd", "tr", "td", "th"):
                    break
        if name in INLINE:
            stack.append((name, stack[-1][1]))
            links += name == "a"
            continue
        run = None
        keys: list[str] = []
        label = 0
        for a in ATTR.finditer(attrs) if attrs else ():
            what, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if what == "data-main":
                label = 1
            elif what == "hidden" or (what == "aria-hidden" and value == "true") or (what == "style" and re.search(r"display\s*:\s*none", value)):
                keys.append("hidden")
            elif what != "style" and what != "aria-hidden":
                for token in PART.findall(value):
                    t = token.lower()
                    if t in KEYS or (t := t.rstrip("s")) in KEYS:
                        keys.append(t)
        node = Node(stack[-1][1], name, tuple(dict.fromkeys(keys)), label=label)
        nodes.append(node)
        stack.append((name, len(nodes) - 1))
    return nodes


def clean(run: Node) -> str:
    """References decoded, white space runs to one space, ends trimmed."""
    return " ".join(html.unescape("".join(run.text)).split())


def features(nodes: list[Node], said: list[str]) -> list[list[str]]:
    out = []
    for n, s in zip(nodes, said):
        if n.tag != "#text":
            out.append(["e:" + n.tag, *["k:" + k for k in n.keys], "e:keys" if n.keys else "e:plain"])
            continue
        total = sum(map(len, n.text))
        share = n.linked / total if total else 0.0
        out.append(["t:" + nodes[n.parent].tag, "t:len%d" % min(6, len(s).bit_length() // 2), "t:link%d" % int(share * 3.99), "t:stop" if s[-1:] in ".!?…。" else "t:open", *["t:mark"] * (s[:1] == "©" or s[:9].lower() == "copyright")])
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  #: log odds of content for each feature
    pair: tuple[tuple[tuple[float, float], tuple[float, float]], ...]  #: [child is text][parent][child], log potentials

    def marginals(self, nodes: list[Node], feats: list[list[str]]) -> list[float]:
        return sum_product(nodes, [sum(self.weights.get(f, 0.0) for f in x) for x in feats], self.pair)[0]


def sum_product(nodes: list[Node], unary: list[float], pair) -> tuple[list[float], list[float] | None]:
    """(P(node = 1), and P(parent = a, child = b) flattened by node) from one pass up and one pass down.

    Messages are ratios in log space, scaled at every step, so neither depth nor width under- or overflows.
    """
    n = len(nodes)
    exp, log = math.exp, math.log
    up0, up1 = [0.0] * n, list(unary)  # log of the product of what comes from below, for 0 and 1
    msg: list[tuple[float, float]] = [(0.0, 0.0)] * n

    def lse(a: float, b: float) -> float:
        return a + log(1 + exp(b - a)) if a >= b else b + log(1 + exp(a - b))

    for k in range(n - 1, 0, -1):  # children come after their parents
        t = pair[int(nodes[k].tag == "#text")]
        m0, m1 = lse(t[0][0] + up0[k], t[0][1] + up1[k]), lse(t[1][0] + up0[k], t[1][1] + up1[k])
        top = m0 if m0 > m1 else m1
        m0, m1 = m0 - top, m1 - top
        msg[k] = (m0, m1)
        p = nodes[k].parent
        up0[p] += m0
        up1[p] += m1
    bel0, bel1, joint = up0[:], up1[:], [0.0] * (4 * n)
    for k in range(n):
        if k:
            p, t = nodes[k].parent, pair[int(nodes[k].tag == "#text")]
            c0, c1 = bel0[p] - msg[k][0], bel1[p] - msg[k][1]  # all that the parent knows from elsewhere
            j = (c0 + t[0][0] + up0[k], c0 + t[0][1] + up1[k], c1 + t[1][0] + up0[k], c1 + t[1][1] + up1[k])
            top = max(j)
            e = [exp(x - top) for x in j]
            z = sum(e)
            joint[4 * k : 4 * k + 4] = [x / z for x in e]
            bel0[k], bel1[k] = lse(j[0], j[2]), lse(j[1], j[3])
        z = lse(bel0[k], bel1[k])
        bel0[k], bel1[k] = bel0[k] - z, bel1[k] - z
    return [exp(b) for b in bel1], joint


def extract(page: str, model: Model) -> str:
    nodes = parse(page)
    said = [clean(n) if n.tag == "#text" else "" for n in nodes]
    if not any(said):
        return ""
    p = model.marginals(nodes, features(nodes, said))
    return "\n".join(s for n, s, q in zip(nodes, said, p) if s and q > 0.5)


# ---- training


def labelled_pages(count: int, seed: int = 11) -> list[str]:
    """Pages in many layouts whose main blocks bear ``data-main``. Layout words are drawn, texts are invented."""
    rnd = random.Random(seed)
    syll = "an be co du el fa go hi jo ka lu me no or pu ra su ti vo we th er on in".split()
    word = lambda: "".join(rnd.choice(syll) for _ in range(rnd.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b)))
    pick = rnd.choice

    def para() -> str:
        s = say(*pick(((2, 5), (8, 40), (40, 120))))
        if rnd.random() < 0.3:
            s = f"{say(1, 5)} <a href='/x'>{say(1, 3)}</a> {s}"
        return pick((s + ".", s + ".", f"<b>{s}.</b>", f"<b>{s}.<br>", s + ".", f"<em>{say(1, 4)}</em> {s}.", s + pick(("", "!", "?"))))

    def box(tags: str, names: str, inner: str, bare: float = 0.0) -> str:
        tag = pick(tags.split())
        attr = "" if tag != "div" and tag != "section" and rnd.random() < 0.6 or rnd.random() < bare else f' {pick(("class", "id"))}="{pick(names.split())}{pick(("", "", "-box", "-" + word()))}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    items = lambda n: "".join(f"<li><a href='/{word()}'>{say(1, 3)}</a></li>" for _ in range(n))
    plain = lambda: pick((say(3, 25) + ".", f"<p>{say(3, 30)}.</p>", f"<p>{say(2, 12)}. <a href='/a'>{say(1, 3)}</a></p>"))
    junk = {
        "menu": lambda: box("nav nav div ul", "nav navbar menu navigation breadcrumbs topbar pagination", f"<ul>{items(rnd.randint(2, 8))}</ul>"),
        "header": lambda: box("header header div", "header masthead topbar banner logo", pick((f"<h1><a href='/'>{say(1, 3)}</a></h1>", f"<p>{say(1, 6)}</p>", f"<div class='logo'>{say(1, 3)}</div><ul>{items(3)}</ul>"))),
        "ad": lambda: box("div div section aside ins", "ad ads advert advertisement sponsored promo banner ad-slot adsense", pick((say(3, 20) + ".", say(3, 30) + ".", plain()))),
        "notice": lambda: box("div div section", "cookie cookie-notice consent gdpr notice alert popup modal newsletter subscribe", f"{plain()}<button>{say(1, 2)}</button>"),
        "side": lambda: box("aside aside div section", "sidebar side widget related recommended popular trending rail", f"<h3>{say(1, 4)}</h3>{pick((plain(), f'<ul>{items(4)}</ul>', plain() + plain()))}"),
        "form": lambda: box("form", "search login signup subscribe form", f"<label>{say(1, 3)}</label><input name=q><p>{say(2, 9)}.</p><button>{say(1, 2)}</button>"),
        "share": lambda: box("div ul", "share social follow sharing tags meta", items(rnd.randint(2, 4))),
        "comments": lambda: box("section div div", "comments comment-list discussion replies respond disqus", f"<h3>{say(1, 3)}</h3>" + "".join(pick((f"<div class='comment'><p>{say(4, 50)}.</p></div>", f"<p>{say(4, 50)}.</p>", f"<article class='comment'><p>{say(4, 50)}.</p></article>", f"<li class='reply'>{say(3, 30)}.</li>")) for _ in range(rnd.randint(1, 5)))),
        "footer": lambda: box("footer footer div", "footer bottom copyright legal contentinfo", pick((f"&copy; {word()}.example &middot; {say(2, 14)}.", f"<p>Copyright {say(2, 9)}.</p>", f"<ul>{items(3)}</ul><p>{say(3, 20)}.</p>"))),
    }

    def article() -> str:
        blocks = [f"<h1 data-main=1>{say(2, 9)}{pick(('', '.', ''))}</h1>"] * (rnd.random() < 0.9)
        for _ in range(rnd.randint(0, 14)):
            r = rnd.random()
            if r < 0.7:
                blocks.append(f"<p data-main=1>{para()}" + pick(("</p>", "</p>", "")))
            elif r < 0.8:
                blocks.append(f"<h{rnd.randint(2, 4)} data-main=1>{say(1, 6)}</h2>")
            elif r < 0.86:
                blocks.append("<ul>" + "".join(f"<li data-main=1>{say(2, 18)}.</li>" for _ in range(3)) + "</ul>")
            elif r < 0.9:
                blocks.append(f"<blockquote data-main=1>{say(5, 30)}.</blockquote>")
            elif r < 0.93:
                blocks.append(f"<pre data-main=1>{say(5, 20)}</pre>")
            elif r < 0.95:
                blocks.append(f"<table><tr><td data-main=1>{say(1, 4)}</td><td data-main=1>{say(1, 4)}</td></tr></table>")
            else:
                blocks.append(junk[pick(("ad", "share", "side", "notice"))]())
        tag, attr = pick((("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("div", ' class="post entry"'), ("div", ' class="article-body"'), ("section", ' class="story"')))
        inner = "".join(blocks)
        if rnd.random() < 0.2:
            inner = f'<div class="{pick(("entry", "content", "text", "prose"))}">{inner}</div>'
        return f"<{tag}{attr}>{inner}" + f"</{tag}>"

    pages = []
    for _ in range(count):
        before = [junk[k]() for k in ("header", "menu", "notice", "ad", "form", "side") if rnd.random() < 0.5]
        after = [junk[k]() for k in ("share", "comments", "side", "ad", "form", "notice") if rnd.random() < 0.4] + [junk["footer"]()] * (rnd.random() < 0.9)
        rnd.shuffle(before)
        body = "".join(before) + article() + "".join(after)
        if rnd.random() < 0.4:
            body = f'<div class="{pick(("page", "wrapper", "container", "site"))}">{body}</div>'
        page = f"<!DOCTYPE html><html><head><title>{say(2, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"
        pages.append(page[: rnd.randint(len(page) // 2, len(page))] if rnd.random() < 0.15 else page)
    return pages


def gold(nodes: list[Node]) -> list[int]:
    """A text run is content inside a marked block; an element is content if anything in it is."""
    y = [0] * len(nodes)
    marked = [False] * len(nodes)
    for k, n in enumerate(nodes):
        marked[k] = bool(n.label) or (n.parent >= 0 and marked[n.parent])
        y[k] = int(n.tag == "#text" and marked[k])
    for k in range(len(nodes) - 1, 0, -1):
        if y[k]:
            y[nodes[k].parent] = 1
    return y


def gold_text(page: str) -> str:
    nodes = parse(page)
    return "\n".join(clean(n) for n, y in zip(nodes, gold(nodes)) if n.tag == "#text" and y and clean(n))


@lru_cache(maxsize=2)
def fit(count: int = 260, rounds: int = 60, seed: int = 11, decay: float = 0.02) -> Model:
    """Gradient ascent on the labelled pages' log likelihood: what the labels show less what the model expects."""
    trees = []
    names: dict[str, int] = {}
    for page in labelled_pages(count, seed):
        nodes = parse(page)
        feats = features(nodes, [clean(n) if n.tag == "#text" else "" for n in nodes])
        rows = [[names.setdefault(f, len(names)) for f in x] for x in feats]
        trees.append((nodes, rows, gold(nodes)))
    w, pair = np.zeros(len(names)), np.zeros((2, 2, 2))
    gw2, gp2 = np.full(len(names), 1e-6), np.full((2, 2, 2), 1e-6)
    for _ in range(rounds):
        gw, gp, now, table = -decay * w, -decay * pair, w.tolist(), pair.tolist()
        for nodes, rows, y in trees:
            p, joint = sum_product(nodes, [sum(now[f] for f in r) for r in rows], table)
            for k, r in enumerate(rows):
                d = y[k] - p[k]
                for f in r:
                    gw[f] += d
                if k:
                    t = int(nodes[k].tag == "#text")
                    gp[t, y[nodes[k].parent], y[k]] += 1
                    gp[t] -= np.array(joint[4 * k : 4 * k + 4]).reshape(2, 2)
        gw2 += gw * gw
        gp2 += gp * gp
        w += 0.5 * gw / np.sqrt(gw2)
        pair += 0.5 * gp / np.sqrt(gp2)
    return Model({f: float(w[k]) for f, k in names.items()}, tuple(tuple(tuple(map(float, a)) for a in b) for b in pair))


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each page. Null or empty html, and a page without main text, give an empty text."""
    fitted = model or fit()

    def make():
        def each(b: pa.RecordBatch):
            out = [extract(t, fitted) for t in texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

        return each

    return map_batches(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", make, "html")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages", "page_id", "url", "html"))
