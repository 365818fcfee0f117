"""Main text of web pages by a tree-structured graphical model.

The nodes are a page's block elements. Each is hidden state BOILER, MIXED (a container that has main text
below it among other things) or CONTENT. A node's potential is the likelihood of its tag, attribute words,
text length, link share and punctuation under each state; an edge's is the probability of a child's state
given its parent's and the child's kind. Sum-product messages go up from the leaves and down from the root,
and the marginals tell which nodes' own text is kept. All potentials are smoothed counts over labelled pages;
the labelled pages come from a generator of page layouts (``labelled_pages``), the bound of the training set.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BOILER, MIXED, CONTENT = 0, 1, 2
#: Pages of the training set.
PAGES = 600

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<=]*)")
#: The rest of a tag, with ">" in quotes; where a quote does not end, the tag ends at the first ">".
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
#: Elements whose text is no markup, up to their closing tag or the page's end.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that are dropped with what is in them.
DROPPED = RAW | frozenset("template svg select canvas video audio annotation annotation-xml datalist".split())
#: Elements that never hold anything.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: The label of an element of a generated page.
LABEL = re.compile(r'\bdata-state="([012])"')
WORD = re.compile(r"[a-z]+")
BLOCKS = frozenset(
    "html head body main article section div header footer nav aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd menu"
    " blockquote pre figure figcaption table caption thead tbody tfoot tr td th address details summary dialog center hgroup search noscript object".split()
)
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th caption summary address".split())
#: Elements of a head; whatever else opens ends it.
HEAD = frozenset("head title style script meta link base template noscript".split())
#: Elements that an opening tag closes, up to the element that bounds the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "thead": ({"thead", "tbody"}, {"table"}), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"tbody"}, {"table"})}
SCOPE = frozenset({"table", "td", "th", "caption", "html"})


class Node:
    """A block element: its own text runs (place, text), characters in links, parent's number."""

    __slots__ = ("tag", "parent", "words", "runs", "linked", "label")

    def __init__(self, tag: str, parent: int, attributes: str):
        self.tag, self.parent = tag, parent
        self.runs: list[tuple[int, str]] = []
        self.linked = 0
        self.label = None
        self.words = ()
        if attributes:
            self.words = tuple(dict.fromkeys(w for m in ATTRIBUTE.finditer(attributes) for w in WORD.findall((m[2] or m[3] or m[4] or "").lower())))


def tokens(page: str) -> Iterator[tuple[str, str | None, str, bool]]:
    """(text, None, "", False) or ("", tag, attributes, closing) of a page, in time linear in its length.

    A comment or raw text that does not end takes the rest of the page, and so does a tag without ">".
    """
    n, start, at, last = len(page), 0, 0, page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        m = NAME.match(page, at)
        if m is None and page[at + 1 : at + 2] not in ("!", "?", "/"):
            at += 1  # a plain "<"
            continue
        if at > start:
            yield page[start:at], None, "", False
        if m is None:
            end = page.find("-->", at + 4) + 2 if page.startswith("<!--", at) else page.find(">", at)
            start = at = n if end < at else end + 1
            continue
        if at > last:
            return
        rest = REST.match(page, m.end())
        end = rest.end() if rest else page.find(">", m.end()) + 1
        tag, closing = m[2].lower(), m[1] == "/"
        yield "", tag, page[m.end() : end - 1], closing
        start = at = end
        if tag in RAW and not closing:
            close = _closer(tag).search(page, end)
            start = at = n if close is None else close.start()
    if start < n:
        yield page[start:], None, "", False


@functools.cache
def _closer(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}(?=[\\s/>])", re.I)


class Closers:
    """Whether a page closes an element after some place; asked for ever later places, in linear time altogether."""

    def __init__(self, page: str):
        self.page, self.next = page, {}

    def __call__(self, tag: str, seen: int) -> bool:
        """``seen`` closing tags of this name have passed."""
        if tag not in self.next:
            self.next[tag] = sum(1 for _ in _closer(tag).finditer(self.page))
        return self.next[tag] > seen


def parse(page: str, labelled: bool = False) -> list[Node]:
    """The page's block elements in order, the root first; inline markup only counts as link or not.

    A body that no tag opens is opened by the first text or element that no head holds; text that stands in a body
    itself is a paragraph of its own.
    Only ``labelled`` pages, those of the trainer, are read for labels.
    """
    nodes = [Node("html", -1, "")]
    stack, link, place = [0], 0, 0
    held: Counter[str] = Counter()  # open block elements by tag
    passed: Counter[str] = Counter()  # closing tags of dropped elements
    closes_later = Closers(page)
    # the dropped element that is open, and what is open in it
    drop, inner = "", []

    def cut(k: int) -> None:
        for x in stack[k:]:
            held[nodes[x].tag] -= 1
        del stack[k:]

    def push(tag: str, attributes: str = "") -> None:
        nodes.append(Node(tag, stack[-1], attributes))
        stack.append(len(nodes) - 1)
        held[tag] += 1

    def in_body() -> None:
        if nodes[stack[-1]].tag in ("html", "head"):
            cut(1)
            push("body")

    for text, tag, attributes, closing in tokens(page):
        if tag is None:
            if drop:
                continue
            if not text.isspace():
                in_body()
                if nodes[stack[-1]].tag == "body":
                    place += 1
                    push("p")
            node = nodes[stack[-1]]
            if not text.isspace():
                node.runs.append((place, text))
                if link:
                    node.linked += len(text)
            elif node.runs:
                node.runs.append((place, " "))
            continue
        if closing and tag in DROPPED:
            passed[tag] += 1
        empty = tag in VOID or attributes.endswith("/")
        if drop:
            if not closing:
                if not empty and (tag in BLOCKS or tag == drop):
                    inner.append(tag)
                continue
            if tag in inner:
                while inner.pop() != tag:
                    pass
                continue
            if tag == drop:
                drop = ""
                continue
            if not held[tag]:
                continue
            drop, inner = "", []  # what holds the dropped element ends, and so does it
        if tag in DROPPED:
            if not closing and not empty and (tag in RAW or closes_later(tag, passed[tag])):
                drop, inner = tag, []
            continue
        if tag not in BLOCKS:
            if tag == "a":
                link = int(not closing)
            elif tag in VOID and nodes[stack[-1]].runs:
                nodes[stack[-1]].runs.append((place, " "))
            continue
        if tag == "html":
            continue
        place += 1
        if closing:  # a closing tag closes its element and all that is open in it
            if held[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        cut(k)
                        link = 0
                        break
            continue
        link = 0
        if tag == "body":
            if held["body"]:
                continue
            cut(1)
        elif tag not in HEAD:
            in_body()
        closes, bound = CLOSES.get(tag, ({"p"}, SCOPE))
        if tag not in CLOSES:
            if tag[0] == "h" and tag[1:].isdigit():
                closes = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
            for k in range(len(stack) - 1, 0, -1):
                own = nodes[stack[k]].tag
                if own in closes and (own == "p" or k == len(stack) - 1):
                    cut(k)
                    break
                if own in bound or own in ("div", "section", "article", "li") or not held["p"]:
                    break
        elif any(held[c] for c in closes):
            for k in range(len(stack) - 1, 0, -1):
                own = nodes[stack[k]].tag
                if own in closes:
                    cut(k)
                    break
                if own in bound:
                    break
        nodes.append(Node(tag, stack[-1], attributes))
        if labelled and (m := LABEL.search(attributes)):
            nodes[-1].label = int(m[1])
        if not empty:
            stack.append(len(nodes) - 1)
            held[tag] += 1
    return nodes


def _kind(tag: str) -> int:
    return 0 if tag in TEXT_TAGS else 2 if tag in ("nav", "aside", "footer", "form", "header", "dialog", "head", "menu", "search", "noscript") else 1


def features(node: Node) -> list[str]:
    n = sum(len(t) for _, t in node.runs)
    out = ["t:" + node.tag, "n:" + str(min(n.bit_length(), 9))]
    if n:
        text = "".join(t for _, t in node.runs)
        ends = sum(map(text.count, ".,;!?"))
        out += ["l:" + str(min(3, 4 * node.linked // n)), "p:" + str(min(3, ends)), "c:" + str(int("©" in text or "&copy;" in text or "copyright" in text.lower()))]
    return out + ["w:" + w for w in node.words]


class Model:
    """Smoothed counts of features by state and of child states by parent state and kind."""

    def __init__(self, pages: list[str]):
        seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
        edge = [[[1.0, 1.0, 1.0] for _ in range(3)] for _ in range(3)]
        total = [1.0, 1.0, 1.0]
        for page in pages:
            nodes = parse(page, labelled=True)
            for v in nodes[1:]:
                if v.label is None:
                    continue
                total[v.label] += 1
                for f in features(v):
                    seen[f][v.label] += 1
                up = nodes[v.parent].label
                edge[_kind(v.tag)][MIXED if up is None else up][v.label] += 1
        self.seen = {f: [log((n + 0.5) / (t + 1.0)) for n, t in zip(c, total, strict=True)] for f, c in seen.items()}
        self.edge = [[[x / sum(row) for x in row] for row in kind] for kind in edge]

    def marginals(self, nodes: list[Node]) -> list[list[float]]:
        """Each node's state probabilities: messages up from the leaves, then down from the root."""
        n = len(nodes)
        up = []
        for v in nodes:
            s = [0.0, 0.0, 0.0]
            for f in features(v):
                if (w := self.seen.get(f)) is not None:
                    s = [s[0] + w[0], s[1] + w[1], s[2] + w[2]]
            top = max(s)
            up.append([2.718281828459045 ** max(x - top, -200.0) for x in s])
        up[0] = [0.0, 1.0, 0.0]
        message: list = [None] * n
        for k in range(n - 1, 0, -1):
            e, b = self.edge[_kind(nodes[k].tag)], up[k]
            m = [r[0] * b[0] + r[1] * b[1] + r[2] * b[2] for r in e]
            z = m[0] + m[1] + m[2]
            message[k] = m = [m[0] / z, m[1] / z, m[2] / z]
            p = up[nodes[k].parent]
            p[0] *= m[0]
            p[1] *= m[1]
            p[2] *= m[2]
            z = p[0] + p[1] + p[2]
            if z < 1e-100:
                p[0], p[1], p[2] = p[0] * 1e100, p[1] * 1e100, p[2] * 1e100
        out = [[0.0, 1.0, 0.0]] + [[0.0] * 3 for _ in range(n - 1)]
        for k in range(1, n):
            p, m, e = out[nodes[k].parent], message[k], self.edge[_kind(nodes[k].tag)]
            rest = [x / max(y, 1e-300) for x, y in zip(p, m, strict=True)]
            b = [up[k][s] * (rest[0] * e[0][s] + rest[1] * e[1][s] + rest[2] * e[2][s]) for s in range(3)]
            z = sum(b) or 1.0
            out[k] = [x / z for x in b]
        return out

    def text(self, page: str) -> str:
        """The main text of a page: its content nodes' own text in page order, a line for each block."""
        nodes = parse(page)
        out: list[tuple[int, int, str]] = []
        for k, (v, m) in enumerate(zip(nodes, self.marginals(nodes), strict=True)):
            if v.runs and m[CONTENT] > 0.5:
                # text of one element before and after a child block are two blocks
                at, part = v.runs[0][0], []
                for place, t in v.runs:
                    if place != at and part:
                        out.append((at, k, "".join(part)))
                        part = []
                    at = place
                    part.append(t)
                out.append((at, k, "".join(part)))
        lines = (" ".join(html.unescape(t).split()) for _, _, t in sorted(out, key=lambda x: x[0]))
        return "\n".join(t for t in lines if t)


# -- labelled pages --------------------------------------------------------------------------------

#: Attribute words of boilerplate, by the element that carries them.
BOILER_WORDS = {
    "menu": "nav navigation navbar menu topnav breadcrumb breadcrumbs pagination pager toolbar links skip",
    "header": "header masthead topbar top banner branding logo hero",
    "footer": "footer foot bottom copyright legal colophon disclaimer",
    "side": "sidebar side aside widget related recommended trending popular tags categories archive",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning message",
    "ad": "ad ads advert advertisement adsbox promo promoted promotion sponsor sponsored banner",
    "form": "form search login signup subscribe newsletter contact register",
    "comments": "comments comment replies reply respond disqus discussion feedback reader",
    "share": "share social sharing follow author bio meta byline tools actions",
}
CONTENT_WORDS = "article content main post entry body story text prose markdown primary blog page"
MIXED_WORDS = "wrapper container page layout row col grid site root app outer inner wrap"


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[str]:
    """Pages of many layouts; each element's data-state is its label."""
    rng = random.Random(seed)
    syllables = "the re on er an ti es nd st en at ed th or ha of it is ing al ar le se ve ma ri ro co de".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def prose(a: int, b: int) -> str:
        out = []
        for _ in range(rng.randint(a, b)):
            s = words(2, 16)
            if rng.random() < 0.4:
                s = s.replace(" ", ", ", 1)
            if rng.random() < 0.1:
                s += f' <a href="/x">{words(1, 3)}</a>'
            out.append(s.capitalize() + rng.choice("...?!"))
        return " ".join(out)

    def el(tag: str, state: int, inner: str, attributes: str = "") -> str:
        end = "" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>"
        return f'<{tag} data-state="{state}"{attributes}>{inner}{end}'

    def named(pool: str, least: float = 0.85) -> str:
        if rng.random() > least:
            return ""
        name = rng.choice(pool.split())
        if rng.random() < 0.3:
            name += rng.choice("-_ ") + rng.choice((pool + " box block area section list item").split())
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def link() -> str:
        return f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'

    def listing(state: int, tag: str = "ul") -> str:
        return el(tag, state, "".join(el("li", state, link()) for _ in range(rng.randint(2, 8))))

    def boiler(kind: str) -> str:
        pool, plain = BOILER_WORDS[kind], rng.random() < 0.5
        text = rng.random() < 0.5
        if kind == "menu":
            return el("nav", 0, listing(0)) if plain else el("div", 0, listing(0) if text else " ".join(link() for _ in range(4)), named(pool, 1))
        if kind == "header":
            return el("header" if plain else "div", 0, (el("h1", 0, words(1, 4)) if text else link()) + (el("p", 0, words(2, 8)) if rng.random() < 0.4 else ""), named(pool, 0.4 if plain else 1))
        if kind == "footer":
            inner = "&copy; " + words(1, 4) + " &middot; " + prose(1, 2) if text else el("p", 0, "Copyright " + words(1, 6)) + listing(0)
            return el("footer" if plain else "div", 0, inner, named(pool, 0.4 if plain else 1))
        if kind == "side":
            return el("aside" if plain else "div", 0, el("h3", 0, words(1, 3)) + (listing(0) if text else el("p", 0, prose(1, 4))), named(pool, 0.5 if plain else 1))
        if kind == "notice":
            return el(rng.choice(["div", "div", "div", "section", "dialog", "noscript"]), 0, prose(1, 3) if text else el("p", 0, prose(1, 3)), named(pool, 1))
        if kind == "ad":
            return el(rng.choice(["div", "div", "aside", "section"]), 0, prose(1, 3) if text else el("p", 0, prose(1, 4)), named(pool, 1))
        if kind == "form":
            inner = (el("p", 0, prose(1, 2)) if text else words(1, 6)) + "<input><label>" + words(1, 3) + "</label>"
            return el("form", 0, inner, named(pool, 0.5)) if plain else el("div", 0, el("form", 0, inner), named(pool, 1))
        if kind == "comments":
            one = lambda: el(rng.choice(["div", "li", "article"]), 0, el("p", 0, prose(1, 6)) if rng.random() < 0.7 else prose(1, 6), named(BOILER_WORDS["comments"], 1))
            return el(rng.choice(["section", "div", "ol"]), 0, (el("h3", 0, words(1, 3)) if text else "") + "".join(one() for _ in range(rng.randint(1, 5))), named(pool, 1))
        return el("div", 0, words(1, 4) + (listing(0) if text else ""), named(pool, 1))

    def body_blocks() -> str:
        out = []
        for _ in range(rng.randint(1, 10)):
            kind = rng.random()
            if kind < 0.62:
                mark = "<b>" if rng.random() < 0.2 else ""
                out.append(el("p", 2, mark + prose(1, 7) + ("<br>" if rng.random() < 0.1 else "")))
            elif kind < 0.72:
                out.append(el(rng.choice(["h2", "h3", "h4"]), 2, words(1, 9)))
            elif kind < 0.80:
                out.append(el(rng.choice(["ul", "ol"]), 2, "".join(el("li", 2, prose(1, 2) if rng.random() < 0.7 else words(1, 5)) for _ in range(rng.randint(1, 5)))))
            elif kind < 0.85:
                out.append(el("blockquote", 2, prose(1, 3) if rng.random() < 0.5 else el("p", 2, prose(1, 3))))
            elif kind < 0.88:
                out.append(el("pre", 2, words(2, 20)))
            elif kind < 0.91:
                out.append(el("table", 2, "".join(el("tr", 2, "".join(el("td", 2, words(1, 4)) for _ in range(3))) for _ in range(rng.randint(1, 4)))))
            elif kind < 0.94:
                out.append(el(rng.choice(["figure", "figure", "figure", "object", "noscript"]), 2, "<img src=x>" + (el("figcaption", 2, words(2, 9)) if rng.random() < 0.7 else prose(1, 3))))
            elif kind < 0.97:
                out.append(el(rng.choice(["section", "div"]), 2, el("p", 2, prose(1, 4)), named(CONTENT_WORDS, 0.3)))
            else:
                out.append(el("dl", 2, el("dt", 2, words(1, 3)) + el("dd", 2, prose(1, 2))))
        return "".join(out)

    pages = []
    kinds = list(BOILER_WORDS)
    for _ in range(n):
        title = words(2, 12)
        head = f"<head><meta charset=utf-8><title>{title}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head>"
        h1 = el("h1", 2, title) if rng.random() < 0.85 else ""
        if h1 and rng.random() < 0.15:
            h1 = el("header", 2, h1)
        blocks = h1 + body_blocks()
        if rng.random() < 0.3:
            blocks += boiler(rng.choice(["ad", "share", "side", "form", "notice", "comments"])) + (body_blocks() if rng.random() < 0.5 else "")
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
        main = el(tag, 2, blocks, named(CONTENT_WORDS, 0.3 if tag in ("article", "main") else 1))
        inner = [boiler(k) for k in rng.sample(["ad", "side", "comments", "menu", "notice", "share"], rng.randint(0, 2))]
        inner.insert(rng.randint(0, len(inner)), main)
        if rng.random() < 0.4:
            main = el(rng.choice(["main", "div", "section"]), 1, "".join(inner), named(MIXED_WORDS, 0.8))
        else:
            main = "".join(inner)
        before = [boiler(k) for k in kinds if rng.random() < 0.25 and k not in ("comments", "footer")]
        after = [boiler(k) for k in kinds if rng.random() < 0.25 and k not in ("header", "menu")] + ([boiler("footer")] if rng.random() < 0.7 else [])
        rng.shuffle(before)
        whole = "".join(before) + main + "".join(after)
        if rng.random() < 0.3:
            whole = el("div", 1, whole, named(MIXED_WORDS, 0.9))
        pages.append(f'<!DOCTYPE html><html>{head}<body data-state="1">{whole}' + ("</body></html>" if rng.random() < 0.8 else ""))
    return pages


def extract(pages: DataFrame, model: Model | None = None, column: str = "html") -> DataFrame:
    """``pages`` with a column ``text``: the main text, empty if there is none.

    Null and empty pages give an empty text. Rows are independent, so repeated rows repeat their result; an
    empty table gives none. The column of the pages goes, a column ``text`` that is already there is replaced;
    others stay. Elements that a page does not close end with what holds them; nothing makes a page fail.
    """
    C.text_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or Model(labelled_pages()))
    kept = [c for c in pages.columns if c not in ("text", column)]
    source = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{column}`").cast("string").alias("__page"))
    schema = source.drop("__page").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [model.text(p.as_py() or "") for p in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    return source.mapInArrow(run, schema)


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text; repeated rows repeat theirs."""
    pages = C.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
