"""Main text of web pages: flat text blocks, classified by a decision tree.

The page is cut into blocks at block-level tags. A block is described by its word count and link
density, those of the blocks before and behind it, and by what stands around it: an article or
main element, furniture (menus, forms, asides, elements named like adverts, notices,
comments and so on), a heading. A decision tree grown on the blocks of the small labelled
pages in ``LABELLED`` tells text from furniture. Kept blocks are joined in page order.

Defined cases: a null or empty page has an empty text; text outside any tag is a block;
unclosed and unknown tags, stray ``<`` and cut-off pages are read as browsers do, more or less;
repeated rows are read one by one; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodeworks.llm.common import text_slices

# The element names of the markup language.
RAW = "script|style|title|textarea|iframe|noembed|noframes|xmp"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th "
    "thead tr ul".split()
)
FURNITURE = set(
    "aside button dialog footer form header head menu nav noscript object search select svg template".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = {"article", "main"}
# A new one of these closes an open one up to the element it lives in.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Names (of class, id or role) that furniture goes by; made up from common usage.
NAMES = set(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar side widget widgets related recommended share sharing "
    "social cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe "
    "subscription signup login comment comments commentlist reply replies respond discussion disqus footer "
    "header masthead topbar toolbar pagination pager teaser teasers contentinfo complementary search "
    "dialog hidden".split()
)
_WRAPS = re.compile(r"^(has|with|no|without|is|page|site)[-_]|[-_](enabled|open|on|off|wrapper-all)$")
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-z][^\s/<>]*)(?P<rest>(?:[^<>"']|"[^"<]*"|'[^'<]*')*+>|[^<>]*>)""",
    re.IGNORECASE | re.DOTALL,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/>]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)

FEATURES = 10


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    inside: bool = False
    furniture: bool = False
    heading: bool = False


def is_furniture(name: str, rest: str) -> bool:
    if name in ("html", "body"):
        return False
    if name in FURNITURE or _HIDDEN.search(rest):
        return True
    for match in _NAMED.finditer(rest):
        for token in (match[1] or match[2] or match[3] or "").lower().split():
            if not _WRAPS.search(token):
                pieces = re.split(r"[-_]+", token)
                if token in NAMES or pieces[0] in NAMES or pieces[-1] in NAMES:
                    return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, blank ones left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is furniture
    now = Block()

    def flush() -> None:
        nonlocal now
        if "".join(now.parts).strip():
            out.append(now)
        names = [n for n, _ in stack]
        now = Block(
            inside=any(n in MAIN for n in names),
            furniture=any(f for _, f in stack),
            heading=bool(HEADINGS.intersection(names)),
        )

    def close(names: set[str], within: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in within:
                return
            if stack[i][0] in names:
                del stack[i:]
                return

    def text(raw: str) -> None:
        if raw:
            now.parts.append(raw)
            if any(n == "a" for n, _ in stack):
                now.linked.append(raw)

    at = 0
    for token in _TOKEN.finditer(page):
        text(page[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if token["raw"] or not name:
            continue
        if name == "br":
            text("\n")
        if token["end"]:
            opened = any(n == name for n, _ in stack)
            if opened:
                close({name}, set())
            if name in BLOCK:
                flush()
            elif opened and not any(n in MAIN for n, _ in stack):
                now.furniture = now.furniture or any(f for _, f in stack)
            continue
        if name in BLOCK:
            close({"p"}, {"td", "th", "table", "button", "object"})
            if name in SIBLINGS:
                close(*SIBLINGS[name])
        if name not in VOID and not token["rest"].endswith("/>"):
            stack.append((name, is_furniture(name, token["rest"])))
        if name in BLOCK or stack and stack[-1][0] == name and stack[-1][1]:
            flush()
    text(page[at:])
    flush()
    return out


def plain(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def describe(blocks: list[Block]) -> np.ndarray:
    """Features of every block, with those of its neighbours."""
    n = len(blocks)
    own = np.zeros((n + 2, 2))
    for i, b in enumerate(blocks, 1):
        words = len("".join(b.parts).split())
        own[i] = words, min(1.0, len("".join(b.linked).split()) / max(words, 1))
    flags = np.array([[b.inside, b.furniture, b.heading] for b in blocks], dtype=float).reshape(n, 3)
    anywhere = np.full((n, 1), float(any(b.inside for b in blocks)))
    return np.hstack((own[1:-1], own[:-2], own[2:], flags, anywhere))


@dataclass
class Node:
    value: float
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Node:
    """A decision tree by Gini impurity; a cut lies midway between two values."""
    node = Node(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or node.value in (0.0, 1.0):
        return node
    best = len(y) * node.value * (1 - node.value) - 1e-9
    for f in range(x.shape[1]):
        by = np.argsort(x[:, f], kind="stable")
        values, positive = x[by, f], np.cumsum(y[by])
        cut = np.flatnonzero(np.diff(values) > 0)
        left, right = cut + 1, len(y) - cut - 1
        a, b = positive[cut], positive[-1] - positive[cut]
        impurity = a * (1 - a / left) + b * (1 - b / right)
        if len(cut) and impurity.min() < best:
            best = impurity.min()
            at = cut[int(np.argmin(impurity))]
            node.feature, node.limit = f, float((values[at] + values[at + 1]) / 2)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.limit
        node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    low = x[:, node.feature] <= node.limit
    out = np.empty(len(x))
    out[low], out[~low] = predict(node.low, x[low]), predict(node.high, x[~low])
    return out


_PROSE = "One plain sentence after the other tells what happened on that long day by the river and why."
# The labelled table: made-up pages, and for each of their blocks whether it is main text.
LABELLED: list[tuple[str, list[int]]] = [
    (
        "<body><nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><div class='ad'>Buy these shoes now and "
        f"save a lot.</div><article><h1>A day</h1><p>{_PROSE}<p>Yes.<p>{_PROSE} {_PROSE}</article>"
        "<footer>All rights reserved by the paper, see the imprint for the names.</footer></body>",
        [0, 0, 0, 1, 1, 1, 1, 0],
    ),
    (
        f"<header>The Daily Paper</header><main><h2>Short</h2><p>Ok.</p><p>{_PROSE}</p><aside>More on this: <a>a"
        f"</a></aside><form>Your mail address <button>Send</button></form><p>See <a>the whole long report of it"
        f"</a>.</p></main><section class='comments'><p>{_PROSE}</p><p>I disagree.</p></section>",
        [0, 1, 1, 1, 0, 0, 0, 1, 0, 0],
    ),
    (
        f"<div class=menu><a>One</a> <a>Two</a></div><div><h1>No article tag</h1><p>{_PROSE}</p><p>{_PROSE} {_PROSE}"
        f"</p><p>Brief.</p><p>{_PROSE}</p></div><div class='sidebar'><p>{_PROSE}</p></div><div id=footer>Imprint</div>",
        [0, 1, 1, 1, 1, 1, 0, 0],
    ),
    (
        f"<ul><li><a>Start page</a><li><a>Contact us</a><li><a>About the firm</a></ul><p>{_PROSE}</p><p>{_PROSE}</p>"
        "<p><a>Read more of these stories in the archive</a></p><p><a>Next</a></p>",
        [0, 0, 0, 1, 1, 0, 0],
    ),
    (
        f"<article><header><h1>In the head</h1></header><p>{_PROSE}</p><ul><li>First point</li><li>Second</li></ul>"
        f"<div class='share'>Tell friends</div><p>{_PROSE}</p></article><div>Outside of it all, not far below.</div>"
        f"<p>{_PROSE}</p>",
        [1, 1, 1, 1, 0, 1, 0, 0],
    ),
    (
        f"<div class='cookie-notice'>We use cookies to make this better for you.</div><article><h1>T</h1><p><b>{_PROSE}"
        f"</b><br>and on</p><table><tr><td>cell</td><td>12</td></tr></table></article><div class='related'><a>x y z</a>"
        f"</div><div class='newsletter'><p>{_PROSE}</p></div>",
        [0, 1, 1, 1, 1, 0, 0],
    ),
    (
        "<header><h1>Site of ours</h1></header><nav><a>a</a></nav><article><h1>One</h1><p>Two.<p>Three of them.<p>No"
        f"<p>{_PROSE}<p>Four.<p><a>A link alone</a><p>Five<p>Six words are in this one.</article><div>Seven.</div>"
        f"<p>{_PROSE} {_PROSE}</p><div>Eight of them stand out here.</div>",
        [0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0],
    ),
    (
        f"<p>{_PROSE}</p><div>Before it all.</div><main><p>Only.</p><ul><li><a>Link</a></li><li><a>And link</a></li></ul>"
        f"<p>{_PROSE}</p><p>End.</p></main><p>{_PROSE} {_PROSE}</p><p>{_PROSE}</p><div>Last.</div>",
        [0, 0, 1, 1, 1, 1, 1, 0, 0, 0],
    ),
    (
        f"<article><p>{_PROSE} {_PROSE}</p><p>{_PROSE}</p><p>And so.</p></article><p>{_PROSE}</p><h2>More</h2><p>Words.</p>",
        [1, 1, 1, 0, 0, 0],
    ),
    (
        f"<article><aside>Note that.</aside><header><h1>Under a note</h1></header><p>{_PROSE}</p></article>"
        f"<article><nav>Parts</nav><header><h2>Under a menu</h2></header><p>{_PROSE}</p><footer>By them</footer></article>",
        [0, 1, 1, 0, 1, 1, 0],
    ),
]


def labelled_rows() -> tuple[np.ndarray, np.ndarray]:
    tables = [describe(blocks_of(page)) for page, _ in LABELLED]
    return np.vstack(tables), np.array([label for _, labels in LABELLED for label in labels], dtype=float)


def main_text(page: str | None, tree: Node) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    keep = predict(tree, describe(blocks)) > 0.5
    texts = (plain(b.parts) for b, k in zip(blocks, keep, strict=True) if k)
    return "\n".join(t for t in texts if t)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """The other columns of ``pages`` and ``text``, ``n_chars`` (code points)."""
    tree = grow(*labelled_rows())
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]

    def run(batches):
        for part in text_slices(batches, column):
            texts = [main_text(page, tree) for page in part.column(column).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in kept] + [pa.array(texts, pa.string()), sizes],
                [*kept, "text", "n_chars"],
            )

    fields = [pages.schema[c] for c in kept] + T.StructType.fromDDL("text string, n_chars long").fields
    return pages.select(*[f"`{c}`" for c in [*kept, column]]).mapInArrow(run, T.StructType(fields))
