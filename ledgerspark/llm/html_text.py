"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A tolerant scanner turns a page into leaf blocks, each with the tags and the
class and id words of its open ancestors and with figures of its text. A CRF
with two labels, trained on labelled pages and decoded by Viterbi, says which
blocks belong to the article; their text, in page order, is the result.

There are no labelled pages in the tables, so ``labelled_pages`` writes some:
pages of random layout whose parts are known. Other labelled pages can be given
to ``train``.

Defined cases: null, empty or blank html gives an empty text of 0 characters;
unclosed and stray tags are closed at the next block, as browsers do, and cost
time in proportion to the page; a comment or declaration that is not closed runs
to the page's end; equal rows give equal texts; scripts, styles, templates and
comments never become blocks; white space is what str.split() takes for it,
no-break spaces too; an empty table gives an empty result; only the columns to
keep and the html are read, whatever other columns there are.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, table

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "template", "noscript", "svg", "iframe", "head", "title", "textarea", "select")}
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY_BLOCK = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6"))
_ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
#: Parts of class, id and role names, by what they tell.
NAMES = {
    "ad": re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner)(?:$|[\s_-])", re.I),
    "menu": re.compile(r"nav|menu|breadcrumb|toolbar|pagination|pager", re.I),
    "edge": re.compile(r"foot|header|masthead|copyright|legal", re.I),
    "side": re.compile(r"side|aside|widget|related|recommend|popular|tag-?cloud|complementary", re.I),
    "notice": re.compile(r"cookie|consent|notice|alert|modal|popup|gdpr|subscribe|newsletter|login|signup", re.I),
    "comment": re.compile(r"comment|discuss|disqus|reply|replies|respond", re.I),
    "share": re.compile(r"share|social|follow|meta|byline", re.I),
    "body": re.compile(r"article|content|post|entry|story|main|body|text", re.I),
}
TAGS = tuple("nav header footer aside form article main section ul ol li table td p h1 h2 h3 h4 blockquote pre div figure figcaption button dl body".split())
_NOTICE = re.compile(r"cookie|subscribe|newsletter|sign up|log in|accept all|privacy|advertisement|sponsored", re.I)
_RIGHTS = re.compile(r"©|\(c\)|all rights reserved|copyright", re.I)
FEATURES = (
    ["bias"] + [f"in:{t}" for t in TAGS] + [f"at:{t}" for t in TAGS] + [f"name:{n}" for n in NAMES] + [f"own:{n}" for n in NAMES]
    + [f"words:{k}" for k in range(5)] + [f"links:{k}" for k in range(3)] + ["ends", "rights", "notice", "first", "last", "after-h1", "article-name", "article-comment", "list-links"]
)
_AT = {f: k for k, f in enumerate(FEATURES)}


def _names(attrs: str) -> tuple[str, ...]:
    if "=" not in attrs:
        return ()
    text = " ".join(a or b or c for a, b, c in _ATTRS.findall(attrs))
    return tuple(n for n, r in NAMES.items() if r.search(text)) if text else ()


class _Page:
    """Open elements and the blocks found so far."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.open: dict[str, int] = {}
        self.blocks: list[tuple[str, frozenset[int]]] = []
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.h1 = False

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.stack.append((tag, names))
        for key in (tag, *names_keys(names)):
            self.open[key] = self.open.get(key, 0) + 1

    def pop(self) -> None:
        tag, names = self.stack.pop()
        for key in (tag, *names_keys(names)):
            self.open[key] -= 1

    def close(self, tag: str) -> None:
        if self.open.get(tag, 0):
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def flush(self) -> None:
        text = " ".join(entities.unescape("".join(self.parts)).split()) if self.parts else ""
        linked, self.parts, self.linked = self.linked, [], 0
        if not text:
            return
        f = {0}
        f.update(_AT[f"in:{t}"] for t in TAGS if self.open.get(t))
        f.update(_AT[f"name:{n}"] for n in NAMES if self.open.get("." + n))
        tag, names = self.stack[-1] if self.stack else ("body", ())
        if tag in TAGS:
            f.add(_AT[f"at:{tag}"])
        f.update(_AT[f"own:{n}"] for n in names)
        n = text.count(" ") + 1
        f.add(_AT[f"words:{0 if n < 3 else 1 if n < 8 else 2 if n < 20 else 3 if n < 60 else 4}"])
        dense = 2 * linked >= len(text)
        f.add(_AT[f"links:{2 if dense else 1 if linked else 0}"])
        if text[-1] in ".!?…:;\"”»)":
            f.add(_AT["ends"])
        if _RIGHTS.search(text[:200]):
            f.add(_AT["rights"])
        if n < 40 and _NOTICE.search(text):
            f.add(_AT["notice"])
        if self.h1:
            f.add(_AT["after-h1"])
        if self.open.get("h1"):
            self.h1 = True
        if self.open.get("article") or self.open.get("main") or self.open.get(".body"):
            f.add(_AT["article-comment" if self.open.get(".comment") else "article-name"])
        if dense and self.open.get("li"):
            f.add(_AT["list-links"])
        self.blocks.append((text, frozenset(f)))


def names_keys(names: tuple[str, ...]) -> list[str]:
    return ["." + n for n in names]


def blocks_of(html: str | None) -> list[tuple[str, frozenset[int]]]:
    """(text, features) of each leaf block, in page order."""
    page = _Page()
    if not html:
        return []
    at, n = 0, len(html)
    headless = False  # no </head> lies ahead
    while at < n:
        m = _TAG.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            page.parts.append(text)
            if page.links:
                page.linked += len(text)
        if not m:
            break
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                page.links = 0 if m[1] else 1
            elif tag == "img":
                page.parts.append(" ")
            continue
        if tag == "br":
            page.parts.append(" ")
            continue
        page.flush()
        page.links = 0
        if m[1]:
            page.close(tag)
            continue
        if tag in _RAW and not m[3].endswith("/"):
            end = None if headless and tag == "head" else _RAW[tag].search(html, at)
            if end is None and tag == "head":
                headless = True
                continue
            at = end.end() if end else n
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        while page.stack and page.stack[-1][0] in _CLOSED_BY_BLOCK:
            page.pop()
        for other in _ITEMS.get(tag, ()):
            if page.stack and page.stack[-1][0] == other:
                page.pop()
        page.push(tag, _names(m[3]))
    page.flush()
    if page.blocks:
        for k, name in ((0, "first"), (-1, "last")):
            page.blocks[k] = (page.blocks[k][0], page.blocks[k][1] | {_AT[name]})
    return page.blocks


class Crf:
    """Two labels (0 other, 1 article); emissions by features, transitions by label pair."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.emission, self.transition = emission, transition

    def decode(self, features: list[frozenset[int]]) -> list[int]:
        """Viterbi; ties go to label 0."""
        if not features:
            return []
        (t00, t01), (t10, t11) = self.transition.tolist()
        scores = [self.emission[list(f)].sum(0).tolist() for f in features]
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            p0, p1 = a + t00 < b + t10, a + t01 < b + t11
            back.append((p0, p1))
            a, b = max(a + t00, b + t10) + x, max(a + t01, b + t11) + y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[frozenset[int]], list[int]]], rounds: int = 150, ridge: float = 1e-3) -> Crf:
    """Maximise the conditional likelihood by Adam, all pages at once, by forward-backward over padded rows."""
    n, longest, size = len(pages), max(len(f) for f, _ in pages), len(FEATURES)
    x = np.zeros((n, longest, size), np.float32)
    y = np.zeros((n, longest), int)
    mask = np.zeros((n, longest), bool)
    for i, (fs, labels) in enumerate(pages):
        for j, f in enumerate(fs):
            x[i, j, list(f)] = 1
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
    gold = np.eye(2)[y] * mask[..., None]
    pairs = mask[:, 1:]
    gold_t = np.einsum("nia,nib->ab", gold[:, :-1] * pairs[..., None], gold[:, 1:])
    gold_e = np.einsum("nif,nia->fa", x, gold)
    theta, m, v = np.zeros(size * 2 + 4), np.zeros(size * 2 + 4), np.zeros(size * 2 + 4)
    for step in range(1, rounds + 1):
        e, t = theta[: size * 2].reshape(size, 2), theta[size * 2 :].reshape(2, 2)
        s = x @ e
        alpha = np.zeros((n, longest, 2))
        alpha[:, 0] = s[:, 0]
        for j in range(1, longest):
            moved = np.logaddexp(alpha[:, j - 1, :1] + t[0], alpha[:, j - 1, 1:] + t[1]) + s[:, j]
            alpha[:, j] = np.where(mask[:, j, None], moved, alpha[:, j - 1])
        beta = np.zeros((n, longest, 2))
        for j in reversed(range(longest - 1)):
            inner = s[:, j + 1] + beta[:, j + 1]
            moved = np.logaddexp(t[:, 0] + inner[:, :1], t[:, 1] + inner[:, 1:])
            beta[:, j] = np.where(mask[:, j + 1, None], moved, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        node = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        edge = np.exp(alpha[:, :-1, :, None] + t + (s + beta)[:, 1:, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        g = np.concatenate([(np.einsum("nif,nia->fa", x, node) - gold_e).ravel(), (edge.sum((0, 1)) - gold_t).ravel()]) / n + ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(theta[: size * 2].reshape(size, 2), theta[size * 2 :].reshape(2, 2))


def labelled_pages(count: int = 300, seed: int = 5) -> Iterator[tuple[str, list[str]]]:
    """Pages of random layout with the blocks of their article."""
    r = random.Random(seed)
    syllables = "an be ci do el fu ga hi jo ka lu me no or pe qui ra sa ti un ve wo".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    sentences = lambda a, b: " ".join(phrase(4, 18) + r.choice([".", ".", ".", "!", "?"]) for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{phrase(1, 3)}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + "</ul>"
    pick = r.choice

    def extra() -> str:
        return pick([
            lambda: f'<div class="{pick(["ad", "ads", "advert", "sponsored", "ad-box", "promo"])}">{pick([phrase(2, 6), sentences(1, 2), link()])}</div>',
            lambda: f'<div class="{pick(["cookie-notice", "notice", "alert", "consent", "newsletter"])}"><p>{pick(["We use cookies on this site.", sentences(1, 2), "Subscribe to our newsletter."])}</p></div>',
            lambda: f'<aside{pick(["", " class=sidebar"])}><h3>{phrase(1, 3)}</h3>{pick([links(), "<p>" + sentences(1, 2) + "</p>"])}</aside>',
            lambda: f'<div class="{pick(["sidebar", "related", "widget", "recommended"])}"><h4>{phrase(1, 3)}</h4>{links()}</div>',
            lambda: f'<form action="/s"><label>{phrase(1, 3)}</label><input name=q><button>{phrase(1, 2)}</button><p>{phrase(3, 8)}</p></form>',
            lambda: f'<div class="{pick(["share", "social"])}">{link()} {link()}</div>',
        ])()

    def comments() -> str:
        one = lambda: pick(["<li>{}</li>", "<p>{}</p>", '<div class="comment"><p>{}</p></div>', '<div class="comment"><b>{}</b></div>']).format(sentences(1, 3))
        head, tail = pick([('<section id="comments">', "</section>"), ('<div class="comments">', "</div>"), ('<ul class="commentlist">', "</ul>"), ('<div class="comment-list">', "</div>")])
        return head + pick(["", f"<h3>{phrase(1, 3)}</h3>"]) + "".join(one() for _ in range(r.randint(1, 5))) + tail

    for _ in range(count):
        article: list[str] = []

        def own(text: str) -> str:
            article.append(text)
            return text

        body = ""
        if r.random() < 0.85:
            body = "<h1>" + own(phrase(2, 10)) + "</h1>"
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.62:
                t = own(sentences(1, 6))
                body += pick([f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<p>{t.replace(' ', ' <i>', 1)}</i></p>"])
            elif kind < 0.72:
                body += pick(["<h2>{}</h2>", "<h3>{}</h3>"]).format(own(phrase(1, 6)))
            elif kind < 0.8:
                body += "<ul>" + "".join(f"<li>{own(phrase(2, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            elif kind < 0.86:
                body += "<blockquote>" + own(sentences(1, 2)) + "</blockquote>"
            elif kind < 0.9:
                body += "<table>" + "".join("<tr>" + "".join(f"<td>{own(phrase(1, 3))}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>"
            elif kind < 0.96:
                body += "<p>" + own(phrase(1, 4)) + "</p>"
            else:
                body += extra()
        if r.random() < 0.15:
            body += comments()
        head, tail = pick([("<article>", "</article>")] * 3 + [("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main-text">', "</div>"), ('<main><article class="post">', "</article></main>"), ("<div>", "</div>"), ('<div class="entry-content">', "</div>")])
        before = pick(["", f"<header><h1>{phrase(1, 3)}</h1>{pick(['', links()])}</header>", f"<header><p>{phrase(2, 5)}</p></header>", f'<div class="masthead">{phrase(1, 4)}</div>'])
        before += pick(["", "<nav>" + links() + "</nav>", "<nav>" + links() + "</nav>", f'<div class="{pick(["menu", "navbar", "breadcrumbs"])}">' + links() + "</div>"])
        before += "".join(extra() for _ in range(r.randint(0, 2)))
        after = pick(["", "", comments()]) + "".join(extra() for _ in range(r.randint(0, 2)))
        after += pick(["", f"<footer>&copy; {word()}.example &middot; {sentences(1, 2)}</footer>", f"<footer>{sentences(1, 3)}</footer>", f"<footer><p>{phrase(2, 6)}</p>{links()}</footer>", f'<div class="footer">Copyright {phrase(1, 3)}</div>'])
        yield f"<!DOCTYPE html><html><head><title>{phrase(2, 5)}</title><style>p{{}}</style></head><body>{before}{head}{body}{tail}{after}</body></html>", article


def labelled_blocks(pages) -> list[tuple[list[frozenset[int]], list[int]]]:
    """Features and labels of pages given with the texts of their article's blocks, in order."""
    out = []
    for html, article in pages:
        found, k, labels = blocks_of(html), 0, []
        for text, _ in found:
            hit = k < len(article) and text == " ".join(article[k].split())
            k += hit
            labels.append(int(hit))
        if found and k == len(article):
            out.append(([f for _, f in found], labels))
    return out


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return train(labelled_blocks(labelled_pages()))


def main_text(html: str | None, model: Crf) -> str:
    found = blocks_of(html)
    return "\n\n".join(text for (text, _), keep in zip(found, model.decode([f for _, f in found])) if keep)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), *, model: Crf | None = None) -> DataFrame:
    """Per row: the columns to keep, text and n_chars (code points)."""
    model = model or default_model()
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[: len(keep)], "text", "n_chars"])

    schema = StructType([*[pages.schema[c] for c in keep], StructField("text", StringType()), StructField("n_chars", LongType())])
    return map_arrow(pages.select(*keep, html_col), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
