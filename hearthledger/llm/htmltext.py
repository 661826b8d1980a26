"""HTML extraction (operator 10): a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks: runs of text between the borders of block elements. Each block is
described by its own tag, its ancestors, words in class, id and role of the ancestors, link share, length
and punctuation; the chain's two states are main text and the rest. Weights are learnt by gradient ascent
on the conditional log-likelihood (forward-backward) over labelled pages and decoded by Viterbi.

No labelled pages come with the tables, so the training pages are generated here: ``labelled_pages`` writes
pages of varied templates (menus, banners, sidebars, adverts, consent notices, forms, reader comments,
footers around headings, paragraphs, lists, quotations, tables) whose blocks carry labels. They are a
fixed number from a seed, independent of the data.

Text inside a block: character references are decoded, white space runs become one space, ends are trimmed;
scripts, styles, comments, the head and form controls hold no text. Blocks of the main text are joined by
one newline, none is cut or left out.

Defined cases: a null or empty page has an empty text; broken markup is read as far as it goes, unclosed
elements end where a block of the same level begins; repeated rows are extracted each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BITS = 14
PAGES = 240
EPOCHS = 6
#: Elements that end a block. Fixed by HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without text of the page; for the first two the parser itself reads raw text.
SILENT = frozenset("script style head title template select textarea button svg canvas iframe object noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new element of the same kind closes.
_SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
_NAME_PART = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "own", "tags", "names", "linked")

    def __init__(self, own: str, tags: tuple[str, ...], names: tuple[str, ...]):
        self.text: list[str] = []
        self.own, self.tags, self.names, self.linked = own, tags, names, 0


class Leaves(HTMLParser):
    """Leaf blocks of a page in order. Nesting has no bound: what a block needs of its ancestors is kept in counts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.inside: list[str] = []  # the block elements of the stack
        self.tags, self.names = Counter(), Counter()  # of open elements
        self.known: tuple[tuple[str, ...], tuple[str, ...]] | None = None
        self.silent = 0
        self.blocks: list[tuple[str, Block]] = []
        self.open: Block | None = None

    def _close(self) -> None:
        if self.open is not None:
            text = " ".join("".join(self.open.text).split())
            if text:
                self.blocks.append((text, self.open))
            self.open = None

    def _push(self, tag: str, names: tuple[str, ...]) -> None:
        self.stack.append((tag, names))
        self.tags[tag] += 1
        self.names.update(names)
        self.silent += tag in SILENT
        if tag in BLOCK:
            self.inside.append(tag)
        self.known = None

    def _pop_through(self, tag: str) -> None:
        """Closes the innermost open ``tag`` and all that is inside it."""
        found = not self.tags[tag]
        while not found:
            last, names = self.stack.pop()
            found = last == tag
            self.tags[last] -= 1
            self.names.subtract(names)
            self.silent -= last in SILENT
            if last in BLOCK:
                self.inside.pop()
            self.known = None

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._close()
        elif tag == "br" and self.open is not None:
            self.open.text.append(" ")
        if tag in VOID:
            return
        if tag == "body":  # whatever was left open before belongs to the head
            self._pop_through("head")
        if tag in _SELF_CLOSING and self.inside and self.inside[-1] == tag:
            self._pop_through(tag)
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "aria-label", "itemprop"))
        self._push(tag, tuple(_NAME_PART.findall(named.lower())))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._close()
        self._pop_through(tag)

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # no known keyword: a bogus comment up to the next '>', as browsers read it
            end = self.parse_bogus_comment(i, report)
            return len(self.rawdata) if end < 0 else end

    def handle_data(self, data):
        if self.silent:
            return
        if self.open is None:
            if data.isspace():
                return
            if self.known is None:
                self.known = tuple(sorted(t for t, n in self.tags.items() if n and t in BLOCK)), tuple(sorted(x for x, n in self.names.items() if n))
            self.open = Block(self.inside[-1] if self.inside else "none", *self.known)
        self.open.text.append(data)
        if self.tags["a"]:
            self.open.linked += len(data)


def leaves(html: str) -> list[tuple[str, Block]]:
    p = Leaves()
    p.feed(html)
    p.close()
    p._close()
    return p.blocks


def described(text: str, b: Block) -> list[str]:
    """Features of a block: ancestors, names, shape."""
    words = text.count(" ") + 1
    share = 4 * b.linked // max(1, len(text))
    return [
        "bias", f"own={b.own}", *(f"in={t}" for t in b.tags), *(f"name={n}" for n in b.names),
        f"link={min(4, share)}", f"words={min(6, words.bit_length())}", f"stop={text[-1] in '.!?:;,'}", f"own={b.own} link={min(4, share)}",
        f"rights={'©' in text or 'copyright' in text.lower()}",
    ]


def _cells(features: list[str]) -> np.ndarray:
    import zlib

    return np.fromiter((zlib.crc32(f.encode()) & ((1 << BITS) - 1) for f in features), np.int64, len(features))


class Crf:
    """Two states: 0 the rest, 1 main text."""

    def __init__(self):
        self.w, self.t, self.s = np.zeros((1 << BITS, 2)), np.zeros((2, 2)), np.zeros(2)

    def emissions(self, chain: list[np.ndarray]) -> np.ndarray:
        return np.asarray([self.w[c].sum(axis=0) for c in chain])

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node and summed edge marginals by forward-backward in log space."""
        n = len(e)
        f, b = np.empty((n, 2)), np.zeros((n, 2))
        f[0] = self.s + e[0]
        for i in range(1, n):
            f[i] = e[i] + np.logaddexp.reduce(f[i - 1][:, None] + self.t, axis=0)
        for i in range(n - 2, -1, -1):
            b[i] = np.logaddexp.reduce(self.t + (e[i + 1] + b[i + 1])[None, :], axis=1)
        z = np.logaddexp.reduce(f[-1])
        node = np.exp(f + b - z)
        edge = np.exp(f[:-1, :, None] + self.t[None] + (e[1:] + b[1:])[:, None, :] - z).sum(axis=0) if n > 1 else np.zeros((2, 2))
        return node, edge

    def fit(self, chains: list[tuple[list[np.ndarray], list[int]]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-4) -> Crf:
        """AdaGrad ascent on the conditional log-likelihood, chain by chain."""
        gw, gt, gs = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6), np.full_like(self.s, 1e-6)
        for _ in range(epochs):
            for chain, labels in chains:
                node, edge = self.marginals(self.emissions(chain))
                y = np.asarray(labels)
                gap = np.eye(2)[y] - node
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                at = np.concatenate(chain)
                g = np.repeat(gap, [len(c) for c in chain], axis=0)
                cells, where = np.unique(at, return_inverse=True)
                total = np.zeros((len(cells), 2))
                np.add.at(total, where, g)
                total -= decay * self.w[cells]
                gw[cells] += total**2
                self.w[cells] += rate * total / np.sqrt(gw[cells])
                d = seen - edge - decay * self.t
                gt += d**2
                self.t += rate * d / np.sqrt(gt)
                gs += gap[0] ** 2
                self.s += rate * gap[0] / np.sqrt(gs)
        return self

    def viterbi(self, e: np.ndarray) -> list[int]:
        n = len(e)
        score, back = self.s + e[0], np.zeros((n, 2), np.int64)
        for i in range(1, n):
            every = score[:, None] + self.t
            back[i] = every.argmax(axis=0)
            score = e[i] + every.max(axis=0)
        out = [int(score.argmax())]
        for i in range(n - 1, 0, -1):
            out.append(int(back[i, out[-1]]))
        return out[::-1]


class Writer:
    """Generated pages whose text carries its label: words of the main text hold the mark ``\\u0001``."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        self.main = False

    def words(self, low: int, high: int) -> str:
        parts = ["la", "mo", "ti", "re", "san", "dor", "vel", "ku", "bra", "nin", "es", "to"]
        said = ["".join(self.r.choice(parts, self.r.integers(1, 4))) for _ in range(self.r.integers(low, high + 1))]
        return ("\x01" if self.main else "") + " ".join(said).capitalize()

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 14) + self.r.choice([".", ".", ".", "!", "?"]) for _ in range(self.r.integers(low, high + 1)))

    def pick(self, *options):
        return options[self.r.integers(len(options))]

    def links(self, n: int, low: int = 1, high: int = 3) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(low, high)}</a></li>' for i in range(n)) + "</ul>"

    def boilerplate(self, kind: str) -> str:
        n = int(self.r.integers(2, 9))
        own = self.sentences(1, 3)
        return {
            "nav": lambda: self.pick("<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="navigation" role="navigation">{}</div>', '<ul class="breadcrumb">{}</ul>').format(self.links(n)),
            "header": lambda: self.pick("<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>').format(f"<h2>{self.words(1, 4)}</h2><p>{self.words(2, 8)}</p>" + self.pick("", self.links(3))),
            "footer": lambda: self.pick("<footer>{}</footer>", '<div class="footer">{}</div>', '<footer id="footer"><p>{}</p></footer>').format(self.pick("&copy; ", "© ", "") + self.pick(self.words(1, 3) + " &middot; " + own, self.words(2, 5), own + self.links(3))),
            "aside": lambda: self.pick("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar-right"><section>{}</section></div>', '<div class="related">{}</div>').format(self.pick(self.links(n, 3, 9), f"<h3>{self.words(1, 4)}</h3><p>{own}</p>", f"<p>{own}</p>" + self.links(n))),
            "ad": lambda: self.pick('<div class="ad">{}</div>', '<div class="advert banner"><p>{}</p></div>', '<div id="ads-top"><a href="/b">{}</a></div>', '<div class="sponsored promo">{}</div>').format(own),
            "notice": lambda: self.pick('<div class="cookie-notice">{}</div>', '<div id="consent" role="dialog"><p>{}</p></div>', '<div class="newsletter popup"><p>{}</p></div>', '<div class="alert notice">{}</div>').format(own),
            "form": lambda: f"<form><label>{self.words(1, 3)}</label><input name=q><p>{self.words(2, 8)}</p><button>{self.words(1, 2)}</button></form>",
            "comments": lambda: self.pick('<section class="comments">{}</section>', '<div id="comments">{}</div>').format("".join(f'<div class="comment"><p>{self.sentences(1, 4)}</p></div>' for _ in range(n))),
            "share": lambda: self.pick('<div class="share social">{}</div>', '<div class="tags">{}</div>').format(self.links(3)),
        }[kind]()

    def article(self) -> str:
        out = []
        self.main = True
        out.append(f"<{self.pick('h1', 'h1', 'h2')}>{self.words(2, 12)}</h1>")
        for _ in range(self.r.integers(1, 14)):
            kind = self.r.choice(["p", "p", "p", "p", "short", "b", "h", "ul", "quote", "table", "linked", "pre"])
            out.append(
                {
                    "p": lambda: f"<p>{self.sentences(1, 7)}</p>",
                    "short": lambda: f"<p>{self.words(1, 4)}.</p>",
                    "b": lambda: f"<p><b>{self.sentences(1, 3)}<br>",
                    "h": lambda: f"<h{self.r.integers(2, 5)}>{self.words(1, 7)}</h2>",
                    "ul": lambda: "<ul>" + "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(self.r.integers(2, 5))) + "</ul>",
                    "quote": lambda: f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>",
                    "table": lambda: "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(2)) + "</table>",
                    "linked": lambda: f'<p>{self.sentences(1, 3)} <a href="/x">{self.words(1, 3)}</a> {self.words(2, 6)}.</p>',
                    "pre": lambda: f"<pre>{self.words(3, 9)}</pre>",
                }[str(kind)]()
            )
            if self.r.random() < 0.06:
                self.main = False
                out.append(self.boilerplate(self.pick("ad", "share", "aside")))
                self.main = True
        self.main = False
        inner = "".join(out)
        return self.pick("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<div class="content"><article>{}</article></div>', '<div id="content" role="main">{}</div>', '<div class="post entry">{}</div>', "<div>{}</div>").format(inner)

    def page(self) -> str:
        before = [k for k in ("notice", "header", "nav", "ad", "form", "aside") if self.r.random() < 0.5]
        after = [k for k in ("share", "comments", "form", "aside", "ad", "nav", "footer") if self.r.random() < 0.5]
        self.r.shuffle(before)
        body = "".join(map(self.boilerplate, before)) + self.article() + "".join(map(self.boilerplate, after))
        return f"<html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labelled_pages(n: int = PAGES, seed: int = 5) -> list[tuple[list[np.ndarray], list[int]]]:
    """Chains of feature cells with their labels, from n generated pages."""
    writer, out = Writer(seed), []
    for _ in range(n):
        found = leaves(writer.page())
        out.append(([_cells(described(t.replace("\x01", ""), b)) for t, b in found], [int("\x01" in t) for t, _ in found]))
    return out


def train(n: int = PAGES, seed: int = 5) -> Crf:
    return Crf().fit(labelled_pages(n, seed))


def main_text(html: str | None, crf: Crf, cache: dict | None = None) -> str:
    found = leaves(html or "")
    if not found:
        return ""
    cache = {} if cache is None else cache
    scores = []
    for text, b in found:
        key = tuple(described(text, b))
        if key not in cache:
            if len(cache) > 50_000:
                cache.clear()
            cache[key] = crf.w[_cells(list(key))].sum(axis=0)
        scores.append(cache[key])
    return "\n".join(t for (t, _), y in zip(found, crf.viterbi(np.asarray(scores)), strict=True) if y)


def extract(pages: DataFrame, crf: Crf) -> DataFrame:
    """page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf, cache = shared.value, {}
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [main_text(h, crf, cache) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), train())
