"""Main text of web pages by a linear-chain conditional random field.

A page becomes its leaf blocks in page order: runs of text between block-level
tags, with the tags, classes and ids of their ancestors. The field labels each
block as main text or not from features of ancestors and text and from the label
before; it is trained on labelled pages and decoded by Viterbi. The labelled pages
are made by rule, in many layouts, so that every block's label is known.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# HTML's element classes.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Scripts and what stands in for them, styles, the fields of forms, and what a browser shows as another page or not at all.
SILENT_TAGS = frozenset("script style noscript template textarea select option iframe noframes head".split())
#: What may stand in a head; any other opening tag, and text, ends it.
HEAD_TAGS = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
#: An opening tag of these ends an open paragraph, and one of the same kind an open item.
ENDS_PARAGRAPH = BLOCK_TAGS - {"button", "option", "title", "body", "html"}
SELF_CLOSING = frozenset("li dt dd tr td th option".split())
#: An end tag of a paragraph or item doesn't reach out of these.
BARRIERS = frozenset("article body div main section td aside footer nav form".split())

SPACE = re.compile(r"\s+")
_MARKED = re.compile(r"<!\[(?:cdata|temp|ignore|include|rcdata)\s*\[", re.I)


class Block:
    """A run of text, its characters in links, and the features of its ancestors."""

    __slots__ = ("link_chars", "place", "text")

    def __init__(self, text: str, link_chars: int, place: tuple[str, ...]):
        self.text, self.link_chars, self.place = text, link_chars, place


class _Blocks(HTMLParser):
    """Open elements are a stack; where each tag, block and barrier stands in it is kept, so no step walks the stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        #: Features of each open element's ancestors and itself; elements that add none share their parent's.
        self.places: list[tuple[str, frozenset[str]]] = [("", frozenset())]
        self.at: dict[str, list[int]] = {}
        self.block_at, self.barrier_at = [-1], [-1]
        self.parts: list[str] = []
        self.linked = self.silent = 0
        self.blocks: list[Block] = []

    def flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append(Block(text, self.linked, _place(*self.places[-1])))
            self.parts, self.linked = [], 0

    def parse_marked_section(self, i, report=1):
        """Sections run to their ``]]>``; any other ``<![`` is a comment up to ``>``."""
        end = super().parse_marked_section(i, report) if _MARKED.match(self.rawdata, i) else -1
        return end if end >= 0 else self.parse_bogus_comment(i, report)

    def _push(self, tag: str, named: str) -> None:
        here = len(self.open)
        leaf, found = self.places[-1]
        if tag in BLOCK_TAGS or named:
            more = _own_features(tag, named) - found
            leaf, found = tag if tag in BLOCK_TAGS else leaf, found | more if more else found
        self.open.append(tag)
        self.places.append((leaf, found))
        self.at.setdefault(tag, []).append(here)
        if tag in BLOCK_TAGS:
            self.block_at.append(here)
        if tag in BARRIERS:
            self.barrier_at.append(here)
        self.silent += tag in SILENT_TAGS

    def _pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag = self.open.pop()
            self.places.pop()
            self.at[tag].pop()
            if tag in BLOCK_TAGS:
                self.block_at.pop()
            if tag in BARRIERS:
                self.barrier_at.pop()
            self.silent -= tag in SILENT_TAGS

    def _end_head(self) -> None:
        """A head that was never closed ends here, and what is open inside it."""
        if self.at.get("head"):
            self._pop_to(self.at["head"][0])

    def handle_starttag(self, tag, attrs):
        # In a script, noscript or template of the head the head goes on.
        if self.silent and (tag in ("body", "article", "main") or self.silent == 1 and tag not in HEAD_TAGS):
            self._end_head()
        if tag == "head" and self.at.get("head"):
            return
        if tag in VOID_TAGS:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.flush()
            if tag in ENDS_PARAGRAPH and self.at.get("p"):
                self._close("p")
            if tag in SELF_CLOSING and self.open and self.open[-1] == tag:
                self._close(tag)
        self._push(tag, " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower())

    def handle_endtag(self, tag):
        if tag in VOID_TAGS:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.flush()
        if tag == "head":
            self._end_head()
        else:
            self._close(tag)

    def _close(self, tag: str) -> None:
        """Close the innermost open element of this name, and what is open inside it."""
        where = self.at.get(tag)
        # An inline end tag doesn't reach out of its block, one of a paragraph or item not out of its part of the page.
        if not where or tag not in BLOCK_TAGS and self.block_at[-1] > where[-1] or tag in ("p", "li") and self.barrier_at[-1] > where[-1]:
            return
        self._pop_to(where[-1])

    def handle_data(self, data):
        if self.silent == 1 and self.open[-1] == "head" and data.strip():
            self._end_head()
        if not self.silent:
            self.parts.append(data)
            if self.at.get("a"):
                self.linked += len(data)


def leaf_blocks(html: str) -> list[Block]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


# Parts of class names and ids that tell what a page's part is for.
CUES = (
    "ad ads advert sponsor promo banner nav menu breadcrumb header masthead footer copyright side sidebar aside widget related recommend "
    "cookie consent notice alert popup modal newsletter subscribe signup login form search share social comment comments reply respond "
    "disqus discussion pagination pager tag tags meta byline article content post entry story body main text title headline"
).split()
_CUE = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?…»\"”)]$")


@lru_cache(10_000)
def _own_features(tag: str, named: str) -> frozenset[str]:
    """What an element says of the text inside it; there are a bounded number of such features."""
    found = {f"in={tag}"} if tag in BLOCK_TAGS and tag not in ("html", "body") else set()
    for word in _CUE.findall(named):
        for cue in (word, word.rstrip("s")):
            if cue in CUES:
                found.add(f"name={cue}")
    return frozenset(found)


@lru_cache(10_000)
def _place(leaf: str, found: frozenset[str]) -> tuple[str, ...]:
    return tuple(sorted([f"leaf={leaf}", *found]))


def block_features(block: Block) -> tuple[str, ...]:
    text = block.text
    words = text.count(" ") + 1
    share = block.link_chars / max(1, len(text))
    return (
        *block.place,
        f"words={min(7, words.bit_length())}",
        f"links={min(4, int(share * 4))}",
        "ends" if _SENTENCE.search(text) else "open",
        *(("copyright",) if "©" in text[:40] else ()),
    )


def _sentence(rng: random.Random, words: int) -> str:
    made = " ".join("".join(rng.choice("aeiounrstlmdkp") for _ in range(rng.randint(1, 9))) for _ in range(words))
    return made.capitalize() + rng.choice(["."] * 5 + ["", "!"])


def labelled_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page and, for each of its leaf blocks, whether it is main text."""
    html: list[str] = []
    labels: list[bool] = []
    say = lambda n: _sentence(rng, n)

    def block(tag: str, text: str, main: bool) -> None:
        html.append(f"<{tag}>{text}</{tag}>" if rng.random() < 0.9 or tag != "p" else f"<p>{text}")
        labels.append(main)

    def links(n: int) -> None:
        html.append("<ul>")
        for _ in range(n):
            html.append(f'<li><a href="#">{say(rng.randint(1, 4)).rstrip(".!")}</a></li>')
            labels.append(False)
        html.append("</ul>")

    def box(opening: str, closing: str, inside) -> None:
        html.append(opening)
        inside()
        html.append(closing)

    def prose(main: bool, n: int) -> None:
        for _ in range(n):
            block("p", " ".join(say(rng.randint(1, 18)) for _ in range(rng.randint(1, 6))), main)

    def plain(text: str) -> None:
        html.append(text)
        labels.append(False)

    def form() -> None:
        plain(f"<label>{say(2)}</label> <input name=q> ")
        html.append("<button>")
        plain(say(1))
        html.append("</button>")

    def comments() -> None:
        block(rng.choice(["h2", "h3"]), say(1), False)
        for _ in range(rng.randint(1, 4)):
            name = rng.choice(["comment", "comment-body", "reply"])
            box(f'<div class="{name}">', "</div>", lambda: prose(False, rng.randint(1, 2)))

    def other() -> None:
        kind = rng.choice(["nav", "ad", "aside", "notice", "form", "share", "header", "footer", "comments", "related", "news"])
        cls = lambda *names: f'{rng.choice(["class", "id"])}="{rng.choice(names)}"'
        if kind == "nav":
            tag = rng.choice(["nav", f"div {cls('nav', 'menu', 'main-menu', 'breadcrumb')}", "nav"])
            box(f"<{tag}>", f"</{tag.split()[0]}>", lambda: links(rng.randint(2, 7)))
        elif kind == "ad":
            tag = rng.choice(["div", "aside", "section"])
            name = cls("ad", "ads", "advert", "sponsored", "promo", "ad-box", "banner ad")
            if rng.random() < 0.6:
                box(f"<{tag} {name}>", f"</{tag}>", lambda: plain(" ".join(say(rng.randint(2, 12)) for _ in range(rng.randint(1, 4)))))
            else:
                box(f"<{tag} {name}>", f"</{tag}>", lambda: prose(False, rng.randint(1, 2)))
        elif kind in ("aside", "related"):
            tag = rng.choice(["aside", f"div {cls('sidebar', 'side', 'widget', 'related', 'related-posts')}", "aside"])
            box(f"<{tag}>", f"</{tag.split()[0]}>", lambda: (block(rng.choice(["h3", "h4"]), say(2), False), prose(False, rng.randint(0, 3)), links(rng.randint(0, 5))))
        elif kind in ("notice", "news"):
            name = cls("cookie", "cookie-notice", "notice", "consent", "alert", "popup", "newsletter", "subscribe")
            box(f"<div {name}>", "</div>", lambda: prose(False, 1) if rng.random() < 0.5 else plain(say(rng.randint(4, 20))))
        elif kind == "form":
            box(rng.choice(["<form>", '<form class="search">', '<form id="login">']), "</form>", form)
        elif kind == "share":
            box(f"<div {cls('share', 'social', 'tags', 'pagination')}>", "</div>", lambda: links(rng.randint(1, 4)))
        elif kind == "header":
            tag = rng.choice(["header", f"div {cls('header', 'masthead', 'site-header')}", "header"])
            box(f"<{tag}>", f"</{tag.split()[0]}>", lambda: block(rng.choice(["h1", "h2", "p", "div"]), say(rng.randint(1, 6)), False))
        elif kind == "footer":
            tag = rng.choice(["footer", f"div {cls('footer', 'site-footer', 'copyright')}", "footer"])
            box(f"<{tag}>", f"</{tag.split()[0]}>", lambda: plain(f"{rng.choice(['&copy; ', ''])}{say(rng.randint(2, 10))}") if rng.random() < 0.7 else prose(False, rng.randint(1, 2)))
        else:
            tag = rng.choice(["div", "section"])
            box(f"<{tag} {cls('comments', 'comment-list', 'discussion', 'disqus')}>", f"</{tag}>", comments)

    def article() -> None:
        if rng.random() < 0.85:
            block("h1", say(rng.randint(2, 9)), True)
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.7:
                prose(True, 1)
            elif r < 0.78:
                block(rng.choice(["h2", "h3"]), say(rng.randint(1, 6)), True)
            elif r < 0.83:
                html.append("<ul>")
                for _ in range(rng.randint(2, 4)):
                    block("li", say(rng.randint(2, 12)), True)
                html.append("</ul>")
            elif r < 0.87:
                block(rng.choice(["blockquote", "pre", "figcaption"]), say(rng.randint(3, 20)), True)
            elif r < 0.9:
                block("p", f'{say(6)} <a href="#">{say(3)}</a> {say(5)}', True)
            else:
                other()

    tag = rng.choice(
        ["article"] * 6
        + ["main", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"', 'section class="story"', 'div class="main-text"', "div"]
    )
    html.append(f"<!DOCTYPE html><html><head><title>{say(3)}</title><script>var t='</p>';</script></head><body>")
    for _ in range(rng.randint(0, 4)):
        other()
    box(f"<{tag}>", f"</{tag.split()[0]}>", article)
    for _ in range(rng.randint(0, 4)):
        other()
    html.append("</body></html>" if rng.random() < 0.9 else "")
    return "".join(html), labels


class Field:
    """Two labels: 1 is main text. Scores are sums of feature weights and of the step between labels."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.index, self.weights, self.steps = index, weights, steps

    def emit(self, features: list[tuple[str, ...]]) -> np.ndarray:
        get = self.index.get
        return np.array([self.weights[[k for f in row if (k := get(f)) is not None]].sum(0) for row in features]).reshape(-1, 2)

    def decode(self, features: list[tuple[str, ...]]) -> list[bool]:
        """Viterbi; of equal paths the one with less main text."""
        emit = self.emit(features).tolist()
        if not emit:
            return []
        (s0, s1), (from0, from1), (to0, to1) = self.steps.tolist()
        a, b = emit[0][0] + s0, emit[0][1] + s1
        back = []
        for e0, e1 in emit[1:]:
            a_from, b_from = b + to0 > a + from0, b + to1 > a + from1
            back.append((a_from, b_from))
            a, b = max(a + from0, b + to0) + e0, max(a + from1, b + to1) + e1
        now = b > a
        path = [now]
        for a_from, b_from in reversed(back):
            now = b_from if now else a_from
            path.append(now)
        return path[::-1]


def _marginals(emit: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label) of each block and summed P(label, next label), by forward and backward sums."""
    n = len(emit)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = emit[0] + steps[0]
    for t in range(1, n):
        ahead[t] = emit[t] + np.logaddexp(ahead[t - 1][0] + steps[1], ahead[t - 1][1] + steps[2])
    for t in range(n - 2, -1, -1):
        after = emit[t + 1] + behind[t + 1]
        behind[t] = np.logaddexp(steps[1:, 0] + after[0], steps[1:, 1] + after[1])
    total = np.logaddexp(*ahead[-1])
    single = np.exp(ahead + behind - total)
    pairs = np.zeros((2, 2))
    for t in range(n - 1):
        pairs += np.exp(ahead[t][:, None] + steps[1:] + (emit[t + 1] + behind[t + 1])[None, :] - total)
    return single, pairs


def train_field(pages: list[tuple[list[tuple[str, ...]], list[bool]]], epochs: int = 4, rate: float = 0.2, decay: float = 1e-4, seed: int = 3) -> Field:
    """Maximum likelihood by AdaGrad over the labelled pages, one page a step."""
    index: dict[str, int] = {}
    for features, _ in pages:
        for row in features:
            for f in row:
                index.setdefault(f, len(index))
    w, steps = np.zeros((len(index), 2)), np.zeros((3, 2))
    gw, gs = np.full_like(w, 1e-2), np.full_like(steps, 1e-2)
    rng = random.Random(seed)
    order = [p for p in pages if p[0]]
    for _ in range(epochs):
        rng.shuffle(order)
        for features, labels in order:
            y = np.array(labels, int)
            rows = [[index[f] for f in row] for row in features]
            emit = np.array([w[r].sum(0) for r in rows])
            single, pairs = _marginals(emit, steps)
            error = np.eye(2)[y] - single
            d = np.zeros_like(steps)
            d[0] = error[0]
            np.add.at(d[1:], (y[:-1], y[1:]), 1)
            d[1:] -= pairs
            gs += d * d
            steps += rate * d / np.sqrt(gs)
            flat = np.array([k for r in rows for k in r])
            step = np.zeros_like(w)
            np.add.at(step, flat, np.repeat(error, [len(r) for r in rows], axis=0))
            used = np.unique(flat)
            g = step[used] - decay * w[used]
            gw[used] += g * g
            w[used] += rate * g / np.sqrt(gw[used])
    return Field(index, w, steps)


def labelled_pages(n: int, seed: int) -> list[tuple[list[tuple[str, ...]], list[bool]]]:
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        html, labels = labelled_page(rng)
        blocks = leaf_blocks(html)
        if len(blocks) != len(labels):
            raise AssertionError("a labelled page's blocks and labels differ")
        made.append(([block_features(b) for b in blocks], labels))
    return made


@lru_cache(1)
def default_field() -> Field:
    return train_field(labelled_pages(1000, 1))


def main_text(html: str, field: Field) -> str:
    blocks = leaf_blocks(html)
    keep = field.decode([block_features(b) for b in blocks])
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text (empty if there is none) and n_chars, its code points.

    Null and empty html has no text. Tags that are never closed, stray end tags and cut-off pages
    are read as far as they go, an unclosed head to the first tag or text that can't stand in one.
    Only scripts and their stand-ins, styles, form fields, frames and templates are silent wherever they stand.
    Time and memory go with a page's length, however deep it nests. Repeated rows have equal results, null
    ids stay, other columns are ignored, an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            texts = [main_text(h, shared.value) for h in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
