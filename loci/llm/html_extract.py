"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with its
ancestor tags, their class and id words, and its own text.  A chain of two labels, content
and boilerplate, runs over the blocks; its weights are trained on labelled pages by
gradient steps on the exact conditional likelihood (forward-backward) and pages are
decoded by Viterbi.

Labelled pages are those whose own markup names the article (article, main, or an
articleBody property).  There, blocks inside it are content, save for what sits in
navigation, asides, forms, adverts, comments and the like.  While training, the
pages are also shown with plain divisions in place of article and paragraph tags, so the
text and the other tags must carry pages without such markup, and with passages of the
article repeated inside boilerplate containers, so a container counts for more than prose.

Scripts, styles, comments and other unseen parts are no text.  Character references are
decoded, white space in a block, line breaks included, becomes one space.  Null, empty or text-free pages give an
empty text.  Without labelled pages, blocks are judged by markup rules alone.  Repeated rows
are treated alike; extra columns do not matter.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 400  # labelled pages the weights are trained on, at most
FIT_CHARS = 200_000  # longest page used in training
FIT_BLOCKS = 400  # blocks of one labelled page used in training, at most
WIDTH = 4096
SEED = 17

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN_TAGS = frozenset("script style template noscript textarea svg math iframe object canvas audio video head title select button datalist".split())
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes xmp".split())
ARTICLE_TAGS = frozenset(("article", "main"))
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer "
    "header masthead comment comments disqus replies reply respond cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup share "
    "sharing social related recommended widget pagination pager login search tags toolbar skip".split()
)
# Closed by the next of their kind, or by the end of their parent.
SELF_CLOSING = {
    "p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside header footer nav form blockquote pre main hr figure address".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")),
    "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",)),
}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_MARKS = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")


class Block:
    """A leaf block: its text, the tags and name words above it, and how much of it is linked."""

    __slots__ = ("text", "tags", "names", "linked", "article")

    def __init__(self, text: str, tags: tuple[str, ...], names: frozenset[str], linked: int, article: bool):
        self.text, self.tags, self.names, self.linked, self.article = text, tags, names, linked, article


def _attributes(text: str) -> tuple[frozenset[str], bool, bool]:
    """Words of class, id and role; whether it is named as an article's body; whether it is hidden."""
    words, body, hidden = set(), False, False
    if text and "=" in text or "hidden" in text.lower():
        for name, a, b, c in _MARKS.findall(text):
            name, value = name.lower(), (a or b or c)
            if name in ("class", "id", "role"):
                words.update(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            elif name == "itemprop":
                body = body or value.lower() == "articlebody"
            elif name == "hidden":
                hidden = True
            elif name == "aria-hidden":
                hidden = hidden or value.lower() == "true"
            else:
                hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return frozenset(words), body, hidden


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order."""
    if not page:
        return []
    out: list[Block] = []
    # Open elements: tag, name words, article, unseen.
    stack: list[tuple[str, frozenset[str], bool, bool]] = []
    pieces: list[str] = []
    linked = links = 0
    top_names: frozenset[str] = frozenset()
    top_article = top_unseen = False

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append(Block(text, tuple(s[0] for s in stack), top_names, linked, top_article))
        linked = 0

    def top() -> None:
        nonlocal top_names, top_article, top_unseen
        _, top_names, top_article, top_unseen = stack[-1] if stack else ("", frozenset(), False, False)

    def pop_to(at: int) -> None:
        nonlocal links
        if any(s[0] in BLOCK_TAGS for s in stack[at:]):
            close()
        links -= sum(s[0] == "a" for s in stack[at:])
        del stack[at:]
        top()

    position, size = 0, len(page)
    while position < size:
        at = page.find("<", position)
        if at < 0:
            at = size
        if at > position and not top_unseen:
            piece = page[position:at]
            pieces.append(piece)
            if links > 0:
                linked += len(piece)
        if at == size:
            break
        found = _TAG.match(page, at)
        if not found:
            if not top_unseen:
                pieces.append("<")
            position = at + 1
            continue
        position = found.end()
        tag = found.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if found.group(1):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
            else:
                if tag in BLOCK_TAGS:
                    close()
            continue
        for i in range(len(stack) - 1, -1, -1):
            held = stack[i][0]
            if held in SELF_CLOSING and tag in SELF_CLOSING[held]:
                pop_to(i)
                break
            if held in ("table", "ul", "ol", "dl", "div", "section", "article", "td", "th", "body"):
                break
        if tag in BLOCK_TAGS:
            close()
        if tag in VOID_TAGS:
            if tag == "br" and not top_unseen:
                pieces.append(" ")
            continue
        names, body, hidden = _attributes(found.group(3) or "")
        unseen = top_unseen or tag in UNSEEN_TAGS or hidden
        stack.append((tag, top_names | names, top_article or body or tag in ARTICLE_TAGS, unseen))
        top()
        links += tag == "a"
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z|(?=[\s/]))", re.I).search(page, position)
            position = end.start() if end else size
    close()
    return out


def named_boilerplate(block: Block) -> bool:
    """Whether the markup itself says that a block is not the article's text."""
    return bool(BOILER_TAGS.intersection(block.tags)) or bool(BOILER_WORDS & block.names) or ("header" in block.tags and "article" not in block.tags and "main" not in block.tags)


def labels_of(page: list[Block]) -> np.ndarray | None:
    """1 for content, 0 for boilerplate, where the markup names the article; else nothing."""
    if not any(b.article for b in page):
        return None
    return np.array([b.article and not named_boilerplate(b) for b in page], np.int64)


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % WIDTH


_HASHED: dict[str, int] = {}


AS_WRITTEN, NO_ARTICLE, ONLY_DIVISIONS = range(3)


def _tags(block: Block, view: int) -> tuple[str, ...]:
    if view == NO_ARTICLE:
        return tuple("div" if t in ARTICLE_TAGS else t for t in block.tags)
    if view == ONLY_DIVISIONS:
        return tuple("div" if t in ARTICLE_TAGS or t == "p" else t for t in block.tags)
    return block.tags


def features(page: list[Block], view: int = AS_WRITTEN) -> list[np.ndarray]:
    """Indices of the features of each block: ancestor tags, name words, and figures of its text.

    Views with plain divisions in place of article and paragraph tags serve training only.
    """
    out = []
    total = max(1, len(page) - 1)
    for i, b in enumerate(page):
        text, size = b.text, len(b.text)
        words = text.count(" ") + 1
        tags = _tags(b, view)
        said = ["bias", f"leaf={tags[-1] if tags else ''}", f"words={min(8, words.bit_length())}", f"place={4 * i // total}"]
        said += [f"tag={t}" for t in set(tags)]
        said += [f"name={n}" for n in b.names]
        if BOILER_WORDS & b.names:
            said.append("boilername")
        if BOILER_TAGS.intersection(b.tags):
            said.append("boilertag")
        if b.article and view == AS_WRITTEN:
            said.append("article")
        link = b.linked / max(1, size)
        said.append(f"links={0 if not b.linked else 1 if link < 0.3 else 2 if link < 0.8 else 3}")
        stops = sum(map(text.count, ".?!"))
        said.append(f"stops={min(3, stops)}")
        said.append(f"ends={text[-1] in '.!?:;”»'}")
        said.append(f"digits={sum(map(str.isdigit, text[:400])) * 5 // max(1, min(400, size))}")
        out.append(np.array([_HASHED.get(s) or _HASHED.setdefault(s, _hash(s)) for s in said], np.int64))
    return out


class Chain:
    """A linear-chain conditional random field with two labels and binary features."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves  # (WIDTH, 2), (2, 2)

    def scores(self, page: list[np.ndarray]) -> np.ndarray:
        return np.stack([self.weights[f].sum(axis=0) for f in page])

    def decode(self, page: list[np.ndarray]) -> np.ndarray:
        """The most likely labels, by Viterbi; ties go to boilerplate."""
        own = self.scores(page)
        best, back = own[0], np.zeros((len(own), 2), np.int64)
        for t in range(1, len(own)):
            paths = best[:, None] + self.moves
            back[t] = paths.argmax(axis=0)
            best = paths.max(axis=0) + own[t]
        out = np.zeros(len(own), np.int64)
        out[-1] = best.argmax()
        for t in range(len(own) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def gradient(self, page: list[np.ndarray], truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Observed minus expected: per block and label, and per move, by forward-backward."""
        own = self.scores(page)
        n = len(own)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = own[0]
        for t in range(1, n):
            ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, None] + self.moves, axis=0) + own[t]
        for t in range(n - 2, -1, -1):
            behind[t] = np.logaddexp.reduce(self.moves + own[t + 1] + behind[t + 1], axis=1)
        total = np.logaddexp.reduce(ahead[-1])
        blocks_off = -np.exp(ahead + behind - total)
        blocks_off[np.arange(n), truth] += 1
        moves_off = np.zeros((2, 2))
        for t in range(1, n):
            moves_off -= np.exp(ahead[t - 1][:, None] + self.moves + own[t] + behind[t] - total)
            moves_off[truth[t - 1], truth[t]] += 1
        return blocks_off, moves_off


def with_decoys(page: list[Block], truth: np.ndarray, draw: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A page with passages of its article repeated inside menus, notices, forms, comments and the like, as boilerplate."""
    content = np.flatnonzero(truth)
    if not len(content):
        return page, truth
    tags, names = sorted(BOILER_TAGS | {"header"}), sorted(BOILER_WORDS)
    out, labels = list(page), truth.tolist()
    for _ in range(4):
        first = int(draw.choice(content))
        some = [page[i] for i in content if first <= i < first + int(draw.integers(1, 4))]
        tag = str(draw.choice(tags)) if draw.random() < 0.5 else "div"
        named = frozenset((str(draw.choice(names)),)) if tag == "div" or draw.random() < 0.5 else frozenset()
        inside = draw.random() < 0.4  # within the article or beside it
        at = int(draw.choice(content)) if inside else int(draw.choice([0, len(out)]))
        outer = tuple(some[0].tags[:-1]) if inside else ("html", "body")
        decoys = [Block(b.text, (*outer, tag, b.tags[-1] if b.tags else "p"), named, b.linked, inside and tag != "header") for b in some]
        if inside and tag == "header":
            continue
        out[at:at] = decoys
        labels[at:at] = [0] * len(decoys)
    return out, np.array(labels, np.int64)


def train(pages: list[tuple[list[Block], np.ndarray]], rounds: int = 4, rate: float = 0.3, ridge: float = 1e-3) -> Chain:
    """Adaptive gradient steps over the pages, each as written and with its article markup out of sight."""
    chain = Chain(np.zeros((WIDTH, 2)), np.zeros((2, 2)))
    seen_w, seen_m = np.full((WIDTH, 2), 1e-6), np.full((2, 2), 1e-6)
    order = np.random.default_rng(SEED)
    sets = []
    for page, truth in pages:
        for view in (AS_WRITTEN, NO_ARTICLE, ONLY_DIVISIONS):
            sets.append((features(page, view), truth))
            dressed, labels = with_decoys(page, truth, order)
            sets.append((features(dressed, view), labels))
    for _ in range(rounds):
        for i in order.permutation(len(sets)):
            page, truth = sets[i]
            if not page:
                continue
            off, moves = chain.gradient(page, truth)
            where = np.concatenate(page)
            step = np.zeros((WIDTH, 2))
            np.add.at(step, where, np.repeat(off, [len(f) for f in page], axis=0))
            used = np.unique(where)
            g = step[used] - ridge * chain.weights[used]
            seen_w[used] += g * g
            chain.weights[used] += rate * g / np.sqrt(seen_w[used])
            seen_m += moves * moves
            chain.moves += rate * moves / np.sqrt(seen_m)
    return chain


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Chain | None:
    """Train on a hash sample of labelled pages, at most about ``fit_pages`` of them."""
    marked = F.col("html").rlike(r"(?i)<(article|main)\b|articleBody")
    known = pages.where(marked & (F.char_length("html") <= FIT_CHARS)).select("html")
    total = known.count()
    if total > fit_pages:
        known = known.where(F.pmod(F.xxhash64("html", F.lit(SEED)), F.lit(1_000_000)) < max(1, int(1_000_000 * fit_pages / total)))
    sample = []
    for row in sorted(known.toLocalIterator(), key=lambda r: zlib.crc32(r["html"].encode("utf-8", "replace"))):
        page = blocks(row["html"])[:FIT_BLOCKS]
        truth = labels_of(page)
        if truth is not None and len(page):
            sample.append((page, truth))
    return train(sample) if sample else None


def extract(page: str | None, chain: Chain | None) -> str:
    found = blocks(page)
    if not found:
        return ""
    if chain is None:
        chosen = np.array([not named_boilerplate(b) for b in found])
    else:
        chosen = chain.decode(features(found)) == 1
    return "\n\n".join(b.text for b, x in zip(found, chosen.tolist(), strict=True) if x)


def main_text(page: Column, chain: Chain | None) -> Column:
    parts = (chain.weights, chain.moves) if chain else None

    @F.arrow_udf(returnType="string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Chain(*parts) if parts else None
        for column in batches:
            yield pa.array([extract(p, own) for p in column.to_pylist()], pa.string())

    return texts(page)


def extracted(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """page_id, url, text and n_chars: one row per row of pages."""
    text = main_text(F.col("html"), fit(pages, fit_pages))
    out = pages.select("page_id", "url", text.alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
