"""HTML main text by a recurrent block labeller (bidirectional LSTM in numpy).

A page is read as its sequence of leaf blocks: the text between two block-level
tags, with the path of open elements. Each block becomes a vector: hashed tag,
class, id and role tokens of its path, hashed words, and a few shares (links,
digits, capitals, punctuation, length). A bidirectional LSTM reads the whole
sequence, so a block is judged in the context of the document before and after
it, and labels it article or not. The text of a page is its article blocks, one
a line.

The model is trained here, by ``train``, on generated pages of many layouts
whose labels are known because the generator places them (``train_pages`` of
them, a fixed number that does not depend on the corpus); its few thousand
weights are broadcast. Every page of the input is read whole.

Scripts, styles, templates, form controls, comments in the markup and the title
never become blocks. Inline tags and <br> are white space or nothing inside a
block, and so are formulas and drawings, whose text stays. Missing end tags close
where the parent closes; a paragraph, list item or cell also closes where the
next one begins. Markup is read in one pass, in time linear in the page.

Defined results: a null or empty page, and one without article blocks, has the
empty text; a comment or script that never closes runs to the end of the page,
and a "<" that no ">" follows is text; repeated rows get equal texts; an empty
table gives an empty result.
"""

from __future__ import annotations

import collections
import functools
import html
import random
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BlockConfig:
    path_size: int = 96
    word_size: int = 32
    hidden: int = 24
    train_pages: int = 1600
    epochs: int = 8
    rate: float = 0.01
    seed: int = 7
    threshold: float = 0.5

    @property
    def size(self) -> int:
        return self.path_size + self.word_size + 8


#: Elements whose content is no text of the page, up to their end tag; the second kind only where there is one.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
RAW_IF_CLOSED = frozenset("annotation annotation-xml desc metadata".split())
#: Elements whose text is left out with everything inside them.
SKIPPED = frozenset("template select option optgroup datalist button object canvas audio video".split())
TAG = re.compile(r"<(?:(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|(?P<odd>[a-z/!?]))", re.I)
NAME = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
TAG_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base col embed hr input link meta param source track".split())
HEAD = frozenset("head base link meta".split())
#: What a start tag closes when it is still open in the same parent.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: How many of the innermost open elements describe a block.
DEEPEST = 48


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, stop, tag, whether an end tag, attributes) of every piece of markup, in one pass; no tag for comments.

    A raw element is one piece with its content. A ``<`` that no ``>`` follows is text; quotes that never close do not count.
    """
    at, last, quotes, unclosed = 0, page.rfind(">"), True, set()
    while m := TAG.search(page, at):
        start, tag, end, rest = m.start(), m["tag"], bool(m["end"]), m["rest"] or ""
        stop = m.end()
        if tag is None:
            named = NAME.match(page, start)
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 2) + 3
                stop = stop if stop > 2 else len(page)
            elif named is None:
                close = page.find("]]>", start) if page.startswith("<![CDATA[", start) and "]]>" not in unclosed else -1
                if close < 0:
                    unclosed.add("]]>")
                stop = close + 3 if close >= 0 else (page.find(">", start) + 1 or len(page))
            elif start > last:
                at = start + 1
                continue
            else:
                stop = named.end()
                while quotes:
                    q = TAG_END.search(page, stop)
                    if q is None:
                        quotes = False  # from here on no tag ends outside quotes: they are no quotes
                        break
                    stop = q.end()
                    if q[0] == ">":
                        break
                    close = page.find(q[0], stop) if q[0] not in unclosed else -1
                    if close < 0:
                        unclosed.add(q[0])
                    stop = close + 1 or stop
                if not quotes:
                    stop = page.index(">", named.end()) + 1
                end, tag, rest = bool(named[1]), named[2], page[named.end() : stop - 1]
            if tag is None:
                yield start, stop, "", False, ""
                at = stop
                continue
        tag = tag.lower()
        if not end and (tag in RAW or (tag in RAW_IF_CLOSED and tag not in unclosed)):
            close = _end_of(tag).search(page, stop)
            if close:
                stop = page.find(">", close.end() - 1) + 1 or len(page)
            elif tag in RAW:
                stop = len(page)
            else:
                unclosed.add(tag)
        yield start, stop, tag, end, rest
        at = stop


@functools.cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?:[\s/>]|\Z)", re.I)


def _element(tag: str, rest: str) -> tuple[str, ...]:
    out = ["t:" + tag]
    for name, a, b, c in ATTRIBUTE.findall(rest) if rest else ():
        kind = "r:" if name.lower() == "role" else "c:"
        out += [kind + x for x in re.split(r"[^a-z]+", (a or b or c).lower()) if x]
    return tuple(out)


def leaf_blocks(page: str, see: Callable[[int, int, str, bool, str], None] | None = None) -> list[tuple[str, int, tuple[tuple[str, ...], ...]]]:
    """(text, characters inside links, innermost open elements) of every leaf block with text, in page order. ``see`` is called with every mark of the page, in the same pass."""
    out: list[tuple[str, int, tuple[tuple[str, ...], ...]]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_tags: collections.Counter[str] = collections.Counter()
    parts: list[str] = []
    linked, in_link, at = 0, False, 0
    skipped = foreign = 0  # depth at which a left-out element stands; open math and svg elements

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((text, min(linked, len(text)), tuple(e for _, e in stack[-DEEPEST:])))
        linked = 0

    def close(depth: int) -> None:
        for tag, _ in stack[depth:]:
            open_tags[tag] -= 1
        del stack[depth:]

    for start, stop, tag, end, rest in markup(page):
        if see:
            see(start, stop, tag, end, rest)
        if start > at and not skipped:
            parts.append(page[at:start])
            if in_link:
                linked += start - at
        at = stop
        if not tag or tag in RAW or tag in RAW_IF_CLOSED:
            continue
        if tag in ("math", "svg"):
            foreign = max(0, foreign + (-1 if end else not rest.endswith("/")))
            continue
        if foreign and tag in ENDS_P:
            foreign = 0
        if tag in INLINE or foreign:
            if tag == "a":
                in_link = not end
            elif tag in ("br", "img", "wbr") and not skipped:
                parts.append(" ")
            continue
        if end:
            if not open_tags[tag]:
                if not skipped and tag not in SKIPPED:
                    flush()
                continue
            depth = len(stack) - 1
            while stack[depth][0] != tag:
                depth -= 1
            if skipped and depth + 1 > skipped:
                close(depth)
            elif skipped and depth + 1 == skipped:
                close(depth)
                skipped = 0
            else:
                flush()
                close(depth)
                skipped, in_link = 0, False
            continue
        if not skipped and tag not in SKIPPED:
            flush()
        if tag in VOID:
            continue
        closes = CLOSES.get(tag, frozenset())
        while stack and len(stack) > skipped and (stack[-1][0] in closes or (stack[-1][0] == "p" and tag in ENDS_P) or (stack[-1][0] == "head" and tag not in HEAD)):
            close(len(stack) - 1)
        stack.append((tag, _element(tag, rest)))
        open_tags[tag] += 1
        if not skipped and tag in SKIPPED:
            skipped = len(stack)
    if at < len(page) and not skipped:
        parts.append(page[at:])
    flush()
    return out


_word_buckets: dict[str, int] = {}
_path_vectors: dict[tuple, np.ndarray] = {}


def _bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


def block_vectors(blocks: list[tuple[str, int, tuple[tuple[str, ...], ...]]], starts: list[int], config: BlockConfig) -> np.ndarray:
    """(blocks, size) float32 inputs of consecutive pages; ``starts`` has the first block of each page and the end."""
    n, p, w = len(blocks), config.path_size, config.word_size
    out = np.zeros((n, config.size), dtype=np.float32)
    if len(_word_buckets) > 500_000:
        _word_buckets.clear()
    if len(_path_vectors) > 50_000:
        _path_vectors.clear()
    known, owners, buckets = _word_buckets, [], []
    for i, (text, linked, path) in enumerate(blocks):
        vector = _path_vectors.get(path)
        if vector is None:
            vector = np.zeros(p, dtype=np.float32)
            for depth, element in enumerate(reversed(path)):
                for token in element:
                    vector[_bucket(token, p)] += 1.0 if depth < 3 else 0.7
            _path_vectors[path] = np.minimum(vector, 2.0, out=vector)
        out[i, :p] = vector
        words = text.split(" ")
        owners.append(len(words))
        for word in words:
            b = known.get(word)
            if b is None:
                b = known[word] = _bucket(word.lower().strip(".,;:!?()"), w)
            buckets.append(b)
        size = len(text)
        out[i, p + w :] = (np.log1p(size) / 8, linked / size, len(words) / 50 if len(words) < 100 else 2.0, text.count(".") / len(words), text.count(",") / len(words), text[-1] in ".!?\"'", text[0].isupper(), text.count("|") / len(words))
    if n:
        counts = np.bincount(np.repeat(np.arange(n), owners) * w + np.array(buckets), minlength=n * w).reshape(n, w)
        out[:, p : p + w] = np.minimum(counts, 4) / 4
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, weights: tuple[np.ndarray, np.ndarray, np.ndarray], back: bool, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, B, H) of one direction; padded steps pass the state on."""
    wx, wh, b = weights
    h_size = wh.shape[0]
    z = x @ wx + b
    h = np.zeros((x.shape[1], h_size), x.dtype)
    c = np.zeros_like(h)
    out = np.empty((*x.shape[:2], h_size), x.dtype)
    for t in reversed(range(len(x))) if back else range(len(x)):
        a = z[t] + h @ wh
        gates = _sigmoid(a[:, : 3 * h_size])
        i, f, o = gates[:, :h_size], gates[:, h_size : 2 * h_size], gates[:, 2 * h_size :]
        g = np.tanh(a[:, 3 * h_size :])
        m = mask[t][:, None]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, tc))
        c = m * c2 + (1 - m) * c
        h = m * (o * tc) + (1 - m) * h
        out[t] = h
    return out


def _back(grad: np.ndarray, x: np.ndarray, mask: np.ndarray, weights: tuple, keep: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of one direction's weights from those of its hidden states."""
    wx, wh, _ = weights
    dz = np.zeros((*x.shape[:2], wx.shape[1]), x.dtype)
    dwh = np.zeros_like(wh)
    dh = np.zeros_like(grad[0])
    dc = np.zeros_like(dh)
    for t, h, c, i, f, o, g, tc in reversed(keep):
        m = mask[t][:, None]
        dh = dh + grad[t]
        inner, dc_in = dh * m, dc * m
        dc2 = dc_in + inner * o * (1 - tc * tc)
        da = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), inner * tc * o * (1 - o), dc2 * i * (1 - g * g)], axis=1)
        dz[t] = da
        dwh += h.T @ da
        dh = da @ wh.T + dh * (1 - m)
        dc = dc2 * f + dc * (1 - m)
    flat = dz.reshape(-1, dz.shape[2])
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0)


def _padded(vectors: np.ndarray, starts: list[int], pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    longest = max(starts[i + 1] - starts[i] for i in pages)
    x = np.zeros((longest, len(pages), vectors.shape[1]), dtype=np.float32)
    mask = np.zeros((longest, len(pages)), dtype=np.float32)
    for j, i in enumerate(pages):
        n = starts[i + 1] - starts[i]
        x[:n, j] = vectors[starts[i] : starts[i + 1]]
        mask[:n, j] = 1
    return x, mask


def label(vectors: np.ndarray, starts: list[int], model: list[np.ndarray], most: int = 40_000) -> np.ndarray:
    """Probability of article for every block; pages of like length run together."""
    out = np.zeros(len(vectors), dtype=np.float32)
    sizes = np.diff(starts)
    order = [i for i in np.argsort(sizes, kind="stable") if sizes[i]]
    while order:
        width = max(1, min(len(order), most // int(sizes[order[-1]])))
        pages, order = np.array(order[-width:]), order[:-width]
        x, mask = _padded(vectors, starts, pages)
        h = np.concatenate([_run(x, mask, tuple(model[:3]), False), _run(x, mask, tuple(model[3:6]), True)], axis=2)
        p = _sigmoid(h @ model[6] + model[7])[:, :, 0]
        for j, i in enumerate(pages):
            out[starts[i] : starts[i + 1]] = p[: sizes[i], j]
    return out


# The generator of training pages: containers by the role their text plays.
ARTICLE = ["article", "main", "div class=content", "div id=content", "div class=post", "div class=entry-content", "div class=article-body", "section class=story", "div id=main-content", "div class=text", "div itemprop=articleBody", "section", "td class=maincell", "div"]
OTHER = (
    "nav;div class=menu;ul class=nav;div class=navbar;div id=navigation;div class=breadcrumb;div class=pagination;header;div id=header;div class=site-header;div class=topbar;footer;div id=footer;div class=site-footer;div class=copyright;"
    "aside;div class=sidebar;div id=sidebar;div class=widget;div class=related;div class=recommended;div class=ad;div class=ads;div class=advert;div class=advertisement;div class=banner;div class=sponsored;div class=promo;"
    "div class=cookie-notice;div id=cookie-banner;div class=notice;div class=consent;div role=alert;div class=popup;div class=modal;form;form class=search;div class=login;div class=newsletter;div class=subscribe;div class=share;div class=social;"
    "div class=comments;section id=comments;div class=comment;ol class=commentlist;div class=reply;div class=disqus;div class=discussion;ul class=tags;div role=navigation;div role=banner;div role=contentinfo;div role=complementary"
).split(";")
PHRASES = ["Subscribe now", "Accept all cookies", "Read more", "All rights reserved", "Log in", "Share this", "Leave a reply", "Privacy policy", "Related stories", "Advertisement", "Search", "Home", "Contact us", "Next page", "posted 3 days ago", "Terms of use"]


def generated_page(rng: random.Random) -> str:
    """A page of random layout; blocks of the article begin with the mark \\x01, all others with \\x02."""
    letters = "abcdefghijklmnoprstuvwzéüñ"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(120)]

    # article and clutter alike may be plain, shouted, repetitive or full of symbols
    manner = rng.choice(["plain"] * 7 + ["shout", "repeat", "symbols"])

    def sentence(low: int, high: int) -> str:
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", "", "", ","]) for _ in range(rng.randint(low, high))]
        if manner == "shout":
            words = [w.upper() + "!!" for w in words]
        elif manner == "repeat":
            words = [w for w in words for _ in range(rng.randint(5, 13))]
        elif manner == "symbols":
            words = [w + rng.choice(["###", "***", "&amp;&amp;&amp;", "%%%", "$$$"]) for w in words]
        return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?"])

    def prose(mark: str, most: int) -> str:
        return mark + " ".join(sentence(1, 18) for _ in range(rng.randint(1, most)))

    def wrap(container: str, inside: str) -> str:
        return f"<{container}>{inside}</{container.split()[0]}>"

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.6:
            return f"<p>{prose(chr(1), 8)}" + rng.choice(["</p>", "</p>", ""])
        if kind < 0.7:
            return f"<p><b>{prose(chr(1), 1)}<br>"
        if kind < 0.78:
            return f"<h{rng.randint(2, 4)}>{chr(1)}{sentence(1, 7)[:-1]}</h2>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{prose(chr(1), 2)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.89:
            return wrap("blockquote", f"<p>{prose(chr(1), 3)}</p>")
        if kind < 0.93:
            return f"<pre>{prose(chr(1), 2)}</pre>"
        if kind < 0.97:
            return f"<p>{chr(1)}" + " | ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30))) + "</p>"
        return f"<p>{prose(chr(1), 1)} <a href=x>{sentence(1, 4)}</a> {sentence(3, 12)}</p>"

    def clutter() -> str:
        container, style = rng.choice(OTHER), rng.random()
        if style < 0.35:
            inside = "<ul>" + "".join(f"<li><a href=x>{chr(2)}{rng.choice([*vocabulary[:20], *PHRASES])}</a></li>" for _ in range(rng.randint(1, 9))) + "</ul>"
        elif style < 0.6:
            inside = chr(2) + rng.choice([sentence(2, 12), rng.choice(PHRASES), "&copy; " + sentence(1, 5)])
        elif style < 0.85:
            inside = "".join(f"<{t}>{prose(chr(2), 3)}</{t}>" for t in rng.choices(["p", "div", "p", "h3", "li"], k=rng.randint(1, 4)))
        else:
            inside = f"<h4>{chr(2)}{rng.choice(PHRASES)}</h4><p>{prose(chr(2), 2)}</p>"
        return wrap(container, inside)

    body = [clutter() for _ in range(rng.randint(0, 4))]
    article = ([f"<h1>{chr(1)}{sentence(2, 12)[:-1]}</h1>"] if rng.random() < 0.8 else []) + [paragraph() for _ in range(rng.choice([1, 2, rng.randint(1, 8), rng.randint(1, 20)]))]
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        article.insert(rng.randint(0, len(article)), clutter())
    if rng.random() < 0.97:
        inner = wrap(rng.choice(ARTICLE[:-1] if rng.random() < 0.9 else ARTICLE), "".join(article))
        if rng.random() < 0.3:
            inner = wrap(rng.choice(["div", "div class=container", "div id=page", "main", "section"]), inner)
        body.append(inner)
    body += [clutter() for _ in range(rng.randint(0, 5))]
    return "<html><head><title>x</title></head><body>" + "".join(body) + rng.choice(["</body></html>", ""])


@functools.cache
def train(config: BlockConfig = BlockConfig()) -> list[np.ndarray]:
    """Weights fitted to generated pages, once a session; the same configuration gives the same weights."""
    rng = random.Random(config.seed)
    blocks, starts, truth = [], [0], []
    for _ in range(config.train_pages):
        for text, linked, path in leaf_blocks(generated_page(rng)):
            truth.append("\x01" in text)
            blocks.append((text.replace("\x01", "").replace("\x02", "").strip() or "x", linked, path))
        starts.append(len(blocks))
    vectors, labels = block_vectors(blocks, starts, config), np.array(truth, dtype=np.float32)
    draw, h, d = np.random.default_rng(config.seed), config.hidden, config.size
    model = [draw.normal(0, s, shape).astype(np.float32) for s, shape in ((0.1, (d, 4 * h)), (0.15, (h, 4 * h)), (0, (4 * h,)), (0.1, (d, 4 * h)), (0.15, (h, 4 * h)), (0, (4 * h,)), (0.2, (2 * h, 1)), (0, (1,)))]
    model[2][h : 2 * h] = model[5][h : 2 * h] = 1.0  # remember at first
    first, second, step = [np.zeros_like(m) for m in model], [np.zeros_like(m) for m in model], 0
    usable = np.array([i for i in range(len(starts) - 1) if starts[i + 1] > starts[i]])
    sizes = np.diff(starts)
    for epoch in range(config.epochs):
        shuffled = draw.permutation(usable)
        batches = np.array_split(shuffled[np.argsort(sizes[shuffled] // 6, kind="stable")], max(1, len(usable) // 32))
        for k in draw.permutation(len(batches)):
            x, mask = _padded(vectors, starts, batches[k])
            y = np.zeros_like(mask)
            for j, i in enumerate(batches[k]):
                y[: sizes[i], j] = labels[starts[i] : starts[i + 1]]
            seen_f, seen_b = [], []
            states = np.concatenate([_run(x, mask, tuple(model[:3]), False, seen_f), _run(x, mask, tuple(model[3:6]), True, seen_b)], axis=2)
            gap = (_sigmoid(states @ model[6] + model[7])[:, :, 0] - y) * mask / mask.sum()
            grad = gap[:, :, None] * model[6][:, 0]
            grads = [*_back(grad[:, :, :h], x, mask, tuple(model[:3]), seen_f), *_back(grad[:, :, h:], x, mask, tuple(model[3:6]), seen_b), states.reshape(-1, 2 * h).T @ gap.reshape(-1, 1), gap.sum()[None]]
            step += 1
            rate = config.rate * (1 - epoch / config.epochs)
            for m, g, a, b in zip(model, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                m -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def extract_texts(pages: list[str | None], model: list[np.ndarray], config: BlockConfig) -> list[str]:
    blocks, starts = [], [0]
    for page in pages:
        blocks += leaf_blocks(page) if page else []
        starts.append(len(blocks))
    if not blocks:
        return [""] * len(pages)
    article = label(block_vectors(blocks, starts, config), starts, model) >= config.threshold
    return ["\n".join(blocks[i][0] for i in range(a, b) if article[i]) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def main_text(pages: DataFrame, config: BlockConfig = BlockConfig(), model: list[np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model if model is not None else train(config))
    picked = pages.select("page_id", "url", "html")
    schema = picked.drop("html").schema.add("text", "string")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = extract_texts(batch.column("html").to_pylist(), weights, config)
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return picked.mapInArrow(extract, schema).withColumn("n_chars", F.char_length("text").cast("long"))
