"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is a vector of its tag path (tags, classes and ids, hashed), of
its words (hashed) and of a few densities. A bidirectional LSTM in numpy reads the whole sequence in both directions and
labels every block as main text or not, so a block is judged by all that stands before and after it.

The labeller is trained here: on a bounded sample of the given pages, whose blocks in ``article`` or ``main`` elements are main
text unless a nested element says otherwise, and on pages laid out at random from the texts of that sample, which show it
other layouts. Training runs on the driver and takes seconds; labelling runs in the tasks, batch by batch.

Defined results: a null or empty page has no text. Markup that is cut off at the end of a page is dropped, text is kept.
White space is what Unicode
calls so, no-break spaces included. End tags that HTML lets a page leave out are implied; a quote that does not close ends with its tag.
Pages of any length are read whole, deep ones in linear time.  Without a page to learn from, no block is main text. Equal rows give equal results;
``text`` replaces a column of that name.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import hashed_sample
from basketlens.llm.shingles import hashed_words

#: Pages that the labeller is trained on at most, and characters of such a page at most.
TRAIN_PAGES, TRAIN_CHARS = 300, 200_000
PATH_DIM, WORD_DIM, DENSE_DIM, HIDDEN = 64, 16, 6, 16
INPUT = PATH_DIM + WORD_DIM + DENSE_DIM
EPOCHS, PAGES_A_STEP, RATE, SEED = 14, 24, 0.01, 7

#: A quote counts after an equals sign only, and if it is closed; else the tag ends at the next bracket.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("head script style template svg iframe select textarea title".split())
_FOREIGN = frozenset(("math", "svg"))
#: Elements that the start of others closes, and the elements that an open one is looked for in.
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select"),
           "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table"), "tbody": ("thead tbody", "table"), "tfoot": ("thead tbody", "table")}
_CLOSES = {name: (frozenset(closed.split()), frozenset(inside.split())) for name, (closed, inside) in _CLOSES.items()}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Steps of a path that a block keeps, the nearest ones: what the labeller is told, and a bound for deep pages.
PATH_STEPS = 48
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_RAW = frozenset(("iframe", "script", "style", "textarea", "title"))


@dataclass
class Block:
    """A leaf block: its text, the path to it, and how many of its characters are link text."""

    text: str
    path: tuple[str, ...]
    linked: int = 0


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order. Text in skipped elements and markup goes, character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    steps: list[str] = []  # of the stack, without inline elements
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = skipped = links = at = 0

    def flush() -> None:
        nonlocal linked
        if parts and (text := " ".join(html.unescape("".join(parts)).split())):
            out.append(Block(text, tuple(steps[-PATH_STEPS:]), linked))
        parts.clear()
        linked = 0

    def leave(names: frozenset[str] | tuple[str, ...], inside: frozenset[str] = frozenset()) -> None:
        """Closes the nearest open element of these names and all in it, if no element of ``inside`` stands before it."""
        nonlocal skipped, links
        if not any(opened[name] for name in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                for closed, step in stack[i:]:
                    opened[closed] -= 1
                    skipped -= closed in _SKIPPED
                    links -= closed == "a"
                    if step:
                        steps.pop()
                del stack[i:]
                return
            if stack[i][0] in inside:
                return

    while at < len(page):
        found = _TAG.search(page, at)
        piece = page[at: found.start()] if found else page[at:]
        if stack and stack[-1][0] == "head" and piece.strip():  # the end tag of a head may be left out
            leave(("head",))
        if piece and not skipped:
            parts.append(piece)
            linked += len(piece) if links else 0
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name not in _INLINE:
            flush()
        if found[1]:
            leave((name,))
            continue
        if stack and stack[-1][0] == "head" and name not in _HEAD:
            leave(("head",))
        if name in _ENDS_P and any(n == "p" for n, _ in stack[-3:]):
            leave(("p",))
        if name in _CLOSES:
            leave(*_CLOSES[name])
        if name in _VOID or found[3].endswith("/") and (name in _FOREIGN or any(opened[f] for f in _FOREIGN)):
            continue
        step = "" if name in _INLINE else " ".join([name, *_marks(found[3])])
        stack.append((name, step))
        opened[name] += 1
        if step:
            steps.append(step)
        skipped += name in _SKIPPED
        links += name == "a"
        if name in _RAW:  # its content is no markup
            end = re.compile(f"</{name}", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def _marks(attributes: str) -> list[str]:
    """Words of class, id and role."""
    return [w for m in _NAMES.finditer(attributes) for w in re.findall(r"[a-z]+", "".join(filter(None, m.groups())).lower())] if attributes.strip() else []


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """The input vectors of all blocks of several pages, one below the other."""
    every = [b for page in pages for b in page]
    x = np.zeros((len(every), INPUT), np.float32)
    if not every:
        return x
    known: dict[tuple[str, ...], np.ndarray] = {}
    for i, b in enumerate(every):
        if b.path not in known:
            v = np.zeros(PATH_DIM, np.float32)
            for depth, step in enumerate(reversed(b.path)):
                for word in step.split():
                    v[zlib.crc32(word.encode()) % PATH_DIM] += 1.0 / (1 + 0.1 * depth)
            known[b.path] = v
        x[i, :PATH_DIM] = known[b.path]
    words, counts = hashed_words([b.text for b in every])
    owner = np.repeat(np.arange(len(every)), counts)
    bags = np.bincount(owner * WORD_DIM + (words % np.uint64(WORD_DIM)).astype(np.int64), minlength=len(every) * WORD_DIM).reshape(-1, WORD_DIM)
    x[:, PATH_DIM: PATH_DIM + WORD_DIM] = bags / np.maximum(counts, 1)[:, None]
    size = np.array([len(b.text) for b in every])
    place = np.concatenate([np.arange(len(p)) / len(p) for p in pages if p])
    dense = (np.log1p(counts) / 5, np.minimum([b.linked for b in every] / size, 1.0), [min(len(b.path), 12) / 12 for b in every],
             [b.text[-1] in ".!?" for b in every], place, np.ones(len(every)))
    for k, column in enumerate(dense):
        x[:, PATH_DIM + WORD_DIM + k] = column
    return x


# ------------------------------------------------------------------- model

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """A bidirectional LSTM with one output per block. Sequences come padded: (steps, pages, input) and a mask."""

    def __init__(self, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        new = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {}
        for d in "fb":  # forward, backward; gates: input, forget, output, candidate
            self.w[f"x{d}"], self.w[f"h{d}"] = new(INPUT, 4 * HIDDEN), new(HIDDEN, 4 * HIDDEN)
            self.w[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
            self.w[f"c{d}"][HIDDEN: 2 * HIDDEN] = 1
        self.w["o"], self.w["p"] = new(2 * HIDDEN, 1), np.zeros(1, np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states along one direction; what the backward pass needs. A padded step keeps the state as it is."""
        steps, pages, _ = x.shape
        drive = x.reshape(-1, INPUT) @ self.w[f"x{d}"] + self.w[f"c{d}"]
        drive = drive.reshape(steps, pages, -1)
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = drive[t] + h @ self.w[f"h{d}"]
            i, f, o = (_sigmoid(gates[:, k * HIDDEN: (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            kept.append((t, i, f, o, g, c, h, tc, m))
            c, h = np.where(m, c_new, c), np.where(m, o * tc, h)
            out[t] = h
        return out, kept

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._pass(x, mask, d)[0] for d in "fb"], axis=2)
        return _sigmoid((states @ self.w["o"])[:, :, 0] + self.w["p"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy and its gradient by backpropagation through time."""
        runs = {d: self._pass(x, mask, d) for d in "fb"}
        states = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = _sigmoid((states @ self.w["o"])[:, :, 0] + self.w["p"])
        n = mask.sum()
        loss = float(-(np.log(np.where(y > 0, p, 1 - p) + 1e-9) * mask).sum() / n)
        delta = ((p - y) * mask / n).astype(np.float32)
        grads = {"o": np.einsum("tbh,tb->h", states, delta)[:, None], "p": delta.sum(keepdims=True).reshape(1)}
        for k, d in enumerate("fb"):
            above = delta[:, :, None] * self.w["o"][k * HIDDEN: (k + 1) * HIDDEN, 0]
            dw_h, d_drive = np.zeros_like(self.w[f"h{d}"]), np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, i, f, o, g, c, h, tc, m in reversed(runs[d][1]):
                dh = dh + above[t]
                own_h, own_c = dh * m, dc * m
                own_c = own_c + own_h * o * (1 - tc * tc)
                gate = np.concatenate([own_c * g * i * (1 - i), own_c * c * f * (1 - f), own_h * tc * o * (1 - o), own_c * i * (1 - g * g)], axis=1)
                d_drive[t] = gate
                dw_h += h.T @ gate
                dh = gate @ self.w[f"h{d}"].T + dh * (1 - m)
                dc = own_c * f + dc * (1 - m)
            flat = d_drive.reshape(-1, 4 * HIDDEN)
            grads |= {f"h{d}": dw_h, f"x{d}": x.reshape(-1, INPUT).T @ flat, f"c{d}": flat.sum(axis=0)}
        return loss, grads

    def fit(self, pages: list[list[Block]], labels: list[list[int]], epochs: int = EPOCHS, seed: int = SEED) -> list[float]:
        """Adam over batches of pages of similar length; the loss of each epoch."""
        draw = random.Random(seed)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        batches = [order[k: k + PAGES_A_STEP] for k in range(0, len(order), PAGES_A_STEP)]
        ready = [padded([pages[i] for i in b], [labels[i] for i in b]) for b in batches]
        one = {k: np.zeros_like(v) for k, v in self.w.items()}
        two, losses, step = {k: np.zeros_like(v) for k, v in self.w.items()}, [], 0
        for _ in range(epochs):
            draw.shuffle(ready)
            total = 0.0
            for x, mask, y in ready:
                loss, grads = self.gradients(x, mask, y)
                total, step = total + loss, step + 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.999 * two[k] + 0.001 * g * g
                    self.w[k] -= (RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total / max(1, len(ready)))
        return losses

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text. Pages of similar length are read side by side."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            group = [order.pop()]
            while order and len(group) < 256 and len(pages[order[-1]]) * 2 > longest and longest * len(group) < 65536:
                group.append(order.pop())
            x, mask, _ = padded([pages[i] for i in group])
            p = self.probabilities(x, mask)
            for k, i in enumerate(group):
                out[i] = p[: len(pages[i]), k] >= 0.5
        return out


def padded(pages: list[list[Block]], labels: list[list[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(p) for p in pages]
    x = np.zeros((max(sizes), len(pages), INPUT), np.float32)
    mask, y = np.zeros(x.shape[:2], bool), np.zeros(x.shape[:2], np.float32)
    rows, at = vectors(pages), 0
    for k, n in enumerate(sizes):
        x[:n, k], mask[:n, k] = rows[at: at + n], True
        if labels:
            y[:n, k] = labels[k]
        at += n
    return x, mask, y


# ---------------------------------------------------------------- training

MAIN = frozenset(("article", "main"))
ASIDE = frozenset("nav header footer aside form menu dialog button comments comment notice cookie banner ad ads advert share sidebar related newsletter".split())
#: Names that layouts give their parts: fixed values of the generator below.
_BODIES = ("article", "main", "div class=content", "div class=post-body", "div id=main-content", "section class=entry-content", "div class=article-text", "div id=story", "div", "td class=text", "article class=post")
_PARTS = {
    "menu": ("nav", "ul class=menu", "div class=navigation", "div id=nav", "div class=breadcrumbs", "nav class=top-menu"),
    "top": ("header", "div class=header", "div id=masthead", "header class=site-header"),
    "side": ("aside", "div class=sidebar", "div class=related", "aside class=widget", "section class=recommended"),
    "note": ("div class=cookie-notice", "div class=notice", "div class=banner", "div role=alert", "div class=newsletter", "div class=popup", "div class=consent"),
    "ad": ("div class=ad", "div class=advert", "div class=sponsored", "aside class=ads", "div id=promo", "div class=advertisement"),
    "form": ("form", "form class=search", "div class=login", "form id=subscribe"),
    "talk": ("section class=comments", "div id=comments", "div class=comment-list", "ol class=comments", "div class=discussion", "section id=responses"),
    "foot": ("footer", "div class=footer", "div id=footer", "footer class=site-footer", "div class=copyright"),
}


def weak_labels(page: list[Block]) -> list[int]:
    """Blocks in an article or main element, outside of nested parts that are named as something else."""
    out = []
    for b in page:
        steps = [step.split() for step in b.path]
        inside = [i for i, step in enumerate(steps) if step[0] in MAIN]
        out.append(int(bool(inside) and not any(ASIDE & set(step) for step in steps[inside[0] + 1:])))
    return out


def invented(texts_: list[str], others: list[str], draw: random.Random) -> tuple[list[Block], list[int]]:
    """A page of random layout and the label of each block."""
    def element(kind: str, inner: str) -> str:
        name, _, attribute = kind.partition(" ")
        key, _, value = attribute.partition("=")
        return f"<{name} {key}=\"{value}\">{inner}</{name}>" if attribute else f"<{name}>{inner}</{name}>"

    def part(kind: str) -> str:
        say = lambda: html.escape(draw.choice(others))
        if kind == "menu" or kind in ("side", "foot") and draw.random() < 0.5:
            inner = "<ul>" + "".join(f'<li><a href="/x">{say()}</a></li>' for _ in range(draw.randint(2, 8))) + "</ul>"
        elif kind == "talk":
            inner = "".join(f"<{t} class=\"comment\"><p>{html.escape(draw.choice(texts_))}</p></{t}>" for t in ["div"] * draw.randint(1, 5))
        elif kind == "form":
            inner = f"<label>{say()}</label><input name=\"q\"><button>{say()}</button>"
        else:
            inner = draw.choice(("{}", "<p>{}</p>", "<div>{}</div>")).format(html.escape(draw.choice([*others, *texts_])))
        return element(draw.choice(_PARTS[kind]), inner)

    body = f"<h1>{html.escape(draw.choice(others))}</h1>" if draw.random() < 0.8 else ""
    for _ in range(draw.randint(1, 12)):
        text = html.escape(draw.choice(texts_))
        body += draw.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}</b><br>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>")).format(text)
        if draw.random() < 0.06:
            body += "<!--aside-->" + part(draw.choice(("ad", "note", "side", "form"))) + "<!--/aside-->"
    kind = draw.choice(_BODIES)
    marked = re.sub(r"<!--(/?)aside-->", lambda m: "\x02" if m[1] else "\x01", element(kind, body))
    before = [part(k) for k in ("top", "menu", "note", "ad", "form", "side") if draw.random() < 0.45]
    after = [part(k) for k in ("talk", "side", "ad", "form", "note", "foot", "menu") if draw.random() < 0.45]
    draw.shuffle(before)
    wrap = draw.choice(("{}", "<div class=\"page\">{}</div>", "<div id=\"wrapper\"><div>{}</div></div>", "<table><tr>{}</tr></table>"))
    page = "<html><head><title>t</title></head><body>" + wrap.format("".join(before) + "\x03" + marked + "\x04" + "".join(after)) + "</body></html>"
    # control characters travel with the text of the blocks next to them and tell the label
    found, labels, main, aside = [], [], False, False
    for b in blocks(re.sub("([\x01-\x04])", r"<p>\1</p>", page)):
        if b.text in ("\x03", "\x04"):
            main = b.text == "\x03"
        elif b.text in ("\x01", "\x02"):
            aside = b.text == "\x01"
        else:
            found.append(b)
            labels.append(int(main and not aside))
    return found, labels


def train_labeller(sample: list[str], seed: int = SEED) -> BlockLabeller | None:
    """The labeller learned from a sample of pages; none if the sample has no main text."""
    real = [blocks(page) for page in sample]
    labels = [weak_labels(page) for page in real]
    main = [b.text for page, y in zip(real, labels) for b, label in zip(page, y) if label]
    other = [b.text for page, y in zip(real, labels) for b, label in zip(page, y) if not label]
    if not main:
        return None
    draw = random.Random(seed)
    made = [invented(main, other or ["Home"], draw) for _ in range(2 * TRAIN_PAGES)]
    known = [(p, y) for p, y in zip(real, labels) if any(y)]
    pages, targets = zip(*(known + made))
    model = BlockLabeller(seed)
    model.fit(list(pages), list(targets), seed=seed)
    return model


def training_sample(pages: DataFrame, page_id: str = "page_id", column: str = "html", rows: int = TRAIN_PAGES) -> list[str]:
    """At most ``rows`` pages of at most ``TRAIN_CHARS`` characters: the least by hash of their id."""
    usable = pages.where(F.length(f"`{column}`").between(1, TRAIN_CHARS)).select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{column}`").alias("html"))
    return [r.html for r in hashed_sample(usable, ["id", "html"], rows, pages.count()).collect()]


def extract(pages: DataFrame, page_id: str = "page_id", column: str = "html", name: str = "text", labeller: BlockLabeller | None = None) -> DataFrame:
    """``pages`` without the markup column, with its main text under ``name`` (empty if there is none)."""
    model = labeller or train_labeller(training_sample(pages, page_id, column))
    weights = pages.sparkSession.sparkContext.broadcast(model)  # some ten thousand numbers

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        own = [blocks(page or "") for page in batch.to_pylist()]
        if weights.value is None:
            return pa.array([""] * len(own), pa.string())
        return pa.array([" ".join(b.text for b, keep in zip(page, labels) if keep) for page, labels in zip(own, weights.value.label(own))], pa.string())

    rest = [F.col(f"`{c}`") for c in pages.columns if c not in (column, name)]
    return pages.select(*rest, run(F.col(f"`{column}`")).alias(name))
