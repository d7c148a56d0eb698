"""Main text of HTML pages by a recurrent block labeller.

A tolerant tokenizer turns a page into leaf blocks, each with its path of
block tags and their class and id words. A bidirectional LSTM in numpy reads the
sequence of hashed path and word vectors, so every block is labelled with the
whole page in view; blocks labelled main are joined in page order. The weights
are trained by train() on generated pages, whose labels are known, and kept
beside this module.

Defined results: null or empty html, and pages without main text, give an empty text;
unclosed and crossed tags are tolerated: an open element ends with the one around it, scripts and styles
at their closing tag in the source or with the page; repeated pages are extracted alike; an empty table
gives an empty result; other columns of the input are ignored. A page is held at once, as 232 floats a block.
"""

from __future__ import annotations

import html as _html
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A comment, a tag with its attributes (quotes count only where a value begins), another declaration, text, or a lone sign.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|</?[a-zA-Z][^\s/>]*+(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|[^<]+|<", re.S
)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
NO_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*none\b", re.I)
#: HTML element names. Elements of UNPARSED hold no text of the page and no markup, those of HIDDEN no text of the
#: page; of these, any block ends one that can't hold blocks. VOID ones never close.
UNPARSED = {k: re.compile(rf"</{k}(?=[\s/>]|\Z)", re.I) for k in ("script", "style", "noscript", "iframe", "textarea", "title")}
HIDDEN = {"template", "svg", "math", "object", "select", "canvas", "audio", "video", "button"}
ENDED_BY_BLOCKS = {"svg", "math", "select", "audio", "video", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "head", "label", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that an opening tag of the same kind, or any block for p, closes.
SELF_CLOSING = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}

PATH_DIM, WORD_DIM, EXTRA, HIDDEN_DIM = 192, 32, 8, 16
INPUT = PATH_DIM + WORD_DIM + EXTRA
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "html_weights.npz")


def _hidden(tag: str, start: int) -> bool:
    """Whether an opening tag, whose attributes begin at start, hides its element."""
    for name, *values in ATTRIBUTE.findall(tag, start):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and NO_DISPLAY.search(value)):
            return True
    return False


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """Leaf blocks in page order: (path words, text, characters inside links)."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    text: list[str] = []
    linked, in_link = 0, 0
    mute = -1  # place in the stack of the outermost open element of HIDDEN

    def flush() -> None:
        nonlocal linked
        if text:
            t = "".join(text)
            if "&" in t:
                t = _html.unescape(t)
            t = " ".join(t.split())
            if t and not any(s[2] for s in stack):
                out.append((tuple(w for s in stack for w in s[1]), t, min(linked, len(t))))
            text.clear()
        linked = 0

    def close(name: str) -> None:
        """End the innermost element of this name and what is open inside; a block outside HIDDEN ends its text too."""
        nonlocal mute, in_link
        at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), len(stack))
        if name in BLOCK and (mute < 0 or at < mute):
            flush()
            in_link = 0
        del stack[at:]
        if at <= mute:
            mute = -1

    page, at = page or "", 0
    while m := TOKEN.match(page, at):
        tok, at = m.group(), m.end()
        if tok[0] != "<" or tok == "<" or not (n := NAME.match(tok)):
            if (tok[0] != "<" or tok == "<") and mute < 0:  # else a comment or declaration
                text.append(tok)
                if in_link:
                    linked += len(tok)
            continue
        name = n.group(1).lower()
        closing, empty = tok[1] == "/", tok.endswith("/>")
        if name in UNPARSED:
            if not closing and not empty:
                if end := UNPARSED[name].search(page, at):
                    at = end.start()
                elif name in ("script", "style"):
                    at = len(page)
        elif closing and (name in BLOCK or name in HIDDEN):
            close(name)
        elif name in HIDDEN:
            if not closing and not empty:
                if mute < 0:
                    mute = len(stack)
                stack.append((name, (), False))
        elif name == "br":
            if mute < 0:
                text.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
        elif name in BLOCK:
            while mute >= 0 and stack[-1][0] in ENDED_BY_BLOCKS:
                stack.pop()
                if len(stack) == mute:
                    mute = -1
            if mute < 0:
                flush()
                in_link = 0
            if name in VOID:
                continue
            closes = SELF_CLOSING.get(name, {"p"})
            while len(stack) > mute + 1 and stack[-1][0] in closes:
                stack.pop()
            words, hides = [name], len(tok) > n.end() + 1 and _hidden(tok, n.end())
            if "=" in tok:
                for a in MARKS.findall(tok):
                    words += ["." + w for w in re.split(r"[^a-z]+", "".join(a).lower()) if w]
            stack.append((name, tuple(words), hides))
    flush()
    return out


def features(page_blocks: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    """One row per block: hashed path words, hashed text words, shape of the text and place in the page."""
    x = np.zeros((len(page_blocks), INPUT), np.float32)
    n = len(page_blocks)
    seen: dict[tuple[str, ...], list[int]] = {}
    for i, (path, text, linked) in enumerate(page_blocks):
        if path not in seen:
            seen[path] = [zlib.crc32(w.encode()) % PATH_DIM for w in path]
        x[i, seen[path]] = 1.0
        words = text.lower().encode("utf-8", "replace").split()
        at = np.bincount([zlib.crc32(w) & (WORD_DIM - 1) for w in words], minlength=WORD_DIM)
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = at / np.sqrt((at * at).sum())
        x[i, PATH_DIM + WORD_DIM :] = (
            np.log1p(len(words)) / 4, np.log1p(len(text)) / 6, linked / len(text), text[-1] in ".!?…:", i / n, 1.0 if i == 0 else 0.0, 1.0 if i == n - 1 else 0.0, np.log1p(n) / 5,
        )
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """One direction of the LSTM over (time, batch, input); where mask is 0 the state stays zero."""
    steps, batch, _ = x.shape
    h = np.zeros((batch, HIDDEN_DIM), np.float32)
    c = np.zeros_like(h)
    out = np.zeros((steps, batch, HIDDEN_DIM), np.float32)
    gates_x = (x.reshape(steps * batch, -1) @ w + b).reshape(steps, batch, -1)
    for t in range(steps):
        g = gates_x[t] + h @ u
        i, f, o = (_sigmoid(g[:, k * HIDDEN_DIM : (k + 1) * HIDDEN_DIM]) for k in range(3))
        z = np.tanh(g[:, 3 * HIDDEN_DIM :])
        before = c
        m = mask[t][:, None]
        c = (f * c + i * z) * m
        tc = np.tanh(c)
        if keep is not None:
            keep.append((i, f, o, z, before, tc, h, m))
        h = o * tc * m
        out[t] = h
    return out


def forward(p: dict, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Logits (time, batch)."""
    a: list | None = [] if keep is not None else None
    b: list | None = [] if keep is not None else None
    ahead = _run(x, p["w0"], p["u0"], p["b0"], mask, a)
    back = _run(x[::-1], p["w1"], p["u1"], p["b1"], mask[::-1], b)[::-1]
    both = np.concatenate([ahead, back, x], axis=2)
    if keep is not None:
        keep += [a, b, both]
    return both @ p["v"] + p["c"][0]


def _back(d_out: np.ndarray, kept: list, x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dw = np.zeros((x.shape[2], 4 * HIDDEN_DIM), np.float32)
    du, db = np.zeros_like(u), np.zeros(4 * HIDDEN_DIM, np.float32)
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t in range(len(kept) - 1, -1, -1):
        i, f, o, z, before, tc, h, m = kept[t]
        dh = (dh + d_out[t]) * m
        dc = (dc + dh * o * (1 - tc * tc)) * m
        g = np.concatenate([dc * z * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - z * z)], axis=1)
        dw += x[t].T @ g
        du += h.T @ g
        db += g.sum(0)
        dh, dc = g @ u.T, dc * f
    return dw, du, db


def _pad(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, seqs))
    x, mask = np.zeros((steps, len(seqs), INPUT), np.float32), np.zeros((steps, len(seqs)), np.float32)
    for i, s in enumerate(seqs):
        x[: len(s), i], mask[: len(s), i] = s, 1
    return x, mask


def start_weights(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for k in "01":
        p["w" + k] = (rng.normal(size=(INPUT, 4 * HIDDEN_DIM)) / np.sqrt(INPUT)).astype(np.float32)
        p["u" + k] = (rng.normal(size=(HIDDEN_DIM, 4 * HIDDEN_DIM)) / np.sqrt(HIDDEN_DIM)).astype(np.float32)
        p["b" + k] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN_DIM)
    p["v"], p["c"] = np.zeros(2 * HIDDEN_DIM + INPUT, np.float32), np.zeros(1, np.float32)
    return p


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    keep: list = []
    logit = forward(p, x, mask, keep)
    prob, n = _sigmoid(logit), mask.sum()
    loss = float(-((y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)) * mask).sum() / n)
    d = ((prob - y) * mask / n).astype(np.float32)
    a, b, both = keep
    g = {"v": np.tensordot(d, both, axes=([0, 1], [0, 1])), "c": np.array([d.sum()], np.float32)}
    d_both = d[:, :, None] * p["v"]
    g["w0"], g["u0"], g["b0"] = _back(d_both[:, :, :HIDDEN_DIM], a, x, p["u0"])
    g["w1"], g["u1"], g["b1"] = _back(d_both[::-1, :, HIDDEN_DIM : 2 * HIDDEN_DIM], b, x[::-1], p["u1"])
    return loss, g


MAIN, OTHER = "\x01", "\x02"


def made_page(rng: np.random.Generator) -> str:
    """A page whose every block begins with MAIN or OTHER."""
    letters = "aeioubcdfghlmnprstvéöñ"
    pick = lambda *xs: xs[rng.integers(len(xs))]
    word = lambda: "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(2, 10)))
    line = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))

    def sentence(n: int = 40) -> str:
        return ". ".join(line(1, 18).capitalize() for _ in range(rng.integers(1, max(2, n // 8)))) + pick(".", ".", "", "!", "***", " |")

    def noise() -> str:
        """Class words that say nothing."""
        return " ".join(pick("wide", "clearfix", "row", "container", "lead", "text-large", "overflow-hidden", "js-x", word(), word()) for _ in range(rng.integers(1, 4)))

    def element(tag: str, mark: str, text: str, close: float = 0.93) -> str:
        inner = f"{mark}{text}"
        attrs = f' class="{noise()}"' if rng.random() < 0.15 else ""
        if rng.random() < 0.1:
            inner = f"<b>{inner}" + pick("</b>", "<br>", "")
        return f"<{tag}{attrs}>{inner}" + (f"</{tag}>" if rng.random() < close else "")

    def links(mark: str, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{mark}{line(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def box(names: tuple[str, ...], body: str, tags: tuple[str, ...] = ("div", "section", "div")) -> str:
        tag = pick(*tags)
        own = [pick(*names) + pick("", "", "-box")] + ([noise()] if rng.random() < 0.35 else [])
        return f'<{tag} {pick("class", "id")}="{" ".join(own if rng.random() < 0.7 else own[::-1])}">{body}</{tag}>'

    def article_part() -> str:
        r = rng.random()
        if r < 0.72:
            return element("p", MAIN, sentence(pick(8, 20, 60, 200)))
        if r < 0.80:
            return element(pick("h2", "h3"), MAIN, line(1, 9))
        if r < 0.86:
            return "<ul>" + "".join(element("li", MAIN, line(2, 16)) for _ in range(rng.integers(2, 6))) + "</ul>"
        if r < 0.90:
            return f"<blockquote>{element('p', MAIN, sentence(20))}</blockquote>"
        if r < 0.94:
            return "<table>" + "".join("<tr>" + "".join(element("td", MAIN, line(1, 4)) for _ in range(3)) + "</tr>" for _ in range(rng.integers(1, 4))) + "</table>"
        if r < 0.97:
            return element("pre", MAIN, line(3, 30))
        return box(("ad", "advert", "adverts", "ads", "sponsor", "promo", "banner"), element("p", OTHER, sentence(20)) if rng.random() < 0.5 else OTHER + sentence(20))

    parts = [article_part() for _ in range(rng.integers(1, 24) if rng.random() < 0.75 else rng.integers(1, 4))]
    body = (element(pick("h1", "h1", "h1", "h2"), MAIN, line(1, 12), 1.0) if rng.random() < 0.85 else "") + "".join(parts)
    if rng.random() < 0.7:
        body = f'<article class="{noise()}">{body}</article>' if rng.random() < 0.25 else f"<article>{body}</article>"
        if rng.random() < 0.3:
            body = f"<main>{body}</main>"
    else:
        body = pick(f"<main>{body}</main>", box(("content", "post", "entry", "main", "article", "story"), body))
    p = element("p", OTHER, sentence(20))
    small = OTHER + pick(sentence(12), "&copy; " + line(1, 3), line(1, 6))
    before = [
        f"<nav>{links(OTHER, rng.integers(2, 9))}</nav>", f"<header>{element(pick('p', 'p', 'h1', 'h2'), OTHER, line(1, 6), 1.0)}{links(OTHER, 3) if rng.random() < 0.7 else ''}</header>", box(("ad", "advert", "ads", "sponsor", "promo"), small),
        box(("cookie", "notice", "consent", "banner", "alert", "gdpr"), p, ("div", "aside")), box(("menu", "nav", "navbar", "breadcrumb"), links(OTHER, 4)), f"<form>{element('label', OTHER, line(1, 4))}<input></form>",
    ]
    after = [
        f"<footer>{small}</footer>", f"<aside>{p}{links(OTHER, 3)}</aside>", box(("sidebar", "related", "widget", "share", "newsletter", "subscribe"), p + links(OTHER, 3)), box(("ad", "advert", "ads", "sponsor", "promo"), small),
        box(("comments", "comment", "replies", "disqus", "discussion"), "".join(f'<div class="comment">{element("p", OTHER, sentence(pick(8, 60)))}</div>' for _ in range(rng.integers(1, 6)))),
        f'<form>{element("p", OTHER, line(1, 8))}</form>', f"<footer>{links(OTHER, 4)}<p>{small}</p></footer>",
    ]
    top = [x for x in before if rng.random() < 0.4]
    end = [x for x in after if rng.random() < 0.45]
    rng.shuffle(top)
    return f"<html><head><title>{line(1, 6)}</title></head><body>{''.join(top)}{body}{''.join(end)}</body></html>"


def made_sample(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    found, y = [], []
    for path, text, linked in blocks(made_page(rng)):
        clean = text.replace(MAIN, "").replace(OTHER, "").strip() or "-"
        found.append((path, clean, min(linked, len(clean))))
        y.append(MAIN in text)
    return features(found), np.array(y, np.float32)


def train(steps: int = 500, batch: int = 16, rate: float = 0.02, seed: int = 5) -> tuple[dict, list[float]]:
    """Adam on freshly generated pages; gives the weights and the losses."""
    rng = np.random.default_rng(seed)
    p = start_weights()
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    losses = []
    for step in range(1, steps + 1):
        sample = [made_sample(rng) for _ in range(batch)]
        x, mask = _pad([s for s, _ in sample])
        y = np.zeros_like(mask)
        for i, (_, t) in enumerate(sample):
            y[: len(t), i] = t
        loss, g = gradients(p, x, mask, y)
        losses.append(loss)
        lr = rate * (1 - step / (steps + 1))
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            p[k] = (p[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p, losses


def load() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def label(p: dict, pages: list[list[tuple]]) -> list[np.ndarray]:
    """For each page which blocks are main text."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        group, cells = [], 0
        while at < len(order) and (not group or (len(group) < 64 and len(pages[order[at]]) * (len(group) + 1) <= 20_000)):
            group.append(order[at])
            at += 1
        x, mask = _pad([features(pages[i]) for i in group])
        logit = forward(p, x, mask)
        for j, i in enumerate(group):
            out[i] = logit[: len(pages[i]), j] > 0
    return out


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", weights: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    p = weights or load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), 256):
                part = b.slice(start, 256)
                found = [blocks(h) for h in part.column("html").to_pylist()]
                texts = ["\n".join(x[1] for x, m in zip(f, ms, strict=True) if m) for f, ms in zip(found, label(p, found), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return src.mapInArrow(run, T.StructType([src.schema["page_id"], src.schema["url"], *T._parse_datatype_string("text string, n_chars long").fields]))


if __name__ == "__main__":
    made, track = train()
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in made.items()})
    print("loss", np.mean(track[:20]), np.mean(track[-20:]))
