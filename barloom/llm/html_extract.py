"""HTML extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks. Each block is a vector of hashed tag-path tokens, hashed words and a few
shape figures; a bidirectional LSTM reads the whole sequence in both directions and labels every block as main text or
not. The model is small and is trained on the driver: on generated pages of several layouts, whose main blocks are known
by construction and a third of which have no telling tags or names (so that text, links and place must tell), and on a
sample of at most `sample_pages` rows of the table itself, labelled by the meaning of their tag and class names.
"""

from __future__ import annotations

import html as markup
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of
from barloom.llm.hashing import by_bytes, column_bytes, hash_words, split_words

SAMPLE_PAGES = 200
#: Characters of a page of the sample, at most: what the driver holds is bounded. Such pages are labelled like any other.
SAMPLE_CHARS = 50_000
MADE_PAGES = 500
PATH_DIMS, WORD_DIMS, SHAPE_DIMS = 256, 24, 8
DIMS = PATH_DIMS + WORD_DIMS + SHAPE_DIMS
HIDDEN = 16
#: Bytes of pages that are labelled at once; a longer page is labelled alone, in some ten times its bytes of memory.
BATCH_BYTES = 4 << 20

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
#: An attribute with its value; attributes are read one after the other, so that a name inside a value isn't one.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMING = frozenset(("class", "id", "role"))
RAW = frozenset("script style noscript template textarea title iframe svg head".split())
SIGNS = np.zeros(256, bool)
SIGNS[[ord(c) for c in ".,;:!?"]] = True
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup "
    "time tt u var wbr img".split()
)
#: An opening tag of the first kind ends an open one of the second, unless a holder stands between.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()
)
HOLDERS = frozenset("article aside body div footer form header main nav section table ul ol dl html blockquote".split())


class Blocks:
    """The leaf blocks of a page: text, hashed path, characters inside links, and what tags and names say of them."""

    def __init__(self, page: str) -> None:
        self.texts: list[str] = []
        self.paths: list[int] = []  # a bit for each slot of the hashed path: bounded, however deep the tags nest
        self.linked: list[int] = []
        self.told: list[int] = []
        stack: list[tuple[str, int, int]] = [("", 0, 0)]  # with the bits of all tags up to here
        open_: dict[str, int] = {}
        parts: list[str] = []
        links = 0

        def close() -> None:
            nonlocal links
            text = " ".join(markup.unescape("".join(parts)).split()) if parts else ""
            if text:
                self.texts.append(text)
                self.paths.append(stack[-1][1])
                self.told.append(stack[-1][2])
                self.linked.append(min(links, len(text)))
            parts.clear()
            links = 0

        def push(tag: str, names: list[str]) -> None:
            path, says = _meaning(tuple(names))
            stack.append((tag, stack[-1][1] | path, stack[-1][2] | says))
            open_[tag] = open_.get(tag, 0) + 1

        def pop_to(k: int) -> None:
            for tag, *_ in stack[k:]:
                open_[tag] -= 1
            del stack[k:]

        at, end = 0, len(page)
        while at < end:
            m = TOKEN.search(page, at)
            piece = page[at : m.start() if m else end]
            if piece:
                parts.append(piece)
                if open_.get("a"):
                    links += len(piece.strip())
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag not in INLINE:
                    close()
                if open_.get(tag):
                    pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag in RAW:
                shut = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if tag in ("head", "svg") and not shut:
                    continue
                at = shut.end() if shut else end
                continue
            if tag not in INLINE:
                close()
            ends = ENDS.get(tag) or ({"p"} if tag in ENDS_P else None)
            if ends and any(open_.get(x) for x in ends):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        pop_to(k)
                        break
                    if stack[k][0] in HOLDERS:
                        break
            if tag not in VOID and not m[3].endswith("/"):
                names = [tag]
                for n in ATTRIBUTE.finditer(m[3]) if "=" in m[3] else ():
                    if n[1].lower() not in NAMING:
                        continue
                    names += [f".{x}" for x in re.split(r"[\s_-]+", (n[2] or n[3] or n[4] or "").lower()) if x]
                push(tag, names)
        close()


BOILER_TAGS = frozenset("nav footer aside form button select menu dialog label".split())
BOILER_NAMES = re.compile(
    r"\.(ad|ads|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumb\w*|header|footer|sidebar|side|widget|related|share|social"
    r"|cookie\w*|consent|notice\w*|alert\w*|popup|modal|comment\w*|disqus|repl(?:y|ies)|newsletter|subscribe|login|signup|search|pag(?:er|ination)"
    r"|copyright|legal|toolbar|masthead|complementary|contentinfo|form)$"
)
MAIN = frozenset("article main .main .content .article .post .entry .story".split())
BODY = frozenset("p h1 h2 h3 blockquote pre".split())


MAIN_BIT, BOILER_BIT, HEADER_BIT, BODY_BIT = 1, 2, 4, 8


@lru_cache(20_000)
def _meaning(names: tuple[str, ...]) -> tuple[int, int]:
    """Path bits of a tag with its names, and bits of what they say."""
    own = set(names)
    tests = (MAIN & own, BOILER_TAGS & own or any(map(BOILER_NAMES.match, names)), "header" in own, BODY & own)
    return sum({1 << zlib.crc32(name.encode()) % PATH_DIMS for name in names}), sum(1 << i for i, hit in enumerate(tests) if hit)


def weak_labels(blocks: Blocks) -> np.ndarray:
    """1 for blocks inside a main container and no other; without any such container, paragraphs and headings."""
    main, boiler, header, body = (np.array(blocks.told, np.int64) & bit > 0 for bit in (MAIN_BIT, BOILER_BIT, HEADER_BIT, BODY_BIT))
    return (~boiler & ~(header & ~main) & (main if main.any() else body)).astype(np.float32)


def features(*pages: Blocks) -> np.ndarray:
    """One row per block of the pages, one page after the other. All words of a block enter its word vector."""
    texts = [t for page in pages for t in page.texts]
    n = len(texts)
    x = np.empty((n, DIMS), np.float32)
    if not n:
        return x
    bits = b"".join(path.to_bytes(PATH_DIMS // 8, "little") for page in pages for path in page.paths)
    x[:, :PATH_DIMS] = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(n, -1), axis=1, bitorder="little")
    data, offsets = column_bytes(pa.array(texts, pa.string()))
    starts, ends, row = split_words(data, offsets)
    words = np.maximum(1, np.bincount(row, minlength=n))
    flat = np.bincount(row * WORD_DIMS + (hash_words(data, starts, ends) % np.uint64(WORD_DIMS)).astype(np.int64), minlength=n * WORD_DIMS)
    x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = flat.reshape(n, WORD_DIMS) / words[:, None]
    size = np.array([len(t) for t in texts])
    signs = np.bincount(np.searchsorted(offsets, np.flatnonzero(SIGNS[data]), "right") - 1, minlength=n)
    linked = np.array([v for page in pages for v in page.linked])
    place = np.concatenate([np.arange(m) / m for page in pages if (m := len(page.texts))])
    shape = [np.log1p(size) / 8, np.log1p(words) / 6, linked / size, signs / size * 10, place]
    shape += [np.array([t[-1] in '.!?"' for t in texts]), np.array(["©" in t or "|" in t for t in texts]), np.ones(n)]
    x[:, PATH_DIMS + WORD_DIMS :] = np.stack(shape, axis=1)
    return x


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"{d}x": w(DIMS, 4 * HIDDEN), f"{d}h": w(HIDDEN, 4 * HIDDEN), f"{d}c": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"{d}c"][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"o": w(2 * HIDDEN, 1), "oc": np.zeros(1, np.float32)}

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: (T, B, DIMS), in reading order of the direction; padding keeps the state."""
        steps, batch, _ = x.shape
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        out = np.zeros((steps, batch, HIDDEN), np.float32)
        gates = x @ self.p[f"{d}x"] + self.p[f"{d}c"]
        for t in range(steps):
            z = gates[t] + h @ self.p[f"{d}h"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep is not None:
                keep.append((h, c, i, f, o, g, tc, m))
            c = m * c2 + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hidden = np.concatenate([self._pass("f", x, mask), self._pass("b", x[::-1], mask[::-1])[::-1]], axis=2)
        return 1 / (1 + np.exp(-np.clip((hidden @ self.p["o"])[..., 0] + self.p["oc"], -30, 30)))

    def _gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept = {"f": [], "b": []}
        hf = self._pass("f", x, mask, kept["f"])
        hb = self._pass("b", x[::-1], mask[::-1], kept["b"])
        hidden = np.concatenate([hf, hb[::-1]], axis=2)
        p = 1 / (1 + np.exp(-np.clip((hidden @ self.p["o"])[..., 0] + self.p["oc"], -30, 30)))
        d_out = ((p - y) * mask / mask.sum())[..., None].astype(np.float32)
        grads = {"o": np.einsum("tbh,tbo->ho", hidden, d_out), "oc": d_out.sum(axis=(0, 1))}
        d_hidden = d_out @ self.p["o"].T
        for d, dh_all, xs in (("f", d_hidden[..., :HIDDEN], x), ("b", d_hidden[::-1, :, HIDDEN:], x[::-1])):
            wh = self.p[f"{d}h"]
            dz_all = np.zeros((*xs.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(wh)
            dh, dc = 0.0, 0.0
            for t in range(len(xs) - 1, -1, -1):
                h, c, i, f, o, g, tc, m = kept[d][t]
                dh = dh + dh_all[t]
                dhm, dcm = dh * m, dc * m
                dc2 = dcm + dhm * o * (1 - tc**2)
                dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dhm * tc * o * (1 - o), dc2 * i * (1 - g**2)], axis=1)
                dz_all[t] = dz
                gh += h.T @ dz
                dh = dz @ wh.T + dh * (1 - m)
                dc = dc2 * f + dc * (1 - m)
            grads |= {f"{d}h": gh, f"{d}x": np.einsum("tbd,tbg->dg", xs, dz_all), f"{d}c": dz_all.sum(axis=(0, 1))}
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 14, batch: int = 24, rate: float = 0.012, seed: int = 3) -> Labeller:
        """Adam on the mean log loss of each batch's blocks, at a falling rate; pages of similar length share a batch."""
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        groups = [pages[k : k + batch] for k in range(0, len(pages), batch)]
        r = random.Random(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            r.shuffle(groups)
            for g in groups:
                step += 1
                x, mask = padded([p[0] for p in g])
                y = np.zeros(mask.shape, np.float32)
                for b, (_, labels) in enumerate(g):
                    y[: len(labels), b] = labels
                now = rate * max(0.05, 1 - step / (epochs * len(groups) + 1))
                for k, d in self._gradients(x, mask, y).items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x, mask = np.zeros((steps, len(rows), DIMS), np.float32), np.zeros((steps, len(rows)), np.float32)
    for b, r in enumerate(rows):
        x[: len(r), b] = r
        mask[: len(r), b] = 1
    return x, mask


#: Begins the text of the main blocks of made pages: a private character that no page has.
MARK = "\uf8f0"


def made_page(r: random.Random, telling: bool = True, main_told: bool | None = None) -> str:
    """A page of a random layout, for training, with its main blocks marked.

    telling: the tags and names around other blocks say what they are; main_told (as telling, if not given): those of
    the main container do. What says nothing is a div with a random name, or several in one another.
    """
    main_told = telling if main_told is None else main_told
    word = lambda: "".join(r.choice(("ka", "lo", "mi", "ren", "to", "shi", "ba", "den", "or")) for _ in range(r.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    own = lambda a, b: MARK + say(a, b)
    para = lambda: f"<p>{'<b>' if r.random() < 0.2 else ''}{own(8, 60) if not main_told or r.random() < 0.94 else own(1, 4)}.{'' if r.random() < 0.2 else '</p>'}"
    links = lambda n: "".join(f"<li><a href='/{word()}'>{say(1, 3)}</a></li>" for _ in range(n))
    outer = [
        f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>",
        f"<header><div>{say(1, 4)}</div><p>{say(3, 9)}</p></header>",
        f"<div class='menu'><ul>{links(r.randint(2, 6))}</ul></div>",
        f"<div class='{r.choice(('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo'))}'>{say(3, 12)}.</div>",
        f"<div class='{r.choice(('cookie-notice', 'notice', 'alert', 'consent'))}'><p>{say(6, 20)}.</p></div>",
    ]
    tail = [
        f"<aside class='{r.choice(('sidebar', 'related', 'widget'))}'><h3>{say(1, 3)}</h3><ul>{links(3)}</ul><p>{say(5, 20)}.</p></aside>",
        f"<div class='{r.choice(('sidebar', 'side', 'related'))}'><p>{say(8, 25)}.</p></div>",
        f"<form action='/s'><label>{say(1, 3)}</label><button>{say(1, 2)}</button></form>",
        f"<{r.choice(('section', 'div'))} {r.choice(('id', 'class'))}='comments'><h3>{say(1, 3)}</h3>" + "".join(f"<div class='comment'><p>{say(5, 40)}.</p></div>" for _ in range(r.randint(1, 4))) + "</section>",
        f"<div class='{r.choice(('newsletter', 'subscribe', 'share'))}'>{say(3, 10)}</div>",
    ]
    if not main_told:
        depth = r.randint(1, 4)
        open_, shut = "".join(f"<div class='{word()}'>" if r.random() < 0.7 else "<div>" for _ in range(depth)), "</div>" * depth
    else:
        open_, shut = r.choice((("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"), ("<div id='main'><article>", "</article></div>"), ("<main><div class='post'>", "</div></main>")))
    inner = [para() for _ in range(r.randint(0, 14) if r.random() < 0.95 else r.randint(30, 90))]
    for k in range(len(inner)):
        if r.random() < 0.2:
            item = lambda a, b: f"<li>{own(a, b)}</li>" if r.random() < 0.7 else f"<li>{MARK}<a href='/{word()}'>{say(a, b)}</a></li>"
            cells = "".join(f"<tr><td>{own(1, 3)}</td><td>{own(1, 4)}</td></tr>" for _ in range(r.randint(1, 4)))
            inner[k] += r.choice((
                f"<h2>{own(2, 6)}</h2>", f"<ul>{item(3, 12)}{item(3, 12)}</ul>", f"<ul>{''.join(item(1, 3) for _ in range(r.randint(2, 6)))}</ul>", f"<blockquote>{own(6, 20)}.</blockquote>",
                f"<div class='ad'>{say(3, 9)}.</div>", f"<table>{cells}</table>", f"<div>{own(4, 30)}.</div>",
            ))
    bare = r.random() < 0.1  # nothing follows the main blocks
    chosen, after = [x for x in outer if r.random() < 0.5], [x for x in tail if r.random() < 0.4 and not bare]
    r.shuffle(after)
    claim = r.choice(("&copy;", f"Copyright {r.randint(1995, 2030)}", "Copyright &copy;"))
    foot = f"<footer>{r.choice(('', '<p>'))}{claim} {word()}{r.choice(('.example &middot;', '. All rights reserved.', '|'))} {say(3, 12)}.</footer>" if r.random() < 0.85 and not bare else ""
    page = f"<html><head><title>{say(2, 6)}</title></head><body>{''.join(chosen)}{open_}<h1>{own(2, 9)}</h1>{''.join(inner)}{shut}{''.join(after)}{foot}</body></html>"
    if not telling:
        start = page.index(open_ + "<h1>")
        end = page.index(shut, page.rindex(MARK)) if MARK in page else len(page)
        blank = lambda part: re.sub(r"(class|id)='[^']*'", lambda m: f"class='{word()}'", re.sub(r"</?(?:nav|header|aside|footer|section)\b", lambda m: "</div" if m[0][1] == "/" else "<div", part))
        body = page[start:end].replace("class='ad'", f"class='{word()}'")
        page = blank(page[:start]) + body + blank(page[end:])
    return page[: r.randint(len(page) // 2, len(page))] if r.random() < 0.1 else page


def truth(blocks: Blocks) -> np.ndarray:
    """The labels of a made page; its marks go."""
    if blocks.texts and blocks.texts[-1] == MARK:  # the page was cut here
        for held in (blocks.texts, blocks.paths, blocks.linked, blocks.told):
            held.pop()
    labels = np.array([MARK in t for t in blocks.texts], np.float32)
    blocks.texts = [t.replace(MARK, "") for t in blocks.texts]
    return labels


def made(n: int, seed: int, telling: bool, main_told: bool | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    r, out = random.Random(seed), []
    for _ in range(n):
        blocks = Blocks(made_page(r, telling, main_told))
        labels = truth(blocks)
        out.append((features(blocks), labels))
    return out


def trained(pages: DataFrame | None = None, html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> Labeller:
    """A labeller fitted to generated pages and a bounded sample of the table's: those of at most sample_chars characters
    with the smallest hashes, whatever the order of the rows. The same table gives the same model."""
    half = MADE_PAGES // 2
    examples = made(half, 5, True) + made(MADE_PAGES, 6, False) + made(half, 7, True, False) + made(half // 2, 8, False, True)
    if pages is not None:
        few = pages.select(F.col(html_col).cast("string").alias("h")).where(F.col("h").isNotNull() & (F.length("h") <= sample_chars))
        few = few.select("h", F.xxhash64("h").alias("k"))
        # the first cut keeps the sort small; it holds more than the sample, or all
        total = pages.count()
        few = few.where(F.pmod("k", F.lit(max(1, total // (4 * sample_pages)))) == 0)
        for row in few.orderBy("k", "h").limit(sample_pages).collect():
            blocks = Blocks(row.h)
            examples.append((features(blocks), weak_labels(blocks)))
    return Labeller().fit(examples)


def label(model: Labeller, pages: list[Blocks], cells: int = 20_000) -> list[np.ndarray]:
    """Scores of each page's blocks; pages of similar length are read together."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i, b in enumerate(pages) if b.texts), key=lambda i: len(pages[i].texts))
    at = 0
    while at < len(order):
        size = 1
        while at + size < len(order) and (size + 1) * len(pages[order[at + size]].texts) <= cells:
            size += 1
        some = order[at : at + size]
        cuts = np.cumsum([len(pages[i].texts) for i in some])[:-1]
        scores = model.scores(*padded(np.split(features(*[pages[i] for i in some]), cuts)))
        for b, i in enumerate(some):
            out[i] = scores[: len(pages[i].texts), b]
        at += size
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """One row per page: id_col, url_col, text, n_chars, n_blocks, n_main.

    The text joins the blocks labelled as main text, in page order, by one space; white space in a block becomes one
    space and character references are decoded. A null or empty page, or one without main text, gives an empty text.
    Broken markup is read as far as it goes; very long pages are read whole. Repeated rows give repeated results, null
    identifiers stay null, an empty table gives no rows; other columns, also of clashing names, are ignored.
    """
    model = model or trained(pages, html_col)
    shared = pages.sparkSession.sparkContext.broadcast(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller()
        own.p = shared.value
        for batch in batches:
            for part in by_bytes(batch, "html", BATCH_BYTES):
                blocks = [Blocks(h) for h in part.column("html").to_pylist()]
                labels = [s >= 0.5 for s in label(own, blocks)]
                texts = [" ".join(t for t, y in zip(b.texts, s, strict=True) if y) for b, s in zip(blocks, labels, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([len(b.texts) for b in blocks], pa.int32()), pa.array([int(s.sum()) for s in labels], pa.int32())],
                    names=["id", "url", "text", "n_chars", "n_blocks", "n_main"],
                )

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    done = rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long, n_blocks int, n_main int")
    return done.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
