"""HTML extraction by a recurrent block labeller.

A page is read into leaf blocks: maximal runs of text between block-level tags, with the tag path (names,
classes, ids, roles) above them. Each block is a vector of hashed path parts, hashed words and a few
lengths; a bidirectional LSTM (numpy) reads a page's blocks in both directions and labels each one main text
or not, so that every decision sees the whole page. Scripts, styles and other unrendered elements are no blocks.

Training. The labeller is trained at each run on at most about ``train_pages`` pages (documented bound), chosen by a hash of their
html. Their labels come from several cues: markup that says what it is (``article``, ``main``, ``role=main`` against ``nav``,
``aside``, ``footer``, ``form``, comment and advert classes ...); class names with an ambiguous word (``related``, ``share``) only if
all their other words are those of page furniture, so that ``related-work`` stays text; blocks that are mostly links below such a name; and,
on pages without main-text markup, blocks that many sampled pages repeat. Parts of the path are hidden at random in
training, so that words and neighbours count too, and a second copy of the sample is strewn with markup that it
may lack (``strewn``), invented class names among it. On a page that is not marked so, blocks outside boilerplate are the teacher's main
text, whatever other pages hold. A long page is trained on in windows of blocks.

The text of a page: its main blocks in page order, white space runs made single spaces and trimmed,
joined by an empty line. Nothing else is cut, and pages of any length are read whole.

A page is read in time of its length, however deep or unclosed its elements are; of more than 100 levels of elements the path keeps
those that tell something first, which never touches the text. The sample is read in the tasks; only its windows of blocks come to the driver.

Edge cases: null or empty html has the empty text; elements with ``hidden`` or ``display: none`` are not read; broken markup is read as far as it goes (unclosed
comments and tags end with the page, unclosed quotes with their tag); repeated pages get equal texts; an empty table gives an empty
table. Columns named ``text`` or ``n_chars`` are replaced; all others come through.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

#: A quote that is never closed is an ordinary character, so that its tag ends at the next bracket.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">]|["'])*)>?|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
MARKS = {"class": ".", "id": "#", "role": "role="}
LINKS = "~links"  # path part of a block at least half of whose characters are links
SPACE = re.compile(r"\s+")
#: Fixed word lists of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math semantics mrow mi mo mn ms mtext mspace mstyle msup msub msubsup mfrac msqrt mroot mover munder munderover mpadded menclose".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template textarea select iframe title annotation annotation-xml".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MAIN = frozenset("article main role=main".split())
FURNITURE = frozenset("nav aside footer header form menu dialog button".split())
#: Words of class names, ids and roles: boilerplate wherever they stand alone or beside neutral ones; those that may be about a text's matter;
#: and neutral ones, which say where a box is or what it is made of.
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promotions nav navbar navigation menu sidebar footer header comment comments commentlist commenter reply replies respond cookie cookies consent gdpr popup modal newsletter subscribe subscription breadcrumb breadcrumbs complementary contentinfo search".split())
AMBIGUOUS = frozenset("related share sharing social notice notices recommended popular trending toolbar widget".split())
NEUTRAL = frozenset("a an and bar block body bottom box boxes button buttons card cards col column container content desktop entry extra feed fixed form global group head heading icon icons inner item items js latest left link links list main media mobile module more most news page panel post posts primary region right row secondary section side site small sticky story stories tags text the thread title to top topic topics ui ul user users view wrap wrapper zone article articles area".split())
WORD_PART = re.compile(r"[a-z]+|[0-9]+")

#: Markup that training strews among the sampled pages' blocks: around boilerplate, and around main text.
STREWN_OUT = tuple(tuple(x.split()) for x in ("aside p", "aside div", "nav li", "form label", "form p", "footer p", "header p", "section .comments p", "div .comment p", "ul .replies li", "div #comments div", "div .sidebar p", "div .cookie-notice p", "div .notice p", "div .banner div", "div .ads p", "div .advert p", "div .promo p", "div .share li", "div .related li", "div .newsletter p", "dialog p", "div .menu li", "div .breadcrumbs li"))
LEAVES = ("p", "div", "li", "h2", "h3", "h4", "label", "td")
STREWN_IN = tuple(tuple(x.split()) for x in ("div .content p", "section p", "div .body p", "div .text", "blockquote p", "ul li", "ol li", "h2", "h3", "figure p", "figure figcaption", "table tr td", "pre", "div .entry p"))

#: Path parts have buckets of their own for furniture, element names and all other names, so that a name never seen is not taken for furniture.
PART_BITS = 64
PATH_BITS, WORD_BITS, EXTRA = 3 * PART_BITS, 64, 4
FEATURES = PATH_BITS + WORD_BITS + EXTRA


#: Elements of a path that are kept; of deeper ones, the outermost that say nothing of their place are left out.
DEPTH = 100
UNSEEN = "~unseen"  # path part of an element that its own attributes hide
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)


@lru_cache(maxsize=100_000)
def telling(parts: tuple[str, ...]) -> bool:
    """Whether an element's path parts say that what it holds is main text, furniture or not shown."""
    return any(p in MAIN or p in HIDDEN or p in ("head", UNSEEN) or furniture(p, True) for p in parts)


def below(path: tuple[tuple[str, ...], ...], parts: tuple[str, ...]) -> tuple[tuple[str, ...], ...]:
    """The path of an element with ``parts`` under ``path``, in at most ``DEPTH`` elements."""
    if len(path) < DEPTH:
        return (*path, parts)
    drop = next((k for k, p in enumerate(path) if not telling(p)), 0)
    deeper = (*path[:drop], *path[drop + 1 :], parts)
    return path if deeper == path else deeper


def path_parts(tag: str, attributes: str) -> tuple[str, ...]:
    parts = [tag]
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if mark := MARKS.get(key):
            parts += [mark + v for v in value.lower().split()]
        elif (key == "hidden" and value.lower() != "until-found") or (key == "style" and NOT_SHOWN.search(value)):
            parts.append(UNSEEN)
    return tuple(parts)


class OpenElements:
    """The open elements of a page, with the places of each name, so that no look-up walks over them."""

    def __init__(self):
        self.names: list[str] = []
        self.paths: list[tuple[tuple[str, ...], ...]] = [()]
        self.places: dict[str, list[int]] = {}
        self.unseen: list[int] = []

    def last(self, name: str) -> int:
        return at[-1] if (at := self.places.get(name)) else -1

    def open(self, name: str, parts: tuple[str, ...]) -> None:
        at = len(self.names)
        self.places.setdefault(name, []).append(at)
        self.names.append(name)
        self.paths.append(self.paths[-1] if name in INLINE else below(self.paths[-1], parts))
        if name in HIDDEN or UNSEEN in parts:
            self.unseen.append(at)

    def close(self, name: str, stop: frozenset = frozenset()) -> bool:
        """Closes the innermost ``name`` and all inside it, unless a ``stop`` element lies between."""
        at = self.last(name)
        if at < 0 or any(self.last(s) > at for s in stop):
            return False
        while len(self.names) > at:
            self.places[self.names.pop()].pop()
            self.paths.pop()
        while self.unseen and self.unseen[-1] >= at:
            self.unseen.pop()
        return True


def blocks(html: str | None) -> list[tuple[tuple[str, ...], str]]:
    """(path parts, text) of the leaf blocks in page order, in time of the page's length; equal paths are one object."""
    out: list[tuple[tuple[str, ...], str]] = []
    opened = OpenElements()
    flat: dict[tuple, tuple[str, ...]] = {}
    before: tuple = (None, False, ())  # the last block's path, flattened
    text: list[str] = []
    linked = 0
    html = html or ""

    def flush() -> None:
        nonlocal linked, before
        if text:
            joined = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if joined:
                path, links = opened.paths[-1], 2 * linked >= len(joined)
                if path is not before[0] or links != before[1]:
                    if (path, links) not in flat:
                        flat[path, links] = tuple(p for parts in path for p in parts) + ((LINKS,) if links else ())
                    before = (path, links, flat[path, links])
                out.append((before[2], joined))
            text.clear()
        linked = 0

    at = 0
    while m := TOKEN.match(html, at):
        at = m.end()
        token = m.group()
        name = (m.group(2) or "").lower()
        if not name:
            if token.startswith(("<!", "<?")) or opened.unseen:
                continue
            text.append(token)
            if opened.last("a") >= 0:
                linked += len(token.strip())
        elif m.group(1):
            if name not in INLINE:
                flush()
                opened.close(name)
            elif name != "img":
                opened.close(name, CLOSES_P | {"li", "td", "th"})
        else:
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
                if name not in INLINE:
                    flush()
                continue
            if name == "br":
                text.append("\n")
                continue
            if name not in INLINE:
                flush()
                if name in CLOSES_P:
                    opened.close("p", frozenset({"button", "table", "td", "th"}))
                elif name == "li":
                    opened.close("li", frozenset({"ul", "ol", "menu"}))
                elif name in ("dt", "dd"):
                    opened.close("dt", frozenset({"dl"})) or opened.close("dd", frozenset({"dl"}))
                elif name in ("td", "th"):
                    opened.close("td", frozenset({"table"})) or opened.close("th", frozenset({"table"}))
                elif name == "tr":
                    opened.close("tr", frozenset({"table"}))
            if name not in VOID and not m.group(3).rstrip().endswith("/"):
                opened.open(name, path_parts(name, m.group(3)))
    flush()
    return out


@lru_cache(maxsize=100_000)
def furniture(part: str, links: bool) -> bool:
    """Whether a path part is that of page furniture; below a name with an ambiguous word this also holds for anything that is mostly ``links``."""
    if part in FURNITURE:
        return True
    if not part.startswith((".", "#", "role=")):
        return False
    words = WORD_PART.findall(part.removeprefix("role="))
    known = [w in BOILERPLATE or w in AMBIGUOUS for w in words]
    if links and any(known):
        return True
    return any(known) and all(k or w in NEUTRAL or w.isdigit() or len(w) == 1 for k, w in zip(known, words, strict=True))


def teacher(path: tuple[str, ...], marked: bool, repeated: bool = False) -> bool:
    """Whether a block is main text by its markup; ``marked``: its page has main-text markup; ``repeated``: many pages hold its text."""
    last = max((i for i, p in enumerate(path) if p in MAIN), default=-1)
    if last < 0 and (marked or repeated):
        return False
    below = last + 1
    while 0 < below < len(path) and path[below].startswith((".", "#", "role=")):
        below += 1  # the main element's own attributes
    links = path[-1:] == (LINKS,)
    return not any(furniture(p, links) for p in path[below:] if p not in MAIN) and "head" not in path


def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % size


class Hasher:
    """Feature vectors of blocks, with a bounded memory of path and word buckets."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def bucket(self, text: str, size: int) -> int:
        k = self.seen.get(text)
        if k is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            k = self.seen[text] = _bucket(text, size)
        return k

    def part(self, part: str) -> int:
        kind = 0 if furniture(part, False) or part == LINKS else 2 if part.startswith((".", "#", "role=")) else 1
        return kind * PART_BITS + self.bucket("<" + part, PART_BITS)

    def vectors(self, page: list[tuple[tuple[str, ...], str]]) -> np.ndarray:
        x = np.zeros((len(page), FEATURES), np.float32)
        paths: dict[int, list[int]] = {}  # by object: a page's equal paths are one
        for i, (path, text) in enumerate(page):
            at = paths.get(id(path))
            if at is None:
                at = paths[id(path)] = sorted({self.part(p) for p in path})
            x[i, at] = 1
            words = text.lower().split()
            for w in words:
                x[i, PATH_BITS + self.bucket(w, WORD_BITS)] += 1
            n = max(1, len(words))
            x[i, PATH_BITS : PATH_BITS + WORD_BITS] /= n
            x[i, -EXTRA:] = np.log1p(n) / 5, np.log1p(len(text)) / 8, i / len(page), sum(map(text.count, ".!?,")) / (len(text) + 1) * 10
        return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BlockLabeller:
    """A bidirectional LSTM with one logistic output for each block."""

    def __init__(self, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = {}
        for d in "fb":
            self.w[d + "x"] = rng.normal(0, 0.1, (FEATURES, 4 * hidden)).astype(np.float32)
            self.w[d + "h"] = rng.normal(0, 0.1, (hidden, 4 * hidden)).astype(np.float32)
            self.w[d + "b"] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)
        self.w["o"] = rng.normal(0, 0.1, (2 * hidden, 1)).astype(np.float32)
        self.w["ob"] = np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, live: np.ndarray, trace: list | None) -> np.ndarray:
        """Hidden states (pages, blocks, hidden) in direction d; past a page's end the state stands still."""
        pages, steps, _ = x.shape
        n = self.h
        z = x @ self.w[d + "x"] + self.w[d + "b"]
        h = np.zeros((pages, n), np.float32)
        c = np.zeros((pages, n), np.float32)
        out = np.zeros((pages, steps, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[:, t] + h @ self.w[d + "h"]
            gates = _sigmoid(g[:, : 3 * n])
            i, f, o, u = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(g[:, 3 * n :])
            m = live[:, t : t + 1]
            new = f * c + i * u
            squashed = np.tanh(new)
            if trace is not None:
                trace.append((t, h, c, i, f, o, u, squashed, m))
            c = np.where(m, new, c)
            h = np.where(m, o * squashed, h)
            out[:, t] = h
        return out

    def scores(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run("f", x, live, None), self._run("b", x, live, None)], axis=2)
        return _sigmoid(both @ self.w["o"] + self.w["ob"])[:, :, 0]

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        traces = {"f": [], "b": []}
        hs = {d: self._run(d, x, live, traces[d]) for d in "fb"}
        both = np.concatenate([hs["f"], hs["b"]], axis=2)
        p = _sigmoid(both @ self.w["o"] + self.w["ob"])[:, :, 0]
        dz = ((p - y) * live / max(1, live.sum()))[:, :, None].astype(np.float32)
        grad = {"o": np.einsum("pth,pto->ho", both, dz), "ob": dz.sum((0, 1))}
        dboth = dz @ self.w["o"].T
        n = self.h
        for k, d in enumerate("fb"):
            wh = self.w[d + "h"]
            gx, gh, gb = np.zeros_like(self.w[d + "x"]), np.zeros_like(wh), np.zeros_like(self.w[d + "b"])
            dh = np.zeros((len(x), n), np.float32)
            dc = np.zeros((len(x), n), np.float32)
            for t, h0, c0, i, f, o, u, squashed, m in reversed(traces[d]):
                dh = dh + dboth[:, t, k * n : (k + 1) * n]
                a, b = np.where(m, dh, 0), np.where(m, dc, 0)
                b = b + a * o * (1 - squashed**2)
                dg = np.concatenate([b * u * i * (1 - i), b * c0 * f * (1 - f), a * squashed * o * (1 - o), b * i * (1 - u**2)], axis=1)
                gx += x[:, t].T @ dg
                gh += h0.T @ dg
                gb += dg.sum(0)
                dh = np.where(m, dg @ wh.T, dh)
                dc = np.where(m, b * f, dc)
            grad |= {d + "x": gx, d + "h": gh, d + "b": gb}
        return grad

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 8, batch: int = 32, rate: float = 0.02, hide: float = 0.1, seed: int = 4) -> BlockLabeller:
        rng = np.random.default_rng(seed)
        one = {k: np.zeros_like(v) for k, v in self.w.items()}
        two = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                x, live, y = padded([pages[i] for i in order[at : at + batch]], [labels[i] for i in order[at : at + batch]])
                x[:, :, :PATH_BITS] *= rng.random((*x.shape[:2], PATH_BITS)) >= hide
                step += 1
                for k, g in self.gradients(x, live, y).items():
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.99 * two[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def padded(pages: list[np.ndarray], labels: list[np.ndarray] | None = None):
    steps = max(map(len, pages))
    x = np.zeros((len(pages), steps, FEATURES), np.float32)
    live = np.zeros((len(pages), steps), bool)
    y = np.zeros((len(pages), steps), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], live[i, : len(p)] = p, True
        if labels is not None:
            y[i, : len(p)] = labels[i]
    return x, live, y


def invented(rng: np.random.Generator) -> str:
    return "-".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(rng.integers(1, 3)))


def strewn(read: list[list], labels: list[np.ndarray], seed: int = 6) -> tuple[list[list], list[np.ndarray]]:
    """Copies of the sampled pages with markup that the sample may lack: boilerplate blocks, of words from other blocks, among
    and inside the main text, and main blocks in further wrappers. So the labeller is not lost where a site has comments in its article."""
    rng = np.random.default_rng(seed)
    texts = [t for b in read for _, t in b]
    pages, marks = [], []
    for b, y in zip(read, labels, strict=True):
        rows = []
        for (path, text), main in zip(b, y, strict=True):
            if main and rng.random() < 0.3:
                path = path[:-1] + STREWN_IN[rng.integers(len(STREWN_IN))]
            if rng.random() < 0.15:  # a name that says nothing
                path = (*path[:-1], "div", f".{invented(rng)}", *path[-1:])
            rows.append((path, text, main))
        stems = [p[:-1] for p, _, m in rows if m] + [("html", "body")]
        for _ in range(rng.integers(1, 5)):
            at = rng.integers(len(rows) + 1)
            path = STREWN_OUT[rng.integers(len(STREWN_OUT))]
            if rng.random() < 0.4:
                path = (*path[:-1], LEAVES[rng.integers(len(LEAVES))])
            some = [(stems[rng.integers(len(stems))] + path, texts[rng.integers(len(texts))], 0.0)] * rng.integers(1, 4)
            rows[at:at] = some
        pages.append([(p, t) for p, t, _ in rows])
        marks.append(np.array([m for _, _, m in rows], np.float32))
    return pages, marks


def windows(page: list, size: int, most: int, rng: np.random.Generator) -> list[list]:
    """The page in windows of at most ``size`` blocks; of more than ``most`` windows, so many taken at random."""
    cut = [page[at : at + size] for at in range(0, len(page), size)]
    return cut if len(cut) <= most else [cut[k] for k in sorted(rng.choice(len(cut), most, replace=False))]


def train(pages: DataFrame, html_col: str = "html", train_pages: int = 400, seed: int = 9, long_page: int = 400) -> BlockLabeller | None:
    """A labeller from about ``train_pages`` pages of the table, long ones in windows of ``long_page`` blocks; None if the table holds no block."""
    rows = pages.where(F.col(html_col) != "").select(F.col(html_col).alias("html"), F.xxhash64(html_col, F.lit(seed)).alias("at"))
    n = rows.count()
    most = max(1, train_pages // max(1, n))  # windows a page, so that the windows are bounded as the pages are
    def cut(batches):
        """(at, windows and whether the page has main-text markup) of the pages that hold a block."""
        for pdf in batches:
            for at, h in zip(pdf["at"], pdf["html"], strict=True):
                if page := blocks(h):
                    marked = any(MAIN.intersection(p) for p in {p for p, _ in page})
                    few = windows(page, long_page, most, np.random.default_rng((seed, at % (1 << 32))))
                    yield pd.DataFrame({"at": [at], "windows": [pickle.dumps((marked, few))]})

    def learn(sample: DataFrame) -> list:
        few = sample.select("at", "html").mapInPandas(cut, "at long, windows binary").orderBy("at").limit(2 * train_pages)
        return [pickle.loads(r.windows) for r in few.collect()]

    pages_read = learn(rows.where(F.pmod("at", F.lit(1_000_000)) < int(1_000_000 * train_pages / max(train_pages, n))) if n > train_pages else rows)
    if not pages_read and n > train_pages:  # a sample of empty pages: whichever pages hold a block
        pages_read = learn(rows)
    held = Counter(t for _, few in pages_read for t in {t for w in few for _, t in w})
    often = max(3, len(pages_read) // 20)
    read = [w for _, few in pages_read for w in few]
    labels = [np.array([teacher(p, marked, held[t] >= often) for p, t in w], np.float32) for marked, few in pages_read for w in few]
    if not read:
        return None
    hasher = Hasher()
    more, marks = strewn(read, labels)
    return BlockLabeller().fit([hasher.vectors(b) for b in read + more], labels + marks, epochs=max(6, 2400 // len(read)))


def label(model: BlockLabeller, pages: list[list], hasher: Hasher, budget: int = 40_000) -> list[np.ndarray]:
    """Main-text verdicts for the blocks of each page; pages of like length are padded together, ``budget`` cells at a time."""
    out: list = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto + 1 - at) * len(pages[order[upto]]) <= budget:
            upto += 1
        group = order[at:upto]
        x, live, _ = padded([hasher.vectors(pages[i]) for i in group])
        p = model.scores(x, live)
        for k, i in enumerate(group):
            out[i] = p[k, : len(pages[i])] >= 0.5
        at = upto
    return out


def extract(pages: DataFrame, html_col: str = "html", model: BlockLabeller | None = None, batch: int = 500, **training) -> DataFrame:
    """pages with ``text`` and ``n_chars``."""
    model = model or train(pages, html_col, **training)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def task():
        hasher = Hasher()

        def work(htmls: list) -> dict[str, list]:
            texts: list[str] = []
            for at in range(0, len(htmls), batch):
                read = [blocks(h) for h in htmls[at : at + batch]]
                verdicts = label(sent.value, read, hasher) if sent.value else [[]] * len(read)
                texts += ["\n\n".join(t for (_, t), main in zip(b, v, strict=False) if main) for b, v in zip(read, verdicts, strict=True)]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_texts(pages, html_col, task, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
