"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, the runs of text between block-level tags. Each has the path of tags
above it, with their classes, ids and roles, and its words; both are hashed and embedded. A
bidirectional LSTM in numpy reads a page's whole sequence of blocks and classifies each as main text or not.

It is trained here, on a bounded sample of pages. A path that names its purpose (article, nav, comments,
...) labels the block, and a host's repeated blocks are labelled as what surrounds its texts; so that the network also learns purposes that the sample lacks, and to go by a
block's neighbours and words where its path names nothing, copies of the sample's pages get further
sections of known purpose, and lose telling names at random.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import by_bytes, values

#: HTML's elements by their role in cutting blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()) | frozenset(
    "math semantics mrow mi mn mo ms mtext mspace mstyle msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mprescripts mtable mtr mtd mpadded mphantom menclose".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg annotation annotation-xml".split())
#: Those of them that don't end the block that they stand in.
RAW_INLINE = RAW - {"title", "noframes", "xmp"}
#: Raw elements of other markup, which a slash closes at once; a slash that ends an attribute's bare value doesn't.
FOREIGN = frozenset({"svg", "annotation", "annotation-xml"})
CLOSED = re.compile(r"(?<!/)/\s*\Z")
BARE_VALUE = re.compile(r"=\s*[^\s\"'=]+/\s*\Z")
#: Opening one of the first ends an open one of the second.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where a quote isn't closed to the page's end, a tag ends at the next >.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|([^>]*)(?:>|\Z))", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PIECE = re.compile(r"[A-Za-z]+")

#: Words in tags, classes, ids and roles that name a purpose, in training pages only.
MAIN = ("article", "main", "content", "post", "entry", "story", "body-text", "articlebody")
OTHER = (
    "nav", "menu", "navbar", "breadcrumb", "header", "masthead", "banner", "footer", "copyright", "aside", "sidebar", "widget", "related", "notice", "cookie", "consent", "alert",
    "ad", "ads", "advert", "advertisement", "sponsor", "promo", "form", "search", "newsletter", "subscribe", "login", "comment", "comments", "reply", "disqus", "share", "social",
)
PATHS, WORDS, NUMBERS = 512, 1024, 6
HIDDEN, EMBED = 24, 16
#: Pages to train on at most, and characters of one.
SAMPLE, SAMPLE_CHARS = 160, 60_000


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters in links) of a page's leaf blocks that have text, in order.

    A path's items are tags followed by the words of their class, id and role. Raw elements, comments and
    markup aren't text. Character references are decoded, and runs of white space are one space.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((tuple(x for _, names in stack for x in names), text, linked))
        linked = 0

    def close(names: set[str] | frozenset[str]) -> None:
        while stack and stack[-1][0] in names:
            stack.pop()

    at, links = 0, 0
    while True:
        m = TOKEN.search(page, at)
        data = page[at : m.start() if m else len(page)]
        if data:
            held.append(data)
            linked += len(data) * (links > 0)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, marks = m[2].lower(), m[3] or m[4] or ""
        if tag in FOREIGN and CLOSED.search(marks) and not BARE_VALUE.search(marks):
            continue
        if tag in RAW and not m[1]:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag not in RAW_INLINE:
                flush()
            continue
        if tag in INLINE or tag in RAW_INLINE:
            links = max(0, links + (-1 if m[1] else 1)) if tag == "a" else links
            if tag == "br":
                held.append(" ")
            continue
        flush()
        links = 0
        if m[1]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        close(ENDS.get(tag, {"p"}))
        if tag not in VOID and not marks.rstrip().endswith("/"):
            names = [p.lower() for a in NAMES.findall(marks) for p in PIECE.findall(" ".join(a))]
            stack.append((tag, (tag, *names)))
    flush()
    return out


_BUCKET: dict[str, int] = {}


def _bucket(word: str, size: int) -> int:
    if len(_BUCKET) > 200_000:
        _BUCKET.clear()
    h = _BUCKET.get(word)
    if h is None:
        h = _BUCKET[word] = zlib.crc32(word.encode())
    return h % size


Features = tuple[list[int], list[int], list[float]]


def features(path: tuple[str, ...], text: str, linked: int) -> Features:
    words = text.split(" ")
    marks = sum(text.count(c) for c in ".,;:!?")
    return (
        [_bucket(x, PATHS) for x in path], [_bucket(w, WORDS) for w in words],
        [np.log1p(len(text)) / 8, np.log1p(len(words)) / 6, min(1.0, linked / len(text)), min(1.0, 10 * marks / len(text)), float(text[-1] in ".!?…"), float(any(c in text for c in "©®·|"))],
    )


class Labeller:
    """Embedding bags, a bidirectional LSTM, and a logistic output per block."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        x, h = 2 * EMBED + NUMBERS, HIDDEN
        n = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(np.float32)
        self.p = {"path": n(PATHS, EMBED) * 5, "word": n(WORDS, EMBED) * 5, "fx": n(x, 4 * h), "fh": n(h, 4 * h), "fb": np.zeros(4 * h, np.float32), "bx": n(x, 4 * h), "bh": n(h, 4 * h), "bb": np.zeros(4 * h, np.float32), "o": n(2 * h + x, 1), "ob": np.zeros(1, np.float32)}
        for k in ("fb", "bb"):
            self.p[k][h : 2 * h] = 1

    def _bags(self, pages: list[list[Features]], steps: int):
        """Mean embeddings and numbers, (pages, steps, inputs), with what the gradient needs."""
        x = np.zeros((len(pages), steps, 2 * EMBED + NUMBERS), np.float32)
        bags = []
        for k, (table, size) in enumerate((("path", EMBED), ("word", EMBED))):
            rows = [(i, t, b[k]) for i, page in enumerate(pages) for t, b in enumerate(page) if b[k]]
            if not rows:
                bags.append(None)
                continue
            n = np.array([len(b) for _, _, b in rows])
            flat, at = np.concatenate([b for _, _, b in rows]).astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]])
            i, t = np.array([a for a, _, _ in rows]), np.array([a for _, a, _ in rows])
            x[i, t, k * EMBED : k * EMBED + size] = np.add.reduceat(self.p[table][flat], at) / n[:, None]
            bags.append((flat, n, i, t))
        for i, page in enumerate(pages):
            if page:
                x[i, : len(page), 2 * EMBED :] = [b[2] for b in page]
        return x, bags

    def _run(self, x: np.ndarray, way: str, live: np.ndarray, keep: bool):
        """One direction over (pages, steps, inputs); a page's padding leaves its state alone."""
        h = np.zeros((len(x), HIDDEN), np.float32)
        c, out, tape = h.copy(), np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        pre = x @ self.p[way + "x"] + self.p[way + "b"]
        for t in range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1):
            z = pre[:, t] + h @ self.p[way + "h"]
            i, f, o = (1 / (1 + np.exp(-np.clip(z[:, k * HIDDEN : (k + 1) * HIDDEN], -30, 30))) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = live[:, t, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep:
                tape.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c2, c)
            out[:, t] = h
        return out, tape

    def _back(self, way: str, x: np.ndarray, tape: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        dx, dh, dc = np.zeros_like(x), 0.0, 0.0
        for t, h0, c0, i, f, o, g, tc, m in reversed(tape):
            dh = dh + dout[:, t]
            dhm = np.where(m, dh, 0)
            dcm = np.where(m, dc + dhm * o * (1 - tc * tc), 0)
            dz = np.concatenate([dcm * g * i * (1 - i), dcm * c0 * f * (1 - f), dhm * tc * o * (1 - o), dcm * i * (1 - g * g)], axis=1)
            grad[way + "x"] += x[:, t].T @ dz
            grad[way + "h"] += h0.T @ dz
            grad[way + "b"] += dz.sum(axis=0)
            dx[:, t] = dz @ self.p[way + "x"].T
            dh = dz @ self.p[way + "h"].T + np.where(m, 0, dh)
            dc = np.where(m, dcm * f, dc)
        return dx

    def scores(self, pages: list[list[Features]]) -> list[np.ndarray]:
        """Probability of being main text of each block of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted(range(len(pages)), key=lambda j: len(pages[j]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at + 1) * len(pages[order[to]]) <= 8192:
                to += 1
            own = [pages[j] for j in order[at:to]]
            steps = max(1, len(own[-1]))
            live = np.arange(steps) < np.array([len(p) for p in own])[:, None]
            x, _ = self._bags(own, steps)
            z = np.concatenate([self._run(x, "f", live, False)[0], self._run(x, "b", live, False)[0], x], axis=2) @ self.p["o"] + self.p["ob"]
            for j, p, row in zip(order[at:to], own, z[:, :, 0], strict=True):
                out[j] = 1 / (1 + np.exp(-np.clip(row[: len(p)], -30, 30)))
            at = to
        return out

    def fit(self, pages: list[list[Features]], labels: list[list[int]], epochs: int = 12, batch: int = 24, rate: float = 0.01, seed: int = 6) -> None:
        """Adam on the mean log loss of blocks."""
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2, n = {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for at in range(0, len(order), batch):
                own = [pages[j] for j in order[at : at + batch]]
                y = [labels[j] for j in order[at : at + batch]]
                steps = max(map(len, own))
                live = np.arange(steps) < np.array([len(p) for p in own])[:, None]
                want = np.zeros((len(own), steps), np.float32)
                for j, v in enumerate(y):
                    want[j, : len(v)] = v
                x, bags = self._bags(own, steps)
                hf, tf = self._run(x, "f", live, True)
                hb, tb = self._run(x, "b", live, True)
                all_ = np.concatenate([hf, hb, x], axis=2)
                p = 1 / (1 + np.exp(-np.clip((all_ @ self.p["o"])[:, :, 0] + self.p["ob"], -30, 30)))
                d = np.where(live, p - want, 0).astype(np.float32) / live.sum()
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
                grad["o"], grad["ob"] = np.einsum("ntk,nt->k", all_, d)[:, None], d.sum(keepdims=True)[0]
                dall = d[:, :, None] * self.p["o"][:, 0]
                dx = dall[:, :, 2 * HIDDEN :] + self._back("f", x, tf, dall[:, :, :HIDDEN], grad) + self._back("b", x, tb, dall[:, :, HIDDEN : 2 * HIDDEN], grad)
                for k, table in enumerate(("path", "word")):
                    if bags[k]:
                        flat, size, i, t = bags[k]
                        at_word = np.argsort(flat, kind="stable")
                        first = np.flatnonzero(np.diff(flat[at_word], prepend=-1))
                        row = np.repeat(np.arange(len(size)), size)[at_word]
                        grad[table][flat[at_word][first]] += np.add.reduceat((dx[i, t, k * EMBED : (k + 1) * EMBED] / size[:, None])[row], first)
                n += 1
                for k, v in self.p.items():
                    g = np.clip(grad[k].reshape(v.shape), -1, 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    v -= (rate * (m1[k] / (1 - 0.9**n)) / (np.sqrt(m2[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)


def purpose(path: tuple[str, ...]) -> int | None:
    """1 for main text, 0 for something else, by the names on a path; None where none tells."""
    if any(x in OTHER for x in path):
        return 0
    return 1 if any(x in MAIN for x in path) else None


def repeats(cut: list[list[tuple[tuple[str, ...], str, int]]], hosts: list[str], least: int = 3) -> set[tuple[str, str]]:
    """(host, text) of blocks that stand on ``least`` or more of a host's pages: what a site puts around its articles."""
    seen = Counter((host, text) for page, host in zip(cut, hosts, strict=True) for text in {b[1] for b in page})
    return {x for x, n in seen.items() if n >= least}


def lessons(pages: list[str], hosts: list[str] | None = None, copies: int = 2, seed: int = 8) -> tuple[list[list[Features]], list[list[int]]]:
    """Training sequences with labels: the pages, and copies with sections added and names lost.

    A block whose path names no purpose is something else where its host repeats it.
    """
    r = np.random.default_rng(seed)
    cut = [blocks(p) for p in pages]
    hosts = hosts or [""] * len(pages)
    often = repeats(cut, hosts) if any(hosts) else set()
    asides = [b[1] for page in cut for b in page if purpose(b[0]) == 0] or ["Menu"]
    proses = [b[1] for page in cut for b in page if purpose(b[0]) == 1] or ["Text of a reader."]
    xs, ys = [], []

    def add(sequence: list[tuple[tuple[str, ...], str, int]], labels: list[int]) -> None:
        if sequence:
            xs.append([features(*b) for b in sequence])
            ys.append(labels)

    for page, host in zip(cut, hosts, strict=True):
        told = [(b, 0 if v is None and (host, b[1]) in often else v) for b, v in ((b, purpose(b[0])) for b in page)]
        # a page that names no main text has it in its longest blocks of prose
        if not any(v == 1 for _, v in told):
            told = [(b, v if v is not None else int(len(b[1]) > 80 and 2 * b[2] < len(b[1]))) for b, v in told]
        told = [(b, int(v or 0)) for b, v in told]
        add([b for b, _ in told], [v for _, v in told])
        for _ in range(copies):
            out: list[tuple[tuple[tuple[str, ...], str, int], int]] = []
            swap = {"article": str(r.choice(MAIN))} if r.random() < 0.5 else {}
            for b, v in told:
                path = tuple(y for x in b[0] for y in (("div", swap[x]) if x in swap else (x,)))
                out.append(((path, b[1], b[2]), v))
            for _ in range(int(r.integers(1, 4))):
                name, tag = str(r.choice(OTHER)), str(r.choice(["div", "section", "aside", "p", "li", "span"]))
                inside = r.random() < 0.4
                at = int(r.integers(0, len(out) + 1)) if inside else int(r.choice([0, len(out)]))
                above = ("html", "body", "article") if inside else ("html", "body")
                texts = [str(r.choice(proses if r.random() < 0.5 else asides)) for _ in range(int(r.integers(1, 4)))]
                out[at:at] = [(((*above, "div", name, tag), t, 0), 0) for t in texts]
            add([b for b, _ in out], [v for _, v in out])
    return xs, ys


#: Labellers of this process by a hash of what they were trained on.
_MODELS: dict[str, Labeller] = {}


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Labeller:
    """A labeller trained on at most about ``sample`` pages of at most ``chars`` characters, chosen by a
    hash of their id so that every run chooses the same.

    Null and empty pages teach nothing, nor do rows that repeat an id and page; an empty table gives the untrained
    labeller. The same sample isn't learnt twice by one process.
    """
    key = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_003))
    n = pages.count()
    fit = pages.where((F.col(html_col).isNotNull()) & (F.length(html_col) <= chars) & (key < F.lit(min(1.0, sample / max(n, 1)) * 1_000_003)))
    host = F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    rows = fit.orderBy(key, id_col, F.xxhash64(html_col)).limit(2 * sample).select(F.col(html_col).alias("page"), host.alias("host")).collect()
    rows = list(dict.fromkeys((r.page, r.host) for r in rows))
    name = hashlib.sha256("\0".join(x for r in rows for x in r).encode()).hexdigest()
    if name not in _MODELS:
        model = Labeller()
        xs, ys = lessons([r[0] for r in rows], [r[1] for r in rows])
        if xs:
            model.fit(xs, ys)
        while len(_MODELS) > 4:
            _MODELS.pop(next(iter(_MODELS)))
        _MODELS[name] = model
    return _MODELS[name]


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """Main text of every page: id and url columns, text, n_chars, n_blocks, n_main.

    Blocks that the labeller takes for main text are joined in page order by a newline. Null or empty HTML,
    or none with such blocks, gives an empty text. Rows that repeat give as many results. Other
    columns of the input aren't carried. An empty table gives an empty result.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    p = model.p

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller()
        own.p = p
        for batch in by_bytes(batches, "html", 2 << 20):
            cut = [blocks(v.decode()) for v in values(batch.column("html"))]
            scores = own.scores([[features(*b) for b in page] for page in cut])
            main = [[b[1] for b, s in zip(page, score, strict=True) if s >= threshold] for page, score in zip(cut, scores, strict=True)]
            text = ["\n".join(m) for m in main]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(text, pa.string()), *(pa.array(x, pa.int64()) for x in ([len(t) for t in text], [len(c) for c in cut], [len(m) for m in main]))], names=["key", "url", "text", "n_chars", "n_blocks", "n_main"])

    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"key {kind}, url string, text string, n_chars long, n_blocks long, n_main long").withColumnsRenamed({"key": id_col, "url": url_col})


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages)).select("page_id", "url", "text", "n_chars")


QUERIES = {"op7_html_text": op7_html_text}
ORACLE: dict[str, str] = {}
