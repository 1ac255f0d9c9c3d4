"""Main-text extraction: a recurrent labeller of the leaf blocks of a page.

A tokenizer in the manner of a browser (comments, raw-text elements, end tags that may be left out, broken
markup) cuts a page into its leaf blocks in page order. Each block is a vector of its tag path (element names
and the words of their class, id and role), of its hashed words and of a few figures; a bidirectional LSTM in
numpy reads all blocks of the page and labels each as main text or not.

The network is trained here: on generated pages of many layouts, whose labels are known, and on a bounded
sample of the table's own pages, labelled by the meaning of their elements. No page is cut, and all ancestors of a block count: it is labelled
with all blocks of its page in view, however many there are.

Defined cases: null html is empty and so is its text; a page without main text has an empty text; equal
pages give equal texts; markup that ends early ends its last block there; a column of the pages that is named as
the text is replaced by it.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import nets as N
from . import shared as S

#: Pages of the table (those of the least hash) and generated pages that the network is trained on.
SAMPLE_PAGES, GENERATED_PAGES = 200, 1500
#: Bytes of such a page at most, of all of them together, and words of theirs that generated pages are made of.
PAGE_BYTES, SAMPLE_BYTES, SAMPLE_WORDS = 1 << 20, 16 << 20, 5000
PATH_WIDTH, WORD_WIDTH, FIGURES, HIDDEN = 512, 32, 6, 16
WIDTH = PATH_WIDTH + WORD_WIDTH + FIGURES

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is code, a form or a stand-in for other content, not text of the page.
RAW_TAGS = frozenset("script style title textarea template iframe noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes, if it is open within the innermost of the tags given last.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Names of elements, and words of class, id and role, that tell main text from the rest.
BOILER_TAGS = frozenset("nav header footer aside form menu dialog button label select".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer footer header login menu nav navbar navigation newsletter "
    "notice pagination popup promo related respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget".split()
)


class Block:
    __slots__ = ("path", "parts", "linked", "text")

    def __init__(self, path: tuple[frozenset, str]):
        """path: the names of all open elements, and the innermost element."""
        self.path, self.parts, self.linked, self.text = path, [], 0, ""


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    words = {w.lower() for m in ATTRIBUTE.finditer(attributes) for w in NAME_WORD.findall(m[2] or m[3] or m[4] or "")} if attributes else ()
    return (tag, *("." + w for w in sorted(words)))


ROOT: tuple[frozenset, str] = (frozenset(), "")
RAW_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW_TAGS}


def opened(path: tuple[frozenset, str], names: tuple[str, ...]) -> tuple[frozenset, str]:
    """The path within one more element."""
    return (path[0] if path[0].issuperset(names) else path[0].union(names), names[0])


def blocks(page: str) -> list[Block]:
    """The leaf blocks that have text, in page order; path: the names of the open elements."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[frozenset, str]]] = []
    current: list[Block | None] = [None]
    links = 0

    def end() -> None:
        b = current[0]
        if b is not None:
            b.text = " ".join(_html.unescape("".join(b.parts)).split())
            if b.text:
                found.append(b)
        current[0] = None

    def pop_to(i: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[i:])
        del stack[i:]

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            text = m[0]
            if text[0] == "<" and len(text) > 1:
                continue
            if current[0] is None:
                current[0] = Block(stack[-1][1] if stack else ROOT)
            current[0].parts.append(text)
            if links:
                current[0].linked += len(text)
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in BLOCK_TAGS:
                end()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if stack[i][0] in BLOCK_TAGS and tag not in BLOCK_TAGS:
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW_TAGS:
            if not attributes.rstrip().endswith("/"):
                close = RAW_ENDS[tag].search(page, at)
                at = close.start() if close else size
            continue
        if tag in BLOCK_TAGS:
            end()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in BLOCK_TAGS:
                    break
        if tag in CLOSES:
            closed, within = CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closed:
                    pop_to(i)
                    break
                if stack[i][0] in within:
                    break
        if tag == "br" and current[0] is not None:
            current[0].parts.append(" ")
        if tag not in VOID_TAGS and not attributes.endswith("/"):
            stack.append((tag, opened(stack[-1][1] if stack else ROOT, _names(tag, attributes))))
            links += tag == "a"
    end()
    return found


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) * PATH_WIDTH >> 32


_paths: dict[tuple, np.ndarray] = {}


def _path_slots(path: tuple) -> np.ndarray:
    if path not in _paths:
        if len(_paths) > 50_000:
            _paths.clear()
        names = path[0] | {">" + path[1]}
        _paths[path] = np.unique(np.array([_slot(n) for n in names], np.int64))
    return _paths[path]


def vectors(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the blocks of all pages: the number of each one's path, the paths as rows of 0 and 1, and the other inputs."""
    flat = [b for page in pages for b in page]
    numbers: dict[tuple, int] = {}
    of = np.array([numbers.setdefault(b.path, len(numbers)) for b in flat], np.int64)
    paths = np.zeros((len(numbers), PATH_WIDTH), N.F4)
    for path, i in numbers.items():
        paths[i, _path_slots(path)] = 1
    x = np.zeros((len(flat), WIDTH - PATH_WIDTH), N.F4)
    if not flat:
        return of, paths, x
    texts = [b.text.encode("utf-8", "replace") for b in flat]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    start, stop, first = S.word_bounds(data, off, S.IS_TOKEN)
    n = np.diff(first)
    hashed = np.concatenate([S.word_hashes(S.LOWER[part], *S.word_bounds(part, o, S.IS_TOKEN)[:2]) for _, _, part, o in S.slices(data, off)])
    place = np.repeat(np.arange(len(flat)), n) * WORD_WIDTH + (hashed % np.uint64(WORD_WIDTH)).astype(np.int64)
    x[:, :WORD_WIDTH] = np.bincount(place, minlength=len(flat) * WORD_WIDTH).reshape(len(flat), -1) / np.maximum(n, 1)[:, None]
    row = 0
    for page in pages:
        for k, b in enumerate(page):
            raw = sum(map(len, b.parts))
            x[row, -FIGURES:] = (np.log1p(n[row]) / 4, b.linked / max(raw, 1), b.text[-1] in ".!?:;", k / len(page), np.log1p(len(page)) / 4, "©" in b.text)
            row += 1
    return of, paths, x


def dense(pages: list[list[Block]]) -> np.ndarray:
    """All inputs, a row a block: for the training pages."""
    of, paths, x = vectors(pages)
    return np.concatenate([paths[of], x], axis=1)


def padded(lengths: list[int], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(lengths)
    out, mask = np.zeros((steps, len(lengths), x.shape[1]), N.F4), np.zeros((steps, len(lengths)), N.F4)
    at = 0
    for j, n in enumerate(lengths):
        out[:n, j], mask[:n, j] = x[at : at + n], 1
        at += n
    return out, mask, np.array(lengths)


class Labeller:
    """Bidirectional LSTM over a page's blocks; logits (steps, batch)."""

    def __init__(self, rng: np.random.Generator):
        self.p = {f"{d}{k}": v for d in "fb" for k, v in N.init(rng, WIDTH, HIDDEN, 4).items()}
        for d in "fb":
            self.p[d + "b"][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"wo": (rng.standard_normal(2 * HIDDEN) / 4).astype(N.F4), "wd": np.zeros(WIDTH, N.F4), "bo": np.zeros(1, N.F4)}

    def logits(self, x: np.ndarray, mask: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p, cols = self.p, np.arange(x.shape[1])[None, :]
        turn = N.reversal(lengths, len(x))
        kf, kb = ([], []) if keep is not None else (None, None)
        xb = x[turn, cols]
        hf = N.lstm(x @ p["fwx"] + p["fb"], p["fwh"], mask, kf)
        hb = N.lstm(xb @ p["bwx"] + p["bb"], p["bwh"], mask, kb)[turn, cols]
        if keep is not None:
            keep |= {"x": x, "xb": xb, "turn": turn, "cols": cols, "kf": kf, "kb": kb, "hf": hf, "hb": hb}
        return hf @ p["wo"][:HIDDEN] + hb @ p["wo"][HIDDEN:] + x @ p["wd"] + p["bo"]

    def prepared(self, pages: list[list[Block]]) -> np.ndarray:
        """What the layers make of each block's inputs: both directions' gates and the direct term. Each path is multiplied once."""
        p = self.p
        w = np.concatenate([p["fwx"], p["bwx"], p["wd"][:, None]], axis=1)
        of, paths, x = vectors(pages)
        return (paths @ w[:PATH_WIDTH])[of] + x @ w[PATH_WIDTH:]

    def answers(self, ready: np.ndarray, mask: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """logits from the padded rows of ``prepared``."""
        p, turn, cols = self.p, N.reversal(lengths, len(ready)), np.arange(ready.shape[1])[None, :]
        wide = 4 * HIDDEN
        hf = N.lstm(ready[:, :, :wide] + p["fb"], p["fwh"], mask)
        hb = N.lstm(ready[:, :, wide : 2 * wide][turn, cols] + p["bb"], p["bwh"], mask)[turn, cols]
        return hf @ p["wo"][:HIDDEN] + hb @ p["wo"][HIDDEN:] + ready[:, :, -1] + p["bo"]

    def gradients(self, dlogit: np.ndarray, k: dict) -> dict[str, np.ndarray]:
        p, g = self.p, {}
        g["wo"] = np.concatenate([np.einsum("tb,tbh->h", dlogit, k["hf"]), np.einsum("tb,tbh->h", dlogit, k["hb"])])
        g["wd"], g["bo"] = np.einsum("tb,tbh->h", dlogit, k["x"]), dlogit.sum(keepdims=True).reshape(1)
        df, g["fwh"] = N.lstm_back(dlogit[:, :, None] * p["wo"][:HIDDEN], p["fwh"], k["kf"])
        db, g["bwh"] = N.lstm_back((dlogit[:, :, None] * p["wo"][HIDDEN:])[k["turn"], k["cols"]], p["bwh"], k["kb"])
        for d, dz, x in (("f", df, k["x"]), ("b", db, k["xb"])):
            g[d + "wx"], g[d + "b"] = np.einsum("tbi,tbo->io", x, dz, optimize=True), dz.sum(axis=(0, 1))
        return g

    def label(self, pages: list[list[Block]], most: int = 4096) -> list[list[bool]]:
        """Whether each block is main text. Pages of like length run together; padding stays under ``most`` steps."""
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        out: list[list[bool]] = [[] for _ in pages]
        group: list[int] = []
        for i in [*order, None]:
            if group and (i is None or len(pages[i]) * (len(group) + 1) > most):
                own = [pages[j] for j in group]
                if any(own):
                    yes = self.answers(*padded([len(b) for b in own], self.prepared(own))) > 0
                    for c, j in enumerate(group):
                        out[j] = yes[: len(pages[j]), c].tolist()
                group = []
            if i is not None:
                group.append(i)
        return out


def meaning(block: Block) -> bool:
    """Teacher of the sample: within article or main, and in nothing whose name says that it is other matter."""
    names = block.path[0]
    return not names.isdisjoint({"article", "main"}) and names.isdisjoint(BOILER_TAGS) and not any(n[1:] in BOILER_WORDS for n in names if n[0] == ".")


def generated(rng: np.random.Generator, words: list[str]) -> tuple[list[Block], list[bool]]:
    """A page of random layout, as blocks and labels."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    sentence = lambda lo, hi: " ".join(pick(words) for _ in range(int(rng.integers(lo, hi)))).capitalize()
    flip = lambda p: rng.random() < p
    out: list[tuple[tuple, str, bool, bool]] = []
    boiler = sorted(BOILER_WORDS)

    def add(path: list[tuple[str, ...]], text: str, main: bool, linked: bool = False) -> None:
        out.append((tuple(path), text, main, linked))

    def other(root: list, links: bool) -> None:
        box = (pick(["nav", "header", "footer", "aside", "form", "select"]),) if flip(0.4) else ("div", "." + pick(["comments", "comment", "respond"])) if flip(0.15) else (pick(["div", "section", "ul", "p"]), *sorted({"." + pick(boiler) for _ in range(int(rng.integers(1, 3)))}))
        for _ in range(int(rng.integers(1, 7))):
            if links:
                add([*root, box, ("ul",), ("li",), ("a",)], sentence(1, 4), False, True)
            elif flip(0.5):
                add([*root, box], sentence(2, 25) + pick([".", "", "!"]), False)
            else:
                add([*root, box, (pick(["p", "div", "li", "label", "h2", "h3"]),)], sentence(1, 40) + pick([".", "", "."]), False)

    root: list[tuple[str, ...]] = [("html",), ("body",)]
    if flip(0.4):
        root += [("div", *sorted({"." + pick(["wrapper", "page", "container", "site", "layout", "x" + str(int(rng.integers(500)))])}))] * int(rng.integers(1, 4))
    for _ in range(int(rng.integers(1, 4))):
        other(root, flip(0.6))
    holder = pick([[("article",)], [("article",)], [("main",)], [("main",), ("article",)], [("div", "." + pick(["content", "main", "article", "post", "entry", "body", "story", "text"]))], [("div", ".main"), ("article", ".post")], [("section", ".content")], []])
    inside = [*root, *holder]
    if flip(0.9):
        add([*inside, (pick(["h1", "h1", "h2"]),)], sentence(1, 20), True)
    for _ in range(int(rng.integers(1, 14))):
        kind = pick(["p"] * 8 + ["li", "blockquote", "pre", "h2", "td", "figcaption"])
        path = [*inside, ("ul",), ("li",)] if kind == "li" else [*inside, ("table",), ("tr",), ("td",)] if kind == "td" else [*inside, ("figure",), (kind,)] if kind == "figcaption" else [*inside, (kind,)]
        if flip(0.2):
            path.append((pick(["b", "i", "em", "strong", "span"]),))
        add(path, sentence(1, 90) + pick([".", ".", ".", "", "!", " |"]), True)
        if flip(0.1):
            other(inside, flip(0.3))
    if flip(0.35):
        other(inside, flip(0.5))
    for _ in range(int(rng.integers(1, 4))):
        other(root, flip(0.4))
    found, labels = [], []
    for names, text, main, linked in out:
        path = ROOT
        for own in names:
            path = opened(path, own)
        b = Block(path)
        b.text, b.parts, b.linked = ("© " if not main and flip(0.2) else "") + text, [text], len(text) if linked else 0
        found.append(b)
        labels.append(main)
    return found, labels


def trained(sample: list[str], generated_pages: int = GENERATED_PAGES, epochs: int = 5, seed: int = 5) -> Labeller:
    rng = np.random.default_rng(seed)
    real = [b for b in map(blocks, sample) if b]
    words = list(islice((w for page in real for b in page for w in b.text.split()), SAMPLE_WORDS)) or ["lorem", "ipsum", "dolor", "sit", "amet"]
    pages = [(b, [meaning(x) for x in b]) for b in real] + [generated(rng, words) for _ in range(generated_pages)]
    pages = [(dense([b]), labels) for b, labels in pages]
    model = Labeller(rng)
    adam = N.Adam(model.p, 0.01)
    for epoch in range(epochs):
        adam.rate = 0.01 * 0.6**epoch
        order = rng.permutation(len(pages))
        for a in range(0, len(order), 32):
            own = sorted((pages[i] for i in order[a : a + 32]), key=lambda t: len(t[0]))
            x, mask, lengths = padded([len(b) for b, _ in own], np.concatenate([b for b, _ in own]))
            y = np.zeros_like(mask)
            for j, (_, labels) in enumerate(own):
                y[: len(labels), j] = labels
            keep: dict = {}
            z = model.logits(x, mask, lengths, keep)
            adam.step(model.gradients(((N.sigmoid(z) - y) * mask / mask.sum()).astype(N.F4), keep))
    return model


def extracted(pages: DataFrame, *, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """All columns but the html, and the main text."""
    spark = pages.sparkSession
    S.arrow_batches(spark, rows=500)
    page = pages.select(F.col(html_col).alias("h"), F.octet_length(html_col).alias("n"), F.xxhash64(html_col).alias("k")).where(F.col("n") <= PAGE_BYTES).orderBy("k", "h").limit(SAMPLE_PAGES)
    upto = F.sum("n").over(Window.orderBy("k", "h").rowsBetween(Window.unboundedPreceding, 0))  # over the sample's rows
    sample = [r[0] for r in page.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("h").collect()]
    model = spark.sparkContext.broadcast(trained(sample).p)
    rest = [c for c in pages.columns if c not in (html_col, text_col)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in rest), f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(np.random.default_rng(0))
        labeller.p = model.value
        for batch in batches:
            found = [blocks(h or "") for h in batch.column(len(rest)).to_pylist()]
            texts = ["\n\n".join(b.text for b, yes in zip(page, labels) if yes) for page, labels in zip(found, labeller.label(found))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], names=[*rest, text_col])

    return pages.select(*rest, html_col).mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    rows = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
