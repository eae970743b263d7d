"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags. Each block has features of its open ancestors
(tags and words of class, id and role) and of its text; a chain over the two labels "main" and "other" is trained on
labelled pages and decoded by Viterbi. Scripts, styles, comments, the head, lists of options, templates and noscript are
never blocks; they end as HTML has it, also where their end tag is left out.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tags that begin or end a block, tags without an end, and tags whose content is no text.
BLOCK = frozenset("head address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags of elements whose content isn't shown, and the tags that can stand in a head or in a list of options without ending it.
UNSHOWN = frozenset("head select template noscript".split())
IN_HEAD = frozenset("html head base link meta title script style noscript template".split())
IN_SELECT = frozenset("option optgroup hr".split())
CONTROLS = frozenset("input textarea select".split())
#: An end tag of these is implied where another of them begins inside.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Comments, raw elements (a script or style without an end goes on to the page's, others to the next tag), declarations, tags.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(textarea|title|iframe)\b[^>]*>(?:.*?</\2\s*>|[^<]*)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none", re.I)
WHITE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?]")


def leaf_blocks(page: str) -> list[tuple[str, frozenset[str], float]]:
    """Blocks of a page in order: text with one blank for each run of white space, ancestor features, and the share of
    its characters inside links. Blocks without text are left out.

    Broken markup is read as far as it goes. A head ends at its first tag or text that can't stand in one, options end at
    the first other block or control, and an element that shows nothing ends with the element around it, so that a left-out
    end tag doesn't hide the page. An unclosed title, textarea or iframe ends at the next tag, an unclosed script or style
    at the page's end.
    """
    stack: list[tuple[str, frozenset[str]]] = []
    blocks, parts, linked, in_link, unshown = [], [], 0, 0, 0
    context: frozenset[str] = frozenset()

    def close() -> None:
        nonlocal linked
        text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            blocks.append((text, context, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal context, in_link, unshown
        del stack[i:]
        context = frozenset().union(*(names for _, names in stack)) if stack else frozenset()
        in_link = sum(tag == "a" for tag, _ in stack)
        unshown = sum(tag in UNSHOWN for tag, _ in stack)

    def end(name: str, unless: str = "") -> None:
        """End the innermost open element of that name, if there is one and none called unless is open inside it."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                pop_to(i)
            if stack[i : i + 1] == [] or stack[i][0] == unless:
                return

    def add(text: str) -> None:
        nonlocal linked
        if unshown and stack[-1][0] == "head" and not text.isspace():
            end("head")
        if not unshown:
            parts.append(text)
            linked += len(text) if in_link else 0

    at = 0
    for m in TOKEN.finditer(page):
        if at < m.start():
            add(page[at : m.start()])
        at = m.end()
        tag = (m[4] or m[2] or "").lower()
        begins = bool(tag) and not m[3]
        if begins and unshown:
            if tag not in IN_HEAD:
                end("head", "template")
            if tag in CONTROLS or (tag in BLOCK and tag not in IN_SELECT):
                end("select", "template")
        if not tag or m[2]:
            continue
        if tag == "br":
            add(" ")
        if tag in BLOCK:
            close()
        if m[3]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if stack[i][0] in ("table", "ul", "ol", "article", "main", "body") and tag not in ("body", "html"):
                    break
        elif tag not in VOID and not m[5].endswith("/"):
            if tag in CLOSES:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CLOSES[tag]:
                        pop_to(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
            names = {f"tag={tag}"}
            for k, *values in NAMES.findall(m[5]):
                words = [w for w in re.split(r"[^a-z0-9]+", "".join(values).lower()) if w]
                names.update(f"{k.lower()}={w}" for w in words)
                names.update(f"name={w}" for w in words)
            if UNSEEN.search(m[5]):
                names.add("hidden")
            stack.append((tag, frozenset(names)))
            context = context | names
            in_link += tag == "a"
            unshown += tag in UNSHOWN
    if at < len(page):
        add(page[at:])
    close()
    return blocks


def features(blocks: list[tuple[str, frozenset[str], float]]) -> list[list[str]]:
    """Names of the features of each block of a page."""
    out = []
    for i, (text, context, linked) in enumerate(blocks):
        marks = len(PUNCTUATION.findall(text)) / max(1, len(text))
        own = [f"in:{c}" for c in context]
        own += [f"length:{min(8, int(math.log2(len(text) + 1)))}", f"linked:{int(linked * 4)}", f"marks:{min(4, int(marks * 100))}"]
        own += ["ends" if text[-1] in ".!?\"'»)" else "open", "bias"]
        own += ["first"] if i == 0 else []
        own += ["last"] if i == len(blocks) - 1 else []
        own += ["©"] if "©" in text else []
        out.append(own)
    return out


class Chain:
    """A linear-chain CRF with labels 0 (other) and 1 (main): weights of feature names for label 1, transitions."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, pages_features: list[list[str]]) -> list[int]:
        """Viterbi: the likeliest labels of one page's blocks; label 0 has score 0."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        get, back, a, b = self.weights.get, [], 0.0, 0.0
        for k, names in enumerate(pages_features):
            s = sum(get(n, 0.0) for n in names)
            if k == 0:
                a, b = 0.0, s
                continue
            from0, from1 = (a + m00 >= b + m10), (a + m01 >= b + m11)
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + m00 if from0 else b + m10), (a + m01 if from1 else b + m11) + s
        if not pages_features:
            return []
        label = 1 if b > a else 0
        path = [label]
        for step in reversed(back):
            label = step[label]
            path.append(label)
        return path[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 250, rate: float = 1.5, decay: float = 1e-5, least: int = 2) -> Chain:
    """Maximum likelihood with an L2 penalty by full-batch Adagrad; features seen in fewer than least blocks are left out.

    pages holds (features of each block, label of each block). The gradient is taken for all pages side by side, padded
    to the longest.
    """
    pages = [p for p in pages if p[0]]
    seen: dict[str, int] = {}
    for blocks, _ in pages:
        for names in blocks:
            for n in names:
                seen[n] = seen.get(n, 0) + 1
    index = {n: i for i, n in enumerate(sorted(n for n, c in seen.items() if c >= least))}
    if not pages or not index:
        return Chain({}, np.zeros((2, 2)))
    most = max(len(b) for b, _ in pages)
    row, place, col = map(np.array, zip(*((p, k, index[n]) for p, (blocks, _) in enumerate(pages) for k, names in enumerate(blocks) for n in names if n in index)))
    there = np.array([[k < len(b) for k in range(most)] for b, _ in pages])
    gold = np.zeros(there.shape, int)
    gold[there] = [y for _, ys in pages for y in ys]
    both = there[:, 1:]
    w, t = np.zeros(len(index)), np.zeros((2, 2))
    gw, gt = np.full(len(index), 1e-8), np.full((2, 2), 1e-8)
    true_moves = np.array([[np.sum(both & (gold[:, :-1] == i) & (gold[:, 1:] == j)) for j in (0, 1)] for i in (0, 1)])
    for _ in range(epochs):
        s = np.zeros((*there.shape, 2))
        np.add.at(s[:, :, 1], (row, place), w[col])
        fore, back = np.zeros_like(s), np.zeros_like(s)
        fore[:, 0] = s[:, 0]
        for k in range(1, most):
            step = np.logaddexp(fore[:, k - 1, 0, None] + t[0], fore[:, k - 1, 1, None] + t[1]) + s[:, k]
            fore[:, k] = np.where(there[:, k, None], step, fore[:, k - 1])
        for k in range(most - 2, -1, -1):
            ahead = s[:, k + 1] + back[:, k + 1]
            step = np.logaddexp(t[:, 0] + ahead[:, 0, None], t[:, 1] + ahead[:, 1, None])
            back[:, k] = np.where(there[:, k + 1, None], step, 0.0)
        total = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        p1 = np.where(there, np.exp(fore[:, :, 1] + back[:, :, 1] - total[:, None]), 0.0)
        moves = fore[:, :-1, :, None] + t + (s + back)[:, 1:, None, :] - total[:, None, None, None]
        moves = np.where(both[:, :, None, None], np.exp(np.minimum(moves, 0.0)), 0.0).sum((0, 1))
        grad = np.bincount(col, (gold - p1)[row, place], len(index)) / len(pages) - decay * w
        move = (true_moves - moves) / len(pages) - decay * t
        gw, gt = gw + grad * grad, gt + move * move
        w, t = w + rate * grad / np.sqrt(gw), t + rate * move / np.sqrt(gt)
    return Chain({n: float(w[i]) for n, i in index.items()}, t)


#: Page parts that aren't the article: the tags they come in and the words that name them in class, id or role.
PARTS = {
    "header": ("header div", "header masthead banner top branding logo"),
    "menu": ("nav div ul", "nav menu navbar navigation breadcrumb breadcrumbs pagination"),
    "side": ("aside div section", "sidebar aside side related widget popular recommended trending"),
    "notice": ("div section dialog", "cookie notice cookies consent banner alert modal popup warning message"),
    "advert": ("div section aside", "ad ads advert advertisement adsbygoogle sponsored sponsor promo promotion"),
    "form": ("form div fieldset", "form search newsletter subscribe signup login contact poll"),
    "comments": ("section div ol", "comments comment reply replies responses discussion respond"),
    "share": ("div ul", "share social sharing tags meta byline"),
    "hidden": ("div section", ""),
    "footer": ("footer div", "footer bottom copyright colophon legal contentinfo"),
}
#: Around the article, and around the whole page with its other parts.
WRAPS = ("<article>{}</article>", "{}", "<main>{}</main>", "<main><article>{}</article></main>", "<div>{}</div>", "<section>{}</section>", "<div class='content'>{}</div>", "<div class='post-body entry'>{}</div>", "<div id='main' class='article story text'>{}</div>")
OUTER = ("{}", "<body>{}</body>", "<div class='wrapper container'>{}</div>", "<div id='page'>{}</div>")


def templates(pages: int = 500, seed: int = 5) -> list[tuple[list[list[str]], list[int]]]:
    """A fixed number of made-up labelled pages for parts that a labelled crawl may lack: headers, menus, sidebars,
    notices, adverts, forms and reader comments around or inside articles of several shapes, in texts of all lengths."""
    rng = random.Random(seed)
    say = lambda: "".join(rng.choice(("This is a sentence that goes on for a while, with clauses, and then ends. ", "One with few marks goes on and on. ", "Another one has no mark before it comes to its end. ", "A much longer one goes on without any mark for as long as it can and then a little longer until there is nothing left to say. ", "A short one. ", "Is it? ")) for _ in range(rng.choice((1, 1, 2, 3, 6)))).strip()
    few = lambda: " ".join(rng.choice(("News", "Home", "More", "A word", "Section")) for _ in range(rng.randint(1, 4)))
    link = lambda t: f"<a href='/x'>{t}</a>"

    def part(kind: str) -> str:
        tags, words = (x.split() for x in PARTS[kind])
        tag = rng.choice(tags)
        named = ""
        if not words:
            named = rng.choice((" hidden", " style='display:none'"))
        elif tag in ("div", "section", "ul", "ol") or rng.random() < 0.5:
            named = f" {rng.choice(('class', 'class', 'id', 'role'))}='{'-'.join(rng.sample(words[:2] * 3 + words, rng.choice((1, 1, 2))))}'"
        item = "li" if tag in ("ul", "ol") else rng.choice(("p", "div", "p"))
        if kind in ("menu", "share") or (kind in ("side", "header", "footer") and rng.random() < 0.4):
            inside = "".join(f"<{rng.choice((item, 'li'))}>{link(few())}</li>" for _ in range(rng.randint(1, 5))) if rng.random() < 0.7 else link(few())
        elif kind == "comments":
            inside = "".join(f"<{item} class='comment'>{say()}</{item}>" if rng.random() < 0.5 else f"<{item}>{say()}</{item}>" for _ in range(rng.randint(1, 3)))
        elif kind == "form":
            inside = rng.choice((f"<p>{say()}</p>", f"<label>{few()}</label>", "")) + rng.choice((f"<button>{few()}</button>", f"<label>{few()}</label><input>", f"<p>{say()}</p>"))
        else:
            inside = rng.choice((say(), f"<{item}>{say()}</{item}>", f"<{item}>{say()}</{item}><{item}>{say()}</{item}>", "&copy; " + few() if kind == "footer" else few()))
        head = rng.choice(("h1", "h2", "h3", "h4"))
        title = f"<{head}>{few()}</{head}>" if rng.random() < 0.3 else ""
        return f"<{tag}{named}>{title}{inside}</{tag}>"

    def article() -> list[str]:
        mark = lambda t: f"\x01{t}"
        shapes = [
            lambda: f"<h2>{mark(few())}</h2>", lambda: f"<h3>{mark(few())}</h3>", lambda: f"<ul><li>{mark(few())}</li><li>{mark(say())}</li></ul>", lambda: f"<blockquote>{mark(say())}</blockquote>",
            lambda: f"<table><tr><td>{mark(few())}</td><td>{mark(say())}</td></tr></table>", lambda: f"<figure><figcaption>{mark(few())}</figcaption></figure>", lambda: f"<pre>{mark(few())}</pre>",
            lambda: f"<div>{mark(say())}</div>", lambda: f"<p>{mark(link(say()))}</p>", lambda: f"<p>{mark(say())} {link(few())} {say()}</p>",
        ]
        body = [f"<h1>{mark(few())}</h1>"] if rng.random() < 0.7 else []
        return body + [rng.choice(shapes)() if rng.random() < 0.35 else f"<p>{mark(say())}</p>" for _ in range(rng.randint(1, 7))]

    some = lambda kinds, most: "".join(map(part, rng.sample(kinds, rng.randint(0, most))))
    found = []
    for _ in range(pages):
        body = article()
        for _ in range(rng.choice((0, 1, 1, 2))):
            body.insert(rng.randint(1, len(body)), part(rng.choice(("side", "advert", "form", "notice", "comments", "share", "hidden", "footer", "menu"))))
        around = some(["header", "menu", "notice", "advert"], 3), some(["comments", "side", "form", "advert", "share", "notice"], 3) + some(["footer"], 1)
        blocks = leaf_blocks(rng.choice(OUTER).format(around[0] + rng.choice(WRAPS).format("".join(body)) + around[1]))
        clean = [(t.replace("\x01", "").strip(), c, linked) for t, c, linked in blocks]
        found.append((features(clean), [int("\x01" in t) for t, _, _ in blocks]))
    return found


def labelled(page: str, text: str) -> tuple[list[list[str]], list[int]] | None:
    """Features and labels of a page whose document is known: blocks that the document's text holds are main. None for
    pages that share less than half of the document, which may have been taken from something else."""
    blocks = leaf_blocks(page)
    squeeze = lambda t: WHITE.sub(" ", t).strip()
    lines = {squeeze(x) for x in text.split("\n")}
    whole = squeeze(text)
    # a short block counts only as a whole line or as how the text begins: common words occur anywhere
    labels = [int(t in lines or whole.startswith(t) or (len(t) >= 80 and t in whole)) for t, _, _ in blocks]
    shared = sum(len(t) for (t, _, _), y in zip(blocks, labels) if y)
    return (features(blocks), labels) if shared >= len(whole) / 2 and whole else None


def labelled_sample(pages: DataFrame, documents: DataFrame, sample: int, sample_bytes: int) -> DataFrame:
    """(page_id, html, text) of at most sample pages whose doc_id documents holds, first by a hash of the page, as long as
    the pages have sample_bytes together, and their texts too.

    The same tables give the same rows, however they are dealt out: of several pages of one id, or several texts of one
    document, the one with the smallest hash counts. Null ids of documents, pages and texts take no part; a null page_id is one id.
    """
    place = [F.xxhash64("page_id"), F.col("page_id")]
    so_far = lambda column, *more: F.sum(F.octet_length(column).cast("long")).over(Window.orderBy(*place, *more).rowsBetween(Window.unboundedPreceding, 0))
    ties = [F.xxhash64("html"), F.col("doc_id"), F.col("html")]
    named = pages.select("page_id", "doc_id", "html").where(F.col("doc_id").isNotNull() & (F.octet_length("html") <= sample_bytes))
    chosen = named.orderBy(*place, *ties).limit(sample).withColumn("so_far", so_far("html", *ties)).where(F.col("so_far") <= sample_bytes)
    texts = documents.select("doc_id", "text").where(F.octet_length("text") <= sample_bytes)
    pairs = texts.join(F.broadcast(chosen.drop("so_far")), "doc_id")
    one = pairs.groupBy("page_id").agg(F.min_by(F.struct("html", "text"), F.struct(F.xxhash64("html"), "html", F.xxhash64("text"), "text")).alias("first")).select("page_id", "first.*")
    return one.withColumn("so_far", so_far("text")).where(F.col("so_far") <= sample_bytes).drop("so_far")


def fit(pages: DataFrame, documents: DataFrame, sample: int = 1000, sample_bytes: int = 32 << 20) -> Chain:
    """A chain from templates() and the labelled_sample() of pages (page_id, doc_id, html) and documents (doc_id, text).
    The bounds are on what the driver takes in; pages of any length train, up to sample_bytes."""
    rows = labelled_sample(pages, documents, sample, sample_bytes).orderBy("page_id").collect()
    made = [labelled(r["html"], r["text"]) for r in rows]
    return train([m for m in made if m] + templates())


def extract(pages: DataFrame, chain: Chain) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html): blocks labelled main, joined by line
    ends; empty text and 0 for null or empty pages and for pages without such blocks. Repeated rows come out as often, an
    empty table gives an empty one, and other columns of whatever name are left aside."""
    shared = pages.sparkSession.sparkContext.broadcast(chain)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                out = []
                for page in part.column("html").to_pylist():
                    blocks = leaf_blocks(page or "")
                    out.append("\n".join(b[0] for b, y in zip(blocks, shared.value.decode(features(blocks))) if y))
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(texts, "page_id long, url string, text string, n_chars long")
