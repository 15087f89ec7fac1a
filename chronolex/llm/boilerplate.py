"""Main body and page furniture of documents, by minimum-cut labelling of their lines.

Every non-empty line of a document is a node. Its terminal capacity is the
log-odds of a line classifier (words and form of the line) plus the evidence of
the page's markup where the page is at hand. Smoothness edges join neighbouring
lines, strongest between lines of one wrapped paragraph, and lines whose page
elements look alike (same tag and class) one after another. The maximum flow
separates furniture from main body with the least total cost.

The classifier is a logistic regression trained on lines of a bounded sample of
pages (:data:`SAMPLE_PAGES`, :data:`SAMPLE_CHARS`; those with the least hashed ids), labelled by their
markup alone: the kind of element that holds most of the page's text, kinds with
long texts, and headings are body; link lists, asides and kinds of short texts
are furniture. Words thereby carry over what markup tells on some pages to texts without any.
Nothing else is sampled; every line of every document is labelled, by all of its words.

Pages are joined to documents by key; a document is labelled by itself in one
row of work, so no page meets another.

Defined results: null and empty texts give no rows; a document without a page,
or whose page is null or plain text, is labelled by its lines alone; page text
that isn't in the document is ignored; repeated documents give repeated rows;
without any labelled page only the built-in cues speak.
"""

from __future__ import annotations

import re
import textwrap
from bisect import bisect_right
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most pages the classifier is fitted on, and most characters of them together (longer pages are left out of the sample).
SAMPLE_PAGES, SAMPLE_CHARS = 2000, 64_000_000
#: Of the sample's paragraphs every so many is also taken in the form that texts with hard line ends have, up to so many lines.
WRAP_EVERY, WRAP_LINES = 3, 6
#: Log-odds of the markup: kind of element against furniture.
MARKUP = {"list": 2.0, "short": 1.5, "long": -1.0, "heading": -1.5, "": 0.0}
#: Weights of smoothness edges.
WRAPPED, NEXT, ACROSS, ALIKE = 4.0, 0.5, 0.15, 0.4

_HTML = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|<![^>]*>|([^<]+|<)")
_CLASS = re.compile(r"class\s*=\s*[\"']?([^\"'>]*)")
_BLOCK = set("p div li ul ol td th tr table section article main nav aside footer header h1 h2 h3 h4 h5 h6 body html title head blockquote br pre form dd dt dl figure figcaption script style".split())
_HEADING = {"h2", "h3", "h4", "h5", "h6"}
_APART = {"nav", "aside", "footer"}
_SKIP = {"script", "style", "title", "head"}


class Block:
    __slots__ = ("tag", "kind", "text", "linked", "bold", "apart")

    def __init__(self, tag: str, kind: str, text: str, linked: bool, bold: bool, apart: bool):
        self.tag, self.kind, self.text, self.linked, self.bold, self.apart = tag, kind, text, linked, bold, apart


def read_page(html: str) -> list[Block]:
    """The text blocks of a page in order; unclosed and stray tags are taken as they come."""
    out: list[Block] = []
    text: list[str] = []
    tag, kind, linked, bold, apart, skip = "body", "", False, False, 0, False
    heading = False

    def flush() -> None:
        nonlocal linked, bold
        joined = " ".join(unescape("".join(text)).split())
        if joined and not skip:
            out.append(Block(tag, tag + "." + kind, joined, linked, bold or heading, apart > 0))
        text.clear()
        linked = bold = False

    for m in _HTML.finditer(html):
        close, name, attributes, words = m.groups()
        if words is not None:
            text.append(words)
            continue
        if name is None:
            continue
        name = name.lower()
        if name in _BLOCK:
            flush()
            if name in _APART:
                apart = max(0, apart + (-1 if close else 1))
            if close:
                skip = skip and name not in _SKIP
                tag, kind, heading = "after", "", False
            else:
                skip = name in _SKIP
                found = _CLASS.search(attributes)
                tag, kind, heading = name, found.group(1) if found else "", name in _HEADING
        elif not close and name == "a":
            linked = True
        elif not close and name in ("b", "strong"):
            bold = True
    flush()
    return out


def block_roles(blocks: list[Block]) -> list[str]:
    """``long, short, list, heading`` or '' of each block, from markup and lengths alone."""
    sizes: dict[str, list[int]] = defaultdict(list)
    for b in blocks:
        sizes[b.kind].append(len(b.text))
    most = max(sizes, key=lambda k: sum(sizes[k]), default="")
    body = {k for k, v in sizes.items() if k == most or len(v) > 1 and sum(v) / len(v) > 150}
    at = [i for i, b in enumerate(blocks) if b.kind in body and not b.apart]
    first, last = (at[0], at[-1]) if at else (0, -1)
    out = []
    for i, b in enumerate(blocks):
        if b.apart or b.linked and b.tag in ("li", "ul", "ol", "td"):
            out.append("list")
        elif b.kind in body:
            out.append("long")
        elif b.tag == "h1":
            out.append("")
        elif b.bold and first - 2 < i < last and len(b.text) < 120 and any(c.kind in body for c in blocks[i + 1 : i + 3]):
            out.append("heading")
        elif sum(sizes[b.kind]) / len(sizes[b.kind]) < 150:
            out.append("short")
        else:
            out.append("")
    return out


#: Tokens at the ends of a line whose order counts.
HEAD, TAIL = 14, 6
_TOKENS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]")


def features(line: str) -> list[str]:
    """Words, word pairs and form of a line; of a long one those at both ends, and apart from them the words between, once each."""
    tokens = _TOKENS.findall(line)
    between = {t.lower() for t in tokens[HEAD:-TAIL] if not t[0].isdigit()} if len(tokens) > HEAD + TAIL + 4 else set()
    tokens = tokens[:HEAD] + tokens[-TAIL:] if between else tokens
    words = ["0" if t[0].isdigit() else t.lower() for t in tokens]
    upper = sum(map(str.isupper, line)) > 0.7 * max(sum(map(str.isalpha, line)), 1)
    # in pairs a capitalised word stands for any name
    shapes = words if upper else words[:1] + ["Name" if t[0].isupper() else w for t, w in zip(tokens[1:], words[1:])]
    out = ["w:" + w for w in shapes] + [f"p:{a} {b}" for a, b in zip(shapes, shapes[1:])]
    if words:
        out += ["first:" + words[0], "first2:" + " ".join(shapes[:2]), "first3:" + " ".join(shapes[:3]), "last:" + shapes[-1], "last2:" + " ".join(shapes[-2:])]
    out += ["in:" + w for w in sorted(between)]
    size = len(line)
    out.append("size:" + ("a" if size < 12 else "b" if size < 25 else "c" if size < 45 else "d" if size < 70 else "e" if size < 100 else "f" if size < 160 else "g" if size < 300 else "h"))
    out.append("upper" if upper else "mixed")
    end = line[-1:]
    out.append("end:" + (end if not end.isalnum() else "x"))
    out.append("sentences:" + str(min(sum(line.count(x) for x in (". ", "? ", "! ")), 3)))
    return out


class Classifier:
    """Log-odds that a line is furniture."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.seen: dict[str, float] = {}

    def odds(self, line: str) -> float:
        key = re.sub(r"\d+", "0", line)
        found = self.seen.get(key)
        if found is None:
            w = self.weights
            found = max(-6.0, min(6.0, self.bias + sum([w[f] for f in features(key) if f in w])))
            if len(line) < 200:
                if len(self.seen) > 200_000:
                    self.seen.clear()
                self.seen[key] = found
        return found


#: Words that speak for furniture or body where no page taught otherwise.
CUES = {
    "w:cookies": 1.5, "w:subscribe": 1.5, "w:newsletter": 1.5, "w:copyright": 2.0, "w:©": 2.0, "w:privacy": 1.5, "w:advertisement": 1.5, "w:sponsored": 1.5, "w:share": 0.7, "w:inbox": 1.5,
    "w:sitemap": 1.5, "w:embargoed": 1.5, "w:login": 1.0, "w:menu": 1.0, "w:photo": 0.7, "w:tags": 0.7, "w:related": 0.7, "w:trending": 1.0, "w:»": 0.7, "w:|": 0.5, "size:g": -1.0, "size:h": -1.5, "end:.": -0.5, "sentences:2": -1.0, "sentences:3": -1.0,
}
CUES |= {"in:" + k[2:]: v for k, v in CUES.items() if k.startswith("w:")}


def fit(lines: list[str], furniture: list[int], rounds: int = 80, decay: float = 4.0) -> Classifier:
    """Logistic regression by full-batch steps, pulled towards :data:`CUES`."""
    sets = [sorted(set(features(re.sub(r"\d+", "0", x)))) for x in lines]
    counts = Counter(f for s in sets for f in s)
    names = sorted({f for f, n in counts.items() if n >= 3} | set(CUES))
    number = {f: i for i, f in enumerate(names)}
    prior = np.array([CUES.get(f, 0.0) for f in names])
    if not lines:
        return Classifier(dict(zip(names, prior.tolist())), -0.5)
    rows = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)])
    cols = np.array([number.get(f, -1) for s in sets for f in s])
    rows, cols = rows[cols >= 0], cols[cols >= 0]
    y = np.array(furniture, dtype=float)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    # accelerated gradient steps, scaled by each feature's bound on the curvature
    size = np.bincount(rows, minlength=len(lines)) + 1
    bound = 0.25 * np.append(np.bincount(cols, (weight * size)[rows], minlength=len(names)), (weight * size).sum()) + decay
    w = ahead = np.append(prior, 0.0)
    for k in range(rounds):
        z = np.bincount(rows, ahead[cols], minlength=len(lines)) + ahead[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.append(np.bincount(cols, error[rows], minlength=len(names)) + decay * (ahead[:-1] - prior), error.sum())
        new = ahead - grad / bound
        ahead = new + k / (k + 3) * (new - w)
        w = new
    bias, w = w[-1], w[:-1]
    return Classifier({f: round(float(v), 4) for f, v in zip(names, w) if abs(v) > 1e-3}, float(bias))


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling x (True: furniture) with the least ``sum(-odds[i] for x[i]) + sum(w for x[i] != x[j])``.

    Nodes whose own odds outweigh all their edges are settled first and pass
    their edges on as odds (this keeps the optimum); the rest is a maximum flow.
    """
    n = len(odds)
    u = list(odds)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j:
            around[i][j] = around[i].get(j, 0.0) + w
            around[j][i] = around[j].get(i, 0.0) + w
    total = [sum(a.values()) for a in around]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(u[i]) >= total[i]:
            label[i] = u[i] > 0
            for j, w in around[i].items():
                if label[j] is None:
                    u[j] += w if label[i] else -w
                    total[j] -= w
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        # source: furniture; capacities of the residual graph
        flow: dict[int, dict[int, float]] = {i: {j: w for j, w in around[i].items() if label[j] is None} for i in rest}
        source = {i: max(u[i], 0.0) for i in rest}
        sink = {i: max(-u[i], 0.0) for i in rest}
        while True:
            came: dict[int, int] = {i: -1 for i in rest if source[i] > 1e-9}
            queue, end = deque(came), None
            while queue:
                i = queue.popleft()
                if sink[i] > 1e-9:
                    end = i
                    break
                for j, c in flow[i].items():
                    if c > 1e-9 and j not in came:
                        came[j] = i
                        queue.append(j)
            if end is None:
                break
            push, i = sink[end], end
            while came[i] >= 0:
                push = min(push, flow[came[i]][i])
                i = came[i]
            push = min(push, source[i])
            source[i] -= push
            sink[end] -= push
            i = end
            while came[i] >= 0:
                flow[came[i]][i] -= push
                flow[i][came[i]] += push
                i = came[i]
        for i in rest:
            label[i] = i in came  # still reached from the source
    return [bool(x) for x in label]


_KEY = re.compile(r"[\W_]+")


def _key(text: str) -> str:
    return _KEY.sub("", text.lower())


def locate(lines: list[str], blocks: list[Block]) -> list[int]:
    """For each line the block of the page that holds its text, or -1."""
    keys = [_key(b.text) for b in blocks]
    exact: dict[str, int] = {}
    for i, k in enumerate(keys):
        exact.setdefault(k, i)
    page = "\n".join(keys)
    starts = np.concatenate([[0], np.cumsum([len(k) + 1 for k in keys])[:-1]]).tolist() if keys else []
    out, at = [], 0
    for line in lines:
        k = _key(line)
        if not k:
            out.append(-1)
        elif k in exact:
            out.append(exact[k])
        elif len(k) < 12:
            out.append(-1)
        else:
            p = page.find(k, at)
            if p < 0:
                p = page.find(k)
            if p >= 0:
                at = p
            out.append(bisect_right(starts, p) - 1 if p >= 0 else -1)
    return out


def label_lines(text: str, page: str | None, classifier: Classifier) -> list[int]:
    """Numbers of the furniture lines of a text."""
    numbered = [(i, line.strip()) for i, line in enumerate(text.split("\n"))]
    numbered = [(i, line) for i, line in numbered if line]
    if not numbered:
        return []
    lines = [line for _, line in numbered]
    odds = [classifier.odds(line) for line in lines]
    edges: list[tuple[int, int, float]] = []
    wrapped = [False] * len(lines)
    for k in range(len(lines) - 1):
        gap = numbered[k + 1][0] - numbered[k][0] > 1
        a, b = lines[k], lines[k + 1]
        if gap:
            edges.append((k, k + 1, ACROSS))
        elif len(a) >= 55 and len(a) <= 110 and a[-1] not in ".?!:;|" and (b[0].islower() or b[0].isdigit() or odds[k] < 0 and odds[k + 1] < 0) or b[0].islower() and len(a) >= 50:
            edges.append((k, k + 1, WRAPPED))
            wrapped[k + 1] = True
        else:
            edges.append((k, k + 1, NEXT))
    often = Counter(_key(re.sub(r"\d+", "0", x)) for x in lines if len(x) < 100)
    for k, line in enumerate(lines):
        if wrapped[k]:
            odds[k] = min(odds[k], 0.0) if len(line) > 40 else odds[k] * 0.3
        elif len(line) < 100 and often[_key(re.sub(r"\d+", "0", line))] > 2:
            odds[k] += 1.0  # a running head
    if page and "<" in page:
        blocks = read_page(page)
        if len(blocks) > 1:
            roles = block_roles(blocks)
            last: dict[str, int] = {}
            for k, b in enumerate(locate(lines, blocks)):
                if b < 0:
                    continue
                odds[k] += MARKUP[roles[b]]
                kind = blocks[b].kind
                if kind in last and kind != "after.":
                    edges.append((last[kind], k, ALIKE))
                last[kind] = k
    return [i for (i, _), x in zip(numbered, minimum_cut(odds, edges)) if x]


def fit_cleaned(lines: list[str], furniture: list[int]) -> Classifier:
    """:func:`fit` twice: furniture also stands in the body's own kind of element, so body labels of short
    lines that the first fit takes for furniture are turned before the second."""
    first = fit(lines, furniture)
    turned = [1 if not y and len(x) < 160 and first.odds(x) > 0.5 else y for x, y in zip(lines, furniture)]
    return fit(lines, turned)


def _training_lines(pages: list[str]) -> tuple[list[str], list[int]]:
    lines, y = [], []
    for page in pages:
        blocks = read_page(page)
        for b, role in zip(blocks, block_roles(blocks)):
            if role:
                lines.append(b.text)
                y.append(int(role in ("list", "short")))
            if role == "long" and len(b.text) > 160 and len(lines) % WRAP_EVERY == 0:
                for line in textwrap.wrap(b.text, 70 + len(b.text) % 30)[:WRAP_LINES]:
                    lines.append(line)
                    y.append(0)
    return lines, y


def train(pages: DataFrame, id_col: str = "id", raw_col: str = "raw_content", most: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> Classifier:
    """The classifier of at most ``most`` pages with markup and ``chars`` characters, those with the least hashed ids."""
    size = F.length(raw_col)
    marked, order = pages.filter(F.col(raw_col).contains("</") & (size <= chars)), F.xxhash64(F.col(id_col))
    # the numbers and sizes first (a task sends no pages), then the pages up to the last number
    least, total = None, 0
    for r in marked.select(order.alias("h"), size.alias("n")).orderBy("h").limit(most).collect():
        total += r["n"]
        if total > chars:
            break
        least = r["h"]
    if least is None:
        return fit([], [])
    sample = marked.filter(order <= least).select(F.col(raw_col).alias("raw"), order.alias("h"), size.alias("n"))
    # numbers can repeat: what the bounds say holds for the rows that are sent
    running = Window.orderBy("h", "n").rowsBetween(Window.unboundedPreceding, 0)
    sample = sample.limit(most).withColumn("total", F.sum("n").over(running)).filter(F.col("total") <= chars)
    return fit_cleaned(*_training_lines([r["raw"] for r in sample.orderBy("h", "n").collect()]))


def find_boilerplate(
    documents: DataFrame, pages: DataFrame, id_col: str = "doc_id", text_col: str = "normalized_text", page_col: str = "source_document_id", page_id: str = "id", raw_col: str = "raw_content",
    classifier: Classifier | None = None,
) -> DataFrame:
    """``id_col, line_no`` of each non-empty line outside the main body; by ``classifier``, else by one fitted on a sample of the pages."""
    classifier = classifier or train(pages, page_id, raw_col)
    model = documents.sparkSession.sparkContext.broadcast((classifier.weights, classifier.bias))
    # Only pages with markup are worth the shuffle; documents without one keep a null page and are spread by a salt.
    salt = F.when(F.col("page").isNull(), F.pmod(F.xxhash64(id_col), F.lit(4096)) + 1).otherwise(0)
    raw = pages.filter(F.col(raw_col).contains("</")).select(F.col(page_id).alias("page"), F.col(raw_col).alias("raw"))
    raw = raw.withColumn("salt", F.col("page").isNull().cast("long")).dropDuplicates(["page", "salt"])
    texts = documents.filter(F.col(text_col) != "").select(F.col(id_col), F.col(page_col).alias("page"), F.col(text_col).alias("text"))
    joined = texts.withColumn("salt", salt.cast("long")).join(raw, ["page", "salt"], "left").select(id_col, "text", "raw")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Classifier(*model.value)
        for b in batches:
            ids, numbers = [], []
            for d, text, page in zip(b[id_col], b["text"], b["raw"]):
                found = label_lines(text, page, own)
                ids += [d] * len(found)
                numbers += found
            yield pd.DataFrame({id_col: pd.Series(ids, dtype=b[id_col].dtype), "line_no": pd.Series(numbers, dtype="int32")})

    kind = documents.schema[id_col].dataType.simpleString()
    return joined.mapInPandas(run, f"{id_col} {kind}, line_no int")


def main_body(documents: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "normalized_text") -> DataFrame:
    """``id_col, text``: every document without its furniture lines."""
    gone = found.groupBy(id_col).agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains("gone", i))
    return documents.select(id_col, text_col).join(gone, id_col, "left").select(id_col, F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(F.trim(F.array_join(kept, "\n"))).alias("text"))
