"""Main text of web pages by wrapper induction.

A page is parsed to a tree of blocks, without the parts whose markup says what they
are (menus, footers, adverts, forms, scripts, comments); where a page marks its article, that element is its tree. The trees
of a host's pages are aligned, in groups of bounded size, by simple tree matching: nodes match under equal labels, weighted by
how much of their subtrees matches in turn, and by texts they share. Each page is aligned with those
that share most blocks with it, so that pages of one section meet, but for near copies: two
pages whose own blocks are mostly the same words say nothing of the template. Blocks with equal text in both are
votes for template, blocks with another text or without a partner votes for content;
votes are summed over the host, and blocks that are constant more often than not go as template. A page that marks its
article says itself what varies, so inside a mark an exact check follows: such a block goes only if most of the host's
different marked pages have it, as passages that some articles share are content.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .scratch import Scratch
from .words import mix, window_hashes, word_hashes

#: Cells of an alignment table held at once; larger ones are halved, to the same result.
CELLS = 4_000_000
#: Array elements up to which the templates of all hosts are broadcast: 8 bytes each.
BROADCAST_SIGS = 2_000_000
#: Different pages of a host, at least, that have a block of the template inside their marked article.
MARKED_PAGES = 4
#: Elements without content of their own, elements that are never article text, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head nav footer aside form button select textarea iframe svg canvas object audio video dialog menu".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What an open element is closed by, as browsers do it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
# Class, id and role names, as whole names, of page parts that are not the article.
NOT_CONTENT = frozenset(
    "ad ads advert adverts advertisement advertising ad-slot ad-container banner sponsor sponsored promo promotion nav navbar navigation nav-menu main-navigation menu breadcrumb breadcrumbs sidebar aside complementary footer site-footer page-footer contentinfo site-header page-header "
    "cookie cookies cookie-banner cookie-notice consent notice notices popup modal newsletter subscribe signup login share sharing share-buttons social social-share related related-posts recommended pagination pager post-navigation widget toolbar search search-form form skip skip-link".split()
)
REPLIES = frozenset("comment comments comment-body comment-list comments-area comment-respond reply replies respond disqus disqus_thread".split())
_TEXT_OF = re.compile(r"\s+")


class Blocks(HTMLParser):
    """Collects a page's text blocks and the block elements around them, in linear space."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, int]] = []  # tag, how it is dropped, element
        self.count: Counter = Counter()  # open elements by tag
        self.labels: list[str] = [""]  # of elements and texts, in the order of the page
        self.parents: list[int] = [0]
        self.out: list[tuple[int, str, bool]] = []  # node, text, whether in an article
        self.buffer: list[str] = []
        self.gone = Counter()
        self.saved: list[int] = []
        self.inside = self.element = 0

    @property
    def dropped(self) -> bool:
        """Whether the place read at is not content."""
        return bool(self.gone["hard"] or self.gone["named"] or self.gone["reply"])

    def flush(self) -> None:
        """End the block that is being read."""
        if self.buffer:
            text = _TEXT_OF.sub(" ", "".join(self.buffer)).strip()
            self.buffer.clear()
            if text:
                self.labels.append("#text")
                self.parents.append(self.element)
                self.out.append((len(self.labels) - 1, text, self.inside > 0))

    def pop(self) -> None:
        """Close the innermost element."""
        tag, drop, element = self.open.pop()
        if tag in BLOCKS:
            if not self.dropped:
                self.flush()
            self.element = element
        self.count[tag] -= 1
        self.gone[drop] -= 1
        if tag in ("article", "main"):
            self.inside -= 1
            self.gone["named"] = self.saved.pop()

    def unwind(self, depth: int) -> None:
        """Close all elements above a depth."""
        while len(self.open) > depth:
            self.pop()

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if not self.dropped:
                if tag == "hr":
                    self.flush()
                else:
                    self.buffer.append(" ")
            return
        if tag in CLOSES and any(self.count[t] for t in CLOSES[tag]):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in SCOPES[tag]:
                    break
                if self.open[k][0] in CLOSES[tag]:
                    self.unwind(k)
                    break
        if tag in BLOCKS:
            # A paragraph ends where a block begins, whatever inline elements are still open in it.
            for k in range(len(self.open) - 1, -1, -1) if self.count["p"] else ():
                if self.open[k][0] == "p":
                    self.unwind(k)
                    break
                if self.open[k][0] in BLOCKS:
                    break
            if not self.dropped:
                self.flush()
        marks = {k: v or "" for k, v in attrs}
        names = set(f"{marks.get('class', '')} {marks.get('id', '')} {marks.get('role', '')}".lower().split())
        hidden = "hidden" in marks or "display:none" in marks.get("style", "").replace(" ", "").lower() or marks.get("aria-hidden") == "true"
        drop = ""
        if tag in DROPPED or tag == "header" and not self.inside or hidden:
            drop = "hard"
        elif tag not in ("html", "body", "main") and names & REPLIES:
            drop = "reply"
        elif tag not in ("html", "body", "article", "main") and names & NOT_CONTENT or tag == "article" and names & {"ad", "advert"}:
            drop = "named"
        if tag in ("article", "main"):
            # An element is not left out for its name where the article itself stands in it.
            self.saved.append(self.gone["named"])
            self.gone["named"] = 0
            self.inside += 1
        self.open.append((tag, drop, self.element))
        self.count[tag] += 1
        self.gone[drop] += 1
        if tag in BLOCKS:
            self.labels.append(" ".join([tag, *sorted(names)]))
            self.parents.append(self.element)
            self.element = len(self.labels) - 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag and tag not in BLOCKS:
            self.pop()

    def handle_endtag(self, tag):
        if tag not in VOID and self.count[tag]:
            k = len(self.open) - 1
            while self.open[k][0] != tag:
                k -= 1
            self.unwind(k)

    def handle_data(self, data):
        if not self.dropped:
            self.buffer.append(data)


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(map(str, parts)).encode("utf-8", "replace"))


@dataclass
class Page:
    """A page's tree in the order of the page, its root first: every node's label and parent, and of each block of text its node, text and signature (path and text)."""

    labels: list[int]
    parents: list[int]
    nodes: list[int]
    texts: list[str]
    sigs: list[int]
    marked: bool


def read(html: str) -> Page:
    """The tree of a page's candidate blocks; blocks outside an article go where there is one."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.unwind(0)
    parser.flush()
    marked = any(within for *_, within in parser.out)
    texts = {node: text for node, text, within in parser.out if within or not marked}
    used = {0}
    for node in texts:
        while node not in used:
            used.add(node)
            node = parser.parents[node]
    at, path = {}, {}
    page = Page([], [], [], [], [], marked)
    for node in sorted(used):
        up = parser.parents[node]
        at[node] = len(at)
        label = _hash(parser.labels[node])
        path[node] = _hash(path.get(up, 0), label)
        page.labels.append(label)
        page.parents.append(at[up])
        if node in texts:
            page.nodes.append(at[node])
            page.texts.append(texts[node])
            page.sigs.append(_hash(path[node], texts[node]))
    return page


def sketches(texts: list[str]) -> np.ndarray:
    """Of each text, the least hashes of its word pairs (of its words, if it has one) under four orders, 16 bits each."""
    out = np.zeros((len(texts), 4), np.uint16)
    words = [t.encode("utf-8", "replace").lower().split() for t in texts]
    flat = word_hashes([w for ws in words for w in ws])
    pairs = np.concatenate([window_hashes(flat, 2), flat[-1:]])
    starts = np.cumsum([0, *map(len, words)])
    size = np.diff(starts)
    several, single = np.flatnonzero(size > 1), np.flatnonzero(size == 1)
    spans = np.column_stack([starts[several], starts[several + 1] - 1]).ravel()  # of every text, its pairs, then what is between
    for k in range(4):
        with np.errstate(over="ignore"):
            x, y = mix(pairs + np.uint64(k)), mix(flat + np.uint64(k + 9))
        if len(several):
            out[several, k] = np.minimum.reduceat(x, spans)[::2] >> np.uint64(48)
        out[single, k] = y[starts[single]] >> np.uint64(48)
    return out


class Tree:
    """A page's tree with, for every node, its children, its size, and classes of equal shape (labels only) and equal content."""

    def __init__(self, labels, parents, nodes, sigs):
        n = len(labels)
        self.labels, self.sig = labels, dict(zip(nodes, sigs, strict=True))
        self.children: list[list[int]] = [[] for _ in range(n)]
        for node in range(1, n):
            self.children[parents[node]].append(node)
        self.parents, self.depth = parents, [0] * n
        for node in range(1, n):
            self.depth[node] = self.depth[parents[node]] + 1
        self.size, self.shape, self.content = [1] * n, [0] * n, [0] * n
        for node in range(n - 1, -1, -1):
            inner = self.children[node]
            self.size[node] += sum(self.size[c] for c in inner)
            self.shape[node] = _hash(labels[node], *[self.shape[c] for c in inner])
            self.content[node] = _hash(labels[node], self.sig.get(node, 0), *[self.content[c] for c in inner])


def _row(before: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The next row of an alignment table: best totals with one more child on the left."""
    row = before.copy()
    np.maximum(row[1:], before[:-1] + weight, out=row[1:])
    return np.maximum.accumulate(row)


def ordered_matching(p: int, q: int, weight) -> list[tuple[int, int]]:
    """The heaviest order-preserving matching; ``weight(i)`` gives the weights of left child ``i`` with all right ones, 0 for no match.

    A table over ``CELLS`` cells is halved at the place where the optimum crosses its middle row, so that
    space stays linear and the result the same.
    """
    out, todo = [], [(0, p, 0, q)]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        if (b - a) * (d - c) > CELLS and b - a > 1:
            mid, ahead, back = (a + b) // 2, np.zeros(d - c + 1), np.zeros(d - c + 1)
            for i in range(a, mid):
                ahead = _row(ahead, weight(i)[c:d])
            for i in range(b - 1, mid - 1, -1):
                back = _row(back, weight(i)[c:d][::-1])
            cross = c + int((ahead + back[::-1]).argmax())
            todo += [(a, mid, c, cross), (mid, b, cross, d)]
            continue
        table = [np.zeros(d - c + 1)]
        for i in range(a, b):
            table.append(_row(table[-1], weight(i)[c:d]))
        i, j = b - a, d - c
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a + i, c + j))
    return sorted(out)


class Matcher:
    """Simple tree matching of two trees; scores of shapes are kept, so equal shapes are compared once."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b, self.known = a, b, {}

    def score(self, x: int, y: int) -> float:
        """Nodes that the best top-down matching of two subtrees pairs: 0 under unequal labels, else one and the best ordered matching of the children."""
        a, b, known = self.a, self.b, self.known
        todo = [(x, y)]
        while todo:
            u, v = todo[-1]
            key = a.shape[u], b.shape[v]
            if key in known:
                todo.pop()
            elif a.labels[u] != b.labels[v]:
                known[key] = 0.0
            elif key[0] == key[1] or not a.children[u] or not b.children[v]:
                known[key] = float(a.size[u]) if key[0] == key[1] else 1.0
            else:
                p = {a.shape[c]: c for c in a.children[u]}
                q = {b.shape[c]: c for c in b.children[v]}
                open_ = [(c, d) for s, c in p.items() for t, d in q.items() if (s, t) not in known]
                if open_:
                    todo += open_
                    continue
                weights = {s: np.array([known[s, b.shape[d]] for d in b.children[v]]) for s in p}
                row = np.zeros(len(b.children[v]) + 1)
                for c in a.children[u]:
                    row = _row(row, weights[a.shape[c]])
                known[key] = 1.0 + float(row[-1])
        return known[a.shape[x], b.shape[y]]

    def shared(self) -> dict[int, dict[int, int]]:
        """For nodes of either page: how many texts that stand once in each lie, under one path, below both."""
        once = []
        for tree in (self.a, self.b):
            seen = Counter(tree.sig.values())
            once.append({s: n for n, s in tree.sig.items() if seen[s] == 1})
        levels: dict[int, Counter] = {}
        for s in once[0].keys() & once[1].keys():
            levels.setdefault(self.a.depth[once[0][s]], Counter())[once[0][s], once[1][s]] += 1
        out: dict[int, dict[int, int]] = {}
        for depth in range(max(levels, default=0), 0, -1):
            for (n, m), k in levels.pop(depth, Counter()).items():
                out.setdefault(n, {})[m] = k
                levels.setdefault(depth - 1, Counter())[self.a.parents[n], self.b.parents[m]] += k
        return out

    def pairs(self) -> list[tuple[int, int]]:
        """Matched nodes, from the roots down. Equal subtrees count twice, and texts that both pages have once add to what holds them."""
        a, b, out, todo, shared = self.a, self.b, [], [(0, 0)], self.shared()
        while todo:
            u, v = todo.pop()
            out.append((u, v))
            p, q = a.children[u], b.children[v]
            lo = hi = 0
            while lo < min(len(p), len(q)) and a.content[p[lo]] == b.content[q[lo]]:
                lo += 1
            while hi < min(len(p), len(q)) - lo and a.content[p[-1 - hi]] == b.content[q[-1 - hi]]:
                hi += 1
            todo += [*zip(p[:lo], q[:lo], strict=True), *(zip(p[-hi:], q[-hi:], strict=True) if hi else ())]
            p, q = p[lo : len(p) - hi], q[lo : len(q) - hi]
            if p and q:
                todo += [(p[i], q[j]) for i, j in ordered_matching(len(p), len(q), self._weights(p, q, shared))]
        return out

    def _weights(self, p: list[int], q: list[int], shared: dict[int, dict[int, int]]):
        a, b = self.a, self.b
        _, first, where = np.unique(np.array([b.shape[d] for d in q], np.uint64), return_index=True, return_inverse=True)
        base = {a.shape[c]: c for c in p}
        base = {s: np.array([self.score(c, q[k]) for k in first])[where] for s, c in base.items()}
        equal: dict[int, list[int]] = {}
        for j, d in enumerate(q):
            equal.setdefault(b.content[d], []).append(j)
        at = {d: j for j, d in enumerate(q)}

        def weight(i: int) -> np.ndarray:
            plain = base[a.shape[p[i]]]
            out = plain.copy()
            for j in equal.get(a.content[p[i]], ()):
                out[j] += plain[j]
            for d, n in shared.get(p[i], {}).items():
                if d in at and plain[at[d]]:
                    out[at[d]] += n
            return out

        return weight


def independent(a: dict, b: dict) -> bool:
    """Whether two pages are different articles: over half of the characters of their own blocks, on either side, have no like block on the other.

    ``a, b``: signature to (characters, sketch) of every block.
    """
    own = [[v for s, v in x.items() if s not in y] for x, y in ((a, b), (b, a))]
    if not own[0] or not own[1]:
        return False
    x, y = (np.array([v[1] for v in side]) for side in own)
    alike = np.zeros((len(x), len(y)), bool)
    for at in range(0, len(x), 512):
        alike[at : at + 512] = (x[at : at + 512, None, :] == y).sum(axis=2) >= 2
    return all(sum(v[0] for v, ok in zip(side, found, strict=True) if not ok) * 2 > sum(v[0] for v in side) for side, found in zip(own, (alike.any(axis=1), alike.any(axis=0)), strict=True))


def _vote(pdf: pd.DataFrame, partners: int) -> pd.DataFrame:
    """Votes of one group of pages of a host: ``constant`` and ``other`` alignments of every block that is constant in any."""
    pdf = pdf.sort_values("page_id")
    blocks = [{s: (n, k) for s, n, k in zip(sigs, sizes, np.asarray(list(marks), np.int64).view(np.uint16).reshape(-1, 4), strict=True)} for sigs, sizes, marks in zip(pdf["sigs"], pdf["sizes"], pdf["sketches"], strict=True)]
    trees: dict[int, Tree] = {}
    index = {s: k for k, s in enumerate({s for b in blocks for s in b})}
    has = np.zeros((len(blocks), len(index)), np.float32)
    for i, b in enumerate(blocks):
        has[i, [index[s] for s in b]] = 1
    common = has @ has.T
    apart: dict[tuple[int, int], bool] = {}
    done, constant, other = set(), Counter(), Counter()
    columns = [list(map(list, pdf[c])) for c in ("labels", "parents", "nodes", "sigs")]
    for i in range(len(blocks)):
        met = 0
        for j in np.argsort(-common[i], kind="stable").tolist():
            if met == partners or not common[i, j]:
                break
            pair = min(i, j), max(i, j)
            if j != i and pair not in apart:
                apart[pair] = independent(blocks[i], blocks[j])
            if j == i or not apart[pair]:
                continue
            met += 1
            if pair in done:
                continue
            done.add(pair)
            for k in (i, j):
                if k not in trees:
                    trees[k] = Tree(*[c[k] for c in columns])
            a, b = trees[i], trees[j]
            same = {a.sig[u] for u, v in Matcher(a, b).pairs() if u in a.sig and a.sig[u] == b.sig.get(v)}
            constant.update(same)
            other.update((blocks[i].keys() | blocks[j].keys()) - same)
    host, marked = pdf["host"].iloc[0], pdf["marked"].iloc[0]
    return pd.DataFrame([(host, marked, s, n, other[s]) for s, n in constant.items()], columns=["host", "marked", "sig", "constant", "other"])


PARSED = "page_id bigint, url string, labels array<bigint>, parents array<int>, nodes array<int>, texts array<string>, sigs array<bigint>, sizes array<int>, sketches array<bigint>, digest bigint, marked boolean"


def parse(pages: DataFrame) -> DataFrame:
    """The tree of every page, see :class:`Page`."""
    signed = lambda xs: np.array(xs, np.uint64).view(np.int64)

    def run(batches):
        for b in slices(batches, 128):
            out: list[list] = [[] for _ in range(9)]
            found = [read(html or "") for html in b.column(2).to_pylist()]
            marks, at = sketches([t for page in found for t in page.texts]).view(np.int64).ravel(), 0
            for page in found:
                to = at + len(page.texts)
                row = (
                    signed(page.labels), page.parents, page.nodes, page.texts, signed(page.sigs), list(map(len, page.texts)),
                    marks[at:to], int(signed([_hash(*page.sigs)])[0]), page.marked,
                )
                at = to
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.bool_())
            yield pa.record_batch([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], [c.split()[0] for c in PARSED.split(", ")])

    return pages.select("page_id", "url", "html").mapInArrow(run, PARSED)


def extract(pages: DataFrame, *, group_rows: int = 64, partners: int = 3) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, blocks joined by an empty line.

    Pages are aligned with others of their host, those that mark their article with those that do, in groups of about ``group_rows`` different
    ones, each with up to ``partners`` others; a block goes as template if it was constant in more alignments than not and, inside a
    marked article, stands in over half of the host's different marked pages, ``MARKED_PAGES`` at least. Null and empty html give an empty text; pages
    without a host in their url are one host. Pages of any length and depth are read whole, in memory linear in their
    size. A box on few of a host's pages (fewer than four of a group) may be taken for content. Ties in an alignment go to the later children. Repeated rows give a row each and vote once; extra columns are
    not read; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "html")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))
    parsed = scratch.keep(parse(pages).withColumn("host", host), "blocks")
    each = parsed.filter(F.size("sigs") > 0).groupBy("host", "marked", "digest").agg(F.min("page_id").alias("page_id"), *[F.first(c).alias(c) for c in ("labels", "parents", "nodes", "sigs", "sizes", "sketches")])
    each = scratch.keep(each, "pages")
    # A few numbers per host; the pages themselves are dealt by host and group, so a large host is many tasks.
    sizes = each.groupBy("host", "marked").agg(F.count("*").alias("pages")).withColumn("groups", F.ceil(F.col("pages") / group_rows).cast("int"))
    few = sizes.count() <= 100_000
    dealt = each.join(F.broadcast(sizes) if few else sizes, ["host", "marked"]).withColumn("grp", F.pmod(F.xxhash64("digest"), F.col("groups")))
    votes = dealt.groupBy("host", "marked", "grp").applyInPandas(lambda pdf: _vote(pdf, partners), "host string, marked boolean, sig bigint, constant bigint, other bigint")
    votes = votes.groupBy("host", "marked", "sig").agg(F.sum("constant").alias("constant"), F.sum("other").alias("other"))
    votes = scratch.keep(votes.filter("constant > other").select("host", "marked", "sig"), "votes")
    inside = votes.filter("marked").select("host", "sig")
    standing = each.filter("marked").select("host", F.explode(F.array_distinct("sigs")).alias("sig"))
    if inside.count() <= BROADCAST_SIGS // 10:
        standing = standing.join(F.broadcast(inside), ["host", "sig"], "left_semi")
    standing = standing.groupBy("host", "sig").agg(F.count("*").alias("n")).join(inside, ["host", "sig"])
    most = (2 * F.col("n") > F.col("pages")) & (F.col("n") >= MARKED_PAGES)
    sure = standing.join(sizes.filter("marked"), "host").filter(most).select("host", "sig")
    templates = votes.filter("NOT marked").select("host", "sig").union(sure)
    templates = scratch.keep(templates.groupBy("host").agg(F.collect_list("sig").alias("template")), "templates")
    elements = templates.agg(F.sum(F.size("template"))).first()[0] or 0
    kept = F.filter(F.arrays_zip("sigs", "texts"), lambda x: ~F.coalesce(F.array_contains("template", x["sigs"]), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda x: x["texts"]), "\n\n")
    out = parsed.join(F.broadcast(templates) if elements <= BROADCAST_SIGS else templates, "host", "left").select("page_id", "url", text.alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
