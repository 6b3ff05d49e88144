"""Main text of web pages by wrapper inference.

Pages of one host are read as streams of tags and text and folded into a union-free regular
expression of nested groups: runs of equal groups become a repeated group, text becomes a slot, and
aligning one page's expression with the next turns groups that only one of them has into optional
groups. Structures are folded in bounded bundles, in rounds, until a host has one wrapper. Every page is
read through the slots of its host's wrapper. Which of them hold the article is decided for each page: the
groups named article or main, which are kept whole. On a page without one, a text that every page of the host has
at the same place is template and no slot, and so is a group that the wrapper repeats if half of its texts or more are.

Pages are trees in flat lists, a group's parent before it, and wrappers travel as flat lists too; what
walks them keeps its own stack, so that groups may be nested to any depth at linear cost.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Generator, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mapped, without

BUNDLE = 64
#: Different pages that a host must have before texts they all share count as its template.
TEMPLATE_PAGES = 3
#: Structures that a task remembers; more are sent again.
SEEN = 5_000
#: Wrappers of at most this many hosts are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 20_000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements whose content is no markup and no text of the page.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "select", "option", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "math", "mi", "mn", "mo", "mrow", "msup", "msub", "mfrac", "mtext", "msqrt", "mroot", "mover", "munder",
}
#: Opening one of these closes an open p.
CLOSE_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
APART = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "header", "fieldset"}
#: Of these, the ones that may stand around a whole page.
OUTER = {"form", "fieldset"}
MAIN = ("article", "main")
APART_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header footer masthead comment comments reply replies discussion disqus respond "
    "share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar widget rail skip hidden".split()
)
MAIN_WORDS = {"article", "post", "entry", "story", "content", "main", "body", "articlebody"}


def host_of(url):
    """Column: the host of a URL, in lower case without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


@lru_cache(4096)
def key_of(name: str, attributes: str) -> str:
    """The name of a group: its tag, and what class, id and role say about it."""
    words: set[str] = set()
    for a in ATTRIBUTE.finditer(attributes):
        if a[1].lower() in ("hidden", "aria-hidden"):
            if (a[2] or a[3] or a[4] or "true").lower() != "false" and a[1].lower() == "hidden":
                words.add("hidden")
            continue
        value = unescape(a[2] or a[3] or a[4] or "")
        value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()
        words |= {w for w in re.split(r"[^a-z]+", value) if w in APART_WORDS or w in MAIN_WORDS}
    return ".".join([name, *sorted(words)])


class Tree:
    """The groups of a page: key and parent by number, a parent before its children; 0 is the page itself."""

    __slots__ = ("keys", "parents", "depths", "hashes", "found")

    def __init__(self):
        self.keys, self.parents, self.depths, self.hashes = [""], [0], [0], [0]
        self.found: dict[tuple[int, str], int] = {}

    def child(self, parent: int, key: str) -> int:
        """The group of a key within a parent. A group directly within its like is the same one, so that wrappers of wrappers don't deepen the tree."""
        if parent and self.keys[parent] == key:
            return parent
        n = self.found.get((parent, key))
        if n is None:
            n = self.found[parent, key] = len(self.keys)
            self.keys.append(key)
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
            self.hashes.append(xxhash.xxh64_intdigest(key, self.hashes[parent]))
        return n


def blocks(html: str) -> tuple[Tree, list[tuple[int, str]]]:
    """(tree, [(group, text)]) of every block of text, in page order; text is trimmed and not empty."""
    tree = Tree()
    path: list[tuple[str, int]] = []
    names: Counter[str] = Counter()
    held: list[str] = []
    out: list[tuple[int, str]] = []
    at = 0

    def end_block() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((path[-1][1] if path else 0, text))

    def cut_back(i: int) -> None:
        while len(path) > i:
            names[path.pop()[0]] -= 1

    while True:
        m = TOKEN.search(html, at)
        if m is None:
            held.append(unescape(html[at:]))
            break
        if m.start() > at:
            held.append(unescape(html[at : m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name or name in INLINE:
            continue
        if name in RAW and not m[1]:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            held.append(" ")
            continue
        if name == "br" or name in VOID and name != "hr":
            held.append(" ")
            continue
        end_block()
        if name == "hr":
            continue
        if m[1]:
            # a name that is not open closes nothing
            for i in range(len(path) - 1, -1, -1) if names[name] else ():
                if path[i][0] == name:
                    cut_back(i)
                    break
                if path[i][0] in ("td", "th", "li") and name == "p":
                    break
            continue
        if name in CLOSE_P and names["p"]:
            while names["p"] and path[-1][0] != "p":
                cut_back(len(path) - 1)
            cut_back(len(path) - 1)
        if name in SIBLINGS and any(names[n] for n in SIBLINGS[name]):
            for i in range(len(path) - 1, -1, -1):
                if path[i][0] in SIBLINGS[name]:
                    cut_back(i)
                    break
                if path[i][0] in ("ul", "ol", "dl", "table"):
                    break
        path.append((name, tree.child(path[-1][1] if path else 0, key_of(name, m[3]))))
        names[name] += 1
    end_block()
    return tree, out


# A wrapper is [key, mark, children]: mark is "" (once), "?" (optional), "+" (repeated) or "*" (both);
# the key "#" is a text slot and has no children.


def structure(tree: Tree, found: list[tuple[int, str]]) -> list:
    """The expression of one page's blocks: nested groups with runs of equal groups folded."""
    root: list = ["", "", []]
    open_now: list[list] = [root]
    # the groups that open_now stands for
    open_groups: list[int] = [0]
    last = -1
    for group, _ in found:
        if group == last and group:
            # a second block in an equal group is a repetition of it
            open_now.pop()
            open_groups.pop()
        fresh, at = [], group
        while tree.depths[at] >= len(open_groups) or open_groups[tree.depths[at]] != at:
            fresh.append(at)
            at = tree.parents[at]
        del open_now[tree.depths[at] + 1 :], open_groups[tree.depths[at] + 1 :]
        for g in reversed(fresh):
            child: list = [tree.keys[g], "", []]
            open_now[-1][2].append(child)
            open_now.append(child)
            open_groups.append(g)
        if not open_now[-1][2] or open_now[-1][2][-1][0] != "#":
            open_now[-1][2].append(["#", "", []])
        last = group
    return run(folded(root))


def run(call: Generator):
    """The result of a generator that yields the calls it needs, made on a stack of its own."""
    calls, value = [call], None
    while calls:
        try:
            calls.append(calls[-1].send(value))
            value = None
        except StopIteration as end:
            calls.pop()
            value = end.value
    return value


def folded(node: list) -> Generator:
    out: list[list] = []
    for child in node[2]:
        out.append((yield folded(child)))
        for period in (1, 2, 3):  # tandem runs of groups become one repeated run
            a, b = out[-2 * period : -period], out[-period:]
            if len(a) == period and [x[0] for x in a] == [x[0] for x in b]:
                merged = []
                for x, y in zip(a, b):
                    merged.append((yield aligned(x, y)))
                for x in merged:
                    x[1] = "*" if x[1] in ("?", "*") else "+"
                out[-2 * period :] = merged
                break
    return [node[0], node[1], out]


def aligned(a: list, b: list) -> Generator:
    """The expression that covers both; a and b have the same key."""
    marks = {a[1], b[1]}
    mark = ("*" if marks & {"?", "*"} else "+") if marks & {"+", "*"} else ("?" if "?" in marks else "")
    x, y = a[2], b[2]
    out: list[list] = []
    i = j = 0
    for block in SequenceMatcher(None, [c[0] for c in x], [c[0] for c in y], autojunk=False).get_matching_blocks():
        for c in [*x[i : block.a], *y[j : block.b]]:
            out.append([c[0], "*" if c[1] in ("+", "*") else "?", c[2]])
        for k in range(block.size):
            out.append((yield aligned(x[block.a + k], y[block.b + k])))
        i, j = block.a + block.size, block.b + block.size
    merged: list[list] = []
    for c in out:  # neighbours of one kind are one repeated group
        if merged and merged[-1][0] == c[0]:
            merged[-1] = yield aligned(merged[-1], c)
            merged[-1][1] = "*" if {merged[-1][1], c[1]} & {"?", "*"} else "+"
        else:
            merged.append(c)
    return [a[0], mark, merged]


def written(wrapper: list) -> str:
    """A wrapper as a flat list of depth, key and mark of each group, from the outside in."""
    out: list = []
    todo = [(0, wrapper)]
    while todo:
        depth, (key, mark, children) = todo.pop()
        out += (depth, key, mark)
        todo += [(depth + 1, c) for c in reversed(children)]
    return json.dumps(out, separators=(",", ":"))


def read_wrapper(text: str) -> list:
    flat = json.loads(text)
    path: list[list] = []
    for depth, key, mark in zip(flat[::3], flat[1::3], flat[2::3]):
        node: list = [key, mark, []]
        del path[depth:]
        if path:
            path[-1][2].append(node)
        path.append(node)
    return path[0]


def fold(structures: list[str]) -> str:
    """One wrapper for several structures, folded in the order of their texts."""
    whole = None
    for s in sorted(structures):
        whole = read_wrapper(s) if whole is None else run(aligned(whole, read_wrapper(s)))
    return written(whole)


def _apart(key: str) -> bool:
    name, *words = key.split(".")
    return name in APART or name not in MAIN and any(w in APART_WORDS for w in words)


class Article:
    """Which groups of a page hold its article.

    The article is the outermost group named article or main; without one a group whose class or id
    says so; without that the whole body. Groups that menus, notices and the like use are left out,
    but for what groups around everything say of themselves: html, body, and those around every possible
    root and half of the text.
    """

    def __init__(self, tree: Tree, read: list[tuple[int, str]]):
        n = len(tree.keys)
        self.tree, self.chars = tree, [0] * n
        for g, t in read:
            self.chars[g] += len(t)
        self.used = [c > 0 for c in self.chars]
        for g in range(n - 1, 0, -1):
            if self.used[g]:
                self.used[tree.parents[g]] = True
        names = [k.split(".")[0] for k in tree.keys]
        says = [names[g] in MAIN or not MAIN_WORDS.isdisjoint(tree.keys[g].split(".")[1:]) for g in range(n)]
        around = self._around(names, says)
        apart, head = [False] * n, [False] * n
        for g in range(1, n):
            apart[g] = apart[tree.parents[g]] or _apart(tree.keys[g]) and g not in around
            head[g] = head[tree.parents[g]] or tree.keys[g] == "head"
        roots: list[int] = []
        for tag in MAIN:
            roots = roots or [g for g in range(1, n) if self.used[g] and names[g] == tag and not apart[g]]
        #: Whether a group is named article or main, so that nothing of it is template.
        self.named = bool(roots)
        roots = roots or [g for g in range(1, n) if self.used[g] and not MAIN_WORDS.isdisjoint(tree.keys[g].split(".")[1:]) and not apart[g]]
        inside = [False] * n
        for g in roots:
            inside[g] = True
        for g in range(1, n):
            inside[g] = inside[g] or inside[tree.parents[g]]
        left = [g for g in range(n) if self.chars[g] and not apart[g] and not head[g] and tree.keys[g] != "title"]
        self.groups = {g for g in left if inside[g]} or set(left)
        self.named = self.named and any(inside[g] for g in left)

    def _around(self, names: list[str], says: list[bool]) -> set[int]:
        tree, n = self.tree, len(names)
        hard = APART - OUTER
        worded = [g for g in range(1, n) if self.used[g] and _apart(tree.keys[g]) and names[g] not in hard]
        if not worded:
            return set()
        below_hard = [False] * n
        for g in range(1, n):
            below_hard[g] = below_hard[tree.parents[g]] or names[g] in hard
        roots = [g for g in range(1, n) if self.used[g] and says[g] and not below_hard[g]]
        held = [0 if below_hard[g] else self.chars[g] for g in range(n)]
        held_roots, above = [0] * n, [0] * n
        for g in roots:
            held_roots[g] = 1
        is_root = held_roots[:]
        for g in range(1, n):
            p = tree.parents[g]
            # roots strictly around a group that say themselves that they are apart
            above[g] = above[p] + (is_root[p] and _apart(tree.keys[p]))
        for g in range(n - 1, 0, -1):
            held[tree.parents[g]] += held[g]
            held_roots[tree.parents[g]] += held_roots[g]
        deepest = max((tree.depths[g] for g in roots), default=0)

        def outer(g: int) -> bool:
            if names[g] in ("html", "body"):
                return True
            if names[g] in OUTER and not roots:
                return 2 * held[g] >= held[0]
            # a root of the same words around g is no root that g fails to hold
            return bool(roots) and held_roots[g] + above[g] == len(roots) and deepest > tree.depths[g] and 2 * held[g] >= held[0]

        return {g for g in worded if outer(g)}


class Wrapper:
    """The slots of a wrapper and the groups it repeats, found along the path of a page's group."""

    def __init__(self, text: str):
        self.inner: list[dict[str, int]] = [{}]
        self.slot, self.again = [False], [False]
        todo = [(0, read_wrapper(text))]
        while todo:
            at, node = todo.pop()
            for key, mark, children in node[2]:
                if key == "#":
                    self.slot[at] = True
                    continue
                known = self.inner[at].get(key)
                if known is None:
                    known = self.inner[at][key] = len(self.inner)
                    self.inner.append({})
                    self.slot.append(False)
                    self.again.append(False)
                elif not mark:
                    mark = "+"  # groups of one kind apart from each other
                self.again[known] = self.again[known] or mark in ("+", "*")
                todo.append((known, [key, mark, children]))

    def places(self, tree: Tree) -> list[int]:
        """The wrapper's group of each group of a page, -1 for none."""
        out = [0] * len(tree.keys)
        for g in range(1, len(out)):
            p = out[tree.parents[g]]
            out[g] = self.inner[p].get(tree.keys[g], -1) if p >= 0 else -1
        return out


@lru_cache(1024)
def _wrapper(text: str) -> Wrapper:
    return Wrapper(text)


def text_mark(tree: Tree, group: int, text: str) -> int:
    """A number for a text at its place in the tree."""
    return xxhash.xxh64_intdigest(text, tree.hashes[group]) - (1 << 63)


def main_text(html: str, wrapper: str, template: frozenset[int] = frozenset()) -> str:
    """The article's blocks of a page; template has the marks of texts that all pages of the host share."""
    tree, found = blocks(html)
    slots = _wrapper(wrapper)
    places = slots.places(tree)
    read = [(g, t) for g, t in found if places[g] >= 0 and slots.slot[places[g]]]
    article = Article(tree, read)
    if template and not article.named:
        marked = [text_mark(tree, g, t) in template for g, t in read]
        # of the texts in a repeated group most decide for all, as a menu may have one entry of its own
        n, fixed = Counter(g for g, _ in read), Counter(g for (g, _), m in zip(read, marked) if m)
        fresh = [(g, t) for (g, t), m in zip(read, marked) if not (m or slots.again[places[g]] and n[g] > 2 and 2 * fixed[g] >= n[g])]
        read = fresh or read
        article = Article(tree, read)
    return "\n".join(t for g, t in read if g in article.groups)


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, template), one row for each host; all pages count.

    Where texts of different pages stand at one place, the place is a slot; template lists the marks of
    the texts that every one of a host's pages has at the same place. Copies of a page count once, and
    hosts of fewer than TEMPLATE_PAGES different pages have no template. A host's template is no longer
    than its shortest page.
    """

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        for b in batches:
            rows = []
            for host, html in zip(*(c.to_pylist() for c in b.columns)):
                tree, found = blocks(html or "")
                made = written(structure(tree, found))
                marks = sorted({text_mark(tree, g, t) for g, t in found})
                if len(seen) >= SEEN:
                    seen.clear()
                # a structure that the task has met before need not travel again
                rows.append((host, None if (host, made) in seen else made, marks, xxhash.xxh64_intdigest(html or "") - (1 << 63)))
                seen.add((host, made))
            kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["host", "wrapper", "marks", "page"])

    def merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [fold(frame["wrapper"].tolist())]})

    hosts = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    read = cut(mapped(hosts, shape, "host string, wrapper string, marks array<long>, page long"))
    now = cut(read.where("wrapper is not null").select("host", "wrapper").distinct())
    while True:
        sizes = now.groupBy("host").agg(F.count("*").alias("n"))
        if sizes.where("n > 1").isEmpty():
            break
        # bundles of a host hold about BUNDLE structures each, however many the host has
        dealt = now.join(sizes, "host").withColumn("bundle", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / BUNDLE)))
        now = cut(dealt.select("host", "bundle", "wrapper").groupBy("host", "bundle").applyInPandas(merged, "host string, wrapper string").distinct())
    different = read.select("host", "page", "marks").dropDuplicates(["host", "page"])
    total = different.groupBy("host").agg(F.count("*").alias("pages")).where(f"pages >= {TEMPLATE_PAGES}")
    shared = different.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n"))
    shared = shared.join(total, "host").where("n = pages").groupBy("host").agg(F.array_sort(F.collect_list("mark")).alias("template"))
    return now.join(shared, "host", "left")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages plus text, the blocks of the article joined by line feeds, and n_chars, its code points.

    A null html is empty and has an empty text; a null URL or one without a host belongs to the empty
    host. Rows are independent of each other but for the wrapper of their host, so repeated rows get
    equal texts. Existing columns called text or n_chars are replaced.
    """
    pages = without(pages, "text", "n_chars")
    wrappers = infer_wrappers(pages, url_col, html_col).toDF("__host", "__wrapper", "__template")
    few = wrappers.count() <= BROADCAST_HOSTS
    both = pages.withColumn("__host", host_of(F.col(f"`{url_col}`"))).join(F.broadcast(wrappers) if few else wrappers, "__host", "left").drop("__host")
    at = pages.columns.index(html_col)
    inner = both.toDF(*[f"c{i}" for i in range(len(both.columns))])
    n = len(pages.columns)
    schema = T.StructType([*inner.schema.fields[:n], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h or "", w, frozenset(m or ())) for h, w, m in zip(b.column(at).to_pylist(), b.column(n).to_pylist(), b.column(n + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string())], schema.names)

    out = mapped(inner, run, schema).toDF(*pages.columns, "text")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
