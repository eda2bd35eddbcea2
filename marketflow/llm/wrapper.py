"""Main text of web pages by wrapper induction.

Every page becomes a tree of its blocks in which siblings of one kind are one slot.  Trees of the same host are
aligned by simple tree matching into one template.  Slots with the same text on all pages are template; slots that
vary are content.  The content root is the article or main that holds nearly all varying text, or else the deepest
container that holds all of it; text of lists and containers made of links, and of slots named as menu, advert, comment
or the like, does not count there unless nothing else varies.  A page's main text is what stands below the root, without
named slots that never vary, without containers so named, and without elements that hold no main text.  The root, and
what holds it, is never left out.

Only slot statistics meet by host (smallest and largest text hash, sizes), summed before they are shuffled.  Slots are
told apart by tag and class words, not by ids, so pages of one layout are one skeleton.  Pages meet the rules of their
host and skeleton in a join.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from marketflow.llm.common import checkpointed
from marketflow.llm.html_text import BLOCKS, CONTAINERS, Node, blocks, drop_roles, parse

#: Begins the name of a slot that is a menu, advert, comment or the like.
ROLE = "!"
#: Pages that have to agree before a slot counts as constant.
MIN_PAGES = 3
#: Share of the varying text that an article or main must hold to be the content root.
HOLDS = 0.8

_STATS = "host string, skeleton string, slot int, pages long, low long, high long, chars long, plain long, page_low long, page_high long"

_MEASURES = ("pages", "low", "high", "chars", "plain", "page_low", "page_high")


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def slots(root: Node) -> tuple[list[tuple[int, str, str]], list[list[str]], list[int]]:
    """Slots (parent, tag, name) in order of first sight, the own texts of each, and their characters outside of lists
    and containers made of links; sets ``slot`` of the block elements."""
    found: dict[tuple[int, str, str], int] = {(-1, root.tag, root.name): 0}
    texts: list[list[str]] = [[]]
    plain = [0]
    root.slot = 0
    todo: list[tuple[Node, int, bool]] = [(root, 0, root.links)]
    while todo:
        node, slot, links = todo.pop()
        for kid in node.kids:
            if isinstance(kid, str):
                if s := kid.strip():
                    texts[slot].append(s)
                    plain[slot] += 0 if links else len(s)
            elif not kid.skip:
                if kid.tag not in BLOCKS:
                    if not kid.role:
                        todo.append((kid, slot, links or kid.links))
                    continue
                key = (slot, kid.tag, ROLE + kid.name if kid.role else kid.name)
                kid.slot = found.setdefault(key, len(found))
                if kid.slot == len(texts):
                    texts.append([])
                    plain.append(0)
                todo.append((kid, kid.slot, links or kid.links))
    return list(found), texts, plain


def _skeleton(keys: list[tuple[int, str, str]]) -> str:
    return json.dumps(keys, separators=(",", ":"))


def _page(page: str | None) -> tuple[Node, str, list[list[str]], list[int]]:
    root = drop_roles(parse(page))
    keys, texts, plain = slots(root)
    return root, _skeleton(keys), texts, plain


def _statistics(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, str, int], list[int]] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, skeleton, texts, plains = _page(page)
                whole = xxhash.xxh3_64_intdigest(page or "") - 2**63
                for slot, (own, plain) in enumerate(zip(texts, plains)):
                    h = xxhash.xxh3_64_intdigest("\n".join(own)) - 2**63
                    n = sum(map(len, own))
                    if s := seen.get((host, skeleton, slot)):
                        seen[host, skeleton, slot] = [s[0] + 1, min(s[1], h), max(s[2], h), s[3] + n, s[4] + plain,
                                                      min(s[5], whole), max(s[6], whole)]
                    else:
                        seen[host, skeleton, slot] = [1, h, h, n, plain, whole, whole]
            cols = list(zip(*(k + tuple(v) for k, v in seen.items()))) or [[]] * 10
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["host", "skeleton", "slot", *_MEASURES])

    return (pages.select("host", "html").mapInArrow(run, _STATS).groupBy("host", "skeleton", "slot")
            .agg(*(f(c).alias(c) for c, f in zip(_MEASURES, (F.sum, F.min, F.max, F.sum, F.sum, F.min, F.max)))))


class Template:
    """A host's template: slots with statistics, grown by aligning one skeleton after another."""

    def __init__(self):
        self.tag, self.name, self.kids, self.stats = ["html"], [""], [[]], [[0, 2**63 - 1, -2**63, 0, 0, 2**63 - 1, -2**63]]

    def align(self, keys: list[tuple[int, str, str]]) -> list[int]:
        """Template slot of each slot of a skeleton; slots without a partner are added."""
        kids: list[list[int]] = [[] for _ in keys]
        for i, (parent, _, _) in enumerate(keys):
            if parent >= 0:
                kids[parent].append(i)
        memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

        def match(t: int, s: int) -> tuple[int, list[tuple[int, int]]]:
            """Simple tree matching: size of the largest order-preserving match of two equal roots, and the pairs of kids."""
            todo = [(t, s)]
            while todo:
                u, v = todo[-1]
                a, b = self.kids[u], kids[v]
                ahead = [] if (u, v) in memo else [(x, y) for x in a for y in b if self.tag[x] == keys[y][1] and (x, y) not in memo]
                if ahead:
                    todo += ahead
                    continue
                todo.pop()
                if (u, v) in memo:
                    continue
                best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
                for i, x in enumerate(a):
                    for j, y in enumerate(b):
                        got = memo[x, y][0] if self.tag[x] == keys[y][1] else 0
                        best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + got)
                pairs, i, j = [], len(a), len(b)
                while i and j:
                    if best[i][j] == best[i - 1][j]:
                        i -= 1
                    elif best[i][j] == best[i][j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        pairs.append((a[i], b[j]))
                same = 2 if self.name[u] == keys[v][2] else 1  # equal names are a better match than equal tags
                memo[u, v] = best[-1][-1] + same, pairs
            return memo[t, s]

        place = [-1] * len(keys)
        place[0] = 0
        todo = [(0, 0)]
        while todo:
            t, s = todo.pop()
            partner = {y: x for x, y in match(t, s)[1]}
            for y in kids[s]:
                x = partner.get(y)
                if x is None:
                    x = len(self.tag)
                    self.tag.append(keys[y][1])
                    self.name.append(keys[y][2])
                    self.kids.append([])
                    self.stats.append([0, 2**63 - 1, -2**63, 0, 0, 2**63 - 1, -2**63])
                    self.kids[t].append(x)
                    memo.clear()
                place[y] = x
                todo.append((x, y))
        return place

    def add(self, slot: int, pages: int, low: int, high: int, chars: int, plain: int, page_low: int, page_high: int) -> None:
        s = self.stats[slot]
        self.stats[slot] = [s[0] + pages, min(s[1], low), max(s[2], high), s[3] + chars, s[4] + plain,
                            min(s[5], page_low), max(s[6], page_high)]

    def rules(self) -> tuple[int, set[int]]:
        """Content root, and the named slots below it that never vary."""
        order = [0]
        for t in order:
            order += self.kids[t]
        constant = {t for t, (n, low, high, c, _, a, b) in enumerate(self.stats)
                    if n >= MIN_PAGES and a < b and low == high and c}
        if all(t in constant for t in order if self.stats[t][3]):
            constant = set()  # copies of one page tell nothing apart
        role = [False] * len(self.tag)
        for t in order:
            role[t] = role[t] or self.name[t].startswith(ROLE)
            for k in self.kids[t]:
                role[k] = role[k] or role[t]

        def varying(roles: bool) -> list[int]:
            held = [0] * len(self.tag)
            for t in reversed(order):
                held[t] = (0 if t in constant or role[t] and not roles else self.stats[t][4]) + sum(held[k] for k in self.kids[t])
            return held

        held = varying(False)
        if not held[0]:
            held = varying(True)
        root = 0
        for t in order:  # article and main say what they are; the deepest that holds nearly all
            if self.tag[t] in ("article", "main") and held[t] and held[t] >= HOLDS * held[0]:
                root = t
        while self.tag[root] not in ("article", "main"):  # other containers have to hold all varying text
            inner = next((k for k in self.kids[root] if self.tag[k] in CONTAINERS and held[k] == held[root]), None)
            if inner is None or not held[inner]:
                break
            root = inner
        above = {k: t for t in order for k in self.kids[t]}
        line, t = {root}, root
        while t in above:
            t = above[t]
            line.add(t)
        named = {t for t in constant if self.name[t] and self.tag[t] not in ("article", "main", "body")}
        return root, (named | {t for t in order if self.name[t].startswith(ROLE)}) - line


def _induce(pages: DataFrame) -> DataFrame:
    """(host, skeleton, top, dropped): slot of the content root and dropped slots, for each skeleton's hash."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        template, places = Template(), {}
        by = pdf.groupby("skeleton")["pages"].max().reset_index().sort_values(["pages", "skeleton"], ascending=[False, True])
        for skeleton in by["skeleton"]:
            places[skeleton] = template.align([tuple(k) for k in json.loads(skeleton)])
        for r in pdf.itertuples(index=False):
            template.add(places[r.skeleton][r.slot], r.pages, r.low, r.high, r.chars, r.plain, r.page_low, r.page_high)
        root, dropped = template.rules()
        above = {k: t for t, kids in enumerate(template.kids) for k in kids}
        rules = []
        for skeleton, place in places.items():
            t, slot_of = root, {t: i for i, t in enumerate(place)}
            while t not in slot_of:  # a page without the content root: the nearest slot above that it has
                t = above[t]
            rules.append((key[0], _key(skeleton), slot_of[t], json.dumps([i for i, t in enumerate(place) if t in dropped])))
        return pd.DataFrame(rules, columns=["host", "skeleton", "top", "dropped"])

    return _statistics(pages).groupBy("host").applyInPandas(run, "host string, skeleton string, top int, dropped string")


def _key(skeleton: str) -> str:
    return xxhash.xxh3_64_hexdigest(skeleton)


def skeleton_key(page: str | None) -> str:
    return _key(_page(page)[1])


def main_text(page: str | None, top: int, dropped: set[int]) -> str:
    root, skeleton, _, _ = _page(page)
    inside = []
    for i, (p, _, _) in enumerate(json.loads(skeleton)):
        inside.append(i not in dropped and (i == top or p >= 0 and inside[p]))
    return "\n\n".join(blocks(root, lambda n: n.slot >= 0 and inside[n.slot]))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by an empty line), n_chars.

    Null html is an empty page with empty text; pages with a null or odd url share the host ''.  Repeated pages stay
    repeated; a host whose pages are all alike has no constant slots.  Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        host_of(F.col(url_col)).alias("host"))
    # Read back as a table, so that the pages of a large host can be split in the join.
    rules = checkpointed(_induce(rows)).select(F.col("host").alias("h"), F.col("skeleton").alias("k"), "top", "dropped")

    @pandas_udf("string")
    def key(html: pd.Series) -> pd.Series:
        return pd.Series([skeleton_key(p) for p in html])

    @pandas_udf("string")
    def text(html: pd.Series, top: pd.Series, dropped: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, t, set(json.loads(d))) for p, t, d in zip(html, top, dropped)])

    keyed = rows.withColumn("skeleton", key("html"))
    done = (keyed.join(rules, (F.col("host") == F.col("h")) & (F.col("skeleton") == F.col("k")))
            .select("page_id", "url", text("html", "top", "dropped").alias("text")))
    return done.withColumn("n_chars", F.length("text").cast("long"))
