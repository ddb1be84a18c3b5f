"""Problem 4: the main body of each page, without the furniture around and inside it.

Method: union-free wrapper inference on line streams. What recurs on a site is a template token: a whole line, the label of
a menu, or the head of a line that goes on with a text slot ("Read also: ..."); every other line is a text slot. The streams
of a site's pages are aligned one after the other into one expression without unions: tokens missing on some pages become
optional, tokens that follow themselves become repeated, runs of other lines become slots. Partial expressions are merged
by the same alignment, so pages of a site never meet in one task. The expression tells on how many pages each token stands
and where relative to the running text: a line on a good share of a site's pages is furniture wherever it stands, a rarer
short one where it always stands on one side of the text, a list of known labels is a menu, and a known head makes its line
furniture. The order of the expression tells what belongs to the head and the footer of a site: its first template tokens, as
long as they stand before the text, and its last ones, as long as they stand behind it. A rarer token between those of the
head, or behind one of the footer, is furniture there; pages without running text say nothing of a token's place. A small
grammar of common web furniture labels what recurs on too few pages, and spares bylines, legal notices
and remarks.

Defined results: null ids go, a repeated page_id counts once (latest delivery); null and empty content has no lines; a
page without host is labelled by the grammar alone; blank lines are never furniture.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import p1_site_lines
from corpusloom.operators.keys import measured_broadcast, one_per_key
from corpusloom.session import cut

TOKEN_PAGES, TOKEN_SHARE = 3, 0.01  #: a line on so many pages, and so large a share of them, is a template token
TEMPLATE_SHARE = 0.25  #: share of a site's pages from which a token is furniture in any place
NAV_SHARE = 0.05  #: share of a site's pages on which a menu label stands
SLOT_SHARE = 0.02  #: share of a site's pages on which the head of a line with a text slot stands
BOX_NEAR = 8  #: lines behind a side box's head that do not tell the page's own subject; the box itself may be longer
COMMON_SHARE = 0.16
HELD_WORDS = 500_000  #: words that a task counts before it passes them on
BROADCAST_CHARS = 32_000_000  #: characters of all expressions up to which they are broadcast
HELD_SITES = 10_000  #: sites that a task keeps at once
MERGE = 64  #: partial expressions merged in one task

# Common wordings of web furniture, and of bylines, legal notices and short remarks.
FURNITURE = re.compile(
    r"^(?:(?:©|\(c\)|copyright)\s*\d{4}|back to (?:the )?top\b|(?:skip|jump) to\b|subscribe\b.*newsletter|newsletter\b|"
    r"(?:download|get) (?:our|the) (?:\S+ ){0,3}app$|follow us\b|privacy\b.*\bterms of use|terms of use\b.*\bprivacy|"
    r"(?:accept|reject|allow) (?:all|everything)\b.{0,60}$|share (?:this|on)\b|(?:e-?mail|print) this page|"
    r"(?:tags|filed under|topics): |previous: .*next: |(?:previous|next): |page \d+ of \d+|(?:advertisement|sponsored|promoted)\s*[:\-–] ?\S|"
    r"(?:read also|see also|see more|don.t miss|more on this|related)\s*[:\-–] ?\S|home\s*[>»/›|]\s*\S)", re.I)
FURNITURE_INSIDE = re.compile(r"\ball rights reserved\b|\b(?:we use|uses|accept) cookies\b", re.I)
_INSIDE_HINTS = ("reserved", "cookies", "RESERVED", "COOKIES")
LINK = re.compile(r"^\s*>>\s*\S")
BOX_HEAD = re.compile(r"^(?:related (?:products|pages|articles|links)|most (?:read|viewed)(?: this week| today)?|in this section|you may also like|popular pages|quick links|recommended(?: for you)?|also of interest)$", re.I)
BYLINE = re.compile(r"^(?:posted [\d./\-]{8,10} by |published [\d./\-]{8,10}|last reviewed on |written (?:for|by) .*(?:min read|\d)|by the .{2,60}\|\s*[\d./\-]{8,10}|by [A-Z][^.]{2,40}\|)", re.I)
LEGAL = re.compile(
    r"\b(?:legal|tax|financial|investment) (?:or (?:legal|tax|financial) )?advice\b|\bfor (?:guidance|information|illustration)\b.*\bonly\b|"
    r"\b(?:no|not a) (?:promise|guarantee|indication) of (?:later|future)\b|\b(?:may|reserves? the right to) (?:change|amend|alter|withdraw)\b|"
    r"^terms(?:,| and) .*|^complaints? about\b|\bterms and conditions apply\W*$|\b(?:subject to|without) (?:prior )?(?:change|notice)\b|"
    r"\bdoes not constitute\b|\bpast performance\b|\baccepts? no liability\b|\bno liability is accepted\b", re.I)
#: what every legal notice above holds some of; looked for first because it is cheap
_LEGAL_HINTS = ("advice", "only", " of later", " of future", "change", "amend", "alter", "withdraw", "terms", "complaint", "notice", "constitute", "performance", "liability")
REMARKS = frozenset(["new", "see the schedule of charges", "call the helpline for details", "download the form", "apply online", "not available on public holidays", "source internal data", "terms and conditions apply", "visit your nearest branch today", "read the full story below"])

_BULLETS = " \t\r\n\x0b\x0c-*•·»>–—"
_MARK = re.compile(r"(?:\(\d{1,4}\)|\.\.\.|[:!\-])$")
_SOFT_MARK = re.compile(r"(?:\(\d{1,4}\)|\.\.\.|[:\-])$")
_NO_LETTER = re.compile(r"[\W\d_]+")
LONG = 200  #: lines longer than that are text
_SPACE = re.compile(r"\s+")
_SEP = re.compile(r"\s*[>/|·,»]\s*|\s{2,}")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_NUMBER = re.compile(r"\d")
_HEAD = re.compile(r"([^:>»›|/]{2,30}?)(?:\s*[:>»›|/]|\s+[\-–])\s*\S")
_CELLS = re.compile(r"\s*[|;\t]\s*|,\s+|\s{2,}")
_FRAME = frozenset("a about an and are as ask at be before by can choose costs documents does during ends for from how if in is it its limits need new news of on or questions step the this to use was what when which who why will with works you your".split())


def plain(line: str) -> str:
    """The line without bullets and trailing marks, spaces collapsed."""
    return " ".join(_cut_tail(line.replace("\xa0", " ").lstrip(_BULLETS), _MARK).split())


def _cut_tail(text: str, mark: re.Pattern[str]) -> str:
    """The text without marks at its end; only the last few characters are looked at."""
    text = text.rstrip()
    while m := mark.search(text[-8:]):
        text = text[: len(text) - (m.end() - m.start())].rstrip()
    return text


_ASCII_OTHERS = {i: None for i in range(128) if not chr(i).isalpha()}


def _letters(text: str) -> str:
    text = text.lower()
    return text.translate(_ASCII_OTHERS) if text.isascii() else _NO_LETTER.sub("", text)


def key_of(line: str) -> int | None:
    letters = _letters(line)
    return xxhash.xxh64_intdigest(letters.encode("utf-8", "surrogatepass")) - (1 << 63) if letters else None


def kind(line: str, text: str) -> str:
    """b blank, p running text, t title-like, m list of labels, o other."""
    if not text:
        return "b"
    words = text.split(" ")
    if text[-1] != "." and len(text) <= 2 * LONG and _SEP.search(line.strip()) and len(labels_of(line)) >= 3:
        return "m"
    if len(text) > LONG:
        return "p"
    end = _cut_tail(line, _SOFT_MARK)[-1:]
    if len(words) >= 7 and (end == "." or (end in ("?", "!") and len(words) >= 11) or len(words) >= 14):
        return "p"
    if len([x for x in _SEP.split(line.strip()) if x]) >= 3:
        return "m"
    if len(words) <= 11 and not (":" in text and not text.lower().endswith("what you need")) and _WORD.search(text):
        return "t"
    return "o"


def _is_row(line: str) -> bool:
    """Whether the line is a row of a table: three cells or more, figures in at least two."""
    cells = _CELLS.split(line.strip())
    return len(cells) >= 3 and sum(_NUMBER.search(c) is not None for c in cells) >= 2


def head_of(text: str) -> str | None:
    """The letters of a line's head, before the mark behind which its slot begins; null without one."""
    m = _HEAD.match(text)
    if m is None or len(m[1].split(" ")) > 4 or _NUMBER.search(m[1]):
        return None
    return _letters(m[1]) or None


def _hash(kind_: str, text: str) -> int:
    return xxhash.xxh64_intdigest((kind_ + text).encode("utf-8", "surrogatepass")) - (1 << 63)


def is_legal(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in _LEGAL_HINTS) and LEGAL.search(text) is not None


def labels_of(line: str) -> list[str]:
    """The labels of a menu line in lower case; a table row has figures and is none."""
    bare = _cut_tail(line.replace("\xa0", " ").lstrip(_BULLETS), _MARK)
    if _NUMBER.search(bare):
        return []
    parts = [_SPACE.sub(" ", x).strip().lower() for x in _SEP.split(bare) if x.strip()]
    return parts if all(1 <= len(x.split(" ")) <= 3 and len(x) > 2 for x in parts) else []


# --- expressions ---------------------------------------------------------------------------------------------------


def extend(nodes: dict[int, Node], page: list[Node]) -> dict[int, Node]:
    """An expression (its nodes in order, by key) with one more page; only a page that brings new tokens needs to be aligned."""
    if all(n.key in nodes for n in page):
        for n in page:
            nodes[n.key].add(n)
        return nodes
    return {n.key: n for n in align(list(nodes.values()), page)}


LINE, LABEL, SLOT = 0, 1, 2


class Node:
    """One template token: on how many pages, where, whether repeated, how often followed by titles or beside lines with heads; what is 0 for a line, 1 for a label, 2 for a head with a slot."""

    __slots__ = ("key", "what", "pages", "head", "tail", "mid", "repeated", "titles", "short", "listed")

    def __init__(self, key: int, what: int = LINE, pages: int = 0, head: int = 0, tail: int = 0, mid: int = 0, repeated: int = 0, titles: int = 0, short: int = 0, listed: int = 0) -> None:
        self.key, self.what, self.pages, self.head, self.tail, self.mid, self.repeated, self.titles, self.short, self.listed = key, what, pages, head, tail, mid, repeated, titles, short, listed

    def add(self, o: Node) -> None:
        self.pages += o.pages
        self.head += o.head
        self.tail += o.tail
        self.mid += o.mid
        self.repeated += o.repeated
        self.titles += o.titles
        self.short += o.short
        self.listed += o.listed


def align(left: list[Node], right: list[Node]) -> list[Node]:
    """Both expressions as one: common tokens in common order are joined, the others become optional at their place."""
    out: list[Node] = []
    m = SequenceMatcher(None, [n.key for n in left], [n.key for n in right], autojunk=False)
    for op, i1, i2, j1, j2 in m.get_opcodes():
        if op == "equal":
            for a, b in zip(left[i1:i2], right[j1:j2]):
                a.add(b)
                out.append(a)
        else:
            out += left[i1:i2] + right[j1:j2]
    where: dict[int, Node] = {}
    single: list[Node] = []
    for n in out:  # a token that crossed over in the alignment is kept once
        if n.key in where:
            where[n.key].add(n)
        else:
            where[n.key] = n
            single.append(n)
    return single  # no more than the site's tokens, which TOKEN_SHARE bounds


def _facts(line: str) -> tuple[str, str, int | None, tuple[int, ...], int | None]:
    """(plain text, kind, key, keys of its menu labels, key of its head) of a line."""
    t = plain(line)
    k = kind(line, t)
    if k == "b":
        return t, k, None, (), None
    labels = tuple(_hash("label ", l) for l in labels_of(line)) if k in "mt" else ()
    h = head_of(t) if len(t) <= LONG else None
    return t, k, key_of(line), labels, _hash("head ", h) if h and not _is_row(line) else None


_short_facts = functools.lru_cache(1 << 15)(_facts)  # short lines recur


_REMARK_KEYS = frozenset(key_of(x) for x in REMARKS)


def facts(line: str) -> tuple[str, str, int | None, tuple[int, ...], int | None]:
    return _short_facts(line) if len(line) <= LONG else _facts(line)


def tokens_of(lines: list[tuple]) -> list[tuple[int, int, int]]:
    """(key, line, what) of everything on a page that may be a template token: lines, menu labels, heads of lines with a slot."""
    out = []
    for i, (t, k, key, labels, head) in enumerate(lines):
        if key is not None:
            out.append((key, i, LINE))
        if labels:  # NAV_SHARE tells menus from lists of single pages
            out += [(l, i, LABEL) for l in labels]
        if head is not None:
            out.append((head, i, SLOT))
    return out


def stream(found_: list[tuple[int, int, int]], kinds: str, tokens: set[int]) -> list[Node]:
    """The page's template tokens, with their place relative to its running text."""
    known = {i for k, i, what in found_ if what == LINE and k in tokens}
    headed = {i for _, i, what in found_ if what == SLOT and kinds[i] != "m"}
    prose = [i for i, k in enumerate(kinds) if k == "p" and i not in known]
    first, last = (prose[0], prose[-1]) if prose else (len(kinds), -1)
    out: list[Node] = []
    seen: dict[int, Node] = {}
    for k, i, what in found_:
        if k not in tokens:
            continue
        if k in seen:
            seen[k].repeated = 1
            continue
        n = seen[k] = Node(k, what, 1)
        if prose:  # else the order of the expression has to tell
            n.head, n.tail, n.mid = int(i < first), int(i > last), int(first <= i <= last)
        n.titles = int(kinds[i + 1 : i + 3] == "tt")
        n.short = int(kinds[i] != "p")
        n.listed = int(i - 1 in headed or i + 1 in headed)
        out.append(n)
    return out


def _dump(nodes: list[Node]) -> str:
    return json.dumps([[getattr(n, f) for f in Node.__slots__] for n in nodes])


def _load(text: str) -> list[Node]:
    return [Node(*x) for x in json.loads(text)]


# --- passes --------------------------------------------------------------------------------------------------------


def parse(content: str | None) -> list[tuple]:
    """The facts of every line."""
    return [facts(x) for x in content.split("\n")] if content else []


_FEATURES = "page_id bigint, site string, content string, plains string, kinds string, keys array<bigint>, at array<int>, what array<tinyint>"


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        plains, kinds, keys, at, what = [], [], [], [], []
        for content in b.column(2).to_pylist():
            lines = parse(content)
            got = tokens_of(lines)
            plains.append("\n".join(f[0] for f in lines))
            kinds.append("".join(f[1] for f in lines))
            keys.append([g[0] for g in got])
            at.append([g[1] for g in got])
            what.append([g[2] for g in got])
        cols = [pa.array(plains, pa.string()), pa.array(kinds, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32())), pa.array(what, pa.list_(pa.int8()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], ["page_id", "site", "content", "plains", "kinds", "keys", "at", "what"])


def featurized(texts: DataFrame) -> DataFrame:
    """The pages with the facts of their lines, a written table that all later passes read."""
    return cut(texts.mapInArrow(_featurize, _FEATURES))


def facts_of(plains: str, kinds: str, keys: list[int], at: list[int], what: list[int]) -> list[tuple]:
    """The facts of a page's lines from its row of the table."""
    key: dict[int, int] = {}
    head: dict[int, int] = {}
    labels: dict[int, list[int]] = {}
    for k, i, w in zip(keys, at, what):
        if w == LINE:
            key[i] = k
        elif w == SLOT:
            head[i] = k
        else:
            labels.setdefault(i, []).append(k)
    return [(t, k, key.get(i), labels.get(i, ()), head.get(i)) for i, (t, k) in enumerate(zip(plains.split("\n"), kinds))]


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, site, content), one row per page."""
    few = pages.select("page_id", "loaded_at", F.col("metadata.url").alias("url"), "content")
    return one_per_key(few, "page_id", "loaded_at").select("page_id", p1_site_lines.host(F.col("url")).alias("site"), "content")


def expressions(pages: DataFrame) -> DataFrame:
    """(site, nodes, pages): the wrapper of every site, from a table made by featurized."""
    lines = pages.filter("site is not null").select("page_id", "site", "keys", "at", "what", "kinds")
    tokens = p1_site_lines.repeated_lines(lines, TOKEN_PAGES, TOKEN_SHARE).groupBy("site").agg(F.collect_list("key").alias("tokens"))
    tokens = cut(tokens)  # bounded by tokens per page / TOKEN_SHARE for each site

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sites: dict[str, tuple[set[int], dict[int, Node]]] = {}
        for b in batches:
            toks = b.column(5)
            cols = [b.column(i).to_pylist() for i in range(5)]
            for i, (site, keys, at, what, kinds) in enumerate(zip(*cols)):
                if site not in sites:
                    sites[site] = (set(toks[i].as_py() or []), {})
                known, nodes = sites[site]
                sites[site] = (known, extend(nodes, stream(list(zip(keys, at, what)), kinds, known)))
        yield pa.RecordBatch.from_arrays([pa.array(list(sites), pa.string()), pa.array([_dump(list(n.values())) for _, n in sites.values()], pa.string())], ["site", "nodes"])

    few = lines.select("site", "keys", "at", "what", "kinds")
    parts = few.join(measured_broadcast(tokens), "site", "left").select(*few.columns, "tokens").mapInArrow(wrap, "site string, nodes string")
    parts = cut(parts)

    def merge(t: pa.Table) -> pa.Table:
        nodes: list[Node] = []
        for x in sorted(t.column("nodes").to_pylist()):
            nodes = align(nodes, _load(x))
        return pa.Table.from_arrays([t.column("site").slice(0, 1), pa.array([_dump(nodes)])], ["site", "nodes"])

    while True:
        most = parts.groupBy("site").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            break
        salt = F.floor(F.pmod(F.xxhash64("nodes"), F.lit(1 << 20)) % F.lit(max(1, -(-most // MERGE))))
        parts = cut(parts.withColumn("salt", salt).groupBy("site", "salt").applyInArrow(merge, "site string, nodes string"))
    pages = lines.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    return cut(pages.join(parts, "site", "left"))


def _topical(text: str, common: frozenset[str]) -> list[str]:
    """The words of a line that tell its subject: neither frame words nor words common on all sites."""
    return [w for w in _WORD.findall(text.lower()) if w not in _FRAME and w not in common]


@functools.lru_cache(1 << 16)
def _words_in(token: str) -> tuple[str, ...]:
    """The words of a piece between white space."""
    return tuple(_WORD.findall(token))


def _page_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for content in b.column(0).to_pylist():
            for w in set().union(*map(_words_in, set(content.lower().split()))):
                seen[w] = seen.get(w, 0) + 1
            if len(seen) > HELD_WORDS:
                yield out()
                seen.clear()
    yield out()


def common_words(texts: DataFrame) -> frozenset[str]:
    """Words on more than COMMON_SHARE of all pages (at most the mean number of words of a page / COMMON_SHARE)."""
    some = texts.filter("content is not null").select("content")
    counted = cut(some.mapInArrow(_page_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    least = COMMON_SHARE * some.count()
    return frozenset(r.word for r in counted.filter(F.col("n") > least).toLocalIterator())


class Site:
    """What the expression of a site says of its lines."""

    def __init__(self, nodes: str | None, common: frozenset[str] = frozenset(), pages: int | None = None) -> None:
        self.common = common
        self.nav: set[int] = set()
        self.slots: set[int] = set()
        self.outside: set[int] = set()
        self.boxes: set[int] = set()
        self.template: set[int] = set()
        self.behind: set[int] = set()
        #: template tokens of the head and the footer, and what stands before the last or behind the first of them in the expression
        self.header: set[int] = set()
        self.footer: set[int] = set()
        self.top: set[int] = set()
        self.foot: set[int] = set()
        pages = pages or 0
        ordered = _load(nodes) if nodes else []
        for some, found_, within, side in ((ordered, self.header, self.top, "head"), (ordered[::-1], self.footer, self.foot, "tail")):
            rarer: list[int] = []  # since the last template token of the side
            for n in some:
                placed = n.head + n.tail + n.mid
                if n.what == LINE and n.pages >= max(8, TEMPLATE_SHARE * pages):
                    if getattr(n, side) < 0.95 * max(1, placed):
                        break
                    found_.add(n.key)
                    within.update(rarer)
                    rarer = []
                elif n.what != LABEL and n.short >= 0.9 * n.pages and getattr(n, side) >= 0.95 * placed:
                    rarer.append(n.key)
        for n in ordered:
            if n.what == LABEL:
                if n.pages >= NAV_SHARE * pages:
                    self.nav.add(n.key)
                continue
            if n.what == SLOT:
                if n.pages >= max(8, SLOT_SHARE * pages) and n.short >= 0.9 * n.pages and n.listed <= 0.5 * n.pages:
                    self.slots.add(n.key)  # rows of lists and tables stand beside each other
                continue
            if n.pages >= max(8, TEMPLATE_SHARE * pages):
                self.template.add(n.key)
            elif n.pages >= max(8, NAV_SHARE * pages) and n.short >= 0.9 * n.pages and n.tail >= max(1, 0.95 * (n.head + n.tail + n.mid)):
                self.behind.add(n.key)
            if n.short >= 0.9 * n.pages and n.pages >= 4:
                if n.titles >= 0.6 * n.pages:
                    self.boxes.add(n.key)
                elif n.mid <= 0.05 * n.pages and n.pages >= 8 and n.key in self.top:
                    self.outside.add(n.key)


NO_SITE = Site(None)


def label_lines(content: str | None, site: Site) -> str:
    """A letter for each line: F furniture, Y byline, L legal notice, R short remark, B blank, M main body."""
    return "".join(annotate(content, site)[3])


def annotate(content: str | None, site: Site, all_: list[tuple] | None = None) -> tuple[list[str], list[str], list[str], list[str]]:
    """(lines, their plain texts, kinds, labels) of a page; all_ are the facts of its lines where they are known."""
    lines = content.split("\n") if content else []
    if all_ is None:
        all_ = parse(content)
    texts, kinds = [f[0] for f in all_], [f[1] for f in all_]
    out = []
    started = False
    heads: list[int] = []
    behind: list[int] = []
    header = max((i for i, f in enumerate(all_) if f[2] in site.header), default=-1)
    footer = False
    for i, (x, (t, k, key, labels, head)) in enumerate(zip(lines, all_)):
        got = "M"
        if k == "b":
            got = "B"
        elif len(t) > LONG and k != "m":
            got = "M"
        elif BYLINE.match(t):
            got = "Y"
        elif is_legal(t):
            got = "L"
        elif key in _REMARK_KEYS:
            got = "R"
        elif FURNITURE.match(t) or LINK.match(x) or (any(h in t for h in _INSIDE_HINTS) and FURNITURE_INSIDE.search(t)):
            got = "F"
        elif BOX_HEAD.match(t):
            got = "F"
            heads.append(i)
        elif k in "mt":
            known = sum(p in site.nav for p in labels)
            if (len(labels) >= 2 and known >= 0.6 * len(labels)) or (len(labels) == 1 and known and not started):
                got = "F"
            elif k == "t" or not labels:
                if key in site.boxes and kinds[i + 1 : i + 3] == ["t", "t"]:
                    got = "F"
                    heads.append(i)
                elif key in site.outside and i < header and not started and len(labels) == 1:
                    got = "F"
        if got == "M" and len(t) <= LONG:
            if key in site.template or head in site.slots:
                got = "F"
            elif key in site.behind or (footer and (key in site.foot or head in site.foot)):
                behind.append(i)
        footer = footer or key in site.footer
        if got == "M" and (k in "po"):
            started = True
        out.append(got)
    last = max((i for i, k in enumerate(kinds) if k == "p" and out[i] == "M"), default=-1)
    for i in behind:
        if i > last:
            out[i] = "F"
    for h in heads:
        run = []
        for i in range(h + 1, len(lines)):
            if out[i] != "M" or kinds[i] == "b":
                break
            if not _is_row(lines[i]):  # rows of tables stay, the box goes on behind them
                run.append(i)
        inside = set(run[:BOX_NEAR])
        body = {w for i, k in enumerate(kinds) if k in "po" and out[i] == "M" and i not in inside for w in _topical(texts[i], site.common)}
        for n, i in enumerate(run):
            words = _topical(texts[i], site.common)
            own = sum(w in body for w in words) / len(words) if words else 0.0
            after = kinds[i + 1 : i + 2]
            item = after == ["t"] and lines[i + 1].lstrip()[:1] in ("-", ">", "•", "*", "»")
            if kinds[i] == "t":  # a heading of the page is followed by its text
                listed = lines[i].lstrip()[:1] in ("-", ">", "•", "*", "»") or not after or out[i + 1] == "F" or (after == ["t"] and out[i + 1] == "M")
            else:
                listed = item
            if (own >= 0.5 and n > 0 and not listed) or (own >= 0.5 and kinds[i] != "t" and not listed) or (not words and kinds[i] == "p" and not listed):
                break  # the page's own text goes on
            out[i] = "F"
    return lines, texts, kinds, out


class Modelled:
    """The pages with what the expression of their site says, and the words common on all sites."""

    def __init__(self, pages: DataFrame) -> None:
        texts = featurized(page_texts(pages))
        models = expressions(texts)
        sc = pages.sparkSession.sparkContext
        self.common = sc.broadcast(common_words(texts))
        size = models.agg(F.coalesce(F.sum(F.length("nodes")), F.lit(0))).first()[0]
        #: site to (nodes, pages) where all expressions are small enough to broadcast; else they travel with the pages
        self.models: Broadcast | None = None
        cols = ["page_id", "site", "content", "plains", "kinds", "keys", "at", "what"]
        if size <= BROADCAST_CHARS:
            self.models = sc.broadcast({r.site: (r.nodes, r.pages) for r in models.toLocalIterator()})
            self.table = texts.select(*cols)
        else:
            self.table = texts.join(models, "site", "left").select(*cols, "nodes", "pages")

    def _mapped(self, each: Callable[[tuple], tuple], names: list[str], schema: str) -> DataFrame:
        """page_id and what `each` makes of every page's annotation."""
        common, models = self.common, self.models

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sites: dict[str | None, Site] = {}
            for b in batches:
                out = []
                for i, (name, content, *rest) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 8)))):
                    if name not in sites:
                        if len(sites) > HELD_SITES:
                            sites.clear()
                        nodes, n = (b.column(8)[i].as_py(), b.column(9)[i].as_py()) if models is None else models.value.get(name, (None, None))
                        sites[name] = Site(nodes, common.value, n)
                    out.append(each(annotate(content, sites[name], facts_of(*rest) if content else [])))
                cols = list(zip(*out)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string()) for c in cols]], ["page_id", *names])

        return self.table.mapInArrow(run, schema)

    def labelled(self) -> DataFrame:
        """(page_id, labels) of every page; see label_lines."""
        return self._mapped(lambda a: ("".join(a[3]),), ["labels"], "page_id bigint, labels string")

    def cleaned(self) -> DataFrame:
        """(page_id, content): the pages without their furniture lines; null content stays null."""
        return self._mapped(lambda a: ("\n".join(x for x, l in zip(a[0], a[3]) if l != "F") if a[0] else None,), ["content"], "page_id bigint, content string")

    def bodies(self) -> DataFrame:
        """(page_id, main, plains, kinds): the lines of every page's main body, bylines, legal notices and remarks aside, their plain texts and kinds."""
        return self._mapped(main_body, ["main", "plains", "kinds"], "page_id bigint, main string, plains string, kinds string")


def main_body(page: tuple) -> tuple[str | None, str | None, str | None]:
    lines, texts, kinds, labels = page
    at = [i for i, x in enumerate(labels) if x == "M"]
    return ("\n".join(lines[i] for i in at), "\n".join(texts[i] for i in at), "".join(kinds[i] for i in at)) if at else (None, None, None)


def labelled(pages: DataFrame) -> DataFrame:
    return Modelled(pages).labelled()


def found(pages: DataFrame) -> DataFrame:
    each = labelled(pages).select("page_id", F.posexplode(F.split("labels", "")).alias("line_no", "label"))
    return each.filter("label = 'F'").select("page_id", F.col("line_no").cast("bigint").alias("line_no"))


def clean(pages: DataFrame) -> DataFrame:
    """(page_id, content): the pages without their furniture lines; null and empty content becomes null."""
    return Modelled(pages).cleaned()


def wrappers(pages: DataFrame) -> DataFrame:
    """(site, pages, tokens, labels, slots, optional, repeated): the size of every site's expression, menu labels and tokens with a text slot."""
    nodes = F.from_json("nodes", "array<array<bigint>>")
    e = expressions(featurized(page_texts(pages))).withColumn("n", nodes)
    count = lambda test: F.size(F.filter("n", test))
    return e.select("site", "pages", F.size("n").alias("tokens"), count(lambda x: x[1] == LABEL).alias("labels"), count(lambda x: x[1] == SLOT).alias("slots"), count(lambda x: x[2] < F.col("pages")).alias("optional"), count(lambda x: x[6] > 0).alias("repeated"))
