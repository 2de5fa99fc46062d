"""Main text of web pages by wrappers inferred from pages of the same host (operator 5).

A page becomes a stream of block tags and texts (inline tags only join text),
nested by its tags.  A wrapper is a union-free regular expression over such
streams: items in order, each once, optional (?), repeated (+) or both (*);
tags have an expression as body, groups repeat several items, and a text is a
constant or, once two pages differ, a slot.  Wrappers are inferred by aligning
page after page: repeated neighbours fold into repeated items or groups, what
one side lacks becomes optional, unequal texts become slots.

Each task aligns its pages host by host as it reads them, and the tasks' small
wrappers of a host are aligned in two steps, so the pages of a host never meet
in one task.  A host's wrapper then decides: the article's region is where the
texts are that vary from page to page and are no links, and of what is in it
texts that are the same on all pages (notices) and repeated or optional parts
that are nearly all links go.  Names of tags and classes break ties between
regions and tell parts of the region that belong to no article; they never drop
the region or what it lies in, and a class or id drops no block of text (a
paragraph, an item) unless it is nearly all links.  Buttons and choices within a
line of text go without parting it.  Tags nested deeper than 200 levels keep their
texts, in order, without more levels.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelspark.llm._util import staged

_RAW = "script|style|noscript|template|textarea|title|iframe|svg|xmp"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[a-z/!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[a-z/!?][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr area embed img input param source track math mi mn mo mrow msup msub mfrac".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag that ends open ones of these names without their end tags.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Controls within lines of text.
_CONTROLS = frozenset("button select".split())
_DROP = frozenset("head nav footer aside form button menu dialog fieldset select datalist".split())
_WORDS = (
    r"(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo|promotion|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side-bar|widget|footer|masthead|toolbar|share|sharing|social|related|recommended|more-stories|comments?|commentlist|disqus|respond|replies|reply|pagination|pager|tags|skip-link|print-only|hidden)"
)
#: Parts of a class or id, and whole ones.
_MARKS, _WHOLE = re.compile(rf"(?:^|[\s_-]){_WORDS}(?:$|[\s_-])", re.I), re.compile(rf"(?:^|\s){_WORDS}(?:$|\s)", re.I)
#: Boxes that say nothing of what they hold, and lists.
_BOXES, _LISTS = frozenset("div section span center".split()), frozenset("ul ol dl menu".split())
#: Never dropped for their class or id.
_STAY = frozenset("html body main article".split())
#: Blocks of text, which are no region.
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption th address summary".split())
#: What a text counts for the choice of a region if it is a link or lies in a part that is dropped by its name: names alone can't outweigh much text.
_LESS = 0.2
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|entry|story|main|content|body)(?:$|[\s_-])", re.I)
#: Pages that must agree on a text, and wrappers that one merge takes.
SUPPORT, FAN = 10, 200
#: Bytes of all hosts' rules that are broadcast at most.
BROADCAST = 32 << 20


class Text(str):
    """A text of a page; links: how many of its characters are links."""

    links = 0


class Tag:
    __slots__ = ("name", "mark", "kids")

    def __init__(self, name: str, mark: str = ""):
        self.name, self.mark, self.kids = name, mark, []

    @property
    def key(self) -> str:
        """What alignment compares. Boxes without a class or id are told apart by what they hold, else neighbours of any kind would fold into one repeated item."""
        if self.mark or self.name not in _BOXES:
            return f"{self.name}.{self.mark}" if self.mark else self.name
        kinds = {"#" if isinstance(k, str) else k.name in _LISTS for k in self.kids}
        return self.name if kinds <= {"#"} else f"{self.name}:{'list' if kinds == {True} else 'parts'}"

    @property
    def linked(self) -> bool:
        """Whether nearly all text in it is links."""
        every = links = 0
        todo = list(self.kids)
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                every, links = every + len(k), links + k.links
            else:
                todo += k.kids
        return 10 * links >= 9 * every > 0

    @property
    def dropped(self) -> bool:
        """Dropped by its name, or by a word of its class or id; these never drop a block of text, which goes where the article's run goes."""
        return self.name in _DROP or bool(self.name not in _LEAF and self.mark and self.name not in _STAY and _MARKS.search(self.mark))

    @property
    def doubtful(self) -> bool:
        """Dropped for a part of a class or id only, as in has-sidebar."""
        return self.dropped and self.name not in _DROP and not _WHOLE.search(self.mark)


def _mark(words: list[str]) -> str:
    """The class, id, role and itemprop of a tag without digits: the words that fit in 80 characters, of those beyond the ones that tell what it holds, and a hash of all that is beyond."""
    words = re.sub(r"\d+", "", " ".join(words)).split()
    if sum(map(len, words)) + len(words) <= 81:
        return " ".join(words)
    out, rest, n = [], [], 0
    for w in words:
        n += len(w) + 1
        if n <= 81:
            out.append(w)
        else:
            rest.append(w)
    out += [w for w in dict.fromkeys(rest) if (_MARKS.search(w) or _MAIN.search(w)) and w not in out]
    return " ".join([*out, "~" + hashlib.blake2b(" ".join(rest).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()])


def _constant(text: str) -> str:
    """A text as wrappers keep it: a long one as its length and a hash, after a character that no text holds."""
    return text if len(text) <= 120 else f"\x1f{len(text)}:{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def parse(html: str) -> Tag:
    """The page as nested block tags and texts. Texts are decoded, white space in them is one space."""
    root = Tag("")
    stack, text, linked, link, control = [root], [], [], 0, ""

    def close_text() -> None:
        if text:
            t = Text(" ".join(unescape("".join(text)).split()))
            if t:
                t.links = min(len(t), sum(len(" ".join(unescape(x).split())) for x in linked))
                stack[-1].kids.append(t)
            text.clear()
            linked.clear()

    def end(names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                del stack[k:]
                return
            if stack[k].name in stop:
                return

    for m in _TOKEN.finditer(html):
        token = m.group()
        if m.group(1) or token.startswith("<!--"):
            continue
        named = _NAME.match(token)
        if token[0] != "<" or len(token) == 1:
            if control:
                continue
            text.append(token)
            if link:
                linked.append(token)
            continue
        if not named:
            continue
        name = named.group(1).lower()
        if control:  # a control lies in its line of text: what it holds goes, and the line is not parted
            if token[1] != "/" or (name != control and name in _INLINE):
                continue
            same, control = name == control, ""
            if same:
                text.append(" ")
                continue
        elif name in _CONTROLS:
            if token[1] == "/" or token.endswith("/>"):
                text.append(" ")
            else:
                control = name
            continue
        if name in _INLINE:
            if name == "a":
                link = int(token[1] != "/")
            continue
        close_text()
        if token[1] == "/":
            end((name,), ())
        elif name in _VOID:
            continue
        else:
            end(("p",), ("td", "th", "table", "button", "article", "section", "div"))
            if name in _ENDS:
                end(_ENDS[name], ("ul", "ol", "dl", "table", "select"))
            tag = Tag(name, _mark([x for f in _MARK.findall(token) for x in (f[1] or f[2] or f[3]).split()]))
            stack[-1].kids.append(tag)
            if not token.endswith("/>"):
                stack.append(tag)
                if len(stack) > 200:  # deeper nesting keeps its texts, in order, without more levels
                    stack.pop()
    close_text()
    return root


# An item of a wrapper is [key, quantifier, pages, value, body]: a text has key "#", value a constant or null (a slot) and
# body the number of its characters, followed by that of characters in links; a tag has its key and its expression as body; a group has key "(...)" and its items as body.


def _quant(a: str, b: str) -> str:
    many, may = a in "+*" or b in "+*", a in "?*" or b in "?*"
    return "*" if many and may else "+" if many else "?" if may else "1"


def _join(a: list, b: list, twice: bool = False) -> list:
    """Two items of one key as one; twice: of the same page."""
    n = max(a[2], b[2]) if twice else a[2] + b[2]
    if a[0] == "#":
        return ["#", _quant(a[1], b[1]), n, a[3] if a[3] == b[3] else None, a[4] + b[4], a[5] + b[5]]
    return [a[0], "+" if twice else _quant(a[1], b[1]), n, None, align(a[4], b[4], twice)]


def _fold(items: list) -> list:
    """Repeated neighbours become repeated items, repeated sequences of up to four items groups."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0] and item[0] != "#":
            out[-1] = _join(out[-1], item, True)
            continue
        out.append(item)
        for p in (2, 3, 4):
            if len(out) > p and out[-p - 1][0] == "(" + " ".join(x[0] for x in out[-p:]) + ")":
                group, tail = out[-p - 1], out[-p:]
                group[4] = [_join(x, y, True) for x, y in zip(group[4], tail, strict=True)]
                del out[-p:]
                break
            if len(out) >= 2 * p and [x[0] for x in out[-p:]] == [x[0] for x in out[-2 * p : -p]] and any(x[0] != "#" for x in out[-p:]):
                body = [_join(x, y, True) for x, y in zip(out[-2 * p : -p], out[-p:], strict=True)]
                out[-2 * p :] = [["(" + " ".join(x[0] for x in body) + ")", "+", max(x[2] for x in body), None, body]]
                break
    return out


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a and every beginning of b."""
    best = np.zeros(len(b) + 1, np.int32)
    for v in a:
        best[1:] = np.maximum.accumulate(np.where(b == v, best[:-1] + 1, best[1:]))
    return best


def _common(a: np.ndarray, b: np.ndarray, i: int = 0, j: int = 0) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by halving a, so that memory follows the lengths and not their product."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i + k, j + k) for k in range(head)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) == 1:
        out += [(i + head, j + head + int(k)) for k in np.flatnonzero(y == x[0])[:1]]
    elif len(x) and len(y):
        h = len(x) // 2
        cut = int(np.argmax(_lengths(x[:h], y) + _lengths(x[h:][::-1], y[::-1])[::-1]))
        out += _common(x[:h], y[:cut], i + head, j + head) + _common(x[h:], y[cut:], i + head + h, j + head + cut)
    return out + [(i + len(a) - tail + k, j + len(b) - tail + k) for k in range(tail)]


def align(a: list, b: list, twice: bool = False) -> list:
    """Two expressions as one: common items in order are joined, the others become optional."""
    ka, kb = [x[0] for x in a], [x[0] for x in b]
    if ka == kb:
        return [_join(x, y, twice) for x, y in zip(a, b, strict=True)]
    number: dict[str, int] = {}
    pairs = _common(*(np.array([number.setdefault(k, len(number)) for k in keys], np.int64) for keys in (ka, kb)))
    out, i, j = [], 0, 0
    may = lambda x: [x[0], _quant(x[1], "?"), *x[2:]]
    for p, q in [*pairs, (len(a), len(b))]:
        out += [may(x) for x in a[i:p]] + [may(x) for x in b[j:q]]
        if p < len(a):
            out.append(_join(a[p], b[q], twice))
        i, j = p + 1, q + 1
    return _fold(out)


def expression(tag: Tag) -> list:
    """A page's own expression."""
    return _fold([["#", "1", 1, _constant(k), len(k), k.links] if isinstance(k, str) else [k.key, "1", 1, None, expression(k)] for k in tag.kids])


def _tag(key: str) -> Tag:
    name, _, mark = key.partition(".")
    return Tag(name, mark)


def rules(wrapper: list, pages: int) -> dict:
    """What extraction needs of a wrapper. main: paths of the article's regions; constant: paths and values of texts in them that are the same on all pages and
    not of a repeated item; links: paths of repeated or optional parts in them that are nearly all links; keep: paths of parts that stay in spite of a part of
    their class or id, as they hold half of the region's text or more.
    """
    many_pages = pages >= SUPPORT

    def mass(items: list, weight: float = 1.0) -> float:
        """Characters of texts that vary, links and parts that are dropped by name counting less."""
        total = 0.0
        for item in items:
            key, body = item[0], item[4]
            if key == "#":
                if item[3] is None or item[2] < max(2, pages) or not many_pages:
                    total += weight * (body - (1 - _LESS) * item[5])
            elif key[0] == "(":
                total += mass(body, weight)
            else:
                total += mass(body, weight * (_LESS if _tag(key).dropped or key.partition(".")[0] == "header" else 1))
        return total

    def share(items: list) -> tuple[int, int]:
        """(characters, those in links) of all texts."""
        each = [(x[4], x[5]) if x[0] == "#" else share(x[4]) for x in items]
        return sum(x for x, _ in each), sum(y for _, y in each)

    def run(items: list) -> bool:
        """Whether blocks of text repeat or follow each other here."""
        return sum((2 if x[1] in "+*" else 1) for x in items if x[0].partition(".")[0] in _LEAF or x[0][0] == "(") >= 2

    #: (path, weighted mass, key, items) of all tags that can be a region: those that no repeated item holds, and articles anywhere
    regions: list[tuple[str, float, str, list]] = []

    def look(items: list, path: str, weight: float, once: bool) -> None:
        for item in items:
            key, quant, body = item[0], item[1], item[4]
            if key == "#":
                continue
            if key[0] == "(":
                look(body, path, weight, False)
                continue
            name, at = key.partition(".")[0], f"{path}/{key}"
            less = weight * (_LESS if _tag(key).dropped or name == "header" else 1)
            named, single = name in ("article", "main") or "articleBody" in key, once and quant in "1?"
            if (single and name not in _LEAF) or named:
                regions.append((at, mass(body, less), key, body))
            look(body, at, less, single)

    look(wrapper, "", 1.0, True)
    every = mass(wrapper)
    named = [r for r in regions if (r[2].partition(".")[0] in ("article", "main") or "articleBody" in r[2]) and 10 * r[1] >= 3 * every > 0]
    marked = [r for r in regions if 2 * r[1] >= every > 0 and _MAIN.search(r[2].partition(".")[2])]
    if named:  # the outermost, or the articles in it that hold nearly all of it
        outer = [r for r in named if not any(r[0].startswith(f"{o[0]}/") for o in named)]
        inner = [r for r in named if r not in outer and r[2].startswith("article") and 10 * r[1] >= 8 * sum(o[1] for o in outer)]
        chosen = [r for r in outer if r[2].startswith("article")] or inner[:1] or outer
    else:
        best = marked or [r for r in regions if 5 * r[1] >= 4 * every > 0]
        deepest = max(best, key=lambda r: (r[0].count("/"), r[0]))[3] if best else wrapper
        if not marked and not any(x[0] == "#" or x[0].partition(".")[0] in _LEAF for x in deepest):
            # boxes only: the one with most of the text, if it is a run of blocks and there is no other such run beside it
            runs = [r for r in regions if run(r[3])]
            apart = lambda a, b: not f"{a[0]}/".startswith(f"{b[0]}/") and not f"{b[0]}/".startswith(f"{a[0]}/")
            best = [*best, *(r for r in runs if 5 * r[1] >= 3 * every > 0 and not any(apart(r, o) and 20 * o[1] >= 3 * every for o in runs))]
        chosen = [max(best, key=lambda r: (r[0].count("/"), r[0]))] if best else [("", every, "", wrapper)]
    constant: list[str] = []
    links: list[str] = []
    keep: list[str] = []

    def inside(items: list, path: str, many: bool, around: float) -> None:
        for item in items:
            key, quant, n, value, body = item[:5]
            if key == "#":
                if not many and quant == "1" and value is not None and n >= SUPPORT and 10 * n >= 9 * pages and not re.search(r"/h[1-6][^/]*$", path):
                    constant.append(f"{path}\t{value}")
            elif key[0] == "(":
                inside(body, path, True, around)
            else:
                at, tag = f"{path}/{key}", _tag(key)
                if tag.dropped and tag.doubtful and 2 * mass(body) >= around > 0:
                    keep.append(at)
                elif many_pages and tag.name not in _LEAF and (lambda x, y: x > 0 and 10 * y >= 9 * x)(*share(body)):
                    links.append(at)
                inside(body, at, many or quant in "+*", around)

    for path, _, _, body in chosen:
        inside(body, path, False, mass(body))
    return {"main": sorted({r[0] for r in chosen}), "constant": sorted(set(constant)), "links": sorted(set(links)), "keep": sorted(set(keep))}


def text_of(page: Tag, rule: dict | None) -> str:
    """The blocks of the article regions, a line each. Without a rule, and where a page lacks its host's regions, its own expression gives one."""
    blocks: list[str] = []

    def take(rule: dict) -> None:
        main, constant, links, keep = (set(rule[c]) for c in ("main", "constant", "links", "keep"))
        around = {m[:k] for m in main for k, c in enumerate(m) if c == "/"}

        def walk(tag: Tag, path: str, inside: bool, article: bool) -> None:
            for k in tag.kids:
                if isinstance(k, str):
                    if inside and f"{path}\t{_constant(k)}" not in constant:
                        blocks.append(k)
                    continue
                at = f"{path}/{k.key}"
                if at in main or at in around:
                    walk(k, at, inside or at in main, article or k.name not in ("html", "body"))
                elif inside and at not in links and (at in keep or not k.dropped) and not (k.name in _LEAF and _MARKS.search(k.mark) and k.linked) and (article or k.name != "header"):
                    walk(k, at, True, article)

        walk(page, "", "" in main, False)

    if rule:
        take(rule)
    if not blocks:
        own = rules(expression(page), 1)
        if own != rule:
            take(own)
    return "\n".join(blocks)


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.regexp_replace(host, r"^(www|m)\.", "").alias("host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """Staged (host, pages, rules) of every host."""

    def infer(batches):
        known: dict[str, list] = {}

        def given(known):
            return pa.RecordBatch.from_arrays([pa.array(list(known)), pa.array([n for n, _ in known.values()], pa.int64()), pa.array([json.dumps(w) for _, w in known.values()])], names=["host", "pages", "wrapper"])

        for batch in batches:
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                own = expression(parse(html))
                if host in known:
                    n, w = known[host]
                    known[host] = [n + 1, align(w, own)]
                else:
                    known[host] = [1, own]
            if len(known) > 2_000:
                yield given(known)
                known = {}
        if known:
            yield given(known)

    def merged(keys):
        def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            n, w = 0, None
            for k, x in sorted(zip(rows["pages"], rows["wrapper"], strict=True), key=lambda r: r[1]):
                n, w = n + int(k), json.loads(x) if w is None else align(w, json.loads(x))
            return pd.DataFrame({"host": [key[0]], "pages": [n], "wrapper": [json.dumps(w)]})

        return keys.applyInPandas(each, "host string, pages long, wrapper string")

    first = staged(_with_host(pages).select("host", "html").mapInArrow(infer, "host string, pages long, wrapper string"), "wrappers")
    # many tasks' wrappers of one host meet in groups of FAN on average before they meet at all
    parts = first.groupBy("host").agg(F.ceil(F.count("*") / F.lit(FAN)).cast("long").alias("parts"))
    salted = first.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.col("parts")))
    out = merged(merged(salted.select("host", "part", "pages", "wrapper").groupBy("host", "part")).groupBy("host"))
    rule = F.pandas_udf(lambda w, n: pd.Series([json.dumps(rules(json.loads(x), int(k))) for x, k in zip(w, n, strict=True)]), "string")
    return staged(out.select("host", "pages", rule("wrapper", "pages").alias("rules")), "wrapper-rules")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null and empty html give an empty text.  Pages without a url, or with one
    that has no host, share the wrapper of the empty host.  Repeated rows are
    extracted alike.  An empty table gives no rows.  Other columns are not read.
    """
    spark = pages.sparkSession
    found = wrappers(pages)
    few = (found.agg(F.sum(F.length("rules") + F.length("host") + 100)).first()[0] or 0) <= BROADCAST
    shared = spark.sparkContext.broadcast({r.host: json.loads(r.rules) for r in found.collect()}) if few else None
    rows = _with_host(pages)
    rows = rows if few else rows.join(found.select("host", "rules"), "host", "left")

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, host = batch.column("html").to_pylist(), batch.column("host").to_pylist()
            own = [shared.value.get(h) for h in host] if few else [json.loads(r) if r else None for r in batch.column("rules").to_pylist()]
            text = [text_of(parse(h), r) if h else "" for h, r in zip(html, own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(each, "page_id long, url string, text string, n_chars long")
