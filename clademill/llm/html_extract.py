"""Main text of web pages by union-free regular-expression inference.

A page becomes a stream of tags and text slots, in which consecutive equal groups are folded into a repeat. The streams of one host
are aligned one after the other: what both have stays, a slot whose text differs becomes variable, what only one has becomes
optional, and a group that one has once and the other repeatedly becomes a repeat. The result is the host's wrapper. Wrappers are
merged like pages, so every task first folds its own pages and only wrappers, a few kilobytes each, are gathered by host.

A page is then aligned with its host's wrapper. The main text is what stands in the container whose variable slots hold most text
over all pages; slots that say the same on all pages are template, at whatever place in the container. Elements whose tag, role or class
name tells that they are menus, forms, notices, comments and the like are left out before.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import materialise

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_NUMBER = re.compile(r"\d+")
RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes, if it is open further in than the listed bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
DROPPED = frozenset("head script style noscript template iframe noframes svg math object embed applet canvas audio video map nav footer aside form fieldset button select option datalist textarea input menu dialog search title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar\w*|side-bar|menu\w*|nav|navbar|navigation|topnav|subnav|breadcrumbs?|foot|footer|site-header|page-header|masthead|topbar|"
    r"cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|comment-?list|respond|replies|disqus|"
    r"search|toolbar|pagination|pager|copyright|disclaimer|widget\w*|skip-link|hidden)(?=$|[\s_-])",
    re.I,
)
#: Inside an article these names leave out nothing, nor does any name an element of text: there the wrapper tells what is template.
_WRAPPED = re.compile(r"(?:^|[\s_-])(?:related|recommended|notices?|alert|disclaimer|copyright|widget\w*|nav|banner|share|sharing|social)(?=$|[\s_-])", re.I)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption label span b i em strong a code small q cite".split())
#: Pages of different content that a wrapper needs before it may call a slot part of the template.
LEAST_PAGES = 5
LONGEST_GROUP = 12
HOSTS_HELD = 2000
#: A wrapper keeps so many nodes at most: beyond, those of the fewest pages are forgotten, and their slots count as content.
MOST_NODES = 600
#: Wrappers of so many bytes in all are broadcast to the pages; beyond, pages meet them in a join.
BROADCAST_BYTES = 16 << 20


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """``kind, name, value``: opening tags with their attributes, closing tags, and texts; comments and the contents of scripts are left out."""
    at, n = 0, len(html)
    while at < n:
        found = _TOKEN.search(html, at)
        if not found:
            yield "text", "", html[at:]
            return
        if found.start() > at:
            yield "text", "", html[at : found.start()]
        at = found.end()
        name = found[2] or found[5]
        if not name:
            if found[0].startswith("<![CDATA["):
                yield "text", "", found[0][9:].removesuffix("]]>").replace("&", "&amp;")
            continue
        name, close, rest = name.lower(), found[1] or found[4], found[3] or found[6] or ""
        if close:
            yield "close", name, ""
            continue
        yield "open", name, rest
        if name in RAW and not rest.rstrip().endswith("/"):
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            at = end.start() if end else n


def attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, a, b, c in _ATTRIBUTE.findall(rest):
        out.setdefault(k.lower(), unescape(a or b or c))
    return out


def label(name: str, rest: str) -> str:
    """A tag as wrappers see it: with its class, id and role, numbers in them made alike."""
    if "=" not in rest:
        return name
    a = attributes(rest)
    return name + "".join(f"{m}{_NUMBER.sub('0', a[k].strip().lower())}" for k, m in (("id", "#"), ("class", "."), ("role", "@")) if a.get(k))


def is_dropped(name: str, rest: str, inside: bool) -> bool:
    """Whether an element and all in it is no main text. ``inside`` an article a header belongs to it."""
    if name in DROPPED or (name == "header" and not inside):
        return True
    if "=" not in rest and "hidden" not in rest:
        return False
    a = attributes(rest)
    if name in ("article", "main", "body", "html"):
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    names = [a[k] for k in ("class", "id") if a.get(k) and _NAMES.search(a[k])]
    return bool(names) and not (inside and (name in TEXTUAL or all(_WRAPPED.search(x) for x in names)))


class Slot:
    """A text of a page with the open elements it stands in."""

    __slots__ = ("text", "path", "dropped", "article", "block", "link")

    def __init__(self, text: str, path: tuple[str, ...], dropped: bool, article: bool, block: int, link: bool):
        self.text, self.path, self.dropped, self.article, self.block, self.link = text, path, dropped, article, block, link


def parse(html: str) -> tuple[list[tuple[str, int]], list[Slot]]:
    """The page's stream of ``key, slot number`` (-1 for tags), and its slots. Broken markup is repaired as browsers do, roughly."""
    stream: list[tuple[str, int]] = []
    slots: list[Slot] = []
    stack: list[tuple[str, str, bool, bool, bool]] = []  # name, label, dropped, in article, in link
    block, path = 0, ()

    def pop(to: int) -> None:
        nonlocal block, path
        if any(x[0] in BLOCKS for x in stack[to:]):
            block += 1
        del stack[to:]
        path = tuple(x[1] for x in stack if x[0] in BLOCKS)

    for kind, name, rest in tokens(html):
        if kind == "text":
            top = stack[-1] if stack else ("", "", False, False, False)
            if rest.strip():
                stream.append(("#", len(slots)))
            slots.append(Slot(rest, path, top[2], top[3], block, top[4]))
        elif kind == "close":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if at >= 0 and (name in BLOCKS or not any(x[0] in BLOCKS for x in stack[at:])):
                pop(at)
                stream.append(("/" + name, -1))
            elif name in BLOCKS:
                block += 1
        else:
            if name in BLOCKS and name not in ("html", "body", "head"):
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), -1)
                if at >= 0 and not any(x[0] in ("td", "th", "button", "caption") for x in stack[at:]):
                    pop(at)
            if name in CLOSES:
                closed, bounds = CLOSES[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in bounds:
                        break
                    if stack[i][0] in closed:
                        pop(i)
                        break
            if name == "body":
                at = next((i for i, x in enumerate(stack) if x[0] == "head"), -1)
                if at >= 0:
                    pop(at)
            tag = label(name, rest)
            stream.append((tag, -1))
            if name in BLOCKS:
                block += 1
            if name == "br":
                slots.append(Slot(" ", path, True, False, block, False))
                if stack:
                    slots[-1].dropped, slots[-1].article = stack[-1][2], stack[-1][3]
                else:
                    slots[-1].dropped = False
            if name in VOID or rest.rstrip().endswith("/") and name not in BLOCKS:
                continue
            top = stack[-1] if stack else ("", "", False, False, False)
            main = name in ("article", "main") or "@main" in tag
            stack.append((name, tag, top[2] or is_dropped(name, rest, top[3]), top[3] or main, top[4] or name == "a"))
            path = tuple(x[1] for x in stack if x[0] in BLOCKS)
    return stream, slots


def fold(stream: list[tuple[str, int]]) -> list[tuple[object, tuple[int, ...]]]:
    """``key, slot numbers``: the stream with consecutive equal groups folded into repeats; a repeat's key is the tuple of the group's keys."""
    out: list[tuple[object, list[int]]] = []
    keys: list[object] = []
    for key, slot in stream:
        out.append((key, [slot] if slot >= 0 else []))
        keys.append(key)
        size = 1
        while size <= LONGEST_GROUP and size < len(keys):
            before = keys[-size - 1]  # ends the group before, if there is one of this size
            if type(before) is tuple and len(before) == size and before == tuple(keys[-size:]) and before != ("#",):
                out[-size - 1][1].extend(x for _, slots in out[-size:] for x in slots)
                del keys[-size:], out[-size:]
                size = 1
            elif before == keys[-1] and keys[-2 * size : -size] == keys[-size:] and 2 * size <= len(keys) and (size > 1 or type(before) is str and before != "#"):
                group, own = tuple(keys[-size:]), [x for _, slots in out[-2 * size :] for x in slots]
                del keys[-2 * size :], out[-2 * size :]
                keys.append(group)
                out.append((group, own))
                size = 1
            else:
                size += 1
    return out


def _sum(text: str) -> int:
    return zlib.crc32(" ".join(text.split()).encode("utf-8", "replace"))


def _steps(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    """How ``a`` becomes ``b``, as SequenceMatcher tells it."""
    if a == b:
        return [("equal", 0, len(a), 0, len(b))]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    middle = SequenceMatcher(None, a[head : len(a) - tail], b[head : len(b) - tail], autojunk=False).get_opcodes() if head + tail < max(len(a), len(b)) else []
    return [("equal", 0, head, 0, head), *((op, i + head, j + head, k + head, m + head) for op, i, j, k, m in middle), ("equal", len(a) - tail, len(a), len(b) - tail, len(b))]


def _places(own: tuple[int, ...], slots: list[Slot]) -> list[tuple[list[int], set[tuple[int, int]]]]:
    """The blocks of text that a repeat's slots make up, each with its checksum at its place from the start and from the end."""
    blocks: dict[int, list[int]] = {}
    for s in own:
        blocks.setdefault(slots[s].block, []).append(s)
    out = []
    for k, held in enumerate(blocks.values()):
        text = _sum(" ".join(slots[s].text for s in held))
        out.append((held, {(k, text), (k - len(blocks), text)}))
    return out


class Node:
    """A tag, a slot or a repeat of a wrapper. ``constant``: the checksum of its texts if they have been the same on all pages so far.
    ``chars``: how much text outside links its slots held, by the container they stood in. ``steady``: the places of a repeat's blocks,
    counted from its start and from its end, with the checksums that all pages so far have there."""

    __slots__ = ("key", "constant", "optional", "count", "chars", "steady")

    def __init__(self, key: object, constant: int | None, optional: bool, count: int, chars: dict[str, int], steady: set[tuple[int, int]] = frozenset()):
        self.key, self.constant, self.optional, self.count, self.chars, self.steady = key, constant, optional, count, chars, steady

    def add(self, other: Node) -> None:
        self.steady &= other.steady
        self.constant = self.constant if self.constant == other.constant else None
        self.optional |= other.optional
        self.count += other.count
        for k, n in other.chars.items():
            self.chars[k] = self.chars.get(k, 0) + n


class Wrapper:
    """The aligned ``nodes`` of a host's pages, and checksums of the texts of up to ``LEAST_PAGES`` different ones."""

    def __init__(self, nodes: list[Node], pages: list[int]):
        self.nodes, self.pages = nodes, pages
        self.known: bool | None = None

    @staticmethod
    def of(page: tuple[list[tuple[str, int]], list[Slot]]) -> Wrapper:
        stream, slots = page
        nodes = []
        for key, own in fold(stream):
            chars: dict[str, int] = {}
            for s in (slots[i] for i in own):
                if not s.dropped and not s.link:
                    where = _container(s.path)
                    chars[where] = chars.get(where, 0) + len(s.text.strip())
            nodes.append(Node(key, _sum(" ".join(slots[i].text for i in own)) if own else None, False, 1, chars, set().union(*(x for _, x in _places(own, slots))) if isinstance(key, tuple) else set()))
        return Wrapper(nodes, [_sum(" ".join(s.text for s in slots))])

    def merge(self, other: Wrapper) -> Wrapper:
        """Aligns another wrapper (or page) with this one."""
        self.pages, self.known = sorted({*self.pages, *other.pages})[:LEAST_PAGES], None
        a, b = [x.key for x in self.nodes], [x.key for x in other.nodes]
        nodes: list[Node] = []
        for op, i, j, k, m in _steps(a, b):
            mine, theirs = self.nodes[i:j], other.nodes[k:m]
            if op == "equal":
                for x, y in zip(mine, theirs, strict=True):
                    x.add(y)
                nodes += mine
            elif (one := _repeat(mine, theirs) or _repeat(theirs, mine)) is not None:
                nodes.append(one)
            else:
                for x in (*mine, *theirs):
                    x.optional = True
                nodes += [*mine, *theirs]
        if len(nodes) > MOST_NODES:
            least = sorted((x.count for x in nodes), reverse=True)[MOST_NODES - 1]
            room = MOST_NODES - sum(x.count > least for x in nodes)
            kept = []
            for x in nodes:
                if x.count > least or (x.count == least and room > 0):
                    room -= x.count == least
                    kept.append(x)
            nodes = kept
        self.nodes = nodes
        return self

    def container(self) -> str:
        """Where the main text is: the path of blocks whose variable slots hold most text outside links; empty if there is none."""
        weight: dict[str, int] = {}
        for x in self.nodes:
            if x.constant is None or not self.knows_template():
                for k, n in x.chars.items():
                    weight[k] = weight.get(k, 0) + n
        return max(sorted(weight), key=weight.get, default="")

    def knows_template(self) -> bool:
        """Whether what is the same on all pages is template: there are enough of them, and they aren't copies of one page, whose
        variable slots hold less text than the others."""
        if self.known is None:
            size = [0, 0]
            for x in self.nodes:
                size[x.constant is None] += sum(x.chars.values())
            self.known = len(self.pages) >= LEAST_PAGES and size[True] >= size[False]
        return self.known

    def template_slots(self, stream: list[tuple[object, tuple[int, ...]]], slots: list[Slot]) -> set[int]:
        """The page's slots that align with a node that says the same on all pages, and do so themselves."""
        if not self.knows_template():
            return set()
        out: set[int] = set()
        for op, i, j, k, m in _steps([x.key for x in self.nodes], [key for key, _ in stream]):
            if op == "equal":
                for node, (_, own) in zip(self.nodes[i:j], stream[k:m], strict=True):
                    if node.steady and not node.optional:
                        out.update(x for held, place in _places(own, slots) if place & node.steady for x in held)
                    if own and node.constant is not None and not node.optional and node.constant == _sum(" ".join(slots[s].text for s in own)):
                        out.update(own)
        return out

    def to_json(self) -> str:
        return json.dumps([[[x.key, x.constant, x.optional, x.count, x.chars, sorted(x.steady)] for x in self.nodes], self.pages])

    @staticmethod
    def from_json(text: str) -> Wrapper:
        def key(x: object) -> object:
            return tuple(map(key, x)) if isinstance(x, list) else x

        nodes, pages = json.loads(text)
        return Wrapper([Node(key(k), c, o, n, w, set(map(tuple, t))) for k, c, o, n, w, t in nodes], pages)


def _repeat(one: list[Node], other: list[Node]) -> Node | None:
    """The repeat in ``one`` that ``other`` has once, with the latter's text added."""
    if len(one) == 1 and isinstance(one[0].key, tuple) and one[0].key == tuple(x.key for x in other):
        texts = [x.constant for x in other if x.chars or x.constant is not None]
        both = {(0, texts[0]), (-1, texts[0])} if len(texts) == 1 else set()
        one[0].steady &= both
        both = one[0].steady
        for x in other:
            one[0].add(Node(x.key, None, x.optional, 0, x.chars))
        one[0].steady = both
        one[0].count += 1
        return one[0]
    return None


def _container(path: tuple[str, ...]) -> str:
    """The blocks around a text, without the innermost ones that hold single paragraphs."""
    at = len(path)
    while at and path[at - 1].split("#")[0].split(".")[0] in ("p", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td", "tr", "tbody", "dd", "dt", "dl", "figure", "figcaption"):
        at -= 1
    return "/".join(path[:at])


def extract(html: str, wrapper: Wrapper | None = None) -> str:
    """The main text of one page, given its host's wrapper; without one, or where nothing stands in the wrapper's container, the page's own is used."""
    page = parse(html)
    slots = page[1]
    live = [n for n, s in enumerate(slots) if not s.dropped]
    template = wrapper.template_slots(fold(page[0]), slots) if wrapper else set()
    chosen: list[Slot] = []
    for w in (wrapper, None):
        container = (w or Wrapper.of(page)).container() if w or not chosen else ""
        inside = [n for n in live if (_container(slots[n].path) + "/").startswith(container + "/")] if container else live
        chosen = [slots[n] for n in inside if n not in template]
        if any(s.text.strip() for s in chosen):
            break
    if not any(s.article for s in chosen):
        # outside an article, blocks that are mostly links are menus
        linked: dict[int, list[int]] = {}
        for s in chosen:
            size = linked.setdefault(s.block, [0, 0])
            size[s.link] += len(s.text.strip())
        chosen = [s for s in chosen if linked[s.block][1] <= linked[s.block][0] or linked[s.block][1] == 0]
    blocks: list[list[str]] = []
    last = None
    for s in chosen:
        if s.block != last:
            blocks.append([])
            last = s.block
        blocks[-1].append(s.text)
    texts = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def host_of(url: str = "url"):
    """The host of an address in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Wrapper] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([w.to_json() for w in held.values()])], names=["host", "wrapper"])
            held.clear()

    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = Wrapper.of(parse(html.as_py()))
            held[host] = held[host].merge(page) if host in held else page
        if len(held) >= HOSTS_HELD:
            yield from flush()
    yield from flush()


def _join_wrappers(frame: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for text in sorted(frame["wrapper"]):
        one = Wrapper.from_json(text)
        whole = whole.merge(one) if whole else one
    return pd.DataFrame({"host": frame["host"].iloc[:1], "wrapper": [whole.to_json()]})


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html", salts: int = 64) -> DataFrame:
    """``host, wrapper``: one wrapper per host; pages without an address have none. Pages are folded per task, then by host and salt, then by host."""
    source = pages.where(F.col(html).isNotNull()).select(host_of(url).alias("host"), F.col(html).alias("html")).where("host <> ''")
    partial = source.mapInArrow(_learn, "host string, wrapper string")
    partial = partial.withColumn("salt", F.pmod(F.crc32("wrapper"), F.lit(salts)))
    partial = partial.groupBy("host", "salt").applyInPandas(_join_wrappers, "host string, wrapper string")
    return partial.groupBy("host").applyInPandas(_join_wrappers, "host string, wrapper string")


def main_text(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A null or empty page, and one without main text, has the empty text. Pages without an address are taken by themselves. Very long pages
    are read whole; repeated rows and null ids are kept; other columns are ignored; an empty table gives an empty one. Html isn't
    shuffled while all wrappers together have at most ``BROADCAST_BYTES``.
    """
    wrappers = materialise(infer_wrappers(pages, url, html), "wrappers")
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host_of(url).alias("host"))
    small = (wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0) <= BROADCAST_BYTES
    joined = source.join(F.broadcast(wrappers) if small else wrappers.hint("shuffle_hash"), "host", "left").select("page_id", "url", "html", "host", "wrapper")
    schema = joined.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper | None] = {}
        for batch in batches:
            texts = []
            for page, host, wrapper in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if host not in known:
                    if len(known) >= HOSTS_HELD:
                        known.clear()
                    found = wrapper.as_py()
                    known[host] = Wrapper.from_json(found) if found else None
                texts.append(extract(page.as_py(), known[host]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, schema)
