"""Main text of web pages by wrappers: union-free regular expressions that are inferred per host.

Pages become trees of elements and texts. All pages of a host are aligned, from the root down: at each element equal children stay, differing texts become slots, runs that follow one another become repeated groups, and what only
one side has becomes optional. The wrapper then says where the article is: the article and main elements, or else the
narrowest element that holds nearly all text in slots. Each page of the host is aligned with the wrapper in the same way, and
the text of the elements that meet the wrapper's article is read in blocks, without containers for navigation, footers,
adverts, notices, forms, comments and the like. A class or id marks such a container only if it holds less than half of the
text. Where the article isn't marked up, texts that every page has in the same place are the wrapper's and not the article's.

A page that doesn't fit the wrapper of its host, and the page of a host with no other, is its own wrapper. If more than half of
a host's long texts are on all of its pages, they are near copies and count as one page. Pages of one shape, that is of the same
elements, are put together where they are read; the wrappers of shapes are merged in rounds, in an order that their hashes give,
so a wrapper doesn't depend on how pages are dealt and no task gets a host whole. A host's pages with an article or main tag have
a wrapper, and its others have another. All pages are extracted, whole. Null html is an
empty page, a null url is a host of its own. Repeated rows are extracted each. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewind.llm.arrays import Store
from cubewind.llm.tables import in_batches, keep, place

#: In each round the wrappers of a host's shapes are merged to so many at most; characters of pages of different shapes that a
#: task holds, and into how many the tasks that have read pages of one shape are dealt first.
ROUNDS = (4096, 64, 1)
HELD = 4_000_000
DEALT = 16
#: If an element of a wrapper of several shapes has more children, it is described by its kinds of children.
KINDS = 500
#: A long text has more characters.
LONG = 40
#: Children that a repeated group has at most, levels of elements that a wrapper describes one by one, and how many children
#: two elements have at most (multiplied) for their common children to be sought anywhere and not at both ends only.
LONGEST_GROUP = 6
LEVELS = 150
ALIGNED = 4_000_000
#: How much of an element's text in slots a child must hold to be the article instead.
NEARLY_ALL = 0.8
#: Wrappers in one file.
PART = 50_000

# Fixed lists of element names and of words in class, id and role
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("aside button canvas dialog footer form head header iframe menu nav noscript object script select style svg template textarea title".split())
MARKED = frozenset(
    "ad ads advert advertisement advertising adverts alert alertdialog banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus disclaimer footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that a marked class name may have besides: "related-posts" is marked, "related-work" and "has-sidebar" aren't
STRUCTURE = frozenset(
    "area article articles bar block body bottom box bx button buttons col column container content count div entries entry feed footer form group head header holder icon icons inline inner item items left link links list main module outer page panel post posts right row section site stories story strip tabs text thread title top widget wrap wrapper".split()
)
#: An element that holds all of these that a page or article has is never left out, whatever its class says
LANDMARKS = frozenset("article main h1".split())
CONTAINERS = frozenset("div section table tr td ul ol dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_INLINE = frozenset("a b em font i li option p small span strong u".split())
# the last form of a tag is for pages in which a quotation mark is left open
_QUOTED = re.compile(r"""<(/?)([a-zA-Z][\w:-]*+)((?:[^<>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)([^<>]*+)>?")
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}


def label(name: str, attributes: str) -> str:
    """'!' if class, id or role mark an element as no article, then '.' and the letters of its first class or id."""
    values = [x for g in _MARK.findall(attributes) for x in g if x]
    words = [[w for w in re.split(r"[^a-z]+", x) if w] for x in " ".join(values).lower().split()]
    marked = any(MARKED.intersection(w) and STRUCTURE.union(MARKED).issuperset(w) for w in words)
    first = re.sub(r"[^a-z_-]+", "", values[0].split()[0].lower()) if values and values[0].split() and name in CONTAINERS else ""
    return ("!" if marked else "") + (f".{first}" if first else "")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', raw text, ''), ('open', name, label) and ('close', name, ''). Each character is read a bounded number of
    times, whatever the page."""
    at = begin = 0
    tag = _QUOTED
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            found = None
        elif page.startswith(("<!", "<?"), at):
            if (end := page.find(">", at)) < 0:
                break
            end, found = end + 1, None
        elif page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] == "/":
            if not (found := tag.match(page, at)):
                if tag is _QUOTED and "=" in (more := _PLAIN.match(page, at) or [""])[0] and '"' in more[0] + "'":
                    tag = _PLAIN
                    continue
                at += 1
                continue
            end = found.end()
        else:
            at += 1
            continue
        if at > begin:
            yield "text", page[begin:at], ""
        at = begin = end
        if found:
            name = found[2].lower()
            if found[1]:
                yield "close", name, ""
                continue
            yield "open", name, label(name, found[3]) if found[3] else ""
            if name in _RAW:
                close = _RAW[name].search(page, at)
                at = begin = close.end() if close else len(page)
                yield "close", name, ""
            elif found[3].endswith("/") and name not in VOID:
                yield "close", name, ""
    if begin < len(page):
        yield "text", page[begin:], ""


@dataclass(eq=False, slots=True)
class Node:
    """An element of a page, or a text if name is empty."""

    name: str
    label: str = ""
    text: str = ""
    kids: list[Node] = field(default_factory=list)
    size: int = 0  # characters of text that isn't in skipped elements
    landmarks: int = 0  # unmarked landmarks in it, itself included

    @property
    def key(self) -> str:
        return self.name + self.label

    @property
    def marked(self) -> bool:
        return self.label.startswith("!")


def parse(page: str, marks: bool = True) -> Node:
    """The elements of a page; without marks, no class, id or role says that one is no article."""
    root = Node("#root")
    stack, open_ = [root], Counter()

    def close() -> None:
        node = stack.pop()
        open_[node.name] -= 1
        node.landmarks += node.name in LANDMARKS and not node.marked
        stack[-1].landmarks += node.landmarks
        if node.name not in SKIPPED:
            stack[-1].size += node.size

    for kind, value, own in tokens(page):
        if kind == "text":
            stack[-1].kids.append(Node("", text=value))
            stack[-1].size += len(value.strip())
        elif kind == "close":
            if open_[value]:
                while stack[-1].name != value:
                    close()
                close()
        else:
            if value in ("p", "li", "option") and any(n.name == value for n in stack[-6:]):
                while stack[-1].name in _INLINE:
                    last = stack[-1].name
                    close()
                    if last == value:
                        break
            node = Node(value, own.lstrip("!") if value in ("html", "body", "main") or not marks else own)
            stack[-1].kids.append(node)
            if value not in VOID:
                stack.append(node)
                open_[value] += 1
    while len(stack) > 1:
        close()
    return root


def said(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def fold(kids: list[Node]) -> list[tuple[str, list[Node], bool]]:
    """(key, nodes, whether the next one is in the same group): runs of children that follow one another are one group."""
    kids = [n for n in kids if n.name or n.text.strip()]
    keys = [n.key for n in kids]
    out = []
    k = 0
    while k < len(kids):
        for size in range(1, min(LONGEST_GROUP, (len(kids) - k) // 2) + 1):
            group = keys[k : k + size]
            if group[0] and group == keys[k + size : k + 2 * size]:
                z = k + 2 * size
                while keys[z : z + size] == group:
                    z += size
                out += [(key, kids[k + i : z : size], i + 1 < size) for i, key in enumerate(group)]
                k = z
                break
        else:
            out.append((keys[k], [kids[k]], False))
            k += 1
    return out


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of common children, in order."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    if len(a) * len(b) <= ALIGNED:
        return [(m.a + i, m.b + i) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for i in range(m.size)]
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    return [(i, i) for i in range(head)] + [(len(a) - i, len(b) - i) for i in range(tail, 0, -1)]


@dataclass(eq=False, slots=True)
class Part:
    """A part of a wrapper: an element, or a text if key is empty; then text is None in a slot."""

    key: str
    text: str | None = None
    kids: list[Part] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    joined: bool = False  # in one group with the next part
    chars: int = 0
    landmarks: int = 0
    article: bool = False

    @property
    def name(self) -> str:
        return re.split("[!.]", self.key)[0]

    @property
    def marked(self) -> bool:
        return "!" in self.key


def part_of(nodes: list[Node], level: int = 0) -> Part:
    """The wrapper of one element, or of the elements of a repeated group."""
    out = None
    for n in nodes:
        if not n.name:
            own = Part("", said(n.text), chars=len(n.text.strip()))
        else:
            own = Part(n.key, chars=n.size, landmarks=n.landmarks)
            for _, same, joined in fold(n.kids) if level < LEVELS else ():
                kid = part_of(same, level + 1)
                kid.repeated, kid.joined = len(same) > 1 or (bool(own.kids) and own.kids[-1].joined), joined
                own.kids.append(kid)
        out = own if out is None else merge(out, own)
    return out


def merge(a: Part, b: Part) -> Part:
    """The wrapper of both."""
    out = Part(a.key, a.text if a.text == b.text else None, [], a.optional or b.optional, a.repeated or b.repeated, a.joined or b.joined, a.chars + b.chars, a.landmarks + b.landmarks)

    def lone(parts: list[Part]) -> None:
        for p in parts:
            if out.kids and out.kids[-1].repeated and not out.kids[-1].joined and out.kids[-1].key == p.key:
                out.kids[-1] = merge(out.kids[-1], p)  # one more of a repeated group
            else:
                p.optional = True
                out.kids.append(p)

    i = j = 0
    for x, y in [*common([k.key for k in a.kids], [k.key for k in b.kids]), (len(a.kids), len(b.kids))]:
        lone(a.kids[i:x])
        lone(b.kids[j:y])
        if x < len(a.kids):
            out.kids.append(merge(a.kids[x], b.kids[y]))
        i, j = x + 1, y + 1
    return out


def overlaid(a: Part, b: Part) -> Part:
    """merge() of wrappers of one shape, in the first one; in any order it gives the same."""
    if a.key != b.key or len(a.kids) != len(b.kids):
        return merge(a, b)
    a.text = a.text if a.text == b.text else None
    a.chars += b.chars
    a.landmarks += b.landmarks
    a.kids = [overlaid(x, y) for x, y in zip(a.kids, b.kids, strict=True)]
    return a


def by_kind(part: Part) -> Part:
    """Elements with more than KINDS children get one optional repeated child for each kind."""
    if len(part.kids) > KINDS:
        kinds: dict[str, Part] = {}
        for k in part.kids:
            kinds[k.key] = merge(kinds[k.key], k) if k.key in kinds else k
        part.kids = list(kinds.values())
        for k in part.kids:
            k.optional, k.repeated, k.joined = True, True, False
    part.kids = [by_kind(k) for k in part.kids]
    return part


@dataclass(slots=True)
class Pages:
    """The wrapper of some pages of a host, their number, how many long texts they have, the least and greatest of their hashes, and
    the hashes of the long texts that all of them have."""

    wrapper: Part
    pages: int
    long: int
    least: int
    most: int
    shared: list[int]

    def add(self, other: Pages, same: bool) -> Pages:
        """same: both are of one shape."""
        wrapper = overlaid(self.wrapper, other.wrapper) if same else by_kind(merge(self.wrapper, other.wrapper))
        return Pages(wrapper, self.pages + other.pages, self.long + other.long, min(self.least, other.least), max(self.most, other.most), sorted({*self.shared}.intersection(other.shared)))

    def different(self) -> int:
        """The number of pages; 1 if they are copies or near copies of one."""
        return 1 if self.least == self.most or 2 * len(self.shared) * self.pages > self.long else self.pages


def one_page(page: Node, h: int) -> Pages:
    todo, long = [page], set()
    while todo:
        node = todo.pop()
        todo += [k for k in node.kids if k.name not in SKIPPED]
        if not node.name and len(node.text) > LONG:
            long.add(said(node.text))
    return Pages(part_of([page]), 1, len(long), h, h, sorted(map(_hash, long)))


def infer(pages: list[Node]) -> tuple[Part, int]:
    """The wrapper of the pages of a host and the number of pages that it is of; near copies of a page count as that page."""
    found = reduce(lambda a, b: a.add(b, False), [one_page(page, k) for k, page in enumerate(pages)])
    return found.wrapper, found.different()


def no_article(part: Part | Node, landmarks: int) -> bool:
    """Whether a part is marked and doesn't hold all landmarks of what it is in."""
    return part.marked and not (landmarks and part.landmarks == landmarks)


def in_slots(part: Part, alone: bool, landmarks: int, memo: dict[int, int]) -> int:
    """Characters in slots, outside of what can't be an article. alone: of one page, all text counts."""
    if (got := memo.get(id(part))) is None:
        if part.name in SKIPPED or no_article(part, landmarks):
            got = 0
        elif not part.key:
            got = part.chars if alone or part.text is None or part.repeated else 0
        elif not part.kids:
            got = part.chars
        else:
            got = sum(in_slots(k, alone, landmarks, memo) for k in part.kids)
        memo[id(part)] = got
    return got


def find_article(wrapper: Part, pages: int) -> list[str]:
    """Mark the article in the wrapper; returns the wrapper's own texts that aren't the article's."""
    landmarks, memo = wrapper.landmarks, {}
    slots = lambda p: in_slots(p, pages == 1, landmarks, memo)
    todo, marked = [wrapper], []
    while todo:
        part = todo.pop()
        if part.name in ("article", "main") and part.chars and not no_article(part, landmarks):
            marked.append(part)
        elif part.name not in SKIPPED and not no_article(part, landmarks):
            todo += part.kids
    for part in marked:
        part.article = True
    if marked:
        return []
    part = wrapper
    while (best := max(part.kids, key=slots, default=None)) is not None:
        rest = [k for k in part.kids if k is not best and slots(k)]
        if not best.key or best.repeated or not slots(best) or slots(best) < NEARLY_ALL * slots(part) or any(k.name in HEADINGS for k in rest):
            break
        part = best
    part.article = True
    fixed, todo = set(), [part] if pages > 1 else []
    while todo:
        own = todo.pop()
        todo += [] if own.repeated else own.kids
        if own.text and not own.optional and not own.repeated:
            fixed.add(own.text)
    return sorted(fixed)


def expression(wrapper: Part) -> str:
    """The wrapper as one regular expression over pages without comments and void elements' slashes."""
    out, group = "", ""
    for k in wrapper.kids:
        if k.key:
            own = rf"<{k.name}\b[^>]*>\s*{expression(k)}" + ("" if k.name in VOID else rf"(?:</{k.name}>)?\s*")
        else:
            own = "([^<]*)" if k.text is None else r"\s*" + r"\s+".join(re.escape(w) for w in k.text.split(" ")) + r"\s*"
        group += own if not k.optional or k.joined or group else f"(?:{own})?" if not k.repeated else own
        if not k.joined:
            out += f"(?:{group}){'*' if k.optional else '+'}" if k.repeated else group
            group = ""
    return out


def pruned(part: Part) -> dict | None:
    """What of a wrapper leads to the article: {k: key, a: is the article, c: children}."""
    if part.article:
        return {"k": part.key, "a": 1}
    kids = [pruned(k) for k in part.kids]
    return {"k": part.key, "c": [x or {"k": k.key} for x, k in zip(kids, part.kids, strict=True)]} if any(kids) else None


def articles(page: Node, way: dict) -> list[Node]:
    """The elements of a page that meet the wrapper's article."""
    out, todo = [], [(page, way)]
    while todo:
        node, own = todo.pop()
        if "a" in own:
            out.append(node)
            continue
        items = fold(node.kids)
        met = dict(common([x["k"] for x in own["c"]], [key for key, _, _ in items]))
        for k in reversed(range(len(own["c"]))):
            wanted = own["c"][k]
            if "a" in wanted or "c" in wanted:
                same = items[met[k]][1] if k in met else [n for n in node.kids if n.key == wanted["k"]]
                todo += [(n, wanted) for n in reversed(same)]
    return out


def blocks(article: Node) -> Iterator[str]:
    """The text of an article, block by block."""
    block: list[str] = []
    inside = article.landmarks - (article.name in LANDMARKS and not article.marked)
    todo: list[tuple[Node | None, bool]] = [(article, False)]  # None ends a block; whether only headings count
    while todo:
        node, headings = todo.pop()
        if node is not None and not node.name:
            if not headings:
                block.append(entities.unescape(node.text))
            continue
        if node is None or node.name in BLOCKS:
            if value := " ".join("".join(block).split()):
                yield value
            block = []
        if node is None:
            continue
        top = node is article
        if not top and node.name == "header":
            headings = True
        elif not top and (node.name in SKIPPED or no_article(node, inside)):
            continue
        if node.name in HEADINGS:
            headings = False
        if node.name in BLOCKS:
            todo.append((None, False))
        todo += [(k, headings) for k in reversed(node.kids)]
    if value := " ".join("".join(block).split()):
        yield value


def extract(page: str, way: dict | None, fixed: frozenset[str] = frozenset()) -> str:
    """The article of a page by the wrapper of its host; by its own if it doesn't fit or there is none. A page whose whole text is
    in marked elements is read without marks."""
    text = _extract(parse(page), way, fixed)
    return text or _extract(parse(page, marks=False), None, frozenset())


def _extract(root: Node, way: dict | None, fixed: frozenset[str]) -> str:
    found = [n for n in articles(root, way) if n.size] if way else []
    if not found:
        own, _ = infer([root])
        find_article(own, 1)
        found, fixed = articles(root, pruned(own)), frozenset()
    return "\n".join(b for n in found for b in blocks(n) if b not in fixed)


def shape(part: Part) -> str:
    """A wrapper without texts and numbers."""
    return f"{part.key}{'?' * part.optional}{'+' * part.repeated}{'&' * part.joined}({','.join(map(shape, part.kids))})"


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _listed(p: Part) -> list:
    return [p.key, p.text, p.optional + 2 * p.repeated + 4 * p.joined, p.chars, p.landmarks, list(map(_listed, p.kids))]


def _part(x: list) -> Part:
    return Part(x[0], x[1], list(map(_part, x[5])), bool(x[2] & 1), bool(x[2] & 2), bool(x[2] & 4), x[3], x[4])


_PAGES = {"host": pa.string(), "shape": pa.int64(), "part": pa.string(), "pages": pa.int64(), "long": pa.int64(), "least": pa.int64(), "most": pa.int64(), "shared": pa.list_(pa.int64())}
_PAGES_DDL = "host string, shape long, part string, pages long, long long, least long, most long, shared array<long>"


def _rows(found: list[tuple[str, int, Pages]]) -> dict[str, pa.Array]:
    columns = zip(*((host, key, json.dumps(_listed(x.wrapper)), x.pages, x.long, x.least, x.most, x.shared) for host, key, x in found), strict=True)
    return {name: pa.array(own, kind) for own, (name, kind) in zip(columns, _PAGES.items(), strict=True)}


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages by host and shape."""
    held: dict[tuple[str, int], Pages] = {}
    chars = 0
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            own = one_page(parse(page), _hash(page))
            key = host, _hash(shape(own.wrapper))
            if key in held:
                held[key] = held[key].add(own, True)
            else:
                held[key] = own
                chars += len(page) + 1000
            if chars > HELD:
                yield pa.RecordBatch.from_pydict(_rows([(*k, x) for k, x in held.items()]))
                held, chars = {}, 0
    if held:
        yield pa.RecordBatch.from_pydict(_rows([(*k, x) for k, x in held.items()]))


def _united(buckets: int | None):
    """One row for all rows of a host: those of one shape first, then shapes in the order of their hashes or numbers of buckets."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in _PAGES), strict=True), key=lambda r: r[1])
        out = None
        for key, same in groupby(rows, key=lambda r: r[1]):
            own = reduce(lambda a, b: a.add(b, True), (Pages(_part(json.loads(part)), *numbers) for _, _, part, *numbers in same))
            out = own if out is None else out.add(own, False)
        return pa.table(_rows([(rows[0][0], key % buckets if buckets else key, out)]))

    return run


_FOUND = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("pages", pa.int64()), ("way", pa.string()), ("fixed", pa.string())])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, _, part, *numbers in zip(*(batch.column(c).to_pylist() for c in _PAGES), strict=True):
            found = Pages(_part(json.loads(part)), *numbers)
            fixed = find_article(found.wrapper, found.different())
            rows.append((host, expression(found.wrapper), found.pages, json.dumps(pruned(found.wrapper)), json.dumps(fixed)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


def with_host(pages: DataFrame) -> DataFrame:
    """Pages of a host with an article or main tag have a wrapper of their own: "/article" follows their host."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    page = F.coalesce("html", F.lit(""))
    host = F.concat(host, F.when(page.rlike(r"(?i)<(article|main)[\s/>]"), "/article").otherwise(""))
    return pages.select("page_id", "url", page.alias("html"), host.alias("host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (regular expression), pages, way (the path to the article), fixed (texts of the wrapper), from all pages of each
    host."""
    found = in_batches(pages.select("host", "html"), _shapes, _PAGES_DDL).withColumn("dealt", F.pmod(F.spark_partition_id(), F.lit(DEALT)))
    found = found.groupBy("host", "shape", "dealt").applyInArrow(_united(None), _PAGES_DDL)
    for buckets in ROUNDS:
        found = found.withColumn("bucket", F.pmod("shape", F.lit(buckets).cast("long"))).groupBy("host", "bucket").applyInArrow(_united(buckets), _PAGES_DDL)
    return found.mapInArrow(_finished, "host string, wrapper string, pages long, way string, fixed string")


class Wrappers:
    """Wrappers by host, as sorted hash arrays that workers map, so pages needn't be joined with them."""

    def __init__(self, store: Store, parts: int):
        self.store, self.parts = store, parts

    def write(self, table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        key = table.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        texts = [x.encode() for x in table.column("json").take(pa.array(order)).to_pylist()]
        self.store.put(f"key-{part}", key[order])
        self.store.put(f"at-{part}", np.cumsum([0, *map(len, texts)]))
        self.store.put(f"json-{part}", np.frombuffer(b"".join(texts), np.uint8))
        return pa.table([pa.array([part], pa.int64()), pa.array([len(key)], pa.int64())], names=["part", "size"])

    def find(self, host: str, key: int) -> tuple[dict | None, frozenset[str]]:
        part = key % self.parts
        keys = _array(self.store.uri, f"key-{part}", "<i8")
        for k in range(*(int(np.searchsorted(keys, key, side)) for side in ("left", "right"))):
            a, z = _array(self.store.uri, f"at-{part}", "<i8")[k : k + 2].tolist()
            name, way, fixed = json.loads(_array(self.store.uri, f"json-{part}", "u1")[a:z].tobytes())
            if name == host:
                return json.loads(way), frozenset(json.loads(fixed))
        return None, frozenset()


@lru_cache(maxsize=300)
def _array(uri: str, name: str, kind: str) -> np.ndarray:
    return Store(uri).get(name, kind)


def stored(found: DataFrame) -> Wrappers:
    """The wrappers in the shared folder."""
    found = keep(found.select("host", F.xxhash64("host").alias("key"), F.to_json(F.array("host", "way", "fixed")).alias("json")), "wrappers")
    out = Wrappers(Store(place(found.sparkSession, "wrappers")).made(), max(1, -(-found.count() // PART)))
    dealt = found.withColumn("part", F.pmod("key", F.lit(out.parts).cast("long")))
    dealt.groupBy("part").applyInArrow(lambda table: out.write(table), "part long, size long").agg(F.sum("size")).collect()
    return out


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    pages = with_host(pages)
    known = stored(wrappers(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = lru_cache(maxsize=10_000)(known.find)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("html", "host", "key")), strict=True)
            out = [extract(page, *find(host, key)) for page, host, key in rows]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    columns = [F.col("page_id").cast("long").alias("page_id"), "url", "html", "host", F.xxhash64("host").alias("key")]
    return in_batches(pages.select(*columns), run, "page_id long, url string, text string, n_chars long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
