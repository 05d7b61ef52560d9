"""Main text of web pages by union-free wrapper inference over same-host pages (operator 2).

A page's token stream is read as a tree of block elements and text blocks (inline markup belongs to its block). Pages
of one host are aligned one after the other. A wrapper level is a union-free expression: an ordered list of parts, each a
labelled element, optional (`?`) where a page lacks it, repeated (`+`) where siblings recur, or a repeated group of optional
elements where they recur out of order. Text that agrees on all pages is a constant, text that differs becomes a
slot (#PCDATA). Each label occurs once a level, so a wrapper is as large as the template, not as the pages, and
merging two wrappers is the same step as aligning a page: tasks fold their pages, and partial wrappers of a host (at most one a
task) are merged in a fixed order, over two rounds. Wrappers also carry how much text and link text each part held.

Extraction walks a page along its host's wrapper. Parts that are menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or reader comments, by element, ARIA role or class words, are never main text. `main` (all of them, whole) or
else `article` is a hint: it is the main part unless a page's share of slot text in it is small for the host. Elsewhere the main
part is the deepest wrapper part that holds most of the host's slot text outside link lists. In either, blocks that all
pages with that part share are template, not article, if the pages have three distinct contents or more (copies of a page count
once), and link lists are left out. A main part left without text gives its own if marked, else the page's non-template text.

Bounds: parsing takes time in proportion to the page whatever its markup. Elements nested deeper than `MAX_DEPTH` join the element at that
depth (as browsers bound a page's tree), with their text. A level of a wrapper with over `MAX_LABELS` labels (class names generated
by page) tells its elements apart by tag alone, so a wrapper stays bounded; which level does depends on the host's pages, not on their order.

Cases: null html = empty html = empty text. A null or odd url has the host ''. A page without markup is its own text. Repeated
pages repeat. Unclosed elements end where HTML ends them; a cut-off tag, comment, script or style at the end is dropped. Other elements whose
content isn't text (svg, iframe, noscript) are left out up to their end tag; closed by `/>` or never closed only the tag is.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: Fixed values of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements never main text.
OUT = frozenset("aside button dialog footer form header input label menu nav search select".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Class or id words (between hyphens, underscores, spaces and case changes) of parts that are not the article.
OUT_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter pager pagination popup promo promoted promotion sidebar signup sponsor sponsored subscribe toolbar".split()
)
#: Words that name such parts alone or beside layout words (`related-posts`), not beside others (`related-work`, `share-price`).
SOME_WORDS = frozenset("banner header notice notices notification related replies reply respond search share sharing social widget".split())
LAYOUT_WORDS = frozenset(
    "area article articles bar block box buttons button container content form group icons inner items left links list main more news outer page pages panel post posts right row section site stories text title top bottom unit wrap wrapper".split()
)
#: A start tag of the key ends an open element of the value (up to the bounding element).
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Comments, tags up to the first `>` outside quotes or else up to the first `>`, and other markup.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:-->|\Z))|<(/?)([a-z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)>)|<[!?/][^>]*+>",
    re.IGNORECASE | re.DOTALL,
)
#: The same for pages where quotes don't match.
LOOSE = re.compile(r"<!--(?:-?>|.*?(?:-->|\Z))|<(/?)([a-z][^\s/>]*+)()([^>]*+)>|<[!?/][^>]*+>", re.IGNORECASE | re.DOTALL)
CUT_TAG = re.compile(r"<[a-z/!?]", re.IGNORECASE)
#: Elements whose content isn't text of the page, and the ends of those.
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.IGNORECASE) for t in "script style noscript template textarea title svg iframe object".split()}
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

TEXT = "#"
#: Shares: of slot text that the main part must hold; of link text that makes a part a link list.
MAIN_SHARE, LINK_SHARE, CONSTANT_PAGES = 0.6, 0.6, 3
#: Share of a page's slot text that `main` or `article` must hold on average to be taken as the main part.
HINT_SHARE = 0.3
#: Levels of a page's tree; open elements that an end tag may reach over; labels a wrapper level tells apart; characters of a label.
MAX_DEPTH, REACH, MAX_LABELS, MAX_LABEL = 200, 512, 64, 120


def host_of(url: Column) -> Column:
    """The host of an address in lower case, '' where it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


class Element:
    """A block element of a page: label, out (never main text), kids (elements, or text blocks as (text, link characters))."""

    __slots__ = ("label", "tag", "out", "kids")

    def __init__(self, tag: str, label: str, out: bool):
        self.tag, self.label, self.out, self.kids = tag, label, out, []


def tells_out(value: str) -> bool:
    """Whether a class or id names a part that is not the article."""
    for name in value.split():
        words = {w.lower() for w in WORD.findall(name)}
        if not OUT_WORDS.isdisjoint(words) or (not SOME_WORDS.isdisjoint(words) and words <= SOME_WORDS | LAYOUT_WORDS):
            return True
    return False


def attributes(raw: str) -> tuple[bool, str]:
    """(out, class words for the label)."""
    if "=" not in raw and "hidden" not in raw:
        return False, ""
    out, label = False, ""
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            out |= tells_out(value)
            if name == "class":
                label = ".".join(sorted({w.lower() for w in WORD.findall(value)}))
                if len(label) > MAX_LABEL:
                    label = block_key(label)
        elif name == "role":
            out |= value.lower() in OUT_ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            out = True
    return out, label


def parse(html: str) -> Element:
    root = Element("", "", False)
    stack, text, links, in_link = [root], [], 0, 0
    opened: dict[str, int] = {}  # open elements by tag

    def end_text():
        nonlocal links
        if text:
            clean = " ".join(unescape("".join(text)).split())
            if clean:
                stack[-1].kids.append((clean, links))
            text.clear()
        links = 0

    def close(depth: int):
        end_text()
        for e in stack[depth:]:
            opened[e.tag] -= 1
        del stack[depth:]

    def end_one(names: set[str], bounds: set[str]):
        if not any(map(opened.get, names)):
            return
        for k in range(len(stack) - 1, max(0, len(stack) - 1 - REACH), -1):
            if stack[k].tag in names:
                close(k)
                return
            if stack[k].tag in bounds:
                return

    def start(tag: str, raw: str):
        nonlocal in_link
        out, words = attributes(raw)
        out |= tag in OUT
        if tag in BLOCKS or out:
            if tag in BLOCKS:
                end_one({"p"}, {"table", "button"})
            if tag in ENDS:
                end_one(*ENDS[tag])
            end_text()
            in_link = in_link if tag not in BLOCKS else 0
            if tag in VOID or (raw.endswith("/") and tag not in BLOCKS):
                return
            above, e = stack[-1], Element(tag, f"{tag}.{words}" if words else tag, out)
            if len(stack) <= MAX_DEPTH:
                above.kids.append(e)
            elif not out:
                e.kids = above.kids
            stack.append(e)
            opened[tag] = opened.get(tag, 0) + 1
        elif tag == "a":
            in_link = 1

    at, loose, endless, dropped = 0, False, set(), False
    last = html.rfind(">") + 1
    while at < last:
        resume = None
        for m in (LOOSE if loose else TOKEN).finditer(html, at, last):
            if m.start() > at:
                text.append(piece := html[at : m.start()])
                links += len(piece) if in_link else 0
            at = m.end()
            tag = m[2]
            if tag is None:
                dropped = html.startswith("<!--", m.start()) and html[at - 3 : at] != "-->" and at - m.start() > 5
                continue
            tag, raw = tag.lower(), m[3] if m[4] is None else m[4]
            if m[1]:  # an end tag
                if tag == "a":
                    in_link = 0
                depth = 0
                if opened.get(tag):
                    depth = next((k for k in range(len(stack) - 1, max(0, len(stack) - 1 - REACH), -1) if stack[k].tag == tag), 0)
                if depth:
                    close(depth)
                elif tag in BLOCKS:
                    end_text()
            elif tag == "br":
                text.append(" ")
            elif tag in RAW_END:
                if (tag in ("script", "style") or not raw.endswith("/")) and tag not in endless:
                    if end := RAW_END[tag].search(html, at):
                        resume = end.end()
                    elif tag in ("script", "style"):
                        resume, dropped = len(html), True
                    else:
                        endless.add(tag)
            else:
                start(tag, raw)
            if m[4] is not None and not loose:  # an open quote: from here on a tag ends at the first `>`
                loose, resume = True, at if resume is None else resume
            if resume is not None:
                at = resume
                break
        else:
            break
    rest = "" if dropped else html[at:]
    if cut := CUT_TAG.search(rest, max(0, last - at)):
        rest = rest[: cut.start()]
    if rest:
        text.append(rest)
    end_text()
    return root


class Part:
    """A wrapper part. parts: ordered [labels, repeated, optional]; kids: the part of each label (once a level); plain: labels are tags alone."""

    __slots__ = ("kids", "parts", "text", "pages", "chars", "links", "out", "common", "seen", "plain")

    def __init__(self, out: bool = False):
        self.kids, self.parts, self.text, self.pages, self.chars, self.links, self.out, self.common, self.seen = {}, [], None, 1, 0, 0, out, frozenset(), frozenset()
        self.plain = False

    # text: None for an element, a digest for a constant, "" for a slot; common: digests of text blocks on all its pages
    # seen: the least CONSTANT_PAGES digests of the distinct contents of its pages

    def packed(self) -> list:
        return [self.parts, self.text, self.pages, self.chars, self.links, int(self.out), {k: v.packed() for k, v in self.kids.items()}, sorted(self.common), sorted(self.seen), int(self.plain)]

    @classmethod
    def unpacked(cls, raw: list) -> Part:
        p = cls(bool(raw[5]))
        p.parts, p.text, p.pages, p.chars, p.links = raw[0], *raw[1:5]
        p.kids, p.common, p.seen = {k: cls.unpacked(v) for k, v in raw[6].items()}, frozenset(raw[7]), frozenset(raw[8])
        p.plain = bool(raw[9])
        return p

    def label(self, e: Element) -> str:
        return plain_label(e.tag, e.out) if self.plain else e.label

    def below(self, e: Element) -> Part | None:
        return self.kids.get(self.label(e))

    def expression(self) -> str:
        """The union-free expression, for people."""
        if self.text is not None:
            return "#PCDATA" if self.text == "" else "#text"
        out = []
        for labels, repeated, optional in self.parts:
            inner = " ".join((k if k == TEXT else "") + (f"({self.kids[k].expression()})" if k == TEXT else f"{k}({self.kids[k].expression()})") + ("?" if len(labels) > 1 else "") for k in labels)
            out.append((f"({inner})" if len(labels) > 1 else inner) + ("+" if repeated else "") + ("?" if optional else ""))
        return " ".join(out)


def plain_label(tag: str, out: bool) -> str:
    return tag + "!" if out else tag


def bounded(part: Part, limit: int | None = None) -> Part:
    """The part with labels by tag alone if it has over `limit` (MAX_LABELS) labels; limit 0: in any case."""
    if part.plain or len(part.kids) <= (MAX_LABELS if limit is None else limit):
        return part
    new = {k: k if k == TEXT else plain_label(k.partition(".")[0], v.out) for k, v in part.kids.items()}
    kids: dict[str, Part] = {}
    for k, v in part.kids.items():
        kids[new[k]] = merged(kids[new[k]], v) if new[k] in kids else v
        kids[new[k]].pages = min(kids[new[k]].pages, part.pages)
    parts: list[list] = []
    for labels, repeated, optional in part.parts:
        mine = list(dict.fromkeys(new[k] for k in labels))
        places = [i for i, p in enumerate(parts) if not set(mine).isdisjoint(p[0])]
        if not places:
            parts.append([mine, repeated or len(mine) < len(labels), optional])
            continue
        stretch = parts[places[0] :]
        parts[places[0] :] = [[list(dict.fromkeys([k for p in stretch for k in p[0]] + mine)), True, optional and all(p[2] for p in stretch)]]
    part.kids, part.parts, part.plain = kids, parts, True
    return part


def block_key(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=8).hexdigest()


def content_key(page: Element) -> str:
    """A digest of a page's text outside parts that are never main text: equal for copies under other addresses."""
    h = hashlib.blake2b(digest_size=8)

    def walk(e: Element):
        for kid in e.kids:
            if isinstance(kid, tuple):
                h.update(kid[0].encode() + b"\n")
            elif not kid.out:
                walk(kid)

    walk(page)
    return h.hexdigest()


def of_page(element: Element, content: str | None = None) -> Part:
    """The wrapper of one page: recurring siblings become repeated parts."""
    part = Part(element.out)
    content = content or content_key(element)
    at: dict[str, int] = {}
    for kid in element.kids:
        if isinstance(kid, tuple):
            label, child = TEXT, Part()
            child.text, child.chars, child.links = block_key(kid[0]), len(kid[0]), kid[1]
            child.common, child.seen = frozenset((child.text,)), frozenset((content,))
        else:
            label, child = kid.label, of_page(kid, content)
        place = at.get(label)
        if place is None:
            at[label] = len(part.parts)
            part.parts.append([[label], False, False])
            part.kids[label] = child
            continue
        if place < len(part.parts) - 1:  # recurs after others: the stretch between is a repeated group
            part.parts[place:] = [[[k for p in part.parts[place:] for k in p[0]], True, all(p[2] for p in part.parts[place:])]]
            at = {k: i for i, p in enumerate(part.parts) for k in p[0]}
        part.parts[place][1] = True
        part.kids[label] = merged(part.kids[label], child, same_page=True)
    return bounded(part)


def merged(a: Part, b: Part, same_page: bool = False) -> Part:
    """Align two wrappers of one label."""
    out = Part(a.out or b.out)
    out.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    out.chars, out.links = a.chars + b.chars, a.links + b.links
    if a.text is not None:
        out.text = a.text if a.text == b.text else ""
        out.common = a.common | b.common if same_page else a.common & b.common
        out.seen = a.seen if a.seen == b.seen else frozenset(sorted(a.seen | b.seen)[:CONSTANT_PAGES])
        return out
    if a.plain != b.plain:
        a, b = bounded(a, 0), bounded(b, 0)
    out.plain = a.plain or b.plain
    out.kids = dict(a.kids)
    for k, v in b.kids.items():
        out.kids[k] = merged(a.kids[k], v, same_page) if k in a.kids else v
    parts = [[list(p[0]), p[1], p[2], False] for p in a.parts]  # the last: met in b
    cursor = -1
    for labels, repeated, optional in b.parts:
        mine = set(labels)
        places = [i for i, p in enumerate(parts) if not mine.isdisjoint(p[0])]
        if not places:
            cursor += 1
            parts.insert(cursor, [list(labels), repeated, True, True])
            continue
        low, high = places[0], places[-1]
        clash = low < cursor or (low == cursor and parts[low][3])
        if clash:
            high = max(high, cursor)
        stretch = parts[low : high + 1]
        names = list(dict.fromkeys([k for p in stretch for k in p[0]] + list(labels)))
        parts[low : high + 1] = [[names, repeated or clash or any(p[1] for p in stretch) or len(stretch) > 1, all(p[2] for p in stretch) or optional, True]]
        cursor = low
    out.parts = [[p[0], p[1], p[2] or not p[3]] for p in parts]
    return bounded(out)


def totals(part: Part) -> tuple[int, int]:
    """(slot characters, link characters) below a part, out parts left aside."""
    if part.out:
        return 0, 0
    if part.text is not None:
        constant = part.text != "" and len(part.seen) >= CONSTANT_PAGES
        return (0, 0) if constant else (part.chars, part.links)
    below = [totals(k) for k in part.kids.values()]
    return sum(b[0] for b in below), sum(b[1] for b in below)


def main_path(wrapper: Part) -> list[str]:
    """Labels down to the deepest part that holds most of the slot text outside link lists."""
    path, part = [], wrapper
    chars, links = totals(wrapper)
    if not chars:
        return path
    while True:
        best = max(((totals(k), label) for label, k in part.kids.items() if k.text is None), key=lambda x: x[0][0] - x[0][1], default=None)
        if best is None or best[0][0] < MAIN_SHARE * chars or best[0][1] > LINK_SHARE * best[0][0]:
            return path
        if part.kids[best[1]].parts and all(p[0] == [TEXT] for p in part.kids[best[1]].parts):
            return path  # paragraphs: stay with what holds them
        path.append(best[1])
        part = part.kids[best[1]]


def hinted(wrapper: Part) -> bool:
    """Whether `main` or `article` holds enough of the host's slot text, by the page, to be its main part."""
    found: dict[str, list[Part]] = {"main": [], "article": []}

    def walk(part: Part, inside: bool):
        for label, kid in part.kids.items():
            if kid.out:
                continue
            tag = label.partition(".")[0].rstrip("!")
            if tag == "main" or (tag == "article" and not inside):
                found[tag].append(kid)
            if tag != "main":
                walk(kid, inside or tag == "article")

    walk(wrapper, False)
    marked = found["main"] or found["article"]
    if not marked:
        return False
    own = [totals(p) for p in marked]
    chars, links = totals(wrapper)
    return sum(c - n for c, n in own) / sum(p.pages for p in marked) >= HINT_SHARE * (chars - links) / wrapper.pages


def main_text(page: Element, wrapper: Part, path: list[str] | None = None, hint: bool | None = None) -> str:
    blocks: list[str] = []
    marked = list(marked_parts(page, wrapper)) if (hinted(wrapper) if hint is None else hint) else []
    if marked:
        for element, part in marked:
            collect(element, part, blocks)
        if not blocks:  # all of it is on every page: still what the page marks as its text
            for element, _ in marked:
                collect(element, None, blocks)
        return " ".join(blocks)
    element, part = [page], wrapper
    for label in main_path(wrapper) if path is None else path:
        down = [k for e in element for k in e.kids if not isinstance(k, tuple) and part.label(k) == label]
        if not down:
            break
        element, part = down, part.kids[label]
    for e in element:
        collect(e, part, blocks)
    if not blocks:  # no slot text in the main part
        collect(page, wrapper, blocks)
    return " ".join(blocks)


def marked_parts(element: Element, wrapper: Part) -> list[tuple[Element, Part | None]]:
    """Outermost `main` elements with their wrapper parts, or outermost `article` elements where no `main` is."""
    found: dict[str, list[tuple[Element, Part | None]]] = {"main": [], "article": []}

    def walk(e: Element, part: Part | None, inside: bool):
        for kid in e.kids:
            if isinstance(kid, tuple) or kid.out:
                continue
            below = part.below(kid) if part else None
            if kid.tag == "main" or (kid.tag == "article" and not inside):
                found[kid.tag].append((kid, below))
            if kid.tag != "main":
                walk(kid, below, inside or kid.tag == "article")

    walk(element, wrapper, False)
    return found["main"] or found["article"]


def collect(element: Element, part: Part | None, blocks: list[str]) -> None:
    """Text blocks in page order. part: the wrapper part whose constants and link lists are template, or None."""
    for kid in element.kids:
        if isinstance(kid, tuple):
            p = part.kids.get(TEXT) if part else None
            if not (p and p.common and len(p.seen) >= CONSTANT_PAGES and block_key(kid[0]) in p.common):
                blocks.append(kid[0])
        elif not kid.out:
            below = part.below(kid) if part else None
            if below is not None:
                chars, links = totals(below)
                if chars and links > LINK_SHARE * chars and any(len(p[0]) > 1 or p[1] for p in below.parts):
                    continue
            collect(kid, below, blocks)


def _dump(part: Part) -> str:
    return json.dumps(part.packed(), separators=(",", ":"))


def infer(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): one row a host, from all its pages."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % 64
        by: dict[str, Part] = {}
        size = 0
        for batch in slices(batches, html_col):
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = of_page(parse(html or ""))
                by[host] = merged(by[host], page) if host in by else page
                size += host not in by
            if len(by) > 20_000:  # many hosts: partial wrappers go out, memory stays bounded
                yield emit(by, salt)
                by = {}
        yield emit(by, salt)

    def emit(by: dict[str, Part], salt: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(by), pa.string()), pa.array([salt] * len(by), pa.int32()), pa.array([_dump(p) for p in by.values()], pa.string())], names=["host", "salt", "wrapper"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key (all columns but the last) and wrapper: one row a key."""
        key, held = None, None
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            done: list[tuple] = []
            for row in zip(*cols, strict=True):
                if key == row[:-1]:
                    held = merged(held, Part.unpacked(json.loads(row[-1])))
                    continue
                if key is not None:
                    done.append((*key, _dump(held)))
                key, held = row[:-1], Part.unpacked(json.loads(row[-1]))
            if done:
                yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], names=batch.schema.names).cast(batch.schema)
            names = batch.schema
        if key is not None:
            yield pa.record_batch([pa.array([x]) for x in (*key, _dump(held))], names=names.names).cast(names)

    partial = df.select(host_of(F.col(url_col)).alias("host"), F.col(html_col)).mapInArrow(fold, "host string, salt int, wrapper string")
    first = partial.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(merge, "host string, salt int, wrapper string")
    return first.select("host", "wrapper").repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(merge, "host string, wrapper string")


#: Wrapper tables up to this many bytes are sent to every task; larger ones are joined by host.
BROADCAST_BYTES = 16 << 20


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id_col, url, text (main text), n_chars."""
    spark = df.sparkSession
    src = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    wrappers = written(infer(src), "wrappers")
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    shared = spark.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()}) if size <= BROADCAST_BYTES else None
    src = src.withColumn("host", host_of(F.col("url")))
    if shared is None:
        src = src.join(wrappers, "host", "left").select("id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Part, list[str], bool]] = {}
        for part in slices(batches, "html"):
            ids, urls, pages = part.column(0), part.column(1), part.column(2).to_pylist()
            raw = part.column(3).to_pylist() if shared is None else [shared.value.get(h) for h in part.column(3).to_pylist()]
            texts = []
            for html, w in zip(pages, raw, strict=True):
                page = parse(html or "")
                key = w or ""
                if key not in known:
                    if len(known) >= 2000:
                        known.clear()
                    wrapper = Part.unpacked(json.loads(w)) if w else of_page(page)
                    known[key] = (wrapper, main_path(wrapper), hinted(wrapper))
                texts.append(main_text(page, *known[key]))
            yield pa.record_batch([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
