"""Main text of web pages by comparing each page with the one of the nearest URL on its host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tables import Parts, staged
from threadloom.llm.urls import host_of, path_of

#: Element names of HTML by what they mean here.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div
dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html
legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot
th thead title tr ul""".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg".split())
MAIN = frozenset(("article", "main"))
CHROME = frozenset("nav footer aside form menu dialog button select search head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold the page or its text: no class or id marks them.
HOLDERS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: Whole class tokens that mark what isn't part of an article. Compounds name a layout or a topic
#: (has-sidebar, category-social) as often as the thing itself, so only these count.
MARKED = frozenset("""ad ads advert adverts advertisement advertisements advertising sponsor sponsors
sponsored sponsored-content promo promos promotion banner cookie cookies cookie-banner cookie-bar
cookie-consent cookie-notice consent consent-banner sidebar side-bar menu nav navigation navbar nav-bar
breadcrumb breadcrumbs footer site-footer page-footer site-header page-header masthead share sharing
share-buttons social social-links social-share related related-posts related-articles newsletter
newsletter-signup subscribe popup modal login signup toolbar pagination widget widget-area skip-link
skiplink""".split())
#: Those that mark readers' comments, whose parts may be article elements themselves.
COMMENTS = frozenset("comment comments comment-list commentlist comments-area disqus disqus_thread replies".split())
#: Elements whose id counts like a class; elsewhere, and in articles, ids name sections.
BOXES = frozenset("div ul ol dl table td".split())
#: A tag or comment. A ``>`` in quotes doesn't end a tag, unless no other does.
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>"
                 r"|[^>]*>)|[!?/][^>]*>)", re.S)
#: A tag that the page ends in.
CUT = re.compile(r"<(?:/?[a-zA-Z]|[!?]).*", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?")


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What the start of an element ends if it's open, and what keeps it open (see ``LABELS``).
CELLS = ("td", "th", "caption")
ROWS = (*CELLS, "tr", "colgroup")
BODIES = (*ROWS, "tbody", "thead", "tfoot")
STARTS = {name: (("p",), "scope") for name in BLOCKS - frozenset(
    "body caption frameset head html legend optgroup option select tbody td tfoot th thead title tr".split())}
STARTS |= {"li": (("li",), "item"), "dt": (("dt", "dd"), "item"), "dd": (("dt", "dd"), "item"),
           "option": (("option",), "select"), "optgroup": (("option", "optgroup"), "select"),
           "td": (CELLS, "table"), "th": (CELLS, "table"), "tr": (ROWS, "table"),
           **dict.fromkeys(("caption", "colgroup", "tbody", "thead", "tfoot"), (BODIES, "table")),
           "button": (("button",), "scope"), "a": (("a",), "scope")}
#: What keeps an element open when its end tag comes; ``scope`` for any other.
ENDS = {"li": "list", **dict.fromkeys(("table", *BODIES), "table"), **dict.fromkeys(MAIN, "page")}
#: Open elements by what they keep open. An article keeps what it lies in, as stray end tags are usual.
SCOPE = frozenset("table td th caption button object marquee applet".split()) | MAIN
LABELS = {"scope": SCOPE, "list": SCOPE | {"ol", "ul"}, "table": MAIN | {"table"}, "select": MAIN | {"select"},
          "item": SCOPE | BLOCKS - frozenset("address div p form li dt dd option optgroup".split()),
          "block": SCOPE | BLOCKS - {"form"}}
LABELED = {name: tuple(label for label, names in LABELS.items() if name in names)
           for name in frozenset().union(*LABELS.values())}
#: Elements of a page's head; any other ends it.
HEADS = frozenset("base basefont bgsound link meta noscript script style template title head html".split())


class Open:
    """The open elements of a page, ended by end tags and by what implies their end.

    Every step takes constant time on average: an element is found by the places of its
    name, and whether something between keeps it open by the places of a label.
    """

    def __init__(self):
        self.stack: list[list] = []  # name, kind of mark, whether still open
        self.places: dict[str, list[int]] = {}
        self.inside = 0  # open articles
        self.around = 0  # open marked elements
        self.plain: list[list] = []  # those but for comments, outside articles

    def last(self, label: str) -> int:
        places = self.places.get(label)
        return places[-1] if places else -1

    def cut(self, place: int) -> None:
        """Ends the element at a place and all inside it."""
        while len(self.stack) > place:
            one = self.stack.pop()
            if one[2]:
                self.done(one)

    def done(self, one: list) -> None:
        name, kind, one[2] = one[0], one[1], False
        for label in (name, *LABELED.get(name, ())):
            self.places[label].pop()
        self.around -= kind > 0
        self.inside -= name in MAIN
        if self.plain and self.plain[-1] is one:
            self.plain.pop()

    def start(self, name: str, kind: int) -> None:
        if name == "form" and self.last("form") > self.last("scope"):
            return
        if name in MAIN and not self.inside:
            # what was left open before an article doesn't hide it, but for comments
            for one in self.plain:
                self.around -= one[2] and one[1] > 0
                one[1] = 0
            self.plain.clear()
        one = [name, kind, True]
        for label in (name, *LABELED.get(name, ())):
            self.places.setdefault(label, []).append(len(self.stack))
        self.stack.append(one)
        self.around += kind > 0
        self.inside += name in MAIN
        if kind == 1 and not self.inside:
            self.plain.append(one)

    def implied(self, name: str) -> None:
        """Ends what the start of an element ends."""
        if name not in HEADS and (head := self.last("head")) >= 0:
            self.cut(head)
        ended, keeper = STARTS.get(name, ((), "scope"))
        if name == "a":
            if self.last("a") > self.last(keeper):
                self.end("a")
            return
        if name == "button":
            keeper = "page"
        least = max(self.last(keeper), self.last("main"), self.last("article"))
        found = [place for n in ended if (place := self.last(n)) > least]
        if found:
            self.cut(min(found))
        if name in ("li", "dt", "dd"):
            self.implied("p")
        if name in HEADINGS and self.stack and self.stack[-1][0] == "h":
            self.cut(len(self.stack) - 1)

    def end(self, name: str) -> None:
        name = "h" if name in HEADINGS else name
        place = self.last(name)
        if place < 0:
            return
        if name != "form" and name in BLOCKS or name in SCOPE or name == "h":
            if place >= self.last(ENDS.get(name, "scope")):
                self.cut(place)
        elif place > self.last("block"):
            self.cut(place)
        else:  # ends alone, the blocks in it stay open
            self.done(self.stack[place])


def _marked(name: str, rest: str, inside: bool) -> int:
    """Whether an element is one of those around an article (1) or readers' comments (2)."""
    kind = int(name in CHROME or name == "header" and not inside)
    if not rest.strip() or name in ("html", "body"):
        return kind
    names: set[str] = set()
    section = ""
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "class":
            names.update(value.split())
        elif key == "id":
            section = value.strip()
        elif (key == "role" and value in ROLES
                or key == "hidden" or key == "aria-hidden" and value == "true"):
            kind = 1
    if name in HOLDERS:
        return kind
    if name in BOXES and "section" not in names and (not inside or section in COMMENTS):
        names.add(section)
    return 2 if names & COMMENTS else int(kind or bool(names & MARKED))


def lines_of(page: str | None) -> list[tuple[str, bool, bool]]:
    """The text lines of a page: (text, in an article, in what surrounds articles), one per block.

    White space inside a line is one blank, character references are decoded; comments,
    scripts, styles and tags are gone. Tags may be unclosed or nested wrongly.
    """
    out: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    opened, state = Open(), (False, False)
    page = page or ""
    at, last = 0, page.rfind(">") + 1

    def close() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append((text, *state))
        held.clear()

    def changed() -> None:
        nonlocal state
        if state != (now := (opened.inside > 0, opened.around > 0)):
            close()
            state = now

    # no tag ends behind the last ">", so a search for one never runs to the end in vain
    while tag := TAG.search(page, at, last):
        if tag.start() > at:
            text = page[at:tag.start()]
            if opened.last("head") >= 0 and not text.isspace():
                opened.implied("")
                changed()
            held.append(html.unescape(text))
        at = tag.end()
        end, name, rest = tag.group(1), tag.group(2), tag.group(3) or ""
        if not name:
            if tag.group().startswith("<!--") and not tag.group().endswith("-->"):
                at = len(page)
            continue
        name = name.lower()
        if name in BLOCKS:
            close()
        elif name == "br":
            held.append(" ")
        if not end and name in RAW:
            stop = re.compile(f"</{re.escape(name)}(?![^\\s/>])", re.I | re.A).search(page, at)
            at = stop.start() if stop else len(page)
            continue
        if end:
            opened.end(name)
        else:
            opened.implied(name)
            if name not in VOID and name not in ("html", "body") and not rest.endswith("/"):
                opened.start("h" if name in HEADINGS else name, _marked(name, rest, opened.inside > 0))
        changed()
    rest = CUT.sub("", page[at:])
    if opened.last("head") >= 0 and rest.strip():
        opened.implied("")
        changed()
    held.append(html.unescape(rest))
    close()
    return out


def aligned(a: list[str], b: list[str]) -> list[int]:
    """Places in ``a`` of one longest common subsequence with ``b``.

    A row of the usual table is one whole number whose zero bits mark where the length
    grows. Only some rows are kept on the way down and the others made again on the way
    back, so memory grows with the square root of the length.
    """
    if not a or not b:
        return []
    masks: dict[str, int] = {}
    for j, line in enumerate(b):
        masks[line] = masks.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    every = max(int(len(a) ** 0.5), 1)

    def step(row: int, line: str) -> int:
        hit = row & masks.get(line, 0)
        return ((row + hit) | (row - hit)) & full

    kept, row = [full], full
    for i, line in enumerate(a, 1):
        row = step(row, line)
        if i % every == 0:
            kept.append(row)
    found, i, j = [], len(a), len(b) - 1
    rows: dict[int, int] = {}
    while i and j >= 0:
        if i not in rows or i - 1 not in rows:
            first = (i - 1) // every
            rows = {first * every: kept[first]}
            for k in range(first * every, min(first * every + every, len(a))):
                rows[k + 1] = step(rows[k], a[k])
        if rows[i] >> j & 1:
            j -= 1
        elif i > 1 and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            found.append(i - 1)
            i, j = i - 1, j - 1
    return found[::-1]


def main_text(lines: list[tuple[str, bool, bool]], near: list[tuple[str, bool, bool]] | None) -> str:
    """The article: lines that the nearest page doesn't share and that don't surround articles.

    Lines shared with the nearest page, in the same order, are the site's; but inside an
    article element they are the page's own, as two articles may quote the same passage.
    If a page marks its article and the article has text, lines outside aren't part of it.
    """
    shared = set(aligned([t for t, _, _ in lines], [t for t, _, _ in near])) if near else set()
    left = [(t, inside) for i, (t, inside, around) in enumerate(lines)
            if not around and (inside or i not in shared)]
    if any(inside for _, inside in left):
        left = [x for x in left if x[1]]
    return "\n".join(t for t, _ in left)


def _alike(a: str, b: str) -> int:
    """How many path segments, then characters, two paths share from the start."""
    segments = sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(a.split("/"), b.split("/"))))
    return segments * 10_000 + sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(a, b)))


#: Where a page stands among all, and characters of text that are handed on together.
KEYS = ["host", "path", "place", "tie"]
BATCH = 8 << 20


def _texts(lines: list[tuple[str, bool, bool]]) -> bytes:
    """A 128-bit hash of the texts of a page's lines."""
    return xxhash.xxh3_128_digest("\n".join(t for t, _, _ in lines).encode("utf-8", "surrogatepass"))


def _keyed(pages: DataFrame) -> DataFrame:
    """Pages with the columns of ``KEYS``; none of those is null."""
    source = pages.select(F.col("page_id").cast("long"), "url", "html")
    return (source.withColumn("host", F.coalesce(host_of("url"), F.lit("")))
            .withColumn("path", F.coalesce(path_of("url"), F.lit("")))
            .withColumn("place", F.coalesce("page_id", F.lit(-1 << 63)))
            .withColumn("tie", F.xxhash64("url", "html")))


def _hashed(source: DataFrame) -> DataFrame:
    """The keys of all pages and the hashes of their lines."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_texts(lines_of(page)) for page in batch.column(len(KEYS)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(KEYS)], pa.array(found, pa.binary())],
                                             names=[*KEYS, "texts"])

    return source.select(*KEYS, "html").mapInArrow(
        hashed, "host string, path string, place long, tie long, texts binary")


def _ends(rows: DataFrame) -> dict[int, list[dict]]:
    """Of each part: the first and last row of its first run of equal pages, the row after it, the
    row before its last run, and that run's first and last row. Rows after or before may be missing."""
    names = ("first", "end", "next", "previous", "start", "last")
    row = pa.struct([("host", pa.string()), ("path", pa.string()), ("place", pa.int64()),
                     ("tie", pa.int64()), ("texts", pa.binary())])
    fields = pa.schema([("part", pa.int32()), *((name, row) for name in names)])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, dict] = {}
        for batch in batches:
            for one in batch.to_pylist():
                part = one.pop("part")
                if (now := parts.get(part)) is None:
                    parts[part] = {"part": part, "first": one, "end": one, "next": None, "previous": None,
                                   "start": one, "last": one}
                    continue
                if not _same(now["last"], one):
                    now["next"] = now["next"] or one
                    now["previous"], now["start"] = now["last"], one
                elif not now["next"]:
                    now["end"] = one
                now["last"] = one
        yield pa.RecordBatch.from_pylist(list(parts.values()), schema=fields)

    one = "struct<host:string,path:string,place:bigint,tie:bigint,texts:binary>"
    ends = rows.select("part", *KEYS, "texts").mapInArrow(
        found, "part int, " + ", ".join(f"{name} {one}" for name in names)).collect()
    return {r["part"]: r.asDict(recursive=True) for r in ends}


def _same(a: dict, b: dict) -> bool:
    """Whether two rows are of one run: the same lines on the same host."""
    return a["host"] == b["host"] and a["texts"] == b["texts"]


def _carried(ends: dict[int, dict]) -> tuple[dict[tuple, list[int]], dict[int, str], dict[int, str]]:
    """What parts need of others: pages as guests, by key; where first runs start; where last runs end.

    A run can fill any number of parts; each gets the different pages next to the whole run.
    """
    guests: dict[tuple, list[int]] = {}
    paths: tuple[dict[int, str], dict[int, str]] = {}, {}
    order = sorted(ends)
    for side, way, (mine, edge, over, away) in (
            (0, order, ("first", "last", "previous", "start")), (1, order[::-1], ("last", "first", "next", "end"))):
        near = path = before = None  # the different page before a part's edge, and the run's own outermost path
        for part in way:
            now = ends[part]
            if before is None or not _same(before[edge], now[mine]):
                near, path = before and before[edge], now[mine]["path"]
            elif before[over]:
                near, path = before[over], before[away]["path"]
            paths[side][part], before = path, now
            if near and near["host"] and near["host"] == now[mine]["host"]:
                guests.setdefault(tuple(near[k] for k in KEYS), []).append(3 * part + 2 * side)
    return guests, *paths


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` (empty if none) and ``n_chars`` of every row of ``pages``.

    Pages are ordered by host and path. A run of pages with the same lines is compared as a
    whole with the different page before or after it on its host, whichever path is nearer
    to the run's (the one before on a tie); so its pages have the same partner, also if it
    fills several parts. There is none for pages without a host. A null html counts as
    empty. Hashes of lines are written to the shared folder first. Rows are shuffled once,
    a host's pages over as many tasks as they fill. Repeated rows and a null page_id or url
    give rows like others, a very long page is held as a whole, an empty table gives no row;
    further columns are ignored, whatever their names.
    """
    source = _keyed(pages)
    hashes = staged(_hashed(source), "page_lines")
    parts = Parts(hashes, KEYS)
    guests, starts, ends = _carried(_ends(parts.deal(hashes)))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in told(row for batch in batches for row in batch.to_pylist()):
            out.append(row)
            size += row[3]
            if size > BATCH or len(out) >= 10_000:
                yield made(out)
                out, size = [], 0
        yield made(out)

    def told(rows: Iterator[dict]) -> Iterator[tuple]:
        part, before, run = None, None, None
        for row in rows:
            lines = lines_of(row["html"])
            name = {"host": row["host"], "texts": _texts(lines)}
            if row["part"] != part:
                yield from texts_of(before, run, None)
                part, before, run = row["part"], None, None
            if run is None or not _same(run, name):
                after = {**name, "part": part, "guest": row["guest"], "lines": lines, "rows": [],
                         "kinds": {}, "first": row["path"], "path": row["path"]}
                if row["guest"] == 0 and (run is None or run["guest"] == -1):
                    after["path"] = starts[part]
                yield from texts_of(before, run, after)
                before, run = run, after
            run["last"] = row["path"]
            if row["guest"] == 0:
                # copies differ in their elements at most
                kind = tuple((inside, around) for _, inside, around in lines)
                run["rows"].append((row["page_id"], row["url"],
                                    run["kinds"].setdefault(kind, (len(run["kinds"]), lines))[0]))
        yield from texts_of(before, run, None)

    def texts_of(before: dict | None, run: dict | None, after: dict | None) -> Iterator[tuple]:
        """The result of a run's own pages, from the runs next to it."""
        if run is None or not run["rows"]:
            return
        last = run["last"] if after and after["guest"] == 0 else ends[run["part"]]
        near = [(one, _alike(path, own)) for one, path, own in (
            (before, before and before["last"], run["path"]), (after, after and after["first"], last))
            if one and run["host"] and one["host"] == run["host"]]
        best = max(near, key=lambda n: n[1], default=None)
        texts = [main_text(lines, best[0]["lines"] if best else None) for _, lines in run["kinds"].values()]
        for page_id, url, kind in run["rows"]:
            yield page_id, url, texts[kind], len(texts[kind])

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type)
                                           for i, f in enumerate(fields)], schema=fields)

    fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()),
                        ("n_chars", pa.int64())])
    return parts.deal(source, more=guests).mapInArrow(
        extracted, "page_id long, url string, text string, n_chars long")
