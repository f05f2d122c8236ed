"""Main text of HTML pages by nearest-URL page differencing.

A page becomes lines, one for each block of text, and regions: its main region, which is its article or main element
or else the smallest element with more than half of the page's text, and the outermost elements beside that, each a
region of its own. Pages of a host are ordered by URL path and each is paired with the nearer of its neighbours (the
longer common beginning of the path). Both pages' regions are aligned by the longest common subsequence of their shapes
(place and element names and classes within, whatever the words): a region that the site repeats goes, also where its
words change from page to page. The main regions' lines are aligned by their text, and shared lines go; inside an
article or main element only if many pages of the host have them, since there a sentence that two articles share is
content. What elements are by their kind decides only over regions that the other page lacks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, joined_by_count, stored
from folioscope.llm.urlfilter import host_of, path_of

# Element names of HTML, and the words that mark an element's class, id or role as page furniture.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
PROSE = frozenset("blockquote caption figure h1 h2 h3 h4 h5 h6 p pre table".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe object svg math canvas head title select textarea audio video".split())
FURNITURE = frozenset("nav header footer aside form menu button dialog".split())
MAIN = frozenset("article main".split())
WORDS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promotion related replies respond review reviews share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
# Words that, put before or after one of those, leave it the same kind.
PLAIN = frozenset("site page main top bottom left right global primary secondary user reader customer box bar block section area wrapper container content list form inner outer slot unit popup banner notice post blog thread links link buttons".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
IMPLIED = {"p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()), "th": frozenset("td th".split()), "option": frozenset("option".split())}
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption li dt dd option optgroup legend summary figcaption title".split())


def marks_furniture(mark: str, main: bool) -> bool:
    """Whether a class or id is a word of page furniture, alone or with words that leave its kind; none for an article's own heading."""
    words = [w for w in re.split(r"[^a-z0-9]+", mark) if w]
    kinds = [w for w in words if w in WORDS and not (main and w == "header")]
    return bool(kinds) and all(w in WORDS or w in PLAIN for w in words) and not (main and "header" in words)


OUTSIDE = ("", False, False, False, 0)


class Lines(HTMLParser):
    """The lines of a page: (text, is page furniture, lies in a main element), and the element that each lies in.

    Without ``kinds`` nothing is furniture or a main element.
    """

    def __init__(self, kinds: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.kinds = kinds
        self.open: list[tuple[str, bool, bool, bool, int]] = []  # tag, unseen, furniture, main, each inherited; innermost block
        self.lines: list[tuple[str, bool, bool]] = []
        self.blocks: list[tuple[str, int, bool]] = [("", -1, False)]  # name with classes, the block around it, furniture
        self.places: list[int] = []  # the block of each line
        self.text: list[str] = []

    def flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                _, _, furniture, main, block = self.open[-1] if self.open else OUTSIDE
                self.lines.append((line, furniture, main))
                self.places.append(block)
            self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P and any(t == "p" for t, *_ in self.open):
            self.close_to("p", frozenset("article aside body div main section td th li table".split()))
        if self.open and self.open[-1][0] in IMPLIED.get(tag, ()):
            self.open.pop()
        _, unseen, furniture, main, block = self.open[-1] if self.open else OUTSIDE
        marks: set[str] = set()
        classes: list[str] = []
        for name, value in attrs:
            if name in ("class", "id") and value:
                marks.update(value.lower().split())
                if name == "class":
                    classes = sorted(set(re.sub("[0-9]+", "0", value.lower()).split()))
            elif name == "role" and value and value.lower() in ROLES:
                furniture = True
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                unseen = True
        inner = main and tag == "header"  # the heading of an article, not of the page
        marked = tag not in ("body", "html") and tag not in MAIN and any(marks_furniture(m, main) for m in marks)
        furniture = self.kinds and (furniture or tag in FURNITURE and not inner or marked)
        if tag in BLOCKS and tag not in ("html", "body"):
            self.blocks.append((".".join([tag, *classes]), block, furniture))
            block = len(self.blocks) - 1
        self.open.append((tag, unseen or tag in UNSEEN, furniture, main or self.kinds and tag in MAIN, block))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag not in VOID:
            self.close_to(tag, frozenset())

    def close_to(self, tag: str, barrier: frozenset[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in barrier:
                return

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.text.append(data)


def page_of(html: str | None, kinds: bool = True) -> Lines:
    """A page, read; broken markup is read as far as it goes."""
    page = Lines(kinds)
    page.feed(html or "")
    page.close()
    page.flush()
    return page


def lines_of(html: str | None) -> list[tuple[str, bool, bool]]:
    """All lines of a page in page order; none for null and empty pages."""
    return page_of(html).lines


def shape_of(block: int, blocks: list[tuple[str, int, bool]], inside: dict[int, list[int]]) -> str:
    """The names within a block, children of one shape in a row taken as one, so that a menu's length does not matter."""
    order, done = [block], {}
    for b in order:
        order.extend(inside.get(b, ()))
    for b in reversed(order):
        parts: list[str] = []
        for c in inside.get(b, ()):
            if not parts or parts[-1] != done[c]:
                parts.append(done[c])
        # Deep markup stays short: what a block holds is told by a digest.
        held = blake2b("|".join(parts).encode("utf-8", "replace"), digest_size=8).hexdigest() if parts else ""
        done[b] = f"{blocks[b][0]}({held})"
    return done[block]


def regions_of(page: Lines) -> list[int]:
    """Of each line the key of the region that it lies in, which tells its place and shape; 0 in the main region.

    Where no element holds more than half of the text in more than one line, the whole page is the main region. An
    element of furniture inside the main region is a region of its own; running text, headings and tables beside the main region belong to it.
    """
    blocks, inside = page.blocks, {}
    for b in range(1, len(blocks)):
        inside.setdefault(blocks[b][1], []).append(b)
    core = [main and not furniture for _, furniture, main in page.lines]
    trunk: set[int] = {0}  # blocks that hold a main region, or are one
    if any(core):
        for b in {b for b, c in zip(page.places, core, strict=True) if c}:
            while b > 0 and b not in trunk:
                trunk.add(b)
                b = blocks[b][1]
    else:
        size, lines = [0] * len(blocks), [0] * len(blocks)
        for (text, furniture, _), b in zip(page.lines, page.places, strict=True):
            if not furniture:
                size[b] += len(text)
                lines[b] += 1
        for b in range(len(blocks) - 1, 0, -1):  # a block comes after the one around it
            size[blocks[b][1]] += size[b]
            lines[blocks[b][1]] += lines[b]
        top = 0
        while (deeper := next((c for c in inside.get(top, ()) if 2 * size[c] > size[0] and lines[c] > 1), None)) is not None:
            trunk.add(top := deeper)
        core = [not furniture for _, furniture, _ in page.lines]
        under = {top}
        for b in range(1, len(blocks)):
            if blocks[b][1] in under:
                under.add(b)
        core = [c and b in under for c, b in zip(core, page.places, strict=True)]
    keys: dict[int, int] = {}
    out = []
    for (_, furniture, main), b, c in zip(page.lines, page.places, core, strict=True):
        way = []  # from the line outwards
        while b > 0:
            way.append(b)
            b = blocks[b][1]
        way.reverse()
        start = next((b for b in way if b not in trunk and (not (main and furniture) or blocks[b][2])), None)
        if furniture and start is None:  # an element inside running text
            out.append(key_of("/".join([*(blocks[b][0] for b in way), "inline"])) or 1)
            continue
        if c or start is None or not furniture and blocks[start][0].split(".")[0] in PROSE:
            out.append(0)
            continue
        if start not in keys:
            place = "/".join(blocks[b][0] for b in way[: way.index(start)])
            keys[start] = key_of(f"{place}/{shape_of(start, blocks, inside)}") or 1
        out.append(keys[start])
    return out


def common_lines(a: list, b: list) -> set[int]:
    """Positions in a of a longest common subsequence with b, by bit-parallel rows and a walk back through them."""
    where: dict = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for line in a:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    shared, i, j = set(), len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            shared.add(i)
    return shared


def repeated(own: list[int], other: list[int]) -> set[int]:
    """The shapes of a page's regions that align with the other page's, those out of order in further alignments."""
    found: set[int] = set()
    while at := common_lines(left := [k for k in own if k not in found], other):
        found.update(left[i] for i in at)
    return found


def main_text(lines: list[tuple[str, bool, bool]], other: list[str] | None) -> str:
    """What is left of one page's lines by kind and by the lines of another page, for pages outside a table; no region is aligned."""
    own = [(t, main) for t, furniture, main in lines if not furniture]
    shared = common_lines([t for t, _ in own], other) if other else set()
    return "\n".join(t for at, (t, main) in enumerate(own) if main or at not in shared)


def key_of(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def digest_of(keys: list[int]) -> bytes:
    return blake2b(np.array(keys, np.int64).tobytes(), digest_size=16).digest()


def many(pages: Column, have: Column) -> Column:
    """Whether ``have`` of a host's pages are too many for a line of an article: more than 4 and more than a quarter."""
    return (have > 4) & (4 * have > pages)


def paired(reps: DataFrame) -> DataFrame:
    """(host, digest, shared, often, other): of each main region, which lines it shares with its neighbour, which of these many pages have, and the neighbour's regions.

    The neighbours are those of the whole order by host and path: the first and last rows of each range, two a range,
    are carried to the ranges beside it.
    """
    spark = reps.sparkSession
    have = reps.select("host", F.explode(F.array_distinct("keys")).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("have"))
    sizes = reps.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # At most four times the lines of a host's mean page.
    often = have.where("have > 4").join(sizes, "host").where(many(F.col("pages"), F.col("have"))).groupBy("host").agg(F.collect_list("key").alias("often"))
    # Hosts of many line lists get their frequent lines by broadcast, so that none makes a task of its own.
    joined = joined_by_count(reps, sizes.join(often, "host", "left"), "host", "pages")
    ordered = cut(joined.repartitionByRange("host", "path", "page_id", "digest").sortWithinPartitions("host", "path", "page_id", "digest"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first or batch.slice(0, 1).to_pylist()[0]
                last = batch.slice(batch.num_rows - 1, 1).to_pylist()[0]
        if first:
            pid = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"pid": pid, "late": late, **{c: row[c] for c in ("host", "path", "keys", "regions")}} for late, row in ((False, first), (True, last))], edge)

    edge = pa.schema([("pid", pa.int32()), ("late", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("keys", pa.list_(pa.int64())), ("regions", pa.list_(pa.int64()))])
    edges = ordered.mapInArrow(ends, "pid int, late boolean, host string, path string, keys array<long>, regions array<long>").collect()
    carried = spark.sparkContext.broadcast(sorted(((r["pid"], r["late"], r["host"], r["path"], r["keys"], r["regions"]) for r in edges), key=lambda r: r[:2]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        page = lambda r: {"host": r[2], "path": r[3], "keys": r[4], "regions": r[5]}
        start = next((page(r) for r in reversed(carried.value) if r[0] < pid and r[1]), None)
        stop = next((page(r) for r in carried.value if r[0] > pid and not r[1]), None)

        def neighbours() -> Iterator[tuple[dict | None, dict, dict | None]]:
            before, now = start, None
            for batch in batches:
                for row in batch.to_pylist():
                    if now is not None:
                        yield before, now, row
                        before = now
                    now = row
            if now is not None:
                yield before, now, stop

        def near(row: dict, other: dict | None) -> int:
            return -1 if other is None or other["host"] != row["host"] else len(commonprefix([row["path"], other["path"]]))

        out: list[dict] = []
        for before, row, after in neighbours():
            length, _, other = max((near(row, before), 1, before), (near(row, after), 0, after), key=lambda x: x[:2])
            shared = sorted(common_lines(row["keys"], other["keys"])) if length >= 0 else []
            frequent = set(row["often"] or ())
            out.append({"host": row["host"], "digest": row["digest"], "shared": shared, "often": [k for k in shared if row["keys"][k] in frequent], "other": other["regions"] if length >= 0 else []})
            if len(out) == 500:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("host", pa.string()), ("digest", pa.binary()), ("shared", pa.list_(pa.int32())), ("often", pa.list_(pa.int32())), ("other", pa.list_(pa.int64()))])
    return ordered.mapInArrow(compare, "host string, digest binary, shared array<int>, often array<int>, other array<long>")


def kept(lines: list[str], main: list[bool], furniture: list[bool], regions: list[int], shared: set[int], often: set[int], other: list[int]) -> str:
    """The lines that are left of a page: those of its main region that are not shared, and other regions that neither repeat nor are furniture."""
    gone = repeated(list(dict.fromkeys(r for r in regions if r)), other)
    out, k = [], 0
    for text, in_main, kind, region in zip(lines, main, furniture, regions, strict=True):
        if region:
            stays = region not in gone and not kind
        else:
            stays = k not in shared or in_main and k not in often
            k += 1
        if stays:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", kinds: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; without ``kinds`` by differencing alone.

    Pages of a host whose main regions have the same lines are one in the order of its pages, under the least of their
    paths, so that copies get the same text and no page is paired with a copy of itself, whose lines would all be
    shared; the regions beside it are each page's own. Only hashes of lines are sorted, over ranges, so a host of any
    size is spread over tasks. A host's only main region is left whole, and of what is beside it furniture goes. A null
    html is an empty page; a null URL has an empty host and path; repeated rows are rows of their own.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    longs = pa.list_(pa.int64())

    def split(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                found = [page_of(x, kinds) for x in part.column("html").to_pylist()]
                regions = [regions_of(x) for x in found]
                keys = [[key_of(t) for (t, *_), r in zip(x.lines, rs, strict=True) if not r] for x, rs in zip(found, regions, strict=True)]
                digest = pa.array([digest_of(k) for k in keys], pa.binary())
                if texts:
                    bools = [pa.array([[line[n] for line in x.lines] for x in found], pa.list_(pa.bool_())) for n in (1, 2)]
                    columns = [*(part.column(c) for c in ("page_id", "url", "host")), digest, pa.array([[t for t, *_ in x.lines] for x in found], pa.list_(pa.string())), *bools, pa.array(regions, longs)]
                    yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "digest", "lines", "furniture", "main", "regions"])
                else:
                    beside = pa.array([list(dict.fromkeys(r for r in rs if r)) for rs in regions], longs)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "host", "path")), digest, pa.array(keys, longs), beside], names=["page_id", "host", "path", "digest", "keys", "regions"])

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lines", "main", "furniture", "regions", "shared", "often", "other")]
            out = [kept(lines, main, furniture, regions, set(shared or ()), set(often or ()), other or []) for lines, main, furniture, regions, shared, often, other in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    hashed = rows.drop("url").mapInArrow(lambda b: split(b, False), "page_id long, host string, path string, digest binary, keys array<long>, regions array<long>").where(F.size("keys") > 0)
    reps = hashed.groupBy("host", "digest").agg(F.min(F.struct("path", "page_id", "regions")).alias("least"), F.first("keys").alias("keys"))
    reps = stored(reps.select("host", "digest", "least.path", "least.page_id", "keys", "least.regions"))
    lined = rows.drop("path").mapInArrow(lambda b: split(b, True), "page_id long, url string, host string, digest binary, lines array<string>, furniture array<boolean>, main array<boolean>, regions array<long>")
    return lined.join(paired(reps), ["host", "digest"], "left").mapInArrow(left, "page_id long, url string, text string, n_chars long")
