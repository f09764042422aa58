"""Main text of pages by differencing against the page with the nearest URL.

A page is a run of blocks of text. Pages of a host are ordered by URL path; each is paired
with the one of its two neighbours whose path agrees longer. Blocks of the pair are aligned
by a longest common subsequence, and blocks that both have are deleted, since what two
articles share is the site's. A page whose blocks are all those of another is a copy, not a
neighbour; copies are passed over and compared to what their first is compared to.

The alignment looks at every visible block, and what it deletes is deleted, but for one
rescue: articles quote and copy each other, so a shared block inside an article element
stays if it stands between blocks of the article's own, and else if fewer than a third of
the host's pages (copies passed over), or fewer than three, hold it inside theirs. Markup
then settles what differencing cannot: blocks in menus, headers, footers, sidebars, notices,
adverts, forms and comments go even if no neighbour has them; a container that only its
class, id or role names so yields to an article or main element in it, and to a name of
content on itself. A page without a neighbour keeps the blocks of its strongest markup:
article, main, a container named as content, or all.

Pairs meet as hashes of blocks. Only the places that the alignment deletes go back to a
page, and only for pages where they, or having a neighbour, change its text; html is
shuffled only where this table is too large for a broadcast.

Defined results: null or empty html gives an empty text; pages without a host have no
neighbour; repeated rows get the same result; an empty table gives an empty table; other
columns pass through ``extract`` unless named ``text`` or with a leading underscore.
"""

import html
import re
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.common import cut, two_hashes
from panelkit.operators.numbering import number_rows

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")

# Element names of the HTML standard by their role here.
INLINE = frozenset((
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr").split())
VOID = frozenset((
    "area base br col embed hr img input link meta param source track wbr").split())
RAW = frozenset("script style textarea title noscript template xmp iframe".split())
DROPPED = frozenset((
    "nav header footer aside form script style noscript template iframe textarea title button "
    "select svg head dialog menu object").split())
# An open paragraph or item ends where one of its kind begins.
ENDS = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")),
        "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")),
        "td": frozenset(("td", "th")), "th": frozenset(("td", "th"))}
# Whole names of class, id and role, without their hyphens, that say what is not the article,
# or what holds it.
NOT_TEXT = frozenset((
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe signup paywall sidebar complementary menu nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager footer contentinfo header masthead comment comments disqus "
    "replies share sharing social related recommended widget toolbar search form dialog").split())
HOLDS_TEXT = frozenset((
    "article articlebody articlecontent content entry entrycontent main maincontent post "
    "postbody postcontent story storybody").split())
NAME_MARKS = re.compile(r"[^a-z0-9\s]+")

# NOT_NAMED comes from a name only; an article or main element inside lifts it.
ARTICLE, MAIN, NAMED, OPEN, NOT_NAMED, NOT_MAIN = 3, 2, 1, 0, -1, -2
# Cells of an alignment that are held at once; larger ones are divided.
CELLS = 1 << 27
# A shared block at an article's end goes if so many pages, and one in so many of the host's,
# hold it in their articles.
SITE_PAGES, SITE_SHARE = 3, 3


def kind_of(name: str, attributes: str) -> int | None:
    """What an element makes of the text inside it; None if nothing new."""
    if name in DROPPED:
        return NOT_MAIN
    hidden, words = False, set()
    if attributes.strip(" \t\n\r\f/"):
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id", "role"):
                words.update(NAME_MARKS.sub("", value).split())
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                hidden = True
            elif key == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
    if hidden:
        return NOT_MAIN
    if name == "article":
        return NOT_MAIN if words & {"comment", "comments"} else ARTICLE
    if name == "main":
        return MAIN
    if name in ("html", "body"):
        return None
    if words & HOLDS_TEXT:
        return NAMED
    return NOT_NAMED if words & NOT_TEXT else None


def blocks(page: str | None) -> list[tuple[str, int]]:
    """Texts of a page's blocks in order, each with the strongest kind around it.

    Inline elements do not end a block. Unclosed elements end where an enclosing one does.
    """
    page = page or ""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    kind = OPEN

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, kind))
            parts.clear()

    at = 0
    while at < len(page):
        found = TAG.search(page, at)
        if not found:
            parts.append(page[at:])
            break
        if found.start() > at:
            parts.append(page[at:found.start()])
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        name, closing = name.lower(), bool(found.group(1))
        if name in INLINE and not found.group(3).strip() and not (
                closing and any(n == name for n, _ in stack)):
            if name == "br":
                parts.append(" ")
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name not in INLINE:
                flush()
            if depth is not None:
                if any(k != kind for _, k in stack[depth:depth + 1]):
                    flush()
                kind = stack[depth][1]
                del stack[depth:]
            continue
        new = kind_of(name, found.group(3))
        if name not in INLINE:
            flush()
            if name in ENDS:
                # Only as far as the nearest container, so lists may nest.
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ENDS[name]:
                        kind = stack[i][1]
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE and stack[i][0] not in ENDS:
                        break
        if name in VOID or found.group(3).rstrip().endswith("/"):
            if name == "br":
                parts.append(" ")
            continue
        inside = kind
        if new is not None and kind != NOT_MAIN:
            if new < OPEN:
                inside = new
            elif kind != NOT_NAMED:
                inside = max(kind, new)
            elif new >= MAIN and all(k != ARTICLE for _, k in stack):
                # Cards inside an article's own sidebar stay out.
                inside = new
        if name in INLINE and inside == kind:
            continue
        if inside != kind:
            flush()
        stack.append((name, kind))
        kind = inside
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if name not in DROPPED:
                parts.append(page[at:stop])
            at = stop
    flush()
    return out


def fingerprint(text: str) -> int:
    value = xxhash.xxh64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


def place_of(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; an unreadable one has no host."""
    try:
        split = urlsplit(url or "")
        return (split.hostname or ""), split.path.rstrip("/")
    except ValueError:
        return "", ""


def matched(a: list[int], b: list[int]) -> list[bool]:
    """Which of ``a`` stand in a longest common subsequence with ``b``.

    Common ends are set aside. The rest is solved by rows of bits, one integer per row, and
    walked back; where the rows would be too many they are divided in halves first.
    """
    out = [False] * len(a)
    low, high_a, high_b = 0, len(a), len(b)
    while low < min(high_a, high_b) and a[low] == b[low]:
        out[low] = True
        low += 1
    while high_a > low and high_b > low and a[high_a - 1] == b[high_b - 1]:
        high_a, high_b = high_a - 1, high_b - 1
        out[high_a] = True
    common = set(a[low:high_a]) & set(b[low:high_b])
    left = [i for i in range(low, high_a) if a[i] in common]
    for i in align([a[i] for i in left], [x for x in b[low:high_b] if x in common]):
        out[left[i]] = True
    return out


def bit_rows(a: list[int], b: list[int]):
    """After each of ``a``: the bits of ``b`` at which the length does not grow."""
    spots: dict[int, int] = {}
    for j, x in enumerate(b):
        spots[x] = spots.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    yield row
    for x in a:
        hit = spots.get(x, 0)
        same = row & hit
        row = ((row + same) | (row - same)) & every
        yield row


def lengths(row: int, n: int) -> list[int]:
    """Lengths of the alignment with each prefix, from the bits of a row."""
    out = [0]
    for bit in reversed(bin(row | 1 << n)[3:]):
        out.append(out[-1] + (bit == "0"))
    return out


def align(a: list[int], b: list[int]) -> list[int]:
    """Places of ``a`` in a longest common subsequence."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > CELLS:
        half = len(a) // 2
        *_, upper = bit_rows(a[:half], b)
        *_, lower = bit_rows(a[half:][::-1], b[::-1])
        first, second = lengths(upper, len(b)), lengths(lower, len(b))
        at = max(range(len(b) + 1), key=lambda j: first[j] + second[len(b) - j])
        return align(a[:half], b[:at]) + [half + i for i in align(a[half:], b[at:])]
    rows = list(bit_rows(a, b))
    found, j = [], len(b)
    for i in range(len(a), 0, -1):
        # The last place up to j where this row has grown; not grown before: a match.
        grown = ~rows[i] & ((1 << j) - 1)
        if not grown:
            break
        last = grown.bit_length() - 1
        if rows[i - 1] >> last & 1:
            found.append(i - 1)
            j = last
    return found[::-1]


def deleted(prints: list[int], kinds: list[int], near: list[int]
            ) -> tuple[list[int], list[int]]:
    """Places of shared blocks that the alignment deletes outright, and of shared blocks at
    the ends of an article, which go if they are the site's. Dropped markup is left out."""
    both = matched(prints, near)
    own = [i for i, kind in enumerate(kinds) if kind == ARTICLE and not both[i]]
    first, last = (own[0], own[-1]) if own else (len(kinds), -1)
    outright = [i for i, kind in enumerate(kinds) if both[i] and OPEN <= kind < ARTICLE]
    ends = [i for i, kind in enumerate(kinds)
            if both[i] and kind == ARTICLE and not first < i < last]
    return outright, ends


def main_text(page: str | None, gone: list[int] | None) -> str:
    """The blocks that differencing and markup leave, joined by empty lines.

    ``gone`` are the places that differencing deletes, None without a neighbour.
    """
    have = blocks(page)
    if gone is None:
        level = max((k for _, k in have), default=OPEN)
        return "\n\n".join(t for t, kind in have if kind == level and kind >= OPEN)
    lost = set(gone)
    return "\n\n".join(
        text for i, (text, kind) in enumerate(have) if kind >= OPEN and i not in lost)


# Kinds as letters, in the order of their values from NOT_MAIN.
LETTERS = "xdonma"


def outlines(pages: DataFrame) -> DataFrame:
    """Per page: key, host, path, hashes of its blocks and of them all, and their kinds.

    No texts. ``kinds`` has a letter for each block, from ``x`` (dropped) to ``a`` (article).
    """
    def outline(parts):
        for part in parts:
            out: list = [[], [], [], [], []]
            for url, page in zip(part.column("url").to_pylist(),
                                 part.column("html").to_pylist(), strict=True):
                host, path = place_of(url)
                have = blocks(page)
                prints = [fingerprint(t) for t, _ in have]
                whole = xxhash.xxh128_hexdigest(repr(prints))
                kinds = "".join(LETTERS[k - NOT_MAIN] for _, k in have)
                for column, value in zip(out, (host, path, prints, whole, kinds), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [part.column("h1"), part.column("h2"), pa.array(out[0], pa.string()),
                 pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int64())),
                 pa.array(out[3], pa.string()), pa.array(out[4], pa.string())],
                ["h1", "h2", "host", "path", "prints", "digest", "kinds"])

    return pages.select(*two_hashes(F.struct("url", "html")), "url", "html").mapInArrow(
        outline, "h1 long, h2 long, host string, path string, prints array<bigint>, "
        "digest string, kinds string")


def aligned(pairs: DataFrame) -> DataFrame:
    """``outright`` deleted places and ``ends`` (place, hash) of each page against its neighbour."""
    end = pa.struct([("place", pa.int32()), ("print", pa.int64())])

    def align_pages(parts):
        for part in parts:
            outright, ends = [], []
            for prints, kinds, near in zip(
                    *(part.column(c).to_pylist() for c in ("prints", "kinds", "near")), strict=True):
                gone, at_ends = deleted(prints, [LETTERS.index(k) + NOT_MAIN for k in kinds], near)
                outright.append(gone)
                ends.append([{"place": i, "print": prints[i]} for i in at_ends])
            yield pa.RecordBatch.from_arrays(
                [part.column("host"), part.column("digest"), part.column("kinds"),
                 pa.array(outright, pa.list_(pa.int32())), pa.array(ends, pa.list_(end))],
                ["host", "digest", "kinds", "outright", "ends"])

    return pairs.mapInArrow(
        align_pages, "host string, digest string, kinds string, outright array<int>, "
        "ends array<struct<place:int,print:bigint>>")


def differences(pages: DataFrame) -> DataFrame:
    """Key of each page whose text differencing changes, and the places ``_gone`` of its blocks.

    A page with a neighbour, nothing deleted and text of one kind of markup has no row: its
    text is the same without a neighbour. Pages with equal blocks on a host are first reduced
    to one, so the order has no copies, and a host of any size is only a run of it.
    """
    known = cut(outlines(pages), "outlines")
    firsts = known.where("host <> ''").groupBy("host", "digest").agg(
        F.min("path").alias("path"), F.first("prints").alias("prints"))
    # Copies may differ in their markup.
    kinds = known.where("host <> ''").select("host", "digest", "kinds").distinct()
    order = number_rows(firsts, ["host", "path", "digest"], "n")
    parts = order.withColumn("path", F.split("path", "/"))

    def beside(by: int, name: str) -> DataFrame:
        return order.select(
            (F.col("n") + by).alias("n"), F.col("host").alias(f"{name}_host"),
            F.split("path", "/").alias(f"{name}_path"), F.col("prints").alias(f"{name}_prints"))

    def agree(name: str):
        """Common leading path parts with a neighbour on the host; -1 if there is none."""
        same = F.zip_with("path", f"{name}_path", lambda a, b: a.eqNullSafe(b))
        return F.when(
            F.col(f"{name}_host") == F.col("host"),
            F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size("path")),
        ).otherwise(-1)

    near = parts.join(beside(1, "before"), "n", "left").join(beside(-1, "after"), "n", "left")
    pairs = near.select(
        "host", "digest", "prints",
        F.when(F.greatest(agree("before"), agree("after")) >= 0, F.when(
            agree("before") >= agree("after"), F.col("before_prints"))
            .otherwise(F.col("after_prints"))).alias("near")).where(F.col("near").isNotNull())
    found = cut(aligned(pairs.join(kinds, ["host", "digest"])), "aligned")
    ends = found.select("host", "digest", "kinds", F.inline("ends"))
    sizes = order.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    held = (
        order.join(kinds, ["host", "digest"])
        .select("host", "digest", F.explode(F.array_distinct(F.filter(
            "prints", lambda x, i: F.substr(F.col("kinds"), i + 1, F.lit(1)) == "a")))
            .alias("print"))
        .join(ends.select("host", "print").distinct(), ["host", "print"])
        .distinct().groupBy("host", "print").agg(F.count(F.lit(1)).alias("held")))
    site = held.join(sizes, "host").where(
        (F.col("held") >= SITE_PAGES) & (SITE_SHARE * F.col("held") >= F.col("pages")))
    page = ["host", "digest", "kinds"]
    of_site = ends.join(site.select("host", "print"), ["host", "print"]).groupBy(*page).agg(F.collect_list("place").alias("more"))
    text_kinds = F.translate("kinds", "xd", "")
    mixed = F.regexp_replace(text_kinds, F.substring(text_kinds, 1, 1), F.lit("")) != ""
    changed = found.join(of_site, page, "left").where(
        mixed | (F.size("outright") > 0) | F.col("more").isNotNull()).select(
        *page, F.concat("outright", F.coalesce("more", F.array().cast("array<int>"))).alias("_gone"))
    return known.select("h1", "h2", *page).dropDuplicates(["h1", "h2"]).join(
        changed, page).select("h1", "h2", "_gone")


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` instead of ``html``."""
    kept = [c for c in pages.columns if c not in ("html", "text") and not c.startswith("_")]
    schema = T.StructType([*pages.select(*kept).schema.fields,
                           T.StructField("text", T.StringType())])

    def cut_pages(parts):
        for part in parts:
            texts = [main_text(page, gone) for page, gone in zip(
                part.column("_html").to_pylist(), part.column("_gone").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), pa.array(texts, pa.string())],
                [*kept, "text"])

    changed = cut(differences(pages), "page-differences")
    first, second = two_hashes(F.struct("url", "html"))
    keyed = pages.select(*kept, F.col("html").alias("_html"), first.alias("_h1"),
                         second.alias("_h2"))
    same = (F.col("_h1") == F.col("d.h1")) & (F.col("_h2") == F.col("d.h2"))
    return keyed.join(changed.alias("d"), same, "left").select(
        *[keyed[c] for c in kept], "_html", "_gone").mapInArrow(cut_pages, schema)
