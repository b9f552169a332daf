"""Main text of web pages by structure and by differencing each page with its nearest pages by URL.

A page is cut to text blocks. Blocks in menus, adverts, forms and the like (by element, role, class or id) go, unless such an element
holds most of the page's text, as a form around a whole page does.

Then pages are put in order of (host, path). A page's neighbours are the REACH pages before and after it that have its host, the one
that shares most of its path first. The blocks of the two are aligned by a longest common subsequence. A neighbour that shares more than
COPY of the text is a copy of the page and tells nothing about the template; the first two others are witnesses. Blocks that the page
shares with the first witness are deleted; in an article or main element both have to share them, as two articles may quote one text.
Of what is left, the text in article or main elements is the result if it is at least half; else all of it is.

Only hashes and lengths of blocks are compared, so the texts are not moved for that. The order has a rank over all pages; ranks are
dealt in stretches that overlap by REACH, so a page meets its neighbours wherever they are and however the table is partitioned, and a
host of any size is spread over many tasks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import sifted
from .common import cut, hash_words, slices, table

COPY, REACH, STRETCH = 0.5, 2, 256
# attribute values are quoted only after an equals sign; what never ends reaches to the end of the page
_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: What stands up to the end tag is no text; without an end tag the first ones reach to the end of the page, the others to nothing.
_RAW = frozenset("script style title textarea iframe noscript noframes noembed xmp".split())
_FOREIGN = frozenset("template svg math object canvas video audio".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head nav footer aside form button select dialog menu".split())
_BLOCK = _DROPPED | frozenset(
    "html body main article section header div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr blockquote pre address figure figcaption fieldset details summary hr hgroup center".split()
)
_ADVERT = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice notices".split())
_COMMENTS = frozenset("comment comments respond reply replies disqus".split())
_BESIDE = _ADVERT | _COMMENTS | frozenset("sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs share sharing related recommended newsletter subscribe subscription pagination pager".split())
_BAD = _BESIDE | frozenset("banner banners footer header masthead social popup modal overlay widget toolbar login signup search".split())
#: Names of parts of an article; a header or banner of one is text.
_PARTS = frozenset("post article entry story content".split())
_SMALL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre tr figcaption".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


def _bad(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no part of an article, by its name, role, class or id."""
    if tag in _DROPPED or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "main") or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    found = {}
    for k, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), a or b or c)
    names = set(re.split(r"[\s_-]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
    if tag == "article":
        words = _COMMENTS
    elif tag in _SMALL:
        words = _ADVERT
    else:
        words = _BESIDE if names & _PARTS or tag == "header" else _BAD
    if names & words:
        return True
    return found.get("role", "").lower() in _ROLES or found.get("aria-hidden", "").lower() == "true" or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()


def blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, kept by structure, in an article or main element) of each block, in order. Never fails, whatever the markup, in time linear in the page's length."""
    if not page:
        return []
    # a cause is an element that is no part of an article: the cause around it, whether it may be void, its characters
    causes: list[list] = [[-1, True, 0]]
    out: list[tuple[str, int, bool]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int, bool]] = []
    opened: dict[str, int] = {}
    endless: set[str] = set()
    cause, inside, at = 0, False, 0

    def flush() -> None:
        if buffer:
            if text := " ".join(html.unescape("".join(buffer)).split()):
                out.append((text, cause, inside))
            buffer.clear()

    def pop() -> None:
        nonlocal cause, inside
        opened[stack.pop()[0]] -= 1
        cause, inside = stack[-1][1:] if stack else (0, False)

    while m := _TAG.search(page, at):
        buffer.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened.get(tag):
                flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag in _BLOCK:
                flush()
            elif tag in ("td", "th"):
                buffer.append(" ")
            continue
        if tag in _RAW or tag in _FOREIGN:
            buffer.append(" ")
            end = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in _RAW:
                at = len(page)
            else:
                endless.add(tag)
            continue
        if tag in _VOID:
            buffer.append(" ") if tag != "hr" else flush()
            continue
        drop = _bad(tag, m[3], inside)
        if tag not in _BLOCK and not drop:
            if tag in ("td", "th", "option"):
                buffer.append(" ")
            continue
        flush()
        # an open paragraph ends where a block begins, an open item where the next one does
        if stack and stack[-1][0] == "p" and tag in _BLOCK:
            pop()
        if stack and tag in ("li", "dt", "dd", "tr") and stack[-1][0] == tag:
            pop()
        if drop:
            causes.append([cause, tag in ("form", "header") or tag not in _DROPPED, 0])
            cause = len(causes) - 1
        inside = inside or tag in ("article", "main") and not drop
        stack.append((tag, cause, inside))
        opened[tag] = opened.get(tag, 0) + 1
    buffer.append(page[at:])
    flush()
    for text, where, _ in out:
        causes[where][2] += len(text)
    for around, _, n in reversed(causes[1:]):
        causes[around][2] += n
    good = [True]
    for around, may, n in causes[1:]:
        good.append(good[around] and may and 2 * n > causes[0][2])
    return [(text, good[where], main) for text, where, main in out]


def shared(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence of a and b, bit-parallel in b."""
    low, n, m = 0, len(a), len(b)
    while low < min(n, m) and a[low] == b[low]:
        low += 1
    while n > low and m > low and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    found = set(range(low)) | set(range(n, len(a)))
    places: dict = {}
    for j, line in enumerate(b[low:m]):
        places[line] = places.get(line, 0) | 1 << j
    rows = [i for i in range(low, n) if a[i] in places]
    full = (1 << (m - low)) - 1
    v, history = full, []
    for i in rows:
        u = v & places[a[i]]
        v = ((v + u) | (v - u)) & full
        history.append(v)
    # zeros of v up to j count the common subsequence with b[:j + 1]
    j = m - low - 1
    for k in range(len(rows) - 1, -1, -1):
        before = history[k - 1] if k else full
        while j >= 0 and history[k] >> j & 1:
            j -= 1  # this line of b adds nothing
        if j < 0:
            break
        if before >> j & 1:
            found.add(rows[k])
            j -= 1
    return found


def near(a: str, b: str) -> int:
    """Code points that two paths share from the start."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def template(page: dict, neighbours: list[dict]) -> list[int]:
    """Places of the blocks that belong to the template. A page is path, line (hashes), size, good and main; the neighbours have its host and stand in order of their distance."""
    good = [i for i, x in enumerate(page["good"]) if x]
    total = sum(page["size"][i] for i in good)
    witnesses: list[set[int]] = []
    for other in sorted(neighbours, key=lambda x: -near(x["path"], page["path"])):
        common = shared(page["line"], other["line"]) if not set(page["line"]).isdisjoint(other["line"]) else set()
        if sum(page["size"][i] for i in good if i in common) <= COPY * total:
            witnesses.append(common)
            if len(witnesses) == 2:
                break
    if not witnesses:
        return []
    both = witnesses[0] & witnesses[1] if len(witnesses) == 2 else set()
    return [i for i in good if i in (both if page["main"][i] else witnesses[0])]


def result(page: str | None, gone: list[int] | None) -> str:
    """The text of a page without the blocks at the places gone."""
    gone = set(gone or ())
    kept = [(text, main) for i, (text, good, main) in enumerate(blocks(page)) if good and i not in gone]
    whole, main = sum(len(x) for x, _ in kept), sum(len(x) for x, inside in kept if inside)
    return "\n".join(x for x, inside in kept if inside or 2 * main < whole)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page.

    A null or empty page has the empty text. Pages without a URL count as one host. Repeated rows stay, and are one page to their
    neighbours; ties in (host, path) are ordered by id (null first) and a hash of the page. Other columns are ignored, whatever their
    names; an empty table gives an empty result. The time for a page is linear in its length, the memory too. The result does not depend
    on how the table is partitioned.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
    source = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), F.lower(F.regexp_extract(url, parts, 1)).alias("host"), F.rtrim(F.regexp_extract(url, parts, 2), F.lit("/")).alias("path"), F.col(html_col).alias("t"))
    # names a page: its id, place and text, nulls included
    named = source.withColumns({f"k{n}": F.xxhash64(F.lit(n), F.to_json(F.struct("i", "host", "path")), F.col("t").isNull(), "t") for n in (1, 2)})

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "t"):
            found = [blocks(x) for x in texts]
            flat = hash_words([text for page in found for text, _, _ in page]).view(np.int64).tolist()
            ends = np.cumsum([len(x) for x in found])
            lines = [flat[b - len(x) : b] for x, b in zip(found, ends.tolist())]
            lists = [pa.array(lines, pa.list_(pa.int64())), pa.array([[len(x[0]) for x in page] for page in found], pa.list_(pa.int32())), *(pa.array([[x[k] for x in page] for page in found], pa.list_(pa.bool_())) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("k1", "k2", "i", "host", "path")), *lists], ["k1", "k2", "i", "host", "path", "line", "size", "good", "main"])

    schema = "k1 long, k2 long, i long, host string, path string, line array<bigint>, size array<int>, good array<boolean>, main array<boolean>"
    light = named.mapInArrow(sketch, schema).dropDuplicates(["k1", "k2"])
    # a rank over all pages from the counts of ranges of them; the number of a range must not change once they are counted
    order = ["host", "path", "i", "k1", "k2"]
    ranged = cut(light.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))
    # one row for each partition
    counts = ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("pid", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = ranged.withColumn("own", F.row_number().over(Window.partitionBy("pid").orderBy(*order))).join(F.broadcast(counts), "pid").withColumn("rank", F.col("before") + F.col("own") - 1)
    # a page is in its stretch, and in the next one if that begins within its reach
    stretches = F.array_distinct(F.transform(F.array(F.lit(-REACH), F.lit(0), F.lit(REACH)), lambda x: F.floor((F.col("rank") + x) / STRETCH)))
    dealt = ranked.drop("pid", "own", "before").withColumn("stretch", F.explode(stretches)).where("stretch >= 0")
    dealt = dealt.repartition("stretch").sortWithinPartitions("stretch", "rank")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the page to judge has REACH rows behind it
        held: list[dict] = []

        def judge(at: int) -> tuple | None:
            page = held[at]
            if page["rank"] // STRETCH != page["stretch"]:
                return None
            sides = [x for x in held if x["stretch"] == page["stretch"] and x["host"] == page["host"] and 0 < abs(x["rank"] - page["rank"]) <= REACH]
            gone = template(page, sorted(sides, key=lambda x: (abs(x["rank"] - page["rank"]), x["rank"])))
            return (page["k1"], page["k2"], gone) if gone else None

        def emit(rows: list) -> pa.RecordBatch:
            a, b, c = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.list_(pa.int32()))], ["k1", "k2", "gone"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = []
                for page in batch.slice(start, 256).to_pylist():
                    held.append(page)
                    if len(held) > REACH:
                        rows.append(judge(len(held) - 1 - REACH))
                    del held[: max(0, len(held) - 1 - 2 * REACH)]
                if rows := [x for x in rows if x]:
                    yield emit(rows)
        if rows := [x for x in map(judge, range(max(0, len(held) - REACH), len(held))) if x]:
            yield emit(rows)

    gone = dealt.mapInArrow(differ, "k1 long, k2 long, gone array<int>")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "t"):
            found = [result(x, y) for x, y in zip(texts, batch.column("gone").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("u"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["i", "u", "text", "n_chars"])

    # pages that lose nothing by differencing, most of them, stay where they are
    gone = cut(gone)
    some, none = sifted(named, "k1", gone, "k1")
    joined = some.join(gone, ["k1", "k2"], "left").select("i", "u", "t", "gone").unionByName(none.select("i", "u", "t", F.lit(None).cast("array<int>").alias("gone")))
    return joined.mapInArrow(finish, "i long, u string, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES, SQL = {"op3_html_text": op3_html_text}, {}
