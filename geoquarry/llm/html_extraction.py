"""Main text of web pages, by wrappers inferred from the pages of each host.

Page structures are folded and counted first, so that a host's structures
are aligned once each however many pages it has; alignments run in parts and
the parts' wrappers are aligned again. Each page is then matched with its
host's wrapper, and the wrapper's slots are judged by what the host's
different pages have in them. The article is the region that holds the long,
unlinked, differing texts; everything in it stays but the fixed texts before
and after what differs, and the named regions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.llm.common import prepared
from geoquarry.llm.html_pages import blocks, words_of
from geoquarry.llm.url_filter import url_host
from geoquarry.llm.wrappers import Sequence, aligned, dumped, expression, numbered, of_page, regions, repeating

PARTS = 32
# A slot whose texts are all on at least two and such a share of a host's different pages is fixed.
TEMPLATE_SHARE = 0.5
# Pages differ in their articles if such a share of what is not fixed is on one page only.
ALONE = 0.5
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Slots that tell where the article is have at most such a share in links and at least so many characters a text.
LINKED = 0.5
SHORT = 20
# Elements that can hold a whole article.
HOLDS = frozenset("article body center div fieldset form html main section td".split())
# Wrappers of at most so many bytes in all go to every task; larger tables of hosts are joined by a shuffle.
CARRIED_BYTES = 16 << 20

# Elements and names that stand for what is not the article.
ASIDE_TAGS = frozenset("nav footer aside form header menu dialog head address fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsbygoogle ad-container ad-slot ad-wrapper banner breadcrumb breadcrumbs comment comments "
    "comment-list comments-area comments-section comment-respond consent contentinfo cookie cookies cookie-banner cookie-bar cookie-consent "
    "cookie-notice disqus disqus_thread footer site-footer page-footer login masthead menu main-menu nav navbar nav-bar nav-menu navigation "
    "main-nav main-navigation site-nav site-navigation post-navigation newsletter notice notices pager pagination popup promo promoted promotion "
    "reader recommended related related-posts related-articles replies reply respond search search-box search-form share share-buttons sharing "
    "sidebar left-sidebar right-sidebar signup skip skip-link social social-links social-share sponsor sponsored subscribe teaser toolbar topbar "
    "top-bar widget widgets widget-area site-header".split()
)
# Named regions that never are the article, however much text they hold.
ANSWERS = frozenset("comment comments comment-list comments-area comments-section comment-respond disqus disqus_thread replies reply respond".split())
# Elements that are judged neither by their tag nor by their words, and those whose tag does not count where they hold most of the text.
FRAMES = frozenset(["html", "body", "article", "main"])
HOLDERS = frozenset(["form", "fieldset"])
MOST = 0.5
MAIN_TAGS = ("article", "main")


def is_aside(path: str, wide: frozenset[int] = frozenset()) -> bool:
    """Return whether an element on the path is a region around the article.

    A header inside an article belongs to it. ``wide`` are the levels of the
    path whose elements hold most of the host's text: there, forms and named
    regions are no asides, but for the comments.
    """
    inside = False
    for level, (tag, *words) in enumerate(words_of(path), 1):
        inside = inside or tag in MAIN_TAGS
        if tag in FRAMES:
            continue
        named = ASIDE_WORDS.intersection(words)
        if level in wide:
            named &= ANSWERS
        if named or (tag in ASIDE_TAGS and not (tag == "header" and inside) and not (tag in HOLDERS and level in wide)):
            return True
    return False


def wide_elements(place: dict[int, tuple[str, tuple[int, ...]]], seen: list[dict]) -> set[int]:
    """Return the numbers of the elements that hold most of the text of a host's different pages."""
    held: dict[int, int] = {}
    for slot in seen:
        for number in place[slot["number"]][1]:
            held[number] = held.get(number, 0) + slot["chars"]
    return {number for number, chars in held.items() if chars > MOST * held[0]}


def article_of(path: str) -> int:
    """Return which of ``MAIN_TAGS`` an element on the path is, the first one first, or their number for none."""
    elements = list(words_of(path))
    for place, tag in enumerate(MAIN_TAGS):
        if any(words[0] == tag or (tag == "main" and "main" in words) for words in elements):
            return place
    return len(MAIN_TAGS)


def kind_of_page(path: str) -> int:
    """Return the kind of page that a text on the path makes: ``article_of``, but for articles in navigation and the like."""
    every = frozenset(range(path.count(">") + 1))
    return len(MAIN_TAGS) if is_aside(path, every) else article_of(path)


def chosen_slots(wrapper: Sequence, seen: list[dict]) -> list[list[int]]:
    """Return the slots to read on a page: for each of ``MAIN_TAGS``, for pages without any, and for all others.

    A page is read by the first list that has a text on it. ``seen`` has
    ``kind, number, least, pages, of, chars, linked, alone`` for every slot
    and kind of page: the different pages that the rarest of its texts is on,
    those of all texts added up, all pages of the kind, and the characters of
    its texts, of those in links, and of those on one page only.
    """
    place = {number: (path, around) for number, path, around, _ in regions(wrapper)}
    wide = wide_elements(place, seen)
    regions_: list[list[dict]] = [[] for _ in MAIN_TAGS]
    open_ = []
    for slot in sorted(seen, key=lambda slot: slot["number"]):
        path, around = place[slot["number"]]
        if is_aside(path, frozenset(level for level, number in enumerate(around) if number in wide)):
            continue
        open_.append(slot)
        if article_of(path) < len(MAIN_TAGS):
            regions_[article_of(path)].append(slot)
    # Pages whose articles are all asides count as pages without any.
    without = [slot for slot in open_ if slot["kind"] == len(MAIN_TAGS) or not regions_[slot["kind"]]]
    holder = container(wrapper, without, place)
    regions_.append([slot for slot in without if holder in place[slot["number"]][1]])
    chosen = [sorted({slot["number"] for slot in slots} - template(slots, place)) for slots in regions_]
    read = any(chosen) or any(slot["linked"] <= LINKED * slot["chars"] for slot in open_)
    return [*chosen, sorted({slot["number"] for slot in open_}) if read else []]


def container(wrapper: Sequence, slots: list[dict], place: dict[int, tuple[str, tuple[int, ...]]]) -> int | None:
    """Return the number of the innermost element that holds all long, unlinked texts that differ from page to page.

    Fixed texts count, too, where they are most of the long ones, as in copies
    of one page. The element can hold an article and does not repeat.
    """
    plain = [slot for slot in slots if slot["linked"] <= LINKED * slot["chars"]]
    long_ = [slot for slot in plain if slot["chars"] >= SHORT * slot["pages"]]
    free = [slot for slot in long_ if not is_fixed(slot)]
    if 2 * sum(slot["chars"] for slot in free) >= sum(slot["chars"] for slot in long_):
        long_ = free
    around = [place[slot["number"]][1] for slot in long_ or plain]
    if not around:
        return None
    shared = around[0]
    for numbers in around[1:]:
        shared = tuple(a for a, b in zip(shared, numbers, strict=False) if a == b)
    repeated = repeating(wrapper)
    held = 0
    for number in shared[1:]:
        if number in repeated:
            break
        if tag_of(place[number][0]) in HOLDS:
            held = number
    return held


def tag_of(path: str) -> str:
    """Return the tag of the innermost element of a path."""
    return path.rsplit(">", 1)[-1].split(".")[0].split("#")[0]


def is_fixed(slot: dict) -> bool:
    """Return whether all texts of a slot are on most of the host's different pages each."""
    return slot["least"] >= max(2, TEMPLATE_SHARE * slot["of"])


def template(slots: list[dict], place: dict[int, tuple[str, tuple[int, ...]]]) -> set[int]:
    """Return the fixed slots before and after all that differs in a region, in page order.

    Fixed texts between others belong to the article, and so do headings.
    Where pages are copies or edited copies of each other, being fixed says
    nothing: nothing is template unless most of what differs is on one page
    only, and it is more than what would go.
    """
    free = [slot for slot in slots if not is_fixed(slot)]
    if not free:
        return set()
    first, last = free[0]["number"], free[-1]["number"]
    edge = [
        slot for slot in slots
        if not first <= slot["number"] <= last and tag_of(place[slot["number"]][0]) not in HEADINGS
    ]
    differing = sum(slot["chars"] for slot in free)
    if sum(slot["alone"] for slot in free) < ALONE * differing or sum(slot["chars"] for slot in edge) > differing:
        return set()
    return {slot["number"] for slot in edge}


def structures(pages: DataFrame) -> DataFrame:
    """Return ``host, structure`` per page: the folded tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [dumped(of_page(blocks(page.as_py() or "")[0])) for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.string())], ["host", "structure"])

    return pages.select("host", "html").mapInArrow(run, "host string, structure string")


def fillings(pages: DataFrame) -> DataFrame:
    """Return ``host, page, kind, slots`` of pages with their ``wrapper``: what is in the wrapper's slots.

    ``page`` names the page's whole text; ``kind`` is that of its article.
    """
    fields = "host string, page bigint, kind int, slots array<struct<number:int,digest:bigint,chars:bigint,linked:bigint>>"
    kind_ = pa.list_(pa.struct([("number", pa.int32()), ("digest", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Sequence, dict[int, int]]] = {}
        for batch in batches:
            names, kinds, filled = [], [], []
            for host, page, text in zip(*(batch.column(at) for at in range(3)), strict=True):
                name = host.as_py()
                if name not in known:
                    if len(known) > 1_000:
                        known.clear()
                    wrapper = Sequence(json.loads(text.as_py()))
                    known[name] = wrapper, {number: kind_of_page(path) for number, path, _, _ in regions(wrapper)}
                wrapper, kind_of = known[name]
                root, found = blocks(page.as_py() or "")
                numbers = numbered(root, wrapper)
                own: dict[tuple[int, int], list] = {}
                for at, value, linked in found:
                    held = own.setdefault((numbers[at], text_digest(value)), [0, 0])
                    held[0] += len(value)
                    held[1] += linked
                filled.append([{"number": number, "digest": digest, "chars": a, "linked": b} for (number, digest), (a, b) in own.items()])
                names.append(text_digest(repr(list(own))))
                kinds.append(min((kind_of[number] for number, _ in own), default=len(MAIN_TAGS)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.int64()), pa.array(kinds, pa.int32()), pa.array(filled, kind_)], ["host", "page", "kind", "slots"]
            )

    return pages.select("host", "html", "wrapper").mapInArrow(run, fields)


def text_digest(text: str) -> int:
    """Return a 63-bit hash of a text."""
    return xxhash.xxh3_64_intdigest(text) >> 1


def _aligned(rows: pd.DataFrame) -> pd.DataFrame:
    """Align all structures of one group, common ones first."""
    ordered = rows.sort_values(["pages", "structure"], ascending=[False, True])
    wrapper: list | None = None
    for text in ordered["structure"]:
        nodes = json.loads(text)
        wrapper = nodes if wrapper is None else aligned(wrapper, nodes)
    first = rows.iloc[0]
    return pd.DataFrame({"host": [first["host"]], "structure": [dumped(wrapper or [])], "pages": [int(rows["pages"].sum())]})


def carried(found: DataFrame, size: Column) -> DataFrame:
    """Mark a table of hosts to go to every task if it is small; ``size`` is that of a row."""
    total = found.agg(F.sum(size + F.octet_length("host") + 64).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(found) if total <= CARRIED_BYTES else found


def wrappers(pages: DataFrame) -> DataFrame:
    """Infer one wrapper per host: ``host, wrapper, expression, chosen``.

    ``pages`` has ``host`` and ``html``. ``chosen`` are the numbers of the
    wrapper's slots to read, as ``chosen_slots`` returns them. Slots are
    judged by the host's different pages, however often each is repeated.
    """
    prepared(pages)
    counted = structures(pages).groupBy("host", "structure").agg(F.count("*").alias("pages"))
    parts = counted.withColumn("part", F.pmod(F.xxhash64("structure"), F.lit(PARTS)))
    fields = "host string, structure string, pages bigint"
    partial = parts.groupBy("host", "part").applyInPandas(_aligned, fields)
    whole = partial.groupBy("host").applyInPandas(_aligned, fields).select("host", F.col("structure").alias("wrapper")).checkpoint()
    joined = pages.select("host", "html").join(carried(whole, F.octet_length("wrapper")), "host")
    seen = fillings(joined).dropDuplicates(["host", "page"]).checkpoint()
    of = seen.groupBy("host", "kind").agg(F.count("*").alias("of"))
    texts = seen.select("host", "kind", F.inline("slots")).groupBy("host", "kind", "number", "digest").agg(
        F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )
    totals = texts.groupBy("host", "kind", "number").agg(
        F.min("pages").alias("least"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.sum(F.when(F.col("pages") == 1, F.col("chars")).otherwise(0)).alias("alone"),
    )
    # One row per slot of the wrapper, not per page.
    slot = F.struct("kind", "number", "least", "pages", "of", "chars", "linked", "alone")
    listed = totals.join(of, ["host", "kind"]).groupBy("host").agg(F.collect_list(slot).alias("seen"))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, wrapper, own in zip(batch["host"], batch["wrapper"], batch["seen"], strict=True):
                nodes = json.loads(wrapper)
                chosen = chosen_slots(Sequence(nodes), [dict(slot) for slot in (own if own is not None else [])])
                rows.append((host, wrapper, expression(nodes), chosen))
            yield pd.DataFrame(rows, columns=["host", "wrapper", "expression", "chosen"])

    return whole.join(listed, "host", "left").mapInPandas(judged, "host string, wrapper string, expression string, chosen array<array<int>>")


def main_text(page: str, wrapper: Sequence, chosen: list[set[int]]) -> str:
    """Return the text of a page's article slots, else of the next slots that have one."""
    root, found = blocks(page)
    numbers = numbered(root, wrapper)
    for wanted in chosen:
        texts = [text for at, text, _ in found if numbers[at] in wanted]
        if texts:
            return " ".join(texts)
    return ""


def extracted(pages: DataFrame) -> DataFrame:
    """Return ``page_id, url, text, n_chars`` of every page.

    Null and empty pages, and pages of which nothing is article, have an
    empty text. Pages without a host share the empty host. Repeated pages
    have equal texts; an empty table gives an empty one.
    """
    prepared(pages)
    rows = pages.select(
        "page_id", "url", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    found = wrappers(rows).select("host", "wrapper", "chosen").checkpoint()
    slots = F.aggregate("chosen", F.lit(0), lambda total, numbers: total + F.size(numbers))
    found = carried(found, F.octet_length("wrapper") + 4 * slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Sequence, list[set]]] = {}
        for batch in batches:
            texts = []
            for host, page, wrapper, chosen in zip(*(batch.column(at) for at in range(2, 6)), strict=True):
                name = host.as_py()
                if name not in known:
                    if len(known) > 1_000:
                        known.clear()
                    known[name] = Sequence(json.loads(wrapper.as_py())), [set(numbers) for numbers in chosen.as_py()]
                texts.append(main_text(page.as_py(), *known[name]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(text) for text in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    fields = "page_id bigint, url string, text string, n_chars bigint"
    joined = rows.join(found, "host", "left").select(F.col("page_id").cast("bigint").alias("page_id"), "url", "host", "html", "wrapper", "chosen")
    return joined.mapInArrow(run, fields)
