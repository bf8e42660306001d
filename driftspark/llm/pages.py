"""Main text of web pages, by markup zones and the suffix array of each host.

A page is read as a stream of blocks. Blocks in elements or classes that name a part of the page's frame are
boilerplate, blocks in an article or main element are its text. What is left in between is judged by the host's
pages: their streams are concatenated and their suffixes sorted, long substrings that distinct pages share are
boilerplate, and unique runs are kept. Articles quote and share paragraphs, so within them only whole blocks are
judged: those that several articles of the host and of no other host have, or a large share of the host's articles.
An article that is mostly such blocks is a copy of another one and stays whole.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import sorted_runs
from driftspark.llm.suffixes import anchors, covered, gram_filter, merged_spans, select_grams, window_batches
from driftspark.operators.lookup import join_lookup, key_counts
from driftspark.runtime import col, materialize

# Bytes of a repeated substring.
LENGTH = 96
# Pages with one gram that one task sorts; see ``suffixes``.
SORTED = 100_000
# Distinct articles of one host, and of no other, that make a block of theirs boilerplate.
OWN_ARTICLES = 3
# Share of a host's distinct articles that does so for a block that other hosts have too.
ARTICLE_SHARE = 0.3

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody"
    " td tfoot th thead tr ul".split()
)
_FRAME = frozenset("nav footer aside form menu dialog head button".split())
_MAIN = frozenset("article main".split())
# Words of class, id and role names that mark a part of the frame.
_FRAME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice alert popup"
    " modal newsletter subscribe signup login sidebar navigation nav navbar menu breadcrumb breadcrumbs footer comment"
    " comments disqus reply replies respond related recommended share sharing social widget toolbar pagination pager"
    " complementary contentinfo search".split()
)


def _split_names(rest: str) -> set[str]:
    names = (a or b or c for a, b, c in _NAMES.findall(rest))
    return {w for name in names for w in re.split(r"[^a-z]+", name.lower())}


def blocks(html: str | None) -> list[tuple[str, bool, bool]]:
    """Blocks of a page in order: text with single spaces, whether in the main text, whether in the frame.

    A name or form around an article does not make it frame, unless the page has an article in fewer of them: a layout
    may be called after its sidebar. A main element is never frame by what is around it but elements of the frame.
    """
    html = html or ""
    out: list[tuple[str, bool, bool, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []
    main = frame = named = 0
    # Names and forms around the outermost article or main element, and those that count against it.
    around = against = 0
    at = 0

    def flush() -> None:
        text = " ".join(markup.unescape("".join(parts)).split())
        if text:
            out.append((text, main > 0, frame > 0 or named > (around if main else 0), against if main else 0))
        parts.clear()

    def pop(to: int) -> None:
        nonlocal main, frame, named
        while len(stack) > to:
            _, in_main, in_frame, in_named = stack.pop()
            main -= in_main
            frame -= in_frame
            named -= in_named

    while m := _MARKUP.search(html, at):
        parts.append(html[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        rest = m["rest"] or m["rest2"] or ""
        if name in _BLOCK:
            flush()
        if m["close"] or m["close2"]:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == name:
                    pop(n)
                    break
            continue
        if name in _RAW:
            if not rest.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
                at = close.end() if close else len(html)
            continue
        if name in _VOID or rest.endswith("/"):
            continue
        if name in _BLOCK and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        in_main = name in _MAIN or 'role="main"' in rest
        within = not in_main and name not in ("html", "body")
        in_frame = within and name != "form" and (name in _FRAME or (name == "header" and not main))
        in_named = (
            within
            and not in_frame
            and (name == "form" or ("=" in rest and not _FRAME_NAMES.isdisjoint(_split_names(rest))))
        )
        if in_main and not main:
            around = named
            against = named if name == "article" and 'role="main"' not in rest else 0
        stack.append((name, in_main, in_frame, in_named))
        main += in_main
        frame += in_frame
        named += in_named
    parts.append(html[at:])
    flush()
    least = min((n for _, in_main, in_frame, n in out if in_main and not in_frame), default=0)
    return [(text, in_main, in_frame or n > least) for text, in_main, in_frame, n in out]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, html in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            found = blocks(html)
            article = any(main and not frame for _, main, frame in found)
            text = " ".join(t for t, main, frame in found if main and not frame)
            # The stream that the host's pages are compared by: all but the article.
            rest = [(t, frame) for t, main, frame in found if not (article and main and not frame)]
            scope = xxhash.xxh64_intdigest((host or "").encode("utf-8", "surrogatepass"))
            parts = [len(t) for t, main, frame in found if main and not frame]
            sizes = [len(t) for t, _ in rest]
            rows.append((text, parts, article, " ".join(t for t, _ in rest), [f for _, f in rest], sizes, scope))
        text, parts, article, stream, frames, sizes, scope = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(text, pa.string()),
                pa.array(parts, pa.list_(pa.int64())),
                pa.array(article, pa.bool_()),
                pa.array(stream, pa.string()),
                pa.array(frames, pa.list_(pa.bool_())),
                pa.array(sizes, pa.list_(pa.int64())),
                pa.array(np.array(scope, np.uint64).view(np.int64)),
            ],
            ["page_id", "url", "text", "parts", "article", "stream", "frames", "sizes", "scope"],
        )


def _batch_grams(batch: pa.RecordBatch, length: int):
    """Streams as bytes, and for their anchors: page in the batch, place, hash of host and gram, window range."""
    streams = [s.encode("utf-8", "surrogatepass") for s in batch.column(1).to_pylist()]
    ends = np.cumsum([len(s) for s in streams])
    place, h, first, last = anchors(np.frombuffer(b"".join(streams), np.uint8), ends, length)
    own = np.searchsorted(ends, place, side="right")
    h = h ^ batch.column(2).to_numpy().view(np.uint64)[own]
    return streams, own, place - np.concatenate([[0], ends])[own], h, place - first, last - place + length


def _gram_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, own, _, h, _, _ = _batch_grams(batch, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(batch.column(0).to_numpy()[own])], ["gram", "row"]
                )

    return run


def _cuts(length: int, batches: Iterator[pa.RecordBatch], select):
    """Rows, places, bytes before and from the anchor, and grams of the selected anchors."""
    for batch in batches:
        if batch.num_rows:
            streams, own, place, h, left, right = _batch_grams(batch, length)
            on = select(h)
            own, place, left, right = (x[on].tolist() for x in (own, place, left, right))
            before = [streams[n][p - u : p] for n, p, u in zip(own, place, left, strict=True)]
            after = [streams[n][p : p + v] for n, p, v in zip(own, place, right, strict=True)]
            yield batch.column(0).to_numpy()[own].tolist(), place, before, after, h[on]


def _occurrences(length: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, place, before, after, h in _cuts(length, batches, shared.value.usual):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    pa.array(row, pa.int64()),
                    pa.array(place, pa.int64()),
                    pa.array([b[::-1] for b in before], pa.binary()),
                    pa.array(after, pa.binary()),
                ],
                ["gram", "row", "place", "before", "after"],
            )

    return run


def _sorted_spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, ["gram"]):
            gram, own, place = (rows[c].to_numpy() for c in ("gram", "row", "place"))
            before, after = rows["before"].to_pylist(), rows["after"].to_pylist()
            bounds = [0, *(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), len(gram)]
            reach: list[tuple[int, int]] = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                reach += covered(before[a:b], after[a:b], length, own[a:b].tolist()) if b - a > 1 else [(0, 0)]
            u, v = np.array(reach, np.int64).reshape(-1, 2).T
            on = v > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[on]), pa.array((place - u)[on]), pa.array((place + v)[on])], ["row", "start", "end"]
            )

    return run


def _windows(length: int, shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, int]]:
        for row, place, before, after, h in _cuts(length, batches, shared.value.hot):
            for gram, r, p, b, a in zip(h.tolist(), row, place, before, after, strict=True):
                text, key = b + a, gram.to_bytes(8, "big")
                for n in range(len(text) - length + 1):
                    yield xxhash.xxh128_digest(key + text[n : n + length]), r, p - len(b) + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from window_batches(rows(batches), pa.int64(), "row")

    return run


def repeated_spans(streams: DataFrame, length: int = LENGTH, in_task: int = SORTED) -> DataFrame:
    """``row`` and ``spans``: runs of bytes in substrings of ``length`` bytes that another row of the same scope has.

    ``streams`` has ``row``, ``stream`` and ``scope`` (a hash). A gram that very many rows have, as in the frame of a
    large host, is not sorted in one task: its windows are counted by hash.
    """
    spark = streams.sparkSession
    grams = streams.mapInArrow(_gram_rows(length), "gram bigint, row bigint")
    again = grams.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("low"), F.max("row").alias("high")
    )
    again = materialize(again.where("low < high").select("gram", "n"), "page-grams")
    selection = select_grams(again, in_task)
    shared = spark.sparkContext.broadcast(selection)
    spans = (
        streams.mapInArrow(
            _occurrences(length, shared), "gram bigint, row bigint, place bigint, before binary, after binary"
        )
        .repartition("gram")
        .sortWithinPartitions("gram")
        .mapInArrow(_sorted_spans(length), "row bigint, start bigint, end bigint")
    )
    if selection.frequent is not None:
        windows = streams.mapInArrow(_windows(length, shared), "window binary, row bigint, start bigint")
        windows = materialize(windows, "page-windows")
        shares = windows.groupBy("window").agg(F.min("row").alias("low"), F.max("row").alias("high"))
        shares = materialize(shares.where("low < high").select("window"), "shared-windows")
        more = windows.join(shares, "window", "left_semi")
        spans = spans.union(more.select("row", "start", (F.col("start") + length).alias("end")))
    return spans.groupBy("row").agg(merged_spans().alias("spans"))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unique runs of pages without an article."""
    for batch in batches:
        columns = {name: batch.column(n).to_pylist() for n, name in enumerate(batch.schema.names)}
        texts = []
        for stream, frames, sizes, spans in zip(
            *(columns[c] for c in ("stream", "frames", "sizes", "spans")), strict=True
        ):
            # Whole words: one that a repeated string only touches is kept.
            inside = np.zeros(len(stream.encode("utf-8", "surrogatepass")) + 1, bool)
            for s in spans or []:
                inside[s["start"] : s["end"]] = True
            kept, at, begin = [], 0, 0
            for frame, size in zip(frames, sizes, strict=True):
                for word in stream[at : at + size].split(" "):
                    width = len(word.encode("utf-8", "surrogatepass"))
                    if not frame and not inside[begin : begin + width].all():
                        kept.append(word)
                    begin += width + 1
                at += size + 1
            texts.append(" ".join(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def _digest(text: str) -> bytes:
    return xxhash.xxh128_digest(text.encode("utf-8", "surrogatepass"))


def _split(text: str, sizes: list[int]) -> list[str]:
    """The blocks that ``text`` was joined of."""
    out, at = [], 0
    for size in sizes:
        out.append(text[at : at + size])
        at += size + 1
    return out


def _gram(block: bytes, scope: int) -> int:
    return xxhash.xxh64_intdigest(block, seed=scope & (1 << 64) - 1)


def _article_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the distinct blocks of articles, and of the whole article."""
    for batch in batches:
        rows: list[tuple] = []
        for text, sizes, scope in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
            whole = _digest(text)
            rows += [(b, scope, whole) for b in dict.fromkeys(map(_digest, _split(text, sizes)))]
        block, scope, article = zip(*rows, strict=True) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(block, pa.binary()), pa.array(scope, pa.int64()), pa.array(article, pa.binary())],
            ["block", "scope", "article"],
        )


def _gram_of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = map(_gram, batch.column(0).to_pylist(), batch.column(1).to_pylist())
        grams = np.array(list(grams), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams)], ["block", "scope", "gram"])


def _possible(shared):
    """Articles and those of their blocks that may be boilerplate, as far as the filter tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, scopes = (batch.column(n).to_pylist() for n in range(3))
            found = []
            for text, own, scope in zip(texts, sizes, scopes, strict=True):
                digests = list(dict.fromkeys(map(_digest, _split(text, own))))
                on = shared.value.has(np.array([_gram(d, scope) for d in digests], np.uint64))
                found.append([d for d, yes in zip(digests, on, strict=True) if yes])
            maybe = pa.array(found, pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, maybe], [*batch.schema.names, "maybe"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Articles without their boilerplate, unless that is most of them."""
    for batch in batches:
        columns = {name: batch.column(n).to_pylist() for n, name in enumerate(batch.schema.names)}
        texts = []
        for text, sizes, blocks_off in zip(*(columns[c] for c in ("text", "parts", "off")), strict=True):
            off = set(blocks_off or [])
            kept = " ".join(b for b in _split(text, sizes) if _digest(b) not in off)
            texts.append(kept if 2 * len(kept) >= len(text) else text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def repeated_blocks(articles: DataFrame, own: int = OWN_ARTICLES, share: float = ARTICLE_SHARE) -> DataFrame:
    """``block`` (a digest) and ``scope`` of the boilerplate in articles (``text``, ``parts``, ``scope``).

    Equal articles count once. A block is boilerplate if ``own`` articles of its host have it, and no other host has
    or ``share`` of the articles of the host do.
    """
    rows = articles.select("text", "parts", "scope").mapInArrow(
        _article_blocks, "block binary, scope bigint, article binary"
    )
    rows = materialize(rows.distinct(), "article-blocks")
    by_host = materialize(rows.groupBy("block", "scope").agg(F.count(F.lit(1)).alias("n")), "host-blocks")
    often = by_host.where(F.col("n") >= own)
    hosts = by_host.groupBy("block").agg(F.count(F.lit(1)).alias("hosts"))
    often = materialize(often.join(hosts, "block"), "often")
    sizes = rows.select("scope", "article").distinct().groupBy("scope").agg(F.count(F.lit(1)).alias("articles"))
    found = join_lookup(often, sizes, ["scope"], key_counts(often, ["scope"]), spread_by="block")
    return found.where((F.col("hosts") == 1) | (F.col("n") >= share * F.col("articles"))).select("block", "scope")


def _judged(articles: DataFrame, schema: str) -> DataFrame:
    """``page_id``, ``url``, ``text`` of articles without their host's boilerplate.

    Only articles with blocks that pass a filter meet the blocks themselves; the texts of others are not shuffled.
    """
    spark = articles.sparkSession
    off = repeated_blocks(articles).mapInArrow(_gram_of_block, "block binary, scope bigint, gram bigint")
    off = materialize(off, "article-boilerplate")
    if off.isEmpty():
        return articles.select("page_id", "url", "text")
    shared = spark.sparkContext.broadcast(gram_filter(off.select("gram")))
    columns = ["text", "parts", "scope", "row", "page_id", "url"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in articles.select(*columns).schema)
    seen = articles.select(*columns).mapInArrow(_possible(shared), fields + ", maybe array<binary>")
    clear = seen.where(F.size("maybe") == 0).select("page_id", "url", "text")
    met = seen.where(F.size("maybe") > 0)
    hits = met.select("row", "scope", F.explode("maybe").alias("block"))
    # At most the blocks of one page come together.
    hits = hits.join(off, ["block", "scope"], "left_semi").groupBy("row").agg(F.collect_list("block").alias("off"))
    met = met.join(materialize(hits, "page-boilerplate"), "row", "left")
    return clear.union(met.select("page_id", "url", "text", "parts", "off").mapInArrow(_without, schema))


def extract(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    length: int = LENGTH,
    in_task: int = SORTED,
) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each row.

    The streams of all pages are evidence of what their host repeats, but only pages without an article meet the
    spans; blocks of articles are judged whole by ``repeated_blocks``.

    Null and empty pages have the empty text, as have pages that are all frame. Pages without a host are one host.
    Repeated rows are distinct pages. No rows give no rows.
    """
    host = F.regexp_extract(F.lower(col(url_column)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rows = pages.select(
        col(id_column).cast("long").alias("page_id"),
        col(url_column).alias("url"),
        host.alias("host"),
        col(html_column).cast("string").alias("html"),
    )
    url_type = rows.schema["url"].dataType.simpleString()
    parsed = rows.mapInArrow(
        _parse,
        f"page_id bigint, url {url_type}, text string, parts array<bigint>, article boolean, stream string, frames array<boolean>,"
        " sizes array<bigint>, scope bigint",
    )
    # The row numbers are written, so later reads agree on them.
    parsed = materialize(parsed.withColumn("row", F.monotonically_increasing_id()), "pages")
    spans = materialize(repeated_spans(parsed.select("row", "stream", "scope"), length, in_task), "page-spans")
    schema = f"page_id bigint, url {url_type}, text string"
    found = _judged(parsed.where("article"), schema)
    open_pages = parsed.where("not article").join(spans, "row", "left")
    open_pages = open_pages.select("page_id", "url", "stream", "frames", "sizes", "spans")
    found = found.union(open_pages.mapInArrow(_keep, schema))
    return found.withColumn("n_chars", F.length("text").cast("long"))
