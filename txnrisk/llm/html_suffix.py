"""Main text of web pages with a host suffix array.

Pages are parsed into blocks of text: those of an article container, those with a boilerplate role
(menu, header, footer, sidebar, notice, advert, form, reader comments) and the rest. The tokens of
all blocks outside an article are one stream per page; the streams of a host are concatenated and
their suffixes sorted by prefix doubling. Neighbours in that order with a common prefix of enough
tokens, from distinct pages, are repeated substrings. Those on enough pages that differ otherwise
are boilerplate; of the blocks without a role only the tokens they leave stay. Copies of a page count
as one page. Of an article's own text, only whole blocks that most of a host's articles have go.

A host may be any share of the pages, so its array is built in pieces, one per batch of pages. The
heads of each piece's groups (a hash of the prefix, the smallest and largest page) are merged over
all pieces, which gives the same repeats as one array over the whole host.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import in_batches, small, stored
from txnrisk.llm.words import SPACED, Words, mix, pieces, run_hash

#: Tokens that a repeated substring has at least.
LENGTH = 7
#: A repeat in the middle of a block is removed from so many covered tokens on.
LONG = 30
#: Unique tokens between removed ones stay from so many on.
LEAST_RUN = 3
#: Share of a host's distinct pages, and pages, that have a repeat which is boilerplate.
SHARE, LEAST_PAGES = 0.05, 2
#: Share of a host's distinct articles, and articles, that have a whole block which is boilerplate inside the container.
INNER_SHARE, INNER_LEAST = 0.5, 10
#: A page with less than this share of tokens that no other page has is a copy of others.
OWN = 0.1

ARTICLE, PLAIN, ROLE = 1, 0, 2

# Elements of HTML by what they mean for text.
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "link", "mark", "meta", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_NEVER = {"head", "noscript", "template", "object", "svg", "math", "canvas", "audio", "video", "select", "datalist", "button", "map"}
_ROLES = {"nav", "menu", "footer", "aside", "form", "dialog"}
_ARIA = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_HARD = r"ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:s|tion|tions)?|breadcrumbs?|sidebar|side|aside|widgets?|notices?|cookies?|consent|gdpr|newsletter|subscribe|signup|related|recommend(?:ed|ations?)|comments?|replies|reply|respond|disqus|pagination|pager|disclaimer|copyright"
_SOFT = r"banner|nav|navbar|navigation|menu|menus|masthead|topbar|footer|alert|popup|modal|overlay|share|sharing|social|login|search|header"
#: Words beside a name in one class: where it is and what shape it has, not what it has or how it is.
_BESIDE = r"site|page|global|main|primary|secondary|post|article|entry|user|top|bottom|left|right|upper|lower|inner|outer|bar|box|wrap|wrapper|container|area|section|block|list|item|items|links|link|buttons?|form|panel|slot|unit|text|body|icons|toolbar|posts?|articles?|stories|content|thread|count|title|feed|cards?|message|\d+"
_NAMES = re.compile(rf"(?:(?:{_BESIDE})[_-]+)*(?:({_HARD})|{_SOFT})(?:[_-]+(?:({_HARD})|{_SOFT}|{_BESIDE}))*")
#: Elements that a head may hold; any other one begins the body.
_HEAD = {"meta", "link", "title", "base", "style", "script", "noscript", "template", "basefont", "bgsound", "noframes", "head"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_CLOSERS: dict[str, re.Pattern] = {}


def _closer(tag: str) -> re.Pattern:
    if tag not in _CLOSERS:
        _CLOSERS[tag] = re.compile(rf"</{re.escape(tag)}(?:[\s/][^>]*)?>", re.I)
    return _CLOSERS[tag]


def _role(tag: str, attributes: str, inside: bool) -> str:
    """'drop' for what is no text at all, 'role' for boilerplate, 'soft' for boilerplate by a name that an
    article inside overrules, 'article' for a container, else ''."""
    if tag in _NEVER:
        return "drop"
    if tag in _ROLES or tag == "header" and not inside:
        return "role"
    named = {}
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            named.setdefault(m[1].lower(), (m[2] or "").strip("\"'").lower())
    if named:
        if "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style", "")):
            return "drop"
        role = named.get("role", "")
        if role in _ARIA:
            return "role"
        if tag not in ("html", "body", "article", "main"):
            soft = False
            for name in f"{named.get('class', '')} {named.get('id', '')}".split():
                m = _NAMES.fullmatch(name)
                if m and (m[1] or m[2]):
                    return "role"
                soft |= m is not None and not (inside and "header" in name)
            if soft:
                return "soft"
        if role in ("main", "article"):
            return "article"
    return "article" if tag in ("article", "main") else ""


def blocks(source: str) -> list[tuple[int, str]]:
    """(kind, text) of the page's blocks in order; kinds ARTICLE, PLAIN, ROLE.

    References are decoded, white space is one space, blocks without text are left out.
    """
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str, int]] = []
    state = {"drop": 0, "role": 0, "soft": 0, "article": 0}

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((ROLE if state["role"] or state["soft"] else ARTICLE if state["article"] else PLAIN, text))

    def pop() -> str:
        name, role, soft = stack.pop()
        if role:
            state[role] -= 1
        if role == "article":
            state["soft"] = soft
        return name

    def leave_head() -> None:
        if stack and stack[-1][0] == "head":
            pop()

    def put(text: str) -> None:
        if text and state["drop"] and not text.isspace():
            leave_head()
        if text and not state["drop"]:
            held.append(text)

    at = 0
    while True:
        m = _TOKEN.search(source, at)
        if m is None:
            put(source[at:])
            break
        put(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, close, attributes = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if tag not in _INLINE:
            if tag == "br":
                put(" ")
            else:
                flush()
        if close:
            if any(t == tag for t, *_ in stack):
                flush_after = any(r for _, r, _ in stack[max(k for k, (t, *_) in enumerate(stack) if t == tag) :])
                if flush_after:
                    flush()
                while pop() != tag:
                    pass
            continue
        if tag not in _HEAD:
            leave_head()
        if tag in _RAW:
            end = _closer(tag).search(source, at)
            if tag == "textarea" or tag == "title":
                flush()
            at = len(source) if end is None else end.end()
            continue
        if tag in _VOID:
            continue
        role = _role(tag, attributes, state["article"] > 0)
        if role:
            flush()
            state[role] += 1
        soft = state["soft"]
        if role == "article":
            state["soft"] = 0
        # an open paragraph or list item ends where the next one begins
        if tag in ("p", "li") and stack and stack[-1][0] == tag and not stack[-1][1]:
            stack.pop()
        stack.append((tag, role, soft))
    flush()
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each page and its stream's token hashes."""
    for batch in batches:
        for part, sources in pieces(batch, batch.column(2)):
            kinds, texts, sizes = [], [], []
            for source in sources.to_pylist():
                own = blocks(source or "")
                kinds += [k for k, _ in own]
                texts += [t for _, t in own]
                sizes.append(len(own))
            kind = np.array(kinds, np.int8)
            words = Words(pa.array(texts, pa.string()), SPACED, lower=False)
            places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            tokens = np.where(kind == ARTICLE, 0, words.counts)
            struct = pa.StructArray.from_arrays([pa.array(kind), pa.array(texts, pa.string()), pa.array(tokens.astype(np.int32)), pa.array(words.counts.astype(np.int32))], ["kind", "text", "tokens", "size"])
            first = np.concatenate([[0], np.cumsum(tokens)])[places]
            stream = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words.hash[np.repeat(kind != ARTICLE, words.counts)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), part.column(4), pa.ListArray.from_arrays(pa.array(places), struct), stream], names=["page_id", "url", "key", "host", "blocks", "stream"])


def suffix_groups(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array up to ``length`` tokens and the rank of each suffix: suffixes of equal rank
    have a common prefix of that length. Sorting doubles the compared prefix in each step."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, seen = len(rank), 1
    while seen < length:
        step = min(seen, length - seen)
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:] if step < n else []
        rank = np.unique(rank * np.int64(n + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        seen += step
    return np.argsort(rank, kind="stable"), rank


def _repeats(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Heads of the suffix groups of each piece: host, head, smallest and largest page."""
    for batch in batches:
        host, lists = batch.column(0), batch.column(2)
        pages = batch.column(1).to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy().view(np.uint64)
        sizes = lists.value_lengths().to_numpy()
        code = host.dictionary_encode().indices.to_numpy()
        order = np.argsort(code, kind="stable")
        begin = np.cumsum(sizes) - sizes
        # streams host by host, each closed by a token of its own
        total = int(sizes.sum()) + len(sizes)
        tokens, page, where = np.zeros(total, np.uint64), np.zeros(total, np.int64), np.zeros(total, np.int64)
        at = 0
        for i in order.tolist():
            n = int(sizes[i])
            tokens[at : at + n] = mix(flat[begin[i] : begin[i] + n] ^ mix(np.array([code[i]], np.uint64)))
            tokens[at + n] = i
            page[at : at + n + 1], where[at : at + n + 1] = i, np.arange(n + 1)
            at += n + 1
        array, rank = suffix_groups(tokens, length)
        array = array[where[array] + length <= sizes[page[array]]]
        if not len(array):
            continue
        edges = np.flatnonzero(np.concatenate([[True], np.diff(rank[array]) > 0]))
        low, high = np.minimum.reduceat(pages[page[array]], edges), np.maximum.reduceat(pages[page[array]], edges)
        first = array[edges]
        heads = run_hash(flat, begin[page[first]] + where[first], length)
        yield pa.RecordBatch.from_arrays([host.take(pa.array(page[first])), pa.array(heads.view(np.int64)), pa.array(low), pa.array(high)], names=["host", "head", "low", "high"])


def _heads(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """host, head, key, page, place of a stream's substrings; ``plain`` if one touches a block without
    a role, ``edge`` if it begins or ends with a block."""
    for batch in batches:
        keys, pages, hosts, lists, blocks_of = (batch.column(k) for k in range(5))
        flat = lists.flatten().to_numpy().view(np.uint64)
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        row, head, place, touch, edge = [], [], [], [], []
        for i, own in enumerate(blocks_of.to_pylist()):
            plain = np.repeat([b["kind"] == PLAIN for b in own], [b["tokens"] for b in own])
            n = len(plain) - length + 1
            if n <= 0:
                continue
            row.append(np.full(n, i))
            head.append(run_hash(flat, at[i] + np.arange(n), length))
            place.append(np.arange(n))
            touch.append(np.convolve(plain, np.ones(length, int), "valid") > 0)
            bounds = np.zeros(len(plain) + 1, bool)
            bounds[np.cumsum([0, *(b["tokens"] for b in own)])] = True
            edge.append(bounds[:n] | bounds[length:])
        row, head, place, touch, edge = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, head, place, touch, edge))
        row = pa.array(row)
        columns = [hosts.take(row), pa.array(head.view(np.int64)), keys.take(row), pages.take(row), pa.array(place.astype(np.int32)), pa.array(touch.astype(bool)), pa.array(edge.astype(bool))]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "head", "key", "page", "place", "plain", "edge"])


def left_over(own: list[tuple[int, str]], places: list[int], edged: set[int], length: int) -> str:
    """The text of a page's (kind, text) without roles and without what the repeats at ``places`` of its stream cover.

    Inside a block, covered tokens go if they are the whole block, or a run of at least LONG,
    or if a repeat that also begins or ends blocks elsewhere (``edged``) does so here; of the rest of
    such a block, runs of at least LEAST_RUN stay.
    """
    split = [[] if kind == ARTICLE else text.split(" ") for kind, text in own]
    marks = np.zeros(sum(map(len, split)) + 1, np.int64)
    np.add.at(marks, np.array(places, np.int64), 1)
    np.add.at(marks, np.array(places, np.int64) + length, -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(marks)[:-1] > 0, [0]])))
    runs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    out, at, k = [], 0, 0
    for (kind, text), tokens in zip(own, split, strict=True):
        start, stop = at, at + len(tokens)
        at = stop
        while k < len(runs) and runs[k][1] <= start:
            k += 1
        if kind == ARTICLE:
            out.append(text)
        if kind != PLAIN:
            continue
        free, gone = start, False
        for a, b in runs[k:]:
            if a >= stop:
                break
            low, high = max(a, start), min(b, stop)
            at_edge = low == start and start in edged or high == stop and stop - length in edged
            if (low, high) == (start, stop) or high - low >= (length if at_edge else LONG):
                if low - free >= LEAST_RUN:
                    out.append(" ".join(tokens[free - start : low - start]))
                free, gone = high, True
        if not gone or stop - free >= LEAST_RUN:
            out.append(" ".join(tokens[free - start :]))
    return " ".join(out)


def _left(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks_of, places, edged = (batch.column(k).to_pylist() for k in (2, 3, 4))
        texts = [left_over([(b["kind"], b["text"]) for b in own], p, set(e), length) for own, p, e in zip(blocks_of, places, edged, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def _without_inner(parsed: DataFrame, length: int) -> DataFrame:
    """``parsed`` without the article blocks that most of the host's distinct articles have."""
    inside = F.filter("blocks", lambda b: b["kind"] == ARTICLE)
    bodies = parsed.select("host", inside.alias("inside")).where("size(inside) > 0")
    bodies = bodies.select("host", F.xxhash64(F.transform("inside", lambda b: b["text"])).alias("body"), "inside")
    marks = F.transform(F.filter("inside", lambda b: b["size"] >= length), lambda b: F.xxhash64(b["text"]))
    of = bodies.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("of")).where(F.col("of") >= INNER_LEAST)
    times = bodies.select("host", "body", F.explode(marks).alias("mark")).distinct().groupBy("host", "mark").agg(F.count("*").alias("times"))
    common = times.where(F.col("times") >= INNER_LEAST).join(small(of), "host").where(F.col("times") >= INNER_SHARE * F.col("of"))
    common = small(stored(common.groupBy("host").agg(F.collect_set("mark").alias("common")), "inner"))
    size = partial(F.aggregate, initialValue=F.lit(0), merge=lambda n, b: n + b["size"])
    gone = F.filter("blocks", lambda b: (b["kind"] == ARTICLE) & F.array_contains("common", F.xxhash64(b["text"])))
    left = F.filter("blocks", lambda b: (b["kind"] != ARTICLE) | ~F.array_contains("common", F.xxhash64(b["text"])))
    cut = F.col("common").isNotNull() & (2 * size(gone) <= size(inside))
    return parsed.join(common, "host", "left").withColumn("blocks", F.when(cut, left).otherwise(F.col("blocks"))).drop("common")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", length: int = LENGTH) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``; n_chars counts code points.

    A null, empty or text-free page gives an empty text. Pages without a url share one host; a
    page without an id is told from others by its url and content only. Repeated rows (equal ids)
    are one page to the suffix array, so a page never makes its own text boilerplate, and so are
    copies: pages that have less than OWN of their text for themselves and share the rest. Text without
    a role, beside an article container or without one, keeps what repeats on enough pages of its host
    leave (``left_over``). A container loses the blocks of ``length`` tokens or more that most distinct
    articles of the host have, unless these are more than half of its text.
    Other columns are ignored.
    """
    url, source = F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string")
    key = F.xxhash64(F.col(f"`{id_col}`"), url, source)
    rows = in_batches(pages).select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), source.alias("html"), key.alias("key"), _host(url).alias("host"))
    kind = "page_id long, url string, key long, host string, blocks array<struct<kind: byte, text: string, tokens: int, size: int>>, stream array<long>"
    parsed = stored(rows.mapInArrow(_parsed, kind), "blocks").withColumn("page", F.coalesce("page_id", "key"))
    parsed = _without_inner(parsed, length)
    # a host without a block that repeats could shorten needs no array
    open_hosts = small(parsed.where(F.exists("blocks", lambda b: b["kind"] == PLAIN)).select("host").distinct())
    opened = parsed.join(open_hosts, "host", "left_semi")
    groups = opened.where("size(stream) > 0").select("host", "page", "stream").mapInArrow(partial(_repeats, length=length), "host string, head long, low long, high long")
    repeats = groups.groupBy("host", "head").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("host", "head")
    bare = F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["tokens"].alias("tokens")))
    heads = opened.select("key", "page", "host", "stream", bare.alias("blocks")).mapInArrow(partial(_heads, length=length), "host string, head long, key long, page long, place int, plain boolean, edge boolean")
    hits = stored(heads.join(repeats, ["host", "head"]), "hits")

    # which pages differ otherwise: copies are named by a repeat on as many pages as the lower quarter of their repeats
    times = hits.groupBy("host", "head").agg(F.count_distinct("page").alias("pages"))
    own = hits.where("plain").join(times, ["host", "head"]).groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("places"), F.sort_array(F.collect_set(F.struct("pages", "head"))).alias("rated"))
    nexts = F.slice("places", F.lit(2), F.size("places"))
    covered = F.aggregate(F.zip_with("places", nexts, lambda a, b: F.least(F.lit(length), F.coalesce(b - a, F.lit(length)))), F.lit(0), lambda x, y: x + y)
    level = F.element_at("rated", F.ceil(F.size("rated") / 4).cast("int"))["pages"]
    own = own.withColumn("level", level).select("key", F.get(F.filter("rated", lambda r: r["pages"] == F.col("level")), F.lit(0))["head"].alias("shared"), covered.alias("covered"))
    total = F.aggregate(F.filter("blocks", lambda b: b["kind"] != ROLE), F.lit(0), lambda n, b: n + b["size"])
    sized = opened.select("key", "page", "host", total.alias("total")).distinct()
    named = F.when(F.col("covered").isNull() | (F.col("total") - F.col("covered") >= OWN * F.col("total")), F.col("page")).otherwise(F.col("shared"))
    names = stored(sized.join(own, "key", "left").select("key", "host", named.alias("name")), "names")
    hosts = small(names.groupBy("host").agg(F.count_distinct("name").alias("of")))
    times = [F.count_distinct("name").alias("times"), F.count_distinct(F.when(F.col("edge"), F.col("name"))).alias("edge_times")]
    found = hits.select("host", "head", "key", "edge").distinct().join(names.select("key", "name"), "key").groupBy("host", "head").agg(*times)
    least = F.greatest(F.lit(LEAST_PAGES), F.ceil(SHARE * F.col("of")))
    enough = found.join(hosts, "host").where(F.col("times") >= least).select("host", "head", (F.col("edge_times") >= least).alias("edges"))
    ends = F.collect_set(F.when(F.col("edge") & F.col("edges"), F.col("place")))
    places = hits.where("plain").join(enough, ["host", "head"]).groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("places"), ends.alias("edged"))
    places = stored(places, "covered").withColumnRenamed("key", "covered_key")
    full = parsed.join(places, F.col("key") == F.col("covered_key"), "left")
    kept = F.transform(F.filter("blocks", lambda b: b["kind"] != ROLE), lambda b: b["text"])
    whole = full.where("places IS NULL").select("page_id", "url", F.concat_ws(" ", kept).alias("text"))
    cut = full.where("places IS NOT NULL")
    cut = cut.select("page_id", "url", "blocks", "places", "edged").mapInArrow(partial(_left, length=length), "page_id long, url string, text string")
    return whole.union(cut).withColumn("n_chars", F.char_length("text").cast("long"))
