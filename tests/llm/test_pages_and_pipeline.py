"""Page operators, the pipeline and the registration."""

from __future__ import annotations

import hashlib
import html
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_fixtures import documents, odd, odd_pages, pages, sf  # noqa: F401
from test_documents import components_by_force, contamination_by_force
from txnrisk.llm import html_suffix, queries, warc
from txnrisk.session import scratch_path


def rows(df) -> list:
    return df.collect()


# 1 main text


def article_by_force(page: str | None) -> str:
    m = re.search(r"<article>(.*?)</article>", page or "", re.S)
    if not m:
        return ""
    text = re.sub(r"</?(?:p|h1|br)>", " ", m[1])
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", text)).split())


def test_main_text_of_all_pages(spark, sf, pages):
    want = {r["page_id"]: article_by_force(r["html"]) for r in rows(pages)}
    found = rows(queries.op1_host_suffix_array(spark, sf))
    assert len(found) == len(want)
    for r in found:
        assert r["text"] == want[r["page_id"]]
        assert r["n_chars"] == len(r["text"])


def test_roles_raw_text_and_references():
    page = """<!DOCTYPE html><head><title>t</title></head><body><header>top</header><div class="cookie-notice">ok?</div>
    <main><h1>A &lt;b&gt;&nbsp;c</h1><p>x<br>y <b>bo</b>ld<p>un<!-- no -->closed<aside>side</aside><form><p>q</p></form>
    <script>if (a < b) "</p>"</script><style>p{}</style><div id="comments"><article>nice</article></div>
    <ul><li>one<li>two</ul> 3 < 4</main><footer>f</footer>"""
    kinds = html_suffix.blocks(page)
    assert [t for k, t in kinds if k == html_suffix.ARTICLE] == ["A <b> c", "x y bold", "unclosed", "one", "two", "3 < 4"]
    assert {t for k, t in kinds if k == html_suffix.ROLE} == {"top", "ok?", "side", "q", "nice", "f"}
    assert [t for k, t in kinds if k == html_suffix.PLAIN] == []


@pytest.mark.parametrize("name", ["layout has-sidebar", "with-header", "no-ads", "nav-open", "page-header", "site-nav"])
def test_an_article_in_a_layout_wrapper_stays(name):
    kinds = html_suffix.blocks(f'<body><div class="{name}"><nav>n</nav><article>body<div class="share">s</div></article></div>')
    assert kinds == [(html_suffix.ROLE, "n"), (html_suffix.ARTICLE, "body"), (html_suffix.ROLE, "s")]


@pytest.mark.parametrize("name", ["comments", "sidebar", "related-posts sidebar-left", "cookie-notice"])
def test_named_boilerplate_keeps_its_role(name):
    assert html_suffix.blocks(f'<div class="{name}"><article>x</article></div><p>y') == [(html_suffix.ROLE, "x"), (html_suffix.PLAIN, "y")]


@pytest.mark.parametrize("page", ["<head><title>t</title><meta x><p>a</p><p>b</p>", "<head><title>t</title><body><p>a</p>b", "<html><head><style>s</style>a<p>b</p>", "<head><noscript>n</noscript><script>s</script></head><p>a<p>b"])
def test_a_head_ends_where_the_body_begins(page):
    assert html_suffix.blocks(page) == [(html_suffix.PLAIN, "a"), (html_suffix.PLAIN, "b")]


@pytest.mark.parametrize("page", ["", "<", "<p", "a<b>c", "</p></div>x", "<script>never ends", "<!-- never ends", "<p class='ad>x</p>", "<div hidden>x</div>y", "&#x110000; &bogus; &amp"])
def test_broken_markup_does_not_stop(page):
    assert isinstance(html_suffix.blocks(page), list)


def test_suffix_ranks_equal_sorted_suffixes():
    rng = np.random.Generator(np.random.PCG64(1))
    tokens = rng.integers(0, 4, 300).astype(np.uint64)
    for length in (1, 2, 3, 5, 8):
        array, rank = html_suffix.suffix_groups(tokens, length)
        heads = [tuple(tokens[i : i + length].tolist()) for i in range(300)]
        assert [heads[i] for i in array] == sorted(heads)
        same = defaultdict(set)
        for h, r in zip(heads, rank.tolist(), strict=True):
            same[h].add(r)
        assert all(len(r) == 1 for r in same.values()) and len(same) == len(set(rank.tolist()))


@pytest.mark.parametrize("parts", [1, 7])
def test_repeats_across_pages_of_a_host_are_removed(spark, parts):
    menu, legal = "Home News Sport Weather Contact us today", "All rights reserved by the owners of this site"
    made = [(k, f"http://h.example/{k}", f"<div>{menu}</div><div>Story {k} is about {' '.join(f'w{k}x{j}' for j in range(20))}</div><div>{legal}</div>") for k in range(20)]
    made.append((90, "http://other.example/", f"<div>{menu}</div><div>Alone here</div>"))
    made.append((91, "http://other.example/a", f"<article>{legal}</article><div>{menu} more</div>"))
    made.append((92, "http://one.example/a", f"<div>{legal}</div>"))
    made.append((92, "http://one.example/a", f"<div>{legal}</div>"))
    df = spark.createDataFrame(made, "page_id long, url string, html string").repartition(parts)
    found = defaultdict(list)
    for r in rows(html_suffix.main_text(df)):
        found[r["page_id"]].append(r["text"])
    for k in range(20):
        assert found[k] == [f"Story {k} is about {' '.join(f'w{k}x{j}' for j in range(20))}"]
    assert found[90] == ["Alone here"]
    assert found[91] == [legal]
    assert found[92] == [legal, legal]


def prose(rng, n: int) -> str:
    """Words with ordinary phrases strewn in."""
    phrases = ["at the end of the day", "one of the most", "on the other hand it is", "as a matter of fact"]
    return " ".join(phrases[rng.integers(0, 4)] if rng.random() < 0.1 else f"w{rng.integers(0, 3000)}" for _ in range(n))


def test_copies_keep_their_text_and_menus_go(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    menu, body = "Home News Sport Weather Contact us today", prose(rng, 120)
    dated = body.replace(" ", " 2 May ", 1)
    made = [(k, f"http://h.example/{k}", f"<div>{menu}</div><div>{prose(rng, 120)}</div>") for k in range(10)]
    made += [(100 + k, f"http://h.example/c{k}", f"<div>{menu}</div><div>{b}</div>") for k, b in enumerate([body, body, dated])]
    made += [(200 + k, f"http://two.example/{k}", f"<div>{body}</div>") for k in range(2)]
    found = {r["page_id"]: r["text"] for r in rows(html_suffix.main_text(spark.createDataFrame(made, "page_id long, url string, html string")))}
    assert [found[k] for k in (100, 101, 102, 200, 201)] == [body, body, dated, body, body]
    assert not any("Sport" in t for t in found.values())


def test_unique_runs_stay_and_long_repeats_go_inside_a_block(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    legal, note = " ".join(f"legal{k}" for k in range(35)), "All rights reserved by the owners of this site"
    before, after = ([f"{x}{k} {prose(rng, 40)} {x}{k}" for k in range(6)] for x in "ab")
    made = [(k, "http://h.example/", f"<div>{before[k]} {legal} {after[k]}</div><div>{note} c{k} x{k} y</div>") for k in range(6)]
    found = {r["page_id"]: r["text"] for r in rows(html_suffix.main_text(spark.createDataFrame(made, "page_id long, url string, html string")))}
    for k in range(6):
        assert found[k] == f"{before[k]} {after[k]} c{k} x{k} y"


def test_prose_of_a_hot_host_stays_whole(spark):
    rng = np.random.Generator(np.random.PCG64(7))
    menu = "Home News Sport Weather Contact us today"
    texts = [prose(rng, 60) for _ in range(3000)]
    made = [(k, "http://hot.example/", f"<div>{menu}</div><p>{t}</p>") for k, t in enumerate(texts)]
    small_one = spark.createDataFrame(made[:50], "page_id long, url string, html string")
    large_one = spark.createDataFrame(made, "page_id long, url string, html string").repartition(6)
    for df in (small_one, large_one):
        wrong = [(texts[r["page_id"]], r["text"]) for r in rows(html_suffix.main_text(df)) if r["text"] != texts[r["page_id"]]]
        assert not wrong


def test_repeats_decide_on_pages_with_an_article(spark):
    rng = np.random.Generator(np.random.PCG64(8))
    menu, letter = "Home News Sport Weather Contact us today", "Get our best stories in your mail every week"
    lead, tale, body = ([f"{x}{k} {prose(rng, 50)} {x}{k}" for k in range(12)] for x in "abc")
    made = [(k, "http://h.example/", f"<div>{menu}</div><div>{lead[k]}</div><article><p>{tale[k]}</p><p>{letter}</p></article>") for k in range(12)]
    made += [(50, "http://t.example/", f"<div>{body[0]}</div><article>Teaser</article>")]
    # near copies: what most of them share is their text
    made += [(100 + k, "http://n.example/", f"<article><p>{body[1]}</p><p>copy {k}</p></article>") for k in range(12)]
    found = {r["page_id"]: r["text"] for r in rows(html_suffix.main_text(spark.createDataFrame(made, "page_id long, url string, html string")))}
    for k in range(12):
        assert found[k] == f"{lead[k]} {tale[k]}"
        assert found[100 + k] == f"{body[1]} copy {k}"
    assert found[50] == f"{body[0]} Teaser"


def test_main_text_of_odd_pages(odd_pages):
    found = rows(html_suffix.main_text(odd_pages))
    assert Counter(r["text"] for r in found)["Hallo & Welt"] == 2
    assert sorted(r["text"] for r in found if r["page_id"] is None) == ["", "text more"]
    assert len(found) == 7
    assert rows(html_suffix.main_text(odd_pages.limit(0))) == []


# 4 archives


def records_by_force(made: list) -> list:
    best: dict = {}
    for page, text in made:
        if page is not None:
            best[text] = max(page, best.get(text, page))
    out = []
    for page, text in made:
        raw = (text or "").encode()
        answer = best.get(text or "")
        revisit = answer is not None and answer != page
        out.append((page, len(raw), warc.base32(hashlib.sha1(raw).digest()), "revisit" if revisit else "response", answer if revisit else None))
    return sorted(out, key=repr)


def test_archive_round_trip(spark, sf, pages):
    made = [(r["page_id"], r["html"] or "") for r in rows(pages)]
    found = sorted((tuple(r) for r in rows(queries.op4_chunked_records(spark, sf))), key=repr)
    assert found == records_by_force(made)


@pytest.mark.parametrize("chunk", [16, 1000, 1 << 16])
def test_chunks_of_odd_pages(spark, odd_pages, chunk):
    more = spark.createDataFrame([(k, "u", "same" * 9 if k % 2 else ("WARC/1.1\r\n\r\nWARC/1.1\r\n" * 5 if k else "ends with WARC/1.1")) for k in range(8)], "page_id long, url string, html string")
    df = odd_pages.select("page_id", "url", F.substring("html", 1, 20_000 if chunk > 16 else 900).alias("html")).union(more)
    found = sorted((tuple(r) for r in rows(warc.round_trip(df, chunk=chunk))), key=repr)
    assert found == records_by_force([(r["page_id"], r["html"] or "") for r in rows(df)])


def test_chunk_table_carries_digests(spark):
    path = scratch_path(spark, "warc-test")
    text = "äb" * 40_000
    warc.write_archive(spark.createDataFrame([(1, "u", text), (2, "u", "short")], "page_id long, url string, html string"), path)
    chunks = sorted(rows(warc.chunk_rows(spark, path)), key=lambda r: r["chunk_no"])
    assert len(chunks) == 2 and all(len(c["chunk"]) <= warc.CHUNK for c in chunks)
    assert b"".join(c["chunk"] for c in chunks) == text.encode()
    running = hashlib.sha1()
    for c in chunks:
        running.update(c["chunk"])
        assert c["so_far"] == warc.base32(running.digest())
    raw = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    assert raw.count("WARC/1.1\r\n") == 3 and raw.endswith("\r\n\r\n")


def test_archive_of_nothing(odd_pages):
    assert rows(warc.round_trip(odd_pages.limit(0))) == []


# pipeline


def test_stages_in_order_and_columns(spark, sf, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_passages", "source_mix", "shards"]
    docs = documents
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(rows(docs.select("doc_id", "text", "source")))
        path = scratch_path(spark, name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "shards":
            assert docs.columns == documents.columns
    quality, near, bench, mix, shards = inputs
    ids = [{r["doc_id"] for r in x} for x in inputs]
    assert 0 < len(ids[1]) < len(ids[0])
    parts = components_by_force({r["doc_id"]: r["text"] for r in near}, 5, 80)
    assert ids[2] == {i for i, (_, c) in parts.items() if i == c}
    items = [(r["item_id"], r["text"]) for r in rows(spark.read.parquet(f"{sf}/benchmark.parquet"))]
    assert ids[3] == {r[0] for r in contamination_by_force([(r["doc_id"], r["text"]) for r in bench], items) if not r[5]}
    times = Counter(r["doc_id"] for r in shards)
    assert set(times.values()) <= {1, 2} and set(times) <= ids[3]
    out = rows(docs)
    assert Counter(r["doc_id"] for r in out) == times
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_stages_on_odd_rows(spark, sf, odd):
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd, sf)
        if name != "shards":
            assert found.columns == odd.columns
        assert found.count() <= 22
        assert stage(spark, odd.limit(0), sf).count() == 0
    left = rows(corpus_pipeline.near_duplicates(spark, odd, sf))
    assert Counter(r["doc_id"] for r in left) == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, None: 2}


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert "pipeline" in names


def records_of(path: str) -> list[tuple[dict[str, str], bytes]]:
    """Records of all files of an archive by the format alone: version line, headers, block of the stated length."""
    out = []
    for name in sorted(os.listdir(path.removeprefix("file:"))):
        if not name.startswith("part-"):
            continue
        with open(f"{path.removeprefix('file:')}/{name}", "rb") as file:
            data = file.read()
        at = 0
        while at < len(data):
            head, end = data[at : data.index(b"\r\n\r\n", at)].decode().split("\r\n"), data.index(b"\r\n\r\n", at) + 4
            assert head[0] == "WARC/1.1"
            headers = dict(line.split(": ", 1) for line in head[1:])
            stop = end + int(headers["Content-Length"])
            assert data[stop : stop + 4] == b"\r\n\r\n"
            out.append((headers, data[end:stop]))
            at = stop + 4
    return out


def test_any_reader_can_follow_the_references(spark):
    long = "<p>" + "wort " * 50_000
    pages = [(1, "u1", "a"), (2, "u2", "a"), (3, "u3", long), (4, "u4", long), (4, "u4b", long), (5, None, None), (6, "u6", ""), (None, "n", "a"), (7, "u7", "only")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    written = []
    for parts in (1, 3):
        path = scratch_path(spark, "warc-follow")
        warc.write_archive(df.repartition(parts), path)
        written.append(records_of(path))
    assert sorted(map(str, written[0])) == sorted(map(str, written[1])), "reruns write the same records"
    responses = [h["WARC-Record-ID"] for h, _ in written[0] if h["WARC-Type"] == "response"]
    segments = {}
    for headers, block in written[0]:
        if headers["WARC-Type"] != "revisit":
            segments[headers.get("WARC-Segment-Origin-ID", headers["WARC-Record-ID"]), int(headers.get("WARC-Segment-Number", 1))] = block
    revisits = [h for h, _ in written[0] if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 4 and len(responses) == 5
    for h in revisits:
        assert h["WARC-Refers-To"] in responses
        held = b"".join(block for (name, _), block in sorted(segments.items()) if name == h["WARC-Refers-To"])
        assert "sha1:" + warc.base32(hashlib.sha1(held).digest()) == h["WARC-Payload-Digest"]
    found = sorted((tuple(r) for r in rows(warc.read_archive(spark, path))), key=repr)
    assert [r[0] for r in found if r[3] == "response"].count(4) == 2 and len(found) == len(pages)
    assert all(r[4] is not None for r in found if r[3] == "revisit")
