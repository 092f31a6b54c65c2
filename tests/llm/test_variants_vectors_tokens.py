"""Spelling variants, whitening and token encoding against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_fixtures import documents, odd, sf  # noqa: F401
from txnrisk.llm import queries, speculative_bpe, trie_pairs, whitening

UP = str.maketrans(trie_pairs.UPPER, trie_pairs.LOWER)


# spelling variants


def brute_words(rows) -> dict[str, int]:
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def edits(word: str, letters: str) -> set[str]:
    cut = {word[:i] + word[i + 1 :] for i in range(len(word))}
    longer = {word[:i] + a + word[i:] for i in range(len(word) + 1) for a in letters}
    return (cut | longer | {word[:i] + a + word[i + 1 :] for i in range(len(word)) for a in letters}) - {word}


def brute_variants(counts: dict[str, int]) -> dict[str, tuple]:
    letters = "".join({a for w in counts for a in w})
    near = {w: [v for v in edits(w, letters) if v in counts] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def as_dict(df) -> dict[str, tuple]:
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_variants_of_all_documents(spark, sf, documents):
    counts = brute_words([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert as_dict(queries.op11_trie_pairs(spark, sf)) == brute_variants(counts)


def test_variants_of_repetitive_words(spark):
    rng = random.Random(3)
    made = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))): rng.choice([2, 3, 30, 300, 4000]) for _ in range(300)}
    made |= {"ü" * 9: 2, "ü" * 8: 25, "ü" * 10: 3000, "x": 2}
    counts = spark.createDataFrame(list(made.items()), "word string, n long").repartition(7)
    assert as_dict(trie_pairs.variants(counts)) == brute_variants(made)


def test_node_numbers_over_many_tasks(spark):
    rng = random.Random(4)
    texts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(900)} | {"a" * 500, "a" * 499 + "b"}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
        found = {r["t"]: r["nodes"] for r in trie_pairs.with_nodes(frame, "t", "nodes").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    numbers = {}
    for t, nodes in found.items():
        assert len(nodes) == len(t) + 1
        for k, node in enumerate(nodes):
            assert numbers.setdefault(t[:k], node) == node
    assert len(set(numbers.values())) == len(numbers) and set(found) == texts
    assert [t for t, _ in sorted(found.items(), key=lambda x: x[1][-1])] == sorted(texts)


def test_variants_of_odd_rows(spark, odd):
    odd = odd.withColumn("text", F.replace("text", F.lit("wort"), F.lit("wörtlich ")))
    counts = brute_words([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert counts and as_dict(trie_pairs.spelling_variants(odd)) == brute_variants(counts)
    assert trie_pairs.spelling_variants(odd.limit(0)).count() == 0
    assert trie_pairs.spelling_variants(odd.where("text IS NULL")).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_long_words_and_chains(spark):
    long = "ab" * 20_000
    made = {long: 2, long[:-1]: 40, long[:100] + "z" + long[101:]: 2, "wordlike": 5, "wordlikes": 50, "wordliked": 600, "wordlik": 7000, "wordlikx": 80_000}
    found = as_dict(trie_pairs.variants(spark.createDataFrame(list(made.items()), "word string, n long")))
    assert found[long] == (long[:-1], long[:-1], 2, 2, 40)
    assert found["wordlikes"][:2] == ("wordliked", "wordliked") and found["wordlike"][:2] == ("wordlikx", "wordlikx")
    assert found["wordlik"][0] == "wordlikx"
    chain = {"a" * (20 - k): 2 * 12**k for k in range(8)}
    assert {root for _, root, *_ in as_dict(trie_pairs.variants(spark.createDataFrame(list(chain.items()), "word string, n long"))).values()} == {"a" * 13}


# whitening


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    for n, d in ((200, 12), (12, 30), (3, 3), (50, 1)):
        a = rng.normal(size=(n, d)) * rng.uniform(0.5, 9, d)
        v = a.T @ a
        factor, order = whitening.pivoted_cholesky(v)
        assert factor.shape[1] == min(n, d)
        np.testing.assert_allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-10 * np.abs(v).max())
        values, vectors = whitening.eigen(v)
        np.testing.assert_allclose(values, np.linalg.eigvalsh(v)[::-1][: len(values)], rtol=1e-9)
        np.testing.assert_allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
        np.testing.assert_allclose(v @ vectors.T, vectors.T * values, atol=1e-11 * values[0])
    assert len(whitening.eigen(np.zeros((4, 4)))[0]) == 0
    assert len(whitening.eigen(np.ones((4, 4)))[0]) == 1


def reference(vectors: np.ndarray):
    x = np.floor(1024 * vectors).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    top = n * x - sums
    values, axes = np.linalg.eigh((top / n).T @ (top / n) / n)
    axes = axes[:, ::-1] * 1.0
    return x, top, values[::-1], (top / n) @ axes


def test_whitening_of_all_embeddings(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    _, top, values, scores = reference(np.array([r["embedding"] for r in table], np.float64))
    place = {r["vec_id"]: k for k, r in enumerate(table)}
    rows = queries.op12_cholesky_jacobi(spark, sf).collect()
    assert len(rows) == 8 * len(table) and {r["component"] for r in rows} == set(range(1, 9))
    got = np.zeros((len(table), 8))
    for r in rows:
        k = place[r["vec_id"]]
        assert r["n"] == len(table) and r["deviation"] == int((top[k].astype(object) ** 2).sum()) == int(r["deviation_exact"])
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-10
        got[k, r["component"] - 1] = r["whitened"]
    np.testing.assert_allclose(np.abs(got), np.abs(scores[:, :8] / np.sqrt(values[:8])), atol=1e-8)
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-10


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    good = [(k, [float(a) for a in rng.normal(size=3)]) for k in range(20)] + [(7, [0.5, 0.25, -1.0])] * 3 + [(None, [1.0, 2.0, 3.0])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 2.0]), (104, [inf, 1.0, 2.0]), (105, [1.0, 2.0])]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "'a' AS id", "2 AS v", "3 AS n", "0 AS whitened")
    rows = whitening.whitened(frame).collect()
    assert Counter(r["vec_id"] for r in rows) == Counter([k for k, _ in good for _ in range(3)])
    _, top, values, scores = reference(np.array([v for _, v in good]))
    want = sorted(zip((top.astype(object) ** 2).sum(1).tolist(), np.abs(scores[:, 0] / np.sqrt(values[0])).tolist()))
    got = sorted((r["deviation"], abs(r["whitened"])) for r in rows if r["component"] == 1)
    assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([w for _, w in got], [w for _, w in want], atol=1e-9)
    assert rows[0]["identity_error"] < 1e-9
    assert whitening.whitened(frame.limit(0)).count() == 0
    assert whitening.whitened(frame.where("vec_id IN (100, 101)")).columns == [f.name for f in whitening.whitened(frame).schema]
    equal = whitening.whitened(frame.where("embedding = array(0.5D, 0.25D, -1D)")).collect()
    assert len(equal) == 9 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] is None for r in equal)


def test_whitening_of_huge_entries(spark):
    frame = spark.createDataFrame([(k, [s * 3.0e38, 1.0, float(k)]) for k, s in enumerate((1, -1, 1, 0))], "vec_id long, embedding array<float>")
    rows = whitening.whitened(frame).collect()
    assert {r["deviation"] for r in rows} == {None} and all(int(r["deviation_exact"]) > 2**63 for r in rows)
    assert all(np.isfinite(r["whitened"]) for r in rows if r["component"] == 1)


def test_sums_beyond_longs_are_exact():
    x = [[2**62 + 1, -(2**62)], [2**62 + 3, 5], [2**62, 7]]
    batch = pa.record_batch({"x": pa.array(x)})
    parts = list(whitening._sums(iter([batch]), 2))
    merged = list(whitening._merged_sums(iter(parts + parts), 2))[0].to_pylist()[0]
    assert [int(s) for s in merged["sums"]] == [2 * sum(c) for c in zip(*x)] and merged["rows"] == 6


# encoding


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(speculative_bpe.VOCABULARY)


@pytest.fixture(scope="module")
def machine():
    return speculative_bpe.encoder(speculative_bpe.read_tokenizer(speculative_bpe.VOCABULARY))


def agrees(machine, library, texts: list[str | None]) -> None:
    n, ids, decoded = machine.texts(pa.array(texts, pa.string()))
    for k, want in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[k].as_py() == " ".join(map(str, want.ids)) and n[k] == len(want.ids), texts[k]
        assert decoded[k].as_py() == library.decode(want.ids, skip_special_tokens=False)


def test_encoding_of_made_up_texts(machine, library):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCéüßñİΣẞ0123456789'!?.-_<|>/ \n\t\r\x0b\x1c\x85\xa0 ́漢字ﬁ\U0001f600\x00"
    vocab = [t.removesuffix("</w>") for t in json.loads(speculative_bpe.read_tokenizer(speculative_bpe.VOCABULARY))["model"]["vocab"]]
    texts = [None, "", " \n ", "<|startoftext|>Hi<|endoftext|> x<|startoftext|><|startoftext", "it's I'LL we'Ve </w> a</w>b é é", "a" * 3000, "hahaha" * 300]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 50))) for _ in range(1000)]
    texts += ["".join(rng.choice("esntirha") for _ in range(rng.randint(0, 90))) for _ in range(3000)]
    texts += ["".join(rng.choice(vocab) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    agrees(machine, library, texts)


def test_speculation_passes_and_fails(machine):
    merges = machine.merges
    words = ["hello", "international", "the", "xqzzyw", "loooooong", "a" * 90]
    found, failed = merges.encode(words)
    assert found == [merges.exact(w) for w in words] == merges.exact_all(words)
    rng = random.Random(6)
    made = list({"".join(rng.choice("esntirha") for _ in range(rng.randint(1, 12))) for _ in range(4000)})
    found, failed = merges.encode(made)
    # the check neither lets a wrong proposal pass nor sends all words to the exact way
    assert found == [merges.exact(w) for w in made] and 0 < failed < len(made)


def test_pairs_stay_apart_as_the_merges_say(machine):
    merges, rng = machine.merges, random.Random(7)
    inner = [i for i, t in merges.text.items() if not t.endswith("</w>") and t.isascii()]
    last = [i for i, t in merges.text.items() if t.endswith("</w>") and t.isascii()]
    pairs = [(rng.choice(inner), rng.choice(last)) for _ in range(4000)]
    apart = merges.compatible(*(np.array(x) for x in zip(*pairs, strict=True)))
    for (a, b), ok in zip(pairs, apart.tolist(), strict=True):
        word = merges.text[a] + merges.text[b].removesuffix("</w>")
        assert ok == (merges.exact(word) == [a, b])
    assert 0 < apart.sum() < len(pairs)


def test_encoding_of_documents_and_odd_rows(spark, sf, documents, odd, library):
    for found, table in ((queries.op13_speculative_bpe(spark, sf), documents), (speculative_bpe.digests(odd), odd)):
        want = Counter()
        for r in table.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            sums = (hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))
            want[(r["doc_id"], len(ids), *sums)] += 1
        assert Counter(tuple(r) for r in found.collect()) == want
    assert speculative_bpe.digests(odd.limit(0)).count() == 0
    plain = speculative_bpe.encoded(odd.where("doc_id = 2")).first()
    assert plain["ids"].split(" ") == [str(i) for i in library.encode("one two three four five six seven eight", add_special_tokens=False).ids]
    renamed = speculative_bpe.digests(odd.select(F.col("doc_id").cast("string").alias("my id"), "text"), id_col="my id")
    assert renamed.columns == ["my id", "n_tokens", "ids_sha256", "decoded_sha256"] and renamed.count() == odd.count()


def test_forgetting_keeps_results(machine, library):
    small = speculative_bpe.Encoder(speculative_bpe.read_tokenizer(speculative_bpe.VOCABULARY))
    small.words, small.runs = speculative_bpe.Recent(8), speculative_bpe.Recent(8)
    agrees(small, library, [f"word{k % 37} and another{k}" for k in range(200)])
    assert len(small.runs.new) + len(small.runs.old) <= 8
