"""Operators on documents against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_fixtures import documents, odd, sf  # noqa: F401
from txnrisk.llm import chosen_path, decontam, entropy_mix, fertility, longest_match, nbsvm, pii_chain, queries, ring
from txnrisk.llm.words import LETTERS, SPACED, Words, pieces

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def spaced(text: str | None) -> list[str]:
    return SPACE_WORD.findall(text or "")


def rows(df) -> list:
    return df.collect()


# words


@pytest.mark.parametrize(("rule", "pattern"), [(SPACED, SPACE_WORD), (LETTERS, LETTER_WORD)])
def test_words_agree_with_patterns(rule, pattern):
    texts = ["", "Ab cD", None, "x", " é\x0bü ", "a1-b2_c3", "the the", "Ab"]
    words = Words(pa.array(texts), rule)
    data = words.data.tobytes()
    for i, text in enumerate(texts):
        own = [data[words.start[k] : words.end[k]].decode() for k in range(words.first[i], words.first[i + 1])]
        assert own == pattern.findall(lower(text or ""))
    by_word = defaultdict(set)
    for a, b, h in zip(words.start, words.end, words.hash, strict=True):
        by_word[data[a:b]].add(int(h))
    assert all(len(h) == 1 for h in by_word.values())
    assert len({h for s in by_word.values() for h in s}) == len(by_word)


def test_pieces_keep_every_row():
    batch = pa.record_batch({"t": ["a" * k for k in range(40)]})
    parts = list(pieces(batch, batch.column(0), most=50))
    assert len(parts) > 5
    assert [t for _, p in parts for t in p.to_pylist()] == batch.column(0).to_pylist()


# 7 near-duplicates


def components_by_force(texts: dict, width: int, percent: int) -> dict:
    sets = {}
    for i, text in texts.items():
        words = spaced(lower(text or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_token = defaultdict(list)
    for i, s in sets.items():
        for t in s:
            by_token[t].append(i)
    shared = Counter()
    for own in by_token.values():
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                shared[own[a], own[b]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_near_duplicates_equal_brute_force(spark, sf, documents):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(queries.op7_chosen_path(spark, sf))}
    assert found == components_by_force({r["doc_id"]: r["text"] for r in rows(documents)}, 4, 80)


@pytest.fixture(scope="module")
def copies(spark):
    """Large groups of near copies of few texts, of which many are linked over others only."""
    rng = np.random.Generator(np.random.PCG64(5))
    texts, i = [], 0
    for base in range(3):
        words = [f"w{base}x{k}" for k in range(120)]
        for _ in range(60):
            own = list(words)
            for place in rng.choice(120, int(rng.integers(0, 4)), replace=False):
                own[place] = f"e{i}y{place}"
            texts.append((i, " ".join(own)))
            i += 1
    return texts


def test_large_nodes_of_near_copies(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(chosen_path.near_components(df))}
    assert found == components_by_force(dict(copies), 4, 80)


def test_near_duplicates_of_odd_rows(odd):
    found = rows(chosen_path.near_components(odd))
    assert len(found) == 11
    by_id = defaultdict(list)
    for r in found:
        by_id[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by_id[1] == [(5, 1, True)] * 2
    assert by_id[2] == [(5, 1, False)]
    assert by_id[3] == [(0, 3, True)] and by_id[4] == [(0, 4, True)] and by_id[6] == [(0, 6, True)]
    assert sorted(by_id[None]) == [(0, None, True), (1, None, True)]
    assert by_id[5][0][1:] == (5, True)


def test_near_duplicates_of_nothing(odd):
    assert rows(chosen_path.near_components(odd.limit(0))) == []


# 5 benchmark passages


def contamination_by_force(texts: list, items: list, window: int = 13) -> list:
    windows = defaultdict(set)
    for item, text in items:
        words = LETTER_WORD.findall(lower(text or ""))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            windows[tuple(words[k : k + window])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in texts:
        words = LETTER_WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                own = tuple(words[k : k + n])
                if own in windows:
                    hit.update(range(k, k + n))
                    found |= windows[own]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


def hits(df, key="doc_id"):
    return sorted(((r["row"][key], *list(r)[1:]) for r in rows(df)), key=repr)


def test_contamination_equals_brute_force(spark, sf, documents):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = contamination_by_force([(r["doc_id"], r["text"]) for r in rows(documents)], [(r["item_id"], r["text"]) for r in rows(bench)])
    found = sorted((tuple(r) for r in rows(queries.op5_prefix_filter(spark, sf))), key=repr)
    assert found == want
    assert any(r[5] for r in want)


@pytest.mark.parametrize("block", [200_000, 3])
def test_contamination_by_short_items_in_blocks(spark, odd, block):
    long = " ".join(f"wort{k % 5000}" for k in range(100, 140))
    items = [(10, "seven eight"), (9, "Seven-Eight!"), (2, "only"), (3, None), (4, "??"), (5, long), (None, "one"), (6, long), (7, "one two three four five six seven")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    found = hits(decontam.contamination(odd, bench, block=block))
    assert found == contamination_by_force([(r["doc_id"], r["text"]) for r in rows(odd)], [x for x in items if x[0] is not None])


def test_contamination_of_and_by_nothing(spark, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r[2:] for r in hits(decontam.contamination(odd, bench))} == {(0, 0, hashlib.sha256(b"").hexdigest(), False)}
    assert rows(decontam.contamination(odd.limit(0), bench)) == []


# 8 quality rules


def base_by_force(text: str | None) -> tuple:
    text = text or ""
    words = spaced(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if spaced(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    marked = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_base_rules_equal_brute_force(spark, sf, documents, odd):
    texts = {r["doc_id"]: r["text"] for r in rows(documents)}
    for r in rows(queries.op8_fertility(spark, sf)):
        want = base_by_force(texts[r["doc_id"]])
        assert tuple(r)[1:6] == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    lines = spark.createDataFrame([(1, "a\n\na\n b\nb\n b\n"), (2, "\n\n"), (3, "x\nx"), (4, "x y z x y z x")], "doc_id long, text string")
    for r in rows(fertility.measures(lines)):
        assert tuple(r)[1:6] == base_by_force(r["row"]["text"])
    for r in rows(fertility.judged(odd)):
        assert tuple(r["n_words n_symbols n_dup_lines n_repeat_words".split()[0]] for _ in [0]) == (base_by_force(r["row"]["text"])[0],)


def test_repeated_lines_beside_lines_without_words():
    texts = ["A b\r\n\r\nA b\r\nC", "A b\n \nA b\nC", "x y\n\t \nz\nx y", "\n \nx y", " \t\nx y\nx y", "\r\nq\r\n\r\nq\r\n", "", " \n", "é\n\x0b\né"]
    for own in (texts, texts[::-1], *([t, u] for t in texts for u in texts)):
        found = fertility._repeated_lines(Words(pa.array(own), SPACED, lower=False))
        assert found.tolist() == [base_by_force(t)[3] for t in own]


def test_fertility_figures_equal_brute_force(spark, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=fertility.VOCABULARY)
    for r in rows(fertility.measures(documents.limit(30))):
        ids = [i for w in spaced(r["row"]["text"]) for i in model.encode(w)]
        counts = Counter(ids)
        assert r["chars_per_token"] == pytest.approx(sum(map(len, spaced(r["row"]["text"]))) / len(ids))
        assert r["byte_share"] == pytest.approx(sum(map(model.is_byte, ids)) / len(ids))
        assert r["entropy"] == pytest.approx(-sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values()))


def test_bands_reject_gibberish_and_keep_prose(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    vocabulary = "the of and to in that is was for on with as by from this are be at or it house water people little".split()
    prose = [(k, " ".join(f"{vocabulary[i]}{vocabulary[j]}" if i % 3 == 0 else vocabulary[i] for i, j in rng.integers(0, len(vocabulary), (200, 2)))) for k in range(300)]
    noise = [(1000 + k, " ".join("".join(map(chr, rng.integers(0x2600, 0x2700, 6))) for _ in range(200))) for k in range(3)]
    df = spark.createDataFrame(prose + noise, "doc_id long, text string").withColumn("lang", F.lit("en"))
    # the noise is in the main script "other"; as one language with prose it is judged by that band
    found = {r["row"]["doc_id"]: r["kept"] for r in rows(fertility.judged(df))}
    assert sum(found[k] for k, _ in prose) >= 297
    mixed = spark.createDataFrame([*prose, *((i, f"{'the ' * 3}{t}") for i, t in [(2000, " ".join("zqxjkvb" + chr(0x1F600 + k % 60) * 3 for k in range(200)))])], "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert not {r["row"]["doc_id"]: r["kept"] for r in rows(fertility.judged(mixed))}[2000]


def test_small_groups_are_judged_and_copies_count_once(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    vocabulary = "the of and to in that is was for on with as by from this are be at or it house water people little".split()
    prose = [(k, " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), 200)), "en") for k in range(300)]
    noise = [" ".join("".join(map(chr, rng.integers(0x2600, 0x2700, 6))) for _ in range(200)) for _ in range(4)]
    few = [(1000 + k, t, lang) for k, (t, lang) in enumerate(zip(noise, ["en", "en", "en", "xx"], strict=True))]
    mixed = " ".join("zqxjkvb" + chr(0x1F600 + k % 60) * 3 for k in range(200))
    copies = [(2000 + k, mixed, "en") for k in range(400)]
    found = {r["row"]["doc_id"]: r["kept"] for r in rows(fertility.judged(spark.createDataFrame(prose + few + copies, "doc_id long, text string, lang string")))}
    assert not any(found[i] for i, _, _ in few + copies)
    assert sum(found[i] for i, _, _ in prose) >= 297


def test_quality_of_nothing(odd):
    assert rows(fertility.judged(odd.limit(0))) == []


# 9 token counts


def greedy(word: bytes, tokens: set) -> int:
    word, at, n = b" " + word, 0, 0
    while at < len(word):
        size = next((k for k in range(min(len(word) - at, 130), 0, -1) if word[at : at + k] in tokens), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def test_token_counts_equal_greedy_matching(spark, sf, documents):
    tokens = set(longest_match.read_vocabulary(longest_match.VOCABULARY))
    texts = {r["doc_id"]: r["text"] for r in rows(documents)}
    known: dict[str, int] = {}
    for r in rows(queries.op9_longest_match(spark, sf)):
        words = spaced(texts[r["doc_id"]])
        for w in set(words) - set(known):
            known[w] = greedy(w.encode(), tokens)
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))


def test_automaton_with_words_that_cannot_be_spelt():
    tokens = [b" a", b" ab", b"abc", b"b", b"cd", b"a", b" abcdx", b"dy"]
    machine = longest_match.Automaton(tokens)
    words = [b"abcd", b"abcdx", b"abcdy", b"ab", b"q", b"abq", b"a" * 500, b"abcabc", b""]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    got = machine.counts(data, end - [len(w) for w in words], end)
    assert got.tolist() == [greedy(w, set(tokens)) if w else 1 for w in words]


def test_token_counts_of_odd_rows(odd):
    found = rows(longest_match.token_counts(odd))
    assert len(found) == 11
    assert {r["n_tokens"] for r in found if r["doc_id"] in (3, 4, 6)} == {0}


# 2 shards


def test_shards_are_even_and_gapless(spark, sf, documents):
    found = rows(queries.op2_bounded_ring(spark, sf))
    texts = {r["doc_id"]: r["text"] or "" for r in rows(documents)}
    slots = defaultdict(list)
    for r in found:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_ring_placement_equals_key_by_key():
    nodes = ring.vnodes(5, 8)
    counts = [(s, a, (s * 7919 + a) % 5) for s in range(64) for a in range(len(nodes) + 1) if s * len(nodes) // 64 <= a <= s * len(nodes) // 64 + 1]
    capacity = ring.even(sum(n for *_, n in counts), 5)
    room = list(capacity)
    want = []
    for cell, arc, n in counts:
        for _ in range(n):
            i = arc
            while not room[nodes[i % len(nodes)][1]]:
                i += 1
            room[nodes[i % len(nodes)][1]] -= 1
            want.append((cell, arc, nodes[i % len(nodes)][1]))
    got = [(cell, arc, shard) for cell, arc, a, b, shard, _ in ring.place(counts, capacity, 8) for _ in range(b - a)]
    assert got == want


def test_keys_follow_the_arc_of_their_whole_hash(spark):
    """With room for all, each key is on the first node at or after its hash, wherever the nodes crowd."""
    found = rows(ring.ring_shards(spark.range(4_000).withColumnRenamed("id", "doc_id"), [F.col("doc_id")], 16, slack=20.0))
    hashes = {r["id"]: r["h"] % 2**64 for r in spark.range(4_000).select("id", F.xxhash64("id").alias("h")).collect()}
    nodes = ring.vnodes(16)
    assert {r["doc_id"]: r["shard"] for r in found} == {k: next((s for p, s in nodes if p >= h), nodes[0][1]) for k, h in hashes.items()}


@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_more_ranges_change_no_shard(spark, monkeypatch, slack):
    df = spark.range(9_000).withColumnRenamed("id", "doc_id")
    few = {r["doc_id"]: (r["shard"], r["slot"]) for r in rows(ring.ring_shards(df, [F.col("doc_id")], slack=slack))}
    monkeypatch.setattr(ring, "PER_SLOT", 1)
    assert few == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows(ring.ring_shards(df, [F.col("doc_id")], slack=slack))}


def test_even_shards_move_few_keys_too(spark):
    """The registered law: counts at most one apart, and one more shard moves little beyond its share."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"))
    before, after = ({r["doc_id"]: r["shard"] for r in rows(ring.ring_shards(df, [F.col("doc_id")], n))} for n in (16, 17))
    assert sum(before[k] != after[k] for k in before) < 2 / 17 * 20_000


def test_another_shard_moves_few_keys(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"))
    before = {r["doc_id"]: r["shard"] for r in rows(ring.ring_shards(df, [F.col("doc_id")], 16, slack=0.25))}
    after = {r["doc_id"]: r["shard"] for r in rows(ring.ring_shards(df, [F.col("doc_id")], 17, slack=0.25))}
    assert max(Counter(before.values()).values()) <= 20_000 / 16 * 1.25 + 1
    assert sum(before[k] != after[k] for k in before) < 0.2 * 20_000


def test_repeated_rows_spread_over_shards(spark, odd):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    found = ring.sharded(df).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert all(r["n"] == r["slots"] == r["last"] + 1 == 1875 for r in found)
    assert len(rows(ring.sharded(odd))) == 11
    assert rows(ring.sharded(odd.limit(0))) == []


def test_documents_without_an_id_spread_over_the_ring(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ring, "place", lambda counts, *more, to=ring.place: seen.append(counts) or to(counts, *more))
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    assert len(rows(ring.sharded(df))) == 20_000
    assert max(n for *_, n in seen[0]) < 30


def test_more_slots_for_more_keys(spark, monkeypatch):
    monkeypatch.setattr(ring, "PER_SLOT", 1)
    found = rows(ring.ring_shards(spark.range(9_000).withColumnRenamed("id", "doc_id"), [F.col("doc_id")]))
    assert sorted({r["doc_id"] for r in found}) == list(range(9_000))
    assert {sum(r["shard"] == s for r in found) for s in range(16)} == {562, 563}


# 10 mixing


def targets_by_force(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2.0 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        goal = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in full and goal[s] > 2.0 * sizes[s]}
        if not over:
            return goal
        full |= over


def test_mix_meets_targets(spark, sf, documents):
    found = rows(queries.op10_entropy_balance(spark, sf))
    source = {r["doc_id"]: r["source"] for r in rows(documents)}
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in found:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    goal = targets_by_force(sizes)
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(goal[s])
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in sizes)
    assert sum(taken.values()) == pytest.approx(sum(goal.values()), rel=0.1)
    again = rows(queries.op10_entropy_balance(spark, sf))
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_tilts_solve_the_dual(spark):
    counts = [(s, k, 1 + (k * 7 + j) % 4) for j, s in enumerate(["a", "b", None]) for k in range(1, 60)]
    size = Counter()
    for s, k, n in counts:
        size[s] += k * n
    goal = {"a": 0.3 * size["a"], "b": 1.7 * size["b"], None: 2.0 * size[None]}
    goals = spark.createDataFrame([(s, size[s], g) for s, g in goal.items()], "source string, source_size long, target double")
    solved = {r["source"]: r for r in rows(entropy_mix.tilts(spark.createDataFrame(counts, "source string, size long, docs long"), goals))}
    assert solved[None]["all_of"] == 2.0
    for s in "ab":
        got = sum(n * k * min(2.0, math.exp(solved[s]["tilt"] * k / solved[s]["scale"])) for t, k, n in counts if t == s)
        assert got == pytest.approx(goal[s], rel=1e-6)


def test_mix_of_odd_rows(odd):
    found = rows(entropy_mix.mixed(odd))
    assert len(found) == 11
    assert all(r["copies"] == 1 for r in found if r["size"] == 0)
    assert rows(entropy_mix.mixed(odd.limit(0))) == []


# 6 personal data


_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def spans_by_force(text: str) -> list:
    out = [(0, *m.span()) for m in _EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def joined(spans: list) -> str:
    return ",".join(f"{pii_chain.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_base_spans_equal_patterns(spark, sf, documents):
    texts = {r["doc_id"]: r["text"] for r in rows(documents)}
    some = 0
    for r in rows(queries.op6_skip_chain(spark, sf)):
        want = spans_by_force(texts[r["doc_id"]])
        some += len(want)
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii_chain.KINDS] == [sum(s[0] == k for s in want) for k in range(4)]
        assert set(filter(None, joined(want).split(","))) <= set(r["spans"].split(","))
    assert some


@pytest.mark.parametrize(
    "text",
    ["a@b.c@d.e", "@b.c", "x@@y.z", "a..b@c-d.e.f.", "a@b", "a+b%c_d@x.y,z@w.v", "1.2.3.4.5.6.7.8", "256.1.1.1 0.0.0.0000255", "4111-1111 1111 1111+1", "é+12 (34) 5678-90 +1", "+1+1+123456789", "1" * 30, "a@b.c.@d.e"],
)
def test_base_spans_of_hard_texts(text):
    assert pii_chain.base_spans(text) == spans_by_force(text)


def test_similar_tokens_get_the_label_of_the_distant_one(spark):
    filler = "und so weiter bis zum Ende "
    texts = [(k, f"call +1 (502) 555-{6000 + k} now {filler * 3} or write ann.lee{k}@mail.example.com {filler}") for k in range(60)]
    texts.append((100, f"call +1 (502) 555-6996 {filler * 5} again: 555-6996, item 555 of 1234567 {filler} ann.lee77@mail.example.com {filler * 4} (Ann.Lee77)"))
    texts.append((101, f"nothing here but 555-6996 and 12345 twice: 12345 {filler}"))
    found = {r["doc_id"]: r["spans"] for r in rows(pii_chain.personal_data(spark.createDataFrame(texts, "doc_id long, text string")))}
    again = texts[60][1].rindex("555-6996")
    assert f"phone:{again}:{again + 8}" in found[100].split(",")
    name = texts[60][1].rindex("Ann.Lee77")
    assert f"email:{name}:{name + 9}" in found[100].split(",")
    assert len(found[100].split(",")) == 4
    assert found[101] == ""
    assert all(len(found[k].split(",")) == 2 for k in range(60))


def test_personal_data_of_odd_rows(odd):
    found = {r["doc_id"]: r for r in rows(pii_chain.personal_data(odd))}
    assert len(rows(pii_chain.personal_data(odd))) == 11
    assert [found[8][f"n_{k}"] for k in pii_chain.KINDS] == [1, 1, 1, 1]
    assert found[3]["spans"] == ""
    assert rows(pii_chain.personal_data(odd.limit(0))) == []


# 3 quality classifier


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in rows(spark.read.parquet(f"{d}/labels.parquet"))}
    found = rows(queries.op3_bayes_support_vectors(spark, d))
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, _, q in held if q == 1], [s for s, _, q in held if q == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95
    assert np.mean([p == q for _, p, q in held]) > 0.93
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_dual_descent_reaches_the_optimum():
    rng = np.random.Generator(np.random.PCG64(2))
    found = [np.unique(rng.integers(0, 40, 8)).astype(np.int32) for _ in range(120)]
    labels = np.array([int(r.min() < 4) for r in found])
    ratio = rng.normal(size=40)
    w, b = nbsvm.descend(found, labels, ratio, epochs=2000)
    y = np.where(labels == 1, 1, -1)
    bound = np.where(labels == 1, 120 / (2 * (labels == 1).sum()), 120 / (2 * (labels == 0).sum()))
    x = [nbsvm.scaled(r, ratio) for r in found]

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(c * max(0, 1 - s * (w[r] @ v + b)) for r, v, s, c in zip(found, x, y, bound, strict=True))

    best = loss(w, b)
    for _ in range(300):
        assert loss(w + rng.normal(size=40) * 0.01, b + rng.normal() * 0.01) >= best - 1e-3 * best


def test_classifier_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (8, 1), (5, 1), (None, 1), (4, None)], "doc_id long, quality int")
    found = rows(nbsvm.scores(odd, labels))
    assert len(found) == 11 and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in rows(nbsvm.scores(odd, labels.limit(0)))} == {0.5}
    assert rows(nbsvm.scores(odd.limit(0), labels)) == []


def test_near_copies_without_an_id_or_with_one_id_for_two_texts(spark):
    words = [f"w{k}" for k in range(200)]
    near = words[:]
    near[150] = "other"
    other = [f"v{k}" for k in range(200)]
    near_other = other[:]
    near_other[20] = "else"
    texts = [(None, words), (1, near), (5, other), (5, [f"u{k}" for k in range(90)]), (3, near_other), (None, [f"t{k}" for k in range(60)])]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts], "doc_id long, text string")
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(chosen_path.near_components(df)))
    assert found == Counter([(None, 197, 1, False), (1, 197, 1, True), (5, 197, 3, False), (5, 87, 5, True), (3, 197, 3, True), (None, 57, None, True)])


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.1.1", "1." * 3000, "7" * 1_000_000, "9" * 20_000 + ".1.2", "<1.2.3.4.5.6.7.8.256.1>" * 50])
def test_addresses_in_long_digit_runs(text):
    began = time.time()
    got = [(a, b) for kind, a, b in pii_chain.base_spans(text) if kind == 1]
    assert time.time() - began < 5
    if len(text) < 10_000:
        want = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
        assert got == want
