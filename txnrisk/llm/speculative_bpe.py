"""Byte-pair encoding by speculation: propose by longest match, verify by pairs, merge only what fails.

A word of the vocabulary's merges is encoded by its greedy longest tokens if, and only if, no two
neighbours would have merged across their border. Two neighbours A B are walked back in time: a part at
A's right edge and a part at B's left edge that exist at the same time would merge if their pair's rank
comes before the rank at which either of them goes into its own parent. Ranks grow from part to whole,
so the later-made part is opened next and each pair of tokens needs one walk down two edges. The walks
of all pairs of a batch are taken at once; words with a pair that fails are merged exactly.

Texts are split at ASCII white space first, which neither the normaliser nor the pre-tokenizer sees
across, and only distinct pieces are looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from txnrisk.llm.common import in_batches
from txnrisk.llm.words import pieces

VOCABULARY = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/word_bpe_49k.json"
#: Distinct words and white-space runs that a worker remembers; the least recent half goes first.
REMEMBERED = 400_000
#: Bytes of text worked on at once; one text is never cut.
SLICE = 1 << 21
_NONE = np.int64(1) << 40


class Numbers:
    """Keys to values, all of a batch looked up at once: open addressing, keys are not negative."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 without one."""
        at = self._place(keys)
        own = self.keys[at]
        out = np.where(own == keys, self.values[at], -1)
        left = np.flatnonzero((own != keys) & (own >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            own, wanted = self.keys[at], keys[left]
            hit = own == wanted
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (own >= 0)
            left, at = left[more], at[more]
        return out


class Merges:
    """Vocabulary with an end-of-word mark as a trie and as merge trees.

    A symbol is a character of the byte alphabet, plus ``MARK`` if it ends its word.
    """

    MARK = 1 << 16
    SHORT = 64

    def __init__(self, vocab: dict[str, int], merges: Sequence[Sequence[str]], suffix: str):
        self.suffix = suffix
        self.text = {i: t for t, i in vocab.items()}
        size = max(vocab.values()) + 1
        self.size = size
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.whole: np.ndarray = np.zeros(len(merges), np.int64)
        pairs: dict[int, int] = {}
        self.made: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a.removesuffix(suffix) + b]
            self.left[z], self.right[z], self.rank[z] = x, y, k
            pairs[x * size + y] = k
            self.made[x, y] = (k, z)
            self.whole[k] = z
        self.ranks = Numbers(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))
        self._trie(vocab)

    def symbols(self, word: str) -> list[int]:
        found = [ord(c) for c in word]
        found[-1] += self.MARK
        return found

    def _stable(self) -> np.ndarray:
        """Tokens that their own symbols are merged to; only these may be proposed."""
        made = np.flatnonzero(self.rank >= 0)
        alone = np.ones(self.size, bool)
        alone[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])].tolist():
            alone[t] &= alone[self.left[t]] and alone[self.right[t]]
        return alone

    def _trie(self, vocab: dict[str, int]) -> None:
        stable = self._stable()
        self.single: dict[int, int] = {}
        edges: dict[tuple[int, int], int] = {}
        token = [-1]
        for t, i in vocab.items():
            if not stable[i]:
                continue
            body = self.symbols(t.removesuffix(self.suffix)) if t.endswith(self.suffix) and t != self.suffix else [ord(c) for c in t]
            node = 0
            for s in body:
                to = edges.get((node, s))
                if to is None:
                    to = edges[node, s] = len(token)
                    token.append(-1)
                node = to
            token[node] = i
            if len(body) == 1:
                self.single[body[0]] = i
        self.token = np.array(token, np.int64)
        self.edges = Numbers(np.array([n * 2 * self.MARK + s for n, s in edges], np.int64), np.array(list(edges.values()), np.int64))

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.ranks.get(a * self.size + b)
        return np.where(found < 0, _NONE, found)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether the tokens a[i] b[i] stay apart, up to the rank ``until[i]`` if that is given."""
        n = len(a)
        good = np.ones(n, bool)
        r, s = a.copy(), b.copy()
        # ranks at which the two parts go into their parents; of equal pairs the left one merges first
        r_ends = np.full(n, _NONE) if until is None else until.copy()
        s_ends = np.full(n, _NONE - 1) if until is None else until.copy()
        live = np.arange(n)
        while len(live):
            x, y = r[live], s[live]
            m = self.merge_rank(x, y)
            meets = (m < r_ends[live]) & (m <= s_ends[live])
            good[live[meets]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~meets & (np.maximum(rx, ry) >= 0)
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            older = rx > ry
            k = live[older]
            r[k], r_ends[k] = self.right[x[older]], rx[older]
            k = live[~older]
            s[k], s_ends[k] = self.left[y[~older]], ry[~older]
        return good

    def longest(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest token and its symbols from each place on; marks end words, so none crosses one."""
        best, length = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
        place, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while len(place):
            node = self.edges.get(node * (2 * self.MARK) + data[place + depth])
            hit = node >= 0
            place, node = place[hit], node[hit]
            depth += 1
            ends = self.token[node] >= 0
            best[place[ends]], length[place[ends]] = self.token[node[ends]], depth
            inside = place + depth < len(data)
            place, node = place[inside], node[inside]
        return best, length

    def exact(self, word: str) -> list[int]:
        """Merge by merge, lowest rank first and leftmost among equals. Unknown symbols are left out."""
        ids = [self.single[s] for s in self.symbols(word) if s in self.single]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(*self.made[pair], k) for k, pair in enumerate(zip(ids, ids[1:])) if pair in self.made]
        heapq.heapify(heap)
        while heap:
            _, whole, k = heapq.heappop(heap)
            j = after[k]
            # a part that went into another token since has no place or another value
            if ids[k] < 0 or j >= len(ids) or self.made.get((ids[k], ids[j]), (0, -1))[1] != whole:
                continue
            ids[k], ids[j] = whole, -1
            after[k] = j = after[j]
            if j < len(ids):
                before[j] = k
            for x, y in ((before[k], k), (k, j)):
                if x >= 0 and y < len(ids) and (ids[x], ids[y]) in self.made:
                    heapq.heappush(heap, (*self.made[ids[x], ids[y]], x))
        return [i for i in ids if i >= 0]

    def exact_all(self, words: list[str]) -> list[list[int]]:
        """``exact`` of many words, a merge of each at a time; long ones, whose merges are many, go one by one."""
        out: list[list[int]] = [[]] * len(words)
        short = []
        for k, w in enumerate(words):
            if len(w) <= self.SHORT and all(s in self.single for s in self.symbols(w)):
                short.append(k)
            else:
                out[k] = self.exact(w)
        ids = np.array([self.single[s] for k in short for s in self.symbols(words[k])], np.int64)
        owner = np.repeat(np.arange(len(short)), [len(words[k]) for k in short])
        while len(ids):
            rank = np.full(len(ids), _NONE)
            inner = np.flatnonzero(owner[:-1] == owner[1:])
            rank[inner] = self.merge_rank(ids[inner], ids[inner + 1])
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, heads)
            going = least < _NONE
            for a, b in zip(heads[~going].tolist(), np.r_[heads[1:], len(ids)][~going].tolist()):
                out[short[owner[a]]] = ids[a:b].tolist()
            sizes = np.diff(np.r_[heads, len(ids)])
            at = np.flatnonzero(np.repeat(going, sizes) & (rank == np.repeat(least, sizes)))
            at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]] if len(at) else at
            ids[at] = self.whole[rank[at]]
            stay = np.repeat(going, sizes)
            stay[at + 1] = False
            ids, owner = ids[stay], owner[stay]
        return out

    def encode(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Tokens of each word, which is not empty, and how many words failed the check of their pairs."""
        if not words:
            return [], 0
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        data[ends - 1] += self.MARK
        best, length = (x.tolist() for x in self.longest(data))
        found, at = [], 0
        for end in ends.tolist():
            own = []
            while at < end:
                own.append(best[at])
                at += length[at] or 1
            found.append(own)
        flat = np.array([i for own in found for i in own], np.int64)
        owner = np.repeat(np.arange(len(words)), [len(own) for own in found])
        bad = np.zeros(len(words), bool)
        bad[owner[flat < 0]] = True
        inner = np.flatnonzero((owner[:-1] == owner[1:]) & (flat[:-1] >= 0) & (flat[1:] >= 0))
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        apart = self.compatible(pairs // self.size, pairs % self.size)
        bad[owner[inner[~apart[back]]]] = True
        failed = np.flatnonzero(bad).tolist()
        for k, ids in zip(failed, self.exact_all([words[k] for k in failed]), strict=True):
            found[k] = ids
        return found, int(bad.sum())


class Recent:
    """A mapping that forgets: once the new half is full, the half before it goes."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.new, self.old = max(1, most // 2), {}, {}

    def get_all(self, keys: list) -> list:
        """The values, None where there is none."""
        found = list(map(self.new.get, keys))
        for k in [k for k, value in enumerate(found) if value is None] if self.old else []:
            found[k] = self.old.get(keys[k])
            if found[k] is not None:
                self[keys[k]] = found[k]
        return found

    def __setitem__(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Encoder:
    """A tokenizer file: its normaliser and pre-tokenizer split the text, ``Merges`` does the rest."""

    def __init__(self, content: str):
        parts = json.loads(content)
        model = parts["model"]
        odd = {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)}
        if model["type"] != "BPE" or odd or parts.get("decoder"):
            raise ValueError(f"not a plain vocabulary of merges without a decoder: {model['type']}, {odd}")
        added = parts.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError("added tokens are taken from the raw text, as they are")
        suffix = model.get("end_of_word_suffix") or ""
        if not suffix:
            raise ValueError("the vocabulary has no end-of-word mark")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, suffix)
        self.added = {t["content"]: t["id"] for t in added}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.text = self.merges.text | {i: t for t, i in self.added.items()}
        front = Tokenizer.from_str(json.dumps(parts | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self.normal, self.cut = front.normalizer, front.pre_tokenizer
        self.ascii = self._ascii(parts)
        self.words, self.runs = Recent(), Recent()

    @staticmethod
    def _ascii(parts: dict) -> re.Pattern | None:
        """The pre-tokenizer's pattern for lower-case printable ASCII, if the file lowers case and splits by letters and numbers."""
        kinds = [n["type"] for n in (parts.get("normalizer") or {}).get("normalizers", [])]
        cuts = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or cuts[1]["use_regex"] or cuts[1]["add_prefix_space"]:
            return None
        if cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or "Regex" not in cuts[0]["pattern"]:
            return None
        pattern = cuts[0]["pattern"]["Regex"].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
        return None if r"\p" in pattern else re.compile(pattern)

    def _words(self, run: str) -> list[str | int]:
        """Pre-tokenized words of a run without ASCII white space, and ids of added tokens in it."""
        if self.ascii and run.isascii() and run.isprintable() and not any(t in run for t in self.added):
            return self.ascii.findall(run.lower())
        found: list[str | int] = []
        for part in self.split.split(run) if self.split else [run]:
            if part in self.added:
                found.append(self.added[part])
            elif part:
                plain = self.normal.normalize_str(part) if self.normal else part
                found += [w for w, _ in self.cut.pre_tokenize_str(plain) if w] if self.cut else [plain]
        return found

    def encode_runs(self, runs: list[str]) -> list[tuple[int, str, str]]:
        """(number of tokens, ids by spaces, tokens by spaces) of each run."""
        out = self.runs.get_all(runs)
        missing = [k for k, value in enumerate(out) if value is None]
        cut = [self._words(runs[k]) for k in missing]
        words = list({w for own in cut for w in own if isinstance(w, str)})
        known = dict(zip(words, self.words.get_all(words), strict=True))
        fresh = [w for w, value in known.items() if value is None]
        for w, ids in zip(fresh, self.merges.encode(fresh)[0], strict=True):
            known[w] = self.words[w] = (len(ids), " ".join(map(str, ids)), " ".join([self.text[i] for i in ids]))
        for k, own in zip(missing, cut, strict=True):
            if len(own) == 1 and isinstance(own[0], str):
                out[k] = known[own[0]]
            else:
                each = [(1, str(w), self.text[w]) if isinstance(w, int) else known[w] for w in own]
                out[k] = (sum(n for n, _, _ in each), " ".join([x for _, x, _ in each]), " ".join([x for _, _, x in each]))
            self.runs[runs[k]] = out[k]
        return out

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Number of tokens, ids by spaces and decoded text of each text; a null is empty."""
        lists = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        found = self.encode_runs(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.array([n for n, _, _ in found], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        full = counts > 0
        before = np.concatenate([[0], np.cumsum(full)])
        sums = np.concatenate([[0], np.cumsum(counts)])
        places, codes = before[at].tolist(), codes[full]
        joined = []
        for k in (1, 2):
            each = np.array([x[k] for x in found] + [""], object)[codes]
            joined.append(pa.array([" ".join(each[a:b]) for a, b in zip(places, places[1:])], pa.string()))
        return np.diff(sums[at]), *joined


_ENCODERS: dict[str, Encoder] = {}


def encoder(content: str) -> Encoder:
    """The encoder of a tokenizer file's content, once per worker."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(content)
    return _ENCODERS[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _encoded(batches: Iterator[pa.RecordBatch], content: Broadcast) -> Iterator[pa.RecordBatch]:
    machine = encoder(content.value)
    for batch in batches:
        for part, texts in pieces(batch, batch.column(1), SLICE):
            n, ids, decoded = machine.texts(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), ids, decoded], names=["id", "n_tokens", "ids", "decoded"])


def _digests(batches: Iterator[pa.RecordBatch], content: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in _encoded(batches, content):
        sums = [pa.array([hashlib.sha256(t.encode()).hexdigest() for t in batch.column(k).to_pylist()], pa.string()) for k in (2, 3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sums], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _applied(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, work, schema: str) -> DataFrame:
    rows = in_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    content = docs.sparkSession.sparkContext.broadcast(read_tokenizer(vocabulary))
    return rows.mapInArrow(partial(work, content=content), f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, n_tokens, ids, decoded): token ids of each whole text, joined by spaces, and their decoded text.

    Encoding has no added start and end, but their strings in a text are the added tokens; decoding
    skips nothing. A null or empty text, and one of white space only, has no tokens and the empty
    string twice. Null ids, repeated rows and texts of any length are encoded as they are (a text is
    held whole by one task); other columns are ignored, an empty table gives an empty one.
    ``vocabulary`` is a tokenizer file that the driver can read; it goes to the workers as a broadcast
    of the file's size, whatever the table's.
    """
    return _applied(docs, id_col, text_col, vocabulary, _encoded, "n_tokens long, ids string, decoded string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): ``encoded`` with both strings as digests, made where they are joined."""
    return _applied(docs, id_col, text_col, vocabulary, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
