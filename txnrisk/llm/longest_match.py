"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. A word starts with a space and is cut greedily into the longest
tokens. Each trie node has a failure link, the node reached after popping the longest tokens of its
string, and the number of tokens popped; a word is then counted in one pass over its bytes without
building its pieces. All distinct words of a batch walk the automaton at the same time.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import in_batches
from txnrisk.llm.words import SPACED, Words, pieces

VOCABULARY = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Trie of the tokens with failure links and popped-token counts. Node 0 is the root.

    Tokens with a space begin words; the others continue them. -1 marks a missing edge or link.
    """

    def __init__(self, tokens: list[bytes]):
        children: list[dict[int, int]] = [{}]
        token = [False]
        for t in sorted(tokens):
            node = 0
            for b in t:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    token.append(False)
                node = children[node][b]
            token[node] = node > 0
        n = len(children)
        self.fail, self.popped = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        level = [0]
        while level:
            below = []
            for parent in level:
                for byte, node in children[parent].items():
                    below.append(node)
                    if token[node]:
                        self.fail[node], self.popped[node] = 0, 1
                        continue
                    # pop what the parent pops until the byte can follow
                    at, count = self.fail[parent], self.popped[parent]
                    while at >= 0 and byte not in children[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = children[at][byte], count
            level = below
        edges = sorted((node * 256 + byte, to) for node, own in enumerate(children) for byte, to in own.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.to = np.array([v for _, v in edges], np.int64)

    def step(self, nodes: np.ndarray, values: np.ndarray) -> np.ndarray:
        keys = nodes * 256 + values
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.to[at], -1)

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each word data[start:end]; a word that the vocabulary can't spell is one token."""
        n = len(start)
        node = np.full(n, int(self.step(np.zeros(1, np.int64), np.array([32]))[0]), np.int64)
        total, lost = np.zeros(n, np.int64), node < 0
        length = end - start
        order = np.argsort(-length, kind="stable")
        for k in range(int(length.max()) if n else 0):
            live = order[: np.searchsorted(-length[order], -k, "left")]
            live = live[~lost[live]]
            self._advance(node, total, lost, live, data[start[live] + k].astype(np.int64))
        # the end pops what is left, link by link
        live = np.flatnonzero(~lost & (node > 0))
        while len(live):
            link = self.fail[node[live]]
            lost[live[link < 0]] = True
            live, link = live[link >= 0], link[link >= 0]
            total[live] += self.popped[node[live]]
            node[live] = link
            live = live[node[live] > 0]
        total[lost] = 1
        return total

    def _advance(self, node: np.ndarray, total: np.ndarray, lost: np.ndarray, live: np.ndarray, values: np.ndarray) -> None:
        while len(live):
            to = self.step(node[live], values)
            moved = to >= 0
            node[live[moved]] = to[moved]
            live, values = live[~moved], values[~moved]
            link = self.fail[node[live]]
            lost[live[link < 0]] = True
            live, values, link = live[link >= 0], values[link >= 0], link[link >= 0]
            total[live] += self.popped[node[live]]
            node[live] = link


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file, once per worker."""
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(read_vocabulary(path))
    return _AUTOMATA[path]


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    machine = automaton(vocabulary)
    for batch in batches:
        for part, texts in pieces(batch, batch.column(1)):
            words = Words(texts, SPACED, lower=False)
            _, one, back = np.unique(words.hash, return_index=True, return_inverse=True)
            each = machine.counts(words.data, words.start[one], words.end[one])
            tokens = np.bincount(words.owner, weights=each[back] if len(one) else [], minlength=len(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(words.at)), pa.array(words.counts.astype(np.int64)), pa.array(tokens.astype(np.int64))],
                names=["id", "n_bytes", "n_words", "n_tokens"],
            )


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, n_bytes, n_words, n_tokens) of the whole text of each row.

    Words are runs without white space, each counted as if a space stood before it. A null or
    empty text has no tokens; null ids, repeated rows and texts of any length are counted as they
    are; other columns are ignored. ``vocabulary`` is a file that every executor can read.
    """
    rows = in_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = rows.mapInArrow(partial(_counted, vocabulary=vocabulary), "id long, n_bytes long, n_words long, n_tokens long")
    return counted.withColumnRenamed("id", id_col)
