"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans. The field's nodes are the tokens of a text that hold a digit or
an at sign; its labels are the kinds and none. Neighbouring nodes share a transition potential, and
each token shares a skip potential with the last similar one before it, however far away: equal up
to case and punctuation, equal in the last seven digits, or equal to an address's part before the
at sign. Potentials are trained piecewise, in closed form, from counts over all documents with the
base spans as labels. Nodes in base spans keep their label; loopy message passing gives the others
theirs. A token that is linked to one of a kind and gets that kind becomes a further span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import in_batches
from txnrisk.llm.words import SPACED, Words, pieces

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
SHAPES = 4096
ROUNDS = 20
#: Tokens between two nodes that are still neighbours.
NEAR = 3
#: Bounds of what a token's shape, and one neighbour, can say against a label.
EVIDENCE, TIE = 5.0, 1.5
#: Belief that a further span needs.
BELIEF = 0.5

# The patterns of the contract.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits does: the rest of a run that has none has none either
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_NOT_NAME = re.compile(r"[^a-z0-9]")

_MARKED = np.zeros(256, np.int64)
_MARKED[48:58] = _MARKED[64] = 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches that pass their checks, in the order of kinds."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        # without its zeros in front a part has few digits, however long it is
        if all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def _core(token: str, start: int) -> tuple[int, int]:
    """The token's range without punctuation at its ends."""
    a, b = 0, len(token)
    while a < b and not (token[a].isalnum() or token[a] == "+"):
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return start + a, start + b


def _shape(token: str) -> int:
    runs = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", re.sub(r"[^\W\d_]+", "a", token))
    return int.from_bytes(hashlib.blake2b(runs.encode(), digest_size=4).digest(), "big") % SHAPES


def _keys(token: str) -> list[str]:
    """Tokens that share a key are similar."""
    low = token.lower()
    plain, digits = _NOT_NAME.sub("", low), _NOT_DIGIT.sub("", low)
    out = [plain] if len(plain) >= 5 else []
    if len(digits) >= 7:
        out.append("#" + digits[-7:])
    if "@" in low and len(name := _NOT_NAME.sub("", low.partition("@")[0])) >= 5:
        out.append(name)
    return out


class Chain:
    """Nodes of one text with their edges; labels come from the base spans."""

    def __init__(self, tokens: list[tuple[int, int, str]], base: list[tuple[int, int, int]]):
        """tokens: (number of the token in its text, start, token)."""
        self.ranges = [_core(t, a) for _, a, t in tokens]
        self.labels = np.zeros(len(tokens), np.int64)
        # spans of one kind are disjoint and sorted, and so are the nodes
        for kind in range(len(KINDS)):
            own, k = [s for s in base if s[0] == kind], 0
            for i, (a, b) in enumerate(self.ranges):
                while k < len(own) and own[k][2] <= a:
                    k += 1
                if k < len(own) and own[k][1] < b and not self.labels[i]:
                    self.labels[i] = kind + 1
        self.shapes = np.array([_shape(t) for _, _, t in tokens], np.int64)
        chain, skip, last = [], [], {}
        for i, (number, _, token) in enumerate(tokens):
            if i and number - tokens[i - 1][0] <= NEAR:
                chain.append((i - 1, i))
            keys = _keys(token)
            for j in {last[k] for k in keys if k in last}:
                skip.append((j, i))
            for k in keys:
                last[k] = i
        self.chain, self.skip = (np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip))

    def beliefs(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Marginals by loopy message passing; labelled nodes are evidence."""
        phi = node[self.shapes].copy()
        known = self.labels > 0
        phi[known] = -30.0
        phi[known, self.labels[known]] = 0.0
        edges = np.concatenate([self.chain, self.skip])
        tables = np.concatenate([np.repeat(chain[None], len(self.chain), 0), np.repeat(skip[None], len(self.skip), 0)])
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(src), LABELS))
        for _ in range(ROUNDS):
            total = phi.copy()
            np.add.at(total, dst, message)
            out = (total[src] - message[back])[:, :, None] + pair
            top = out.max(1)
            out = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            out -= out.max(1, keepdims=True)
            # half of the old message keeps loops from swinging
            new = 0.5 * message + 0.5 * out
            moved = np.abs(new - message).max(initial=0.0)
            message = new
            if moved < 1e-3:
                break
        total = phi.copy()
        np.add.at(total, dst, message)
        total = np.exp(total - total.max(1, keepdims=True))
        return total / total.sum(1, keepdims=True)

    def further(self, potentials: tuple[np.ndarray, np.ndarray, np.ndarray], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of unlabelled nodes that a chain of skip edges ties to a labelled one."""
        if not len(self.skip) or self.labels.all() or not self.labels.any():
            return []
        reach = np.eye(LABELS, dtype=bool)[self.labels]
        reach[:, 0] = False
        while True:
            before = reach.sum()
            for i, j in self.skip.tolist():
                reach[i] |= reach[j]
                reach[j] = reach[i]
            if reach.sum() == before:
                break
        open_nodes = np.flatnonzero((self.labels == 0) & reach.any(1))
        if not len(open_nodes):
            return []
        belief = self.beliefs(*potentials)
        out = []
        for i in open_nodes.tolist():
            k = int(belief[i].argmax())
            a, b = self.ranges[i]
            if k and reach[i, k] and belief[i, k] > BELIEF and a < b and not any(s < b and a < e for _, s, e in base):
                out.append((k - 1, a, b))
        return out


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """For each slice of a batch, per text: None if it has no digit and no at sign, else (text, tokens)."""
    for batch in batches:
        for part, texts in pieces(batch, batch.column(column)):
            words = Words(texts, SPACED, lower=False)
            out: list = [None] * len(texts)
            if len(words.start):
                marked = np.flatnonzero(np.add.reduceat(_MARKED[words.data], words.start))
                lead = np.cumsum(np.concatenate([[0], (words.data & 0xC0) != 0x80]))
                owner = words.owner[marked]
                for i in np.unique(owner).tolist():
                    text = texts[i].as_py()
                    own = marked[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]
                    begin = lead[words.start[own]] - lead[words.at[i]]
                    stop = lead[words.end[own]] - lead[words.at[i]]
                    out[i] = (text, [(n, a, text[a:b]) for n, a, b in zip((own - words.first[i]).tolist(), begin.tolist(), stop.tolist(), strict=True)])
            yield part, out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels by shape, by neighbour and by similar token, summed over a task: part, a, b, n."""
    totals = [np.zeros((SHAPES, LABELS), np.int64), np.zeros((LABELS, LABELS), np.int64), np.zeros((LABELS, LABELS), np.int64)]
    for _, texts in _texts(batches, 0):
        for found in texts:
            if found is None:
                continue
            chain = Chain(found[1], base_spans(found[0]))
            np.add.at(totals[0], (chain.shapes, chain.labels), 1)
            for total, edges in ((totals[1], chain.chain), (totals[2], chain.skip)):
                np.add.at(total, (chain.labels[edges[:, 0]], chain.labels[edges[:, 1]]), 1)
    rows = [np.stack([np.full(len(at[0]), k), *at, t[at]]) for k, t in enumerate(totals) for at in [np.nonzero(t)]]
    part, a, b, n = np.concatenate(rows, 1)
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (part, a, b, n)], names=["part", "a", "b", "n"])


def potentials(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log potentials of shapes, neighbours and similar tokens, from all rows' texts (column text)."""
    counts = docs.select("text").mapInArrow(_counted, "part long, a long, b long, n long").groupBy("part", "a", "b").agg(F.sum("n").alias("n")).toArrow()
    tables = [np.zeros((SHAPES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
    for part, a, b, n in zip(*(c.to_pylist() for c in counts.columns), strict=True):
        tables[part][a, b] = n
    prior = tables[0].sum(0) + 1.0
    prior /= prior.sum()
    node = np.log((tables[0] + prior) / (tables[0].sum(1, keepdims=True) + 1.0))
    out = [node]
    for table in tables[1:]:
        # symmetric, with one pseudo-count spread as if the ends were independent, and another on agreement
        both = table + table.T + np.outer(prior, prior) + np.diag(prior)
        both /= both.sum()
        side = both.sum(1)
        out.append(np.log(both) - np.log(np.outer(side, side)))
    # a label missed by the patterns is no proof against it: no potential is stronger than these bounds
    node, chain = np.maximum(out[0], -EVIDENCE), np.clip(out[1], -TIE, TIE)
    # similar tokens are the same thing, so agreement counts at least as much as the worst evidence
    agree = np.diag(np.maximum(np.diag(out[2]), 0.0)) + (EVIDENCE + 2 * TIE) * np.eye(LABELS)
    return node, chain, np.minimum(agree, 3 * EVIDENCE)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _found(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for part, texts in _texts(batches, 1):
        counts = np.zeros((len(KINDS), len(texts)), np.int64)
        hashes, spans = [empty] * len(texts), [""] * len(texts)
        for i, found in enumerate(texts):
            if found is None:
                continue
            base = base_spans(found[0])
            for k, _, _ in base:
                counts[k, i] += 1
            hashes[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
            spans[i] = _joined(base + Chain(found[1], base).further(model.value, base)) if base else ""
        yield pa.RecordBatch.from_arrays(
            [part.column(0), *(pa.array(c) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
            names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row's whole text.

    The counts and the hash are those of the base spans; spans lists base and further ones as
    kind:start:end in code points. A null or empty text has no spans; null ids and repeated rows
    are rows like others; other columns are ignored.
    """
    rows = in_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(potentials(rows))
    kind = "id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return rows.mapInArrow(partial(_found, model=sent), kind).withColumnRenamed("id", id_col)
