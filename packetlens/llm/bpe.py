"""BPE encoding and decoding by a tokenization automaton.

States are tokens: after reading a token the automaton is in that token's state, and an arc u -> v, labelled v, says
that v may follow u. At first there are the base tokens, each with arcs to all. Each merge (a, b) -> c, in order, adds a
gadget: a state c that gets the out-arcs which b has at that point and the in-arcs which a has, while the arc a -> b goes.
Exactly one path of the final automaton spells a given string, and it is the string's BPE encoding. An explicit table
would have (number of tokens) squared cells, so gadgets are kept as built - the two states a gadget copied, and when -
and the cells that texts need are resolved through them once and then kept in a transition table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, record_batch, releasing, small_batches

#: Fixed value: the pattern that splits text before merges (byte-level BPE of this vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids are kept in each worker; past it, the store starts anew.
WORDS_KEPT = 60_000
#: Cells of the transition table, as a power of two.
ARC_BITS = 21
ARC_SLOTS = 1 << ARC_BITS


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, and the byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The compiled tables.

    label: the bytes of each arc's token. born: after how many gadgets a state exists. out_of, into: the states whose
    out-arcs and in-arcs a gadget copied. gone: for a pair (a << 32 | b), the gadget that removed the arc. step: the
    byte-trie of labels, for finding the arcs that the next bytes allow. special: tokens that are cut out of text first.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        symbols = byte_symbols()
        spell = lambda s: bytes(symbols[c] for c in s)
        self.special = special
        self.label: list[bytes] = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            self.label[i] = spell(token)
        n = len(self.label)
        self.born, self.out_of, self.into, self.gone = [0] * n, [-1] * n, [-1] * n, {}
        made = {i for token, i in vocab.items() if len(token) == 1}
        for k, (a, b) in enumerate(merges, 1):
            self._gadget(k, vocab[a], vocab[b], vocab[a + b], made)
        for token, i in special.items():
            self.label[i] = token.encode()
        self._tables(made)
        self.words: dict[str, bytes] = {}

    def _tables(self, made: set[int]) -> None:
        """step: from a trie node (row) and a byte, the next node, else -1; nodes with children stand first. token: of a
        node, or -1. size: bytes of a label."""
        children: list[dict[int, int]] = [{}]
        token = [-1]
        for i in sorted(made):
            node = 0
            for byte in self.label[i]:
                node = children[node].setdefault(byte, len(children))
                if node == len(children):
                    children.append({})
                    token.append(-1)
            token[node] = i
        order = sorted(range(len(children)), key=lambda x: not children[x])
        place = {old: new for new, old in enumerate(order)}
        rows = sum(bool(c) for c in children)
        self.step = np.full((rows + 1, 256), -1, np.int32)
        self.rows = rows
        self.token = np.array([token[x] for x in order], np.int64)
        for old, found in enumerate(children):
            for byte, child in found.items():
                self.step[place[old], byte] = place[child]
        self.size = np.array([len(x) for x in self.label], np.int64)
        self.arc_key, self.arc_there = np.full(ARC_SLOTS, -1, np.int64), np.zeros(ARC_SLOTS, bool)

    def _gadget(self, k: int, a: int, b: int, c: int, made: set[int]) -> None:
        """Merge k. A pair that can't be adjacent any more, or a token that an earlier merge makes, needs no new state."""
        if a in made and b in made and (a << 32 | b) not in self.gone:
            self.gone[a << 32 | b] = k
            if c not in made:
                self.born[c], self.out_of[c], self.into[c] = k, b, a
                made.add(c)

    @classmethod
    def load(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], pairs, {x["content"]: x["id"] for x in data.get("added_tokens", [])})

    def arcs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Does each arc u -> v exist after the last gadget? Looked up in the transition table, which fills as it is asked;
        a slot holds the latest of the arcs that share it."""
        key = u << 32 | v
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - ARC_BITS)).astype(np.int64)
        out = self.arc_there[slot]
        miss = np.flatnonzero(self.arc_key[slot] != key)
        if len(miss):
            asked, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            there = np.fromiter((self._resolve(k >> 32, k & 0xFFFFFFFF) for k in asked.tolist()), bool, len(asked))
            out[miss] = there[back]
            at, one = np.unique(slot[miss][first], return_index=True)
            self.arc_key[at], self.arc_there[at] = asked[one], there[one]
        return out

    def _resolve(self, u: int, v: int) -> bool:
        born, gone, until = self.born, self.gone, 1 << 60
        while True:
            if gone.get(u << 32 | v, 1 << 61) < until:
                return False
            bu, bv = born[u], born[v]
            if not bu and not bv:
                return True
            if bu > bv:  # u was made with the out-arcs of out_of[u] before its own gadget's removal
                until, u = bu, self.out_of[u]
            elif bv > bu:  # v got the in-arcs of into[v] after its gadget's removal
                until, v = bv + 1, self.into[v]
            else:  # the new state's arc to itself: had its second part an arc to its first?
                until, u, v = bu, self.out_of[u], self.into[v]

    def _labels_at(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, token) of every label that stands in data and ends by `stop` of its place."""
        places, tokens = [], []
        who, node, i = np.arange(len(data)), np.zeros(len(data), np.int64), np.arange(len(data))
        while len(who):
            node = self.step[node, data[i]]
            on = node >= 0
            who, node, i = who[on], node[on], i[on] + 1
            token = self.token[node]
            on = token >= 0
            places.append(who[on])
            tokens.append(token[on])
            on = (i < stop[who]) & (node < self.rows)
            who, node, i = who[on], node[on], i[on]
        return np.concatenate(places), np.concatenate(tokens)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers. All words step through the tables together, byte
        by byte. A prefix is spelled by one path only, so a place has one state, the last label of that path; the arcs
        out of it that the next bytes spell set the states of later places. The path is read off from the end."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size)
        if not len(data):
            return [b""] * len(words)
        first = np.repeat(stop - size, size)
        place, token = self._labels_at(data, np.repeat(stop, size))
        offset = place - first[place]
        order = np.argsort(offset, kind="stable")
        place, token = place[order], token[order]
        cuts = np.searchsorted(offset[order], np.arange(offset.max() + 2))
        state = np.full(len(data), -1, np.int64)  # of the place behind each byte
        for p in range(len(cuts) - 1):
            at, t = place[cuts[p] : cuts[p + 1]], token[cuts[p] : cuts[p + 1]]
            if p:
                there = self.arcs(state[at - 1], t)
                at, t = at[there], t[there]
            state[at + self.size[t] - 1] = t
        who, end = np.flatnonzero(size), stop[size > 0]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            t = state[end - 1]
            if (t < 0).any():
                raise ValueError("a byte has no base token")
            found.append((who, t))
            end = end - self.size[t]
            on = end > (stop - size)[who]
            who, end = who[on], end[on]
        owner, tokens = (np.concatenate([x[k] for x in reversed(found)]) for k in (0, 1))
        order = np.argsort(owner, kind="stable")
        ids = tokens[order].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [[p if p in self.special else PATTERN.findall(p) for p in self._cut(t)] for t in texts]
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        new = {w for text in parts for p in text if type(p) is list for w in p} - self.words.keys()
        own = dict(zip(new, self.encode_words([w.encode() for w in new]), strict=True)) if new else {}
        kept = self.words
        kept.update(own)
        out = [b"".join([b"".join([kept[w] for w in p]) if type(p) is list else self.special[p].to_bytes(4, "little") for p in text]) for text in parts]
        return out

    def _cut(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return [text]
        return [x for x in regex.split("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")", text) if x]

    def decode(self, ids: bytes) -> bytes:
        """The labels along the path; bytes that are no UTF-8 become replacement characters."""
        label = self.label
        return b"".join([label[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode(errors="replace").encode()


PATTERN = regex.compile(SPLIT)
_LOADED: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """Compiled once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Automaton.load(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, with_ids, (ids array<int>, decoded string), for every row.

    path: a tokenizer file that every executor has at the same place. A null text counts as empty: no ids, and the
    digest of nothing. Repeated rows are all returned; an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        try:
            own = automaton(path)
            for batch in batches:
                if batch.num_rows:
                    yield from each(batch, own)
        finally:
            _LOADED.clear()  # a worker outlives its task; the tables would stay beside those of other workers

    def each(batch: pa.RecordBatch, own: Automaton) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batch, limit=1 << 20):
            ids = own.encode_all([t.decode(errors="replace") for t in texts])
            decoded = [own.decode(x) for x in ids]
            columns = {
                "doc_id": part.column(0),
                "n_tokens": np.array([len(x) // 4 for x in ids], np.int64),
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded],
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
                columns["decoded"] = [x.decode() for x in decoded]
            yield record_batch(**columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return small_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(releasing(run), schema)
