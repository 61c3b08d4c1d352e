"""Token counts by greedy longest match, in one pass over the bytes and without building pieces.

The vocabulary becomes a trie whose nodes carry a failure link and the number of tokens
popped when that link is taken, both worked out beforehand: the text of a node is split into
its longest vocabulary prefixes until what is left is a node again. A word is then read once,
byte by byte; when no edge fits, the popped tokens are counted and the link is followed.
Tasks run the automaton over all distinct words of a slice side by side in numpy.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from featshift.llm.arrays import flat, segment_sums, slices, span_hashes, word_spans


class LongestMatch:
    """Trie with failure links over byte tokens; all 256 single bytes must be tokens."""

    def __init__(self, tokens: Sequence[bytes]):
        if len({t for t in tokens if len(t) == 1}) < 256:
            raise ValueError("the vocabulary needs every single byte")
        children: list[dict[int, int]] = [{}]
        parent, byte, is_token = [0], [0], [False]
        for token in tokens:
            at = 0
            for b in token:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    parent.append(at)
                    byte.append(b)
                    is_token.append(False)
                at = children[at][b]
            is_token[at] = is_token[at] or bool(token)
        n = len(children)
        link, popped = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        level = [0]
        while level:  # by depth: links of shorter nodes are known
            level = [c for v in level for c in children[v].values()]
            for v in level:
                if is_token[v]:
                    popped[v] = 1  # the whole node is one token, nothing is left
                    continue
                at, count = link[parent[v]], popped[parent[v]]
                while byte[v] not in children[at]:  # the root has an edge for every byte
                    count += popped[at]
                    at = link[at]
                link[v], popped[v] = children[at][byte[v]], count
        self.link, self.popped = link, popped
        edges = sorted((v * 256 + b, c) for v, found in enumerate(children) for b, c in found.items())
        # Open addressing with a table four times the edges: a few probes in small arrays.
        bits = int(4 * len(edges)).bit_length()
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.targets = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        waiting, to = (np.array(x) for x in zip(*edges, strict=True))
        slot = self._slot(waiting)
        self.probes = 0
        while len(waiting):
            self.probes += 1
            free = self.keys[slot] == -1
            self.keys[slot[free]], self.targets[slot[free]] = waiting[free], to[free]
            left = self.keys[slot] != waiting
            waiting, to, slot = waiting[left], to[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _step(self, nodes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Target of each edge, -1 where there is none."""
        keys = nodes.astype(np.int64) * 256 + found
        out, slot, open_ = np.full(len(keys), -1, dtype=np.int32), self._slot(keys), np.arange(len(keys))
        for _ in range(self.probes):
            seen = self.keys[slot]
            hit = seen == keys[open_]
            out[open_[hit]] = self.targets[slot[hit]]
            more = ~hit & (seen != -1)
            if not more.any():
                break
            open_, slot = open_[more], (slot[more] + 1) & self.mask
        return out

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Greedy tokens of each word ``data[start:end]``."""
        order = np.argsort(starts - ends, kind="stable")  # long words first, so those still open are a prefix
        starts, lengths = starts[order], (ends - starts)[order]
        nodes, counts = np.zeros(len(starts), dtype=np.int32), np.zeros(len(starts), dtype=np.int64)
        n_open = len(starts)
        for at in range(int(lengths[0]) if len(lengths) else 0):
            n_open = int(np.searchsorted(-lengths[:n_open], -at, side="left"))
            found = data[starts[:n_open] + at].astype(np.int64)
            waiting = np.arange(n_open)
            while len(waiting):
                target = self._step(nodes[waiting], found[waiting])
                fits = target >= 0
                nodes[waiting[fits]] = target[fits]
                waiting = waiting[~fits]
                counts[waiting] += self.popped[nodes[waiting]]
                nodes[waiting] = self.link[nodes[waiting]]
        waiting = np.flatnonzero(nodes)
        while len(waiting):
            counts[waiting] += self.popped[nodes[waiting]]
            nodes[waiting] = self.link[nodes[waiting]]
            waiting = waiting[nodes[waiting] > 0]
        out = np.empty(len(counts), dtype=np.int64)
        out[order] = counts
        return out


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(x.split()[0]) for x in lines if x.strip()]


def marked_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with the one space before them, and each other white-space byte alone.

    A space belongs to the word that follows it directly; a white-space byte that no word
    takes counts as a word of its own. Nothing crosses a row.
    """
    starts, ends, _ = word_spans(data, bounds)
    first = np.zeros(len(data) + 1, dtype=bool)
    first[bounds] = True
    takes = (starts > 0) & ~first[starts] & (data[starts - 1] == 0x20)
    used = np.zeros(len(data) + 1, dtype=np.int32)
    used[starts - takes] += 1
    used[ends] -= 1
    alone = np.flatnonzero(np.cumsum(used[:-1]) == 0)
    starts, ends = np.concatenate((starts - takes, alone)), np.concatenate((ends, alone + 1))
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], np.searchsorted(starts[order], bounds)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", n_tokens: str = "n_tokens", n_words: str = "n_words") -> DataFrame:
    """Add the greedy token count of each whole text, and its number of words and lone blanks.

    ``vocabulary`` is the path of a byte-level rank file on every machine. Null and empty
    texts have 0 tokens. Columns with the names of the results are replaced, others stay.
    """
    kept = [c for c in docs.columns if c not in (n_tokens, n_words)]
    source = text if text in kept else "_text"
    frame = docs.select(*kept, *([docs[text].alias(source)] if source not in kept else []))
    out_fields = [f for f in frame.schema.fields if f.name in kept]
    schema = T.StructType([*out_fields, T.StructField(n_tokens, T.LongType()), T.StructField(n_words, T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LongestMatch(read_ranks(vocabulary))
        for batch in slices(batches, source, 2 << 20):
            data, bounds = flat(batch.column(source))
            starts, ends, firsts = marked_words(data, bounds)
            _, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            counts = automaton.count(data, starts[first], ends[first])[back]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in out_fields), pa.array(segment_sums(counts, firsts)), pa.array(np.diff(firsts).astype(np.int64))],
                names=schema.names,
            )

    return frame.mapInArrow(task, schema)
