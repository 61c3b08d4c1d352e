"""The whole pipeline on the smallest tables against plain Python, stage by stage."""

from __future__ import annotations

import re

import numpy as np

import corpus_pipeline
from featshift.catalog.base import table
from featshift.llm import quality
from featshift.llm.pieces import ChunkCodec
from featshift.llm.queries import tokenizer_path

BLANKS = re.compile(r"[\x20\x09-\x0D]+")
BREAKS = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _ascii_lower(text: str) -> str:
    return text.encode().lower().decode()


def _accepted(docs: dict[int, str], model: quality.QualityModel) -> dict[int, str]:
    def score(text: str) -> float:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return float(model.score(data, np.array([0, len(data)]))[0])

    return {k: t for k, t in docs.items() if score(t) >= 0.7}


def _without_repeated_lines(docs: dict[int, str]) -> dict[int, str]:
    seen: list[set[str]] = []
    out = {}
    for key in sorted(docs):
        lines = docs[key].split("\n")
        kept = []
        for line in lines:
            words = {w for w in BLANKS.split(line.lower()) if w}
            if not (words and any(4 * max(len(words), len(x)) <= 5 * min(len(words), len(x)) and 5 * len(words & x) >= 4 * len(words | x) for x in seen)):
                kept.append(line)
            seen += [words] if words else []
        if kept:
            out[key] = "\n".join(kept)
    return out


def _first_of_each_group(docs: dict[int, str]) -> dict[int, str]:
    sets = {}
    for key, text in docs.items():
        words = [w for w in BLANKS.split(_ascii_lower(text)) if w]
        sets[key] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    label = {k: k for k in docs}
    links = [(a, b) for a in docs for b in docs if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in docs:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {k: t for k, t in docs.items() if label[k] == k}


def _without_benchmark(docs: dict[int, str], items: list[str]) -> dict[int, str]:
    def words(text: str) -> list[str]:
        return [w for w in BREAKS.split(_ascii_lower(text)) if w]

    windows = set()
    for item in map(words, items):
        windows |= {tuple(item[i : i + 10]) for i in range(max(len(item) - 9, 1))} if item else set()
    sizes = {len(w) for w in windows}
    return {k: t for k, t in docs.items() if not any(tuple(ws[i : i + n]) in windows for ws in [words(t)] for n in sizes for i in range(len(ws) - n + 1))}


def test_pipeline_against_plain_python(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").collect()
    docs = {r.doc_id: r.text or "" for r in rows}
    assert len(docs) == len(rows)
    model = quality.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    items = [r.text for r in table(spark, sf_dir, "benchmark").collect() if r.text]
    counts = [len(docs)]
    for stage in (lambda d: _accepted(d, model), _without_repeated_lines, _first_of_each_group, lambda d: _without_benchmark(d, items)):
        docs = stage(docs)
        counts.append(len(docs))
    assert len(set(counts)) >= 4  # the stages do drop documents
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.text or "" for r in got} == docs and len(got) == len(docs)
    pieces = ChunkCodec(tokenizer_path("piece_bpe_32k.model")).model
    for r in got:
        assert r.piece_ids == pieces.encode(r.text or "") and r.n_tokens == len(r.piece_ids) and r.n_chars == len(r.text or "")
        assert r.decoded == pieces.decode(r.piece_ids)
