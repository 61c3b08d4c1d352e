"""Language-model scores by prediction by partial matching over bytes, with a model that is never in one place.

The model predicts each byte, and the end of a text, from the bytes before it. The counts of
the longest context that has been seen decide; what it has not seen escapes to the next
shorter one, whose counts leave out the symbols that were already ruled out. The escape
probability is q / 2n for n symbols of q kinds, and a symbol seen c times has (c - 1/2) / n. Pretrained scores use the counts of the
training texts as they are; adaptive ones learn from the text itself as it goes on.

The probability of a symbol depends on its context of at most ``ORDER`` symbols alone. So
every shard of documents sends each distinct string of ``ORDER + 1`` symbols once, with its
count in training texts, to the part of the model that holds all contexts with the same last
two symbols, and gets its log-probability back. Only the counts of single symbols after one
symbol go to every executor: at most 258 * 258 of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featshift.llm.arrays import LOWER, mix, segment_sums, word_hashes
from featshift.llm.shelves import arrow_batches, packed, unpack
from featshift.storage import forget, materialize

ORDER = 5
END, START, KINDS = 256, 257, 258
BITS = 9
#: Text of a shard, and how much of it is worked on at once.
SHARD_BYTES, WORK_BYTES = 12 << 20, 1 << 20
#: Shards whose counts are merged at a time, stored bytes of requests that pass by one copy of a part, and bytes of those looked up at once.
FAN_IN, ASK_BYTES, HELD_BYTES = 256, 64 << 20, 16 << 20
_GRAM = np.int64((1 << BITS * (ORDER + 1)) - 1)
_END_WORD = np.int64(-1)


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of every position, packed in 9 bits each, and where each row's begin.

    A row has one position per byte and one for its end; contexts begin with start symbols.
    """
    rows = len(bounds) - 1
    lengths = np.diff(bounds)
    starts = bounds[:-1] + np.arange(rows) * (ORDER + 1)  # each row as ORDER starts, its bytes, its end
    stream = np.full(len(data) + rows * (ORDER + 1), START, dtype=np.int64)
    at = np.arange(len(data)) + np.repeat(np.arange(rows) * (ORDER + 1) + ORDER, lengths)
    stream[at] = data
    stream[starts + ORDER + lengths] = END
    key = stream[: len(stream) - ORDER].copy()
    for k in range(1, ORDER + 1):
        key = key << BITS | stream[k : len(stream) - ORDER + k]
    inside = np.arange(len(data) + rows) + np.repeat(np.arange(rows) * ORDER, lengths + 1)
    return key[inside], bounds + np.arange(rows + 1)


def _stored(values: np.ndarray) -> bytes:
    """Long numbers byte plane by byte plane, compressed: the upper planes are all zero for small numbers. Their number goes before them."""
    planes = values.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return np.int64(len(values)).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _read(stored: bytes) -> np.ndarray:
    count = int(np.frombuffer(stored[:8], dtype=np.int64)[0])
    planes = pa.decompress(stored[8:], decompressed_size=8 * count, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _stored_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return _stored(np.diff(keys, prepend=np.int64(0)))


def _read_keys(stored: bytes) -> np.ndarray:
    return np.cumsum(_read(stored))


def _stored_values(values: np.ndarray) -> bytes:
    """Doubles as the distinct ones and the number of each."""
    kinds, codes = np.unique(values, return_inverse=True)
    return np.int64(len(kinds)).tobytes() + kinds.tobytes() + _stored(codes)


def _read_values(stored: bytes) -> np.ndarray:
    end = 8 + 8 * int(np.frombuffer(stored[:8], dtype=np.int64)[0])
    return np.frombuffer(stored[8:end], dtype=np.float64)[_read(stored[end:])]


def _part_of(kind: int, keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of each key: strings by the last two symbols of their context, words by themselves."""
    cut = keys >> BITS & np.int64((1 << 2 * BITS) - 1) if kind == 0 else keys
    return (mix(cut.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _keys(kind: int, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings (kind 0) or words and ends (kind 1) of all rows, and where each row's begin."""
    if kind == 0:
        return grams(data, bounds)
    words, firsts = word_hashes(LOWER[data], bounds)
    return np.insert(words.view(np.int64), firsts[1:], _END_WORD), firsts + np.arange(len(firsts))


class Distinct:
    """The distinct keys of a shard, sorted, with the training count of each; ``rows`` sums a value per key over each row.

    Texts are taken about a megabyte at a time, and of all positions only 32-bit codes are held.
    """

    def __init__(self, kind: int, data: np.ndarray, bounds: np.ndarray, trained: np.ndarray | None = None, keep: bool = True):
        found, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        self.pieces: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(bounds) - 1:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + WORK_BYTES, side="right")) - 1)
            keys, first = _keys(kind, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
            codes, kinds = pd.factorize(keys)
            found.append(kinds)
            counts.append(np.bincount(codes, weights=np.repeat(trained[at:end], np.diff(first)), minlength=len(kinds)) if trained is not None else np.zeros(len(kinds)))
            if keep:
                self.pieces.append((codes.astype(np.int32), first))
            at = end
        self.keys, back = np.unique(np.concatenate(found), return_inverse=True)
        self.counts = np.bincount(back, weights=np.concatenate(counts), minlength=len(self.keys)).astype(np.int64)
        self.places = np.split(back, np.cumsum([len(x) for x in found[1:-1]])) if self.pieces else []

    def rows(self, values: np.ndarray) -> np.ndarray:
        sums = [segment_sums(values[place][codes], first) for place, (codes, first) in zip(self.places, self.pieces, strict=True)]
        return np.concatenate(sums) if sums else np.zeros(0, dtype=values.dtype)

    def lengths(self) -> np.ndarray:
        return np.concatenate([np.diff(first) for _, first in self.pieces]) if self.pieces else np.zeros(0, dtype=np.int64)


def _sent(shards: DataFrame, parts: int) -> DataFrame:
    """``(kind, part, shard, keys, counts)``: what each shard tells and asks each part."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data, bounds, more in unpack(batch):
                trained = np.array(more["trained"].as_py(), dtype=np.float64)
                for kind in (0, 1):
                    told = Distinct(kind, data, bounds, trained, keep=False)
                    known, counts = told.keys, told.counts
                    part = _part_of(kind, known, parts)
                    order = np.argsort(part, kind="stable")
                    cuts = np.searchsorted(part[order], np.arange(parts + 1))
                    rows = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    some = [k for k, r in enumerate(rows) if len(r)]
                    yield pa.RecordBatch.from_pydict({
                        "kind": pa.array([kind] * len(some), pa.int32()), "part": pa.array(some, pa.int32()), "shard": pa.array([shard] * len(some), pa.int64()),
                        "keys": pa.array([_stored_keys(known[rows[k]]) for k in some], pa.binary()), "counts": pa.array([_stored(counts[rows[k]]) for k in some], pa.binary()),
                    })

    return shards.mapInArrow(task, "kind int, part int, shard long, keys binary, counts binary")


def _low_counts(sent: DataFrame) -> np.ndarray:
    """Training counts of each symbol after each symbol, summed by Spark: 258 * 258 numbers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 2 * BITS, dtype=np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                np.add.at(total, _read_keys(keys) & np.int64((1 << 2 * BITS) - 1), _read(counts))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": some, "n": total[some]})

    low = np.zeros((1 << BITS, 1 << BITS), dtype=np.int64)
    for pair, n in sent.filter("kind = 0").select("keys", "counts").mapInArrow(task, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        low[pair >> BITS, pair & ((1 << BITS) - 1)] = n
    return low[:KINDS, :KINDS]


def _merge_counts(sent: DataFrame, by: list[str]) -> DataFrame:
    """Sum the counts of equal keys within each group of blocks."""

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = np.concatenate([_read_keys(x) for x in table.column("keys").to_pylist()])
        counts = np.concatenate([_read(x) for x in table.column("counts").to_pylist()])
        seen = counts > 0
        found, back = np.unique(keys[seen], return_inverse=True)
        sums = np.zeros(len(found), dtype=np.int64)
        np.add.at(sums, back, counts[seen])
        values = {k: pa.array([v.as_py()], pa.int32()) for k, v in zip(by, key, strict=True)}
        return pa.table(values | {"keys": pa.array([_stored_keys(found)], pa.binary()), "counts": pa.array([_stored(sums)], pa.binary()), "n_keys": pa.array([len(found)], pa.int64()), "total": pa.array([int(sums.sum())], pa.int64())})

    return sent.groupBy(*by).applyInArrow(merged, ", ".join(f"{k} int" for k in by) + ", keys binary, counts binary, n_keys long, total long")


class Contexts:
    """The contexts of one part, longest first, with what exclusion takes from each."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: np.ndarray):
        self.low = low
        self.levels = []
        above = None
        for k in range(ORDER, 1, -1):
            entry, back = np.unique(keys & np.int64((1 << BITS * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(back, weights=counts, minlength=len(entry))
            context, first = np.unique(entry >> BITS, return_index=True)
            total, kinds = segment_sums(n, np.append(first, len(entry))), np.diff(np.append(first, len(entry)))
            if above is not None:
                self._ruled_out(above, n[np.searchsorted(entry, above["entry"] & np.int64((1 << BITS * (k + 1)) - 1))])
            above = {"k": k, "entry": entry, "n": n, "context": context, "first": np.append(first, len(entry)), "total": total, "kinds": kinds}
            self.levels.append(above)
        if above is not None:
            self._ruled_out(above, low[above["entry"] >> BITS & 511, above["entry"] & 511])
        self.zero = low.sum(axis=0)

    @staticmethod
    def _ruled_out(level: dict, below: np.ndarray) -> None:
        """Count in the next shorter context of all symbols seen in each context of ``level``."""
        level["below"] = segment_sums(below.astype(np.float64), level["first"])

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol of each packed string in its context."""
        out, open_ = np.zeros(len(keys)), np.ones(len(keys), dtype=bool)
        out_total, out_kinds = np.zeros(len(keys)), np.zeros(len(keys))

        def decide(total: np.ndarray, kinds: np.ndarray, count: np.ndarray, at: np.ndarray) -> None:
            total, kinds = total - out_total[at], kinds - out_kinds[at]
            hit = count > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(hit, np.log10((count - 0.5) / total), np.where(kinds > 0, np.log10(0.5 * kinds / total), 0.0))
            out[at] += gain
            open_[at[hit]] = False

        for level in self.levels:
            at = np.flatnonzero(open_)
            entry = keys[at] & np.int64((1 << BITS * (level["k"] + 1)) - 1)
            if not len(at) or not len(level["context"]):
                continue
            c = np.minimum(np.searchsorted(level["context"], entry >> BITS), len(level["context"]) - 1)
            seen = level["context"][c] == entry >> BITS
            at, entry, c = at[seen], entry[seen], c[seen]
            e = np.minimum(np.searchsorted(level["entry"], entry), len(level["entry"]) - 1)
            decide(level["total"][c], level["kinds"][c], np.where(level["entry"][e] == entry, level["n"][e], 0), at)
            out_total[at], out_kinds[at] = level["below"][c], level["kinds"][c]
        for counts, total, kinds, below in self._short(keys):
            at = np.flatnonzero(open_)
            at = at[total[at] > 0]
            decide(total[at], kinds[at], counts[at], at)
            out_total[at], out_kinds[at] = below[at], kinds[at]
        at = np.flatnonzero(open_)
        out[at] -= np.log10(np.maximum(KINDS - 1 - np.count_nonzero(self.zero), 1))
        return out

    def _short(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Count, total, kinds and what they rule out below, for contexts of one symbol and of none."""
        context, symbol = keys >> BITS & 511, keys & 511
        ruled = ((self.low > 0) * self.zero).sum(axis=1)
        yield self.low[context, symbol], self.low.sum(axis=1)[context], (self.low > 0).sum(axis=1)[context], ruled[context].astype(np.float64)
        yield self.zero[symbol], np.full(len(keys), self.zero.sum()), np.full(len(keys), np.count_nonzero(self.zero)), np.zeros(len(keys))


def _answers(sent: DataFrame, model: DataFrame, low: np.ndarray) -> DataFrame:
    """``(shard, kind, part, values)``: log-probabilities of strings, training counts of words.

    A part of the model and what is asked of it meet in one partition, the part first, so that
    requests pass by it one after the other and only some of them are held at a time.
    """
    shared = sent.sparkSession.sparkContext.broadcast(low)

    def word_counts(keys: np.ndarray, counts: np.ndarray, every: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(every))
        at = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
        return np.where(keys[at] == every, counts[at], 0).astype(np.float64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        known, contexts = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), None

        def answered() -> pa.RecordBatch:
            kind, part, _ = now
            every, back = np.unique(np.concatenate([keys for _, keys in held]), return_inverse=True)
            values = contexts.log10(every) if kind == 0 else word_counts(*known, every)
            cuts = np.cumsum([0, *(len(keys) for _, keys in held)])
            found = [_stored_values(values[back[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard for shard, _ in held], pa.int64()), "kind": pa.array([kind] * len(held), pa.int32()),
                "part": pa.array([part] * len(held), pa.int32()), "values": pa.array(found, pa.binary()),
            })

        for batch in batches:
            for k in range(batch.num_rows):
                at = tuple(batch.column(c)[k].as_py() for c in ("kind", "part", "chunk"))
                if at != now or size > HELD_BYTES:
                    if held:
                        yield answered()
                    held, size = [], 0
                keys = _read_keys(batch.column("keys")[k].as_py())
                shard, counts = batch.column("shard")[k].as_py(), batch.column("counts")[k].as_py()
                if at != now:
                    now = at
                    known = (keys, _read(counts)) if shard is None else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
                    contexts = Contexts(*known, shared.value) if at[0] == 0 else None
                if shard is not None:
                    held.append((shard, keys))
                    size += keys.nbytes
        if held:
            yield answered()

    columns = ["kind", "part", "chunk", "shard", "keys", "counts"]
    rows = model.withColumn("shard", F.lit(None).cast("long")).select(*columns).unionByName(sent.withColumn("counts", F.lit(None).cast("binary")).select(*columns))
    rows = rows.repartition("kind", "part", "chunk").sortWithinPartitions("kind", "part", "chunk", F.col("shard").asc_nulls_first())
    return rows.mapInArrow(task, "shard long, kind int, part int, values binary")


def score_texts(docs: DataFrame, trained: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    ``trained`` names a boolean column: the model and the word counts learn from rows where it
    is true (null counts as false). ``score`` is the log10 probability of the whole text and its end.
    ``base_score`` adds log10((c + 0.1) / (N + 0.1 * (V + 1))) over the white-space words, A-Z
    as a-z, and one end. Null texts are empty. Repeated rows are texts of their own. Words are
    told apart by a 64-bit hash.
    """
    shards = packed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(trained), F.lit(False)).alias("trained")), shard_bytes=SHARD_BYTES)
    n_shards = shards.count()
    parts = max(8, int(6 * math.sqrt(n_shards)))
    chunks = n_shards // FAN_IN + 1
    with arrow_batches(docs.sparkSession, SHARD_BYTES):
        sent = materialize(_sent(shards, parts).withColumn("chunk", F.pmod(F.xxhash64("shard"), F.lit(chunks)).cast("int")), "strings")
    low = _low_counts(sent)
    model = _merge_counts(sent.select("kind", "part", "chunk", "keys", "counts"), ["kind", "part", "chunk"])
    while chunks > 1:
        chunks = chunks // FAN_IN + 1 if chunks > FAN_IN else 1
        model = _merge_counts(model.withColumn("chunk", F.pmod("chunk", F.lit(chunks)).cast("int")), ["kind", "part", "chunk"])
    model = materialize(model, "model")
    totals = model.filter("kind = 1").agg(F.sum("n_keys"), F.sum("total")).first()
    n_kinds, n_train = int(totals[0] or 0), int(totals[1] or 0)
    # A part is copied once for every so many bytes asked of it; two rows for each part, whose number grows with the root of the shards.
    load = F.broadcast(sent.groupBy("kind", "part").agg(F.ceil(F.sum(F.octet_length("keys").cast("double")) / ASK_BYTES).cast("int").alias("copies")))
    asked = sent.drop("counts", "chunk").join(load, ["kind", "part"]).withColumn("chunk", F.pmod(F.xxhash64("shard"), F.col("copies")).cast("int")).drop("copies")
    copied = model.select("kind", "part", "keys", "counts").join(load, ["kind", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    answers = _answers(asked, copied, low)
    # Dealt as the shards are kept, so that the join below moves neither side again.
    mine = answers.repartition(shards._buckets, "shard").groupBy("shard").agg(F.collect_list(F.struct("kind", "part", "values")).alias("answers"))
    known = shards.join(mine.hint("shuffle_hash"), "shard", "left")
    floor = math.log10(n_train + 0.1 * (n_kinds + 1))
    kind_of = docs.schema[doc_id].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds, more in unpack(batch):
                values = {(a["kind"], a["part"]): a["values"] for a in more["answers"].as_py() or []}
                found = []
                for kind in (0, 1):
                    held = Distinct(kind, data, bounds)
                    part = _part_of(kind, held.keys, parts)
                    got = np.zeros(len(held.keys))
                    order = np.argsort(part, kind="stable")
                    cuts = np.searchsorted(part[order], np.arange(parts + 1))
                    for k in np.flatnonzero(np.diff(cuts)).tolist():
                        got[order[cuts[k] : cuts[k + 1]]] = _read_values(values[kind, k])
                    if kind == 0:
                        found.append(held.rows(got))
                    else:
                        found += [held.lengths(), held.rows((got > 0).astype(np.int64)), held.rows(np.log10(got + 0.1) - floor)]
                    del held
                score, n_tokens, n_known, base = found
                yield pa.RecordBatch.from_arrays(
                    [more["doc_id"].values, more["trained"].values, pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(score), n_train, dtype=np.int64)), pa.array(base), pa.array(score)],
                    names=["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    scored = known.mapInArrow(task, f"doc_id {kind_of}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    with arrow_batches(docs.sparkSession, SHARD_BYTES):
        scored = materialize(scored, "scores")
    forget(sent, model, shards)
    return scored


def adaptive_score(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one text by a model that starts empty and learns after every symbol."""
    counts: dict[tuple[int, ...], dict[int, int]] = {}
    history: list[int] = [START] * order
    total = 0.0
    for symbol in [*text, END]:
        ruled: set[int] = set()
        for k in range(order, -1, -1):
            seen = {s: c for s, c in counts.get(tuple(history[len(history) - k :]), {}).items() if s not in ruled}
            if symbol in seen:
                total += math.log10((seen[symbol] - 0.5) / sum(seen.values()))
                break
            if seen:
                total += math.log10(0.5 * len(seen) / sum(seen.values()))
                ruled |= seen.keys()
        else:
            total -= math.log10(KINDS - 1 - len(ruled))
        for k in range(order + 1):
            table = counts.setdefault(tuple(history[len(history) - k :]), {})
            table[symbol] = table.get(symbol, 0) + 1
        history = [*history[1:], symbol] if order else history
    return total
