"""Small tables with odd rows, each operator against a plain version of itself."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from featshift.llm import cap_filters, decontaminate, line_dedup, minhash, pieces, ppm, quality, suffix_dedup, token_counts, warc
from featshift.llm.links import components
from featshift.llm.queries import QUERIES, tokenizer_path
from featshift.storage import fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_tokens string, component_id string"
PIECES = "piece_bpe_32k.model"


def _texts() -> list[str | None]:
    rng = random.Random(5)
    words = ["".join(rng.choice(["an", "tor", "ü", "is", "qu", "e"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    near = [" ".join(w if k != 30 else "changed" for k, w in enumerate(b.split())) for b in base[:4]]
    lines = "\n".join([base[0], base[1], "", "one two three", base[0]])
    return [None, "", " ", "\n", "a", "a b", *base, *near, base[5], base[5], lines, "x" * 900, base[2] * 40, "Ünï ▁ \x00 日本 <s>", "A b C. d"]


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    found = [(k, t, None if k % 5 == 0 else "en", None if k % 3 == 0 else "src", None, "old", "old", "old") for k, t in enumerate(texts)]
    return [*found, found[8], (None, texts[9], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    label = list(range(80))
    for _ in range(80):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(components(spark.createDataFrame(pairs, "u long, v long")).collect())
    assert got == {x: label[x] for p in pairs if p[0] != p[1] for x in p}


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(60):
        text = rng.integers(0, 3, rng.integers(1, 90)).astype(np.uint8)
        raw = text.tobytes()
        assert suffix_dedup.suffix_array(text).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        valid = np.arange(len(raw)) + 9 <= len(raw)
        counts = Counter(raw[i : i + 9] for i in range(len(raw) - 8))
        assert suffix_dedup.repeated_starts(text, valid, 9).tolist() == [bool(v) and counts[raw[i : i + 9]] > 1 for i, v in enumerate(valid)]


@pytest.mark.parametrize("shard_bytes", [600, 1 << 20])
def test_suffix_dedup(spark, docs, rows, empty, monkeypatch, shard_bytes):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard_bytes)
    length = 40
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    counts = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    want = []
    for key, b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if counts[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((key, len(b), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1)), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs, length).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_ppm(docs, rows, empty):
    order, start, end = ppm.ORDER, ppm.START, ppm.END
    counts: dict[tuple, Counter] = {}
    words, trained = Counter(), F.col("doc_id") % 4 != 0
    split = {k: [*(r[1] or "").encode().translate(bytes(ppm.LOWER)).split(), None] for k, r in enumerate(rows)}
    for k, r in enumerate(rows):
        if r[0] is not None and r[0] % 4:
            words.update(split[k])
            s = [start] * order + list((r[1] or "").encode()) + [end]
            for p in range(order, len(s)):
                for n in range(order + 1):
                    counts.setdefault(tuple(s[p - n : p]), Counter())[s[p]] += 1
    total = sum(words.values())

    def score(text: bytes) -> float:
        s, out = [start] * order + list(text) + [end], 0.0
        for p in range(order, len(s)):
            ruled: set = set()
            for n in range(order, -1, -1):
                seen = {a: c for a, c in counts.get(tuple(s[p - n : p]), {}).items() if a not in ruled}
                if s[p] in seen:
                    out += math.log10((seen[s[p]] - 0.5) / sum(seen.values()))
                    break
                if seen:
                    out += math.log10(0.5 * len(seen) / sum(seen.values()))
                    ruled |= seen.keys()
            else:
                out -= math.log10(257 - len(ruled))
        return out

    want = sorted((str(r[0]), len(split[k]), sum(words[w] > 0 for w in split[k]), total, round(sum(math.log10((words[w] + 0.1) / (total + 0.1 * (len(words) + 1))) for w in split[k]), 5), round(score((r[1] or "").encode()), 5)) for k, r in enumerate(rows))
    got = ppm.score_texts(docs.withColumn("use", trained), "use").collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want
    assert ppm.score_texts(empty.withColumn("use", F.lit(True)), "use").count() == 0
    assert ppm.adaptive_score(b"abababababab") > 3 * ppm.adaptive_score(b"abab")


def test_line_dedup(docs, rows, empty):
    seen: list[tuple] = []
    want = []
    for key, text in sorted({(r[0], r[1]) for r in rows if r[0] is not None}):
        kept = []
        for line in (text.split("\n") if text is not None else []):
            words = {w for w in line.lower().encode().split()}
            if not (words and any(5 * len(words & x) >= 4 * len(words | x) for x in seen)):
                kept.append(line)
            seen += [words] if words else []
        want.append((key, None if text is None else "\n".join(kept)))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = out.filter("doc_id is not null").select("doc_id", "text").distinct().collect()
    assert sorted((r[0], r[1]) for r in got if r[1] is not None) == [w for w in want if w[1] is not None]
    assert out.count() == len(rows) and out.filter("doc_id is null").first()["text"] == rows[-1][1]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_long_lines(spark):
    """Lines of up to 300 words that share many of them: the bound by shared prefix words loses no match."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(500)]
    texts: list[str] = []
    for _ in range(30):
        base = rng.sample(words, rng.randint(20, 300))
        copies = [base]
        for share in (0.03, 0.08, 0.1, 0.12, 0.2):
            change = set(rng.sample(range(len(base)), int(share * len(base))))
            copies.append([rng.choice(words) if k in change else w for k, w in enumerate(base)])
        texts += ["\n".join(" ".join(c) for c in copies[:2]), *(" ".join(c) for c in copies[2:])]
    rng.shuffle(texts)
    seen: list[set[str]] = []
    want = {}
    for k, text in enumerate(texts):
        kept = []
        for line in text.split("\n"):
            mine = set(line.split())
            if not any(len(mine & x) * 100 >= len(mine | x) * 80 for x in seen):
                kept.append(line)
            seen.append(mine)
        want[k] = "\n".join(kept)
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_cap_filters(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 16))
    near = base[:10] + 0.1 * rng.normal(size=(10, 16))
    vectors = [*base.tolist(), *near.tolist(), base[3].tolist()]
    data = [(k, [float(x) for x in v], k % 2 if k < 20 else (k - 20) % 2) for k, v in enumerate(vectors)]
    data[-1] = (30, data[3][1], data[3][2])
    odd = [(31, None, 0), (32, [0.0] * 16, 0), (33, [float("nan")] * 16, 0), (34, [None] + [1.0] * 15, 1), (35, data[0][1], None), (None, data[0][1], 0), (36, [], 0), data[5]]
    names = ["id", "vec", "dim", "signs", "filters", "component_id"]  # columns of the same names as those in between stay out of the way
    frame = spark.createDataFrame([*data, *odd], "vec_id long, embedding array<float>, label int").select("*", *(F.lit("x").alias(c) for c in names))
    got = {r.vec_id: r for r in cap_filters.cosine_groups(frame).collect() if r.vec_id is not None}
    x = np.array([np.float32(v) for _, v, _ in data], dtype=np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([d[2] for d in data])
    linked = (unit @ unit.T >= 0.93) & (labels[:, None] == labels) & ~np.eye(len(x), dtype=bool)
    for k in range(len(data)):
        assert got[k].n_links == linked[k].sum(), k
        assert got[k].kept == (got[k].component_id == k)
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in range(31, 37))
    assert cap_filters.cosine_groups(frame.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [2, 3, 8, 16, 24, 37, 64])
@pytest.mark.parametrize("cosine", [0.93, 0.9])
def test_pairs_share_a_filter(dim, cosine):
    rng = np.random.default_rng(dim)
    x, y = rng.normal(size=(2, 200, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    code = cap_filters.ProductCode(dim, cosine)
    a, b = code.decode(x)[0], code.decode(y)[0]
    assert all(len(np.intersect1d(p, q)) for p, q in zip(a, b, strict=True))
    assert np.mean([len(p) for p in a]) < 1500


def test_warc(spark):
    long = "é<p>" * 60
    pages = [(1, "http://a\r\nb", long), (2, None, long), (3, "u%0A", ""), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (7, "u", "b" * 70000), (None, "u", long)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = fresh_path(spark, "warc-test")
    assert warc.write_archives(frame, folder, "page_id", "url", "html").agg(F.sum("n_records")).first()[0] == len(pages)
    got = {r.record_id: r for r in warc.read_archives(spark, folder).collect()}
    assert got["1"].target_uri == "http://a\r\nb" and got["1"].payload.decode() == long and got["2"].target_uri is None
    assert got["2"].record_type == "revisit" and got["2"].refers_to == "1" and got["2"].payload_digest == hashlib.sha256(long.encode()).hexdigest()
    assert {k for k, r in got.items() if r.record_type == "response"} == {"1", "3", "4", "5", "6", "7", ""}
    assert got["4"].payload == b"" and got["7"].payload_bytes == 70000


def test_warc_damage():
    member = warc.record_bytes("1", "u", b"hello" * 50, None)
    assert next(warc.read_records(io.BytesIO(member)))["payload"] == b"hello" * 50
    changed = gzip.compress(gzip.decompress(member).replace(b"hello", b"jello", 1))
    for bad in (member[:-9], changed, gzip.compress(gzip.decompress(member) + b"x"), b"plain text"):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_records(io.BytesIO(member + bad)))


def test_decontamination(spark, docs, rows, empty):
    item = " ".join(rows[7][1].split()[5:25]).encode().upper().decode()
    items = spark.createDataFrame([(1, item), (2, "A, b!"), (3, None), (4, "..."), (None, "a"), (1, item)], "item_id long, text string")
    summary, _ = decontaminate.contamination(docs, items)
    got = {r.doc_id: r for r in summary.collect()}
    assert got[7].n_hit == 20 and got[7].item_ids == ["1"] and got[5].n_hit == 2 and got[5].item_ids == ["2"]
    assert not got[0].contaminated and got[0].n_words == 0 and got[len(_texts()) - 1].n_hit == 2
    assert decontaminate.contamination(empty, items)[0].count() == 0
    assert decontaminate.contamination(docs, items.limit(0))[0].filter("contaminated").count() == 0


def test_pieces(docs, rows, empty):
    path = tokenizer_path(PIECES)
    model = pieces.ChunkCodec(path, table_rows=50).model
    got = pieces.encode_pieces(docs, path, decoded="back").select("doc_id", "text", "piece_ids", "back").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = model.encode(r.text or "")
        assert r.piece_ids == ids and r.back == model.decode(ids)
    assert pieces.encode_pieces(docs, path, digests=True).columns.count("n_tokens") == 1
    assert pieces.encode_pieces(empty, path).count() == 0


def test_token_counts(docs, rows, empty):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    vocabulary = set(token_counts.read_ranks(path))

    def greedy(word: bytes) -> int:
        n = 0
        while word:
            k = next(k for k in range(min(len(word), 64), 0, -1) if word[:k] in vocabulary) if len(word) > 1 else 1
            word, n = word[k:], n + 1
        return n

    for r in token_counts.count_tokens(docs, path).collect():
        data = np.frombuffer((r.text or "").encode(), dtype=np.uint8)
        starts, ends, _ = token_counts.marked_words(data, np.array([0, len(data)]))
        assert b"".join(data[a:z].tobytes() for a, z in zip(starts, ends, strict=True)) == data.tobytes()
        if len(data) < 3000:
            assert r.n_tokens == sum(greedy(data[a:z].tobytes()) for a, z in zip(starts, ends, strict=True))
    assert token_counts.count_tokens(empty, path).count() == 0


def test_minhash(docs, rows, empty):
    sets = {}
    for key, text, *_ in rows:
        words = (text or "").lower().split() if key is not None else []
        sets[key] = {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set()
    label = {k: k for k in sets if k is not None}
    for _ in label:
        for a in label:
            for b in label:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = minhash.near_duplicates(docs, 3, 85).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.kept) == ((label[r.doc_id], label[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))
        assert r.doc_id is None or r.n_shingles == len(sets[r.doc_id])
    assert minhash.near_duplicates(empty, 3, 85).count() == 0


def test_minhash_prefix_path(docs, monkeypatch):
    want = sorted(map(str, minhash.near_duplicates(docs, 3, 80).collect()))
    monkeypatch.setattr(minhash, "OUTSIDE", 0)
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    assert sorted(map(str, minhash.near_duplicates(docs, 3, 80).collect())) == want
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, 3, 79)


def _thue_morse(n: int) -> tuple[str, str]:
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_without_a_common_letter_are_told_apart(spark):
    x, y = _thue_morse(1024)
    frame = spark.createDataFrame([(1, x, True), (2, y, False), (3, f"{x}\n{y}", False)], "doc_id long, text string, use boolean")
    assert sorted(r.component_id for r in minhash.near_duplicates(frame, 3, 85).collect()) == [1, 2, 3]
    known = {r.doc_id: r.n_known for r in ppm.score_texts(frame, "use").collect()}
    assert known == {1: 2, 2: 1, 3: 2}
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame, tokenizer_path("byte_bpe_50k.tiktoken")).collect()}
    assert counts[3] == counts[1] + counts[2] + 1


def test_quality(spark, sf_dir, empty):
    build = next(q.build for q in QUERIES if q.name == "op10_quality")
    scored = build(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.9
    labels = spark.createDataFrame([(None, 1), (3, None), (7, 1), (8, 0)], "doc_id long, quality int")
    model = quality.fit_quality(empty, labels.limit(0))
    out = quality.score_quality(spark.createDataFrame([(1, None, "x"), (2, "", "y")], "doc_id long, text string, predicted string"), model)
    assert [f.dataType for f in out.schema.fields][-2:] == [T.DoubleType(), T.IntegerType()]
    assert all(0 <= r.score <= 1 for r in out.collect())


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "stage")
        n = docs.count()
        assert 0 < n and (before is None or n <= before), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
        before = n
    model = pieces.ChunkCodec(tokenizer_path(PIECES)).model
    assert all(r.piece_ids == model.encode(r.text) for r in docs.collect())
    near = minhash.near_duplicates(docs, 5, 80)
    assert near.filter("not kept").count() == 0


def test_pipeline_odd_rows(docs, empty, spark, sf_dir):
    for frame in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, frame, sf_dir)
            assert out.count() <= frame.count()


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_decontamination_against_brute_force(spark, monkeypatch, most):
    """Broadcast and shuffled windows find the same words, in long texts, at both ends and with ties."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdEF"), n)) for n in (0, 1, 3, 9, 40, 40, 3000)] + [None, "a-b, A b!", "\u00e9 a"]
    wanted = ["a b c d", "a b", "E", "", None, " ".join(texts[4].split()[:7]), " ".join(texts[6].split()[-5:]), "a b"]
    size = 4

    def runs(text):
        return [w.lower() for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")]

    windows = {}
    for k, text in enumerate(wanted):
        found = runs(text)
        for at in range(max(1, len(found) - size + 1) if found else 0):
            windows.setdefault(tuple(found[at : at + size]), set()).add(str(k))
    want = {}
    for k, text in enumerate(texts):
        found, hit, named = runs(text), set(), set()
        for window, names in windows.items():
            for at in range(len(found) - len(window) + 1):
                if tuple(found[at : at + len(window)]) == window:
                    hit |= set(range(at, at + len(window)))
                    named |= names
        want[k] = (len(found), len(hit), sorted(named))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("window", F.lit(1))
    items = spark.createDataFrame(list(enumerate(wanted)), "item_id long, text string")
    got = decontaminate.contamination(docs, items, size=size)[0].collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in got} == want and len(got) == len(texts)


def _shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_line_dedup_leaves_no_shuffles(spark):
    """What its steps shuffled goes with them, however long the driver collects no garbage."""
    texts = [(k, f"one line of {k % 7}\nand another of {k}\nwords {k} words") for k in range(200)]
    before = _shuffle_files(spark)
    out = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    assert not _shuffle_files(spark) - before
    assert out.count() == 200


def test_line_dedup_plans_stay_short(spark):
    """The driver keeps the text of every plan, and each has the ranks of all word classes."""
    lines = spark.range(200_000).select(F.concat_ws(" ", "id", F.col("id") % 2, F.lit("c")).alias("line"))
    plan = lines.select(line_dedup._ordered(F.col("line"), line_dedup._rarity(lines)).alias("words"))
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 4 * line_dedup.CLASSES


def test_line_dedup_pairs_no_long_lines_that_differ(spark, monkeypatch):
    """Long lines of the same few words meet by them, but are not sent on as pairs, and the shares lose none."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    lines = [" ".join(draw.sample(words, n)) for n in (90, 120, 150, 180, 230, 300) for _ in range(20)]
    near = [" ".join([*line.split(" ")[:-2], "other"]) for line in lines[::7]]
    rows = spark.createDataFrame(list(enumerate([*lines, *near])), "doc_id long, text string")
    behind, joined = line_dedup._behind, []

    def seen(met, open_, x, after, percent):
        joined.append(open_.join(x, "token").filter(after & line_dedup._possible(percent)[0]).select("doc", "no", "xdoc", "xno").distinct().count())
        return behind(met, open_, x, after, percent)

    monkeypatch.setattr(line_dedup, "_behind", seen)
    for shares in (1, 4):
        monkeypatch.setattr(line_dedup, "SHARES", shares)
        got = line_dedup.dedup_lines(rows).filter("n_removed > 0").select("doc_id").collect()
        assert sorted(r["doc_id"] for r in got) == list(range(len(lines), len(lines) + len(near)))
    assert max(joined) <= 2 * len(near)
