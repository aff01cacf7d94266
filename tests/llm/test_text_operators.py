"""Dedup, SimHash, quality, mixing against brute force, with awkward inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from tabloom.llm import common, exact_dedup, mixing, quality, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, texts, source=None):
    rows = [(i, t, "en", (source(i) if source else f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = ["a b", "a  b", "a\t\nb", None, "", " ", "x" * 200_000, "é ü", "é ü", "a b", "a\x0bb", "A b"]


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(spark, digest_bytes):
    texts = AWKWARD + [f"t{i % 40}" for i in range(300)] + ["hot"] * 200
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    group = defaultdict(list)
    for i, t in enumerate(norm):
        group[t].append(i)
    want = {(i, min(group[t]), len(group[t]), min(group[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)}
    docs = corpus(spark, texts).repartition(5)
    got = exact_dedup.exact_dedup(docs, fan_in=2, digest_bytes=digest_bytes)
    assert {tuple(r) for r in got.collect()} == want
    kept = exact_dedup.dedup_documents(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in group.values())


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(corpus(spark, ["x"]).where("false")).count() == 0
    odd = spark.createDataFrame([(None, "x", 1, "d"), (3, "x", 2, "d"), (3, "x", 2, "d"), (None, "y", 3, "d")], "doc_id long, text string, keep_id long, digest string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd).collect()), key=repr)
    assert got == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, None, 1, True)], key=repr)


def test_digest_lookup_and_filter_size(spark):
    index = exact_dedup.DigestIndex(spark)
    for part in (["a b", "c"], ["a  b", "d"]):
        index.append(corpus(spark, part))
    sha = hashlib.sha256(b"a b").hexdigest()
    assert [(r["doc_id"], r["text_sha256"]) for r in index.find(sha).collect()] == [(0, sha), (0, sha)]
    assert index.find(hashlib.sha256(b"x").hexdigest()).count() == 0
    assert [exact_dedup.filter_words(n) for n in (0, 4095, 4096, 10**6, 10**12)] == [1 << 10, 1 << 10, 1 << 11, 1 << 18, 1 << 19]


def test_exact_dedup_reads_texts_in_short_batches(spark, tmp_path):
    """A reader's arrays for 4,096 texts are what made executors' heaps grow; a size that the user set stays."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    corpus(spark, [f"t{i % 900}" for i in range(2_000)]).coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    try:
        for choice, batches in ((None, 8), ("1000", 2)):
            spark.conf.unset(key) if choice is None else spark.conf.set(key, choice)
            assert exact_dedup.exact_dedup(docs).where("kept").count() == 900
            read = docs.select("text")
            assert len(read.collect()) == 2_000
            assert read._jdf.queryExecution().executedPlan().child().metrics().apply("numInputBatches").value() == batches
    finally:
        spark.conf.unset(key)


def test_hot_keys_join_like_others(spark):
    from tabloom.llm.common import join_counted

    rows = spark.createDataFrame([(0 if i < 3000 else i % 700, i) for i in range(6000)], "k long, i long")
    groups = rows.where("k <> 5").groupBy("k").count()
    got = join_counted(rows, groups, "k", "count", 6000)
    n = Counter(r["k"] for r in rows.collect())
    assert n[0] > 1024
    assert sorted((r["k"], r["i"], r["count"]) for r in got.collect() if r["k"] != 5) == sorted((r["k"], r["i"], n[r["k"]]) for r in rows.collect() if r["k"] != 5)
    assert {r["count"] for r in got.where("k = 5").collect()} == {None} and got.count() == 6000


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, d):
    top = list(range(len(fps)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near_texts():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(200)]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            copy[rng.randrange(200)] = "changed"
            out.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return out


@pytest.mark.parametrize("max_bucket", [1 << 20, 2])
def test_near_duplicates_equal_brute_force(spark, max_bucket):
    texts = near_texts() + [None, "", " \n", "one", "one two three", "One two three", "É x", "one two three four five"] + ["same text here again now"] * 30
    fps = [brute_fingerprint(t) for t in texts]
    want = {(i, f"{fp:016x}", c) for i, (fp, c) in enumerate(zip(fps, brute_components(fps, 4)))}
    docs = corpus(spark, texts)
    assert {tuple(r) for r in simhash.near_duplicates(docs, max_bucket=max_bucket).collect()} == want
    if max_bucket > 2:
        assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted({c for _, _, c in want})
        assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_variants_and_forests():
    assert simhash.segments(4) == [(0, 21), (21, 21), (42, 22)]
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & ((1 << 64) - 1) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    links = simhash.spanning(np.array(fps, np.uint64).view(np.int64), 4)
    assert len(links) < len(fps)
    at = {fp: i for i, fp in enumerate(fps)}
    top = list(range(len(fps)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        i, j = find(at[a]), find(at[b])
        top[max(i, j)] = min(i, j)
    assert [find(i) for i in range(len(fps))] == brute_components(fps, 4)


def brute_failures(text):
    """The bits of the ledger by the published rules."""
    text = text or ""
    words, word_chars, symbols, dup, repeated = brute_measures(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0d]", x)) for x in text.split("\n"))
    letters, upper = sum(c.isalpha() for c in text), sum(c.isupper() for c in text)
    odd_length = words > 0 and not 2 <= word_chars / words <= 15
    rules = [words < 50, repeated / max(words, 1) > 0.5, symbols / max(words, 1) > 0.3 if words else symbols > 0, 2 * dup > lines, odd_length, 2 * upper > letters, 2 * letters < word_chars]
    return sum(1 << k for k, bad in enumerate(rules) if bad)


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality(spark):
    rng = random.Random(3)
    texts = [*AWKWARD, "a b c a b c a", "x\nx\nx\ny", "W# o|d", *(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 90))) for _ in range(40)), "GOOD " * 80, *(" ".join(f"word{rng.randrange(500)}" for _ in range(70)) + "\nend" for _ in range(10))]
    docs = corpus(spark, texts)
    book = quality.ledger(docs)
    rows = {r["doc_id"]: r for r in book.collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for i, t in enumerate(texts):
        want = brute_measures(t)
        assert tuple(rows[i][c] for c in names) == want, repr(t)[:80]
        assert rows[i]["failed"] == brute_failures(t)
        assert bool(rows[i]["failed"] & 3) == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    report = {r["doc_id"]: r for r in quality.quality_report(docs).collect()}
    kept = {i for i, r in report.items() if r["kept"]}
    assert all(not report[i]["base_failed"] for i in kept) and kept
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == kept
    clash = docs.withColumns({"failed": docs.doc_id, "n_words": docs.doc_id, "row": docs.text})
    good = quality.keep_good(clash)
    assert good.columns == clash.columns and {r["doc_id"]: (r["failed"], r["n_words"], r["row"]) for r in good.collect()} == {i: (i, i, texts[i]) for i in kept}
    key = lambda r: r["bit"]
    assert sorted(quality.ablation(quality.stored_ledger(docs)).collect(), key=key) == sorted(quality.ablation(book).collect(), key=key)
    for r in quality.ablation(book).collect():
        bit = 1 << r["bit"]
        assert r["failed_rows"] == sum(bool(x["failed"] & bit) for x in rows.values())
        assert r["only_this_rule"] == sum(x["failed"] == bit for x in rows.values())
        assert r["kept_without_it"] == sum(x["failed"] & ~bit == 0 for x in rows.values())
    assert quality.quality_report(docs.where("false")).count() == 0


def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, total, out = set(order), 1.5 * sum(sizes.values()), {}
    while left:
        unit = total / sum(w[s] for s in left)
        over = {s for s in left if unit * w[s] > 2 * sizes[s] + 1e-9}
        if not over:
            out.update({s: unit * w[s] for s in left})
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            total -= out[s]
        left -= over
    return out


def test_mixing(spark):
    rng = random.Random(9)
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(900)] + [None, "", "x\x0by"]
    src = lambda i: "hot" if i % 3 == 0 else (None if i % 17 == 0 else f"s{i % 5}")
    docs = corpus(spark, texts, src)
    size = [len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for t in texts]
    sizes = Counter()
    for i, n in enumerate(size):
        sizes[src(i)] += n
    want = brute_targets(sizes)
    got = {r["doc_id"]: r for r in mixing.mix(docs, block_docs=32, fan_in=3).collect()}
    assert len(got) == len(texts)
    taken = Counter()
    for i, r in got.items():
        assert r["size"] == size[i] and r["source_size"] == sizes[src(i)]
        assert abs(r["target"] - want[src(i)]) < 1e-6
        assert r["taken"] in (0, size[i], 2 * size[i])
        taken[src(i)] += r["taken"]
    assert all(abs(taken[s] - t) <= 60 for s, t in want.items())
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7), block_docs=32, fan_in=3).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    out = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    whole = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert all(out[i] == (1 if not size[i] else whole[i]["taken"] // size[i]) for i in whole)
    assert mixing.mix(docs.where("false")).count() == 0


def test_stages_decide_by_row(spark):
    base = [" ".join(f"w{k}x{i}" for i in range(80)) for k in range(5)]
    near = base[1] + " end"
    odd = [(1, base[0]), (5, base[0]), (5, base[1]), (5, base[1]), (None, base[0]), (None, base[2]), (None, base[3]), (None, base[3]), (None, near), (6, base[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in odd], DOCS).repartition(3)
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    once = [(1, base[0]), (5, base[1]), (None, base[2]), (None, base[3]), (6, base[4])]
    assert texts(exact_dedup.dedup_documents(docs)) == sorted([*once, (None, near)], key=repr)
    assert brute_components([brute_fingerprint(t) for t in (*base, near)], 4) == [0, 1, 2, 3, 4, 1]
    assert texts(simhash.keep_one(docs)) == sorted(once, key=repr)


def test_mixed_documents_repeat_each_row_by_its_own_copies(spark):
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else i // 4, f"t{i} " + "w " * rng.randint(1, 30), "en", f"s{i % 2}", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["source"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r["source"]] += len(r["text"].split())
    assert all(abs(got[s] - n) <= 40 for s, n in want.items())
    assert set(got) == set(want)


def test_pivot_keeps_mass_and_probabilities():
    rng = np.random.default_rng(0)
    w = rng.integers(1, 50, 40).astype(float)
    total, ones = [], np.zeros(40)
    for k in range(400):
        p = np.full(40, 0.3)
        left = mixing.pivot(p, w, np.random.default_rng(k))
        assert abs((p * w).sum() - 0.3 * w.sum()) < 1e-6
        assert all(x in (0, 1) for i, x in enumerate(p) if i != left)
        ones += p
        total.append(p.sum())
    assert np.abs(ones / 400 - 0.3).max() < 0.12


def test_rows_of_a_parquet_table_are_known_by_their_places(spark, tmp_path):
    rows = [(i % 7 or None, f"text {i % 40}", f"a{i}", f"b{i}", f"c{i}", i) for i in range(200)]
    made = spark.createDataFrame(rows, "doc_id long, text string, __gone string, __row string, `all` string, _metadata int")
    made.repartition(5).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    keys = docs.select(common.row_key(docs).alias("k"), F.col("_metadata").alias("i"))
    first = {bytes(r["k"]): r["i"] for r in keys.collect()}
    assert len(first) == 200 and {bytes(r["k"]): r["i"] for r in keys.repartition(3).collect()} == first
    assert common.row_key(made) is None and common.row_key(docs.select("text")) is None
    for table in (docs, made):
        kept = exact_dedup.dedup_documents(table)
        got = kept.collect()
        assert kept.columns == docs.columns and len({r["text"] for r in got}) == len(got) == 40
        assert all(rows[r["_metadata"]] == tuple(r) for r in got)
        for r in got:
            least = min((x[0] for x in rows if x[1] == r["text"] and x[0]), default=None)
            assert r["doc_id"] == least
