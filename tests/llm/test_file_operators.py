"""Token files, packing, WARC, placement, HTML, toxicity, pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tabloom.llm import bit_packing, bm25_packing, exact_dedup, html_extract, mixing, quality, sharding, simhash, tokens, toxicity, warc
from tests.llm.test_text_operators import DOCS, corpus

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = [None, "", " ", "\n", "a  b", " lead", "trail ", "\nx\n", "don't you're 'stuff", "a\tb c", "É́ é f", "x <|endoftext|> y", "12 345 a1b2", "ΑΣ ΣΑΣ. é b", "a \n b", "\x1c a", "a.\n\nB", "word!!! x, y.. Zé., 3%%% .,", "İI ı", "x" * 5000, "日本語 テキスト。"]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", ",", "\nNew"]) for _ in range(rng.randint(0, 300))) for _ in range(n)]


#: Texts with added tokens, and capitals whose mark composes with the small letter only.
SPECIAL = ["x <|endoftext|> y", "a<|startoftext|>b <|endoftext|>", "<|ENDOFTEXT|> <| endoftext", "H\u0331 J\u030c T\u0308 W\u030a Y\u030a", "\u0130stanbul K\u00aa \u00ba", "a!!!!!!!!! b?,.! c:;"]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_encoder_equals_library(name):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path(name)
    t = Tokenizer.from_file(path)
    texts = ODD + SPECIAL + random_texts(60)
    got = [x.tolist() for x in tokens.encode_column(pa.array(texts, pa.string()), path)]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("width", [1, 7, 15, 16, 17, 31, 32])
def test_bits_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 5000):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        data = bit_packing.pack_bits(ids, width)
        assert len(data) == -(-n // 64) * 8 * width
        assert (bit_packing.unpack_bits(data, width, n) == ids).all()


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50257, n).astype(np.uint16) for n in (1, 5, 700_000, 3, 9000)]
    w = bit_packing.Writer(open(tmp_path / "f", "wb"), 16)
    for i, d in enumerate(docs):
        w.add(i, d)
    w.close()
    whole = np.concatenate(docs)
    with open(tmp_path / "f", "rb") as f:
        r = bit_packing.Reader(f, (tmp_path / "f").stat().st_size)
        assert r.n == len(whole)
        for a, b in ((0, 1), (4090, 4100), (0, r.n), (r.n - 1, r.n), (600_000, 600_001), (5, 5)):
            assert (r.ids(a, b) == whole[a:b]).all()
        assert [(d, s, len(x)) for d, s, x in r.documents()] == [(i, sum(map(len, docs[:i])), len(d)) for i, d in enumerate(docs)]


def expected_ids(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark):
    texts = ODD + SPECIAL + random_texts(80)
    docs = corpus(spark, texts).repartition(3)
    ids = expected_ids(BYTE, texts)
    got = sorted(tuple(r) for r in bit_packing.encode_and_read_back(docs, tokens.tokenizer_path(BYTE)).collect())
    start = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    assert got == [(i, start[i], len(x), crc(x)) for i, x in enumerate(ids)]
    assert bit_packing.encode_and_read_back(docs.where("false"), tokens.tokenizer_path(BYTE)).count() == 0


def check_pieces(rows, ids_of, window):
    """Every id in one piece, sequences gapless, padding only where allowed."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        ids = ids_of[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) and r["length"] > 0
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids)
    for spans in by_seq.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= window and at & (at - 1) == 0  # no padding at all
    return by_seq


def test_packing(spark):
    texts = ODD + random_texts(150) + ["same words in every copy"] * 40 + [" ".join(random_texts(30, 8))]
    ids = dict(enumerate(expected_ids(WORD, texts)))
    docs = corpus(spark, texts)
    rows = bm25_packing.pack_documents(docs, tokens.tokenizer_path(WORD), window=512, shard_docs=50).collect()
    check_pieces(rows, ids, 512)
    assert bm25_packing.pack_documents(docs.where("false"), tokens.tokenizer_path(WORD)).count() == 0


@pytest.mark.parametrize("dtype, top, docs", [("<u2", 1 << 16, 40), ("<u4", 1 << 18, 40), ("<u2", 50, 70_000)])
def test_postings_equal_brute_force(dtype, top, docs):
    rng = np.random.default_rng(3)
    flat, sizes = rng.integers(top - 30, top, 100_000).astype(dtype), rng.multinomial(100_000, np.full(docs, 1 / docs))
    term, doc, tf = bm25_packing.postings(flat, sizes)
    want = sorted(Counter(zip(flat.tolist(), np.repeat(np.arange(docs), sizes).tolist())).items())
    assert list(zip(zip(term.tolist(), doc.tolist()), tf.tolist())) == want
    assert bm25_packing.postings(flat[:0], np.array([0]))[0].tolist() == []
    np.bincount(term), np.bincount(doc)


def test_packing_memory():
    """The index of a shard takes few bytes an id, and what encoding remembered is gone before packing."""
    import tracemalloc

    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 40_000, 2_000).astype(np.uint16) for _ in range(500)]
    tracemalloc.start()
    bm25_packing.Shard(docs, np.ones(1 << 16, np.float32), 2_000.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * sum(map(len, docs))
    enc = tokens.encoder(tokens.tokenizer_path(WORD))
    enc.encode(pa.array(["some words to remember"]))
    assert enc.known
    list(bm25_packing._frequencies([pa.RecordBatch.from_pydict({"ids": pa.array([docs[0].tobytes()])})], "<u2", enc.vocab))
    assert not enc.known


def test_bm25_scores_equal_brute_force():
    rng = random.Random(2)
    docs = [np.array([rng.randrange(40) for _ in range(rng.randint(1, 60))], np.uint16) for _ in range(30)]
    df = Counter(t for d in docs for t in set(d.tolist()))
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    idf = np.array([max(0, np.log((n - df[t] + 0.5) / (df[t] + 0.5))) for t in range(40)], np.float32)
    shard = bm25_packing.Shard(docs, idf, mean)
    for seed in (0, 7, 29):
        want = np.zeros(n)
        for t in set(docs[seed].tolist()):
            for j, d in enumerate(docs):
                tf = (d == t).sum()
                want[j] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) if tf else 0
        assert np.allclose(shard.scores(seed), want, atol=1e-4)


def test_neighbours_share_windows():
    docs = [np.full(100, k % 4 + 1, np.uint16) for k in range(16)]
    idf = np.ones(10, np.float32)
    pieces = bm25_packing.pack_shard(docs, idf, 100.0, 256)
    topics = defaultdict(set)
    for d, _, _, q, _ in pieces:
        topics[q].add(d % 4)
    assert sum(len(t) == 1 for t in topics.values()) >= 4


PAGES = "page_id long, url string, html string"


def test_warc(spark):
    rows = [(i, f"http://x/{i}", f"<p>page {i} é</p>" * (i % 7)) for i in range(300)] + [(300, None, None), (301, "", "x" * 300_000), (5, "dup", "d")]
    pages = spark.createDataFrame(rows, PAGES)
    got = warc.write_and_audit(pages, warc.flip_some).collect()
    assert Counter((r["page_id"], r["record_bytes"]) for r in got) == Counter((p, len(warc.record(p, u, h))) for p, u, h in rows)
    assert {r["page_id"] for r in got if not r["intact"]} == {13, 110, 207}
    assert all(r["intact"] for r in warc.write_and_audit(pages).collect())
    assert warc.write_and_audit(pages.where("false")).count() == 0
    fields, body = warc.parse(warc.record(7, "u", "<p>é"))
    assert body.decode() == "<p>é" and fields["content-length"] == "5"


def test_audit_descends_to_lost_and_broken_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(200)], PAGES)
    folder = "file://" + str(tmp_path / "w")
    manifest = warc.write_warc(pages, folder, 2)
    assert warc.order_check(manifest).count() == 0
    rows = sorted(manifest.collect(), key=lambda r: (r["file"], r["seq"]))
    one = [r for r in rows if r["file"] == rows[0]["file"]]
    path = tmp_path / "w" / one[0]["file"]
    data = bytearray(path.read_bytes())
    data[one[50]["offset"] + 12] ^= 0xFF
    path.write_bytes(bytes(data))
    bad = {(r["file"], r["seq"]) for r in warc.fixity(manifest, warc.scan_warc(manifest, folder), 4).collect() if not r["intact"]}
    assert (one[50]["file"], one[50]["seq"]) in bad and all(f == one[0]["file"] and s >= one[50]["seq"] for f, s in bad)


def test_audit_names_exactly_the_damaged_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * (i % 9)) for i in range(200)], PAGES)
    folder = "file://" + str(tmp_path / "w")
    manifest = warc.write_warc(pages, folder, 2)
    rows = sorted(manifest.collect(), key=lambda r: (r["file"], r["seq"]))
    one = [r for r in rows if r["file"] == rows[0]["file"]]
    path = tmp_path / "w" / one[0]["file"]
    bad = lambda: {(r["file"], r["seq"]) for r in warc.fixity(manifest, warc.scan_warc(manifest, folder), 4).collect() if not r["intact"]}
    key = lambda *at: {(one[0]["file"], one[k]["seq"]) for k in at}
    data = bytearray(path.read_bytes())
    data[one[50]["offset"] + 12] ^= 0xFF
    path.write_bytes(bytes(data))
    assert bad() == key(50)
    data[one[20]["offset"]] ^= 1  # the gzip mark
    data[one[30]["offset"] + one[30]["length"] - 8] ^= 1  # the checksum
    path.write_bytes(bytes(data[: one[-2]["offset"] + 5]))  # and the end cut off
    assert bad() == key(20, 30, 50, len(one) - 2, len(one) - 1)
    path.write_bytes(bytes(data) + warc._gz(b"foreign"))
    found = warc.scan_warc(manifest, folder)
    assert [r["record_bytes"] for r in found.where(f"file = '{one[0]['file']}' AND seq >= {len(one)}").collect()] == [7]
    assert bad() == key(20, 30, 50)


def test_planted_fault_is_in_the_file(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "a" * 5000 if i % 2 else f"page {i}") for i in range(120)], PAGES)
    manifest = warc.write_warc(pages, "file://" + str(tmp_path / "w"), 1, warc.flip_some)
    unsound = set()
    for r in manifest.collect():
        with open(tmp_path / "w" / r["file"], "rb") as f:
            f.seek(r["offset"])
            if warc._unpacked(f.read(r["length"])) is None:
                unsound.add(r["page_id"])
    assert unsound == {13, 110}


def test_placement(spark):
    names = [f"s{i}" for i in range(20)]
    table = sharding.lookup_table(names, 5003)
    counts = np.bincount(table, minlength=20)
    assert counts.max() - counts.min() <= 1
    less = sharding.lookup_table(names[:-1], 5003)
    stay = table != 19
    assert (table[stay] != less[stay]).mean() < 0.15
    df = spark.createDataFrame([(i, "x") for i in range(500)] + [(None, "n")], "k long, v string")
    got = sharding.place(df, "k", names, 5003)
    assert got.columns == ["k", "v", "slot", "shard"] and got.count() == 501
    assert all(names[table[r["slot"]]] == r["shard"] for r in got.collect())
    with pytest.raises(ValueError):
        sharding.place(df.withColumnRenamed("v", "slot"), "k", names)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 5000)


def test_html(spark, sf):
    page = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-banner">We use cookies.</div><article><h1>Head &amp; more</h1><p>First  paragraph\nwith <b>bold</b> text, and more words here.<p>Second one, a bit longer than the first, with words.</article><section class="comments"><p>Great, thanks!</p></section><footer>&copy; Me</footer><script>var a="<p>no</p>"</script></body></html>'
    net = html_extract.labeller()
    got = html_extract.extract([page, None, "", "<p", "no tags at all"], net)
    assert got[0] == "Head & more\nFirst paragraph with bold text, and more words here.\nSecond one, a bit longer than the first, with words."
    assert got[1] == got[2] == ""
    rng = np.random.default_rng(1234)  # pages the training never saw
    hit = wrong = missed = 0
    for _ in range(60):
        made, main = html_extract.sample_page(rng)
        want = {b.text for b in html_extract.blocks(made) if b.text in main}
        have = set(html_extract.extract([made], net)[0].split("\n")) - {""}
        hit, wrong, missed = hit + len(want & have), wrong + len(have - want), missed + len(want - have)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (1, "u", page)], PAGES)
    out = html_extract.main_text(pages).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in out) == [(1, len(got[0])), (1, len(got[0])), (2, 0)]


def test_toxicity(spark):
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choice("alpha beta gamma delta house tree river".split()) for _ in range(60))
    texts, toxic = [], []
    for i in range(400):
        t = clean()
        bad = i % 4 == 0
        if bad:
            t += f" you zorgl{rng.choice(['ab', 'en', 'ik'])} " + clean()
        texts.append(t)
        toxic.append(int(bad))
    texts[7], toxic[7] = None, 0
    docs = corpus(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (999, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) and 0 <= got[i]["score"] <= 1 for i in got)
    assert np.mean([got[i]["predicted"] == toxic[i] for i in held]) > 0.95
    none = toxicity.score_documents(docs, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.score_documents(docs.where("false"), labels).count() == 0


def test_capped_classes_keep_their_share(spark):
    docs = corpus(spark, [f"t{i}" for i in range(600)])
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    _, y, w = toxicity.training_rows(docs, labels, 1500, 3000)
    assert (w == 1).all()
    _, few, v = toxicity.training_rows(docs, labels, 20, 60)
    assert few.sum() == 20 and len(few) == 80
    assert np.isclose(v[few == 1].sum(), y.sum()) and np.isclose(v.sum(), len(y))


def test_weights_are_as_good_as_copies():
    rng = np.random.default_rng(6)
    x, w = rng.integers(0, 9, (300, 2)).astype(float), rng.integers(1, 5, 300)
    y = (rng.random(300) < x[:, 0] / 9).astype(float)
    margin = x[:, 0] + x[:, 1] / 10
    for a, b in zip(toxicity.isotonic(margin, y, w), toxicity.isotonic(np.repeat(margin, w), np.repeat(y, w))):
        assert np.allclose(a, b)
    cut = lambda k: toxicity.Trees(x[:, :1], y, k)
    assert np.isclose(cut(np.where(y == 1, 1.0, 4.0)).start, np.log(y.sum() / (4 * (1 - y).sum())))
    assert np.allclose(cut(None).margin(x[:, :1]), cut(np.ones(300)).margin(x[:, :1]))


def test_isotonic():
    xs, ys = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0, 1, 0, 1, 0, 1]))
    assert (np.diff(ys) >= 0).all() and ys[0] == 0 and ys[-1] == 1


def test_pipeline_equals_its_operators(spark, sf, tmp_path):
    from tests.llm.test_text_operators import brute_components, brute_failures

    docs = spark.read.parquet(sf + "/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {i: r for i, r in rows.items() if not brute_failures(r["text"]) & (quality.POLICIES[quality.CURRENT_POLICY] | 3)}
    first = {}
    for i in sorted(good):
        first.setdefault(" ".join(good[i]["text"].split(" ")) and __import__("re").sub(r"[\x20\x09-\x0d]+", " ", good[i]["text"]), i)
    ids = sorted(first.values())
    fps = [simhash.fingerprint(good[i]["text"]) for i in ids]
    left = sorted({ids[c] for c in brute_components(fps, 4)})
    assert left
    part = docs.where(docs.doc_id.isin(left))
    mix = {r["doc_id"]: r for r in mixing.mix(part).collect()}
    want = Counter({i: mix[i]["copies"] for i in left if mix[i]["copies"]})
    out = corpus_pipeline.run(spark, sf).collect()
    tok = dict(zip(left, expected_ids(WORD, [rows[i]["text"] for i in left])))
    seen = Counter()
    for r in out:
        seen[r["doc_id"]] += r["length"]
    assert dict(seen) == {i: n * len(tok[i]) for i, n in want.items()}
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "bm25_packing" and len(corpus_pipeline.STAGES) == 5
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
    assert exact_dedup.dedup_documents(empty).schema == docs.schema or exact_dedup.dedup_documents(empty).columns == docs.columns
    assert DOCS.split()[0] == docs.columns[0]
