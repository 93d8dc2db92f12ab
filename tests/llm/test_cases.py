"""Odd rows that once went wrong, the registered queries as they are, and whole results against brute force."""

import hashlib
import random
import re
import struct
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import LOWER, WORD, components

from orrery.llm import common, language_id, license_scan, mixing, near_dedup, packing, queries, tiff, toxicity, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- near dedup


def test_links_inside_one_large_bucket(spark):
    """Hundreds of texts that share two thirds of their words, and link only in pairs and threes; no link is lost."""
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(120)]
    rows = []
    for g in range(120):
        own = [f"g{g}w{i}" for i in range(60)]
        for c in range(2 + g % 2):
            words = shared + own
            for _ in range(c):
                words[rng.randrange(125, 180)] = f"x{g}c{c}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    want = components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len({c for _, c in want.values()}) >= 120


@pytest.mark.parametrize("percent, least", [(75, 3), (50, 1), (80, 4), (99, 99), (100, 2**62)])
def test_least_size(percent, least):
    assert near_dedup.least_size(percent) == least


def test_small_sets_at_a_half(spark):
    """Two of three shingles in common."""
    rows = [(0, "a b c d e f"), (1, "a b c d e f g"), (2, "q r s t u v w")]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=50).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_word_longer_than_a_block(spark):
    long = "x" * (3 * near_dedup.BLOCK + 5)
    rows = [(0, f"a b {long} c d e"), (1, f"A b {long.upper()} c d e"), (2, f"a b {long}y c d e")]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_sketches_bound_differences():
    rng = np.random.default_rng(2)
    for n in (1, 10, 1000, 5000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate((a[n // 3 :], rng.integers(0, 2**63, n // 2, dtype=np.uint64)))
        bits = sum(int(x).bit_count() for x in (near_dedup.parity(a) ^ near_dedup.parity(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b)) and not (near_dedup.parity(a) ^ near_dedup.parity(a[::-1])).any()


# --- languages


def test_long_texts_are_parsed_whole():
    rng = random.Random(3)
    data = bytes(rng.choice(b"abc ") for _ in range(3000))
    text = data[100:2900] + b"zz" + data[:2500] + bytes(rng.choice(b"abc ") for _ in range(1500))
    want, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in data:
            n += 1
        want, at = want + 1, at + n
    parser = language_id.Parser([("x", data), ("y", data[::-1])])
    assert parser.phrases([np.frombuffer(x, np.uint8) for x in (b"a", text, b"")])[:, 0].tolist() == [1, want, 0]


def test_no_language_is_left_out(spark):
    """Seventy languages, one of them in one text that is far longer than what is learnt of a text."""
    word = lambda n: "".join(chr(97 + n // 26**i % 26) for i in range(2))
    rows = [(i, f"{word(i)} {word(i)}q{word(i)} " * 40, f"l{i:02d}", "s", 0) for i in range(69)] + [(99, "ÿþ õñ " * 9000, "long", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(docs, max_doc=5000)
    assert len(model) == 70 and sum(len(x) for _, x in model) <= 400_000
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_odd_column_names(spark):
    docs = spark.createDataFrame([(1, "abc abd", "en", "s", 0, 5, 6), (2, None, None, None, None, None, None)], SCHEMA + ", `my col` int, `a.b` int")
    found = language_id.identify(docs, language_id.fit(docs), carry=True).select("row.*")
    assert found.columns == docs.columns and sorted(map(str, found.collect())) == sorted(map(str, docs.collect()))
    ids = docs.withColumnRenamed("doc_id", "doc-id").withColumn("copies", F.lit(9))
    assert sorted(r["copies"] for r in mixing.mix(ids, id_col="doc-id").collect()) == [0, 1]


# --- mixing


def test_inclusion_differs_within_a_source(spark):
    """Long documents are likelier than scraps; the ratio of odds decides, not the draw alone."""
    rows = [(i, "w " * (2 if i % 2 else 400), "en", "a" if i % 3 else "b", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).where("source = 'b'").collect()
    share = lambda some: sum(r["copies"] for r in some) / len(some)
    long, short = share([r for r in got if r["size"] > 2]), share([r for r in got if r["size"] == 2])
    assert long > short * 1.2
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 400
    carried = mixing.mix(docs, carry=True)
    assert carried.columns == ["row", "copies"]
    assert {r["row"]["doc_id"]: r["copies"] for r in carried.where("row.source = 'b'").collect()} == {r["doc_id"]: r["copies"] for r in got}


# --- TIFF


def changed(file: bytes, tag: int, value: int) -> bytearray:
    """The file with another value under a tag of its first directory."""
    out = bytearray(file)
    (at,) = struct.unpack_from("<I", out, 4)
    (n,) = struct.unpack_from("<H", out, at)
    for i in range(n):
        if struct.unpack_from("<H", out, at + 2 + 12 * i)[0] == tag:
            struct.pack_into("<I", out, at + 2 + 12 * i + 8, value)
    return out


def test_broken_files_are_error_rows(spark):
    plain = tiff.image_file(b"ab" * 640)
    tiled = tiff.image_file(b"ab" * 6400)
    files = [changed(plain, tag, v) for tag, v in ((tiff.STRIP_ROWS, 0), (tiff.SAMPLES, 0), (tiff.WIDTH, 0), (tiff.HEIGHT, 2**31), (tiff.WIDTH, 2**31), (tiff.STRIP_OFFSETS, 2**31), (tiff.BITS, 3))]
    files += [changed(tiled, tiff.TILE_WIDTH, 0), bytearray(plain[:30]), bytearray(b"II*\0\xff\xff\xff\x7f"), bytearray(b"")]
    broken = bytearray(tiled)
    (at,) = struct.unpack_from("<I", broken, 4)
    for i in range(struct.unpack_from("<H", broken, at)[0]):
        if struct.unpack_from("<H", broken, at + 2 + 12 * i)[0] == tiff.TILE_WIDTH:
            struct.pack_into("<H", broken, at + 2 + 12 * i, 60_000)
    files.append(broken)
    media = spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary")
    got = tiff.read_pages(media).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(files)))
    assert all(r["error"] and r["pixels"] is None for r in got)


def test_pages_of_a_long_text(spark):
    text = " ".join(f"word{i % 977}" for i in range(300_000))
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, text)], "doc_id long, text string")
    media = tiff.encode_texts(docs)
    n = -(-len(text) // 64)
    pages = sorted((r["doc_id"], r["page"], r["top"], r["rows"]) for r in tiff.read_pages(media).drop("pixels").collect())
    whole = -(-n // tiff.PAGE_ROWS)
    assert whole > 1 and pages == [(d, p, p * tiff.PAGE_ROWS, n) for d in (1,) for p in range(whole)] + [(2, 0, 0, 1)] + [(3, p, p * tiff.PAGE_ROWS, n) for p in range(whole)]
    got = {r["doc_id"]: r for r in tiff.digests(media).collect()}
    payload = tiff.payload_of(text)[1]
    grid = np.frombuffer(payload, np.uint8).reshape(-1, 8, 8).sum(axis=2)
    band = np.minimum(7, np.arange(n) * 8 // n)
    means = np.array([[grid[band == i, j].mean() / 8 for j in range(8)] for i in range(8)])
    assert got[1]["feature"] == tiff.feature_of(whole, (64, n), np.frombuffer(payload, np.uint8).mean(), means) == got[3]["feature"]
    assert got[1]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[1]["media_sha256"] == got[3]["media_sha256"]


def test_every_size_meets_every_codec():
    for rows in range(1, 13):
        for scale in (1, 300):
            (page,) = tiff.pages(tiff.image_file(b"abcdefgh" * 8 * (rows + 12 * scale * 6 // 6)))
            assert page.compression in (tiff.LZW, tiff.DEFLATE, tiff.PACKBITS)
    assert {next(tiff.pages(tiff.image_file(b"x" * 64 * (6000 + i)))).compression for i in range(6)} == {tiff.LZW, tiff.DEFLATE, tiff.PACKBITS}


# --- urls


def test_newlines_and_depth(spark):
    """Keys of segments with any characters, and a pure blocked branch at the seventh segment that its siblings don't dilute."""
    top = "/".join("abcdef")
    urls = ["h://a/x\ny/z", "h://a/x\ny/z", "h://a/x/y\nz", "h:///p", "h:///p", "h://a/1:2/3", "h://a/1/2:3", f"h://shop.com/{top}/bad/2"]
    urls += [f"h://shop.com/{top}/bad/1{i}" for i in range(40)] + [f"h://shop.com/{top}/good/{i}" for i in range(40)] + ["h://b/" + "/".join("abcdefghijklmnop")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, (("block", "shop.com", f"/{top}/bad/1"),)).collect()}
    assert len(got) == len(urls) and got[0]["template"] == got[1]["template"] != got[2]["template"] and got[3]["template"] == got[4]["template"] == "/p"
    assert got[7]["template"] == f"/{top}/bad/*" and got[7]["verdict"] == "block"
    assert {got[i]["verdict"] for i in range(48, 88)} == {"allow"}
    assert got[len(urls) - 1]["template"] == "/" + "/".join("abcdefghijklmnop")


# --- licences, archives


def test_license_ties_repeats_and_long_texts(spark):
    mit, cc = "Released under the MIT License.", "Licensed under CC BY 4.0."
    files = [(1, "a/COPYING", mit, 1), (2, "a/LICENSE", cc, 2), (3, "a/x.py", "code", 3), (3, "a/x.py", "code", 4), (4, "b/y", "word " * 60_000 + mit, 5)]
    df = spark.createDataFrame(files, "doc_id long, path string, text string, score int")
    got = [(r["doc_id"], r["license"], r["inherited_from"]) for r in license_scan.license_of_files(df).collect()]
    assert sorted(got, key=str) == [(1, "MIT", None), (2, "CC-BY-4.0", None), (3, "CC-BY-4.0", "a"), (3, "CC-BY-4.0", "a"), (4, "MIT", None)]


def test_warc_of_nothing_and_of_long_payloads(spark, tmp_path):
    empty = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert empty.count() == 0 and warc.read_records(empty, f"file://{tmp_path}/e").count() == 0
    long = "é" * 3_000_000
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "v", "s")], "page_id long, url string, html string")
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = {r["id"]: r for r in warc.read_records(index, f"file://{tmp_path}/w").collect()}
    assert bytes(got[2]["payload"]).decode() == long and got[1]["refers_to"] == 2 and got[1]["payload_bytes"] == 6_000_000
    assert {r["payload"] for r in warc.read_records(index, f"file://{tmp_path}/w", payloads=False).collect()} == {None}


# --- packing, toxicity


def test_padding_is_small(spark, sf_dir):
    docs = documents(spark, sf_dir)
    parts = [docs.withColumn("doc_id", F.col("doc_id") + 100_000 * i).withColumn("text", F.concat(F.lit(f"n{i} "), "text")) for i in range(10)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    used = packing.pack(whole.coalesce(1)).agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert 1 - used["n"] / (used["s"] * packing.WINDOW) < 0.03


def test_gradient_of_the_loss():
    rng = np.random.default_rng(1)
    some = lambda n: toxicity._Sparse([rng.integers(0, 12, rng.integers(0, 6)) for _ in range(n)], 12)
    loss = toxicity.Loss(some(30), rng.integers(0, 2, 30).astype(float), rng.random(30) + 0.5, some(20), some(20), rng.random(20), 0.3)
    x = rng.standard_normal(13)
    slopes = [(loss.value(x + 1e-6 * e) - loss.value(x - 1e-6 * e)) / 2e-6 for e in np.eye(13)]
    assert np.allclose(loss.gradient(x), slopes, atol=1e-7)


def test_toxicity_of_rows_held_out(spark):
    folder = "/root/testdata/sf0.1"  # the smaller tables have half a dozen toxic rows held out
    found = queries.op8_toxicity(spark, folder).where("held_out")
    both = found.join(spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id").collect()
    right = lambda y: [r["predicted"] == y for r in both if r["toxic"] == y]
    assert len(right(1)) > 50 and sum(right(1)) / len(right(1)) >= 0.85 and sum(right(0)) / len(right(0)) >= 0.99


# --- the pipeline's stages on odd rows


ODD = [(1, "aaa bbb", "en", "s", 0), (1, "zzz yyy", "en", "s", 0), (2, "AAA bbb", "en", None, 0), (None, "same text", "en", "s", 0), (None, "same text", "en", "s", 0), (7, None, "en", "t", 0), (8, "", None, "t", 0), (9, "aaa bbb", "en", "s", 0), (9, "aaa bbb", "en", "s", 0)]


def test_stages_decide_for_rows(spark):
    docs = spark.createDataFrame([(*r, 4, 5, 6) for r in ODD], SCHEMA + ", copies int, `my col` int, kept int")
    texts = lambda df: sorted((r["text"] or "").translate(LOWER) for r in df.collect())
    kept = corpus_pipeline.exact(spark, docs, "")
    assert kept.columns == docs.columns and texts(kept) == ["", "aaa bbb", "same text", "zzz yyy"]
    assert [r["doc_id"] for r in kept.collect() if r["text"] == "aaa bbb"] == [9]
    kept = corpus_pipeline.near(spark, docs, "")
    assert kept.columns == docs.columns and texts(kept) == ["", "", "aaa bbb", "same text", "zzz yyy"]
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns and texts(kept) == texts(docs.where("length(text) > 0"))
    kept = corpus_pipeline.mix(spark, docs, "")
    assert kept.columns == docs.columns and {r["text"] for r in kept.collect()} >= {"same text", "zzz yyy"}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def brute_pipeline(rows, spark, sf_dir):
    """Rows (doc_id, text) that the first three stages keep, from the definitions."""
    clear = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    top = {}
    for i, t in clear:
        low = t.translate(LOWER)
        top[low] = max(i, top.get(low, i))
    exact = [(i, t) for i, t in clear if top[t.translate(LOWER)] == i]
    root = components(exact)
    return [(i, t) for i, t in exact if root[i][1] == i]


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    kept = brute_pipeline([(r["doc_id"], r["text"]) for r in docs.collect()], spark, sf_dir)
    near = docs.join(spark.createDataFrame([(i,) for i, _ in kept], "doc_id long"), "doc_id", "left_semi")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(near).collect()}
    words = packing.Words(packing.default_vocabulary())
    tokens = {i: len(words.ids(t)) // 4 + 1 for i, t in kept}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: tokens[i] * n for i, n in copies.items() if n}


# --- the registered queries


def test_op1_against_brute_force(spark, sf_dir):
    want = components([(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op1_near_dedup(spark, sf_dir).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_op2_against_brute_force(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op2_tiff(spark, sf_dir).collect()}
    rows = documents(spark, sf_dir).collect()
    assert len(got) == len(rows)
    same = {}
    for r in rows:
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        file = tiff.image_file(payload)
        x = got[r["doc_id"]]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (x["media_bytes"], x["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        assert same.setdefault(payload, x["feature"]) == x["feature"]


def test_op3_rules(spark, sf_dir):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in queries.op3_urls(spark, sf_dir).collect()}
    assert set(got) == set(pages)
    for i, url in pages.items():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert got[i]["verdict"] == max(fits)[2] if fits else got[i]["verdict"] in ("allow", "block")


def test_op4_against_brute_force(spark, sf_dir):
    rows = documents(spark, sf_dir).collect()
    counts = {}
    for r in rows:
        for w in set(license_scan.words_of(r["text"] or "")):
            counts[w] = counts.get(w, 0) + 1
    scanner = license_scan.Scanner(license_scan.TEMPLATES, counts, len(rows), 0.7)
    path = lambda r: "/".join([r["source"] or "none", str(r["doc_id"] // 16 % 64), *(["LICENSE"] if r["doc_id"] % 16 == 0 else [str(r["doc_id"] // 1024 % 64), f"{r['doc_id']}.txt"])])
    own = {r["doc_id"]: scanner.file(r["text"]) for r in rows}
    holders = {}
    for r in rows:
        if r["doc_id"] % 16 == 0 and own[r["doc_id"]]:
            name, score, _ = own[r["doc_id"]]
            at = path(r).rpartition("/")[0]
            holders[at] = min(holders.get(at, (-score, name, path(r))), (-score, name, path(r)))
    got = {r["doc_id"]: (r["path"], r["license"]) for r in queries.op4_licenses(spark, sf_dir).collect()}
    for r in rows:
        up = path(r).rpartition("/")[0]
        ways = ["/".join(up.split("/")[:n]) for n in range(len(up.split("/")), 0, -1)]
        near = next((holders[x][1] for x in ways if x in holders), None)
        assert got[r["doc_id"]] == (path(r), own[r["doc_id"]][0] if own[r["doc_id"]] else near)


def test_op7_and_op9(spark, sf_dir):
    rows = documents(spark, sf_dir).collect()
    got = {r["doc_id"]: r for r in queries.op7_language(spark, sf_dir).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    assert {i: r["held_out"] for i, r in got.items()} == {r["doc_id"]: held(r["doc_id"]) for r in rows}
    clear = [r for r in rows if r["lang"] and re.search(r"[^\W\d_]", r["text"] or "")]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in clear) / len(clear) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())
    pieces = queries.op9_pack(spark, sf_dir).collect()
    tokens = {}
    for p in pieces:
        tokens[p["doc_id"]] = tokens.get(p["doc_id"], 0) + p["length"]
        assert tokens[p["doc_id"]] <= p["doc_tokens"]
    assert set(tokens) == {r["doc_id"] for r in rows} and all(WORD for _ in tokens)


def test_batches_are_bounded(spark):
    sizes = common.map_batches(spark.range(5000).repartition(1).selectExpr("id", "repeat('x', 20000) AS t"), lambda batches: (b.slice(0, 0).select(["id"]) if b.nbytes < 2 * common.BATCH_BYTES and b.num_rows <= common.BATCH_ROWS else b.select(["id"]) for b in batches), "id long")
    assert sizes.count() == 0
