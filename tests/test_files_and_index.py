import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.config import EvalConfig, IndexConfig, SearchConfig
from orrery.operators import clustering, coarse, evaluate, index, knn
from orrery.plans import pipeline
from orrery.sources import vector_files as files
from orrery.streaming import serving


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 128)).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").cache()


@pytest.mark.parametrize("ext", ["fvecs", "fbin"])
def test_round_trip(spark, data, tmp_path, ext):
    files.register(spark)
    path = str(tmp_path / f"x.{ext}")
    files.write_vectors(data, path)
    with pytest.raises(Exception, match="overlap|order"):
        data.repartition(3).write.format("vectorfile").mode("overwrite").save(path + "2" + path[-6:])
    back = spark.read.format("vectorfile").option("splitRows", 64).load(path)
    assert back.join(data, ["vec_id", "embedding"]).count() == 300 == back.count()


def test_u8_and_errors(spark, tmp_path):
    files.register(spark)
    path = str(tmp_path / "x.u8bin")
    df = spark.createDataFrame([(0, [0.0, 255.0]), (1, [7.0, 8.0])], "vec_id long, embedding array<float>")
    df.write.format("vectorfile").mode("append").save(path)
    assert [r["embedding"] for r in spark.read.format("vectorfile").load(path).orderBy("vec_id").collect()] == [[0, 255], [7, 8]]
    with pytest.raises(Exception, match="whole numbers"):
        spark.createDataFrame([(0, [0.5])], "vec_id long, embedding array<float>").write.format("vectorfile").mode("append").save(str(tmp_path / "y.u8bin"))
    with open(path, "r+b") as f:
        f.truncate(10)
    with pytest.raises(files.VectorFileError):
        files.layout(path)
    assert files.layout(path, partial=True).rows == 1


def test_id_files(spark, tmp_path):
    a = str(tmp_path / "a.cid64")
    files.write_assignments([2, 0, 1], 3, a)
    assert [r["cid"] for r in files.read_assignments(spark, a).orderBy("vec_id").collect()] == [2, 0, 1]
    g = str(tmp_path / "g.bin")
    rows = [(0, 1, 5, 0.5), (0, 2, 6, 0.75), (1, 1, 7, 0.0), (1, 2, 8, 1.0)]
    files.write_ground_truth(rows, 2, g)
    assert [tuple(r) for r in files.read_ground_truth(spark, g).orderBy("query_id", "rank").collect()] == rows


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("memdim", [64, 128])
def test_save_load_search(spark, data, tmp_path, metric, memdim):
    config = IndexConfig(128, metric=metric, memdim=memdim, seed=3)
    cents = clustering.kmeans(data, 5, 4)
    placed = clustering.assign(data, cents).join(data, "vec_id")
    index.save(index.build(placed, cents, config), cents, config, str(tmp_path / "i"))
    blocks, c, got = index.load(spark, str(tmp_path / "i"))
    assert got == config and sum(len(r["vec_id"]) for r in blocks.select("vec_id").collect()) == 300
    q = data.where("vec_id < 10")
    truth = knn.exact_knn(data, q, 10, metric)
    r = knn.recall(index.search(blocks, q, c, got, SearchConfig(k=10, nprobe=5)), truth, 10).first()["recall"]
    assert r >= 0.9
    spark.read.parquet(str(tmp_path / "i/centroids")).withColumn("centroid", F.transform("centroid", lambda x: x + 1)).write.parquet(str(tmp_path / "c"))
    spark.read.parquet(str(tmp_path / "c")).write.mode("overwrite").parquet(str(tmp_path / "i/centroids"))
    with pytest.raises(ValueError, match="aren't those"):
        index.load(spark, str(tmp_path / "i"))


def test_raw_all_probes_is_exact(spark, data):
    cents = clustering.kmeans(data, 4, 2)
    placed = index.centroid_order(clustering.assign(data, cents).drop("dist").join(data, "vec_id"), cents)
    q = data.where("vec_id % 20 = 0")
    a = index.search_raw(placed, q, cents, 4, 5)
    assert sorted(map(tuple, a.select("query_id", "rank", "vec_id").collect())) == sorted(map(tuple, knn.exact_knn(data, q, 5).select("query_id", "rank", "vec_id").collect()))


def test_two_level(spark, data):
    cells, children = clustering.two_level_kmeans(data, 9, 3)
    assert children.count() == 9 and cells.count() == 3
    near = clustering.probe_assign(data, cells, children, 3)
    exact = clustering.assign(data, children)
    assert clustering.agreement(near, exact).first()["recall"] == 1.0


def test_empty_cluster_keeps_centroid(spark, data):
    trained = spark.createDataFrame([(0, [0.0] * 128), (1, [9.0] * 128)], "cid long, centroid array<double>")
    got = {r["cid"]: r for r in clustering.centroids(clustering.assign(data, trained).join(data, "vec_id"), trained=trained).collect()}
    assert got[1]["n"] == 0 and got[1]["centroid"] == [9.0] * 128 and got[0]["n"] == 300


def test_pipeline_and_serving(spark, data, tmp_path):
    config = IndexConfig(128, num_clusters=4, seed=1)
    rows = pipeline.run(data, data.where("vec_id % 20 = 0"), config, str(tmp_path), evaluation=EvalConfig(0.5, 0.9, 0.2)).collect()
    assert rows and all(r["metric_space"] == "l2" and 0 <= r["recall_at_topk"] <= 1 for r in rows)
    path, made = pipeline.ensure_index(data, config, str(tmp_path))
    assert made["build_s"] == 0
    data.where("vec_id < 5").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    serving.serve(stream, path, SearchConfig(k=3, nprobe=4), lambda df, n: got.extend(df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert len(got) == 15 and {r["vec_id"] for r in got if r["rank"] == 1} == set(range(5))


def test_grid_skips_finished_cells(spark, data, tmp_path):
    config, few = IndexConfig(128, num_clusters=3, seed=1), EvalConfig(0.5, 0.9, 0.4)
    q = data.where("vec_id % 50 = 0")
    first = pipeline.grid(data, q, config, str(tmp_path), [1, 3], [1, 2], few)
    cells = {(r["topk"], r["threads"]) for r in first.collect()}
    assert cells == {(1, 1), (1, 2), (3, 1), (3, 2)}
    done = {p: p.stat().st_mtime_ns for p in tmp_path.glob("cell-*/_SUCCESS")}
    assert sorted(map(str, pipeline.grid(data, q, config, str(tmp_path), [1, 3], [1, 2], few).collect())) == sorted(map(str, first.collect()))
    assert len(done) == 4 and {p: p.stat().st_mtime_ns for p in tmp_path.glob("cell-*/_SUCCESS")} == done
    other = data.withColumn("vec_id", 299 - F.col("vec_id"))
    assert pipeline.data_key(other) != pipeline.data_key(data)


def test_folders_and_id_files(spark, data, tmp_path):
    path = str(tmp_path / "x.fbin")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files.write_vectors(data, path, parts=True)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files.files_of(path)) > 1
    back = spark.read.format("vectorfile").load("file://" + path)
    assert back.join(data, ["vec_id", "embedding"]).count() == 300 == back.count()
    files.convert(spark, path, str(tmp_path / "y.fvecs"), 50)
    assert files.layout(str(tmp_path / "y.fvecs")).rows == 50
    u8 = spark.createDataFrame([(i, [float(i), 255.0]) for i in range(9)], "vec_id long, embedding array<float>")
    files.write_vectors(u8, str(tmp_path / "z.u8bin"))
    own = spark.read.format("vectorfile").option("elements", "own").load(str(tmp_path / "z.u8bin"))
    assert own.schema["embedding"].dataType.simpleString() == "array<smallint>" and own.where("vec_id = 8").first()["embedding"] == [8, 255]
    truth = [(q, r, 10 * q + r + (1 << 40), 0.0) for q in range(7) for r in (1, 2, 3)]
    files.write_gt64(truth, 3, str(tmp_path / "t.gt64"))
    got = spark.read.format("vectorfile").option("kind", "truth").option("splitRows", 2).load(str(tmp_path / "t.gt64"))
    assert got.rdd.getNumPartitions() == 4 and sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == [x[:3] for x in truth]
    files.write_ground_truth([(q, r, 7 * q + r, r / 2) for q, r, _, _ in truth], 3, str(tmp_path / "one.bin"))
    files.convert_truth(spark, str(tmp_path / "one.bin"), str(tmp_path / "two.gt64"), queries=2)
    assert sorted(tuple(r) for r in files.read_ground_truth(spark, str(tmp_path / "two.gt64")).collect()) == [(q, r, 7 * q + r, None) for q in (0, 1) for r in (1, 2, 3)]
    with pytest.raises(files.VectorFileError, match="no distances"):
        files.convert_truth(spark, str(tmp_path / "two.gt64"), str(tmp_path / "three.bin"))
    (tmp_path / "ids.bin").write_bytes(np.array([2, 2, 4, 5, 6, 7], "<i4").tobytes())
    assert [r["vec_id"] for r in files.read_ground_truth(spark, str(tmp_path / "ids.bin")).orderBy("query_id", "rank").collect()] == [4, 5, 6, 7]
    with pytest.raises(files.VectorFileError):
        files.write_ground_truth([(0, 1, 5, 0.5), (2, 1, 5, 0.5)], 1, str(tmp_path / "g"))


def test_ladder():
    assert evaluate.ladder(10, 10, 100) == [1, 2, 3, 4, 6, 8, 10] and evaluate.ladder(10, 1, 5) == [1]


def _scans(df):
    """Of the plan's file scans: pushed filters and columns read."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]


def test_search_reads_what_is_probed(spark, data, tmp_path):
    """One probe reads the row groups of its cluster, and resident columns only until seeds and survivors are known."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    config = IndexConfig(128, store="raw", seed=3)
    cents = clustering.kmeans(data, 8, 3)
    placed = clustering.assign(data, cents).join(data, "vec_id")
    index.save(index.build(placed, cents, config), cents, config, str(tmp_path / "i"))
    blocks, c, config = index.load(spark, str(tmp_path / "i"))
    q = data.where("vec_id = 7")
    (some,) = index.asked(q, c, SearchConfig(k=5, nprobe=1), 128)
    assert len(some.cids) == 1 and len(some.centroids) == 1
    index._threshold(blocks, some, config, SearchConfig(k=5, nprobe=1))
    sent = spark.sparkContext.broadcast(some)
    left = index._survivors(blocks, some, sent, config)
    (scan,) = _scans(left)
    assert f"EqualTo(cid,{some.cids[0]})" in scan or f"GreaterThanOrEqual(cid,{some.cids[0]})" in scan
    assert "raw" not in scan.split("ReadSchema")[1] and "ex_code" not in scan.split("ReadSchema")[1]
    paid = index._paid(blocks, left.select("q", "cid", "block", "place"), sent, config, 5, some.cids)
    assert any("raw" in x.split("ReadSchema")[1] and "cid" in x.split("PushedFilters")[1] for x in _scans(paid))
    members = placed.where(F.col("cid") == int(some.cids[0])).select("vec_id", "embedding")
    truth = knn.exact_knn(members, q, 5)
    got = index.search(blocks, q, c, config, SearchConfig(k=5, nprobe=1))
    assert [tuple(r)[:3] for r in got.orderBy("rank").collect()] == [tuple(r)[:3] for r in truth.orderBy("rank").collect()]


@pytest.mark.parametrize("more", [{}, {"memdim": 64}, {"store": "raw"}, {"metric": "ip"}])
def test_search_stores_no_survivors(spark, data, monkeypatch, more):
    """More queries than a tile, every vector twice: the best of what the measuring way marks, and no row for a survivor stored."""
    config = IndexConfig(128, seed=3, **more)
    twice = data.unionByName(data.withColumn("vec_id", F.col("vec_id") + 300))
    q = spark.range(5).crossJoin(data).select((F.col("id") * 300 + F.col("vec_id")).alias("vec_id"), "embedding")
    cents = clustering.kmeans(data, 4, 2)
    postings = index.build(clustering.assign(twice, cents).join(twice, "vec_id"), cents, config)
    blocks = index.durable(index.to_blocks(postings))
    options = SearchConfig(k=5, nprobe=4, drain_alpha=0.6)
    stored = []
    monkeypatch.setattr(index, "durable", lambda df, keep=index.durable: stored.append(keep(df)) or stored[-1])
    found = index.search(blocks, q, cents, config, options).collect()
    assert all(x.count() <= blocks.count() for x in stored)
    monkeypatch.undo()
    marked = index.marks(blocks, q, cents, config, options).where("kept")
    assert marked.count() > 20 * len(found)
    want = knn.ranked(marked.select("query_id", "vec_id", "dist"), 5).collect()
    plain = lambda rows: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["dist"], 9)) for r in rows)
    assert len(found) == 7500 and plain(found) == plain(want)


@pytest.mark.parametrize("kind", ["irq", "hnsw"])
def test_coarse_choice(spark, data, kind):
    config = IndexConfig(128, inner_size=4, seed=2)
    cents = clustering.kmeans(data, 12, 3)
    postings = index.build(clustering.assign(data, cents).join(data, "vec_id"), cents, config)
    q = data.where("vec_id < 12")
    flat = index.search(postings, q, cents, config, SearchConfig(k=5, nprobe=12))
    other = index.search(postings, q, cents, config, SearchConfig(k=5, nprobe=12, coarse=kind, irq_mode="full"))
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, other.collect()))
    with pytest.raises(ValueError, match="too few"):
        index.search(postings, q, cents, config, SearchConfig(k=5, nprobe=12, coarse=kind, irq_mult=0.01))


@pytest.mark.parametrize("case", ["ip", "hnsw", "kfixedmult", "full"])
def test_full_refinement_is_exact(spark, case):
    """Probing refined at full precision finds the nearest of the scanned centroids, to the last digits of their distances."""
    rng = np.random.default_rng(8)
    c, q = rng.standard_normal((30, 64)) * rng.uniform(0.5, 2, (30, 1)), rng.standard_normal((1500, 64))
    cents = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cid long, centroid array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "vec_id long, embedding array<double>")
    config = IndexConfig(64, metric="ip" if case == "ip" else "l2", seed=5)
    own = coarse.build(cents, config, cents.select("cid", (F.col("cid") % 3).alias("inner")), refine="full")
    if case == "hnsw":
        found = coarse.choose(asked, cents, config, SearchConfig(nprobe=4, coarse="hnsw", irq_mode="full"), own)
    else:
        found = coarse.probe(asked, own, 4, "kfixedmult" if case == "kfixedmult" else "full")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = (unit(q), unit(c)) if case == "ip" else (q, c)
    d = np.linalg.norm(a[:, None] - b, axis=2)
    if case == "kfixedmult":
        middle = np.array([b[i::3].mean(axis=0) for i in range(3)])
        scanned = np.argsort(np.linalg.norm(a[:, None] - middle, axis=2), axis=1)[:, :2]
        d[(np.arange(30) % 3 != scanned[:, :1]) & (np.arange(30) % 3 != scanned[:, 1:])] = np.inf
    want = np.argsort(d, axis=1)[:, :4]
    rows = sorted(tuple(r) for r in found.select("query_id", "rank", "cid", "dist").collect())
    assert [r[2] for r in rows] == want.ravel().tolist()
    assert np.abs(np.array([r[3] for r in rows]) - np.take_along_axis(d, want, 1).ravel()).max() < 1e-12


def test_wrong_partners(spark, data):
    cents = clustering.kmeans(data, 3, 1)
    placed = clustering.assign(data, cents).join(data, "vec_id")
    config = IndexConfig(128)
    with pytest.raises(ValueError, match="dimensions"):
        index.search(index.build(placed, cents, config), spark.createDataFrame([(0, [1.0] * 64)], "vec_id long, embedding array<double>"), cents, config, SearchConfig())
    with pytest.raises(Exception, match="has no centroid"):
        index.places(placed.withColumn("cid", F.lit(9)), cents).count()
    with pytest.raises(ValueError, match="not among"):
        knn.in_range(spark.createDataFrame([(0, 1, 300, 0.5)], "query_id long, rank long, vec_id long, dist double"), 300)


def test_lloyd_goes_on(spark, data, tmp_path):
    start = data.where("vec_id < 6").selectExpr("vec_id AS cid", "embedding AS centroid")
    whole = {r["cid"]: r["centroid"] for r in clustering.lloyd(data, start, 6).collect()}
    clustering.lloyd(data, start, 4, folder=str(tmp_path), every=2)
    assert sorted(clustering.checkpoints(spark, str(tmp_path))) == [2, 4]
    again = {r["cid"]: r["centroid"] for r in clustering.lloyd(data, start, 6, folder=str(tmp_path), every=2).collect()}
    assert all(np.allclose(whole[i], again[i]) for i in whole)


def test_plans_of_training(spark, data):
    sample = clustering.sample_exact(data, 50)
    assert "TakeOrdered" not in sample._jdf.queryExecution().executedPlan().toString() and sample.count() == 50
    cells, children = clustering.two_level_kmeans(data, 9, 2)
    few = clustering.probe_assign(data, cells, children, 2, limit=0)
    assert sorted(map(tuple, few.select("vec_id", "cid").collect())) == sorted(map(tuple, clustering.probe_assign(data, cells, children, 2).select("vec_id", "cid").collect()))
    sweep = {r["probes"]: r["recall"] for r in clustering.probe_sweep(data, cells, children, [1, 3]).collect()}
    assert sweep[1] <= sweep[3] == 1.0
    assert clustering.calibrate([(100, 1.0), (200, 2.0)], 1000) == pytest.approx(10.0)


def test_queries_in_parts(spark, data, monkeypatch):
    from orrery.operators import blocks

    q = data.where("vec_id % 3 = 0")
    want = sorted(map(tuple, knn.exact_knn(data, q, 4).collect()))
    parts = blocks.query_chunks(q, 1 << 20)
    assert len(parts) > 1 and sum(p.count() for p in parts) == 100
    monkeypatch.setattr(knn, "query_chunks", lambda *a: parts)
    assert sorted(map(tuple, knn.exact_knn(data, q, 4).collect())) == want


def test_hot_cluster_is_ordered_in_parts(spark, data, monkeypatch):
    cents = spark.createDataFrame([(0, [0.0] * 128)], "cid long, centroid array<double>")
    placed = data.withColumn("cid", F.lit(0))
    want = sorted(map(tuple, index.places(placed, cents).select("vec_id", "pos").collect()))
    monkeypatch.setattr(index, "ORDERED", 16)
    assert sorted(map(tuple, index.places(placed, cents).select("vec_id", "pos").collect())) == want
    assert sorted(p for _, p in want) == list(range(300))
