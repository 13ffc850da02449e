"""fbin and FASTA files, artifacts and kept searches."""

import json

import numpy as np
import pytest

from strandmill.operators import search
from strandmill.sources import catalog, fasta, fbin, store


def rows_of(n, d=8, seed=0):
    return np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, v.tolist()) for i, v in enumerate(x)], "vector_id long, embedding array<float>").repartition(5)


def matrix(df):
    rows = df.orderBy("vector_id").collect()
    return [r["vector_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float32)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fbin") / "v")
    x = rows_of(1000)
    fbin.write_fbin(frame(spark, x), path, 8, piece_bytes=8 * 4 * 300)
    return x, path


def test_round_trip(spark, folder):
    x, path = folder
    about = fbin.manifest(path)
    assert [(p["start"], p["rows"]) for p in about["pieces"]] == [(0, 300), (300, 300), (600, 300), (900, 100)] and about["n"] == 1000
    ids, got = matrix(fbin.read_fbin(spark, path, rows=70))
    assert ids == list(range(1000)) and (got == x).all()
    one = np.fromfile(about["pieces"][1]["path"], np.uint32, 2).tolist()
    assert one == [300, 8]
    ids, got = matrix(fbin.read_fbin(spark, about["pieces"][3]["path"]))
    assert ids == list(range(100)) and (got == x[900:]).all()


@pytest.mark.parametrize("kind", ["fp16", "bf16"])
def test_two_bytes(spark, tmp_path, kind):
    from strandmill.functions.vectors import round_to

    x = rows_of(50)
    fbin.write_fbin(frame(spark, x), str(tmp_path / "v"), 8, kind)
    assert (matrix(fbin.read_fbin(spark, str(tmp_path / "v")))[1] == round_to(x, kind)).all()


def test_range_reads_only_its_pieces(spark, folder):
    x, path = folder
    for start, end, pieces in ((310, 320, {1}), (290, 610, {0, 1, 2}), (0, 1, {0}), (2000, 3000, set())):
        reader = fbin.FbinReader(path, {"start": start, "end": end, "rows": 100})
        opened = {int(p[0][-10:-5]) for part in reader.partitions() for p in part.parts}
        assert opened == pieces
        assert sum(p[3] for part in reader.partitions() for p in part.parts) == max(0, min(end, 1000) - start)
    ids, got = matrix(fbin.read_fbin(spark, path, start=295, end=305))
    assert ids == list(range(295, 305)) and (got == x[295:305]).all()


def test_filters_reach_the_reader(spark, folder):
    x, path = folder
    ids, got = matrix(fbin.read_fbin(spark, path).where("vector_id >= 299 and vector_id < 303"))
    assert ids == [299, 300, 301, 302] and (got == x[299:303]).all()
    assert matrix(fbin.read_fbin(spark, path).where("vector_id in (5, 950)"))[0] == [5, 950]
    assert matrix(fbin.read_fbin(spark, path).where("vector_id = 7 and embedding[0] is not null"))[0] == [7]
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThanOrEqual

    reader = fbin.FbinReader(path, {"rows": 1000})
    left = list(reader.pushFilters([GreaterThan(("vector_id",), 599), LessThanOrEqual(("vector_id",), 610), IsNotNull(("vector_id",)), EqualTo(("embedding",), 3)]))
    assert len(left) == 2 and [p.parts for p in reader.partitions()] == [[(fbin.manifest(path)["pieces"][2]["path"], 600, 600, 11)]]


def test_gaps_and_failures_leave_nothing(spark, tmp_path):
    x = rows_of(20)
    with pytest.raises(Exception, match="consecutive|rows, not"):
        fbin.write_fbin(frame(spark, x).where("vector_id <> 7"), str(tmp_path / "v"), 8)
    assert [p.name for p in (tmp_path / "v").iterdir() if not p.name.startswith(".")] == []
    fbin.write_fbin(frame(spark, x), str(tmp_path / "w"), 8)
    with pytest.raises(FileExistsError):
        fbin.write_fbin(frame(spark, x), str(tmp_path / "w"), 8)


def test_empty_file(spark, tmp_path):
    np.array([0, 8], np.uint32).tofile(tmp_path / "e.fbin")
    assert fbin.read_fbin(spark, str(tmp_path / "e.fbin")).collect() == []


def test_merge(spark, folder, tmp_path):
    x, path = folder
    y = rows_of(40, seed=2)
    fbin.write_fbin(frame(spark, y), str(tmp_path / "b"), 8)
    about = fbin.merge_fbin([path, str(tmp_path / "b")], str(tmp_path / "all"))
    assert about["n"] == 1040 and [p.name for p in (tmp_path / "all").iterdir()] == ["manifest.json"]
    ids, got = matrix(fbin.read_fbin(spark, str(tmp_path / "all"), start=990))
    assert ids == list(range(990, 1040)) and (got == np.concatenate([x[990:], y])).all()
    fbin.write_fbin(frame(spark, rows_of(4, d=4)), str(tmp_path / "c"), 4)
    with pytest.raises(ValueError, match="dimension"):
        fbin.merge_fbin([path, str(tmp_path / "c")], str(tmp_path / "no"))
    meta = lambda *r: spark.createDataFrame(r, "accession string, start_row long, num_rows long")
    got = fbin.merge_meta([meta(("a", 0, 600), ("b", 600, 400)), meta(("c", 0, 40))])
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0, 600), ("b", 600, 400), ("c", 1000, 40)]
    with pytest.raises(ValueError, match="several shards"):
        fbin.merge_meta([meta(("a", 0, 1)), meta(("a", 0, 1))])


def test_block_sample(spark, folder):
    x, path = folder
    reader = fbin.FbinReader(path, {"sample": 100, "block": 8, "seed": 3, "rows": 40})
    parts = [p for part in reader.partitions() for p in part.parts]
    assert sum(p[3] for p in parts) == 104 and len(reader.partitions()) > 1  # what is read follows the sample
    ids, got = matrix(fbin.read_fbin(spark, path, sample=100, block=8, seed=3))
    assert len(ids) == 104 and (got == x[ids]).all() and {i // 8 * 8 for i in ids} == set(ids[::8])
    assert matrix(fbin.read_fbin(spark, path, sample=100, block=8, seed=3))[0] == ids != matrix(fbin.read_fbin(spark, path, sample=100, block=8, seed=4))[0]
    assert np.allclose(fbin.centroid_estimate(spark, path, 5000), x.mean(0), atol=1e-6)
    assert np.abs(fbin.centroid_estimate(spark, path, 400, block=8) - x.mean(0)).max() < 0.2


def test_fasta_in_splits(spark, tmp_path):
    want = []
    for acc in ("S1", "S2"):
        (tmp_path / acc).mkdir()
        lines = []
        for i in range(200):
            seq = "".join(np.random.default_rng(i).choice(list("ACGT"), 50 + i))
            lines.append(f">{acc}_{i} some > text\n" + "\n".join(seq[j : j + 60] for j in range(0, len(seq), 60)))
            want.append((acc, i, f"{acc}_{i}", seq))
        (tmp_path / acc / "contigs.fa").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = fasta.read_fasta(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    fasta.write_fasta(df.select("contig_id", "sequence"), str(tmp_path / "out" / "S3"), "contig_id")
    assert sorted(r["sequence"] for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()) == sorted(w[3] for w in want)


def test_identity(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    assert not catalog.ensure(spark, path, {"x": 1})
    calls = []
    build = lambda p: (calls.append(p), spark.range(3).write.parquet(f"{p}/t"))
    for _ in range(2):
        assert catalog.built(spark, path, {"x": 1, "y": [2]}, build) == path
    assert calls == [path] and json.loads(store.read_text(spark, f"{path}/config.json")) == {"x": 1, "y": [2]}
    with pytest.raises(ValueError, match="another"):
        catalog.ensure(spark, path, {"x": 2})
    store.delete(spark, f"{path}/config.json")
    with pytest.raises(ValueError, match="no config"):
        catalog.ensure(spark, path, {"x": 1})
    catalog.built(spark, path, {"x": 1}, build)  # half of an artifact is built anew
    assert len(calls) == 2


def test_smaller_search_reads_no_vectors(spark, tmp_path):
    x, root, calls = rows_of(60), f"file://{tmp_path}/hits", []
    v = spark.createDataFrame([(i, "a", r.tolist()) for i, r in enumerate(x)], "vector_id long, accession string, embedding array<float>")
    q = spark.createDataFrame([(f"q{i}", r.tolist()) for i, r in enumerate(rows_of(4, seed=1))], "query_id string, embedding array<float>")

    def find(k, asked=q):
        calls.append(k)
        return search.exact(asked, v, k)

    about = {"engine": "exact", "encoder": "e", "top_k": 9, "num_queries": 4, "seed": 0}
    first = catalog.searched(spark, root, about, q, find)
    assert first.count() == 36
    again = catalog.searched(spark, root, about | {"top_k": 3, "num_queries": 2}, q.limit(2), find)
    assert calls == [9] and again.count() == 6 and {r["rank"] for r in again.collect()} == {1, 2, 3}
    catalog.searched(spark, root, about | {"top_k": 12}, q, find)
    catalog.searched(spark, root, about | {"encoder": "f", "top_k": 2}, q, find)
    other = q.unionByName(spark.createDataFrame([("q9", x[0].tolist())], q.schema))
    assert catalog.searched(spark, root, about | {"top_k": 3}, other, lambda k: find(k, other)).count() == 15
    assert calls == [9, 12, 2, 3]


def test_differences(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (2, "y", 1.0), (2, "y", 1.0), (None, "z", 2.0)], "i int, k string, v double")
    b = spark.createDataFrame([(1, "x", 0.25), (2, "y", 1.0), (3, "y", 9.0), (None, "z", 2.0)], "i int, k string, v double")
    assert tuple(catalog.differences(a, b, ["i", "k"], ["v"]).first()) == (1, 1, 0.25)
