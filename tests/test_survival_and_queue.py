"""Nested reads and what survives; the key queue, replayed in other batches; ingest."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import survival
from strandmill.streaming import ingest, key_queue


def test_nested_by_construction(spark):
    rng = random.Random(0)
    rows = [(f"p{i}", "".join(rng.choices("ACGTN", k=rng.choice([150, 256, 700])))) for i in range(30)]
    parents = spark.createDataFrame(rows, "parent_id string, sequence string")
    reads = survival.nested_reads(parents, [32, 64, 128], [0.0, 0.1, 0.3], 2, 200).collect()
    long = {p for p, s in rows if len(s) >= 200}
    assert len(reads) == len({r["query_id"] for r in reads}) == len(long) * 3 * (1 + 2 + 2)
    text, by = dict(rows), {(r["parent_id"], r["length"], r["rate"], r["draw"]): r["sequence"] for r in reads}
    changed, places = {0.1: 0, 0.3: 0}, 0
    for p in long:
        clean = by[p, 128, 0.0, 0]
        assert clean in text[p]
        for rate, draw in ((0.0, 0), (0.1, 0), (0.1, 1), (0.3, 0), (0.3, 1)):
            full = by[p, 128, rate, draw]
            assert [len(by[p, n, rate, draw]) for n in (32, 64, 128)] == [32, 64, 128]
            assert by[p, 32, rate, draw] == full[:32] and by[p, 64, rate, draw] == full[:64]
            if rate:
                changed[rate] += sum(a != b for a, b in zip(clean, full, strict=True))
                assert all(b in "ACGT" for a, b in zip(clean, full, strict=True) if a != b)
        assert by[p, 128, 0.3, 0] != by[p, 128, 0.3, 1]
        places += 2 * sum(c != "N" for c in clean)
    assert abs(changed[0.1] / places - 0.1) < 0.03 and abs(changed[0.3] / places - 0.3) < 0.04
    with pytest.raises(ValueError):
        survival.nested_reads(parents, [300], [0.0], 1, 200)


def test_relevant_and_survival(spark):
    x = np.eye(6, dtype=np.float32)
    v = spark.createDataFrame([(i, f"a{i}", r.tolist()) for i, r in enumerate([*x, 0.999 * x[0] + 0.01 * x[1]])], "vector_id long, accession string, embedding array<float>")
    parents = spark.createDataFrame([("p", "a0", x[0].tolist()), ("r", "a1", x[1].tolist())], "parent_id string, accession string, embedding array<float>")
    own = survival.relevant(parents, v)
    assert sorted(map(tuple, own.collect())) == [("p", "a0"), ("p", "a6"), ("r", "a1")]
    reads = spark.createDataFrame([("p1", "p", 32, 0.0), ("p2", "p", 64, 0.0), ("r1", "r", 32, 0.0)], "query_id string, parent_id string, length int, rate double")
    found = spark.createDataFrame([("p1", "a6", 2), ("p1", "a3", 1), ("p2", "a0", 1), ("r1", "a5", 1)], "query_id string, accession string, rank int")
    got = {(r["length"], r["rate"]): (r["n_reads"], r["found_1"], r["found_3"]) for r in survival.survival(found, reads, own, [1, 3]).collect()}
    assert got == {(32, 0.0): (2, 0.0, 0.5), (64, 0.0): (1, 1.0, 1.0)}


def replay(spark, tmp_path, rows, batches, name):
    """The stream cut into that many files, one a batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", key_queue.STATE_STORE)
    source = tmp_path / name / "in"
    for i in range(batches):
        part = [r for n, r in enumerate(rows) if n * batches // len(rows) == i]
        spark.createDataFrame(part, "queue string, number long, sequence string").coalesce(1).write.mode("append").parquet(str(source / f"{i:03}"))
    stream = spark.readStream.schema("queue string, number long, sequence string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = key_queue.enqueue(stream, 5, 4).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / name / "c")).trigger(availableNow=True).start(str(tmp_path / name / "out"))
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.read.schema(key_queue.OUTPUT).parquet(str(tmp_path / name / "out"))


def test_queue_in_other_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("uv"), i, "".join(rng.choices("ACG", k=rng.choice([3, 6, 9])))) for i in range(40)]
    want, slots, nexts = [], {}, {}
    for queue, number, s in rows:
        ring, at = slots.setdefault(queue, {}), nexts.get(queue, 0)
        grams = {s[i : i + 4] for i in range(len(s) - 3)}
        near = sorted(j for j, t in ring.items() if grams & {t[i : i + 4] for i in range(len(t) - 3)})
        want.append((queue, number, at, s, ring.get(at), near))
        ring[at], nexts[queue] = s, (at + 1) % 5
    for batches in (1, 4):
        log = replay(spark, tmp_path, rows, batches, f"b{batches}")
        assert sorted((r["queue"], r["number"], r["slot"], r["sequence"], r["replaced"], r["candidates"]) for r in log.collect()) == sorted(want)
        assert {(r["queue"], r["slot"]): r["sequence"] for r in key_queue.queue_of(log).collect()} == {(q, j): t for q, ring in slots.items() for j, t in ring.items()}


def test_ingest(spark, tmp_path):
    for i in range(2):
        spark.range(i * 10, i * 10 + 10).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark, str(tmp_path / "in"), "id long", str(tmp_path / "table"), str(tmp_path / "c")).awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / "table"))
        assert sorted(r["id"] for r in got.collect()) == list(range(10 * i + 10))
    assert got.select(F.countDistinct("batch")).first()[0] == 2
