"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's set of word shingles gives ``SLOTS`` min-hashes, of which 8 bits each are
kept. Two signatures are near when at most ``DISTANCE`` slots differ. By the
pigeonhole principle, when the slots are cut into ``CHUNKS`` chunks, a near pair has a
chunk with at most DISTANCE // CHUNKS errors; with the values chosen that is one, so
every chunk is indexed once for each slot that may be wrong, without that slot. All
near pairs share a key. For sets with a similarity of 0.8 the expected distance is
25.6 with a deviation of 4.5, so a link's chance of being farther than ``DISTANCE`` is
about 1 in 10,000 at the threshold and less above it. Every link is confirmed on
full shingle sets (of 64-bit hashes in the last step, of words before it).

Documents with the same set are one class from the start. A key's documents aren't
all compared with each other: each meets its keys' leaders, of which the nearest by
signature is confirmed. Links are contracted onto the components of the rounds
before, so edges never add up. Leaders are the smallest documents first, then random
members of a key's largest component for the documents outside it. What is left are
keys with several components. Their documents meet in blocks of at most ``PART`` by
``PART``, by signature first; those that are near to another component go on with
their texts, and only a forest of links leaves a task. So no near pair that can join
two components is left out, and no task holds more than two parts.

Defined results: a null or wordless text has an empty set and stays alone. Fewer
words than a shingle give one shingle of all words. Where rows repeat a doc_id, the
smallest of their texts stands for all of them. Rows with a null doc_id stay alone
and are kept. An empty table gives an empty result. Extra columns aren't read, and
``drop_near_duplicates`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.base import Scratch, gram_hashes, join_spread, lower, mix, sized, span_hashes, table, text_chunks, words
from strandmill.llm.components import contracted

SLOTS, CHUNKS, DISTANCE, ROUNDS, PART = 128, 22, 42, 3, 125
_SEEDS = np.random.RandomState(1).randint(0, 2**32, (SLOTS, 2), dtype=np.uint32)
_SEEDS[:, 1] |= 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, ascending."""
    data = lower(data)
    starts, ends, first = words(data, offsets)
    h = span_hashes(data, starts, ends)
    grams = gram_hashes(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : b - size + 1]) if b - a >= size else gram_hashes(h[a:b], b - a) if b > a else grams[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """8 bits of the smallest value of each of SLOTS hash functions."""
    out = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        h = (shingles[at : at + 4096] >> np.uint64(32)).astype(np.uint32)
        np.minimum(out, ((h[None, :] ^ _SEEDS[:, :1]) * _SEEDS[:, 1:]).min(1), out=out)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _signature_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig = [], [], []
            for _, _, data, offsets in text_chunks(batch.column("text")):
                for s in shingle_sets(data, offsets, size):
                    n.append(len(s))
                    key.append(np.array([mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(1)))] if len(s) else [0, 0], np.uint64).tobytes())
                    sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return run


def _plan() -> list[tuple[int, np.ndarray]]:
    """(chunk and left-out slot as one number, slots of the key)."""
    bounds = np.linspace(0, SLOTS, CHUNKS + 1).astype(int)
    return [(c * SLOTS + left, np.array([s for s in range(a, b) if s != left])) for c, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) for left in range(a, b)]


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plan = _plan()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(-1, SLOTS).astype(np.uint64)
            keys = np.empty((len(sig), len(plan)), np.uint64)
            for k, (number, slots) in enumerate(plan):
                value = np.full(len(sig), number, np.uint64)
                for s in slots:
                    value = value * np.uint64(257) + sig[:, s]
                keys[:, k] = mix(value)
            ids = part.column("node").take(pa.array(np.repeat(np.arange(len(sig)), len(plan))))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), ids], ["key", "node"])


def _verify_batches(size: int, numerator: int, denominator: int):
    def grams(text: str | None) -> set:
        w = (text or "").encode().lower().split()
        return set(zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else {tuple(w)} if w else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                a = a.as_py()
                if a != last:
                    last, left = a, grams(a)
                right = grams(b.as_py())
                both = len(left & right)
                ok.append(both > 0 and denominator * both >= numerator * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return run


def _distance_batches(numerator: int, denominator: int):
    """(node, leader, d) of the pairs whose signatures are near and whose set sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("sig_node", "sig_leader"))
            n, m = (batch.column(c).to_numpy() for c in ("n_node", "n_leader"))
            d = (one != two).sum(1, dtype=np.int32)
            ok = pa.array((d <= DISTANCE) & (np.minimum(n, m) * denominator >= np.maximum(n, m) * numerator))
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(ok), batch.column("leader").filter(ok), pa.array(d).filter(ok)], ["node", "leader", "d"])

    return run


class _Verifier:
    """Tests pairs of class representatives: by signature, then on full sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, numerator: int, denominator: int, scratch: Scratch):
        self.docs, self.classes, self.scratch = docs, classes, scratch
        self.distances = _distance_batches(numerator, denominator)
        self.verify = _verify_batches(size, numerator, denominator)
        self.kind = docs.schema["doc_id"].dataType.simpleString()

    def nearest(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b), a the smaller, of each node of pairs(node, leader) and the leader nearest to it by signature."""
        of = lambda x: self.classes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))
        pairs = self.scratch.save(pairs, f"{name}_pairs")
        both = join_spread(pairs.join(of("node"), "node"), of("leader"), "leader", "node", self.scratch, name)
        near = both.select("node", "leader", "sig_node", "sig_leader", "n_node", "n_leader").mapInArrow(self.distances, f"node {self.kind}, leader {self.kind}, d int")
        best = near.groupBy("node").agg(F.min(F.struct("d", "leader")).alias("m"))
        return self.scratch.save(best.select(F.least("node", "m.leader").alias("a"), F.greatest("node", "m.leader").alias("b")).distinct(), name)

    def confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, linked) for each pair(a, b)."""
        needed = self.scratch.save(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), f"{name}_needed")
        texts = self.scratch.save(self.docs.join(sized(needed), "doc_id", "left_semi"), f"{name}_texts")
        of = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
        both = join_spread(join_spread(pairs, of("b"), "b", "a", self.scratch, f"{name}_b"), of("a"), "a", "b", self.scratch, f"{name}_a")
        out = self.scratch.save(both.select("a", "b", "text_a", "text_b").mapInArrow(self.verify, f"a {self.kind}, b {self.kind}, linked boolean"), name)
        self.scratch.drop(f"{name}_texts", f"{name}_needed")
        return out


def near_duplicates(docs: DataFrame, scratch: Scratch, size: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Links have denominator * intersection >= numerator * union over word shingles of ``size``.
    """
    docs = docs.select("doc_id", "text")
    rows = docs
    if repeated := docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0:
        one = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
        docs = scratch.save(one.unionByName(docs.where("doc_id is null")), "documents")
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = scratch.save(docs.mapInArrow(_signature_batches(size), f"doc_id {kind}, n_shingles long, set_key binary, sig binary"), "signatures")
    known = read.where("doc_id is not null and n_shingles > 0")
    classes = scratch.save(known.groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.count("*").alias("members")), "classes")
    # dealt anew, so that a task's keys fit its memory; the join never broadcasts, since keys grow with the documents
    by_key = classes.select("node", "sig").repartition(max(32, classes.count() // 8000)).mapInArrow(_key_batches, f"key long, node {kind}")
    keys = scratch.save(by_key.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader"), "keys")
    index = scratch.save(by_key.join(keys.hint("merge"), "key"), "index")
    scratch.drop("keys")
    labels = scratch.save(index.select("node").distinct().withColumn("component", F.col("node")), "labels")
    verify = _Verifier(docs, classes, size, numerator, denominator, scratch)
    tested: list[str] = []
    for step in range(ROUNDS + 1):
        if not step:
            asked = index.where("node <> leader").select("node", "leader").distinct()
        else:
            here = index.select("key", "node").join(labels, "node")
            parts = here.groupBy("key", "component").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("node", "key", F.lit(step)).alias("h"), "node")).alias("pick"))
            mixed = parts.groupBy("key").agg(F.max(F.struct("c", "component", F.col("pick.node").alias("leader"))).alias("top"), F.count("*").alias("k")).where("k > 1")
            index = scratch.save(here.join(mixed.select("key", F.col("top.component").alias("main"), F.col("top.leader").alias("leader")), "key"), f"open_{step}")
            scratch.drop("index" if step == 1 else f"open_{step - 1}")
            if not index.limit(1).count():
                break
            if step == ROUNDS:
                links = _across(index.select("main", "node", "component").distinct(), docs, classes, scratch, size, numerator, denominator)
                labels = contracted(labels, links, scratch, f"labels_{step}")
                break
            asked = index.where("component <> main").select("node", "leader").distinct()
            before = scratch.read(found.schema, *tested).select(F.col("a"), F.col("b"))
            asked = asked.withColumns({"a": F.least("node", "leader"), "b": F.greatest("node", "leader")}).join(before, ["a", "b"], "left_anti").select("node", "leader")
        found = verify.confirm(verify.nearest(asked, f"near_{step}"), f"tested_{step}")
        tested.append(f"tested_{step}")
        labels = contracted(labels, found.where("linked").select("a", "b"), scratch, f"labels_{step}")
    of_class = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).where("members > 1 or component <> node")
    of_class = scratch.save(of_class.select(F.col("set_key").alias("k"), F.col("n_shingles").alias("n"), "component"), "joined")
    out = read.join(sized(of_class), (F.col("set_key") == F.col("k")) & (F.col("n_shingles") == F.col("n")), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
    if not repeated:
        return out
    out = scratch.save(out, "by_document")
    return rows.where("doc_id is not null").select("doc_id").join(out, "doc_id").unionByName(out.where("doc_id is null"))


def _dealt(members: DataFrame, payload: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """members(main, node, component) with payload and, for each block x, y that it belongs to, a row.

    Below a main component, the documents outside it have parts 0 to p - 1, those
    inside parts p and up. A block is two parts, of which one at least is outside.
    """
    inside = F.col("component") == F.col("main")
    sizes = members.groupBy("main").agg(F.ceil(F.sum(inside.cast("int")) / PART).cast("int").alias("q"), F.greatest(F.lit(1), F.ceil(F.sum((~inside).cast("int")) / PART).cast("int")).alias("p"))
    sizes = sized(scratch.save(sizes, name))
    part = F.pmod(F.xxhash64("node"), F.when(inside, F.col("q")).otherwise(F.col("p"))).cast("int") + F.when(inside, F.col("p")).otherwise(0)
    own = members.join(sizes, "main").withColumn("own", part)
    with_outside = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("x"), F.greatest(i, F.col("own")).alias("y")))
    with_inside = F.transform(F.sequence(F.col("p"), F.col("p") + F.col("q") - 1), lambda j: F.struct(F.col("own").alias("x"), j.alias("y")))
    blocks = F.when(F.col("own") >= F.col("p"), with_outside).otherwise(F.concat(with_outside, with_inside))
    placed = own.select("node", "main", "component", "own", F.explode(blocks).alias("block")).select("node", "main", "component", "own", "block.x", "block.y")
    placed = scratch.save(placed, f"{name}_placed")
    return join_spread(placed, payload, "node", "main", scratch, f"{name}_nodes").repartition("main", "x", "y").sortWithinPartitions("main", "x", "y", "node")


def _across(members: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch, size: int, numerator: int, denominator: int) -> DataFrame:
    """Confirmed links (a, b), a forest in each block, between documents of different components below a main one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    members = scratch.save(members, "members")
    dealt = _dealt(members, classes.select("node", "sig", "n_shingles"), scratch, "sizes_signatures")
    near = dealt.mapInArrow(_by_block(_near_in_block(numerator, denominator)), f"main {kind}, node {kind}").distinct()
    left = scratch.save(members.join(scratch.save(near, "near_across"), ["main", "node"], "left_semi"), "members_left")
    needed = scratch.save(left.select(F.col("node").alias("doc_id")).distinct(), "needed_across")
    texts = scratch.save(docs.join(sized(needed), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"), "texts_across")
    dealt = _dealt(left, texts, scratch, "sizes_texts")
    return scratch.save(dealt.mapInArrow(_by_block(_links_in_block(size, numerator, denominator)), f"a {kind}, b {kind}").distinct(), "links_across")


def _by_block(work):
    """Calls work(table) for each block of rows sorted by main, x, y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("main", "x", "y")]
            change = np.zeros(batch.num_rows - 1, bool)
            for k in keys:
                change |= k[1:] != k[:-1]
            cuts = (np.flatnonzero(change) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                at = tuple(k[i] for k in keys)
                if held and group != at:
                    yield work(pa.Table.from_batches(held))
                    held = []
                group = at
                held.append(batch.slice(i, j - i))
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _rivals(t: pa.Table, sig: np.ndarray, n: np.ndarray, numerator: int, denominator: int):
    """(i, those later than i or inside the main component) of rows near by signature, from different components and parts."""
    comp, own = (t.column(c).to_numpy() for c in ("component", "own"))
    alike = t.column("x")[0].as_py() == t.column("y")[0].as_py()
    outside = comp != t.column("main")[0].as_py()
    place = np.arange(len(comp))
    for i in np.flatnonzero(outside):
        others = (comp != comp[i]) & (~outside | (place > i)) & (np.minimum(n, n[i]) * denominator >= np.maximum(n, n[i]) * numerator)
        others = np.flatnonzero(others if alike else others & (own != own[i]))
        others = others[(sig[others] != sig[i]).sum(1) <= DISTANCE]
        if len(others):
            yield i, others


def _near_in_block(numerator: int, denominator: int):
    """(main, node) of the rows with a rival."""

    def work(t: pa.Table) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, SLOTS)
        met = np.zeros(t.num_rows, bool)
        for i, others in _rivals(t, sig, t.column("n_shingles").to_numpy(), numerator, denominator):
            met[i] = True
            met[others] = True
        found = t.select(["main", "node"]).filter(pa.array(met)).combine_chunks()
        return pa.RecordBatch.from_arrays([found.column(c).combine_chunks() for c in ("main", "node")], ["main", "node"])

    return work


def _links_in_block(size: int, numerator: int, denominator: int):
    """(a, b) of confirmed links, a forest over the block's components."""

    def work(t: pa.Table) -> pa.RecordBatch:
        sets = [s for _, _, data, offsets in text_chunks(t.column("text")) for s in shingle_sets(data, offsets, size)]
        sig, n = np.stack([signature(s) for s in sets]), np.array([len(s) for s in sets])
        node, comp = t.column("node").to_numpy(), t.column("component").to_numpy()
        parent: dict = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        left, right = [], []
        for i, others in _rivals(t, sig, n, numerator, denominator):
            for j in others:
                one, two = root(comp[i]), root(comp[j])
                if one == two:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if denominator * both >= numerator * (len(sets[i]) + len(sets[j]) - both):
                    parent[max(one, two)] = min(one, two)
                    left.append(min(node[i], node[j]))
                    right.append(max(node[i], node[j]))
        kind = t.schema.field("node").type
        return pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], ["a", "b"])

    return work


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, size: int = 5) -> DataFrame:
    """One document of each group, the smallest doc_id, with its own columns."""
    gone = near_duplicates(docs, scratch, size).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op1_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "near-dups"), size=2)
