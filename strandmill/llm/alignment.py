"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers encode every text in Arrow batches. Running sums of byte lengths give every
token's end, ends that both sides have cut the tokens into groups, running counts of
cuts are the groups' numbers, and the tokens of a group are linked. There are two forms
of that step with equal results: ``aligned``, relational from the tokens on, and
``aligned_in_tasks``, which does the same on arrays where the tokens are made. A text
gives about as many tokens as it has words and half again, on two sides, and each token's row is
sorted, summed, joined and grouped in the relational form; README has its figures. The
query takes the second.

Relational form: tokens are exploded with their places, a window sums byte lengths, a full
equi-join on document and end puts the two sides in one order of bytes, where the count
of rows before that have both is the group.

An id pair's count is the number of documents that hold it linked. Pairs are made
distinct within a document first, so counting them shuffles totals of each map task.
Counts return to the documents' pairs by a broadcast of up to ``BROADCAST_PAIRS`` of
them, the most common ones; the others are joined by a shuffle. A document is one row
of the table: its key is made when the table is read.

Defined results: null and empty texts, and texts whose tokens' bytes differ from a
space and the text (those that a tokenizer normalises, or that hold U+2581), have no
tokens: zeros and an empty digest. Repeated rows are documents of their own, each counting
for its pairs. Rows with a null doc_id are treated like all others. A tokenizer's
special strings are plain text. Extra columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import importlib.util
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.llm.base import Scratch, table

TOKENIZERS = "/opt/tokenizers"
#: Pairs of ids that are broadcast with their counts at most; each takes two ints and two longs.
BROADCAST_PAIRS = 2_000_000
#: Links of a group up to which they are listed; beyond it each side's distinct ids are paired.
LISTED_LINKS = 4096
#: Rows of tokens that a task sorts at most, about.
TOKENS_PER_TASK = 4_000_000


class _Pair:
    """Both tokenizers, and the bytes of every id."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        spec = importlib.util.spec_from_file_location("public_tokenizers", f"{folder}/__init__.py")
        public = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(public)
        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:  # the vocabulary of byte_bpe_50k.json as ranks
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        self.a_size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.a_size[rank] = len(token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.b_size = np.array([len(p) for p in self.b_bytes], np.int64)
        #: What an id looks like inside and at the end of its side of a group.
        self.text = [f"{i}{end}".encode() for end, n in ((",", len(self.a_size)), ("|", len(self.a_size)), (",", len(self.b_size)), (";", len(self.b_size))) for i in range(n)]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        b = self.b.encode(text, num_threads=1)
        if b"".join(map(self.b_bytes.__getitem__, b)) != b" " + text.encode():
            return none, none
        return np.array(self.a.encode_ordinary(" " + text), np.int64), np.array(b, np.int64)


@lru_cache(1)
def _pair(folder: str) -> _Pair:
    return _Pair(folder)


def tokens(keyed: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """key, and for both tokenizers the ids and byte lengths of a text's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _pair(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [both.encode(t) for t in part.column("text").to_pylist()]
                lists = []
                for side, size in ((0, both.a_size), (1, both.b_size)):
                    offsets = pa.array(np.cumsum([0, *[len(m[side]) for m in made]]), pa.int32())
                    ids = np.concatenate([m[side] for m in made])
                    lists += [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, size[ids])]
                yield pa.RecordBatch.from_arrays([part.column("key"), *lists], ["key", "a_ids", "a_sizes", "b_ids", "b_sizes"])

    return keyed.select("key", "text").mapInArrow(run, "key long, a_ids array<int>, a_sizes array<int>, b_ids array<int>, b_sizes array<int>")


def placed(encoded: DataFrame, side: str) -> DataFrame:
    """(key, end, id) of one side's tokens, with the byte at which each ends."""
    each = encoded.select("key", F.posexplode(F.arrays_zip(F.col(f"{side}_ids").alias("id"), F.col(f"{side}_sizes").alias("size"))).alias("pos", "token"))
    return each.select("key", F.sum("token.size").over(Window.partitionBy("key").orderBy("pos")).alias("end"), F.col("token.id").alias(side))


def grouped(encoded: DataFrame) -> DataFrame:
    """(key, g, a, b): the ids of each group in order."""
    both = placed(encoded, "a").join(placed(encoded, "b"), ["key", "end"], "full_outer")
    before = Window.partitionBy("key").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)
    of = both.select("key", "end", "a", "b", F.count(cut).over(before).alias("g"))
    listed = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", F.col(side).alias("id"))))), lambda x: x["id"])
    return of.groupBy("key", "g").agg(listed("a").alias("a"), listed("b").alias("b"))


def aligned(encoded: DataFrame) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups_sha256 and ``pairs``, each pair of ids linked in a document once with its number of links."""
    groups = grouped(encoded)
    text = F.concat_ws("|", F.array_join("a", ","), F.array_join("b", ","))
    sides = groups.groupBy("key").agg(
        F.sum(F.size("a")).alias("n_a"), F.sum(F.size("b")).alias("n_b"), F.count("*").alias("n_groups"), F.sum(F.size("a").cast("long") * F.size("b")).alias("n_links"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", text.alias("s")))), lambda x: x["s"]), ";"), 256).alias("groups_sha256"),
    )
    links = groups.select("key", F.explode("a").alias("a"), "b").select("key", "a", F.explode("b").alias("b"))
    pairs = links.groupBy("key", "a", "b").agg(F.count("*").alias("n")).groupBy("key").agg(F.collect_list(F.struct("a", "b", "n")).alias("pairs"))
    return sides.join(pairs, "key")


def _links(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs as a * 2^32 + b, and their numbers of links. ga and gb: the tokens' groups, ascending."""
    na, nb = np.bincount(ga), np.bincount(gb)
    start = np.cumsum(nb) - nb
    large = na * nb > LISTED_LINKS
    own = np.flatnonzero(~large[ga])
    reps = nb[ga[own]]
    first = np.cumsum(reps) - reps
    codes = [np.repeat(a[own] << 32, reps) + b[np.repeat(start[ga[own]] - first, reps) + np.arange(reps.sum())]]
    times = [np.ones(len(codes[0]), np.int64)]
    for g in np.flatnonzero(large):
        (ua, ca), (ub, cb) = (np.unique(x[np.searchsorted(of, g) : np.searchsorted(of, g, "right")], return_counts=True) for x, of in ((a, ga), (b, gb)))
        codes.append(((ua << 32)[:, None] + ub).ravel())
        times.append((ca[:, None] * cb).ravel())
    codes, times = np.concatenate(codes), np.concatenate(times)
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    new = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[new], np.add.reduceat(times, new)


def _row(both: _Pair, text: str | None) -> tuple:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs and their links of one text."""
    a, b = both.encode(text)
    if not len(a):
        return 0, 0, 0, 0, "", a, a
    ea, eb = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
    cut_a, cut_b = eb[np.searchsorted(eb, ea)] == ea, ea[np.searchsorted(ea, eb)] == eb  # both end with the text
    ga, gb = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    na, nb = np.bincount(ga), np.bincount(gb)
    shown = np.empty(len(a) + len(b), np.int64)  # every group's ids, those of one side before the other's
    n, m = len(both.a_size), len(both.b_size)
    shown[np.arange(len(a)) + (np.cumsum(nb) - nb)[ga]] = a + n * cut_a
    shown[np.arange(len(b)) + np.cumsum(na)[gb]] = b + 2 * n + m * cut_b
    digest = hashlib.sha256(b"".join(map(both.text.__getitem__, shown.tolist()))[:-1]).hexdigest()
    return len(a), len(b), len(na), int((na * nb).sum()), digest, *_links(a, b, ga, gb)


def aligned_in_tasks(keyed: DataFrame, folder: str = TOKENIZERS, key: str = "long") -> DataFrame:
    """What ``aligned`` gives, for every row of keyed; key is the type of its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _pair(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = list(zip(*[_row(both, t.as_py()) for t in part.column("text")], strict=True))
                codes, n = np.concatenate(rows[5]), np.concatenate(rows[6])
                pair = pa.StructArray.from_arrays([pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["a", "b", "n"])
                pairs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows[5])]), pa.int32()), pair)
                yield pa.RecordBatch.from_arrays([part.column("key"), *[pa.array(r, pa.int64()) for r in rows[:4]], pa.array(rows[4], pa.string()), pairs], ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return keyed.select("key", "text").mapInArrow(run, f"key {key}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,n:bigint>>")


def counted(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """pairs with the columns of counts(a, b, count, ..), a saved table: the most common ones by a broadcast, what it can't hold by a shuffle. Rows without a pair stay."""
    power = F.floor(F.log2("count")).cast("int")
    sizes = sorted(((r["p"], r["n"]) for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 64 rows at most
    held, least = 0, None
    for p, n in sizes:
        if held + n > BROADCAST_PAIRS:
            least = p + 1
            break
        held += n
    if least is None:
        return pairs.join(F.broadcast(counts), ["a", "b"], "left")
    common, rare = F.broadcast(counts.where(power >= least)), counts.where(power < least)
    some = pairs.where("a is not null")
    others = some.join(common.select("a", "b"), ["a", "b"], "left_anti").join(rare.hint("merge"), ["a", "b"])
    return some.join(common, ["a", "b"]).unionByName(others).unionByName(pairs.where("a is null"), allowMissingColumns=True)


def summaries(found: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of found, a saved table with a key for each row."""
    counts = found.select(F.inline("pairs")).groupBy("a", "b").agg(F.count("*").alias("count"))
    counts = scratch.save(counts, "counts")
    best = counts.groupBy("a").agg(F.max("count").alias("best"))  # a row for each id of the vocabulary
    counts = scratch.save(counts.join(F.broadcast(best), "a").select("a", "b", "count", (F.col("count") == F.col("best")).alias("is_best")), "ranked")
    own = ["key", *(c for c in found.columns if c not in ("key", "pairs"))]
    each = counted(found.select(*own, F.inline_outer("pairs")), counts)
    out = each.groupBy(*own).agg(F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.coalesce(F.col("n") * F.col("count"), F.lit(0))).alias("count_sum"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("key"))


def align(docs: DataFrame, scratch: Scratch, folder: str = TOKENIZERS) -> DataFrame:
    """The summaries of docs, aligned where the tokens are made. No text and no token is shuffled."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = aligned_in_tasks(_keyed(docs).withColumn("key", F.struct("doc_id", "key")), folder, f"struct<doc_id:{kind},key:bigint>")
    found = scratch.save(made.select("key.doc_id", "key.key", *made.columns[1:]), "aligned")
    return summaries(found, scratch)


def align_relational(docs: DataFrame, scratch: Scratch, folder: str = TOKENIZERS) -> DataFrame:
    """The summaries of docs by the relational form, whose tokens meet in one shuffle by document."""
    conf, key = scratch.spark.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    old = conf.get(key)
    conf.set(key, "false")  # what is dealt by document stays so for joins on document and end
    try:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(int(conf.get("spark.sql.shuffle.partitions")), size // TOKENS_PER_TASK + 1)  # tokens are fewer than bytes
        keyed = scratch.save(_keyed(docs), "keyed")
        found = keyed.select("doc_id", "key").join(aligned(tokens(keyed, folder).repartition(parts, "key")), "key", "left")
        zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_a", "n_b", "n_groups", "n_links")}
        return summaries(scratch.save(found.withColumns(zero).withColumn("groups_sha256", F.coalesce("groups_sha256", F.lit(""))), "aligned"), scratch)
    finally:
        conf.set(key, old)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), Scratch(spark, "alignment"))
