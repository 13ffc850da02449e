"""Secret scan with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of its text). The ledger
lists the pairs of blob and rule version that earlier runs have scanned; only
unseen pairs are scanned, once for each blob, and their findings are joined back to
all paths that carry the blob. The new pairs are returned for the next run's ledger.

Positions come from splitting a text at its matches: the lengths of pieces and
matches add up to starts and ends in code points. Texts without a match, told by one
``rlike``, are never split.

Defined results: a null text is the empty text and has no finding; its hashes are
those of the empty string. Repeated rows get equal results. Rows with a null doc_id are
scanned as well. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.llm.base import Scratch, join_spread, sized, table

RULE_VERSION = 1
#: kind, pattern, is it a base kind. A pattern's matches are leftmost and don't overlap.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True),
    ("access", r"AKIA[A-Z0-9]{16,}", True),
    ("hex", r"[0-9a-f]{24,}", True),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", False),
    ("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", False),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", False),
)
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
_STEP = "array<struct<rank:int,kind:string,at:int,gap:int,size:int,ok:boolean>>"


def steps_of(kind: str, pattern: str, rank: int) -> Column:
    """Of one kind in ``text``: what lies before each match and the match itself, as lengths, with the rest of the text as the last."""
    pieces, matches = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    long_enough = F.transform(matches, lambda m: F.length(F.regexp_extract(m, pattern, 1)) >= 6 if kind == "assign" else F.lit(True))
    steps = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(matches, F.length).alias("size"), long_enough.alias("ok"))
    numbered = F.transform(steps, lambda x, i: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), i.alias("at"), x["gap"].alias("gap"), x["size"].alias("size"), x["ok"].alias("ok")))
    return F.when(F.col("text").rlike(pattern), numbered).otherwise(F.array().cast(_STEP))


def scan(blobs: DataFrame) -> DataFrame:
    """(blob, spans) of blobs(blob, text) that have a span, sorted by start and kind. Only lengths leave the scan; running sums of them are the places."""
    steps = F.concat(*[steps_of(kind, pattern, i) for i, (kind, pattern, _) in enumerate(RULES)])
    # the condition names the blob too, so that it isn't pushed below the join that leaves the unseen ones
    possible = F.when(F.col("blob").isNotNull(), F.col("text")).rlike("|".join(p for _, p, _ in RULES))
    numbered = blobs.where(possible).select("blob", "text", F.monotonically_increasing_id().alias("row"))
    rows = numbered.select("blob", "row", F.explode_outer(steps).alias("s")).select("blob", "row", "s.*")  # explode would search the texts once more, in a filter of its own
    upto = Window.partitionBy("row", "rank").orderBy("at")
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(upto).cast("int"))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rank", "end", "kind")
    return ends.where("size is not null and ok").groupBy("row", "blob").agg(F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def scan_incremental(versions: DataFrame, scratch: Scratch, ledger: DataFrame | None = None, findings: DataFrame | None = None, rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """versions(doc_id, text) -> (doc_id, blob and spans of every version; ledger and findings with this run's added).

    ledger(blob, rule_version) and findings(blob, rule_version, spans) are those of earlier runs.
    """
    text = F.coalesce("text", F.lit(""))
    paths = scratch.save(versions.select("doc_id", F.unhex(F.sha2(text, 256)).alias("blob")), "paths")
    one = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    seen = None if ledger is None else ledger.where(F.col("rule_version") == rule_version).select("blob")
    unseen = scratch.save(one if seen is None else one.join(seen, "blob", "left_anti"), "unseen")
    own = versions.select(F.col("doc_id").alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("own"))
    texts = own.join(unseen, own.id.eqNullSafe(unseen.doc_id) & (F.col("own") == F.col("blob")))  # both, so that versions of a path don't meet each other's blobs
    # only here are texts searched
    new = scratch.save(scan(texts.select("blob", "text")).dropDuplicates(["blob"]).select("blob", F.lit(rule_version).alias("rule_version"), "spans"), "findings")
    added = unseen.select("blob", F.lit(rule_version).alias("rule_version"))
    every = new if findings is None else findings.unionByName(new)
    current = every.where(F.col("rule_version") == rule_version).select("blob", "spans")
    # paths without a finding need no join, and those of one common blob meet its finding in several places
    found = sized(scratch.save(current.select("blob"), "found"))
    hit = join_spread(paths.join(found, "blob", "left_semi").withColumn("_path", F.monotonically_increasing_id()), current, "blob", "_path", scratch, "hit").select("doc_id", "blob", "spans")
    joined = hit.unionByName(paths.join(found, "blob", "left_anti").select("doc_id", "blob", F.array().cast(_SPAN).alias("spans")))
    return joined, added if ledger is None else ledger.unionByName(added), every


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: one over the versions of even ids, and one over all that scans what the first one's ledger hasn't seen."""
    scratch, documents = Scratch(spark, "secrets"), table(spark, sf_dir, "documents").select("doc_id", "text")
    _, ledger, findings = scan_incremental(documents.where("doc_id % 2 = 0"), scratch)
    found, _, _ = scan_incremental(documents, Scratch(spark, "secrets-again"), scratch.save(ledger, "ledger"), findings)
    base = [kind for kind, _, is_base in RULES if is_base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, base), F.sha2(_listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
