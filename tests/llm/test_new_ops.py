"""Top-k search, importance resampling and alignment against brute force, with odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from strandmill.llm import alignment, importance, top_k
from strandmill.llm.base import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- top-k ---------------------------------------------------------------------


def best_of(rows, queries, k):
    want = []
    for qid, q in sorted(queries.items()):
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != qid and len(v) == len(q))
        want += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return want


@pytest.mark.parametrize("size", [(1024, 256, 32), (7, 3, 2)])
def test_top_k_brute_force(spark, monkeypatch, size):
    for name, n in zip(("ROWS", "QUERIES", "SLICE"), size, strict=True):
        monkeypatch.setattr(top_k, name, n)
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.integers(-40, 40, 37).astype(float).tolist()) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(150, 190)]  # many ties
    rows += [(190, [0.0] * 37), (191, [1.0, 2.0]), (192, [3.0, 1.0]), (7, rows[9][1])]
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [float("nan")] * 37), (204, [float("inf")] + [0.0] * 36), (None, rows[0][1])]
    v = spark.createDataFrame(rows + odd, "id long, v array<double>")
    asked = {i: x for i, x in rows if i % 10 == 0 or i in (150, 191)}
    got = top_k.top_k(v.where("id % 10 = 0 or id in (150, 191)"), v, 5, Scratch(spark, "t")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == best_of(rows, asked, 5)


def test_top_k_empty(spark):
    v = spark.createDataFrame([], "id long, v array<double>")
    assert top_k.top_k(v, v, 5, Scratch(spark, "t")).collect() == []
    one = spark.createDataFrame([(50, [1.0])], "id long, v array<double>")
    assert top_k.top_k(one, one, 5, Scratch(spark, "t")).collect() == []


def test_top_k_drops_candidates():
    """Bounds leave few candidates for the last dimensions where weight lies in the first ones."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 64)) * np.r_[np.full(16, 100.0), np.full(48, 1.0)]
    q = top_k._Query(x[0], 0, 5)
    cells = np.ascontiguousarray(x.T)
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            out = np.asarray(super().__getitem__(at))
            read.append(out.size)
            return out

    q.meet(np.arange(100), cells[:, :100], (x[:100] ** 2).sum(1))
    q.meet(np.arange(100, 2000), cells[:, 100:].view(Counted), (x[100:] ** 2).sum(1))
    scores = x @ x[0]
    scores[0] = -np.inf
    assert q.vid.tolist() == np.argsort(-scores, kind="stable")[:5].tolist()
    assert sum(read) < 0.5 * 1900 * 64


# --- importance ------------------------------------------------------------------


def features(text):
    w = WORD.findall((text or "").translate(UPPER))
    return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def noise(doc_id):
    h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def expected(docs, items, percent=5):
    s, t = Counter(), Counter()
    made = [(i, *features(x)) for i, x in docs]
    for _, _, f in made:
        s.update(f)
    for x in items:
        t.update(features(x)[1])
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T + 10000.0)))) for b in range(10000)]
    rows = [[i, len(f), sum(gain[b] for b in f), None, None, len(w)] for i, w, f in made]
    for r in rows:
        if r[0] is not None:
            r[3] = r[2] + noise(r[0])
    may = sorted((r for r in rows if r[5] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for n, r in enumerate(may[: len(may) * percent // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def importance_docs():
    rng = random.Random(3)
    vocab = [f"Wort{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.choice([5, 19, 20, 60])))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, ".,;"), (303, "ÀB c"), (None, docs[0][1]), (304, " ".join(rng.choices(vocab, k=30000)))]
    docs += [(305, docs[3][1] + " same"), (305, docs[3][1] + " same")]
    return docs


def test_importance_brute_force(spark):
    docs, items = importance_docs(), ["w1 w2 w3 w4", "Wort7é w1 w2", None, ""]
    d = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in docs], DOCS).withColumnsRenamed({"lang": "words", "source": "buckets"})
    t = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "item_id long, text string")
    scratch = Scratch(spark, "t")
    got = importance.drawn(scratch.save(importance.scored(d, t), "scores"), scratch).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(docs, items)


def test_importance_ties_and_one_hot_score(spark):
    """All scores equal: ranks go by doc_id, without gaps."""
    scores = spark.createDataFrame([(i, 20, 1, 0, 7) for i in range(1000)], "doc_id long, n_words long, n_features long, weight long, score long")
    got = importance.drawn(scores, Scratch(spark, "t"), percent=30).where("rank is not null").collect()
    assert sorted((r["rank"], r.doc_id) for r in got) == [(i + 1, i) for i in range(300)]


def test_importance_empty(spark):
    d, t = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    scratch = Scratch(spark, "t")
    assert importance.drawn(scratch.save(importance.scored(d, t), "scores"), scratch).collect() == []
    d = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS)
    row = importance.drawn(scratch.save(importance.scored(d, t), "one"), scratch).first()
    assert (row.n_features, row["rank"]) == (3, None)


# --- alignment -------------------------------------------------------------------

FOLDER = alignment.TOKENIZERS
TEXTS = [
    "Hello world, this is a test.", "Ärger über Öl — naïve café", "x", " ", "  two  spaces\n\n\ttab ", "日本語のテキスト", "😀😀 smile", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "▁literal", "ﬁ ligature ½ Ⅷ", "a\u0000b", "é decomposed é", " nbsp　wide", "the the the the", "=" * 500, "ab" * 3000, "1234567890 " * 40, "don't they'll I'm", "\r\nline\r\n", "ß" * 50,
]


@pytest.fixture(scope="module")
def plain_tokenizers():
    import sentencepiece

    a = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}
    a_bytes = {i: bytes(byte_of[c] for c in token) if i != 50256 else token.encode() for token, i in a.get_vocab().items()}
    return a, a_bytes, sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")


def plain_groups(text, both):
    a, a_bytes, b = both
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    pieces = [b.id_to_piece(i) for i in ids_b]
    b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
    whole = (" " + text).encode()
    if b"".join(a_bytes[i] for i in ids_a) != whole or b"".join(b_bytes) != whole:
        return []
    ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
    ea, eb = ends(a_bytes[i] for i in ids_a), ends(b_bytes)
    out, low = [], 0
    for cut in sorted(set(ea) & set(eb)):
        out.append(([i for i, e in zip(ids_a, ea, strict=True) if low < e <= cut], [i for i, e in zip(ids_b, eb, strict=True) if low < e <= cut]))
        low = cut
    return out


def plain_alignment(texts, both):
    made = [plain_groups(t, both) for t in texts]
    count = Counter()
    links = [[(x, y) for a, b in g for x in a for y in b] for g in made]
    for pairs in links:
        count.update(set(pairs))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for g, pairs in zip(made, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(pairs), sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


@pytest.mark.parametrize("form", ["align", "align_relational", "small bounds"])
def test_alignment_brute_force(spark, plain_tokenizers, monkeypatch, form):
    if form == "small bounds":
        monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 40)
        monkeypatch.setattr(alignment, "LISTED_LINKS", 2)
        form = "align"
    some = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY length(text) LIMIT 60").fetchall()]
    texts = [*TEXTS, *some, None, "", some[-1], some[-1]]
    d = spark.createDataFrame([(i if i < len(texts) - 1 else i - 1, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).withColumnsRenamed({"lang": "key", "source": "n_a"})
    got = getattr(alignment, form)(d, Scratch(spark, "t")).collect()
    want = [(i if i < len(texts) - 1 else i - 1, *row) for i, row in enumerate(plain_alignment(texts, plain_tokenizers))]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(row[1] > 0 for row in want) > 60


def test_alignment_empty(spark):
    for form in (alignment.align, alignment.align_relational):
        assert form(spark.createDataFrame([], DOCS), Scratch(spark, "t")).collect() == []


def test_same_vocabulary(plain_tokenizers):
    """The rank file gives the ids of the JSON file, on odd and on long texts."""
    a = plain_tokenizers[0]
    both = alignment._Pair(FOLDER)
    for text in [*TEXTS, "a" * 100_000, " " * 20_000, "\n" * 3000, "x y " * 10_000]:
        assert both.a.encode_ordinary(" " + text) == a.encode(" " + text, add_special_tokens=False).ids
