"""Token block files, tokenizer alignment and centroids against plain versions of the same."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lobspark.llm import alignment, centroids, token_blocks
from lobspark.llm.alignment import PlainEncoder, Vocabularies
from lobspark.llm.common import tokenizer_path
from lobspark.llm.tokens import Encoder, paths

FILES = (*paths(), tokenizer_path("piece_bpe_32k.model"))
RNG = random.Random(11)


def sentence(n):
    return " ".join(RNG.choice(["cat", "été", "naïve", "under", "x9", "größe,", "(a)", "42", "won't"]) for _ in range(n))


TEXTS = [
    None, "", " ", "  ", "\n", "word", "two  spaces", " leading", "trailing ", "tab\there", "line\nline \n next", "a b c",
    "<|endoftext|> stays <s> plain </s> <unk> <0x41>", "mark ▁ here", "▁", "x▁ y", "zero\x00byte", "no break", "　wide", "é \U0001f600 ｆｕｌｌ",
    "don't they're", "aaaa" * 300, "ab" * 3000, "1234567890" * 20, sentence(3000), sentence(40), sentence(40) + "  " + sentence(3),
]
ROWS = [*enumerate(TEXTS), (7, TEXTS[-1]), (7, TEXTS[-1]), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.selectExpr("doc_id", "text", "'x' AS hash", "1 AS row", "'y' AS content", "2 AS chunk", "'k' AS kind", "3 AS n_a")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# token blocks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(1, 400)), max_size=12), st.floats(0.5, 1.0))
def test_blocks_round_trip(parts, share):
    ids = np.concatenate([np.zeros(0, np.uint32), *(np.full(n, v, np.uint32) ^ np.arange(n, dtype=np.uint32) % 7 for v, n in parts)])
    raw, starts = token_blocks.pack(ids, share)
    assert len(starts) == -(-len(ids) // token_blocks.BLOCK)
    assert (token_blocks.unpack(raw, starts) == ids).all()


def test_outliers_are_exceptions():
    """A block of small ids with a few large ones takes the small ones' width, and the whole ids come back."""
    ids = np.arange(1024, dtype=np.uint32) % 8 + 100
    ids[[5, 700]] = 50_000, 2**32 - 1
    raw, starts = token_blocks.pack(ids)
    low, width, n, exceptions = token_blocks.HEAD.unpack_from(raw, 0)
    assert (low, width, n, exceptions) == (100, 3, 1024, 2)
    assert len(raw) == token_blocks.HEAD.size + 1024 * 3 // 8 + 2 * 6
    assert (token_blocks.unpack(raw, starts) == ids).all()


def test_any_run_of_a_file_needs_only_its_blocks():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 50_257, n).astype(np.uint32) for n in (3, 5000, 1, 1024)]
    raw = token_blocks.file_bytes([4, None, -1, 9], parts, 2, 1, 77) + token_blocks.END
    f, every = token_blocks.TokenFile(raw), np.concatenate(parts)
    assert (f.part, f.number, f.before, f.doc_ids, f.sizes.tolist()) == (2, 1, 77, [4, None, -1, 9], [3, 5000, 1, 1024])
    for a, b in ((0, 1), (1023, 1025), (1024, 2048), (5000, 6028), (10, 10), (6000, 9999)):
        assert (f.ids(a, b) == every[a:b]).all()
    broken = bytearray(raw)
    broken[: int(f.starts[1])] = bytes(int(f.starts[1]))  # the first block gone: later runs still read
    assert (token_blocks.TokenFile(bytes(broken)).ids(2000, 2100) == every[2000:2100]).all()
    for bad in (raw[:-1], raw[:20], b"", b"PFRB\n"):
        with pytest.raises(ValueError):
            token_blocks.TokenFile(bad)


@pytest.mark.parametrize("file_ids", [1, 500, 1 << 20])
def test_token_files(spark, docs, tmp_path, file_ids):
    path = str(tmp_path / "out")
    token_blocks.write_token_blocks(docs, path, file_ids=file_ids)
    got = token_blocks.read_token_blocks(spark, path).collect()
    encoder = Encoder.of(*paths())
    want = collections.Counter((i, tuple([*encoder.slow.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in ROWS)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    sums = {(r.start, r.ids_crc32) for r in token_blocks.read_token_blocks(spark, path, checksums=True).collect()}
    assert sums == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}


def test_token_files_of_one_id(spark, tmp_path):
    """An id of very many rows is written by many tasks."""
    path = str(tmp_path / "out")
    token_blocks.write_token_blocks(spark.range(4000).selectExpr("5L AS doc_id", "concat('text ', id) AS text"), path)
    rows = token_blocks.read_token_blocks(spark, path)
    assert rows.count() == 4000
    assert rows.selectExpr("count(DISTINCT start) AS n").first().n == 4000
    assert spark.read.format("binaryFile").load(path).where("length > 0").count() == 4


def test_no_token_files(spark, empty, tmp_path):
    path = str(tmp_path / "out")
    token_blocks.write_token_blocks(empty, path)
    assert token_blocks.read_token_blocks(spark, path).count() == 0


# alignment


def aligned_plainly(rows):
    v = Vocabularies.of(*FILES)
    slow = PlainEncoder.of(*paths()).slow
    docs = []
    for i, t in rows:
        a, b, raw = ([], [], b"") if not t else (slow.encode(" " + t, add_special_tokens=False).ids, v.b.encode(t), (" " + t).encode())
        if b"".join(v.a_bytes[x] for x in a) != raw or b"".join(v.b_bytes[x] for x in b) != raw:
            a, b = [], []
        linked, groups, x, y, x0, y0, ea, eb = [], [], 0, 0, 0, 0, 0, 0
        while x < len(a):
            linked.append((a[x], b[y]))
            na, nb = ea + len(v.a_bytes[a[x]]), eb + len(v.b_bytes[b[y]])
            if na == nb:
                groups.append((a[x0 : x + 1], b[y0 : y + 1]))
                x0, y0 = x + 1, y + 1
            if na <= nb:
                x, ea = x + 1, na
            if nb <= na:
                y, eb = y + 1, nb
        docs.append((i, len(a), len(b), groups, linked))
    count = collections.Counter(p for d in docs for p in set(d[4]))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    text = lambda g: ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
    return collections.Counter(
        (i, na, nb, len(g), len(k), sum(count[p] == top[p[0]] for p in k), sum(count[p] for p in k), hashlib.sha256(text(g).encode()).hexdigest() if g else "") for i, na, nb, g, k in docs
    )


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("chunk", [1, 700, 1 << 20])
def test_alignment(docs, chunk):
    got = alignment.aligned(docs, chunk_bytes=chunk).select(*NAMES).collect()
    want = aligned_plainly(ROWS)
    assert collections.Counter(map(tuple, got)) == want
    assert sum(w[1] == 0 for w in want) >= 4 and sum(w[3] < w[4] for w in want) >= 10


def test_alignment_with_hot_groups(docs, monkeypatch):
    monkeypatch.setattr("lobspark.llm.common.LEAST_HOT", 1)
    monkeypatch.setattr("lobspark.llm.common.MOST_HOT", 100)
    assert collections.Counter(map(tuple, alignment.aligned(docs, chunk_bytes=300).select(*NAMES).collect())) == aligned_plainly(ROWS)


def test_alignment_of_an_empty_table(empty):
    assert alignment.aligned(empty).count() == 0


def test_words_are_encoded_as_in_their_text():
    v = Vocabularies.of(*FILES)
    assert v.cuttable
    for t in TEXTS:
        if t and "▁" not in t:
            words = v.words(t)
            a, b, n_a, n_b = v.encoded(words)
            assert a.tolist() == v.a.slow.encode(" " + t, add_special_tokens=False).ids and b.tolist() == v.b.encode(t)
            assert n_a.sum() == len(a) and len(n_b) == len(words)
    a, _, n_a, n_b = v.encoded(["fine", "not▁so", "fine"])
    assert n_a[1] == n_b[1] == 0 and n_a[0] == n_a[2] > 0


def test_groups_with_equal_hashes(monkeypatch):
    """Groups are compared by their ids where a hash says they are equal."""
    monkeypatch.setattr(alignment, "span_hash", lambda s, a, b: np.zeros(len(a), np.uint64))
    a, b = np.array([1, 2, 1, 3], np.uint32), np.array([1, 2, 1, 4], np.uint32)
    first, number = alignment.interned(alignment.Groups(a, b, np.arange(1, 5), np.arange(1, 5)))
    assert number.tolist() == [0, 1, 0, 2] and first.tolist() == [0, 1, 3]


def test_keys_round_trip():
    g = alignment.Groups(np.array([1, 2, 3, 70_000], np.uint32), np.array([9, 8, 7], np.uint32), np.array([3, 4]), np.array([1, 3]))
    back = alignment.of_keys(alignment.keys(g))
    assert all((x == y).all() for x, y in zip(g, back, strict=True))


# centroids


def clustered_plainly(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    now = [v for _, v in first]

    def own(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, v in kept:
            of[own(v)[1]].append(v)
        now = [[sum(x) // len(of[j]) for x in zip(*of[j], strict=True)] if of[j] else c for j, c in enumerate(now)]
    got = [(i, *reversed(own(v))) for i, v in kept]
    sums = collections.Counter()
    for _, j, d in got:
        sums[j] += d
    return collections.Counter((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest()) for i, j, d in got)


VECTORS = [(i, [RNG.choice([0.0, 0.25, -0.5, 1.0]) + RNG.random() * (i % 3) / 10 for _ in range(8)]) for i in range(120)]
VECTORS += [(3, VECTORS[3][1]), (3, VECTORS[9][1]), (None, VECTORS[5][1]), (None, VECTORS[6][1])] + [(200 + i, [0.5] * 8) for i in range(60)]
VECTORS += [(300, None), (301, []), (302, [0.1] * 7), (303, [0.1] * 9), (304, [None] + [0.1] * 7), (305, [float("nan")] * 8), (306, [float("inf")] + [0.0] * 7)]


@pytest.mark.parametrize("k,rounds", [(1, 2), (7, 5), (40, 3), (500, 1), (7, 0)])
def test_centroids(spark, k, rounds):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").repartition(3).selectExpr("vec_id", "embedding", "1 AS cluster", "'x' AS v", "2 AS n")
    got = centroids.clustered(df, k, rounds, dims=8).collect()
    assert collections.Counter(map(tuple, got)) == clustered_plainly(VECTORS, k, rounds, 8)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(1, 9), st.integers(1, 4), st.integers(0, 2**32))
def test_nearest_is_exact_and_takes_the_smaller_of_equals(dims, k, values, seed):
    rng = np.random.default_rng(seed)
    v, c = rng.integers(-values, values + 1, (30, dims)), rng.integers(-values, values + 1, (k, dims))
    own, d = centroids.nearest(v, c)
    every = ((v[:, None] - c) ** 2).sum(axis=2)
    assert (own == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()


def test_centroids_of_nothing(spark):
    df = spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<double>")
    assert centroids.clustered(df).count() == 0
    assert centroids.clustered(df.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_exact_distances():
    with pytest.raises(ValueError):
        centroids.integers(pa.array([[1e9] * 2]), 2, 256)
    right, v = centroids.integers(pa.array([[-0.001, 1.0], None, [1.0]], pa.list_(pa.float32())), 2, 256)
    assert right.tolist() == [True, False, False] and v.tolist() == [[-1, 256]]
