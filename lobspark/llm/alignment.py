"""Operator 12: how the tokens of two vocabularies line up, by a dictionary of the distinct groups between common ends.

A single space between characters that are neither white space nor the mark for one (U+2581) is a token start in both
vocabularies, so what stands between two of them, a word as a rule, is encoded on its own and once a chunk of documents.
Its tokens are cut into groups where both vocabularies end one. Distinct groups are interned; their links are expanded
once a distinct group; a document counts once for each id pair it holds linked. The counts by pair are summed up over all
chunks, looked up once for each distinct group of all documents, and come back to the chunks by the group's key, which
is the group's ids. A chunk has a row for each of its distinct groups, so a group in every text is one row a chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lobspark.llm.common import joined_unevenly, powers, runs, same_spans, span_hash, stored, table, tokenizer_path
from lobspark.llm.tokens import UNUSUAL, Encoder, paths

#: Bytes of text in a chunk, or more if one document has more.
CHUNK_BYTES = 6 << 20

#: Characters of words that are encoded in one call.
CALL = 1 << 18

#: The mark that some vocabularies have for a space.
MARK = "▁"
_CUT = re.compile(rf"(?<=[^\s{MARK}]) (?=[^\s{MARK}])")
_BESIDE = [p for c in map(chr, range(1 << 16)) if c == MARK or re.match(r"\s", c) for p in {c + " ", " " + c}]


def words(text: str) -> list[str]:
    """The text cut at the spaces beside which is neither white space nor MARK, nor an end of the text."""
    odd = text[:1] == " " or text[-1:] == " " or any(p in text for p in _BESIDE)
    return _CUT.split(text) if odd else text.split(" ")


def is_unusual(word: str) -> bool:
    return not (word.isascii() and word.isprintable() and "<" not in word) and UNUSUAL.search(word) is not None


class Numbers(dict):
    """Numbers its keys in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class PlainEncoder(Encoder):
    """Special tokens' strings in a text are ordinary text."""

    _made: dict[tuple[str, str], Encoder] = {}

    def __init__(self, json_path: str, ranks_path: str):
        super().__init__(json_path, ranks_path)
        self.slow.encode_special_tokens = True


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 ones for themselves, the
    others, in order, as the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers, and each token's bytes; built once in a worker."""

    _made: dict[tuple[str, str, str], Vocabularies] = {}

    def __init__(self, json_path: str, ranks_path: str, model_path: str):
        import sentencepiece

        self.a = PlainEncoder.of(json_path, ranks_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        of = byte_level()
        size = self.a.slow.get_vocab_size()
        entries = (self.a.slow.id_to_token(i) or "" for i in range(size))
        self.a_bytes = [bytes(of[c] for c in e) if all(c in of for c in e) else e.encode() for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        #: Whether no piece goes over the start of a word.
        self.cuttable = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    @classmethod
    def of(cls, *key: str) -> Vocabularies:
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def words(self, text: str) -> list[str]:
        return words(text) if self.cuttable else [text]

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words' ids in both vocabularies, one word after the other, and how many each has.

        A word with other bytes in either than a space and itself has none.
        """
        out, at = [], 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (size < CALL or end == at):
                size, end = size + len(words[end]) + 1, end + 1
            out += self._together(words[at:end])
            at = end
        none = np.zeros(0, np.uint32)
        return tuple(np.concatenate([none if k < 2 else none.astype(np.int64), *(x[k] for x in out)]) for k in range(4))

    def _together(self, words: list[str]) -> list[tuple[np.ndarray, ...]]:
        text = " ".join(words)
        a, b, raw = self.a.ids(" " + text), np.array(self.b.encode(text), np.uint32), b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b.tolist())):
            word_ends = np.cumsum([len(w) + 1 if w.isascii() else len(w.encode()) + 1 for w in words])
            ends = [np.cumsum(size[x]) for x, size in ((a, self.a_size), (b, self.b_size))]
            last = [np.searchsorted(e, word_ends) for e in ends]
            if all((e[k] == word_ends).all() for e, k in zip(ends, last, strict=True)):
                return [(a, b, *(np.diff(k + 1, prepend=0) for k in last))]
        if len(words) == 1:
            none = np.zeros(1, np.int64)
            return [(a[:0], b[:0], none, none)]
        half = len(words) // 2
        return self._together(words[:half]) + self._together(words[half:])


class Groups(NamedTuple):
    """Groups of two flat arrays of ids: where each group's ids end, and the ids' byte sizes."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray

    @property
    def a_start(self) -> np.ndarray:
        return np.append(0, self.a_end[:-1])[: len(self.a_end)]

    @property
    def b_start(self) -> np.ndarray:
        return np.append(0, self.b_end[:-1])[: len(self.b_end)]


def cut(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> Groups:
    """The groups of two id sequences with the same bytes."""
    ea, eb = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    common = np.intersect1d(ea, eb, assume_unique=True)
    return Groups(a, b, np.searchsorted(ea, common) + 1, np.searchsorted(eb, common) + 1)


def links(g: Groups, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping pairs of the groups, as a * 2**32 + b, and each one's group.

    Between two neighbouring ends of either kind lie one A and one B token, and each pair that overlaps does so
    in one such stretch.
    """
    ea, eb = np.cumsum(a_size[g.a]), np.cumsum(b_size[g.b])
    ends = np.union1d(ea, eb)
    ia, ib = np.searchsorted(ea, ends), np.searchsorted(eb, ends)
    return g.a[ia].astype(np.int64) << 32 | g.b[ib].astype(np.int64), np.searchsorted(g.a_end, ia, side="right")


_VALUE = np.random.Generator(np.random.PCG64(20250115)).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sums(ids: np.ndarray, salt: int) -> np.ndarray:
    s = np.zeros(len(ids) + 1, np.uint64)
    values = _VALUE[ids & 0xFFFF] * (ids.astype(np.uint64) * np.uint64(2) + np.uint64(salt))
    np.cumsum(values * powers(len(ids))[0][: len(ids)], out=s[1:])
    return s


def interned(g: Groups) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct group, and each group's number among them. Equal hashes are compared by their ids."""
    n = len(g.a_end)
    h = span_hash(_sums(g.a, 1), g.a_start, g.a_end) * np.uint64(0x9E3779B97F4A7C15) ^ span_hash(_sums(g.b, 3), g.b_start, g.b_end)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    own = first[number]
    a, b = g.a.view(np.uint8), g.b.view(np.uint8)
    if same_spans(a, 4 * g.a_start, 4 * g.a_end, 4 * g.a_start[own], 4 * g.a_end[own]).all() and same_spans(b, 4 * g.b_start, 4 * g.b_end, 4 * g.b_start[own], 4 * g.b_end[own]).all():
        return first, number
    seen: dict[tuple[bytes, bytes], int] = {}
    number = np.array([seen.setdefault((g.a[p:q].tobytes(), g.b[r:s].tobytes()), len(seen)) for p, q, r, s in zip(g.a_start, g.a_end, g.b_start, g.b_end, strict=True)], np.int64)
    first = np.full(len(seen), n)
    np.minimum.at(first, number, np.arange(n))
    return first, number


def keys(g: Groups) -> list[bytes]:
    """Each group's key: how many A ids, then all ids, 32 bits each."""
    flat = [x.astype("<u4").tobytes() for x in (g.a, g.b)]
    return [(q - p).to_bytes(4, "little") + flat[0][4 * p : 4 * q] + flat[1][4 * r : 4 * s] for p, q, r, s in zip(g.a_start.tolist(), g.a_end.tolist(), g.b_start.tolist(), g.b_end.tolist(), strict=True)]


def of_keys(raw: list[bytes]) -> Groups:
    each = [np.frombuffer(k, "<u4") for k in raw]
    a, b = [k[1 : 1 + k[0]] for k in each], [k[1 + k[0] :] for k in each]
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return Groups(flat(a), flat(b), np.cumsum([len(x) for x in a], dtype=np.int64), np.cumsum([len(x) for x in b], dtype=np.int64))


class Chunk:
    """Documents met together: their words, the words' groups, and the distinct groups' links."""

    def __init__(self, texts: list[str | None], v: Vocabularies):
        numbers = Numbers()
        docs = [np.array(list(map(numbers.__getitem__, v.words(t))), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        unusual = np.array([is_unusual(w) for w in numbers], bool)  # these go to the slower library, apart from the others
        order, words = np.argsort(unusual, kind="stable"), list(numbers)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        a, b, self.n_a, self.n_b = v.encoded([words[k] for k in order.tolist()])
        self.docs = [r if self.n_a[r := rank[d]].all() else r[:0] for d in docs]
        g = cut(a, b, v.a_size, v.b_size)
        first, self.group = interned(g)
        word_end = np.searchsorted(g.a_end, np.cumsum(self.n_a), side="right")  # a word's end ends a group
        self.word_end, self.word_start = word_end, np.append(0, word_end[:-1])[: len(word_end)]
        a_start, b_start = g.a_start, g.b_start
        pick = lambda x, s, e: x[runs(s[first], e[first])]
        self.groups = Groups(pick(g.a, a_start, g.a_end), pick(g.b, b_start, g.b_end), np.cumsum((g.a_end - a_start)[first]), np.cumsum((g.b_end - b_start)[first]))
        self.pairs, number, of = self._links(v)
        self.n_links = np.bincount(of, minlength=len(first))
        self.link, self.link_end = number, np.cumsum(self.n_links)

    def _links(self, v: Vocabularies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair, of = links(self.groups, v.a_size, v.b_size)
        distinct, number = np.unique(pair, return_inverse=True)
        return distinct, number, of

    def by_word(self, of_group: np.ndarray) -> np.ndarray:
        """The sum over each word's groups."""
        s = np.append(0, np.cumsum(of_group[self.group]))
        return s[self.word_end] - s[self.word_start]

    def documents_of_pairs(self) -> np.ndarray:
        """How many of the chunk's documents hold each pair linked."""
        out = np.zeros(len(self.pairs), np.int64)
        word, group, pair = (np.zeros(n, np.int64) for n in (len(self.n_a), len(self.n_links), len(self.pairs)))
        link_start = self.link_end - self.n_links

        def distinct(x: np.ndarray, last: np.ndarray) -> np.ndarray:
            at = np.arange(len(x))
            last[x] = at
            return x[last[x] == at]

        for d in self.docs:
            w = distinct(d, word)
            g = distinct(self.group[runs(self.word_start[w], self.word_end[w])], group)
            out[distinct(self.link[runs(link_start[g], self.link_end[g])], pair)] += 1
        return out

    def strings(self) -> list[str]:
        """Each word's groups as text."""
        g = self.groups
        a, b = g.a.astype(str).tolist(), g.b.astype(str).tolist()
        each = [f"{','.join(a[p:q])}|{','.join(b[r:s])}" for p, q, r, s in zip(g.a_start.tolist(), g.a_end.tolist(), g.b_start.tolist(), g.b_end.tolist(), strict=True)]
        number = self.group.tolist()
        return [";".join([each[k] for k in number[s:e]]) for s, e in zip(self.word_start.tolist(), self.word_end.tolist(), strict=True)]


#: What the first pass writes. kind d: a document, its words' numbers in data. w: a chunk's words, in data where each
#: one's groups end and then their numbers. g: a chunk's distinct group, its key in data. p: an id pair, n documents.
PASS = "kind string, chunk long, no long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, data binary, pair long, n long"
NAMES = [c.split()[0] for c in PASS.split(", ")]
KINDS = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in PASS.split(", ")]


def _rows(kind: str, size: int, **columns) -> pa.RecordBatch:
    columns |= {"kind": [kind] * size}
    arrays = [pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(NAMES, KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, NAMES)


def _first_pass(doc_ids: list[int | None], texts: list[str | None], chunk: int, v: Vocabularies) -> Iterator[pa.RecordBatch]:
    c = Chunk(texts, v)
    n_groups, n_links, strings = c.word_end - c.word_start, c.by_word(c.n_links), c.strings()
    hashes = [hashlib.sha256(";".join([strings[w] for w in d.tolist()]).encode()).hexdigest() if len(d) else "" for d in c.docs]
    of = lambda values: [int(values[d].sum()) for d in c.docs]
    yield _rows("d", len(texts), chunk=[chunk] * len(texts), doc_id=doc_ids, n_a=of(c.n_a), n_b=of(c.n_b), n_groups=of(n_groups), n_links=of(n_links), groups_sha256=hashes, data=[d.astype("<u4").tobytes() for d in c.docs])
    words = np.concatenate([[len(c.word_end)], c.word_end, c.group]).astype("<u4")
    yield _rows("w", 1, chunk=[chunk], data=[words.tobytes()])
    key = keys(c.groups)
    for k in range(0, len(key), 50_000):
        part = key[k : k + 50_000]
        yield _rows("g", len(part), chunk=np.full(len(part), chunk), no=np.arange(k, k + len(part)), data=part)
    documents = c.documents_of_pairs()
    some = np.flatnonzero(documents)
    for k in range(0, len(some), 50_000):
        at = some[k : k + 50_000]
        yield _rows("p", len(at), pair=c.pairs[at], n=documents[at])


def aligned(docs: DataFrame, files: tuple[str, str, str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each row of ``docs``: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    files: the first vocabulary as JSON and as ranks, and the second one's model. A text that is null or empty, or whose
    tokens' bytes in either vocabulary are not a space and the text, has no tokens: zeros, and '' for the hash. Rows without
    doc_id, or with one that occurs again, are documents of their own. A task works on chunks of some ``chunk_bytes``
    of text and holds one at a time; everything that leaves it is a row a document, distinct group or distinct pair.
    """
    files = files or (*paths(), tokenizer_path("piece_bpe_32k.model"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, part, number = Vocabularies.of(*files), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        texts: list[str | None] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= chunk_bytes:
                    yield from _first_pass(doc_ids, texts, part << 32 | number, v)
                    number, doc_ids, texts, size = number + 1, [], [], 0
        if texts:
            yield from _first_pass(doc_ids, texts, part << 32 | number, v)

    first = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, PASS))

    pairs = first.where("kind = 'p'").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))  # a row for each id of the second vocabulary at most
    pairs = stored(pairs.select("pair", "n", (F.col("n") == most).cast("long").alias("best")))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabularies.of(*files)
        for batch in batches:
            raw = batch.column(0).to_pylist()
            pair, of = links(of_keys(raw), v.a_size, v.b_size)
            for k in range(0, len(pair), 50_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[k : k + 50_000])), pa.array(pair[k : k + 50_000])], ("key", "pair"))

    in_chunks = first.where("kind = 'g'").select(F.col("chunk").alias("of"), "no", F.col("data").alias("key"))
    distinct = in_chunks.groupBy("key").agg(F.count("*").alias("n_chunks"))
    expanded = stored(distinct.mapInArrow(lambda b: expand(x.select(["key"]) for x in b), "key binary, pair long").groupBy("key", "pair").agg(F.count("*").alias("m")))
    n_expanded, n_in_chunks = expanded.count(), in_chunks.count()
    by_pair = expanded.groupBy("pair").agg(F.count("*").alias("rows")).join(pairs, "pair")
    valued = joined_unevenly(expanded, by_pair, "pair", "rows", n_expanded)
    valued = valued.groupBy("key").agg(F.sum(F.col("m") * F.col("n")).alias("count_sum"), F.sum(F.col("m") * F.col("best")).alias("n_best"))
    valued = stored(valued.join(distinct, "key"))
    back = joined_unevenly(in_chunks, valued, "key", "n_chunks", n_in_chunks).select("of", "no", "count_sum", "n_best")

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.column("kind")
        words = np.frombuffer(left.filter(pa.compute.equal(kind, "w")).column("data")[0].as_py(), "<u4").astype(np.int64)
        end, group = words[1 : 1 + words[0]], words[1 + words[0] :]
        docs = left.filter(pa.compute.equal(kind, "d"))
        sums = []
        for name in ("n_best", "count_sum"):
            of_group = np.zeros(right.num_rows, np.int64)
            of_group[right.column("no").to_numpy()] = right.column(name).to_numpy()
            s = np.append(0, np.cumsum(of_group[group]))
            of_word = s[end] - s[np.append(0, end[:-1])[: len(end)]]
            sums.append(pa.array([int(of_word[np.frombuffer(d.as_py(), "<u4")].sum()) for d in docs.column("data")], pa.int64()))
        names = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
        return pa.table([*(docs.column(c) for c in names), *sums, docs.column("groups_sha256")], [*names, "n_best", "count_sum", "groups_sha256"])

    left = first.where("kind IN ('d', 'w')").select("kind", "chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "data")
    return left.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(total, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
