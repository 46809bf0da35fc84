"""Finding the windows of texts that also occur elsewhere, without comparing all texts with all.

A window is a run of ``window`` units (words or bytes). Of the hashes of its runs of ``gram`` units the smallest is its
anchor: equal windows have equal anchors, and neighbouring windows mostly share one, so a text has about
2 / (window - gram + 2) anchors a unit. Windows whose anchor occurs once cannot be repeated. The others are cut out as
contexts (the text under neighbouring windows of one anchor); the contexts of one anchor meet in one shard, where equal
ones are merged and an operator's own method decides which windows came first. Everything is linear in the
texts: no pair of documents is ever formed, and the driver gets nothing.

Nothing that is common meets in one task. Of an anchor that a task sees more than once it sends one summary to where the
anchor is counted, and keeps the places aside, under a key of its own to which the verdict comes back. Equal contexts of
common anchors are merged in each task, those of hot ones are divided into single windows. Long texts are worked on in
segments, and text of a short period gives each of its windows once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import NOT_SPACE, checkpointed, gram_hash, joined_unevenly, mixed, prefix_hash, same_spans, sliding_min, span_hash, text_bytes, text_chunks, word_spans


@dataclass(frozen=True)
class Units:
    """window and gram in words (what ASCII white space separates) or bytes.

    other_document: a window is repeated only if a smaller doc_id has it; else an earlier start in its own document
    will do as well. hot: occurrences of an anchor above which its contexts are divided into single windows.
    """

    window: int
    gram: int
    words: bool
    other_document: bool
    hot: int = 2000


class Texts:
    """Some texts as units: ``first`` tells each text's first unit (and the total). Hashes are made where they are used."""

    def __init__(self, column: pa.Array, units: Units):
        self.data, self.offsets = text_bytes(column)
        if units.words:
            self.starts, self.ends, self.first = word_spans(self.data, self.offsets, NOT_SPACE)
        else:
            self.first = self.offsets
        self.units = units

    @cached_property
    def hashes(self) -> np.ndarray:
        """Of all units."""
        return span_hash(prefix_hash(self.data), self.starts, self.ends)

    @cached_property
    def grams(self) -> np.ndarray:
        if self.units.words:
            return gram_hash(self.hashes, self.units.gram)
        at = np.arange(max(0, len(self.data) - self.units.gram + 1))
        return mixed(span_hash(prefix_hash(self.data), at, at + self.units.gram))

    @cached_property
    def odd(self) -> np.ndarray:
        """How many of the words up to each one stand after more than one space."""
        if not len(self.starts):
            return np.zeros(0, np.int64)
        return np.cumsum(np.concatenate([[0], (self.starts[1:] - self.ends[:-1] != 1) | (self.data[self.ends[:-1]] != 0x20)]))

    @cached_property
    def windows(self) -> np.ndarray:
        return gram_hash(self.hashes, self.units.window)

    def first_within(self, a: int, n: int) -> list[tuple[int, int]]:
        """Of the n word windows from a on, those without an equal one before among them, as runs (start, how many).

        Windows of equal hash are compared by their bytes; where these differ both stay.
        """
        _, first, kind = np.unique(self.windows[a : a + n], return_index=True, return_inverse=True)
        again = np.flatnonzero(first[kind] != np.arange(n))
        x, y = a + again, a + first[kind[again]]
        w = self.units.window - 1
        keep = np.ones(n, bool)
        keep[again[same_spans(self.data, self.starts[x], self.ends[x + w], self.starts[y], self.ends[y + w])]] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.view(np.int8), [0]])))
        return list(zip((a + edge[::2]).tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of neighbouring windows with one anchor: the anchor, the text, the first window's start, how many."""
        w, first = self.units.window, self.first
        m = sliding_min(self.grams, w - self.units.gram + 1)
        if not len(m):
            return m, *(np.zeros(0, np.int64),) * 3
        n = len(m)
        new = np.empty(n, bool)
        new[0], new[1:] = True, m[1:] != m[:-1]
        valid = np.ones(n, bool)
        for a, b in zip(np.maximum(first[:-1], first[1:] - w + 1).tolist(), first[1:].tolist(), strict=True):
            valid[a:b] = False
            if a < b < n:
                new[b] = True
        edges = np.flatnonzero(new | ~valid)
        many = np.diff(np.append(edges, n))
        own = valid[edges]
        edges, many = edges[own], many[own]
        self.m = m
        return m[edges], np.searchsorted(first, edges, side="right") - 1, edges, many

    def self_repeating(self, at: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Which of the runs have their anchor twice (text of a short period), and perhaps a window, too."""
        reach = self.units.window - self.units.gram + 1
        low = np.concatenate([np.zeros(reach - 1, np.uint64), self.m, np.zeros(reach - 1, np.uint64)])
        places = np.flatnonzero(self.grams == ~sliding_min(~low, reach))  # of all anchors
        twice = (np.diff(self.grams[places]) == 0) & (np.diff(places) <= reach)
        before = np.concatenate([[0], np.cumsum(twice)])
        lo, hi = np.searchsorted(places, at), np.searchsorted(places, at + many + reach - 1)
        return before[np.maximum(hi - 1, lo)] > before[lo]

    def cut(self, a: int, b: int) -> bytes:
        """Units a to b; words with one space between."""
        if not self.units.words:
            return self.data[a:b].tobytes()
        if self.odd[b - 1] == self.odd[a]:
            return self.data[self.starts[a] : self.ends[b - 1]].tobytes()
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True))


#: Bytes of text handled at once; with hashes at every place a byte takes a hundred for a moment.
CHUNK = 1 << 19

#: Anchors that a task gathers before it deals them out, and summaries that it holds.
FLUSH, SUMMARIES = 400_000, 200_000

#: Of the places that a task keeps aside, the groups that its anchors are dealt to.
GROUPS = 16

#: Occurrences of an anchor above which each task merges its equal contexts before they are shuffled, and the most
#: contexts that it holds for that.
WARM, MERGED = 16, 50_000


def segments(column: pa.Array, units: Units) -> Iterator[tuple[Texts, int, int | None]]:
    """The texts, or a single long one in segments: (texts, first, end), with the units where its windows begin.

    A segment has the windows that begin from unit ``first`` to unit ``end``, about CHUNK bytes of them; neighbours
    share what windows at the border need. Several texts come at once, with end None.
    """
    data, offsets = text_bytes(column)
    if len(column) != 1 or len(data) <= 2 * CHUNK:
        yield Texts(column, units), 0, None
        return
    if units.words:
        starts, ends, _ = word_spans(data, offsets, NOT_SPACE)
    n = len(starts) if units.words else len(data)
    at = 0
    while at + units.window <= n:
        end = max(int(np.searchsorted(starts, starts[at] + CHUNK)), at + 1) if units.words else at + CHUNK
        end = min(end, n - units.window + 1)
        last = end + units.window - 1
        part = data[starts[at] : ends[last - 1]] if units.words else data[at:last]
        yield Texts(pa.array([part.tobytes()], pa.large_binary()), units), at, end
        at = end


def packed_run(start: np.ndarray, n: np.ndarray, heat: np.ndarray) -> np.ndarray:
    return start << 32 | n << 2 | heat  # a text has less than 2**31 bytes, a run no more windows than a segment


def unpacked_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of each list, and all runs' starts, lengths and heats, by start within a list."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    v = v[np.lexsort((v, np.repeat(np.arange(len(sizes)), sizes)))]
    return np.concatenate([[0], np.cumsum(sizes)]), v >> 32, v >> 2 & (1 << 30) - 1, v & 3


def _planes(v: np.ndarray) -> bytes:
    """Fixed-width integers byte plane by byte plane, which general compression shortens well."""
    return np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T).tobytes()


def _unplanes(raw: bytes, n: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, n).T).view(kind)[:, 0]


def packed_columns(*columns: np.ndarray) -> bytes:
    """Integers of any width, the same number of each; compressed where there are enough."""
    n = len(columns[0])
    raw = b"".join(map(_planes, columns))
    return n.to_bytes(4, "little") + (raw if n < 16 else zstandard.ZstdCompressor(level=1).compress(raw))


def unpacked_columns(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    raw = blob[4:] if n < 16 else zstandard.ZstdDecompressor().decompress(blob[4:])
    out, at = [], 0
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(_unplanes(raw[at : at + size], n, kind))
        at += size
    return out


#: What the packed columns of a row are: places of anchors, dealt by anchor; summaries of anchors, which ask under a key
#: (count, least and largest document, whether it repeats itself); the places kept aside under that key; answers.
PLACES, ASKS, ASIDE, ANSWERS, RUNS = range(5)
COLUMNS = {
    PLACES: ("<u4", "<i8", "<u4", "<u4"),
    ASKS: ("<u4", "<i8", "<i8", "<i8", "u1", "<i8"),
    ASIDE: ("<i8", "<i8", "<u4", "<u4"),
    ANSWERS: ("<i8", "u1"),
    RUNS: ("<i8", "<i8"),
}
DEALT = "key long, kind int, packed binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ("key", "kind", "packed"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows of DEALT, which come sorted by key, as (key, [(kind, packed)])."""
    now, held = None, []
    for batch in batches:
        for key, kind, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append((kind, raw))
    if held:
        yield now, held


def _by_key(key: np.ndarray, kind: int, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows of DEALT of values that are sorted by key."""
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return [(int(key[a]), kind, packed_columns(*(c[a:b] for c in columns))) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(key)], strict=False)]


def dealt_anchors(docs: DataFrame, units: Units, buckets: int) -> DataFrame:
    """(key, kind, packed): all runs of windows with one anchor, in packed columns.

    PLACES are dealt by anchor to the buckets (the keys below ``buckets``): 32 bits of it beside the bucket (anchors that
    agree in them by chance only make candidates), the document, the run's start and length. Of an anchor with several
    places in one batch of FLUSH anchors the bucket gets one row for the task (ASKS), and the places go to a key of the
    task's own (ASIDE). So an anchor has at most a row for each batch in its bucket, however common it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = buckets + TaskContext.get().partitionId() * GROUPS
        kept: list[tuple[np.ndarray, ...]] = []
        asks: list[tuple[np.ndarray, ...]] = []
        n_kept = n_asks = 0

        def merged() -> tuple[np.ndarray, ...]:
            """The summaries, one for each anchor."""
            h, n, low, high, twice = (np.concatenate(c) for c in zip(*asks, strict=True))
            order = np.argsort(h, kind="stable")
            h = h[order]
            edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            by = lambda f, v: f.reduceat(v[order], edges)
            return h[edges], by(np.add, n), by(np.minimum, low), by(np.maximum, high), by(np.bitwise_or, twice)

        def asked() -> list[tuple[int, int, bytes]]:
            h, n, low, high, twice = merged()
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            i = np.argsort(bucket, kind="stable")
            short = (h // np.uint64(buckets)).astype(np.uint32)
            return _by_key(bucket[i], ASKS, short[i], n[i], low[i], high[i], twice[i].astype(np.uint8), own + bucket[i] % GROUPS)

        def flush() -> list[tuple[int, int, bytes]]:
            h, doc, start, n, twice = (np.concatenate(c) for c in zip(*kept, strict=True))
            many = n * 2 + twice
            order = np.argsort(h, kind="stable")
            sorted_h = h[order]
            edges = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]))
            size = np.diff(np.append(edges, len(h)))
            several = np.zeros(len(h), bool)
            several[order] = np.repeat(size > 1, size)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            short = (h // np.uint64(buckets)).astype(np.uint32)
            i = np.flatnonzero(~several)
            i = i[np.lexsort((start[i], doc[i], bucket[i]))]
            out = _by_key(bucket[i], PLACES, short[i], doc[i], start[i], many[i])
            if several.any():
                i = np.flatnonzero(several)
                group = own + bucket[i] % GROUPS
                i = i[np.lexsort((start[i], doc[i], group))]
                out += _by_key(own + bucket[i] % GROUPS, ASIDE, bucket[i] << 32 | short[i].astype(np.int64), doc[i], start[i], many[i])
                i = order[np.repeat(size > 1, size)]
                edges = np.flatnonzero(np.concatenate([[True], h[i][1:] != h[i][:-1]]))
                by = lambda f, v: f.reduceat(v[i], edges)
                asks.append((h[i][edges], by(np.add, np.ones(len(h), np.int64)), by(np.minimum, doc), by(np.maximum, doc), by(np.bitwise_or, twice)))
            return out

        for chunk in text_chunks(batches, CHUNK):
            ids = chunk.column("doc_id").to_numpy()
            for texts, base, _ in segments(chunk.column("text"), units):
                h, doc, at, n = texts.runs()
                if not len(h):
                    continue
                twice = np.zeros(len(h), bool) if units.other_document else texts.self_repeating(at, n)
                kept.append((h, ids[doc], (at - texts.first[doc] + base).astype(np.uint32), n.astype(np.uint32), twice.astype(np.uint32)))
                n_kept += len(h)
                if n_kept >= FLUSH:
                    yield _rows(flush())
                    kept, n_kept = [], 0
                    n_asks = sum(len(a[0]) for a in asks)
                    if n_asks > SUMMARIES:
                        asks = [merged()]
                        if len(asks[0][0]) > SUMMARIES // 2:
                            yield _rows(asked())
                            asks = []
        if kept:
            yield _rows(flush())
        if asks:
            yield _rows(asked())

    return docs.mapInArrow(run, DEALT)


def bucket_count(total_bytes: int, partitions: int = 0) -> int:
    """Follows the texts' total length: a bucket is for 4 MB of text, and from 256 GB on for up to 64 MB, some four
    million anchors of byte windows. At least two for each partition of a shuffle, so that all have work."""
    return max(64, 2 * partitions, min(total_bytes >> 22, 1 << 16), total_bytes >> 26)


def judged_anchors(units: Units, buckets: int):
    """Of rows of DEALT, those of a bucket: the runs whose anchor occurs in another place that counts (RUNS, under keys
    below 0), and the answers to those who asked (ANSWERS: 0 for no, else heat + 1). Places kept aside pass through."""

    def verdicts(bucket: int, packed: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
        columns = lambda kind: [np.concatenate(c) for c in zip(*([unpacked_columns(raw, *COLUMNS[kind]) for k, raw in packed if k == kind] or [[np.zeros(0, t) for t in COLUMNS[kind]]]), strict=True)]
        h, doc, start, many = columns(PLACES)
        asked, n_asked, low, high, twice, reply = columns(ASKS)
        both, kind = np.unique(np.concatenate([h, asked]), return_inverse=True)
        own, other = kind[: len(h)], kind[len(h) :]
        size = np.bincount(own, minlength=len(both))
        np.add.at(size, other, n_asked)
        if units.other_document:
            least, most = np.full(len(both), np.iinfo(np.int64).max), np.full(len(both), np.iinfo(np.int64).min)
            for i, a, b in ((own, doc, doc), (other, low, high)):
                np.minimum.at(least, i, a)
                np.maximum.at(most, i, b)
            keep = least < most
        else:
            keep = size > 1
            keep[own[many & 1 == 1]] = True
            keep[other[twice == 1]] = True
        verdict = np.where(keep, np.where(size > units.hot, 2, size > WARM) + 1, 0)
        chosen = keep[own]
        run = packed_run(start[chosen].astype(np.int64), (many[chosen] >> 1).astype(np.int64), verdict[own][chosen] - 1)
        out = [(-1 - bucket, RUNS, packed_columns(doc[chosen], run))] if chosen.any() else []
        i = np.argsort(reply, kind="stable")
        return out + _by_key(reply[i], ANSWERS, bucket << 32 | asked[i].astype(np.int64), verdict[other][i].astype(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, packed in _groups(batches):
            yield _rows(verdicts(key, packed) if key < buckets else [(key, kind, raw) for kind, raw in packed])

    return run


def answered_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, run) of RUNS, and of the places kept aside those whose anchor's answer is yes."""
    for _, packed in _groups(batches):
        said = [unpacked_columns(raw, *COLUMNS[ANSWERS]) for kind, raw in packed if kind == ANSWERS]
        anchor, verdict = (np.concatenate(c) for c in zip(*said, strict=True)) if said else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        anchor, first = np.unique(anchor, return_index=True)
        verdict = verdict[first].astype(np.int64)
        for kind, raw in packed:
            if kind == RUNS:
                doc, run = unpacked_columns(raw, *COLUMNS[RUNS])
            elif kind == ASIDE:
                which, doc, start, many = unpacked_columns(raw, *COLUMNS[ASIDE])
                heat = verdict[np.searchsorted(anchor, which)] - 1
                yes = heat >= 0
                doc, run = doc[yes], packed_run(start[yes].astype(np.int64), (many[yes] >> 1).astype(np.int64), heat[yes])
            else:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(run)], ("doc_id", "run"))


def repeated_runs(docs: DataFrame, units: Units, buckets: int) -> DataFrame:
    """(doc_id, runs): the runs whose anchor occurs in another place that counts, each packed into one integer.

    See ``packed_run``; a run's heat is 2 if its anchor occurs over ``units.hot`` times, 1 if over WARM times, else 0.
    """
    dealt = dealt_anchors(docs, units, buckets).repartition("key").sortWithinPartitions("key")
    known = dealt.mapInArrow(judged_anchors(units, buckets), DEALT).repartition("key").sortWithinPartitions("key")
    return known.mapInArrow(answered_runs, "doc_id long, run long").groupBy("doc_id").agg(F.collect_set("run").alias("runs"))  # a set: rows that repeat a document send the same ones


def copies(docs: DataFrame, n_docs: int) -> DataFrame:
    """doc_ids of the documents whose whole text a smaller doc_id has, too. Texts with very many copies don't meet."""
    marked = docs.where("length(text) > 0").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = marked.groupBy("sha").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high")
    first = checkpointed(first.select("sha", "low", "n"))
    return joined_unevenly(marked, first, "sha", "n", n_docs).where("doc_id > low").select("doc_id").distinct()


#: Bytes of contexts that a task gathers before it deals them out.
GATHER = 6 << 20


def pack_contexts(rows: list[tuple[int, bytes, int, int, int, int]], buckets: int) -> pa.RecordBatch:
    """(bucket, packed) of rows (h, ctx, doc_id, key, rel, n), compressed by bucket."""
    h, ctx, *numbers = zip(*rows, strict=True)
    h = np.array(h, np.int64)
    bucket = (h.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h, bucket))
    starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))  # of the buckets that occur
    numbers = [np.array(v, np.int64) for v in numbers]
    squeeze = zstandard.ZstdCompressor(level=3)
    at, blobs = [], []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        i = order[a:b]
        texts = [ctx[j] for j in i.tolist()]
        size = np.fromiter(map(len, texts), np.int32, len(texts))
        planes = [_planes(np.diff(h[i], prepend=0)), *(_planes(v[i]) for v in numbers), _planes(size)]
        at.append(int(bucket[i[0]]))
        blobs.append(squeeze.compress(pickle.dumps((len(i), planes, b"".join(texts)), 5)))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], ("bucket", "packed"))


def unpack_contexts(packed: list[bytes]) -> pa.Table:
    """The rows of a bucket, by h."""
    parts = []
    for raw in packed:
        n, planes, text = pickle.loads(zstandard.ZstdDecompressor().decompress(raw))
        h, *numbers = (_unplanes(p, n, "<i8") for p in planes[:-1])
        size = _unplanes(planes[-1], n, "<i4")
        offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ctx = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text)])
        columns = [pa.array(np.cumsum(h)), ctx, *map(pa.array, numbers)]
        parts.append(pa.Table.from_arrays(columns, names=["h", "ctx", "doc_id", "key", "rel", "n"]))
    out = pa.concat_tables(parts)
    return out.take(pa.array(np.argsort(out.column("h").to_numpy(), kind="stable")))


def contexts(joined: DataFrame, units: Units, buckets: int) -> DataFrame:
    """(bucket, packed): the text under each run, dealt out by anchor.

    Packed are rows (h, ctx, doc_id, key, rel, n): key is the run's start, n the number of windows.
    Equal contexts of an anchor that occurs often are merged in each task: the first document's stays. A hot anchor's
    contexts (a common line between different neighbours) are divided into single windows, with their own hash for the
    anchor and their place in the context as rel, and equal windows are merged in the same way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int, list[tuple[int, int]]]] = {}
        rows: list[tuple[int, bytes, int, int, int, int]] = []
        gathered = n_held = held_bytes = 0

        def hold(h: int, ctx: bytes, doc_id: int, key: int, rel: int) -> None:
            nonlocal n_held, held_bytes
            had = held.get(ctx)
            if had is None or doc_id < had[1] or (units.words and doc_id == had[1] and key + rel < sum(had[2][0])):
                held[ctx] = (h, doc_id, [(key, rel)])
                held_bytes += len(ctx)
            elif doc_id == had[1] and not units.words:
                had[2].append((key, rel))
                n_held += 1

        def released() -> None:
            nonlocal gathered, n_held, held_bytes
            for ctx, (h, d, at) in held.items():
                n = ctx.count(b" ") + 2 - units.window if units.words else len(ctx) + 1 - units.window
                rows.extend((h, ctx, d, k, r, n) for k, r in at)
                gathered += len(ctx) * len(at)
            held.clear()
            n_held = held_bytes = 0

        def taken(texts: Texts, a: int, n: int, heat: int, doc_id: int, key: int, seen: set[bytes]) -> None:
            """The windows a to a + n, of which the first is the document's window ``key``."""
            nonlocal gathered
            ctx = texts.cut(a, a + n + units.window - 1)
            if units.words:
                if ctx in seen:
                    return  # it starts earlier in its own document
                seen.add(ctx)
            if heat < 2:
                h = int(texts.grams[a : a + units.window - units.gram + 1].min()) | 1
                h -= (h >> 63) << 64
                if heat:
                    hold(h, ctx, doc_id, key, 0)
                else:
                    rows.append((h, ctx, doc_id, key, 0, n))
                    gathered += len(ctx)
                return
            one = ctx.split(b" ") if units.words else ctx
            for i in range(n):
                w = b" ".join(one[i : i + units.window]) if units.words else one[i : i + units.window]
                g = xxhash.xxh64_intdigest(w) & ~1  # contexts' anchors are odd: the two never meet
                hold(g - (1 << 64) if g >> 63 else g, w, doc_id, key, i)
                if n_held > MERGED:
                    released()

        for chunk in text_chunks(batches, CHUNK):
            offsets, starts, sizes, heats = unpacked_runs(chunk.column("runs"))
            if not offsets[-1]:
                continue
            all_rows = np.repeat(np.arange(chunk.num_rows), np.diff(offsets))
            ids = chunk.column("doc_id").fill_null(0).to_numpy()  # a null has no runs
            seen, last = set(), -1
            for texts, base, end in segments(chunk.column("text"), units):
                mine = slice(None) if end is None else slice(*np.searchsorted(starts, [base, end]))
                row = all_rows[mine]
                a = starts[mine] - base + texts.first[row]
                fits = a + sizes[mine] + units.window - 1 <= texts.first[row + 1]  # always, but for rows that repeat a doc_id with another text
                for x, n, heat, key, r in zip(*(v[fits].tolist() for v in (a, sizes[mine], heats[mine], starts[mine], row)), strict=True):
                    if r != last:
                        seen, last = set(), r
                    parts = texts.first_within(x, n) if units.words and n > 4 * units.window else [(x, n)]
                    for at, many in parts:
                        taken(texts, at, many, heat, int(ids[r]), key + at - x, seen)
                    if len(held) > MERGED or n_held > MERGED or held_bytes > GATHER:
                        released()
                    if gathered > GATHER:
                        yield pack_contexts(rows, buckets)
                        gathered = 0
                        rows.clear()
        released()
        if rows:
            yield pack_contexts(rows, buckets)

    return joined.mapInArrow(run, "bucket int, packed binary")


def distinct_contexts(block: pa.Table, units: Units) -> pa.Table:
    """Of equal contexts of an anchor the first (for bytes: all those of the smallest doc_id)."""
    h, doc, key, rel = (block.column(k).to_numpy().astype(np.int64) for k in ("h", "doc_id", "key", "rel"))
    code = pc.dictionary_encode(block.column("ctx").combine_chunks()).indices.to_numpy()
    order = np.lexsort((key + rel, doc, code, h))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (code[order][1:] != code[order][:-1])])
    if units.other_document:
        low = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        new = doc[order] == low
    return block.take(pa.array(order[new]))


def shard_blocks(rows: pa.Table, most_bytes: int) -> Iterator[pa.Table]:
    """Rows sorted by anchor in blocks of whole anchors, of about ``most_bytes`` of contexts."""
    h = rows.column("h").to_numpy()
    total = np.concatenate([[0], np.cumsum(pc.binary_length(rows.column("ctx")).to_numpy())])
    edges = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
    at = 0
    while at < len(h):
        k = int(np.searchsorted(total[edges], total[at] + most_bytes, side="right")) - 1
        end = int(edges[k]) if edges[k] > at else int(edges[np.searchsorted(edges, at, side="right")])
        yield rows.slice(at, end - at)
        at = end


def first_windows(packed: DataFrame, units: Units, decide: Callable[[pa.Table], list[tuple[int, int, int, int]]], most_bytes: int) -> DataFrame:
    """(doc_id, fresh): runs of windows that occur there first. decide: (doc_id, key, a, n) of those in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh(packed: list[bytes]) -> Iterator[pa.RecordBatch]:
            for block in shard_blocks(distinct_contexts(unpack_contexts(packed), units), most_bytes):
                doc, key, a, n = np.array(decide(block), np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([pa.array(doc.copy()), pa.array(packed_run(key + a, n, 0 * n))], ("doc_id", "run"))

        now, held = None, []
        for batch in batches:
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and held:
                    yield from fresh(held)
                    held = []
                now = bucket
                held.append(raw)
        if held:
            yield from fresh(held)

    out = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, run long")
    return out.groupBy("doc_id").agg(F.collect_set("run").alias("fresh"))


def fresh_runs(fresh: np.ndarray, row: np.ndarray, doc: np.ndarray, key: np.ndarray, rel: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Maximal runs of fresh windows. fresh, rel: of each window in order; row: its context; doc, key: of each context."""
    at = np.flatnonzero(fresh)
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(row[at]) != 0)) + 1
    starts = at[np.concatenate([[0], cut])]
    n = np.diff(np.concatenate([[0], cut, [len(at)]]))
    r = row[starts]
    return list(zip(doc[r].tolist(), key[r].tolist(), rel[starts].tolist(), n.tolist(), strict=True))


def removed_spans(docs: DataFrame, units: Units, decide: Callable[[pa.Table], list[tuple[int, int, int, int]]], most_bytes: int) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_units, spans (removed units: start, end, start, end, ...), kept.

    Removed is each unit under a window that also occurs earlier, windows being judged on the whole input. kept: the
    remaining bytes, or the remaining words with one space between. A copy of a whole text loses all its windows at once.
    A null or empty text has no units; a row without doc_id loses nothing; rows that repeat a doc_id (they should repeat
    the text) are treated as one document.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    own = docs.where("doc_id IS NOT NULL")
    n_docs, total = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    again = copies(own, n_docs).withColumn("copy", F.lit(True))
    buckets = bucket_count(total, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marked = repeated_runs(own, units, buckets).join(again, "doc_id", "full_outer")
    marked = checkpointed(marked.select("doc_id", F.when(F.col("copy").isNull(), F.col("runs")).alias("runs"), F.coalesce("copy", F.lit(False)).alias("copy")))
    both = own.join(marked, "doc_id", "left")  # the texts are shuffled once, for what follows twice
    fresh = first_windows(contexts(both.select("doc_id", "text", "runs"), units, buckets), units, decide, most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, CHUNK):
            texts = Texts(chunk.column("text"), units)
            at_run, run_start, run_size, _ = unpacked_runs(chunk.column("runs"))
            at_new, new_start, new_size, _ = unpacked_runs(chunk.column("fresh"))
            copy = chunk.column("copy").fill_null(False).to_pylist()
            spans, kept, total = [], [], []
            for d in range(chunk.num_rows):
                first, n = int(texts.first[d]), int(texts.first[d + 1] - texts.first[d])
                gone = np.zeros(n, bool)
                r, f = slice(at_run[d], at_run[d + 1]), slice(at_new[d], at_new[d + 1])
                if copy[d]:
                    gone[:] = n >= units.window
                elif at_run[d] < at_run[d + 1]:
                    windows = np.zeros(max(0, n - units.window + 1), bool)
                    start, many = run_start[r], run_size[r]
                    for a, m in zip(start.tolist(), many.tolist(), strict=True):
                        windows[a : a + m] = True
                    for a, m in zip(new_start[f].tolist(), new_size[f].tolist(), strict=True):
                        windows[a : a + m] = False
                    step = np.zeros(n + 1, np.int64)
                    w = np.flatnonzero(windows)
                    np.add.at(step, w, 1)
                    np.add.at(step, w + units.window, -1)
                    gone = np.cumsum(step[:-1]) > 0
                spans.append(np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist())
                total.append(n)
                if units.words:
                    if not spans[-1]:
                        kept.append(texts.cut(first, first + n) if n else b"")
                    else:
                        edges = [0, *spans[-1], n]
                        kept.append(b" ".join(texts.cut(first + a, first + b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b))
                else:
                    kept.append(texts.data[first : first + n][~gone].tobytes())
            columns = [chunk.column("doc_id"), pa.array(total, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ("doc_id", "n_units", "spans", "kept"))

    nameless = docs.where("doc_id IS NULL")  # they lose nothing, and would all meet in a join on the id
    joined = both.join(fresh, "doc_id", "left")
    none = nameless.select("doc_id", "text", *(F.lit(None).cast(joined.schema[c].dataType).alias(c) for c in joined.columns if c not in nameless.columns))
    # under other names, else the union keeps an alias of the id on one side, and Spark sees two dealings of the texts
    apart = lambda df: df.select(*(F.col(c).alias(f"{c}_") for c in joined.columns))
    every = apart(joined).union(apart(none)).toDF(*joined.columns)
    return every.mapInArrow(run, "doc_id long, n_units long, spans array<long>, kept binary")


def removed_count(spans: str = "spans"):
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
