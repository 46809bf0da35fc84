"""Operator 1: substring deduplication by suffix automata of reference shards.

The reference is the corpus itself, so no bound on its size could be proven and it is not broadcast whole. Shards
hold what may be repeated (see ``shared``): every shard's automaton is built once, in the task that has the shard,
from its texts in the order of (doc_id, start), and the shard's documents stream through it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.llm.common import table
from lobspark.llm.shared import Units, fresh_runs, removed_count, removed_spans

#: Bytes of text in one automaton; its states take about a hundred times that.
SHARD_BYTES = 200_000


class SuffixAutomaton:
    """All substrings of a sequence; ``first``: where a state's substrings first end."""

    def __init__(self, sequence: list[int]):
        step: list[dict[int, int]] = [{}]
        link, length, first = [-1], [0], [-1]
        last = 0
        for at, c in enumerate(sequence):
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            first.append(at)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(step[q].copy())
                    length.append(length[p] + 1)
                    first.append(first[q])
                    link.append(link[q])
                    link[q] = link[new] = twin
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
            last = new
        self.step, self.link, self.length, self.first = step, link, length, first

    def first_ends(self, sequence: list[int], window: int) -> list[int]:
        """Matching statistics up to ``window``: where each position's last ``window`` items first ended, or -1."""
        step, link, length, first = self.step, self.link, self.length, self.first
        state = have = 0
        out = []
        for c in sequence:
            while state and c not in step[state]:
                state = link[state]
                have = length[state]
            if c in step[state]:
                state = step[state][c]
                have += 1
                while length[link[state]] >= window:
                    state = link[state]
                    have = length[state]
            out.append(first[state] if have >= window else -1)
        return out


def first_by_automaton(window: int):
    def decide(block: pa.Table) -> list[tuple[int, int, int, int]]:
        doc, key, rel = (block.column(k).to_numpy().astype(np.int64) for k in ("doc_id", "key", "rel"))
        order = np.lexsort((key + rel, doc))
        texts = block.column("ctx").to_pylist()
        number: dict[bytes, int] = {}
        sequence: list[int] = []
        begins = []
        for k, i in enumerate(order.tolist()):
            begins.append(len(sequence))
            sequence += [number.setdefault(w, len(number)) for w in texts[i].split(b" ")]
            sequence.append(-1 - k)  # no match goes beyond it
        automaton = SuffixAutomaton(sequence)
        fresh: list[bool] = []
        row: list[int] = []
        place: list[int] = []
        for k, i in enumerate(order.tolist()):
            a, b = begins[k], (begins[k + 1] if k + 1 < len(begins) else len(sequence)) - 1
            ends = automaton.first_ends(sequence[a:b], window)[window - 1 :]
            fresh += [e == a + window - 1 + j for j, e in enumerate(ends)]
            row += [i] * len(ends)
            place += range(int(rel[i]), int(rel[i]) + len(ends))
        return fresh_runs(np.array(fresh, bool), np.array(row, np.int64), doc, key, np.array(place, np.int64))

    return decide


def deduplicated(docs: DataFrame, window: int = 20, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Removes every word under a run of ``window`` words that also starts earlier; see ``removed_spans``."""
    units = Units(window=window, gram=max(1, window * 2 // 5), words=True, other_document=False)
    return removed_spans(docs, units, first_by_automaton(window), shard_bytes)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), removed_count().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, hash(list_slice(w, i, i + 19)) AS h, array_to_string(list_slice(w, i, i + 19), ' ') AS s
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h, s ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS p FROM ranked WHERE r > 1)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
