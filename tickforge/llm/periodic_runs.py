"""Periodic runs of words (maximal repetitions) by Kolpakov and Kucherov's algorithm.

A run is a stretch of words with smallest period q and a length of at least max(`least`, 2q) that no neighbouring word
extends with period q. For each stretch of text that can hold any:

1. its LZ factorisation (a factor is the longest prefix of the rest that also starts earlier, or one new word) is read off a
   suffix automaton whose states know where they first ended;
2. Main's algorithm finds the runs that cross or touch a border between factors, from longest common extensions by each
   period to the border's left and right, in windows as long as the factors beside it;
3. the other runs lie strictly inside one factor, so they are copied from the earlier occurrence of that factor.

All of it takes time linear in the stretch, up to the number of runs. A run repeats `least` / 2 words one period later, so a word that
isn't covered by a gram of that many words found twice is in no run: stretches are what such grams cover, found for many documents at
once by their hashes (a collision makes a stretch longer, never shorter), and no run leaves its stretch. Words are compared by
dictionary numbers, not hashes. A document is one map task's work; nothing is shuffled. Memory is under a KB for each word of the
longest stretch.

Nulls and edge cases: a null or empty text has no words and no runs. A null doc_id is never given a periodic tail. Repeated
rows are answered one by one. Ties for the greatest run go to the smaller start, then the smaller period. Extra columns are kept by
`with_runs`, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, fresh, hash_windows, mix, ranges, split_words, table, text_runs

LEAST = 12


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, start of an earlier occurrence or -1): the LZ factors of word, earlier occurrences may overlap them."""
    step: list[dict[int, int]] = [{}]
    link, length, first_end = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(word):
        new = len(step)
        step.append({})
        length.append(i + 1)
        first_end.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] != length[p] + 1:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                first_end.append(first_end[q])
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[new] = q
        last = new
    found, i, n = [], 0, len(word)
    while i < n:
        state, j = 0, i
        while j < n:
            state_next = step[state][word[j]]
            if first_end[state_next] >= j:  # starts here for the first time
                break
            state, j = state_next, j + 1
        found.append((i, max(j, i + 1), first_end[state] - (j - i) + 1 if j > i else -1))
        i = max(j, i + 1)
    return found


def prefix_lengths(x: list[int]) -> list[int]:
    """For each i, how many words of x[i:] equal x's first ones (Z function)."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def runs_at_border(word: list[int], low: int, border: int, high: int) -> list[tuple[int, int, int]]:
    """(start, end, period): repetitions of at least two periods in word[low:high] that cross or touch the border."""
    x, y = word[low:border][::-1], word[border:high]
    nx, ny, gap = len(x), len(y), [-1]
    # How far each side repeats itself a period on, and how far it goes on from the other side's words next to the border.
    right, left = prefix_lengths(y), prefix_lengths(x)
    back, forth = prefix_lengths(x + gap + y[::-1]), prefix_lengths(y + gap + x[::-1])
    found = []
    for p in range(1, ny + 1):  # a whole period to the right of the border
        e = right[p] if p < ny else 0
        s = back[nx + 1 + ny - p]
        if s >= p and p < nx:
            s += left[p]
        if s + e >= p:
            found.append((border - s, border + p + e, p))
    for p in range(1, nx + 1):  # a whole period to its left
        s = left[p] if p < nx else 0
        e = forth[ny + 1 + nx - p]
        if e >= p and p < ny:
            e += right[p]
        if s + e >= p:
            found.append((border - p - s, border + e, p))
    return found


def runs_of(word: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of word, by start and period."""
    n = len(word)
    parts = factors(word)
    best: dict[tuple[int, int], int] = {}
    ended = word + [-2]
    borders = [(b, e) for b, e, _ in parts[1:]] + [(n, n + 1)]
    before = 0
    for border, end in borders:
        size = border - before
        low, high = max(0, border - 2 * size - (end - border) - 1), min(end + 1, n + 1)
        for s, e, p in runs_at_border(ended, low, border, high):
            # What reaches an end of the window is met at another border, whole.
            if (s > low or low == 0) and e <= end and e <= n and e - s >= max(least, 2 * p):
                best[s, e] = min(p, best.get((s, e), p))
        before = border
    by_start: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for (s, e), p in best.items():
        by_start[s].append((e, p))
    for b, e, source in parts:
        if e - b <= least or source < 0:
            continue
        shift = b - source
        for s in range(b + 1, e):
            for end, p in by_start[s - shift]:
                if end + shift < e and (s, end + shift) not in best:
                    best[s, end + shift] = p
                    by_start[s].append((end + shift, p))
    return sorted((s, e, p) for (s, e), p in best.items())


def stretches(ids: np.ndarray, first: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(row, start, end): the parts of rows' words that can hold runs; ids are word numbers, first each row's first word (one more at the end)."""
    k = max(1, least // 2)
    if len(ids) < least:
        return []
    h = hash_windows(mix(ids.astype(np.uint64) + np.uint64(1)), k)
    part = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = part[: len(h)] == part[k - 1 :]
    for _ in range(3):  # grams found twice in a row, then twice in a stretch, and once more
        at = np.flatnonzero(whole)
        own = mix(h[at] + mix(part[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        whole = np.zeros(len(h), bool)
        whole[at[twice]] = True
        # What the grams cover, a new stretch at each row.
        cover = np.zeros(len(ids) + 1, np.int64)
        cover[: len(h)] += whole
        cover[k : k + len(h)] -= whole
        covered = np.cumsum(cover[:-1]) > 0
        starts = covered.copy()
        starts[1:] &= ~covered[:-1]
        starts[first[:-1][first[:-1] < len(ids)]] |= covered[first[:-1][first[:-1] < len(ids)]]
        part = np.cumsum(starts)
    begins = np.flatnonzero(starts)
    row = np.searchsorted(first, begins, "right") - 1
    # A stretch ends where the next begins, at its row's end, or at the first word that isn't covered.
    bare = np.append(np.flatnonzero(~covered), len(ids))
    ends = np.minimum(np.minimum(np.append(begins[1:], len(ids)), first[row + 1]), bare[np.searchsorted(bare, begins)]) if len(begins) else begins
    return [(int(r), int(s), int(e)) for r, s, e in zip(row, begins, ends) if e - s >= least]


def document_runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST) -> dict[int, list[tuple[int, int, int]]]:
    """For each row that has any, its runs (start, end, period) by start and period; words are numbered in their row from 0."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for row, s, e in stretches(ids, first, least):
        shift = s - int(first[row])
        runs = [(a + shift, b + shift, p) for a, b, p in runs_of(ids[s:e].tolist(), least)]
        if runs:
            found.setdefault(row, []).extend(runs)
    return found


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word of data, equal for equal words."""
    at = ranges(starts, ends - starts)
    offsets = np.concatenate(([0], np.cumsum(ends - starts, dtype=np.int64)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def kept_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words joined by one space."""
    lengths = ends - starts + 1
    at = np.minimum(ranges(starts, lengths), len(data) - 1)
    out = data[at]
    out[np.cumsum(lengths) - 1] = 0x20
    return out[:-1].tobytes()


def with_tail(n: int, seed: int | None) -> np.ndarray:
    """Numbers of the n words of a text, where a seed picks a place from which they repeat a period picked by it."""
    order = np.arange(n)
    if n and seed is not None:
        start = seed % n
        period = 1 + (n - start) // (3 + seed % 8)
        order[start:] = start + (order[start:] - start) % period
    return order


RUN_FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def with_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, tail_seed: str | None = None, out: str = "runs") -> DataFrame:
    """docs and a struct `out` of RUN_FIELDS (how many, the greatest run's place, size and exponent, digests of the list and of the text without
    repeated periods), and a list `out`_spans of all runs. `tail_seed` names a long column: where it isn't null, the text gets a periodic tail first (see with_tail).
    """
    text, seed = fresh(docs, "_text"), fresh(docs, "_seed")
    names = [*docs.columns, out, f"{out}_spans"]
    fields = [tuple(f.split()) for f in RUN_FIELDS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    listed_as = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def find(batches):
        for b in batches:
            answers, lists, seeds = [], [], b.column(b.num_columns - 1).to_pylist()
            for i, j, data, offsets in text_runs(b.column(b.num_columns - 2)):
                starts, ends, first = split_words(data, offsets, SPACED)
                orders = [first[row] + with_tail(int(first[row + 1] - first[row]), seeds[i + row]) for row in range(j - i)]
                found = document_runs(word_numbers(data, starts, ends)[np.concatenate(orders)], first, least)
                for row, mine in enumerate(orders):
                    runs = found.get(row, [])
                    keep = np.ones(len(mine), bool)
                    for s, e, p in runs:
                        keep[s + p : e] = False
                    mine = mine[keep]
                    left = kept_text(data, starts[mine], ends[mine]) if len(mine) else b""
                    top = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2])) if runs else None
                    place = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
                    listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
                    answers.append((len(runs), *place, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
                    lists.append([{"start": s, "length": e - s, "period": p} for s, e, p in runs])
            columns = [pa.array([a[k] for a in answers], kinds[kind]) for k, (_, kind) in enumerate(fields)]
            struct = pa.StructArray.from_arrays(columns, names=[name for name, _ in fields])
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], struct, pa.array(lists, listed_as)], names=names)

    schema = [f"`{c}` {t}" for c, t in docs.dtypes] + [f"`{out}` struct<{', '.join(f'{n}: {t}' for n, t in fields)}>", f"`{out}_spans` array<struct<start: long, length: long, period: long>>"]
    seeds = F.col(tail_seed).cast("long") if tail_seed else F.lit(None).cast("long")
    return docs.withColumns({text: F.col(text_col), seed: seeds}).mapInArrow(find, ", ".join(schema))


def op13_runs(spark, sf_dir: str) -> DataFrame:
    """One document in ten, by its id, gets a periodic tail before runs are sought."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("seed"))
    return with_runs(docs, tail_seed="seed").select("doc_id", "runs.*")
