"""Language identification by rank-order profiles.

A profile is the `top` most frequent letter 1-, 2- and 3-grams of a language, over all its training documents, in order
of their counts. A document's own most frequent grams are ranked alike, and the language with the smallest out-of-place
distance is taken: each gram adds how far its rank is from the language's, and `top` where the language's profile lacks it.

Words are runs of letters and combining marks, lower-cased, with one mark of a word's edge before and after; grams don't
cross words. A gram is three code points of 21 bits in one long, so equal numbers are equal grams, nothing is hashed.
Ties go to the smaller gram, and between languages to the smaller name.

Cost: training is one pass over the text. A task adds up its grams and sends each (language, gram) once, so the shuffle holds
distinct grams a task, not text; Spark keeps the `top` of each partition before it ranks a language's. The profiles, `top` rows a
language, are all that reaches the driver; more than `most_languages` raise ValueError. Scoring is a map without a shuffle.

Nulls and edge cases: a text that is null or has no letter is `und` with score 0, and so is every text if nothing could be
learned (no labelled training text with a letter). Null languages and texts aren't learned from; an empty language name is a
name like any other. A null doc_id counts as remainder 0. Repeated rows are learned from and answered once each. Extra columns
are kept by `identify`, whatever their names. Empty tables give empty results. A text is counted whole, a run at a time.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_remainder, crc_sql, fresh, table, text_runs

TOP = 400
UNKNOWN = "und"
#: A code point is stored two up, 1 is a word's edge.
BITS, EDGE = 21, 1
#: A task sends its sums on once it holds so many.
HELD_GRAMS = 1 << 21


@functools.cache
def word_parts() -> np.ndarray:
    """By code point: 2 for letters, 1 for marks that stand with them, else 0."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def row_grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, grams in order, counts) of each row that has a letter."""
    parts = word_parts()
    for first, end, data, offsets in text_runs(pc.utf8_lower(texts)):
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        kind = parts[points]
        # An edge before the first row and after each.
        a = np.full(len(points) + end - first + 1, EDGE, np.int64)
        a[np.arange(len(points)) + np.repeat(np.arange(1, end - first + 1), np.diff(at))] = np.where(kind > 0, points.astype(np.int64) + 2, EDGE)
        letters = np.concatenate(([0], np.cumsum(kind == 2)))[at]
        inside = np.flatnonzero(a != EDGE)
        before, here, after = a[inside - 1], a[inside], a[inside + 1]
        last = after == EDGE
        found = [here, before << BITS | here, here[last] << BITS | EDGE, before << 2 * BITS | here << BITS | after]
        starts = at + np.arange(1, end - first + 2)
        cuts = [np.searchsorted(inside, starts)] * 2
        cuts += [np.searchsorted(inside[last], starts), cuts[0]]
        for row in np.flatnonzero(np.diff(letters)):
            yield first + row, *np.unique(np.concatenate([g[c[row] : c[row + 1]] for g, c in zip(found, cuts)]), return_counts=True)


def added(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and the sums of their counts."""
    g, n = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[starts], np.add.reduceat(n, starts)


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with a language; a row a task and gram before the shuffle, one after."""

    def count(batches):
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def sent():
            for lang, (grams, counts) in held.items():
                g, n = added(grams, counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])

        for b in batches:
            langs = b.column(1).to_pylist()
            for row, grams, counts in row_grams(b.column(0)):
                mine = held.setdefault(langs[row], ([], []))
                mine[0].append(grams)
                mine[1].append(counts)
                size += len(grams)
                if size > HELD_GRAMS:
                    held = {k: tuple([x] for x in added(*v)) for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > HELD_GRAMS // 2:  # distinct ones are many: let the shuffle hold them
                        yield from sent()
                        held, size = {}, 0
        yield from sent()

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, F.col(lang_col).alias("_lang"))
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, most_languages: int = 4096) -> dict[str, list[int]]:
    """Each language's `top` most frequent grams, most frequent first."""
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = gram_counts(docs, text_col, lang_col).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    found: dict[str, list[int]] = {}
    for r in ranked.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "gram"))).alias("grams")).limit(most_languages + 1).collect():
        found[r.lang] = [g.gram for g in r.grams]
    if len(found) > most_languages:
        raise ValueError("too many languages")
    return found


def distances(grams: np.ndarray, known: np.ndarray, ranks: np.ndarray, top: int) -> np.ndarray:
    """Out-of-place distance of ranked grams to each language; ranks: (languages, known grams), `top` where a language lacks one."""
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    theirs = np.where(known[at] == grams, ranks[:, at], top)
    return np.where(theirs < top, np.abs(theirs - np.arange(len(grams))), top).sum(axis=1)


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", top: int = TOP, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the nearest language and how near it is: 1 for equal ranks, 0 where no gram is shared. Columns named as `out` are replaced."""
    text_of, docs = F.col(text_col), docs.drop(*(c for c in out if c != text_col))
    langs = sorted(profiles)
    known = np.unique(np.array([g for grams in profiles.values() for g in grams], np.int64))
    ranks = np.full((len(langs), len(known)), top, np.int64)
    for k, lang in enumerate(langs):
        ranks[k, np.searchsorted(known, np.array(profiles[lang], np.int64))] = np.arange(len(profiles[lang]))
    text, names = fresh(docs, "_text"), [*docs.columns, *out]

    def score(batches):
        for b in batches:
            best, near = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            for row, grams, counts in row_grams(b.column(b.num_columns - 1)) if langs else ():
                ranked = grams[np.lexsort((grams, -counts))[:top]]
                d = distances(ranked, known, ranks, top)
                k = int(d.argmin())
                best[row], near[row] = langs[k], 1 - d[k] / (top * len(ranked))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(best, pa.string()), pa.array(near)], names=names)

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.withColumn(text, text_of).mapInArrow(score, f"{kinds}, `{out[0]}` string, `{out[1]}` double")


def op11_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_remainder("doc_id", 4) == 2)
    profiles = fit(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).drop("text")


OP11_SQL = f"""WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce({crc_sql('CAST(doc_id AS VARCHAR)')} % 4, 0) = 2 AS held_out, lower(text) AS t FROM documents
), words AS (
  SELECT r, ' ' || w || ' ' AS w, count(*) AS n FROM (SELECT r, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}]+')) AS w FROM docs WHERE regexp_matches(t, '\\p{{L}}')) GROUP BY 1, 2
), cut AS (
  SELECT r, w, n, unnest(range(1, length(w) + 1)) AS i FROM words
), grams AS (
  SELECT r, g, sum(n)::BIGINT AS n FROM (
    SELECT r, n, unnest([CASE WHEN i > 1 AND i < length(w) THEN substring(w, i, 1) END, CASE WHEN i < length(w) THEN substring(w, i, 2) END, CASE WHEN i + 1 < length(w) THEN substring(w, i, 3) END]) AS g FROM cut
  ) WHERE g IS NOT NULL GROUP BY 1, 2
), profiles AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) - 1 AS rank
  FROM (SELECT lang, g, sum(n) AS n FROM grams JOIN docs USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1, 2) QUALIFY rank < {TOP}
), ranked AS (
  SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, length(g), g) - 1 AS rank FROM grams QUALIFY rank < {TOP}
), size AS (SELECT r, count(*) AS m FROM ranked GROUP BY r),
met AS (
  SELECT a.r, p.lang, sum({TOP} - abs(a.rank - p.rank)) AS saved FROM ranked a JOIN profiles p USING (g) GROUP BY 1, 2
), far AS (
  SELECT r, m, l.lang, m * {TOP} - coalesce(saved, 0) AS d FROM size CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN met USING (r, lang)
), best AS (SELECT r, min(m) AS m, min(d) AS d, arg_min(lang, (d, lang)) AS lang FROM far GROUP BY r)
SELECT doc_id, held_out, coalesce(best.lang, '{UNKNOWN}') AS lang_pred, coalesce(1 - d::DOUBLE / ({TOP} * m), 0) AS score FROM docs LEFT JOIN best USING (r)"""
