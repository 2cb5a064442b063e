"""Language identification against counters and sorted lists, and on held-out documents."""

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tickforge.llm import language_id as L

from .cases import SCHEMA, write

WORDS = re.compile(r"[^\W\d_]+(?:[̀-ͯ][^\W\d_]*)*|[̀-ͯ]+[^\W\d_]*")

LETTER = r"[^\W\d_]"


def grams(text):
    found = Counter()
    for w in WORDS.findall((text or "").lower()):
        padded = f" {w} "
        found.update(w)
        found.update(padded[i : i + 2] for i in range(len(padded) - 1))
        found.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return found


def top(found):
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[: L.TOP]]


def wanted(rows):
    """(doc_id, held_out, lang_pred, score) of rows (doc_id, text, lang)."""
    held = [zlib.crc32(str(i).encode()) % 4 == 2 if i is not None else False for i, _, _ in rows]
    sums = {}
    for (_, text, lang), out in zip(rows, held):
        if not out and lang is not None and re.search(LETTER, text or ""):
            sums.setdefault(lang, Counter()).update(grams(text))
    ranks = {lang: {g: k for k, g in enumerate(top(c))} for lang, c in sums.items()}
    for (i, text, _), out in zip(rows, held):
        mine = top(grams(text))
        if not re.search(LETTER, text or "") or not ranks:
            yield i, out, "und", 0.0
            continue
        far = {lang: sum(abs(r[g] - k) if g in r else L.TOP for k, g in enumerate(mine)) for lang, r in ranks.items()}
        d, lang = min((d, lang) for lang, d in far.items())
        yield i, out, lang, 1 - d / (L.TOP * len(mine))


TEXTS = {
    "en": "The Quick brown fox, and the lazy dog; it's the end of the day.", "de": "Der schnelle braune Fuchs und der faule Hund. Über Straße!",
    "fr": "Le renard brun, élégant et rapide; l’été à la plage.", "": "zzz qqq xxx zqx", None: "Sorpresa, no se sabe nada.",
}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 7, "x", 1, 2, "?", 3, 4) for i, t, lang in rows], SCHEMA).repartition(4)


def rows():
    out = [(i, f"{text} {' '.join(text.split()[i % 5 :: 2])} {i}", lang) for i in range(30) for lang, text in TEXTS.items()]
    out += [(90, None, "en"), (91, "", "de"), (92, " 123 ?! \n", "fr"), (93, "́", "en"), (94, "été 中文 ЖЖЖ", "en"), (95, "THE DOG. " * 3000, "en"), (None, "der Hund und der Fuchs", "de"), (None, "der Hund und der Fuchs", "de")]
    return out + out[:3]


def test_against_counters(spark, tmp_path, duck):
    mine = rows()
    d = write(spark, tmp_path, documents=documents(spark, mine))
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 12)) for r in L.op11_language(spark, d).collect())
    assert got == Counter((i, h, lang, round(s, 12)) for i, h, lang, s in wanted(mine))
    sql = L.OP11_SQL.replace("FROM documents", f"FROM read_parquet('{d}/documents.parquet/*.parquet')")
    assert got == Counter((i, h, lang, round(s, 12)) for i, h, lang, s in duck.execute(sql).fetchall())


def test_nothing_learned_and_empty(spark, tmp_path):
    d = write(spark, tmp_path / "a", documents=documents(spark, [(1, "some words", None), (2, "more", None)]))
    assert {tuple(r)[2:] for r in L.op11_language(spark, d).collect()} == {("und", 0.0)}
    d = write(spark, tmp_path / "b", documents=documents(spark, []))
    assert L.op11_language(spark, d).count() == 0


def test_extra_columns(spark):
    docs = documents(spark, rows())
    found = L.fit(docs)
    assert set(found) == {"en", "de", "fr", ""} and all(len(g) <= L.TOP for g in found.values())
    assert L.identify(docs, found, out=("lang_pred", "nearness")).columns == [*docs.columns, "lang_pred", "nearness"]
    got = L.identify(docs, found)  # docs has a score of its own
    assert got.columns == [*(c for c in docs.columns if c != "score"), "lang_pred", "score"] and dict(got.dtypes)["score"] == "double" and got.count() == len(rows())
    assert found == L.fit(docs.coalesce(1))


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = L.op11_language(spark, d).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert got[0] > 0.99 and got[1] > 200


def test_sql(spark, duck, sf_dir):
    got = sorted((r.doc_id, r.held_out, r.lang_pred, r.score) for r in L.op11_language(spark, sf_dir).collect())
    assert got == sorted(duck.execute(L.OP11_SQL).fetchall())
