"""License scans by diagonal voting.

Every rolling window of k words of a text is hashed. Hashes that some template has are joined by Spark with that
template's positions. A hit at word p of the text and word t of the template votes for the diagonal p - t. Votes are
gathered by diagonal, and each diagonal is merged with its neighbours up to `WIDTH` above it (words that the text adds; below
it, seen from the last, words that it leaves out). So a merged span is at most `WIDTH` words longer than its template, and
its hits follow one another as in the template but for so many words. A span is verified by the distinct windows of the
template that it holds, each counted once however often the text repeats it: `LEAST_COVER` of all must be there. Of
spans of a template that lie less than its length apart, the best stays (ties to the first).
Templates that are phrases must be covered in full on one diagonal, and each such diagonal is one place. Hits carry the
words themselves, which the join compares, so a hash that collides gives no vote.

Windows that no template has can't join; tasks leave them out before the shuffle by the same hashes, which are as many
as the templates have words.

Defined results: a null text, or one without words, has n_words 0, no places, no labels and score 0. Each row is one
result, repeated and null doc_ids too. An empty table gives no rows. Columns besides doc_id and text are not read.
score: the highest cover among all labels found, 1 for a phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import record_batch, small_batches
from .words import ALPHANUMERIC_LOWER, Words

# Phrases with their labels, of which every place counts.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The customary words of public license notices, with a label for each.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
}

PHRASE_K, NOTICE_K = 2, 3
#: Diagonals up to so many words apart are merged; a merged span must cover this share of the notice.
WIDTH, LEAST_COVER = 8, 0.8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) or 1


def rolling(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each start on."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(k):
        out = out * _BASE + hashes[starts + i]
    return out


def templates(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> list[tuple[int, str, bool, int, int, int, str]]:
    """(template, label, is_phrase, n_grams, position, hash, words) for each window of each template."""
    rows = []
    for number, (text, label) in enumerate([*phrases.items(), *notices.items()]):
        is_phrase = text in phrases
        k = PHRASE_K if is_phrase else NOTICE_K
        words = text.encode().split()
        hashes = np.array([word_hash(w) for w in words], np.uint64)
        grams = rolling(hashes, np.arange(len(words) - k + 1), k)
        rows += [(number, label, is_phrase, len(grams), i, int(g.astype(np.int64)), b" ".join(words[i : i + k]).decode()) for i, g in enumerate(grams)]
    return rows


def hits(docs: DataFrame, rows: list[tuple]) -> DataFrame:
    """(row, doc_id, n_words, position, hash, words): for each row one hit with a null position, and one for each
    window whose hash a template has. row numbers the rows of the table."""
    known_words = sorted({w for r in rows for w in r[6].encode().split()})
    by_k = {k: np.unique(np.array([r[5] for r in rows if len(r[6].split()) == k], np.int64).astype(np.uint64)) for k in {len(r[6].split()) for r in rows}}
    known = {w: word_hash(w) for w in known_words}
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("position", pa.int64()), ("hash", pa.int64()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches, "text"):
            n = batch.num_rows
            words = Words(batch.column(1), ALPHANUMERIC_LOWER)
            distinct = words.listed()
            # words that no template has are 0, and so are the windows that hold one
            hashes = np.fromiter((known.get(w, 0) for w in distinct), np.uint64, len(distinct))[words.word]
            number = first + np.arange(n)
            doc_ids = batch.column(0)
            yield record_batch(schema, {"row": number, "doc_id": doc_ids, "n_words": words.lengths, "position": [None] * n, "hash": [None] * n, "words": [None] * n})
            for k, table in by_k.items():
                starts, doc = words.windows(k)
                ok = hashes[starts] != 0
                for i in range(1, k):
                    ok &= hashes[starts + i] != 0
                starts, doc = starts[ok], doc[ok]
                grams = rolling(hashes, starts, k)
                ok = np.isin(grams, table)
                starts, doc, grams = starts[ok], doc[ok], grams[ok]
                if len(starts):
                    said = [b" ".join(distinct[words.word[s + i]] for i in range(k)).decode() for s in starts]
                    yield record_batch(schema, {"row": number[doc], "doc_id": doc_ids.take(pa.array(doc)), "n_words": words.lengths[doc], "position": starts - words.begins[doc], "hash": grams.astype(np.int64), "words": said})
            first += n

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "`row` long, doc_id long, n_words long, position long, hash long, words string")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row for each row of `docs`: (row, doc_id, n_words, spans), spans being an array of (label, is_phrase, first,
    last, cover), first and last being the span's first and last words in the text."""
    spark = docs.sparkSession
    rows = templates(phrases, notices)
    table = spark.createDataFrame(rows, "template int, label string, is_phrase boolean, n_grams int, at int, hash long, words string")
    found = hits(docs, rows).join(F.broadcast(table), ["hash", "words"], "left")
    found = found.filter("position is null or template is not null")
    same = ["label", "is_phrase", "n_grams"]
    # votes by diagonal; at most as many as the template has windows
    votes = found.filter("position is not null").withColumn("diagonal", F.col("position") - F.col("at")).groupBy("row", "template", "diagonal")
    votes = votes.agg(*(F.first(c).alias(c) for c in same), F.min("position").alias("first"), F.max("position").alias("last"), F.collect_set("at").alias("ats"))
    phrase = F.struct("label", "is_phrase", "first", (F.col("last") + PHRASE_K - 1).alias("last"), F.lit(1.0).alias("cover"))
    places = votes.filter(F.col("is_phrase") & (F.size("ats") == F.col("n_grams"))).select("row", phrase.alias("span"))
    # neighbouring diagonals in one, then the best among those that overlap
    merged = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, WIDTH)
    spans = votes.filter("not is_phrase").select("*", F.array_distinct(F.flatten(F.collect_list("ats").over(merged))).alias("held"), F.min("first").over(merged).alias("begin"), F.max("last").over(merged).alias("end"))
    spans = spans.withColumn("cover", F.size("held") / F.col("n_grams")).filter(F.col("cover") >= LEAST_COVER)
    lengths = Window.partitionBy("row", "template").orderBy("lengths").rangeBetween(-1, 1)
    spans = spans.withColumn("lengths", F.col("diagonal") / F.col("n_grams")).withColumn("best", F.max(F.struct("cover", -F.col("diagonal"))).over(lengths))
    notice = F.struct("label", "is_phrase", F.col("begin").alias("first"), (F.col("end") + NOTICE_K - 1).alias("last"), "cover")
    notices = spans.filter((F.col("cover") == F.col("best.cover")) & (F.col("diagonal") == -F.col("best.col2"))).select("row", notice.alias("span"))
    # a row of the table stays without spans
    rows = found.filter("position is null").select("row", "doc_id", "n_words", F.lit(None).cast(places.schema["span"].dataType).alias("span"))
    every = rows.unionByName(places.unionByName(notices), allowMissingColumns=True)
    # n_words is set in the one row that stands for the text
    return every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("span").alias("spans"))


def op6_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["is_phrase"])
    joined = lambda spans: F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    firsts = F.transform(base, lambda s: s["first"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


_ROWS = ", ".join(f"({t}, '{label}', {is_phrase}, {n}, {at}, {len(words.split())}, '{words}')" for t, label, is_phrase, n, at, _, words in templates())
ORACLE_SQL = f"""
WITH templates(template, label, is_phrase, n_grams, place, k, gram) AS (VALUES {_ROWS}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM docs),
grams AS (SELECT r, i, w || ' ' || lead(w) OVER o AS g2, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g3 FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
hits AS (
  SELECT r, template, label, is_phrase, n_grams, place, i, i - place AS diagonal
  FROM grams JOIN templates ON gram = CASE WHEN k = {PHRASE_K} THEN g2 ELSE g3 END),
diagonals AS (SELECT r, template, any_value(label) AS label, any_value(is_phrase) AS is_phrase, any_value(n_grams) AS n_grams, diagonal, min(i) AS first_word, count(DISTINCT place) AS n FROM hits GROUP BY r, template, diagonal),
good AS (
  SELECT r, label, is_phrase, first_word, 1.0::DOUBLE AS cover FROM diagonals WHERE is_phrase AND n = n_grams
  UNION ALL
  SELECT d.r, any_value(d.label), false, min(h.i), CAST(count(DISTINCT h.place) AS DOUBLE) / any_value(d.n_grams) AS cover
  FROM diagonals d JOIN hits h ON h.r = d.r AND h.template = d.template AND h.diagonal BETWEEN d.diagonal AND d.diagonal + {WIDTH}
  WHERE NOT d.is_phrase GROUP BY d.r, d.template, d.diagonal HAVING count(DISTINCT h.place) >= {LEAST_COVER}::DOUBLE * any_value(d.n_grams)),
found AS (
  SELECT r, count(*) FILTER (WHERE is_phrase) AS n_base, min(first_word) FILTER (WHERE is_phrase) AS first_word, max(first_word) FILTER (WHERE is_phrase) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
  FROM good GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN found USING (r)
"""
