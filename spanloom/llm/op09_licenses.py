"""License scans by diagonal voting, in DataFrame functions only.

Templates are short notices, cut into words like the texts. All rolling word pairs of
all texts are hashed and joined to the pairs of the templates (a fixed list, so its
size is known and it is broadcast). A hit at word p of a text and word t of a template
votes for diagonal p - t: a text that holds the template at p0 sends all its hits to
diagonal p0, whatever lies around. Votes are summed per (text, template, diagonal)
before anything is shuffled; as a bit per template place they also show what is
covered. Neighbouring diagonals (a word more or less in between) are merged, and a
span counts if it covers COVERED of the template's pairs within STRETCH times its length.
Templates that share ALIKE of their pairs (versions of one licence) are told apart by
the others: a span of such a template has to cover all its pairs that its siblings have not.

The base phrases are templates as well: they count where one diagonal has all pairs.

Defined cases: a null text counts as empty (no words, no labels, score 0); a phrase
that occurs twice counts twice; repeated rows (and null doc_ids) are scanned each, as
rows are told apart by their place in the scan; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import ascii_lower

#: Phrase and label; fixed by the query's contract.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Wording of public license notices; at most 63 words each, as a place is a bit of a long.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit-text"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0-header"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-header"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
NEAR = 3
COVERED = 0.75
#: Share of the pairs of the shorter one of two siblings that both have.
ALIKE = 0.65
STRETCH = 1.5
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; characters below 0x80 other than letters and digits part them."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS)
    return F.array_remove(parts, "")


def telling(notices) -> list[int]:
    """For each notice the places, as bits, of the word pairs that tell it from its siblings; 0 without siblings."""
    pairs = [[*zip(words, words[1:])] for words in (text.split() for text, _ in notices)]
    out = []
    for own in pairs:
        siblings = [set(other) for other in pairs if other is not own and len({*own} & {*other}) >= ALIKE * min(len({*own}), len({*other}))]
        out.append(sum(1 << i for i, pair in enumerate(own) if not any(pair in other for other in siblings)) if siblings else 0)
    return out


def templates(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    """pair (hash), place, bit, template, label, pairs (of the template), need (bits of the pairs that tell it from its siblings), is_base."""
    needs = [0] * len(base) + telling(notices)
    rows = [(i, text, label, needs[i], i < len(base)) for i, (text, label) in enumerate((*base, *notices))]
    words = spark.createDataFrame(rows, "template int, text string, label string, need long, is_base boolean").withColumn("w", words_of(F.col("text")))
    pairs = words.select("template", "label", "is_base", "need", (F.size("w") - 1).alias("pairs"), F.posexplode(pair_hashes(F.col("w"))).alias("place", "pair"))
    return pairs.withColumn("bit", F.expr("shiftleft(1L, place)"))


def pair_hashes(words: Column) -> Column:
    """Rolling hashes of two words; none for fewer words."""
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.xxhash64(a, b)))


def votes(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per text and diagonal: row, doc_id, n_words, template, ..., diagonal, mask, first, last; a text without hits has one row of nulls."""
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words_of(F.col("text")).alias("w"))
    rolling = words.select("row", "doc_id", F.size("w").alias("n_words"), F.posexplode_outer(pair_hashes(F.col("w"))).alias("p", "pair"))
    hits = rolling.join(F.broadcast(patterns), "pair", "left")
    place = F.when(F.col("template").isNotNull(), F.col("p"))
    return hits.groupBy("row", "doc_id", "n_words", "template", "label", "is_base", "pairs", "need", (place - F.col("place")).alias("diagonal")).agg(
        F.bit_or("bit").alias("mask"), F.min(place).alias("first"), F.max(place).alias("last"))


def spans(voted: DataFrame) -> DataFrame:
    """Merged and verified: row, doc_id, n_words, label, is_base, start, end (words), covered (0 to 1); rows without a span stay with nulls."""
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    # base phrases aren't merged: each diagonal is a place of its own
    cut = voted.withColumn("cut", F.when(gap.isNull() | F.col("is_base") | (gap > NEAR), 1).otherwise(0))
    merged = cut.withColumn("span", F.sum("cut").over(order)).groupBy("row", "doc_id", "n_words", "template", "label", "is_base", "pairs", "need", "span").agg(
        F.bit_or("mask").alias("mask"), F.min("first").alias("start"), (F.max("last") + 2).alias("end"))
    covered = F.bit_count("mask") / F.col("pairs")
    told = F.col("mask").bitwiseAND(F.col("need")) == F.col("need")
    sound = F.when(F.col("is_base"), covered == 1).otherwise((covered >= COVERED) & told & (F.col("end") - F.col("start") <= STRETCH * (F.col("pairs") + 1)))
    kept = lambda c: F.when(sound, F.col(c)).alias(c)
    return merged.select("row", "doc_id", "n_words", kept("label"), kept("is_base"), kept("start"), kept("end"), F.when(sound, covered).alias("covered"))


def scan(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """Verified spans of docs(doc_id, text), one row per text at least."""
    return spans(votes(docs.select(F.col("doc_id").cast("long"), "text"), templates(docs.sparkSession, base, notices)))


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(labels), ",")


def op9_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.col("is_base")
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), joined(F.collect_set("label")).alias("labels"),
        F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"),
    ).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _rows(items) -> str:
    return ", ".join(f"({i}, '{text}', '{label}', {str(i < len(BASE)).lower()})" for i, (text, label) in enumerate(items))


ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), templates AS (
  SELECT template, label, is_base, string_split(text, ' ') AS w FROM (VALUES {_rows((*BASE, *NOTICES))}) t(template, text, label, is_base)
), template_pairs AS (
  SELECT template, label, is_base, len(w) - 1 AS pairs, i - 1 AS place, w[i] || ' ' || w[i + 1] AS pair FROM templates, unnest(range(1, len(w))) u(i)
), common AS (
  SELECT a.template, b.template AS other, count(DISTINCT a.pair) AS n FROM template_pairs a JOIN template_pairs b ON a.pair = b.pair AND a.template <> b.template
  WHERE NOT a.is_base AND NOT b.is_base GROUP BY ALL
), sizes AS (
  SELECT template, count(DISTINCT pair) AS n FROM template_pairs GROUP BY template
), siblings AS (
  SELECT common.template, other FROM common JOIN sizes a ON a.template = common.template JOIN sizes b ON b.template = other WHERE common.n >= {ALIKE} * least(a.n, b.n)
), needs AS (
  SELECT template, bit_or(1::BIGINT << place) AS need FROM template_pairs p WHERE template IN (SELECT template FROM siblings)
    AND NOT EXISTS (SELECT 1 FROM siblings s JOIN template_pairs q ON q.template = s.other WHERE s.template = p.template AND q.pair = p.pair) GROUP BY template
), doc_pairs AS (
  SELECT row, i - 1 AS p, w[i] || ' ' || w[i + 1] AS pair FROM docs, unnest(range(1, len(w))) u(i)
), voted AS (
  SELECT row, template, label, is_base, pairs, p - place AS diagonal, bit_or(1::BIGINT << place) AS mask, min(p) AS first, max(p) AS last
  FROM doc_pairs JOIN template_pairs USING (pair) GROUP BY ALL
), cut AS (
  SELECT *, CASE WHEN is_base OR coalesce(diagonal - lag(diagonal) OVER o, 99) > {NEAR} THEN 1 ELSE 0 END AS cut FROM voted WINDOW o AS (PARTITION BY row, template ORDER BY diagonal)
), numbered AS (
  SELECT *, sum(cut) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM cut
), merged AS (
  SELECT row, template, label, is_base, pairs, span, bit_count(bit_or(mask)) / pairs AS covered, bit_or(mask) AS mask, min(first) AS start, max(last) + 2 AS stop FROM numbered GROUP BY row, template, label, is_base, pairs, span
), sound AS (
  SELECT * FROM merged LEFT JOIN needs USING (template)
  WHERE CASE WHEN is_base THEN covered = 1 ELSE covered >= {COVERED} AND mask & coalesce(need, 0) = coalesce(need, 0) AND stop - start <= {STRETCH} * (pairs + 1) END
)
SELECT doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(*) FILTER (is_base) AS n_base,
  CAST(min(start) FILTER (is_base) AS BIGINT) AS first_word, CAST(max(start) FILTER (is_base) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (is_base))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list(label))), ','), '') AS labels, coalesce(max(covered), 0.0)::DOUBLE AS score
FROM docs LEFT JOIN sound USING (row) GROUP BY row, doc_id
"""
