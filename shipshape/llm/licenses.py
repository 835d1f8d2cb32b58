"""Licence scan with a positional rare-token index, in DataFrame operations only.

Licence notices are templates: words at positions. Of every text the words that any template
holds are kept with their positions. Document frequencies over all documents give each of these
words its IDF; of the mandatory words of a template that are in a file, the two of highest IDF are
looked up in the template's postings. (A file that holds a template has all of its mandatory words, so
these two are the template's own two of highest IDF; a file without them has no candidate.) A place where
both agree on the template's relative position is a candidate. Only there the template's other words are
looked for, by a join on their positions, and all words of its mandatory key phrases have to stand
there. Positions in a template are bits of a mask, so alignments are grouped ``bit_or``s that are combined
map-side, whatever a file's length.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shipshape.llm.common import row_tag, staged, text_of

# The base phrases, and short notices of known licences with their key phrases.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files", ["hereby granted free", "associated documentation files"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2",
     ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3",
     ["gnu general public license version 3"]),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3",
     ["gnu lesser general public license version 3"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3",
     ["gnu affero general public license version 3"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ["cc by nc sa 4 0"]),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", ["cc by nc nd 4 0"]),
    ("cc0-1.0", "dedicated under cc0 1 0 universal", ["cc0 1 0 universal"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution", "binary forms", "permitted"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose",
     ["copy modify", "distribute", "purpose"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["unencumbered software released", "public domain"]),
]
#: Words that are never looked up outside a key phrase.
COMMON = frozenset("a and any are for free in into is of or the this to under with without use person terms".split())
RARE = 2
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def postings(templates=TEMPLATES, base=BASE) -> list[tuple[int, str, bool, str, int, bool]]:
    """(template, label, is_base, word, position, mandatory) for each word that is looked up."""
    out = []
    for number, (label, text, keys, is_base) in enumerate(
            [(b, phrase, [phrase], True) for phrase, b in base] + [(*t, False) for t in templates]):
        words, must = text.split(), set()
        for key in keys:
            k = key.split()
            at = next(i for i in range(len(words)) if words[i:i + len(k)] == k)
            must |= set(range(at, at + len(k)))
        assert len(words) <= 63
        out += [(number, label, is_base, w, i, i in must) for i, w in enumerate(words) if i in must or w not in COMMON]
    return out


def posting_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or postings(), "template int, label string, is_base boolean, word string, "
                                                     "at int, must boolean")


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


def licence_words(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, tag, pos, word): where each document holds words of the index."""
    text = text_of(docs)
    words = docs.select("doc_id", row_tag(text).alias("tag"),
                        F.posexplode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("pos", "raw"))
    known = F.broadcast(table.select("word").distinct())  # as many rows as the templates have words
    found = words.join(known, F.lower("raw") == F.col("word"))
    return found.where(F.translate("raw", UPPER, LOWER) == F.col("word")).select("doc_id", "tag", "pos", "word")


def places(words: DataFrame, table: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, tag, template, label, is_base, start, coverage): the verified places of all templates.

    coverage is the share of the template's looked-up words that stand at their positions.
    """
    df = words.select("doc_id", "tag", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(n_docs) + 1) / (F.coalesce("df", F.lit(0)) + 1))
    order = Window.partitionBy("template").orderBy(F.col("must").desc(), F.col("idf").desc(), "at")
    index = table.join(df, "word", "left").withColumn("idf", idf).withColumn("nth", F.row_number().over(order))
    index = staged(index.withColumn("rare", F.col("must") & (F.col("nth") <= RARE)), "postings")
    whole = index.groupBy("template", "label", "is_base").agg(
        F.bit_or(F.when(F.col("rare"), _bit(F.col("at"))).otherwise(0)).alias("rare_mask"),
        F.bit_or(F.when(F.col("must"), _bit(F.col("at"))).otherwise(0)).alias("must_mask"),
        F.count(F.lit(1)).alias("n"))
    key = ["doc_id", "tag", "template", "start"]

    def aligned(rows: DataFrame) -> DataFrame:
        hits = words.join(F.broadcast(rows.select("word", "template", "at")), "word").select(
            "doc_id", "tag", "template", (F.col("pos") - F.col("at")).alias("start"), _bit(F.col("at")).alias("bit"))
        return hits.groupBy(*key).agg(F.bit_or("bit").alias("mask"))

    def holds(mask: str) -> Column:
        return F.col("mask").bitwiseAND(F.col(mask)) == F.col(mask)

    candidates = aligned(index.where("rare")).join(F.broadcast(whole), "template").where(holds("rare_mask")).select(*key)
    # the template's words at the candidate's places, and which of them the file has there
    asked = candidates.join(F.broadcast(index.select("template", F.col("word").alias("want"), "at")), "template").select(
        F.col("doc_id").alias("id"), F.col("tag").alias("t"), "template", "start", (F.col("start") + F.col("at")).alias("spot"),
        "want", _bit(F.col("at")).alias("bit"))
    there = words["doc_id"].eqNullSafe(F.col("id")) & (words["tag"] == F.col("t")) & (words["pos"] == F.col("spot")) \
        & (words["word"] == F.col("want"))
    full = asked.join(words, there).groupBy(*key).agg(F.bit_or("bit").alias("mask"))
    return full.join(F.broadcast(whole), "template").where(holds("must_mask")).select(
        "doc_id", "tag", "template", "label", "is_base", "start", (F.bit_count("mask") / F.col("n")).alias("coverage"))


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts are empty. Texts without a licence have no places, null first and last words, empty
    labels and score 0; score is else the best coverage of a verified place. Rows repeated whole
    give the same result each; a null doc_id is an id like any other. Only doc_id and text are
    read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = posting_table(spark, postings(templates, base))
    words = staged(licence_words(docs, table), "licence-words")
    found = places(words, table, docs.count())
    is_base = F.col("is_base")
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  as many as there are templates
    per_doc = found.groupBy("doc_id", "tag").agg(
        F.count(F.when(is_base, 1)).alias("n_base"), F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        labels(F.when(is_base, F.col("label"))).alias("base_labels"), labels(F.col("label")).alias("labels"),
        F.max("coverage").alias("score")).withColumnsRenamed({"doc_id": "id", "tag": "t"})
    text = text_of(docs)
    every = docs.select("doc_id", row_tag(text).alias("tag"), F.regexp_count(text, F.lit(WORD)).alias("n_words"))
    return every.join(per_doc, every["doc_id"].eqNullSafe(F.col("id")) & (F.col("tag") == F.col("t")), "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def oracle() -> str:
    """The same result by plain SQL: every alignment of every template, without an index."""
    rows = ", ".join(f"({t}, '{label}', {str(b).lower()}, '{w}', {i}, {str(m).lower()})"
                     for t, label, b, w, i, m in postings())
    return f"""
WITH p(template, label, is_base, word, place, must) AS (VALUES {rows}),
     size AS (SELECT template, count(*) AS n, sum(must::INT) AS n_must FROM p GROUP BY 1),
     d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
     w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
     hit AS (SELECT doc_id, template, label, is_base, pos - place AS start, count(*) AS n_hit, sum(must::INT) AS must_hit
             FROM w JOIN p USING (word) GROUP BY ALL),
     place AS (SELECT doc_id, label, is_base, start, n_hit / n AS coverage
               FROM hit JOIN size USING (template) WHERE must_hit = n_must),
     r AS (SELECT doc_id, count(*) FILTER (WHERE is_base) AS n_base,
                  min(start) FILTER (WHERE is_base) AS first_word, max(start) FILTER (WHERE is_base) AS last_word,
                  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base) AS base_labels,
                  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
           FROM place GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN r USING (doc_id)
"""
