"""Licence scan over a positional index of rare words, in DataFrame functions only.

Two findings a document: base places, where the words of a base phrase stand
consecutively, and licence templates. A template is found in four steps:

1. each template is posted by the highest-IDF words of its mandatory key
   phrases, and these are looked up in the file; IDF comes from the document
   frequency over all documents (the licence vocabulary is fixed, so these are
   some hundred counts);
2. their positions meet the template postings on the word, and the relative
   position (place in the file less place in the template) is counted; it is
   negative where the file begins within the template;
3. relative positions with all posted places give candidate alignments;
4. an alignment counts if the mandatory key phrases stand at their places and
   the words that agree hold most of the template's IDF.

Documents without any licence word never leave the first scan.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize

# The contract's base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Label, template words, mandatory key phrases. Wording of the
# licences' own notices.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "associated documentation files")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "binary forms")),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)

# Words of the templates that say nothing about licences.
STOP_WORDS = frozenset("a and any are by charge copy files forms free in is nc of or person sa source subject terms the this to under use v with without 0 2 3 4".split())

#: Highest-IDF words of a template's mandatory phrases that are posted.
POSTED = 2
#: Share of a template's IDF that has to agree.
COVERAGE = 0.6

#: Words of letters, digits and non-ASCII, of either case, and what separates them.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_INSIDE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()} - STOP_WORDS)


def _places(words: Column, phrase: str) -> Column:
    """Starts (from 0) of the phrase's words standing consecutively."""
    said = phrase.split()
    last = F.size(words) - len(said)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: reduce(lambda x, y: x & y, [F.get(words, i + k) == w for k, w in enumerate(said)]))


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BETWEEN), lambda w: w != "")


def _first_scan(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), n_words, base findings; the text of documents with licence words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = sorted({*_vocabulary(), *(p.split()[-1] for p, _ in BASE), *(p.split()[0] for p, _ in BASE)} - {"by", "all", "general"})
    hint = f"(?i)(?<!{_INSIDE})(?:{'|'.join(known)})(?!{_INSIDE})"
    scan = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.sha2("text", 256).alias("key"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
        F.when(F.col("text").rlike(hint), F.col("text")).alias("hinted"),
    )
    scan = scan.withColumn("words", F.when(F.col("hinted").isNotNull(), _words(F.col("hinted"))))
    places = F.array(*(F.struct(F.lit(label).alias("label"), _places(F.col("words"), phrase).alias("at")) for phrase, label in BASE))
    scan = scan.withColumn("places", F.when(F.col("words").isNotNull(), places))
    starts = F.flatten(F.transform("places", lambda p: p["at"]))
    found = F.filter("places", lambda p: F.size(p["at"]) > 0)
    return scan.select(
        "doc_id",
        "key",
        "n_words",
        "hinted",
        F.coalesce(F.size(starts), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.coalesce(F.transform(found, lambda p: p["label"]), F.array().cast("array<string>")).alias("base"),
    )


def _literal(spark: SparkSession, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """A small fixed table as a literal of the plan."""
    value = lambda x: F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(value(x).alias(n) for n, x in zip(names, row, strict=True))) for row in rows))))


def _templates(scan: DataFrame) -> DataFrame:
    """(doc_id, key, found labels, coverage) of documents with a verified template."""
    spark = scan.sparkSession
    vocabulary = _vocabulary()
    hinted = scan.where("hinted IS NOT NULL").select("doc_id", "key", "hinted")
    files = hinted.select("doc_id", "key", _words(F.col("hinted")).alias("words"))
    licence = F.array(*map(F.lit, vocabulary))
    counts = files.select(F.explode(F.array_intersect(licence, F.col("words"))).alias("word")).groupBy("word").count()
    df = {row["word"]: row["count"] for row in counts.collect()}  # at most as many rows as the fixed vocabulary
    total = scan.count()
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) for w in vocabulary}

    posted, known = [], []
    for t, (label, text, phrases) in enumerate(TEMPLATES):
        words = text.split()
        held = {k + i for p in phrases for k in range(len(words)) if words[k : k + len(p.split())] == p.split() for i in range(len(p.split()))}
        must = [k in held for k in range(len(words))]
        rarest = sorted({words[k] for k in held} - STOP_WORDS, key=lambda w: (-idf[w], w))[:POSTED]
        places = [(t, words[k], k) for k in sorted(held) if words[k] in rarest]
        posted += places
        known.append((t, label, words, [idf.get(w, 0.0) + 0.01 for w in words], must, len(places)))
    looked_up = F.array(*map(F.lit, sorted({w for _, w, _ in posted})))
    at = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains(looked_up, x["word"]))
    hits = files.select("doc_id", "key", F.explode(at).alias("hit"))
    hits = hits.select("doc_id", "key", F.col("hit.word").alias("word"), F.col("hit.at").alias("at"))
    postings = _literal(spark, ("template", "word", "place"), posted)
    templates = _literal(spark, ("template", "label", "said", "weight", "must", "least"), known)

    lined = hits.join(F.broadcast(postings), "word").groupBy("doc_id", "key", "template", (F.col("at") - F.col("place")).alias("shift"))
    # a repeated row meets the same places again
    lined = lined.agg(F.count_distinct("place").alias("met"))
    lined = lined.join(F.broadcast(templates), "template").where("met >= least")
    whole = hinted.select(F.col("doc_id").alias("file_id"), F.col("key").alias("file_key"), "hinted")
    lined = lined.join(whole, F.col("doc_id").eqNullSafe(F.col("file_id")) & (F.col("key") == F.col("file_key")))
    # words of the template before the file's first are not there
    before = F.greatest(-F.col("shift"), F.lit(0)).cast("int")
    heard = F.concat(F.array_repeat(F.lit(None).cast("string"), before), F.slice(_words(F.col("hinted")), (F.greatest("shift", F.lit(0)) + 1).cast("int"), F.size("said") - before))
    there = F.zip_with("said", heard, lambda w, v: F.coalesce(v == w, F.lit(False)))
    # there stands outside the lambdas, which would split the text again for every word
    lined = lined.withColumn("there", there).where(F.forall(F.zip_with("there", "must", lambda h, m: h | ~m), lambda x: x))
    add = lambda s, x: s + x
    agreed = F.aggregate(F.zip_with("there", "weight", lambda h, w: F.when(h, w).otherwise(0.0)), F.lit(0.0), add)
    lined = lined.withColumn("coverage", F.round(agreed / F.aggregate("weight", F.lit(0.0), add), 6)).where(F.col("coverage") >= COVERAGE)
    return lined.groupBy("doc_id", "key").agg(F.collect_set("label").alias("found"), F.max("coverage").alias("coverage"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence findings for every row of docs.

    doc_id, n_words, n_base (base places), first_word and last_word (smallest
    and largest start of a base place, else null), base_labels and labels
    (distinct, sorted, comma-joined; labels holds the templates' too), score:
    the best coverage of a verified template, at least 0.5 with a base place,
    else 0. A null or empty text has no words and no findings. Repeated rows
    are each returned; other columns are not read.
    """
    scan = materialize(_first_scan(docs), "licences")
    found = _templates(scan).select(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key"), "found", "coverage")
    joined = scan.drop("hinted").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
