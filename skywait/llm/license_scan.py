"""License scans by diagonal voting: k-gram joins, diagonals, verified spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import settle

K = 3
#: Share of a template's k-grams that a span must hold.
COVERAGE = 0.75
#: Diagonals at most this far apart are one span (words put in or left out).
GAP = 3
#: A span ends where the next match starts more than this share of the template's words later.
FAR = 0.5

# Phrases of the base scan and their labels.
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Well-known notices of public licenses, as words.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("released under the gnu general public license version 2", "gpl-2"),
    ("it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gpl-3"),
    ("it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "gpl-2"),
    ("it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
]

# Whole texts of public licenses, as words.
LONG_TEMPLATES = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages "
        "or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
        "code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
        "basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl-3",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl-2",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever "
        "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
        "isc",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following "
        "restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "zlib",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source "
        "code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at "
        "http mozilla org mpl 2 0",
        "mpl-2",
    ),
    (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the "
        "software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        "bsl-1",
    ),
    (
        "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0",
        "cc-by-sa",
    ),
    (
        "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
        "cc0",
    ),
]
TEMPLATES += LONG_TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of ASCII letters and digits and of characters beyond ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def rolling(words: str, k: int) -> Column:
    """Hashes of all k-grams of a column of words."""
    n = F.size(words)
    grams = F.transform(
        F.slice(words, 1, F.greatest(n - (k - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]),
    )
    return F.when(n < k, F.array().cast("array<bigint>")).otherwise(grams)


def template_positions(spark: SparkSession, templates: list[tuple[str, str, bool]], k: int) -> DataFrame:
    """(gram, template, at, grams, size, label, base): a few hundred rows, set by the templates alone."""
    rows = [(i, text.split(), label, base) for i, (text, label, base) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, words array<string>, label string, base boolean")
    return (
        table.withColumn("grams", F.size("words") - (k - 1)).withColumn("size", F.size("words"))
        .select("template", "grams", "size", "label", "base", F.posexplode(rolling("words", k)).alias("at", "gram"))
    )


def spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, k: int = K, coverage: float = COVERAGE, gap: int = GAP, far: float = FAR) -> DataFrame:
    """Verified spans: doc_id, text_key, template, label, base, first_word, end_word, score.

    All rolling k-gram hashes of all texts meet the templates' positions in one join (the
    template side is a fixed table of a few thousand rows). A match votes for the diagonal
    (word - template position). A template's votes in a text are cut where none follows within
    a share `far` of its words; in each part neighbouring diagonals merge, and what merged is cut by
    the same distance again, so a stray match elsewhere on a diagonal stretches no span. A
    span stands if it holds at least coverage of the template's k-grams in at most
    twice its words. Base phrases must stand exactly: one diagonal, all k-grams.
    """
    spark = docs.sparkSession
    both = [(t, label, True) for t, label in BASE_PHRASES] + [(t, label, False) for t, label in templates or TEMPLATES]
    positions = template_positions(spark, both, k)
    grams = (
        docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), license_words(F.col("text")).alias("words"))
        .select("doc_id", "text_key", F.posexplode(rolling("words", k)).alias("word", "gram"))
    )
    key = ["doc_id", "text_key", "template"]
    about = [F.first(c).alias(c) for c in ("label", "base", "grams", "size")]
    votes = grams.join(F.broadcast(positions), "gram").groupBy(*key, "word", "at").agg(*about)  # equal rows vote once
    votes = settle(votes.withColumn("diagonal", F.col("word") - F.col("at")))  # few rows, used twice: the texts are read once
    exact = (
        votes.where("base").groupBy(*key, "diagonal").agg(*about, F.count("*").alias("votes"), F.min("word").alias("first_word"), F.max("word").alias("high"))
        .where("votes = grams").withColumn("score", F.lit(1.0)).withColumn("end_word", F.col("high") + k)
    )

    def cut(rows: DataFrame, name: str, within: list[str], order: list[str], value: str, most: Column) -> DataFrame:
        """Number the parts of rows, in order, between which value grows by over most."""
        line = Window.partitionBy(*within).orderBy(*order)
        opens = F.coalesce(F.col(value) - F.lag(value).over(line) > most, F.lit(True))
        return rows.withColumn("_opens", opens.cast("int")).withColumn(name, F.sum("_opens").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")

    away = F.lit(far) * F.col("size")
    parts = cut(votes.where("not base"), "place", key, ["word", "at"], "word", away)
    parts = cut(parts, "band", [*key, "place"], ["diagonal", "word"], "diagonal", F.lit(gap))
    parts = cut(parts, "span", [*key, "place", "band"], ["word", "at"], "word", away)
    merged = (
        parts.groupBy(*key, "place", "band", "span")
        .agg(*about, F.count_distinct("at").alias("votes"), F.min("word").alias("first_word"), F.max("word").alias("high"))
        .withColumn("score", F.col("votes") / F.col("grams"))
        .withColumn("end_word", F.col("high") + k)
        .where((F.col("score") >= coverage) & (F.col("end_word") - F.col("first_word") <= 2 * F.col("size") + k))
    )
    out = [*key, "label", "base", "first_word", "end_word", "score"]
    return exact.select(*out).unionByName(merged.select(*out))


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases; first_word and last_word are their smallest
    and largest start (null without one). labels adds those of verified spans. Label
    columns are distinct, sorted and comma-joined ('' without one). score is the best
    span's share of template k-grams (0 without one). Null and empty texts have no words and
    no labels; texts of any length are read whole; repeated rows get equal results each;
    null ids are matched by text; other columns stay out; an empty table gives an empty result.
    """
    found = spans(docs, **options)
    base = F.col("base")
    by_doc = found.groupBy("doc_id", "text_key").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    all_docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.size(license_words(F.col("text"))).cast("long").alias("n_words"))
    same = all_docs["doc_id"].eqNullSafe(by_doc["doc_id"]) & (all_docs["text_key"] == by_doc["text_key"])
    return all_docs.join(by_doc, same, "left").select(
        all_docs["doc_id"],
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
