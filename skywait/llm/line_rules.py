"""Quality rules: text statistics and cross-document line frequency, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle
from .common import SPACE_CHARS, broadcast_if_small, others_aside, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate on a host if more distinct documents than both of these have it.
LINE_DOCS = 20
LINE_SHARE = 0.02
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.2


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS)) != ""


def _line_key(line: Column) -> Column:
    """Hash of a normalised line: lower case, digits as 0, white space squeezed."""
    squeezed = F.btrim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))
    return F.substring(F.md5(F.regexp_replace(squeezed, "[0-9]+", "0")), 1, 16)


def text_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    text = F.coalesce("text", F.lit(""))
    hashed = docs.withColumn("_w", F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).withColumn(
        "_lines", F.transform(F.filter(F.split(text, "\n"), _has_word), lambda x: F.xxhash64(x))
    )
    n = F.size("_w")
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.slice("_w", 1, F.greatest(n - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)),
        )
    )
    # Sorting brings equal windows side by side; only texts that repeat one are sorted.
    sorted_windows = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.filter(
        "_sorted",
        lambda s, i: (s["h"] == F.get("_sorted", i + 1)["h"]) | ((i > 0) & (s["h"] == F.get("_sorted", i - 1)["h"])),
    )
    covered = F.flatten(F.transform(repeated, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))
    no_rows = F.array().cast("array<struct<h:bigint,i:int>>")
    return (
        hashed.withColumn("_windows", windows)
        .withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), no_rows).otherwise(sorted_windows))
        .withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, SPACE_CHARS, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("long"))
        .drop("_w", "_lines", "_windows", "_sorted")
    )


def judge(
    docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE,
    min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """docs' verdicts, one row a document: doc_id, the statistics, base_failed, n_removed_words, kept.

    Lines are hashed and counted per host (source; null is a host of its own). Documents
    with the same set of lines are one document to that count, so copies of one text do not
    make its lines boilerplate; all others count, near copies too. A line that more than line_docs and more than
    line_share of the host's documents have is removed; a document with less than left_share
    of its words left is depleted and not kept. Null and blank texts have no words and
    fail the base rule; very long texts and repeated rows are judged like others; an
    empty table gives an empty result.
    """
    return _verdicts(docs, line_docs, line_share, left_share, min_words, max_repeat_percent).drop("source", "text_key")


@others_aside("doc_id", "source", "text", "n_chars")
def cleaned(docs: DataFrame, **options) -> DataFrame:
    """docs that judge() keeps, their texts without the lines that are frequent on their host.

    A row's id, host and text decide, so rows without an id are judged too. The other lines
    stay as they are, in order; n_chars, if docs has it, follows the text; other columns,
    whatever their names, go along.
    """
    limits = {"line_docs": LINE_DOCS, "line_share": LINE_SHARE, "left_share": LEFT_SHARE, "min_words": MIN_WORDS, "max_repeat_percent": MAX_REPEAT_PERCENT} | options
    names = ["doc_id", "source", "text_key"]
    verdicts = settle(_verdicts(docs, **limits, keys=True).select(*names, "kept", "removed_keys").where("not kept or removed_keys is not null"))
    gone = verdicts.where("not kept").select(*names).distinct()
    shorter = verdicts.where("kept").select(*names, F.col("removed_keys").alias("_removed_keys")).dropDuplicates(names)
    left = _same_row(docs.withColumn("_text_key", _text_key()), gone, "left_anti")
    marked = _same_row(left, shorter, "left")
    stays = F.filter(F.split("text", "\n"), lambda x: ~_has_word(x) | ~F.array_contains("_removed_keys", _line_key(x)))
    changed = F.col("_removed_keys").isNotNull()
    out = marked.withColumn("_cleaned", F.when(changed, F.array_join(stays, "\n")).otherwise(F.col("text")))
    columns = {"text": F.col("_cleaned")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length("_cleaned")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def _same_row(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs (with _text_key) joined to rows of their id, host and text; few rows are broadcast."""
    renamed = rows.withColumnsRenamed({c: f"_{c}_" for c in ("doc_id", "source", "text_key")})
    few = broadcast_if_small(renamed)
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id_")) & F.col("source").eqNullSafe(F.col("_source_")) & (F.col("_text_key") == F.col("_text_key_"))
    return docs.join(few, same, how)


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _verdicts(
    docs: DataFrame, line_docs: int, line_share: float, left_share: float, min_words: int, max_repeat_percent: int, keys: bool = False,
) -> DataFrame:
    """judge()'s rows with source and text_key; with keys, also removed_keys (null if no line is removed)."""
    n = F.col("n_words")
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n)
    lines = F.transform(
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), _has_word),
        lambda x: F.struct(_line_key(x).alias("key"), F.size(words(x)).alias("n")),
    )
    base = settle(
        text_statistics(docs.select("doc_id", "source", "text"))
        .withColumn("base_failed", failed)
        .withColumn("lines", lines)
        .withColumn("copy", F.xxhash64(F.array_sort(F.array_distinct(F.transform("lines", lambda s: s["key"])))))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("text_key", _text_key())
        .drop("text")
    )
    hosts = base.groupBy("source").agg(F.count("*").alias("host_docs"))
    each = base.select("row", "source", "copy", F.explode("lines").alias("line")).select("row", "source", "copy", "line.*")
    frequent = (
        each.groupBy("source", "key").agg(F.countDistinct("copy").alias("docs")).where(F.col("docs") > line_docs)
        .alias("f").join(hosts.alias("h"), F.col("f.source").eqNullSafe(F.col("h.source")))
        .where(F.col("docs") > line_share * F.col("host_docs"))
        .select(F.col("f.source").alias("source"), "key")
    )
    removed = (
        each.alias("e").join(frequent.alias("f"), (F.col("e.key") == F.col("f.key")) & F.col("e.source").eqNullSafe(F.col("f.source")))
        .groupBy("row").agg(F.sum("n").alias("n_removed_words"), *[F.collect_set("e.key").alias("removed_keys")] * keys)
    )
    left = n - F.col("n_removed_words")
    return (
        base.drop("lines", "copy").join(removed, "row", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & ~((F.col("n_removed_words") > 0) & (left < left_share * n)))
        .drop("row")
    )
