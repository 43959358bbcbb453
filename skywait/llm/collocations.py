"""Collocations by hierarchical pair naming.

Texts are cut into slices that keep their word positions. A k-gram is the pair of the frequent
(k-1)-grams at two neighbouring positions: each slice replaces neighbours by numbers of its own
and sends one row for each distinct pair; pairs are counted and named globally where their rows
meet, and the names return to the slices, row by row, for the next round. A name's two parents are the k-gram without its last
and without its first word, so cuts and containment are looked up along them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import forget, settle
from .common import broadcast_if_small, lean, slices, small_batches, text_bytes

LEAST = 10
LONGEST = 3
TOP = 2000
INSIDE_PERCENT = 50
SCALE = 1_000_000
BREAKS, SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
SLICE_BYTES = 8_000_000
_KIND, _LOWER = np.zeros(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
_KIND[list(SPACES)], _KIND[list(BREAKS)] = 1, 2
_LOWER[65:91] += 32


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of all texts in a row, and which of them are followed by a word of the same piece."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[0] == ends[-1]:
        return pa.array([], pa.string()), np.zeros(0, dtype=bool)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    first = (ends[:-1] - ends[0])[ends[:-1] < ends[1:]]  # where texts begin
    kind = _KIND[data]
    inside, after = kind == 0, np.zeros(len(data), dtype=bool)
    after[1:] = inside[:-1]
    after[first] = False
    starts = np.flatnonzero(inside & ~after)
    cuts = (kind == 2).astype(np.int32)
    cuts[first] += 1
    piece = np.cumsum(cuts, dtype=np.int32)[starts]
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    before = np.cumsum(inside, dtype=np.int32)
    if len(starts):
        offsets[:-1], offsets[-1] = before[starts] - 1, before[-1]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]]))
    follows = np.zeros(len(starts), dtype=bool)
    follows[:-1] = piece[:-1] == piece[1:]
    return words, follows


#: A slice has one row with these, and one for each distinct k-gram.
_UNITS = "units binary, follows binary"
_BATCH_ROWS = 100_000


def _batches(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The table in batches of a few MB; columns of the schema that it lacks are null."""
    columns = [table[f.name].cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in schema]
    yield from pa.table(columns, schema=schema).to_batches(_BATCH_ROWS)


def sliced(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(slice, lang, spot, word, count, units, follows): texts of a language with their words numbered.

    A slice has a row for each distinct word, with its number (spot) and count, and one whose units
    hold the number of every word in turn (int32), and whose follows has a bit for each; a word that
    no text has deals that one out like the rest. Rows are one a word whatever the slice holds. Slices are numbered by the words before them in their task, so
    slice + spot is unique for words and for k-grams of any one length.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("slice", pa.int64()), ("lang", pa.string()), ("spot", pa.int32()), ("word", pa.string()), ("count", pa.int64()), ("units", pa.binary()), ("follows", pa.binary())])

    @lean
    def cut(batches: Iterator[pa.RecordBatch]):
        number = TaskContext.get().partitionId() << 33
        held, size = [], 0

        def flush():
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            langs = table["lang"].combine_chunks()
            for lang in pc.unique(langs).to_pylist():
                texts = table["text"].combine_chunks().filter(pc.equal(langs, lang))
                for a, b in slices(text_bytes(texts), slice_bytes):
                    words, follows = split_words(texts.slice(a, b - a))
                    if not len(words):
                        continue
                    coded = words.dictionary_encode()
                    units = coded.indices.to_numpy()
                    counts = np.bincount(units, minlength=len(coded.dictionary))
                    mine = {"slice": pa.array([number]), "lang": pa.array([lang]), "word": pa.array([f" {number}"]), "units": pa.array([units.astype("<i4").tobytes()]), "follows": pa.array([np.packbits(follows).tobytes()])}
                    yield from _batches(pa.table(mine), schema)
                    n = len(counts)
                    mine = {"slice": np.full(n, number), "lang": pa.array([lang]).take(pa.array(np.zeros(n, dtype=np.int32))), "spot": np.arange(n, dtype=np.int32), "word": coded.dictionary, "count": counts}
                    yield from _batches(pa.table(mine), schema)
                    number += len(units)

        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= slice_bytes:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(cut, f"slice long, lang string, spot int, word string, count long, {_UNITS}")


def paired(held: DataFrame, more: bool) -> DataFrame:
    """(slice, spot, left, right, count, units, follows): pairs of named neighbours in each slice, as names of their parents.

    held has slice, spot, id (the global name of the slice's number spot), and a row a slice with
    units and follows (null beyond words: neighbours then overlap, so they stand in one piece).
    more keeps the units for another round, under a pair of names that no other row has. A task holds
    one slice at a time.
    """
    schema = pa.schema([("slice", pa.int64()), ("spot", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("count", pa.int64()), ("units", pa.binary()), ("follows", pa.binary())])

    def pair(number: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        whole = pc.is_valid(table["units"])
        own, named = table.filter(whole), table.filter(pc.invert(whole))
        units = np.frombuffer(own["units"][0].as_py(), dtype="<i4")
        spots, names = named["spot"].to_numpy(), named["id"].to_numpy()
        most = int(max(units.max(initial=-1), spots.max(initial=-1))) + 1
        dense = np.full(most + 1, -1, dtype=np.int64)
        dense[spots] = np.arange(len(spots))
        at = dense[units]  # -1, the last place, has no name either
        both = (at[:-1] >= 0) & (at[1:] >= 0)
        follows = own["follows"][0].as_py()
        if follows is not None:
            both &= np.unpackbits(np.frombuffer(follows, dtype=np.uint8), count=len(units))[:-1].astype(bool)
        keys, code, counts = np.unique(at[:-1][both] * len(names) + at[1:][both], return_inverse=True, return_counts=True)
        if not len(keys):
            return
        if more:
            out = np.full(len(units), -1, dtype="<i4")
            out[:-1][both] = code
            yield from _batches(pa.table({"slice": pa.array([number]), "left": pa.array([number]), "right": pa.array([-1]), "units": pa.array([out.tobytes()])}), schema)
        found = {"slice": np.full(len(keys), number), "spot": np.arange(len(keys), dtype=np.int32), "left": names[keys // len(names)], "right": names[keys % len(names)], "count": counts}
        yield from _batches(pa.table(found), schema)

    @lean
    def each(batches: Iterator[pa.RecordBatch]):
        number, parts = None, []
        for b in batches:
            numbers = b.column("slice").to_numpy()
            cuts = (np.flatnonzero(np.diff(numbers)) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
                if i < j and numbers[i] != number:
                    if parts:
                        yield from pair(number, parts)
                    number, parts = int(numbers[i]), []
                parts.append(b.slice(i, j - i))
        if parts:
            yield from pair(number, parts)

    together = held.select("slice", "spot", "id", "units", "follows").repartition("slice").sortWithinPartitions("slice")
    return together.mapInArrow(each, f"slice long, spot int, left long, right long, count long, {_UNITS}")


def _named(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """(slice, spot, id, the key, f, units, follows): a round's k-grams that occur at least so often, settled.

    A k-gram's id is its smallest slice + spot; the row there has the key and f, so these are the
    names, the others have null. Rows with units come along, with no id and no f.
    """
    own, whole = F.col("slice") + F.col("spot"), F.col("units").isNotNull()
    same = Window.partitionBy("spread", *key)  # spread: sorted by it, few rows tie
    dealt = rows.repartition(*key).withColumn("spread", F.xxhash64(*key))
    found = dealt.withColumn("f", F.sum("count").over(same)).withColumn("id", F.min(own).over(same)).where(whole | (F.col("f") >= least))
    return settle(found.select("slice", "spot", "id", *[F.when(whole | (F.col("id") == own), F.col(c)).alias(c) for c in (*key, "f")], "units", "follows"))


def score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)) of SQL expressions, exact for counts up to 10 ** 14."""
    a, left, right = (f"cast({x} as decimal(14,0))" for x in (a, left, right))
    return F.expr(f"({a} * {a} * cast({SCALE} as decimal(7,0))) div ({left} * {right})")


def candidates(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside_percent: int = INSIDE_PERCENT, slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(phrases, sizes): all phrases that stay (lang, phrase, a, l, r, score), and (lang, n)."""
    held = _named(sliced(docs, slice_bytes), ["lang", "word"], least)
    sizes = settle(held.where(F.col("units").isNotNull()).groupBy("lang").agg(F.sum(F.expr("octet_length(units) div 4")).alias("n")))
    names, levels = held.where(F.col("f").isNotNull()), []
    level = settle(names.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array().cast("array<long>").alias("heads"), F.array().cast("array<long>").alias("tails")))
    for size in range(2, longest + 1):
        before, now = held, paired(held, size < longest)
        if size < longest:
            held = _named(now, ["left", "right"], least)
            names = held.where(F.col("f").isNotNull()).select("id", "left", "right", "f")
        else:  # nothing returns to the slices
            names = settle(now.groupBy("left", "right").agg(F.sum("count").alias("f")).where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()))
        forget(before)
        first = level.select(F.col("id").alias("left"), "lang", "phrase", F.concat("heads", F.array("f")).alias("heads"))
        rest = level.select(F.col("id").alias("right"), "last", F.concat("tails", F.array("f")).alias("tails"))
        level = settle(
            names.join(first, "left").join(rest, "right")
            .select("id", "left", "right", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", "heads", "tails")
        )
        levels.append(level)
    kept = []
    for k, level in enumerate(levels):
        cuts = []
        for j in range(k + 1):  # the first j + 1 words, and the k + 1 - j after them
            head, tail = f"heads[{j}]", f"tails[{k - j}]"
            cuts.append(F.struct(score("f", head, tail).alias("score"), F.lit(j + 1).alias("cut"), F.expr(head).alias("l"), F.expr(tail).alias("r")))
        stays = level
        if k + 1 < len(levels):
            longer = levels[k + 1]
            around = longer.select(F.col("left").alias("id"), F.col("f").alias("more")).unionByName(longer.select(F.col("right").alias("id"), F.col("f").alias("more")))
            stays = level.join(around.groupBy("id").agg(F.max("more").alias("more")), "id", "left").where(F.col("more").isNull() | (100 * F.col("more") < inside_percent * F.col("f")))
        kept.append(stays.withColumn("best", F.array_min(F.array(*cuts))).select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score"))
    phrases = kept[0]
    for other in kept[1:]:
        phrases = phrases.unionByName(other)
    return settle(phrases), sizes


def collocations(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """Each language's first `top` collocations: lang, rank, phrase, a, l, r, n, score.

    docs has lang (null: `und`) and text; other columns stay out. A-Z are lower-cased; pieces end
    at `.,;:!?` and line ends and texts end pieces too; words are what spaces and tabs part.
    Phrases of 2 to LONGEST words that occur LEAST times or more within pieces are candidates;
    overlapping occurrences and repeated rows all count. The cut of the lowest score stands for a
    phrase; equal scores go to the shortest first part. A candidate goes if a longer one that
    contains it occurs at least INSIDE_PERCENT of its times (as a k-gram occurs no more often
    than the (k-1)-grams in it, those one word longer decide). Null and empty texts have no
    words; very long texts are slices of their own; empty tables give an empty result.
    """
    phrases, sizes = candidates(docs, **options)
    # a language may hold most phrases: firsts of hashed shares first, then the firsts of these
    shares = max(1, round((phrases.count() / top) ** 0.5))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = phrases.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(broadcast_if_small(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
