"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

A language is a distribution over vocabulary pieces. A word's probability is the sum over
all its segmentations into pieces (forward algorithm); a text's is the product over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import settle
from .common import is_training, lean, mix64, slices, small_batches, text_bytes

LONGEST_PIECE = 16  # of the public vocabulary; forward() rescales after so many characters
GRID_NUMBERS = 5_000_000  # prefix probabilities held at a time; one longer word stands alone
UNKNOWN = 1e-9  # probability of a character that no piece has
ROUNDS = 3
MAX_TRAINING_ROWS = 20_000  # of each language
SLICE_BYTES = 8_000_000
WORD_START = 0x2581
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """The vocabulary: for each length, sorted hashes of the pieces and their numbers."""

    hashes: list[np.ndarray]
    ids: list[np.ndarray]
    count: int


def load_pieces(path: str | None = None) -> Pieces:
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    names = sorted({sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))})
    longest = max(map(len, names))
    if longest > LONGEST_PIECE:
        raise ValueError(f"a piece of {longest} characters is longer than {LONGEST_PIECE}")
    by: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
    for k, p in enumerate(names):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in p:
                h = h * BASE + np.uint64(ord(c) + 1)
        by[len(p)].append((int(h), k))
    by = [sorted(x) for x in by]
    return Pieces([np.array([h for h, _ in x], dtype=np.uint64) for x in by], [np.array([k for _, k in x], dtype=np.int64) for x in by], len(names))


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of letters in lower case, and how many each text has."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    bare = pc.utf8_trim(pc.replace_substring_regex(texts, r"[^\pL\pM]+", " "), " ")
    parts = pc.split_pattern(bare, " ")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    empty = pc.equal(bare, "").to_numpy(zero_copy_only=False)
    if empty.any():
        counts[empty] = 0
        flat = flat.filter(pc.not_equal(flat, ""))
    return flat, counts


def has_letter(texts: pa.Array) -> np.ndarray:
    """Marks alone are words, but no letters."""
    return pc.match_substring_regex(pc.fill_null(texts.cast(pa.string()), ""), r"\pL").to_numpy(zero_copy_only=False)


def grids(words: pa.Array, languages: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word numbers, code points [words, length], lengths) of words of about equal length.

    Words stand whole, behind the word-start mark; zeros follow the shorter ones.
    """
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    start = np.cumsum(size - 1) - size + 1
    step = 1 << np.maximum(np.log2(size).astype(np.int64) - 3, 0)
    padded = np.where(size <= 2 * LONGEST_PIECE, size, -(-size // step) * step)
    for n in np.unique(padded).tolist():
        alike = np.flatnonzero(padded == n)
        most = max(1, GRID_NUMBERS // ((n + 1) * max(1, languages)))
        for a in range(0, len(alike), most):
            at = alike[a : a + most]
            grid = points[np.clip(start[at][:, None] + np.arange(-1, n - 1), 0, len(points) - 1)].astype(np.uint64)
            grid[:, 0] = WORD_START
            grid[np.arange(n) >= size[at][:, None]] = 0
            yield at, grid, size[at]


def lattice(grid: np.ndarray, vocabulary: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(end, length, rows, piece numbers) of every piece that stands in a word, by end."""
    n = grid.shape[1]
    with np.errstate(over="ignore"):
        for j in range(1, n + 1):
            h, power = np.zeros(len(grid), dtype=np.uint64), np.uint64(1)
            for size in range(1, min(j, len(vocabulary.hashes) - 1) + 1):
                h = h + power * (grid[:, j - size] + np.uint64(1))
                power = power * BASE
                table = vocabulary.hashes[size]
                if not len(table):
                    continue
                at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                rows = np.flatnonzero(table[at] == h)
                if len(rows):
                    yield j, size, rows, vocabulary.ids[size][at[rows]]


def _block(end):
    """The block of a prefix: 0 for the empty one, then one for each LONGEST_PIECE characters."""
    return -(-end // LONGEST_PIECE)


def forward(grid: np.ndarray, edges, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix numbers [length + 1, rows, languages] over all segmentations, and scales by block.

    A prefix's probability is its number times the scales of the blocks up to its own. A full
    block is divided by its largest number, so words of any length keep their precision;
    a piece reaches back no further than the block before.
    """
    n = grid.shape[1]
    alpha = np.zeros((n + 1, len(grid), chance.shape[1]))
    scales = np.ones((_block(n) + 1, len(grid), chance.shape[1]))
    alpha[0] = 1.0
    done = 0
    for j, size, rows, ids in chain(edges, [(n + 1, 0, None, None)]):
        while done < j - 1:  # the ends before j are complete but for unknown characters
            done += 1
            alpha[done] += UNKNOWN * alpha[done - 1]
            if done % LONGEST_PIECE == 0:
                full = alpha[done - LONGEST_PIECE + 1 : done + 1]
                scales[_block(done)] = full.max(0)
                full /= scales[_block(done)]
        if size:
            alpha[j, rows] += alpha[j - size, rows] * chance[ids]
    return alpha, scales


def log_chances(words: pa.Array, vocabulary: Pieces, chance: np.ndarray) -> np.ndarray:
    """Natural log probability of each word under each language."""
    out = np.zeros((len(words), chance.shape[1]))
    for word, grid, size in grids(words, chance.shape[1]):
        alpha, scales = forward(grid, lattice(grid, vocabulary), chance)
        row = np.arange(len(word))
        out[word] = np.log(alpha[size, row]) + np.cumsum(np.log(scales), 0)[_block(size), row]
    return out


def expected_counts(words: pa.Array, weight: np.ndarray, lang: np.ndarray, vocabulary: Pieces, chance: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in weighted words of known languages: [pieces, languages]."""
    out = np.zeros(chance.size)
    for word, grid, length in grids(words, chance.shape[1]):
        edges, k, n = list(lattice(grid, vocabulary)), lang[word], grid.shape[1]
        alpha, scales = (np.take_along_axis(x, k[None, :, None], 2)[:, :, 0] for x in forward(grid, edges, chance))
        row = np.arange(len(word))
        beta = np.zeros_like(alpha)  # of a suffix, so that alpha times beta is the chance of a cut there
        beta[length, row] = 1.0 / alpha[length, row]
        at, found, uses = len(edges) - 1, [], []
        for j in range(n, 0, -1):
            while at >= 0 and edges[at][0] == j:
                _, size, rows, ids = edges[at]
                at -= 1
                step = chance[ids, k[rows]]
                if _block(j - size) != _block(j):
                    step = step / scales[_block(j), rows]
                found.append(ids * chance.shape[1] + k[rows])
                uses.append(alpha[j - size, rows] * step * beta[j, rows] * weight[word[rows]])
                beta[j - size, rows] += step * beta[j, rows]
            beta[j - 1] += (UNKNOWN if _block(j - 1) == _block(j) else UNKNOWN / scales[_block(j)]) * beta[j]
        if found:
            out += np.bincount(np.concatenate(found), weights=np.concatenate(uses), minlength=chance.size)
    return out.reshape(chance.shape)


@dataclass
class Model:
    languages: list[str]
    chance: np.ndarray
    pieces_path: str | None


def fit(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS, rounds: int = ROUNDS, pieces_path: str | None = None, folds: int = 3, held_out: int = 1) -> Model:
    """Learn piece probabilities from labelled training rows by expectation maximisation.

    The rows are those with a language whose id is not in the held-out fold. Of each language
    all rows are used, or a sample of about max_rows by hash of id and text. Expected counts are summed in
    Spark; the driver holds one number a piece and language.
    """
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & is_training(F.col("doc_id"), folds, held_out)).select("doc_id", "lang", "text")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    vocabulary_size = load_pieces(pieces_path).count
    chance = np.full((vocabulary_size, len(languages)), 1.0 / vocabulary_size)
    if not languages:
        return Model([], chance, pieces_path)
    code = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int") - 1
    share = F.get(F.array(*[F.lit(min(1.0, max_rows / counts[x])) for x in languages]), code)
    sample = labelled.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30))

    @lean
    def count_words(batches):
        for b in batches:
            for lo, hi in slices(text_bytes(b.column("text")), SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                words, n = letter_words(part.column("text"))
                t = pa.table({"word": words, "lang": np.repeat(part.column("lang").to_numpy(), n)})
                t = t.group_by(["word", "lang"]).aggregate([([], "count_all")])
                for x in t.rename_columns(["word", "lang", "n"]).to_batches():
                    yield x

    words = settle(
        sample.select("text", code.alias("lang")).mapInArrow(count_words, "word string, lang int, n long")
        .groupBy("word", "lang").agg(F.sum("n").alias("n"))
    )
    spark = docs.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(chance)

        @lean
        def expect(batches, shared=shared):
            vocabulary, now, out = load_pieces(pieces_path), shared.value, None
            for b in batches:
                for a in range(0, b.num_rows, 50_000):
                    part = b.slice(a, 50_000)
                    got = expected_counts(part.column("word"), part.column("n").to_numpy().astype(float), part.column("lang").to_numpy().astype(np.int64), vocabulary, now)
                    out = got if out is None else out + got
            if out is not None:
                piece, lang = np.nonzero(out)
                yield pa.record_batch([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(out[piece, lang])], ["piece", "lang", "n"])

        sums = words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        grown = np.full_like(chance, 0.01)
        grown[sums["piece"], sums["lang"]] += sums["n"]
        chance = grown / grown.sum(0)
        shared.destroy()
    return Model(languages, chance, pieces_path)


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score: the most probable language and its posterior.

    Languages weigh alike beforehand. Null texts and texts without a letter are 'und' with
    score 0; ties go to the first language by code point; every character of a text counts.
    Repeated rows are scored alike, an empty table gives an empty result, and a model
    without languages calls all texts 'und'. Columns of these names (`names`) are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # plain lists and arrays: a broadcast is read where this package may be missing
    shared = spark.sparkContext.broadcast((model.languages, model.chance, model.pieces_path))
    rest = docs.drop(*names)

    @lean
    def run(batches):
        languages, chance, path = shared.value
        vocabulary = load_pieces(path)
        for b in batches:
            for lo, hi in slices(text_bytes(b.column("text")), SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                words, n = letter_words(part.column("text"))
                scores = np.zeros((part.num_rows, len(languages)))
                if len(words) and languages:
                    coded = words.dictionary_encode()
                    each = log_chances(coded.dictionary, vocabulary, chance)
                    index = coded.indices.to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(part.num_rows), n)
                    for k in range(len(languages)):
                        scores[:, k] = np.bincount(row, weights=each[index, k], minlength=part.num_rows)
                if languages:
                    best = scores.argmax(1)
                    score = 1.0 / np.exp(scores - scores.max(1, keepdims=True)).sum(1)
                    named = np.array(languages, dtype=object)[best]
                else:
                    score, named = np.zeros(part.num_rows), np.full(part.num_rows, "und", dtype=object)
                none = ~has_letter(part.column("text"))
                named[none], score[none] = "und", 0.0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(named, pa.string()), pa.array(score)], [*part.schema.names, *names])

    schema = T.StructType([*rest.schema.fields]).add(names[0], "string").add(names[1], "double")
    return rest.mapInArrow(run, schema)


def held_out_flag(doc_id: Column, folds: int = 3, held_out: int = 1) -> Column:
    return ~is_training(doc_id, folds, held_out)
