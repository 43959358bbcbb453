import zlib

import cases
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skywait.llm import packing, token_files, tokens


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda texts: [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é'S s\n\t  .1<|", max_size=25), st.lists(st.sampled_from(["<|endoftext|>", " ", "a", " b", "\n", "<|"]), max_size=8).map("".join)), min_size=1, max_size=6))
def test_ids_equal_the_tokenizer(reference, texts):
    assert split(*tokens.encode(pa.array(texts, pa.string()), tokens.encoder())) == reference(texts)


def test_piece_bounds():
    row, piece, start, size = tokens.piece_bounds(np.array([1, 2048, 2049, 5000]), 2048)
    assert list(zip(row, piece, start, size, strict=True)) == [(0, 0, 0, 1), (1, 0, 0, 2048), (2, 0, 0, 1), (2, 1, 1, 2048), (3, 0, 0, 904), (3, 1, 904, 2048), (3, 2, 2952, 2048)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.sampled_from(["norm", "dot"]), st.sampled_from([20, 60, 100]))
def test_best_fit_keeps_every_limit(lengths, rule, cost):
    n = np.array(lengths, dtype=np.int64)
    bins, offset = packing.best_fit(n, 100, 5, cost, rule=rule, tile=10)
    for b in set(bins.tolist()):
        mine = n[bins == b]
        tiles = (np.ceil(mine / 10) ** 2).sum()
        assert mine.sum() <= 100 and len(mine) <= 5 and (tiles <= cost or len(mine) == 1)
        at = offset[bins == b]
        order = np.argsort(at)
        assert at[order].tolist() == (np.cumsum(mine[order]) - mine[order]).tolist()


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from(["uniform", "long", "short", "mixed"]))
def test_default_capacities_cost_no_sequence(seed, kind):
    rng = np.random.default_rng(seed)
    low, high = {"uniform": (1, 2049), "long": (1900, 2049), "short": (1, 9), "mixed": (1, 300)}[kind]
    n = rng.integers(low, high, 600)
    if kind in ("long", "mixed"):
        n = np.concatenate([n, rng.integers(1, 120, 300), np.ones(50, dtype=np.int64), rng.integers(1921, 2048, 100)])
    cost = packing.most_tiles(2048, 2048, 128)
    count = lambda *limits: len(set(packing.best_fit(n, 2048, *limits)[0].tolist()))
    assert count(2048, cost) <= count(1e12, 1e12)


def test_no_length_is_refused_company_by_the_default_cost():
    cost = packing.most_tiles(2048, 2048, 128)
    for n in range(1, 2048):
        bins, _ = packing.best_fit(np.array([n, *[1] * (2048 - n)]), 2048, 2048, cost)
        assert set(bins.tolist()) == {0}
    piece = [1930] * 1000 + [100] * 1000
    assert len(set(packing.best_fit(np.array(piece), 2048, 2048, cost)[0].tolist())) == 1000


def test_large_ids_beside_null_ids(spark):
    big = [2**60 + k for k in range(1, 6)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in [*big, None, None]], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in packing.pack(docs).collect()) == [0, 0, *big]


def test_every_capacity_opens_bins():
    tokens, documents, cost = np.array([1500, 600]), np.full(300, 1), np.array([1900] + [3] * 40)
    limits = (2048, 256, packing.attention_tiles(2048))
    bins = [len(set(packing.best_fit(n, *limits)[0].tolist())) for n in (tokens, documents, cost)]
    assert bins == [2, 2, 2]
    assert [tokens.sum() > 2048, len(documents) > 256, packing.attention_tiles(cost).sum() > 256] == [True] * 3
    assert cost.sum() <= 2048 and len(cost) <= 256, "only its attention cost binds"
    assert set(packing.best_fit(cost, 2048, 256, 1e9)[0].tolist()) == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_decreasing_fit_equals_a_plain_search(lengths):
    n = np.array(lengths, dtype=np.int64)
    bins, count = token_files.best_fit_decreasing(n, 64)
    room = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [r for r in room if r >= lengths[k]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - lengths[k])
        else:
            room.append(64 - lengths[k])
    assert count == len(room)
    assert sorted(64 - np.bincount(bins, weights=n, minlength=count)) == sorted(room)


def test_packed_documents(spark, reference):
    docs = cases.make(spark, extra=True)
    out = packing.pack(docs, length=256, cell=64).collect()
    texts = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for r, ids in zip(texts, reference([r.text for r in texts]), strict=True) if len(ids) <= 256)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.ids_crc32) for r in out if r.piece == 0 and r.length < 256 and not any(o.doc_id == r.doc_id and o.piece == 1 for o in out))
    assert set(got) <= set(want)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) <= 256
    total = sum(r.length for r in out)
    assert total == sum(len(i) for i in reference([r.text for r in texts]))
    assert len(by) <= 1.05 * total / 256 + 1
    assert packing.pack(cases.empty(spark)).count() == 0


def test_round_trip_of_id_rows(spark, reference, tmp_path):
    docs = cases.make(spark, extra=True)
    token_files.write_rows(token_files.packed_rows(docs, length=300, window=20_000), str(tmp_path / "rows"))
    parts = {}
    for r in spark.read.parquet(str(tmp_path / "rows")).collect():
        ids, pos = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(pos) == 300 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and len(r.cu_seqlens) == len(r.doc_ids) + 1
        for d, k, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert pos[a:b].tolist() == list(range(b - a))
            parts.setdefault((d, k), []).append(ids[a:b].tolist())
    texts = docs.select("doc_id", "text").collect()
    for r, ids in zip(texts, reference([r.text for r in texts]), strict=True):
        if r.doc_id != 1006:
            joined, k = [], 0
            while (r.doc_id, k) in parts:
                joined += parts[r.doc_id, k][0]
                k += 1
            assert joined == ids
    assert len(parts[1006, 0]) == 2
    assert token_files.packed_rows(cases.empty(spark)).count() == 0
