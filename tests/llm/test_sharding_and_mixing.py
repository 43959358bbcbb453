import itertools
import random
import zlib

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from skywait.llm import mixing, sharding
from skywait.llm.common import running_offsets


def test_flow_against_all_plans():
    rng = random.Random(3)
    for _ in range(25):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 4) for _ in range(n)]
        room = [rng.randint(0, 4) for _ in range(m)]
        if sum(supply) > sum(room):
            with pytest.raises(ValueError):
                sharding.min_cost_flow(supply, room)
            continue
        cost = [[rng.randint(0, 5) for _ in range(m)] for _ in range(n)]
        flow = sharding.min_cost_flow(supply, room, cost)
        assert all(sum(v for (a, _), v in flow.items() if a == i) == supply[i] for i in range(n))
        assert all(sum(v for (_, b), v in flow.items() if b == j) <= room[j] for j in range(m))
        best = None
        units = [i for i in range(n) for _ in range(supply[i])]
        for plan in itertools.product(range(m), repeat=len(units)) if len(units) <= 7 else []:
            if all(plan.count(j) <= room[j] for j in range(m)):
                c = sum(cost[i][j] for i, j in zip(units, plan, strict=True))
                best = c if best is None else min(best, c)
        if best is not None:
            assert sum(cost[i][j] * v for (i, j), v in flow.items()) == best


def test_only_the_excess_moves():
    flow = sharding.min_cost_flow([10, 4, 1], [5, 5, 5])
    assert sum(v for (i, j), v in flow.items() if i != j) == 5


def test_many_shards_by_the_hub():
    rng = random.Random(5)
    supply = [rng.randint(0, 10_000) for _ in range(400)]
    room = sharding._even(sum(supply), 700)
    flow = sharding.min_cost_flow(supply, room)
    assert all(sum(v for (a, _), v in flow.items() if a == i) == supply[i] for i in range(0, 400, 37)) and sum(flow.values()) == sum(supply)
    held = np.zeros(700, dtype=np.int64)
    for (_, j), v in flow.items():
        held[j] += v
    assert held.tolist() == room and len(flow) <= 2 * 1100
    assert sum(v for (i, j), v in flow.items() if i == j) == sum(min(s, r) for s, r in zip(supply, room, strict=False))


def test_running_offsets(spark):
    rows = spark.createDataFrame([("g" if k % 3 else "h", k % 50, k % 7) for k in range(300)], "grp string, k long, v long")
    out = running_offsets(rows, "grp", ["k", "v"], F.col("v"), 16).collect()
    for g in "gh":
        mine = sorted((r for r in out if r.grp == g), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        assert [r.start for r in mine] == list(np.cumsum([r.v for r in mine]) - [r.v for r in mine])


def test_reshard_and_rewrite(spark, tmp_path):
    docs = cases.make(spark, extra=True, n=400)
    rows = sharding.describe(docs, F.pmod(F.hash("source"), F.lit(5)))
    plan = sharding.reshard(rows, 8)
    got = plan.collect()
    assert len(got) == docs.count()
    sizes, slots = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= largest
    mean = sum(sizes.values()) / 8
    assert sum(abs(v - mean) < 0.1 * mean for v in sizes.values()) >= 6
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r["size"] == len((text[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)
    assert sorted(map(tuple, plan.select("doc_id", "shard").where("doc_id is not null").collect())) == sorted((r.doc_id, r.shard) for r in got if r.doc_id is not None)
    files = sharding.rewrite(docs, plan, str(tmp_path / "out"))
    touched = set(sharding.affected_shards(plan))
    assert {r.shard for r in files.where("path is not null").collect()} == touched & set(sizes)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == sum(1 for r in got if r.shard in touched)
    assert sharding.reshard(sharding.describe(cases.empty(spark), F.lit(0)), 4).count() == 0


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 100, 190], [5, 2, 1])[0] == 30
    out = mixing.targets([1, 1, 298], [5, 2, 1])
    assert out == pytest.approx([3, 3, 294])
    assert mixing.targets([0, 5], [5, 2]) == [0, 5] and mixing.targets([], [1]) == []


def test_permutation_is_a_bijection():
    for n in (1, 2, 7, 100, 1000):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345, dtype=np.uint64))
        assert sorted(got.tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 9, dtype=np.uint64)).tolist() != list(range(1000))


@pytest.mark.parametrize("limit", [1_000_000_000, 200])
def test_draws_keep_the_quotas(monkeypatch, limit):
    monkeypatch.setattr(mixing, "LIBRARY_MOST", limit)
    quotas = [1000, 30, 0, 7]
    each = [mixing.shard_draws(quotas, 9, s, seed=1) for s in range(9)]
    draws = np.array([d for _, d in each])
    assert draws.sum(0).tolist() == quotas and set(draws.sum(1)) <= {115, 116} and (draws >= 0).all()
    assert all((b == draws[:s].sum(0)).all() for s, (b, _) in enumerate(each))


def test_draws_are_those_of_a_random_deal():
    got = np.array([mixing.shard_draws([400, 100], 5, 2, seed=s)[1] for s in range(300)])
    assert got[:, 1].mean() == pytest.approx(20, abs=1) and 2.5 < got[:, 1].std() < 5


def test_hypergeometric_at_any_size(monkeypatch):
    from math import comb

    big = 40 * 10**9
    got = np.array([mixing.hypergeometric(big // 4, big - big // 4, big // 2, np.random.default_rng(s)) for s in range(200)])
    sd = (big // 2 * 0.25 * 0.75 * 0.5) ** 0.5
    assert abs(got.mean() - big / 8) < 4 * sd / 200**0.5 and 0.8 < got.std() / sd < 1.25
    monkeypatch.setattr(mixing, "LIBRARY_MOST", 0)
    for good, bad, sample in ((3, 4, 5), (1, 9, 2), (6, 2, 7), (5, 5, 0), (4, 3, 7)):
        n, rng = 4000, np.random.default_rng(good)
        seen = np.bincount([mixing.hypergeometric(good, bad, sample, rng) for _ in range(n)], minlength=good + 1) / n
        want = [comb(good, k) * comb(bad, sample - k) / comb(good + bad, sample) if 0 <= sample - k <= bad else 0 for k in range(good + 1)]
        assert np.abs(seen - want).max() < 0.04 and all(w or not s for s, w in zip(seen, want, strict=True))


def test_pieces_are_the_blocks_of_the_slots(spark):
    """Every drawn slot against a plain cut of each source's running words."""
    docs = cases.make(spark, extra=True, n=300)
    documents, pieces = mixing.mix(docs, block=16, shard_blocks=20)
    held, at = {}, {}
    for r in sorted(documents.collect(), key=lambda r: r._row):
        first = at.get(r.source_id, 0)
        held.setdefault(r.source_id, []).append((first, first + r["size"], r._row))
        at[r.source_id] = first + r["size"]
    got, slots = {}, {}
    for p in pieces.collect():
        got.setdefault((p.source_id, p.epoch, p.block), set()).add((p._row, p.from_word, p.to_word))
        slots.setdefault((p.shard, p.source_id), {}).setdefault(p.slot, set()).add((p.epoch, p.block))
    assert all(sorted(s) == list(range(len(s))) and all(len(b) == 1 for b in s.values()) for s in slots.values())
    per_shard = {}
    for (shard, _), s in slots.items():
        per_shard[shard] = per_shard.get(shard, 0) + len(s)
    assert set(per_shard.values()) <= {19, 20} and sorted(per_shard) == list(range(len(per_shard)))
    last = {k: max(e for s, e, _ in got if s == k) for k in at if at[k]}
    for (source, epoch, block), rows in got.items():
        want = {(row, max(a, 16 * block) - a, min(b, 16 * block + 16) - a) for a, b, row in held[source] if a < b and max(a, 16 * block) < min(b, 16 * block + 16)}
        if epoch < last[source]:
            assert rows == want
    for source, n in at.items():
        for epoch in range(last.get(source, 0)):
            assert {b for s, e, b in got if (s, e) == (source, epoch)} == set(range(-(-n // 16)))
    cut = {k for k, rows in got.items() if k[1] == last[k[0]] and sum(b - a for _, a, b in rows) < 16}
    assert len(cut) <= 2 * len(at), "but for a source's last block and the last one drawn, blocks are whole"


def test_mix(spark):
    docs = cases.make(spark, extra=True, n=300)
    documents, pieces = mixing.mix(docs, block=16)
    got = mixing.taken_words(documents, pieces).collect()
    assert len(got) == docs.count()
    by, size = {}, {}
    for r in got:
        by[r.source] = by.get(r.source, 0) + r.taken
        size[r.source] = size.get(r.source, 0) + r["size"]
        assert r.taken <= 3 * r["size"]
    want = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), mixing.targets([size[s] for s in sorted(size, key=lambda s: (s is None, s or ""))], [5, 2, 1, 5]), strict=True))
    assert all(abs(by[s] - want[s]) <= 16 for s in by) and all(r.target == want[r.source] and r.source_size == size[r.source] for r in got)
    again = mixing.taken_words(*mixing.mix(docs, block=16)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in got)
    assert mixing.taken_words(*mixing.mix(cases.empty(spark))).count() == 0


@pytest.mark.parametrize("again", [False, True])
def test_mixed_documents_hold_what_was_taken(spark, again):
    docs = cases.make(spark, n=200, extra=again)
    docs = docs if again else docs.dropDuplicates(["doc_id"])
    documents, pieces = mixing.mix(docs, block=16)
    taken = {}
    for r in mixing.taken_words(documents, pieces).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    out = mixing.mixed_documents(docs, block=16)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    held, words = {}, {r.doc_id: set(cases.words(r.text)) for r in docs.collect()}
    for r in out.collect():
        held[r.doc_id] = held.get(r.doc_id, 0) + len(cases.words(r.text))
        assert r.n_chars == len(r.text) and set(cases.words(r.text)) <= words[r.doc_id]
    assert held == {d: n for d, n in taken.items() if n}
    assert mixing.mixed_documents(cases.empty(spark)).count() == 0
