import math
import random
from collections import Counter, defaultdict

import cases
import numpy as np
import pyarrow as pa
import pytest

from skywait.llm import ctw, forest, langid, minhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(ids, links):
    head = {i: i for i in ids}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        head[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_forward_sums_all_segmentations():
    pieces = langid.load_pieces()
    rng = np.random.default_rng(1)
    chance = rng.random((pieces.count, 2)) / pieces.count
    table = {}
    for size in range(1, langid.LONGEST_PIECE + 1):
        table |= {(size, int(h)): int(k) for h, k in zip(pieces.hashes[size], pieces.ids[size], strict=True)}

    def key(s):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in s:
                h = h * langid.BASE + np.uint64(ord(c) + 1)
        return int(h)

    def plain(word, lang):
        text = "▁" + word
        alpha = [1.0] + [0.0] * len(text)
        for j in range(1, len(text) + 1):
            alpha[j] = langid.UNKNOWN * alpha[j - 1]
            for size in range(1, min(j, langid.LONGEST_PIECE) + 1):
                k = table.get((size, key(text[j - size : j])))
                if k is not None:
                    alpha[j] += alpha[j - size] * chance[k, lang]
        return math.log(alpha[-1])

    words = ["the", "über", "motion", "x", "ñandú", "interesting"]
    got = langid.log_chances(pa.array(words), pieces, chance)
    for i, w in enumerate(words):
        for lang in (0, 1):
            assert got[i, lang] == pytest.approx(plain(w, lang), rel=1e-9)
    counts = langid.expected_counts(pa.array(words), np.ones(len(words)), np.zeros(len(words), dtype=np.int64), pieces, chance)
    assert counts[:, 0].sum() > 0 and counts[:, 1].sum() == 0


def test_long_words_are_scored_whole():
    pieces = langid.load_pieces()
    chance = np.full((pieces.count, 1), 1 / pieces.count)
    a, b = (langid.log_chances(pa.array([w]), pieces, chance)[0, 0] for w in ("a" * 200, "a" * 300))
    assert b < 1.3 * a < -130


def test_long_words_and_pieces_count_in_full():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = sorted({sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))})
    pieces = langid.load_pieces()
    assert pieces.count == len(names) and max(map(len, names)) == 16
    number = {p: k for k, p in enumerate(names)}
    rng = np.random.default_rng(2)
    chance = rng.random((len(names), 2)) / len(names)
    words = ["international", "responsibilities", "donaudampfschifffahrtsgesellschaftskapitän", "x" * 63, "日本語" * 20, "characteristics" * 40, "a" * 15, "é" * 16, "ab" * 700]
    got = langid.log_chances(pa.array(words), pieces, chance)
    uses = np.zeros_like(chance)
    for i, word in enumerate(words):
        text, lang = "▁" + word, i % 2
        n = len(text)
        edges = [(a, b, number[text[a:b]]) for b in range(1, n + 1) for a in range(max(0, b - 16), b) if text[a:b] in number]
        for c in (0, 1):
            into = [[] for _ in range(n + 1)]
            for a, b, k in edges:
                into[b].append((a, math.log(chance[k, c])))
            alpha = [0.0] + [-math.inf] * n
            for b in range(1, n + 1):
                alpha[b] = np.logaddexp.reduce([alpha[b - 1] + math.log(langid.UNKNOWN), *(alpha[a] + x for a, x in into[b])])
            assert got[i, c] == pytest.approx(alpha[n], rel=1e-9), word[:20]
            if c == lang:
                first = alpha
        beta = [-math.inf] * n + [0.0]
        out = [[] for _ in range(n + 1)]
        for a, b, k in edges:
            out[a].append((b, k))
        for a in range(n - 1, -1, -1):
            beta[a] = np.logaddexp.reduce([beta[a + 1] + math.log(langid.UNKNOWN), *(beta[b] + math.log(chance[k, lang]) for b, k in out[a])])
        for a, b, k in edges:
            uses[k, lang] += (i + 1) * math.exp(first[a] + math.log(chance[k, lang]) + beta[b] - first[n])
    counts = langid.expected_counts(pa.array(words), np.arange(1.0, len(words) + 1), np.arange(len(words)) % 2, pieces, chance)
    assert counts == pytest.approx(uses, rel=1e-7, abs=1e-12)


def test_language_accuracy_and_awkward_rows(spark):
    docs = cases.make(spark, extra=True, n=200)
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    got = {r.doc_id: r for r in langid.predict(docs.select("doc_id", "text", "lang"), model).collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    held = [d for d in got if d is not None and d < 1000 and cases.fold(d, 3) == 1]
    assert sum(got[d].lang_pred == truth[d].lang for d in held) / len(held) > 0.98
    for d in (1000, 1001, 1002, 1003):
        assert got[d].lang_pred == "und" and got[d].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(cases.empty(spark), model).count() == 0
    nothing = langid.fit(cases.empty(spark))
    assert {r.lang_pred for r in langid.predict(docs.select("doc_id", "text"), nothing).collect()} == {"und"}


def test_marks_are_no_letters(spark):
    texts = ["\u0301", "\u0301 12 \u0300\u0301", "e\u0301", "x", "12", "日"]
    docs = cases.make(spark, n=60).select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(9000 + k, t, None, "a") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(odd, model, ("a1", "b1")).collect()}
    assert [got[9000 + k].a1 == "und" for k in range(6)] == [True, True, False, False, True, False]
    assert got[9000].b1 == 0 and got[9002].b1 > 0


def test_each_language_has_its_own_sample(spark):
    rows = [(None if k % 2 else k, f"hot the text {'e' * (k % 40)} {k}", "en") for k in range(3000)]
    rows += [(5000 + k, "qua quo quid quis", "la") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, max_rows=40, rounds=1)
    mass = 1 / model.chance.min(0) * 0.01 - 0.01 * len(model.chance)  # expected pieces: the least chance is 0.01 of them all
    assert model.languages == ["en", "la"] and mass[1] >= 4 * 4  # all Latin rows that are not held out
    assert mass[0] < 40 * 3 * 25  # about 40 English rows of some pieces, though half have no id
    assert langid.predict(docs.where("lang = 'la'"), model).where("lang_pred != 'la'").count() == 0


def test_estimates_and_chances_of_all_bytes_sum_to_one(spark):
    assert math.exp(float(ctw.log_estimate(np.array([2]), np.array([1]))[0])) == pytest.approx(0.5 * 0.75 * (0.5 / 3), rel=1e-9)
    for z, o in ((70_000, 3), (3, 70_000), (90_000, 80_000), (0, 65_536)):
        want = math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)
        assert ctw.log_estimate(np.array([z]), np.array([o]))[0] == pytest.approx(want, rel=1e-9)
    row, key = ctw.byte_steps(ctw.joined(pa.array(["The  then", None, "thé"])))
    assert bytes((key & 255).astype(np.uint8)) == "the then \n".encode() + b"\n" + "thé \n".encode() and row.tolist() == [0] * 10 + [1] + [2] * 6
    assert key[0] == int.from_bytes(b"\0\0\0\0\0 t", "big") and key[9] == int.from_bytes(b" then \n", "big") and key[10] == int.from_bytes(b"\0\0\0\0\0 \n", "big")
    keys = np.unique(np.concatenate([key, *((k & ~255) + np.arange(256) for k in key)]))
    counts = np.bincount(np.searchsorted(keys, key), minlength=len(keys)) * 3
    rows = [b.to_pylist()[0] for b in ctw._table_rows(0, ctw.BYTES, ctw.group_of(ctw.BYTES, keys, 4), keys, counts)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], ctw.TABLE)
    for r in ctw.code_lengths(frame, 4).collect():
        chance = np.power(10.0, ctw.unpack(r.counts, r.size) / ctw.SCALE)
        context = ctw.unpack_keys(r.keys, r.size) >> 8
        assert np.bincount(np.unique(context, return_inverse=True)[1], weights=chance) == pytest.approx(1, abs=1e-4)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for values in (np.empty(0, dtype=np.int64), np.array([-5, 0, 7]), rng.integers(-(1 << 63), (1 << 63) - 1, 1000)):
        assert ctw.unpack(ctw.pack(values), len(values)).tolist() == values.tolist()
        keys = np.unique(values)
        assert ctw.unpack_keys(ctw.pack_keys(keys), len(keys)).tolist() == keys.tolist()


def test_scores(spark):
    docs = cases.make(spark, extra=True, n=150)
    rows = docs.select("doc_id", "text").collect()
    tokens = {i: [*cases.words((r.text or "").translate(UPPER)), None] for i, r in enumerate(rows)}
    train = [i for i, r in enumerate(rows) if cases.fold(r.doc_id, 5) != 1]
    count = Counter(w for i in train for w in tokens[i])
    total, distinct = sum(count.values()), len(count)
    got = ctw.score(docs).collect()
    want = Counter()
    for i, r in enumerate(rows):
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens[i])
        want[r.doc_id, cases.fold(r.doc_id, 5) == 1, len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), total, round(base, 6)] += 1
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == want
    assert all(g.score < 0 for g in got)
    size = Counter((r.doc_id, sum(len(w.encode()) + 1 for w in cases.words(r.text)) + 1) for r in rows)
    assert Counter((g.doc_id, round(-g.score * math.log2(10) / g.bits_per_byte)) for g in got) == size
    held = [g for g in got if g.held_out and g.n_tokens > 20]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)
    assert ctw.score(cases.empty(spark)).count() == 0


def plain_codes(texts, training):
    """log10 P of each text under the tree of the training texts, node by node."""
    visits, below = defaultdict(lambda: [0, 0]), defaultdict(set)

    def steps(text):
        data = b" " + "".join(w + " " for w in cases.words((text or "").translate(UPPER))).encode() + b"\n"
        for i in range(1, len(data)):
            yield tuple(data[j] if j >= 0 else 0 for j in range(i - 1, i - 1 - ctw.DEPTH, -1)), data[i]

    def decisions(byte):
        return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]

    for text, use in zip(texts, training, strict=True):
        for context, byte in steps(text) if use else ():
            for prefix, bit in decisions(byte):
                for d in range(ctw.DEPTH + 1):
                    visits[prefix, context[:d]][bit] += 1
                    if d:
                        below[prefix, context[: d - 1]].add(context[:d])

    def own(prefix, context):
        z, o = visits[prefix, context]
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)

    held = {}

    def mixed(prefix, context):
        key = (prefix, context)
        if key not in held:
            inner = sum(mixed(prefix, x) for x in below[key])
            held[key] = own(*key) if len(context) == ctw.DEPTH else math.log(0.5) + float(np.logaddexp(own(*key), inner))
        return held[key]

    def chance(prefix, context):
        mix, left = 0.0, 1.0
        for d in range(ctw.DEPTH + 1):
            z, o = visits.get((prefix, context[:d]), (0, 0))
            one = (o + 0.5) / (z + o + 1)
            if d == ctw.DEPTH or (prefix, context[: d + 1]) not in visits:
                return mix + left * one
            stop = math.exp(math.log(0.5) + own(prefix, context[:d]) - mixed(prefix, context[:d]))
            mix, left = mix + left * stop * one, left * (1 - stop)

    each = [[(chance(p, x), bit) for x, byte in steps(t) for p, bit in decisions(byte)] for t in texts]
    return [sum(math.log10(q if bit else 1 - q) for q, bit in e) for e in each]


@pytest.mark.parametrize("limits", [{}, {"BLOCK_BYTES": 300, "SLICE_BYTES": 100, "GROUP_BYTES": 200, "FAN_IN": 2, "LANES": 3, "PARTED": 2}])
def test_scores_are_those_of_a_whole_context_tree(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ctw, name, value)
    rng = random.Random(6)
    rows = [(k, cases.prose(rng, rng.randint(3, 12), ["ka", "lo ", "mi", "tu", "é "])) for k in range(60)]
    rows += [(100, "one two three four"), (101, "four three  TWO\none "), (102, None), (103, " "), (104, "zzz zz"), (None, "ka lo"), (105, "kalo" * 400)]
    got = {r.doc_id: r.score for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    training = [cases.fold(r[0], 5) != 1 for r in rows]
    for r, code in zip(rows, plain_codes([r[1] for r in rows], training), strict=True):
        assert got[r[0]] == pytest.approx(code, abs=1e-3), r
    assert abs(got[100] - got[101]) > 0.01, "the order of words counts"


def test_scores_without_training_rows(spark):
    rows = [(k, f"word {k}") for k in range(40) if cases.fold(k, 5) == 1]
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in got)
    assert all(r.bits_per_byte == pytest.approx(8, abs=1e-3) for r in got)


def weighted_jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    m = 4096
    base = {k: int(rng.integers(1, 12)) for k in range(60)}
    other = {k: max(0, v + int(rng.integers(-4, 5))) for k, v in base.items()} | {1000 + k: 3 for k in range(5)}
    other = {k: v for k, v in other.items() if v}
    key = np.array([*base, *other], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    row = np.array([0] * len(base) + [1] * len(other))
    weight = np.array([*base.values(), *other.values()])
    sig = minhash.signatures(row, minhash.mix64(key), weight, 2, m)
    assert np.isfinite(sig).all()
    truth = weighted_jaccard(Counter(base), Counter(other))
    assert abs((sig[0] == sig[1]).mean() - truth) < 4 * math.sqrt(truth * (1 - truth) / m)
    # components are exponential with the rate of the total weight, for any split of weights
    assert sig[0].mean() == pytest.approx(m / sum(base.values()), rel=0.08)


def test_near_duplicates_against_all_pairs(spark):
    docs = cases.make(spark, extra=True, n=150)
    rows = docs.select("doc_id", "text").collect()
    rng = random.Random(8)
    stems = ["ka", "lo", "mi", "tu", "re", "so"]
    extra = []
    for g in range(12):  # families with more and more edits, some below the limit
        base = cases.prose(rng, 150, stems).split()
        for k in range(7):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = f"edit{g}x{k}"
            extra.append((5000 + 10 * g + k, " ".join(w)))
    shared = cases.prose(rng, 40, stems)
    extra += [(7000 + k, shared + " " + cases.prose(rng, 60, stems)) for k in range(90)]
    everything = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    out = minhash.near_duplicates(everything, tile=16).collect()
    texts = {**{r.doc_id: r.text for r in rows if r.doc_id is not None}, **dict(extra)}
    bags = {d: cases.shingle_counts(t) for d, t in texts.items() if t is not None}
    at = defaultdict(set)
    for d, bag in bags.items():
        for s in bag:
            at[s].add(d)
    pairs = {(a, b) for d in bags for s in bags[d] for a, b in ((min(d, o), max(d, o)) for o in at[s]) if a != b}
    links = [(a, b) for a, b in pairs if weighted_jaccard(bags[a], bags[b]) >= 0.8]
    blank = [d for d in bags if not bags[d]]
    want = components(texts, links + [(blank[0], b) for b in blank[1:]])
    got = {r.doc_id: r.class_id for r in out if r.doc_id is not None}
    wrong = [d for d in want if want[d] != got[d]]
    assert len(wrong) <= 0.01 * len(want), wrong
    assert len(out) == everything.count() and all(r.kept == (r.doc_id == r.class_id) for r in out)
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0


def test_deduplicated_keeps_one_row_a_class(spark):
    docs = cases.make(spark, extra=True)
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and ids.count(1006) == 1 and 1000 in ids
    kept = {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}
    assert set(ids) - {None} == kept - {None}


def test_deduplicated_judges_rows_by_id_and_text(spark):
    rng = random.Random(3)
    text = [cases.prose(rng, 80, ["ka", "lo", "mi", "tu", "re", "so"]) for _ in range(9)]
    rows = [(None, text[k]) for k in range(4)]  # different texts without an id
    rows += [(None, text[0]), (None, text[4]), (1, text[4])]  # copies without an id
    rows += [(2, text[5]), (2, text[6]), (0, text[6])]  # one text of id 2 is a copy, the other is clean
    rows += [(3, text[7]), (3, text[8]), (4, text[8] + " "), (5, None), (5, None), (6, None)]
    want = [(None, text[k]) for k in range(4)] + [(1, text[4]), (2, text[5]), (0, text[6]), (3, text[7]), (3, text[8]), (5, None), (6, None)]
    out = minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want)


def test_connected(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 103), (200, 200)]
    got = {r.id: r.component for r in minhash.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[103] == 100 and 200 not in got


def vectors(seed=2, many=120, width=16):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(many):
            v = rng.standard_normal(width)
            rows.append((k, v.tolist(), label))
            k += 1
            for _ in range(int(rng.integers(0, 3))):
                rows.append((k, (v * rng.uniform(0.1, 9) + rng.standard_normal(width) * rng.choice([0.05, 0.2, 0.4])).tolist(), label))
                k += 1
    hot = rng.standard_normal(width)
    for _ in range(150):
        rows.append((k, (hot + rng.standard_normal(width) * 0.02).tolist(), 1))
        k += 1
    rows += [(k + j, rows[3][1], rows[3][2]) for j in range(20)]  # equal vectors
    k += 20
    rows += [(7, rows[3][1], rows[3][2]), (None, rows[9][1], rows[9][2]), (None, rows[30][1], rows[30][2])]  # an id twice, and none
    rows += [(k, None, 0), (k + 1, [0.0] * width, 0), (k + 2, [float("nan")] * width, 0), (k + 3, [1.0, None] + [0.0] * (width - 2), 0), (k + 4, [1.0, 2.0], 0), (k + 5, [], 1), (k + 6, [float("inf")] * width, 0)]
    return rows


def all_links(rows):
    """(positions of usable vectors, link matrix) by all pairs."""
    width = max(len(v or []) for _, v, _ in rows)
    good = [p for p, (_, v, label) in enumerate(rows) if label is not None and v and len(v) == width and None not in v and np.isfinite(v).all() and any(v)]
    x = np.stack([np.array(rows[p][1]) for p in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([rows[p][2] for p in good])
    hit = (x @ x.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(hit, False)
    return good, hit


def test_forest_against_all_pairs(spark):
    rows = vectors()
    shape = "vec_id long, embedding array<double>, label int, node string, places string, n string"
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], shape)
    good, hit = all_links(rows)
    want = Counter({rows[p][0]: 0 for p in range(len(rows))})
    for p, n in zip(good, hit.sum(1), strict=True):
        want[rows[p][0]] += int(n)
    parts = components(range(len(good)), list(zip(*np.nonzero(hit), strict=True)))
    least = defaultdict(set)
    for a, head in parts.items():
        least[head].add(rows[good[a]][0])
    names = {h: min((i for i in ids if i is not None), default=None) for h, ids in least.items()}
    whole = Counter((rows[good[a]][0], names[h]) for a, h in parts.items())
    for options in ({"leaf": 24}, {"leaf": 24, "tile": 32}, {"leaf": 24, "sample": 100}):
        out = forest.near_vectors(frame, **options).collect()
        got = Counter()
        for r in out:
            got[r.vec_id] += r.n_links
        assert len(out) == len(rows) and all(got[i] <= want[i] for i in want)
        assert sum(got.values()) >= 0.97 * sum(want.values())
        assert sum((Counter((r.vec_id, r.component_id) for r in out) & whole).values()) >= 0.97 * len(good)
        assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert forest.near_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("many", [300, 1500])
def test_recall_at_two_sizes(spark, many):
    rows = [(k, v, 0) for k, (_, v, label) in enumerate(vectors(5, many, 32)) if label is not None]
    good, hit = all_links(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = forest.near_vectors(frame, leaf=32, sample=500).agg({"n_links": "sum"}).first()[0]
    assert 0.95 * hit.sum() <= got <= hit.sum() + 4, "single precision may move a pair over the limit"


def test_alike_vectors_stay_in_one_leaf():
    rng = np.random.default_rng(1)
    alike = rng.standard_normal(16) + 1e-3 * rng.standard_normal((500, 16))
    alike /= np.linalg.norm(alike, axis=1)[:, None]
    direction, threshold, child = forest.grow(alike, 12, 0.06, rng)
    assert child.tolist() == [[-1, -1]]
    mixed = rng.standard_normal((500, 16))
    mixed /= np.linalg.norm(mixed, axis=1)[:, None]
    row, leaf = forest.leaves(*forest.grow(mixed, 40, 0.06, rng), mixed, 0.06)
    assert set(row) == set(range(500)) and np.bincount(leaf).max() < 200
