import re
import zlib
from collections import Counter, defaultdict

import cases
import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from skywait.llm import line_rules, mixing


def line_keys(text):
    return [re.sub("[0-9]+", "0", " ".join(cases.words(x)).lower()) for x in (text or "").split("\n") if cases.words(x)]


def plain_quality(rows):
    """Rows that stay, with the texts that they have then."""
    docs = defaultdict(Counter)
    for r in rows:
        for k in set(line_keys(r.text)):
            docs[r.source][k, frozenset(line_keys(r.text))] = 1
    host, out = Counter(r.source for r in rows), []
    seen = {s: Counter(k for k, _ in c) for s, c in docs.items()}
    for r in rows:
        w = cases.words(r.text)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[g] > 1 for j in (i, i + 1, i + 2)}
        if len(w) < line_rules.MIN_WORDS or 100 * len(covered) > line_rules.MAX_REPEAT_PERCENT * len(w):
            continue
        frequent = {k for k in set(line_keys(r.text)) if seen[r.source][k] > max(line_rules.LINE_DOCS, line_rules.LINE_SHARE * host[r.source])}
        stays = [x for x in r.text.split("\n") if not cases.words(x) or line_keys(x)[0] not in frequent]
        gone = len(w) - sum(len(cases.words(x)) for x in stays)
        if not gone or len(w) - gone >= line_rules.LEFT_SHARE * len(w):
            out.append((r.doc_id, r.source, "\n".join(stays)))
    return out


def plain_dedup(rows):
    """One (id, text) of each class of texts that link at 0.8, by brute force over all pairs."""
    texts = sorted({tuple(cases.words(r.text)) for r in rows})
    bags, head = [cases.shingle_counts(" ".join(t)) for t in texts], list(range(len(texts)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = sum((bags[a] & bags[b]).values())
            if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    number, classes = {t: k for k, t in enumerate(texts)}, defaultdict(list)
    for r in rows:
        classes[find(number[tuple(cases.words(r.text))])].append(r.doc_id)
    return Counter(min(ids, key=lambda i: (i is None, i or 0)) for ids in classes.values())


def plain_pieces(rows, tokenizer, longest=2048):
    out = Counter()
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % longest + 1
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), longest)], [*range(first, len(ids), longest), len(ids)], strict=True)):
            out[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    return out


def test_stages_against_plain_versions(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = cases.make(spark, n=150, extra=True)  # with columns whose names operators use
    menu = F.when(F.col("source") == "a", F.concat("text", F.lit("\nMenu 12 home\n"), F.lit("\nmenu 7   HOME"))).otherwise(F.col("text"))
    docs = docs.withColumn("text", menu).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_dedup", "mixture", "packed"]
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now.collect()
        if name != "packed":
            assert now.dtypes == docs.dtypes
    rows = docs.collect()
    whole = lambda rows: Counter(map(str, rows))  # noqa: E731  all columns, the clashing ones too
    assert whole(seen["language"]) == whole([r for r in rows if any(c.isalpha() for c in r.text or "")])
    assert Counter((r.doc_id, r.source, r.text) for r in seen["quality"]) == Counter(plain_quality(seen["language"]))
    assert any("Menu" in r.text for r in seen["language"]) and not any("Menu" in r.text for r in seen["quality"])
    assert Counter(r.doc_id for r in seen["near_dedup"]) == plain_dedup(seen["quality"])
    assert whole(seen["near_dedup"]) - whole(seen["quality"]) == Counter()
    before, size, taken = {(r.doc_id, r.source): r for r in seen["near_dedup"]}, Counter(), Counter()
    for r in seen["near_dedup"]:
        size[r.source] += len(cases.words(r.text))
    copies = Counter()
    for r in seen["mixture"]:
        old, w = before[r.doc_id, r.source], cases.words(r.text)
        taken[r.source] += len(w)
        copies[r.doc_id, r.source] += len(w)
        left = iter(cases.words(old.text))
        assert all(x in left for x in w) and r.n_chars == len(r.text) and (r.text == old.text or len(w) <= len(cases.words(old.text)))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, mixing.targets([size[s] for s in order], [5, 2, 1, 5]), strict=True):
        assert abs(taken[s] - t) <= 256
    assert all(n <= 3 * len(cases.words(before[k].text)) for k, n in copies.items())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in seen["packed"]) == plain_pieces(seen["mixture"], tokenizer)
    sequences = defaultdict(list)
    for r in seen["packed"]:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        assert [a for a, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    result = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(r) for r in result.select(*key).collect()) == Counter(tuple(r[k] for k in key) for r in seen["packed"])


def test_empty_table(spark, tmp_path):
    cases.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
