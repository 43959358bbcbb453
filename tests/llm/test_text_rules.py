import re
from collections import Counter

import cases

from skywait.llm import license_scan, line_rules


def plain_statistics(text):
    w, lines = cases.words(text), [x for x in (text or "").split("\n") if cases.words(x)]
    windows = list(zip(w, w[1:], w[2:], strict=False))
    count, covered = Counter(windows), set()
    for i, g in enumerate(windows):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    docs = cases.make(spark)
    for r in line_rules.text_statistics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(r.text)


def test_verdicts_against_plain_rules(spark):
    rng_lines = [f"line {chr(97 + k)} of its own with words enough to stay here" for k in range(26)]
    common = "this line stands on every page of the host and says nothing"
    rows = [(k, "\n".join([common, *[f"{x} {chr(97 + k % 26)}{k // 26 * 'x'}" for x in rng_lines[:6]]]), "h") for k in range(60)]
    rows += [(100 + k, "\n".join([common] * 9 + [f"rest {'y' * k}"]), "h") for k in range(30)]
    rows += [(200 + k, rows[0][1], "h") for k in range(50)]  # copies of one text
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_rules.judge(docs, line_docs=20, line_share=0.1, max_repeat_percent=100).collect()}
    assert all(got[k].kept and got[k].n_removed_words == 12 for k in range(60))
    assert all(not got[100 + k].kept and not got[100 + k].base_failed for k in range(30))
    assert all(got[200 + k].kept for k in range(50)), "copies are one document"


def test_documents_of_shared_lines_count_each(spark):
    shared = [f"shared notice {chr(97 + k)} stands on many pages of this host and says nothing new" for k in range(8)]
    rows = [(k, "\n".join([*shared, f"page {'z' * (k + 1)} has this one line"]), "h") for k in range(60)]
    picks = [[x for b, x in enumerate(shared) if k >> b & 1] for k in range(256)]
    rows += [(1000 + k, "\n".join(p), "g") for k, p in enumerate(picks) if len(p) >= 5]  # nothing but shared lines
    rows += [(2000 + k, rows[0][1] + "\n" + rows[0][1], "f") for k in range(50)]  # copies of one text
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_rules.judge(docs, max_repeat_percent=100).collect()
    assert all(not r.base_failed for r in got) and len(got) == len(rows)
    assert all(r.n_removed_words == 8 * 14 and not r.kept for r in got if r.doc_id < 1000)
    assert all(r.n_removed_words == r.n_words and not r.kept for r in got if 1000 <= r.doc_id < 2000)
    assert all(r.n_removed_words == 0 and r.kept for r in got if r.doc_id >= 2000)


def test_frequent_lines_leave_the_text(spark):
    own = [f"own line {'q' * (k + 1)} " + " ".join(f"w{'v' * k}{chr(97 + j)}" for j in range(22)) for k in range(40)]
    rows = [(None if k % 4 == 0 else k, f"Menu  {k}\n{own[k]}\n\nMENU 7\n last {'p' * (k + 1)} line\ncontact us", "h", -1, "x") for k in range(40)]
    rows += [(1, rows[1][1], "other", -1, "x"), (100, "\n".join(["menu 1"] * 200), "h", -1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, note string")
    got = line_rules.cleaned(docs, min_words=20, max_repeat_percent=100)
    assert got.dtypes == docs.dtypes
    text = [f"{own[k]}\n\n last {'p' * (k + 1)} line" for k in range(40)]
    want = Counter((None if k % 4 == 0 else k, x, "h", len(x)) for k, x in enumerate(text)) + Counter([(1, rows[1][1], "other", -1)])
    assert Counter((r.doc_id, r.text, r.source, r.n_chars) for r in got.collect()) == want
    assert line_rules.cleaned(cases.empty(spark)).count() == 0


def test_awkward_rows(spark):
    docs = cases.make(spark, extra=True)
    out = line_rules.judge(docs)
    assert out.count() == docs.count() and len(set(out.columns)) == len(out.columns)
    by = {r.doc_id: r for r in out.collect()}
    assert not by[1000].kept and by[1000].n_words == 0 and by[1005].n_words == 9000
    assert line_rules.judge(cases.empty(spark)).count() == 0


def plain_scan(text):
    lower = (text or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER))
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES:
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base(spark):
    texts = [
        "Released under the MIT License.", "Under the mit, LICENSE; apache license: version 2.0", "CC BY-NC 4.0 cc by nc nc by cc by nc", "under the mit\nlicense under the MIT license",
        None, "", "mit license", "Licensed under the Apache License, Version 2.0.", "this work is licensed under the GNU General Public License, version 3.", "é under the mit license à",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated docs files (the Software), to deal in the Software without any restriction",
    ]
    docs = spark.createDataFrame([(9000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string").unionByName(cases.make(spark).select("doc_id", "text"))
    got = license_scan.scan(docs).join(docs.distinct(), "doc_id").collect()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(r.text), r.text
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    by = {r.doc_id: r for r in got}
    assert by[9008].labels == "gpl-3" and by[9008].n_base == 0
    assert by[9010].labels == "mit", "a few changed words do not hide a notice"
    assert license_scan.scan(cases.empty(spark)).count() == 0
    extra = cases.make(spark, extra=True)
    assert license_scan.scan(extra).count() == extra.count()


def test_spans_merge_neighbouring_diagonals(spark):
    t = license_scan.TEMPLATES[0][0].split()
    cut = " ".join(["x"] * 7 + t[:12] + ["inserted"] + t[12:])
    found = license_scan.spans(spark.createDataFrame([(1, cut)], "doc_id long, text string")).where("not base").collect()
    assert len(found) == 1 and found[0].first_word == 7 and found[0].end_word == 8 + len(t) and found[0].score > 0.9


def test_a_stray_match_on_the_diagonal_loses_no_notice(spark):
    t = license_scan.TEMPLATES[1][0].split()
    stray = [f"w{k}" for k in range(300)]
    far = stray[:150] + t + stray[150 + len(t) :]
    far[30:33] = t[3:6]  # three words of the notice elsewhere, but on a neighbouring diagonal of another one's
    far[120:123] = t[:3]
    far[270:273] = t[5:8]
    near = ["x"] * 20 + t[2:5] + ["y"] * 9 + t + ["z"] * 9 + t[1:4] + ["x"] * 20
    twice = t + ["and"] + t
    texts = {1: far, 2: near, 3: twice}
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    found = license_scan.spans(frame, templates=[license_scan.TEMPLATES[1]]).where("not base").collect()
    by = {k: [r for r in found if r.doc_id == k] for k in texts}
    assert all(r.score == 1 for r in found)
    assert [(r.first_word, r.end_word) for r in by[1]] == [(150, 150 + len(t))]
    assert len(by[2]) == 1 and by[2][0].first_word <= 32 and len(by[3]) == 2


def test_whole_license_texts(spark):
    docs = [(k, f"some words before {t} and after") for k, (t, _) in enumerate(license_scan.LONG_TEMPLATES)]
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(license_scan.LONG_TEMPLATES) == 12
    for r in got:
        assert license_scan.LONG_TEMPLATES[r.doc_id][1] in r.labels.split(",") and r.score == 1
