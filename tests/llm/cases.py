"""Small documents with every awkward case, and plain versions of what operators compute."""

import random
import re
import zlib
from collections import Counter

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASHING = "size long, start long, shard string, score string, kept string, n_words string, words string, row string, piece string, label string, number string"
CLASHING += "".join(f", {c} string" for c in (
    "_text_key _t1 _t2 _out _cleaned _words _rest _whole _removed_keys _twin _row _n _doc_id_ _source_ _text_key_ _size _chunk _start _place _taken _cell _of_doc_id _language "
    "_score _w _lines _windows _sorted text_key copy removed_keys k1 k2 no_text node component bucket head first_doc source_id source_name epoch block low high _aside_1 TEXT2 lang_pred"
).split())


def prose(rng, n, stems):
    return " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(n))


def make(spark, extra=False, seed=5, n=120):
    rng = random.Random(seed)
    stems = {"en": ["the", "ing", "er", "th", "and", "wh", "sh"], "fr": ["eau", "oi", "ment", "ché", "la", "ier", "ç"], "de": ["sch", "ung", "ein", "ü", "ver", "pf", "heit"]}
    rows = []
    for k in range(n):
        lang = rng.choice(list(stems))
        rows.append([k, prose(rng, rng.randint(5, 300), stems[lang]) + ".\n" + prose(rng, 20, stems[lang]), lang, rng.choice(["a", "a", "a", "b", "c", None])])
    rows += [
        [1000, None, "en", "a"], [1001, "", "en", "b"], [1002, " \n\t ", None, "a"], [1003, "12 34 -- !!", "en", None], [1004, "word", None, "c"],
        [1005, prose(rng, 9000, stems["en"]), "en", "a"], [1006, "same words here again", "en", "a"], [1006, "same words here again", "en", "a"],
        [None, prose(rng, 60, stems["fr"]), "fr", "b"], [1007, "Released under the MIT License. " * 3, "en", "a"], [1008, "<|endoftext|> a  b\n c ", "en", "a"],
    ]
    rows += [[2000 + k, rows[3][1], rows[3][2], "a"] for k in range(6)]  # exact copies
    base = prose(rng, 200, stems["en"]).split()
    for k in range(8):  # near copies
        w = list(base)
        w[rng.randrange(len(w))] = f"changed{k}"
        rows.append([3000 + k, " ".join(w), "en", "b"])
    out = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    if extra:
        names = [c.split()[0] for c in CLASHING.split(", ")]
        return spark.createDataFrame([(*r, *([7] * 2 + ["x"] * (len(names) - 2))) for r in out], f"{SHAPE}, {CLASHING}")
    return spark.createDataFrame(out, SHAPE)


def empty(spark):
    return spark.createDataFrame([], SHAPE)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def shingle_counts(text, size=5):
    w = words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else Counter([tuple(w)])
