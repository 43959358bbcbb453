"""The operators' queries over the shared tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, ctw, forest, langid, license_scan, line_rules, merkle, minhash, mixing, packing, sharding, token_files, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OLD_SHARDS, NEW_SHARDS = 24, 40


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old shards are those of a layout by source, so one of them is hot."""
    docs = _table(spark, sf_dir, "documents")
    rows = sharding.describe(docs, F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS)))
    return sharding.reshard(rows, NEW_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved"
    )


def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pieces = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixing.taken_words(documents, pieces).select("doc_id", "size", "source_size", "target", "taken")


def op4_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_table(spark, sf_dir, "documents"))


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(_table(spark, sf_dir, "documents"))


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op9_language_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out_flag(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.packed_rows(_table(spark, sf_dir, "documents"))


def op11_pair_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the pages that show a document labelled toxic."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.pages_of_toxic_documents(pages, _table(spark, sf_dir, "labels")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_reshard, op2_bagminhash, op3_mix_sources, op4_projection_forest, op5_context_tree, op6_vector_packing,
        op7_line_frequency, op8_license_diagonals, op9_language_pieces, op10_packed_rows, op11_pair_collocations, op12_merkle_manifest, op13_url_filter, pipeline,
    )
}


# SQL of the oracle's dialect: the same rules, written independently.
_WORD = r"[^\x20\x09-\x0D]+"
_OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
grams AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
l AS (SELECT rid, source, line FROM (SELECT rid, source, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rid),
k AS (SELECT rid, source, len(regexp_extract_all(line, '{_WORD}')) AS n, substr(md5(regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g')), 1, 16) AS key FROM l),
a AS (SELECT rid, list_sort(list(DISTINCT key)) AS lines FROM k GROUP BY rid),
h AS (SELECT source, count(*) AS host_docs FROM d GROUP BY source),
f AS (SELECT k.source, k.key FROM k JOIN a ON a.rid = k.rid JOIN h ON h.source IS NOT DISTINCT FROM k.source GROUP BY k.source, k.key, h.host_docs
  HAVING count(DISTINCT lines) > {line_rules.LINE_DOCS} AND count(DISTINCT lines) > {line_rules.LINE_SHARE}::DOUBLE * host_docs),
r AS (SELECT k.rid, sum(k.n)::BIGINT AS n_removed_words FROM k JOIN f ON f.key = k.key AND f.source IS NOT DISTINCT FROM k.source GROUP BY k.rid),
b AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(text) - length(translate(text, '{line_rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
  FROM d JOIN w ON w.rid = d.rid LEFT JOIN rep ON rep.rid = d.rid LEFT JOIN dup ON dup.rid = d.rid LEFT JOIN r ON r.rid = d.rid)
SELECT *, n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words) AND NOT (n_removed_words > 0 AND n_words - n_removed_words < {line_rules.LEFT_SHARE}::DOUBLE * n_words) AS kept FROM b"""


def _op8() -> str:
    both = [(t, label, True) for t, label in license_scan.BASE_PHRASES] + [(t, label, False) for t, label in license_scan.TEMPLATES]
    k = license_scan.K
    rows = ", ".join(f"({i}, '{t}', '{label}', {str(base).lower()})" for i, (t, label, base) in enumerate(both))

    def gram(words: str) -> str:
        return " || ' ' || ".join(f"{words}[i + {j}]" for j in range(k))

    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT rid, i - 1 AS word, {gram('ws')} AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM d)),
t AS (SELECT id, label, base, len(tw) - {k - 1} AS grams, len(tw) AS size, tw FROM (SELECT id, label, base, string_split(txt, ' ') AS tw FROM (VALUES {rows}) v(id, txt, label, base))),
p AS (SELECT id, label, base, grams, size, i - 1 AS spot, {gram('tw')} AS gram FROM (SELECT *, unnest(range(1, grams + 1)) AS i FROM t)),
v AS (SELECT rid, id, label, base, grams, size, word - spot AS diagonal, spot, word FROM g JOIN p ON p.gram = g.gram),
e AS (SELECT rid, label, true AS base, min(word) AS first_word, 1.0::DOUBLE AS score FROM v WHERE base GROUP BY rid, id, label, grams, diagonal HAVING count(DISTINCT spot) = grams),
r1 AS (SELECT *, coalesce((word - lag(word) OVER (PARTITION BY rid, id ORDER BY word, spot) > {license_scan.FAR}::DOUBLE * size)::INTEGER, 1) AS opens FROM v WHERE NOT base),
r2 AS (SELECT * EXCLUDE opens, sum(opens) OVER (PARTITION BY rid, id ORDER BY word, spot ROWS UNBOUNDED PRECEDING) AS place FROM r1),
r3 AS (SELECT *, coalesce((diagonal - lag(diagonal) OVER (PARTITION BY rid, id, place ORDER BY diagonal, word) > {license_scan.GAP})::INTEGER, 1) AS opens FROM r2),
r4 AS (SELECT * EXCLUDE opens, sum(opens) OVER (PARTITION BY rid, id, place ORDER BY diagonal, word ROWS UNBOUNDED PRECEDING) AS band FROM r3),
r5 AS (SELECT *, coalesce((word - lag(word) OVER (PARTITION BY rid, id, place, band ORDER BY word, spot) > {license_scan.FAR}::DOUBLE * size)::INTEGER, 1) AS opens FROM r4),
s AS (SELECT * EXCLUDE opens, sum(opens) OVER (PARTITION BY rid, id, place, band ORDER BY word, spot ROWS UNBOUNDED PRECEDING) AS span FROM r5),
m AS (SELECT rid, label, false AS base, min(word) AS first_word, count(DISTINCT spot)::DOUBLE / grams AS score FROM s GROUP BY rid, id, label, grams, size, place, band, span
  HAVING count(DISTINCT spot)::DOUBLE / grams >= {license_scan.COVERAGE}::DOUBLE AND max(word) + {k} - min(word) <= 2 * size + {k}),
f AS (SELECT * FROM e UNION ALL SELECT * FROM m),
b AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(first_word) FILTER (WHERE base) AS first_word, max(first_word) FILTER (WHERE base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM f GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN b ON b.rid = d.rid"""



def _op11() -> str:
    c = collocations
    scale = f"{c.SCALE}::HUGEINT"

    def cut(left: str, right: str, k: int) -> str:
        return f"{{'score': ({scale} * a * a // ({left}::HUGEINT * {right}))::BIGINT, 'cut': {k}, 'l': {left}, 'r': {right}}}"

    return rf"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{merkle.UPPER}', '{merkle.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
c AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(k)) GROUP BY ALL),
s AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p FROM c WHERE k > 1 AND f >= {c.LEAST}),
two AS (SELECT s.*, x.f AS l1, y.f AS r1 FROM s JOIN c x ON x.lang = s.lang AND x.k = 1 AND x.phrase = p[1] JOIN c y ON y.lang = s.lang AND y.k = s.k - 1 AND y.phrase = array_to_string(p[2:], ' ')),
three AS (SELECT two.*, x.f AS l2, y.f AS r2 FROM two LEFT JOIN c x ON two.k = 3 AND x.lang = two.lang AND x.k = 2 AND x.phrase = p[1] || ' ' || p[2] LEFT JOIN c y ON two.k = 3 AND y.lang = two.lang AND y.k = 1 AND y.phrase = p[3]),
b AS (SELECT lang, phrase, k, a, CASE WHEN k = 2 THEN {cut("l1", "r1", 1)} ELSE list_sort([{cut("l1", "r1", 1)}, {cut("l2", "r2", 2)}])[1] END AS best FROM three),
m AS (SELECT lang, phrase, max(a) AS more FROM (SELECT lang, a, unnest([p[1] || ' ' || p[2], p[2] || ' ' || p[3]]) AS phrase FROM s WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.lang, b.phrase, a, best.l AS l, best.r AS r, best.score AS score FROM b LEFT JOIN m ON b.k = 2 AND m.lang = b.lang AND m.phrase = b.phrase WHERE more IS NULL OR 100 * more < {c.INSIDE_PERCENT} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM kept JOIN (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang) USING (lang) QUALIFY rank <= {c.TOP}"""


def _op12(in_source: int = 5, above: int = 3) -> str:
    """Trees as unrolled levels: right for sources of up to 16 ** 5 rows and up to 16 ** 3 sources."""

    def field(value: str) -> str:
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"

    def levels(name: str, key: str, n: int) -> str:
        out = ""
        for k in range(n):
            run = f"PARTITION BY {key}, pos // 16 ORDER BY pos ROWS BETWEEN"
            out += f""",
{name}s{k} AS (SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k}),
{name}{k + 1} AS (SELECT {key}, pos // 16 AS pos, CASE WHEN cnt > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h, (cnt + 15) // 16 AS cnt FROM {name}{k} GROUP BY {key}, pos // 16, cnt)"""
        return out

    def folds(start: str, name: str, key: str, base: str, n: int) -> str:
        out, before = "", start
        for k in range(n):
            out += f""",
{base}{k} AS (SELECT x.* EXCLUDE (folded, proof), CASE WHEN y.cnt > 1 THEN sha256(b || folded || a) ELSE folded END AS folded, CASE WHEN y.cnt > 1 THEN proof || b || a ELSE proof END AS proof
  FROM {before} x JOIN {name}s{k} y ON {key} AND y.pos = x.place // {16**k})"""
            before = f"{base}{k}"
        return out

    bits = "list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce({bits}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '') AS tree, {leaf("text")} AS h, CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')")} ELSE h END AS shown FROM documents),
a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, rid) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS cnt FROM d){levels("a", "tree", in_source)},
t0 AS (SELECT 0 AS one, tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS cnt FROM a{in_source}){levels("t", "one", above)},
f AS (SELECT rid, doc_id, tree, h AS leaf, shown AS folded, '' AS proof, pos AS place FROM a0){folds("f", "a", "y.tree = x.tree", "f", in_source)},
u AS (SELECT x.* EXCLUDE place, y.pos AS place, y.h AS subroot FROM f{in_source - 1} x JOIN t0 y ON y.tree = x.tree){folds("u", "t", "y.one = 0", "u", above)}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified FROM u{above - 1}, t{above} r"""


def _op13() -> str:
    u = url_filter
    rules = ", ".join(f"('{action}', '{h}', '{p}')" for action, h, p in u.RULES)

    def parsed(table: str, columns: str) -> str:
        return rf"""SELECT *, regexp_extract(after, '^[^/?#]*') AS raw, translate(raw, '{u.UPPER}', '{u.LOWER}') AS host, substr(after, length(raw) + 1) AS rest, regexp_extract(rest, '^[^?#]*') AS path,
    regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '^www\.', '') AS site,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{u.TRACKING}'))), '&') AS args,
    CASE WHEN site <> '' THEN site || regexp_replace(path, '/+$', '') || CASE WHEN args <> '' THEN '?' || args ELSE '' END END AS canonical
  FROM (SELECT {columns}, CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS after FROM {table})"""

    return rf"""
WITH p AS ({parsed("pages", "page_id, url")}),
shown AS (SELECT canonical FROM p WHERE try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:/|[.]|$)', 1), '') AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1) AND canonical IS NOT NULL),
q AS (SELECT row_number() OVER () AS rid, page_id, host, path, canonical, canonical IS NOT NULL AND canonical IN (SELECT canonical FROM shown) AS listed FROM p),
f AS (SELECT rid, max_by(h || s, length(h || s)) AS rule, max_by(action, length(h || s)) AS action FROM q, (VALUES {rules}) v(action, h, s) WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, canonical, listed FROM q LEFT JOIN f ON f.rid = q.rid"""


ORACLE_SQL: dict[str, str] = {
    "op7_line_frequency": _OP7, "op8_license_diagonals": _op8(), "op11_pair_collocations": _op11(), "op12_merkle_manifest": _op12(), "op13_url_filter": _op13(),
}
