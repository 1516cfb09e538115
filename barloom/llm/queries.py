"""The query opN_<name> of each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import brown, decontam, embeddings, exact, html, langid, lexical, minhash, mixing, pieces, pii, toxicity, turns
from barloom.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model()).drop("text"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_exact(_table(spark, sf_dir, "documents")).drop("length")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(COALESCE(CAST(doc_id AS VARCHAR), '')), doc_id) AS k FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS room, CAST([1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM s),
f AS (SELECT *, room / weight AS fills_at FROM w),
p AS (SELECT fills_at, sum(room) AS room, sum(weight) AS weight FROM f GROUP BY fills_at),
q AS (SELECT fills_at, COALESCE(sum(room) OVER b, 0) AS full_, COALESCE(sum(weight) OVER b, 0) AS out_ FROM p WINDOW b AS (ORDER BY fills_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, fills_at) AS level FROM (SELECT fills_at, ((SELECT sum(source_size) FROM s) - full_) / ((SELECT sum(weight) FROM w) - out_) AS level FROM q) WHERE level <= fills_at),
g AS (SELECT source, source_size, least(CAST(room AS DOUBLE), (SELECT level FROM l) * weight) AS target FROM f),
x AS (SELECT r.doc_id, r.size, g.source_size, g.target, r.k, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
  CAST(CAST('0x' || substr(md5('offset:' || COALESCE(r.source, '')), 1, 5) AS BIGINT) AS DOUBLE) / 1048576 AS u
  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * least(3, floor(u + rate * k) - floor(u + rate * (k - 1))) AS BIGINT) AS taken FROM x
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(length(text), 0) AS n, sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = toxicity.rate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return rated.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), html.train())
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op9_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.train()).drop("text"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op12_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.digest(turns.repair(_table(spark, sf_dir, "conversations")))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
l AS (SELECT count(*) FILTER (len(ws) > 0) AS big_n, CAST(sum(len(ws)) AS BIGINT) AS big_l FROM d),
p AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, l WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT q.item_id, t.r, t.doc_id, CAST(sum(f.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (100 - 50 + (50 * t.n * l.big_n) // l.big_l)))) AS BIGINT) AS score
  FROM t JOIN f USING (term) JOIN q USING (term) CROSS JOIN l GROUP BY q.item_id, t.r, t.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
i AS (SELECT item_id, {_TERMS} AS ws, least(10, len(ws)) AS n FROM benchmark),
b AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS win FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM i WHERE n > 0)),
c AS (SELECT r, k, n, array_to_string(ws[k:k + n - 1], ' ') AS win FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM b))),
h AS (SELECT DISTINCT r, k, n, item_id FROM c JOIN b USING (n, win)),
x AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
y AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r)
"""


def _edit(state: str, cost: str, letter: str) -> str:
    """A state of the repair is its cost in nine digits, then its audit: one string, so that the least is the best."""
    return f"(lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || {letter})"


_PUT = {k: _edit(k, "5", "'I'") for k in "esau"}
_GONE = {k: _edit(k, "2", "'D'") for k in "esau"}
_ROLE = {k: _edit(p, f"CASE WHEN ini = '{k}' THEN 0 ELSE 1 END + cut", f"CASE WHEN ini = '{k}' THEN 'K' ELSE 'R' END") for k, p in (("u", "least(e, s, a)"), ("a", "u"))}

OP13_SQL = rf"""
WITH RECURSIVE tbl AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
k AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, list_transform(string_split(COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes FROM conversations),
h AS (SELECT k.*, xor(4294967295, list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS kind FROM k, tbl),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos, left(role, 1) AS ini, right(rtrim(text, E' \t\n\x0B\f\r'), 1) AS tail FROM m),
g AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS pair FROM p),
r AS (SELECT *, COALESCE(fault, '') IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cut FROM g),
f AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, '000000000' AS e, '500000000' AS s, '500000000' AS u, '500000000' AS a FROM r
  UNION ALL
  SELECT conv_id, pos, {_GONE["e"]},
    CASE WHEN must OR ini <> 's' THEN {_GONE["s"]} ELSE least({_GONE["s"]}, {_edit("e", "cut", "'K'")}) END,
    CASE WHEN must THEN {_GONE["u"]} ELSE least({_GONE["u"]}, {_ROLE["u"]}) END,
    CASE WHEN must THEN {_GONE["a"]} ELSE least({_GONE["a"]}, {_ROLE["a"]}) END
  FROM (SELECT conv_id, pos, ini, must, cut, e, s, u, least(a, {_PUT["u"]}) AS a
    FROM (SELECT f.conv_id, r.pos, ini, must, cut, e, s, a, least(u, {_PUT["e"]}, {_PUT["s"]}, {_PUT["a"]}) AS u FROM f JOIN r ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = f.pos + 1))),
b AS (SELECT conv_id, least(e, a, {_edit(f"least(u, {_PUT['e']}, {_PUT['s']}, {_PUT['a']})", "5", "'I'")}) AS best FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
x AS (SELECT conv_id, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM b),
y AS (SELECT conv_id, i, substr(audit, i, 1) AS edit, length(replace(left(audit, i), 'I', '')) AS pos, length(replace(left(audit, i), 'D', '')) AS n FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM x)),
z AS (SELECT y.conv_id, y.i, y.edit, y.n, CASE WHEN edit <> 'I' THEN r.role END AS role, CASE WHEN edit <> 'I' THEN r.text ELSE '' END AS text, max(CASE WHEN n = 1 AND edit = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY y.conv_id) AS sys
  FROM y JOIN r ON y.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = greatest(y.pos, 1) WHERE edit <> 'D'),
v AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (n - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS lines FROM z GROUP BY conv_id),
c AS (SELECT conv_id, COALESCE(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT o.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, COALESCE(cost, 0) AS cost, COALESCE(audit, '') AS audit, sha256(COALESCE(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN x ON o.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN v ON o.conv_id IS NOT DISTINCT FROM v.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mix": op1_mix, "op2_minhash": op2_minhash, "op3_pieces": op3_pieces, "op4_langid": op4_langid, "op5_vectors": op5_vectors, "op6_exact": op6_exact, "op7_toxicity": op7_toxicity, "op8_html": op8_html, "op9_brown": op9_brown, "op10_pii": op10_pii, "op11_search": op11_search, "op12_decontam": op12_decontam, "op13_turns": op13_turns}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": OP1_SQL, "op6_exact": OP6_SQL, "op11_search": OP11_SQL, "op12_decontam": OP12_SQL, "op13_turns": OP13_SQL}
