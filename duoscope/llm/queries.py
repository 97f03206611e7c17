"""The operators with their production parameters over whole tables, by query name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm import byte_bpe, chat, decontamination, lines, lm, pieces, quality, resampling, secrets, simhash, toxicity, vectorcodes, warc
from duoscope.runtime import read


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.format_chats(read(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "role", "new_role", "action", "merged", F.array_join("inserted", ",").alias("inserted"), F.array_join("closing", ",").alias("closing"), "cost", "fragment")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_text(found["fp"]).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_lm(read(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(read(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.digest(vectorcodes.compress(read(spark, sf_dir, "embeddings")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_quality_rules, op3_line_dedup, op4_sentencepiece, op5_simhash, op6_decontamination, op7_lm_scoring, op8_warc, op9_secret_scans, op10_toxicity,
        op11_vector_codes, op12_resampling, op13_byte_bpe,
    )
}

_WORD = "'[0-9a-z\\x{80}-\\x{10FFFF}]+'"

OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM benchmark),
j AS (SELECT item, least(len(w), 13) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda p: list_slice(w, p, p + least(len(w), 13) - 1))) AS win FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM j),
p AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS spot, w FROM d CROSS JOIN sizes WHERE len(w) >= k),
g AS (SELECT r, k, spot, list_slice(w, spot, spot + k - 1) AS win FROM p),
m AS (SELECT g.r, g.spot, g.k, j.item FROM g JOIN j ON g.k = j.k AND g.win = j.win),
h AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(spot, spot + k)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

#: Rows are ordered by id, then by their text's digest; r tells apart rows that repeat both.
OP3_SQL = """
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, substr(md5(text), 1, 15)) AS r, doc_id, text FROM documents),
l AS (SELECT r, p - 1 AS line_no, lower(lines[p]) AS l FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS p FROM (SELECT r, string_split(text, chr(10)) AS lines FROM docs)) WHERE regexp_matches(lines[p], '[^\\x20\\x09-\\x0D]')),
f AS (SELECT l, min((r, line_no)) AS k FROM l GROUP BY l),
w AS (SELECT k, regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+') AS w FROM f),
t AS (SELECT DISTINCT k, unnest(CASE WHEN len(w) > 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM w),
n AS (SELECT k, count(*) AS n FROM t GROUP BY k),
o AS (SELECT a.k AS a, b.k AS b, count(*) AS o FROM t a JOIN t b ON a.s = b.s AND b.k < a.k GROUP BY ALL),
gone AS (SELECT DISTINCT o.a AS k FROM o JOIN n x ON x.k = o.a JOIN n y ON y.k = o.b WHERE 5 * o.o >= 4 * (x.n + y.n - o.o)),
stay AS (SELECT k FROM f WHERE k NOT IN (SELECT k FROM gone)),
kept AS (SELECT k[1] AS r, count(*) AS n, string_agg(CAST(k[2] AS VARCHAR), ',' ORDER BY k[2]) AS s FROM stay GROUP BY 1),
lines AS (SELECT r, count(*) AS n FROM l GROUP BY r)
SELECT d.doc_id, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_kept, coalesce(kept.s, '') AS kept_lines
FROM docs d LEFT JOIN lines ON lines.r = d.r LEFT JOIN kept ON kept.r = d.r
"""

OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS m FROM p GROUP BY h),
digits AS (SELECT h, list_transform(range(0, 8), lambda k: list_sum(list_transform(range(0, 5), lambda c: CAST((strpos('0123456789abcdef', substr(h, CAST(5 * k + c + 1 AS BIGINT), 1)) - 1) * (CASE c WHEN 0 THEN 65536 WHEN 1 THEN 4096 WHEN 2 THEN 256 WHEN 3 THEN 16 ELSE 1 END) AS BIGINT)))) AS v FROM g),
text AS (SELECT h, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([32768, 1024, 32, 1], lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(x AS BIGINT) // d) % 32 + 1 AS BIGINT), 1)), '')), '') AS b FROM digits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to
FROM p JOIN g USING (h) JOIN text USING (h)
"""



def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd's rounds written out one after another. Rows are told apart by r."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, k AS part, list_slice(q, k * len(q) // {parts} + 1, (k + 1) * len(q) // {parts}) AS x FROM v, range({parts}) t(k))",
        f"c0 AS MATERIALIZED (SELECT part, r - 1 AS e, x FROM p WHERE r <= {entries})",
    ]
    far = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))"
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, part, min({{'far': CAST({far} AS BIGINT), 'e': c.e}}) AS best FROM p JOIN c{k} c USING (part) GROUP BY r, part)")
        if k < rounds:
            steps += [
                f"s{k} AS (SELECT part, best.e AS e, i, count(*) AS n, CAST(sum(x[i]) AS BIGINT) AS s FROM a{k} JOIN p USING (r, part), range(1, len(x) + 1) t(i) GROUP BY ALL)",
                f"m{k} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{k} GROUP BY part, e)",
                f"c{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (part, e))",
            ]
    return f"""WITH {', '.join(steps)},
z AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS h FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN z USING (r), b"""


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) // 2 + 1), lambda i: CAST((strpos('0123456789abcdef', x[2 * i - 1]) - 1) * 16 + strpos('0123456789abcdef', x[2 * i]) - 1 AS BIGINT))), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"

#: The checksum's table is made from its polynomial.
OP12_SQL = f"""
WITH tbl AS (SELECT list(list_reduce(list_prepend(CAST(k AS BIGINT), range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS tbl FROM range(256) t(k)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
f AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
i AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD})) AS w FROM benchmark) GROUP BY w),
u AS (SELECT w, lower(hex(encode(w))) AS x FROM (SELECT w FROM f UNION SELECT w FROM i)),
b AS (SELECT w, {_CRC} % 10000 AS bucket FROM u, tbl),
s AS (SELECT bucket, sum(n) AS s FROM f JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM i JOIN b USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT sum(n) FROM f)::DOUBLE + 10000) / ((CAST(s AS DOUBLE) + 1) * ((SELECT coalesce(sum(n), 0) FROM i)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM f JOIN b USING (w) JOIN g USING (bucket) GROUP BY r),
h AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (r)),
o AS (SELECT r, doc_id, n, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n, weight) AS rank FROM o WHERE n >= 20)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM k) THEN rank END AS rank FROM o LEFT JOIN k USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op6_decontamination": OP6_SQL, "op8_warc": OP8_SQL, "op11_vector_codes": _op11_sql(), "op12_resampling": OP12_SQL}
