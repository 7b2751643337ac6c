"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlines.llm import ann, common, decontaminate, jaccard_join, language_id, line_dedup, minhash, mixing, periodic, prefix_trie, quality, token_counts, toxicity, warc


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(c.v, q.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score
FROM d QUALIFY rank <= 10
"""


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(common.table(spark, sf_dir, "documents"), k=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP2_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                 ELSE list_transform(range(0, len(ws) - 3), lambda i: array_to_string(ws[i + 1 : i + 4], ' ')) END) AS shs FROM d),
e AS MATERIALIZED (SELECT doc_id, len(shs) AS n, unnest(shs) AS sh FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
      FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * c >= 80 * (nx + ny - c)),
r AS (SELECT doc_id, doc_id AS reached FROM s UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reached = l.x)
SELECT s.doc_id, len(shs) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    found = language_id.identify_languages(documents.select("doc_id", "text"), language_id.learn_dictionaries(documents))
    return found.select("doc_id", (~common.learn_row(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.each_row(mixing.mix_sources(common.table(spark, sf_dir, "documents")))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, i - 1 AS pos, ls[i] AS line,
         len(list_filter(regexp_split_to_array(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
s AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS c
  FROM l WHERE n > 0),
w AS (
  SELECT a.doc_id, a.k AS k0, min(b.k) AS k1 FROM s a
  JOIN s b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 7 AND b.c - a.c + a.n >= 8 GROUP BY a.doc_id, a.k
  UNION
  SELECT b.doc_id, max(a.k) AS k0, b.k AS k1 FROM s a
  JOIN s b ON a.doc_id = b.doc_id AND a.k BETWEEN b.k - 7 AND b.k AND b.c - a.c + a.n >= 8 GROUP BY b.doc_id, b.k),
t AS (
  SELECT w.doc_id, k0, k1, string_agg(line, chr(10) ORDER BY s.k) AS body, min(pos) AS start, max(pos) AS stop
  FROM w JOIN s ON w.doc_id = s.doc_id AND s.k BETWEEN k0 AND k1 GROUP BY w.doc_id, k0, k1),
f AS (SELECT *, min((doc_id, start)) OVER (PARTITION BY body) AS first FROM t),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS pos FROM f WHERE (doc_id, start) > first)
SELECT d.doc_id, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(x.body, '')) END AS text_md5
FROM d LEFT JOIN (
  SELECT l.doc_id, count(*) FILTER (WHERE n > 0) AS n_lines, count(*) FILTER (WHERE n > 0 AND g.pos IS NOT NULL) AS n_removed,
         string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS body
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id) x ON d.doc_id = x.doc_id
"""

def _scored(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", (~common.learn_row(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return _scored(toxicity.score(documents, toxicity.train(documents, labels)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return _scored(quality.score(documents, quality.train(documents, labels)))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(common.table(spark, sf_dir, "pages"))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS best FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to, TRUE AS intact
FROM q
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.round("similarity", 6).alias("similarity"))


OP8_SQL = r"""
WITH b AS (
  SELECT item_id, ws, len(ws) AS n, least(len(ws), 5) AS k FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM benchmark) WHERE len(ws) > 0),
bs AS (SELECT item_id, n, k, q, array_to_string(ws[q + 1 : q + k], ' ') AS sh FROM (SELECT *, unnest(range(0, n - k + 1)) AS q FROM b)),
bi AS (SELECT item_id, list(DISTINCT sh) AS shs FROM bs GROUP BY item_id),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents WHERE text IS NOT NULL),
ds AS (
  SELECT doc_id, k, p, array_to_string(ws[p + 1 : p + k], ' ') AS sh
  FROM (SELECT doc_id, ws, k, unnest(range(0, len(ws) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM b) WHERE len(ws) >= k)),
o AS (
  SELECT DISTINCT ds.doc_id, item_id, bs.n, bs.k, unnest(range(p - bs.n + bs.k, p + 1)) AS t
  FROM ds JOIN bs ON ds.sh = bs.sh AND ds.k = bs.k),
w AS (SELECT o.doc_id, item_id, k, greatest(t, 0) AS s, least(t + n, len(d.ws)) AS e FROM o JOIN d ON d.doc_id = o.doc_id),
v AS (
  SELECT w.doc_id, w.item_id, s, shs, list_distinct(list_transform(range(s, e - k + 1), lambda i: array_to_string(ws[i + 1 : i + k], ' '))) AS win
  FROM w JOIN d ON w.doc_id = d.doc_id JOIN bi ON w.item_id = bi.item_id),
m AS (
  SELECT doc_id, item_id, s, list_sum(list_transform(list_intersect(win, shs), lambda x: length(x))) AS shared,
         list_sum(list_transform(win, lambda x: length(x))) + list_sum(list_transform(shs, lambda x: length(x))) AS total FROM v)
SELECT doc_id, item_id, arg_min(s, (-(shared / (total - shared)), s)) AS start, round(max(shared / (total - shared)), 6) AS similarity
FROM m WHERE 100 * shared >= 80 * (total - shared) GROUP BY doc_id, item_id
"""

def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_sets(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP11_SQL = OP2_SQL.replace("len(ws) < 4", "len(ws) < 5").replace("len(ws) - 3)", "len(ws) - 4)").replace("i + 4]", "i + 5]").replace(", s.doc_id = c.component_id AS kept", "")

#: crc32 of short ASCII texts in SQL: `crc(s)` over a table of 256 values that eight shifts make.
CRC_SQL = """
crc_of AS MATERIALIZED (SELECT list(list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS t
                        FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS v))"""


def crc_sql(number: str) -> str:
    """SQL for the unsigned crc32 of a number's decimal text; crc_of must be joined in."""
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"


def shared_beginnings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns of rebuilt conversations (conv_id, total, place, x, y, size), and conv_id, total: each begins with the first crc32(conv_id) % 6 turns of conversation conv_id - conv_id % 100 in place of as many of its own."""
    c, hundred = F.col("conv_id"), F.lit(100)
    h = F.pmod(F.crc32(c.cast("string")), F.lit(6))
    heads = turns.where((c % hundred == 0) & (F.col("place") < 5)).groupBy(c.alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "x", "y", "size"))).alias("head"))
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("*", h.alias("h"), (c - c % hundred).alias("base"))
    taken = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h").cast("int")))
    convs = counts.join(heads, "base", "left").withColumn("taken", taken)
    borrowed = F.coalesce(F.size("taken"), F.lit(0)).cast("long")
    convs = convs.withColumn("nb", F.when(F.col("taken").isNull(), 0).otherwise(borrowed)).withColumn("total", F.col("nb") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = common.keep(convs.select("conv_id", "h", "nb", "total", "taken"), "conversations")
    first = convs.select("conv_id", "total", F.explode("taken").alias("t")).select("conv_id", "total", "t.*")
    own = turns.join(convs.select("conv_id", "h", "nb", "total"), "conv_id").where(F.col("place") >= F.col("h"))
    rest = own.select("conv_id", "total", (F.col("place") - F.col("h") + F.col("nb")).alias("place"), "x", "y", "size")
    return first.unionByName(rest), convs.select("conv_id", "total")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.keep(prefix_trie.ordered_turns(common.table(spark, sf_dir, "conversations")), "placed")
    return prefix_trie.prefix_nodes(*shared_beginnings(turns))


OP12_SQL = f"""
WITH {CRC_SQL.strip()},
o AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ts, {crc_sql("conv_id")} % 6 AS h FROM o, crc_of),
c AS MATERIALIZED (
  SELECT h.conv_id, list_concat(coalesce(b.ts[1 : h.h], []), h.ts[h.h + 1 :]) AS ts FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS MATERIALIZED (
  SELECT conv_id, len(ts) AS total, d AS depth, CAST(to_json(ts[1 : d]) AS VARCHAR) AS path, CASE WHEN d > 0 THEN CAST(to_json(ts[1 : d - 1]) AS VARCHAR) END AS up,
         CASE WHEN d > 0 THEN length(ts[d].text) ELSE 0 END AS size
  FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM c)),
n AS MATERIALIZED (
  SELECT depth, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE total = depth), '')) AS ends_sha256
  FROM p GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY depth, up),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.depth = k.depth AND n.path = k.path),
s AS (SELECT p.depth, p.path, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.size) AS saved_tokens
      FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.depth, p.path)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s ON m.depth = s.depth AND m.path = s.path LEFT JOIN n u ON u.depth = m.depth - 1 AND u.path = m.up
"""


def repeating_tails(documents: DataFrame) -> DataFrame:
    """doc_id, text: of every tenth document, by h = crc32(doc_id), the words from one on repeat with a period; h tells both."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def tail(ws):
        n = F.size(ws)
        a = F.pmod(g, n)
        period = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        word = lambda i: F.get(ws, F.when(i < a, i).otherwise(a + F.pmod(i - a, period)).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")).otherwise("")

    return documents.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, common.let(common.words(F.col("text")), tail)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(repeating_tails(common.table(spark, sf_dir, "documents")))
    runs = F.col("runs")
    longer = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    best = F.when(F.size(runs) > 0, F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, 0), lambda a, b: F.when(longer(a, b), b).otherwise(a)))
    listed = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size(runs) > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    out = found.withColumn("b", best)
    return out.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"),
        F.expr("(1000 * b.length) div b.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP13_SQL = rf"""
WITH {CRC_SQL.strip()},
d AS (
  SELECT doc_id, {crc_sql("doc_id")} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents, crc_of),
g AS (SELECT *, len(ws) AS n, h // 10 AS g FROM d),
p AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
w AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws FROM p),
e AS MATERIALIZED (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(ws) AS word FROM w),
s AS (SELECT x.doc_id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
      FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
r AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY doc_id, start, length),
best AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_runs FROM runs a
  WHERE NOT EXISTS (FROM runs b WHERE a.doc_id = b.doc_id AND (b.length * a.period > a.length * b.period
    OR (b.length * a.period = a.length * b.period AND (b.start, b.period) < (a.start, a.period))))),
n AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM e ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n_runs, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(n.lines, '')) AS runs_sha256, sha256(coalesce(kept.body, '')) AS collapsed_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (op1_nearest_vectors, op2_minhash_dedup, op3_token_counts, op4_toxicity, op5_quality, op6_warc_index, op7_mix_sources, op8_decontaminate, op9_line_dedup, op10_language_id, op11_jaccard_join, op12_prefix_trie, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op1_nearest_vectors": OP1_SQL, "op2_minhash_dedup": OP2_SQL, "op6_warc_index": OP6_SQL, "op8_decontaminate": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_jaccard_join": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_periodic_runs": OP13_SQL}
