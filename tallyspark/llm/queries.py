"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD
from tallyspark.llm.conversation_repair import digests, repair
from tallyspark.llm.fingerprints import edited_fingerprints, fingerprint, likeness
from tallyspark.llm.jaccard_join import jaccard_join
from tallyspark.llm.language_id import identify
from tallyspark.llm.license_scan import CUE, LEAST_COSINE, LICENCE_SHARE, NOTICES, TEXTS, TOKEN, scan, spdx
from tallyspark.llm.lm_scoring import score_texts
from tallyspark.llm.mixing import mix
from tallyspark.llm.packing import pack
from tallyspark.llm.periodic_runs import periodic_runs
from tallyspark.llm.quality_rules import judge
from tallyspark.llm.sharding import shard_rows
from tallyspark.llm.topk import exact_topk
from tallyspark.llm.url_filter import BAD_RATIO, BOUND_Z, LEAST_WEIGHT, MOST_SHARE, MOST_WEIGHT, RULES, SUFFIXES, url_filter

#: Id that closes each packed document.
END_ID = 2


def tokenizer_path() -> str:
    """The public tokenizer whose ids are packed and scored."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens, a row per piece."""
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention model and unigram scores of all documents."""
    return score_texts(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents; a document's path is its source, its id by thousands, then by hundreds; one that is mainly a notice stands for its folder."""
    docs = table(spark, sf_dir, "documents")
    folder = lambda n: F.coalesce(F.floor(F.col("doc_id") / n).cast("string"), F.lit("none"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), folder(1000), folder(100), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    found = scan(docs.select(path.alias("path"), "text"), share=LICENCE_SHARE)
    doc_id = F.regexp_extract("path", r"/(-?[0-9]+)\.txt$", 1)
    return found.select(F.when(doc_id != "", doc_id.cast("long")).alias("doc_id"), "path", "licence", F.round("score", 6).alias("score"), "inherited_from")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page urls; labels of the id that a page has are its outcomes (bad: low quality or toxic)."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    judged = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), labels)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages of all documents."""
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents, with weights 1, 2, 3 in turn, takes from each."""
    docs = table(spark, sf_dir, "documents")
    rows, sources, spans = mix(docs.select("doc_id", "source", "text"), lambda i, _: 1.0 + i % 3)
    taken = spans.groupBy("row").agg(F.sum("words").alias("taken"))
    out = rows.join(taken, "row", "left").join(F.broadcast(sources.select("s", "source_size", "target")), "s")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows by inner product for every row whose id is divisible by 50."""
    return exact_topk(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with their likeness."""
    rows = edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"), fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on a ring of 24 shards whose counts of rows are at most one apart."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text").cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"), F.xxhash64("text").alias("text_key"))
    out = shard_rows(rows, F.col("text_key"), ["doc_id", "text_key"], shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    members, _ = jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    least = members.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return members.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty); where crc32(doc_id) is divisible by 10, words from a place on repeat with a period. A null id plants none."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    words = F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("_words", F.coalesce(words, F.array().cast("array<string>")))
    n, g = F.size("_words").cast("long"), F.floor(F.col("_h") / 10)
    rows = rows.withColumn("_at", F.when(n > 0, g % n)).withColumn("_period", F.when(n > 0, 1 + F.floor((n - F.col("_at")) / (3 + g % 8))))
    place = lambda i: F.when(i < F.col("_at"), i).otherwise(F.col("_at") + (i - F.col("_at")) % F.col("_period")).cast("int")
    planted = F.array_join(F.transform(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.get("_words", place(i))), " ")
    return rows.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, some of them with planted periods, and what stays when runs keep their first period."""
    rows = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    start, length, period = -best["back"], best["length"], -best["less"]
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated or given to the user, by a checksum of conversation and turn."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("_k"))
    k = F.col("_k")
    rows = rows.where(k != 0).withColumn("_copy", F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of all conversations after damage, and their cheapest repairs."""
    rows = table(spark, sf_dir, "conversations")
    turns, report = repair(damaged(rows))
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = report.withColumnRenamed("conv_id", "_c").join(digests(turns).withColumnRenamed("conv_id", "_d"), F.col("_c").eqNullSafe(F.col("_d")), "left")
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, and which a cascade of quality rules keeps."""
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_packing, op2_lm_scoring, op3_license_scan, op4_url_filter, op5_language_id, op6_mixing, op7_topk, op8_fingerprints, op9_sharding, op10_jaccard_join, op11_periodic_runs, op12_conversation_repair, op13_quality_rules)}

_SUFFIXES = ", ".join(f"'{s}'" for s in SUFFIXES)
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)



def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN}')"


_NAMES = [n for n, _ in [*NOTICES, *TEXTS]]
_TEMPLATE_ROWS = ", ".join(f"({i}, {_text(n)}, {_text(t)}, {short})" for i, (n, t, short) in enumerate([*[(*x, True) for x in NOTICES], *[(*x, False) for x in TEXTS], *[(*x, True) for x in spdx(_NAMES)]]))
_CUE = CUE.removeprefix("(?i)")

ORACLES = {
    "op3_license_scan": rf"""
WITH f AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce((doc_id // 1000)::VARCHAR, 'none') || '/' || coalesce((doc_id // 100)::VARCHAR, 'none') || '/' || coalesce(doc_id::VARCHAR, 'none') || '.txt' AS path,
  coalesce(source, 'none') || '/' || coalesce((doc_id // 1000)::VARCHAR, 'none') || '/' || coalesce((doc_id // 100)::VARCHAR, 'none') AS folder, coalesce(text, '') AS text, {_tok("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT i, licence, {_tok("txt")} AS w, short, starts_with(txt, 'SPDX-') AS tag FROM (VALUES {_TEMPLATE_ROWS}) v(i, licence, txt, short)),
need AS (SELECT DISTINCT i, u.token FROM t, LATERAL (SELECT unnest(w) AS token) u WHERE short AND (tag OR regexp_full_match(u.token, '[0-9]+([.][0-9]+)?'))),
lens AS (SELECT DISTINCT len(w) AS n FROM t WHERE short),
known AS (SELECT DISTINCT unnest(w) AS token FROM t),
total AS (SELECT count(*) AS n FROM f),
df AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, path, unnest(w) AS token FROM f) JOIN known USING (token) GROUP BY 1),
idf AS (SELECT token, ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1 AS idf FROM known LEFT JOIN df USING (token), total),
c AS (SELECT * FROM f WHERE regexp_matches(text, '{_CUE}', 'i')),
cue AS (SELECT path, w, u.i FROM c, LATERAL (SELECT unnest(range(len(w))) AS i) u WHERE regexp_matches(w[u.i + 1], '{_CUE}', 'i')),
win AS (SELECT DISTINCT path, w, n, u.s FROM cue, lens, LATERAL (SELECT unnest(range(greatest(i - n + 1, 0), i + 1)) AS s) u),
p AS (SELECT path, u.x AS text FROM c, LATERAL (SELECT unnest(string_split(text, chr(10))) AS x) u WHERE regexp_matches(u.x, '{_CUE}', 'i')
  UNION SELECT path, u.x FROM c, LATERAL (SELECT unnest(regexp_split_to_array(text, '
[ 	]*
')) AS x) u WHERE regexp_matches(u.x, '{_CUE}', 'i')
  UNION SELECT path, text FROM c UNION SELECT path, array_to_string(w[s + 1:s + n], ' ') FROM win),
d AS (SELECT DISTINCT text FROM p),
tf AS (SELECT text, token, count(*) AS tf FROM (SELECT text, unnest({_tok("text")}) AS token FROM d) GROUP BY ALL),
wt AS (SELECT text, token, tf * coalesce(idf, ln(n + 1.0) + 1) AS x, idf IS NOT NULL AS known FROM tf LEFT JOIN idf USING (token), total),
ours AS (SELECT text, token, x / sqrt(sum(x * x) OVER (PARTITION BY text)) AS x, known FROM wt),
tt AS (SELECT i, token, count(*) AS tf FROM (SELECT i, unnest(w) AS token FROM t) GROUP BY ALL),
tw AS (SELECT i, token, tf * idf AS x FROM tt JOIN idf USING (token)),
theirs AS (SELECT i, token, x / sqrt(sum(x * x) OVER (PARTITION BY i)) AS x FROM tw),
sc AS (SELECT o.text, th.i, round(sum(o.x * th.x), 9) AS score FROM ours o JOIN theirs th USING (token) GROUP BY ALL HAVING round(sum(o.x * th.x), 9) >= {LEAST_COSINE}),
ok AS (SELECT sc.text, sc.score, t.licence FROM sc JOIN t USING (i) WHERE NOT EXISTS (SELECT 1 FROM need WHERE need.i = sc.i AND need.token NOT IN (SELECT token FROM tf WHERE tf.text = sc.text))),
b AS (SELECT text, min(struct_pack(s := -score, licence := licence)) AS b FROM ok GROUP BY 1),
piece AS (SELECT p.path, min(struct_pack(b := b.b, n := len({_tok("p.text")}), w := len(f.w))) AS p FROM p JOIN b USING (text) JOIN f ON f.path = p.path GROUP BY 1),
best AS (SELECT path, p.b AS b, p.n >= {LICENCE_SHARE} * p.w AS covers FROM piece),
licensed AS (SELECT folder, min(best.b.licence) AS inherited FROM best JOIN f USING (path) WHERE covers GROUP BY 1),
up AS (SELECT x.folder, max(struct_pack(l := length(l.folder), folder := l.folder, inherited := l.inherited)) AS n FROM (SELECT DISTINCT folder FROM f) x JOIN licensed l ON x.folder = l.folder OR starts_with(x.folder, l.folder || '/') GROUP BY 1)
SELECT f.doc_id, f.path, coalesce(best.b.licence, up.n.inherited) AS licence, round(-best.b.s, 6) AS score, CASE WHEN best.path IS NULL THEN up.n.folder END AS inherited_from
FROM f LEFT JOIN best ON best.path = f.path LEFT JOIN up ON up.folder = f.folder
""",
    "op4_url_filter": f"""
WITH p AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
o AS (SELECT p.host, CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END AS bad FROM p JOIN labels l ON l.doc_id = p.page_id
      WHERE (l.quality = 0 OR l.toxic = 1) IS NOT NULL AND p.host <> ''),
l AS (SELECT host, string_split(host, '.') AS l, count(*) AS n, sum(bad) AS bad FROM o GROUP BY host),
h AS (SELECT host, n, bad, array_to_string(l[greatest(len(l) - k + 1, 1):], '.') AS suffix, array_to_string(l[greatest(len(l) - k, 1):], '.') AS domain
      FROM (SELECT *, CASE WHEN array_to_string(l[greatest(len(l) - 1, 1):], '.') IN ({_SUFFIXES}) THEN 2 ELSE 1 END AS k FROM l)),
a AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS p_all FROM h),
g AS (SELECT 'suffix' AS level, suffix AS g, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix UNION ALL SELECT 'domain', domain, sum(n), sum(bad) FROM h GROUP BY domain UNION ALL SELECT 'host', host, n, bad FROM h),
gp AS (SELECT level, sum(bad) / sum(n) AS p FROM g GROUP BY 1),
gq AS (SELECT level, any_value(p) * (1 - any_value(p)) AS noise, (sum(n * (bad / n - p) * (bad / n - p)) - (count(*) - 1) * any_value(p) * (1 - any_value(p))) / nullif(sum(n) - sum(n * n) / sum(n), 0) AS v FROM g JOIN gp USING (level) GROUP BY 1),
gw AS (SELECT level, CASE WHEN round(v, 12) > 0 THEN least(greatest(noise / v - 1, {LEAST_WEIGHT}), {MOST_WEIGHT}) ELSE {MOST_WEIGHT} END AS w FROM gq),
s AS (SELECT g AS suffix, (bad + w * p_all) / (n + w) AS p_suffix FROM g JOIN gw USING (level), a WHERE level = 'suffix'),
d AS (SELECT g AS domain, (bad + w * p_suffix) / (n + w) AS p_domain FROM g JOIN gw USING (level) JOIN (SELECT DISTINCT domain, suffix FROM h) x ON x.domain = g.g JOIN s USING (suffix) WHERE level = 'domain'),
m AS (SELECT host, n, w, (bad + w * p_domain) / (n + w) AS mean FROM h JOIN d USING (domain), gw WHERE level = 'host'),
b AS (SELECT host, round(mean - {BOUND_Z} * sqrt(mean * (1 - mean) / (n + w + 1)), 9) AS low, round(least({BAD_RATIO} * p_all, {MOST_SHARE}), 9) AS cut FROM m, a),
r AS (SELECT * FROM (VALUES {_RULE_ROWS}) t(verdict, h, path)),
f AS (SELECT page_id, p.url, max(struct_pack(l := length(r.h || r.path), rule := r.h || r.path, verdict := r.verdict)) AS best
      FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.path) GROUP BY page_id, p.url)
SELECT p.page_id, p.host, p.path, f.best.rule AS rule,
       coalesce(f.best.verdict, CASE WHEN b.low > b.cut THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f ON f.page_id = p.page_id AND f.url = p.url LEFT JOIN b ON b.host = p.host
""",
    "op7_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
""",
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4]) END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
t AS (SELECT doc_id, hash(g) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n_shingles + b.n_shingles - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS reached FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
SELECT n.doc_id, n.n_shingles, coalesce(min(r.reached), n.doc_id) AS component_id FROM n LEFT JOIN r USING (doc_id) GROUP BY n.doc_id, n.n_shingles
""",
    "op12_conversation_repair": r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS bytes FROM conversations),
k AS (SELECT conv_id, turn, role, text, xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM o, tab),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(role)) || ':' || role || text)) AS i FROM d),
f AS (SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
  left(role, 1) || left(lead(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS pair FROM n),
said(s, t) AS (VALUES (0, 2), (1, 2), (3, 2), (2, 3)),
added AS (SELECT s, s AS t, '' AS a FROM (VALUES (0), (1), (2), (3)) v(s) UNION ALL SELECT s, t, 'I' FROM said UNION ALL SELECT x.s, y.t, 'II' FROM said x JOIN said y ON y.s = x.t),
moves AS (SELECT 'D' AS e, s, s AS t, 3 AS price, '' AS c FROM (VALUES (0), (1), (2), (3)) v(s) UNION ALL SELECT 'R', s, t, 2, '' FROM said UNION ALL SELECT 'K', s, t, 0, CASE t WHEN 2 THEN 'u' ELSE 'a' END FROM said UNION ALL SELECT 'K', 0, 1, 0, 's'),
ends AS (SELECT conv_id, max(i) AS n FROM f GROUP BY 1),
p AS (SELECT conv_id, 0::BIGINT AS i, t AS s, struct_pack(cost := 2 * length(a), audit := a) AS v FROM ends, added WHERE s = 0
  UNION ALL
  SELECT p.conv_id, p.i + 1, w.t, min(struct_pack(cost := p.v.cost + m.price + 2 * length(w.a) + CASE WHEN f.fault = 'truncated' AND m.e <> 'D' THEN 1 ELSE 0 END, audit := p.v.audit || m.e || w.a))
  FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN moves m ON m.s = p.s AND (m.e = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (m.e = 'R' OR m.c = f.c)) JOIN added w ON w.s = m.t
  GROUP BY p.conv_id, p.i, w.t),
best AS (SELECT p.conv_id, min(p.v) AS v FROM p JOIN ends ON ends.conv_id IS NOT DISTINCT FROM p.conv_id AND ends.n = p.i WHERE p.s IN (0, 3) GROUP BY 1),
edit AS (SELECT conv_id, u.k, v.audit[u.k] AS e, length(replace(left(v.audit, u.k), 'I', '')) AS i, length(replace(left(v.audit, u.k - 1), 'D', '')) AS m, length(v.audit) - length(ltrim(v.audit, 'D')) AS lead FROM best, LATERAL (SELECT unnest(range(1, length(v.audit) + 1)) AS k) u),
head AS (SELECT edit.conv_id, edit.e = 'K' AND f.c = 's' AS s FROM edit JOIN f ON f.conv_id IS NOT DISTINCT FROM edit.conv_id AND f.i = edit.i WHERE edit.k = edit.lead + 1),
line AS (SELECT edit.conv_id, edit.k, CASE WHEN e = 'K' THEN f.role WHEN (m + CASE WHEN head.s THEN 1 ELSE 0 END) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE f.text END AS line
  FROM edit LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM edit.conv_id AND f.i = edit.i LEFT JOIN head ON head.conv_id IS NOT DISTINCT FROM edit.conv_id WHERE e <> 'D'),
whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS text FROM line GROUP BY 1),
r AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.v.cost, 0)::BIGINT AS cost, coalesce(best.v.audit, '') AS audit, sha256(coalesce(whole.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM i.conv_id
""",
    "op13_quality_rules": r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM (SELECT r, u.i, ws[u.i:u.i + 7] AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 6)) AS i) u)),
p AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k.j AS at FROM g, (SELECT unnest(range(8)) AS j) k WHERE g.k > 1) GROUP BY 1),
c AS (SELECT w.*, len(ws) AS n_words, list_sum(list_transform(ws, lambda x: length(x))) AS chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM w LEFT JOIN p USING (r)),
f AS (SELECT *, coalesce(chars, 0)::BIGINT AS word_chars, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  list_transform(ws, lambda x: regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}')) AS loud FROM c)
SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 4 > n_words OR word_chars NOT BETWEEN 2 * n_words AND 20 * n_words OR n_dup_lines * 10 > n_lines * 3
    OR len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•‣][\x20\x09]'))) * 10 > n_lines * 9
    OR len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) * 10 > n_lines * 3
    OR len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) * 10 < n_words * 6
    OR len(list_filter(loud, lambda x: x)) * 10 > n_words * 4 OR len(list_distinct(ws)) * 50 < least(n_words, 1000)) AS kept
FROM f
""",
}
