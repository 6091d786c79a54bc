"""Registered queries of this package, with the same results in SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, licenses, lines, minhash, packing, pii, quality, rabitq, runs, sharding, toxicity, whitening
from .tables import table

SHINGLE_SETS_SQL = r"""
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
items AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id),
linked AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM items x JOIN items y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id
  HAVING 100 * count(*) >= 75 * ((SELECT n FROM sizes WHERE doc_id = x.doc_id) + (SELECT n FROM sizes WHERE doc_id = y.doc_id) - count(*))),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.root FROM reach r JOIN linked l ON l.a = r.doc_id)
"""


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its near-duplicate component."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH RECURSIVE {SHINGLE_SETS_SQL}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.root AS component_id, d.doc_id = r.root AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""

def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat earlier ones, exactly or but for a word."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "lines_before", "lines_dropped")


LINE_DEDUP_SQL = r"""
parts AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {docs})),
listed AS (
  SELECT doc_id, line_no, line, w, len(w) AS n, array_to_string(w, ' ') AS t
  FROM (SELECT *, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM parts)),
uniq AS (SELECT t, any_value(w) AS w, any_value(n) AS n, min((doc_id, line_no)) AS place FROM listed WHERE n >= 8 GROUP BY t),
gone AS (
  SELECT t, n, place, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS rest
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM uniq)),
near AS (
  SELECT x.t FROM gone x JOIN gone y ON x.rest = y.rest AND x.i = y.i AND x.n = y.n WHERE y.place < x.place
  UNION SELECT x.t FROM gone x JOIN uniq y ON x.rest = y.t WHERE y.place < x.place
  UNION SELECT y.t FROM gone x JOIN uniq y ON x.rest = y.t WHERE x.place < y.place),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY t, CASE WHEN n < 5 THEN doc_id ELSE -1 END ORDER BY doc_id, line_no) AS k FROM listed),
shorter AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.line_no) FILTER (WHERE NOT p.gone) AS text,
    count(*) AS lines_before, count(*) FILTER (WHERE p.gone) AS lines_dropped
  FROM (SELECT doc_id, line_no, line, n > 0 AND (k > 1 OR (n >= 8 AND t IN (SELECT t FROM near))) AS gone FROM ranked) p GROUP BY p.doc_id)
"""
OP10_SQL = f"""
WITH {LINE_DEDUP_SQL.replace('{docs}', 'documents')}
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text,
  CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE s.lines_before END AS lines_before, coalesce(s.lines_dropped, 0) AS lines_dropped
FROM documents d LEFT JOIN shorter s ON s.doc_id = d.doc_id
"""

def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a benchmark item in a document."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def word_tokenizer() -> str:
    """The definition of the public word-wise tokenizer, from the package that holds it."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer(), with_ids=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector with its number of near-duplicates and its component."""
    return rabitq.embedding_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
reach(vec_id, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.root FROM reach r JOIN linked l ON l.a = r.vec_id)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, r.root AS component_id, e.vec_id = r.root AS kept
FROM embeddings e JOIN (SELECT vec_id, min(root) AS root FROM reach GROUP BY vec_id) r ON r.vec_id = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM linked GROUP BY a) n ON n.a = e.vec_id
"""

def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.BASE]
    base = F.filter("found", lambda s: s["number"] < len(pii.BASE))
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("found")).alias("spans"))


def _pii_sql() -> str:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}([\x20]?[A-Z0-9]){11,30}",
        "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, len({digits}) + 1), lambda i:
      CASE WHEN (len({digits}) - i) % 2 = 0 THEN CAST({digits}[i] AS INT)
      WHEN CAST({digits}[i] AS INT) > 4 THEN 2 * CAST({digits}[i] AS INT) - 9 ELSE 2 * CAST({digits}[i] AS INT) END)) % 10 = 0"""
    plain = "replace(m, ' ', '')"
    turned = f"({plain}[5:] || {plain}[1:4])"
    number = f"list_reduce(list_concat([0], list_transform(string_split({turned}, ''), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) + 945 ELSE ascii(c) - 48 END)), lambda r, v: CASE WHEN v >= 1000 THEN (r * 100 + v - 1000) % 97 ELSE (r * 10 + v) % 97 END)"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0",
        "card": f"len({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"len({digits}) BETWEEN 10 AND 15",
        "iban": f"{number} = 1",
        "ssn": "regexp_matches(lower(right(gap, 40)), 'ssn|social security|tax id')",
    }
    parts = [
        f"""SELECT doc_id, {n} AS number, '{k}' AS kind, m, s, s + length(m) AS e FROM (
          SELECT doc_id, ms[i] AS m, gaps[i] AS gap,
            list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS s
          FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gaps FROM docs)))
        WHERE {valid[k]}"""
        for n, (k, p) in enumerate(patterns.items())
    ]
    item = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    counts = ", ".join(f"count(f.doc_id) FILTER (WHERE number = {n}) AS n_{k}" for n, k in enumerate(pii.BASE))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg({item}, ',' ORDER BY s, number) FILTER (WHERE number < {len(pii.BASE)}), '')) AS base_sha256,
  coalesce(string_agg({item}, ',' ORDER BY s, number), '') AS spans
FROM docs d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the side of each of its participants."""
    return chat.perspectives(table(spark, sf_dir, "conversations"))


OP8_SQL = r"""
WITH rows AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS rank FROM rows),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM rows WHERE role <> 'system'),
segments AS (
  SELECT r.conv_id, perspective, rank, rank // 64 AS part, role = perspective AS learnt,
    CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
      ELSE '<|user:' || replace(role, '<|', '< |') || '|>' END || chr(10) AS head,
    replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM ranked r JOIN people p ON p.conv_id IS NOT DISTINCT FROM r.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY rank) AS last FROM segments)
SELECT conv_id, perspective, part, count(*) AS turns, string_agg(head || body, '' ORDER BY rank) AS text,
  coalesce(string_agg(CAST(last - length(body) AS BIGINT) || '-' || CAST(last AS BIGINT), ',' ORDER BY rank) FILTER (WHERE learnt), '') AS mask,
  coalesce(CAST(sum(length(body)) FILTER (WHERE learnt) AS BIGINT), 0) AS learnt_chars
FROM placed GROUP BY conv_id, perspective, part
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words, and its text without their repeats."""
    found = runs.find_runs(runs.with_tails(table(spark, sf_dir, "documents")))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    return found.withColumn("best", first).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP11_SQL = r"""
WITH hashed AS (
  SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
      flatten(list_transform(range(1, length(id) + 1), lambda i: [CAST(ascii(id[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h
  FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
planned AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS turned, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM hashed),
docs AS (
  SELECT doc_id, n, CASE WHEN turned THEN list_transform(range(0, n), lambda i:
    CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // parts) + 1] END) ELSE w END AS w FROM planned),
places AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM docs),
same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM places x JOIN places y ON x.doc_id = y.doc_id AND x.word = y.word
  WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM stretches x WHERE NOT EXISTS (
    SELECT 1 FROM stretches y WHERE y.doc_id = x.doc_id AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, s, q) AS k FROM runs),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
short AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS t FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i
  WHERE g.i IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, 1000 * b.len // b.q AS exponent_milli,
  sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(t.t, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id AND b.k = 1
LEFT JOIN short t ON t.doc_id = d.doc_id
"""


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and the notices that its text blocks meet."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))

    def joined(*labels):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*labels))), ",")

    said, met = F.col("phrases.label"), F.col("blocks.label")
    score = F.greatest(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)), F.when(F.size("phrases") > 0, 1.0).otherwise(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.start").alias("first_word"),
        F.array_max("phrases.start").alias("last_word"),
        joined(said).alias("base_labels"),
        joined(said, met).alias("labels"),
        score.alias("score"),
    )


def _licenses_sql() -> str:
    def listed(words):
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    notices = [(label, licenses.notice_words(t)) for label, texts in licenses.NOTICES.items() for t in texts]
    templates = ", ".join(f"('{label}', {listed(sorted(set(w)))}, {licenses.needed(w, licenses.PERCENT)}, {licenses.span_of(w)})" for label, w in notices)
    phrases = ", ".join(f"('{label}', {listed(licenses.notice_words(p))})" for p, label in licenses.PHRASES.items())
    return rf"""
WITH docs AS (
  SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
phrases(label, p) AS (VALUES {phrases}),
templates(label, t, need, span) AS (VALUES {templates}),
said AS (
  SELECT doc_id, label, i - 1 AS s FROM (SELECT doc_id, label, w, p, unnest(range(1, n - len(p) + 2)) AS i FROM docs JOIN phrases ON list_has_all(w, p))
  WHERE w[i:i + len(p) - 1] = p),
blocks AS (
  SELECT doc_id, label, t, need, w[i:i + span - 1] AS b
  FROM (SELECT *, unnest(range(1, greatest(n - span, 0) + 2)) AS i FROM docs JOIN templates ON len(list_intersect(list_distinct(w), t)) >= need)),
met AS (
  SELECT doc_id, label, max(len(list_intersect(list_distinct(b), t)) / len(t)) AS c FROM blocks
  WHERE len(list_intersect(list_distinct(b), t)) >= need GROUP BY doc_id, label),
b AS (SELECT doc_id, count(*) AS n, min(s) AS lo, max(s) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM said GROUP BY doc_id),
m AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l, max(c) AS c
  FROM (SELECT doc_id, label, c FROM met UNION ALL SELECT doc_id, label, 1.0 FROM said) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word,
  coalesce(b.l, '') AS base_labels, coalesce(m.l, '') AS labels, CAST(coalesce(m.c, 0) AS DOUBLE) AS score
FROM docs d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the leading components of the covariance, whitened."""
    found, model, error = whitening.whiten(table(spark, sf_dir, "embeddings"))
    explained = [] if model is None else model.explained.tolist()
    shares = F.array(*[F.lit(v) for v in explained]).cast("array<double>")
    return found.select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, "place").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_minhash": op4_minhash,
    "op5_packing": op5_packing,
    "op6_embeddings": op6_embeddings,
    "op7_pii": op7_pii,
    "op8_chat": op8_chat,
    "op9_sharding": op9_sharding,
    "op10_lines": op10_lines,
    "op11_runs": op11_runs,
    "op12_licenses": op12_licenses,
    "op13_whitening": op13_whitening,
}
ORACLES = {"op4_minhash": OP4_SQL, "op6_embeddings": OP6_SQL, "op7_pii": _pii_sql(), "op8_chat": OP8_SQL, "op10_lines": OP10_SQL, "op11_runs": OP11_SQL, "op12_licenses": _licenses_sql()}
