"""One query per operator, over whole tables, with SQL where SQL can say it."""

import public_tokenizers
from pyspark.sql import functions as F

from tagmill.llm import (
    divergence, interactions, langid, licenses, mixing, neardup, packing, quality, secrets, tokencounts, tokenfiles, toxicity, vectordup,
)
from tagmill.llm.registry import query, table
from tagmill.storage import settle

SPACE = r"[^\x20\x09-\x0D]"


@query()
def op1_best_fit_packing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return packing.pack(docs, packing.Packing(public_tokenizers.path("byte_bpe_50k.json")), keep_ids=False)


def license_sql():
    """Every alignment of every template, scored; a phrase inside it has to stand word for word."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    base = " UNION ALL ".join(
        f"SELECT doc_id, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {listed(p.split())})) AS s, '{label}' AS label FROM texts"
        for p, label in licenses.BASE_PHRASES
    )
    bodies = [t.text.split() for t in licenses.TEMPLATES]
    places = ", ".join(f"({t}, {q}, '{word}')" for t, body in enumerate(bodies) for q, word in enumerate(body))
    spans = ", ".join(
        f"({t}, '{template.label}', {q}, {q + len(phrase)})"
        for t, (template, body) in enumerate(zip(licenses.TEMPLATES, bodies, strict=True))
        for phrase in map(str.split, template.phrases) for q in range(len(body)) if body[q:q + len(phrase)] == phrase
    )
    alone = ", ".join(f"('{w}')" for phrase, _ in licenses.BASE_PHRASES for w in phrase.split())
    return rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{licenses.LICENSE_WORD}') AS w FROM documents),
base AS ({base}),
places AS (SELECT * FROM (VALUES {places}) AS v(t, q, word)),
spans AS (SELECT * FROM (VALUES {spans}) AS v(t, label, a, b)),
vocabulary AS (SELECT word FROM places UNION SELECT * FROM (VALUES {alone})),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM texts),
known AS (SELECT words.* FROM words SEMI JOIN vocabulary USING (word)),
idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT doc_id) + 1)) + 1e-6 AS idf
        FROM vocabulary LEFT JOIN known USING (word) GROUP BY word),
weights AS (SELECT t, q, word, idf / sum(idf) OVER (PARTITION BY t) AS share FROM places JOIN idf USING (word)),
stands AS (SELECT doc_id, t, i - q AS start, q, share FROM known JOIN weights USING (word)),
scores AS (SELECT doc_id, t, start, sum(share) AS score FROM stands GROUP BY ALL HAVING sum(share) >= 0.6),
aligned AS (
    SELECT doc_id, label, score FROM scores JOIN spans USING (t)
    WHERE (SELECT count(*) FROM stands x WHERE x.doc_id = scores.doc_id AND x.t = scores.t AND x.start = scores.start AND x.q >= a AND x.q < b) = b - a),
best AS (SELECT doc_id, least(max(score), 1.0) AS score FROM aligned GROUP BY doc_id),
sums AS (SELECT doc_id, count(*) AS n, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
          FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM aligned) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(sums.labels, '') AS base_labels,
       coalesce(named.labels, '') AS labels, round(greatest(coalesce(best.score, 0), CASE WHEN n > 0 THEN 0.5 ELSE 0 END), 9) AS score
FROM texts LEFT JOIN sums USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)"""


@query(license_sql())
def op2_license_scan(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return licenses.license_scan(docs).drop("text").withColumn("score", F.round("score", 9))


@query(rf"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACE}+')) AS size,
           CAST('0x' || substr(md5(doc_id::VARCHAR), 1, 15) AS BIGINT) AS h
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
    FROM sized GROUP BY source),
steps AS (
    SELECT *, 2 * source_size / w AS r,
           coalesce(sum(2 * source_size) OVER o, 0) AS stopped,
           sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open_w,
           sum(source_size) OVER () * 150 / 100 AS total
    FROM sources WINDOW o AS (ORDER BY 2 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
unit AS (SELECT (total - stopped) / open_w AS u FROM steps WHERE (total - stopped) / open_w <= r ORDER BY r, source LIMIT 1),
targets AS (
    SELECT source, source_size, least((2 * source_size)::DOUBLE, w * u) AS target,
           least((2 * source_size)::DOUBLE, w * u) / source_size AS rate
    FROM sources, unit),
plan AS (
    SELECT *, abs(rate - round(rate)) < 1e-9 AS near,
           CASE WHEN abs(rate - round(rate)) < 1e-9 THEN round(rate) ELSE floor(rate) END::BIGINT AS whole
    FROM targets),
taken AS (
    SELECT doc_id, size, source_size, target, whole, near,
           sum(size) OVER (PARTITION BY sized.source ORDER BY h) - size / 2 AS middle
    FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (whole + CASE WHEN NOT near AND middle <= target - whole * source_size THEN 1 ELSE 0 END)::BIGINT * size AS taken
FROM taken""")
def op3_source_mixing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    mix = mixing.mixed(docs)
    return mix.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("""
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
    WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
reach AS (SELECT vec_id AS start, vec_id AS node FROM embeddings UNION SELECT start, b FROM reach JOIN links ON a = node),
found AS (SELECT start, min(node) AS component FROM reach GROUP BY start),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT start AS vec_id, coalesce(n, 0) AS n_links, component AS component_id, start = component AS kept
FROM found LEFT JOIN counts ON a = start""")
def op4_near_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vectordup.near_vectors(vectors).drop("embedding")


@query()
def op5_language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.learn(docs.where(~held_out))
    return langid.identify(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query(rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{SPACE}+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
    FROM documents),
sets AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS x
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
    WHERE 100 * common >= 85 * (s.n + t.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS start, doc_id AS node FROM documents UNION SELECT start, b FROM reach JOIN edges ON a = node)
SELECT start AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(node) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = start GROUP BY start""")
def op6_jaccard_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, neardup.Likeness(4, 85), keep_text=False)


@query(rf"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (
    SELECT *, regexp_extract_all(text, '{SPACE}+') AS w,
           list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{SPACE}')) AS lines
    FROM texts),
windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c >= 2),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
counts AS (
    SELECT doc_id, lang, source, len(w)::BIGINT AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
    FROM split LEFT JOIN covered USING (doc_id)),
judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           1000000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
           1000000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * word_chars // greatest(n_words, 1) AS wlength
    FROM counts),
cells AS (
    SELECT lang, source, measure, v >> s << s AS cell
    FROM (SELECT lang, source, measure, v, greatest(length(bin(v)) - 6, 0)::BIGINT AS s
          FROM (UNPIVOT (SELECT lang, source, symbols, dup_lines, repeats, wlength FROM judged WHERE NOT base_failed)
                ON symbols, dup_lines, repeats, wlength INTO NAME measure VALUE v))),
groups AS (
    SELECT 'own' AS level, lang, source, measure, cell FROM cells
    UNION ALL SELECT 'all', lang, NULL, measure, cell FROM cells),
quartiles AS (
    SELECT level, lang, source, measure, quantile_disc(cell, 0.25) AS q1, quantile_disc(cell, 0.75) AS q3
    FROM groups GROUP BY ALL),
fences AS (
    SELECT *, greatest(q3 - q1, CASE measure WHEN 'symbols' THEN 10000 WHEN 'dup_lines' THEN 60000
                                             WHEN 'repeats' THEN 50000 ELSE 1000 END) * 6 AS wide FROM quartiles),
long AS (
    SELECT doc_id, lang, source, measure, v
    FROM (UNPIVOT (SELECT doc_id, lang, source, symbols, dup_lines, repeats, wlength FROM judged)
          ON symbols, dup_lines, repeats, wlength INTO NAME measure VALUE v)),
beyond AS (
    SELECT DISTINCT doc_id FROM long
    JOIN fences o ON o.level = 'own' AND o.lang = long.lang AND o.source = long.source AND o.measure = long.measure
    JOIN fences a ON a.level = 'all' AND a.lang = long.lang AND a.measure = long.measure
    WHERE (v > o.q3 + o.wide AND v > a.q3 + a.wide)
       OR (long.measure = 'wlength' AND v < o.q1 - o.wide AND v < a.q1 - a.wide))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND beyond.doc_id IS NULL AS kept
FROM judged LEFT JOIN beyond USING (doc_id)""")
def op7_quality_rules(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    counted = quality.measured(docs)
    narrow = counted.withColumn("doc", F.struct("doc.doc_id", "doc.lang", "doc.source"))
    verdicts = quality.judged(settle(narrow, "measured"))
    return verdicts.select("doc.doc_id", *quality.COUNTS[:5], "base_failed", "kept")


@query()
def op8_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, toxicity.learn(docs, table(spark, sf, "labels"))).drop("text")


def kind_sql(kind, pattern, group, least):
    return f"""
    SELECT doc_id, '{kind}' AS kind, regexp_extract_all(text, '{pattern}') AS hits,
           regexp_extract_all(text, '{pattern}', {group}) AS tested, string_split_regex(text, '{pattern}') AS gaps, {least} AS least
    FROM texts WHERE regexp_matches(text, '{pattern}')"""


@query(rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({" UNION ALL ".join(kind_sql(r.kind, r.pattern.replace("'", "''"), r.group, r.least) for r in secrets.RULES)}),
parts AS (
    SELECT doc_id, kind, least, i, length(hits[i]) AS hit, length(tested[i]) AS tested, length(gaps[i]) AS gap
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM matched)),
ends AS (SELECT *, sum(gap + hit) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM parts),
spans AS (
    SELECT doc_id, kind, (e - hit)::BIGINT AS s, e::BIGINT AS e,
           list_position([{", ".join(f"'{r.kind}'" for r in secrets.RULES)}], kind) AS k FROM ends WHERE tested >= least),
texted AS (SELECT doc_id, kind, s, k, e, kind || ':' || s || ':' || e AS span FROM spans),
grouped AS (
    SELECT doc_id, string_agg(span, ',' ORDER BY s, k) AS spans, string_agg(span, ',' ORDER BY s, k) FILTER (k <= 3) AS base,
           count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h
    FROM texted GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN grouped USING (doc_id)""")
def op9_secret_scan(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs).drop("text")
    base = [rule.kind for rule in secrets.BASE_RULES]
    of_kind = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in base]
    spans = secrets.described(F.filter("findings", lambda f: f["kind"].isin(base)))
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), secrets.described(F.col("findings")).alias("spans"))


@query()
def op10_token_files(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    manifest = tokenfiles.write_tokens(docs, tokenfiles.Format(public_tokenizers.path("word_bpe_49k.json")))
    return tokenfiles.read_documents(manifest).withColumnRenamed("id", "doc_id")


@query(r"""
WITH texts AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
groups AS (SELECT DISTINCT lang, source FROM texts),
kept AS (
    SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM texts) GROUP BY lang, term HAVING count(*) >= 3),
counts AS (
    SELECT lang, source, term, count(*)::HUGEINT AS n
    FROM (SELECT lang, source, unnest(w) AS term FROM texts) JOIN kept USING (lang, term) GROUP BY ALL),
vocabulary AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
own AS (
    SELECT lang, source, term, coalesce(n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(total, 0) + v) AS p
    FROM groups JOIN kept USING (lang) JOIN vocabulary USING (lang)
    LEFT JOIN totals USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
whole AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + any_value(v)) AS q
    FROM counts JOIN vocabulary USING (lang) GROUP BY lang, term),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
listed AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM listed)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""")
def op11_source_divergence(spark, sf):
    return divergence.source_divergence(table(spark, sf, "documents").select("text", "lang", "source"))


@query()
def op12_token_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return tokencounts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def removed_sql(label="true"):
    """Documents of a label that are still there before a step and fail its filter."""
    return f"coalesce(sum(n) FILTER ({label} AND earlier & mask = 0 AND own & mask <> 0), 0)::BIGINT"


@query(rf"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '{SPACE}+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
given AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
cells AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           CASE WHEN len(w) < 100 THEN 1 ELSE 0 END | CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
           | CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
           | CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END | CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask,
           count(*) AS n
    FROM split LEFT JOIN given USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a JOIN letters b ON a.x <> b.x JOIN letters c ON c.x NOT IN (a.x, b.x)
    JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (
    SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step])::INTEGER - bits[step] AS earlier
    FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step)),
counted AS (
    SELECT part, filter_order, step, own, coalesce(sum(n) FILTER ((earlier | own) & mask = 0), 0)::BIGINT AS kept, {removed_sql()} AS removed,
           coalesce(sum(n) FILTER (own & mask <> 0), 0)::BIGINT AS failing, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
           {removed_sql("good")} AS good_lost, {removed_sql("toxic")} AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, failing - removed AS redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted""")
def op13_filter_interactions(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return interactions.filter_interactions(docs, table(spark, sf, "labels"))
