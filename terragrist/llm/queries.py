"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from terragrist.llm import chat, decontaminate, filter_audit, forest, html_text, langid, licenses, minhash, packing, pii, quality, rules, source_audit

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return quality.classify(_table(spark, sf_dir, "documents"), trusted)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op8_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.with_byte_tokens(_table(spark, sf_dir, "documents")), "doc_id", "n_tokens")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = chat.conversation_events(_table(spark, sf_dir, "conversations"))
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT -7L AS conv_id, at AS seq, 'message' AS kind, at AS message, role, '{said}' AS text FROM VALUES (1, 'user'), (2, 'assistant') AS t(at, role)")
    return chat.digests(chat.read_back(chat.render(chat.fold_events(log.unionByName(own)))))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.document_masks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")), "ABCDE")


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(_table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_html_extraction,
        op3_quality_classifier,
        op4_nearest_neighbours,
        op5_license_scan,
        op6_decontamination,
        op7_language_id,
        op8_length_packing,
        op9_chat_format,
        op10_personal_data,
        op11_filter_interaction_audit,
        op12_source_divergence_audit,
        op13_quality_rules,
    )
}


def _decontamination_sql() -> str:
    """No masks: whatever few words of a stretch may differ, they leave a run of m equal ones somewhere in it, so alignments are those with such a run."""
    split = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    runs = lambda t, i: f"SELECT {i}, m, pos, w[pos + 1 : pos + m] AS run FROM (SELECT *, unnest(range(0, len(w) - m + 1)) AS pos FROM {t} WHERE len(w) >= m)"
    return f"""
WITH d AS (SELECT DISTINCT doc_id, {split} AS w FROM documents), b AS (SELECT item_id, {split} AS w FROM benchmark),
e AS (SELECT item_id, w, k, CAST(ceil(k * 0.8) AS INTEGER) AS equal FROM (SELECT *, least(12, len(w)) AS k FROM b) WHERE k > 0),
i AS (SELECT item_id, w, CAST(ceil(equal / (k - equal + 1)) AS INTEGER) AS m FROM e),
dm AS (SELECT doc_id, w, m FROM d, (SELECT DISTINCT m FROM i)),
ds AS ({runs("dm", "doc_id")}), bs AS ({runs("i", "item_id")}),
hits AS (SELECT DISTINCT doc_id, item_id, ds.pos - bs.pos AS shift FROM ds JOIN bs USING (m, run)),
pairs AS (SELECT h.doc_id, h.item_id, shift, d.w AS dw, b.w AS iw, greatest(0, -shift) AS f, least(len(b.w), len(d.w) - shift) AS l
  FROM hits h JOIN d USING (doc_id) JOIN b USING (item_id)),
same AS (SELECT doc_id, item_id, shift, f, len(iw) AS n, [CASE WHEN iw[i + 1] = dw[i + shift + 1] THEN 1 ELSE 0 END for i in range(f, l)] AS s FROM pairs),
best AS (SELECT *, least(12, n) AS k, list_max([list_sum(s[x + 1 : x + least(12, n)]) for x in range(0, len(s) - least(12, n) + 1)]) AS m FROM same),
kept AS (SELECT doc_id, item_id, n, list_sum(s) AS e, f + shift AS pos FROM best WHERE m * 100 >= k * 80)
SELECT doc_id, item_id, CAST(e AS BIGINT) AS n_equal, CAST(n AS BIGINT) AS n_item, CAST(pos AS BIGINT) AS first_word
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY e DESC, pos) AS r FROM kept) WHERE r = 1"""


def _packing_sql(buckets: int = 16, budget: int = 131072, shards: int = 1024) -> str:
    """The dynamic programme as one common table expression a bucket, and the way back through them."""
    steps, back = [], []
    for k in range(2, buckets + 1):
        steps.append(
            f"d{k} AS (SELECT j, x.cost AS cost, x.i AS i FROM (SELECT h.j, min(struct_pack(cost := p.cost + (h.c - q.c) * h.m - (h.s - q.s), i := p.j)) AS x "
            f"FROM d{k - 1} p JOIN cum q ON q.j = p.j JOIN cum h ON h.j > p.j GROUP BY h.j))"
        )
    for k in range(buckets, 1, -1):
        back.append(f"e{k - 1} AS (SELECT coalesce((SELECT d.i FROM d{k} d, e{k} WHERE d.j = e{k}.j AND {k} <= (SELECT least({buckets}, max(j)) FROM cum)), (SELECT j FROM e{k})) AS j)")
    ends = " UNION ".join(f"SELECT j FROM e{k}" for k in range(1, buckets + 1))
    return f"""
WITH r AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS n FROM documents),
hist AS (SELECT n AS m, count(*) AS c, sum(n) AS s FROM r GROUP BY 1),
cum AS (SELECT row_number() OVER o AS j, CAST(sum(c) OVER o AS BIGINT) AS c, CAST(sum(s) OVER o AS BIGINT) AS s, m FROM hist WINDOW o AS (ORDER BY m)),
d1 AS (SELECT j, c * m - s AS cost, CAST(NULL AS BIGINT) AS i FROM cum),
{", ".join(steps)},
e{buckets} AS (SELECT max(j) AS j FROM cum),
{", ".join(back)},
bounds AS (SELECT CAST(row_number() OVER (ORDER BY m) - 1 AS INTEGER) AS bucket, CAST(m AS BIGINT) AS bucket_len FROM cum WHERE j IN ({ends})),
placed AS (SELECT doc_id, n, bucket, bucket_len, row_number() OVER (PARTITION BY bucket ORDER BY (doc_id + doc_id // {shards}) % {shards}, doc_id, n) - 1 AS place,
  greatest(1, {budget} // bucket_len) AS per
  FROM (SELECT doc_id, n, (SELECT min(bucket_len) FROM bounds WHERE bucket_len >= n) AS bucket_len FROM r) JOIN bounds USING (bucket_len))
SELECT doc_id, n AS n_tokens, bucket, bucket_len, CAST(place // per AS BIGINT) AS batch, CAST(place % per AS BIGINT) AS slot FROM placed"""


def _chat_sql() -> str:
    esc = lambda c: "replace(replace(replace(replace(" + c + ", '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;')"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 1, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 2, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|' || {esc("role")} || '|>' || chr(10) || {esc("text")} || '<|end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _audit_sql() -> str:
    letters = "ABCDE"
    tables = ", ".join(f"l AS l{i}" for i in range(1, 6))
    different = " AND ".join(f"l{i}.c <> l{j}.c" for j in range(1, 6) for i in range(1, j))
    steps = " UNION ALL ".join(
        f"SELECT o, {i} AS step, 1 << (ascii(o[{i}]) - 65) AS f, {' + '.join(['0', *[f'(1 << (ascii(o[{j}]) - 65))' for j in range(1, i)]])} AS s FROM orders" for i in range(1, 6)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
label AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1),
masks AS (SELECT part, good, toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN label USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM masks GROUP BY ALL),
l AS (SELECT unnest(string_split('{" ".join(letters)}', ' ')) AS c),
orders AS (SELECT l1.c || l2.c || l3.c || l4.c || l5.c AS o FROM {tables} WHERE {different}),
steps AS ({steps}),
found AS (SELECT part, o AS filter_order, step, f, coalesce(sum(n) FILTER (mask & (s | f) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & s = 0 AND mask & f <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & s <> 0 AND mask & f <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = f), 0) AS unique_fails,
    coalesce(sum(g) FILTER (mask & s = 0 AND mask & f <> 0), 0) AS good_lost, coalesce(sum(t) FILTER (mask & s = 0 AND mask & f <> 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM found"""


def _divergence_sql() -> str:
    p = "1 + CAST(1000000000 AS HUGEINT) * ({0} + 2) // ({1} + 2 * v)"
    return rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS text, row_number() OVER () AS r FROM documents),
t AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '{source_audit.TERM}')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS m FROM kept GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n) FILTER (kept.term IS NOT NULL), 0) AS m FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, term, n FROM c) USING (lang, source)
  LEFT JOIN (SELECT lang, term FROM kept) AS kept USING (lang, term) GROUP BY ALL),
f AS (SELECT k.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p.format("coalesce(c.n, 0)", "g.m")} AS p, {p.format("k.n", "v.m")} AS q
  FROM kept k JOIN v USING (lang) JOIN g USING (lang) LEFT JOIN c ON c.lang = k.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM f a JOIN f b USING (lang, term) GROUP BY ALL),
best AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM f WHERE n > 0 AND p > q),
found AS (SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b USING (lang) LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  WHERE a.source <> b.source UNION ALL SELECT * FROM best)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 10"""


def _rules_sql(risk: float = 0.05, delta: float = 0.05, cost: int = 10) -> str:
    """Cutoffs one by one, each tested by the sum of binomial probabilities, where the operator counts levels of a ladder."""
    each = risk / len(rules.RULES)
    ladder = ", ".join(f"('{r}', {i}, {c})" for r, (_, _, _, cutoffs) in rules.RULES.items() for i, c in enumerate(cutoffs, 1))
    beyond = " ".join(f"WHEN '{r}' THEN 1000 * {top} {'>' if large else '<'} cutoff * {bottom}" for r, (top, bottom, large, _) in rules.RULES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM documents),
places AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS a FROM d),
three AS (SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM places WINDOW o AS (PARTITION BY r ORDER BY i)),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM three WHERE c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE times > 1) GROUP BY r),
m AS (SELECT r, doc_id, stratum, len(w) AS n_words, length(regexp_replace(text, '[ 	-
]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM d LEFT JOIN rep USING (r)),
label AS (SELECT doc_id, min(quality) = 1 AS is_good FROM labels WHERE quality IN (0, 1) GROUP BY 1 HAVING min(quality) = max(quality)),
hold AS (SELECT * FROM m JOIN label USING (doc_id) WHERE NOT base_failed),
size AS (SELECT stratum, count(*) FILTER (is_good) AS n FROM hold GROUP BY 1),
ladder(rule, step, cutoff) AS (VALUES {ladder}),
tried AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (is_good) AS good, count(*) FILTER (NOT is_good) AS bad FROM hold, ladder WHERE CASE rule {beyond} END GROUP BY ALL),
tested AS (SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({each}) + (n - j) * ln(1 - {each}))) FROM (SELECT unnest(range(0, good + 1)) AS j)) AS p
  FROM tried JOIN size USING (stratum) WHERE good <= {each} * n),
chosen AS (SELECT stratum, rule, cutoff FROM tested WHERE p <= {delta} / ({len(rules.RULES)} * (SELECT count(*) FROM size)) AND bad > {cost} * good
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad - {cost} * good DESC, step) = 1),
out AS (SELECT DISTINCT r FROM m JOIN chosen USING (stratum) WHERE CASE rule {beyond} END)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM out) AS kept FROM m"""


ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN text_words = 0 THEN [] WHEN text_words = 1 THEN [w[1]]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, text_words)]) END AS s
  FROM (SELECT doc_id, w, coalesce(len(w), 0) AS text_words FROM words)
), sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
posted AS (SELECT doc_id, n, unnest(s) AS x FROM sized),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM posted a JOIN posted b ON a.x = b.x AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM sized
  UNION
  SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.seen
), least_seen AS (SELECT node, min(seen) AS c FROM reach GROUP BY node)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CAST(c AS BIGINT) AS component_id, doc_id = c AS kept
FROM sized JOIN least_seen ON node = doc_id""",
    "op6_decontamination": _decontamination_sql(),
    "op8_length_packing": _packing_sql(),
    "op9_chat_format": _chat_sql(),
    "op11_filter_interaction_audit": _audit_sql(),
    "op12_source_divergence_audit": _divergence_sql(),
    "op13_quality_rules": _rules_sql(),
}
