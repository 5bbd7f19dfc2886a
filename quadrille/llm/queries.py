"""The dealt operators as named queries, one each, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import (byte_bpe, chat, decontaminate, exact_dedup, licenses, line_dedup, periodic, quality_rules, repair, secrets,
                           simhash, token_counts, toxicity)
from quadrille.plans.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def named(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All of them, with the pipeline over them."""
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@named("op1_chat_format", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', '')))
         + len(regexp_extract_all(text, '</?s>|\[/?(?:INST|ROLE)[\] ]')) AS escaped,
         CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 16 + length(role) END AS marks
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(escaped + marks) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_rewrites
FROM sized GROUP BY conv_id
""")
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    turns = turns.unionByName(spark.createDataFrame(CONTROL_TURNS, turns.schema))
    template = chat.MarkedTurns()
    return chat.read_back(chat.format_turns(turns, template), template)


@named("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = byte_bpe.decode(byte_bpe.encode(docs, path), path)
    return decoded.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def _found_sql(kind: str, pattern: str, group: int, condition: str) -> str:
    """Matches with their places: the gaps before a match and the matches before it add up to its start."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, hits[i] AS hit, groups[i] AS part,
        list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(h) FOR h IN hits[1:i - 1]]), 0) AS s
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS hits,
        regexp_extract_all(text, '{p}', {group}) AS groups, string_split_regex(text, '{p}') AS gaps FROM d)) WHERE {condition}"""


def _tail_sql(z: str) -> str:
    return f"(1.0 / (1.0 + exp(1.5976 * {z} + 0.07056 * {z} * {z} * {z})))"


ALPHABETS_SQL = "CASE encoding " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in secrets.ALPHABETS.items()) + " END"
SIZES_SQL = "CASE encoding " + " ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in secrets.ALPHABETS.items()) + " END"
RANK_SQL = "CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END"


@named("op3_secret_scan", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT doc_id, kind, CAST(s AS BIGINT) AS s, CAST(s + length(hit) AS BIGINT) AS e FROM (
  {_found_sql('assign', secrets.ASSIGN, 2, 'length(part) >= 6')}
  UNION ALL {_found_sql('access', secrets.ACCESS, 0, 'TRUE')} UNION ALL {_found_sql('hex', secrets.HEX, 0, 'TRUE')})),
found AS (SELECT doc_id, CAST(s AS BIGINT) AS s, CAST(s + length(hit) AS BIGINT) AS e, hit,
    CASE WHEN regexp_full_match(lower(hit), '[0-9a-f]+') THEN 'hex' WHEN regexp_full_match(hit, '[A-Z2-7]+=*') THEN 'base32'
         WHEN regexp_full_match(hit, '[A-Za-z0-9]+') THEN 'alnum' ELSE 'base64' END AS encoding
  FROM ({_found_sql('random', secrets.CANDIDATE, 0, "regexp_matches(hits[i], '[0-9]') AND regexp_matches(hits[i], '[A-Za-z]')")}) f
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.s <= f.s AND f.s + length(f.hit) <= b.e)),
texts AS (SELECT *, CASE encoding WHEN 'hex' THEN lower(hit) ELSE translate(rtrim(hit, '='), '-_', '+/') END AS t, {SIZES_SQL} AS m FROM found),
chars AS (SELECT doc_id, s, e, encoding, m, length(t) AS n, i, strpos({ALPHABETS_SQL}, t[i]) - 1 AS v FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM texts)),
sums AS (SELECT doc_id, s, e, m, n, SUM(v) AS v, SUM(v * v) AS q, SUM(coalesce(before * v, 0)) AS w, COUNT_IF(2 * v >= m) AS above,
    COUNT_IF(before IS NOT NULL AND (2 * before >= m) <> (2 * v >= m)) AS changes, arg_min(v, i) AS a, arg_max(v, i) AS z
  FROM (SELECT *, lag(v) OVER (PARTITION BY doc_id, s ORDER BY i) AS before FROM chars) GROUP BY 1, 2, 3, 4, 5),
squares AS (SELECT doc_id, s, SUM(c * c) AS sq FROM (SELECT doc_id, s, v, COUNT(*) AS c FROM chars GROUP BY 1, 2, 3) GROUP BY 1, 2),
deviates AS (SELECT doc_id, s, e, n,
    (pow(greatest(CAST(m * sq AS DOUBLE) / n - n, 0.0) / (m - 1), CAST(1.0 AS DOUBLE) / 3) - (1 - CAST(2.0 AS DOUBLE) / (9 * (m - 1)))) / sqrt(CAST(2.0 AS DOUBLE) / (9 * (m - 1))) AS z1,
    CASE WHEN above = 0 OR above = n THEN sqrt(n) ELSE abs(changes - CAST(2 * above * (n - above) AS DOUBLE) / n)
      / sqrt(greatest(CAST(2 * above * (n - above) AS DOUBLE) * (2 * above * (n - above) - n) / (CAST(n AS DOUBLE) * n * (n - 1)), 1e-9)) END AS z2,
    CASE WHEN n * q = v * v THEN sqrt(n) ELSE abs((w - (CAST(v AS DOUBLE) / n) * (2 * v - a - z) + (n - 1) * (CAST(v AS DOUBLE) / n) * (CAST(v AS DOUBLE) / n))
      / (q - CAST(v AS DOUBLE) * v / n)) * sqrt(n) END AS z3
  FROM sums JOIN squares USING (doc_id, s)),
fisher AS (SELECT doc_id, s, e, n, -ln(greatest({_tail_sql('z1')}, 1e-30)) - ln(greatest(least(2 * {_tail_sql('z2')}, 1.0), 1e-30))
    - ln(greatest(least(2 * {_tail_sql('z3')}, 1.0), 1e-30)) AS l FROM deviates),
stepped AS (SELECT doc_id, s, e, length(bin(n)) AS class, CAST(least(400, floor(20 * -log10(greatest(exp(-l) * (1 + l + l * l / 2), 1e-30)) + 1e-9)) AS INT) AS step FROM fisher),
histogram AS (SELECT class, step, COUNT(*) AS n FROM stepped GROUP BY 1, 2),
limits AS (SELECT class, MIN(step) AS cut FROM (SELECT class, step, SUM(n) OVER (PARTITION BY class ORDER BY step DESC) AS beyond,
    SUM(n) OVER (PARTITION BY class) AS total FROM histogram) WHERE pow(10, -step / 20) <= 0.05 * beyond / total GROUP BY 1),
spans AS (SELECT * FROM base UNION ALL SELECT doc_id, 'random', s, e FROM stepped LEFT JOIN limits USING (class) WHERE cut IS NULL OR step < cut),
listed AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, {RANK_SQL}, e) AS spans,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, {RANK_SQL}, e) FILTER (kind <> 'random'), '') AS base,
    COUNT_IF(kind = 'assign') AS n_assign, COUNT_IF(kind = 'access') AS n_access, COUNT_IF(kind = 'hex') AS n_hex FROM spans GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (doc_id)
""")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


# Two lines at one edit share a half; a place is a document and a line in one number.
@named("op4_line_dedup", """
WITH RECURSIVE s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i - 1 AS line_no, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM s)),
u AS (SELECT line, length(line) AS n, MIN(doc_id * 10000000 + line_no) AS first, COUNT(*) AS c, row_number() OVER (ORDER BY line) AS id
      FROM l WHERE length(line) >= 20 GROUP BY line),
p AS (SELECT DISTINCT a.id AS x, b.id AS y FROM u a JOIN (SELECT *, n - k AS shorter FROM u, (VALUES (0), (1)) v(k)) b
      ON a.n = b.shorter AND left(a.line, a.n // 2) = left(b.line, a.n // 2) AND a.id <> b.id
      UNION SELECT DISTINCT a.id, b.id FROM u a JOIN (SELECT *, n - k AS shorter FROM u, (VALUES (0), (1)) v(k)) b
      ON a.n = b.shorter AND right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2) AND a.id <> b.id),
e AS (SELECT x, y FROM p JOIN u a ON a.id = x JOIN u b ON b.id = y
      WHERE len([k FOR k IN range(0, a.n + 1) IF left(a.line, k) = left(b.line, k) AND substr(a.line, k + CASE WHEN a.n = b.n THEN 2 ELSE 1 END) = substr(b.line, k + 2)]) > 0),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT x AS id, x AS other FROM both_ways UNION SELECT r.id, w.y FROM r JOIN both_ways w ON r.other = w.x),
g AS (SELECT r.id, MIN(u.first) AS first FROM r JOIN u ON u.id = r.other GROUP BY 1),
gone AS (SELECT l.doc_id, l.line_no FROM l JOIN u USING (line) LEFT JOIN g USING (id) WHERE l.doc_id * 10000000 + l.line_no <> coalesce(g.first, u.first)),
listed AS (SELECT doc_id, COUNT(*) AS n_repeats, string_agg(line_no, ',' ORDER BY line_no) AS repeats FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n_repeats, 0) AS n_repeats, coalesce(repeats, '') AS repeats FROM s LEFT JOIN listed USING (doc_id)
""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@named("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).select("row.doc_id", "score", "neighbours")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")


@named("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, public_tokenizers.path(TOKENIZER))
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"))


@named("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@named("op8_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha FROM documents
), g AS (
  SELECT sha, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY sha
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM d JOIN g USING (sha)
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@named("op9_decontaminate", r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i:i + least(10, len(w)) - 1] AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
hits AS (
  SELECT doc_id, i, p.n, win.item_id
  FROM (SELECT doc_id, n, i, w[i:i + n - 1] AS words
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)) p
  JOIN win ON win.n = p.n AND win.words = p.words
), words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


TEMPLATES_SQL = ", ".join("({}, '{}', '{}', [{}]::VARCHAR[])".format(i, name, body.replace("'", "''"), ", ".join(f"'{k}'" for k in licenses.key_phrases(body)))
                          for i, (name, body) in enumerate(licenses.TEMPLATES))
SHARE_SQL = "(CAST(0.8 AS DOUBLE) / (2 - CAST(0.8 AS DOUBLE)))"


@named("op10_license_scan", rf"""
WITH RECURSIVE t AS (SELECT template, license, string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS words,
             [string_split(trim(regexp_replace(lower(k), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') FOR k IN keys] AS keys
           FROM (VALUES {TEMPLATES_SQL}) v(template, license, body, keys)),
kb AS (SELECT DISTINCT template, unnest([k[i] || ' ' || k[i + 1] FOR i IN range(1, len(k))]) AS pair FROM (SELECT template, unnest(keys) AS k FROM t)),
tb AS (SELECT *, coalesce(SUM(times) FILTER (key) OVER (PARTITION BY template), 0) AS needed
       FROM (SELECT template, license, len(words) - 1 AS size, pair, COUNT(*) AS times, (template, pair) IN (SELECT (template, pair) FROM kb) AS key
             FROM (SELECT template, license, words, unnest([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS pair FROM t) GROUP BY ALL)),
b AS (SELECT doc_id, i - 1 AS place, words[i] || ' ' || words[i + 1] AS pair FROM (SELECT *, unnest(range(1, len(words))) AS i
      FROM (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+') AS words FROM documents))),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template, pair ORDER BY place) AS r FROM b JOIN tb USING (pair)
      QUALIFY COUNT(*) OVER (PARTITION BY doc_id, template) >= size * {SHARE_SQL} - 1e-9),
f AS (SELECT h.*, coalesce(p.place, -1) AS filled FROM h LEFT JOIN h p ON p.doc_id = h.doc_id AND p.template = h.template AND p.pair = h.pair AND p.r = h.r - h.times),
seg AS (SELECT a.doc_id, a.template, a.license, a.size, a.needed, a.place AS first, z.place AS last FROM f a JOIN f z ON z.doc_id = a.doc_id AND z.template = a.template
        AND z.place >= a.place AND z.place - a.place + 1 BETWEEN a.size * {SHARE_SQL} - 1e-9 AND a.size / {SHARE_SQL} + 1e-9),
scored AS (SELECT s.doc_id, s.template, s.license, first, last, round(CAST(2 * COUNT(*) AS DOUBLE) / (last - first + 1 + s.size), 12) AS dice
           FROM seg s JOIN f c ON c.doc_id = s.doc_id AND c.template = s.template AND c.place BETWEEN first AND last AND c.filled < first
           GROUP BY s.doc_id, s.template, s.license, s.size, s.needed, first, last HAVING COUNT_IF(c.key) >= s.needed),
ends AS (SELECT doc_id, template, license, first, last + 1 AS last, dice FROM scored WHERE dice >= 0.8 - 1e-9
         QUALIFY row_number() OVER (PARTITION BY doc_id, template, first ORDER BY dice DESC, last) = 1),
picked AS (
  SELECT doc_id, CASE WHEN len(rest) < 0 THEN rest[1] END AS got, rest FROM (SELECT doc_id, list({{'template': template, 'license': license, 'first': first, 'last': last, 'dice': dice}}
                                   ORDER BY dice DESC, last - first DESC, first, template) AS rest FROM ends GROUP BY doc_id)
  UNION ALL
  SELECT doc_id, rest[1], list_filter(rest, lambda x: x.first > rest[1].last OR x.last < rest[1].first) FROM picked WHERE len(rest) > 0)
SELECT doc_id, got.license AS license, got.template AS template, round(got.dice, 6) AS dice, CAST(got.first AS BIGINT) AS first_word,
       CAST(got.last AS BIGINT) AS last_word
FROM picked WHERE got IS NOT NULL
""")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.license_matches(table(spark, sf_dir, "documents").select("doc_id", "text")))


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SHARE_OF = "CASE WHEN {1} > 0 THEN least(1000, 1000 * {0} // ({1})) ELSE 0 END"
RULES_SQL = ", ".join(f"'{s}'" for s in quality_rules.SIGNALS)


@named("op11_quality_rules", rf"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
grams AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
often AS (SELECT doc_id, i FROM grams QUALIFY COUNT(*) OVER (PARTITION BY doc_id, g) > 1),
again AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM often, range(3) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, COUNT(*) AS n, COUNT(*) - COUNT(DISTINCT line) AS copied
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, stratum, len(w) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(copied, 0) AS n_dup_lines,
             coalesce(again.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z!]', '', 'g')) AS shouts
      FROM d LEFT JOIN again USING (doc_id) LEFT JOIN lines USING (doc_id)),
s AS (SELECT *, {SHARE_OF.format('n_symbols', 'n_words')} AS symbols, {SHARE_OF.format('n_repeat_words', 'n_words')} AS repeated,
             {SHARE_OF.format('n_dup_lines', 'n_lines')} AS copied_lines, {SHARE_OF.format('shouts', 'word_chars')} AS shouting,
             {SHARE_OF.format('word_chars', '50 * n_words')} AS long_words,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
long AS (UNPIVOT (SELECT doc_id, stratum, {', '.join(f'CAST({x} AS BIGINT) AS {x}' for x in quality_rules.SIGNALS)} FROM s) ON {', '.join(quality_rules.SIGNALS)} INTO NAME rule VALUE value),
lab AS (SELECT doc_id, MIN(quality) = 1 AS good, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '5' AS fit FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
counts AS (SELECT stratum, rule, value, COUNT_IF(good) AS good, COUNT_IF(NOT good) AS bad FROM long JOIN lab USING (doc_id) WHERE fit GROUP BY ALL),
reached AS (SELECT stratum, rule, value, SUM(good) OVER a AS good, SUM(bad) OVER a AS bad, SUM(good) OVER r AS all_good, SUM(bad) OVER r AS all_bad,
              coalesce(lead(value) OVER a + 1, 0) AS cut FROM counts
            WINDOW a AS (PARTITION BY stratum, rule ORDER BY value DESC), r AS (PARTITION BY stratum, rule)),
cuts AS (SELECT stratum, rule, step, coalesce(MIN(cut) FILTER (good * 1000 <= step * all_good), MAX(value) + 1) AS cut,
           coalesce(MAX(good) FILTER (good * 1000 <= step * all_good), 0) AS good, coalesce(MAX(bad) FILTER (good * 1000 <= step * all_good), 0) AS bad,
           MAX(all_good) AS all_good, MAX(all_bad) AS all_bad FROM reached, range({quality_rules.STEPS + 1}) t(step) GROUP BY 1, 2, 3),
useful AS (SELECT stratum, rule FROM cuts WHERE step = {quality_rules.STEPS} AND bad * all_good > good * all_bad),
steps AS (SELECT doc_id, stratum, MIN(step) AS step FROM (SELECT doc_id, l.stratum, l.rule, COUNT(*) FILTER (u.rule IS NULL OR cut > value) AS step
          FROM long l JOIN cuts USING (stratum, rule) LEFT JOIN useful u ON u.stratum = l.stratum AND u.rule = l.rule GROUP BY 1, 2, 3) GROUP BY 1, 2),
held AS (SELECT stratum, step FROM steps JOIN lab USING (doc_id) WHERE NOT fit AND good),
lost AS (SELECT stratum, t.step, (SELECT COUNT(*) FROM held h WHERE h.stratum = p.stratum AND h.step <= t.step) AS k, p.n, COUNT(DISTINCT stratum) OVER () AS strata
         FROM (SELECT stratum, COUNT(*) AS n FROM held GROUP BY 1) p, range({quality_rules.STEPS + 1}) t(step)),
chosen AS (SELECT stratum, coalesce(MIN(step) FILTER (list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - CASE WHEN j = n THEN 0 ELSE lgamma(n - j + 1) END
             + j * ln(CAST({quality_rules.LIMIT} AS DOUBLE)) + (n - j) * ln(CAST({1 - quality_rules.LIMIT} AS DOUBLE))) FOR j IN range(0, k + 1)]) > {quality_rules.RISK} / strata),
             {quality_rules.STEPS + 1}) - 1 AS chosen FROM lost GROUP BY 1)
SELECT s.doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND coalesce(step, 99) > coalesce(chosen, -1) AS kept
FROM s LEFT JOIN steps USING (doc_id) LEFT JOIN chosen ON chosen.stratum = s.stratum
""")
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality_rules.verdicts(docs, table(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def with_periods(docs: DataFrame) -> DataFrame:
    """Texts of one id in ten (by crc32) end in a repeated stretch, as the query's contract says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10).cast("long"), F.size("words").cast("long")
    a = F.col("g") % F.col("n")
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long")
    some = docs.filter(h % 10 == 0).select("doc_id", "text", words.alias("words"), g.alias("g")).withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, a))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int")))
    changed = some.withColumn("p", p).select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))
    return changed.unionByName(docs.filter(F.coalesce(h % 10 != 0, F.lit(True))).select("doc_id", "text"))


# CRC-32 of ASCII text, from its table.
CRC_SQL = """bytes AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bytes WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bytes WHERE k = 8)"""


def _crc_sql(text: str) -> str:
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(({text})[j]) AS BIGINT) FOR j IN range(1, length({text}) + 1)]), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


# Equal stretches of four words, d apart, side by side.
@named("op12_periodic_runs", rf"""
WITH RECURSIVE {CRC_SQL},
h AS (SELECT doc_id, {WORDS_SQL} AS w, {_crc_sql('CAST(doc_id AS VARCHAR)')} AS h FROM documents, crc),
a AS (SELECT *, (h // 10) % len(w) AS a, h // 10 AS g FROM h),
d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) END] FOR i IN range(0, len(w))] ELSE w END AS w FROM a),
grams AS (SELECT doc_id, i, w[i + 1:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 3)) AS i FROM d)),
shared AS (SELECT * FROM grams QUALIFY COUNT(*) OVER (PARTITION BY doc_id, g) > 1),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS d FROM shared x JOIN shared y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i),
islands AS (SELECT doc_id, d, MIN(i) AS s, MAX(i) + 4 + d AS e
            FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS island FROM pairs) GROUP BY doc_id, d, island),
runs AS (SELECT doc_id, s, e, MIN(d) AS q FROM islands WHERE e - s >= greatest(12, 2 * d) GROUP BY doc_id, s, e),
listed AS (SELECT doc_id, COUNT(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS text,
                  arg_min(struct_pack(s := s, e := e, q := q), (s - e, s, q)) AS top FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM runs),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.e - top.s AS length, top.q AS period,
       CAST(1000 * (top.e - top.s) // top.q AS BIGINT) AS exponent_milli, sha256(coalesce(listed.text, '')) AS runs_sha256,
       sha256(coalesce(left_over.text, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN left_over USING (doc_id)
""")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    # Greatest length, then smallest start, then period.
    longest = F.get(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("b"), r["period"].alias("c")))), F.lit(0))
    return found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"),
                        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("top.b").alias("start"), (-F.col("top.a")).alias("length"), F.col("top.c").alias("period"),
        F.floor(-1000 * F.col("top.a") / F.col("top.c")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


# States of the grammar: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
# One insertion at most can help before a turn, two at the end.
@named("op13_structure_repair", rf"""
WITH RECURSIVE {CRC_SQL},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
        CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE k <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i FROM damaged),
f AS (SELECT *, left(role, 1) AS initial, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM n),
r AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN again THEN 2 WHEN NOT contains('.!?', last) THEN 3 ELSE 0 END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM f),
keep(q, initial, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
moves(q, pre, m, z) AS (SELECT q, '', 0, q FROM range(4) t(q) UNION ALL SELECT q, 'I', 2, CASE q WHEN 2 THEN 3 ELSE 2 END FROM range(4) t(q)),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS cost, '' AS audit FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT conv_id, i, z, cost, audit FROM (
    SELECT dp.conv_id, r.i, CASE e.e WHEN 'D' THEN moves.z WHEN 'R' THEN CASE moves.z WHEN 2 THEN 3 ELSE 2 END ELSE keep.z END AS z,
           dp.cost + m + CASE e.e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN fault = 3 AND e.e <> 'D' THEN 1 ELSE 0 END AS cost, audit || pre || e.e AS audit
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN moves ON moves.q = dp.q
      CROSS JOIN (VALUES ('D'), ('K'), ('R')) e(e) LEFT JOIN keep ON keep.q = moves.z AND keep.initial = r.initial
    WHERE e.e = 'D' OR fault IN (0, 3) AND (e.e = 'R' OR keep.z IS NOT NULL))
  QUALIFY row_number() OVER (PARTITION BY conv_id, z ORDER BY cost, audit) = 1),
best AS (SELECT conv_id, cost, audit FROM (
    SELECT dp.conv_id, cost + CASE q WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost, audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit
    FROM dp JOIN (SELECT conv_id, MAX(i) AS n FROM r GROUP BY 1) z ON z.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = z.n)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
edits AS (SELECT conv_id, k, e, COUNT(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i
          FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS k, unnest(string_split(audit, '')) AS e FROM best)),
outs AS (SELECT edits.conv_id, k, e, role, text, initial, row_number() OVER w AS place,
           first_value(e = 'K' AND initial = 's') OVER w AS headed
         FROM edits JOIN r ON r.conv_id IS NOT DISTINCT FROM edits.conv_id AND r.i = greatest(edits.i, 1) WHERE e <> 'D' WINDOW w AS (PARTITION BY edits.conv_id ORDER BY k)),
texts AS (SELECT conv_id, string_agg(CASE e WHEN 'K' THEN role ELSE CASE WHEN (place + CAST(headed AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END END
            || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS text FROM outs GROUP BY 1),
counts AS (SELECT conv_id, coalesce(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT_IF(fault = 1) AS blank, COUNT_IF(fault = 2) AS duplicate,
             COUNT_IF(fault = 3) AS truncated, COUNT_IF(i > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(texts.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM o.conv_id
""")
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = repair.damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return repair.report(turns, repair.audits(turns))
