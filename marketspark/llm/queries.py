"""Registered queries of the text operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm import (
    byte_bpe, decontamination, html_extract, language_id, line_dedup, merkle, pii, quality_model, quality_rules, secret_scan, simhash, spelling, warc,
)
from marketspark.llm.text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def decorate(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return decorate


def _sql_words(text: str) -> str:
    """DuckDB list of the words of ``text`` with A-Z lowered."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"list_filter(string_split_regex(translate({text}, '{upper}', '{upper.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _sql_lower(text: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"translate({text}, '{upper}', '{upper.lower()}')"


def _sql_shingles(words: str, width: int) -> str:
    return (
        f"CASE WHEN len({words}) >= {width} THEN list_distinct(list_transform(range(1, len({words}) - {width} + 2),"
        f" lambda i: array_to_string({words}[i:i + {width - 1}], ' '))) WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"
    )


def _base32(hex_digits: str) -> str:
    """Upper-case base32 of 40 hex digits in DuckDB: every five digits are four symbols."""
    five = f"CAST('0x' || substr({hex_digits}, 5 * g + 1, 5) AS INTEGER)"
    symbols = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({five} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(0, 8), lambda g: {symbols}), '')"


@query("op1_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM d)
SELECT page_id, payload_bytes, {_base32('h')} AS payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM m
""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files and read back."""
    return warc.archived(table(spark, sf_dir, "pages"))


def _quality_sql() -> str:
    """The counts, sketches and fences of ``quality_rules`` in DuckDB, written over unnested words."""
    r = quality_rules
    rates = {
        "symbols": "1000 * n_symbols // greatest(n_words, 1)", "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
        "repeats": "1000 * n_repeat_words // greatest(n_words, 1)", "word_length": "1000 * word_chars // greatest(n_words, 1)",
        "capitals": "1000 * n_capitals // greatest(word_chars, 1)",
    }
    entries = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rate, {v} AS value FROM c WHERE NOT base_failed" for k, v in rates.items())
    spread = "CASE rate " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in r.SPREADS.items()) + " END"
    tests = " AND ".join([f"{v} <= max(high) FILTER (rate = '{k}')" for k, v in rates.items()] + [f"{rates[k]} >= max(low) FILTER (rate = '{k}')" for k in r.LOW_SIDE])

    def level(name: str, keys: str) -> str:
        at = f"{keys}, " if keys else ""
        return f"""
{name}_b AS (SELECT {at}rate, bucket, sum(n) AS n FROM sketch GROUP BY {at}rate, bucket),
{name}_c AS (SELECT {at}rate, bucket, sum(n) OVER (PARTITION BY {at}rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {at}rate) AS rows FROM {name}_b),
{name}_q AS (SELECT {at}rate, max(rows) AS rows, min(bucket) FILTER (4 * upto >= rows) AS q1, min(bucket) FILTER (4 * upto >= 3 * rows) AS q3 FROM {name}_c GROUP BY {at}rate),
{name} AS (SELECT *, q1 - {r.REACH} * greatest(q3 - q1, {spread}) AS low, q3 + {r.REACH} * greatest(q3 - q1, {spread}) AS high FROM {name}_q)"""

    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(string_split_regex(text, '[ 	-
]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM t),
g AS (SELECT r, p, w[p] || chr(10) || w[p + 1] || chr(10) || w[p + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM w)),
x AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS k FROM g) WHERE k > 1) GROUP BY r),
s AS (SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[ 	-
]+', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(x.n, 0) AS n_repeat_words,
  len(l) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals FROM t JOIN w USING (r) LEFT JOIN x USING (r)),
c AS (SELECT *, n_words < {r.MIN_WORDS} OR 100 * n_repeat_words > {r.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s),
e AS ({entries}),
sketch AS (SELECT lang, source, rate, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS bucket, count(*) AS n FROM e GROUP BY ALL),
{level('by_source', 'lang, source')},{level('by_lang', 'lang')},{level('overall', '')},
f AS (SELECT a.lang, a.source, a.rate, CASE WHEN a.rows >= {r.MIN_ROWS} THEN a.low WHEN b.rows >= {r.MIN_ROWS} THEN b.low ELSE o.low END AS low,
  CASE WHEN a.rows >= {r.MIN_ROWS} THEN a.high WHEN b.rows >= {r.MIN_ROWS} THEN b.high ELSE o.high END AS high
  FROM by_source a JOIN by_lang b ON a.lang IS NOT DISTINCT FROM b.lang AND a.rate = b.rate JOIN overall o ON o.rate = a.rate)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({tests}, false) AS kept
FROM c LEFT JOIN f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source
GROUP BY c.r, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed
"""


@query("op2_quality_rules", _quality_sql())
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether it is kept."""
    found = quality_rules.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words('text')} AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {_sql_words('text')} AS w FROM benchmark),
ds AS (SELECT r, doc_id, unnest({_sql_shingles('w', 5)}) AS s FROM d),
bs AS (SELECT q, item_id, unnest({_sql_shingles('w', 5)}) AS s FROM b),
n AS (SELECT q, count(*) AS n_item FROM bs GROUP BY q)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, CAST(count(*) AS DOUBLE) / n_item AS containment
FROM ds JOIN bs USING (s) JOIN n USING (q) GROUP BY r, q, doc_id, item_id, n_item HAVING CAST(count(*) AS DOUBLE) / n_item >= 0.8
""")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a benchmark item's five-word shingles."""
    found = decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), "item_id", "n_item", "n_shared", "containment")


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op5_quality_model")
def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_html_extract")
def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id.predictions(table(spark, sf_dir, "documents"))


@query("op8_pii_surrogates")
def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data. The key of this query is public; real runs pass their own."""
    return pii.replace_personal_data(table(spark, sf_dir, "documents"), key="public example key")


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text decoded from them, as digests."""
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), *byte_bpe.default_table())


@query("op11_line_dedup", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS p FROM d),
k AS (SELECT *, {_sql_lower("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM u),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY r, doc_id
""")
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more documents hold."""
    kept = line_dedup.without_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: CRC-32 of a list of bytes in DuckDB, by the table of the 256 remainders.
_CRC_TABLE = "(SELECT list(list_reduce([i] || range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) AS x(i))"


def _sql_crc(text: str) -> str:
    """CRC-32 of ASCII text and letters up to U+00FF; ``crc.t`` is the table."""
    bytes_ = f"flatten(list_transform(string_split({text}, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)] ELSE [195, unicode(s) - 64] END))"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || CAST({bytes_} AS BIGINT[]), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def _manifest_sql() -> str:
    """The levels by a recursive grouping, the climb by a recursive join, first within the sources and then above them."""

    def field(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    def levels(name: str, start: str) -> str:
        return f"""
{name} AS ({start} UNION ALL
  SELECT key, l + 1, p // 16, max((n + 15) // 16), sha256(string_agg(h, '' ORDER BY p)) FROM {name} WHERE n > 1 GROUP BY key, l, p // 16),
{name}_run AS (SELECT key, l, p // 16 AS q, list(h ORDER BY p) AS hs FROM {name} WHERE n > 1 GROUP BY key, l, p // 16)"""

    def climb(name: str, start: str, runs: str) -> str:
        here = "CAST(p % 16 AS BIGINT)"
        return f"""
{name} AS ({start} UNION ALL
  SELECT r, c.key, c.l + 1, p // 16, sha256(array_to_string(hs[:{here}] || [folded] || hs[{here} + 2:], '')), proof || array_to_string(hs[:{here}] || hs[{here} + 2:], '')
  FROM {name} c JOIN {runs} x ON x.key = c.key AND x.l = c.l AND x.q = p // 16)"""

    return f"""
WITH RECURSIVE crc AS {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS key, {leaf('text')} AS leaf, {leaf(_sql_lower('text'))} AS other,
  coalesce({_sql_crc('CAST(doc_id AS VARCHAR)')} % 5 = 0, false) AS changed FROM documents, crc),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY key) AS n FROM d),
{levels('low', 'SELECT key, 0 AS l, p, n, leaf AS h FROM o')},
s AS (SELECT key, h, row_number() OVER (ORDER BY key COLLATE "C") - 1 AS p, count(*) OVER () AS n FROM low WHERE n = 1),
{levels('high', "SELECT '' AS key, 0 AS l, p, n, h FROM s")},
{climb('up', "SELECT r, key, 0 AS l, p, CASE WHEN changed THEN other ELSE leaf END AS folded, '' AS proof FROM o", 'low_run')},
sub AS (SELECT r, up.key, folded, proof FROM up JOIN (SELECT r, max(l) AS l FROM up GROUP BY r) USING (r, l)),
{climb('over', "SELECT r, '' AS key, 0 AS l, s.p, folded, proof FROM sub JOIN s ON s.key = sub.key", 'high_run')},
fin AS (SELECT r, folded, proof FROM over JOIN (SELECT r, max(l) AS l FROM over GROUP BY r) USING (r, l))
SELECT doc_id, leaf, s.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = top.h AS verified
FROM o JOIN fin USING (r) JOIN s ON s.key = o.key, (SELECT h FROM high WHERE n = 1) AS top
"""


@query("op12_merkle_manifest", _manifest_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's way to the root of the manifest, one in five of them altered on the way."""
    docs = table(spark, sf_dir, "documents")
    found = merkle.verify(merkle.build_manifest(docs, changed=merkle.tampered_case(docs)))
    return found.withColumnRenamed("id", "doc_id")


@query("op13_spelling_variants", f"""
WITH RECURSIVE crc AS {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_sql_lower('text')}, '[a-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT r, id, run, count(*) AS n FROM d WHERE length(run) >= 6 GROUP BY r, id, run),
h AS (SELECT run, n, {_sql_crc("id || ':' || run")} AS h FROM g, crc),
f AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM f WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
c AS (SELECT word, unnest(list_transform(range(length(word)), lambda i: substr(word, 1, i) || '_' || substr(word, i + 2))) AS hole FROM w),
l AS (SELECT DISTINCT word, replace(hole, '_', '') AS less FROM c),
pairs AS (SELECT a.word, b.word AS near FROM c a JOIN c b USING (hole) WHERE a.word <> b.word
  UNION SELECT l.word, w.word FROM l JOIN w ON w.word = l.less UNION SELECT w.word, l.word FROM l JOIN w ON w.word = l.less),
best AS (SELECT p.word, count(*) AS n_near, max(b.n) AS top FROM pairs p JOIN w b ON b.word = p.near GROUP BY p.word),
form AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN top END AS form_n,
  CASE WHEN top >= 5 * w.n THEN (SELECT min(p.near COLLATE "C") FROM pairs p JOIN w b ON b.word = p.near WHERE p.word = w.word AND b.n = top) END AS form
  FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.at WHERE form.form IS NOT NULL)
SELECT form.word, form.n, form.n_near, form.form, form.form_n, walk.at AS root
FROM form JOIN walk USING (word) JOIN form AS z ON z.word = walk.at WHERE z.form IS NULL
""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the corpus with their near words and the form that they are probably variants of."""
    return spelling.variant_groups(table(spark, sf_dir, "documents"))
