"""Named queries: text functions, hashes, JSON, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .registry import query, table

#: A rule table in the shape of an intent cascade: the first pattern that a text matches names it.
INTENT_RULES = [(r"\?", "question"), (r"(?i)licen[sc]e|rights reserved", "legal"), (r"\d{3}", "numbers"), (r"!!", "shouting"), (r"\|", "list")]
UNITS = ["the", "und", "que", "les"]


@query(r"""SELECT doc_id, CASE WHEN length(x) > 80 THEN rtrim(substr(x, 1, 79)) || '…' ELSE x END AS short
FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS x FROM documents)""")
def short_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts cut to 80 characters with an ellipsis (PRJ2)."""
    return table(spark, sf, "documents").select("doc_id", T.short_text("text", 80).alias("short"))


@query(r"""SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^0-9a-z\x{4e00}-\x{9fff}]+', '', 'g') AS dataset_key, lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}\p{M}]+', '', 'g')) AS audit_key,
regexp_replace(lower(coalesce(text, '')), '[\s]+', '', 'g') AS space_key FROM documents""")
def normalised_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Three of the five normalisers side by side (STR-b, STR-c, STR-e)."""
    return table(spark, sf, "documents").select("doc_id", T.normal_dataset("text").alias("dataset_key"), T.normal_audit("text").alias("audit_key"), T.normal_space("text").alias("space_key"))


@query("""SELECT item_id, list_sort(list_distinct(list_transform(range(1, length(text)), lambda i: substr(text, i, 2)))) AS grams FROM benchmark""")
def char_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct character bigrams (STR-f)."""
    return table(spark, sf, "benchmark").select("item_id", F.sort_array(T.char_grams("text", 2)).alias("grams"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS INTEGER) AS n_words, regexp_extract_all(text, '\d+(?:\.\d+)?') AS numbers FROM documents""")
def extracted_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Words and all numbers of each text (STR-p)."""
    return table(spark, sf, "documents").select("doc_id", F.size(T.words("text")).alias("n_words"), T.numbers("text").alias("numbers"))


@query(r"""SELECT conv_id, turn, CAST(2 * c + floor((n - c) / 4) AS BIGINT) AS tokens FROM
(SELECT conv_id, turn, length(coalesce(text, '')) AS n, length(regexp_replace(coalesce(text, ''), '[^\x{4e00}-\x{9fff}]', '', 'g')) AS c FROM conversations)""")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Token estimates of turns (STR-q)."""
    return table(spark, sf, "conversations").select("conv_id", "turn", T.token_estimate("text").alias("tokens"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '\\?') THEN 'question' WHEN regexp_matches(text, '(?i)licen[sc]e|rights reserved') THEN 'legal' WHEN regexp_matches(text, '\\d{3}') THEN 'numbers'
WHEN regexp_matches(text, '!!') THEN 'shouting' WHEN regexp_matches(text, '\\|') THEN 'list' ELSE 'prose' END AS intent FROM documents""".replace("\\\\", "\\"))
def intent_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that matches names the text (CLS1)."""
    return table(spark, sf, "documents").select("doc_id", V.cascade(F.col("text"), INTENT_RULES, "prose").alias("intent"))


@query("""SELECT doc_id, list_filter([CASE WHEN n_chars < 200 THEN 'too_short' END, CASE WHEN n_chars > 10000 THEN 'too_long' END, CASE WHEN lang <> 'en' THEN 'not_english' END, CASE WHEN regexp_matches(text, '[#$%&]{3}') THEN 'symbols' END], lambda x: x IS NOT NULL) AS reasons FROM documents""")
def all_reasons_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Every violated rule of each document (FLT6, PIP20)."""
    reasons = {"too_short": F.col("n_chars") < 200, "too_long": F.col("n_chars") > 10000, "not_english": F.col("lang") != "en", "symbols": F.col("text").rlike("[#$%&]{3}")}
    return table(spark, sf, "documents").select("doc_id", V.all_reasons(reasons).alias("reasons"))


@query("""SELECT doc_id, CASE WHEN n_chars < 200 THEN 'too_short' WHEN lang <> 'en' THEN 'not_english' WHEN contains(lower(text), 'licen') THEN 'license' END AS reason FROM documents""")
def first_reason_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that each document fails (FLT5, FLT3)."""
    return table(spark, sf, "documents").select("doc_id", V.first_reason({"too_short": F.col("n_chars") < 200, "not_english": F.col("lang") != "en", "license": F.lower("text").contains("licen")}).alias("reason"))


@query("""SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE value > 50 AND event_type IN ('click', 'view') END AS holds FROM events""")
def tri_state_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """A conjunction that is unknown where a value is (FLT7)."""
    holds = V.all_hold([V.compare(F.col("value"), "gt", 50), V.compare(F.col("event_type"), "in", ["click", "view"])])
    return table(spark, sf, "events").select("event_id", F.when(F.col("value").isNull(), None).otherwise(holds).alias("holds"))


@query("""SELECT doc_id, CASE WHEN CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 17, 16)) AS UBIGINT) % 10 = 0 THEN 'eval' ELSE 'train' END AS split FROM documents""")
def hash_split_90_10(spark: SparkSession, sf: str) -> DataFrame:
    """A split by bytes 8 to 15 of the hash (HSH2)."""
    return table(spark, sf, "documents").select("doc_id", V.split_90_10(F.col("doc_id").cast("string")).alias("split"))


@query("""SELECT conv_id, CASE CAST(('0x' || substr(sha256(CAST(conv_id AS VARCHAR)), 1, 8)) AS UBIGINT) % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split FROM (SELECT DISTINCT conv_id FROM conversations)""")
def hash_split_80_10_10(spark: SparkSession, sf: str) -> DataFrame:
    """A split by the first eight digits of the hash (HSH3)."""
    return table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", V.split_80_10_10(F.col("conv_id").cast("string")).alias("split"))


@query("""SELECT doc_id, substr(sha256('{"lang":"' || lang || '","source":"' || source || '"}'), 1, 12) AS content_id FROM documents""")
def content_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids from the canonical JSON of stable fields (PRJ8, HSH1)."""
    return table(spark, sf, "documents").select("doc_id", V.content_id(lang=F.col("lang"), source=F.col("source")).alias("content_id"))


@query("""SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, CAST(len(json_keys(props)) AS INTEGER) AS n_keys FROM events""")
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of a JSON text and its first value (JSN1)."""
    keys = F.json_object_keys("props")
    return table(spark, sf, "events").select("event_id", F.element_at(F.from_json("props", "map<string,string>"), F.element_at(keys, 1)).alias("first_value"), F.size(keys).alias("n_keys"))


@query("""SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS n_keys FROM events""")
def json_repair(spark: SparkSession, sf: str) -> DataFrame:
    """JSON whose last brace was cut off, closed and parsed (JSN1)."""
    cut = F.col("props").substr(F.lit(1), F.length("props") - 1)
    return table(spark, sf, "events").select("event_id", F.size(F.map_keys(V.repaired_json(cut, "map<string,string>"))).alias("n_keys"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def html_strip_text(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text of pages by patterns (STR-y)."""
    return table(spark, sf, "pages").select("page_id", T.strip_markup("html").alias("text"))


@query()
def chunked_text(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as speech chunks of at most 80 characters (STR-r)."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.chunk_text("text", 80)).alias("chunk", "text"))


@query()
def packed_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences packed under a token budget (STR-s)."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.pack_segments("text", 120)).alias("segment", "text"))


@query(r"""SELECT doc_id, regexp_replace(source, '[^A-Za-z0-9_.:-]+', '_', 'g') AS source_id, translate(CAST(doc_id AS VARCHAR), '0123456789', 'abcdefghij') AS spelled, split_part(text, ' ', -1) AS last_word FROM documents""")
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Sanitised ids, spelled digits and what follows the last marker (STR-t, STR-y, STR-z)."""
    return table(spark, sf, "documents").select("doc_id", T.identifier("source").alias("source_id"), T.spell_digits(F.col("doc_id").cast("string"), "abcdefghij").alias("spelled"), T.after_last("text", " ").alias("last_word"))


@query("""SELECT event_id, '{"a":{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '},"deep":{"b":{"c":{"d":{"e":{"f":"…"}}}}},"items":[{"ok":' || event_id || '},"[image omitted]"]}' AS props FROM events""")
def redacted_props(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties beside secrets, an image and deep nesting: without the first two, and bounded (PRJ5, PRJ6)."""
    i = F.col("event_id").cast("string")
    body = F.concat(
        F.lit('{"api_key":"s'), i, F.lit('","a":'), F.col("props"), F.lit(',"items":[{"password":"p","ok":'), i, F.lit(',"my_secret_x":1},"data:image/png;base64,AAAA"],'),
        F.lit('"deep":{"b":{"c":{"d":{"e":{"f":{"g":1}}}}},"Authorization":{"t":2}}}'),
    )
    return table(spark, sf, "events").select("event_id", V.redacted(body).alias("props"))
