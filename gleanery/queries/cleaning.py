"""Text cleaning, masking, redaction, de-duplication and integrity (B1, B28-B31, F5, A10)."""

from pyspark.sql import functions as F

from gleanery.functions import text as tx
from gleanery.operators import catalog, integrity
from gleanery.plans import journeys
from gleanery.queries import query
from gleanery.queries.views import table, wide_table

_WS = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"


def clean_sql(column: str, strict: bool = False) -> str:
    out = f"regexp_replace({column}, '&[a-zA-Z]+;', ' ', 'g')"
    if not strict:
        out = rf"regexp_replace({out}, '[\t-\r\x1C-\x1F\x{{85}}]+', ' ', 'g')"
    out = rf"regexp_replace({out}, '\p{{C}}+', '', 'g')"
    out = rf"regexp_replace({out}, '[ \p{{Z}}]+', ' ', 'g')"
    return rf"trim(regexp_replace({out}, '[^\x00-\x7F]+', '', 'g'))"


def mask_sql(column: str) -> str:
    for name in ("password", "token", "key", "secret"):
        pattern = rf"""{name}["'']?[{_WS}]*[:=][{_WS}]*["'']?[^"''{_WS}]+["'']?"""
        column = f"regexp_replace({column}, '{pattern}', '{name}=***MASKED***', 'gi')"
    return column


@query(
    "a00_clean_by_source",
    f"""WITH checked AS (
          SELECT source, text,
                 trim(text) = '' OR length(text) > 10000
                 OR (length(text) - length(translate(text, '?#@$', ''))) / length(text) > 0.1 AS rejected
          FROM documents),
        texts AS (
          SELECT source, {clean_sql('text')} AS clean, count(*) AS copies FROM checked WHERE NOT rejected GROUP BY ALL),
        kept AS (
          SELECT source, count(*) AS documents, sum(copies - 1) AS duplicates, round(avg(length(clean)), 6) AS mean_chars
          FROM texts GROUP BY source),
        bad AS (SELECT source, count(*) FILTER (WHERE rejected) AS rejected FROM checked GROUP BY source)
        SELECT source, coalesce(documents, 0) AS documents, CAST(coalesce(duplicates, 0) AS BIGINT) AS duplicates,
               mean_chars, rejected
        FROM bad LEFT JOIN kept USING (source)""",
)
def clean_by_source(spark, sf):
    return journeys.clean_by_source(wide_table(spark, sf, "documents"))


@query("b01_clean_text", f"SELECT doc_id, {clean_sql('text')} AS clean FROM documents")
def clean_text(spark, sf):
    return wide_table(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


@query("b01_clean_text_strict", f"SELECT doc_id, {clean_sql('text', True)} AS clean FROM documents")
def clean_text_strict(spark, sf):
    return wide_table(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text"), strict=True).alias("clean"))


@query("b28_mask_text", f"SELECT doc_id, {mask_sql('text')} AS masked FROM documents")
def mask_text(spark, sf):
    return wide_table(spark, sf, "documents").select("doc_id", tx.mask_text(F.col("text")).alias("masked"))


@query(
    "b29_mask_map",
    f"""SELECT doc_id, '***MASKED***' AS api_key, {mask_sql('text')} AS body, source, '***MASKED***' AS inner_secret,
               lang AS inner_lang
        FROM documents""",
)
def mask_map(spark, sf):
    from pyspark.sql import types as T

    text_map = F.create_map(F.lit("API_Key"), F.col("source"), F.lit("body"), F.col("text"), F.lit("source"), F.col("source"))
    inner = F.create_map(F.lit("inner"), F.create_map(F.lit("clientSecret"), F.col("lang"), F.lit("lang"), F.col("lang")))
    nested = T.MapType(T.StringType(), T.StringType())
    return (
        wide_table(spark, sf, "documents")
        .select("doc_id", tx.mask_map(text_map).alias("m"), tx.mask_map(inner, nested).alias("n"))
        .select(
            "doc_id",
            F.col("m")["API_Key"].alias("api_key"),
            F.col("m")["body"].alias("body"),
            F.col("m")["source"].alias("source"),
            F.col("n")["inner"]["clientSecret"].alias("inner_secret"),
            F.col("n")["inner"]["lang"].alias("inner_lang"),
        )
    )


@query("b30_mask_fields", "SELECT doc_id, '***MASKED_source***' AS source, '***MASKED_lang***' AS lang, n_chars FROM documents")
def mask_fields(spark, sf):
    docs = wide_table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return catalog.mask_fields(docs, ["source", "lang", "n_chars"])


@query(
    "b31_encrypt_cols",
    """SELECT doc_id, source, text, CAST(octet_length(encode(text)) + 28 AS INTEGER) AS sealed_bytes, true AS wrong_key_fails
       FROM documents""",
)
def encrypt_cols(spark, sf):
    key, wrong = F.lit(b"0123456789abcdef0123456789abcdef"), F.lit(b"x123456789abcdef0123456789abcdef")
    docs = wide_table(spark, sf, "documents").select("doc_id", "source", "text")
    sealed = catalog.encrypt_cols(docs, ["source", "text"], key).withColumn("sealed_bytes", F.octet_length("text"))
    guess = F.try_aes_decrypt(F.col("text"), wrong, F.lit("GCM")).isNull()
    return catalog.decrypt_cols(sealed.withColumn("wrong_key_fails", guess), ["source", "text"], key)


@query(
    "b31_encrypt_sensitive",
    "SELECT s_suppkey AS id, s_name AS api_key, 'user' || s_nationkey AS login, true AS hidden FROM supplier",
)
def encrypt_sensitive(spark, sf):
    key = F.lit(b"0123456789abcdef0123456789abcdef")
    creds = F.create_map(F.lit("api_key"), F.col("s_name"), F.lit("login"), F.concat(F.lit("user"), F.col("s_nationkey").cast("string")))
    sources = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", creds.alias("credentials"))
    sealed = catalog.encrypt_sensitive(sources, "credentials", key)
    hidden = sealed.withColumn("hidden", F.col("credentials")["api_key"] != F.col("s_name"))
    plain = catalog.decrypt_sensitive(hidden, "credentials", key)
    return plain.select("id", F.col("credentials")["api_key"].alias("api_key"), F.col("credentials")["login"].alias("login"), "hidden")


@query(
    "b29_mask_value",
    f"""SELECT doc_id, '***MASKED***' AS token, '***MASKED***' AS keys, n_chars AS size, {mask_sql('text')} AS note, lang AS plain,
               '***MASKED***' AS inner_secret, CAST(n_chars AS VARCHAR) AS counted FROM documents""",
)
def mask_value(spark, sf):
    """A number, an array and an object under secret names, and texts in an array."""
    entry = F.struct(
        F.col("n_chars").alias("Auth_Token"),
        F.array("source").alias("keys"),
        F.struct(F.col("n_chars").alias("size"), F.array(F.col("text"), F.col("lang")).alias("notes")).alias("body"),
        F.array(F.create_map(F.lit("clientSecret"), F.struct("lang"), F.lit("n"), F.struct(F.col("n_chars").cast("string").alias("lang")))).alias("list"),
    )
    masked = wide_table(spark, sf, "documents").select("doc_id", tx.mask_value(entry).alias("m"))
    pick = {"token": "$.Auth_Token", "keys": "$.keys", "note": "$.body.notes[0]", "plain": "$.body.notes[1]", "inner_secret": "$.list[0].clientSecret", "counted": "$.list[0].n.lang"}
    texts = [F.variant_get("m", path, "string").alias(name) for name, path in pick.items()]
    return masked.select("doc_id", F.variant_get("m", "$.body.size", "long").alias("size"), *texts)


# The documents hold e-mail addresses, phone numbers with brackets, IPv4 addresses and plain card numbers.
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|0?[0-9]?[0-9])"
_DIGIT = "CAST(substr(cards[i], len(cards[i]) - k, 1) AS INTEGER)"


@query(
    "b36_redact_pii",
    rf"""WITH t AS (
          SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
            '[A-Za-z0-9._%+-]{{1,64}}@[A-Za-z0-9.-]{{1,255}}\.[A-Za-z]{{2,24}}', '[EMAIL]', 'g'),
            '\+([2-9][0-9]{{0,2}}|1[0-9]{{1,2}}) ?\([0-9]{{3}}\) ?[0-9]{{3}}-[0-9]{{4}}', '[PHONE]', 'g'),
            '(\+1 ?)?\([2-9][0-9]{{2}}\) ?[2-9][0-9]{{2}}-[0-9]{{4}}', '[PHONE]', 'g'),
            '({_OCTET}\.){{3}}{_OCTET}', '[IP]', 'g') AS text FROM documents),
        c AS (SELECT doc_id, regexp_split_to_array(text, '[0-9]{{13,19}}') AS parts, regexp_extract_all(text, '[0-9]{{13,19}}') AS cards FROM t)
        SELECT doc_id, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(
          CASE WHEN list_sum(list_transform(range(0, len(cards[i])), lambda k:
            CASE WHEN k % 2 = 0 THEN {_DIGIT} WHEN {_DIGIT} > 4 THEN 2 * {_DIGIT} - 9 ELSE 2 * {_DIGIT} END)) % 10 = 0 THEN '[CARD]' ELSE cards[i] END, '')), '') AS redacted
        FROM c""",
)
def redact_pii(spark, sf):
    return wide_table(spark, sf, "documents").select("doc_id", tx.redact_pii(F.col("text")).alias("redacted"))


@query(
    "b37_word_and_noise_counts",
    rf"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{_WS}]+')) AS INTEGER) AS words,
               round((length(text) - length(translate(text, '?#@$', ''))) / length(text), 6) AS noise
        FROM documents""",
)
def word_and_noise_counts(spark, sf):
    t = F.col("text")
    return wide_table(spark, sf, "documents").select("doc_id", tx.word_count(t).alias("words"), F.round(tx.noise_ratio(t), 6).alias("noise"))


@query(
    "f05_dedupe_first",
    "SELECT min(doc_id) AS doc_id, sha256(text) AS fingerprint FROM documents GROUP BY text",
)
def dedupe_first(spark, sf):
    docs = wide_table(spark, sf, "documents").select("doc_id", "text")
    return integrity.dedupe_first(docs, [F.col("text")], ["doc_id"]).select("doc_id", "fingerprint")


@query(
    "f05_dedupe_urls",
    "SELECT min(page_id) AS page_id, url, sha256(url) AS fingerprint FROM pages GROUP BY url",
)
def dedupe_urls(spark, sf):
    return integrity.dedupe_first(table(spark, sf, "pages").select("page_id", "url"), [F.col("url")], ["page_id"])


@query(
    "a10_checksum_objects",
    "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS INTEGER) AS size_bytes FROM documents",
)
def checksum_objects(spark, sf):
    return integrity.checksum_objects(wide_table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query(
    "a10_verify_checksums",
    """WITH a AS (SELECT doc_id AS id, sha256(text) AS h FROM documents WHERE lang <> 'de'),
            b AS (SELECT doc_id AS id, sha256(trim(text) || CASE WHEN lang = 'es' THEN '.' ELSE '' END) AS h
                  FROM documents WHERE lang <> 'fr')
       SELECT id, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'unexpected' ELSE 'mismatch' END AS problem
       FROM a FULL JOIN b USING (id) WHERE a.h IS DISTINCT FROM b.h""",
)
def verify_checksums(spark, sf):
    docs = wide_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    suffix = F.when(F.col("lang") == "es", F.lit(".")).otherwise(F.lit(""))
    moved = docs.filter(F.col("lang") != "fr").withColumn("text", F.concat(F.trim("text"), suffix))
    return integrity.verify_checksums(
        integrity.checksum_objects(docs.filter(F.col("lang") != "de"), "text"), integrity.checksum_objects(moved, "text")
    )
