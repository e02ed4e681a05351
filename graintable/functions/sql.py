"""Column builders that take plain values, and operators that give rows for a text, as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name, parameters, result type, body: each says what the builder of the same name in columns.py does.
FUNCTIONS = (
    ("to_number", "s STRING", "DOUBLE", r"CASE WHEN trim(s) RLIKE r'^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$' THEN try_cast(trim(s) AS DOUBLE) END"),
    ("null_outside", "x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN x BETWEEN low AND high THEN x END"),
    ("clean_null", "s STRING, words ARRAY<STRING>", "STRING", "CASE WHEN trim(s) <> '' AND NOT array_contains(transform(words, w -> lower(w)), lower(trim(s))) THEN trim(s) END"),
    ("normalize_key", "s STRING, prefix STRING", "STRING", "nullif(regexp_replace(lower(trim(s)), concat('^(', prefix, ')'), ''), '')"),
    ("first_token", "s STRING", "STRING", "nullif(lower(trim(split(s, ';')[0])), '')"),
    ("bare_text", "s STRING", "STRING", "regexp_replace(lower(coalesce(s, '')), '[^a-z0-9]', '')"),
    ("safe_ratio", "a DOUBLE, b DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN try_divide(a, b) BETWEEN low AND high THEN try_divide(a, b) END"),
    ("log_clip", "x DOUBLE, floor_at DOUBLE", "DOUBLE", "CASE WHEN x IS NOT NULL THEN ln(greatest(x, floor_at)) END"),
    ("null_if_inconsistent", "a DOUBLE, b DOUBLE, ratio DOUBLE", "DOUBLE", "CASE WHEN b IS NULL OR a <= b * ratio THEN a END"),
    ("norm_categorical", "s STRING", "STRING", "coalesce(nullif(lower(trim(s)), ''), 'unknown')"),
    ("resolve_range", "x DOUBLE, is_range BOOLEAN, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN is_range AND low IS NOT NULL AND high IS NOT NULL THEN (low + high) / 2 ELSE x END"),
    ("within_chars", "s STRING, a STRING, b STRING, n INT", "BOOLEAN", "coalesce(s, '') RLIKE concat('(?is)(', a, ').{0,', n, '}(', b, ')|(', b, ').{0,', n, '}(', a, ')')"),
    ("closeness", "p DOUBLE, target DOUBLE, width DOUBLE", "DOUBLE", "exp(-((ln(p) - ln(target)) * (ln(p) - ln(target))) / (2 * width * width))"),
)

#: name, parameters, columns, body: functions that give rows, for a lateral join; each the operator named, a text at a time.
TABLE_FUNCTIONS = (
    ("sentences", "s STRING", "pos INT, sentence STRING", r"SELECT pos, col FROM posexplode(split(s, r'(?<=[.!?])\s+'))"),  # extract.sentences
    ("spans", "s STRING, pattern STRING", "nth INT, matched STRING, value DOUBLE",  # extract.quantity_spans: group 1 of the pattern is the number
     "SELECT pos + 1, col.m, try_cast(col.v AS DOUBLE) FROM posexplode(zip_with(regexp_extract_all(s, pattern, 0), regexp_extract_all(s, pattern, 1), (a, b) -> named_struct('m', a, 'v', b)))"),
    ("blocks", "s STRING, least INT, must STRING", "nth INT, block STRING",  # extract.explode_blocks, at line ends
     r"SELECT pos + 1, col FROM posexplode(CASE WHEN s IS NOT NULL THEN CASE WHEN exists(split(s, '\n'), x -> length(x) >= least AND x RLIKE must) THEN filter(split(s, '\n'), x -> length(x) >= least AND x RLIKE must) ELSE array(s) END END)"),
    ("tags", "s STRING, rules MAP<STRING, ARRAY<STRING>>", "tag STRING",  # columns.tag_keywords
     "SELECT key FROM explode(map_filter(rules, (k, words) -> exists(words, w -> contains(lower(coalesce(s, '')), w))))"),
    ("words", "s STRING", "nth INT, word STRING", "SELECT pos + 1, col FROM posexplode(regexp_extract_all(lower(s), '[a-z]+', 0))"),  # extract.word_spans
)


def register(spark: SparkSession, prefix: str = "grain_") -> list[str]:
    """Make the functions known to a session's SQL; returns their names. They are SQL bodies, which Spark inlines: no Python runs."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, parameters, columns, body in TABLE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    return [prefix + name for name, *_ in (*FUNCTIONS, *TABLE_FUNCTIONS)]
