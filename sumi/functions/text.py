"""File names, verdict texts, paths and boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the keep rule and of file names.
FIRST_CJK, LAST_CJK = 0x4E00, 0x9FFF
UNSAFE = r'[<>:"/\\|?*]'
NAME_CHARS = 20
LOG_CHARS = 200


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def safe_filename(text: Column, most: int = NAME_CHARS) -> Column:
    name = strip(F.coalesce(text, F.lit("")))
    return F.when(name == "", "unknown").otherwise(F.substring(F.regexp_replace(name, UNSAFE, "_"), 1, most))


def strip_fence(raw: Column) -> Column:
    """Without a code fence: the fence line at the start and, only after one, the fence at the end."""
    text = strip(F.coalesce(raw, F.lit("")))
    inner = strip(F.regexp_replace(text, r"^```[^\n]*\n?", ""))
    return F.when(text.startswith("```"), strip(F.regexp_replace(inner, r"```$", ""))).otherwise(text)


def log_text(text: Column) -> Column:
    return F.substring(text, 1, LOG_CHARS)


def is_cjk(char: Column) -> Column:
    """One code point of the main ideograph block."""
    return F.coalesce((F.length(char) == 1) & F.ascii(char).between(FIRST_CJK, LAST_CJK), F.lit(False))


def truthy(value: Column) -> Column:
    """How a script would read a JSON scalar as a flag: null, false, 0, "" and empty lists and objects are not."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit(None)).otherwise(~text.isin("null", "false", "0", "0.0", '""', "[]", "{}"))


def verdict(raw: Column) -> Column:
    """The judge's reply as a struct. Not an object: flags are null and the comment is the reply. A string "false"
    is a flag that is set; a character that is no string, or a reply that is JSON but no object, is an error."""
    text = strip_fence(raw)
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    get = lambda key, to: F.try_variant_get(F.when(is_object, value), f"$.{key}", to)
    flag = lambda key: F.when(is_object, F.coalesce(truthy(F.to_json(F.try_variant_get(F.when(is_object, value), f"$.{key}", "variant"))), F.lit(False)))
    char_kind = F.schema_of_variant(F.try_variant_get(F.when(is_object, value), "$.character", "variant"))
    bad_char = is_object & char_kind.isNotNull() & ~char_kind.isin("STRING", "VOID")
    return F.struct(
        raw.alias("raw"),
        is_object.alias("parsed"),
        flag("single_character").alias("single_character"),
        flag("recognizable").alias("recognizable"),
        flag("has_noise").alias("has_noise"),
        F.when(is_object, strip(F.coalesce(get("character", "string"), F.lit("")))).alias("character"),
        F.when(is_object, get("comment", "string")).otherwise(raw).alias("comment"),
        ((value.isNotNull() & ~is_object) | bad_char).alias("error"),
    )


def keep(v: Column) -> Column:
    """Single, recognizable, without noise, and one ideograph."""
    return F.coalesce(v["single_character"] & v["recognizable"] & ~v["has_noise"] & is_cjk(v["character"]), F.lit(False))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def preprocessed_name(path: Column, suffix: str = "_preprocessed") -> Column:
    return F.regexp_replace(path, r"^(.*?)(\.[^./]*)?$", f"$1{suffix}$2")


def alpha_name(path: Column, alpha: float, beta: float, heal: bool = False) -> Column:
    return preprocessed_name(path, f"{'_heal' if heal else ''}_alpha{alpha}_beta{beta}")


def region_file(k: Column) -> Column:
    return F.format_string("region_%03d.jpg", k)


def char_file(k: Column) -> Column:
    return F.format_string("char_%04d.png", k)


def output_file(k: Column, character: Column, kept: Column) -> Column:
    return F.when(kept, F.concat(F.format_string("%03d_", k), safe_filename(character), F.lit(".png"))).otherwise(F.format_string("reject_%03d.png", k))


def encode(data: Column) -> Column:
    """Base64 on one line: Spark breaks lines after 76 characters unless a setting of the session says otherwise."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def register(spark: SparkSession) -> None:
    """SQL functions of the same names, as expressions that Catalyst sees through."""
    cases = rf"'{UNSAFE}'".replace("\\\\", "\\\\\\\\")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION safe_filename(t STRING) RETURNS STRING RETURN CASE WHEN trim(coalesce(t, '')) = '' THEN 'unknown' ELSE substring(regexp_replace(trim(t), {cases}, '_'), 1, {NAME_CHARS}) END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_cjk(c STRING) RETURNS BOOLEAN RETURN coalesce(length(c) = 1 AND ascii(c) BETWEEN {FIRST_CJK} AND {LAST_CJK}, false)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gray_of(b INT, g INT, r INT) RETURNS INT RETURN (299 * r + 587 * g + 114 * b + 500) div 1000")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION clamp(v INT, low INT, high INT) RETURNS INT RETURN greatest(low, least(high, v))")
