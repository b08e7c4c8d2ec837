"""Scalar text functions as Column expressions: no Python runs per row."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that a head-up display line may carry, in order of detection.
HUD_KEYS = ("health", "hp", "ammo", "score", "lives", "life", "time", "level", "gold", "coins", "kills", "shield", "armor")
#: An amount of money, and a text that is a number and nothing else.
CURRENCY = r"(?<![+\-\d])[$]\s?(\d[\d,]*)"
NUMBER_ONLY = r"[^\w$+\-]*(\d[\d,]*)[^\w$]*"
SOURCE_TAGS = {"observed": "obs", "propagated": "PROP", "inferred": "INFER"}


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscore with more than one character; repeats stay."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: F.length(w) > 1)


def substring_count(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences, by bytes: removing a needle shortens the text by its bytes each time."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle.encode())).cast("bigint")


def score(text: Column, words: list[str]) -> Column:
    """Occurrences of all words summed; a word given twice counts twice."""
    low = F.lower(text)
    return sum((substring_count(low, w) * n for w, n in sorted(Counter(words).items())), F.lit(0).cast("bigint"))


def source_tag(source: Column, conf: Column) -> Column:
    tag = F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_TAGS.items() for x in kv])[source], source)
    return F.when(conf.isNull(), tag).otherwise(F.concat(tag, F.lit(" "), F.format_string("%.2f", conf)))


def token_estimate(text: Column, chars_per_token: float = 3.5) -> Column:
    return (F.floor(F.length(text) / chars_per_token) + 1).cast("bigint")


def hud_key(line: Column) -> Column:
    """First known name, in the order of HUD_KEYS, that stands as a word; hp is health."""
    low = F.lower(line)
    hit = F.coalesce(*[F.when(low.rlike(rf"\b{k}\b"), F.lit(k)) for k in HUD_KEYS])
    return F.when(hit == "hp", "health").otherwise(hit)


def hud_pairs(text: Column) -> Column:
    """(key, value) of every known name with a whole number among the two tokens after it, in order; a lone o or @ where a digit may stand reads as 0."""
    plain = F.regexp_replace(F.lower(text), "[|:]", " ")
    tokens = F.regexp_extract_all(F.regexp_replace(plain, r"(?<=[\s\d])[o@](?=[\d\s]|$)", "0"), F.lit(r"[a-z]+|-?\d+"), F.lit(0))
    names, is_number = F.array(*[F.lit(k) for k in HUD_KEYS]), lambda x: x.rlike(r"^-?\d+$")
    spread = F.transform(tokens, lambda x, i: F.struct(x.alias("name"), F.get(F.filter(F.slice(tokens, i + 2, F.lit(2)), is_number), F.lit(0)).alias("number")))
    found = F.filter(spread, lambda p: F.array_contains(names, p["name"]) & p["number"].isNotNull())
    return F.transform(found, lambda p: F.struct(F.when(p["name"] == "hp", "health").otherwise(p["name"]).alias("key"), p["number"].try_cast("bigint").alias("value")))


def hud_value(line: Column, key: Column | None = None) -> Column:
    """The first value of the key, which is that of the line unless one is given."""
    key = hud_key(line) if key is None else key
    return F.get(F.filter(hud_pairs(line), lambda p: p["key"] == key), F.lit(0))["value"]


def currency(text: Column) -> Column:
    """$N,NNN, a blank after the sign allowed, without a plus, minus or digit before it."""
    return _digits(F.regexp_extract(text, CURRENCY, 1))


def plain_number(text: Column) -> Column:
    """The only number of a text without letters, dollars and signs, if it has two digits or more."""
    hit = F.regexp_extract(F.trim(text), f"(?U)^{NUMBER_ONLY}$", 1)
    return F.when(F.length(F.replace(hit, F.lit(","), F.lit(""))) >= 2, _digits(hit))


def _digits(hit: Column) -> Column:
    return F.replace(hit, F.lit(","), F.lit("")).try_cast("bigint")


def is_field(node: Column) -> Column:
    """Whether a VARIANT is an object that has a value and a source, null or not."""
    has = lambda k: F.try_variant_get(node, f"$.{k}", "variant").isNotNull()
    return F.coalesce(has("v") & has("source"), F.lit(False))


def shown(value: Column) -> Column:
    """A value's JSON text as people read it: floats to three digits, lists member by member, True, False and None."""
    def one(x: Column) -> Column:
        short = F.regexp_replace(F.format_string("%.3g", x.try_cast("double")), r"(\.\d*?)0+(?=e|$)", "$1")
        number = F.regexp_replace(short, r"\.(?=e|$)", "")
        return F.when(x.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$") & x.rlike("[.eE]"), number).when(x.isin("true", "false"), F.initcap(x)).when(x == "null", "None").otherwise(x)

    members = F.from_json(value, "array<variant>")
    listed = F.concat(F.lit("["), F.array_join(F.transform(members, lambda m: one(F.to_json(m))), ","), F.lit("]"))
    return F.coalesce(F.when(value.startswith("["), listed).otherwise(one(value)), F.lit("None"))


def half_even(value: Column, digits: int = 4) -> Column:
    """Rounded to so many digits, halves to the even one."""
    return F.bround(value, digits)


def graded_choice(answer: Column, choices: list[str], truth: Column) -> Column:
    """Right if the first of the choices that the answer names, or the one that the answer starts with, is the true one."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    named = F.coalesce(*[F.when(low.rlike(rf"\b{c}\b"), F.lit(c)) for c in choices])
    return F.coalesce((named == truth) | (named.isNotNull() & F.trim(low).startswith(truth)), F.lit(False))


def key_values(text: Column) -> Column:
    """``k=v k=v`` as a map; values end at blanks."""
    pairs = F.regexp_extract_all(text, F.lit(r"(\w+)=(\S*)"), F.lit(0))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(\w+)=", 1), F.regexp_extract(p, r"^\w+=(.*)$", 1))))


def normalise_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def contains_all(text: Column, words: list[str]) -> Column:
    """Whether the normalised text has each of the words or phrases, normalised alike."""
    low = normalise_text(text)
    wanted = [normalise_text(F.lit(w)) for w in words]
    return F.lit(True) if not words else F.array_min(F.array(*[low.contains(w).cast("int") for w in wanted])) == 1


def first_integer(text: Column) -> Column:
    hit = F.regexp_extract(text, r"(-?\d+)", 1)
    return F.when(hit != "", hit.cast("bigint"))


def graded_number(answer: Column, truth: Column, tolerance: int = 0) -> Column:
    return F.coalesce(F.abs(first_integer(answer) - truth) <= tolerance, F.lit(False))


def slug(text: Column) -> Column:
    """A heading's id: lower case, letters, digits, marks, - and _ kept, each blank a -."""
    return F.replace(F.regexp_replace(F.lower(strip_markdown(text)), r"[^\p{L}\p{N}\p{M}\-_ ]", ""), F.lit(" "), F.lit("-"))


def strip_markdown(text: Column) -> Column:
    """Links and images as their text; tags, emphasis and code marks gone."""
    links = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(links, "<[^>]+>", ""), r"`|\*\*|__|\*", ""))


def heading_ids(lines: DataFrame) -> DataFrame:
    """lines (doc, n, line) -> (doc, n, title, id) of Markdown headings outside fences; a repeated id is numbered from 1."""
    w = Window.partitionBy("doc").orderBy("n")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    marked = lines.withColumn("fence", fence).withColumn("inside", F.sum(fence.cast("int")).over(w) % 2 == 1)
    heads = marked.filter(~F.col("fence") & ~F.col("inside")).withColumn("title", F.regexp_extract("line", r"^#{1,6}\s+(.*?)\s*$", 1)).filter("title <> ''").withColumn("base", slug(F.col("title")))
    nth = F.row_number().over(Window.partitionBy("doc", "base").orderBy("n")) - 1
    return heads.withColumn("nth", nth).select("doc", "n", "title", F.when(F.col("nth") > 0, F.concat_ws("-", "base", F.col("nth").cast("string"))).otherwise(F.col("base")).alias("id"))


def digest16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def number(text: Column, low: float = 0.0, high: float = 1.0, default: float = 0.5) -> Column:
    """A number within bounds, the default where there is none."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(text.try_cast("double"), F.lit(default))))


def reply_json(text: Column, schema: str) -> Column:
    """A model's reply: the text from the first brace to the last, read by schema."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)
