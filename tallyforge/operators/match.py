"""Which saved profile fits a file: token overlap, keyword and name scores, weighted and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import tokens
from tallyforge.operators.bounds import bounded, fits

THRESHOLD, AUTO = 0.7, 0.9
HEADER, BODY, NAME = 0.6, 0.3, 0.1
CAPPED = 0.69
#: Profiles that are broadcast at most, and terms of a dictionary.
BROADCAST, TERMS = 20_000, 10_000


def header_tokens(headers: Column | str) -> Column:
    h = F.col(headers) if isinstance(headers, str) else headers
    return F.array_distinct(F.flatten(F.transform(h, lambda x: tokens(F.lower(x)))))


def overlap_score(saved: Column, seen: Column) -> Column:
    """Share of the saved header's tokens that the file's header has."""
    a, b = header_tokens(saved), header_tokens(seen)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def keyword_score(keywords: Column, text: Column) -> Column:
    n = F.size(F.filter(keywords, lambda x: F.contains(F.lower(text), F.lower(x))))
    return F.when(F.size(keywords) > 0, n / F.size(keywords)).otherwise(0.0)


def filename_score(pattern: Column, name: Column) -> Column:
    """1 where the saved tokens stand in the name in their order, else 0. Patterns are tokens joined by `.*`, optionally between ^ and $; any other sign in them is an error, so no user pattern runs here."""
    bare = F.regexp_replace(F.lower(pattern), r"^\^(\.\*)?|(\.\*)?(\\\.[a-z0-9]+)?\$$", "")
    parts = F.split(bare, r"\.\*")
    odd = F.exists(parts, lambda p: ~p.rlike(r"^[a-z0-9 _-]*$"))
    left = F.aggregate(parts, F.lower(name), lambda rest, p: F.when(F.contains(rest, p), F.substr(rest, F.position(p, rest) + F.length(p))))  # null once a token is missing
    return F.when(odd, F.raise_error(F.concat(F.lit("not a file name pattern: "), pattern))).when((bare != "") & left.isNotNull(), 1.0).otherwise(0.0)


def signature_score(p: str, f: str) -> Column:
    """Weighted score of a saved signature (struct column p) for a file (struct column f), to six places."""
    header = overlap_score(F.col(f"{p}.header"), F.col(f"{f}.header"))
    body = F.greatest(keyword_score(F.col(f"{p}.keywords"), F.col(f"{f}.text")), keyword_score(F.col(f"{p}.anchors"), F.col(f"{f}.text")))
    name = filename_score(F.col(f"{p}.filename"), F.col(f"{f}.name"))
    has_header, has_body = F.size(f"{p}.header") > 0, (F.size(f"{p}.keywords") > 0) | (F.size(f"{p}.anchors") > 0)
    raw = F.when(has_header & has_body, HEADER * header + BODY * body + NAME * name).when(has_header, (HEADER + BODY) * header + NAME * name).otherwise(F.greatest(body, name))
    return F.round(raw, 6)


def sources_present(required: Column, header: Column) -> Column:
    """Whether a header has all required names, apart from case and spaces about them; a file without a header has."""
    lower = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    return (F.size(header) == 0) | (F.size(F.array_except(lower(required), lower(header))) == 0)


def bank_present(bank: Column, text: Column, name: Column) -> Column:
    """Whether a bank's name stands in a file's text or name."""
    return F.contains(F.lower(F.concat_ws(" ", text, name)), F.lower(bank)) & (bank != "")


def match_profiles(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles that fit each file, best first: file_id, profile_id, confidence, layout_changed, rank.

    `files` has file_id, type, name, header, text; `profiles` has profile_id,
    type, bank, required (header names), header, keywords, anchors, filename.
    Files are held against profiles of their own type alone. A profile whose
    required columns are missing reaches 0.69 at most. Ties go to the lesser
    profile id. Up to BROADCAST profiles are sent to all files; more are dealt
    out in shares of that size.

    Tokens and small letters are told once a file and once a profile. A pair
    is scored by header and file name first; the text is looked through only
    where its keywords can still bring the pair to the threshold, or the bank's
    name stands there.
    """
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    names = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    f = files.select("file_id", "type", header_tokens("header").alias("tokens"), names("header").alias("names"), F.lower("text").alias("low"), F.lower(F.concat_ws(" ", "text", "name")).alias("all"), "name")
    p = profiles.select("profile_id", "type", F.lower("bank").alias("bank"), names("required").alias("required"), (F.size("header") > 0).alias("has_header"), header_tokens("header").alias("wanted"), low("keywords").alias("keywords"), low("anchors").alias("anchors"), "filename")
    if fits(p, BROADCAST):
        both = f.join(F.broadcast(p), "type")
    else:  # a type's files and profiles meet in many tasks: each file goes to every share of the profiles
        parts = -(-p.count() // BROADCAST)
        shares = f.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        both = shares.join(p.withColumn("_part", F.pmod(F.xxhash64("profile_id"), F.lit(parts)).cast("int")), ["type", "_part"])
    overlap = F.when(F.size("wanted") > 0, F.size(F.array_intersect("wanted", "tokens")) / F.size("wanted")).otherwise(0.0)
    present = (F.size("names") == 0) | (F.size(F.array_except("required", "names")) == 0)
    first = both.select("file_id", "profile_id", "low", "keywords", "anchors", "has_header", overlap.alias("header"), filename_score(F.col("filename"), F.col("name")).alias("named"), present.alias("present"), (F.contains("all", "bank") & (F.col("bank") != "")).alias("bank"))
    h, n, has_body = F.col("header"), F.col("named"), (F.size("keywords") > 0) | (F.size("anchors") > 0)
    raw = lambda body: F.round(F.when(F.col("has_header") & has_body, HEADER * h + BODY * body + NAME * n).when(F.col("has_header"), (HEADER + BODY) * h + NAME * n).otherwise(F.greatest(body, n)), 6)
    open_ = first.filter(F.col("bank") | (raw(F.when(has_body, 1.0).otherwise(0.0)) >= THRESHOLD))
    share = lambda words: F.when(F.size(words) > 0, F.size(F.filter(words, lambda x: F.contains(F.col("low"), x))) / F.size(words)).otherwise(0.0)
    scored = open_.withColumn("body", F.greatest(share("keywords"), share("anchors"))).select("file_id", "profile_id", raw(F.col("body")).alias("score"), "present", "bank", "has_header")
    confidence = F.when(F.col("present"), F.col("score")).otherwise(F.least("score", F.lit(CAPPED)))
    changed = F.when(F.col("present"), F.col("has_header") & F.col("bank") & (F.col("score") < THRESHOLD)).otherwise((F.col("score") >= THRESHOLD) | F.col("bank"))
    kept = scored.select("file_id", "profile_id", confidence.alias("confidence"), changed.alias("layout_changed")).filter(f"confidence >= {THRESHOLD} OR layout_changed")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("confidence"), "profile_id")))


def score_headers(headers: DataFrame, terms: DataFrame) -> DataFrame:
    """header, field, score: 1 for an exact term, 0.7 where the header holds one. `terms` is a fixed dictionary of field and term."""
    h = F.lower(F.trim("header"))
    joined = headers.select("header", h.alias("h")).distinct().join(bounded(terms, TERMS, "terms"), F.expr("h = term OR contains(h, term)"))
    return joined.groupBy("header", "field").agg(F.max(F.when(F.col("h") == F.col("term"), 1.0).otherwise(0.7)).alias("score"))
