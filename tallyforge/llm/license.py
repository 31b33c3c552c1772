"""License scans by exact set-similarity join.

Templates and text blocks (windows of consecutive words) are sets of words. Words are ordered by how
many documents hold them, rarest first. A block that holds the share
`threshold` of a template's words must hold one of the template's rarest words
(prefix filter), have enough template words at all (length filter), and have
enough of them left from the first common one on (positional filter). What
passes is compared in full. DataFrame functions only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored

#: After lower-casing A-Z: runs of a-z, 0-9 and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: Label, the words that tell the license from others (all of them must be there), and the notice.
TEMPLATES = (
    ("agpl", "affero", "licensed under the gnu affero general public license version 3"),
    ("apache", "apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "cc nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "cc nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "cc sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "commons attribution sharealike", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "waived", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("gpl", "gnu general", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "purpose fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "lesser", "licensed under the gnu lesser general public license version 3"),
    ("mit", "mit", "released under the mit license"),
    ("mit", "granted charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "reserved", "all rights reserved"),
    ("public-domain", "domain", "this work has been released into the public domain"),
)

#: The least step from a block to the next, in words.
LEAST_STEP = 24


def block_size(templates: tuple[tuple[str, str, str], ...]) -> tuple[int, int]:
    """Words of a text block, and words from its start to the next one's: any notice as long as the longest template lies inside one."""
    step = max(LEAST_STEP, *(len(t.split()) for _, _, t in templates))
    return 2 * step, step


#: Those of the fixed list.
BLOCK, STEP = block_size(TEMPLATES)


def wider(templates: tuple[tuple[str, str, str], ...]) -> dict[int, list[int]]:
    """For each template, those of another label whose words include all of its own."""
    sets = [set(t.split()) for _, _, t in templates]
    return {i: [j for j, u in enumerate(sets) if sets[i] < u and templates[i][0] != templates[j][0]] for i in range(len(sets))}


def _need(text: str, threshold: float) -> int:
    return math.ceil(threshold * len(set(text.split())) - 1e-9)


def _may_hold(low: Column, phrases: list[str]) -> Column:
    """Whether all words of some phrase are parts of the text."""
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [low.contains(w) for w in p.split()]) for p in phrases])


def phrase_places(low: Column, words: Column, phrases: tuple[tuple[str, str], ...]) -> dict[str, tuple[Column, Column, Column]]:
    """For each label: the places where the phrase's words stand consecutively, and the first and the last of them (words from 0)."""
    # Two spaces between words, one of which each neighbour owns: places side by side don't overlap.
    spaced = F.when(_may_hold(low, [p for _, p in phrases]), F.concat(F.lit("  "), F.array_join(words, "  "), F.lit("  "))).otherwise(F.lit(""))
    out = {}
    for label, phrase in phrases:
        needle = " " + "  ".join(phrase.split()) + " "
        n = ((F.length(spaced) - F.length(F.replace(spaced, F.lit(needle)))) / len(needle)).cast("long")
        before = F.regexp_count(F.substring_index(spaced, needle, 1), F.lit("[^ ]+"))
        after = F.regexp_count(F.substring_index(spaced, needle, -1), F.lit("[^ ]+"))
        out[label] = n, before.cast("long"), (F.size(words) - after - len(phrase.split())).cast("long")
    return out


def blocks_of(words: Column, block: int, step: int) -> Column:
    """The blocks of an array of words; none without words."""
    more = F.greatest(F.lit(0), F.ceil((F.size(words) - block) / F.lit(step)).cast("int"))
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), more)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(words, i * step + 1, block))


def match_templates(blocks: DataFrame, order: list[str], templates: tuple[tuple[str, str, str], ...], threshold: float) -> DataFrame:
    """The join: for each block (columns k1, k2, words) and template with containment of the threshold or more, its label and containment.

    `order` has every template word, rarest first. A block is held against
    templates by their prefix words alone; nothing is sent but blocks that pass.
    A template whose words are all among another's gives way to that one.
    """
    rank = {w: i for i, w in enumerate(order)}
    index, above = [], wider(templates)
    for t, (label, keys, text) in enumerate(templates):
        words = sorted(set(text.split()), key=rank.__getitem__)
        need = _need(text, threshold)
        index += [(words[i], t, label, keys.split(), above[t], words, i, need) for i in range(len(words) - need + 1)]
    index_df = F.broadcast(blocks.sparkSession.createDataFrame(index, "word string, template int, label string, keys array<string>, wider array<int>, template_words array<string>, i int, need int"))  # as large as the fixed list above
    least = min(x[7] for x in index)
    prefixes = sorted({x[0] for x in index})
    held = F.array_intersect(F.array(*map(F.lit, order)), F.col("words"))  # in the global order
    some = blocks.filter(F.arrays_overlap("words", F.array(*map(F.lit, prefixes)))).select("k1", "k2", "block", held.alias("held")).filter(F.size("held") >= least)
    each = some.select("k1", "k2", "block", "held", F.posexplode("held").alias("j", "word")).join(index_df, "word")
    rest = F.least(F.size("template_words") - F.col("i"), F.size("held") - F.col("j"))
    passed = each.filter((F.size("held") >= F.col("need")) & (rest >= F.col("need")))
    common = F.size(F.array_intersect("template_words", "held"))
    found = passed.filter((common >= F.col("need")) & (F.size(F.array_except("keys", "held")) == 0)).select("k1", "k2", "block", F.struct("template", "wider", "label", (common / F.size("template_words")).alias("containment")).alias("m"))
    by_block = found.groupBy("k1", "k2", "block").agg(F.collect_set("m").alias("ms"))
    own = F.filter("ms", lambda m: ~F.arrays_overlap(m["wider"], F.transform("ms", lambda x: x["template"])))
    return by_block.select("k1", "k2", F.explode(own).alias("m")).select("k1", "k2", "m.label", "m.containment")


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: tuple[tuple[str, str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan every whole text for license phrases and templates.

    Returns the id column, `n_words`, `n_base` (places of all phrases),
    `first_word`, `last_word` (null without a place), `base_labels`, `labels`
    (with those of templates that a block contains to the threshold; sorted and
    comma-joined, empty without any) and `score` (the largest containment that
    reaches the threshold, else 0), a row for each row given. Blocks are
    windows of words over the whole text, whatever its lines, twice as long as
    the longest template (`block_size`). A null text
    is the empty text. Repeated rows get equal answers. Texts are read once,
    in place; kept are the template words that each holds, and the words of
    the few texts that hold enough of some template's.

    The vocabulary is the templates' alone and is held in the plan: meant for
    up to some thousand words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A to Z alone: the two other letters whose small form is in A to Z become one that stands for itself.
    low = F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("ß")), F.lit("\u0130"), F.lit("ß")))
    vocabulary = F.array(*map(F.lit, sorted({w for _, _, t in templates for w in t.split()})))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(text, F.col(id_col)).alias("k2"), low.alias("low"))
    base = base.select("*", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)).alias("words"))
    base = base.select("*", F.array_intersect("words", vocabulary).alias("held"))
    may = [(F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(set(t.split())))))) >= _need(t, threshold)) & reduce(lambda a, b: a & b, [F.array_contains("held", k) for k in keys.split()]) for _, keys, t in templates]
    enough = (F.size("held") >= min(_need(t, threshold) for _, _, t in templates)) & reduce(lambda a, b: a | b, may)
    places = phrase_places(F.col("low"), F.col("words"), phrases)
    here = {label: n > 0 for label, (n, _, _) in places.items()}
    told = base.select(
        "id", "k1", "k2", F.size("words").cast("long").alias("n_words"), "held", F.when(enough, F.col("words")).alias("words"),
        reduce(lambda a, b: a + b, [n for n, _, _ in places.values()]).alias("n_base"),
        F.array_min(F.array(*[F.when(here[x], a) for x, (_, a, _) in places.items()])).alias("first_word"),
        F.array_max(F.array(*[F.when(here[x], b) for x, (_, _, b) in places.items()])).alias("last_word"),
        F.array_compact(F.array(*[F.when(here[x], F.lit(x)) for x in places])).alias("base"),
    )
    told = stored(told, "scanned")
    counts = {r.word: r.n for r in told.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted({w for _, _, t in templates for w in t.split()}, key=lambda w: (counts.get(w, 0), w))
    blocks = told.filter("words IS NOT NULL").select("k1", "k2", F.posexplode(blocks_of(F.col("words"), *block_size(templates))).alias("block", "words"))
    labels = match_templates(blocks, order, templates, threshold).groupBy("k1", "k2").agg(F.collect_set("label").alias("found"), F.max("containment").alias("score"))
    both = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    joined = told.drop("words", "held").join(labels, ["k1", "k2"], "left")
    return joined.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(both), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
