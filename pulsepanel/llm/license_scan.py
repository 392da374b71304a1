"""License scans by diagonal voting.

Every rolling k-gram of words of a document is hashed and joined to the
positions of the same k-gram in license templates.  A hit lies on a diagonal
(document position minus template position); a passage that follows the
template puts all its hits on one diagonal, and an inserted or missing word
moves the rest to a neighbouring one.  Hits are counted by diagonal,
neighbouring diagonals are merged, and a span is verified by comparing the
words themselves and by the share of template words that it covers.  Licenses
that share most of a passage each have a template; the gram where a template
differs from its kin (``TELLING``) has to be among the span's hits.

Scale: DataFrame functions only.  The template table is a constant of this
module, so its broadcast is bounded; document k-grams stream through the two
hash joins and only hits are shuffled, by (document, template), never by a
word.  A phrase that a third of all documents hold makes a few hits in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsepanel.llm.common import lower_ascii
from pulsepanel.sources.sinks import materialize

#: Words of letters, digits and non-ASCII characters.
LICENSE_WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"

#: Phrases and labels that always count, in full.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Opening passages of public licenses, found also where words differ.
PASSAGES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files the software to deal in the software without restriction",
     "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except "
     "in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of "
     "the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or "
     "without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license",
     "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("gnu library general public license as published by the free software foundation", "lgpl"),
    ("gnu affero general public license as published by the free software foundation", "agpl"),
    ("licensed under the apache software license version 2 0 the license you may not use this file "
     "except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software", "bsd"),
    ("this program and the accompanying materials are made available under the terms of the eclipse "
     "public license", "epl"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of "
     "the software and accompanying documentation covered by this license the software", "bsl"),
    ("licensed under the creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution 3 0 unported license", "cc-by"),
    ("licensed under the creative commons attribution 3 0 unported license", "cc-by"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license",
     "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 3 0 unported license", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution share alike 4 0 international license",
     "cc-by-sa"),
    ("licensed under a creative commons attribution noderivatives 4 0 international license",
     "cc-by-nd"),
    ("licensed under a creative commons attribution noncommercial sharealike 4 0 international "
     "license", "cc-by-nc-sa"),
    ("licensed under a creative commons attribution noncommercial noderivatives 4 0 international "
     "license", "cc-by-nc-nd"),
)
#: The gram in which a label's passages differ from those of
#: other licenses (the first that a passage holds).
TELLING = {
    "gpl": ("gnu general public license",),
    "lgpl": ("gnu lesser general public", "gnu library general public"),
    "agpl": ("gnu affero general public",),
    "apache": ("under the apache license", "under the apache software"),
    "mpl": ("the mozilla public license",),
    "epl": ("the eclipse public license",),
    "mit": ("to deal in the",),
    "cc-by": ("commons attribution 4 0", "commons attribution 3 0"),
    "cc-by-nc": ("attribution noncommercial 4 0", "attribution noncommercial 3 0"),
    "cc-by-sa": ("creative commons attribution sharealike", "commons attribution share alike"),
    "cc-by-nd": ("creative commons attribution noderivatives",),
    "cc-by-nc-sa": ("commons attribution noncommercial sharealike",),
    "cc-by-nc-nd": ("commons attribution noncommercial noderivatives",),
}
#: k of the rolling k-grams; a phrase of fewer words uses SHORT.
LONG, SHORT = 4, 2
#: Diagonals at most so far apart are merged.
NEIGHBOUR = 3
#: Share of a passage's words that a span has to cover.
COVER = 0.6


def templates(phrases=PHRASES, passages=PASSAGES) -> list[tuple]:
    """(words, label, exact, k, tell) of each template; ``tell`` is the position
    of its telling gram, None for a base phrase or a label without one."""
    out = []
    for number, (text, label) in enumerate([*phrases, *passages]):
        words, exact = text.split(), number < len(phrases)
        k = LONG if len(words) >= LONG else SHORT
        if len(words) < k:
            raise ValueError(f"a template needs {SHORT} words or more: {text!r}")
        grams = [" ".join(words[at:at + k]) for at in range(len(words) - k + 1)]
        telling = [] if exact else [grams.index(g) for g in TELLING.get(label, ()) if g in grams]
        if not exact and label in TELLING and not telling:
            raise ValueError(f"no telling words of {label} in {text!r}")
        out.append((words, label, exact, k, telling[0] if telling else None))
    return out


def template_grams(spark: SparkSession, phrases=PHRASES, passages=PASSAGES) -> DataFrame:
    """One row per k-gram of each template: template, exact, label, words of
    the template, k, ``tell``, position ``at`` and the words of the gram."""
    rows = F.array(*[F.struct(
        F.lit(number).alias("template"), F.lit(exact).alias("exact"), F.lit(label).alias("label"),
        F.lit(len(words)).alias("n"), F.lit(k).alias("k"), F.lit(tell).cast("int").alias("tell"),
        F.lit(" ".join(words)).alias("text"))
        for number, (words, label, exact, k, tell) in enumerate(templates(phrases, passages))])
    grams = F.expr("transform(sequence(0, n - k), i -> slice(split(text, ' '), i + 1, k))")
    return spark.range(1).select(F.inline(rows)).select(
        "template", "exact", "label", "n", "k", "tell", F.posexplode(grams).alias("at", "gram"))


def _grouped(grams: DataFrame, k: int) -> DataFrame:
    """Positions of each k-gram hash: one row per hash."""
    words = [F.col("gram")[i] for i in range(k)]
    return (grams.where(F.col("k") == k).groupBy(F.xxhash64(*words).alias(f"_t{k}"))
            .agg(F.collect_list(F.struct("template", "exact", "label", "n", "k", "tell", "at", "gram"))
                 .alias(f"_at{k}")))


def license_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified k-gram hits: _id, _text (hash of the text), template columns,
    ``pos`` (word of the document) and ``diagonal``."""
    grams = template_grams(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"),
        F.regexp_extract_all(lower_ascii(text), F.lit(LICENSE_WORD), F.lit(1)).alias("w"))
    size = F.greatest(F.size("w"), F.lit(1))
    grams_of = F.arrays_zip(*[F.slice("w", i + 1, size).alias(f"w{i}") for i in range(LONG)])
    rows = (words.select("_id", "_text", F.posexplode(grams_of).alias("pos", "g"))
            .select("_id", "_text", "pos", "g.*"))
    for k in (SHORT, LONG):
        part = [F.col(f"w{i}") for i in range(k)]
        rows = rows.join(F.broadcast(_grouped(grams, k)),
                         (F.xxhash64(*part) == F.col(f"_t{k}")) & part[-1].isNotNull(), "left")
    found = rows.where("_at2 is not null or _at4 is not null")
    found = found.withColumn("t", F.explode(F.concat(F.coalesce("_at2", F.array()),
                                                     F.coalesce("_at4", F.array()))))
    same = F.slice(F.array(*[F.col(f"w{i}") for i in range(LONG)]), 1, F.col("t.k")) == F.col("t.gram")
    return (found.where(same)
            .select("_id", "_text", "pos", "t.template", "t.exact", "t.label", "t.n", "t.k", "t.tell",
                    "t.at", (F.col("pos") - F.col("t.at")).alias("diagonal"))
            .dropDuplicates(["_id", "_text", "template", "pos", "at"]))


def license_spans(hits: DataFrame) -> DataFrame:
    """Spans per (document, template): base phrases in full on one diagonal,
    passages over merged diagonals, with ``first``, ``last`` word, ``cover``
    (share of the template's words that were seen), ``own`` (the telling gram
    was hit, or there is none) and ``rival`` (the span runs on across its place
    with other words: another license's text)."""
    doc = ["_id", "_text", "template"]
    exact = (hits.where("exact").groupBy(*doc, "label", "n", "diagonal", "k")
             .agg(F.count(F.lit(1)).alias("votes")).where("votes = n - k + 1")
             .select("_id", "_text", "template", F.lit(True).alias("exact"), "label",
                     F.col("diagonal").cast("long").alias("first"),
                     (F.col("diagonal") + F.col("n") - 1).cast("long").alias("last"),
                     F.lit(1.0).alias("cover"), F.lit(True).alias("own"),
                     F.lit(False).alias("rival")))
    by = Window.partitionBy(*doc).orderBy("diagonal")
    diagonals = (hits.where("not exact").groupBy(*doc, "label", "n", "k", "tell", "diagonal")
                 .agg(F.collect_set("at").alias("ats"), F.min("pos").alias("lo"),
                      F.max("pos").alias("hi"))
                 .withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by) > NEIGHBOUR))
                 .withColumn("band", F.sum(F.coalesce(F.col("new"), F.lit(True)).cast("int")).over(by)))
    merged = (diagonals.withColumn("words", F.expr("flatten(transform(ats, a -> sequence(a, a + k - 1)))"))
              .groupBy(*doc, "label", "n", "tell", "band")
              .agg(F.collect_set("words").alias("seen"), F.min("lo").alias("first"),
                   (F.max(F.col("hi") + F.col("k")) - 1).alias("last"),
                   F.max(F.array_contains("ats", F.col("tell"))).alias("hit"),
                   F.min(F.array_min("ats")).alias("low"), F.max(F.array_max("ats")).alias("high"))
              .withColumn("cover", F.size(F.array_distinct(F.flatten("seen"))) / F.col("n")))
    own = F.col("tell").isNull() | F.coalesce("hit", F.lit(False))
    passages = merged.select(
        "_id", "_text", "template", F.lit(False).alias("exact"), "label",
        F.col("first").cast("long"), F.col("last").cast("long"), "cover", own.alias("own"),
        (~own & (F.col("low") < F.col("tell")) & (F.col("high") > F.col("tell"))).alias("rival"))
    return exact.unionByName(passages)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  cover: float = COVER) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_base``, ``first_word``,
    ``last_word``, ``base_labels``, ``labels``, ``score`` and ``spans``.

    ``score`` is the best cover of any template (1 with a base phrase), spans
    of another license's words left out.  A null text is empty; a text without words has counts of 0, null words,
    empty labels and score 0.  Rows that repeat get the same result each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col), F.xxhash64(text).alias("_text"),
        F.regexp_count(lower_ascii(text), F.lit(LICENSE_WORD)).cast("long").alias("n_words"))
    spans = license_spans(materialize(license_hits(docs, id_col, text_col), "license-hits"))
    spans = spans.where("not rival")
    kept = F.col("exact") | ((F.col("cover") >= cover) & F.col("own"))
    found = spans.groupBy(F.col("_id").alias("_fid"), F.col("_text").alias("_ftext")).agg(
        F.count_if("exact").alias("_n"),
        F.min(F.when(F.col("exact"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",")
        .alias("_base"),
        F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("label")))), ",").alias("_all"),
        F.max("cover").alias("_cover"),
        F.array_sort(F.collect_list(F.when(kept, F.struct("first", "last", "label")))).alias("_spans"))
    joined = base.join(found, F.col(id_col).eqNullSafe(F.col("_fid"))
                       & (F.col("_text") == F.col("_ftext")), "left")
    return joined.select(
        id_col, "n_words", F.coalesce("_n", F.lit(0)).cast("long").alias("n_base"), "first_word",
        "last_word", F.coalesce("_base", F.lit("")).alias("base_labels"),
        F.coalesce("_all", F.lit("")).alias("labels"),
        F.coalesce("_cover", F.lit(0.0)).alias("score"), F.col("_spans").alias("spans"))
