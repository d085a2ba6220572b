"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Templates are partitioned by their number of shingles (up to 1, 2, 4, 8, ...). Windows of a partition are half as long
again as its largest template and start every half template, so each occurrence lies inside a window, and a window with
four fifths of a template shares over three tenths of all their shingles with it. With one row a band and ``BANDS``
bands such a window shares a band with probability over 1 - 0.7^32 > 0.9999. The j-th MinHash of a set is the least
(hash xor seed j): one hash a shingle serves all bands.

A window can only share a band if it holds the very shingle that is the template's minimum there, so places without any
such shingle are left out before windows are cut; this changes no candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.llm.common import whole_text
from pathlore.llm.contamination import SHARE, SHINGLE, shingle_hashes, shingle_texts

BANDS = 32
MAX_TEMPLATES = 4096  # templates are sent to all tasks as literals

#: Public license notices, as (license, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_NOT_WORD = r"[^\p{L}\p{N}]+"


def notice_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits: notices are compared without punctuation."""
    return F.filter(F.split(F.lower(text), _NOT_WORD), lambda w: w != "")


def seeds(bands: int = BANDS) -> list[int]:
    """Fixed, well spread 64-bit numbers: multiples of the golden ratio."""
    return [((j + 1) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) - (1 << 63) for j in range(bands)]


def min_hashes(hashes: Column, bands: int = BANDS) -> Column:
    return F.transform(F.array(*[F.lit(s) for s in seeds(bands)]), lambda s: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(s))))


def window_shape(upper: int) -> tuple[int, int]:
    """(shingles of a window, shingles from one window to the next) for templates of up to ``upper`` shingles."""
    step = max(1, upper // 2)
    return upper + step - (1 if upper == 1 else 0), step


def read_templates(spark: SparkSession, templates, bands: int = BANDS) -> DataFrame:
    """(template, license, shingles, hashes, n, upper, minima) of the templates of five words and more."""
    templates = list(templates)
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    given = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, notice string")
    words = given.select("template", "license", notice_words(F.coalesce("notice", F.lit(""))).alias("words"))
    cut = words.select("template", "license", shingle_texts(F.col("words"), SHINGLE).alias("shingles"), F.array_distinct(shingle_hashes(F.col("words"), SHINGLE)).alias("hashes"))
    cut = cut.where("size(shingles) > 0").withColumn("n", F.size("shingles"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double")))).cast("int")
    return cut.withColumn("upper", upper).withColumn("minima", min_hashes(F.col("hashes"), bands))


def find_licenses(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text: str = "text", share: float = SHARE, bands: int = BANDS) -> DataFrame:
    """(id, license, template, n, shared, containment, first_word) for every window that holds ``share`` of a template.

    ``first_word`` is the place (from 0) of the first shared shingle among the words of the text. NULL and empty texts
    have no license; repeated rows are scanned each; NULL ids pass through; templates under five words raise no match.
    """
    spark = docs.sparkSession
    # Templates are a stated, bounded set: read once and put into the plan as literals and a broadcast table.
    known = read_templates(spark, templates, bands).collect()
    schema = "template int, license string, t_shingles array<string>, n int, upper int, band int, value bigint"
    by_band = spark.createDataFrame(
        [(t["template"], t["license"], t["shingles"], t["n"], t["upper"], j, v) for t in known for j, v in enumerate(t["minima"])], schema
    )
    anchors = sorted({v ^ s for t in known for v, s in zip(t["minima"], seeds(bands))})
    words = docs.select(F.col(id_col).alias("id"), notice_words(whole_text(text)).alias("words"))
    hashed = words.select("id", "words", shingle_hashes(F.col("words"), SHINGLE).alias("hashes"))
    placed = hashed.withColumn("places", F.filter(
        F.transform("hashes", lambda h, i: F.when(h.isin(anchors), i)), lambda i: i.isNotNull()
    ))
    # A place lies in the windows of a partition that start at most length - 1 before it; all partitions in one pass.
    def starts(upper: int) -> Column:
        length, step = window_shape(upper)
        near = F.flatten(F.transform("places", lambda p: F.transform(
            F.sequence(F.greatest(F.lit(0), F.ceil((p - (length - 1)) / step).cast("int")), F.floor(p / step).cast("int")), lambda k: k * step
        )))
        return F.transform(F.array_distinct(near), lambda s: F.struct(F.lit(upper).alias("upper"), s.alias("start"), F.lit(length).alias("length")))

    uppers = sorted({t["upper"] for t in known})
    every = F.flatten(F.array(*[starts(u) for u in uppers])) if uppers else F.array().cast("array<struct<upper:int,start:int,length:int>>")
    windows = placed.select("id", F.explode(every).alias("w"), "words", "hashes").select(
        "id", "w.upper", "w.start", F.slice("words", F.col("w.start") + 1, F.col("w.length") + SHINGLE - 1).alias("words"),
        F.slice("hashes", F.col("w.start") + 1, F.col("w.length")).alias("hashes"),
    )
    signed = windows.select("id", "upper", "start", "words", F.posexplode(min_hashes(F.col("hashes"), bands)).alias("band", "value"))
    hits = signed.join(F.broadcast(by_band), ["upper", "band", "value"])
    own = hits.select("id", "start", "license", "template", "n", "t_shingles", "words").distinct()
    own = own.withColumn("common", F.array_intersect(shingle_texts(F.col("words"), SHINGLE), "t_shingles"))
    found = own.select(
        "id", "license", "template", "n", F.size("common").alias("shared"), (F.col("start") + first_place(F.col("words"), F.col("common"))).alias("first_word")
    )
    return found.withColumn("containment", F.col("shared") / F.col("n")).where(F.col("containment") >= share)


def first_place(words: Column, common: Column) -> Column:
    """Place of the first shingle of ``words`` that is one of ``common``; array_intersect keeps the order of the words."""
    all_shingles = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " "))
    return F.array_position(all_shingles, F.get(common, F.lit(0))) - 1


def document_licenses(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text: str = "text", share: float = SHARE, bands: int = BANDS) -> DataFrame:
    """Pairs (id, license) with the best containment of any of its templates and the first word of a match; rows that
    share an id are one document."""
    found = find_licenses(docs, templates, id_col, text, share, bands)
    return found.groupBy("id", "license").agg(
        F.max("containment").alias("containment"), F.min("first_word").cast("long").alias("first_word"), F.countDistinct("template").cast("long").alias("templates")
    ).withColumnRenamed("id", id_col)
