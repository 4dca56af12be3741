"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize

#: Licence names (SPDX) and the notices that stand for them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 or later."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted under the ISC License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal license."),
    ("Proprietary", "Copyright. All rights reserved."),
)
#: Whole texts, one file for each licence name; ORIGIN.md there says where they are from.
TEXTS = Path(__file__).with_name("license_texts")
#: A part of a text that holds one of these may state a licence.
TRIGGER = r"(?i)licen[sc]e|copyright|rights reserved|public domain|permission is hereby|redistribut"
SIMILARITY = 0.6
#: A file states a licence as a whole, for its directory, if this share of its tokens lies in the part that matches.
FILE_SHARE = 0.5


def parts(text: Column) -> Column:
    """Parts of a text that may state a licence, distinct: its lines, sentences and paragraphs, and the whole.

    A paragraph ends at an empty line, so a notice that is wrapped over lines is one part too.
    """
    pieces = F.concat(F.split(text, r"\n|(?<=[.!?;])\x20+(?=[A-Z])"), F.split(text, r"\n[^A-Za-z0-9\n]*\n"), F.array(text))
    return F.when(text.rlike(TRIGGER), F.array_distinct(F.filter(pieces, lambda p: p.rlike(TRIGGER)))).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), F.lit(0))


def templates(spark: SparkSession) -> DataFrame:
    whole = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    return spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate([*TEMPLATES, *whole])], "template int, license string, text string")


def document_frequencies(texts: DataFrame) -> DataFrame:
    """``token, df``: in how many of ``texts(text)`` each token occurs, counted over all of them."""
    return texts.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def match_parts(found: DataFrame, frequencies: DataFrame, total: int, known: DataFrame) -> DataFrame:
    """``key, license, similarity, n_tokens``: the template nearest to each of ``found(key, text)``, if near enough (ties: the first).

    Sparse TF-IDF cosine: a token weighs its count times ``ln((1 + total) / (1 + df)) + 1``, with ``df`` of the whole corpus
    (0 for what only templates have). Weights join by token, so a frequent token is spread over tasks like any other
    skewed key; only what templates hold, whose number is fixed, is broadcast.
    """
    idf = lambda df: F.log((1 + F.lit(float(total))) / (1 + F.coalesce(df, F.lit(0)))) + 1
    bag = lambda df, key: df.select(key, F.explode(tokens(F.col("text"))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    weigh = lambda bags: bags.join(frequencies, "token", "left").withColumn("w", F.col("tf") * idf(F.col("df"))).drop("df")
    posting = materialize(weigh(bag(known, "template")))
    norm = posting.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    posting = materialize(posting.join(norm, "template").select("token", "template", (F.col("w") / F.col("norm")).alias("part")))
    bags = materialize(weigh(bag(found, "key")))
    length = bags.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), F.sum("tf").alias("n_tokens"))
    dots = bags.join(F.broadcast(posting), "token").groupBy("key", "template").agg(F.sum(F.col("w") * F.col("part")).alias("dot"))
    best = dots.groupBy("key").agg(F.max(F.struct(F.round("dot", 9).alias("dot"), (-F.col("template")).alias("less"))).alias("b")).select("key", F.col("b.dot").alias("dot"), (-F.col("b.less")).alias("template"))
    near = best.join(length, "key").withColumn("similarity", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("similarity") >= SIMILARITY)
    return near.join(F.broadcast(known.select("template", "license")), "template").select("key", "license", "similarity", "n_tokens")


def directory(path: Column) -> Column:
    """Everything before the last slash; empty at the top."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The directory, those above it, and the top."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(0), F.when(folder == "", 0).otherwise(F.size(parts))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(files: DataFrame, id_col: str, path_col: str, text_col: str, is_license_file: Column | None = None) -> DataFrame:
    """``doc_id, path, license, origin, similarity, from_dir`` for every row of ``files``.

    ``origin`` is ``own`` (a part of the text; the nearest to its template, then the first licence name), ``inherited`` (from
    the licence files of the nearest directory above, the smallest path among them) or ``none``. A licence file is one that
    ``is_license_file`` says, or, where that is not given, one whose matching part holds ``FILE_SHARE`` of its tokens.
    Parts equal in text are compared once, and directories once, however many files they hold. Null or empty texts
    have no notice; a null path lies at the top. Repeated rows and null ids stay, an empty table gives an empty one, and no
    other column of ``files`` is read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    stated = F.lit(None).cast("boolean") if is_license_file is None else is_license_file
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), stated.alias("stated"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("parts", parts(F.col("text")))
    n_tokens = F.when(F.size("parts") > 0, F.size(tokens(F.col("text"))))
    marked = materialize(rows.select("doc_id", "path", "stated", "row", n_tokens.alias("n"), F.transform("parts", lambda p: F.struct(F.sha2(p, 256).alias("key"), p.alias("text"))).alias("parts")))
    known = templates(files.sparkSession)
    frequencies = materialize(document_frequencies(files.select(text.alias("text"))))
    each = marked.select("row", F.explode("parts").alias("p")).select("row", "p.*")
    matched = materialize(match_parts(each.groupBy("key").agg(F.first("text").alias("text")), frequencies, files.count(), known))
    own = each.select("row", "key").join(matched, "key").groupBy("row").agg(F.min(F.struct((-F.col("similarity")).alias("far"), F.col("license"))).alias("own"), F.max("n_tokens").alias("held"))
    marked = materialize(marked.drop("parts").join(own, "row", "left").withColumn("folder", directory(F.col("path"))))
    whole = F.coalesce("stated", F.col("held") >= FILE_SHARE * F.col("n"))
    licensed = marked.where(whole & F.col("own").isNotNull()).groupBy(F.col("folder").alias("from_dir")).agg(F.min(F.struct("path", "own.license")).alias("l"))
    folders = marked.select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"))).alias("from_dir"))
    nearest = materialize(folders.join(licensed, "from_dir").groupBy("folder").agg(F.max_by(F.struct("from_dir", F.col("l.license").alias("license")), F.length("from_dir")).alias("n")))
    out = marked.drop("n").join(nearest, "folder", "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("n").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("own.license", "n.license").alias("license"), origin.alias("origin"), (-F.col("own.far")).alias("similarity"), F.when(F.col("own").isNull(), F.col("n.from_dir")).alias("from_dir"))
