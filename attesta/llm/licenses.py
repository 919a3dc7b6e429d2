"""License scans by diagonal voting: word k-grams joined to template positions, votes by offset, neighbouring offsets merged, spans verified."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Workspace, hash_words, mix, small_batches, text_batches

#: Words of a gram; offsets that merge, as a word more or less shifts what follows; shares of a template's words that a span must cover.
GRAM, NEAR, SHORT, SHORT_SHARE, LONG_SHARE = 3, 2, 14, 0.8, 0.5

# Phrases that are always reported where they stand whole, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Wordings of well-known public licenses and notices, with their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3"),
    ("you should have received a copy of the gnu general public license along with this program if not see", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("you should have received a copy of the gnu affero general public license along with this program", "agpl"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", "epl-2"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "zlib"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", "bsl-1"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("this work is licensed under the creative commons attribution noderivatives 4 0 international license", "cc-by-nd"),
)


def grams(texts: list[str | None], k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of every k-gram of words of the texts, and each text's number of words."""
    words, counts = hash_words(texts, WORD)
    if len(words) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), counts
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + n])
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    inside = text[:n] == text[k - 1 :]
    text = text[:n][inside]
    return text, np.flatnonzero(inside) - first[text], h[inside], counts


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...], k: int = GRAM) -> DataFrame:
    """(gram, template, at): where each gram stands in the templates. As many rows as the templates have words; gram 0 marks a text's own row."""
    text, place, h, _ = grams([t for t, _ in templates], k)
    rows = [(int(x), int(t), int(p)) for x, t, p in zip(h.view(np.int64), text, place)]  # noqa: B905
    return spark.createDataFrame([(0, -1, 0), *rows], "gram long, template int, at int")


def in_order(spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (place in the text, place in the template) in which both rise: what stands in the order of the template."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(spots)
    spots = sorted(spots, key=lambda s: (s[0], -s[1]))  # of one place in the text only one place in the template can follow another
    for i, (_, at) in enumerate(spots):
        k = bisect_left(tails, at)
        before[i] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [at], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(spots[i])
        i = before[i]
    return out[::-1]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """(id, n_words, places array<struct<start,phrase>>, found array<struct<label,first,last,share>>) for each row.

    places: where a phrase's words stand consecutively. found: merged diagonals of a template of which enough words are covered, word by word and in the template's order; first and
    last are places of words. Null and empty texts, and texts shorter than a gram, have none. Rows that repeat an id stay apart; other columns are not read; an empty table gives no
    rows. The table of template grams is as large as the templates given and is broadcast; every gram of every text is joined to it.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "licenses")
    every = (*phrases, *templates)
    n_phrases = len(phrases)
    lengths = grams([t for t, _ in every])[3].tolist()
    if short := [every[i][0] for i, n in enumerate(lengths) if n < GRAM]:
        raise ValueError(f"templates need {GRAM} words at least: {short}")
    labels = [x for _, x in every]

    def rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch, texts in text_batches(batches):
            for at in range(0, len(texts), 128):
                part = texts[at : at + 128]
                text, place, h, counts = grams(part)
                ids = batch.column("id").slice(at, len(part))
                own = np.arange(len(part))
                text, place, h = np.concatenate([own, text]), np.concatenate([counts, place]), np.concatenate([np.zeros(len(part), np.uint64), h])
                yield pa.RecordBatch.from_arrays([pa.array(row + text), ids.take(pa.array(text)), pa.array(place), pa.array(h.view(np.int64))], ["row", "id", "place", "gram"])
                row += len(part)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hits = rows.mapInArrow(rolled, "row long, id long, place long, gram long").join(F.broadcast(template_grams(spark, every)), "gram")
    votes = hits.groupBy("row", "id", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("at"))
    by_text = votes.groupBy("row", "id").agg(F.collect_list(F.struct("template", "diagonal", "at")).alias("votes"))
    schema = "id long, n_words long, places array<struct<start:long,phrase:string>>, found array<struct<label:string,first:long,last:long,share:double>>"

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_type = pa.list_(pa.struct([("start", pa.int64()), ("phrase", pa.string())]))
        found_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))
        for batch in batches:
            words, places, found = [], [], []
            for vote in batch.column("votes").to_pylist():
                own_places, own_found, n = [], [], 0
                by: dict[int, list[tuple[int, list[int]]]] = {}
                for v in vote:
                    if v["template"] < 0:
                        n = v["diagonal"]
                    elif v["template"] < n_phrases:
                        if len(v["at"]) == lengths[v["template"]] - GRAM + 1:
                            own_places.append({"start": v["diagonal"], "phrase": every[v["template"]][0]})
                    else:
                        by.setdefault(v["template"], []).append((v["diagonal"], v["at"]))
                for t, diagonals in by.items():
                    diagonals.sort(key=lambda x: x[0])
                    groups = [[diagonals[0]]]
                    for d in diagonals[1:]:
                        if d[0] - groups[-1][-1][0] <= NEAR:
                            groups[-1].append(d)
                        else:
                            groups.append([d])
                    for group in groups:
                        spots = in_order([(d + p, p) for d, at in group for p in at])
                        share = len({p + j for _, p in spots for j in range(GRAM)}) / lengths[t]
                        if share >= (SHORT_SHARE if lengths[t] <= SHORT else LONG_SHARE):
                            own_found.append({"label": labels[t], "first": spots[0][0], "last": spots[-1][0] + GRAM - 1, "share": share})
                words.append(n)
                places.append(sorted(own_places, key=lambda x: (x["start"], x["phrase"])))
                found.append(sorted(own_found, key=lambda x: (x["first"], x["last"], x["label"])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words, pa.int64()), pa.array(places, place_type), pa.array(found, found_type)], ["id", "n_words", "places", "found"])

    with small_batches(spark):
        return ws.save(by_text.select("id", "votes").mapInArrow(verified, schema), "found")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license texts in all documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    label_of = F.create_map(*[F.lit(x) for pair in PHRASES for x in pair])
    base = F.transform("places", lambda p: label_of[p["phrase"]])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    starts = F.transform("places", lambda p: p["start"])
    best = F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("found", lambda x: x["label"]))).alias("labels"), best.alias("score"),
    )
