"""License scan by diagonal voting.

All rolling word k-gram hashes of all texts are joined with the positions where license
templates hold them. Every match votes for its diagonal, the text's position less the
template's; neighbouring diagonals that a few inserted or lost words part are merged, and what
gathers enough votes is a span, which is verified word by word against its template.

Besides, the base finds fixed phrases. Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after
lower-casing A-Z. Defined results: null or wordless text has no words, no places and
score 0; equal rows are judged apart but alike; other columns are ignored.
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnowry.llm.decontaminate import normalised
from winnowry.llm.staging import row_key, small_batches, staged
from winnowry.llm.textops import WORDS, grams, hash_runs, pieces, signed, spans

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: The notices that projects put into their files under these licenses.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
}

K = 4
#: Words by which neighbouring diagonals may differ and be one; share of a template's grams that a span's votes must reach; share of its words that must be verified.
NEIGHBOUR, VOTES, VERIFIED = 8, 0.3, 0.5


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mapped = WORDS[data]
    starts, ends, first = spans(mapped, offsets)
    return hash_runs(mapped, starts, ends), first


def one_text(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[0]


def digest(batches):
    """For mapInArrow: number of words, places of phrases and their labels."""
    wanted = [(one_text(p), label) for p, label in PHRASES.items()]
    for rows, data, offsets in pieces(batches):
        words, first = word_hashes(data, offsets)
        n = len(first) - 1
        places, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
        labels: list[set[str]] = [set() for _ in range(n)]
        for phrase, label in wanted:
            size = len(phrase)
            if len(words) < size:
                continue
            hit = np.ones(len(words) - size + 1, bool)
            for j, h in enumerate(phrase):
                hit &= words[j : len(words) - size + 1 + j] == h
            at = np.flatnonzero(hit)
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + size <= first[doc + 1]
            at, doc = at[inside], doc[inside]
            np.add.at(places, doc, 1)
            np.minimum.at(low, doc, at - first[doc])
            np.maximum.at(high, doc, at - first[doc])
            for d in np.unique(doc):
                labels[d].add(label)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("row"), pa.array(np.diff(first)), pa.array(places), pa.array(low, mask=places == 0), pa.array(high, mask=places == 0), pa.array([sorted(x) for x in labels], pa.list_(pa.string()))], ["doc_id", "row", "n_words", "n_base", "first_word", "last_word", "base"])


def rolling(k: int):
    """For mapInArrow: (row, position, hash) of every word k-gram of every text."""

    def run(batches):
        for rows, data, offsets in pieces(batches):
            words, first = word_hashes(data, offsets)
            h, begin = grams(words, first, k)
            n = np.diff(begin)
            at = np.arange(len(h)) - np.repeat(begin[:-1], n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows.column("row").to_numpy(), n)), pa.array(at.astype(np.int32)), pa.array(signed(h))], ["row", "at", "hash"])

    return run


def template_grams(spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    rows = []
    for name, text in templates.items():
        w = one_text(text)
        h, _ = grams(w, np.array([0, len(w)]), k)
        rows += [(name, i, int(x)) for i, x in enumerate(signed(h))]
    return spark.createDataFrame(rows, "template string, place int, hash long")


def verify(templates: dict[str, str]):
    """For mapInArrow over (row, text, spans): the spans with the share of template words that stand in them in order."""
    known = {name: [w.decode() for w in normalised(text)] for name, text in templates.items()}

    def run(batches):
        for rows in batches:
            out = []
            for row, text, found in zip(*(rows.column(c).to_pylist() for c in ("row", "text", "spans")), strict=True):
                words = [w.decode() for w in normalised(text)]
                for s in found:
                    own, template = words[s["first"] : s["last"] + 1], known[s["template"]]
                    match = sum(b.size for b in difflib.SequenceMatcher(None, own, template, autojunk=False).get_matching_blocks())
                    out.append((row, s["template"], s["first"], s["last"], match / len(template)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()))], ["row", "template", "first", "last", "share"])

    return run


def license_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = K) -> DataFrame:
    """(row, template, first, last, share) of verified spans; docs: row, text."""
    # a few hundred rows, given by the operator's own templates
    votes = docs.mapInArrow(rolling(k), "row long, at int, hash long").join(F.broadcast(template_grams(docs.sparkSession, templates, k)), "hash")
    diagonal = votes.groupBy("row", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"))
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(line) > NEIGHBOUR
    band = diagonal.withColumn("band", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(line))
    merged = band.groupBy("row", "template", "band").agg(F.sum("votes").alias("votes"), F.min("low").alias("first"), (F.max("high") + k - 1).alias("last"))
    least = F.element_at(F.create_map(*[x for name, text in templates.items() for x in (F.lit(name), F.lit(max(1.0, VOTES * (len(normalised(text)) - k + 1))))]), F.col("template"))
    found = merged.where(F.col("votes") >= least).groupBy("row").agg(F.collect_list(F.struct("template", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))).alias("spans"))
    texts = docs.select("row", "text").join(staged(found, "spans"), "row").dropDuplicates(["row"])
    return texts.mapInArrow(verify(templates), "row long, template string, first long, last long, share double").where(F.col("share") >= VERIFIED)


def find_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base and labels (arrays), spans and score: the best share verified, half of what lacks to 1 added if a phrase stands there."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text", row_key().alias("row"))
    found = license_spans(texts.select("row", "text")).groupBy("row").agg(F.collect_list(F.struct("template", "first", "last", "share")).alias("spans"))
    all_rows = texts.mapInArrow(digest, "doc_id long, row long, n_words long, n_base long, first_word long, last_word long, base array<string>").join(found, "row", "left")
    names = F.coalesce(F.transform("spans", lambda s: s["template"]), F.array().cast("array<string>"))
    best = F.least(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)), F.lit(1.0))
    return all_rows.withColumn("labels", F.array_sort(F.array_union("base", names))).withColumn("score", F.when(F.col("n_base") > 0, 1 - (1 - best) / 2).otherwise(best)).drop("row")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
