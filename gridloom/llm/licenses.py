"""Licence scans in DataFrame operations alone.

Paragraphs are classified by a multinomial logistic regression over hashed word 1- and
2-grams. It is trained on the licence passages below in several wordings, on prose about
licences that grants none, and on a bounded sample of the corpus, the latter two as class
``none``. A sample it hasn't seen calibrates the probability of being a licence. A predicted
family is confirmed by comparison with its passages; a paragraph that is almost surely a
licence and shares several telling word pairs with licence texts, but that no passage of the
family confirms, is ``unknown``.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import table

FEATURES = 1 << 14
#: Paragraphs of the corpus that train class none, and that calibrate, at most.
SAMPLE, CALIBRATE = 2000, 2000
#: Share of word pairs that confirms a family; calibrated probability of a licence, and of an unknown one with so many telling pairs.
CONFIRM, LEAST, UNKNOWN, TELLING = 0.6, 0.5, 0.9, 4
#: What a licence is to a paragraph of none in the calibrating sample.
RARITY = 0.3

TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "Licensed under GPL v3", "under the terms of the GPLv3", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "Licensed under GPL v2", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1 or later.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "nor the names of its contributors may be used to endorse or promote products derived", "Redistributions of source code must retain the above copyright notice", "Redistributions in binary form must reproduce the above copyright notice", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "SPDX-License-Identifier: MPL-2.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0 1.0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without permission."],
}

#: Prose about licences, permission, copyright and software that licenses nothing, and plain prose.
NEGATIVES = """She passed her driving test and got her licence in the spring.
You need a fishing license to use the lake, and the permission of the owner.
The committee argued about copyright law for three hours without a decision.
He was granted permission to leave the hospital on Friday.
The software is fast, but the documentation files are hard to read.
Our restaurant has applied for a liquor license, free of charge for charities.
A warranty of two years covers the engine, express delivery is not included.
The public library is open to any person with a card.
The general public was asked to stay away from the foundation.
The author has published a second version of the novel, copies of which are sold out.
Students may use any material in the room and copy the notes from the board.
The court found that the license had been obtained without restriction in 1998.
Which license should I choose for my project? Many people ask this question.
The apache helicopter landed near the village of Boston.
They study at MIT and at a university in the north.
The terms of the agreement were discussed, and the contributors agreed to meet again.
In this section we discuss the notice that was sent to all members.
Rights of workers were reserved for a later debate in parliament.
Creative people share common traits, the attribution of success is hard.
The source code of the game leaked before the binary was finished.
We permit dogs in the garden as long as they are kept on a lead.
The products derived from milk are sold at the market in the old town.
Any later version of the plan must be approved by the council.
The domain of the function is the set of all public numbers.
This program on television was watched by two million people.
The weather was fine and the children played in the garden all day.
Add the flour and the butter, then stir until the dough is smooth.
The results of the study show that sleep is good for the memory.
The train leaves at nine and arrives in the capital before noon.
Distributed systems fail in ways that single machines never do.""".splitlines()


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}.]+|\.(?=\s|$)"), lambda w: w != "")


def _features(df: DataFrame) -> DataFrame:
    """Adds ``g_x``, the hashed 1- and 2-grams of ``g_words``."""
    pairs = NGram(n=2, inputCol="g_words", outputCol="g_pairs").transform(df)
    grams = pairs.withColumn("g_grams", F.concat("g_words", "g_pairs"))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="g_grams", outputCol="g_x").transform(grams).drop("g_pairs", "g_grams")


def _shingles(ws: Column) -> Column:
    return F.when(F.size(ws) >= 2, F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1)))).otherwise(F.transform(ws, lambda w: F.xxhash64(w)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph`` (number from 0), ``g_text`` for each paragraph that has a word.

    A line is one, with the lines that go on with its sentence: those that start in lower case
    after one that doesn't end as a sentence does."""
    parts = F.split(F.coalesce("text", F.lit("")), r"\r?\n(?!\s*\p{Ll})|(?<=[.!?:;])\r?\n")
    split = docs.select("doc_id", F.posexplode_outer(parts).alias("paragraph", "g_text"))
    return split.where(F.col("g_text").rlike(r"[\p{L}\p{N}]"))


def _passages(spark) -> tuple[list[tuple[str, list[int]]], Column]:
    """Family and word pairs of each passage, and an array of the telling pairs of them all, those
    without pairs of function words; both are fixed lists."""
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    words = spark.createDataFrame(rows, "g_name string, g_t string").select("g_name", _tokens(F.col("g_t")).alias("g_t"))
    found = words.select("g_name", "g_t", _shingles(F.col("g_t")).alias("g_pairs")).collect()
    plain = set("a an and any as at be by for from in is it its may no not of on or that the this to under with you".split())
    telling = sorted({s for r in found for x, y, s in zip(r.g_t, r.g_t[1:], r.g_pairs) if not {x, y} <= plain})
    return [(r.g_name, list(dict.fromkeys(r.g_pairs))) for r in found], F.lit(telling).cast("array<bigint>")


def _wordings(text: str) -> list[str]:
    ws = text.split()
    return [text, text.lower(), text.upper(), "Note: " + text, text + " See the file for details.", "Copyright 2020 the authors. " + text, " ".join(ws[: max(4, len(ws) * 2 // 3)]), " ".join(ws[len(ws) // 3 :] if len(ws) > 8 else ws)]


def train(docs: DataFrame, fixed: tuple[list[tuple[str, list[int]]], Column] | None = None):
    """Model, names of its classes, and slope and intercept that calibrate the log odds of a licence.

    Paragraphs that share most word pairs with a passage, or ``TELLING`` telling ones with any,
    aren't taken for class none. What trains is written first, as one sorted part: each round of a
    fit is a job of one task over that table, and sends the driver one gradient."""
    spark = docs.sparkSession
    passages, telling = fixed or _passages(spark)
    families = ["none", *TEMPLATES]
    rows = [(float(k), v) for k, f in enumerate(families[1:], 1) for t in TEMPLATES[f] for v in _wordings(t)] + [(0.0, v) for t in NEGATIVES for v in (t, t.lower())]
    given = spark.createDataFrame(rows, "label double, g_text string").withColumn("g_words", _tokens(F.col("g_text")))
    picked = paragraphs(docs).select("g_text", F.xxhash64("g_text", "doc_id").alias("g_h")).orderBy("g_h", "g_text").limit(SAMPLE + CALIBRATE)
    drawn = table(picked.dropDuplicates(["g_text"]).withColumn("g_words", _tokens(F.col("g_text"))).withColumn("g_row", F.monotonically_increasing_id()), "license-sample")
    own = drawn.select("g_row", F.explode(F.array_distinct(_shingles(F.col("g_words")))).alias("g_s"))
    theirs = spark.createDataFrame([(k, len(pairs), s) for k, (_, pairs) in enumerate(passages) for s in pairs], "g_k int, g_n int, g_s long")
    alike = own.join(F.broadcast(theirs), "g_s").groupBy("g_row", "g_k", "g_n").count().where(F.col("count") >= 0.5 * F.col("g_n")).select("g_row").distinct()  # passages are a fixed list
    drawn = drawn.where(F.size(F.array_intersect(_shingles(F.col("g_words")), telling)) < TELLING)
    half = F.pmod(F.xxhash64("g_h", F.lit(2)), F.lit(2)) == 0
    none = drawn.join(alike, "g_row", "left_anti").select(F.lit(0.0).alias("label"), "g_words", half.alias("g_fit"), F.when(~half, 1.0).alias("g_w"))
    either = none.unionByName(given.select("label", "g_words", F.lit(True).alias("g_fit"), F.lit(RARITY).alias("g_w")))
    data = table(_features(either.coalesce(1).sortWithinPartitions("label", "g_words")).select("label", "g_fit", "g_w", "g_x"), "license-training")
    fit = LogisticRegression(featuresCol="g_x", labelCol="label", family="multinomial", regParam=1e-4, maxIter=60, probabilityCol="g_p", rawPredictionCol="g_raw", predictionCol="g_k")
    model = fit.fit(data.where("g_fit").coalesce(1))
    seen = model.transform(data.where("g_w is not null")).select((F.col("label") > 0).cast("double").alias("label"), "g_w", _log_odds(F.col("g_p")).alias("g_o"))
    odds = table(VectorAssembler(inputCols=["g_o"], outputCol="g_v").transform(seen.coalesce(1)), "license-odds")
    fitted = LogisticRegression(featuresCol="g_v", labelCol="label", weightCol="g_w", regParam=1e-3, maxIter=20).fit(odds.coalesce(1))
    return model, families, (max(0.0, float(fitted.coefficients[0])), float(fitted.intercept))


def _log_odds(p: Column) -> Column:
    none = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.get(vector_to_array(p), 0)))
    return F.log((1 - none) / none)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, family, probability, similarity`` of licence paragraphs.

    ``probability`` is the calibrated one of being a licence of any family. ``similarity`` is the
    share of word pairs of the shorter of paragraph and passage that the other has; below
    ``CONFIRM`` the family is ``unknown``. Of families with equal probability the first listed
    counts. Null, empty and other texts give no row; repeated rows give repeated results; an
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    passages, telling = fixed = _passages(spark)
    model, families, (slope, intercept) = train(docs, fixed)
    read = paragraphs(docs).withColumn("g_words", _tokens(F.col("g_text")))
    odds = F.lit(slope) * _log_odds(F.col("g_p")) + F.lit(intercept)
    scored = model.transform(_features(read)).select("doc_id", "paragraph", "g_words", (1 / (1 + F.exp(-odds))).alias("probability"), vector_to_array("g_p").alias("g_p"))
    rest = F.slice("g_p", 2, len(families) - 1)
    best = F.get(F.array(*[F.lit(f) for f in families[1:]]), F.array_position(rest, F.array_max(rest)).cast("int") - 1)
    likely = scored.where(F.col("probability") >= F.lit(LEAST)).select("doc_id", "paragraph", "g_words", best.alias("g_family"), "probability")
    templates = spark.createDataFrame([(f, [pairs for g, pairs in passages if g == f]) for f in TEMPLATES], "g_name string, g_ts array<array<bigint>>")
    own = likely.withColumn("g_s", F.array_distinct(_shingles(F.col("g_words"))))
    joined = own.join(F.broadcast(templates), F.col("g_family") == F.col("g_name"))  # as many rows as families
    share = F.array_max(F.transform("g_ts", lambda t: F.size(F.array_intersect(t, F.col("g_s"))) / F.least(F.size(t), F.size("g_s"))))
    out = joined.withColumn("similarity", share)
    confirmed = F.col("similarity") >= CONFIRM
    like = (F.col("probability") >= UNKNOWN) & (F.size(F.array_intersect("g_s", telling)) >= TELLING)
    return out.where(confirmed | like).select("doc_id", "paragraph", F.when(confirmed, F.col("g_family")).otherwise("unknown").alias("family"), "probability", "similarity")
