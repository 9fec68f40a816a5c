"""Licence paragraphs: known wordings, wordings that no passage has, and prose that licenses nothing."""

import random

import pytest

from gridloom.llm import licenses

SCHEMA = "doc_id long, text string, family string, paragraph int, g_words string"

#: None of these is a passage of the operator; families by their words.
UNSEEN = [
    ("Apache-2.0", "Unless agreed to in writing or required by law, software that is distributed under the License is distributed on an AS IS BASIS, without warranties of any kind."),
    ("MIT", "The Software is provided as is, without warranty of any kind, express or implied, including the warranties of merchantability and fitness for a particular purpose."),
    ("MIT", "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files to deal in the Software without restriction."),
    ("EPL-2.0", "These materials are made available under the terms of the Eclipse Public License 2.0."),
    ("BSL-1.0", "This header is distributed under the Boost Software License, Version 1.0, see the file."),
    ("GPL-2.0", "You can redistribute this tool and modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License."),
    ("GPL-3.0", "The tool is free software, redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License."),
    ("CC-BY", "Pictures on this site are licensed under a Creative Commons Attribution 4.0 International License."),
]

PROSE = [
    "The council granted a license for the market, and the public may attend.",
    "A copy of the notice was sent to every person who had asked for it.",
    "Software is eating the world, said a man who sells software for a living.",
    "Nobody has the right to reproduce without love, the poet wrote.",
    "The foundation publishes a report on free speech every year.",
    "We discussed the terms of the contract under which the band was hired.",
    "The lawyer explained copyright to the class in plain words.",
    "He holds a pilot licence, version two of which was issued in March.",
    "Permission from the parents is needed for the trip to the museum.",
    "All seats in the front row are reserved for the press.",
]


def invented(rng, n):
    return " ".join("".join(rng.choice(["ba", "ri", "to", "mel", "ka", "sun"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(4)
    texts = [invented(rng, rng.randint(1, 90)) + "." for _ in range(120)] + [None, "", " \n ", "one", "two words"]
    texts += [f"{invented(rng, 20)}.\n{t}\n{invented(rng, 9)}." for _, t in UNSEEN]
    texts += [f"{p}\n{invented(rng, 12)}." for p in PROSE]
    texts += ["Intro.\nReleased under the MIT License.\nMore", "This work is licensed under the GNU General Public License, version 3."]
    df = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in enumerate(texts)], SCHEMA)
    return len(texts), df, licenses.scan(df).collect()


def test_known_wordings(found):
    n, _, rows = found
    assert {(r.paragraph, r.family) for r in rows if r.doc_id == n - 2} == {(1, "MIT")}
    assert {(r.paragraph, r.family) for r in rows if r.doc_id == n - 1} == {(0, "GPL-3.0")}


def test_precision_on_prose_and_invented_text(found):
    _, _, rows = found
    false = [r for r in rows if r.doc_id < 125 or 125 + len(UNSEEN) <= r.doc_id < 125 + len(UNSEEN) + len(PROSE)]
    assert not false, false


def test_recall_of_unseen_wordings(found):
    _, _, rows = found
    hit = {r.doc_id - 125: r.family for r in rows if 125 <= r.doc_id < 125 + len(UNSEEN)}
    assert all(r.paragraph == 1 for r in rows if 125 <= r.doc_id < 125 + len(UNSEEN))
    assert len(hit) >= len(UNSEEN) - 1 and sum(UNSEEN[k][0] == f for k, f in hit.items()) >= len(UNSEEN) - 2, hit


def test_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "Released under the MIT License.", "x", 1, "y")] * 2, SCHEMA)
    assert [(r.doc_id, r.family) for r in licenses.scan(df).collect()] == [(None, "MIT")] * 2
    assert licenses.scan(df.limit(0)).isEmpty()


def test_a_round_of_training_is_one_task(spark):
    df = spark.createDataFrame([(k, f"{invented(random.Random(k), 12)}.", "x", 1, "y") for k in range(40)], SCHEMA)
    sc = spark.sparkContext
    sc.setJobGroup("licences", "training")
    try:
        licenses.scan(df)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    seen = sc.statusTracker()
    jobs = [[seen.getStageInfo(s) for s in seen.getJobInfo(j).stageIds] for j in seen.getJobIdsForGroup("licences")]
    rounds = [j for j in jobs if any(s and s.name.startswith("treeAggregate") for s in j)]
    assert rounds and all(len(j) == 1 and j[0].numTasks == 1 for j in rounds)  # the driver holds no earlier stages for a round, and one gradient
