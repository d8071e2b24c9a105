from __future__ import annotations

import hashlib
import textwrap
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quarrymill.llm import licenses
from quarrymill.llm.syncmers import K, anchors_of, edited, fingerprint_documents, likeness, match_positions, op7_syncmer_fingerprints, with_next


def test_anchors_by_brute_force(spark):
    text = " ".join(f"w{i * i % 37}" for i in range(200))
    words = text.split()
    hashes = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    chosen = [i for i in range(len(words) - K + 1) if min(hashes[i : i + K]) in (hashes[i], hashes[i + K - 1])]
    wanted = spark.createDataFrame([(hashes[i : i + K],) for i in chosen], "h array<long>").select(F.hash(*[F.col("h")[j] for j in range(K)])).collect()
    found = spark.createDataFrame([(text,)], "t string").select(anchors_of(F.col("t"))).first()[0]
    assert found == [r[0] for r in wanted] and 0.3 < len(found) / len(words) < 0.5


def test_anchors_depend_on_their_context_only(spark):
    part = " ".join(f"p{i}" for i in range(60))
    rows = spark.createDataFrame([(part,), ("x y z " + part + " q",)], "t string").select(anchors_of(F.col("t")).alias("a")).collect()
    assert set(rows[0]["a"]) <= set(rows[1]["a"])


def test_odd_texts(odd, none):
    found = {r["doc_id"]: r for r in fingerprint_documents(odd.drop("fp")).collect()}
    assert found[4]["fingerprint"] == found[5]["fingerprint"] == found[6]["fingerprint"] == "" and len(found[9]["fingerprint"]) == 8
    assert found[1]["fingerprint"] == found[2]["fingerprint"] == found[3]["fingerprint"]
    assert fingerprint_documents(none).count() == 0


def test_likeness(spark):
    rows = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], []), ([5, 5], [5])], "a array<int>, b array<int>").select(likeness(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == [pytest.approx(4 / 6), 1.0, 0.0, 1.0]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_next(table, none, parts):
    rows = [(i * i, f"t{i}" if i % 5 else None) for i in range(37)]
    found = {r["doc_id"]: (r["text"], r["next_text"]) for r in with_next(table(rows), parts).collect()}
    down = sorted(rows, reverse=True)
    assert found == {i: (t or "", down[(n + 1) % 37][1] or "") for n, (i, t) in enumerate(down)}
    assert with_next(none, parts).count() == 0
    assert [tuple(r) for r in with_next(table([(5, "only")]), parts).collect()] == [(5, "only", "only")]


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("ids", [[5] * 200 + list(range(100)) + [None] * 150, [7] * 60, [None] * 40])
def test_next_where_many_rows_share_an_id(spark, ids, parts):
    """All rows lie on one round trip, along which ids never grow but once."""
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    after = {r["text"]: r["next_text"] for r in with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), parts).collect()}
    seen = ["t0"]
    while after[seen[-1]] != "t0":
        seen.append(after[seen[-1]])
    of = {t: -1 if i is None else i for i, t in rows}
    along = [of[t] for t in seen]
    assert len(seen) == len(rows) and sum(a < b for a, b in zip(along, along[1:] + along[:1])) <= 1


def test_next_of_odd_rows(odd):
    assert with_next(odd).count() == odd.count()


def test_edited(spark):
    rows = spark.createDataFrame([("abcdefgh", "XYZ"), ("abcdefg\U0001f600é", "X"), ("ab", "XY"), ("", "XY")], "a string, b string").select(edited(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == ["abcdefXY", "abcdefX", "ab", ""]


def test_match_positions(spark):
    part = " ".join(f"p{i}" for i in range(80))
    docs = fingerprint_documents(spark.createDataFrame([(1, part), (2, "a b c d e f g h i j k l " + part)], "doc_id long, text string"))
    best = match_positions(docs, docs).where("a_id = 1").orderBy(F.desc("anchors")).first()
    assert best["b_id"] == 2 and best["offset"] > 0 and best["anchors"] > 20


def test_query(spark):
    found = {r["doc_id"]: r for r in op7_syncmer_fingerprints(spark, "/root/testdata/sf0.01").collect()}
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()), reverse=True)
    same = {}
    for n, (i, t) in enumerate(docs):
        after, third, r = docs[(n + 1) % len(docs)][1], len(t) // 3, found[i]
        changed = t[: len(t) - third] + after[:third]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert same.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    long = [r for r in found.values() if r["n_chars"] >= 300]
    assert all(r["near_edited"] > r["near_next"] for r in long) and sum(r["near_edited"] for r in long) / len(long) > 0.6


def test_licence_scan(spark, table, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scanner = licenses.train(docs)
    rows = [
        (1, "prose here.\nReleased under the MIT License.\nmore prose"), (2, "Licensed under CC BY-NC 4.0."), (3, "nothing of the kind\n\n"), (4, None), (5, ""),
        (6, "All rights reserved.\nLicensed under the Apache License, Version 2.0."), (7, "This work is licensed under the GNU General Public License, version 2."),
        (8, "This work is licensed under the Frobnicator Private License, version 9."), (9, "the license of the poet is the poem " * 3), (10, "word " * 30_000),
    ]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(table(rows), scanner).collect()}
    assert {i: found[i]["license"] for i in (1, 2, 3, 4, 5, 7, 10)} == {1: "MIT", 2: "CC-BY-NC", 3: "none", 4: "none", 5: "none", 7: "GPL", 10: "none"}
    assert found[6]["families"] == "Apache-2.0,proprietary" and found[6]["license_paragraphs"] == 2
    assert found[8]["license"] in ("unknown", "none") and found[9]["license"] in ("unknown", "none")
    assert licenses.scan_licenses(odd, scanner).count() == odd.count()
    # Every notice in the corpus, and nothing else.
    told = licenses.scan_licenses(docs, scanner).join(docs, "doc_id")
    notice = F.regexp_extract("text", r"(CC BY-NC|GNU General Public|Apache License|MIT License|All rights reserved)", 1)
    assert told.where((notice != "") != (F.col("license") != "none")).count() == 0


def test_every_template_is_told(spark, table):
    scanner = licenses.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = [(i, f"some words before\n{t}\nand after") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    found = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(table(rows), scanner).collect()}
    assert {i: found[i] for i in found} == {i: f for i, (f, _) in enumerate(licenses.TEMPLATES)}


def test_wrapped_notices_and_other_licences(spark, table):
    """Notices wrapped at 72 columns, behind comment marks too, are met whole; licences of no family are unknown or, if too unlike any, none."""
    scanner = licenses.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    wrapped = [(f, t) for f, t in licenses.TEMPLATES if len(t) > 150]
    rows = [(i, "ande thor inst.\n" + textwrap.fill(t, 72, initial_indent=mark, subsequent_indent=mark) + "\n\nthor ande.") for i, (mark, (_, t)) in enumerate((m, w) for m in ("", "# ") for w in wrapped)]
    found = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(table(rows), scanner).collect()}
    assert [found[i] for i in range(len(rows))] == [f for f, _ in wrapped] * 2
    others = [(i, t) for i, t in enumerate([*licenses.OTHERS, "This work is licensed under the Frobnicator Private License, version 9.", "Distributed under the terms of the Example Community License."])]
    found = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(table(others), scanner).collect()}
    assert set(found.values()) <= {"unknown", "none"} and sum(v == "unknown" for v in found.values()) >= 10


def test_licence_scan_of_nothing(none):
    assert licenses.scan_licenses(none, licenses.train(none)).count() == 0


#: Written lines that are no template, with the family that they state.
STATED = [
    ("MIT", "Code is released under the MIT License"), ("MIT", "This software is distributed under the MIT License."), ("MIT", "License: MIT License"), ("MIT", "Available under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("Apache-2.0", "Released under the Apache License 2.0"), ("Apache-2.0", "This file is licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Available under the Apache License, Version 2.0."), ("GPL", "Licensed under the GNU GPL v3 or later."), ("GPL", "Licensed under the GPL v2."), ("GPL", "Released under the GPL v3 or later"),
    ("GPL", "Distributed under the GNU General Public License, version 2."), ("GPL", "This script is licensed under the GNU GPL version 3."), ("GPL", "SPDX-License-Identifier: GPL-2.0+"), ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0"), ("LGPL", "SPDX-License-Identifier: LGPL-2.1-or-later"), ("LGPL", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL", "Licensed under the LGPL v2.1 or later."), ("AGPL", "SPDX-License-Identifier: AGPL-3.0-only"), ("AGPL", "This program is licensed under the GNU AGPL v3."), ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD", "Licensed under the 3-Clause BSD License."), ("BSD", "Code is licensed under the BSD License."), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("MPL-2.0", "Licensed under the Mozilla Public License, v. 2.0."),
    ("ISC", "SPDX-License-Identifier: ISC"), ("CC0", "SPDX-License-Identifier: CC0-1.0"), ("CC-BY", "This text is licensed under CC BY 4.0."), ("CC-BY-SA", "This article is licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "Photos are licensed under CC BY-NC 4.0."), ("public-domain", "SPDX-License-Identifier: Unlicense"), ("proprietary", "Example Corp. All rights reserved."), ("proprietary", "Copyright 2021 Jane Doe. All Rights Reserved"),
    ("MIT", "SPDX-License-Identifier: MIT-0"), ("CC-BY-SA", "SPDX-License-Identifier: CC-BY-SA-4.0"), ("BSD", "Use of this code is governed by a BSD-style license"),
]
#: Lines of plain prose that hold words of notices.
PROSE = [
    "All rights reserved seats were sold out by noon.", "We all have the rights reserved for citizens.", "The general public was free to use the library.", "He lost his driving license in May.",
    "The museum is open to the public on Sundays.", "She asked for permission to leave the room.", "MIT researchers published a paper on memory.", "The Apache helicopter landed near the river.",
    "Terms and conditions of the lease were permitted to change.", "The software was slow and the warranty had run out.", "A copy of the map was given to each person.", "Version 2.0 of the game came out in spring.",
    "The foundation of the house was laid in 1902.", "The author has a right to be heard.", "You can redistribute the seats between both halls.", "The public domain name was registered last week.",
    "Without limitation, the river spread over the fields.", "The creative director spoke about attribution of paintings.", "The source code of life is written in DNA.", "An international group of students met in Rome.",
    "The fishing license costs ten euros a day.", "Subject to approval, the bridge will open in June.", "No part of the wall was left standing.", "The notice above the door said nothing of use.",
]


def test_written_lines(spark, table):
    """Short forms, SPDX lines and prose with words of notices, alone, behind comment marks and between other lines: precision and recall of at least 0.9."""
    scanner = licenses.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    frames = ["{}", "# {}", " * {}", "thor ande inst\n{}\nande thor"]
    cases = [(family, frame.format(line)) for frame in frames for family, line in [*STATED, *(("none", x) for x in PROSE)]]
    found = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(table([(i, t) for i, (_, t) in enumerate(cases)]), scanner).collect()}
    wrong = [(found[i], *cases[i]) for i in found if found[i] != cases[i][0]]
    right = sum(found[i] == f for i, (f, _) in enumerate(cases) if f != "none")
    told = sum(x != "none" for x in found.values())
    assert len(cases) > 200 and right >= 0.9 * len(STATED) * len(frames) and right >= 0.9 * told, wrong
    assert all(found[i] == "none" for i, (_, t) in enumerate(cases) if "reserved seats" in t)


def test_dual_licences(spark, table):
    scanner = licenses.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = [
        (1, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Linux-syscall-note"), (2, "Dual licensed under the MIT License and the Apache License, Version 2.0."),
        (3, "Licensed under the GNU General Public License, version 3, or under the Mozilla Public License, v. 2.0."),
    ]
    found = {r["doc_id"]: r["families"] for r in licenses.scan_licenses(table(rows), scanner).collect()}
    assert found == {1: "Apache-2.0,GPL,MIT", 2: "Apache-2.0,MIT", 3: "GPL,MPL-2.0"}


def test_training_counts_every_paragraph(spark, table):
    """Paragraphs are counted, none is drawn: more than the 6,000 of an earlier sample, with repeats, without those that share a pair with a template."""
    rows = [(i, "thor ande the\nsoftware ande\nno more\n" * 3 + "Released under the MIT License.") for i in range(1_000)]
    sets = licenses._plain_sets(table(rows), licenses.templates(spark), F.lit(False).alias("calibrates")).collect()
    assert {tuple(r["grams"]): r["n"] for r in sets} == {("the",): 3_000, ("software",): 3_000, ("more", "no"): 3_000}


def test_share_of_weighted_scores(spark):
    scores = spark.createDataFrame([(0.1, 900), (0.5, 90), (0.7, 9), (0.9, 1)], "score double, n long")
    assert [licenses._passed_by(scores, x) for x in (0.0, 0.001, 0.009, 0.01, 0.1, 1.0)] == [0.9, 0.7, 0.7, 0.5, 0.1, 0.1]
    assert licenses._passed_by(scores.where("n = 0"), 0.1) == 0.0


def test_lines_and_words_are_made_once(spark, table):
    """No condition repeats the splitting into lines or words: each stands in the plan as often as it has to run for a text."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    made = plan(licenses.paragraphs_of(table([(1, "a b")]).select("doc_id", "text")))
    assert made.count("split(text") == 1 and made.count("regexp_extract_all(lower(") == 1


def test_what_is_not_worth_scoring_can_not_pass(spark):
    """The condition that spares lines the model leaves no paragraph out that passes the threshold, and spares most plain ones."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scanner = licenses.train(docs)
    texts = [x for _, t in licenses.templates_list() for x in (t, f"thor {t} ande", t[: len(t) // 2], t[len(t) // 2 :])] + [x for _, x in STATED] + PROSE
    own = licenses.paragraphs_of(docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for threshold in (0.0, 0.1, 0.6, 0.99, 1.0):
        asked = replace(scanner, threshold=threshold)
        worth = licenses._worth(asked)
        told = licenses._scored(own, asked).select((1 - F.col("p_none") >= threshold).alias("passes"), (worth(F.col("words")) if worth else F.lit(True)).alias("worth"))
        n = {(r["passes"], r["worth"]): r["count"] for r in told.groupBy("passes", "worth").count().collect()}
        assert n.get((True, False), 0) == 0
        assert threshold != 0.6 or (n[True, True] > 50 and n[False, False] > 5 * n[False, True])


def test_runs_of_lines(spark, table):
    """Runs at the start, amid and at the end of a text, behind SPDX lines, and many in one text; one line alone is none, and texts without a telling word have none."""
    a, b, c = "of the License", "under the terms", "thor ande"
    many = "\n".join([a, b, c] * 2_000)
    rows = [(1, "\n".join([a, b, c, a, c, b, a, b])), (2, f"{a}\n{c}\r\n{b}"), (3, f"SPDX-License-Identifier: MIT OR ISC\n{c}\n{a}\r{b}"), (4, "of the\nof the"), (5, None), (6, ""), (7, many)]
    found = licenses.paragraphs_of(table(rows).select("doc_id", "text"), "(?i)license").where("run").select("doc_id", "paragraph").collect()
    runs = {i: [r["paragraph"] for r in found if r["doc_id"] == i] for i in range(1, 8)}
    assert runs == {1: [f"{a} {b}", f"{b} {a} {b}"], 2: [], 3: [f"{a} {b}"], 4: [], 5: [], 6: [], 7: [f"{a} {b}"] * 2_000}
