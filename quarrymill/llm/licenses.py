"""Licence scan: a trained classifier of paragraphs, confirmed by templates.

A sparse multinomial logistic regression over the words and word pairs of the templates tells the licence families, `unknown` (licences of no family, learned
from notices of others) and `none` apart. It is trained on variants of notice templates and on all of the corpus's own paragraphs without a word pair of a template. Two thresholds are
calibrated on rows that were not trained on: one separates paragraphs that look like a licence from the rest, the other the families from other
licences. The likeliest family counts if it passes the latter and a template of the family has enough of its word pairs in the paragraph; without that the
paragraph is `unknown`. Further families of which a template stands in a paragraph are told as well (dual licences). Lines are judged one by one, and runs of lines that share word
pairs with templates as one paragraph, so that wrapped notices are met whole. A line with an SPDX expression is one paragraph for each identifier in it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import let, read_table, stage

NONE, UNKNOWN = "none", "unknown"

# Licence families and usual wordings of their notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("GPL", "Licensed under the GPL v3 or later."),
    ("GPL", "Licensed under the GNU GPL v2."),
    ("GPL", "Released under the GNU GPL version 3."),
    ("LGPL", "Licensed under the GNU LGPL v2.1 or later."),
    ("AGPL", "Licensed under the GNU AGPL v3."),
    ("BSD", "Licensed under the BSD License."),
    ("BSD", "Distributed under the 3-Clause BSD License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0."),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("BSD", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND", "Licensed under CC BY-ND 4.0."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher."),
]
# Notices of licences that are no family here.
OTHERS = [
    "Licensed under the EUPL, Version 1.2 or later.",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "This is free software, licensed under the Artistic License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Python Software Foundation License, version 2.",
    "This code is licensed under the Microsoft Public License.",
    "This database is made available under the Open Database License.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
]
# SPDX identifiers of the families, and of licences that are none.
SPDX = {
    "MIT": ["MIT", "MIT-0"],
    "Apache-2.0": ["Apache-2.0"],
    "GPL": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "AGPL": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause"],
    "MPL-2.0": ["MPL-2.0"],
    "ISC": ["ISC"],
    "CC0": ["CC0-1.0"],
    "CC-BY": ["CC-BY-4.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0"],
    "CC-BY-ND": ["CC-BY-ND-4.0"],
    "public-domain": ["Unlicense"],
    UNKNOWN: ["EUPL-1.2", "OFL-1.1", "EPL-2.0", "BSL-1.0", "Zlib", "Artistic-2.0", "MS-PL", "ODbL-1.0", "CDDL-1.0", "PSF-2.0"],
}
SPDX_LINE = r"(?i)SPDX-License-Identifier:\s*(.+)"
#: Words in a template of so few or fewer: it counts only where its sentence ends behind it, not inside a longer one.
SHORT = 3


@dataclass
class Scanner:
    model: LogisticRegressionModel
    families: list[str]  # by class number; the first is NONE
    threshold: float  # of not being NONE
    clear: float  # of a family among all licences
    terms: CountVectorizerModel  # words and word pairs of the templates
    telling: str  # expression for the rarest words of each template: lines are joined only in texts that have one


def words_of(text: Column) -> Column:
    """Lower-cased words of a paragraph: letters and digits, with hyphens and dots inside words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[-.][\p{L}\p{N}]+)*"), F.lit(0))


def pairs_of(words: Column) -> Column:
    return let(words, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))


def _grams(words: Column) -> Column:
    return let(words, lambda w: F.array_union(w, pairs_of(w)))


def _pairs_among(words: Column, pairs: list[str]) -> Column:
    """Those of pairs_of(words) that are among fixed pairs, in order and with repeats. Few words begin one of them: these alone are put together with the next."""
    begin = sorted({p.split(" ")[0] for p in pairs})
    return let(words, lambda w: F.filter(F.transform(w, lambda x, i: F.when(x.isin(begin), F.concat_ws(" ", x, F.get(w, i + 1)))), lambda p: p.isin(pairs)))


def _grams_among(words: Column, terms: list[str]) -> Column:
    """Those of _grams(words) that are among fixed words and word pairs."""
    single, pairs = _apart(terms)
    return let(words, lambda w: F.array_distinct(F.concat(F.filter(w, lambda x: x.isin(single)), _pairs_among(w, pairs))))


def _apart(terms: list[str]) -> tuple[list[str], list[str]]:
    """Single words and word pairs."""
    return [t for t in terms if " " not in t], [t for t in terms if " " in t]


def paragraphs_of(docs: DataFrame, joined_if: str | None = None, worth: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, paragraph, run and words: the lines of every text that hold a word, one for each identifier of an SPDX expression, and, in texts that the expression
    joined_if meets, runs of two and more lines of which each shares a word pair with a template, as one (run). worth: a condition on words that lines (not runs) have to meet."""
    known = sorted({p for _, t in templates_list() for p in _plain_pairs(t)})
    lines = F.split("text", r"\r?\n|\r")
    stated = F.col("text").rlike(SPDX_LINE)

    def runs(lines: Column, hit: Callable[[Column], Column]) -> Column:
        near = lambda i: F.coalesce(hit(i), F.lit(False))
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        starts = F.filter(places, lambda i: near(i) & near(i + 1) & ~near(i - 1))
        ends = F.filter(places, lambda i: near(i) & near(i - 1) & ~near(i + 1))  # of the run that starts at the same place of starts
        return let(ends, lambda e: F.transform(starts, lambda i, k: F.array_join(F.slice(lines, i + 1, F.get(e, k) - i + 1), " ")))

    def marked(units: Column, run: bool) -> Column:
        return F.transform(units, lambda u: F.struct(u.alias("paragraph"), F.lit(run).alias("run")))

    def apart(lines: Column) -> Column:
        named = lambda x: F.regexp_replace(F.regexp_extract(x, SPDX_LINE, 1), r"(?i)\s+WITH\s+\S+", "")
        each = lambda x: F.transform(F.regexp_extract_all(named(x), F.lit(r"(?!(?i:OR|AND)\b)[A-Za-z0-9][A-Za-z0-9.+-]*"), F.lit(0)), lambda i: F.concat(F.lit("SPDX-License-Identifier: "), i))
        return F.flatten(F.transform(lines, lambda x: F.when(x.rlike(SPDX_LINE), each(x)).otherwise(F.array(x))))

    def units(lines: Column) -> Column:
        if joined_if is None and worth is None:
            return marked(F.when(stated, apart(lines)).otherwise(lines), False)
        some = worth or (lambda _: F.lit(True))
        of = lambda w: F.struct((F.size(_pairs_among(w, known)) > 0).alias("hit"), some(w).alias("worth"))

        def kept(told: Column) -> Column:
            single = F.when(stated, F.filter(apart(lines), lambda x: let(words_of(x), some))).otherwise(F.filter(lines, lambda x, i: F.get(told, i)["worth"]))
            if joined_if is None:
                return marked(single, False)
            # Few texts have a run: the expression is only tried on these.
            joined = let(runs(lines, lambda i: F.get(told, i)["hit"]), lambda r: F.when((F.size(r) > 0) & F.col("text").rlike(joined_if), r).otherwise(F.slice(r, 1, 0)))
            return F.concat(marked(single, False), marked(joined, True))

        return let(F.transform(lines, lambda x: let(words_of(x), of)), kept)

    # Outer, since Spark puts a condition on what it explodes before any other explode, and would make lines and words twice; the words are exploded, since a condition on them would.
    split = docs.select("doc_id", F.explode_outer(let(lines, units)).alias("unit")).select("doc_id", "unit.*")
    return split.select("*", F.explode_outer(F.array(F.coalesce(words_of(F.col("paragraph")), F.array().cast("array<string>")))).alias("words")).where(F.size("words") > 0)


def templates_list() -> list[tuple[str, str]]:
    stated = ((f, f"SPDX-License-Identifier: {i}") for f, names in SPDX.items() for i in names)
    return [*TEMPLATES, *((UNKNOWN, t) for t in OTHERS), *stated]


def _plain_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[-.][^\W_]+)*", text.lower())


def _plain_pairs(text: str) -> list[str]:
    words = _plain_words(text)
    return [" ".join(p) for p in zip(words, words[1:])]


def templates(spark: SparkSession) -> DataFrame:
    """family (UNKNOWN for other licences), template and words."""
    rows = ", ".join("('{}', '{}')".format(f, t.replace("\\", "\\\\").replace("'", "\\'")) for f, t in templates_list())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(family, template)").withColumn("words", words_of(F.col("template")))


def _variants(known: DataFrame) -> DataFrame:
    """Each template whole, with each word left out, and as windows of seven tenths of its words."""
    n, long = F.size("words"), F.greatest(F.lit(3), F.ceil(F.size("words") * 0.7).cast("int"))
    without = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.slice("words", F.lit(1), i), F.slice("words", i + 2, n)))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - long + 1, F.lit(1))), lambda i: F.slice("words", i, long))
    return known.select("family", F.explode(F.concat(F.array("words"), F.when(n > 3, without).otherwise(F.array("words")), windows)).alias("words"))


def train(docs: DataFrame, false_alarms: float = 0.0005, mistaken: float = 0.05, before: int = 40, rarest: int = 3, plain_weight: int = 4_500) -> Scanner:
    """Fit on template variants and on all paragraphs of docs that share no word pair with a template. What the model sees of these is which template words they hold, so
    they are counted by that set and learned once each, with their number as weight; in all they weigh plain_weight at most, so that they do not drown the notices.
    A quarter of the paragraphs, by a hash of their words, is kept for calibration: the threshold is what only the share false_alarms of it passes, and 0.6 at least.
    A quarter of the variants of other licences calibrates what is clearly a family: what only the share mistaken of them passes, from 0.5 to 0.9. Notices are also
    learned behind plain paragraphs: each set of words stands before as many notices as give each notice `before` of them at least, where there are so many, and these weigh
    `before` for each notice. The `rarest` words of each template, by the number of plain paragraphs with them, tell which texts may hold a wrapped notice.
    """
    spark = docs.sparkSession
    known = templates(spark)
    families = [NONE, UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
    vocabulary = sorted(r[0] for r in known.select(F.explode(_grams(F.col("words")))).distinct().collect())
    terms = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)
    number = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(families) for x in (f, float(i))]), F.col("family"))
    calibrates = (F.xxhash64("words") % 4 == 0).alias("calibrates")
    plain = stage(_plain_sets(docs, known, calibrates), "plain")
    learned = plain.where("not calibrates").drop("calibrates")
    sets, there = learned.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    variants = _variants(known).withColumn("calibrates", (F.col("family") == UNKNOWN) & calibrates)
    notices = known.withColumn("t", F.row_number().over(Window.orderBy("family", "template")) - 1).select("family", "t", _grams(F.col("words")).alias("notice"))
    many = len(templates_list())
    each = min(many, -(-before * many // max(1, sets)))
    behind = learned.select("grams", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("k")).select("grams", F.pmod(F.xxhash64("grams") + F.col("k"), F.lit(many)).alias("t"))
    behind = behind.join(F.broadcast(behind.groupBy("t").count()), "t").join(F.broadcast(notices), "t")
    embedded = behind.select("family", F.array_union("grams", "notice").alias("grams"), F.least(F.lit(1.0), before / F.col("count")).alias("weight"))
    rows = variants.where("not calibrates").select("family", _grams(F.col("words")).alias("grams"), F.lit(1.0).alias("weight")).unionByName(embedded)
    rows = rows.unionByName(learned.select(F.lit(NONE).alias("family"), "grams", (F.col("n") * (min(plain_weight, there) / max(1, there))).alias("weight")))
    rows = stage(terms.transform(rows.withColumn("label", number)).select("label", "features", "weight"), "licence_training")
    # No corpus paragraph may be left to learn `none` from; an empty one still says what no licence looks like.
    model = LogisticRegression(maxIter=50, regParam=0.0005, elasticNetParam=0.5, family="multinomial", weightCol="weight").fit(rows).setRawPredictionCol("").setPredictionCol("")
    open_ = Scanner(model, families, 1.0, 1.0, terms, _telling(plain, rarest))
    calm = _passed_by(_told(plain.where("calibrates"), open_).select((1 - F.col("p_none")).alias("score"), "n"), false_alarms)
    clear = _scored(variants.where("calibrates").select("words"), open_).agg(F.percentile_approx(F.col("sure") / (1 - F.col("p_none")), 1 - mistaken, 10_000)).first()[0]
    return Scanner(model, families, max(0.6, calm), min(0.9, max(0.5, clear or 0.0)), terms, open_.telling)


def _plain_sets(docs: DataFrame, known: DataFrame, calibrates: Column) -> DataFrame:
    """grams, calibrates and n: the sets of template words that paragraphs without a word pair of a template hold, and how many paragraphs hold each."""
    terms = sorted(r[0] for r in known.select(F.explode(_grams(F.col("words")))).distinct().collect())
    words, pairs = _apart(terms)
    plain = paragraphs_of(docs.select("doc_id", "text")).where(F.size(_pairs_among(F.col("words"), pairs)) == 0)
    grams = F.array_sort(F.array_distinct(F.filter("words", lambda w: w.isin(words))))
    return plain.select(grams.alias("grams"), calibrates).groupBy("grams", "calibrates").agg(F.count("*").alias("n"))


def _passed_by(scores: DataFrame, share: float, bins: int = 1 << 16) -> float:
    """The score (0 to 1) that no more than a share of rows (score, n times) is above, to one bin: the greatest score of its bin. 0 if there are no rows."""
    counts = scores.groupBy(F.floor(F.col("score") * bins).alias("bin")).agg(F.sum("n").alias("n"), F.max("score").alias("most")).toPandas().sort_values("bin", ascending=False)
    above = counts["n"].cumsum() - counts["n"]
    fit = counts["most"][above <= share * counts["n"].sum()]
    # The last bin that still fits above which no more than the share lies.
    return float(fit.iloc[-1]) if len(fit) else 0.0


def _telling(plain: DataFrame, rarest: int) -> str:
    """An expression that meets the rarest words of each template, by the plain paragraphs with them (ties: the longer, then the first in order). Branches by first letter keep it fast."""
    seen = plain.select(F.explode("grams").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    often = {r["word"]: r["n"] for r in seen.collect()}
    kept = sorted({w for _, t in templates_list() for w in sorted(set(_plain_words(t)), key=lambda w: (often.get(w, 0), -len(w), w))[:rarest]})
    by_letter = {w[0]: "|".join(re.escape(x[1:]) for x in kept if x[0] == w[0]) for w in kept}
    return r"(?i)\b(?:" + "|".join(f"{re.escape(c)}(?:{rest})" for c, rest in by_letter.items()) + r")\b"


def _scored(paragraphs: DataFrame, scanner: Scanner) -> DataFrame:
    """Adds p_none, guess (the likeliest family) and sure (its probability) to paragraphs with words."""
    return _told(paragraphs.withColumn("grams", _grams_among(F.col("words"), scanner.terms.vocabulary)), scanner)


def _told(grams: DataFrame, scanner: Scanner) -> DataFrame:
    told = scanner.model.transform(scanner.terms.transform(grams)).withColumn("p", vector_to_array("probability"))
    families = scanner.families[2:]
    told = told.withColumn("sure", F.array_max(F.slice("p", 3, len(families))))
    told = told.withColumn("guess", F.element_at(F.array(*map(F.lit, families)), F.array_position(F.slice("p", 3, len(families)), F.col("sure")).cast("int")))
    return told.withColumn("p_none", F.element_at("p", 1)).drop("p", "grams", "features", "probability")


def _worth(scanner: Scanner) -> Callable[[Column], Column] | None:
    """A condition on words that every paragraph meets that may pass the threshold. What the terms in it speak for licences over `none` adds up: of each the most that it does for
    any class, rounded up to halves. A paragraph that stays below what the threshold asks for beyond the intercepts can't pass, and needs no model. None: all may pass."""
    weights, start = scanner.model.coefficientMatrix.toArray(), scanner.model.interceptVector.toArray()
    speaks = np.ceil(2 * (weights[1:] - weights[0]).max(axis=0)) / 2
    threshold = min(scanner.threshold, 1 - 1e-12)
    asked = math.log(threshold / (1 - threshold)) - float(np.logaddexp.reduce(start[1:] - start[0])) - 1e-6 if threshold > 0 else 0.0
    if asked <= 0:
        return None
    levels: dict[float, list[str]] = {}
    for term, level in zip(scanner.terms.vocabulary, speaks.tolist()):
        if level > 0:
            levels.setdefault(level, []).append(term)
    speaking = [t for terms in levels.values() for t in terms]

    def least(g: Column) -> Column:
        level = F.lit(0.0)
        for value, terms in levels.items():
            level = F.when(g.isin(terms), value).otherwise(level)
        return level

    return lambda words: F.aggregate(_grams_among(words, speaking), F.lit(0.0), lambda a, g: a + least(g)) >= asked


def scan_paragraphs(docs: DataFrame, scanner: Scanner, confirm: float = 0.6) -> DataFrame:
    """Paragraphs that look like a licence: doc_id, paragraph, run, family (or `unknown`), also (further families), sure, overlap.

    confirm: share of a template's word pairs that the paragraph has to have, or of the paragraph's that the template has, before the family counts. Half
    of the template's pairs that no other family has are asked for as well, and that the family is clear among licences. A further family counts if a paragraph has
    all those pairs of one of its templates, one at least, and the share confirm of all its pairs. A template of up to SHORT words counts only as the
    end of a sentence: a paragraph that has it elsewhere, and no other template, is prose and left out.
    """
    suspect = _scored(paragraphs_of(docs.select("doc_id", "text"), scanner.telling, _worth(scanner)), scanner).where(1 - F.col("p_none") >= scanner.threshold)
    own = F.col("own")
    share = lambda part: F.coalesce(F.size(F.array_intersect(part, own)) / F.nullif(F.size(part), F.lit(0)), F.lit(1.0))
    covered = lambda pairs: F.coalesce(F.size(F.array_intersect(pairs, own)) / F.nullif(F.size(own), F.lit(0)), F.lit(1.0))

    def ends(words: Column, closed: bool) -> Column:
        """Whether the paragraph has these words on end, and, if closed, a sentence that ends behind them."""
        behind = r"\s*(?:[^\p{L}\p{N}\s]|$)" if closed else r"(?![\p{L}\p{N}])"
        return F.rlike("paragraph", F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}])"), F.array_join(words, r"[^\p{L}\p{N}]+"), F.lit(behind)))

    def judged(t: Column) -> Column:
        short = (F.size(t["words"]) <= SHORT) & ~t["stated"]
        met = F.when(short & ~ends(t["words"], True), 0.0).when(share(t["telling"]) >= 0.5, F.greatest(share(t["pairs"]), covered(t["pairs"]))).otherwise(0.0)
        whole = (met > 0) & (F.size(t["telling"]) > 0) & (share(t["telling"]) == 1.0) & (share(t["pairs"]) >= confirm)
        return F.struct(t["family"].alias("family"), met.alias("met"), whole.alias("whole"), (short & ends(t["words"], False) & ~ends(t["words"], True)).alias("inside"))

    # The pairs are exploded, so that they are made once, not for each template.
    suspect = suspect.select("*", F.explode_outer(F.array(F.array_distinct(pairs_of(F.col("words"))))).alias("own"))
    told = suspect.join(F.broadcast(_known(docs.sparkSession))).withColumn("told", F.transform("known", judged)).drop("known", "own")
    told = told.withColumn("overlap", F.array_max(F.transform(F.filter("told", lambda t: t["family"] == F.col("guess")), lambda t: t["met"])))
    sure = (F.col("overlap") >= confirm) & (F.col("sure") >= scanner.clear * (1 - F.col("p_none")))
    whole = F.array_sort(F.array_distinct(F.transform(F.filter("told", lambda t: t["whole"]), lambda t: t["family"])))
    told = told.withColumn("whole", whole).withColumn("family", F.when(sure, F.col("guess")).otherwise(F.coalesce(F.get("whole", F.lit(0)), F.lit(UNKNOWN))))
    prose = (F.col("family") == UNKNOWN) & F.exists("told", lambda t: t["inside"])
    return told.where(~prose).select("doc_id", "paragraph", "run", "family", F.array_except("whole", F.array("family")).alias("also"), "sure", "overlap")


def _known(spark: SparkSession) -> DataFrame:
    """One row, known: of each template of a family its words, its pairs, those of them that no other family has (telling), and whether it is an SPDX line (stated)."""
    pairs = templates(spark).where(F.col("family") != UNKNOWN).withColumn("pairs", F.array_distinct(pairs_of(F.col("words")))).withColumn("stated", F.col("template").rlike(SPDX_LINE))
    common = pairs.select("family", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.countDistinct("family").alias("n")).where("n > 1").agg(F.collect_set("pair").alias("common"))
    return pairs.join(F.broadcast(common)).agg(F.collect_list(F.struct("family", "words", "pairs", F.array_except("pairs", "common").alias("telling"), "stated")).alias("known"))


def scan_licenses(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, license (the family that is surest, `unknown` if paragraphs look like a licence
    but none is confirmed, else `none`), families (all confirmed ones, sorted, comma between), confidence, license_paragraphs.

    license_paragraphs counts lines, or runs of lines if no line is one by itself. Ties of confidence go to the first name. Very long texts are scanned whole. Null and empty texts have `none`. Rows that share a doc_id get one verdict for
    all their texts. Extra columns are ignored.
    """
    found = scan_paragraphs(docs, scanner)
    confirmed = F.col("family") != UNKNOWN
    verdict = found.groupBy(F.col("doc_id").alias("_id")).agg(
        F.min(F.struct((~confirmed).alias("open"), (-F.col("sure")).alias("less"), "family")).alias("best"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_union("also", F.when(confirmed, F.array("family")).otherwise(F.array().cast("array<string>"))))))), ",").alias("families"),
        F.coalesce(F.nullif(F.count_if(~F.col("run")), F.lit(0)), F.count("*")).alias("license_paragraphs"),
    )
    return docs.select("doc_id").join(verdict, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id",
        F.coalesce("best.family", F.lit(NONE)).alias("license"),
        F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce(-F.col("best.less"), F.lit(0.0)).alias("confidence"),
        F.coalesce("license_paragraphs", F.lit(0).cast("long")).alias("license_paragraphs"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs, train(docs))
