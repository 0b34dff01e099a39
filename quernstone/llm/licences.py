"""Licence families of paragraphs: a trained classifier over sparse word n-grams.

A multinomial logistic regression over the words and word pairs of a paragraph tells
licence families and an unknown class apart. It is trained on the driver from the
templates below: whole, shortened and extended with other words; for the unknown class from
mixtures of their words, from a third of a template's words amid others, and from sentences that
speak of licences but give none. The probability below which a prediction is unknown is the one
that all but ``false_rate`` of held-out texts of the unknown class stay under. A prediction stands only where enough of a
template of that family is found in the paragraph. An expression of several SPDX identifiers is
named by one of their families; families that aren't listed are unknown.

A paragraph is a line or a run of lines, so a notice is found however it is wrapped: the
lines after each line are added one by one, as long as fewer words stand between than twice
the longest template has. Of runs of one family that share a line the first and shortest
counts.

Scanning uses DataFrame functions only. A paragraph with the required share of some
template holds one of that template's cue words, which are chosen so that too few n-grams
are left without them; all others are unknown, whatever their probability, and go no
further. Paragraphs with a cue word are split into n-grams, which join the weights, a table
of fixed size; sums, probabilities and template shares follow from aggregates.

Defined cases: null and empty texts have no paragraphs and no families; rows that repeat
doc_id and text give a row each; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm._store import written

# Notices by which works name their licence, by family.
TEMPLATES = {
    "Apache-2.0": ["licensed under the apache license version 2.0", "distributed under the apache license 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0", "spdx-license-identifier apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"],
    "MIT": ["released under the mit license", "licensed under the mit license", "this project is mit licensed", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "spdx-license-identifier mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"],
    "BSD": ["licensed under the bsd license", "released under the 3-clause bsd license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "spdx-license-identifier bsd-3-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"],
    "GPL": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "released under the gpl version 2", "licensed under the gnu gpl v3", "spdx-license-identifier gpl-3.0", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness", "you should have received a copy of the gnu general public license along with this program"],
    "LGPL": ["licensed under the gnu lesser general public license version 2.1", "this library is free software under the terms of the gnu lesser general public license", "released under the lgpl", "you should have received a copy of the gnu lesser general public license along with this library"],
    "AGPL": ["licensed under the gnu affero general public license version 3", "released under the agpl", "you should have received a copy of the gnu affero general public license along with this program"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0"],
    "CC-BY": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-SA": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "CC-BY-NC": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CC0": ["to the extent possible under law the author has waived all copyright and related rights", "released into the public domain under cc0 1.0", "this work is dedicated to the public domain"],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license", "spdx-license-identifier isc"],
    "EPL-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license", "licensed under the eclipse public license version 2.0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "spdx-license-identifier unlicense"],
    "proprietary": ["all rights reserved", "copyright all rights reserved", "confidential and proprietary unauthorized copying is strictly prohibited"],
}
TEMPLATES |= {
    "Zlib": ["this software is provided as-is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "this notice may not be removed or altered from any source distribution", "licensed under the zlib license"],
    "BSL-1.0": ["distributed under the boost software license version 1.0", "see accompanying file license_1_0.txt or copy at http www.boost.org license_1_0.txt", "licensed under the boost software license"],
    "Artistic-2.0": ["licensed under the artistic license 2.0", "you can redistribute it and or modify it under the same terms as perl itself", "released under the terms of the artistic license"],
    "EUPL": ["licensed under the european union public licence", "licensed under the eupl version 1.2 or as soon they will be approved by the european commission subsequent versions of the eupl"],
}
# SPDX identifiers and titles by family; each makes a template "spdx-license-identifier <id>", or of its own.
SPDX = {
    "Apache-2.0": "Apache-2.0", "MIT": "MIT", "BSD": "BSD-2-Clause BSD-3-Clause 0BSD", "GPL": "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later",
    "LGPL": "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later", "AGPL": "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later", "MPL-2.0": "MPL-2.0", "CC-BY": "CC-BY-4.0", "CC-BY-SA": "CC-BY-SA-4.0",
    "CC-BY-NC": "CC-BY-NC-4.0", "CC0": "CC0-1.0", "ISC": "ISC", "EPL-2.0": "EPL-2.0", "Unlicense": "Unlicense", "Zlib": "Zlib", "BSL-1.0": "BSL-1.0", "Artistic-2.0": "Artistic-2.0", "EUPL": "EUPL-1.2",
}
TITLES = {
    "Apache-2.0": ["apache license version 2.0"], "MIT": ["mit license"], "BSD": ["bsd license", "bsd 3-clause license", "bsd 2-clause license"], "GPL": ["gnu general public license", "licensed under gpl-3.0-or-later", "licensed under gpl-2.0-only"],
    "LGPL": ["gnu lesser general public license"], "AGPL": ["gnu affero general public license"], "MPL-2.0": ["mozilla public license"], "ISC": ["isc license"], "EPL-2.0": ["eclipse public license"], "Zlib": ["zlib license"], "BSL-1.0": ["boost software license"], "Artistic-2.0": ["artistic license"], "EUPL": ["european union public licence"],
}
for _family in TEMPLATES:
    _own = [f"spdx-license-identifier {i.lower()}" for i in SPDX.get(_family, "").split()] + TITLES.get(_family, [])
    TEMPLATES[_family] = [*dict.fromkeys([*TEMPLATES[_family], *_own])]
# Sentences that speak of licences, rights or software and give no licence.
NO_LICENCE = [
    "his driver license was renewed at the office last year", "a fishing licence is valid for one season in this state", "the pub lost its licence to sell alcohol after the fire", "she is a licensed nurse and practises in the city", "the right to vote is reserved for citizens",
    "all rights of the tenant are listed in the contract", "permission to build was granted by the council", "the software is provided with a manual in three languages", "the general public was invited to the opening of the museum", "the committee discussed the terms of the licence for hours",
    "copies of the report can be obtained from the library", "the work was published by the university press", "this program was broadcast on the first of may", "the conditions of the warranty are printed on the box", "the authors thank the foundation for its support",
    "the copyright of the song was sold in 1971", "the licence fee for television pays for public broadcasting", "the state may not use this file in court", "the file was distributed to all members of the board", "the source of the river lies in the hills",
    "redistribution of land was the aim of the reform", "a free copy of the map is given to any person who asks", "the european union and the public debt", "he was given an artistic education at an early age", "the eclipse was seen by the public in the north",
    "the apache helicopter was introduced in 1986", "she studied at mit and later worked in boston", "the mozilla foundation is based in california", "the boost in sales surprised the software company", "the creative use of the commons by farmers",
]
UNKNOWN = "unknown"
FAMILIES = [*TEMPLATES, UNKNOWN]
WORD = r"[^a-z0-9.\-]+"
WORD_BREAK = r"[^A-Za-z0-9.\-]+"
#: What stands between runs of letters and digits.
PART = r"[^a-z0-9]+"
#: Words that may stand between the first and the last line of a notice: twice the longest template.
REACH = 2 * max(len(t.split()) for ts in TEMPLATES.values() for t in ts)
# Words of templates that most texts hold; they serve as cues only if no other word is left.
EVERYDAY = set("a all and any are at by following for from have in into is it may not of or possible provided related that the this to under use version with without work you".split())
#: Words of no licence, for texts around notices and for mixtures.
OTHER = "the of a in to and for with was by on is driver fishing season renewed office apply holder fee year plate lost issued valid state road vote civil human equal property water read note page see also table figure people house garden music".split()


def grams_of(text: str) -> set[str]:
    words = [w for w in (x.strip(".-") for x in re.split(WORD, text.lower())) if w]
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def parts_of(gram: str) -> set[str]:
    """The runs of letters and digits of an n-gram."""
    return {p for p in re.split(PART, gram) if p}


@functools.cache
def cues(share: float) -> list[str]:
    """Runs of letters and digits of which one stands in every paragraph with ``share`` (above 0) of the n-grams of any template.

    A template's n-grams without a cue must be too few for that share. What serves most
    templates comes next; short and everyday words only where no other is left.
    """
    left = [([parts_of(g) for g in grams], len(grams) - next(n for n in range(len(grams) + 1) if n / len(grams) >= share) + 1) for ts in TEMPLATES.values() for grams in map(grams_of, ts)]
    words = sorted({w for grams, _ in left for g in grams for w in g}, key=lambda w: (-len(w), w))
    chosen: list[str] = []
    while left:
        gain = {w: sum(min(need, sum(w in g for g in grams)) for grams, need in left) for w in words}
        word = max((w for w in words if gain[w]), key=lambda w: (w not in EVERYDAY and len(w) > 4, w not in EVERYDAY and len(w) > 2, gain[w]))
        chosen.append(word)
        rest = [([g for g in grams if word not in g], need - sum(word in g for g in grams)) for grams, need in left]
        left = [(grams, need) for grams, need in rest if need > 0]
    return chosen


def has_cue(low: Column, share: float) -> Column:
    """Whether a lower-cased text holds a cue; one look-up for each of its words, however many cues there are."""
    return F.arrays_overlap(F.split(low, PART), F.array(*map(F.lit, cues(share))))


class Classifier:
    """Weights by n-gram, biases, the calibrated probability, and the templates' n-grams."""

    def __init__(self, each: int = 30, mixtures: int = 3000, rounds: int = 200, rate: float = 3.0, ridge: float = 1e-3, false_rate: float = 0.005, seed: int = 1):
        rng = random.Random(seed)
        pool = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.split()})
        texts, labels = [], []
        for k, ts in enumerate(TEMPLATES.values()):
            for t in ts:
                for _ in range(each):
                    words = [w for w in t.split() if rng.random() > 0.05] or t.split()
                    before, after = ([rng.choice(OTHER) for _ in range(rng.choice((0, 0, 0, 2, 8)))] for _ in range(2))
                    texts.append(" ".join([*before, *words, *after]))
                    labels.append(k)
        every = [t for ts in TEMPLATES.values() for t in ts if len(t.split()) > 5]
        for n in range(mixtures):
            if n % 3 == 1:
                words = rng.choice(NO_LICENCE).split() + [rng.choice(OTHER) for _ in range(rng.choice((0, 2, 6)))]
                texts.append(" ".join(words))
                labels.append(len(TEMPLATES))
                continue
            if n % 3 == 2:
                words = rng.choice(every).split()
                words = [*rng.sample(words, len(words) // 3), *(rng.choice(OTHER) for _ in range(rng.randint(2, 12)))]
                rng.shuffle(words)
                texts.append(" ".join(words))
                labels.append(len(TEMPLATES))
                continue
            words = [rng.choice(pool) for _ in range(rng.randint(0, 6))] + [rng.choice(OTHER) for _ in range(rng.randint(1, 12))]
            rng.shuffle(words)
            texts.append(" ".join(words))
            labels.append(len(TEMPLATES))
        grams = [grams_of(t) for t in texts]
        vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams_of(t)} | {g for t in NO_LICENCE for g in grams_of(t)} | set(OTHER))
        self.place = {g: i for i, g in enumerate(vocabulary)}
        x = np.zeros((len(texts), len(vocabulary)), np.float32)
        for i, g in enumerate(grams):
            x[i, [self.place[w] for w in g if w in self.place]] = 1
        y = np.eye(len(FAMILIES), dtype=np.float32)[labels]
        train = np.arange(len(texts)) % 5 != 0
        w, b = np.zeros((len(vocabulary), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
        for _ in range(rounds):
            g = (self._soft(x[train] @ w + b) - y[train]) / train.sum()
            w -= rate * (x[train].T @ g + ridge * w)
            b -= rate * g.sum(0)
        self.weights, self.bias = w, b
        p = self._soft(x[~train] @ w + b)
        wrong = p[np.array(labels)[~train] == len(TEMPLATES), :-1].max(1)
        self.least = float(np.quantile(wrong, 1 - false_rate))

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(gram, weights) and (template, family, gram, size), of a size that the templates fix."""
        weights = spark.createDataFrame([(g, [float(v) for v in self.weights[i]]) for g, i in self.place.items()], "gram string, weights array<double>")
        rows, n = [], 0
        for family, ts in TEMPLATES.items():
            for t in ts:
                own = grams_of(t)
                rows += [(n, family, g, len(own)) for g in sorted(own)]
                n += 1
        return weights, spark.createDataFrame(rows, "template int, family string, gram string, size int")


def cued_runs(docs: DataFrame, share: float) -> DataFrame:
    """(doc_id, tag, n_paragraphs, paragraph, last, line): the runs of lines with a cue word, and one with line null for each row of ``docs``.

    A run is the lines ``paragraph`` to ``last``, joined by spaces; lines without a letter or
    digit don't count as lines of a run. Fewer than REACH words stand between its first and last line.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lower(text)
    lines = F.array_remove(F.split(text, r"[\r\n]+"), "")
    noted = F.transform(F.filter(lines, lambda x: x.rlike("[A-Za-z0-9]")), lambda x: F.struct(x.alias("line"), F.size(F.split(F.trim(x), WORD_BREAK)).alias("n"), has_cue(F.lower(x), share).alias("cue")))
    none = F.array().cast("array<struct<paragraph: int, last: int, line: string>>")

    def from_line(some, i):
        """The runs that begin with the first of ``some``, line i."""
        start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("between"), F.lit(False).alias("cue"), F.lit("").alias("line"), none.alias("out"))

        def longer(acc, x):
            cue, line = acc["cue"] | x["cue"], F.concat_ws(" ", acc["line"], x["line"])
            run = F.array(F.struct(i.alias("paragraph"), (i + acc["k"]).cast("int").alias("last"), line.alias("line")))
            more = F.struct((acc["k"] + 1).alias("k"), (acc["between"] + F.when(acc["k"] > 0, x["n"]).otherwise(0)).alias("between"), cue.alias("cue"), line.alias("line"), F.when(cue, F.concat(acc["out"], run)).otherwise(acc["out"]).alias("out"))
            return F.when(acc["between"] < REACH, more).otherwise(acc)

        return F.when(F.exists(some, lambda x: x["cue"]), F.aggregate(some, start, longer, lambda acc: acc["out"])).otherwise(none)

    # An array of one binds the lines to a variable, so that they are made once.
    runs = F.transform(F.array(noted), lambda all_: F.flatten(F.transform(all_, lambda _, i: from_line(F.slice(all_, i + 1, REACH + 2), i))))[0]
    end = F.array(F.struct(F.lit(None).cast("int").alias("paragraph"), F.lit(None).cast("int").alias("last"), F.lit(None).cast("string").alias("line")))
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), F.size(lines).cast("long").alias("n_paragraphs"), F.explode(F.concat(F.when(has_cue(low, share), runs).otherwise(none), end)).alias("run"))
    return each.select("doc_id", "tag", "n_paragraphs", "run.*")


def paragraphs(docs: DataFrame, model: Classifier, share: float = 0.7) -> DataFrame:
    """(doc_id, tag, n_paragraphs, paragraph, last, text, family, probability, template_share): one row for each run of lines with a cue word, and one with paragraph null for each row of ``docs``."""
    weights, templates = model.tables(docs.sparkSession)
    each = written(cued_runs(docs, share), "licence-lines")
    kept = each.where(F.col("line").isNotNull()).dropDuplicates(["doc_id", "tag", "paragraph", "last"])
    word = F.filter(F.transform(F.split(F.lower("line"), WORD), lambda w: F.regexp_replace(w, r"^[.\-]+|[.\-]+$", "")), lambda w: w != "")
    worded = kept.withColumn("w", word)
    pair = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    key = ["doc_id", "tag", "paragraph", "last"]
    grams = worded.select(*key, F.explode(F.array_distinct(F.concat("w", pair))).alias("gram"))
    # Both small sides have a size that the templates fix.
    weighed = grams.join(F.broadcast(weights), "gram").groupBy(*key).agg(*[F.sum(F.col("weights")[k]).alias(f"z{k}") for k in range(len(FAMILIES))])
    z = [F.col(f"z{k}") + F.lit(float(model.bias[k])) for k in range(len(FAMILIES))]
    top = F.greatest(*z)
    total = sum((F.exp(v - top) for v in z[1:]), F.exp(z[0] - top))
    best = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position(F.array(*z), top).cast("int"))
    predicted = weighed.select(*key, best.alias("family"), (1 / total).alias("probability"))
    matched = grams.join(F.broadcast(templates), "gram").groupBy(*key, "family", "template", "size").agg(F.count("*").alias("n"))
    matched = matched.groupBy(*key, "family").agg(F.max(F.col("n") / F.col("size")).alias("template_share"))
    other = matched.select(*[F.col(k).alias(f"_{k}") for k in (*key, "family")], "template_share")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    for k in (*key[1:], "family"):
        same = same & (F.col(k) == F.col(f"_{k}"))
    judged = predicted.join(other, same, "left").select(*key, "family", "probability", F.coalesce("template_share", F.lit(0.0)).alias("template_share"))
    sure = (F.col("probability") >= model.least) & (F.col("template_share") >= share)
    judged = judged.withColumn("family", F.when(sure, F.col("family")).otherwise(UNKNOWN))
    return _joined(each, judged, key)


def _joined(each: DataFrame, judged: DataFrame, key: list[str]) -> DataFrame:
    judged = judged.select(*[F.col(k).alias(f"_{k}") for k in key], "family", "probability", "template_share")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    for k in key[1:]:
        same = same & (F.col(k) == F.col(f"_{k}"))
    out = each.join(judged, same & F.col("line").isNotNull(), "left")
    return out.select("doc_id", "tag", "n_paragraphs", "paragraph", "last", F.col("line").alias("text"), "family", "probability", "template_share")


def apart(found: Column) -> Column:
    """(n, probability) of a set of (family, last, first, probability) with first negated: of runs of one family that share a line the one that ends first counts, the shortest of those."""
    start = F.struct(F.lit("").alias("family"), F.lit(-1).alias("last"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("probability"))

    def after(acc, x):
        more = F.struct(x["family"].alias("family"), x["last"].alias("last"), (acc["n"] + 1).alias("n"), F.greatest(acc["probability"], x["probability"]).alias("probability"))
        return F.when((x["family"] != acc["family"]) | (-x["first"] > acc["last"]), more).otherwise(acc)

    return F.aggregate(F.array_sort(found), start, after)


def licences(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, n_licences, families, probability) for each row of ``docs``: families sorted and comma-joined, probability the largest of theirs."""
    found = paragraphs(docs, model or Classifier())
    named = F.col("family").isNotNull() & (F.col("family") != UNKNOWN)
    run = F.struct("family", "last", (-F.col("paragraph")).alias("first"), "probability")
    per = found.groupBy("doc_id", "tag", "n_paragraphs").agg(
        F.count_if(F.col("paragraph").isNull()).alias("copies"),
        F.array_join(F.array_sort(F.collect_set(F.when(named, F.col("family")))), ",").alias("families"),
        F.collect_set(F.when(named, run)).alias("runs"),
    )
    per = per.withColumn("of", apart(F.col("runs"))).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return per.select("doc_id", "n_paragraphs", F.col("of.n").alias("n_licences"), "families", F.col("of.probability").alias("probability"))
