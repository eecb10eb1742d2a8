"""Licence scan by a positional rare-token index.

Licence templates are a table: the words of a licence text or notice, a label, and the mandatory key
phrase.  Its size is a parameter of the job, not of the corpus.

1. Every text is cut into words once.  Which words of the templates it has is counted towards their
   document frequencies; the words themselves are kept only of texts that have all words of the key
   phrase of some template, as no other text can match.
2. The index posts every template under its ``RARE`` words of highest IDF, each with its offset.
3. A file looks its words up in the index.  Every posting implies the place where its template would
   begin (word position minus offset); postings of a template are intersected by that place, and
   ``AGREE`` of them must meet there.
4. At such a place, the template's key phrase must stand word for word.  The rest of the template
   adds to the score by IDF weight.

All work on a text happens in its own row, with array functions over the index; nothing but the
counts of the templates' words is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.words import plain_words
from sightline.sources.work import cut

#: Postings of a template, and how many must imply one place (all, if it has fewer).
RARE, AGREE = 4, 2


@dataclass(frozen=True)
class Template:
    """``words`` as they stand in a licence text; ``key`` (first, length) is its mandatory phrase."""

    label: str
    words: str
    key: tuple[int, int]
    base: bool = False


#: Phrases of the base labels first, then texts and notices of common licences.
TEMPLATES = (
    Template("mit", "mit license", (0, 2), True),
    Template("apache", "apache license", (0, 2), True),
    Template("gpl", "general public license", (0, 3), True),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions",
        (0, 4),
    ),
    Template(
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www "
        "apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed "
        "under the license is distributed on an as is basis without warranties or conditions of any kind either express or "
        "implied see the license for the specific language governing permissions and limitations under the license",
        (22, 5),
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 2 of the license or at your option any later "
        "version",
        (18, 4),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer",
        (0, 4),
    ),
    Template("bsd", "bsd license", (0, 2)),
    Template("mpl", "mozilla public license", (0, 3)),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at http mozilla org mpl 2 0",
        (0, 8),
    ),
    Template("isc", "isc license", (0, 2)),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        (0, 5),
    ),
    Template("lgpl", "gnu lesser general public license", (1, 4)),
    Template("agpl", "gnu affero general public license", (1, 4)),
    Template("cc", "creative commons attribution", (0, 3)),
    Template("cc", "this work is licensed under a creative commons attribution 4 0 international license", (6, 2)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", (6, 5)),
    Template("unlicense", "released into the public domain", (0, 5)),
    Template("epl", "eclipse public license", (0, 3)),
    Template(
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license",
        (9, 4),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this software",
        (12, 8),
    ),
)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``label, words`` (array), ``first, length`` (of the key phrase) and ``base``."""
    rows = [(t.label, t.words.split(), *t.key, t.base) for t in templates]
    return spark.createDataFrame(rows, "label string, words array<string>, first int, length int, base boolean")


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _index(templates: list, idf: dict[str, float]) -> list[tuple[str, int, int]]:
    """(word, template, offset): the places of highest IDF of each template; of equal ones, the first."""
    out = []
    for k, t in enumerate(templates):
        places = sorted(range(len(t["words"])), key=lambda i: (-idf[t["words"][i]], i))
        out += [(t["words"][i], k, i) for i in places[:RARE]]
    return out


def license_scan(
    docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each document row.

    ``doc_id``; ``n_words``; ``n_base``, ``first_word``, ``last_word``: number, smallest and largest
    start of all base places (null without any); ``base_labels`` and ``labels``: distinct labels,
    sorted, comma-joined, empty without any; ``score``: the best match's share of its template's
    IDF weight, 0 without any match.

    ``templates``: see ``template_table``; it is collected.  Base templates are key phrases as a whole.
    Null and empty texts have no words; repeated rows each keep their row; an empty table gives none.
    A very long text is read whole, in its row.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    table = (templates if templates is not None else template_table(spark)).collect()
    vocab = sorted({w for t in table for w in t["words"]})
    keys = [t["words"][t["first"] : t["first"] + t["length"]] for t in table]
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_words(F.col(text_col)).alias("w"))
    own = words.select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_intersect("w", _strings(vocab)).alias("own"), "w")
    all_keys = F.array(*[_strings(sorted(set(k))) for k in keys])
    can = F.exists(all_keys, lambda k: F.size(F.array_except(k, F.col("own"))) == 0)
    stored = cut(own.select("doc_id", "n_words", "own", F.when(can, F.col("w")).alias("w")), "words")

    df = {r["x"]: r["n"] for r in stored.select(F.explode("own").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = stored.count()
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-9 for w in vocab}  # as many as the templates have words
    index = _index(table, idf)
    rare = _strings(sorted({w for w, _, _ in index}))
    postings = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(k).alias("t"), F.lit(i).alias("offset")) for w, k, i in index])
    weight = [[idf[w] / sum(idf[x] for x in t["words"]) for w in t["words"]] for t in table]
    facts = F.array(
        *[
            F.struct(
                F.lit(t["label"]).alias("label"), F.lit(t["base"]).alias("base"), F.lit(t["first"]).alias("first"), _strings(k).alias("key"),
                _strings(t["words"]).alias("words"), F.array(*[F.lit(x) for x in v]).alias("weight"),
                F.lit(min(AGREE, len(t["words"]))).alias("need"),
            )
            for t, k, v in zip(table, keys, weight)
        ]
    )
    fact = lambda p: F.get(facts, p["t"])

    hot = stored.where("w is not null").select("doc_id", "n_words", "w", F.array_intersect("own", rare).alias("own"))
    # places of rare words
    hot = hot.select(
        "doc_id", "n_words", "w", F.filter(postings, lambda p: F.array_contains("own", p["word"])).alias("posted"),
        F.filter(F.transform("w", lambda x, i: F.when(F.array_contains("own", x), F.struct(i.alias("i"), x.alias("x")))), lambda s: s.isNotNull()).alias("at"),
    )
    # implied starts of the key phrase, equal ones beside each other
    starts = F.flatten(
        F.transform(
            "at",
            lambda a: F.transform(
                F.filter("posted", lambda p: p["word"] == a["x"]),
                lambda p: F.struct(p["t"].alias("t"), (a["i"] - p["offset"] + fact(p)["first"]).alias("start")),
            ),
        )
    )
    hot = hot.select("doc_id", "n_words", "w", F.array_sort(starts).alias("starts"))
    # the first of `need` equal ones
    meets = lambda s, i: (F.get("starts", i + fact(s)["need"] - 1) == s) & F.when(i > 0, F.get("starts", i - 1) != s).otherwise(True)
    stands = lambda s: F.when(
        s["start"] >= 0, F.slice("w", F.greatest(s["start"], F.lit(0)) + 1, F.size(fact(s)["key"])) == fact(s)["key"]
    ).otherwise(False)
    hot = hot.select("doc_id", "n_words", "w", F.filter("starts", meets).alias("met"))
    hot = hot.select("doc_id", "n_words", "w", F.filter("met", stands).alias("found"))

    def share(s: Column) -> Column:
        t = fact(s)
        there = F.transform(t["words"], lambda x, j: F.when(F.get("w", s["start"] - t["first"] + j) == x, F.get(t["weight"], j)).otherwise(0.0))
        return F.aggregate(there, F.lit(0.0), lambda a, b: a + b)

    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda s: fact(s)["label"]))), ",")
    of_base = F.filter("found", lambda s: fact(s)["base"])
    hot = hot.select("doc_id", "n_words", "w", "found", of_base.alias("base"))
    begin = F.transform("base", lambda s: s["start"])
    matched = hot.select(
        "doc_id", "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(begin).cast("long").alias("first_word"),
        F.array_max(begin).cast("long").alias("last_word"),
        names(F.col("base")).alias("base_labels"),
        names(F.col("found")).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("found", share)), F.lit(0.0))).alias("score"),
    )
    none, empty = F.lit(None).cast("long"), F.lit("")
    others = stored.where("w is null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"),
        empty.alias("base_labels"), empty.alias("labels"), F.lit(0.0).alias("score"),
    )
    return matched.unionByName(others)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
