"""Licence notices found by a positional index of rare licence words."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointquarry.llm.common import plain, word_array


@dataclass(frozen=True)
class Notice:
    """A licence template: its words, the mandatory key phrase among them, the label."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        """Where the key phrase stands in the template."""
        k, w = self.key_words, self.words
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


# Phrases of public licence notices, in lower case, and their labels.
BASE = [
    Notice("mit", "under the mit license", "under the mit license", True),
    Notice("apache-2", "apache license version 2", "apache license version 2", True),
    Notice("cc-by-nc", "cc by nc", "cc by nc", True),
]
NOTICES = BASE + [
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    Notice("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    Notice("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    Notice("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Notice("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Notice("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    Notice("cc-by-sa", "cc by sa", "cc by sa"),
    Notice("cc-by-nd", "cc by nd", "cc by nd"),
    Notice("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    Notice("all-rights-reserved", "all rights reserved", "all rights reserved"),
]


def document_frequencies(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each word stands, and under "" how many documents there are.

    Only the given words leave a document, once each, and counts are partial before the
    shuffle; a row for each word comes to the driver, as many as the templates have.
    """
    own = F.array_distinct(F.concat(F.array(F.lit("")), F.filter(word_array(F.col(text_col)), lambda w: w.isin(words))))
    return {r["w"]: r["n"] for r in docs.select(F.explode(own).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}


def scan_licenses(docs: DataFrame, notices: list[Notice] | None = None, rare_words: int = 3, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """Find licence notices in each whole text.

    The inverse document frequency of each licence word is taken over all documents.
    The index has, for each template, the ``rare_words`` words of its key phrase of the highest
    frequency so weighed, with their places. A file's words are looked up in the
    index; each hit says where a template would begin; a template's places are those that
    all its rare words agree on. There the key phrase is verified word by word, and
    the score is the weighed part of the template's words that stand in place. The
    search runs within a row, so documents are not shuffled. Base templates are their
    own key phrases and count at every place; others need ``min_score``.

    Adds ``__words``, ``__base`` (places of base phrases), ``__first`` and ``__last`` (their
    smallest and largest start), ``__base_labels``, ``__labels`` (sorted, distinct arrays) and ``__score``
    (the best template's, 0 without one).

    Null and empty texts have no words and no labels. A text of any length is one row. Base
    columns depend on the row alone; rare words, and so the method's labels and scores, on the frequencies of all
    documents. Repeated rows give repeated results, an empty table gives an empty one. Columns of
    ``docs`` that begin with two underscores are left out.
    """
    notices, docs = NOTICES if notices is None else notices, plain(docs)
    known = sorted({w for t in notices for w in t.words})
    df = document_frequencies(docs, known, text_col)
    idf = {w: math.log((1 + df.get("", 0)) / (1 + df.get(w, 0))) + 1 for w in known}
    rare = [sorted(dict.fromkeys(t.key_words), key=lambda w: (-idf[w], w))[:rare_words] for t in notices]
    ids = {w: i for i, w in enumerate(sorted({w for ws in rare for w in ws}))}
    number = F.create_map(*[F.lit(x) for w, i in ids.items() for x in (w, i)])
    look_up = F.filter(
        F.transform("__tokens", lambda w, i: F.when(w.isin(list(ids)), F.struct(number[w].alias("w"), i.alias("p")))),
        lambda h: h.isNotNull(),
    )
    tokens = docs.withColumn("__tokens", word_array(F.col(text_col)))
    hits = tokens.withColumn("__hits", look_up)

    def shifted(word: int, offset: int) -> Column:
        return F.transform(F.filter("__hits", lambda h: h["w"] == word), lambda h: h["p"] - offset)

    def starts(t: Notice, words: list[str]) -> Column:
        found = None
        for w in words:
            at = shifted(ids[w], t.key_words.index(w))
            found = at if found is None else F.array_intersect(found, at)
        # A rare word that repeats in the phrase is taken at its first place; the whole phrase is verified here.
        key = F.array(*[F.lit(w) for w in t.key_words])
        return F.filter(found, lambda s: (s >= 0) & (F.slice(F.col("__tokens"), F.greatest(s, F.lit(0)) + 1, len(t.key_words)) == key))

    def covered(t: Notice, s: Column) -> Column:
        total = sum(idf[w] for w in t.words)
        parts = [F.when(F.coalesce(F.when(s - t.key_at + i >= 0, F.get(F.col("__tokens"), s - t.key_at + i)), F.lit("")) == w, F.lit(idf[w])).otherwise(F.lit(0.0)) for i, w in enumerate(t.words)]
        return F.least(F.lit(1.0), sum(parts[1:], parts[0]) / F.lit(total))

    def best_cover(t: Notice, at: str) -> Column:
        return F.array_max(F.transform(at, lambda s: covered(t, s)))

    places = hits.withColumns({f"__at{i}": F.when(F.size("__hits") > 0, starts(t, rare[i])).otherwise(F.array().cast("array<int>")) for i, t in enumerate(notices)})
    scores = places.withColumns(
        {
            f"__s{i}": F.when(F.size(f"__at{i}") == 0, F.lit(0.0)).otherwise(F.lit(1.0) if t.text == t.key else best_cover(t, f"__at{i}"))
            for i, t in enumerate(notices)
        }
    )
    base = [i for i, t in enumerate(notices) if t.base]
    all_base = F.concat(*[F.col(f"__at{i}") for i in base]) if base else F.array().cast("array<int>")
    named = [F.when(F.col(f"__s{i}") >= (0.0 if t.base else min_score), F.when(F.col(f"__s{i}") > 0, F.lit(t.label))) for i, t in enumerate(notices)]

    def labels(of: list[Column]) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.array(*of) if of else F.array().cast("array<string>"), lambda x: x.isNotNull())))

    best = [F.when(F.col(f"__s{i}") >= min_score, F.col(f"__s{i}")).otherwise(F.lit(0.0)) for i in range(len(notices))]
    return scores.select(
        *docs.columns,
        F.size("__tokens").cast("long").alias("__words"),
        F.size(all_base).cast("long").alias("__base"),
        F.array_min(all_base).cast("long").alias("__first"),
        F.array_max(all_base).cast("long").alias("__last"),
        labels([named[i] for i in base]).alias("__base_labels"),
        labels(named).alias("__labels"),
        F.round(F.greatest(*best, F.lit(0.0)), 6).alias("__score"),
    )
