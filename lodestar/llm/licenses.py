"""License scan by a positional index of rare template words, in DataFrame functions alone.

Words are runs of letters, digits and non-ASCII characters, with A-Z folded. The
index holds postings (word, template, place) of the RARE highest-IDF words of
every template's key phrase, by document frequencies over the whole corpus. A file
looks up its licence words; each posting gives the place where the template would
begin, and places are kept on which all postings of a template agree. There the
mandatory key phrase is verified word by word, and the share of the weight of the
template's words that stand where they should, give or take DRIFT words, is the
score. A template that is nothing but its key phrase is a base phrase.

A hit carries only the words around it, as far as a template reaches, so work and
memory grow with the words and the hits of a text, not with their product.

Defined results: a null or empty text has no words, labels or places and score
0; a template may begin before the text's first word or end after its last one, and
words that are not there do not count; phrases may overlap and are all counted;
repeated rows are scanned alike, and rows are told apart by a number of their own,
so null and repeated ids are kept; an empty table gives an empty result; texts are
scanned whole; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.plans.scratch import materialize

# Words as the contract states them (A-Z are folded afterwards), base phrases, and templates as (label, text, key phrase).
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this program is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license version 3", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain cc0 1 0", "cc0 1 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "see the gnu general public license for more details"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1", "distributed under the boost software license version 1 0", "boost software license"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla org mpl 2 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("artistic-2", "you can redistribute it and or modify it under the terms of the artistic license 2 0", "artistic license 2 0"),
    ("wtfpl", "do what the fuck you want to public license", "what the fuck you want"),
    ("ofl-1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
]
#: Share of a template's weight that must match.
COVER = 0.6
#: Words of a key phrase that have postings, and how far a word of the rest may be from its place.
RARE, DRIFT = 3, 2


def _templates() -> list[tuple[str, bool, list[str], int, int]]:
    """(label, base, words, start and length of the key phrase)."""
    out = [(label, True, words := phrase.split(), 0, len(words)) for label, phrase in BASE]
    for label, text, key in TEMPLATES:
        words, part = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
        out.append((label, False, words, at, len(part)))
    return out


def _word_set(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: a number, doc_id, n_words, the vocabulary's words in it, and all its words if one of the key phrases' words is among them."""
    known = sorted({w for t in _templates() for w in t[2]})
    keys = sorted({w for t in _templates() for w in t[2][t[3] : t[3] + t[4]] if len(w) > 2 or w == "cc"} - {"the", "and", "use", "for", "any"})
    raw = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"))
    # Each key phrase holds at least one of these words, in lower case after folding.
    folded = F.transform("raw", lambda w: F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    hint = F.arrays_overlap("folded", _word_set(keys))
    wide = rows.withColumn("folded", folded)
    return materialize(wide.select("row", "doc_id", F.size("raw").cast("long").alias("n_words"), F.array_intersect("folded", _word_set(known)).alias("present"), F.when(hint, F.col("folded")).alias("words")), "licenses")


def weights(scanned: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every template word over the whole corpus (a fixed vocabulary)."""
    total = scanned.count()
    counts = {r["word"]: r["n"] for r in scanned.select(F.explode("present").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: math.log(1 + (total + 1) / (counts.get(w, 0) + 1)) for t in _templates() for w in t[2]}


def _index(idf: dict[str, float]) -> list[tuple]:
    """Postings (word, place, template, needed, label, base, words, their weights, key start, key length): those of a template's rarest key words, by their first places in the key phrase."""
    out = []
    for number, (label, base, words, at, size) in enumerate(_templates()):
        first = {w: i for i, w in reversed(list(enumerate(words[at : at + size], at)))}
        rare = sorted(first, key=lambda w: (-idf[w], w))[:RARE]
        out += [(w, first[w], number, len(rare), label, base, words, [idf[x] for x in words], at, size) for w in rare]
    return out


_POSTING = "word string, place int, template int, needed int, label string, base boolean, words array<string>, weight array<double>, key_at int, key_size int"


def matches(scanned: DataFrame, idf: dict[str, float]) -> DataFrame:
    """(row, label, base, at, score) of every place where a template's key phrase stands and enough of the rest."""
    index = _index(idf)
    reach = max(len(p[6]) for p in index) + DRIFT
    postings = scanned.sparkSession.createDataFrame(index, _POSTING)
    hit = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(sorted({p[0] for p in index})))
    near = F.transform(hit, lambda x: F.struct(x["word"].alias("word"), x["at"].alias("at"), F.greatest(x["at"] - reach, F.lit(0)).alias("from"), F.slice("words", F.greatest(x["at"] - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("near")))
    found = scanned.where("words is not null").select("row", F.explode(near).alias("hit")).select("row", "hit.*")
    # The postings are as many as the templates have rare words.
    placed = found.join(F.broadcast(postings), "word").withColumn("at", F.col("at") - F.col("place"))

    def there(i: Column, w: Column, off: int = 0) -> Column:
        return F.coalesce(F.get("near", F.col("at") + i + off - F.col("from")) == w, F.lit(False))

    key = F.forall(F.sequence(F.lit(0), F.col("key_size") - 1), lambda i: there(i + F.col("key_at"), F.get("words", i + F.col("key_at"))))
    gained = F.transform("words", lambda w, i: F.when(_any(there(i, w, d) for d in range(-DRIFT, DRIFT + 1)), F.get("weight", i)).otherwise(0.0))
    total = lambda of: F.aggregate(of, F.lit(0.0), lambda a, w: a + w)
    scored = placed.select("row", "word", "template", "needed", "label", "base", "at", F.struct(key.alias("key"), (total(gained) / total("weight")).alias("score")).alias("x"))
    # All postings of a template must agree on where it begins.
    agreed = scored.groupBy("row", "template", "at").agg(F.countDistinct("word").alias("n"), F.first("needed").alias("needed"), F.first("label").alias("label"), F.first("base").alias("base"), F.min("x.key").alias("key"), F.max("x.score").alias("score"))
    return agreed.where("n = needed and key").where(F.col("base") | (F.col("score") >= COVER)).select("row", "label", "base", "at", F.when(F.col("base"), 1.0).otherwise(F.col("score")).alias("score"))


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def find(docs: DataFrame) -> DataFrame:
    """One row a document: its words, base places, labels and best score."""
    scanned = scan(docs)
    found = matches(scanned, weights(scanned))
    base = F.when(F.col("base"), F.col("at")).cast("long")

    def listed(of: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(of)), ",")

    by_row = found.groupBy("row").agg(
        F.count(base).alias("n_base"),
        F.min(base).alias("first_word"),
        F.max(base).alias("last_word"),
        listed(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        listed(F.col("label")).alias("labels"),
        F.max(F.round("score", 9)).alias("score"),
    )
    joined = scanned.select("row", "doc_id", "n_words").join(by_row, "row", "left")
    empty = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return joined.select("doc_id", "n_words", *(F.coalesce(c, F.lit(empty[c])).alias(c) if c in empty else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")))
