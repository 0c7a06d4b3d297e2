"""Licence scan by a positional index of rare template words; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of digits, lower-case letters and characters from U+0080 on.
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
#: The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Further templates of this operator: the text, its label, and the key phrase in it that must stand whole.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0", "apache license version 2 0"),
    ("gnu general public license version 3", "gpl-3", "gnu general public license version 3"),
    ("gnu general public license version 2", "gpl-2", "gnu general public license version 2"),
    ("gnu lesser general public license", "lgpl", "gnu lesser general public license"),
    ("gnu affero general public license", "agpl", "gnu affero general public license"),
    ("released under the mit license", "mit-grant", "under the mit license"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit-text", "hereby granted free of charge"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc by sa"),
    ("cc0 1 0 universal", "cc0", "cc0 1 0 universal"),
    ("mozilla public license version 2 0", "mpl-2.0", "mozilla public license"),
    ("redistribution and use in source and binary forms with or without modification", "bsd", "redistribution and use in source and binary forms"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", "permission to use copy modify and or distribute this software"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "free and unencumbered software"),
    ("boost software license version 1 0", "bsl-1.0", "boost software license"),
)


def words_of(text: Column) -> Column:
    """The words of a whole text, A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(1))


def templates() -> list[tuple[str, bool, list[str], int, int]]:
    """(label, base, words, where the mandatory phrase starts in them, its length)."""
    out = [(label, True, phrase.split(), 0, len(phrase.split())) for phrase, label in BASE]
    for text, label, key in TEMPLATES:
        words, phrase = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        out.append((label, False, words, at, len(phrase)))
    return out


def inverse_frequencies(docs: DataFrame) -> dict[str, float]:
    """ln((N + 1) / (documents with the word + 1)) of every template word, over all documents, in one pass."""
    vocabulary = sorted({w for _, _, words, _, _ in templates() for w in words})
    held = F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))
    seen = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("word"))  # no word: each document once
    counts = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}  # of the vocabulary only
    return {w: math.log((counts.get("", 0) + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


#: Words of each template that are posted: of its key phrase, and of all of it, those of the highest inverse document frequency.
KEYED, POSTED = 2, 3


def posted_words(words: list[str], at: int, length: int, idf: dict[str, float]) -> list[int]:
    """The words of a template that are posted. Two of its key phrase always are, so the phrase is found wherever it stands whole."""
    rarest = lambda some, n: sorted(some, key=lambda i: (-idf[words[i]], i))[:n]
    return sorted({*rarest(range(at, at + length), KEYED), *rarest(range(len(words)), POSTED)})


#: A hit as one number: template, and start of the template in the text plus SHIFT.
STRIDE, SHIFT = 1 << 40, 1 << 20


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def licence_scan(docs: DataFrame) -> DataFrame:
    """Licence phrases of every whole text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    docs: doc_id, text; other columns are ignored; repeated rows each give a row; rows without a doc_id are left out. Of
    every template the KEYED words of its key phrase and the POSTED words of all of it that have the highest inverse document
    frequency in this corpus are posted with their places. Each such word of a text puts its templates at a start relative
    to it; the postings of one template are intersected by that start: at least two of them must agree there. The score is the
    share of the template's inverse frequencies whose words agree, at best (0 to 1), also where a word of it is altered;
    the label is given wherever the mandatory key phrase stands whole, whatever else the corpus holds. Base places are all positions of the base phrases; without one
    first_word and last_word are null and base_labels is empty. Null and empty texts have no words; an empty table gives an
    empty result. Everything is one expression on the row: nothing is exploded, joined or shuffled.
    """
    idf = inverse_frequencies(docs)
    postings: dict[str, list[tuple[int, int]]] = {}
    described = []
    for number, (label, base, words, at, length) in enumerate(templates()):
        rarest = posted_words(words, at, length, idf)
        for i in rarest:
            postings.setdefault(words[i], []).append((number, i))
        weights = [idf[w] + 1e-9 for w in words]
        described.append(F.struct(F.lit(label).alias("label"), F.lit(base).alias("base"), F.array(*map(F.lit, words)).alias("words"), F.array(*(F.lit(x / sum(weights)) for x in weights)).alias("weights"), F.array(*map(F.lit, rarest)).alias("rare"), F.array(*map(F.lit, range(at, at + length))).alias("key")))
    shape = F.array(*described)
    index = F.create_map(*(x for word, held in sorted(postings.items()) for x in (F.lit(word), F.array(*(F.lit(t * STRIDE + SHIFT - i) for t, i in held)))))

    def candidate(words: Column, hit: Column) -> Column:
        start = (hit % STRIDE - SHIFT).cast("int")

        def judged(t: Column) -> Column:
            stands = lambda i: F.coalesce(F.get(words, start + i) == F.get(t["words"], i), F.lit(False))
            agreeing = F.size(F.filter(t["rare"], stands))
            share = F.aggregate(F.transform(t["weights"], lambda w, i: F.when(stands(i), w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
            return F.when(agreeing >= 2, F.struct(start.cast("long").alias("start"), t["label"].alias("label"), t["base"].alias("base"), F.forall(t["key"], stands).alias("whole"), share.alias("score")))

        return bound(F.get(shape, F.floor(hit / STRIDE).cast("int")), judged)

    def result(words: Column) -> Column:
        posted = F.filter(F.transform(words, lambda w, i: F.when(w.isin(sorted(postings)), F.struct(w.alias("w"), i.cast("long").alias("i")))), lambda p: p.isNotNull())
        hits = F.array_distinct(F.flatten(F.transform(posted, lambda p: F.transform(F.element_at(index, p["w"]), lambda e: e + p["i"]))))
        met = F.filter(F.transform(hits, lambda h: candidate(words, h)), lambda c: c.isNotNull())

        def columns(found: Column) -> Column:
            base = F.filter(found, lambda c: c["base"] & c["whole"])
            starts = F.transform(base, lambda c: c["start"])
            names = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda c: c["label"]))), ",")
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.size(base).cast("long").alias("n_base"),
                F.array_min(starts).alias("first_word"),
                F.array_max(starts).alias("last_word"),
                names(base).alias("base_labels"),
                names(F.filter(found, lambda c: c["whole"])).alias("labels"),
                F.least(F.coalesce(F.array_max(F.transform(found, lambda c: c["score"])), F.lit(0.0)), F.lit(1.0)).alias("score"),
            )

        return bound(met, columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bound(words_of(F.col("text")), result).alias("r")).where("doc_id IS NOT NULL")
    return rows.select("doc_id", "r.*")
