"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Everything is column expressions over one row at a time; nothing is shuffled but the token counts.

The join: templates and blocks are sets of words. Words are ordered by how many documents hold them, rarest first. A
block contains a template of n words to at least ``THRESHOLD`` only if it shares k = ceil(THRESHOLD * n) of them, so

* prefix filter: it must hold one of the template's n - k + 1 rarest words;
* length filter: it must have at least k words;
* positional filter: from the first shared word on, both sorted sets must still have k words;

and every block that passes is verified on all words. The words that tell relatives apart (``VARIANTS`` and numbers) are
not left to the threshold: a block must hold those of the template, and no variant that the template lacks, so a
notice of version 2 or of a lesser license is never named after version 3. Templates are a parameter, so that side is a
literal; the other side is every block of every document. A block is a sentence or paragraph.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.85
#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Sentences by which licenses are named or granted in a text.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
    ],
    "gpl-3.0": [
        "licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
    ],
    "gpl-2.0": [
        "licensed under the gnu general public license version 2",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
    ],
    "lgpl-3.0": [
        "licensed under the gnu lesser general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license",
    ],
    "lgpl-2.1": [
        "licensed under the gnu lesser general public license version 2 1",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license",
    ],
    "agpl-3.0": [
        "licensed under the gnu affero general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "bsd-3-clause": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license"],
    "cc-by-4.0": [
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ],
    "cc-by-sa-4.0": [
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    ],
    "cc-by-nc-4.0": [
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ],
    "cc-by-nd-4.0": [
        "licensed under cc by nd 4 0",
        "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    ],
}
#: Words that tell a license from its relatives.
VARIANTS = ("lesser", "affero", "sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLOCK_END = r"[.!?]+(?:\s+|$)|\n\s*\n"
_NUMBER = re.compile("[0-9]+")


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def spaced_words(low: Column) -> Column:
    """The words of a lowered text with single blanks between them."""
    return F.trim(F.regexp_replace(low, _BETWEEN, " "))


def _marked(words: str) -> str:
    return "".join(f"|{w}|" for w in words.split())


def _bars(x: Column) -> Column:
    """Words in a piece of marked text: each has two bars."""
    return ((F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))) / 2).cast("long")


class Phrase:
    """Places of a phrase in marked words, where each word stands between bars of its own."""

    def __init__(self, phrase: str, marked: Column, n_words: Column) -> None:
        words = phrase.split()
        if any(words[:k] == words[-k:] for k in range(1, len(words))):
            raise ValueError(f"places of {phrase!r} could overlap, which the count does not follow")
        pattern = _marked(phrase)
        without = F.replace(marked, F.lit(pattern), F.lit(""))
        self.count = ((F.length(marked) - F.length(without)) / len(pattern)).cast("long")
        self.found = marked.contains(pattern)
        self.first = F.when(self.found, _bars(F.substring_index(marked, pattern, 1)))
        self.last = F.when(self.found, n_words - _bars(F.substring_index(marked, pattern, -1)) - len(words))


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _array(values: Sequence) -> Column:
    return F.array(*map(F.lit, values))


def _least(values: Sequence[Column], pick) -> Column:
    return pick(*values) if len(values) > 1 else values[0]


def template_words(templates: Mapping[str, Sequence[str]]) -> list[tuple[str, frozenset[str]]]:
    """(label, words) of every template; words as in the documents."""
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    return [(label, frozenset(find(text.lower()))) for label, texts in templates.items() for text in texts]


def telling(words: frozenset[str]) -> tuple[list[str], list[str]]:
    """The words of a template that a block must hold, and the variants that it must not hold."""
    return sorted(w for w in words if w in VARIANTS or _NUMBER.fullmatch(w)), sorted(set(VARIANTS) - words)


def token_order(docs: DataFrame, vocabulary: Sequence[str], text: str = "text") -> list[str]:
    """The vocabulary by the number of documents that hold a word, rarest first; ties by the word itself.

    One row per word of the templates comes to the driver, whatever the corpus.
    """
    words = F.split(spaced_words(lowered(F.col(text))), " ")
    held = docs.select(F.explode(F.array_intersect(words, _array(vocabulary))).alias("word"))
    counts = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _contained(ranks: Sequence[int], needed: Sequence[int], barred: Sequence[int], share: float, block: Column) -> Column:
    """How much of a template a block contains; null below the threshold or where a telling word speaks against it.

    ``block`` is a struct of ``size`` and ``ranks``, the sorted ranks of its vocabulary words.
    """
    n, need = len(ranks), math.ceil(share * len(ranks) - 1e-9)
    prefix, held = _array(sorted(ranks)[: n - need + 1]), block["ranks"]
    first = F.element_at(F.array_intersect(held, prefix), 1)
    left = F.least(F.size(held) - F.array_position(held, first) + 1, n - F.array_position(_array(sorted(ranks)), first) + 1)
    shared = F.size(F.array_intersect(held, _array(ranks)))
    passes = (block["size"] >= need) & (F.size(held) >= need) & F.arrays_overlap(held, prefix) & (left >= need)
    told = reduce(lambda a, b: a & b, [F.array_contains(held, r) for r in needed], F.lit(True))
    told = reduce(lambda a, b: a & b, [~F.array_contains(held, r) for r in barred], told)
    return F.when(passes, F.when((shared >= need) & told, shared / F.lit(float(n))))


def scan_licenses(
    docs: DataFrame, keep: Sequence[str], phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text",
) -> DataFrame:
    """Columns ``keep`` of every row with n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``n_base`` counts all places of all phrases; ``first_word`` and ``last_word`` are the smallest and largest word at
    which one begins, else null. Labels are distinct, sorted and comma-joined, empty where there are none. ``score`` is 1
    with a phrase, else the largest containment of a template that meets the threshold, else 0. A null or empty text has
    no words. Repeated rows and null ids give rows of their own.
    """
    known = [(label, words) for label, words in template_words(templates) if words]
    order = token_order(docs, sorted({w for _, ws in known for w in ws} | set(VARIANTS)), text) if known else []
    rank = {w: i for i, w in enumerate(order)}
    ranked = [(label, *[sorted(rank[w] for w in part) for part in (words, *telling(words))]) for label, words in known]

    rows = docs.select(*keep, lowered(F.col(text)).alias("_low"))
    rows = rows.withColumn("_words", spaced_words(F.col("_low")))
    rows = rows.withColumns({
        "_marked": F.when(F.col("_words") == "", F.lit("")).otherwise(
            F.concat(F.lit("|"), F.replace("_words", F.lit(" "), F.lit("||")), F.lit("|"))
        ),
    }).drop("_words")
    marked = F.col("_marked")
    rows = rows.withColumn("n_words", _bars(marked))
    places = [(Phrase(p, marked, F.col("n_words")), label) for p, label in phrases.items()]
    base = F.array_compact(F.array(*[F.when(p.found, F.lit(label)) for p, label in places]))
    rare = sorted({r for _, ranks, _, _ in ranked for r in ranks[: len(ranks) - math.ceil(threshold * len(ranks) - 1e-9) + 1]})
    candidate = _any([marked.contains(f"|{order[r]}|") for r in rare])
    facts = {
        "n_base": sum((p.count for p, _ in places), F.lit(0).cast("long")),
        "first_word": _least([p.first for p, _ in places], F.least),
        "last_word": _least([p.last for p, _ in places], F.greatest),
        "_base": F.array_sort(F.array_distinct(base)),
    }
    if ranked:
        ranks = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
        vocabulary = _array(order)

        def block(sentence: Column) -> Column:
            words = F.array_distinct(F.split(spaced_words(sentence), " "))
            held = F.transform(F.array_intersect(words, vocabulary), lambda w: F.element_at(ranks, w))
            return F.struct(F.size(words).alias("size"), F.array_sort(held).alias("ranks"))

        blocks = F.transform(F.split("_low", _BLOCK_END), block)
        facts["_blocks"] = F.when(candidate, F.filter(blocks, lambda b: F.size(b["ranks"]) > 0))
    rows = rows.withColumns(facts).drop("_low", "_marked")
    if ranked:
        found = {
            f"_t{i}": F.array_max(F.transform("_blocks", partial(_contained, r, needed, barred, threshold)))
            for i, (_, r, needed, barred) in enumerate(ranked)
        }
        rows = rows.withColumns(found).drop("_blocks")
        more = F.array_compact(F.array(*[F.when(F.col(f"_t{i}").isNotNull(), F.lit(label)) for i, (label, *_) in enumerate(ranked)]))
        best = F.coalesce(_least([F.col(c) for c in found], F.greatest), F.lit(0.0))
    else:
        more, best = F.array().cast("array<string>"), F.lit(0.0)
    return rows.select(
        *keep, "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", more)), ",").alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
