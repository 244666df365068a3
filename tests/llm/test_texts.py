"""Decontamination, quality rules, language identification and licenses against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trailmark.llm import decontamination, langid, licenses, perplexity
from trailmark.llm.text_features import reduced

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, kept string"
ODD = [None, "", " ", "\n\n", "...", "é" * 30, "a" * 5000, "x y z " * 4000, "\x00\x1f", "mit license mit license. MIT  License"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def passages():
    rng = random.Random(1)
    vocabulary = [a + b for a in ("ba", "ke", "li", "mo") for b in ("ra", "so", "tu", "vé", "9")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 14, 40]))) for i in range(12)] + [(50, None), (51, ""), (None, "ke ra ke ra"), (3, "twice the id")]
    docs = []
    for i in range(120):
        parts = [text(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            words = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(words)) if words else 0
            parts += [", ".join(words[at:] if rng.random() < 0.5 else words).upper(), text(rng.randrange(8))]
        docs.append((i, " ".join(parts), "en", "x"))
    return docs + [(200 + i, t, "en", "x") for i, t in enumerate(ODD)] + docs[:2], items


def brute_hits(text, items, window=10):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        own = WORD.findall(lower(body))
        for k in range(max(1, len(own) - window + 1)) if own else ():
            w = own[k : k + window]
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    hit.update(range(p, p + len(w)))
                    found.add("" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit)


@pytest.mark.parametrize("block", [decontamination.BLOCK_WINDOWS, 20])
def test_decontamination(spark, monkeypatch, block):
    docs, items = passages()
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", block)
    found = decontamination.find_passages(
        spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), keep=["doc_id", "kept"]
    )
    got = decontamination.contamination(found).drop("kept").collect()
    want = [(d[0], *brute_hits(d[1], items)) for d in docs]
    assert sorted(map(tuple, got)) == sorted(want)
    clean = decontamination.drop_contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == ["doc_id", "text", "lang", "kept"]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in want if not w[-1])


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontamination.contamination(decontamination.find_passages(spark.createDataFrame(passages()[0], SCHEMA), none, keep=["doc_id"]))
    assert rows.filter("contaminated OR n_hit > 0 OR n_items > 0").isEmpty()
    assert decontamination.find_passages(spark.createDataFrame([], SCHEMA), none).isEmpty()


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for p in range(len(words) - 7):
        windows[tuple(words[p : p + 8])].append(p)
    covered = {q for places in windows.values() if len(places) > 1 for p in places for q in range(p, p + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def corpus():
    rng = random.Random(8)
    words = {"en": "the quick brown fox jumps over a lazy dog and runs away".split(), "de": "der schnelle braune fuchs springt über den faulen hund".split()}
    rows = [(i, "\n".join(" ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 30))), lang, "x")
            for i in range(80) for lang in [rng.choice(["en", "de"])]]
    rows += [(300, "zq#x vw|kj " * 40 + "q%z " * 30, "en", "x"), (301, "no language at all but words enough to count them " * 3, None, "x")]
    return rows + [(200 + i, t, "en", "x") for i, t in enumerate(ODD)] + [(None, "null id " * 30, "fr", "x")] + rows[:2]


def brute_log_perplexity(texts):
    """Modified Kneser-Ney of order 4 over character classes, by dictionaries."""
    def classes(text):
        near = perplexity._NEAR
        return [39] * 3 + [int(near[ord(c)]) if ord(c) < 0x250 else 34 if ord(c) < 0x3000 else 35 for c in text or ""] + [39]

    counts = [None] * 5
    counts[4] = Counter(tuple(x[i - 3 : i + 1]) for x in map(classes, texts) for i in range(3, len(x)))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts, total, left = [None] * 5, [None] * 5, [None] * 5
    for n in range(1, 5):
        often = Counter(min(c, 5) for c in counts[n].values())
        if min(often[k] for k in (1, 2, 3, 4)) == 0:
            cuts[n] = [0.5, 0.75, 0.9]
        else:
            y = often[1] / (often[1] + 2 * often[2])
            cuts[n] = [min(max(k - (k + 1) * y * often[k + 1] / often[k], 0.05), k - 0.05) for k in (1, 2, 3)]
        total[n], left[n] = Counter(), Counter()
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            left[n][g[:-1]] += cuts[n][min(c, 3) - 1]

    def estimate(gram):
        n = len(gram)
        if n == 0:
            return 1 / 40
        lower_ = estimate(gram[1:])
        context = gram[:-1]
        if not total[n][context]:
            return lower_
        c = counts[n][gram]
        own = (c - cuts[n][min(c, 3) - 1]) / total[n][context] if c else 0
        return own + left[n][context] / total[n][context] * lower_

    out = []
    for x in map(classes, texts):
        out.append(-sum(math.log(estimate(tuple(x[i - 3 : i + 1]))) for i in range(3, len(x))) / (len(x) - 3))
    return out


def test_quality_rules(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    made = perplexity.quality_rules(docs, ["doc_id", "lang", "text"]).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    key = lambda r: str(r)
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in made), key=key) == sorted(((r[0], *brute_base(r[1])) for r in rows), key=key)
    want = {t: p for (_, t, _, _), p in zip(rows, brute_log_perplexity([r[1] for r in rows]))}
    assert all(abs(r.log_perplexity - want[r.text]) < 1e-4 for r in made)
    passed = [r for r in made if not r.base_failed]
    for r in passed:
        own = [x for x in passed if x.lang == r.lang]
        middle = sorted(round(x.log_perplexity * 1000) for x in own)
        middle = (middle[(len(own) - 1) // 2] + middle[len(own) // 2]) / 2000
        away = sorted(round(abs(x.log_perplexity - middle) * math.sqrt(x.n_chars_scored) * 100) for x in own)
        spread = max(0.5, (away[(len(own) - 1) // 2] + away[len(own) // 2]) / 200 * 1.4826)
        bound = perplexity.WIDTH * spread / math.sqrt(r.n_chars_scored) + perplexity.MARGIN
        if abs(abs(r.log_perplexity - middle) - bound) > 0.01:
            assert r.kept == (abs(r.log_perplexity - middle) <= bound)
    assert not any(r.kept for r in made if r.base_failed)
    kept = perplexity.keep_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in made if r.kept)


def test_quality_rules_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert perplexity.quality_rules(empty, ["doc_id"]).isEmpty() and perplexity.keep_documents(empty).isEmpty()


def test_estimates_add_up_to_one():
    rng = np.random.default_rng(2)
    grams, counts = np.unique(rng.integers(0, 40**4, 3000), return_counts=True)
    table = np.exp(perplexity.KneserNey(grams, counts).table().astype(np.float64))
    assert np.allclose(table.reshape(-1, 40).sum(axis=1), 1, atol=1e-4)


def test_languages(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.learn(docs)
    made = langid.predict_languages(docs, model, ["doc_id", "text", "lang"]).collect()
    for r in made:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        assert letters or r.score == 0
        if r.doc_id is not None and r.doc_id < 80:
            assert r.lang_pred == r.lang
    unseen = spark.createDataFrame([(1, "quickly foxes jumping", None, "x"), (2, "schneller füchse springend", None, "x")], SCHEMA)
    assert [r.lang_pred for r in langid.predict_languages(unseen, model, ["doc_id"]).orderBy("doc_id").collect()] == ["en", "de"]
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(80))


def brute_languages(rows, text):
    """Language and score of one text, by loops over its words and the counts of labelled rows."""
    def own_words(t):
        return re.findall(r"[a-z\x80-\U0010ffff]+", (t or "").lower()) if any(c.isalpha() for c in t or "") else []

    def pieces(word, n):
        return list(word) if n == 1 else [f"^{word}$"[i : i + n] for i in range(len(word) + 3 - n)]

    langs, counts = sorted({r[2] for r in rows if r[2]}), defaultdict(Counter)
    for _, body, lang, _ in rows:
        for word in own_words(body) if lang else ():
            counts[lang, 0][word] += 1
            for n in range(1, 5):
                counts[lang, n].update(pieces(word, n))
    known = [set().union(*(counts[x, n] for x in langs)) for n in range(5)]

    def log(lang, n, token):
        return math.log((counts[lang, n][token] + 0.5) / (max(1, sum(counts[lang, n].values())) + 0.5 * (len(known[n]) + 1)))

    def value(lang, word):
        if word in known[0]:
            return log(lang, 0, word)
        for n in (4, 3, 2, 1):
            found = [log(lang, n, g) for g in pieces(word, n) if g in known[n]]
            if found:
                return sum(found) / len(found)
        return 0.0

    words = own_words(text)
    if not words:
        return "und", 0.0
    means = [sum(value(x, w) for w in words) / len(words) for x in langs]
    best = max(means)
    return langs[means.index(best)], 1 / sum(math.exp((m - best) * min(len(words), 12)) for m in means)


def test_languages_by_brute_force(spark):
    rows = corpus()
    more = [(400, "quickly foxes", None, "x"), (401, "schneller fuchs der dog", None, "x"), (402, "ключ über qqq", None, "x"), (403, "the der", None, "x")]
    asked = [r for r in rows if len(r[1] or "") < 4000] + more
    model = langid.learn(spark.createDataFrame(rows, SCHEMA))
    made = langid.predict_languages(spark.createDataFrame(asked, SCHEMA), model, ["text"]).collect()
    want = {t: brute_languages(rows, t) for _, t, _, _ in asked}
    assert len(made) == len(asked)
    for r in made:
        lang, score = want[r.text]
        assert abs(r.score - score) < 1e-3 and (r.lang_pred == lang or abs(score - 0.5) < 1e-3), r


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None, "x")], SCHEMA)
    assert langid.predict_languages(docs, langid.learn(docs), ["doc_id"]).first().lang_pred == "und"
    assert langid.keep_identified(spark.createDataFrame([], SCHEMA)).isEmpty()


def brute_license(text):
    words = WORD.findall(lower(text))
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                base.add(label)
    more, best = set(), 0.0
    for block in re.split(r"[.!?]+(?:\s+|$)|\n\s*\n", lower(text)):
        own = set(WORD.findall(block))
        for label, template in licenses.template_words(licenses.TEMPLATES):
            share = len(own & template) / len(template)
            numbers = {w for w in template if w.isascii() and w.isdigit()}
            relatives = own & set(licenses.VARIANTS) == template & set(licenses.VARIANTS)
            if relatives and numbers <= own and len(own & template) >= math.ceil(licenses.THRESHOLD * len(template) - 1e-9):
                more.add(label)
                best = max(best, share)
    score = 1.0 if base else best
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), round(score, 9)


def test_licenses(spark):
    rng = random.Random(4)
    texts = [t for v in licenses.TEMPLATES.values() for t in v] + list(licenses.PHRASES)
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(["other", "LICENSE", "under", "the"])
            parts.append(rng.choice([" ", ", "]).join(words).title() + rng.choice([".", "\n", ";\n\n", " "]))
        rows.append((i, " ".join(parts), "en", "x"))
    rows += [(200 + i, t, "en", "x") for i, t in enumerate(ODD)] + rows[:2]
    made = licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA), ["doc_id"])
    got = [(*tuple(r)[:-1], round(r.score, 9)) for r in made.collect()]
    assert sorted(got, key=str) == sorted(((r[0], *brute_license(r[1])) for r in rows), key=str)
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA), ["doc_id"]).isEmpty()
    bare = licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA), ["doc_id"], templates={})
    assert all(r.labels == r.base_labels for r in bare.collect())


NOTICES = {
    "Licensed under CC BY 4.0.": "cc-by,cc-by-4.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "Licensed under the GNU General Public License version 2.": "gpl,gpl-2.0",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl,gpl-2.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl,gpl-3.0",
    "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "lgpl-3.0",
    "It is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\").": "apache,apache-2.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4.0",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "Licensed work may be shared under terms that the owner sets.": "",
}


def test_relatives_are_told_apart(spark):
    rows = [(i, t, "en", "x") for i, t in enumerate(NOTICES)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).orderBy("doc_id").collect()
    assert [r.labels for r in got] == list(NOTICES.values())


def test_sums_of_runs():
    assert reduced(np.arange(6.0), np.array([2, 0, 3, 1])).tolist() == [1, 0, 9, 5]
