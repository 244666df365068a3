"""URL rules against brute force; quality and toxicity by held-out accuracy; the factorisation machine's identity."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import quality, queries, toxicity, url_rules
from trailmark.llm.common import remainder

DOCS = "doc_id long, text string, n_chars long, score string"
LABELS = "doc_id long, quality int, toxic int"


def brute_parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not found:
        return "", ""
    return re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]


def brute_rule(host, path):
    best = None
    for domain, begin, says in url_rules.RULES:
        if (host == domain or host.endswith("." + domain)) and path.startswith(begin) and (best is None or len(domain + begin) > len(best[0])):
            best = domain + begin, says
    return best or (None, None)


def pages():
    rng = random.Random(6)
    rows = []
    for i in range(400):
        host = rng.choice(["spam.example.net", "ok.example.net", "a.Example.ORG", "b.example.com", "example.org", "notexample.org"])
        path = rng.choice(["/en/", "/es/", "/fr/", "/de/", "/buy/"]) + str(i) + rng.choice(["", ".html", "/"])
        rows.append((i, f"http{rng.choice(['', 's'])}://{host}{path}{rng.choice(['', '?ref=1', '?page=2&ref=x', '#top'])}"))
    odd = [None, "", "no scheme", "://", "x://", "http://HOST", "http://h?x=/a://b", "http://org/", "a\nb://c.net/1", "http://x.org", "http://net//7//"]
    return rows + [(900 + i, u) for i, u in enumerate(odd)] + [(None, rows[0][1])] + rows[:2]


def test_urls(spark):
    rows = pages()
    labels = []
    for i, url in rows[:400]:
        bad = ("spam" in url and "/buy/" in url) or i % 31 == 0
        if i % 3:
            labels.append((i, int(not bad), 0))
    labels += [(1, None, None), (None, 0, 1), (2, 1, None)]
    made = url_rules.judge_urls(
        spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, LABELS), ["page_id", "url"],
        min_support=0.01, min_confidence=0.7,
    )
    got = made.collect()
    assert len(got) == len(rows)
    tokens = {
        r.url: frozenset(r.t) for r in made.select("url", url_rules.url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("t")).collect()
    }
    bad = {d: any(x[1] == 0 or x[2] == 1 for x in labels if x[0] == d) for d in {x[0] for x in labels if x[1] is not None or x[2] is not None}}
    sets = []
    for _, url in rows:
        number = re.search(r"/([0-9]+)(?:[/.]|$)", brute_parts(url)[1])
        if number and int(number[1]) in bad and tokens[url]:
            sets.append((tokens[url], bad[int(number[1])]))
    held, hits = {}, {}
    for own, is_bad in sets:
        for k in range(1, len(own) + 1):
            for part in combinations(sorted(own), k):
                held[part] = held.get(part, 0) + 1
                hits[part] = hits.get(part, 0) + is_bad
    least = -(-0.01 * len(sets) // 1)
    mined = [set(p) for p, n in held.items() if hits[p] >= least and hits[p] / n >= 0.7]
    assert mined
    for r in got:
        host, path = brute_parts(r.url)
        rule, verdict = brute_rule(host, path)
        own = "block" if any(m <= tokens[r.url] for m in mined) else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or own), r


def test_urls_without_labels_or_pages(spark):
    none = spark.createDataFrame([], LABELS)
    made = url_rules.judge_urls(spark.createDataFrame(pages(), "page_id long, url string"), none, ["page_id"])
    assert made.filter("rule IS NULL AND verdict <> 'allow'").isEmpty() and made.count() == len(pages())
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string"), none, ["page_id"]).isEmpty()


def test_words_of_labels_and_segments(spark):
    urls = ["http://www.Free-Bets24.example.com/buy_now/12.html?a=1", "http://org/x", None]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_rules.host_of(F.col("url")).alias("h"), url_rules.path_of(F.col("url")).alias("p"))
    got = {r.url: set(r.t) for r in rows.select("url", url_rules.url_tokens(F.col("url"), F.col("h"), F.col("p")).alias("t")).collect()}
    words = {f"word={w}" for w in ("free", "bets", "buy", "now", "html")}
    assert got[urls[0]] == words | {"host=www", "host=free-bets24", "host=example", "host=com", "path=buy_now", "path=0.html", "query=a"}
    assert got[urls[1]] == {"host=org", "path=x"} and got[None] == set()


def test_kept_columns_named_like_internal_and_result_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org/1", "t", "h", "r", 7)], "page_id long, url string, tokens string, host string, rule string, doc_id int")
    labels = spark.createDataFrame([(1, 0, 0)], LABELS)
    row = url_rules.judge_urls(pages, labels, pages.columns).first()
    assert (row.tokens, row.host, row.rule, row.doc_id, row.url) == ("t", "a.org", "org/", 7, "http://a.org/1")


def test_pairs_in_linear_time():
    rng = np.random.default_rng(1)
    model = quality.FactorizationMachine(30, 4)
    model.bias, model.weights = 0.3, rng.normal(size=30)
    index, value, sizes = rng.integers(0, 30, 12), rng.normal(size=12), np.array([5, 0, 7])
    got, at = model.scores(index, value, sizes), 0
    for row, n in enumerate(sizes):
        i, x = index[at : at + n], value[at : at + n]
        at += n
        raw = model.bias + (model.weights[i] * x).sum()
        raw += sum(model.factors[i[a]] @ model.factors[i[b]] * x[a] * x[b] for a in range(n) for b in range(a))
        assert abs(got[row] - 1 / (1 + np.exp(-raw))) < 1e-9


def labelled():
    """Junk and toxic texts among plain ones, with odd rows and labels."""
    rng = random.Random(2)
    words = [a + b for a in ("ba", "ke", "li", "mo", "nu") for b in ("ra", "so", "tu", "vi", "we", "xy")]
    docs, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        junk, toxic = rng.random() < 0.25, rng.random() < 0.25
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["you idiot", "stupid", "grunzel", "grunzend", "worthless"]))
        if junk:
            text = [w + rng.choice(["###", "|", "$$"]) for w in text]
        docs.append((i, " ".join(text), len(" ".join(text)), "x"))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(2000, None, None, "x"), (2001, "", 0, "x"), (2002, "...", 3, "x"), (2003, "long " * 20000, 10, "x"), (None, "null id", 7, "x"), docs[0]]
    labels += [(5000, 1, 1), (None, 1, 1), (0, None, None), labels[1]]
    return docs, labels


@pytest.mark.parametrize("name,column,threshold", [("quality", 1, 0.5), ("toxicity", 2, 0.7)])
def test_held_out_accuracy(spark, name, column, threshold):
    docs, labels = labelled()
    frame, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    may = remainder("doc_id", 3) != 1
    if name == "quality":
        made = quality.score_quality(frame, quality.learn(frame, known, may), ["doc_id"])
    else:
        made = toxicity.learn(frame, known, may).score(frame, ["doc_id"])
    rows = made.collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    truth = {r[0]: r[column] for r in labels[:900]}
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum((r.score >= threshold) == bool(truth[r.doc_id]) for r in held)
    assert len(held) > 200 and right / len(held) > 0.93


def test_without_labels_every_text_gets_the_same_score(spark):
    frame, none = spark.createDataFrame(labelled()[0][:5], DOCS), spark.createDataFrame([], LABELS)
    may = remainder("doc_id", 3) != 1
    assert {r.score for r in toxicity.learn(frame, none, may).score(frame, ["doc_id"]).collect()} == {0.0}
    assert quality.score_quality(frame, quality.learn(frame, none, may), ["doc_id"]).count() == 5
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.learn(empty, none, may).score(empty, ["doc_id"]).isEmpty()
    assert quality.score_quality(empty, quality.learn(empty, none, may), ["doc_id"]).isEmpty()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, con, name):
    made = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    want = con.execute(queries.ORACLE[name]).fetchdf()[list(made.columns)]
    order = list(made.columns)
    left, right = (x.sort_values(order).reset_index(drop=True) for x in (made, want))
    assert len(left) and left.astype(object).where(left.notna(), None).equals(right.astype(object).where(right.notna(), None))


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "decontaminate", "pack"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, ids = docs.schema, {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        kept = docs.collect()
        assert docs.schema == schema and {r.doc_id for r in kept} <= ids and kept
        ids = {r.doc_id for r in kept}
        docs = spark.createDataFrame(kept, schema)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == ids
