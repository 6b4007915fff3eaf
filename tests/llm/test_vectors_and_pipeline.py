"""Vector searches against brute force, the pipeline against its stages, and the registered queries' shapes."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from lilt.llm import near_vectors, queries, top_k

SF = "/root/testdata/sf0.001"
SHAPE = "vec_id long, embedding array<float>, score string, rank string, block int, part int"


def table(spark, n, dim, seed, spread=1.0):
    draw = np.random.default_rng(seed)
    vectors = draw.standard_normal((n, dim)) * np.exp(draw.standard_normal((n, 1)) * spread)
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(vectors)]
    rows[7] = (7, rows[5][1])  # equal vectors
    rows[8] = (8, [-x for x in rows[5][1]])
    rows += [(n, None), (n + 1, [0.0] * dim), (n + 2, [math.nan] * dim), (n + 3, [None] * dim), (n + 4, [math.inf] * dim), (None, rows[3][1]), (9, rows[9][1]), (n + 5, [1.0, 2.0])]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SHAPE).repartition(4), rows


def usable(rows, dim):
    kept = {k: v for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    return {k: v + [0.0] * (dim - len(v)) for k, v in kept.items()}


@pytest.mark.parametrize(("spread", "blocks"), [(1.0, 64), (0.0, 64), (1.0, 4096)])
def test_exact_top_k(spark, spread, blocks):
    frame, rows = table(spark, 700, 24, 3, spread)
    got = top_k.top_k(frame, F.col("vec_id") % 10 == 0, lambda x: F.floor(x * 256).cast("long"), 5, blocks, 32).collect()
    whole = {k: [math.floor(256 * x) for x in v] for k, v in usable(rows, 24).items()}
    expected = {}
    for q in (k for k in whole if k % 10 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), k) for k, v in whole.items() if k != q)[:5]
        expected.update({(q, r + 1): (k, -s) for r, (s, k) in enumerate(scores)})
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == expected
    assert top_k.top_k(frame.limit(0), F.col("vec_id") % 10 == 0, lambda x: F.floor(x * 256).cast("long")).collect() == []


def test_products_beyond_doubles():
    big = np.array([[2**40, 3], [1, 1]], dtype=np.int64)
    assert top_k.exact_products(big, big).tolist() == [[2**63 - 1, 2**40 + 3], [2**40 + 3, 2]]
    assert top_k.exact_products(big // 2**12, big).tolist() == [[2**63 - 1, 2**28], [0, 0]]


def test_nearest(spark):
    frame, rows = table(spark, 2500, 16, 4)
    asked = F.col("vec_id") % 25 == 0
    got = near_vectors.nearest(frame, asked, block_rows=512, query_rows=40).collect()
    whole = {k: np.array(v) for k, v in usable(rows, 16).items() if any(v)}
    ids = np.array(sorted(whole))
    unit = np.stack([whole[k] / np.linalg.norm(whole[k]) for k in ids])
    hits = 0
    for q in (k for k in whole if k % 25 == 0):
        score = unit @ (whole[q] / np.linalg.norm(whole[q]))
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and len({r.vec_id for r in mine}) == len(mine) and q not in {r.vec_id for r in mine}
        for r in mine:
            assert r.score == pytest.approx(score[np.searchsorted(ids, r.vec_id)], abs=1e-12)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        best = [int(k) for k in ids[np.lexsort((ids, -score))] if k != q][:5]
        hits += len(set(best) & {r.vec_id for r in mine}) / 5
    assert hits / sum(1 for k in whole if k % 25 == 0) >= 0.9
    assert near_vectors.nearest(frame.limit(0), asked).collect() == []


def test_perturbations_come_in_expected_order():
    m, sets = 5, near_vectors.perturbations(5, 60)
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    cost += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    totals = [sum(c for c, s in zip(cost, row) if s) for row in sets.tolist()]
    assert totals[0] == 0 and np.diff(totals).min() > -1e-12 and len({tuple(r) for r in sets.tolist()}) == 60
    assert all(not (row[j] and row[2 * m - 1 - j]) for row in sets.tolist() for j in range(m))


def test_probes_follow_the_measured_recall():
    """Random vectors of 64 dimensions in a table of 200,000 rows, hashed as one of 3 million: fixed probes lose recall."""
    draw = np.random.default_rng(5)
    x = draw.standard_normal((200_000, 64), dtype=np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    score = x[:200] @ x.T
    score[np.arange(200), np.arange(200)] = -9
    near = np.argpartition(-score, 5, axis=1)[:, :5]
    q, v = np.repeat(x[:200], 5, axis=0).astype(float), x[near.ravel()].astype(float)
    learned = slice(0, 600)
    n = 3_000_000
    m = near_vectors.key_length(n)
    fixed = near_vectors.Hashes(64, m, 8, 11), near_vectors.perturbations(m, near_vectors.probe_count(m))
    hashes, sets = near_vectors.tuned(64, n, 8, 11, q[learned], v[learned])
    share = lambda h, s: float((near_vectors.places(h, s, q[600:], v[600:]) < len(s)).mean())
    assert share(*fixed) < 0.9 <= share(hashes, sets)


def test_one_bucket_holds_all_rows():
    far = np.eye(6)
    hashes, sets = near_vectors.tuned(6, 10**9, 1, 3, far, -far, 1.0)
    assert (near_vectors.places(hashes, sets, far, -far) < len(sets)).all()
    assert (near_vectors.places(near_vectors.Hashes(6, 0, 2, 3), near_vectors.perturbations(0, 9), far, -far) == 0).all()


def test_recall_on_the_table(spark):
    got = queries.QUERIES["op3_multiprobe_nearest"](spark, "/root/testdata/sf0.01")
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    pairs = []
    for k in np.flatnonzero(ids % 50 == 0):
        score = x @ x[k]
        score[k] = -9
        pairs += [(int(ids[k]), int(ids[j])) for j in np.argsort(-score)[:5]]
    assert near_vectors.recall(got, spark.createDataFrame(pairs, "query_id long, vec_id long")) >= 0.9


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == start, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in packed) == sorted((r.doc_id, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())


def test_pipeline_edges(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, _row int, size int"
    english = "the cat and the dog went over the hill with another brother "
    rows = [(k, english * (1 + k % 3) + str(k) * 5, "en", "s", 5, 1, 2) for k in range(30)]
    rows += [(40, None, "en", None, 0, None, None), (41, "", None, "s", 0, 1, 1), (42, "12345 !!!", "en", "s", 9, 1, 1), (43, english, None, None, None, None, None), (None, english, "en", "s", 1, 1, 1)]
    docs = spark.createDataFrame(rows, shape)
    for data in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            data = stage(spark, data, SF)
            data.collect()
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == set(range(30)) | {43, None}


def test_pipeline_keeps_a_corpus_without_languages(spark):
    rows = [(k, f"document number {k} says nothing new", None, "s", 5) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.identify_language(spark, docs, SF).count() == 20


def planted():
    """Clean documents of two languages, foreign ones, repeated lines, copies, near copies and repeated rows."""
    draw = random.Random(8)
    vocabulary = {"en": [f"{a}{b}ing" for a in "bcdfgh" for b in ("al", "er", "on", "ut")], "de": [f"ge{a}{b}ung" for a in "klmnst" for b in ("au", "ei", "ie", "oh")]}
    prose = lambda lang, n: " ".join(draw.choice(vocabulary[lang]) for _ in range(n))
    rows = []
    for k in range(60):
        lang = "en" if k % 2 else "de"
        text = "\n".join([prose(lang, 40), "A line of every page in this place.", prose(lang, 30)])
        rows.append((k, text, lang, "abc"[k % 3]))
    rows += [(100 + k, rows[k][1], rows[k][2], "a") for k in range(10)]  # copies
    for k in range(10, 20):  # near copies
        words = rows[k][1].split(" ")
        words[35] = "changed"
        rows.append((200 + k, " ".join(words), rows[k][2], "b"))
    rows += [rows[3]] * 4 + [(k, "", None, None) for k in (300, 301)] + [(302, None, "en", "a")]
    rows += [(400 + k, "".join(draw.choice("ѐѓєѕіїјљњ ") for _ in range(80)), None, "c") for k in range(5)]  # a script nobody taught
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in rows]


def test_pipeline_against_plain_decisions(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    plain = lambda frame: Counter((r.doc_id, r.text) for r in frame.collect())
    stages = dict(corpus_pipeline.STAGES)

    # Language: texts without a letter and the foreign ones go, nothing else.
    docs = stages["language_id"](spark, docs, SF)
    rows = [r for r in rows if r[1] and not 400 <= r[0] < 410]
    assert plain(docs) == Counter((r[0], r[1]) for r in rows)

    # Lines: a line of ten characters stays in the smallest document that holds it.
    first = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    for d, t, *_ in rows:
        for line in t.split("\n"):
            first[key(line)] = min(first.get(key(line), d), d)
    rows = [(d, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == d), *more) for d, t, *more in rows]
    docs = stages["line_dedup"](spark, docs, SF)
    assert plain(docs) == Counter((r[0], r[1]) for r in rows)

    # Near duplicates: the smallest document of each component, once.
    sets = {}
    for d, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sorted(sets):
        for b in sorted(sets):
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * len(sets[a] | sets[b]):
                a_root, b_root = sorted((root(a), root(b)))
                parent[b_root] = a_root
    kept = {d for d in sets if root(d) == d}
    docs = stages["ngram_jaccard_join"](spark, docs, SF)
    assert plain(docs) == Counter({(d, t): 1 for d, t, *_ in rows if d in kept})
    rows = list({d: r for r in rows for d in [r[0]] if d in kept}.values())

    # Mixing: each document at most twice, each source within a document of its target.
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for r in rows:
        total[r[3]] = total.get(r[3], 0) + size(r[1])
    weights = dict(zip(sorted(total), (3, 1, 2)))
    target, open_, budget = {}, set(total), 1.5 * sum(total.values())
    while open_:  # water filling
        level = (budget - sum(target.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * total[s]}
        for s in full or open_:
            target[s] = 2 * total[s] if full else level * weights[s]
        open_ -= full or open_
    docs = stages["source_mix"](spark, docs, SF)
    taken = plain(docs)
    assert set(taken) <= {(r[0], r[1]) for r in rows} and max(taken.values()) <= 2
    for s in total:
        got = sum(n * size(t) for (d, t), n in taken.items() if {r[0]: r[3] for r in rows}[d] == s)
        assert target[s] - 80 <= got <= target[s] + 1  # documents have 70 to 80 words

    # Packing: every id of every document that was taken, no overlap and no hole.
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(queries.tokenizer())
    packed = stages["best_two_fit"](spark, docs, SF).collect()
    lengths = Counter()
    for (d, t), n in taken.items():
        lengths[d] += n * (len(encoder.encode(t, add_special_tokens=False).ids) + 1)
    got, places = Counter(), {}
    for r in packed:
        got[r.doc_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == lengths
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_contract_names():
    names = contract.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
