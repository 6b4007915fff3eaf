"""Merkle proofs against trees built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lilt.llm import merkle

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank long, digest string, depth int, path string, copy string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)))


def tree(leaves, fanout):
    """(root, for each leaf its levels of (left, right))."""
    paths, places, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, p in enumerate(places):
            run = level[p // fanout * fanout : p // fanout * fanout + fanout]
            paths[k].append((run[: p % fanout], run[p % fanout + 1 :]))
        level = [H(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
        places = [p // fanout for p in places]
    return level[0], paths


def expected(rows, fanout=8):
    groups = {}
    for doc, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((doc, leaf(doc, source, lang, n, text), text, source, n))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    roots = [tree([r[1] for r in groups[g]], fanout) for g in order]
    root, upper = tree([r for r, _ in roots], fanout)
    out = []
    for g, (sub, paths), top in zip(order, roots, upper):
        for (doc, digest, text, source, n), path in zip(groups[g], paths):
            whole = path + top
            proof = H(*(x for left, right in whole for x in left + right))
            low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            at = leaf(doc, source, g, n, low) if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 else digest
            for left, right in whole:
                at = H(*left, at, *right)
            out.append((doc, digest, sub, root, proof, at, at == root))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "d", 2, "p", "c") for r in rows], SHAPE).repartition(3)


def many(n):
    rows = [(k, f"Text {k}" if k % 7 else None, ["en", "de", None, "é", ""][min(k % 11, 4)] if k > 3 else f"lone{k}", "S" if k % 2 else None, k * 3) for k in range(n)]
    same = (50, "Twice THE same", "en", "S", 1)
    return rows + [same] * 20 + [(None, "no id", "en", None, None), (None, "", None, "x", 2), (n, "L" * 300_000, "fr", "", -1)]


def found(frame):
    return sorted(map(tuple, merkle.document_proofs(frame).collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65, 700])
def test_proofs(spark, n):
    rows = many(n) if n > 8 else [(k, f"A{k}", "en", "s", 1) for k in range(n)]
    got = found(table(spark, rows))
    assert got == (expected(rows) if rows else [])


def test_many_groups(spark):
    rows = [(k, f"Doc {k}", f"g{k % 90}", None, k) for k in range(300)]
    assert found(table(spark, rows)) == expected(rows)


def test_some_requests_and_another_fanout(spark):
    rows = [(k, f"Doc {k}", "abc"[k % 3], None, k) for k in range(200)]
    frame = table(spark, rows)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tree3 = merkle.manifest(frame, "lang", ["doc_id"], merkle.leaf_digest(*fields), [F.col("doc_id")], fanout=3)
    asked = merkle.proofs(tree3, tree3.leaves.where("doc_id IN (0, 7, 199)"))
    got = {r.doc_id: (r.proof, r.again) for r in asked.select("doc_id", merkle.proof_digest(F.col("path")).alias("proof"), merkle.folded(F.col("path"), F.col("digest")).alias("again")).collect()}
    want = {r[0]: (r[4], r[3]) for r in expected(rows, 3) if r[0] in (0, 7, 199)}
    assert got == want


def test_a_changed_sibling_is_noticed(spark):
    frame = table(spark, many(40))
    before, after = found(frame), found(frame.withColumn("text", F.when(F.col("doc_id") == 11, "changed").otherwise(F.col("text"))))
    assert {r[3] for r in before}.isdisjoint({r[3] for r in after})
