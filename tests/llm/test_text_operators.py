"""Text operators against plain Python on small tables with NULLs, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lilt.llm import jaccard_join, language_id, line_dedup, mixing, packing, personal_data, sharding, token_files
from lilt.llm.common import TokenIds, components, mix

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = "size long, _row string, n long, part int, bucket string, score double, rank int, _hash long, start long"
SHAPE = f"doc_id long, text string, lang string, source string, {EXTRA}"
EMPTY = (None,) * len(EXTRA.split(", "))


def words(n, seed, kinds=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(kinds)}" for _ in range(n))


def near(text, every):
    out = text.split(" ")
    for k in range(every, len(out), every):
        out[k] += "x"
    return " ".join(out)


def rows():
    base, long = words(200, 1), words(30_000, 2, 5000)
    common = "The same closing line of every page."
    out = [
        (0, None, "en", None), (1, "", "en", "a"), (2, " \n\t ", None, "a"), (3, base, "en", "a"), (4, base, "en", "b"),
        (5, near(base, 80), "en", "b"), (6, near(base, 7), "en", None), (7, long, "en", "b"), (8, long + " tail", None, "B"),
        (9, "one two", "de", "B"), (10, "One  TWO", "de", "a"), (11, f"first\n{common}\nlast", "en", "a"), (12, f"{common}\n{common}\n  {common.upper()} ", "en", "a"),
        (12, f"{common}\n{common}\n  {common.upper()} ", "en", "a"), (None, f"{common}\nno id", "en", "a"), (13, "!!! 123", "en", ""), (14, "écart naïve\n\nécart naïve", "fr", "é"),
        (15, base, "en", "a"), (15, base, "en", "a"),
    ]
    for k in range(20, 60):  # a group of near copies above the plain limit, each linked to its base
        text = words(120, 77).split(" ")
        text[3 * (k - 20) % 118] = f"own{k}"
        out.append((k, " ".join(text), "en", "hot"))
    return [(*row, *EMPTY) for row in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SHAPE).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def union_find(pairs, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def linked(sets):
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                yield a, b


@pytest.mark.parametrize("list_rows", [1 << 16, 7])
def test_jaccard_join(docs, none, monkeypatch, list_rows):
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", list_rows)
    sets = {r[0]: shingles(r[1]) for r in rows() if r[0] is not None}
    expected = union_find(linked(sets), sets)
    got = jaccard_join.join_components(docs).collect()
    assert len(got) == len(rows())
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {d: (len(sets[d]), expected[d]) for d in sets}
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    found = [r.doc_id for r in kept.collect()]
    assert sorted(d for d in found if d is not None) == sorted(d for d in sets if expected[d] == d) and found.count(None) == 1
    assert jaccard_join.join_components(none).collect() == []


def test_rows_without_id_and_repeated_rows(spark):
    """Repeated rows leave one, also without doc_id; a text that a numbered document holds goes with that document."""
    text = {k: words(60, k) for k in range(8)}
    rows = [(k, text[k]) for k in range(4) for _ in range(3)] + [(None, text[k]) for k in range(2, 8) for _ in range(3)] + [(None, None)] * 2 + [(9, text[9 % 8] + " tail")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, str(r.text)) for r in kept) == sorted(
        [(False, k, text[k]) for k in range(4)] + [(True, 0, text[k]) for k in range(4, 8)] + [(True, 0, "None")]
    )


def test_unlinked_documents_that_share_boilerplate(spark, monkeypatch):
    """Half of each text is the same in all; a few pairs among them link. The pairs that are made stay few and none is lost."""
    made = []
    whole = jaccard_join._across
    monkeypatch.setattr(jaccard_join, "_across", lambda member, sketch: made.append(whole(member, sketch).count()) or whole(member, sketch))
    for share, seed in ((60, 5), (120, 6), (200, 7)):
        common = words(share, seed)
        rows = [(k, common + " " + words(100, 100 + k)) for k in range(80)] + [(k + 500, common + " " + near(words(100, 100 + k), 30)) for k in range(0, 80, 9)]
        sets = {k: shingles(t) for k, t in rows}
        got = jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert {r.doc_id: r.component_id for r in got} == union_find(linked(sets), sets)
        assert made[-1] <= 2 * len(rows)


def test_pairs_that_cells_alone_let_pass(spark):
    """Sets with the same counts in all cells share little; prints tell them apart and keep those that link."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    cell = (mix(pool) % np.uint64(jaccard_join.CELLS)).astype(np.int64)
    by_cell = [pool[cell == c] for c in range(jaccard_join.CELLS)]
    sets = [np.sort(np.array([x[k] for x in by_cell])) for k in range(20)]  # nothing in common, one shingle a cell
    sets.append(np.sort(np.concatenate((sets[0][:240], sets[1][240:]))))
    shingles = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "doc_id long, shingles binary")
    member = spark.createDataFrame([(7, k, 256, k) for k in range(21)], "sig long, doc long, size long, component long")
    got = {(r.a, r.b) for r in jaccard_join._across(member, jaccard_join.sketches(shingles)).collect()}
    assert got == {(0, 20)}


def test_pairs_of_lists_and_sketches():
    """Pairs of lists once, over several batches and groups, without those that the sketches rule out."""
    import pandas as pd

    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 60, size=70).astype(np.uint64)
    sets = {k: np.unique(np.concatenate((base[:40], draw.integers(0, 1 << 60, size=30).astype(np.uint64))) if k % 3 else base[: 60 + k % 5]) for k in range(40)}
    cells = lambda x: np.bincount((jaccard_join.mix(x) % np.uint64(jaccard_join.CELLS)).astype(np.int64), minlength=jaccard_join.CELLS).astype(np.uint8).tobytes()
    rows, lists = [], [(1, 0, 11, range(0, 25)), (1, 0, 12, range(5, 30)), (1, 1, 13, range(20, 40)), (2, 0, 14, range(0, 40, 7))]
    for first, task in {(f, t) for f, t, *_ in lists}:
        held = {d for f, t, _, ds in lists if (f, t) == (first, task) for d in ds}
        rows += [(first, task, 0, 0, d, 0, 0, cells(sets[d]) if d != 8 else None) for d in held]
    rows += [(f, t, 1, s, d, len(sets[d]), d % 4, None) for f, t, s, ds in lists for d in ds]
    frame = pd.DataFrame(sorted(rows, key=lambda r: r[:4]), columns=["first", "task", "listing", "sig", "doc", "size", "component", "sketch"])
    parts = [frame.iloc[k : k + 9].reset_index(drop=True) for k in range(0, len(frame), 9)]
    got = Counter((int(a), int(b)) for out in jaccard_join._made_pairs(iter(parts)) for a, b in out.itertuples(index=False))
    every = {(a, b) for _, _, _, ds in lists for a in ds for b in ds if a < b and a % 4 != b % 4 and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b]))}
    links = {(a, b) for a, b in every if 7 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (len(sets[a]) + len(sets[b]))}
    assert links and links <= set(got) <= every and len(got) < len(every) / 2


def test_long_regular_words(spark):
    """Two words of equal length whose polynomial hashes agree modulo 2**64."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    got = jaccard_join.join_components(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), min_size=0, max_size=50), min_size=2, max_size=12), st.integers(0, 99))
def test_signatures_meet(sets, seed):
    """All pairs that link share a signature, and do so outside any few that are left out."""
    draw = random.Random(seed)
    sets += [[x for x in s if draw.random() > 0.1] for s in sets]
    arrays = [np.unique(np.array(s, dtype=np.uint64)) for s in sets]
    flat, bounds = np.concatenate(arrays), np.cumsum([0, *map(len, arrays)])
    entries, scheme = jaccard_join.SCHEMES.entries(np.diff(bounds))
    sig, entry, marked, spare_of = jaccard_join.signatures(flat, bounds, entries, scheme)
    units = {(int(r), int(s)): int(u) for r, s, u in zip(entries, scheme, spare_of)}
    held = defaultdict(dict)
    for s, e, m in zip(sig.tolist(), entry.tolist(), marked.tolist()):
        held[int(entries[e]), int(scheme[e])][s] = 1 + m
    for a in range(len(arrays)):
        for b in range(a):
            x, y = set(arrays[a].tolist()), set(arrays[b].tolist())
            if x != y and len(x & y) and 100 * len(x & y) >= 75 * len(x | y):
                met = False
                for which in {s for r, s in held if r == a} & {s for r, s in held if r == b}:
                    mine = list(held[a, which].items())
                    draw.shuffle(mine)
                    spare, left = units[a, which], set()
                    for s, cost in mine:
                        if cost <= spare:
                            spare -= cost
                            left.add(s)
                    met |= bool((held[a, which].keys() - left) & held[b, which].keys())
                assert met


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    nodes = {x for a, b in edges for x in (a, b) if a != b}
    assert got == union_find([e for e in edges if e[0] != e[1]], nodes)
    assert components(spark.createDataFrame([], "a long, b long"), "test").collect() == []


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def test_line_dedup(docs, none):
    holders = defaultdict(set)
    for r in rows():
        if r[0] is not None:
            for line in (r[1] or "").split("\n"):
                holders[key(line)].add(r[0])

    def expected(doc_id, text):
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or doc_id is None or min(holders[key(x)]) >= doc_id]
        return len(lines), len(lines) - len(kept), "\n".join(kept)

    got = line_dedup.dedup_lines(docs)
    found = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect())
    assert found == Counter((r[0], *expected(r[0], r[1])) for r in rows())
    assert set(docs.columns) <= set(got.columns)
    assert line_dedup.dedup_lines(none).collect() == []


def test_line_runs_over_partitions(spark):
    """One line in most documents, over many partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = [(k, f"a line that is everywhere\nonly in {k} and nowhere else") for k in range(2000)]
        got = line_dedup.dedup_lines(spark.createDataFrame(table, "doc_id long, text string").repartition(7)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n_dropped for r in got) == 1999
    assert [r.doc_id for r in got if not r.n_dropped] == [0]


@pytest.mark.parametrize("limit", [1, 500, 5_000, 10**9])
def test_shards(docs, none, limit):
    got = sharding.shard(docs, limit).collect()
    assert len(got) == len(rows())
    size, keys = Counter(), defaultdict(set)
    for r in got:
        size[r.shard] += r.row_bytes
        keys[r.shard].add(r.doc_id)
    for r in got:
        assert r.shard_bytes == size[r.shard] and len(r.shard) == r.shard_depth
        assert r.oversized == (size[r.shard] > limit) and (not r.oversized or len(keys[r.shard]) == 1)
    for a in size:  # no shard is inside another, and no split was needless
        assert not any(b != a and b.startswith(a) for b in size)
        if a:
            assert sum(n for b, n in size.items() if b.startswith(a[:-1])) > limit
    assert sharding.shard(none, limit).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t aB1'.!éñ日_<|>sx"), max_size=30), max_size=8))
def test_token_ids_of_any_text(texts):
    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    ids, bounds = test_token_ids_of_any_text.encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])] == [plain.encode(x, add_special_tokens=False).ids + [0] for x in texts]


test_token_ids_of_any_text.encoder = TokenIds(TOKENIZER, keep=50)


def test_token_ids_keep_words_without_marks():
    """Marks behind a word are parts of their own, and words that come again outlive a full store."""
    encoder = TokenIds(TOKENIZER, keep=12_000)
    plain = Tokenizer.from_file(TOKENIZER)
    for k in range(40):
        text = " again, again. again! again? again; again: again" + "".join(f" w{k}x{j}a," for j in range(60)) + " it's, A1, é, b,c ,"
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]
        names = encoder.names.to_pylist()
        assert len(names) == len(set(names)) and names.count(" again") == 1 and " again," not in names
        learned = len(names) if not k else learned + len(set(names) - before)
        before = set(names)
    assert learned < 40 * 61 + 30 and len(names) < 40 * 61  # the store was thinned, and only new words were learned


def tokens():
    plain = Tokenizer.from_file(TOKENIZER)
    return [(r[0], plain.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows()]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_files(spark, docs, none):
    folder = token_files.new_folder(spark)
    token_files.write_tokens(docs, TOKENIZER, folder)
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows()), key=lambda d: -1 if d is None else d)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == Counter((d, tuple(ids)) for d, ids in tokens())
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    folder = token_files.new_folder(spark)
    token_files.write_tokens(none, TOKENIZER, folder)
    assert token_files.read_tokens(spark, folder).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=2000), st.integers(1, 40))
def test_huffman_round_trip(ids, power):
    counts = Counter(ids)
    counts = {x: n**power for x, n in counts.items()}
    symbols, lengths = token_files.code_lengths(counts)
    assert lengths.max() <= 16 and sum(2.0 ** -int(x) for x in lengths) <= 1
    code = token_files.Code(symbols, lengths)
    bits, offsets = code.write(np.array(ids))
    assert code.read(bits, offsets, len(ids)).tolist() == ids


def test_huffman_is_optimal_below_the_limit():
    symbols, lengths = token_files.code_lengths({0: 5, 1: 9, 2: 12, 3: 13, 4: 16, 5: 45})
    assert dict(zip(symbols.tolist(), lengths.tolist())) == {0: 4, 1: 4, 2: 3, 3: 3, 4: 3, 5: 1}


@pytest.mark.parametrize("width", [16, 2048])
def test_packing(docs, none, width):
    got = packing.pack(packing.pieces(docs, TOKENIZER, width), width)
    packed = got.collect()
    per_sequence = defaultdict(list)
    for r in packed:
        per_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.piece == 0 or r.length == width
    for slots in per_sequence.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= width
    whole = Counter()
    for d, ids in tokens():
        pieces = -(-len(ids) // width)
        first = len(ids) - (pieces - 1) * width
        cuts = [0] + [first + k * width for k in range(pieces)]
        whole.update((d, k, cuts[k], cuts[k + 1] - cuts[k], crc(ids[cuts[k] : cuts[k + 1]])) for k in range(pieces))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == whole
    total = sum(len(ids) for _, ids in tokens())
    assert len(per_sequence) <= -(-total // width) * 1.1 + 1
    filled = {r.sequence_id: r for r in packing.sequences(got).collect()}
    for r in packed:
        assert crc(np.frombuffer(filled[r.sequence_id].ids, "<u4")[r.offset : r.offset + r.length]) == r.ids_crc32
    assert packing.pack(packing.pieces(none, TOKENIZER, width), width).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_patterns_use_each_piece_once(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, dtype=np.int64)
    found = packing.patterns(counts, 40)
    assert all(sum(items) <= 40 for _, items in found)
    used = Counter()
    for times, items in found:
        for x in items:
            used[x] += times
    assert used == Counter(lengths)


def test_two_replace_the_shortest():
    counts = np.zeros(101, dtype=np.int64)
    for x in (60, 30, 19, 20):
        counts[x] += 1
    assert packing.patterns(counts, 100)[0] == (1, [60, 20, 19]) or sum(packing.patterns(counts, 100)[0][1]) == 99


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m.group().split(".") if kind == "ip"),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PRIVATE = [
    "mail a.b@c.de, x@y.z_q@w.org.uk and @no.one a@b", "é 日 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4111  1111", "+1 (415) 555-2671 and +49 30 1234567. +1-2 +",
    "pay 4012888888881881x and 5500005555555559 " * 50, "1 " * 20_000, "a." * 20_000 + "@" + "b." * 20_000 + "c", "9" * 50_000, "+" + "1-" * 9_000,
    None, "", "call me: 415-555-2671 or write to joe [at] example [dot] com",
]


def test_personal_data(spark):
    table = [(k, t, "x") for k, t in enumerate(PRIVATE)] + [(0, PRIVATE[0], "y"), (None, PRIVATE[1], "z")]
    docs = spark.createDataFrame(table, "doc_id long, text string, kind string")
    got = personal_data.summary(docs, personal_data.find(docs)).collect()
    assert len(got) == len(table)
    expected = Counter()
    for d, text, _ in table:
        spans = base_spans(text)
        expected[(d, *[sum(s.startswith(kind) for s in spans) for kind in BASE], hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == expected
    for r in got:
        text = PRIVATE[1] if r.doc_id is None else PRIVATE[r.doc_id]
        assert set(base_spans(text)) <= set(filter(None, r.spans.split(",")))
    clean = personal_data.summary(docs.limit(0), personal_data.find(docs.limit(0))).collect()
    assert clean == []


def test_reliabilities_follow_agreement():
    patterns = [("email", (1, 1, 1, 1), 100.0), ("email", (-1, -1, 0, -1), 100.0), ("email", (1, 1, -1, 1), 5.0), ("email", (1, -1, 0, -1), 5.0)]
    _, _, posterior = personal_data.reliabilities(patterns)
    assert posterior[0] > 0.9 and posterior[1] < 0.1 and posterior[2] > 0.5 > posterior[3]


def water_fill(sizes, weights, total, cap):
    """Rounds as in the definition: fill by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {s: 0.0 for s in names}, set(names), float(total)
    while open_ and left > 1e-9:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if target[s] + unit * weight[s] >= cap * sizes[s] - 1e-9}
        if not over:
            for s in open_:
                target[s] += unit * weight[s]
            break
        for s in over:
            left -= cap * sizes[s] - target[s]
            target[s] = cap * sizes[s]
        open_ -= over
    return target


def test_the_programme_sees_all_lengths():
    """1,199 lengths, all even but one: only that one closes an odd budget."""
    lengths = [2 * k for k in range(1, 1200)] + [2 * 777 + 1]
    order = sorted(range(1200), key=lambda i: lengths[i])
    lengths, counts = [lengths[i] for i in order], [1] * 1200
    for budget in (30_001, 5_001, 20_000):
        taken = mixing.fit_lengths(lengths, counts, budget)
        assert sum(x * k for x, k in zip(lengths, taken)) == budget and all(0 <= k <= 1 for k in taken)


def test_repeated_rows_in_the_mix(spark):
    """Equal rows are counted, rows that differ elsewhere take turns; as many come out as the mix takes."""
    rows = [(1, "a b c", "s", k % 2) for k in range(40)] + [(2, "d e", "t", 0)] * 7 + [(k, words(9, k), "u", 5) for k in range(3, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(3)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    out = mixing.mixed_documents(docs).collect()
    assert Counter(r.doc_id for r in out) == +want and {r.extra for r in out if r.doc_id == 1} == {0, 1}


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += count(r[1])
    aims = water_fill(sizes, (3, 1, 2), 1.5 * sum(sizes.values()), 2)
    taken, least = Counter(), defaultdict(lambda: 10**9)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(aims[r.source])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        if r.size:
            least[r.source] = min(least[r.source], r.size)
    largest = max(r.size for r in got)
    for s, aim in aims.items():
        assert aim - largest <= taken[s] <= aim + 1
    assert abs(taken["hot"] - aims["hot"]) <= 120
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.text_hash, r.taken) for r in got) == Counter((r.doc_id, r.text_hash, r.taken) for r in again)
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    per_text = Counter()
    for r in got:
        per_text[r.doc_id, r.size] += r.copies * (r.size > 0)
    assert Counter((r.doc_id, count(r.text)) for r in whole.collect() if count(r.text)) == +per_text
    assert mixing.mix(none).collect() == [] and mixing.mixed_documents(none).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), min_size=1, max_size=12, unique_by=lambda x: x[0]), st.integers(0, 3000))
def test_budget_is_met_where_sums_reach_it(hist, budget):
    lengths, counts = zip(*hist)
    taken = mixing.fit_lengths(list(lengths), list(counts), budget)
    assert all(0 <= k <= n for k, n in zip(taken, counts))
    total = sum(k * x for k, x in zip(taken, lengths))
    assert total <= budget
    base = [n * min(budget, sum(x * n for x, n in hist)) // max(1, sum(x * n for x, n in hist)) if x else 0 for x, n in hist]
    sums = {sum(k * x for k, x in zip(base, lengths))}
    for k, (x, n) in enumerate(hist):
        sums = {s + x * j for s in sums for j in range(n - base[k] + 1)}
    assert total == max(s for s in sums if s <= budget)


def test_language_id(spark, none):
    english = ["the cat and the dog went over the hill", "there was nothing in the house that night", "another thing with the other brother"]
    german = ["der hund und die katze gingen über den hügel", "nichts war in dem haus in jener nacht", "noch ein ding mit dem anderen bruder"]
    table = [(k, t, lang, "x") for k, (t, lang) in enumerate([(t, "en") for t in english * 9] + [(t, "de") for t in german * 9])]
    table += [(100, None, "en", "x"), (101, "", None, "x"), (102, "123 !!", "de", "x"), (103, "the night in the house", None, None), (103, "the night in the house", None, None), (None, "über die nacht", None, "x"), (104, "die katze " * 40_000, None, "x")]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, score string")
    filters = language_id.learn(docs.where(~language_id.held_out()))
    got = language_id.predict(docs, filters).collect()
    assert len(got) == len(table) and got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score"}
    for r in got:
        assert 0 <= r.score <= 1
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.lang:
            assert r.lang_pred == r.lang
    said = {r.doc_id: r.lang_pred for r in got}
    assert (said[103], said[None], said[104]) == ("en", "de", "de")
    assert language_id.predict(none, filters).collect() == []
    unlearned = language_id.predict(docs, language_id.learn(none)).collect()
    assert {(r.lang_pred, r.score) for r in unlearned} == {("und", 0.0)}


def test_many_languages(spark):
    """130 language tags, each with words of its own."""
    word = lambda k, j: "".join(chr(97 + (k * 131 + j * 17 + (k * j) % 23 + i * (k % 19 + 3)) % 26) for i in range(9)) + chr(97 + k % 26) + chr(97 + k // 26)
    text = lambda k: " ".join(word(k, j) for j in range(12))
    table = [(4 * k + c, f"{text(k)} {text(k)}", f"l{k:03d}") for k in range(130) for c in range(2)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(2)
    got = language_id.predict(docs, language_id.learn(docs)).collect()
    assert len(got) == 260 and all(r.lang_pred == r.lang and r.score > 0.5 for r in got)


def test_slots_follow_the_grams(spark):
    """More grams than the smallest table can tell apart: random texts of two languages, and a third that no language holds."""
    draw = np.random.default_rng(2)
    letters = {"aa": "abcdefghijklm", "bb": "nopqrstuvwxyz"}
    text = lambda s, n: " ".join("".join(draw.choice(list(s), 8)) for _ in range(n))
    table = [(k, t, lang) for lang, s in letters.items() for k in range(10) for t in [text(s, 300)] for _ in range(2)]
    foreign = [(1000 + k, text("abcdefghijklmnopqrstuvwxyz", 40), None) for k in range(10)]
    docs = spark.createDataFrame(table + foreign, "doc_id long, text string, lang string")
    learned = language_id.learn(docs, least_bits=12)
    assert learned.bits > 12 and learned.parts == 1
    masks = learned.filters(0).masks[0]
    assert max(((masks >> np.uint64(k)) & np.uint64(1)).mean() for k in range(2)) <= language_id.MOST_FILL + 0.02
    assert language_id.table_size(2, 3_000_000) == (22, 4) and language_id.table_size(65, 100) == (20, 1)
    wide = [x.max() for x in language_id.slots(language_id.mix(np.arange(99, dtype=np.uint64)) >> np.uint64(6), 24)]
    assert 1 << 20 < min(wide) and max(wide) < 1 << 24
    split = language_id.learn(docs, part_words=1 << 13, least_bits=12)
    assert split.parts > 1
    whole, parted = (sorted((r.doc_id, r.text, r.lang, r.lang_pred, r.score) for r in language_id.predict(docs.fillna("", ["lang"]), x).collect()) for x in (learned, split))
    assert len(whole) == len(parted) == 50
    for one, two in zip(whole, parted):
        assert one[:3] == two[:3] and abs(one[4] - two[4]) < 0.1
        if one[2]:
            assert one[3] == two[3] == one[2] and min(one[4], two[4]) > 0.9
        else:
            assert max(one[4], two[4]) < 0.2


def test_filters_find_all_grams_they_hold():
    data = np.frombuffer(b" some words for a filter ", dtype=np.uint8)
    hashes, _ = language_id.gram_hashes(data, np.array([0, len(data)]))
    masks = np.zeros(1 << language_id.SLOT_BITS, dtype=np.uint64)
    for at in language_id.slots(hashes >> np.uint64(6)):
        masks[at] |= np.uint64(2)
    found = masks[language_id.slots(hashes >> np.uint64(6))[0]]
    assert (found == 2).all() and 0 < language_id.Filters(["a", "b"], masks).chance[1] < 1e-9


def test_jaccard_join_hands_small_batches_to_python(spark, monkeypatch):
    size, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, whole = spark.conf.get(size), jaccard_join.verified

    def watched(pairs, sets):
        seen.append(int(spark.conf.get(size)))
        return whole(pairs, sets)

    monkeypatch.setattr(jaccard_join, "verified", watched)
    base = words(400, 31)
    docs = spark.createDataFrame([(1, base), (2, near(base, 90)), (3, words(400, 32))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.join_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and len(seen) == 2 and max(seen) <= 8 << 20
    assert spark.conf.get(size) == before


def test_language_id_pads_a_slice_at_a_time(monkeypatch):
    draw = random.Random(5)
    texts = pa.array(["", None, "ab", "x" * 5000] + [words(draw.randrange(1, 60), k) for k in range(200)])
    whole = language_id._padded(texts)
    data, offsets = next((d, o) for _, _, d, o in language_id.byte_slices(whole, 1 << 40))
    hashes, row = language_id.gram_hashes(data, offsets)
    padded, sizes = language_id._padded, []
    monkeypatch.setattr(language_id, "SLICE", 1000)
    monkeypatch.setattr(language_id, "_padded", lambda some: sizes.append((len(some), some.nbytes)) or padded(some))
    parts = [(first, end, *language_id.gram_hashes(data, offsets)) for first, end, data, offsets in language_id._padded_slices(texts)]
    assert [a for a, _, _, _ in parts] == [0] + [z for _, z, _, _ in parts][:-1] and parts[-1][1] == len(texts)
    assert (np.concatenate([x for _, _, x, _ in parts]) == hashes).all() and (np.concatenate([a + r for a, _, _, r in parts]) == row).all()
    assert all(n == 1 or size < 3000 for n, size in sizes)


def test_packing_hands_small_batches_to_python(spark, monkeypatch):
    size, seen, write = "spark.sql.execution.arrow.maxBytesPerBatch", [], packing.cut
    monkeypatch.setattr(packing, "cut", lambda rows, name: seen.append(int(spark.conf.get(size))) or write(rows, name))
    before = spark.conf.get(size)
    docs = spark.createDataFrame([(k, words(50, k)) for k in range(40)], "doc_id long, text string")
    assert packing.pack(packing.pieces(docs, TOKENIZER, keep_ids=False)).count() == 40
    assert seen and max(seen) <= 8 << 20 and spark.conf.get(size) == before
