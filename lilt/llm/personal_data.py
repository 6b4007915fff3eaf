"""Personal data by weak supervision, in DataFrame operations only.

Candidate spans come from the base patterns (email, ip, card, phone) and from wider ones (spelled-out addresses, local
phone numbers, IPv6, short card numbers). Four labelers vote on each candidate: its form, a gazetteer (top-level
domains, country codes, issuers, address ranges), the words before it, and the characters at its borders. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is for each kind; its posteriors train
a logistic span classifier. Base spans that pass their check are always kept; a further candidate is kept if the
classifier gives it 0.5 or more and it doesn't overlap a base span of its kind.

The driver sees only counts per vote pattern, at most 4 kinds x 3^4 votes x 4 shapes. Texts are read once; only
candidates, with 32 characters of context, are moved.

Patterns are written with possessive groups and with \\G in front, which finds the same leftmost matches as the plain
forms but neither recurses nor rescans on long runs.

Edges: NULL and empty texts have no spans; repeated rows get the same spans; rows without doc_id are treated like others;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lilt.session import cut

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: name -> (kind, quick filter, pattern).
PATTERNS = {
    "email": ("email", "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("card", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "email_words": (
        "email",
        r"[\[(](?:at|AT)[\])]",
        rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++",
    ),
    "phone_local": ("phone", r"[0-9]{3}[-.][0-9]{4}", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])"),
    "ip_six": ("ip", r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
CONTEXT = 32
#: Gazetteers and context words per kind.
KNOWN = {
    "email": r"(?i)[.\]) ](?:com|org|net|edu|gov|int|info|biz|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca|example)$",
    "ip": r"^(?!0+\.)(?!2(?:2[4-9]|[345][0-9])\.)[0-9A-Fa-f]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^(?:\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-8])|[(]?[2-9])",
}
NEAR = {
    "email": r"(?i)(?:e-?mail|contact|write|courriel|correo|mailto|address)",
    "ip": r"(?i)(?:\bip\b|host|server|address|login|client)",
    "card": r"(?i)(?:card|visa|master|credit|carte|karte|tarjeta|payment)",
    "phone": r"(?i)(?:phone|\btel|call|mobile|\bfax|telefon|llam|appel)",
}
AGAINST = r"(?i)(?:version|\bv\.?$|isbn|order|invoice|serial|figure|table|section)"
VOTES = ("form", "listed", "near", "border")
_WEIGHT_DECAY = 1e-2


def luhn(digits: Column) -> Column:
    """Check of a string of digits: every second digit from the right counts double."""
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda x, i: F.when(i % 2 == 0, F.coalesce(x.try_cast("int"), F.lit(0))).otherwise(F.get(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.coalesce(x.try_cast("int"), F.lit(0)))),
    )
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pattern, kind, start, end, match, before, after) of all matches of all patterns."""
    text = F.col("text")
    wanted = F.array_compact(F.array(*[F.when(text.rlike(quick), F.lit(name)) for name, (_, quick, _) in PATTERNS.items()]))
    rows = docs.where(text.rlike(r"[0-9@\[(:]")).select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.explode(wanted).alias("pattern"))

    def by_pattern(of) -> Column:
        return reduce(lambda done, name: done.when(F.col("pattern") == name, of(PATTERNS[name][2])), PATTERNS, F.when(F.lit(False), F.array().cast("array<string>")))

    found = (
        rows.withColumn("matches", by_pattern(lambda p: F.regexp_extract_all(text, F.lit(p), 0)))
        .where(F.size("matches") > 0)
        .withColumn("pieces", by_pattern(lambda p: F.split(text, p, -1)))
        .select(
            "doc_id", "text_hash", "pattern",
            F.posexplode(F.arrays_zip(F.col("matches").alias("m"), F.slice("pieces", 1, F.size("matches")).alias("b"), F.slice("pieces", 2, F.size("matches")).alias("a"))).alias("i", "z"),
        )
        .select(
            "doc_id", "text_hash", "pattern", "i", F.col("z.m").alias("match"), F.char_length("z.b").alias("gap"),
            F.right("z.b", F.lit(CONTEXT)).alias("before"), F.left("z.a", F.lit(4)).alias("after"),
        )
    )
    # Repeated rows give the same matches; one of each stays.
    single = found.groupBy("doc_id", "text_hash", "pattern", "i").agg(*[F.first(c).alias(c) for c in ("match", "gap", "before", "after")])
    upto = Window.partitionBy("doc_id", "text_hash", "pattern").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("match")).over(upto).cast("long")
    kind = F.create_map(*[F.lit(x) for name, (kind, _, _) in PATTERNS.items() for x in (name, kind)])
    placed = single.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("match"))
    return placed.withColumn("kind", kind[F.col("pattern")]).drop("gap", "i")


def votes(spans: DataFrame) -> DataFrame:
    """``spans`` with base (passes its kind's check), the labelers' votes (-1, 0, 1) and shape."""
    match, digits = F.col("match"), F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    base = (
        F.when(F.col("pattern") == "email", True)
        .when(F.col("pattern") == "ip", match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(F.col("pattern") == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False))
        .when(F.col("pattern") == "phone", n.between(8, 15))
        .otherwise(False)
    )
    wide = F.col("pattern").isin("email_words", "phone_local", "ip_six") | ((F.col("pattern") == "card") & F.when(n.between(13, 15), luhn(digits)).otherwise(False))

    def of_kind(patterns: dict[str, str], on: Column) -> Column:
        return reduce(lambda done, kind: done.when(F.col("kind") == kind, on.rlike(patterns[kind])), KINDS, F.when(F.lit(False), F.lit(False)))

    against = F.col("before").rlike(AGAINST)
    touching = F.col("before").rlike(r"[\p{L}\p{N}_/=&-]$") | F.col("after").rlike(r"^[\p{L}\p{N}_/=&]")
    return spans.withColumns(
        {
            "base": base,
            "wide": wide,
            "form": F.when(base | wide, 1).otherwise(-1),
            "listed": F.when(of_kind(KNOWN, match), 1).otherwise(-1),
            "near": F.when(of_kind(NEAR, F.col("before")), 1).when(against, -1).otherwise(0),
            "border": F.when(touching, -1).otherwise(1),
            "shape": (F.char_length("match") >= 16).cast("int") + 2 * match.rlike("[ ()-]").cast("int"),
        }
    )


def reliabilities(patterns: list[tuple[str, tuple[int, ...], float]], rounds: int = 40) -> tuple[dict[str, float], dict[tuple, float], list[float]]:
    """Expectation maximisation over (kind, votes, count): prior per kind, chance of each vote per kind, labeler and class,
    posterior per row. Pseudo-counts say that labelers are better than chance."""
    prior = {kind: 0.5 for kind in KINDS}
    chance: dict[tuple, float] = {}
    for kind in KINDS:
        for k in range(len(VOTES)):
            for truth in (0, 1):
                for vote in (-1, 0, 1):
                    chance[kind, k, truth, vote] = 0.2 if vote == 0 else 0.55 if (vote == 1) == bool(truth) else 0.25
    start = dict(chance)
    posterior = [0.5] * len(patterns)
    for _ in range(rounds):
        for j, (kind, votes_cast, _) in enumerate(patterns):
            logs = [math.log(max(1e-9, prior[kind] if truth else 1 - prior[kind])) + sum(math.log(chance[kind, k, truth, v]) for k, v in enumerate(votes_cast)) for truth in (0, 1)]
            posterior[j] = 1 / (1 + math.exp(min(50.0, logs[0] - logs[1])))
        for kind in KINDS:
            mine = [(v, n, posterior[j]) for j, (which, v, n) in enumerate(patterns) if which == kind]
            total = sum(n for _, n, _ in mine)
            prior[kind] = (sum(n * p for _, n, p in mine) + 5) / (total + 10)
            for truth in (0, 1):
                mass = sum(n * (p if truth else 1 - p) for _, n, p in mine)
                for k in range(len(VOTES)):
                    for vote in (-1, 0, 1):
                        hit = sum(n * (p if truth else 1 - p) for v, n, p in mine if v[k] == vote)
                        chance[kind, k, truth, vote] = (hit + 20 * start[kind, k, truth, vote]) / (mass + 20)
    return prior, chance, posterior


def _features(kind: str, votes_cast: tuple[int, ...], shape: int) -> list[float]:
    return [1.0, *[float(v) for v in votes_cast], float(shape & 1), float(shape >> 1), *[float(kind == k) for k in KINDS]]


def classifier(rows: list[tuple[str, tuple[int, ...], int, float]], posterior: list[float]) -> np.ndarray:
    """Weights of a logistic classifier fitted to the posteriors by Newton steps; rows are counted patterns."""
    if not rows:
        return np.zeros(len(_features(KINDS[0], (0,) * len(VOTES), 0)))
    x = np.array([_features(kind, v, shape) for kind, v, shape, _ in rows])
    n, y = np.array([r[3] for r in rows], dtype=float), np.array(posterior)
    n = n / n.sum() * len(rows)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - _WEIGHT_DECAY * w
        bend = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + _WEIGHT_DECAY * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return w


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_hash, kind, start, end, match, base, probability) of the spans that are kept."""
    voted = cut(votes(candidates(docs.select("doc_id", "text"))), "pii-votes")
    counted = voted.groupBy("kind", *VOTES, "shape").agg(F.count("*").alias("n")).orderBy("kind", *VOTES, "shape").collect()
    rows = [(r.kind, tuple(r[v] for v in VOTES), r["shape"], float(r.n)) for r in counted]
    _, _, posterior = reliabilities([(kind, v, n) for kind, v, _, n in rows])
    weights = [float(w) for w in classifier(rows, posterior)]
    values = [F.lit(1.0), *[F.col(v) for v in VOTES], F.col("shape").bitwiseAND(1), F.shiftright("shape", 1), *[(F.col("kind") == k).cast("int") for k in KINDS]]
    logit = sum((F.lit(w) * v for w, v in zip(weights, values)), F.lit(0.0))
    scored = voted.withColumn("probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
    kept = scored.where(F.col("base") | (F.col("wide") & (F.col("probability") >= threshold)))
    ordered = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("start", "end")
    earlier = F.max(F.when(F.col("base"), F.col("end"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(F.col("base"), F.col("start"))).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(F.col("earlier"), F.col("start")) <= F.col("start")) & (F.coalesce(F.col("later"), F.col("end")) >= F.col("end"))
    return (
        kept.withColumns({"earlier": earlier, "later": later})
        .where(F.col("base") | free)
        .select("doc_id", "text_hash", "kind", "start", "end", "match", "base", "probability")
    )


def summary(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts per kind and the spans as text, base ones hashed."""
    order = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    said = F.concat_ws(":", "kind", "start", "end")
    one = F.struct(order[F.col("kind")].alias("k"), "start", "end", said.alias("said"))
    joined = lambda column: F.array_join(F.transform(F.array_sort(column), lambda s: s["said"]), ",")
    grouped = (
        spans.groupBy("doc_id", "text_hash")
        .agg(
            *[F.sum(((F.col("kind") == kind) & F.col("base")).cast("long")).alias(f"n_{kind}") for kind in KINDS],
            F.collect_list(F.when(F.col("base"), one)).alias("base_spans"),
            F.collect_list(one).alias("all_spans"),
        )
        .withColumns({"base_spans": joined(F.col("base_spans")), "all_spans": joined(F.col("all_spans"))})
    )
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    return (
        keyed.alias("d")
        .join(grouped.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_hash") == F.col("g.text_hash")), "left")
        .select(
            "d.doc_id",
            *[F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS],
            F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
            F.coalesce("all_spans", F.lit("")).alias("spans"),
        )
    )
