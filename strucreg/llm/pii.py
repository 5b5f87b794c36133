"""Personal data by weak supervision.

Candidates are found by patterns, one per kind. Labelers vote on each candidate, for, against or not at all: the pattern's own check, a
gazetteer, the words before it, the characters around it, the spread of its characters. Expectation-maximisation estimates per kind how reliable each labeler is, from
the counts of the vote patterns alone (at most 3^5 per kind). A logistic span classifier is then trained on the spans' features with the
estimated probabilities as targets, from counts of feature patterns (at most 2^9 per kind), and decides on candidates that do not pass the base check. Base
spans always stay; an added span that overlaps a base span is dropped.

Only built-in functions; the two bounded tables of counts reach the driver, where the few parameters are fitted.
Places are code points, end exclusive: a match's start is the length of all gaps and matches before it.

Defined cases: null text is empty; a null id, ties and repeated rows are documents like others; without candidates
the result has counts of 0 and empty lists; texts are read whole; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strucreg.llm.common import Tables, text_or_empty

# Kinds in order. What stands before a match that starts within a run of its characters was a match itself (\G); a run is
# scanned from its start only, so that long runs take linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[0-9A-Za-z]{12,}+",
}
BASE = ("email", "ip", "card", "phone")
BEFORE, AFTER = 40, 8

# Words that announce a kind, and words that speak against it.
ANNOUNCE = {
    "email": "mail|e-mail|email|contact|write to|correo|kontakt|courriel",
    "ip": "ip|host|server|address|login from|client",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta|account|iban",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono|whatsapp",
    "secret": "token|password|passwd|secret|api[_ -]?key|key|pwd|auth|bearer",
}
AGAINST = "version|section|chapter|page|isbn|issn|doi|order|invoice|sha1|sha256|md5|commit|http|www"
# Issuer beginnings of payment cards, country codes of telephone numbers, reserved address beginnings, top-level domains.
CARD_STARTS = "^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
PHONE_STARTS = r"^\+(1|7|2[07]|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED_IP = r"^(0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-4])\."
DOMAINS = r"\.(com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl)$"


def _matches(kind: str) -> Column:
    """An array of (kind, nth, match, skipped, before, after) for one kind."""
    found = F.regexp_extract_all("_text", F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split("_text", PATTERNS[kind], -1)
    zipped = F.arrays_zip(found.alias("m"), gaps.alias("g"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("h"))
    each = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("nth"),
            x["m"].alias("match"),
            F.length(x["g"]).alias("skipped"),
            F.right(x["g"], F.lit(BEFORE)).alias("before"),
            F.left(x["h"], F.lit(AFTER)).alias("after"),
        ),
    )
    return F.filter(each, lambda x: x["match"].isNotNull())


def candidates(tables: Tables, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate (at least one per row of ``docs``, with a null kind if it has none): _row, _id, kind, match, start, end, before, after."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    # written once, as numbering and the rows without candidates both read it
    found = rows.select("_row", "_id", F.explode_outer(F.flatten(F.array(*[_matches(k) for k in PATTERNS]))).alias("c")).select("_row", "_id", "c.*")
    found = tables.keep(found)
    none = found.filter("kind is null").select("_row", "_id", "kind", "match", F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"), "before", "after")
    some = found.filter("kind is not null")
    until = F.sum(F.col("skipped") + F.length("match")).over(W.partitionBy("_row", "kind").orderBy("nth"))
    some = some.withColumn("end", until.cast("bigint")).withColumn("start", F.col("end") - F.length("match"))
    return some.select("_row", "_id", "kind", "match", "start", "end", "before", "after").unionByName(none)


def _digits() -> Column:
    return F.regexp_replace("match", "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    size = F.length(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.when((size - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(d) for d in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substr(digits, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes() -> Column:
    """The base check of a candidate of a base kind."""
    digits = _digits()
    parts = F.forall(F.split("match", r"\."), lambda p: p.cast("double") <= 255)
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", parts)
        .when((F.col("kind") == "card") & F.length(digits).between(12, 19), _luhn(digits))
        .when(F.col("kind") == "phone", F.length(digits).between(9, 15))
        .otherwise(False)
    )


def _vote(for_: Column, against: Column) -> Column:
    return F.when(for_, 1).when(against, -1).otherwise(0)


def _by_kind(choices: dict[str, Column], other: Column) -> Column:
    made = None
    for kind, column in choices.items():
        made = F.when(F.col("kind") == kind, column) if made is None else made.when(F.col("kind") == kind, column)
    return made.otherwise(other)


def _distinct_characters() -> Column:
    return F.size(F.array_distinct(F.split(F.lower("match"), "")))


VOTES = ("by_check", "by_gazetteer", "by_context", "by_edges", "by_spread")


def votes(rows: DataFrame) -> DataFrame:
    """Adds ``base`` and the labelers' votes."""
    low = F.lower("before")
    announced = _by_kind({k: low.rlike(f"(^|[^a-z])({w})[^a-z0-9]*$|(^|[^a-z])({w})[^a-z].{{0,15}}$") for k, w in ANNOUNCE.items()}, F.lit(False))
    listed = _by_kind(
        {"email": F.lower("match").rlike(DOMAINS), "card": _digits().rlike(CARD_STARTS), "phone": F.col("match").rlike(PHONE_STARTS), "ip": ~F.col("match").rlike(RESERVED_IP)},
        F.lit(False),
    )
    unlisted = _by_kind({"card": ~_digits().rlike(CARD_STARTS), "phone": ~F.col("match").rlike(PHONE_STARTS), "ip": F.col("match").rlike(RESERVED_IP)}, F.lit(False))
    clean = F.col("before").rlike(r"(^|[\s\"'(<=:;,])$") & F.col("after").rlike(r"^([\s\"')>;,.!?]|$)")
    spread = _distinct_characters()
    few = _by_kind({"ip": spread < 3, "phone": spread < 5, "card": spread < 5, "email": spread < 4}, spread < 8)
    return rows.withColumns(
        {
            "base": passes(),
            "by_check": F.when(F.col("kind") == "secret", 0).otherwise(_vote(passes(), ~passes())),
            "by_gazetteer": _vote(listed, unlisted),
            "by_context": _vote(announced, low.rlike(f"(^|[^a-z])({AGAINST})[^a-z]*$")),
            "by_edges": _vote(clean, ~clean),
            "by_spread": _vote(~few, few),
        }
    )


FEATURES = ("f_check", "f_listed", "f_announced", "f_against", "f_clean", "f_spread", "f_assigned", "f_long", "f_separated")


def _features() -> dict[str, Column]:
    flag = lambda c: c.cast("int")
    return {
        "f_check": flag(F.col("by_check") == 1),
        "f_listed": flag(F.col("by_gazetteer") == 1),
        "f_announced": flag(F.col("by_context") == 1),
        "f_against": flag(F.col("by_context") == -1),
        "f_clean": flag(F.col("by_edges") == 1),
        "f_spread": flag(F.col("by_spread") == 1),
        "f_assigned": flag(F.col("before").rlike("[=:]\\s*[\"']?$")),
        "f_long": flag(F.length("match") >= 16),
        "f_separated": flag(F.col("match").rlike(r"[ ().@-]")),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[list[dict[int, tuple[float, float]]], float]:
    """Expectation-maximisation over vote patterns with counts: for each labeler the chance of each vote given a true and a false
    span, and the share of true spans. Labelers start out better than chance, the check most of all; one pseudo-count for each vote."""
    width = len(patterns[0][0]) if patterns else 0
    trust = [0.95 if j == 0 else 0.75 for j in range(width)]
    tables = [{1: (t, 1 - t), -1: (1 - t, t), 0: (0.5, 0.5)} for t in trust]
    share = 0.5
    for _ in range(rounds):
        true = [[2.0 * t, 0.5, 2.0 * (1 - t)] for t in trust]
        false = [[2.0 * (1 - t), 0.5, 2.0 * t] for t in trust]
        all_true = all_ = 1e-9
        for pattern, n in patterns:
            p = posterior(pattern, tables, share)
            all_true, all_ = all_true + n * p, all_ + n
            for j, v in enumerate(pattern):
                true[j][1 - v] += n * p
                false[j][1 - v] += n * (1 - p)
        share = min(0.999, max(0.001, all_true / all_))
        after = [{v: (a[1 - v] / sum(a), b[1 - v] / sum(b)) for v in (1, 0, -1)} for a, b in zip(true, false)]
        moved = max((abs(x - y) for old, new in zip(tables, after) for v in old for x, y in zip(old[v], new[v])), default=0)
        tables = after
        if moved < 1e-9:
            break
    return tables, share


def posterior(pattern: tuple[int, ...], tables: list[dict[int, tuple[float, float]]], share: float) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(t[v][0] / t[v][1]) for v, t in zip(pattern, tables))
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, odds))))


def classifier(patterns: list[tuple[tuple[int, ...], float, float]], rounds: int = 400) -> list[float]:
    """Logistic regression, bias last, by accelerated gradient steps on (features, spans, expected true spans); ridge of one span."""
    width = len(patterns[0][0]) + 1 if patterns else 1
    total = sum(n for _, n, _ in patterns) or 1.0
    weights, ahead = [0.0] * width, [0.0] * width
    for turn in range(rounds):
        slope = [w / total for w in ahead]
        for features, n, true in patterns:
            z = ahead[-1] + sum(w for w, f in zip(ahead, features) if f)
            miss = (n / (1 + math.exp(-max(-35.0, min(35.0, z)))) - true) / total
            for j, f in enumerate(features):
                if f:
                    slope[j] += miss
            slope[-1] += miss
        step = 4.0 / width
        after = [a - step * s for a, s in zip(ahead, slope)]
        pace = turn / (turn + 3.0)
        ahead = [a + pace * (a - w) for a, w in zip(after, weights)]
        weights = after
    return [round(w, 6) for w in weights]


def judged(tables: Tables, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The candidates with votes, features, base and probability."""
    rows = tables.keep(votes(candidates(tables, docs, id_col, text_col)).withColumns(_features()))
    real = rows.filter("kind is not null")
    counted = real.groupBy("kind", *VOTES).count().collect()  # at most 5 * 3^5 rows
    by_kind: dict[str, list] = {k: [] for k in PATTERNS}
    for r in sorted(counted, key=str):
        by_kind[r["kind"]].append((tuple(r[v] for v in VOTES), r["count"]))
    learnt = {k: estimate(p) for k, p in by_kind.items() if p}
    chance = F.lit(0.0)
    for kind in by_kind:
        if kind in learnt:
            tables_, share = learnt[kind]
            odds = F.lit(math.log(share / (1 - share)))
            for name, t in zip(VOTES, tables_):
                odds = odds + F.when(F.col(name) == 1, math.log(t[1][0] / t[1][1])).when(F.col(name) == -1, math.log(t[-1][0] / t[-1][1])).otherwise(math.log(t[0][0] / t[0][1]))
            chance = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-odds))).otherwise(chance)
    shapes = real.groupBy("kind", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum(chance).alias("true")).collect()  # at most 5 * 2^9 rows
    score = F.lit(0.0)
    for kind in PATTERNS:
        own = sorted((tuple(r[f] for f in FEATURES), float(r["n"]), round(r["true"], 6)) for r in shapes if r["kind"] == kind)
        if own:
            *weights, bias = classifier(own)
            z = F.lit(bias)
            for name, w in zip(FEATURES, weights):
                z = z + F.col(name) * w
            score = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-z))).otherwise(score)
    return rows.withColumns({"labelled": chance, "probability": score})


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: the id, base (array of start, rank, end, kind) and all (the same with added spans), each in order."""
    tables = Tables(docs.sparkSession, "pii")
    rows = judged(tables, docs, id_col, text_col)
    order = W.partitionBy("_row").orderBy("start", "end")
    rows = rows.withColumns(
        {
            "_until": F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1)),
            "_next": F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing)),
        }
    )
    apart = (F.coalesce("_until", F.lit(0)) <= F.col("start")) & (F.col("_next").isNull() | (F.col("_next") >= F.col("end")))
    added = ~F.col("base") & (F.col("probability") >= threshold) & apart
    rank = F.array_position(F.array(*[F.lit(k) for k in PATTERNS]), F.col("kind")).cast("int")
    span = F.struct("start", rank.alias("rank"), "end", "kind")
    listed = rows.groupBy("_row", "_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(F.when(F.col("base") | added, span))).alias("all")
    )
    return listed.select(F.col("_id").alias(id_col), "base", "all")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets. Ids must be unique here."""
    found = spans(docs, id_col, text_col, threshold).select(F.col(id_col).alias("of"), F.col("all").alias("spans"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("of")), "left")
    # overlapping spans of different kinds: what was taken before is not taken again
    piece = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct(
                F.concat(a["done"], F.substr("text", (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")).alias("done"), s["end"].alias("at")
            )
        ),
        lambda a: F.concat(a["done"], F.substr("text", (a["at"] + 1).cast("int"))),
    )
    changed = F.when(F.size("spans") > 0, piece).otherwise(F.col("row").getField(text_col))
    return rows.select(F.col("row").withField(text_col, changed).alias("row")).select("row.*")


def span_text(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
