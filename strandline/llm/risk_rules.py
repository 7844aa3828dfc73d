"""Quality rules whose cutoffs are chosen under a risk bound.

Each rule compares one ratio of a document with a cutoff of its stratum (the language); a document goes if any
rule says so.  Labelled documents are dealt in two by a hash of their id.  The first part proposes for each
stratum a path of joint settings, each stricter than the one before: the cutoffs of a fixed grid, in
the order of the bad documents that they reject for each good one.  The second part, which the path knows
nothing of, certifies it: settings are tested from the loosest on, and one is certified if the exact binomial
(Clopper-Pearson) upper bound of what all rules together reject of its good documents is at most ``RISK``;
testing stops at the first that isn't (a fixed sequence needs no correction within itself).  Over the strata that
are tested the error ``ERROR`` is divided (Bonferroni).  So with probability 1 - ERROR the rules reject at
most a share RISK of the good documents in every stratum.  The strictest certified setting is used, or none.

A stratum with too few labelled good documents for any certificate (``fewest_good``) isn't tested, gets no
cutoffs, and keeps whatever the base limits keep.

Rows: a null or empty text has no words and fails the base.  A null language is a stratum of its own.
A null doc_id has no label.  Of several labels of a document the smallest counts.  Repeated rows are
repeated.  All of it is DataFrame operations; the driver gets counts per stratum, rule
and grid cell, and per stratum and setting.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import SPACES, Stored, fold_of, settled, table

RISK, ERROR = 0.03, 0.05
WINDOW = 8
#: One document of so many labelled ones proposes settings, the others certify them.
PROPOSING = 3
#: Rejected good documents weigh so much more than bad ones when settings are proposed.
WEIGHT = 20.0
#: Cutoffs: GRID_TOP * 2 ** (-k / 4), from k = 0 on.
GRID_TOP, GRID_STEPS = 16.0, 48
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

RULES: dict[str, str] = {
    "symbols": "n_symbols / n_words",
    "shouting": "n_capitals / word_chars",
    "exclaiming": "n_exclaimed / n_words",
    "repeats": "n_repeat_words / n_words",
    "double_lines": "n_dup_lines / n_lines",
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def _pairs(values: str, gap: int, combine) -> Column:
    """combine(x[i], x[i + gap]) for every i."""
    n = F.greatest(F.size(values) - gap, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, 1 + gap, n), combine)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with COUNTS, n_lines, n_capitals and n_exclaimed (columns of such names are replaced).

    Windows of 8 words are hashed by doubling (1, 2, 4, 8 words); only texts with two equal hashes
    are looked at by position.
    """
    made = [*COUNTS, "n_lines", "n_capitals", "n_exclaimed"]
    keep = [c for c in docs.columns if c not in (text, *made)]
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, whole.alias("__t"), F.btrim(whole, F.lit(_BLANKS)).alias("__b"))
    words = F.when(F.col("__b") == "", F.array().cast("array<string>")).otherwise(F.split("__b", SPACES))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    t = F.col("__t")
    df = df.select(
        *keep,
        F.length(F.regexp_replace(t, SPACES, "")).cast("long").alias("word_chars"),
        _without(t, _SYMBOLS).cast("long").alias("n_symbols"),
        _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        _without(t, "!").cast("long").alias("n_exclaimed"),
        lines.alias("__l"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("__1"),
    )
    rest = ["word_chars", "n_symbols", "n_capitals", "n_exclaimed"]
    df = df.select(*keep, *rest, F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), F.size("__1").cast("long").alias("n_words"), _pairs("__1", 1, lambda a, b: F.xxhash64(a, b)).alias("__2"))
    rest += ["n_lines", "n_dup_lines", "n_words"]
    df = df.select(*keep, *rest, _pairs("__2", 2, lambda a, b: F.xxhash64(a, b)).alias("__4"))
    df = df.select(*keep, *rest, _pairs("__4", 4, lambda a, b: F.xxhash64(a, b)).alias("__8"))
    numbered = F.array_sort(F.transform("__8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(*keep, *rest, F.when(F.size(F.array_distinct("__8")) < F.size("__8"), numbered).alias("__s"))
    equal = F.filter(_pairs("__s", 1, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
    df = df.select(*keep, *rest, F.array_sort(F.array_distinct(F.flatten(equal))).alias("__p"))
    steps = F.aggregate(_pairs("__p", 1, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda x, y: x + y)
    return df.select(*keep, *rest, F.coalesce(steps + F.when(F.size("__p") > 0, WINDOW).otherwise(0), F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ratios() -> list[Column]:
    """Each rule's ratio; zero where its divisor is."""
    out = []
    for name, ratio in RULES.items():
        above, below = ratio.split(" / ")
        out.append(F.coalesce(F.try_divide(F.col(above).cast("double"), F.col(below).cast("double")), F.lit(0.0)).alias(name))
    return out


def _tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    one = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    return min(1.0, math.fsum(map(one, range(k + 1))))


def fewest_good(strata: int = 1, risk: float = RISK, error: float = ERROR) -> int:
    """Good documents that a stratum needs, of ``strata`` that are tested, before anything can be certified."""
    return math.ceil(math.log(error / strata) / math.log1p(-risk))


def tested(good: dict[str, int], risk: float = RISK, error: float = ERROR) -> list[str]:
    """The strata with enough good documents for as many as are tested; their outcomes play no part."""
    order = sorted(good, key=lambda s: (-good[s], s))
    return max((order[:k] for k in range(len(order) + 1) if all(good[s] >= fewest_good(k, risk, error) for s in order[:k])), key=len)


def path(cells: dict[str, dict[int, tuple[int, int]]], good: int, bad: int, weight: float = WEIGHT) -> list[tuple[str, int]]:
    """Steps (rule, k) from the loosest setting on: each moves one rule's cutoff to cell k of the grid.

    cells: rule -> cell -> (good, bad) documents that cutoff k rejects and k - 1 doesn't.  Of each rule the steps on the
    concave hull of (good, bad) rejected are taken, merged by slope, down to where a bad document isn't worth its price.
    """
    steps = []
    for rule in RULES:
        points = [(0.0, 0.0, -1)]
        g = b = 0
        for k in range(GRID_STEPS):
            more = cells.get(rule, {}).get(k, (0, 0))
            if more == (0, 0):
                continue
            g, b = g + more[0], b + more[1]
            now = (g / max(1, good), b / max(1, bad), k)
            slope = lambda x, y: (y[1] - x[1]) / max(y[0] - x[0], 1e-12)
            while len(points) > 1 and slope(points[-2], points[-1]) <= slope(points[-1], now):
                points.pop()
            points.append(now)
        steps += [(slope(x, y), rule, y[2]) for x, y in zip(points, points[1:]) if slope(x, y) > weight]
    return [(rule, k) for _, rule, k in sorted(steps, key=lambda s: (-s[0], s[1], s[2]))]


def certified(rejected: dict[int, int], good: int, steps: int, strata: int, risk: float = RISK, error: float = ERROR) -> int:
    """How many steps of a path are certified; rejected: step -> good documents that it rejects and those before don't."""
    g = 0
    for k in range(steps):
        g += rejected.get(k, 0)
        if _tail(g, good, risk) > error / strata:
            return k
    return steps


def _local(spark: SparkSession, columns: dict[str, list], values: pa.DataType) -> DataFrame:
    """A small table of a first column of strings and others of ``values``; it travels in the plan, so no executor starts Python for it."""
    names = list(columns)
    return spark.createDataFrame(pa.table([pa.array(columns[n], values if k else pa.string()) for k, n in enumerate(names)], names=names))


def calibrate(found: DataFrame, labels: DataFrame, stratum: str = "lang") -> dict[tuple[str | None, str], float]:
    """Cutoff of each (stratum, rule) that gets one, from labelled documents; ``found``: doc_id, stratum and what ``features`` gives."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__q"))
    # the first cutoff of the grid that a ratio exceeds: ratio > TOP * 2 ** (-k / 4)
    cells = [F.when(r > 0, F.greatest(F.lit(0), (F.floor(4 * F.log2(F.lit(GRID_TOP) / r)) + 1).cast("int"))).alias(name) for name, r in zip(RULES, ratios())]
    own = found.where(~base_failed()).join(marks, F.col("doc_id") == F.col("__id"))
    own = own.select(F.coalesce(F.concat(F.lit("="), stratum), F.lit("")).alias("s"), (F.col("__q") == 1).alias("q"), (fold_of("doc_id", PROPOSING) == 0).alias("proposes"), *cells)
    stored = Stored(own, "holdout")
    totals: dict[tuple[str, bool, bool], int] = {(r["s"], r["proposes"], r["q"]): r["count"] for r in stored.df.groupBy("s", "proposes", "q").count().collect()}
    strata = tested({s: n for (s, proposes, q), n in totals.items() if q and not proposes})
    if not strata:
        return {}
    long = stored.df.where(F.col("proposes") & F.col("s").isin(strata)).select("s", "q", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("k")) for r in RULES])).alias("x"))
    proposed: dict[str, dict[str, dict[int, tuple[int, int]]]] = {s: {r: {} for r in RULES} for s in strata}
    for row in long.where(f"x.k < {GRID_STEPS}").groupBy("s", "x.rule", "x.k").agg(F.count_if("q").alias("good"), F.count_if(~F.col("q")).alias("bad")).collect():
        proposed[row["s"]][row["rule"]][row["k"]] = row["good"], row["bad"]
    paths = {s: path(proposed[s], totals.get((s, True, True), 0), totals.get((s, True, False), 0)) for s in strata}
    # the first step that rejects a document: for each rule the first whose cutoff reaches the document's cell
    firsts = {"s": [], **{f"__{r}": [] for r in RULES}}
    for s, steps in paths.items():
        firsts["s"].append(s)
        for r in RULES:
            firsts[f"__{r}"].append([next((n for n, (rule, k) in enumerate(steps) if rule == r and k >= cell), None) for cell in range(GRID_STEPS)])
    steps_of = _local(found.sparkSession, firsts, pa.list_(pa.int32()))
    step = F.least(*[F.get(F.col(f"__{r}"), F.col(r)) for r in RULES])
    rejected: dict[str, dict[int, int]] = {s: {} for s in strata}
    for row in stored.df.where(F.col("q") & ~F.col("proposes")).join(steps_of, "s").select("s", step.alias("step")).where("step IS NOT NULL").groupBy("s", "step").count().collect():
        rejected[row["s"]][row["step"]] = row["count"]
    stored.drop()
    out = {}
    for s, steps in paths.items():
        for rule, k in steps[: certified(rejected[s], totals[s, False, True], len(steps), len(strata))]:
            out[s[1:] if s else None, rule] = GRID_TOP * 2 ** (-k / 4)
    return out


def verdicts(found: DataFrame, cutoffs: dict[tuple[str | None, str], float], stratum: str = "lang") -> DataFrame:
    """``found`` with base_failed and kept."""
    rows = {}
    for (s, r), c in cutoffs.items():
        rows.setdefault(s, dict.fromkeys(RULES))[r] = c
    spark = found.sparkSession
    limits = {"__s": ["" if s is None else f"={s}" for s in rows], **{f"__{r}": [v[r] for v in rows.values()] for r in RULES}}
    limits = _local(spark, limits, pa.float64())
    columns = [c for c in found.columns if c not in ("base_failed", "kept")]
    beyond = [F.coalesce(ratio > F.col(f"__{name}"), F.lit(False)) for name, ratio in zip(RULES, ratios())]
    hit = beyond[0]
    for x in beyond[1:]:
        hit = hit | x
    joined = found.join(limits, F.coalesce(F.concat(F.lit("="), stratum), F.lit("")) == F.col("__s"), "left")
    return joined.select(*columns, base_failed().alias("base_failed"), (~base_failed() & ~hit).alias("kept"))


def op10_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Stored(features(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), "features")
    cutoffs = calibrate(stored.df, table(spark, sf_dir, "labels"))
    return settled(verdicts(stored.df, cutoffs).select("doc_id", *COUNTS, "base_failed", "kept"), "verdicts", stored)


QUERIES = {"op10_risk_rules": op10_risk_rules}
ORACLES: dict[str, str] = {}
