"""Line dedup: winnowing over line hashes, and removal of later copies of repeated runs of lines.

A run is a stretch of consecutive lines of one document with at least ``RUN_WORDS`` words.  Each line
that has words starts a forward window, the fewest lines from it on that hold RUN_WORDS words, and
ends a backward one.  Each window selects its least line hash (of equal ones the first) with its position: a fingerprint.
Windows depend on nothing but their own lines, so two copies of a run select equal fingerprints at different
positions; that is what winnowing guarantees for every shared run.  Fingerprints are joined by hash,
and those that were selected at one position only are dropped, with all windows that rest on them: their lines are compared
with nothing.  From the others a match is extended over whole windows, by the forward ones to the right
and by the backward ones to the left, for as long as these occur earlier.  Every line of such a match
is deleted, except at the first occurrence.

So a line goes if and only if it lies in a run of RUN_WORDS words or more that also begins earlier, in a
document with a smaller id or further up in its own (copies may overlap).  Lines are compared
without white space at their ends.  Hashes are 128 bits for a line.

Rows: a null text stays null, an empty text and one without repeats stay as they are.  A null
doc_id comes before all others.  Repeated rows (same id and text) are one document, and each gets its
result.  Other columns pass through.  All of it is DataFrame operations; the largest thing that one
task must hold is the lines of one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import SPACES, Stored, settled, table

RUN_WORDS = 50
_TRIM = " \t\r\x0b\x0c"


def windows(docs: DataFrame, run_words: int = RUN_WORDS, text: str = "text") -> DataFrame:
    """Forward and backward windows: doc_id, th, i, j (lines), anchor and at (least line hash and its line), k1, k2 (content)."""
    lines = docs.select("doc_id", F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(_TRIM))).where("line != ''")
    lines = lines.select("doc_id", "th", "pos", F.size(F.split("line", SPACES)).cast("long").alias("w"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))
    lines = lines.repartition("doc_id", "th").dropDuplicates(["doc_id", "th", "pos"])
    own = Window.partitionBy("doc_id", "th")
    lines = lines.withColumn("end", F.sum("w").over(own.orderBy("pos"))).withColumn("start", F.col("end") - F.col("w"))
    sides = []
    for name, order, by in (("f", F.col("start"), "start"), ("b", F.col("end").desc(), "end")):
        w = own.orderBy(order).rangeBetween(0, run_words - 1)
        lines = lines.withColumn(name, F.collect_list(F.struct("pos", "h1", "h2")).over(w)).withColumn(f"{name}w", F.sum("w").over(w))
        at = F.col(name)
        first, last = at[0]["pos"], F.element_at(at, -1)["pos"]
        hashes = at if name == "f" else F.reverse(at)
        sides.append(
            F.when(
                (F.col(f"{name}w") >= run_words) & ((first != last) if name == "b" else F.lit(True)),
                F.struct(F.least(first, last).alias("i"), F.greatest(first, last).alias("j"), F.array_min(F.transform(at, lambda x: F.struct(x["h1"].alias("h"), x["pos"].alias("at")))).alias("least"), F.xxhash64(hashes["h1"]).alias("k1"), F.xxhash64(F.lit(1), hashes["h2"]).alias("k2")),
            )
        )
    return lines.select("doc_id", "th", F.explode(F.array_compact(F.array(*sides))).alias("x")).select("doc_id", "th", "x.i", "x.j", F.col("x.least.h").alias("anchor"), F.col("x.least.at").alias("at"), "x.k1", "x.k2")


def anchored(found: DataFrame) -> DataFrame:
    """The windows whose fingerprint was selected at two positions or more; no others can hold a copy."""
    place = F.struct("doc_id", "th", "at")
    shared = found.groupBy("anchor").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi").select("anchor")
    return found.join(shared, "anchor").select("doc_id", "th", "i", "j", "k1", "k2")


def repeated(docs: DataFrame, run_words: int = RUN_WORDS, text: str = "text") -> DataFrame:
    """doc_id, th and cuts: the disjoint ranges of lines (i, j) that lie in later copies, in order."""
    stored = Stored(windows(docs, run_words, text), "windows")
    matches = Stored(anchored(stored.df), "matches")
    stored.drop()
    near, place = matches.df, F.struct("doc_id", "th", "i")
    first = near.groupBy("k1", "k2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi").select("k1", "k2", "lo")
    later = near.join(first, ["k1", "k2"]).where(place != F.col("lo")).select("doc_id", "th", "i", "j").distinct()
    own = Window.partitionBy("doc_id", "th").orderBy("i", "j")
    before = F.max("j").over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("i")).cast("int")).withColumn("island", F.sum("new").over(own))
    cuts = islands.groupBy("doc_id", "th", "island").agg(F.min("i").alias("i"), F.max("j").alias("j"))
    return settled(cuts.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("cuts")), "cuts", matches)


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS, text: str = "text", lines: str = "n_lines", removed: str = "n_removed") -> DataFrame:
    """``docs`` with the text that remains, and the counts of its lines before and of those removed."""
    columns = [c for c in docs.columns if c not in (text, lines, removed)]
    cuts = repeated(docs, run_words, text).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("cuts").alias("__cuts"))
    # cuts grow with the documents, so texts meet them by the same shuffle at every size
    both = docs.join(cuts.hint("merge"), docs["doc_id"].eqNullSafe(cuts["__id"]) & (F.xxhash64(docs[text]) == cuts["__th"]), "left")
    both = both.select(*columns, F.col(text).alias("__text"), "__cuts", F.split(text, "\n").alias("__lines"))
    # what is kept lies between the end of a cut and the start of the next
    ends = F.concat(F.array(F.lit(-1)), F.col("__cuts")["j"])
    starts = F.concat(F.col("__cuts")["i"], F.array(F.size("__lines")))
    kept = F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice("__lines", a + 2, b - a - 1)))
    gone = F.aggregate("__cuts", F.lit(0), lambda n, c: n + c["j"] - c["i"] + 1)
    out = both.select(
        *columns,
        F.when(F.col("__cuts").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n")).alias(text),
        F.coalesce(F.greatest(F.size("__lines"), F.lit(0)), F.lit(0)).cast("long").alias(lines),
        F.coalesce(gone, F.lit(0)).cast("long").alias(removed),
    )
    order = [c for c in docs.columns if c not in (lines, removed)]
    return out.select(*order, lines, removed)


def op2_line_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs; those that were nothing else go."""
    left = dedup_lines(docs, lines="__n", removed="__gone")
    return left.where("__gone = 0 OR length(btrim(text, ' \t\r\n')) > 0").select(*docs.columns)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), n AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l) WHERE line <> ''
), s AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM n
), f AS (
  SELECT doc_id, pos AS i, max(pos) OVER v AS j, list(line) OVER v AS run, sum(w) OVER v AS words
  FROM (SELECT *, e - w AS b FROM s) WINDOW v AS (PARTITION BY doc_id ORDER BY b RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
), g AS (
  SELECT doc_id, min(pos) OVER v AS i, pos AS j, list(line) OVER v AS run, sum(w) OVER v AS words
  FROM s WINDOW v AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), r AS (
  SELECT doc_id, i, j, run FROM f WHERE words >= 50 UNION SELECT doc_id, i, j, run FROM g WHERE words >= 50
), c AS (
  SELECT doc_id, i, j, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM r
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM c JOIN l ON l.doc_id = c.doc_id AND l.pos BETWEEN c.i AND c.j WHERE c.k > 1
), t AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed, string_agg(CASE WHEN gone.pos IS NULL THEN l.raw END, chr(10) ORDER BY l.pos) AS kept
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.kept, '') END AS text, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""

QUERIES = {"op2_line_winnow": op2_line_winnow}
ORACLES = {"op2_line_winnow": ORACLE}
