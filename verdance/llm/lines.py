"""Line dedup over the suffix order of line ids, in DataFrame operations only.

A run is a row of successive lines of one text. A run with at least ``least`` words that begins earlier somewhere else
(by doc_id, then line; the same text included) is a later copy, and its lines are deleted. So for each repeated run of
the corpus the first copy stays.

* Lines get ids. A line that occurs once is in no repeated run: from there on only islands of repeated lines matter.
* Prefix doubling: after k rounds a line's rank is its place in the order of all suffixes by their first 2^k lines. A
  round pairs the rank of a line with that of the line 2^k further on; the sorted distinct pairs are the next ranks.
  Equal ranks are an interval of the suffix order with a common prefix of 2^k lines, and two overlapping ranks make
  the interval of any length between two powers.
* A maximal repeated run with enough words is covered exactly by the shortest runs with enough words that begin, or
  end, at one of its lines: any of them is a copy as well, and a line near the run's end is covered by one that ends
  there. So the intervals are needed at those lengths alone, and doubling stops at the longest of them.
* The first member of each interval stays, the runs of all others are deleted.

Lines are cut at line feeds and compared as they are. A null text has no lines and stays null. Rows with the same
doc_id and text are one document (each row is returned, with the same deletions); rows with the same doc_id and other
text are told apart by a hash of the text. A null doc_id comes before all others. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdance.llm.common import WORD, cut

#: Words of the shortest run that counts as repeated.
LEAST_WORDS = 5

_KEY = ["d", "h"]


def _key(docs: DataFrame) -> dict[str, Column]:
    text = F.col("text").cast("string")
    return {"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "h": F.xxhash64(text)}


def _numbered(pairs: DataFrame, label: str) -> DataFrame:
    """The distinct repeated pairs (a, b) with ranks in their order."""
    repeated = pairs.groupBy("a", "b").agg(F.count("*").alias("times")).where("times > 1").select("a", "b")
    return cut(repeated.orderBy("a", "b").withColumn("rank", F.monotonically_increasing_id()), label)


def islands(docs: DataFrame) -> DataFrame:
    """Repeated lines: document (d, h), line n, island, words, rank, and the words from the island's first line on,
    before and after the line."""
    lines = docs.select("d", "h", F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("n", "line"))
    ids = lines.select(
        *_KEY,
        "n",
        F.xxhash64("line").alias("a"),
        F.xxhash64(F.lit(1), "line").alias("b"),
        F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"),
    )
    ids = cut(ids, "lines-ids")
    ranks = _numbered(ids, "lines-ranks")
    repeated = cut(ids.join(ranks, ["a", "b"]).drop("a", "b"), "lines-repeated")
    in_doc = Window.partitionBy(*_KEY).orderBy("n")
    marked = repeated.withColumn("island", F.col("n") - F.row_number().over(in_doc))
    so_far = Window.partitionBy(*_KEY, "island").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("after", F.sum("words").over(so_far))
    return cut(counted.withColumn("before", F.col("after") - F.col("words")), "lines-islands")


def shortest_runs(lines: DataFrame, least: int) -> DataFrame:
    """(d, h, n, length): the shortest runs with ``least`` words that begin or end at a line of an island."""
    island = Window.partitionBy(*_KEY, "island")
    edge = Window.unboundedPreceding, -least
    # first line with enough words before it, seen from the line where the run begins
    beyond = F.min("n").over(island.orderBy(F.col("before").desc()).rangeBetween(*edge))
    # last line with few enough words up to it, seen from the line where the run ends
    ahead = F.max("n").over(island.orderBy("after").rangeBetween(*edge))
    seen = lines.withColumns(
        {"first": F.min("n").over(island), "last": F.max("n").over(island), "all": F.max("after").over(island)}
    )
    seen = seen.withColumns({"beyond": beyond, "ahead": ahead})
    end = F.when(F.col("beyond").isNotNull(), F.col("beyond") - 1).when(
        F.col("all") - F.col("before") >= least, F.col("last")
    )
    begin = F.when(F.col("ahead").isNotNull(), F.col("ahead") + 1).when(F.col("after") >= least, F.col("first"))
    runs = F.array(
        F.struct(F.col("n").alias("n"), (end - F.col("n") + 1).alias("length")),
        F.struct(begin.alias("n"), (F.col("n") - begin + 1).alias("length")),
    )
    found = seen.select(*_KEY, F.explode(F.array_distinct(runs)).alias("run")).select(*_KEY, "run.*")
    return found.where("n is not null and length is not null").distinct()


def later_copies(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(d, h, n): the lines to delete, for documents (d, h, text)."""
    lines = islands(docs)
    runs = cut(shortest_runs(lines, least), "lines-runs")
    longest = runs.agg(F.max("length")).first()[0] or 0
    ranked, k, copies = lines.select(*_KEY, "island", "n", "rank"), 0, []
    while 1 << k <= longest:
        half = 1 << k
        own = runs.where((F.col("length") >= half) & (F.col("length") < 2 * half))
        front = ranked.select(*_KEY, "n", F.col("rank").alias("a"))
        back = ranked.select(*_KEY, F.col("n").alias("m"), F.col("rank").alias("b"))
        placed = own.join(front, [*_KEY, "n"]).withColumn("m", F.col("n") + F.col("length") - half)
        placed = cut(placed.join(back, [*_KEY, "m"]), "lines-placed")
        interval = placed.groupBy("length", "a", "b").agg(
            F.count("*").alias("times"), F.min(F.struct("d", "h", "n")).alias("earliest")
        )
        # between two tables Spark can split a hot interval
        interval = cut(interval.where("times > 1").drop("times"), "lines-intervals")
        late = placed.join(interval, ["length", "a", "b"]).where(F.struct("d", "h", "n") != F.col("earliest"))
        copies.append(cut(late.select(*_KEY, "n", "length"), "lines-copies"))
        if 2 * half <= longest:
            further = Window.partitionBy(*_KEY, "island").orderBy("n")
            pairs = ranked.withColumn("b", F.lead("rank", half).over(further)).where("b is not null")
            pairs = cut(pairs.withColumnRenamed("rank", "a"), "lines-pairs")
            ranked = cut(pairs.join(_numbered(pairs, "lines-ranks"), ["a", "b"]).drop("a", "b"), "lines-ranked")
        k += 1
    if not copies:
        return runs.select(*_KEY, "n").limit(0)
    every = copies[0]
    for more in copies[1:]:
        every = every.unionByName(more)
    covered = F.explode(F.sequence(F.col("n"), F.col("n") + F.col("length") - 1)).alias("n")
    return every.select(*_KEY, covered).distinct()


def deduplicated(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """row (all columns of ``docs`` as they were), text without the later copies, n_lines, n_removed."""
    text = F.col("text").cast("string")
    keyed = docs.select(F.struct("*").alias("row"), text.alias("text"), *[c.alias(k) for k, c in _key(docs).items()])
    once = keyed.select(*_KEY, "text").dropDuplicates(_KEY)
    gone = later_copies(once, least).groupBy(*_KEY).agg(F.collect_list("n").alias("gone"))
    joined = keyed.join(gone, _KEY, "left").withColumn("lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    shorter = F.array_join(F.transform(left, lambda i: F.element_at("lines", i + 1)), "\n")
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(shorter).alias("text"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"),
    )


def digest(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the text that is left."""
    left = deduplicated(docs.select("doc_id", "text"), least)
    return left.select("row.doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def without_copies(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The columns of ``docs`` with shorter texts; a text that lost all its words leaves, n_chars follows the text."""
    left = deduplicated(docs, least).where(f"n_removed = 0 or regexp_like(text, '{WORD}')")
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


#: The same for DuckDB: every shortest run by its text.
ORACLE = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, i, ls[i] AS line, len(regexp_extract_all(ls[i], '{WORD}')) AS words
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
),
c AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM l
),
s AS (
  SELECT x.doc_id, x.i AS s, min(y.i) AS e
  FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.after - (x.after - x.words) >= {LEAST_WORDS}
  GROUP BY ALL
  UNION
  SELECT y.doc_id, max(x.i) AS s, y.i AS e
  FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.after - (x.after - x.words) >= {LEAST_WORDS}
  GROUP BY y.doc_id, y.i
),
r AS (
  SELECT s.doc_id, s.s, s.e, array_to_string(d.ls[s.s:s.e], chr(10)) AS run FROM s JOIN d USING (doc_id)
),
f AS (SELECT *, row_number() OVER (PARTITION BY run, e - s ORDER BY doc_id, s) AS nth FROM r),
g AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM f WHERE nth > 1),
k AS (
  SELECT c.doc_id, count(g.i) AS n_removed,
    coalesce(string_agg(CASE WHEN g.i IS NULL THEN c.line END, chr(10) ORDER BY c.i), '') AS kept
  FROM c LEFT JOIN g USING (doc_id, i) GROUP BY c.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS INTEGER) AS n_lines,
  CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(k.kept) END AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
