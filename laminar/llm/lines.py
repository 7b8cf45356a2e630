"""Line dedup by overlapping windows of consecutive lines, in DataFrame functions only.

Lines are what stands between line feeds, unchanged; a null text has none, an empty text one empty line. A window is
`size` consecutive lines of a document, told by two hashes over its lines. Every line covered by a window whose lines also
start earlier (smaller doc_id, or further up in the same document) goes; windows are judged on the input. Shorter
documents have no window and stay whole. Rows that share a doc_id, and all rows without one (they come last), are
ordered by a hash of the text; of rows with the same text, one comes first. Other columns, clashing names included, play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.llm.common import ROW, copies_counted, rows_keyed, unkeyed

SIZE = 3


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_text of every row of docs.

    Windows leave the scan as two hashes and a position; a window's first place is found by a partial
    aggregate, so a hot window costs one row a task, and its later places by an equi-join whose skewed side AQE
    splits. Texts are shuffled once, to meet their covered positions."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    whole = rows_keyed(docs)
    hashed = whole.select(*ROW, F.transform(lines, lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") >= size)

    def window(i):
        at = [F.get("h", i + k) for k in range(size)]
        return F.struct(i.cast("int").alias("at"), F.xxhash64(*at).alias("a"), F.hash(*at).alias("b"))

    windows = hashed.select(*ROW, F.explode(F.transform(F.sequence(F.lit(0), F.size("h") - size), window)).alias("w")).select(*ROW, "w.*")
    firsts = windows.groupBy("a", "b").agg(F.min(F.struct(*ROW, "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(firsts, ["a", "b"]).where(F.struct(*ROW, "at") > F.col("first"))
    covered = later.groupBy(*ROW).agg(F.collect_set("at").alias("ats"))

    met = copies_counted(whole.join(covered, ROW, "left")).select("doc_key", "text", lines.alias("lines"), "ats", "copy")
    spread = F.flatten(F.transform(F.coalesce("ats", F.array().cast("array<int>")), lambda i: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: i + k)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), spread)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    repeats = (F.col("copy") > 0) & (F.size("lines") >= size)
    out = met.select("doc_key", n.cast("long").alias("n_lines"), "lines", F.when(repeats, F.array().cast("array<int>")).when(F.col("ats").isNull(), F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(kept).alias("kept"))
    removed = F.when(F.col("n_lines") > 0, F.col("n_lines") - F.size("kept")).otherwise(0)
    return out.select(unkeyed().alias("doc_id"), "n_lines", removed.cast("long").alias("n_removed"), F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n").alias("kept_text"))


ORACLE = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(lines) - 2)) AS pos, lines FROM l WHERE len(lines) >= 3),
k AS (SELECT doc_id, pos, list_slice(lines, pos + 1, pos + 3) AS key FROM w),
later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS r FROM k) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, pos + o AS pos FROM later, range(0, 3) AS t(o)),
p AS (SELECT l.doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line FROM l),
k2 AS (SELECT p.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(p.line, chr(10) ORDER BY p.pos) FILTER (WHERE g.pos IS NULL) AS kept
  FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d JOIN k2 USING (doc_id)
"""
