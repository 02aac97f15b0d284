"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a text are hashed to 128 bits. A window that occurs more than once, anywhere, keeps its first
occurrence by (doc_id, digest of the text, position); every later one covers its three lines, and the union of the covered positions is removed.
A later occurrence that overlaps the first in the same document covers only what lies behind the first. No
line's last copy is lost, as a removed line stands in a window that occurs earlier.

Plan: windows shuffle as (hash, doc_id, digest, position), pre-aggregated to the first occurrence, then meet the windows again in a sort-merge
join which AQE splits for hot windows; texts shuffle once, by doc_id and digest, and no window list exceeds its own document.

Defined results: null texts stay null and have 0 lines; texts of fewer than three lines have no window and stay as they are; rows with a null
doc_id stay as they are. A document is a doc_id with a text: different texts under one doc_id are documents of their own, in the order of their
digests, and rows that repeat both are one, which loses the same lines in each. The result has only the columns named here, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def digest(text_col: str) -> Column:
    """60 bits of the text's MD5, which tell texts under one doc_id apart (DuckDB gives the same)."""
    return F.conv(F.substring(F.md5(F.col(text_col).cast("binary")), 1, 15), 16, 10).cast("long")


def windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h1, h2, doc, th (the text's digest), pos: each window of lines. Two 64-bit hashes over the lines in different order stand for it."""
    lines = F.split(F.col(text_col), "\n", -1)
    hashed = F.transform(
        F.sequence(F.lit(1), F.size("lines") - WINDOW + 1),
        lambda i: F.struct(
            F.xxhash64(*[F.element_at("lines", i + k) for k in range(WINDOW)]).alias("h1"),
            F.xxhash64(F.lit("b"), *[F.element_at("lines", i + k) for k in reversed(range(WINDOW))]).alias("h2"),
        ),
    )
    return (
        df.select(F.col(id_col).alias("doc"), digest(text_col).alias("th"), lines.alias("lines"))
        .where(F.col("doc").isNotNull() & (F.size("lines") >= WINDOW))
        .select("doc", "th", F.posexplode(hashed).alias("pos", "w"))
        .select("w.h1", "w.h2", "doc", "th", "pos")
    )


def covered(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, th, cut: the sorted positions (from 0) of the lines that go, for documents that lose any."""
    all_windows = windows(df, id_col, text_col)
    at = F.struct("doc", "th", "pos")
    first = all_windows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = all_windows.join(first, ["h1", "h2"]).where(at > F.col("first"))
    starts = F.when((F.col("doc") == F.col("first.doc")) & (F.col("th") == F.col("first.th")), F.greatest("pos", F.col("first.pos") + WINDOW)).otherwise(F.col("pos"))
    return (
        later.select("doc", "th", starts.alias("lo"), (F.col("pos") + WINDOW - 1).alias("hi"))
        .where("lo <= hi")
        .select("doc", "th", F.explode(F.sequence("lo", "hi")).alias("at"))
        .groupBy("doc", "th")
        .agg(F.array_sort(F.collect_set("at")).alias("cut"))
    )


def without(df: DataFrame, cut: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the lines in cut; adds __cut, true where a text lost lines, and __lines and __removed, how many it had and lost."""
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__at"))
    joined = df.withColumn("__th", digest(text_col)).join(cut.select(F.col("doc").alias(id_col), F.col("th").alias("__th"), F.col("cut").alias("__at")), [id_col, "__th"], "left")
    counted = joined.withColumns(
        {
            "__lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"),
            "__removed": F.when(F.col("__at").isNull(), 0).otherwise(F.size("__at")).cast("long"),
            "__cut": F.col("__at").isNotNull(),
        }
    )
    return counted.withColumn(text_col, F.when(F.col("__at").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))).drop("__at", "__th")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text (what is left), n_lines (before), n_removed; one row for each row of df."""
    out = without(df.select(id_col, text_col), covered(df, id_col, text_col), id_col, text_col)
    return out.select(id_col, F.col(text_col).alias("text"), F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"))


ORACLE = """
WITH d AS (SELECT doc_id, text, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS th, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id AS doc, th, p - 1 AS pos, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS w
  FROM (SELECT doc_id, th, l, unnest(range(1, len(l) - 1)) AS p FROM d WHERE doc_id IS NOT NULL AND len(l) >= 3)),
f AS (SELECT w, min(struct_pack(doc := doc, th := th, pos := pos)) AS f FROM w GROUP BY w HAVING count(*) > 1),
c AS (
  SELECT doc, th, CASE WHEN doc = f.doc AND th = f.th THEN greatest(pos, f.pos + 3) ELSE pos END AS lo, pos + 2 AS hi
  FROM w JOIN f USING (w) WHERE struct_pack(doc := doc, th := th, pos := pos) > f),
g AS (SELECT DISTINCT doc, th, unnest(range(lo, hi + 1)) AS i FROM c WHERE lo <= hi),
s AS (SELECT doc, th, list(i) AS cut FROM g GROUP BY doc, th)
SELECT doc_id,
  CASE WHEN cut IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: NOT list_contains(cut, i)), lambda i: l[i + 1]), chr(10)), '') END AS text,
  CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(cut), 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN s ON d.doc_id = s.doc AND d.th = s.th
"""
