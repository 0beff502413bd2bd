"""Removal of passages of several lines that repeat across documents; DataFrame functions only.

A text is cut into chunks of lines where a rolling hash of two line hashes says so, three places in four, so that a
passage is cut alike wherever it stands; a chunk of over ``LONGEST`` lines is cut again, counted from its start. From every
cut that lies inside a repeated passage the match grows line by line to both sides: a *piece* is the last line before a
cut and lines of the chunk behind it, or lines of the chunk before it and the first line behind it. Pieces whose hash
occurs more than once are compared byte by byte; of those found identical the first by identifier and place stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, staged

#: Lines of a chunk at most, so that the pieces of a text are of bounded length.
LONGEST = 32
#: A line that is not blank.
FILLED = r"[^\x20\x09-\x0D]"


def key_of(hashes: Column) -> Column:
    """What pieces are grouped by, from the hashes of their lines."""
    return F.unhex(F.md5(hashes))


def pieces(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th (hash of the text) and pieces: array of (from, to, key), the first line and the last; those of blank lines only are null.

    What a lambda below uses of other columns it uses twice, as Spark would move a column's expression into it otherwise.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), F.split(text, "\n", -1).alias("lines"))
    d = d.select("doc_id", "th", F.size("lines").alias("n"), F.transform("lines", lambda x: F.md5(x)).alias("hashes"), F.transform("lines", lambda x: x.rlike(FILLED)).alias("filled"))
    before = F.concat(F.array(F.lit("")), F.slice("hashes", F.lit(1), F.col("n") - 1))
    cut = F.zip_with(before, "hashes", lambda a, b: F.substring(F.md5(F.concat(a, b)), 32, 1) < "c")
    starts = F.array_compact(F.transform(cut, lambda c, i: F.when(c | (i == 0), i)))
    d = d.select("*", starts.alias("starts"))
    ends = lambda: F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array("n"))
    d = d.withColumn("starts", F.flatten(F.zip_with("starts", ends(), lambda s, e: F.sequence(s, e - 1, F.lit(LONGEST)))))
    chunks = F.zip_with("starts", ends(), lambda s, e: F.struct(s.alias("s"), e.alias("e")))

    def piece(low: Column, high: Column) -> Column:
        part = lambda c: F.slice(c, low + 1, high - low + 1)
        return F.when(F.exists(part("filled"), lambda x: x), F.struct(low.alias("from"), high.alias("to"), key_of(F.array_join(part("hashes"), "")).alias("key")))

    def of(c: Column) -> Column:
        s, e = c["s"], c["e"]
        behind = F.when(s > 0, F.transform(F.sequence(s, e - 1), lambda i: piece(s - 1, i)))
        ahead = F.when((e < F.col("n")) & (e - s > 1), F.transform(F.sequence(s, e - 2), lambda i: piece(i, e)))
        return F.concat(F.coalesce(behind, F.array()), F.coalesce(ahead, F.array()))

    return d.select("doc_id", "th", F.flatten(F.transform(chunks, of)).alias("pieces"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces whose hash occurs more than once: doc_id, th, from, to, key, and stays for the first of each hash."""
    # explode_outer, as for explode Spark infers a filter on the array and evaluates all that makes it once more for each use
    each = pieces(docs, id_col, text_col).select("doc_id", "th", F.explode_outer("pieces").alias("p")).filter("p is not null")
    places = staged(each.select("doc_id", "th", "p.from", "p.to", "p.key"), "line-places")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "from")).alias("first")
    often = places.groupBy("key").agg(F.count("*").alias("times"), first).filter("times > 1").drop("times")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("from") == F.col("first.from"))
    return places.join(hinted(often), "key").select("doc_id", "th", "from", "to", "key", stays.alias("stays")).distinct()


def _listed(docs: DataFrame, found: DataFrame, id_col: str, text: Column) -> DataFrame:
    """docs with _list, the pieces found in each. Texts travel once at every size, as no side is broadcast; Spark splits large keys of docs."""
    lists = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("from", "to", "key", "stays")).alias("_list")).select(F.col("doc_id").alias("_list_id"), F.col("th").alias("_list_th"), "_list")
    same = F.col(id_col).eqNullSafe(F.col("_list_id")) & (F.col("_th") == F.col("_list_th"))
    return staged(docs.withColumn("_th", F.xxhash64(text)).join(lists.hint("merge"), same, "left").drop("_th", "_list_id", "_list_th"), "line-listed")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with three columns more: clean_text, n_lines and removed_lines.

    Null texts count as empty; an empty text is one empty line and stays. A single line that repeats stays, as do
    repeated blank lines. Every line that goes stays in a document before it, or earlier in its own. Pieces whose
    hash is shared by different bytes stay everywhere. Rows alike in identifier and text are one document and are
    treated alike. An empty table gives none. Columns of docs of the three names are replaced.
    """
    found = staged(repeated(docs, id_col, text_col), "line-found")
    text = F.coalesce(F.col(text_col), F.lit(""))
    listed = _listed(docs, found, id_col, text)
    rows = listed.filter("_list is not null").select(F.split(text, "\n", -1).alias("lines"), "_list")
    body = lambda p: F.when(F.size("lines") > p["to"], F.array_join(F.slice("lines", p["from"] + 1, p["to"] - p["from"] + 1), "\n"))
    bodies = rows.select(F.explode_outer(F.transform("_list", lambda p: F.struct(p["key"].alias("key"), body(p).alias("body")))).alias("p")).select("p.key", "p.body")
    differ = staged(bodies.groupBy("key").agg((F.min("body") < F.max("body")).alias("differ")).filter("differ").select("key"), "line-differ")
    if not differ.isEmpty():
        listed = _listed(docs, found.join(hinted(differ), "key", "left_anti"), id_col, text)
    ranges = F.transform(F.filter("_list", lambda p: ~p["stays"]), lambda p: F.sequence(p["from"], p["to"]))
    out = listed.withColumns({"_gone": F.array_distinct(F.flatten(ranges)), "_lines": F.split(text, "\n", -1)})
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    hit = F.size(F.coalesce("_gone", F.array())) > 0
    out = out.withColumns({"n_lines": F.size("_lines"), "removed_lines": F.when(hit, F.size("_gone")).otherwise(0), "clean_text": F.when(hit, kept).otherwise(text)})
    return out.drop("_list", "_gone", "_lines")


#: The same in DuckDB's SQL, for tables whose identifiers are unique.
ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
h AS (SELECT doc_id, CAST(i AS INTEGER) AS i, len(lines) AS n, md5(lines[i + 1]) AS h FROM d, unnest(range(len(lines))) AS u(i)),
c AS (SELECT *, i = 0 OR right(md5(lag(h) OVER w || h), 1) < 'c' AS cut FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT *, max(CASE WHEN cut THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS head FROM c),
b AS (SELECT *, (i - head) % 32 = 0 AS starts FROM s),
k AS (SELECT *, max(CASE WHEN starts THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS s,
  coalesce(min(CASE WHEN starts THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS e FROM b),
p AS (SELECT doc_id, s - 1 AS low, i AS high FROM k WHERE s > 0 UNION ALL SELECT doc_id, i, e FROM k WHERE e < n AND i < e - 1),
body AS (SELECT p.*, array_to_string(d.lines[low + 1 : high + 1], chr(10)) AS body FROM p JOIN d USING (doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS i
  FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, low) AS r FROM body WHERE regexp_matches(body, '[^\x20\x09-\x0D]')) x WHERE r > 1),
kept AS (SELECT l.doc_id, l.i, l.n, g.i IS NOT NULL AS gone FROM h l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i)
SELECT doc_id, CAST(max(n) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS removed_lines,
  md5(coalesce(string_agg(d.lines[i + 1], chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS clean_md5
FROM kept JOIN d USING (doc_id) GROUP BY doc_id
"""
