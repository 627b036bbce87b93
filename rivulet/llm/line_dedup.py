"""Line dedup with content-defined chunks, in DataFrame functions only.

A text is cut at line ends into chunks: a hash of two neighbouring lines' hashes rolls over the text,
and a chunk ends behind a line whose rolling hash is less than those before and behind it, so that
boundaries depend on the lines around them alone and shift with them, no frequent line decides
by itself where to cut, and none but a text's first and last chunk is a single line.  Chunks of two lines or more that occur again anywhere are removed, all but the
first occurrence (least doc_id, then place in the text).

1. Chunk hashes are counted; each document keeps the numbers of its repeated ones.
2. Those chunks' texts are cut out again and grouped by the text itself, which is the byte
   comparison; the least place of each text is its first occurrence.
3. A document loses its repeated chunks less those that are first occurrences.

Counts and least places are aggregated before the shuffle, first occurrences are one row a
text, and where all occurrences meet their counts (step 1) hot hashes are spread, so a chunk
that a third of all documents hold fills no task.

A short passage may hold no whole chunk, so line_dedup leaves some of them in every document.  passage_dedup takes the same steps with every two neighbouring lines as a
candidate and misses none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread, materialise, table

#: Above all hashes.
TOP = 1 << 32
#: What the earlier line's hash is multiplied by in the rolling hash, a fixed value.
STEP = 31
#: A text with more than white space.
SOME = r"[^\s]"


def _cut(df: DataFrame) -> DataFrame:
    """Adds lines, ends and starts (1-based, inclusive) of the chunks of `text`."""
    df = df.withColumn("lines", F.split("text", "\n", -1))
    hashes = F.transform("lines", lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))
    df = df.withColumn("hashes", hashes)
    df = df.withColumn("rolling", F.transform("hashes", lambda h, i: (F.coalesce(F.get("hashes", i - 1), F.lit(0)) * STEP + h) % TOP))
    beside = lambda i: F.coalesce(F.get("rolling", i), F.lit(TOP))
    least = F.transform("rolling", lambda h, i: F.when((h < beside(i - 1)) & (h < beside(i + 1)), i + 1).otherwise(0))
    places = F.filter(least, lambda i: i > 0)
    df = df.withColumn("ends", F.array_union(places, F.array(F.size("lines"))))
    return df.withColumn("starts", F.slice(F.concat(F.array(F.lit(1)), F.transform("ends", lambda e: e + 1)), 1, F.size("ends")))


def _body(starts: Column, ends: Column, no: Column) -> Column:
    s, e = F.get(starts, no), F.get(ends, no)
    return F.array_join(F.slice(F.col("lines"), s, e - s + 1), "\n")


def _long_chunks() -> Column:
    """Numbers of the chunks of two lines or more."""
    spans = F.zip_with("starts", "ends", lambda s, e: e > s)
    return F.filter(F.transform(spans, lambda many, i: F.when(many, i).otherwise(-1)), lambda i: i >= 0)


def _repeated(hashed: DataFrame) -> DataFrame:
    """(id, t, marked): the numbers of each document's candidates (id, t, no, h) whose hash occurs again."""
    counts = materialise(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    return join_spread(hashed, counts, ["h"], "n", ["id", "no"]).groupBy("id", "t").agg(F.collect_set("no").alias("marked"))


def _first(bodies: DataFrame) -> DataFrame:
    """(id, t, first): the numbers of each document's candidates (id, t, no, body) that are the
    first occurrence of their text."""
    place = bodies.groupBy("body").agg(F.min(F.struct("id", "t", "no")).alias("p"))
    return place.groupBy("p.id", "p.t").agg(F.collect_set("p.no").alias("first"))


def _with_marks(usable: DataFrame, others: DataFrame, marks: DataFrame, first: DataFrame) -> DataFrame:
    found = usable.join(marks.hint("merge"), ["id", "t"], "left").join(first.hint("merge"), ["id", "t"], "left")
    none = F.lit(None).cast("array<int>")
    return found.unionByName(others.withColumns({"marked": none, "first": none}))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """doc_id, text, n_lines, n_chunks, n_removed_lines for each row of `docs`; text is what is
    left, lines joined by line ends.  `carry` is an expression over `docs` that comes along as a
    column named carry.

    Null texts stay null with 0 lines; an empty text is one empty line; chunks of white space
    only are kept.  Rows without an id are returned as they are and stand for no occurrence;
    rows that share id and text are one occurrence.  A text of which all is removed becomes
    empty.  Other columns aren't read."""
    extra = [] if carry is None else [carry.alias("carry")]
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *extra)
    base = base.withColumn("t", F.xxhash64("text"))
    # both joins with the texts have the same filter below, and the id a name of its own (an alias
    # that Spark removes on one side only would tell them apart), so their exchange is made once
    usable = base.where("id is not null and text is not null")
    others = base.where("id is null or text is null")
    # at most one chunk in two lines: texts of one line have none
    cut = _cut(usable.where(F.contains("text", F.lit("\n"))))
    chunk = lambda i: _body(F.col("starts"), F.col("ends"), i)
    hashed = cut.select("id", "t", F.explode(F.transform(_long_chunks(), lambda i: F.struct(i.alias("no"), F.when(F.regexp_like(chunk(i), F.lit(SOME)), F.xxhash64(chunk(i))).alias("h")))).alias("c"))
    marks = _repeated(hashed.select("id", "t", "c.no", "c.h").where("h is not null"))

    again = _cut(usable.select("id", "text", "t").join(marks.hint("merge"), ["id", "t"]))
    bodies = again.select("id", "t", F.explode(F.transform("marked", lambda i: F.struct(i.alias("no"), chunk(i).alias("body")))).alias("c"))
    first = _first(bodies.select("id", "t", "c.no", "c.body"))

    whole = _cut(_with_marks(usable, others, marks, first)).withColumn("gone", F.array_except("marked", F.coalesce("first", F.array().cast("array<int>"))))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("ends") - 1), "gone")
    left = F.flatten(F.transform(numbers, lambda i: F.slice(F.col("lines"), F.get("starts", i), F.get("ends", i) - F.get("starts", i) + 1)))
    whole = whole.withColumn("left", F.when(F.col("gone").isNotNull(), left))
    some = F.col("left").isNotNull()
    out = whole.select(
        F.col("id").alias("doc_id"), *(["carry"] if extra else []), F.when(some, F.array_join("left", "\n")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("ends")).cast("long").alias("n_chunks"),
        F.when(some, F.size("lines") - F.size("left")).otherwise(0).cast("long").alias("n_removed_lines"),
    )
    return out


def passage_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """doc_id, text, n_lines, n_removed_lines for each row of `docs`, as line_dedup; every repeated
    passage of two lines or more goes, wherever it begins.

    A pair of neighbouring lines that isn't white space only is a repeat if the same two lines
    stand at an earlier place (least id, then place in the text) that it doesn't overlap; both
    lines of a repeat go.  So each line that goes has an earlier copy that stays.  Null texts,
    rows without an id and rows that share id and text are treated as in line_dedup."""
    extra = [] if carry is None else [carry.alias("carry")]
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *extra)
    base = base.withColumn("t", F.xxhash64("text"))
    usable = base.where("id is not null and text is not null")
    others = base.where("id is null or text is null")
    split = F.split("text", "\n", -1)
    hashes = usable.where(F.contains("text", F.lit("\n"))).select("id", "t", F.transform(split, lambda x: F.xxhash64(x)).alias("hs"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("hs") - 2), lambda i: F.xxhash64(F.get("hs", i), F.get("hs", i + 1)))
    hashed = hashes.select("id", "t", F.posexplode(pairs).alias("no", "h"))
    body = lambda i: F.concat(F.get("lines", i), F.lit("\n"), F.get("lines", i + 1))
    marks = _repeated(hashed)

    again = usable.select("id", "text", "t").join(marks.hint("merge"), ["id", "t"]).withColumn("lines", split)
    bodies = again.select("id", "t", F.explode(F.transform("marked", lambda i: F.struct(i.alias("no"), body(i).alias("body")))).alias("c"))
    first = _first(bodies.select("id", "t", "c.no", "c.body"))

    whole = _with_marks(usable, others, marks, first).withColumn("lines", split)
    firsts = F.coalesce("first", F.array().cast("array<int>"))
    # one that overlaps its first occurrence has three equal lines
    overlaps = lambda i: F.array_contains(firsts, i - 1) & (body(i) == body(i - 1))
    whole = whole.withColumn("gone", F.filter(F.array_except("marked", firsts), lambda i: F.regexp_like(body(i), F.lit(SOME)) & ~overlaps(i)))
    both = F.array_union("gone", F.transform("gone", lambda i: i + 1))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), both), lambda i: F.get("lines", i))
    whole = whole.withColumn("left", F.when(F.col("gone").isNotNull(), left))
    some = F.col("left").isNotNull()
    return whole.select(
        F.col("id").alias("doc_id"), *(["carry"] if extra else []), F.when(some, F.array_join("left", "\n")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(some, F.size("lines") - F.size("left")).otherwise(0).cast("long").alias("n_removed_lines"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op1_passage_dedup(spark, sf_dir: str) -> DataFrame:
    out = passage_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS m FROM l),
h AS (SELECT *, (coalesce(lag(m) OVER (PARTITION BY doc_id ORDER BY i), 0) * {STEP} + m) % {TOP} AS h FROM m),
r AS (SELECT *, h < coalesce(lag(h) OVER w, {TOP}) AND h < coalesce(lead(h) OVER w, {TOP}) AS cut FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(CAST(cut AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM r),
b AS (SELECT doc_id, no, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n FROM c GROUP BY doc_id, no),
d AS (SELECT doc_id, no, n >= 2 AND regexp_matches(body, '[^\\s]') AND row_number() OVER (PARTITION BY body, n >= 2 ORDER BY doc_id, no) > 1 AS gone FROM b),
k AS (SELECT c.doc_id, count(*) AS n_lines, count(DISTINCT c.no) AS n_chunks, count(*) FILTER (d.gone) AS n_removed_lines,
      coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT d.gone), '') AS kept
      FROM c JOIN d ON c.doc_id = d.doc_id AND c.no = d.no GROUP BY c.doc_id)
SELECT o.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_removed_lines, 0) AS n_removed_lines, sha256(kept) AS kept_sha256
FROM documents o LEFT JOIN k ON o.doc_id = k.doc_id
"""

PASSAGE_ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS body FROM l),
f AS (SELECT doc_id, i, first_value(doc_id) OVER w AS d1, first_value(i) OVER w AS i1 FROM p
      WHERE body IS NOT NULL AND regexp_matches(body, '[^\\s]') WINDOW w AS (PARTITION BY body ORDER BY doc_id, i)),
g AS (SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM f WHERE doc_id <> d1 OR i > i1 + 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed_lines, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT o.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, sha256(kept) AS kept_sha256
FROM documents o LEFT JOIN k ON o.doc_id = k.doc_id
"""
