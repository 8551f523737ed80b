"""Quality rules of a document and of its lines across documents, in DataFrame functions only.

Lines are normalised (case, digits, white space) and hashed; for each host the documents that hold a line
are counted, with a partial sum in every task, so that a line of a third of all rows is one row a task.
Lines in more documents of a host than its limit are removed, and a document that little is left of is
rejected. The lines above a limit are few (each stands in many documents); they are broadcast if their
count is within a bound, and joined by a shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import common

SPACE = r"\x20\x09-\x0D"
#: A line may stand in this share of a host's documents, and in so many at least.
LIMIT_SHARE, LEAST_LIMIT = 0.01, 20
#: What must be left of a document: words, and a share of its words.
LEAST_WORDS, LEAST_SHARE = 20, 0.2
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rows of lines above their limit that may be broadcast, about 30 bytes each.
MAX_LINES = 100_000
#: Low bits that hold a word's place where windows are sorted by hash; longer texts take more (a string cannot hold 2**28 windows).
PLACE_BITS, LONG_PLACE_BITS = 20, 28


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, white space as one space."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.lower(F.regexp_replace(F.regexp_replace(bare, "[0-9]", "0"), f"[{SPACE}]+", " "))


def _repeats(rows: DataFrame) -> DataFrame:
    """rows with w; adds n_repeat_words: words in windows of three that come twice or more.

    Windows are sorted by hash with their place in the low bits, so equal ones are neighbours. Those whose hash
    comes once are unique; the others are sorted by their words, and neighbours compared. So the hash, of which
    long texts keep fewer bits, decides nothing but how many windows are compared by their words.
    """
    n = F.size("w")
    bits = F.when(n < 1 << PLACE_BITS, F.lit(PLACE_BITS)).otherwise(F.lit(LONG_PLACE_BITS))
    rows = rows.withColumn("bits", bits)
    place = lambda x: x.bitwiseAND(F.expr("shiftleft(1L, bits) - 1L")).cast("int")
    high = lambda x: F.call_function("shiftright", x, F.col("bits"))
    window = lambda i: F.call_function("shiftleft", F.call_function("shiftright", F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)), F.col("bits")), F.col("bits")).bitwiseOR(i.cast("long"))
    rows = rows.withColumn("s", F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))).otherwise(F.array().cast("array<bigint>")))
    beside = lambda x, i, by: F.coalesce(high(x) == high(F.get("s", i + by)), F.lit(False))
    rows = rows.withColumn("c", F.filter("s", lambda x, i: beside(x, i, -1) | beside(x, i, 1))).drop("s")
    text = lambda p: F.concat_ws(" ", F.get("w", p), F.get("w", p + 1), F.get("w", p + 2))
    rows = rows.withColumn("c", F.sort_array(F.transform("c", lambda x: F.struct(text(place(x)).alias("k"), place(x).alias("p")))))
    equal = lambda x, i, by: F.coalesce(x["k"] == F.get("c", i + by)["k"], F.lit(False))
    rows = rows.withColumn("c", F.filter("c", lambda x, i: equal(x, i, -1) | equal(x, i, 1)))
    rows = rows.withColumn("c", F.sort_array(F.transform("c", lambda x: x["p"])))
    covered = F.aggregate(F.transform("c", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("c", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("c", "bits")


def rules(docs: DataFrame, host: str = "source", share: float = LIMIT_SHARE, least: int = LEAST_LIMIT) -> DataFrame:
    """Per row of docs (doc_id, text, host): doc_id, the counts, base_failed, words_left after frequent lines go, kept.

    A null text counts as empty and fails for want of words; a null host is the host ''. Repeated rows are
    documents of their own and count as such in the line counts. A line at the limit stays; the limit of a
    host is the larger of `least` and `share` of its documents. Other columns of docs are not read.
    """
    return _judged(_named(docs, host), share, least).drop("row", "gone_lines")


def cleaned(docs: DataFrame, host: str = "source", share: float = LIMIT_SHARE, least: int = LEAST_LIMIT) -> DataFrame:
    """docs, all columns, with the lines above their limit removed from text; rows that rules() doesn't keep go, n_chars (if any) is counted anew."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), *_named(docs, host, row=False))
    # a row's number must be the same in the marks and in the texts
    rows = common.materialise(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    marks = _judged(rows.select("doc_id", "text", "host", "row"), share, least).where("kept").select("row", "gone_lines")
    gone = lambda x: x.rlike(f"[^{SPACE}]") & F.array_contains("gone_lines", F.xxhash64(normalised(x)))
    text = F.when(F.size("gone_lines") == 0, F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x: ~gone(x)), "\n"))
    out = rows.join(marks, "row").withColumn("left_text", text)
    made = {"text": F.col("left_text")} | ({"n_chars": F.char_length("left_text").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*(made.get(c, F.col("own")[c]).alias(c) for c in docs.columns))


def _named(docs: DataFrame, host: str, row: bool = True):
    """doc_id, text, host and row; without row the columns of the first three."""
    named = [F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"), (F.coalesce(F.col(host).cast("string"), F.lit("")) if host in docs.columns else F.lit("")).alias("host")]
    return docs.select(*named).withColumn("row", F.monotonically_increasing_id()) if row else named


def _judged(named: DataFrame, share: float, least: int) -> DataFrame:
    """The columns of rules() with row and gone_lines, the hashes of a row's lines above their limit."""
    line_hashes = F.array_distinct(F.transform(lines_with_words(F.col("text")), lambda x: F.xxhash64(normalised(x))))
    counts = named.select("host", F.explode(line_hashes).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    documents = named.groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    frequent = common.materialise(counts.join(documents, "host").where(F.col("n") > share * F.col("documents")).select("host", "line"), "lines")

    rows = named.select("row", "doc_id", "host", "text", words(F.col("text")).alias("w"), lines_with_words(F.col("text")).alias("l"))
    rows = rows.select(
        "row",
        "doc_id",
        "host",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("l", lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(words(x)).alias("n"))).alias("l"),
    )
    rows = _repeats(rows).drop("w")
    base = ["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    exploded = rows.select(*base, "host", F.explode_outer("l").alias("l")).select(*base, "host", "l.line", "l.n")
    marked = frequent.withColumn("gone", F.lit(True))
    joined = exploded.join(common.broadcast_if_small(marked, frequent.count(), MAX_LINES), ["host", "line"], "left")
    # all but row and the sum are the same for a document's lines
    out = joined.groupBy("row").agg(*(F.first(c).alias(c) for c in base[1:]), F.sum(F.when(F.col("gone"), F.col("n")).otherwise(0)).alias("removed"), F.collect_set(F.when(F.col("gone"), F.col("line"))).alias("gone_lines"))
    left = F.col("n_words") - F.col("removed")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    whole = (F.col("removed") == 0) | ((left >= LEAST_WORDS) & (left >= LEAST_SHARE * F.col("n_words")))
    return out.select("row", "gone_lines", *base[1:], failed.alias("base_failed"), left.alias("words_left"), (~failed & whole).alias("kept"))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents, with their source as host."""
    return rules(common.table(spark, sf_dir, "documents"))


#: The same for DuckDB.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
tri AS (SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 't': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}})) AS x FROM w WHERE len(w) >= 3),
dup AS (SELECT r, x.i AS i FROM tri QUALIFY count(*) OVER (PARTITION BY r, x.t) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY r),
ln AS (SELECT r, host, unnest(l) AS raw FROM w),
nl AS (SELECT r, host, lower(regexp_replace(regexp_replace(trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS line,
  len(list_filter(regexp_split_to_array(raw, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n FROM ln),
many AS (SELECT host, line, count(DISTINCT r) AS n FROM nl GROUP BY host, line HAVING count(DISTINCT r) > {LEAST_LIMIT}),
freq AS (SELECT host, line FROM many JOIN (SELECT host, count(*) AS documents FROM d GROUP BY host) h USING (host) WHERE many.n > {LIMIT_SHARE} * documents),
gone AS (SELECT r, sum(n) AS n FROM nl JOIN freq USING (host, line) GROUP BY r),
o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed
  FROM w LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, n_words - removed AS words_left FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_left,
  NOT base_failed AND (removed = 0 OR (words_left >= {LEAST_WORDS} AND words_left >= {LEAST_SHARE} * n_words)) AS kept FROM f
"""
