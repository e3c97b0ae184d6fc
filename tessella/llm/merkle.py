"""Document fingerprints with DataFrame functions only: a Merkle tree of sections, paragraphs and clauses.

A paragraph is a line. Its clauses are cut after spaces that follow certain letters or marks, at most 48 code points on, so an edit moves
few cuts. A clause is known by half its MD5, a paragraph by the SHA-256 of its clauses, a section by that of its paragraphs, the document by
that of its sections: the root is the fingerprint. A section ends after a paragraph whose digest starts with 0 to 3, so sections
realign after an edit too. Equal texts have equal roots; unequal texts differ in theirs but for a collision of 64-bit clause digests. To locate edits two trees are
walked down from the root, into sections that differ only. Likeness is Dice's measure of the distinct clauses of two trees.

Null text is empty. In the next-document order null doc_ids come last (they are smallest), equal doc_ids by falling text. A lone document is its own next one;
an empty table gives no rows. Only doc_id and text are read. Rows that all share one doc_id, or have none, are ordered by one task, as their order is by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLAUSE = "(?s).{1,48}?[.,;:!?nrst] +|.{1,48}"
CELLS = 1024  # of the doc_id histogram


def tree(text: Column) -> Column:
    """Clause digests by paragraph."""
    return F.transform(F.split(text, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), F.lit(0)), lambda c: F.substring(F.md5(c.cast("binary")), 1, 16)))


def paragraphs(nodes: Column) -> Column:
    return F.transform(nodes, lambda p: F.sha2(F.array_join(p, "").cast("binary"), 256))


def branches(paragraph: Column) -> Column:
    """Sections as structs: digest, number of the first paragraph, paragraph digests."""
    marked = F.array_join(F.transform(paragraph, lambda d: F.concat(d, F.when(F.substring(d, 1, 1) < "4", "|").otherwise(","))), "")
    cut = F.transform(F.split(marked, "[|]"), lambda s: F.struct(F.sha2(s.cast("binary"), 256).alias("digest"), F.filter(F.split(s, ","), lambda d: d != "").alias("paragraphs")))
    start = lambda i: F.aggregate(F.slice(cut, 1, i), F.lit(0), lambda n, s: n + F.size(s["paragraphs"]))
    return F.transform(cut, lambda s, i: F.struct(s["digest"].alias("digest"), start(i).alias("first"), s["paragraphs"].alias("paragraphs")))


def sections(paragraph: Column) -> Column:
    """Section digests from paragraph digests."""
    marked = F.array_join(F.transform(paragraph, lambda d: F.concat(d, F.when(F.substring(d, 1, 1) < "4", "|").otherwise(","))), "")
    return F.transform(F.split(marked, "[|]"), lambda s: F.sha2(s.cast("binary"), 256))


def root(section: Column) -> Column:
    return F.sha2(F.array_join(section, ",").cast("binary"), 256)


def fingerprint(nodes: Column) -> Column:
    return root(sections(paragraphs(nodes)))


def likeness(a: Column, b: Column) -> Column:
    """Of two columns of distinct clause digests."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def differing(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of the first tree that the second lacks: where the edits are.

    Both are `branches`. Equal roots end the walk; a section that the other tree has too is passed over whole; in the others, paragraphs are looked up among
    those of the other tree's sections that differ.
    """
    digest = lambda x: F.transform(x, lambda s: s["digest"])
    other = F.flatten(F.transform(F.filter(b, lambda s: ~F.array_contains(digest(a), s["digest"])), lambda s: s["paragraphs"]))
    own = F.filter(a, lambda s: ~F.array_contains(digest(b), s["digest"]))
    found = F.flatten(F.transform(own, lambda s: F.filter(F.transform(s["paragraphs"], lambda d, i: F.when(~F.array_contains(other, d), s["first"] + i)), lambda i: i.isNotNull())))
    return F.when(root(digest(a)) == root(digest(b)), F.array().cast("array<int>")).otherwise(found)


def edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per doc_id in both tables: the numbers of the paragraphs that went and of those that came. Repeated doc_ids are compared each with each."""
    trees = [d.where("doc_id is not null").select("doc_id", branches(paragraphs(tree(F.coalesce(F.col("text"), F.lit(""))))).alias(x)) for d, x in ((old, "a"), (new, "b"))]
    return trees[0].join(trees[1], "doc_id").select("doc_id", differing(F.col("a"), F.col("b")).alias("went"), differing(F.col("b"), F.col("a")).alias("came"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, section and paragraph digests of every row."""
    t = docs.select("doc_id", paragraphs(tree(F.coalesce(F.col("text"), F.lit("")))).alias("paragraphs"))
    t = t.withColumn("sections", sections(F.col("paragraphs")))
    return t.select("doc_id", root(F.col("sections")).alias("fingerprint"), "sections", "paragraphs")


def buckets(docs: DataFrame, n: int) -> Column:
    """About n buckets of equal rows, rising with doc_id: quantiles of doc_id, found by binary search. Null is -1."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    found = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 4 * n)).first()[0]
    bounds = sorted(set(found or [0]))
    powers = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    place = F.lit(bounds)
    below = F.aggregate(powers, F.lit(0), lambda low, p: F.when((low + p <= len(bounds)) & (F.get(place, low + p - 1) < F.col("doc_id")), low + p).otherwise(low))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(below).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, the text of the next document by falling doc_id; after the last comes the first. Texts are shuffled once."""
    doc = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), doc.rdd.getNumPartitions())
    doc = doc.withColumn("bucket", buckets(docs, n))
    tops = doc.groupBy("bucket").agg(F.max("doc_id").alias("top"))  # one short row a bucket
    heads = doc.join(F.broadcast(tops.withColumnRenamed("bucket", "b")), F.expr("bucket = b and doc_id <=> top")).groupBy("bucket").agg(F.max("text").alias("head"))
    every = Window.orderBy("bucket")
    below = tops.select("bucket", F.coalesce(F.lag("bucket").over(every), F.max("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("below"))
    follow = below.join(heads.withColumnRenamed("bucket", "below"), "below").select("bucket", "head")
    inside = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    lead = doc.withColumn("after", F.lead("text").over(inside))
    return lead.join(follow, "bucket").select("doc_id", "text", F.coalesce("after", "head").alias("next_text"))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edit, whose last third is the next document's start; likeness to the edit and to the next document."""
    d = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars as int) - cast(floor(n_chars / 3) as int))"), F.left("next_text", third)))
    d = d.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *(tree(F.col(x)).alias(y) for x, y in (("text", "own"), ("edited", "edit"), ("next_text", "next"))))
    d = d.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edit")).alias("edited_fingerprint"), *(F.array_distinct(F.flatten(x)).alias(x) for x in ("own", "edit", "next")))
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))


_TREE = "list_transform(string_split({0}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '(?s).{{1,48}}?[.,;:!?nrst] +|.{{1,48}}'), lambda c: left(md5(c), 16)))"
_ROOT = "sha256(array_to_string(list_transform(string_split(array_to_string(list_transform(list_transform({0}, lambda p: sha256(array_to_string(p, ''))), lambda d: d || CASE WHEN left(d, 1) < '4' THEN '|' ELSE ',' END), ''), '|'), lambda s: sha256(s)), ','))"
_LIKE = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM d),
e AS (SELECT *, left(text, n_chars - n_chars // 3) || left(next_text, n_chars // 3) AS edited FROM n),
t AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_TREE.format("text")} AS own, {_TREE.format("edited")} AS edit, {_TREE.format("next_text")} AS nxt FROM e),
f AS (SELECT doc_id, n_chars, edited_sha256, {_ROOT.format("own")} AS fingerprint, {_ROOT.format("edit")} AS edited_fingerprint, list_distinct(flatten(own)) AS a, list_distinct(flatten(edit)) AS b, list_distinct(flatten(nxt)) AS c FROM t)
SELECT doc_id, n_chars::BIGINT AS n_chars, edited_sha256, fingerprint, edited_fingerprint, {_LIKE.format("a", "b")} AS near_edited, {_LIKE.format("a", "c")} AS near_next FROM f
"""
