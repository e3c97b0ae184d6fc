"""Benchmark decontamination with DataFrame functions only: windows of benchmark words are a broadcast hash set, document windows probe it.

Texts are lower-cased (A-Z only) and cut into words. A benchmark item's windows are its runs of `width` words, or all its words if it
has fewer. One scan of the documents explodes the 64-bit hash of every window of those lengths against the set; the words of each hit are
then compared, so a hash alone never decides. Hits and one row for each document are grouped; only those rows are shuffled.

The set is broadcast while it has at most `broadcast_windows` windows and SENT_BYTES of words and item ids. A larger one can't be: then place and hash of every document window are
shuffled to it, and the hits of a document go back to its text, where words are compared. Both ways give the same rows.

Null or empty text has no words and is never hit. A null item_id counts for hits but not as an item; items that repeat an item_id are one.
Documents are told apart by doc_id and a hash of the text, so repeated doc_ids and repeated rows keep their rows and their own verdicts.
An empty benchmark hits nothing; an empty table gives no rows. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13
SENT_BYTES = 128 << 20


def lowered(text: Column) -> Column:
    """A-Z in lower case; lower() does the same on plain ASCII and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows: w_size, w_hash, w_text, w_items."""
    item = benchmark.select("item_id", words(F.col("text")).alias("words")).where("size(words) > 0")
    item = item.withColumn("w_size", F.least(F.size("words"), F.lit(width)))
    cut = item.select("item_id", "w_size", F.expr("explode(transform(sequence(1, size(words) - w_size + 1), i -> slice(words, i, w_size)))").alias("w"))
    return cut.groupBy("w_size", F.xxhash64("w").alias("w_hash"), F.array_join("w", " ").alias("w_text")).agg(F.collect_set("item_id").alias("w_items"))


def _hashes(sizes: list[int]) -> list[Column]:
    """Structs of a window length and the hashes of all windows of that length in the column words."""
    runs = []
    for n in sizes:
        hashes = F.expr(f"if(size(words) < {n}, array(), transform(sequence(1, greatest(size(words) - {n - 1}, 1)), i -> xxhash64(slice(words, i, {n}))))")
        runs.append(F.struct(F.lit(n).alias("size"), hashes.cast("array<bigint>").alias("hashes")))
    return runs


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_windows: int = 500_000) -> DataFrame:
    """Per document: doc_id, text_hash, copies (equal rows), n_words, spans (sorted from, size of hit windows), items."""
    found = benchmark_windows(benchmark, width)
    counted = found.groupBy("w_size").agg(F.count("*").alias("n"), F.sum(F.octet_length("w_text") + 8 * F.size("w_items")).alias("bytes")).collect()
    sizes = {r["w_size"]: r["n"] for r in counted}
    doc = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    if sum(sizes.values()) > broadcast_windows or sum(r["bytes"] for r in counted) > SENT_BYTES:
        return _hits_by_shuffle(docs, doc, found, sorted(sizes))
    start = F.struct(F.lit(0).alias("size"), F.array(F.lit(0).cast("long")).alias("hashes"))  # the row that every document keeps
    run = doc.select("doc_id", "text_hash", "words", F.inline(F.array(start, *_hashes(sorted(sizes)))))
    window = run.select("doc_id", "text_hash", "words", "size", F.posexplode("hashes").alias("at", "hash"))
    probed = window.join(F.broadcast(found), (F.col("hash") == F.col("w_hash")) & (F.col("size") == F.col("w_size")), "left")
    kept = probed.where("size = 0 or array_join(slice(words, at + 1, size), ' ') = w_text")
    kept = kept.select("doc_id", "text_hash", F.size("words").alias("n_words"), "size", "at", "w_items")
    is_hit = F.col("size") > 0
    return kept.groupBy("doc_id", "text_hash").agg(
        F.count_if(~is_hit).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(is_hit, F.struct("at", "size")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set(F.when(is_hit, F.col("w_items"))))).alias("items"),
    )


def _hits_by_shuffle(docs: DataFrame, doc: DataFrame, found: DataFrame, sizes: list[int]) -> DataFrame:
    """The same rows where the windows are too many to broadcast. A passage that very many documents share is left to the skew join of adaptive execution."""
    window = doc.select("doc_id", "text_hash", F.inline(F.array(*_hashes(sizes)))).select("doc_id", "text_hash", "size", F.posexplode("hashes").alias("at", "hash"))
    probed = window.join(found, (F.col("hash") == F.col("w_hash")) & (F.col("size") == F.col("w_size")))
    probed = probed.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "size", "w_text", "w_items")).alias("probed"))
    every = docs.groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    same = F.expr("d.doc_id <=> p.doc_id and d.text_hash = p.text_hash")
    joined = every.alias("d").join(probed.alias("p"), same, "left").select("d.doc_id", "d.text_hash", "copies", "probed", words(F.col("text")).alias("words"))
    hit = F.expr("filter(coalesce(probed, array()), h -> array_join(slice(words, h.at + 1, h.size), ' ') = h.w_text)")
    return joined.select("doc_id", "text_hash", "copies", F.size("words").alias("n_words"), hit.alias("found")).select(
        "doc_id", "text_hash", "copies", "n_words",
        F.expr("array_sort(array_distinct(transform(found, h -> struct(h.at, h.size))))").alias("spans"),
        F.expr("array_distinct(flatten(transform(found, h -> h.w_items)))").alias("items"),
    )


def n_hit() -> Column:
    """Words inside any of the sorted spans."""
    return F.expr("aggregate(spans, named_struct('n', 0, 'end', 0), (s, x) -> named_struct('n', s.n + greatest(0, x.at + x.size - greatest(s.end, x.at)), 'end', greatest(s.end, x.at + x.size)), s -> s.n)")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20, broadcast_windows: int = 500_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (some hit, and share * n_hit >= n_words)."""
    found = hits(docs, benchmark, width, broadcast_windows).withColumn("n_hit", n_hit())
    listed = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    out = found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), F.explode(F.expr("array_repeat(1, cast(copies as int))")).alias("copy"),
    )
    return out.drop("copy")


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents", width: int = WIDTH, share: int = 20, broadcast_windows: int = 500_000) -> DataFrame:
    """Documents without the contaminated ones, or all of them without the hit words of contaminated ones (what='spans'); columns stay."""
    bad = hits(docs, benchmark, width, broadcast_windows).withColumn("n_hit", n_hit()).where(f"n_hit > 0 and n_hit * {share} >= n_words")
    doc_id, text_hash, spans = (free_name(docs, x) for x in ("_id", "_hash", "_spans"))
    bad = bad.select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(text_hash), F.col("spans").alias(spans))
    same = docs["doc_id"].eqNullSafe(F.col(doc_id)) & (F.xxhash64(docs["text"]) == F.col(text_hash))
    if what == "documents":
        return docs.join(bad, same, "left_anti")
    joined = docs.join(bad, same, "left")
    # each piece is a word with what stands before it, so what is kept keeps its separators
    pieces = F.expr(r"transform(regexp_extract_all(text, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0), (x, i) -> if(exists(`{}`, s -> i >= s.at and i < s.at + s.size), '', x))".format(spans))
    tail = F.regexp_extract("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    clean = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.withColumn("text", clean).select(*docs.columns)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
b2 AS (SELECT item_id, words, least(len(words), 13) AS size FROM b WHERE len(words) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS win FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM b2)),
sizes AS (SELECT DISTINCT size FROM b2),
dw AS (SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS win FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, sizes WHERE len(words) >= size)),
h AS (SELECT doc_id, dw.size, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hw AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM (SELECT DISTINCT doc_id, size, i FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
