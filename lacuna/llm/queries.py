"""Queries of this subpackage (p2_, p4_ to p8_), with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sigla import letters, plate, siglum
from ..operators.skew import salted_join, spread
from ..session import WorkDir, default_tokenizer, table
from .encode import encode_corpus, token_counts
from .mixture import mix, shares
from .overlap import Overlap
from .readability import reading_levels
from .spans import FingerprintIndex, SharedSpans, chunks_of_texts, chunks_of_words, classes, with_members
from .splits import deal, grouped, torn


def _records(spark: SparkSession, sf: str):
    """Restored lines as (tab, key, batch, text), and the words of scrolls as (tab, key, batch, word, word_id). Batches are years:
    of a line's first delivery, of a word's last one."""
    last = lambda c: F.max_by(c, F.struct("loaded_at", c))
    year = lambda c: F.coalesce(F.year(c), F.lit(0)).alias("batch")
    lines = table(spark, sf, "m9_restore_lines").where("line_key is not null and text is not null").groupBy(F.col("line_key").alias("key"))
    lines = lines.agg(last("text").alias("text"), year(F.min("loaded_at"))).withColumn("tab", F.lit("m9_restore_lines"))
    words = table(spark, sf, "m9_variants").select(siglum(F.col("scroll")).alias("key"), "word_id", F.col("scroll_word").alias("word"), "loaded_at")
    words = words.where("key is not null and key <> '' and word_id is not null and word is not null").groupBy("key", "word_id")
    words = words.agg(last("word").alias("word"), year(F.max("loaded_at"))).withColumn("tab", F.lit("m9_variants"))
    return lines, words


def _spans(spark: SparkSession, sf: str):
    work = WorkDir(spark, "p2")
    lines, words = _records(spark, sf)
    lines = work.save(classes(work.save(lines, "lines")), "classes")
    reps = lines.where("key = rep").select("tab", "key", F.col("first").alias("batch"), "text")
    words = work.save(words, "words")
    chunks = chunks_of_texts(reps).unionByName(chunks_of_words(words, "word_id"))
    index = FingerprintIndex(spark, work.place("index"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return SharedSpans(chunks, work, index), lines, words


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    spans, lines, _ = _spans(spark, sf)
    members = lines.where("copies > 1 and length(text) >= 40").select("tab", "rep", "key")
    return with_members(spans.pairs(), members)


def p2_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each line and scroll stands elsewhere too, in characters and as a share."""
    spans, lines, words = _spans(spark, sf)
    covered = spans.covered()
    n = words.groupBy("tab", "key").agg((F.sum(F.length("word") + 1) - 1).alias("n_chars"))
    of_lines = lines.join(covered.withColumnRenamed("key", "rep"), ["tab", "rep"], "left")
    shared = F.when((F.col("copies") > 1) & (F.length("text") >= 40), F.length("text")).otherwise(F.coalesce("covered", F.lit(0)))
    of_lines = of_lines.select("tab", "key", F.length("text").cast("long").alias("n_chars"), shared.cast("long").alias("shared"))
    of_words = n.join(covered, ["tab", "key"], "left").select("tab", "key", "n_chars", F.coalesce("covered", F.lit(0)).alias("shared"))
    out = of_lines.unionByName(of_words)
    return out.withColumn("share", F.round(F.coalesce(F.try_divide("shared", "n_chars"), F.lit(0.0)), 6))


def _groups(spark: SparkSession, sf: str):
    return grouped(table(spark, sf, "pairs"), "rec_id", siglum(F.col("manuscript")), plate(F.col("plate")), WorkDir(spark, "p4"), ["split"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _groups(spark, sf)
    out = salted_join(rows.where("root is not null").select("rec_id", "root"), torn(rows, "split"), ["root"], ["rec_id"], "inner")
    return out.select("rec_id", F.col("first_min").alias("group_ms"))


def p4_splits(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _groups(spark, sf)
    return deal(rows, "rec_id", {"train": 0.8, "val": 0.1, "test": 0.1}, WorkDir(spark, "p4")).select("rec_id", "split")


def p4_check(spark: SparkSession, sf: str) -> DataFrame:
    """What the splits must keep: no manuscript or plate, in normal form, in two splits, and shares within 1 % of all rows."""
    d = table(spark, sf, "pairs").select("rec_id", siglum(F.col("manuscript")).alias("manuscript"), plate(F.col("plate")).alias("plate")).join(p4_splits(spark, sf), "rec_id")
    rows = d.groupBy("split").agg(F.count("*").alias("n"))

    def torn_by(c: str) -> DataFrame:
        g = d.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
        return g.agg(F.lit(c).alias("by"), F.count("*").alias("things"), F.count_if(F.col("lo") != F.col("hi")).alias("wrong"))

    want = F.when(F.col("split") == "train", 0.8).otherwise(0.1)
    off = rows.crossJoin(rows.agg(F.sum("n").alias("total"))).agg(F.lit("split").alias("by"), F.sum("n").alias("things"), F.count_if(F.abs(F.col("n") / F.col("total") - want) > 0.01).alias("wrong"))  # three rows
    return torn_by("manuscript").unionByName(torn_by("plate")).unionByName(off)


def p4_forest(spark: SparkSession, sf: str) -> DataFrame:
    """The spanning forest's edges: manuscript, plate and the round in which the edge was chosen."""
    edges = _groups(spark, sf)[1].edges
    if edges is None:
        return spark.createDataFrame([], "manuscript string, plate string, round int")
    return edges.select(F.substring("a", 3, 1 << 30).alias("manuscript"), F.substring("b", 3, 1 << 30).alias("plate"), "round")


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """(rec_id, split, source, siglum, frag) of each complete link."""
    d = table(spark, sf, "pairs").select("rec_id", "split", F.explode("links").alias("l"))
    part = lambda i: F.get(F.col("l.etcbc"), F.lit(i))
    return d.select("rec_id", "split", F.col("l.source").alias("source"), siglum(part(0)).alias("siglum"), part(1).alias("frag")).where("siglum is not null and frag is not null")


def _overlap(spark: SparkSession, sf: str) -> Overlap:
    rows = _links(spark, sf).withColumnRenamed("rec_id", "key")
    texts = table(spark, sf, "m9_restore_lines").select(siglum(F.col("scroll")).alias("siglum"), "frag", letters(F.col("text")).alias("letters"))
    return Overlap(rows, texts.where("siglum is not null and frag is not null"), ["siglum", "frag"], WorkDir(spark, "p5"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    out = _overlap(spark, sf).pairs()
    return out.select(F.least("train_key", "eval_key").alias("rec_a"), F.greatest("train_key", "eval_key").alias("rec_b"))


def p5_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct lines of val and test rows by split and the source of their links: how many match a line of a train row, the
    pairs of matching lines, and how many letters stand in merged maximal matches."""
    links = _links(spark, sf).where("split in ('val', 'test')").select("split", "source", "siglum", "frag").distinct()
    d = salted_join(_overlap(spark, sf).spans(), links, ["siglum", "frag"], ["letters"], "inner")
    d = d.groupBy("split", "source", "letters").agg(F.first("matches").alias("matches"), F.first("covered").alias("covered"))  # a text's are the same at all places
    return d.groupBy("split", "source").agg(
        F.count("*").alias("lines"), F.count_if(F.col("matches") > 0).alias("matched"), F.sum("matches").alias("pairs"), F.sum(F.length("letters")).alias("letters"), F.sum("covered").alias("covered")
    )


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Val and test rows that overlap with a train row, and all of them, by split and the source of their complete links."""
    links = _links(spark, sf).where("split in ('val', 'test')").select("rec_id", "split", "source").distinct()
    found = p5_found(spark, sf)
    hit = found.select(F.col("rec_a").alias("rec_id")).unionByName(found.select(F.col("rec_b").alias("rec_id"))).distinct().withColumn("hit", F.lit(1))
    return links.join(hit, "rec_id", "left").groupBy("split", "source").agg(F.count("*").alias("rows"), F.count("hit").alias("overlapping"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(spread(table(spark, sf, "documents").select("doc_id", "text")), default_tokenizer())


def _mixed(spark: SparkSession, sf: str, **how):
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return mix(docs, table(spark, sf, "source_targets"), default_tokenizer(), WorkDir(spark, "p7"), **how)


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return shares(*_mixed(spark, sf))


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """What the draw must keep: each source within half a document of its budget, and no document used too often."""
    drawn, plans = _mixed(spark, sf)
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    longest = token_counts(docs, default_tokenizer(), ["doc_id", "source"]).groupBy("source").agg(F.max("n_tokens").alias("longest"))
    d = drawn.groupBy("source").agg(F.sum("n_tokens").alias("drawn")).join(longest, "source", "right")
    times = drawn.groupBy("source", "doc_id").agg(F.count("*").alias("times")).groupBy("source").agg(F.max("times").alias("times"))
    by = spark.createDataFrame([(p.source, p.budget, p.cap) for p in plans], "source string, budget double, cap int")
    d = by.join(d, "source", "left").join(times, "source", "left").fillna(0)
    return d.select("source", (F.abs(F.col("drawn") - F.col("budget")) <= F.greatest(F.col("longest"), F.lit(1)) / 2 + 1).alias("share_kept"), (F.col("times") <= F.col("cap")).alias("cap_kept"))


def p7_tempered(spark: SparkSession, sf: str) -> DataFrame:
    """The sources' own sizes, tempered to an entropy half-way to that of even shares; no document used too often."""
    return _mixed(spark, sf, flatten=0.5)[0]


def p7_tempered_shares(spark: SparkSession, sf: str) -> DataFrame:
    return shares(*_mixed(spark, sf, flatten=0.5))


def p7_stretched_shares(spark: SparkSession, sf: str) -> DataFrame:
    """More tokens than the targets allow, half-way to all sources with all repeats: shares as near the targets as can be."""
    return shares(*_mixed(spark, sf, stretch=0.5))


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return reading_levels(docs, table(spark, sf, "level_anchors"), WorkDir(spark, "p8"), label="lang")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).where("english and n_words >= 40 and level >= 4").select("doc_id")


def p8_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf)


def p8_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by source and level; documents that aren't English have level 0."""
    d = _levels(spark, sf).select("doc_id", F.when(F.col("english"), F.coalesce("level", F.lit(0))).otherwise(0).alias("level"))
    src = table(spark, sf, "documents").select("doc_id", "source")
    return src.join(d, "doc_id").groupBy("source", "level").agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_coverage, p4_found, p4_splits, p4_check, p4_forest, p5_found, p5_report, p5_spans, p6_ids, p7_mix, p7_shares, p7_check, p7_tempered, p7_tempered_shares, p7_stretched_shares, p8_found, p8_levels, p8_profile)}

SIGLUM = "regexp_replace(upper(replace(regexp_replace({0}, '[\\s.^]', '', 'g'), '_', '-')), '-[0-9]+$', '')"
PLATE = "regexp_replace(lower(trim({0})), '/(rec|vrs)$', '')"

_RECORDS = f"""recs AS (
    SELECT 'm9_restore_lines' AS tab, line_key AS key, arg_max(text, loaded_at) AS text FROM m9_restore_lines WHERE text IS NOT NULL GROUP BY line_key
    UNION ALL SELECT 'm9_variants', key, string_agg(word, ' ' ORDER BY word_id) FROM (SELECT DISTINCT {SIGLUM.format("scroll")} AS key, word_id, scroll_word AS word FROM m9_variants WHERE scroll IS NOT NULL) GROUP BY key),
    wins AS (SELECT tab, key, i, substr(text, i, 40) AS w FROM (SELECT tab, key, text, unnest(range(1, length(text) - 38)) AS i FROM recs WHERE length(text) >= 40)),
    hot AS (SELECT tab, w FROM wins GROUP BY tab, w HAVING count(DISTINCT key) > 1)"""

# DuckDB's edit distance counts bytes, so Hebrew letters are first mapped to single bytes
_LETTERS = "translate(regexp_replace(text, '\\s', '', 'g'), 'אבגדהוזחטיךכלםמןנסעףפץצקרשת', 'abcdefghijklmnopqrstuvwxyzA')"
_P5 = f"""WITH li AS (SELECT rec_id, split, {SIGLUM.format("l.etcbc[1]")} AS sg, l.etcbc[2] AS fr, l.source AS source FROM (SELECT rec_id, split, unnest(links) AS l FROM pairs) WHERE l.etcbc[1] IS NOT NULL AND l.etcbc[2] IS NOT NULL),
    tx AS (SELECT DISTINCT {SIGLUM.format("scroll")} AS sg, frag AS fr, {_LETTERS} AS t FROM m9_restore_lines WHERE length({_LETTERS}) >= 20),
    rt AS (SELECT DISTINCT rec_id, split, t FROM li JOIN tx USING (sg, fr)),
    ta AS (SELECT DISTINCT t FROM rt WHERE split = 'train'), tb AS (SELECT DISTINCT t FROM rt WHERE split IN ('val', 'test')),
    tm AS (SELECT ta.t AS a, tb.t AS b FROM ta JOIN tb ON abs(length(ta.t) - length(tb.t)) * 10 <= greatest(length(ta.t), length(tb.t)) AND levenshtein(ta.t, tb.t) * 10 <= greatest(length(ta.t), length(tb.t))),
    found AS (SELECT DISTINCT least(x.rec_id, y.rec_id) AS rec_a, greatest(x.rec_id, y.rec_id) AS rec_b FROM tm JOIN rt x ON x.t = tm.a AND x.split = 'train' JOIN rt y ON y.t = tm.b AND y.split IN ('val', 'test'))"""

SQL: dict[str, str] = {
    "p2_found": f"WITH {_RECORDS} SELECT DISTINCT a.tab AS tab, a.key AS key_a, b.key AS key_b FROM wins a JOIN hot USING (tab, w) JOIN wins b ON a.tab = b.tab AND a.w = b.w AND a.key < b.key",
    "p2_coverage": f"""WITH {_RECORDS}, cov AS (SELECT tab, key, count(DISTINCT p) AS n FROM (SELECT tab, key, unnest(range(i, i + 40)) AS p FROM wins JOIN hot USING (tab, w)) GROUP BY tab, key)
        SELECT recs.tab AS tab, recs.key AS key, CAST(length(text) AS BIGINT) AS n_chars, coalesce(n, 0) AS shared, round(coalesce(coalesce(n, 0) / nullif(length(text), 0), 0.0), 6) AS share FROM recs LEFT JOIN cov ON recs.tab = cov.tab AND recs.key = cov.key""",
    "p4_check": f"""SELECT 'manuscript' AS by, count(DISTINCT {SIGLUM.format("manuscript")}) AS things, 0 AS wrong FROM pairs UNION ALL SELECT 'plate', count(DISTINCT {PLATE.format("plate")}), 0 FROM pairs
        UNION ALL SELECT 'split', count(*), 0 FROM pairs""",
    "p7_check": "SELECT DISTINCT source, true AS share_kept, true AS cap_kept FROM source_targets WHERE source IS NOT NULL",
    "p5_found": _P5 + " SELECT rec_a, rec_b FROM found",
    "p5_report": _P5 + """, hit AS (SELECT rec_a AS rec_id FROM found UNION SELECT rec_b FROM found)
        SELECT split, source, count(*) AS rows, count(hit.rec_id) AS overlapping FROM (SELECT DISTINCT rec_id, split, source FROM li WHERE split IN ('val', 'test')) l LEFT JOIN hit USING (rec_id) GROUP BY split, source""",
    "p4_found": f"""WITH RECURSIVE r AS (SELECT rec_id, split, 'a:' || {SIGLUM.format("manuscript")} AS a, 'b:' || {PLATE.format("plate")} AS b FROM pairs),
        e AS (SELECT DISTINCT a AS x, b AS y FROM r WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT DISTINCT b, a FROM r WHERE a IS NOT NULL AND b IS NOT NULL),
        reach(x, y) AS (SELECT a, a FROM r WHERE a IS NOT NULL UNION SELECT b, b FROM r WHERE b IS NOT NULL UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
        root AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
        g AS (SELECT rec_id, split, a, root FROM r JOIN root ON root.x = coalesce(r.a, r.b)),
        t AS (SELECT root, min(a) AS a FROM g GROUP BY root HAVING count(DISTINCT split) > 1)
        SELECT g.rec_id AS rec_id, substr(t.a, 3) AS group_ms FROM g JOIN t USING (root)""",
}
