"""Queries of sources and sinks, signs and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hebrew as H
from ..operators import signs as G
from ..session import WorkDir, table
from ..sources import files as IO
from . import catalogue_queries as K
from .catalogue_queries import WRD
from .search_queries import transcribed
from .statistics_queries import _LINES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ harvest, cache, files
PAGES, PER_PAGE = 7, 20
_HARVEST = f"SELECT i % 90 AS key, page, CAST(page * 1000 + i AS BIGINT) AS value FROM (SELECT i, i // {PER_PAGE} + 1 AS page FROM range({PAGES * PER_PAGE}) t(i)) WHERE page <> 5 QUALIFY row_number() OVER (PARTITION BY i % 90 ORDER BY page DESC, i DESC) = 1"


def _fetch():
    """A source of seven pages, each of which fails once, and the fifth always."""
    failed: set = set()

    def fetch(page: dict) -> list[dict]:
        p = int(page["page"])
        if p == 5 or p not in failed:
            failed.add(p)
            raise OSError("not now")
        return [{"key": i % 90, "value": p * 1000 + i, "error": None} for i in range((p - 1) * PER_PAGE, p * PER_PAGE)]

    return fetch


def _harvested(spark):
    return IO.harvest_pages(spark, _fetch(), PAGES, "key long, value long, error string", "key", tries=3, wait=0.01)


@query(f"SELECT CAST(key AS BIGINT) AS key, CAST(value AS BIGINT) AS value, CAST(page AS INTEGER) AS page, CAST(NULL AS VARCHAR) AS error FROM ({_HARVEST}) UNION ALL SELECT NULL, NULL, NULL, 'OSError: not now'")
def harvested_pages(spark, sf):
    """All pages of a source, with retries; of repeated keys the last one, and a row for the page that failed each time."""
    return _harvested(spark)


@query(f"SELECT count(*) AS unique, CAST(90 AS BIGINT) AS expected, CAST(1 AS BIGINT) AS failed, count(*) <> 90 AS incomplete FROM ({_HARVEST})")
def harvest_warning(spark, sf):
    return IO.harvest_report(_harvested(spark), "key", 90)


@query("SELECT n_nationkey, n_name FROM nation")
def read_through_table(spark, sf):
    """A table made on the first reading and read from its folder on the second."""
    at = WorkDir(spark, "cache").place("nation")
    make = lambda: table(spark, sf, "nation").select("n_nationkey", "n_name")

    def again():
        raise RuntimeError("made twice")

    IO.read_through(spark, at, make)
    return IO.read_through(spark, at, again)


@query("SELECT source, target_share, max_repeats FROM source_targets")
def json_array_round_trip(spark, sf):
    """A file that is one JSON array of records, written from a small fixed table."""
    d = table(spark, sf, "source_targets").select("source", "target_share", "max_repeats")
    at = WorkDir(spark, "json").place("targets")
    one = d.agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*d.columns))), ",\n"), F.lit("]")))  # twelve rows
    one.coalesce(1).write.text(at)
    return IO.read_json_array(spark, at, "source string, target_share double, max_repeats int")


@query(f"WITH {WRD} SELECT sg || ' ' || ref AS ref, string_agg(regexp_replace(scroll_word, '[^א-ת]', '', 'g'), ' ' ORDER BY word_id) FILTER (WHERE regexp_replace(scroll_word, '[^א-ת]', '', 'g') <> '') AS text FROM wrd WHERE ref IS NOT NULL AND scroll_word IS NOT NULL GROUP BY ALL HAVING text IS NOT NULL")
def xml_verses(spark, sf):
    """Verses written as XML with words and notes, and read back without the notes."""
    w = K.words(spark, sf).where("ref is not null and scroll_word is not null")
    g = w.groupBy(F.concat_ws(" ", "sg", "ref").alias("_osisID")).agg(F.array_sort(F.collect_list(F.struct("word_id", "scroll_word"))).alias("a"))
    at = WorkDir(spark, "xml").place("verses")
    g.select("_osisID", F.col("a.scroll_word").alias("w"), F.struct(F.array(F.lit("א note")).alias("w")).alias("note")).write.format("xml").option("rowTag", "verse").option("rootTag", "corpus").save(at)
    return IO.read_verses(spark, at).where("text <> ''")


@query("SELECT vec_id // 4 AS image, CAST((vec_id % 4) // 2 * 8 + (i - 1) // 8 AS INTEGER) AS y, CAST(vec_id % 2 * 8 + (i - 1) % 8 AS INTEGER) AS x, embedding[i] AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE x < 15 AND y < 14")
def stitched_tiles(spark, sf):
    """Vectors as tiles of eight by eight, four to an image of 15 by 14."""
    d = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("image"), F.floor(F.col("vec_id") % 4 / 2).alias("r"), (F.col("vec_id") % 2).alias("c"), "embedding")
    return IO.stitched(d, "image", "r", "c", "embedding", (8, 8), (15, 14))


# ------------------------------------------------------------------ signs
def _signs(spark, sf):
    """Transcribed lines as tables of signs: (rec_id, key, line, word, sign, c, k, after)."""
    d = transcribed(spark, sf).select("rec_id", "key", "line", F.posexplode(H.signs(F.col("text"), F.col("marks"))).alias("sign", "x"), "text", "marks")
    n = F.col("sign")
    blank = lambda c, k: (c == " ") & (k != "#")
    after = F.when(blank(F.substring("text", n + 2, F.lit(1)), F.substring("marks", n + 2, F.lit(1))), " ").otherwise("")
    return d.where(~blank(F.col("x.c"), F.col("x.k"))).select("rec_id", "key", "line", F.lit(0).alias("word"), "sign", F.col("x.c").alias("c"), F.col("x.k").alias("k"), after.alias("after"))


_CHARS = f"{_LINES}, ch AS (SELECT rec_id, k AS key, line, i, substr(text, i, 1) AS c, substr(marks, i, 1) AS m, substr(text, i + 1, 1) = ' ' AND substr(marks, i + 1, 1) NOT IN ('#', '') AS nb FROM (SELECT *, unnest(range(1, least(length(text), length(marks)) + 1)) AS i FROM ln))"
_TAIL = "CASE WHEN nb THEN ' ' ELSE '' END"


@query(
    f"WITH {_CHARS} SELECT rec_id, key, CAST(line AS INTEGER) AS line, rtrim(regexp_replace(string_agg(CASE m WHEN '#' THEN '#' ELSE c END || {_TAIL}, '' ORDER BY i), '#+', '#', 'g')) AS text, rtrim(regexp_replace(string_agg(CASE WHEN m IN ('#', 'p', 'r', 'u') THEN m ELSE '.' END || {_TAIL}, '' ORDER BY i), '#+', '#', 'g')) AS marks FROM ch WHERE NOT (c = ' ' AND m <> '#') GROUP BY rec_id, key, line HAVING trim(string_agg(CASE m WHEN '#' THEN '#' ELSE c END, '')) <> ''"
)
def sign_lines(spark, sf):
    """Lines out of tables of signs: missing signs that follow each other are one, blanks come from the sign before."""
    d = _signs(spark, sf)
    k = F.col("k")
    s = d.select("rec_id", "key", "line", "word", "sign", F.col("c").alias("glyph"), F.when(k == "#", "missing").otherwise("sign").alias("kind"), "after", (k == "p").alias("script"), (k == "r").alias("rec"), (k == "u").alias("unc"))
    return G.lines_of_signs(s, ["rec_id", "key", "line"]).select("rec_id", "key", F.col("line").cast("int").alias("line"), "text", "marks")


@query(f"WITH {_CHARS} SELECT CAST(rec_id AS VARCHAR) || '/' || key AS edition, string_agg(c, '' ORDER BY line, i) AS text FROM ch WHERE regexp_matches(c, '[א-ת]') AND m <> 'r' GROUP BY ALL")
def edition_texts(spark, sf):
    """The letters of an edition that aren't reconstructed, from signs with attributes."""
    d = _signs(spark, sf)
    pair = lambda a, b: F.struct(F.lit(a).alias("kind"), F.lit(b).alias("value"))
    attributes = F.array_compact(F.array(F.when(F.col("c").rlike("^[א-ת]$"), pair("sign_type", "LETTER")), F.when(F.col("k") == "r", pair("is_reconstructed", "TRUE"))))
    s = d.select(F.concat_ws("/", F.col("rec_id").cast("string"), "key").alias("edition"), "line", "sign", F.col("c").alias("letter"), attributes.alias("attributes"))
    return G.edition_text(s, "edition", ["line", "sign"])


@query("SELECT scroll, fragment, loaded_at, CASE WHEN paleo > 0 THEN 'p' WHEN reconstructed > 10 THEN 'r' WHEN uncertain > 5 THEN 'u' ELSE '.' END AS mark FROM fragment_counts")
def mark_precedence(spark, sf):
    """Other script before reconstructed before uncertain before preserved; what isn't known doesn't count."""
    d = table(spark, sf, "fragment_counts")
    return d.select("scroll", "fragment", "loaded_at", H.mark_of(F.col("paleo") > 0, F.col("reconstructed") > 10, F.col("uncertain") > 5).alias("mark"))


@query("SELECT vec_id, abs(embedding[2]) >= 0.5 AND abs(embedding[1]) < 0.2 AS contested FROM embeddings")
def contested_letters(spark, sf):
    """Where another reading is likely and the own one isn't, over vectors taken as probabilities."""
    e = lambda i: F.abs(F.get("embedding", F.lit(i)))
    return table(spark, sf, "embeddings").select("vec_id", G.contested(e(0), e(1)).alias("contested"))


@query(f"WITH {_LINES}, q AS (SELECT rec_id, k AS key, line, trim(regexp_replace(text, ' +', ' ', 'g')) AS label FROM ln), s AS (SELECT *, length(replace(label, ' ', '')) AS n FROM q) SELECT rec_id, key, CAST(line AS INTEGER) AS line, CASE WHEN n > 2 THEN trim(substr(label, a, b - a + 1)) ELSE '' END AS span FROM (SELECT *, list_filter(range(1, length(label) + 1), lambda i: substr(label, i, 1) <> ' ')[2] AS a, list_filter(range(1, length(label) + 1), lambda i: substr(label, i, 1) <> ' ')[n - 1] AS b FROM s)")
def label_spans(spark, sf):
    """Each line without its first and its last letter, as a span over letters taken back to the label."""
    d = transcribed(spark, sf).select("rec_id", "key", "line", F.trim(F.regexp_replace("text", " +", " ")).alias("label"))
    n = F.length(F.translate("label", " ", ""))
    return d.select("rec_id", "key", F.col("line").cast("int").alias("line"), H.label_span(F.col("label"), F.lit(1), n - 1).alias("span"))


@query("SELECT '| name | preserved |' || chr(10) || '|-|-|' || chr(10) || string_agg('| ' || coalesce(replace(name, '|', chr(92) || '|'), '') || ' | ' || coalesce(CAST(preserved AS VARCHAR), '') || ' |', chr(10) ORDER BY preserved DESC NULLS LAST, name) || chr(10) AS report FROM (SELECT name, preserved FROM pairs QUALIFY row_number() OVER (PARTITION BY name ORDER BY loaded_at DESC, rec_id DESC) = 1 ORDER BY preserved DESC NULLS LAST, name LIMIT 20)")
def markdown_report(spark, sf):
    """The top of a ranking as a Markdown table."""
    d = K.pairs(spark, sf).select("name", "preserved").orderBy(F.desc_nulls_last("preserved"), "name")
    return spark.createDataFrame([(G.markdown(d, 20),)], "report string")
