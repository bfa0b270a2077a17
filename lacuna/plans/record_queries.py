"""Queries on nested records and references between tables (p1_, p3_), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sigla import siglum
from ..operators.nested import flatten_nested
from ..operators.references import judged
from ..session import WorkDir, table


_FIELDS = {"inventory_images": ["text_fragments"], "pairs": ["links", "lines"]}


def _flat(spark: SparkSession, sf: str, name: str, keep: list[str] | None = None):
    """The flat tables of one input table: all of them, written in one pass, or only one that is asked for."""
    d = flatten_nested(table(spark, sf, name), "rec_id", _FIELDS[name], keep)
    return d.written(WorkDir(spark, "p1"), name) if len(d.tables) > 1 else d


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Both inputs taken apart into all their tables, with all columns; of these the places of the elements of three."""
    images = _flat(spark, sf, "inventory_images")
    pairs = _flat(spark, sf, "pairs")

    def keys(flat, tag: str) -> DataFrame:
        return flat.table(tag).select(F.col("root_key").alias("rec_id"), F.lit(tag).alias("path"), "map_key", "pos")

    return keys(images, "text_fragments").unionByName(keys(pairs, "links")).unionByName(keys(pairs, "lines"))


def p1_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """The child table of text fragments, with its parent's key and its scalar columns."""
    images = _flat(spark, sf, "inventory_images", ["text_fragments"])
    return images.table("text_fragments").select(
        F.col("root_key").alias("rec_id"), "key", "parent_key", "pos", "edition", "edition_name", "text_fragment", "tf_name", "confirmed", "link", "preserved", "certain", "lines"
    )


def p1_etcbc(spark: SparkSession, sf: str) -> DataFrame:
    """Grandchildren: the parts of each etcbc, linked to their fragment or link."""
    out = [
        _flat(spark, sf, name, [tag]).table(tag).select(F.col("root_key").alias("rec_id"), F.lit(tag).alias("path"), "key", "parent_key", "pos", "value")
        for name, tag in (("inventory_images", "text_fragments.etcbc"), ("pairs", "links.etcbc"))
    ]
    return out[0].unionByName(out[1])


def p1_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The child table of the map of lines: its key is kept as map_key."""
    return _flat(spark, sf, "pairs", ["lines"]).table("lines").select(F.col("root_key").alias("rec_id"), "map_key", "pos", "line", "text", "marks")


def _references(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each reference: tab, rec_id, pos, field, id (integer keys) or siglum and label, loaded_at."""
    images = table(spark, sf, "inventory_images").select("rec_id", "loaded_at", F.posexplode("text_fragments").alias("pos", "e")).where("e is not null")
    pairs = table(spark, sf, "pairs").select("rec_id", "loaded_at", F.posexplode("links").alias("pos", "e")).where("e is not null")
    part = lambda i: F.get(F.col("e.etcbc"), F.lit(i))
    none_s, none_l = F.lit(None).cast("string"), F.lit(None).cast("long")

    def ref(field: str, i, a, b):
        return F.struct(F.lit(field).alias("field"), i.alias("id"), siglum(a).alias("siglum"), b.alias("label"))

    def rows(d: DataFrame, tab: str, *refs) -> DataFrame:
        return d.select(F.lit(tab).alias("tab"), "rec_id", "pos", "loaded_at", F.inline(F.array(*refs)))

    etcbc = ref("etcbc", none_l, F.when(part(1).isNotNull(), part(0)), part(1))
    return rows(
        images,
        "inventory_images",
        ref("edition", F.col("e.edition").cast("long"), none_s, none_s),
        ref("text_fragment", F.col("e.text_fragment").cast("long"), none_s, none_s),
        etcbc,
    ).unionByName(rows(pairs, "pairs", etcbc))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """All references that refer to something, with the reason if they find nothing in force."""
    refs = _references(spark, sf)
    span = ["loaded_at", "deleted_at"]
    ints = (
        table(spark, sf, "editions")
        .select(F.lit("edition").alias("field"), "id", *span)
        .unionByName(table(spark, sf, "text_fragments").select(F.lit("text_fragment").alias("field"), "id", *span))
    )
    counts = table(spark, sf, "fragment_counts").select(siglum(F.col("scroll")).alias("siglum"), F.col("fragment").alias("label"), *span)
    apart = ["tab", "rec_id", "pos"]
    keep = [*apart, "field", "loaded_at", "reason"]
    by_id = judged(refs.where("field <> 'etcbc'").drop("siglum", "label"), ints, ["field", "id"], "loaded_at", apart, integer_key="id")
    by_name = judged(refs.where("field = 'etcbc'").drop("id"), counts, ["siglum", "label"], "loaded_at", apart)
    return by_id.select(*keep).unionByName(by_name.select(*keep))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).where("reason is not null").select("tab", "rec_id", "pos", "field", "reason")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """References and orphans by table, month of delivery and field."""
    by = ["tab", F.date_format("loaded_at", "yyyy-MM").alias("month"), "field"]
    return _judged(spark, sf).groupBy(*by).agg(F.count("*").alias("refs"), *[F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(r) for r in ("missing", "late", "deleted")])


QUERIES = {f.__name__: f for f in (p1_found, p1_fragments, p1_etcbc, p1_lines, p3_found, p3_report)}

#: The normal form of a siglum, in DuckDB.
SIGLUM = "regexp_replace(upper(replace(regexp_replace({0}, '[\\s.^]', '', 'g'), '_', '-')), '-[0-9]+$', '')"
PLATE = "regexp_replace(lower(trim({0})), '/(rec|vrs)$', '')"

_TF = "(SELECT rec_id, loaded_at, i, text_fragments[i] AS e FROM (SELECT rec_id, loaded_at, text_fragments, unnest(range(1, len(text_fragments) + 1)) AS i FROM inventory_images) WHERE text_fragments[i] IS NOT NULL)"
_LK = "(SELECT rec_id, loaded_at, i, links[i] AS e FROM (SELECT rec_id, loaded_at, links, unnest(range(1, len(links) + 1)) AS i FROM pairs) WHERE links[i] IS NOT NULL)"
_LN = "(SELECT rec_id, k, i, v[i] AS e FROM (SELECT rec_id, k, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT rec_id, m.key AS k, m.value AS v FROM (SELECT rec_id, unnest(map_entries(lines)) AS m FROM pairs))) WHERE v[i] IS NOT NULL)"

_REFS = f"""
refs AS (
  SELECT 'inventory_images' AS tab, rec_id, CAST(i - 1 AS INTEGER) AS pos, loaded_at, 'edition' AS field, e.edition AS id, NULL AS sg, NULL AS lb FROM {_TF} WHERE e.edition IS NOT NULL
  UNION ALL SELECT 'inventory_images', rec_id, CAST(i - 1 AS INTEGER), loaded_at, 'text_fragment', e.text_fragment, NULL, NULL FROM {_TF} WHERE e.text_fragment IS NOT NULL
  UNION ALL SELECT 'inventory_images', rec_id, CAST(i - 1 AS INTEGER), loaded_at, 'etcbc', NULL, {SIGLUM.format("e.etcbc[1]")}, e.etcbc[2] FROM {_TF} WHERE e.etcbc[1] IS NOT NULL AND e.etcbc[2] IS NOT NULL
  UNION ALL SELECT 'pairs', rec_id, CAST(i - 1 AS INTEGER), loaded_at, 'etcbc', NULL, {SIGLUM.format("e.etcbc[1]")}, e.etcbc[2] FROM {_LK} WHERE e.etcbc[1] IS NOT NULL AND e.etcbc[2] IS NOT NULL
),
parents AS (
  SELECT 'edition' AS field, id, NULL AS sg, NULL AS lb, loaded_at, deleted_at FROM editions WHERE id IS NOT NULL
  UNION ALL SELECT 'text_fragment', id, NULL, NULL, loaded_at, deleted_at FROM text_fragments WHERE id IS NOT NULL
  UNION ALL SELECT 'etcbc', NULL, {SIGLUM.format("scroll")}, fragment, loaded_at, deleted_at FROM fragment_counts WHERE scroll IS NOT NULL AND fragment IS NOT NULL
),
judged AS (
  SELECT r.tab, r.rec_id, r.pos, r.field, r.loaded_at,
    count(p.field) AS n,
    count(*) FILTER (WHERE p.loaded_at <= r.loaded_at AND (p.deleted_at IS NULL OR p.deleted_at > r.loaded_at)) AS live,
    count(*) FILTER (WHERE p.loaded_at > r.loaded_at) AS later
  FROM refs r LEFT JOIN parents p ON p.field = r.field AND coalesce(p.id, -1) = coalesce(r.id, -1) AND coalesce(p.sg, '') = coalesce(r.sg, '') AND coalesce(p.lb, '') = coalesce(r.lb, '')
  GROUP BY r.tab, r.rec_id, r.pos, r.field, r.loaded_at
)"""

_P3 = f"WITH {_REFS} SELECT tab, rec_id, pos, field, CASE WHEN n = 0 THEN 'missing' WHEN later = n THEN 'late' ELSE 'deleted' END AS reason FROM judged WHERE live = 0"

SQL = {
    "p1_found": f"""SELECT rec_id, 'text_fragments' AS path, '' AS map_key, CAST(i - 1 AS INTEGER) AS pos FROM {_TF}
        UNION ALL SELECT rec_id, 'links', '', CAST(i - 1 AS INTEGER) FROM {_LK} UNION ALL SELECT rec_id, 'lines', k, CAST(i - 1 AS INTEGER) FROM {_LN}""",
    "p1_fragments": f"""SELECT rec_id, CAST(rec_id AS VARCHAR) || '/text_fragments:' || CAST(i - 1 AS VARCHAR) AS key, CAST(rec_id AS VARCHAR) AS parent_key, CAST(i - 1 AS INTEGER) AS pos,
        e.edition AS edition, e.edition_name AS edition_name, e.text_fragment AS text_fragment, e.tf_name AS tf_name, e.confirmed AS confirmed, e.link AS link, e.preserved AS preserved, e.certain AS certain, e.lines AS lines FROM {_TF}""",
    "p1_etcbc": " UNION ALL ".join(
        f"""SELECT rec_id, '{n}.etcbc' AS path, CAST(rec_id AS VARCHAR) || '/{n}:' || CAST(i - 1 AS VARCHAR) || '/etcbc:' || CAST(j - 1 AS VARCHAR) AS key, CAST(rec_id AS VARCHAR) || '/{n}:' || CAST(i - 1 AS VARCHAR) AS parent_key,
        CAST(j - 1 AS INTEGER) AS pos, e.etcbc[j] AS value FROM (SELECT rec_id, i, e, unnest(range(1, len(e.etcbc) + 1)) AS j FROM {src}) WHERE e.etcbc[j] IS NOT NULL"""
        for n, src in (("text_fragments", _TF), ("links", _LK))
    ),
    "p1_lines": f"SELECT rec_id, k AS map_key, CAST(i - 1 AS INTEGER) AS pos, e.line AS line, e.text AS text, e.marks AS marks FROM {_LN}",
    "p3_found": _P3,
    "p3_report": f"""WITH {_REFS} SELECT tab, strftime(loaded_at, '%Y-%m') AS month, field, count(*) AS refs, count(*) FILTER (WHERE live = 0 AND n = 0) AS missing,
        count(*) FILTER (WHERE live = 0 AND n > 0 AND later = n) AS late, count(*) FILTER (WHERE live = 0 AND n > 0 AND later <> n) AS deleted FROM judged GROUP BY ALL""",
}
