"""Queries of catalogue linkage: normal forms, joins, set operators and classifiers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hebrew as H
from ..functions import labels as L
from ..functions.sigla import aliased, siglum
from ..operators import relational as R
from ..session import table
from .record_queries import SIGLUM

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ sources of the queries
def images(spark: SparkSession, sf: str) -> DataFrame:
    """The last delivery of each image."""
    return R.latest(table(spark, sf, "inventory_images"), ["name"], ["loaded_at", "rec_id"])


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest(table(spark, sf, "pairs"), ["name"], ["loaded_at", "rec_id"])


def manuscripts(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest(table(spark, sf, "manuscripts"), ["manuscript_number"], ["loaded_at", "manuscript_id"])


def counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "fragment_counts").withColumn("sg", siglum(F.col("scroll")))
    return R.latest(d, ["sg", "fragment"], ["loaded_at", "lines", "preserved", "certain", "uncertain", "reconstructed", "paleo", "aramaic", "scroll"])


def links(d: DataFrame, *keep: str) -> DataFrame:
    """Complete links, once for each place: (keep..., sg, label, link, source, confirmed)."""
    e = d.select(*keep, F.posexplode("links").alias("pos", "l")).where("l is not null")
    sg = siglum(F.get("l.etcbc", F.lit(0)))
    e = e.select(*keep, "pos", sg.alias("sg"), F.get("l.etcbc", F.lit(1)).alias("label"), "l.link", "l.source", "l.confirmed")
    return e.where("sg is not null and label is not null")


IMG = "img AS (SELECT * FROM inventory_images QUALIFY row_number() OVER (PARTITION BY name ORDER BY loaded_at DESC, rec_id DESC) = 1)"
PRS = "prs AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY name ORDER BY loaded_at DESC, rec_id DESC) = 1)"
MSS = "mss AS (SELECT * FROM manuscripts QUALIFY row_number() OVER (PARTITION BY manuscript_number ORDER BY loaded_at DESC, manuscript_id DESC) = 1)"
CNT = f"cnt AS (SELECT *, {SIGLUM.format('scroll')} AS sg FROM fragment_counts QUALIFY row_number() OVER (PARTITION BY {SIGLUM.format('scroll')}, fragment ORDER BY loaded_at DESC, lines DESC, preserved DESC, certain DESC, uncertain DESC, reconstructed DESC, paleo DESC, aramaic DESC, scroll DESC) = 1)"
LNK = f"lnk AS (SELECT rec_id, name, manuscript, plate, frag, side, split, pos, {SIGLUM.format('l.etcbc[1]')} AS sg, l.etcbc[2] AS label, l.link AS link, l.source AS source, l.confirmed AS confirmed FROM (SELECT rec_id, name, manuscript, plate, frag, side, split, i - 1 AS pos, links[i] AS l FROM (SELECT *, unnest(range(1, len(links) + 1)) AS i FROM prs)) WHERE l IS NOT NULL AND l.etcbc[1] IS NOT NULL AND l.etcbc[2] IS NOT NULL)"
BASE = "CASE WHEN regexp_full_match({0}, '[0-9]+Q[0-9]+[a-z]*-[0-9]+') THEN regexp_extract({0}, '^([0-9]+Q[0-9]+[a-z]*)-[0-9]+$', 1) ELSE {0} END"
PKEY = "lower(ltrim(regexp_replace(trim(coalesce({0}, '')), '/(Rec|Vrs)$', ''), '*'))"


def SG(c: str) -> str:
    return SIGLUM.format(c)


LINKTYPE = "CASE WHEN x = y THEN 'exact' WHEN starts_with(y, x) AND regexp_full_match(substr(y, length(x) + 1), '[A-Z]{1,2}') THEN 'subsiglum' END"


# ------------------------------------------------------------------ normal forms and labels
@query(f"SELECT rec_id, {SG(BASE.format('manuscript'))} AS ms, {PKEY.format('plate')} AS plate_key FROM pairs")
def siglum_keys(spark, sf):
    return table(spark, sf, "pairs").select("rec_id", siglum(L.base_siglum(F.col("manuscript"))).alias("ms"), L.plate_key(F.col("plate")).alias("plate_key"))


@query("SELECT id, regexp_replace(regexp_replace(regexp_replace(trim(name), '^frg\\.\\s*', 'f'), '^col\\.\\s*', ''), '\\s', '', 'g') AS label FROM text_fragments")
def fragment_labels(spark, sf):
    return table(spark, sf, "text_fragments").select("id", L.fragment_label(F.col("name")).alias("label"))


@query(
    f"WITH {MSS}, k AS (SELECT DISTINCT manuscript AS number FROM pairs WHERE manuscript IS NOT NULL UNION SELECT manuscript_number FROM mss WHERE manuscript_number IS NOT NULL) SELECT number AS manuscript_number, CASE WHEN m.manuscript_number IS NULL THEN 'no record' WHEN coalesce(script_type, '') NOT IN ('', 'Square') THEN 'excluded: ' || script_type || ' script' WHEN coalesce(script_language, '') NOT IN ('Hebrew', 'Aramaic', 'Hebrew?', 'Aramaic?') THEN 'excluded: language ''' || coalesce(script_language, '') || '''' WHEN script_type = 'Square' THEN 'square' ELSE 'script type blank' END AS status FROM k LEFT JOIN mss m ON m.manuscript_number = number"
)
def manuscript_statuses(spark, sf):
    """Of all manuscripts that the catalogue or a record names, whether they are in and why not."""
    m = manuscripts(spark, sf).where("manuscript_number is not null").withColumn("known", F.lit(True))
    named = table(spark, sf, "pairs").where("manuscript is not null").select(F.col("manuscript").alias("manuscript_number")).unionByName(m.select("manuscript_number")).distinct()
    d = named.join(m, "manuscript_number", "left")
    return d.select("manuscript_number", L.manuscript_status(F.col("script_type"), F.col("script_language"), F.coalesce("known", F.lit(False))).alias("status"))


@query(f"WITH a AS (SELECT DISTINCT scroll, {SG('scroll')} AS sg FROM m9_variants WHERE scroll IS NOT NULL) SELECT scroll, CASE WHEN sg = (SELECT min({SG('scroll')}) FROM m9_variants) THEN 'FIRST' ELSE sg END AS siglum FROM a")
def siglum_aliases(spark, sf):
    """Sigla by their usual names: a small table of aliases, here of the first one."""
    d = table(spark, sf, "m9_variants").where("scroll is not null").select("scroll").distinct()
    first = d.agg(F.min(siglum(F.col("scroll")))).first()[0]
    return d.select("scroll", aliased(F.col("scroll"), {first: "FIRST"} if first is not None else {}).alias("siglum"))


@query("SELECT line_key, loaded_at, CASE WHEN scroll IS NOT NULL AND frag IS NOT NULL THEN scroll END AS scroll, CASE WHEN scroll IS NOT NULL AND frag IS NOT NULL THEN frag END AS fragment FROM (SELECT line_key, loaded_at, replace(scroll, ' ', '') AS scroll, split_part(frag, ':', 1) AS frag FROM m9_restore_lines)")
def hit_places(spark, sf):
    """Scroll and fragment out of places like '4Q58 3:18'."""
    d = table(spark, sf, "m9_restore_lines").select("line_key", "loaded_at", F.concat(F.translate("scroll", " ", ""), F.lit(" "), "frag", F.lit(":"), F.coalesce("line", F.lit(""))).alias("ref"))
    return d.withColumn("p", L.hit_parts(F.col("ref"))).select("line_key", "loaded_at", "p.scroll", "p.fragment")


@query(
    "SELECT DISTINCT fragment AS label, list_sort(list_distinct(flatten(list_transform(string_split(replace(fragment, 'f', ''), '+'), lambda p: CASE WHEN contains(p, '_') AND len(regexp_extract_all(p, '[0-9]+')) = 2 AND CAST(regexp_extract_all(p, '[0-9]+')[2] AS INTEGER) - CAST(regexp_extract_all(p, '[0-9]+')[1] AS INTEGER) BETWEEN 0 AND 49 THEN list_transform(range(CAST(regexp_extract_all(p, '[0-9]+')[1] AS INTEGER), CAST(regexp_extract_all(p, '[0-9]+')[2] AS INTEGER) + 1), lambda x: CAST(x AS INTEGER)) ELSE list_transform(regexp_extract_all(p, '[0-9]+'), lambda x: CAST(x AS INTEGER)) END)))) AS numbers FROM fragment_counts WHERE fragment IS NOT NULL"
)
def fragment_numbers(spark, sf):
    d = table(spark, sf, "fragment_counts").where("fragment is not null").select(F.col("fragment").alias("label")).distinct()
    return d.select("label", L.fragment_numbers(F.col("label")).alias("numbers"))


@query(
    "SELECT DISTINCT fragment AS label, CASE WHEN regexp_matches(fragment, '^f?[0-9]+[a-z]?(i{1,3}|iv|v|vi{0,3})$') THEN regexp_extract(fragment, '^(f?[0-9]+[a-z]?)(i{1,3}|iv|v|vi{0,3})$', 1) END AS base, regexp_matches(fragment, '^[0-9]+[a-z]?$') OR regexp_matches(fragment, '[_+]') AS assembly FROM fragment_counts WHERE fragment IS NOT NULL"
)
def label_classes(spark, sf):
    d = table(spark, sf, "fragment_counts").where("fragment is not null").select(F.col("fragment").alias("label")).distinct()
    return d.select("label", L.column_base(F.col("label")).alias("base"), L.is_assembly(F.col("label")).alias("assembly"))


@query("SELECT line_key, loaded_at, CASE WHEN regexp_matches(scroll, '^[0-9]+Q') THEN regexp_extract(scroll, '^([0-9]+)Q', 1) || 'Q' WHEN starts_with(upper(scroll), 'PAM') THEN '4Q' END AS cave, CASE WHEN regexp_matches(line, '^[0-9]') THEN CAST(regexp_extract(line, '^([0-9]+)', 1) AS INTEGER) END AS number FROM m9_restore_lines")
def key_parts(spark, sf):
    return table(spark, sf, "m9_restore_lines").select("line_key", "loaded_at", L.cave(F.col("scroll")).alias("cave"), L.line_number(F.col("line")).alias("number"))


@query(
    f"WITH {MSS} SELECT rec_id, coalesce(m.composition_type = 'Unidentified Text', false) OR coalesce(regexp_full_match(p.manuscript, '[0-9]+Q9999'), false) AS target FROM pairs p LEFT JOIN mss m ON m.manuscript_number = p.manuscript"
)
def target_flags(spark, sf):
    m = manuscripts(spark, sf).select(F.col("manuscript_number").alias("manuscript"), "composition_type")
    return table(spark, sf, "pairs").select("rec_id", "manuscript").join(R.small(m), "manuscript", "left").select("rec_id", L.is_target(F.col("manuscript"), F.col("composition_type")).alias("target"))


@query(
    "WITH v AS (SELECT word_id, any_value(scroll) AS scroll, any_value(ref) AS ref FROM m9_variants WHERE scroll IS NOT NULL AND ref IS NOT NULL GROUP BY word_id), p AS (SELECT a.word_id AS word_id, a.ref AS a, b.ref AS b FROM v a JOIN v b ON b.word_id = a.word_id + 1) SELECT word_id, CASE WHEN split_part(a, '.', 1) || '.' || split_part(a, '.', 2) = split_part(b, '.', 1) || '.' || split_part(b, '.', 2) THEN abs(CAST(split_part(a, '.', 3) AS INTEGER) - CAST(split_part(b, '.', 3) AS INTEGER)) <= 3 ELSE false END AS same FROM p"
)
def same_places(spark, sf):
    """Consecutive words, and whether their references are the same passage."""
    v = table(spark, sf, "m9_variants").where("scroll is not null and ref is not null").groupBy("word_id").agg(F.min("ref").alias("ref"))
    nxt = v.select((F.col("word_id") - 1).alias("word_id"), F.col("ref").alias("b"))
    return v.join(nxt, "word_id").select("word_id", L.same_place(F.col("ref"), F.col("b")).alias("same"))


@query("SELECT rec_id, CASE WHEN preserved BETWEEN 1 AND 9 THEN '1-9' WHEN preserved BETWEEN 10 AND 19 THEN '10-19' WHEN preserved BETWEEN 20 AND 39 THEN '20-39' WHEN preserved >= 40 THEN '40+' END AS band, CAST(CASE WHEN preserved BETWEEN 1 AND 9 THEN 17.7 WHEN preserved BETWEEN 10 AND 19 THEN 25.5 WHEN preserved BETWEEN 20 AND 39 THEN 39.7 WHEN preserved >= 40 THEN 44.9 END AS DOUBLE) AS threshold FROM pairs")
def bands_thresholds(spark, sf):
    return table(spark, sf, "pairs").select("rec_id", L.band(F.col("preserved")).alias("band"), L.threshold(F.col("preserved")).alias("threshold"))


# ------------------------------------------------------------------ joins
def _link_sides(spark, sf):
    a = images(spark, sf).select("name", F.col("manuscript").alias("ms_a"), L.plate_key(F.col("plate")).alias("pk"), F.col("frag").alias("fr"), F.lower(F.coalesce("side", F.lit(""))).alias("sd"), F.coalesce(F.col("plate").startswith("*"), F.lit(False)).alias("star"))
    b = pairs(spark, sf).where("frag is not null").select(F.col("name").alias("pair"), F.col("manuscript").alias("ms_b"), L.plate_key(F.col("plate")).alias("pk_b"), F.col("frag").alias("fr_b"), F.lower(F.coalesce("side", F.lit(""))).alias("sd_b"))
    return a.where("fr is not null"), b


_SIDES = f"""a AS (SELECT name, manuscript AS ms_a, {PKEY.format('plate')} AS pk, frag AS fr, lower(coalesce(side, '')) AS sd, coalesce(starts_with(plate, '*'), false) AS star FROM img WHERE frag IS NOT NULL),
 b AS (SELECT name AS pair, manuscript AS ms_b, {PKEY.format('plate')} AS pk_b, frag AS fr_b, lower(coalesce(side, '')) AS sd_b FROM prs WHERE frag IS NOT NULL),
 d AS (SELECT name, pair, star, {LINKTYPE} AS link FROM (SELECT *, {SG(BASE.format('ms_a'))} AS x, {SG('ms_b')} AS y FROM a JOIN b ON pk = pk_b AND fr = fr_b AND sd = sd_b)),
 direct AS (SELECT name, pair, link FROM d WHERE link = 'exact' OR (link IS NOT NULL AND NOT star)),
 f AS (SELECT name, pair, {LINKTYPE} AS link FROM (SELECT *, {SG(BASE.format('ms_a'))} AS x, {SG('ms_b')} AS y FROM a JOIN b ON pk = pk_b AND fr = fr_b AND sd_b = CASE sd WHEN 'recto' THEN 'verso' WHEN 'verso' THEN 'recto' END WHERE NOT star AND name NOT IN (SELECT name FROM direct)))"""


@query(f"WITH {IMG}, {PRS}, {_SIDES} SELECT * FROM direct")
def link_composite(spark, sf):
    """Images and records on the same plate, fragment and side whose manuscripts agree."""
    a, b = _link_sides(spark, sf)
    j = a.join(b, (F.col("pk") == F.col("pk_b")) & (F.col("fr") == F.col("fr_b")) & (F.col("sd") == F.col("sd_b")))
    link = L.link_type(F.col("ms_a"), F.col("ms_b"))
    return j.withColumn("link", link).where("link = 'exact' or (link is not null and not star)").select("name", "pair", "link")


@query(f"WITH {IMG}, {PRS}, {_SIDES} SELECT * FROM direct UNION ALL SELECT name, pair, 'side_swapped' FROM f WHERE link = 'exact'")
def link_fallback_side(spark, sf):
    """The same, and the other side for images without a link there (but not those on a starred plate)."""
    a, b = _link_sides(spark, sf)
    flip = F.when(F.col("sd") == "recto", "verso").when(F.col("sd") == "verso", "recto")
    same = (F.col("pk") == F.col("pk_b")) & (F.col("fr") == F.col("fr_b"))
    t = L.link_type(F.col("ms_a"), F.col("ms_b"))
    first = F.when((t == "exact") | ~F.col("star"), t)
    j = R.fallback_join(a, b, "name", same & (F.col("sd") == F.col("sd_b")), same & (flip == F.col("sd_b")), ~F.col("star"), first, F.when(t == "exact", "side_swapped"))
    return j.select("name", "pair", "link")


@query(f"WITH {IMG} SELECT name, rec_id, manuscript, plate, side FROM img")
def link_dedupe_last(spark, sf):
    return images(spark, sf).select("name", "rec_id", "manuscript", "plate", "side")


@query(f"WITH {PRS}, {CNT}, {LNK} SELECT lnk.name AS name, CAST(pos AS INTEGER) AS pos, lnk.sg AS sg, label, preserved, certain, lines FROM lnk LEFT JOIN cnt ON cnt.sg = lnk.sg AND cnt.fragment = lnk.label")
def transcription_lookup(spark, sf):
    c = counts(spark, sf).select("sg", F.col("fragment").alias("label"), "preserved", "certain", "lines")
    return links(pairs(spark, sf), "name").join(c, ["sg", "label"], "left").select("name", "pos", "sg", "label", "preserved", "certain", "lines")


@query(f"WITH {PRS}, {MSS} SELECT name, coalesce(m.material, '') AS ms_material, coalesce(m.period, '') AS ms_period, coalesce(m.script_language, '') AS ms_language FROM prs LEFT JOIN mss m ON m.manuscript_number = prs.manuscript")
def dimension_defaults(spark, sf):
    m = manuscripts(spark, sf).select(F.col("manuscript_number").alias("manuscript"), *[F.col(a).alias(b) for a, b in (("material", "ms_material"), ("period", "ms_period"), ("script_language", "ms_language"))])
    j = pairs(spark, sf).select("name", "manuscript").join(R.small(m), "manuscript", "left")
    return j.select("name", *[F.coalesce(c, F.lit("")).alias(c) for c in ("ms_material", "ms_period", "ms_language")])


_OWN = "own AS (SELECT name, t.etcbc AS etcbc, t.link AS link, 'catalogue' AS source FROM (SELECT name, unnest(text_fragments) AS t FROM img) WHERE t IS NOT NULL AND t.etcbc IS NOT NULL)"


@query(
    f"WITH {IMG}, {PRS}, {CNT}, {LNK}, bare AS (SELECT name, {SG(BASE.format('manuscript'))} AS ms, {PKEY.format('plate')} AS pk, frag AS fr, lower(coalesce(side, '')) AS sd FROM img WHERE coalesce(len(text_fragments), 0) = 0 AND frag IS NOT NULL) SELECT DISTINCT bare.name AS name, lnk.sg AS sg, lnk.label AS label FROM bare JOIN lnk ON {PKEY.format('lnk.plate')} = pk AND lnk.frag = fr AND lower(coalesce(lnk.side, '')) = sd AND {SG('lnk.manuscript')} = ms JOIN cnt ON cnt.sg = lnk.sg AND cnt.fragment = lnk.label"
)
def second_source(spark, sf):
    """Links from the second source for images that the first has none for."""
    bare = images(spark, sf).where("coalesce(size(text_fragments), 0) <= 0 and frag is not null")
    bare = bare.select("name", siglum(L.base_siglum(F.col("manuscript"))).alias("ms"), L.plate_key(F.col("plate")).alias("pk"), F.col("frag").alias("fr"), F.lower(F.coalesce("side", F.lit(""))).alias("sd"))
    other = links(pairs(spark, sf), "manuscript", "plate", "frag", "side")
    other = other.select(siglum(F.col("manuscript")).alias("ms"), L.plate_key(F.col("plate")).alias("pk"), F.col("frag").alias("fr"), F.lower(F.coalesce("side", F.lit(""))).alias("sd"), "sg", "label")
    known = counts(spark, sf).select("sg", F.col("fragment").alias("label"))
    return bare.join(other, ["ms", "pk", "fr", "sd"]).join(known, ["sg", "label"], "left_semi").select("name", "sg", "label").distinct()


@query(f"WITH {PRS}, {CNT}, {LNK} SELECT sg, fragment AS label, preserved FROM cnt WHERE preserved >= 5 AND paleo <= preserved / 2 AND sg IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lnk WHERE lnk.sg = cnt.sg AND lnk.label = cnt.fragment)")
def anti_unlinked(spark, sf):
    """Fragments with text that no image is linked to."""
    c = counts(spark, sf).where("preserved >= 5 and paleo <= preserved / 2 and sg is not null").select("sg", F.col("fragment").alias("label"), "preserved")
    return R.not_done(c, links(pairs(spark, sf), "name"), ["sg", "label"])


@query(
    f"WITH h AS (SELECT DISTINCT {SG('manuscript')} AS sg FROM pairs WHERE split IN ('val', 'test') AND manuscript IS NOT NULL), l AS (SELECT line_key, loaded_at, {SG('scroll')} AS sg FROM m9_restore_lines) SELECT line_key, loaded_at, 'held_out' AS part FROM l WHERE sg IN (SELECT sg FROM h) UNION ALL SELECT line_key, loaded_at, 'train' FROM l WHERE sg NOT IN (SELECT sg FROM h)"
)
def held_out_lines(spark, sf):
    """Lines of manuscripts that are held out (semi join), and all others (anti join)."""
    h = table(spark, sf, "pairs").where("split in ('val', 'test') and manuscript is not null").select(siglum(F.col("manuscript")).alias("sg")).distinct()
    d = table(spark, sf, "m9_restore_lines").select("line_key", "loaded_at", siglum(F.col("scroll")).alias("sg"))
    a, b = d.join(h, "sg", "left_semi").withColumn("part", F.lit("held_out")), d.where("sg is not null").join(h, "sg", "left_anti").withColumn("part", F.lit("train"))
    return a.unionByName(b).drop("sg")


def _pieces(d: DataFrame) -> DataFrame:
    return d.withColumn("pk", L.plate_key(F.col("plate"))).withColumn("fr", F.coalesce("frag", F.lit(""))).withColumn("sd", F.coalesce("side", F.lit("")))


@query(f"WITH {PRS}, {LNK} SELECT sg, label, coalesce(side, '') AS sd, count(DISTINCT {PKEY.format('plate')} || '|' || coalesce(frag, '')) AS pieces FROM lnk GROUP BY ALL")
def fragments_on_pieces(spark, sf):
    """On how many pieces each fragment is photographed, by side."""
    d = _pieces(links(pairs(spark, sf), "plate", "frag", "side"))
    return d.groupBy("sg", "label", "sd").agg(F.count_distinct("pk", "fr").alias("pieces"))


_CAT = f"""k AS (SELECT DISTINCT name, coalesce(side, '') AS sd, sg, label, {PKEY.format('plate')} || '|' || coalesce(frag, '') AS piece FROM lnk),
 op AS (SELECT sg, label, sd, count(DISTINCT piece) AS n FROM k GROUP BY ALL),
 kk AS (SELECT k.*, op.n AS n, coalesce(r.n, 0) AS on_recto, coalesce(cnt.preserved, 0) AS preserved, CASE WHEN regexp_matches(k.label, '^f?[0-9]+[a-z]?(i{{1,3}}|iv|v|vi{{0,3}})$') THEN regexp_extract(k.label, '^(f?[0-9]+[a-z]?)(i{{1,3}}|iv|v|vi{{0,3}})$', 1) END AS base FROM k JOIN op USING (sg, label, sd) LEFT JOIN op r ON r.sg = k.sg AND r.label = k.label AND r.sd = 'Recto' LEFT JOIN cnt ON cnt.sg = k.sg AND cnt.fragment = k.label),
 g AS (SELECT name, sd, count(*) AS n_keys, max(n) > 1 AS shared, min(on_recto) > 0 AS all_recto, count(base) = count(*) AND count(DISTINCT base) = 1 AS one_base, sum(preserved) AS preserved FROM kk GROUP BY name, sd),
 cat AS (SELECT prs.name AS name, coalesce(prs.side, '') AS sd, prs.split AS split, CASE WHEN g.name IS NULL THEN 'unlinked' WHEN g.preserved = 0 THEN 'no_text' WHEN g.sd = 'Verso' AND all_recto THEN 'verso_back' WHEN shared THEN 'shared' WHEN n_keys = 1 THEN 'one_to_one' WHEN one_base THEN 'multi_column' ELSE 'image_many' END AS category, CAST(coalesce(g.preserved, 0) AS BIGINT) AS preserved FROM prs LEFT JOIN g ON g.name = prs.name)"""


def categories(spark, sf) -> DataFrame:
    """(name, sd, split, category, preserved): how each picture is linked to fragments."""
    p = pairs(spark, sf)
    k = _pieces(links(p, "name", "plate", "frag", "side")).select("name", "sd", "sg", "label", "pk", "fr").distinct()
    op = k.groupBy("sg", "label", "sd").agg(F.count_distinct("pk", "fr").alias("n"))
    recto = op.where("sd = 'Recto'").select("sg", "label", F.col("n").alias("on_recto"))
    c = counts(spark, sf).select("sg", F.col("fragment").alias("label"), "preserved")
    k = k.join(op, ["sg", "label", "sd"]).join(recto, ["sg", "label"], "left").join(c, ["sg", "label"], "left").withColumn("base", L.column_base(F.col("label")))
    g = k.groupBy("name").agg(
        F.count("*").alias("n_keys"), (F.max("n") > 1).alias("shared"), (F.min(F.coalesce("on_recto", F.lit(0))) > 0).alias("all_recto"), ((F.count("base") == F.count("*")) & (F.count_distinct("base") == 1)).alias("one_base"), F.sum(F.coalesce("preserved", F.lit(0))).alias("preserved")
    )
    d = p.select("name", F.coalesce("side", F.lit("")).alias("sd"), "split").join(g, "name", "left")
    cat = (
        F.when(F.col("n_keys").isNull(), "unlinked")
        .when(F.col("preserved") == 0, "no_text")
        .when((F.col("sd") == "Verso") & F.col("all_recto"), "verso_back")
        .when(F.col("shared"), "shared")
        .when(F.col("n_keys") == 1, "one_to_one")
        .when(F.col("one_base"), "multi_column")
        .otherwise("image_many")
    )
    return d.select("name", "sd", "split", cat.alias("category"), F.coalesce("preserved", F.lit(0)).cast("long").alias("preserved"))


@query(f"WITH {PRS}, {CNT}, {LNK}, {_CAT} SELECT * FROM cat")
def category_case(spark, sf):
    return categories(spark, sf)


@query(f"WITH {PRS}, {CNT}, {LNK}, {_CAT} SELECT coalesce(split, 'none') AS split, category, sd, count(*) AS images, CAST(sum(preserved) AS BIGINT) AS preserved FROM cat GROUP BY ALL")
def category_side(spark, sf):
    d = categories(spark, sf).withColumn("split", F.coalesce("split", F.lit("none")))
    return d.groupBy("split", "category", "sd").agg(F.count("*").alias("images"), F.sum("preserved").alias("preserved"))


# ------------------------------------------------------------------ words of scrolls against the base text
# DuckDB's edit distance counts bytes, so letters are first mapped to single ones
BYTES = "translate({0}, 'אבגדהוזחטיךכלםמןנסעףפץצקרשת', 'abcdefghijklmnopqrstuvwxyzA')"
FOLD = "translate({0}, 'ךםןףץ', 'כמנפצ')"
ORTHO = "regexp_replace(translate({0}, 'ךםןףץ', 'כמנפצ'), '[ויא]', '', 'g')"
QSP = "regexp_replace(regexp_replace(translate({0}, 'ךםןףץ', 'כמנפצ'), '[ויא]', '', 'g'), '([כתמ])ה$', '\\1')"
KIND = f"CASE WHEN mt IS NULL OR mt = '' THEN 'plus' WHEN {FOLD.format('scroll_word')} = {FOLD.format('mt')} THEN 'same' WHEN {ORTHO.format('scroll_word')} = {ORTHO.format('mt')} THEN 'orthographic' WHEN {QSP.format('scroll_word')} = {QSP.format('mt')} THEN 'long_form' ELSE 'substantive' END"
WRD = f"wrd AS (SELECT * FROM (SELECT word_id, {SG('scroll')} AS sg, ref, j, scroll_word, mt, kind, plene FROM m9_variants WHERE scroll IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY word_id ORDER BY sg, ref, j, scroll_word, mt, kind, plene) = 1)"


def words(spark, sf) -> DataFrame:
    """Each word of a scroll once."""
    d = table(spark, sf, "m9_variants").where("scroll is not null").withColumn("sg", siglum(F.col("scroll")))
    cols = ["sg", "ref", "j", "scroll_word", "mt", "kind", "plene"]
    g = d.groupBy("word_id").agg(F.min_by(F.struct(*cols), F.struct(*cols)).alias("r"))
    return g.select("word_id", *[F.col(f"r.{c}").alias(c) for c in cols])


@query(f"WITH {WRD} SELECT word_id, {KIND} AS new_kind, CASE WHEN {KIND} = 'orthographic' THEN length(scroll_word) - length(mt) ELSE 0 END AS new_plene, levenshtein({BYTES.format('scroll_word')}, {BYTES.format("coalesce(mt, '')")}) AS edits FROM wrd")
def variant_kinds(spark, sf):
    k = H.variant_kind(F.col("scroll_word"), F.col("mt"))
    d = words(spark, sf).withColumn("new_kind", k)
    plene = F.when(F.col("new_kind") == "orthographic", F.length("scroll_word") - F.length("mt")).otherwise(0)
    return d.select("word_id", "new_kind", plene.cast("long").alias("new_plene"), F.levenshtein("scroll_word", F.coalesce("mt", F.lit(""))).cast("long").alias("edits"))


@query(f"WITH {WRD} SELECT sg, count(*) FILTER (WHERE kind <> 'plus') AS n, round(count(*) FILTER (WHERE kind = 'same') / count(*) FILTER (WHERE kind <> 'plus'), 3) AS same, round(count(*) FILTER (WHERE kind = 'orthographic' AND plene > 0) / count(*) FILTER (WHERE kind <> 'plus'), 3) AS fuller, round(count(*) FILTER (WHERE kind = 'substantive') / count(*) FILTER (WHERE kind <> 'plus'), 3) AS substantive, count(*) FILTER (WHERE kind = 'plus') AS pluses FROM wrd GROUP BY sg HAVING count(*) FILTER (WHERE kind <> 'plus') >= 50")
def scroll_rates(spark, sf):
    d = words(spark, sf)
    n = F.count_if(F.col("kind") != "plus")
    rate = lambda c: F.round(F.try_divide(F.count_if(c), n), 3)
    g = d.groupBy("sg").agg(n.alias("n"), rate(F.col("kind") == "same").alias("same"), rate((F.col("kind") == "orthographic") & (F.col("plene") > 0)).alias("fuller"), rate(F.col("kind") == "substantive").alias("substantive"), F.count_if(F.col("kind") == "plus").alias("pluses"))
    return g.where("n >= 50")


@query(
    f"WITH {WRD}, pl AS (SELECT sg, ref, j, max(CASE WHEN kind <> 'same' THEN {QSP.format('scroll_word')} END) AS m FROM wrd WHERE j IS NOT NULL AND ref IS NOT NULL GROUP BY ALL), jn AS (SELECT x.sg AS a, y.sg AS b, x.ref AS ref, x.j AS j, x.m = y.m AS eq FROM pl x JOIN pl y ON x.ref = y.ref AND x.j = y.j AND x.sg < y.sg) SELECT a, b, count(*) AS overlap, count(*) FILTER (WHERE eq) AS shared, round(count(*) FILTER (WHERE eq) / count(*), 3) AS rate, list(ref || ' ' || CAST(j AS VARCHAR) ORDER BY ref, j) FILTER (WHERE eq)[1:4] AS examples FROM jn GROUP BY a, b HAVING count(*) FILTER (WHERE eq) >= 1"
)
def shared_pairs(spark, sf):
    """Pairs of scrolls that read other than the base text at the same place and alike, how often and where first."""
    m = F.when(F.col("kind") != "same", H.long_form(F.col("scroll_word")))
    d = words(spark, sf).where("j is not null and ref is not null").withColumn("m", m).groupBy("ref", "j", "sg").agg(F.max("m").alias("m"))
    return R.shared_pairs(d, ["ref", "j"], "sg", F.col("m"), 1)


# ------------------------------------------------------------------ set operators, top-k, resume
@query(f"SELECT DISTINCT {SG('manuscript')} AS ms FROM pairs WHERE manuscript IS NOT NULL UNION SELECT {SG('manuscript')} FROM inventory_images WHERE manuscript IS NOT NULL")
def union_distinct(spark, sf):
    a, b = (table(spark, sf, t).where("manuscript is not null").select(siglum(F.col("manuscript")).alias("ms")) for t in ("pairs", "inventory_images"))
    return a.unionByName(b).distinct()


@query(f"SELECT {SG('scroll')} AS ms FROM fragment_counts WHERE scroll IS NOT NULL EXCEPT SELECT {SG('manuscript')} FROM pairs WHERE manuscript IS NOT NULL")
def except_keys(spark, sf):
    a = table(spark, sf, "fragment_counts").where("scroll is not null").select(siglum(F.col("scroll")).alias("ms"))
    return a.subtract(table(spark, sf, "pairs").where("manuscript is not null").select(siglum(F.col("manuscript")).alias("ms")))


@query(f"SELECT {SG('scroll')} AS ms FROM fragment_counts WHERE scroll IS NOT NULL INTERSECT SELECT {SG('manuscript')} FROM pairs WHERE manuscript IS NOT NULL")
def intersect_keys(spark, sf):
    a = table(spark, sf, "fragment_counts").where("scroll is not null").select(siglum(F.col("scroll")).alias("ms"))
    return a.intersect(table(spark, sf, "pairs").where("manuscript is not null").select(siglum(F.col("manuscript")).alias("ms")))


@query(
    f"WITH {IMG}, {PRS} SELECT name, manuscript, 'pairs' AS origin FROM prs UNION ALL SELECT name, manuscript, 'images' FROM img WHERE name NOT IN (SELECT name FROM prs)"
)
def merge_right_wins(spark, sf):
    a = images(spark, sf).select("name", "manuscript", F.lit("images").alias("origin"))
    b = pairs(spark, sf).select("name", "manuscript", F.lit("pairs").alias("origin"))
    return R.merge_right_wins(a, b, ["name"])


@query(f"WITH {IMG} SELECT name, rec_id FROM img WHERE name NOT IN (SELECT name FROM pairs)")
def resume_anti(spark, sf):
    """Images that a run which wrote pairs hasn't reached."""
    return R.not_done(images(spark, sf).select("name", "rec_id"), table(spark, sf, "pairs"), ["name"])


@query(f"WITH {PRS} SELECT name, manuscript, preserved FROM prs ORDER BY preserved DESC NULLS LAST, name LIMIT 20")
def top_sort(spark, sf):
    return pairs(spark, sf).select("name", "manuscript", "preserved").orderBy(F.desc_nulls_last("preserved"), "name").limit(20)


@query(f"WITH {PRS} SELECT name, ms, CAST(r AS INTEGER) AS rank FROM (SELECT name, {SG('manuscript')} AS ms, row_number() OVER (PARTITION BY {SG('manuscript')} ORDER BY loaded_at, rec_id) AS r FROM prs WHERE manuscript IS NOT NULL) WHERE r <= 8")
def first_per_group(spark, sf):
    d = pairs(spark, sf).where("manuscript is not null").select("name", siglum(F.col("manuscript")).alias("ms"), "loaded_at", "rec_id")
    return R.top_per_group(d, ["ms"], [F.col("loaded_at"), F.col("rec_id")], 8).select("name", "ms", "rank")


@query(
    f"WITH {PRS} SELECT name, side, material FROM prs WHERE split = 'train' AND category IN ('one_to_one', 'multi_column') AND side = 'Recto' AND material = 'Parchment'"
)
def work_set(spark, sf):
    d = pairs(spark, sf).where("split = 'train' and category in ('one_to_one', 'multi_column') and side = 'Recto' and material = 'Parchment'")
    return d.select("name", "side", "material")


@query(f"WITH {PRS}, {LNK} SELECT rec_id, CAST(count(*) AS BIGINT) AS links, bool_or(confirmed IS NOT FALSE) AS usable, max(CASE WHEN source = 'catalogue' THEN 1 ELSE 0 END) = 1 AS in_catalogue FROM lnk GROUP BY rec_id")
def link_confirmed(spark, sf):
    """Links that aren't rejected: false rejects, null passes."""
    g = links(pairs(spark, sf), "rec_id").groupBy("rec_id")
    return g.agg(F.count("*").alias("links"), F.bool_or(F.coalesce(F.col("confirmed"), F.lit(True))).alias("usable"), (F.max((F.col("source") == "catalogue").cast("int")) == 1).alias("in_catalogue"))


def corpus_lines(spark, sf) -> DataFrame:
    """Distinct restored lines as (line_key, sg, frag, line, letters): folded letters without blanks."""
    d = table(spark, sf, "m9_restore_lines").where("text is not null").groupBy("line_key").agg(F.max_by(F.struct("scroll", "frag", "line", "text"), F.struct("loaded_at", "text")).alias("r"))
    return d.select("line_key", siglum(F.col("r.scroll")).alias("sg"), F.col("r.frag").alias("frag"), F.col("r.line").alias("line"), H.consonants(H.fold(F.col("r.text"))).alias("letters"))


CORPUS = f"corpus AS (SELECT line_key, {SG('scroll')} AS sg, frag, regexp_replace({FOLD.format('text')}, '[^א-ת]', '', 'g') AS letters FROM (SELECT * FROM m9_restore_lines WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line_key ORDER BY loaded_at DESC, text DESC) = 1))"


@query(f"WITH {CORPUS} SELECT line_key, sg, length(letters) AS n FROM corpus WHERE sg NOT IN (SELECT {SG('manuscript')} FROM pairs WHERE split = 'test' AND manuscript IS NOT NULL)")
def corpus_restrict(spark, sf):
    """The corpus without the held-out manuscripts."""
    h = table(spark, sf, "pairs").where("split = 'test' and manuscript is not null").select(siglum(F.col("manuscript")).alias("sg")).distinct()
    return corpus_lines(spark, sf).where("sg is not null").join(h, "sg", "left_anti").select("line_key", "sg", F.length("letters").cast("long").alias("n"))


def columns(*names: str) -> list[Column]:
    return [F.col(n) for n in names]
