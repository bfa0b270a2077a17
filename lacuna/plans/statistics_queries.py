"""Queries of profiles, robust statistics and calibration, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hebrew as H
from ..functions import labels as L
from ..functions.sigla import siglum
from ..operators import calibration as C
from ..operators import relational as R
from ..operators import statistics as S
from ..session import table
from . import catalogue_queries as K
from .catalogue_queries import CNT, CORPUS, IMG, LNK, MSS, PRS, SG

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ profiles and margins
_PROFILE = f"""flat AS (SELECT name, manuscript, side, coalesce(len(list_filter(text_fragments, lambda t: t IS NOT NULL)), 0) AS n, coalesce(len(list_filter(text_fragments, lambda t: t IS NOT NULL AND t.etcbc IS NOT NULL)), 0) AS ne, coalesce(len(list_filter(text_fragments, lambda t: t IS NOT NULL AND t.link = 'exact')), 0) AS nx FROM img),
 prof AS (SELECT coalesce(manuscript, 'none') AS ms, count(*) AS images, count(*) FILTER (WHERE side = 'Recto') AS recto, count(*) FILTER (WHERE n > 0) AS linked, count(*) FILTER (WHERE ne > 0) AS transcribed, count(*) FILTER (WHERE ne > 0 AND n = 1) AS single, count(*) FILTER (WHERE ne > 0 AND nx = n) AS exact FROM flat GROUP BY ALL)"""


def _profile(spark, sf):
    n = lambda cond: F.size(F.coalesce(F.filter("text_fragments", cond), F.array()))
    d = K.images(spark, sf).select(
        F.coalesce("manuscript", F.lit("none")).alias("ms"), "side", n(lambda t: t.isNotNull()).alias("n"), n(lambda t: t["etcbc"].isNotNull()).alias("ne"), n(lambda t: t["link"] == "exact").alias("nx")
    )
    c = lambda cond, name: F.count_if(cond).alias(name)
    return d.groupBy("ms").agg(
        F.count("*").alias("images"), c(F.col("side") == "Recto", "recto"), c(F.col("n") > 0, "linked"), c(F.col("ne") > 0, "transcribed"), c((F.col("ne") > 0) & (F.col("n") == 1), "single"), c((F.col("ne") > 0) & (F.col("nx") == F.col("n")), "exact")
    )


@query(f"WITH {IMG}, {_PROFILE} SELECT * FROM prof")
def manuscript_profile(spark, sf):
    return _profile(spark, sf)


@query(
    f"WITH {IMG}, {MSS}, {_PROFILE}, j AS (SELECT coalesce(material, 'none') AS material, prof.* FROM prof LEFT JOIN mss ON mss.manuscript_number = prof.ms) SELECT coalesce(material, 'all') AS material, count(*) AS manuscripts, CAST(sum(images) AS BIGINT) AS images, CAST(sum(recto) AS BIGINT) AS recto, CAST(sum(linked) AS BIGINT) AS linked FROM j GROUP BY ROLLUP (material)"
)
def status_totals(spark, sf):
    m = K.manuscripts(spark, sf).select(F.col("manuscript_number").alias("ms"), "material")
    j = _profile(spark, sf).join(m, "ms", "left").withColumn("material", F.coalesce("material", F.lit("none")))
    return S.with_margins(j, [["material"], []], [F.count("*").alias("manuscripts"), *[F.sum(c).alias(c) for c in ("images", "recto", "linked")]])


_SUB = {"all": "true", "recto": "side = 'Recto'", "recto_parchment": "side = 'Recto' AND material = 'Parchment'", "recto_papyrus": "side = 'Recto' AND material = 'Papyrus'", "verso": "side = 'Verso'"}


@query(f"WITH {PRS} " + " UNION ALL ".join(f"SELECT '{k}' AS subset, count(*) AS n, CAST(sum(preserved) AS BIGINT) AS letters, count(DISTINCT manuscript) AS manuscripts FROM prs WHERE {c} HAVING count(*) >= 10" for k, c in _SUB.items()))
def subset_profile(spark, sf):
    return S.named_subsets(K.pairs(spark, sf), {k: F.expr(c) for k, c in _SUB.items()}, [F.sum("preserved").cast("long").alias("letters"), F.count_distinct("manuscript").alias("manuscripts")])


def _signs(spark, sf):
    """(rec_id, key, line, i, c, k, edge): the readable letters of transcribed lines; those next to something missing, and the
    first and last ones, are at an edge."""
    d = table(spark, sf, "pairs").where("lines is not null").select("rec_id", F.explode("lines").alias("key", "ls"))
    d = d.select("rec_id", "key", F.posexplode("ls").alias("line", "l")).where("l.text is not null and l.marks is not null")
    d = d.select("rec_id", "key", "line", F.col("l.marks").alias("m"), F.posexplode(H.signs(F.col("l.text"), F.col("l.marks"))).alias("i", "x"))
    near = F.substring("m", F.col("i"), F.lit(1)).isin("r", "#") & (F.col("i") > 0) | F.substring("m", F.col("i") + 2, F.lit(1)).isin("r", "#")
    return d.where("x.k in ('.', 'u') and x.c <> ' '").select("rec_id", "key", "line", "i", "x.c", "x.k", F.coalesce(near, F.lit(False)).alias("edge"))


_LINES = "ln AS (SELECT rec_id, k, i - 1 AS line, v[i].text AS text, v[i].marks AS marks FROM (SELECT rec_id, k, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT rec_id, m.key AS k, m.value AS v FROM (SELECT rec_id, unnest(map_entries(lines)) AS m FROM pairs))) WHERE v[i] IS NOT NULL AND v[i].text IS NOT NULL AND v[i].marks IS NOT NULL)"
_SIGNS = f"{_LINES}, sg AS (SELECT rec_id, k AS key, line, i, substr(text, i, 1) AS c, substr(marks, i, 1) AS m, (i > 1 AND substr(marks, i - 1, 1) IN ('r', '#')) OR substr(marks, i + 1, 1) IN ('r', '#') AS edge FROM (SELECT *, unnest(range(1, least(length(text), length(marks)) + 1)) AS i FROM ln))"


@query(f"WITH {_SIGNS} SELECT m AS mark, CASE WHEN grouping(edge) = 1 THEN 'all' WHEN edge THEN 'true' ELSE 'false' END AS edge, count(*) AS letters, count(DISTINCT c) AS kinds FROM sg WHERE m IN ('.', 'u') AND c <> ' ' GROUP BY GROUPING SETS ((m, edge), (m))")
def grouping_margins(spark, sf):
    """Letters by mark and edge, and by mark alone."""
    d = _signs(spark, sf).withColumnRenamed("k", "mark")
    return S.with_margins(d, [["mark", "edge"], ["mark"]], [F.count("*").alias("letters"), F.count_distinct("c").alias("kinds")])


_BAND = "CASE WHEN preserved BETWEEN 1 AND 9 THEN '1-9' WHEN preserved BETWEEN 10 AND 19 THEN '10-19' WHEN preserved BETWEEN 20 AND 39 THEN '20-39' WHEN preserved >= 40 THEN '40+' ELSE 'none' END"


@query(f"WITH {PRS}, b AS (SELECT {_BAND} AS band, * FROM prs) SELECT coalesce(band, 'all') AS band, count(*) AS images, count(*) FILTER (WHERE split = 'test') AS test, CAST(sum(preserved) AS BIGINT) AS letters FROM b GROUP BY ROLLUP (band)")
def banded_totals(spark, sf):
    d = K.pairs(spark, sf).withColumn("band", F.coalesce(L.band(F.col("preserved")), F.lit("none")))
    return S.with_margins(d, [["band"], []], [F.count("*").alias("images"), F.count_if(F.col("split") == "test").alias("test"), F.sum("preserved").cast("long").alias("letters")])


@query("SELECT quantile_cont(CAST(abs(z) AS DOUBLE), 0.95) AS q95, quantile_cont(CAST(abs(z) AS DOUBLE), 0.99) AS q99, quantile_cont(CAST(abs(z) AS DOUBLE), 0.999) AS q999 FROM m9_restore_lines WHERE z IS NOT NULL")
def quantile_thresholds(spark, sf):
    """Exact quantiles with interpolation, from counts of distinct values."""
    d = table(spark, sf, "m9_restore_lines").where("z is not null").groupBy(F.abs("z").cast("double").alias("x")).agg(F.count("*").alias("n"))
    return d.agg(*[F.expr(f"percentile(x, {q}D, n)").alias(n) for q, n in ((0.95, "q95"), (0.99, "q99"), (0.999, "q999"))])


@query("SELECT median(CAST(length AS DOUBLE)) AS med, quantile_cont(CAST(length AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(length AS DOUBLE), 0.75) AS q3, count(*) AS n FROM m9_restore_lines WHERE length IS NOT NULL")
def median_iqr(spark, sf):
    d = table(spark, sf, "m9_restore_lines").where("length is not null").groupBy(F.col("length").cast("double").alias("x")).agg(F.count("*").alias("c"))
    return d.agg(*[F.expr(f"percentile(x, {q}D, c)").alias(n) for q, n in ((0.5, "med"), (0.25, "q1"), (0.75, "q3"))], F.sum("c").alias("n"))


_LN = f"rl AS (SELECT line_key, {SG('scroll')} AS sg, frag, length, z, share_rec, text FROM m9_restore_lines QUALIFY row_number() OVER (PARTITION BY line_key ORDER BY loaded_at DESC) = 1)"


def restored(spark, sf):
    """Each restored line once."""
    d = R.latest(table(spark, sf, "m9_restore_lines").select("line_key", "scroll", "frag", "length", "z", "share_rec", "text", "loaded_at"), ["line_key"], ["loaded_at"])
    return d.select("line_key", siglum(F.col("scroll")).alias("sg"), "frag", "length", "z", "share_rec", "text")


@query(
    f"WITH {_LN}, m AS (SELECT sg, frag, count(*) AS n, median(CAST(length AS DOUBLE)) AS med FROM rl WHERE length IS NOT NULL GROUP BY ALL HAVING count(*) >= 5), d AS (SELECT m.sg AS sg, m.frag AS frag, med, median(abs(CAST(length AS DOUBLE) - med)) AS mad FROM rl JOIN m ON m.sg = rl.sg AND m.frag = rl.frag WHERE length IS NOT NULL GROUP BY ALL) SELECT line_key, med AS column_mid, round((length - med) / (mad * 1.4826 + 1.0), 2) AS z_score, abs(round((length - med) / (mad * 1.4826 + 1.0), 2)) >= 3.5 AS flag FROM rl JOIN d ON d.sg = rl.sg AND d.frag = rl.frag WHERE length IS NOT NULL"
)
def mad_outliers(spark, sf):
    d = restored(spark, sf).where("length is not null").select("line_key", "sg", "frag", "length")
    return S.robust_outliers(d, ["sg", "frag"], "length").select("line_key", F.col("median").alias("column_mid"), "z_score", "flag")


@query(
    f"WITH {_LN}, s AS (SELECT frag, avg(CAST(length AS DOUBLE)) AS mu, stddev_pop(CAST(length AS DOUBLE)) AS sd FROM rl WHERE length IS NOT NULL AND share_rec < 0.7 GROUP BY frag) SELECT line_key, round((length - mu) / (sd + 1e-6), 4) AS z FROM rl LEFT JOIN s USING (frag) WHERE length IS NOT NULL  AND share_rec >= 0.7"
)
def group_z(spark, sf):
    """Mostly reconstructed lines against the others of the same label."""
    d = restored(spark, sf).where("length is not null").select("line_key", "frag", F.col("length").cast("double").alias("x"), "share_rec")
    null = d.where("share_rec < 0.7")
    out = S.control_z(d.where("share_rec >= 0.7"), null, ["frag"], "x")
    return out.select("line_key", F.round("z", 4).alias("z"))


@query(f"WITH {_LN} SELECT sg, max(length) AS longest, arg_max(frag, (length, line_key)) AS at FROM rl WHERE length IS NOT NULL GROUP BY sg")
def grouped_max(spark, sf):
    """The longest line of each scroll and where it is."""
    d = restored(spark, sf).where("length is not null")
    return d.groupBy("sg").agg(F.max("length").alias("longest"), F.max_by("frag", F.struct("length", "line_key")).alias("at"))


@query(f"WITH {PRS}, b AS (SELECT {_BAND} AS band, cast(preserved AS DOUBLE) AS score, split, name FROM prs WHERE preserved IS NOT NULL) SELECT name, (1 + (SELECT count(*) FROM b n WHERE n.split = 'train' AND n.band = r.band AND n.score >= r.score)) / (1 + (SELECT count(*) FROM b n WHERE n.split = 'train' AND n.band = r.band)) AS p, (SELECT count(*) FROM b n WHERE n.split = 'train' AND n.band = r.band) AS n_controls FROM b r WHERE r.split IN ('val', 'test')")
def empirical_p(spark, sf):
    """p of held-out records' letters against train records of the same band."""
    d = K.pairs(spark, sf).where("preserved is not null").select("name", "split", F.coalesce(L.band(F.col("preserved")), F.lit("none")).alias("band"), F.col("preserved").cast("double").alias("score"))
    return C.empirical_p(d.where("split in ('val', 'test')"), d.where("split = 'train'"), ["band"], "score").select("name", "p", "n_controls")


@query(f"WITH {PRS}, b AS (SELECT {_BAND} AS band, cast(preserved AS DOUBLE) AS score, name, split FROM prs WHERE preserved IS NOT NULL), p AS (SELECT name, (1 + (SELECT count(*) FROM b n WHERE n.split = 'train' AND n.band = r.band AND n.score >= r.score)) / (1 + (SELECT count(*) FROM b n WHERE n.split = 'train' AND n.band = r.band)) AS p FROM b r WHERE r.split IN ('val', 'test')) SELECT name, p * (SELECT count(*) FROM p) AS E FROM p")
def e_values(spark, sf):
    """E of every held-out record."""
    return C.with_e(empirical_p(spark, sf)).select("name", "E")


@query(
    f"WITH {PRS}, b AS (SELECT {_BAND} AS band, cast(preserved AS DOUBLE) AS score, name, split, coalesce(manuscript, '') AS ms, {K.PKEY.format('plate')} AS pk FROM prs WHERE preserved IS NOT NULL), p AS (SELECT ms, pk, (1 + (SELECT count(*) FROM b n WHERE n.split = 'train' AND n.band = r.band AND n.score >= r.score)) / (1 + (SELECT count(*) FROM b n WHERE n.split = 'train' AND n.band = r.band)) AS p FROM b r WHERE r.split IN ('val', 'test')), s AS (SELECT pk, ms, round(sum(greatest(-ln(p) + ln(0.05), 0)), 6) AS stat FROM p GROUP BY ALL) SELECT pk, ms, stat FROM s QUALIFY row_number() OVER (PARTITION BY pk ORDER BY stat DESC, ms) = 1"
)
def fisher_combine(spark, sf):
    """For each plate the manuscript to which its held-out pieces point most, by the truncated statistic."""
    d = K.pairs(spark, sf).where("preserved is not null").select("name", F.coalesce("manuscript", F.lit("")).alias("ms"), L.plate_key(F.col("plate")).alias("pk"))
    p = empirical_p(spark, sf).join(d, "name")
    return C.fisher(p, ["pk"], "ms", truncated=True)


@query(
    f"WITH {PRS}, b AS (SELECT {_BAND} AS band, cast(preserved AS DOUBLE) AS score, name, split, coalesce(manuscript, '') AS ms, {K.PKEY.format('plate')} AS pk FROM prs WHERE preserved IS NOT NULL), p AS (SELECT ms, pk, (1 + (SELECT count(*) FROM b n WHERE n.split = 'train' AND n.band = r.band AND n.score >= r.score)) / (1 + (SELECT count(*) FROM b n WHERE n.split = 'train' AND n.band = r.band)) AS p FROM b r WHERE r.split IN ('val', 'test')), s AS (SELECT pk, ms, round(sum(-ln(p)), 6) AS stat FROM p GROUP BY ALL) SELECT pk, ms, stat FROM s QUALIFY row_number() OVER (PARTITION BY pk ORDER BY stat DESC, ms) = 1"
)
def fisher_sums(spark, sf):
    """The same by the plain sum of -ln p."""
    d = K.pairs(spark, sf).where("preserved is not null").select("name", F.coalesce("manuscript", F.lit("")).alias("ms"), L.plate_key(F.col("plate")).alias("pk"))
    return C.fisher(empirical_p(spark, sf).join(d, "name"), ["pk"], "ms")


@query(f"WITH {PRS}, b AS (SELECT {_BAND} AS band, cast(preserved AS DOUBLE) AS score, split, name FROM prs WHERE preserved IS NOT NULL) SELECT name, split, (1 + (SELECT count(*) FROM b n WHERE n.split = 'train' AND n.band = r.band AND n.score >= r.score)) / (1 + (SELECT count(*) FROM b n WHERE n.split = 'train' AND n.band = r.band)) AS p FROM b r")
def null_p(spark, sf):
    """p of all records, the controls too, against the controls of their band."""
    d = K.pairs(spark, sf).where("preserved is not null").select("name", "split", F.coalesce(L.band(F.col("preserved")), F.lit("none")).alias("band"), F.col("preserved").cast("double").alias("score"))
    return C.empirical_p(d, d.where("split = 'train'"), ["band"], "score").select("name", "split", "p")


_FW = f"{_LN}, o AS (SELECT sg, max(abs(z)) AS z_best FROM rl WHERE z IS NOT NULL AND share_rec >= 0.7 GROUP BY sg), n AS (SELECT sg, frag, max(abs(z)) AS z_max FROM rl WHERE z IS NOT NULL AND share_rec < 0.7 GROUP BY ALL)"


@query(f"WITH {_FW} SELECT o.sg AS sg, z_best, (1 + count(*) FILTER (WHERE z_max >= z_best)) / (1 + count(z_max)) AS p_fw FROM o LEFT JOIN n ON n.sg = o.sg GROUP BY o.sg, z_best")
def family_wise_p(spark, sf):
    """The largest |z| among reconstructed lines of a scroll against the largest of each of its columns of preserved ones."""
    d = restored(spark, sf).where("z is not null").select("sg", "frag", F.abs("z").alias("z"), "share_rec").where("sg is not null")
    return C.family_wise(d.where("share_rec >= 0.7"), d.where("share_rec < 0.7"), "sg", "frag")


@query(f"WITH {PRS}, r AS (SELECT row_number() OVER (ORDER BY preserved, name) AS a, row_number() OVER (ORDER BY w, name) AS b FROM prs WHERE preserved IS NOT NULL AND w IS NOT NULL) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r")
def spearman_ordinal(spark, sf):
    return S.spearman(K.pairs(spark, sf).select("name", "preserved", "w"), "preserved", "w", "name").select("n", F.round("rho", 6).alias("rho"))


@query(f"WITH {PRS}, d AS (SELECT coalesce(material, 'none') AS material, links IS NOT NULL AND len(links) > 0 AS linked, preserved FROM prs WHERE preserved IS NOT NULL) SELECT a.material AS material, count(*) FILTER (WHERE linked) AS n_pos, count(*) FILTER (WHERE NOT linked) AS n_neg, (SELECT round(avg(CASE WHEN x.preserved > y.preserved THEN 1.0 WHEN x.preserved = y.preserved THEN 0.5 ELSE 0.0 END), 6) FROM d x JOIN d y ON x.material = y.material WHERE x.linked AND NOT y.linked AND x.material = a.material) AS auc FROM d a GROUP BY a.material")
def auc(spark, sf):
    d = K.pairs(spark, sf).select(F.coalesce("material", F.lit("none")).alias("material"), (F.coalesce(F.size("links"), F.lit(0)) > 0).alias("linked"), "preserved")
    return S.auc(d, F.col("linked"), "preserved", ["material"]).withColumn("auc", F.round("auc", 6))


@query(
    f"WITH {PRS} SELECT name, CASE WHEN w * h < 1e4 AND preserved > 0 THEN 'no_parchment_found' WHEN CAST(preserved AS DOUBLE) / nullif(CAST(w AS DOUBLE) * h / 1e6, 0) > (SELECT 3 * quantile_cont(CAST(preserved AS DOUBLE) / (CAST(w AS DOUBLE) * h / 1e6), 0.95) FROM prs WHERE preserved >= 10 AND w > 0 AND h > 0) THEN 'too_many_letters_for_area' WHEN preserved >= 20 AND photos_of_piece < preserved * 0.1 THEN 'letters_without_ink' WHEN photos_of_piece >= 60 AND preserved <= 3 THEN 'ink_without_letters' END AS flag FROM prs WHERE w IS NOT NULL AND h IS NOT NULL"
)
def quality_flags(spark, sf):
    """Reasons to doubt a link, with a density limit of three times the 95th percentile."""
    area = F.col("w").cast("double") * F.col("h")
    d = K.pairs(spark, sf).where("w is not null and h is not null").select("name", "preserved", F.col("photos_of_piece").alias("blobs"), area.alias("area"), F.try_divide(F.col("preserved").cast("double"), area / 1e6).alias("density"))
    limit = d.where("preserved >= 10 and density is not null").agg((F.expr("percentile(density, 0.95D)") * 3).alias("l")).first()["l"]
    return d.select("name", S.quality_flag(F.col("area"), F.col("density"), F.col("blobs"), F.col("preserved"), F.lit(limit).cast("double")).alias("flag"))


@query(f"WITH {K.WRD}, e AS (SELECT sg, levenshtein({K.BYTES.format('scroll_word')}, {K.BYTES.format('mt')}) AS e, length(mt) AS n FROM wrd WHERE mt IS NOT NULL AND mt <> '') SELECT sg, CAST(sum(e) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS letters, round(sum(e) / sum(n), 6) AS rate FROM e GROUP BY sg")
def micro_error_rate(spark, sf):
    """Edits per letter, summed over a scroll."""
    d = K.words(spark, sf).where("mt is not null and mt <> ''").select("sg", F.levenshtein("scroll_word", "mt").alias("e"), F.length("mt").alias("n"))
    return d.groupBy("sg").agg(F.sum("e").alias("edits"), F.sum("n").alias("letters"), F.round(F.sum("e") / F.sum("n"), 6).alias("rate"))


@query(
    "SELECT name, rec_id, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 WHEN 'test' THEN 3 ELSE 4 END AS tier FROM pairs QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 WHEN 'test' THEN 3 ELSE 4 END, rec_id) = 1"
)
def best_tier(spark, sf):
    """Of a name's records the one of the best tier, the first of equals."""
    t = F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2).when(F.col("split") == "test", 3).otherwise(4)
    d = table(spark, sf, "pairs").select("name", "rec_id", t.alias("tier"))
    return d.groupBy("name").agg(F.min(F.struct("tier", "rec_id")).alias("b")).select("name", "b.rec_id", "b.tier")


@query(f"WITH {CORPUS}, l AS (SELECT sg, substr(letters, i, 1) AS letter FROM (SELECT sg, letters, unnest(range(1, length(letters) + 1)) AS i FROM corpus)) SELECT letter, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM l GROUP BY letter")
def letter_freq(spark, sf):
    return S.letter_frequency(K.corpus_lines(spark, sf), F.col("letters")).withColumn("share", F.round("share", 6))


_LM = f"""{CORPUS}, g AS (SELECT substr('|||' || letters, i, 3) AS ctx, substr('|||' || letters, i + 3, 1) AS letter, count(*) AS n FROM (SELECT letters, unnest(range(1, length(letters) + 1)) AS i FROM corpus) GROUP BY ALL),
 al AS (SELECT unnest(string_split('אבגדהוזחטיכלמנסעפצקרשת', '')) AS letter)"""


def _lm_order(k: int) -> str:
    c = f"substr(ctx, {4 - k}, {k})" if k else "''"
    return f"n{k} AS (SELECT {c} AS c, letter, sum(n) AS n FROM g GROUP BY ALL), t{k} AS (SELECT c, sum(n) AS t FROM n{k} GROUP BY c), p{k} AS (SELECT t.c AS c, al.letter AS letter, (coalesce(n.n, 0) + 0.1) / (t.t + 2.2) AS p FROM t{k} t CROSS JOIN al LEFT JOIN n{k} n ON n.c = t.c AND n.letter = al.letter)"


@query(
    f"WITH {_LM}, {', '.join(_lm_order(k) for k in range(4))}, c AS (SELECT DISTINCT ctx FROM g) SELECT ctx, al.letter AS letter, round(0.05 * p0.p + 0.15 * p1.p + 0.3 * p2.p + 0.5 * p3.p, 8) AS p FROM c CROSS JOIN al JOIN p0 ON p0.letter = al.letter JOIN p1 ON p1.c = substr(ctx, 3, 1) AND p1.letter = al.letter JOIN p2 ON p2.c = substr(ctx, 2, 2) AND p2.letter = al.letter JOIN p3 ON p3.c = ctx AND p3.letter = al.letter"
)
def letter_lm4(spark, sf):
    return S.letter_model(K.corpus_lines(spark, sf), F.col("letters"), H.ALPHABET).withColumn("p", F.round("p", 8))


@query(
    f"WITH {_LINES}, e AS (SELECT rec_id, k AS key, count(*) FILTER (WHERE regexp_matches(marks, '[.u]')) AS visible, max(line) - min(line) + 1 AS span FROM ln GROUP BY ALL) SELECT count(*) AS fragments, round(avg(CASE WHEN visible = span THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN abs(visible - span) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_one, round(avg(CASE WHEN visible < span THEN 1.0 ELSE 0.0 END), 6) AS fewer, round(avg(CASE WHEN visible > span THEN 1.0 ELSE 0.0 END), 6) AS more FROM e"
)
def count_agreement(spark, sf):
    """How often the number of readable lines is that of the lines spanned."""
    d = table(spark, sf, "pairs").where("lines is not null").select("rec_id", F.explode("lines").alias("key", "ls")).select("rec_id", "key", F.posexplode("ls").alias("line", "l"))
    d = d.where("l.text is not null and l.marks is not null")
    g = d.groupBy("rec_id", "key").agg(F.count_if(F.col("l.marks").rlike("[.u]")).alias("v"), (F.max("line") - F.min("line") + 1).alias("s"))
    avg = lambda c: F.round(F.avg(c.cast("double")), 6)
    v, s = F.col("v"), F.col("s")
    return g.agg(F.count("*").alias("fragments"), avg(v == s).alias("exact"), avg(F.abs(v - s) <= 1).alias("within_one"), avg(v < s).alias("fewer"), avg(v > s).alias("more"))


@query(f"WITH {K.WRD} SELECT kind, sg, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, sg) AS r FROM (SELECT kind, sg, count(*) AS n FROM wrd GROUP BY kind, sg)) WHERE r <= 8")
def most_common(spark, sf):
    g = K.words(spark, sf).groupBy("kind", "sg").agg(F.count("*").alias("n"))
    return R.top_per_group(g, ["kind"], [F.desc("n"), F.col("sg")], 8).drop("rank")


@query(f"WITH {_LN} SELECT sg, round(sum(share_rec * length) / sum(length), 6) AS share FROM rl WHERE length IS NOT NULL AND share_rec IS NOT NULL GROUP BY sg")
def weighted_mean(spark, sf):
    d = restored(spark, sf).where("length is not null and share_rec is not null")
    return d.groupBy("sg").agg(F.round(F.sum(F.col("share_rec") * F.col("length")) / F.sum("length"), 6).alias("share"))


@query(f"WITH {_LN}, r AS (SELECT line_key, abs(z) AS loss, row_number() OVER (ORDER BY abs(z) DESC, line_key) AS r, count(*) OVER () AS n FROM rl WHERE z IS NOT NULL) SELECT line_key, r > floor(0.15 * n) AS kept FROM r")
def prune_worst(spark, sf):
    d = restored(spark, sf).where("z is not null").select("line_key", F.abs("z").alias("loss"))
    return S.prune_worst(d, "loss", "line_key", 0.15).select("line_key", "kept")


@query(
    f"WITH {PRS}, b AS (SELECT {_BAND} AS band, cast(preserved AS DOUBLE) AS score, instr('13579bdf', substr(md5(manuscript), 1, 1)) > 0 AS odd FROM prs WHERE preserved IS NOT NULL AND manuscript IS NOT NULL), p AS (SELECT (1 + (SELECT count(*) FROM b n WHERE NOT n.odd AND n.band = r.band AND n.score >= r.score)) / (1 + (SELECT count(*) FROM b n WHERE NOT n.odd AND n.band = r.band)) AS p FROM b r WHERE r.odd) SELECT count(*) AS tested, round(avg(CASE WHEN p <= 0.01 THEN 1.0 ELSE 0.0 END), 6) AS fp_0_01, round(avg(CASE WHEN p <= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS fp_0_05 FROM p"
)
def half_split_fp(spark, sf):
    d = K.pairs(spark, sf).where("preserved is not null and manuscript is not null").select("manuscript", F.coalesce(L.band(F.col("preserved")), F.lit("none")).alias("band"), F.col("preserved").cast("double").alias("score"))
    out = C.half_split_false_positives(d, "manuscript", ["band"], "score")
    return out.select("tested", *[F.round(c, 6).alias(c) for c in ("fp_0_01", "fp_0_05")])


@query(f"WITH {PRS}, d AS (SELECT coalesce(side, 'none') AS side, CASE WHEN w >= 0 AND w < 1000 THEN 0 WHEN w < 2000 THEN 1 WHEN w < 4000 THEN 2 WHEN w <= 8000 THEN 3 END AS bin FROM prs WHERE w >= 0) SELECT side, bin, count(*) AS n FROM d WHERE bin IS NOT NULL GROUP BY ALL")
def histogram(spark, sf):
    d = K.pairs(spark, sf).withColumn("side", F.coalesce("side", F.lit("none")))
    return S.histogram(d, "w", [0, 1000, 2000, 4000, 8000], ["side"])


# ------------------------------------------------------------------ controls
_RB = f"{PRS}, q AS (SELECT name, preserved AS pq, manuscript AS mq FROM prs WHERE split IN ('val', 'test') AND preserved > 0), c AS (SELECT preserved AS pc, manuscript AS mc, name AS cn FROM prs WHERE split = 'train' AND preserved > 0)"


@query(f"WITH {_RB} SELECT name, count(*) AS n, CAST(sum(pc) AS BIGINT) AS letters FROM q JOIN c ON abs(ln(pc / pq)) <= ln(1.5) + 1e-12 AND mq IS DISTINCT FROM mc GROUP BY name")
def ratio_band_controls(spark, sf):
    """How many controls of similar length each held-out record has, in other manuscripts. Lengths and manuscripts are counted
    first, so the join is over distinct lengths."""
    d = K.pairs(spark, sf).where("preserved > 0").select("name", "split", "manuscript", "preserved")
    q = d.where("split in ('val', 'test')").select("name", F.col("preserved").alias("pq"), F.coalesce("manuscript", F.lit("")).alias("ms"))
    c = d.where("split = 'train'").groupBy(F.col("preserved").alias("pc"), F.coalesce("manuscript", F.lit("")).alias("mc")).agg(F.count("*").alias("k"))
    every = c.groupBy("pc").agg(F.sum("k").alias("k"))
    lengths = R.ratio_band(q.select("pq").distinct(), every, "pq", "pc")
    total = lengths.groupBy("pq").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("pc")).alias("s"))
    own = R.ratio_band(q.select("pq", "ms").distinct(), c.withColumnRenamed("mc", "_mc"), "pq", "pc", extra=F.col("ms") == F.col("_mc"))
    own = own.groupBy("pq", "ms").agg(F.sum("k").alias("n_own"), F.sum(F.col("k") * F.col("pc")).alias("s_own"))
    out = q.join(total, "pq").join(own, ["pq", "ms"], "left").select("name", (F.col("n") - F.coalesce("n_own", F.lit(0))).alias("n"), (F.col("s") - F.coalesce("s_own", F.lit(0))).alias("letters"))
    return out.where("n > 0")


@query(f"WITH {_RB}, j AS (SELECT name, cn AS control, row_number() OVER (PARTITION BY name ORDER BY round(abs(ln(pc / pq)), 12), CASE WHEN pc < pq THEN 0 ELSE 1 END, CASE WHEN pc < pq THEN -r ELSE r END) AS rank FROM q, (SELECT *, row_number() OVER (ORDER BY pc, cn) AS r FROM c)) SELECT name, control, CAST(rank AS INTEGER) AS rank FROM j WHERE rank <= 20")
def nearest_fallback(spark, sf):
    """The 20 controls nearest in log length."""
    d = K.pairs(spark, sf).where("preserved > 0")
    q = d.where("split in ('val', 'test')").select("name", F.col("preserved").alias("pq"))
    c = d.where("split = 'train'").select(F.col("name").alias("control"), F.col("preserved").alias("pc"))
    return R.nearest_by_ratio(q, c, "name", "pq", "pc", "control").select("name", "control", "rank")


@query(f"WITH {_RB}, n AS (SELECT name, pq, count(pc) AS n, CAST(sum(pc) AS BIGINT) AS letters FROM q LEFT JOIN c ON abs(ln(pc / pq)) <= ln(1.05) + 1e-12 GROUP BY name, pq), j AS (SELECT q.name AS name, pc, row_number() OVER (PARTITION BY q.name ORDER BY round(abs(ln(pc / pq)), 12), CASE WHEN pc < pq THEN 0 ELSE 1 END, CASE WHEN pc < pq THEN -r ELSE r END) AS rank FROM q, (SELECT *, row_number() OVER (ORDER BY pc, cn) AS r FROM c)) SELECT name, false AS near, n, letters FROM n WHERE n >= 20 UNION ALL SELECT name, true, count(*), CAST(sum(pc) AS BIGINT) FROM j WHERE rank <= 20 AND name IN (SELECT name FROM n WHERE n < 20) GROUP BY name")
def matched_controls(spark, sf):
    """Controls of nearly the same length, or the 20 nearest where there are fewer than 20: how many, and their letters."""
    d = K.pairs(spark, sf).where("preserved > 0")
    q = d.where("split in ('val', 'test')").select("name", F.col("preserved").alias("pq"))
    c = d.where("split = 'train'").select(F.col("name").alias("control"), F.col("preserved").alias("pc"))
    return R.matched_totals(q, c, "name", "pq", "pc", "control", 1.05).withColumnRenamed("total", "letters")


@query(f"WITH {_LN}, k AS (SELECT line_key, sg, row_number() OVER (PARTITION BY sg ORDER BY md5('7|' || line_key), line_key) AS r FROM rl WHERE sg IS NOT NULL) SELECT line_key, sg FROM k WHERE r <= 3")
def hash_sample(spark, sf):
    """Three lines of each scroll in a repeatable random order (decoys)."""
    return C.hash_sample(restored(spark, sf).where("sg is not null").select("line_key", "sg"), ["sg"], 3, "7", "line_key")


@query(
    f"WITH {_LN}, p AS (SELECT line_key, i, substr(text, i, 1) AS c FROM (SELECT line_key, text, unnest(range(1, length(text) + 1)) AS i FROM rl WHERE text IS NOT NULL)), r AS (SELECT line_key, rep, i, c, md5('0|' || line_key || '|' || rep || '|' || i) AS h FROM p, range(2) t(rep)), o AS (SELECT *, row_number() OVER (PARTITION BY line_key, rep ORDER BY h, i) AS o FROM r) SELECT line_key, CAST(rep AS INTEGER) AS rep, string_agg(c, '' ORDER BY o) AS text FROM o GROUP BY line_key, rep"
)
def shuffled_controls(spark, sf):
    """Two permutations of each line's letters, which stay in the line's row."""
    letters = F.transform(F.split("text", ""), lambda c, i: F.named_struct(F.lit("i"), i + 1, F.lit("c"), c))
    d = restored(spark, sf).where("text <> ''").select("line_key", F.explode(F.array(F.lit(0), F.lit(1))).alias("rep"), letters.alias("a"))
    return d.select("line_key", "rep", F.array_join(F.transform(C.shuffled(F.col("a"), "i", "0", "line_key", "rep"), lambda x: x["c"]), "").alias("text"))


@query(
    f"WITH {CORPUS}, c AS (SELECT line_key, sg, letters, floor(ln(length(letters)) / ln(1.2)) AS b, md5('9|' || line_key) AS h FROM corpus WHERE sg IS NOT NULL AND length(letters) > 0), n AS (SELECT line_key, sg, letters, lead(line_key) OVER w AS other, lead(sg) OVER w AS sg2, lead(letters) OVER w AS t FROM c WINDOW w AS (PARTITION BY b, substr(h, 1, 1) ORDER BY h, line_key)) SELECT line_key, other, round(levenshtein({K.BYTES.format('letters')}, {K.BYTES.format('t')}) / length(letters), 6) AS err FROM n WHERE sg2 <> sg"
)
def random_partners(spark, sf):
    """A random line of another scroll and of like length for each line, and how far apart they are: the baseline of error rates.
    Lines of a band of lengths are taken in a random order, in sixteen parts."""
    from pyspark.sql import Window

    c = K.corpus_lines(spark, sf).where("sg is not null and length(letters) > 0")
    c = c.select("line_key", "sg", "letters", F.floor(F.log(F.length("letters").cast("double")) / F.log(F.lit(1.2))).alias("b"), F.md5(F.concat_ws("|", F.lit("9"), "line_key")).alias("h"))
    w = Window.partitionBy("b", F.substring("h", 1, 1)).orderBy("h", "line_key")
    n = c.select("line_key", "sg", "letters", F.lead("line_key").over(w).alias("other"), F.lead("sg").over(w).alias("sg2"), F.lead("letters").over(w).alias("t"))
    return n.where("sg2 <> sg").select("line_key", "other", F.round(F.levenshtein("letters", "t") / F.length("letters"), 6).alias("err"))
