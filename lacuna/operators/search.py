"""Text search: symbols with barriers, exact containment, ordered windows, likelihood-ratio tables, clear winners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hebrew import fold, signs
from .sequences import windows_of
from .skew import distributed_rank, salted_join

EPSILON = 0.02


def symbols(lines: DataFrame, group: Sequence[str], order: str, text: Column, marks: Column, barrier: str = "|") -> DataFrame:
    """(group, symbols): the lines of a fragment in order as folded letters and barriers. Each reconstructed letter is one
    barrier, so distances over it are kept; a gap of unknown length is one barrier, unless one stands there already; and one
    closes the fragment."""
    one = F.transform(
        signs(text, marks),
        lambda x: F.when(x["k"].isin(".", "u"), F.when(x["c"].rlike("^[א-ת]$"), fold(x["c"])).otherwise(F.lit(""))).when(x["k"] == "r", F.lit(barrier)).when(x["k"].isin("#", "p"), F.lit("~")).otherwise(F.lit("")),
    )
    d = lines.select(*group, F.col(order).alias("_o"), F.array_join(one, "").alias("_s"))
    g = d.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_s"))), lambda x: x["_s"]), "").alias("s"))
    s = F.regexp_replace(F.regexp_replace("s", r"\|~+", "|"), "~+", "|")
    return g.select(*group, F.concat(s, F.lit(barrier)).alias("symbols"))


def contained(queries: DataFrame, corpus: DataFrame, run: str, doc: str, text: str, seed: int) -> DataFrame:
    """queries ⋈ places in the corpus at which the run stands, overlapping ones too: (queries' columns, doc, pos). The first
    `seed` letters are joined by equality and the rest is compared; runs shorter than the seed find nothing. A seed that very
    many places have is spread over tasks."""
    w = windows_of(corpus, [doc], text, seed).withColumnRenamed("gram", "_g")
    q = queries.where(F.length(run) >= seed).withColumn("_g", F.substring(run, 1, seed))
    hit = salted_join(w, q, ["_g"], [doc, "pos"], "inner").join(corpus.select(doc, F.col(text).alias("_t")), doc)
    return hit.where(F.substring("_t", F.col("pos") + 1, F.length(run)) == F.col(run)).drop("_g", "_t")


#: A letter of a pattern that may be any one.
ANY = "[^ |]"


def pattern_classes(pattern: str) -> list[str]:
    """The letters of a pattern as classes: `?` is any letter, `[..]` one of those inside; the rest stands for itself."""
    import re

    return [ANY if x == "?" else x if x.startswith("[") else re.escape(x) for x in re.findall(r"\[[^\]]+\]|.", pattern)]


def ordered_window(df: DataFrame, key: str, text: str, patterns: Sequence[str], lo: int, hi: int) -> DataFrame:
    """(key, p0, p1, ...): every place of the first pattern, overlapping ones too, from which each next pattern begins lo to hi
    characters after the one before it; of several such places the first counts, without going back. Patterns have `?` and
    `[..]` for letters that aren't sure."""
    first = "".join(pattern_classes(patterns[0]))
    size = len(pattern_classes(patterns[0]))
    t = F.col(text)
    # places are looked for in pieces of pieces of a text, as substrings of long texts are slow
    d = df.where(t.rlike(first)).select(key, t.alias("_t"), F.explode(F.sequence(F.lit(0), F.floor(F.length(t) / 4096).cast("int"))).alias("_c"))
    d = d.withColumn("_b", F.substring("_t", F.col("_c") * 4096 + 1, F.lit(4096 + size - 1))).where(F.col("_b").rlike(first))
    d = d.withColumn("_d", F.explode(F.sequence(F.lit(0), F.least(F.lit(31), F.floor(F.length("_b") / 128).cast("int")))))
    d = d.withColumn("_b", F.substring("_b", F.col("_d") * 128 + 1, F.lit(128 + size - 1))).where(F.col("_b").rlike(first))
    # the letters before the first unsure one are compared before the pattern is
    sure = patterns[0][: min((patterns[0] + "?").index(c) for c in "?[" if c in patterns[0] + "?")]
    begins = lambda i: F.substring("_b", i + 1, F.lit(len(sure))) == sure if sure else F.lit(True)
    at = F.filter(F.sequence(F.lit(0), F.length("_b") - size), lambda i: begins(i) & F.substring("_b", i + 1, F.lit(size)).rlike(f"^{first}$"))
    d = d.where(F.length("_b") >= size).select(key, "_t", "_c", "_d", F.explode(at).alias("_i")).select(key, "_t", (F.col("_c") * 4096 + F.col("_d") * 128 + F.col("_i")).cast("long").alias("p0"))
    for i, x in enumerate(patterns[1:], 1):
        one = pattern_classes(x)
        part = F.substring("_t", (F.col(f"p{i - 1}") + lo + 1).cast("int"), F.lit(hi - lo + len(one)))
        d = d.withColumn("_a", F.regexp_instr(part, F.lit("".join(one)))).where("_a > 0").withColumn(f"p{i}", F.col(f"p{i - 1}") + lo + F.col("_a") - 1).drop("_a")
    return d.drop("_t")


def log_expected(pattern: Column, shares: dict[str, float], letters: Column, least: float = 1e-6) -> Column:
    """ln of how often a pattern is expected by chance among so many letters: each letter has its share, a class the sum of its
    letters', and `?` is sure."""
    part = lambda x: F.when(x == "?", F.lit(1.0)).otherwise(F.aggregate(F.filter(F.split(x, ""), lambda c: ~c.isin("", "[", "]")), F.lit(0.0), lambda s, c: s + F.coalesce(F.try_element_at(known, c), F.lit(least))))
    known = F.create_map(*[F.lit(v) for kv in (shares or {"": 0.0}).items() for v in kv])
    parts = F.regexp_extract_all(pattern, F.lit(r"(\[[^\]]+\]|.)"), 1)
    return F.log(letters.cast("double")) + F.aggregate(parts, F.lit(0.0), lambda s, x: s + F.log(F.least(F.lit(1.0), part(x))))


def llr_table(reading: DataFrame, keys: Sequence[str], index: str, background: DataFrame, eps: float = EPSILON) -> DataFrame:
    """(keys, index, sym, s): ln((P + eps) / sum q (P + eps)) for every symbol of background(sym, q), given reading(keys,
    index, sym, p). Probabilities of a position are scaled to sum 1."""
    k = [*keys, index]
    total = Window.partitionBy(*k)
    r = reading.groupBy(*k, "sym").agg(F.sum("p").alias("p")).withColumn("p", F.col("p") / F.sum("p").over(total))
    bg = [tuple(x) for x in background.select("sym", "q").collect()]  # one row for each letter of the alphabet
    every = F.inline(F.array(*[F.struct(F.lit(a).alias("sym"), F.lit(float(b)).alias("_bg")) for a, b in bg])) if bg else None
    if every is None:
        return reading.select(*k, "sym", F.lit(0.0).alias("s")).limit(0)
    full = r.select(*k).distinct().select(*k, every).join(r, [*k, "sym"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)) + eps)
    den = F.sum(F.col("_bg") * F.col("p")).over(total)
    return full.select(*k, "sym", F.log(F.col("p") / den).alias("s"))


def surprisal(df: DataFrame, key: str, text: Column, model: DataFrame, barrier: str = "|") -> DataFrame:
    """(key, surprisal): mean of -ln p of the letters of a text under a letter model (ctx, letter, p) of all contexts. A letter
    that the model doesn't know isn't counted."""
    padded = F.concat(F.lit(barrier * 3), text)
    grams = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(padded, i, F.lit(4)))
    g = df.where(F.length(text) > 0).select(key, F.explode(grams).alias("_g")).groupBy(key, "_g").agg(F.count("*").alias("_n"))
    g = g.select(key, "_n", F.substring("_g", 1, 3).alias("ctx"), F.substring("_g", 4, 1).alias("letter"))
    j = g.join(model, ["ctx", "letter"])
    return j.groupBy(key).agg((F.sum(-F.log("p") * F.col("_n")) / F.sum("_n")).alias("surprisal"))


def chance_table(reading: DataFrame, keys: Sequence[str], index: str, alphabet: str, eps: float = EPSILON) -> DataFrame:
    """(keys, index, sym, s): P + eps of each symbol, which a letter model is compared with place by place (see `corpus`)."""
    k = [*keys, index]
    r = reading.groupBy(*k, "sym").agg(F.sum("p").alias("p"))
    r = r.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(*k)))
    full = r.select(*k).distinct().withColumn("sym", F.explode(F.split(F.lit(alphabet), ""))).where("sym <> ''").join(r, [*k, "sym"], "left")
    return full.select(*k, "sym", (F.coalesce("p", F.lit(0.0)) + eps).alias("s"))


def context_rows(model: DataFrame, alphabet: str, barrier: str = "|") -> list[list[float]]:
    """The letter model of all contexts as rows by context code, as the corpus search takes it: 24**3 rows, most of them used."""
    n = len(alphabet)
    code = {c: i for i, c in enumerate(alphabet)} | {barrier: n}
    out = [[1.0 / n] * n for _ in range((n + 2) ** 3)]
    for r in model.select("ctx", "letter", "p").collect():  # 23**3 contexts of 22 letters
        a, b, c = (code[x] for x in r["ctx"])
        out[(a * (n + 2) + b) * (n + 2) + c][code[r["letter"]]] = r["p"]
    return out


def clear_best(df: DataFrame, group: Sequence[str], key: str, err: str, most: float, margin: float) -> DataFrame:
    """(group, key, err, second): the best row of each group if its error is at most `most` and the next best one's is at
    least `margin` more (1 if there is none)."""
    w = Window.partitionBy(*group).orderBy(err, key)
    d = df.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    g = d.groupBy(*group).agg(F.min(F.when(F.col("_r") == 1, F.struct(err, key))).alias("b"), F.coalesce(F.min(F.when(F.col("_r") == 2, F.col(err))), F.lit(1.0)).alias("second"))
    out = g.select(*group, F.col("b")[key].alias(key), F.col("b")[err].alias(err), "second")
    return out.where((F.col(err) <= most) & (F.col("second") - F.col(err) >= margin))


def hash_split(df: DataFrame, key: str, seed: str, cuts: Sequence[tuple[str, float]], rest: str = "train") -> DataFrame:
    """(key, part): distinct keys in md5 order; those before each cut's share go to its part, the others to `rest`."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(key)))
    d = df.select(key, h.alias("_h")).withColumn("_all", F.lit(0))
    n = d.count()
    d = distributed_rank(d, ["_all"], F.conv(F.substring("_h", 1, 3), 16, 10).cast("long"), ["_h", key], "_r")
    part = F.lit(rest)
    for name, share in reversed(cuts):
        part = F.when(F.col("_r") < int(share * n), name).otherwise(part)
    return d.select(key, part.alias("part"))
