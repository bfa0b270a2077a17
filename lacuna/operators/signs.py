"""Lines and editions out of tables of signs, and verdicts over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hebrew import mark_of


def lines_of_signs(signs: DataFrame, line: Sequence[str]) -> DataFrame:
    """(line, text, marks) from signs(line..., word, sign, glyph, kind, after, script, rec, unc), in the order of (word, sign).

    Missing signs that follow each other are one '#'. A blank follows a word whose last sign has `after` = ' '. Lines without
    any sign but blanks are left out."""
    k = list(line)
    missing = F.col("kind") == "missing"
    text = F.when(missing, "#").otherwise(F.coalesce("glyph", F.lit("")))
    mark = F.when(missing, "#").otherwise(mark_of(F.col("script"), F.col("rec"), F.col("unc")))
    tail = F.when(F.col("after") == " ", " ").otherwise("")
    item = F.struct("word", "sign", F.concat(text, tail).alias("t"), F.concat(F.when(text == "", "").otherwise(F.repeat(mark, F.length(text))), tail).alias("m"))
    g = signs.groupBy(*k).agg(F.array_sort(F.collect_list(item)).alias("a"))
    d = g.select(*k, F.array_join("a.t", "").alias("text"), F.array_join("a.m", "").alias("marks"))
    one = lambda c: F.rtrim(F.regexp_replace(c, "#+", "#"))
    return d.select(*k, one("text").alias("text"), one("marks").alias("marks")).where(F.trim("text") != "")


def edition_text(signs: DataFrame, edition: str, order: Sequence[str]) -> DataFrame:
    """(edition, text): the letters of an edition in order, from signs(edition, order..., letter, attributes: array of
    (kind, value)): only signs that are letters and aren't reconstructed."""
    has = lambda kind, value: F.exists("attributes", lambda a: (a["kind"] == kind) & (a["value"] == value))
    d = signs.where(has("sign_type", "LETTER") & ~has("is_reconstructed", "TRUE"))
    g = d.groupBy(edition).agg(F.array_sort(F.collect_list(F.struct(*order, "letter"))).alias("a"))
    return g.select(edition, F.array_join("a.letter", "").alias("text"))


def numbering(same: Column, shifted: Column, least: float = 0.2) -> Column:
    """Whether labels count as in the text with the same number or as in the next one: same, shifted or unclear."""
    return F.when(same - shifted >= least, "same").when(shifted - same >= least, "shifted").otherwise("unclear")


def hit_kind(same_manuscript: Column, images_of_scroll: Column) -> Column:
    return F.when(same_manuscript, "missing_link").when(F.coalesce(images_of_scroll, F.lit(0)) == 0, "no_image_scroll").otherwise("unlinked_fragment")


def relabelled(verdict: Column, has_hits: Column, own_scroll: Column, own_fragment: Column, related: Column, e: Column) -> Column:
    """A verdict after a search of everything: a hit in the own scroll but another fragment changes it, and 'elsewhere' stands
    only if less than one such hit is expected by chance."""
    inside = F.when(own_fragment, verdict).when(related, "split_record").otherwise("other_frag")
    return F.when(~has_hits, verdict).when(own_scroll, inside).when((verdict == "elsewhere") & (e >= 1), "weak_elsewhere").otherwise(verdict)


def contested(own: Column, other: Column) -> Column:
    """A letter that is read as another one."""
    return (other >= 0.5) & (own < 0.2)


def markdown(df: DataFrame, rows: int = 60) -> str:
    """The first rows as a Markdown table, for a report: a small limit, formatted on the driver."""
    head = df.limit(rows).collect()
    show = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in head)]) + "\n"
