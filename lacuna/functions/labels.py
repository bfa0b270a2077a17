"""Keys and labels of catalogues and corpora, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sigla import siglum

# Fixed value: chapters that are copies of each other.
PARALLELS = [("Ps.18", "2Sam.22"), ("Isa.36", "2Kgs.18"), ("Isa.37", "2Kgs.19"), ("Isa.38", "2Kgs.20"), ("Ps.14", "Ps.53"), ("Ps.105", "1Chr.16"), ("Ps.96", "1Chr.16"), ("Jer.52", "2Kgs.25")]
# Bands of letters read, and the score that each must reach.
BANDS = [(1, 9, 17.7), (10, 19, 25.5), (20, 39, 39.7), (40, None, 44.9)]
LANGUAGES = ("Hebrew", "Aramaic", "Hebrew?", "Aramaic?")


def base_siglum(c: Column) -> Column:
    """A siglum without an appended plate number, if it has the full form <cave>Q<number><letters>-<digits>."""
    m = F.regexp_extract(c, r"^(\d+Q\d+[a-z]*)-\d+$", 1)
    return F.when(m != "", m).otherwise(c)


def link_type(a: Column, b: Column) -> Column:
    """exact, subsiglum (b is a with one or two letters more) or null."""
    x, y = siglum(base_siglum(a)), siglum(b)
    more = F.substring(y, F.length(x) + 1, F.lit(100))
    return F.when(x == y, "exact").when(y.startswith(x) & more.rlike("^[A-Z]{1,2}$"), "subsiglum")


def fragment_label(c: Column) -> Column:
    """'frg. 3 i' as 'f3i', 'col. 4' as '4'."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), r"^frg\.\s*", "f"), r"^col\.\s*", ""), r"\s", "")


def plate_key(c: Column) -> Column:
    """A plate without side and leading stars, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "/(Rec|Vrs)$", ""), r"^\*+", ""))


def manuscript_status(script: Column, language: Column, known: Column) -> Column:
    s = F.coalesce(script, F.lit(""))
    return (
        F.when(~known, "no record")
        .when((s != "") & (s != "Square"), F.concat(F.lit("excluded: "), s, F.lit(" script")))
        .when(~F.coalesce(language.isin(*LANGUAGES), F.lit(False)), F.concat(F.lit("excluded: language '"), F.coalesce(language, F.lit("")), F.lit("'")))
        .when(s == "Square", "square")
        .otherwise("script type blank")
    )


def is_target(ms: Column, composition_type: Column) -> Column:
    """Unidentified texts and collective numbers."""
    return F.coalesce(composition_type == "Unidentified Text", F.lit(False)) | F.coalesce(ms.rlike(r"^\d+Q9999$"), F.lit(False))


def column_base(label: Column) -> Column:
    """The piece of a label that ends in a column numeral, or null."""
    m = F.regexp_extract(label, r"^(f?\d+[a-z]?)(i{1,3}|iv|v|vi{0,3})$", 1)
    return F.when(m != "", m)


def is_assembly(label: Column) -> Column:
    """Plain column numbers and joins of pieces."""
    return label.rlike(r"^\d+[a-z]?$") | label.rlike("[_+]")


def fragment_numbers(label: Column) -> Column:
    """The piece numbers in a label: 'f6+14' as [6, 14], 'f9i_10' as [9, 10]; ranges of fewer than 50 are written out."""

    def part(p: Column) -> Column:
        n = F.transform(F.regexp_extract_all(p, F.lit(r"(\d+)"), 1), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int"))
        a, b = F.get(n, F.lit(0)), F.get(n, F.lit(1))
        spread = p.contains("_") & (F.size(n) == 2) & (b >= a) & (b - a < 50)
        return F.when(F.coalesce(spread, F.lit(False)), F.sequence(a, F.greatest(a, b))).otherwise(n)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.translate(label, "f", ""), r"\+"), part))))


def cave(c: Column) -> Column:
    m = F.regexp_extract(c, r"^(\d+)Q", 1)
    return F.when(m != "", F.concat(m, F.lit("Q"))).when(F.upper(c).startswith("PAM"), "4Q")


def line_number(c: Column) -> Column:
    m = F.regexp_extract(c, r"^(\d+)", 1)
    return F.when(m != "", m.cast("int"))


def band(n: Column, bands=BANDS) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi, *_ in reversed(bands):
        inside = n >= lo if hi is None else (n >= lo) & (n <= hi)
        out = F.when(inside, F.lit(f"{lo}+" if hi is None else f"{lo}-{hi}")).otherwise(out)
    return out


def threshold(n: Column, bands=BANDS) -> Column:
    out = F.lit(None).cast("double")
    for lo, hi, t in reversed(bands):
        inside = n >= lo if hi is None else (n >= lo) & (n <= hi)
        out = F.when(inside, F.lit(t)).otherwise(out)
    return out


def same_place(a: Column, b: Column) -> Column:
    """Two references to the same passage: book.chapter.verse within three verses or in parallel chapters, or the same scroll
    and fragment of 'scroll fragment:line'."""
    verse = a.contains(".") & b.contains(".") & ~a.contains(" ") & ~b.contains(" ")
    ch = lambda c: F.array_join(F.slice(F.split(c, r"\."), 1, 2), ".")
    v = lambda c: F.try_to_number(F.get(F.split(c, r"\."), F.lit(2)), F.lit("999999")).cast("int")
    pair = F.concat_ws("|", F.least(ch(a), ch(b)), F.greatest(ch(a), ch(b)))
    parallel = pair.isin(*["|".join(sorted(p)) for p in PARALLELS])
    scroll = lambda c: F.get(F.split(c, " "), F.lit(0))
    frag = lambda c: F.coalesce(F.get(F.split(F.get(F.split(c, " "), F.lit(1)), ":"), F.lit(0)), F.lit(""))
    out = F.when(verse, F.when(ch(a) == ch(b), F.abs(v(a) - v(b)) <= 3).otherwise(parallel)).otherwise((scroll(a) == scroll(b)) & (frag(a) == frag(b)))
    return F.coalesce(out, F.lit(False))


def hit_parts(ref: Column) -> Column:
    """struct<scroll, fragment> of a place like '4Q58 3:18'; null without a colon."""
    rest = F.substring(ref, F.instr(ref, " ") + 1, F.length(ref))
    return F.when(F.coalesce(ref.contains(":") & ref.contains(" "), F.lit(False)), F.struct(F.get(F.split(ref, " "), F.lit(0)).alias("scroll"), F.get(F.split(rest, ":"), F.lit(0)).alias("fragment")))
