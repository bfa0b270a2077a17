"""Letters, marks and labels of transcriptions, as Column functions.

A transcription line is a text and a string of marks of the same length, one mark for each character: preserved, uncertain,
reconstructed, other script, blank, lacuna. The functions work on arrays of (character, mark) and stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet in its order, final forms and their medial ones, and the marks.
ALPHABET = "אבגדהוזחטיכלמנסעפצקרשת"
FINAL, MEDIAL = "ךםןףץ", "כמנפצ"
PRESERVED, UNCERTAIN, RECONSTRUCTED, OTHER_SCRIPT, BLANK, LACUNA = ".", "u", "r", "p", " ", "#"
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8}


def fold(c: Column) -> Column:
    """Final letters as medial ones."""
    return F.translate(c, FINAL, MEDIAL)


def ortho(c: Column) -> Column:
    """Folded, without the three letters that spelling adds or leaves out."""
    return F.translate(fold(c), "ויא", "")


def skeleton(c: Column) -> Column:
    """Without vav and yod."""
    return F.translate(c, "וי", "")


def long_form(c: Column) -> Column:
    """ortho, without a final he after kaf, tav or mem."""
    return F.regexp_replace(ortho(c), "([כתמ])ה$", "$1")


def consonants(c: Column) -> Column:
    """Hebrew letters only."""
    return F.regexp_replace(c, "[^א-ת]", "")


def variant_kind(scroll: Column, base: Column) -> Column:
    """same, orthographic, long_form or substantive, the first that holds; plus without a base word."""
    return (
        F.when(base.isNull() | (base == ""), "plus")
        .when(fold(scroll) == fold(base), "same")
        .when(ortho(scroll) == ortho(base), "orthographic")
        .when(long_form(scroll) == long_form(base), "long_form")
        .otherwise("substantive")
    )


def signs(text: Column, marks: Column) -> Column:
    """array<struct<c, k>>: each character with its mark; the shorter of the two decides."""
    n = F.least(F.length(text), F.length(marks))
    return F.when(
        n > 0,
        F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(text, i, F.lit(1)).alias("c"), F.substring(marks, i, F.lit(1)).alias("k"))),
    ).otherwise(F.array().cast("array<struct<c:string,k:string>>"))


def mark_of(script: Column, reconstructed: Column, uncertain: Column) -> Column:
    """The mark of a sign: other script before reconstructed before uncertain before preserved."""
    on = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    return F.when(on(script), OTHER_SCRIPT).when(on(reconstructed), RECONSTRUCTED).when(on(uncertain), UNCERTAIN).otherwise(PRESERVED)


def _bounds(marks: Column) -> tuple[Column, Column]:
    """First and last place (from 1) of a preserved or uncertain sign; 0 if there is none."""
    kept = F.translate(marks, "u", ".")
    first = F.instr(kept, ".")
    last = F.when(first > 0, F.length(marks) - F.instr(F.reverse(kept), ".") + 1).otherwise(0)
    return first, last


def visible(text: Column, marks: Column) -> Column:
    """struct<label, letters, uncertain, has_gap>: what can be read, from the first to the last preserved sign; null if
    nothing is preserved."""
    a, b = _bounds(marks)
    t, m = F.substring(text, a, b - a + 1), F.substring(marks, a, b - a + 1)
    keep = F.filter(signs(t, m), lambda x: x["k"].isin(PRESERVED, UNCERTAIN, BLANK))
    label = F.trim(F.regexp_replace(F.array_join(F.transform(keep, lambda x: x["c"]), ""), " +", " "))
    out = F.struct(
        label.alias("label"),
        F.length(F.translate(label, " ", "")).alias("letters"),
        F.length(F.regexp_replace(m, "[^u]", "")).alias("uncertain"),
        m.rlike("[r#p]").alias("has_gap"),
    )
    return F.when(a > 0, out)


def preserved_runs(text: Column, marks: Column, least: int = 1) -> Column:
    """Folded runs of preserved letters; blanks are skipped and any other mark ends a run."""
    kept = F.transform(
        signs(text, marks),
        lambda x: F.when(x["k"].isin(PRESERVED, UNCERTAIN) & x["c"].rlike("^[א-ת]$"), fold(x["c"])).when(x["k"] == BLANK, F.lit("")).otherwise(F.lit("|")),
    )
    return F.filter(F.split(F.array_join(kept, ""), r"\|"), lambda r: F.length(r) >= least)


def bracketed(text: Column, marks: Column) -> Column:
    """The line with each reconstructed stretch in brackets and each lacuna as [...]."""
    s = F.array_join(
        F.transform(signs(text, marks), lambda x: F.when(x["k"] == RECONSTRUCTED, F.concat(F.lit("["), x["c"], F.lit("]"))).when(x["k"] == LACUNA, F.lit("[...]")).otherwise(x["c"])), ""
    )
    return F.regexp_replace(s, r"\]\[", "")


def counts(marks: Column) -> dict[str, Column]:
    """How many signs of each kind a string of marks has."""
    n = lambda chars: F.length(marks) - F.length(F.translate(marks, chars, ""))
    return {"preserved": n(".u"), "certain": n("."), "uncertain": n("u"), "reconstructed": n("r"), "other_script": n("p")}


def encode(label: Column) -> Column:
    """Codes of the letters from the end of the label to its start, from 1; others are left out."""
    order = F.split(F.reverse(fold(label)), "")
    return F.filter(F.transform(order, lambda c: F.instr(F.lit(ALPHABET), c)), lambda i: i > 0)


def label_span(label: Column, start: Column, end: Column) -> Column:
    """The part of a label that holds its letters from place `start` to before `end`, blanks not counted; empty if there are none."""
    at = F.filter(F.sequence(F.lit(1), F.length(label)), lambda i: F.substring(label, i, F.lit(1)) != " ")
    a, b = F.get(at, start), F.get(at, end - 1)
    return F.when(F.coalesce((end > start) & (F.length(label) > 0) & a.isNotNull() & b.isNotNull(), F.lit(False)), F.trim(F.substring(label, a, b - a + 1))).otherwise("")
