"""String expressions: barcodes, labels, contexts, taxa.  Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_prefix(c: Column, *prefixes: str) -> Column:
    """Whether the text begins with any of the prefixes (STR1)."""
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def haemoglobin(c: Column) -> Column:
    """The flag ``^HB[^(P)]``: HB and a third character that isn't ( P or ) (STR2)."""
    return c.rlike("^HB[^(P)]")


def without_suffix(c: Column, suffix: str = "-1") -> Column:
    """The text without that ending (STR3)."""
    return F.when(c.endswith(suffix), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def before(c: Column, mark: str = "-") -> Column:
    """The text before the first mark, or all of it (STR3)."""
    return F.substring_index(c, mark, 1)


def composite(*parts: Column, sep: str = "_") -> Column:
    """A key of several parts; null if any part is null (STR4)."""
    out = parts[0].cast("string")
    for p in parts[1:]:
        out = F.concat(out, F.lit(sep), p.cast("string"))
    return out


def sanitised_label(c: Column) -> Column:
    """Punctuation and blanks to underscores, one for one (STR5)."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")


def sanitised_name(name: str) -> str:
    """A column name without / \\ blank (to _) and brackets (dropped) (STR6)."""
    for a, b in (("/", "_"), ("\\", "_"), (" ", "_"), ("(", ""), (")", ""), ("[", ""), ("]", "")):
        name = name.replace(a, b)
    return name


def listed_bases(c: Column) -> Column:
    """The set in a list cut at , or |; a lone dot, null and blanks are no member (STR7)."""
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", ","), ","), lambda x: F.trim(x))
    return F.when(F.trim(F.coalesce(c, F.lit("."))) == ".", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(parts, lambda x: x != "")))


def in_list(base: Column, listed: Column) -> Column:
    """Whether a base is in the set of :func:`listed_bases` (STR7)."""
    return F.coalesce(F.array_contains(listed_bases(listed), base), F.lit(False))


def second_letter(c: Column) -> Column:
    """The second character, N where there is none (STR8)."""
    return F.when(F.length(c) >= 2, F.substring(c, 2, 1)).otherwise("N")


def reverse_complement(c: Column) -> Column:
    """Null where a base isn't A, C, G or T (STR9)."""
    return F.when(c.rlike("^[ACGT]*$"), F.reverse(F.translate(c, "ACGT", "TGCA")))


def mutation_context(ref: Column, alt: Column, context: Column) -> Column:
    """``5'[R>A]3'`` of a substitution in its trinucleotide, on the strand where
    the reference base is a pyrimidine; null if neither strand has one or the
    context isn't three letters (STR9, STR10)."""
    flipped = ref.isin("A", "G")
    r, a, c = (F.when(flipped, reverse_complement(x)).otherwise(x) for x in (ref, alt, context))
    shown = F.concat(F.substring(c, 1, 1), F.lit("["), r, F.lit(">"), a, F.lit("]"), F.substring(c, 3, 1))
    return F.when(r.isin("C", "T") & (F.length(context) == 3) & ~context.contains("N"), shown)


def taxid(c: Column) -> Column:
    """The number in ``name (taxid 123)``, or the text if it is all digits (STR11)."""
    return F.when(c.rlike(r"^\d+$"), c).otherwise(F.substring(F.regexp_extract(c, r"\(([^)]+)", 1), F.lit(7), F.length(c)))


def second_field(c: Column, sep: str = "|") -> Column:
    """The second part of a name cut at a mark; null if it has one part (STR12)."""
    return F.try_element_at(F.split(c, "\\" + sep), F.lit(2))


def keyword_bucket(c: Column, buckets: list[tuple[str, list[str]]], default: str = "other") -> Column:
    """The first bucket of which a keyword is in the lower-cased text (STR13)."""
    out = None
    for name, words in buckets:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(c).contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def choices(c: Column, prefix: str = "ambiguous:") -> Column:
    """The labels of ``ambiguous:a|b``; of a plain label, itself (STR15)."""
    return F.split(F.when(c.startswith(prefix), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c), r"\|")


def scientific(c: Column) -> Column:
    """As ``{:e}`` prints a number (STR16)."""
    return F.format_string("%e", c.cast("double"))


def cleaned_barcode(c: Column) -> Column:
    """Without commas and carriage returns; null if empty or all N (STR17)."""
    bare = F.regexp_replace(c, "[,\r]", "")
    return F.when(~bare.rlike("^N*$"), bare)


def joined(c: Column, sep: str = ";") -> Column:
    """A list as text (PIV7)."""
    return F.array_join(c, sep)


def parted(c: Column, sep: str = ";") -> Column:
    """Text as a list; null and blanks give no member (PIV7)."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), sep), lambda x: x != "")
