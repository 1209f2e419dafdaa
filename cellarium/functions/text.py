"""Text building blocks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and the plain letters they stand for.
_MARKED = "àáâãäåāăąçćčďèéêëēęěìíîïīıłñńňòóôõöøōőřśšşťùúûüūůűýÿźżž"
_PLAIN = "aaaaaaaaacccdeeeeeeeiiiiiilnnnoooooooorssstuuuuuuuyyzzz"


def unaccent(lowered: Column) -> Column:
    """Lower-case text without the marks on Latin letters; ß, æ and œ become two letters."""
    t = F.translate(lowered, _MARKED, _PLAIN)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def fold(text: Column) -> Column:
    """Lower case without apostrophes and marks."""
    return unaccent(F.lower(F.translate(text, "'’‘`", "")))


def word_tokens(text: Column, shortest: int = 2) -> Column:
    """Distinct words of at least ``shortest`` letters, in order."""
    return F.array_distinct(F.filter(F.split(fold(text), r"[^\p{L}]+"), lambda w: F.length(w) >= shortest))


def name_tokens(text: Column) -> Column:
    """Distinct words of at least three letters and runs of digits, in order."""
    return F.array_distinct(F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 3) | w.rlike(r"^\d+$")))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the whole folded text, padded once with two blanks before and one behind."""
    padded = F.concat(F.lit("  "), fold(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def word_trigrams(text: Column) -> Column:
    """Distinct trigrams of every word, each padded with two blanks before and one behind."""
    words = F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def within_one_edit(a: Column, b: Column) -> Column:
    """Equal up to one insertion, deletion, replacement or swap of neighbours."""
    same_length = F.length(a) == F.length(b)
    differing = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    i, j = F.get(differing, F.lit(0)), F.get(differing, F.lit(1))
    at = lambda x, k: F.substring(x, k, F.lit(1))
    swap = same_length & (F.size(differing) == 2) & (j == i + 1) & (at(a, i) == at(b, j)) & (at(a, j) == at(b, i))
    return (F.levenshtein(a, b) <= 1) | F.coalesce(swap, F.lit(False))


def slug(text: Column, longest: int = 60) -> Column:
    """Lower-case letters and digits joined by hyphens, at most ``longest`` characters."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), 1, longest), "^-+|-+$", "")


def document_id(source: Column, natural_key: Column) -> Column:
    """Stable id of a fetched document."""
    return F.concat(source, F.lit(":"), F.substring(F.sha2(F.concat(source, F.lit("::"), natural_key), 256), 1, 16))


def title_case(text: Column) -> Column:
    """Capitalises words of texts that are all upper case; everything else stays as typed."""
    cap = F.array_join(F.transform(F.split(F.lower(text), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return F.when((F.upper(text) == text) & (F.lower(text) != text), cap).otherwise(text)


# Cyrillic letters that look like Latin ones.
_LOOK_ALIKE = ("АВЕКМНОРСТУХавекмнорстух", "ABEKMHOPCTYXabekmhopctyx")


def latin_look_alikes(text: Column) -> Column:
    """Cyrillic look-alikes as Latin letters."""
    return F.translate(text, *_LOOK_ALIKE)


def upc_variants(code: Column) -> Column:
    """A barcode as read and in its twelve- and thirteen-digit forms, distinct and in that order."""
    digits = F.regexp_replace(code, "[^0-9]", "")
    shorter = F.when((F.length(digits) == 13) & digits.startswith("0"), F.substring(digits, 2, 12))
    longer = F.when(F.length(digits) == 12, F.concat(F.lit("0"), digits))
    return F.array_distinct(F.filter(F.array(digits, shorter, longer), lambda x: x.isNotNull() & (x != "")))


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\u0000"), F.lit(""))


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice share of the multisets of letter pairs."""
    pairs = lambda x: F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    pa, pb = pairs(F.lower(a)), pairs(F.lower(b))
    kinds = F.array_intersect(pa, pb)
    count = lambda arr, k: F.size(F.filter(arr, lambda y: y == k))
    common = F.aggregate(F.transform(kinds, lambda k: F.least(count(pa, k), count(pb, k))), F.lit(0), lambda s, x: s + x)
    total = F.size(pa) + F.size(pb)
    return F.when(total == 0, F.lit(0.0)).otherwise(2 * common / total)


def deletions(word: Column, longest: int | None = None) -> Column:
    """The word without any one letter; empty for words above ``longest`` letters, if that is given."""
    each = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    fits = F.length(word) >= 1 if longest is None else F.length(word).between(1, longest)
    return F.when(fits, each).otherwise(F.array().cast("array<string>"))


#: Words up to this long are keyed by their deletions, whose letters grow with the square of the length;
#: longer ones by their ends, of this many letters each.
DELETED_UP_TO, END = 64, 24


def one_edit_keys(word: Column) -> Column:
    """Keys of which any two words within one edit or swap share at least one.

    Short words: the word and its deletions. Long words: an edit leaves the start or the end as it was.
    Words about as long as the limit have both kinds.
    """
    long = F.length(word) >= DELETED_UP_TO
    ends = F.array(F.concat(F.lit("<"), F.substring(word, 1, END)), F.concat(F.lit(">"), F.substring(word, -END, END)))
    return F.array_distinct(F.concat(F.array(word), deletions(word, DELETED_UP_TO), F.when(long, ends).otherwise(F.array().cast("array<string>"))))
