"""Word text: cleaning, sentence marks, hesitations, casing, character counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped from the end of a token before comparison.
TRAILING_MARKS = ".,?!:;\"'"
# Vocalised hesitations.
HESITATIONS = ("um", "umm", "uh", "uhh", "ah", "ahh", "er", "erm")
# Fixed value: an "a" held this long counts as a hesitation.
LONG_A_MS = 350
# Tokens that cannot end a sentence.
NON_ENDERS = tuple(
    """
    the a an of in to for with on at from by about as into like through after over between out against during
    without before under around among and but or nor so yet because although while if when where why how that which
    who whom whose what this these those is are was were be been being have has had do does did can could shall
    should will would may might must am i we you he she it they my your his her its our their than then very
    much more most such only just also mr mrs ms dr prof st vs e.g i.e etc
    """.split()
)


def strip_space(word: Column) -> Column:
    """Remove all white space at both ends; ``trim`` alone would keep tabs and newlines."""
    return F.regexp_replace(word, r"^\s+|\s+$", "")


def clean_token(word: Column) -> Column:
    return F.rtrim(F.lower(F.trim(word)), F.lit(TRAILING_MARKS))


def clean_token_weak(word: Column) -> Column:
    return F.lower(F.trim(word))


def ends_sentence(word: Column) -> Column:
    return word.endswith(".") | word.endswith("?") | word.endswith("!")


def is_hesitation(word: Column, start_ms: Column, end_ms: Column) -> Column:
    token = clean_token(word)
    return token.isin(*HESITATIONS) | ((token == "a") & (end_ms - start_ms >= LONG_A_MS))


def starts_lower(word: Column) -> Column:
    head = F.substring(word, 1, 1)
    return (F.lower(head) == head) & (F.upper(head) != head)


def starts_upper(word: Column) -> Column:
    head = F.substring(word, 1, 1)
    return (F.upper(head) == head) & (F.lower(head) != head)


def lower_first(word: Column) -> Column:
    return F.concat(F.lower(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


def upper_first(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


def sentence_case(word: Column, first: Column, last: Column) -> Column:
    """Capital for the first word of a sentence, full stop for the last one unless it has a terminal mark."""
    opened = F.when(first & starts_lower(word), upper_first(word)).otherwise(word)
    closed = F.when(opened.rlike("[,;:]$"), F.concat(F.rtrim(opened, F.lit(",;:")), F.lit("."))).otherwise(
        F.concat(opened, F.lit("."))
    )
    return F.when(last & (opened != "") & ~ends_sentence(opened), closed).otherwise(opened)


def char_count(word: Column) -> Column:
    """Number of contour points for a word: letters without trailing marks, at least one."""
    kept = F.length(F.rtrim(F.trim(word), F.lit(TRAILING_MARKS)))
    return F.when(kept > 0, kept).otherwise(F.greatest(F.lit(1), F.length(word)))


def display_char_count(word: Column) -> Column:
    """Letters shown one by one: trailing marks and hyphens are split off."""
    return F.length(F.regexp_replace(word, r"""[.,!?;:"'\-]+$""", ""))
