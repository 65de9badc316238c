"""Text clean-up of transcripts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space: whatever Unicode says (the last one is U+3000).
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WHITESPACE = f"[{BLANKS}]"

# Marks that may end an utterance, and marks no blank may precede.
CLOSING_MARKS = [".", "?", "!", ":", ";", ","]
TIGHT_MARKS = ["?", "!", ".", ",", ":", ";"]


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def is_empty_string(text: Column) -> Column:
    """True when only white space and full stops are there."""
    return F.translate(text, BLANKS + ".", "") == ""


def format_punct(text: Column) -> Column:
    """Readable utterance text: capital first letter, closing mark, no ``...``, no blank before
    marks, single blanks, ``I`` for a lone ``i``. The order of the steps decides the result."""
    # the array of one text names the stripped text, so that it is worked out once
    out = F.transform(F.array(strip(text)), _begin_and_close)[0]
    out = F.replace(out, F.lit("..."), F.lit(""))
    for mark in TIGHT_MARKS:
        out = F.replace(out, F.lit(f" {mark}"), F.lit(mark))
    out = F.regexp_replace(F.translate(out, BLANKS, " " * len(BLANKS)), " {2,}", " ")
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}_])i(?![\p{L}\p{N}_])", "I")
    return strip(out)


def _begin_and_close(x: Column) -> Column:
    closed = F.when(F.substring(x, -1, 1).isin(CLOSING_MARKS), F.lit("")).otherwise(F.lit("."))
    first = F.substring(x, 1, 1)
    begun = F.when(first.rlike(r"^\p{Ll}"), F.upper(first)).otherwise(first)
    return F.concat(begun, F.substring(x, F.lit(2), F.length(x)), closed)


def compact_words(text: Column) -> Column:
    """Lower-case words without punctuation, single blanks: the form compared when scoring."""
    return strip(F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}']", " ")), r" +", " "))


def word_array(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, f"{WHITESPACE}+"), lambda w: w != "")
