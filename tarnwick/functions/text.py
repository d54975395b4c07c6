"""Text functions: stripping and normalising as Python does, formats, the prompt."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, as ``str.strip`` knows it (fixed pattern).
PY_WS = r"(?U)\A[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+\z"
#: What an answer says when the context is not enough (fixed text).
REFUSAL = "I don't have enough information."


def py_strip(x: Column) -> Column:
    return F.regexp_replace(x, PY_WS, "")


def normalize_answer(x: Column) -> Column:
    """Lower case, no ASCII punctuation, no white space at the ends; inner spaces stay."""
    return py_strip(F.translate(F.lower(x), string.punctuation, ""))


def exact_match(predicted: Column, gold: Column) -> Column:
    """1 or 0; null if either is null."""
    return (normalize_answer(predicted) == normalize_answer(gold)).cast("int")


def passage_block(rank: Column, title: Column, text: Column) -> Column:
    """A passage as the prompt shows it; a null title or text is empty."""
    none = F.lit("")
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), F.coalesce(title, none), F.lit(":\n"), F.coalesce(text, none))


def prompt(context: Column, question: Column) -> Column:
    """Instruction, context, question; an empty context stays an empty section."""
    return F.concat(
        F.lit(f'Use nothing but the context below to answer. Where it does not hold the answer, reply "{REFUSAL}"\n\nContext:\n'),
        context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"),
    )


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals, ties to even as Python's formats have them."""
    return F.call_function("format_number", F.bround(x, places), F.lit("0." + "0" * places))


def blank(x: Column) -> Column:
    return F.length(py_strip(F.coalesce(x, F.lit("")))) == 0


def score_line(rank: Column, title: Column, score: Column) -> Column:
    return F.concat(F.lit("  ["), rank.cast("string"), F.lit("] "), title, F.lit(" (score: "), fixed(score, 4), F.lit(")"))
