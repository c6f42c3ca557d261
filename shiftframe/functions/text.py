"""Column functions over strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftframe import constants as C

WHITESPACE = " \t\n\r\x0b\x0c"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def string_gate(text: Column) -> Column:
    """Null for an acceptable string, else the first reason against it."""
    core = stripped(text)
    return F.when(F.coalesce(F.length(core), F.lit(0)) == 0, C.MESSAGE_STRING_EMPTY).when(
        F.length(core) > C.MAX_STRING_LENGTH, C.MESSAGE_STRING_TOO_LONG
    )


def parentheses_balanced(text: Column) -> Column:
    """True when no closing parenthesis comes early and all are closed."""
    only = F.regexp_replace(text, r"[^()]", "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest"))

    def step(state: Column, char: Column) -> Column:
        depth = state["depth"] + F.when(char == "(", 1).when(char == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.least(state["lowest"], depth).alias("lowest"))

    walked = F.aggregate(F.split(only, ""), start, step)
    return F.when(F.length(only) == 0, True).otherwise((walked["depth"] == 0) & (walked["lowest"] >= 0))


def string_lint(text: Column) -> Column:
    """Null for a clean string, else the first reason: empty, characters, parentheses."""
    core = stripped(text)
    return (
        F.when(F.coalesce(F.length(core), F.lit(0)) == 0, C.MESSAGE_STRING_EMPTY)
        .when(~core.rlike(C.STRING_ALPHABET_PATTERN), C.MESSAGE_STRING_CHARACTERS)
        .when(~parentheses_balanced(core), C.MESSAGE_STRING_PARENTHESES)
    )


def half_up(value: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(value + 0.5)


def token_estimate(text: Column, nucleus: Column) -> Column:
    """Rough number of observable atoms in a structure string."""
    plain = F.regexp_replace(text, C.BRACKET_GROUP_PATTERN, "X")
    estimate = F.lit(C.TOKEN_ESTIMATE_OTHER).cast("long")
    for name, pattern in C.ATOM_LETTER_PATTERNS.items():
        count = F.regexp_count(plain, F.lit(pattern)).cast("long")
        if name == "1H":
            count = half_up(count * C.PROTONS_PER_HEAVY_ATOM).cast("long")
        low, high = C.TOKEN_ESTIMATE_RANGE[name]
        if high is not None:
            count = F.least(F.lit(high).cast("long"), count)
        estimate = F.when(nucleus == name, F.greatest(F.lit(low).cast("long"), count)).otherwise(estimate)
    return estimate


def multiplicity_name(label: Column) -> Column:
    name = F.lit(None).cast("string")
    for short, long in C.MULTIPLICITY_NAMES.items():
        name = F.when(label == short, long).otherwise(name)
    return name


def splitting_text(label: Column, neighbors: Column, coupling: Column) -> Column:
    """Readable splitting of a signal; null without a known label or without anything to say."""
    rounded = half_up(neighbors).cast("long")
    counted = F.concat(
        rounded.cast("string"),
        F.when(rounded == 1, " neighbor").otherwise(" neighbors"),
        F.lit(" (n+1 = "),
        (rounded + 1).cast("string"),
        F.lit(" lines)"),
    )
    first = F.when(neighbors > 0, counted).when(label == "s", "no 1H neighbors")
    second = F.when(coupling.isNotNull(), F.format_string("J ≈ %.1f Hz", coupling)).when(
        label == "m", "complex pattern (unresolved)"
    )
    parts = F.concat_ws(" · ", first, second)
    return F.when(F.length(parts) > 0, F.concat(multiplicity_name(label), F.lit(": "), parts))


def reference_id(*parts: Column) -> Column:
    """Short id for an error row that is the same on every run."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)
