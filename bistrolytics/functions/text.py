"""Text, number-to-text and lenient-time column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed import ACK_TOKENS, PAD_TOKEN, SPACES


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def run_counts(ordered: Column, value_type: str) -> Column:
    """array<struct<key, n>>: how often each element occurs in a sorted array, in one pass."""

    def counted(xs):
        starts = F.array_compact(F.transform(xs, lambda x, i: F.when((i == 0) | (x != F.get(xs, i - 1)), i)))
        ends = lambda at, i: F.coalesce(F.get(at, i + 1), F.size(xs))
        return bind(
            starts,
            lambda at: F.transform(
                at, lambda a, i: F.struct(F.get(xs, a).cast(value_type).alias("key"), (ends(at, i) - a).cast("long").alias("n"))
            ),
        )

    return bind(ordered, counted)


def tokenise(text: Column) -> Column:
    """Lower-cased white-space tokens; empty or null text gives the pad token.

    All separators become blanks first, so the split needs no regular expression,
    and emptiness is tested at the ends of the raw text, so the work is done once.
    """
    empty = F.coalesce(strip(text), F.lit("")) == ""
    blanks = F.translate(F.lower(F.when(empty, F.lit(PAD_TOKEN)).otherwise(text)), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(blanks, " "), "")


def is_ack(text: Column) -> Column:
    """True for a short confirmation. Punctuation is cut after stripping, so "ok !" is not one."""
    bare = F.regexp_replace(F.lower(strip(text)), "[.!?,;:]+$", "")
    return F.coalesce(bare.isin(*ACK_TOKENS), F.lit(False))


def float_text(value: Column) -> Column:
    """A double as the shortest text that keeps ".0" and uses an exponent only outside 1e-4..1e16."""
    plain = value.cast("string")
    wide = F.regexp_replace(
        F.regexp_replace(plain.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0"
    )
    exponent = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(plain, r"\.0E", "E"), r"E(\d)", "e+$1"), r"E-", "e-"
    )
    exponent = F.regexp_replace(exponent, r"e([+-])(\d)$", "e$10$2")
    size = F.abs(value)
    return (
        F.when((size >= 1e16) | ((size > 0) & (size < 1e-4)), exponent)
        .when((size >= 1e7) | ((size > 0) & (size < 1e-3)), wide)
        .otherwise(plain)
    )


def epoch_seconds(text: Column, otherwise: Column) -> Column:
    """ISO-8601 text to whole epoch seconds; unreadable text takes ``otherwise`` (a timestamp)."""
    return F.unix_seconds(F.coalesce(text.try_cast("timestamp"), otherwise.cast("timestamp")))


def wall_clock_date(text: Column) -> Column:
    """The date as written in ISO text, whatever its offset; null when unreadable."""
    return F.when(text.try_cast("timestamp").isNotNull(), F.substring(text, 1, 10).try_cast("date"))


def truthy(value: Column, kind: str) -> Column:
    """Null out values that count as missing: 0, empty text, false."""
    empty = {"string": F.lit(""), "boolean": F.lit(False)}.get(kind, F.lit(0).cast(kind))
    return F.nullif(value.try_cast(kind), empty)
