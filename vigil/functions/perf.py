"""Display text and metric parsing of a check output.

``output`` is ``<display text>|<k>=<v>,<k>=<v>,...``. Only the first ``|``
separates; tokens without ``=`` are dropped; key and value are trimmed of
Unicode white space; a value that is not a 32-bit float in the accepted
grammar becomes 0.0 and is flagged ``parse_ok = false``.

Every step is linear in the text: split at commas, cut at the first ``=``,
trim by character set. No regular expression sees untrimmed text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted float grammar (Java regex), the signed-NaN form,
# and WS, the Unicode White_Space characters trimmed from keys and values.
FLOAT_GRAMMAR = (r"^[+-]?([0-9]++(\.[0-9]*+)?([eE][+-]?[0-9]+)?|\.[0-9]++([eE][+-]?[0-9]+)?"
                 r"|(?i:inf|infinity|nan))\z")
SIGNED_NAN = r"^[+-]?(?i:nan)\z"
WS = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                       0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

_MAX_LEN = 2 ** 31 - 1


def _after_first(c: Column, sep: str) -> Column:
    """Text after the first ``sep``; empty string when ``sep`` is absent."""
    at = F.instr(c, sep)
    return F.when(at > 0, c.substr(at + 1, F.lit(_MAX_LEN))).otherwise(F.lit(""))


def display_text(output: Column) -> Column:
    """Everything before the first ``|`` (untrimmed); whole text if none."""
    return F.substring_index(output, "|", 1)


def metric_text(output: Column) -> Column:
    return _after_first(output, "|")


def parse_f32(text: Column) -> Column:
    """Guarded float parse: null when ``text`` is outside the grammar."""
    ok = text.rlike(FLOAT_GRAMMAR)
    return (F.when(~ok, F.lit(None).cast("float"))
            .when(text.rlike(SIGNED_NAN), F.lit(float("nan")).cast("float"))
            .otherwise(text.try_cast("float")))


def metric_tokens(output: Column) -> Column:
    """The ``k=v`` tokens as written, in order."""
    return F.filter(F.split(metric_text(output), ",", -1), lambda t: F.contains(t, F.lit("=")))


def token_key(token: Column) -> Column:
    return F.btrim(F.substring_index(token, "=", 1), F.lit(WS))


def token_value(token: Column) -> Column:
    """Trimmed text after the first ``=`` (not yet parsed)."""
    return F.btrim(_after_first(token, "="), F.lit(WS))


def metric_texts(output: Column) -> Column:
    """array<struct<perf_key, pos, text>> of the tokens, in order."""
    return F.transform(metric_tokens(output), lambda t, i: F.struct(
        token_key(t).alias("perf_key"), i.alias("pos"), token_value(t).alias("text")))


def first_texts(texts: Column) -> Column:
    """The first token of every key, ordered by key: equal keys are neighbours
    after the sort, so this is linear but for the sort."""
    return F.transform(F.array(F.sort_array(texts)), lambda s: F.filter(
        s, lambda x, i: (i == 0) | (F.get(s, i - 1)["perf_key"] != x["perf_key"])))[0]


def metric_entries(output: Column) -> Column:
    """array<struct<pos int, perf_key string, perf_value float, parse_ok boolean>>

    ``pos`` is the 0-based position among the kept ``k=v`` tokens.
    """
    parsed = F.transform(metric_texts(output), lambda e: F.struct(
        e["pos"].alias("pos"), e["perf_key"].alias("perf_key"), parse_f32(e["text"]).alias("pf")))
    return F.transform(parsed, lambda e: F.struct(
        e["pos"].alias("pos"),
        e["perf_key"].alias("perf_key"),
        F.coalesce(e["pf"], F.lit(0.0).cast("float")).alias("perf_value"),
        e["pf"].isNotNull().alias("parse_ok")))


def _by_key(entries: Column, first: bool) -> Column:
    """First (or later) entries of every key, in their order of appearance."""
    keyed = F.sort_array(F.transform(entries, lambda e: F.struct(e["perf_key"].alias("k"), e["pos"].alias("p"))))
    positions = F.transform(F.array(keyed), lambda s: F.transform(
        F.filter(s, lambda x, i: ((i == 0) | (F.get(s, i - 1)["k"] != x["k"])) == F.lit(first)), lambda x: x["p"]))[0]
    return F.transform(F.array(F.sort_array(positions)), lambda ps: F.transform(
        ps, lambda p: F.get(entries, p)))[0]


def first_per_key(entries: Column) -> Column:
    """Keep the first entry of every key (row-local duplicate removal)."""
    return _by_key(entries, True)


def later_duplicates(entries: Column) -> Column:
    return _by_key(entries, False)


def metric_map(entries: Column) -> Column:
    """Key-ordered map perf_key -> perf_value (entries must be key-unique)."""
    pairs = F.transform(entries, lambda e: F.struct(e["perf_key"].alias("k"),
                                                    e["perf_value"].alias("v")))
    return F.map_from_entries(F.sort_array(pairs))
