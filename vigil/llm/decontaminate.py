"""Benchmark decontamination by template canonicalisation (operator 9, DataFrame
functions only).

Texts become templates: numbers, names and units are replaced by typed
placeholders, letters are lower-cased and punctuation is dropped. Windows of
:data:`WINDOW` template words are hashed; the documents' windows meet the
benchmark's in a hash join. Windows of one document and item that lie on one
diagonal (document place minus item place) make a match when they are enough;
then the values in the placeholders are compared: where the item has one name or
unit, the document must have one, and the other way round, and most numbers must
map likewise. So a copied question is found with other names and numbers in it,
and text that merely has the same shape is left alone.

Beside the templates the words as they stand (lower-cased, without punctuation)
are windows too. Where the template windows of a diagonal are not enough, those
of the words are looked at: they hold all values, so rows of numbers and words
that are names in one text and literals in the other count like others. An item
of which most template windows say nothing (see :func:`_item_windows`) is looked
for by its words alone.

What neither form finds is looked for in a loose form: a run of names is one
placeholder, the item's first word may be a name or not, and diagonals up to
:data:`SHIFT` apart count together. There the values of all windows that agree
must be consistent, a run of names standing for its first; the templates and the
words come first, so the loose form only adds.

A name is a capitalised word after a letter, digit or comma, that is, inside a
sentence; words in capitals are words like others. A unit is one of
:data:`UNITS` after a number.

Every window of every document is looked at, in one pass: the words are hashed,
eight shifted copies of the array are zipped, and a window is hashed when it is
exploded. Words as they stand and runs of names are looked at only in texts that
have placeholders, or runs; elsewhere they are the template's.

The benchmark's windows, and later the documents found, are counted and broadcast
up to :data:`BROADCAST_ROWS` narrow rows; beyond that Spark shuffles. The texts
are read a second time once, for the documents that already match in enough
windows, and cut to the matched places before anything else is done with them.

Defined results: null and empty texts match nothing; an item of fewer than
:data:`SHORTEST` words is never looked for, one of fewer than ``WINDOW`` words
as a whole. Rows of ``docs`` are told apart by doc_id and text, so repeated rows
give one result and a null ``doc_id`` is an id like others. Items that share an
``item_id`` are told apart by their text. Empty tables give an empty result.
Extra columns are ignored by :func:`contaminated` and kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import materialise, scratch, small, unused

WINDOW = 8
SHORTEST = 4
ENOUGH = 6        # windows on a diagonal, that is 13 words ...
SHARE = 0.6       # ... or this share of a shorter item's windows

SHIFT = 2         # diagonals beside the first that count with it in the loose form

TEMPLATE, PLAIN, LOOSE = 0, 1, 2  # forms of a window

PLACES = 2 ** 28           # more than the words of any text, which has less than 2 GB

BROADCAST_ROWS = 300_000  # of ids or windows, tens of bytes each
BROADCAST_MATCHES = 50_000  # of matches with their windows, about a kilobyte each

# Fixed value: words that count as units after a number.
UNITS = ("mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards",
         "mi", "mile", "miles", "mg", "g", "gram", "grams", "kg", "t", "ton", "tons", "oz", "lb", "lbs",
         "pound", "pounds", "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds",
         "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
         "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degree",
         "degrees", "meter", "meters", "metre", "metres")

_WS = r"[\x20\x09-\x0D]"
_NAME, _NUMBER, _UNIT = "\ue000", "\ue001", "\ue002"  # private use: cut from the texts first
_ANY = f"[{_NAME}-{_UNIT}]"


def _has_any(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(c) for c in (_NAME, _NUMBER, _UNIT)])


def _cleared(text: Column) -> Column:
    """Without the characters that stand for placeholders; hardly a text has any."""
    return F.when(_has_any(text), F.regexp_replace(text, _ANY, " ")).otherwise(F.coalesce(text, F.lit("")))


def _template(text: Column, values: bool) -> Column:
    """Words of the template; with ``values`` a placeholder is followed by what
    it stands for. Both forms have the same words in the same places."""
    return F.split(_template_text(text, values), " ")


def _template_text(text: Column, values: bool) -> Column:
    keep = (lambda group: f"${group}") if values else (lambda group: "")
    t = _cleared(text)
    # White space first, then what is before it: cheap where no word starts.
    t = F.regexp_replace(t, rf"({_WS})(?<=[\p{{L}}\p{{N}},;]{_WS})(\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}]*)",
                         f"$1{_NAME}{keep(2)}")
    t = F.regexp_replace(t, r"(\d[\d.,:/]*)", f"{_NUMBER}{keep(1)}")
    t = F.lower(t)
    number = rf"({_NUMBER}[\d.,:/]*{_WS}?)"
    t = F.regexp_replace(t, rf"{number}({'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})(?![\p{{L}}\p{{N}}])",
                         f"$1{_UNIT}{keep(2)}")
    t = F.regexp_replace(t, rf"[^\p{{L}}\p{{M}}\p{{N}}{_NAME}-{_UNIT}\x20\x09-\x0D]+", "")
    return F.btrim(F.regexp_replace(t, f"{_WS}+", " "))


def _plain(text: Column) -> Column:
    """The words as they stand, in the same places as those of the template."""
    t = F.lower(_cleared(text))
    t = F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")
    return F.split(F.btrim(F.regexp_replace(t, f"{_WS}+", " ")), " ")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _row(words: Column, form: int, wanted: Column) -> tuple[Column, Column]:
    """Hashed words and their codes (place, and form above it), both followed by a gap
    as long as what a window may reach beyond the last word; empty if not wanted."""
    low, gap = form * PLACES, F.array_repeat(F.lit(None).cast("bigint"), WINDOW - 1)
    return (F.when(wanted, F.concat(words, gap)).otherwise(F.array().cast("array<bigint>")),
            F.when(wanted, F.sequence(F.lit(low), F.size(words) + (low + WINDOW - 2))).otherwise(F.array().cast("array<int>")))


def _exploded(rows: DataFrame, widths: list[int], *keep: str) -> DataFrame:
    """``rows`` (``hashes`` and ``codes``) as (*keep, place, form, width, hash), one per
    window: eight shifted copies of the hashes are zipped. The code is small, and all
    that is read later is in the zip or in ``keep``, as Spark copies to every window
    what is read beside it."""
    n = F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))
    at = F.arrays_zip(*[F.slice("hashes", k + 1, n).alias(f"w{k}") for k in range(WINDOW)],
                      F.slice("codes", 1, n).alias("code"))
    rows = rows.select(*keep, F.explode(at).alias("at")).filter(F.col("at.w0").isNotNull())
    found = [F.struct(F.lit(w).alias("width"), F.when(
        F.col(f"at.w{w - 1}").isNotNull(), F.xxhash64(*[F.col(f"at.w{k}") for k in range(w)])).alias("hash")) for w in widths]
    place, form = (F.col("at.code") % PLACES).alias("place"), F.floor(F.col("at.code") / PLACES).cast("int").alias("form")
    rows = rows.select(*keep, place, form, (found[0] if len(found) == 1 else F.explode(F.array(*found))).alias("of"))
    return rows.select(*keep, "place", "form", "of.*").filter(F.col("hash").isNotNull())


def _literal(word: Column) -> Column:
    return ~word.rlike(_ANY)


def items_of(benchmark: DataFrame) -> DataFrame:
    """``item_id, ikey, variant, words, values, width, plain, need, need_plain`` of
    every item that can be looked for; variant 0 is the item itself, 1 and 2 are
    its loose forms with a literal and a name as first word; ``ikey`` is a hash of its text. ``need`` is counted
    over the template windows kept and null if those are too few."""
    own = benchmark.select("item_id", F.xxhash64("text").alias("ikey"), "text",
                           _template(F.col("text"), False).alias("words"), _template(F.col("text"), True).alias("values"))
    # After a comma a first word that may be a name is one.
    named = F.concat(F.lit(", "), "text")
    loose = own.unionByName(own.withColumn("words", _template(named, False)).withColumn("values", _template(named, True)))
    loose = loose.withColumn("ends", _ends(F.col("words"))).select(
        "item_id", "ikey", "text", _at(F.col("words"), F.col("ends")).alias("words"),
        _at(F.col("values"), _starts(F.col("ends"))).alias("values")).distinct()
    return (own.withColumn("variant", F.lit(0)).unionByName(
                loose.withColumn("variant", F.when(_literal(F.col("words")[0]), 1).otherwise(2)))
            .withColumn("plain", _plain(F.col("text"))).drop("text")
            .filter((F.size("words") >= SHORTEST) & (F.col("words")[0] != ""))
            .withColumn("width", F.least(F.lit(WINDOW), F.size("words")))
            .withColumn("n_item", F.size("words") - F.col("width") + 1)
            .withColumn("kept", F.size(F.filter(F.sequence(F.lit(1), F.col("n_item")), _telling)))
            .withColumn("need_plain", _share("n_item"))
            .withColumn("need", F.when((F.col("kept") >= F.col("need_plain")) | (2 * F.col("kept") >= F.col("n_item")),
                                       _share("kept")))
            .distinct())


def _ends(words: Column) -> Column:
    """Places of the words without those names that another name follows."""
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda k: ~(
        (F.get(words, k) == _NAME) & F.coalesce(F.get(words, k + 1).startswith(_NAME), F.lit(False))))


def _starts(ends: Column) -> Column:
    """Places of the first words of the runs that end at ``ends``."""
    return F.transform(ends, lambda e, k: F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1))


def _at(words: Column, places: Column) -> Column:
    return F.transform(places, lambda k: F.get(words, k))


def _share(windows: str) -> Column:
    return F.least(F.lit(ENOUGH), F.ceil(F.col(windows) * SHARE)).cast("int")


def _telling(start: Column) -> Column:
    """Whether half of the words of an item's window are literal, as a row of
    placeholders says nothing."""
    return 2 * F.size(F.filter(F.slice("words", start, F.col("width")), _literal)) >= F.col("width")


def _item_windows(items: DataFrame, widths: list[int]) -> DataFrame:
    """(hash, iform, item_id, ikey, variant, width, ipos, need, need_plain): the
    windows kept of the template if those are enough to look for, and all windows
    of the words."""
    keys = ["item_id", "ikey", "variant", "need", "need_plain"]
    template = _row(_hashed(F.col("words")), TEMPLATE, F.col("need").isNotNull())
    plain = _row(_hashed(F.col("plain")), PLAIN, F.col("variant") == 0)
    parts = []
    for w in widths:
        own = items.filter(F.col("width") == w)
        rows = own.select(*keys, "words", "width", F.concat(template[0], plain[0]).alias("hashes"),
                          F.concat(template[1], plain[1]).alias("codes"))
        parts.append(_exploded(rows.withColumnRenamed("width", "w"), [w], *keys, "words", "w"))
    windows = reduce(DataFrame.unionByName, parts)
    return (windows.filter((F.col("form") == PLAIN) | _telling(F.col("place") + 1))
            .select(*keys, "width", F.col("place").alias("ipos"), "hash",
                    F.when(F.col("variant") > 0, LOOSE).otherwise(F.col("form")).alias("iform")))


def _document_windows(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, dkey, dpos, hash, dform, runs): the windows of the template, those
    of the words where a text has placeholders, and those of the loose form where
    it has runs of names; elsewhere these are the template's."""
    words = (docs.select("doc_id", F.xxhash64("text").alias("dkey"), "text", _template_text(F.col("text"), False).alias("t"))
             .withColumn("runs", F.col("t").contains(f"{_NAME} {_NAME}"))
             .withColumn("words", F.split("t", " ")))
    marked = _has_any(F.col("t"))
    forms = [_row(F.col("h"), TEMPLATE, F.lit(True)), _row(F.col("p"), PLAIN, F.col("p").isNotNull()),
             _row(F.col("l"), LOOSE, F.col("l").isNotNull())]
    rows = words.select("doc_id", "dkey", "runs", _hashed(F.col("words")).alias("h"),
                        F.when(marked, _hashed(_plain(F.col("text")))).alias("p"),
                        F.when(F.col("runs"), _hashed(_at(F.col("words"), _ends(F.col("words"))))).alias("l"))
    rows = rows.select("doc_id", "dkey", "runs", F.concat(*[f[0] for f in forms]).alias("hashes"),
                       F.concat(*[f[1] for f in forms]).alias("codes"))
    return (_exploded(rows, widths, "doc_id", "dkey", "runs").drop("width")
            .withColumnsRenamed({"place": "dpos", "form": "dform"}))


def _mapped(pairs: Column) -> Column:
    """How many (item value, document value) pairs exceed a one-to-one map."""
    return (2 * F.size(F.array_distinct(pairs)) - F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"])))
            - F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"]))))


MATCH = "doc_id bigint, dkey bigint, item_id bigint, start bigint, n_windows bigint, n_slots int, n_changed int"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row (doc_id, and ``dkey``, a hash of its text) and
    item found in it: the place of the item's first word, the windows that
    agree, the placeholders compared and those with another value."""
    spark = docs.sparkSession
    with scratch(spark) as inner:
        items = materialise(items_of(benchmark), "decon-items")
        widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # WINDOW numbers at most
        if not widths:
            return spark.createDataFrame([], MATCH)
        item_windows = materialise(_item_windows(items, widths), "decon-item-windows")
        hits = materialise(
            _document_windows(docs, widths).join(small(item_windows, BROADCAST_ROWS), "hash")
            .filter(F.when(F.col("iform") == PLAIN, F.col("dform") != LOOSE)
                    .when(F.col("iform") == TEMPLATE, F.col("dform") == TEMPLATE)
                    .otherwise((F.col("dform") == LOOSE) | (F.col("dform") == TEMPLATE) & ~F.col("runs")))
            .select("doc_id", "dkey", "item_id", "ikey", "variant", "width", "need", "need_plain", "ipos", "iform",
                    (F.col("dpos") - F.col("ipos")).alias("diagonal")).distinct(), "decon-hits")
        found = materialise(_matches(hits).unionByName(_bands(hits)), "decon-matches")
        judged = materialise(_judged(_slots(_cut(docs, found), items)), "decon-judged")
        return inner.keep(materialise(_chosen(judged), "decon-result"))


_PAIR = ["doc_id", "dkey", "item_id", "ikey"]


def _matches(hits: DataFrame) -> DataFrame:
    """Diagonals with enough windows; the words decide only where the templates do not."""
    by_form = [F.struct(F.count_if(own).alias("n_windows"), F.min(F.when(own, F.col("ipos"))).alias("first"),
                        F.max(F.when(own, F.col("ipos"))).alias("last")).alias(name)
               for name, own in (("t", F.col("iform") == TEMPLATE), ("p", F.col("iform") == PLAIN))]
    return (hits.filter(F.col("iform") != LOOSE).groupBy(*_PAIR, "width", "diagonal")
            .agg(*by_form, F.first("need").alias("need"), F.first("need_plain").alias("need_plain"))
            .withColumn("by", F.when(F.col("t.n_windows") >= F.col("need"), TEMPLATE)
                        .when(F.col("p.n_windows") >= F.col("need_plain"), PLAIN))
            .filter(F.col("by").isNotNull())
            .withColumn("of", F.when(F.col("by") == TEMPLATE, F.col("t")).otherwise(F.col("p")))
            .select(*_PAIR, F.lit(0).alias("variant"), "width", "by", "diagonal", "of.n_windows", "of.first", "of.last",
                    F.lit(None).cast("array<struct<ipos:int,diagonal:int>>").alias("at")))


def _bands(hits: DataFrame) -> DataFrame:
    """Bands of diagonals with enough windows of the loose form."""
    return (hits.filter(F.col("iform") == LOOSE)
            .withColumn("band", F.explode(F.sequence(F.col("diagonal") - SHIFT, F.col("diagonal"))))
            .groupBy(*_PAIR, "variant", "width", "band")
            .agg(F.collect_set(F.struct("ipos", "diagonal")).alias("at"), F.first("need").alias("need"))
            .withColumn("n_windows", F.size(F.array_distinct("at.ipos")).cast("long"))
            .filter(F.col("n_windows") >= F.col("need"))
            .select(*_PAIR, "variant", "width", F.lit(LOOSE).alias("by"), F.array_min("at")["diagonal"].alias("diagonal"),
                    "n_windows", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), "at"))


def _cut(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``start`` and ``places``, the document's values at the places of
    the item that are compared (i, b). Repeated document rows give equal rows."""
    same = F.col("tid").eqNullSafe(F.col("doc_id")) & (F.col("tkey") == F.col("dkey"))
    ids = materialise(found.select("doc_id", "dkey").distinct(), "decon-ids")
    texts = (docs.select(F.col("doc_id").alias("tid"), F.xxhash64("text").alias("tkey"), "text")
             .join(small(ids, BROADCAST_ROWS), same, "left_semi")
             .select("tid", "tkey", _template(F.col("text"), True).alias("values"),
                     _template(F.col("text"), False).alias("words"))
             .withColumn("ends", F.when(F.array_contains("words", _NAME), _ends(F.col("words"))))
             .withColumn("starts", _starts(F.col("ends"))).drop("words", "ends"))
    rows = texts.join(small(found, BROADCAST_MATCHES), same)
    # Where the loose form's word j stands; without runs it is word j.
    place = lambda j: F.when(F.col("starts").isNotNull(), F.get("starts", j)).otherwise(j)
    own = F.transform(F.sequence(F.col("first"), F.col("last") + F.col("width") - 1), lambda i: F.struct(
        i.alias("i"), F.get("values", (i + F.col("diagonal")).cast("int")).alias("b")))
    loose = F.array_distinct(F.flatten(F.transform("at", lambda h: F.transform(
        F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.struct(
            (h["ipos"] + k).alias("i"), F.get("values", place((h["ipos"] + h["diagonal"] + k).cast("int"))).alias("b"))))))
    first = F.col("diagonal").cast("int")
    start = F.when(F.col("at").isNotNull() & (first >= 0), F.coalesce(place(first), first)).otherwise(first)
    return rows.select(*_PAIR, "variant", "by", "n_windows", start.cast("long").alias("start"),
                       F.when(F.col("at").isNull(), own).otherwise(loose).alias("places"))


def _slots(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``slots``: (item value, document value) of the places where both have
    placeholders; inside the matched stretch a window that failed may hold others."""
    values = items.select(F.col("item_id").alias("iid"), F.col("ikey").alias("tikey"),
                          F.col("variant").alias("tvariant"), F.col("values"))
    pairs = F.transform("places", lambda p: F.struct(F.get("values", p["i"]).alias("a"), p["b"].alias("b")))
    slots = F.filter(pairs, lambda p: ~_literal(p["a"]) & ~_literal(p["b"]))
    # A generator of one row: what follows reads the slots and does not make them anew.
    return rows.join(values, F.col("item_id").eqNullSafe(F.col("iid")) & (F.col("ikey") == F.col("tikey"))
                     & (F.col("variant") == F.col("tvariant"))).select(
        *_PAIR, "by", "n_windows", "start", F.explode(F.array(slots)).alias("slots"))


def _judged(rows: DataFrame) -> DataFrame:
    """The rows whose ``slots`` map consistently, counted."""
    named = F.filter("slots", lambda p: p["a"].rlike(f"[{_NAME}{_UNIT}]"))
    numbers = F.filter("slots", lambda p: ~p["a"].rlike(f"[{_NAME}{_UNIT}]"))
    return (rows.filter((_mapped(named) == 0) & (2 * _mapped(numbers) <= F.size(numbers)))
            .select(*_PAIR, "by", "n_windows", "start", F.size("slots").alias("n_slots"),
                    F.size(F.filter("slots", lambda p: p["a"] != p["b"])).alias("n_changed")))


def _chosen(rows: DataFrame) -> DataFrame:
    """The best match of a document and an item: by the templates, else by the words,
    else in the loose form; then most windows, then the first place."""
    best = F.max(F.struct(-F.col("by"), "n_windows", -F.col("start"), "n_slots", "n_changed")).alias("best")
    return (rows.groupBy(*_PAIR).agg(best)
            .select("doc_id", "dkey", "item_id", (-F.col("best.col3")).cast("long").alias("start"),
                    "best.n_windows", "best.n_slots", "best.n_changed"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which an item was found; all columns stay."""
    key, gone, gone_key = unused(docs, "key", "gone", "gone_key")
    bad = contaminated(docs, benchmark).select(
        F.col("doc_id").alias(gone), F.col("dkey").alias(gone_key)).distinct()
    own = [F.col(f"`{c}`") for c in docs.columns]
    bad = materialise(bad, "decon-bad")
    return (docs.withColumn(key, F.xxhash64("text"))
            .join(small(bad, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col(gone)) & (F.col(key) == F.col(gone_key)), "left_anti")
            .select(*own))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, benchmark).select(
        "doc_id", "item_id", "start", "n_windows", "n_slots", "n_changed")
