"""Secret scan (operator 3, DataFrame functions only).

Base rules give spans of three kinds (:data:`KINDS`). Two first-order Markov
models of characters then judge the remaining long tokens: one of random
strings, one of ordinary words and identifiers. A token of :data:`MIN_TOKEN`
characters or more that no base span touches is a secret of kind ``markov``
when its log-likelihood ratio exceeds :data:`CUT`.

The models are trained from labelled samples of the corpus itself: what the base
rules match is random, the other words of eight characters or more are ordinary.
The samples hold at most about :data:`SAMPLE` documents per class, chosen by a
hash of the id. A model is one count per pair of characters, so it fits an array
of 128 x 128 whole numbers (thousandths of a nat), which makes sums exact.

Spans are found without a UDF: what :func:`split` leaves between the matches
gives their places. Places are code points, the end exclusive; a span of kind
``assign`` is the whole match.

Defined results: a null text counts as empty and has no spans (the digest is
that of the empty text); without samples of both classes no token is added.
Rows are scanned one by one, so repeated rows repeat. Extra columns are ignored
by the query and kept by :func:`scan`.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import unused

# The base rules. Shorter runs than the rules ask for cannot
# match here and would be dropped there, so the two ways agree; ``assign`` is
# matched in full and checked afterwards, since what it consumes counts.
ASSIGN = (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
          r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_CHARS = 6
ANY_RULE = f"{ASSIGN.replace('([A-Z', '(?:[A-Z')}|{ACCESS}|{HEX}"

MIN_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
WORD = r"[A-Za-z0-9+/_=-]{8,}"
ALPHABET = 67
SMOOTH = 0.5
CUT = 10_000  # thousandths of a nat: the odds of a random token are taken as 1 to 22,000
SAMPLE = 2000
_BLOCK = 256


def _matches(text: str, pattern: str, kind: int) -> Column:
    """Array of (s, kind, e, v) of the matches of ``pattern``. Running sums are
    made per block of matches, so that a text with very many stays linear."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    step = "struct(acc.pos + y.p + y.m as pos, concat(acc.out, array(struct(acc.pos + y.p as s, "\
        f"{kind} as kind, acc.pos + y.p + y.m as e, y.v as v))) as out)"
    zipped = (f"zip_with(slice(split({text}, '{quoted}', -1), 1, size(regexp_extract_all({text}, '{quoted}', 0))), "
              f"zip_with(regexp_extract_all({text}, '{quoted}', 0), "
              f"regexp_extract_all({text}, '{quoted}', {1 if kind == 0 else 0}), (m, v) -> struct(m as m, v as v)), "
              "(p, m) -> struct(cast(length(p) as bigint) as p, cast(length(m.m) as bigint) as m, m.v as v))")
    # `x` is bound once by transforming a one-element array.
    body = (f"flatten(transform(sequence(0, cast(floor((size(x) - 1) / {_BLOCK}) as int)), b -> "
            f"aggregate(slice(x, b * {_BLOCK} + 1, {_BLOCK}), "
            f"struct(aggregate(slice(x, 1, b * {_BLOCK}), 0L, (a, y) -> a + y.p + y.m) as pos, "
            "cast(array() as array<struct<s: bigint, kind: int, e: bigint, v: string>>) as out), "
            f"(acc, y) -> {step}, acc -> acc.out)))")
    return F.expr(f"case when {text} rlike '{quoted}' then transform(array({zipped}), x -> {body})[0] "
                  "else cast(array() as array<struct<s: bigint, kind: int, e: bigint, v: string>>) end")


def base_spans(text: str) -> Column:
    """The base spans of the text column named, ordered by start and kind."""
    assign = F.filter(_matches(text, ASSIGN, 0), lambda x: F.length(x["v"]) >= ASSIGN_CHARS)
    return F.array_sort(F.concat(assign, _matches(text, ACCESS, 1), _matches(text, HEX, 2)))


def sample_rank(doc_id: Column) -> Column:
    """Value in [0, 1) by which documents are sampled; any engine can compute it."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") / F.lit(
        float(1 << 32))


def _pairs(tokens: DataFrame) -> dict[str, int]:
    """Counts of neighbouring characters; at most 67 x 67 rows."""
    pairs = tokens.filter(F.length("token") > 1).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substr(F.col("token"), i, F.lit(2)))).alias("pair"))
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count("*").alias("n")).collect()}


class Model:
    """``table[128 * a + b]``: log ratio of b after a, in thousandths."""

    def __init__(self, random: dict[str, int], ordinary: dict[str, int]):
        self.known = bool(random) and bool(ordinary)
        self.table = [0] * (128 * 128)
        totals = []
        for counts in (random, ordinary):
            after = [0] * 128
            for pair, n in counts.items():
                after[ord(pair[0])] += n
            totals.append(after)
        chars = [c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-"]
        for a in chars:
            for b in chars:
                pair = chr(a) + chr(b)
                p, q = ((counts.get(pair, 0) + SMOOTH) / (after[a] + SMOOTH * ALPHABET)
                        for counts, after in zip((random, ordinary), totals))
                self.table[128 * a + b] = math.floor(1000 * math.log(p / q) + 0.5)

    def ratio(self, token: Column) -> Column:
        """Log-likelihood ratio of a token; the table is one literal array."""
        table = F.from_json(F.lit(json.dumps(self.table)), "array<int>")
        place = lambda i: F.ascii(F.substr(token, i, F.lit(1)))
        return F.aggregate(
            F.sequence(F.lit(1), F.length(token) - 1), F.lit(0),
            lambda acc, i: acc + F.element_at(table, place(i) * 128 + place(i + 1) + 1))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Models from documents (doc_id, text): at most about ``sample`` documents
    that hold a base span for the random class, as many of all for the other."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), sample_rank(F.col("doc_id")).alias("u"))
    total, marked = rows.agg(F.count("*"), F.count_if(F.col("text").rlike(ANY_RULE))).first()
    if not marked:
        return Model({}, {})
    hit = rows.filter(F.col("text").rlike(ANY_RULE) & (F.col("u") * marked < sample))
    random = hit.select(F.explode(base_spans("text")).alias("x")).select(F.regexp_extract(
        F.col("x.v"), f"({WORD})", 1).alias("token"))
    plain = rows.filter(F.col("u") * total < sample).select(F.explode(F.regexp_extract_all(
        F.regexp_replace("text", ANY_RULE, " "), F.lit(f"({WORD})"), F.lit(1))).alias("token"))
    return Model(_pairs(random), _pairs(plain))


def scan(docs: DataFrame, model: Model, out: str = "spans") -> DataFrame:
    """``docs`` with the array of spans (s, kind, e, v) in ``out``: place, index
    in :data:`KINDS`, end and value."""
    text, base = unused(docs, "text", "base")
    rows = docs.withColumn(text, F.coalesce(F.col("text"), F.lit(""))).withColumn(base, base_spans(f"`{text}`"))
    if not model.known:
        return rows.withColumnRenamed(base, out).drop(text)
    free = F.filter(_matches(f"`{text}`", TOKEN, 3), lambda c: ~F.exists(
        F.col(base), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    added = F.filter(free, lambda c: model.ratio(c["v"]) > CUT)
    return rows.withColumn(out, F.array_sort(F.concat(F.col(base), added))).drop(text, base)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(docs)).select("doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
