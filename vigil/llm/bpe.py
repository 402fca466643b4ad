"""Byte-level BPE by a lazily determinised transducer (operator 8).

Encoding. The merge ranks are compiled into a trie of the tokens' bytes and a
table of the last merge of each token. A sequence of tokens is the one that the
merges produce exactly if every two neighbours are (:meth:`Merges.adjacent`), so
a nondeterministic transducer can read a piece byte by byte and guess where
tokens start: a hypothesis is a trie node and the token before it. At each place
one token can end, the last token of the text so far. :class:`Transducer`
determinises this on the fly, as far as the texts need it: a state is the tuple
of live hypotheses, a transition says which token can end there. A hypothesis
dies within the longest token's length, so tokens are certain after that
lookahead and are emitted by walking back over the ends; a long piece is emitted
portion by portion. States are cached per Python process up to
:data:`MAX_STATES` and then dropped together, which costs time and never
changes a result.

Decoding. Tokens become bytes by table; :class:`Utf8Stream` turns any split of
the byte stream into text, holding back at most three bytes.

Defined results: a null or empty text has no tokens; unknown ids raise an
error in the task; :func:`decode` of a null list is empty. Extra columns are
kept by both functions.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import CACHES, chunks, in_task, task

MAX_STATES = 100_000
MAX_PIECES = 160_000
MAX_PAIRS = 200_000
PORTION = 4096   # bytes of a long piece between two emissions
LOW = (1 << 17) - 1
DECODE_BATCH = 8192


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Merges:
    """Tokens, their last merges and which tokens can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[int, int] = {}  # left << 17 | right -> the token they make
        # The trie: node << 8 | byte -> node; a node's token or -1, its depth.
        self.children: dict[int, int] = {}
        self.tokens: list[int] = [-1]
        self.leaf: list[bool] = [False]
        self.depth: list[int] = [0]
        self.size = {r: len(t) for t, r in ranks.items()}
        if max(self.size) >= LOW:
            raise ValueError("too many tokens")
        for token, rank in ranks.items():
            if len(token) > 1:
                halves = self._merge(token, rank)
                if len(halves) != 2:
                    continue  # no sequence of merges makes it
                self.parts[rank] = (halves[0], halves[1])
                self.joined[halves[0] << 17 | halves[1]] = rank
            self._insert(token, rank)
        self.near: dict[int, bool] = {}  # (left + 1) << 17 | right -> what adjacent() has found

    def _insert(self, token: bytes, rank: int) -> None:
        node = 0
        for b in token:
            nxt = self.children.get(node << 8 | b)
            if nxt is None:
                nxt = self.children[node << 8 | b] = len(self.tokens)
                self.depth.append(self.depth[node] + 1)
                self.leaf[node] = False
                self.tokens.append(-1)
                self.leaf.append(True)
            node = nxt
        self.tokens[node] = rank

    def _merge(self, data: bytes, below: int) -> list[int]:
        """The merges of rank under ``below`` applied to ``data``, lowest first."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the merges of the two tokens' bytes give these two tokens (any
        token may follow the start, -1): their merges are undone along the
        boundary, latest first, and no merge across it may come before the one
        undone last."""
        key = left + 1 << 17 | right
        known = self.near.get(key)
        if known is None:
            if len(self.near) > MAX_PAIRS:
                self.near.clear()
            known = self.near[key] = left < 0 or self._check(left, right)
        return known

    def _check(self, left: int, right: int) -> bool:
        # Undoing the merge that made ``left`` forbids a lower rank across the
        # boundary; an equal one would come later, being further right. Undoing
        # the one that made ``right`` forbids an equal rank too.
        below = None
        while True:
            across = self.joined.get(left << 17 | right)
            if across is not None and (below is None or across < below):
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                below, left = left, a[1]
            else:
                below, right = right + 1, b[0]


class Transducer:
    """Numbers packed into ints: a hypothesis is ``node << 17 | last + 1``, a
    cached transition ``state << 8 | byte`` -> ``next state << 17 | token``."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._reset()

    def _reset(self) -> None:
        self.index: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = []
        self.next: dict[int, int] = {}
        self.start = self._intern((0,))

    def _intern(self, hyps: tuple[int, ...]) -> int:
        k = self.index.get(hyps)
        if k is None:
            k = self.index[hyps] = len(self.states)
            self.states.append(hyps)
        return k

    def _step(self, key: int) -> int:
        m, byte, live, done = self.merges, key & 255, [], -1
        go, tokens, leaf, near = m.children.get, m.tokens, m.leaf, m.near.get
        for code in self.states[key >> 8]:
            child = go(code >> 17 << 8 | byte)
            if child is None:
                continue
            last = code & LOW
            if not leaf[child]:
                live.append(child << 17 | last)
            if done < 0 and (token := tokens[child]) >= 0:
                known = near(last << 17 | token)
                if known or (known is None and m.adjacent(last - 1, token)):
                    done = token
        if done < 0:
            raise ValueError("the vocabulary lacks a byte")
        live.append(done + 1)  # a new hypothesis starts at the root
        if len(self.states) > MAX_STATES:
            self._reset()
            return self._intern(tuple(live)) << 17 | done
        value = self.next[key] = self._intern(tuple(live)) << 17 | done
        return value

    def encode(self, piece: bytes) -> list[int]:
        if len(piece) > PORTION:
            return [t for part in self.portions(piece) for t in part]
        ends, state = [], self.start
        for b in piece:
            key = state << 8 | b
            value = self.next.get(key)
            if value is None:
                value = self._step(key)
            ends.append(value & LOW)
            state = value >> 17
        return self._back(ends, len(ends), 0)

    def _back(self, ends: list[int], at: int, stop: int) -> list[int]:
        """The tokens between two places, from the token that ends at each."""
        size, out = self.merges.size, []
        while at > stop:
            t = ends[at - 1]
            out.append(t)
            at -= size[t]
        out.reverse()
        return out

    def portions(self, piece: bytes) -> Iterator[list[int]]:
        """Tokens of a long piece as they become certain: up to the last place
        through which the tokens before every live hypothesis pass."""
        ends: list[int] = []
        state, size = self.start, self.merges.size
        for k in range(0, len(piece), PORTION):
            for b in piece[k:k + PORTION]:
                key = state << 8 | b
                value = self.next.get(key)
                if value is None:
                    value = self._step(key)
                ends.append(value & LOW)
                state = value >> 17
            places = {len(ends) - self.merges.depth[code >> 17] for code in self.states[state]}
            while len(places) > 1 and min(places) >= 0:
                last = max(places)  # a hypothesis never starts later than its rivals' tokens
                places.remove(last)
                places.add(last - size[ends[last - 1]])
            sure = places.pop()
            yield self._back(ends, sure, 0)
            del ends[:sure]
        yield self._back(ends, len(ends), 0)


_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Texts of printable ASCII, Latin-1 letters and the white space of both matchers.
_is_latin = re.compile(f"[\t-\r -~{_LATIN}]*").fullmatch


def latin_pattern(pattern: str) -> str | None:
    """The pattern for such texts only, where letters and numbers are plain
    ranges and the faster standard matcher will do; None if it has other
    properties than those two."""
    plain = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", _LATIN).replace(r"\p{N}", "0-9"), pattern)
    plain = plain.replace(r"\p{L}", f"[{_LATIN}]").replace(r"\p{N}", "[0-9]")
    return None if r"\p" in plain.lower() else plain


class Encoder(dict):
    """piece -> its ids as little-endian int32 bytes, filled on demand. When it
    is full it becomes the old generation, from which pieces still in use are
    taken over."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.ranks = ranks
        self.machine = Transducer(Merges(ranks))
        self.split = regex.compile(pattern).findall
        plain = latin_pattern(pattern)
        self.split_latin = re.compile(plain).findall if plain else self.split

    def __missing__(self, piece: str) -> bytes:
        value = self.old.get(piece)
        if value is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)  # a piece that is a token needs no merges
            ids = (whole,) if whole is not None else self.machine.encode(data)
            value = pack(f"<{len(ids)}i", *ids)
        if len(piece) < 64:
            if len(self) >= MAX_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value

    def shrink(self) -> None:
        """Between tasks only the newer pieces and the transducer are kept."""
        self.old = {}

    def encode(self, text: str) -> bytes:
        split = self.split_latin if _is_latin(text) else self.split
        return b"".join(map(self.__getitem__, split(text)))


class Utf8Stream:
    """Text from bytes that arrive in any portions; a sequence cut in two waits
    for its rest, malformed bytes become U+FFFD as ``bytes.decode`` has it."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """Length of an unfinished sequence at the end of ``data`` (0 to 3)."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                ok = 0xC2 <= b <= 0xF4 and need > back
                if ok and back > 1:
                    second = data[-back + 1]
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                    ok = low <= second <= high
                return back if ok else 0
            if b < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self._open(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.table = {r: t for t, r in ranks.items()}

    def bytes(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def portions(self, ids) -> Iterator[str]:
        """Text, portion by portion, holding one portion at a time."""
        stream = Utf8Stream()
        for k in range(0, len(ids), DECODE_BATCH):
            yield stream.feed(self.bytes(ids[k:k + DECODE_BATCH]))
        yield stream.close()


_CACHE: dict[tuple, object] = {}
CACHES["bpe"] = _CACHE.clear


def _cached(kind, key: tuple, make):
    """One encoder or decoder per Python worker, kept across tasks."""
    if (kind, key) not in _CACHE:
        _CACHE[kind, key] = make()
    return _CACHE[kind, key]


def _id_lists(parts: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts])
    return pa.ListArray.from_arrays(pa.array(ends.astype("i4")),
                                    pa.array(np.frombuffer(b"".join(parts), "<i4")))


class Tokenizer:
    """A rank file read on the driver and sent to the executors (its size is
    that of the vocabulary, not of the data)."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            self.data = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern
        self.key = (path, pattern)

    def encode_udf(self):
        data, key, pattern = self.data, self.key, self.pattern

        @F.arrow_udf("array<int>")
        def encode_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with task("bpe"):
                enc = _cached("encoder", key, lambda: Encoder(read_ranks(data.value), pattern))
                for texts in batches:
                    yield _id_lists([enc.encode(t.as_py() or "") for t in texts])
                enc.shrink()

        return encode_texts

    def round_trip_batches(self, columns: list[str]):
        """Encoding and decoding in one Python worker, a few documents at a time
        whatever Spark's batches are; the columns pass through."""
        data, key, pattern = self.data, self.key, self.pattern

        @in_task("bpe")
        def encode_and_decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc = _cached("encoder", key, lambda: Encoder(read_ranks(data.value), pattern))
            dec = _cached("decoder", key, lambda: Decoder(enc.ranks))
            for batch in batches:
                for start, texts in chunks(batch.column("text")):
                    parts = [enc.encode(t or "") for t in texts]
                    back = [dec.bytes(np.frombuffer(p, "<i4").tolist()) for p in parts]
                    own = [c.slice(start, len(texts)) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*own, _id_lists(parts), pa.array(back, pa.binary())],
                                                     names=[*columns, "token_ids", "decoded"])
            enc.shrink()

        return encode_and_decode

    def checked_batches(self, columns: list[str]):
        """As :meth:`round_trip_batches`, but the texts and the decoded bytes stay
        in the worker, where they are compared: only ids and the outcome go back."""
        both, own = self.round_trip_batches([*columns, "text"]), len(columns)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in both(batches):
                same = [(t.as_py() or "").encode("utf-8", "surrogatepass") == d.as_py()
                        for t, d in zip(batch.column("text"), batch.column("decoded"))]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:own], batch.column("token_ids"), pa.array(same, pa.bool_())],
                    names=[*columns, "token_ids", "round_trip"])

        return compare

    def decode_bytes_udf(self):
        data, key = self.data, self.key

        @F.arrow_udf("binary")
        def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with task("bpe"):
                dec = _cached("decoder", key, lambda: Decoder(read_ranks(data.value)))
                for lists in batches:
                    yield pa.array([dec.bytes(x.values.to_pylist()) if x.is_valid else b"" for x in lists],
                                   pa.binary())

        return decode_ids

    def decode_text_udf(self):
        data, key = self.data, self.key

        @F.arrow_udf("string")
        def decode_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with task("bpe"):
                dec = _cached("decoder", key, lambda: Decoder(read_ranks(data.value)))
                for lists in batches:
                    yield pa.array(["".join(dec.portions(x.values.to_pylist() if x.is_valid else []))
                                    for x in lists], pa.string())

        return decode_texts


def encode(docs: DataFrame, tokenizer: Tokenizer, out: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in ``out``."""
    return docs.withColumn(out, tokenizer.encode_udf()(F.col("text")))


def decode(rows: DataFrame, tokenizer: Tokenizer, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of the ids in ``out``."""
    return rows.withColumn(out, tokenizer.decode_bytes_udf()(F.col(ids)))


def round_trip(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``docs`` with the ids of ``text`` in ``token_ids`` and the bytes that they
    decode to in ``decoded`` (columns of these names are replaced)."""
    docs = docs.drop("token_ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.BinaryType())])
    return docs.mapInArrow(tokenizer.round_trip_batches(docs.columns), schema)


def checked(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``docs`` without ``text``, with its ids in ``token_ids`` and in
    ``round_trip`` whether they decode to the bytes of the text (columns of these
    names are replaced)."""
    own = docs.drop("text", "token_ids", "round_trip")
    schema = T.StructType([*own.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())),
                           T.StructField("round_trip", T.BooleanType())])
    return docs.select(*own.columns, "text").mapInArrow(tokenizer.checked_batches(own.columns), schema)


def ids_text(ids: str):
    """Decimal ids joined by one space."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")


def default_tokenizer(spark: SparkSession) -> Tokenizer:
    import public_tokenizers as P
    return Tokenizer(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = default_tokenizer(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = round_trip(docs, tok)
    return rows.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(ids_text("token_ids"), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
