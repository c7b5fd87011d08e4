"""BPE encoding and decoding of whole texts, with chunks that texts share encoded once.

A rolling hash of the last WINDOW bytes cuts texts where it has CUT_BITS leading zero bits, so equal passages are cut
alike wherever they stand. Chunks that occur more than once in the corpus are encoded once; what lies between them is
encoded in one go. A text's tokens are those of its parts in order, with the joins repaired.

Repair: a byte-level BPE splits a text into words first and encodes each by itself. None of its patterns goes on from a
character other than white space to white space, so such a place ends a word in every text that has it ("firm place").
Around each join, the text from a firm place before it to a firm place after it, with one word more on either side, is
encoded again. The words on either side have to come out as they were; if they don't, the window grows. As tokens stand
for bytes, the text of a window is read from the tokens themselves, and no text is moved.

Plan: one pass counts chunks by their hashes; those that repeat are put into a bit map of at most 2^MAX_BITS bits, which
goes to all tasks. Texts without a chunk in the map are encoded where they are read. Chunks in the map are gathered and
encoded once; texts that have some keep references to them and the tokens of what lies between, are joined with the
chunks' tokens, and put together. A full map sends more chunks to the join, and changes no result.

Memory: each Python operator of a stage has a worker of its own in each running task, with its own codec (150 to 190 MB).
So a stage has one at most: ids and, where asked for, the text decoded from them come from one pass, marked as not
deterministic, as Spark would else repeat it for each use of its result.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.llm.common import stored, table

WINDOW = 32
CUT_BITS = 9
LEAST, MOST = 256, 16_384
#: Bits of the map of repeated chunks, as powers of two.
MIN_BITS, MAX_BITS = 16, 26
#: Bytes hashed at once; distinct chunks that a task counts before handing them on; windows whose tokens it remembers.
SLICE = 1 << 20
HELD = 200_000
WINDOWS = 50_000
#: Texts over this many characters are encoded in pieces that end at firm places.
PIECE = 100_000
#: Rows whose results a task hands on at once, and their characters, bytes of parts, or ids, if these are more than one row's.
ROWS = 200
HANDED = 1 << 20
#: Vocabulary files: the tokenizer, and the same vocabulary as byte strings with their ranks.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Characters that all regular expression engines class alike, whatever their Unicode version.
PLAIN = re.compile(r"[\t\n\r -~¡-ɏ]*")
FIRM = re.compile(r"(?<=[!-~])(?=[ \n])")
#: Last bytes of the UTF-8 forms of white space beyond ASCII.
BLANK_ENDS = (0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F)


def _gears() -> np.ndarray:
    """A pseudo-random number for each byte value."""
    return np.array([xxhash.xxh32_intdigest(bytes([i]), 7) for i in range(256)], np.uint32)


GEARS = _gears()


def _candidates(data: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash asks for a cut: hash(i) = sum of GEARS[byte i - k] << k over the last WINDOW bytes."""
    found = []
    for start in range(0, len(data), SLICE):
        first = max(0, start - WINDOW + 1)
        h = GEARS[data[first : start + SLICE]]
        step = 1
        while step < WINDOW:
            wider = h.copy()
            wider[step:] += h[:-step] << np.uint32(step)
            h, step = wider, 2 * step
        at = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + first
        found.append(at[at >= start])
    return np.concatenate(found) + 1 if found else np.zeros(0, np.int64)


def chunks(raw: bytes) -> list[bytes]:
    """raw, UTF-8, cut by its content into chunks of LEAST to about MOST bytes, at characters' edges; the last may be shorter."""

    def whole(p: int) -> int:
        while p < len(raw) and raw[p] & 0xC0 == 0x80:
            p += 1
        return p

    cuts, last = [], 0
    for p in [*_candidates(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]:
        while p - last > MOST:
            last = whole(last + MOST)
            cuts.append(last)
        p = whole(p)
        if p - last >= LEAST or p == len(raw) and p > last:
            cuts.append(p)
            last = p
    return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def name_of(chunk: bytes) -> tuple[int, int]:
    """128-bit hash of a chunk as two signed numbers."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(chunk), ">i8").tolist()
    return a, b


@dataclass(frozen=True)
class Vocabulary:
    """The two vocabulary files, and the special tokens as (id, text), which are read once on the driver."""

    tokenizer: str
    ranks: str
    special: tuple[tuple[int, str], ...]

    @classmethod
    def of(cls, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> Vocabulary:
        added = _tokenizer(tokenizer).get_added_tokens_decoder()
        return cls(tokenizer, ranks, tuple((i, t.content) for i, t in sorted(added.items())))


def _found(path: str) -> str:
    import public_tokenizers

    return path if "/" in path else public_tokenizers.path(path)


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(_found(path))
    out.no_truncation()
    out.no_padding()
    return out


class Codec:
    """Encoder and decoder of one vocabulary.

    Texts of PLAIN characters without special tokens go through the ranks' encoder, which is faster; all others through
    the tokenizer itself, as the two need not agree on what newer characters are. Each is loaded when first needed.
    """

    def __init__(self, vocabulary: Vocabulary | None = None) -> None:
        self.vocabulary = vocabulary or Vocabulary.of()
        self.special = tuple(t for _, t in self.vocabulary.special)
        with open(_found(self.vocabulary.ranks), "rb") as f:
            ranked = [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, f)]
        ranked += [(t.encode(), i) for i, t in self.vocabulary.special]
        self.bytes_of = [b""] * (1 + max(i for _, i in ranked))
        for token, i in ranked:
            self.bytes_of[i] = token
        self.dtype = np.dtype("<u2" if len(self.bytes_of) <= 1 << 16 else "<u4")
        self._windows: dict[bytes, np.ndarray] = {}

    @cached_property
    def tokenizer(self):
        return _tokenizer(self.vocabulary.tokenizer)

    @cached_property
    def plain(self):
        import public_tokenizers
        import tiktoken

        special = {i for i, _ in self.vocabulary.special}
        merges = {token: i for i, token in enumerate(self.bytes_of) if token and i not in special}
        return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    @cached_property
    def opens(self) -> np.ndarray:
        """Whether each token starts with white space."""
        return np.array([t[:1] in (b" ", b"\n") for t in self.bytes_of])

    @cached_property
    def solid(self) -> np.ndarray:
        """Whether each token surely ends with something else than white space."""
        return np.array([bool(t) and (0x20 < t[-1] < 0x7F or t[-1] >= 0x80 and t[-1] not in BLANK_ENDS) for t in self.bytes_of])

    def encode(self, raw: bytes) -> np.ndarray:
        """Token ids of a text in UTF-8."""
        text = raw.decode("utf-8")
        cuts, last = [], 0
        while len(text) - last > PIECE:
            firm = FIRM.search(text, last + PIECE)
            if firm is None:
                break
            last = firm.start()
            cuts.append(last)
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            part = text[a:b]
            plain = PLAIN.fullmatch(part) and not any(s in part for s in self.special)
            out += self.plain.encode_ordinary(part) if plain else self.tokenizer.encode(part, add_special_tokens=False).ids
        return np.array(out, self.dtype)

    def text_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """As the tokenizer's decode(ids, skip_special_tokens=False): bytes that are no UTF-8 become U+FFFD."""
        return self.text_of(ids).decode("utf-8", "replace")

    def _again(self, raw: bytes) -> np.ndarray:
        ids = self._windows.get(raw)
        if ids is None:
            if len(self._windows) >= WINDOWS:
                self._windows.clear()
            ids = self._windows[raw] = self.encode(raw)
        return ids

    def joined(self, parts: list[np.ndarray]) -> np.ndarray:
        """Token ids of the text whose parts, one after the other, have the token ids `parts`."""
        ids = np.concatenate(parts) if parts else np.zeros(0, self.dtype)
        joins = np.cumsum([len(p) for p in parts])[:-1]
        firm = np.flatnonzero(self.opens[ids[1:]] & self.solid[ids[:-1]]) + 1
        joins = np.setdiff1d(joins, np.append(firm, [0, len(ids)]))
        if not len(joins):
            return ids
        edges = np.concatenate([[0], firm, [len(ids)]])
        at = np.searchsorted(edges, joins)  # each join lies between edges[at - 1] and edges[at]
        todo = [[int(a) - 1, int(a)] for a in at]
        out, done = [], 0
        while todo:
            lo, hi = todo.pop(0)
            more = 1
            while True:
                left, right = max(0, lo - more), min(len(edges) - 1, hi + more)
                while todo and todo[0][0] <= right:  # windows that meet become one
                    hi = max(hi, todo.pop(0)[1])
                    right = min(len(edges) - 1, hi + more)
                a, b, c, d = edges[[left, lo, hi, right]].tolist()
                new = self._again(self.text_of(ids[a:d]))
                before, after = b - a, d - c
                if len(new) >= before + after and np.array_equal(new[:before], ids[a:b]) and np.array_equal(new[len(new) - after :], ids[c:d]):
                    break
                if left == 0 and right == len(edges) - 1:
                    return new  # the whole text
                lo, hi, more = left, right, 2 * more
            out += [ids[done:b], new[before : len(new) - after]]
            done = c
        return np.concatenate([*out, ids[done:]])


_CODECS: dict[Vocabulary, Codec] = {}


def codec(vocabulary: Vocabulary) -> Codec:
    """The process's own codec."""
    if vocabulary not in _CODECS:
        _CODECS[vocabulary] = Codec(vocabulary)
    return _CODECS[vocabulary]


def repeated(docs: DataFrame, text_col: str) -> DataFrame:
    """(h1, h2) of the chunks that occur more than once in all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        frame = lambda: pd.DataFrame([(*k, n) for k, n in held.items()], columns=["h1", "h2", "n"])
        for batch in batches:
            for text in batch["text"]:
                held.update(map(name_of, chunks((text or "").encode())))
                if len(held) > HELD:
                    yield frame()
                    held.clear()
        if held:
            yield frame()

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "h1 bigint, h2 bigint, n bigint")
    return counted.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2")


def bit_map(names: DataFrame) -> tuple[int, np.ndarray]:
    """(power of two, words of 64 bits): two bits for each chunk."""
    size = min(MAX_BITS, max(MIN_BITS, 4 + math.ceil(math.log2(1 + names.count()))))
    bits = names.select(F.explode(F.array(*[F.shiftrightunsigned(h, 64 - size) for h in ("h1", "h2")])).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("ones")).toArrow()  # 2 ^ (MAX_BITS - 6) rows at most
    out = np.zeros(1 << (size - 6), np.uint64)
    out[words["word"].to_numpy()] = words["ones"].to_numpy().view(np.uint64)
    return size, out


class Repeats:
    """The bit map of repeated chunks, for tasks."""

    def __init__(self, spark: SparkSession, names: DataFrame) -> None:
        self.size, words = bit_map(names)
        self.words = spark.sparkContext.broadcast(words)  # 2 ^ MAX_BITS bits at most

    def __contains__(self, name: tuple[int, int]) -> bool:
        bits = [(h % (1 << 64)) >> (64 - self.size) for h in name]
        return all(int(self.words.value[b >> 6]) >> (b & 63) & 1 for b in bits)

    def split(self, text: str | None) -> list[tuple[tuple[int, int] | None, bytes]]:
        """(name, bytes) of each repeated chunk, and (None, bytes) of what lies between."""
        out: list[tuple[tuple[int, int] | None, bytes]] = []
        between: list[bytes] = []
        for chunk in chunks((text or "").encode()):
            name = name_of(chunk)
            if name in self:
                if between:
                    out.append((None, b"".join(between)))
                    between = []
                out.append((name, chunk))
            else:
                between.append(chunk)
        return [*out, (None, b"".join(between))] if between else out


def _slices(batches: Iterator[pd.Series], size: Callable = len) -> Iterator[pd.Series]:
    """The rows in small batches, so that results of few and, where rows are long, of few long rows are held at once."""
    for batch in batches:
        start = held = 0
        for i, row in enumerate(batch):
            more = 0 if row is None else size(row)
            if i - start == ROWS or i > start and held + more > HANDED:
                yield batch.iloc[start:i]
                start, held = i, 0
            held += more
        if start < len(batch):
            yield batch.iloc[start:]


RESULT = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("text", "string")
PARTS = T.ArrayType(T.StructType().add("h1", "long").add("h2", "long").add("ids", "binary"))


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", tokenizer: str = TOKENIZER, ranks: str = RANKS, decoded_col: str | None = None) -> DataFrame:
    """docs with ids_col, the token ids of text_col, in place of text_col; decoded_col, if named, is the text that decode() reads from these ids.

    Null texts count as empty ones, which have no tokens. Every row is encoded by itself: repeated rows and null ids
    stay, an empty table gives an empty one. Columns of the caller keep their names and values, whatever these are; one
    named ids_col or decoded_col is replaced. Special tokens that a text spells out are taken as such, as the tokenizer does by default.
    """
    spark, vocabulary = docs.sparkSession, Vocabulary.of(tokenizer, ranks)
    repeats = Repeats(spark, stored(repeated(docs, text_col)))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The repeated chunks, once a task."""
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            out = []
            for text in batch["text"]:
                for name, chunk in repeats.split(text):
                    if name is not None and name not in sent:
                        sent.add(name)
                        out.append((*name, chunk))
                if len(sent) > HELD:
                    sent.clear()
            yield pd.DataFrame(out, columns=["h1", "h2", "chunk"])

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"n1": batch["h1"], "n2": batch["h2"], "tokens": [own.encode(bytes(c)).tobytes() for c in batch["chunk"]]})

    def results(own: Codec, ids: list[np.ndarray | None]) -> pd.DataFrame:
        """RESULT of each row; null for null ids."""
        texts = [None if x is None or decoded_col is None else own.decode(x) for x in ids]
        return pd.DataFrame({"ids": pd.Series([None if x is None else x.astype(np.int32) for x in ids], dtype=object), "text": pd.Series(texts, dtype=object)})

    @F.pandas_udf(RESULT)
    def alone(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        """Results of texts without repeated chunks; null ids for the others."""
        own = codec(vocabulary)
        for batch in _slices(texts):
            split = map(repeats.split, batch)
            yield results(own, [None if any(n is not None for n, _ in parts) else own.encode(parts[0][1] if parts else b"") for parts in split])

    @F.pandas_udf(PARTS)
    def references(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """Names of repeated chunks and token ids of what lies between; null for texts without repeated chunks."""
        own = codec(vocabulary)
        for batch in _slices(texts):
            out = []
            for parts in map(repeats.split, batch):
                some = any(n is not None for n, _ in parts)
                out.append([(*n, None) if n else (None, None, own.encode(raw).tobytes()) for n, raw in parts] if some else None)
            yield pd.Series([x and [dict(zip(("h1", "h2", "ids"), p, strict=True)) for p in x] for x in out], dtype=object)

    @F.pandas_udf(RESULT)
    def joined(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(vocabulary)
        for batch in _slices(parts, lambda row: sum(map(len, row))):
            yield results(own, [own.joined([np.frombuffer(p, own.dtype) for p in row]) for row in batch])

    texts = docs.select(F.col(text_col).alias("text")).mapInPandas(gather, "h1 bigint, h2 bigint, chunk binary").groupBy("h1", "h2").agg(F.first("chunk").alias("chunk"))
    tokens = stored(texts.mapInPandas(encoded, "n1 bigint, n2 bigint, tokens binary"))
    names = [c for c in docs.columns if c not in (text_col, ids_col, decoded_col)]
    rows = docs.select(F.struct(*[F.col(c) for c in names] or [F.lit(None).alias("nothing")]).alias("own"), F.col(text_col).alias("text"))
    done = rows.select("own", alone.asNondeterministic()("text").alias("out")).where("out.ids is not null")  # or else the filter would work it out again
    open_rows = rows.select("own", references.asNondeterministic()("text").alias("parts")).where("parts is not null")
    open_rows = stored(open_rows.withColumn("row", F.monotonically_increasing_id()))
    pieces = open_rows.select("row", "own", F.posexplode("parts").alias("seq", "p")).select("row", F.when(F.col("seq") == 0, F.col("own")).alias("own"), "seq", "p.*")
    met = pieces.where("h1 is not null").join(tokens.hint("merge"), (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2"))).select("row", "own", "seq", F.col("tokens").alias("ids"))
    every = met.unionByName(pieces.where("h1 is null").select("row", "own", "seq", "ids"))
    whole = every.groupBy("row").agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list(F.struct("seq", "ids"))).alias("parts"))  # of one text
    rest = whole.select("own", joined.asNondeterministic()(F.col("parts.ids")).alias("out"))  # or else once for each use of its result
    made = {ids_col: "out.ids"} | ({decoded_col: "out.text"} if decoded_col is not None else {})
    return done.unionByName(rest).select(*[F.col("own")[c].alias(c) for c in names], *[F.col(v).alias(k) for k, v in made.items()])


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "text", tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    """df with text_col, the text of the token ids in ids_col, special tokens included; null ids give the empty text."""

    vocabulary = Vocabulary.of(tokenizer, ranks)

    @F.pandas_udf(T.StringType())
    def decoded(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(vocabulary)
        for batch in _slices(ids):
            yield pd.Series([own.decode(x) if x is not None else "" for x in batch], dtype=object)

    return df.withColumn(text_col, decoded(F.col(ids_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded_col="decoded")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
