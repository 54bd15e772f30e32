"""Best-fit packing planned on a histogram of lengths.

Documents are tokenized into pieces. The plan sees only how many pieces have
each length: it places lengths from the longest down, each into the fullest open
sequences that still hold it, whole ranges of equal sequences at a time. A piece
then takes the slot that its rank within its length names. Neither pieces nor
sequences come to the driver: only the histogram does, one row per length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Workspace

CACHE_WORDS = 500_000
#: Rank counters are kept for so many parts of a length, so that a hot length is counted by many tasks.
PARTS = 64
#: A plan of at most so many rows (40 bytes each) is broadcast; a longer one is joined by a shuffle.
PLAN_BROADCAST_ROWS = 200_000
_GAP = re.compile("[ \\n\\t\\r]+")
#: White space of ``str.split`` that stays inside a word here: the tokenizer's own rules apply to it.
_ODD_ASCII = "\x0b\x0c\x1c\x1d\x1e\x1f"
_ODD_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: The vocabulary's pattern of pre-tokens, and what it finds in lower-cased ASCII without white space.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


#: How byte-level vocabularies show bytes: printable ones as themselves, the others by characters from U+0100 on, in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_SHOWN = {b: 256 + i for i, b in enumerate(_HIDDEN)}


def split(text: str) -> list[str]:
    """Words between spaces, tabs, line feeds and carriage returns."""
    odd = any(c in text for c in _ODD_ASCII) or (not text.isascii() and _ODD_SPACE.search(text))
    return [w for w in _GAP.split(text) if w] if odd else text.split()


class WordTokenizer:
    """ids of a vocabulary that never joins text across white space, encoded once per distinct word.

    The cache has two generations of ``CACHE_WORDS`` words, so that frequent words
    outlive it being full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.tokenize = self.model.model.tokenize
        self.ends = {c: self._part(c) for c in ".,;:!?"}
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        known = json.dumps(PRE_TOKENS).encode() in self.model.pre_tokenizer.__getstate__() and all(sum(not c.isalpha() for c in x) > 1 for x in self.special)
        self.plain = known and all(array("I", self.model.encode(w, add_special_tokens=False).ids).tobytes() == self._short(w) for w in ("A", "ÉßŒñ", "It's,", "Ab."))

    def _part(self, part: str) -> bytes:
        """A lower-cased pre-token's ids, by the characters that show its bytes."""
        return array("I", [t.id for t in self.tokenize(part)]).tobytes()

    def _short(self, word: str) -> bytes | None:
        """ids of a word of letters below U+0180 or of printable ASCII; None for others, which take the tokenizer's whole way."""
        if word.isascii():
            if word.isalpha():
                return self._part(word.lower())
            if word[-1] in self.ends and word[:-1].isalpha():
                return self._part(word[:-1].lower()) + self.ends[word[-1]]
            if not word.isprintable() or any(x in word for x in self.special):
                return None
            return b"".join(map(self._part, _ASCII_PRE_TOKEN.findall(word.lower())))
        if word.isalpha() and max(word) < "\u0180" and "\u0130" not in word:
            return self._part(word.lower().encode().decode("latin-1").translate(_SHOWN))
        return None

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older, short = self.known, self.older, self._short
        found, rest = [], []
        for text in texts:
            words = split(text) if text else []
            ids = list(map(known.get, words))
            at = 0
            for _ in range(ids.count(None)):
                at = ids.index(None, at)
                w = words[at]
                x = known.get(w) or older.get(w) or (short(w) if self.plain else None)
                if x is None:
                    rest.append((ids, at, w))
                else:
                    ids[at] = known[w] = x
                at += 1
            found.append(ids)
        if rest:
            known.update(self._whole({w for _, _, w in rest}))
            for ids, i, w in rest:
                ids[i] = known[w]
        return [b"".join(ids) for ids in found]

    def _whole(self, words: set[str]) -> dict[str, bytes]:
        """Words' ids by all of the tokenizer's steps."""
        found, listed = {}, sorted(words)
        for at in range(0, len(listed), 128):
            part = listed[at : at + 128]
            ids: list[list[int]] = [[] for _ in part]
            e = self.model.encode(part, is_pretokenized=True, add_special_tokens=False)
            for i, w in zip(e.ids, e.word_ids, strict=True):
                ids[w].append(i)
            found.update((w, array("I", i).tobytes()) for w, i in zip(part, ids, strict=True))
        return found


@lru_cache(maxsize=1)
def _tokenizer(path: str, run: str) -> WordTokenizer:
    """A Python worker's tokenizer: its tasks in one run share what it has learned."""
    return WordTokenizer(path)


def _pieces(path: str, run_id: str, most: int, end: int, carried: pa.Schema):
    kind = pa.schema([*carried, ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer, last = _tokenizer(path, run_id), np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows, of = [], []
                for i, ids in enumerate(tokenizer.encode_batch(part.column(part.num_columns - 1).to_pylist())):
                    ids += last
                    for p, s in enumerate(range(0, len(ids), 4 * most)):
                        own = ids[s : s + 4 * most]
                        rows.append((p, s // 4, len(own) // 4, zlib.crc32(own)))
                        of.append(i)
                taken = pa.array(of, pa.int64())
                made = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, list(kind)[-4:], strict=True)]
                yield pa.record_batch([*(c.take(taken) for c in part.columns[:-1]), *made], schema=kind)

    return run


def plan(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts: rows (length, first rank, rank after the last, first sequence, offset)."""
    rows, space, rooms, sequences = [], {}, [], 0  # rooms: the sorted keys of space, free tokens -> ranges of sequences

    def put(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in space:
                insort(rooms, free)
            space.setdefault(free, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # no open sequence holds one: open as many as the rest fills, the last perhaps not wholly
                each = most // length
                whole, rest = divmod(n - rank, each)
                for sequences_n, k in ((whole, each), (1, rest)):
                    if sequences_n and k:
                        for j in range(k):
                            rows.append((length, rank, rank + sequences_n, sequences, j * length))
                            rank += sequences_n
                        put(most - k * length, sequences, sequences_n)
                        sequences += sequences_n
                continue
            free = rooms[at]
            first, held = space[free].pop()
            if not space[free]:
                del space[free], rooms[at]
            take = min(held, n - rank)
            rows.append((length, rank, rank + take, first, most - free))
            put(free - length, first, take)
            put(free, first + take, held - take)
            rank += take
    return rows


def pack(docs: DataFrame, work: Workspace, tokenizer: str, most: int = 4096, end: int = 1, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per piece: ``keep``'s columns, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its text (null: none) and then ``end``; longer
    ones are cut every ``most`` ids. Equal or repeated rows keep their pieces, an
    empty table packs into nothing, and other columns aren't read.
    """
    spark, keep = docs.sparkSession, keep or ["doc_id"]
    chosen = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("t"))
    carried = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32()}.get(f.dataType.simpleString(), pa.string())) for f in chosen.schema[:-1]])
    ddl = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in chosen.schema[:-1])
    pieces = work.keep(chosen.mapInArrow(_pieces(tokenizer, work.root, most, end, carried), ddl + "piece int, start long, length long, ids_crc32 long"), "pieces")
    ids = [f"k{i}" for i in range(len(keep))]
    part = F.pmod(F.xxhash64(*ids, "piece", "ids_crc32"), F.lit(PARTS)).cast("int")
    pieces = pieces.withColumn("part", part)
    counted = work.keep(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counted.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``most`` rows
    slots = plan(histogram, most)
    planned = spark.createDataFrame(slots, "of_length long, low long, high long, first long, offset long")
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy(*ids, "piece", "ids_crc32"))
    ranked = pieces.withColumn("within", within).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    if len(slots) <= PLAN_BROADCAST_ROWS:
        planned = F.broadcast(planned)
    out = ranked.join(planned, F.expr("length = of_length and rank >= low and rank < high"))
    return out.select(*(F.col(i).alias(c) for i, c in zip(ids, keep, strict=True)), "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
