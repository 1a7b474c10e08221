"""BPE encoding and decoding with a pair occurrence index.

The words of a batch that are not known yet are split into symbols and laid end to end.
An index holds every occurrence of a pair of adjacent symbols in the batch, by rank and
position.  The least occurrence of every word is applied at once, and the neighbours' pairs
are moved in the index.  Of words longer than ``SHORT`` bytes, the ranks that occur wait in a
heap; the smallest is applied at all positions of its pair, and pairs that arise join the heap.

The file names normalization, word pattern, vocabulary and merges (the format of the
tokenizers library); this module does what ``word_bpe_49k.json`` asks for: NFC, white space
to single spaces, lower case by code point, words by pattern, bytes as printable symbols,
and an end-of-word mark.  Special tokens are found in the raw text first.  Decoding joins
the tokens with spaces, as that library does where the file has no decoder.

Defined results: a null text is an empty text, which has no ids and decodes to an empty
text; an unknown id ends the run with an error; empty tables give no rows; repeated rows
have a row each; texts of any length are encoded whole, about half a megabyte at a time; all columns of the
input are kept, but for those that the new ones are named like, which they replace.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import give_back, map_batches

#: What \s matches in the file's patterns.
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Longest word, in bytes, whose merges are done in rounds over all words.
SHORT = 64
#: The rank of a pair that has none.
NONE = 1 << 30


def _byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        known: dict[str, int] = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.end = model["end_of_word_suffix"] or ""
        #: A pair a, b of symbols is known by the number a * size + b.
        self.size = 1 + max((*known.values(), *self.special.values()))
        becomes: dict[int, int] = {}
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            becomes.setdefault(known[a] * self.size + known[b], known[a + b])
        self.pairs = list(becomes)  # by rank
        self.ranks = {pair: rank for rank, pair in enumerate(self.pairs)}
        self.becomes = np.fromiter(becomes.values(), np.int64, len(becomes))
        self.keys = np.array(self.pairs, np.int64)
        self.by_key = np.argsort(self.keys)
        self.keys = self.keys[self.by_key]
        tokens: list[str | None] = [None] * self.size
        for t, i in (known | self.special).items():
            tokens[i] = t
        self.tokens = pa.array(tokens, pa.string())
        symbols = _byte_symbols()
        inner, last = [known.get(s) for s in symbols], [known.get(s + self.end) for s in symbols]
        words = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("[^\\s", f"[^{_SPACE}")
        self.words = regex.compile(words)
        if None in (*inner, *last):
            raise ValueError("the vocabulary lacks a byte")
        self.inner, self.last = np.array(inner, np.int64), np.array(last, np.int64)
        self.spaces = regex.compile(f"[{_SPACE}]+")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def stretches(self, text: str) -> list[str]:
        """The normalized text, parted at white space.  No word of the pattern spans any."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # str.lower() looks at the neighbours of a capital sigma; the file lowers each code point
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        # str.split() would part at four control characters too
        return self.spaces.split(text) if _SEPARATORS.search(text) else text.split()

    def pieces(self, text: str) -> list[str | int]:
        """Stretches without white space and the ids of special tokens, in order."""
        if not (self.specials and "<" in text):
            return self.stretches(text)
        out: list[str | int] = []
        at = 0
        for match in self.specials.finditer(text):
            out += self.stretches(text[at : match.start()])
            out.append(self.special[match.group()])
            at = match.end()
        return out + self.stretches(text[at:])

    def texts_of(self, ids: pa.Array) -> pa.Array:
        """The text of each list of ids; a null list is an empty one."""
        flat = self.tokens.take(ids.flatten())
        if flat.null_count:
            raise ValueError("an id is null or unknown")
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), flat), " ")

    def encode_all(self, stretches: list[str]) -> list[bytes]:
        """The ids of every stretch, four bytes each; its words are merged once however often they occur."""
        found = [self.words.findall(s) for s in stretches]
        words = list(set().union(*found))
        ids = dict(zip(words, self.merge(words), strict=True))
        return [b"".join(map(ids.__getitem__, f)) for f in found]

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of every word, four bytes each, merging over all words at once."""
        data = [word.encode("utf-8", "surrogatepass") for word in words]
        out = [b""] * len(words)
        for long, merged in ((False, self._in_rounds), (True, self._in_turn)):
            which = [i for i, d in enumerate(data) if (len(d) > SHORT) == long]
            if not which:
                continue
            ends = np.cumsum(np.fromiter((len(data[i]) for i in which), np.int64, len(which)))
            laid = np.frombuffer(b"".join([data[i] for i in which]), np.uint8)
            symbols = self.inner[laid]
            symbols[ends - 1] = self.last[laid[ends - 1]]
            left = merged(symbols, np.concatenate(([0], ends[:-1])), ends)
            stay = left >= 0
            cuts = (4 * np.cumsum(stay)[ends - 1]).tolist()
            ids = left[stay].astype(np.int32).tobytes()
            for i, s, e in zip(which, [0, *cuts], cuts, strict=False):
                out[i] = ids[s:e]
        return out

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the pairs; NONE where a pair has none."""
        pairs = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.by_key[at], NONE)

    def _indexed(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each position the rank of the pair that starts there, within its word."""
        ranks = np.full(len(symbols), NONE)
        ranks[:-1] = self._ranks_of(symbols[:-1], symbols[1:])
        ranks[ends - 1] = NONE
        return ranks

    def _in_rounds(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The symbols that stand at each position at last, -1 where none does; a round a merge of the words' longest row of merges.

        The index is an array of occurrences, (rank, position).  In each round the least of every
        word is applied, and the pairs of its neighbours take their new ranks in the index.
        """
        left, place = np.full(len(symbols), -1), np.arange(len(symbols))
        ranks, lengths = self._indexed(symbols, ends), ends - starts
        while len(lengths):
            first = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat((ranks << 32) | np.arange(len(ranks)), first)
            going = least < NONE << 32
            i, merged = least[going] & 0xFFFFFFFF, self.becomes[least[going] >> 32]
            end, start = (first + lengths)[going], first[going]
            symbols[i] = merged
            more = i + 2 < end
            ranks[i] = NONE
            ranks[i[more]] = self._ranks_of(merged[more], symbols[i[more] + 2])
            more = i > start
            ranks[i[more] - 1] = self._ranks_of(symbols[i[more] - 1], merged[more])
            keep = np.repeat(going, lengths)
            left[place[~keep]] = symbols[~keep]
            keep[i + 1] = False
            symbols, ranks, place, lengths = symbols[keep], ranks[keep], place[keep], lengths[going] - 1
        return left

    def _in_turn(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same for words of any length, in n log(n): the ranks that occur wait in a heap, each with all its positions.

        The smallest is applied at all positions of its pair, and pairs that arise join the index
        and the heap.
        """
        ranks = self._indexed(symbols, ends)
        # A list may hold positions that a merge has since taken; they are told by the symbols
        # that stand there now.
        where: dict[int, list[int]] = {}
        for i in np.flatnonzero(ranks < NONE).tolist():
            where.setdefault(int(ranks[i]), []).append(i)
        n, size = len(symbols), self.size
        after, ahead = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = ahead[starts] = -1
        row, following, before = symbols.tolist(), after.tolist(), ahead.tolist()
        heap = sorted(where)

        def arises(pair: int, at: int) -> None:
            rank = self.ranks.get(pair)
            if rank in where:
                where[rank].append(at)
            elif rank is not None:
                where[rank] = [at]
                heapq.heappush(heap, rank)

        while heap:
            rank = heapq.heappop(heap)
            (a, b), merged = divmod(self.pairs[rank], size), int(self.becomes[rank])
            for i in sorted(where.pop(rank)):
                j = following[i]
                if j < 0 or row[i] != a or row[j] != b:
                    continue
                p, k = before[i], following[j]
                row[i], row[j], following[i] = merged, -1, k
                if k >= 0:
                    before[k] = i
                    arises(merged * size + row[k], i)
                if p >= 0:
                    arises(row[p] * size + merged, p)
        return np.array(row)


#: Stretches of text whose ids a task remembers at a time, and how long they may be.
KNOWN, LONGEST = 100_000, 64
#: Bytes of text that are encoded at a time, a row at least.
PART = 1 << 19


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about PART bytes of text each; a row is not cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and held + size > PART:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < batch.num_rows:
        yield batch.slice(first)


def _encoder(path: str, text: str, out: str, back: str | None):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        give_back()  # the file takes several times what is kept of it
        fixed: dict[str | int, bytes] = {i: np.array([i], np.int32).tobytes() for i in vocabulary.special.values()}
        known = dict(fixed)
        for whole in batches:
            for batch in _parts(whole, text):
                found = [vocabulary.pieces(x or "") for x in batch.column(text).to_pylist()]
                met = set().union(*found)
                if len(known) > KNOWN:  # what is met again now is likely to be met later
                    known = fixed | {w: known[w] for w in met if w in known}
                new = [w for w in met if w not in known]
                for at in range(0, len(new), 20_000):
                    part = new[at : at + 20_000]
                    known.update(zip(part, vocabulary.encode_all(part), strict=True))
                rows = [b"".join(map(known.__getitem__, pieces)) for pieces in found]
                for stretch in new:
                    if len(stretch) > LONGEST:
                        del known[stretch]
                ends = np.cumsum([0] + [len(r) // 4 for r in rows])
                flat = pa.array(np.frombuffer(b"".join(rows), np.int32))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                new_columns, names = [ids], [out]
                if back:
                    new_columns.append(vocabulary.texts_of(ids))
                    names.append(back)
                yield pa.RecordBatch.from_arrays([*batch.columns, *new_columns], [*batch.schema.names, *names])

    return encode


def _decoder(path: str, ids: str, out: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                yield pa.RecordBatch.from_arrays([*batch.columns, vocabulary.texts_of(batch.column(ids))], [*batch.schema.names, out])

    return decode


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", back: str | None = None) -> DataFrame:
    """Adds ``out``, the ids of the whole text, and ``back``, if named, the text that these ids decode to.

    Both in one pass hold one vocabulary a task, where ``encode`` and ``decode`` hold two.
    """
    fields = [T.StructField(out, T.ArrayType(T.IntegerType(), True))]
    if back:
        fields.append(T.StructField(back, T.StringType()))
    docs = docs.drop(*[f.name for f in fields])
    return map_batches(docs, _encoder(path, text, out, back), T.StructType([*docs.schema.fields, *fields]))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the text that the ids stand for."""
    rows = rows.drop(out)
    return map_batches(rows, _decoder(path, ids, out), T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))
