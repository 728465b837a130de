"""Byte-level BPE: encoding in batched numpy merge rounds, and decoding.

Texts are cut into words by character classes, all words of a batch at once.
Each distinct word is merged once: the symbols of all new words stand in one flat
array; a round finds the rank of every adjacent pair by binary search over the
sorted pair keys, takes the lowest rank of each word (a segmented minimum) and
merges that pair wherever it stands in the word, left to right.  A word of more than LONG_WORD bytes
would need thousands of rounds over all of it; it is merged by a heap of its pairs, in the same order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, slices, text_buffers

#: Bytes of text in one batch of rounds, and words whose encodings a worker keeps.
BATCH_BYTES = 1 << 20
CACHE_WORDS = 300_000
#: Bytes from which a word (a run without breaks) is merged by a heap.
LONG_WORD = 2048
_NONE = np.int64(2**62)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + k)
    return [letters[b] for b in range(256)]


class Pieces:
    """Byte strings by number, in one flat array."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[bytes, list[int]]:
        """The strings of ``ids`` one after another, and where those of ids[cuts] begin."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at].tobytes(), np.r_[0, ends][cuts].tolist()


class BpeModel:
    """Vocabulary and merges of a byte-level BPE file; small (bounded by the file) and picklable."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._refuse_unknown(spec)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *added.values()]) + 1
        self.table: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.table[i] = token.encode() if token in added else bytes(back[c] for c in token)
        for token, i in added.items():
            self.table[i] = token.encode()
        self.pieces = Pieces(self.table)
        self.numerals = Pieces([b"%d," % i for i in range(size)])
        self.special = {t.encode(): i for t, i in sorted(added.items(), key=lambda x: -len(x[0]))}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    @staticmethod
    def _refuse_unknown(spec: dict) -> None:
        """Raises for what a vocabulary file asks for and this encoder doesn't do."""
        model, before, after = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        asked = {
            "a model other than BPE": model.get("type", "BPE") != "BPE",
            "a normalizer": spec.get("normalizer") is not None,
            "a pre-tokenizer other than ByteLevel with its regular expression": before.get("type") != "ByteLevel" or not before.get("use_regex", True),
            "a prefix space": bool(before.get("add_prefix_space")),
            "a decoder other than ByteLevel": after.get("type") != "ByteLevel",
            "dropout": bool(model.get("dropout")),
            "ignore_merges": bool(model.get("ignore_merges")),
            "byte_fallback": bool(model.get("byte_fallback")),
            "subword marks": bool(model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")),
            "added tokens with flags": any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip")),
            "added tokens that are not special": any(not t.get("special", True) for t in spec.get("added_tokens", [])),
        }
        if unknown := [what for what, found in asked.items() if found]:
            raise ValueError(f"the vocabulary file asks for {', '.join(unknown)}")

    def merge_long(self, word: bytes) -> list[int]:
        """Token ids of one word: pairs leave a heap by rank, then place; symbols are a doubly linked list."""
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made[self.ranks].tolist(), strict=True), strict=True))
        symbol = self.first[np.frombuffer(word, np.uint8)].tolist()
        n, pairs = len(symbol), self._pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], k, found[1]) for k in range(n - 1) if (found := pairs.get(symbol[k] << 32 | symbol[k + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, k, made = heapq.heappop(heap)
            other = after[k]
            # Symbols have changed since: a merged one is -1, another pair has another rank.
            if symbol[k] < 0 or other >= n or (now := pairs.get(symbol[k] << 32 | symbol[other])) is None or now[0] != rank:
                continue
            symbol[k], symbol[other] = made, -1
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
                if found := pairs.get(made << 32 | symbol[after[k]]):
                    heapq.heappush(heap, (found[0], k, found[1]))
            if before[k] >= 0 and (found := pairs.get(symbol[before[k]] << 32 | made)):
                heapq.heappush(heap, (found[0], before[k], found[1]))
        return [x for x in symbol if x >= 0]

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words data[start:end], flat, and the number of each word's."""
        long = np.flatnonzero(end - start > LONG_WORD)
        if not len(long):
            return self._merge_rounds(data, start, end)
        short = np.setdiff1d(np.arange(len(start)), long)
        flat, counts = self._merge_rounds(data, start[short], end[short])
        parts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(start)
        for k, part in zip(short.tolist(), np.split(flat, np.cumsum(counts)[:-1]) if len(short) else [], strict=True):
            parts[k] = part
        for k in long.tolist():
            parts[k] = np.array(self.merge_long(data[start[k] : end[k]].tobytes()), np.int64)
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def _merge_rounds(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = end - start
        n = len(sizes)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbol = self.first[data[place + np.repeat(start, sizes)]]
        word = np.repeat(np.arange(n), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            inner = np.zeros(len(symbol), bool)
            inner[:-1] = word[:-1] == word[1:]
            rank = np.full(len(symbol), _NONE)
            at = np.flatnonzero(inner)
            key = symbol[at] << 32 | symbol[at + 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            rank[at[hit]] = self.ranks[found[hit]]
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[heads, len(word)])
            low = np.repeat(np.minimum.reduceat(rank, heads), counts)
            idle = low == _NONE
            pick = np.flatnonzero((rank == low) & ~idle)
            if len(pick):
                # Of pairs that overlap (one symbol repeated) every other one merges, from the left.
                fresh = np.r_[True, (np.diff(pick) > 1) | (word[pick[1:]] != word[pick[:-1]])]
                run = np.flatnonzero(fresh)
                pick = pick[(np.arange(len(pick)) - np.repeat(run, np.diff(np.r_[run, len(pick)]))) % 2 == 0]
                symbol[pick] = self.made[rank[pick]]
            if idle.any():
                done.append((word[idle], symbol[idle]))
            stay = ~idle
            stay[pick + 1] = False
            symbol, word = symbol[stay], word[stay]
        if not done:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        word, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbol[np.argsort(word, kind="stable")], np.bincount(word, minlength=n)

    def decode(self, ids) -> str:
        """The text of token ids, those of special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join([self.table[i] for i in ids]).decode("utf-8", "replace")


_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point, from Unicode's general categories and White_Space."""
    if not _CLASSES:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                table[a : b + 1] = kind
        table[0xD800:0xE000] = _OTHER
        _CLASSES.append(table)
    return _CLASSES[0]


_ENDINGS = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in ("s", "t", "re", "ve", "m", "ll", "d")]


def word_starts(points: np.ndarray, doc_heads: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point; doc_heads are the first code points of texts.

    A pre-token is a contraction ending, or a run of letters, numbers or other marks
    with at most one space before it, or white space: all of a run at the end of a text, else
    all but its last character and, if that is no space, the last one.
    """
    n = len(points)
    kind = classes()[points]
    head = np.zeros(n, bool)
    head[doc_heads] = True
    edge = head.copy()
    edge[1:] |= kind[1:] != kind[:-1]
    start = edge & (kind != _SPACE)
    space = kind == _SPACE
    last = np.zeros(n, bool)  # the last character of a run of white space before something else
    last[:-1] = space[:-1] & ~space[1:] & ~head[1:]
    blank = last & (points == 32)
    start[1:] &= ~blank[:-1]
    start |= space & (edge | last)
    # Contractions: a quote alone in its run, with no space before it, and one of the endings after it.
    quote = np.flatnonzero((points == 39) & edge & start)
    for ending in _ENDINGS:
        if not len(quote):
            break
        k = len(ending)
        fits = quote[quote + k < n]
        ok = np.ones(len(fits), bool)
        for j in range(k):
            ok &= (points[fits + 1 + j] == ending[j]) & ~head[fits + 1 + j]
        fits = fits[ok]
        start[fits + 1] = False
        after = fits + 1 + k
        after = after[after < n]
        after = after[(kind[after] == _LETTER) & ~head[after]]
        start[after] = True
        quote = np.setdiff1d(quote, fits)
    return start


class Encoder:
    """Encodes batches of texts; keeps the encodings of words it has seen, in flat arrays."""

    def __init__(self, model: BpeModel, special: bool = True):
        self.model = model
        self.special = model.special if special else {}
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        # The first words are the special tokens.
        self.flat = np.array(list(self.model.special.values()), np.int32)
        self.starts = np.arange(len(self.flat))
        self.sizes = np.ones(len(self.flat), np.int64)

    def _known(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the words data[start:end] in the store, where new ones are put.

        Hashes only group a batch's words; what stands for a group is compared byte by byte with all of it, and
        the store is asked by the words themselves.
        """
        words = Words.__new__(Words)
        words.start, words.end = start, end
        hashes = words._hashes(data, False, 1 << 20)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        unlike = self._unlike(data, start, end, where[inverse])
        if len(unlike):  # words with the hash of another one stand for themselves
            inverse[unlike] = len(where) + np.arange(len(unlike))
            where = np.r_[where, unlike]
        if len(self.place) + len(where) > CACHE_WORDS:
            self._forget()
        raw = data.tobytes()
        spelled = [raw[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)]
        place = np.array([self.place.get(w, -1) for w in spelled], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            flat, counts = self.model.merge(data, start[where[new]], end[where[new]])
            place[new] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            # Long words are rare and large: the store keeps their encodings for this batch alone.
            self.place.update((spelled[k], int(place[k])) for k in new.tolist() if len(spelled[k]) <= LONG_WORD)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.sizes = np.concatenate([self.sizes, counts])
        return place[inverse]

    @staticmethod
    def _unlike(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Words whose bytes aren't those of word ``other`` of each."""
        sizes = end - start
        same = sizes == sizes[other]
        at = np.flatnonzero(same & (other != np.arange(len(other))))
        i = 0
        total = np.cumsum(sizes[at])
        while i < len(at):  # about a megabyte at a time
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 20), "right")))
            own = sizes[at[i:j]]
            heads = np.cumsum(own) - own
            place = np.arange(int(own.sum())) - np.repeat(heads, own)
            equal = data[place + np.repeat(start[at[i:j]], own)] == data[place + np.repeat(start[other[at[i:j]]], own)]
            same[at[i:j]] = np.logical_and.reduceat(equal, heads)
            i = j
        return np.flatnonzero(~same)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For valid UTF-8 texts: the number of each pre-token in the store, and where each text's begin."""
        cuts, marks = self._specials(data, offsets)
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begin = np.searchsorted(heads, cuts[cuts < len(data)])
        at = heads[np.flatnonzero(word_starts(points, begin))] if len(points) else np.zeros(0, np.int64)
        token = np.searchsorted(at, marks[:, 0])
        if len(marks):  # what stands inside a special token is one token
            inside = np.searchsorted(at, marks[:, 1]) - token
            drop = np.repeat(token, inside) + np.arange(int(inside.sum())) - np.repeat(np.cumsum(inside) - inside, inside)
            at = np.delete(at, np.setdiff1d(drop, token))
            token = np.searchsorted(at, marks[:, 0])
        end = np.r_[at[1:], len(data)] if len(at) else at
        number = np.empty(len(at), np.int64)
        plain = np.ones(len(at), bool)
        plain[token] = False
        if plain.any():
            number[plain] = self._known(data, at[plain], end[plain])
        number[token] = marks[:, 2]
        return number, np.searchsorted(at, offsets)

    def _specials(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words must begin anew, and (start, end, number) of special tokens, leftmost first."""
        found: list[tuple[int, int, int]] = []
        if self.special:
            numbers = {token: k for k, token in enumerate(self.special)}
            # Longer tokens stand first, so the longest of those that begin at a place is taken.
            pattern, raw, at = re.compile(b"|".join(map(re.escape, self.special))), data.tobytes(), 0
            while m := pattern.search(raw, at):
                if m.end() <= offsets[np.searchsorted(offsets, m.start(), "right")]:
                    found.append((*m.span(), numbers[m[0]]))
                    at = m.end()
                else:  # across the end of a text
                    at = m.start() + 1
        marks = np.array(found, np.int64).reshape(-1, 3)
        return np.unique(np.concatenate([offsets[:-1], marks[:, 0], marks[:, 1]])), marks

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and where each text's begin (and the last one's end)."""
        number, first = self.words(data, offsets)
        sizes = self.sizes[number]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[number] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at], np.r_[0, ends][first]


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("body"))


def _encoded(batches, encoder: Encoder):
    """(ids of rows, token ids, cuts) of texts, some megabytes at a time."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i, j in slices(offsets, BATCH_BYTES):
            yield batch.column(0).slice(i, j - i), *encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def encode_texts(docs: DataFrame, model: BpeModel, id_column: str = "doc_id", text_column: str = "text", special: bool = True) -> DataFrame:
    """id and ids (array<int>) of every row's text.

    Null and empty texts have no ids.  With ``special``, strings of special tokens in a
    text become those tokens.  A very long text is encoded by itself, with some hundred bytes of memory a byte.  Rows are independent: repeated rows, null ids and extra
    columns change nothing; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary file

    def run(batches):
        for rows, ids, cuts in _encoded(batches, Encoder(shared.value, special)):
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([rows, lists], names=["id", "ids"])

    return _rows(docs, id_column, text_column).mapInArrow(run, "id long, ids array<int>")


def decode_texts(encoded: DataFrame, model: BpeModel, ids_column: str = "ids", out_column: str = "decoded") -> DataFrame:
    """Adds the text of a column of token ids; null ids give null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    keep = encoded.drop(out_column)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in keep.dtypes), f"`{out_column}` string"])

    def run(batches):
        decode = shared.value.decode
        for batch in batches:
            text = [None if x is None else decode(x) for x in batch.column(batch.schema.get_field_index(ids_column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, out_column])

    return keep.mapInArrow(run, schema)


def token_digests(docs: DataFrame, model: BpeModel, id_column: str = "doc_id", text_column: str = "text", special: bool = True, with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids: as encode_texts, then decode_texts of those ids.

    Both directions run in one task, so ids and decoded texts don't travel.  Null and empty texts have no ids, and the digests of
    nothing; very long texts, repeated rows, null ids, extra columns and empty tables are as in encode_texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches):
        model = shared.value
        for rows, ids, cuts in _encoded(batches, Encoder(model, special)):
            shown, shown_at = model.numerals.join(ids, cuts)
            raw, raw_at = model.pieces.join(ids, cuts)
            numbers = [hashlib.sha256(shown[a : max(a, b - 1)]).hexdigest() for a, b in zip(shown_at[:-1], shown_at[1:], strict=True)]
            texts = [hashlib.sha256(raw[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(raw_at[:-1], raw_at[1:], strict=True)]
            columns = [rows, pa.array(np.diff(cuts)), pa.array(numbers), pa.array(texts)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _rows(docs, id_column, text_column).mapInArrow(run, schema)
