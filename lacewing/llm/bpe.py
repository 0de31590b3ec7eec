"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by an incremental UTF-8 machine.

A token sequence is the one that byte-pair merging yields exactly when each neighbouring pair of it is (the pair's bytes, merged on
their own, give the pair back). So the tokens of a word are a path through the token trie that may turn from one token to the next
only where the two are compatible, and at each position at most one path has just ended a token. That machine is
non-deterministic and emits late. It is made deterministic as in the subset construction for transducers: a state holds all live
paths together with the output they don't share yet, and what all share is emitted at once, so output lags behind the input by
less than the longest token. States and moves are made when a text first needs them, and kept up to a fixed number in flat arrays, over which
very many words are led at once, a byte of each at a time.
"""

from __future__ import annotations

import base64
import struct
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lacewing.llm.common import replace_columns, small_batches, trimmed

#: Bounds of what a worker keeps: moves of the machine, and twice as many bytes of whole words of at most LONGEST_KEPT characters.
TRANSITIONS_KEPT, WORDS_BYTES, LONGEST_KEPT = 300_000, 20 << 20, 40
#: Bytes that a word of the table is reckoned to take besides its text and ids.
WORD_COST = 180
#: Longer words (bytes) are led through the machine by themselves; the others so many at once.
LONG, TOGETHER = 48, 8192
#: A rank above all.
LAST = 1 << 40
#: Tokens below a node up to which paths are reduced; marks in the place of the token before.
FEW, ANY, NEVER = 1, -2, -3
#: Texts are taken together up to this many characters.
BATCH_BYTES = 1 << 19
#: Slots of the moves' hash table, for each move that may be kept, at least; multiplier of its hash.
_ROOM, _MIX = 2, np.uint64(0x9E3779B97F4A7C15)


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines `base64 rank` of a .tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Transducer:
    """Encoder of single words; see the module's text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.edges: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.edges:
                    self.edges[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.edges[key]
            self.token_at[node] = rank
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.edge_of: dict[int, list[tuple[bytes, int]] | None] = {}
        self.fits: dict[int, bool] = {}
        self.below = self._few_below()
        self.alive: dict[int, int] = {}
        self.reset()

    def _few_below(self) -> list[tuple[int, ...] | None]:
        """Of each node of the trie, the tokens that end below it, if they are few."""
        below: list[tuple[int, ...] | None] = [()] * len(self.token_at)
        for key, child in sorted(self.edges.items(), key=lambda x: -x[1]):  # children were numbered after their parents
            token, under, above = self.token_at[child], below[child], below[key >> 8]
            if under is not None and token >= 0:
                under = (*under, token)
            below[key >> 8] = None if under is None or above is None or len(above) + len(under) > FEW else above + under
        return below

    def _reduced(self, last: int, node: int) -> int:
        """What a path within a token must know of the token before: nothing (ANY) if all that may still end can follow it, and
        NEVER if none can, so that the path is dead; else the token."""
        key = (last + 1) << 24 | node
        found = self.alive.get(key)
        if found is None:
            if len(self.alive) > TRANSITIONS_KEPT:
                self.alive.clear()
            fits = [self.compatible(last, token) for token in self.below[node]]
            found = self.alive[key] = ANY if all(fits) else last if any(fits) else NEVER
        return found

    def reset(self) -> None:
        """Forget all states and moves."""
        bits = max(4, (_ROOM * TRANSITIONS_KEPT).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.moves = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self.next, self.emit = np.zeros(TRANSITIONS_KEPT + 1, np.int32), np.zeros(TRANSITIONS_KEPT + 1, np.int32)
        self.end = np.zeros(TRANSITIONS_KEPT + 2, np.int32)
        self.first, self.size = np.zeros(2 * TRANSITIONS_KEPT + 4, np.int32), np.zeros(2 * TRANSITIONS_KEPT + 4, np.int32)
        self.tokens, self.n_tokens, self.kept = np.zeros(1024, np.uint32), 0, 0
        self.outputs: dict[tuple, int] = {(): 0}
        self.numbers: dict[tuple, int] = {}
        self.paths: list[tuple] = []
        self.start = self._state(((-1, 0, ()),))

    def _output(self, tokens: tuple) -> int:
        """Number of a token sequence that is emitted; 0 is the empty one."""
        number = self.outputs.get(tokens)
        if number is None:
            number = self.outputs[tokens] = len(self.outputs)
            begin, end = self.n_tokens, self.n_tokens + len(tokens)
            if end > len(self.tokens):
                self.tokens = np.concatenate((self.tokens, np.zeros(max(len(self.tokens), end), np.uint32)))
            self.tokens[begin:end] = tokens
            self.first[number], self.size[number], self.n_tokens = begin, len(tokens), end
        return number

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes, and for tokens that merging never makes."""
        if token not in self.made_of:
            data, found = self.bytes_of[token], None
            for i in range(1, len(data)):
                left, right = self.ranks.get(data[:i], token), self.ranks.get(data[i:], token)
                if left < token and right < token and self._apart(left, right, token):
                    found = left, right
                    break
            self.made_of[token] = found
        return self.made_of[token]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]] | None:
        """What stands at a token's left (0) or right (1) edge while it is being made, from the single byte to the token itself: its bytes, and
        the rank of the merge that ends it."""
        if (edge := self.edge_of.get(token << 1 | side, 0)) == 0:
            data = self.bytes_of[token]
            if len(data) == 1:
                edge = [(data, LAST)]
            else:
                parts = self.halves(token)
                below = parts and self._edge(parts[side], side)
                edge = below and [*below[:-1], (below[-1][0], token), (data, LAST)]
            self.edge_of[token << 1 | side] = edge
        return edge

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge of a rank below limit joins the two tokens across their boundary while they are being made.

        Merges go by rank. What stands left of the boundary ends with the merge that makes its successor; among merges of one rank the
        leftmost is first, so an equal rank ends the left side before, and the right side after, a merge across the boundary.
        """
        lefts, rights = self._edge(left, 1), self._edge(right, 0)
        if not lefts or not rights:
            return False
        rank_of, lefts, rights = self.ranks.get, iter(lefts), iter(rights)
        (one, one_ends), (other, other_ends) = next(lefts), next(rights)
        while True:
            rank = rank_of(one + other)
            if rank is not None and rank < one_ends and rank <= other_ends and rank < limit:
                return False
            if one_ends <= other_ends:
                if one_ends == LAST:
                    return True
                one, one_ends = next(lefts)
            else:
                other, other_ends = next(rights)

    def compatible(self, left: int, right: int) -> bool:
        """Whether right may follow left; left is -1 at a word's start, where right must only be one that merging makes."""
        key = (left + 1) << 24 | right
        if (fit := self.fits.get(key)) is None:
            if len(self.fits) > 2 * TRANSITIONS_KEPT:
                self.fits.clear()
            fit = self.fits[key] = bool(self._edge(right, 0)) if left < 0 else self._apart(left, right, LAST)
        return fit

    def _state(self, paths: tuple) -> int:
        state = self.numbers.get(paths)
        if state is None:
            state = self.numbers[paths] = len(self.paths)
            self.paths.append(paths)
            self.end[state] = self._output(next((out for _, node, out in paths if node == 0), ()))
        return state

    def _grow(self, state: int, byte: int) -> int:
        """Make the move of a state by a byte, to the next state with the tokens that are now certain: its number."""
        paths, edges, below, token_at, fits = [], self.edges, self.below, self.token_at, self.fits
        for last, node, out in self.paths[state]:
            node = edges.get(node << 8 | byte)
            if node is None:
                continue
            few, token = below[node], token_at[node]
            if few is None:
                paths.append((last, node, out))
            elif few and (known := last if last == ANY else self._reduced(last, node)) != NEVER:
                paths.append((known, node, out))
            if token >= 0:
                fit = True if last == ANY else fits.get((last + 1) << 24 | token)
                if self.compatible(last, token) if fit is None else fit:
                    paths.append((token, 0, (*out, token)))
        first, shared = paths[0][2], 0
        if first:
            shared = len(first)
            for _, _, out in paths:
                while out[:shared] != first[:shared]:
                    shared -= 1
        move = self.kept
        self.kept += 1
        self.emit[move] = self._output(first[:shared])
        self.next[move] = self._state(tuple([(last, node, out[shared:]) for last, node, out in paths]) if shared else tuple(paths))
        key = state << 8 | byte
        at = int(np.uint64(key * int(_MIX) & (1 << 64) - 1) >> self.shift)
        while self.slots[at] >= 0:
            at = (at + 1) & self.mask
        self.slots[at], self.moves[at] = key, move
        return move

    def _moves(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the moves of (state << 8 | byte); those that aren't there are made, or _Full is raised if there is no room."""
        while True:
            at = (keys.view(np.uint64) * _MIX >> self.shift).view(np.int64)
            seen = self.slots[at]
            off = np.flatnonzero((seen != keys) & (seen >= 0))
            while off.size:
                at[off] = (at[off] + 1) & self.mask
                seen[off] = self.slots[at[off]]
                off = off[(seen[off] != keys[off]) & (seen[off] >= 0)]
            fresh = np.unique(keys[seen < 0])
            if not fresh.size:
                return self.moves[at]
            if self.kept + fresh.size > TRANSITIONS_KEPT:
                raise _Full
            for key in fresh.tolist():
                self._grow(key >> 8, key & 255)

    def _led(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words in order of falling length, one after the other, and where those of each begin and the last end."""
        n, lengths = len(words), np.array([len(w) for w in words])
        begins, data = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(words), np.uint8)
        out, state = np.zeros((n, int(lengths[0]) + 1), np.int32), np.full(n, self.start, np.int64)
        for k in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -k))  # as many words are longer than k
            moves = self._moves(state[:live] << 8 | data[begins[:live] + k])
            state[:live], out[:live, k] = self.next[moves], self.emit[moves]
        out[np.arange(n), lengths] = self.end[state]
        sizes = self.size[out]
        bounds = np.concatenate(([0], np.cumsum(sizes.sum(axis=1))))
        outputs = out[sizes > 0]
        sizes = self.size[outputs]
        source = np.repeat(self.first[outputs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(bounds[-1]))
        return self.tokens[source], bounds

    def encode_all(self, words: list[bytes]) -> list[bytes]:
        """Packed token ids of words. A word that is itself a token is that token, as in the rank files' own library."""
        packed, short, rank_of = [], [], self.ranks.get
        for i, word in enumerate(words):
            if (rank := rank_of(word)) is not None:
                packed.append(pack([rank]))
            elif len(word) > min(LONG, TRANSITIONS_KEPT // 4):
                packed.append(self.encode(word))
            else:
                short.append(i)
                packed.append(b"")
        short.sort(key=lambda i: -len(words[i]))
        step = max(1, min(TOGETHER, TRANSITIONS_KEPT // LONG))  # their moves surely fit into an empty machine
        for at in range(0, len(short), step):
            part = short[at : at + step]
            taken = [words[i] for i in part]
            try:
                tokens, bounds = self._led(taken)
            except _Full:
                self.reset()
                tokens, bounds = self._led(taken)
            data, edges = tokens.astype("<u4").tobytes(), (4 * bounds).tolist()
            for k, i in enumerate(part):
                packed[i] = data[edges[k] : edges[k + 1]]
        return packed

    def encode(self, word: bytes) -> bytes:
        """Packed token ids of one word of any length that is no token."""
        state, outputs, known = self.start, [], {}
        for byte in word:
            key = state << 8 | byte
            step = known.get(key)
            if step is None:
                if self.kept >= TRANSITIONS_KEPT:
                    paths, known = self.paths[state], {}
                    self.reset()
                    state = self._state(paths)
                    key = state << 8 | byte
                move = self._one(key)
                emitted = int(self.emit[move])
                begin = int(self.first[emitted])
                step = known[key] = int(self.next[move]), self.tokens[begin : begin + int(self.size[emitted])].tolist()
            state, emitted = step
            outputs += emitted
        end = int(self.end[state])
        begin = int(self.first[end])
        return pack(outputs + self.tokens[begin : begin + int(self.size[end])].tolist())

    def _one(self, key: int) -> int:
        """Number of one move, made if need be; there must be room for it."""
        at = int(np.uint64(key * int(_MIX) & (1 << 64) - 1) >> self.shift)
        while self.slots[at] >= 0:
            if self.slots[at] == key:
                return int(self.moves[at])
            at = (at + 1) & self.mask
        return self._grow(key >> 8, key & 255)


class _Full(Exception):
    """The machine has no room for further moves."""


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Encodes texts; words met before are looked up, new ones are led through the machine together.

    When the table of words holds WORDS_BYTES, its words become the older ones; of these, those not asked for again go when it is full the next
    time.
    """

    def __init__(self, vocabulary: bytes, pattern: str):
        self.transducer, self.split = Transducer(load_ranks(vocabulary)), regex.compile(pattern)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts; each match of the pattern is merged separately."""
        split = [self.split.findall(text) for text in texts]
        words, older = self.words, self.older
        unknown = set().union(*split).difference(words)
        new = [w for w in unknown if w not in older]
        packed = dict(zip(new, self.transducer.encode_all([w.encode() for w in new]), strict=True))
        for word in unknown:
            ids = packed.get(word)
            words[word] = ids = older[word] if ids is None else ids
            self.held += WORD_COST + len(word) + len(ids)
        out = [b"".join(map(words.__getitem__, found)) for found in split]
        for word in unknown:
            if len(word) > LONGEST_KEPT:
                self.held -= WORD_COST + len(word) + len(words.pop(word))
        if self.held > WORDS_BYTES:
            self.older, self.words, self.held = words, {}, 0
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


#: For each leading byte: bytes that must follow, and the range of the first of these (the Unicode Standard, table 3-7).
def _lead(byte: int) -> tuple[int, int, int] | None:
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


def utf8_step(pending: bytes, data: bytes) -> tuple[str, bytes]:
    """Feed bytes to the UTF-8 machine: the text that is now complete, and the unfinished sequence kept as its state.

    An ill-formed sequence gives one U+FFFD for its longest well-formed beginning.
    """
    text: list[str] = []
    for byte in data:
        if pending:
            count, low, high = _lead(pending[0])
            if len(pending) > 1:
                low, high = 0x80, 0xBF
            if low <= byte <= high:
                pending += bytes([byte])
                if len(pending) == count + 1:
                    text.append(pending.decode())
                    pending = b""
                continue
            text.append("\N{REPLACEMENT CHARACTER}")
            pending = b""
        if byte < 0x80:
            text.append(chr(byte))
        elif _lead(byte):
            pending = bytes([byte])
        else:
            text.append("\N{REPLACEMENT CHARACTER}")
    return "".join(text), pending


class Decoder:
    """Incremental decoder: feed() any number of ids, finish() at the end. Unknown ids decode to nothing.

    Its state is the unfinished UTF-8 sequence, of at most three bytes.
    """

    #: Ids taken at a time, whatever the length of a text.
    STEP = 1 << 16

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = [bytes_of.get(i, b"") for i in range(max(bytes_of, default=-1) + 1)]
        self.pending = b""

    def feed(self, ids: Iterable[int]) -> str:
        table = self.bytes_of
        try:
            data = self.pending + b"".join([table[i] for i in ids])
        except IndexError:
            data = self.pending + b"".join([table[i] for i in ids if i < len(table)])
        tail = utf8_tail(data)
        try:
            text, self.pending = data[: len(data) - tail].decode(), data[len(data) - tail :]
        except UnicodeDecodeError:
            text, self.pending = utf8_step(b"", data)
        return text

    def finish(self) -> str:
        rest, self.pending = "\N{REPLACEMENT CHARACTER}" if self.pending else "", b""
        return rest

    def decode(self, packed: bytes) -> str:
        ids = array("I")  # of four bytes on every platform that Spark runs on
        ids.frombytes(packed)
        if sys.byteorder == "big":
            ids.byteswap()
        return "".join([self.feed(ids[i : i + self.STEP]) for i in range(0, len(ids), self.STEP)]) + self.finish()


def utf8_tail(data: bytes) -> int:
    """Length of the unfinished sequence at the end of data, 0 if there is none."""
    for back in range(1, min(3, len(data)) + 1):
        if lead := _lead(data[-back]):
            return back if lead[0] >= back and not utf8_step(b"", data[-back:])[0] else 0
        if data[-back] < 0x80:
            return 0
    return 0


_MADE: dict[tuple, object] = {}


def _worker(kind: str, vocabulary: bytes, pattern: str = ""):
    """The worker process's own encoder or decoder, made once a task; _released() forgets it."""
    key = kind, hash(vocabulary), pattern
    if key not in _MADE:
        _MADE[key] = Encoder(vocabulary, pattern) if kind == "encode" else Decoder({rank: token for token, rank in load_ranks(vocabulary).items()})
    return _MADE[key]


def _released() -> None:
    """Forget the worker's tables when a task ends: workers outlive it, and idle or in later stages of other kinds they would hold them still."""
    _MADE.clear()
    trimmed()


def _extended(df: DataFrame, source: str, targets: dict[str, T.DataType], make: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """df with more columns, made from the values of another in Arrow batches of bounded size; make() gives, in a task, the function of a
    list of values to a list of values for each target."""
    df = replace_columns(df, *targets)
    small_batches(df.sparkSession)
    at, arrow = df.columns.index(source), [{"binary": pa.binary(), "string": pa.string()}[kind.simpleString()] for kind in targets.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        try:
            for batch in batches:
                begin, held, values = 0, 0, []
                for i, value in enumerate(batch.column(at)):
                    values.append(value.as_py())
                    held += len(values[-1] or ())
                    if held > BATCH_BYTES or i + 1 == batch.num_rows:
                        part = batch.slice(begin, i + 1 - begin)
                        made = [pa.array(x, kind) for x, kind in zip(f(values), arrow, strict=True)]
                        yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *targets])
                        begin, held, values = i + 1, 0, []
        finally:
            f = None
            _released()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(name, kind) for name, kind in targets.items()]]))


def encode(df: DataFrame, vocabulary: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the token ids of a text column, packed as little-endian unsigned 32-bit integers.

    vocabulary: content of a rank file (a megabyte or so; broadcast). Null text counts as empty and gives empty ids; an existing
    column ids_col is replaced; other columns, repeated rows and rows of an empty table pass through unchanged. Texts of any length are
    taken whole. No shuffle: one pass over the rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        encoder = _worker("encode", shared.value, pattern)
        return lambda texts: [encoder.encode_all([text or "" for text in texts])]

    return _extended(df, text_col, {ids_col: T.BinaryType()}, make)


def decode(df: DataFrame, vocabulary: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of packed token ids. Null ids give null; ids that the vocabulary lacks are skipped; bytes that are not UTF-8 give U+FFFD.
    An existing column text_col is replaced; other columns, repeated rows and an empty table pass through."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        decoder = _worker("decode", shared.value)
        return lambda packed: [[None if x is None else decoder.decode(x) for x in packed]]

    return _extended(df, ids_col, {text_col: T.StringType()}, make)


def round_trip(df: DataFrame, vocabulary: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """encode() and decode() in one pass over the rows: both columns are added, of the same values and with the same rules."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        encoder, decoder = _worker("encode", shared.value, pattern), _worker("decode", shared.value)

        def both(texts: list) -> list[list]:
            packed = encoder.encode_all([text or "" for text in texts])
            return [packed, [decoder.decode(x) for x in packed]]

        return both

    return _extended(df, text_col, {ids_col: T.BinaryType(), decoded_col: T.StringType()}, make)
