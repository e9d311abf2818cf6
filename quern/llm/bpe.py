"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a UTF-8 state machine.

Encoding. A text is cut into pieces by the usual pattern. Merges are compiled
into a relation: which token may follow which. The encoding of a prefix ends
in exactly one token, so all that decides the future of a piece is, for each
place where a token that is still open may have begun, the tokens up to it.
Such a configuration is a state of a transducer. Tokens on which all open
readings agree are emitted at once, so that what waits is never longer than
the longest token. States and transitions are made when first met and dropped
altogether when there are too many, as lazy automata for regular expressions
do. Frequent pieces are remembered whole, within a bound. The short pieces
that a portion of texts brings are read together: sorted, they are paths
through a tree, whose nodes are the states, each made once and held only along
the path that is being read.

Decoding. Tokens are bytes and may end inside a character. Tokens that are
whole characters are joined as text; from the first that isn't, bytes pass
through an automaton of UTF-8 until it is back between two characters.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import fresh, importable, table

#: Ranks of a public byte-level vocabulary, one "base64 rank" a line; any such file will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Remembered pieces, transitions, histories and pairs of tokens before each memory is emptied; bounds on memory alone.
PIECES, TRANSITIONS, HISTORIES, PAIRS = 400_000, 400_000, 400_000, 400_000
#: Bytes of the filter that tells whether a transition was asked for before.
ASKED = 1 << 22
LONG = 64
#: Bytes of texts that are cut and encoded at a time; the last text of a portion may be longer, and is always whole.
PORTION = 2_000_000
#: Bits of a reading that hold its node.
_SHIFT = 24
_NODES = (1 << _SHIFT) - 1


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes: list[bytes] = [b""] * (max(self.rank.values()) + 1)
        for token, i in self.rank.items():
            self.bytes[i] = token
        # The tree of all tokens: a node is a number, children are found by (node << 8 | byte).
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        for token, i in self.rank.items():
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                node = self.child[key]
            self.token[node] = i

        # Each token's last merge: the two tokens it is made of, itself twice for a byte.
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.bytes))]
        self.merged: dict[tuple[int, int], int] = {}
        for token, i in self.rank.items():
            parts = self.merge(token, i)
            if len(parts) == 2:
                self.halves[i] = parts[0], parts[1]
                self.merged[parts[0], parts[1]] = i

    def merge(self, raw: bytes, below: int = 1 << 60) -> list[int]:
        """BPE as defined: merge the pair of least rank, leftmost first, while one is under ``below``."""
        get, parts = self.rank.get, [raw[i : i + 1] for i in range(len(raw))]
        ranks = [get(parts[i] + parts[i + 1], below) for i in range(len(parts) - 1)]
        while ranks:
            least = min(ranks)
            if least >= below:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], below)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], below)
        return [self.rank[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is these tokens.

        It isn't if, while both are taken apart merge by merge, latest first,
        the parts that touch would have merged before the parts' own merge.
        """
        merged, halves, limit = self.merged, self.halves, 1 << 60
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            left, right = halves[a][1], halves[b][0]
            if a > b and left != a:
                limit, a = a, left
            elif right != b:
                limit, b = b + 1, right
            elif left != a:
                limit, a = a, left
            else:
                return True


class Encoder:
    """The transducer of one vocabulary.

    A reading is one number: the node of the token tree that it has come to,
    and a history, which stands for the token emitted last and the tokens up
    to where the reading began. A state is the tuple of its readings.
    """

    def __init__(self, path: str = VOCABULARY):
        self.vocabulary = Vocabulary(path)
        self.cut = regex.compile(PATTERN).findall
        self.size = list(map(len, self.vocabulary.bytes))
        self.pairs: dict[int, bool] = {}
        self.pieces = _Pieces(self)
        inner = {key >> 8 for key in self.vocabulary.child}
        self.goes_on = bytearray(n in inner for n in range(len(self.vocabulary.token)))
        self.reset()

    def reset(self, readings: tuple[int, ...] = ()) -> tuple[int, ...]:
        """Forget all but the first state (nothing read, one reading that begins here); returns ``readings`` in new numbers."""
        kept = [(r & _NODES, *self.history[r >> _SHIFT]) for r in readings]
        self.history: list[tuple[int, tuple[int, ...]]] = []
        self.number_of: dict[tuple[int, tuple[int, ...]], int] = {}
        first = (self._history(-1, ()) << _SHIFT,)
        self.states: list[tuple[int, ...]] = [first]
        self.number: dict[tuple[int, ...], int] = {first: 0}
        self.move: dict[int, int] = {}  # (state << 8 | byte) to the next state, or to its complement where tokens are emitted
        self.emitted: dict[int, tuple[int, ...]] = {}
        self.asked = bytearray(ASKED)
        return tuple([self._history(before, pending) << _SHIFT | node for node, before, pending in kept])

    def _history(self, before: int, pending: tuple[int, ...]) -> int:
        key = before, pending
        number = self.number_of.get(key)
        if number is None:
            number = self.number_of[key] = len(self.history)
            self.history.append(key)
        return number

    def may_follow(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self.vocabulary.may_follow(a, b)
        return known

    def step(self, readings: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The readings after one byte, and the tokens on which all of them agree."""
        child, ends, goes_on, history = self.vocabulary.child, self.vocabulary.token, self.goes_on, self.history
        new, pendings, here = [], [], None
        for r in readings:
            node = child.get((r & _NODES) << 8 | byte)
            if node is None:
                continue
            if goes_on[node]:  # at a leaf of the token tree nothing can follow
                new.append(r & ~_NODES | node)
                pendings.append(history[r >> _SHIFT][1])
            if here is None and (token := ends[node]) >= 0:
                before, pending = history[r >> _SHIFT]
                a = pending[-1] if pending else before
                if a < 0 or self.may_follow(a, token):
                    here, last = (*pending, token), before
        # Encodings of prefixes exist, so one token does end here; it is a reading that begins anew.
        agreed = 0
        if not pendings:
            agreed = len(here)
        elif min(map(len, pendings)):
            least, most = min(here, *pendings), max(here, *pendings)  # what these two begin with, all do
            for x, y in zip(least, most):
                if x != y:
                    break
                agreed += 1
        if not agreed:
            new.append(self._history(last, here) << _SHIFT)
            return tuple(new), ()
        out = here[:agreed]
        before = out[-1]
        new = [self._history(before, p[agreed:]) << _SHIFT | r & _NODES for r, p in zip(new, pendings)]
        new.append(self._history(before, here[agreed:]) << _SHIFT)
        return tuple(new), out

    def _state(self, readings: tuple[int, ...]) -> int:
        number = self.number.get(readings)
        if number is None:
            number = self.number[readings] = len(self.states)
            self.states.append(readings)
        return number

    def _unknown(self, state: int, raw: bytes, at: int, out: list[int]) -> tuple[int, int]:
        """Go on from a transition that isn't known, to where states are known again: (state, place).

        A transition is made when it is asked for the second time. Until then
        the readings are carried along without becoming states, so that what
        is met once doesn't crowd out what recurs.
        """
        readings, n = self.states[state], len(raw)
        while at < n:
            if len(self.move) > TRANSITIONS or len(self.history) > HISTORIES:
                readings = self.reset(readings)
                state = -1
            byte = raw[at]
            to, tokens = self.step(readings, byte)
            at += 1
            out += tokens
            if state >= 0:
                key = state << 8 | byte
                slot = key * 0x9E3779B1 % ASKED
                if self.asked[slot]:
                    number = self._state(to)
                    self.move[key] = ~number if tokens else number
                    if tokens:
                        self.emitted[key] = tokens
                    return number, at
                self.asked[slot] = 1
            state = self.number.get(to, -1)
            readings = to
            if state >= 0 and at < n and state << 8 | raw[at] in self.move:
                return state, at
        return -1 - self._history(*self._whole(readings)), at

    def _whole(self, readings: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
        return self.history[readings[-1] >> _SHIFT]

    def transduce(self, raw: bytes) -> list[int]:
        """The tokens of one piece."""
        out: list[int] = []
        state, at, n = 0, 0, len(raw)
        while at < n:
            to = self.move.get(state << 8 | raw[at])
            if to is None:
                state, at = self._unknown(state, raw, at, out)
                continue
            if to < 0:
                out += self.emitted[state << 8 | raw[at]]
                to = ~to
            state = to
            at += 1
        left = self.history[-1 - state] if state < 0 else self._whole(self.states[state])  # the reading that ends here
        return out + list(left[1])

    def learn(self, pieces: Iterable[str]) -> None:
        """Remember the tokens of pieces of at most ``LONG`` characters.

        In their order, pieces are paths through a tree, and each node of it is
        one state: its readings are held along the path, so that what pieces
        begin with is read once. There a reading is the token before it and
        its node; the tokens up to it are found on the path, from the end.
        """
        child, ends, goes_on, size = self.vocabulary.child.get, self.vocabulary.token, self.goes_on, self.size
        pairs, may_follow, keep = self.pairs, self.may_follow, self.pieces.keep
        states: list[list[int]] = [[0]]  # of what `last` begins with, by its length; a token before is its number and 1
        token: list[int] = [-1]  # the last one of that
        last = b""
        for piece in sorted(pieces):  # in the order of their bytes, too
            raw, at = piece.encode("utf-8", "surrogatepass"), 0
            for x, y in zip(raw, last):
                if x != y:
                    break
                at += 1
            del states[at + 1 :], token[at + 1 :]
            readings = states[at]
            for byte in raw[at:]:
                new, here = [], -1
                for r in readings:
                    node = child((r & _NODES) << 8 | byte)
                    if node is None:
                        continue
                    if here < 0 and (t := ends[node]) >= 0:
                        before = (r >> _SHIFT) - 1
                        if before < 0:
                            here = t
                        else:
                            known = pairs.get(before << 32 | t)
                            if known or known is None and may_follow(before, t):
                                here = t
                    if goes_on[node]:
                        new.append(r & ~_NODES | node)
                new.append(here + 1 << _SHIFT)
                readings = new
                states.append(new)
                token.append(here)
            last, at, out = raw, len(raw), []
            while at:
                out.append(token[at])
                at -= size[token[at]]
            keep(piece, tuple(out[::-1]))

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The tokens of each text; pieces that are new are read together."""
        cut = [self.cut(t) if t else [] for t in texts]
        known, new = self.pieces, []
        for p in set(chain.from_iterable(cut)):
            if p not in known and len(p) <= LONG:
                if (tokens := known.old.get(p)) is None:
                    new.append(p)
                else:
                    known.keep(p, tokens)
        self.learn(new)
        return [np.fromiter(chain.from_iterable(map(known.__getitem__, pieces)), np.int32) for pieces in cut]

    def encode(self, text: str | None) -> np.ndarray:
        """The tokens of a text; of null as of an empty one, none."""
        if not text:
            return np.zeros(0, np.int32)
        return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, self.cut(text))), np.int32)


class _Pieces(dict):
    """Remembered pieces in two generations: what was used since the last turn outlives the next one."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.old: dict[str, tuple[int, ...]] = {}

    def keep(self, piece: str, tokens: tuple[int, ...]) -> None:
        if len(self) > PIECES // 2:
            self.old = dict(self)
            self.clear()
        self[piece] = tokens

    def __missing__(self, piece: str) -> tuple[int, ...]:
        tokens = self.old.get(piece)
        if tokens is None:
            tokens = tuple(self.encoder.transduce(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= LONG:
            self.keep(piece, tokens)
        return tokens


# States of UTF-8: how many bytes a character still needs, and in which range the next one must be.
_START, _REJECT = 0, -1
_NEXT: dict[tuple[int, int], int] = {}
for _b in range(256):
    if _b < 0x80:
        _NEXT[0, _b] = 0
    elif 0xC2 <= _b <= 0xDF:
        _NEXT[0, _b] = 1
    elif 0xE0 <= _b <= 0xEF:
        _NEXT[0, _b] = {0xE0: 4, 0xED: 5}.get(_b, 2)
    elif 0xF0 <= _b <= 0xF4:
        _NEXT[0, _b] = {0xF0: 6, 0xF4: 7}.get(_b, 3)
    for _state, _low, _high, _to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        if _low <= _b <= _high:
            _NEXT[_state, _b] = _to


class Decoder:
    """Streaming: feed tokens in any portions; text comes as soon as its characters are whole.

    Bytes that aren't UTF-8 become U+FFFD, one for each longest part that
    began a character, as the standard recommends.
    """

    def __init__(self, path: str = VOCABULARY):
        self.tokens = _decoded(path)
        self.raw = vocabulary_of(path).bytes
        self.state, self.held = _START, bytearray()

    def _byte(self, b: int, out: list[str]) -> None:
        to = _NEXT.get((self.state, b), _REJECT)
        if to == _REJECT:
            if self.state != _START:  # the part so far was no character; the byte may begin one
                out.append("�")
                self.state = _START
                self.held.clear()
                self._byte(b, out)
            else:
                out.append("�")
            return
        self.held.append(b)
        self.state = to
        if to == _START:
            out.append(self.held.decode("utf-8"))
            self.held.clear()

    def feed(self, tokens: Iterable[int]) -> str:
        pieces = [self.tokens[t] for t in tokens] if self.state == _START else None
        if pieces is not None and None not in pieces:
            return "".join(pieces)
        out: list[str] = []
        for t in tokens:
            whole = self.tokens[t]
            if whole is not None and self.state == _START:
                out.append(whole)
            else:
                for b in self.raw[t]:
                    self._byte(b, out)
        return "".join(out)

    def end(self) -> str:
        """What is left: U+FFFD where the last character isn't whole."""
        left = "�" if self.state != _START else ""
        self.state = _START
        self.held.clear()
        return left


@contextmanager
def _uncollected() -> Iterator[None]:
    """No search for cycles, which states and transitions don't form, while many of them are made."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(2)
def vocabulary_of(path: str) -> Vocabulary:
    return encoder_of(path).vocabulary


@lru_cache(2)
def _decoded(path: str) -> list[str | None]:
    """Tokens that are whole characters, as text; None for others."""
    out: list[str | None] = []
    for raw in vocabulary_of(path).bytes:
        try:
            out.append(raw.decode("utf-8"))
        except UnicodeDecodeError:
            out.append(None)
    return out


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in their order, in portions whose texts (the second column) have ``PORTION`` bytes or little more."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + PORTION)) + 1
        yield batch.slice(at, upto - at)
        at = upto


def encode(docs: DataFrame, path: str = VOCABULARY, verify: bool = True) -> DataFrame:
    """``(doc_id, tokens, n_tokens, exact)`` for every row: its whole text's tokens, and whether they decode to it.

    A null text has no tokens, like an empty one; null ids stay null; repeated
    rows are encoded each; other columns don't matter; an empty table gives
    none. Without ``verify``, exact is null.
    """
    importable(docs.sparkSession)
    schema = "doc_id bigint, tokens array<int>, n_tokens bigint, exact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(path)
        decoder = Decoder(path)
        for b in chain.from_iterable(map(portions, batches)):
            texts = b.column(1).to_pylist()
            with _uncollected():
                own = e.encode_all(texts)
            size = np.array([len(x) for x in own], np.int64)
            flat = np.concatenate([*own, np.zeros(0, np.int32)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
            exact = [decoder.feed(x.tolist()) + decoder.end() == (t or "") for x, t in zip(own, texts)] if verify else [None] * len(own)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(size), pa.array(exact, pa.bool_())], names=["doc_id", "tokens", "n_tokens", "exact"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = VOCABULARY, portion: int = 4096) -> DataFrame:
    """``encoded`` with a column ``text`` of the decoded ``tokens``, read in portions; null tokens give null.

    A column ``text`` that is there already is replaced.
    """
    importable(encoded.sparkSession)

    @F.pandas_udf("string")
    def text(tokens):
        decoder = Decoder(path)
        return tokens.map(lambda x: None if x is None else "".join(decoder.feed(x[i : i + portion].tolist()) for i in range(0, len(x), portion)) + decoder.end())

    (name,) = fresh(encoded, "text") if "text" not in encoded.columns else ("text",)
    return encoded.withColumn(name, text("tokens"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
