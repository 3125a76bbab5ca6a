"""Token counts of a byte-level BPE by two compiled finite-state transducers.

1. *Splitting.* The pattern that cuts a text into pieces before merging is a deterministic transducer over twelve classes of
   characters: a transition says whether a cut lies before the current or the previous character. A stream of texts is
   divided in chunks of equal length; each chunk's map (state at its start → state at its end) is computed for all states
   side by side, the maps are composed by a parallel prefix scan, and one more pass from the now known states gives the cuts.
2. *Merging.* Within a piece, the BPE is a deterministic transducer over bytes whose transitions carry the change of the
   token count. A prefix's last token t is the one vocabulary entry that ends there and is stable after the last token
   before it: a sequence of tokens is the BPE's own exactly if every two neighbours are (Berglund and others, 2023-24).
   So a state is: for each start still inside some entry, the place in the vocabulary's trie, the last token before it and
   the count there, relative to now. States and transitions are made when first reached and kept.

The kept states are dropped when they exceed a fixed number, which changes speed only; all pieces of a batch run through the
transducer side by side. Special strings in a text stand for one token each, as the library's default is.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from glossweave.llm.rows import map_texts

MAX_FILE_BYTES = 64 << 20
CHUNK = 256
#: States of the merging transducer that are kept, and pieces that are no longer worth stepping side by side.
MOST_STATES, FEW = 200_000, 16

# classes of characters
LETTER, ONE, R, V, E, LL, NUMBER, OTHER, QUOTE, SPACE, WHITE, END = range(12)
# states of the splitter: what the piece read so far is
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, SHORT_FORM, SPACE_1, SPACE_N, WHITE_1, WHITE_N = range(13)
STATES = 13
CUT_HERE, CUT_BEFORE_LAST = 1, 2
#: The white space of Unicode.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes(splits=None) -> np.ndarray:
    """Class by code point; one place more for the mark between texts.

    ``splits`` (text → list of pieces) decides for code points that Python's tables leave unassigned: a library may follow
    a later Unicode version.
    """
    table = np.full(sys.maxunicode + 2, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LN":
            table[c] = LETTER if kind[0] == "L" else NUMBER
        elif kind == "Cn" and splits and c < 0x40000:
            x = chr(c)
            table[c] = LETTER if len(splits("a" + x)) == 1 else NUMBER if len(splits("1" + x)) == 1 else OTHER
    table[WHITE_SPACE] = WHITE
    table[0x20], table[ord("'")], table[-1] = SPACE, QUOTE, END
    for letters, kind in (("stmd", ONE), ("r", R), ("v", V), ("e", E), ("l", LL)):
        table[[ord(x) for x in letters]] = kind
    return table


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, cuts), each by class * STATES + state.

    Pieces: the short forms 's 't 'm 'd 're 've 'll; runs of letters, of numbers or of others, with one space before; white
    space, of which the last character before something else is left for that or stands alone.
    """
    letters = {LETTER, ONE, R, V, E, LL}
    fresh = {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: AFTER_QUOTE, SPACE: SPACE_1, WHITE: WHITE_1, END: START} | dict.fromkeys(letters, IN_LETTERS)
    body = {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: IN_OTHERS} | dict.fromkeys(letters, IN_LETTERS)

    def step(state: int, c: int) -> tuple[int, int]:
        if state == IN_LETTERS:
            return (IN_LETTERS, 0) if c in letters else (fresh[c], CUT_HERE)
        if state == IN_NUMBERS:
            return (IN_NUMBERS, 0) if c == NUMBER else (fresh[c], CUT_HERE)
        if state == IN_OTHERS:
            return (IN_OTHERS, 0) if c in (OTHER, QUOTE) else (fresh[c], CUT_HERE)
        if state == AFTER_QUOTE:
            if c in (OTHER, QUOTE):
                return IN_OTHERS, 0
            part = {ONE: SHORT_FORM, R: QUOTE_R, V: QUOTE_V, LL: QUOTE_L}.get(c)
            return (part, 0) if part is not None else (fresh[c], CUT_HERE)
        if state in (QUOTE_R, QUOTE_V, QUOTE_L):
            if c == (LL if state == QUOTE_L else E):
                return SHORT_FORM, 0
            to, cut = step(IN_LETTERS, c)
            return to, cut | CUT_BEFORE_LAST
        if state in (SPACE_1, SPACE_N, WHITE_1, WHITE_N):
            if c in (SPACE, WHITE):
                return (SPACE_N if c == SPACE else WHITE_N), 0
            if c == END:
                return START, CUT_HERE
            cut = CUT_BEFORE_LAST if state in (SPACE_N, WHITE_N) else 0
            return (body[c], cut) if state in (SPACE_1, SPACE_N) else (fresh[c], cut | CUT_HERE)
        return fresh[c], CUT_HERE  # START, SHORT_FORM

    to, cuts = np.zeros(12 * STATES, np.uint8), np.zeros(12 * STATES, np.uint8)
    for c in range(12):
        for s in range(STATES):
            to[c * STATES + s], cuts[c * STATES + s] = step(s, c)
    return to, cuts


def cut_points(kinds: np.ndarray, to: np.ndarray, cuts: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Places before which the splitter cuts, from the classes of a stream that ends with END."""
    n = len(kinds)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, END, np.uint8)
    padded[:n] = kinds
    symbols = np.ascontiguousarray((padded.astype(np.uint8) * STATES).reshape(rows, chunk).T)
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], rows, 1)
    for t in range(chunk):
        maps = to[maps + symbols[t]]
    maps = np.ascontiguousarray(maps.T)
    gap = 1
    while gap < rows:  # prefix scan: after each round a map covers twice as many chunks
        maps = np.concatenate([maps[:gap], np.take_along_axis(maps[gap:], maps[:-gap].astype(np.intp), 1)])
        gap *= 2
    state = np.full(rows, START, np.uint8)
    state[1:] = maps[:-1, START]
    found = np.empty((chunk, rows), np.uint8)
    for t in range(chunk):
        at = state + symbols[t]
        found[t] = cuts[at]
        state = to[at]
    found = found.T.reshape(-1)[:n]
    cut = (found & CUT_HERE) > 0
    cut[:-1] |= (found[1:] & CUT_BEFORE_LAST) > 0
    return np.flatnonzero(cut)


def byte_names() -> dict[str, int]:
    """The vocabulary writes printable bytes as themselves, the others as code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The merging transducer of one vocabulary; counts the tokens of a piece."""

    def __init__(self, model: dict):
        names = byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        self.ids = {raw(k): v for k, v in model["vocab"].items() if all(c in names for c in k)}
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.words = {v: k for k, v in self.ids.items()}
        if max(map(len, self.ids)) > 190 or len(self.ids) >= 1 << 17:
            raise ValueError("entries of at most 190 bytes, fewer than 131072 of them, are supported")
        self.children: dict[int, int] = {}  # node << 8 | byte → node
        self.token = [-1]
        for word, i in self.ids.items():
            node = 0
            for b in word:
                if (child := self.children.get(node << 8 | b)) is None:
                    child = self.children[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                node = child
            self.token[node] = i
        self.stable: dict[tuple[int, int], bool] = {}

        self.inner = {key >> 8 for key in self.children}  # nodes with children
        self.table = np.full((1 << 14, 128), -1, np.int32)  # (state, column) → next state << 6 | change of the count + 32
        self.column, self.columns = np.full(256, -1, np.int16), 0
        self.clear()

    def clear(self) -> None:
        """Forget all transitions; the tables are used again."""
        self.states: list[tuple[int, ...]] = [(self.entry(0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.table[:] = -1

    @staticmethod
    def entry(node: int, last: int, count: int) -> int:
        """A start that is still inside some vocabulary entry, as one number. Counts lie within the longest entry's length."""
        return node << 25 | (last + 1) << 8 | (count + 200)

    def see(self, data: np.ndarray) -> None:
        """Give the bytes that occur a column each."""
        for b in np.flatnonzero(np.bincount(data, minlength=256) > 0):
            if self.column[b] < 0:
                self.column[b] = self.columns
                self.columns += 1
        if self.columns > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.full((len(self.table), 256 - self.table.shape[1]), -1, np.int32)], 1)

    def merged(self, text: bytes) -> list[bytes]:
        """The BPE of a few bytes by its definition; only asked for two neighbouring tokens."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), len(self.rank)))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def follows(self, last: int, token: int) -> bool:
        if (known := self.stable.get((last, token))) is None:
            a, b = [] if last < 0 else [self.words[last]], self.words[token]
            known = self.stable[last, token] = self.merged(b"".join(a) + b) == [*a, b]
        return known

    def step(self, state: int, byte: int) -> int:
        """The transition, made and kept: next state << 6 | change of the token count + 32."""
        alive, token = [], -1
        children, of, inner = self.children, self.token, self.inner
        for e in self.states[state]:
            if (child := children.get(e >> 25 << 8 | byte)) is not None:
                if child in inner:
                    alive.append(child << 25 | e & 0x1FFFFFF)
                if token < 0 and of[child] >= 0 and self.follows((e >> 8 & 0x1FFFF) - 1, of[child]):
                    token, change = of[child], (e & 0xFF) - 200 + 1
        key = (*[e - change for e in alive], self.entry(0, token, 0))
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if to == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        packed = to << 6 | change + 32
        self.table[state, self.column[byte]] = packed
        return packed

    def counts(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of the pieces data[begin:end], all pieces one byte at a time side by side."""
        if len(self.states) > MOST_STATES:
            self.clear()
        order = np.argsort(begin - end, kind="stable")
        at, left = begin[order], (end - begin)[order]
        self.see(data)
        state, total = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        n, t = len(at), 0
        while n:
            n = int(np.searchsorted(-left[:n], -t, side="left"))  # pieces longer than t
            if n <= FEW:
                break
            s, b = state[:n], data[at[:n] + t]
            to = self.table[s, self.column[b]]
            if len(new := np.flatnonzero(to < 0)):
                for pair in np.unique(s[new].astype(np.int64) << 8 | b[new]).tolist():
                    self.step(pair >> 8, pair & 255)
                to = self.table[s, self.column[b]]
            total[:n] += (to & 63) - 32
            state[:n] = to >> 6
            t += 1
        for i in range(n):  # the few longest, each by itself
            s, more = int(state[i]), 0
            for b in data[at[i] + t:at[i] + left[i]].tolist():
                if (to := int(self.table[s, self.column[b]])) < 0:
                    to = self.step(s, b)
                s, more = to >> 6, more + (to & 63) - 32
            total[i] += more
        out = np.empty_like(total)
        out[order] = total
        return out


class Counter:
    """Counts the tokens of many texts."""

    def __init__(self, definition: bytes, table: np.ndarray | None = None, chunk: int = CHUNK):
        spec = json.loads(definition)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre.get("use_regex", True) or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE without normalizer and prefix space is asked for")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merger, self.chunk = Merger(spec["model"]), chunk
        self.classes, (self.to, self.cuts) = classes() if table is None else table, splitter()

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text without its special strings, and how many those are; longer strings first."""
        parts, special = [text], 0
        for s in sorted(self.special, key=len, reverse=True):
            parts = [x for p in parts for x in p.split(s)] if s in text else parts
        special = len(parts) - 1
        return [p for p in parts if p], special

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            if text:
                mine, out[i] = self.segments(text)
                parts += mine
                owner += [i] * len(mine)
        if not parts:
            return out
        stream = "\n".join(parts) + "\n"
        points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(stream.encode(), np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds = self.classes[points]
        kinds[ends] = END
        starts = cut_points(kinds, self.to, self.cuts, self.chunk)
        real = kinds[starts] != END
        of = np.searchsorted(ends, starts[real])  # the segment of each piece
        width = np.ones(len(points) + 1, np.int64)  # byte positions of the characters
        width[0] = 0
        for least in (0x80, 0x800, 0x10000):
            width[1:] += points >= least
        place = np.cumsum(width)
        counts = self.merger.counts(data, place[starts[real]], place[np.append(starts[1:], len(kinds))[real]])
        out += np.bincount(np.asarray(owner)[of], counts, len(texts)).astype(np.int64)
        return out


def library_classes(definition: bytes) -> np.ndarray:
    """Classes as the installed library splits by them."""
    from tokenizers import Tokenizer

    return classes(Tokenizer.from_str(definition.decode()).pre_tokenizer.pre_tokenize_str)


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """Columns ``keep`` + n_bytes, n_tokens, over_limit: UTF-8 bytes and tokens of every whole text.

    ``path``: a tokenizer file of a byte-level BPE, read on the driver and sent to the tasks (64 MB at most, checked).
    Null and empty texts: 0 bytes, 0 tokens. Equal rows stay equal rows; null keys are kept; an empty table gives an empty
    result; other columns are not read; a kept column named like a result is replaced by it.
    """
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} has more than {MAX_FILE_BYTES} bytes")
    with open(path, "rb") as f:
        definition = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((definition, library_classes(definition)))

    def make():
        counter = Counter(*sent.value)

        def work(texts: pa.Array) -> dict:
            n = counter(texts.to_pylist())
            size = pc.binary_length(texts).fill_null(0).cast(pa.int64())
            return {"n_bytes": size, "n_tokens": n, "over_limit": n > limit}

        return work

    return map_texts(docs, list(keep), text, "n_bytes long, n_tokens long, over_limit boolean", make)
