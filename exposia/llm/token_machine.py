"""Token counts from finite-state transducers compiled from a vocabulary of merges.

Two machines are made from the vocabulary file alone; its library encodes no text.

* The splitter cuts normalised text into words. It is compiled from the file's split pattern over
  classes of characters. Text is cut into chunks; the map from every state before a chunk to the
  state after it is computed for all chunks at once, the maps are composed by a parallel prefix scan,
  and a last run from the then known states marks the cuts.
* The word machine reads the bytes of a word. A sequence of tokens is what the merges give exactly
  when every two neighbours are what the merges give for the two alone, so the last token of each
  prefix follows from a bounded stretch before it. A state is the last settled token and the bytes
  after it: a token is settled when every token that may still come starts behind it. Each transition
  carries the number of tokens that it settles, the end of the word those that remain. States are
  made when first reached and dropped together when there are too many.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from exposia.llm.text import prefix_hash, span_hash, text_chunks, worker_state

LIMIT = 2048
CHUNK = 256  # characters a state map spans
MOST_STATES = 500_000
MOST_WORDS, KEPT_WORD = 400_000, 64  # words remembered by a worker, and their longest
END = "Ā"  # closes the last symbol of a word; bytes are the characters below it
_WORD_END = "</w>"
_NOWHERE = 255

SPACE, LETTER, NUMBER, OTHER = range(4)
# The classes a split pattern may be made of, and the kind of normalisation read.
_CLASSES = {r"[\p{L}]+": (LETTER, True), r"[\p{N}]": (NUMBER, False), r"[^\s\p{L}\p{N}]+": (OTHER, True)}
_NORMALISERS = ["NFC", "Replace", "Lowercase"]
_ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


class Splitter:
    """Words of a text: tables of next states and of cuts, by state and symbol.

    A symbol is a class of characters, or one character that the pattern's fixed strings hold. A cut
    is a bit: before the current character, before the one read earlier, and so on.
    """

    def __init__(self, pattern: str):
        parts = pattern.split("|")
        self.fixed = [p for p in parts if p not in _CLASSES]
        if set(parts[len(self.fixed) :]) != set(_CLASSES) or any(re.search(r"[\\\[\]+*?(){}.^$]", p) for p in self.fixed):
            raise ValueError(f"unknown split pattern: {pattern}")
        heads = {p[0] for p in self.fixed}
        if any(c in heads for p in self.fixed for c in p[1:]) or any(a != b and b.startswith(a) for a in self.fixed for b in self.fixed):
            raise ValueError("fixed strings that overlap")
        self.runs = dict(_CLASSES.values())
        self.characters = sorted({c for p in self.fixed for c in p})
        self.classes = [SPACE, LETTER, NUMBER, OTHER] + [self._kind(c) for c in self.characters]
        self.spelled = [None] * 4 + self.characters
        states: list[tuple] = [("fresh",)]
        moves: list[list[tuple[int, int]]] = []
        for state in states:  # grows
            row = []
            for symbol in range(len(self.classes)):
                after, cuts = self._step(state, symbol)
                if after not in states:
                    states.append(after)
                row.append((states.index(after), cuts))
            moves.append(row)
        self.next = np.array([[m[0] for m in row] for row in moves], np.uint8)
        self.cuts = np.array([[m[1] for m in row] for row in moves], np.uint8)

    @staticmethod
    def _kind(c: str) -> int:
        return LETTER if c.isalpha() else NUMBER if c.isnumeric() else OTHER

    def _step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        if state[0] != "fixed":
            return self._begin_or_go_on(state, symbol)
        seen = state[1]
        c = self.spelled[symbol]
        if c is not None and seen + c in self.fixed:
            return ("fresh",), 0
        if c is not None and any(p.startswith(seen + c) for p in self.fixed):
            return ("fixed", seen + c), 0
        # no fixed string after all: what was held is read again as classes
        now, cuts = ("run", self._kind(seen[0])), 0
        if not self.runs[self._kind(seen[0])]:
            now = ("fresh",)
        for back, held in zip(range(len(seen) - 1, 0, -1), seen[1:]):
            now, cut = self._begin_or_go_on(now, 4 + self.characters.index(held))
            cuts |= cut << back
        now, cut = self._begin_or_go_on(now, symbol)
        return now, cuts | cut

    def _begin_or_go_on(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        kind, c = self.classes[symbol], self.spelled[symbol]
        if kind == SPACE:
            return ("fresh",), 0
        if state == ("run", kind):
            return state, 0
        if c is not None and any(p.startswith(c) for p in self.fixed):
            return ("fixed", c), 1
        return (("run", kind) if self.runs[kind] else ("fresh",)), 1

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Where words start. The text must end with a space."""
        n, n_symbols = len(symbols), self.next.shape[1]
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, SPACE, np.int64)
        grid[:n] = symbols
        columns = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        follow, cuts = self.next.ravel().astype(np.int64), self.cuts.ravel()
        maps = np.repeat(np.arange(len(self.next))[:, None], rows, axis=1)
        for symbol in columns:
            maps = follow[maps * n_symbols + symbol]
        entry = np.zeros(rows, np.int64)
        entry[1:] = composed(maps.T)[:-1, 0]
        marks = np.zeros((CHUNK, rows), np.uint8)
        for j, symbol in enumerate(columns):
            at = entry * n_symbols + symbol
            marks[j], entry = cuts[at], follow[at]
        marks = marks.T.ravel()
        found = marks & 1
        for back in range(1, int(self.cuts.max()).bit_length()):
            found[:-back] |= (marks[back:] >> back) & 1
        return np.flatnonzero(found[:n])


def composed(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (one row a chunk): row i is map 0, then 1, ... then i."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def _byte_of() -> dict[str, str]:
    """The character that stands for each byte in vocabularies of this kind, turned back."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(others)}


class WordMachine:
    """Number of tokens of a word, by a transducer over its bytes that is made as it is used."""

    def __init__(self, vocabulary: Sequence[str], merges: Sequence[Sequence[str]], most_states: int = MOST_STATES):
        table = str.maketrans(_byte_of())

        def own(token: str) -> str:
            ended = token.endswith(_WORD_END)
            return (token.removesuffix(_WORD_END) if ended else token).translate(table) + END * ended

        self.rank = {(own(a), own(b)): i for i, (a, b) in enumerate(merges)}
        if any(a.endswith(END) for a, _ in self.rank):
            raise ValueError("a merge goes on after the end of a word")
        if max(map(len, vocabulary)) > 120:
            raise ValueError("tokens too long for positions of a byte")
        self.tokens = {own(t) for t in vocabulary}
        self.prefixes = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.most_states = most_states
        self.whole: set[str] = set()  # tokens found to be what the merges make of their own symbols
        self.fit: dict[tuple[str, str], bool] = {}
        self._clear()

    def _clear(self) -> None:
        """Forget all states but the first. Held of a state: its last settled token and the text after
        it; where the last token of each prefix of that text starts; its moves and the tokens left at an end."""
        self.number: dict[tuple[str, str], int] = {}
        self.keys: list[tuple[str, str]] = []
        self.parents: list[bytes] = []
        self.moves: dict[int, int] = {}  # state and byte in one, to next state and settled tokens in one
        self.left: dict[int, int] = {}
        self._state(("", ""), b"\0")

    def _state(self, key: tuple[str, str], parents: bytes) -> int:
        found = self.number.setdefault(key, len(self.keys))
        if found == len(self.keys):
            self.keys.append(key)
            self.parents.append(parents)
        return found

    def merged(self, symbols: list[str]) -> list[str]:
        """The tokens that the merges make of symbols: lowest rank first, from the left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = [self.rank.get(pair, len(self.rank)) for pair in zip(symbols, symbols[1:])]
            least = min(ranks)
            if least == len(self.rank):
                break
            at = ranks.index(least)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    @staticmethod
    def _symbols(token: str) -> list[str]:
        return [*token[:-2], token[-2:]] if token.endswith(END) else list(token)

    def _fits(self, before: str, token: str) -> bool:
        """Whether the merges keep both tokens as they are when they stand side by side."""
        if token not in self.whole:
            if self.merged(self._symbols(token)) != [token]:
                self.tokens.discard(token)
                return False
            self.whole.add(token)
        if not before:
            return True
        pair = (before, token)
        if pair not in self.fit:
            if len(self.fit) > self.most_states:
                self.fit.clear()
            self.fit[pair] = self.merged(self._symbols(before) + self._symbols(token)) == [before, token]
        return self.fit[pair]

    def _last_token(self, last: str, parents: bytes, text: str) -> int:
        """Where the last token of the text starts."""
        for p, up in enumerate(parents):
            if up != _NOWHERE and text[p:] in self.tokens and self._fits(text[up:p] if p else last, text[p:]):
                return p
        return _NOWHERE

    @staticmethod
    def _depth(parents: bytes, at: int) -> int:
        depth = 0
        while at:
            at, depth = parents[at], depth + 1
        return depth

    def _move(self, state: int, byte: int) -> int:
        (last, tail), parents = self.keys[state], self.parents[state]
        text = tail + chr(byte)
        parents += bytes([self._last_token(last, parents, text)])
        # where a token that is still to come may start, and the last cut that all of these share
        open_at = {p for p in range(len(tail) + 1) if parents[p] != _NOWHERE and text[p:] in self.prefixes}
        open_at.add(len(text))
        while len(open_at) > 1:
            top = max(open_at)
            open_at.remove(top)
            open_at.add(parents[top])
        settled = open_at.pop()
        if settled:
            last = text[parents[settled] : settled]
            kept = bytearray(1)
            for up in parents[settled + 1 :]:
                through = up != _NOWHERE and up >= settled and kept[up - settled] != _NOWHERE
                kept.append(up - settled if through else _NOWHERE)
            after = self._state((last, text[settled:]), bytes(kept))
        else:
            after = self._state((last, text), parents)
        found = self.moves[state << 8 | byte] = after << 8 | self._depth(parents, settled)
        return found

    def count(self, word: bytes) -> int:
        """Tokens of a word of at least one byte."""
        if len(self.keys) > self.most_states:
            self._clear()
        state = total = 0
        moves = self.moves
        for i, byte in enumerate(word):
            found = moves.get(state << 8 | byte)
            if found is None:
                found = self._move(state, byte)
            state, total = found >> 8, total + (found & 255)
            if i & 0xFFFF == 0xFFFF and len(self.keys) > self.most_states:  # within a very long word
                key, parents = self.keys[state], self.parents[state]
                self._clear()
                moves, state = self.moves, self._state(key, parents)
        if state not in self.left:
            (last, tail), parents = self.keys[state], self.parents[state]
            self.left[state] = self._depth(parents, self._last_token(last, parents, tail + END)) + 1
        return total + self.left[state]


class Counter:
    """Token counts of many texts, as the library of the vocabulary file counts them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, normaliser, split = (spec[k] or {} for k in ("model", "normalizer", "pre_tokenizer"))
        kinds = [n["type"] for n in normaliser.get("normalizers", [])]
        first, second = split.get("pretokenizers", [{}, {}])
        settings = {"type": "BPE", "end_of_word_suffix": _WORD_END, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
        if (
            any(model.get(k) != v for k, v in settings.items())
            or kinds != _NORMALISERS
            or (first.get("type"), first.get("behavior"), first.get("invert")) != ("Split", "Removed", True)
            or (second.get("type"), second.get("add_prefix_space"), second.get("use_regex")) != ("ByteLevel", False, False)
            or any(t[k] != v for t in spec["added_tokens"] for k, v in _ADDED.items())
        ):
            raise ValueError(f"not a vocabulary of the known kind: {path}")
        self.splitter = Splitter(first["pattern"]["Regex"])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.machine = WordMachine(list(model["vocab"]), merges)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        # what the file's normaliser and split make of a single character, asked for when first met
        tokenizer = Tokenizer.from_file(path)
        self._normal, self._split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.small = np.zeros(0x110000, np.uint32)
        self.symbol = np.full(0x110000, 255, np.uint8)
        self.longer: dict[int, str] = {}
        self.words: dict[bytes, int] = {}

    def _learn(self, c: int) -> None:
        """Lower case and symbol of a character."""
        small = self._normal(chr(c))
        if len(small) != 1:
            self.longer[c] = small
            self.small[c], self.symbol[c] = c, OTHER
            return
        if small in self.splitter.characters:
            symbol = 4 + self.splitter.characters.index(small)
        elif small == " ":
            symbol = SPACE
        elif len(self._split("a" + small)) == 1:
            symbol = LETTER
        else:
            symbol = OTHER if len(self._split("!" + small)) == 1 else NUMBER
        self.small[c], self.symbol[c] = ord(small), symbol

    def _points(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        fresh = points[self.symbol[points] == 255]
        for c in np.unique(fresh).tolist():
            self._learn(c)
        return points

    def counts(self, texts: Sequence[str | None]) -> np.ndarray:
        pieces, owner, total = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = self.added.split(text or "") if "<|" in (text or "") else [text or ""]
            total[i] = len(parts) - 1
            for part in filter(None, parts):
                pieces.append(part if part.isascii() or unicodedata.is_normalized("NFC", part) else unicodedata.normalize("NFC", part))
                owner.append(i)
        if not pieces:
            return total
        self._points("".join(pieces))
        if self.longer:
            pieces = [p if p.isascii() else p.translate(self.longer) for p in pieces]
        points = self._points("\n".join(pieces) + "\n")
        small = self.small[points]
        starts = self.splitter.starts(self.symbol[points])
        if not len(starts):
            return total
        spaces = np.flatnonzero(self.symbol[points] == SPACE)
        ends = np.minimum(np.r_[starts[1:], len(points)], spaces[np.searchsorted(spaces, starts)])
        width = 1 + (small >= 0x80) + (small >= 0x800) + (small >= 0x10000).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(width)])
        raw = small.astype("<u4").tobytes().decode("utf-32-le").encode()
        first, last = at[starts], at[ends]
        running = prefix_hash(np.frombuffer(raw, np.uint8))
        _, one, same = np.unique(span_hash(running, first, last), return_index=True, return_inverse=True)
        tokens = np.array([self._word(raw[a:b]) for a, b in zip(first[one].tolist(), last[one].tolist())], np.int64)[same]
        lengths = np.cumsum([len(p) + 1 for p in pieces])
        document = np.array(owner)[np.searchsorted(lengths, starts, "right")]
        return total + np.bincount(document, weights=tokens, minlength=len(texts)).astype(np.int64)

    def _word(self, word: bytes) -> int:
        if word in self.words:
            return self.words[word]
        found = self.machine.count(word)
        if len(word) <= KEPT_WORD:
            if len(self.words) >= MOST_WORDS:
                self.words.clear()
            self.words[word] = found
        return found


def _count(path: str):
    mark = f"token machine {path}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, keep=mark):
            counter: Counter = worker_state(mark, lambda: Counter(path))
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            counts = counter.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), size, pa.array(counts)], names=["row", "n_bytes", "n_tokens"])

    return rows


def count_tokens(docs: DataFrame, path: str, *, keep: Sequence[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """``row`` (the ``keep`` columns, all by default), ``n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``path`` is the vocabulary file, the same on every executor. Counted is the whole text without
    begin, end or added tokens; special strings inside a text are one token each, as the library's
    default has it. A null, empty or blank text has none. Rows stand alone: repeated ids, null ids and
    other columns do not matter, and an empty table gives no rows. Words are told apart by 64-bit hashes.
    """
    names = list(keep) if keep is not None else docs.columns
    rows = docs.select("text", F.struct(*[f"`{c}`" for c in names]).alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(_count(path), schema).withColumn("over_limit", F.col("n_tokens") > limit)
