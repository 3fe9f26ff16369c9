"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

``sufficient_lookahead`` derives from the merge list how far a later symbol can still change an earlier token; the
encoder holds a few times that many symbols, emits the tokens before them and continues from the last boundary.

Why the bound holds. Apply the merges in the order of their ranks to a prefix and to the prefix with more text. Both
agree up to a boundary, at first the end of the prefix. Merge (u, v) moves that boundary left only if u ends at it
and v starts at it on one of the sides, and then by the length of u; the token that starts at the boundary now begins
with u. The next merge (u', v') that moves it has a later rank and a v' that begins with u. So the total is at most
the heaviest chain of merges with rising ranks, each one's right part beginning with the left part of the one before,
weighted by the length of left parts. One pass over the list finds it.

Text passes the tokenizer file's own steps (NFC, white space, lower case, split pattern, bytes as characters), with
special tokens cut out first as the file says. Texts are taken in pieces of at most ``PIECE`` characters, cut before a
character that composes with nothing before it; a run of letters or symbols that crosses pieces goes on symbol by
symbol. Words of several texts, or of a part of one, are gathered in a block; its distinct words of up to ``FEW`` symbols
fit the window as a whole and are merged together, one merge of each word at a time, longer ones go through the window
singly. So besides the text itself, as Arrow holds it, working memory is constant: one piece, one block, the window and a
bounded memory of long words met before. Decoding is incremental too: without a decoder in the file token strings are joined by a
space; a byte-level decoder goes through ``ByteText``, a UTF-8 state machine that carries an unfinished character from
piece to piece and puts U+FFFD for what is no UTF-8.

Letters, numbers and white space are those of the tokenizer library's Unicode version (16), lower case of version 17, and NFC
that of its older normalization tables.

Defined cases: a null text is empty and gives no tokens; an empty table gives an empty result; repeated rows are
encoded row by row; other columns are not read. Results hold for every text length: nothing is cut.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.llm.common import kept, table, text_parts

#: Long words whose tokens are remembered by a worker, and the longest such word; bounds its memory.
CACHE_WORDS, CACHE_CHARS = 1 << 16, 64

#: Characters of a text that are looked at in one piece, and tokens of a long run that are handed on at once.
PIECE, BLOCK = 1 << 16, 1 << 13

#: Bytes of the words of a block, which are encoded together.
BLOCK_BYTES = 1 << 21

#: Symbols up to which a word is merged by a search for its lowest rank, without a heap; words of about the same length are merged together, so many at once.
FEW = 48
LENGTHS, TOGETHER = (0, 4, 6, 8, 10, 12, 16, 24, FEW), 1 << 13

#: White space of the Unicode standard, and the letters and numbers that its version 16.0 added to 15.1.
WHITE_SPACE = "9-D 20 85 A0 1680 2000-200A 2028-2029 202F 205F 3000"
LETTERS_16 = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
NUMBERS_16 = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Lower case of letters of versions 16 and 17: first and last capital, first small letter.
LOWER_17 = "1C89-1C89:1C8A A7CB-A7CB:264 A7CC-A7CC:A7CD A7CE-A7CE:A7CF A7D2-A7D2:A7D3 A7D4-A7D4:A7D5 A7DA-A7DA:A7DB A7DC-A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB"
#: Marks that are newer than the library's normalization tables, which take them for characters without a class, and
#: the second part of the one composition that is newer.
LATE_MARKS = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 "
    "11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)


def _points(ranges: str) -> list[int]:
    ends = [(r.split("-")[0], r.split("-")[-1]) for r in ranges.split()]
    return [c for a, b in ends for c in range(int(a, 16), int(b, 16) + 1)]


def _as_class(points: Iterable[int]) -> str:
    """The code points as ranges of a character class."""
    ranges: list[list[int]] = []
    for c in sorted(points):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@cache
def character_classes(last: int) -> dict[str, str]:
    """Members of the classes that split patterns use, up to code point ``last``."""
    kinds: dict[str, set[int]] = {r"\p{L}": set(_points(LETTERS_16)), r"\p{N}": set(_points(NUMBERS_16)), r"\s": set(_points(WHITE_SPACE))}
    for c in range(last + 1):
        kind = rf"\p{{{unicodedata.category(chr(c))[0]}}}"
        if kind in kinds:
            kinds[kind].add(c)
    return {k: _as_class(c for c in points if c <= last) for k, points in kinds.items()}


def compiled(pattern: str, last: int) -> re.Pattern:
    """A split pattern with its classes spelled out, for texts whose code points go up to ``last``."""
    classes, parts, inside = character_classes(last), [], False
    for m in re.finditer(r"\\p\{[LN]\}|\\s|\\.|.", pattern, re.DOTALL):
        piece = m.group()
        if piece in classes:
            parts.append(classes[piece] if inside else f"[{classes[piece]}]")
        elif piece == r"\S" and not inside:
            parts.append(rf"[^{classes[r'\s']}]")
        elif re.fullmatch(r"\\[a-zA-Z]", piece):
            raise ValueError(f"unknown class {piece}")
        else:
            inside = piece == "[" or inside and piece != "]"
            parts.append(piece)
    return re.compile("".join(parts))


_LATE = {a + k: b + k for r in LOWER_17.split() for a, z, b in [[int(x, 16) for x in re.split("[-:]", r)]] for k in range(z - a + 1)}
_ANY_LATE = re.compile(f"[{_as_class(_LATE)}]")


def lower(text: str) -> str:
    """Each character by itself: no final form of sigma."""
    text = text.replace("Σ", "σ").lower()
    return text if text.isascii() or not _ANY_LATE.search(text) else text.translate(_LATE)


def _basic(text: str) -> bool:
    """No code point above U+FFFF."""
    return text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)


def _latin(text: str) -> bool:
    """No code point above U+00FF."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_LATE_MARK, _LATE_BASIC_MARK = (re.compile(f"([{_as_class(c for c in _points(LATE_MARKS) if c <= last)}])") for last in (0x10FFFF, 0xFFFF))


def nfc(text: str) -> str:
    """NFC by the library's tables: nothing is reordered or composed across a mark that they do not know."""
    if _latin(text):
        return text  # composed already
    parts = (_LATE_BASIC_MARK if _basic(text) else _LATE_MARK).split(text)
    return "".join(p if k % 2 else unicodedata.normalize("NFC", p) for k, p in enumerate(parts))


def _joins(c: str) -> bool:
    """Whether a character may compose with one before it: marks, and vowels and finals of Hangul syllables and Kirat Rai."""
    return unicodedata.category(c)[0] == "M" or 0x1160 <= ord(c) <= 0x11FF or 0x16D40 <= ord(c) <= 0x16D6C


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: printable Latin-1 characters for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols after a token boundary that decide whether it lasts. ``length`` gives the number of symbols of a token string."""
    heaviest: dict[str, int] = {}
    most = 0
    for left, right in merges:
        moved = length(left) + max((heaviest.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
        heaviest[left] = max(heaviest.get(left, 0), moved)
        most = max(most, moved)
    return most


class ByteText:
    """Bytes to text, chunk by chunk; keeps at most the bytes of one unfinished character."""

    def __init__(self) -> None:
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._state.decode(data)

    def end(self) -> str:
        return self._state.decode(b"", True)


class Words(dict):
    """Tokens of words met before. Two generations keep the frequent ones and bound the memory."""

    def __init__(self, encode) -> None:
        self.encode, self.old = encode, {}

    def __missing__(self, w: str):
        found = self.old.get(w) or self.encode(w)
        if len(w) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[w] = found
        return found


class Pairs:
    """Ranks of pairs of numbers (left << 32 | right), looked up together."""

    def __init__(self, ranks: dict[int, int]) -> None:
        keys, values = (np.fromiter(x, np.int64, len(ranks)) for x in (ranks, ranks.values()))
        by = np.argsort(keys)
        self.keys, self.values = np.append(keys[by], -1), np.append(values[by], 0).astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        """``none`` for what is no pair; numbers below 0 are in none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where((self.keys[at] == key) & (right >= 0), self.values[at], np.int32(none))


def _offsets(values: pa.BinaryArray) -> np.ndarray:
    return np.frombuffer(values.buffers()[1], np.int32, len(values) + 1)


class Transducer:
    """Encoder and decoder of one tokenizer file (its JSON text)."""

    def __init__(self, spec: str) -> None:
        t = json.loads(spec)
        model = t["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models are supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: k for k, m in enumerate(merges)}
        self.ids = model["vocab"]
        # Words are merged as numbers: of strings, and of pairs of them.
        number: dict[str, int] = {}
        of = lambda x: number.setdefault(x, len(number))
        numbered = [(of(a), of(b), of(a + b)) for a, b in merges]
        self.number, self.joined = number, [j for _, _, j in numbered]
        self.pairs = {a << 32 | b: k for k, (a, b, _) in enumerate(numbered)}
        for s in self.ids:
            of(s)
        if missing := [s for s in number if s not in self.ids]:
            raise ValueError(f"merges make {missing[0]!r}, which has no id")
        self.lookahead = sufficient_lookahead(merges, lambda s: len(s) - len(self.suffix) + 1 if self.suffix and s.endswith(self.suffix) else len(s))
        self.chars = byte_characters()
        added = {a["content"]: a for a in t.get("added_tokens") or []}
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added.values()):
            raise ValueError("only plain special tokens are supported")
        self.added = {s: a["id"] for s, a in added.items()}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.strings = {k: s for s, k in self.ids.items()} | {k: s for s, k in self.added.items()}
        self.patterns: dict[int, tuple[re.Pattern, list[re.Pattern]]] = {}
        self.split, self.bytes_as_chars = self._splitter(t.get("pre_tokenizer"))
        self.steps = self._normalizers(t.get("normalizer"))
        kind = (t.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"unknown decoder {kind}")
        self.byte_decoder = kind == "ByteLevel"
        values = {c: b for b, c in self.chars.items()}
        if self.byte_decoder:
            self.pieces = {k: bytes(values[c] for c in s) if all(c in values for c in s) else s.encode() for k, s in self.strings.items()}
        else:
            self.pieces = {k: b" " + s.encode() for k, s in self.strings.items()}
        self.names = list(number)
        # By number, those of special tokens last: ids after a space, decoded bytes.
        by_number = [*map(self.ids.__getitem__, self.names), *self.added.values()]
        self.number_of = {i: k for k, i in enumerate(by_number)}
        self.id_texts = pa.array([b" %d" % i for i in by_number], pa.binary())
        self.decoded = pa.array(list(map(self.pieces.__getitem__, by_number)), pa.binary())
        self.symbol, self.last_symbol = (np.array([number.get(self.chars[b] + end, -1) for b in range(256)], np.int32) for end in ("", self.suffix))
        self.arrays = self.bytes_as_chars and self.symbol.min() >= 0 and self.last_symbol.min() >= 0
        self.table = Pairs(self.pairs)
        self.results = np.array(self.joined, np.int32)
        self.known = Words(self.encode_word)

    def _normalizers(self, n: dict | None) -> list:
        steps = []
        for s in (n or {}).get("normalizers", [n] if n else []):
            if s["type"] == "NFC":
                steps.append(nfc)
            elif s["type"] == "Lowercase":
                steps.append(lower)
            elif s["type"] == "Replace" and (s["pattern"].get("Regex"), s["content"]) == (r"\s+", " "):
                # No word holds white space, so its amount decides nothing.
                if not self.split or any(self.pattern("").search(chr(c)) for c in _points(WHITE_SPACE)) or " " in self.split:
                    steps.append(lambda x, p=compiled(r"\s+", 0x10FFFF): p.sub(" ", x))
            else:
                raise ValueError(f"unknown normalizer {s['type']}")
        return steps

    @staticmethod
    def _splitter(p: dict | None) -> tuple[str | None, bool]:
        pattern, as_chars = None, False
        for s in (p or {}).get("pretokenizers", [p] if p else []):
            if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] or s["type"] == "Split" and s["behavior"] == "Isolated" and not s["invert"]:
                pattern = s["pattern"]["Regex"]
            elif s["type"] == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space"):
                as_chars = True
            else:
                raise ValueError(f"unknown pre-tokenizer {s}")
        return pattern, as_chars

    def _compiled(self, last: int) -> tuple[re.Pattern, list[re.Pattern]]:
        """The split pattern, and those of its alternatives that are runs of one class."""
        if last not in self.patterns:
            self.patterns[last] = compiled(self.split, last), [compiled(r, last) for r in re.findall(r"\[[^\]]*\]\+", self.split)]
        return self.patterns[last]

    def pattern(self, text: str) -> re.Pattern:
        """The split pattern for the text: a smaller one if it has no code point above U+FFFF."""
        return self._compiled(0xFFFF if _basic(text) else 0x10FFFF)[0]

    def _normal(self, text: str) -> str:
        for step in self.steps:
            text = step(text)
        return text

    def _normal_pieces(self, text: str, at: int, end: int) -> Iterator[str]:
        while end - at > PIECE:
            cut = max(text.rfind(" ", at + 1, at + PIECE), text.rfind("\n", at + 1, at + PIECE))
            if cut < 0:
                cut = at + PIECE
                while cut < end and _joins(text[cut]):
                    cut += 1
            yield self._normal(text[at:cut])
            at = cut
        yield self._normal(text[at:end])

    def words(self, text: str) -> Iterator[list[str] | int | Iterator[str]]:
        """In order: lists of words, ids of special tokens, and parts of a run too long for one piece."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._plain(text, at, m.start())
            yield self.added[m.group()]
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, end: int) -> Iterator[list[str] | Iterator[str]]:
        if not self.split:
            if at < end:
                yield self._normal_pieces(text, at, end)
            return
        if end - at <= PIECE:
            held = self._normal(text[at:end])
            yield self.pattern(held).findall(held)
            return
        held, pieces = "", self._normal_pieces(text, at, end)
        for piece in pieces:
            if not held or piece[:1] in " \n":
                if held:
                    yield self.pattern(held).findall(held)
                held = piece
                continue
            found = self.pattern(held).findall(held)
            last = found.pop() if found and held.endswith(found[-1]) else ""
            yield found
            run = next((r for r in self._compiled(0x10FFFF)[1] if len(last) >= PIECE // 2 and r.fullmatch(last)), None)
            if not run:
                held = last + piece
                continue
            rest: list[str] = [piece]

            def parts(run=run, last=last, rest=rest):
                yield last
                while rest[0]:
                    more = run.match(rest[0])
                    if not more:
                        return
                    yield more.group()
                    rest[0] = rest[0][more.end() :] or next(pieces, "")

            yield parts()
            held = rest[0]
        if held:
            yield self.pattern(held).findall(held)

    def symbols(self, parts: Iterable[str]) -> Iterator[str]:
        for part in parts:
            for c in part:
                if self.bytes_as_chars:
                    yield from map(self.chars.__getitem__, c.encode())
                else:
                    yield c

    def merge(self, parts: list[str]) -> list[str]:
        """The merges of lowest rank first, leftmost first."""
        return self._merge_few(parts) if len(parts) <= FEW else self._merge_many(parts)

    def _merge_few(self, parts: list[str]) -> list[str]:
        """Ranks of neighbours are kept and mended around each merge."""
        rank, none = self.ranks.get, len(self.ranks)
        ranks = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            parts[k : k + 2] = (parts[k] + parts[k + 1],)
            del ranks[k]
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), none)
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), none)
        return parts

    def _merge_many(self, parts: list[str]) -> list[str]:
        """A heap of (rank, place) over linked places; entries whose pair has changed are skipped."""
        rank, n = self.ranks.get, len(parts)
        ranks = [rank(p, -1) for p in zip(parts, parts[1:], strict=False)] + [-1]
        heap = [r * n + k for k, r in enumerate(ranks) if r >= 0]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, k = divmod(heappop(heap), n)
            if ranks[k] != r:
                continue
            gone = after[k]
            parts[k] += parts[gone]
            ranks[gone], parts[gone] = -1, ""
            right = after[k] = after[gone]
            ranks[k] = -1
            if right < n:
                before[right] = k
                ranks[k] = r = rank((parts[k], parts[right]), -1)
                if r >= 0:
                    heappush(heap, r * n + k)
            left = before[k]
            if left >= 0:
                ranks[left] = r = rank((parts[left], parts[k]), -1)
                if r >= 0:
                    heappush(heap, r * n + left)
        return [p for p in parts if p]

    def stream(self, symbols: Iterator[str]) -> Iterator[str]:
        """Tokens of one word as soon as they are stable. Holds at most eight times the lookahead and one token more."""
        window, ended = [], False
        room = 8 * self.lookahead + 64
        while not ended:
            more = list(islice(symbols, room + 1 - len(window)))
            window += more
            ended = len(window) <= room
            if ended:
                if self.suffix and window:
                    window[-1] += self.suffix
                yield from self.merge(window)
                return
            at = 0
            # The last symbol is held back: it may turn out to be the word's last.
            for token in self.merge(window[:-1]):
                if at + len(token) > len(window) - 1 - self.lookahead:
                    break
                yield token
                at += len(token)
            if not at:
                room *= 2  # cannot happen while a token is shorter than the room beyond the lookahead
            window = window[at:]

    def encode_word(self, word: str) -> list[int]:
        """Numbers of the tokens of one word."""
        return list(map(self.number.__getitem__, self._merge_word(word) if len(word) <= FEW else self.stream(self.symbols([word]))))

    def _merge_word(self, word: str) -> list[str]:
        """Tokens of a short word: the same merges as ``_merge_few``, on numbers."""
        symbols = list(map(self.chars.__getitem__, word.encode())) if self.bytes_as_chars else list(word)
        symbols[-1] += self.suffix
        if len(symbols) > FEW:
            return self.merge(symbols)
        try:
            parts = list(map(self.number.__getitem__, symbols))
        except KeyError:
            return self.merge(symbols)  # a symbol of no merge
        rank, none, joined = self.pairs.get, len(self.joined), self.joined
        ranks = [rank(a << 32 | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            parts[k] = new = joined[best]
            del parts[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1] << 32 | new, none)
            if k < len(ranks):
                ranks[k] = rank(new << 32 | parts[k + 1], none)
        return list(map(self.names.__getitem__, parts))

    def forget(self) -> None:
        """Gives back the memory of remembered words: a worker goes on to other tasks."""
        self.known = Words(self.encode_word)

    def _merge_together(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens of short words, one after another, and how many each has: the merges of ``_merge_few``, each time one of every word.

        A column holds a word's linked symbols, between two places without a symbol; a place's key is its pair's rank and the place.
        """
        n, place, none = len(sizes), np.arange(longest + 2, dtype=np.int32)[:, None], len(self.joined) << 6
        column = np.arange(n)
        symbols = data[np.minimum(starts + place - 1, len(data) - 1)]
        parts = np.where((place > 0) & (place < sizes), self.symbol[symbols], np.int32(-1))
        parts[sizes, column] = self.last_symbol[data[starts + sizes - 1]]
        keys = np.full(parts.shape, none, np.int32)
        keys[:-1] = self.table.ranks(parts[:-1], parts[1:], none >> 6) << 6 | place[:-1]
        after, before = (np.repeat(x, n, axis=1).ravel() for x in (place + 1, place - 1))
        flat, flat_keys = parts.ravel(), keys.ravel()
        while True:
            best = keys.min(axis=0)
            live = np.flatnonzero(best < none)
            if not live.size:
                break
            best = best[live]
            rank, at = best >> 6, best & 63
            here = at * n + live
            gone = after[here] * n + live
            right, left = after[gone], before[here]
            to_right, to_left = right * n + live, left * n + live
            new = self.results[rank]
            flat[here], flat[gone], flat_keys[gone] = new, -1, none
            after[here], before[to_right] = right, at
            ranks = self.table.ranks(np.concatenate([flat[to_left], new]), np.concatenate([new, flat[to_right]]), none >> 6) << 6
            flat_keys[to_left], flat_keys[here] = ranks[: live.size] | left, ranks[live.size :] | at
        words = parts.T
        there = words >= 0
        return words[there], there.sum(axis=1)

    def _tokens(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the tokens of distinct words, one word after another, how many each has, and each word's place in that order."""
        ends, data = (np.frombuffer(b, t) if b else np.zeros(0, t) for b, t in zip(words.buffers()[1:], (np.int32, np.uint8), strict=True))
        starts = ends[: len(words)].astype(np.int64)
        sizes = np.diff(ends[: len(words) + 1])
        together = (sizes > 0) & self.arrays
        order, tokens, counts = [], [], []
        for low, high in pairwise(LENGTHS):
            alike = np.flatnonzero(together & (low < sizes) & (sizes <= high))
            for k in range(0, alike.size, TOGETHER):
                at = alike[k : k + TOGETHER]
                found, many = self._merge_together(data, starts[at], sizes[at], high)
                order, tokens, counts = [*order, at], [*tokens, found], [*counts, many]
        rest = np.flatnonzero(~together | (sizes > FEW))
        singly = [self.known[w] if w else [] for w in words.take(pa.array(rest)).to_pylist()]
        order, tokens, counts = [*order, rest], [*tokens, *(np.array(x, np.int32) for x in singly)], [*counts, np.array(list(map(len, singly)), np.int64)]
        place = np.empty(len(words), np.int32)
        place[np.concatenate(order)] = np.arange(len(words))
        return np.concatenate([np.zeros(0, np.int32), *tokens]), np.concatenate(counts), place

    def _items(self, text: str) -> Iterator[list[str] | tuple[int, ...]]:
        """In order: lists of words, and numbers of tokens that are known already."""
        for w in self.words(text):
            if isinstance(w, list):
                yield w
            elif isinstance(w, int):
                yield (self.number_of[w],)
            else:
                tokens = self.stream(self.symbols(w))
                while numbers := tuple(self.number[t] for t in islice(tokens, BLOCK)):
                    yield numbers

    def encoded(self, texts: Iterable[str | None]) -> Iterator[tuple[int, int, bytes, bytes]]:
        """Parts of texts, in order: the text's place, its number of tokens, their ids with a space before each, their decoded bytes."""
        held, fixed, ends, n, size = [], {}, [], 0, 0
        for row, text in enumerate(texts):
            for item in self._items(text or ""):
                if isinstance(item, tuple):
                    fixed[n] = item
                held.append(pa.array([""] if isinstance(item, tuple) else item, pa.string()))
                n += len(held[-1])
                size += held[-1].nbytes + (8 * len(item) if isinstance(item, tuple) else 0)
                if size >= BLOCK_BYTES:
                    yield from self._block(held, fixed, [*ends, (row, n)])
                    held, fixed, ends, n, size = [], {}, [], 0, 0
            ends.append((row, n))
        if held:
            yield from self._block(held, fixed, ends)

    def _block(self, held: list[pa.Array], fixed: dict[int, tuple[int, ...]], ends: list[tuple[int, int]]) -> Iterator[tuple[int, int, bytes, bytes]]:
        """The parts of a block: its words, the tokens of those that are known already, and (text, end of its words)."""
        words = pa.concat_arrays(held).dictionary_encode()
        tokens, counts, place = self._tokens(words.dictionary)
        index = place[words.indices.to_numpy()]
        if fixed:
            index[list(fixed)] = np.arange(len(counts), len(counts) + len(fixed))
            tokens = np.concatenate([tokens, *(np.array(x, np.int32) for x in fixed.values())])
            counts = np.append(counts, list(map(len, fixed.values())))
        first = np.concatenate([[0], np.cumsum(counts)])
        stops = np.array([0, *(end for _, end in ends)])
        many = np.diff(np.concatenate([[0], np.cumsum(counts[index])])[stops])

        def parts(of_tokens: pa.BinaryArray) -> Iterator[bytes]:
            found = of_tokens.take(pa.array(tokens))
            of_words = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(_offsets(found)[first]), found.buffers()[2]])
            text = of_words.take(pa.array(index))
            data = memoryview(text.buffers()[2] or b"")
            yield from (bytes(data[a:b]) for a, b in pairwise(_offsets(text)[stops].tolist()))

        yield from zip((row for row, _ in ends), many.tolist(), parts(self.id_texts), parts(self.decoded), strict=True)

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """Ids in blocks."""
        for _, _, ids, _ in self.encoded([text]):
            yield list(map(int, ids.split()))

    def decode(self, blocks: Iterable[list[int]]) -> Iterator[str]:
        """Text in chunks."""
        return self.text_of(b"".join(map(self.pieces.__getitem__, ids)) for ids in blocks)

    def text_of(self, data: Iterable[bytes]) -> Iterator[str]:
        """The decoded text of the bytes of tokens, in chunks."""
        state, first = ByteText(), not self.byte_decoder
        for part in data:
            if first and part:
                part, first = part[1:], False
            yield state.feed(part)
        yield state.end()


class Row:
    """Running count and digests of one text."""

    def __init__(self, t: Transducer) -> None:
        self.n, self.ids, self.text, self.bytes, self.spaced = 0, hashlib.sha256(), hashlib.sha256(), ByteText(), not t.byte_decoder

    def add(self, n: int, ids: bytes, data: bytes) -> None:
        # Nothing is put before a text's first token.
        self.ids.update(ids if self.n else ids[1:])
        self.text.update(self.bytes.feed(data[1:] if self.spaced and not self.n else data).encode())
        self.n += n

    def done(self) -> tuple[int, str, str]:
        self.text.update(self.bytes.end().encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def transducer(spec: str) -> Transducer:
    return kept(("bpe", spec), lambda: Transducer(spec))


def round_trip(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of the ids and of the decoded text, one row per row of ``docs``.

    ``spec`` is the tokenizer file's JSON text: it travels with the task, so executors need no file of the driver.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(spec)
        for b in text_parts(batches, 1, BLOCK_BYTES):
            rows = [Row(t) for _ in range(b.num_rows)]
            for k, n, ids, data in t.encoded(x.as_py() for x in b.column(1)):
                rows[k].add(n, ids, data)
            counts, id_sums, text_sums = zip(*(r.done() for r in rows), strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())], names=["id", "n", "a", "b"])
        t.forget()

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = narrow.mapInArrow(of_batches, f"id {narrow.schema['id'].dataType.simpleString()}, n long, a string, b string")
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")


def tokenizer_spec(path: str | None = None) -> str:
    """Text of a tokenizer file; the default is the public lower-casing vocabulary of 49,408 tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_spec())


QUERIES = {"op2_bpe": op2_bpe}
SQL: dict[str, str] = {}
