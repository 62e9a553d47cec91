"""Token counts: the exact number of tokens of every prefix of every text, by prefix dynamic programming.

A byte-pair encoding of a string ends in the one token t for which the encoding of what stands before t ends in a token
that stays apart from t when both are encoded together. So the last token and the number of tokens of each prefix follow
from those of shorter prefixes, and no prefix is ever encoded again. Words of this vocabulary end in symbols of their own
("</w>"); a prefix therefore has two states: the encoding of its symbols while the word goes on (``open``), and the count
if the text were cut here (``closed``), one look-up of the last, closing token on top of an open state.

White space never belongs to a token, so the counts of a text are those of its words, shifted by what stands before. Each
distinct word of a slice of texts is computed once: the pre-tokens of all of them go through the recurrence together, one
byte further at each step, in numpy (``_Together``). Words that need care (contractions, special strings, letters whose
accents stand apart, very long runs) go through the same recurrence one by one (``_Run``).

Normalisation (NFC, lower case), the cut into pre-tokens (contractions, runs of letters, single digits, runs of others) and
special strings follow the tokenizer file, and hold at every prefix: what a prefix of a special string, of "'re" or of a
letter and its accent would give is what is stored there.

Defined cases: a null text counts as empty (no prefixes, no tokens); white space alone has 0 tokens at every prefix; repeated
rows and null ids stay as they are; an empty table gives no rows; other columns of the input are left behind. A text of any
length is held whole, with four bytes for each code point.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Words, id_and_text, slices

#: Words that need care and token pairs that a task's process remembers at most; places of the table of pairs, a power of two.
WORDS, PAIRS, PLACES = 50_000, 500_000, 20

#: Pre-tokens of more bytes are computed one by one.
TOGETHER = 1000

#: Bytes of text that a task works on at once: the more, the fewer words are met again in the next slice.
SLICE = 6 << 20

# The contractions that the tokenizer's pattern names.
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}

_CONTRACTS = re.compile("|".join(sorted(CONTRACTIONS)))


def _byte_symbols() -> dict[int, str]:
    """Byte -> character that stands for it in a byte-level vocabulary: printable Latin-1 as it is, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class PrefixCounter:
    """Token counts of all prefixes of words, for a BPE tokenizer file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        self.suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not self.suffix or model["continuing_subword_prefix"] or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: prefix counts need a BPE vocabulary with word ends behind NFC and lower case")
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        if any(c.isspace() for t in self.specials for c in t) or any(t["normalized"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special strings must be free of white space and looked for in the text as it is")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {tuple(pair): k for k, pair in enumerate(pairs)}
        end = len(self.suffix)
        self.closing = {t[:-end]: t for t in model["vocab"] if t.endswith(self.suffix)}
        self.inner = {t for t in model["vocab"] if not t.endswith(self.suffix)}
        self.longest = max(max(map(len, self.inner)), max(map(len, self.closing)))
        self.never = len(self.rank)
        self.parts = {a + b: (a, b) for a, b in self.rank}
        if len(self.parts) != len(self.rank):
            raise ValueError(f"{path}: a token is made by more than one merge")
        self.symbols = _byte_symbols()
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.kinds: dict[str, str] = {}
        self.plain: dict[str, tuple[str, ...]] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.whole: dict[str, bool] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.known: dict[str, np.ndarray] = {}
        self.together = _Together(self, {t: k for t, k in model["vocab"].items()})

    # --- one vocabulary, pair by pair

    def _encoded(self, symbols: list[str]) -> list[str]:
        """Symbols merged pair by pair, best rank first, leftmost first."""
        while len(symbols) > 1:
            rank, at = min((self.rank.get(pair, self.never), k) for k, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == self.never:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at the left (0) or right (1) end of a token while it is merged: each piece and the rank that ends it."""
        if (edge := self.edges[side].get(token)) is None:
            edge, until, piece = [], self.never, token
            while True:
                edge.append((piece, until))
                if piece not in self.parts:
                    break
                pair = self.parts[piece]
                until, piece = self.rank[pair], pair[side]
            self.edges[side][token] = edge
        return edge

    def _merge_across(self, left: str, right: str) -> bool:
        """Whether some merge joins the end of one token to the beginning of the next, before both are complete.

        A merge of two pieces happens if its rank comes before those that would end either piece; between equal ranks
        the leftmost is first.
        """
        rank, starts = self.rank, self._edge(right, 0)
        for x, x_until in self._edge(left, 1):
            for y, y_until in starts:
                found = rank.get((x, y))
                if found is not None and found < x_until and found <= y_until:
                    return True
        return False

    def _sound(self, token: str) -> bool:
        """Whether the token is what its own symbols encode to."""
        if (known := self.whole.get(token)) is None:
            end = token[-1 - len(self.suffix) :] if token.endswith(self.suffix) else token[-1:]
            known = self.whole[token] = self._encoded([*token[: len(token) - len(end)], end]) == [token]
        return known

    def _stands(self, before: str, token: str) -> bool:
        """Whether ``before`` (empty: nothing) and ``token`` are just what their symbols encode to."""
        key = (before, token)
        if (known := self.apart.get(key)) is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            known = self.apart[key] = self._sound(token) and not (before and self._merge_across(before, token))
        return known

    def _last(self, text: str, begin: int, end: int, last: list[str]) -> int:
        """Where the last token of the encoding of ``text[begin:end]`` starts; ``last[k]`` is that of the open prefix up to k."""
        inner, apart = self.inner, self.apart
        for k in range(max(begin, end - self.longest), end):
            token = text[k:end]
            if token in inner:
                before = last[k] if k > begin else ""
                if (known := apart.get((before, token))) or (known is None and self._stands(before, token)):
                    return k
        raise ValueError(f"no token of the vocabulary ends {text[begin:end]!r}")

    def _last_closed(self, text: str, begin: int, end: int, last: list[str]) -> int:
        """The same if the word ends here."""
        closing, apart = self.closing, self.apart
        for k in range(max(begin, end - self.longest), end):
            if (token := closing.get(text[k:end])) is not None:
                before = last[k] if k > begin else ""
                if (known := apart.get((before, token))) or (known is None and self._stands(before, token)):
                    return k
        raise ValueError(f"no token of the vocabulary closes {text[begin:end]!r}")

    def _pre_token(self, chars: str) -> list[int]:
        """Counts of all prefixes of one pre-token."""
        if (found := self.pieces.get(chars)) is None:
            text, last, number, found = "", [""], [0], []
            for char in chars:
                for b in char.encode():
                    text += self.symbols[b]
                    end = len(text)
                    k = self._last(text, 0, end, last)
                    last.append(text[k:end])
                    number.append(number[k] + 1)
                found.append(1 + number[self._last_closed(text, 0, end, last)])
            if len(self.pieces) >= WORDS:
                self.pieces.clear()
            self.pieces[chars] = found
        return found

    # --- characters

    def _kind(self, char: str) -> str:
        """S white space, N digit (a pre-token alone), L letter, O other; as the tokenizer's own pattern has it."""
        if (kind := self.kinds.get(char)) is None:
            twice = len(self.split(char * 2))
            kind = self.kinds[char] = "S" if twice == 0 else "N" if twice == 2 else "L" if len(self.split("a" + char)) == 1 else "O"
        return kind

    def _normal_char(self, char: str) -> tuple[str, ...]:
        if (found := self.plain.get(char)) is None:
            found = self.plain[char] = tuple(self.normal(char))
        return found

    def _lowered(self, char: str) -> str:
        return "".join(self.plain.get(char) or self._normal_char(char))

    # --- words

    def counts(self, word: str) -> np.ndarray:
        """Tokens of each prefix of a word without ASCII white space, one count for each code point."""
        if (found := self.known.get(word)) is None:
            if len(self.known) >= WORDS:
                self.known.clear()
            found = self.known[word] = np.array(self._with_specials(word), np.int32)
        return found

    def _with_specials(self, word: str) -> list[int]:
        out: list[int] = []
        begin = 0
        while True:
            total = out[-1] if out else 0
            hits = [(at, -len(t), t) for t in self.specials if (at := word.find(t, begin)) >= 0]
            if not hits:
                return out + [total + n for n in self._plain_counts(word[begin:])]
            at, _, special = min(hits)
            # a special string that has not ended yet is ordinary text, one that has ended is one token
            until = at + len(special) - 1
            ordinary = self._plain_counts(word[begin:until])
            out += [total + n for n in ordinary]
            out.append(total + (ordinary[at - begin - 1] if at > begin else 0) + 1)
            begin = until + 1

    def _simple(self, words: list[str]) -> tuple[str, list[int]]:
        """The normalised words, one line each, and which of them need care (these lines are empty)."""
        joined = "\n".join([*words, ""])
        wide = [c for c in set(joined) if not c.isascii()]
        lowered = joined.lower()
        if all(self._lowered(c) == c.lower() and len(c.lower()) == 1 and c != "Σ" for c in wide) and unicodedata.is_normalized("NFC", joined):
            care = set()
        else:
            care = {k for k, w in enumerate(words) if not w.isascii() and (not unicodedata.is_normalized("NFC", w) or len("".join(map(self._lowered, w))) != len(w))}
            lowered = "\n".join(["" if k in care else w.lower() if w.isascii() else "".join(map(self._lowered, w)) for k, w in enumerate(words)] + [""])
        hits = [m.start() for m in _CONTRACTS.finditer(lowered)] if "'" in lowered else []
        if hits:
            breaks = np.flatnonzero(np.frombuffer(lowered.encode("utf-32-le"), np.uint32) == 10)
            care |= set(np.searchsorted(breaks, hits).tolist())
        for special in self.specials:
            if special in joined:
                care |= {k for k, w in enumerate(words) if special in w}
        if care:
            lines = lowered.split("\n")
            for k in care:
                lines[k] = ""
            lowered = "\n".join(lines)
        return lowered, sorted(care)

    def all_counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts of all prefixes of the words one after the other, in some order; where those of each word begin)."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        whole, care = self._simple(words)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind_of = np.zeros(int(points.max()) + 1, np.uint8)
        for c in np.flatnonzero(np.bincount(points)).tolist():
            kind_of[c] = ord("S") if c == 10 else ord(self._kind(chr(c)))
        kinds = kind_of[points]
        breaks = points == 10  # one behind each word
        starts = np.append(True, (kinds[1:] != kinds[:-1]) | (kinds[1:] == ord("N")) | breaks[1:] | breaks[:-1])
        begins = np.flatnonzero(starts)
        sizes = np.diff(np.append(begins, len(points)))
        blank = kinds[begins] == ord("S")
        pieces: dict[str, int] = {}
        number = np.array([pieces.setdefault(whole[i : i + n], len(pieces)) for i, n in zip(begins.tolist(), sizes.tolist(), strict=True)], np.int64)
        is_blank = np.zeros(len(pieces), bool)
        is_blank[number] = blank
        flat, offset = self.together.counts(list(pieces), is_blank, self._pre_token)
        total = flat[np.append(offset[1:], len(flat)) - 1][number]
        before = np.cumsum(total) - total
        first = np.append(0, np.flatnonzero(breaks)[:-1] + 1)
        piece_of = np.cumsum(starts) - 1
        shift = before - np.repeat(before[piece_of[first]], np.diff(np.append(piece_of[first], len(begins))))
        counts = shift[piece_of] + flat[(offset[number] - begins)[piece_of] + np.arange(len(points))]
        parts, size = [counts.astype(np.int32)], len(counts)
        for k in care:
            parts.append(self.counts(words[k]))
            first[k] = size
            size += len(parts[-1])
        return np.concatenate(parts), first

    def _plain_counts(self, text: str) -> list[int]:
        out: list[int] = []
        composed = text.isascii() or unicodedata.is_normalized("NFC", text)
        run = _Run(self)
        if composed:
            for char in text:
                run.extend(self._normal_char(char))
                out.append(run.count())
            return out
        cluster, base, now = "", 0, ()
        for char in text:
            own = self._normal_char(char)
            joined = tuple(self.normal(cluster + char))
            if cluster and unicodedata.combining(char) == 0 and joined == (*now, *own):
                cluster, base, now = char, run.size(), own  # nothing behind a starter that stays apart changes what is before it
                run.extend(own)
            else:
                same = next((k for k, (a, b) in enumerate(zip(now, joined, strict=False)) if a != b), min(len(now), len(joined)))
                run.cut(base + same)
                run.extend(joined[same:])
                cluster, now = cluster + char, joined
            out.append(run.count())
        return out


class _Run:
    """A normalised text that grows, or is cut back, at its end; the count of tokens is known at each character."""

    def __init__(self, of: PrefixCounter):
        self.of = of
        self.text = ""  # one character for each byte
        self.last: list[str] = [""]
        self.number: list[int] = [0]
        #: Per character: tokens before its pre-token, where that starts, its kind, the count here, length of text here.
        self.state: list[tuple[int, int, str, int, int]] = [(0, 0, "S", 0, 0)]

    def size(self) -> int:
        return len(self.state) - 1

    def count(self) -> int:
        return self.state[-1][3]

    def cut(self, size: int) -> None:
        if size < self.size():
            del self.state[size + 1 :]
            length = self.state[-1][4]
            self.text = self.text[:length]
            del self.last[length + 1 :], self.number[length + 1 :]

    def extend(self, chars: tuple[str, ...]) -> None:
        for char in chars:
            self._add(char)

    def _add(self, char: str) -> None:
        done, begin, kind, count, length = self.state[-1]
        now = self.of._kind(char)
        if now == "S":
            self.state.append((count, length, "S", count, length))
            return
        for back in (1, 2):  # does this character end a contraction that begins at a pre-token "'"?
            if len(self.state) > back and self._contracts(char, back):
                done, begin = self.state[-back][0], self.state[-back][1]
                symbols = self._grow(char)
                whole = self.text[begin:]
                self.last += [""] * symbols
                self.number += [0] * symbols
                self.state.append((done, begin, "C", done + self._alone(whole), len(self.text)))
                return
        if not (now == kind and now in "LO"):
            done, begin = count, length
        for _ in range(self._grow(char)):
            end = len(self.last)
            k = self.of._last(self.text, begin, end, self.last)
            self.last.append(self.text[k:end])
            self.number.append(1 + (self.number[k] if k > begin else 0))
        k = self.of._last_closed(self.text, begin, len(self.text), self.last)
        self.state.append((done, begin, now, done + 1 + (self.number[k] if k > begin else 0), len(self.text)))

    def _grow(self, char: str) -> int:
        symbols = [self.of.symbols[b] for b in char.encode()]
        self.text += "".join(symbols)
        return len(symbols)

    def _contracts(self, char: str, back: int) -> bool:
        _, begin, kind, _, length = self.state[-back]
        first = self.state[-back]
        if kind != "O" or length - begin != 1 or self.text[begin:length] != "'":
            return False
        if back == 2 and not (self.state[-1][2] == "L" and self.state[-1][1] == first[4]):
            return False
        return self.text[begin:] + char in CONTRACTIONS

    def _alone(self, text: str) -> int:
        return len(self.of._encoded([*text[:-1], text[-1] + self.of.suffix]))


class _Together:
    """The recurrence on many pre-tokens at once: tokens as paths of a trie over bytes, pairs of tokens looked up in tables."""

    def __init__(self, of: PrefixCounter, number: dict[str, int]):
        back = {c: b for b, c in of.symbols.items()}
        top = max(number.values()) + 1
        self._pairs(of, number, top)
        edges: dict[int, int] = {}
        ends: list[list[int]] = [[-1, -1]]
        for token, k in number.items():
            if not self.sound[k]:
                continue  # never the encoding of its own symbols
            closed = token.endswith(of.suffix)
            node = 0
            for char in token[: -len(of.suffix)] if closed else token:
                step = node * 256 + back[char]
                if step not in edges:
                    edges[step] = len(ends)
                    ends.append([-1, -1])
                node = edges[step]
            ends[node][closed] = k
        self.step = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.step.tolist()], np.int64)
        self.inner, self.closing = np.array(ends, np.int64).T.copy()
        self.longest = of.longest
        self.seen = np.full(1 << PLACES, 0xFFFFFFFF, np.uint32)
        self.apart = np.zeros(1 << PLACES, bool)

    def _pairs(self, of: PrefixCounter, number: dict[str, int], top: int) -> None:
        ranked = sorted(((number[a] << 16 | number[b], rank) for (a, b), rank in of.rank.items()))
        self.pair = np.array([k for k, _ in ranked], np.int64)
        self.rank = np.array([r for _, r in ranked], np.int64)
        self.never = of.never
        #: What stands at the right (left) end of each token while it is merged, and the ranks that end these pieces.
        self.edge = []
        for side in (1, 0):
            own = {k: of._edge(t, side) for t, k in number.items()}
            deep = max(map(len, own.values()))
            piece, until, depth = np.zeros((top, deep), np.int64), np.zeros((top, deep), np.int64), np.zeros(top, np.int64)
            for k, edge in own.items():
                depth[k] = len(edge)
                piece[k, : len(edge)] = [number[t] for t, _ in edge]
                until[k, : len(edge)] = [r for _, r in edge]
            self.edge.append((piece, until, depth))
        # a token is sound if its parts are and nothing merges across them before they merge with each other
        merged = sorted(of.parts.items(), key=lambda item: of.rank[item[1]])
        left, right = (np.array([number[pair[k]] for _, pair in merged], np.int64) for k in (0, 1))
        alone = ~self._across(left, right, np.array([of.rank[pair] for _, pair in merged], np.int64))
        self.sound = np.ones(top, bool)
        for (token, _), a, b, ok in zip(merged, left.tolist(), right.tolist(), alone.tolist(), strict=True):
            self.sound[number[token]] = ok and self.sound[a] and self.sound[b]

    def _across(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether some merge joins pieces of a and b before those end (or before rank ``until``)."""
        (right, right_until, right_depth), (left, left_until, left_depth) = self.edge
        joined = np.zeros(len(a), bool)
        for i in range(right.shape[1]):
            rows = np.flatnonzero(right_depth[a] > i)
            for j in range(left.shape[1]):
                rows = rows[left_depth[b[rows]] > j]
                if not len(rows):
                    break
                key = right[a[rows], i] << 16 | left[b[rows], j]
                at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
                rank = np.where(self.pair[at] == key, self.rank[at], self.never)
                first, last = right_until[a[rows], i], left_until[b[rows], j]
                if until is not None:
                    first, last = np.minimum(first, until[rows]), np.minimum(last, until[rows])
                joined[rows[(rank < first) & (rank <= last) & (rank < self.never)]] = True
        return joined

    def _stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b stay apart; a = -1: nothing stands before b."""
        key = (np.maximum(a, 0) << 16 | b).astype(np.uint32)
        place = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES)
        new = np.flatnonzero((self.seen[place] != key) & (a >= 0))
        out = self.apart[place]
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            ok = ~self._across((keys >> np.uint32(16)).astype(np.int64), (keys & np.uint32(0xFFFF)).astype(np.int64))
            out[new] = ok[back]
            self.seen[place[new]] = key[new]
            self.apart[place[new]] = out[new]
            # two new pairs at one place: the last one written holds it
            lost = new[self.seen[place[new]] != key[new]]
            self.seen[place[lost]] = 0xFFFFFFFF
        return out | (a < 0)

    def counts(self, pieces: list[str], blank: np.ndarray, one: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(counts of all prefixes of the pre-tokens, where those of each begin); ``one`` gives those of a very long one.

        ``blank`` marks white space, which has no tokens.
        """
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        chars = np.array([len(p) for p in pieces], np.int64)
        offset = np.cumsum(chars) - chars
        out = np.zeros(int(chars.sum()), np.int64)
        for k in np.flatnonzero((size > TOGETHER) & ~blank).tolist():
            out[offset[k] : offset[k] + chars[k]] = one(pieces[k])
        some = np.flatnonzero((size <= TOGETHER) & ~blank)
        text = np.frombuffer(b"".join(raw[k] for k in some.tolist()), np.uint8).astype(np.int64)
        if len(text):
            closed = self._closed_counts(text, size[some])
            last = np.append((text[1:] & 0xC0) != 0x80, True)  # last byte of a character
            where = np.repeat(offset[some] - (np.cumsum(chars[some]) - chars[some]), chars[some]) + np.arange(int(chars[some].sum()))
            out[where] = closed[last]
        return out, offset

    def _closed_counts(self, text: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each prefix, if the word ended with it, by bytes (of whole characters only)."""
        end = np.repeat(np.cumsum(size), size)
        begin = end - np.repeat(size, size)
        state = np.arange(len(text)) + np.repeat(np.arange(len(size)), size)  # one state more than bytes for each pre-token
        found: list[tuple[np.ndarray, ...]] = []
        closing: list[tuple[np.ndarray, ...]] = []
        at, node = np.arange(len(text)), np.zeros(len(text), np.int64)
        for length in range(1, self.longest + 1):
            step = node * 256 + text[at + length - 1]
            edge = np.minimum(np.searchsorted(self.step, step), len(self.step) - 1)
            hit = self.step[edge] == step
            at, node = at[hit], self.child[edge[hit]]
            for kept, tokens in ((found, self.inner), (closing, self.closing)):
                token = tokens[node]
                ends = np.flatnonzero(token >= 0)
                kept.append((at[ends], np.full(len(ends), length), token[ends]))
            more = at + length < end[at]
            at, node = at[more], node[more]
            if not len(at):
                break
        at, length, token = (np.concatenate(x) for x in zip(*found, strict=True))
        reach = (at - begin[at] + length).astype(np.uint16)
        order = np.argsort(reach, kind="stable")
        at, length, token, reach = at[order], length[order], token[order], reach[order]
        last, number = np.full(len(text) + len(size), -1, np.int64), np.zeros(len(text) + len(size), np.int64)
        cuts = np.searchsorted(reach, np.arange(1, int(size.max()) + 2))
        for low, high in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            source = state[at[low:high]]
            ok = np.flatnonzero(self._stand(last[source], token[low:high]) & ((last[source] >= 0) | (at[low:high] == begin[at[low:high]])))
            target = source[ok] + length[low:high][ok]
            last[target] = token[low:high][ok]
            number[target] = number[source[ok]] + 1
        at, length, token = (np.concatenate(x) for x in zip(*closing, strict=True))
        source = state[at]
        ok = self._stand(last[source], token) & ((last[source] >= 0) | (at == begin[at]))
        out = np.zeros(len(text), np.int64)
        out[at[ok] + length[ok] - 1] = number[source[ok]] + 1
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _of_slice(texts: pa.Array, count: PrefixCounter) -> pa.Array:
    """The counts of all prefixes of each text, as lists."""
    texts = pc.fill_null(texts, "")
    words = Words(texts)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(words.code):
        return pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(np.zeros(len(points), np.int32)))
    flat, offset = count.all_counts(words.distinct)
    last = offset + np.array([len(w) for w in words.distinct], np.int64) - 1
    total = np.where(last >= offset, flat[last], 0)[words.code].astype(np.int64)
    before = np.cumsum(total) - total
    # counts start again with each text
    held = words.start[:-1] < words.start[1:]
    base = np.zeros(len(held), np.int64)
    base[held] = before[words.start[:-1][held]]
    before -= base[words.doc]
    inside = (points != 32) & ((points < 9) | (points > 13))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = np.concatenate([[0], ends[:-1]])
    first = first[first < len(points)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    at = np.cumsum(begins, dtype=np.int32) - 1  # the word at or before each place
    # inside a word: the words before it and its own prefix; in white space: all words of the text so far
    shift = (offset[words.code] - starts)[np.maximum(at, 0)]
    shift += np.arange(len(points))
    out = before.astype(np.int32)[np.maximum(at, 0)]
    out[inside] += flat[shift[inside]]
    gaps = np.flatnonzero(~inside)
    word = at[gaps]
    doc = np.searchsorted(ends, gaps, side="right")
    same = (word >= 0) & (words.doc[np.maximum(word, 0)] == doc)
    out[gaps] = np.where(same, out[gaps] + total[np.maximum(word, 0)], 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out))


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and prefix_tokens: tokens of the first code point, of the first two, and so on, to the whole text.

    ``tokenizer`` is the path of the tokenizer file, the same on all executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in slices(batches, SLICE):
            texts = batch.column("text")
            sizes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, _of_slice(texts, count)], ["doc_id", "n_bytes", "prefix_tokens"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, prefix_tokens array<int>")


def tokens_of(prefixes: Column | str) -> Column:
    """Tokens of the whole text."""
    prefixes = F.col(prefixes) if isinstance(prefixes, str) else prefixes
    return F.coalesce(F.try_element_at(prefixes, F.lit(-1)), F.lit(0)).cast("long")


def tokens_at(prefixes: Column | str, chars: Column | int) -> Column:
    """Tokens of the text cut after ``chars`` code points (of the whole text where it is shorter)."""
    prefixes = F.col(prefixes) if isinstance(prefixes, str) else prefixes
    chars = F.lit(chars) if isinstance(chars, int) else chars
    return F.coalesce(F.get(prefixes, (F.least(chars, F.size(prefixes)) - 1).cast("int")), F.lit(0)).cast("long")


def cut_for(prefixes: Column | str, budget: Column | int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens. Counts may fall by a few where a word is completed, so the last fitting prefix is taken."""
    prefixes = F.col(prefixes) if isinstance(prefixes, str) else prefixes
    budget = F.lit(budget) if isinstance(budget, int) else budget
    return F.coalesce(F.array_max(F.transform(prefixes, lambda n, k: F.when(n <= budget, k + 1))), F.lit(0))


def truncated(docs: DataFrame, tokenizer: str, budget: int) -> DataFrame:
    """doc_id, the text cut to the longest prefix of at most ``budget`` tokens, and that prefix's tokens.

    The text travels beside its counts, so documents that share an id are not mixed up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in slices(batches, SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), _of_slice(batch.column("text"), count)], ["doc_id", "text", "prefix_tokens"])

    counted = id_and_text(docs).mapInArrow(run, "doc_id long, text string, prefix_tokens array<int>")
    cut = cut_for("prefix_tokens", budget)
    return counted.select("doc_id", F.substring(F.col("text"), F.lit(1), cut).alias("text"), tokens_at("prefix_tokens", cut).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens), answered from the stored prefixes."""
    counted = prefix_counts(docs, tokenizer).withColumn("n_tokens", tokens_of("prefix_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
