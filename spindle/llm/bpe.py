"""Byte-pair tables read from a tokenizer's JSON file, and the prefix programme over them."""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import re
import struct
import unicodedata

import regex

#: White space as the tokenizer's pattern engine has it (fixed values).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Split patterns of the two families of tokenizers (fixed values, see their JSON).
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"

#: Entries kept of any cache; beyond it the cache starts anew, so memory is bounded.
CACHE = 600_000


@functools.cache
def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, itertools.count(256)
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(next(spare))
    return out


class PrefixCounter:
    """Exact token counts of every prefix of a text, for a byte-level BPE without added normalisation.

    Let last(i) be the token that ends the encoding of the first i bytes of a piece. A BPE encoding is
    valid exactly if each neighbouring pair of its tokens encodes to itself, so last(i) is the one token t
    that matches the bytes before i and is compatible with last(i - len(t)); then count(i) =
    count(i - len(t)) + 1. One pass gives all prefixes of a piece. Pieces are split as the tokenizer splits
    them; a text's table is the running sum over its pieces plus the table of the piece that a cut falls in.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        as_bytes = lambda s: bytes(back[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items() if all(c in back for c in s)}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        #: rank of the merge of a pair, and by token the rank that made it and its two parts
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            left, right = as_bytes(a), as_bytes(b)
            pair = self.ids[left], self.ids[right]
            self.rank[pair] = r
            self.made.setdefault(self.ids[left + right], (r, *pair))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.find = regex.compile(BYTE_PATTERN).findall
        self.space = regex.compile(rf"[{_SPACE}]+$")
        self.odd = re.compile(r"\s[\s]|^\s|\s\Z").search
        self.total: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether a then b is how BPE encodes their joined bytes.

        Undo merges from the latest back, always on the side made later: before each undone merge, the pair
        that touches at the seam must not be one that BPE would have merged earlier.
        """
        known = self.fits.get((a, b))
        if known is not None:
            return known
        if len(self.fits) > 4 * CACHE:
            self.fits.clear()
        x, y, before = a, b, (len(self.rank), 0)
        while True:
            r = self.rank.get((x, y))
            # at equal rank the leftmost pair merges first: one made on the left side wins over the seam
            if r is not None and (r, 1) < before:
                answer = False
                break
            left, right = self.made.get(x), self.made.get(y)
            if left is None and right is None:
                answer = True
                break
            if right is None or (left is not None and left[0] > right[0]):
                before, x = (left[0], 0), left[2]
            else:
                before, y = (right[0], 2), right[1]
        self.fits[a, b] = answer
        return answer

    def piece(self, data: bytes) -> list[int]:
        """Token counts of the first 0, 1, ... len(data) bytes of one piece."""
        n, ids = len(data), self.ids
        count, last = [0] * (n + 1), [-1] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                t = ids.get(data[j:i])
                if t is not None and (j == 0 or self.compatible(last[j], t)):
                    count[i], last[i] = count[j] + 1, t
                    break
        return count

    def size(self, piece: str) -> int:
        n = self.total.get(piece)
        if n is None:
            if len(self.total) >= CACHE:
                self.total.clear()
            data = piece.encode()
            n = self.total[piece] = 1 if data in self.ids else self._last(data, len(data), {0: (-1, 0)})[1] if len(data) <= 200 else self.piece(data)[-1]
        return n

    def _last(self, data: bytes, i: int, known: dict[int, tuple[int, int]]) -> tuple[int, int]:
        """(last(i), count(i)) by the same programme, evaluated only at the prefixes that the answer rests on."""
        ids, fits = self.ids, self.fits
        for j in range(i - self.longest if i > self.longest else 0, i):
            t = ids.get(data[j:i])
            if t is not None:
                before = known.get(j) or self._last(data, j, known)
                if j == 0 or (ok if (ok := fits.get((before[0], t))) is not None else self.compatible(before[0], t)):
                    known[i] = found = (t, before[1] + 1)
                    return found
        raise AssertionError("every byte is a token")

    def _pieces(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.special):
            return self.find(text)
        return [p for i, part in enumerate(self.split.split(text)) for p in ([part] if i % 2 else self.find(part))]

    def _spaced(self, part: str) -> int:
        """Token count of a blank-led part of a text, summed over its pieces."""
        if len(self.parts) >= CACHE:
            self.parts.clear()
        n = self.parts[part] = self.size(" " + part) if part.isalpha() else sum(map(self.size, self.find(" " + part)))
        return n

    def table(self, text: str) -> list[int]:
        """The token count up to the end of each unit of the text: the stored prefix table.

        Where single blanks alone separate the parts of a text, no piece crosses a blank but for one that
        starts with it, so units are the blank-led parts and a cache knows most of them. In any other
        text, units are pieces.
        """
        if text and self.odd(text) is None and not any(s in text for s in self.special):
            first, *rest = text.split(" ")
            sizes = [sum(map(self.size, self.find(first))), *map(self.parts.get, rest)]
            if None in sizes:
                sizes = [sizes[0], *(self._spaced(p) if n is None else n for p, n in zip(rest, sizes[1:]))]
            return list(itertools.accumulate(sizes))
        return list(itertools.accumulate([1 if p in self.special else self.size(p) for p in self._pieces(text)]))

    def count(self, text: str) -> int:
        return (self.table(text) or [0])[-1]

    def within(self, text: str, sums: list[int], limit: int) -> int:
        """Most leading characters, cut between pieces or within one, whose own encoding has at most ``limit`` tokens.

        ``sums``: the text's table. Only the unit that the limit falls in is looked at again.
        """
        if not sums or sums[-1] <= limit:
            return len(text)
        units = self.table_units(text)
        k = bisect.bisect_right(sums, limit)
        # a cut changes at most the pieces next to it: the unit before the limit and the two after it are looked at again
        low = max(0, k - 1)
        done, head = sum(map(len, units[:low])), sums[low - 1] if low else 0
        near = self.prefixes("".join(units[low : k + 3]))
        return done + max(c for c, n in enumerate(near) if head + n <= limit)

    def table_units(self, text: str) -> list[str]:
        if self.odd(text) is None and not any(s in text for s in self.special):
            first, *rest = text.split(" ")
            return [first, *(" " + p for p in rest)]
        return self._pieces(text)

    def prefixes(self, text: str) -> list[int]:
        """Token counts of text[:0], text[:1], ... text[:len(text)], each as if encoded by itself."""
        out, done = [0], 0
        pieces = self._pieces(text)
        for k, p in enumerate(pieces):
            if p in self.special:
                # a cut special string is ordinary text joined to what stands before it
                tail = "".join(pieces[max(0, k - 1) : k]) if k and pieces[k - 1] not in self.special else ""
                base = done - (self.count(tail) if tail else 0)
                out += [base + self.count(tail + p[:c]) for c in range(1, len(p))]
                done += 1
                out.append(done)
                continue
            data = p.encode()
            counts, at = self.piece(data), 0
            # a piece of white space right before another piece can join the one before once the text ends in it
            before = pieces[k - 1] if k and pieces[k - 1] not in self.special and self.space.fullmatch(pieces[k - 1]) else ""
            for c, ch in enumerate(p, 1):
                at += len(ch.encode())
                head = p[:c]
                if before and self.space.fullmatch(head):
                    out.append(done - self.size(before) + self.count(before + head))
                elif c < len(p) and len(self.find(head)) > 1:
                    out.append(done + self.count(head))
                else:
                    out.append(done + counts[at])
            done += counts[-1]
        return out


class WordEncoder:
    """Ids of the lower-casing word BPE, by a cache of words; unseen words go through the tokenizer's own model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = Tokenizer.from_file(path).model
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.find = regex.compile(WORD_PATTERN).findall
        self.control = re.compile("[\x1c-\x1f]").search  # str.split() takes these for white space
        self.letters = dict(enumerate(byte_letters()))
        self.cache: dict[str, bytes] = {}

    def _new(self, word: str) -> bytes:
        if len(self.cache) >= CACHE // 3:
            self.cache.clear()
        pieces = [word] if word.isalpha() else self.find(word)
        if not (word.isascii() and word.isprintable()):
            pieces = [p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        ids = [t.id for p in pieces for t in self.model.tokenize(p)]
        out = self.cache[word] = struct.pack(f"<{len(ids)}H", *ids)
        return out

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: each letter by itself
        text = text.lower()
        # no match holds white space, so blank-separated parts can be looked up whole
        found = self.find(text) if self.control(text) else text.split()
        get = self.cache.get
        return b"".join([x if x is not None else self._new(w) for w, x in zip(found, map(get, found))])

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian 16-bit integers."""
        if "<|" not in text:
            return self._plain(text)
        return b"".join(self.special[p].to_bytes(2, "little") if i % 2 else self._plain(p) for i, p in enumerate(self.split.split(text)))


@functools.lru_cache(maxsize=4)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
