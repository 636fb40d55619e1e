"""BPE encoding and decoding by speculation and verification.

A merge-ordered BPE vocabulary has one valid encoding of a word, and a token sequence is that encoding
exactly if each of its tokens is what its own string encodes to and each adjacent pair is compatible,
that is, no merge across the pair's border would have run before the two tokens were complete. So each
new word of a batch gets a cheap proposal (greedy longest match), all adjacent pairs of all proposals
are tested at once with numpy, and only words with an incompatible pair are merged rank by rank.

The words of all texts of a batch are cut at once, by the kinds of their code points, and told apart by Arrow;
only different ones are looked up in a bounded cache or resolved. Nothing is shuffled; memory is bounded by a
batch and the cache.

Nulls count as empty texts and give an empty list; texts of any length are encoded whole; equal texts
give equal ids; an empty table gives an empty table; other columns pass through untouched.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm.common import text_of

#: Words kept by a Python worker in each of two halves (the older one goes when the newer is full), and the longest word (in bytes) that is kept.
CACHE_WORDS, CACHE_BYTES = 300_000, 64
#: Characters of text that are encoded at a time; longer texts are cut before white space.
CHUNK_CHARS = 2_000_000
NEVER = np.int64(2**62)
#: Words of at most so many bytes are merged side by side.
SHORT = 64
#: The pattern whose words are cut by kinds of code points; those of any other are found by the pattern itself.
CLASSES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, NUMBER, SYMBOL, LATER_CAPITAL = range(5)

#: First and last code points of letters and of numbers that Unicode has since version 17. The tokenizer's
#: pattern has the classes of version 16, in which these are neither; the pattern module here may have newer ones.
LATER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
LATER_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
#: Capitals that the tokenizer lower-cases and Python's Unicode 15.1 does not know: first, last, what the first becomes.
LATER_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
_LOWER_LATER = {c: low + c - first for first, last, low in LATER_CAPITALS for c in range(first, last + 1)}


def _ranges(*pairs: tuple[int, int]) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in pairs)


#: What needs the careful pattern: any of these in the basic plane, and everything above it.
_LATER = re.compile("[" + _ranges(*[(a, b) for a, b, *_ in (*LATER_LETTERS, *LATER_NUMBERS, *LATER_CAPITALS) if b < 0x10000]) + "]")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_ABOVE = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point in the tokenizer's Unicode tables."""
    points = "".join(map(chr, range(0x110000)))
    out = np.full(len(points), SYMBOL, dtype=np.uint8)
    for name, kind in ((r"\p{White_Space}+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(name, points):
            out[m.start() : m.end()] = kind
    for first, last in (*LATER_LETTERS, *LATER_NUMBERS):
        out[first : last + 1] = SYMBOL
    out[list(_LOWER_LATER)] = LATER_CAPITAL
    return out


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is
    printable Latin-1, else the next free code point from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, free = [""] * 256, 256
    for b in range(256):
        if b in plain:
            table[b] = chr(b)
        else:
            table[b], free = chr(free), free + 1
    return table


class WordBpe:
    """Encoder and decoder of a tokenizers JSON file: a BPE model with word ends, byte alphabet and one Split pattern.

    Texts with characters that the tokenizer's tables and those here may class differently go by a second form of
    the pattern, without the letters and numbers that only newer tables know.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("only plain BPE models are supported")
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or spec.get("decoder"):
            raise ValueError("only a Split pattern before the byte alphabet, and no decoder, is supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # \s in the file's pattern is Unicode's White_Space
        self.by_kinds = steps[0]["pattern"]["Regex"] == CLASSES
        pattern = steps[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern, regex.V0)
        letters, numbers = rf"[\p{{L}}--[{_ranges(*LATER_LETTERS)}]]", rf"[\p{{N}}--[{_ranges(*LATER_NUMBERS)}]]"
        self.careful = regex.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers), regex.V1)
        self.alphabet = byte_alphabet()
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.strings = [""] * size
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = text
        self.strings_array = np.array(self.strings, dtype=object)
        end = self.end
        #: Tokens by their characters, within a word and at its end (the same where words have no mark at the end)
        self.ended = {t.removesuffix(end): i for t, i in self.vocab.items() if t.endswith(end)}
        self.inner = {t: i for t, i in self.vocab.items() if not end or not t.endswith(end)}
        #: Lengths that tokens within words have, longest first, by their first three characters
        by_start: dict[str, set[int]] = {}
        for t in self.inner:
            if len(t) > 2:
                by_start.setdefault(t[:3], set()).add(len(t))
        self.short = (2, 1)
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in by_start.items()}
        self.size = size
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        self.pair_ranks: dict[int, int] = {}
        self.made: list[int] = []
        twice: set[int] = set()
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            i, j, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.made.append(made)
            if self.pair_ranks.setdefault(i * size + j, r) != r:
                continue
            if self.rank[made] >= 0:
                twice.add(made)
            self.rank[made], self.left[made], self.right[made] = r, i, j
        keys = np.fromiter(self.pair_ranks, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.fromiter(self.pair_ranks.values(), dtype=np.int64)[order]
        self.sound = self._sound(twice)
        #: Tokens of single bytes, within a word and at its end; -1 where there is none
        self.bytes_inner = np.array([self.inner.get(c, -1) for c in self.alphabet], dtype=np.int64)
        self.bytes_ended = np.array([self.ended.get(c, -1) for c in self.alphabet], dtype=np.int64)
        self.all_bytes = bool((self.bytes_inner >= 0).all() and (self.bytes_ended >= 0).all())
        self.made_array = np.array(self.made, dtype=np.int64)
        self.newer: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER where there is none."""
        if not len(self.keys):
            return np.full(len(left), NEVER)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, own: bool = False) -> np.ndarray:
        """For each adjacent pair of tokens: whether both come out of merging their joined strings.

        The two tokens' borders are undone from the last merge back. Between two undone merges the border
        stands as (l, r); a merge of the two breaks the pair if it runs before l is consumed by its parent
        (at one rank the left one runs first) and not after r is. own: the pair's own merge, with which the
        walk begins, does not count; so are the two halves of a token tested.
        """
        n = len(left)
        good = np.ones(n, dtype=bool)
        at, l, r = np.arange(n), left.astype(np.int64), right.astype(np.int64)
        until_l = np.full(n, NEVER)
        until_r = np.full(n, NEVER)
        first = own
        while len(at):
            if not first:
                m = self._pair_rank(l, r)
                broken = (m < until_l) & (m <= until_r) & (m != NEVER)
                good[at[broken]] = False
            else:
                broken = np.zeros(len(at), dtype=bool)
                own_rank = self._pair_rank(l, r)
                until_l, until_r = own_rank.copy(), own_rank.copy()
                first = False
            rank_l, rank_r = self.rank[l], self.rank[r]
            on = ~broken & ((rank_l >= 0) | (rank_r >= 0))
            at, l, r, until_l, until_r, rank_l, rank_r = (x[on] for x in (at, l, r, until_l, until_r, rank_l, rank_r))
            undo_r = rank_r >= rank_l  # of two equal merges the left one ran first
            until_r = np.where(undo_r, rank_r, until_r)
            until_l = np.where(undo_r, until_l, rank_l)
            r = np.where(undo_r, self.left[r], r)
            l = np.where(undo_r, l, self.right[l])
        return good

    def _sound(self, twice: set[int]) -> np.ndarray:
        """Which tokens are what their own strings encode to; made of lower merges only."""
        made = np.flatnonzero(self.rank >= 0)
        good = np.ones(self.size, dtype=bool)
        a, b = self.left[made], self.right[made]
        ok = (self.rank[a] < self.rank[made]) & (self.rank[b] < self.rank[made])
        ok[ok] &= self.compatible(a[ok], b[ok], own=True)
        good[made] = ok
        good[list(twice)] = False
        for t in made[np.argsort(self.rank[made])]:  # what is made of an unsound token is unsound
            if not (good[self.left[t]] and good[self.right[t]]):
                good[t] = False
        return good

    def propose(self, chars: str) -> list[int]:
        """Greedy longest match over the byte alphabet; only the last token has the word's end."""
        out, i, n, vocab, ended, lengths = [], 0, len(chars), self.inner, self.ended, self.lengths
        while i < n:
            t = ended.get(chars[i:])
            if t is not None:
                out.append(t)
                return out
            for size in lengths.get(chars[i : i + 3], self.short):
                t = vocab.get(chars[i : i + size])
                if t is not None and i + size < n:
                    out.append(t)
                    i += size
                    break
            else:
                return []
        return out

    def exact(self, words: list[bytes]) -> list[bytes]:
        """Merging rank by rank, leftmost first: for words whose proposal has an incompatible pair. Ids as bytes of 32-bit integers."""
        out = [b""] * len(words)
        short = []
        for k, w in enumerate(words):
            if self.all_bytes and len(w) <= SHORT:
                short.append(k)
            else:
                out[k] = array("i", self._exact_one(w)).tobytes()
        short.sort(key=lambda k: len(words[k]))
        for at in range(0, len(short), 8192):
            part = short[at : at + 8192]
            for k, ids in zip(part, self._exact_many([words[k] for k in part]), strict=True):
                out[k] = ids
        return out

    def _exact_many(self, words: list[bytes]) -> list[bytes]:
        """All words step by step together: a column has a word's tokens, and beside them their pairs' ranks and places in one number."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        rows, n = int(sizes.max()), len(words)
        text = np.frombuffer(b"".join([w.ljust(rows, b"\0") for w in words]), dtype=np.uint8).reshape(n, rows).T
        ids = self.bytes_inner[text]
        ids[sizes - 1, np.arange(n)] = self.bytes_ended[text[sizes - 1, np.arange(n)]]
        place = np.arange(rows)[:, None]
        none = np.int64(len(self.made) * SHORT)

        def ranked(left: np.ndarray, right: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
            """Rank and place of the pairs whose left token is at this place of words of this size."""
            rank = self._pair_rank(left, right)
            return np.where((rank != NEVER) & (at >= 0) & (at + 1 < size), rank * SHORT + at, 2 * none)

        low = ranked(ids[:-1].ravel(), ids[1:].ravel(), np.repeat(place[:-1, 0], n), np.tile(sizes, rows - 1)).reshape(rows - 1, n)
        done, left = np.zeros((n, rows), dtype=np.int32), sizes.copy()
        of = np.arange(n)
        while rows > 1:
            first = low.min(axis=0)
            on = first < none
            if not on.all():
                done[of[~on], : len(ids)] = ids.T[~on]
                left[of[~on]] = sizes[~on]
                if not on.any():
                    break
                most = sizes[on].max()
                of, ids, low, sizes, first = of[on], ids[:most, on], low[: most - 1, on], sizes[on], first[on]
            at, column = first % SHORT, np.arange(len(of))
            sizes -= 1
            ids[:-1] = np.where(place[: len(ids) - 1] > at, ids[1:], ids[:-1])
            ids[at, column] = self.made_array[first // SHORT]
            low[:-1] = np.where(place[: len(low) - 1] >= at, low[1:] - 1, low[:-1])
            low[-1] = 2 * none
            for a in (at - 1, at):
                inside = (a >= 0) & (a + 1 < sizes)
                x, c = a[inside], column[inside]
                low[x, c] = ranked(ids[x, c], ids[x + 1, c], x, sizes[inside])
        if rows == 1:
            done[:] = ids.T
        raw = done.tobytes()
        return [raw[4 * rows * k : 4 * (rows * k + m)] for k, m in enumerate(left.tolist())]

    def _exact_one(self, word: bytes) -> list[int]:
        """The same for one word with a heap, for n log n steps; bytes without a token are left out."""
        chars = [self.alphabet[b] for b in word]
        ids = [t for i, c in enumerate(chars, 1) if (t := (self.ended if i == len(chars) else self.inner).get(c)) is not None]
        size, ranks, n = self.size, self.pair_ranks, len(ids)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := ranks.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.made[low], False, after[j]
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := ranks.get(ids[x] * size + ids[y])) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
            if after[i] < n:
                before[after[i]] = i
        return [t for t, on in zip(ids, alive, strict=True) if on]

    def resolve(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of these distinct words, as bytes of 32-bit integers."""
        table = self.alphabet
        proposed = []
        for w in words:
            c = w.decode("latin-1")
            proposed.append(self.propose(c if c.isascii() and c.isprintable() else "".join([table[b] for b in w])))
        sizes = np.fromiter(map(len, proposed), dtype=np.int64, count=len(words))
        flat = np.fromiter(chain.from_iterable(proposed), dtype=np.int64, count=int(sizes.sum()))
        of = np.repeat(np.arange(len(words)), sizes)
        failed = sizes == 0
        failed[of[~self.sound[flat]]] = True
        inner = np.flatnonzero(of[1:] == of[:-1]) if len(flat) else np.array([], dtype=np.int64)
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        failed[of[inner[~good[back]]]] = True
        raw, ends = flat.astype(np.int32).tobytes(), (4 * np.cumsum(sizes)).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905
        again = np.flatnonzero(failed).tolist()
        for k, ids in zip(again, self.exact([words[k] for k in again]), strict=True):
            out[k] = ids
        return out

    def known(self, words: list[bytes]) -> list[bytes]:
        """The same from the cache, as far as it goes."""
        out = list(map(self.newer.get, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        for k in missing:
            out[k] = self.older.get(words[k])
        new = [k for k in missing if out[k] is None]
        for k, ids in zip(new, self.resolve([words[k] for k in new]), strict=True):
            out[k] = ids
        if len(self.newer) + len(missing) > CACHE_WORDS:
            self.newer, self.older = {}, self.newer
        self.newer.update((words[k], out[k]) for k in missing if len(words[k]) <= CACHE_BYTES)
        return out

    def parts(self, text: str) -> list[str | int]:
        """A text, cut at the special tokens that stand in it, these by their ids; no part is much longer than a chunk if white space allows."""
        found = self.by_special is not None and "<" in text
        cut = [self.special.get(p, p) for p in self.by_special.split(text)] if found else [text]
        return cut if len(text) <= CHUNK_CHARS else [x for p in cut for x in ([p] if isinstance(p, int) else _stretches(p))]

    @staticmethod
    def normal(text: str) -> str:
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of these texts, one text after the other, as UTF-8, and how many each has."""
        if not self.by_kinds:
            words = [self._words(t) for t in texts]
            return pa.array([w.encode("utf-8", "surrogatepass") for w in chain.from_iterable(words)], pa.large_binary()), np.array([len(w) for w in words], dtype=np.int64)
        low = [self.normal(t) for t in texts]
        joined = " ".join([*low, "  "])
        ends = np.cumsum(np.fromiter(map(len, low), dtype=np.int64, count=len(low)) + 1)
        plain = joined.isascii()
        if plain:
            raw = codes = np.frombuffer(joined.encode(), dtype=np.uint8)
            kind = kinds()[:128][codes]
        else:
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            kind = kinds()[codes]
            if (kind == LATER_CAPITAL).any():
                joined = joined.translate(_LOWER_LATER)
                codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                kind = kinds()[codes]
            raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        starts = kind == NUMBER
        starts[0] = True
        starts[1:] |= kind[1:] != kind[:-1]
        # an apostrophe that begins a run takes the letters of its contraction with it
        quotes = np.flatnonzero(codes == ord("'"))
        quotes = quotes[starts[quotes]]
        a, b = codes[quotes + 1], codes[quotes + 2]
        one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        starts[quotes[one | two] + 1] = False
        starts[quotes[one] + 2] = True
        starts[quotes[two] + 3] = True
        keep = kind != SPACE
        first = np.flatnonzero(starts & keep)
        held = keep.view(np.uint8)  # bytes that go to a word
        if not plain:
            size = 1 + (codes > 0x7F).astype(np.uint8) + (codes > 0x7FF) + (codes > 0xFFFF)
            held, keep = held * size, np.repeat(keep, size)
        offsets = np.cumsum(np.append(0, np.add.reduceat(held, first, dtype=np.int64) if len(first) else []), dtype=np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[keep])])
        return words, np.diff(np.searchsorted(first, ends), prepend=0)

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.words.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma
        if _LATER.search(text) or _ABOVE.search(text):
            return self.careful.findall(text.translate(_LOWER_LATER))
        return self.words.findall(text)

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, one text after the other, and how many each has."""
        words, n = self.split(texts)
        coded = words.dictionary_encode()
        _, offsets, data = coded.dictionary.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[: len(coded.dictionary) + 1].tolist() if len(words) else []
        raw = data.to_pybytes() if len(words) else b""
        known, index = self.known([raw[a:b] for a, b in zip(at, at[1:])]), coded.indices.to_numpy()  # noqa: B905
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        begin, size = (np.cumsum(sizes) - sizes)[index], sizes[index]
        ends = np.cumsum(size)
        ids = np.frombuffer(b"".join(known), dtype=np.int32)[np.repeat(begin - ends + size, size) + np.arange(size.sum())]
        return ids, np.diff(np.append(0, ends)[np.cumsum(n)], prepend=0)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these texts, one text after the other, and how many each has."""
        cut = [self.parts(t) for t in texts]
        done = [self._encode_plain(chunk) for chunk in _chunks([p for parts in cut for p in parts if isinstance(p, str)])]
        if not done:
            return np.array([], dtype=np.int32), np.array([], dtype=np.int64)
        ids, n = (np.concatenate(x) for x in zip(*done, strict=True))
        if all(len(parts) == 1 for parts in cut):
            return ids, n
        until = np.append(0, np.cumsum(n))
        at, places, special, counts = 0, [], [], []
        for parts in cut:
            began, held = at, len(special)
            for p in parts:
                if isinstance(p, str):
                    at += 1
                else:
                    places.append(until[at])
                    special.append(p)
            counts.append(until[at] - until[began] + len(special) - held)
        return np.insert(ids, places, special), np.array(counts, dtype=np.int64)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        ids, sizes = self.encode_all(texts)
        return [ids[end - n : end] for n, end in zip(sizes, np.cumsum(sizes), strict=True)]

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """A file without a decoder joins its tokens with spaces; unknown ids are left out."""
        inside = (ids >= 0) & (ids < self.size)
        strings = self.strings_array[np.where(inside, ids, 0)]
        known = inside.all()
        out = []
        for a, b in zip(offsets, offsets[1:]):  # noqa: B905
            part = strings[a:b] if known else strings[a:b][inside[a:b]]
            out.append(" ".join(part.tolist()))
        return out


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _stretches(text: str):
    """Stretches of a long text, all but the first begun by white space: neither words nor composed characters reach across."""
    at = 0
    while len(text) - at > CHUNK_CHARS and (m := _BLANK.search(text, at + CHUNK_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def _chunks(texts: list[str]):
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK_CHARS:
            yield texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def encode(text: str | Column, path: str | None = None) -> Column:
    """Token ids (array<int>) of a text column."""
    path = path or default_path()

    def ids(column: pa.Array) -> pa.Array:
        flat, n = loaded(path).encode_all(column.to_pylist())
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), type=pa.int32()), pa.array(flat, type=pa.int32()))

    return F.arrow_udf(ids, "array<int>")(text_of(text))


def decode(ids: str | Column, path: str | None = None) -> Column:
    """The text of a column of token ids; null gives the empty text."""
    path = path or default_path()

    def texts(column: pa.Array) -> pa.Array:
        bpe, out = loaded(path), []
        if column.null_count:
            column = pa.array([x or [] for x in column.to_pylist()], type=column.type)
        for at in range(0, len(column), 256):
            part = column.slice(at, 256)
            flat = part.flatten().to_numpy(zero_copy_only=False)
            offsets = part.offsets.to_numpy()
            out.append(pa.array(bpe.decode_batch(flat, offsets - offsets[0]), type=pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], type=pa.string())

    return F.arrow_udf(texts, "string")(F.col(ids) if isinstance(ids, str) else ids)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded of every document: its tokens and what they decode to."""
    return docs.select("doc_id", encode("text", path).alias("ids")).select("doc_id", "ids", decode("ids", path).alias("decoded"))


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return digests(out)


def digests(out: DataFrame) -> DataFrame:
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
