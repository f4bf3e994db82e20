"""Exact byte-pair encoding by speculation: propose, verify, and merge only what fails.

1. A trie walk over all new words at once proposes each word's greedy longest-match tokens.
2. A sequence of tokens is the encoding exactly if each token encodes to itself and each adjacent
   pair survives together: undoing the merges of two neighbours from the latest to the earliest
   must never show a merge across their border that would have come first. All distinct pairs
   of a batch are tested together, in lockstep.
3. Words with a failing token or pair are merged exactly, lowest rank first and leftmost on ties.

The ids equal those of the tokenizers library (tests compare them).
"""

from __future__ import annotations

import heapq
import json
import os
from array import array

import numpy as np
import regex

from rasterlake.llm.chunks import ChunkEncoder, before_space, by_space
from rasterlake.llm.work import runs

LONG = 256  # symbols; longer words are proposed one by one, and merged with a heap where they fail
MERGED_AT_ONCE = 1 << 20  # symbols of failing words
NONE = np.int64(1) << 40
#: Pre-tokenizer patterns of the two supported kinds (fixed values of the public vocabularies).
PATTERN_SUFFIX = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PATTERN_MARKED = regex.compile(PATTERN_SUFFIX.pattern + "| ")
PATTERN_SPACE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose classes every Unicode version agrees on; others go to the library's own pre-tokenizer.
PLAIN = regex.compile("[\n\r\t \x21-\x7e\xa1-ɏ]*")
PLAIN_CHUNK = regex.compile("[\x21-\x7e\xa1-ɏ]+")
_BLANK = ("", " ", "\n", "\r", "\t")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Lookup:
    """A fixed map from non-negative 64-bit keys to values, for arrays of keys; -1 where absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            at = left[free]
            _, first = np.unique(slot[at], return_index=True)
            at = at[first]
            self.keys[slot[at]], self.values[slot[at]] = keys[at], values[at]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], -1)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out


class Index(dict):
    """Numbers for keys as they come; 0 is the mark between chunks where there is one."""

    def __init__(self, marked: bool) -> None:
        super().__init__({" " if marked else None: 0})

    def __missing__(self, key: str | int) -> int:
        self[key] = k = len(self)
        return k


class SpeculativeBPE:
    """A byte-level BPE vocabulary file of the tokenizers library, with or without an end-of-word suffix."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.vocab: dict[str, int] = model["vocab"]
        self.n = max(max(self.vocab.values()), *self.special.values()) + 1
        self.names = [""] * self.n
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = t
        chars = byte_chars()
        self.base = np.array([self.vocab[c] for c in chars] + ([self.vocab[c + self.suffix] for c in chars] if self.suffix else []), np.int64)
        self.rank, self.left, self.right = (np.full(self.n, -1, np.int64) for _ in range(3))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        drop = len(self.suffix)
        for r, (a, b) in enumerate(pairs):
            i = self.vocab[a + b]
            if self.rank[i] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            self.rank[i], self.left[i], self.right[i] = r, self.vocab[a], self.vocab[b]
        made = np.flatnonzero(self.rank >= 0)
        self._rank = self.rank.tolist()
        self.merged = Lookup(self.left[made] * 65536 + self.right[made], made)
        self.by_pair = dict(zip((self.left[made] * 65536 + self.right[made]).tolist(), made.tolist(), strict=True))
        byte = {c: b for b, c in enumerate(chars)}
        steps: dict[int, int] = {}
        accept = [-1]
        special = set(self.special.values())
        for t, i in self.vocab.items():
            ended = bool(drop) and t.endswith(self.suffix)
            symbols = [byte[c] for c in (t[:-drop] if ended else t) if c in byte]
            if not symbols or i in special:
                continue
            if ended:
                symbols[-1] += 256
            node = 0
            for x in symbols:
                new = steps.setdefault(node * 512 + x, len(accept))
                if new == len(accept):
                    accept.append(-1)
                node = new
            accept[node] = i
        self.steps = steps
        self.trie = Lookup(np.fromiter(steps.keys(), np.int64, len(steps)), np.fromiter(steps.values(), np.int64, len(steps)))
        self.accept, self._accept = np.array(accept, np.int64), accept
        self.sound = np.ones(self.n, bool)
        whole = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i, ok in sorted(zip(made.tolist(), whole.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
            self.sound[i] = ok and self.sound[self.left[i]] and self.sound[self.right[i]]

    # -- verification ------------------------------------------------------------------------
    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the border of each pair of tokens stays while both are merged up (and until rank limit)."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NONE) if limit is None else limit.copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            joined = self.merged(x * 65536 + y)
            broken = (joined >= 0) & (self.rank[joined] < limit[live])
            good[live[broken]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~broken & ((rx >= 0) | (ry >= 0))
            first = rx > ry
            # undo the later merge; on the left side a merge across the border comes later at equal rank
            limit[live] = np.where(first, rx, ry + 1)
            a[live] = np.where(first & (rx >= 0), self.right[x], x)
            b[live] = np.where(~first & (ry >= 0), self.left[y], y)
            live = live[go]
        return good

    # -- speculation -------------------------------------------------------------------------
    def propose(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of the words symbols[start:end], and each word's number of tokens."""
        word = np.arange(len(start))
        at, pos, stop = start.copy(), start.copy(), end
        node = np.zeros(len(start), np.int64)
        best, after = np.full(len(start), -1, np.int64), start.copy()
        padded = np.append(symbols, 0)
        out_word, out_token = [], []
        while len(word):
            inside = pos < stop
            step = np.where(inside, self.trie(node * 512 + padded[np.minimum(pos, len(symbols))]), -1)
            on = step >= 0
            token = np.where(on, self.accept[step], -1)
            pos = pos + on
            took = token >= 0
            best, after = np.where(took, token, best), np.where(took, pos, after)
            node = np.where(on, step, 0)
            off = ~on
            out_word.append(word[off])
            out_token.append(best[off])
            at = np.where(off, after, at)
            pos = np.where(off, after, pos)
            best = np.where(off, -1, best)
            keep = ~off | (at < stop)
            if not keep.all():
                word, at, pos, stop, node, best, after = (v[keep] for v in (word, at, pos, stop, node, best, after))
        words = np.concatenate([*out_word, np.empty(0, np.int64)])
        order = np.argsort(words, kind="stable")
        return np.concatenate([*out_token, np.empty(0, np.int64)])[order], np.bincount(words, minlength=len(start))

    def propose_long(self, symbols: np.ndarray) -> np.ndarray:
        """Greedy longest-match tokens of one long word (-1 where nothing matches): the same walk without
        a vector step a symbol, whose fixed cost only many words at once pay for."""
        word, steps, accept = symbols.tolist(), self.steps, self._accept
        out = array("q")
        at, n = 0, len(word)
        while at < n:
            node, best, after, pos = 0, -1, at, at
            while pos < n:
                node = steps.get(node * 512 + word[pos], -1)
                if node < 0:
                    break
                pos += 1
                if accept[node] >= 0:
                    best, after = accept[node], pos
            out.append(best)
            at = after if best >= 0 else n
        return np.frombuffer(out, np.int64)

    def propose_all(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """propose() for words of any length."""
        lengthy = np.flatnonzero(end - start > LONG)
        if not len(lengthy):
            return self.propose(symbols, start, end)
        short = np.flatnonzero(end - start <= LONG)
        tokens, counts = self.propose(symbols, start[short], end[short])
        parts = [self.propose_long(symbols[start[k] : end[k]]) for k in lengthy.tolist()]
        all_counts = np.zeros(len(start), np.int64)
        all_counts[short] = counts
        all_counts[lengthy] = list(map(len, parts))
        first = np.cumsum(all_counts) - all_counts
        out = np.empty(int(all_counts.sum()), np.int64)
        out[runs(counts, first[short])] = tokens
        for k, part in zip(lengthy.tolist(), parts, strict=True):
            out[first[k] : first[k] + len(part)] = part
        return out, all_counts

    # -- exact merging -----------------------------------------------------------------------
    def merge_all(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words at once: each pass makes each word's next merge. A pair's rank and place
        share a long, so there may be no more than 2^22 symbols; callers pass about MERGED_AT_ONCE."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        word = np.repeat(np.arange(len(counts)), counts)
        while len(word):
            pair = np.full(len(word), NONE)
            same = np.flatnonzero(word[1:] == word[:-1])
            joined = self.merged(tokens[same] * 65536 + tokens[same + 1])
            pair[same] = np.where(joined >= 0, self.rank[joined], NONE)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(pair * len(word) + np.arange(len(word)), first)
            ends = low >= NONE * len(word)
            over = np.repeat(ends, np.diff(np.append(first, len(word))))
            done.append((word[over], tokens[over]))
            at = (low % len(word))[~ends]
            tokens = tokens.copy()
            tokens[at] = self.merged(tokens[at] * 65536 + tokens[at + 1])
            over[at + 1] = True
            word, tokens = word[~over], tokens[~over]
        words = np.concatenate([d[0] for d in done])
        order = np.argsort(words, kind="stable")
        return np.concatenate([d[1] for d in done])[order], np.bincount(words, minlength=len(counts))

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Exact merging of one word, lowest rank first and leftmost on ties. The candidates known at the
        start are one sorted array and later ones a heap of numbers, so a word takes about 60 bytes a symbol."""
        n = len(symbols)
        pair = self.merged(symbols[:-1] * 65536 + symbols[1:])
        at = np.flatnonzero(pair >= 0)
        known = np.sort((self.rank[pair[at]] << 40) | at)
        tokens, before, behind = array("i", symbols.astype(np.int32).tobytes()), array("i", range(-1, n - 1)), array("i", [*range(1, n), -1])
        rank, by_pair = self._rank, self.by_pair
        heap: list[int] = []

        def offer(i: int) -> None:
            j = behind[i]
            if j >= 0 and (m := by_pair.get(tokens[i] * 65536 + tokens[j])) is not None:
                heapq.heappush(heap, rank[m] << 40 | i)

        for at in range(0, len(known) + 1, 1 << 16):
            part = known[at : at + (1 << 16)].tolist()
            last = at + (1 << 16) > len(known)
            k = 0
            while k < len(part) or (last and heap):
                if heap and (k == len(part) or heap[0] < part[k]):
                    entry = heapq.heappop(heap)
                else:
                    entry, k = part[k], k + 1
                i = entry & (1 << 40) - 1
                j = behind[i]
                if tokens[i] < 0 or j < 0:
                    continue
                m = by_pair.get(tokens[i] * 65536 + tokens[j])
                if m is None or rank[m] != entry >> 40:  # an older candidate; the pair's own one is in the heap
                    continue
                tokens[i], tokens[j] = m, -1
                behind[i] = behind[j]
                if behind[j] >= 0:
                    before[behind[j]] = i
                offer(i)
                if before[i] >= 0:
                    offer(before[i])
        out = np.frombuffer(tokens, np.int32)
        return out[out >= 0].astype(np.int64)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty words (as bytes) and ids per word."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        start = end - size
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if self.suffix:
            symbols[end - 1] += 256
        tokens, counts = self.propose_all(symbols, start, end)
        first = np.cumsum(counts) - counts
        word = np.repeat(np.arange(len(words)), counts)
        bad = np.zeros(len(words), bool)
        bad[word[(tokens < 0) | ~self.sound[tokens]]] = True
        near = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(tokens[near] * 65536 + tokens[near + 1], return_inverse=True)
        bad[word[near[~self.compatible(pairs >> 16, pairs & 65535)[which]]]] = True
        if not bad.any():
            return tokens, counts
        short, lengthy = np.flatnonzero(bad & (size <= LONG)), np.flatnonzero(bad & (size > LONG))
        out_count = counts.copy()
        fixed: list[tuple[np.ndarray, np.ndarray]] = []
        piece = np.cumsum(size[short]) // MERGED_AT_ONCE
        for some in np.split(short, np.flatnonzero(np.diff(piece)) + 1) if len(short) else ():
            ids, n = self.merge_all(self.base[symbols[runs(size[some], start[some])]], size[some])
            out_count[some] = n
            fixed.append((some, ids))
        for k in lengthy.tolist():
            ids = self.merge_long(self.base[symbols[start[k] : end[k]]])
            out_count[k] = len(ids)
            fixed.append((np.array([k]), ids))
        out_start = np.cumsum(out_count) - out_count
        out = np.empty(int(out_count.sum()), np.int64)
        good = np.flatnonzero(~bad)
        out[runs(counts[good], out_start[good])] = tokens[runs(counts[good], first[good])]
        for k, ids in fixed:
            out[runs(out_count[k], out_start[k])] = ids
        return out, out_count

    # -- texts -------------------------------------------------------------------------------
    def words_of(self, chunk: str) -> list[str | int]:
        """Pre-tokens of a chunk as text; special tokens as their ids."""
        if self.cut_special and (parts := self.cut_special.split(chunk))[1:]:
            out: list[str | int] = []
            for k, part in enumerate(parts):  # every second part is a special token
                if k % 2:
                    out.append(self.special[part])
                elif part:
                    out += self._plain_words(part)
            return out
        return self._plain_words(chunk)

    def _plain_words(self, chunk: str) -> list[str]:
        if not PLAIN.fullmatch(chunk):
            text = self.normalizer.normalize_str(chunk) if self.normalizer else chunk
            if not PLAIN.fullmatch(text):
                back = {c: b for b, c in enumerate(byte_chars())}
                return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self.pre_tokenizer.pre_tokenize_str(text)]
        else:
            text = chunk.lower() if self.normalizer and chunk.isascii() else self.normalizer.normalize_str(chunk) if self.normalizer else chunk
        return (PATTERN_SUFFIX if self.suffix else PATTERN_SPACE).findall(text)

    def resolve(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks. Plain chunks are normalised and pre-tokenised as one string."""
        index = Index(bool(self.suffix))
        get = index.__getitem__
        texts = [c[0] if isinstance(c, tuple) else c if self.suffix else " " + c for c in chunks]
        clean = PLAIN_CHUNK.fullmatch if self.suffix else PLAIN.fullmatch
        whole = self.special and any(s in "\n".join(texts) for s in self.special)
        easy = [bool(clean(t)) and not (whole and any(s in t for s in self.special)) for t in texts]
        if not self.suffix:  # joined chunks are cut apart again only where a space comes before a non-space
            easy = [e and t[:1] == " " and t[1:2] not in _BLANK for e, t in zip(easy, texts, strict=True)]
        at = np.flatnonzero(easy)
        found: list[tuple[np.ndarray, list[int], np.ndarray]] = []
        if len(at):
            picked = [texts[k] for k in at.tolist()]
            if self.suffix:
                text = self.normalizer.normalize_str(" ".join(picked))
                marks = np.fromiter(map(get, PATTERN_MARKED.findall(text + " ")), np.int64)
                ends = np.flatnonzero(marks == 0)  # the index holds the mark at 0
                if len(ends) != len(at):
                    raise AssertionError("normalisation changed the number of chunks")
                found.append((at, marks[marks > 0], np.diff(ends, prepend=-1) - 1))
            else:
                words = PATTERN_SPACE.findall("".join(picked))
                stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
                cut = np.searchsorted(stop, np.cumsum(np.fromiter(map(len, picked), np.int64, len(picked)))) + 1
                found.append((at, np.fromiter(map(get, words), np.int64, len(words)), np.diff(cut, prepend=0)))
        for k in np.flatnonzero(~np.array(easy, bool)).tolist():
            words = self.words_of(texts[k]) if texts[k] else []
            found.append((np.array([k]), np.fromiter(map(get, words), np.int64, len(words)), np.array([len(words)])))
        plain = [(w.encode("utf-8", "surrogateescape"), i) for w, i in index.items() if isinstance(w, str) and i]
        ids, n = self.encode_words([w for w, _ in plain])
        length = np.ones(len(index), np.int64)
        where = np.array([i for _, i in plain], np.int64)
        length[where] = n
        start = np.cumsum(length) - length
        table = np.empty(int(length.sum()), np.uint32)
        table[runs(n, start[where])] = ids
        for w, i in index.items():
            if isinstance(w, int):
                table[start[i]] = w
        counts = np.zeros(len(chunks), np.int64)
        for k, use, per in found:
            total = np.concatenate([[0], np.cumsum(length[use])])
            stop = np.cumsum(per)
            counts[k] = total[stop] - total[stop - per]
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for k, use, _ in found:
            out[runs(counts[k], first[k])] = table[runs(length[use], start[use])]
        return out, counts

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: token texts joined by spaces; byte-level text where there is no suffix."""
        if self.suffix:
            return " ".join(map(self.names.__getitem__, ids))
        back = {c: b for b, c in enumerate(byte_chars())}
        return bytes(back[c] for i in ids for c in self.names[i]).decode("utf-8", "replace")


_LOADED: dict[str, tuple[SpeculativeBPE, ChunkEncoder]] = {}


def loaded(path: str) -> tuple[SpeculativeBPE, ChunkEncoder]:
    """The vocabulary and its cached encoder, once a worker process."""
    if path not in _LOADED:
        bpe = SpeculativeBPE(path)
        _LOADED[path] = bpe, ChunkEncoder(by_space if bpe.suffix else before_space, bpe.resolve)
    return _LOADED[path]
