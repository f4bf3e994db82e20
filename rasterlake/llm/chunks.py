"""Token ids of whole texts through a cache of their independent chunks.

Both tokenizers' pre-tokenizers never join what this module cuts apart, so a text's ids are the
concatenation of its chunks' ids. The cache only saves work: it is emptied when it is full.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rasterlake.llm.work import runs

CACHE_CHUNKS = 500_000
LIBRARY_CHUNKS = 450_000  # beside the workers of other stages
LONE_LIBRARY_CHUNKS = 900_000  # where one Python process a core holds the only cache
_SPLIT = re.compile("[ \t\n\r\x0b\x0c]+")
_ODD = re.compile("[\x1c-\x1f]")
_BEFORE = re.compile(r"(?= \S)")
_TANGLED = re.compile(r" (?:\s|\Z)")


def by_space(text: str) -> list[str]:
    """Chunks for a tokenizer that drops white space: what stands between white space (str.split
    takes four control characters for it that the tokenizer keeps; texts with them are cut at ASCII spaces)."""
    return _SPLIT.split(text) if _ODD.search(text) else text.split()


def before_space(text: str) -> list[str | tuple[str]]:
    """Chunks for a byte-level tokenizer whose words own the one space before them: cut before each
    space that a non-space follows. A string stands for itself with one space before it, a tuple for itself."""
    if _TANGLED.search(text):
        return [c[1:] if c[0] == " " else (c,) for c in _BEFORE.split(text) if c]
    pieces = text.split(" ")
    pieces[0] = (pieces[0],)
    return pieces


class ChunkEncoder:
    """resolve: distinct chunks -> (all their ids, ids per chunk)."""

    def __init__(self, cut: Callable[[str], list[str]], resolve: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cap: int = CACHE_CHUNKS):
        self.cut, self.resolve, self.cap = cut, resolve, cap
        self.known: dict = {}
        self._start()

    def _start(self) -> None:
        """An empty cache, but for chunks that were met more than once since the last start."""
        fresh: list = []
        old = None
        if self.known:
            again = self.met[: len(self.known)] > 1
            if again.sum() < self.cap // 2:
                old = [k for k, a in zip(self.known, again.tolist(), strict=True) if a], np.flatnonzero(again)

        class Known(dict):
            def __missing__(self, key: str) -> int:
                self[key] = k = len(self)
                fresh.append(key)
                return k

        self.known, self.fresh = Known(), fresh
        self.met = np.zeros(0, np.uint8)
        if old:
            keys, at = old
            self.known.update(zip(keys, range(len(keys)), strict=True))
            self.ids = self.ids[runs(self.length[at], self.start[at])]
            self.used, self.length = len(self.ids), self.length[at]
            self.start = np.cumsum(self.length) - self.length
        else:
            self.ids, self.used = np.empty(1 << 16, np.uint32), 0
            self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and the number of ids of each text; null is empty."""
        if len(self.known) > self.cap:
            self._start()
        get, index, counts = self.known.__getitem__, [], []
        for t in texts:
            pieces = self.cut(t) if t else ()
            index.extend(map(get, pieces))
            counts.append(len(pieces))
        at = np.array(index, np.int64)
        return self._ids(at, np.array(counts, np.int64), at)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of a column, for a tokenizer that cuts by before_space: Arrow cuts the texts and numbers the distinct pieces, so
        the cache is asked once for each and not for each occurrence. Texts with a space before white space or their end are cut one by one."""
        if self.cut is not before_space:
            return self(texts.to_pylist())
        if len(self.known) > self.cap:
            self._start()
        get = self.known.__getitem__
        cut = pc.split_pattern(pc.fill_null(texts, ""), " ")
        counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        pieces, ends = cut.flatten(), np.cumsum(counts)
        heads = ends - counts  # every text has a piece, and its first one has no space before it
        later = np.ones(len(pieces), bool)
        later[heads] = False
        coded = pieces.filter(pa.array(later)).dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        odd = [k for k, c in enumerate(names) if not c or c[0].isspace()]
        tangled: dict[int, list[int]] = {}
        if odd:
            for k in odd:
                names[k] = None
            among = np.zeros(len(names), bool)
            among[odd] = True
            spots = np.flatnonzero(later)[among[coded.indices.to_numpy()]]
            which = np.unique(np.searchsorted(ends, spots, "right")).tolist()
            tangled = {i: list(map(get, before_space(texts[i].as_py()))) for i in which}
        found = np.fromiter((0 if c is None else get(c) for c in names) if odd else map(get, names), np.int64, len(names))
        first = [(c,) for c in pieces.take(pa.array(heads)).to_pylist()]
        at = np.empty(len(pieces), np.int64)
        at[later] = found[coded.indices.to_numpy()]
        at[heads] = np.fromiter((0 if i in tangled else get(c) for i, c in enumerate(first)), np.int64, len(first))
        if tangled:
            parts = np.split(at, ends[:-1])
            for i, index in tangled.items():
                parts[i], counts[i] = np.array(index, np.int64), len(index)
            at = np.concatenate(parts)
            return self._ids(at, counts, at)
        return self._ids(at, counts, np.concatenate([found, at[heads]]))

    def _ids(self, at: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of so many chunks each, by their places in the cache. asked: every place at least once."""
        if self.fresh:
            ids, lengths = self.resolve(self.fresh)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty(max(len(ids), len(self.ids)), np.uint32)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.start = np.concatenate([self.start, self.used + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
            self.used += len(ids)
            self.fresh.clear()
        if len(self.met) < len(self.known):
            self.met = np.concatenate([self.met, np.zeros(len(self.known) - len(self.met), np.uint8)])
        self.met[asked] += (self.met[asked] < 2).astype(np.uint8)  # repeats inside one batch count once
        length = self.length[at]
        flat = self.ids[runs(length, self.start[at])]
        total = np.concatenate([[0], np.cumsum(length)])
        ends = np.cumsum(counts)
        return flat, np.diff(total[np.concatenate([[0], ends])])


JOINED = 512
_ENCODERS: dict[str, ChunkEncoder] = {}


def library_resolver(path: str) -> tuple[Callable[[str], list], Callable[[list], tuple[np.ndarray, np.ndarray]]]:
    """How to cut texts, and distinct chunks by the tokenizers library itself, without special tokens,
    truncation or padding.

    Many chunks are encoded as one string, which gives the same ids as each alone, and the bytes
    that each id stands for tell where a chunk ends. Where the bytes don't come out even, or a
    chunk may not be joined, the library gets the chunk alone.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    spaced = tokenizer.normalizer is None
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    size = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():  # byte-level: a character is a byte
        size[i] = len(token if spaced else token.removesuffix("</w>"))
    glue = " "

    def bytes_of(group: list[str], whole: str) -> np.ndarray:
        """Bytes that each chunk's ids stand for (with the space before it, where ids have one)."""
        if whole.isascii():
            return np.fromiter(map(len, group), np.int64, len(group)) + spaced
        if not spaced:
            changed = tokenizer.normalizer.normalize_str(whole).split(glue)
            group = changed if len(changed) == len(group) else list(map(tokenizer.normalizer.normalize_str, group))
        return np.fromiter((len(c.encode()) for c in group), np.int64, len(group)) + spaced

    def resolve(chunks: list) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.zeros(len(chunks), np.int64)
        found: list[tuple[list[int], np.ndarray]] = []
        alone = [k for k, c in enumerate(chunks) if c.__class__ is not str]
        joined = [k for k, c in enumerate(chunks) if c.__class__ is str] if alone else list(range(len(chunks)))
        groups, wholes, members = [], [], []
        for at in range(0, len(joined), JOINED):
            index = joined[at : at + JOINED]
            group = [chunks[k] for k in index]
            whole = glue.join(group)
            # a chunk that is empty or begins with white space would run into its neighbour
            if _TANGLED.search(f" {whole}") or any(x in whole for x in special):
                alone += index
            else:
                groups.append(index)
                members.append(group)
                wholes.append(f" {whole}" if spaced else whole)
        for index, group, whole, e in zip(groups, members, wholes, tokenizer.encode_batch_fast(wholes, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum(size[ids])
            want = np.cumsum(bytes_of(group, whole))
            cut = np.minimum(np.searchsorted(ends, want), len(ids) - 1)
            if len(ids) and ends[-1] == want[-1] and (ends[cut] == want).all():
                lengths[index] = np.diff(cut, prepend=-1)
                found.append((index, ids))
            else:
                alone.extend(index)
        texts = [c[0] if isinstance(c, tuple) else f" {c}" if spaced else c for c in (chunks[k] for k in alone)]
        for k, e in zip(alone, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            lengths[k] = len(e.ids)
            found.append(([k], np.array(e.ids, np.uint32)))
        out = np.empty(int(lengths.sum()), np.uint32)
        start = np.cumsum(lengths) - lengths
        for g, ids in found:
            out[runs(lengths[g], start[g])] = ids
        return out, lengths

    return before_space if spaced else by_space, resolve


def library_encoder(path: str, cap: int = LIBRARY_CHUNKS) -> ChunkEncoder:
    """One encoder a worker process, so that tasks share its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(*library_resolver(path), cap)
    return _ENCODERS[path]
