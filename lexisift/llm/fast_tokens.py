"""Fast exact encoding with a Hugging Face `tokenizers` file: each different segment is encoded once.

A text is cut where the tokenizer's pre-tokeniser always cuts, so the ids of a text are the ids of
its segments in a row.  Two rules for such cuts are known:

* ``space``: the pre-tokeniser drops white space (its pattern never matches any), so segments are
  the runs between ASCII white space.
* ``gpt2``: the byte-level pattern.  The last white-space character before a non-space character
  either joins the next token (a blank) or is a token of its own (any other), so a cut before a
  blank, or before and after another one, is always a token border.

Strings of special tokens in a text, such as ``<|endoftext|>``, are ordinary text by default, as the note on
the tokenizer files has it (``encode_special_tokens``); with `specials=True` they become their ids,
as a tokenizer left at its defaults gives, and texts that hold one are encoded whole.

The segments of a step are told apart by a 64-bit hash of their bytes; a bounded cache keeps the ids
of segments met before in the same Python worker.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .common import NOT_SPACE, hash_spans, ranges, spans, text_buffer

#: Segments that the cache of one worker holds at most (about 40 bytes each).
CACHE_SEGMENTS = 800_000

_GPT2_PATTERN_USERS = ("ByteLevel",)
#: Lead bytes of characters that may be white space beyond ASCII.
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SPACE = ~NOT_SPACE


def rule_of(path: str) -> str:
    """Which cut rule holds for a tokenizer file; anything unknown is encoded text by text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") in _GPT2_PATTERN_USERS and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "gpt2"
    first = (pre.get("pretokenizers") or [{}])[0]
    if pre.get("type") == "Sequence" and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
        pattern = first.get("pattern", {}).get("Regex", "")
        kinds = {x.get("type") for x in (norm or {}).get("normalizers", [])}
        if "[^\\s\\p{L}\\p{N}]" in pattern and " ?" not in pattern and kinds <= {"NFC", "Replace", "Lowercase"}:
            return "space"
    return "text"


def cuts_gpt2(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    last = np.zeros(n, bool)
    last[:-1] = _SPACE[buf[:-1]] & NOT_SPACE[buf[1:]] & ~_ODD_LEAD[buf[1:]] & ~edge[1:n]
    at = np.flatnonzero(last)
    edge[at] = True
    edge[at[buf[at] != 0x20] + 1] = True
    edge[n] = True
    marks = np.flatnonzero(edge)
    starts, ends = marks[:-1], marks[1:]
    return starts, ends, np.searchsorted(starts, offs)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As np.unique with first places and inverse, by a hash table: only the different values are sorted."""
    codes, seen = pd.factorize(h)
    first = np.empty(len(seen), np.int64)
    first[codes[::-1]] = np.arange(len(h) - 1, -1, -1)
    order = np.argsort(seen)
    rank = np.empty(len(seen), np.int64)
    rank[order] = np.arange(len(seen))
    return seen[order], first[order], rank[codes]


class Encoder:
    """Encodes Arrow string columns to flat ids and offsets."""

    def __init__(self, path: str, specials: bool = False) -> None:
        # the tasks of an executor are its parallelism: a thread pool in each worker only costs CPU time
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not specials
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.special] if specials else []
        self.rule = rule_of(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        counts = np.empty(len(texts), np.int32)
        for i in range(0, len(texts), 20_000):
            for k, e in enumerate(self.tok.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)):
                got = e.ids
                counts[i + k] = len(got)
                ids += got
        return np.array(ids, np.uint32), counts

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each text's ids."""
        if self.specials:
            col = pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(buf.tobytes())])
            held = np.zeros(len(col), bool)
            for x in self.specials:
                held |= pc.match_substring(col, x, ignore_case=True).to_numpy(zero_copy_only=False)
            if held.any():
                return self._mixed(col, held)
        return self._cut(buf, offs)

    def _mixed(self, col: pa.Array, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold a special token are encoded whole, the others by segments."""
        whole, counts = self._raw(col.filter(pa.array(held)).to_pylist())
        cut, at = self._cut(*text_buffer(col.filter(pa.array(~held))))
        n = np.empty(len(col), np.int64)
        n[held], n[~held] = counts, np.diff(at)
        offs = np.concatenate([[0], np.cumsum(n)])
        ids = np.empty(offs[-1], np.uint32)
        ids[ranges(offs[:-1][held], n[held])] = whole
        ids[ranges(offs[:-1][~held], n[~held])] = cut
        return ids, offs

    def _cut(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.rule == "text":
            ids, counts = self._raw([buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)])
            return ids, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        starts, ends, soffs = cuts_gpt2(buf, offs) if self.rule == "gpt2" else spans(buf, offs, NOT_SPACE)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        seen, first, inverse = _distinct(hash_spans(buf, starts, ends))
        where = np.searchsorted(self.keys, seen)
        known = np.zeros(len(seen), bool)
        inner = where < len(self.keys)
        known[inner] = self.keys[where[inner]] == seen[inner]
        new = np.flatnonzero(~known)
        if len(new):
            a, b = starts[first[new]], ends[first[new]]
            size = b - a
            joined = buf[ranges(a, size)]
            o = np.concatenate([[0], np.cumsum(size)])
            texts = pa.Array.from_buffers(pa.large_string(), len(new), [None, pa.py_buffer(o.astype(np.int64).tobytes()), pa.py_buffer(joined.tobytes())]).to_pylist()
            ids, counts = self._raw(texts)
            if len(self.keys) + len(new) > CACHE_SEGMENTS:  # keep what this step uses, forget the rest
                held = where[known]
                n = self.count[held]
                self.ids = self.ids[ranges(self.at[held], n.astype(np.int64))]
                self.keys, self.count = self.keys[held], n
                self.at = np.cumsum(n, dtype=np.int64) - n
            at = len(self.ids) + np.cumsum(counts, dtype=np.int64) - counts
            spot = np.searchsorted(self.keys, seen[new])
            self.keys = np.insert(self.keys, spot, seen[new])
            self.at = np.insert(self.at, spot, at)
            self.count = np.insert(self.count, spot, counts)
            self.ids = np.concatenate([self.ids, ids])
            where = np.searchsorted(self.keys, seen)
        n = self.count[where][inverse].astype(np.int64)
        out = self.ids[ranges(self.at[where][inverse], n)]
        ends_at = np.concatenate([[0], np.cumsum(n)])
        return out, ends_at[soffs]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, specials: bool = False) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if (path, specials) not in _ENCODERS:
        _ENCODERS[path, specials] = Encoder(path, specials)
    return _ENCODERS[path, specials]
