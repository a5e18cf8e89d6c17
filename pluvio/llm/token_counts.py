"""Token counts by finite-state transducers.

A BPE vocabulary with word ends is compiled, state by state as texts need it,
into a deterministic transducer over bytes.  Each transition carries the change
in the number of tokens, so a word's count is the sum over its path:

* the tokens of a prefix end in one last token, and what stands before it is
  the token sequence of a shorter prefix; a token may follow another when
  merging the two together leaves both.  A state is therefore the longest suffix
  that starts some token, with the last token and the relative count at each
  of its positions: finite, whatever the word;
* the word-end transition does the same with tokens that carry the end mark.

Words are found by a small automaton over character classes (letters, single
digits, other signs, contractions), computed for whole batches at once.  The
byte stream is cut into chunks of fixed length, which run side by side.  Entry states
are guessed by a warm-up over the bytes before; each chunk's exit is compared with
the next one's entry, and chunks that entered wrongly run again until all
fit, so chunk borders may lie inside words of any length.  (No maps over all entry
states are made; see the README.)
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from pluvio.llm.common import whole_text

CHUNK = 512
WARM_UP = 48
#: Characters handled at once.
SLICE_CHARS = 4_000_000
#: States kept at most; the tables start anew beyond it, as a lazy automaton's cache does.
MAX_STATES = 300_000
_NEVER = 1 << 60
_END = "Ā"  # the word-end mark; bytes are characters below it

LETTER, DIGIT, OTHER, SPACE = 1, 2, 3, 0


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes (fixed, published rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Signs:
    """What the library makes of single code points, asked of the library itself: its class for
    splitting words, and whether normal form or lower case need the library for the text around."""

    def __init__(self):
        # the planes beyond hold no assigned signs but private ones
        points = [*range(1, 0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]
        every = "".join(map(chr, points))
        at = np.array(points)

        def having(pattern: str) -> np.ndarray:
            out = np.zeros(0x110000, bool)
            split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
            for _, (start, stop) in split.pre_tokenize_str(every):
                out[at[start:stop]] = True
            return out

        self.classes = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in (("\\p{L}+", LETTER), ("\\p{N}+", DIGIT), ("\\s+", SPACE)):
            self.classes[having(pattern)] = kind
        # one code point a line; the line feed itself (10) is neither changed nor composed
        lines = "\n".join(chr(c) for c in points if c != 10)
        alone = at[at != 10]
        composed, apart, low = (n.normalize_str(lines).split("\n") for n in (normalizers.NFC(), normalizers.NFD(), normalizers.Lowercase()))
        # text without these is in normal form C: changed alone, second in some decomposition, or a mark
        self.unsettled = having("\\p{M}+")
        self.unsettled[[c for c, x in zip(points, every) if unicodedata.combining(x)]] = True
        self.unsettled[[c for c, x in zip(alone.tolist(), composed) if x != chr(c)]] = True
        self.unsettled[sorted({ord(x) for parts in apart for x in parts[1:]})] = True
        # lower case: str.lower looks around a final sigma, and its tables may be of another age
        self.cased = np.zeros(0x110000, bool)
        self.cased[[ord("\u03a3"), *(c for c, x in zip(alone.tolist(), low) if x != chr(c).lower())]] = True
        self.compose, self.lower = normalizers.NFC().normalize_str, normalizers.Lowercase().normalize_str

    def normal(self, text: str) -> str:
        """``text`` in normal form C and lower case, as the library has it."""
        if text.isascii():
            return text.lower()
        cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if self.unsettled[cp].any():
            text = self.compose(text)
            cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
        return self.lower(text) if self.cased[cp].any() else text.lower()


class Transducer:
    """The compiled part of one vocabulary's word automaton."""

    START = 0

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end, back = model["end_of_word_suffix"], byte_letters()

        def own(token: str) -> str:
            final = token.endswith(end)
            return "".join(chr(back[c]) for c in (token[: -len(end)] if final else token)) + _END * final

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(own(a), own(b)): i for i, (a, b) in enumerate(merges)}
        added = {t["content"] for t in spec["added_tokens"]}
        self.tokens = {own(t) for t in model["vocab"] if t not in added}
        # what a token can still grow from: proper beginnings, and whole words' texts
        whole = {t[:-1] for t in self.tokens if t.endswith(_END)}
        self.prefixes = whole | {t[:k] for t in self.tokens for k in range(len(t.rstrip(_END)))}
        self.specials = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.made: dict[str, tuple[list, list] | None] = {}
        self.signs = Signs()
        self.classes = self.signs.classes
        self.reset()

    # -- merges -------------------------------------------------------------
    def spines(self, token: str) -> tuple[list, list] | None:
        """How ``token`` is merged together: its (part, rank of the merge that takes the part up)
        along the right and the left edge; None if merging its signs does not give it."""
        if token not in self.made:
            parts, splits = [*token[:-2], token[-2:]] if token.endswith(_END) else [*token], {}
            while len(parts) > 1:
                ranks = [self.rank.get(p, _NEVER) for p in zip(parts, parts[1:])]
                low = min(ranks)
                if low == _NEVER:
                    break
                out, i = [], 0
                while i < len(parts):
                    if i < len(ranks) and ranks[i] == low:
                        splits[parts[i] + parts[i + 1]] = (parts[i], parts[i + 1], low)
                        out.append(parts[i] + parts[i + 1])
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            found = None
            if parts == [token] and token in self.tokens:
                found = ([], [])
                for side, spine in ((1, found[0]), (0, found[1])):
                    part, rank = token, _NEVER
                    spine.append((part, rank))
                    while part in splits:
                        rank, part = splits[part][2], splits[part][side]
                        spine.append((part, rank))
            self.made[token] = found
        return self.made[token]

    def may_follow(self, last: str | None, token: str) -> bool:
        """Whether merging ``last`` and ``token`` together leaves both: no part of the one's
        right edge merges with one of the other's left edge while both stand free."""
        own = self.spines(token)
        if own is None or last is None:
            return own is not None
        get = self.rank.get
        for x, taken in self.made[last][0]:
            for y, taken_y in own[1]:
                q = get((x, y))
                if q is not None and q < taken and q <= taken_y and q != _NEVER:
                    return False
        return True

    # -- states -------------------------------------------------------------
    def reset(self) -> None:
        self.keys: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.last = np.full(1024, -128, np.int8)
        self.n = 0
        self._table(1 << 16)
        self.state(("", (None,), (0,)))

    def _table(self, size: int) -> None:
        self.at, self.to, self.by = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int8)

    def state(self, key: tuple) -> int:
        if key not in self.index:
            self.index[key] = len(self.keys)
            self.keys.append(key)
            if len(self.keys) > len(self.last):
                self.last = np.concatenate([self.last, np.full_like(self.last, -128)])
        return self.index[key]

    def _slot(self, edges: np.ndarray) -> np.ndarray:
        """The table slot of each edge (state << 8 | byte): its own, or the free one it would take."""
        mask = len(self.at) - 1
        slot = ((edges * 0x9E3779B1) >> 7) & mask
        held = self.at[slot]
        off = np.flatnonzero((held != edges) & (held >= 0))
        while len(off):
            slot[off] = (slot[off] + 1) & mask
            held = self.at[slot[off]]
            off = off[(held != edges[off]) & (held >= 0)]
        return slot

    def _put(self, edges: np.ndarray, to: np.ndarray, by: np.ndarray) -> None:
        if 2 * (self.n + len(edges)) > len(self.at):
            used = self.at >= 0
            old = self.at[used], self.to[used], self.by[used]
            self._table(4 * len(self.at))
            self.n = 0
            self._put(*old)
        self.n += len(edges)
        while len(edges):
            slot = self._slot(edges)
            self.at[slot] = edges  # of two edges on one slot the last stays
            mine = self.at[slot] == edges
            self.to[slot[mine]], self.by[slot[mine]] = to[mine], by[mine]
            edges, to, by = edges[~mine], to[~mine], by[~mine]

    def _best(self, key: tuple, text: str, mark: str) -> tuple[str, int]:
        """The last token after ``text`` (+ mark) and its count, relative to the state's."""
        _, last, count = key
        for k in range(len(text)):
            token = text[k:] + mark
            if last[k] != "" and token in self.tokens and self.may_follow(last[k], token):
                return token, count[k] + 1
        raise ValueError(f"no token ends {text!r}")

    def step(self, edge: int) -> tuple[int, int]:
        """(state, count change) behind an edge."""
        key = self.keys[edge >> 8]
        text = key[0] + chr(edge & 0xFF)
        token, change = self._best(key, text, "")
        last, count = (*key[1], token), (*key[2], change)
        # only positions where some token can begin and go on tell states apart
        opens = [text[k:] in self.prefixes for k in range(len(text) + 1)]
        k = opens.index(True)
        rest = [(t, c - change) if o else ("", 0) for t, c, o in zip(last[k:], count[k:], opens[k:])]
        t, c = zip(*rest)
        return self.state((text[k:], t, c)), change

    def finish(self, s: int) -> None:
        """Count change at the end of a word: its last sign carries the end mark."""
        key = self.keys[s]
        self.last[s] = self._best(key, key[0], _END)[1]

    # -- runs ---------------------------------------------------------------
    def _advance(self, s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edges = s.astype(np.int64) << 8 | c
        slot = self._slot(edges)
        miss = self.at[slot] < 0
        if miss.any():
            new = np.unique(edges[miss])
            to, by = zip(*map(self.step, new.tolist()))
            self._put(new, np.array(to, np.int32), np.array(by, np.int8))
            slot = self._slot(edges)
        return self.to[slot], self.by[slot]

    def run(self, cols: np.ndarray, first: np.ndarray, final: np.ndarray, entry: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Exit states of chunks that run side by side (arrays are step x chunk); ``out`` gets the count changes."""
        s = entry
        for t in range(len(cols)):
            s, d = self._advance(np.where(first[t], self.START, s), cols[t])
            at = np.flatnonzero(final[t])
            if len(at):
                e = self.last[s[at]]
                if e.min() == -128:
                    for p in np.unique(s[at][e == -128]).tolist():
                        self.finish(p)
                    e = self.last[s[at]]
                d = d.copy()
                d[at] += e
            out[t] = d
        return s

    def changes(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The count change at every byte; ``first`` marks the bytes that begin a word."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int8)
        chunks = -(-n // CHUNK)
        pad = chunks * CHUNK - n
        cols = np.concatenate([data, np.full(pad, data[0])])
        first = np.concatenate([first, np.ones(pad, bool)])
        final = np.concatenate([first[1:], [True]])
        deal = lambda x: np.ascontiguousarray(x.reshape(chunks, CHUNK).T)
        c, f, e = deal(cols), deal(first), deal(final)
        out = np.zeros((CHUNK, chunks), np.int8)
        # entry states: exact where a word begins in the warm-up, else a guess that is checked below
        entry = np.zeros(chunks, np.int32)
        if chunks > 1:
            tail = slice(CHUNK - WARM_UP, CHUNK)
            scratch = np.zeros((WARM_UP, chunks - 1), np.int8)
            entry[1:] = self.run(c[tail, :-1], f[tail, :-1], np.zeros((WARM_UP, chunks - 1), bool), entry[1:], scratch)
        exits = self.run(c, f, e, entry, out)
        while chunks > 1:  # each must enter where the one before left
            wrong = np.flatnonzero((entry[1:] != exits[:-1]) & ~f[0, 1:]) + 1
            if not len(wrong):
                break
            entry[wrong] = exits[wrong - 1]
            again = np.zeros((CHUNK, len(wrong)), np.int8)
            exits[wrong] = self.run(c[:, wrong], f[:, wrong], e[:, wrong], entry[wrong], again)
            out[:, wrong] = again
        return out.T.reshape(-1)[:n]

    # -- texts --------------------------------------------------------------
    def _words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, begins a word, bytes) of every character of a normalised text."""
        cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = self.classes[cp]
        before = np.concatenate([[SPACE], kind[:-1]]).astype(np.uint8)
        first = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
        mark = np.flatnonzero((cp == 39) & (before != OTHER))
        if len(mark):
            padded = np.concatenate([cp, np.zeros(3, cp.dtype)])
            a, b = padded[mark + 1], padded[mark + 2]
            one = np.isin(a, [ord(x) for x in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            first[mark[one | two] + 1] = False
            for at in (mark[one] + 2, mark[two] + 3):
                at = at[at < len(cp)]
                first[at[kind[at] == LETTER]] = True
        width = 1 + (cp > 0x7F) + (cp > 0x7FF).astype(np.int64) + (cp > 0xFFFF)
        return kind, first, width

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, as the library counts them."""
        if len(self.keys) > MAX_STATES:
            self.reset()
        n = np.zeros(len(texts), np.int64)
        clean = []
        for i, t in enumerate(texts):
            if self.specials is not None and "<" in t:
                parts = self.specials.split(t)
                n[i] += len(parts) - 1
                t = "\n".join(parts)  # white space ends a word as a special token does
            clean.append(self.signs.normal(t))
        text = "\n".join(clean)
        kind, first, width = self._words(text)
        ends = np.cumsum(width)
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        begins = np.zeros(len(data), bool)
        begins[(ends - width)[first]] = True
        keep = np.repeat(kind != SPACE, width)
        change = self.changes(data[keep], begins[keep])
        total = np.concatenate([[0], np.cumsum(change, dtype=np.int64)])
        kept = np.concatenate([[0], np.cumsum(keep)])
        cut = np.concatenate([[0], ends])
        stop = np.cumsum([len(t) + 1 for t in clean]) - 1  # each text's end, in characters
        start = stop - [len(t) for t in clean]
        return n + total[kept[cut[stop]]] - total[kept[cut[start]]]


_LOADED: dict[str, Transducer] = {}


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    machine = _LOADED[path]
    for batch in batches:
        texts = batch.column("_text").to_pylist()
        sizes = np.cumsum([len(t) for t in texts])
        start = 0
        counts = []
        while start < len(texts):
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + SLICE_CHARS, "right")))
            counts.append(machine.counts(texts[start:stop]))
            start = stop
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_bytes"), pa.array(n)], ["_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    The file is a lower-casing word BPE with an end-of-word suffix.  Null and empty texts
    have 0 tokens; strings of special tokens inside a text count as one token each, as the
    library does; repeated rows are counted each; an empty table gives an empty result.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.octet_length(text).cast("long").alias("_bytes"), text.alias("_text"))
    counted = rows.mapInArrow(lambda it: _count(it, tokenizer), "_id long, n_bytes long, n_tokens long")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
