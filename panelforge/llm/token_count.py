"""Token counts with a compiled finite-state tokenizer.

Two deterministic transducers stand in for the tokenizer of a ``word_bpe`` vocabulary file:

* ``Splitter`` finds where pre-tokens start. It has five states over six character classes. A text block is cut into
  chunks; each chunk's map from entry state to exit state is run for all states at once, and the maps compose through a
  parallel prefix scan, which gives every chunk its entry state.
* ``WordMachine`` reads the bytes of a pre-token. Its transitions carry the change in the number of emitted tokens, and
  its states are compiled when first met. A state holds the longest suffix of the bytes read that can still grow into a
  vocabulary entry, with the last token and the relative count at each position where such an entry can start. Extending by a byte
  picks the one entry that ends there and is a valid neighbour of the token before it, which is byte-pair encoding read
  from left to right. All words of a block advance together, one byte a step.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Character classes. The two apostrophe classes start a contraction of two and of three characters.
SPACE, LETTER, NUMBER, PUNCT, APOS_2, APOS_3 = range(6)
# Splitter states: outside, in letters, in punctuation, one and two characters of a contraction left.
OUT, IN_LETTERS, IN_PUNCT, LEFT_1, LEFT_2 = range(5)
CHUNK = 256
BLOCK_CHARS = 1 << 20
#: States that a worker keeps before it starts anew; bounds its memory to about 1 KB each.
MAX_STATES = 200_000
#: The character classes of the vocabulary file's pattern.
PATTERNS = {SPACE: r"\s+", LETTER: r"\p{L}+", NUMBER: r"\p{N}+"}
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(spare)) for b in range(256)]


@cache
def character_classes() -> np.ndarray:
    """Each code point's class, asked of the library, which has a Unicode version of its own."""
    from tokenizers import Regex, pre_tokenizers

    points = np.delete(np.arange(0x110000), np.s_[0xD800:0xE000])
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    classes = np.full(0x110000, PUNCT, np.uint8)
    for kind, pattern in PATTERNS.items():
        for _, (start, end) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            classes[points[start:end]] = kind
    return classes


class Splitter:
    """Compiled pre-tokenizer: letters, single numbers, contractions, and runs of anything else."""

    def __init__(self, classes: np.ndarray) -> None:
        self.classes = classes
        begin = {SPACE: OUT, LETTER: IN_LETTERS, NUMBER: OUT, PUNCT: IN_PUNCT, APOS_2: LEFT_1, APOS_3: LEFT_2}
        step = np.zeros((5, 6), np.uint8)
        starts = np.zeros((5, 6), bool)
        for c, state in begin.items():
            for s in (OUT, IN_LETTERS, IN_PUNCT):
                step[s, c], starts[s, c] = state, c != SPACE
        starts[IN_LETTERS, LETTER] = False
        for c in (PUNCT, APOS_2, APOS_3):
            step[IN_PUNCT, c], starts[IN_PUNCT, c] = IN_PUNCT, False
        step[LEFT_1, :], step[LEFT_2, :] = OUT, LEFT_1
        self.step, self.starts = step.ravel(), starts.ravel()

    def classify(self, cps: np.ndarray) -> np.ndarray:
        cls = self.classes[cps]
        at = np.flatnonzero(cps == ord("'"))
        if len(at):
            padded = np.append(cps, [32, 32])
            one, two = padded[at + 1], padded[at + 2]
            short = np.isin(one, [ord(x) for x in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            cls[at[short]], cls[at[long]] = APOS_2, APOS_3
        return cls

    def chunk_maps(self, grid: np.ndarray) -> np.ndarray:
        """grid: one chunk a column. Returns each chunk's exit state for every entry state."""
        state = np.repeat(np.arange(5, dtype=np.uint8)[:, None], grid.shape[1], axis=1)
        for row in grid:
            state = self.step[state * np.uint8(6) + row]
        return state.T.copy()

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Inclusive prefix composition of state maps, in log2(n) rounds."""
        maps, d = maps.copy(), 1
        while d < len(maps):
            maps[d:] = np.take_along_axis(maps[d:], maps[:-d], axis=1)
            d *= 2
        return maps

    def token_starts(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flags of the characters that start a pre-token, and of those that belong to one."""
        n = len(cps)
        cls = self.classify(cps)
        grid = np.full(-(-n // CHUNK) * CHUNK, SPACE, np.uint8)
        grid[:n] = cls
        grid = np.ascontiguousarray(grid.reshape(-1, CHUNK).T)
        whole = self.scan(self.chunk_maps(grid))
        state = np.append(np.uint8(OUT), whole[:-1, OUT])
        flags = np.empty(grid.shape, bool)
        for i, row in enumerate(grid):
            k = state * np.uint8(6) + row
            flags[i] = self.starts[k]
            state = self.step[k]
        return flags.T.ravel()[:n], cls != SPACE


class WordMachine:
    """Lazily compiled transducer from the bytes of a pre-token to its number of tokens."""

    def __init__(self, vocab: dict[str, int], merges: Iterable, suffix: str) -> None:
        self.suffix = suffix
        self.symbols = byte_symbols()
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
        self.inner = {t for t in vocab if not t.endswith(suffix)}
        self.final = {t[: -len(suffix)] for t in vocab if t.endswith(suffix)}
        self.prefixes = {t[:i] for t in self.inner | self.final for i in range(len(t))}
        self.fits: dict[tuple, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.keys: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.columns = np.full(512, -1, np.int64)
        self.column_symbols: list[int] = []
        self.table = np.full((1024, 64), -1, np.int32)
        self.state("", ((None, 0),))

    def state(self, suffix: str, ends: tuple) -> int:
        k = self.ids.get((suffix, ends))
        if k is None:
            k = self.ids[suffix, ends] = len(self.keys)
            self.keys.append((suffix, ends))
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.full((len(self.table) // 2, self.table.shape[1]), -1, np.int32)])
        return k

    def encode(self, parts: list[str]) -> list[str]:
        """Byte-pair encoding of a short list of symbols, merge by merge."""
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            a, b = parts[i], parts[i + 1]
            out, j = [], 0
            while j < len(parts):
                if j + 1 < len(parts) and parts[j] == a and parts[j + 1] == b:
                    out.append(a + b)
                    j += 2
                else:
                    out.append(parts[j])
                    j += 1
            parts = out
        return parts

    def neighbours(self, left: str | None, token: str, last: bool) -> bool:
        """Whether the encoder, given both tokens' symbols, returns just these tokens."""
        k = (left, token, last)
        if k not in self.fits:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            ends = list(token)
            if last:
                ends[-1] += self.suffix
            want = ([left] if left else []) + [token + (self.suffix if last else "")]
            self.fits[k] = self.encode(list(left or "") + ends) == want
        return self.fits[k]

    def compile(self, state: int, symbol: int) -> int:
        """Next state and change in count of one transition, packed as state * 256 + change + 128."""
        suffix, ends = self.keys[state]
        last, grown = symbol >= 256, suffix + self.symbols[symbol % 256]
        entries = self.final if last else self.inner
        for size in range(len(grown), 0, -1):
            token = grown[-size:]
            if token in entries and self.neighbours(ends[size - 1][0], token, last):
                break
        else:
            raise ValueError(f"no token ends {grown!r}")
        change = ends[size - 1][1] + 1
        if last:
            return change + 128
        while grown not in self.prefixes:
            grown = grown[1:]
        after = [(token, 0)]
        for k in range(1, len(grown) + 1):
            open_at = ends[k - 1] if grown[-k:] in self.prefixes else None
            after.append(open_at and (open_at[0], open_at[1] - change))
        return self.state(grown, tuple(after)) * 256 + change + 128

    def counts(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each word, a slice of data; all words take a step at a time."""
        if len(self.keys) > MAX_STATES:
            self.reset()
        order = np.argsort(-sizes, kind="stable")
        at, left = starts[order], sizes[order]
        still = len(order) - np.searchsorted(left[::-1], np.arange(1, left[0] + 1)) if len(left) else []
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for i, n in enumerate(still):
            symbol = data[at[:n] + i].astype(np.int64) + 256 * (left[:n] == i + 1)
            column = self.columns[symbol]
            if (column < 0).any():
                for s in np.unique(symbol[column < 0]):
                    self.columns[s] = len(self.column_symbols)
                    self.column_symbols.append(int(s))
                column = self.columns[symbol]
                while len(self.column_symbols) > self.table.shape[1]:
                    self.table = np.concatenate([self.table, np.full((len(self.table), 64), -1, np.int32)], axis=1)
            go = self.table[state[:n], column]
            missing = go < 0
            if missing.any():
                for k in np.unique(state[:n][missing] * 1024 + column[missing]):
                    s, c = divmod(int(k), 1024)
                    packed = self.compile(s, self.column_symbols[c])
                    self.table[s, c] = packed
                go = self.table[state[:n], column]
            total[:n] += (go & 255) - 128
            state[:n] = go >> 8
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


class CompiledTokenizer:
    """Counts the tokens of texts as the vocabulary file's tokenizer does."""

    def __init__(self, spec: str, classes: np.ndarray) -> None:
        self.spec, conf = spec, json.loads(spec)
        model = conf["model"]
        self.splitter = Splitter(classes)
        self.words = WordMachine(model["vocab"], model["merges"], model["end_of_word_suffix"])
        special = sorted((t["content"] for t in conf["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.mark = os.path.commonprefix(special)  # a cheap test that rules most texts out
        self.library = None

    def normalize(self, text: str) -> str:
        if not _BEYOND_LATIN.search(text):
            return text.lower()
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        return self.library.normalizer.normalize_str(text)

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Normalised parts between special strings, long ones cut at spaces, and the number of special strings."""
        parts = self.special.split(text) if self.special and self.mark in text else [text]
        out = []
        for part in map(self.normalize, parts):
            at = 0
            while len(part) - at > BLOCK_CHARS:
                cut = re.compile(r"[ \n]").search(part, at + BLOCK_CHARS // 2)
                if not cut:
                    break
                out.append(part[at : cut.start()])
                at = cut.end()
            out.append(part[at:])
        return out, len(parts) - 1

    def count_block(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part; a space between parts returns both machines to their start."""
        text = " ".join(parts) + " "
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts, used = self.splitter.token_starts(cps)
        data = np.frombuffer(text.encode(), np.uint8)
        first = np.flatnonzero(starts)
        ends = np.flatnonzero(used[:-1] & (starts[1:] | ~used[1:])) + 1
        owner = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), first, side="right")
        if len(data) != len(cps):
            offset = np.zeros(len(cps) + 1, np.int64)
            np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800).astype(np.int64) + (cps >= 0x10000), out=offset[1:])
            first, ends = offset[first], offset[ends]
        counts = self.words.counts(data, first, ends - first)
        return np.bincount(owner, weights=counts, minlength=len(parts)).astype(np.int64)

    def count(self, texts: Iterable[str | None]) -> np.ndarray:
        totals: list[int] = []
        block: list[str] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if block:
                for i, n in zip(owners, self.count_block(block), strict=True):
                    totals[i] += int(n)
            block.clear()
            owners.clear()
            held = 0

        for i, text in enumerate(texts):
            parts, n = self.pieces(text or "")
            totals.append(n)
            for part in parts:
                block.append(part)
                owners.append(i)
                held += len(part) + 1
                if held >= BLOCK_CHARS:
                    flush()
        flush()
        return np.array(totals, np.int64)


_compiled: dict[int, CompiledTokenizer] = {}


def compiled(spec: str, classes: np.ndarray) -> CompiledTokenizer:
    """One machine a worker process, so that compiled states serve all its tasks."""
    key = hash(spec)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = CompiledTokenizer(spec, classes)
    return _compiled[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > max_tokens).

    Null and empty texts have no bytes and no tokens; null ids and repeated rows stay, each with its own counts; other
    columns of docs are not read. A text of any length takes memory for itself and one block of BLOCK_CHARS (one without
    blanks is a block of its own). The file at tokenizer_path is read on the driver and sent to the workers (2 MB).
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast((f.read(), character_classes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(*spec.value)
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            tokens = machine.count(t.as_py() for t in texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(tokens), pa.array(tokens > max_tokens)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
