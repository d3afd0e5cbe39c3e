"""BPE encoding and decoding over a minimal acyclic transducer lexicon.

The corpus's most frequent words are counted over all documents, encoded once, and
compiled by one task into a minimal acyclic automaton: words with a common ending
share their last states. Each arc carries the number of words that sort before it, so
that a walk yields the word's number, and the number yields its ids. The bytes are
broadcast; each worker process maps them from an unlinked file of its own. Words that
aren't in the automaton, as a filter of bits mostly tells without a walk, are merged
exactly by rank, many side by side, so the lexicon's size affects speed and never the
result.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import struct
import tempfile
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain
from os.path import commonprefix
from pathlib import Path

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.shared import forget_tables, materialise, worker_tables

#: The lexicon's most words. It is a cache: any value gives the same ids.
LEXICON_WORDS = 100_000
#: Entries of a worker's table before it keeps only what the texts at hand use.
MEMO_WORDS = 250_000
#: Characters of the texts, and words of one text, that are looked up together.
TEXTS_CHARS, TEXT_WORDS = 1_000_000, 200_000
#: Pieces of at most so many bytes are merged side by side.
SIDE_BY_SIDE = 32
END = "</w>"

# Code points on which Python's normalisation, lower case and classes agree with the
# tokenizers library (tests go through all of them); other texts are cut by the library.
PLAIN = regex.compile(r"[\x00-\x7F\xA0-ſ‐-‧‰-⁞₠-₿]*+")
# Python's split() cuts at these, the tokenizers library doesn't.
UNSPLIT = regex.compile(r"[\x1C-\x1F]")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _plain_pieces() -> re.Pattern:
    """PIECES for words of PLAIN code points, with the classes spelt out."""
    plain = [chr(c) for c in range(0x2100) if PLAIN.fullmatch(chr(c))]
    every = sorted({*plain, *"".join(plain).lower()})
    members = lambda form: "".join(map(re.escape, filter(regex.compile(form).fullmatch, every)))
    letters, numbers, spaces = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


PLAIN_PIECES = _plain_pieces()


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it prints, else
    the next free one from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = {}, 256
    for b in range(256):
        out[b] = chr(b) if b in kept else chr(free)
        free += b not in kept
    return out


class Transducer:
    """A minimal acyclic automaton over byte strings, each with a tuple of ids.

    Layout: eight-byte header (states, arcs, words as 32-bit numbers follow it), arc
    labels, then 32-bit arrays: first arc of each state (plus an end mark), final marks,
    arc targets, arc skips, id offsets, ids; at the end the filter, a power of two of
    bits, at least 16 for each word, and its size in bytes.
    """

    MAGIC = b"mat-lex2"

    @staticmethod
    def compile(entries: dict[bytes, tuple[int, ...]]) -> bytes:
        words = sorted(entries)
        # state: [final, {label: state}]; finished states are unique by content
        register: dict[tuple, int] = {}
        done: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def freeze(state: list) -> int:
            key = (state[0], tuple(sorted(state[1].items())))
            if key not in register:
                register[key] = len(done)
                done.append(key)
            return register[key]

        path: list[list] = [[False, {}]]
        last = b""
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            for depth in range(len(last), common, -1):
                path[depth - 1][1][last[depth - 1]] = freeze(path.pop())
            for _ in word[common:]:
                path.append([False, {}])
            path[-1][0] = True
            last = word
        for depth in range(len(last), 0, -1):
            path[depth - 1][1][last[depth - 1]] = freeze(path.pop())
        root = freeze(path[0])

        below = []  # words accepted from each state; targets precede their sources
        for final, arcs in done:
            below.append(final + sum(below[t] for _, t in arcs))
        order = [root, *[s for s in range(len(done)) if s != root]]
        number = {s: i for i, s in enumerate(order)}
        labels, first, finals, targets, skips = bytearray(), [0], [], [], []
        for s in order:
            final, arcs = done[s]
            seen = int(final)
            for label, target in arcs:
                labels.append(label)
                targets.append(number[target])
                skips.append(seen)
                seen += below[target]
            finals.append(int(final))
            first.append(len(labels))
        offsets, ids = [0], []
        for word in words:
            ids += entries[word]
            offsets.append(len(ids))
        head = Transducer.MAGIC + struct.pack("<3i", len(order), len(labels), len(words))
        labels += b"\0" * (-len(labels) % 4)
        body = b"".join(struct.pack(f"<{len(x)}i", *x) for x in (first, finals, targets, skips, offsets, ids))
        bits = bytearray(max(8, 1 << (2 * len(words)).bit_length()))
        for word in words:
            h = zlib.crc32(word) & 8 * len(bits) - 1
            bits[h >> 3] |= 1 << (h & 7)
        return head + bytes(labels) + body + bytes(bits) + struct.pack("<i", len(bits))

    def __init__(self, image: bytes):
        with tempfile.TemporaryFile() as file:  # unlinked: gone with the process
            file.write(image)
            file.flush()
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        states, arcs, words = struct.unpack_from("<3i", self._map, 8)
        self.states, self.arcs, self.words = states, arcs, words
        self._labels = at = 20
        at += arcs + -arcs % 4
        view = memoryview(self._map)
        parts = []
        for n in (states + 1, states, arcs, arcs, words + 1):
            parts.append(view[at : at + 4 * n].cast("i"))
            at += 4 * n
        self._first, self._final, self._target, self._skip, self._offset = parts
        (size,) = struct.unpack_from("<i", self._map, len(view) - 4)
        self._bits, self._mask = view[-4 - size : -4], 8 * size - 1
        self._ids = view[at : -4 - size].cast("i")

    def get(self, word: bytes) -> tuple[int, ...] | None:
        h = zlib.crc32(word) & self._mask
        if not self._bits[h >> 3] >> (h & 7) & 1:
            return None
        state = number = 0
        labels, find = self._labels, self._map.find
        for b in word:
            lo = self._first[state]
            arc = find(bytes((b,)), labels + lo, labels + self._first[state + 1]) - labels
            if arc < 0:
                return None
            number += self._skip[arc]
            state = self._target[arc]
        if not self._final[state]:
            return None
        return tuple(self._ids[self._offset[number] : self._offset[number + 1]])


class WordBpe:
    """A word-end BPE tokenizer read from a tokenizers file."""

    def __init__(self, spec: str, lexicon: bytes | None = None):
        data = json.loads(spec)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {tuple(m): i for i, m in enumerate(pairs)}
        self.added = {a["content"]: a["id"] for a in data["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        #: What every special token begins with.
        self.hint = commonprefix(list(self.added))
        self.letters = str.maketrans(byte_letters())
        self.lexicon = Transducer(lexicon) if lexicon else None
        self._spec = spec

    @cached_property
    def library(self):
        """The library's tokenizer, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self._spec)

    def words(self, text: str) -> list[str]:
        """Stretches of a text without special tokens whose ids can be worked out one by
        one: those between white space where pieces() can cut them, else pieces in byte
        letters."""
        if text.isascii() or PLAIN.fullmatch(text):
            if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if not UNSPLIT.search(text):
                return text.split()
        return self.cut(text)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special tokens that are merged on their own."""
        if PLAIN.fullmatch(text):
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            return PIECES.findall(text.lower())
        return self.cut(text)

    def cut(self, text: str) -> list[_Cut]:
        """The library's pieces, in byte letters."""
        return [_Cut(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one piece, by merging the pair of least rank, leftmost first."""
        letters = word if isinstance(word, _Cut) else word.encode().decode("latin-1").translate(self.letters)
        parts = [*letters[:-1], letters[-1] + END]
        get, none = self.ranks.get, len(self.ranks)
        ranks = [get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return tuple(self.vocab[p] for p in parts)

    @cached_property
    def pairs(self) -> tuple | None:
        """For merging by numbers: sorted keys of pairs of ids and their ranks, the id
        that each rank makes, and the ids of byte letters inside and at the end. None if
        the vocabulary lacks some of these or gives a number twice."""
        needed = [*chain.from_iterable((c, c + END) for c in byte_letters().values()), *chain.from_iterable((a, b, a + b) for a, b in self.ranks)]
        if not self.vocab.keys() >= set(needed) or len(set(self.vocab.values())) < len(self.vocab):
            return None
        base = max(self.vocab.values()) + 2
        keys = np.array([self.vocab[a] * base + self.vocab[b] for a, b in self.ranks], np.int64)
        ranks = np.array(list(self.ranks.values()), np.int32)
        made = np.zeros(max(self.ranks.values(), default=0) + 1, np.int32)
        made[ranks] = [self.vocab[a + b] for a, b in self.ranks]
        order = np.argsort(keys)
        letters = np.zeros((2, 512), np.int32)
        for c in byte_letters().values():
            letters[:, ord(c)] = self.vocab[c], self.vocab[c + END]
        return base, np.append(keys[order], np.int64(-1)), np.append(ranks[order], 0), made, letters

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """merge() of each piece: in every round, each piece that still has a pair of some
        rank gets its least one merged, leftmost first."""
        out: list = [None] * len(words)
        groups: dict[int, list[tuple[int, str]]] = {}
        for i, word in enumerate(words):
            letters = word if isinstance(word, _Cut) else word.encode().decode("latin-1").translate(self.letters)
            if 0 < len(letters) <= SIDE_BY_SIDE and self.pairs:
                groups.setdefault((len(letters) + 3) // 4, []).append((i, letters))
            else:
                out[i] = list(self.merge(word))
        for group in groups.values():
            self._merge_group(group, out)
        return out

    def _merge_group(self, group: list[tuple[int, str]], out: list) -> None:
        base, keys, ranks_of, made, letters = self.pairs
        none = np.int32(np.iinfo(np.int32).max)

        def rank(a, b):
            key = a.astype(np.int64) * base + b
            at = np.searchsorted(keys[:-1], key)
            return np.where(keys[at] == key, ranks_of[at], none)

        owner = np.array([i for i, _ in group])
        sizes = np.array([len(t) for _, t in group])
        flat = np.frombuffer("".join(t for _, t in group).encode("utf-32-le"), np.uint32)
        width = int(sizes.max())
        ids = np.full((len(group), width), base - 1, np.int32)  # the last number is no id
        ids[np.arange(width) < sizes[:, None]] = letters[0][flat]
        ids[np.arange(len(group)), sizes - 1] = letters[1][flat[np.cumsum(sizes) - 1]]
        ranks = rank(ids[:, :-1], ids[:, 1:])
        while len(owner):
            width = ids.shape[1]
            if width > 1:
                at = ranks.argmin(axis=1)
                least = ranks[np.arange(len(owner)), at]
                more = least < none
            else:
                more = np.zeros(len(owner), bool)
            for i, n, row in zip(owner[~more].tolist(), sizes[~more].tolist(), ids[~more].tolist()):
                out[i] = row[:n]
            if not more.any():
                break
            owner, sizes, ids, ranks, at, least = owner[more], sizes[more] - 1, ids[more], ranks[more], at[more], least[more]
            rows, col = np.arange(len(owner)), np.arange(width - 1)
            ids = np.take_along_axis(ids, col + (col > at[:, None]), axis=1)
            ids[rows, at] = made[least]
            ranks = np.take_along_axis(ranks, col[:-1] + (col[:-1] >= at[:, None]), axis=1)
            left, right = at > 0, at < width - 2
            r, c = rows[left], at[left]
            ranks[r, c - 1] = rank(ids[r, c - 1], ids[r, c])
            r, c = rows[right], at[right]
            ranks[r, c] = rank(ids[r, c], ids[r, c + 1])

    def word(self, word: str) -> tuple[int, ...]:
        if self.lexicon is not None and not isinstance(word, _Cut):
            found = self.lexicon.get(word.encode())
            if found is not None:
                return found
        return self.merge(word)

    def sections(self, text: str) -> Iterator[tuple[bool, str]]:
        """(whether it is a special token, stretch of text) in order."""
        if self.marks is None or self.hint not in text:
            yield False, text
            return
        for i, part in enumerate(self.marks.split(text)):
            if part:
                yield bool(i % 2), part

    def parts(self, word: str) -> Iterator[tuple[int, ...]]:
        """The ids of each piece of one of words()."""
        return map(self.word, [word] if isinstance(word, _Cut) else PLAIN_PIECES.findall(word.lower()))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for special, part in self.sections(text):
            if special:
                out.append(self.added[part])
            else:
                for w in self.words(part):
                    out += chain.from_iterable(self.parts(w))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the file, tokens are joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


class _Cut(str):
    """A piece that is in byte letters already."""


def _ids_bytes(bpe: WordBpe, ids: Iterable[int]) -> bytes:
    return array("i", ids).tobytes()


def _ids_and_tokens(bpe: WordBpe, ids: Iterable[int]) -> tuple[str, str]:
    """The ids and the tokens as text."""
    return " ".join(map(str, ids)), bpe.decode(ids)


def _joined_bytes(parts: list[bytes]) -> bytes:
    return b"".join(parts)


def _joined_texts(parts: list[tuple[str, str]]) -> tuple[str, str]:
    if len(parts) == 2:
        (a, x), (b, y) = parts
        return f"{a} {b}", f"{x} {y}"
    ids, tokens = map(" ".join, zip(*parts))
    return ids, tokens


#: What a table keeps for a piece's ids, and how those of a word's pieces are put together.
KEPT = {"ids": (_ids_bytes, _joined_bytes), "texts": (_ids_and_tokens, _joined_texts)}


class _Memo(dict):
    """word or piece -> what is kept for its ids, worked out at first sight."""

    def __init__(self, bpe: WordBpe, kind: str):
        super().__init__()
        self.bpe = bpe
        self.made, self.joined = KEPT[kind]

    def of(self, word: str) -> list[str]:
        if isinstance(word, _Cut):
            return [word]
        low = word.lower()
        return [low] if low.isalpha() else PLAIN_PIECES.findall(low)  # letters alone are one piece

    def learn(self, words: Iterable[str]) -> None:
        """Enters all the words; merges those of their pieces that are new together."""
        words = set(words)
        fresh = words.difference(self)
        if len(self) + len(fresh) > MEMO_WORDS:
            kept = [(w, self[w]) for w in words if w not in fresh]
            self.clear()
            self.update(kept)
        cuts = {w: self.of(w) for w in fresh}
        bpe, made, joined = self.bpe, self.made, self.joined
        unknown, lexicon = [], bpe.lexicon
        for p in set(chain.from_iterable(cuts.values())).difference(self):
            found = None if lexicon is None or isinstance(p, _Cut) else lexicon.get(p.encode())
            if found is None:
                unknown.append(p)
            else:
                self[p] = made(bpe, found)
        for p, ids in zip(unknown, bpe.merge_all(unknown)):
            self[p] = made(bpe, ids)
        for w, pieces in cuts.items():
            if w not in self:
                self[w] = joined([self[p] for p in pieces])

    def __missing__(self, word: str):
        pieces = self.of(word)
        if pieces == [word]:
            got = self.made(self.bpe, self.bpe.word(word))
        else:
            got = self.joined([self[p] for p in pieces])
        self[word] = got
        return got


def _memo_for(words: list[str], plain, cut):
    """Byte letters may spell another word, so that cut pieces have a table of their own."""
    return cut if words and isinstance(words[0], _Cut) else plain


def _found(texts: list[str], bpe: WordBpe, plain: _Memo, cut: _Memo, memo_for) -> Iterator[Iterator[tuple[str | None, list]]]:
    """For each text, its sections in order: (special token, []) or (None, what the table
    keeps for some words). New words are learned for many texts at once, and for a long
    text by stretches, so that a table holds no more than MEMO_WORDS and those."""

    def of(sections):
        for special, part in sections:
            if special:
                yield part, []
                continue
            memo = memo_for(part, plain, cut)
            for lo in range(0, len(part), TEXT_WORDS):
                words = part[lo : lo + TEXT_WORDS] if len(part) > TEXT_WORDS else part
                if len(part) > TEXT_WORDS:
                    memo.learn(words)
                yield None, list(map(memo.__getitem__, words))

    lo = 0
    while lo < len(texts):
        hi, held = lo + 1, len(texts[lo])
        while hi < len(texts) and held + len(texts[hi]) <= TEXTS_CHARS:
            held += len(texts[hi])
            hi += 1
        group = [[(special, part if special else bpe.words(part)) for special, part in bpe.sections(t)] for t in texts[lo:hi]]
        short = [part for sections in group for special, part in sections if not special and len(part) <= TEXT_WORDS]
        for memo in (plain, cut):
            memo.learn(chain.from_iterable(words for words in short if memo_for(words, plain, cut) is memo))
        yield from map(of, group)
        lo = hi


def _tables(shared: tuple[str, bytes | None], kind: str) -> tuple:
    """(tokenizer, table of words, table of cut pieces, choice of a table, the walk over
    texts), kept by a worker process from task to task, so that it learns each word once.
    The functions are kept with them, as every task brings classes of its own."""
    held = worker_tables()
    key = (kind, *map(hash, shared))
    if held.get("key") != key:
        forget_tables()
        bpe = WordBpe(*shared)
        held["key"], held["tables"] = key, (bpe, _Memo(bpe, kind), _Memo(bpe, kind), _memo_for, _found)
    return held["tables"]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """w, n: how often each word of up to 24 letters is found in all documents."""
    words = F.explode(F.split(F.lower(F.col(text_col)), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"))
    return docs.select(words.alias("w")).where(F.length("w").between(1, 24)).groupBy("w").agg(F.count("*").alias("n"))


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """w: the words seen most often over all documents, whole classes of like counts at
    a time, at most ``most`` of them. The driver gets the sizes of the classes."""
    counts = word_counts(docs, text_col).where("n > 1")
    classed = materialise(counts.select("w", F.floor(F.log2("n") * 16).cast("int").alias("class")))
    least, total = 1 << 30, 0
    for r in sorted(classed.groupBy("class").agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r["n"]
        if total > most:
            break
        least = r["class"]
    return classed.where(F.col("class") >= least).select("w")


def compile_words(spec: str, words: Iterable[str]) -> bytes:
    """Compiles words into a transducer; those that the tokenizer cuts are left out."""
    bpe = WordBpe(spec)
    entries = {}
    for w in words:
        if PLAIN.fullmatch(w) and (cut := bpe.pieces(w)) and cut == [w]:
            entries[w.encode()] = bpe.merge(w)
    return Transducer.compile(entries)


def build_lexicon(spec: str, words: DataFrame) -> bytes:
    """The transducer of words(w), which one task compiles: they are LEXICON_WORDS at
    most. The driver gets its bytes only."""
    import pyarrow as pa

    def run(batches):
        image = compile_words(spec, chain.from_iterable(b.column("w").to_pylist() for b in batches))
        yield pa.RecordBatch.from_arrays([pa.array([image], pa.binary())], names=["image"])

    return bytes(words.repartition(1).mapInArrow(run, "image binary").first()["image"])


def _texts(batch, column: str) -> list[str]:
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def _slices(batches, rows: int = 500):
    """Batches in slices of a few hundred rows, so that a task holds no more ids at once."""
    for whole in batches:
        for lo in range(0, whole.num_rows, rows):
            yield whole.slice(lo, rows)


def _prepare(docs: DataFrame, tokenizer: str, text_col: str, lexicon_words: int):
    sc = docs.sparkSession.sparkContext
    spec = Path(tokenizer).read_text(encoding="utf-8")
    lexicon = build_lexicon(spec, frequent_words(docs, text_col, lexicon_words)) if lexicon_words else None
    return sc.broadcast((spec, lexicon))  # a few MB: the vocabulary and at most lexicon_words words


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """id_col, ids array<int>, n_tokens: the ids of every whole text.

    A null or empty text has no ids. Rows are independent: null or repeated ids and
    repeated rows are kept as they are. An empty table gives no rows. Other columns
    aren't read.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    shared = _prepare(docs, tokenizer, text_col, lexicon_words)

    def run(batches):
        *tables, found = _tables(shared.value, "ids")
        bpe = tables[0]
        for batch in _slices(batches):
            ids, ends = bytearray(), [0]
            for sections in found(_texts(batch, "text"), *tables):
                for special, known in sections:
                    ids += b"".join(known) if special is None else array("i", [bpe.added[special]]).tobytes()
                ends.append(len(ids) // 4)
            offsets = pa.array(ends, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(ids)]))
            n = pc.cast(pc.subtract(offsets[1:], offsets[:-1]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, n], names=["id", "ids", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, text: decodes every list of ids. A null list gives an empty text."""
    import pyarrow as pa

    shared = encoded.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def run(batches):
        bpe = WordBpe(shared.value)
        for batch in _slices(batches):
            texts = [bpe.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)


def digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of every whole text, without moving
    the ids out of the task. Cases as in encode()."""
    import pyarrow as pa

    shared = _prepare(docs, tokenizer, text_col, lexicon_words)

    def run(batches):
        *tables, found = _tables(shared.value, "texts")
        bpe = tables[0]
        sha = hashlib.sha256
        for batch in _slices(batches):
            n, first, second = [], [], []
            for sections in found(_texts(batch, "text"), *tables):
                numbers: list[str] = []
                tokens: list[str] = []
                for special, known in sections:
                    if special is not None:
                        numbers.append(str(bpe.added[special]))
                        tokens.append(special)
                    elif known:
                        a, b = zip(*known)
                        numbers += a
                        tokens += b
                ids = " ".join(numbers)
                n.append(ids.count(" ") + 1 if ids else 0)
                first.append(sha(ids.encode()).hexdigest())
                second.append(sha(" ".join(tokens).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
