"""Packing documents into training sequences by minimum bin slack.

Each input partition packs its own documents, so nothing is shuffled. Texts become ids once; full windows of a long document
go out as they are, and remainders wait by length. A window starts with the longest remainder; a bitset subset-sum (bit s is
set if some multiset of the waiting lengths adds up to s) finds the sum closest to the room left, and backtracking through
the bitsets gives the counts. Where no multiset fits exactly, one remainder is cut. A partition's last, shorter window
becomes sequences of powers of two, so that nothing is padded.

Memory is bounded by BUFFER waiting ids, whatever the size of a partition. Partitions read from files are the same on every
attempt, and so are their sequences.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
#: Ids that wait to be packed at most (4 bytes each), and down to which a full buffer is packed.
BUFFER, REST = 3_000_000, 300_000
#: Distinct words whose ids are remembered in a task.
WORDS = 500_000
#: Bytes of text that are split at once.
STRETCH = 2_000_000


def choose(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum comes closest to ``room`` without passing it."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if 0 < x <= room and counts[x] > 0), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:  # multiples in powers of two, so that counts cost their logarithm
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            times *= 2
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + take
            at -= length * take
    return found


class Packer:
    """Turns documents' ids into pieces (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.waiting: dict[int, deque] = {}
        self.counts: dict[int, int] = {}
        self.size = 0
        self.out: list[tuple] = []

    def _wait(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.waiting.setdefault(n, deque()).append(piece)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.size += n

    def _take(self, n: int) -> tuple:
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.counts[n]
        self.size -= n
        return self.waiting[n].popleft()

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, self.next, at))
            at += len(ids) // 4
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total, step = len(ids) // 4, self.capacity * 4
        whole = total // self.capacity * step
        for a in range(0, whole, step):
            self._emit([(doc, a // 4, ids[a : a + step], total)])
        if whole < len(ids):
            self._wait((doc, whole // 4, ids[whole:], total))

    def pack(self, rest: int) -> None:
        """Fills windows until at most ``rest`` ids wait; fewer than a window's are left alone."""
        while self.size > rest and self.size >= self.capacity:
            longest = max(self.counts)
            self.counts[longest] -= 1
            chosen = choose(self.counts, self.capacity - longest)
            self.counts[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            slack = self.capacity - sum(k * n for k, n in chosen.items())
            # The same counts fill further windows; but filling up takes other pieces, so they are counted anew then.
            for _ in range(1 if slack else min(self.counts[k] // n for k, n in chosen.items())):
                if self.size < self.capacity:
                    break
                pieces = [self._take(k) for k, n in chosen.items() for _ in range(n)]
                if slack:
                    pieces += self._fill(slack)
                self._emit(pieces)

    def _fill(self, slack: int) -> list[tuple]:
        """Pieces for the room that no multiset fills: whole ones while they fit, then one that is cut."""
        out = []
        while slack and self.counts:
            n = min((k for k in self.counts if k >= slack), default=None) or max(self.counts)
            doc, start, ids, total = self._take(n)
            out.append((doc, start, ids[: slack * 4], total))
            if n > slack:
                self._wait((doc, start + slack, ids[slack * 4 :], total))
            slack -= min(n, slack)
        return out

    def finish(self) -> None:
        self.pack(0)
        room = self.size
        while room:  # the rest: sequences of falling powers of two
            size = 1 << (room.bit_length() - 1)
            pieces = [self._take(k) for k, n in choose(dict(self.counts), size).items() for _ in range(n)]
            self._emit(pieces + self._fill(size - sum(len(p[2]) // 4 for p in pieces)))
            room -= size


#: The normalizer and pre-tokenizer for which a text's ids are those of its words in turn, and words of letters and marks those
#: of two lower-cased units; files with any others are encoded text by text.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def by_word(path: str) -> bool:
    """Whether ids may be looked up word by word: decided by what the tokenizer's file says."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = all(not re.search(r"\s", t["content"]) and not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") for t in spec.get("added_tokens", []))
    model = spec["model"]
    return plain and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and all(spec.get(k) == v for k, v in _BY_WORD.items())


def _text_ids(path: str):
    """A function from texts to their ids, for any tokenizer."""
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation(), tokenizer.no_padding()

    def encode(texts: list[bytes | None]) -> list:
        found = tokenizer.encode_batch_fast([(t or b"").decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    return encode


def _word_ids(path: str):
    """A function from texts to their ids, with one lookup for each word.

    The tokenizer drops white space and never joins what white space parts, so a text's ids are those of its words in turn.
    """
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    place: dict[bytes, int] = {}
    letters: dict[str, list[int]] = {}
    # Latin letters whose lower case is one letter and which never combine, then marks without an apostrophe.
    simple = re.compile("([A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch
    # The model's alphabet: a printable byte is its own character, the others follow from 256 on in turn.
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    alphabet = {b: chr(b if b in own else next(rest)) for b in range(256)}
    flat, start, size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(words: set[bytes]) -> None:
        """Makes room for the ids of ``words``; what was learned before may be forgotten."""
        nonlocal flat, start, size
        new = {w for w in words if w not in place}
        if len(place) + len(new) > WORDS and place:
            place.clear(), letters.clear()
            flat, start, size = flat[:0], start[:0], size[:0]
            new = words
        plain, other, ids = [], [], []
        for w in new:  # letters, then marks: two units for the model, without the rest of the machinery
            if (m := simple(w.decode())) is None:
                other.append(w)
                continue
            head, tail = m.groups()
            if (found := letters.get(head)) is None:
                head_bytes = head.lower().encode()
                found = letters[head] = [t.id for t in model.tokenize(head_bytes.decode("latin-1").translate(alphabet))]
            if tail:
                if (marks := letters.get(tail)) is None:
                    marks = letters[tail] = [t.id for t in model.tokenize(tail)]
                found = found + marks
            plain.append(w)
            ids.append(found)
        for at in range(0, len(other), 20_000):
            ids += [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in other[at : at + 20_000]], add_special_tokens=False)]
        if ids:
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            start = np.concatenate([start, len(flat) + np.cumsum(lengths) - lengths])
            size, flat = np.concatenate([size, lengths]), np.concatenate([flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))])
            place.update(zip(chain(plain, other), range(len(place), len(place) + len(ids))))

    def stretches(text: bytes) -> Iterator[list[bytes]]:
        while len(text) > STRETCH:
            cut = next((i for i in range(STRETCH, len(text)) if text[i : i + 1].isspace()), len(text))
            yield text[:cut].split()
            text = text[cut:]
        yield text.split()

    def encode(words: list[bytes]):
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        n = size[at]
        ends = np.cumsum(n)
        return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[at] - (ends - n), n)]

    def all_of(texts: list[bytes | None]) -> list:
        short = [t.split() if t and len(t) <= STRETCH else [] for t in texts]
        learn(set().union(*short))
        ready = [encode(words) for words in short]
        for i, text in enumerate(texts):
            if text and len(text) > STRETCH:
                own = []
                for words in stretches(text):
                    learn(set(words))
                    own.append(encode(words))
                ready[i] = np.concatenate(own)
        return ready

    return all_of


def _parts(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most STRETCH bytes together, and 512 texts; a longer text is one of its own."""
    first = held = 0
    for i, t in enumerate(texts):
        size = len(t or b"")
        if i > first and (held + size > STRETCH or i - first == 512):
            yield first, i
            first, held = i, 0
        held += size
    if first < len(texts):
        yield first, len(texts)


def _pack(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import numpy as np
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        encode = _word_ids(path) if by_word(path) else _text_ids(path)
        last = np.array([end], "<u4")

        def drain(least: int) -> Iterator[pa.RecordBatch]:
            while len(packer.out) > least:
                some, packer.out = packer.out[:1000], packer.out[1000:]
                doc, start, ids, total, sequence, offset = zip(*some)
                columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in _parts(texts):
                for doc, ids in zip(docs[a:b], encode(texts[a:b])):
                    packer.add(doc, np.concatenate([ids, last]).astype("<u4").tobytes())
                    if packer.size > BUFFER:
                        packer.pack(REST)
                    yield from drain(1000)
        packer.finish()
        yield from drain(0)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, *, end: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document's ids are those of ``tokenizer`` (any file of the tokenizers library, on every machine; without special tokens
    added) and then ``end``; where the file's rules allow it, they are looked up word by word. Each id lies in exactly one piece; ``ids`` holds them as little-endian unsigned 32-bit numbers.
    Sequences have ``capacity`` ids, but for those of a power of two at the end of each input partition; offsets in them are
    gapless from 0. Null or empty text is ``end`` alone, a null doc_id stays null, repeated rows are packed each, other
    columns are left out. An empty table gives no sequences.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(_pack(tokenizer, end, capacity), schema)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
