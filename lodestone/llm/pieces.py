"""SentencePiece encoding and decoding in numpy batches.

Texts become units: a run of spaces and what follows it up to the next space (no piece holds a space after another
character, so no piece crosses units). Distinct units of one length are rows of a matrix that advance together. Hashes of
all their substrings up to the longest piece probe the sorted hashes of the pieces, which gives a table of scores by start
and length. Then

* a unigram model takes vectorised Viterbi maxima over the table, with backpointers;
* a BPE model merges, in all rows at once, the adjacent pair with the highest score, leftmost first: the highest sum of
  scores is not what a BPE model means, and Viterbi would not give its ids.

Ids of BPE models, and of unigram models with scores of their own, equal those of the sentencepiece library, in ties too: the
longest last piece wins, and sums have 32 bits. For the unigram model that ``sentencepiece_unigram`` makes of BPE pieces the
library's plain encoding has a lower sum for some words; the ids here have the highest one. Units are
scored on their own, so that no sum grows with a text and rounds. A task remembers the ids of up to UNITS distinct units.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNITS = 400_000
#: Longer units are merged one by one with a heap (BPE) or on their own (unigram).
LONG = 48
#: Characters of text handled at once.
STRETCH = 2_000_000
_UNIGRAM, _BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class Model:
    """The pieces of a SentencePiece model: normal ones by hash, byte pieces, and how text is split."""

    def __init__(self, raw: bytes):
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        top = list(_fields(raw))
        trainer, normalizer = (dict(_fields(next((v for k, v in top if k == n), b""))) for n in (2, 3))
        self.kind = trainer.get(3, _UNIGRAM)
        if self.kind not in (_UNIGRAM, _BPE) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only BPE and unigram models with a dummy prefix and without normalisation are supported")
        if any(k == 1 and dict(_fields(v)).get(3, 1) == 4 for k, v in top):
            raise ValueError("user-defined pieces are not supported")
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(n)]
        self.unknown = sp.unk_id()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.bytes = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.scores = np.array([sp.get_score(i) for i in range(n)], np.float32).astype(float)
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece holds a space after another character")
        self.longest = max(map(len, self.ids))
        # No piece of several characters holds these, so they stand alone: units are cut around all other characters.
        self.joining = set(chain.from_iterable(p for p in self.ids if len(p) > 1))
        self.powers = np.cumprod(np.full(LONG + 1, 0x9E3779B97F4A7C15, np.uint64))
        names = list(self.ids)
        keys = np.empty(len(names), np.uint64)
        for length in {len(p) for p in names}:
            own = [i for i, p in enumerate(names) if len(p) == length]
            keys[own] = self._spans(self._prefix(self._codes([names[i] for i in own])), length)[:, 0]
        order = np.argsort(keys)
        self.keys, self.of = keys[order], np.array(list(self.ids.values()))[order]
        self.some = np.zeros(1 << 20, bool)  # leading bits that any piece's hash has: most substrings stop here
        self.some[keys >> np.uint64(44)] = True
        flat = [bytes([b]) if (b := {i: k for k, i in self.bytes.items()}.get(i)) is not None else " ⁇ ".encode() if i == self.unknown else b"" if i in special else p.encode() for i, p in enumerate(self.pieces)]
        self.piece_size = np.array([len(b) for b in flat])
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.flat = np.frombuffer(b"".join(flat), np.uint8)

    def _prefix(self, codes):
        import numpy as np

        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        mixed ^= mixed >> np.uint64(29)
        np.cumsum(mixed * self.powers[: codes.shape[1]], axis=1, out=out[:, 1:])
        return out

    def _spans(self, prefix, length: int):
        """Hashes of all substrings of one length by start, the same wherever they stand."""
        import numpy as np

        x = (prefix[:, length:] - prefix[:, : prefix.shape[1] - length]) * self.powers[LONG - np.arange(prefix.shape[1] - length)]
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length)

    @staticmethod
    def _codes(units: list[str]):
        import numpy as np

        return np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(len(units), -1)

    def table(self, units: list[str]):
        """For units of one length: (row, start, length) tables of piece ids (-1: none) and scores."""
        import numpy as np

        n, size = len(units), len(units[0])
        prefix = self._prefix(self._codes(units))
        ids = np.full((n, size, min(size, self.longest) + 1), -1, np.int32)
        for length in range(1, ids.shape[2]):
            key = self._spans(prefix, length)
            row, start = np.nonzero(self.some[key >> np.uint64(44)])
            key = key[row, start]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ids[row, start, length] = np.where(self.keys[at] == key, self.of[at], -1)
        return ids, np.where(ids >= 0, self.scores[ids], -np.inf)

    def encode_units(self, units: list[str]):
        """(ids of all units, where each unit's begin, how many it has) as arrays."""
        import numpy as np

        flat, start, size, used = [], np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), 0
        by_length: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by_length.setdefault(len(u), []).append(i)
        for length, rows in by_length.items():
            step = max(1, 200_000 // (length * min(length, self.longest)))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                own = [units[i] for i in some]
                if length > LONG:
                    found = [self._long(u) for u in own]
                    ids, sizes = np.array([x for f in found for x in f], np.int32), np.array([len(f) for f in found])
                else:
                    table, scores = self.table(own)
                    ends = self._viterbi(scores) if self.kind == _UNIGRAM else self._merge(scores)
                    ids, sizes = self._collect(own, table, ends)
                start[some], size[some] = used + np.cumsum(sizes) - sizes, sizes
                flat.append(ids)
                used += len(ids)
        return np.concatenate(flat) if flat else np.empty(0, np.int32), start, size

    def _collect(self, units: list[str], table, ends):
        """Ids of all rows in order, and how many each has; characters that are no piece become their bytes or unknown."""
        import numpy as np

        row, a = np.nonzero(ends)
        ids = table[row, a, ends[row, a] - a]
        if (ids < 0).any():
            lists = [[int(i)] if i >= 0 else self._unknown(units[r][c]) for r, c, i in zip(row, a, ids)]
            row = np.repeat(row, [len(x) for x in lists])
            ids = np.array([x for y in lists for x in y], np.int32)
        return ids, np.bincount(row, minlength=len(units))

    def _unknown(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def _viterbi(self, scores):
        """Ends by start of each row's best segmentation: maxima over the last piece, with backpointers."""
        import numpy as np

        n, size, most = scores.shape
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int64)
        none = self._none()
        for end in range(1, size + 1):
            # The longest last piece comes first and wins ties; sums are kept in 32 bits: so does the library.
            for k in range(min(end, most - 1), 0, -1):
                s = scores[:, end - k, k]
                option = best[:, end - k] + (np.where(np.isinf(s), none, s) if k == 1 else s)
                more = option > best[:, end]
                best[more, end], back[more, end] = option[more].astype(np.float32), end - k
        ends = np.zeros((n, size), np.int64)
        at = np.full(n, size)
        while (live := np.flatnonzero(at > 0)).size:
            start = back[live, at[live]]
            ends[live, start] = at[live]
            at[live] = start
        return ends

    def _none(self) -> float:
        """The score of a character that is no piece."""
        import numpy as np

        return float(np.float32(self.scores[list(self.ids.values())].min()) - np.float32(10))

    def _merge(self, scores):
        """Ends by start of each row's symbols when no adjacent pair is a piece any more."""
        import numpy as np

        n, size, most = scores.shape
        ends = np.tile(np.arange(1, size + 1), (n, 1))
        if size < 2:
            return ends
        start = np.arange(size)
        live = np.arange(n)
        while len(live):
            e = ends[live]
            after = np.where((e > 0) & (e < size), np.take_along_axis(e, np.minimum(e, size - 1), 1), 0)
            span = after - start
            pair = np.where((after > 0) & (span < most), scores[live[:, None], start[None, :], np.clip(span, 0, most - 1)], -np.inf)
            at = pair.argmax(1)
            ok = pair[np.arange(len(live)), at] > -np.inf
            live, at, e, after = live[ok], at[ok], e[ok], after[ok]
            old = e[np.arange(len(live)), at]
            ends[live, at] = after[np.arange(len(live)), at]
            ends[live, old] = 0
        return ends

    def _long(self, unit: str) -> list[int]:
        """One long unit: the same result in time near its length."""
        if self.kind == _UNIGRAM:
            import numpy as np

            none = self._none()
            best, back = [0.0] + [-float("inf")] * len(unit), [0] * (len(unit) + 1)
            for end in range(1, len(unit) + 1):
                for a in range(max(0, end - self.longest), end):
                    i = self.ids.get(unit[a:end])
                    s = self.scores[i] if i is not None else none if a == end - 1 else None
                    if s is not None and best[a] + s > best[end]:
                        best[end], back[end] = float(np.float32(best[a] + s)), a
            cuts, at = [], len(unit)
            while at:
                cuts.append((back[at], at))
                at = back[at]
            parts = [unit[a:b] for a, b in reversed(cuts)]
        else:
            import heapq

            parts = list(unit)
            left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
            heap: list[tuple] = []

            def offer(a: int, b: int) -> None:
                if a >= 0 and b >= 0 and (i := self.ids.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-self.scores[i], a, b, parts[a] + parts[b]))

            for i in range(len(parts) - 1):
                offer(i, i + 1)
            while heap:
                _, a, b, joined = heapq.heappop(heap)
                if right[a] != b or not parts[a] or not parts[b] or parts[a] + parts[b] != joined:
                    continue
                parts[a], parts[b] = joined, ""
                right[a] = right[b]
                if right[b] >= 0:
                    left[right[b]] = a
                offer(left[a], a)
                offer(a, right[a])
            parts = [p for p in parts if p]
        return [x for p in parts for x in ([self.ids[p]] if p in self.ids else [y for c in p for y in self._unknown(c)])]


class Codec:
    """Encodes and decodes lists of texts."""

    def __init__(self, raw: bytes):
        import re

        import numpy as np

        self.model = Model(raw)
        self.place: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.spaces = re.compile(" +[^ ]*")
        alone = "".join(sorted(self.model.joining))
        self.cuts = re.compile(f"[{re.escape(alone)}]+|[^{re.escape(alone)}]")

    def units(self, text: str) -> list[str]:
        """``text`` with a space put before it, in units."""
        text = text.replace("▁", " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return self.spaces.findall(" " + text)
        return [" " + x for x in text.split(" ")]

    def learn(self, units: set[str]) -> None:
        import numpy as np

        new = [u for u in units if u not in self.place]
        if len(self.place) + len(new) > UNITS and self.place:
            self.place.clear()
            self.flat, self.start, self.size = self.flat[:0], self.start[:0], self.size[:0]
            new = list(units)
        if not new:
            return
        split = [self.cuts.findall(u) for u in new]
        parts = list(dict.fromkeys(chain.from_iterable(split)))
        index = dict(zip(parts, range(len(parts))))
        flat, start, size = self.model.encode_units(parts)
        whole = np.fromiter((index[s[0]] for s in split), np.int64, len(split))
        starts, sizes, more, used = start[whole], size[whole], [], len(flat)
        for i, s in enumerate(split):
            if len(s) > 1:
                own = np.concatenate([flat[start[j] : start[j] + size[j]] for j in map(index.__getitem__, s)])
                starts[i], sizes[i] = used, len(own)
                more.append(own)
                used += len(own)
        self.start = np.concatenate([self.start, len(self.flat) + starts])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, flat, *more])
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))

    def ids_of(self, units: list[str]):
        import numpy as np

        at = np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))
        n = self.size[at]
        ends = np.cumsum(n)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[at] - (ends - n), n)]
        if not self.model.bytes:  # neighbouring unknown characters are one unknown piece
            ids = ids[~((ids == self.model.unknown) & (np.roll(ids, 1) == self.model.unknown) & (np.arange(len(ids)) > 0))]
        return ids

    def encode(self, texts: list[str | None]) -> list:
        """int32 arrays of ids; None for None."""
        split, out, held = [], [], 0

        def flush() -> None:
            nonlocal held
            self.learn(set().union(*(s for s in split if s)))
            out.extend(None if s is None else self.ids_of(s) for s in split)
            split.clear()
            held = 0

        for text in texts:
            split.append(self.units(text) if text else None if text is None else [])
            held += len(text or "")
            if held > STRETCH:
                flush()
        flush()
        return out

    def decode(self, lists: list) -> list[str | None]:
        import numpy as np

        out: list[str | None] = []
        m = self.model
        for ids in lists:
            if ids is None:
                out.append(None)
                continue
            ids = np.asarray(ids, np.int64)
            n = m.piece_size[ids]
            ends = np.cumsum(n)
            raw = m.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(m.piece_at[ids] - (ends - n), n)].tobytes()
            out.append((raw[1:] if raw[:1] == b" " else raw).decode(errors="replace"))
        return out


def _mapper(raw: bytes, source: str, target: str, names: list[str], decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec = Codec(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                column = some.column(source)
                if decode:
                    new = pa.array(codec.decode([x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in column]), pa.string())
                else:
                    lists = codec.encode(column.to_pylist())
                    sizes = [0 if x is None else len(x) for x in lists]
                    offsets = pa.array([*np.cumsum([0, *sizes])], pa.int32(), mask=np.array([*(x is None for x in lists), False]))
                    whole = [x for x in lists if x is not None and len(x)]
                    new = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(whole) if whole else np.empty(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), new], [*names, target])

    return run


def _with(docs: DataFrame, raw: bytes, source: str, target: str, kind: T.DataType, decode: bool) -> DataFrame:
    kept = docs if source == target else docs.drop(target)
    names = [c for c in kept.columns if c != target]
    if source == target:
        kept = kept.withColumnRenamed(source, "__source")
    rows = kept.select(*[F.col(f"`{c}`") for c in names], *([] if source in names else ["__source"]))
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(target, kind)])
    return rows.mapInArrow(_mapper(raw, source if source in names else "__source", target, names, decode), schema)


def encode(docs: DataFrame, model: bytes, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (array<int>), the library's ids of the whole text; a column of that name is replaced.

    ``model`` is the content of a SentencePiece file. Empty text has no ids, null text null; every row keeps its other columns.
    """
    return _with(docs, model, text, ids, T.ArrayType(T.IntegerType()), False)


def decode(docs: DataFrame, model: bytes, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text that ``ids`` stand for (null for null). Encoding and decoding give the same text back, but for
    U+2581, which the model cannot tell from a space."""
    return _with(docs, model, ids, text, T.StringType(), True)


def unigram_model(raw: bytes) -> bytes:
    """The model with the same pieces and scores read as a unigram model: the highest sum of scores decides."""

    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    def message(fields: list) -> bytes:
        # Integers stay, four bytes are a float (5), all else is a string (2): what a model's file has.
        return b"".join(varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 5) + v if floats else varint(n << 3 | 2) + varint(len(v)) + v for n, v, floats in fields)

    out = []
    for number, value in _fields(raw):
        if number == 2:
            out.append((2, message([(n, _UNIGRAM if n == 3 else v, False) for n, v in _fields(value) if isinstance(v, int)]), False))
        else:
            out.append((number, value, False))
    return message(out)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        raw = f.read()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = decode(encode(docs, raw), raw)
    joined = F.array_join("ids", " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def sentencepiece_unigram(spark, sf_dir: str) -> DataFrame:
    """The same pieces by Viterbi, over whole documents: the ids with the highest sums of scores, which differ from op5's."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        raw = unigram_model(f.read())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = decode(encode(docs, raw), raw)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
