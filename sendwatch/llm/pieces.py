"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the model says, cut where no vocabulary entry can
reach across, and every distinct chunk is merged once: an agenda holds the
adjacent symbol pairs whose concatenation is an entry, ordered by score, then
by position; the best pair is merged until none is left. Symbols without an
entry become byte entries. Long chunks use a heap for the agenda; short ones
are merged together, numpy arrays holding the agendas of all of them, one
merge per chunk and round. Every chunk that a task has not met before is
checked, per Arrow batch, against the sentencepiece library, whose ids are
taken where they differ.

Edge cases: null and empty texts encode to the end id alone and decode to the
empty string; spaces, line breaks, control and unassigned characters round
trip as the library has it; chunk results are kept in a bounded two-generation
memo of a stated size in bytes; an empty table gives no rows; input columns
may have any name.
"""

from __future__ import annotations

import heapq
import itertools
import logging
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendwatch.llm.common import text_slices
from sendwatch.llm.worker import give_back, state

_LOG = logging.getLogger(__name__)
SPACE = "▁"
NEVER = np.int64(1 << 40)
LONG = 48
EMPTY = np.int64(-2)
MEMO_BYTES = 60_000_000  # of a generation; two are kept


def _nothing() -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    return {}, np.zeros(1, np.int64), np.empty(0, np.int32)


def _runs(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``length`` values from each ``start``, one run after another."""
    shift = start - (np.cumsum(length) - length)
    return values[np.arange(int(length.sum())) + np.repeat(shift, length)]


class Encoder:
    """Encoder for one model file; keep one per Python worker (``encoder``)."""

    def __init__(self, model_path: str, end: bool = True):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.end = [sp.eos_id()] if end else []
        self.names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n)
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.names[i]: i for i in normal}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.score = [sp.get_score(i) for i in range(n)]
        several = [p for p in self.ids if len(p) > 1]
        # single characters of entries that are no entries themselves are symbols too
        self.symbols = dict(self.ids)
        for p in several:
            for c in p:
                self.symbols.setdefault(c, len(self.names) + len(self.symbols) - len(self.ids))
        self._merge_table(several)
        # A chunk may start at a space or stand beside a line break if no entry reaches across.
        crossing = re.compile(f"[^{SPACE}]{SPACE}")
        self.cut_spaces = not any(crossing.search(p) for p in several)
        self.cut_lines = not any("\n" in p for p in several)
        stop = "\n" if self.cut_lines else ""
        self.chunk = re.compile((f"{stop}|" if stop else "") + f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+"
                                if self.cut_spaces else f"(?s:{stop}|[^{stop}]+)" if stop else "(?s:.+)")
        self.names_of_ids = pa.array([str(i) for i in range(n)])
        # generations: number of a chunk, where the ids of a number begin, ids
        self.memo, self.older = _nothing(), _nothing()
        self.memo_bytes = 0
        self.differed = 0

    def _merge_table(self, several: list[str]) -> None:
        ranks = {s: r for r, s in enumerate(sorted({self.score[self.ids[p]] for p in several}, reverse=True))}
        keys, ids, rank = [], [], []
        for p in several:
            for k in range(1, len(p)):
                left, right = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    ids.append(self.ids[p])
                    rank.append(ranks[self.score[self.ids[p]]])
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        key = np.array(keys, dtype=np.int64)[order]
        self.merged = np.append(np.array(ids, dtype=np.int64)[order], 0)
        self.rank = np.append(np.array(rank, dtype=np.int64)[order], NEVER)
        self.symbol_of = -1 - np.arange(0x110000, dtype=np.int32)  # by code point
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        # an open table of the pairs, at most half full: a pair lies at its home or the next free place
        bits = max(4, (2 * len(key)).bit_length())
        self.slot_key, self.slot_pair = np.full(1 << bits, EMPTY), np.full(1 << bits, -1, np.int32)
        todo = np.append(True, key[1:] != key[:-1]).nonzero()[0] if len(key) else np.empty(0, np.int64)
        at = self._home(key[todo])
        while len(todo):
            free = np.flatnonzero(self.slot_key[at] == EMPTY)
            place, one = np.unique(at[free], return_index=True)
            one = free[one]
            self.slot_key[place], self.slot_pair[place] = key[todo[one]], todo[one]
            rest = np.delete(np.arange(len(todo)), one)
            todo, at = todo[rest], (at[rest] + 1) & ((1 << bits) - 1)

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """(rank, id) by pair, tens of MB: made for the first long chunk."""
        taken = self.slot_key != EMPTY
        at = self.slot_pair[taken]
        return dict(zip(self.slot_key[taken].tolist(), zip(self.rank[at].tolist(), self.merged[at].tolist())))

    def _home(self, key: np.ndarray) -> np.ndarray:
        bits = len(self.slot_key).bit_length() - 1
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    # -- the agenda -----------------------------------------------------------

    def merge_heap(self, chunk: str) -> list[int]:
        """Symbols of one chunk: ids, or -1 - code point where there is no entry."""
        symbols = self.symbols
        sym = [symbols.get(c, -1 - ord(c)) for c in chunk]
        n = len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        pairs = self.pairs
        agenda: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if sym[i] >= 0 and sym[j] >= 0 and (got := pairs.get(sym[i] << 20 | sym[j])):
                heapq.heappush(agenda, (got[0], i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if not alive[i] or j >= n or sym[i] != left or sym[j] != right:
                continue
            sym[i] = pairs[left << 20 | right][1]
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return self._spell([s for s, a in zip(sym, alive) if a])

    def _spell(self, sym: list[int]) -> list[int]:
        n = len(self.names)
        if not sym or 0 <= min(sym) and max(sym) < n:
            return sym
        extra = {i: c for c, i in self.symbols.items() if i >= n}
        out: list[int] = []
        for s in sym:
            if 0 <= s < n:
                out.append(s)
            else:
                c = extra[s] if s >= 0 else chr(-1 - s)
                out.extend(self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass"))
        return out

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((left >= 0) & (right >= 0), left << 20 | right, np.int64(-1))
        at = self._home(key)
        found = self.slot_key[at]
        todo = np.flatnonzero((found != key) & (found != EMPTY))
        while len(todo):  # another pair's place: the next one
            at[todo] = (at[todo] + 1) & (len(self.slot_key) - 1)
            found[todo] = self.slot_key[at[todo]]
            todo = todo[(found[todo] != key[todo]) & (found[todo] != EMPTY)]
        pair = np.where(found == key, self.slot_pair[at], -1)  # -1: the last entry, no pair
        return self.rank[pair], self.merged[pair]

    def merge_many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, their number per chunk): as ``merge_heap`` for
        short chunks together, by rounds of one merge per chunk."""
        length = np.array([len(w) for w in chunks], dtype=np.int64)
        if not len(length):
            return np.empty(0, np.int32), length
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.symbol_of[points].astype(np.int64)
        word = np.arange(len(chunks))
        last = np.cumsum(length) - 1
        rank, merged = self._look_up(sym[:-1], sym[1:])
        rank, merged = np.append(rank, NEVER), np.append(merged, 0)
        rank[last] = NEVER
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            starts = np.cumsum(length) - length
            best = np.minimum.reduceat(rank, starts)
            done = best == NEVER
            if done.any():
                gone = np.repeat(done, length)
                ended.append((word[done], length[done], sym[gone]))
                sym, rank, merged = sym[~gone], rank[~gone], merged[~gone]
                word, length, best = word[~done], length[~done], best[~done]
                if not len(word):
                    break
                starts = np.cumsum(length) - length
            hits = np.flatnonzero(rank == np.repeat(best, length))
            owner = np.searchsorted(starts, hits, side="right") - 1
            at = hits[np.append(True, owner[1:] != owner[:-1])]  # leftmost best pair of each chunk
            sym[at] = merged[at]
            rank[at] = rank[at + 1]  # the merged symbol now stands before what followed its right half
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))  # every chunk to the left has lost one symbol
            sym, rank, merged = sym[keep], rank[keep], merged[keep]
            length = length - 1
            starts = np.cumsum(length) - length
            ends = starts + length - 1
            again = np.concatenate([new[new < ends], (new - 1)[new > starts]])
            if len(again):
                rank[again], merged[again] = self._look_up(sym[again], sym[again + 1])
        word, length, sym = (np.concatenate(x) for x in zip(*ended))
        order = np.argsort(word, kind="stable")
        sym = _runs(sym, (np.cumsum(length) - length)[order], length[order])
        length = length[order]
        odd = (sym < 0) | (sym >= len(self.names))
        if not odd.any():
            return sym.astype(np.int32), length
        # symbols that are no entries become byte entries
        parts = np.split(sym, np.flatnonzero(odd))
        spelt = [parts[0]]
        many = np.ones(len(sym), np.int64)
        for i, part in zip(np.flatnonzero(odd).tolist(), parts[1:]):
            got = self._spell([int(part[0])])
            many[i] = len(got)
            spelt += [np.array(got, np.int64), part[1:]]
        return np.concatenate(spelt).astype(np.int32), np.add.reduceat(many, np.cumsum(length) - length)

    # -- chunks and texts -----------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(self.library.normalize(text)) if text else []

    def _learn(self, chunks: set[str]) -> None:
        """Keep chunks that the memo does not hold; those not met before are checked against the library."""
        kept = [c for c in chunks if c in self.older[0]]
        if kept:
            at = np.array([self.older[0][c] for c in kept])
            _, starts, ids = self.older
            length = starts[at + 1] - starts[at]
            self._keep(kept, _runs(ids, starts[at], length), length)
        new = [c for c in chunks if c not in self.older[0]] if kept else list(chunks)
        new.sort(key=lambda c: len(c) > LONG)
        short = sum(len(c) <= LONG for c in new)
        ids, length = self.merge_many(new[:short])
        if short < len(new):
            own = [self.merge_heap(c) for c in new[short:]]
            ids = np.concatenate([ids, np.array([i for o in own for i in o], np.int32)])
            length = np.concatenate([length, np.array([len(o) for o in own], np.int64)])
        if self.cut_lines and new:
            ids, length = self._checked(new, ids, length)
        self._keep(new, ids, length)

    def _checked(self, chunks: list[str], ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lead = len(self.library.encode("\n"))
        found = self.library.encode(["\n" + c for c in chunks], num_threads=1)
        size = np.array([len(f) for f in found], np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(size.sum()))
        del found
        begin = np.cumsum(size) - size
        library = _runs(flat, begin + lead, size - lead)
        if np.array_equal(size - lead, length) and np.array_equal(library, ids):
            return ids, length
        mine = np.split(ids, np.cumsum(length)[:-1])
        for c, a, b in zip(chunks, mine, np.split(library, np.cumsum(size - lead)[:-1])):
            if not np.array_equal(a, b):
                self.differed += 1
                _LOG.warning("chunk %r: own ids differ from the library's, which are taken", c[:100])
        return library, size - lead

    def _keep(self, chunks: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        memo, starts, held = self.memo
        memo.update(zip(chunks, range(len(memo), len(memo) + len(chunks))))
        starts = np.concatenate([starts, starts[-1] + np.cumsum(length)])
        self.memo = memo, starts, np.concatenate([held, ids.astype(np.int32)])
        # objects and table entries
        self.memo_bytes += 260 * len(chunks) + 2 * sum(map(len, chunks)) + 4 * len(ids)

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end); end ids included."""
        if self.memo_bytes > MEMO_BYTES:  # a new generation
            self.older, self.memo, self.memo_bytes = self.memo, _nothing(), 0
        held = [self.chunks(t or "") for t in texts]
        words = list(itertools.chain.from_iterable(held))
        until = np.cumsum([0, *map(len, held)])
        del held
        at = np.fromiter(map(self.memo[0].get, words, itertools.repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            missing = [words[i] for i in unknown.tolist()]
            self._learn(set(missing))
            at[unknown] = np.fromiter(map(self.memo[0].__getitem__, missing), np.int64, len(missing))
        del words
        _, starts, ids = self.memo
        length = starts[at + 1] - starts[at]
        flat = _runs(ids, starts[at], length)
        many = np.diff(np.append(0, np.cumsum(length))[until])
        ends = np.cumsum(many + len(self.end))
        out = np.empty(len(flat) + len(texts) * len(self.end), np.int32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(texts)) * len(self.end), many)] = flat
        for i, e in enumerate(self.end):
            out[ends - len(self.end) + i] = e
        return out, np.append(0, ends)

    def decimals(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Per text the ids as decimals joined by a space."""
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), self.names_of_ids.take(pa.array(ids)))
        return pc.binary_join(lists, " ").to_pylist()

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """(ids, the ids as decimals joined by a space) per text, end id included."""
        ids, bounds = self.encode_flat(texts)
        yield from zip(np.split(ids, bounds[1:-1]) if texts else [], self.decimals(ids, bounds))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


def encoder(model_path: str, end: bool = True) -> Encoder:
    """The worker's encoder for a model: loaded once, its memo kept across tasks."""

    def make() -> Encoder:
        made = Encoder(model_path, end)
        give_back()  # what its making took
        return made

    return state("pieces", (model_path, end), make)


def encode(df: DataFrame, text: str, model_path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """Columns ``keep`` of ``df`` and the array column ``ids``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    schema = StructType([*(df.schema[k] for k in keep), StructField(ids, ArrayType(IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for whole in batches:
            for b in text_slices(whole, "__text"):
                flat, bounds = enc.encode_flat(b.column("__text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), lists],
                                                 schema=arrow)

    cols = [F.col(f"`{k}`") for k in keep]
    return df.select(*cols, F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def digests(df: DataFrame, id_col: str, text: str, model_path: str, with_ids: bool = False) -> DataFrame:
    """Per row the id, the number of ids, SHA-256 of the decimal ids and of the
    library's decoding of the ids; encoding and decoding share one pass."""
    import hashlib

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for whole in batches:
            for b in text_slices(whole, "__text"):
                flat, bounds = enc.encode_flat(b.column("__text").to_pylist())
                spelt = [hashlib.sha256(t.encode()).hexdigest() for t in enc.decimals(flat, bounds)]
                back = [hashlib.sha256(enc.library.decode(ids.tolist()).encode()).hexdigest()
                        for ids in np.split(flat, bounds[1:-1])]
                columns = [b.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(spelt, pa.string()),
                           pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return (df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("__text"))
            .mapInArrow(run, schema))
