"""Token ids of texts by the tokenizers library, with a per-worker memo.

For vocabularies that drop white space (pre-tokens never span it) the library
need not see the same word twice: texts are cut at ASCII white space, a slice's
words are numbered by Arrow's dictionary encoding, and only distinct words that
the worker has not met go to the library, a batch at a time; the ids of all
words are then one gather. A-Z are lower-cased first where the vocabulary
lower-cases anyway. Whether a vocabulary has these properties is read from its
file; otherwise whole texts go to the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sendwatch.llm.worker import state

MEMO_BYTES = 70_000_000  # of a generation; two are kept
SLICE_CHARS = 6_000_000  # characters whose words are numbered together
JOINED = 64
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# fixed value: the pre-tokenizer pattern of vocabularies that cut between letters and marks
LETTERS_AND_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Tokenizer:
    """``special_as_text``: strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        drops_space = (pre.get("type") == "Split" and pre.get("behavior") == "Removed" and pre.get("invert")
                       and "\\s" in str(pre.get("pattern")) and set(steps) <= {"NFC", "Replace", "Lowercase"})
        added = [t for t in spec.get("added_tokens", [])]
        self.by_piece = bool(drops_space) and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word")
                                                      or any(c.isspace() for c in t["content"]) for t in added)
        self.lower = self.by_piece and "Lowercase" in steps
        self.marks = [] if special_as_text else [t["content"].encode() for t in added]
        # letters and ASCII marks (but the apostrophe) are always words of their own
        self.cuts_marks = self.by_piece and pre.get("pattern", {}).get("Regex") == LETTERS_AND_MARKS
        # ids of entries that end a word, if the vocabulary marks them
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
        for entry, i in (spec["model"]["vocab"].items() if suffix and self.by_piece else ()):
            self.ends[i] = entry.endswith(suffix)
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.memo_bytes = 0
        self.after: dict[str, bytes] = {}

    def _encode(self, pieces: list[bytes]) -> Iterator[bytes]:
        texts = [p.decode() for p in pieces]
        for e in self.library.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, dtype=self.dtype).tobytes()

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces not in the memo. Where the vocabulary cuts between
        letters and marks, a word is letters and the marks after them, each
        with ids of its own. New letters go to the library many at a time: each
        is one word of the vocabulary, whose last entry ends a word, so the ids
        can be told apart. Everything else goes piece by piece."""
        if self.memo_bytes > MEMO_BYTES:
            self.older, self.memo, self.memo_bytes = self.memo, {}, 0
        words = b" ".join(pieces).decode().split(" ")
        letters = [w.rstrip(MARKS) for w in words] if self.cuts_marks else [""] * len(words)
        known: dict[str, bytes] = {}
        new = []
        for w in {w for w in letters if w.isalpha()}:
            key = w.encode()
            if (ids := self.memo.get(key)) is None and (ids := self.older.get(key)) is None:
                new.append(w)
            else:
                known[w] = ids
        groups = [new[k:k + JOINED] for k in range(0, len(new), JOINED)]
        joined = self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False) if new else []
        for g, e in zip(groups, joined):
            ids = np.array(e.ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(g) and ends[-1] == len(ids):
                data, at = ids.tobytes(), 0
                for w, cut in zip(g, (ends * self.dtype.itemsize).tolist()):
                    known[w] = data[at:cut]
                    at = cut
        for w in new:
            if w in known:
                self._keep(w.encode(), known[w])
        out, rest = {}, []
        for p, word, w in zip(pieces, words, letters):
            if w in known:
                out[p] = known[w] + self._marks(word[len(w):]) if len(word) > len(w) else known[w]
            elif (ids := self.older.get(p)) is not None:
                out[p] = ids
            else:
                rest.append((p, w))
        for (p, w), ids in zip(rest, self._encode([p for p, _ in rest])):
            out[p] = ids
            if not w.isalpha():  # the memo's ids of letters are those of one word
                self._keep(p, ids)
        return out

    def _keep(self, piece: bytes, ids: bytes) -> None:
        if len(piece) <= 64:
            self.memo[piece] = ids
            self.memo_bytes += 180 + len(piece) + len(ids)  # objects and table entry

    def _marks(self, marks: str) -> bytes:
        """Ids of the marks after a word: few kinds, kept while they are few."""
        if (ids := self.after.get(marks)) is None:
            ids = next(self._encode([marks.encode()]))
            if len(self.after) < 10_000 and len(marks) <= 64:
                self.after[marks] = ids
        return ids

    def _words(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text, lower-cased where that changes nothing but time."""
        if self.lower:
            low = pc.ascii_lower(texts)
            for mark in self.marks:  # special tokens are matched before lower-casing
                texts_with = pc.match_substring(low, mark.decode())
                if pc.any(texts_with).as_py():
                    low = pc.if_else(texts_with, texts, low)
            texts = low
        return pc.ascii_split_whitespace(texts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``."""
        if not self.by_piece:
            flat = self._encode([t.encode() for t in texts if t])
            return [next(flat) if t else b"" for t in texts]
        held = self._words(pc.fill_null(pa.array(texts, pa.large_string()), ""))
        every = held.flatten().dictionary_encode()
        lengths = held.value_lengths().to_numpy(zero_copy_only=False)
        del held
        names = every.dictionary.cast(pa.large_binary()).to_pylist()
        found = [self.memo.get(p) if p else b"" for p in names]  # text ends give empty words
        if lacking := [p for p, ids in zip(names, found) if ids is None]:
            learnt = self._learn(lacking)
            found = [learnt[p] if ids is None else ids for p, ids in zip(names, found)]
        width = self.dtype.itemsize
        size = np.fromiter(map(len, found), np.int32, len(found)) // width
        ids = np.frombuffer(b"".join(found), self.dtype)
        word = every.indices.to_numpy(zero_copy_only=False)
        begins, sizes = (np.cumsum(size, dtype=np.int64) - size)[word], size[word]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        place = np.int32 if max(len(ids), ends[-1]) < 1 << 31 else np.int64
        at = np.repeat((begins - ends[:-1]).astype(place), sizes)
        at += np.arange(len(at), dtype=place)
        out = ids[at].tobytes()
        cuts = (ends[np.concatenate([[0], np.cumsum(lengths)])] * width).tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]


def tokenizer(path: str, special_as_text: bool = False) -> Tokenizer:
    """The worker's tokenizer for a file: loaded once, its memo kept across tasks."""
    return state("tokens", (path, special_as_text), lambda: Tokenizer(path, special_as_text))


class PartFile:
    """A file that a task writes. The name holds a random part, so another
    attempt of the task writes another file; readers go by the names that
    successful tasks have returned."""

    def __init__(self, folder: str, part: int, suffix: str):
        import uuid

        from sendwatch.llm.common import local_path

        self.uri = f"{folder.rstrip('/')}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"
        fs, path = local_path(self.uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()


def part_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
