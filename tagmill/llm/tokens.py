"""Token ids by the tokenizers library, each different word encoded once per worker.

Two kinds of tokenizer never join characters across certain blanks, so a text may be cut there and
the pieces encoded on their own, with the same ids as the whole:

* byte-level ones with the usual split rule put a single space at the head of the next word, and a single
  line break between other characters stands alone;
* those that drop white space end a word at each space, and lower its letters.

Any other tokenizer gets whole texts. Texts are cut and their words numbered as Arrow arrays, so Python sees the different
words of a batch only; the ids of a batch are gathered from one array. Ids are little-endian unsigned 32-bit numbers.
"""

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space as Python's ``\s`` has it; a fixed list, as Arrow's expressions know ASCII only.
BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ODD = f"{BLANK}{BLANK}|^{BLANK}|{BLANK}$"
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
MARKED = re.compile(r"([ \n]?)([^\W\d_]+)([.,;:!?%&*$#|]*)")
LONGEST_KEPT = 64
MOST_KEPT = 500_000
# Text that is cut at a time: working arrays take some 30 times as much.
BATCH_BYTES = 1 << 22
# How byte-level tokenizers write a space.
SPACE = "\u0120"


def kind_of(path: str) -> str:
    """``leading`` (space at the head of a word), ``dropped`` (white space dropped) or ``whole``."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    before, normal = rules.get("pre_tokenizer") or {}, rules.get("normalizer") or {}
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal:
        return "leading"
    steps, cleaning = before.get("pretokenizers") or [], [n.get("type") for n in normal.get("normalizers", [])]
    first = steps[0] if steps else {}
    if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and {"Replace", "Lowercase"} <= set(cleaning) and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", ""):
        return "dropped"
    return "whole"


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of all items of runs, run after run."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def slices(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES):
    """Parts of a batch with a bounded number of bytes in a string column, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, before + most, "right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


class Store:
    """Runs of ids, one after another in one array."""

    def __init__(self):
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.counts, self.runs = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    @staticmethod
    def room(array: np.ndarray, wanted: int) -> np.ndarray:
        return array if wanted <= len(array) else np.concatenate((array, np.empty(max(wanted - len(array), len(array)), array.dtype)))

    def add(self, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> range:
        """Keep stretches of ``ids``; returns the numbers of the runs."""
        first, runs = self.runs, self.runs + len(starts)
        self.ids, self.starts, self.counts = self.room(self.ids, self.used + len(ids)), self.room(self.starts, runs), self.room(self.counts, runs)
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[first:runs], self.counts[first:runs] = starts + self.used, counts
        self.used, self.runs = self.used + len(ids), runs
        return range(first, runs)

    def gathered(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs in a row, and how many each has."""
        counts = self.counts[runs]
        return self.ids[spans(self.starts[runs], counts)], counts


class Encoder:
    """Encodes batches of texts; remembers the ids of words.

    New words are encoded in one go, with a special token between them, at which the tokenizer cuts
    before all else.
    """

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.end_id = Tokenizer.from_file(path), kind_of(path), end_id
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.lstrip and not t.rstrip]
        if not special:
            self.kind = "whole"
        else:
            self.mark_id, self.mark = special[0]
        self.start()

    def start(self):
        # Words by their key: "word" stands after a space, "\nword" after a line break, " word" at the
        # start. No word begins with a space itself, as texts are cut between other characters.
        self.known: dict[str, int] = {}
        self.store = Store()
        self.end_run = None if self.end_id is None else self.store.add(*self.runs([[self.end_id]]))[0]

    @staticmethod
    def runs(lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum()))
        return ids, np.cumsum(counts) - counts, counts

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spelled(self, key: str) -> str:
        """The stretch of text that a key stands for."""
        if key[:1] == " ":
            return key[1:]
        return key if key[:1] == "\n" or self.kind == "dropped" else " " + key

    def parts(self, key: str) -> tuple[str, ...]:
        """Keys of stretches at whose borders both kinds of tokenizer cut: a line break before a
        word, and marks after a letter."""
        if key.isalpha() and key.isascii():
            return (key.lower() if self.kind == "dropped" else key,)
        found = MARKED.fullmatch(key)
        if not found:
            return (key,)
        head, word, marks = found.groups()
        if self.kind == "dropped":
            return (word.lower() if word.isascii() else word, *((marks,) if marks else ()))
        word = " " + word if head in (" ", "\n") and word[:1] != " " else word
        return ((" \n",) if head == "\n" else ()) + (word,) + ((" " + marks,) if marks else ())

    def learn(self, keys: list[str]) -> None:
        """Keep the ids of new keys: known stretches are looked up, new ones encoded."""
        split = [(key, self.parts(key)) for key in keys]
        # A word of plain letters is one piece and goes to the merges as it is.
        plain, others, merged = [], [], self.tokenizer.model.tokenize
        for part in {part: None for _, parts in split for part in parts if part not in self.known}:
            (plain if part.isalpha() and part.isascii() else others).append(part)
        head = SPACE if self.kind == "leading" else ""
        found = [[token.id for token in merged(head + part)] for part in plain]
        self.known.update(zip(plain, self.store.add(*self.runs(found)), strict=True))
        for start in range(0, len(others), 2_000):
            some = others[start : start + 2_000]
            found = np.array(self.whole([self.mark.join(map(self.spelled, some))])[0], np.uint32)
            cuts = np.flatnonzero(found == self.mark_id)
            starts, ends = np.concatenate(([0], cuts + 1)), np.append(cuts, len(found))
            self.known.update(zip(some, self.store.add(found, starts, ends - starts), strict=True))
        self.known.update((key, self.known[parts[0]]) for key, parts in split if len(parts) == 1)
        joined = [(key, parts) for key, parts in split if len(parts) > 1]
        if joined:
            widths = np.array([len(parts) for _, parts in joined])
            ids, counts = self.store.gathered(np.array([self.known[part] for _, parts in joined for part in parts]))
            totals = np.add.reduceat(counts, np.cumsum(widths) - widths)
            self.known.update(zip([key for key, _ in joined], self.store.add(ids, np.cumsum(totals) - totals, totals), strict=True))

    def runs_of(self, keys: list[str]) -> np.ndarray:
        """The runs of different keys. Those of very long keys and of such with a special token are not remembered by key."""
        found = list(map(self.known.get, keys))
        missing = [key for key, run in zip(keys, found, strict=True) if run is None]
        if missing:
            rest = [key for key in missing if len(key) > LONGEST_KEPT or self.mark in key]
            others = dict(zip(rest, self.store.add(*self.runs(self.whole(list(map(self.spelled, rest))))), strict=True))
            self.learn([key for key in missing if key not in others])
            found = [others[key] if run is None and key in others else self.known[key] if run is None else run for key, run in zip(keys, found, strict=True)]
        return np.array(found, np.int64)

    def words(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Different keys, the number of the key of every word, text after text, and how many words each text has."""
        if self.kind == "dropped":
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            coded = cut.flatten().dictionary_encode()
            return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), pc.list_value_length(cut).to_numpy()
        odd = pc.match_substring_regex(texts, ODD)
        plain = texts.filter(pc.invert(odd))
        cut = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        counts = pc.list_value_length(cut).to_numpy()
        flat, starts = cut.flatten(), np.cumsum(counts) - counts
        heads = pc.binary_join_element_wise(pa.scalar(" ", texts.type), flat.take(pa.array(starts)), pa.scalar("", texts.type))
        rows = [self.odd_keys(text) for text in texts.filter(odd).to_pylist()]
        coded = pa.concat_arrays([flat, heads, pa.array([key for row in rows for key in row], texts.type)]).dictionary_encode()
        codes = coded.indices.to_numpy().copy()
        codes[starts] = codes[len(flat) : len(flat) + len(heads)]
        if rows:
            # Back into the order of the texts.
            odd, few = odd.to_numpy(zero_copy_only=False), np.array([len(row) for row in rows])
            all_counts, places = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
            all_counts[odd], all_counts[~odd] = few, counts
            places[odd], places[~odd] = len(flat) + len(heads) + np.cumsum(few) - few, starts
            codes, counts = codes[spans(places, all_counts)], all_counts
        else:
            codes = codes[: len(flat)]
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), codes, counts

    @staticmethod
    def odd_keys(text: str) -> list[str]:
        """Keys of a text with runs of white space, which is cut at spaces between other characters only."""
        first, *others = SINGLE_SPACE.split(text)
        return [" " + first, *others]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the end id, and where each text begins, with the end of all; null counts as empty."""
        if len(self.known) > MOST_KEPT or self.store.used > 16 * MOST_KEPT:
            self.start()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.kind == "whole":
            end = [] if self.end_id is None else [self.end_id]
            ids, starts, _ = self.runs([found + end for found in self.whole(texts.to_pylist())])
            return ids, np.append(starts, len(ids))
        keys, codes, words = self.words(texts)
        runs = self.runs_of(keys)[codes]
        if self.end_run is not None:
            runs, words = np.insert(runs, np.cumsum(words), self.end_run), words + 1
        ids, counts = self.store.gathered(runs)
        edges = np.concatenate(([0], np.cumsum(counts)))
        return ids, edges[np.concatenate(([0], np.cumsum(words)))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text as bytes."""
        ids, edges = self.ids(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


ENCODERS: dict = {}


def encoder(path: str, end_id: int | None = None) -> Encoder:
    """The worker's encoder for a file."""
    if (path, end_id) not in ENCODERS:
        ENCODERS[path, end_id] = Encoder(path, end_id)
    return ENCODERS[path, end_id]
