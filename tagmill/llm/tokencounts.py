"""Token counts without tokenizing: words that are one token as they stand are looked up, the rest is merged once.

Before a job, the driver proves for every string of the vocabulary whether it comes out as one token when it stands
alone: the library itself encodes it. A byte-level tokenizer never joins characters across a single space between
other characters, nor across a single line break, so a text is cut there, and a stretch that is a proven string
counts one. Other stretches are cut by the library's own rule; of these pieces, proven ones count one and only the rest goes
through the merges. Workers remember the counts of short stretches, up to a fixed number.

Texts that hold an added token (``<|endoftext|>``) and tokenizers of any other kind are encoded whole by their library, so their
counts are the library's by definition.

Defined cases: a null or empty text has no bytes and no tokens; repeated rows are counted alike; a text of any length is
counted whole; an empty table gives an empty result; an input column named like a result is replaced.
"""

import json
import os
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import packed, unpacked
from tagmill.llm.tokens import kind_of

BETWEEN = re.compile(r"(?<=\S) (?=\S)")
SPACED = re.compile(r"\s")
LONGEST_KEPT = 64
MOST_KEPT = 400_000
#: Count of a stretch at whose end no cut is allowed; one of them makes a text's sum negative.
UNSAFE = -(1 << 62)
COUNTS = ["n_bytes", "n_tokens", "over_limit"]


class Vocabulary(NamedTuple):
    """A tokenizer's file, its strings proven to be one token alone, as the merges see them and as text, and its added tokens."""

    path: str
    pieces: frozenset
    texts: tuple
    added: tuple
    shortcut: bool


def loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def proven(path: str) -> Vocabulary:
    """Encode every vocabulary string alone and keep those that come out as one token."""
    if path.endswith(".model") or kind_of(path) != "leading":
        return Vocabulary(path, frozenset(), (), (), False)
    tokenizer = loaded(path)
    added = tuple(token.content for token in tokenizer.get_added_tokens_decoder().values())
    with open(path, encoding="utf-8") as file:
        strings = [s for s in json.load(file)["model"]["vocab"] if s not in added]
    pieces = [s for s in strings if len(tokenizer.model.tokenize(s)) == 1]
    texts = [tokenizer.decode([tokenizer.token_to_id(s)]) for s in pieces]
    ones = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    alone = [text for text, one in zip(texts, ones, strict=True) if len(one.ids) == 1]
    return Vocabulary(path, frozenset(pieces), tuple(alone), added, True)


class Counts(dict):
    """Tokens of stretches of text. ``word`` is a stretch that follows a space and includes it, `` word`` one that does
    not; none has a space inside."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.tokenizer = vocabulary, loaded(vocabulary.path)
        self.cut, self.merged = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        self.start()

    def start(self):
        self.clear()
        for text in self.vocabulary.texts:
            if " " not in text[1:] and not text[-1:].isspace():
                self[text[1:] if text[0] == " " else " " + text] = 1

    def __missing__(self, key: str) -> int:
        if key in ("", " ") or key[-1].isspace():
            return UNSAFE
        head, line, tail = key.partition("\n")
        if line and tail and "\n" not in tail and not (head[-1:].isspace() or tail[0].isspace()) and head not in ("", " "):
            # A single line break between other characters: cut before it.
            return self[head] + self[" \n" + tail]
        count = self.of(key[1:] if key[0] == " " else " " + key)
        if len(key) <= LONGEST_KEPT:
            if len(self) > MOST_KEPT:
                self.start()
            self[key] = count
        return count

    def of(self, stretch: str) -> int:
        """Tokens of any stretch: proven pieces count one, the others are merged."""
        whole = self.vocabulary.pieces
        return sum(1 if piece in whole else len(self.merged(piece)) for piece, _ in self.cut(stretch))

    def text(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if any(token in text for token in self.vocabulary.added):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *others = text.split(" ")
        count = self[" " + first] + sum(map(self.__getitem__, others))
        if count >= 0:
            return count
        # Runs of white space: cut only at spaces between other characters, and count the few odd stretches as they are.
        first, *others = BETWEEN.split(text)
        counts = [self.of(" " + part) if SPACED.search(part) else self[part] for part in others]
        return sum(counts) + (self.of(first) if SPACED.search(first) else self[" " + first])


COUNTERS: dict = {}


def counter(vocabulary: Vocabulary):
    """The worker's function from a text to its number of tokens."""
    path = vocabulary.path
    if path not in COUNTERS:
        if vocabulary.shortcut:
            COUNTERS[path] = Counts(vocabulary).text
        elif path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            COUNTERS[path] = lambda text: len(processor.encode(text, num_threads=1))
        else:
            tokenizer = loaded(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            COUNTERS[path] = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    return COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """All input columns, ``n_bytes``, ``n_tokens`` and whether they are more than ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(proven(tokenizer))  # bounded by the vocabulary

    @F.arrow_udf("bigint")
    def tokens(texts: pa.Array) -> pa.Array:
        count = counter(shared.value)
        return pa.array([count(value.as_py()) for value in texts], pa.int64())

    whole = F.coalesce(F.col("doc").getField(text).cast("string"), F.lit(""))
    rows = packed(docs).withColumns({"n_tokens": tokens(whole), "n_bytes": F.octet_length(whole).cast("bigint")})
    return unpacked(rows.withColumn("over_limit", F.col("n_tokens") > limit), COUNTS)
