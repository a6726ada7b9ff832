"""Text columns: strip, keys, tokens, truncation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagmill.constants import MAX_PROMPT_TEXT, SPACES, TOKEN_PATTERN, TRUNCATION_SUFFIX


def strip_space(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def text_key(text: Column) -> Column:
    """Content key of a text."""
    return F.md5(F.encode(text, "UTF-8"))


def tokens(text: Column) -> Column:
    """Lower-case words of two or more characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def without(words: Column, stop_words) -> Column:
    """Words that are not stop words."""
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def with_pairs(words: Column) -> Column:
    """Words followed by their neighbouring pairs."""
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(words, pairs)


def truncate(text: Column, length: int = MAX_PROMPT_TEXT, suffix: str = TRUNCATION_SUFFIX) -> Column:
    """Cut a long text for display in a prompt."""
    return F.when(F.char_length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit(suffix))).otherwise(text)
