"""Judge replies: from provider JSON to verdicts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagmill import constants as K
from tagmill.functions.text import strip_space


def decode_reply(payload: Column) -> Column:
    """Reply text inside a provider's JSON, without think tags."""
    text = F.coalesce(*[F.get_json_object(payload, path) for path in K.REPLY_PATHS])
    return F.coalesce(strip_space(F.regexp_replace(text, "</?think>", "")), F.lit(K.UNREADABLE_REPLY))


def verdict(reply: Column) -> Column:
    """Struct of ``is_valid`` and ``confidence``; a null reply is a failed request."""
    low = F.lower(strip_space(reply))
    yes, no = low.contains("true"), low.contains("false")
    confidence = (
        F.when(reply.isNull(), F.lit(K.FAILED_CONFIDENCE))
        .when(yes != no, F.lit(K.CLEAR_CONFIDENCE))
        .otherwise(F.lit(K.AMBIGUOUS_CONFIDENCE))
    )
    return F.struct(F.coalesce(yes & ~no, F.lit(False)).alias("is_valid"), confidence.alias("confidence"))
