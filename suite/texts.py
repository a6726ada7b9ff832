"""Text functions, prompts, requests, features."""

from pyspark.sql import functions as F

from suite.fixtures import BASE, DOCS, VERDICTS, documents, replies, seed, table
from suite.registry import query
from suite.relational import WORD_VECTORS
from tagmill import constants as K
from tagmill.functions import prompts
from tagmill.functions.replies import decode_reply, verdict
from tagmill.functions.text import text_key, truncate
from tagmill.operators import features, judge
from tagmill.operators.sampling import sample_examples
from tagmill.storage import lookup_join, settle, spread


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def filled(template, **values):
    """The SQL form of a filled template."""
    import re

    parts = []
    for at, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        parts.append(values[piece] if at % 2 else quoted(piece))
    return " || ".join(p for p in parts if p != "''")


@query("SELECT doc_id AS row_id, md5(text) AS key FROM documents")
def text_md5(spark, sf):
    return documents(spark, sf).select("row_id", text_key(F.col("text")).alias("key"))


@query("SELECT doc_id AS row_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS shown FROM documents")
def truncate_text(spark, sf):
    return documents(spark, sf).select("row_id", truncate(F.col("text")).alias("shown"))


@query(f"WITH {VERDICTS} SELECT row_id, is_valid, confidence FROM verdicts")
def verdict_parse(spark, sf):
    return replies(spark, sf).select("row_id", verdict(F.col("reply")).alias("v")).select("row_id", "v.*")


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'indeterminate'
ELSE regexp_replace(replace(replace('<think>' || text || '</think> ', '<think>', ''), '</think>', ''), '^\\s+|\\s+$', '', 'g') END AS reply
FROM conversations""")
def reply_decode(spark, sf):
    """Conversation turns wrapped as replies of each provider form, every fifth unreadable."""
    text = F.concat(F.lit("<think>"), F.col("text"), F.lit("</think> "))
    as_parts = F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    as_content = F.struct(F.array(F.struct(text.alias("text"))).alias("content"))
    as_choice = F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"))
    as_text = F.struct(text.alias("text"))
    form = F.col("turn") % 5
    payload = (
        F.when(form == 0, F.to_json(as_parts))
        .when(form == 1, F.to_json(as_content))
        .when(form == 2, F.to_json(as_choice))
        .when(form == 3, F.to_json(as_text))
        .otherwise(F.lit('{"error": "timeout"}'))
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", decode_reply(payload).alias("reply"))


# Up to seven examples per label; six are shown.
EXAMPLES = f"""{BASE}, drawn AS (
  SELECT row_id, label, text, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) AS place
  FROM seed QUALIFY place <= 7),
lists AS (SELECT label, list(text ORDER BY place) AS examples FROM drawn GROUP BY label),
sections AS (SELECT label, 'Representative Examples:' || chr(10) ||
  string_agg(place || '. "' || text || '"' || chr(10), '' ORDER BY place) FILTER (place <= 6) || chr(10) AS section FROM drawn GROUP BY label)"""


def example_lists(spark, sf):
    drawn = sample_examples(seed(spark, sf), 7)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return drawn.groupBy("label").agg(ordered.alias("examples"))


@query(f"WITH {EXAMPLES} SELECT label, section FROM sections")
def examples_section(spark, sf):
    return example_lists(spark, sf).select("label", prompts.examples_section(F.col("examples"), 6).alias("section"))


def with_lists(spark, sf):
    rows = documents(spark, sf)
    return lookup_join(rows, example_lists(spark, sf), "label", "left")


DEFAULT = "'Text samples that belong to the ''' || docs.label || ''' category'"


def prompt_sql(template):
    body = filled(template, text="text", label="docs.label", description=DEFAULT, examples_section="coalesce(section, '')")
    return f"WITH {EXAMPLES} SELECT row_id, md5({body}) AS prompt_md5, length({body}) AS n_chars FROM docs LEFT JOIN sections USING (label)"


def described(prompt):
    return [F.md5(prompt).alias("prompt_md5"), F.char_length(prompt).cast("long").alias("n_chars")]


@query(prompt_sql(K.BINARY_TEMPLATE))
def prompt_binary(spark, sf):
    about = prompts.default_description(F.col("label"))
    prompt = prompts.binary_prompt(F.col("text"), F.col("label"), about, F.col("examples"), 6)
    return with_lists(spark, sf).select("row_id", *described(prompt))


@query(prompt_sql(K.REASONING_TEMPLATE))
def prompt_reasoning(spark, sf):
    about = prompts.default_description(F.col("label"))
    prompt = prompts.reasoning_prompt(F.col("text"), F.col("label"), about, F.col("examples"), 6)
    return with_lists(spark, sf).select("row_id", *described(prompt))


CLASS_LINES = """names AS (SELECT string_agg('- ' || label || ': Text samples that belong to the ''' || label || ''' category', chr(10) ORDER BY label) AS classes,
string_agg(label, ', ' ORDER BY label) AS available FROM (SELECT DISTINCT label FROM docs))"""
MULTI = filled(K.MULTICLASS_TEMPLATE, text="text", predicted_class="docs.label", class_descriptions="classes", examples_section="coalesce(section, '')")


def all_classes(spark, sf):
    """Sorted labels with their descriptions in one row; there are few labels."""
    labels = documents(spark, sf).select("label").distinct()
    names = F.sort_array(F.collect_list("label"))
    row = labels.agg(names.alias("names")).select(
        "names", F.transform("names", lambda x: prompts.fill(K.DEFAULT_DESCRIPTION, label=x)).alias("about")
    )
    return row.withColumn("_one", F.lit(1))


@query(f"WITH {EXAMPLES}, {CLASS_LINES} SELECT row_id, md5({MULTI}) AS prompt_md5, length({MULTI}) AS n_chars FROM docs LEFT JOIN sections USING (label), names")
def prompt_multiclass(spark, sf):
    rows = lookup_join(with_lists(spark, sf).withColumn("_one", F.lit(1)), all_classes(spark, sf), "_one")
    lines = prompts.class_list(F.col("names"), F.col("about"))
    prompt = prompts.multiclass_prompt(F.col("text"), F.col("label"), lines, F.col("examples"), 6)
    return rows.select("row_id", *described(prompt))


UNSURE = filled(K.UNCERTAINTY_TEMPLATE, text="text", predicted_class="label", confidence="lang", available_classes="available")


@query(f"WITH {DOCS}, {CLASS_LINES} SELECT row_id, md5({UNSURE}) AS prompt_md5, length({UNSURE}) AS n_chars FROM docs, names")
def prompt_uncertainty(spark, sf):
    """The document language stands for the confidence text."""
    rows = lookup_join(documents(spark, sf).withColumn("_one", F.lit(1)), all_classes(spark, sf), "_one")
    available = F.array_join("names", ", ")
    return rows.select("row_id", *described(prompts.uncertainty_prompt(F.col("text"), F.col("label"), F.col("lang"), available)))


DESCRIBE = f"""{BASE}, drawn AS (
  SELECT row_id, label, text, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) AS place
  FROM seed QUALIFY place <= 50),
listed AS (SELECT label, count(*) AS n, string_agg(place || '. "' || text || '"', chr(10) ORDER BY place) FILTER (place <= 10)
  || CASE WHEN count(*) > 10 THEN chr(10) || '... and ' || (count(*) - 10) || ' more examples' ELSE '' END AS examples FROM drawn GROUP BY label),
asked AS (SELECT label, n, {filled(K.DESCRIBE_TEMPLATE, label='label', examples='examples')} AS prompt FROM listed)"""


@query(f"WITH {DESCRIBE} SELECT label, n AS n_examples, prompt FROM asked")
def prompt_describe_label(spark, sf):
    lists = judge.example_lists(seed(spark, sf), 50)
    prompt = prompts.describe_prompt(F.col("label"), F.col("examples"), F.col("n_examples"))
    return lists.select("label", "n_examples", prompt.alias("prompt"))


@query(f"""WITH {DOCS} SELECT row_id, CASE WHEN row_id % 9 = 0 THEN '__NOISE__' ELSE label END AS predicted_label,
CASE WHEN row_id % 9 = 0 THEN 'Text samples that do not belong to any of the defined categories'
     WHEN label < 'src2' THEN 'About ' || label ELSE 'Text samples that belong to the ''' || label || ''' category' END AS description FROM docs""")
def description_fallback(spark, sf):
    label = F.when(F.col("row_id") % 9 == 0, F.lit(K.NOISE_LABEL)).otherwise(F.col("label"))
    rows = documents(spark, sf).select("row_id", label.alias("predicted_label"))
    known = documents(spark, sf).select("label").distinct().where("label < 'src2'")
    return judge.with_description(rows, known.withColumn("description", F.concat(F.lit("About "), F.col("label"))))


def chat_sql(style, user="text"):
    pairs = K.FEW_SHOT_PAIRS
    system = quoted(K.VALIDATOR_SYSTEM)

    def message(role, content):
        return f"{{'role': '{role}', 'content': {content}}}"

    def turn(role, content):
        return f"{{'role': '{role}', 'parts': [{{'text': {content}}}]}}"

    if style == "single":
        parts = [f"'System: ' || {system}"]
        for q, a in pairs:
            parts += [f"'Human: ' || {quoted(q)}", f"'Assistant: ' || {quoted(a)}"]
        content = " || chr(10) || chr(10) || ".join([*parts, f"'Human: ' || {user}"])
        return f"to_json({{'messages': [{message('user', content)}]}})"
    make, answer = (message, "assistant") if style == "messages" else (turn, "model")
    items = [make("system", system)] if style == "messages" else [make("user", system), make("model", quoted(K.ACKNOWLEDGEMENT))]
    for q, a in pairs:
        items += [make("user", quoted(q)), make(answer, quoted(a))]
    items.append(make("user", user))
    return f"to_json({{'{'messages' if style == 'messages' else 'contents'}': [{', '.join(items)}]}})"


STYLES = ("messages", "single", "contents")


@query(" UNION ALL ".join(
    f"SELECT conv_id, turn, '{s}' AS style, {chat_sql(s)}::VARCHAR AS request FROM conversations WHERE role = 'user'" for s in STYLES
))
def chat_requests(spark, sf):
    """Every user turn as a request in each style."""
    asked = table(spark, sf, "conversations").where("role = 'user'")
    requests = F.array(*[
        F.struct(F.lit(s).alias("style"), prompts.chat_request(K.VALIDATOR_SYSTEM, F.col("text"), s).alias("request")) for s in STYLES
    ])
    return asked.select("conv_id", "turn", F.inline(requests))


# features

STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in K.ENGLISH_STOP_WORDS)
# The two queries over all documents leave out only these words and count every other one.
STOP_WORDS = tuple("the and of to in is it that was for on are as with his they at be this have from".split())
FEW_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
TERMS = rf"""docs AS (SELECT doc_id AS row_id, text FROM documents),
lists AS (SELECT row_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'),
          lambda w: NOT list_contains([{FEW_STOPS}], w)) AS ws FROM docs),
terms AS (SELECT row_id, unnest(ws) AS term FROM lists
          UNION ALL SELECT row_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM lists),
tf AS (SELECT row_id, term, count(*) AS tf FROM terms GROUP BY ALL),
vocab AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM tf GROUP BY term ORDER BY 2 DESC, term LIMIT 10000),
idf AS (SELECT *, row_number() OVER (ORDER BY tf DESC, term) - 1 AS idx, ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1 AS idf FROM vocab)"""


def document_vocabulary(spark, sf):
    return features.vocabulary(spread(documents(spark, sf)), 10_000, STOP_WORDS)


@query(f"WITH {TERMS} SELECT term, idx, tf, df, round(idf, 9) AS idf FROM idf")
def tfidf_vocabulary(spark, sf):
    return document_vocabulary(spark, sf).select("term", "idx", "tf", "df", F.round("idf", 9).alias("idf"))


@query(f"""WITH {TERMS}, w AS (SELECT row_id, tf.term, tf.tf * idf AS w FROM tf JOIN idf USING (term))
SELECT row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 7) AS weight FROM w""")
def tfidf(spark, sf):
    weights = features.tfidf(spread(documents(spark, sf)), document_vocabulary(spark, sf), STOP_WORDS)
    return weights.select("row_id", "term", F.round("weight", 7).alias("weight"))


@query(f"""WITH {BASE}, keyed AS (SELECT DISTINCT md5(text) AS key, text FROM docs), {WORD_VECTORS}
SELECT row_id, pos, value FROM docs JOIN cells ON cells.key = md5(docs.text)""")
def embed_texts(spark, sf):
    """All documents, with the seed texts already in the cache."""
    from suite.relational import text_cache

    rows, _ = features.embed_texts(
        documents(spark, sf).select("row_id", "text"), text_cache(spark, sf), features.word_hash_encoder(), "words", strict=True
    )
    return rows.select("row_id", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


@query(r"""WITH words AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w FROM benchmark),
sums AS (SELECT item_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos,
         sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS s FROM words GROUP BY ALL),
n AS (SELECT item_id, sqrt(sum(s * s)) AS n FROM sums GROUP BY item_id)
SELECT a.item_id, b.item_id AS other_id, round(coalesce((SELECT sum(x.s * y.s) FROM sums x JOIN sums y USING (pos)
  WHERE x.item_id = a.item_id AND y.item_id = b.item_id) / nullif(na.n * nb.n, 0), 0), 5) AS similarity
FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 LEFT JOIN n na ON na.item_id = a.item_id LEFT JOIN n nb ON nb.item_id = b.item_id""")
def compute_similarity(spark, sf):
    """Similarity of two texts: each benchmark text and the next one."""
    from tagmill.functions.vectors import cosine

    rows = table(spark, sf, "benchmark").select(F.col("item_id"), "text")
    empty = spark.createDataFrame([], features.EMPTY_CACHE)
    encoded, _ = features.embed_texts(rows, empty, features.word_hash_encoder(), "words")
    one = settle(encoded.select("item_id", "embedding"), "encoded")
    two = one.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other_id"), F.col("embedding").alias("other"))
    similarity = F.round(cosine(F.col("embedding"), F.col("other")), 5)
    return one.join(two, "item_id").select("item_id", "other_id", similarity.alias("similarity"))
