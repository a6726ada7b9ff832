"""Source divergence, token counts and filter interactions against plain Python."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import edges
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagmill.llm import divergence, interactions, tokencounts

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def divergence_by_hand(rows, least, scale, top):
    """Every kept term for every group, one by one."""
    texts = [(lang or "", source or "", TERM.findall(lowered(text or ""))) for text, lang, source in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), sorted({t[:2] for t in texts})
    for lang, source, terms in texts:
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        counts[lang].update(terms)
    kept = {lang: [t for t, n in docs[lang].items() if n >= least] for lang, _ in groups}

    def p(lang, key, term):
        total = sum(counts[key][t] for t in kept[lang]) + len(kept[lang])
        return 1 + scale * (counts[key][term] + 1) // total

    f = lambda x, y: (x - y) ** 2 // y
    out = []
    for lang, source in groups:
        pairs = [
            (-sum(f(p(lang, (lang, source), t), p(lang, (lang, other), t)) for t in kept[lang]), other)
            for same, other in groups if same == lang and other != source
        ]
        own = [(t, p(lang, (lang, source), t), p(lang, lang, t)) for t in kept[lang] if counts[lang, source][t]]
        terms = [(-f(a, b), t) for t, a, b in own if a > b]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            found.sort(key=lambda x: (x[0], x[1].encode()))
            out += [(lang, source, part, item, -value, rank) for rank, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def found_divergence(spark, rows, audit=divergence.Audit()):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    return sorted(map(tuple, divergence.source_divergence(docs, audit=audit).collect()))


@pytest.mark.parametrize("block", [(1 << 20, 300_000), (7, 3)])
def test_divergence_equals_the_dense_count(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "PAIR_BLOCK", block[0])
    monkeypatch.setattr(divergence, "MOST_HELD", block[1])
    draw = random.Random(3)
    words = ["Alpha", "beta", "ÉTÉ", "été", "日本", "x", "the", "the", "the", "rare%d"]
    rows = []
    for i in range(240):
        lang = draw.choice(["en", "en", "en", "fr", None])
        source = draw.choice(["hot"] * 4 + ["a", "b", "é", None]) if lang else "only"
        text = draw.choice([" ", "1", "-", "\0", "\n"]).join(w % i if "%" in w else w for w in draw.choices(words, k=draw.randrange(12)))
        rows.append((draw.choice([text] * 9 + [None]), lang, source))
    rows += [("nothing kept here", "xx", "one"), (None, "xx", "two"), ("...", "fr", "no terms")] + rows[:3]
    audit = divergence.Audit(min_docs=3, top=3)
    assert found_divergence(spark, rows, audit) == divergence_by_hand(rows, 3, 1_000_000_000, 3)


def test_divergence_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 1000)
    rows = [r[1:4] for r in edges.rows()] * 2
    got = sorted(map(tuple, divergence.source_divergence(edges.table(spark).union(edges.table(spark))).collect()))
    assert got == divergence_by_hand(rows, 3, 1_000_000_000, 200)
    assert divergence.source_divergence(edges.none(spark)).count() == 0


def test_long_texts_are_read_in_blocks(monkeypatch):
    text = ("Word other-word " * 500 + "é" * 3000 + " last").encode()
    whole, counted = divergence.frequencies(text), interactions.word_counts(text)
    monkeypatch.setattr(divergence, "BLOCK", 50)
    monkeypatch.setattr(interactions, "BLOCK", 50)
    assert divergence.frequencies(text) == whole and whole[b"word"] == 1000
    assert interactions.word_counts(text) == counted == (1002, 4)


PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = tokencounts.proven(PATH)


def by_library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


ODD = [
    "", " ", "\n", "  a b ", " ,x", "\n\ny z\n", "a\tb c\xa0d", "it's 's  x \n q", "　a b", "a\x1cb c", "a \x1c b", "é ́x", "a<|endoftext|> b", "<|endoftext|>",
    "tab\t end\n", "x  y z", "a\r\nb c\r\n d", "a\n b", "a \nb", "x\ny\nz w\nv", "\nq r", "q r\n", " first word", "!\n!", "a\0b \0c", "\0x", "ԘK b ࢏ c1", "THE!! END, (end).",
    "x" * 300 + " y", "'re we're", "can't\nwon't 'll",
]


def test_proven_strings_are_one_token_alone():
    assert VOCABULARY.shortcut and len(VOCABULARY.texts) > 45_000
    for text in random.Random(1).sample(VOCABULARY.texts, 500):
        assert by_library(text) == 1


def test_counts_equal_the_library():
    counts = tokencounts.Counts(VOCABULARY)
    for _ in range(2):  # new stretches, then remembered ones
        for text in ODD + [r[1] or "" for r in edges.rows()]:
            assert counts.text(text) == by_library(text), text[:50]


COUNTS = tokencounts.Counts(VOCABULARY)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \n\tabE.,'s!#1é\xa0Σ日\0\x1c\x85", max_size=30))
def test_any_text_counts_like_the_library(text):
    assert COUNTS.text(text) == by_library(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokencounts, "MOST_KEPT", len(COUNTS) + 10)
    counts = tokencounts.Counts(VOCABULARY)
    text = " ".join(f"word{i}\nnext{i}" for i in range(500))
    assert counts.text(text) == by_library(text)
    assert len(counts) <= tokencounts.MOST_KEPT + 3


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        library = Tokenizer.from_file(path)
        count = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    else:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda text: len(processor.encode(text))
    got = tokencounts.token_counts(edges.table(spark), path, limit=70)
    assert got.columns[:4] == ["doc_id", "text", "lang", "source"] and got.columns[-3:] == tokencounts.COUNTS
    wanted = Counter((i, len((t or "").encode()), count(t or ""), count(t or "") > 70) for i, t, *_ in edges.rows())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == wanted
    assert tokencounts.token_counts(edges.none(spark), path).count() == 0


def steps_by_hand(rows, labels):
    """Run every order of the filters over every document."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    good, toxic = good - {None}, toxic - {None}
    parts = defaultdict(list)
    for ident, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": ident is not None and any(i is not None and i < ident and (t or "") == text for i, t, _ in rows),
        }
        parts[part or ""].append((ident, {f for f in "ABCDE" if fails[f]}))
    out = {}
    for part, docs in parts.items():
        sums = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                sums[f] += len(gone)
                failing = sum(f in d[1] for d in docs)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in docs),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                ]
        for (name, order, step), row in out.items():
            if name == part:
                row.append(sums[order[step - 1]])
    return sorted((*key, *row) for key, row in out.items())


def test_interactions_equal_running_every_order(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["BIG", "#x", "Cap"]
    texts = [" ".join(draw.choices(words[: draw.choice([5, 60, 403])], k=draw.choice([3, 99, 100, 150]))) for _ in range(40)] + [None, "", "same " * 200]
    rows = [(draw.choice([None] + list(range(60))), draw.choice(texts), draw.choice(["en", "de", None, ""])) for _ in range(150)]
    rows += [(i, "hot copy " * 60, "en") for i in range(100, 160)] + rows[:5]
    labels = [(draw.choice([None] + list(range(90))), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    given_labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = interactions.filter_interactions(docs, given_labels)
    assert sorted(map(tuple, got.collect())) == steps_by_hand(rows, labels)


def test_interactions_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (14, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = interactions.filter_interactions(edges.table(spark), labels)
    assert sorted(map(tuple, got.collect())) == steps_by_hand([r[:3] for r in edges.rows()], [(1, 1, 0), (1, 0, 0), (14, 1, 1)])
    assert interactions.filter_interactions(edges.table(spark), labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0
    assert interactions.filter_interactions(edges.none(spark), labels).count() == 0


def test_path_counts_cover_every_order():
    reaching, leaving = interactions.path_counts(5)
    assert reaching[31] == leaving[0] == 120
    for size in range(6):  # every order passes one state of each size
        assert sum(reaching[s] * leaving[s] for s in range(32) if s.bit_count() == size) == 120
