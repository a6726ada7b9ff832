"""The stages against plain Python over a small table."""

import re
import zlib
from collections import Counter

import edges
import numpy as np
import public_tokenizers
from test_groups import least_reachable, shingles
from test_texts import counts, filled, spans
from tokenizers import Tokenizer

import corpus_pipeline
from tagmill.llm import quality
from tagmill.storage import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark):
    rows = [r[:5] for r in edges.rows()]
    rows += [(100 + i, " ".join(f"{w}{(i * 13 + k) % 83}" for k, w in enumerate(["ab", "cd", "ef"] * 30)), "en", f"s{i % 4}", 0) for i in range(40)]
    rows += [(200, rows[20][1] + " more", "en", "s1", 0), (201, rows[21][1] + ' token = "abcdefABCDEF12345678"', "en", "s2", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_equal_plain_python(spark):
    docs = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    good = settle(stages[names[0]](spark, docs, None), "t")
    verdicts = [r.doc_id for r in quality.quality_rules(docs).where("kept").collect()]
    assert Counter(r.doc_id for r in good.collect()) == Counter(verdicts)
    assert all(counts(r.text)[0] >= 20 for r in good.collect()) and good.columns == COLUMNS

    single = settle(stages[names[1]](spark, good, None), "t")
    rows = [r for r in good.collect() if r.doc_id is not None]
    sets = {r.doc_id: shingles(r.text, 5) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    kept = sorted(set(least_reachable(sets, links).values()))
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == kept and len(kept) < len(rows)
    assert single.where("doc_id IS NULL").count() == 1

    clean = settle(stages[names[2]](spark, single, None), "t")
    before = {r.doc_id: r.text for r in single.collect()}
    for row in clean.collect():
        text, at, out = before[row.doc_id], 0, ""
        for start, _, _, end in spans(text):
            if start >= at:
                out += text[at:start] + "<secret>"
            at = max(at, end)
        assert row.text == out + text[at:]

    mix = settle(stages[names[3]](spark, clean, None), "t")
    sizes, taken = Counter(), Counter()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for row in clean.collect():
        sizes[row.source] += words(row.text)
    for row in mix.collect():
        taken[row.source] += words(row.text)
    longest = max(words(r.text) for r in clean.collect())
    assert all(abs(taken[s] - t) <= longest for s, t in filled(sizes).items())
    assert max(Counter(r.doc_id for r in mix.collect()).values()) <= 2

    packed = stages[names[4]](spark, mix, None).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter()
    for row in mix.collect():
        wanted[row.doc_id, np.array(coder.encode(row.text, add_special_tokens=False).ids + [2], "<u4").tobytes()] += 1
    found, texts = Counter(), {}
    for row in packed:
        assert zlib.crc32(row.ids) == row.ids_crc32
        found[row.doc_id, row.piece, bytes(row.ids)] += 1
    for (doc, raw), times in wanted.items():
        cut = len(raw) % 4096
        parts = ([raw[:cut]] if cut else []) + [raw[i : i + 4096] for i in range(cut, len(raw), 4096)]
        texts.update({(doc, i, part): times for i, part in enumerate(parts)})
    assert found == Counter(texts)


def test_an_empty_table_passes_through(spark, tmp_path):
    documents(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_unrelated_texts_of_one_id_all_stay(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    texts = [(1, text(1)), (1, text(2)), (1, text(2)), (1, text(3)), (1, text(3) + " more"), (2, text(3)), (2, text(4)), (None, text(1)), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    found = [(r.doc_id or 0, r.text) for r in stage(spark, docs, None).collect()]
    again = [(r.doc_id or 0, r.text) for r in stage(spark, docs.repartition(3, "text"), None).collect()]
    third = [t for i, t in found if t.startswith("w3x0")]
    assert sorted(found) == sorted(again) and len(third) == 1
    assert sorted(found) == sorted([(1, text(1)), (1, text(2)), (1, third[0]), (2, text(4)), (0, text(1)), (3, "")])
