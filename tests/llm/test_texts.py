"""Quality rules, secret scans, license scans, mixing."""

import hashlib
import re
from collections import Counter

import edges
import pytest
from pyspark.sql import functions as F

from tagmill.llm import licenses, mixing, quality, secrets
from tagmill.storage import fresh_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_quality_counts_equal_brute_force(spark):
    docs = edges.table(spark)
    got = quality.quality_rules(docs).collect()
    assert sorted(tuple(r[c] for c in quality.COUNTS) for r in got) == sorted(counts(r[1]) for r in edges.rows())
    for row in got:
        failed = row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words
        assert row.base_failed == failed and (not failed or not row.kept)
    assert quality.quality_rules(edges.none(spark)).count() == 0


def test_quality_rejects_far_documents_of_a_group_only(spark):
    clean = [(i, " ".join(f"word{(i * 7 + k) % 997}" for k in range(50)), "en", "a") for i in range(200)]
    junk = [(1000 + i, " ".join(f"word{k}###" for k in range(50 + i)), "en", "a") for i in range(5)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[1000 + i] for i in range(5))


def test_every_fence_rejects_on_its_side(spark):
    word = lambda i: f"word{i % 997}"
    clean = [(i, " ".join(word(i * 7 + k) for k in range(50)), "en", "a") for i in range(200)]
    lines = [f"{word(3 * k)} {word(3 * k + 1)} {word(3 * k + 2)}" for k in range(7)]
    far = {
        "symbols": " ".join(word(k) + "#" * (k % 4 == 0) for k in range(100)),
        "dup_lines": "\n".join([*lines, *lines[:5:2]]),
        "repeats": " ".join(map(word, [*range(90), *range(10)])),
        "long": " ".join(f"{10 ** (11 + k % 2) + k}" for k in range(50)),
        "short": " ".join("abcdefghijklmnopqrstuvwxyz0123456789"),
    }
    rows = clean + [(1000 + i, text, "en", "a") for i, text in enumerate(far.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert all(got[i].kept for i in range(200))
    before = {r["doc"].doc_id: r.kept for r in quality.judged(quality.measured(docs)).collect()}
    for i, side in enumerate(far):
        assert not got[1000 + i].base_failed and not got[1000 + i].kept and before[1000 + i], side


def test_sketch_cells_hold_their_values(spark):
    values = spark.range(0, 5_000_000, 9_973).withColumn("cell", quality.cell(F.col("id")))
    assert values.where("cell > id OR id - cell > id / 32").count() == 0


def spans(text, rules=secrets.RULES):
    found = []
    for place, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), place, rule.kind, m.end()))
    return sorted(found)


def test_secrets_equal_brute_force(spark):
    docs = edges.table(spark)
    got = secrets.scan_secrets(docs)
    found = sorted((r.doc_id or 0, [(f.start, f.place, f.kind, f.end) for f in r.findings]) for r in got.collect())
    assert found == sorted((r[0] or 0, spans(r[1])) for r in edges.rows())
    assert secrets.scan_secrets(edges.none(spark)).count() == 0
    masked = {r.doc_id: r.m for r in got.withColumn("m", secrets.masked(F.col("text"), F.col("findings"))).collect()}
    assert masked[8] == 'x <secret>" <secret> secret:short <secret>' and masked[2] is None and masked[6] == "one two three"


def test_a_failing_match_still_takes_its_text(spark):
    text = "token=secret:abcdefghijklmnop password=secret=abcdefghijkl API_KEY : 'Ab0+/_.=-zzzz' é😀 AKIA" + "A" * 13 + " AKIA" + "B" * 14
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = secrets.scan_secrets(docs).first().findings
    assert [(f.start, f.place, f.kind, f.end) for f in found] == spans(text) and len(found) == 3


def test_ledger_scans_only_unseen_pairs(spark):
    docs = edges.table(spark)
    ledger = secrets.open_ledger(spark, fresh_path(spark, "ledger"))
    read = lambda: spark.read.schema(secrets.LEDGER).parquet(ledger)
    first = secrets.scan_secrets(docs, ledger).collect()
    blobs = {hashlib.sha256((r[1] or "").encode()).digest() for r in edges.rows()}
    assert sorted(bytes(r.blob) for r in read().collect()) == sorted(blobs)
    assert sorted(secrets.scan_secrets(docs, ledger).collect(), key=str) == sorted(first, key=str)
    assert read().count() == len(blobs)
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("token: 0123456789ABCDEFG")))
    secrets.scan_secrets(more, ledger)
    assert read().count() == len(blobs) + 1
    newer = (*secrets.RULES[:-1], secrets.RULES[-1]._replace(version=2))
    secrets.scan_secrets(docs, ledger, newer)
    latest = read().where(F.array_contains("rules", "jwt@2")).collect()
    assert len(latest) == len(blobs) and all(list(r.rules) == ["jwt@2"] for r in latest)


def base_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    found = [(i, label) for phrase, label in licenses.BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found}))


def test_license_places_equal_brute_force(spark):
    docs = edges.table(spark)
    many = "mit license mit license apache license " * 300 + "İ K mit licenSe general public license"
    more = docs.limit(1).withColumn("text", F.lit(many))
    got = licenses.license_scan(docs.unionByName(more)).collect()
    found = sorted(tuple(r[c] for c in licenses.RESULTS[:5]) for r in got if r.text is not None)
    assert found == sorted(base_of(t) for t in [r[1] for r in edges.rows()] + [many] if t is not None)
    missing = next(r for r in got if r.text is None)
    assert (missing.n_words, missing.n_base, missing.first_word, missing.base_labels, missing.labels, missing.score) == (0, 0, None, "", "", 0.0)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.license_scan(edges.none(spark)).count() == 0


def test_licence_notices_get_their_label(spark):
    rows = [(i, "some words before. " + t.text.title() + ". and after") for i, t in enumerate(licenses.TEMPLATES)]
    rows += [(100 + i, f"plain text number {i} about the public and general use of software") for i in range(30)]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for row in got:
        if row.doc_id < 100:
            assert licenses.TEMPLATES[row.doc_id].label in row.labels.split(",") and row.score > 0.9
        else:
            assert row.labels == "" and row.score == 0


def filled(sizes, weights=(3, 1, 2), percent=150, cap=2):
    """Targets by handing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = sum(sizes.values()) * percent / 100, dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and open_:
        unit = left / sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += unit * weight[s]
        left = sum(max(0, target[s] - cap * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("ranked", [4096, 4])
def test_mix_meets_its_targets(spark, monkeypatch, ranked):
    monkeypatch.setattr(mixing, "RANKED_ROWS", ranked)
    rows = [(i, "w " * (1 + i * 37 % 90), "big" if i % 3 else f"s{i % 7}") for i in range(600)] + [(601, None, None), (602, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    target, taken = filled(sizes), Counter()
    for row in got:
        assert row.source_size == sizes[row.source] and abs(row.target - target[row.source]) < 1e-6 * max(1, row.target)
        assert row.taken <= 2 * row.size and row.taken == row.copies * row.size
        taken[row.source] += row.taken
    assert all(abs(taken[s] - target[s]) <= 90 for s in sizes)
    assert sorted(got, key=str) == sorted(mixing.mixed(docs.repartition(7)).collect(), key=str)


def test_mix_of_odd_rows(spark):
    got = mixing.mixed(edges.table(spark)).collect()
    assert len(got) == len(edges.rows()) and all(r.taken <= 2 * r.size for r in got)
    assert {r.size for r in got if not (r.text or "").strip()} == {0}
    assert mixing.mixed(edges.none(spark)).count() == 0
    words = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mixed(words).collect()] == [0, 0]
