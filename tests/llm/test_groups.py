"""Near duplicates among texts and vectors, components."""

import math
import os
import random
import re

import edges
import numpy as np
import pytest

from tagmill.llm import neardup, vectordup
from tagmill.llm.graph import components
from tagmill.storage import SHUFFLE_CLEANUP, work_dir


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 3), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == least_reachable({n for x in links for n in x}, links)


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def texts_with_copies(seed):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(400)}"
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(draw.choice([2, 4, 6, 9, 15, 30, 80, 200]))]
        if draw.random() < 0.4:
            base += passage  # a passage that many share
        rows.append(" ".join(base))
        for _ in range(draw.randrange(7)):
            copy = list(base)
            for _ in range(draw.randrange(4)):
                at = draw.randrange(len(copy))
                copy[at : at + draw.randrange(2)] = [word()]
            rows.append(" ".join(copy).title() if draw.random() < 0.3 else "  ".join(copy))
    return rows


@pytest.mark.parametrize("seed,words,percent", [(1, 4, 85), (2, 5, 80), (3, 1, 70)])
def test_jaccard_components_equal_brute_force(spark, seed, words, percent):
    texts = texts_with_copies(seed) + ["", None, "  ", "A b", "a  B"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = {i: shingles(t, words) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    got = neardup.near_duplicates(docs, neardup.Likeness(words, percent)).collect()
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == least_reachable(sets, links)


def test_join_takes_its_own_tables_away(spark):
    folder, usual = work_dir(spark).removeprefix("file:"), spark.conf.get(SHUFFLE_CLEANUP)
    names = lambda: {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    docs = spark.createDataFrame(list(enumerate(texts_with_copies(4))), "doc_id long, text string")
    before = set(os.listdir(folder))
    got = neardup.near_duplicates(docs)
    assert names() == {"sets", "moved"} and spark.conf.get(SHUFFLE_CLEANUP) == usual
    assert any(r.doc_id != r.component_id for r in got.collect())


def test_traversal_alone_finds_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts_with_copies(4))), "doc_id long, text string")
    found = lambda: sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect())
    usual = found()
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    assert found() == usual and any(a != b for a, b in usual)


def test_alike_texts_without_links_meet_once_and_are_not_compared(spark, monkeypatch):
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base[: 15 * k] + [f"own{k}x{i}" for i in range(36)] + base[15 * k + 36 :]) for k in range(16)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, write = {}, neardup.settle

    def settle(df, name="table"):
        out = write(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    compared, exact = [], neardup.linked

    def linked(pairs, tokens, percent):
        compared.append(pairs.count())
        return exact(pairs, tokens, percent)

    monkeypatch.setattr(neardup, "settle", settle)
    monkeypatch.setattr(neardup, "linked", linked)
    assert all(r.component_id == r.doc_id for r in neardup.near_duplicates(docs).collect())
    assert rows["open"][0] > 16  # they share many nodes
    assert rows["members"] == [16] and sum(compared) == 0


def test_bounds_keep_every_linked_pair(spark):
    draw = random.Random(5)
    sizes = [(draw.randrange(1, 400), draw.randrange(1, 400), draw.random()) for _ in range(300)]
    sets = []
    for left, right, share in sizes:
        both = {draw.getrandbits(63) for _ in range(int(min(left, right) * (0.7 + 0.3 * share)))}
        sets += [both | {draw.getrandbits(63) for _ in range(n - len(both))} for n in (left, right)]
    words = [[0] * neardup.BITMAP for _ in sets]
    for own, tokens in zip(words, sets):
        for place in (t % (64 * neardup.BITMAP) for t in tokens):
            own[place // 64] |= 1 << place % 64
    signed = [[w - (1 << 64) if w >> 63 else w for w in own] for own in words]
    maps = [(c, len(t), *signed[c], sum(w.bit_count() for w in words[c])) for c, t in enumerate(sets)]
    maps = spark.createDataFrame(maps, "c long, n long, " + "".join(f"b{i} long, " for i in range(neardup.BITMAP)) + "bits int")
    pairs = [(a, a + 1) for a in range(0, len(sets), 2)]
    got = {(r.a, r.b) for r in neardup.plausible(spark.createDataFrame(pairs, "a long, b long"), maps, 85).collect()}
    links = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert links and links <= got < set(pairs)


def test_region_counts_exceed_what_linked_sets_can_differ():
    for percent in (70, 80, 85, 95):
        ranges = neardup.Ranges(percent)
        for large in range(1, 400):
            for small in range(1, large + 1):
                # Largest difference of linked sets of these sizes.
                common = -(-percent * (small + large) // (100 + percent))
                if common <= small:
                    index = ranges.of(large)
                    assert index in (ranges.of(small), ranges.of(small) + 1)
                    assert small + large - 2 * common < ranges.regions(index)
                    assert small + large - 2 * common <= min(ranges.differing(small, index), ranges.differing(large, index))


@pytest.mark.parametrize("percent", [55, 70, 80, 85, 95])
def test_linked_sets_share_a_node(percent):
    draw = np.random.default_rng(percent)
    ranges, linked = neardup.Ranges(percent), 0
    numbers = lambda count: draw.integers(0, 2**63, count).astype(np.uint64)
    while linked < 400:
        a = np.unique(numbers(draw.integers(2, 150)))
        gone, more = draw.integers(0, len(a) // 2 + 1, 2)
        b = np.unique(np.concatenate((a[gone:], numbers(more))))
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (len(a) + len(b) - common) and len(a) + len(b) > 2 * common:
            linked += 1
            assert len(np.intersect1d(neardup.node_keys(a, ranges), neardup.node_keys(b, ranges)))


def test_keys_grow_with_the_set_only():
    draw = np.random.default_rng(6)
    for percent, share in ((70, 2.5), (80, 1.0), (95, 0.3)):
        ranges = neardup.Ranges(percent)
        for size in (40, 160, 1000, 4000, 5000, 5600):
            keys = [len(neardup.node_keys(np.sort(draw.integers(0, 2**63, size).astype(np.uint64)), ranges)) for _ in range(5)]
            assert np.mean(keys) < share * size


def test_copies_under_few_ids_give_one_profile_each(spark):
    texts = [" ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(58))]
    docs = spark.createDataFrame([(i % 2, texts[i % 2]) for i in range(200)] + [(5, "a b c d e f g")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(0, 0), (1, 0), (5, 5)}


def test_near_duplicates_of_odd_rows(spark):
    got = neardup.near_duplicates(edges.table(spark)).collect()
    assert len(got) == len(edges.rows())
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[14] == by_id[13] == 13 and by_id[2] == 2 and by_id[3] == 3 and by_id[None] is None
    assert neardup.near_duplicates(edges.none(spark)).count() == 0


def clumps(seed, width=16):
    draw = np.random.default_rng(seed)
    rows = []
    for size in (1, 1, 1, 2, 3, 5, 120):
        centre = draw.normal(size=width)
        rows += [(centre + draw.normal(size=width) * draw.choice([0.05, 0.25, 0.4]) * np.linalg.norm(centre) / 4).tolist() for _ in range(size)]
    rows += draw.normal(size=(150, width)).tolist()
    rows += [rows[0], rows[0], [0.0] * width, [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), None, [], rows[3][:5], [1e200] * width, [1e-200] * width]
    return rows


def test_vector_links_equal_brute_force(spark):
    rows = list(enumerate(clumps(3)))
    got = vectordup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    usable = {i: np.array(v) / np.abs(v).max() for i, v in rows if v and all(map(math.isfinite, v)) and any(v)}
    cosine = lambda x, y: float(x @ y / math.sqrt((x @ x) * (y @ y)))
    links = [(a, b) for a, x in usable.items() for b, y in usable.items() if a != b and len(x) == len(y) and cosine(x, y) >= 0.9]
    found = {r.vec_id: r.n_links for r in got}
    wanted = {i: sum(a == i for a, _ in links) for i, _ in rows}
    assert sum(found.values()) >= 0.99 * sum(wanted.values()) and all(found[i] <= wanted[i] for i in wanted)
    reach = least_reachable([i for i, _ in rows], links)
    assert {r.vec_id: r.component_id for r in got} == reach
    assert all(r.kept == (r.vec_id == reach[r.vec_id]) for r in got)


def test_vectors_in_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, n_links string, class int, digest int, id int"
    assert vectordup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], "x", 1, 1, 1), (1, [1.0, 0.0], "x", 1, 1, 1), (None, [1.0, 0.0], "x", 1, 1, 1), (2, [0.0, 1.0], "x", 1, 1, 1), (3, [None, 1.0], "x", 1, 1, 1)]
    got = vectordup.near_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, False), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_graph_recall_against_brute_force():
    draw = np.random.default_rng(1)
    base = draw.normal(size=(400, 32))
    rows = np.concatenate((base, base + draw.normal(size=base.shape) * 0.2))
    units = vectordup.unit_rows(rows.astype("<f8").tobytes(), 32)
    options = vectordup.Settings()
    graph = vectordup.Graph.load(vectordup.built(units, np.arange(len(units)), options).dump(), options)
    found = vectordup.asked(graph, units, units, options)
    wanted = [np.flatnonzero(units @ q >= options.least) for q in units]
    assert sum(len(np.intersect1d(a, b)) for a, b in zip(found, wanted, strict=True)) >= 0.9 * sum(map(len, wanted))


def share_found(found, wanted):
    return sum(len(np.intersect1d(a, b)) for a, b in zip(found, wanted, strict=True)) / sum(map(len, wanted))


def rare_pairs_and_a_clump(shard, width=24):
    """A shard, and queries of which only some between the audited ones have a link, beside some in the clump."""
    draw = np.random.default_rng(7)
    centre = draw.normal(size=width)
    rows = draw.normal(size=(shard, width))
    rows[: shard // 5] = centre + draw.normal(size=(shard // 5, width)) * 0.1
    draw.shuffle(rows)
    units = vectordup.unit_rows(rows.tobytes(), width)
    queries = draw.normal(size=(1000, width))
    audited = set(np.linspace(0, 999, vectordup.Settings().audited).astype(int).tolist())
    other = [i for i in range(1000) if i not in audited]
    queries[other[::9]] = units[: len(other[::9])] + draw.normal(size=(len(other[::9]), width)) * 0.04
    return units, vectordup.unit_rows(queries.tobytes(), width)


def test_unaudited_links_are_found_by_a_poor_graph():
    units, queries = rare_pairs_and_a_clump(2000)
    options = vectordup.Settings(neighbours=3, build_beam=3, beam=2)
    wanted = [np.flatnonzero(units @ q >= options.least) for q in queries]
    rare = [i for i, nodes in enumerate(wanted) if 0 < len(nodes) < 5]
    found = vectordup.asked(vectordup.built(units, np.arange(len(units)), options), units, queries, options)
    assert len(rare) > 50 and share_found(found, wanted) >= 0.97
    assert share_found([found[i] for i in rare], [wanted[i] for i in rare]) >= 0.95


def test_a_graph_that_cannot_pass_is_compared_exactly():
    draw = np.random.default_rng(2)
    units = vectordup.unit_rows(draw.normal(size=(300, 8)).tobytes(), 8)
    options = vectordup.Settings()
    graph = vectordup.built(units, np.arange(300), options)
    graph.layers = [{node: np.empty(0, np.int64) for node in layer} for layer in graph.layers]
    turned, wanted = vectordup.probes(units, options)
    found = vectordup.asked(graph, units, turned, options)
    assert all(len(nodes) for nodes in wanted) and all(map(np.array_equal, found, wanted))


def test_the_link_of_a_query_to_itself_is_no_audit():
    units = vectordup.unit_rows(np.random.default_rng(4).normal(size=(200, 16)).tobytes(), 16)
    options, seen = vectordup.Settings(), []
    graph = vectordup.built(units, np.arange(200), options)
    graph.near = lambda query, least, beam: seen.append(beam) or [int((units @ query).argmax())]
    units_linked = sum(map(len, vectordup.linked(units, units, options.least)))
    vectordup.asked(graph, units, units, options, np.arange(200))
    assert units_linked == 200 and len(seen) == 200  # nothing to audit: every query is asked once


def test_large_sets_use_all_their_regions():
    tokens = np.sort(np.random.default_rng(3).integers(0, 2**63, 5000, np.int64).astype(np.uint64) * np.uint64(2))
    ranges = neardup.Ranges(80)
    own = ranges.of(len(tokens))
    regions = ranges.regions(own) + ranges.regions(own + 1)
    assert regions > 1000 and len(neardup.node_keys(tokens, ranges)) > 0.8 * regions
