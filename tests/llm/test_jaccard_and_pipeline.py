"""The Jaccard join against brute force, components, and the pipeline against plain versions of its stages."""

import random
import re

import numpy as np
import pytest

from lumenpage.llm import jaccard, secrets
from lumenpage.llm.common import shared_dir
from lumenpage.llm.components import components

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            linked = sets[a] and sets[b] and 100 * inter >= percent * len(sets[a] | sets[b])
            if linked or rows[a][0] == rows[b][0]:
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted((rows[k][0], len(sets[k]), least[top(k)]) for k in range(len(rows)))


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(400))
    rows = []
    for family in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 12, 40, 90, 200]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            own = base.copy()
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    passage = " ".join(word() for _ in range(60))
    rows += [f"{' '.join(word() for _ in range(30))} {passage} {' '.join(word() for _ in range(20))}" for _ in range(25)]
    rows += ["", " \n\t", "one", "ONE", "one two", rows[0], rows[0].upper()]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "limit", "size", "percent"), [(1, (1000, 4_000_000), 4, 85), (2, (10, 1500), 4, 85), (3, (4, 200), 5, 80)])
def test_components_equal_brute_force(spark, seed, limit, size, percent):
    rows = fixture(seed)
    df = spark.createDataFrame([(*r, "k", 5) for r in rows], "doc_id long, text string, cell string, n int")
    got = sorted(tuple(r) for r in jaccard.jaccard_components(df, size=size, percent=percent, limit=limit).collect())
    assert got == brute(rows, size, percent)


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80), (3, 60), (4, 50)])
def test_regions_of_one_task_connect_what_is_near(seed, percent):
    """The in-task join against all pairs, with and without members that are connected already."""
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(25):
        base = rng.integers(0, 500, rng.integers(4, 60))
        for _ in range(rng.integers(1, 9)):
            own = base.copy()
            own[rng.integers(0, len(own), rng.integers(0, 6))] = rng.integers(0, 500)
            sets.append(np.unique(own).astype(np.uint64))
    ids = np.arange(len(sets)) * 3
    near = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]

    def parted(links, joined=()):
        label = list(range(len(sets)))
        for a, b in [*links, *((joined[0], x) for x in joined)]:
            label = [label[b] if x == label[a] else x for x in label]
        return [label.index(x) for x in label]

    assert parted([(a // 3, b // 3) for a, b in jaccard.join_sets(ids, sets, percent)]) == parted(near)
    settled = rng.random(len(sets)) < 0.3
    group = np.flatnonzero(settled).tolist()
    assert parted([(a // 3, b // 3) for a, b in jaccard.join_sets(ids, sets, percent, settled)], group) == parted(near, group)


def test_large_cells_are_cut_into_regions(spark, monkeypatch):
    """One hot group of near copies and one of texts that only share words: both are cut by pivots, and the result is exact."""
    rng = random.Random(21)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(60):
        own = base.copy()
        for _ in range(rng.randrange(0, 7)):
            own[rng.randrange(60)] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(own)))
    passes = []
    cut = jaccard._cut
    monkeypatch.setattr(jaccard, "_cut", lambda percent: passes.append(percent) or cut(percent))
    got = sorted(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), limit=(8, 900)).collect())
    assert got == brute(rows, 4, 85) and passes


def tables_of(monkeypatch):
    """Every working table of the join by its name."""
    tables, write = {}, jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, folder, name, **how: tables.setdefault(name, write(df, folder, name, **how)))
    return tables


@pytest.mark.parametrize("size", [4, 5])
def test_texts_that_share_a_passage_meet_only_if_their_sizes_fit(spark, monkeypatch, size):
    """what texts of different sizes share by chance makes no region, so it takes no disk."""
    tables, rows = tables_of(monkeypatch), []
    for k in range(60):
        passage = [f"p{k}_{x}" for x in range(30)]
        rows += [(2 * k, " ".join([*passage, *(f"a{k}_{x}" for x in range(20))])), (2 * k + 1, " ".join([*passage, *(f"b{k}_{x}" for x in range(80))]))]
    rows += [(200, rows[0][1] + " more"), (201, rows[1][1] + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard.one_of_each(df, size=size, percent=80)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(120))
    assert sorted(map(tuple, tables["met"].collect())) == [(0, 200), (1, 201)]


def test_windows_go_to_the_cells_in_turns(spark, monkeypatch):
    """the windows that move at once follow from the sets, and the result from all turns."""
    tables, rows = tables_of(monkeypatch), fixture(6)
    monkeypatch.setattr(jaccard, "TURN", 0.05)
    got = sorted(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows, 4, 85) and "hopeful-1" in tables


def test_a_cell_that_is_crowded_by_chance_moves_no_whole_sets(spark, monkeypatch):
    """a long text that shares a passage with each of many; only two of them are near."""
    tables, first = tables_of(monkeypatch), [f"c{x}" for x in range(1500)]
    rows = [(0, " ".join(first))]
    for k in range(1, 41):
        rows.append((k, " ".join([*first[30 * k : 30 * k + 40], *(f"u{k}_{x}" for x in range(1460))])))
    rows.append((41, rows[7][1] + " more"))
    got = sorted(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), limit=(8, 4_000_000)).collect())
    assert got == [(k, len(shingles(t, 4)), 7 if k == 41 else k) for k, t in rows]
    assert tables["met"].where("cell = 0").count() > 16
    assert {r["id"] for r in tables["merged"].collect()} == {7, 41}


def test_groups_of_any_size_against_brute_force_with_few_blocks(spark, monkeypatch):
    """Cells beyond BLOCKED go on whole."""
    rows = fixture(7)
    monkeypatch.setattr(jaccard, "BLOCKED", 2)
    got = sorted(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), limit=(4, 900)).collect())
    assert got == brute(rows, 4, 85)


def test_a_text_of_several_megabytes_is_one_set(spark):
    rng = random.Random(22)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    other = words.copy()
    other[150_000] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:200_000]))]
    assert len(rows[0][1]) > 2 << 20
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(shingles(t, 4)), 1 if i < 3 else 3) for i, t in rows}


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (3, "A b c d e"), (None, "a b c d e"), (None, None), (9, None)], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in jaccard.jaccard_components(df).collect())))
    assert got == sorted(map(str, [(5, 2, 3), (5, 2, 3), (3, 2, 3), (None, 2, None), (None, 0, None), (9, 0, 9)]))
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    assert sorted(str(r["doc_id"]) for r in jaccard.one_of_each(df).collect()) == ["3", "9", "None", "None"]


@pytest.mark.parametrize(("seed", "limit"), [(4, (1000, 4_000_000)), (5, (5, 1500))])
def test_rows_of_one_doc_id_with_different_texts_keep_all_their_links(spark, seed, limit):
    rng = random.Random(seed)
    texts = [t for _, t in fixture(seed)]
    rows = [(k if rng.random() < 0.8 else rng.randrange(len(texts)), t) for k, t in enumerate(texts)]
    first, second = ([f"{w}{k}" for k in range(40)] for w in "xy")
    near = [*second[:39], "z"]
    rows += [(1001, " ".join(first)), (1003, " ".join(first)), (1003, " ".join(second)), (1003, ""), (1005, " ".join(near)), (1007, "p q r s"), (1007, " ".join(near[1:]))]
    got = sorted(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit).collect())
    assert got == brute(rows, 4, 85)
    assert {r[2] for r in got if r[0] > 1000} == {1001}


def test_only_near_copies_go_where_a_doc_id_has_several_texts(spark):
    first, second, third = (" ".join(f"{w}{k}" for k in range(40)) for w in "xyz")
    rows = [(1, first), (3, first), (3, second), (3, third), (3, third.upper()), (3, ""), (3, None), (5, f"{second} more"), (7, "p q r s t"), (7, "p q r s t"), (8, f"{third} more"), (9, "u v w x y"), (None, first)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = jaccard.one_of_each(df, size=5, percent=80)
    assert kept.columns == df.columns
    got = [(str(r["doc_id"]), (r["text"] or "").lower()) for r in kept.collect()]
    assert sorted(got) == sorted([("1", first), ("3", second), ("3", third), ("3", ""), ("7", "p q r s t"), ("9", "u v w x y"), ("None", first)])


def test_components_of_chains_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200 + k, 200 + (k + 1) % 9) for k in range(9)] + [(7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long"), shared_dir(spark)).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys(range(200, 209), 200)}


def test_pipeline_keeps_what_plain_versions_of_its_stages_keep(spark, tmp_path):
    rng = random.Random(11)
    prose = lambda n: " ".join("v" + str(rng.randrange(3000)) for _ in range(n))
    item = prose(30)
    docs, toxic = [], set()
    for i in range(400):
        text = prose(rng.randrange(40, 90))
        if i % 6 == 0:
            text, _ = text + " vileword vileword2"[: 9 if i % 12 else 19], toxic.add(i)
        docs.append((i, text))
    docs += [(400 + k, docs[1][1]) for k in range(3)] + [(410, docs[2][1] + " extra"), (411, f"{prose(9)} {item} {prose(9)}"), (412, 'x token = "abcdef123456" y ' + prose(50)), (413, None), (414, "")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, at = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        at = spark.read.parquet(f"{tmp_path}/out{k}")
        assert at.columns == table.columns
        kept[name] = {r["doc_id"]: r["text"] for r in at.collect()}
    first = {i: t for i, t in docs if i not in toxic}
    assert kept["toxicity"] == first
    linked = brute([(i, t) for i, t in first.items()], 5, 80)
    second = {i for i, _, c in linked if i == c}
    assert set(kept["ngram_jaccard_join"]) == second and {400, 401, 402, 410}.isdisjoint(second)
    third = {i for i in second if item not in (first[i] or "")}
    assert set(kept["benchmark_decontamination"]) == third and 411 not in third
    assert kept["secret_scan"] == {i: secrets.redact(first[i]) for i in third} and "abcdef123456" not in kept["secret_scan"][412]
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == third and packed.groupby("sequence_id").length.sum().max() <= 1024
