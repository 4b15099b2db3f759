"""Near-dedup of similar texts against the similarity of all pairs."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewise.llm import similar

from .conftest import awkward_rows, words
from .test_dedup import plain_shingles

SIMILARITY = 0.8


def alike_pairs(rows):
    """All pairs of row numbers with the similarity, by shared shingles; texts with equal sets among them."""
    sets, of, pairs = [frozenset(plain_shingles(t or "", 5)) for t in rows], defaultdict(list), set()
    for i, s in enumerate(sets):
        for x in s or {None}:
            of[x].append(i)
    shared = Counter((i, j) for held in of.values() for a, i in enumerate(held) for j in held[a + 1 :])
    for (i, j), n in shared.items():
        if not sets[i] and not sets[j] or sets[i] and n >= SIMILARITY * (len(sets[i]) + len(sets[j]) - n):
            pairs.add((i, j))
    return pairs


def check(rows, kept):
    """Of rows (id, text): all that went are linked, by alike pairs, to one that stayed before them; no two that stayed are alike.

    Returns how many pairs of those that stayed are alike after all, which min-hashes and fingerprints missed.
    """
    pairs, up = alike_pairs([t for _, t in rows]), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    stays = {i for i, (x, _) in enumerate(rows) if x in kept}
    for i in set(range(len(rows))) - stays:
        assert any(root(j) == root(i) and rows[j][0] < rows[i][0] for j in stays), rows[i]
    return sum(i in stays and j in stays for i, j in pairs), len(pairs)


def edited(text, rate, seed):
    rng = np.random.default_rng(seed)
    return " ".join(f"x{rng.integers(0, 10**6)}" if rng.random() < rate else w for w in text.split())


def planted():
    texts = [words(150, i) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i, t in enumerate(texts):
        for k, rate in enumerate((0.005, 0.01, 0.02, 0.03, 0.05, 0.08)):
            rows.append((100 + 10 * i + k, edited(t, rate, 10 * i + k)))
    rows += [(1000 + i, edited(texts[0], 0.004, i)) for i in range(150)]
    # Half of each text is shared: far below the similarity, though many.
    shared = words(100, 999)
    return rows + [(2000 + i, f"{words(100, 3000 + i)} {shared}") for i in range(60)]


@pytest.mark.parametrize("block", [32_000_000, 20_000, 2_000])
def test_only_alike_texts_go(spark, block, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_BYTES", block)
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in similar.keep_one(df).collect()}
    missed, pairs = check(rows, kept)
    assert pairs > 10_000 and missed == 0
    assert {2000 + i for i in range(60)} <= kept and len({1000 + i for i in range(150)} & kept) < 5


def test_awkward_tables(spark, docs, clashing, empty):
    # 10 and 11 are alike, too: one has a word more. Of copies the smallest id stays.
    stay = {(1, 0), (2, 1), (4, 4), (7, 7), (None, 10), (9, 11), (10, 12), (12, 14), (13, 15)}
    want = {(i, awkward_rows()[at][1]) for i, at in stay}
    for df in (docs, clashing):
        kept = similar.keep_one(df)
        assert kept.columns == df.columns and {(r.doc_id, r.text) for r in kept.collect()} == want and kept.count() == len(want)
    assert similar.keep_one(empty).count() == 0
    one = spark.createDataFrame([(None, "a b c"), (None, "a  b c"), (None, None), (5, "")], "doc_id long, text string")
    assert sorted(map(tuple, similar.keep_one(one).collect()), key=repr) == [(5, ""), (None, "a  b c")]


def test_leaders_are_those_of_a_loop():
    rng = np.random.default_rng(0)
    base = [np.unique(rng.integers(0, 10**6, 60).astype(np.uint32)) for _ in range(12)]
    sets = [np.unique(np.r_[b[rng.random(len(b)) < 0.95], rng.integers(0, 10**6, 2).astype(np.uint32)]) for b in base for _ in range(40)]
    fps = rng.integers(0, 2**63, 12, np.uint64).repeat(40) ^ (np.uint64(1) << rng.integers(0, 63, 480).astype(np.uint64))
    order = rng.permutation(480)
    sets, fps = [sets[i] for i in order], fps[order]
    leads, want = [], []
    for i in range(480):
        near = (j for j in leads if int(fps[i] ^ fps[j]).bit_count() <= 20 and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j])))
        want.append(next(near, i))
        if want[-1] == i:
            leads.append(i)
    assert similar.stars(fps, sets, similar.SIMILAR).tolist() == want and 12 <= len(leads) < 480


def test_documents_of_a_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").isNotNull())
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    missed, pairs = check(rows, {r.doc_id for r in similar.keep_one(df).collect()})
    assert pairs and missed <= 0.05 * pairs


def chains():
    """Chains of texts, each alike to the next ones only, among longer and shorter ones and texts that share much less."""
    rows = []
    for chain in range(60):
        rng, text = np.random.default_rng(chain), words(20 + 6 * chain, 7000 + chain).split()
        for k in range(6):
            text = list(text)
            for at in rng.integers(0, len(text), 1 + len(text) // 100):
                text[at] = f"y{chain}x{k}x{at}"
            rows.append((chain * 10 + k, " ".join(text)))
    shared = words(60, 998)
    return rows + [(5000 + i, f"{words(60, 4000 + i)} {shared}") for i in range(40)]


def components_of(rows):
    pairs, up = alike_pairs([t for _, t in rows]), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if up[i] == i}


@pytest.mark.parametrize("listed", [8192, 2])
def test_groups_are_the_components_of_all_links(spark, listed, monkeypatch):
    if hasattr(similar, "LIST_NODES"):
        monkeypatch.setattr(similar, "LIST_NODES", listed)
    rows = chains()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in similar.keep_one(df).collect()} == components_of(rows)


def test_cells_that_shrink_to_one_block_are_settled(spark, monkeypatch):
    """A cell of near copies shrinks to one block while one of texts that are not alike does not shrink."""
    monkeypatch.setattr(similar, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(similar, "described", lambda t, link, real=similar.described: (*real(t, link)[:2], np.array([1 if t.startswith("s") else 2]), real(t, link)[3]))
    rng = np.random.default_rng(3)
    copy = " ".join(f"s{i}" for i in range(100))
    rows = [(i, f"{copy} z{i}") for i in range(20)] + [(100 + i, " ".join(f"t{rng.integers(0, 10**9)}" for _ in range(60))) for i in range(300)]
    link = similar.SIMILAR
    made = [(i, *similar.described(t, link)) for i, t in rows]
    df = spark.createDataFrame([(i, n, int(np.uint64(f).view(np.int64)), [int(k) for k in keys], held) for i, n, f, keys, held in made], "id long, node binary, fp long, keys array<long>, shingles binary")
    found = {(bytes(r.u), bytes(r.v)) for r in similar.edges(df, link).collect()}
    hung = {u for u, _ in found}
    assert sum(bytes(n) not in hung for i, n, *_ in made if i < 100) == 1


def test_pairs_by_sizes_and_parities_miss_none():
    rng, link = np.random.default_rng(5), similar.SIMILAR
    sets = []
    for size in (1, 3, 5, 9, 40, 300, 1500):
        for _ in range(3):
            base = np.unique(rng.integers(0, 2**32, size, np.uint32))
            sets += [base, *(np.unique(np.r_[base[rng.random(len(base)) < share], rng.integers(0, 2**32, len(base) // 20, np.uint32)]) for share in (0.97, 0.9, 0.85, 0.5))]
    sets = sorted((s for s in sets if len(s)), key=len)
    last = np.unique(np.concatenate(sets[::4]))
    fronts = [set(similar.front(s, last, link.similarity).tolist()) for s in sets]
    size, bits = np.array([len(s) for s in sets]), np.stack([np.frombuffer(similar.parities(s), np.uint64) for s in sets])
    each = np.arange(len(sets))
    near = {(int(x), int(y)) for a, b in similar.near_pairs(size, bits, each, np.zeros(len(sets), int), link.similarity) for x, y in zip(a, b)}
    true = {(i, j) for i in each.tolist() for j in range(i + 1, len(sets)) if similar.alike(sets[i], sets[j], link.similarity)}
    assert len(true) > 20 and true <= near and len(near) < 2 * len(true) and all(fronts[i] & fronts[j] for i, j in true)


def test_sketches_give_a_least_difference_of_large_sets_too():
    rng = np.random.default_rng(11)
    for size in (0, 1, 2, 8, 9, 300, 3000, 3700):
        for kept in (1, 0.99, 0.9, 0.5, 0):
            a = np.unique(rng.integers(0, 2**32, size, np.uint32))
            b = np.unique(np.r_[a[rng.random(len(a)) < kept], rng.integers(0, 2**32, int(size * (1.1 - kept)), np.uint32)])
            found = similar.least_difference(*(np.frombuffer(similar.sketch(s), np.uint8) for s in (a, b)))
            assert found <= len(np.setxor1d(a, b)), (size, kept)
            # Sets that share half of their elements or less are told apart, whatever their size.
            assert size < 300 or kept > 0.5 or found > (len(a) + len(b)) / 9
    assert all(len(similar.sketch(np.arange(n, dtype=np.uint32))) == n // 8 for n in (8, 1024))


def test_shingles_of_long_texts_that_share_little_stay_where_they_are(spark, monkeypatch):
    """Sets of 1,500 share a passage and so an element of their fronts; 256 parities can't part them."""
    moved, real = spark.sparkContext.accumulator(0), similar._checking

    def counting(link):
        run = real(link)

        def counted(batches):
            def seen():
                for batch in batches:
                    moved.add(len(batch))
                    yield batch

            return run(seen())

        return counted

    monkeypatch.setattr(similar, "_checking", counting)
    shared = words(60, 997)
    rows = [(i, f"{' '.join(f'w{i}x{k}' for k in range(1500))} {shared}") for i in range(30)]
    rows += [(100 + i, " ".join(f"v{k}" if k >= 90 * i else f"u{i}x{k}" for k in range(1500))) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in similar.keep_one(df).collect()} == components_of(rows) == {*range(30), 100}
    assert moved.value <= 2


def test_shuffle_files_of_what_is_written_are_deleted(spark):
    from tracewise.llm.common import cut

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(found.size()) if (f := found.apply(i).getName()).startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    df, before = spark.range(1000).groupBy(F.col("id") % 7).count(), spark.conf.get(name, None)
    for few in (False, True):
        held = files()
        made = cut(df, few=few, tidy=True)
        assert not files() - held
        assert made.count() == 7 and made.columns == df.columns
    held = files()
    cut(df)
    assert files() - held and spark.conf.get(name, None) == before
