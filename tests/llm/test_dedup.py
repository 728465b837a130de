"""Exact, near and substring dedup against plain versions, on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, minhash
from lectern.llm import substring_dedup as substring
from lectern.llm.exact_dedup import LsmIndex, exact_dedup
from lectern.llm.graph import connected_components
from lectern.llm.minhash import near_duplicates, superminhash
from lectern.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}
#: Extra columns clash with names that the operators use.
SCHEMA = "doc_id long, text string, id string, body string, kept string, digest string, batch int, batch_size double"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", "y", "z", "d", 1, 1.0) for i, t in rows], SCHEMA).repartition(parts)


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(40)}{rng.choice('abc')}" for _ in range(n)]


def awkward(seed=0):
    """Texts with copies, near copies, shared passages, blanks, one very long, and null ids and texts."""
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        rows.append((k, " ".join(words(rng.randint(5, 120), seed * 1000 + k))))
    base = words(100, 7)
    for k in range(60, 90):
        copy = list(base)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(1000)}"
        rows.append((k, " ".join(copy)))
    passage = " ".join(words(20, 11))
    rows += [(90 + k, f"{' '.join(words(9, 90 + k))}\n{passage}\t{' '.join(words(9, 190 + k))}") for k in range(8)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "One two THREE"), (105, "one two three"), (106, "é ü 漢字 end of it"), (107, "É ü 漢字 end of it")]
    rows += [(110, rows[3][1]), (2, rows[2][1]), (None, rows[4][1]), (None, "only without an id anywhere " * 5), (111, " ".join(words(30_000, 5))), (112, "x" * 100_000)]
    return rows


def plain_exact(rows, keep=max):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        stays = keep(known) if known else None
        out.append((i, stays, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(spark, keep):
    rows = awkward()
    found = exact_dedup(frame(spark, rows), keep=keep).withColumn("digest", F.lower(F.hex("digest"))).collect()
    assert sorted([(r.id, r.keep_id, r.group_size, r.digest) for r in found], key=str) == plain_exact(rows, max if keep == "largest" else min)
    kept = {}
    for r in found:
        kept[r.digest] = kept.get(r.digest, 0) + r.kept
    assert set(kept.values()) == {1}


def test_exact_of_nothing_and_of_one_text(spark):
    assert exact_dedup(frame(spark, []).limit(0)).count() == 0
    found = exact_dedup(frame(spark, [(k, "same") for k in range(500)]), keep="largest").collect()
    assert [(r.id, r.group_size) for r in found if r.kept] == [(499, 500)]


def test_exact_carries_columns_and_normal_forms(spark):
    docs = frame(spark, [(1, "A b"), (2, "a  B"), (3, None)])
    found = exact_dedup(docs, normalize=F.lower(F.regexp_replace("text", " +", " ")), payload=["batch_size"]).collect()
    assert {(r.id, r.kept, r.batch_size) for r in found} == {(1, True, 1.0), (2, False, 1.0), (3, True, 1.0)}
    assert {r.id: r.text for r in exact_dedup(docs, payload=["text"]).collect()} == {1: "A b", 2: "a  B", 3: None}


def test_appended_batches_equal_a_rebuild(spark, tmp_path):
    """Ten batches through merges of three runs; the index opened anew; an unfinished flush is not seen."""
    rng = random.Random(5)
    rows = [(rng.choice([None, rng.randrange(500)]), f"text {rng.randrange(120)}") for _ in range(600)]
    make = lambda part: spark.createDataFrame(part, "id long, text string").select("id", F.unhex(F.sha2("text", 256)).alias("digest")).repartition(2)
    path = f"file://{tmp_path}/index"
    index = LsmIndex(spark, path, fan_in=3)
    for k in range(10):
        index.append(make(rows[60 * k : 60 * k + 60]))
    assert max(level for level, *_ in index.runs) == 2 and len(index.runs) < 6
    # Files of merged runs and old manifests are gone.
    assert {p.name for p in (tmp_path / "index").iterdir()} == {*(r[1] for r in index.runs), "manifest-000000010"}
    index.flush(make([(1, "never committed")]))
    opened = LsmIndex.open(spark, path)
    rebuilt = LsmIndex(spark, f"file://{tmp_path}/rebuilt")
    rebuilt.flush(make(rows))
    shown = lambda df: sorted((bytes(r.digest), r.least, r.most, r.n, r.n_ids) for r in df.collect())
    want = shown(rebuilt.compacted())
    assert shown(opened.compacted()) == want
    own = {}
    for i, t in rows:
        own.setdefault(hashlib.sha256(t.encode()).digest(), []).append(i)
    least = lambda ids, f: f([i for i in ids if i is not None], default=None)
    assert want == sorted((d, least(ids, min), least(ids, max), len(ids), sum(i is not None for i in ids)) for d, ids in own.items())


def test_lookups_read_the_runs_that_filters_allow_alone(spark, tmp_path):
    make = lambda texts: spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").select("id", F.unhex(F.sha2("text", 256)).alias("digest"))
    index = LsmIndex(spark, f"file://{tmp_path}/index", fan_in=9)
    for batch in range(4):
        index.append(make([f"batch {batch} text {k}" for k in range(200)]))
    asked = make(["batch 2 text 7", "batch 2 text 9", "nowhere"])
    assert sorted(r.least for r in index.lookup(asked).collect()) == [7, 9]
    assert index.read_runs == [index.runs[2][1]]
    assert index.lookup(make(["nowhere"])).count() == 0 and index.lookup(asked.limit(0)).count() == 0


def test_exact_with_a_full_filter(spark, monkeypatch):
    """A filter of one bitmap passes rows that have no copy; they come out alike."""
    monkeypatch.setattr(common, "FILTER_BITS", 0)
    monkeypatch.setattr(common, "BITMAP_BITS", 8)
    rows = awkward()
    found = exact_dedup(frame(spark, rows), keep="largest").withColumn("digest", F.lower(F.hex("digest"))).collect()
    assert sorted([(r.id, r.keep_id, r.group_size, r.digest) for r in found], key=str) == plain_exact(rows)


def sets_of(rows, size=4):
    out = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def plain_near(rows, size=4):
    sets, group = sets_of(rows, size), list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        known = [x for x in least[find(k)] if x is not None]
        own = (min(known) if known else None) if sets[k] else i
        out.append((i, len(sets[k]), own, i == own))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_near(spark, seed):
    rows = awkward(seed)
    found = near_duplicates(frame(spark, rows)).collect()
    assert sorted([(r.id, r.n_shingles, r.component_id, r.kept) for r in found], key=str) == plain_near(rows)


def test_near_in_small_blocks_finds_chains(spark, monkeypatch):
    """A chain of documents, each near the next alone, whatever the blocks."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 150)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 2)
    line = words(400, 3)
    rows = [(k, " ".join(line[k * 8 : k * 8 + 120])) for k in range(30)]
    found = near_duplicates(frame(spark, rows)).collect()
    assert sorted([(r.id, r.n_shingles, r.component_id, r.kept) for r in found], key=str) == plain_near(rows)
    assert len({r.component_id for r in found}) == 1


def test_near_ids_at_the_ends_of_their_range(spark):
    """The largest id is no null, and a class's number is its own whatever its digest."""
    text = " ".join(words(30, 1))
    rows = [(None, text), (2**63 - 1, text), (-(2**63), "alone here in its own words"), (None, ""), (2**63 - 1, None), (None, "of nulls alone it is"), (None, "of nulls alone it is")]
    found = near_duplicates(frame(spark, rows)).collect()
    assert sorted([(r.id, r.n_shingles, r.component_id, r.kept) for r in found], key=str) == plain_near(rows)


def test_near_with_digests_of_one_half(spark, monkeypatch):
    """Classes whose digests share a half stay apart."""
    plain = minhash.set_digests
    monkeypatch.setattr(minhash, "set_digests", lambda *a: plain(*a) & np.array([[1], [-1]]))
    rows = awkward(3)
    found = near_duplicates(frame(spark, rows)).collect()
    assert sorted([(r.id, r.n_shingles, r.component_id, r.kept) for r in found], key=str) == plain_near(rows)


def test_near_of_nothing(spark):
    assert near_duplicates(frame(spark, []).limit(0)).count() == 0
    assert near_duplicates(frame(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = pool[:300], pool[100:]
    rows = [(g, np.sort(x)) for g, x in enumerate((a, b))]
    sig = superminhash(np.concatenate([np.full(len(x), g) for g, x in rows]), np.concatenate([x for _, x in rows]), 2, 240)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.1
    steps = (sig >> np.uint64(56)).astype(int)
    assert steps.max() >= 1 and (sig < 2**64 - 1).all()
    tiny = superminhash(np.zeros(1, int), a[:1], 1, 72)[0]
    assert sorted((tiny >> np.uint64(56)).tolist()) == list(range(72))  # ranks of one element exclude each other


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(400, k) for k in range(401, 440)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert found == {x: find(x) for a, b in edges for x in (a, b) if a != b or x in found}


def plain_substring(rows, window):
    order = lambda i: (i is None, i or 0)
    first = {}
    split = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, split, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order(i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "seed"), [(13, 0), (13, 1), (5, 2), (2, 3), (1, 4)])
def test_substring(spark, window, seed):
    rows = awkward(seed)
    found, lengths = substring_dedup(frame(spark, rows), window=window)
    assert lengths[1] == window
    assert sorted([(r.id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()], key=str) == plain_substring(rows, window)


def plain_longest(rows, lengths):
    """Of each row the greatest length at which a window of it stands in another row, of another id at the first length."""
    split, out = [WORD.findall(t or "") for _, t in rows], [0] * len(rows)
    for n in lengths:
        where = {}
        for r, w in enumerate(split):
            for k in range(len(w) - n + 1):
                where.setdefault(tuple(w[k : k + n]), set()).add(rows[r][0] if n == lengths[0] else r)
        for r, w in enumerate(split):
            if any(len(where[tuple(w[k : k + n])]) > 1 for k in range(len(w) - n + 1)):
                out[r] = n
    return sorted(((i, n) for (i, _), n in zip(rows, out, strict=True)), key=str)


def test_substring_tells_the_longest_repeats(spark):
    rows = awkward(2)
    found, lengths = substring_dedup(frame(spark, rows))
    assert lengths[-1] >= 104
    assert sorted([(r.id, r.longest_repeat) for r in found.collect()], key=str) == plain_longest(rows, lengths[1:])


def test_substring_when_hashes_clash(spark, monkeypatch):
    """First hashes of three bits: second hashes still tell windows apart."""
    plain = substring.windows

    def weak(*a):
        hashes, at = plain(*a)
        return hashes & np.uint64(7 << 61), at

    monkeypatch.setattr(substring, "windows", weak)
    rows = awkward(8)
    found, _ = substring_dedup(frame(spark, rows), exhaust=False)
    assert sorted([(r.id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()], key=str) == plain_substring(rows, 13)


def test_substring_ids_at_the_end_of_their_range(spark):
    text = " ".join(words(30, 1))
    found, _ = substring_dedup(frame(spark, [(None, text), (2**63 - 1, text), (5, text)]))
    assert sorted([(r.id, r.n_removed) for r in found.collect()], key=str) == [(5, 0), (2**63 - 1, 30), (None, 30)]


def test_substring_spans_cover_what_is_removed(spark):
    found, _ = substring_dedup(frame(spark, awkward()))
    for r in found.collect():
        spans = [tuple(map(int, s.split(":"))) for s in r.removed.split(",") if s]
        assert sum(b - a for a, b in spans) == r.n_removed


def test_substring_doubles_until_nothing_survives(spark):
    long = " ".join(f"u{k}" for k in range(100))
    rows = [(1, long), (2, f"a b {long} c"), (3, "short and alone in its words it is not repeated at all in any other text")]
    found, lengths = substring_dedup(frame(spark, rows), exhaust=True)
    assert lengths == [7, 13, 26, 52, 104]
    assert {r.id: r.longest_repeat for r in found.collect()} == {1: 52, 2: 52, 3: 0}
    assert {r.id: r.n_removed for r in found.collect()} == {1: 0, 2: 100, 3: 0}


def test_substring_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(substring, "RANGE_WORDS", 300)
    monkeypatch.setattr(substring, "BATCH_BYTES", 2_000)
    rows = awkward(6)
    found, _ = substring_dedup(frame(spark, rows))
    assert sorted([(r.id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()], key=str) == plain_substring(rows, 13)


def test_substring_of_nothing(spark):
    found, _ = substring_dedup(frame(spark, []).limit(0))
    assert found.count() == 0
