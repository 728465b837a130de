"""The Jaccard join, the Merkle manifest and tokenizer alignment against plain versions, on awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from lectern.llm import alignment, merkle, minhash, ngram_join

from lectern.llm.alignment import Aligned, PieceModel, align_tokenizers
from lectern.llm.bpe import BpeModel
from lectern.llm.merkle import merkle_manifest
from lectern.llm.ngram_join import boundary, count_class, jaccard_join, overlaps, prefix, subset_keys, subsets

from lectern.llm.queries import tokenizer_path

from .test_dedup import LOWER, WORD, awkward, frame


def plain_join(rows, size=5, share=80):
    """All pairs of rows; (id, n, least id of the component)."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= share * (len(sets[a]) + len(sets[b]) - same):
                part[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 2**63), 2**63 if i is None else i)
    return sorted(((i, len(sets[k]), None if least[find(k)] == 2**63 else least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def joined(df, **options):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard_join(df, **options).collect()), key=str)


def short_texts(seed):
    """Texts of up to 24 words over few words, with edits at their ends and inside."""
    rng = random.Random(seed)
    rows = []
    for k in range(40):
        base = [f"v{rng.randrange(300)}" for _ in range(rng.randint(1, 24))]
        rows.append((10 * k, " ".join(base)))
        for j in range(1, rng.randint(1, 5)):
            own = [f"end{rng.randrange(9)}"] * rng.randint(0, 2) + base[rng.randint(0, 1) :]
            if own and rng.random() < 0.5:
                own[rng.randrange(len(own)):] = own[: rng.randint(0, 3)]
            rows.append((10 * k + j, " ".join(own) if own else None))
    return rows


@pytest.mark.parametrize("seed", [1])
def test_join_equals_all_pairs(spark, seed):
    rows = awkward(seed) + short_texts(seed)
    rows = [(None if i is None else i + 1000 * (k >= len(awkward(seed))), t) for k, (i, t) in enumerate(rows)]
    assert joined(frame(spark, rows)) == plain_join(rows)


@pytest.mark.parametrize(("x", "share"), [(0, 80), (14, 80), (5, 67)])
def test_any_boundary_gives_the_same_rows(spark, monkeypatch, x, share):
    monkeypatch.setattr(ngram_join, "boundary", lambda *a: x)
    rows = short_texts(x)
    assert joined(frame(spark, rows), share=share) == plain_join(rows, share=share)


def test_many_ranges_and_batches(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RANGE_WORDS", 500)
    rows = awkward(5)
    assert joined(frame(spark, rows, parts=9)) == plain_join(rows)


def test_join_of_other_shingles_and_of_nothing(spark):
    rows = short_texts(9)
    assert joined(frame(spark, rows), shingle=2) == plain_join(rows, size=2)
    assert joined(frame(spark, []).limit(0)) == []
    assert joined(frame(spark, [(1, None), (None, ""), (3, " \n")])) == [(1, 0, 1), (3, 0, 3), (None, 0, None)]
    with pytest.raises(ValueError):
        jaccard_join(frame(spark, rows), share=30)


def test_null_ids_cost_one_comparison_a_class(spark, monkeypatch):
    """Two texts that link, 200 rows each without an id: one pair is compared."""
    base = [f"w{k}" for k in range(60)]
    near = [*base[:-1], "other"]
    rows = [(None, " ".join(t)) for t in (base, near) for _ in range(200)]
    counts, plain = [], minhash.connected_components
    monkeypatch.setattr(minhash, "connected_components", lambda edges: counts.append(edges.count()) or plain(edges))
    assert minhash.near_duplicates(frame(spark, rows)).where("component_id IS NULL").count() == 400
    assert jaccard_join(frame(spark, rows)).where("component_id IS NULL AND n_shingles = 56").count() == 400
    assert counts == [1, 1]


def test_subsets_meet_exactly_where_links_do():
    rng = np.random.default_rng(0)
    for n in range(1, 12):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        assert subset_keys(a[None]).shape[1] == subsets(n)
        for m in range(-(-80 * n // 100), min(12, 100 * n // 80) + 1):
            c = -(-80 * (n + m) // 180)
            if c <= min(n, m):
                assert c in overlaps(n) and c in overlaps(m)
                b = np.r_[a[n - c :], rng.integers(0, 2**63, m - c).astype(np.uint64)]
                assert set(subset_keys(a[None])[0]) & set(subset_keys(rng.permutation(b)[None])[0])
                far = np.r_[a[n - c + 1 :], rng.integers(0, 2**63, m - c + 1).astype(np.uint64)]
                assert not set(subset_keys(a[None])[0]) & set(subset_keys(far[None])[0]) or c - 1 in overlaps(n)


def test_boundary_follows_cost():
    assert boundary({n: (1, 1000) for n in range(1, 15)}) >= 13
    assert boundary({n: (1000, 1) for n in range(1, 15)}) == 0
    assert boundary({n: (subsets(n), 2 * prefix(n)) for n in range(1, 15)}) in range(1, 9)
    assert boundary({}) == 0
    steps = count_class(np.arange(1, 10**6, 37))
    assert (np.diff(steps.astype(int)) >= 0).all() and steps[-1] < 255


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The root, and for each leaf the [left, right] siblings of each level."""
    sides = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            sides[k].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        nodes, place = [H("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)], [p // 16 for p in place]
    return nodes[0], sides


def plain_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text); ids are distinct within a source, or leaves equal."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built, out = [], []
    for name in names:
        own = sorted(trees[name], key=lambda r: (r[0] is None, r[0] or 0, plain_leaf(*r)))
        built.append((own, *plain_tree([plain_leaf(*r) for r in own])))
    if not rows:
        return []
    root, upper = plain_tree([b[1] for b in built])
    for (own, subroot, sides), above in zip(built, upper, strict=True):
        for r, side in zip(own, sides, strict=True):
            changed = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and changed is not None:
                changed = changed.translate(LOWER)
            node = plain_leaf(*r[:4], changed)
            for left, right in side + above:
                node = H(left + node + right)
            out.append((r[0], plain_leaf(*r), subroot, root, H("".join(a + b for a, b in side + above)), node, node == root))
    return sorted(out, key=str)


def manifest_rows(seed):
    """Sources of one row, of 16, 17, 256, 257 and several hundred, a null one, one that reads like another's mark, repeats and odd texts."""
    rng = random.Random(seed)
    sizes = {None: 3, "": 1, "=": 2, "a": 1, "b": 16, "c": 17, "\ud55c\uad6d": 256, "d": 257, "\U0001f600": 40, "hot": 700, **{f"s{k}": 2 for k in range(20)}}
    rows = []
    for name, n in sizes.items():
        for i in rng.sample(range(-500, 5000), n):
            rows.append((i, name, rng.choice(["en", None, ""]), rng.choice([None, 3, -1]), rng.choice([None, "", "Abc", "ABC déf É", "x" * 3000, f"t{i}"])))
    rows += [(7, "twice", "en", 1, "Same")] * 2 + [(None, "none", None, None, f"T{k}") for k in range(20)] + [(None, "none", None, None, None)] * 3
    rng.shuffle(rows)
    return rows


def manifest(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, index int").repartition(parts)
    return sorted(map(tuple, merkle_manifest(df).collect()), key=str)


@pytest.mark.parametrize("leaves", [90, 10**6])
def test_manifest_equals_a_plain_one(spark, monkeypatch, leaves):
    """In many partitions, whose edges are unaligned, and in one."""
    monkeypatch.setattr(merkle, "PART_LEAVES", leaves)
    rows = manifest_rows(leaves % 7)
    found = manifest(spark, rows)
    assert found == plain_manifest(rows)
    assert {x[-1] for x in found} == {True, False}


def test_manifest_of_little(spark):
    assert manifest(spark, []) == []
    one = [(5, "s", "en", 1, "Text")]
    assert manifest(spark, one) == plain_manifest(one)
    assert manifest(spark, one)[0][4] == H("")
    alone = [(k, f"s{k:03}", None, None, None) for k in range(300)]
    assert manifest(spark, alone) == plain_manifest(alone)


def test_mountains_meet_wherever_a_tree_is_cut():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.choice([1, 2, 15, 16, 17, 255, 256, 257, 300, 700, 4097])
        nodes = [H(str(k)) for k in range(n)]
        cuts = sorted({0, n, *(rng.randrange(n) for _ in range(rng.randint(0, 5)))})
        runs, edges = {}, {}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            m = merkle.Mountains(n, a)
            for x in nodes[a:b]:
                m.add(x)
            m.close()
            assert all(len(x) == merkle.HEX * min(16, merkle.sizes_of_levels(n)[level] - 16 * at) for level, at, x in m.runs)
            runs |= {(level, at): x for level, at, x in m.runs}
            edges |= {(level, at): x for level, at, x in m.edges}
            assert len(m.edges) <= 30 * len(m.sizes)
        for level, size in enumerate(merkle.sizes_of_levels(n)[:-1]):
            for at in range(-(-size // 16)):
                own = [edges.get((level, k)) for k in range(16 * at, min(size, 16 * at + 16))]
                assert all(own) if (level, at) not in runs else not any(own)
                edges.setdefault((level + 1, at), H("".join(own))) if all(own) else None
        assert edges[len(merkle.sizes_of_levels(n)) - 1, 0] == plain_tree(nodes)[0]


@pytest.fixture(scope="module")
def models():
    return BpeModel(tokenizer_path()), PieceModel(tokenizer_path("piece_bpe_32k.model"))


def plain_alignment(rows):
    """Whole texts through both libraries, links one by one."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizer_path())
    one.encode_special_tokens = True
    two = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    letters = {c: bytes([k]) for k, c in enumerate(alignment_letters())}
    docs, counts = [], {}
    for _, t in rows:
        groups, text = [], b" " + (t or "").encode()
        a = one.encode(" " + t, add_special_tokens=False).ids if t else []
        b = two.encode(t) if t else []
        a_bytes = [b"".join(letters[c] for c in one.id_to_token(i)) for i in a]
        names = [two.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(x[3:5], 16)]) if two.is_byte(i) else x.replace("\u2581", " ").encode() for i, x in zip(b, names, strict=True)]
        if not t or b"".join(a_bytes) != text or b"".join(b_bytes) != text:
            a, b = [], []
        x = y = p = q = 0
        while x < len(a):
            left, right = [a[x]], []
            p, x = p + len(a_bytes[x]), x + 1
            while q != p:
                if q < p:
                    right.append(b[y])
                    q, y = q + len(b_bytes[y]), y + 1
                else:
                    left.append(a[x])
                    p, x = p + len(a_bytes[x]), x + 1
            groups.append((left, right))
        links = [(i, j) for g in groups for i in g[0] for j in g[1]]
        for pair in set(links):
            counts[pair] = counts.get(pair, 0) + 1
        docs.append((a, b, groups, links))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for (i, _), (a, b, groups, links) in zip(rows, docs, strict=True):
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), H(shown) if groups else ""))
    return sorted(out, key=str), counts, most


def alignment_letters():
    from lectern.llm.bpe import byte_letters

    return byte_letters()


def test_alignment_equals_the_libraries(spark, models, monkeypatch):
    rng = random.Random(3)
    pieces = [*"abc  '\n\t stredvml' é漢字😀1²_-.,\x1c\x85 ́ſ\u3000ﬁ", "<|endoftext|>", "<s>", "<0x41>", "'re", "  ", "\r\n", "aaaa", "The ", "\u2581", "\x00", "한국어"]
    rows = awkward(4)[-25:] + [(None if k % 50 == 0 else 1000 + k, "".join(rng.choices(pieces, k=rng.randint(0, 40)))) for k in range(300)]
    rows += [(2000 + k, t) for k, t in enumerate([" ", "  ", "a ", " a", "\u2581", "x\u2581y", "😀" * 400, "é" * 3000, "\n" * 500, "word  " * 50])]
    found, pairs = align_tokenizers(frame(spark, rows), *models)
    want, counts, most = plain_alignment(rows)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert {(r.a, r.b): (r.documents, r.best) for r in pairs.collect()} == {x: (n, n == most[x[0]]) for x, n in counts.items()}


def test_alignment_of_nothing(spark, models):
    found, pairs = align_tokenizers(frame(spark, []).limit(0), *models)
    assert found.count() == pairs.count() == 0
    found, pairs = align_tokenizers(frame(spark, [(1, None), (None, ""), (2, "\u2581")]), *models)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
    assert pairs.count() == 0


def test_wide_groups_are_expanded_from_distinct_tokens(monkeypatch):
    """One side's tokens end at odd places, the other's at even ones, up to the end of the text."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, 61), rng.integers(0, 3, 61)
    sizes = np.full(4, 2)
    a_sizes, b_sizes = sizes.copy(), np.r_[sizes, 1]
    a, b = np.r_[a, 0], np.r_[4, b, 4]
    many = Aligned(a, np.array([0, len(a)]), a_sizes, b, np.array([0, len(b)]), b_sizes)
    assert many.in_a.tolist() == [62]
    few = many.distinct()
    monkeypatch.setattr(alignment, "WIDE", 10**9)
    assert all((x == y).all() for x, y in zip(few, many.distinct(), strict=True))
    assert few[2].sum() == 62 * 63
