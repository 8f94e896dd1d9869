"""Merkle manifests, whitening and min-max near-duplicates against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieout.llm import merkle, minmax, whitening
from tieout.llm.common import ascii_lower

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """Root of a list of digests, and the siblings of each of them."""
    groups, siblings = [[k] for k in range(len(leaves))], [[] for _ in leaves]
    row = list(leaves)
    while len(row) > 1:
        nodes, merged = [], []
        for at in range(0, len(row), 8):
            run = row[at: at + 8]
            for k in range(len(run)):
                for leaf in groups[at + k]:
                    siblings[leaf] += run[:k] + run[k + 1:]
            nodes.append(sha("".join(run)))
            merged.append([x for g in groups[at: at + 8] for x in g])
        row, groups = nodes, merged
    return row[0], siblings


def plain_manifest(rows):
    """Leaf, subroot, root and proof digest of every row, by row number."""
    by = defaultdict(list)
    for k, r in enumerate(rows):
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), k))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        placed = sorted(by[lang])
        trees.append((placed, *plain_tree([leaf for _, _, leaf, _ in placed])))
    root, upper = plain_tree([t[1] for t in trees])
    return {k: (leaf, sub, root, sha("".join(own + upper[n])))
            for n, (placed, sub, siblings) in enumerate(trees) for (_, _, leaf, k), own in zip(placed, siblings, strict=True)}


def certified(documents, block=merkle.BLOCK):
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.when(touched, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return merkle.certify(documents, lowered, block).withColumn("proof_sha256", F.sha2(F.lower(F.hex("proof")), 256))


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_manifest_and_proofs_are_those_of_plain_trees(spark, block):
    rng = random.Random(3)
    rows = [(i if rng.random() < 0.95 else None, rng.choice(["A Text", "a text", None, "", "É B"]) , rng.choice(langs), "s" if i % 3 else None, i)
            for langs in ([None, "en", "é", "z"], ["big"] * 3 + ["en"]) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain = plain_manifest([r.asDict() for r in frame.collect()])
    want = sorted(plain.values())
    found = certified(frame, block).collect()
    assert sorted((r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in found) == want
    touched = [r for r in found if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0]
    assert touched and any(not r["verified"] for r in touched) and any(r["verified"] for r in touched)
    assert all(r["verified"] for r in found if r not in touched)
    texts = defaultdict(set)
    for r in frame.collect():
        texts[plain_leaf(r, r["text"])].add(r["text"])
    for r in touched:
        text = next(iter(texts[r["leaf"]]))
        assert r["verified"] == (text is None or text == text.translate(LOWER))
        assert (r["folded_root"] == r["root"]) == r["verified"]


def test_manifest_asks_for_no_node_twice_and_none_it_can_derive():
    rng = random.Random(4)
    for width in (1, 2, 8, 9, 64, 65, 700):
        leaves = [sha(str(k)) for k in range(width)]
        for size in {1, min(3, width), min(100, width)}:
            known = set(rng.sample(range(width), size))
            asked = list(merkle.missing_nodes(known, width))
            assert len(asked) == len(set(asked))
            levels = [leaves]
            while len(levels[-1]) > 1:
                levels.append([sha("".join(levels[-1][a: a + 8])) for a in range(0, len(levels[-1]), 8)])
            for level, place in asked:  # no leaf below is known
                assert not known & set(range(place * 8**level, (place + 1) * 8**level))
            built = merkle.interiors({k: leaves[k] for k in known}, width, {x: levels[x[0]][x[1]] for x in asked})
            assert built[-1][0] == levels[-1][0]
            for k, proof in zip(sorted(known), merkle.proofs(built, sorted(known)), strict=True):
                assert merkle.fold(leaves[k], k, width, proof) == (levels[-1][0], b"")
                assert merkle.fold(sha("x"), k, width, proof)[0] != levels[-1][0]


def test_manifest_of_odd_rows(spark, odd_documents, no_documents):
    plain = plain_manifest([r.asDict() for r in odd_documents.collect()])
    found = certified(odd_documents).collect()
    assert sorted((r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in found) == sorted(plain.values())
    assert certified(no_documents).count() == 0
    one = certified(odd_documents.where("doc_id = 5")).collect()
    assert [r["leaf"] == r["subroot"] == r["root"] for r in one] == [True] and one[0]["proof_sha256"] == sha("")


def test_scatter_is_exact():
    rng = np.random.default_rng(1)
    for rows, d, top in ((1, 1, 5), (64, 3, 2**20), (100, 7, 2**11), (130, 4, 2**62), (63, 2, 1)):
        numbers = rng.integers(-top, top, (rows, d))
        wide = [[1, *map(int, r)] for r in numbers]
        found = whitening.scatter(numbers)
        assert all(found[i][j] == sum(r[i] * r[j] for r in wide) for i in range(d + 1) for j in range(i, d + 1))


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    centred = (n * x - total).astype(np.float64) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:8]
    return ((n * x - total) ** 2).sum(1), centred @ columns[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_is_that_of_plain_numpy(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(500, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    rows = [(k, v.tolist(), 1, k) for k, v in enumerate(vectors)]
    odd = [(900, None, 1, 1), (901, [1.0] * 11 + [None], 1, 1), (902, [float("nan")] * 12, 1, 1), (903, [1.0] * 11 + [float("-inf")], 1, 1),
           (904, [], 1, 1), (905, [1.0, 2.0], 1, 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, component int, n long").repartition(7)
    found = whitening.whiten(frame).collect()
    deviation, white, explained = plain_whitening(vectors)
    assert len(found) == 500 * 8 and {r["n"] for r in found} == {500}
    signs = {}
    for r in found:
        k, c = r["vec_id"], r["component"]
        assert r["deviation"] == deviation[k]
        sign = signs.setdefault(c, np.sign(r["whitened"] * white[k, c - 1]))
        assert r["whitened"] == pytest.approx(sign * white[k, c - 1], rel=1e-6, abs=1e-8)
        assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
    assert len({r["identity_error"] for r in found}) == 1 and 0 <= found[0]["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])], schema)).collect()
    assert len(same) == 6 and {r["whitened"] for r in same} == {None} == {r["explained"] for r in same}
    assert {r["deviation"] for r in same} == {0} and {r["n"] for r in same} == {3} and sorted({r["component"] for r in same}) == [1, 2]
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], schema)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and line[0]["identity_error"] < 1e-9
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 1.0])], schema)).collect()
    assert len(far) == 6 and {r["deviation"] for r in far} <= {None} | {r["deviation"] for r in far if r["vec_id"] == 3}


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]


def plain_set(text):
    words = words_of(text)
    return {tuple(words[k: k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_classes(rows):
    """Smallest id of each row's class."""
    sets, parent = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        known = least.setdefault(root(k), doc)
        if doc is not None and (known is None or doc < known):
            least[root(k)] = doc
    return sorted((doc is not None, doc or 0, len(sets[k]), str(least[root(k)])) for k, (doc, _) in enumerate(rows))


def made_up(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6))) for _ in range(n)]


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = made_up(rng, 1)[0]
    return words


def group_rows(rng):
    """Groups of near copies whose similarities lie around the limit, and texts without any."""
    texts = []
    for size, words, most in ((2, 30, 1), (3, 120, 3), (25, 150, 5), (90, 200, 6), (5, 8, 1)):
        base = made_up(rng, words)
        texts += [" ".join(edited(rng, base, rng.randrange(most + 1))) for _ in range(size)]
    chain = made_up(rng, 400)
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 3)
    texts += [" ".join(made_up(rng, rng.randrange(1, 60))) for _ in range(40)]
    return list(enumerate(texts))


@pytest.mark.parametrize("members", [96, 8])
def test_minmax_classes_are_those_of_all_pairs(spark, monkeypatch, members):
    rows = group_rows(random.Random(6))
    monkeypatch.setattr(minmax, "MEMBERS", members)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = minmax.near_duplicates(frame).collect()
    assert sorted((True, r["doc_id"], r["n_shingles"], str(r["component_id"])) for r in found) == plain_classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert len({r["component_id"] for r in found}) < len(rows)


def test_minmax_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    errors, apart = [], []
    for share in (0.5, 0.8, 0.9):
        for _ in range(150):
            both = rng.integers(0, 2**64, int(400 * share), np.uint64, endpoint=False)
            left, right = (np.concatenate((both, rng.integers(0, 2**64, (400 - len(both)) // 2, np.uint64))) for _ in range(2))
            true = len(both) / (len(left) + len(right) - len(both))
            agree = (minmax.signature(left) == minmax.signature(right))
            errors.append(agree.mean() - true)
            apart.append((agree.mean() - true) ** 2 / (true * (1 - true) / len(agree)))
    assert abs(np.mean(errors)) < 0.006 and np.mean(apart) < 1.15  # unbiased, no more variance than independent values


def test_minmax_of_odd_rows(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    found = minmax.near_duplicates(odd_documents).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_shingles"], str(r["component_id"])) for r in found) == plain_classes(rows)
    assert all(r["n_shingles"] == 0 and r["kept"] for r in found if r["doc_id"] in (2, 3, 4))
    assert minmax.near_duplicates(no_documents).count() == 0
