"""SimHash, passages, benchmark windows, quality, toxicity and probabilities against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tieout.llm import components, decontamination, divergence, lattice, passages, simhash, tokens, toxicity

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text, break_at=r"[\x20\x09-\x0D]+"):
    return [w for w in re.split(break_at, (text or "").translate(ASCII_LOWER)) if w]


def made_up(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def classes(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def same_partition(left, right):
    return len(set(zip(left, right, strict=True))) == len(set(left)) == len(set(right))


def plain_fingerprint(text):
    words = words_of(text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_majorities_of_shingle_hashes():
    rng = random.Random(2)
    for text in ["", " \n", "A", "É x\x0bZ q", *(made_up(rng, n) for n in (1, 3, 4, 5, 60, 5000))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_are_all_those_within_four_bits(spark):
    rng, fps = random.Random(1), set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            x = base
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
            base = x if rng.random() < 0.3 else base
    base = rng.getrandbits(64)
    for _ in range(300):  # one half in common
        x = base
        for _ in range(rng.randrange(7)):
            x ^= 1 << 32 + rng.randrange(32)
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    near = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if int(np.bitwise_count(fps[i] ^ fps[j])) <= 4]
    want = classes(len(fps), near)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for most in (20_000, 30, 3):
        found = {r["node"]: r["root"] for r in components.components(simhash.links(frame, most)).collect()}
        assert same_partition(want, [found.get(int(x), int(x)) for x in fps.view(np.int64)])
    big = simhash._group_links(fps, np.bitwise_count((fps ^ fps[0]) & np.uint64(0xFFFFFFFF)), 0)
    assert all(int(np.bitwise_count(a ^ b)) <= 4 for a, b in big)


def test_components_of_paths_and_rings(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + (i + 1) % 50) for i in range(50)] + [(7, 7), (3, 4)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(201)) and all(found[1000 + i] == 1000 for i in range(50))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_rows(spark, odd_documents, no_documents):
    found = simhash.near_duplicates(odd_documents).collect()
    assert len(found) == odd_documents.count()
    of = {(r["doc_id"], r["fp"]): r["component_id"] for r in found}
    assert of[6, next(r["fp"] for r in found if r["doc_id"] == 6)] == 5
    assert {c for (d, fp), c in of.items() if fp == 0} == {2}  # empty texts, one of them without an id
    kept = simhash.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    rows = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert set(rows.values()) == {1} and sum(d in (2, 3, 4) for d, _ in rows) == 1 and (None, "a text without an id") in rows
    assert len(rows) == len({r["root"] for r in found})
    assert simhash.near_duplicates(no_documents).count() == 0 == simhash.one_of_each(no_documents).count()


def test_passages_that_repeat_are_found(spark):
    rng = random.Random(5)
    shared, other, edited = made_up(rng, 61), made_up(rng, 55), made_up(rng, 90).split()
    once, less = list(edited), list(edited)
    once[45], less[30:31] = "qqq", []
    texts = [made_up(rng, 200) + " " + shared + " " + made_up(rng, 100), shared + " " + made_up(rng, 300),
             made_up(rng, 20) + " " + shared.upper() + " " + made_up(rng, 5), made_up(rng, 70) + "\n" + other,
             made_up(rng, 70) + " " + other + " " + made_up(rng, 1), made_up(rng, 50) + " " + " ".join(edited) + " " + made_up(rng, 50),
             made_up(rng, 9) + " " + " ".join(once), " ".join(less) + " " + made_up(rng, 400), made_up(rng, 500), "", None, made_up(rng, 49)]
    texts += [made_up(rng, rng.randrange(60)) + " " + shared + " " + made_up(rng, 30) for _ in range(40)]
    whole = made_up(rng, 30)  # parts of a longer passage also stand elsewhere
    rest = made_up(rng, 30)
    texts += [made_up(rng, 60) + " " + whole, made_up(rng, 40) + " " + whole + " " + rest, made_up(rng, 11) + " " + whole + " " + rest]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("start", F.lit(1))
    found = passages.shared_passages(frame).collect()
    holders, covered = defaultdict(set), {doc: set() for doc in range(len(texts))}
    for doc, text in enumerate(texts):
        line = words_of(text)
        for i in range(len(line) - 49):
            holders[tuple(line[i:i + 50])].add(doc)
    for r in found:
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
        assert r["other_id"] < r["doc_id"] and r["end"] - r["start"] >= 50 and r["similarity"] >= 0.8
    for doc, text in enumerate(texts):
        line, wanted = words_of(text), set()
        for i in range(len(line) - 49):
            if min(holders[tuple(line[i:i + 50])]) < doc:
                wanted.update(range(i, i + 50))
        # A word beside a passage may agree by chance with a holder that is not the first.
        assert len(wanted - covered[doc]) <= 2, doc
    assert covered[6] and covered[7] and not any(covered[doc] for doc in (0, 3, 5, 8, 9, 10, 11))
    assert len(found) <= 2 * len(texts)
    cut = {r["doc_id"]: r["text"] for r in passages.without_repeats(frame, passages.shared_passages(frame)).collect()}
    assert len(cut) == len(texts) and cut[0] == texts[0] and cut[8] == texts[8] and cut[10] is None
    assert words_of(cut[1]) == words_of(texts[1])[61:] and words_of(cut[4]) == words_of(texts[4])[:70] + words_of(texts[4])[-1:]


def test_short_passages_with_parts_in_earlier_documents_are_found(spark):
    rng = random.Random(14)
    texts = []
    for size in (*range(50, 72, 3), 90, 130):
        line = made_up(rng, size).split()
        for parts in ([line[:-20]], [line[20:]], [line[:size // 2 + 10], line[size // 2 - 10:]], [line[15:], line[:-15]],
                      [line[i:i + 49] for i in range(0, size - 48, 7)]):
            again = [rng.choice("abcdefghij") * 9 + w for w in made_up(rng, size).split()]  # other words in each case
            words = dict(zip(line, again, strict=False))
            case = [[words[w] for w in part] for part in parts]
            whole = [words[w] for w in line]
            for held in (*case, whole, whole, whole + made_up(rng, 3).split() + whole):
                texts.append(" ".join([made_up(rng, rng.randrange(1, 40)), *held, made_up(rng, rng.randrange(1, 40))]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first, covered = {}, defaultdict(set)
    for r in passages.shared_passages(frame).collect():
        assert r["other_id"] < r["doc_id"] and r["end"] - r["start"] >= 50 and r["similarity"] >= 0.8
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
    n = 0
    for doc, text in enumerate(texts):
        line = words_of(text)
        for i in range(len(line) - 49):
            if first.setdefault(tuple(line[i:i + 50]), doc) < doc:
                assert covered[doc].issuperset(range(i, i + 50)), (doc, i)
                n += 1
    assert n > 3000


def test_edited_passages_are_found(spark):
    """Recall over passages with changed words, of which 0.8 of the five-word runs or more still agree."""
    rng, texts, wanted = random.Random(21), [], []
    for size, edits in itertools.product((60, 90, 140, 300), (1, 2, 3, 4, 6)):
        for _ in range(4):
            base = made_up(rng, size).split()
            copy = list(base)
            for at in sorted(rng.sample(range(size), edits)):
                copy[at] = made_up(rng, 1) + "z"
            agree = [base[i:i + 5] == copy[i:i + 5] for i in range(size - 4)]
            texts.append(" ".join([made_up(rng, 40), *base, made_up(rng, 40)]))
            texts.append(" ".join([made_up(rng, 25), *copy, made_up(rng, 30)]))
            if sum(agree) >= 0.8 * len(agree):
                wanted.append((len(texts) - 1, 25, size))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    covered = defaultdict(set)
    for r in passages.shared_passages(frame).collect():
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
    caught = sum(len(covered[doc] & set(range(start, start + size))) >= 0.8 * size for doc, start, size in wanted)
    print("recall of edited passages", caught, "of", len(wanted))
    assert len(wanted) > 40 and caught >= 0.9 * len(wanted)


def test_edited_passages_with_parts_in_earlier_documents_are_found(spark, monkeypatch):
    """The first place of every seed is in a document that does not hold the passage."""
    rng, texts, wanted = random.Random(3), [], []
    for size, edits in ((52, 1), (60, 1), (90, 2), (120, 3)):
        for change in ("other", "more", "less") * 2:
            base = [word + "q" for word in made_up(rng, size).split()]
            copy = list(base)
            for k in range(edits, 0, -1):
                at = size * k // (edits + 1)
                copy[at:at + (change != "more")] = [] if change == "less" else ["zz" + made_up(rng, 1)]
            texts += [[*made_up(rng, 30).split(), *base[a:a + 30], *made_up(rng, 30).split()] for a in range(0, size, 12)]
            texts.append([*made_up(rng, 40).split(), *base, *made_up(rng, 40).split()])
            texts.append([*made_up(rng, 25).split(), *copy, *made_up(rng, 30).split()])
            wanted.append((len(texts) - 1, len(texts) - 2, 25, len(copy)))
    frame = spark.createDataFrame([(i, " ".join(line)) for i, line in enumerate(texts)], "doc_id long, text string")
    frame = frame.unionByName(frame.where("doc_id % 5 = 0"))  # repeated rows
    results = []
    for places in (passages._PLACES, 2):  # with hot seeds in blocks, too
        monkeypatch.setattr(passages, "_PLACES", places)
        found = passages.shared_passages(frame).collect()
        covered = defaultdict(set)
        for r in found:
            assert r["other_id"] < r["doc_id"] and r["end"] - r["start"] >= 50 and r["similarity"] >= 0.8
            covered[r["doc_id"], r["other_id"]].update(range(r["start"], r["end"]))
        for doc, other, start, size in wanted:
            assert len(covered[doc, other] & set(range(start, start + size))) >= 0.9 * size, (doc, other)
        results.append(sorted(tuple(r) for r in found))
    assert results[0] == results[1]


def test_what_agrees_around_a_match_is_taken_whole():
    left = np.arange(60, dtype=np.uint64)
    right = np.concatenate((np.arange(100, 110), left)).astype(np.uint64)
    # The second match is on another diagonal, inside of what agrees around the first.
    found = passages.agreeing(left, right, np.array([5, 12]), np.array([15, 20]))
    assert found.tolist() == list(range(10, 70))


def test_passages_of_odd_rows(spark, odd_documents, no_documents):
    found = passages.shared_passages(odd_documents)
    assert {(r["doc_id"], r["other_id"]) for r in found.collect()} == {(6, 5)}
    cut = passages.without_repeats(odd_documents, found)
    assert cut.columns == odd_documents.columns and cut.count() == odd_documents.count()
    assert {r["doc_id"]: r["n_chars"] for r in cut.collect()}[6] < 200
    assert passages.shared_passages(no_documents).count() == 0 == passages.without_repeats(no_documents, found).count()
    assert passages.cut_words("a b  c\nd e", [(1, 3)]) == "a d e" and passages.cut_words(" a b c ", [(2, 9), (0, 1)]) == " b "


def test_chains_rise_in_both_documents():
    x, y = np.array([1, 2, 3, 50, 51, 9]), np.array([11, 12, 13, 60, 61, 2])
    found = passages.chains(x, y)
    assert [x[c].tolist() for c in found[:2]] == [[1, 2, 3], [50, 51]] or [x[c].tolist() for c in found[:2]] == [[50, 51], [1, 2, 3]]
    for c in found:
        assert (np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all()
    assert passages.best_stretches(np.array([1] * 30 + [0] * 40 + [1] * 60, bool), 46, 0.8) == [(70, 130)]
    assert passages.best_stretches(np.array([1] * 40 + [0] * 5 + [1] * 40, bool), 46, 0.8) == [(0, 85)]


def test_runs_hash_words_in_order():
    line = passages.word_hashes(" ".join(map(str, range(60))))
    for n in (1, 2, 5, 34):
        assert len(passages.runs(line, n)) == 61 - n and len(set(passages.runs(line, n).tolist())) == 61 - n
    assert passages.runs(passages.word_hashes("9 a b c d e"))[1] == passages.runs(passages.word_hashes("A b c d e"))[0]


def test_texts_together_have_the_seeds_of_each():
    rng = random.Random(8)
    texts = ["", made_up(rng, 300), "a b", " \n", made_up(rng, 49), made_up(rng, 50), "x " * 200, "É " + made_up(rng, 90), made_up(rng, 60_000), "q"]
    groups = list(passages.groups_of(texts))
    assert len(groups) > 1 and [i for a, b in groups for i in range(a, b)] == list(range(len(texts)))
    for begin, end in groups:
        words, bounds = passages.hashed_together(texts[begin:end])
        row, at, hashes = passages.seeds_together(words, bounds)
        found = list(zip(row.tolist(), (at - bounds[row]).tolist(), hashes.tolist()))
        wanted = []
        for i, line in enumerate(map(passages.word_hashes, texts[begin:end])):
            assert words[bounds[i]:bounds[i + 1]].tolist() == line.tolist()
            if len(line) >= passages.LEAST_WORDS:
                wanted += [(i, *p) for p in zip(*(v.tolist() for v in passages._seeds(line)[:2]))]
        assert found == wanted
    assert [r.tolist() for r in passages.runs_of(texts)] == [passages.runs(passages.word_hashes(t)).tolist() for t in texts]
    assert list(passages.groups_of([])) == [] == passages.runs_of([])


def test_places_of_one_document_are_not_compared(monkeypatch):
    rng, compared, may_hold = np.random.default_rng(1), [], passages._may_hold
    monkeypatch.setattr(passages, "_may_hold", lambda agree: compared.append(len(agree)) or may_hold(agree))
    same, other = (rng.integers(0, 2**16, 91, dtype=np.uint16) for _ in range(2))
    # Document 5 repeats itself and asks everywhere; 3 has the same words, 2 has others, 7 comes behind.
    places = [(2, 0, 0, other), (3, 0, 0, same), *((5, 1, 100 * n, same) for n in range(20)), *((5, 0, 100 * n, same) for n in range(20)), (7, 0, 0, same)]
    ids, asks = np.array([p[0] for p in places]), np.array([p[1] for p in places])
    at, low = np.array([p[2] + 45 for p in places]), np.array([p[2] for p in places])
    around, known = passages.numbered([p[3] for p in places]), np.ones(len(places), bool)

    def found(chosen):
        order = np.array(chosen)[np.lexsort((at[chosen], ids[chosen]))]
        return [(int(ids[i]), int(low[i]), int(ids[j])) for i, j, _ in passages.first_alike(order, asks, ids, known, at, low, around)]

    assert sorted(found(np.arange(len(places)))) == [(5, 100 * n, 3) for n in range(20)]
    assert sum(compared) == 20
    assert found(np.flatnonzero(ids >= 5)) == [] == found(np.flatnonzero(ids == 2)) and sum(compared) == 20


def plain_contamination(documents, items):
    breaks = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for item, text in items:
        line = words_of(text, breaks)
        for i in range(max(1, len(line) - 12)):
            if line:
                windows[tuple(line[i:i + 13])].add(item)
    out = []
    for doc, text in documents:
        line, hit, of = words_of(text, breaks), set(), set()
        for window, names in windows.items():
            for i in range(len(line) - len(window) + 1):
                if tuple(line[i:i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    of |= names
        names = sorted(str(n) for n in of if n is not None)
        out.append((doc, len(line), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(line)))
    return sorted(out, key=repr)


def test_windows_of_items_are_found_exactly(spark, odd_documents, no_documents):
    rng = random.Random(4)
    line = made_up(rng, 40).split()
    items = [(1, " ".join(line)), (2, " ".join(line[:13])), (3, " ".join(line[5:9])), (4, "two words"), (5, "Éa"), (6, ""), (7, None),
             (10, " ".join(line[5:9])), (None, "no id here"), (11, "x " * 20)]
    texts = [made_up(rng, 30) + " " + " ".join(line) + " " + made_up(rng, 9), "; ".join(line[:14]).upper(), " ".join(line[:12]),
             " ".join(line[5:9]), "TWO, words two", "éa Éa", "no id here", "x " * 50, None, "", made_up(rng, 700) + " two words", "q"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (0, "two words"), (None, "two words"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(0))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for given in (items, items[:2], [], items[5:7]):
        for broadcast in (200_000, 0):
            found = decontamination.find(frame, spark.createDataFrame(given, "item_id long, text string"), broadcast)
            assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr) == plain_contamination(rows, given)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.find(odd_documents, table).count() == odd_documents.count()
    assert decontamination.find(no_documents, table).count() == 0


def plain_measures(text):
    line = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(line[i:i + 8]) for i in range(len(line) - 7))
    again = {p for i in range(len(line) - 7) if windows[tuple(line[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(line), sum(map(len, line)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again),
            len(line) < 20 or 100 * len(again) > 30 * len(line))


def test_quality_counts_and_verdicts(spark, odd_documents, no_documents):
    rng = random.Random(6)
    common = ["the", "of", "and", "to", "in"]
    usual = [" ".join(rng.choice(common) if rng.random() < 0.5 else made_up(rng, 1) for _ in range(200)) for _ in range(60)]
    odd = ["## $$ " * 60 + " ".join(made_up(rng, 40).split()), made_up(rng, 300).upper(), " | ".join(made_up(rng, 200).split())]
    again = made_up(rng, 20)
    texts = usual + odd + [again + " x " + again + "\n" + "a\n" * 5 + "\n\n", made_up(rng, 7), made_up(rng, 8), "a " * 30]
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, words string")
    found = {r["doc_id"]: r for r in divergence.judge(frame).collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for i, text in enumerate(texts):
        assert tuple(found[i][n] for n in names) == plain_measures(text), i
    assert all(found[i]["kept"] for i in range(60)) and not any(found[60 + i]["kept"] for i in range(3))
    rows = divergence.judge(odd_documents, most_languages=0).collect()
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(plain_measures(r["text"]) for r in odd_documents.collect())
    assert divergence.judge(no_documents).count() == 0


def test_quality_counts_take_no_pass_over_the_text_for_each_class_and_window(spark):
    """op10 spent its time on five patterns over whole texts, twice, and on copying eight words for every window."""
    rng = random.Random(17)
    texts = ["".join(rng.choice(["a ", "b ", "a\t", "b\n", "\n", "É ", "X9 ", "$|, ", "\u2003", "ß", "\x01", "{~"]) for _ in range(n))
             for n in range(90)]
    texts += [" ".join(rng.choice("ab") for _ in range(n)) for n in range(30)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    found = divergence.measures(frame)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 6 and plan.count("regexp_replace(classed") == 5 and "xxhash64(slice(" not in plan
    kinds = [re.compile(kind) for kind in divergence.CLASSES]
    for r in found.collect():
        text = texts[r["doc_id"]]
        assert list(r["classes"]) == [len(kind.findall(text)) for kind in kinds], text
        n_words, chars, symbols, lines, again, _ = plain_measures(text)
        assert (r["n_words"], r["word_chars"], r["classes"][2], r["n_dup_lines"], r["n_repeat_words"]) == (
            n_words, chars, symbols, lines, again), text


def test_classes_are_counted_once_for_a_text(spark, monkeypatch):
    """op10 counted the classes and words of every text for the references and again for the text's own row."""
    rng = random.Random(18)
    rows = [(i, made_up(rng, 40) + " ##\tÉ\n", ["en", None, "de"][i % 3], f"s{i % 4}") for i in range(60)] + [(99, None, "xx", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plans, plain = [], divergence.write_scratch

    def seen(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(divergence, "write_scratch", seen)
    judged = divergence.judge(frame)
    plans.append(judged._jdf.queryExecution().optimizedPlan().toString())
    assert sum("regexp_replace(" in plan for plan in plans) == 1 and sum("split(" in plan for plan in plans) == 2
    found = {r["doc_id"]: r for r in judged.collect()}
    assert len(found) == 61 and all(found[i]["n_words"] == 42 and found[i]["n_symbols"] == 2 for i in range(60))
    assert found[99]["n_words"] == 0 and found[99]["base_failed"] and found[99]["class_distance"] is None


def test_a_hot_source_or_text_does_not_set_what_is_usual(spark):
    rng = random.Random(16)

    def plain():
        return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else made_up(rng, 1) for _ in range(60))

    def junk():
        return " ".join(word + rng.choice(["$$$$", "&&&&", "####"]) for word in plain().split())

    clean = [(i, plain(), "en", f"s{i % 12}") for i in range(400)]
    copied = junk()
    groups = {"source": [(1000 + i, junk(), "en", "hot") for i in range(200)],
              "copies": [(1000 + i, copied, "en", f"s{i % 12}") for i in range(200)]}
    for name, odd in groups.items():
        frame = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")
        kept = {r["doc_id"] for r in divergence.judge(frame).where("kept").collect()}
        assert kept == {r[0] for r in clean}, name


def test_jensen_shannon_distance(spark):
    one = spark.range(1).select(*(divergence.jensen_shannon(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias(str(i))
                                  for i, (a, b) in enumerate([((1, 0), (0, 3)), ((2, 2), (5, 5)), ((3, 1), (1, 1)), ((0, 0), (1, 1))]))).first()
    p, q = (0.75, 0.25), (0.5, 0.5)
    mean = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    want = math.sqrt(sum(a * math.log2(a / m) + b * math.log2(b / m) for a, b, m in zip(p, q, mean, strict=True)) / 2)
    assert one["0"] == pytest.approx(1) and one["1"] == 0 and one["2"] == pytest.approx(want) and one["3"] is None


def test_toxic_texts_are_told_from_others(spark, odd_documents, no_documents):
    rng = random.Random(8)
    bad = ["vile", "scum", "moron"]
    rows, labels = [], []
    for i in range(900):
        line, toxic = made_up(rng, rng.randrange(5, 80)).split(), int(rng.random() < 0.2)
        if toxic:
            for _ in range(3):
                line.insert(rng.randrange(len(line)), rng.choice(bad))
        rows.append((i, " ".join(line), 1.0))
        labels += [(i, toxic)] if i % 10 else [(i, toxic), (i, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double")
    table = spark.createDataFrame(labels + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    weights = toxicity.fit(frame, table, toxicity.Settings(shard_rows=400), teaches=F.col("doc_id") % 3 > 0)
    assert np.count_nonzero(weights) < 2000
    scored = toxicity.score(frame, weights)
    assert scored.columns == ["doc_id", "text", "score"]
    truth = {i: t for i, t in labels if t is not None}
    wrong = [r["doc_id"] for r in scored.collect() if r["doc_id"] % 3 == 0 and (r["score"] >= 0.5) != truth[r["doc_id"]]]
    assert len(wrong) <= 6
    assert (toxicity.fit(frame, table, toxicity.Settings(shard_rows=400), teaches=F.col("doc_id") % 3 > 0) == weights).all()
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd_documents, weights).collect())
    assert toxicity.score(no_documents, weights).count() == 0
    assert not toxicity.fit(frame, table.where("false")).any() and not toxicity.fit(no_documents, table).any()
    assert toxicity.training_labels(table, toxicity.Settings(most_rows=100))[1] <= 100


def plain_word(line, pieces):
    if not line:
        return 1.0
    total = 0.0
    for end in range(1, len(line) + 1):
        piece = pieces.begun.get(line[:end], -1)
        if piece >= 0:
            total += math.exp(pieces.logs[piece]) * plain_word(line[end:], pieces)
        elif end == 1:
            total += math.prod(math.exp(pieces.logs[pieces.byte_ids[b]]) for b in line[0].encode()) * plain_word(line[1:], pieces)
    return total


def test_words_sum_over_all_segmentations():
    pieces = lattice.load(tokens.tokenizer_path("piece_bpe_32k.model"))
    words = ["the", "thon", "é漢x", "\x00a", "aaaaaaaa", "🙂🙂", "w" * 300]
    for at in lattice._groups(np.array([len(w) for w in words])):
        group = [words[i] for i in at]
        found = lattice.Lattices.of(group, pieces)
        uses = found.expected(pieces.logs, np.ones(len(group)))
        assert np.isfinite(found.totals(pieces.logs)).all() and uses.sum() > 0
        for word, log in zip(group, found.totals(pieces.logs), strict=True):
            if len(word) < 20:
                assert log == pytest.approx(math.log(plain_word(lattice.MARK + word, pieces)), abs=1e-9)
    assert np.exp(pieces.logs).sum() == pytest.approx(1)


def test_scores_and_base_of_whole_texts(spark, odd_documents, no_documents):
    rng = random.Random(9)
    vocabulary = [made_up(rng, 1) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(150)] + [(200, None), (201, "Neu \x0b É")]
    rows += [(3, rows[3][1]), (None, "a b"), (3, "other")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    counts = Counter()
    for i, text in rows:
        if i is not None and i % 5:
            counts.update([*words_of(text), None])
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(((i, len(line), sum(counts[w] > 0 for w in line), total, round(sum(
        math.log10((counts[w] + 1) / (total + distinct + 1)) for w in line), 6)) for i, text in rows
        for line in [[*words_of(text), None]]), key=repr)
    whole = None
    for head in (1 << 18, 40, 0):
        got = lattice.score(frame, F.col("doc_id") % 5 > 0, head_words=head).collect()
        assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr) == want
        scores = sorted(round(r["score"], 6) for r in got)
        assert whole in (None, scores) and all(s < 0 for s in scores)
        whole = scores
    assert lattice.score(odd_documents, F.lit(True)).count() == odd_documents.count()
    assert lattice.score(odd_documents, F.lit(False)).agg(F.max("train_tokens")).first()[0] == 0
    assert lattice.score(no_documents, F.lit(True)).count() == 0


def test_training_rows_are_cut_within_a_full_bucket(spark):
    from dataclasses import replace

    # Ids whose hashes begin alike, found by trying many.
    ids = [r["id"] for r in spark.range(3_000_000).where(F.shiftrightunsigned(F.xxhash64("id"), 48) == 0).select("id").collect()]
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int")
    few = replace(toxicity.Settings(), most_rows=len(ids) // 2)
    rows, total = toxicity.training_labels(labels, few)
    assert 0 < total <= few.most_rows and rows.count() == total
    assert toxicity.training_labels(labels, replace(few, most_rows=10**6))[1] == len(ids)


def test_toxicity_states_are_averaged_in_tasks(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, made_up(rng, 12) + (" vile scum" if i % 3 == 0 else "")) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    settings, sent, plain = toxicity.Settings(shard_rows=30, l1=0.5), [], type(frame).toArrow

    def seen(df):
        sent.append(plain(df))
        return sent[-1]

    monkeypatch.setattr(type(frame), "toArrow", seen)
    weights = toxicity.fit(frame, labels, settings)
    # Four shards' states are 33 MB; only counts of labels and weights other than zero come to the driver.
    assert np.count_nonzero(weights) and sum(x.nbytes for x in sent) < 1 << 17

    shards = defaultdict(list)
    for r in frame.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)).alias("shard"),
                          F.xxhash64("doc_id", "text").alias("at")).collect():
        shards[r["shard"]].append(r)
    models = []
    for _, part in sorted(shards.items()):
        models.append(toxicity.Ftrl(settings))
        for epoch in range(settings.epochs):
            for r in sorted(part, key=lambda r: ((r["at"] * (2 * epoch + 3)) & 0xFFFF, r["at"])):
                models[-1].learn(toxicity.features(r["text"]).astype(np.int64), int(r["doc_id"] % 3 == 0))
    z, n = (sum(getattr(m, c).astype(np.float32).astype(float) for m in models) for c in "zn")
    heard = np.maximum(sum((m.n > 0).astype(int) for m in models), 1)
    want = toxicity.Ftrl(settings, z / heard, n / heard).weights(np.arange(len(z)))
    assert np.allclose(weights, want, rtol=1e-9, atol=0)


def test_scores_of_two_corpora_in_one_session_do_not_mix(spark):
    rng = random.Random(11)
    frames = []
    for letters in ("abc", "xyz"):
        words = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(60)]
        frames.append(spark.createDataFrame([(i, " ".join(rng.choices(words, k=30))) for i in range(40)], "doc_id long, text string"))

    def scores(frame):
        return sorted((r["doc_id"], round(r["score"], 9)) for r in lattice.score(frame, F.col("doc_id") % 5 > 0).collect())

    alone = [scores(f) for f in frames]
    assert [scores(f) for f in (*frames, *reversed(frames))] == [*alone, *reversed(alone)]


def test_crc_of_an_id_is_that_of_its_text(spark):
    from tieout.llm.queries import remainder

    for r in spark.range(-3, 30).withColumnRenamed("id", "doc_id").select("doc_id", remainder(5).alias("r")).collect():
        assert r["r"] == zlib.crc32(str(r["doc_id"]).encode()) % 5
