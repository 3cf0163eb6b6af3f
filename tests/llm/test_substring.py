"""Substring dedup against brute force: windows, exact passages, near passages, clean texts, cutting."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lineweave.llm import substring

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(_LOW))


def test_windows_are_all_maximal_ones():
    rng = np.random.default_rng(1)
    for _ in range(15):
        sizes = rng.integers(0, 40, 6)
        off = np.concatenate([[0], np.cumsum(sizes)])
        v = rng.integers(0, 2**63, off[-1]).astype(np.uint64)
        want = set()
        for d in range(6):
            for i in range(off[d], off[d + 1]):
                for j in range(i + 4, off[d + 1]):
                    c = i + int(np.argmin(v[i : j + 1]))
                    left, right = c, c
                    while left > off[d] and v[left - 1] > v[c]:
                        left -= 1
                    while right + 1 < off[d + 1] and v[right + 1] > v[c]:
                        right += 1
                    want.add((left, c, right))
        assert sorted(zip(*[x.tolist() for x in substring.compact_windows(v, off, 5)], strict=True)) == sorted(want)
    left, _, right = substring.compact_windows(np.full(3000, 7, np.uint64), np.array([0, 3000]), 50)
    assert len(left) > 20 and (right - left + 1 >= 50).all()  # equal values make low trees


def prose(rng, n):
    return " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(300)}" for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (50, 51, 60, 90, 200)]
    rows, holds = [], {}
    for i in range(80):
        own = [prose(rng, rng.randrange(0, 120))]
        for k, p in enumerate(passages):
            if rng.random() < 0.15:
                own += [p.upper() if rng.random() < 0.5 else p, prose(rng, rng.randrange(0, 60))]
                holds.setdefault(k, []).append(i)
        rows.append((i, " \n ".join(own)))
    return rows, passages, holds


def test_every_exact_passage_is_found_and_clean_texts_are_left_alone(spark):
    rows, _, _ = corpus()
    seen, dirty = {}, set()
    for i, t in rows:
        w = tokens(t)
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    for ids in seen.values():
        if len(ids) > 1:
            dirty |= ids
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == dirty
    words_of = {i: tokens(t) for i, t in rows}
    covered = {}
    for r in got:
        assert r.end_word - r.start_word >= 50 and r.mate_id <= r.doc_id and r.kept == (r.mate_id == r.doc_id)
        assert r.similarity >= 0.8
        covered.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    for i, w in words_of.items():
        for k in range(len(w) - 49):
            if len(seen[tuple(w[k : k + 50])]) > 1:
                assert any(a <= k and k + 50 <= b for a, b in covered[i]), (i, k)


def test_near_passages(spark):
    rng = random.Random(4)
    base = prose(rng, 200).split()
    swapped = [w if k not in (60, 130) else "changed" for k, w in enumerate(base)]
    inserted = [*base[:100], "extra", *base[100:]]
    far = [w if k % 9 else "changed" for k, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, prose(rng, 30) + " " + " ".join(swapped)), (3, " ".join(inserted) + " " + prose(rng, 20)), (4, " ".join(far))]
    got = {r.doc_id: r for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("not kept").collect()}
    assert sorted(got) == [2, 3]
    assert (got[2].start_word, got[2].end_word, got[2].mate_id) == (30, 230, 1)
    assert (got[3].start_word, got[3].end_word) == (0, 201)


def test_edge_cases(spark):
    same = " ".join(f"w{k}" for k in range(60))
    rows = [(1, None, "a"), (2, "", "b"), (3, "few words", "c"), (None, same, "d"), (5, same, "e"), (5, same, "f"), (6, same + " tail", "g"), (7, ("again " * 400).strip(), "h"), (8, ("again " * 300).strip(), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, value string").selectExpr("doc_id", "text", "value", "1 as id", "2 as _spans", "3 as place")
    got = substring.repeats(df).collect()
    assert {(r.doc_id, r.mate_id) for r in got} == {(6, 5), (5, 5), (8, 7), (7, 7)}
    assert substring.repeats(df.limit(0)).collect() == []
    cut = substring.without_repeats(df)
    assert cut.columns == df.columns
    texts = {(r.doc_id, r.value): r.text for r in cut.collect()}
    assert len(texts) == len(rows) and texts[6, "g"] == "tail" and texts[5, "e"] == texts[5, "f"] == same and texts[1, "a"] is None and texts[7, "h"] == ("again " * 400).strip()


def test_cut_texts_keep_what_is_their_own(spark):
    rows, passages, holds = corpus(2)
    cut = {r.doc_id: r.text for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, ids in holds.items():
        text = tokens(passages[k])
        have = [i for i in cut if any(tokens(cut[i])[j : j + len(text)] == text for j in range(len(tokens(cut[i]))))]
        assert have == [min(ids)] if len(set(ids)) > 1 else True
    once = {i for i, t in rows} - {i for ids in holds.values() for i in ids}
    assert all(cut[i] == dict(rows)[i] for i in once)


def test_hot_passage_in_very_long_texts(spark):
    rng = random.Random(9)
    p = prose(rng, 70)
    rows = [(k, prose(rng, 20) + " " + p) for k in range(200)] + [(500, prose(rng, 60_000) + " " + p)]
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {*range(200), 500} and all(r.mate_id == 0 for r in got)


def missed(spark, rows, copies):
    """Passages of `copies` (words -> ids) that no row of repeats() covers in the later one of their texts."""
    words_of = {i: tokens(t) for i, t in rows}
    covered = {}
    for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        covered.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    out = []
    for p, ids in copies.items():
        own = words_of[max(ids)]
        at = next(k for k in range(len(own)) if own[k : k + len(p)] == list(p))
        if not any(a <= at and at + len(p) <= b for a, b in covered.get(max(ids), [])):
            out.append(ids)
    return out


def test_exact_copies_behind_edited_versions(spark):
    """Versions with smaller ids, too far from the copies to verify, come first under nearly all values."""
    rng = random.Random(11)
    rows, copies, i = [], {}, 0
    for _ in range(30):
        p = prose(rng, 60).split()
        for _ in range(20):
            own = list(p)
            for k in rng.sample(range(20, 40), 3):
                own[k] = prose(rng, 1) + "x"
            rows.append((i, " ".join([prose(rng, 20), *own, prose(rng, 20)])))
            i += 1
        copies[tuple(p)] = (i, i + 1)
        rows += [(i + k, " ".join([prose(rng, 20), *p, prose(rng, 20)])) for k in (0, 1)]
        i += 2
    assert missed(spark, rows, copies) == []


def test_exact_repeats_that_begin_with_a_frequent_line(spark):
    """45 words that 1,500 texts hold, followed by 15 words that only two of them share."""
    rng = random.Random(12)
    line = prose(rng, 45)
    rows = [(i, " ".join([prose(rng, 30), line, prose(rng, 40)])) for i in range(1500)]
    copies = {}
    for k in range(40):
        tail = prose(rng, 15)
        copies[tuple(f"{line} {tail}".split())] = (2000 + 2 * k, 2001 + 2 * k)
        rows += [(2000 + 2 * k + j, " ".join([prose(rng, 30), line, tail, prose(rng, 25)])) for j in (0, 1)]
    assert missed(spark, rows, copies) == []


def test_fragments_of_the_passage_come_first(spark):
    """The first text of each group holds 45 and 40 words of a passage that the two others share whole."""
    rng = random.Random(13)
    rows, copies = [], {}
    for g in range(150):
        p = prose(rng, 60).split()
        rows.append((3 * g, " ".join([prose(rng, 15), *p[:45], prose(rng, 25), *p[20:], prose(rng, 15)])))
        copies[tuple(p)] = (3 * g + 1, 3 * g + 2)
        rows += [(3 * g + k, " ".join([prose(rng, 20), *p, prose(rng, 20)])) for k in (1, 2)]
    assert missed(spark, rows, copies) == []


def edited(rng, words, n=1):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = prose(rng, 1) + "x"
    return out


def test_recall_of_near_passages(spark):
    """Passages with one word in sixty changed, whatever comes first: nothing, their fragments, edited versions, a
    frequent line before them."""
    rng = random.Random(14)
    rows, pairs, i = [], {"plain": [], "fragments": [], "versions": [], "line": []}, 0
    line = prose(rng, 38).split()

    def put(words):
        nonlocal i
        rows.append((i, " ".join([prose(rng, 20), *words, prose(rng, 20)])))
        i += 1
        return i - 1

    for _ in range(600):
        put(line)
    for _ in range(60):
        for kind in pairs:
            p = (line if kind == "line" else []) + prose(rng, 30 if kind == "line" else 64).split()
            if kind == "fragments":
                put([*p[:45], *prose(rng, 20).split(), *p[24:]])
            for _ in range(12 if kind == "versions" else 0):
                put(edited(rng, p[:20], 2) + edited(rng, p[20:44], 2) + edited(rng, p[44:], 2))
            a = put(p)
            pairs[kind].append((a, put(edited(rng, p)), len(p)))
    got = {}
    for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("not kept").collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    for kind, all_ in pairs.items():
        found = [any(min(e, 20 + n) - max(a, 20) >= 50 for a, e in got.get(later, [])) for _, later, n in all_]
        assert sum(found) >= 0.9 * len(found), (kind, sum(found))


def test_a_text_in_parts(spark, monkeypatch):
    """Cut into overlapping parts, a long text gives what it gives as a whole."""
    rng = random.Random(15)
    p = prose(rng, 80)
    rows = [(1, " ".join([prose(rng, 9000), p, prose(rng, 6000), p, prose(rng, 7000)])), (2, " ".join([prose(rng, 30), p]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, substring.repeats(df).collect()))
    monkeypatch.setattr(substring, "PART", 4000)
    parts = substring._texts(iter(df.toArrow().select(["doc_id", "text"]).to_batches()), 5, 46)
    assert len(list(parts)) > 6
    assert len(want) >= 2 and {r.doc_id for r in substring.repeats(df).collect()} == {w[0] for w in want}
    with_text_ids = df.selectExpr("cast(doc_id as string) as doc_id", "text")
    with pytest.raises(TypeError, match="whole numbers"):
        substring.repeats(with_text_ids)
