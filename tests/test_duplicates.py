"""Duplicate queries beyond the size at which their SQL holds, against plain versions."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from sievestone.plans import QUERIES


def plain(docs):
    """Frequencies of shingles, cutoff, and scores of pairs, by comparing all that share a rare shingle."""
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w, _ in docs}
    df = Counter(s for own in sets.values() for s in own)
    cutoff = max(20, len(docs) * 5 // 100)
    weight = {s: min(8, (len(docs) // n).bit_length()) for s, n in df.items() if n < cutoff}
    lang, whole, shared = {i: x for i, _, x in docs}, {i: sum(weight.get(s, 0) for s in own) for i, own in sets.items()}, Counter()
    posted = defaultdict(list)
    for i, own in sets.items():
        for s in own & weight.keys():
            posted[s].append(i)
    for s, ids in posted.items():
        for a, b in combinations(sorted(ids), 2):
            if lang[a] == lang[b]:
                shared[a, b] += weight[s]
    scores = {(a, b): (n * 100 + (u := whole[a] + whole[b] - n) // 2) // u for (a, b), n in shared.items()}
    return df, cutoff, {p: s for p, s in scores.items() if s >= 82}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """1,300 texts: 60 near copies, 50 equal ones in two languages, a passage in 62 texts, 100 copies (too common), and the rest."""
    rng = np.random.default_rng(2)
    some = lambda n: [f"w{k}" for k in rng.integers(0, 300, n)]
    base, equal, passage, common = some(60), some(50), some(40), some(45)
    texts = []
    for k in range(1300):
        w = some(int(rng.integers(38, 70)))
        if k < 60:
            w = list(base)
            for at in rng.integers(0, 60, k % 4):
                w[at] = "z"
        elif k < 110:
            w = equal
        elif k < 172:
            w = passage + some(8)
        elif k < 272:
            w = common
        texts.append((k * 7 % 1300, w, "de" if k % 5 == 0 else "en"))
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, " ".join(w), lang) for i, w, lang in texts], "doc_id long, text string, lang string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, [t for t in texts if len(t[1]) >= 40]


def test_pairs_beyond_48_documents(spark, corpus):
    folder, docs = corpus
    _, cutoff, want = plain(docs)
    got = {(r.l, r.r): r.score for r in QUERIES["near_duplicate_pairs"](spark, folder).collect()}
    assert cutoff > 50 and len(want) > 1000 and got == want


def test_groups_beyond_48_documents(spark, corpus):
    folder, docs = corpus
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in plain(docs)[2]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {r.id: r.component for r in QUERIES["near_duplicate_groups"](spark, folder).collect()} == {x: find(x) for x in list(root)}


def test_weights_beyond_48_documents(spark, corpus):
    folder, docs = corpus
    df, cutoff, _ = plain(docs)
    want = defaultdict(list)
    for n in df.values():
        if n < cutoff:
            want[min(8, (len(docs) // n).bit_length())].append(n)
    got = {r.weight: (r.n_shingles, r.lowest, r.highest) for r in QUERIES["rare_shingle_weights"](spark, folder).collect()}
    assert got == {w: (len(n), min(n), max(n)) for w, n in want.items()} and max(h for _, _, h in got.values()) >= 48


def test_candidates_by_96_functions(spark, corpus):
    """Pairs of similarity 0.82 or more are met (all but 5e-7 of them), and estimates are close to the similarity."""
    folder, docs = corpus
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w, _ in docs}
    posted, near = defaultdict(set), {}
    for i, own in sets.items():
        for s in own:
            posted[s].add(i)
    for i, own in sets.items():
        for j in set().union(*(posted[s] for s in own)):
            if i < j:
                near[i, j] = len(own & sets[j]) / len(own | sets[j])
    rows = QUERIES["minhash_estimate_96"](spark, folder).collect()
    got = {(r.l, r.r): r.estimate for r in rows}
    assert len(rows) == len(got) and {p for p, s in near.items() if s >= 0.82} <= got.keys()
    off = [e - 100 * near.get(p, 0) for p, e in got.items()]
    assert max(abs(x) for x in off) <= 25 and abs(np.mean(off)) < 5
    assert all(got[p] == 100 for p, s in near.items() if s == 1)
