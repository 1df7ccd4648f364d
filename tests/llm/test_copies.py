"""Groups of copies in the Jaccard join: one stands for all, and foreign hubs make no pairs of them."""

import random
from itertools import combinations

import pytest

from findlake.llm import jaccard


def text(*names):
    return " ".join(names)


def run_of(name, n):
    return [f"{name}{k}" for k in range(n)]


def by_hand(texts):
    sets = []
    for body in texts:
        w = body.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def joined(spark, texts, folder):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(folder))
    found = jaccard.near_duplicates(spark.read.parquet(str(folder)))
    return sorted(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect())


def test_equal_shared_shingles_with_and_without_a_link(spark, tmp_path):
    """Twelve texts of 30 common and 5 own words: too far from each other, linked by the plain one."""
    groups = []
    for name, bridge in (("a", True), ("b", False)):
        groups += [text(*run_of(name, 30), *run_of(f"{name}own{k}x", 5)) for k in range(12)]
        groups += [text(*run_of(name, 30))] if bridge else []
    groups += [text(*run_of("c", 40), f"end{k}") for k in range(6)] + ["one two"] * 3 + ["", " "]
    random.Random(3).shuffle(groups)
    assert joined(spark, groups, tmp_path / "t") == by_hand(groups)


@pytest.mark.parametrize("copies", [40, 160])
def test_foreign_hubs_make_no_pairs_of_copies(spark, tmp_path, monkeypatch, copies):
    """Two foreign texts share the rarest words of all copies; pairs don't grow with the copies."""
    sizes = []
    plain = jaccard.written

    def counted(df, label):
        out = plain(df, label)
        if label == "pairs":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    body = run_of("w", 60)
    texts = [text(*body[:30], *run_of("p", 12)), text(*body[:30], *run_of("q", 12))] + [text(*body)] * copies
    texts += [text(*run_of("s", 10), *run_of("u", 30))] * copies + [text(*run_of("s", 10), *run_of("v", 30))] * copies
    assert joined(spark, texts, tmp_path / "t") == by_hand(texts)
    assert sum(sizes) < 20
