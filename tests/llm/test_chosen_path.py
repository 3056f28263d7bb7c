import random
import re

import numpy as np
import pytest

from tarn.llm import chosen_path as cp
from tarn.llm.components import components


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(rows, percent=75):
    """(n_shingles, component_id) of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and shared and 100 * shared >= percent * (len(a) + len(sets[j]) - shared) and label[i] != label[j]:
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [r[0] for r, x in zip(rows, label, strict=True) if x == label[i] and r[0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def found(df, **options):
    rows = cp.near_duplicates(df, **options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)


def test_all_kinds_of_rows(docs, empty):
    assert found(docs) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert cp.near_duplicates(empty).count() == 0


def test_corpus(corpus, texts):
    assert found(corpus) == plain(list(texts.items()))


@pytest.fixture(scope="module")
def families(spark):
    """A hub whose many copies resemble it but hardly each other, a chain, a shared passage, and texts around the threshold."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    fresh = lambda n: [word() for _ in range(n)]
    texts = []
    hub = fresh(120)
    texts.append(hub)
    for _ in range(60):
        copy = list(hub)
        for at in rng.sample(range(0, 120, 12), 3):
            copy[at] = word()
        texts.append(copy)
    chain = fresh(200)
    for _ in range(12):
        texts.append(list(chain))
        at = rng.randrange(0, 170)
        chain[at : at + 18] = fresh(18)
    passage = fresh(60)
    texts += [fresh(80) + passage + fresh(60) for _ in range(40)]
    for gap in range(1, 30, 2):
        base = fresh(100)
        texts += [base, base[:-gap] + fresh(gap)]
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")


def test_families(families):
    assert found(families) == plain([tuple(r) for r in families.collect()])


def test_small_nodes_and_blocks_give_the_same(families):
    """Leaves of four documents force deeper levels and whole nodes; tiny tasks force the two rounds of blocks."""
    assert found(families, leaf=4, task_shingles=1500) == plain([tuple(r) for r in families.collect()])


@pytest.fixture(scope="module")
def templates(spark):
    """Pages of two templates whose own words differ, some of them copied closely, and one that is nearly the bare template."""
    own = random.Random(11)
    fresh = lambda n: ["".join(own.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    texts = []
    for _ in range(2):
        template = fresh(120)
        pages = [template + fresh(30) for _ in range(60)] + [template + fresh(n) for n in range(2, 30)]
        copies = [page[:-2] + fresh(2) for page in pages[::7]] + [template[:-4] + fresh(4)]
        texts += pages + copies + [copies[0][:-1] + fresh(1)]
    own.shuffle(texts)
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("task_shingles", [2000, 8000])
def test_templates_are_divided(templates, task_shingles):
    assert found(templates, task_shingles=task_shingles) == plain([tuple(r) for r in templates.collect()])


def test_divisions_part_no_similar_sets(spark, templates):
    """Whatever similar pair is in a group, both are in one division, or both are left to the blocks."""
    rows = [(b"g", str(i).encode(), len(cp.shingle_set(t.encode())), t.encode(), str(i).encode()) for i, t in templates.collect()]
    members = cp.written(spark.createDataFrame(rows, "group binary, key binary, n_shingles long, text binary, label binary"), "members")
    divided, alike = cp._divided(members, 75)
    division = {bytes(r["key"]): bytes(r["group"]) for r in divided.collect()}
    blocks = {bytes(r["key"]) for r in alike.collect()}
    sets = [(r[1], set(cp.shingle_set(r[3]).tolist())) for r in rows]
    pairs = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if 100 * len(x & y) >= 75 * len(x | y)]
    assert pairs and all((a in division and division[a] == division.get(b)) or {a, b} <= blocks for a, b in pairs)


def test_shingle_set():
    assert len(cp.shingle_set(b"")) == len(cp.shingle_set(None)) == len(cp.shingle_set(b" \n\t")) == 0
    assert len(cp.shingle_set(b"a b c d")) == 1 and len(cp.shingle_set(b"a b c d e f")) == 2
    assert (cp.shingle_set(b"A b\tC d e") == cp.shingle_set(b"a  B c\nd E")).all()
    assert (cp.shingle_set("É b c d e".encode()) != cp.shingle_set("é b c d e".encode())).all()
    text = " ".join(str(i % 97) for i in range(20000))
    assert len(cp.shingle_set(text.encode())) == len(shingles(text))


def test_minwise_agreement_follows_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[500:3500])
    agree = (cp.minwise(a) == cp.minwise(b)).mean()
    assert abs(agree - 2500 / 3500) < 0.2


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (5, 4), (6, 5), (7, 6), (9, 8), *[(100, 200 + i) for i in range(50)], (1, 249)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {1: 1, 2: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 8, 9: 8, 100: 1, **{200 + i: 1 for i in range(50)}}
    assert components(links.limit(0)).count() == 0


def test_trees_follow_from_the_recall_that_is_asked_for():
    assert cp.trees_for(0.95, 75, 8) == 10 and cp.agreeing(75) == 28 and cp.tree_recall(75, 0) == 0.75
    assert cp.trees_for(0.99, 75, 8) > 10 > cp.trees_for(0.8, 75, 8) and cp.trees_for(0.9, 100, 8) == 1
    rng, met = random.Random(2), 0
    for _ in range(20_000):  # the same by chance: a pair's nodes in one tree, level by level
        nodes = int(rng.random() < 0.75)
        for _ in range(8):
            nodes = sum(rng.random() < 0.75 for _ in range(nodes) for _ in range(1 + (rng.random() < 1 / 3)))
        met += nodes > 0
    assert abs(met / 20_000 - cp.tree_recall(75, 8)) < 0.02
    for bad in ((0.999999, 75), (0.95, 40), (1.0, 75)):
        with pytest.raises(ValueError):
            cp.trees_for(*bad, 8)


def test_recall_in_deep_trees(spark):
    """Sets that all share two fifths of their shingles: nodes of eight at most lie five levels down, and pairs at 0.75 still meet."""
    rng = random.Random(13)
    fresh = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    common, texts = fresh(84), []
    for i in range(900):
        own = fresh(122)
        texts.append(common + own)
        if i < 120:  # 176 shingles in common of 202 and 202: similar by 0.77
            texts.append(common + own[:96] + fresh(26))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [shingles(" ".join(t)) for t in texts[:240]]
    pairs = [(2 * i, 2 * i + 1) for i in range(120)]
    assert all(0.75 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.82 for a, b in pairs)
    rows = cp.written(cp.sketches(df, "doc_id", "text", cp.trees_for(cp.RECALL, 75, cp.LEVELS)), "test")
    named = {bytes(r["key"]): r["id"] for r in rows.collect()}
    links = [(named[bytes(r["a"])], named[bytes(r["b"])]) for r in cp.candidate_links(rows, 75, leaf=8).collect()]
    group = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    met = sum(a in group and group[a] == group.get(b) for a, b in pairs)
    assert met >= 0.9 * len(pairs)
    components_ = {r["doc_id"]: r["component_id"] for r in cp.near_duplicates(df, leaf=8).collect()}
    assert sum(components_[a] == components_[b] for a, b in pairs) >= met
