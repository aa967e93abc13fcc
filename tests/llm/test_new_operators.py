"""Yinyang clustering, repeated-phrase automata and the prefix trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from relquill.llm import phrase_automata, prefix_trie, queries, yinyang

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_clusters(rows, k, rounds, dim, scale=256, salt="2"):
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of the usable rows, comparing everything with everything."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"{salt}:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if members:
                centroids[n] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = defaultdict(int)
    for _, n, d in found:
        sums[n] += d
    return [(i, n, d, sums[n], sum(sums.values()), centroids[n]) for i, n, d in found]


@pytest.mark.parametrize(("k", "spread"), [(40, 1.0), (7, 0.05), (25, 20_000.0), (400, 1.0)])
def test_yinyang(spark, k, spread):
    r = random.Random(k)
    heads = [[r.gauss(0, spread) for _ in range(6)] for _ in range(9)]
    rows = [(n, [x + r.gauss(0, spread / 5) for x in r.choice(heads)]) for n in range(300)]
    rows += [(300 + n, rows[0][1]) for n in range(90)]  # many alike
    rows += [(0, rows[5][1]), (None, rows[3][1]), (500, [0.0] * 5), (501, None), (502, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (505, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    found = sorted((tuple(x) for x in yinyang.cluster(df, k=k, dim=6).collect()), key=key)
    assert found == sorted(slow_clusters(rows, k, 5, 6), key=key)
    assert yinyang.cluster(df.where("false"), k=k, dim=6).collect() == []
    assert yinyang.cluster(df.where("vec_id = 501"), k=k, dim=6).collect() == []


def test_yinyang_bounds_hold_and_spare_distances():
    """Bounds never exclude the nearest centroid, and save most distances once centroids settle."""
    r = np.random.default_rng(3)
    x = (r.normal(size=(40, 1, 16)) * 300 + r.normal(size=(40, 50, 16)) * 20).reshape(-1, 16).astype(np.int64)
    centroids, before = x[::50].copy(), None
    group = yinyang.grouped(centroids, 4)
    own, upper, lower = np.zeros(len(x), np.int64), np.sqrt(yinyang.squared(x, np.broadcast_to(centroids[0], x.shape)).astype(float)), np.zeros((len(x), int(group.max()) + 1))
    taken = []
    for _ in range(6):
        own, upper, lower, n = yinyang.Round(centroids, before, group).assign(x, own, upper, lower)
        taken.append(n)
        every = yinyang.all_squared(x, centroids)
        assert (own == every.argmin(axis=1)).all()
        assert (upper**2 * (1 + 1e-6) + 1e-6 >= every[np.arange(len(x)), own]).all()
        every[np.arange(len(x)), own] = np.iinfo(np.int64).max
        for g in range(lower.shape[1]):
            least = every[:, group == g].min(axis=1).astype(float)
            assert (lower[:, g] <= np.sqrt(least) * (1 + 1e-6) + 1e-6).all()
        before, centroids = centroids, np.stack([x[own == n].sum(axis=0) // max(1, (own == n).sum()) if (own == n).any() else centroids[n] for n in range(len(centroids))])
    assert taken[-1] < taken[0] / 4


def slow_repeats(rows, n=13):
    """[(id, words, removed, kept)] by looking all windows up in a dictionary."""
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for p in range(len(words) - n + 1):
            if i is not None:
                w = tuple(words[p : p + n])
                least[w] = min(least.get(w, i), i)
    out = []
    for i, words in split:
        gone = set()
        for p in range(len(words) - n + 1):
            if i is not None and least[tuple(words[p : p + n])] < i:
                gone |= set(range(p, p + n))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(words) - len(kept), b" ".join(kept).decode()))
    return sorted(out, key=str)


def repeated_texts(seed=4):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Red", "red", "über", "日本", "x\x00y", "a b", "."]
    passage = [" ".join(r.choices(words, k=n)) for n in (13, 14, 20, 40, 12)]
    text = lambda n: " ".join(r.choices(words, k=n))
    rows = [(k, text(r.randint(1, 40)) + "  \n" + r.choice(passage) + "\t" + text(r.randint(0, 30))) for k in range(80)]
    rows += [(100 + k, rows[3][1]) for k in range(60)]  # copies
    near = text(80).split()
    for k in range(40):  # near copies
        own = list(near)
        own[r.randrange(80)] = "other"
        rows.append((200 + k, " ".join(own)))
    rows += [(7, rows[8][1]), (7, rows[9][1]), (9, rows[9][1]), (9, rows[9][1]), (None, rows[3][1]), (None, passage[2]), (-5, passage[3]), (400, None), (401, ""), (402, " \x0b\f"), (403, passage[4])]
    rows += [(404, "a " * 500), (405, "a " * 300), (406, passage[0].upper()), (407, passage[1].replace(" ", " ")), (408, "b " + "a " * 13 + "c")]
    return rows


@pytest.mark.parametrize(("block", "phrases", "salt"), [(5_000_000, 50_000, 256), (700, 40, 2), (1, 13, 1)])
def test_phrase_automata(spark, monkeypatch, block, phrases, salt):
    monkeypatch.setattr(phrase_automata, "PHRASES", phrases)
    monkeypatch.setattr(phrase_automata, "SALT_BLOCKS", salt)
    rows = repeated_texts()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, kept string, block string").repartition(3)
    found = phrase_automata.without_repeats(df, block_bytes=block)
    assert sorted((tuple(x) for x in found.collect()), key=str) == slow_repeats(rows)
    assert phrase_automata.without_repeats(df.where("false")).collect() == []


def test_phrase_automata_share_one_shuffle_of_texts(spark, capsys):
    df = spark.createDataFrame(repeated_texts(), "doc_id long, text string")
    found = phrase_automata.without_repeats(df)
    found.collect()
    assert found._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 3


def slow_trie(rows):
    """The rows of the contract, node by node over dictionaries of prefixes."""
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - int(np.fmod(c, 5))
        built[c] = tuple(own.get(first, [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    children = defaultdict(int)
    for key in nodes:
        if key:
            children[key[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, members in nodes.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(members) - 1) * len(key[-1][1]) if key else 0
    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(key)))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), children[key], leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=6):
    r = random.Random(seed)
    rows = []
    for c in range(-12, 160):
        n = r.randint(0, 9)
        base = c - c % 5 if r.random() < 0.7 else c
        rows += [(c, t, ["user", "assistant"][t % 2], f"turn {t} of {base % 15} é") for t in range(n)]
    rows += [(300 + 5 * k, t, "user", f"hot {t}") for k in range(80) for t in range(3)]  # equal conversations
    rows += [(1000, t, "user", f"long {t}") for t in range(300)] + [(1001, t, "user", f"long {t}") for t in range(250)]
    rows += [(None, 1, "user", "nobody"), (2000, None, None, None), (2000, None, "user", ""), (2000, 3, None, "x"), (2000, 3, "", "x"), (2001, 1, "a", "b:c"), (2002, 1, "a:b", "c"), (2**40, 0, "user", "hot 0")]
    return rows


@pytest.mark.parametrize(("turns", "tasks"), [(250_000, 16), (40, 40), (250_000, 1)])
def test_prefix_trie(spark, monkeypatch, turns, tasks):
    monkeypatch.setattr(prefix_trie, "TURNS", turns)
    monkeypatch.setattr(prefix_trie, "TASKS", tasks)
    rows = conversations()
    df = spark.createDataFrame([(*x, "k") for x in rows], "conv_id long, turn long, role string, text string, digest string").repartition(3)
    assert sorted((tuple(x) for x in prefix_trie.prefix_trie(df).collect()), key=str) == slow_trie(rows)
    assert prefix_trie.prefix_trie(df.where("false")).collect() == []
    assert prefix_trie.prefix_trie(df.where("conv_id IS NULL")).collect() == []


def test_sweeps_stitched_at_any_boundary():
    """Sweeps of any cut of the sorted conversations, stitched, give the nodes of one sweep."""
    r = random.Random(2)
    convs = sorted((tuple(bytes([r.randint(0, 1)]) for _ in range(r.randint(0, 5))), c) for c in range(60))

    def nodes(cuts):
        rows = []
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(convs)], strict=True)):
            sweep = prefix_trie.Sweep(part)
            for key, c in convs[a:b]:
                sweep.feed(c, list(key), [3] * len(key))
            sweep.finish()
            rows += [dict(zip(prefix_trie.FIELDS, x, strict=True)) for x in sweep.rows]
        made, places = prefix_trie.stitch([x for x in rows if x["from_left"] or x["to_right"]])
        at = {(part, place): conv for part, place, _, conv in places}
        inner = [(x["conv_id"], x["depth"], at.get((x["part"], x["parent"]), x["parent_conv_id"]), *(x[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))) for x in rows if not (x["from_left"] or x["to_right"])]
        return sorted(inner + [x[1:] for x in made], key=str)

    whole = nodes([])
    for _ in range(60):
        assert nodes(sorted(r.sample(range(1, 60), r.randint(1, 30)))) == whole


@pytest.mark.parametrize("name", ["op11_yinyang", "op12_phrase_automata", "op13_prefix_trie"])
def test_new_queries_on_empty_tables(spark, tmp_path, name):
    for table, schema in (("embeddings", "vec_id long, embedding array<float>, label int"), ("documents", DOCS), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_phrase_automata_look_at_shared_windows_only():
    """Anchors by partition and the hashes that meet, against plain ways; words in windows that no passage has aren't looked at."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    values = np.concatenate([rng.choice(keys, 50), rng.integers(0, 1 << 63, 500, dtype=np.uint64), keys[:1] ^ np.uint64(1 << 40)])
    places, at = phrase_automata.met(keys, values)
    assert places.tolist() == np.flatnonzero(np.isin(values, keys)).tolist() and (keys[at] == values[places]).all()
    assert phrase_automata.met(keys[:0], values)[0].size == phrase_automata.met(keys, values[:0])[0].size == 0
    shared = [f"s{k}" for k in range(15)]
    texts = [" ".join([f"a{k}" for k in range(40)] + shared), " ".join(shared + [f"b{k}" for k in range(30)]), "short", None]
    block = phrase_automata.Block(phrase_automata.ipc(pa.array([4, 9, 11, None], pa.int64()), pa.array([x and x.encode() for x in texts], pa.binary())))
    found, part, many, at = phrase_automata.distinct_anchors(block, 5)
    own = block.anchors()
    assert list(zip(part.tolist(), found.tolist(), strict=True)) == sorted({(int(x % np.uint64(5)), int(x)) for x in own}) and (found[at] == own).all()
    assert {int(x): bool(m) for x, m in zip(found, many, strict=True)} == {int(x): len(set(block.doc[own == x])) > 1 for x in own}
    held, starts = phrase_automata.needed(block, [b" ".join(x.encode() for x in shared)])
    assert held == [(0, [x.encode() for x in shared])] and starts.tolist() == [40, 41, 42, 55, 56, 57]
