"""The training-data operators against brute force, on small fixtures with awkward rows."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from relquill.llm import backoff_lm, exact_dedup, language_mixture, license_join, mixing, piece_bpe, quality_rules, queries, simhash, toxicity, warc
from relquill.llm.common import held_out

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_texts(n=60, seed=5):
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "Red", "fox", "über", "naïve", "jumps", "x1", "日本"] + [f"w{k}" for k in range(200)]
    out = [" ".join(r.choices(vocabulary, k=r.randint(1, 90))) for _ in range(n)]
    out += [out[0], out[0] + "  \n", out[1].replace(" ", "\n"), "", None, " \t\n", "a", "a b", "z " * 3000, "same line\nsame line\nother\nsame line", "x\x00y ▁ z", out[2] + " tail"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "de", None][k % 3], None if k % 7 == 0 else f"s{k % 3 % 2}", len(t or "")) for k, t in enumerate(make_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def model():
    return piece_bpe.read_model(queries.tokenizer_path())


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language(spark, empty):
    r = random.Random(1)
    words = {"en": ["the", "thing", "when", "with", "other"], "fr": ["que", "eau", "leur", "deux", "être"]}
    text = lambda lang, n: " ".join(r.choices(words[lang], k=n))
    rows = [(k, text(lang, 40), lang, "s", 1) for k, lang in enumerate(["en", "fr"] * 30)]
    docs = spark.createDataFrame([*rows, (100, None, None, None, None), (101, "123 ---", "en", None, None), (102, text("en", 60) + " " + text("fr", 30), None, None, None), (102, text("fr", 9), None, None, None)], SCHEMA)
    fitted = language_mixture.fit(docs, "text", "lang", "doc_id", ~held_out())
    found = language_mixture.identify(docs, *fitted).collect()
    assert len(found) == 64
    assert all(x["lang_pred"] == ["en", "fr"][x["doc_id"] % 2] and 0 <= x["score"] <= 1 for x in found if x["doc_id"] < 60)
    assert {x["doc_id"]: (x["lang_pred"], x["score"]) for x in found if x["doc_id"] in (100, 101)} == {100: ("und", 0.0), 101: ("und", 0.0)}
    mixed = max((x["proportions"] for x in found if x["doc_id"] == 102), key=len)
    assert 0.5 < mixed["en"] < 0.8 and abs(sum(mixed.values()) - 1) < 1e-6
    assert language_mixture.identify(empty, *fitted).count() == 0
    clash = language_mixture.identify(docs.selectExpr("doc_id", "text", "lang score"), *fitted, keep=("doc_id", "text", "score"))
    assert clash.columns == ["doc_id", "text", "score", "lang_pred", "_score", "proportions"] and clash.count() == 64
    long = spark.createDataFrame([(1, text("en", 300_000))], "doc_id long, text string")
    assert language_mixture.identify(long, *fitted).first()["lang_pred"] == "en"
    nothing = language_mixture.fit(empty, "text", "lang", "doc_id", ~held_out())
    assert {x["lang_pred"] for x in language_mixture.identify(docs, *nothing).collect()} == {"und"}


def test_backoff(docs, empty):
    got = by_id(backoff_lm.backoff_scores(docs, block_bytes=700))
    split = {k: [w.lower() for w in (t or "").encode().split()] for k, t in enumerate(make_texts())}
    total = sum(map(len, split.values()))
    for k, words in split.items():
        one, two = Counter(), Counter()
        for j, other in split.items():
            if j != k:
                one.update(other)
                two.update(zip(other, other[1:]))
        logs, backed = [], 0
        for i, w in enumerate(words):
            if i and two[words[i - 1], w]:
                logs.append(np.log10(two[words[i - 1], w] / one[words[i - 1]]))
            else:
                backed += i > 0
                logs.append((np.log10(0.4) if i else 0) + np.log10(max(one[w], 1) / max(total - len(words), 1)))
        assert (got[k]["n_words"], got[k]["n_backed_off"]) == (len(words), backed)
        assert (got[k]["log_score"] is None) if not words else abs(got[k]["log_score"] - np.mean(logs)) < 1e-9
    assert backoff_lm.backoff_scores(empty).count() == 0


def test_toxicity(spark, empty):
    r = random.Random(2)
    plain = [f"w{k}" for k in range(120)]
    rows, labels = [], []
    for k in range(400):
        words = r.choices(plain, k=40)
        if k % 4 == 0:
            for at in r.sample(range(40), 3):
                words[at] = r.choice(["nasty", "vile", "rotten"])
        rows.append((k, " ".join(words), None, None, None))
        labels.append((k, int(k % 4 == 0)))
    docs = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", None, None, None)], SCHEMA)
    labels = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    found = by_id(toxicity.score(docs, toxicity.fit(docs.select("doc_id", "text"), labels, ~held_out())))
    assert sum(found[k]["predicted"] == (k % 4 == 0) for k in range(400)) >= 396
    assert found[900]["score"] == found[901]["score"] and found[900]["predicted"] == 0
    fitted = toxicity.fit(docs, labels, ~held_out())
    clash = toxicity.score(docs.selectExpr("doc_id", "text", "lang score", "lang body"), fitted, keep=("doc_id", "score", "body"))
    assert clash.columns == ["doc_id", "score", "body", "_score", "predicted"] and clash.count() == 402
    long = spark.createDataFrame([(1, "w1 w2 w3 " * 400_000), (1, "vile"), (1, "vile")], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score(long, fitted).collect()] == [0, 1, 1]
    wordless = docs.withColumn("text", docs.doc_id.cast("string"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, toxicity.fit(wordless, labels, ~held_out())).collect())
    assert toxicity.fit(docs, labels.where("toxic = 0"), ~held_out()) is None
    assert {x["score"] for x in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(empty, None).count() == 0


def slow_discounts(counts):
    """What is taken off a count, by the formulas of Kneser-Ney smoothing with three discounts."""
    n = [sum(x == k for x in counts) for k in (0, 1, 2, 3, 4)]
    taken = [0.0, 0.75, 0.75, 0.75]
    if all(n[1:]):
        y = n[1] / (n[1] + 2 * n[2])
        taken = [0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.375), k - 0.01) for k in (1, 2, 3))]
    return lambda x: min(x, taken[min(x, 3)])


def slow_kneser_ney(texts):
    """Levels of P(w | v) of each class from (class, words) of the counted texts, by the formulas, with dictionaries."""
    head = lambda w: w[: toxicity.HEAD]
    count = [Counter(), Counter()]
    for y, words in texts:
        count[y].update(set(zip(words, words[1:])))
    both = count[0] + count[1]
    follows = [Counter(w for _, w in c) for c in count]
    shared = Counter(w for _, w in both)
    heads = {head(w) for w in shared}

    def level(counts, x, off, below):
        """A discounted count, whose mass goes to ``below``."""
        total = sum(counts.values())
        return below if not total else (counts[x] - off(counts[x])) / total + sum(map(off, counts.values())) / total * below

    def grouped(counts):
        out = Counter()
        for w, n in counts.items():
            out[head(w)] += n
        return out

    def within(counts, h):
        return Counter({w: n for w, n in counts.items() if head(w) == h})

    off_head, off_word, off_pair = ([slow_discounts(f(c).values()) for c in cs] for f, cs in ((grouped, [*follows, shared]), (Counter, [*follows, shared]), (Counter, [*count, both])))

    def of_head(k, w, h=None):
        h = h or head(w)
        return level(grouped(follows[k]), h, off_head[k], level(grouped(shared), h, off_head[2], 1 / (len(heads) + 1)))

    def word(k, w, h=None):
        h = h or head(w)
        if h not in heads:
            return of_head(k, w, h)
        own = within(shared, h)
        return of_head(k, w, h) * level(within(follows[k], h), w, off_word[k], level(own, w, off_word[2], 1 / (len(own) + 1)))

    def after(counts, v):
        return Counter({w: n for (x, w), n in counts.items() if x == v})

    def bigram(k, v, w, h=None):
        return level(after(count[k], v), w, off_pair[k], level(after(both, v), w, off_pair[2], word(k, w, h)))

    seen = lambda v, w: (grouped(shared)[head(w)], shared[w], both[v, w])
    return of_head, word, bigram, seen, sorted(shared), sorted(heads)


def slow_features(texts, kneser_ney):
    """The four numbers of each text, word by word."""
    of_head, word, bigram, seen, _, _ = kneser_ney
    out = []
    for words in texts:
        ratios, sures = [], []
        for i, w in enumerate(words):
            v = words[i - 1] if i else None
            own = [np.log(f(1) / f(0)) for f in (lambda k: of_head(k, w), lambda k: word(k, w), lambda k: bigram(k, v, w) if i else word(k, w))]
            sure = 0.0
            for added, n in zip((own[0], own[1] - own[0], own[2] - own[1]), seen(v, w)):
                sure += np.sign(added) * max(abs(added) - toxicity.ERRORS / np.sqrt(n or 1e-9), 0)
            ratios.append(own[2])
            sures.append(sure)
        size = max(1, min(toxicity.WINDOW, len(words)))
        best = max((sum(sures[i : i + size]) / size for i in range(len(words) - size + 1) if words), default=0.0)
        out.append([float(np.mean(ratios)) if words else 0.0, best if words else 0.0, sum(sorted(sures)[-3:]) / 3, np.log(len(words)) / 10 if words else 0.0])
    return np.array(out)


def test_toxicity_is_kneser_ney(spark, monkeypatch):
    """The terms against the formulas, and the probabilities of a context sum to 1."""
    r = random.Random(12)
    vocabulary = ["aa", "bb", "worda", "wordab", "wordabc", "wordac", "other", "others", "otherwise", "c", "d", "rare1", "rare2"]
    texts = [(k % 2, r.choices(vocabulary[: 11 + k % 3], k=r.randint(1, 30))) for k in range(40)]
    columns = {c: [] for c in ("hash", "context", "last", "head", "c0", "c1")}
    count = [Counter(), Counter()]
    for y, words in texts:
        count[y].update(set(zip(words, words[1:])))
    hashed = lambda words, cut=0: toxicity.word_hashes([" ".join(words).encode()], toxicity.LETTERS, cut)[0]
    for v, w in sorted(count[0] | count[1]):
        own = hashed([v, w])
        for c, x in zip(columns, (toxicity.gram_hashes(own, np.zeros(2, np.int64), 2)[0][0], own[0], own[1], hashed([w], toxicity.HEAD)[0], count[0][v, w], count[1][v, w])):
            columns[c].append(int(np.int64(np.uint64(x).view(np.int64))) if isinstance(x, np.uint64) else x)
    grams = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} long" for c in columns))
    tables = (t.toArrow() for t in toxicity.tables(grams))
    model = toxicity.models(*({c: x.to_numpy() for c, x in zip(t.column_names, t.columns)} for t in tables))
    slow = slow_kneser_ney(texts)
    _, _, bigram, _, known, heads = slow
    for v in ["aa", "wordab", "rare2", "never"]:
        seen = [*known, "wordzz", "zzzzzzzz", "q"]
        for w in seen:
            got = toxicity.levels(model, hashed([v, w]), hashed([v, w], toxicity.HEAD), np.zeros(2, np.int64))[0][2][1]
            assert np.allclose(got, [bigram(k, v, w) for k in (0, 1)], rtol=1e-5)
        for k in (0, 1):  # all known words, one unknown word of each head, one unknown head
            assert abs(sum(bigram(k, v, w) for w in known) + sum(bigram(k, v, "\0", h) for h in heads) + bigram(k, v, "\0") - 1) < 1e-9
    some = [words for _, words in texts[:12]] + [["never"], [], ["aa"], ["zz", "rare1", "wordabc"], ["bb"] * 20 + ["worda"] * 9]
    monkeypatch.setattr(toxicity, "ERRORS", 0.5)
    got = toxicity.features(model, [" ".join(words).encode() for words in some])
    assert np.allclose(got, slow_features(some, slow), atol=1e-5) and np.abs(got[:, 1]).max() > 0.1


def test_toxicity_curve():
    """Newton's method ends where the gradient of the penalised likelihood is zero; the score is that curve."""
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 4))
    y = (x @ [2.0, -1.0, 0.5, 0.0] + r.normal(size=400) > 0.3).astype(float)
    weight = r.uniform(0.5, 2, 400)
    w = toxicity.curve(x, y, weight)
    whole = np.c_[np.ones(400), x]
    slope = whole.T @ (weight * (y - 1 / (1 + np.exp(-whole @ w)))) - np.array([1e-6, *[1e-2] * 4]) * w
    assert np.abs(slope).max() < 1e-4


def slow_language(text, languages, counts):
    """Proportions by expectation-maximisation over the words of one text, in plain Python."""
    import math

    m = language_mixture
    words, buffer = [], [int(m.FOLD[b]) for b in text.encode()] + [0]
    now = []
    for i, b in enumerate(buffer):
        if b:
            before = buffer[i - 1] if i else 0
            code = (before * 0x9E3779B1 + b * 0x85EBCA6B + buffer[i + 1] * 0xC2B2AE35) & 0xFFFFFFFF
            now.append((((code ^ (code >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF) >> 16)
        elif now:
            words.append(now)
            now = []
    log = [[sum(counts[c][k] for c in w) for k in range(len(languages))] for w in words]
    log = [[max(x - max(row), -m.CLIP) for x in row] for row in log]
    like = [[math.exp(x) for x in row] for row in log]
    sums = [sum(row[k] for row in log) for k in range(len(languages))]
    chosen = [sums.index(max(sums))]
    share, total = {chosen[0]: 1.0}, max(sums)
    while len(chosen) < len(languages):
        rise = {k: sum(row[k] / sum(row[j] * share[j] for j in chosen) for row in like) / len(like) - 1 for k in range(len(languages)) if k not in chosen}
        new = max(rise, key=lambda k: rise[k])
        trial = [*chosen, new]
        found = dict.fromkeys(trial, 1 / len(trial))
        for _ in range(m.ROUNDS):
            parts = [{k: row[k] * found[k] / sum(row[j] * found[j] for j in trial) for k in trial} for row in like]
            found = {k: sum(p[k] for p in parts) / len(like) for k in trial}
        value = sum(math.log(sum(row[k] * found[k] for k in trial)) for row in like)
        if rise[new] <= 0 or 2 * (value - total) <= m.PENALTY * math.log(max(len(like), 2)):
            break
        chosen, share, total = trial, found, value
    return {languages[k]: share[k] for k in chosen}


def test_language_against_plain_python():
    r = random.Random(9)
    words = {"a": ["mala", "kolo", "tame", "ruda"], "b": ["xeth", "wrong", "things", "thorn"], "c": ["été", "çà", "leur", "deux"]}
    languages = sorted(words)
    table = np.zeros((language_mixture.BUCKETS, 3))
    for k, lang in enumerate(languages):
        table[:, k] = np.bincount(language_mixture.trigrams([" ".join(r.choices(words[lang], k=300)).encode()])[0], minlength=len(table))
    table = np.log((table + language_mixture.SMOOTHING) / (table + language_mixture.SMOOTHING).sum(axis=0)).astype(np.float32)
    texts = [" ".join(r.choices(words[x], k=n)) + "  " + " ".join(r.choices(words[y], k=m)) for x in languages for y in languages for n, m in ((3, 0), (40, 4), (20, 20), (1, 1))]
    texts += ["", "1 2 3", "mala xeth çà " * 30]
    shares, _ = language_mixture.infer([t.encode() for t in texts], table)
    plain = table.astype(float).tolist()
    for t, row in zip(texts, shares, strict=True):
        want = slow_language(t, languages, plain) if re.search("[^ 0-9]", t) else {}
        got = {languages[k]: row[k] for k in np.flatnonzero(row)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in got)


def test_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", "", None, "é" * 300_000, "<p>b</p>", "<p>a</p>"]
    pages = spark.createDataFrame([*((k + 1, None if k == 2 else f"http://x/{k}\r\nEvil: 1", h) for k, h in enumerate(html)), (None, "u", "<p>a</p>")], "page_id long, url string, html string")
    rows = warc.round_trip(pages).collect()
    assert len(rows) == 8
    got = {r["page_id"]: r for r in rows}
    for k, h in enumerate(html):
        data = (h or "").encode()
        assert (got[k + 1]["payload_bytes"], got[k + 1]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {k: r["refers_to"] for k, r in got.items()} == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: None, 7: 1, None: None}
    assert all((r["record_type"] == "revisit") == (r["refers_to"] is not None) for r in rows)
    assert {r["record_type"] for r in warc.round_trip(pages, min_bytes=9).collect()} == {"response"}
    twice = warc.round_trip(pages.union(pages).selectExpr("*", "1 digest", "2 size", "3 first")).collect()
    assert Counter((r["page_id"], r["refers_to"]) for r in twice) == Counter((r["page_id"], r["refers_to"]) for r in rows * 2)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_mixing(spark, docs, empty, monkeypatch):
    import math

    got = Counter(r["doc_id"] for r in mixing.mix(docs, temperature=0.5, epochs=2.0, seed=3).collect())
    rows = docs.select("doc_id", "source").collect()
    sizes = Counter(r["source"] for r in rows)
    norm = sum(math.sqrt(n) for n in sizes.values())
    for r in rows:
        rate = math.sqrt(sizes[r["source"]]) / norm * len(rows) * 2 / sizes[r["source"]]
        u = int(hashlib.md5(f"3|0|{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        n, p, cdf = 0, math.exp(-rate), math.exp(-rate)
        while cdf <= u:
            n += 1
            p *= rate / n
            cdf += p
        assert got[r["doc_id"]] == n
    many = mixing.mix(docs.withColumn("source", docs.lang), weights={"en": 1.0}, epochs=300.0)
    n = many.groupBy("source").count().collect()
    assert [r["source"] for r in n] == ["en"] and abs(n[0]["count"] / (300 * len(rows)) - 1) < 0.05
    assert mixing.mix(empty).count() == 0
    clashing = ("copy", "_cdf_", "_parts_", "_times_", "_source_", "_salt_", "key", "held", "cdf", "parts", "times", "place", "salt")
    named = docs.select("*", *(docs.doc_id.alias(c) for c in clashing))
    for most in (10_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
        again = mixing.mix(named, temperature=0.5, epochs=2.0, seed=3)
        assert again.columns == [*named.columns, "_copy"]
        rows = again.collect()
        assert Counter(r["doc_id"] for r in rows) == got and all(r[c] == r["doc_id"] for r in rows for c in clashing)
    nameless = spark.createDataFrame([(None, f"t{k}", None, "s", None) for k in range(1000)], SCHEMA)
    assert 880 < mixing.mix(nameless, epochs=1.0).count() < 1120 and mixing.mix(nameless.union(nameless)).groupBy("text").count().where("count % 2 = 1").count() == 0


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_exact_dedup(docs, empty, monkeypatch, most):
    """Both ways to join the groups give one result; only texts that share a length and a head are hashed."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", most)
    groups, shapes = {}, Counter()
    for k, t in enumerate(make_texts()):
        body = re.sub("[\x20\x09-\x0d]", "", t or "")
        groups.setdefault(body, []).append((-len(t or ""), k))
        shapes[len(body.encode()), body[:64]] += 1
    got = by_id(exact_dedup.exact_duplicates(docs.withColumn("sha", docs.lang).withColumn("held", docs.source), keep=("sha", "held", "lang")))
    for body, members in groups.items():
        sha = hashlib.sha256(body.encode()).hexdigest() if shapes[len(body.encode()), body[:64]] > 1 else None
        for _, k in members:
            assert (got[k]["keep_id"], got[k]["group_size"], got[k]["kept"], got[k]["text_sha256"]) == (min(members)[1], len(members), min(members)[1] == k, sha)
            assert got[k]["sha"] == got[k]["lang"] == ["en", "de", None][k % 3]
    assert exact_dedup.exact_duplicates(empty).count() == 0
    twice = exact_dedup.exact_duplicates(docs.union(docs))
    assert twice.where("kept").count() == len(groups)
    clashing = docs.withColumn("_sha", docs.lang).withColumn("id", docs.lang).withColumn("Held", docs.lang)
    left = exact_dedup.drop_copies(clashing.union(clashing).union(clashing.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars", "_sha", "id", "Held")))
    assert left.columns == clashing.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(min(g)[1] for g in groups.values())


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_exact_dedup_hashes_survivors_only(docs, monkeypatch, most):
    """Heads are hashed of texts that share a length, whole texts of those that share a head as well."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", most)
    bodies = [re.sub("[\x20\x09-\x0d]", "", t or "") for t in make_texts()]
    sizes, shapes = Counter(len(b.encode()) for b in bodies), Counter((len(b.encode()), b[:64]) for b in bodies)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), exact_dedup.normalised(F.col("text")).alias("body"))
    got = by_id(exact_dedup.refined(rows))
    for k, b in enumerate(bodies):
        assert (got[k]["head"] is not None) == (sizes[len(b.encode())] > 1)
        assert (got[k]["sha"] is not None) == (shapes[len(b.encode()), b[:64]] > 1)
    heads, whole = (sum(got[k][c] is not None for k in range(len(bodies))) for c in ("head", "sha"))
    assert 0 < whole < heads < len(bodies)


def test_exact_dedup_query(spark):
    """The query's digests of all texts, the uniques' too, on the smallest table."""
    texts = {r["doc_id"]: re.sub("[\x20\x09-\x0d]", "", r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = by_id(queries.op6_exact_dedup(spark, "/root/testdata/sf0.001"))
    assert {k: r["text_sha256"] for k, r in got.items()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}


def test_license_scan(spark, docs, empty):
    rows = [(0, "Released under the MIT License. MIT LICENSE"), (1, "x\nThis work is licensed under the GNU General Public\nLicense, version 3."), (2, "mit of license"), (3, None), (4, "Licensed under CC BY-NC 4.0"), (5, "the and of under this work is")]
    got = by_id(license_join.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["labels"]) == (7, 2, 3, 5, "mit,mit-notice")
    assert (got[1]["base_labels"], got[1]["labels"]) == ("gpl", "gpl,gpl-3.0-notice")
    assert [got[k]["labels"] for k in (2, 3, 4, 5)] == ["", "", "cc-by-nc-4.0-notice", ""]
    assert (got[3]["n_words"], got[3]["first_word"], got[3]["score"]) == (0, None, 0.0)
    assert license_join.license_scan(empty).count() == 0
    import duckdb

    import textwrap

    texts = [(k, f"{t or ''}\n{license_join.TEMPLATES[k % 9][1]}") for k, t in enumerate(make_texts())] + rows
    wrapped = [(name, "\n".join(f"# {x}" for x in textwrap.wrap(text, width))) for name, text in license_join.TEMPLATES for width in (20, 30, 40, 60, 72)]
    texts += [(0, f"some words before\n{t}\nand after") for _, t in wrapped]
    texts += [(0, "x mit license \u0085"), (0, "the mit license\u2028"), (0, "mit license \u2029\u0085"), (0, "gpl \u212aelvin GNU General Public License, version 3 this wor\u212a is licensed under the"), (0, "word " * 5000 + "MIT License")]
    texts += [(0, license_join.TEMPLATES[5][1].replace("under", "under " + "x " * n)) for n in range(8)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(k, t) for k, (_, t) in enumerate(texts)])
    rel = con.sql(license_join.license_sql())
    mine = license_join.license_scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")).select(*rel.columns)
    assert sorted(map(tuple, mine.collect()), key=repr) == sorted(rel.fetchall(), key=repr)
    at = texts.index((0, f"some words before\n{wrapped[0][1]}\nand after"))
    found = by_id(mine)
    assert all(name in found[at + k]["labels"].split(",") for k, (name, _) in enumerate(wrapped))
    assert [found[at + len(wrapped) + k]["n_base"] for k in range(3)] == [1, 0, 1] and found[at + len(wrapped)]["n_words"] == 4


def test_piece_bpe(docs, empty, model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = by_id(piece_bpe.encode_decode(docs, model))
    r = random.Random(4)
    own = piece_bpe.loaded(model)
    pool = ["a", "the", "t", "h", " ", "  ", "\n", "-", "é", "日", "🙂", "ing", "▁", "0", "\t", "=", "<", "x"]
    texts = ["".join(r.choices(pool, k=r.randint(0, 50))) for _ in range(2000)] + [" " * 5000, "-" * 5000, "ab" * 3000, "#" * 5000, "# " * 2000 + "#" * 3001 + "=-" * 1500, "".join(r.choices("#-=ab", k=9000)), "".join(r.choices(["##", "###", "#", "=", "----"], k=4000)), "<s> </s> <0x41>", "﻿\x00"]
    for t, data in zip(texts, own.encode(texts), strict=True):
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(data, "<u4").tolist() == ids and own.decode(data) == lib.decode(ids)
    for k, t in enumerate(make_texts()):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert got[k]["ids"] == ids and got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert piece_bpe.encode_decode(empty, model).count() == 0
    clash = piece_bpe.encode_decode(docs.selectExpr("doc_id", "doc_id n_tokens", "lang ids", "lang IDS_SHA256", "text"), model)
    assert clash.columns == ["doc_id", "n_tokens", "ids", "IDS_SHA256", "_n_tokens", "_ids", "_ids_sha256", "decoded_sha256"] and clash.count() == len(make_texts())
    small = piece_bpe.PieceModel(model)
    small_texts = ["x" * 100_000 + str(k) for k in range(30)] + texts
    piece_bpe.CACHE_CHARACTERS, kept = 5_000, piece_bpe.CACHE_CHARACTERS
    for t in small_texts[:200]:
        assert small.encode([t]) == own.encode([t]) and small.stored < 10_000
    piece_bpe.CACHE_CHARACTERS = kept


def test_quality(spark, docs, empty):
    awkward = [*make_texts(), "a b \u0085", "a b\u2028", "a \u2029 b \u2029", "\u0085", " x\r\n", "p \u212a q\n" * 40]
    got = by_id(quality_rules.quality(spark.createDataFrame([*enumerate(awkward)], "doc_id long, text string"), []))
    for k, t in enumerate(awkward):
        words = WORDS.findall(t or "")
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[k]["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and got[k]["kept"] == (not got[k]["base_failed"])
    r = random.Random(3)
    rows = [({f: r.random() for f in quality_rules.FEATURES} | {"symbols": r.random() * 0.1 + 0.3 * (k % 5 == 0)}, int(k % 5 == 0)) for k in range(300)]
    rules = quality_rules.learn(rows)
    assert len(rules) == 1 and rules[0][0].feature == "symbols" and rules[0][0].above and 0.09 < rules[0][0].threshold < 0.31
    assert quality_rules.quality(empty, rules).count() == 0
    assert quality_rules.learn_from(docs, spark.createDataFrame([], "doc_id long, quality int")) == []


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, radius):
    label = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(fps[a] ^ fps[b]).count("1") <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_simhash(docs, empty):
    fps = {k: slow_fingerprint(t) for k, t in enumerate(make_texts())}
    for radius in (2, 20):
        got = by_id(simhash.near_duplicates(docs, radius=radius))
        assert all(int(got[k]["fingerprint"], 16) == f for k, f in fps.items())
        assert {k: r["component_id"] for k, r in got.items()} == slow_components(sorted(fps), fps, radius)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_tiles_and_chains(spark, monkeypatch):
    """A cell of many tiles, and a chain that only links its neighbours."""
    monkeypatch.setattr(simhash, "TILE", 7)
    r = random.Random(6)
    fps = {0: 0}
    for k in range(1, 120):
        fps[k] = fps[k - 1] ^ (1 << r.randrange(12)) ^ (1 << r.randrange(12)) if k % 40 else r.getrandbits(62)
    values = sorted(set(fps.values()))
    edges = simhash.links(spark.createDataFrame([(f,) for f in values], "fp long"), 2)
    roots = {x["node"]: x["root"] for x in simhash.components(edges).collect()}
    want = slow_components(values, {f: f for f in values}, 2)
    assert {f: roots.get(f, f) for f in values} == want


def test_pipeline_keeps_its_promises(spark):
    """Each stage against brute force over its own input, on the smallest tables."""
    import sentencepiece

    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*p.COLUMNS)
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    stages = [f for _, f in p.STAGES]
    clean = stages[0](spark, docs, folder).cache()
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"), ~held_out())
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert sorted(ids(clean)) == sorted(set(ids(docs)) - toxic)
    single = stages[1](spark, clean, folder).cache()
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    groups = {}
    for k, t in text.items():
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), k))
    assert sorted(ids(single)) == sorted(min(g)[1] for g in groups.values())
    near = stages[2](spark, single, folder).cache()
    assert sorted(ids(near)) == sorted(set(slow_near({k: text[k] for k in sorted(ids(single))}).values()))
    mixed = stages[3](spark, near, folder).cache()
    assert mixed.columns == list(p.COLUMNS) and set(ids(mixed)) <= set(ids(near))
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    out = stages[4](spark, mixed, folder).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(ids(mixed))
    assert all(r["ids"] == lib.encode(text[r["doc_id"]], add_bos=True, add_eos=True) for r in out)


def shingles_of(text, n=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else {b""}


def slow_near(texts):
    """Component of each id of ``texts``, by the Jaccard similarity of all pairs."""
    sets, label = {k: shingles_of(t) for k, t in texts.items()}, {k: k for k in texts}
    for a in sets:
        for b in sets:
            if a < b and label[a] != label[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def test_near_copies(spark, docs, empty):
    """Edited copies at and below the bound, a group whose members are linked only through others, and the awkward texts."""
    from relquill.llm import simhash_copies

    r = random.Random(8)
    texts = dict(enumerate(make_texts()))
    for base in range(12):
        words = [f"b{base}x{r.randrange(500)}" for _ in range(r.randint(8, 200))]
        for _ in range(8):
            copy = words[:]
            for _ in range(r.randint(0, 1 + len(copy) // 30)):
                copy[r.randrange(len(copy))] = f"e{r.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy)
            words = copy if base % 3 == 0 else words
    got = by_id(simhash_copies.near_copies(spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)))
    want = slow_near(texts)
    assert {k: x["component_id"] for k, x in got.items()} == want and 20 < len(set(want.values())) < len(want) - 30
    assert simhash_copies.near_copies(empty).count() == 0


def test_near_copies_keep_rows(spark, empty):
    """Rows that share an id with a copy, rows without an id, repeated rows, and columns with clashing names."""
    from relquill.llm import simhash_copies

    words = [f"w{k}" for k in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"o{k}" for k in range(60))
    rows = [(5, text), (7, near), (7, other), (None, text.upper()), (None, "alone " + other), (8, None), (9, ""), (9, ""), (10, "a b"), (10, "a b"), (11, "a  b")]
    docs = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id long, text string, key int, `row` int, _key int")
    left = simhash_copies.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(5, text), (7, other), (8, None), (10, "a b")], key=repr)
    assert simhash_copies.drop_near_copies(empty).count() == 0


def test_near_copies_tiles(spark, monkeypatch):
    """Many small tiles find what one tile finds."""
    from relquill.llm import simhash_copies

    monkeypatch.setattr(simhash_copies, "TILE", 5)
    monkeypatch.setattr(simhash_copies, "TILE_BYTES", 2_000)
    r = random.Random(11)
    texts = {}
    for base in range(10):
        words = [f"b{base}x{r.randrange(99)}" for _ in range(r.randint(30, 60))]
        for _ in range(6):
            texts[len(texts)] = " ".join(w if r.random() > 0.01 else "e" for w in words)
    got = by_id(simhash_copies.near_copies(spark.createDataFrame([*texts.items()], "doc_id long, text string")))
    assert {k: x["component_id"] for k, x in got.items()} == slow_near(texts)


def test_pipeline_drops_near_copies(spark):
    """The stage against the five-word Jaccard similarity of all pairs, where copies differ in more than two bits of SimHash."""
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*p.COLUMNS)
    single = p.keep_one_copy(spark, docs, "").cache()
    want = slow_near({r["doc_id"]: r["text"] for r in single.collect()})
    left = [r["doc_id"] for r in p.keep_one_near_copy(spark, single, "").select("doc_id").collect()]
    assert sorted(left) == sorted(set(want.values())) and len(left) == len(want) - 5


def test_language_of_letterless_text(spark):
    """A sign beyond ASCII far behind digits is no letter."""
    r = random.Random(1)
    rows = [(k, " ".join(r.choices(["the", "thing", "when"] if k % 2 else ["que", "eau", "leur", "être"], k=40)), ["fr", "en"][k % 2], "s", 1) for k in range(40)]
    docs = spark.createDataFrame([*rows, (100, "12 34 " * 50 + "€", None, None, None), (101, "12 34 " * 50 + "ê the thing", None, None, None)], SCHEMA)
    found = by_id(language_mixture.identify(docs, *language_mixture.fit(docs, "text", "lang", "doc_id", ~held_out())))
    assert (found[100]["lang_pred"], found[100]["score"], found[100]["proportions"]) == ("und", 0.0, {})
    assert found[101]["lang_pred"] != "und"


def awkward_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, shared ids, odd characters."""
    r = random.Random(21)
    words = ["the", "of", "and", "red", "fox", "\u00fcber", "jumps"] + [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(r.choices(words, k=r.randint(5, 120))), "en", f"s{k % 3}", 1) for k in range(60)]
    rows += [(100, None, None, None, None), (None, "no id here", None, None, None), (None, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t", "en", "s0", 3)]
    rows += [(103, "long word " * 30_000, "en", "s1", 1), (104, "x" * 200_000, "en", "s1", 1), rows[0], rows[0], (0, "same id, other text", "en", "s2", 1), (105, rows[1][1], "en", "s1", 1)]
    rows += [(106, rows[2][1] + " tail", "en", "s1", 1), (107, "\x00 \u0085 \u2028 \U0001f600", None, "s1", 1)]
    return rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_awkward_and_empty_tables(spark, tmp_path, name):
    rows = awkward_rows()
    for kind, some in (("awkward", rows), ("empty", [])):
        folder = tmp_path / kind
        docs = spark.createDataFrame(some, SCHEMA)
        docs.selectExpr("*", "lang as digest", "source as key", "text as body", "lang as row").write.parquet(f"{folder}/documents.parquet")
        labels = [(r[0], k % 2, int(k % 5 == 0)) for k, r in enumerate(some)] + [(None, None, None), (1, None, 1), (2, 1, None)][: len(some)]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        pages = [(r[0], None if k % 4 == 0 else f"http://h/{k}", r[1]) for k, r in enumerate(some)]
        spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
        vectors = [(r[0], None if k % 9 == 0 else [float(k % 7), 0.5] * 32, k) for k, r in enumerate(some)]
        spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
        spark.createDataFrame([(r[0], k % 3 or None, r[2], r[1]) for k, r in enumerate(some)], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
        got = queries.QUERIES[name](spark, str(folder)).collect()
        if name == "op13_prefix_trie":
            top = [r for r in got if r["depth"] == 0]
            assert [r["n_convs"] for r in top] == [len({r[0] for r in some} - {None})][: len(some)]
        elif name == "op11_yinyang":
            assert Counter(r["vec_id"] for r in got) == Counter(v[0] for v in vectors if v[1] is not None)
        elif name == "op5_poisson_mixing":
            key = lambda r: tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars"))
            assert {key(r) for r in got} <= {tuple(r) for r in some} and (len(got) > len(some) // 3 or not some)
            times = Counter(map(key, got))
            assert all(times[r] % n == 0 for r, n in Counter(map(tuple, some)).items() if r[0] is None or n > 1)
        else:
            assert Counter(r["page_id" if name == "op4_warc" else "doc_id"] for r in got) == Counter(r[0] for r in some)


def test_pipeline_runs_end_to_end(spark, tmp_path):
    """``run`` against brute force: the stages one after another over awkward rows, and over an empty table."""
    import sentencepiece

    import corpus_pipeline as p

    rows = awkward_rows()
    for kind, some in (("awkward", rows), ("empty", [])):
        spark.createDataFrame(some, SCHEMA).write.parquet(f"{tmp_path}/{kind}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{kind}/labels.parquet")
    assert p.run(spark, f"{tmp_path}/empty").count() == 0
    out = p.run(spark, f"{tmp_path}/awkward").collect()
    groups = {}
    for k, t, *_, in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), k is None, k or 0, t))
    kept = [min(g, key=lambda x: x[:3]) for g in groups.values()]
    label = slow_near({i: x[3] for i, x in enumerate(kept)})
    near = {}
    for i, x in enumerate(kept):
        near.setdefault(label[i], []).append((x[1], x[2], x[3]))
    stay = {min(g, key=lambda x: x[:2])[2] for g in near.values()}
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    want = {hashlib.sha256(np.array(lib.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest() for t in stay}
    found = {r["ids_sha256"] for r in out}
    assert found <= want and len(out) > len(stay) // 3  # a Poisson draw may be zero
    everything = p.STAGES[4][1](spark, p.STAGES[2][1](spark, p.STAGES[1][1](spark, spark.createDataFrame(rows, SCHEMA), ""), ""), "")
    assert {r["ids_sha256"] for r in everything.collect()} == want


def test_backoff_of_repeated_rows_and_shared_ids(spark):
    """Rows count as texts of their own, whatever their ids."""
    texts = [(1, "a b c a b"), (1, "a b c a b"), (1, "c a"), (None, "b c d"), (2, "a b c a b"), (2, None)]
    got = Counter((r["doc_id"], r["n_words"], r["n_backed_off"], None if r["log_score"] is None else round(r["log_score"], 9)) for r in backoff_lm.backoff_scores(spark.createDataFrame(texts, "doc_id long, text string"), block_bytes=12).collect())
    split = [(t or "").split() for _, t in texts]
    want = Counter()
    for j, words in enumerate(split):
        one, two = Counter(), Counter()
        for k, other in enumerate(split):
            if k != j:
                one.update(other)
                two.update(zip(other, other[1:]))
        rest, logs, backed = sum(map(len, split)) - len(words), [], 0
        for i, w in enumerate(words):
            if i and two[words[i - 1], w]:
                logs.append(np.log10(two[words[i - 1], w] / one[words[i - 1]]))
            else:
                backed += i > 0
                logs.append((np.log10(0.4) if i else 0) + np.log10(max(one[w], 1) / rest))
        want[texts[j][0], len(words), backed, round(float(np.mean(logs)), 9) if logs else None] += 1
    assert got == want


def test_backoff_sums_beyond_32_bits():
    """Counts of many blocks add up past 2^32, and past what a double holds."""
    most = np.uint32(2**32 - 1)
    keys = [np.array([3, 7, 9], np.uint64), np.array([7], np.uint64), np.array([7, 9], np.uint64)]
    counts = [np.array([1, most, 5], np.uint32), np.array([most], np.uint32), np.array([most, 6], np.uint32)]
    assert [x.tolist() for x in backoff_lm.summed(keys, counts)] == [[1, 3 * (2**32 - 1), 11], [3 * (2**32 - 1)], [3 * (2**32 - 1), 11]]
    big = backoff_lm.summed([np.array([1], np.uint64)] * 2, [np.array([2**53], np.int64), np.array([1], np.int64)])
    assert [int(x[0]) for x in big] == [2**53 + 1] * 2
    assert backoff_lm.unplanes(backoff_lm.planes(big[0]), np.int64)[0] == 2**53 + 1


def test_warc_bundles_follow_the_public_formats(spark, tmp_path, monkeypatch):
    """The frames by a plain decompressor, the seek table by its definition, the records by their headers."""
    import struct
    from pathlib import Path

    import zstandard

    monkeypatch.setattr(warc, "FRAME_BYTES", 2_000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 3_000)
    r = random.Random(3)
    pages = spark.createDataFrame([(k, f"http://x/{k}", "".join(r.choices("abcdefgh \n", k=r.randint(0, 3_000)))) for k in range(40)], "page_id long, url string, html string")
    index = warc.write_archives(pages, f"file://{tmp_path}/w").collect()
    bundles = {x["bundle"] for x in index}
    assert len(bundles) > 3 and len(index) == 40
    for uri in bundles:
        raw = Path(uri.removeprefix("file://")).read_bytes()
        n, flags, magic = struct.unpack("<IBI", raw[-9:])
        assert magic == 0x8F92EAB1 and flags == 0 and struct.unpack("<II", raw[-17 - 8 * n : -9 - 8 * n]) == (0x184D2A5E, 8 * n + 9)
        sizes = [struct.unpack_from("<II", raw, len(raw) - 9 - 8 * n + 8 * k) for k in range(n)]
        frames, at = [], 0
        for packed, plain in sizes:
            frames.append(zstandard.ZstdDecompressor().decompress(raw[at : at + packed], max_output_size=plain))
            assert len(frames[-1]) == plain
            at += packed
        assert at == len(raw) - 17 - 8 * n
        with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as f:
            assert f.read() == b"".join(frames)
        for x in (x for x in index if x["bundle"] == uri):
            record = frames[x["frame"]][x["offset"] : x["offset"] + x["length"]]
            head, _, rest = record.partition(b"\r\n\r\n")
            assert record.startswith(b"WARC/1.1\r\n") and f"<urn:page:{x['page_id']}>".encode() in head
            assert len(rest) == int(re.search(rb"Content-Length: (\d+)", head)[1]) + 4 and record.endswith(b"\r\n\r\n")
