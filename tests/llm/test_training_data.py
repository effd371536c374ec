"""Each operator against brute force, and on odd tables: nulls, empty and long texts, repeated rows, clashing columns."""

import collections
import hashlib
import pathlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from sqltwin import check

from tagwise.llm import bpe, chat, decontaminate, langid, neardup, pseudo_likelihood, quality, queries, substring, token_counts, warc
from tagwise.llm.common import drop_table, materialize

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.read_ranks(open(PATH, "rb").read())
LONG = "longword" * 3000 + " and more words " * 500
PASSAGE = " ".join(f"w{i}" for i in range(60))
#: id, text and columns whose names the operators use inside
ROWS = [
    (1, None, "a", 1), (2, "", None, 2), (3, " \t\n", "c", None), (4, LONG, "d", 4), (5, "one two", "e", 5), (5, "one two", "e", 5),
    (None, "no id here é日本 \x1c x", "f", 6), (7, PASSAGE + " tail seven", "g", 7), (8, "head eight " + PASSAGE, "h", 8), (9, PASSAGE + " tail seven", "i", 9),
    (10, "Orre " * 300, "j", 10), (10, "other text under the same id", "k", 11),
]
SCHEMA = "doc_id long, text string, key string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def words(text):
    return (text or "").encode().split()


def bag(rows):
    return collections.Counter(map(repr, rows))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    check(spark, name, SF, queries.queries(), queries.ORACLES)


def test_bpe_equals_tiktoken_and_round_trips(docs):
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
    out = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert bag((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in out) == bag((i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in ROWS)
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0 and bpe.decode(bpe.encode(docs.limit(0), PATH, PATTERN), PATH, PATTERN).count() == 0
    clash = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit("y")), PATH, PATTERN), PATH, PATTERN)
    assert clash.columns == ["doc_id", "text", "key", "n", "ids", "decoded"] and bag((r["doc_id"], r["ids"]) for r in clash.collect()) == bag((r["doc_id"], r["ids"]) for r in out)


def test_recursive_query_equals_the_heap():
    codec = bpe.Codec(open(PATH, "rb").read(), PATTERN)
    rng = random.Random(1)
    some = ["".join(rng.choice("aeinrst ") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    some += ["".join(rng.choice("aeinrst") for _ in range(n)) for n in (60, 60, 130, bpe.LONG_WORD)]
    calls, merge = [], bpe.heap_merge
    bpe.heap_merge = lambda w, r: calls.append(len(w)) or merge(w, r)
    try:
        codec.learn(some)
    finally:
        bpe.heap_merge = merge
    assert not calls  # all of them take the recursive query
    for w in some:
        if w.encode() not in RANKS:
            assert np.frombuffer(codec.known[w], np.int32).tolist() == bpe.heap_merge(w.encode(), RANKS)


def test_token_counts_equal_plain_dynamic_programming(docs):
    counter = token_counts.TrieCounter(open(PATH, "rb").read(), PATTERN)

    def count(word):
        raw, best = word.encode(), [(0.0, 0)]
        for i in range(1, len(raw) + 1):
            options = [(best[s][0] + counter.score[raw[s:i]], best[s][1] + 1) for s in range(i) if raw[s:i] in counter.score]
            top = max(x[0] for x in options)
            best.append(min(((x, n) for x, n in options if x > top - 1e-9), key=lambda x: x[1]))
        return best[-1][1]

    def count_long(raw):
        """For a long word: ends reached with their best score and fewest tokens, tokens tried by length."""
        best = [(0.0, 0)] + [None] * len(raw)
        for i in range(1, len(raw) + 1):
            options = [(best[s][0] + counter.score[raw[s:i]], best[s][1] + 1) for s in range(max(0, i - counter.longest), i) if raw[s:i] in counter.score]
            top = max(x for x, _ in options)
            best[i] = min(((x, n) for x, n in options if x > top - 1e-9), key=lambda x: x[1])
        return best[-1][1]

    given = docs.withColumn("n_tokens", F.lit("clash"))
    out = token_counts.count_tokens(given, PATH, PATTERN).collect()
    of = lambda w: count(w) if len(w) < 100 else count_long(w.encode())
    assert bag((r["doc_id"], r["n_tokens"]) for r in out) == bag((i, sum(map(of, counter.split(t or "")))) for i, t, *_ in ROWS)
    assert token_counts.count_tokens(docs.limit(0), PATH, PATTERN).count() == 0


def test_quality_features_and_verdicts(spark, docs):
    def features(text):
        w = [x.decode() for x in words(text)]
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + k for i in range(len(w) - 2) for k in range(3) if seen[tuple(w[i : i + 3])] > 1}
        lines = [x for x in (text or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(map((text or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(cover)

    out = quality.judge(docs).collect()
    got = bag((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in out)
    assert got == bag((i, features(t)) for i, t, *_ in ROWS)
    assert quality.judge(docs.limit(0)).count() == 0
    good = quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("NOT base_failed")
    share = {r["quality"]: r["s"] for r in good.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.96 and share[0] < 0.1


def test_quality_posterior_equals_plain_em(spark):
    """The same iterations over the texts themselves, in numpy, one row for each text."""
    rows = quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    index = {1: 0, 0: 1, -1: 2}
    votes = np.array([[index[v] for v in r] for r in rows[[f"vote_{x[0]}" for x in quality.RULES]].to_numpy()])
    rules = votes.shape[1]
    share = np.array([quality.PRIOR_GOOD] + [(1 - quality.PRIOR_GOOD) / rules] * rules)
    table = np.array([[quality.OWN if k == r + 1 else quality.OTHER for r in range(rules)] for k in range(rules + 1)])
    seen = np.eye(3)[votes]
    for _ in range(quality.ITERATIONS + 1):
        p = share * np.prod(table[:, np.arange(rules), :][:, np.arange(rules)[None], votes], axis=2).T
        p /= p.sum(1, keepdims=True)
        good = p[:, 0]
        share = p.sum(0) + quality.SMOOTHING
        share /= share.sum()
        table = np.einsum("dk,drv->krv", p, seen) + quality.SMOOTHING / 10
        table /= table.sum(2, keepdims=True)
    assert np.abs(good - rows["p_good"]).max() < 1e-5
    failed = (rows["n_words"] < 50) | (100 * rows["n_repeat_words"] > 50 * rows["n_words"])
    assert (rows["kept"] == ~failed & (rows["p_good"] >= 0.5)).all()


@pytest.mark.parametrize("name", ["t", "w", "s", "p", "lines", "h", "i"])
def test_quality_with_any_id_name(docs, name):
    out = quality.judge(docs.select(F.col("doc_id").alias(name), "text"), id_col=name)
    assert out.columns[0] == name and bag(r[name] for r in out.collect()) == bag(i for i, *_ in ROWS)


def test_near_duplicate_classes_equal_brute_force(spark, docs):
    rng = random.Random(2)
    base = [f"v{rng.randint(0, 400)}" for _ in range(120)]
    rows = list(ROWS)
    for i in range(60):  # a group of near copies, most of them not near the first one
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
        rows.append((100 + i, " ".join(w), "z", i))
    rows += [(300, " ".join(base + base[:60]), "z", 0), (301, " ".join(base + base[:60] * 2), "z", 0)]  # near as sets, not as multisets
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append(collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else collections.Counter())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total():
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    want = collections.Counter()
    for r in set(root):
        ids = [rows[i][0] for i in range(len(rows)) if root[i] == r]
        least = min((x for x in ids if x is not None), default=None)
        want.update((x, rows[root.index(r)][0] if not sets[r] else least) for x in ids)
    df = spark.createDataFrame(rows, SCHEMA)
    got = neardup.classes(df)
    assert bag((r["doc_id"], r["class_id"]) for r in got.select("doc_id", "class_id").collect()) == bag(want.elements())
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(set(root))
    assert neardup.classes(docs.limit(0)).count() == 0


def test_blocks_of_a_large_group_find_the_same_classes(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(base[:59] + [f"t{rng.randint(0, 30)}"]), "z", i) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(neardup, "BLOCK_WORDS", 300)
    monkeypatch.setattr(neardup, "HUB_WORDS", 200)
    assert {r["class_id"] for r in neardup.classes(df).collect()} == {0}
    # a chain: each text is near its neighbours, hardly any near one hub
    chain = [(i, " ".join(f"c{j}" for j in range(6 * i, 6 * i + 120)), "z", i) for i in range(40)]
    links = [(a, b) for a in range(40) for b in range(a) if 116 - 6 * (a - b) >= 0.8 * (116 + 6 * (a - b))]
    assert {a - b for a, b in links} == {1, 2}
    assert {r["class_id"] for r in neardup.classes(spark.createDataFrame(chain, SCHEMA)).collect()} == {0}
    same = spark.createDataFrame([(None, "a b c d e f", "z", 1)] * 5 + [(1, "a b c d e f", "z", 1)] * 3, SCHEMA)
    assert {r["class_id"] for r in neardup.classes(same).collect()} == {1}


def test_signatures_find_near_pairs(spark):
    """Recall of the bands: every text whose id is divisible by 20 against all, by brute force."""
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in given.collect():
        if w := words(r["text"]):
            sets[r["doc_id"]] = collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    of = {r["id"]: set(r["bands"] or []) for r in neardup.signatures(given, "doc_id", "text", "count").collect()}
    met = [bool(of[a] & of[b]) for a in sets if a % 20 == 0 for b in sets if a != b and (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total()]
    assert len(met) > 5 and sum(met) >= 0.9 * len(met)


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300).astype(float), rng.integers(1, 9, 300).astype(float)
    s = neardup.dart_minhash([e, e, np.zeros(0, np.uint64)], [a, b, np.zeros(0)], 2400)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05
    one = neardup.dart_minhash([e[:200], e[100:]], [np.ones(200), np.ones(200)], 2400)
    assert abs((one[0] == one[1]).mean() - 100 / 300) < 0.05


def test_pseudo_likelihood(spark, docs):
    model = pseudo_likelihood.train(docs)
    out = pseudo_likelihood.score(docs, model).collect()
    assert bag((r["doc_id"], r["n_words"]) for r in out) == bag((i, len(words(t))) for i, t, *_ in ROWS)
    assert all((r["mean_log_likelihood"] is None) == (r["n_words"] == 0) and np.isfinite(r["log_likelihood"]) for r in out)
    assert bag(out) == bag(pseudo_likelihood.score_corpus(docs).collect())
    assert pseudo_likelihood.score_corpus(docs.limit(0)).count() == 0 and pseudo_likelihood.score(docs, pseudo_likelihood.train(docs.limit(0))).count() == len(ROWS)
    order = [f"a{i % 7}" for i in range(20_000)]
    mixed = order[:]
    random.Random(4).shuffle(mixed)
    trained = pseudo_likelihood.train(spark.createDataFrame([(i, " ".join(order)) for i in range(4)], "doc_id long, text string"))
    two = spark.createDataFrame([(1, " ".join(order[:500])), (2, " ".join(mixed[:500]))], "doc_id long, text string")
    s = {r["doc_id"]: r["mean_log_likelihood"] for r in pseudo_likelihood.score(two, trained).collect()}
    assert s[1] > -0.2 > s[2] + 1


def test_pseudo_likelihood_equals_plain_computation(spark):
    """Every log-probability again, word by word: sums of embeddings, both softmax levels, shares by plain counting."""
    P = pseudo_likelihood
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    known, net = P.train(given)
    texts = {r["doc_id"]: words(r["text"]) for r in given.collect()}
    found = collections.Counter(w for t in texts.values() for w in t)
    assert [found[w] for w in known.frequent] == sorted(found.values(), reverse=True)[: P.FREQUENT]
    tokens = {w: i for i, w in enumerate(known.frequent)}
    token = lambda w: P.PAD if w is None else tokens.get(w, P.FREQUENT + P.shape(w))
    total = collections.Counter()
    for w, n in found.items():
        total[token(w)] += n
    assert known.counts.sum() == sum(found.values()) and all(known.counts[k] == n for k, n in total.items())
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    def plain(text):
        padded, out = [None, None, *text, None, None], 0.0
        for i, w in enumerate(text):
            h = np.zeros(P.HIDDEN)
            for k, o in enumerate((-2, -1, 1, 2)):
                c = padded[i + 2 + o]
                h = h + net.inner[token(c), k] + (net.extra[P.slot(c)] if c is not None and c not in tokens else 0)
            h, (c, j) = np.tanh(h), divmod(token(w), P.CLASSES)
            out += np.log(softmax(h @ net.cls + net.cls_bias)[c]) + np.log(softmax(h @ net.own[c] + net.own_bias[c])[j])
            out += 0 if w in tokens else np.log(found[w] / (total[token(w)] + 1))
        return out

    for r in P.score(given, (known, net)).collect():
        if len(texts[r["doc_id"]]) < 300:
            assert r["log_likelihood"] == pytest.approx(plain(texts[r["doc_id"]]), rel=1e-4, abs=1e-2)
    # shares of a bucket's words and of all that the corpus lacks add up
    for b in {token(w) for w in found} - set(tokens.values()):
        assert sum(n / (total[b] + 1) for w, n in found.items() if token(w) == b) + 1 / (total[b] + 1) == pytest.approx(1)
    new = spark.createDataFrame([(1, "Qzxv"), (2, next(w.decode() for w in found if w not in tokens and P.shape(w) == P.shape(b"Qzxv")))], "doc_id long, text string")
    s = {r["doc_id"]: r["log_likelihood"] for r in P.score(new, (known, net)).collect()}
    assert b"Qzxv" not in found and s[1] <= s[2]


def test_pseudo_likelihood_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "CELL_BYTES", 60_000)  # several cells in each round
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = []
    for n in (1, 16, 64):
        out.append({r["doc_id"]: r["mean_log_likelihood"] or 0.0 for r in pseudo_likelihood.score_corpus(given.repartition(n)).collect()})
    for x in out[1:]:
        assert np.corrcoef(list(out[0].values()), [x[i] for i in out[0]])[0, 1] > 0.9999


def test_network_gradient_is_right():
    P = pseudo_likelihood
    net = P.Network.start(np.ones(P.SIZE))
    rng = np.random.default_rng(0)
    token = rng.integers(0, P.SIZE, 60).astype(np.int16)
    slots = np.where(token < P.FREQUENT, -1, rng.integers(0, 20, 60))
    token[30:32], slots[30:32] = P.PAD, -1
    rows = 60 - 2 * P.REACH - 2
    loss = lambda: -net.forward(token, slots)[0].sum() / rows
    dense, inner, extra = net.backward(net.forward(token, slots)[1])
    whole = [np.zeros_like(net.inner), *dense, np.zeros_like(net.extra)]
    for k, (at, g) in ((0, inner), (-1, extra)):
        whole[k][at] = g.reshape(len(at), *whole[k].shape[1:])
    assert set(extra[0]) == set(slots[slots >= 0])
    for a, g in zip(net.arrays(), whole, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = a[at]
        a[at] = old + 1e-2
        up = loss()
        a[at] = old - 1e-2
        assert abs((up - loss()) / 2e-2 - g[at]) < 2e-3
        a[at] = old


def test_cells_hold_whole_texts():
    texts = [b"a b a", None, b"", b"c\xc3\xa9 a\x1c b \n b"]
    x = {c: pseudo_likelihood.unpack(c, v) for c, v in pseudo_likelihood.pack(texts).items()}
    run = [x["words"][i] for i in x["at"]]
    assert run == [w for t in texts for w in (t or b"").split()] and x["sizes"].tolist() == [3, 0, 0, 4]
    assert dict(zip(x["words"], x["n"].tolist(), strict=True)) == collections.Counter(run)


def test_shape_reads_the_whole_word():
    assert len({pseudo_likelihood.shape(w) for w in (b"ab1234cdef", b"ab####cdef", b"abghijcdef")}) == 3
    assert pseudo_likelihood.shape(b"ab1234cdef") == pseudo_likelihood.shape(b"xyz567defg")


def test_decontamination_equals_brute_force(spark):
    def nearest(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(i, say(12)) for i in range(8)] + [(8, None), (9, "  "), (10, "short"), (0, say(12))]
    texts = [None, "", "a short text"]
    for _ in range(40):
        t = list(items[rng.randrange(8)][1])
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(len(t))] = rng.choice("abc ")
        texts.append(say(20) + " " + "".join(t).upper() + "\n" + say(10))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = [(i, decontaminate.normalise(t)) for i, t in items if t and t.strip()]
    want = bag((d, i) for d, t in enumerate(texts) if t for i, p in clean if nearest(p, decontaminate.normalise(t)) <= len(p) // decontaminate.EDIT_EVERY)
    got = decontaminate.matches(docs, bench)
    assert bag((r["doc_id"], r["item_id"]) for r in got.collect()) == want and len(want) > 10
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.count() == len(texts) - got.select("doc_id").distinct().count()
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.matches(docs.limit(0), bench).count() == 0


def test_decontamination_of_odd_tables(spark):
    """Ids of any type or null, short items, columns of any name, a very long text, repeated rows."""
    long = "filler words " * 30_000 + "the answer to the riddle is forty two"
    docs = spark.createDataFrame([(None, long, 1), (7, "a cat", 2), (8, "concatenate", 3), (9, None, 4), (9, "A  CAT\n", 5), (9, "A  CAT\n", 5)], "doc_id int, text string, id int").withColumn("distance", F.lit("x"))
    bench = spark.createDataFrame([(1, "the answer to the riddle is forty-two"), (2, "cat"), (None, "a"), (2, "cat")], "item_id int, text string")
    got = decontaminate.matches(docs, bench)
    assert got.schema["item_id"].dataType.simpleString() == "int"
    assert bag((r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()) == bag([(None, 1, 1)] + [(i, x, 0) for i in (7, 9, 9) for x in (2, 2, None)])
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["id"] for r in kept.collect()) == [3, 4]



def test_substring_dedup_equals_brute_force(docs):
    seen = collections.Counter(tuple(w[j : j + 35]) for w in (words(t) for _, t, *_ in ROWS) for j in range(len(w) - 34))

    def want(text):
        w = words(text)
        gone = {j + k for j in range(len(w) - 34) for k in range(35) if seen[tuple(w[j : j + 35])] > 1}
        return len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()

    out = substring.remove_repeats(docs, normal=True)
    assert out.columns == ["doc_id", "text", "key", "n", "n_words", "n_removed"]
    assert bag((r["doc_id"], (r["n_words"], r["n_removed"], r["text"] or "")) for r in out.collect()) == bag((i, want(t)) for i, t, *_ in ROWS)
    assert substring.remove_repeats(docs.limit(0)).count() == 0
    clash = substring.remove_repeats(docs.withColumn("n_words", F.lit("x")).withColumn("n_removed", F.lit("y")).withColumn("spans", F.lit("z")), normal=True)
    assert bag((r["doc_id"], (r["n_words"], r["n_removed"], r["text"] or ""), r["spans"]) for r in clash.collect()) == bag((i, want(t), "z") for i, t, *_ in ROWS)


@pytest.mark.parametrize("parts", [1, 5])
def test_passages_met_often_in_one_task(spark, parts, monkeypatch):
    """Places that are known at once, and windows of such passages that others share in part."""
    rng = random.Random(11)
    say = lambda n: " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(n))
    passage = say(80)
    rows = [(i, say(rng.randint(0, 40)) + " " + passage + " " + say(rng.randint(0, 40))) for i in range(30)] + [(100, say(50) + " " + " ".join(passage.split()[10:60])), (101, say(60)), (102, passage), (102, passage)]
    seen = collections.Counter(tuple(w[j : j + 35]) for w in (words(t) for _, t in rows) for j in range(len(w) - 34))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = collections.Counter((r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(df).collect())
    monkeypatch.setattr(substring, "HEAVY_WORDS", 100)  # buckets are split
    monkeypatch.setattr(substring, "HEAVY_TIMES", 2)
    assert got == collections.Counter((r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(df).collect())
    assert got == collections.Counter((i, len({j + k for j in range(len(w) - 34) for k in range(35) if seen[tuple(w[j : j + 35])] > 1})) for i, w in ((i, words(t)) for i, t in rows))


def test_substring_counts_in_passes_and_in_spite_of_equal_hashes(monkeypatch):
    texts = [PASSAGE.encode(), (PASSAGE + " x").encode(), b" ".join(f"q{i}".encode() for i in range(50))]
    want = [x.tolist() for x in substring.repeated(texts, np.ones(3, np.int64))]
    monkeypatch.setattr(substring, "PASS_WORDS", 20)
    assert [x.tolist() for x in substring.repeated(texts, np.ones(3, np.int64))] == want
    monkeypatch.setattr(substring, "PASS_WORDS", 1000)
    monkeypatch.setattr(substring, "_mixed", lambda x: x * np.uint64(0))
    assert [x.tolist() for x in substring.repeated(texts, np.ones(3, np.int64))] == want


def test_chat_round_trip_and_turn_order(spark):
    rng = random.Random(7)
    parts = ["\\", "### ", "</turn>", " </turn>\n", ":", " ", "\n", "a", "é", "### User: "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "x: y"]), "".join(rng.choices(parts, k=rng.randint(0, 9))) or None) for c in range(30) for t in range(5)]
    rows += [(100, 0, "user", "q"), (100, 1, "assistant", "a"), (101, 0, "assistant", "a"), (None, 0, "user", None), (102, 0, "user", "b"), (102, 0, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit("clash"))
    formatted = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        by[c].append((r or "", x or ""))
    for c, turns in by.items():
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256("".join(x for r, x in turns if r == "assistant").encode()).hexdigest()
    assert got[100]["valid"] and not got[101]["valid"] and not got[102]["valid"] and got[None]["valid"]
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0
    straight = chat.read_back(formatted, in_order=True).collect()
    assert bag(straight) == bag(got.values()) == bag(chat.read_back(formatted.orderBy(F.rand(3))).collect())


def test_language_id(spark, docs):
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(corpus, where=~langid.held_out())
    out = langid.identify(corpus, model).where(langid.held_out())
    right = out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert right[0] > 0.98 and right[1] < 0.02
    odd = langid.identify(docs, model).collect()
    for r in odd:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1
    assert langid.identify(docs.limit(0), model).count() == 0
    assert [x[0] for x in model.predict(["½ ² 12 _", "٣", "é½"])][:2] == ["und", "und"] and model.predict(["é½"])[0][0] != "und"
    unlabelled = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(docs, unlabelled).collect()} == {"und"}
    assert [r[0] for r in spark.createDataFrame([(i,) for i in range(40)], "doc_id long").select(langid.held_out()).collect()] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(40)]


class PlainKneserNey:
    """Interpolated Kneser-Ney by its definition, over dictionaries of strings."""

    def __init__(self, texts, alphabet):
        order = langid.ORDER
        self.base = 1 / (2 * alphabet)
        padded = [" " * (order - 1) + t + " " for t in texts]
        grams = [collections.Counter(t[i - n + 1 : i + 1] for t in padded for i in range(order - 1, len(t))) for n in range(1, order + 1)]
        self.levels = []
        for n in range(1, order + 1):
            counts = grams[n - 1]
            if n < order:  # in how many different characters' wake
                wakes = collections.Counter(g[1:] for g in grams[n])
                counts = {g: wakes.get(g, 1) for g in counts}
            ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            total, kinds = collections.Counter(), collections.Counter()
            for g, c in counts.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.levels.append((counts, d, total, kinds))

    def p(self, gram):
        if not gram:
            return self.base
        counts, d, total, kinds = self.levels[len(gram) - 1]
        lower = self.p(gram[1:])
        if gram[:-1] not in total:
            return lower
        seen = max(counts.get(gram, 0) - d, 0) if gram in counts else 0
        return seen / total[gram[:-1]] + d * kinds[gram[:-1]] / total[gram[:-1]] * lower


def test_kneser_ney_equals_its_definition():
    rng = random.Random(12)
    train = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(20, 60))) for _ in range(12)] for x, letters in (("x", "abc de"), ("y", "cdefg "), ("z", "éñ ab"))}
    train = {x: [langid.normalise(t) for t in texts] for x, texts in train.items()}
    model = langid.fit([(x, t, False) for x, texts in train.items() for t in texts])
    alphabet = len({c for texts in train.values() for t in texts for c in t})
    probe = [langid.normalise("".join(rng.choice("abcdefgéñ q") for _ in range(30))) for _ in range(40)]
    got = model.cross_entropies(probe)
    for j, x in enumerate(model.languages):
        plain = PlainKneserNey(train[x], alphabet)
        for t, h in zip(probe, got[:, j], strict=True):
            padded = " " * (langid.ORDER - 1) + t + " "
            want = -sum(np.log(plain.p(padded[i - langid.ORDER + 1 : i + 1])) for i in range(langid.ORDER - 1, len(padded))) / (len(t) + 1)
            assert h == pytest.approx(want, rel=1e-4)
    # what the letters lack to one is half of what every level hands on, as the lowest gives half of it to unknown ones
    plain = PlainKneserNey(train["x"], alphabet)
    letters = {c for t in train["x"] for c in t}
    others = alphabet - len(letters | {" "})
    for context in ("abc", "ab ", "zzz", "   "):
        rest = 1.0
        for n in range(len(context), -1, -1):
            _, d, total, kinds = plain.levels[n]
            if (c := context[len(context) - n :]) in total:
                rest *= d * kinds[c] / total[c]
        assert sum(plain.p(context + c) for c in letters | {" "}) + others * rest / (2 * alphabet) == pytest.approx(1 - rest / 2)


def test_every_language_is_learned(spark):
    """More languages than any fixed list would hold, each with an alphabet of its own."""
    own = lambda i: "".join(chr(0x4E00 + 30 * i + k) for k in range(30))
    rng = random.Random(13)
    rows = [(1000 * k + i, "".join(rng.choice(own(i)) for _ in range(80)), f"l{i}") for i in range(257) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert len(model.languages) == 257
    assert langid.identify(df, model).where("lang = lang_pred").count() == len(rows)
    with pytest.raises(ValueError, match="languages"):
        langid.train(df, max_languages=256)


def test_rejecting_keeps_columns_of_any_name(spark):
    corpus = spark.read.parquet(f"{SF}/documents.parquet")
    given = corpus.withColumns({"score": F.lit(-5.0), "rejected": F.lit("no"), "lang_pred": F.lit(1), "cross_entropy": F.col("doc_id")})
    kept = langid.drop_rejected(given)
    assert kept.schema == given.schema and kept.where("score <> -5 OR rejected <> 'no' OR lang_pred <> 1 OR cross_entropy <> doc_id").count() == 0
    assert kept.count() == langid.drop_rejected(corpus).count() > 0.9 * corpus.count()
    assert langid.drop_rejected(given.limit(0)).count() == 0


def test_warc_rejects_magic_in_payloads(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "x" * 120
    rows = [(1, "u", big), (2, "u\r\nEvil: 1", big), (3, None, None), (4, "u", fake), (5, "u", fake * 60 + "é"), (6, "u", "short"), (7, "u", "short"), (8, "u", "WARC/1.0\r\n" * 40)]
    rows += [(None, "http://x/WARC/1.0", "nullid"), (9, "u", fake * 60 + "é"), (10, "u", "tail WARC/1.0"), (6, "u", "short"), (1, "u", big)] + [(i, "u", f"y{i}" * 30) for i in range(20, 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).coalesce(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = warc.round_trip(pages).collect()
        assert warc.round_trip(pages.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    want, first = [], {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        p = (h or "").encode()
        d, ref = hashlib.sha256(p).hexdigest(), None
        if len(p) >= 100 and i is not None:
            ref = first.setdefault(d, i)
        ref = None if ref == i else ref
        want.append((f"<urn:page:{'' if i is None else i}>", len(p), d, "revisit" if ref else "response", f"<urn:page:{ref}>" if ref else None))
    assert bag((r["record_id"], r["payload_bytes"], r["payload_digest"], r["warc_type"], r["refers_to"]) for r in got) == bag(want)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    given = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len({r["doc_id"] for r in out}) == len(out) and {r["doc_id"] for r in out} <= set(given)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)
    texts = collections.Counter(r["text"] for r in given.values())
    assert len(out) < len(texts) and len(out) > 0.7 * len(texts)


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(f"own {c}") for c in ("score", "rejected", "n_words", "n_removed", "key", "node", "spans", "__x")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.where(" OR ".join(f"`{c}` <> 'own {c}'" for c in ("score", "rejected", "n_words", "n_removed", "key", "node", "spans", "__x"))).count() == 0
        empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """Stages 2 to 5, each on what the stage before it kept, over a small table with planted copies, passages and leaks."""
    import corpus_pipeline

    given = spark.read.parquet(f"{SF}/documents.parquet")
    rng, rows = random.Random(8), given.where("n_chars BETWEEN 300 AND 3000").orderBy("doc_id").limit(60).collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(12)
    items = [(r["item_id"], decontaminate.normalise(r["text"])) for r in bench.collect()]
    table = [tuple(r) for r in rows]
    for i, r in enumerate(rows[:20]):
        w = r["text"].split(" ")
        w[rng.randrange(len(w))] = "altered"
        t = (" ".join(w), r["text"], r["text"] + "\n" + items[i % 12][1], r["text"] + " " + rows[50]["text"], PASSAGE + f" {i} " + r["text"][::-1])[i % 5]
        table.append((900_000 + i, t, r["lang"], r["source"], len(t)))
    spark.createDataFrame(table, given.schema).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    now, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        now = spark.read.parquet(f"{tmp_path}/out-{name}")
        steps.append({r["doc_id"]: r for r in now.collect()})
    assert len(steps[0]) > 0.8 * len(table)
    # near-duplicates
    sets = {i: collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for i, r in steps[0].items() if (w := words(r["text"]))}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if b < a and root[a] != root[b] and (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total():
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    left = set(root.values()) | (steps[0].keys() - sets.keys())
    assert set(steps[1]) == left and len(left) < len(steps[0])
    # repeated passages
    seen = collections.Counter(tuple(w[j : j + 35]) for w in (words(r["text"]) for r in steps[1].values()) for j in range(len(w) - 34))
    want = {}
    for i, r in steps[1].items():
        w = words(r["text"])
        gone = {j + k for j in range(len(w) - 34) for k in range(35) if seen[tuple(w[j : j + 35])] > 1}
        if not gone or len(gone) < len(w):
            want[i] = [x for k, x in enumerate(w) if k not in gone]
    assert {i: words(r["text"]) for i, r in steps[2].items()} == want
    assert all(steps[2][i]["text"] == steps[1][i]["text"] for i in want if len(want[i]) == len(words(steps[1][i]["text"])))
    # leaks: the least distance of each item to any substring, one row of the table at a time
    def leaks(text):
        t = np.array([ord(c) for c in decontaminate.normalise(text)], np.int64)
        at = np.arange(len(t) + 1)
        for _, p in items:
            row = np.zeros(len(t) + 1, np.int64)
            for i, c in enumerate(p, 1):
                new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (t != ord(c)))])
                row = np.minimum.accumulate(new - at) + at
            if row.min() <= len(p) // decontaminate.EDIT_EVERY:
                return True
        return False

    clean = {i for i, r in steps[2].items() if not leaks(r["text"] or "")}
    assert set(steps[3]) == clean and len(clean) < len(steps[2])
    # token ids
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
    assert {i: r["ids"] for i, r in steps[4].items()} == {i: enc.encode_ordinary(r["text"] or "") for i, r in steps[3].items()}
    assert all(r["round_trip"] for r in steps[4].values())


def test_split_buckets_hold_equal_windows_together():
    rng = random.Random(14)
    texts = [" ".join(rng.choice("abcd") for _ in range(120)).encode() for _ in range(20)]
    texts += texts[:3]
    windows = substring.Windows(texts)
    whole, split = substring.Router(4, {}), substring.Router(4, {0: 3, 2: 5})
    a, b = whole(windows), split(windows)
    assert set(a[windows.within]) <= set(range(4)) and set(b[windows.within]) - set(a) and b.max() < split.total == 12
    by = collections.defaultdict(set)
    for i in np.flatnonzero(windows.within):
        by[tuple(windows.words[i : i + substring.WIDTH])].add(b[i])
    assert all(len(x) == 1 for x in by.values())
    # runs cover every window once
    found = list(windows.super_kmers(b))
    assert sum(len(t.split()) - substring.WIDTH + 1 for _, t, _, _ in found) == windows.within.sum()
    assert all(t == b" ".join(texts[d].split()[p : p + len(t.split())]) for _, t, d, p in found)


def test_bpe_round_trip_in_one_worker(spark):
    docs = spark.createDataFrame([(1, "A b  c\nरु"), (2, None), (3, ""), (3, ""), (None, "x" * 700 + " 12 z"), (4, "word " * 300_000)], "doc_id long, text string")
    want = bpe.decode(bpe.encode(docs, PATH, PATTERN, keep=["doc_id"]), PATH, PATTERN)
    got = bpe.round_trip(docs, PATH, PATTERN, keep=["doc_id"])
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0
    from tagwise.llm import queries

    plan = queries.op1_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_lm_gradient_without_scores(spark):
    net = pseudo_likelihood.Network.start(np.ones(pseudo_likelihood.SIZE))
    rng = np.random.default_rng(3)
    net.extra += rng.normal(0, 0.1, net.extra.shape).astype(np.float32)
    token = np.concatenate([[pseudo_likelihood.PAD] * 2, rng.integers(0, pseudo_likelihood.SIZE, 50), [pseudo_likelihood.PAD] * 2]).astype(np.int16)
    slots = np.where(token >= pseudo_likelihood.FREQUENT, rng.integers(0, 9, len(token)), -1).astype(np.int32)
    slots[token == pseudo_likelihood.PAD] = -1
    logp, state = net.forward(token, slots)
    none, same = net.forward(token, slots, scored=False)
    assert none is None and all(np.array_equal(a, b) for a, b in zip(state, same, strict=True))
    # plainly: the hidden layer of one word
    i, r = 20, pseudo_likelihood.REACH
    h = sum(net.inner[token[i + o], k] + (net.extra[slots[i + o]] if slots[i + o] >= 0 else 0) for k, o in enumerate((*range(-r, 0), *range(1, r + 1))))
    pc = np.exp(np.tanh(h) @ net.cls + net.cls_bias)
    c, w = divmod(int(token[i]), pseudo_likelihood.CLASSES)
    pw = np.exp(np.tanh(h) @ net.own[c] + net.own_bias[c])
    assert abs(logp[i - r] - np.log(pc[c] / pc.sum() * pw[w] / pw.sum())) < 1e-5


def test_written_tables_start_no_process_for_each_file(spark, tmp_path):
    def local(folder):
        return sorted(p.name for p in pathlib.Path(folder.removeprefix("file://")).iterdir())

    rows = spark.range(1000).repartition(6).selectExpr("id", "CAST(id AS string) AS text")
    table = materialize(rows, "plain")
    files = local(table._tagwise_path)
    assert len([f for f in files if f.startswith("part-")]) == 6 and not [f for f in files if f.endswith(".crc")]
    assert bag(table.collect()) == bag(rows.collect())
    rows.write.parquet(f"file://{tmp_path}/own")  # what a caller writes in the same session stays as it was
    assert [f for f in local(f"file://{tmp_path}/own") if f.endswith(".crc")]
    drop_table(table)
    assert not pathlib.Path(table._tagwise_path.removeprefix("file://")).exists()
