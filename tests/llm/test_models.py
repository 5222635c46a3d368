"""Mixing, language model, language and toxicity: exact parts against brute force, the rest by held-out quality."""

import collections
import copy
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from weft.llm import langid, langmodel, mixing, registry, toxicity

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def test_base_scores(spark, odd_docs):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{odd_docs}/documents.parquet").collect()]
    bags = [(d, [*WORD.findall(t.translate(LOWER)), None]) for d, t in docs]
    counts = collections.Counter(w for d, own in bags if crc(d) % 10 for w in own)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d if d is not None else -1), crc(d) % 10 == 0, len(own), sum(counts[w] > 0 for w in own), n,
                   round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 3)) for d, own in bags)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3))
                 for r in registry.queries()["op4_lm_score"](spark, odd_docs).collect())
    assert [w[:5] for w in want] == [g[:5] for g in got]
    assert np.allclose([w[5] for w in want], [g[5] for g in got], atol=0.01)


def test_rare_words_are_looked_up(spark, odd_docs, monkeypatch):
    docs = spark.read.parquet(f"{odd_docs}/documents.parquet")
    whole = sorted((r["doc_id"] or -1, r["n_known"], round(r["base_score"], 3)) for r in langmodel.score(docs).collect())
    monkeypatch.setattr(langmodel, "COMMON", 50)
    assert sorted((r["doc_id"] or -1, r["n_known"], round(r["base_score"], 3)) for r in langmodel.score(docs).collect()) == whole


def test_score_beats_the_base(spark):
    rows = langmodel.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    gain = (rows["sum(score)"] - rows["sum(base_score)"]) / rows["sum(n_tokens)"]
    print("log10 a held-out token over single words", gain)
    assert gain > 0.22


def small_model(rng):
    vocabulary = [f"w{k}" for k in range(40)] + ["the", "of"]
    h, leaf, _ = langmodel.tokens(pa.array([" ".join(vocabulary)]))
    singles = [int(x) for x in h[40:42].view(np.int64)]
    classes = langmodel.Classes(singles)
    cls = classes.of(h, leaf)
    words, kinds = np.zeros((langmodel.CLASSES, langmodel.GROUPS)), np.zeros((langmodel.CLASSES, langmodel.GROUPS))
    counts = {}
    for k, x in enumerate(h):
        n = int(rng.integers(1, 50))
        at = (cls[k], leaf[k] % langmodel.GROUPS if cls[k] > langmodel.SINGLES else 0)
        words[at] += n
        kinds[at] += 1
        counts[int(x)] = n
    model = langmodel.Model(classes, int(words.sum()), words, kinds)
    model.whole[:] = rng.normal(size=len(model.whole)).astype(np.float32)
    return model, vocabulary, counts


def plain_probability(model, counts, context, token, leaf, cls):
    """P(token | the three tokens before it) by plain loops; the add-0.1 share of an unseen word where counts has none."""
    exp = lambda zs: [math.exp(z) for z in zs]
    back = [np.array([x], np.uint64) for x in context]
    rows = langmodel.features(back, model.buckets)[:, 0]
    z = exp([float(model.bias[c]) + sum(float(model.weights[k][rows[k]][c]) for k in range(langmodel.FEATURES)) for c in range(langmodel.CLASSES)])
    p, group = z[cls] / sum(z), 0
    if cls > langmodel.SINGLES:
        rows, group = langmodel.group_features(back, np.array([cls]), model.buckets)[:, 0], leaf % langmodel.GROUPS
        z = exp([float(model.group_bias[cls - 1 - langmodel.SINGLES][g]) + sum(float(model.group_weights[k][rows[k]][g]) for k in range(langmodel.GROUP_FEATURES))
                 for g in range(langmodel.GROUPS)])
        p *= z[group] / sum(z)
    return p * (counts.get(int(token), 0) + langmodel.ADD) / model.mass[cls][group]


def test_model_sums_to_one():
    """All words, the end and one unseen word in each group, after several histories, by brute force."""
    rng = np.random.default_rng(0)
    model, vocabulary, counts = small_model(rng)
    h, leaf, _ = langmodel.tokens(pa.array([" ".join(vocabulary)]))
    cls = model.classes.of(h, leaf)
    for _ in range(3):
        context = [h[k] for k in rng.integers(0, len(h), 3)]
        total = sum(plain_probability(model, counts, context, t, int(g), int(c)) for t, g, c in zip(h, leaf, cls, strict=True))
        for c in range(langmodel.CLASSES):  # the unseen words
            for g in range(langmodel.GROUPS if c > langmodel.SINGLES else 1):
                total += plain_probability(model, {}, context, 0, g, c)
        assert abs(total - 1) < 1e-3  # the list ends with an end


def test_scores_by_brute_force(spark):
    """The query's score column, text by text and token by token, with the trained weights."""
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + j * j) % 23}" for j in range(12))) for k in range(40)] + [(50, ""), (51, "never seen"), (52, None)], "doc_id long, text string")
    model, table = langmodel.train(docs)
    counts = {int(np.int64(r["h"]).view(np.uint64)): r["n"] for r in table.collect()}
    assert len(model.history) == langmodel.BATCHES
    got = {r["doc_id"]: r["score"] for r in langmodel.score(docs).collect()}
    for r in docs.collect():
        h, leaf, _ = langmodel.tokens(pa.array([r["text"] or ""]))
        cls, want = model.classes.of(h, leaf), 0.0
        for k in range(len(h)):
            context = [h[k - j] if k >= j else langmodel.END for j in (1, 2, 3)]
            want += math.log10(plain_probability(model, counts, context, h[k], int(leaf[k]), int(cls[k])))
        assert abs(got[r["doc_id"]] - want) < 1e-3


def test_rows_have_no_upper_bound():
    for total in (10**9, 10**10, 10**12):
        assert langmodel.buckets_for(total) * langmodel.TOKENS_PER_ROW >= total
        assert langmodel.buckets_for(total) == langmodel.shards_for(total) * langmodel.SHARD_ROWS


SHARDED = [(k, " ".join(f"w{(k * 7 + j * j) % 23}" for j in range(12))) for k in range(40)] + [(50, ""), (51, "never seen"), (52, None), (None, "w1 w2"), (3, "twice"), (3, "twice"), (53, None)]


def test_saved_tokens_train_as_texts_do(spark):
    """One shard of saved tokens gives the weights that the texts give."""
    docs = spark.createDataFrame(SHARDED, "doc_id long, text string")
    whole = langmodel.train(docs)[0]
    for _, model in langmodel.shard_models(docs, langmodel.untrained(docs)[0], 1):
        assert np.abs(whole.whole).max() > 0.1 and np.allclose(model.whole, whole.whole, atol=1e-3)
        assert np.allclose(model.history, whole.history, atol=1e-3)


def test_sharded_scores_by_brute_force(spark, monkeypatch):
    """More rows than a worker holds: every token is scored by the rows of its shard, every row of the table is returned."""
    docs = spark.createDataFrame(SHARDED, "doc_id long, text string")
    for name, value in (("LEAST_BUCKETS", 64), ("SHARD_ROWS", 64), ("TOKENS_PER_ROW", 2)):
        monkeypatch.setattr(langmodel, name, value)
    model, table = langmodel.untrained(docs)
    shards = langmodel.shards_for(model.total)
    assert shards == 4 and model.buckets == 64
    counts = {int(np.int64(r["h"]).view(np.uint64)): r["n"] for r in table.collect()}
    models = [copy.deepcopy(own) for _, own in langmodel.shard_models(docs, model, shards)]
    training = docs.where(langmodel.crc_mod(10) != 0).select("text", langmodel._batch().alias("batch"))
    for shard, own in enumerate(models):  # trained on all tokens of the shard and no others
        def read(classes, batches, shard=shard):
            for back, cls, group in langmodel._of_texts(classes, batches):
                here = np.flatnonzero(langmodel.shard_of(back[0], shards) == shard)
                yield [x[here] for x in back], cls[here], group[here]

        model.clear()
        langmodel._fit(model, training, read)
        assert np.abs(own.whole).max() > 0.1 and np.allclose(own.whole, model.whole, atol=1e-3)
    want = []
    for doc_id, text in SHARDED:
        h, leaf, _ = langmodel.tokens(pa.array([text or ""]))
        cls, total = model.classes.of(h, leaf), 0.0
        for k in range(len(h)):
            context = [h[k - j] if k >= j else langmodel.END for j in (1, 2, 3)]
            own = models[int(langmodel.shard_of(np.array(context[:1], np.uint64), shards)[0])]
            total += math.log10(plain_probability(own, counts, context, h[k], int(leaf[k]), int(cls[k])))
        want.append((-1 if doc_id is None else doc_id, len(h), total))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["score"]) for r in langmodel.score(docs).collect())
    want.sort()
    assert [w[:2] for w in want] == [g[:2] for g in got]
    assert np.allclose([w[2] for w in want], [g[2] for g in got], atol=1e-3)


def test_sums_of_repeated_rows():
    rng = np.random.default_rng(1)
    ids, rows = rng.integers(0, 9, 500).astype(np.uint16), rng.random((500, langmodel.CLASSES)).astype(np.float32)
    got = np.zeros((9, langmodel.CLASSES), np.float32)
    langmodel.add_rows(got, ids, rows, np.empty_like(rows))
    want = np.zeros_like(got)
    np.add.at(want, ids, rows)
    assert np.allclose(got, want, rtol=1e-4)


def test_targets():
    assert mixing.targets([800, 100, 100], [5, 2, 1]) == [625.0, 250.0, 125.0]
    got = mixing.targets([10_000, 10, 10], [5, 2, 1])
    assert got == [10_020 - 60, 30.0, 30.0]
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_split_tree_deals_exact_quotas():
    quotas, capacity = np.array([17, 5, 40]), np.array([20, 21, 21])
    dealt = mixing.split_tree(quotas, capacity, 3)
    assert (dealt.sum(axis=0) == quotas).all() and (dealt.sum(axis=1) == capacity).all() and (dealt >= 0).all()
    assert (dealt == mixing.split_tree(quotas, capacity, 3)).all()


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_rows(docs).collect()
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    by = collections.defaultdict(int)
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"]
        by[r["source"]] += r["taken"]
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    totals = [next(r["source_size"] for r in rows if r["source"] == s) for s in names]
    targets = mixing.targets(totals, [(5, 2, 1)[k % 3] for k in range(len(names))])
    most = max(size.values())
    for s, t in zip(names, targets, strict=True):
        assert next(r["target"] for r in rows if r["source"] == s) == t
        assert abs(by[s] - t) <= most
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix_rows(docs.repartition(7)).collect()), key=repr)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'").collect()
    assert len(got) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_network_learns_and_freezes_to_the_same_function():
    rng = np.random.default_rng(2)
    x = rng.integers(97, 110, (400, langid.WINDOW)).astype(np.uint8)
    y = rng.integers(0, 2, 400)
    x[y == 1, 5:8] = np.frombuffer(b"zzz", np.uint8)
    net = langid.ByteCnn(["a", "b"]).train(x, y)
    frozen = net.predict(x)
    net.tables = None
    assert np.allclose(frozen, net.predict(x.astype(np.int64)), atol=1e-4) and (frozen.argmax(axis=1) == y).mean() > 0.95


def test_toxicity_held_out(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (1 - y).sum()
    print("AUC", auc, "predicted", [(int(((s >= 0.7) & (y == k)).sum()), int((y == k).sum())) for k in (0, 1)])
    assert auc > 0.96


def test_neighbours_are_exact(spark, monkeypatch):
    """Every document of the small table against every example, by dense cosines of all terms; posting lists alone, and with the matrix."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    bag = {d: dict(zip(*[x.tolist() for x in toxicity.bags(*toxicity.terms(pa.array([t])))[:2]], strict=True)) for d, t in texts.items()}
    df = collections.Counter(t for b in bag.values() for t in b)
    monkeypatch.setattr(toxicity, "K", 10)
    for dense in (0, 2048):
        monkeypatch.setattr(toxicity, "DENSE", dense)
        model = toxicity.fit(docs, labels)
        known = set(model.vocabulary.tolist())

        def unit(d):
            w = {t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in bag[d].items() if t in known}  # noqa: B023
            size = math.sqrt(sum(x * x for x in w.values())) or 1.0
            return {t: x / size for t, x in w.items()}

        vectors = {d: unit(d) for d in texts}
        without = 0
        for d in list(texts)[:80]:
            t, n, _ = toxicity.bags(*toxicity.terms(pa.array([texts[d]])))
            at, q = model.vector(t, n)
            if not len(at):
                without += 1
                continue
            own = vectors[d]
            want = sorted((sum(x * vectors[e].get(t, 0.0) for t, x in own.items()) for e in model.ids), reverse=True)
            top, score, _ = model.nearest(at, q, *[p[0] for p in model.parts([(at, q)])])
            assert np.allclose(score, [w for w in want if w > 1e-9][:10], atol=1e-5)
            assert np.allclose(score, [sum(x * vectors[model.ids[k]].get(t, 0.0) for t, x in own.items()) for k in top], atol=1e-5)
        assert without <= 4


def test_language_sample_with_one_doc_id(spark):
    """All doc_ids null, one doc_id for many repeated rows, and a very long text: nothing fails, every language has its examples."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text", "lang")
    nulls = docs.selectExpr("cast(null as long) AS doc_id", "text", "lang")
    assert langid.fit(nulls) is not None
    got = langid.language_id(nulls).where("lang_pred != 'und'").count()
    assert got >= docs.where("text rlike '[a-z]'").count() * 0.9
    hot = spark.range(100_000).selectExpr("6L AS doc_id", "'the same text over and over' AS text", "'en' AS lang")
    long = spark.createDataFrame([(3, "eine sehr lange Zeile " * 200_000, "de")], "doc_id long, text string, lang string")
    sample = langid.training_sample(hot.union(long).union(nulls.where("lang = 'en'"))).collect()
    by = collections.Counter(r["lang"] for r in sample)
    different = nulls.where("lang = 'en' and text is not null").select("text").distinct().count()
    assert by["de"] == 1 and by["en"] == min(langid.DOCS_PER_CLASS, different + 1)
    assert all(len(r["windows"]) <= langid.WINDOWS_PER_DOC * langid.WINDOW for r in sample)


def test_language_scores_by_brute_force(spark):
    """Averaged windows of the network, by plain loops over bytes, filters and places."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = langid.fit(docs)
    p = {k: v.astype(float) for k, v in net.p.items()}
    got = {r["doc_id"]: r for r in langid.language_id(docs).where("lang_pred != 'und'").collect()}
    for r in docs.where("length(text) between 10 and 700").orderBy("doc_id").limit(12).collect():
        data = r["text"].encode()
        starts = [min(k * langid.WINDOW, max(0, len(data) - langid.WINDOW)) for k in range(max(1, -(-len(data) // langid.WINDOW)))]
        total = np.zeros(len(net.labels))
        for at in starts:
            x = list(data[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0"))
            hidden = []
            for w in langid.WIDTHS:
                out = [sum(p["e"][x[i + j]] @ p[f"k{w}"][j] for j in range(w)) for i in range(langid.WINDOW - w + 1)]
                hidden += list(np.maximum(np.max(out, axis=0) + p[f"b{w}"], 0))
            z = np.exp(np.array(hidden) @ p["v"] + p["c"])
            total += z / z.sum() / len(starts)
        if r["doc_id"] in got:
            assert got[r["doc_id"]]["lang_pred"] == net.labels[total.argmax()] and abs(got[r["doc_id"]]["score"] - total.max()) < 1e-3
