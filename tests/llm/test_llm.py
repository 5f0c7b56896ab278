"""The training-data operators against brute force, and on odd tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievelight.llm import bpe, chat, compress, crf, gear, graph, jaccard, kneser, lines, mix, queries, simhash
from sievelight.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "Lorem ipsum dolor sit amet consectetur. " * 3000
ODD = [
    (1, "one two three four five six seven eight", "en", "a", 5), (2, None, None, None, None), (3, "", "de", "a", 0), (4, " \n\t ", "en", "b", 4),
    (None, "no id here at all today", "en", "a", 3), (5, "one two three four five six seven eight", "en", "a", 5), (5, "one two three four five six seven eight", "en", "a", 5),
    (6, LONG, "fr", "a", 9), (7, "x" * 5000, "en", "c", 5000), (8, "½ ²³ naïve ﬁ 日本 </s>[INST]", "en", "a", 1), (9, "a\nb\nc\nd\na\nb\nc\nq", "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as those inside."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(ODD, schema)
    for c in ("id", "t", "class", "size", "words", "topic", "kind", "pos", "a", "b", "kept", "probability"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(small):
    d = pd.read_parquet(f"{small}/documents.parquet").sort_values("doc_id")
    return dict(zip(d.doc_id, d.text))


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def test_bpe_agrees_with_tiktoken(spark, odd, docs, none):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(queries.tokenizer_file())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for table in (odd, docs):
        rows = bpe.encode_decode(table, queries.tokenizer_file(), public_tokenizers.PATTERN, with_ids=True).collect()
        source = sorted((str(r.doc_id), r.text or "") for r in table.select("doc_id", "text").collect())
        want = sorted((i, ",".join(map(str, enc.encode_ordinary(t)))) for i, t in source)
        assert sorted((str(r.doc_id), r.ids) for r in rows) == want
        assert all(r.round_trip for r in rows)
    assert bpe.encode_decode(none, queries.tokenizer_file(), public_tokenizers.PATTERN).count() == 0


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_agrees_with_brute_force(spark, docs, texts, monkeypatch):
    want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == want
    # tiles and exact tasks of a few rows: every pair must still meet
    monkeypatch.setattr(jaccard, "TILE", 3)
    monkeypatch.setattr(jaccard, "EXACT_GRAMS", 500)
    rng = np.random.RandomState(3)
    base = [f"w{k}" for k in range(60)]
    near = {}
    for i in range(60):
        w = list(base)
        for at in rng.choice(60, rng.randint(0, 4), replace=False):
            w[at] = f"n{rng.randint(1000)}"
        near[i] = " ".join(w[: rng.randint(50, 61)])
    table = spark.createDataFrame(list(near.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(table).collect()}
    assert got == brute_components(near)


def test_jaccard_on_odd_rows(odd, none):
    rows = jaccard.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == len(ODD) and by[5].component_id == 1 and by[3].component_id == 3 and by[2].n_shingles == 0 and by[2].component_id == 2
    assert next(r for r in rows if r.doc_id is None).component_id is None
    assert jaccard.near_duplicates(none).count() == 0


def test_components(spark):
    rng = np.random.RandomState(1)
    edges = [(int(a), int(b)) for a, b in rng.randint(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_mixing_meets_its_targets(docs, odd, none):
    own = ("source", "lang")
    topics = mix.fit_topics(docs)
    fit = mix.fit(mix.with_topics(docs, topics, keep=own), queries.MIXTURE, 0.3)
    assert max(abs(x - queries.MIXTURE["lang"][k]) for k, x in fit.achieved["lang"].items()) < 0.05
    assert all(0 < p <= 1 for _, _, p in fit.cells)
    a = {r.doc_id for r in mix.sample(docs, queries.MIXTURE).where("kept").collect()}
    assert a == {r.doc_id for r in mix.keep(docs, queries.MIXTURE).collect()}
    assert mix.sample(odd, queries.MIXTURE).count() == len(ODD) and mix.sample(none, queries.MIXTURE).count() == 0
    assert mix.keep(odd, queries.MIXTURE, 1.0).columns == odd.columns and mix.keep(none, queries.MIXTURE).count() == 0
    # drawn shares are those of the cells, up to the chance of the draw
    rows = mix.sample(docs, queries.MIXTURE).collect()
    drawn, wanted = sum(max(r.words, 1) for r in rows if r.kept), sum(max(r.words, 1) * r.probability for r in rows)
    spread = sum(max(r.words, 1) ** 2 * r.probability * (1 - r.probability) for r in rows) ** 0.5
    assert abs(drawn - wanted) < 4 * spread
    assert all((r.weight == pytest.approx(1 / r.probability)) if r.kept else r.weight is None for r in rows)


def test_topics_are_the_planted_ones(spark):
    """Texts of four vocabularies fall into four clusters, also by the plain rule: the centre of the largest cosine."""
    rng = np.random.RandomState(4)
    vocabulary = [[f"word{k}{i:03d}" for i in range(40)] for k in range(4)]
    texts = [(i, " ".join(rng.choice(vocabulary[i % 4], 30))) for i in range(200)] + [(200, ""), (201, None), (202, "a b c")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    topics = mix.fit_topics(df, topics=4)
    got = {r.doc_id: (r.words, r.topic) for r in mix.with_topics(df, topics).collect()}
    assert all(len({got[i][1] for i in range(k, 200, 4)}) == 1 for k in range(4)) and len({t for _, t in got.values()}) == 4
    assert got[200] == got[201] == (0, "t0") and got[202] == (3, "t0")
    for i, t in texts[:20]:
        v = np.zeros(mix.TOPIC_SLOTS)
        _, _, slot, weight = mix.terms([t.encode()])
        v[slot] = weight * topics.idf[slot]
        assert got[i][1] == f"t{(topics.centres @ v).argmax()}"


def brute_rake(cells, targets, share):
    """Cell by cell in dicts: the same fixed point as the operator's arrays."""
    total = sum(cells.values())
    p = dict.fromkeys(cells, share)
    for _ in range(500):
        for i, target in enumerate(targets):
            words = collections.Counter()
            for c, w in cells.items():
                words[c[i]] += w
            want = {k: target.get(k, 0.0) for k in words}
            other = words[mix.OTHER] / total if mix.OTHER in words and mix.OTHER not in target else 0.0
            named = sum(target.values())
            want = {k: other if k == mix.OTHER and k not in target else x / named * (1 - other) for k, x in want.items()}
            have = sum(want.values())
            got = collections.Counter()
            for c, w in cells.items():
                got[c[i]] += w * p[c]
            p = {c: x * want[c[i]] / have * total * share / got[c[i]] if got[c[i]] else x for c, x in p.items()}
        p = {c: min(max(x, mix.FLOOR * share), 1.0) for c, x in p.items()}
    return p


def test_sample_agrees_with_brute_force(docs):
    rows = mix.sample(docs, queries.MIXTURE).collect()
    place = lambda r: tuple(v if v in queries.MIXTURE[c] else mix.OTHER for c, v in (("source", r.source), ("lang", r.lang), ("topic", r.topic)))
    cells = collections.Counter()
    for r in rows:
        cells[place(r)] += max(r.words, 1)
    p = brute_rake(cells, list(queries.MIXTURE.values()), 0.5)
    for r in rows:
        assert r.probability == pytest.approx(p[place(r)], rel=1e-3)


def test_rake_by_hand():
    words_ = np.array([100.0, 300.0, 200.0, 400.0])
    margins = [(np.array([0, 0, 1, 1]), np.array([0.5, 0.5])), (np.array([0, 1, 0, 1]), np.array([0.4, 0.6]))]
    p, _ = mix.rake(words_, margins, 0.2)
    drawn = words_ * p
    assert drawn.sum() == pytest.approx(200) and drawn[:2].sum() == pytest.approx(100) and drawn[[0, 2]].sum() == pytest.approx(80)


def test_kneser_ney_agrees_with_brute_force(docs, texts, odd, none):
    train = {i: words(t) + ["</end>"] for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1}
    c = collections.Counter(w for t in train.values() for w in t)
    pairs = collections.Counter(p for t in train.values() for p in zip(["<s>"] + t, t))
    cont = collections.Counter(w for _, w in pairs)
    size, kinds = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (v, _), k in pairs.items():
        size[v] += k
        kinds[v][min(k, 3) - 1] += 1
    of_pairs, of_words = collections.Counter(pairs.values()), collections.Counter(cont.values())
    d = kneser.discounts(*(of_pairs[k] for k in (1, 2, 3, 4)))
    e = kneser.discounts(*(of_words[k] for k in (1, 2, 3, 4)))
    take = lambda x, k: 0 if k == 0 else x[min(k, 3) - 1]
    left = (e[0] * of_words[1] + e[1] * of_words[2] + e[2] * (len(c) - of_words[1] - of_words[2])) / len(pairs)

    def p(v, w):
        one = max(cont[w] - take(e, cont[w]), 0) / len(pairs) + left / (len(c) + 1)
        if not size[v]:
            return one
        return max(pairs[v, w] - take(d, pairs[v, w]), 0) / size[v] + sum(a * b for a, b in zip(d, kinds[v])) / size[v] * one

    assert sum(p("<s>", w) for w in c) + p("<s>", "never seen") == pytest.approx(1)
    model = kneser.count(docs.where(kneser.fold() != 1))
    for r in kneser.score(docs, model).collect():
        t = words(texts[r.doc_id]) + ["</end>"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), sum(c.values()))
        assert r.score == pytest.approx(sum(math.log10(p(v, w)) for v, w in zip(["<s>"] + t, t)))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (sum(c.values()) + 0.5 * (len(c) + 1))) for w in t))
    assert kneser.score(odd, model).count() == len(ODD)
    assert all(r.score == 0 and r.n_known == 0 for r in kneser.score(odd, kneser.count(none)).collect())


def test_simhash_neighbours(docs, texts, odd, none):
    got = {r.doc_id: r for r in simhash.edited_pairs(docs, parts=7).collect()}
    order = sorted(texts, reverse=True)
    prints = {i: simhash.fingerprints([t.encode()])[0] for i, t in texts.items()}
    for i, nxt in zip(order, order[1:] + order[:1]):
        t, half = texts[i], len(texts[i]) // 2
        edited = t[: len(t) - half] + texts[nxt][:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[i].hex())
        assert r.near_next == simhash.likeness(prints[i], prints[nxt])
        assert r.near_edited == simhash.likeness(prints[i], simhash.fingerprints([edited.encode()])[0])
    assert sum(r.near_edited for r in got.values()) > 1.2 * sum(r.near_next for r in got.values())
    rows = simhash.edited_pairs(odd, parts=3).collect()
    assert len(rows) == len(ODD) and len({r.fingerprint for r in rows if r.doc_id in (1, 5)}) == 1
    assert simhash.edited_pairs(none).count() == 0


def test_fingerprints_agree_with_brute_force(texts):
    """Signed votes of every term, bit by bit, in plain numbers."""
    from sievelight.llm.hashing import U, Words, grams, mix

    for t in list(texts.values())[:25]:
        one = Words([t.encode()], lower=True).hashes()
        terms = collections.Counter([*one.tolist(), *grams(one, 2).tolist()])
        votes = [0] * 128
        for term, n in terms.items():
            weight = round(float(np.float32(1 + np.log(n))) * 1024)
            for lane in range(2):
                h = int(mix(np.array([term], dtype=np.uint64) + U(lane * 0x9E3779B97F4A7C15 & (2**64 - 1)))[0])
                for k, byte in enumerate(h.to_bytes(8, "little")):
                    for bit in range(8):
                        votes[lane * 64 + k * 8 + bit] += weight if byte >> (7 - bit) & 1 else -weight
        want = int("".join("1" if v > 0 else "0" for v in votes), 2).to_bytes(16, "big")
        assert simhash.fingerprints([t.encode()])[0] == want


def test_neighbours_of_hot_and_null_ids(spark):
    """A third of the rows under one id, repeated rows and null ids: each row's next is the one the plain order gives."""
    rng = np.random.RandomState(9)
    rows = [(7, f"hot text {i}") for i in range(40)] + [(7, "the same row")] * 30 + [(None, f"no id {i}") for i in range(20)] + [(int(i), f"text {i} " + "w " * int(rng.randint(30))) for i in rng.randint(0, 500, 30)] + [(3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashed = [(r.k, r.h, r.t or "", r.doc_id) for r in df.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64("text").alias("h"), F.col("text").alias("t")).collect()]
    hashed.sort(key=lambda r: (r[0], r[1]), reverse=True)
    want = []
    for at, (_, _, t, i) in enumerate(hashed):
        nxt, half = hashed[(at + 1) % len(hashed)][2], len(t) // 2
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    for parts in (1, 5, 30):
        got = [(str(r.doc_id), r.n_chars, r.edited_sha256) for r in simhash.edited_pairs(df, parts=parts).collect()]
        assert sorted(got) == sorted(want)
    with pytest.raises(ValueError, match="whole numbers"):
        simhash.edited_pairs(df.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_simhash_query_counts_neighbours(spark, tmp_path):
    """n_near is the number of other fingerprints within the radius, whatever the tiles."""
    rng = np.random.RandomState(8)
    base = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(60):
        w = list(base) if i < 40 else [f"v{k}" for k in rng.randint(0, 10**6, 50)]
        if i < 40:
            for at in rng.choice(3000, rng.randint(0, 12), replace=False):
                w[at] = f"x{rng.randint(10**6)}"
        rows.append((i, " ".join(w)))
    spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_simhash(spark, str(tmp_path)).collect()
    prints = {r.fingerprint for r in got}
    want = {p: sum(q != p and (int(p, 16) ^ int(q, 16)).bit_count() <= 3 for q in prints) for p in prints}
    assert len(got) == 65 and all(r.n_near == want[r.fingerprint] for r in got) and max(want.values()) > 1
    fp = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    for tile, blocks in ((2, 4), (4096, 8)):
        assert {r.fingerprint: r.n_near for r in simhash.neighbours(fp, tile=tile, blocks=blocks).collect()} == {p: n for p, n in want.items() if n}


def test_simhash_search_finds_every_near_pair(spark):
    rng = np.random.RandomState(2)
    base = [rng.bytes(16) for _ in range(20)]
    prints = set(base)
    for b in base:
        for _ in range(6):
            x = int.from_bytes(b, "big")
            for at in rng.choice(128, rng.randint(1, 6), replace=False):
                x ^= 1 << int(at)
            prints.add(x.to_bytes(16, "big"))
    hexes = sorted(p.hex() for p in prints)
    df = spark.createDataFrame([(h,) for h in hexes + hexes[:5]] + [(None,)], "fingerprint string")
    want = {(a, b) for n, a in enumerate(hexes) for b in hexes[n + 1 :] if (int(a, 16) ^ int(b, 16)).bit_count() <= 3}
    assert {(r.a, r.b) for r in simhash.near(df, radius=3).collect()} == want and want


def brute_lines(texts):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        ls = t.split("\n")
        gone = set()
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if "".join(w).strip():
                if w in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(w)
        out[i] = ("\n".join(x for k, x in enumerate(ls) if k not in gone), len(ls), len(gone))
    return out


def test_lines_agree_with_brute_force(docs, texts, odd, none):
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup(docs).collect()}
    assert got == brute_lines(texts)
    rows = lines.dedup(odd).collect()
    assert len(rows) == len(ODD) and next(r for r in rows if r.doc_id == 9).text == "a\nb\nc\nd\nq"
    assert next(r for r in rows if r.doc_id == 2).text is None and rows[0].words == "clash"
    assert lines.dedup(none).count() == 0


def test_compression_scores_held_out_quality(spark, odd, none):
    folder = "/root/testdata/sf0.01"
    rows = queries.op7_compress(spark, folder).collect()
    label = dict(pd.read_parquet(f"{folder}/labels.parquet")[["doc_id", "quality"]].itertuples(index=False))
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9 and np.mean([s >= 0.3 for s in good]) > 0.95
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    flat = compress.score(odd, compress.fit(odd, labels)).collect()
    assert len(flat) == len(ODD) and {r.score for r in flat} == {0.5}
    assert compress.score(none, compress.fit(none, labels)).count() == 0


def test_gear_agrees_with_brute_force(docs, texts, odd, none):
    seen, want = set(), {}
    for i, t in texts.items():
        raw, at, runs = t.encode(), 0, []
        for stop in gear.cuts([raw])[0]:
            chunk = raw[at:stop]
            if chunk in seen:
                if runs and runs[-1][1] == at:
                    runs[-1][1] = stop
                else:
                    runs.append([at, stop])
            seen.add(chunk)
            at = stop
        assert at == len(raw)
        want[i] = [tuple(r) for r in runs if r[1] - r[0] >= 100 or r == [0, len(raw)]]
    got = gear.dedup(docs).collect()
    assert {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in got} == want
    for r in got:
        assert len(r.text.encode()) == r.n_bytes - r.removed_bytes
    rows = gear.dedup(odd).collect()
    assert len(rows) == len(ODD) and next(r for r in rows if r.doc_id == 2).n_chunks == 0
    assert gear.dedup(none).count() == 0


def test_gear_drops_copies_of_short_texts(spark):
    df = spark.createDataFrame([(1, "a short text"), (2, "a short text"), (3, "a short text, and more"), (4, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in gear.dedup(df).collect()}
    assert got == {1: "a short text", 2: "", 3: "a short text, and more", 4: ""}


def test_gear_cuts_come_back_after_an_insertion():
    rng = np.random.RandomState(5)
    raw = bytes(rng.randint(97, 123, 4000).tolist())
    chunks = lambda x: [x[a:b] for a, b in zip([0, *gear.cuts([x])[0]], gear.cuts([x])[0])]
    a, b = set(chunks(raw)), set(chunks(raw[:50] + b"inserted" + raw[50:]))
    assert len(a - b) <= 4
    both = gear.cuts([b"other text first", raw])
    assert both[1] == gear.cuts([raw])[0]


def test_chat_round_trip(spark):
    t = chat.Template()
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "a\\b\\\\<s>\n"), ("odd\nrole\\", ""), ("", "<<s>> \\<")]
    assert t.read("".join(t.turn(r, x)[0] for r, x in turns)) == turns
    body = t.turn(*turns[0])
    assert body[0].count("</s>") == 1 and t.unescape(body[0][body[1] : body[2]]) == turns[0][1]


def test_chat_branches(spark):
    nodes = [("x", 1, None, 1.0), ("x", 2, 1, 5.0), ("x", 3, 1, 1.0), ("x", 4, 3, 1.0), ("x", 5, 4, 1.0), ("y", 1, 9, 0.0), ("z", 1, 2, 0.0), ("z", 2, 1, 0.0), ("z", 3, None, None)]
    df = spark.createDataFrame(nodes, "tree string, node bigint, parent bigint, score double")
    best = {(r.tree, r.leaf): [] for r in chat.branches(df, 1, score="score").collect()}
    for r in chat.branches(df, None, score="score").orderBy("tree", "leaf", "depth").collect():
        best.setdefault((r.tree, r.leaf), []).append((r.branch_rank, r.node, r.depth))
    assert best[("x", 2)] == [(1, 1, 1), (1, 2, 2)] and best[("x", 5)] == [(2, 1, 1), (2, 3, 2), (2, 4, 3), (2, 5, 4)]
    assert set(best) == {("x", 2), ("x", 5), ("y", 1), ("z", 3)}
    chain = spark.createDataFrame([("c", i, i - 1 if i else None) for i in range(77)], "tree string, node bigint, parent bigint")
    assert [r.node for r in chat.branches(chain).orderBy("depth").collect()] == list(range(77))
    assert chat.branches(df.limit(0)).count() == 0


def test_chat_query(spark, small):
    rows = {r.conv_id: r for r in queries.op9_chat(spark, small).collect()}
    c = pd.read_parquet(f"{small}/conversations.parquet").sort_values(["conv_id", "turn"], kind="stable")
    assert rows.pop(-7).n_turns == 2 and len(rows) == c.conv_id.nunique()
    for conv, g in c.groupby("conv_id"):
        said = "".join(f"{r}\n{t or ''}\n" for r, t in zip(g.role, g.text))
        loss = "".join(t or "" for r, t in zip(g.role, g.text) if r == "assistant")
        r = rows[conv]
        assert (r.n_turns, r.turns_sha256) == (len(g), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, None, "x"), (1, None, "user", "y"), (None, 1, "user", "z"), (1, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    m = chat.linear(df)
    out = chat.read_back(chat.format_branches(chat.with_messages(chat.branches(m), m))).collect()
    assert sorted((str(r.tree), r.n_turns) for r in out) == [("1", 4), ("None", 1)]
    m = chat.linear(df.limit(0))
    assert chat.read_back(chat.format_branches(chat.with_messages(chat.branches(m), m))).count() == 0
    clash = df.withColumns({c: F.lit("clash") for c in ("tree", "node", "parent", "leaf", "depth", "at", "formatted", "loss", "t", "n", "s")})
    m = chat.linear(clash)
    assert chat.read_back(chat.format_branches(chat.with_messages(chat.branches(m), m))).count() == 2


def test_rules_agree_with_brute_force(spark, small, docs, texts, odd, none):
    field = crf.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    for r in crf.judge(docs, field).collect():
        t = texts[r.doc_id]
        w = words(t, lower=False)
        own = [x for x in t.split("\n") if WORD.search(x)]
        runs = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        twice = {i + k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in range(3)}
        counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(twice))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w)) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in crf.judge(docs, field).where("kept").collect()}
    assert kept == {r.doc_id for r in crf.keep(docs, field).collect()}
    assert crf.judge(odd, crf.Field.neutral()).count() == len(ODD)
    assert crf.judge(none, crf.fit(none, spark.createDataFrame([], "doc_id bigint, quality int"))).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.RandomState(0)
    for _ in range(20):
        f = crf.Field(np.zeros((1, 2)), rng.randn(2, 2), rng.randn(2), np.zeros(crf.LEXICON))
        emit = rng.randn(6, 2)

        def total(y):
            return f.start[y[0]] + sum(emit[i, k] for i, k in enumerate(y)) + sum(f.step[a, b] for a, b in zip(y, y[1:]))

        want = max(([n >> i & 1 for i in range(6)] for n in range(64)), key=total)
        assert f.viterbi(emit) == want


def test_pipeline_stages(spark, small, odd):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids = [set(r.doc_id for r in docs.collect())]
    for name, stage in P.STAGES:
        docs = stage(spark, docs, small).cache()
        rows = docs.collect()
        ids.append({r.doc_id for r in rows})
        assert ids[-1] <= ids[-2] and ids[-1], name
        if name != "tokenize":
            assert docs.columns == P.COLUMNS
    assert P.run(spark, small).count() == len(rows)
    for name, stage in P.STAGES:
        assert stage(spark, odd, small).count() <= len(ODD), name
        assert stage(spark, odd.limit(0), small).count() == 0, name


def test_near_duplicates_keep_one_row_of_each_group(spark):
    """Rows go by id and text: other texts under the id of a copy stay, and repeated rows become one."""
    t = "one two three four five six seven eight nine ten"
    rows = [(1, t), (5, t), (5, "an altogether different text of six words"), (7, t), (7, t), (None, t), (8, t.upper()), (9, "q"), (9, "q"), (10, None), (10, None), (11, ""), (None, "z z")]
    df = spark.createDataFrame([(i, x, "en", "a", 1) for i, x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted((str(r.doc_id), str(r.text)) for r in jaccard.keep(df).collect())
    assert got == sorted([("1", t), ("5", rows[2][1]), ("9", "q"), ("10", "None"), ("10", "None"), ("11", ""), ("None", "z z")])
    named = df.withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))
    assert sorted((str(r.doc_id), str(r.text)) for r in jaccard.keep(named).collect()) == sorted([("id1", t), ("id5", rows[2][1]), ("id9", "q"), ("id10", "None"), ("id10", "None"), ("id11", ""), ("None", "z z")])
    clash = df.withColumns({c: F.lit(1) for c in ("stays", "text_hash", "touched_id", "touched_text", "key", "class", "t", "id")})
    assert jaccard.keep(clash).count() == 7 and jaccard.keep(clash).columns == clash.columns


def test_boilerplate_in_good_texts_is_marked(spark):
    """Lines that stand in many unlike good texts are boilerplate; copies of a text do not make its lines so."""
    rng = np.random.RandomState(7)
    words_ = [f"prose{i}" for i in range(400)]
    body = lambda: [" ".join(rng.choice(words_, 12)) + "." for _ in range(6)]
    notice = ["ALL RIGHTS RESERVED 1999 | LICENCE", "TERMS | PRIVACY | CONTACT | 2001"]
    unlike = ["\n".join(body() + notice) for _ in range(30)]
    copied = ["\n".join(body())] * 10
    junk = ["\n".join(["$$ ## 12 | 99 && %%"] * 8 + [str(i)]) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(unlike + copied + junk)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(70)], "doc_id bigint, quality int")
    field = crf.fit(df, labels)
    new = crf.measure(["\n".join(body() + notice).encode(), copied[0].encode(), junk[0].encode()])
    got = [field.labels(new)[a:b].tolist() for a, b in zip(new.offsets, new.offsets[1:])]
    assert got[0] == [1] * 6 + [0, 0] and got[1] == [1] * 6 and not any(got[2])
    twice = crf.fit(df, labels.union(labels).union(spark.createDataFrame([(None, 1), (69, None)], labels.schema)))
    assert np.allclose(twice.state, field.state)


def test_samples_are_bounded_when_an_id_repeats(spark):
    from sievelight.llm import sampling

    df = spark.range(500).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    df = df.union(spark.createDataFrame([(2, "two"), (3, "three"), (4, None), (5, "five")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (4, 1), (5, None), (None, 1)], "doc_id bigint, quality int")
    got = sampling.labelled(df, labels, 10, "doc_id", "text", "quality")
    assert sorted(q for _, q in got) == [0, 1] and ("two", 0) in got
    assert len(sampling.texts(df, 7, "text")) == 7 and len(sampling.texts(df.union(df), 10_000, "text")) == 503


def test_long_runs_contract_like_short_ones():
    """Pieces far longer than a block, of several kinds, against the library's own encoder."""
    import random

    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(queries.tokenizer_file())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    runs = ["".join(rng.choice(a) for _ in range(n)) for n in (90, 99, 100, 101, 900, 5000) for a in ("abcdefghijklmnopqrstuvwxyz", "aeintr", "ab", "0123456789", "日本語中文字", "абвгд", "!?#*")]
    runs += ["a" * 3000, "the" * 700, " " * 1500 + "x", "ing" * 50 + "s" * 500]
    own = bpe.Bpe(ranks, public_tokenizers.PATTERN)
    assert own.encode(runs) == [",".join(map(str, enc.encode_ordinary(t))) for t in runs]


def test_lines_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 7, 8, 9), (2, "a\nb\nc", 7, 8, 9), (3, None, 7, 8, 9)], "doc_id bigint, text string, n_lines int, n_removed int, covered int")
    got = {r.doc_id: r for r in lines.dedup(df).collect()}
    assert lines.dedup(df).columns == ["doc_id", "text", "covered", "n_lines", "n_removed"]
    assert [(got[i].text, got[i].n_lines, got[i].n_removed, got[i].covered) for i in (1, 2, 3)] == [("a\nb\nc", 3, 0, 9), ("", 3, 3, 9), (None, 0, 0, 9)]


def test_compression_agrees_with_brute_force(spark, docs, texts):
    """Scores of every text from the model's dictionaries, one block after the other; ties and repeats score alike."""
    import zstandard

    labels = spark.createDataFrame([(i, int(k % 3 > 0)) for k, i in enumerate(sorted(texts))], "doc_id bigint, quality int")
    model = compress.fit(docs, labels, compress.Settings(per_class=20, calibration=20))
    size = lambda raw, d: sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(raw[i : i + 512])) for i in range(0, len(raw), 512))
    got = {r.doc_id: r for r in compress.score(docs, model).collect()}
    for i in sorted(texts)[:60]:
        raw = texts[i].encode()
        a, b = size(raw, model.good), size(raw, model.bad)
        x = (b - a) / max(a, b) if raw else 0.0
        assert got[i].feature == pytest.approx(x) and got[i].score == pytest.approx(1 / (1 + math.exp(-(model.slope * x + model.intercept))))
    long = spark.createDataFrame([(1, LONG * 20), (2, LONG * 20), (None, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r.score for r in compress.score(long, model).collect()}
    assert rows[1] == rows[2] and 0 < rows[1] < 1 and len(rows) == 3


def test_pipeline_agrees_with_brute_force(spark, small, texts):
    """Every stage's rows from those of the one before, reckoned in plain Python."""
    import public_tokenizers
    import tiktoken

    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, small).cache()
        held[name] = {r.doc_id: r for r in docs.collect()}
    source = spark.read.parquet(f"{small}/documents.parquet")
    judged = crf.judge(source, crf.fit(source, spark.read.parquet(f"{small}/labels.parquet")))
    now = {r.doc_id: texts[r.doc_id] for r in judged.where("kept").collect()}
    assert set(held["quality_rules"]) == set(now)
    deduped = {i: t for i, (t, _, gone) in brute_lines(now).items() if not gone or t.strip()}
    assert {i: r.text for i, r in held["line_dedup"].items()} == deduped and all(r.n_chars == len(r.text) for r in held["line_dedup"].values())
    groups = brute_components(deduped)
    now = {i: t for i, t in deduped.items() if groups[i][1] == i}
    assert {i: r.text for i, r in held["near_duplicates"].items()} == now
    before = source.where(F.col("doc_id").isin(list(now))).drop("text", "n_chars").join(spark.createDataFrame(list(now.items()), "doc_id bigint, text string"), "doc_id")
    rows = mix.sample(before, queries.MIXTURE, queries.SAMPLE_SHARE).collect()
    cells = collections.Counter()
    place = lambda r: tuple(v if v in queries.MIXTURE[c] else mix.OTHER for c, v in (("source", r.source), ("lang", r.lang), ("topic", r.topic)))
    for r in rows:
        cells[place(r)] += max(r.words, 1)
    p = brute_rake(cells, list(queries.MIXTURE.values()), queries.SAMPLE_SHARE)
    draws = {r.doc_id: r.d for r in spark.createDataFrame([(i,) for i in now], "doc_id bigint").select("doc_id", (F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id"), 11) / F.lit(float(1 << 53))).alias("d")).collect()}
    assert set(held["mixing"]) == {r.doc_id for r in rows if draws[r.doc_id] < p[place(r)]}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.tokenizer_file()), special_tokens={})
    assert {i: r.n_tokens for i, r in held["tokenize"].items()} == {i: len(enc.encode_ordinary(now[i])) for i in held["mixing"]}
    assert {r.doc_id: r.ids_sha256 for r in P.run(spark, small).collect()} == {i: r.ids_sha256 for i, r in held["tokenize"].items()}
