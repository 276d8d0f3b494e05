"""The training-data operators against brute force, round trips and odd rows."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest

from plumbline.llm import bytehash, chat, chunk_dedup, common, decontam, fingerprint, langid, mixing, ngram_join, quality, suffix, suffix_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, k string"


def corpus(n=60, seed=3):
    """Documents with copies, near copies, shared passages, odd texts and clashing extra columns."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    docs = [text(rng.randint(3, 200)) for _ in range(n)]
    docs += [docs[0], docs[0], docs[1]]
    shared = text(120)
    docs += [text(20) + " " + shared + " " + text(15), shared, text(5) + " " + shared]
    for _ in range(4):
        w = docs[2].split()
        w[rng.randrange(len(w))] = "other"
        docs.append(" ".join(w))
    docs += ["", None, " \t\n", "one", "é", "ab " * 4000, "x" * 9000]
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, 0.5, "clash") for i, t in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def odd_frames(spark):
    rows = corpus(20)
    yield spark.createDataFrame([], SCHEMA)
    yield spark.createDataFrame(rows + rows[:5] + [(None, "null id text here now", None, None, None, None, None), (None, None, None, None, None, None, None), (3, "same id other text of some words", "en", "s", 1, 0.1, "z")], SCHEMA)


def sets_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def components_of(rows):
    s = [(i, sets_of(t)) for i, t in rows]
    root = {i: i for i, _ in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            x, y = s[a][1], s[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(s[a][0]), find(s[b][0])
                root[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in s}


def test_ngram_join_is_brute_force(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == components_of([(r[0], r[1]) for r in corpus()])


def test_ngram_join_with_all_texts_open_is_the_same(spark, docs):
    p = ngram_join.JoinParams(zone=0.1, most_bits=10, near=75, fragments=1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, p).collect()}
    assert got == components_of([(r[0], r[1]) for r in corpus()])


def links_of(rows):
    """Every pair of different sets that links."""
    s = sorted({x for _, t in rows if (x := sets_of(t))}, key=sorted)
    return {frozenset((x, y)) for k, x in enumerate(s) for y in s[:k] if 100 * len(x & y) >= 75 * len(x | y)}


@pytest.mark.parametrize("blocks", [{}, {"block_texts": 7}, {"block_grams": 900, "near": 75}, {"near": 5, "fragments": 16}])
def test_ngram_join_gives_every_link(spark, blocks):
    """A large group of near copies (some pairs in it don't link), a pair, and exact copies."""
    rng = random.Random(8)
    base, rows = [f"w{k}" for k in range(120)], []
    for i in range(50):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        rows.append((i, " ".join(w)))
    pair = " ".join(f"p{k}" for k in range(40))
    rows += [(80, pair), (81, pair + " more"), (82, pair), (90, "alone here"), (91, None)]
    text = dict(rows)
    want = links_of(rows)
    different = len({sets_of(text[i]) for i in range(50)})
    assert 200 < len(want) < different * (different - 1) / 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = ngram_join.JoinParams(**blocks)
    got = [(r.a, r.b) for r in ngram_join.similarity_join(df, p).pairs().collect()]
    assert len(got) == len(want) and all(a < b for a, b in got)
    assert {frozenset((sets_of(text[a]), sets_of(text[b]))) for a, b in got} == want
    n = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(df, p).collect()}
    assert n == {i: sum(sets_of(t) in q for q in want) if sets_of(t) else 0 for i, t in rows}


def test_ngram_join_of_near_copies_under_the_threshold(spark):
    """Copies edited so much that most pairs don't link, at other sizes and beside a passage that all share."""
    rng = random.Random(21)
    base, rows = [f"w{k}" for k in range(100)], []
    for i in range(70):
        w = list(base)
        for at in rng.sample(range(100), rng.choice([0, 1, 1, 2, 5])):
            w[at] = f"e{rng.randrange(400)}"
        rows.append((i, " ".join(w[rng.randint(0, 5) :] + [f"t{rng.randrange(9)}" for _ in range(rng.randint(0, 6))])))
    for i in range(100, 130):
        own = [f"o{rng.randrange(5000)}" for _ in range(rng.choice([5, 15, 30, 60]))]
        rows.append((i, " ".join(base[:50] + own)))
    text, want = dict(rows), links_of(rows)
    assert 100 < len(want) < 1500
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for p in (ngram_join.JoinParams(), ngram_join.JoinParams(near=75, zone=0.2)):
        got = [(r.a, r.b) for r in ngram_join.similarity_join(df, p).pairs().collect()]
        assert len(got) == len(set(got)) == len(want)
        assert {frozenset((sets_of(text[a]), sets_of(text[b]))) for a, b in got} == want
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()}
    assert got == components_of(rows)


def covered(texts, length):
    seen = {}
    for i, b in enumerate(texts):
        for j in range(len(b) - length + 1):
            seen.setdefault(b[j : j + length], []).append((i, j))
    out = [np.zeros(len(b), bool) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                out[i][j : j + length] = True
    return out


@pytest.mark.parametrize("shard", [2 << 20, 100])
def test_suffix_dedup_is_brute_force(spark, docs, shard):
    rows = corpus()
    texts = [(t or "").encode() for _, t, *_ in rows]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, suffix_dedup.SuffixParams(shard_bytes=shard)).collect()}
    for (i, *_), raw, mask in zip(rows, texts, covered(texts, 400)):
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()), i


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for _ in range(60):
        parts = [[rng.choice((97, 98)) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 4))]
        depth, flat, begins = rng.choice([1, 2, 5, 13]), [], []
        for i, x in enumerate(parts):
            begins.append(len(flat))
            flat += [*x, 256 + i]
        s = np.array(flat)
        sa, place, rank = suffix.suffix_array(s, depth)
        heads = [tuple(flat[i : i + depth]) for i in range(len(flat))]
        assert [heads[i] for i in sa] == sorted(heads)
        lcp = suffix.common_prefixes(s, sa, place, rank, np.array(begins), np.array([len(x) + 1 for x in parts]), depth)
        for r in range(1, len(sa)):
            i, j, e = sa[r], sa[r - 1], 0
            while e < depth and i + e < len(flat) and j + e < len(flat) and flat[i + e] == flat[j + e]:
                e += 1
            assert lcp[i] == e


def test_chunks_resist_shifts_and_keep_text(spark, docs):
    p = chunk_dedup.ChunkParams()
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(600)).encode()
    ends = list(chunk_dedup.chunk_ends([text, b"inserted " + text], p))
    cut = lambda raw, e: {raw[a:b] for a, b in zip([0, *e[:-1]], e)}
    assert len(cut(text, ends[0]) - cut(b"inserted " + text, ends[1])) <= 2
    assert all(b - a <= p.longest for e in ends for a, b in zip([0, *e[:-1]], e))
    got = {r.doc_id: r for r in chunk_dedup.dedup_chunks(docs).collect()}
    rows = corpus()
    for i, t, *_ in rows:
        assert got[i].n_bytes == len((t or "").encode())
        assert len(got[i].kept.encode()) == got[i].n_bytes - got[i].n_removed
    assert got[0].n_removed == 0 and got[60].kept == "" and got[61].kept == ""  # the first copy stays
    assert got[64].n_removed > 300 and got[65].n_removed > 300 and got[63].n_removed == 0


def test_fingerprints(spark, docs):
    rows = sorted(((i, t or "") for i, t, *_ in corpus()), reverse=True)
    can = lambda x: " ".join(unicodedata.normalize("NFKC", x).casefold().split())
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs).collect()}
    assert len(got) == len(rows)
    prints = {}
    for n, (i, x) in enumerate(rows):
        y = rows[(n + 1) % len(rows)][1]
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(can(x) == can(edited)), float(can(x) == can(y)))
        assert prints.setdefault(can(x), r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)


def test_colliding_hashes_are_told_apart(spark, docs, monkeypatch):
    """With a hash of four values, bytes decide."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprint, "wide_hash", lambda c: F.concat(F.lit("h"), (F.length(c) % 4).cast("string")))
    can = lambda x: " ".join(unicodedata.normalize("NFKC", x or "").casefold().split())
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs).collect()}
    by = {}
    for i, t, *_ in corpus():
        by.setdefault(can(t), set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)
    rows = sorted(((i, t) for i, t, *_ in corpus()), reverse=True)
    assert all(got[i].near_next == float(can(t) == can(rows[(n + 1) % len(rows)][1])) for n, (i, t) in enumerate(rows))


def test_canonical_form(spark):
    df = spark.createDataFrame([("ﬁne   CAFÉ",), ("  fine\tcafé\n",)], "text string")
    assert len({r[0] for r in df.select(fingerprint.canonical(df.text)).collect()}) == 1


def test_chat_round_trip():
    odd = [r"\### Assistant: </turn> ok", "####", "\\", "\\\\###", "<|image 0|>", "a: b", "</turn>\n### user: x</turn>\n", "<", "", "\\: ", "é\n"]
    for s in odd:
        text, mask, _ = chat.format_turns([("user", [{"kind": "text", "text": s}]), ("assistant", [{"text": s[:1]}, None, {"text": s[1:]}]), ("od: d###", [{"text": s}])])
        assert chat.read_turns(text) == [("user", s), ("assistant", s), ("od: d###", s)]
        assert [chat.unescape(text[a:b]) for a, b in mask] == [s]


def test_chat_parts():
    parts = [{"text": "see "}, {"kind": "image", "ref": "i.png", "width": 56, "height": 29}, {"kind": "audio", "ref": "a", "seconds": 2.0}, {"kind": "document", "ref": "d", "pages": 2}, {"text": "end"}]
    text, _, attached = chat.format_turns([("user", parts)])
    assert text == "### user: see <|image 0|><|audio 1|><|document 2|>end</turn>\n"
    assert [(a.kind, a.ref, a.tokens) for a in attached] == [("image", "i.png", 4), ("audio", "a", 50), ("document", "d", 1200)]
    with pytest.raises(ValueError):
        chat.format_turns([("user", [{"kind": "video"}])])


def test_chat_frames(spark):
    part = chat.PART_TYPE
    rows = [(1, 0, "user", None, [("image", None, "x", 28, 28, None, None)]), (1, 1, None, None, None), (None, None, None, "t", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts array<{part}>")
    out = chat.format_conversations(df)
    got = {r.conv_id: (r.formatted, r.attachment_tokens) for r in out.collect()}
    assert got == {1: ("### user: <|image 0|></turn>\n### : </turn>\n", 1), None: ("### : t</turn>\n", 0)}
    assert chat.read_back(out.limit(0)).count() == 0


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in corpus()}
    assert {r.doc_id: r.size for r in got} == size
    by = {}
    for r in got:
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        by.setdefault(r.source, []).append(r)
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(sum(size.values()))
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(20, 0.02 * rows[0].target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


def test_mixing_blocks_and_shares(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), "en", "ab"[i % 2], None, None, None) for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), mixing.MixParams(block_rows=100)).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) < 200


def shared_out(sizes, weights, most):
    """Targets by weight, worked out one source after the other."""
    targets, rest = {}, float(sum(sizes))
    while len(targets) < len(sizes):
        left = [i for i in range(len(sizes)) if i not in targets]
        unit = rest / sum(weights[i] for i in left)
        over = [i for i in left if weights[i] * unit > most * sizes[i]]
        targets |= {i: most * sizes[i] if over else weights[i] * unit for i in over or left}
        rest -= sum(most * sizes[i] for i in over)
    return [targets[i] for i in range(len(sizes))]


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_targets_are_shared_out_by_weight(spark, broadcast_rows):
    rng = random.Random(4)
    names = sorted([f"s{i}" for i in range(40)] + ["é", "Z", "a", "\U0001f600", "\uffee"])
    sizes = {n: rng.choice([0, 3, 50, 4000, rng.randint(1, 300)]) for n in [*names, None]}
    rows = [(i, "w " * k, n) for i, (n, k) in enumerate(sizes.items())]
    want = dict(zip([*names, None], shared_out(list(sizes.values()), [(1, 2, 3)[i % 3] for i in range(len(sizes))], 3)))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(df, mixing.MixParams(broadcast_rows=broadcast_rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.size, r.source_size) == (sizes[r.source],) * 2 and r.target == pytest.approx(want[r.source])


def test_small_source_settles_beside_a_large_one(spark):
    """A source of one block gets the same rows taken whether another source fits in one block or not."""
    rng = random.Random(9)
    size = [rng.randint(1, 90) for _ in range(150)]
    small = [(i, "w " * n, "en", "a", None, None, None) for i, n in enumerate(size)]
    large = [(1000 + i, "w " * rng.randint(1, 90), "en", "b", None, None, None) for i in range(2000)]
    docs = spark.createDataFrame(small + large, SCHEMA)
    one, many = (mixing.mix(docs, mixing.MixParams(block_rows=k, most_repeats=1.5)).collect() for k in (4000, 256))
    for s in "ab":
        total, target = sum(r.taken for r in many if r.source == s), next(r.target for r in many if r.source == s)
        assert abs(total - target) <= 1
    own = lambda rows: sorted((r.doc_id, r.taken) for r in rows if r.source == "a")
    assert own(one) == own(many)
    assert len(many) == 2150 and len({r.doc_id for r in many}) == 2150


def test_cube_keeps_totals():
    rng = random.Random(5)
    size = sorted((rng.randint(1, 100) for _ in range(200)), reverse=True)
    p = mixing.fly(mixing.fly_large_first([0.37] * 200, size, rng.random), size, rng.random, False)
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(74) and sum(x * s for x, s in zip(p, size)) == pytest.approx(0.37 * sum(size))


def test_decontamination(spark):
    item = "Tom bought 12 apples for 3 euros at the old market near Paris and then sold them all again later"
    other = "Ann bought 40 apples for 7 dollars at the old market near Rome and then sold them all again later"
    mixed = "Ann bought 40 apples for 7 dollars at the old market near Rome"
    clean = "nothing of that kind stands in this long and quite ordinary text about the sea and its many fish"
    docs = spark.createDataFrame([(1, "Before. " + item + " After.", "x"), (2, "So: " + other, "x"), (3, clean, "x"), (4, None, "x"), (5, "", "x"), (None, item, "x"), (6, mixed, "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.find_leaks(docs, bench).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7), (6, 7)}
    assert all(r.n_slots == r.n_consistent for r in got.values())
    twice = spark.createDataFrame([(1, "Tom met Tom and they spoke of the war with Tom for long hours")], "item_id long, text string")
    bad = spark.createDataFrame([(1, "Ann met Bob and they spoke of the war with Cid for long hours"), (2, "Ann met Ann and they spoke of the war with Ann for long hours")], "doc_id long, text string")
    assert [r.doc_id for r in decontam.find_leaks(bad, twice, decontam.LeakParams(consistent=1.0)).collect()] == [2]
    shuffled = decontam.find_leaks(docs, bench, decontam.LeakParams(broadcast_rows=0)).collect()
    assert {(r.doc_id, r.item_id) for r in shuffled} == set(got)


def labelled(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(400):
        w = [word() for _ in range(40)]
        bad, toxic = i % 3 == 0, i % 4 == 0
        if toxic:
            w[5:5] = ["idiot", "moron"]
        rows.append((i, " ".join(x + "&&&%" if bad else x for x in w), int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark):
    df = labelled(spark)
    train, held = df.where("doc_id % 5 <> 1"), df.where("doc_id % 5 = 1")
    q = quality.score_quality(held, quality.fit_quality(train, train), keep=["doc_id", "quality"]).collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in q]) > 0.95
    t = toxicity.score_toxicity(held, toxicity.fit_toxicity(train, train), keep=["doc_id", "toxic"]).collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in t]) > 0.95


def test_language(spark):
    de, en = "der hund und die katze laufen über die straße nach hause", "the dog and the cat walk over the street to their house"
    rows = [(i, (de if i % 2 else en)[i % 9 :], "de" if i % 2 else "en") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_language(df)
    ask = spark.createDataFrame([(1, "die straße und der hund"), (2, "THE STREET AND THE DOG"), (3, None), (4, "123 !?"), (5, ""), (6, "the dog " * 90_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict_language(ask, model, keep=["doc_id"]).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["de", "en", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_frames(spark):
    """Nulls, repeats, a repeated id with another text, clashing columns, empty tables: every operator runs and
    gives a row for each row."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in odd_frames(spark):
        n = df.count()
        assert ngram_join.near_duplicates(df).count() == n
        assert suffix_dedup.remove_repeats(df).count() == n
        assert chunk_dedup.dedup_chunks(df, carry=["k"]).count() == n
        assert fingerprint.fingerprint_edits(df).count() == n
        assert mixing.mix(df).count() == n
        model = langid.fit_language(df)
        assert langid.predict_language(df, model, keep=["doc_id"]).count() == n
        assert quality.score_quality(df, quality.fit_quality(df, labels), keep=["doc_id"]).count() == n
        assert toxicity.score_toxicity(df, toxicity.fit_toxicity(df, labels), keep=["doc_id"]).count() == n
        assert decontam.find_leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_repeated_ids_share_a_component(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a), (1, "one two")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 1: 1}


def test_pipeline_small(spark, tiny):
    import corpus_pipeline as C

    rows = {r.doc_id: r.text for r in common.read_table(spark, tiny, "documents").collect()}
    docs, kept = common.read_table(spark, tiny, "documents"), {}
    for name, stage in C.STAGES:
        docs = common.written(stage(spark, docs, tiny), "test")
        kept[name] = [r.doc_id for r in docs.collect()]
        assert len(set(kept[name])) == len(kept[name])
        if name != "mixing":
            assert docs.columns == C.COLUMNS
    parts = components_of(sorted((i, rows[i]) for i in kept["language_id"]))
    assert sorted(kept["near_duplicates"]) == sorted({c for _, c in parts.values()})
    assert set(kept["mixing"]) <= set(kept["decontamination"]) <= set(kept["substring_dedup"])


def test_word_hashes_of_long_texts():
    text = ("Wort " * 200_000) + "x" * 700_000 + " Ende"
    got = dict(bytehash.word_hashes(["a b", text, None]))
    assert [len(got[i]) for i in range(3)] == [2, 200_002, 0]
    assert len(np.unique(got[1])) == 3
    assert (dict(bytehash.word_hashes(["WORT x"]))[0][0] == got[1][0])
