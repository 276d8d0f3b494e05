"""Operators and pipeline stages against plain Python: a dictionary, a loop or a dense matrix in place of the method."""

import hashlib
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
import zstandard

from plumbline.llm import bytehash, chat, chunk_dedup, common, decontam, langid, mixing, quality, toxicity
from plumbline.llm import queries as llm

MASK = (1 << 32) - 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(v):
    if v is None or pd.isna(v):
        return None
    return f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_as_sql(spark, tiny, name):
    con = duckdb.connect()
    for f in os.listdir(tiny):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{tiny}/{f}'")
    rows_of = lambda f: sorted((tuple(plain(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False)), key=str)
    got = llm.queries()[name](spark, tiny).toPandas()
    want = con.execute(llm.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def bucket(chars, bits):
    h = 0x811C9DC5
    for c in chars:
        h = ((h ^ ord(c)) * 0x9E3779B1) & MASK
        h ^= h >> 15
    return ((h * 0x85EBCA77) & MASK) >> (32 - bits)


def letters_only(text):
    """Lower case, a blank for whatever follows a letter, blanks at either end."""
    low = text.replace("\0", " ").lower()
    return " " + "".join(c if c.isalpha() else " " for i, c in enumerate(low) if c.isalpha() or (i and low[i - 1].isalpha())) + " "


def grams(text, orders, bits):
    line, out = letters_only(text), {}
    for n in orders:
        for i in range(len(line) - n + 1):
            if n > 1 or line[i].isalpha():
                b = bucket(line[i : i + n], bits)
                out[b] = out.get(b, 0) + 1
    return out


SENTENCES = {"de": "der hund läuft über die straße und die katze schläft im haus", "en": "the dog walks over the street while a cat sleeps in the house", "fr": "le chien traverse la rue et le chat dort à la maison"}


def spoken(n=90, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SENTENCES))
        w = SENTENCES[lang].split()
        rows.append((i, " ".join(rng.choice(w) for _ in range(rng.randint(1, 25))) + rng.choice(["", "!", " 12?"]), lang if i % 8 else None, f"s{i % 3}", i))
    return rows


def naive_bayes(train, texts, p):
    counts, docs = {}, {}
    for text, lang in train:
        docs[lang] = docs.get(lang, 0) + 1
        c = counts.setdefault(lang, {})
        for b, n in grams(text, p.orders, p.bucket_bits).items():
            c[b] = c.get(b, 0) + n
    out = []
    for t in texts:
        if t is None or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        logs = {}
        for lang in sorted(counts):
            total = sum(counts[lang].values()) + p.smoothing * (1 << p.bucket_bits)
            logs[lang] = np.log(docs[lang] / sum(docs.values())) + sum(n * np.log((counts[lang].get(b, 0) + p.smoothing) / total) for b, n in grams(t, p.orders, p.bucket_bits).items())
        best = max(sorted(logs), key=lambda x: logs[x])
        out.append((best, 1 / sum(np.exp(v - logs[best]) for v in logs.values())))
    return out


def test_language_is_naive_bayes_by_dictionaries(spark, monkeypatch):
    rows = spoken()
    df = spark.createDataFrame(rows, SCHEMA)
    p = langid.LangParams(bucket_bits=12)
    model = langid.fit_language(df, p)
    texts = [r[1] for r in rows] + [None, "", "12 !?", "Ärger im HAUS", "x" * 400, "\0a\0b"]
    want = naive_bayes([(r[1], r[2]) for r in rows if r[2]], texts, p)
    for piece in (1 << 18, 40):  # long texts in pieces score the same
        monkeypatch.setattr(langid, "PIECE", piece)
        lang, score = langid.score_texts(texts, model)
        assert lang == [w[0] for w in want]
        assert np.allclose(score, [w[1] for w in want], atol=1e-5)
    got = {r.doc_id: (r.lang_pred, r.text) for r in langid.predict_language(df, model, keep=["text", "doc_id"]).collect()}
    assert got == {r[0]: (w[0], r[1]) for r, w in zip(rows, want)}
    none = langid.fit_language(df.limit(0), p)
    assert [r.lang_pred for r in langid.predict_language(df.limit(2), none, keep=["doc_id"]).collect()] == ["und", "und"]


def labelled(seed=6, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good, toxic = rng.random() < 0.5, rng.random() < 0.4
        w = ["".join(rng.choice("aeiolnrst") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(5, 40))]
        rows.append((i, " ".join(([x + "%%" for x in w] if not good else w) + (["idiot", "moron"] if toxic else [])), int(good), int(toxic)))
    return rows


def test_quality_is_two_plain_compressors(spark):
    df = spark.createDataFrame(labelled(), "doc_id long, text string, quality int, toxic int")
    model = quality.fit_quality(df, df)
    by = [zstandard.ZstdCompressor(level=model.params.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False) for d in (model.good, model.bad)]
    texts = [r[1] for r in labelled()] + [None, "", "é" * 5000, "a b " * 3000]
    ask = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score_quality(ask, model, keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        blocks = [raw[a : a + model.params.block] for a in range(0, len(raw), model.params.block)]
        diff = sum(len(by[1].compress(b)) - len(by[0].compress(b)) for b in blocks) / max(1, len(raw))
        z = float(np.dot(model.weights, [1, diff, diff * np.log2(1 + len(raw))]))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    assert got[len(texts) - 4] == got[len(texts) - 3]
    one = quality.fit_quality(df, df.where("quality = 1"))
    assert quality.score_quality(ask, one, keep=["doc_id"]).where("score < 0.9").count() == 0


def toxic_grams(text, p):
    line = " " + " ".join(text.lower().replace("\0", " ").split()) + " "
    return {bucket(line[i : i + n], p.bucket_bits) for n in p.orders for i in range(len(line) - n + 1)}


def test_toxicity_is_a_dense_presence_matrix(spark, monkeypatch):
    p = toxicity.ToxicParams(bucket_bits=11, rounds=40)
    rows = labelled()
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    model = toxicity.fit_toxicity(df, df, p)
    # the same fit on a dense matrix of presence
    order = sorted((r[3], np.array(sorted(toxic_grams(r[1], p)), np.int32).tobytes()) for r in rows)
    x = np.zeros((len(rows), 1 << p.bucket_bits))
    for i, (_, s) in enumerate(order):
        x[i, np.frombuffer(s, np.int32)] = 1
    y = np.array([k for k, _ in order], float)
    held = [x[y == k].sum(axis=0) + p.smoothing for k in (0, 1)]
    ratio = np.log(held[1] / held[1].sum()) - np.log(held[0] / held[0].sum())
    seen = (x.sum(axis=0) >= p.least_docs) & (np.abs(ratio) >= p.least_ratio)
    m = x * np.where(seen, ratio, 0)
    norm = np.sqrt((m**2).sum(axis=1).mean())
    m /= norm
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    w = ahead = np.zeros(m.shape[1])
    b = b_ahead = 0.0
    t = 1.0
    for _ in range(p.rounds):
        g = weight * (1 / (1 + np.exp(-(m @ ahead + b_ahead))) - y) / len(y)
        new, b_new, t_new = ahead - (m.T @ g + p.penalty * ahead), b_ahead - g.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, b_ahead = new + (t - 1) / t_new * (new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = new, b_new, t_new
    assert np.allclose(model.weights, np.where(seen, w * ratio / norm, 0), atol=1e-4) and model.bias == pytest.approx(b, abs=1e-4)
    long_text = " ".join(r[1] for r in rows) * 3
    texts = [r[1] for r in rows[:20]] + ["", None, long_text]
    want = [1 / (1 + np.exp(-np.clip(model.bias + sum(float(model.weights[k]) for k in toxic_grams(s or "", p)), -30, 30))) for s in texts]
    for piece in (1 << 18, 500):  # a text counts an n-gram once, however many pieces it is hashed in
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert np.allclose(toxicity.score_batch(texts, model), want, atol=1e-5)


def chunks_of(raw, p):
    """Chunks of one text by a rolling hash, a byte at a time."""
    table, h, out, last = bytehash.gear_table().tolist(), 0, [], 0
    ends = []
    for i, c in enumerate(raw):
        h = ((h << 1) + table[c]) & MASK
        at = i + 1
        if h < 1 << (32 - p.cut_bits) and at < len(raw) and raw[at] & 0xC0 != 0x80:
            ends.append(at)
    for end in [*ends, len(raw)]:
        while end - last > p.longest:
            cut = last + p.longest
            while raw[cut] & 0xC0 == 0x80 and cut > last + 1:
                cut -= 1
            out.append((last, cut))
            last = cut
        if end - last >= p.shortest or end == len(raw) > last:
            out.append((last, end))
            last = end
    return out


def shared_texts(seed=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé😀 ") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(14)]
    texts += [texts[0], texts[1] + passage, passage + texts[2], texts[3][:200] + passage + texts[3][200:], passage, "", None, "z" * 3000, "z" * 3000]
    return [(i, t, None, None, None) for i, t in enumerate(texts)]


def test_chunk_dedup_is_chunk_by_chunk(spark):
    p, rows = chunk_dedup.ChunkParams(), shared_texts()
    raws = {i: (t or "").encode() for i, t, *_ in rows}
    first = {}
    for i in sorted(raws):
        for a, b in chunks_of(raws[i], p):
            first.setdefault(raws[i][a:b], (i, a))
    got = {r.doc_id: r for r in chunk_dedup.dedup_chunks(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, raw in raws.items():
        runs = []
        for a, b in chunks_of(raw, p):
            if first[raw[a:b]] != (i, a):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        runs = [(a, b) for a, b in runs if b - a >= p.least_run]
        kept = chunk_dedup.without(raw, runs)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept, got[i].kept_sha256) == (len(raw), sum(b - a for a, b in runs), len(runs), kept.decode(), hashlib.sha256(kept).hexdigest())
    assert sum(r.n_removed for r in got.values()) > 5000


def test_decontamination_catches_copies_in_any_case(spark):
    item = "The Old Clock In Bern Was Sold To Anna For 300 euros by Max And 12 More people"
    dense = "Ann 3 kg Bob 4 km Cid 5 ml Dan 6 mm Eve 7 mg"
    short = "Tell me of 7 seas"
    bench = spark.createDataFrame([(1, item), (2, dense), (3, short)], "item_id long, text string")
    around = lambda t: f"some words stand before it {t} and others after it"
    docs = spark.createDataFrame([(1, around(item.lower())), (2, around(item.upper())), (3, around(dense.lower())), (4, around(short)), (5, short), (6, "tell me of"), (7, around("nothing of the kind is here at all today"))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 3), (5, 3)}


def test_chat_ignores_a_clashing_parts_column(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi", "clash"), (1, 1, "assistant", None, None)], "conv_id long, turn long, role string, text string, parts string")
    assert [r.formatted for r in chat.format_conversations(df).collect()] == ["### user: hi</turn>\n### assistant: </turn>\n"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_mixing_repeated_rows_agree(spark):
    rows = [(i % 40, "w " * (1 + i % 40 * 7 % 30), None, "ab"[i % 40 % 2], None) for i in range(800)]
    p = mixing.MixParams(block_rows=50, most_repeats=1.5)
    take = lambda df: sorted(map(str, mixing.mix(df, p).collect()))
    df = spark.createDataFrame(rows, SCHEMA)
    assert take(df) == take(df.repartition(5))


def test_pipeline_stages_are_brute_force(spark, tmp_path):
    """Each stage on odd rows: nulls, repeats, an id with two texts, and a benchmark passage."""
    import corpus_pipeline as C

    item = "Tom bought 12 apples for 3 euros at the old market near the river and then sold them all again"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spoken(60)
    rows += [(100, None, "en", "s", 0), (101, "", None, None, None), (102, "12 !?", "en", "s", 1), (3, rows[4][1] + " more of it here", "en", "s", 5), rows[5], (None, rows[6][1], None, None, None), (103, "the house " + item + " the dog", "en", "s9", 7)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", extra string")
    sure = naive_bayes([(r[1], r[2]) for r in rows if r[1] is not None and r[2]], [r[1] for r in rows], langid.LangParams())
    one = C.identify_language(spark, docs, str(tmp_path))
    assert one.columns == C.COLUMNS
    got = sorted((tuple(r) for r in one.collect()), key=str)
    assert got == sorted((r for r, (lang, score) in zip(rows, sure) if lang != "und" and score >= C.LEAST_SCORE), key=str)

    two = C.drop_near_duplicates(spark, one, str(tmp_path)).collect()
    ids = [r.doc_id for r in two if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in two) == 1
    three_rows = [r for r in rows if r[0] == 3]
    assert [tuple(r) for r in two if r.doc_id == 3] in ([], [min(three_rows, key=lambda r: r[1:])])

    long = shared_texts()
    cut = {r.doc_id: r for r in C.cut_repeated_chunks(spark, spark.createDataFrame(long, SCHEMA), str(tmp_path)).collect()}
    direct = {r.doc_id: r for r in chunk_dedup.dedup_chunks(spark.createDataFrame(long, SCHEMA)).collect()}
    for i, t, *_ in long:
        r = direct[i]
        if r.n_removed and not r.kept.strip():
            assert i not in cut
        else:
            assert cut[i].text == (None if t is None else r.kept) and cut[i].n_chars == (len(r.kept) if r.n_removed else None)

    left = C.decontaminate(spark, docs.select(*C.COLUMNS), str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in left) == sorted(str(r) for r in rows if r[0] != 103)
    mixed = C.mix_sources(spark, docs, str(tmp_path)).collect()
    every = mixing.mix(docs).collect()
    assert sorted(map(str, mixed)) == sorted(str(r) for r in every if r.taken > 0) and len(mixed) < len(every)
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0).select(*C.COLUMNS), str(tmp_path)).count() == 0, name


def test_odd_values(spark):
    """What each operator gives for null, empty and repeated rows, by value."""
    rows = [(1, None, None, None, None), (2, "", None, "s", None), (3, "one two three four five six", None, "s", None), (3, "one two three four five six", None, "s", None), (None, "one two three four five six", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    from plumbline.llm import fingerprint, ngram_join, suffix_dedup

    joined = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in ngram_join.near_duplicates(df).collect())
    assert joined == [("1", 0, "1", 0), ("2", 0, "2", 0), ("3", 2, "3", 0), ("3", 2, "3", 0), ("None", 2, "None", 0)]
    assert all((r.n_removed, r.n_spans) == (0, 0) for r in suffix_dedup.remove_repeats(df).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.kept_sha256 for r in chunk_dedup.dedup_chunks(df).where("doc_id in (1, 2)").collect()} == {empty}
    prints = {str(r.doc_id): r.fingerprint for r in fingerprint.fingerprint_edits(df).collect()}
    assert prints["1"] == prints["2"] and prints["3"] == prints["None"] != prints["1"]
    sizes = {(str(r.doc_id), r.source): (r["size"], r.source_size) for r in mixing.mix(df).collect()}
    assert sizes == {("1", None): (0, 6), ("2", "s"): (0, 12), ("3", "s"): (6, 12), ("None", None): (6, 6)}


def test_written_tables_are_discarded(spark):
    out = common.written(spark.range(5).toDF("x"), "t")
    path = out.written_path.removeprefix("file://")
    assert os.path.exists(path) and out.count() == 5
    common.discard(out)
    assert not os.path.exists(path)
    assert len(xxhash.xxh3_128_digest(b"")) == 16
