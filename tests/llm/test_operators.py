"""Each operator against a brute-force version, a round trip or held-out labels, with nulls, repeats, empty and long texts."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat, common, decontaminate, jaccard, language, merkle, packing, queries, repair, resampling, superkmers, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tokenizer():
    return queries.tokenizer()


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randint(0, vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    shared = words(rnd, 70)
    rows = [" ".join(words(rnd, rnd.randint(0, 200))) for _ in range(30)]
    for i in range(0, 12, 3):
        base = words(rnd, 120)
        edit = list(base)
        edit[rnd.randint(0, 119)] = "changed"
        rows += [" ".join(base), " ".join(edit), " ".join(base)]
    rows += [" ".join(words(rnd, 20) + shared + words(rnd, 20)) for _ in range(4)]
    rows += [None, "", " \t\n", "one two", "One TWO", "x" * 5000, "é" + "ÀB c" * 300, " ".join(words(rnd, 6000))]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 % 101, t, "en", "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id at all", None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- shared helpers -------------------------------------------------------------------------------------------


def test_encoder_equals_whole_text_encoding(tokenizer):
    odd = ["a  b \n c d ½3 x² naïve. café, ÷. <|endoftext|> it's don’t 日本語 。", "", "Ä.ö;ü:ß!", " lead", "tail ", "a\x1c b  c　d", "x.y,z  ,", "a" * 4000, "é, à.", "\n\n x", "1 2 3.4"]
    rnd = random.Random(3)
    odd += ["".join(rnd.choice("ab .,é×÷\n'1À ") for _ in range(80)) for _ in range(300)]
    enc = common.TokenEncoder(tokenizer)
    ids, ends = enc.encode(pa.array(odd))
    want = [x.ids for x in enc.tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == want
    again, _ = enc.encode(pa.array(odd))  # from the table
    assert (again == ids).all()


def thue_morse(n, a="a", b="b"):
    """Two strings of n characters that a polynomial hash modulo a power of two can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join((a, b)[x ^ flip] for x in bits) for flip in (0, 1)]


def test_hashes_of_thue_morse_words_differ(tokenizer):
    enc = common.TokenEncoder(tokenizer)
    for n in (64, 1024, 2048, 4096):
        pair = thue_morse(n)
        raw, at = common.text_bytes(pa.array(pair))
        assert len(set(common.span_hashes(raw, at[:-1], at[1:]).tolist())) == 2
        ids, ends = enc.encode(pa.array(pair))
        assert [ids[: ends[0]].tolist(), ids[ends[0] :].tolist()] == [x.ids for x in enc.tokenizer.encode_batch(pair, add_special_tokens=False)]


def test_word_spans_and_hashes():
    raw, at = common.text_bytes(pa.array(["ab c", None, "", "d  eé\n", "ab"]))
    starts, ends, first = common.word_spans(raw, at)
    assert [bytes(raw[s:e]).decode() for s, e in zip(starts, ends)] == ["ab", "c", "d", "eé", "ab"]
    assert first.tolist() == [0, 2, 2, 2, 4, 5]
    h = common.span_hashes(raw, starts, ends)
    assert h[0] == h[4] and len(set(h.tolist())) == 4


# ---- 1 WARC ---------------------------------------------------------------------------------------------------


def test_warc_round_trip_with_revisits(spark):
    pages = [(3, "http://a/é x", "<p>one</p>"), (1, "http://b", "<p>one</p>"), (2, None, None), (5, "http://c", ""), (9, "u", "<p>é" + "long " * 50000), (None, "n", "<p>one</p>"), (7, "z", "lone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read(warc.normalise(warc.write(df, roll_bytes=2000))).collect()}
    assert len(got) == len(pages)
    for page_id, _, html in pages:
        body = (html or "").encode()
        want = {1: None, 3: 1, None: 1, 2: None, 5: 2}.get(page_id)
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.refers_to, r.record_type) == (want, "revisit" if want else "response")
    assert warc.read(warc.normalise(warc.write(df.limit(0)))).count() == 0


def test_warc_members_stand_alone_and_cut_streams_fail():
    blob = b"".join(warc.record(i, "u", b"x" * i, None, "d") for i in range(5))
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = whole.compress(blob) + whole.flush()
    assert len(list(warc.records(io.BytesIO(packed)))) == 5
    assert len(list(warc.records(io.BytesIO(packed + packed)))) == 10
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(io.BytesIO(packed[:-12])))


# ---- 2 decontamination ----------------------------------------------------------------------------------------


def brute_hits(text, items):
    import regex

    cut = lambda t: regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = cut(text), set(), set()
    for item_id, item in items:
        b = cut(item)
        n = min(13, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(item_id))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination(spark, docs, texts, limit):
    items = [(1, " ".join(texts[2].split()[:40])), (2, "one two"), (10, texts[3][:120].upper()), (4, None), (5, ""), (6, "ÀB c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.report(docs, bench, broadcast_windows=limit).collect()), key=repr)
    want = []
    for r in docs.collect():
        n, hit, found = brute_hits(r.text, items)
        want.append((r.doc_id, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert got == sorted(want, key=repr)
    left = decontaminate.remove(docs, bench, broadcast_windows=limit)
    assert left.columns == docs.columns and left.count() == sum(not r[5] for r in want)
    spans = decontaminate.remove(docs, bench, "spans", broadcast_windows=limit)
    assert spans.count() == docs.count() and spans.where("text = 'One TWO' or text = 'one two'").count() == 0
    if not limit:
        plan = decontaminate.hits(docs, bench, broadcast_windows=0)._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.split("\n") if "Exchange" in x and "words" in x]


def test_decontamination_empty(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs, bench).where("n_hit > 0").count() == 0
    assert decontaminate.report(empty, bench).count() == 0


# ---- 3 fingerprints -------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, empty):
    got = merkle.compare_edits(docs).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()), reverse=True)
    want = []
    for i, (_, doc_id, text) in enumerate(rows):
        k = len(text) // 3
        want.append((len(text), hashlib.sha256((text[: len(text) - k] + rows[(i + 1) % len(rows)][2][:k]).encode()).hexdigest()))
    assert sorted((r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long])
    prints = merkle.fingerprints(docs).collect()
    by_text = {}
    for r in docs.join(spark.createDataFrame(prints), "doc_id").collect():
        by_text.setdefault(r.text or "", set()).add(r.fingerprint)
    assert len({x for s in by_text.values() for x in s}) == len(by_text)
    assert merkle.compare_edits(empty).count() == 0


def test_differing_branches_locate_an_edit(spark):
    rnd = random.Random(12)
    rows = [("a\nb\nc\nd", "a\nB\nc\nd"), ("", ""), ("x", ""), ("same\ntext", "same\ntext")]
    for _ in range(30):
        lines = [f"line {rnd.randint(0, 10**9)}" for _ in range(rnd.randint(1, 60))]
        changed = [f"{x} new" if rnd.random() < 0.1 else x for x in lines]
        rows.append(("\n".join(lines), "\n".join(changed)))
    old, new = (spark.createDataFrame([(i, r[k]) for i, r in enumerate(rows)], "doc_id long, text string") for k in (0, 1))
    for r in merkle.edits(old, new).collect():
        x, y = (t.split("\n") for t in rows[r.doc_id])
        assert r.went == [i for i, t in enumerate(x) if t not in y] and r.came == [i for i, t in enumerate(y) if t not in x]


def test_buckets_are_even_whatever_the_ids(spark):
    df = spark.range(2000).selectExpr("if(id = 0, 1L << 61, if(id % 500 = 1, null, id)) as doc_id")
    sizes = {r.b: r["count"] for r in df.groupBy(merkle.buckets(df, 16).alias("b")).count().collect()}
    assert sizes.pop(-1) == 4 and 14 <= len(sizes) <= 17 and max(sizes.values()) < 300
    order = df.where("doc_id is not null").orderBy("doc_id").select(merkle.buckets(df, 16).alias("b")).collect()
    assert [r.b for r in order] == sorted(r.b for r in order)


# ---- 4 token files --------------------------------------------------------------------------------------------


def test_token_files(docs, empty, tokenizer):
    tk = common.TokenEncoder(tokenizer).tokenizer
    manifest = repair.write(docs, tokenizer, shard_tokens=3000)
    assert manifest.count() > 1
    got = sorted(map(tuple, repair.read(manifest).collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.collect()))
    start, want = 0, []
    for known, doc_id, _, text in rows:
        ids = [*tk.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert repair.read(repair.write(empty, tokenizer)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    docs = [np.append(rng.zipf(1.3, rng.integers(0, 400)) % (900 if seed % 2 else 4) + 3, 2).astype(np.uint32) for _ in range(60)]
    ids = np.concatenate(docs)
    symbols, rules, sizes, first = repair.compress(ids, 2)
    assert len(symbols) < len(ids) and (repair.expand(symbols, rules, sizes, first) == ids).all()
    assert all(len(repair.expand(np.array([first + r], np.uint32), rules, sizes, first)) == sizes[r] for r in range(len(rules)))
    for lo, hi in rng.integers(0, len(ids), (30, 2)).tolist():
        assert (repair.expand(symbols, rules, sizes, first, lo, hi) == ids[lo:hi]).all()
    pairs: dict = {}  # places of each pair, none of which overlap
    for i, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist())):
        if 2 not in pair and (pair not in pairs or pairs[pair][-1] + 1 < i):
            pairs.setdefault(pair, []).append(i)
    assert all(len(x) == 1 for x in pairs.values())
    used = np.bincount(np.concatenate((symbols.astype(int), rules.reshape(-1).astype(int))), minlength=first + len(rules))
    assert (used[first:] > 1).mean() > 0.5 and (used[first:] > 0).all()


def test_grammar_of_runs_and_small_sequences():
    for ids in ([], [2], [5, 2], [5, 5, 2], [5, 5, 5, 2], [5] * 4 + [2], [5] * 1000 + [2], [7, 8, 7, 8, 7, 2, 2, 8, 7, 2]):
        symbols, rules, sizes, first = repair.compress(np.array(ids, np.uint32), 2)
        assert repair.expand(symbols, rules, sizes, first).tolist() == ids


def test_shards_give_any_range_of_tokens(spark, docs, tokenizer):
    for row in repair.write(docs, tokenizer, shard_tokens=9000).collect():
        shard = repair.Shard(row.file, row.offset)
        whole = shard.ids(0, row.tokens)
        assert len(whole) == row.tokens == shard.tokens[-1] and len(shard.section("sequence")) == row.symbols
        for lo, hi in ((0, 1), (row.tokens - 1, row.tokens), (row.tokens // 3, row.tokens // 2), (5, 5)):
            assert (shard.ids(lo, hi) == whole[lo:hi]).all()
        shard.close()


def test_token_ids_are_those_of_the_plain_call(spark, tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    texts = ["a <|endoftext|> b", "foo  <|endoftext|>  bar.<|endoftext|>,", *thue_morse(2048), "<|endoftext|", None, "x" * 100_000 + " y"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    files = {r.doc_id: r for r in repair.read(repair.write(df, tokenizer)).collect()}
    packed = {}
    for r in packing.pack(df, tokenizer, capacity=1 << 20).collect():
        packed[r.doc_id] = r
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids
        for r, end, n in ((files[i], 2, "n_tokens"), (packed[i], 0, "length")):
            assert r[n] == len(ids) + 1 and r.ids_crc32 == zlib.crc32(np.array([*ids, end], "<u4").tobytes())


# ---- 5 resampling ---------------------------------------------------------------------------------------------


def test_resampling(spark, empty):
    rnd = random.Random(9)
    good, bad = [f"g{i}" for i in range(200)], [f"b{i}" for i in range(50)]
    rows = [(i, " ".join(rnd.choices(bad if i % 4 == 0 else good, k=60)), "en", "s", 0) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    got = resampling.resample(df, labels, keep=0.75).collect()
    assert len(got) == 300 and sum(r.doc_id % 4 > 0 for r in got) == 300
    none = labels.limit(0)
    assert resampling.resample(df, none, keep=0.1).count() == 40
    assert resampling.resample(empty, labels).count() == 0


def brute_weights(rows, good, smoothing=5.0, bits=resampling.BITS):
    """Log ratio of every text's words and word pairs, from counts in plain dictionaries over the same buckets."""
    import regex

    def ngrams(text):
        w = [x.encode() for x in regex.findall(r"[0-9A-Za-z\u0080-\U0010FFFF]+", text or "")]
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
        raw = np.frombuffer(b" ".join(w), np.uint8)
        ends = np.cumsum([len(x) + 1 for x in w]) - 1 if w else np.zeros(0, int)
        h = [int(x) for x in common.span_hashes(raw, ends - [len(x) for x in w] if w else ends, ends)]
        pairs = [int(common.mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % (1 << 64)], np.uint64))[0]) for a, b in zip(h, h[1:])]
        return [x >> (64 - bits) for x in h + pairs]

    raw, target = {}, {}
    for doc_id, text in rows:
        for x in ngrams(text):
            raw[x] = raw.get(x, 0) + 1
            target[x] = target.get(x, 0) + (doc_id in good)
    share = sum(target.values()) / max(sum(raw.values()), 1)
    return [sum(np.log((target[x] + smoothing) / (raw[x] * share + smoothing)) for x in ngrams(t)) for _, t in rows]


def test_resampling_weights(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(("Alpha", "beta", "gämma", "7", "x-y", "z.")) for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    rows += [(60, None), (60, ""), (None, "Alpha beta"), (None, None), (5, rows[5][1])]
    labels = [(i, i % 2, None if i % 3 else 0) for i in range(40)] + [(3, 0, 0), (5, 1, 1), (None, 1, 0)]
    good = {i for i in range(40) if i % 2} - {3, 5}
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ratio = resampling.log_ratio(df, marks)
    got = sorted((r.doc_id is None, r.doc_id or 0, round(r.log_weight, 4)) for r in resampling.weights(df, ratio).collect())
    assert got == sorted((i is None, i or 0, round(float(w), 4)) for (i, _), w in zip(rows, brute_weights(rows, good)))
    kept = resampling.resample(df, marks, keep=0.5).collect()
    keys = sorted((r.key for r in resampling.weights(df, ratio).collect()), reverse=True)
    assert sorted((r.key for r in kept), reverse=True) == keys[: -(-len(rows) // 2)]


def test_top_k_with_ties(spark):
    df = spark.createDataFrame([(i, 0.0, float(i // 10)) for i in range(100)] + [(None, 0.0, 5.0)], "doc_id long, log_weight double, key double")
    for k in (0, 1, 5, 10, 37, 46, 101):
        got = sorted((-r.key, r.doc_id is None, r.doc_id) for r in resampling.top_k(df, k, bins=4).collect())
        want = sorted((-r.key, r.doc_id is None, r.doc_id) for r in df.collect())[:k]
        assert got == want


# ---- 6 super-k-mers -------------------------------------------------------------------------------------------


def brute_removal(rows, width):
    first = {}
    for did, text in rows:
        w = text.encode().split()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, did), did)
    out = []
    for did, text in rows:
        w, gone = text.encode().split(), set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < did:
                gone.update(range(i, i + width))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((None if did == superkmers.LAST else did, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup(docs, empty, hot):
    rows = [(superkmers.LAST if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()]
    got = sorted(map(tuple, superkmers.removal(docs, hot=hot).collect()), key=repr)
    want = sorted(brute_removal(rows, 50), key=repr)
    assert got == want and sum(r[2] for r in got) > 300
    clean = superkmers.deduplicate(docs, hot=hot)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert superkmers.removal(empty).count() == 0


# ---- 7 language -----------------------------------------------------------------------------------------------


def test_language(spark, empty):
    rnd = random.Random(2)
    make = {"aa": "abcd", "bb": "wxyz"}
    rows = [(i, " ".join("".join(rnd.choices(make[x], k=5)) for _ in range(10)), x, "s", 0) for i, x in enumerate(["aa", "bb"] * 60)]
    rows += [(1000, None, "aa", None, None), (1001, "12 34 !", "bb", None, None), (None, "wxyz wxyz", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in language.identify(df, "doc_id", "lang").collect()}
    assert all(r.lang_pred == r.lang and r.score > 0.9 for i, r in got.items() if i is not None and i < 1000)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[None].lang_pred == "bb"
    assert language.identify(empty, "doc_id").count() == 0
    assert {r.lang_pred for r in language.predict(df, language.train(empty), "doc_id").collect()} == {"und"}


def brute_language(train, texts, smoothing=0.05, evidence=60, bits=17):
    """Multinomial naive Bayes over the same hashed n-grams, counted one by one."""

    def ngrams(text):
        chars, gap = [" "], True
        for c in (text or "").lower():
            if c.isalpha():
                chars.append(c)
                gap = False
            elif not gap:
                chars.append(" ")
                gap = True
        if not gap:
            chars.append(" ")
        out = []
        for n in language.SIZES:
            for i in range(len(chars) - n + 1):
                if n == 1 and chars[i] == " ":
                    continue
                h = 0
                for c in chars[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
                out.append(int(common.mix(np.array([(h + n) % (1 << 64)], np.uint64))[0]) >> (64 - bits))
        return out

    langs = sorted({x for _, x in train})
    counts = {x: np.full(1 << bits, smoothing) for x in langs}
    for text, x in train:
        np.add.at(counts[x], ngrams(text), 1)
    prior = {x: np.log(sum(y == x for _, y in train) / len(train)) for x in langs}
    found = []
    for text in texts:
        grams = ngrams(text)
        if not any(c.isalpha() for c in text or ""):
            found.append(("und", 0.0))
            continue
        score = np.array([sum(np.log(counts[x][g] / counts[x].sum()) for g in grams) * evidence / max(len(grams), evidence) + prior[x] for x in langs])
        found.append((langs[int(score.argmax())], float(1 / np.exp(score - score.max()).sum())))
    return found


def test_language_equals_plain_bayes(spark, monkeypatch):
    monkeypatch.setattr(language, "STRETCH", 64)  # n-grams cross stretches
    rnd = random.Random(7)
    make = {"aa": ["der", "die", "und", "nicht"], "bb": ["the", "and", "not", "der"], "cc": ["le", "et", "été", "nicht"]}
    texts = [(i, " ".join(rnd.choices(make[x], k=rnd.randint(1, 40))) + rnd.choice(("", "!", " 12.")), x) for i, x in enumerate(["aa", "bb", "cc", "bb"] * 15)]
    texts += [(90, None, "aa"), (91, "", None), (92, "É", None), (93, "x" * 3000 + " the and", "bb"), (None, "le et", "cc"), (3, texts[3][1], "bb")]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    learn = [(t, x) for i, t, x in texts if i is not None and zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and x is not None]
    got = sorted(((r.text is None, r.text or "", r.lang_pred, round(r.score, 3)) for r in language.identify(df, "text").collect()))
    want = brute_language(learn, [t for _, t, _ in texts])
    assert got == sorted((t is None, t or "", x, round(p, 3)) for (_, t, _), (x, p) in zip(texts, want))


# ---- 8 packing ------------------------------------------------------------------------------------------------


def test_packing(docs, empty, tokenizer):
    tk = common.TokenEncoder(tokenizer).tokenizer
    got = packing.pack(docs, tokenizer, capacity=256).collect()
    place = {}
    for r in got:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in place.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 256
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        ids = [*tk.encode(r.text or "", add_special_tokens=False).ids, 0]
        pieces = {p.piece: p for p in by_doc[r.doc_id]}
        assert sum(p.length for p in pieces.values()) == len(ids) and len(pieces) == -(-len(ids) // 256)
        for p in pieces.values():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert packing.pack(empty, tokenizer).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_equals_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    lengths = sorted((rnd.randint(1, 64) for _ in range(500)), reverse=True)
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins = []
    for n in lengths:
        fit = [i for i, left in enumerate(bins) if left >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(64 - n)
    p = packing.plan(counts, 64)
    filled: dict = {}  # every slot of the plan, as ranks take it
    for i in range(len(p["length"])):
        length, lo, per, sequence, offset = (int(p[x][i]) for x in ("length", "from", "per", "sequence", "offset"))
        same = p["from"][p["length"] == length]
        hi = min([int(x) for x in same if x > lo], default=counts[length])
        for k in range(hi - lo):
            filled.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
    assert len(filled) == len(bins) and sum(map(len, filled.values())) == len(lengths)
    for slots in filled.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_of_repeated_and_missing_ids(spark, tokenizer):
    tk = common.TokenEncoder(tokenizer).tokenizer
    rows = [(1, "a b c"), (1, "a b c"), (None, "x y"), (None, None), (2, "word " * 40), (1, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, tokenizer, capacity=16).collect()
    want = [(i, len(tk.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows]
    assert sum(r.length for r in got) == sum(n for _, n in want)
    assert sorted((str(r.doc_id), r.piece) for r in got) == sorted((str(i), k) for i, n in want for k in range(-(-n // 16)))


# ---- 9 chat ---------------------------------------------------------------------------------------------------


def test_chat(spark, tokenizer):
    control = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "system", "rules"), (1, 1, "user", "hi " * 40), (1, 2, "assistant", "yes " * 40), (1, 3, "user", "<||x<|"), (1, 4, "assistant", control), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "od\nd\\n", "é<"), (3, 1, "assistant", "b" * 9000), (None, 0, "assistant", "n"), (4, None, "user", "t"), (4, None, "user", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget in (40, 100, 4096):
        windows = chat.format_windows(df, tokenizer, budget, 30)
        got = {r.conv_id: r for r in chat.digest(windows).collect()}
        for conv, turns in itertools.groupby(rows, key=lambda r: r[0]):
            turns = list(turns)
            loss = "".join(t or "" for _, _, role, t in turns if role == "assistant")
            r = got[conv]
            assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
            assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t or ''}\n" for _, _, role, t in turns).encode()).hexdigest()
        later = [w for w in windows.collect() if w.conv_id == 1 and w.window]
        assert all(chat.parse(w.text)[0] == ("system", "rules") for w in later if w.context)
        assert all(w.tokens <= budget or w.turns == 1 and not w.context for w in windows.collect())
    assert chat.digest(chat.format_windows(df.limit(0), tokenizer)).count() == 0


def test_chat_windows_hold_the_budget(spark, tokenizer):
    rnd = random.Random(8)
    enc = common.TokenEncoder(tokenizer)
    rows = [(c, t, "system" if t == 0 else ("user", "assistant")[t % 2], f"turn {c} {t} " + "word " * rnd.randint(0, 150)) for c in range(8) for t in range(25)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    size = lambda text: len(enc.encode(pa.array([text]))[0])
    for budget in (60, 300, 500):
        found = sorted(chat.format_windows(df, tokenizer, budget, 200).collect(), key=lambda w: (w.conv_id, w.window))
        new = [(w.conv_id, t) for w in found for t in chat.parse(w.text)[w.context :]]
        assert new == [(c, (role, text)) for c, _, role, text in rows]
        for w, after in zip(found, found[1:]):
            assert w.tokens == size(w.text) and (w.tokens <= budget or w.turns == 1 and not w.context)
            if after.conv_id == w.conv_id:  # the next turn would not have fitted beside the system turn and the new ones
                role, text = chat.parse(after.text)[after.context]
                turn = f"{chat.START}{role}\n{text}{chat.END}\n"
                own = chat.parse(w.text)
                must = [x for i, x in enumerate(own) if i >= w.context or w.turns > 1 or x[0] == "system"]
                assert size("".join(f"{chat.START}{r}\n{t}{chat.END}\n" for r, t in must)) + size(turn) > budget
    wide = [w.turns for w in found]
    assert np.mean(wide) > 1.5


# ---- 10 Jaccard -----------------------------------------------------------------------------------------------


def brute_components(rows, k=5):
    found = {}
    for did, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        found.setdefault(did, []).append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    label = {d: d for d in found}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(found, 2):
            if label[a] != label[b] and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in found[a] for y in found[b]):
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_jaccard(docs, empty):
    got = jaccard.near_copies(docs).collect()
    assert len(got) == docs.count()
    want = brute_components([(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()])
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    left = jaccard.representatives(docs)
    assert {r.doc_id for r in left.where("doc_id is not null").collect()} == {d for d, c in want.items() if d == c}
    assert jaccard.near_copies(empty).count() == 0


def test_jaccard_chains_of_edits(spark):
    rnd = random.Random(4)
    rows, base = [], words(rnd, 100)
    for i in range(60):
        base[rnd.randint(0, 99)] = f"n{i}"
        rows.append((i, " ".join(base), "en", "s", 0))
    rnd.shuffle(rows)
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_components([r[:2] for r in rows])


def test_jaccard_rows_that_repeat_an_id_keep_all_their_links(spark):
    rnd = random.Random(6)
    a, b = words(rnd, 100), words(rnd, 100, 10_000)
    near = [*b[:-1], "other"]
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in ((1, a), (5, a), (5, b), (9, near), (7, []), (5, []))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_copies(spark.createDataFrame(rows, DOCS)).collect())
    assert [x[::2] for x in got] == [(1, 1), (5, 1), (5, 1), (5, 1), (7, 7), (9, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_with_hot_keys_split(spark, monkeypatch, seed):
    """Every key counts as hot: tokens in parts, pivots split, joins by broadcast."""
    for module, name, value in ((jaccard, "FULL", 2), (jaccard, "SPLIT", 2), (common, "HOT_ROWS", 1)):
        monkeypatch.setattr(module, name, value)
    rnd = random.Random(seed)
    bases = [words(rnd, rnd.randint(3, 90), 30) for _ in range(8)]
    rows = []
    for i in range(150):
        text = list(rnd.choice(bases)) + words(rnd, rnd.randint(0, 4), 30)
        for _ in range(rnd.randint(0, 3)):
            text[rnd.randrange(len(text))] = f"e{rnd.randint(0, 5)}"
        rows.append((rnd.randint(0, 120) if i % 3 else i, " ".join(text), "en", "s", 0))
    got = jaccard.near_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == brute_components([r[:2] for r in rows])


def test_words_made_to_collide_stay_apart(spark):
    """A 64-bit hash that takes eight bytes after the other can be mended by the last eight."""
    rows = [(1, "abcdefghijklmnop a b c d"), (2, "zzzadocuwr#n0\\^j a b c d"), (3, "zzzadocuwr#n0\\^j a b c d abcdefghijklmnop a b c d")]
    raw = np.frombuffer(b"".join(t.split()[0].encode() for _, t in rows[:2]), np.uint8)
    one, two = common.span_digests(raw, np.array([0, 16]), np.array([16, 32]))
    assert one[0] != one[1] and two[0] != two[1]
    got = jaccard.near_copies(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 2), (3, 6, 3)]


def test_sets_whose_tokens_collide_are_compared_by_both_halves(monkeypatch):
    plain = common.span_digests
    monkeypatch.setattr(jaccard, "span_digests", lambda *x: (np.zeros(len(x[1]), np.uint64), plain(*x)[1]))
    token, other, end = jaccard.sets(pa.array(["a b c d e f g", "a b c d e x y", "a b c d e a b c d e", None, "one"]))
    assert end.tolist() == [3, 6, 11, 11, 12] and len(set(token.tolist())) == 1
    one, two = ((token[a:b], other[a:b]) for a, b in ((0, 3), (3, 6)))
    assert jaccard.common_size(one, two) == 1 and jaccard.common_size(one, one) == 3


@pytest.mark.parametrize("sent", [0, 8 << 20])
def test_frequent_keys_are_joined_in_parts_or_by_broadcast(spark, monkeypatch, sent):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "SENT_BYTES", sent)
    many = common.materialise(spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)], "k int, i int").repartition(3), "many")
    one = spark.createDataFrame([(k, [k] * 5, f"t{k}") for k in range(5)], "k int, more array<int>, t string")
    assert sorted(map(tuple, common.join_each(many, one, ["k"]).select("k", "i", "t").collect())) == sorted((k, i, f"t{k}") for k, i in map(tuple, many.collect()) if k < 5)


def test_hundreds_of_languages(spark):
    rnd = random.Random(12)
    names = [f"l{i:03}" for i in range(200)]
    lexicon = {x: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for x in names}
    rows = [(i, " ".join(rnd.choice(lexicon[x]) for _ in range(30)), x, "s", 0) for i, x in enumerate(names * 3)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.train(docs)
    assert model.log_prob.shape == (200, 1 << 16)
    got = language.predict(docs, model, "doc_id", "lang").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(rows)


# ---- columns of the operators' own names ----------------------------------------------------------------------


CLASH = ["lang_pred", "score", "_gone", "_runs", "_did", "_th", "_id", "_hash", "_spans", "words", "size", "bucket", "digest", "salt", "key", "task", "rank", "held_out", "TARGET", "at", "n", "hash", "label", "token"]


def clashing(df):
    for i, name in enumerate(CLASH):
        df = df.withColumn(name, F.lit(i))
    return df


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_columns_of_any_name_pass_through(spark, tokenizer):
    rnd = random.Random(13)
    base = words(rnd, 80)
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(words(rnd, 30)), None, "", "zzz " * 60, " ".join(words(rnd, 20) + base[:60])]
    plain = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*texts, texts[0]])], DOCS)
    bench = spark.createDataFrame([(1, "zzz zzz"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    wide = clashing(plain)
    for run in (
        lambda d: decontaminate.report(d, clashing(bench) if d is wide else bench),
        merkle.compare_edits,
        lambda d: repair.read(repair.write(d, tokenizer)),
        lambda d: resampling.resample(d, clashing(labels) if d is wide else labels),
        superkmers.removal,
        lambda d: language.identify(d, "doc_id"),
        lambda d: packing.pack(d, tokenizer).drop("sequence_id", "offset"),
        jaccard.near_copies,
    ):
        assert rows_of(run(wide)) == rows_of(run(plain))
    for keep in (lambda d: decontaminate.remove(d, bench), lambda d: decontaminate.remove(d, bench, "spans"), superkmers.deduplicate, jaccard.representatives, language.keep_known):
        got = keep(wide)
        assert got.columns == wide.columns
        assert rows_of(got.select(*plain.columns)) == rows_of(keep(plain))
        assert all(list(r) == list(range(len(CLASH))) for r in got.select(*CLASH).collect())


def test_pages_and_turns_with_columns_of_any_name(spark, tokenizer):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (2, "u", "a"), (3, None, None)], "page_id long, url string, html string")
    extra = lambda df: df.withColumns({x: F.lit(1) for x in ("digest", "size", "salt", "first", "hot", "refers_to", "window", "loss", "context")})
    run = lambda df: warc.read(warc.normalise(warc.write(df)))
    assert rows_of(run(extra(pages))) == rows_of(run(pages))
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert rows_of(chat.format_and_read(extra(turns), tokenizer)) == rows_of(chat.format_and_read(turns, tokenizer))


def test_warc_repeated_rows_and_hot_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_ROWS", 2)
    pages = [(i, f"http://{i}", "same" if i % 2 else f"page {i // 4}") for i in range(40)] + [(7, "http://7", "same"), (7, "http://7", "same"), (None, None, "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    first: dict = {}
    for i, _, html in pages:
        if i is not None:
            first[html] = min(first.get(html, i), i)
    want = sorted(str((i, len(h), None if i == first[h] else first[h])) for i, _, h in pages)
    assert sorted(str((r.page_id, r.payload_bytes, r.refers_to)) for r in warc.read(warc.normalise(warc.write(df))).collect()) == want


def test_substring_dedup_of_thue_morse_words_and_hot_minimisers(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    rnd = random.Random(21)
    x, y = thue_morse(1024)
    same = words(rnd, 49)
    rows = [(1, " ".join([*same[:20], x, *same[20:]])), (2, " ".join([*same[:20], y, *same[20:]])), (3, " ".join([*same[:20], x, *same[20:]]))]
    rows += [(10 + i, " ".join(words(rnd, 30) + same + same + words(rnd, 30))) for i in range(6)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    for hot in (2000, 2):
        got = sorted(map(tuple, superkmers.removal(df, hot=hot).collect()))
        assert got == sorted(brute_removal(rows, 50)) and got[1][2] == 0 and got[2][2] == 50


@pytest.mark.parametrize("hot", [1, 3, 40])
def test_hot_minimisers_are_cut_by_other_orders(spark, monkeypatch, hot):
    """Short windows over few words: minimisers with many different strings, equal strings in many documents, and copies."""
    monkeypatch.setattr(superkmers, "DIFFERENT", 1)
    rnd = random.Random(hot)
    seed = words(rnd, 4)
    rows = [(i, " ".join(words(rnd, 12, 6) + seed + words(rnd, 12, 6))) for i in range(60)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(30)] + [(7, rows[9][1]), (7, " ".join(seed * 9)), (200, " ".join(seed * 12))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    assert sorted(map(tuple, superkmers.removal(df, 10, 3, hot).collect())) == sorted(brute_removal(rows, 10))


def test_thousands_of_equal_rows_cost_what_one_does(spark, monkeypatch):
    text = " ".join(f"w{i % 71}x{i}" for i in range(120))
    rows = [(1, text, "en", "s", 0), *[(None, text, "en", "s", 0)] * 3000, *[(5, text, "en", "s", 0)] * 3000]
    df = spark.createDataFrame(rows, DOCS)
    kmers = superkmers.super_kmers(superkmers._distinct(superkmers._keyed(df)))
    assert kmers.count() <= 3 * 60
    got = superkmers.removal(df).groupBy("doc_id", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(1, 0, 1), (None, 120, 3000), (5, 120, 3000)}


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(superkmers, "run_hashes", lambda w, k: np.zeros(len(w) - k + 1, np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([0, 0, 0, 0]), pa.array([0, 0, 0, 5], pa.int32()), pa.array(["a b c", "a b d", "a b c d", "x b d"])], names=["did", "th", "start", "words"])
    assert superkmers._repeated(batch, 3).to_pylist() == [{"did": 3, "th": 0, "start": 0, "n": 1}]


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_frequent_minimisers_are_counted_once(spark, monkeypatch, sent):
    """Super-k-mers were read and counted again for every use of the counts, as soon as one minimiser was frequent."""
    for module in (common, superkmers):
        monkeypatch.setattr(module, "HOT_ROWS", 5, raising=False)
    monkeypatch.setattr(common, "SENT_BYTES", sent)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} tail{i % 3}") for i in range(12)] + [(99, " ".join(["x"] * 90))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        superkmers.repeated_runs(df).explain()
    # the frequent ones and the rest
    assert sum("FileScan" in x and "super-kmers" in x for x in out.getvalue().splitlines()) == 2, out.getvalue()
    assert sorted(map(tuple, superkmers.removal(df).collect())) == sorted(brute_removal(rows, 50))


def test_superkmers_frequent_are_found_without_a_shuffle(spark):
    passage = " ".join(f"w{i}" for i in range(70))
    df = spark.createDataFrame([(i, f"a{i} {passage} " + " ".join(f"{i}x{k}" for k in range(60))) for i in range(12)] + [(50, "short"), (51, None)], "doc_id long, text string")
    texts = superkmers._keyed(df)
    kmers = superkmers.super_kmers(texts)
    frequent = sorted(r[0] for r in kmers.groupBy("minimiser").count().where("count > 5").collect())
    listed = superkmers._listed(texts, np.array(frequent, np.int64), superkmers.WIDTH, superkmers.SEED)
    rows = lambda d: sorted((r.did, r.th, r.text, sorted(map(tuple, r.kmers))) for r in d.collect())
    assert rows(listed) == rows(superkmers._wanted(texts, kmers.where(F.col("minimiser").isin(frequent))).select("did", "th", "text", "kmers"))
    assert listed.count() == 12 and "Exchange" not in listed._jdf.queryExecution().executedPlan().toString()
