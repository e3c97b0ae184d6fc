"""Byte-pair encoding, conversation repair and centroid clustering against brute force, with nulls, repeats, ties, empty and long input."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tessella.llm import bpe, centroids, dialogue

VECTORS = "vec_id long, embedding array<float>, label int, cluster string"


# ---- byte-level BPE -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    return path, public.PATTERN, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_of_every_code_point(vocabulary):
    path, pattern, library = vocabulary
    encoder = bpe.RankEncoder(bpe.load_ranks(path), pattern)
    texts = [f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(texts), 1 << 14):
        got = encoder.encode(texts[lo : lo + (1 << 14)])
        assert [x.tolist() for x in got] == [library.encode_ordinary(x) for x in texts[lo : lo + (1 << 14)]]


def test_ids_of_odd_and_very_long_pieces(vocabulary):
    path, pattern, library = vocabulary
    encoder, rnd = bpe.RankEncoder(bpe.load_ranks(path), pattern), random.Random(2)
    texts = [None, "", " ", "\n\n \t x", "it's <|endoftext|> we'll I'D", "a" * 50_001, " " * 30_000 + "x", "!?" * 20_000, "1" * 10_000, "日本語" * 3000, "".join(rnd.choice("abcdeinorst") for _ in range(200_000))]
    texts += ["".join(rnd.choice("abé 1.\n'x") for _ in range(200)) for _ in range(200)]
    for _ in range(2):  # the second time from memory
        got = encoder.encode(texts)
        assert [x.tolist() for x in got] == [library.encode_ordinary(x or "") for x in texts]
        assert [encoder.decode(x) for x in got] == [(x or "").encode() for x in texts]
    assert encoder.queue.top == 0 and not any(encoder.queue.low) and not any(encoder.queue.buckets)


def test_memory_of_pieces_turns_over(vocabulary, monkeypatch):
    path, pattern, library = vocabulary
    monkeypatch.setattr(bpe, "MEMORY", 7)
    encoder, rnd = bpe.RankEncoder(bpe.load_ranks(path), pattern), random.Random(4)
    for _ in range(20):
        texts = [" ".join(rnd.choice(["Ärger", "zxqv", "unwieldiness", "the", "qqq"]) + rnd.choice("abc") for _ in range(30)) for _ in range(4)]
        assert [x.tolist() for x in encoder.encode(texts)] == [library.encode_ordinary(x) for x in texts]
        assert len(encoder.known) <= 7 and len(encoder.older) <= 7


def by_plain_merges(piece, ranks):
    parts = [bytes([x]) for x in piece]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[x] for x in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_ranks_in_any_order_and_gaps_between_them():
    """A merge may make a pair of a lower rank, which then comes first."""
    rnd = random.Random(9)
    for _ in range(60):
        tokens = {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 6))).encode() for _ in range(40)}
        places = rnd.sample(range(5000), 256 + len(tokens))
        ranks = dict(zip([*(bytes([x]) for x in range(256)), *sorted(tokens)], places))
        encoder = bpe.RankEncoder(ranks, r"\S+")
        pieces = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 40))) for _ in range(30)]
        want = [[ranks[x.encode()]] if x.encode() in ranks else by_plain_merges(x.encode(), ranks) for x in pieces]
        assert [x.tolist() for x in encoder.encode(pieces)] == want
    with pytest.raises(ValueError, match="no token"):
        bpe.RankEncoder({b"a": 0}, ".")


def test_encoded_documents(spark, vocabulary):
    path, pattern, library = vocabulary
    rows = [(1, "some words", "x"), (1, "some words", "x"), (2, None, None), (3, "", "x"), (None, "no id, é", "x"), (4, "w" * 70_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, bpe.round_trip(docs, path, pattern).collect()), key=repr) == sorted(want, key=repr)
    encoded = bpe.encode(docs, path, pattern)
    assert sorted((r.doc_id or -1, bytes(r.raw)) for r in bpe.decode(encoded, path, pattern).collect()) == sorted((i or -1, (t or "").encode()) for i, t, _ in rows)
    assert np.concatenate([r.ids for r in encoded.collect() if r.ids]).max() < 50_256
    assert bpe.round_trip(docs.limit(0), path, pattern).collect() == []


# ---- conversation repair --------------------------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string, edits string"


def damaged_by_hand(rows):
    """Present turns of every conversation, in order."""
    found = {}
    for conv, turn, role, text, *_ in rows:
        kept = found.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fault = role if role is not None else " ", text if text is not None else " ", zlib.crc32(key.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        kept += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest())
    return {k: sorted(v, key=order) for k, v in found.items()}


def faults_of(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_by_trying_all(turns, faults):
    """Every choice of edits with up to two inserted turns in each gap, judged by the pattern itself."""
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = []
    for (_, role, text), fault in zip(turns, faults):
        more = fault == "t"
        some = [("D", 3, None)]
        if fault not in ("b", "d"):
            some += [("K", more, (role, text)), ("R", 2 + more, ("user", text)), ("R", 2 + more, ("assistant", text))]
        choices.append(some)
    best = None
    for put in itertools.product(gaps, repeat=len(turns) + 1):
        for ops in itertools.product(*choices):
            lines, edits, cost = [], "", 0
            for i, more in enumerate(put):
                for role in more:
                    lines.append((role, ""))
                    edits, cost = edits + "I", cost + 2
                if i < len(ops):
                    letter, price, line = ops[i]
                    edits, cost = edits + letter, cost + price
                    if line:
                        lines.append(line)
            if (best is None or (cost, edits) <= best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                best = (cost, edits, "\n".join(f"{r}:{t}" for r, t in lines))
    return best


def best_by_memo(turns, faults):
    """The same by a recursion over turns and states, for longer conversations."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    ends = {"": (0, "", ()), "a": (0, "", ()), "u": (2, "I", (("assistant", ""),)), "s": (4, "II", (("user", ""), ("assistant", "")))}
    later = ends
    for (_, role, text), fault in zip(reversed(turns), reversed(faults)):
        more, now = fault == "t", {}
        for state in ends:
            some = [(later[state][0] + 3, "D" + later[state][1], later[state][2])]
            if fault not in ("b", "d"):
                to, lead = after[state], role[:1]
                some.append((later[to][0] + 2 + more, "R" + later[to][1], ((names[to], text), *later[to][2])))
                if lead == to or (lead == "s" and state == ""):
                    some.append((later[lead][0] + more, "K" + later[lead][1], ((role, text), *later[lead][2])))
            now[state] = min(some)
        for _ in range(2):
            now = {s: min(now[s], (now[after[s]][0] + 2, "I" + now[after[s]][1], ((names[after[s]], ""), *now[after[s]][2]))) for s in now}
        later = now
    cost, edits, lines = later[""]
    return cost, edits, "\n".join(f"{r}:{t}" for r, t in lines)


def reported(rows, best=best_by_memo):
    out = []
    for conv, turns in damaged_by_hand(rows).items():
        faults = faults_of(turns)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        leads = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(leads, leads[1:]))
        cost, edits, lines = best(turns, faults) if turns else (0, "", "")
        out.append((conv, gaps, *(faults.count(x) for x in "bdt"), illegal, cost, edits, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=repr)


def drawn(rnd, convs, longest):
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None]
    texts = ["Yes.", "Yes.", "No", "Really? ", "", " \t\n", None, "a.b", "é!", "x" * 50]
    return [(c, rnd.choice([t, t, t, t + 1, None]), rnd.choice(roles), rnd.choice(texts), "x") for c in range(convs) for t in range(rnd.randint(0, longest))]


def test_the_two_brute_forces_agree():
    rnd = random.Random(6)
    rows = drawn(rnd, 40, 2) + [(100 + i, t, rnd.choice(["system", "user", "assistant", "tool"]), rnd.choice(["A.", "b", "c!", ""]), "x") for i in range(4) for t in range(3)]
    assert reported(rows, best_by_trying_all) == reported(rows)


@pytest.mark.parametrize("limit", [dialogue.SLICE, 1, 120])
def test_repairs_equal_brute_force_however_conversations_are_cut(spark, limit):
    rnd = random.Random(limit)
    rows = drawn(rnd, 150, 9) + drawn(rnd, 3, 40)
    rows += [(None, t, r, f"{t}{e}", "x") for t, (r, e) in enumerate([("user", "."), ("assistant", "!"), ("assistant", ""), ("user", "?")] * 4)]
    rows += [(7777, t, rnd.choice(["user", "assistant", "system"]), rnd.choice([f"t{t}.", f"t{t}", "same."]), "x") for t in range(700)]  # longer than others together
    rows += [(8888, 3, "user", "again.", "x")] * 60  # one turn, repeated
    rows += [(9999, next(t for t in range(1000) if zlib.crc32(f"9999:{t}".encode()) % 20 == 0), "user", "gone.", "x")]
    conversations = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    assert sorted(map(tuple, dialogue.report(*dialogue.damage(conversations), limit).collect()), key=repr) == reported(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be brief.", "x"), (1, 1, "assistant", "Hello.", "x"), (1, 2, "user", "Why", "x"), (1, 3, "user", " ", "x"), (2, 0, "tool", "call.", "x"), (3, 0, "user", "", "x")]
    for limit in (dialogue.SLICE, 1):
        got = dialogue.repaired(spark.createDataFrame(rows, CONVERSATIONS), limit=limit).orderBy("conv_id", "place").collect()
        assert [tuple(r) for r in got] == [(1, 0, 0, "K", "system", "Be brief."), (1, 1, None, "I", "user", ""), (1, 2, 1, "K", "assistant", "Hello.")]  # KIKDD is before KIKKDI


def test_no_conversations(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert dialogue.report(none).collect() == [] and dialogue.repaired(none).collect() == []


# ---- centroid clustering --------------------------------------------------------------------------------------


def lloyd_by_hand(rows, k, rounds, width, scale):
    kept = []
    for vec_id, v, *_ in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * x) for x in v]))
    key = lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "g", r[1])
    centers = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centers))

    for _ in range(rounds):
        own = [[] for _ in centers]
        for _, v in kept:
            own[near(v)[1]].append(v)
        centers = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for c, vs in zip(centers, own)]
    found = [(vec_id, *near(v)[::-1]) for vec_id, v in kept]
    inertia, of = sum(d for _, _, d in found), {}
    for _, c, d in found:
        of[c] = of.get(c, 0) + d
    return sorted(((i, c, d, of[c], inertia, hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


@pytest.fixture(scope="module")
def vectors():
    rnd = random.Random(8)
    number = lambda: rnd.choice([rnd.uniform(-2, 2), rnd.randint(-3, 3) / 4, 0.0])
    rows = [(i, [number() for _ in range(4)], 1, "x") for i in range(150)]
    rows += [(1000 + i, [0.5, -0.25, 0.0, 1.0], 1, "x") for i in range(80)]  # a frequent vector
    rows += [rows[3], rows[3], (7, [9.0] * 4, None, None), (None, [0.25] * 4, 1, "x"), (None, [0.5] * 4, 1, "x"), (2**60 + 1, [-0.001] * 4, 1, "x")]
    rows += [(2000, None, 1, "x"), (2001, [], 1, "x"), (2002, [1.0] * 3, 1, "x"), (2003, [1.0] * 5, 1, "x"), (2004, [1.0, None, 1.0, 1.0], 1, "x"), (2005, [1.0, math.nan, 1.0, 1.0], 1, "x"), (2006, [math.inf, 1.0, 1.0, 1.0], 1, "x"), (2007, [1.0, -math.inf, 1.0, 1.0], 1, "x")]
    return rows


@pytest.mark.parametrize(("k", "rounds"), [(6, 5), (300, 2), (1, 3)])
def test_clusters_equal_rounds_by_hand(spark, vectors, k, rounds):
    got = centroids.cluster(spark.createDataFrame(vectors, VECTORS).repartition(5), k, rounds, 4, 256)
    assert sorted(map(tuple, got.collect()), key=repr) == lloyd_by_hand(vectors, k, rounds, 4, 256)


def test_rows_without_ids_come_last_among_first_centroids(spark):
    rows = [(None, [1.0], 1, "x"), (5, [0.0], 1, "x"), (None, [0.0], 1, "x")]
    kept = centroids.integer_vectors(spark.createDataFrame(rows, VECTORS), 1)
    assert centroids.first_centroids(kept, 2).tolist() == [[0], [0]]
    assert centroids.first_centroids(kept, 9).tolist() == [[0], [0], [256]]


def test_no_vector_to_keep_gives_no_rows(spark):
    for rows in ([], [(1, None, 1, "x"), (2, [1.0], 1, "x")]):
        got = centroids.cluster(spark.createDataFrame(rows, VECTORS), width=4)
        assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_exact_distances_are_an_error(spark):
    with pytest.raises(Exception, match="units or more"):
        centroids.cluster(spark.createDataFrame([(1, [1e30], 1, "x")], VECTORS), width=1).collect()
    got = centroids.cluster(spark.createDataFrame([(1, [524287.0], 1, "x"), (2, [-524287.0], 1, "x")], VECTORS), 1, 0, 1).collect()
    assert {r.distance for r in got} == {0, (2 * 524287 * 256) ** 2}
