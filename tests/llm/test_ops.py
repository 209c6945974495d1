"""Small cases for each operator: edges, ties, and brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tributary.llm import bitslice, chat, exact, jaccard, mixing, packing, records, substring, toxicity, warc, words
from tributary.llm.common import new_folder, with_row
from tributary.llm.graph import components
from tributary.llm.queries import tokenizer
from tributary.llm.tokens import BatchEncoder, Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, parts=2):
    rows_ = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows_, DOCS).repartition(parts) if rows_ else spark.createDataFrame([], DOCS)


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names that operators use."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    data = [(None, None), (None, "a b c d"), (1, ""), (1, ""), (2, long), (3, long), (4, "a b c d"), (4, "a b c d"), (5, " \t\n"), (6, "é ß 中 文")]
    return spark.createDataFrame([(a, b, None, None, None, 7, "x", 1.5) for a, b in data], DOCS + ", n int, digest string, place double")


WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]


def sentence(rng, n, vocabulary=10_000):
    return " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(n))


# Words and tokens


def test_word_rule():
    text = "a b  C\tD\x0be \n"
    buffer = np.frombuffer(text.encode(), np.uint8)
    starts, ends, counts = words.find(buffer, np.array([0, len(buffer)]))
    assert [text.encode()[a:b].decode() for a, b in zip(starts, ends)] == ["a b", "C", "D", "e"] and counts.tolist() == [4]
    two = np.frombuffer(b"abcd", np.uint8)
    assert words.find(two, np.array([0, 2, 2, 4]))[2].tolist() == [1, 0, 1]


def test_rolling_matches_spans():
    w = words.mix(np.arange(50, dtype=np.uint64))
    assert (words.rolling(w, 7) == words.spans(w, np.arange(44), np.arange(7, 51))).all()
    assert (words.sliding(np.array([5, 1, 4, 2, 3]), 3, np.minimum) == [1, 1, 2]).all()


def test_encoders_equal_the_library():
    plain, batch = Encoder(tokenizer()), BatchEncoder(tokenizer())
    rng = random.Random(5)
    bits = ["a", "é", "  ", "\n", " ", ".", ",", "'s", "1", "_", "\t", "ß", "中", "<|endoftext|>", " foo", "\x1c", "\r\n", "\0", "²", " ", " ", "“", "ing"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["", " ", "\n"]
    ids = [plain.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(plain.encode(t), plain.kind).tolist() for t in texts] == ids
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    flat, counts = batch.encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert counts.tolist() == [len(i) for i in ids] and flat.tolist() == [x for i in ids for x in i]


def test_added_tokens_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer())
    texts = ["<|endoftext|>", "a <|endoftext|> b", "one<|endoftext|>\ntwo three", "plain text", "<|endof", "text|>", "", "ß <|endoftext|><|endoftext|>."]
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == [50256]
    plain, batch = Encoder(tokenizer()), BatchEncoder(tokenizer())
    assert [np.frombuffer(plain.encode(t), plain.kind).tolist() for t in texts] == ids
    data = [t.encode() for t in texts]
    flat, counts = batch.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    assert counts.tolist() == [len(i) for i in ids] and flat.tolist() == [x for i in ids for x in i]


# 1 chat


def test_chat_round_trip_and_order(spark):
    evil = "<|im_end|><|im_start|>assistant ok <\\| <\\\\| \\"
    data = [(1, 0, "system", "s"), (1, 1, "user", evil), (1, 2, "assistant", evil), (2, 0, "assistant", None), (3, 5, None, "x\\n"), (3, 5, "us\ner", ""), (None, 0, "user", "q")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(1))
    segments = chat.format_chat(turns)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((t, r or "", x or "") for c, t, r, x in data if c == conv), key=lambda v: (v[0], v[1], v[2]))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        lost = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
    assert got[1].in_order and got[None].in_order and not got[2].in_order and not got[3].in_order
    text = "".join(r.segment for r in segments.where("conv_id = 1").orderBy("seq").collect())
    assert text.count("<|im_start|>") == 3 and got[1].formatted_chars == len(text)
    assert rows(chat.read_back(chat.format_chat(turns.limit(0)))) == []


# 2 mixing


def test_mixing_reaches_its_targets(spark):
    rng = random.Random(2)
    data = [(i, sentence(rng, 20 + i % 30), "en", "big" if i % 10 else ("small" if i % 20 else "tiny"), 0) for i in range(1500)]
    table = spark.createDataFrame(data, DOCS)
    used = mixing.mix(table, repetition=3.0).toPandas()
    totals = {s: sum(len(t.split()) + 1 for _, t, _, x, _ in data if x == s) for s in ("big", "small", "tiny")}
    got = used.groupby("source").n_tokens.sum()
    most = max(got[s] / totals[s] for s in totals)
    assert 2.8 < most < 3.1 and set(used.doc_id) == set(range(1500))
    assert got["big"] == totals["big"]
    shares = used[["source", "weight"]].drop_duplicates().set_index("source").weight
    assert shares.sum() == pytest.approx(1)
    for s in totals:
        assert got[s] / got.sum() == pytest.approx(shares[s], abs=0.01)
    # No document twice in a pass, and every stretch of the mix has the same shares.
    assert not used.duplicated(["doc_id", "epoch"]).any()
    half = used[used.place < 0.5].groupby("source").n_tokens.sum()
    assert half["big"] / half.sum() == pytest.approx(shares["big"], abs=0.03)
    again = mixing.mix(table.repartition(5), repetition=3.0)
    assert again.count() == pytest.approx(len(used), rel=0.01)


def test_mixing_to_an_entropy(spark):
    data = [(i, "w " * 9, "en", "a" if i % 16 else "b", 0) for i in range(800)]
    used = mixing.mix(spark.createDataFrame(data, DOCS), repetition=None, entropy=0.5)
    w = [r.weight for r in used.select("source", "weight").distinct().collect()]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(0.5, abs=1e-4)


def test_mixing_edges(spark):
    out = mixing.mixed(odd_docs(spark))
    assert out.columns == odd_docs(spark).columns and out.count() >= 10
    assert mixing.mix(docs(spark, [])).count() == 0


# 3 packing


def check_pieces(pieces, texts, size):
    tok = Encoder(tokenizer())
    seen = {}
    for p in pieces:
        seen.setdefault(p.doc_id, []).append(p)
    for doc, text in texts.items():
        ids = tok.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        got = []
        for p in sorted(seen[doc], key=lambda p: p.start):
            assert p.start == len(got) and p.doc_tokens == len(ids)
            part = np.frombuffer(p.ids, f"<u{p.id_bytes}").tolist()
            assert len(part) == p.length > 0
            got += part
        assert got == ids
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert all(e <= size for e in ends.values())
    return ends


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(3)
    texts = {i: sentence(rng, rng.choice([0, 1, 5, 60, 300, 1500])) for i in range(300)}
    texts[7] = None
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOCS).repartition(4)
    pieces = packing.pack(table, tokenizer(), size=256, open_windows=8).collect()
    ends = check_pieces(pieces, texts, 256)
    assert sum(256 - e for e in ends.values()) < 0.03 * sum(ends.values())


def test_packing_edges(spark):
    assert packing.pack(docs(spark, []), tokenizer()).count() == 0
    found = packing.pack(odd_docs(spark), tokenizer())
    sums = packing.checksums(found).agg(F.sum("length")).first()[0]
    assert sums == found.agg(F.sum("length")).first()[0]
    p = packing.checksums(packing.pack(docs(spark, ["one two"]), tokenizer())).first()
    ids = Encoder(tokenizer()).tokenizer.encode("one two", add_special_tokens=False).ids + [1]
    assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


# 4 toxicity


def test_chain_is_exact():
    rng = np.random.default_rng(0)
    e, moves = np.exp(rng.normal(size=6)), np.exp(rng.normal(size=(2, 2)))
    total, ones = 0.0, np.zeros(6)
    for y in range(64):
        states = [y >> k & 1 for k in range(6)]
        p = np.prod([e[k] if s else 1 for k, s in enumerate(states)]) * np.prod([moves[a, b] for a, b in zip(states, states[1:])])
        total += p
        ones += p * np.array(states)
    got = toxicity.marginals([np.log(e), np.log(e[:3]), np.zeros(0)], moves)
    assert np.allclose(got[0], ones / total) and len(got[1]) == 3 and len(got[2]) == 0


def test_toxicity_learns_and_points(spark):
    rng = random.Random(4)
    texts, labels = {}, {}
    for i in range(400):
        w = sentence(rng, 80, 500).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(80)] = rng.choice(["vile", "rotten", f"qqz{rng.randrange(999)}"])
        texts[i], labels[i] = " ".join(w), int(toxic)
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOCS)
    marks = spark.createDataFrame([(i, 1, y) for i, y in labels.items()] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, marks)
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((got[i].score >= 0.5) == bool(labels[i]) for i in held)
    i = next(i for i in held if labels[i])
    assert all(re.fullmatch(r"vile|rotten|qqz\d+", texts[i][s["from"] : s["to"]]) for s in got[i].spans)


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.score(odd_docs(spark), toxicity.fit(odd_docs(spark), none)).collect()
    assert len(found) == 10 and all(r.score == pytest.approx(0.5) for r in found)
    assert toxicity.score(docs(spark, []), toxicity.Field()).count() == 0


# 5 substring


def brute_substring(texts, width):
    cut = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts.items()}
    where = {}
    for i, w in cut.items():
        for s in range(len(w) - width + 1):
            where.setdefault(tuple(w[s : s + width]), []).append((i, s))
    gone = {i: set() for i in cut}
    for places in where.values():
        if len(places) > 1:
            for i, s in places:
                gone[i] |= set(range(s, s + width))
    return sorted(((i, len(w), len(gone[i]), " ".join(x for k, x in enumerate(w) if k not in gone[i])) for i, w in cut.items()), key=repr)


@pytest.mark.parametrize("width", [4, 9])
def test_substring_against_brute_force(spark, width):
    rng = random.Random(width)
    passages = [sentence(rng, n).split() for n in (5, 12, 40, 200)]
    texts = {}
    for i in range(120):
        w = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += sentence(rng, rng.randrange(30), 40).split() + p[a : a + rng.randrange(1, 200)]
        texts[i] = " ".join(w)
    texts |= {200: "x y " * 300, 201: "z " * 100, 202: texts[3], 203: None, 204: "", 205: " \n".join(passages[3])}
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOCS).repartition(3)
    got = rows(substring.remove_repeats(table, width).select("doc_id", "n_words", "n_removed", "kept_text"))
    assert got == brute_substring(texts, width)


def test_substring_edges(spark):
    assert substring.remove_repeats(docs(spark, [])).count() == 0
    assert substring.remove_repeats(odd_docs(spark)).count() == 10
    r = substring.remove_repeats(docs(spark, ["a b c d e", "x a b c d"]), 4).collect()
    assert sorted([(s["from"], s["to"]) for s in x.removed] for x in r) == [[(0, 4)], [(1, 5)]]


# 6 records


def test_records_round_trip(spark):
    rng = random.Random(6)
    texts = {i: sentence(rng, rng.randrange(40)) for i in range(200)} | {300: None, 301: ""}
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOCS).repartition(5)
    index = records.write_records(table, new_folder(spark, "records"), tokenizer())
    start = 0
    got = {r.doc_id: r for r in records.read_records(index.orderBy(F.rand(1))).collect()}
    plain = Encoder(tokenizer()).tokenizer
    for i in sorted(texts):
        ids = plain.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].start == start
        start += len(ids)
    assert records.write_records(docs(spark, []), new_folder(spark, "records"), tokenizer()).count() == 0
    odd = records.write_records(odd_docs(spark), new_folder(spark, "records"), tokenizer())
    assert records.read_records(odd).count() == 10


def test_broken_records_are_found():
    data = bytearray(records.frame(records.serialise(7, np.array([1, 2], "<u2").tobytes(), 2)))
    assert records.parse(records.unframe(bytes(data)))[0] == 7
    for at in (0, 9, 14, len(data) - 1):
        bad = data.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            records.unframe(bytes(bad))


# 7 WARC

RECORDS = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers array<struct<name:string,value:string>>, payload string"


def test_revisits(spark):
    h = lambda **k: [(a.replace("_", "-"), b) for a, b in k.items()]
    data = [
        (1, "http://www.X.org/a/?utm_source=q#f", 10, "response", '"v1"', None, h(Content_Type="text/html", ETag='"v1"', Date="d1"), "one"),
        (2, "https://x.org:443/a", 20, "response", '"v2"', "m2", None, "two"),
        (3, "http://x.org/a", 15, "revisit", 'W/"v1"', None, h(date="d3", Content_Type="no"), None),
        (4, "http://x.org/a", 20, "revisit", '"v1"', None, None, None),
        (5, "http://x.org/a", 25, "revisit", '"v1"', None, None, None),
        (6, "http://x.org/a", 26, "revisit", None, "m2", None, None),
        (7, "http://x.org/b", 26, "revisit", '"v1"', None, None, None),
        (8, None, 26, "revisit", None, None, None, None),
        (9, "http://x.org/a", None, "revisit", None, None, None, None),
        (10, "http://x.org/a", 27, "revisit", None, None, None, None),
    ]
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(data, RECORDS)).collect()}
    assert {k: (r.status, r.response_id) for k, r in got.items()} == {
        3: ("merged", 1), 4: ("merged", 1), 5: ("mismatch", 2), 6: ("merged", 2), 7: ("orphan", None), 8: ("invalid", None), 9: ("invalid", None), 10: ("merged", 2),
    }
    assert [tuple(x) for x in got[3].headers] == [("Content-Type", "text/html"), ("ETag", '"v1"'), ("date", "d3")] and got[3].payload == "one"
    assert rows(warc.resolve(spark.createDataFrame([], RECORDS))) == []


# 8 exact


def brute_exact(table):
    groups = {}
    for r in table:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    out = []
    for g in groups.values():
        keep = min(g, key=lambda r: (-len(r[1] or ""), r[0]))[0]
        out += [(r[0], keep, len(g), r[0] == keep) for r in g]
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_even_if_digests_clash(spark, digest):
    rng = random.Random(8)
    data = [(i, rng.choice([None, "", " ", "a b", "ab", "a\tb ", "A b", "long " * 5, f"t{i}", "中 文", "中文"])) for i in range(150)]
    table = spark.createDataFrame([(*r, None, None, None) for r in data], DOCS).repartition(3)
    got = rows(exact.deduplicate(table, digest).select("doc_id", "keep_id", "group_size", "kept"))
    assert got == brute_exact(data)


def test_exact_edges(spark):
    assert exact.deduplicate(docs(spark, [])).count() == 0
    odd = odd_docs(spark)
    found = exact.deduplicate(odd)
    assert found.count() == 10 and found.where("kept").count() == 4
    assert exact.keep_one(odd).columns == odd.columns and exact.keep_one(odd).count() == 4


# 9 Jaccard


def brute_jaccard(texts, size, num, den):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in texts}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in texts:
        for j in texts:
            if i < j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(((i, len(sets[i]), find(i)) for i in texts), key=repr)


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_against_brute_force(spark, size, num):
    rng = random.Random(size)
    texts = {}
    for i in range(160):
        if i % 4 == 0 or not texts:
            w = sentence(rng, rng.choice([1, 2, 4, 9, 14, 20, 40, 150, 700]), 3000).split()
        else:
            w = (texts[rng.choice(list(texts))] or "").split()
            for _ in range(rng.randrange(4)):
                if w:
                    w[rng.randrange(len(w))] = f"New{rng.randrange(99)}"
            if rng.random() < 0.3:
                w = w[: max(1, len(w) - rng.randrange(3))]
        texts[i] = " ".join(w)
    texts |= {500: None, 501: "", 502: "A B", 503: "a  b", 504: "a b c"}
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOCS).repartition(3)
    got = rows(jaccard.jaccard_components(table, size, num, 100).select("doc_id", "n_shingles", "component_id"))
    assert got == brute_jaccard(texts, size, num, 100)


def test_subset_plans_cover_all_pairs():
    for num in (60, 80, 90):
        for n in range(1, 25):
            for m in range(n, 25):
                c = jaccard.overlap(n, m, num, 100)
                # c is the least overlap that links the sizes.
                assert 100 * c >= num * (n + m - c) and not 100 * (c - 1) >= num * (n + m - c + 1)
                if c <= n and not (n == m == c):
                    assert (n, m, n - c) in jaccard.subset_plans(n, 25, num, 100)
                    assert (n, m, m - c) in jaccard.subset_plans(m, 25, num, 100)


def test_jaccard_edges(spark):
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0
    odd = odd_docs(spark)
    assert jaccard.jaccard_components(odd).count() == 10
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id and r.text and r.text.strip()) == [2, 4, 6]


def test_jaccard_keeps_one_of_each_component_whatever_the_ids(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    data = [(1, words(1)), (1, words(2)), (None, words(3)), (None, words(3) + " more"), (None, words(4)), (7, words(4)), (5, words(5)), (6, words(5))]
    kept = jaccard.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(r.text.split()[0] for r in kept) == [f"w{k}x0" for k in range(1, 6)]
    assert {r.text.split()[0]: r.doc_id for r in kept} == {"w1x0": 1, "w2x0": 1, "w3x0": None, "w4x0": 7, "w5x0": 5}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (5, 5)], "u long, v long")
    assert rows(components(links)) == [(1, 1), (2, 1), (3, 1), (6, 6), (7, 6), (8, 6), (9, 6)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r.root for r in components(chain).collect()} == {0}
    assert components(links.limit(0)).count() == 0


# 10 bit slices


def test_top_rows_against_brute_force(spark):
    rng = np.random.default_rng(10)
    vectors = np.round(rng.normal(scale=0.2, size=(300, 8)), 2).astype(np.float32)
    vectors[40:60] = vectors[39]
    data = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    data += [(400, None, 0), (401, [1.0, None] + [0.0] * 6, 0), (402, [float("nan")] * 8, 0), (403, [float("inf")] * 8, 0), (404, [0.5, 0.5], 0), (405, [0.5, 0.25], 0), (406, [], 0), (None, [0.0] * 8, 0)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)
    queries = table.where("vec_id % 20 = 0 or vec_id = 404")
    q = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, 300, 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    want.append((404, 1, 405, 128 * 128 + 128 * 64))
    for size in (64, 65_536):
        got = rows(bitslice.search(bitslice.build_index(table, block_rows=size), queries))
        assert got == sorted(want, key=repr)
    none = table.limit(0)
    assert bitslice.search(bitslice.build_index(none), none).count() == 0


def test_row_identity_survives_repeats(spark):
    r = with_row(odd_docs(spark)).select("__f", "__r")
    assert r.distinct().count() == 10


def thue_morse(n):
    """Two words of n letters that cancel out in every polynomial modulo a power of two."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_words_of_like_structure_are_told_apart(spark, n):
    tail = " " + " ".join(f"t{i}" for i in range(34))
    texts = [w + tail for w in thue_morse(n)]
    table = docs(spark, texts)
    data = [t.encode() for t in texts]
    buffer = np.frombuffer(b"".join(data), np.uint8)
    assert len(set(words.hashes(buffer, np.array([0, len(data[0])]), np.array([n, len(data[0]) + n])).tolist())) == 2
    assert rows(jaccard.jaccard_components(table, 3, 96, 100).select("doc_id", "component_id")) == [(0, 0), (1, 1)]
    assert [r.n_removed for r in substring.remove_repeats(table).collect()] == [0, 0]
    library = Encoder(tokenizer()).tokenizer
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    index = records.write_records(table, new_folder(spark, "records"), tokenizer())
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in records.read_records(index).collect()}
    assert got == {i: x + [2] for i, x in enumerate(ids)}
    check_pieces(packing.pack(table.repartition(1), tokenizer()).collect(), dict(enumerate(texts)), 2048)


def test_a_store_meets_earlier_batches_after_a_restart(spark, tmp_path):
    for digest in (exact.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)):
        folder = f"file://{tmp_path}/{digest.__name__ == '<lambda>'}"
        first = [(1, "a b"), (2, "c"), (3, None), (4, "c  "), (5, "e")]
        second = [(6, "ab"), (7, "new"), (8, " "), (9, "c"), (0, "e")]
        for k, data in enumerate((first, second)):
            spark.createDataFrame(data, "doc_id long, text string").repartition(2).write.parquet(f"{folder}-in{k}")
        one = exact.Store(spark, folder, digest, files=1).add(spark.read.parquet(f"{folder}-in0"), "one")
        assert rows(one.select("doc_id", "keep_id", "group_size", "kept")) == brute_exact(first)
        for _ in range(2):  # repeating a batch changes nothing
            two = exact.Store(spark, folder, digest, files=1).add(spark.read.parquet(f"{folder}-in1").where("doc_id >= 0"), "two")
            want = [r for r in brute_exact(first + second) if r[0] in (0, 6, 7, 8, 9)]
            assert rows(two.select("doc_id", "keep_id", "group_size", "kept")) == want


def test_offsets_are_those_of_the_text_itself(spark):
    table = spark.createDataFrame([(i, f"İİİ {'vile' if i % 2 else 'kind'} w{i % 7}", None, None, None) for i in range(60)], DOCS)
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    found = toxicity.score(table, toxicity.fit(table, marks)).where("doc_id = 1").first()
    assert [(s["from"], s["to"]) for s in found.spans] == [(4, 8)]


def test_the_mix_is_the_same_again_whatever_the_files(spark, tmp_path):
    rng = random.Random(3)
    data = [(i, sentence(rng, 40), "en", "a" if i % 5 else "b", 0) for i in range(300)]
    runs = []
    for k in range(2):
        spark.createDataFrame(data, DOCS).repartition(3, "doc_id").write.parquet(f"{tmp_path}/{k}")
        out = mixing.mixed(spark.read.parquet(f"{tmp_path}/{k}"))
        out.write.parquet(f"{tmp_path}/out{k}")
        runs.append([r.doc_id for r in spark.read.parquet(f"{tmp_path}/out{k}").coalesce(1).collect()])
    assert runs[0] == runs[1] and len(runs[0]) > 300


def test_scores_that_could_overflow_are_refused(spark):
    table = spark.createDataFrame([(1, [1e300, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="large components"):
        bitslice.build_index(table)
    small = bitslice.build_index(table.where("vec_id = 2"))
    with pytest.raises(ValueError, match="large components"):
        bitslice.search(small, table)


def test_revisits_repeat_and_columns_clash(spark):
    data = [(1, "http://x/a", 1, "response", '"v"', None, None, "b"), (1, "http://x/a", 1, "response", '"v"', None, None, "a")]
    data += [(2, "http://x/a", 5, "revisit", '"v"', None, [(None, "q"), ("Date", "d")], None)] * 2
    table = spark.createDataFrame(data, RECORDS)
    for name in ("key", "slice", "found", "status", "first", "near", "response_id", "response_ts"):
        table = table.withColumn(name, F.lit("x"))
    got = warc.resolve(table).collect()
    assert [(r.record_id, r.response_id, r.status, r.payload, [tuple(h) for h in r.headers]) for r in got] == [(2, 1, "merged", "a", [("Date", "d")])] * 2


def test_a_hot_url_is_resolved(spark):
    data = [(i, "http://x/a", i, "response" if i % 3 == 0 else "revisit", None, None, None, str(i)) for i in range(900)]
    got = {r.record_id: r.response_id for r in warc.resolve(spark.createDataFrame(data, RECORDS).repartition(4)).collect()}
    assert got == {i: (i - 1) // 3 * 3 for i in range(900) if i % 3}


def test_repeated_vectors_and_clashing_columns(spark):
    data = [(1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for name in ("dims", "block", "copy", "number", "size"):
        table = table.withColumn(name, F.lit(5))
    got = rows(bitslice.search(bitslice.build_index(table, scale=1), table.where("vec_id in (1, 2)"), k=2, scale=1))
    assert got == sorted([(1, 1, 2, 1), (1, 2, 3, 0), (1, 1, 2, 2), (1, 2, 3, 0), (2, 1, 1, 2), (2, 2, 1, 1)], key=repr)


def test_rows_of_one_doc_id_are_written_apart(spark):
    texts = [f"t{i}" for i in range(50)]
    table = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = rows(records.read_records(records.write_records(table, new_folder(spark, "records"), tokenizer())))
    ids = Encoder(tokenizer()).tokenizer
    assert sorted(np.frombuffer(r[2], "<u4").tolist() for r in got) == sorted(ids.encode(t, add_special_tokens=False).ids + [2] for t in texts)
    ends = sorted((r[1], r[1] + len(r[2]) // 4) for r in got)
    assert [a for a, _ in ends] == [0, *(b for _, b in ends[:-1])]
    assert all(a[0] is None for a in sorted(got, key=lambda r: r[1])[:25])


def brute_mix(table, repetition, seed=17):
    """Exponent, budgets, passes and positions of mix(), computed anew in plain Python from the rows' hashes."""
    rows_ = with_row(table).select(
        "doc_id", "source", "__f", "__r", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        F.xxhash64("doc_id", "text", F.coalesce("source", F.lit(""))).alias("own"),
    ).collect()
    spark = table.sparkSession
    totals = {}
    for r in rows_:
        totals[r.source or ""] = totals.get(r.source or "", 0) + r.words + 1
    most = max(totals.values())
    low, high = 0, 1 << 36
    while high - low > 1:
        mid = (low + high) // 2
        flat = max((t / most) ** (mid / 2.0**36) / (t / most) for t in totals.values()) > repetition
        low, high = (mid, high) if flat else (low, mid)
    weights = {s: (t / most) ** (high / 2.0**36) for s, t in totals.items()}
    budget = {s: max(t, math.floor(most * weights[s] + 1e-6)) for s, t in totals.items()}
    blocks = {s: -(-t // mixing.BLOCK_TOKENS) for s, t in totals.items()}

    def hashed(expression, data, schema):
        made = spark.createDataFrame(data, schema).withColumn("h", F.expr(expression)).collect()
        return [r.h for r in made]

    deal = hashed(f"xxhash64({seed}, own, r)", [(r.own, r[3]) for r in rows_], "own long, r long")
    held = {}
    for r, h in zip(rows_, deal):
        held.setdefault((r.source or "", h % blocks[r.source or ""]), []).append(r)
    out = []
    for s in totals:
        own = [k for k in held if k[0] == s]
        for epoch in range(max(1, -(-budget[s] // totals[s]))):
            order = dict(zip(own, hashed(f"xxhash64({seed}, e, s, d)", [(epoch, s, k[1]) for k in own], "e long, s string, d long")))
            at = epoch * totals[s]
            for k in sorted(own, key=lambda k: (order[k], k[1])):
                inside = hashed(f"xxhash64({seed}, e, own, r)", [(epoch, r.own, r[3]) for r in held[k]], "e long, own long, r long")
                for _, r in sorted(zip(inside, held[k]), key=lambda x: (x[0], x[1].own, x[1][3])):
                    if at < budget[s]:
                        out.append((r.doc_id, s, r.words + 1, epoch, at))
                    at += r.words + 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranged", [False, True])
def test_mixing_against_brute_force(spark, tmp_path, monkeypatch, ranged):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 200)
    if ranged:
        monkeypatch.setattr(mixing, "RANGE_BLOCKS", 4)
    rng = random.Random(12)
    data = [(i, sentence(rng, rng.randrange(60)) if i % 9 else None, "en", ("big", "big", "mid", "small", None)[min(4, rng.randrange(12) // 2)], 0) for i in range(400)]
    spark.createDataFrame(data, DOCS).repartition(3).write.parquet(f"{tmp_path}/docs")
    table = spark.read.parquet(f"{tmp_path}/docs")
    got = rows(mixing.mix(table, repetition=2.0).select("doc_id", "source", "n_tokens", "epoch", "position"))
    assert got == brute_mix(table, 2.0)


def test_a_hot_element_and_many_ranges_lose_no_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "RANGE", 64)
    monkeypatch.setattr(jaccard, "CHUNK", 500)
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    monkeypatch.setattr(jaccard, "PAIRS_PER_ENTRY", 0)
    test_jaccard_against_brute_force(spark, 3, 80)


def test_jaccard_rounds_carry_only_lists_of_several_components(spark, monkeypatch):
    rounds, inner = [], jaccard.Join.pairs_left

    def counted(self, held):
        of = [len({r.root for r in part}) for part in held.groupBy("tok").agg(F.collect_list(F.struct("root")).alias("x")).toPandas()["x"]]
        rounds.append((held.count(), min(of, default=2)))
        return inner(self, held)

    monkeypatch.setattr(jaccard.Join, "pairs_left", counted)
    monkeypatch.setattr(jaccard, "PAIRS_PER_ENTRY", 0)
    test_jaccard_against_brute_force(spark, 3, 80)
    assert len(rounds) > 1 and all(least > 1 for _, least in rounds)
    assert rounds[-1][0] < rounds[0][0]
