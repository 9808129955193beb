"""The training-data operators against brute force, on given tables and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from exposia.llm import bloom_lm, jaccard_join, language, queries, suffix_dedup, transducer
from exposia.llm.components import components
from exposia.llm.fingerprints import fingerprints
from exposia.llm.lattice import Lattice, Pieces
from exposia.llm.mixing import mix_sources, take
from exposia.llm.near_vectors import near_vectors
from exposia.llm.token_files import EliasFano, read_documents, write_tokens
from exposia.llm.warc import capture_key, read_captures, url_key, write_archives

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PIECES = f"{queries.TOKENIZERS}/{transducer.VOCABULARY}"
WORDS = f"{queries.TOKENIZERS}/word_bpe_49k.json"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def rows(df):
    return [r.asDict() for r in df.collect()]


def brute_components(texts, linked):
    parent = {i: i for i in texts}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in itertools.combinations(sorted(texts), 2):
        if linked(texts[a], texts[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def jaccard(a, b):
    return bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)


def test_jaccard_join_matches_brute_force(spark, docs):
    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(queries.op1_jaccard_join(spark, SF))}
    want = brute_components(sets, jaccard)
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


@pytest.mark.parametrize("share,block", [(500, 1500), (3, 4)])
def test_jaccard_join_of_one_large_group_of_near_copies(spark, monkeypatch, share, block):
    """Frequent shingles and blocks smaller than the group must not change the result."""
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", share)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(40):
        edited = list(base)
        for k in range(i % 7):
            edited[(i * 13 + k * 29) % 120] = f"e{i}x{k}"
        texts[i] = " ".join(edited)
    texts |= {100 + i: " ".join(base[:60] + [f"o{i}q{k}" for k in range(60)]) for i in range(10)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in rows(jaccard_join.jaccard_join(frame))}
    assert got == brute_components({i: shingles(t) for i, t in texts.items()}, jaccard)


def test_jaccard_join_of_odd_rows(odd, none):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.jaccard_join(odd)))
    assert got[:2] == [(1, 8, 1), (2, 8, 1)] and got[2:5] == [(3, 0, 3), (4, 0, 4), (5, 0, 5)]
    assert [g[2] for g in got if g[0] in (6, 10)] == [6, 6, 6] and [g[2] for g in got if g[0] in (8, 9)] == [8, 8]
    assert jaccard_join.jaccard_join(none).count() == 0


def near_words(name, *edits):
    """100 words; each edit far from others changes five of the 96 shingles."""
    return " ".join(f"{name}e{k}" if k in edits else f"{name}{k}" for k in range(100))


def test_jaccard_join_through_rows_without_doc_id(spark):
    data = [(1, near_words("a", 10, 20)), (2, near_words("a", 50, 60)), (None, near_words("a")), (None, near_words("b"))]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((r["n_shingles"], r["doc_id"] or 9, r["component_id"] or 9) for r in rows(jaccard_join.jaccard_join(frame)))
    assert got == [(96, 1, 1), (96, 2, 1), (96, 9, 1), (96, 9, 9)]


def test_jaccard_join_of_texts_under_one_doc_id(spark):
    names = "abcdefgh"
    data = [(50, near_words(x)) for x in names] + [(60 + i, near_words(x, 30)) for i, x in enumerate(names)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in rows(jaccard_join.jaccard_join(frame)))
    assert got == sorted((i, 50) for i, _ in data)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 99), (99, 98), (7, 7), (200, 200)]
    got = {r["id"]: r["component"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {**{i: 0 for i in range(51)}, 98: 98, 99: 98, 100: 98, 200: 200}


def test_language_of_held_out_texts(spark, docs):
    lang = {d["doc_id"]: d["lang"] for d in docs}
    got = rows(queries.op2_language_id(spark, SF))
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(odd, none):
    model = language.fit(odd, PIECES, F.lit(True))
    got = [(r["row"]["doc_id"], r["lang_pred"]) for r in rows(language.identify(odd, model))]
    assert sorted(i for i, x in got if x == "und") == [3, 4, 5, 7]
    assert language.identify(none, model).count() == 0
    empty = language.fit(none, PIECES, F.lit(True))
    assert {r["lang_pred"] for r in rows(language.identify(odd, empty))} == {"und"}


def test_lattice_counts_every_segmentation():
    vocabulary = [b"a", b"b", b"ab", b"ba", b"aba", b"c"]
    weight = np.log(np.array([0.3, 0.2, 0.15, 0.1, 0.2, 0.05]))
    table = dict(zip(vocabulary, weight))
    strings = [b"abab", b"cab", b"aaba", b""]

    def paths(s):
        if not s:
            return [[]]
        return [[p, *rest] for p in vocabulary if s.startswith(p) for rest in paths(s[len(p) :])]

    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    lattice = Lattice.of(Pieces(vocabulary), np.frombuffer(b"".join(strings), np.uint8), offsets)
    total = lattice.log_sums(weight[lattice.piece])[lattice.last]
    back = lattice.log_sums_back(weight[lattice.piece])[lattice.first]
    piece, count = lattice.shortest(-weight[lattice.piece])
    start = 0
    for s, a, b, n in zip(strings, total, back, count):
        each = [sum(table[p] for p in path) for path in paths(s)]
        assert math.isclose(a, math.log(sum(map(math.exp, each))), abs_tol=1e-12) and math.isclose(a, b, abs_tol=1e-12)
        best = [vocabulary[i] for i in piece[start : start + n]]
        assert b"".join(best) == s and math.isclose(sum(table[p] for p in best), max(each), abs_tol=1e-12)
        start += n


def brute_spans(texts):
    """Covered bytes by the definition; texts in order."""
    seen, out = set(), []
    for raw in texts:
        covered = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        runs = sum(1 for k, c in enumerate(covered) if c and not (k and covered[k - 1]))
        kept = bytes(x for x, c in zip(raw, covered) if not c)
        out.append((len(raw), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


def digest(r):
    return r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]


def test_repeats_match_brute_force(spark, docs):
    ordered = sorted(docs, key=lambda d: d["doc_id"])
    want = brute_spans([(d["text"] or "").encode() for d in ordered])
    got = {r["doc_id"]: digest(r) for r in rows(queries.op3_suffix_dedup(spark, SF))}
    assert got == {d["doc_id"]: w for d, w in zip(ordered, want)}


@pytest.mark.parametrize("share,group", [(300, 4000), (10**6, 4000), (300, 3)])
def test_repeats_of_a_common_passage(spark, monkeypatch, share, group):
    """As hot anchors, as large groups, and as suffix arrays, with one result."""
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", share)
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    draw = np.random.default_rng(5)
    noise = lambda n: "".join(draw.choice(list("abcdefgh é"), n))
    passage = noise(400)
    texts = [noise(int(draw.integers(0, 60))) + passage[int(draw.integers(0, 99)) :] + noise(150) for _ in range(60)]
    texts += ["ab" * 400, "ab" * 300 + noise(20), texts[3], ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: digest(r) for r in rows(suffix_dedup.remove_repeats(frame))}
    assert [got[i] for i in range(len(texts))] == brute_spans([t.encode() for t in texts])


def test_repeats_of_odd_rows(odd, none):
    got = {r["row"]["doc_id"]: r for r in rows(suffix_dedup.remove_repeats(odd))}
    assert len(rows(suffix_dedup.remove_repeats(odd))) == 12 and got[3]["n_bytes"] == 0 and got[9]["kept"] == b""
    assert got[8]["row"]["row"] == "x" and got[8]["n_removed"] > 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_repeats_of_texts_without_doc_id_whose_hashes_end_alike(spark):
    text = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(2)])
    made = spark.range(20_000).select(text.alias("text")).withColumn("end", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFF)))
    alike = made.groupBy("end").agg(F.sort_array(F.collect_list("text")).alias("texts")).filter("size(texts) > 1").collect()
    assert len(alike) > 5
    data = [(i, r["texts"][0]) for i, r in enumerate(alike)] + [(None, t) for r in alike for t in r["texts"]]
    got = rows(suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")))
    left = sorted(r["kept_text"] for r in got if r["row"]["doc_id"] is None)
    assert left == sorted(t for r in alike for t in ["", *r["texts"][1:]])


def test_maximal_repeats_need_different_left_neighbours():
    core = bytes(range(97, 97 + 26)) * 4
    texts = [b"X" + core + b"Q", b"Y" + core + b"R", b"Y" + core + b"S"]
    found = suffix_dedup.repeats(texts, np.zeros(3, np.int64))
    assert {(tuple(sorted(o.tolist())), n) for o, _, n in found} >= {((0, 1, 2), 104), ((1, 2), 105)}
    assert all(len(o) > 1 and n >= 100 for o, _, n in found)


def test_pieces_round_trip(spark, docs):
    got = {r["doc_id"]: r for r in rows(queries.op4_sentencepiece(spark, SF))}
    for d in docs:
        text = (d["text"] or "").replace("▁", " ")
        assert got[d["doc_id"]]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_pieces_of_odd_rows(odd, none):
    found = {r["row"]["doc_id"]: r for r in rows(transducer.decode(transducer.encode(odd, PIECES), PIECES))}
    assert found[3]["n_ids"] == found[4]["n_ids"] == 0 and found[5]["text"] == " \t\n " and found[8]["text"].endswith("é   😀")
    assert transducer.encode(none, PIECES).count() == 0


def test_pieces_decode_as_the_library_does():
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    texts = ["Hello  world 😀\n x", " lead", "naïve café 123", "日本"]
    ids, offsets = transducer.load(PIECES).encode(pa.array(texts))
    for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
        assert model.decode(ids[a:b].tolist()) == text


def test_fingerprints_estimate_generalised_jaccard(spark, docs):
    got = {r["doc_id"]: r for r in rows(queries.op5_document_fingerprints(spark, SF))}
    ordered = sorted(docs, key=lambda d: -d["doc_id"])
    bag = lambda t: Counter(tuple(w[k : k + 5]) for w in [words(t)] if w for k in range(max(1, len(w) - 4)))
    errors, prints = [], {}
    for d, after in zip(ordered, ordered[1:] + ordered[:1]):
        t, nxt = d["text"] or "", after["text"] or ""
        edited, r = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3], got[d["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = bag(t), bag(edited)
        errors.append(r["near_edited"] - (sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0))
        assert prints.setdefault(t.translate(LOWER), r["fingerprint"]) == r["fingerprint"]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.1


def test_fingerprints_of_odd_rows(odd, none):
    got = [r for r in rows(fingerprints(odd))]
    assert len(got) == 12 and {r["fingerprint"] for r in got if r["doc_id"] in (3, 4, 5)} == {""}
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (8, 9)}) == 1
    assert fingerprints(none).count() == 0


def test_elias_fano():
    draw = np.random.default_rng(1)
    for values in ([], [0], [5], [0, 0, 0], np.cumsum(draw.integers(0, 900, 3000)), np.sort(draw.integers(0, 10**12, 777))):
        values = np.asarray(values, np.int64)
        packed = EliasFano.of(values)
        for a, b in ((0, len(values)), (len(values) // 3, len(values) // 2), (max(0, len(values) - 1), len(values))):
            assert packed.select(a, b).tolist() == values[a:b].tolist()


def test_token_files_match_the_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    model, start, want = Tokenizer.from_file(WORDS), 0, []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = [*model.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        want.append((d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = rows(queries.op6_token_files(spark, SF))
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_token_files_of_rows_without_doc_id(spark):
    texts = [(i if i % 3 else None, f"text number {i}") for i in range(400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted(rows(read_documents(write_tokens(frame, WORDS))), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in texts if i) + [None] * 134
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    alone = frame.filter("doc_id is null")
    assert sorted(r["ids_crc32"] for r in rows(read_documents(write_tokens(alone, WORDS)))) == sorted(r["ids_crc32"] for r in got[-134:])


def test_token_files_of_odd_rows(odd, none):
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in rows(read_documents(write_tokens(odd, WORDS))))
    assert len(got) == 12 and [n for _, i, n in got if i in (3, 4, 5)] == [1, 1, 1]
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))
    assert read_documents(write_tokens(none, WORDS)).count() == 0


def test_archives_match_brute_force(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    largest = {}
    for p in pages:
        largest[p["html"]] = max(largest.get(p["html"], -1), p["page_id"])
    got = {r["page_id"]: r for r in rows(queries.op7_warc(spark, SF))}
    assert len(got) == len(pages)
    for p in pages:
        r, payload = got[p["page_id"]], (p["html"] or "").encode()
        kind = "response" if largest[p["html"]] == p["page_id"] else "revisit"
        assert (r["payload_bytes"], r["record_type"]) == (len(payload), kind)


def test_archives_of_odd_rows(spark):
    schema = "page_id long, url string, html string, key string, size int"
    data = [(1, "http://A.example.org/x", "same", "k", 1), (2, None, "same", "k", 1), (3, "http://a.example.org/x", None, "k", 1),
            (4, "not a url\n", "", "k", 1), (5, "http://a.example.org/x", "é" * 9, "k", 1)]
    pages = spark.createDataFrame(data, schema)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows(read_captures(write_archives(pages), pages))}
    assert got == {1: (4, "revisit", 2), 2: (4, "response", None), 3: (0, "revisit", 4), 4: (0, "response", None), 5: (18, "response", None)}
    assert read_captures(write_archives(pages.limit(0)), pages.limit(0)).count() == 0
    assert url_key("http://www.Example.org:80/a?b") == "org,example,www)/a?b" and capture_key(None, None).endswith(" None")


def test_language_model_base_scores(spark, docs):
    token = {d["doc_id"]: [*words(d["text"]), None] for d in docs}
    counts = Counter(w for i, ws in token.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = rows(queries.op8_language_model(spark, SF))
    assert len(got) == len(docs)
    for r in got:
        ws = token[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_rare_tokens_are_joined_exactly(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a, b = (
        {r["row"]["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in rows(bloom_lm.score(frame, F.col("doc_id") % 2 == 0, top=t))}
        for t in (5, 1 << 17)
    )
    assert a == b


def test_filter_never_underestimates(spark):
    data = [(int(i) * 2654435761 % (1 << 63), 1 + i % 40) for i in range(2000)]
    model = bloom_lm.build_filter(spark.createDataFrame(data, "name long, n long"), bits=21)
    levels = model.levels(np.array([d[0] for d in data], np.int64).view(np.uint64))
    assert all(q >= 1 + math.floor(math.log2(n)) for q, (_, n) in zip(levels, data))
    assert np.mean(levels > [1 + math.floor(math.log2(n)) for _, n in data]) < 0.05


def brute_scores(texts, train):
    """Scores with the level of every n-gram of the training texts."""
    known = Counter(w for i in train for w in ["<s>", *words(texts[i]), "</s>"])
    double = Counter(p for i in train for p in itertools.pairwise(["<s>", *words(texts[i]), "</s>"]))
    n = sum(known.values()) - known["<s>"]
    total = n + len(known.keys() - {"<s>"}) + 1
    weight = min(0.95, max(0.01, sum(c for c in double.values() if c > 1) / n))

    def middle(c):
        level = c.bit_length()
        return math.sqrt(2 ** (level - 1) * (2**level - 1)) if c else 0.0

    out = {}
    for i, text in texts.items():
        out[i] = 0.0
        for a, b in itertools.pairwise(["<s>", *words(text), "</s>"]):
            one, context, two = middle(known[b]), middle(known[a]), middle(double[a, b])
            share = min(1.0, two / max(context, two, 1.0)) if two else 0.0
            out[i] += math.log10(weight * share + (1 - weight) * (one + 1) / total)
    return out


def test_language_model_scores_pairs_seen_once(spark):
    texts = {2: "red green blue", 4: "red green grey", 6: "one two", 1: "one two blue", 3: "two one grey", 5: None}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["score"] for r in rows(bloom_lm.score(frame, F.col("doc_id") % 2 == 0))}
    want = brute_scores(texts, [i for i in texts if i % 2 == 0])
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in texts)


@pytest.mark.parametrize("bits", [6, 28])
def test_size_of_the_filter_changes_no_score(spark, bits):
    texts = {i: " ".join(f"w{(i * j * j + j) % (3 + j)}" for j in range(30)) for i in range(40)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["score"] for r in rows(bloom_lm.score(frame, F.col("doc_id") % 3 > 0, bits=bits))}
    want = brute_scores(texts, [i for i in texts if i % 3])
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in texts)


@pytest.mark.parametrize("bits", [7, 8])
def test_scores_where_only_the_lowest_levels_are_left_out(spark, bits):
    texts = {i: f"a b {'c d' if i < 4 else f'x{i} y{i}'}" for i in range(9)} | {20: "a b x5 z y6"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["score"] for r in rows(bloom_lm.score(frame, F.col("doc_id") < 9, bits=bits))}
    want = brute_scores(texts, [i for i in texts if i < 9])
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in texts)


def test_language_model_of_odd_rows(odd, none):
    got = {r["row"]["doc_id"]: r for r in rows(bloom_lm.score(odd, F.col("doc_id") < 9))}
    assert got[3]["n_tokens"] == got[4]["n_tokens"] == got[5]["n_tokens"] == 1
    assert rows(bloom_lm.score(odd, F.lit(False)))[0]["train_tokens"] == 0
    assert bloom_lm.score(none, F.lit(True)).count() == 0


def test_near_vectors_recall(spark):
    draw = np.random.default_rng(3)
    base = draw.standard_normal((300, 64))
    near = base[:200] + draw.standard_normal((200, 64)) * draw.uniform(0.05, 0.45, (200, 1))
    table = np.concatenate([base, near, base[:5]]).astype(np.float32)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(table)], "vec_id long, embedding array<float>")
    unit = table.astype(float) / np.linalg.norm(table.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r for r in rows(near_vectors(frame))}
    counts = np.array([got[i]["n_links"] for i in range(len(table))])
    assert (counts <= linked.sum(axis=1)).all() and counts.sum() >= 0.97 * linked.sum()
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_near_vectors_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, rep int, raw string"
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (3, [1.0, 0.0])]
    frame = spark.createDataFrame([(*d, 1, "x") for d in data], schema)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rows(near_vectors(frame)))
    assert got == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (3, 3, 1), *[(i, 0, i) for i in range(4, 12)]]
    assert near_vectors(frame.limit(0)).count() == 0


def test_mix_reaches_its_targets(spark, docs):
    got = rows(queries.op10_mix_sources(spark, SF))
    assert got == rows(queries.op10_mix_sources(spark, SF))
    source, size = {d["doc_id"]: d["source"] for d in docs}, {d["doc_id"]: len(words(d["text"])) for d in docs}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    names = sorted(total)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(total.values())
    while free:
        whole = sum(weight[n] for n in free)
        over = [n for n in free if left * weight[n] / whole > 2 * total[n]]
        for n in over or list(free):
            target[n] = 2.0 * total[n] if over else left * weight[n] / whole
        if not over:
            break
        left -= sum(target[n] for n in over)
        free -= set(over)
    taken = Counter()
    for r in got:
        name = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[name]) and r["taken"] <= 2 * r["size"]
        assert math.isclose(r["target"], target[name], rel_tol=1e-9)
        taken[name] += r["taken"]
    largest = {n: max(size[i] for i in size if source[i] == n) for n in names}
    assert all(abs(taken[n] - target[n]) <= largest[n] / 2 + 1 for n in names)


def test_equal_rows_share_all_their_copies(spark):
    data = [(1, "a", "one two three")] * 100 + [(None, None, "four five")] * 7 + [(2, "b", "six")]
    frame = spark.createDataFrame(data, "doc_id long, source string, text string")
    mixed = mix_sources(frame, weights=(1, 1, 1), share=0.6, most=1).cache()
    want = {(r["doc_id"], r["source"]): r["n"] for r in mixed.groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()}
    got = Counter((r["doc_id"], r["source"]) for r in take(frame, mixed).collect())
    assert 0 < want[1, "a"] < 100 and got == Counter({k: n for k, n in want.items() if n})


def test_mix_of_odd_rows(odd, none):
    mixed = mix_sources(odd)
    got = rows(mixed)
    assert len(got) == 12 and all(r["copies"] == 0 for r in got if r["size"] == 0)
    assert {r["source"] for r in got} == {"a", "b", "c", None}
    assert take(odd, mixed).columns == odd.columns
    assert mix_sources(none).count() == 0
