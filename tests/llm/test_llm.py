"""The numbered operators against brute force, exact round trips and held-out rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.llm import bpe, language, order_minhash, packing, pages, quality, sharding, simhash, token_files, toxicity
from veriframe.llm.tokens import vocabulary_path

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("kept", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("n_words", T.StringType()),
])
LONG = "word number and another " * 30_000
ODD = [
    (1, "a b c d e f g h i j k", "en", "s", 1, None, None, None),
    (1, "a b c d e f g h i j k", "en", "s", 1, "x", "y", "z"),
    (2, None, None, None, None, None, None, None),
    (None, "", "en", None, 0, None, None, None),
    (None, None, None, "s", None, None, None, None),
    (4, LONG, "en", "s", None, None, None, None),
    (5, "   \n\t ", "de", "s", None, None, None, None),
    (6, "A B C D E F G H I J K", "en", "s", 1, None, None, None),
    (7, "<|endoftext|> 日本語 text\x1cé \U0001F600 ŒUVRE İstanbul", None, "s", None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def test_bpe_equals_the_library(spark, docs, rows, odd, empty, library):
    for table, texts in ((docs, rows), (odd, [(r[0], r[1]) for r in ODD])):
        got = sorted(map(tuple, bpe.encode_documents(table).collect()), key=str)
        want = []
        for doc_id, text in texts:
            ids = ids_of(library, text)
            decoded = library.decode(ids.tolist(), skip_special_tokens=False)
            want.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        assert got == sorted(want, key=str)
    assert bpe.encode_documents(empty).collect() == []


def test_bpe_blocks_forgetting_and_decoding(library, rows, monkeypatch):
    """Small blocks and a memory that is cleared all the time change no id; any ids are decoded."""
    texts = [t for _, t in rows[:80]] + [None, "", "word " * 50]
    monkeypatch.setattr(bpe, "BLOCK", 3_000)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    coder = bpe.Encoder(vocabulary_path())
    blocks = list(bpe.text_blocks(texts))
    assert [t for b in blocks for t in b] == texts and len(blocks) > 5
    assert all(len(b) == 1 or sum(len(t or "") for t in b) <= 3_000 for b in blocks)
    assert [i for b in blocks for i in coder.encode_all(b)] == [ids_of(library, t).astype("<u4").tobytes() for t in texts]
    ids = np.random.default_rng(3).integers(0, library.get_vocab_size(), 5_000).tolist()
    assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_goes_back_to_a_lower_rank():
    coder = bpe.Encoder(vocabulary_path())
    words = ["".join(w) for w in np.random.default_rng(1).choice(list("abetinhrs"), (400, 9))]
    alone = [coder.merge([w])[0] for w in words]
    assert coder.merge(words) == alone
    assert alone == [[t.id for t in coder.splitter.model.tokenize(w)] for w in words]


def check_packing(table, texts, library):
    got = packing.pack_documents(table).collect()
    want = sorted((d, np.append(ids_of(library, t), 1).astype("<u4").tobytes()) for d, t in ((-1 if d is None else d, t) for d, t in texts))
    pieces = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    assert pieces == sorted((d, k, at // 4, len(b[at : at + 16384]) // 4, zlib.crc32(b[at : at + 16384])) for d, b in want for k, at in enumerate(range(0, len(b), 16384)))
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(e <= 4096 for e in ends.values())
    return len(ends), -(-sum(p[3] for p in pieces) // 4096)


def test_packing(docs, rows, odd, empty, library):
    bins, least = check_packing(docs, rows, library)
    assert bins <= least + 1
    check_packing(odd, [(r[0], r[1]) for r in ODD], library)
    assert packing.pack_documents(empty).collect() == []


def test_underfull_bins_of_groups_meet(spark):
    lengths = np.random.default_rng(8).integers(1, 60, 2000).tolist()
    table = spark.createDataFrame([(k, 0, 0, n, 0, k) for k, n in enumerate(lengths)], packing.PIECES)
    got = packing.packed(packing.cut(table), 100, 50).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == list(enumerate(lengths))
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 100
    print("bins", len(ends), "of at least", -(-sum(lengths) // 100))
    assert len(ends) <= -(-sum(lengths) // 100) + 3


def test_local_search_empties_bins():
    # Best fit leaves a bin too many here; exchanges drain it.
    lengths = [6, 6, 5, 5, 5, 4, 4, 3, 2]
    start = [[0], [1, 6], [2, 3], [4, 5], [7, 8]]
    end = packing.local_search(lengths, start, 10)
    assert sorted(i for b in end for i in b) == list(range(9)) and all(sum(lengths[i] for i in b) <= 10 for b in end)
    assert len(end) < len(start)
    for seed in range(30):
        lengths = np.random.default_rng(seed).integers(1, 60, 80).tolist()
        bins = packing.pack(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(80)) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= -(-sum(lengths) // 100) + 1


def test_token_files_round_trip(docs, rows, odd, empty, library):
    for table, texts in ((docs, rows), (odd, [(r[0], r[1]) for r in ODD])):
        got = sorted((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"]) for r in token_files.token_round_trip(table).collect())
        ids = {}
        for d, t in texts:
            b = np.append(ids_of(library, t), 1).astype("<u4")
            ids.setdefault(d, []).append((len(b), zlib.crc32(b.tobytes())))
        at = 0
        for start, n, crc, doc_id in got:
            assert start == at and (n, crc) in ids[doc_id]
            ids[doc_id].remove((n, crc))
            at += n
        assert not any(ids.values())
        order = [-1 if g[3] is None else g[3] for g in got]
        assert order == sorted(order)
    assert token_files.token_round_trip(empty).collect() == []


def test_any_token_by_itself(tmp_path):
    ids = np.random.default_rng(3).choice([0, 1, 255, 256, 49407, 70000, 2**31], 3000).astype("<u4")
    levels = token_files.encode_levels(ids)
    assert len(levels) == 4
    assert [token_files.token_at(levels, i) for i in range(0, 3000, 7)] == ids[::7].tolist()
    assert (token_files.decode_levels(levels) == ids).all()
    writer = token_files.FileWriter(str(tmp_path / "a" / "x.dac"))
    for k in range(0, 3000, 100):
        writer.add(k, ids[k : k + 100].tobytes())
    writer.close()
    reader = token_files.FileReader(str(tmp_path / "a" / "x.dac"))
    assert [reader.token(i) for i in (0, 1, 511, 512, 2999)] == ids[[0, 1, 511, 512, 2999]].tolist()
    assert all((got == ids[d : d + 100]).all() for d, _, got in reader.documents())


def test_a_token_needs_few_bytes(tmp_path, monkeypatch):
    ids = np.random.default_rng(5).choice([0, 255, 256, 49407, 2**31], 20000).astype("<u4")
    writer = token_files.FileWriter(str(tmp_path / "z.dac"))
    for k in range(0, 20000, 1000):
        writer.add(k, ids[k : k + 1000].tobytes())
    writer.close()
    reader = token_files.FileReader(str(tmp_path / "z.dac"))
    file, sizes = reader.file, []

    class Counted:
        def read_at(self, n, at):
            sizes.append(n)
            return file.read_at(n, at)

    reader.file = Counted()
    for i in range(0, 20000, 97):
        sizes.clear()
        assert reader.token(i) == ids[i] and sum(sizes) <= 4 * (1 + 64 + 4)
    reader.file = file
    assert (np.concatenate([d for _, _, d in reader.verified()]) == ids).all()
    monkeypatch.setattr(token_files.FileReader, "token", lambda self, i: -1)
    with pytest.raises(ValueError, match="by itself"):
        list(reader.verified())


def test_segments_that_cut_documents(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 64)
    parts = [np.random.default_rng(k).integers(0, 50000, n).astype("<u4") for k, n in enumerate([10, 200, 1, 64, 63, 300, 5])]
    writer = token_files.FileWriter(str(tmp_path / "y.dac"))
    for k, part in enumerate(parts):
        writer.add(k, part.tobytes())
    writer.close()
    reader = token_files.FileReader(str(tmp_path / "y.dac"))
    got = list(reader.documents())
    assert all((a == g[2]).all() for a, g in zip(parts, got, strict=True))
    flat = np.concatenate(parts)
    assert [reader.token(i) for i in range(len(flat))] == flat.tolist()


def test_sharding(spark, docs, odd, empty):
    got = sharding.shard_documents(docs).collect()
    assert sorted(r["doc_id"] for r in got) == [r["doc_id"] for r in docs.select("doc_id").orderBy("doc_id").collect()]
    for s in range(8):
        own = [r["slot"] for r in got if r["shard"] == s]
        assert sorted(own) == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    strange = sharding.shard_documents(odd).collect()
    assert len(strange) == len(ODD)
    assert len({r["shard"] for r in strange if r["doc_id"] == 1}) == 1
    for s in range(8):
        own = [r["slot"] for r in strange if r["shard"] == s]
        assert sorted(own) == list(range(len(own)))
    assert sharding.shard_documents(empty).collect() == []
    copies = spark.range(25_000).select(F.lit(9).alias("doc_id"), F.lit("same").alias("text"))
    assert sorted(r["slot"] for r in sharding.shard_documents(copies).collect()) == list(range(25_000))


def test_shard_weights(spark):
    shares = sharding.with_shard(spark.range(20_000), "id", [1.0, 3.0]).groupBy("shard").count().orderBy("shard").collect()
    assert abs(shares[1]["count"] / 20_000 - 0.75) < 0.02


def link_by_force(prints):
    label = list(range(len(prints)))
    values = np.array(prints, dtype=np.int64).view(np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1:
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def slow_fingerprint(text):
    import xxhash

    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, odd, empty):
    for table, texts in ((docs, rows), (odd, [(r[0], r[1]) for r in ODD if r[1] is None or len(r[1]) < 1000])):
        if table is odd:
            table = table.where("doc_id IS NULL OR doc_id <> 4")
        got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table).collect())
        prints = [slow_fingerprint(t) for _, t in texts]
        label = link_by_force([p - (1 << 64) if p >> 63 else p for p in prints])
        least = {}
        for k, (d, _) in zip(label, texts, strict=True):
            least[k] = min(x for x in (least.get(k), d) if x is not None) if (least.get(k), d) != (None, None) else None
        assert got == sorted((-1 if d is None else d, f"{p:016x}", least[k]) for (d, _), p, k in zip(texts, prints, label, strict=True))
    assert simhash.near_duplicates(empty).collect() == []


def test_trie_join_finds_all_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "UNIT_ROWS", 16)
    rng = np.random.default_rng(5)
    centres = rng.integers(-(2**63), 2**63 - 1, 40)
    values = set(centres.tolist())
    for c in centres[:6].tolist():  # dense groups, larger than a unit
        for _ in range(60):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            v = (c ^ sum(1 << int(b) for b in flips)) & (2**64 - 1)
            values.add(v - (1 << 64) if v >> 63 else v)
    values = sorted(values)
    frame = spark.createDataFrame([(v,) for v in values], "_fp long")
    got = {r["fp"]: r["cls"] for r in simhash.classes(frame).collect()}
    label = link_by_force(values)
    pairs = {(got[v], k) for v, k in zip(values, label, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components_by_contraction(spark):
    from veriframe.llm.components import components

    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    whole = {r["node"]: r["component"] for r in components(edges).collect()}
    rounds = {r["node"]: r["component"] for r in components(edges, last_edges=5).collect()}
    assert whole.keys() == rounds.keys() == {x for p in pairs if p[0] != p[1] for x in p}
    both = {(whole[n], rounds[n]) for n in whole}
    assert len(both) == len({a for a, _ in both}) == len({b for _, b in both}) and all(whole[a] == whole[b] for a, b in pairs if a != b)


def test_near_dedup_keeps_one_of_each_group(docs, odd, empty):
    kept = simhash.near_dedup(docs)
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values()))
    assert simhash.near_dedup(odd).where("doc_id = 1").count() == 1
    assert simhash.near_dedup(empty).collect() == []


def slow_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(docs, rows, odd, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for table, texts in ((docs, rows), (odd, [(r[0], r[1]) for r in ODD])):
        got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), *[r[n] for n in names]) for r in quality.quality_verdicts(table).collect())
        assert got == sorted((-1 if d is None else d, *slow_statistics(t)) for d, t in texts)
    assert quality.quality_verdicts(empty).collect() == []


def test_quality_rejects_junk_and_keeps_clean(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_verdicts(docs).where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    counts = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert counts.get((1, False), 0) == 0
    assert counts.get((0, True), 0) <= 0.1 * counts[0, False]


def test_mcd_resists_outliers_and_equals_numpy(spark):
    rng = np.random.default_rng(2)
    good = rng.normal(size=(3000, 6)) * 0.5 + np.arange(6)
    bad = rng.normal(size=(600, 6)) * 0.1 + 30
    points = spark.createDataFrame([("g", *map(float, x)) for x in np.concatenate([good, bad])], ["k", *quality.AXES])
    fit = quality.mcd(points, ["k"]).first()
    assert np.allclose([fit[f"m_{a}"] for a in quality.AXES], np.arange(6), atol=0.1)
    lower = np.array([[fit[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(6)] for i in range(6)])
    moment = np.array([[fit[f"s_{quality.AXES[min(i, j)]}_{quality.AXES[max(i, j)]}"] for j in range(6)] for i in range(6)]) * 1.6
    product = lower @ lower.T
    off = ~np.eye(6, dtype=bool)
    assert np.allclose(product[off], moment[off], atol=1e-9)


def test_keep_good_keeps_columns(docs, odd, empty):
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(empty).collect() == []
    assert {r["doc_id"] for r in quality.keep_good(odd).collect()} <= {1, 4, 6}


def test_order_minhash_edits(docs, rows, odd, empty):
    got = {r["doc_id"]: r for r in order_minhash.edited_fingerprints(docs).collect()}
    for k, (doc_id, text) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[doc_id]["n_chars"] == len(text)
    assert np.mean([r["near_edited"] for r in got.values()]) > 10 * np.mean([r["near_next"] for r in got.values()])
    by_text = {}
    for doc_id, text in rows:
        assert by_text.setdefault(text, got[doc_id]["fingerprint"]) == got[doc_id]["fingerprint"]
    strange = order_minhash.edited_fingerprints(odd).collect()
    assert len(strange) == len(ODD) and all(0 <= r["near_next"] <= 1 for r in strange)
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t, n in ((ordered[i][1] or "", ordered[(i + 1) % len(ordered)][1] or "") for i in range(len(ordered))))
    assert sorted(r["edited_sha256"] for r in strange) == want
    assert order_minhash.edited_fingerprints(empty).collect() == []


def test_order_minhash_feels_order(spark):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    mixed = [words[i] for i in np.random.default_rng(1).permutation(400)]
    frame = spark.createDataFrame([(" ".join(w),) for w in (words, words[:380] + ["new"] * 20, moved, mixed)], "text string")
    prints = [r["fp"] for r in order_minhash.with_fingerprint(frame, "text", "fp").collect()]
    near = [sum(prints[0][i : i + 4] == p[i : i + 4] for i in range(0, 256, 4)) / 64 for p in prints]
    assert near[0] == 1 and near[1] > 0.7 and near[3] < 0.1 and near[1] > near[2]


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.99
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    strange = language.identify(odd).collect()
    assert len(strange) == len(ODD)
    assert all(r["lang_pred"] == "und" for r in strange if r["doc_id"] in (2, 5))
    assert language.identify(empty).collect() == []


def test_codewords_are_apart():
    for classes in (2, 3, 4, 6, 12):
        code = language.codewords(classes)
        distance = [(code[i] != code[j]).sum() for i in range(classes) for j in range(i)]
        assert min(distance) >= (1 if classes == 2 else 2 if classes == 3 else 4)


def test_toxicity(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs.join(labels, "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out").collect()
    # Measured: 0.95 with the 320 toxic rows of this table (0.999 with the 800 of the check's small one).
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.93
    assert np.mean([r["predicted"] for r in got if r["toxic"]]) > 0.85
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    strange = toxicity.score_documents(odd, labels).collect()
    assert len(strange) == len(ODD) and all(r["predicted"] == 0 for r in strange if r["doc_id"] in (2, 5))
    assert toxicity.score_documents(empty, labels).collect() == []


def test_string_kernel_by_force():
    kernel = toxicity.Kernel(["idiot", "the"])

    def weights(word):
        word, out = toxicity.START + word, {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                    out[word[i] + word[j] + word[k]] = out.get(word[i] + word[j] + word[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out

    for word in ("idiot", "idioti", "axe", "theidio"):
        own, mark = weights(word), weights("idiot")
        plain = sum(v * mark.get(s, 0) for s, v in own.items()) / np.sqrt(sum(v * v for v in mark.values()))
        _, _, each = toxicity.subsequences([word])
        assert np.isclose(kernel.values([word])[0, 0], plain / np.sqrt((each**2).sum()), atol=1e-5)


def test_gapped_insults_score_like_the_word(spark):
    clean = ["the day was long and they went home to eat soup", "we read of many towns and rivers in that book"] * 40
    toxic = [t.replace(" and ", " idiot and ") for t in clean]  # nothing else sets them apart
    model = toxicity.train([f"{t} {i}" for i, t in enumerate(clean + toxic)], [0] * len(clean) + [1] * len(toxic))
    reader = toxicity.Sentences(model.kernel)
    texts = ["they went to an i d i o t and home", "an id.i.ot and they went", "an idiiot and they went", "they went home to eat", ""]
    scores = model.scores(model.margins(*reader.of(texts)))
    assert (scores[:3] >= 0.5).all() and (scores[3:] < 0.5).all()


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">one</a><li>two</ul></nav><!-- note --><div class="ad">buy now</div>
<article><h1>Head{0}</h1><p>A <b>bo</b>ld&nbsp;text &lt; {0}<p>second<br>line<div class="comments"><p>first!</p></div></article>
<aside>side</aside><form>name</form><footer>&copy; all</footer></body></html>"""


def test_pages(spark, empty):
    schema = "page_id long, url string, html string, text string"
    rows = [(k, "http://h.example/x", PAGE.format(k), "clash") for k in range(4)]
    menu = "home about contact prices offers staff news archive"
    rows += [(k, "http://g.example/x", f"<div><p>{menu}</p><p>n{k} words of its own <i>{k}</i>x</p></div>", None) for k in range(10, 14)]
    rows += [(20, None, None, None), (None, "", "", None), (20, None, None, None), (21, "http://h.example", "a < b <p>c", None)]
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in pages.extract(spark.createDataFrame(rows, schema)).collect())
    want = [(str(k), f"Head{k} A bold text < {k} second line") for k in range(4)]
    want += [(str(k), f"n{k} words of its own {k}x") for k in range(10, 14)]
    want += [("20", ""), ("None", ""), ("20", ""), ("21", "a < b c")]
    assert got == sorted((k, t, len(t)) for k, t in want)
    assert pages.extract(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize(("html", "text"), [
    ("<p title=it's>Hello world, don't go</p>", "Hello world, don't go"),
    ("<p title=it's>Hello world</p>", "Hello world"),
    ("<article><a title=\"x>y\" rel = 'a>b'>link</a> on</article>", "link on"),
    ("<article><p>one</p><div class='post-comments'>no</div><p>two</p></article>", "one two"),
    ("<article><p>one</p><section id=article-comments>no</section><div class='content-ad'>no</div></article>", "one"),
    ("<article><div class='content has-sidebar'>one</div><div class='entry no-comments'>two</div></article>", "one two"),
    ("<article>half <math><mi>x</mi></math> of it<noscript>told without scripts</noscript></article>", "half x of it told without scripts"),
    ("<article>one <svg width=1/> two <svg><text>no</text></svg></article>", "one two"),
])
def test_parts_of_a_page(html, text):
    tokens, zones = pages.laid_out(html)
    assert " ".join(t for t, z in zip(tokens, zones.tolist(), strict=True) if z != pages.OUT) == text


def test_a_very_long_page(spark):
    words = [f"w{k}" for k in range(300_000)]
    html = "<nav>menu</nav><article>" + "".join(f"<p>{w}</p>" for w in words[:150_000]) + "<p>" + " ".join(words[150_000:]) + "</p></article>"
    row = pages.extract(spark.createDataFrame([(1, None, html)], "page_id long, url string, html string")).first()
    assert row["text"] == " ".join(words)


def test_copies_of_pages_keep_their_text(spark):
    menu, text = "home about contact prices offers staff news archive", "one two three four five six seven eight nine"
    page = "<div><p>{}</p><p>{}</p></div>"
    rows = [(1, "http://a.example/1", page.format(menu, text))] * 2  # repeated rows
    rows += [(2, "http://a.example/2", f"<body>{page.format(menu, text)}</body>")]  # the same text
    rows += [(3, "http://a.example/3", page.format(menu, "its own words"))]
    rows += [(4, "http://b.example/1", page.format(menu, text)), (5, "http://b.example/2", page.format(menu, text))]
    got = sorted((r["page_id"], r["text"]) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, text), (1, text), (2, text), (3, "its own words"), (4, f"{menu} {text}"), (5, f"{menu} {text}")]


def test_runs_are_counted_over_all_shards(spark, monkeypatch):
    rng = np.random.default_rng(9)
    phrases = [" ".join(rng.choice(list("abcdefgh"), 9)) for _ in range(12)]
    rows = []
    for k in range(120):
        own = [" ".join(f"w{k % 50}x{n}" for n in range(a, a + 6)) for a in (0, 6)]
        said = [phrases[j] for j in rng.integers(0, len(phrases), 3)]
        body = f"<p>{own[0]}</p><p>{said[0]}</p><div class=menu>{said[1]}</div><p>{own[1]} {said[2]}</p>"
        rows.append((k, f"http://{'ab'[k % 7 == 0]}.example/{k}", f"<article>{body}</article><p>{said[0]}</p>" if k % 3 == 0 else body))
    want = []
    for host in "ab":
        own = [(k, *pages.laid_out(html)) for k, url, html in rows if url.startswith(f"http://{host}.")]
        number = {}
        distinct = {(number.setdefault(tuple(t), len(number)), z.tobytes()): (t, z) for _, t, z in own}
        word = {}
        tokens = np.array([word.setdefault(t, len(word)) for t, _ in distinct.values() for t in t])
        page = np.concatenate([np.full(len(t), k) for (k, _), (t, _) in distinct.items()])
        zones = np.concatenate([z for _, z in distinct.values()])
        covered, at, drops = pages.repeated(tokens, page, zones != pages.MAIN), 0, {}
        for key, (t, _) in distinct.items():
            drops[key], at = covered[at : at + len(t)], at + len(t)
        for k, t, z in own:
            drop = drops[number[tuple(t)], z.tobytes()] & (z != pages.MAIN)
            want.append((k, " ".join(w for w, d, zone in zip(t, drop, z, strict=True) if zone != pages.OUT and not d)))
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for size in (1, 400, pages.SHARD_BYTES):
        monkeypatch.setattr(pages, "SHARD_BYTES", size)
        assert sorted((r["page_id"], r["text"]) for r in pages.extract(table).collect()) == sorted(want), size
    assert len({t for _, t in want}) > 40


def test_repeated_runs_by_force():
    rng = np.random.default_rng(4)
    tokens, page, outside = rng.integers(0, 3, 400), np.repeat(np.arange(8), 50), rng.random(400) < 0.6
    where = {}
    for i in range(400 - 3):
        if page[i] == page[i + 3]:
            where.setdefault(tuple(tokens[i : i + 4]), []).append(i)
    want = np.zeros(400, dtype=bool)
    for places in where.values():
        if len({page[i] for i in places}) > 1 and 2 * sum(outside[i] for i in places) >= len(places):
            for i in places:
                want[i : i + 4] = True
    assert (pages.repeated(tokens, page, outside, 4) == want).all()


def test_pipeline_is_its_stages_by_force(spark, library):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in quality.quality_verdicts(docs).where("kept").collect()}
    left = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    model = toxicity.train(*toxicity.sample(docs.where(F.col("doc_id").isin(*good)), labels))
    if model:
        reader = toxicity.Sentences(model.kernel)
        left = {d: t for d, t in left.items() if model.scores(model.margins(*reader.of([t])))[0] < 0.5}
    ids = sorted(left)
    prints = [slow_fingerprint(left[d]) for d in ids]
    label = link_by_force([p - (1 << 64) if p >> 63 else p for p in prints])
    kept = {ids[k] for k in set(label)}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == kept
    for d in kept:
        own = np.append(ids_of(library, left[d]), 1).astype("<u4")
        assert sorted((r["piece"], r["length"]) for r in got if r["doc_id"] == d) == [(k, len(own[a : a + 4096])) for k, a in enumerate(range(0, len(own), 4096))]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "simhash near-dedup", "best-fit packing"]


def test_site_runs_leave_articles(spark, monkeypatch):
    notice, quote = "please read our terms of use before you write to us", "a line that some articles of this host say again"
    rows = []
    for k in range(40):
        said = f"<p>{quote}</p>" if k % 3 == 0 else ""
        note = f"<p>{notice}</p>" if k % 8 else ""
        rows.append((k, "http://a.example/", f"<nav>n{k}</nav><article><p>{' '.join(f'w{k}x{n}' for n in range(30))}</p>{said}{note}<p>end {notice} {k}</p></article>"))
    near = " ".join(f"v{n}" for n in range(20))
    rows += [(100 + k, "http://b.example/", f"<article><p>{near}</p><p>{k}</p></article>") for k in range(6)]  # near copies
    rows += [(200 + k, "http://c.example/", f"<nav>{k}</nav><article><p>{near}</p></article>") for k in range(30)]  # one article
    rows += [(300 + k, "http://d.example/", f"<article><p>{notice}</p><p>{' '.join(f'd{k}x{n}' for n in range(30))}</p></article>") for k in range(3)]  # too few
    want = {k: " ".join(pages.laid_out(html)[0][n] for n in np.flatnonzero(pages.laid_out(html)[1] == pages.MAIN)) for k, _, html in rows}
    kept = dict(want)
    for k in range(40):
        want[k] = kept[k].replace(f" {notice} end", " end")
    assert sum(want[k] != kept[k] for k in want) == 35
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for size in (1, 900, pages.SHARD_BYTES):
        monkeypatch.setattr(pages, "SHARD_BYTES", size)
        got = {r["page_id"]: r["text"] for r in pages.extract(table).collect()}
        assert got == want, size
