"""Archives, fill-in-middle frames and the prefix trie against brute force and damaged inputs."""

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from veriframe.llm import fill_middle, hot_keys, prefix_trie, warc
from veriframe.llm.storage import arrow_uri

SF = "/root/testdata/sf0.001"


def test_store_names():
    assert arrow_uri("s3a://bucket/a") == "s3://bucket/a" and arrow_uri("/a/b") == "file:///a/b" and arrow_uri("file:///a") == "file:///a"


# ---- archives ------------------------------------------------------------------------------

PAGE = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
    # names that the operator uses itself
    T.StructField("digest", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("first", T.StringType()),
])


def expected_archive(rows):
    """By force: one response per payload, at the smallest (page_id, url)."""
    groups = defaultdict(list)
    for page_id, url, html, *_ in rows:
        groups[(html or "").encode()].append((page_id is None, page_id or 0, url is not None, url or "", page_id))
    out = []
    for payload, members in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        members.sort()
        for k, m in enumerate(members):
            out.append((m[-1], len(payload), digest, "revisit" if k else "response", members[0][-1] if k else None))
    return sorted(out, key=str)


def columns(table, *names):
    return sorted((tuple(r[n] for n in names) for r in table.collect()), key=str)


RESULT = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
PAGES = [
    (3, "http://a/3", "same", "x", "y", "z"), (2, "http://a/2", "same", None, None, None), (9, "http://a/9", "same", None, None, None),
    (4, None, None, None, None, None), (5, "http://a/5", "", None, None, None), (None, None, None, None, None, None), (None, "u", "null id", None, None, None),
    (7, "http://b/\r\nx: y", "line\r\n\r\nends WARC/1.1\r\nWARC-Type: response\r\n\r\n", None, None, None), (8, "http://b/ü", "日本語 \U0001F600 é\x00", None, None, None),
    (10, "http://c", "long " * 700_000, None, None, None), (11, "http://c", "long " * 700_000, None, None, None),
    *[(6, "http://a/6", "repeated row", None, None, None)] * 5, (6, "http://a/60", "repeated row", None, None, None), (-1, "n", "negative", None, None, None),
]


def test_archive_round_trip(spark):
    given = spark.read.parquet(f"{SF}/pages.parquet")
    assert columns(warc.archive_round_trip(given), *RESULT) == expected_archive(map(tuple, given.collect()))
    odd = spark.createDataFrame(PAGES, PAGE).repartition(3)
    assert columns(warc.archive_round_trip(odd), *RESULT) == expected_archive(PAGES)
    assert warc.archive_round_trip(spark.createDataFrame([], PAGE)).collect() == []


def test_small_payloads_are_all_responses(spark):
    got = warc.archive_round_trip(spark.createDataFrame(PAGES, PAGE), min_bytes=6).collect()
    assert all(r["record_type"] == "response" and r["refers_to"] is None for r in got if r["payload_bytes"] < 6)
    assert sum(r["record_type"] == "revisit" for r in got) == 6


def test_revisits_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "BROADCAST_GROUPS", 2)
    rows = [(k, None, f"page {k % 7 if k % 2 else 0}", None, None, None) for k in range(200)]
    assert columns(warc.archive_round_trip(spark.createDataFrame(rows, PAGE)), *RESULT) == expected_archive(rows)


@pytest.mark.parametrize("compressed", [True, False])
def test_archives_keep_payloads_and_split(spark, tmp_path, compressed):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * 300, None, None, None) for k in range(120)]
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGE).coalesce(2), f"file://{tmp_path}", compressed=compressed, file_bytes=9_000)
    assert manifest.count() > 2 and manifest.agg({"n_records": "sum"}).first()[0] == 120
    read = [r for r in warc.read_archives(manifest, with_payload=True).collect() if r["record_type"] == "response"]
    assert sorted((r["url"], bytes(r["payload"]).decode()) for r in read) == sorted((r[1], r[2]) for r in rows)
    if compressed:  # any gzip reader sees the records in a row
        path = manifest.first()["path"].removeprefix("file://")
        assert gzip.open(path).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def archive_of(count, wrap, payload=lambda k: f"payload {k} ".encode() * 40):
    parts = []
    for k in range(count):
        data = payload(k)
        parts.append(wrap(warc.page_record(k, f"http://h/{k}", data, len(data), warc.sha1_label(data), None)))
    return parts


def read_all(data):
    found = list(warc.salvage(Bytes(data)))
    places = [(f[0], f[1]) if isinstance(f, tuple) else (f.start, f.end) for f in found]
    # records and gaps cover the archive without holes
    assert places[0][0] == 0 and places[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(places, places[1:]))
    ids = [int(f.fields["warc-record-id"].split(":")[2]) for f in found if not isinstance(f, tuple)]
    return ids, [f for f in found if isinstance(f, tuple)]


@pytest.mark.parametrize("wrap", [warc.member, bytes])
def test_salvage_after_damage(wrap):
    parts = archive_of(9, wrap)
    at = np.concatenate([[0], np.cumsum(list(map(len, parts)))]).tolist()
    whole = b"".join(parts)
    assert read_all(whole) == (list(range(9)), [])
    # a flipped byte in the middle of a record
    hurt = bytearray(whole)
    hurt[at[3] + len(parts[3]) // 2] ^= 0x55
    ids, gaps = read_all(bytes(hurt))
    assert ids == [0, 1, 2, 4, 5, 6, 7, 8] and [(g[0], g[1]) for g in gaps] == [(at[3], at[4])]
    # a record cut short, bytes of nothing between records, a lost head and a lost tail
    cut_short = whole[: at[2] - 30] + whole[at[2] :]
    ids, gaps = read_all(cut_short)
    assert ids == [0, 2, 3, 4, 5, 6, 7, 8] and [(g[0], g[1]) for g in gaps] == [(at[1], at[2] - 30)]
    noise = b"\x1f\x8b\x08 WARC/1.1\r\nnothing of the kind \x00\x01" * 3
    ids, gaps = read_all(whole[: at[5]] + noise + whole[at[5] :])
    assert ids == list(range(9)) and [(g[0], g[1]) for g in gaps] == [(at[5], at[5] + len(noise))]
    ids, gaps = read_all(whole[7:])
    assert ids == list(range(1, 9)) and gaps[0][:2] == (0, at[1] - 7)
    ids, gaps = read_all(whole[:-9])
    assert ids == list(range(8)) and gaps[0][:2] == (at[8], len(whole) - 9)
    assert read_all(noise)[0] == [] and list(warc.salvage(Bytes(b""))) == []


def test_salvage_of_every_cut():
    parts = archive_of(3, warc.member, lambda k: f"p{k}".encode())
    whole = b"".join(parts)
    ends = np.cumsum(list(map(len, parts))).tolist()
    for n in range(1, len(whole)):
        ids, gaps = read_all(whole[:n])
        assert ids == [k for k in range(3) if ends[k] <= n] and bool(gaps) == (n not in ends)


def test_damaged_payload_that_quotes_a_record():
    inner = warc.page_record(77, "http://q", b"quoted", 6, warc.sha1_label(b"quoted"), None)
    parts = archive_of(3, bytes, lambda k: b"before " + inner + b" after" if k == 1 else b"plain")
    assert read_all(b"".join(parts)) == ([0, 1, 2], [])
    hurt = parts[1].replace(b"before", b"befort")  # the frame holds, the digest doesn't
    ids, gaps = read_all(parts[0] + hurt + parts[2])
    assert ids == [0, 2] and gaps[0][2] == "block digest differs"


def test_salvage_of_records_longer_than_a_step(monkeypatch):
    monkeypatch.setattr(warc, "STEP", 64)
    for wrap in (warc.member, bytes):
        parts = archive_of(5, wrap)
        hurt = bytearray(b"".join(parts))
        hurt[len(parts[0]) + 40] ^= 1
        assert read_all(bytes(hurt))[0] == [0, 2, 3, 4]


def test_mixed_archive_and_foreign_fields():
    own = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-page:5:X:0>\r\nWARC-Date: 2001-01-01T00:00:00Z\r\nX-Folded: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n".encode()
    data = archive_of(2, warc.member)[0] + own + archive_of(2, bytes)[1]
    assert read_all(data) == ([0, 5, 1], [])
    short = own.replace(b"Content-Length: 3", b"Content-Length: 900")
    ids, gaps = read_all(short + own)
    assert ids == [5] and gaps[0][:2] == (0, len(short))


def test_gap_log(spark, tmp_path):
    parts = archive_of(4, warc.member)
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"junk" + parts[1])
    (tmp_path / "b.warc.gz").write_bytes(b"")
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.gz",) for n in "ab"], "path string")
    rows = warc.read_archives(paths).collect()
    assert Counter(r["kind"] for r in rows) == {"record": 2, "gap": 1}
    gap = next(r for r in rows if r["kind"] == "gap")
    assert (gap["start"], gap["end"], gap["reason"]) == (len(parts[0]), len(parts[0]) + 4, "neither a member nor a version line")


# ---- fill in the middle ---------------------------------------------------------------------

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType()),
    T.StructField("data", T.StringType()), T.StructField("form", T.StringType()),
])
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected_middle(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    counts = (None, None) if form == "plain" else (len(p), len(m))
    return (doc_id, n, form, *counts, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), out)


FIM = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")
TEXTS = [None, "", " ", "\n\t ", "word", " word", "word ", "a b", "é日本 \U0001F600\x0b x\x1c y\u00a0z ", "<P> mark", "a <S><", "<M", "x<S", "word " * 50_000, "日本" * 40_000, " " * 90_000 + "x", "a\nb" * 30_000]


def test_fill_middle(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, table in enumerate((docs, spark.createDataFrame([(i, t, "a", "b", "c") for i in (None, *range(40)) for t in TEXTS], DOC).repartition(3))):
        for size in (32_768, 64, 5):
            if size == 5 and not k:
                continue
            rows = [r for r in table.select("doc_id", "text").collect() if size > 5 or len(r["text"] or "") < 100]
            given = table if size > 5 else table.where("coalesce(length(text), 0) < 100")
            got = columns(fill_middle.transform(fill_middle.write_frames(given, f"file://{tmp_path}/{k}-{size}", size), with_text=True), *FIM)
            assert got == sorted((expected_middle(*r) for r in rows), key=str)
    forms = Counter(expected_middle(i, "some words")[2] for i in range(40))
    assert set(forms) == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(spark.createDataFrame([], DOC)).collect() == []


def test_frames_by_force():
    rng = np.random.default_rng(5)
    for _ in range(300):
        text = "".join(rng.choice(list("ab \n\u00e9\u65e5\U0001F600"), rng.integers(0, 60)))
        data = text.encode()
        cuts = sorted(rng.integers(0, len(data) + 1, 3).tolist())
        pieces = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        f = fill_middle.Frames.build(iter(pieces), int(rng.integers(4, 20)))
        units = UNITS.findall(text)
        assert f.units[-1] == len(units) and f.chars[-1] == len(text) and b"".join(f.stream(0, len(data))) == data
        for u in range(len(units) + 1):
            before = "".join(units[:u])
            assert f.unit_at(u) == (len(before.encode()), len(before))
        a, b = sorted(rng.integers(0, len(data) + 1, 2).tolist())
        assert b"".join(f.stream(a, b)) == data[a:b]


def test_only_cut_frames_are_opened(monkeypatch):
    f = fill_middle.Frames.build(iter((b"some words here " * 5_000,)), 1024)
    opened = []
    monkeypatch.setattr(fill_middle.Frames, "frame", lambda self, k, old=fill_middle.Frames.frame: opened.append(k) or old(self, k))
    f.unit_at(7_500)
    assert len(f.at) > 50 and len(opened) == 1


# ---- prefix trie ----------------------------------------------------------------------------

TURN = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("depth", T.StringType()),
])
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def expected_trie(rows):
    """By force: every prefix as a tuple."""
    turns = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(hashlib.sha256(role.encode()).digest() + text.encode()).hexdigest()
            turns[conv_id].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = []
    children = Counter(p[:-1] for p in members if p)
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(p))))
        leaves = sum(not children[q] for q in under)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), children[p], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def tangled(seed, convs, turns, words):
    rng = np.random.default_rng(seed)
    return [(int(c), int(k), str(rng.choice(["user", "assistant"])), "x" * int(rng.integers(0, words)), None, "d") for c in rng.permutation(convs) - 12 for k in range(int(rng.integers(1, turns)))]


ODD_TURNS = [
    (None, 0, "user", "nobody's", None, None), (1, None, None, None, None, None), (1, 1, "user", None, None, None), (1, 1, "user", "tie", None, None), (1, 1, "user", "tie", None, None),
    (3, 0, "user", "日本 \U0001F600", None, None), (5, 0, "u", "xx", None, None), (5, 1, "u", "yy", None, None), (6, 0, "u", "xx", None, None), (8, 3, "user", "long " * 100_000, None, None), (9, 0, "", "", None, None), (-7, 0, "a", "b", None, None),
]


def test_prefix_trie(spark, monkeypatch):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    assert columns(prefix_trie.prefix_trie(given), *NODE) == expected_trie(map(tuple, given.collect()))
    assert columns(prefix_trie.prefix_trie(spark.createDataFrame(ODD_TURNS, TURN)), *NODE) == expected_trie(ODD_TURNS)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURN)).collect() == []


def test_prefix_trie_of_shared_and_hot_turns(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "BROADCAST_GROUPS", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rows = tangled(1, 60, 13, 3) + [(c, 0, "user", "common", None, None) for c in range(100, 140)]
    rows += [(200, 5, "user", "again", None, None)] * 20 + [(201, k, "user", "again", None, None) for k in range(17)]
    got = columns(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURN).repartition(5)), *NODE)
    assert got == expected_trie(rows)


# ---- earlier operators: bounds that must not depend on ids ------------------------------------


@pytest.mark.parametrize("doc_id", [None, 1, 7])
def test_language_sample_under_one_id(spark, doc_id):
    from veriframe.llm import language

    words = {"en": ["the", "house", "and", "garden"], "de": ["das", "haus", "und", "garten"]}
    rows = [(doc_id, f"{' '.join(w)} {k}", lang) for k in range(3000) for lang, w in words.items()] + [(doc_id, "copy of one text", "en")] * 2000
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = language.sample(table)
    held = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1
    assert Counter(langs) == ({} if held else {"en": language.SAMPLE, "de": language.SAMPLE}) and len(set(texts)) == len(texts)
