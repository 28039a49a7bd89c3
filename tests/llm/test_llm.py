import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbena.llm import chat, decontam, dedup, jaccard, langid, mixing, quality, queries, secrets, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id long"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(30000))
ODD = [(1, None, None, None, None, 1), (2, "", "en", "a", 0, 1), (3, " \n\t", "en", None, 3, 1), (4, "a  b\nc", "en", "a", 6, 1), (5, "a b c", "en", "a", 5, 1), (5, "a b c", "en", "a", 5, 1), (None, "a b c", None, "b", 5, 1), (7, LONG, "en", "b", len(LONG), 1), (8, "one two three four five six é ß", "de", "b", 30, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_dedup(odd, none):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in dedup.exact_dedup(odd).collect()), key=repr)
    assert len(got) == len(ODD) and dedup.exact_dedup(none).count() == 0
    same = [g for g in got if g[2] == 4]
    assert len(same) == 4 and sum(g[3] for g in same) == 1 and {g[1] for g in same} == {4}
    assert {g[0]: g[4] for g in got}[8] == hashlib.sha256(ODD[8][1].encode()).hexdigest()
    assert [g[1:4] for g in got if g[0] in (1, 2)] == [(1, 2, True), (1, 2, False)]


def test_mixing(odd, none):
    got = mixing.mix_sources(odd, block=16).collect()
    assert len(got) == len(ODD) and mixing.mix_sources(none).count() == 0
    for source in (None, "a", "b"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and all(r.taken <= 3 * r["size"] for r in own)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))
    again = mixing.mix_sources(odd, block=16).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    mixed = mixing.mixed_documents(odd, block=16)
    assert mixed.columns == odd.columns and mixed.select(F.sum(F.size(F.split("text", " ")))).first()[0] > 50000


def _targets(sizes, cap=3):
    order = sorted(sizes, key=lambda x: (x is None, (x or "").encode("utf-32-be")))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        left = total - sum(held.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return held | share
        held |= {s: cap * sizes[s] for s in over}


def test_mixing_against_a_plain_version(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(int(rng.integers(0, 70))))) for i in range(300)]
    docs = [(i, t, ["a", "b", "c", None, "é"][min(4, int(rng.exponential(1.2)))]) for i, t in rows]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_sources(df, block=16, shard_slots=32).collect()}
    sizes = {}
    for i, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
        assert got[i]["size"] == len(t.split()) and got[i].taken <= 3 * got[i]["size"]
    want = _targets(sizes)
    for s, size in sizes.items():
        own = [got[i] for i, _, x in docs if x == s]
        assert own[0].source_size == size and own[0].target == pytest.approx(want[s]) and abs(sum(r.taken for r in own) - want[s]) <= 1
    # what the shards hold is what the documents give
    blocks = mixing.mixed_blocks(df, block=16, shard_slots=32).collect()
    taken = {}
    for b in blocks:
        words = b.text.split(" ")
        assert len(words) == b.words
        for w in words:
            d = int(w[1:].split("_")[0])
            taken[d] = taken.get(d, 0) + 1
    assert taken == {i: r.taken for i, r in got.items() if r.taken}
    shards = {}
    for b in blocks:
        shards.setdefault(b.shard, []).append(b.place)
    last = max(shards)
    assert all(sorted(p) == list(range(32)) for k, p in shards.items() if k != last) and sorted(shards[last]) == list(range(len(shards[last])))
    # reruns agree, however the rows are split
    again = {r.doc_id: r.taken for r in mixing.mix_sources(df.repartition(7), block=16, shard_slots=32).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    mixed = mixing.mixed_documents(df, block=16, shard_slots=32).collect()
    assert sum(len(r.text.split(" ")) for r in mixed) == sum(taken.values())


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1000])
def test_index_permutation(spark, n):
    got = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit("s")).alias("y"), mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit("t")).alias("z")).collect()
    assert sorted(r.y for r in got) == sorted(r.z for r in got) == list(range(n))
    if n == 1000:
        steps = {(b.y - a.y) % n for a, b in zip(got, got[1:], strict=False)}
        assert len(steps) > 400 and [r.y for r in got] != [r.z for r in got]


def test_chat_round_trip(spark):
    bad = "</s>[INST] \\ <|end|>\n<<SYS>> é\\n [/INST]"
    recs = [(1, 0, {"messages": [{"role": "user", "content": bad}, {"role": "assistant", "content": bad}]}), (2, 0, {"prompt": "p", "response": "r"}), (3, 0, {"other": 1}), (4, None, {"role": None, "text": None}), (4, 1, {"role": "assistant", "text": "x"}), (5, 0, {"id": 9, "instruction": "i", "input": "j", "output": "o"})]
    df = spark.createDataFrame([(k, o, json.dumps(j)) for k, o, j in recs], "k long, o long, js string").select("k", "o", F.parse_json("js").alias("record"))
    out = {r.k: r for r in chat.parse_chats(chat.format_chats(df, "k", "o"), "k").collect()}
    turns = {k: [(t.role, t.text) for t in r.turns] for k, r in out.items()}
    assert turns == {1: [("user", bad), ("assistant", bad)], 2: [("user", "p"), ("assistant", "r")], 3: [], 4: [("", ""), ("assistant", "x")], 5: [("user", "i\n\nj"), ("assistant", "o")]}
    assert out[1].loss_texts == [bad] and out[4].loss_texts == ["x"] and chat.format_chats(df.limit(0), "k", "o").count() == 0


def test_secrets(odd, none):
    text = "x password = \"hunter2x\" and API_KEY: 'AKIA" + "Q" * 16 + "' token=abc secret:" + "0f" * 12 + " pwd: 9xQ!r7Lm2Zt8"
    spans = secrets.scan(text)
    assert [k for k, *_ in spans if k != "guess"] == ["assign", "assign", "access", "assign", "hex"] and ("guess", len(text) - 12, len(text)) in spans
    want = [(m.start(), m.end()) for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    assert [(a, b) for k, a, b in spans if k == "assign"] == want
    assert secrets.guesses("password")[0] < 2 < secrets.guesses("qwertyuiop")[0] < secrets.guesses("v8Kq2Lz9Xw")[0] and secrets.guesses("")[0] == 0
    assert secrets.guesses("password1987-05-12")[1][0][0] == "word"
    assert secrets.secret_scan(odd).count() == len(ODD) and secrets.secret_scan(none).count() == 0
    assert secrets.secret_scan(odd).first().base_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("before", ["pwd=", "passphrase: ", "pwd => ", 'credentials "', "auth.pwd="])
def test_secrets_of_letters_after_a_separator(before):
    value = "kXqWzRtPvLmN"
    assert secrets.scan(f"x {before}{value} y") == [("guess", 2 + len(before), 2 + len(before) + len(value))]
    assert secrets.scan("the pwd is authentication of passengers; auth: username, passcode: required") == []


def test_secrets_are_taken_whole():
    rng = np.random.default_rng(2)
    long = "".join(rng.choice(list("abcdefghijABCDEFGHIJ0123456789-_"), 303))
    assert ("guess", 22, 325) in secrets.scan("Authorization: Bearer " + long)
    padded = "pwd: " + "x1" * 40 + "kXqWzRtPvLmNbYwT"
    assert secrets.scan(padded) == [("guess", 5, len(padded))] and secrets.scan("pwd: " + "x1" * 4000) == []
    assert secrets.guesses("x1" * 40 + "kXqW9")[0] > secrets.guesses("x1" * 40)[0]


def _classes(docs, k, num, den):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("weight", [300_000, 400])
def test_jaccard_is_exact(spark, odd, none, monkeypatch, weight):
    monkeypatch.setattr(jaccard, "BLOCK_WEIGHT", weight)
    monkeypatch.setattr(jaccard, "SCREEN_WEIGHT", 10 * weight)
    rng = np.random.default_rng(3)
    docs = []
    for size in (1, 2, 5, 9, 14, 30, 60, 120):
        base = [f"w{i}" for i in rng.integers(0, 300, size)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.integers(0, 1 + max(1, size // 25))):
                w[rng.integers(0, size)] = f"z{rng.integers(0, 50)}"
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df, 4, 85, 100).collect()}
    assert got == _classes(docs, 4, 85, 100)
    if weight == 400:
        r = {x.doc_id: x for x in jaccard.jaccard_classes(odd, 4).collect()}
        assert r[2].component_id == 2 and r[5].component_id == 4 and r[1].n_shingles == 0 and jaccard.jaccard_classes(none).count() == 0
        kept = [x.doc_id for x in jaccard.keep_one(odd, jaccard.jaccard_classes(odd)).collect()]
        assert kept.count(4) == 1 and 5 not in kept


def test_pigeonhole_keys_meet():
    rng = np.random.default_rng(5)
    for size in (1, 3, 7, 12, 20, 50, 200, 900):
        for _ in range(60):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            cut = int(rng.integers(0, size // 6 + 1))
            b = np.concatenate([a[cut:], rng.integers(0, 2**63, int(rng.integers(0, size // 8 + 1))).astype(np.uint64)])
            common = size - cut
            if 100 * common >= 85 * (size + len(b) - common):
                assert set(jaccard.all_keys(np.sort(a), 85, 100).tolist()) & set(jaccard.all_keys(np.sort(b), 85, 100).tolist())


@pytest.mark.parametrize("tile", [7, 500_000])
def test_bitmaps_lose_no_link(monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = np.random.default_rng(7)
    sets = []
    for size in (1, 2, 6, 11, 40, 90, 300, 1500):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        for _ in range(8):
            new = rng.integers(0, 2**63, int(rng.integers(0, size // 5 + 1))).astype(np.uint64)
            sets.append(np.unique(np.concatenate([base[int(rng.integers(0, size // 6 + 1)) :], new])))
    n = np.array([len(s) for s in sets])
    bits, bands = [jaccard.bitmap(s, 80, 100) for s in sets], np.array([jaccard.band_of(x, 80, 100) for x in n.tolist()])
    forest = jaccard.Forest(len(sets))
    for k in np.unique(bands).tolist():
        own, above = np.flatnonzero(bands == k), np.flatnonzero(bands == k + 1)
        for right in (own, above):
            if len(right):
                jaccard.screen(n, bits, jaccard.bitmap_width(k, 80, 100), own, right, 80, 100, forest)
    met = links = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(np.intersect1d(a, b))
            same = forest.label[i] == forest.label[j]
            met += same
            if 100 * common >= 80 * (len(a) + len(b) - common):
                links += 1
                assert same
    assert 0 < links <= met < len(sets) * (len(sets) - 1) // 4  # and unlike sets stay apart


def test_decontamination(spark, odd, none):
    item = "the quick brown fox jumps over one lazy dog while seventeen green parrots watch from tall old trees"
    edited = item.replace("lazy", "sleepy").replace("green", "blue").replace("tall ", "")
    docs = spark.createDataFrame([(1, "Intro words. " + item.upper() + ". End."), (2, "aa bb " + edited), (3, "the quick brown fox and nothing else here at all"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, None), (11, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    assert set(got) == {1, 2} and got[1].score == 1 and got[2].score > 0.6 and (got[1].start_word, got[1].end_word) == (2, 20)
    assert [r.doc_id for r in decontam.keep_clean(docs, decontam.decontaminate(docs, bench)).orderBy("doc_id").collect()] == [3, 4]
    assert decontam.decontaminate(odd, bench.limit(0)).count() == 0 and decontam.decontaminate(none, bench).count() == 0


def test_a_hot_edited_group_beside_a_verbatim_copy(spark):
    words = [f"word{i}" for i in range(40)]
    edited = " ".join("changed" if i % 6 == 5 else w for i, w in enumerate(words))
    docs = spark.createDataFrame([(i, f"intro{i} {edited} outro{i}") for i in range(60)] + [(60, " ".join(words)), (61, " ".join(words[:6]) + " other text")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (r.score, r.start_word, r.end_word) for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {i: (0.775, 1, 41) for i in range(60)} | {60: (1.0, 0, 40)}


def test_align_against_plain_matrix():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(1, 6, 9).astype(np.int32), rng.integers(0, 6, 15).astype(np.int32)
        h = np.zeros((10, 16), int)
        for i in range(1, 10):
            for j in range(1, 16):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontam.align(a, b)[0] == h.max() / 18


def test_language(odd, none):
    known = {"en": ("the and that with which from this have " * 300).encode(), "de": ("der und das nicht eine auch werden sich " * 300).encode()}
    got = {r.doc_id: r for r in langid.identify(odd, known).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and len(langid.identify(odd, known).collect()) == len(ODD)
    c = langid.Classifier(known)
    assert c("This and that from the")[0] == "en" and c("Nicht eine und der das")[0] == "de"
    assert langid.learn(none) == {} and langid.identify(none, known).count() == 0 and langid.identify(odd, {}).first().lang_pred == "und"


def test_quality(spark, odd, none):
    good = [(i, f"plain words number {i} in a calm sentence, and more of it.", 40, 1) for i in range(60)]
    junk = [(100 + i, f"BUY!! NOW!! {i} $$$ ### BUY!! NOW!!", 30, 0) for i in range(60)]
    docs = spark.createDataFrame([x[:3] for x in good + junk], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(x[0], x[3]) for x in good + junk], "doc_id long, quality int")
    m = quality.train(docs, labels)
    assert all(r.predicted == (r.doc_id < 100) for r in quality.score(docs, m).collect()) and quality.keep_good(docs, m).count() == 60
    idx, x = quality.features(["some words here"], [[15.0]])[0]
    pairs = sum(m.v[i] @ m.v[j] * a * b for p, (i, a) in enumerate(zip(idx, x, strict=True)) for j, b in list(zip(idx, x, strict=True))[:p])
    assert m.margin(idx, x) == pytest.approx(m.w0 + m.w[idx] @ x + pairs)
    assert len(quality.score(odd, m).collect()) == len(ODD) and quality.score(none, m).count() == 0
    assert quality.score(odd, quality.train(docs, labels.limit(0))).count() == len(ODD)


def test_warc(spark):
    big = "x" * 2000
    pages = spark.createDataFrame([(1, "http://a/ b", big), (2, None, big), (3, "http://c", None), (4, "http://d", "é"), (5, "http://e", "é"), (None, "u", big)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.pages_through_warc(pages).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type, got[None].refers_to) == ("revisit", 2, "response", 2)
    assert got[4].record_type == got[5].record_type == "response" and got[3].payload_bytes == 0 and got[4].payload_digest == hashlib.sha1("é".encode()).hexdigest()
    assert warc.pages_through_warc(pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    data = warc.arc_bytes("n.arc.gz", version, [("http://a b c", "2001", "text/html", b"HTTP/1.0 200 OK\r\n\r\n\nbody\n\n"), ("dns:x", "x", "text/dns", b"")])
    (f, body), (g, empty) = warc.parse_arc(data)
    assert f["URL"] == "http://a b c" and body.endswith(b"\nbody\n\n") and empty == b"" and warc.warc_type(g["URL"], empty) == "resource"
    assert warc.warc_date("2001") == "2001-01-01T00:00:00Z" and warc.warc_date("x").startswith("1970")
    assert [h["WARC-Type"] for h, _ in warc.parse_warc(warc.convert("n.arc.gz", data, {}))] == ["warcinfo", "response", "resource"]


def test_arc_folder_of_other_origin(spark, tmp_path):
    big = b"y" * 1500
    one = b"".join(warc._line(1, {"URL": u, "IP-address": "1.2.3.4", "Archive-date": "1999", "Content-type": k, "Archive-length": len(b)}) + b + b"\n" for u, k, b in [("http://x/", "text/html", b"HTTP/1.0 200 OK\nA: b\n\n" + big), ("dns:x", "text/dns", big), ("ftp://f", "x/y", b"a\n\nb")])
    first = b"1 0 someone\nURL IP-address Archive-date Content-type Archive-length\n"
    (tmp_path / "plain.arc").write_bytes(b"filedesc://plain.arc 0.0.0.0 1999 text/plain %d\n" % len(first) + first + one)
    (tmp_path / "other.txt").write_bytes(b"no archive")
    manifest = warc.arc_manifest(spark, str(tmp_path))
    got = {(r.record_type, r.payload_bytes, r.refers_to_id is not None) for r in warc.read_warcs(warc.arc_to_warc(manifest, str(tmp_path), str(tmp_path / "out")), str(tmp_path / "out")).collect()}
    assert got == {("revisit", 1500, True), ("resource", 1500, False), ("resource", 4, False)}


def test_archives_are_read_in_linear_time():
    import time

    def took(n):
        data = warc.arc_bytes("n.arc.gz", 1, [("http://a", "2001", "text/html", b"HTTP/1.0 200 OK\r\n\r\n" + b"z" * 3000)] * n)
        began = time.process_time()
        assert sum(1 for _ in warc.parse_warc(warc.convert("n.arc.gz", data, {}))) == n + 1
        return time.process_time() - began

    took(100)
    assert took(8000) < 40 * took(800)


def test_tokens(odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    at = 0
    want = []
    order = sorted(ODD, key=lambda d: (d[0] is not None, d[0] or 0))
    for d in order:
        ids = np.array([*t.encode(d[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = tokens.token_binary(odd, path, file_ids=50).orderBy("start").collect()
    assert [tuple(r) for r in got] == want and tokens.token_binary(none, path).count() == 0
    e = tokens.encoder(path)
    for text in ["a <|endoftext|> b", " x\n\n\ny ", "it's  we'll\t\x1c", "½ ٣ ſ 😀", "a \n b"]:
        assert e.batch([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_bit_packing(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 10_001)
    assert (tokens.unpack(tokens.pack(x, bits), len(x), bits) == x).all()
    f = tokens.TokenFile(tokens.to_file([5, None], [9000, 10_001], x, bits))
    assert (f.doc(1) == x[9000:]).all() and (f.slice(4090, 4100) == x[4090:4100]).all() and f.doc_ids == [5, None]
    assert all((a == b).all() and len(a) == len(b) for size in (1, 100, 9500, 10**6) for a, b in zip(f.docs(size), (x[:9000], x[9000:]), strict=True))


def test_quality_stage_changes_no_value(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "plain words here", 5, "x", 1), (None, None, None, None, 2), (3, "more of it", 4, "y", 3), (3, "more of it", 4, "y", 3)], "doc_id long, text string, n_chars long, label string, rank int")
    labels = spark.createDataFrame([(big, 1), (3, 0), (3, 1), (None, 1), (9, None)], "doc_id long, quality int")
    m = quality.train(docs, labels)
    assert sorted(map(repr, quality.keep_good(docs, m, threshold=0.0).collect())) == sorted(map(repr, docs.collect()))
    assert quality.keep_good(docs, m, threshold=1.1).count() == 0 and quality.keep_good(docs.limit(0), m).columns == docs.columns


def test_stages_tell_rows_apart_by_id_and_text(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(4, words, "a"), (5, words, "b"), (5, "a text of its own that nothing else is like", "c"), (None, words + " end", "d"), (None, "again one of its own, quite unlike", "e"), (None, "again one of its own, quite unlike", "f"), (7, "", "g"), (7, "", "h")], "doc_id long, body string, component_id string")
    kept = [r.component_id for r in jaccard.keep_one(docs, jaccard.jaccard_classes(docs, text_col="body"), text_col="body").collect()]
    assert sorted(kept) in (["a", "c", "e", "g", "h"], ["a", "c", "f", "g", "h"])
    alone = spark.createDataFrame([(None, words), (None, words + " end"), (None, "x")], "doc_id long, text string")
    assert {r.text for r in jaccard.keep_one(alone, jaccard.jaccard_classes(alone)).collect()} in ({words, "x"}, {words + " end", "x"})
    bench = spark.createDataFrame([("i1", words), ("i1", "another text under the same name of an item here"), (None, "x")], "item_id string, text string")
    more = docs.unionByName(spark.createDataFrame([(8, "he said another text under the same name of an item here", "i")], docs.schema))
    found = decontam.decontaminate(more, bench, text_col="body")
    assert sorted((r.doc_id or 0, r.item_id) for r in found.collect()) == [(0, "i1"), (4, "i1"), (5, "i1"), (8, "i1")]
    assert sorted(r.component_id for r in decontam.keep_clean(more, found, text_col="body").collect()) == ["c", "e", "f", "g", "h"]


def _cheapest(value, ranks):
    """Least cost over all segmentations, each segment priced by itself."""
    from functools import lru_cache

    low, leet, each = value.lower(), value.lower().translate(secrets._LEET), np.log10(secrets._alphabet(value))

    def price(i, j):
        n, options = j - i, [((j - i) * each, "brute")]
        for form, extra in ((low, 0.0), (leet, 0.6)):
            if n >= 3 and form[i:j] in ranks:
                options.append((np.log10(ranks[form[i:j]] + 1) + extra + 0.3 * (value[i:j] != low[i:j]), "word"))
        if (m := secrets._DATE.match(value, i)) and m.end() == j:
            options.append((np.log10(130 * 365 if n > 4 else 130), "date"))
        if n >= 4 and all(low[k] in secrets._NEXT.get(low[k - 1], ()) for k in range(i + 1, j)):
            turns = sum(ord(low[k]) - ord(low[k - 1]) != ord(low[k - 1]) - ord(low[k - 2]) for k in range(i + 2, j))
            options.append((np.log10(47 * n) + 0.3 * turns, "walk"))
        steps = {ord(value[k]) - ord(value[k - 1]) for k in range(i + 1, j)}
        if n >= 4 and steps in ({1}, {-1}):
            options.append((np.log10(40 * n), "walk"))
        for unit in range(1, min(8, n // 2) + 1):
            if n % unit == 0 and value[i:j] == value[i : i + unit] * (n // unit) and n // unit >= (3 if unit == 1 else 2):
                options.append((unit * each + np.log10(n // unit), "repeat"))
        return options

    @lru_cache(maxsize=None)
    def best(j, last):
        if j == 0:
            return 0.0
        found = []
        for i in range(j):
            for cost, kind in price(i, j):
                if not (kind == "brute" and last == "brute"):
                    found.append(best(i, kind) + cost + 0.3 * (i > 0))
        return min(found, default=np.inf)

    return best(len(value), "")


@pytest.mark.parametrize("value", ["password1987-05-12", "P@ssword", "qwertyuiop12", "aaaaaaab", "abcabcabc1", "xK9#dragon", "12345678", "zyxwvu77", "Secret2020login", "v8Kq2Lz9Xw", "a", "letmein!letmein!"])
def test_guess_cost_against_all_segmentations(value):
    assert secrets.guesses(value)[0] == pytest.approx(_cheapest(value, secrets._RANK))


def test_words_of_a_vocabulary():
    ranks = secrets.word_ranks(queries.tokenizer_path(queries.WORDS))
    assert len(ranks) > 20_000 and ranks["password"] == 1 and secrets.guesses("umbrellagiraffe", ranks=ranks)[0] < 11 < secrets.guesses("umbrellagiraffe")[0]
    assert secrets.scan("pwd=umbrellagiraffe", ranks=ranks) == [] and secrets.scan("pwd=kXqWzRtPvLmN", ranks=ranks) == [("guess", 4, 16)]


def test_numbers_are_no_letters(spark):
    known = {"en": ("the and that with which from this have " * 300).encode(), "de": ("der und das nicht eine auch werden sich " * 300).encode()}
    docs = spark.createDataFrame([(1, "\u00bd \u00b2"), (2, "\u2167"), (3, "\u2460 12 _"), (4, "the and that with\u00bd")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(docs, known).orderBy("doc_id").collect()] == ["und", "und", "und", "en"]


def test_copies_take_one_place_of_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(f"text number {chr(97 + i)}", "xx") for i in range(20)] + [("the same", "xx")] * 900, "text string, lang string")
    got = langid.learn(docs)["xx"].decode()
    assert got.count("the same") == 1 and got.count("text number") == 20
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 5)
    ranks = [r[0] for r in docs.select(F.xxhash64("text").alias("h"), "text").distinct().orderBy("h").select("text").collect()]
    want = {langid.plain(t) for t in ranks[:5]}
    assert langid.learn(docs)["xx"].decode() == " ".join(langid.plain(t) for t in ranks[:5]) and len(want) == 5


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) > 0.9 * len(got)


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op5_quality_fm(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out and quality is not null").collect()
    assert len(got) > 20 and sum(r.predicted == r.quality for r in got) > 0.9 * len(got)


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    clash = {c: F.lit(i) for i, c in enumerate(("label", "rank", "n", "key", "component_id", "row_key", "h", "place", "at", "item_id"))}
    real = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([x[:5] for x in ODD], real.schema)
    docs = real.unionByName(odd).withColumns(clash)
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs, before = p.write_table(stage(spark, docs, sf), name), docs
        assert docs.columns == before.columns and 0 < docs.count()
        if name in ("quality", "near_duplicates", "decontamination"):
            assert docs.exceptAll(before).count() == 0  # rows go, none changes
    last = p.STAGES[-1][1]
    got = last(spark, docs, sf).orderBy("start").collect()
    assert len(got) == docs.count() and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert last(spark, docs.limit(0), sf).count() == 0
